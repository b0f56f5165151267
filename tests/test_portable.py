"""Version upgrades of nested lines, and the tails of printed results."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.sources import tables

SCHEMAS = {
    1: "version int, name string, reports array<struct<id:int,value:string>>",
    2: "version int, person struct<name:string>, reports array<struct<id:int,values:array<struct<code:string,value:string>>>>",
    3: "version int, person struct<name:string,tags:array<string>>, reports array<struct<id:int,values:array<struct<code:string,value:string,unit:string>>>>",
}


def second(r):
    one = lambda x: F.struct(x["id"].alias("id"), F.array(F.struct(F.lit("main").alias("code"), x["value"].alias("value"))).alias("values"))
    return F.struct(F.lit(2).alias("version"), F.struct(r["name"].alias("name")).alias("person"), F.transform(r["reports"], one).alias("reports"))


def third(r):
    value = lambda v: F.struct(v["code"].alias("code"), v["value"].alias("value"), F.lit(None).cast("string").alias("unit"))
    one = lambda x: F.struct(x["id"].alias("id"), F.transform(x["values"], value).alias("values"))
    return F.struct(F.lit(3).alias("version"), F.struct(r["person"]["name"].alias("name"), F.array().cast("array<string>").alias("tags")).alias("person"), F.transform(r["reports"], one).alias("reports"))


LINES = [
    '{"version": 1, "name": "é", "reports": [{"id": 1, "value": "5"}, {"id": 2, "value": null}], "extra": 1}',
    '{"version": 2, "person": {"name": "b"}, "reports": [{"id": 3, "values": [{"code": "x", "value": "1"}]}]}',
    '{"version": 3, "person": {"name": "c", "tags": ["t"]}, "reports": [{"id": 4, "values": [{"code": "y", "value": "2", "unit": "g"}]}]}',
    '{"version": 3}',
    '{"version": 4, "person": {}}',
    '{"name": "none"}',
    '{"version": 1, "reports": "not a list"}',
    "[1]",
    "no json",
    "",
    None,
]


def test_three_versions_in_one_folder_give_one_schema(spark, tmp_path):
    for i, line in enumerate(LINES[:3]):
        (tmp_path / f"{i}.jsonl").write_text(line + "\n")
    good, bad = tables.versioned(spark.read.text(str(tmp_path)), SCHEMAS, {1: second, 2: third})
    rows = {r.read_as: r for r in good.collect()}
    assert [rows[k].version for k in (1, 2, 3)] == [3, 3, 3] and bad.count() == 0
    assert rows[1].asDict(True) == {"read_as": 1, "version": 3, "person": {"name": "é", "tags": []}, "reports": [{"id": 1, "values": [{"code": "main", "value": "5", "unit": None}]}, {"id": 2, "values": [{"code": "main", "value": None, "unit": None}]}]}
    assert rows[2].asDict(True)["reports"] == [{"id": 3, "values": [{"code": "x", "value": "1", "unit": None}]}]
    assert rows[3].asDict(True)["person"] == {"name": "c", "tags": ["t"]}


def test_rejected_lines_have_a_reason(spark):
    good, bad = tables.versioned(spark.createDataFrame([(x,) for x in LINES], "value string"), SCHEMAS, {1: second, 2: third})
    assert good.count() == 4
    assert {r.value: r.reason for r in bad.collect()} == {LINES[4]: "version", LINES[5]: "version", LINES[6]: "schema", LINES[7]: "unreadable", LINES[8]: "unreadable", "": "unreadable", None: "unreadable"}
    with pytest.raises(ValueError):
        tables.versioned(bad, SCHEMAS, {1: second})


def test_tails_of_results(spark):
    cases = {
        "5.2 g/L 10-20 H": ("5.2", "g/L", "10-20", "H"),
        "5.2 g/L 10 - 20 ↑": ("5.2", "g/L", "10 - 20", "↑"),
        "5.2 10^9 / L 4--10": ("5.2", "10^9 / L", "4--10", ""),
        "5.2 10^9 / L": ("5.2", "10^9 / L", "", ""),
        "5.2 10^9 / L L": ("5.2", "10^9 / L", "", "L"),
        "5.2 ≤ 60": ("5.2", "", "≤ 60", ""),
        "5.2 H": ("5.2", "", "", "H"),
        "5.2 mmol/L": ("5.2", "mmol/L", "", ""),
        "5.2": ("5.2", "", "", ""),
        "5.2 x 10": ("5.2", "x 10", "", ""),
        "  <5   g/L   <60  ": ("<5", "g/L", "<60", ""),
        "5 7 3-9 L": ("5", "7", "3-9", "L"),
        "5 g H 3-9": ("5", "g H", "3-9", ""),
        " ": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.result_tail(F.col("t")).alias("r")).collect()
    assert {r.t: r.r and tuple(r.r) for r in rows} == cases


def test_observed_writes(spark, tmp_path):
    from ledgerline.sources.sinks import write_observed

    metrics = {"n": F.count(F.lit(1)), "nulls": F.count_if(F.col("v").isNull()), "most": F.max("v")}
    df = spark.createDataFrame([(1, 2), (2, None), (2, None), (None, 7)], "k int, v int").repartition(3)
    assert write_observed(df, f"{tmp_path}/some", metrics) == {"n": 4, "nulls": 2, "most": 7}
    assert spark.read.parquet(f"{tmp_path}/some").agg(*(m.alias(x) for x, m in metrics.items())).first().asDict() == {"n": 4, "nulls": 2, "most": 7}
    assert write_observed(df.limit(0), f"{tmp_path}/none", metrics) == {"n": 0, "nulls": 0, "most": None}
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0
