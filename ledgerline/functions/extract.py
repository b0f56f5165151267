"""Facts in free text: sections, dimensions, uptake values, clauses with their assertion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.operators.series import over

_NUMBER = r"\d+(?:\.\d+)?"


def dimensions(text: Column) -> Column:
    """Array of struct(values in mm, unit) of size literals such as ``12 x 8.5 mm``."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i){_NUMBER}(?:\s*(?:mm|cm))?(?:\s*[x×*]\s*{_NUMBER}(?:\s*(?:mm|cm))?){{0,2}}\s*(?:mm|cm)\b|(?i){_NUMBER}\s*(?:mm|cm)\b"), F.lit(0))

    def one(s: Column) -> Column:
        unit = F.lower(F.regexp_extract(s, r"(?i)(mm|cm)\s*$", 1))
        scale = F.when(unit == "cm", 10.0).otherwise(1.0)
        return F.struct(F.transform(F.regexp_extract_all(s, F.lit(f"({_NUMBER})"), F.lit(1)), lambda v: v.cast("double") * scale).alias("mm"), unit.alias("unit"))

    return F.transform(found, one)


def uptake(text: Column) -> Column:
    """Array of struct(comparator, value) of standard uptake values."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)SUV\s*(?:max)?\s*[:=]?\s*(?:<=|>=|[<>≤≥])?\s*{_NUMBER}"), F.lit(0))
    return F.transform(found, lambda s: F.struct(F.when(s.rlike("[<≤]"), "LE").when(s.rlike("[>≥]"), "GE").otherwise("EQ").alias("comparator"), F.regexp_extract(s, rf"({_NUMBER})$", 1).cast("double").alias("value")))


def sections(lines: DataFrame, headings: dict[str, str]) -> DataFrame:
    """(document_id, section, heading, text) of documents cut at their headings; lines before the first have no section.

    lines: document_id, line, text.  headings: section name and the pattern of its
    heading, which may be followed by text on the same line.
    """
    name, rest = F.lit(None).cast("string"), F.col("text")
    for section, pattern in reversed(headings.items()):
        start = rf"^\s*(?:{pattern})\s*[:：]?\s*"
        name = F.when(F.col("text").rlike(start), section).otherwise(name)
        rest = F.when(F.col("text").rlike(start), F.regexp_replace("text", start, "")).otherwise(rest)
    w = over(["document_id"], "line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"heading": name, "body": rest}).withColumns({"section": F.last("heading", ignorenulls=True).over(w), "part": F.count("heading").over(w)})
    joined = F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"])
    return marked.groupBy("document_id", "part", "section").agg(F.trim(F.array_join(F.filter(joined, lambda x: x != ""), "\n")).alias("text")).drop("part")


def clauses(text: Column, terms: str) -> Column:
    """Array of struct(clause, assertion) of clauses that name a term: negated, uncertain, historical or present."""
    cut = F.filter(F.split(text, r"[.;。；\n]"), lambda c: c.rlike(f"(?i){terms}"))
    return F.transform(
        cut,
        lambda c: F.struct(
            F.trim(c).alias("clause"),
            F.when(c.rlike(r"(?i)\b(no|not|without|denies|negative for)\b"), "negated").when(c.rlike(r"(?i)\b(possible|suspected|may|probable|cannot exclude)\b"), "uncertain").when(c.rlike(r"(?i)\b(history of|previous|prior)\b"), "historical").otherwise("present").alias("assertion"),
        ),
    )


@F.pandas_udf(T.StringType())
def joined_overlap(first: pd.Series, second: pd.Series) -> pd.Series:
    """Two texts in a row, with what ends the one and begins the other only once; built-ins have no such search."""

    def one(a, b):
        if a is None or b is None:
            return a if b is None else b
        for n in range(min(len(a), len(b)), 0, -1):
            if a.endswith(b[:n]):
                return a + b[n:]
        return a + b

    return pd.Series([one(a, b) for a, b in zip(first, second, strict=True)], dtype=object)


def table_rows(cells: DataFrame, roles: list[str]) -> DataFrame:
    """(version_id, page_number, row, and one text for each role) of the cells of a table, by the nearest header's column.

    cells: version_id, page_number, row, x, text.  A row whose cells name at least two
    roles is a header; it holds for the rows below it.
    """
    header = F.col("text").isin(*roles)
    per_row = cells.groupBy("version_id", "page_number", "row").agg(
        F.count_if(header).alias("n"), F.collect_list(F.when(header, F.struct(F.col("text").alias("role"), "x"))).alias("anchors"), F.collect_list(F.struct("x", "text")).alias("cells")
    )
    w = over(["version_id", "page_number"], "row").rowsBetween(Window.unboundedPreceding, 0)
    under = per_row.withColumn("head", F.last(F.when(F.col("n") >= 2, F.col("anchors")), ignorenulls=True).over(w)).where("n < 2 AND head IS NOT NULL")
    near = under.select("version_id", "page_number", "row", "head", F.explode("cells").alias("c"))
    role = F.array_min(F.transform("head", lambda h: F.struct(F.abs(h["x"] - F.col("c.x")).alias("d"), h["role"].alias("role"))))["role"]
    texts = near.withColumn("role", role).groupBy("version_id", "page_number", "row", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["text"]), " ").alias("t"))
    return texts.groupBy("version_id", "page_number", "row").pivot("role", roles).agg(F.first("t"))
