"""Findings of hand-made pages, with the places that they were taken from."""

from ledgerline.functions import findings as f
from ledgerline.operators import findings


def read(lines):
    found = f.Page(lines).found
    for x in found:
        assert x.raw == (lines[x.line] or "")[x.start : x.end]
    return found


def brief(found):
    return [(x.key, x.entity, x.line, x.start, x.end, x.specimen, x.assay, x.marker) for x in found]


def test_one_specimen_one_assay():
    page = ["某医院病理报告", "标本编号：S-01  采样日期：2024年3月5日", "检测项目：PD-L1检测", "检测方法：免疫组化", "检测结果：", "ＰＤ－Ｌ１ TPS：约 60 %，CPS≥10", "ER 阳性 PR：阴性"]
    found = read(page)
    assert brief(found) == [
        ("specimen.identity", "specimen:1", 1, 5, 9, None, None, None),
        ("assay.identity", "assay:1", 2, 5, 12, 0, None, None),
        ("assay.collection_date", "assay:1", 1, 16, 25, 0, 1, None),
        ("assay.method", "assay:1", 3, 5, 9, 0, 1, None),
        ("ihc.marker", "ihc:1", 5, 0, 5, 0, 1, None),
        ("ihc.score", "ihc:1", 5, 6, 16, 0, 1, 4),
        ("ihc.score", "ihc:1", 5, 17, 23, 0, 1, 4),
        ("ihc.marker", "ihc:2", 6, 0, 2, 0, 1, None),
        ("ihc.result", "ihc:2", 6, 3, 5, 0, 1, 7),
        ("ihc.marker", "ihc:3", 6, 6, 8, 0, 1, None),
        ("ihc.result", "ihc:3", 6, 9, 11, 0, 1, 9),
    ]
    assert found[2].value == {"value": "2024-03-05", "precision": "DAY"} and found[3].value["code"] == "IHC"
    assert found[5].value == {"score": "TPS", "values": "60", "comparator": "EQ", "unit": "%", "approximate": "true"}
    assert found[6].value["comparator"] == "GE" and found[4].value == {"code": "PD_L1"}
    assert [found[i].value["assertion"] for i in (8, 10)] == ["POSITIVE", "NEGATIVE"]


def test_two_specimens_leave_results_unbound_unless_named():
    found = read(["标本号:A1 标本号:B2 标本号:A1", "ALK 阳性", "B2 ALK 阴性", "检测名称:ALK检测"])
    assert [x.raw for x in found if x.key == "specimen.identity"] == ["A1", "B2"]
    markers = [x for x in found if x.key == "ihc.marker"]
    # the assay's line names no specimen, so it is one of none; the second line's specimen has none
    assert [(x.specimen, x.assay, x.limits) for x in markers] == [(None, 2, ["unlinked_specimen"]), (1, None, ["unlinked_assay"])]


def test_sections_and_words_that_take_results_away():
    page = ["送检材料:肺组织", "临床信息", "病理诊断:腺癌", "质控结果:", "ER 阳性", "标本编号:Q9", "检测结果:", "PR 阳性", "既往结果 ER 阳性", "HER2 待测", "备注", "MSH6 阳性"]
    found = read(page)
    assert [(x.key, x.raw, x.limits) for x in found] == [
        ("specimen.identity", "肺组织", ["material_only"]),
        ("specimen.description", "肺组织", []),
        ("ihc.marker", "PR", ["unlinked_assay"]),
        ("ihc.result", "阳性", ["unlinked_assay"]),
    ]


def test_fields_and_assertions():
    page = ["标本编号:S1", "病理诊断:浸润性腺癌,未见脉管癌栓", "肿瘤大小:2.5×1.8cm,另见 3 mm", "切缘:/", "报告日期:2024-01-02 2024-01-03", "病理分期:pT1", "克隆号:22C3", "NapsinA免疫组化检测"]
    found = read(page)
    assert [(x.key, x.raw) for x in found] == [
        ("specimen.identity", "S1"),
        ("assay.identity", "NapsinA免疫组化检测"),
        ("specimen.histology", "浸润性腺癌,未见脉管癌栓"),
        ("specimen.dimensions", "2.5×1.8cm"),
        ("specimen.dimensions", "3 mm"),
        ("pathology.reported_stage", "pT1"),
        ("assay.antibody", "22C3"),
    ]
    assert found[2].value["assertion"] == "NEGATIVE" and found[5].entity == "report"


def test_scores_that_are_none():
    for text, n in (("PD-L1 TPS 50%", 1), ("PD-L1 TPS 1-5%", 1), ("PD-L1 TPS<1-5%", 0), ("PD-L1 TPS 150%", 0), ("PD-L1 CPS 150", 1), ("PD-L1 TPS 5%a", 0), ("PD-L1TPS:5%CPS:6", 2), ("APD-L1 TPS 5%", 0), ("ALKx TPS 5%", 0), ("非ER 阳性", 0)):
        assert sum(x.key == "ihc.score" for x in read([text])) == n, text
    assert [f.asserted(x) for x in ("未检测到", "未检测", "可疑阳性", "检出", "x")] == ["NOT_DETECTED", "NOT_TESTED", "UNCERTAIN", "DETECTED", "SOURCE_TEXT_ONLY"]


def test_as_a_table_function(spark):
    rows = [("a", 3, "ER 阳性", "x"), ("a", 1, "标本编号:S1", "x"), ("b", 1, None, "x"), ("b", 2, "", "x"), (None, 5, "PR 阴性", "x"), ("a", 2, "检测项目:P40", "x"), ("a", 3, "ER 阳性", "x")]
    df = spark.createDataFrame(rows, "page string, line int, text string, raw string").repartition(4)
    got = findings.pathology(df).collect()
    assert [(r.page, r.number, r.key, r.line, r.specimen, r.assay, r.marker) for r in sorted(got, key=lambda r: (r.page is not None, r.page, r.number))] == [
        (None, 0, "ihc.marker", 5, None, None, None),
        (None, 1, "ihc.result", 5, None, None, 0),
        ("a", 0, "specimen.identity", 1, None, None, None),
        ("a", 1, "assay.identity", 2, 0, None, None),
        *[("a", 2 + k, key, 3, 0, 1, marker) for k, (key, marker) in enumerate([("ihc.marker", None), ("ihc.result", 2), ("ihc.marker", None), ("ihc.result", 4)])],
    ]
    assert next(r for r in got if r.key == "ihc.result" and r.page == "a").value == {"text": "阳性", "assertion": "POSITIVE"}
    assert findings.pathology(df.where("false")).count() == 0
