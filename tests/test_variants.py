"""Variants of hand-made grids, with the places that their parts were taken from."""

from ledgerline.functions import variants as v
from ledgerline.operators import findings


def read(rows):
    found = v.Grid(rows).records
    for r in found:
        for p in r.parts:
            assert any(x == p.x and p.end <= len(t) and p.start < p.end for x, t in rows[p.row])
    return found


def brief(r):
    return {n: r.values(n) for n in ("gene", "coding", "protein", "transcript", "exon", "fusion", "fraction", "copies") if r.values(n)}


def test_one_column_holds_several_components():
    rows = [[(0, "基因"), (5, "变异"), (9, "突变丰度")], [(0, "EGFR"), (5.2, "NM_005228.5 exon 21 c.2573T>G p.L858R"), (9, "12.5%")], [(5, "c.2369C>T p.T790M"), (9, "＜1%")]]
    a, b = read(rows)
    assert brief(a) == {"gene": ["EGFR"], "coding": ["c.2573T>G"], "protein": ["p.L858R"], "transcript": ["NM_005228.5"], "exon": ["21"], "fraction": ["EQ 12.5%"]}
    assert brief(b) == {"gene": ["EGFR"], "coding": ["c.2369C>T"], "protein": ["p.T790M"], "fraction": ["LT 1%"]}  # the gene stands for the row below
    assert [r.status for r in (a, b)] == ["COMPLETE"] * 2
    text = rows[1][1][1]
    assert {text[p.start : p.end] for p in a.parts if p.x == 5.2} == {"NM_005228.5", "exon 21", "c.2573T>G", "p.L858R"}
    assert next(p.row for p in b.parts if p.name == "gene") == 1


def test_headers_change_and_headings_end_them():
    rows = [
        [(0, "基因"), (4, "氨基酸变化")], [(0, "KRAS"), (4, "p.G12C")],
        [(0, "基因"), (4, "拷贝数"), (8, "结果")], [(0, "MET"), (4, "≥6"), (8, "阳性")],
        [(0, "历史结果")], [(0, "TP53"), (4, "p.R175H")],
        [(0, "检测基因"), (4, "核苷酸变化"), (8, "检出情况")], [(0, "TP53"), (4, "c.524G>A"), (8, "未检出")],
        [(0, "体细胞变异结果")], [(0, "基因"), (4, "变异")], [(0, "ALK"), (4, "EML4-ALK 融合")], [(4, "EML4::ALK fusion")],
    ]
    found = read(rows)
    assert [(r.row, r.role, r.scope, r.assertion, brief(r)) for r in found] == [
        (1, "CURRENT", "UNKNOWN", None, {"gene": ["KRAS"], "protein": ["p.G12C"]}),
        (3, "CURRENT", "UNKNOWN", "POSITIVE", {"gene": ["MET"], "copies": ["GE 6"]}),
        (7, "HISTORICAL", "UNKNOWN", "NOT_DETECTED", {"gene": ["TP53"], "coding": ["c.524G>A"]}),
        (10, "CURRENT", "SOMATIC", None, {"gene": ["ALK"], "fusion": ["EML4-ALK"]}),
        (11, "CURRENT", "SOMATIC", None, {"fusion": ["EML4-ALK"]}),
    ]


def test_what_differs_or_lacks_is_not_settled():
    head = [(0, "基因"), (4, "变异"), (8, "丰度")]
    found = read([head, [(0, "EGFR"), (4, "KRAS p.G12C")], [(0, "EGFR"), (4, "p.L858R p.T790M")], [(0, "EGFR")], [(4, "p.L858R")], [(0, "BRAF NRAS"), (4, "p.V600E")], [(4, "p.V600E")], [(2, "p.V600E")], [(8, "150%")]])
    assert [(r.row, r.status) for r in found] == [(1, "UNRESOLVED"), (2, "UNRESOLVED"), (3, "INCOMPLETE"), (4, "COMPLETE"), (5, "UNRESOLVED"), (6, "INCOMPLETE")]
    assert read([[(0, "基因"), (4, "基因")], [(0, "EGFR"), (4, "p.L858R")]]) == [] and read([[(0, "EGFR p.L858R")]]) == [] and read([]) == []


def test_as_a_table_function(spark):
    cells = [("a", 2, 0.0, "EGFR"), ("a", 1, 4.0, "变异"), ("a", 1, 0.0, "基因"), ("a", 2, 4.0, "p.L858R"), ("a", 7, 4.0, "p.T790M"), ("b", 1, 0.0, None), (None, 3, 4.0, "p.V600E"), (None, 1, 0.0, "基因"), (None, 1, 4.0, "变异"), ("a", None, 0.0, "x")]
    df = spark.createDataFrame(cells, "page string, row int, x double, text string").repartition(4)
    got = findings.molecular(df).collect()
    assert sorted((r.page or "", r.row, r.gene, r.protein, r.status) for r in got if r.page) == [("a", 2, "EGFR", "p.L858R", "COMPLETE"), ("a", 7, "EGFR", "p.T790M", "COMPLETE")]
    assert [(r.row, r.gene, r.status) for r in got if r.page is None] == [(3, None, "INCOMPLETE")]
    assert next((p.row, p.x, p.start, p.end) for r in got if r.row == 7 for p in r.parts if p.name == "gene") == (2, 0.0, 0, 4)
    assert findings.molecular(df.where("false")).count() == 0
