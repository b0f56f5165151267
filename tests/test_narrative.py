"""Subjects of terms in running text, on sentences with known answers and against a plain search."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from ledgerline.functions import narrative as n
from ledgerline.functions.text import placed

RECORD = dt.date(2024, 5, 6)


def found(spark, cases):
    df = spark.createDataFrame([(i, t, r, d) for i, (t, r, d) in enumerate(cases)], "i int, t string, role string, record date")
    out = [[] for _ in cases]
    for r in n.subjects(df, "t", F.col("record"), F.col("role")).collect():
        out[r.i].append(r)
    return [sorted(rows, key=lambda r: r.start) for rows in out]


def test_sentences(spark):
    chief, admitted, exams = "CHIEF_COMPLAINT", "ADMISSION_NARRATIVE", "AUXILIARY_FINDINGS"
    cases = [
        ("患者诊断为肺癌。", None, RECORD, ["CURRENT_PRIMARY"]),
        ("目前确诊肺癌", None, None, ["CURRENT_PRIMARY"]),
        ("诊断为肺癌", None, RECORD, ["UNKNOWN"]),
        ("诊断为肺癌", chief, RECORD, ["CURRENT_PRIMARY"]),
        ("肺癌术后", chief, RECORD, ["CURRENT_PRIMARY"]),
        ("咳嗽诊断为肺癌", chief, RECORD, ["UNKNOWN"]),
        ("父亲患肺癌,患者确诊为胰腺癌", chief, RECORD, ["OTHER_PERSON", "OTHER_PERSON"]),
        ("父亲患肺癌,但患者确诊为胰腺癌", chief, RECORD, ["OTHER_PERSON", "CURRENT_PRIMARY"]),
        ("父亲患肺癌；患者确诊为胰腺癌", None, RECORD, ["OTHER_PERSON", "CURRENT_PRIMARY"]),
        ("既往肺癌,目前诊断为胰腺癌", None, RECORD, ["HISTORICAL", "HISTORICAL"]),
        ("转移性肺癌可能", chief, RECORD, ["METASTATIC_SITE"]),
        ("患者因“肺癌”收入院", admitted, RECORD, ["CURRENT_PRIMARY"]),
        ("患者因“肺癌”就诊", admitted, RECORD, ["UNKNOWN"]),
        ("2024年5月6日CT检查诊断:肺癌", exams, RECORD, []),
        ("2024年5月6日CT提示肺癌", exams, RECORD, ["CURRENT_PRIMARY"]),
        ("2024-5-5CT提示肺癌", exams, RECORD, ["HISTORICAL"]),
        ("2024.05.07CT提示肺癌", exams, RECORD, ["UNKNOWN"]),
        ("2024年5月6日CT提示肺癌", exams, None, ["UNKNOWN"]),
        ("2024年2月30日CT提示肺癌", exams, RECORD, ["UNKNOWN"]),
        ("CT提示肺癌", exams, RECORD, ["UNKNOWN"]),
        ("2024年5月5日诊断为肺癌", chief, RECORD, ["HISTORICAL"]),
        ("患者确诊为肺癌和胰腺癌", None, RECORD, ["CURRENT_PRIMARY", "CURRENT_PRIMARY"]),
        ("小细胞肺癌", chief, RECORD, []),
        ("肺癌患者", chief, RECORD, []),
        ("1、肺癌", chief, RECORD, ["CURRENT_PRIMARY"]),
        ("", chief, RECORD, []),
        (None, chief, RECORD, []),
    ]
    for (t, *_, want), rows in zip(cases, found(spark, [c[:3] for c in cases]), strict=True):
        assert [r.subject for r in rows] == want, t


def test_spans_against_a_plain_search(spark):
    rng = random.Random(5)
    bits = n.TERMS.split("|") + ["患者", "诊断为", "父亲患", "既往", ",", "，", "但", "和", "、", "。", ";", "\n", "😀", "2024年5月6日", "2024-5-7", "术后", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(800)]
    total = 0
    for text, rows in zip(texts, found(spark, [(t, "CHIEF_COMPLAINT", RECORD) for t in texts]), strict=True):
        want = []
        for clause in re.finditer(r"[^。;；\r\n]+", text):
            body = clause.group()
            for m in re.finditer(n.TERMS, body):
                left = re.sub(f"^{n.ORDINAL}", "", body[: m.start()])
                if (left == "" or re.search(f"(?:{n.BEFORE})[“\"']?$", left)) and re.match(n.BEHIND, body[m.end() :]):
                    begin = max([x.end() for x in re.finditer(n.CONTRAST, body[: m.start()])], default=0)
                    stop = re.search(f"{n.CONTRAST}|{n.COORDINATION}|[,，]", body[m.end() :])
                    context = body[begin : m.end() + stop.start() if stop else len(body)]
                    day = re.match(n.DAY, context)
                    time = ("CURRENT_PRIMARY" if day.group(3) == "6" else "UNKNOWN") if day else None
                    other, earlier = re.search(n.OTHER_PERSON, context), re.search(n.EARLIER, context)
                    want.append((m.group(), clause.start() + m.start(), clause.start() + m.end(), clause.start(), clause.end(), time, "OTHER_PERSON" if other else "HISTORICAL" if earlier else None))
        assert [(r.term, r.start, r.end, r.clause_start, r.clause_end, r.time, r.subject if r.subject in ("OTHER_PERSON", "HISTORICAL") else None) for r in rows] == want, text
        total += len(want)
    assert total > 200


def test_placed(spark):
    df = spark.createDataFrame([("a1b22",), ("",), (None,), ("7",), ("é😀9",)], "t string")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(placed(F.col("t"), r"\d+")).collect()]
    assert got == [[("1", 1, "a", "b"), ("22", 3, "b", "")], [], None, [("7", 0, "", "")], [("9", 2, "é😀", "")]]
