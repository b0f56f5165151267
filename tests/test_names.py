"""Printed names and statements that may be carried, on hand-made rows."""

from pyspark.sql import functions as F

from ledgerline.functions import names, policy


def test_names(spark):
    cases = {
        "1. 白细胞 5.2 ↑": ("白细胞", False),
        "★ 12、血 红 蛋 白 120 g/L": ("血红蛋白", False),
        "白细胞计数H": ("白细胞计数H", False),
        "WBC H": ("WBC", False),
        "维生素 D 测定 20": ("维生素D测定", False),
        "抗体：阴性": ("抗体", False),
        "抗体 弱阳性 (+)": ("抗体弱阳性 (+)", False),  # spaces between Chinese signs go first
        "抗体 IgG 弱阳性 (+)": ("抗体 IgG", False),
        "CA19-9": ("CA19-9", False),
        "CA19-9 <2": ("CA19-9", False),
        "ＡＬＴ　１２": ("ALT", False),
        "T3 1.5e-3 L": ("T3", False),
        "-5": ("", True),
        "阴性": ("", True),
        "x": ("x", True),
        "患者姓名 张": ("患者姓名张", True),
        "市医院": ("市医院", True),
        "院检验科": ("院检验科", True),
        "检验科项": ("检验科项", False),
        "项目 名称 单位": ("项目名称单位", True),
        "参考范围": ("参考范围", True),
        "a1234567": ("a1234567", True),
        "好,不": ("好,不", True),
        "12#34": ("12#", True),
        "y" * 200: ("y" * 160, True),
        "": ("", True),
        None: (None, True),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").withColumn("name", names.candidate_name(F.col("t")))
    got = [(r.name, r.bad) for r in sorted(df.withColumn("bad", names.no_name(F.col("name"))).collect())]
    assert [(t, *x) for t, x in zip(cases, got, strict=True)] == [(t, *x) for t, x in cases.items()]


def test_selectable(spark):
    rows = [
        (True, False, "CONFIRMED", None, "肺癌", False, "selectable"),
        (True, False, None, None, "any", True, "selectable"),
        (True, False, None, None, "any", False, "label"),
        (True, False, None, None, "y" * 161, True, "label"),
        (True, False, None, None, None, True, "label"),
        (True, False, "DEFERRED", None, "肺癌", True, "status"),
        (True, False, "PENDING", "EXCLUDED", "肺癌", True, "parent"),
        (True, True, "EXCLUDED", None, "肺癌", True, "changed"),
        (True, None, None, None, "肺癌", True, "changed"),
        (False, False, None, None, "肺癌", True, "source"),
        (None, False, None, None, "肺癌", True, "source"),
        (True, False, None, None, "肺癌", None, "selectable"),
        (True, False, None, None, "other", None, "label"),
    ]
    df = spark.createDataFrame(rows, "v boolean, c boolean, s string, p string, l string, m boolean, want string")
    got = df.withColumn("got", policy.selectable(*map(F.col, "vcsplm"), ["肺癌"])).collect()
    assert [r for r in got if r.got != r.want] == []
