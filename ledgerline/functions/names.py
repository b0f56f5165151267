"""Names of indicators as they are printed: cleaned of marks and results, and what can't be a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import folded

# Results in words, and words that no indicator's name holds.
RESULTS = ["未检出", "未报告", "未见", "阴性", "阳性", "弱阳性", "可疑", "溶血", "拒收", "正常", "异常", "negative", "positive"]
NO_NAMES = ["姓名", "患者", "病人", "受检者", "身份证", "住院", "门诊", "病历号", "条码号", "样本号", "标本号", "床号", "科室", "医生", "医师", "性别", "年龄", "出生日期", "联系电话", "手机号码", "报告日期", "采样日期", "采样时间", "送检时间", "审核时间", "检验报告", "申请单", "病史", "诊断", "治疗", "化疗", "本检测项目"]
PLACES = "医院|(检验科|化验室|检测中心|医学中心)$"
HEADERS = ["项目", "名称", "结果", "单位", "参考", "范围", "提示", "方法"]
WHOLE_HEADERS = ["项目名称", "检验项目", "检验结果", "参考范围"]

_HAN = r"[㐀-䶿一-鿿]"
_MARKS = r"^(?:[\s*•·●▪■□◆◇▶►↑↓★☆△]+|\d{1,3}\s*(?:[.)、:]|[★☆*△]+)\s*)+"
_NUMBER = r"(?<![A-Za-z0-9_-])(?:[<>≤≥]=?\s*)?[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?(?:\s*[↑↓HL])?(?=\s|$)"
_WORD = rf"(?:^|[\s:])(?:{'|'.join(RESULTS)})(?:\s|$)"


def _plain(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"\p{C}", ""), r"\s+", " "))
    return _grown(clean)


def _grown(text: Column) -> Column:
    """Without the spaces between Chinese signs, and around one letter between them."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?<={_HAN})\s+(?={_HAN})", ""), rf"(?<={_HAN})\s+([A-Za-z])\s+(?={_HAN})", "$1")


def candidate_name(text: Column) -> Column:
    """The name in a printed row: no list marks before it, no result or flag behind it, at most 160 signs; null stays null."""
    unmarked = F.trim(F.regexp_replace(_plain(text), _MARKS, ""))
    cut = rf"(?i)^(.*?)(?:{_WORD}|{_NUMBER}).*$"
    name = F.regexp_replace(F.when(unmarked.rlike(cut), F.regexp_replace(F.regexp_extract(unmarked, cut, 1), r"[ :,;]+$", "")).otherwise(unmarked), r"(?i)\s*(?:[↑↓]|(?<![\p{L}\p{N}_])[HL]|[+*])\s*$", "")
    return F.trim(F.left(_grown(F.regexp_replace(name, r"^[ :,;|]+|[ :,;|]+$", "")), F.lit(160)))


def no_name(text: Column) -> Column:
    """Whether a text can't be an indicator's name: too short or long, prose, a person's or a place's data, a header, a long number. Null can't."""
    t = _plain(text)
    headers = sum((F.contains(t, F.lit(w)).cast("int") for w in HEADERS), F.lit(0))
    bad = ~F.length(t).between(2, 96) | t.rlike("|".join(NO_NAMES)) | t.rlike(PLACES) | t.rlike(r"[,。;！？!?]") | t.isin(*WHOLE_HEADERS) | (headers >= 3) | t.rlike(r"\d{6,}") | ~t.rlike(r"[\p{L}\-_()]")
    return F.coalesce(bad, F.lit(True))
