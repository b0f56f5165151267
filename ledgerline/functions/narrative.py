"""Whom a diagnosis in running text is about: terms, their context within a clause, and how the day said there lies to the record's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import placed

# Words and forms of the reports' language.
TERMS = "右肺上叶浸润性腺癌|胰头导管腺癌|胰腺癌|胰头癌|肺癌"
CONTRAST = "但是|然而|不过|但|而"
COORDINATION = "以及|合并|伴|及|和|与|或|、|/"
OTHER_PERSON = "父亲|母亲|父母|兄弟|姐妹|祖父|祖母|外祖|家族史|他人|丈夫|妻子|配偶|儿子|女儿|兄长|哥哥|弟弟|姐姐|妹妹"
EARLIER = "既往|曾患|曾诊断|历史|此前"
HISTORY = "既往|曾患|病史|历史"
SPREAD = "转移性|转移(?:癌|肿瘤)|继发(?:性)?(?:癌|肿瘤)"
BEFORE = "[、,/因]|但是|然而|不过|但|而|以及|合并|伴|及|和|与|或者|或|患者|确诊|诊断|确诊为|诊断为|明确|提示|考虑|倾向|可能|可疑|疑似|不能排除|无法排除|不能除外|不除外|待排|排除|未见|未发现|未检出|未证实|否认|无|患有|曾患|患|既往|父亲|母亲|转移性|家族史[:：]?"
BEHIND = "$|[().、,/?”\"']|p?[TNM][0-9xX?]|[IVX]+[A-C]?期|明确|确诊|待排|待定|可能|可疑|倾向|考虑|不除外|不能除外|不能排除|无法排除|未(?:见|检出|检测到|发现)|否认|术后|治疗后|合并|伴|及|和|与|或|转移|均|皆|两者|二者|收入院|入院"
PLAIN = "患者|从未患|未患|患有|患|确诊为|诊断为|明确|提示|考虑|倾向|可能|可疑|疑似|不能排除|无法排除|不能除外|不除外|待排|排除|未见|未发现|未检出|未证实|否认|无|[,，()]"
MARKED = "(?:患者|本患者)(?:目前|现)?(?:诊断为|诊断|确诊为|确诊|患有|患)|(?:目前|现)(?:患者)?(?:诊断为|诊断|确诊为|确诊|患有|患)"
EXAM = "(?:(?:胸部)?CT|MRI|影像)?(?:检查)?(?:诊断[:：]?|检查所见[:：]?|结果[:：]?|提示|考虑)+"
ADMITTED = "(?:患者|本患者)?因[“\"']?"
ORDINAL = r"(?:\(?[0-9IVX]+[.)、]|[一二三四五六七八九十]+、)"
DAY = r"(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})日?(?!\d)"


def subjects(df: DataFrame, text: str, record_date: Column, role: Column) -> DataFrame:
    """A row for each term that stands free in a clause, with the other columns of its row: term, start, end, clause_start, clause_end, day, time, subject.

    Clauses end at 。 ; ； and line ends.  A term's context goes from the last contrast before it to the next contrast, list sign or comma.
    A day that begins the context lies to the record's day: CURRENT_PRIMARY, HISTORICAL or (later, impossible, or no record day) UNKNOWN.
    subject: OTHER_PERSON, HISTORICAL or METASTATIC_SITE where the context says so, in this order; CURRENT_PRIMARY only where the words
    before the term are all of the patient's own statement, in a form that the role (CHIEF_COMPLAINT, ADMISSION_NARRATIVE,
    AUXILIARY_FINDINGS) admits or that names the patient; else UNKNOWN.  Offsets are code points, end exclusive, in the text as it is
    (width and white space aren't folded).  Null texts, and terms grown together with other words, give no rows.
    """
    c, kept = F.col, [x for x in df.columns if x != text]
    df = df.withColumns({"__record": record_date, "__role": role}).select(*kept, "__record", "__role", F.explode(placed(c(text), r"[^。;；\r\n]+")).alias("__c"))
    df = df.where(c("__c.hit").rlike(TERMS)).withColumn("__t", F.explode(placed(c("__c.hit"), TERMS)))
    df = df.withColumns({"__left": F.left("__c.hit", c("__t.start")), "__right": F.substr("__c.hit", c("__t.start") + F.length("__t.hit") + 1)})
    free = F.regexp_replace("__left", f"^{ORDINAL}", "").rlike(f"(^|{BEFORE})[“\"']?$") & c("__right").rlike(f"^(?:{BEHIND})")
    df = df.where(free)
    head = F.regexp_extract("__left", f"^(?:.*(?:{CONTRAST}))?(.*)$", 1)
    reach = F.regexp_extract("__right", f"^((?:(?!{CONTRAST}|{COORDINATION}|[,，]).)*)", 1)
    df = df.withColumn("__context", F.concat(head, "__t.hit", reach))
    # a day is one only where it begins the context
    said = [F.regexp_extract("__context", f"^{DAY}", k) for k in (1, 2, 3)]
    df = df.withColumn("__said", F.concat_ws("-", *said)).withColumn("day", F.when(c("__said") != "--", F.try_to_timestamp("__said", F.lit("yyyy-M-d")).cast("date")))
    lies = F.when(c("day").isNull() | c("__record").isNull() | (c("day") > c("__record")), "UNKNOWN").when(c("day") < c("__record"), "HISTORICAL").otherwise("CURRENT_PRIMARY")
    df = df.withColumns({"time": F.when(c("__said") != "--", lies), "__local": F.regexp_replace("__context", f"^{DAY}", "")})
    local, begun = c("__local"), lambda x: c("__local").rlike(f"^(?:{x})")
    rest = lambda x: F.regexp_replace("__local", f"^(?:{x})", "")
    own = (
        F.when(begun(MARKED), rest(MARKED))
        .when(c("__role") == "CHIEF_COMPLAINT", local)
        .when((c("__role") == "ADMISSION_NARRATIVE") & begun(ADMITTED) & local.rlike("入院"), rest(ADMITTED))
        .when((c("__role") == "AUXILIARY_FINDINGS") & (c("time") != "UNKNOWN") & begun(EXAM), rest(EXAM))
    )
    df = df.withColumn("__own", own)
    proved = c("__own").rlike(f"^(?:{ORDINAL})?(?:{TERMS}|{COORDINATION}|{PLAIN})*(?:{TERMS})(?!.*(?:{TERMS}))")
    stated = F.when(c("__own").rlike(HISTORY), "HISTORICAL").when(F.coalesce(proved, F.lit(False)), F.when(c("time") == "HISTORICAL", "HISTORICAL").otherwise("CURRENT_PRIMARY")).otherwise("UNKNOWN")
    subject = F.when(c("__context").rlike(OTHER_PERSON), "OTHER_PERSON").when(c("__context").rlike(EARLIER), "HISTORICAL").when(c("__context").rlike(SPREAD), "METASTATIC_SITE").when(c("time") == "UNKNOWN", "UNKNOWN").otherwise(stated)
    start = c("__c.start") + c("__t.start")
    return df.select(*kept, c("__t.hit").alias("term"), start.alias("start"), (start + F.length("__t.hit")).alias("end"), c("__c.start").alias("clause_start"), (c("__c.start") + F.length("__c.hit")).alias("clause_end"), "day", "time", subject.alias("subject"))
