"""String functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC normalisation; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def folded(text: Column) -> Column:
    """NFKC only where a text isn't ASCII, so that most rows stay in the JVM's own code."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(nfkc(text))


def contains_ci(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def csv_guard(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def excerpt(text: Column, part: str, width: int = 140) -> Column:
    """``width`` characters around the first place of ``part``, with an ellipsis where text is left out; null if it isn't there."""
    at = F.instr(F.lower(text), F.lit(part.lower()))
    start = F.greatest(F.lit(1), at - (width - len(part)) // 2)
    return F.when(
        at > 0,
        F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, F.lit(width)), F.when(start + width - 1 < F.length(text), "…").otherwise("")),
    )


def alias_key(text: Column) -> Column:
    """Lower case, without control characters, stars and white space."""
    return F.lower(F.regexp_replace(text, r"[\p{Cntrl}*\s]+", ""))


def unit_key(unit: Column) -> Column:
    """Units in one spelling: superscripts, micro signs and spaces."""
    return F.lower(F.regexp_replace(F.translate(unit, "²³⁹⁶μµ×", "2396uux"), r"\s+", ""))


def first_match(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first rule whose pattern is in the text."""
    out = F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return F.when(text.isNull(), other).otherwise(out)


def heading_title(html: Column, most: int = 3, suffix: str = " and more") -> Column:
    """The first ``most`` distinct texts of the h1 to h3 headings, with a suffix if there are more; null without one."""
    names = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"<h[1-3][^>]*>([^<]*)</h[1-3]>"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, suffix).otherwise("")))


def sanitized_name(name: Column, limit: int = 80) -> Column:
    """A file name of letters, digits, dots and dashes."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", "file").otherwise(F.left(clean, F.lit(limit)))


def trimmed_number(value: Column) -> Column:
    """A number without an exponent or needless zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), r"0+$", ""), r"\.$", "")


def parse_reference(text: Column) -> Column:
    """struct(low, high, comparator) of a printed reference range; nulls if it isn't one."""
    clean = F.regexp_replace(F.translate(text, "～〜—–≤≥", "~~--≤≥"), r"\s+", "")
    clean = F.regexp_replace(F.regexp_replace(clean, "≤", "<="), "≥", ">=")
    span = r"^(\d+(?:\.\d+)?)(?:-+|~)(\d+(?:\.\d+)?)$"
    one = r"^(<=|>=|<|>)(\d+(?:\.\d+)?)$"
    number = lambda pattern, k: F.regexp_extract(clean, pattern, k).try_cast("double")
    sign = F.regexp_extract(clean, one, 1)
    return F.struct(
        F.when(clean.rlike(span), number(span, 1)).when(sign.startswith(">"), number(one, 2)).alias("low"),
        F.when(clean.rlike(span), number(span, 2)).when(sign.startswith("<"), number(one, 2)).alias("high"),
        F.when(sign != "", sign).alias("comparator"),
    )


def compare_to_reference(value: Column, low: Column, high: Column, comparator: Column | None = None) -> Column:
    """below, above, within, or unavailable without a value or a bound; a strict comparator's bound is itself outside."""
    strict = F.coalesce(comparator.isin("<", ">"), F.lit(False)) if comparator is not None else F.lit(False)
    under = low.isNotNull() & ((value < low) | (strict & (value == low)))
    over = high.isNotNull() & ((value > high) | (strict & (value == high)))
    return F.when(value.isNull() | (low.isNull() & high.isNull()), "unavailable").when(under, "below").when(over, "above").otherwise("within")


# Report flags and what they say.
FLAGS = {
    "above": ("H", "HIGH", "↑", "偏高", "高"),
    "below": ("L", "LOW", "↓", "偏低", "低"),
    "different": ("A", "*", "异常", "ABNORMAL"),
    "within": ("N", "正常", "NORMAL"),
}


def flag_status(flag: Column) -> Column:
    """What a printed report flag says; null for an empty or unknown one."""
    key = F.upper(F.trim(flag))
    out = F.lit(None).cast("string")
    for status, flags in FLAGS.items():
        out = F.when(key.isin(*flags), status).otherwise(out)
    return out


def abnormal_status(flag: Column, result_type: Column, status: Column, review: Column, blocked: Column) -> Column:
    """A result's abnormal status from its printed flag and its place in the reference (``status``).

    review: the result itself is in question; blocked: an issue forbids a reference.
    A flag that can't be read, or says other than the reference, is for review.
    """
    said = flag_status(flag)
    said = F.when(~result_type.isin("numeric", "comparator") & said.isin("above", "below"), "different").otherwise(said)
    known = status != "unavailable"
    against = said.isNotNull() & known & (said != status) & ~((said == "different") & status.isin("above", "below", "different"))
    unread = (F.trim(flag) != "") & said.isNull()
    return F.when(review, "review").when(blocked, "unavailable").when(unread | against, "review").otherwise(F.coalesce(F.when(known, status), said, F.lit("unavailable")))


def redact_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://[^\s\"'<>]+", "[link]")


def result_type(text: Column) -> Column:
    """numeric, range, ratio, qualitative or text, in this order."""
    return (
        F.when(text.rlike(r"^[<>≤≥]?\s*[+-]?\d+(\.\d+)?$"), "numeric")
        .when(text.rlike(r"^\d+(\.\d+)?\s*[-~]\s*\d+(\.\d+)?$"), "range")
        .when(text.rlike(r"^\d+\s*:\s*\d+$"), "ratio")
        .when(F.lower(text).rlike(r"^(positive|negative|trace|[+-]{1,4})$"), "qualitative")
        .otherwise("text")
    )


def result_tail(text: Column) -> Column:
    """struct(value, unit, reference, flag) of a printed result: its first token, and what stands behind it.

    The tail is read from its right end: a flag if the last token is one, then the tokens that
    together are a reference range (``10 - 20``, ``≤ 60``), and all that is left of them is the unit,
    spaces included (``10^9 / L``).  Numbers that make no range stay with the unit.  Parts that
    aren't there are empty; a null or blank text gives null.
    """
    known = [f for flags in FLAGS.values() for f in flags]
    state = lambda step, unit, reference, whole, flag: F.struct(step.alias("step"), unit.alias("unit"), reference.alias("reference"), whole.alias("whole"), flag.alias("flag"))
    joined = lambda a, b: F.when(b == "", a).otherwise(F.concat_ws(" ", a, b))

    def whole(reference: Column) -> Column:
        # what ``parse_reference`` finds a bound in, by one pattern: a higher-order function shares nothing between its steps
        return F.translate(reference, "～〜—– ", "~~--").rlike(r"^(?:\d+(?:\.\d+)?(?:-+|~)|<=|>=|[<>≤≥])\d+(?:\.\d+)?$")

    def take(s: Column, t: Column) -> Column:
        more = joined(t, s["reference"])
        is_flag = (s["step"] == 0) & F.upper(t).isin(*known)
        # a token goes on with the reference while it has its signs only and the range isn't whole without it; two numbers in a row aren't one
        goes_on = (s["step"] < 2) & t.rlike(r"^[<>=≤≥~～〜—–.\d-]+$") & ~(t.rlike(r"\d$") & s["reference"].rlike(r"^\d")) & (~s["whole"] | whole(more))
        # what stands behind a slash is a part of the unit (``/ L``)
        below = (s["flag"] != "") & (s["reference"] == "") & (s["unit"] == "") & t.endswith("/")
        return (
            F.when(below, state(F.lit(2), F.concat_ws(" ", t, s["flag"]), s["reference"], s["whole"], F.lit("")))
            .when(is_flag, state(F.lit(1), s["unit"], s["reference"], s["whole"], t))
            .when(goes_on, state(F.lit(1), s["unit"], more, whole(more), s["flag"]))
            .otherwise(state(F.lit(2), joined(t, s["unit"]), s["reference"], s["whole"], s["flag"]))
        )

    def parts(tokens: Column) -> Column:
        def finish(s: Column) -> Column:
            unit = F.when(s["whole"] | (s["reference"] == ""), s["unit"]).otherwise(F.trim(F.concat_ws(" ", s["unit"], s["reference"])))
            return F.struct(F.get(tokens, 0).alias("value"), unit.alias("unit"), F.when(s["whole"], s["reference"]).otherwise("").alias("reference"), s["flag"].alias("flag"))

        none = F.lit("")
        return F.when(F.size(tokens) > 0, F.aggregate(F.reverse(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))), state(F.lit(0), none, none, F.lit(False), none), take, finish))

    # a one-element array, so that the tokens are found once and each part is taken from one walk
    return F.transform(F.array(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")), parts)[0]


def placed(text: Column, pattern: str) -> Column:
    """Array of struct(hit, start, before, after) of a pattern's hits: code points, and the texts between it and its neighbours."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s, h):
        start = s["at"] + F.length(F.get(pieces, F.size(s["starts"])))
        return F.struct((start + F.length(h)).alias("at"), F.array_append(s["starts"], start).alias("starts"))

    whole = F.array(F.struct(pieces.alias("pieces"), hits.alias("hits"), F.aggregate(hits, none, step)["starts"].alias("starts")))
    # a one-element array, so that each part is found once
    return F.transform(whole, lambda w: F.transform(w["hits"], lambda h, i: F.struct(h.alias("hit"), F.get(w["starts"], i).alias("start"), F.get(w["pieces"], i).alias("before"), F.get(w["pieces"], i + 1).alias("after"))))[0]
