"""Links in texts: where they stand, whether they may be opened, and the site that they lead to.  No host is ever asked."""

from __future__ import annotations

import ipaddress
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import placed

#: A link in running text; CJK punctuation ends it.
LINK = r"(?iU)https?://[^\s<>\"'。，；！？、]+"

# The networks that the address registries keep from public use, and what they except from these.
CLOSED_4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
OPEN_4 = ["192.0.0.9/32", "192.0.0.10/32"]
CLOSED_6 = ["::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"]
OPEN_6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
#: Last labels of names inside a house or firm.
INNER = ["local", "localhost", "internal", "home", "lan"]

_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _within(digits: Column, networks: list[str]) -> Column:
    """Whether an address in hexadecimal digits is in any of the networks: digits of one length sort as their numbers do."""
    ends = [(f"{int(n[0]):0{n.max_prefixlen // 4}x}", f"{int(n[-1]):0{n.max_prefixlen // 4}x}") for n in map(ipaddress.ip_network, networks)]
    return reduce(lambda a, b: a | b, [digits.between(low, high) for low, high in ends])


def address_4(host: Column) -> Column:
    """Eight hexadecimal digits of a dotted address, null if it is none."""
    part = lambda k: F.lpad(F.lower(F.hex(F.regexp_extract(host, rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$", k).try_cast("int"))), 2, "0")
    return F.when(host.rlike(rf"^{_BYTE}(\.{_BYTE}){{3}}$"), F.concat(*map(part, range(1, 5))))


def address_6(df: DataFrame, host: str, out: str) -> DataFrame:
    """Adds 32 hexadecimal digits of a version 6 address in any of its spellings, null if it is none; in steps, each found once."""
    tail = F.regexp_extract(F.lower(host), r":([\d.]*\.[\d.]*)$", 1)
    df = df.withColumn("__tail", tail).withColumn("__four", address_4(F.col("__tail")))
    head = F.substr(F.lower(host), F.lit(1), F.length(host) - F.length("__tail"))
    plain = F.when(F.col("__tail") == "", F.lower(host)).otherwise(F.concat(head, F.left("__four", F.lit(4)), F.lit(":"), F.right("__four", F.lit(4))))
    groups = lambda i: F.when(F.coalesce(F.get("__halves", F.lit(i)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get("__halves", F.lit(i)), ":", -1))
    df = df.withColumn("__halves", F.split(plain, "::", -1)).withColumns({"__first": groups(0), "__last": groups(1)})
    df = df.withColumn("__missing", 8 - F.size("__first") - F.size("__last"))
    df = df.withColumn("__parts", F.concat("__first", F.array_repeat(F.lit("0"), F.greatest("__missing", F.lit(0))), "__last"))
    whole = ((F.size("__halves") == 1) & (F.col("__missing") == 0)) | ((F.size("__halves") == 2) & (F.col("__missing") >= 1))
    good = whole & F.forall("__parts", lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    return df.withColumn(out, F.when(good, F.array_join(F.transform("__parts", lambda x: F.lpad(x, 4, "0")), ""))).drop("__tail", "__four", "__halves", "__first", "__last", "__missing", "__parts")


_MAPPED = "00000000000000000000ffff"


def public(df: DataFrame, digits: str, out: str) -> DataFrame:
    """Adds whether an address (8 or 32 digits) is of public use; version 4 inside version 6 is judged as what it is."""
    c = F.col(digits)
    four, six = F.col("__four"), c
    df = df.withColumn("__four", F.when(F.length(c) == 8, c).when(c.startswith(_MAPPED), F.right(c, F.lit(8))))
    return df.withColumn(out, F.when(four.isNotNull(), ~_within(four, CLOSED_4) | _within(four, OPEN_4)).otherwise(~_within(six, CLOSED_6) | _within(six, OPEN_6))).drop("__four")


def shown_6(df: DataFrame, digits: str, out: str) -> DataFrame:
    """Adds the short spelling of 32 digits: no leading zeros, the longest run of zero groups (the first of equals) left out."""
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(F.col(digits), i * 4 + 1, F.lit(4)), "^0+(?=.)", "")), ":")
    df, short = df.withColumn("__groups", groups), F.col("__groups")
    for n in range(2, 9):
        run = rf"^((?:[0-9a-f]+:)*?)0(?::0){{{n - 1}}}((?::[0-9a-f]+)*)$"
        short = F.when(F.col("__groups").rlike(run), F.concat(F.regexp_replace(F.regexp_extract("__groups", run, 1), ":$", ""), F.lit("::"), F.regexp_replace(F.regexp_extract("__groups", run, 2), "^:", ""))).otherwise(short)
    dotted = F.array_join(F.transform(F.sequence(F.lit(12), F.lit(15)), lambda i: F.conv(F.substring(F.col(digits), i * 2 + 1, F.lit(2)), 16, 10)), ".")
    return df.withColumn(out, F.when(F.col(digits).startswith(_MAPPED), F.concat(F.lit("::ffff:"), dotted)).otherwise(short)).drop("__groups")


@F.pandas_udf(T.StringType())
def _ascii_name(host: pd.Series) -> pd.Series:
    """A name in the letters that are sent: folded, each label in Punycode; sharp s and final sigma stay what they are. Null if a label can't be one."""

    def label(x):
        if x.isascii():
            return x
        if unicodedata.category(x[0])[0] == "M" or not all(c == "-" or unicodedata.category(c)[0] in "LMN" for c in x):
            return None
        return "xn--" + x.encode("punycode").decode()

    def one(h):
        if h is None:
            return None
        folded = unicodedata.normalize("NFKC", "".join(c.lower() for c in unicodedata.normalize("NFKC", h)))
        labels = [label(x) for x in folded.replace("。", ".").split(".")]
        return None if None in labels else ".".join(labels)

    return host.map(one, na_action="ignore")


def with_site(df: DataFrame, url: str) -> DataFrame:
    """Adds state and site: ok and the host (and port, if it isn't the scheme's own), or why the link isn't to be opened and null.

    unreadable: null, empty, over 8,192 signs, spaces, controls, backslashes, broken percent codes, or no authority that can be read;
    scheme: not http or https; credentials; port: zero or beyond 65,535; private: an address out of public use; host: no name of two labels
    or more, a number that is no address, or a name of an inner network.  Names are in their sent form (only those with other than ASCII
    letters meet Python); labels already in Punycode aren't decoded again, and rules on the direction of writing aren't tried.
    """
    c, shape = F.col, r"^(?:\[([^\[\]]*)\]|([^:\[\]]+))(?::(\d+))?$"
    df = df.withColumns({"__scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)), "__authority": F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)})
    df = df.withColumns({f"__{part}": F.regexp_extract("__authority", shape, k) for k, part in enumerate(("inner", "name", "port"), 1)})
    ascii_only = c("__name").rlike(r"^\p{ASCII}*$")
    sent = F.when(ascii_only, F.lower("__name")).otherwise(_ascii_name(F.when(~ascii_only, c("__name"))))
    df = df.withColumns({"__four_name": address_4(c("__name")), "__host": F.regexp_replace(sent, r"\.$", ""), "__number": c("__port").try_cast("int")})
    df = address_6(df, "__inner", "__six").withColumn("__digits", F.coalesce("__four_name", F.when(c("__inner") != "", c("__six"))))
    df = shown_6(public(df, "__digits", "__public"), "__six", "__shown")
    bad = c(url).rlike(r"[\\\p{Cc}\p{Cf}\p{Z}]|%(?![0-9A-Fa-f]{2})") | (F.length(url) > 8192) | (c("__scheme") == "")
    host, number = c("__host"), c("__number")
    good = (F.length(host) <= 253) & host.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$")
    good = good & ~host.rlike(r"^(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+))*$") & ~host.rlike(r"(^|\.)(?!xn)..--") & ~F.substring_index(host, ".", -1).isin(*INNER)
    state = (
        F.when(c(url).isNull() | bad, "unreadable")
        .when(~c("__scheme").isin("http", "https"), "scheme")
        .when(c("__authority").contains("@"), "credentials")
        .when(~c("__authority").rlike(shape), "unreadable")
        .when((c("__port") != "") & (number.isNull() | ~number.between(1, 65535)), "port")
        .when(c("__digits").isNotNull(), F.when(c("__public"), "ok").otherwise("private"))
        .when(F.coalesce(good, F.lit(False)), "ok")
        .otherwise("host")
    )
    shown = F.when(c("__four_name").isNotNull(), c("__name")).when(c("__inner") != "", F.concat(F.lit("["), "__shown", F.lit("]"))).otherwise(host)
    own = (c("__port") == "") | (number == F.when(c("__scheme") == "https", 443).otherwise(80))
    df = df.withColumn("state", state)
    return df.withColumn("site", F.when(c("state") == "ok", F.concat(shown, F.when(own, "").otherwise(F.concat(F.lit(":"), number))))).drop(*(x for x in df.columns if x.startswith("__")))


def payloads(df: DataFrame, text: str, most: int = 16384) -> DataFrame:
    """A row for each link in a text, with the other columns of its row: payload, digest, length, start, end, kind, reason, site.

    Offsets are code points, end exclusive.  A parenthesis around a link isn't part of it.  A link of over ``most`` signs is told by
    digest and length only, so that no cut link passes for a whole one; one that may go on behind a line break isn't judged.
    kind is URL or UNSUPPORTED.  Null texts and texts without links give no rows.
    """
    kept = [c for c in df.columns if c != text]
    found = df.select(*kept, F.explode(placed(F.col(text), LINK)).alias("l")).select(*kept, "l.hit", "l.start", F.right("l.before", F.lit(1)).alias("before"), F.left(F.regexp_replace("l.after", r"^[\r\n]+", "\n"), F.lit(2)).alias("after"))
    count = lambda x: F.length("hit") - F.length(F.replace(F.col("hit"), F.lit(x), F.lit("")))
    wrapped = F.col("hit").endswith(")") & (F.col("before") == "(") & (count("(") + 1 == count(")"))
    cut = F.col("hit").rlike(r"[=/?&%\-]$") & F.col("after").startswith("\n") | F.col("after").rlike(r"^\n[/?&=%]")
    found = found.withColumns({"cut": ~wrapped & cut, "hit": F.when(wrapped, F.left("hit", F.length("hit") - 1)).otherwise(F.col("hit"))}).withColumn("length", F.length("hit"))
    whole = F.col("length") <= most
    found = with_site(found.withColumn("payload", F.when(whole, F.col("hit"))), "payload")
    reason = F.when(F.col("cut"), "ambiguous_line_break").when(~whole, "payload_too_long").when(F.col("state") != "ok", F.concat(F.lit("link_"), "state")).otherwise("")
    return found.withColumn("reason", reason).select(
        *kept,
        "payload",
        F.sha2("hit", 256).alias("digest"),
        "length",
        F.when(whole, F.col("start")).alias("start"),
        F.when(whole, F.col("start") + F.col("length")).alias("end"),
        F.when(F.col("reason") == "", "URL").otherwise("UNSUPPORTED").alias("kind"),
        "reason",
        F.when(F.col("reason") == "", F.col("site")).alias("site"),
    )
