"""Search over all that an archive says of a document, before and after corrections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import excerpt
from ledgerline.operators.series import latest


def asked_date(query: str) -> tuple[int, int | None, int | None] | None:
    """(year, month, day) of a query that is a date, or a part of one, between 1900 and 2100; else None."""
    clean = re.sub(r"[年月/.]", "-", query.strip()).replace("日", "").rstrip("-")
    found = re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", clean)
    year, month, day = (int(x) if x else None for x in found.groups()) if found else (0, None, None)
    if not 1900 <= year <= 2100 or (month is not None and not 1 <= month <= 12) or (day is not None and not 1 <= day <= 31):
        return None
    return year, month, day


def on_date(date: Column, query: str) -> Column:
    """Whether a date is in the year, month or day that the query names; false if it names none."""
    asked = asked_date(query)
    if asked is None:
        return F.lit(False)
    parts = [part(date) == n for part, n in zip((F.year, F.month, F.dayofmonth), asked, strict=True) if n is not None]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def named_by(code: Column, labels: dict[str, str], query: str, missing: str | None = None) -> Column:
    """The label of the code if it holds the query, else null; a null code is read as ``missing``."""
    code = F.coalesce(code, F.lit(missing).cast("string"))
    return reduce(lambda out, x: F.when(code == x[0], x[1]).otherwise(out), [x for x in labels.items() if query.casefold() in x[1].casefold()], F.lit(None).cast("string"))


def search(
    documents: DataFrame,
    key: str,
    query: str,
    own: dict[str, Column],
    met: dict[str, Column],
    said: dict[str, DataFrame],
    corrections: DataFrame | None = None,
) -> DataFrame:
    """(key, found_in, excerpt, corrected) of each document that holds the query: ``searches`` for one."""
    return searches(documents, key, {query: met}, own, said, corrections).drop("query")


def searches(
    documents: DataFrame,
    key: str,
    met: dict[str, dict[str, Column]],
    own: dict[str, Column],
    said: dict[str, DataFrame],
    corrections: DataFrame | None = None,
) -> DataFrame:
    """(query, key, found_in, excerpt, corrected) of each document that holds a query, letter case and white space aside.

    met: the queries, and of each the name and text of what was judged by the caller (labels, dates), which is null where it wasn't
    met; the names are the same for all.  own: name and text of what stands in the document's own row.  said: name and rows
    (key, text) of what other tables say; gates of confidence are the caller's filters.
    corrections: key, entity, sequence, text; only the last of each entity is read, and the queries are held against it after
    that, so no filter drops a correction before it is resolved: a document counts if the texts as they came or as they were
    corrected hold the query (``corrected``: only a correction does).
    found_in: the first source in the order given (own, met, said, correction); excerpt: of its text that sorts first.
    Every table is read once for all queries; only texts that match are shuffled, and one a document, query and task.
    An empty query holds nothing, nor does a null text; null keys are left out; said rows of no document are left out.
    """
    queries = list(met)
    judgements = list(dict.fromkeys(name for m in met.values() for name in m))
    names = [*own, *judgements, *said, "correction"]
    text_of = lambda t: F.regexp_replace(F.trim(t), r"\s+", " ")
    # a query's number, the text's source and the text
    hit = lambda holds, i, name, text: F.when(holds, F.struct(F.lit(i).alias("query"), F.struct(F.lit(names.index(name)).alias("place"), text.alias("text")).alias("hit")))
    some = [i for i, q in enumerate(queries) if q]

    def hits(df: DataFrame, texts: dict[str, str], more: list[Column], mine: bool) -> DataFrame:
        # texts in one spelling come from a step of their own, so that each is made once for all queries
        df = df.select(key, *(F.col(c) for c in df.columns[1:]), *(F.lower(c).alias(f"{c}_low") for c in texts.values()))
        found = [hit(F.contains(f"{c}_low", F.lit(queries[i].lower())), i, name, F.col(c)) for name, c in texts.items() for i in some] + more
        if mine:  # that the document is there
            found.append(F.struct(F.lit(-1).alias("query"), F.struct(F.lit(0).alias("place"), F.lit(None).cast("string").alias("text")).alias("hit")))
        every = F.array(*found) if found else F.array().cast("array<struct<query:int,hit:struct<place:int,text:string>>>")
        # nulls go after explode: a filter of the array would leave generated code
        return df.select(key, F.explode(every).alias("__x")).where("__x IS NOT NULL").select(key, "__x.query", "__x.hit")

    asked = {(i, name): t for i in some for name, t in met[queries[i]].items()}
    columns = [text_of(t).alias(f"__own{k}") for k, t in enumerate(own.values())] + [t.alias(f"__met{i}_{judgements.index(name)}") for (i, name), t in asked.items()]
    judged = [hit(F.col(c).isNotNull(), i, name, F.col(c)) for i, name in asked for c in [f"__met{i}_{judgements.index(name)}"]]
    rows = hits(documents.where(F.col(key).isNotNull()).select(key, *columns), {name: f"__own{k}" for k, name in enumerate(own)}, judged, True)
    others = list(said.items())
    if corrections is not None:
        others.append(("correction", latest(corrections, [key, "entity"], F.col("sequence").desc_nulls_last(), F.col("text").desc_nulls_last())))
    for name, df in others:
        rows = rows.union(hits(df.where(F.col(key).isNotNull()).select(key, text_of(F.col("text")).alias("__text")), {name: "__text"}, [], False))
    best = rows.groupBy(key).agg(*(F.min(F.when(F.col("query") == i, F.col("hit"))).alias(f"__hit{i}") for i in some), F.bool_or(F.col("query") == -1).alias("__mine")).where("__mine")

    def shown(i: int) -> Column:
        place, text = F.col(f"__hit{i}.place"), F.col(f"__hit{i}.text")
        name = F.element_at(F.array(*map(F.lit, names)), place + 1)
        found = F.struct(F.lit(queries[i]).alias("query"), name.alias("found_in"), F.coalesce(excerpt(text, queries[i]), text).alias("excerpt"), (name == "correction").alias("corrected"))
        return F.when(F.col(f"__hit{i}").isNotNull(), found)

    kind = "array<struct<query:string,found_in:string,excerpt:string,corrected:boolean>>"
    found = F.array(*map(shown, some)) if some else F.array().cast(kind)
    return best.select(key, F.explode(found).alias("__x")).where("__x IS NOT NULL").select("__x.query", key, "__x.found_in", "__x.excerpt", "__x.corrected")
