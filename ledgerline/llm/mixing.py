"""Mixing sources to target weights by Sainte-Laguë apportionment.

A corpus of T words is cut into equal-token blocks.  Sources get blocks by highest
quotients target / (2k + 1), the shards of a source share its blocks in the same
way, and each shard takes its quota as full passes over its seeded order plus one
seeded run of blocks.  Everything is window functions and joins over small
statistics; the texts are read once, to count their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

#: A word, as the sizes count it.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources in order of their names, repeated as often as needed.
    weights: tuple[int, ...] = (5, 2, 1)
    #: A source gives at most so many times its size.
    most_passes: int = 3
    #: Words in a block.
    block: int = 32
    #: Rows of a shard, about; a source has at most ``most_shards``.
    shard_rows: int = 1000
    most_shards: int = 4096
    seed: str = "mix"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, tag (a hash of the text) and size (words of the text, 0 for null) of each row."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("tag"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``sources`` (source, source_size, n_docs) with number, weight and target.

    Targets are weight times a common level, stopped at ``most_passes`` sizes; the
    level is where they add up to all sizes: the largest of the levels that arise
    when sources are stopped in order of size over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    return (
        sources.withColumn("number", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, p.weights)), ((F.col("number") - 1) % len(p.weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * p.most_passes)
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.col("left_size") / F.col("left_weight")).over(everything))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .drop("cap", "left_size", "left_weight", "level")
    )


def sainte_lague(parties: DataFrame, house: Column, votes: str, key: str, within: list[str], out: str) -> DataFrame:
    """``parties`` with ``out``: the seats that the highest quotients votes / (2k + 1) give each party of its house.

    Rounding votes over the natural divisor is the highest-quotient result of a
    house that differs by at most half its parties; the difference is made up by
    the next quotients, or taken back from the last ones.  Ties go to the smaller
    ``key``.  A house without votes gives no seats.
    """
    house_of = Window.partitionBy(*within, F.lit(1)) if within else Window.partitionBy(F.lit(1))
    base = (
        parties.withColumn("__house", house.cast("long"))
        .withColumn("__all", F.sum(votes).over(house_of).cast("double"))
        .withColumn("__share", F.when(F.col("__all") > 0, F.col(votes) / F.col("__all")).otherwise(0.0))
        .withColumn("__seats", F.floor(F.col("__share") * F.col("__house") + 0.5))
        .withColumn("__short", F.when(F.col("__all") > 0, F.col("__house") - F.sum("__seats").over(house_of)).otherwise(0))
    )
    reach = F.ceil(F.col("__share") * (F.abs("__short") + F.count(F.lit(1)).over(house_of))).cast("long") + 1
    base = base.withColumn("__reach", reach)
    steps = F.when(F.col("__short") > 0, F.sequence(F.col("__seats"), F.col("__seats") + F.least("__reach", "__short") - 1)).when(
        (F.col("__short") < 0) & (F.col("__seats") > 0), F.sequence(F.greatest(F.lit(0), F.col("__seats") - F.least("__reach", -F.col("__short"))), F.col("__seats") - 1)
    )
    offers = base.where(F.col(votes) > 0).select(*within, key, votes, "__short", F.explode(steps).alias("__k")).withColumn("__quotient", F.col(votes) / (2 * F.col("__k") + 1))
    up = F.col("__short") > 0
    order = Window.partitionBy(*within, F.lit(1)).orderBy(F.when(up, -F.col("__quotient")).otherwise(F.col("__quotient")), F.when(up, F.col(key)).otherwise(-F.col(key)), "__k")
    change = (
        offers.withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") <= F.abs("__short"))
        .groupBy(*within, key)
        .agg(F.sum(F.signum("__short")).cast("long").alias("__change"))
    )
    return base.join(change, [*within, key], "left").withColumn(out, F.col("__seats") + F.coalesce("__change", F.lit(0))).drop("__house", "__all", "__share", "__seats", "__short", "__reach", "__change")


def _order(p: MixParams, doc_id: Column) -> Column:
    """The place of a row in its shard's line: md5 of the seed and the id."""
    return F.md5(F.concat(F.lit(p.seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _shard(order: Column, shards: Column) -> Column:
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("long") % shards


def _laid(docs: DataFrame, p: MixParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows on their shards' lines, sources with their blocks and shards, the stored sizes).

    A row lies from ``lo`` to ``hi`` words on its line; the shard's run is from a to b,
    and what passes the line's end n goes on at its start.
    """
    rows = stored(sizes(docs).withColumn("order", _order(p, F.col("doc_id"))), "sizes")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), p)
    blocks = F.ceil(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / p.block)
    quota = sainte_lague(per_source.withColumn("__blocks", blocks), F.col("__blocks"), "target", "number", [], "blocks").drop("__blocks")
    quota = stored(quota.withColumn("shards", F.least(F.ceil(F.col("n_docs") / p.shard_rows), F.lit(p.most_shards)).cast("long")), "quota")
    placed = rows.join(quota.select(F.col("source").alias("name"), "number", "source_size", "target", "shards"), F.col("source").eqNullSafe(F.col("name"))).withColumn("shard", _shard(F.col("order"), F.col("shards")))
    shards = placed.groupBy("number", "shard").agg(F.sum("size").alias("shard_size")).join(quota.select("number", "blocks"), "number")
    shards = sainte_lague(shards, F.col("blocks"), "shard_size", "shard", ["number"], "quota").select("number", "shard", "shard_size", "quota")
    line = Window.partitionBy("number", "shard").orderBy("order", "size", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.greatest(F.ceil(F.col("shard_size") / p.block), F.lit(1))
    start = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(p.seed), F.col("number"), F.col("shard")).cast("binary")), 1, 8), 16, 10).cast("long") % whole
    chosen = (
        shards.withColumn("whole", whole)
        .withColumn("quota", F.when(F.col("shard_size") > 0, F.least("quota", F.col("whole") * p.most_passes)).otherwise(0))
        .withColumn("passes", F.floor(F.col("quota") / F.col("whole")))
        .withColumn("run", F.col("quota") % F.col("whole"))
        .withColumn("run_from", start)
        .select("number", "shard", "passes", (F.col("run_from") * p.block).alias("a"), ((F.col("run_from") + F.col("run")) * p.block).alias("b"), (F.col("whole") * p.block).alias("n"))
    )
    laid = placed.withColumn("hi", F.sum("size").over(line)).withColumn("lo", F.col("hi") - F.col("size")).join(chosen, ["number", "shard"])
    # the run may pass the end of the line and go on at its start
    low1, high1 = F.greatest("lo", "a"), F.least("hi", F.least("b", "n"))
    high2 = F.least(F.col("hi"), F.col("b") - F.col("n"))
    piece = lambda low, high: F.when(high > low, F.struct((low - F.col("lo")).alias("from"), (high - low).alias("words")))
    pieces = F.filter(F.array(piece(F.col("lo"), high2), piece(low1, high1)), lambda x: x.isNotNull())
    return laid.withColumn("pieces", pieces), quota, rows


def apportion(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, source_size, target, passes, pieces (from, words) and taken of each row of ``docs``.

    A row gives ``passes`` whole copies and the word spans of ``pieces``.  Null
    texts have size 0 and give nothing; a null source is a source of its own, the
    last.  Repeated rows are rows of their own.  Reruns agree: order and runs come
    from md5 of the seed and the id.
    """
    laid, _, _ = _laid(docs, p)
    taken = F.col("passes") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return laid.withColumn("taken", taken).select("doc_id", "source", "tag", "size", "source_size", "target", "passes", "pieces", "taken")


def shard_rules(docs: DataFrame, p: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """(sources, rules): what tells, of any row of ``docs`` by itself, what the mix takes of it.

    A shard's run covers its line from one row to another, so a rule needs the keys
    (order, size, tag) of the first and last rows that are covered whole, before and
    after the line's end, and the few rows that are covered in part.  Rows that are
    the same in id and text can't be told apart: where a run ends among them they are
    one exception, with what all of them give.
    """
    laid, quota, sizes_ = _laid(docs, p)
    key = F.struct("order", "size", "tag")
    whole = F.transform("pieces", lambda x: x["words"] == F.col("size"))
    state = F.when(F.size("pieces") == 0, 0).when(F.exists(whole, lambda x: x), F.when(F.col("lo") >= F.col("a"), 1).otherwise(2)).otherwise(3)
    peers = Window.partitionBy("number", "shard").orderBy("order", "size", "tag").rangeBetween(Window.currentRow, Window.currentRow)
    rows = laid.where("size > 0").withColumn("state", state)
    rows = rows.withColumn("odd", (F.col("state") == 3) | (F.min("state").over(peers) != F.max("state").over(peers)))
    rows = rows.select("number", "shard", "passes", "state", "odd", key.alias("key"), "pieces")
    plain = lambda k: F.when(~F.col("odd") & (F.col("state") == k), F.col("key"))
    ranges = rows.groupBy("number", "shard").agg(F.first("passes").cast("int").alias("passes"), *(f(plain(k)).alias(f"{name}{k}") for k in (1, 2) for f, name in ((F.min, "low"), (F.max, "high"))))
    odd = rows.where("odd").groupBy("number", "shard", "key").agg(F.count(F.lit(1)).cast("int").alias("same"), F.count_if(F.col("state").isin(1, 2)).cast("int").alias("copies"), F.flatten(F.collect_list(F.when(F.col("state") == 3, F.col("pieces")))).alias("parts"))
    odd = odd.groupBy("number", "shard").agg(F.collect_list(F.struct("key.order", "key.tag", "same", "copies", "parts")).alias("odd"))  # four at most
    rules = stored(ranges.join(odd, ["number", "shard"], "left"), "rules")
    discard(sizes_)
    return quota, rules


def realise(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mix itself: the rows of ``docs``, repeated as often as they are taken whole, and rows with the pieces taken.

    Columns are those of ``docs``; a piece has its own words, one space apart, and
    its own n_chars if there is such a column.  Texts stay where they are: each row
    finds its source and shard by hash and decides by the shard's rule, a table of
    one row for about ``shard_rows`` documents, sent as its size allows.
    """
    quota, rules = shard_rules(docs.select("doc_id", "source", "text"), p)
    c = F.col
    named = quota.select(c("source").alias("__name"), c("number").alias("__number"), c("shards").alias("__shards"))
    ruled = rules.select(c("number").alias("__number"), c("shard").alias("__shard"), *(c(x).alias(f"__{x}") for x in rules.columns if x not in ("number", "shard")))
    rows = docs.where(c("text").rlike(WORD)).withColumn("__order", _order(p, c("doc_id"))).withColumn("__tag", F.xxhash64("text"))
    rows = rows.join(named, c("source").eqNullSafe(c("__name"))).withColumn("__shard", _shard(c("__order"), c("__shards"))).join(ruled, ["__number", "__shard"])
    # sizes are counted at the ends of a run only
    key = F.struct(c("__order").alias("order"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), c("__tag").alias("tag"))

    def inside(k: int) -> Column:
        low, high = c(f"__low{k}"), c(f"__high{k}")
        between = (c("__order") >= low["order"]) & (c("__order") <= high["order"])
        end = (c("__order") == low["order"]) | (c("__order") == high["order"])
        return F.when(~between | low.isNull(), F.lit(False)).when(end, key.between(low, high)).otherwise(F.lit(True))

    rows = rows.withColumn("__own", F.get(F.filter("__odd", lambda x: (x["order"] == c("__order")) & (x["tag"] == c("__tag"))), F.lit(0)))
    many = rules.where(F.exists("odd", lambda x: x["same"] > 1))
    if not many.isEmpty():
        one = F.coalesce(c("__own.same") > 1, F.lit(False))
        rows = rows.where(~one).unionByName(rows.where(one).dropDuplicates(["__order", "__tag"]))
    copies = F.when(c("__own").isNotNull(), c("__passes") * c("__own.same") + c("__own.copies")).otherwise(c("__passes") + (inside(1) | inside(2)).cast("int"))
    span = "struct<from:bigint,words:bigint>"
    complete = F.array_repeat(F.struct(F.lit(0).cast("long").alias("from"), F.lit(-1).cast("long").alias("words")), copies)
    parts = F.coalesce(c("__own.parts"), F.array().cast(f"array<{span}>"))
    taken = rows.select(*docs.columns, F.explode(F.concat(complete, parts)).alias("__piece"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (c("__piece.from") + 1).cast("int"), c("__piece.words").cast("int"))
    out = taken.withColumn("text", F.when(c("__piece.words") < 0, c("text")).otherwise(F.array_join(words, " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(c("__piece.words") < 0, c("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)
