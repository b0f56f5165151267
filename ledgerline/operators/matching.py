"""Greedy and nearest matches, span containment, stream-like fences over tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators.series import over


def greedy(scores: DataFrame, group: str, least: float) -> DataFrame:
    """(group, left, right, ambiguous): pairs taken by falling score, each side once (bounded groups).

    A pair is ambiguous if one of its sides has another pair of the same score.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["score"] >= least].sort_values(["score", "left", "right"], ascending=[False, True, True])
        ties = pdf.groupby(["left", "score"])["right"].transform("size").gt(1) | pdf.groupby(["right", "score"])["left"].transform("size").gt(1)
        left, right, out = set(), set(), []
        for g, a, b, tie in zip(pdf[group], pdf["left"], pdf["right"], ties, strict=True):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                out.append((g, a, b, bool(tie)))
        return pd.DataFrame(out, columns=[group, "left", "right", "ambiguous"])

    kind = dict(scores.dtypes)
    return scores.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, left {kind['left']}, right {kind['right']}, ambiguous boolean")


def nearest_image(images: DataFrame, radius: int = 8) -> DataFrame:
    """(id, match_id, distance) of each image's nearest other image of its patient within the radius; the newest of equals.

    images: id, patient_id, phash (64 bits), created_at.  Bands of bits block the pairs.
    """
    bands = radius + 1
    width = 64 // bands
    cut = F.posexplode(F.array(*(F.shiftrightunsigned("phash", k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(bands))))
    parts = images.select("id", "patient_id", "phash", "created_at", cut.alias("band", "part"))
    other = parts.select("patient_id", "band", "part", F.col("id").alias("match_id"), F.col("phash").alias("h"), F.col("created_at").alias("at"))
    pairs = parts.join(other, ["patient_id", "band", "part"]).where("id <> match_id").withColumn("distance", F.bit_count(F.col("phash").bitwiseXOR(F.col("h")))).where(F.col("distance") <= radius)
    best = over(["id"], "distance", F.col("at").desc(), F.col("match_id").desc())
    return pairs.select("id", "match_id", "distance", "at").distinct().withColumn("n", F.row_number().over(best)).where("n = 1").select("id", "match_id", "distance")


def spans_within(fragments: DataFrame, texts: DataFrame) -> DataFrame:
    """``fragments`` (fragment_id, text_id, start, end, quote) with whether the text has the quote at its place."""
    joined = fragments.join(texts.select("text_id", "body"), "text_id", "left")
    return joined.withColumn("found", F.coalesce(F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote"), F.lit(False))).drop("body")


def monotone(stages: DataFrame, key: str, order: str, stage: str) -> DataFrame:
    """Rows whose stage is not below any earlier stage of the key."""
    before = F.max(stage).over(over([key], order).rowsBetween(Window.unboundedPreceding, -1))
    return stages.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(stage) >= F.col("__before"))).drop("__before")


def expired(rows: DataFrame, at: str, now, days: int) -> DataFrame:
    """Rows older than so many days, oldest first due."""
    return rows.where(F.col(at) <= now - F.make_interval(days=F.lit(days))).orderBy(at)


def tombstoned(rows: DataFrame, graves: DataFrame, key: str, namespace: str) -> DataFrame:
    """Rows whose keyed hash is not among the graves (target_hash)."""
    target = F.sha2(F.concat(F.lit(namespace + ":"), F.col(key).cast("string")), 256)
    return rows.withColumn("target_hash", target).join(graves.select("target_hash"), "target_hash", "left_anti").drop("target_hash")
