"""Report workspace: units that are one report, with a token that changes when anything it stands on does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import complete_link, settled

JOINED = "JOINED"


def sums_of(text: Column) -> list[Column]:
    """Aggregates whose sums tell a multiset of texts from others, whatever the order: the eight words of each text's sha256."""
    return [F.coalesce(F.sum(F.conv(F.substring(F.sha2(text, 256), 8 * k + 1, 8), 16, 10).cast("long")), F.lit(0)) for k in range(8)]


def token_of(*sums: Column) -> Column:
    return F.sha2(F.concat_ws(",", *[s.cast("string") for s in sums]), 256)


def report_workspace(units: DataFrame, relations: DataFrame, rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """A row for each report: what ``reports`` says of it, and whether it is confirmed (see ``with_confirmation``)."""
    return with_confirmation(reports(units, relations, rows), confirmed)


def reports(units: DataFrame, relations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each report: scope, report (its smallest unit), n_units, n_rows, relation_conflict, n_problems, token.

    units: scope, unit, state; relations: scope, left, right, state; rows: unit, row, state, problem.
    Units are one report if each two of them are joined (see ``complete_link``).
    The token depends on the ids and states of the units, their rows and the relations that touch them, never on
    their order.  Nothing of a report is gathered
    in one place: tokens are made of sums.  Units without a scope or an id take no part.
    """
    c = F.col
    of = complete_link(relations.where(c("state") == JOINED), units.select("scope", c("unit").alias("node")), "scope").select("scope", c("node").alias("unit"), c("cluster").alias("report"))
    of = settled(of)
    said = lambda *xs: F.concat_ws("/", *[F.coalesce(c(x).cast("string"), F.lit("")) for x in xs])
    named = lambda sums, letter: [s.alias(f"{letter}{k}") for k, s in enumerate(sums)]
    own = units.join(of, ["scope", "unit"]).groupBy("scope", "report").agg(F.count(F.lit(1)).alias("n_units"), *named(sums_of(said("unit", "state")), "u"))
    lines = rows.join(of.select("unit", "scope", "report"), "unit").groupBy("scope", "report").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("problem").alias("n_problems"), *named(sums_of(said("unit", "row", "state")), "r"))
    ends = relations.select("scope", "left", "right", "state", F.explode(F.array_distinct(F.array("left", "right"))).alias("unit")).join(of, ["scope", "unit"])
    touch = ends.select("scope", "report", "left", "right", "state").distinct().groupBy("scope", "report").agg(F.bool_or(c("state") == "CONFLICT").alias("relation_conflict"), *named(sums_of(said("left", "right", "state")), "t"))
    found = own.join(lines, ["scope", "report"], "left").join(touch, ["scope", "report"], "left")
    sums = [F.coalesce(c(f"{letter}{k}"), F.lit(0)) for letter in "urt" for k in range(8)]
    return found.select("scope", "report", "n_units", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("relation_conflict", F.lit(False)).alias("relation_conflict"), F.coalesce("n_problems", F.lit(0)).alias("n_problems"), token_of(*sums).alias("token"))


def with_confirmation(found: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``reports`` with confirmed: whether a report's last confirmation was of its token.  confirmed: report, token, at."""
    c = F.col
    last = confirmed.groupBy("report").agg(F.max_by("token", F.struct("at", "token")).alias("__token"))
    return found.join(last, "report", "left").withColumn("confirmed", F.coalesce(c("token") == c("__token"), F.lit(False))).drop("__token")


def tokens_differ(before: DataFrame, after: DataFrame) -> DataFrame:
    """(scope, report, change) of the reports that are new, gone or changed between two workspaces."""
    keys = ["scope", "report"]
    b, a = before.select(*keys, F.col("token").alias("was")), after.select(*keys, F.col("token").alias("now"))
    both = b.join(a, keys, "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")
