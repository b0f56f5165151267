"""Contexts of entities in a typed graph: what a record depends on, over several parents and a bounded depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators.joins import settled

#: How far a context may reach, and over how many records.
MOST_DEPTH, MOST_NODES = 8, 32


def _walks(steps: DataFrame, length: int, most_nodes: int) -> DataFrame:
    """(node, front, reach, many) of each node with a step (at, next): what walks of ``length`` steps end at, and what walks of up to that many do.

    ``many``: more than ``most_nodes`` are reached; such a node, and what leads to it in fewer steps, holds nothing.
    """
    c = F.col
    none = F.array_except("front", "front")

    def bounded(walks: DataFrame) -> DataFrame:
        many = c("many") | (F.size("reach") > most_nodes)
        return walks.select("node", F.when(many, none).otherwise(c("front")).alias("front"), F.when(many, none).otherwise(c("reach")).alias("reach"), many.alias("many"))

    def longer(first: DataFrame, then: DataFrame) -> DataFrame:
        # all that the ends of the first walks come to, beside what the first ones passed
        ends = first.where("NOT many").select("node", F.explode("front").alias("__end"))
        met = ends.join(then.select(c("node").alias("__end"), "front", "reach", "many"), "__end").select("node", "front", "reach", "many")
        rows = met.union(first.select("node", none.alias("front"), "reach", "many"))
        union = lambda x: F.array_distinct(F.flatten(F.collect_list(x)))
        return bounded(rows.groupBy("node").agg(union("front").alias("front"), union("reach").alias("reach"), F.max("many").alias("many")))

    # a node's steps are counted before they are listed
    counted = steps.withColumn("__n", F.row_number().over(Window.partitionBy("at").orderBy("next"))).where(c("__n") <= most_nodes + 1)
    one = counted.groupBy(c("at").alias("node")).agg(F.collect_list("next").alias("front")).select("node", "front", c("front").alias("reach"), F.lit(False).alias("many"))
    power, out = settled(bounded(one)), None
    while True:
        if length & 1:
            out = power if out is None else longer(power, out)
        length >>= 1
        if not length:
            return out
        power = settled(longer(power, power))


def resolve(nodes: DataFrame, links: DataFrame, most_depth: int = MOST_DEPTH, most_nodes: int = MOST_NODES) -> DataFrame:
    """The context of each of ``nodes``: node, state, reason, n_dependencies, dependencies, context.

    nodes: node, scope, status, source_valid; an id that repeats is one node, with the least of
    each column.  links: node, role, target, entity; a null target is a binding that is unknown.
    A node depends on every node that a path of links leads to; the bindings of all these and its
    own make its context, one entity for each role.  ``state`` is the first that holds of

    * ``INVALID``, with the reason: ``too_many`` (more than ``most_nodes`` dependencies), ``cycle``
      (it leads to a node that leads to itself), ``too_deep`` (a path of more than ``most_depth``
      links), ``bad_link`` (here or below, a target that isn't there, is of another scope or is the node
      itself), ``source`` (the source of a dependency isn't valid), ``conflict`` (one role, two entities)
    * ``EXCLUDED``: a direct target is excluded
    * ``UNLINKED``: a binding of its own is unknown
    * ``UNREVIEWED``: a dependency isn't confirmed, or has an unknown binding
    * ``RESOLVED``

    Of a node with ``too_many``, ``cycle`` or ``too_deep`` the dependencies and the context are empty.
    Links of a null node or role are left out, repeated links count once.

    Walks are doubled in length, so there are about log2(``most_depth``) joins; a node that has more than
    ``most_nodes`` dependencies keeps none, so no more than that times the nodes are held.
    """
    c = F.col
    known = nodes.where("node IS NOT NULL").groupBy("node").agg(*(F.min(x).alias(x) for x in ("scope", "status", "source_valid")))
    own = links.where("node IS NOT NULL AND role IS NOT NULL").select("node", "role", "target", "entity").distinct()
    own = own.join(known.select("node", c("scope").alias("__scope")), "node")
    target = known.select(c("node").alias("target"), c("scope").alias("__its"), c("status").alias("__status"))
    tied = own.join(target, "target", "left")
    good = (c("__its") == c("__scope")) & (c("target") != c("node"))
    tied = settled(tied.select("node", "role", "target", "entity", (c("target").isNotNull() & ~F.coalesce(good, F.lit(False))).alias("bad"), (c("__status") == "EXCLUDED").alias("excluded")))
    # what a node is by itself, for those that depend on it
    flag = lambda x: F.coalesce(F.max(x), F.lit(False))
    direct = tied.groupBy("node").agg(flag("bad").alias("bad"), flag("excluded").alias("excluded"), flag(c("target").isNull()).alias("unknown"), F.collect_set(F.when(c("entity").isNotNull() & c("target").isNotNull() & ~c("bad"), F.struct("role", "entity"))).alias("bound"))
    facts = known.select("node", "status", "source_valid").join(direct, "node", "left").select("node", "status", "source_valid", *(F.coalesce(x, F.lit(False)).alias(x) for x in ("bad", "excluded", "unknown")), F.coalesce("bound", F.array().cast("array<struct<role:string,entity:string>>")).alias("bound"))
    steps = tied.where("target IS NOT NULL AND NOT bad").select(c("node").alias("at"), c("target").alias("next")).distinct()
    walks = settled(_walks(steps, most_depth + 1, most_nodes))

    limits = walks.select(c("node").alias("root"), F.when(c("many"), True).alias("many"), F.when(~c("many") & (F.size("front") > 0), True).alias("deep"))
    ring = walks.where(F.array_contains("reach", c("node"))).select(c("node").alias("at"), F.lit(True).alias("__ring"))
    below = walks.select(c("node").alias("root"), F.explode("reach").alias("at"))
    known_below = facts.select(c("node").alias("at"), *(c(x).alias(f"__{x}") for x in ("status", "source_valid", "bad", "unknown", "bound"))).join(ring, "at", "left")
    met = below.join(known_below, "at").groupBy("root").agg(
        F.array_sort(F.collect_set("at")).alias("dependencies"),
        F.max("__bad").alias("bad_below"),
        F.max(~F.coalesce("__source_valid", F.lit(False))).alias("source_below"),
        F.max((F.coalesce("__status", F.lit("")) != "CONFIRMED") | c("__unknown")).alias("open_below"),
        F.array_distinct(F.flatten(F.collect_set("__bound"))).alias("bound_below"),
        F.max("__ring").alias("ring"),
    )
    every = facts.withColumnRenamed("node", "root").join(limits, "root", "left").join(met, "root", "left")
    stopped = F.coalesce("many", "ring", "deep", F.lit(False))
    bound = F.array_sort(F.array_union("bound", F.coalesce("bound_below", F.array().cast("array<struct<role:string,entity:string>>"))))
    every = every.withColumn("context", F.when(~stopped, bound).otherwise(F.array_except(bound, bound))).withColumn("dependencies", F.when(~stopped, c("dependencies")))
    torn = F.size(F.array_distinct(F.transform("context", lambda x: x["role"]))) < F.size("context")
    reason = F.when(c("many"), "too_many").when(c("ring"), "cycle").when(c("deep"), "too_deep").when(c("bad") | c("bad_below"), "bad_link").when(c("source_below"), "source").when(torn, "conflict")
    state = F.when(reason.isNotNull(), "INVALID").when(c("excluded"), "EXCLUDED").when(c("unknown"), "UNLINKED").when(c("open_below"), "UNREVIEWED").otherwise("RESOLVED")
    return every.select(c("root").alias("node"), state.alias("state"), reason.alias("reason"), F.coalesce(F.size("dependencies"), F.lit(0)).alias("n_dependencies"), F.coalesce("dependencies", F.array().cast(every.schema["dependencies"].dataType)).alias("dependencies"), "context")


def units(lines: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """``lines`` with ``unit``, the number (from 1) of the report unit that each line of its ``scope`` is in.

    Lines come in the ``order``, which may run over page ends; ``title``, ``head``, ``marker``,
    ``result`` and ``counter`` say what a line is, and null is no.  A unit begins

    * at every title but the first, or at the head line right before it; and further up at a page
      counter before that, and at a head line before the counter that is no title
    * between two neighbouring results of such a stretch, at the first marker there, if a marker
      stands before the first of the two results as well; or at the last head line between that
      result and the marker

    Columns of these names are kept; ties of the order are broken by the signals, so lines that tie
    wholly are alike.  One sort of each scope's lines; lines of a null scope are one scope.
    """
    c = F.col
    signs = ("title", "head", "marker", "result", "counter")
    rows = lines.select(*lines.columns, *(F.coalesce(c(x), F.lit(False)).alias(f"__{x}") for x in signs))
    w = Window.partitionBy(scope).orderBy(*order, *(f"__{x}" for x in signs))
    back = lambda x, k: F.coalesce(F.lag(x, k).over(w), F.lit(False))
    rows = rows.withColumn("__n", F.row_number().over(w)).withColumn("__k", F.sum(c("__title").cast("int")).over(w))
    up = F.when(back("__head", 1), 1).otherwise(0)
    more = F.when(F.when(up == 1, back("__counter", 2)).otherwise(back("__counter", 1)), up + 1).otherwise(up)
    rows = rows.withColumn("__up", up).withColumn("__more", more)
    topmost = F.when(c("__more") == c("__up"), c("__up")).when(F.when(c("__more") == 1, back("__head", 2) & ~back("__title", 2)).otherwise(back("__head", 3) & ~back("__title", 3)), c("__more") + 1).otherwise(c("__more"))
    rows = rows.withColumn("__from", F.when(c("__title") & (c("__k") > 1), c("__n") - topmost))
    first = F.lit(False)
    for k in range(4):
        first = first | F.coalesce((F.lead("__from", k).over(w) if k else c("__from")) == c("__n"), F.lit(False))
    rows = rows.withColumn("__first", first).withColumn("__part", F.sum(F.col("__first").cast("int")).over(w))

    part = Window.partitionBy(scope, "__part").orderBy("__n")
    before, after = part.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(1, Window.unboundedFollowing)
    at = lambda x: F.when(c(x), c("__n"))
    rows = rows.withColumn("__last", F.max(at("__result")).over(before)).withColumn("__next", F.min(at("__result")).over(after)).withColumn("__mark", F.min(at("__marker")).over(before)).withColumn("__top", F.max(at("__head")).over(before))
    cut = c("__marker") & ~c("__result") & c("__next").isNotNull() & (c("__mark") < c("__last"))
    rows = rows.withColumn("__cut", F.when(cut, c("__n"))).withColumn("__begin", F.when(cut, F.when(c("__top") > c("__last"), c("__top")).otherwise(c("__n"))))
    # lines between two results; a result is with the lines after it
    rows = rows.withColumn("__gap", F.when(c("__result"), c("__n")).otherwise(c("__last")))
    gap = Window.partitionBy(scope, "__part", "__gap")
    rows = rows.withColumn("__begin", F.min(F.when(c("__cut").isNotNull(), F.struct("__cut", "__begin"))).over(gap))
    begins = (c("__first") & (c("__n") > 1)) | F.coalesce(c("__begin.__begin") == c("__n"), F.lit(False))
    return rows.withColumn("__b", begins).withColumn("unit", (F.sum(c("__b").cast("int")).over(w) + 1).cast("int")).select(*[x for x in lines.columns if x != "unit"], "unit")
