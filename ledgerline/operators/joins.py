"""Join-shaped operators: existence flags, unique lookups, as-of, lineage, overlays, near matches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ledgerline.functions.text import alias_key
from ledgerline.operators.series import latest


def exists_flag(df: DataFrame, other: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Whether the other table has the row's key, as a column."""
    return df.join(other.select(*keys).distinct().withColumn(out, F.lit(True)), keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def first_of(df: DataFrame, other: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """``df`` with columns of the other table's first row for its key, null without one."""
    return df.join(latest(other, keys, *order).select(*keys, *columns), keys, "left")


def with_total(df: DataFrame, other: DataFrame, keys: list[str], aggregate: Column, out: str, default) -> DataFrame:
    """``df`` with an aggregate of the other table's rows for its key; aggregated before the join."""
    return df.join(other.groupBy(*keys).agg(aggregate.alias(out)), keys, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def matched_by_any(df: DataFrame, key: str, sources: list[DataFrame]) -> DataFrame:
    """Rows whose key any of the sources holds: the match sets are united, then joined once."""
    found = reduce(DataFrame.union, [s.select(key) for s in sources]).distinct()
    return df.join(found, key, "left_semi")


def unordered_pairs(df: DataFrame, block: list[str], key: str) -> DataFrame:
    """Pairs (left, right) of different rows that share a block, each once; bounded blocks only."""
    a, b = df.select(*block, F.col(key).alias("left")), df.select(*block, F.col(key).alias("right"))
    return a.join(b, block).where("left < right")


def unique_lookup(df: DataFrame, dimension: DataFrame, keys: list[str], code: str) -> DataFrame:
    """The dimension's code for the row's key if there is exactly one, else null."""
    one = dimension.groupBy(*keys).agg(F.countDistinct(code).alias("__n"), F.min(code).alias(code)).where("__n = 1").drop("__n")
    return df.join(one, keys, "left")


def only_rule(rules: list[tuple[str, Column]]) -> Column:
    """The code of the only rule whose condition holds for the row, else null.  The rules are in the plan: no row moves."""
    hits = F.array_distinct(F.filter(F.array(*(F.when(holds, F.lit(code)) for code, holds in rules)), lambda x: x.isNotNull()))
    return F.when(F.size(hits) == 1, hits[0])


# Printed specimens and panels, and what they mean in a dictionary.
SPECIMENS = {"尿液": "URINE", "尿": "URINE", "粪便": "STOOL", "大便": "STOOL", "血液": "BLOOD", "血清": "BLOOD", "血浆": "BLOOD"}
PANELS = {"CBC": "血常规", "HEMATOLOGY": "血常规", "血常规（急诊）": "血常规", "INFLAMMATION": "炎症三项"}
PANEL_SPECIMENS = [("尿|^URINALYSIS$", "URINE"), ("大便|粪便|^STOOL$", "STOOL")]


def dictionary_lookup(df: DataFrame, dictionary: DataFrame, name: Column, specimen: Column, panel: Column) -> DataFrame:
    """Rows with the only code that their printed name can mean, else null.

    dictionary: alias, code, specimen, category; names and aliases are compared without case, stars and white space.  A known
    specimen leaves the entries of that specimen; if more than one is left, the panel does: by the specimen that it tells, else by
    its category.  A null, empty, UNSPECIFIED or UNKNOWN specimen and a null or empty panel leave all.  Entries that repeat count once.
    What an alias's entries come to is reckoned once for each specimen and panel that may be said, as counts; the joined
    side has one row for each, so rows don't multiply and none holds a list of entries.
    """
    entries = dictionary.where("code IS NOT NULL").select(alias_key(F.col("alias")).alias("__alias"), "code", "specimen", "category").distinct()
    said = reduce(lambda out, x: F.when(specimen == x[0], x[1]).otherwise(out), SPECIMENS.items(), specimen)
    group = reduce(lambda out, x: F.when(panel == x[0], x[1]).otherwise(out), PANELS.items(), panel)
    told = reduce(lambda out, x: F.when(F.col("__panel").rlike(x[0]), x[1]).otherwise(out), reversed(PANEL_SPECIMENS), F.lit(None).cast("string"))
    df = df.withColumns({"__alias": alias_key(name), "__said": F.when(~said.isin("", "UNSPECIFIED", "UNKNOWN"), said), "__panel": F.when(group != "", group)})
    df = df.withColumn("__told", told).withColumn("__category", F.when(F.col("__told").isNull(), F.col("__panel")))
    # entries by what they are and, for questions that leave it open, by null; a null specimen or category of an entry is never asked for
    open_ = [F.lit(None).cast("string")]
    of = lambda x: F.explode(F.array_distinct(F.array(*open_, F.col(x))))
    counted = entries.withColumn("__s", of("specimen")).withColumn("__t", of("specimen")).withColumn("__c", of("category"))
    counted = counted.where("__t IS NULL OR __c IS NULL").groupBy("__alias", "__s", "__t", "__c").agg(F.count(F.lit(1)).alias("__n"), F.min("code").alias("__code"))
    asked = lambda k, t, c: counted.select(F.col("__alias").alias(f"__a{k}"), F.col("__s").alias(f"__s{k}"), F.col("__t").alias(f"__t{k}"), F.col("__c").alias(f"__c{k}"), F.col("__n").alias(f"__n{k}"), F.col("__code").alias(f"__code{k}")).where(f"__t{k} IS {t}NULL AND __c{k} IS {c}NULL")
    own = lambda k: (F.col("__alias") == F.col(f"__a{k}")) & F.col("__said").eqNullSafe(F.col(f"__s{k}"))
    df = df.join(asked(0, "", ""), own(0), "left")
    df = df.join(asked(1, "NOT ", ""), own(1) & (F.col("__told") == F.col("__t1")), "left").join(asked(2, "", "NOT "), own(2) & (F.col("__category") == F.col("__c2")), "left")
    by_panel = F.when(F.coalesce("__n1", "__n2") == 1, F.coalesce("__code1", "__code2"))
    one = F.when(F.col("__n0") == 1, F.col("__code0")).when(F.col("__panel").isNotNull(), by_panel)
    return df.withColumn("code", one).drop("__alias", "__said", "__panel", "__told", "__category", *(f"__{x}{k}" for k in range(3) for x in ("a", "s", "t", "c", "n", "code")))


def patient_range(df: DataFrame, rules: DataFrame, code: str, sex: Column, age: Column, phase: Column) -> DataFrame:
    """Rows with low and high of the only rule that holds for the patient, else nulls.

    rules: code, sex, from_age, to_age, phase, low, high.  A rule of a phase holds for women in that phase only; any other holds if
    its sex (null: both) and its ages, both ends included (null: open), agree; an unknown age meets no bound, an unknown sex no
    rule of a sex.  Two rules that hold leave the row without a range, equal ones too.  A code's rules are one row of the joined side.
    """
    parts = ["sex", "from_age", "to_age", "phase", "low", "high"]
    grouped = rules.select(F.col("code").alias("__code"), F.struct(*parts).alias("__r")).groupBy("__code").agg(F.collect_list("__r").alias("__rules"))
    df = df.withColumns({"__sex": sex, "__age": age, "__phase": phase}).join(grouped, F.col(code) == F.col("__code"), "left")

    def holds(r):
        ages = (r["from_age"].isNull() & r["to_age"].isNull()) | F.col("__age").between(F.coalesce(r["from_age"], F.lit(0)), F.coalesce(r["to_age"], F.lit(10**6)))
        plain = (r["sex"].isNull() | (r["sex"] == F.col("__sex"))) & ages
        return F.coalesce(F.when(r["phase"].isNotNull(), (F.col("__sex") == "F") & (r["phase"] == F.col("__phase"))).otherwise(plain), F.lit(False))

    one = df.withColumn("__held", F.filter("__rules", holds))
    only = lambda f: F.when(F.size("__held") == 1, F.get("__held", F.lit(0))[f])
    return one.withColumns({"low": only("low"), "high": only("high")}).drop("__sex", "__age", "__phase", "__code", "__rules", "__held")


def tokenised_lookup(df: DataFrame, key: str, raw: str, aliases: DataFrame) -> DataFrame:
    """(key, code) of each row: the code that every one of its text's parts names, if there are several parts and they agree; else null.

    aliases: alias, code.  A part that is no alias, or the alias of two codes, leaves the row without a code.
    """
    known = aliases.select(F.lower("alias").alias("__part"), "code").groupBy("__part").agg(F.countDistinct("code").alias("__n"), F.min("code").alias("code")).where("__n = 1").drop("__n")
    parts = df.select(key, F.explode(F.filter(F.split(F.trim(F.lower(raw)), r"\s+"), lambda x: x != "")).alias("__part"))
    found = parts.join(known, "__part", "left").groupBy(key).agg(F.count(F.lit(1)).alias("__parts"), F.count("code").alias("__known"), F.countDistinct("code").alias("__codes"), F.min("code").alias("__code"))
    one = (F.col("__parts") > 1) & (F.col("__known") == F.col("__parts")) & (F.col("__codes") == 1)
    return df.select(key).join(found, key, "left").select(key, F.when(one, F.col("__code")).alias("code"))


def rule_table(spark, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table of rules as a local relation, whose size the optimizer knows (null, numbers, strings and booleans)."""
    marks, values = [], {}
    for i, row in enumerate(rows):
        marks.append("(" + ", ".join(f":v{i}_{j}" for j in range(len(row))) + ")")
        values |= {f"v{i}_{j}": v for j, v in enumerate(row)}
    return spark.sql(f"SELECT * FROM VALUES {', '.join(marks)} AS t({columns})", args=values)


def asof_prior(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The value of the latest earlier time of the key, if that time has only one value.

    Times are aggregated first, so the look back is one window over distinct times.
    """
    from ledgerline.operators.series import over

    times = df.groupBy(*keys, at).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias("__v"), F.count(F.lit(1)).alias("__c"))
    prior = times.select(*keys, at, F.lag("__v").over(over(keys, at)).alias("prior"), F.lag(at).over(over(keys, at)).alias("prior_at"))
    return df.join(prior, [*keys, at])


def overlay(base: DataFrame, revisions: DataFrame, keys: list[str], sequence: str, fields: list[str]) -> DataFrame:
    """Base rows with the fields of their latest revision where it sets them; base values stay beside them."""
    last = latest(revisions, keys, F.col(sequence).desc()).select(*keys, *(F.col(f).alias(f"__{f}") for f in fields))
    joined = base.join(last, keys, "left")
    for f in fields:
        joined = joined.withColumn(f"effective_{f}", F.coalesce(f"__{f}", f)).drop(f"__{f}")
    return joined


def component_sums(whole: DataFrame, parts: DataFrame, key: str, total: str, part: str, tolerance: float) -> DataFrame:
    """Rows with the sum of their parts and whether it holds within the tolerance; null where there are no parts."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("parts_sum"), F.count(F.lit(1)).alias("n_parts"))
    return whole.join(sums, key, "left").withColumn("holds", F.abs(F.col("parts_sum") - F.col(total)) <= tolerance)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='ledgerline-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's shared folder, so that a loop's plan doesn't grow."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ledgerline-"))
    return df.checkpoint()


def lineage(edges: DataFrame, node: str, previous: str, rounds: int = 40) -> DataFrame:
    """(node, root, steps): each node's first ancestor.

    Pointers double every round, so chains of any length below 2 ** ``rounds`` end
    early; a cycle has no root and its nodes point to null.  A node leaves the loop
    when its pointer is a root, so no round joins on roots that many nodes share.
    """
    c = F.col
    all_ = edges.select(c(node).alias("node"), c(previous).alias("up"))
    roots = all_.where("up IS NULL").select("node")
    done = roots.select("node", c("node").alias("root"), F.lit(0).alias("steps"))
    # a parent that is a root, or isn't there, ends the chain
    known = all_.select(c("node").alias("up"), c("up").isNull().alias("top"))
    first = all_.where("up IS NOT NULL").join(known, "up", "left").select("node", F.when(c("top").isNotNull(), c("up")).alias("up"), F.lit(1).alias("steps"), F.coalesce("top", F.lit(True)).alias("top"))
    at = settled(first)
    arrived = at.where("top")
    for _ in range(rounds):
        ahead = arrived.unionByName(at.where("NOT top")).select(c("node").alias("up"), c("up").alias("__up"), c("steps").alias("__steps"), c("top").alias("__top"))
        at = settled(at.where("NOT top").join(ahead, "up").select("node", c("__up").alias("up"), (c("steps") + c("__steps")).alias("steps"), c("__top").alias("top")))
        arrived = arrived.unionByName(at.where("top"))
        if at.where("top").isEmpty():  # what is left runs in circles
            nowhere = at.select("node", F.lit(None).alias("root"), F.lit(None).alias("steps"))
            ends = arrived.select("node", c("up").alias("root"), F.when(c("up").isNotNull(), c("steps")).alias("steps"))
            return done.union(ends).union(nowhere)
    raise RuntimeError(f"chains are longer than 2 ** {rounds}")


def hamming_within(left: DataFrame, right: DataFrame, bits: str, key: str, radius: int, blocks: int = 4) -> DataFrame:
    """Pairs (left, right, distance), left < right, within the radius over 64-bit numbers; rows of a null number are in none.

    Some block of a pair within the radius differs by at most radius // blocks bits.  The left side asks
    for all values so near to its own, so that both meet on whole blocks; a pair counts in its first such block.
    """
    width, reach = 64 // blocks, radius // blocks
    part = lambda x, k: F.shiftrightunsigned(x, k * width).bitwiseAND(F.lit((1 << width) - 1))
    near = [sum(1 << i for i in at) for n in range(reach + 1) for at in combinations(range(width), n)]
    a = left.select(F.col(key).alias("left"), F.col(bits).alias("__a"), F.posexplode(F.array(*(part(bits, k) for k in range(blocks)))).alias("__block", "__own"))
    a = a.select("left", "__a", "__block", F.explode(F.transform(F.array(*map(F.lit, near)), lambda m: F.col("__own").bitwiseXOR(m.cast("long")))).alias("__part"))
    b = right.select(F.col(key).alias("right"), F.col(bits).alias("__b"), F.posexplode(F.array(*(part(bits, k) for k in range(blocks)))).alias("__block", "__part"))
    pairs = a.join(b, ["__block", "__part"]).where(F.col("left") < F.col("right")).withColumn("__x", F.col("__a").bitwiseXOR(F.col("__b"))).withColumn("distance", F.bit_count("__x"))
    first = reduce(lambda out, k: F.when(F.bit_count(part("__x", k)) <= reach, k).otherwise(out), reversed(range(blocks)), F.lit(-1))
    return pairs.where((F.col("distance") <= radius) & (first == F.col("__block"))).select("left", "right", "distance")


def components(pairs: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """(keys, node, component) of the nodes of ``pairs`` (keys, left, right): the smallest node that links lead to, within equal keys.

    Stars towards larger and smaller neighbours in turn: the links of a chain halve every round.
    Null ends and keys are left out.
    """
    ends = [*keys, "u", "v"]
    links = pairs.where("left <> right").select(*keys, F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v")).dropna().distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*ends)), F.sum(F.xxhash64(*ends).bitwiseAND(F.lit(0xFFFFFFFF)))).first())

    links = settled(links)
    was = state(links)
    for _ in range(rounds):
        both = links.union(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).where("v <> m").select(*keys, F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select(*keys, "u", F.col("m").alias("v")))
        links = settled(small.distinct())
        now = state(links)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = links.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.union(links.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Nodes and pairs of a group up to which ``complete_link`` works on it as one; a larger group is cut into its connected parts.
WHOLE_GROUP = 1 << 18


def each_group(rows: DataFrame, run: Callable, out: list[int | pa.DataType], schema: DataType | str, order: tuple[str, ...] = ()) -> DataFrame:
    """What ``run`` (lists of a group's other columns) says of each group, the first column: lists of columns, with the group before them.

    A partition's groups stand one after the other, so one group is held at a time and none costs a frame of its
    own.  ``out``: the types of the result, or the columns of ``rows`` that have them; ``order``: the order of a group's rows.
    """
    group = rows.columns[0]

    def walk(batches):
        key, held, fresh = None, [], True
        for b in batches:
            kinds = [b.schema.types[k] if isinstance(k, int) else k for k in out]
            keys, *columns = (c.to_pylist() for c in b.columns)
            done, at = [[] for _ in out], 0

            def end(key, held, done=done):
                found = run(*held)
                done[0] += [key] * len(found[0])
                for whole, own in zip(done[1:], found, strict=True):
                    whole += own

            for own, same in groupby(keys):
                n = at + sum(1 for _ in same)
                if not fresh and own == key:
                    for whole, c in zip(held, columns, strict=True):
                        whole += c[at:n]
                else:
                    if not fresh:
                        end(key, held)
                    key, held, fresh = own, [c[at:n] for c in columns], False
                at = n
            yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(done, kinds, strict=True)], names=names)
        if not fresh:
            done = [[] for _ in out]
            end(key, held, done)
            yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(done, kinds, strict=True)], names=names)

    schema = DataType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(walk, schema)


def _clusters(left: list, right: list) -> tuple[list, list]:
    """(nodes, clusters) of a group's nodes (equal ends) and pairs."""
    nodes, before = {a for a, b in zip(left, right, strict=True) if a == b}, {}
    for a, b in zip(left, right, strict=True):
        if a != b and a in nodes and b in nodes:
            before.setdefault(max(a, b), set()).add(min(a, b))
    home, size = {}, {}
    for x in sorted(nodes):
        met: dict = {}
        for y in before.get(x, ()):
            met[home[y]] = met.get(home[y], 0) + 1
        home[x] = min((c for c, n in met.items() if n == size[c]), default=x)
        size[home[x]] = size.get(home[x], 0) + 1
    return list(home), list(home.values())


def complete_link(pairs: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, node, cluster): a node joins the first cluster all of whose members it is paired with, in order of ids; a cluster has its first member's id.

    Nodes that no chain of pairs connects don't see each other, so of a group with many pairs (``WHOLE_GROUP``) a
    connected part is worked on as one, in time and memory by its pairs; a group may be of any size.
    Repeated nodes and pairs count once, pairs hold either way round, ends that are no nodes and null ids take no part.
    """
    ids = nodes.select(group, F.col("node").alias("left"), F.col("node").alias("right")).dropna()
    rows = settled(ids.union(pairs.select(group, "left", "right").where("left <> right").dropna()).repartition(group))
    kind = dict(ids.dtypes)
    schema = lambda name: f"{name} {kind[group]}, node {kind['left']}, cluster {kind['left']}"
    large = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > WHOLE_GROUP).select(group)
    if large.isEmpty():
        return each_group(rows, _clusters, [0, 1, 1], schema(group))
    large = settled(large)
    hot = rows.join(large, group, "left_semi")
    ids = hot.where("left = right").select(group, F.col("left").alias("node")).distinct()
    ends = hot.where("left <> right").select(group, F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    for side in ("left", "right"):
        ends = ends.join(ids.select(group, F.col("node").alias(side)), [group, side], "left_semi")
    ends = settled(ends.select(group, "left", "right"))
    part = settled(components(ends, [group]))
    # a part stands for its group: struct of both, so that parts of one number in two groups stay apart
    of = ends.join(part.select(group, F.col("node").alias("left"), "component"), [group, "left"])
    both = of.select(F.struct(group, "component").alias("__part"), "left", "right")
    whole = part.select(F.struct(group, "component").alias("__part"), F.col("node").alias("left"), F.col("node").alias("right")).union(both)
    apart = each_group(whole, _clusters, [0, 1, 1], f"__part struct<{group}:{kind[group]},component:{kind['left']}>, node {kind['left']}, cluster {kind['left']}")
    alone = ids.join(part.select(group, "node"), [group, "node"], "left_anti").select(group, "node", F.col("node").alias("cluster"))
    cool = each_group(rows.join(large, group, "left_anti").select(group, "left", "right"), _clusters, [0, 1, 1], schema(group))
    return cool.union(apart.select(F.col(f"__part.{group}").alias(group), "node", "cluster")).union(alone)


def assigned(scores: DataFrame, group: str) -> DataFrame:
    """(group, left, right, score) of the one-to-one matching with the largest total score, group by group (bounded groups)."""

    def run(lefts: list, rights: list, scores: list) -> tuple[list, list, list]:
        (left, i), (right, j) = np.unique(lefts, return_inverse=True), np.unique(rights, return_inverse=True)
        score = np.zeros((len(left), len(right)))
        score[i, j] = scores
        if len(left) <= len(right):
            pairs = enumerate(shortest_augmenting(-score))
        else:
            pairs = ((b, a) for a, b in enumerate(shortest_augmenting(-score.T)))
        good = [(a, b) for a, b in pairs if score[a, b] > 0]
        return [left[a].item() for a, _ in good], [right[b].item() for _, b in good], [float(score[a, b]) for a, b in good]

    rows = scores.select(group, "left", "right", F.col("score").cast("double"))
    return each_group(rows, run, [0, 1, 2, 3], ", ".join(f"{name} {kind}" for name, kind in rows.dtypes))


def shortest_augmenting(cost) -> list[int]:
    """The column of each row in a cheapest assignment of a matrix with no more rows than columns, by shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    n, m = cost.shape if cost.size else (0, 0)
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        best, back, done, reach, col = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), row, -1
        while True:
            d = cost[reach] - row_price[reach] - col_price
            nearer = ~done & (d < best)
            best[nearer], back[nearer] = d[nearer], col
            nxt = int(np.where(done, np.inf, best).argmin())
            low = best[nxt]
            row_price[owner[done]] += low
            col_price[done] -= low
            best[~done] -= low
            row_price[row] += low
            col, done[nxt] = nxt, True
            if owner[col] < 0:
                break
            reach = owner[col]
        while col >= 0:
            prev = back[col]
            owner[col] = row if prev < 0 else owner[prev]
            col = prev
    out = [-1] * n
    for j in np.flatnonzero(owner >= 0):
        out[owner[j]] = int(j)
    return out
