"""From recognised pages to records: lines, sampling times, dates of pages, scopes, term queues, segments, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import text as texts
from ledgerline.operators.series import over

# Field keys of a side and the sides that count.
SIDE_KEY, SCOPED_SIDE_KEY = "lesion.laterality", "lesion.scoped_laterality"
SIDES = ("LEFT", "RIGHT", "BILATERAL", "MIDLINE")


def source_lines(blocks: DataFrame, reach: float = 1.6, overlap: float = 0.1) -> DataFrame:
    """(version_id, page_number, row, line, text, n_blocks): blocks of a row joined where the gap is at most ``reach`` character widths.

    blocks: version_id, page_number, row, reading_order, x0, x1, text.  A width is the
    larger of both blocks' mean; a gap below minus ``overlap`` widths parts them too.
    Single characters are joined without a space.  Blank and null texts are left out;
    equal places keep their reading order.
    """
    word = F.trim("text")
    row = over(["version_id", "page_number", "row"], "x0", "reading_order")
    width = (F.col("x1") - F.col("x0")) / F.greatest(F.length("word"), F.lit(1))
    cut = blocks.withColumn("word", word).where(F.length("word") > 0).withColumn("width", width)
    before = lambda name: F.lag(name).over(row)
    cut = cut.withColumns({"gap": F.col("x0") - before("x1"), "wide": F.greatest("width", before("width")), "short": (F.length("word") == 1) | (F.length(before("word")) == 1)})
    joins = (F.col("gap") >= -overlap * F.col("wide")) & (F.col("gap") <= reach * F.col("wide"))
    cut = cut.withColumn("starts", ~F.coalesce(joins, F.lit(False)))
    cut = cut.withColumn("line", F.sum(F.col("starts").cast("long")).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.when(F.col("starts") | F.col("short"), F.col("word")).otherwise(F.concat(F.lit(" "), "word"))
    parts = F.array_sort(F.collect_list(F.struct("x0", "reading_order", piece.alias("piece"))))
    return cut.groupBy("version_id", "page_number", "row", "line").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"), F.count(F.lit(1)).alias("n_blocks"))


def sampling_times(parts: DataFrame, keys: list[str], least: float = 0.95) -> DataFrame:
    """A report's time of sampling from all places that state it: keys, sampled_at, precision, state and reason.

    parts: the keys, day (date), clock (seconds of the day), to_second, invalid,
    confidence; each may be null.  A full statement wins; else one day with any clock.
    Statements that don't agree give REVIEW without a time, doubtful ones REVIEW with
    it, and a missing part REJECTED.
    """
    c = F.col
    full = c("day").isNotNull() & c("clock").isNotNull()
    seen = parts.withColumns({"to_second": F.coalesce("to_second", F.lit(False)), "full": full})
    found = seen.groupBy(*keys).agg(
        F.count_if("full").alias("n_full"),
        F.count_distinct("day").alias("n_days"),
        F.min("day").alias("first_day"),
        F.count("clock").alias("n_clocks"),
        F.max(F.when(full, F.struct("to_second", "day", "clock"))).alias("stated"),
        F.max(F.when(c("clock").isNotNull(), F.struct("to_second", "clock"))).alias("late"),
        F.min(F.floor(c("clock") / 60)).alias("first_minute"),
        F.max(F.floor(c("clock") / 60)).alias("last_minute"),
        F.min(F.when(c("to_second"), c("clock"))).alias("first_second"),
        F.max(F.when(c("to_second"), c("clock"))).alias("last_second"),
        F.coalesce(F.bool_or("invalid"), F.lit(False)).alias("doubtful_part"),
        F.coalesce(F.bool_or(c("confidence") < least), F.lit(False)).alias("faint"),
    )
    has = (c("n_full") > 0) | ((c("n_days") == 1) & (c("n_clocks") > 0))
    second = F.when(c("n_full") > 0, c("stated.to_second")).otherwise(c("late.to_second"))
    day = F.when(c("n_full") > 0, c("stated.day")).otherwise(c("first_day"))
    clock = F.when(c("n_full") > 0, c("stated.clock")).otherwise(c("late.clock"))
    against = (c("n_days") > 1) | (c("first_minute") != c("last_minute")) | (second & (c("first_second") != c("last_second")))
    conflict = (c("n_clocks") > 0) & (c("n_days") > 0) & (~has | against)
    doubtful = c("doubtful_part") | c("faint")
    given = has & ~conflict
    missing = F.when(c("doubtful_part"), "sampling_datetime_unreliable").when(c("n_days") > 0, "sampling_time_missing").when(c("n_clocks") > 0, "sampling_date_missing").otherwise("sampling_datetime_missing")
    return found.select(
        *keys,
        F.when(given, F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + clock)).alias("sampled_at"),
        F.when(given, F.when(second, "SECOND").otherwise("MINUTE")).otherwise("").alias("precision"),
        F.when(conflict, "REVIEW").when(~has, "REJECTED").when(doubtful, "REVIEW").otherwise("ACCEPTED").alias("state"),
        F.when(conflict, "sampling_datetime_conflict").when(~has, missing).when(doubtful, "sampling_datetime_unreliable").otherwise("").alias("reason"),
    )


def page_dates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A page's own date: that of its candidates of the first priority if they all name one day, else null; other pages lend none.

    candidates: the keys, priority (smaller first), day.
    """
    # first by priority, then the first priority's: sums, least and largest, so nothing is sorted or listed
    per = candidates.groupBy(*keys, "priority").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("low"), F.max("day").alias("high"))
    first = lambda x: F.min_by(x, "priority")
    found = per.groupBy(*keys).agg(first("low").alias("low"), first("high").alias("high"), F.sum("n").alias("n_candidates"), F.coalesce(first("n"), F.lit(0)).alias("n_selected"))
    return found.select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).alias("observation_date"), "n_candidates", "n_selected")


def without_rejected(regions: DataFrame, units: DataFrame) -> DataFrame:
    """``regions`` (version_id, page_number, reading_order) outside every rejected unit (the same page, start_order to end_order, both included)."""
    u = units.select(F.col("version_id").alias("__v"), F.col("page_number").alias("__p"), "start_order", "end_order")
    return regions.join(u, (F.col("version_id") == F.col("__v")) & (F.col("page_number") == F.col("__p")) & F.col("reading_order").between(F.col("start_order"), F.col("end_order")), "left_anti")


def effective_side(fields: DataFrame, sites: DataFrame, entity: str) -> DataFrame:
    """The side that holds for a whole entity, if its usable fields agree on one; its scope_state otherwise says why not.

    fields: the entity, field_id, field_key, scope_state, parent_id, code, usable,
    conflict.  sites: parent_id, current; a field counts only under a current site.
    """
    c = F.col
    own = fields.where(c("field_key").isin(SIDE_KEY, SCOPED_SIDE_KEY)).join(sites.groupBy("parent_id").agg(F.bool_and("current").alias("current")), "parent_id", "left")
    state = F.coalesce("scope_state", F.lit("UNKNOWN_SCOPE"))
    whole = (state == "WHOLE_ENTITY") & (c("field_key") == SIDE_KEY)
    named = (state == "NAMED_MEMBERS_ONLY") & (c("field_key") == SCOPED_SIDE_KEY)
    clash = F.coalesce("conflict", F.lit(False))
    usable = whole & F.coalesce(c("usable") & c("current"), F.lit(False)) & ~clash & c("code").isin(*SIDES)
    got = own.groupBy(entity).agg(
        F.count_if(whole).alias("n_whole"),
        F.count_if(named).alias("n_named"),
        F.count_if(~whole & ~named).alias("n_unknown"),
        F.count_distinct(F.when(usable, c("code"))).alias("n_codes"),
        F.min(F.when(usable, c("code"))).alias("code"),
        F.bool_or(whole & clash).alias("clash"),
    )
    conflict = (c("n_codes") > 1) | c("clash")
    scope = F.when(conflict, "CONFLICT").when(c("n_codes") == 1, "WHOLE_ENTITY").when(c("n_named") > 0, "NAMED_MEMBERS_ONLY").when(c("n_unknown") > 0, "UNKNOWN_SCOPE").otherwise("UNAVAILABLE")
    return got.select(entity, scope.alias("scope_state"), F.when(~conflict & (c("n_codes") == 1), c("code")).alias("side"), "n_whole", "n_named", "n_unknown")


def term_candidates(observations: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Terms for the dictionary's queue: names of unknown codes and units that a known code doesn't list, each once a patient.

    observations: patient_id, observation_id, standard_code, raw_name, raw_unit,
    specimen.  dictionary (broadcast by Spark's own size limit): standard_code, unit_keys.
    The first observation's spelling is shown; spellings with one key are one term.
    """
    c = F.col
    known = dictionary.select(c("standard_code"), c("unit_keys"))
    rows = observations.join(known, "standard_code", "left")
    unknown = c("unit_keys").isNull()
    odd = ~unknown & (F.coalesce("raw_unit", F.lit("")) != "") & ~F.array_contains("unit_keys", texts.unit_key(c("raw_unit")))
    kind = F.when(unknown, "PROJECT").when(odd, "UNIT")
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL").withColumns({"term": F.when(unknown, c("raw_name")).otherwise(c("raw_unit")), "code": F.when(unknown, "").otherwise(c("standard_code"))})
    key = F.sha2(F.concat_ws(":", "kind", F.coalesce(texts.alias_key(c("term")), F.lit("")), "code", F.coalesce("specimen", F.lit(""))), 256)
    return rows.withColumn("normalized_key", key).groupBy("patient_id", "normalized_key").agg(
        F.min_by("kind", "observation_id").alias("kind"),
        F.min_by("term", "observation_id").alias("raw_term"),
        F.min_by("code", "observation_id").alias("standard_code"),
        F.count(F.lit(1)).alias("n_sources"),
        F.min("observation_id").alias("first_source"),
    )


def chart_segments(changes: DataFrame, points: DataFrame, chart: list[str]) -> DataFrame:
    """Lines of a chart between consecutive points that may be compared, in the drawing's coordinates.

    points: the chart's columns, observation_id, day, value, eligible; changes: the
    rows of ``measurement_changes`` with observation_id, previous_id, reasons and the
    chart's barrier (null if nothing bars it).  A chart of one day or one value is
    drawn in the middle.
    """
    shown = points.where("eligible AND day IS NOT NULL AND value IS NOT NULL")
    w = over(chart)
    day, first, last = F.unix_date("day"), F.min(F.unix_date("day")).over(w), F.max(F.unix_date("day")).over(w)
    low, high = F.min("value").over(w), F.max("value").over(w)
    # The drawing's margins and size.
    x = 50 + F.when(last != first, (day - first) / (last - first) * 720).otherwise(360)
    y = 205 - F.when(high != low, (F.col("value") - low) / (high - low) * 170).otherwise(85)
    at = shown.select(*chart, "observation_id", x.alias("x"), y.alias("y"))
    open_ = changes.where((F.size("reasons") == 0) & F.col("barrier").isNull() & F.col("previous_id").isNotNull())
    ends = open_.join(at.select("observation_id", F.col("x").alias("x2"), F.col("y").alias("y2")), "observation_id")
    return ends.join(at.select(F.col("observation_id").alias("previous_id"), F.col("x").alias("x1"), F.col("y").alias("y1")), "previous_id").select("previous_id", "observation_id", "x1", "y1", "x2", "y2", "delta")


def field_evaluation(pairs: DataFrame, fields: list[str], joint: list[str], severe: list[str]) -> DataFrame:
    """(measure, tp, fp, fn, precision, recall, f1) of each field, of all ``joint`` fields at once, and errors in ``severe`` ones as intercepted or not.

    pairs: a full join of what is right and what was read: has_gold, has_read,
    intercepted, and gold_x and read_x of each field x.  A field without a right value
    isn't assessed; a row that matches nothing counts against every field it fills.
    For measure ``severe``, tp are intercepted and fn are missed errors, fp correct rows
    that were intercepted.  Rates are null over nothing.
    """
    c = F.col
    both = c("has_gold") & c("has_read")
    gold, read = (lambda f: c(f"gold_{f}")), (lambda f: c(f"read_{f}"))
    right = lambda f: F.coalesce(both & (gold(f) == read(f)), F.lit(False))
    known = lambda f: F.coalesce(c("has_gold") & gold(f).isNotNull(), F.lit(False))
    every = lambda fs, rule: reduce(lambda a, b: a & b, map(rule, fs))
    extra = c("has_read") & ~c("has_gold")
    wrong = both & reduce(lambda a, b: a | b, [known(f) & ~right(f) for f in severe]) | extra
    fine = every(joint, known) & every(joint, right)
    counts: dict[str, tuple[Column, Column, Column]] = {f: (known(f) & right(f), (known(f) & ~right(f) & both & read(f).isNotNull()) | (extra & read(f).isNotNull()), known(f) & ~right(f)) for f in fields}
    counts["joint"] = (fine, (every(joint, known) & ~every(joint, right) & both) | extra, every(joint, known) & ~every(joint, right))
    counts["severe"] = (wrong & c("intercepted"), fine & c("intercepted"), wrong & ~F.coalesce("intercepted", F.lit(False)))
    sums = pairs.agg(*[F.count_if(x).alias(f"{name}_{k}") for name, row in counts.items() for k, x in zip(("tp", "fp", "fn"), row, strict=True)])
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), *[c(f"{n}_{k}").alias(k) for k in ("tp", "fp", "fn")]) for n in counts]))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return sums.select(rows).withColumns({"precision": rate(c("tp"), c("tp") + c("fp")), "recall": rate(c("tp"), c("tp") + c("fn")), "f1": rate(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))})
