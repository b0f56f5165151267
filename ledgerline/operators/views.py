"""Views and policies of a record archive: comparison matrix, lab output, cards, calendars, limits, resolutions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators.records import daily_latest, folded
from ledgerline.operators.series import over


def comparison_matrix(cells: DataFrame, catalog_order: list[tuple[str, int]]) -> DataFrame:
    """Cells of a patient's matrix: one row an indicator (code, specimen, method basis) and report, with both places.

    Rows are in the catalog's order, then by code; columns by report.  Equal results of
    a cell are folded.  A cell of one result has its value (null if it can't be shown as a number) and unit;
    of several, neither, but all ``results`` as they were printed.  ``abnormal`` is the flag that all its
    results have, else ``review``.

    cells: ``comparable`` rows with review, method_basis and abnormal.
    """
    result = F.coalesce(F.round("shown_value", 6).cast("string"), F.col("raw_value"))
    keys = ["patient_id", "standard_code", "specimen", "method_basis", "report_id"]
    shown = cells.select(*keys, result.alias("result"), "shown_unit", "observation_id", "reference_range_raw", "report_flag_raw", (F.col("state") != "insufficient").alias("trend_eligible"), F.col("review").alias("review_required"), F.round("shown_value", 6).alias("value"), "raw_value", "abnormal")
    printed = [F.min("value").alias("value"), F.array_sort(F.collect_set("raw_value")).alias("printed"), F.min("abnormal").alias("least"), F.max("abnormal").alias("most")]
    folds = folded(shown, [*keys, "result", "shown_unit"], *printed)
    place = reduce(lambda out, x: F.when(F.col("standard_code") == x[0], x[1]).otherwise(out), catalog_order, F.lit(9))
    patient = Window.partitionBy("patient_id")
    indicator = (place, "standard_code", "specimen", "method_basis")
    placed = folds.withColumn("row_no", F.dense_rank().over(patient.orderBy(*indicator))).withColumn("column_no", F.dense_rank().over(patient.orderBy("report_id")))
    return placed.groupBy(*keys, "row_no", "column_no").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.sum(F.size("sources")).alias("n_sources"),
        F.bool_or("reference_difference").alias("reference_difference"),
        F.bool_or("review_required").alias("review_required"),
        F.min(F.get("sources", 0)).alias("first_source"),
        F.when(F.count(F.lit(1)) == 1, F.min("value")).alias("value"),
        F.when(F.count(F.lit(1)) == 1, F.min("shown_unit")).alias("unit"),
        F.when(F.min("least") == F.max("most"), F.min("least")).otherwise("review").alias("abnormal"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("printed")))), " | ").alias("results"),
    )


def lab_output(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A day's results: the latest value or a dispute, counts of results and reports, and whether references differ.

    cells: the keys, sampled_at, shown_value, accepted, report_id, reference_range_raw, report_flag_raw.
    Null keys are a key.
    """
    last = daily_latest(cells, keys, "sampled_at", "shown_value", "accepted")
    counts = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_results"),
        F.countDistinct("report_id").alias("report_count"),
        (F.countDistinct(F.trim("reference_range_raw"), F.trim("report_flag_raw")) > 1).alias("reference_difference"),
    )
    counts = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), "n_results", "report_count", "reference_difference")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return last.join(counts, same).drop(*(f"__{k}" for k in keys))


def report_groups(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each group of reports of the ``keys`` (a day, a month) that say the same: the reports, their values, and how they relate to the first group.

    Reports with equal sets of (indicator, value, unit) are one group.  ``relation`` is ``first``; ``same_indicators``
    (other values for the first group's indicators), ``part`` or ``wider`` (some of, or more than, its indicators),
    ``overlapping`` or ``apart``.  Groups are in the order of their smallest report id; cells without a report
    take no part; equal rows of a report count once.

    cells: the keys, report_id, standard_code, shown_value, shown_unit.
    """
    said = cells.where("report_id IS NOT NULL").groupBy(*keys, "report_id").agg(F.array_sort(F.collect_set(F.struct("standard_code", "shown_value", "shown_unit"))).alias("said"))
    groups = said.groupBy(*keys, "said").agg(F.array_sort(F.collect_set("report_id")).alias("reports"))
    codes = F.array_sort(F.array_distinct(F.transform("said", lambda x: F.coalesce(x["standard_code"], F.lit("")))))
    w = over(keys, F.get("reports", 0))
    placed = groups.withColumn("codes", codes).withColumn("group_no", F.row_number().over(w)).withColumn("of", F.first("codes").over(w))
    inside, holds = F.size(F.array_except("codes", "of")) == 0, F.size(F.array_except("of", "codes")) == 0
    relation = F.when(F.col("group_no") == 1, "first").when(inside & holds, "same_indicators").when(inside, "part").when(holds, "wider").when(F.arrays_overlap("codes", "of"), "overlapping").otherwise("apart")
    return placed.select(*keys, "group_no", "reports", F.size("said").alias("n_values"), relation.alias("relation"))


def label_matches(code: Column, labels: dict[str, str], part: str) -> Column:
    """Whether the label of a code contains ``part`` in any case."""
    return code.isin([c for c, label in labels.items() if part.casefold() in label.casefold()])


def material_status(page_status: Column) -> Column:
    """A document's material from its pages': DOCUMENT if any is, NON_DOCUMENT if all are not, else UNCERTAIN."""
    return F.when(F.bool_or(page_status == "DOCUMENT"), "DOCUMENT").when(F.bool_and(page_status == "NON_DOCUMENT"), "NON_DOCUMENT").otherwise("UNCERTAIN")


def array_median(values: Column) -> Column:
    """The median of an array; the mean of both middle elements of an even one, null of an empty one."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def date_priority(label: Column, document_type: Column) -> Column:
    """0 for a sampling, examination or treatment date, 1 for a report's or signature's, else 2."""
    # Labels by document type and priority.
    lab, other = ("采样日期|采样时间|检查日期|检验日期", "报告日期"), ("检查日期|取材日期|治疗日期", "报告日期|签署日期")
    of = lambda first, second: F.when(label.rlike(first), 0).when(label.rlike(second), 1).otherwise(2)
    return F.when(document_type == "LAB", of(*lab)).otherwise(of(*other))


def date_by_label(rows: DataFrame, keys: list[str], label: str, day: str, document_type: Column) -> DataFrame:
    """The date under the best label of each key if there is exactly one, else null; and the number of candidates."""
    best = rows.withColumn("__p", date_priority(F.col(label), document_type)).withColumn("__best", F.min("__p").over(over(keys)))
    chosen = F.when(F.col("__p") == F.col("__best"), F.col(day))
    return best.groupBy(*keys).agg(F.when(F.countDistinct(chosen) == 1, F.min(chosen)).alias(day), F.count(F.lit(1)).alias("n_candidates"))


def durable_limits(events: DataFrame, key: str, who: str, at: str, cooldown: int = 60, hour: int = 5, day: int = 15) -> DataFrame:
    """Whether each event falls in the cooldown after the one before, and whether an hour's or a day's limit was reached before it."""
    micros = events.select(key, who, F.unix_micros(F.col(at).cast("timestamp")).alias("__at"))
    line = Window.partitionBy(who).orderBy("__at")
    since = lambda seconds: F.count(F.lit(1)).over(line.rangeBetween(1 - seconds * 1_000_000, 0)) - 1
    before = F.lag("__at").over(Window.partitionBy(who).orderBy("__at", key))
    return micros.select(key, F.coalesce(before > F.col("__at") - cooldown * 1_000_000, F.lit(False)).alias("cooling"), (since(3600) >= hour).alias("over_hour"), (since(86400) >= day).alias("over_day"))


def task_cards(items: DataFrame, batch: str, cutoff: Column) -> DataFrame:
    """Counts and main status of each batch that is active or was touched since the cutoff.

    items: the batch, state (processing, completed, failed), at.
    """
    count = lambda state: F.count_if(F.col("state") == state).alias(state)
    cards = items.groupBy(batch).agg(F.count(F.lit(1)).alias("total"), count("processing"), count("completed"), count("failed"), F.max("at").alias("__last"))
    main = F.when(F.col("processing") > 0, "PROCESSING").when(F.col("failed") == F.col("total"), "FAILED").when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETED")
    return cards.where((F.col("processing") > 0) | (F.col("__last") >= cutoff)).withColumn("main_status", main).drop("__last")


def month_view(rows: DataFrame, month: str) -> DataFrame:
    """The Monday-first weeks of a month with each day's number of rows and kinds; days of other months are empty.

    rows: day, kind.
    """
    start = F.to_date(F.lit(month))
    first, last = F.trunc(start, "week"), F.date_add(F.trunc(F.last_day(start), "week"), 6)
    grid = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"), first.alias("__first"))
    in_month = F.trunc("day", "month") == F.trunc(start, "month")
    counts = rows.where(in_month).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"))
    days = grid.join(F.broadcast(counts), "day", "left")  # 31 rows at most
    return days.select("day", F.floor(F.datediff("day", "__first") / 7).cast("int").alias("week"), (F.weekday("day") + 1).alias("weekday"), in_month.alias("in_month"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


def profile_resolution(subjects: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """The display profile of each subject if all that is said agrees, else GENERAL; and the first reason that holds.

    said: the key, profile (null: not supported), eligible.
    """
    c = F.col
    # The reasons.
    per = said.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.count("profile").alias("__known"), F.countDistinct("profile").alias("__profiles"), F.min("profile").alias("__profile"), F.bool_and("eligible").alias("__eligible"))
    joined = subjects.join(per, key, "left")
    reason = (
        F.when(c("__n").isNull(), "no_reported_diagnosis")
        .when(c("__profiles") + (c("__known") < c("__n")).cast("int") > 1, "reported_diagnoses_differ")
        .when(c("__known") == 0, "unsupported_reported_diagnosis")
        .when(~c("__eligible"), "original_review_required")
        .otherwise("reported_diagnosis")
    )
    return joined.withColumn("reason", reason).select(key, F.when(c("reason") == "reported_diagnosis", c("__profile")).otherwise("GENERAL").alias("profile"), "reason")


def rule_coverage(rows: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Of each rule (name, applies, triggers): rows assessed, applicable and triggered, and whether it was exercised; one pass over the rows."""
    counts = [F.struct(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("assessed"), F.count_if(applies).alias("applicable"), F.count_if(applies & triggers).alias("triggered")) for name, applies, triggers in rules]
    return rows.agg(F.array(*counts).alias("r")).select(F.inline("r")).withColumn("status", F.when(F.col("applicable") > 0, "exercised").otherwise("not_evaluated"))
