"""Lines, sampling times, sides and terms on small cases with nulls, ties and repeated rows."""

import datetime

from ledgerline.operators import intake


def test_lines_by_gap(spark):
    rows = [(1, 1, 0, 1, 0.0, 2.0, "ab"), (1, 1, 0, 2, 3.0, 4.0, "c"), (1, 1, 0, 3, 5.0, 7.0, "de"), (1, 1, 0, 4, 9.0, 11.0, "fg"), (1, 1, 0, 5, 8.0, 8.5, "  "), (1, 1, 0, 6, 8.0, 8.5, None), (1, 1, 1, 7, 0.0, 2.0, "hi"), (1, 1, 1, 8, 3.6, 5.6, "jk"), (1, 1, 1, 9, 7.3, 9.3, "lm")]
    got = intake.source_lines(spark.createDataFrame(rows, "version_id int, page_number int, row int, reading_order int, x0 double, x1 double, text string")).collect()
    assert sorted((r.row, r.line, r.text, r.n_blocks) for r in got) == [(0, 1, "abcde", 3), (0, 2, "fg", 1), (1, 1, "hi jk", 2), (1, 2, "lm", 1)]


def test_sampling_states(spark):
    day, other = datetime.date(2024, 5, 1), datetime.date(2024, 5, 2)
    cases = {
        "full": [(day, 3600, False, False, 0.99)],
        "parts": [(day, None, None, False, 0.99), (None, 3660, True, False, 0.99)],
        "days": [(day, 3600, False, False, 0.99), (other, None, False, False, 0.99)],
        "minutes": [(day, 3600, False, False, 0.99), (None, 3660, False, False, 0.99)],
        "agree": [(day, 3600, False, False, 0.99), (day, 3605, True, None, None)],
        "seconds": [(day, 3604, True, False, 0.99), (day, 3605, True, False, 0.99)],
        "apart": [(day, None, None, False, 0.99), (other, None, None, False, 0.99), (None, 3600, False, False, 0.99)],
        "faint": [(day, 3600, False, False, 0.5)],
        "day": [(day, None, None, False, 0.99)],
        "clock": [(None, 60, False, False, 0.99)],
        "none": [(None, None, None, None, None)],
        "bad": [(None, None, None, True, 0.99)],
    }
    rows = [(k, *r) for k, rs in cases.items() for r in rs]
    got = intake.sampling_times(spark.createDataFrame(rows, "id string, day date, clock long, to_second boolean, invalid boolean, confidence double"), ["id"])
    told = {r.id: (r.state, r.reason, r.precision, r.sampled_at is not None) for r in got.collect()}
    conflict = ("REVIEW", "sampling_datetime_conflict", "", False)
    assert told == {
        "full": ("ACCEPTED", "", "MINUTE", True),
        "parts": ("ACCEPTED", "", "SECOND", True),
        "days": conflict,
        "minutes": conflict,
        "agree": ("ACCEPTED", "", "SECOND", True),
        "seconds": conflict,
        "apart": conflict,
        "faint": ("REVIEW", "sampling_datetime_unreliable", "MINUTE", True),
        "day": ("REJECTED", "sampling_time_missing", "", False),
        "clock": ("REJECTED", "sampling_date_missing", "", False),
        "none": ("REJECTED", "sampling_datetime_missing", "", False),
        "bad": ("REJECTED", "sampling_datetime_unreliable", "", False),
    }
    assert got.where("id = 'agree'").first().sampled_at == datetime.datetime(2024, 5, 1, 1, 0, 5)


def test_sides(spark):
    side, scoped = intake.SIDE_KEY, intake.SCOPED_SIDE_KEY
    rows = [
        (1, side, "WHOLE_ENTITY", 7, "LEFT", True, False), (1, side, "WHOLE_ENTITY", 7, "LEFT", True, None),
        (2, side, "WHOLE_ENTITY", 7, "LEFT", True, False), (2, side, "WHOLE_ENTITY", 7, "RIGHT", True, False),
        (3, side, "WHOLE_ENTITY", 8, "LEFT", True, False), (3, scoped, "NAMED_MEMBERS_ONLY", 7, None, True, False),
        (4, side, None, None, None, None, None), (5, "lesion.size", "WHOLE_ENTITY", 7, "LEFT", True, False),
        (6, side, "WHOLE_ENTITY", 7, "NOWHERE", True, False),
    ]
    fields = spark.createDataFrame(rows, "entity int, field_key string, scope_state string, parent_id int, code string, usable boolean, conflict boolean")
    got = intake.effective_side(fields, spark.createDataFrame([(7, True), (7, True), (8, False)], "parent_id int, current boolean"), "entity")
    assert {r.entity: (r.scope_state, r.side) for r in got.collect()} == {1: ("WHOLE_ENTITY", "LEFT"), 2: ("CONFLICT", None), 3: ("NAMED_MEMBERS_ONLY", None), 4: ("UNKNOWN_SCOPE", None), 6: ("UNAVAILABLE", None)}


def test_terms_and_regions(spark):
    rows = [(1, 10, "X", "Na me*", "g", "B"), (1, 11, "X", "NAME", None, "B"), (1, 12, "K", "known", "Kg", None), (1, 13, "K", "known", " g", "B"), (1, 14, "K", "known", None, "B"), (2, 15, None, None, None, None)]
    obs = spark.createDataFrame(rows, "patient_id int, observation_id int, standard_code string, raw_name string, raw_unit string, specimen string")
    got = intake.term_candidates(obs, spark.createDataFrame([("K", ["g"])], "standard_code string, unit_keys array<string>")).collect()
    assert sorted((r.patient_id, r.kind, r.raw_term or "", r.n_sources, r.first_source) for r in got) == [(1, "PROJECT", "Na me*", 2, 10), (1, "UNIT", "Kg", 1, 12), (2, "PROJECT", "", 1, 15)]
    regions = spark.createDataFrame([(1, 1, i) for i in range(1, 6)] + [(1, 2, 3), (1, None, 3), (1, 1, 5)], "version_id int, page_number int, reading_order int")
    left = intake.without_rejected(regions, spark.createDataFrame([(1, 1, 2, 3), (1, 1, 3, 4)], "version_id int, page_number int, start_order int, end_order int"))
    assert sorted((r.page_number or 0, r.reading_order) for r in left.collect()) == [(0, 3), (1, 1), (1, 5), (1, 5), (2, 3)]
