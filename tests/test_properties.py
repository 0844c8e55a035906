"""Property tests on many random inputs (one Spark job per batch): values
built from known parts, hand-judged statements, invariants, and a numpy brute
force of the outlier chain."""

from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farelens.functions.parsing import duration_minutes, stops_num, with_parsed
from farelens.operators.screen import screen
from farelens.plans.inputs import SQL_VERDICTS

# --- parsing: built from known parts, so the right answer is known ----------

@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 ** 25), st.integers(0, 10 ** 25), st.sampled_from(["", " ", "\t", "\u2003"]),
                          st.sampled_from(["h", "H"]), st.sampled_from(["m", "M", " mins"])), min_size=1, max_size=30))
def test_duration_of_any_length(spark, parts):
    """Numbers of up to 25 digits: beyond 64 bits a part counts as absent."""
    values = [f"{h}{gap}{hu} {m}{gap}{mu}" for h, m, gap, hu, mu in parts]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in df.select(duration_minutes("t")).collect()]
    staged = [r["duration_minutes"] for r in
              with_parsed(df.withColumnRenamed("t", "Duration").withColumn("Total_stops", F.lit(None).cast("string")))
              .collect()]
    assert got == staged
    for (h, m, *_), g in zip(parts, got):
        known = [x for x in (h, m) if x < 2 ** 63]
        if not known:
            assert g is None
        else:
            assert abs(g - ((h if h < 2 ** 63 else 0) * 60 + (m if m < 2 ** 63 else 0))) <= 1e-9 * max(1, g)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 ** 25), st.sampled_from([" stop", " stops", "-STOP", ""])),
                min_size=1, max_size=30))
def test_stops_of_any_length(spark, parts):
    df = spark.createDataFrame([(f" {n}{unit}",) for n, unit in parts], "t string")
    assert [r[0] for r in df.select(stops_num("t")).collect()] == [n if n < 2 ** 31 else None for n, _ in parts]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_any_text_parses_to_something(spark, values):
    df = spark.createDataFrame([(v, "non" + v) for v in values], "t string, n string")
    rows = df.select(duration_minutes("t"), stops_num("t"), stops_num("n")).collect()
    assert all(r[2] == 0 for r in rows)


# --- screening: invariants over hand-judged statements ----------------------

JUDGED = [(t.format(src="X", dst="Y", airline="A", price=7), c, s) for t, c, s in SQL_VERDICTS]
# white space before a final ";" stays in the text, and so does a ";" before that
# white space: statements that end in ";" or white space take no further ends
OPEN_ENDED = [x for x in JUDGED if x[0] == x[0].rstrip().rstrip(";")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(OPEN_ENDED), st.sampled_from(["", ";", " ;;", "\n"]), st.booleans(),
                          st.sampled_from(["", "  ", "\t"])), min_size=1, max_size=40))
def test_screen_ignores_case_and_ends(spark, picks):
    sql = [lead + (t.swapcase() if swap else t) + tail for (t, _, _), tail, swap, lead in picks]
    df = spark.createDataFrame([(x,) for x in sql], "sql string")
    got = [tuple(r) for r in df.select(screen("sql", "compat"), screen("sql", "strict")).collect()]
    assert got == [(c, s) for (_, c, s), *_ in picks]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([t for t, _, s in JUDGED if s]), st.sampled_from(
    [" UNION TABLE users", " UNION SELECT * FROM users", " UNION SELECT * FROM flights, users", " UNION SELECT * FROM (users)",
     " UNION SELECT * FROM flights STRAIGHT_JOIN users", " UNION SELECT * FROM (SELECT * FROM flights) t, users"])),
    min_size=1, max_size=30))
def test_strict_rejects_an_added_table(spark, picks):
    df = spark.createDataFrame([(t.strip().rstrip(";").strip() + more,) for t, more in picks], "sql string")
    assert not any(r[0] for r in df.select(screen("sql", "strict")).collect())


# --- question matching: column form == driver-side form -------------------

_FRAGMENTS = ["what is the ", "AVERAGE PRICE", " per airline", "how many flights", " busiest ", "route",
              "airport", "non-stop rate", "% non-stop", "number of routes", "cheapest flight by route",
              "mean price", " from Delhi", "?", "price by airline", "total airlines"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_FRAGMENTS), max_size=5).map("".join), min_size=1, max_size=30))
def test_question_match_column_equals_driver_rule(spark, questions):
    from farelens.operators.questions import match_question, match_questions
    df = spark.createDataFrame([(q,) for q in questions], "question string")
    got = [(r["metric_first"], r["metric_longest"]) for r in match_questions(df).collect()]
    assert got == [(match_question(q, "first"), match_question(q, "longest")) for q in questions]


# --- outliers: Spark chain == numpy brute force -----------------------------

_group_rows = st.lists(
    st.tuples(st.sampled_from(["R1", "R2", "R3", None]),
              st.one_of(st.none(), st.integers(100, 110), st.just(5000)),
              st.sampled_from(["1h", "1h 5m", "2h", "9h", None, "x"]),
              st.sampled_from(["non-stop", "1 stop", "2 stops", None])),
    min_size=0, max_size=40)


MINUTES = {"1h": 60.0, "1h 5m": 65.0, "2h": 120.0, "9h": 540.0, None: None, "x": None}
STOPS = {"non-stop": 0, "1 stop": 1, "2 stops": 2, None: None}


def _brute_force(rows, threshold, min_size):
    import math

    import numpy as np
    clean = []
    for route, price, dur, stops in rows:
        d, s = MINUTES[dur], STOPS[stops]
        if price is None or d is None or s is None or route is None:
            continue
        clean.append((route, float(price), d, float(s)))
    flagged = []
    for route in sorted({r[0] for r in clean}):
        grp = [r for r in clean if r[0] == route]
        if len(grp) < min_size:
            continue
        cols = np.array([[g[1], g[2], g[3]] for g in grp])
        mean = cols.mean(axis=0)
        std = cols.std(axis=0, ddof=1) if len(grp) > 1 else np.array([math.nan] * 3)
        for g, row in zip(grp, cols):
            z = [(row[i] - mean[i]) / std[i] if std[i] and not math.isnan(std[i]) else 0.0 for i in range(3)]
            # a z within rounding distance of the threshold can fall either way
            assume(all(abs(abs(v) - threshold) > 1e-9 for v in z))
            score = sum(abs(v) > threshold for v in z)
            if score >= 1:
                flagged.append((route, g[1], score))
    return sorted(flagged)


@settings(max_examples=20, deadline=None)
@given(_group_rows, st.sampled_from([1.0, 1.5, 2.0]), st.sampled_from([1, 2, 5]))
def test_outliers_match_brute_force(spark, rows, threshold, min_size):
    from farelens.operators import outliers as O
    from farelens.schema import OUTLIER_INPUT
    df = spark.createDataFrame([("A", r, p, d, s) for r, p, d, s in rows], OUTLIER_INPUT)
    flagged = O.flag_outliers(O.group_zscores(O.clean(df), broadcast_max_bytes=None), threshold, min_size)
    got = sorted((r["Route"], float(r["Price"]), r["severity_score"]) for r in flagged.collect())
    assert got == _brute_force(rows, threshold, min_size)
