"""Matching plain-English questions to governed metrics, in bulk.

A question matches a metric when its lower-cased text contains one of the
metric's alias phrases. ``mode="first"`` walks metrics and aliases in
declaration order and takes the first hit; ``mode="longest"`` prefers the
longest matching alias (so "average price per airline" reaches the
per-airline metric instead of the overall average). Either way the match is
one ``CASE WHEN contains(...)`` chain evaluated row by row inside codegen:
no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.operators.metrics import REGISTRY, metric_results, run_metric
from farelens.operators.results import SAMPLE_ROWS, chart_kind, sample_json


def _alias_order(mode: str) -> list[tuple[str, str]]:
    pairs = [(alias, key) for key, m in REGISTRY.items() for alias in m.aliases]
    if mode == "first":
        return pairs
    if mode == "longest":
        return sorted(pairs, key=lambda p: -len(p[0]))  # stable: ties keep declaration order
    raise ValueError(mode)


def match_metric(question: Column | str, mode: str = "first") -> Column:
    """Metric key for each question, NULL when no alias occurs."""
    return _match_lowered(F.lower(F.col(question) if isinstance(question, str) else question), mode)


def match_questions(df: DataFrame, col: str = "question", modes: tuple[str, ...] = ("first", "longest"),
                    prefix: str = "metric_") -> DataFrame:
    """Add one ``metric_<mode>`` column per mode. The lower-cased text gets its
    own projection, so it is computed once per row, not once per alias."""
    keep = [F.col(c) for c in df.columns]
    staged = df.select(*keep, F.lower(F.col(col)).alias("_q"))
    return staged.select(*keep, *[_match_lowered(F.col("_q"), m).alias(f"{prefix}{m}") for m in modes])


def _match_lowered(q: Column, mode: str) -> Column:
    out = F.lit(None).cast("string")
    for alias, key in reversed(_alias_order(mode)):
        out = F.when(q.contains(F.lit(alias)), F.lit(key)).otherwise(out)
    return out


def match_question(question: str, mode: str = "first") -> str | None:
    """The same rule for one question held on the driver."""
    q = question.lower()
    for alias, key in _alias_order(mode):
        if alias in q:
            return key
    return None


def governed_rows(flights: DataFrame, results: dict[str, DataFrame] | None = None) -> DataFrame:
    """(metric_key, sort_value, record): every row of all nine governed results,
    as JSON records. ``sort_value`` is the number that orders a result, largest
    first where the result runs downwards (ascending results carry it negated),
    null for single values; ties run by record. All results come from one scan
    (:func:`metric_results`) unless ``results`` gives them; nothing is gathered, so a
    result may have any number of rows."""
    # the column that orders a table result, and its direction
    order = {"busiest_route": ("flights", 1), "busiest_airport": ("flights", 1),
             "avg_price_by_airline": ("avg_price", 1), "cheapest_flight_by_route": ("cheapest_price", -1)}
    out = None
    for key, df in (results or metric_results(flights)).items():
        col, sign = order.get(key, (None, 1))
        value = (F.col(col).cast("double") * sign) if col else F.lit(None).cast("double")
        part = df.select(F.lit(key).alias("metric_key"), value.alias("sort_value"),
                         F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


def metric_answers(flights: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """(metric_key, row_count, sample): per governed metric the number of rows
    of its result and a JSON array of the first ``n`` of them, for display. One
    row per registered metric; whole results are :func:`governed_rows`."""
    out = None
    for key, df in metric_results(flights).items():
        ordered = F.array_sort(F.collect_list(F.struct("rn", "record")))
        text = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["record"]), ","), F.lit("]"))
        part = sample_json(df, n).agg(text.alias("sample")).select(
            F.lit(key).alias("metric_key"), df.agg(F.count(F.lit(1))).scalar().alias("row_count"), "sample")
        out = part if out is None else out.unionByName(part)
    return out


def answer_questions(questions: DataFrame, flights: DataFrame, col: str = "question",
                     mode: str = "first") -> DataFrame:
    """Bulk governed answers: every question gets its matched metric key, the
    number of rows of that metric's result and a sample of them (NULL when
    nothing matches). The result itself, in full, is :func:`governed_rows` under
    the metric key. The joined side has one row per registered metric, a bound
    known before running, so it is broadcast and the question log is never
    shuffled."""
    matched = match_questions(questions, col, modes=(mode,))
    answers = F.broadcast(metric_answers(flights))
    key = f"metric_{mode}"
    return (matched.join(answers, matched[key] == answers["metric_key"], "left")
            .drop("metric_key"))


@dataclass
class Answer:
    question: str
    metric_key: str | None
    data: DataFrame | None
    chart: str | None
    sample: DataFrame | None


def answer(flights: DataFrame, question: str, mode: str = "first") -> Answer:
    """Governed answer to one question: the metric's result, a 20-row JSON
    sample of it and the chart kind. No match gives an empty answer; free
    text is never turned into SQL here."""
    key = match_question(question, mode)
    if key is None:
        return Answer(question, None, None, None, None)
    data = run_metric(flights, key)
    return Answer(question, key, data, chart_kind(data), sample_json(data))
