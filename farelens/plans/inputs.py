"""Text inputs derived from the fare table, for the bulk question matcher and
the SQL screen.

Each fare row yields one question and one logged statement: a fixed phrasing
(picked by the row's price) filled in with that row's cities, airline and
price. The inputs therefore grow with the table and are computed on the
executors like any other projection. Real user turns from ``conversations``
are added to the question stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens import schema as S

# Question phrasings. Placeholders: {src} {dst} {airline} {price}.
QUESTION_TEMPLATES = [
    "What is the average price from {src} to {dst}?",
    "How many flights does {airline} operate?",
    "Which is the busiest route out of {src}?",
    "Show me flights from {src} to {dst} under {price}",
    "AVERAGE PRICE PER AIRLINE flying to {dst}",
    "What percentage of non-stop flights land in {dst}?",
    "cheapest flight by route starting at {src}",
    "number of airlines serving {dst}",
    "Is {src} the busiest city?",
    "mean price of {airline} tickets",
    "total routes touching {src}",
    "Which airport with the most flights is near {dst}?",
    "price by airline for {airline} versus others",
    "lowest price per route to {dst}",
]

# Logged statements, good and bad, with the verdicts (compat,
# strict) that a reader of the rules gives them. Same placeholders.
SQL_VERDICTS = [
    ("SELECT * FROM flights WHERE Source = '{src}' AND destination = '{dst}'", True, True),
    ("SELECT airline, AVG(Price) FROM flights WHERE airline = '{airline}' GROUP BY airline", True, True),
    ("DELETE FROM flights WHERE Price > {price}", False, False),
    ("SELECT * FROM flights, users WHERE Price = {price}", True, False),
    ("SELECT * FROM `users` WHERE airline = '{airline}'", True, False),
    ("SELECT * FROM flights WHERE Price < {price}; DROP TABLE flights", False, False),
    ("SELECT EXTRACT(YEAR FROM date_of_journey) FROM flights WHERE Source = '{src}'", False, True),
    ("SELECT * FROM flights.users WHERE Price = {price}", True, False),
    ("UPDATE flights SET Price = {price}", False, False),
    ("SELECT * FROM flights WHERE airline = 'updated {airline}'", False, True),
    ("  select route, count(*) from flights where destination = '{dst}' group by route;  ", True, True),
    ("SELECT * FROM flights JOIN users ON flights.airline = users.name", False, False),
    ("SELECT * FROM/**/users WHERE Price = {price}", True, False),
    ("WITH t AS (SELECT * FROM flights) SELECT * FROM t", False, False),
    ("SELECT * FROM flights -- {airline}", True, False),
    ("SELECT * FROM (SELECT * FROM flights WHERE Price > {price}) t", True, True),
    ("SELECT * FROM (users) WHERE Price = {price}", True, False),
    ("SELECT * FROM(users) WHERE Source = '{src}'", True, False),
    ("SELECT * FROM (SELECT * FROM flights WHERE Price > {price}) t, users", True, False),
    ("SELECT * FROM flights STRAIGHT_JOIN users ON Price = {price}", False, False),
    ("SELECT * FROM flights f JOIN flights g ON f.Price = g.Price, users", True, False),
    ("SELECT Price FROM flights WHERE Price = {price} UNION TABLE users", True, False),
    ("SELECT * FROM flights f USE INDEX (a), users WHERE Price = {price}", True, False),
    ("INSERT INTO flights VALUES ('{airline}', {price})", False, False),
    ("DROP TABLE flights", False, False),
    ("SELECT * FROM users WHERE name = '{airline}'", False, False),
    ("SELECT updated_at FROM flights WHERE Price = {price}", False, True),
    ("SELECT * FROM flights INTO OUTFILE '/tmp/{price}'", True, False),
    ("SELECT * FROM flights WHERE airline = 'a;{airline}'", False, True),
    ("SELECT * FROM flights f JOIN flights g ON f.Price = g.Price WHERE f.Price = {price}", True, True),
    ("SELECT * FROM flights AS f, users u WHERE f.Price = {price}", True, False),
    ("SELECT Price FROM flights WHERE route IN (SELECT route FROM users WHERE Price = {price})", False, False),
    ("SELECT TRIM(LEADING 'x' FROM airline) FROM flights WHERE Price = {price}", False, True),
    ("SELECT * FROM flights WHERE airline = 'it''s {airline}'", True, True),
    ("SELECT * FROM flights WHERE airline = '{src}", True, False),
    ("SELECT * FROM flights # {price}", True, False),
    ("SELECTED * FROM flights WHERE Price = {price}", True, False),
    ("SELECT airline, route FROM flights WHERE Price IN ({price}, 1) ORDER BY airline, route", True, True),
    ("SELECT MAX(Price), MIN(Price) FROM flights WHERE route IN (SELECT route FROM flights, users)", True, False),
]
SQL_TEMPLATES = [t for t, _, _ in SQL_VERDICTS]


def _fill(template: Column) -> Column:
    out = F.replace(template, F.lit("{src}"), F.col(S.SOURCE))
    out = F.replace(out, F.lit("{dst}"), F.col(S.DESTINATION))
    out = F.replace(out, F.lit("{airline}"), F.col(S.AIRLINE))
    return F.replace(out, F.lit("{price}"), F.col(S.PRICE).cast("string"))


def _pick(templates: list[str]) -> Column:
    idx = F.col(S.PRICE) % len(templates)
    return F.element_at(F.array(*[F.lit(t) for t in templates]), idx + 1)


def question_log(flights: DataFrame, spark: SparkSession | None = None,
                 sf_dir: str | None = None) -> DataFrame:
    """(origin, question): one question per fare row, plus user turns."""
    qs = flights.select(F.lit("flight").alias("origin"), _fill(_pick(QUESTION_TEMPLATES)).alias("question"))
    if spark is not None and sf_dir is not None:
        turns = (spark.read.parquet(f"{sf_dir}/conversations.parquet")
                 .where(F.col("role") == "user")
                 .select(F.lit("conversation").alias("origin"), F.col("text").alias("question")))
        qs = qs.unionByName(turns)
    return qs


def sql_log(flights: DataFrame) -> DataFrame:
    """(sql_text): one logged statement per fare row."""
    return flights.select(_fill(_pick(SQL_TEMPLATES)).alias("sql_text"))


def sql_case(templates: list[str], col: str = "Price") -> str:
    """The same template choice as a portable SQL CASE (for the oracle)."""
    arms = " ".join(
        "WHEN {} THEN '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(templates))
    return f"CASE {col} % {len(templates)} {arms} END"
