"""Independent SQL for every catalog query, for the DuckDB cross-check.

Written by hand in portable SQL against the raw star-schema tables; it shares
no code path with the Spark plans except the fixed template lists.
"""

from __future__ import annotations

from farelens.operators.metrics import REGISTRY
from farelens.plans.catalog import SEARCH_AIRLINES, SEARCH_DESTINATION, SEARCH_SOURCE
from farelens.plans.inputs import QUESTION_TEMPLATES, SQL_TEMPLATES, SQL_VERDICTS, sql_case

FLIGHTS_CTE = """
WITH base AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity,
         l.l_extendedprice, l.l_returnflag, l.l_shipdate,
         p.p_brand, sn.n_name AS s_nation, cn.n_name AS c_nation,
         (l.l_orderkey * 7 + l.l_partkey) % 97 AS k
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
), m AS (
  SELECT *, (CAST(l_quantity AS INTEGER) * 10 + CAST(l_partkey % 60 AS INTEGER))
            * CASE WHEN k IN (0, 1) THEN 4 ELSE 1 END AS mins
  FROM base
), flights AS (
  SELECT p_brand AS airline,
         CAST(l_shipdate AS DATE) AS date_of_journey,
         s_nation AS Source,
         c_nation AS destination,
         s_nation || '-' || c_nation AS route,
         lpad(CAST(l_suppkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') || ':00' AS dep_time,
         lpad(CAST((l_suppkey + 3) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') || ':00' AS Arrival_time,
         CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN NULL
              WHEN mins < 60 THEN CAST(mins AS VARCHAR) || 'm'
              WHEN mins % 60 = 0 THEN CAST(CAST(floor(mins / 60.0) AS INTEGER) AS VARCHAR) || 'h'
              ELSE CAST(CAST(floor(mins / 60.0) AS INTEGER) AS VARCHAR) || 'h ' || CAST(mins % 60 AS VARCHAR) || 'm'
         END AS Duration,
         CASE WHEN l_quantity = 49 AND l_linenumber = 1 THEN NULL
              WHEN l_linenumber <= 5 THEN 'non-stop'
              WHEN l_linenumber = 6 THEN '1 stop'
              WHEN l_linenumber = 7 THEN CASE WHEN l_returnflag = 'R' THEN '2 stops' ELSE '1 stop' END
         END AS Total_stops,
         CAST(CAST(round(l_extendedprice / 10) AS INTEGER) * CASE WHEN k = 0 THEN 4 ELSE 1 END AS INTEGER) AS Price
  FROM m
)"""

# duration and stops rules, written against a text column t
_DUR_TEXT = "lower(regexp_replace(Duration, '^\\s+|\\s+$', '', 'g'))"
_STOP_TEXT = "lower(regexp_replace(Total_stops, '^\\s+|\\s+$', '', 'g'))"
_H = f"TRY_CAST(NULLIF(regexp_extract({_DUR_TEXT}, '([0-9]+)\\s*h', 1), '') AS BIGINT)"
_M = f"TRY_CAST(NULLIF(regexp_extract({_DUR_TEXT}, '([0-9]+)\\s*m', 1), '') AS BIGINT)"
DURATION_SQL = f"""CASE WHEN Duration IS NULL THEN NULL
  WHEN {_H} IS NULL AND {_M} IS NULL THEN
    CASE WHEN regexp_matches({_DUR_TEXT}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?$')
         THEN TRY_CAST({_DUR_TEXT} AS DOUBLE) END
  ELSE CAST(COALESCE({_H}, 0) * 60 + COALESCE({_M}, 0) AS DOUBLE) END"""
STOPS_SQL = f"""CASE WHEN Total_stops IS NULL THEN NULL
  WHEN contains({_STOP_TEXT}, 'non') THEN 0
  ELSE TRY_CAST(NULLIF(regexp_extract({_STOP_TEXT}, '([0-9]+)', 1), '') AS INTEGER) END"""

OUTLIER_CTES = f""",
parsed AS (
  SELECT airline AS Airline, route AS Route, Price, Duration, Total_stops,
         {DURATION_SQL} AS duration_minutes,
         {STOPS_SQL} AS stops_num
  FROM flights
), clean AS (
  SELECT * FROM parsed
  WHERE Price IS NOT NULL AND duration_minutes IS NOT NULL AND stops_num IS NOT NULL
), stats AS (
  SELECT Route,
         avg(Price) AS price_mean, stddev_samp(Price) AS price_std,
         avg(duration_minutes) AS duration_mean, stddev_samp(duration_minutes) AS duration_std,
         avg(stops_num) AS stops_mean, stddev_samp(stops_num) AS stops_std,
         count(*) AS route_size
  FROM clean WHERE Route IS NOT NULL GROUP BY Route
), z AS (
  SELECT c.*, s.price_mean, s.price_std, s.duration_mean, s.duration_std, s.stops_mean, s.stops_std, s.route_size,
         COALESCE((c.Price - s.price_mean) / NULLIF(s.price_std, 0), 0) AS price_z,
         COALESCE((c.duration_minutes - s.duration_mean) / NULLIF(s.duration_std, 0), 0) AS duration_z,
         COALESCE((c.stops_num - s.stops_mean) / NULLIF(s.stops_std, 0), 0) AS stops_z
  FROM clean c JOIN stats s ON c.Route = s.Route
), scored AS (
  SELECT *,
         abs(price_z) > 2.0 AS price_flag,
         abs(duration_z) > 2.0 AS duration_flag,
         abs(stops_z) > 2.0 AS stops_flag,
         CAST(abs(price_z) > 2.0 AS INTEGER) + CAST(abs(duration_z) > 2.0 AS INTEGER)
           + CAST(abs(stops_z) > 2.0 AS INTEGER) AS severity_score
  FROM z WHERE route_size >= 5
), flagged AS (
  SELECT *,
         greatest(abs(price_z), abs(duration_z), abs(stops_z)) AS max_abs_z,
         CASE severity_score WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' END AS Severity,
         CASE severity_score WHEN 1 THEN '#d4edda' WHEN 2 THEN '#fff3cd' WHEN 3 THEN '#f8d7da' END AS highlight,
         'Route ' || Route || ': price ₹' || printf('%.0f', round_even(CAST(Price AS DOUBLE), 0))
           || ' vs route average ₹' || printf('%.0f', round_even(price_mean, 0))
           || '; duration ' || printf('%.0f', round_even(duration_minutes, 0))
           || ' min vs ' || printf('%.0f', round_even(duration_mean, 0))
           || ' min; stops ' || printf('%.0f', round_even(CAST(stops_num AS DOUBLE), 0))
           || ' vs ' || printf('%.1f', round_even(stops_mean, 1))
           || ' (based on ' || CAST(route_size AS VARCHAR) || ' flights).' AS explanation
  FROM scored WHERE severity_score >= 1
)"""

_OD = "Source || ' -> ' || destination"
_ROUTE_WHERE = f"Source = '{SEARCH_SOURCE}' AND destination = '{SEARCH_DESTINATION}'"
_SEARCH_COLS = ("airline AS Airline, strftime(date_of_journey, '%Y-%m-%d') AS Date, route AS Route, dep_time AS Departure, "
                "Arrival_time AS Arrival, Duration, Total_stops AS Stops, Price")
_AIRLINES_IN = ", ".join(f"'{a}'" for a in SEARCH_AIRLINES)


def _match_sql(mode: str) -> str:
    pairs = [(alias, key) for key, m in REGISTRY.items() for alias in m.aliases]
    if mode == "longest":
        pairs = sorted(pairs, key=lambda p: -len(p[0]))
    arms = " ".join(f"WHEN contains(lower(question), '{a}') THEN '{k}'" for a, k in pairs)
    return f"CASE {arms} END"


def _fill_sql(templates: list[str]) -> str:
    return ("replace(replace(replace(replace(" + sql_case(templates)
            + ", '{src}', Source), '{dst}', destination), '{airline}', airline), '{price}', CAST(Price AS VARCHAR))")


def _verdict_sql(place: int) -> str:
    """The hand-judged verdict of the statement that a row's price picks."""
    arms = " ".join(f"WHEN {i} THEN {str(v[place]).lower()}" for i, v in enumerate(SQL_VERDICTS))
    return f"CASE Price % {len(SQL_VERDICTS)} {arms} END"


def _r4(c: str) -> str:
    return f"round({c}, 4) AS {c}"


def _scalar_row(key: str, value: str) -> str:
    return (f"SELECT '{key}' AS metric_key, CAST(NULL AS DOUBLE) AS sort_value, CAST(NULL AS VARCHAR) AS name, "
            f"CAST(to_json(struct_pack({key} := {value})) AS VARCHAR) AS record FROM flights")


# every row of the nine results: (metric_key, sort_value, name for ties, record)
_RESULT_ROWS = " UNION ALL ".join([
    _scalar_row("total_flights", "COUNT(*)"),
    _scalar_row("total_airlines", "COUNT(DISTINCT airline)"),
    _scalar_row("total_routes", "COUNT(DISTINCT Source || destination)"),
    _scalar_row("avg_price", "ROUND(AVG(Price), 0)"),
    _scalar_row("nonstop_rate", "CAST((2000 * SUM(CASE WHEN Total_stops = 'non-stop' THEN 1 ELSE 0 END) + COUNT(*))"
                " // (2 * COUNT(*)) AS DOUBLE) / 10"),
    f"""SELECT * FROM (SELECT 'busiest_route', CAST(COUNT(*) AS DOUBLE) AS v, {_OD} AS n,
          CAST(to_json(struct_pack(od_route := {_OD}, flights := COUNT(*))) AS VARCHAR)
        FROM flights GROUP BY {_OD} ORDER BY v DESC, n NULLS LAST LIMIT 1)""",
    """SELECT * FROM (SELECT 'busiest_airport', CAST(COUNT(*) AS DOUBLE) AS v, Source AS n,
          CAST(to_json(struct_pack(airport := Source, flights := COUNT(*))) AS VARCHAR)
        FROM flights GROUP BY Source ORDER BY v DESC, n NULLS LAST LIMIT 1)""",
    """SELECT 'avg_price_by_airline', ROUND(AVG(Price), 0), airline,
          CAST(to_json(struct_pack(airline := airline, avg_price := ROUND(AVG(Price), 0))) AS VARCHAR)
        FROM flights GROUP BY airline""",
    f"""SELECT 'cheapest_flight_by_route', -CAST(MIN(Price) AS DOUBLE), {_OD},
          CAST(to_json(struct_pack(od_route := {_OD}, cheapest_price := MIN(Price))) AS VARCHAR)
        FROM flights GROUP BY {_OD}"""])


ORACLE: dict[str, str] = {
    "metric_total_flights": "SELECT COUNT(*) AS total_flights FROM flights",
    "metric_total_airlines": "SELECT COUNT(DISTINCT airline) AS total_airlines FROM flights",
    "metric_total_routes": "SELECT COUNT(DISTINCT Source || destination) AS total_routes FROM flights",
    "metric_avg_price": "SELECT ROUND(AVG(Price), 0) AS avg_price FROM flights",
    # exact half-up rounding to one decimal in integer arithmetic
    "metric_nonstop_rate": """SELECT CAST((2000 * SUM(CASE WHEN Total_stops = 'non-stop' THEN 1 ELSE 0 END) + COUNT(*))
                // (2 * COUNT(*)) AS DOUBLE) / 10 AS nonstop_rate FROM flights""",
    "metric_busiest_route": f"""SELECT {_OD} AS od_route, COUNT(*) AS flights FROM flights
        GROUP BY {_OD} ORDER BY flights DESC, od_route LIMIT 1""",
    "metric_busiest_airport": """SELECT Source AS airport, COUNT(*) AS flights FROM flights
        GROUP BY Source ORDER BY flights DESC, airport LIMIT 1""",
    "metric_avg_price_by_airline": """SELECT airline, ROUND(AVG(Price), 0) AS avg_price FROM flights
        GROUP BY airline ORDER BY avg_price DESC, airline""",
    "metric_cheapest_by_route": f"""SELECT {_OD} AS od_route, MIN(Price) AS cheapest_price FROM flights
        GROUP BY {_OD} ORDER BY cheapest_price, od_route""",
    "kpi_bundle": """SELECT COUNT(*) AS total_flights, COUNT(DISTINCT airline) AS total_airlines,
        COUNT(DISTINCT Source || destination) AS total_routes, ROUND(AVG(Price), 0) AS avg_price FROM flights""",
    "kpi_labels": """, k AS (SELECT COUNT(*) AS tf, COUNT(DISTINCT airline) AS ta,
            COUNT(DISTINCT Source || destination) AS tr, ROUND(AVG(Price), 0) AS ap FROM flights)
        SELECT 'Total Flights' AS label, CAST(tf AS VARCHAR) AS value FROM k
        UNION ALL SELECT 'Total Airlines', CAST(ta AS VARCHAR) FROM k
        UNION ALL SELECT 'Total Routes', CAST(tr AS VARCHAR) FROM k
        UNION ALL SELECT 'Avg Price', '₹' || CAST(ap AS VARCHAR) FROM k""",
    "home_counts": """SELECT COUNT(*) AS total_records, COUNT(DISTINCT airline) AS airlines_covered,
        COUNT(DISTINCT Source || destination) AS unique_routes,
        (SELECT COUNT(*) FROM (SELECT DISTINCT Source FROM flights)) AS cities_covered FROM flights""",
    "freq_airline": "SELECT airline, COUNT(*) AS flights FROM flights GROUP BY airline",
    "freq_airline_share": """SELECT airline, COUNT(*) AS flights,
        COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM flights GROUP BY airline""",
    "freq_airport": "SELECT Source AS airport, COUNT(*) AS flights FROM flights GROUP BY Source ORDER BY flights DESC",
    "freq_month": """SELECT strftime(date_of_journey, '%Y-%m') AS month, COUNT(*) AS flights
        FROM flights GROUP BY month ORDER BY month""",
    "freq_year": """SELECT CAST(year(date_of_journey) AS INTEGER) AS year, COUNT(*) AS flights
        FROM flights GROUP BY 1 ORDER BY 1""",
    "top_routes": """SELECT Source || ' → ' || destination AS od_route, COUNT(*) AS flights FROM flights
        GROUP BY Source || ' → ' || destination ORDER BY flights DESC, od_route LIMIT 10""",
    "avg_price_airline_chart": """SELECT airline, ROUND(AVG(Price), 0) AS avg_price FROM flights
        GROUP BY airline ORDER BY AVG(Price) DESC""",
    "od_route": f"SELECT DISTINCT Source, destination, {_OD} AS od_route FROM flights",
    "dashboard_feeds": """, keyed AS (
            SELECT airline AS k1, Source AS k2, strftime(date_of_journey, '%Y-%m') AS k3,
                   CAST(year(date_of_journey) AS VARCHAR) AS k4, Source || ' → ' || destination AS k5,
                   Source || destination AS k6, Price FROM flights)
        SELECT CASE GROUPING(k1, k2, k3, k4, k5, k6)
                 WHEN 31 THEN 'airline' WHEN 47 THEN 'airport' WHEN 55 THEN 'month'
                 WHEN 59 THEN 'year' WHEN 61 THEN 'od_route' WHEN 62 THEN 'pair_route' ELSE 'all' END AS feed,
               COALESCE(k1, k2, k3, k4, k5, k6) AS key, COUNT(*) AS flights,
               CAST(SUM(Price) AS BIGINT) AS price_sum, COUNT(Price) AS price_n
        FROM keyed GROUP BY GROUPING SETS ((k1), (k2), (k3), (k4), (k5), (k6), ())""",
    "flight_search": f"SELECT {_SEARCH_COLS} FROM flights WHERE {_ROUTE_WHERE} ORDER BY Price",
    "flight_search_by_duration": f"SELECT {_SEARCH_COLS} FROM flights WHERE {_ROUTE_WHERE} ORDER BY {DURATION_SQL}",
    "flight_search_by_duration_text": f"SELECT {_SEARCH_COLS} FROM flights WHERE {_ROUTE_WHERE} ORDER BY Duration",
    "flight_search_sql": f"SELECT {_SEARCH_COLS} FROM flights WHERE {_ROUTE_WHERE}",
    "flight_search_airlines": f"""SELECT {_SEARCH_COLS} FROM flights
        WHERE {_ROUTE_WHERE} AND airline IN ({_AIRLINES_IN})""",
    "flight_search_airline_table": f"""SELECT {_SEARCH_COLS} FROM flights
        WHERE {_ROUTE_WHERE} AND airline IN (SELECT p_brand FROM part WHERE p_size > 45)""",
    "flight_search_cheapest": f""", r AS (SELECT {_SEARCH_COLS} FROM flights
            WHERE {_ROUTE_WHERE} AND airline IN ({_AIRLINES_IN}))
        SELECT *, COALESCE(Price = (SELECT MIN(Price) FROM r), false) AS is_cheapest,
               CASE WHEN Price = (SELECT MIN(Price) FROM r) THEN '#d4edda' ELSE '' END AS highlight
        FROM r ORDER BY Price""",
    "search_summary": f"""SELECT COUNT(*) AS flights_found, MIN(Price) AS cheapest_price,
        CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) AS VARCHAR) || ' flights found | Cheapest: ₹' || CAST(MIN(Price) AS VARCHAR)
             ELSE 'No flights found for this route!' END AS banner
        FROM flights WHERE {_ROUTE_WHERE}""",
    "search_summary_empty": f"""SELECT COUNT(*) AS flights_found, MIN(Price) AS cheapest_price,
        'No flights found for this route!' AS banner
        FROM flights WHERE Source = '{SEARCH_SOURCE}' AND destination = '{SEARCH_SOURCE}_'""",
    "search_airlines": f"SELECT DISTINCT airline AS Airline FROM flights WHERE {_ROUTE_WHERE}",
    "distinct_cities": """SELECT DISTINCT 'source' AS side, Source AS city FROM flights
        UNION ALL SELECT DISTINCT 'destination', destination FROM flights""",
    "parse_duration": f"SELECT Duration, {DURATION_SQL} AS duration_minutes FROM flights",
    "parse_stops": f"SELECT Total_stops, {STOPS_SQL} AS stops_num FROM flights",
    "outlier_clean": OUTLIER_CTES + """
        SELECT Airline, Route, Price, Duration, Total_stops, duration_minutes, stops_num FROM clean""",
    "outlier_route_stats": OUTLIER_CTES + f"""
        SELECT Route, {_r4('price_mean')}, {_r4('price_std')}, {_r4('duration_mean')}, {_r4('duration_std')},
               {_r4('stops_mean')}, {_r4('stops_std')}, route_size FROM stats""",
    "outlier_merged_stats": OUTLIER_CTES + f"""
        SELECT Route, {_r4('price_mean')}, {_r4('price_std')}, {_r4('duration_mean')}, {_r4('duration_std')},
               {_r4('stops_mean')}, {_r4('stops_std')}, route_size FROM stats""",
    "outlier_zscores": OUTLIER_CTES + f"""
        SELECT Airline, Route, Price, duration_minutes, stops_num, route_size,
               {_r4('price_z')}, {_r4('duration_z')}, {_r4('stops_z')} FROM z""",
    "outlier_flags": OUTLIER_CTES + f"""
        SELECT Airline, Route, Price, duration_minutes, stops_num, price_flag, duration_flag, stops_flag,
               severity_score, Severity, {_r4('max_abs_z')} FROM flagged""",
    "outlier_report": OUTLIER_CTES + """
        SELECT Airline, Route, Price, CAST(round_even(duration_minutes, 0) AS INTEGER) AS duration_min,
               CAST(round_even(CAST(stops_num AS DOUBLE), 0) AS INTEGER) AS stops, Severity,
               round_even(price_z, 2) AS price_z, round_even(duration_z, 2) AS duration_z,
               round_even(stops_z, 2) AS stops_z, explanation, highlight
        FROM flagged
        ORDER BY severity_score DESC, max_abs_z DESC, Airline, Route, Price, duration_minutes, stops_num,
                 Duration, Total_stops
        LIMIT 8""",
    "outlier_severity_counts": OUTLIER_CTES + """
        SELECT COUNT(*) AS flagged_total,
               COUNT(*) FILTER (WHERE severity_score = 1) AS low,
               COUNT(*) FILTER (WHERE severity_score = 2) AS medium,
               COUNT(*) FILTER (WHERE severity_score = 3) AS high,
               least(COUNT(*), 8) AS reported
        FROM flagged""",
    "outlier_narrative": OUTLIER_CTES + """
        SELECT Airline, Route, Price, Severity, explanation FROM flagged""",
    "question_metric_match": f""", questions AS (
            SELECT 'flight' AS origin, {_fill_sql(QUESTION_TEMPLATES)} AS question FROM flights
            UNION ALL
            SELECT 'conversation', text FROM conversations WHERE role = 'user')
        SELECT origin, question, {_match_sql('first')} AS metric_first,
               {_match_sql('longest')} AS metric_longest FROM questions""",
    "question_answers": f""", questions AS (
            SELECT 'flight' AS origin, {_fill_sql(QUESTION_TEMPLATES)} AS question FROM flights
            UNION ALL
            SELECT 'conversation', text FROM conversations WHERE role = 'user'),
        matched AS (SELECT origin, question, {_match_sql('first')} AS metric_first FROM questions),
        rows AS ({_RESULT_ROWS}),
        ranked AS (SELECT metric_key, record, row_number() OVER (PARTITION BY metric_key ORDER BY sort_value DESC NULLS LAST,
                     name NULLS LAST) AS rn FROM rows),
        answers AS (SELECT metric_key, COUNT(*) AS row_count,
                      '[' || string_agg(record, ',' ORDER BY rn) FILTER (WHERE rn <= 20) || ']' AS sample
                    FROM ranked GROUP BY metric_key)
        SELECT m.origin, m.question, m.metric_first, a.row_count, a.sample
        FROM matched m LEFT JOIN answers a ON m.metric_first = a.metric_key""",
    "governed_rows": f""", rows AS ({_RESULT_ROWS}) SELECT metric_key, sort_value, record FROM rows""",
    "governed_rows_sql": f""", rows AS ({_RESULT_ROWS}) SELECT metric_key, sort_value, record FROM rows""",
    "metric_slice_sql": """SELECT airline, ROUND(AVG(Price), 0) AS avg_price FROM flights
        WHERE Source = 'NATION_5' AND destination = 'NATION_13' GROUP BY airline""",
    "query_log_screen": f"""SELECT {_fill_sql(SQL_TEMPLATES)} AS sql_text, {_verdict_sql(1)} AS safe_compat,
               {_verdict_sql(2)} AS safe_strict FROM flights""",
    "result_sample_json": """, r AS (SELECT airline, ROUND(AVG(Price), 0) AS avg_price FROM flights
            GROUP BY airline ORDER BY avg_price DESC, airline LIMIT 20)
        SELECT CAST(row_number() OVER (ORDER BY avg_price DESC, airline) AS INTEGER) AS rn,
               CAST(to_json(struct_pack(airline := airline, avg_price := avg_price)) AS VARCHAR) AS record FROM r""",
    "result_chart_kind": f""",
        c AS (
          SELECT 'busiest_route' AS metric_key, (SELECT COUNT(*) FROM (SELECT {_OD} AS r, COUNT(*) AS n FROM flights
                GROUP BY 1 ORDER BY n DESC, r LIMIT 1)) AS n
          UNION ALL SELECT 'busiest_airport', (SELECT COUNT(*) FROM (SELECT Source, COUNT(*) AS n FROM flights
                GROUP BY 1 ORDER BY n DESC, Source LIMIT 1))
          UNION ALL SELECT 'avg_price_by_airline', (SELECT COUNT(*) FROM (SELECT DISTINCT airline FROM flights))
          UNION ALL SELECT 'cheapest_flight_by_route', (SELECT COUNT(*) FROM (SELECT DISTINCT {_OD} FROM flights)))
        SELECT metric_key, CASE WHEN n = 0 THEN 'none' WHEN n <= 15 THEN 'bar' ELSE 'line' END AS chart_kind FROM c
        UNION ALL SELECT k, 'none' FROM (VALUES ('total_flights'), ('total_airlines'), ('total_routes'),
                                                ('avg_price'), ('nonstop_rate')) t(k)""",
}


def oracle(name: str) -> str:
    """The complete oracle statement for ``name`` (fare-table CTE + query)."""
    body = ORACLE[name]
    if body.lstrip().startswith(","):
        return FLIGHTS_CTE + body
    return FLIGHTS_CTE + "\n" + body
