"""Column names and the fixed schema of a fare table.

One row per trip. ``Duration`` and ``Total_stops`` arrive as text and are
parsed by :mod:`farelens.functions.parsing`. Clock times stay text
(``HH:mm:ss``) because Spark's TIME type is not enabled by default.
"""

from __future__ import annotations

from pyspark.sql import types as T

AIRLINE = "airline"
DATE = "date_of_journey"
SOURCE = "Source"
DESTINATION = "destination"
ROUTE = "route"            # the stored route text; outliers group by this
DEP_TIME = "dep_time"
ARRIVAL_TIME = "Arrival_time"
DURATION = "Duration"
STOPS = "Total_stops"
PRICE = "Price"

# Source + destination built on the fly; never named ``route`` so it cannot
# be confused with the stored column of that name.
OD_ROUTE = "od_route"

FLIGHTS = T.StructType([
    T.StructField(AIRLINE, T.StringType()),
    T.StructField(DATE, T.DateType()),
    T.StructField(SOURCE, T.StringType()),
    T.StructField(DESTINATION, T.StringType()),
    T.StructField(ROUTE, T.StringType()),
    T.StructField(DEP_TIME, T.StringType()),
    T.StructField(ARRIVAL_TIME, T.StringType()),
    T.StructField(DURATION, T.StringType()),
    T.StructField(STOPS, T.StringType()),
    T.StructField(PRICE, T.IntegerType()),
])

FLIGHT_COLUMNS = [f.name for f in FLIGHTS.fields]

# Outlier input: the five columns the detector reads, under their report names.
OUTLIER_INPUT = T.StructType([
    T.StructField("Airline", T.StringType()),
    T.StructField("Route", T.StringType()),
    T.StructField("Price", T.IntegerType()),
    T.StructField("Duration", T.StringType()),
    T.StructField("Total_stops", T.StringType()),
])
