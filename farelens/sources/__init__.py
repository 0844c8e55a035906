"""Readers for fare tables and the star-schema derivation used by the checks."""

from farelens.sources.flights import (
    flights_from_star,
    flights_table,
    ingest_flights,
    jdbc_partitions,
    load_flights,
    materialize,
    register_view,
)

__all__ = ["flights_from_star", "flights_table", "ingest_flights", "jdbc_partitions",
           "load_flights", "materialize", "register_view"]
