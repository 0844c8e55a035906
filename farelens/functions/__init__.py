"""Column-level functions (``Column -> Column``), all built-in Spark expressions."""

from farelens.functions.parsing import duration_minutes, stops_num
from farelens.functions.text import currency, od_route, pair_route

__all__ = ["duration_minutes", "stops_num", "od_route", "pair_route", "currency"]
