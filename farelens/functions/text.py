"""Small text builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farelens import schema as S

# Route separators and the currency sign used in labels.
ARROW_ASCII = " -> "
ARROW_UNICODE = " → "
RUPEE = "₹"


def od_route(sep: str = ARROW_ASCII, source: str = S.SOURCE,
             destination: str = S.DESTINATION) -> Column:
    """Origin-destination label. ``concat`` (not ``concat_ws``) so a NULL end
    gives a NULL label, as SQL CONCAT does."""
    return F.concat(F.col(source), F.lit(sep), F.col(destination))


def pair_route(source: str = S.SOURCE, destination: str = S.DESTINATION) -> Column:
    """The two ends glued with no separator (the governed route count uses
    this; ('A','BC') and ('AB','C') collide by definition)."""
    return F.concat(F.col(source), F.col(destination))


def currency(c: Column) -> Column:
    """``<rupee sign><value as text>``."""
    return F.concat(F.lit(RUPEE), c.cast("string"))


def half_even_text(c: Column, digits: int) -> Column:
    """Fixed-point text rounded half to even (Python's ``:.Nf``); Java's
    ``%.Nf`` alone would round half up."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits))
