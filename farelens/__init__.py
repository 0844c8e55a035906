"""farelens: fare and route analytics expressed as Spark DataFrame plans.

Every public operator is ``DataFrame -> DataFrame`` or ``Column -> Column``;
nothing in the package collects data to the driver except the bounded
single-value helpers named as such (``scalar_metric``, ``chart_kind``).
"""

from farelens.session import build_session, scratch_root

__all__ = ["build_session", "scratch_root"]
__version__ = "0.1.0"
