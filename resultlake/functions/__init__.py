"""Scalar functions.  Each module builds expressions; ``col`` makes one a Spark column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPARK


def col(build, *args: str, **how) -> Column:
    """Column of a function of this package over column names, e.g. ``col(urls.host, "url")``."""
    return F.expr(build(SPARK, *args, **how))
