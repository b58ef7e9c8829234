"""Number formatting for reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text rounded from the exact binary value.

    The built-in formatter rounds the shortest decimal form half up, which
    differs in the last digit on some values. Reports have few rows, so this
    small vectorised function is enough.
    """

    @F.pandas_udf(T.StringType())
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return text(value)


def exact_mean(value: Column) -> Column:
    """Mean of doubles taken as the decimals they are written as, whatever their order.

    A running sum of doubles depends on the order of rows, which shows where a mean lies
    halfway between two printed digits. Values or sums too large for that, and values that
    are no numbers, give the plain mean.
    """
    number = value.try_cast("decimal(38,15)")
    total = F.when(F.count(number) == F.count(value), F.try_sum(number))
    return F.coalesce(total.cast("double") / F.nullif(F.count(value), F.lit(0)), F.avg(value))
