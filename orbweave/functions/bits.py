"""Numbers as bits and back, samples and fixed points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType


@F.pandas_udf(IntegerType())
def float_bits(v: pd.Series) -> pd.Series:
    """The 32 bits of a float."""
    return pd.Series(v.to_numpy(np.float32).view(np.int32))


@F.pandas_udf(LongType())
def double_bits(v: pd.Series) -> pd.Series:
    """The 64 bits of a double."""
    return pd.Series(v.to_numpy(np.float64).view(np.int64))


@F.pandas_udf(FloatType())
def float_of_bits(bits: pd.Series) -> pd.Series:
    return pd.Series(bits.to_numpy(np.int32).view(np.float32))


@F.pandas_udf(DoubleType())
def double_of_bits(bits: pd.Series) -> pd.Series:
    return pd.Series(bits.to_numpy(np.int64).view(np.float64))


def sample_code(sample: Column) -> Column:
    """A 16-bit sample as a number from 0."""
    return sample.cast("int") + 32768


def sample_of(code: Column) -> Column:
    return (code - 32768).cast("short")


def fixed_rate(fps: Column) -> Column:
    """Frames a second in thousandths."""
    return F.round(fps * 1000).cast("long")


def rate_of(fixed: Column) -> Column:
    return fixed / 1000.0


def epoch_seconds(at: Column) -> Column:
    """Seconds since 1970 of a timestamp, which the caller gives: the clock is not read."""
    return F.unix_timestamp(at)
