"""The 128-bit space-filling curve over quantized points, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from orbweave.functions.geometry import quantized

_WORDS = StructType([StructField(n, LongType()) for n in ("high", "low")])
_ORDINATES = StructType([StructField(n, DoubleType()) for n in "xyzm"])


def _walk(n: int):
    """Rotation state of n points: the axis in each slot, and the flipped slots."""
    return np.tile(np.arange(4), (n, 1)), np.zeros(n, np.uint64)


def _turn(g: np.ndarray, axes: np.ndarray, flip: np.ndarray) -> np.ndarray:
    moved = (g != 0) & (g != 15)
    top = np.where(g >= 8, 3, np.where(g >= 4, 2, np.where(g >= 2, 1, 0)))
    rows = np.flatnonzero(moved)
    first = axes[rows, 0].copy()
    flip = flip.copy()
    flip[rows] ^= np.uint64(1) << first.astype(np.uint64)
    axes[rows, 0] = axes[rows, top[rows]]
    axes[rows, top[rows]] = first
    return flip


def encode(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low words of points of four 32-bit ordinates (n x 4, uint64)."""
    n = len(q)
    axes, flip = _walk(n)
    words = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    rows = np.arange(n)
    for bit in range(31, -1, -1):
        bits = np.zeros(n, np.uint64)
        for slot in range(4):
            bits |= (q[rows, axes[:, slot]] >> np.uint64(bit) & np.uint64(1)) << np.uint64(slot)
        bits ^= flip
        g = bits ^ (bits >> np.uint64(1))
        words[bit < 16] |= g << np.uint64(4 * (bit % 16))
        flip = _turn(g, axes, flip)
    return words[0], words[1]


def decode(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The ordinates of curve indexes."""
    n = len(high)
    axes, flip = _walk(n)
    q = np.zeros((n, 4), np.uint64)
    rows = np.arange(n)
    for bit in range(31, -1, -1):
        g = ((high if bit >= 16 else low) >> np.uint64(4 * (bit % 16))) & np.uint64(15)
        bits = g ^ (g >> np.uint64(2))
        bits = (bits ^ (bits >> np.uint64(1))) ^ flip
        for slot in range(4):
            q[rows, axes[:, slot]] |= ((bits >> np.uint64(slot)) & np.uint64(1)) << np.uint64(bit)
        flip = _turn(g, axes, flip)
    return q


#: Fixed value: slots 0 to 3 hold axes 0 to 3, two bits each.
_AXES_AT_START = 0b11100100


def curve_key(x: Column, y: Column, z: Column, m: Column) -> Column:
    """struct(high, low), as :func:`curve_of` gives, from built-in functions alone.

    The state of a round is the axes in their slots, packed, the flipped slots and the words."""
    shift = lambda name, v, n: F.call_function(name, v, n)
    once = lambda v, body: F.element_at(F.transform(F.array(v), body), 1)

    def of(q: Column) -> Column:
        def step(s: Column, bit: Column) -> Column:
            def slot(d: int) -> Column:
                axis = F.shiftright(s["axes"], 2 * d).bitwiseAND(F.lit(3))
                return F.shiftleft(shift("shiftright", F.get(q, axis), bit).bitwiseAND(F.lit(1)).cast("int"), d)

            def turned(g: Column) -> Column:
                top = F.when(g >= 8, 3).when(g >= 4, 2).when(g >= 2, 1).otherwise(0)
                first = s["axes"].bitwiseAND(F.lit(3))
                at = 2 * top
                other = shift("shiftright", s["axes"], at).bitwiseAND(F.lit(3))
                swapped = s["axes"].bitwiseXOR(first.bitwiseXOR(other)).bitwiseXOR(shift("shiftleft", first.bitwiseXOR(other), at))
                moves = (g != 0) & (g != 15)
                word = lambda name, here: F.when(here, F.shiftleft(s[name], 4).bitwiseOR(g.cast("long"))).otherwise(s[name]).alias(name)
                return F.struct(
                    F.when(moves & (top > 0), swapped).otherwise(s["axes"]).alias("axes"),
                    F.when(moves, s["flip"].bitwiseXOR(shift("shiftleft", F.lit(1), first))).otherwise(s["flip"]).alias("flip"),
                    word("high", bit >= 16),
                    word("low", bit < 16),
                )

            bits = slot(0).bitwiseOR(slot(1)).bitwiseOR(slot(2)).bitwiseOR(slot(3)).bitwiseXOR(s["flip"])
            return once(once(bits, lambda b: b.bitwiseXOR(F.shiftright(b, 1))), turned)

        start = F.struct(F.lit(_AXES_AT_START).alias("axes"), F.lit(0).alias("flip"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
        return F.aggregate(F.sequence(F.lit(31), F.lit(0)), start, step, lambda s: F.struct(s["high"], s["low"]))

    return once(F.array(*[quantized(F.nanvl(c.cast("double"), F.lit(0.0))) for c in (x, y, z, m)]), of)


def low_word_distance(a: Column, b: Column) -> Column:
    """Distance of two positions on the curve by their low words alone, as decimal(20,0)."""
    wide = lambda w: w.cast("decimal(20,0)") + F.when(w < 0, F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    return F.abs(wide(a["low"]) - wide(b["low"])).cast("decimal(20,0)")


def keyed(points: DataFrame) -> DataFrame:
    """``points`` with hk and lk, their places on the curve as signed keys in unsigned order."""
    k = points.withColumn("__k__", curve_key(*[F.col(c) for c in "xyzm"]))
    return k.withColumn("hk", unsigned(F.col("__k__.high"))).withColumn("lk", unsigned(F.col("__k__.low"))).drop("__k__")


def save_keyed(points: DataFrame, path: str) -> None:
    """Points with their keys, written in order of the curve: a range of keys then reads few files."""
    keyed(points).repartitionByRange("hk", "lk").sortWithinPartitions("hk", "lk", "id").write.mode("overwrite").parquet(path)


@F.pandas_udf(_WORDS)
def _curve(x: pd.Series, y: pd.Series, z: pd.Series, m: pd.Series) -> pd.DataFrame:
    v = np.stack([s.to_numpy(np.float64) for s in (x, y, z, m)], 1)
    q = np.floor(np.clip((np.nan_to_num(v) + 1) / 2, 0, 1) * 4294967295.0 + 0.5).astype(np.uint64)
    high, low = encode(q)
    return pd.DataFrame({"high": high.view(np.int64), "low": low.view(np.int64)})


@F.pandas_udf(_ORDINATES)
def _point(high: pd.Series, low: pd.Series) -> pd.DataFrame:
    q = decode(high.to_numpy(np.int64).view(np.uint64), low.to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame(q / 4294967295.0 * 2 - 1, columns=["x", "y", "z", "m"])


def curve_of(x: Column, y: Column, z: Column, m: Column) -> Column:
    """struct(high, low): raw 64-bit words; order by :func:`unsigned` of them."""
    return _curve(x, y, z, m)


def point_of(high: Column, low: Column) -> Column:
    """struct(x, y, z, m)."""
    return _point(high, low)


def unsigned(word: Column) -> Column:
    """A key that orders 64-bit words as unsigned numbers."""
    return word.bitwiseXOR(F.lit(-(1 << 63)))
