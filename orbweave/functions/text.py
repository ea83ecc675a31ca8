"""Texts as code points and runs, hashes of content."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def code_points(text: Column) -> Column:
    """array<int>; an empty text has none."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def shortened(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def seed_hash(kind: Column, value: Column) -> Column:
    """Hash of a constant: its kind and all 64 bits of its value."""
    return F.sha2(F.concat_ws(":", kind.cast("string"), value.cast("string")), 256)


def composition_hash(children: Column) -> Column:
    """Hash of an ordered array of struct(hash, multiplicity); order and multiplicity count."""
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws("*", c["hash"], c["multiplicity"].cast("string"))), "|"), 256)


def run_strings(text: Column) -> Column:
    """array<string>: the runs of equal code points of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(.)\1*+"), F.lit(0))


@lru_cache(1 << 16)
def code_hash(code: int, kind: int = 0) -> str:
    """The same as :func:`seed_hash`."""
    return hashlib.sha256(f"{kind}:{code}".encode()).hexdigest()


def hash_of_names(names: list[bytes], at: np.ndarray) -> str:
    """SHA-256 of the names at ``at``, one after the other, in pieces."""
    digest = hashlib.sha256()
    for lo in range(0, len(at), 1 << 16):
        digest.update((b"|" if lo else b"") + b"|".join([names[i] for i in at[lo : lo + (1 << 16)].tolist()]))
    return digest.hexdigest()


def hash_of_text(text: str) -> tuple[str, int, str]:
    """The :func:`composition_hash` of a text's runs, their number, and the distinct characters.

    A run is named once however often it comes, and the names are hashed in pieces, so a
    long text needs no copy of all of them."""
    if not text:
        return hashlib.sha256().hexdigest(), 0, ""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    runs_, at = np.unique(codes[starts] << 32 | np.diff(starts, append=len(codes)), return_inverse=True)
    names = [f"{code_hash(r >> 32)}*{r & 0xFFFFFFFF}".encode() for r in runs_.tolist()]
    return hash_of_names(names, at), len(starts), "".join(map(chr, dict.fromkeys((runs_ >> 32).tolist())))


@F.pandas_udf(StructType([StructField("hash", StringType()), StructField("children", IntegerType()), StructField("characters", StringType())]))
def text_hash(text: pd.Series) -> pd.DataFrame:
    """(hash, children, characters): the composition that a text's runs make, how many they are, and its distinct characters."""
    return pd.DataFrame([hash_of_text(t) for t in text], columns=["hash", "children", "characters"])


def typed_composition_hash(children: Column, kind: Column) -> Column:
    """Hash of a composition of one kind; each of struct(hash, multiplicity, is_constant) counts with its own kind."""
    tags = F.array_join(F.transform(children, lambda c: F.when(c["is_constant"], "1").otherwise("0")), "")
    return F.sha2(F.concat_ws(":", composition_hash(children), tags, kind.cast("string")), 256)


def bytes_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def first_difference(a: Column, b: Column) -> Column:
    """The first place (from 0) at which two texts differ, null where they are equal.

    Found by halving: a prefix of the least differing length is looked for in 31 steps."""
    short = F.least(F.length(a), F.length(b))

    def step(s: Column, _: Column) -> Column:
        half = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), half) == F.substring(b, F.lit(1), half)
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(same, half).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(half - 1).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), short.cast("int").alias("hi"))
    return F.when(a != b, F.aggregate(F.sequence(F.lit(0), F.lit(31)), start, step, lambda s: s["lo"]))


def json_escaped(text: Column) -> Column:
    """A text as a JSON string, quotes included."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def run_array(codes: Column) -> Column:
    """array<struct<value, multiplicity>> of an array."""
    at = F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: (i == 0) | (F.get(codes, i) != F.get(codes, i - 1)))
    told = lambda starts: F.transform(starts, lambda s, k: F.struct(F.get(codes, s).cast("long").alias("value"), (F.coalesce(F.get(starts, k + 1), F.size(codes)) - s).cast("long").alias("multiplicity")))
    return F.when(F.size(codes) > 0, F.element_at(F.transform(F.array(at), told), 1)).otherwise(F.array().cast("array<struct<value:bigint,multiplicity:bigint>>"))


def runs(values: DataFrame, key: str = "doc_id", array: str = "codes") -> DataFrame:
    """Run-length encoding of each row's array: (key, position, value, multiplicity).

    It stays within the row: the starts of runs are the places that differ from the one
    before, so nothing is shuffled and a long text is no group."""
    a = F.col(array)
    marked = values.select(key, array, F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1))).alias("starts")).where(F.size(a) > 0)
    each = marked.select(
        key,
        F.posexplode_outer(F.transform("starts", lambda s, k: F.struct(F.get(a, s).alias("value"), (F.coalesce(F.get("starts", k + 1), F.size(a)) - s).alias("multiplicity")))).alias("position", "run"),
    )
    return each.where("position is not null").select(key, "position", F.col("run.value").cast("long").alias("value"), F.col("run.multiplicity").cast("long").alias("multiplicity"))
