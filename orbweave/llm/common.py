"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.store import Scratch, settled

__all__ = ["Scratch", "settled", "documents_of", "let", "space_words", "cut_by", "sums_before", "parts"]

#: The bytes that separate words (space, tab to carriage return).
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text of each row, as ``doc_id`` and ``text``."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable, not a copy)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def space_words(text: Column) -> Column:
    """The words of a text: its longest runs without ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), "")


def cut_by(text: Column, pattern: str) -> tuple[Column, Column]:
    """For each match of ``pattern``: the text between it and the last one, and the match.

    ``pattern`` has no capturing groups.  Both arrays are empty where nothing matches.
    """
    both = rf"(?s)\G(.*?)({pattern})"  # \G: without it, the rest after the last match is tried from each place
    none = F.array().cast("array<string>")
    found = text.rlike(pattern)
    return (
        F.when(found, F.regexp_extract_all(text, F.lit(both), 1)).otherwise(none),
        F.when(found, F.regexp_extract_all(text, F.lit(both), 2)).otherwise(none),
    )


def sums_before(lengths: Column) -> Column:
    """For each place of an array of integers, the sum of all before it.

    Summed by blocks of about the root of the array's size, so that n numbers cost n ** 1.5
    additions: an aggregate that appends to an array would copy it each time."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def of(a: Column) -> Column:
        def by_block(k: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / k).cast("int")), lambda c: total(F.slice(a, c * k + 1, k)))
            upto = let(blocks, lambda b: F.transform(b, lambda _, c: total(F.slice(b, F.lit(1), c))))
            block = lambda i: F.floor(i / k).cast("int")
            return let(upto, lambda u: F.transform(a, lambda _, i: F.get(u, block(i)) + total(F.slice(a, block(i) * k + 1, i - block(i) * k))))

        return F.when(F.size(a) > 0, let(F.ceil(F.sqrt(F.size(a))).cast("int"), by_block)).otherwise(F.array().cast("array<int>"))

    return let(lengths, of)


def parts(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch by parts of at most ``rows`` rows and ``size`` bytes of its second column, or of one row."""
    lo = held = 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
        if k > lo and (k - lo == rows or held + n > size):
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += n
    if batch.num_rows:
        yield batch.slice(lo)
