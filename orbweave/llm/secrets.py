"""Secrets by fixed shapes and by the entropy of sliding windows.

Candidate strings are runs of the characters that keys are written in.  Each gets a
character class; a window of ``WINDOW`` characters slides over it while the counts of its
characters, and with them the sum of c * log2(c), are updated for the one that enters and
the one that leaves.  A string is a secret when a window's entropy reaches the class's
limit and no allow-list entry suppresses it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import cut_by, documents_of, let, sums_before

#: The shapes of the base kinds.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]
#: The characters of candidates; a window counts them by their place here.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: The entropy in bits that a window must reach, by class.  Words (letters alone) never do.
LIMITS = {"hex": 2.8, "alnum": 3.6, "symbols": 3.8}
UNIT = 1_000_000
#: Strings that look random and are not.
ALLOWED = [
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[A-Za-z][A-Za-z_/+=-]*$",
    r"(?i)example|placeholder|changeme|sample",
    r"(?i)abcdefghijkl|0123456789abcdef",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
]


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, said>> of the matches, left to right, in code points."""
    before, found = cut_by(text, pattern)
    length = lambda a: F.transform(a, F.length)

    def of(c: Column) -> Column:
        each = F.zip_with(length(c["before"]), length(c["found"]), lambda b, f: b + f)

        def placed(last: Column) -> Column:
            def one(said: Column, i: Column) -> Column:
                begin = F.get(last, i) + F.length(F.get(c["before"], i))
                return F.struct(begin.alias("start"), (begin + F.length(said)).alias("end"), said.alias("said"))

            return F.transform(c["found"], one)

        return let(sums_before(each), placed)

    return let(F.struct(before.alias("before"), found.alias("found")), of)


def character_class(x: Column) -> Column:
    return F.when(x.rlike("^[0-9a-fA-F]+$"), "hex").when(x.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("symbols")


def lowest_window_sum(x: Column) -> Column:
    """The least sum of c * log2(c), in millionths, over the windows of a candidate.

    The entropy of that window is log2(WINDOW) minus the sum over WINDOW: the highest."""
    table = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(WINDOW + 1)])
    codes = F.transform(F.split(x, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    nothing = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    start = F.struct(nothing.alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(1 << 60).cast("long").alias("least"))

    def over(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
            change = lambda c: F.get(table, c)

            def updated(io: Column) -> Column:
                e, o = io["e"], io["o"]
                n_in = F.get(s["counts"], e)
                n_out = F.get(s["counts"], o)
                total = F.when(
                    e == o, s["total"]
                ).otherwise(
                    s["total"] + change(n_in + 1) - change(n_in) + F.when(o >= 0, change(n_out - 1) - change(n_out)).otherwise(F.lit(0))
                )
                counts = F.transform(s["counts"], lambda c, k: c + F.when(k == e, 1).otherwise(0) - F.when(k == o, 1).otherwise(0))
                return let(
                    total,
                    lambda t: F.struct(counts.alias("counts"), t.alias("total"), F.when(i >= WINDOW - 1, F.least(s["least"], t)).otherwise(s["least"]).alias("least")),
                )

            return let(F.struct(enters.alias("e"), leaves.alias("o")), updated)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["least"])

    return let(codes, over)


def looks_random(x: Column) -> Column:
    """Whether a window of the candidate reaches its class's entropy and nothing allows it."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | x.rlike(pattern)
    most = lambda bits: int((math.log2(WINDOW) - bits) * WINDOW * UNIT)
    kind = character_class(x)
    limit = F.when(kind == "hex", most(LIMITS["hex"])).when(kind == "alnum", most(LIMITS["alnum"])).otherwise(most(LIMITS["symbols"]))
    return F.when(allowed, False).otherwise(lowest_window_sum(x) <= limit)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array<struct<start, kind, end, said>> by start, then kind.

    ``kind`` counts in KINDS; start and end are code points, end exclusive.  One row per
    row of ``docs``; null and empty texts have no spans.  Repeated rows and null ids are
    rows like any other; further columns are ignored.
    """
    rows = docs.transform(documents_of, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    named = lambda a, k: F.transform(a, lambda p: F.struct(p["start"].alias("start"), F.lit(k).alias("kind"), p["end"].alias("end"), p["said"].alias("said")))
    value = lambda p: F.regexp_extract(p["said"], ASSIGN_VALUE, 1)
    return rows.select(
        "doc_id",
        named(F.filter(places(text, ASSIGN), lambda p: F.length(value(p)) >= 6), 0).alias("a"),
        named(places(text, ACCESS), 1).alias("b"),
        named(places(text, HEX), 2).alias("c"),
        named(F.filter(places(text, CANDIDATE), lambda p: looks_random(p["said"])), 3).alias("d"),
    ).select("doc_id", F.array_sort(F.concat("a", "b", "c", "d")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(n) for n in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
