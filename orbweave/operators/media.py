"""Bytes, sound, pictures, films and vectors as runs, and back without loss.

Each is cut into parts (chunks, frames, rows), a part is run-length encoded within its row,
and what tells its shape is kept beside it (``meta``).  Parts come back in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.bits import fixed_rate, sample_code, sample_of
from orbweave.functions.text import run_array


def _unrolled(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["multiplicity"].cast("int"))))


def _cut(codes: Column, size) -> Column:
    """An array in parts of ``size``, the last one shorter."""
    n = F.ceil(F.size(codes) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(codes, (k * size + 1).cast("int"), size if isinstance(size, Column) else F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))


def byte_values(content: Column) -> Column:
    """array<int> of a binary's bytes."""
    return F.transform(F.filter(F.split(F.hex(content), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int"))


def binary_parts(files: DataFrame, size: int = 4096) -> DataFrame:
    """(id, part, runs, meta) of (id, content): chunks of ``size`` bytes; meta is [length].

    Each chunk is cut out before rows are made, so no row carries the whole file.  An empty
    file has one part without runs; a null one has none."""
    n = F.greatest(F.ceil(F.length("content") / size).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("content"), k * size + 1, F.lit(size)))
    cut = files.where("content is not null").select("id", F.array(F.length("content").cast("long")).alias("meta"), F.posexplode(pieces).alias("part", "piece"))
    return cut.select("id", "part", run_array(byte_values(F.col("piece"))).alias("runs"), "meta")


def audio_parts(tracks: DataFrame, size: int = 1024) -> DataFrame:
    """(id, part, runs, meta) of (id, samples, rate, channels, bits): frames of ``size`` samples + 32768."""
    coded = F.transform("samples", sample_code)
    return tracks.select("id", F.array(*[F.col(c).cast("long") for c in ("rate", "channels", "bits")]).alias("meta"), F.posexplode(_cut(coded, size)).alias("part", "codes")).select("id", "part", run_array(F.col("codes")).alias("runs"), "meta")


def image_parts(images: DataFrame) -> DataFrame:
    """(id, part, runs, meta) of (id, width, height, pixels): rows of pixels; meta is [width, height]."""
    rows = _cut(F.col("pixels"), F.col("width").cast("int"))
    return images.select("id", F.array(F.col("width").cast("long"), F.col("height").cast("long")).alias("meta"), F.posexplode(rows).alias("part", "codes")).select("id", "part", run_array(F.col("codes")).alias("runs"), "meta")


def video_parts(films: DataFrame) -> DataFrame:
    """(id, part, runs, meta) of (id, frame, width, height, fps, pixels), one row a frame.

    ``part`` counts rows over all frames; meta is [width, height, fps in thousandths]."""
    rows = _cut(F.col("pixels"), F.col("width").cast("int"))
    cut = films.select("id", "frame", "height", F.array(F.col("width").cast("long"), F.col("height").cast("long"), fixed_rate(F.col("fps"))).alias("meta"), F.posexplode(rows).alias("row", "codes"))
    return cut.select("id", (F.col("frame") * F.col("height") + F.col("row")).cast("int").alias("part"), run_array(F.col("codes")).alias("runs"), "meta")


def _whole(parts: DataFrame) -> DataFrame:
    """(id, meta, codes): the parts of each in order."""
    joined = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "runs"))).alias("parts"), F.first("meta").alias("meta"))
    return joined.select("id", "meta", F.flatten(F.transform("parts", lambda p: _unrolled(p["runs"]))).alias("codes"))


def binary_of(parts: DataFrame) -> DataFrame:
    """(id, content) from :func:`binary_parts`."""
    return _whole(parts).select("id", F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("content"))


def audio_of(parts: DataFrame) -> DataFrame:
    """(id, samples, rate, channels, bits) from :func:`audio_parts`."""
    return _whole(parts).select("id", F.transform("codes", sample_of).alias("samples"), *[F.col("meta")[k].cast("int").alias(c) for k, c in enumerate(("rate", "channels", "bits"))])


def image_of(parts: DataFrame) -> DataFrame:
    """(id, width, height, pixels) from :func:`image_parts`."""
    return _whole(parts).select("id", F.col("meta")[0].cast("int").alias("width"), F.col("meta")[1].cast("int").alias("height"), F.col("codes").alias("pixels"))


def video_of(parts: DataFrame) -> DataFrame:
    """(id, frame, width, height, fps, pixels) from :func:`video_parts`; a frame is a group of its own."""
    framed = parts.withColumn("frame", F.floor(F.col("part") / F.col("meta")[1]).cast("int")).withColumn("of", F.struct("id", "frame"))
    whole = _whole(framed.select(F.col("of").alias("id"), "part", "runs", "meta"))
    return whole.select("id.id", "id.frame", F.col("meta")[0].cast("int").alias("width"), F.col("meta")[1].cast("int").alias("height"), (F.col("meta")[2] / 1000.0).alias("fps"), F.col("codes").alias("pixels"))


def flat(parts: DataFrame) -> DataFrame:
    """(id, part, position, value, multiplicity): one row a run."""
    return parts.select("id", "part", F.posexplode("runs").alias("position", "r")).select("id", "part", "position", "r.value", "r.multiplicity")


def vector_cells(vectors: DataFrame) -> DataFrame:
    """(id, position, value) of (id, vector)."""
    return vectors.select("id", F.posexplode("vector").alias("position", "value"))


def vector_of(cells: DataFrame, length: int | None = None) -> DataFrame:
    """(id, vector) from cells; with ``length``, places without a cell are 0 (sparse tensors)."""
    parts = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("cells"))
    if length is None:
        return parts.select("id", F.transform("cells", lambda c: c["value"]).alias("vector"))
    known = F.map_from_entries("cells")
    return parts.select("id", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0).cast("float"))).alias("vector"))
