"""Binary formats: WAV samples and SafeTensor values, read by partition."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.store import settled

#: Bytes of each tensor type.
TENSOR_BYTES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
MAX_HEADER = 100 << 20


def wav_samples(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Rate, channels, bits and 16-bit samples of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    channels, rate = struct.unpack_from("<HI", data, 22)
    (bits,) = struct.unpack_from("<H", data, 34)
    body = data[44:]
    return rate, channels, bits, np.frombuffer(body[: len(body) // 2 * 2], "<i2")


def tensor_header(data: bytes) -> dict[str, dict]:
    """The tensors that a SafeTensor file declares, with absolute places."""
    (n,) = struct.unpack_from("<Q", data, 0)
    if n > MAX_HEADER or 8 + n > len(data):
        raise ValueError("the header is too long")
    head = json.loads(data[8 : 8 + n])
    head.pop("__metadata__", None)
    return {k: v | {"begin": 8 + n + v["data_offsets"][0], "end": 8 + n + v["data_offsets"][1]} for k, v in head.items()}


def tensor_values(raw: bytes, kind: str) -> np.ndarray:
    """Float values widened to 32 bits."""
    if kind == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    if kind not in ("F16", "F32", "F64"):
        raise ValueError(f"{kind} holds no floats")
    return np.frombuffer(raw, {"F16": "<f2", "F32": "<f4", "F64": "<f8"}[kind]).astype(np.float32)


def tensor_ranges(files: DataFrame, step: int = 4 << 20) -> DataFrame:
    """(path, tensor, dtype, begin, end, first) of (path): the float tensors of each file in ranges of ``step`` bytes.

    Of a file the header alone is read, through the file system of its path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path in pdf["path"]:
                with _opened(path) as file:
                    for name, t in _header_of(file).items():
                        if t["dtype"] in ("F16", "BF16", "F32", "F64"):
                            rows += [(path, name, t["dtype"], at, min(at + step, t["end"]), (at - t["begin"]) // TENSOR_BYTES[t["dtype"]]) for at in range(t["begin"], t["end"], step)]
            yield pd.DataFrame(rows, columns=["path", "tensor", "dtype", "begin", "end", "first"])

    return files.select("path").mapInPandas(run, "path string, tensor string, dtype string, begin long, end long, first long")


def _opened(path: str):
    """A file by its URI: local ones as files, all others through Arrow's file systems."""
    if path.startswith("file:"):
        return open(unquote(urlparse(path).path), "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _header_of(file) -> dict[str, dict]:
    """As :func:`tensor_header`, of an open file."""
    (n,) = struct.unpack("<Q", file.read(8))
    if n > MAX_HEADER:
        raise ValueError("the header is too long")
    return tensor_header(struct.pack("<Q", n) + file.read(n))


def read_tensors(files: DataFrame, *, threshold: float = 0.0) -> DataFrame:
    """(path, tensor, position, value) of (path); values below the threshold are left out.

    Headers are read first; then each range of a tensor is a row of its own, dealt over all
    tasks, which reads just its bytes: a file has no size limit."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples():
                with _opened(row.path) as file:
                    file.seek(row.begin)
                    v = tensor_values(file.read(row.end - row.begin), row.dtype)
                keep = np.flatnonzero(np.abs(v) >= threshold)
                yield pd.DataFrame({"path": row.path, "tensor": row.tensor, "position": keep + row.first, "value": v[keep]})

    ranges = settled(tensor_ranges(files))
    dealt = ranges.repartition("path", "tensor", "begin")
    return dealt.mapInPandas(run, "path string, tensor string, position long, value float")


def read_wav(files: DataFrame) -> DataFrame:
    """(path, rate, channels, bits, samples, error) of a binaryFile frame; a file that is no WAV has its error alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rate, channels, bits, samples = wav_samples(content)
                    rows.append((path, rate, channels, bits, samples.tolist(), None))
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "bits", "samples", "error"]).astype({"rate": "Int32", "channels": "Int32", "bits": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, channels int, bits int, samples array<short>, error string")


#: What the name of an embedding tensor holds.
EMBEDDING_NAMES = ("embed", "wte", "token_embedding")


def tensor_class(name: Column) -> Column:
    """embedding or weight, by the tensor's name, whatever its case."""
    either = F.lit(False)
    for part in EMBEDDING_NAMES:
        either = either | F.lower(name).contains(part)
    return F.when(either, "embedding").otherwise("weight")


def tensor_vectors(cells: DataFrame) -> DataFrame:
    """(path, tensor, class, vector): each tensor of :func:`read_tensors` as one vector, and its class."""
    parts = cells.groupBy("path", "tensor").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("parts"))
    return parts.select("path", "tensor", tensor_class(F.col("tensor")).alias("class"), F.transform("parts", lambda p: p["value"]).alias("vector"))


def taken_in(spark, folder: str) -> dict[str, DataFrame]:
    """The files of a folder by kind: texts (path, text), json (path, json), audio as
    :func:`read_wav`, and images and all other files (path, content) as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).withColumn("kind", file_kind(F.col("path")))
    of = lambda k: files.where(F.col("kind") == k)
    text = lambda k, name: of(k).select("path", F.decode("content", "UTF-8").alias(name))
    return {"text": text("text", "text"), "json": text("json", "json"), "audio": read_wav(of("audio")), "image": of("image").select("path", "content"), "binary": of("binary").select("path", "content")}


def file_kind(path: Column) -> Column:
    """text, json, image, audio or binary, by the file's extension."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.(txt|md|cs|py|js|ts|html|css|xml)$"), "text")
        .when(p.rlike(r"\.json$"), "json")
        .when(p.rlike(r"\.(png|jpe?g|bmp|gif)$"), "image")
        .when(p.rlike(r"\.wav$"), "audio")
        .otherwise("binary")
    )
