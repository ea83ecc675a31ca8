"""TIFF columns: directories, strips, tiles, predictors, one row per page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: bytes of each field type, and the tags that are read.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


class TiffError(ValueError):
    """What is not a readable TIFF says why."""


def unpack_bits(data: bytes, need: int) -> bytes:
    """Runs and literals, until ``need`` bytes are there."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < need:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + run
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        j = min(j, i + 128)
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, need: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early.  It ends with ``need`` bytes."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, bits, held, width, last, size = [], 0, 0, 9, b"", 0
    for byte in data:
        if size >= need:
            break
        held = (held << 8 | byte) & 0xFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        size += len(entry)
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    held, bits, width, out = 0, 0, 9, bytearray()

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    size, now = 258, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if now + c in table:
            now += c
            continue
        put(table[now])
        table[now + c] = size
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
        if size >= 4095:
            put(256)
            table = {bytes((j,)): j for j in range(256)}
            size, width = 258, 9
        now = c
    if now:
        put(table[now])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


#: How many bytes a stored byte can stand for at most, by scheme.
MOST = {NONE: 1, PACKBITS: 64, LZW: 2600, DEFLATE: 1033, OLD_DEFLATE: 1033}


def _decompressed(data: bytes, scheme: int, need: int) -> bytes:
    """The first ``need`` bytes that a strip or tile spells, or few more."""
    if scheme == NONE:
        return data
    if scheme == PACKBITS:
        return unpack_bits(data, need)
    if scheme == LZW:
        return lzw_decode(data, need)
    return zlib.decompressobj().decompress(data, need)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPE_CODES:
            continue
        size = TYPE_BYTES[kind] * n
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size <= len(data):  # a page that needs what lies outside the file lacks the tag
            tags[tag] = struct.unpack_from(f"{order}{n}{TYPE_CODES[kind]}", data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, order: str, tags: dict[int, tuple]) -> dict:
    one = lambda t, usual=None: tags.get(t, (usual,))[0]
    width, height, samples, scheme = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE)
    bits, planar, predictor = one(BITS, 1), one(PLANAR, 1), one(PREDICTOR, 1)
    if not width or not height or not samples:
        raise TiffError("a page has no size")
    if scheme not in MOST:
        raise TiffError(f"compression {scheme} is not supported")
    if bits not in (1, 2, 4, 8, 16) or any(b != bits for b in tags.get(BITS, ())):
        raise TiffError(f"{bits} bits a sample are not supported")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise TiffError(f"predictor {predictor} is not supported")
    kind = np.dtype(np.uint8 if bits <= 8 else order + "u2")
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    places, lengths = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    if not w or not h:
        raise TiffError("a strip or tile has no size")
    across, down = -(-width // w), -(-height // h)
    count = planes * across * down
    if min(len(places), len(lengths)) < count:
        raise TiffError("strips or tiles are missing")
    line = w * depth * kind.itemsize if bits >= 8 else -(-w * depth * bits // 8)
    stored = [min(lengths[k], max(len(data) - places[k], 0)) for k in range(count)]
    # Nothing is made of the declared size before the file is seen to hold that much.
    if any(n * MOST[scheme] < (h if tiled else min(h, height - k % down * h)) * line for k, n in enumerate(stored)):
        raise TiffError("a strip or tile is too short")
    image = np.zeros((planes, height, width, depth), kind.newbyteorder("="))
    for k in range(count):
        p, rest = divmod(k, across * down)
        y, x = rest // across * h, rest % across * w
        rows = h if tiled else min(h, height - y)
        need = rows * line
        raw = _decompressed(data[places[k] : places[k] + stored[k]], scheme, need)
        if len(raw) < need:
            raise TiffError("a strip or tile is too short")
        if bits < 8:
            single = np.unpackbits(np.frombuffer(raw[:need], np.uint8).reshape(rows, line), axis=1, bitorder="little" if one(FILL_ORDER, 1) == 2 and bits == 1 else "big")
            single = single[:, : w * depth * bits].reshape(rows, w, depth, bits)
            block = single @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
        else:
            block = np.frombuffer(raw[:need], kind).astype(image.dtype).reshape(rows, w, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        part = image[p, y : y + rows, x : x + w]
        part[...] = block[: part.shape[0], : part.shape[1]]
    pixels = image[0] if planes == 1 else np.moveaxis(image[..., 0], 0, -1)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": scheme, "predictor": predictor, "pixels": pixels.tobytes()}


_DAMAGE = (TiffError, struct.error, zlib.error, KeyError, TypeError, ValueError, IndexError, ArithmeticError, MemoryError)


def tiff_pages(data: bytes) -> Iterator[dict]:
    """The pages of a file, one by one: width, height, samples, bits, compression, predictor, pixels (native
    order; samples of 1, 2 and 4 bits have a byte each).  A page that is not readable is its error alone;
    damage to the chain of pages is raised after the pages before it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF")
    seen: set[int] = set()
    (at,) = struct.unpack_from(order + "I", data, 4)
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        tags, at = _directory(data, order, at)
        try:
            page = _page(data, order, tags)
        except _DAMAGE as e:
            page = {"error": str(e) or type(e).__name__}
        yield page


def encode_tiff(pages: list[np.ndarray], *, scheme: int = DEFLATE, predictor: int = 1, rows: int = 256, tile: int = 0, order: str = "<", level: int = 1) -> bytes:
    """A file of 8- or 16-bit pages (height, width[, samples]) in strips of ``rows`` or square tiles."""
    pack = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, level)}[scheme]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = page.shape
        if predictor == 2 and not tile:
            moved = page.copy()
            moved[:, 1:] -= page[:, :-1]
        else:
            moved = page
        parts = []
        for y in range(0, height, tile or rows):
            for x in range(0, width, tile or width):
                part = moved[y : y + (tile or rows), x : x + (tile or width)]
                if tile:
                    full = np.zeros((tile, tile, samples), page.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    if predictor == 2:
                        full[:, 1:] = full[:, 1:] - full[:, :-1]
                    part = full
                parts.append(pack(np.ascontiguousarray(part, page.dtype.newbyteorder(order)).tobytes()))
        places = []
        for p in parts:
            places.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        bits = page.dtype.itemsize * 8
        tags = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [bits] * samples), (COMPRESSION, "H", [scheme]), (PHOTOMETRIC, "H", [1 if samples < 3 else 2]), (SAMPLES, "H", [samples]), (PREDICTOR, "H", [predictor])]
        lengths = [len(p) for p in parts]
        tags += [(TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (TILE_OFFSETS, "I", places), (TILE_BYTES, "I", lengths)] if tile else [(STRIP_OFFSETS, "I", places), (ROWS_PER_STRIP, "I", [rows]), (STRIP_BYTES, "I", lengths)]
        entries = []
        for tag, code, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw
                raw = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def features_of(pixels: bytes, width: int) -> str:
    """A 64-bit difference hash over 8 x 9 block means, the mean and the deviation of the samples."""
    a = np.frombuffer(pixels, np.uint8)
    rows = len(a) // width
    total = np.zeros((rows + 1, width + 1), np.int64)
    total[1:, 1:] = a[: rows * width].reshape(rows, width)
    total = total.cumsum(0).cumsum(1)
    y, x = np.arange(9) * rows // 8, np.arange(10) * width // 9
    low_y, high_y = y[:-1], np.maximum(y[1:], np.minimum(y[:-1] + 1, rows))
    low_x, high_x = x[:-1], np.maximum(x[1:], np.minimum(x[:-1] + 1, width))
    sums = total[np.ix_(high_y, high_x)] - total[np.ix_(low_y, high_x)] - total[np.ix_(high_y, low_x)] + total[np.ix_(low_y, low_x)]
    area = np.maximum((high_y - low_y)[:, None] * (high_x - low_x)[None, :], 1)
    means = sums // area
    bits = np.packbits((means[:, 1:] > means[:, :-1]).ravel()).tobytes().hex()
    n, s, q = len(a), int(a.sum(dtype=np.int64)), int((a.astype(np.int64) ** 2).sum())
    return f"{bits}:{s * 1000 // max(n, 1)}:{(q * n - s * s) * 1000 // max(n * n, 1)}"


_PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, feature string, error string"
_PAGE_NAMES = ["page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "feature", "error"]


def read_tiff_columns(files: DataFrame, *, keep_col: str, media_col: str = "media") -> DataFrame:
    """One row per page of each file: ``keep_col`` as it is, the page's number and shape, its
    pixels, a feature string (8-bit pages) and a null error.

    A page that is not readable has its number and the error alone.  A null file gives no
    row; one that is no TIFF, or whose chain of pages breaks, gives a row with page -1, no
    pixels and the error, after the pages before the break.  Repeated rows give repeated pages; further columns are ignored."""
    kept = files.select(F.col(keep_col), F.col(media_col).alias("__media__"))
    schema = f"`{keep_col}` {kept.schema[keep_col].dataType.simpleString()}, {_PAGE_SCHEMA}"
    page_types = [pa.int32()] * 7 + [pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0

            def told() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(at, pa.int64()))]
                columns += [pa.array([r.get(n) for r in rows], t) for n, t in zip(_PAGE_NAMES, page_types, strict=True)]
                return pa.RecordBatch.from_arrays(columns, names=[keep_col, *_PAGE_NAMES])

            for i, media in enumerate(batch.column(1)):
                if (data := media.as_py()) is None:
                    continue
                try:
                    for k, page in enumerate(tiff_pages(data)):
                        feature = features_of(page["pixels"], page["width"] * page["samples"]) if page.get("bits") == 8 else None
                        rows.append({"page": k, "feature": feature, **page})
                        at.append(i)
                        held += len(page.get("pixels", b""))
                        if held > 16 << 20:
                            yield told()
                            at, rows, held = [], [], 0
                except _DAMAGE as e:
                    rows.append({"page": -1, "error": str(e) or type(e).__name__})
                    at.append(i)
                if held > 16 << 20:
                    yield told()
                    at, rows, held = [], [], 0
            if rows:
                yield told()

    return kept.mapInArrow(run, schema)


def store_as_tiff(docs: DataFrame, *, width: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled with zeros to whole rows, as a grey page.

    A null text is an empty one; an empty one is a page of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                rows = max(1, -(-len(data) // width))
                page = np.frombuffer(data.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width)
                ids.append(doc_id)
                sizes.append(len(data))
                files.append(encode_tiff([page]))
                held += len(data)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    ids, sizes, files, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
