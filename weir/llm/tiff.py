"""TIFF as a column type: walk image directories, decode strips and tiles, undo predictors, one row per page.

Baseline TIFF 6.0 in either byte order: 8-bit samples, chunky or planar, strips or tiles, compression none (1),
LZW (5), deflate (8 and 32946) or PackBits (32773), predictor none (1) or horizontal (2). The writer makes the
same kinds. A page that is something else raises TiffError in `pages`; the row operator reports it in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import map_arrow

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325


class TiffError(ValueError):
    pass


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of 2 and more equal bytes as repeats, the rest as literals of at most 128."""
    a = np.frombuffer(data, "u1")
    if not a.size:
        return b""
    cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
    begins = np.concatenate([[0], cuts]).tolist()
    ends = [*begins[1:], a.size]
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for at in range(0, len(literal), 128):
            part = literal[at : at + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for b, e in zip(begins, ends, strict=True):
        n = e - b
        if n < 3:
            literal.extend(data[b:e])
            continue
        flush()
        while n >= 2:
            k = min(n, 128)
            out.extend((257 - k, data[b]))
            n -= k
        if n:
            literal.append(data[b])
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """TIFF LZW: most significant bit first, clear 256, end 257, code width grows one code early."""
    out: list[bytes] = []
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, have, bits, last = 9, 0, 0, b""
    for byte in data:
        bits = bits << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW data begins within a string")
            last = table[code]
            out.append(last)
            continue
        if code < len(table):
            this = table[code]
        elif code == len(table):
            this = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(this)
        table.append(last + this[:1])
        last = this
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    table = {bytes((i,)): i for i in range(256)}
    width, next_code = 9, 258

    def put(code: int) -> None:
        nonlocal bits, have
        bits = bits << width | code
        have += width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    put(256)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer] = next_code
        next_code += 1
        if next_code == 4094:
            put(256)
            table = {bytes((i,)): i for i in range(256)}
            width, next_code = 9, 258
        elif next_code + 0 >= 1 << width and width < 12:
            width += 1
        run = data[i : i + 1]
    if run:
        put(table[run])
        next_code += 1
        if next_code >= 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(bits << 8 - have & 255)
    return bytes(out)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    try:
        if compression == NONE:
            raw = data
        elif compression == LZW:
            raw = lzw_decode(data)
        elif compression in (DEFLATE, 32946):
            raw = zlib.decompress(data)
        elif compression == PACKBITS:
            raw = packbits_decode(data)
        else:
            raise TiffError(f"compression {compression}")
    except zlib.error as e:
        raise TiffError(str(e)) from e
    if len(raw) < size:
        raise TiffError(f"a strip or tile of {len(raw)} bytes for {size}")
    return raw[:size]


def _pack(data: bytes, compression: int, row: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:  # rows are packed by themselves
        return b"".join(packbits_encode(data[at : at + row]) for at in range(0, len(data), row))
    return data


@dataclass
class Page:
    """One image directory: its tags, and its samples as rows x columns x samples of uint8."""

    index: int
    tags: dict[int, tuple]
    samples: np.ndarray


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The chain of image directories: byte order, and tag -> values. A chain that loops is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    try:
        while at:
            if at in seen:
                raise TiffError("image directories form a loop")
            seen.add(at)
            n = struct.unpack_from(order + "H", data, at)[0]
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                size = _SIZES.get(kind, 0) * count
                where = at + 2 + 12 * k + 8
                if size > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                if size > len(data):
                    raise TiffError(f"tag {tag} is longer than the file")
                if kind in _CODES:
                    tags[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, where)
                elif size:
                    tags[tag] = (data[where : where + size],)
            yield order, tags
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError(f"the file ends early: {e}") from e


def pages(data: bytes) -> Iterator[Page]:
    for index, (_, tags) in enumerate(directories(data)):
        try:
            width, length = tags[WIDTH][0], tags[LENGTH][0]
            spp = tags.get(SAMPLES, (1,))[0]
            if any(b != 8 for b in tags.get(BITS, (1,))):
                raise TiffError(f"samples of {tags.get(BITS, (1,))} bits")
            compression, planar, predictor = (tags.get(t, (1,))[0] for t in (COMPRESSION, PLANAR, PREDICTOR))
            if predictor not in (1, 2):
                raise TiffError(f"predictor {predictor}")
            if TILE_OFFSETS in tags:
                w, h, offsets, counts = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
            else:
                w, h, offsets, counts = width, min(tags.get(ROWS_PER_STRIP, (length,))[0], length), tags[OFFSETS], tags[COUNTS]
            planes = spp if planar == 2 else 1
            each = 1 if planar == 2 else spp
            if not w or not h:
                raise TiffError("an image without extent")
            across, down = -(-width // w), -(-length // h)
            if len(offsets) < across * down * planes or len(counts) < len(offsets):
                raise TiffError("strips or tiles are missing")
            samples = np.zeros((length, width, spp), "u1")
        except (KeyError, IndexError, MemoryError, struct.error) as e:
            raise TiffError(f"page {index}: {e!r}") from e
        for k in range(across * down * planes):
            plane, rest = divmod(k, across * down)
            y, x = divmod(rest, across)
            rows = h if TILE_OFFSETS in tags else min(h, length - y * h)
            raw = _unpack(data[offsets[k] : offsets[k] + counts[k]], compression, rows * w * each)
            block = np.frombuffer(raw, "u1").reshape(rows, w, each)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype="u1")
            part = block[: length - y * h, : width - x * w]
            at = slice(plane, plane + 1) if planar == 2 else slice(None)
            samples[y * h : y * h + part.shape[0], x * w : x * w + part.shape[1], at] = part
        yield Page(index, tags, samples)


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, order: str = "<", planar: int = 1) -> bytes:
    """A TIFF file of uint8 images (rows x columns x samples), one directory each; tile: (rows, columns)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        length, width, spp = image.shape
        h, w = tile or (rows_per_strip, width)
        offsets, counts = [], []
        for plane in range(spp if planar == 2 else 1):
            source = image[:, :, plane : plane + 1] if planar == 2 else image
            for y in range(0, length, h):
                for x in range(0, width, w):
                    block = source[y : y + h, x : x + w]
                    if tile:
                        block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                    if predictor == 2:
                        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                    data = _pack(block.astype("u1").tobytes(), compression, block.shape[1] * block.shape[2])
                    offsets.append(len(out))
                    counts.append(len(data))
                    out += data
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [length]), (BITS, 3, [8] * spp), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if spp >= 3 else 1]), (SAMPLES, 3, [spp]), (PLANAR, 3, [planar]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [w]), (TILE_LENGTH, 4, [h]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (COUNTS, 4, counts)]
        fields = []
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, at = struct.pack(order + "I", len(out)), data
                out += at
            fields.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def page_rows(files: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of each TIFF in column `media`: key, page, width, height, samples, compression, predictor, pixels, error.

    A file that cannot be read gives its pages up to the fault and then a row with `error`; a null file gives
    one such row; a file without directories gives none. pixels are rows x columns x samples, chunky.
    """
    kind = files.schema[key].dataType.simpleString()
    names = [key, "page", "width", "height", "samples", "compression", "predictor", "pixels", "error"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = 0
            try:
                if data is None:
                    raise TiffError("no file")
                for p in pages(data):
                    n += 1
                    out.append((k, p.index, p.samples.shape[1], p.samples.shape[0], p.samples.shape[2], p.tags.get(COMPRESSION, (1,))[0], p.tags.get(PREDICTOR, (1,))[0], p.samples.tobytes(), None))
            except TiffError as e:
                out.append((k, n, None, None, None, None, None, None, str(e)))
        cols = list(zip(*out, strict=True)) or [()] * 9
        kinds = [batch.schema.field(0).type, *[pa.int32()] * 6, pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    ddl = f"`{key}` {kind}, page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"
    return map_arrow(files.select(F.col(key), F.col(media)), ddl, rows, 64)


#: Bytes of a row of 64 RGB pixels; rows of a page; pages are written as strips of 64 rows.
ROW, PAGE_ROWS = 192, 4096


def payload(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8, filled up with spaces to a positive multiple of ROW; and its own length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" "), len(data)


def text_media(text: str | None, compression: int = DEFLATE, predictor: int = 2) -> tuple[bytes, int]:
    data, n = payload(text)
    image = np.frombuffer(data, "u1").reshape(-1, ROW // 3, 3)
    return encode([image[at : at + PAGE_ROWS] for at in range(0, len(image), PAGE_ROWS)], compression, predictor), n


def features(images: list[np.ndarray]) -> str:
    """Pages, rows, mean and deviation of all samples, entropy in bits, and the mean of each channel."""
    counts = sum((np.bincount(i.reshape(-1), minlength=256) for i in images), np.zeros(256, "i8"))
    n, values = int(counts.sum()), np.arange(256)
    mean = float(counts @ values) / n
    deviation = max(0.0, float(counts @ (values * values)) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    channels = sum(i.sum(axis=(0, 1), dtype="i8") for i in images) / (n / 3)
    return f"pages={len(images)} rows={sum(len(i) for i in images)} mean={mean:.4f} sd={deviation:.4f} bits={-float(p @ np.log2(p)):.4f} rgb=" + "/".join(f"{c:.3f}" for c in channels)


def text_as_tiff(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """Each text stored as a TIFF and read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text counts as empty: one row of spaces. Equal texts give equal values. Texts of any length go into
    pages of PAGE_ROWS rows. Repeated and null doc_ids keep their rows; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            media, n = text_media(text, compression, predictor)
            images = [p.samples for p in pages(media)]
            back = b"".join(i.tobytes() for i in images)
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(images)))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ddl, rows, 128)
