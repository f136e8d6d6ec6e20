"""Media columns in TIFF: the file walked directory by directory, one row for each page.

The reader takes both byte orders, strips and tiles, chunky and planar samples of 8 or 16 bits, no compression,
PackBits, LZW and deflate, and undoes horizontal differencing. The writer stores 8-bit samples in strips.
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

from .common import arrow_map

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
STRIP_ROWS = 1024
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three or more equal bytes as two bytes, other bytes as they are behind their number."""
    out, at, plain = bytearray(), 0, 0

    def flush(end: int) -> None:
        nonlocal plain
        while plain < end:
            n = min(128, end - plain)
            out.append(n - 1)
            out.extend(data[plain : plain + n])
            plain += n

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            flush(at)
            out += bytes((257 - run, data[at]))
            plain = at + run
        at += run
    flush(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, held, filled = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, filled
        held, filled = held << width | code, filled + width
        while filled >= 8:
            filled -= 8
            out.append(held >> filled & 255)
        held &= (1 << filled) - 1

    table: dict[tuple[int, int], int] = {}
    width, following, prefix = 9, 258, -1
    put(256, width)
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        if (known := table.get((prefix, byte))) is not None:
            prefix = known
            continue
        put(prefix, width)
        table[prefix, byte] = following
        following, prefix = following + 1, byte
        if following == 4094:
            put(256, width)
            table.clear()
            width, following = 9, 258
        elif following in (512, 1024, 2048):
            width += 1
    if prefix >= 0:
        put(prefix, width)
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    put(257, width)
    if filled:
        out.append(held << 8 - filled & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, table, previous = bytearray(), [], b""
    held = filled = at = 0
    width = 9
    while len(out) < size:
        while filled < width:
            if at >= len(data):
                return bytes(out)
            held, filled, at = held << 8 | data[at], filled + 8, at + 1
        filled -= width
        code = held >> filled
        held &= (1 << filled) - 1
        if code == 256:
            table, width, previous = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not table:
            raise ValueError("LZW data do not begin with a clear code")
        if not previous:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code is not in the table")
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out += entry
        previous = entry
        if len(table) in (511, 1023, 2047):
            width += 1
    return bytes(out)


def compress(data: bytes, kind: int) -> bytes:
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 2), PACKBITS: pack_bits}[kind](data)


def decompress(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        return data
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if kind == LZW:
        return unlzw(data, size)
    if kind == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {kind} is not supported")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS) -> bytes:
    """A little-endian file with a page for each array of rows, columns and samples (uint8)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for pixels in pages:
        rows, columns, samples = pixels.shape
        offsets, sizes = [], []
        for top in range(0, rows, strip_rows):
            strip = pixels[top : top + strip_rows]
            if predictor == 2:
                strip = np.concatenate((strip[:, :1], strip[:, 1:] - strip[:, :-1]), axis=1)
            data = compress(strip.tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        entries = [(256, 4, [columns]), (257, 4, [rows]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 1]), (273, 4, offsets), (277, 3, [samples]), (278, 4, [strip_rows]), (279, 4, sizes), (284, 3, [1]), (317, 3, [predictor])]
        fields = []
        for tag, kind, values in entries:
            data = struct.pack(f"<{len(values)}{CODES[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack("<I", len(out))
                out += data
            else:
                place = data.ljust(4, b"\0")
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    """A page's number, form and pixels (rows, columns, samples)."""

    number: int
    compression: int
    predictor: int
    pixels: np.ndarray


def read_tiff(media: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; a chain that comes back to itself ends there."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, number, seen = struct.unpack_from(order + "I", media, 4)[0], 0, set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(order + "H", media, at)[0]
        tags: dict[int, tuple] = {}
        for k in range(count):
            place = at + 2 + 12 * k
            tag, kind, n = struct.unpack_from(order + "HHI", media, place)
            if kind in CODES:
                start = place + 8 if SIZES[kind] * n <= 4 else struct.unpack_from(order + "I", media, place + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{CODES[kind]}", media, start)
        yield _page(media, tags, number, order)
        at, number = struct.unpack_from(order + "I", media, at + 2 + 12 * count)[0], number + 1


def _page(media: bytes, tags: dict[int, tuple], number: int, order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    columns, rows, samples = tags[256][0], tags[257][0], one(277, 1)
    kind, predictor, planar, bits = one(259, NONE), one(317, 1), one(284, 1), set(tags.get(258, (1,)))
    if bits not in ({8}, {16}) or predictor not in (1, 2) or one(266, 1) != 1:
        raise ValueError("only 8 and 16 bit samples, with horizontal differencing at most, are supported")
    form = np.dtype("u1" if bits == {8} else order + "u2")
    tiled = 322 in tags
    wide, high = (tags[322][0], tags[323][0]) if tiled else (columns, min(one(278, rows), rows) or rows)
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-columns // wide), -(-rows // high)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes:
        raise ValueError("a page has too few strips or tiles")
    pixels = np.zeros((rows, columns, samples), form.newbyteorder("="))
    for i in range(across * down * planes):
        plane, cell = divmod(i, across * down)
        y, x = cell // across * high, cell % across * wide
        tall = high if tiled else min(high, rows - y)
        size = tall * wide * depth * form.itemsize
        data = decompress(media[offsets[i] : offsets[i] + sizes[i]], kind, size)
        if len(data) < size:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(data, form, tall * wide * depth).reshape(tall, wide, depth).astype(pixels.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        part = block[: rows - y, : columns - x]
        pixels[y : y + part.shape[0], x : x + part.shape[1], plane if planar == 2 else slice(None)] = part[:, :, 0] if planar == 2 else part
    return Page(number, kind, predictor, pixels)


def pad(text: bytes) -> bytes:
    """The bytes followed by spaces up to a positive multiple of a row's bytes."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def feature(pixels: np.ndarray) -> str:
    """Form, integer means of the samples, and 64 bits that tell which cell of an 8 by 8 grid is brighter than the page."""
    rows, columns, samples = pixels.shape
    means = pixels.reshape(-1, samples).sum(axis=0, dtype=np.int64) // (rows * columns)
    light = pixels.sum(axis=2, dtype=np.int64)
    ys, xs = np.arange(9) * rows // 8, np.arange(9) * columns // 8
    sums = np.zeros((9, 9), np.int64)
    for j in range(1, 9):
        band = light[ys[j - 1] : ys[j]].sum(axis=0)
        sums[j, 1:] = sums[j - 1, 1:] + np.concatenate(([0], np.cumsum(band)))[xs[1:]]
    code = 0
    for j in range(8):
        for k in range(8):
            area = int((ys[j + 1] - ys[j]) * (xs[k + 1] - xs[k]))
            cell = int(sums[j + 1, k + 1] - sums[j, k + 1] - sums[j + 1, k] + sums[j, k])
            code = code << 1 | (cell * rows * columns > int(sums[8, 8]) * area)
    return f"{rows}x{columns}x{samples}:{'.'.join(map(str, means.tolist()))}:{code:016x}"


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """(doc_id long, n_bytes long, media binary): each whole text as a TIFF of one page, 64 pixels of three samples wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [write_tiff([np.frombuffer(pad(t), np.uint8).reshape(-1, WIDTH, SAMPLES)], compression, predictor) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_bytes long, media binary")


def pages(media: DataFrame, with_pixels: bool = False) -> DataFrame:
    """One row for each page of column `media`, with the rows' doc_id and n_bytes: page int, height, width, samples int,
    payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string,
    error string, and with `with_pixels` pixels binary. Null media give no row; media that can not be read give
    one with the error and without page."""
    names = ["doc_id", "n_bytes", "page", "height", "width", "samples", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = "doc_id long, n_bytes long, page int, height int, width int, samples int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    if with_pixels:
        names, kinds, schema = [*names, "pixels"], [*kinds, pa.binary()], schema + ", pixels binary"

    def rows_of(doc_id: int | None, n_bytes: int | None, stored: bytes) -> Iterator[tuple]:
        form = (len(stored), hashlib.sha256(stored).hexdigest())
        try:
            for page in read_tiff(stored):
                data = page.pixels.tobytes()
                row = (doc_id, n_bytes, page.number, *page.pixels.shape, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), *form, feature(page.pixels), None)
                yield (*row, data) if with_pixels else row
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as error:
            row = (doc_id, n_bytes, *[None] * 7, *form, None, f"{type(error).__name__}: {error}")
            yield (*row, None) if with_pixels else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                columns = [c.to_pylist() for c in batch.slice(at, 256).columns]
                rows = [row for x in zip(*columns, strict=True) if x[2] is not None for row in rows_of(*x)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, schema)


def store_and_read(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text stored as a media column and read back: one row for each row of `docs`, as `pages` gives them.

    Null and empty texts are one row of spaces; equal texts have equal values; a null id stays null and rows repeat;
    an empty table gives no rows; other columns are ignored.
    """
    return pages(store_texts(docs, id_column, text_column))
