"""Media columns: baseline TIFF written and read without a media library.

The reader walks the chain of image file directories in either byte order, decodes
uncompressed, PackBits, LZW and deflate strips or tiles, undoes horizontal differencing
and yields one row per page. The writer makes files for the reader to be tried on.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table, utf8

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


class TiffError(ValueError):
    """The bytes are not a TIFF file that this reader can decode."""


@dataclass(frozen=True)
class Page:
    """One image directory, decoded; ``pixels`` are its samples row by row."""

    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    segments: int
    pixels: bytes


def packbits_decode(data: bytes) -> bytes:
    """Runs of a repeated byte (header 129 to 255) and of literal bytes (0 to 127); 128 is skipped."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            if i + 1 >= n:
                raise TiffError("PackBits run without a byte")
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three equal bytes or more as repeats, everything else as literals."""
    cells = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.diff(cells, prepend=~cells[:1])) if data else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    long = sizes >= 3
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
        literal(start)
        at = start + n
        while n >= 3:
            run = min(n, 128)
            out += bytes((257 - run, data[start]))
            n -= run
        at -= n  # one or two that are left begin the next literals
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits, widened one code early; 256 clears, 257 ends."""
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, out, last, width, held, bits = list(start), [], None, 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            words, last, width = list(start), None, 9
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW starts with an unknown code")
            word = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("LZW code beyond its table")
            words.append(last + word[:1])
            size = len(words)
            width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
        out.append(word)
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """The counterpart of ``lzw_decode``; the table is cleared when it is full."""
    start = {bytes((i,)): i for i in range(256)}
    codes, width, held, bits, out, word = dict(start), 9, 0, 0, bytearray(), b""
    following = 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            put(256)
            codes, width, following = dict(start), 9, 258
        word = data[i : i + 1]
    if word:
        put(codes[word])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _unpack(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    raise TiffError(f"compression {compression} is not known")


def _pack(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode}[compression](data)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """Tags of the directory at ``at`` and where the next one starts (0: nowhere)."""
    if at + 2 > len(data):
        raise TiffError("directory beyond the end")
    (count,) = struct.unpack_from(order + "H", data, at)
    end = at + 2 + 12 * count
    if end + 4 > len(data):
        raise TiffError("directory is cut off")
    tags: dict[int, tuple] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _CODES:
            continue
        where, size = at + 10 + 12 * k, _SIZES[kind] * n
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + size > len(data):
            raise TiffError(f"values of tag {tag} beyond the end")
        tags[tag] = struct.unpack_from(f"{order}{n}{_CODES[kind]}", data, where)
    return tags, struct.unpack_from(order + "I", data, end)[0]


def _segment(data: bytes, offset: int, count: int, rows: int, row_bytes: int, compression: int, predictor: int, samples: int, bits: int, order: str) -> np.ndarray:
    """One strip or tile as rows of bytes; too short a segment is an error."""
    if offset + count > len(data):
        raise TiffError("segment beyond the end")
    raw = _unpack(data[offset : offset + count], compression)
    if len(raw) < rows * row_bytes:
        raise TiffError("segment is too short")
    cells = np.frombuffer(raw, np.uint8, rows * row_bytes).reshape(rows, row_bytes)
    if predictor == 2:
        kind = np.dtype({8: "u1", 16: "u2", 32: "u4"}[bits]).newbyteorder(order)
        steps = cells.reshape(rows, row_bytes).view(kind).reshape(rows, -1, samples)
        cells = np.cumsum(steps, axis=1, dtype=kind.newbyteorder("=")).astype(kind).view(np.uint8).reshape(rows, row_bytes)
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} is not known")
    return cells


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages of a TIFF file in the order of its directories; ``TiffError`` where it can't be decoded."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    index = 0
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        one = lambda tag, default, tags=tags: tags.get(tag, (default,))[0]
        width, height, samples, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
        compression, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
        if not width or not height or not samples:
            raise TiffError("page without a size")
        if bits not in (8, 16, 32) or len(set(tags.get(258, (bits,)))) > 1:
            raise TiffError(f"samples of {bits} bits are not known")
        cell, planes = (samples, 1) if planar == 1 else (1, samples)
        unit = cell * bits // 8
        tiled = 322 in tags
        if tiled:
            across, down = one(322, 0), one(323, 0)
            offsets, counts = tags.get(324, ()), tags.get(325, ())
            if not across or not down:
                raise TiffError("tiles without a size")
        else:
            across, down = width, min(one(278, height), height) or height
            offsets, counts = tags.get(273, ()), tags.get(279, ())
        columns, lines = -(-width // across), -(-height // down)
        if len(offsets) != columns * lines * planes or len(counts) != len(offsets):
            raise TiffError("segments do not cover the page")
        image = np.empty((planes, height, width * unit), np.uint8)
        for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
            plane, k = divmod(k, columns * lines)
            row, column = divmod(k, columns)
            top, left = row * down, column * across
            tall, wide = min(down, height - top), min(across, width - left)
            cells = _segment(data, offset, count, down if tiled else tall, across * unit, compression, predictor, cell, bits, order)
            image[plane, top : top + tall, left * unit : (left + wide) * unit] = cells[:tall, : wide * unit]
        if planes > 1:
            image = image.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
        yield Page(index, width, height, samples, bits, compression, predictor, tiled, len(offsets), image.tobytes())
        index += 1


def write_pages(payload: bytes, width: int = 192, page_rows: int = 256, compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file whose pages hold ``payload`` as 8-bit grey rows of ``width``, ``page_rows`` a page.

    ``payload`` must fill whole rows. ``tile`` (width, height in multiples of 16) makes tiles instead of strips.
    """
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        across, down = tile or (width, rows_per_strip)
        offsets, counts = [], []
        for y in range(0, len(page), down):
            for x in range(0, width, across):
                cells = page[y : y + down, x : x + across]
                if tile:
                    cells = np.pad(cells, ((0, down - cells.shape[0]), (0, across - cells.shape[1])))
                if predictor == 2:
                    cells = np.diff(cells, axis=1, prepend=np.zeros((len(cells), 1), np.uint8))
                packed = _pack(cells.tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        tags: dict[int, tuple[str, list[int]]] = {256: ("I", [width]), 257: ("I", [len(page)]), 258: ("H", [8]), 259: ("H", [compression]), 262: ("H", [1]), 277: ("H", [1]), 284: ("H", [1]), 317: ("H", [predictor])}
        tags |= {322: ("I", [across]), 323: ("I", [down]), 324: ("I", offsets), 325: ("I", counts)} if tile else {273: ("I", offsets), 278: ("I", [down]), 279: ("I", counts)}
        entries = bytearray()
        out += b"\0" * (len(out) % 2)
        for tag, (code, values) in sorted(tags.items()):
            body = struct.pack(f"<{len(values)}{code}", *values)
            if len(body) > 4:
                where = len(out)
                out += body
                body = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, 3 if code == "H" else 4, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
        if len(out) >= 1 << 32:
            raise ValueError("a TIFF file ends at 4 GiB")
    return bytes(out)


PAGES_SCHEMA = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, segments int, pixels binary, error string"


def tiff_pages(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per page of every file in ``media``, with ``key`` (whatever its values) and ``PAGES_SCHEMA``.

    A null file gives no row. A file that can't be decoded gives the pages before the fault and a
    row whose ``error`` names it and whose other columns are null. Repeated rows give repeated pages;
    all other columns of ``df`` are left out, so their names can't clash.
    """
    names = [x.split()[0] for x in PAGES_SCHEMA.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def walk(batches):
        for batch in chunks(batches, 1):
            rows, keys = [], batch.column(0)
            taken = []
            for i, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    for p in read_pages(data):
                        taken.append(i)
                        rows.append((p.index, p.width, p.height, p.samples, p.bits, NAMES.get(p.compression, "other"), p.predictor, p.tiled, p.segments, p.pixels, None))
                except TiffError as e:
                    taken.append(i)
                    rows.append((None,) * 10 + (str(e),))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int32()] * 5 + [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(taken, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, *names])

    return df.select(key, media).mapInArrow(walk, f"`{key}` {kind}, {PAGES_SCHEMA}")


ROW = 192


#: How the query stores payloads: codec, predictor and tiles of each form.
FORMS = ((LZW, 1, None), (PACKBITS, 1, None), (DEFLATE, 2, None), (DEFLATE, 2, (64, 64)))


def stored_form(payload: bytes) -> bytes:
    """A payload in the form that its own checksum chooses, whatever its length; so about as much goes through each form."""
    compression, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write_pages(payload, ROW, compression=compression, predictor=predictor, tile=tile)


def _digest(text: bytes) -> tuple:
    payload = text + b" " * (-len(text) % ROW or (0 if text else ROW))
    media = stored_form(payload)
    pages = list(read_pages(media))
    back = b"".join(p.pixels for p in pages)
    histogram = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
    levels, mean = int(np.count_nonzero(histogram)), int(histogram @ np.arange(256)) * 1000 // len(back)
    head = pages[0]
    feature = f"pages={len(pages)};width={head.width};rows={sum(p.height for p in pages)};codec={NAMES[head.compression]};predictor={head.predictor};tiled={int(head.tiled)};segments={sum(p.segments for p in pages)};levels={levels};mode={int(histogram.argmax())};mean_milli={mean}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as TIFF pages, read back, and its digests.

    A null or empty text is one row of 192 blanks. Rows with a null or repeated ``doc_id`` each give a row.
    """

    def run(batches):
        for batch in chunks(batches, 1):
            columns = zip(*map(_digest, utf8(batch.column(1))), strict=True)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
