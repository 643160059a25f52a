"""TIFF as a media column: walk the image directories, decode strips and tiles, one row per page.

Reads classic TIFF of either byte order with uncompressed, PackBits, LZW and deflate data, 1 to 64 bits
per sample, chunky or planar samples, and the horizontal and floating-point predictors; writes the
same compressions for 8-bit samples.
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

from . import ragged

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Fixed values of the TIFF 6.0 format: bytes of each field type, and tag numbers.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339


def packbits_encode(raw: bytes, width: int | None = None) -> bytes:
    """Runs of three bytes or more as such, the rest as it is; no packet goes on into another row of ``width`` bytes."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width or len(raw) or 1)
    width = rows.shape[1]
    same = rows[:, 1:] == rows[:, :-1]
    runs = (same[:, 1:] & same[:, :-1]).any(1) | (width > 128)
    # Rows without a run are one packet each.
    plain = np.concatenate([np.full((len(rows), 1), min(width, 128) - 1, np.uint8), rows], 1)
    out, at = [], 0
    for y in np.flatnonzero(runs).tolist():
        out += [plain[at:y].tobytes(), _packed_row(rows[y])]
        at = y + 1
    return b"".join([*out, plain[at:].tobytes()])


def _packed_row(row: np.ndarray) -> bytes:
    start = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
    size = np.diff(np.append(start, len(row)))
    raw, out, at = row.tobytes(), bytearray(), 0
    for s, n in [*zip(start[size > 2].tolist(), size[size > 2].tolist()), (len(raw), 0)]:
        for i in range(at, s, 128):
            part = raw[i : min(i + 128, s)]
            out += bytes((len(part) - 1,)) + part
        at = s
        while n > 1:
            out += bytes((257 - min(n, 128), raw[s]))
            at, n = at + min(n, 128), n - min(n, 128)
    return bytes(out)


def packbits_decode(coded: bytes, size: int) -> bytes:
    out, i, n = [], 0, 0
    while i < len(coded) and n < size:
        k = coded[i]
        if k < 128:
            out.append(coded[i + 1 : i + 2 + k])
            i += 2 + k
            n += k + 1
        elif k == 128:
            i += 1
        else:
            out.append(coded[i + 1 : i + 2] * (257 - k))
            i += 2
            n += 257 - k
    return b"".join(out)


CLEAR, END, FULL = 256, 257, 4094
#: Bits of the n-th code after a clear code, which is how many the table then needs, and where it begins.
_BITS = np.array([min(12, (258 + n).bit_length()) for n in range(1 << 13)])
_BEGIN = np.concatenate([[0], np.cumsum(_BITS)[:-1]])
_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_encode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the table cleared when it is full."""
    codes: list[int] = []
    if raw:
        put, table, size, word = codes.append, {}, 258, raw[0]
        get = table.get
        for b in raw[1:]:
            key = word << 8 | b
            longer = get(key)
            if longer is not None:
                word = longer
                continue
            put(word)
            word, table[key] = b, size
            size += 1
            if size == FULL:
                put(CLEAR)
                table.clear()
                size = 258
        put(word)
    codes.append(END)
    bits = np.concatenate([[9], _BITS[np.arange(len(codes)) % (FULL - 258 + 1)]])
    begin = np.cumsum(bits) - bits
    value = np.array([CLEAR, *codes]) << 24 - bits - (begin & 7)
    out = np.zeros(int(begin[-1] + bits[-1] + 7) // 8 + 2, np.uint8)
    for k in range(3):  # the bits of different codes never overlap
        np.add.at(out, (begin >> 3) + k, (value >> 16 - 8 * k & 255).astype(np.uint8))
    return out[:-2].tobytes()


def lzw_decode(coded: bytes, size: int) -> bytes:
    data = np.concatenate([np.frombuffer(coded, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    total, at, out, n, going = 8 * len(coded), 0, [], 0, True
    while going and n < size:
        # The codes up to the next clear code have known sizes; beyond the list all have 12 bits.
        count = int(np.searchsorted(_BEGIN + _BITS, total - at, "right"))
        begin, bits = at + _BEGIN[:count], _BITS[:count]
        if count == len(_BITS):
            more = at + _BEGIN[-1] + 12 * np.arange(1, (total - at - int(_BEGIN[-1])) // 12)
            begin, bits = np.concatenate([begin, more]), np.concatenate([bits, np.full(len(more), 12)])
        place = begin >> 3
        codes = (data[place] << 16 | data[place + 1] << 8 | data[place + 2]) >> 24 - bits - (begin & 7) & (1 << bits) - 1
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        end = int(stop[0]) if len(stop) else len(codes)
        going = end < len(codes) and int(codes[end]) == CLEAR
        if going:
            at = int(begin[end] + bits[end])
        table, before = list(_SINGLE), b""
        for code in codes[:end].tolist():
            if code < len(table):
                word = table[code]
            elif before and code == len(table):
                word = before + before[:1]
            else:
                raise ValueError("LZW code out of range")
            out.append(word)
            n += len(word)
            if before and len(table) < 4096:
                table.append(before + word[:1])
            before = word
            if n >= size:
                break
    return b"".join(out)


def _decompress(kind: int, coded: bytes, size: int) -> bytes:
    if kind == NONE:
        raw = coded
    elif kind == PACKBITS:
        raw = packbits_decode(coded, size)
    elif kind == LZW:
        raw = lzw_decode(coded, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(coded, size)
    else:
        raise ValueError(f"compression {kind} is not supported")
    if len(raw) < size:
        raise ValueError(f"{len(raw)} bytes of {size} after decoding")
    return raw[:size]


@dataclass
class Page:
    """One decoded image: rows x columns x samples."""

    pixels: np.ndarray
    bits: int
    compression: int
    photometric: int


class _Reader:
    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if data[:2] == b"II" else ">"
        magic, self.first = struct.unpack_from(f"{self.order}HI", data, 2)
        if magic != 42:
            raise ValueError("not a classic TIFF file")

    def directories(self) -> Iterator[dict[int, tuple[int, ...]]]:
        at, seen = self.first, set()
        while at and at not in seen:
            seen.add(at)
            if at + 2 > len(self.data):
                raise ValueError("a directory lies outside the file")
            (n,) = struct.unpack_from(f"{self.order}H", self.data, at)
            if at + 6 + 12 * n > len(self.data):
                raise ValueError("a directory lies outside the file")
            yield {tag: v for k in range(n) for tag, v in [self._field(at + 2 + 12 * k)] if v is not None}
            (at,) = struct.unpack_from(f"{self.order}I", self.data, at + 2 + 12 * n)

    def _field(self, at: int) -> tuple[int, tuple[int, ...] | None]:
        tag, kind, count = struct.unpack_from(f"{self.order}HHI", self.data, at)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code is None:
            return tag, None
        size = TYPE_BYTES[kind] * count
        where = at + 8 if size <= 4 else struct.unpack_from(f"{self.order}I", self.data, at + 8)[0]
        if where + size > len(self.data):
            raise ValueError(f"tag {tag} lies outside the file")
        return tag, struct.unpack_from(f"{self.order}{count}{code}", self.data, where)

    def page(self, tags: dict[int, tuple[int, ...]]) -> Page:
        def one(tag: int, default: int | None = None) -> int:
            value = tags.get(tag, (default,))[0]
            if value is None:
                raise ValueError(f"tag {tag} is missing")
            return value

        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, kind, predictor, sample_format = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(FORMAT, 1)
        if len(set(tags.get(BITS, (1,)))) > 1:
            raise ValueError("samples of several sizes are not supported")
        planes = samples if one(PLANAR, 1) == 2 else 1
        depth = samples // planes
        if TILE_AT in tags:
            box_w, box_h, at, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_AT], tags.get(TILE_BYTES)
        else:
            box_w, box_h, at, sizes = width, min(one(STRIP_ROWS, height), height), tags.get(STRIP_AT), tags.get(STRIP_BYTES)
        if not at or not sizes or len(at) != len(sizes):
            raise ValueError("no strips or tiles")
        if not width or not height or not box_w or not box_h:
            raise ValueError("an image without pixels")
        across, down = -(-width // box_w), -(-height // box_h)
        if len(at) < across * down * planes:
            raise ValueError("strips or tiles are missing")
        dtype = np.dtype(f"{'f' if sample_format == 3 else 'i' if sample_format == 2 else 'u'}{max(1, bits // 8)}") if bits in (8, 16, 32, 64) else np.dtype("u1")
        out = np.zeros((height, width, samples), dtype)
        for k in range(across * down * planes):
            plane, j = divmod(k, across * down)
            y, x = j // across * box_h, j % across * box_w
            rows = box_h if TILE_AT in tags else min(box_h, height - y)
            line = -(-box_w * depth * bits // 8)
            coded = self.data[at[k] : at[k] + sizes[k]]
            raw = np.frombuffer(_decompress(kind, coded, rows * line), np.uint8).reshape(rows, line)
            part = self._samples(raw, bits, dtype, predictor, box_w, depth)
            h, w = min(rows, height - y), min(box_w, width - x)
            out[y : y + h, x : x + w, plane * depth : (plane + 1) * depth] = part[:h, :w]
        return Page(out, bits, kind, one(PHOTOMETRIC, 0))

    def _samples(self, raw: np.ndarray, bits: int, dtype: np.dtype, predictor: int, width: int, depth: int) -> np.ndarray:
        """Samples of one strip or tile, its predictor undone."""
        rows = len(raw)
        if bits in (1, 2, 4):
            if predictor != 1:
                raise ValueError("a predictor over packed samples is not supported")
            flat = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
            return np.packbits(flat, axis=2)[:, : width * depth, 0].reshape(rows, width, depth) >> (8 - bits)
        if bits not in (8, 16, 32, 64):
            raise ValueError(f"{bits} bits per sample are not supported")
        size = bits // 8
        if predictor == 3:
            step = np.cumsum(raw.reshape(rows, -1, depth), axis=1, dtype=np.uint8).reshape(rows, size, width * depth)
            planes = np.ascontiguousarray(step.transpose(0, 2, 1))  # most significant byte first
            return planes.view(dtype.newbyteorder(">")).reshape(rows, width, depth).astype(dtype)
        values = np.ascontiguousarray(raw).view(dtype.newbyteorder(self.order)).astype(dtype).reshape(rows, width, depth)
        if predictor == 2:
            plain = values.view(f"u{size}")
            return np.cumsum(plain, axis=1, dtype=plain.dtype).view(dtype)
        if predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        return values


def read_pages(data: bytes) -> Iterator[Page]:
    reader = _Reader(data)
    for tags in reader.directories():
        yield reader.page(tags)


def write_tiff(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | None]]) -> bytes:
    """A little-endian file of 8-bit grey pages ``(rows x columns, compression, predictor, tile size)``."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for pixels, kind, predictor, tile in pages:
        height, width = pixels.shape
        box_w, box_h = tile or (width, max(1, min(height, (1 << 16) // width)))
        at, sizes = [], []
        for y in range(0, height, box_h):
            for x in range(0, width, box_w):
                part = pixels[y : y + box_h, x : x + box_w]
                if tile and part.shape != (box_h, box_w):
                    part = np.pad(part, ((0, box_h - part.shape[0]), (0, box_w - part.shape[1])))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.uint8(0))
                raw = part.tobytes()
                coded = {NONE: bytes, PACKBITS: lambda r: packbits_encode(r, box_w), LZW: lzw_encode}.get(kind, lambda r: zlib.compress(r, 1))(raw)
                at.append(len(out))
                sizes.append(len(coded))
                out += coded
        out += b"\0" * (len(out) % 2)
        n = len(at)
        fields = [(WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, 8), (COMPRESSION, 3, kind), (PHOTOMETRIC, 3, 1), (SAMPLES, 3, 1), (PREDICTOR, 3, predictor)]
        lists = len(out)
        if n > 1:
            out += struct.pack(f"<{2 * n}I", *at, *sizes)
        where, length = (lists, lists + 4 * n) if n > 1 else (at[0], sizes[0])
        named = [(TILE_WIDTH, 4, box_w), (TILE_HEIGHT, 4, box_h)] if tile else [(STRIP_ROWS, 4, box_h)]
        entries = [(t, k, 1, v) for t, k, v in fields + named] + [(TILE_AT if tile else STRIP_AT, 4, n, where), (TILE_BYTES if tile else STRIP_BYTES, 4, n, length)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per page: ``key``, ``page`` from 0, its shape, bits, compression, and samples as bytes.

    A null or empty value gives no row.  A file that can't be read gives its readable pages and then one
    row with ``error`` set, the page's number, and nulls elsewhere.  Other columns are ignored.
    """
    names = ["page", "width", "height", "samples", "bits", "compression", "data", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(column)):
                data, page = data.as_py(), 0
                if not data:
                    continue
                pages = iter(()) if data is None else read_pages(data)
                while True:
                    row: dict = dict.fromkeys(names) | {"page": page}
                    try:
                        p = next(pages)
                        h, w, s = p.pixels.shape
                        row |= {"width": w, "height": h, "samples": s, "bits": p.bits, "compression": p.compression, "data": p.pixels.tobytes()}
                    except StopIteration:
                        break
                    except (ValueError, struct.error, zlib.error) as wrong:
                        row["error"] = str(wrong)
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(i, 1), *(pa.array([row[n]], t) for n, t in zip(names, [pa.int32()] * 6 + [pa.binary(), pa.string()]))], [key, *names])
                    if row["error"] is not None:
                        break
                    page += 1

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, page int, width int, height int, samples int, bits int, compression int, data binary, error string")


#: Pixels of a row, rows of a tile, and payload bytes that four pages hold at most.
ROW, TILE_ROWS, PAGES_BYTES = 16, 64, 1 << 20
#: The four pages that every payload goes through: compression, predictor and tiles.
KINDS = ((PACKBITS, 1, None), (LZW, 2, None), (DEFLATE, 1, None), (DEFLATE, 2, (ROW, TILE_ROWS)))


def store_payload(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as pages of 16-pixel rows.

    Whatever its size, a quarter each goes to strips packed by PackBits, to strips of LZW with the horizontal
    predictor, to deflated strips, and to deflated tiles with the predictor; more than 1 MiB is stored in
    sections of that size, four pages each.
    """
    pages: list[tuple[np.ndarray, int, int, tuple[int, int] | None]] = []
    for at in range(0, len(payload), PAGES_BYTES):
        image = np.frombuffer(payload[at : at + PAGES_BYTES], np.uint8).reshape(4, -1, ROW)
        pages += [(quarter, *kind) for quarter, kind in zip(image, KINDS)]
    return write_tiff(pages)


def feature(pages: list[np.ndarray]) -> str:
    """Pages, size, mean, deviation and entropy of the samples that were read."""
    count = np.sum([np.bincount(p.ravel(), minlength=256) for p in pages], axis=0)
    n = int(count.sum())
    share = count[count > 0] / n
    level = np.arange(256)
    mean = float((count * level).sum() / n)
    spread = float((count * (level - mean) ** 2).sum() / n) ** 0.5
    return f"pages={len(pages)};size={ROW}x{n // ROW};mean={mean:.4f};std={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as a TIFF, read the file back page by page, and describe what was read.

    A null or empty text is 64 zero bytes.  Equal texts give equal values, repeated rows each give a row,
    and other columns are ignored.  Texts of any length are stored whole, on as many pages as they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches):
            data, off = ragged.texts(batch.column("text"))
            raw, ends, rows = data.tobytes(), off.tolist(), []
            for a, b in zip(ends, ends[1:]):
                size = max(64, -(-(b - a) // 64) * 64)
                media = store_payload(raw[a:b] + b"\0" * (size - (b - a)))
                pages = [p.pixels for p in read_pages(media)]
                back = b"".join(p.tobytes() for p in pages)
                rows.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
