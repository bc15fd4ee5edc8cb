"""Media columns held as baseline JPEG.

``encode`` stores bytes losslessly as quantised DCT coefficients, one byte a
coefficient, three 64-coefficient blocks (Y, Cb, Cr) a unit; ``decode`` parses
markers and Huffman-decodes the scan of any baseline JPEG. Restart intervals
are decoded side by side in numpy, so work is done a symbol at a time for all
intervals of a batch at once. Thumbnails come from the luminance DC terms alone.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, spread

#: Bytes of a unit: three blocks of 64 coefficients.
UNIT = 192
#: Units that are coded or decoded side by side.
LANES = 1 << 14
PACKED = 1 << 12

# Symbols of the Huffman tables by code length. Symbol s codes a
# coefficient of s bits after no zeros (0: no more coefficients, or a DC step of 0).
CODE_COUNTS = [0, 3, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]
CODE_SYMBOLS = [1, 2, 3, 4, 5, 6, 7, 8, 0]

#: Bytes from the commonest in UTF-8 prose to the rarest; rank gives the size of the coefficient.
_COMMON = b" etaonihsrdlucmgfpwbvykxqjz\n.,0123456789-'\"!?():;/_|*%$#&@+=<>[]{}~^`\\\xc3\xa9\xa8\xaa\xa4\xb6\xbc\x9f\xb1\xb3\xad\xa1ETAONIHSRDLUCMGFPWBVYKXQJZ"
BY_RANK = np.frombuffer(_COMMON + bytes(b for b in range(256) if b not in _COMMON), np.uint8)
#: Coefficients by rank: 1, -1, 2, -2, ... so that none is 0.
VALUE_OF_RANK = np.array([(r // 2 + 1) * (1 if r % 2 == 0 else -1) for r in range(256)], np.int16)
VALUE_OF_BYTE = np.empty(256, np.int16)
VALUE_OF_BYTE[BY_RANK] = VALUE_OF_RANK
BYTE_OF_VALUE = np.zeros(257, np.uint8)
BYTE_OF_VALUE[VALUE_OF_RANK + 128] = BY_RANK


def huffman_codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in the canonical order of the format."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out.append((symbol, code, length))
            code += 1
        at += n
        code <<= 1
    return out


def _coders() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each byte's symbol and magnitude, which of the 16 places they fill, and their number.

    Entries 256 to 263 are 0 to 7 set bits, which fill up the last byte of an interval.
    """
    code = {s: (c, n) for s, c, n in huffman_codes(CODE_COUNTS, CODE_SYMBOLS)}
    text = []
    for byte in range(256):
        value = int(VALUE_OF_BYTE[byte])
        size = abs(value).bit_length()
        extra = value if value > 0 else value + (1 << size) - 1
        text.append(format(code[size][0] << size | extra, f"0{code[size][1] + size}b"))
    text += ["1" * n for n in range(8)]
    bits = np.array([[c == "1" for c in t.ljust(16, "0")] for t in text], np.uint8)
    width = np.array([len(t) for t in text])
    return bits, np.arange(16) < width[:, None], width


BITS, FILLED, WIDTH = _coders()
_EMPTY = {s: (c, n) for s, c, n in huffman_codes(CODE_COUNTS, CODE_SYMBOLS)}[0]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, n_bytes: int) -> bytes:
    table = bytes(CODE_COUNTS) + bytes(CODE_SYMBOLS)
    parts = [
        b"\xff\xd8",
        _segment(0xFE, b"units %d" % n_bytes),
        _segment(0xDB, b"\x00" + bytes([8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x11\x00\x02\x11\x00\x03\x11\x00"),
        _segment(0xC4, b"\x00" + table + b"\x10" + table),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"),
    ]
    return b"".join(parts)


def _pack(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of rows of 192 bytes, rows one after another, and the length of each row."""
    bits = WIDTH[units].sum(axis=1)
    symbols = np.concatenate([units, (256 + -bits % 8)[:, None]], axis=1).reshape(-1)
    return np.packbits(BITS[symbols][FILLED[symbols]]), (bits + 7) >> 3


def _empty_unit() -> bytes:
    code, length = _EMPTY
    bits = 0
    for _ in range(6):
        bits = bits << length | code
    pad = -6 * length % 8
    return (bits << pad | (1 << pad) - 1).to_bytes((6 * length + pad) // 8, "big")


def shape_of(units: int) -> tuple[int, int]:
    """Columns and rows of blocks: nearly square."""
    across = min(math.isqrt(units - 1) + 1, 8191)
    return across, -(-units // across)


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of 192."""
    units = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    stuffed: list[bytes] = []
    for at in range(0, len(units), PACKED):
        coded, lengths = _pack(units[at : at + PACKED].astype(np.int16))
        raw = coded.tobytes()
        begin = 0
        for length in lengths.tolist():
            stuffed.append(raw[begin : begin + length].replace(b"\xff", b"\xff\x00"))
            begin += length
    blank = _empty_unit().replace(b"\xff", b"\xff\x00")
    out, at = [], 0
    for payload in payloads:
        n = len(payload) // UNIT
        across, down = shape_of(n)
        scan = stuffed[at : at + n] + [blank] * (across * down - n)
        at += n
        marks = [b"\xff" + bytes([0xD0 + i]) for i in range(8)]
        parts = [_head(across * 8, down * 8, len(payload))]
        for i, piece in enumerate(scan):
            if i:
                parts.append(marks[(i - 1) % 8])
            parts.append(piece)
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


@dataclass
class Header:
    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantisation table)
    tables: dict = field(default_factory=dict)
    quant: dict = field(default_factory=dict)
    order: list = field(default_factory=list)  # (component, DC table, AC table)
    interval: int = 0
    comment: bytes = b""
    scan: bytes = b""


def parse(media: bytes) -> Header:
    """Segments up to the scan, and the scan's bytes. Only baseline (SOF0) with one scan is read."""
    head, at = Header(), 2
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker = media[at + 1]
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            _, head.height, head.width, n = struct.unpack_from(">BHHB", body)
            head.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = list(body[i + 1 : i + 17])
                n = sum(counts)
                head.tables[body[i]] = lookup(tuple(counts), tuple(body[i + 17 : i + 17 + n]))
                i += 17 + n
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                head.quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int32)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xDD:
            head.interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            head.comment = body
        elif marker == 0xDA:
            head.order = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            break
    end = media.rfind(b"\xff\xd9")
    head.scan = media[at : end if end >= at else len(media)]
    return head


_LOOKUPS: dict = {}


def lookup(counts: tuple, symbols: tuple) -> np.ndarray:
    """For each 16-bit prefix, value << 16 | bits << 8 | symbol of the code and magnitude it starts with.

    ``bits`` is their number; where it is over 16 the value has to be read anew.
    """
    found = _LOOKUPS.get((counts, symbols))
    if found is None:
        found = np.zeros(1 << 16, np.int32)
        for symbol, code, length in huffman_codes(list(counts), list(symbols)):
            size = symbol & 15
            low = np.arange(1 << (16 - length))
            extra = low >> max(16 - length - size, 0)
            value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            value = value if length + size <= 16 else np.zeros_like(low)
            found[code << (16 - length) : (code + 1) << (16 - length)] = value << 16 | (length + size) << 8 | symbol
        _LOOKUPS[counts, symbols] = found
    return found


def _intervals(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and restart markers, and the first byte of each interval."""
    raw = np.frombuffer(scan, np.uint8)
    lead = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) > 1 else np.empty(0, np.int64)
    after = raw[lead + 1] if len(lead) else raw[:0]
    keep = np.ones(len(raw), bool)
    keep[lead[after == 0] + 1] = False
    marks = lead[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = False
    keep[marks + 1] = False
    place = np.cumsum(keep)
    return raw[keep], np.concatenate([[0], place[marks]])


def _blocks(head: Header) -> list[tuple[int, int, int]]:
    """(component, DC table, AC table) of each block of an MCU."""
    sizes = {c[0]: (i, c[1] * c[2]) for i, c in enumerate(head.components)}
    out = []
    for component, dc, ac in head.order:
        i, n = sizes[component]
        out += [(i, dc, 0x10 | ac)] * (n if len(head.order) > 1 else 1)
    return out


def decode_scans(heads: list[Header]) -> list[np.ndarray]:
    """Quantised coefficients in zigzag order, (MCUs, blocks of an MCU, 64), of JPEGs with equal tables."""
    first = heads[0]
    layout = _blocks(first)
    streams, begins, lanes, mcus = [], [], [], []
    total = 0
    for head in heads:
        h_max, v_max = max(c[1] for c in head.components), max(c[2] for c in head.components)
        if len(head.components) == 1:
            h_max = v_max = 1
        n = -(-head.width // (8 * h_max)) * -(-head.height // (8 * v_max))
        stream, begin = _intervals(head.scan)
        step = head.interval or n
        count = -(-n // step)
        if len(begin) < count:
            raise ValueError("restart intervals are missing")
        begins.append(begin[:count] + total)
        streams.append(stream)
        total += len(stream)
        lanes.append(np.minimum(step, n - step * np.arange(count)))
        mcus.append(n)
    stream = np.concatenate([*streams, np.full(8, 0xFF, np.uint8)])
    window = np.zeros(len(stream) - 3, np.uint32)
    for k in range(4):
        window = window << np.uint32(8) | stream[k : len(stream) - 3 + k]
    at = np.concatenate(begins).astype(np.int64) << 3
    left = np.concatenate(lanes)
    units = int(left.sum())
    out = np.zeros(units * len(layout) * 64, np.int16)
    row = np.cumsum(left) - left
    before = np.zeros((len(left), len(first.components)), np.int32)
    for turn in range(int(left.max())):
        live = np.flatnonzero(left > turn)
        for b, (component, dc, ac) in enumerate(layout):
            cell = ((row[live] + turn) * len(layout) + b) * 64
            bits = at[live]
            bits, step, _ = _symbol(window, stream, bits, first.tables[dc])
            before[live, component] += step
            out[cell] = before[live, component]
            lane, k = live, 1
            while len(lane):
                bits, value, symbol = _symbol(window, stream, bits, first.tables[ac])
                if not symbol.all():
                    going = symbol != 0
                    at[lane[~going]] = bits[~going]
                    lane, cell, bits, value, symbol = (x[going] for x in (lane, cell, bits, value, symbol))
                    k = k[going] if isinstance(k, np.ndarray) else k
                # Lanes share the place k until one of them codes a run of zeros.
                shift = symbol >> 4
                if isinstance(k, np.ndarray) or shift.any():
                    k = k + shift
                    put = ((symbol & 15) > 0) & (k < 64)
                    out[cell[put] + k[put]] = value[put]
                    k = k + 1
                    done = k >= 64
                    if done.any():
                        at[lane[done]] = bits[done]
                        lane, cell, bits, k = lane[~done], cell[~done], bits[~done], k[~done]
                else:
                    out[cell + k] = value
                    k += 1
                    if k == 64:
                        at[lane] = bits
                        break
    cut = np.cumsum(mcus)[:-1]
    return np.split(out.reshape(units, len(layout), 64), cut)


def _symbol(
    window: np.ndarray, stream: np.ndarray, at: np.ndarray, table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next bit, value of the magnitude bits, symbol) read at bit ``at`` of each lane."""
    word = window[np.minimum(at >> 3, len(window) - 1)]
    found = table[(word >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)]
    bits, symbol, value = found >> 8 & 0xFF, found & 0xFF, found >> 16
    if (long := bits > 16).any():
        value = value.copy()
        for i in np.flatnonzero(long):
            size = int(symbol[i] & 15)
            end = int(at[i] + bits[i])
            piece = int.from_bytes(stream[(end - size) // 8 : end // 8 + 1].tobytes(), "big")
            extra = piece >> (8 * (end // 8 + 1) - end) & ((1 << size) - 1)
            value[i] = extra if extra >> (size - 1) else extra - (1 << size) + 1
    return at + bits, value, symbol


def thumbnail(head: Header, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of 8x8 blocks from their DC terms, (rows, columns) of 0 to 255.

    The blocks of an MCU are put where its sampling places them; blocks beyond
    the picture are cut off.
    """
    _, h, v, q = head.components[0]
    if len(head.components) == 1:
        h = v = 1
    h_max = max(c[1] for c in head.components) if len(head.components) > 1 else 1
    v_max = max(c[2] for c in head.components) if len(head.components) > 1 else 1
    across, down = -(-head.width // (8 * h_max)), -(-head.height // (8 * v_max))
    dc = coefficients[:, : h * v, 0].astype(np.int32) * int(head.quant[q][0])
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grid = grid[: -(-head.height * v // (8 * v_max)), : -(-head.width * h // (8 * h_max))]
    return np.clip((grid >> 3) + 128, 0, 255).astype(np.uint8)


def difference_hash(picture: np.ndarray) -> str:
    """64 bits: whether brightness falls between neighbours in an 8 x 9 shrinking of the picture."""
    sums = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1), np.int64)
    sums[1:, 1:] = picture.astype(np.int64).cumsum(0).cumsum(1)

    def cuts(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(parts) * n // parts
        return low, np.maximum(low + 1, (np.arange(parts) + 1) * n // parts)

    y0, y1 = cuts(picture.shape[0], 8)
    x0, x1 = cuts(picture.shape[1], 9)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    mean = (sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]) / area
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def payload_of(text: bytes | None) -> bytes:
    """The bytes with blanks up to a positive multiple of 192."""
    text = text or b""
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def _media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(1)]
        media = encode_all([payload_of(t) for t in texts]) if texts else []
        yield pa.record_batch(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a JPEG, written to the shared folder and read back.

    A null text counts as empty, whose payload is 192 blanks. Equal texts give
    equal media.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return materialise(slim.mapInArrow(_media_batches, "doc_id long, n_bytes long, media binary"), "media")


def _groups(heads: list[Header]) -> Iterator[list[int]]:
    """Consecutive pictures with equal tables and layout, about ``LANES`` intervals at once."""
    group: list[int] = []
    held = 0
    kind = None
    for i, head in enumerate(heads):
        lanes = -(-head.width // 8) * -(-head.height // 8) // max(head.interval, 1) + 1 if head.interval else 1
        own = (tuple((k, id(t)) for k, t in sorted(head.tables.items())), tuple(head.order), tuple(c[1:3] for c in head.components))
        if group and (own != kind or held + lanes > LANES):
            yield group
            group, held = [], 0
        kind = own
        group.append(i)
        held += lanes
    if group:
        yield group


def read_back(media: list[bytes]) -> Iterator[tuple[Header, np.ndarray]]:
    """Header and coefficients of each picture, decoded in groups."""
    heads = [parse(m) for m in media]
    for group in _groups(heads):
        chosen = [heads[i] for i in group]
        yield from zip(chosen, decode_scans(chosen), strict=True)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature")}
        media = [m.as_py() for m in batch.column(2)]
        for body, (head, coefficients) in zip(media, read_back(media), strict=True):
            n = int(head.comment.split()[1])
            payload = BYTE_OF_VALUE[coefficients.reshape(-1)[:n] + 128].tobytes()
            rows["payload_bytes"].append(n)
            rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(payload[-16:]))
            rows["media_bytes"].append(len(body))
            rows["media_sha256"].append(hashlib.sha256(body).hexdigest())
            rows["width"].append(head.width)
            rows["height"].append(head.height)
            rows["feature"].append(f"{head.width}x{head.height}:{difference_hash(thumbnail(head, coefficients))}")
        kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "width": pa.int32(), "height": pa.int32()}
        yield pa.record_batch(
            [batch.column(0), batch.column(1), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]],
            names=["doc_id", "n_bytes", *rows],
        )


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, width int, height int, feature string"
)


def media_features(stored: DataFrame) -> DataFrame:
    """Digests of what the stored media hold, their dimensions and their thumbnails' hash."""
    return stored.mapInArrow(_feature_batches, FEATURES)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form of each row of ``documents``; null and empty texts are one unit of blanks, equal texts have equal values."""
    return media_features(store(spread(documents(spark, sf_dir))))
