"""GIF media: LZW code streams, palettes, interlace, disposal, transparency, timed frames and colour histograms.

`encode_frames`/`decode_frames` are the format; `gif_column` stores byte payloads as GIF files in a DataFrame column and
`gif_frames` turns a column of GIF files into one row per frame. A frame's canvas is what a viewer shows: the frame
drawn on what the frame before left after its disposal. A payload is kept as the samples of 8-bit images of 64 columns
with a palette of 256 greys (sample i has the colour i, i, i), in as many frames as the format's height needs.

Nulls: a null payload is the empty payload; a null or broken GIF gives no frame row and one row with `error` set.
Equal payloads give equal files.
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

from tessella.llm.common import small_batches

COLUMNS = 64
FRAME_ROWS = 1024
DELAY_CS = 10
MAX_CODES = 4096
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
FRAMES = "doc_id long, frame int, delay_cs int, disposal int, width int, height int, transparent int, canvas binary, histogram array<long>, error string"


def code_widths(least: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: a code is as wide as the largest entry known when it is read."""
    largest = (1 << least) + 1 + np.arange(n)
    return np.clip(np.floor(np.log2(largest)).astype(np.int64) + 1, least + 1, 12)


WIDTHS = {least: code_widths(least, MAX_CODES + 2) for least in range(2, 9)}


def pack_codes(codes: list[int], widths: np.ndarray) -> np.ndarray:
    """The bits of the codes, lowest first."""
    c, bits = np.asarray(codes, np.uint16), []
    ends = [*np.flatnonzero(np.diff(widths)) + 1, len(c)]
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        w = int(widths[a])
        bits.append((np.unpackbits(c[a:b].astype("<u2").view(np.uint8), bitorder="little").reshape(-1, 16))[:, :w].ravel())
    return np.concatenate(bits)


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    bits: list[np.ndarray] = []
    first = (MAX_CODES - clear - 2) + 1  # codes until the table is full
    known: dict[int, int] = {}
    get, codes, entry, prefix = known.get, [], clear + 2, -1
    for s in samples:
        if prefix < 0:
            prefix = s
            continue
        key = prefix << 8 | s
        found = get(key)
        if found is not None:
            prefix = found
            continue
        codes.append(prefix)
        prefix = s
        if entry < MAX_CODES:
            known[key] = entry
            entry += 1
        if len(codes) == first:
            codes.append(clear)
            bits.append(pack_codes(codes, WIDTHS[least][: len(codes)]))
            codes, entry = [], clear + 2
            known.clear()
    if prefix >= 0:
        codes.append(prefix)
    codes.append(end)
    bits.append(pack_codes(codes, WIDTHS[least][: len(codes)]))
    head = pack_codes([clear], np.array([least + 1]))
    return np.packbits(np.concatenate([head, *bits]), bitorder="little").tobytes()


def lzw_decode(data: bytes, least: int, n: int) -> bytes:
    """At most n samples of a code stream; clear codes may come at any place, a full table stays as it is."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    clear, end = 1 << least, (1 << least) + 1
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    widths = WIDTHS[least]
    ends = np.cumsum(widths)
    out: list[bytes] = []
    at, made, table, prev = 0, 0, singles.copy(), b""
    since = 0  # codes since the last clear
    while made < n:
        # As many codes as the widths from here on tell, up to the next clear or end code.
        if since < len(widths):
            w, e = widths[since:], ends[since:] - (ends[since - 1] if since else 0)
        else:
            w, e = np.full(4096, 12), np.arange(1, 4097) * 12
        m = int(np.searchsorted(e, len(bits) - at, side="right"))
        if not m:
            break
        w, e = w[:m], e[:m]
        codes = np.empty(m, np.int64)
        cuts = [0, *np.flatnonzero(np.diff(w)) + 1, m]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(w[a])
            lo = at + (int(e[a - 1]) if a else 0)
            codes[a:b] = bits[lo : lo + (b - a) * k].reshape(-1, k) @ (1 << np.arange(k, dtype=np.int64))
        special = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(special[0]) if len(special) else m
        size, done = len(table), len(out)
        for c in codes[:stop].tolist():
            if c < size:
                entry = table[c]
            elif prev and c == size:
                entry = prev + prev[:1]
            else:
                raise ValueError("a code beyond the table")
            out.append(entry)
            if prev and size < MAX_CODES:
                table.append(prev + entry[:1])
                size += 1
            prev = entry
        made += sum(map(len, out[done:]))
        since += stop
        if len(special):
            at += int(e[stop])
            if codes[stop] == end:
                break
            table, prev, since = singles.copy(), b"", 0
        else:
            at += int(e[m - 1])
    return b"".join(out)[:n]


def blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


def encode_frames(frames: list[tuple[np.ndarray, int]], palette: np.ndarray = GREYS) -> bytes:
    """An animated GIF of (indices [rows, columns], delay in 1/100 s) frames with one palette of 2 to 256 colours."""
    power = max(1, int(len(palette) - 1).bit_length())
    table = np.zeros((1 << power, 3), np.uint8)
    table[: len(palette)] = palette
    height, width = max(f.shape[0] for f, _ in frames), max(f.shape[1] for f, _ in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | (power - 1), 0, 0), table.tobytes()]
    least = max(2, power)
    for f, delay in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + bytes([least]))
        out.append(blocks(lzw_encode(f.astype(np.uint8).tobytes(), least)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    delay_cs: int
    disposal: int
    transparent: int
    box: tuple[int, int, int, int]  # left, top, width, height
    canvas: np.ndarray  # rows, columns, RGBA as shown

    def drawn(self) -> np.ndarray:
        left, top, width, height = self.box
        return self.canvas[top : top + height, left : left + width]


def decode_frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as shown, one after the other."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n

    def read_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, -1
    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            return
        if mark == 0x21:
            label = data[at + 1]
            body, at = read_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            continue
        if mark != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("no palette")
        least = data[at]
        if not 2 <= least <= 8:
            raise ValueError("a code size out of range")
        body, at = read_blocks(at + 1)
        samples = np.frombuffer(lzw_decode(body, least, w * h), np.uint8)
        if len(samples) < w * h:
            raise ValueError("too few samples")
        index = samples.reshape(h, w)
        if flags & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            whole = np.empty_like(index)
            whole[order] = index
            index = whole
        if left + w > canvas.shape[1] or top + h > canvas.shape[0]:
            raise ValueError("a frame beyond the screen")
        before = canvas.copy() if disposal == 3 else None
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(palette), :3] = palette
        colours[:, 3] = 255
        area = canvas[top : top + h, left : left + w]
        if transparent < 0:
            area[...] = colours[index]
        else:
            seen = index != transparent
            area[seen] = colours[index[seen]]
        yield Frame(delay, disposal, transparent, (left, top, w, h), canvas.copy())
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, -1


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of visible pixels in 4 x 4 x 4 bins of red, green and blue."""
    p = rgba.reshape(-1, 4)
    p = p[p[:, 3] > 0] >> 6
    return np.bincount(p[:, 0].astype(np.int64) * 16 + p[:, 1] * 4 + p[:, 2], minlength=64)


def payload(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 if data else 64)


def store(data: bytes) -> bytes:
    """A payload of 64 n bytes as a GIF."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, COLUMNS)
    return encode_frames([(rows[i : i + FRAME_ROWS], DELAY_CS) for i in range(0, len(rows), FRAME_ROWS)])


def read_back(media: bytes) -> tuple[bytes, np.ndarray, int, int]:
    """Payload, colour histogram, frames and shown time of a stored GIF."""
    parts, counts, n, time = [], np.zeros(64, np.int64), 0, 0
    for f in decode_frames(media):
        parts.append(np.ascontiguousarray(f.drawn()[:, :, 0]).tobytes())
        counts += histogram(f.drawn())
        n, time = n + 1, time + f.delay_cs
    return b"".join(parts), counts, n, time


def gif_column(docs: DataFrame, data: str = "data") -> DataFrame:
    """doc_id, n_bytes and the GIF that stores the binary (or text) column `data`, padded to whole rows of 64."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([store(payload(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(data).cast("binary").alias("data")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def gif_frames(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per frame of a column of GIF files: timing, disposal, canvas (RGBA) and colour histogram."""
    small_batches(files.sparkSession, 100)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FRAMES.split(", ")]
        kinds = [pa.int64()] + [pa.int32()] * 6 + [pa.binary(), pa.list_(pa.int64()), pa.string()]
        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for k, f in enumerate(decode_frames(data or b"")):
                        rows.append((doc_id, k, f.delay_cs, f.disposal, f.canvas.shape[1], f.canvas.shape[0], f.transparent, f.canvas.tobytes(), histogram(f.canvas).tolist(), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((doc_id, len(rows), None, None, None, None, None, None, None, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(media).alias("media")).mapInArrow(decode, FRAMES)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, shown_cs int, histogram array<long>"


def digests(files: DataFrame) -> DataFrame:
    """Digests and features of files made by `gif_column`, from the stored bytes read back."""
    small_batches(files.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int32()] * 2 + [pa.list_(pa.int64())]
        for b in batches:
            rows = []
            for doc_id, n, media in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data, counts, frames, time = read_back(media)
                feature = hashlib.sha256(counts.astype("<i8").tobytes()).hexdigest()[:16]
                feature = f"gif:{frames}x{COLUMNS}x{len(data) // COLUMNS}:{int(counts.argmax())}:{feature}"
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames, time, counts.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(digest, DIGEST)
