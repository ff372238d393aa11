"""Media columns: AVI motion-JPEG written, parsed and cut into timed clips.

Storing. A payload of bytes becomes grey frames of 64 blocks of 8 x 8 pixels;
every byte is the grey level of one block. With a quantiser of 8 for the mean of
a block, the mean's coefficient is the level less 128, so baseline JPEG keeps
each byte exactly. Frames carry their own (short) Huffman tables: each is a
complete baseline JPEG. They lie in the `movi` list of a RIFF file, one chunk a
frame, with an `idx1` index.

Reading. The RIFF chunks are walked to the index, the index gives the frames (by
offsets from the `movi` list or the file's start; without an index the list is
walked). Frames whose headers are those written here are entropy-decoded side by
side, one block at a time. Any other baseline JPEG is decoded by the tables that
its own markers give, to the grey level of each pixel; what is not baseline, or
lacks a table, is an error.

Shots. Each frame has a histogram of 16 levels; the difference between
neighbours is compared with a threshold that adapts to the differences around
it. Clips run from one cut to the next and are timed by the frame rate.

Nulls and edge cases: a null text is an empty one; an empty text is one frame of
zeros; long texts are coded and decoded a bounded number of frames at a time;
one RIFF file holds 2**31 bytes, which is more than a Spark string can fill;
a null medium has no clips; repeated rows give repeated results; a change that
only equals its threshold is no cut; only `doc_id` and `text` (or `media`) are
read, so further columns of any name do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .bpe import slices
from .common import read

UNIT = 64
SIDE = 64
MICROS_PER_FRAME = 40_000
#: Frames coded or decoded at a time.
FRAMES = 8_192
LEVELS = 16
#: A cut differs by this many deviations from the mean of the differences around it, and by this share of a frame.
DEVIATIONS, AROUND, LEAST = 2.0, 8, 0.25

#: JPEG's standard code lengths for the size of a grey level's difference, sizes 0 to 8.
CODE_LENGTHS = [2, 3, 3, 3, 3, 3, 4, 5, 6]


def _codes() -> list[int]:
    """The canonical codes of those lengths."""
    codes, code, was = [], 0, CODE_LENGTHS[0]
    for length in CODE_LENGTHS:
        code <<= length - was
        codes.append(code)
        code, was = code + 1, length
    return codes


CODES = _codes()


def _jpeg_head() -> bytes:
    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    counts = bytes(CODE_LENGTHS.count(n) for n in range(1, 17))
    return (
        b"\xff\xd8"
        + part(0xDB, b"\0" + b"\x08" + b"\x01" * 63)
        + part(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
        + part(0xC4, b"\x00" + counts + bytes(range(9)))
        + part(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")  # one code: no further coefficients
        + part(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


HEAD, TAIL = np.frombuffer(_jpeg_head(), np.uint8), np.frombuffer(b"\xff\xd9", np.uint8)


def _tables() -> tuple[np.ndarray, ...]:
    """Code and number of bits of each difference -255..255, end of block included; and the inverse over 15 bits."""
    code, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    back, taken = np.zeros(1 << 15, np.int16), np.zeros(1 << 15, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << size) - 1
        code[d + 255] = ((CODES[size] << size) | (extra if size else 0)) << 1  # the end of the block is a 0
        bits[d + 255] = n = CODE_LENGTHS[size] + size + 1
        at = int(code[d + 255]) << (15 - n)
        back[at : at + (1 << (15 - n))], taken[at : at + (1 << (15 - n))] = d, n
    return code, bits, back, taken


CODE, BITS, BACK, TAKEN = _tables()


def _scatter(out: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
    """Put runs of `values`, of the given lengths, at `starts` in `out`."""
    before = np.cumsum(lengths) - lengths
    out[np.arange(len(values)) + np.repeat(starts - before, lengths)] = values


def encode_frames(levels: np.ndarray) -> tuple[bytes, np.ndarray]:
    """AVI chunks of frames (n, 64), joined, and the size of each JPEG."""
    n = len(levels)
    signed = levels.astype(np.int64) - 128
    step = np.diff(signed, axis=1, prepend=0) + 255
    step[:, 0] = signed[:, 0] + 255
    code, bits = CODE[step], BITS[step]
    ends = np.cumsum(bits, axis=1)
    room = -(-ends[:, -1] // 8)  # bytes of each frame before stuffing
    first = np.cumsum(room) - room
    at = (ends - bits) + first[:, None] * 8
    word = code << (32 - bits - (at & 7))
    total, byte = int(room.sum()), (at >> 3).ravel()
    packed = np.zeros(total + 4)
    for k in range(3):  # 15 bits from any bit on lie in three bytes
        packed += np.bincount(byte + k, (word.ravel() >> (24 - 8 * k)) & 255, minlength=total + 4)
    packed = packed[:total].astype(np.uint8)
    packed[first + room - 1] |= ((1 << (-ends[:, -1] & 7)) - 1).astype(np.uint8)  # padded with ones
    full = packed == 255
    stuffed = np.repeat(packed, 1 + full)
    where = np.flatnonzero(full)
    stuffed[where + np.arange(1, len(where) + 1)] = 0
    lengths = room + np.add.reduceat(full.astype(np.int64), first)
    sizes = len(HEAD) + lengths + len(TAIL)
    spans = 8 + sizes + (sizes & 1)
    starts = np.cumsum(spans) - spans
    out = np.zeros(int(spans.sum()), np.uint8)
    chunk = np.zeros((n, 8), np.uint8)
    chunk[:, :4] = np.frombuffer(b"00dc", np.uint8)
    chunk[:, 4:] = sizes.astype("<u4")[:, None].view(np.uint8)
    out[starts[:, None] + np.arange(8)] = chunk
    out[starts[:, None] + 8 + np.arange(len(HEAD))] = HEAD
    _scatter(out, starts + 8 + len(HEAD), lengths, stuffed)
    out[(starts + 8 + sizes - 2)[:, None] + np.arange(2)] = TAIL
    return out.tobytes(), sizes


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body


def avi(chunks: bytes, sizes: np.ndarray) -> bytes:
    """A RIFF file of coded frames, with headers and an index."""
    n = len(sizes)
    largest = int(sizes.max())
    head = struct.pack("<14I", MICROS_PER_FRAME, largest * 1_000_000 // MICROS_PER_FRAME, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, MICROS_PER_FRAME, 1_000_000, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", head) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    spans = 8 + sizes + (sizes & 1)
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(spans) - spans, sizes
    body = b"AVI " + header + _list(b"movi", chunks) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def frames_of(media: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Parse a RIFF file: where each frame's JPEG starts, its size, and microseconds a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, end, index, micros = 12, -1, 0, b"", 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi, end = at + 8, at + 8 + size
        elif kind == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            micros = struct.unpack_from("<I", media, at + 20)[0]
        elif kind == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi < 0:
        raise ValueError("no movi list")
    entries = np.frombuffer(index, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    # pictures of any stream: compressed or not, JPEG all the same
    entries = entries[np.char.endswith(entries["id"], b"dc") | np.char.endswith(entries["id"], b"db")]
    if not index:
        starts, sizes, at = [], [], movi + 4
        while at + 8 <= end:
            kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if kind[2:] in (b"dc", b"db"):
                starts.append(at + 8)
                sizes.append(size)
            at += 12 if kind == b"LIST" else 8 + size + (size & 1)  # a rec list is entered
        return np.array(starts, np.int64), np.array(sizes, np.int64), micros
    starts = entries["at"].astype(np.int64) + 8
    if not len(starts) or media[movi + starts[0] - 8 : movi + starts[0] - 4] == entries["id"][0]:
        starts += movi
    return starts, entries["size"].astype(np.int64), micros


def decode_frames(media: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Grey levels (n, 64) of the JPEGs at `starts` of a buffer."""
    n = len(starts)
    lengths = sizes - len(HEAD) - len(TAIL)
    begin = np.cumsum(lengths) - lengths
    raw = media[np.arange(int(lengths.sum())) + np.repeat(starts + len(HEAD) - begin, lengths)]
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
    skipped = np.cumsum(stuffed)
    data = np.concatenate([raw[~stuffed], np.zeros(4, np.uint8)]).astype(np.uint32)
    word = data[:-3] << 16 | data[1:-2] << 8 | data[2:-1]
    at = (begin - skipped[begin]) * 8
    out, level = np.empty((n, UNIT), np.int16), np.full(n, 128, np.int16)
    for k in range(UNIT):
        bits = (word[at >> 3] >> (9 - (at & 7)).astype(np.uint32)) & 0x7FFF
        level = level + BACK[bits]
        taken = TAKEN[bits]
        if not taken.all() or level.min(initial=0) < 0 or level.max(initial=0) > 255:
            raise ValueError("broken frame")
        at += taken
        out[:, k] = level
    return out.astype(np.uint8)


def _zigzag() -> np.ndarray:
    """Where the coefficients of a block lie, row by row, in the order they are stored."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else -c[0]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: The cosine transform of eight samples.
COSINES = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that each 16 bits begin with; length 0 where none does."""
    length, symbol, at, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << (16 - bits)
            length[at : at + span], symbol[at : at + span] = bits, symbols[k]
            at, k = at + span, k + 1
    return length, symbol


@dataclass
class Header:
    """What the markers of a baseline JPEG say."""

    height: int
    width: int
    parts: list[tuple[int, int, int, int]]  # component, sampling across and down, quantiser
    quantisers: dict[int, np.ndarray]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    chosen: dict[int, tuple[int, int]]  # tables of a component: mean, others
    interval: int
    scan: int  # where the coded data start


def header_of(jpeg: bytes) -> Header:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    found, at = Header(0, 0, [], {}, {}, {}, 0, 0), 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                found.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else ">u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                found.tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError(f"{body[0]} bits a sample are not supported")
            found.height, found.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            found.parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG is supported")
        elif marker == 0xDD:
            found.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            found.chosen = {body[k]: (body[k + 1] >> 4, 0x10 | (body[k + 1] & 15)) for k in range(1, 1 + 2 * body[0], 2)}
            found.scan = at
            break
    missing = [p for p in found.parts if p[3] not in found.quantisers or any(t not in found.tables for t in found.chosen.get(p[0], (-1, -1)))]
    if not found.scan or not found.parts or missing:
        raise ValueError("a frame, a scan or a table is missing")
    return found


def decode_jpeg(jpeg: bytes) -> np.ndarray:
    """Grey levels (height, width) of a baseline JPEG: its first component, at full sampling."""
    head = header_of(jpeg)
    most_h, most_v = max(p[1] for p in head.parts), max(p[2] for p in head.parts)
    if (head.parts[0][1], head.parts[0][2]) != (most_h, most_v):
        raise ValueError("a first component of lower sampling is not supported")
    if len(head.parts) == 1:
        most_h = most_v = 1  # a scan of one component goes block by block
    across, down = -(-head.width // (8 * most_h)), -(-head.height // (8 * most_v))
    end = jpeg.rfind(b"\xff\xd9")
    coded, runs, at = jpeg[head.scan : end if end >= 0 else len(jpeg)], [], 0
    for k in range(len(coded) - 1):
        if coded[k] == 0xFF and 0xD0 <= coded[k + 1] <= 0xD7:
            runs.append(coded[at:k])
            at = k + 2
    runs.append(coded[at:])
    grid = np.zeros((down * most_v, across * most_h, 64), np.int64)
    unit = 0
    for run in runs:
        data, bit = run.replace(b"\xff\x00", b"\xff") + b"\0" * 8, 0
        room, before = 8 * (len(data) - 8), dict.fromkeys((p[0] for p in head.parts), 0)

        def peek(n: int, bit: int, data: bytes = data) -> int:
            return int.from_bytes(data[bit >> 3 : (bit >> 3) + 4], "big") >> (32 - n - (bit & 7)) & ((1 << n) - 1)

        for _ in range(min(head.interval or across * down, across * down - unit)):
            for part, h, v, _q in head.parts:
                means, others = (head.tables[t] for t in head.chosen[part])
                single = len(head.parts) == 1
                for y in range(1 if single else v):
                    for x in range(1 if single else h):
                        block, k = np.zeros(64, np.int64), 0
                        while k < 64:
                            length, symbol = others if k else means
                            code = peek(16, bit)
                            if not length[code] or bit > room:
                                raise ValueError("broken frame")
                            bit += int(length[code])
                            skip, size = int(symbol[code]) >> 4, int(symbol[code]) & 15
                            if k and not size and skip < 15:
                                break
                            k += skip
                            extra = peek(size, bit) if size else 0
                            bit += size
                            if size and k < 64:
                                block[k] = extra if extra >> (size - 1) else extra - (1 << size) + 1
                            k += 1
                        before[part] += int(block[0])
                        block[0] = before[part]
                        if part == head.parts[0][0]:
                            grid[unit // across * most_v + y, unit % across * most_h + x] = block
            unit += 1
    if unit < across * down:
        raise ValueError("frame ends early")
    plain = np.zeros(grid.shape)
    plain[..., ZIGZAG] = grid * head.quantisers[head.parts[0][3]]
    squares = COSINES.T @ plain.reshape(*grid.shape[:2], 8, 8) @ COSINES
    pixels = squares.transpose(0, 2, 1, 3).reshape(8 * grid.shape[0], 8 * grid.shape[1])[: head.height, : head.width]
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)


def clips(levels: np.ndarray) -> list[tuple[int, int]]:
    """Frames [start, end) of each shot."""
    n = len(levels)
    if n < 2:
        return [(0, 1)] * n
    bins = np.bincount((np.arange(n)[:, None] * LEVELS + (levels >> 4)).ravel(), minlength=n * LEVELS).reshape(n, LEVELS)
    change = np.abs(np.diff(bins, axis=0)).sum(axis=1) / (2 * levels.shape[1])
    total, square = (np.concatenate([[0], np.cumsum(x)]) for x in (change, change * change))
    low, high = np.maximum(np.arange(n - 1) - AROUND, 0), np.minimum(np.arange(n - 1) + AROUND + 1, n - 1)
    mean = (total[high] - total[low]) / (high - low)
    spread = np.sqrt(np.maximum((square[high] - square[low]) / (high - low) - mean * mean, 0))
    cuts = np.flatnonzero((change > mean + DEVIATIONS * spread) & (change >= LEAST)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(payloads: list[bytes]) -> list[bytes]:
    """Media of payloads, the frames of all coded together."""
    counts = [len(p) // UNIT for p in payloads]
    levels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    parts, sizes = zip(*(encode_frames(levels[k : k + FRAMES]) for k in range(0, len(levels), FRAMES)), strict=True)
    chunks, sizes = b"".join(parts), np.concatenate(sizes)
    spans, out, at, frame = np.concatenate([[0], np.cumsum(8 + sizes + (sizes & 1))]), [], 0, 0
    for n in counts:
        end = int(spans[frame + n])
        out.append(avi(chunks[at:end], sizes[frame : frame + n]))
        at, frame = end, frame + n
    return out


def load(media: list[bytes]) -> list[np.ndarray]:
    """The frames (n, cells) of media: 64 blocks of those written here, all decoded together, or else the pixels."""
    parsed, base = [frames_of(m) for m in media], 0
    foreign = [k for k, (m, p) in enumerate(zip(media, parsed, strict=True)) if not _written_here(m, p[0], p[1])]
    if foreign:
        known = iter(load([m for k, m in enumerate(media) if k not in foreign]) if len(foreign) < len(media) else [])
        return [_pixels(m, p[0], p[1]) if k in foreign else next(known) for k, (m, p) in enumerate(zip(media, parsed, strict=True))]
    starts, sizes = [], np.concatenate([p[1] for p in parsed])
    for m, p in zip(media, parsed, strict=True):
        starts.append(p[0] + base)
        base += len(m)
    whole, starts = np.frombuffer(b"".join(media), np.uint8), np.concatenate(starts)
    levels = np.concatenate([decode_frames(whole, starts[k : k + FRAMES], sizes[k : k + FRAMES]) for k in range(0, len(starts), FRAMES)])
    return np.split(levels, np.cumsum([len(p[0]) for p in parsed])[:-1])


def _written_here(media: bytes, starts: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether all frames have the header that `encode_frames` writes."""
    if not len(starts) or (sizes < len(HEAD) + len(TAIL)).any() or int((starts + sizes).max()) > len(media):
        return False
    whole, head, wide = np.frombuffer(media, np.uint8), np.arange(len(HEAD)), 4096
    return all((whole[starts[k : k + wide, None] + head] == HEAD).all() for k in range(0, len(starts), wide))


def _pixels(media: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    frames = [decode_jpeg(media[a : a + n]).ravel() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    if len({len(f) for f in frames}) > 1:
        raise ValueError("frames of different sizes")
    return np.stack(frames) if frames else np.zeros((0, UNIT), np.uint8)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): each text as a motion-JPEG file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in slices(batch, 500_000):
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "media": store([padded(x) for x in rows["text"]])})

    return docs.select("doc_id", "text").mapInPandas(run, schema=f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """(doc_id, clip, first_frame, n_frames, start_ms, end_ms, mean_level) of (doc_id, media): a row for each shot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, one in zip(batch["doc_id"], batch["media"], strict=True):
                if one is None:
                    continue
                levels, micros = load([one])[0], frames_of(one)[2]
                cut = clips(levels)
                yield pd.DataFrame(
                    {
                        "doc_id": [doc_id] * len(cut),
                        "clip": range(len(cut)),
                        "first_frame": [a for a, _ in cut],
                        "n_frames": [b - a for a, b in cut],
                        "start_ms": [a * micros / 1000 for a, _ in cut],
                        "end_ms": [b * micros / 1000 for _, b in cut],
                        "mean_level": [float(levels[a:b].mean()) for a, b in cut],
                    }
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInPandas(run, schema=f"doc_id {kind}, clip int, first_frame int, n_frames int, start_ms double, end_ms double, mean_level double")


def digests(docs: DataFrame) -> DataFrame:
    """What the stored media say of each text; clips are given as start-end in milliseconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, 500_000):
                payloads = [padded(x) for x in part["text"]]
                media, rows = store(payloads), []
                for text, one, levels in zip(part["text"], media, load(media), strict=True):
                    raw, cut = levels.tobytes(), clips(levels)
                    ms = MICROS_PER_FRAME // 1000
                    feature = f"{len(levels)} frames, {len(cut)} clips: " + ",".join(f"{a * ms}-{b * ms}" for a, b in cut)
                    rows.append((len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(one), hashlib.sha256(one).hexdigest(), feature))
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, schema=f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
