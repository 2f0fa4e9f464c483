"""Media columns: baseline JPEG, read for dimensions and DC-only luminance thumbnails.

`decode_frames` parses the markers of baseline (SOF0, Huffman) JPEG streams, cuts their scans at the
restart markers, and Huffman-decodes all segments of a batch in lockstep: step t of every segment is
one set of numpy operations. Only DC coefficients are kept; times their quantiser and over 8 they are
the mean luminance of each 8x8 block, which is the thumbnail. AC codes are walked over.

`encode_payload` stores bytes losslessly in that form: every byte is the mean of a flat 8x8 block
(quantiser 8, so the DC level is the byte less 128), 24 blocks a row, 576 blocks a restart interval.
The thumbnail of such a picture is the payload. Payloads of over 341 intervals take several pictures,
one after another, as a JPEG side is limited to 65535 samples.

Defined cases: null text counts as empty (a payload of 576 bytes of 255); an empty table gives an empty
result; equal texts give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.shared import read_table, whole_texts

UNIT = 576  # blocks of a restart interval, 24 x 24
ROW_BLOCKS = 24
MAX_UNITS = 341  # 341 * 24 * 8 = 65472 sample rows
#: Code lengths of the DC size categories, short for the differences that text has. 9 to 11 can't occur.
DC_LENGTHS = {6: 2, 5: 2, 4: 3, 7: 3, 3: 3, 2: 4, 0: 5, 1: 6, 8: 7}
AC_LENGTHS = {0: 1}
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
BLOCK_BYTES = 2_000_000


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A Huffman table segment's body (counts, symbols) and symbol -> (code, length)."""
    ordered = sorted(lengths.items(), key=lambda x: (x[1], list(lengths).index(x[0])))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for symbol, length in ordered:
        code <<= length - last
        codes[symbol] = (code, length)
        counts[length - 1] += 1
        code, last = code + 1, length
    return bytes(counts) + bytes(s for s, _ in ordered), codes


DC_TABLE, DC_CODES = canonical(DC_LENGTHS)
AC_TABLE, AC_CODES = canonical(AC_LENGTHS)


def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of a flat block, by DC difference + 255: DC code, magnitude bits, end of block."""
    bits, lengths = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = DC_CODES[size]
        magnitude = diff if diff > 0 else diff + (1 << size) - 1
        end, end_length = AC_CODES[0]
        bits[diff + 255] = (code << size | magnitude) << end_length | end
        lengths[diff + 255] = length + size + end_length
    return bits, lengths


BITS, LENGTHS = block_codes()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(units: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        segment(0xDB, b"\x00" + bytes([8] * 64)),
        segment(0xC0, struct.pack(">BHHB", 8, units * ROW_BLOCKS * 8, ROW_BLOCKS * 8, 1) + b"\x01\x11\x00"),
        segment(0xC4, b"\x00" + DC_TABLE),
        segment(0xC4, b"\x10" + AC_TABLE),
        segment(0xDD, struct.pack(">H", UNIT)),
        segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def padded(raw: bytes) -> bytes:
    """Bytes of 255 up to a positive multiple of a unit."""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def entropy_units(payload: np.ndarray) -> list[bytes]:
    """Entropy-coded, byte-stuffed data of each unit of 576 payload bytes."""
    levels = payload.reshape(-1, UNIT).astype(np.int16) - 128
    diffs = np.empty_like(levels)
    diffs[:, 0] = levels[:, 0]
    np.subtract(levels[:, 1:], levels[:, :-1], out=diffs[:, 1:])
    index = diffs.astype(np.int64) + 255
    count, bits = len(index), np.empty((len(index), UNIT + 1), np.int64)
    lengths = np.empty_like(bits)
    bits[:, :UNIT], lengths[:, :UNIT] = BITS[index], LENGTHS[index]
    total = lengths[:, :UNIT].sum(1)
    fill = -total % 8
    lengths[:, UNIT], bits[:, UNIT] = fill, (1 << fill) - 1
    size = (total + fill) // 8
    starts = np.zeros(count + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    offset = np.cumsum(lengths, axis=1) - lengths + 8 * starts[:-1, None]
    window = (bits << (24 - lengths - (offset & 7))).ravel()
    place = (offset >> 3).ravel()
    out = np.zeros(int(starts[-1]) + 3, np.int32)
    for k in range(3):
        np.add.at(out, place + k, ((window >> (16 - 8 * k)) & 255).astype(np.int32))
    raw = out.astype(np.uint8).tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def encode_payload(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 576 bytes) as one or more JPEG pictures."""
    units = entropy_units(np.frombuffer(b"".join(payloads), np.uint8)) if payloads else []
    out, at = [], 0
    for payload in payloads:
        own = units[at : at + len(payload) // UNIT]
        at += len(own)
        pictures = []
        for first in range(0, len(own), MAX_UNITS):
            part = own[first : first + MAX_UNITS]
            pictures.append(header(len(part)))
            for i, data in enumerate(part):
                if i:
                    pictures.append(bytes((0xFF, 0xD0 + (i - 1) % 8)))
                pictures.append(data)
            pictures.append(b"\xff\xd9")
        out.append(b"".join(pictures))
    return out


@dataclass
class Frame:
    """What the markers of one picture say, and its scan's restart segments."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, horizontal, vertical, quantiser)
    quantisers: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # class << 4 | id -> counts and symbols
    restart: int = 0
    scan: tuple = ()  # (component id, tables)
    segments: list = field(default_factory=list)
    luminance: np.ndarray | None = None


def parse(stream: bytes) -> list[Frame]:
    """Frames of one or more baseline pictures written one after another."""
    frames, at, frame = [], 0, Frame()
    while at < len(stream) - 1:
        if stream[at] != 0xFF:
            raise ValueError(f"no JPEG marker at byte {at}")
        marker = stream[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
        elif marker == 0xD8:
            frame = Frame()
        elif marker == 0xD9:
            frames.append(frame)
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        else:
            (size,) = struct.unpack_from(">H", stream, at)
            body = stream[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quantisers[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                _, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline Huffman JPEG is read")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    frame.tables[body[0]] = bytes(body[1 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (frame.restart,) = struct.unpack(">H", body[:2])
            elif marker == 0xDA:
                scan = tuple((body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0]))
                end = SCAN_END.search(stream, at)
                stop = end.start() if end else len(stream)
                if not frame.scan:  # of several scans the first has the luminance
                    frame.scan = scan
                    frame.segments = [x.replace(b"\xff\x00", b"\xff") for x in RESTART.split(stream[at:stop])]
                at = stop
    return frames


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol by the next 16 bits; length 0 where no code fits."""
    lengths, symbols = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            low = code << (16 - length)
            lengths[low : low + (1 << (16 - length))] = length
            symbols[low : low + (1 << (16 - length))] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, symbols


def layout(frame: Frame) -> tuple[list[int], int, int, int]:
    """Component of each block of an MCU, MCUs in all, MCUs a row, blocks of luminance a row."""
    if len(frame.scan) == 1:
        across, down = -(-frame.width // 8), -(-frame.height // 8)
        wide, high = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
        own = next(c for c in frame.components if c[0] == frame.scan[0][0])
        across = -(-(-(-frame.width * own[1] // wide)) // 8)
        down = -(-(-(-frame.height * own[2] // high)) // 8)
        return [0], across * down, across, across
    wide, high = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    by_id = {c[0]: c for c in frame.components}
    blocks = [i for i, (name, _) in enumerate(frame.scan) for _ in range(by_id[name][1] * by_id[name][2])]
    across, down = -(-frame.width // (8 * wide)), -(-frame.height // (8 * high))
    return blocks, across * down, across, across * by_id[frame.scan[0][0]][1]


def decode_segments(segments: list[bytes], mcus: np.ndarray, blocks: list[int], tables: list[tuple[bytes, bytes]]) -> np.ndarray:
    """DC levels of the first component's blocks of every segment, (segment, block), by lockstep decoding."""
    order = np.argsort(-mcus, kind="stable")
    mcus = mcus[order]
    starts = np.zeros(len(segments) + 1, np.int64)
    chosen = [segments[i] for i in order]
    np.cumsum([len(s) + 8 for s in chosen], out=starts[1:])
    buffer = b"".join(s + b"\xff" * 8 for s in chosen) + b"\xff" * 8
    windows = np.ndarray((len(buffer) - 8,), ">u8", buffer, strides=(1,)).astype(np.uint64)
    position = starts[:-1] * 8
    known: dict[bytes, tuple] = {}
    looked = [tuple(known.setdefault(t, lookup(t)) for t in pair) for pair in tables]
    level = np.zeros((len(tables), len(chosen)), np.int64)
    mine = blocks.count(0)
    out = np.zeros((len(chosen), int(mcus[0]) * mine if len(mcus) else 0), np.int64)
    u7, u16 = np.uint64(7), np.uint64(48)
    alive, column = len(chosen), 0
    for t in range(int(mcus[0]) if len(mcus) else 0):
        while alive and mcus[alive - 1] <= t:
            alive -= 1
        here = position[:alive]
        for component in blocks:
            (dc_length, dc_symbol), (ac_length, ac_symbol) = looked[component]
            bits = windows[here >> 3] << (here.astype(np.uint64) & u7)
            top = (bits >> u16).astype(np.int64)
            length, size = dc_length[top], dc_symbol[top]
            value = ((bits << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            value -= np.where((value >> np.maximum(size - 1, 0)) == 0, (1 << size) - 1, 0)
            level[component, :alive] += value
            here += length + size
            if component == 0:
                out[:alive, column] = level[0, :alive]
                column += 1
            bits = windows[here >> 3] << (here.astype(np.uint64) & u7)
            top = (bits >> u16).astype(np.int64)
            symbol = ac_symbol[top]
            here += ac_length[top] + (symbol & 15)
            if symbol.any():
                filled = np.where(symbol == 0, 64, 1 + (symbol >> 4) + 1)
                going = np.flatnonzero(filled < 64)
                filled = filled[going]
                while len(going):
                    at = here[going]
                    bits = windows[at >> 3] << (at.astype(np.uint64) & u7)
                    top = (bits >> u16).astype(np.int64)
                    symbol = ac_symbol[top]
                    here[going] = at + ac_length[top] + (symbol & 15)
                    filled = np.where(symbol == 0, 64, filled + (symbol >> 4) + 1)
                    going, filled = going[filled < 64], filled[filled < 64]
        position[:alive] = here
    back = np.empty_like(out)
    back[order] = out
    return back


def decode_frames(streams: list[bytes]) -> list[list[Frame]]:
    """Parse streams and fill in each frame's DC-only luminance thumbnail (uint8, blocks down x across)."""
    parsed = [parse(s) for s in streams]
    groups: dict[tuple, list[Frame]] = {}
    for frame in (f for frames in parsed for f in frames):
        blocks = layout(frame)[0]
        tables = tuple((frame.tables[t >> 4], frame.tables[16 | t & 15]) for _, t in frame.scan)
        groups.setdefault((tuple(blocks), tables), []).append(frame)
    for (blocks, tables), frames in groups.items():
        segments, mcus, spans = [], [], []
        for frame in frames:
            _, total, _, _ = layout(frame)
            step = frame.restart or total
            first = len(segments)
            counts = [min(step, total - k) for k in range(0, total, step)]
            segments += frame.segments[: len(counts)]
            mcus += counts[: len(frame.segments)]
            spans.append((first, len(segments)))
        levels = decode_segments(segments, np.array(mcus, np.int64), list(blocks), list(tables))
        mine = blocks.count(0)
        for frame, (first, last) in zip(frames, spans, strict=True):
            flat = np.concatenate([levels[i, : mcus[i] * mine] for i in range(first, last)])
            own = next(c for c in frame.components if c[0] == frame.scan[0][0])
            _, _, across, row = layout(frame)
            if mine > 1:
                h, v = own[1], own[2]
                flat = flat.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1)
            mean = (flat * frame.quantisers[own[3]] + 4) // 8 + 128
            frame.luminance = mean.clip(0, 255).astype(np.uint8).reshape(-1, row)
    return parsed


def thumbnail_hash(luminance: np.ndarray) -> int:
    """64-bit difference hash of a thumbnail, from exact integer sums over an 8 x 9 grid of its cells."""
    rows = np.linspace(0, luminance.shape[0], 9).astype(int)
    columns = np.linspace(0, luminance.shape[1], 10).astype(int)
    table = np.zeros((luminance.shape[0] + 1, luminance.shape[1] + 1), np.int64)
    table[1:, 1:] = luminance.astype(np.int64).cumsum(0).cumsum(1)
    sums = np.diff(np.diff(table[np.ix_(rows, columns)], axis=0), axis=1)
    areas = np.maximum(np.outer(np.diff(rows), np.diff(columns)), 1)
    left, right = sums[:, :-1] * areas[:, 1:], sums[:, 1:] * areas[:, :-1]
    return int("".join("1" if x else "0" for x in (right > left).ravel()), 2)


def blocks_of(lengths: list[int]):
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= BLOCK_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: the text's padded bytes as JPEG."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in blocks_of([len(t) for t in texts]):
                media = encode_payload([padded(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return whole_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail bytes and thumbnail hash of stored pictures (stacked, where a value holds several)."""
    schema = "doc_id long, width int, height int, pictures int, thumbnail binary, thumbnail_hash string, media_bytes long, media_sha256 string"

    def run(batches):
        for batch in batches:
            stored = batch.column(1).to_pylist()
            for a, b in blocks_of([len(s) for s in stored]):
                rows = []
                for stream, frames in zip(stored[a:b], decode_frames(stored[a:b]), strict=True):
                    whole = np.concatenate([f.luminance.ravel() for f in frames])
                    value = 0
                    for f in frames:
                        value ^= thumbnail_hash(f.luminance)
                    rows.append((frames[0].width, sum(f.height for f in frames), len(frames), whole.tobytes(), f"{value:016x}", len(stream), hashlib.sha256(stream).hexdigest()))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc_id", "width", "height", "pictures", "thumbnail", "thumbnail_hash", "media_bytes", "media_sha256"])

    return media.mapInArrow(run, schema)


def digest_media(media: DataFrame) -> DataFrame:
    """The stored pictures read back: payload and media digests and a feature of dimensions and thumbnail hash."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            c = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != "doc_id"}
            n, size, digest, tail, feature = [], [], [], [], []
            for payload, w, h, p, value in zip(c["thumbnail"], c["width"], c["height"], c["pictures"], c["thumbnail_hash"], strict=True):
                n.append(len(payload.rstrip(b"\xff")))  # 255 never occurs in UTF-8
                size.append(len(payload))
                digest.append(hashlib.sha256(payload).hexdigest())
                tail.append(zlib.crc32(payload[-32:]))
                feature.append(f"{w}x{h}/{p}:{value}")
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, size)), pa.array(digest, pa.string()), pa.array(tail, pa.int64())]
            columns += [pa.array(c["media_bytes"], pa.int64()), pa.array(c["media_sha256"], pa.string()), pa.array(feature, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return read_media(media).mapInArrow(run, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(encode_media(read_table(spark, sf_dir, "documents")))
