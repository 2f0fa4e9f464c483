"""Best-fit packing by planning over a histogram of lengths.

Documents become pieces of at most `capacity` tokens. Only the count of pieces of each length (at most
`capacity` numbers) goes to the driver, where best-fit-decreasing runs over counts: all pieces of a
length go, as many at once as fit, into the bins with the least room that still holds them. The plan is
a short list of slots (length, range of ranks, first bin, pieces a bin, offset). Pieces then take their
slots by joining on their rank within their length. Ranks are dealt by salted sub-ranks plus offsets, so
a length that many pieces share is not ordered in one task.

Defined cases: null text counts as empty; an empty text is the end id alone; null doc_ids and repeated
rows are packed like any others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.llm.byte_scan import CAPITALS, WORD_BYTES, byte_class, runs, text_bytes
from tonewright.llm.shared import cut, read_table, shuffle_partitions, whole_texts, worker_state

CAPACITY = 2048
END_ID = 0
HELD_WORDS = 350_000  # pieces of letters that a worker remembers in each of two generations
PIECES_A_CALL = 20_000
BLOCK_BYTES = 2_000_000


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, last rank + 1, first bin, pieces a bin, offset in the bin)."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of bins (first, count)
    rooms: list[int] = []  # those with bins, ascending
    plan, next_bin = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                insort(rooms, left)
                room[left] = []
            room[left].append((first, count))

    for length in range(capacity, 0, -1):
        todo, rank = counts.get(length, 0), 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, bins = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first = capacity, next_bin
                bins = -(-todo // (capacity // length))
                next_bin += bins
            each = left // length
            full = min(bins, todo // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - left))
                put(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < bins:
                if todo:
                    plan.append((length, rank, rank + todo, first + full, todo, capacity - left))
                    put(left - todo * length, first + full, 1)
                    full, todo = full + 1, 0
                put(left, first + full, bins - full)
    return plan


class Recent:
    """A dictionary that forgets: of two generations the older goes when the newer is full."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def of(self, keys: list, make) -> list:
        """What is held for distinct keys; for those that neither generation has, make(their list)."""
        found = list(map(self.new.get, keys))
        absent = [i for i, value in enumerate(found) if value is None]
        if absent:
            again = list(map(self.old.get, (keys[i] for i in absent)))
            unknown = [i for i, value in zip(absent, again, strict=True) if value is None]
            if len(self.new) + len(absent) > self.limit:
                self.old, self.new = self.new, {}
            for i, value in zip(absent, again, strict=True):
                found[i] = value
            for i, value in zip(unknown, make([keys[i] for i in unknown]) if unknown else (), strict=True):
                found[i] = value
            self.new.update((keys[i], found[i]) for i in absent)
        return found


#: ASCII letters; ASCII marks but the apostrophe; second bytes of the letters that begin with 0xC3, and of their capitals.
LETTERS = byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
MARKS = byte_class(bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"))
SECOND = byte_class(bytes([*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]))
SECOND_CAPITALS = byte_class(bytes([*range(0x80, 0x97), *range(0x98, 0x9F)]))


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Pieces of the words of a block, in order: a number each, the pieces by number, which of these are letters, and pieces before each text.

    A word of ASCII and Latin-1 letters before ASCII marks is two pieces, its letters lowered; any other is one as it stands.
    """
    inside = WORD_BYTES[data]
    begins, ends, before = runs(inside, offsets)
    letters = LETTERS[data]
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & SECOND[data[1:]]
    letters |= lead
    letters[1:] |= lead[:-1]
    count = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
    in_letters, in_marks = count(letters), count(MARKS[data])
    cut = begins + (in_letters[ends] - in_letters[begins])  # where the marks begin, if letters come first
    plain = (in_letters[cut] - in_letters[begins] == cut - begins) & (in_marks[ends] - in_marks[cut] == ends - cut)
    # Two places a word; the second is empty where there is but one piece.
    cut[~plain] = ends[~plain]
    full = np.stack([cut > begins, ends > cut], 1).reshape(-1)
    lowered = data + np.uint8(32) * CAPITALS[data]
    lowered[1:] += np.uint8(32) * (lead[:-1] & SECOND_CAPITALS[data[1:]])
    own = np.repeat(plain, ends - begins)
    held = np.where(own, lowered[inside], data[inside])
    sizes = np.stack([cut - begins, ends - cut], 1).reshape(-1)[full]
    starts = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=starts[1:])
    coded = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(starts), pa.py_buffer(held)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    spelled = np.zeros(len(coded.dictionary), bool)
    spelled[codes] = (np.stack([plain, np.zeros_like(plain)], 1).reshape(-1))[full]
    return codes, coded.dictionary, spelled, count(full)[2 * before]


class WordIds:
    """Token ids of white-space separated words, as little-endian bytes, each piece of a word encoded once while remembered.

    The tokenizer drops white space, and no token, normal form or case rule reaches across it. Words of ASCII and
    Latin-1 letters that end in ASCII marks other than an apostrophe are two pieces for it, letters (lowered) and
    marks. Letters go to the tokenizer's merges alone, many words in one text: they have their normal form, and a
    word's last token, and no other, holds the end of a word. What is not plain goes through the whole tokenizer, a
    divider between pieces, whose id no piece without that character has.

    This leans on how the file lowers and splits; a file that does so otherwise is refused.
    """

    DIVIDER, WORD_END = "|", "</w>"
    #: What a file must say of its steps (fixed values).
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, held: int = HELD_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        steps = json.loads(self.tokenizer.to_str())
        self.check(steps)
        letters = steps | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(letters))
        self.letters, self.others = Recent(held), Recent(held // 8)
        (self.divider,) = self.tokenizer.encode(self.DIVIDER, add_special_tokens=False).ids
        vocabulary = steps["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith(self.WORD_END)]] = True
        # Bytes as the characters that stand for them: printable ones are their own, the others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.characters = {b: b for b in own} | {b: 256 + n for n, b in enumerate(rest)} | {32: 32}

    def check(self, steps: dict) -> None:
        split = [p for p in (steps["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        model = steps["model"]
        known = (steps["normalizer"] or {}).get("normalizers") == self.NORMALIZERS and len(split) == 1
        known = known and split[0]["pattern"] == {"Regex": self.SPLIT} and split[0]["behavior"] == "Removed" and split[0]["invert"]
        if not known or model["type"] != "BPE" or model["end_of_word_suffix"] != self.WORD_END or model["dropout"] or not any(p["type"] == "ByteLevel" for p in steps["pre_tokenizer"]["pretokenizers"]):
            raise ValueError("a tokenizer file that lowers, splits or ends words in another way")

    def cut_up(self, n: int, text: str, tokenizer, ends) -> list[bytes]:
        """Ids of one text of n pieces, cut after its ends or (none given) at the dividers."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        raw, keep = ids.tobytes(), 0 if ends is None else 4
        cuts = (4 * np.flatnonzero(ids == self.divider if ends is None else ends[ids])).tolist()
        cuts = [*cuts, len(raw)] if ends is None else cuts
        return [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts[: n - 1]]], [c + keep for c in cuts], strict=True)]

    def of_letters(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces of lowered letters."""
        out: list[bytes] = []
        for start in range(0, len(pieces), PIECES_A_CALL):
            part = pieces[start : start + PIECES_A_CALL]
            out += self.cut_up(len(part), b" ".join(part).decode("latin-1").translate(self.characters), self.merges, self.ends)
        return out

    def of_others(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces of any kind."""
        out: list = [b""] * len(pieces)
        mark = self.DIVIDER.encode()
        for i in (i for i, p in enumerate(pieces) if mark in p):
            out[i] = np.array(self.tokenizer.encode(pieces[i].decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        rest = [i for i, p in enumerate(pieces) if mark not in p]
        for start in range(0, len(rest), PIECES_A_CALL):
            part = rest[start : start + PIECES_A_CALL]
            text = f" {self.DIVIDER} ".join([pieces[i].decode("utf-8") for i in part])
            for i, ids in zip(part, self.cut_up(len(part), text, self.tokenizer, None), strict=True):
                out[i] = ids
        return out

    def of_texts(self, texts: pa.StringArray):
        """Ids of each text, as little-endian bytes."""
        for _, _, data, offsets in text_bytes(texts, BLOCK_BYTES):
            # Pieces are told apart and numbered by Arrow; only distinct ones become Python's.
            codes, names, spelled, before = pieces_of(data, offsets)
            pieces = names.cast(pa.binary())
            ids: list = [b""] * len(names)
            for kept, make, which in ((self.letters, self.of_letters, spelled), (self.others, self.of_others, ~spelled)):
                at = np.flatnonzero(which)
                for i, own in zip(at.tolist(), kept.of(pieces.take(pa.array(at)).to_pylist(), make), strict=True):
                    ids[i] = own
            held, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            own = sizes[codes]
            ends = np.cumsum(own)
            places = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - own), own)
            places += np.arange(len(places))
            raw = memoryview(held[places]).cast("B") if len(places) else memoryview(b"")
            edges = np.concatenate([[0], ends])[before] * 4
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield raw[a:b]


def word_ids(path: str, held: int = HELD_WORDS) -> WordIds:
    return worker_state(("words", path, held), lambda: WordIds(path, held))


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, held: int = HELD_WORDS) -> DataFrame:
    """doc_id, piece, start, length and checksum of every piece of every whole text. held: pieces of words a worker remembers."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end, step = END_ID.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        words = word_ids(tokenizer_file, held)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for name, own in zip(batch.column(0).to_pylist(), words.of_texts(batch.column(1)), strict=True):
                ids = bytes(own) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(rows, (name, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    return whole_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    salts = max(16, shuffle_partitions(spark))
    pieces = cut(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # At most `capacity` rows: one a length.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(histogram, capacity)
    slots = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "length long, first long, last long, bin long, each long, base long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("sub", F.row_number().over(own) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("below") + F.col("sub")).alias("p")
    # The plan's size depends on `capacity` alone, whatever the corpus: it may be broadcast.
    placed = ranked.join(
        F.broadcast(slots.alias("s")),
        (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.first")) & (F.col("p.rank") < F.col("s.last")),
    )
    place = F.col("p.rank") - F.col("s.first")
    return placed.select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
        (F.col("s.bin") + F.floor(place / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.base") + F.pmod(place, F.col("s.each")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, held: int = HELD_WORDS) -> DataFrame:
    return pack(tokenized_pieces(docs, tokenizer_file, capacity, held), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
