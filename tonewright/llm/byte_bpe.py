"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

Pieces of text (matches of the split pattern) that a worker has not met yet are put in matrices of
token ids, one row a piece, rows of like length together. In each round every row looks up the ranks
of its neighbouring pairs in an open-addressing hash table, merges its leftmost pair of minimum rank,
and closes the gap; finished rows leave the matrix. A matrix of one row merges all places of that pair in a
round, from the left, unless one of the pairs that come about has a lower rank, which has to go first. Texts are
then put together from the pieces, and decoded from their ids.

Defined cases: null text counts as empty; an empty text has no token (digests of the empty string);
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tonewright.llm.shared import read_table, text_blocks, whole_texts, worker_state

NO_RANK = np.int32(2**31 - 1)
#: Unicode White_Space, as the library's regex engine has it (Python's own classes also hold U+001C..U+001F).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Longer pieces have a matrix of their own.
MATRIX_WIDTH = 2048
CACHE_PIECES = 250_000


def split_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with its white-space classes written out."""
    written = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(written)


class PairTable:
    """(left id, right id) -> id of the joined bytes, by vectorised open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.mask = (1 << max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, NO_RANK, np.int32)
        todo = np.asarray(keys, np.int64)
        todo_values = np.asarray(values, np.int32)
        slot = self._home(todo)
        self.longest = 0
        while len(todo):
            self.longest += 1
            free = self.keys[slot] < 0
            places, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[places], self.values[places] = todo[chosen], todo_values[chosen]
            rest = np.ones(len(todo), bool)
            rest[chosen] = False
            todo, todo_values, slot = todo[rest], todo_values[rest], (slot[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(33)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_RANK where none exists or either side is padding (-1)."""
        out = np.full(left.shape, NO_RANK, np.int32)
        at = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat = out.ravel()
        keys = left.ravel()[at].astype(np.int64) << 32 | right.ravel()[at].astype(np.int64)
        slot = self._home(keys)
        while len(at):
            found = self.keys[slot]
            hit = found == keys
            flat[at[hit]] = self.values[slot[hit]]
            go_on = ~hit & (found >= 0)
            at, keys, slot = at[go_on], keys[go_on], (slot[go_on] + 1) & self.mask
        return flat.reshape(out.shape)


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.pattern = split_pattern(pattern)
        #: A piece's ids as decimal text and as bytes of 32-bit integers.
        self.text_of: dict[str, str] = {}
        self.ids_of: dict[str, bytes] = {}
        self.old_text: dict[str, str] = {}
        self.old_ids: dict[str, bytes] = {}
        known = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.spelt = np.frombuffer(b"".join(known), np.uint8)
        self.spelt_sizes = np.fromiter(map(len, known), np.int64, len(known))
        self.spelt_starts = np.cumsum(self.spelt_sizes) - self.spelt_sizes

    def merge_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces of two bytes or more, one after another, and how many each has."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces' numbers, counts, ids
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > MATRIX_WIDTH).tolist():
            ids = self.merge_one(pieces[i])
            done.append((np.array([i]), np.array([len(ids)]), ids))
        bucket = np.where(sizes > MATRIX_WIDTH, 0, (np.maximum(sizes, 2) + 3) // 4)
        for width in np.unique(bucket[bucket > 0]).tolist():
            members = np.flatnonzero(bucket == width)
            step = max(1, 250_000 // width)
            for start in range(0, len(members), step):
                rows = members[start : start + step]
                self._merge_matrix([pieces[i] for i in rows.tolist()], rows, 4 * width, done)
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        names, counts, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(names)
        starts = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        return ids[np.repeat(starts, counts) + inner], counts

    def _merge_matrix(self, pieces: list[bytes], names: np.ndarray, width: int, done: list) -> None:
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(ids):
            at = ranks.argmin(axis=1)
            every = np.arange(len(ids))
            best = ranks[every, at]
            live = best < NO_RANK
            if not live.all():
                ended = ids[~live]
                real = ended >= 0
                done.append((names[~live], real.sum(1), ended[real]))
                ids, ranks, names, at, best = ids[live], ranks[live], names[live], at[live], best[live]
                every = np.arange(len(ids))
                if not len(ids):
                    return
                # Rows of the matrix only get shorter: columns that no row uses any more go too.
                used = max(2, int((ids >= 0).sum(1).max()))
                if used < width:
                    width = used
                    ids, ranks, columns = ids[:, :width], ranks[:, : width - 1], columns[:width]
            ids[every, at] = best
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, source[:, :-1].clip(max=width - 2), 1)
            ranks[:, -1] = NO_RANK
            ranks[every, at] = self.pairs.ranks(ids[every, at], ids[every, at + 1])
            before = at > 0
            ranks[every[before], at[before] - 1] = self.pairs.ranks(ids[every[before], at[before] - 1], ids[every[before], at[before]])

    def merge_one(self, piece: bytes) -> np.ndarray:
        """The same merges for a matrix of one row. A round costs the row's length, and there is hardly more than one a token."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        while len(ranks):
            best = ranks.min()
            if best == NO_RANK:
                break
            at = np.flatnonzero(ranks == best)
            # Of places that overlap (a run of one token) every other one, counted from the run's first.
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))
            first = at[np.searchsorted(run, run)]
            every = at[(at - first) % 2 == 0]
            # Beside a place merged just now, the next one's left token makes a pair of its own until it is merged too.
            between = self.pairs.ranks(best.reshape(1), ids[every[:1]])[0] < best and bool((np.diff(every) == 2).any())
            for at in (every[:1],) if between else (every, every[:1]):
                keep = np.ones(len(ids), bool)
                keep[at + 1] = False
                merged = ids.copy()
                merged[at] = best
                merged = merged[keep]
                # Only pairs beside a merged one are new.
                places = at - np.arange(len(at))
                touched = np.unique(np.concatenate([places, places - 1]))
                touched = touched[(touched >= 0) & (touched < len(merged) - 1)]
                new = self.pairs.ranks(merged[touched], merged[touched + 1])
                if len(at) == 1 or not len(new) or new.min() > best:
                    break
            ids, ranks = merged, ranks[keep[1:]][: len(merged) - 1]
            ranks[touched] = new
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces not met before; keep their ids as text and as integers."""
        raw = [p.encode("utf-8") for p in pieces]
        whole = np.fromiter((self.ranks.get(r, -1) for r in raw), np.int64, len(raw))
        merged = np.flatnonzero(whole < 0).tolist()
        ids, counts = self.merge_rows([raw[i] for i in merged])
        pieces = [*(pieces[i] for i in merged), *(pieces[i] for i in np.flatnonzero(whole >= 0).tolist())]
        ids = np.concatenate([ids, whole[whole >= 0]]).astype("<i4")
        counts = [*counts.tolist(), *[1] * (len(pieces) - len(merged))]
        written, held = list(map(str, ids.tolist())), ids.tobytes()
        at = 0
        for piece, n in zip(pieces, counts, strict=True):
            end = at + n
            self.text_of[piece] = ",".join(written[at:end])
            self.ids_of[piece] = held[4 * at : 4 * end]
            at = end

    def meet(self, pieces: set[str]) -> None:
        """See that pieces are known. Of two generations of known pieces the older is forgotten when the newer is full."""
        missing = pieces - self.text_of.keys()
        if len(self.text_of) + len(missing) > CACHE_PIECES:
            self.old_text, self.old_ids, self.text_of, self.ids_of = self.text_of, self.ids_of, {}, {}
            missing = pieces
        again = missing & self.old_text.keys()
        for piece in again:
            self.text_of[piece] = self.old_text[piece]
            self.ids_of[piece] = self.old_ids[piece]
        new = missing - again
        if new:
            self.learn(list(new))

    def encode_texts(self, texts: list):
        """For each text: its ids, decimal and joined by commas, and as integers."""
        find = self.pattern.findall
        for start, end in text_blocks(texts):
            split = [find(t) if t else [] for t in texts[start:end]]
            self.meet(set().union(*split))
            written, ids = self.text_of.__getitem__, self.ids_of.__getitem__
            for pieces in split:
                yield ",".join(map(written, pieces)), np.frombuffer(b"".join(map(ids, pieces)), "<i4")

    def decode(self, ids) -> bytes:
        """The bytes that ids stand for."""
        ids = np.asarray(ids, np.int64)
        sizes = self.spelt_sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.spelt_starts[ids] - (ends - sizes), sizes)
        places += np.arange(len(places))
        return self.spelt[places].tobytes()

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_texts([text]))[1].tolist()


def codec(rank_file: str, pattern: str) -> ByteBpe:
    """One codec a worker process."""
    return worker_state(("bpe", rank_file, pattern), lambda: ByteBpe(rank_file, pattern))


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, *, keep_ids: bool = False) -> DataFrame:
    """doc_id, token count, digest of the ids and of the decoded bytes; with keep_ids also the ids themselves."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        bpe = codec(rank_file, pattern)
        for batch in batches:
            n, ids_digest, raw_digest, ids = [], [], [], []
            for written, own in bpe.encode_texts(batch.column(1).to_pylist()):
                n.append(len(own))
                ids_digest.append(hashlib.sha256(written.encode()).hexdigest())
                raw_digest.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                if keep_ids:
                    ids.append(own)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(raw_digest, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole_texts(docs).select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
