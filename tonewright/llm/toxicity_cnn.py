"""Toxicity by a convolutional text classifier in numpy: hashed word embeddings, filters of several widths,
max pooling over the whole text, and thresholds calibrated by language.

A word's embedding is the sum of three hashed vectors: the word, its first five letters and its last five.
A convolution of width k over embeddings is a sum of k projections of words, so scoring keeps one row of
projections a word and adds shifted rows; a text of any length is pooled whole.

Calibration guesses a text's language from its words alone (votes of hashed words, learned from the labelled
rows' languages) and subtracts that language's threshold from the logit, so 0.5 is the threshold everywhere.
Labels, languages, sources and ids of the scored rows are no inputs.

The model is fitted on at most `sample` labelled rows of each label (a documented bound), chosen by a hash of
the id over all labelled rows. Embeddings and filters start from noise; `train(log_odds=True)` starts them from the
log odds of each bucket, which finds more with few labelled rows but is a list of words before it is a network.

Defined cases: null text counts as empty; texts without words get the score of the pooled biases; where no
row is labelled every score is 0; null labels are not learned from; a document labelled twice is learned
twice; repeated rows are repeated in the result; an empty table gives an empty result; other columns are
ignored (or kept, where asked for).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.shared import crc32_mod, give_back, read_table, text_blocks, unused, whole_texts, worker_state

BUCKETS = 1 << 15
WIDTH = 12  # of embeddings
KERNELS = (1, 2, 3)
FILTERS = 6  # of each width
SAMPLE = 2500
WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 150_000
LEAN = 40
WORDS_AT_ONCE = 8192  # whose projections are worked out at once in training, to bound the driver's memory


def buckets(word: str) -> tuple[int, int, int]:
    head, tail = word[:5], word[-5:]
    return (
        zlib.crc32(word.encode()) % BUCKETS,
        zlib.crc32(b"<" + head.encode()) % BUCKETS,
        zlib.crc32(b">" + tail.encode()) % BUCKETS,
    )


@dataclass
class ToxicityModel:
    """Embedding table, filters (kernel -> place, embedding, filter), biases, output weights and calibration."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    languages: list[str] = field(default_factory=list)
    votes: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    scale: float = 1.0
    trained: bool = True

    def __post_init__(self):
        self.flat = np.concatenate([f.transpose(1, 0, 2).reshape(WIDTH, -1) for f in self.filters], axis=1)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, self.flat.shape[1] + max(1, len(self.languages))), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "table", "flat")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self) -> None:
        self.rows = {}
        self.table = self.table[:0].copy()

    def learn_words(self, words: set[str]) -> None:
        """Projections (and language votes) of words not met before."""
        new = list(words)
        ids = np.array([buckets(w) for w in new]).reshape(len(new), 3)
        part = self.embedding[ids].sum(1) @ self.flat
        votes = self.votes[ids[:, 0]] if self.votes is not None and self.languages else np.zeros((len(new), 1), np.float32)
        self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate([self.table, np.concatenate([part, votes], axis=1).astype(np.float32)])

    def pooled(self, projected: np.ndarray) -> np.ndarray:
        """Max over positions of every filter; projected: a row a word."""
        out, at = [], 0
        for k in KERNELS:
            block = projected[:, at : at + k * FILTERS]
            at += k * FILTERS
            if len(block) < k:  # a short text is padded with zero vectors
                block = np.concatenate([block, np.zeros((k - len(block), block.shape[1]), block.dtype)])
            total = block[: len(block) - k + 1, :FILTERS]
            for j in range(1, k):
                total = total + block[j : len(block) - k + 1 + j, j * FILTERS : (j + 1) * FILTERS]
            out.append(total.max(0))
        return np.concatenate(out)

    def logits(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Raw logits and the calibration language's number (-1: none) of each text."""
        raw, spoken = np.zeros(len(texts)), np.full(len(texts), -1)
        columns = self.flat.shape[1]
        for start, end in text_blocks(texts, 1_000_000):
            split = [WORD.findall(t.lower()) if t else [] for t in texts[start:end]]
            new = set().union(*split)
            if len(self.rows) + len(new) > CACHE_WORDS:
                self.forget()
            new -= self.rows.keys()
            if new:
                self.learn_words(new)
            place = self.rows.__getitem__
            for i, words in enumerate(split, start):
                rows = self.table[np.fromiter(map(place, words), np.int64, len(words))]
                raw[i] = np.maximum(self.pooled(rows[:, :columns]) + self.bias, 0) @ self.out + self.shift
                if self.languages and len(words):
                    spoken[i] = int(rows[:, columns:].sum(0, dtype=np.float64).argmax())
        return raw, spoken

    def score(self, texts: list) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        raw, spoken = self.logits(texts)
        # The last threshold is that of texts without a language.
        margin = self.scale * (raw - self.thresholds[spoken])
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, fallback: float) -> float:
    """Middle of the gap with the least weighted error; the fallback where a label is missing."""
    if len(set(labels.tolist())) < 2 or labels.sum() < 5:
        return fallback
    order = np.argsort(logits, kind="stable")
    x, y, w = logits[order], labels[order], weights[order]
    missed = np.concatenate([[0.0], np.cumsum(w * y)])
    false = (w * (1 - y)).sum() - np.concatenate([[0.0], np.cumsum(w * (1 - y))])
    at = np.flatnonzero(missed + false <= (missed + false).min() + 1e-12)
    gaps = [(x[i] - x[i - 1], (x[i] + x[i - 1]) / 2) for i in at if 0 < i < len(x)]
    return float(max(gaps)[1]) if gaps else fallback


def train(rows: list[tuple[str, str | None, int]], toxic_share: float, seed: int = 11, epochs: int = 12, log_odds: bool = False) -> ToxicityModel:
    """rows: (text, language or None, label) in a fixed order; toxic_share: that of all labelled rows.

    log_odds: do embeddings start with the log odds of their buckets in one coordinate, or with noise alone?
    """
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, _, y in rows], np.float64)
    size = len(KERNELS) * FILTERS
    filters = [np.zeros((k, WIDTH, FILTERS), np.float32) for k in KERNELS]
    if len(rows) < 10 or len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros((BUCKETS, WIDTH), np.float32), filters, np.zeros(size), np.zeros(size), 0.0, trained=False)
    place: dict[str, int] = {}
    sequences = [np.array([place.setdefault(w, len(place)) for w in WORD.findall((t or "").lower())], np.int32) for t, _, _ in rows]
    ids = np.array([buckets(w) for w in place], np.int32).reshape(len(place), 3)
    place.clear()
    judged = np.arange(len(rows)) % 5 == 4
    learned = np.flatnonzero(~judged)

    # First values: one coordinate holds each bucket's log odds of appearing in either label, the rest is noise.
    seen = np.zeros((2, BUCKETS))
    for i in learned:
        seen[int(labels[i]), np.unique(ids[sequences[i]])] += 1
    per_label = np.array([(labels[learned] == y).sum() for y in (0, 1)], np.float64)
    odds = np.log((seen[1] + 0.3) / (per_label[1] + 1)) - np.log((seen[0] + 0.3) / (per_label[0] + 1))
    odds[seen.sum(0) < 3] = 0
    embedding = rng.normal(0, 0.05, (BUCKETS, WIDTH))
    weights = [rng.normal(0, 0.1, (k, WIDTH, FILTERS)) for k in KERNELS]
    bias, out, shift = np.zeros(size), rng.normal(0, 0.1 if log_odds else 0.3, size), 0.0
    if log_odds:
        embedding[:, 0] = odds / 3
        for w in weights:
            w[:, 0, : FILTERS // 2] += 1.0 / len(w)
        out, shift = np.where(np.arange(size) % FILTERS < FILTERS // 2, 0.6, out), -1.5
    # Adam over all of them; gradients of embeddings touch the buckets of winning windows only.
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embedding, *weights, bias, out, np.zeros(1))]
    turn = 0
    # Written over a turn: large arrays that come and go would leave the driver's memory in pieces.
    vectors, projected = np.zeros((len(ids), WIDTH)), np.zeros((len(ids), FILTERS * sum(KERNELS)), np.float32)
    balance = np.where(labels == 1, 0.5 / per_label[1], 0.5 / per_label[0]) * len(learned)
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(learned), max(1, len(learned) // 200)):
            turn += 1
            flat = np.concatenate([w.transpose(1, 0, 2).reshape(WIDTH, -1) for w in weights], axis=1)
            for start in range(0, len(ids), WORDS_AT_ONCE):
                some = slice(start, start + WORDS_AT_ONCE)
                vectors[some] = embedding[ids[some]].sum(1)
                projected[some] = vectors[some] @ flat
            grad_e = np.zeros_like(embedding)
            grad_w = [np.zeros_like(w) for w in weights]
            grad_b, grad_o, grad_s = np.zeros_like(bias), np.zeros_like(out), 0.0
            for i in batch:
                sequence = sequences[i]
                if not len(sequence):
                    continue
                rows_ = projected[sequence]
                pooled, winners, at = np.full(size, 0.0), [], 0
                for number, k in enumerate(KERNELS):
                    block = rows_[:, at : at + k * FILTERS]
                    at += k * FILTERS
                    if len(block) < k:
                        block = np.concatenate([block, np.zeros((k - len(block), block.shape[1]), block.dtype)])
                    total = block[: len(block) - k + 1, :FILTERS]
                    for j in range(1, k):
                        total = total + block[j : len(block) - k + 1 + j, j * FILTERS : (j + 1) * FILTERS]
                    best = total.argmax(0)
                    winners.append(best)
                    pooled[number * FILTERS : (number + 1) * FILTERS] = total[best, np.arange(FILTERS)]
                hidden = np.maximum(pooled + bias, 0)
                guess = 1 / (1 + np.exp(-np.clip(hidden @ out + shift, -40, 40)))
                slope = (guess - labels[i]) * balance[i] / len(batch)
                grad_o += slope * hidden
                grad_s += slope
                back = slope * out * (pooled + bias > 0)
                grad_b += back
                for number, k in enumerate(KERNELS):
                    own = back[number * FILTERS : (number + 1) * FILTERS]
                    for j in range(k):
                        where = winners[number] + j
                        inside = where < len(sequence)
                        chosen = sequence[np.minimum(where, len(sequence) - 1)]
                        step = np.where(inside, own, 0.0)
                        grad_w[number][j] += (vectors[chosen] * step[:, None]).T
                        np.add.at(grad_e, ids[chosen].ravel(), np.repeat(weights[number][j].T * step[:, None], 3, axis=0))
            values = (embedding, *weights, bias, out, np.array([shift]))
            for value, grad, (first, second) in zip(values, (grad_e, *grad_w, grad_b, grad_o, np.array([grad_s])), state, strict=True):
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                rate = 0.01 if epoch < epochs // 2 else 0.004
                value -= rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-6)
            shift = float(values[-1][0])

    del vectors, projected, state
    give_back()
    languages = sorted({name for _, name, _ in rows if name is not None})
    votes = None
    if languages:
        counts = np.full((BUCKETS, len(languages)), 0.1)
        number = {name: i for i, name in enumerate(languages)}
        for i in learned:
            if rows[i][1] is not None:
                counts[np.unique(ids[sequences[i], 0]), number[rows[i][1]]] += 1
        votes = np.log(counts / counts.sum(0))
        votes = (votes - votes.mean(1, keepdims=True)).astype(np.float32)
    model = ToxicityModel(embedding.astype(np.float32), [w.astype(np.float32) for w in weights], bias, out, shift, languages, votes)
    raw, spoken = model.logits([t for t, _, _ in rows])
    share = min(max(toxic_share, 1e-3), 1 - 1e-3)
    natural = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    whole = best_threshold(raw[judged], labels[judged], natural[judged], np.nan)
    if np.isnan(whole):  # too few to calibrate on: no clean row kept apart may fall
        whole = max(best_threshold(raw, labels, natural, 0.0), float(raw[judged & (labels == 0)].max(initial=0.0)) + 1e-6)
    thresholds = []
    for k in range(len(languages)):
        own = judged & (spoken == k)
        toxic = labels[own].sum()
        # A language with few toxic rows leans on the threshold of all.
        thresholds.append((toxic * best_threshold(raw[own], labels[own], natural[own], whole) + LEAN * whole) / (toxic + LEAN))
    model.thresholds = np.array([*thresholds, whole])
    model.forget()
    del sequences, ids, embedding, weights
    give_back()
    return model


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[list[tuple[str, str | None, int]], float]:
    """At most about `sample` rows of each label, by a hash of the id, and the toxic share of all learnable labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(learn)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    grid = 1 << 30
    share = F.when(F.col("toxic") == 1, min(grid, int(grid * sample / max(1, counts.get(1, 0))) + 1))
    share = share.otherwise(min(grid, int(grid * sample / max(1, counts.get(0, 0))) + 1))
    # Bounded by `sample`, whatever the corpus: it may be broadcast and collected.
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < share).limit(4 * sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = own.join(F.broadcast(drawn), "doc_id").limit(8 * sample).collect()
    rows = sorted(((r["doc_id"], r["text"], r["lang"], r["toxic"]) for r in held), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or "", r[3]))
    return [(t, name, y) for _, t, name, y in rows], counts.get(1, 0) / max(1, sum(counts.values()))


def score_documents(docs: DataFrame, model: ToxicityModel, *, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the `keep` columns), score, predicted; where a kept column has such a name, the new one gets underscores before it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = keep or ["doc_id"]
    made = [unused(n, names) for n in ("score", "predicted")]
    # The text goes over once; where it isn't kept it comes last and is dropped.
    own = "text" in names and dict(docs.dtypes)["text"] == "string"
    at = names.index("text") if own else len(names)
    source = whole_texts(docs).select(*names, *([] if own else [F.col("text").cast("string").alias("__text")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(names)])

    def run(batches):
        worker_state("toxicity")
        for batch in batches:
            scores = shared.value.score(batch.column(at).to_pylist())
            columns = [*batch.columns[: len(names)], pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return source.mapInArrow(run, f"{schema}, {made[0]} double, {made[1]} int")


def held_out(doc_id: Column) -> Column:
    return crc32_mod(doc_id, 5) == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows, share = training_rows(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = score_documents(docs, train(rows, share))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
