"""Language identification by error-correcting output codes over hashed character n-grams.

Every language has a codeword; one binary logistic classifier a bit, on byte 2- and 3-grams of the
lower-cased letters of the whole text, predicts the bits. Decoding is loss-weighted: a codeword's distance
is the sum over bits of the bit's weight (from its accuracy on rows kept apart) times the logistic loss of
the bit's margin, and the nearest codeword wins. A small gap to the runner-up flags the text as ambiguous.

The model is fitted on at most `sample` labelled rows a language (a documented bound), chosen by a hash of
the id over all rows; whole texts are scored.

Defined cases: a text that is null or has no letter gets `und` with score 0; where no row is labelled, so
does every text; rows with a null doc_id are scored and are not learned from; repeated rows are repeated
in the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.shared import crc32_mod, read_table, unused, whole_texts, worker_state

UNDETERMINED = "und"
FEATURES = 4096
SAMPLE = 400
CODE_BITS = 15
AMBIGUOUS_GAP = 0.02
#: ASCII bytes other than letters become spaces; bytes of other characters stay.
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed byte 2- and 3-gram counts."""
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split())
    codes = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    two = codes[:-1] << 8 | codes[1:]
    three = two[:-1] << 8 | codes[2:]
    counts = np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    counts = counts + np.bincount((three * np.uint32(2246822519)) >> np.uint32(20), minlength=FEATURES)
    vector = np.sqrt(counts.astype(np.float32))
    return vector / max(float(np.sqrt(vector @ vector)), 1e-9)


def codewords(classes: int, bits: int = CODE_BITS, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1 with a large least distance: the best of many seeded draws, each bit splitting the classes."""
    if classes < 2:
        return np.ones((classes, bits))
    rng = np.random.default_rng(seed)
    bits = max(bits, int(np.ceil(4 * np.log2(classes))))
    best, best_key = None, (-1, -1)
    for _ in range(300):
        code = np.where(rng.random((classes, bits)) < 0.5, 1, -1)
        one_sided = np.abs(code.sum(0)) == classes
        code[0, one_sided] *= -1
        apart = (bits - code @ code.T) // 2
        rows = (bits - np.abs(code.T @ code)).min() if classes <= 8 else 0
        key = (int(apart[~np.eye(classes, dtype=bool)].min()), int(rows))
        if key > best_key:
            best, best_key = code, key
    return best.astype(np.float64)


@dataclass
class LanguageModel:
    """languages: sorted labels; code: codeword a language; weights, bias: a linear classifier a bit; trust: bit weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword, a row a text."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0.0, -margins[:, None, :] * self.code[None, :, :])
        return (loss * self.trust).sum(2) / self.trust.sum()

    def predict(self, texts: list) -> tuple[list[str], list[float], list[bool]]:
        """Language, score (0 to 1) and ambiguity of each text."""
        names, scores, unsure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.languages:
            return names, scores, unsure
        for start in range(0, len(texts), 512):
            at = [i for i in range(start, min(start + 512, len(texts))) if has_letter(texts[i])]
            if not at:
                continue
            away = self.distances(np.stack([features(texts[i]) for i in at]))
            # A text's score: probability of the nearest codeword if distances are energies of their bits.
            energy = np.exp(-(away - away.min(1, keepdims=True)) * self.code.shape[1] / 2)
            nearest = away.argmin(1)
            best = 1 / energy.sum(1)
            second = np.partition(away, 1, axis=1)[:, 1] - away.min(1) if away.shape[1] > 1 else np.ones(len(at))
            for i, k, score, gap in zip(at, nearest, best, second, strict=True):
                names[i], scores[i], unsure[i] = self.languages[k], float(score), bool(gap < AMBIGUOUS_GAP)
        return names, scores, unsure


def fit_bits(x: np.ndarray, targets: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers for all bits at once, by accelerated gradient steps."""
    weights, bias = np.zeros((x.shape[1], targets.shape[1])), np.zeros(targets.shape[1])
    past_w, past_b, rate = weights, bias, 4.0
    for k in range(rounds):
        push = k / (k + 3)
        w, b = weights + push * (weights - past_w), bias + push * (bias - past_b)
        pull = -targets / (1 + np.exp(np.clip(targets * (x @ w + b), -50, 50))) / len(x)
        past_w, past_b = weights, bias
        weights, bias = w - rate * (x.T @ pull + penalty * w), b - rate * pull.sum(0)
    return weights, bias


def train(rows: list[tuple[str, str]]) -> LanguageModel:
    """A model from (text, language) rows, in a given order."""
    rows = [(t, name) for t, name in rows if has_letter(t)]
    languages = sorted({name for _, name in rows})
    code = codewords(len(languages))
    if not rows:
        return LanguageModel([], code, np.zeros((FEATURES, 0)), np.zeros(0), np.ones(0))
    place = {name: i for i, name in enumerate(languages)}
    x = np.stack([features(t) for t, _ in rows])
    y = np.array([place[name] for _, name in rows])
    kept = np.arange(len(rows)) % 5 == 4
    if not kept.any() or len(set(y[~kept])) < len(languages):
        kept[:] = False
    weights, bias = fit_bits(x[~kept], code[y[~kept]])
    judged = kept if kept.any() else ~kept
    right = ((x[judged] @ weights + bias) * code[y[judged]] > 0).mean(0)
    trust = np.log((right + 0.02).clip(0.05, 1.01) / (1.02 - right).clip(0.02, 1.0)).clip(0.05)
    return LanguageModel(languages, code, weights.astype(np.float32), bias.astype(np.float32), trust)


def training_rows(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most about `sample` rows a language, by a hash of the id; two passes, one for counts."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    grid = 1 << 30
    limits = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(grid, int(grid * sample / n) + 1))]) if counts else None
    share = F.element_at(limits, F.col("lang")) if counts else F.lit(0)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < share)
    held = drawn.select("lang", "text", F.xxhash64("doc_id").alias("order")).limit(2 * sample * max(1, len(counts))).collect()
    return [(r["text"], r["lang"]) for r in sorted(held, key=lambda r: (r["order"], r["lang"], r["text"] or ""))]


def identify(docs: DataFrame, model: LanguageModel, *, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the `keep` columns), lang_pred, score, ambiguous; where a kept column has such a name, the new one gets underscores before it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = keep or ["doc_id"]
    made = [unused(n, names) for n in ("lang_pred", "score", "ambiguous")]
    # The text goes over once; where it isn't kept it comes last and is dropped.
    own = "text" in names and dict(docs.dtypes)["text"] == "string"
    at = names.index("text") if own else len(names)
    source = whole_texts(docs).select(*names, *([] if own else [F.col("text").cast("string").alias("__text")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(names)])

    def run(batches):
        worker_state("language")
        for batch in batches:
            found, scores, unsure = shared.value.predict(batch.column(at).to_pylist())
            columns = [*batch.columns[: len(names)], pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return source.mapInArrow(run, f"{schema}, {made[0]} string, {made[1]} double, {made[2]} boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fold = crc32_mod(F.col("doc_id"), 3)
    model = train(training_rows(docs, fold != 1))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
