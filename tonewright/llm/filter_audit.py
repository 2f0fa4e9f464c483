"""How quality filters act together: what each removes in every order, alone, and on average.

A scan over Arrow buffers counts, for each whole text, words, distinct words, capitals, symbols and code
points: tables of byte classes, prefix sums over them, and word hashes sorted within the document. Equal
hashes are verified byte by byte; a document with a collision is counted by its words themselves.

The five filters make a mask of five bits a document. Masks are counted by part, mask and labels, and those
counts (at most 128 a part) are spread over the 120 orders of the filters. The filter for copies needs no
join of documents on their texts: rows are counted by text hash first, with the smallest doc_id and how
often it occurs, so a text that a third of all rows share is one row before it is shuffled.

Filters: A under 100 words; B distinct words under 80 of 100; C over 10 of 100 code points are capitals;
D holds any of `#$%&*|`; E equals the text of a smaller doc_id. Texts are told apart by 128 bits of hash
and their length.

Defined cases: a null text is the empty one, a null lang the empty string. Rows without a doc_id have no
labels and are never E, nor are others E because of them. Rows that repeat a doc_id with the same text are
not E because of one another. A document counts as good (toxic) if any of its label rows has quality 1
(toxic 1). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.llm.byte_scan import CAPITALS, POINT_STARTS, WORD_BYTES, byte_class, run_hashes, runs, same_runs, sums_by_text, text_bytes
from tonewright.llm.shared import read_table, whole_texts, worker_state

FILTERS = "ABCDE"
SYMBOLS = byte_class(b"#$%&*|")
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COUNTED = ["n_words", "n_distinct", "n_capitals", "n_symbols", "n_points"]


def distinct_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, before: np.ndarray, hashed=run_hashes) -> np.ndarray:
    """Distinct words of each text. before: words before each text."""
    hashes = hashed(data, begins, ends)
    order = np.empty(len(begins), np.int64)
    for a, b in itertools.pairwise(before.tolist()):
        if b > a:
            order[a:b] = hashes[a:b].argsort(kind="stable")
            order[a:b] += a
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    ranked = hashes[order]
    again = np.flatnonzero((ranked[1:] == ranked[:-1]) & (text[1:] == text[:-1]))
    good = same_runs(data, begins, ends, order[again], order[again + 1])
    found = np.diff(before) - np.bincount(text[again], minlength=len(before) - 1)
    for t in np.unique(text[again[~good]]).tolist():
        found[t] = len({data[b:e].tobytes() for b, e in zip(begins[before[t] : before[t + 1]].tolist(), ends[before[t] : before[t + 1]].tolist(), strict=True)})
    return found


def counts(texts: pa.Array) -> list[np.ndarray]:
    """COUNTED for each text of a column."""
    parts = [np.zeros((len(COUNTED), 0), np.int64)]
    for _, _, data, offsets in text_bytes(texts):
        capitals, symbols, points = sums_by_text(data, offsets, [CAPITALS, SYMBOLS, POINT_STARTS])
        begins, ends, before = runs(WORD_BYTES[data], offsets)
        parts.append(np.stack([np.diff(before), distinct_words(data, begins, ends, before), capitals, symbols, points]))
    return list(np.concatenate(parts, axis=1))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null: empty), two hashes of the text, and COUNTED."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    source = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))

    def run(batches):
        worker_state("filter_audit")
        for batch in batches:
            made = [pa.array(x, pa.int64()) for x in counts(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=["doc_id", "lang", "h1", "h2", *COUNTED])

    return source.mapInArrow(run, "doc_id long, lang string, h1 long, h2 long, " + ", ".join(f"{c} long" for c in COUNTED))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails filter i), good, toxic, n: documents of each kind."""
    c = {name: F.col(name) for name in COUNTED}
    fails = [c["n_words"] < 100, 100 * c["n_distinct"] < 80 * c["n_words"], 100 * c["n_capitals"] > 10 * c["n_points"], c["n_symbols"] > 0]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    text = ["h1", "h2", "n_points"]
    rows = scan(docs).select("doc_id", F.col("lang").alias("part"), *text, mask.alias("mask"))
    rows = rows.groupBy("doc_id", "part", *text, "mask").agg(F.count("*").alias("n"))
    # Rows without an id meet no label; their texts deal them out.
    rows = rows.withColumns({"key": F.coalesce("doc_id", "h1"), "unnamed": F.col("doc_id").isNull()})
    flag = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0))
    named = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key"), F.lit(False).alias("unnamed"))
    labelled = rows.join(named.agg(flag("quality").alias("good"), flag("toxic").alias("toxic")), ["key", "unnamed"], "left").fillna(0, ["good", "toxic"])
    # Copies shrink to a row a kind before they meet.
    kind = [*text, "mask", "part", "good", "toxic"]
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_unnamed")
    firsts = F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), "doc_id").alias("n_first")
    copies = labelled.groupBy(*kind).agg(F.sum("n").alias("n"), unnamed, F.min("doc_id").alias("first_id"), firsts)
    each = copies.withColumn("owner", F.min("first_id").over(Window.partitionBy(*text)))
    stay = F.col("n_unnamed") + F.when(F.col("first_id") == F.col("owner"), F.col("n_first")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), stay.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - stay).alias("n")))
    split = each.select("part", "good", "toxic", F.explode(both).alias("m")).select("part", "good", "toxic", "m.*")
    return split.filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def outcomes(spark: SparkSession) -> DataFrame:
    """What happens to a mask at each step of each order: 32 x 120 x 5 rows, whatever the input."""
    rows = []
    for order in ORDERS:
        bits = [1 << FILTERS.index(f) for f in order]
        for mask in range(32):
            first = next((i for i, b in enumerate(bits) if mask & b), 5)
            for i, b in enumerate(bits):
                fails = bool(mask & b)
                alone = 120 // mask.bit_count() if fails else 0
                rows.append((mask, order, i + 1, int(first > i), int(first == i), int(fails and first < i), int(mask == b), alone))
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, stays int, goes int, late int, only int, orders int")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step; see op12."""
    counted = mask_counts(docs, labels)
    spread = counted.join(F.broadcast(outcomes(docs.sparkSession)), "mask")
    total = lambda flag, name: F.sum(F.col("n") * flag).cast("long").alias(name)
    return spread.groupBy("part", "filter_order", "step").agg(
        total(F.col("stays"), "kept"),
        total(F.col("goes"), "removed"),
        total(F.col("late"), "redundant"),
        total(F.col("only"), "unique_fails"),
        total(F.col("goes") * F.col("good"), "good_lost"),
        total(F.col("goes") * F.col("toxic"), "toxic_lost"),
        total(F.col("orders"), "shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH scored AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS capitals,
         regexp_matches(coalesce(text, ''), '[#$%&*|]') AS symbols,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS owner
  FROM documents),
marked AS (
  SELECT doc_id, part, {'A': len(words) < 100, 'B': 100 * list_unique(words) < 80 * len(words), 'C': 100 * capitals > 10 * length(text),
         'D': symbols, 'E': coalesce(doc_id > owner, false)} AS f
  FROM scored),
named AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, (CASE WHEN f['A'] THEN 'A' ELSE '' END || CASE WHEN f['B'] THEN 'B' ELSE '' END || CASE WHEN f['C'] THEN 'C' ELSE '' END
         || CASE WHEN f['D'] THEN 'D' ELSE '' END || CASE WHEN f['E'] THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM marked LEFT JOIN named USING (doc_id)),
counted AS (SELECT part, fails, good, toxic, count(*) AS n FROM rows GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
placed AS (
  SELECT c.*, filter_order, step, substr(filter_order, step, 1) AS filter,
         (SELECT min(i) FROM range(1, 6) t(i) WHERE contains(c.fails, substr(filter_order, i::INT, 1))) AS gone
  FROM counted c, steps),
table_ AS (
  SELECT part, filter_order, step::INT AS step, filter,
         coalesce(sum(n) FILTER (WHERE gone IS NULL OR gone > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND gone < step), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = filter), 0)::BIGINT AS unique_fails,
         coalesce(sum(n * good) FILTER (WHERE gone = step), 0)::BIGINT AS good_lost,
         coalesce(sum(n * toxic) FILTER (WHERE gone = step), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM table_
"""
