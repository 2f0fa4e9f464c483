"""Line dedup against levelled sorted runs of line hashes; DataFrame functions only.

Documents come in batches of ascending doc_id. A batch's distinct line hashes are merge-anti-joined with
the runs written so far; what is new becomes a run of its own, bucketed and sorted by hash, with the
smallest document that holds the line. When a level has `fanout` runs they are compacted to one run of the
next level. As batches ascend, a line's first owner never changes. Runs are tables bucketed alike, so the
merges read them in order without a shuffle.

A key is a line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lowered, held as 128 bits of hash.
Keys of at least `min_chars` code points in two or more documents lose their lines, but for the smallest
doc_id holding them. Lines that hold a thousandth of all lines or more (a thousand of them at most, so they
can be broadcast) are settled apart from the merge, which keeps them out of single tasks.

Defined cases: null and empty texts are one empty line; rows with a null doc_id count as one document after
all others; repeated rows share an id and are one document; an empty table gives an empty result; other
columns of the input are kept by `drop_lines` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.shared import cut, fresh_name, read_table, shuffle_partitions, unused

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
LAST_ID = 2**63 - 1
HEAVY_SHARE = 1000
HASHES = ["h1", "h2"]


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LevelledRuns:
    """Sorted, bucketed runs of (h1, h2, owner), each key in one run only."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        for run in self.runs():
            batch = batch.join(run.hint("merge"), HASHES, "left_anti")
        return batch

    def write(self, rows: DataFrame) -> str:
        name = fresh_name("line_run")
        writer = rows.repartition(self.buckets, *HASHES).write.format("parquet")
        writer.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).saveAsTable(name)
        return name

    def add(self, rows: DataFrame, compact: bool = True) -> None:
        self.levels[0].append(self.write(rows))
        level = 0
        while compact and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(merged))
            self.levels[level] = []
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]


def doomed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """did, mark (hash of the text) and the positions of the lines to drop; checkpointed."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"))
    cuts = ids.agg(F.percentile_approx("did", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    number = sum((F.when(F.col("did") > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), F.col("text").cast("string").alias("text"))
    lines = rows.select("did", F.xxhash64("text").alias("mark"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("did", "mark", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hashed = keyed.select("did", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), number.alias("batch"))
    name = fresh_name("line_hashes")
    hashed.write.format("parquet").partitionBy("batch").saveAsTable(name)
    # As many buckets as shuffle partitions: a write deals its rows to one file a bucket.
    runs = LevelledRuns(spark, parts, fanout)
    try:
        held = spark.table(name)
        total = held.count()
        last = len(set(cuts))
        for k in range(last + 1):
            first = held.filter(F.col("batch") == k).groupBy(*HASHES).agg(F.min("did").alias("owner"))
            runs.add(runs.unseen(first), compact=k < last)
        every = runs.runs()[0]
        for run in runs.runs()[1:]:
            every = every.unionByName(run)
        heavy = held.groupBy(*HASHES).agg(F.count("*").alias("n")).filter(F.col("n") >= max(1000, total // HEAVY_SHARE)).select(*HASHES)
        heavy = cut(every.join(F.broadcast(heavy), HASHES))  # a thousand rows at most
        rest = held.join(F.broadcast(heavy.select(*HASHES)), HASHES, "left_anti")
        doomed = rest.join(every.hint("merge"), HASHES).filter("did > owner").select("did", "mark", "pos")
        doomed = doomed.unionByName(held.join(F.broadcast(heavy), HASHES).filter("did > owner").select("did", "mark", "pos"))
        return cut(doomed.groupBy("did", "mark").agg(F.collect_set("pos").alias("doomed")))
    finally:
        runs.drop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents with their texts reduced to kept lines, plus n_lines and n_dropped (underscores before them where docs has such columns)."""
    doomed = doomed_lines(docs, min_chars, batches, fanout)
    names = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("row"))
    held = held.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), F.xxhash64(F.col("row.text").cast("string")).alias("mark"))
    lines = split_lines(F.col("row.text").cast("string"))
    joined = held.join(doomed, ["did", "mark"], "left").select("row", "doomed", lines.alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("doomed"))
    text = F.when(F.col("doomed").isNull(), F.col("row.text").cast("string"))
    text = text.otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(F.col("lines"), i + 1)), "\n"))
    return joined.select(
        *[(text if c == "text" else F.col("row")[c]).alias(c) for c in names],
        F.size("lines").cast("long").alias(unused("n_lines", names)),
        F.coalesce(F.size("doomed"), F.lit(0)).cast("long").alias(unused("n_dropped", names)),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owned AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE k.doc_id <> o.owner) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE o.owner IS NULL OR o.owner = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN owned o ON k.key = o.key
GROUP BY k.doc_id
"""
