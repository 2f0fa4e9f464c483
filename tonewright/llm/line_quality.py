"""Quality rules over documents: repetition within a text, and lines that a host repeats over its documents.

A scan over Arrow buffers numbers words and lines exactly (Arrow's dictionaries), finds three-word windows
that come twice by ranking pairs and then triples of those numbers, and gives each line a 128-bit hash of
its words, lower-cased, digits as 0, one space between. How many distinct documents of a host (source) hold
a line is an aggregate of hashes. Lines above both limits, more than `max_docs` documents and more than
`max_share` of the host's documents, are removed, and a document that keeps less than `least_kept` of its
words is depleted and rejected, as are those that fail the rules on the text itself.

Lines are counted by host, hash and document before they are counted by host and hash, so a line that a
third of all documents hold is counted in every task that reads it and arrives as one row a task.

Defined cases: a null text has no words, a null source is the host ''; rows without a doc_id are one
document together where documents are counted, and judged by their own texts; rows that repeat a doc_id are
one document where documents are counted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.byte_scan import BASE, LOWERED, POINT_STARTS, WORD_BYTES, byte_class, held_powers, inverse, mixed, powers, run_codes, run_hashes, runs, sums_by_text, text_bytes
from tonewright.llm.shared import read_table, whole_texts, worker_state, written

MIN_WORDS, REPEATED = 50, 50
MAX_DOCS, MAX_SHARE, LEAST_KEPT = 50, 0.05, 0.5
LAST_ID = 2**63 - 1
SYMBOLS = byte_class(b"#*$%&|<>")
LINE_BYTES = ~byte_class(b"\n")
#: Lower case, and every digit a 0.
NORMAL = np.where(byte_class(b"123456789"), np.uint8(48), LOWERED)
LINE_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
COUNTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in it."""
    texts = len(before) - 1
    text = np.repeat(np.arange(texts), np.diff(before))
    at = np.flatnonzero(text[2:] == text[:-2]) if len(codes) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(texts, np.int64)
    pairs = np.unique(codes[at] << 32 | codes[at + 1], return_inverse=True)[1]
    triples = pairs << 32 | codes[at + 2]
    order = np.lexsort((triples, text[at]))
    same = (triples[order][1:] == triples[order][:-1]) & (text[at][order][1:] == text[at][order][:-1])
    found = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[found + k] = True
    return np.bincount(text[covered], minlength=texts)


def line_hashes(words: np.ndarray, first: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """Hash of the words of each line: word hashes times powers of their place. first, size: its words."""
    found = np.zeros(len(first), np.uint64)
    if not len(first):
        return found
    longest = int(size.max())
    raised = powers(base, longest) if longest > 1 << 16 else held_powers(base, 1 << 16)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * raised[place], out=prefix[1:])
    return mixed(prefix[first + size] - prefix[first])


def scan_block(data: np.ndarray, offsets: np.ndarray):
    """COUNTED for each text, and its distinct normalised lines: how many a text, their two hashes, and their words in all."""
    texts = len(offsets) - 1
    inside = WORD_BYTES[data]
    begins, ends, before = runs(inside, offsets)
    symbols, points = sums_by_text(data, offsets, [SYMBOLS, POINT_STARTS & WORD_BYTES])
    codes, _ = run_codes(data, inside, begins, ends)
    counts = [np.diff(before), points, symbols, np.zeros(texts, np.int64), repeated_words(codes, before)]
    line = LINE_BYTES[data]
    line_begins, line_ends, _ = runs(line, offsets)
    first = np.searchsorted(begins, line_begins)
    size = np.searchsorted(begins, line_ends) - first
    full = size > 0
    if full.any():
        raw, _ = run_codes(data, line, line_begins, line_ends)
        raw, first, size, line_begins = raw[full], first[full], size[full], line_begins[full]
        text = np.searchsorted(offsets, line_begins, side="right") - 1
        kinds = np.unique(text << 32 | raw) >> 32
        counts[3] = np.bincount(text, minlength=texts) - np.bincount(kinds, minlength=texts)
        words = mixed(run_hashes(NORMAL[data], begins, ends))
        hashes = [line_hashes(words, first, size, base).view(np.int64) for base in LINE_BASES]
        order = np.lexsort((hashes[1], hashes[0], text))
        text, size, hashes = text[order], size[order], [h[order] for h in hashes]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[0][1:] != hashes[0][:-1]) | (hashes[1][1:] != hashes[1][:-1])]))
        return counts, np.bincount(text[new], minlength=texts), hashes[0][new], hashes[1][new], np.add.reduceat(size, new)
    none = np.zeros(0, np.int64)
    return counts, np.zeros(texts, np.int64), none, none, none


LINES = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, did (null ids: the last), host, mark (hash of the text), COUNTED, and the distinct lines with their words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = F.col("doc_id").cast("long")
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    source = whole_texts(docs).select(ids.alias("doc_id"), F.coalesce(ids, F.lit(LAST_ID)).alias("did"), host.alias("host"), F.xxhash64(text).alias("mark"), text.alias("text"))

    def run(batches):
        worker_state("line_quality")
        for batch in batches:
            for start, end, data, offsets in text_bytes(batch.column(4)):
                counts, sizes, h1, h2, words = scan_block(data, offsets)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lines = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (h1, h2, words)], fields=list(LINES))
                made = [*(pa.array(x, pa.int64()) for x in counts), pa.ListArray.from_arrays(ends, lines)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in batch.columns[:4]), *made], names=["doc_id", "did", "host", "mark", *COUNTED, "lines"])

    schema = "doc_id long, did long, host string, mark long, " + ", ".join(f"{c} long" for c in COUNTED)
    return source.mapInArrow(run, schema + ", lines array<struct<h1:long,h2:long,words:long>>")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """doc_id, COUNTED, base_failed, n_removed_words (words of lines above the limits), kept."""
    rows = written(scan(docs))
    lines = rows.select("did", "mark", "host", F.explode("lines").alias("line")).select("did", "mark", "host", "line.*")
    key = ["host", "h1", "h2"]
    common = lines.groupBy(*key).agg(F.count_distinct("did").alias("n")).filter(F.col("n") > max_docs)
    hosts = rows.groupBy("host").agg(F.count_distinct("did").alias("docs"))
    common = written(common.join(hosts, "host").filter(F.col("n") > max_share * F.col("docs")).select(*key))
    # Rows that repeat a document have the same lines: one of them counts.
    document = ["did", "mark", "host"]
    hits = lines.join(common, key).groupBy(*document, "h1", "h2").agg(F.first("words").alias("words"))
    removed = hits.groupBy(*document).agg(F.sum("words").alias("gone"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    gone = F.coalesce("gone", F.lit(0))
    kept = ~failed & (F.col("n_words") - gone >= least_kept * F.col("n_words"))
    judged = rows.drop("lines").join(removed, document, "left")
    return judged.select("doc_id", *COUNTED, failed.alias("base_failed"), gone.alias("n_removed_words"), kept.alias("kept"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
placed AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
windows AS (
  SELECT r, i, w AS a, lead(w) OVER (PARTITION BY r ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM placed),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 3) t(k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs),
full_lines AS (
  SELECT r, doc_id, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY r),
normal AS (
  SELECT r, coalesce(doc_id, 9223372036854775807) AS did, host, len(words) AS n,
         translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS key
  FROM full_lines),
hosts AS (SELECT host, count(DISTINCT coalesce(doc_id, 9223372036854775807)) AS docs FROM docs GROUP BY host),
common AS (
  SELECT host, key FROM (SELECT host, key, count(DISTINCT did) AS n FROM normal GROUP BY host, key) JOIN hosts USING (host)
  WHERE n > 50 AND n > 0.05 * docs),
gone AS (SELECT r, sum(n) AS n FROM normal JOIN common USING (host, key) GROUP BY r),
joined AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM docs LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM joined
"""
