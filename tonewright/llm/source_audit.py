"""Which sources of a language speak unlike the others, and by which terms.

Terms are counted by language and source in Arrow blocks and then by Spark. Each language keeps the terms
that at least `min_docs` of its documents hold. A group's share of a term is p = 1 + floor(10^9 (count + 5)
/ (N + 5 V)) over its kept terms, worked out digit by digit in whole numbers; a term that a group does not
hold has the group's baseline share.

* Pairs of sources. The sum of |p - q| over all kept terms is the sum of both totals less twice the sum of
  the smaller shares. Of two sources the one with the lower baseline is below the other's baseline wherever
  it holds no term, so the smaller shares follow from its own terms held against the other's baseline (a
  running sum over its shares), corrected where both hold a term. Only terms that both hold form pairs.
* Terms that a source uses more than its language. The k-th largest difference of each group is found by
  radix selection: histograms over ten bits of the value at a time, narrowed to the bin that holds the k-th.
  Where more terms tie at that value than are wanted, the same goes on over the bytes of their UTF-8 text
  after what they share, until few enough are left to be sorted.

Nothing but histograms (1024 bins a group), thresholds and group totals is gathered, all as DataFrames.

Defined cases: null text, lang and source are ''. Repeated rows count each. A group without terms has
pairs, all of whose shares are baselines; a language without kept terms has pairs of value 0. A language
with one source has no pairs. An empty table gives no rows. Other columns, and doc_id, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.llm.byte_scan import LOWERED, byte_class, run_codes, runs, text_bytes
from tonewright.llm.shared import cut, read_table, whole_texts, worker_state, written

MIN_DOCS, TOP = 30, 50
SCALE_DIGITS, ADDED = 3, 5  # three steps of a factor 1000; what is added to each count
VALUE_BITS, STEP_BITS = 30, 10
#: Tied terms of a group that are sorted rather than split further.
FINISH = 1000
BLOCK_BYTES = 8_000_000
#: ASCII other than letters parts terms.
TERM_BYTES = ~byte_class(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def block_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """Of a block whose texts belong to numbered groups: group, term, occurrences and texts, a row a group and term."""
    inside = TERM_BYTES[data]
    begins, ends, before = runs(inside, offsets)
    codes, names = run_codes(LOWERED[data], inside, begins, ends)
    many = max(1, len(names))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    held, times = np.unique(text * many + codes, return_counts=True)
    key = group[held // many] * many + held % many
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(times, new) if len(new) else new
    return key[new] // many, names.take(pa.array(key[new] % many)), n, np.diff(np.concatenate([new, [len(key)]]))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents); every group has a row with the empty term, n and d 0."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    source = whole_texts(docs).select(blank("lang"), blank("source"), blank("text"))

    def run(batches):
        worker_state("source_audit")
        for batch in batches:
            for start, end, data, offsets in text_bytes(batch.column(2), BLOCK_BYTES):
                columns = [batch.column(i).slice(start, end - start).dictionary_encode() for i in (0, 1)]
                lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
                width = len(columns[1].dictionary)
                groups, group = np.unique(lang * width + source, return_inverse=True)
                at, terms, n, d = block_counts(data, offsets, group)
                at = np.concatenate([at, np.arange(len(groups))])
                none = np.zeros(len(groups), np.int64)
                names = [c.dictionary.take(pa.array(x)) for c, x in zip(columns, (groups[at] // width, groups[at] % width), strict=True)]
                terms = pa.concat_arrays([terms.cast(pa.string()), pa.array([""] * len(groups), pa.string())])
                yield pa.RecordBatch.from_arrays([*(x.cast(pa.string()) for x in names), terms, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([d, none]))], names=["lang", "source", "term", "n", "d"])

    return source.mapInArrow(run, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)); exact while the divisor is under 9 * 10^15. 0 without terms."""
    part, whole = count + F.lit(ADDED).cast("long"), total + ADDED * terms
    whole = F.when(whole > 0, whole).otherwise(1)
    div = lambda a, b: F.call_function("div", a, b)
    found, rest = div(part, whole), part % whole
    for _ in range(SCALE_DIGITS):
        found, rest = found * 1000 + div(rest * 1000, whole), rest * 1000 % whole
    return F.when(terms > 0, 1 + found).otherwise(0)


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """The groups' counts of kept terms, with the language's count, and whether the row is the term's first; and the rows of the empty term."""
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).select("lang", "source", "term", "n", F.sum("d").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), F.row_number().over(term.orderBy("source")).alias("place"))
    return counted.filter((F.col("docs") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n", (F.col("place") == 1).alias("first"))


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, total (N), held (kept terms it has), terms (V) and lang_total of the language, base (the share of a term it lacks)."""
    named = F.col("term") != ""
    groups = cut(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(named).alias("held"), F.count_if(named & F.col("first")).alias("firsts")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
    joined = groups.drop("firsts").join(langs, "lang")
    return joined.withColumn("base", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))


def pair_divergence(scored: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of a language's sources."""
    sums = scored.groupBy("lang", "source").agg(F.sum("p").alias("sum_p"))
    whole = totals.join(sums, ["lang", "source"], "left")
    whole = cut(whole.select("lang", "source", "base", "held", "terms", (F.coalesce("sum_p", F.lit(0)) + (F.col("terms") - F.col("held")) * F.col("base")).alias("all_p")))
    side = lambda mark: whole.select("lang", *[F.col(c).alias(f"{c}_{mark}") for c in ("source", "base", "held", "terms", "all_p")])
    lower = F.struct("base_a", "source_a") < F.struct("base_b", "source_b")
    pairs = side("a").join(side("b"), "lang").filter(lower)
    # Own terms of the lower one against the other's baseline: shares (kind 0) below each baseline asked for (kind 1), as running sums.
    histogram = scored.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    none = F.lit(None)
    events = histogram.select("lang", "source", F.col("p").alias("at"), F.lit(1).alias("kind"), "m", (F.col("p") * F.col("m")).alias("pm"), none.cast("string").alias("item"), *[none.cast("long").alias(c) for c in ("known", "held", "both_p")])
    known = F.col("all_p_a") + F.col("all_p_b") - 2 * (F.col("terms_a") - F.col("held_a")) * F.col("base_a")
    asked = pairs.select("lang", F.col("source_a").alias("source"), F.col("base_b").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("pm"), F.col("source_b").alias("item"), known.alias("known"), F.col("held_a").alias("held"), F.lit(0).cast("long").alias("both_p"))
    running = Window.partitionBy("lang", "source").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = events.unionByName(asked).withColumns({"below": F.sum("m").over(running), "below_pm": F.sum("pm").over(running)}).filter("item IS NOT NULL")
    own = own.select("lang", "source", "item", (F.col("known") - 2 * (F.col("below_pm") + (F.col("held") - F.col("below")) * F.col("at"))).alias("value"))
    # Where both hold a term: the smaller share instead of what was taken above.
    entry = lambda mark: scored.select("lang", "term", *[F.col(c).alias(f"{c}_{mark}") for c in ("source", "p", "base")])
    met = entry("a").join(entry("b"), ["lang", "term"]).filter(lower)
    mended = met.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg((-2 * F.sum(F.least("p_a", "p_b") - F.least("p_a", "base_b"))).alias("value"))
    value = own.unionByName(mended).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return value.select("lang", "value", F.explode(both).alias("e")).select("lang", "e.source", "e.item", "value")


def chosen_bin(histogram: DataFrame, keys: list[str], descending: bool) -> DataFrame:
    """Of each group the bin that holds the last row wanted, with what is still wanted in it (need) and what it holds (left)."""
    order = F.col("bin").desc() if descending else F.col("bin")
    upto = F.sum("left").over(Window.partitionBy(*keys).orderBy(order))
    ranked = histogram.withColumn("upto", upto)
    before = F.col("upto") - F.col("left")
    return ranked.filter((before < F.col("need")) & (F.col("upto") >= F.col("need"))).withColumn("need", F.col("need") - before).drop("upto")


def thresholds(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Groups with more than k rows: limit (the k-th largest value), need (rows wanted at the limit), left (rows at the limit)."""
    state = None
    for shift in range(VALUE_BITS - STEP_BITS, -1, -STEP_BITS):
        digit = F.shiftright("value", shift).bitwiseAND((1 << STEP_BITS) - 1).alias("bin")
        if state is None:
            found = rows.groupBy(*keys, digit).agg(F.count("*").alias("left")).select(*keys, F.lit(0).cast("long").alias("limit"), F.lit(k).cast("long").alias("need"), "bin", "left")
        else:
            there = rows.join(state, keys).filter(F.shiftright("value", shift + STEP_BITS) == F.col("limit"))
            found = there.groupBy(*keys, "limit", "need", digit).agg(F.count("*").alias("left"))
        state = cut(chosen_bin(found, keys, True).select(*keys, (F.shiftleft("limit", STEP_BITS) + F.col("bin")).alias("limit"), "need", "left"))
    return state


def common_start(a: Column, b: Column) -> Column:
    """How many leading hexadecimal digits two strings share, in whole bytes."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    unlike = F.array_position(same, F.lit(False))
    length = F.when(unlike > 0, unlike - 1).otherwise(F.length(a))
    return (length - length % 2).cast("int")


def tie_bounds(ties: DataFrame, keys: list[str], finish: int = FINISH) -> DataFrame:
    """Of each group's tied texts (hx, hexadecimal; need: how many are wanted) a start so that all before it and those with it hold the wanted ones.

    ties has need and left; at most `finish` rows have the start, or no more than are wanted.
    """
    done = None
    state = cut(ties.groupBy(*keys).agg(F.first("need").alias("need"), F.count("*").alias("left")).withColumn("start", F.lit("")))
    held = ties.select(*keys, "hx")
    while True:
        settled = state.filter((F.col("left") <= finish) | (F.col("left") <= F.col("need"))).select(*keys, "start")
        done = settled if done is None else done.unionByName(settled)
        state = state.filter((F.col("left") > finish) & (F.col("left") > F.col("need")))
        if state.isEmpty():
            return done
        there = held.join(state, keys).filter(F.startswith("hx", "start"))
        ends = there.groupBy(*keys).agg(F.min("hx").alias("least"), F.max("hx").alias("most"))
        shared = ends.select(*keys, F.substring("least", F.lit(1), common_start(F.col("least"), F.col("most"))).alias("shared"))
        there = there.join(shared, keys)
        after = F.substring("hx", F.length("shared") + 1, F.lit(2)).alias("bin")  # empty where the text ends
        found = there.groupBy(*keys, "need", "shared", after).agg(F.count("*").alias("left"))
        state = cut(chosen_bin(found, keys, False).select(*keys, "need", "left", F.concat("shared", "bin").alias("start")))


def largest(rows: DataFrame, keys: list[str], k: int, finish: int = FINISH) -> DataFrame:
    """The k rows of each group with the largest values, ties by the bytes of item; keys, item, value, rank."""
    limits = thresholds(rows, keys, k)
    hx = F.hex(F.encode("item", "UTF-8"))
    judged = rows.join(limits, keys, "left")
    above = judged.filter(F.col("limit").isNull() | (F.col("value") > F.col("limit")) | ((F.col("value") == F.col("limit")) & (F.col("left") <= F.col("need"))))
    ties = written(judged.filter((F.col("value") == F.col("limit")) & (F.col("left") > F.col("need"))).select(*keys, "item", "value", "need", hx.alias("hx")))
    starts = tie_bounds(ties, keys, finish)
    # At most k before the start, and with it `finish` or as many as are wanted: few enough to sort.
    near = ties.join(starts, keys).filter((F.col("hx") < F.col("start")) | F.startswith("hx", "start"))
    few = above.select(*keys, "item", "value").unionByName(near.select(*keys, "item", "value"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("value").desc(), "item"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= k)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, finish: int = FINISH) -> DataFrame:
    """lang, source, part, item, value, rank; see op11."""
    kept = written(kept_terms(docs, min_docs))
    totals = cut(group_totals(kept))
    terms = kept.filter(F.col("term") != "").join(totals, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    scored = written(terms.select("lang", "source", "term", "base", p.alias("p"), q.alias("q")))
    keys = ["lang", "source"]
    over = scored.filter("p > q").select(*keys, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    most = largest(over, keys, top, finish)
    pairs = pair_divergence(scored.drop("q"), totals)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("value").desc(), "item")))
    part = lambda df, name: df.select(*keys, F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(most, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
tokens AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
counted AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
         sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total,
         count(*) OVER (PARTITION BY lang, source) AS terms
  FROM dense),
both_ AS (SELECT *, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * terms) AS q FROM shares),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM both_ WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
