"""Near copies over a corpus: texts whose normal forms are alike by the paragraph predicate, and their groups.

1. Equal normal forms become one node with their smallest key, before anything is compared.
2. Every pair of forms of close lengths meets in one cell: lengths are cut into bands, bands into slices of `SLICE_BYTES`,
   and each two slices that can hold alike forms make a cell, which is a group of one task.
3. In a cell, pairs are discarded by how many n-grams they can't share, counted over parities of hashed n-grams. Alike forms
   have few enough matching blocks for this to lose none (`most_apart`). What is left is compared by the predicate.
4. Groups are what links connect. Most come from a quick look first: a form gets `BANDS` keys of least hashes, and under a
   key forms in order of length are held against up to `WINDOW` before them. Then cells bring together every pair whose
   ends are still in two groups.

Links and groups are those of all pairs. The work in cells grows with the square of the forms of close lengths; memory is
that of two slices, whatever the table.

Null and empty texts have the empty form and are exact copies of one another. Forms under 12 characters have exact
copies only. Rows with a null key take part in no group: they come back with a null first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.functions.stages import materialised
from tonewright.operators.paragraphs import LENGTH_RATIO, SHORTEST, THRESHOLD, near, normal_form

GRAM = 4  # characters of an n-gram that parities are counted of
SHORT = 200  # below as many characters, the library starts a block at any character
LEAST_BITS, MOST_BITS = 4096, 1 << 17  # of parities: 2 to 4 a character
SLICE_BYTES = 8 << 20
PAIRS_AT_ONCE, AT_A_TIME = 1 << 15, 2048
#: The quick look.
BANDS, WINDOW = 32, 16
#: From which length: characters of an n-gram, least hashes of a key.
GRAMS = [(SHORTEST, 4, 1), (64, 8, 2), (256, 12, 2)]
#: Alike forms differ in length by at most this factor.
LEAST_RATIO = THRESHOLD / (2 - THRESHOLD)
BAND_FACTOR = 1.5
AT_ONCE = 8192
_RNG = np.random.default_rng(20)
MULTIPLIERS = (_RNG.integers(1, 2**63, 2 * BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)


def least_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of 2 * BANDS hash functions over the n-grams of a form."""
    grams = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        grams = grams * GRAM_BASE + codes[k : len(codes) - n + 1 + k]
    grams = (grams ^ (grams >> np.uint64(31))) * GRAM_BASE
    least = np.full(2 * BANDS, 2**64 - 1, np.uint64)
    for a in range(0, len(grams), AT_ONCE):
        mixed = grams[None, a : a + AT_ONCE] * MULTIPLIERS[:, None]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(1), out=least)
    return least


def form_keys(form: str) -> np.ndarray:
    """The keys of one form; none if it is too short."""
    length = len(form)
    codes = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    number = np.arange(BANDS, dtype=np.uint64)
    band = np.floor(np.log(max(length, 1)) / np.log(BAND_FACTOR) + np.arange(BANDS) / BANDS).astype(np.uint64)
    found = []
    for i, (least, n, hashes) in enumerate(GRAMS):
        upto = GRAMS[i + 1][0] / LEAST_RATIO if i + 1 < len(GRAMS) else np.inf
        if least <= length < upto:
            mins = least_hashes(codes, n)
            key = mins[:BANDS] if hashes == 1 else mins[:BANDS] * np.uint64(31) + mins[BANDS:]
            found.append(((key * GRAM_BASE + number) * GRAM_BASE + band) * GRAM_BASE + np.uint64(n))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def quick_pairs(nodes: DataFrame) -> DataFrame:
    """a, b (a before b): nodes that share a key and are close in its order of lengths, where most links are. nodes: node, form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [form_keys(f) for f in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, flat)], names=["node", "size", "keys"])

    kind = dict(nodes.dtypes)["node"]
    source = nodes.select("node", "form", F.length("form").alias("size")).filter(F.col("size") >= SHORTEST)
    keyed = source.mapInArrow(run, f"node {kind}, size int, keys array<long>").select("node", "size", F.explode("keys").alias("key"))
    before = F.collect_list("node").over(Window.partitionBy("key").orderBy("size", "node").rowsBetween(-WINDOW, -1))
    close = keyed.withColumn("before", before).select("node", F.explode("before").alias("other"))
    return close.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def starts(form: str) -> int:
    """How many characters the library may start a block at, if the form is its second text."""
    return len(form) if len(form) < SHORT else sum(n for n in Counter(form).values() if n <= len(form) // 100 + 1)


def parity_bits(length: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * length - 1).bit_length()))


def parities(form: str, n: int = GRAM) -> np.ndarray:
    """Parity of a form's n-grams in each of `parity_bits` classes, as 64-bit words. Two forms differ in at least as many n-grams as these in bits.

    An n-gram that comes again counts as another one, or even repeats would leave no trace.
    """
    codes = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        grams = grams * GRAM_BASE + codes[k : len(codes) - n + 1 + k]
    grams.sort()
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    place = np.arange(len(grams))
    repeat = place - np.maximum.accumulate(np.where(first, place, 0))
    grams = (grams ^ (grams >> np.uint64(31))) * GRAM_BASE + repeat.astype(np.uint64) * MULTIPLIERS[0]
    grams = (grams ^ (grams >> np.uint64(31))) * GRAM_BASE
    bits = parity_bits(len(codes))
    held = np.bincount((grams >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(held.astype(bool)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (64-bit words) over fewer classes: equal parts fold on one another."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words))


def most_apart(both: np.ndarray, blocks: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """In how many n-grams two alike forms can differ. both: sum of their lengths; blocks: how many matching blocks there can be.

    The library's blocks hold threshold * both / 2 characters at least, apart in both forms, and between any two a character is
    left out. A block of L characters is L - n + 1 shared n-grams.
    """
    matched = np.ceil(threshold * both / 2 - 1e-6)
    shared = matched - (n - 1) * np.minimum(blocks, both - 2 * matched + 1)
    return both - 2 * (n - 1) - 2 * np.maximum(shared, 0)


def least_ratio(threshold: float) -> float:
    """Of the lengths of two alike forms."""
    return max(LENGTH_RATIO, threshold / (2 - threshold))


class Side:
    """Rows of one slice in a cell, by size."""

    def __init__(self, size: np.ndarray, begun: np.ndarray, bits: list[np.ndarray], group: np.ndarray | None):
        self.size, self.begun, self.group = size.astype(np.int64), begun.astype(np.int64), group
        self.bits = bits

    def matrix(self, words: int) -> np.ndarray:
        return np.array([folded(x, words) for x in self.bits], np.uint64).reshape(-1, words)


def cell_pairs(one: Side, two: Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of two sides that can be alike; of one side held against itself each pair once."""
    words = min(min(map(len, one.bits)), min(map(len, two.bits)))
    left = one.matrix(words)
    right = left if one is two else two.matrix(words)
    # Folded to fewer classes, parities differ in no more bits; classes lie along rows for the sums.
    levels = [words >> k for k in (3, 2, 1, 0)]
    lefts = [np.bitwise_xor.reduce(left.reshape(len(left), -1, w), axis=1) for w in levels]
    rights = [np.ascontiguousarray(np.bitwise_xor.reduce(right.reshape(len(right), -1, w), axis=1).T) for w in levels]
    ratio = least_ratio(threshold) - 1e-9
    low = np.searchsorted(two.size, one.size * ratio, side="left")
    high = np.searchsorted(two.size, one.size / ratio, side="right")
    for i in range(len(one.size)):
        first = i + 1 if one is two else int(low[i])
        for at in range(first, int(high[i]), AT_A_TIME):
            places = slice(at, min(int(high[i]), at + AT_A_TIME))
            limits = most_apart(one.size[i] + two.size[places], np.maximum(one.begun[i], two.begun[places]), GRAM, threshold)
            # The fewest classes that tell unlike forms apart; what they leave is held against all.
            both, usual = float(one.size[i] + two.size[at]), float(limits[:: max(1, len(limits) >> 5)].mean())
            told = [32 * w * (1 - np.exp(-1.3 * both / (64 * w))) * 0.9 > usual for w in levels]
            level = told.index(True) if any(told) else len(levels) - 1
            apart = np.bitwise_count(rights[level][:, places] ^ lefts[level][i][:, None]).sum(axis=0, dtype=np.int32)
            good = apart <= limits
            if one.group is not None:
                good &= two.group[places] != one.group[i]
            found = np.flatnonzero(good)
            if len(found) and levels[level] < words:
                apart = np.bitwise_count(right[at + found] ^ left[i]).sum(axis=1, dtype=np.int32)
                found = found[apart <= limits[found]]
            if len(found):
                yield np.full(len(found), i), at + found


def candidate_pairs(nodes: DataFrame, threshold: float = THRESHOLD, roots: DataFrame | None = None) -> DataFrame:
    """a, b (a before b): every pair of nodes that can be alike, once. nodes: node, form; with roots (node, root), only pairs of two groups."""
    kind = dict(nodes.dtypes)["node"]
    width = float(np.log(max(1.05, 1.0001 / least_ratio(threshold))))
    part = nodes.select("node", "form", F.length("form").alias("size")).filter(F.col("size") >= SHORTEST)
    part = part.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(width)).cast("int"))
    grouped = roots is not None
    part = part.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if grouped else part.withColumn("root", F.col("node"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(1).to_pylist()
            begun, bits = pa.array([starts(f) for f in forms], pa.int32()), pa.array([parities(f).tobytes() for f in forms], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in (2, 3, 4)], begun, bits], names=["node", "size", "band", "root", "begun", "bits"])

    # 2 to 4 bits a character; the size of a slice follows the bits of the longest of its band.
    weight = F.greatest(F.lit(LEAST_BITS), F.least(F.lit(MOST_BITS), F.col("size") * F.lit(4))) / F.lit(8)
    slices = part.groupBy("band").agg(F.ceil(F.sum(weight) / F.lit(SLICE_BYTES)).cast("int").alias("slices"))
    known = F.broadcast(materialised(slices))
    made = part.select("node", "form", "size", "band", "root").mapInArrow(sketched, f"node {kind}, size int, band int, root {kind}, begun int, bits binary")
    for shift, name in ((-1, "below"), (0, "slices"), (1, "above")):
        made = made.join(known.select((F.col("band") - F.lit(shift)).alias("band"), F.col("slices").alias(name)), "band", "left")
    made = made.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    each = lambda upto, make: F.when(F.coalesce(upto, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.coalesce(upto, F.lit(1)) - 1), make)).otherwise(F.array())
    cell = lambda low_band, low, high_band, high, side: F.struct(low_band.alias("low_band"), low.alias("low"), high_band.alias("high_band"), high.alias("high"), side.alias("side"))
    band, own = F.col("band"), F.col("own")
    cells = F.concat(
        each(F.col("below"), lambda i: cell(band - 1, i, band, own, F.lit(1))),
        each(F.col("slices"), lambda i: cell(band, F.least(own, i), band, F.greatest(own, i), (own > i).cast("int"))),
        each(F.col("above"), lambda i: cell(band, own, band + 1, i, F.lit(0))),
    )
    spread = made.withColumn("cell", F.explode(cells)).select("cell.low_band", "cell.low", "cell.high_band", "cell.high", "cell.side", "size", "begun", "node", "root", "bits")
    key = ["low_band", "low", "high_band", "high"]
    dealt = spread.repartition(shuffle_partitions(part.sparkSession), *key).sortWithinPartitions(*key, "side", "size")

    def side_of(rows: pa.Table, group: np.ndarray | None) -> Side:
        bits = [np.frombuffer(x, np.uint64) for x in rows.column("bits").to_pylist()]
        return Side(rows.column("size").to_numpy(), rows.column("begun").to_numpy(), bits, group)

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side = rows.column("side").to_numpy()
        at = int(np.searchsorted(side, 1))
        same = rows.column("low_band")[0] == rows.column("high_band")[0] and rows.column("low")[0] == rows.column("high")[0]
        if not same and not 0 < at < len(side):
            return
        group = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy() if grouped else None
        part_of = lambda a, b: side_of(rows.slice(a, b - a), None if group is None else group[a:b])
        one = part_of(0, len(side)) if same else part_of(0, at)
        two = one if same else part_of(at, len(side))
        node = rows.column("node").combine_chunks()
        held, count = [], 0

        def batch_of(held):
            x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([node.take(pa.array(x)), node.take(pa.array(y + (0 if same else at)))], names=["x", "y"])

        for found in cell_pairs(one, two, threshold):
            held.append(found)
            count += len(found[0])
            if count >= PAIRS_AT_ONCE:
                yield batch_of(held)
                held, count = [], 0
        if held:
            yield batch_of(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            marks = np.stack([rows.column(k).to_numpy() for k in key])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), len(rows)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                name = tuple(marks[:, a].tolist())
                if held and name != now:
                    yield from pairs_of(pa.concat_tables(held))
                    held = []
                held.append(rows.slice(a, b - a))
                now = name
        if held:
            yield from pairs_of(pa.concat_tables(held))

    return dealt.mapInArrow(meet, f"x {kind}, y {kind}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def shuffle_partitions(spark: SparkSession) -> int:
    """Cells differ in size, so there are some for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def alike_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """a, b: the pairs that the predicate calls alike; the later form is held against the earlier, as within a text."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("form").alias(f"form_{name}"))
    # Sorted by the earlier form, whose characters are then placed once.
    joined = pairs.join(side("b"), "b").join(side("a"), "a")

    @F.pandas_udf("boolean")
    def alike(later: pd.Series, earlier: pd.Series) -> pd.Series:
        return pd.Series([near(x, y, threshold) for x, y in zip(later, earlier, strict=True)], dtype=bool)

    return joined.filter(alike("form_b", "form_a")).select("a", "b")


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: all pairs that are alike."""
    return alike_pairs(candidate_pairs(nodes, threshold), nodes, threshold)


def groups(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, root (the smallest node that links reach), for nodes with a link: quick links first, then all pairs of two groups."""
    quick = materialised(components(alike_pairs(quick_pairs(nodes), nodes, threshold)))
    rest = alike_pairs(candidate_pairs(nodes, threshold, quick), nodes, threshold)
    return components(rest.unionByName(quick.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for nodes with a link.

    Stars are turned in two ways until nothing moves: every larger neighbour of a node is tied to the smallest of its
    neighbourhood, then every smaller one and the node itself. The number of rounds grows with the logarithm of a
    group's size; each is an aggregate and a join, which Spark splits where a node has many links.
    """
    edges = materialised(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned = materialised(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark(turned) == mark(edges):
            roots = turned.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(turned.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = turned


def marked_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).alias("id"), normal_form(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("form"))
    return rows.select("id", "form", F.sha2(F.col("form").cast("binary"), 256).alias("mark"))


def corpus_nodes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """mark, node (smallest key), copies, form: a row a normal form."""
    named = marked_rows(df, key, text).filter("id IS NOT NULL")
    return materialised(named.groupBy("mark").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("form").alias("form")))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, first (smallest key of its group), copies (rows with its normal form), group_rows (rows of its group)."""
    nodes = corpus_nodes(df, key, text)
    roots = groups(nodes.select("node", "form"), threshold)
    classes = nodes.select("mark", "node", "copies").join(roots, "node", "left").select("mark", "copies", F.coalesce("root", "node").alias("first"))
    sizes = classes.groupBy("first").agg(F.sum("copies").alias("group_rows"))
    whole = materialised(classes.join(sizes, "first"))
    marked = marked_rows(df, key, text).select("id", "mark")
    # Rows without a key find no class, and are dealt out by their text.
    found = marked.join(whole, (marked["mark"] == whole["mark"]) & marked["id"].isNotNull(), "left")
    return found.select(F.col("id").alias(key), "first", "copies", "group_rows")
