"""SimHash near-duplicates found through a table of distances to pivot fingerprints.

Every fingerprint gets a row of Hamming distances to many reference fingerprints (the pivots): zero, and
for each block of bits one Walsh pattern a bit, zero elsewhere. By the triangle inequality, two
fingerprints within radius r differ by at most r in every coordinate. The pivots of a block also fix the
block's bits, so of `blocks` blocks at least blocks - r have equal coordinates in a linked pair: each
choice of that many blocks gives a join key. Pairs that meet under a key are discarded by their maximum
coordinate difference, and survivors are verified by counting bits.

Only a spanning set of links leaves a group, never all pairs. Groups of over `bin_limit` fingerprints are split
by the same table: the blocks that their key leaves free are cut into blocks in turn, whose coordinates make
finer keys, until groups are small or no bits are left to cut. Components come from alternating star
contractions, cut by checkpoints.

`similar_documents` links by similarity of shingle sets. The links of the sets' SimHash fingerprints, found as above,
are held against the sets themselves. As sets that are alike enough can be further apart than the radius, what is still
apart meets under its rarest shingles too, which completes the links. There, a parity fingerprint discards pairs: it holds
the parity of a set's members in each of many classes, so it differs in no more bits than sets differ in members.

Defined cases: null or empty text has fingerprint zero and is linked like any other; rows with a null
doc_id get a fingerprint and a null component; repeated rows and ids are repeated in the result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.llm.shared import cut, read_table, release, shuffle_partitions, whole_texts, worker_state

SEED = 42
BITS = 64
RADIUS = 2
BLOCKS = 4
BIN_LIMIT = 512  # fingerprints under one key, above which it is split into finer keys
PAIR_CHUNK = 1 << 21


def fingerprint(text: bytes, words_a_shingle: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_a_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - words_a_shingle + 1].tolist()
    stops = (ends[words_a_shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(0, len(raw), 255):  # a byte holds a sum of 255 bits
        counts += np.add.reduce(np.unpackbits(raw[k : k + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(raw), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_a_shingle: int = 3) -> DataFrame:
    """doc_id and signed 64-bit fp of every whole text."""

    def run(batches):
        worker_state("simhash")
        for batch in batches:
            found = [fingerprint(t or b"", words_a_shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return whole_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_edges(blocks: int) -> list[tuple[int, int]]:
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def pivots(blocks: int = BLOCKS) -> np.ndarray:
    """Zero, and for each block as many Walsh patterns as it has bits."""
    out = [0]
    for low, high in block_edges(blocks):
        for walsh in range(high - low):
            # Walsh pattern 0 is turned into all ones; the others mark bits whose masked index has odd parity.
            pattern = [1 if walsh == 0 else bin(walsh & bit).count("1") & 1 for bit in range(high - low)]
            if (high - low) & (high - low - 1):  # not a power of two: unit patterns fix the bits
                pattern = [int(bit == walsh) for bit in range(high - low)]
            out.append(sum(b << (low + i) for i, b in enumerate(pattern)))
    return np.array(out, np.uint64)


def distances(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.uint8)


def pivot_table(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp, its distances to the pivots, and a key for every choice of blocks - radius blocks."""
    references = pivots(blocks)
    edges = block_edges(blocks)
    choices = list(combinations(range(blocks), blocks - radius))
    starts = np.cumsum([1, *(b - a for a, b in edges)])

    def run(batches):
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            table = distances(signed.view(np.uint64), references)
            # The block's own part of a distance: less what the other blocks add, which the zero pivot knows.
            local = table.astype(np.int16) - table[:, :1].astype(np.int16)
            local = np.ascontiguousarray(local.astype(np.int8))
            names, keys, members, coordinates = [], [], [], []
            raw = [row.tobytes() for row in table]
            for number, chosen in enumerate(choices):
                columns = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in chosen])
                part = np.ascontiguousarray(local[:, columns])
                keys.append(np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), number) for r in part), np.uint64, len(part)).view(np.int64))
                names.append(np.full(len(part), number, np.int32))
                members.append(signed)
                coordinates += raw
            if len(signed):
                columns = [pa.array(np.concatenate(names)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(members)), pa.array(coordinates, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["choice", "key", "fp", "coordinates"])

    return fps.select("fp").mapInArrow(run, "choice int, key long, fp long, coordinates binary")


def group_links(names: np.ndarray, table: np.ndarray, radius: int, near) -> list[tuple[int, int]]:
    """A spanning set of the links of one group: (member, smallest member of its component).

    table: distances to the pivots; near(left, right): the pairs of places that pass verification.
    """
    n = len(names)
    if n < 2:
        return []
    order = np.argsort(table[:, 0], kind="stable")
    table = table[order].astype(np.int16)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    step = max(1, PAIR_CHUNK // (n * 4))
    for start in range(0, n, step):
        rows = np.arange(start, min(n, start + step))
        counts = reach[rows] - rows - 1
        left = np.repeat(rows, counts)
        right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + left + 1
        for low in range(1, table.shape[1], 8):  # the largest coordinate difference, a few pivots at a time
            keep = np.abs(table[left, low : low + 8] - table[right, low : low + 8]).max(axis=1, initial=0) <= radius
            left, right = left[keep], right[keep]
        left, right = order[left], order[right]
        passed = near(left, right)
        for i, j in zip(left[passed].tolist(), right[passed].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i in range(n):
        r = root(i)
        least[r] = min(least.get(r, names[i]), names[i])
    return [(int(names[i]), int(least[root(i)])) for i in range(n) if names[i] != least[root(i)]]


def within(fps: np.ndarray, radius: int):
    bits = fps.view(np.uint64)
    return lambda left, right: np.bitwise_count(bits[left] ^ bits[right]) <= radius


def meeting_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) among fingerprints that share a key; rows come sorted by key within a partition."""

    def run(batches):
        held: list[tuple] = []

        def flush(groups):
            found = [x for fps, table in groups for x in group_links(fps, table, radius, within(fps, radius))]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            choice, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            table = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(key), -1)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (choice[1:] != choice[:-1])) + 1
            cuts = [0, *edge.tolist(), len(key)]
            groups = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = (choice[a], key[a], fp[a:b], table[a:b])
                if held and held[-1][:2] == part[:2]:
                    held.append(part)
                    continue
                if len(held) > 1 or held and len(held[0][2]) > 1:
                    groups.append((np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])))
                held = [part]
            if groups:
                yield flush(groups)
        if held:
            yield flush([(np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))])

    parts = shuffle_partitions(keyed.sparkSession)
    dealt = keyed.repartition(parts, "choice", "key").sortWithinPartitions("choice", "key")
    return dealt.select("choice", "key", "fp", "coordinates").mapInArrow(run, "u long, v long")


def refined(crowded: DataFrame, free: list[list[int]], radius: int, blocks: int) -> tuple[DataFrame, list[list[int]]]:
    """Finer keys of crowded groups, and the bits that these leave free.

    The members of a group differ in its free bits alone. These are cut into blocks in turn, and a linked pair agrees in
    the coordinates of at least blocks - radius of them.
    """
    picks, masks, left = list(combinations(range(blocks), blocks - radius)), [], []
    for bits in free:
        parts = [bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks] for k in range(blocks)]
        own = [sum(1 << i for b in pick for i in parts[b]) for pick in picks]
        masks.append(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in own]))
        left += [[i for b in range(blocks) if b not in pick for i in parts[b]] for pick in picks]
    spread = crowded.select("choice", "key", "fp", "coordinates", F.posexplode(F.element_at(F.array(*masks), F.col("choice") + 1)).alias("pick", "mask"))
    number = (F.col("choice") * len(picks) + F.col("pick")).cast("int")
    return spread.select(number.alias("choice"), F.xxhash64("key", "pick", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "coordinates"), left


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bin_limit: int = BIN_LIMIT) -> DataFrame:
    """Links (u, v), spanning every component of fingerprints within `radius` bits. fps: distinct, column fp."""
    keyed = cut(pivot_table(fps, radius, blocks))
    edges = block_edges(blocks)
    free = [[i for b in range(blocks) if b not in chosen for i in range(*edges[b])] for chosen in combinations(range(blocks), blocks - radius)]
    found = None
    while True:
        crowds = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bin_limit).select("choice", "key", F.lit(True).alias("crowded"))
        crowds = cut(crowds)
        # A group with so few free bits that they can't be cut has 2 ** (blocks - 1) fingerprints at most.
        last = len(free[0]) < blocks or crowds.isEmpty()
        marked = keyed if last else keyed.join(crowds, ["choice", "key"], "left")
        met = meeting_links(marked if last else marked.filter("crowded is null"), radius)
        found = met if found is None else found.unionByName(met)
        if last:
            return found
        finer, free = refined(marked.filter("crowded"), free, radius, blocks)
        keyed = cut(finer)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) by alternating star contractions over edges (u, v)."""
    oriented = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = cut(oriented(edges))
    while True:
        # Done when every node has one edge, to a node without one.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up")).distinct())
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).filter("up > 1 or (up = 1 and n > 1)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = oriented(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = cut(oriented(small))
        release(now.sparkSession)


def near_duplicates(docs: DataFrame, words_a_shingle: int = 3, radius: int = RADIUS, blocks: int = BLOCKS, bin_limit: int = BIN_LIMIT) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable over links)."""
    base = cut(fingerprints(docs, words_a_shingle))
    by_fp = base.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(by_fp.filter("first is not null").select("fp"), radius, blocks, bin_limit))
    rooted = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    owners = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(owners, "root").select("fp", "component_id")
    return base.join(classes, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


# --- documents alike by similarity of their shingle sets ---

SLICE = 1024
SAMPLED_ROWS = 8000  # rows whose shingles are counted to order shingles by rarity
COMMON, COMMON_LEAST = 20_000, 3  # shingles held as common, and how often the sample must show them
LEAST_BITS = 1024  # of a parity fingerprint
SET_PIVOTS = 8  # of each 64 bits of it
PIVOT_ROWS = 500  # pairs whose tables are held at once
MISS = 1e-15
BROADCAST_ROWS = 2_000_000  # ids (8 bytes each) that may be broadcast to pick the rows whose sets are needed
EPSILON = 1e-9


def shingle_hashes(text: bytes, words_a_shingle: int) -> np.ndarray:
    """Ascending XXH64 of the set of shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= words_a_shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - words_a_shingle].tolist()]
    stops = (ends[words_a_shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def prefix_length(size: int, rare: int, similarity: float) -> int:
    """How many first members of each of two sets of this Jaccard similarity are sure to share one.

    In any one order of all members, size - similarity * size + 1 are enough: the shared ones can't all lie behind them.
    Far fewer are enough where the order is one of hashes. The members that are not common (`rare` of them, which come
    first) are in such an order. Of the union's, at most differ = (1 / similarity - 1) * size are not shared, so the first
    n of them all are with a probability of at most (differ / rare) ** n. n makes that MISS; for sets of unlike sizes,
    whose n differ by a fifth at most, it is 1e-12.
    """
    certain = size - int(np.ceil(similarity * size - EPSILON)) + 1
    differ = (1 / similarity - 1) * size
    if rare <= differ:
        return certain
    enough = int(np.ceil(np.log(MISS) / np.log(differ / rare)))
    return min(certain, enough) if enough <= rare else certain


def parities(hashes: np.ndarray) -> bytes:
    """Parity of a set's members in each of 2 to 4 classes a member (1024 at least, a power of two).

    Two sets differ in at least as many members as these differ in bits.
    """
    bits = max(LEAST_BITS, 1 << int(2 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(bool)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity fingerprint (its 64-bit words) over fewer classes: halves fold on one another."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def pivot_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most as many bits as fingerprints (rows of 64-bit words) differ in: the largest difference of the distances of

    each pair of words to the pivots, summed over the words.
    """
    references = pivots(1)[:SET_PIVOTS]
    gap = np.abs(np.bitwise_count(a[..., None] ^ references).astype(np.int8) - np.bitwise_count(b[..., None] ^ references).astype(np.int8))
    return gap.max(axis=-1).sum(axis=-1, dtype=np.int64)


def common_shingles(rows: DataFrame, words_a_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of shingles that are frequent in a sample of rows, and their counts. Only the order of keys depends on it."""

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t or b"", words_a_shingle) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            names, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], names=["key", "n"])

    share = -(-rows.count() // SAMPLED_ROWS)
    shown = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, share))) == 0).select("text").mapInArrow(run, "key long, n long")
    held = shown.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "key").limit(COMMON).collect()
    keys, counts = np.array([r["key"] for r in held], np.int64).view(np.uint64), np.array([r["n"] for r in held], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def rarest(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set in the order of all keys, as many as are needed: by frequency in the sample, then by hash."""
    counts = np.zeros(len(hashes), np.int64)
    if len(common[0]):
        at = np.searchsorted(common[0], hashes).clip(max=len(common[0]) - 1)
        counts = np.where(common[0][at] == hashes, common[1][at], 0)
    n = prefix_length(len(hashes), int((counts == 0).sum()), similarity)
    return hashes[np.argsort(counts, kind="stable")[:n]]


def can_be_alike(size, other_size, place, other_place, similarity: float, least):
    """Can two sets that share the key at these places of theirs be alike? Columns or arrays; the first set is not the larger.

    Shared members lie before both places, at the key, or behind both.
    """
    most = least(place, other_place) + 1 + least(size - place, other_size - other_place) - 1
    return (size >= similarity * other_size - EPSILON) & (most >= similarity / (1 + similarity) * (size + other_size) - EPSILON)


def most_differ(size, other_size, similarity: float):
    """In how many members two sets that are alike can differ. Columns or arrays."""
    return (1 - similarity) / (1 + similarity) * (size + other_size) + EPSILON


def meeting_nodes(base: DataFrame) -> DataFrame:
    """key, node, size, place of the keys that several nodes have. base: node, size, prefix, a node in any number of rows."""
    keys = base.select("node", "size", F.posexplode("prefix").alias("place", "key"))
    by_size = Window.partitionBy("key").orderBy("size", "node")
    once = keys.withColumn("before", F.lag("node").over(by_size)).filter(F.col("before").isNull() | (F.col("before") != F.col("node")))
    met = once.withColumn("after", F.lead("node").over(by_size)).filter(F.col("before").isNotNull() | F.col("after").isNotNull())
    return met.select("key", "node", "size", "place")


def simhash_pairs(base: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that span the links of their SimHash fingerprints, and those of one fingerprint. base: node, fp, a node in any number of rows."""
    heads = cut(base.groupBy("fp").agg(F.min("node").alias("head")))
    ends = [heads.select(F.col("fp").alias(n), F.col("head").alias(f"head_{n}")) for n in "uv"]
    across = links(heads.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.col("head_u").alias("u"), F.col("head_v").alias("v"))
    inside = base.select("node", "fp").join(heads, "fp").filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    both = across.unionByName(inside)
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def neighbour_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of each key's members that can be alike: the next one by size, and the first one."""
    by_size = Window.partitionBy("key").orderBy("size", "node")
    own = F.struct("node", "size", "place")
    near = met.withColumns({"before": F.lag(own).over(by_size), "head": F.first(own).over(by_size.rowsBetween(Window.unboundedPreceding, 0))})
    near = near.withColumn("other", F.explode(F.array_distinct(F.array("before", "head")))).filter(F.col("other.node") != F.col("node"))
    near = near.filter(can_be_alike(F.col("other.size"), F.col("size"), F.col("other.place"), F.col("place"), similarity, F.least))
    return near.select(F.greatest("node", "other.node").alias("u"), F.least("node", "other.node").alias("v")).distinct()


def not_discarded(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """u, v and the differing bits of the pairs whose fingerprints do not tell that they differ too much. nodes: node, size, parity."""
    left, right = (nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("parity").alias(f"parity_{n}")) for n in "uv")

    def run(batches):
        for batch in batches:
            limits = most_differ(*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4)), similarity)
            one, two = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (3, 5))
            # The table of distances to pivots first, over the least number of classes; then bits, over as many as there are.
            least = LEAST_BITS // 64
            a, b = (np.array([folded(x, least) for x in side], np.uint64).reshape(-1, least) for side in (one, two))
            differ = np.full(len(batch), -1, np.int64)
            for start in range(0, len(batch), PIVOT_ROWS):
                at = slice(start, start + PIVOT_ROWS)
                places = start + np.flatnonzero(pivot_differences(a[at], b[at]) <= limits[at])
                places = places[np.bitwise_count(a[places] ^ b[places]).sum(axis=1, dtype=np.int64) <= limits[places]]
                for i in places.tolist():
                    words = min(len(one[i]), len(two[i]))
                    bits = int(np.bitwise_count(folded(one[i], words) ^ folded(two[i], words)).sum(dtype=np.int64))
                    differ[i] = bits if bits <= limits[i] else -1
            good = pa.array(differ >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(differ[differ >= 0])], names=["u", "v", "differ"])

    both = pairs.join(left, "u").join(right, "v").select("u", "v", "size_u", "parity_u", "size_v", "parity_v")
    return both.mapInArrow(run, "u long, v long, differ long")


def shingle_sets(rows: DataFrame, reps: DataFrame, words_a_shingle: int) -> DataFrame:
    """node and shingles (ascending hashes, the upper 48 bits) of the nodes of reps, dealt out by node.

    rows: doc_id, text_hash, text; reps: node, and doc_id and text_hash of one of its rows. Rows are picked by one id
    each, which is broadcast where there are no more than BROADCAST_ROWS; beyond that, rows and ids are shuffled.
    """

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t or b"", words_a_shingle) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64)
            sets = [x.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    wanted = reps.select(F.xxhash64("doc_id", "text_hash").alias("row")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    chosen = rows.withColumn("row", F.xxhash64("doc_id", "text_hash")).join(wanted, "row", "left_semi")
    made = chosen.select("text").mapInArrow(run, "node long, shingles binary")
    # A row may be there several times.
    once = made.groupBy("node").agg(F.first("shingles").alias("shingles"))
    return once.repartition(shuffle_partitions(rows.sparkSession), "node")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have that Jaccard similarity."""

    def unpacked(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 6, 8), np.uint8)
        out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return out.view(np.uint64).ravel()

    def run(batches):
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                one, two = unpacked(a), unpacked(b)
                shared = len(np.intersect1d(one, two))
                good[i] = shared >= similarity * (len(one) + len(two) - shared) - EPSILON
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["u", "v"])

    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("u", "a"), ("v", "b")))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends have different roots, with these (ru, rv). roots: node, root; a node that is not there is its own."""
    for end in "uv":
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return pairs.filter("ru <> rv")


def contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (node, root) with the components of further links united."""
    apart = rooted(links, roots)
    merged = components(apart.select(F.col("ru").alias("u"), F.col("rv").alias("v"))).withColumnsRenamed({"node": "old", "root": "new"})
    moved = roots.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return cut(moved.unionByName(merged.select(F.col("old").alias("node"), F.col("new").alias("root"))))


def united(pairs: DataFrame, roots: DataFrame, rows: DataFrame, reps: DataFrame, similarity: float, words_a_shingle: int) -> DataFrame:
    """roots (node, root) with all united that verified ones of the pairs (u, v, differ) unite.

    Each round compares the sets of every component's most promising pairs to others, one at first and eight times as many
    a round, and unites what passes. A pair is dropped when it fails or when its ends are one component.
    """
    left = cut(rooted(pairs, roots).select("u", "v", "differ"))
    if left.isEmpty():
        return roots
    ends = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = cut(shingle_sets(rows, reps.join(ends, "node", "left_semi"), words_a_shingle))
    width = 1
    while not left.isEmpty():
        known = rooted(left, roots)
        if width <= 1000:
            order = [F.col("differ"), F.col("u"), F.col("v")]
            best = [known.withColumn("at", F.row_number().over(Window.partitionBy(r).orderBy(*order))).filter(F.col("at") <= width).select("u", "v") for r in ("ru", "rv")]
            now = cut(best[0].unionByName(best[1]).distinct())
        else:
            now = cut(known.select("u", "v"))
        roots = contracted(alike(now, sets, similarity), roots)
        left = cut(rooted(left.join(now, ["u", "v"], "left_anti"), roots).select("u", "v", "differ"))
        width *= 8
        release(rows.sparkSession)
    return roots


def wide_pairs(met: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, slice_rows: int = SLICE) -> DataFrame:
    """All pairs (u, v) of different roots that share a key and can be alike. met: key, node, size, place; nodes: node, parity.

    Keys of over `slice_rows` nodes meet slice by slice, every pair of slices once.
    """
    parts = shuffle_partitions(met.sparkSession)
    apart = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = apart.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "n")
    # Only what meets another root needs its fingerprint, folded to the least size.
    marked = apart.join(mixed, "key").join(nodes.select("node", "parity"), "node").withColumn("slices", F.ceil(F.col("n") / slice_rows).cast("int"))
    own = marked.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = other.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "size", "place", "root", "parity")
    dealt = cells.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "size")

    def pairs_of(cell):
        _, low, high, own, node, size, place, root, bits = cell
        reach = np.searchsorted(size, size / similarity + EPSILON, side="right")
        step = max(1, PAIR_CHUNK // 16 // len(node))
        for start in range(0, len(node), step):
            rows = np.arange(start, min(len(node), start + step))
            counts = reach[rows] - rows - 1
            left = np.repeat(rows, counts)
            right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + left + 1
            good = root[left] != root[right]
            if low[0] != high[0]:
                good &= own[left] != own[right]
            left, right = left[good], right[good]
            good = can_be_alike(size[left], size[right], place[left], place[right], similarity, np.minimum)
            left, right = left[good], right[good]
            limits = most_differ(size[left], size[right], similarity)
            good = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64) <= limits
            a, b = node[left[good]], node[right[good]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    def meet(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            words = LEAST_BITS // 64
            now.append(np.array([folded(np.frombuffer(x, np.uint64), words) for x in batch.column(8).to_pylist()], np.uint64).reshape(-1, words))
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            edge = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])) + 1
            cuts = [0, *edge.tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from pairs_of([x[a:b] for x in now])
            held = [x[cuts[-1] :] for x in now]
        if held is not None:
            yield from pairs_of(held)

    return dealt.mapInArrow(meet, "u long, v long").distinct()


def similar_documents(docs: DataFrame, similarity: float = 0.8, words_a_shingle: int = 5) -> DataFrame:
    """doc_id, text_hash and component_id of documents linked by a Jaccard similarity of `similarity` or more of their shingle sets.

    A node is a shingle set; a document is a doc_id with a text. Nodes that SimHash links are compared and united first. Nodes
    also meet under the rarest shingles of theirs, as many as `prefix_length` says: neighbours under a key are compared with
    the former; then all pairs under a key whose ends are still apart are. Rows with a null doc_id are left out; texts without words are alike; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = whole_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, words_a_shingle))

    def run(batches):
        worker_state("shingles")
        for batch in batches:
            nodes, sizes, fps, parity, prefixes = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text or b"", words_a_shingle)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                fps.append(majority(hashes))
                parity.append(parities(hashes))
                prefixes.append(rarest(hashes, similarity, common.value).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(parity, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "size", "fp", "parity", "prefix"])

    found = rows.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, node long, size int, fp long, parity binary, prefix array<long>")
    base = cut(found)
    hashed = cut(simhash_pairs(base))
    met = cut(meeting_nodes(base))
    # Copies are brought together where they are read; of nodes that meet no other, nothing but the id is needed on.
    reps = base.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min("size").alias("size"), F.min("parity").alias("parity"))
    meeting = met.select("node").unionByName(hashed.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    reps = reps.join(meeting, "node", "left_semi")
    reps = cut(reps.select("node", "row.doc_id", "row.text_hash", "size", "parity"))
    release(rows.sparkSession)
    roots = met.sparkSession.createDataFrame([], "node long, root long")
    tried = cut(not_discarded(hashed.unionByName(neighbour_pairs(met, similarity)).distinct(), reps, similarity))
    roots = united(tried, roots, rows, reps, similarity, words_a_shingle)
    wide = wide_pairs(met, reps, roots, similarity).join(tried, ["u", "v"], "left_anti")
    roots = united(cut(not_discarded(wide, reps, similarity)), roots, rows, reps, similarity, words_a_shingle)
    owned = base.select("doc_id", "text_hash", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    owners = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return owned.join(owners, "root").select("doc_id", "text_hash", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
