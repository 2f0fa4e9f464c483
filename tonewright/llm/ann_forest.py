"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample of distinct vectors (`sample` rows, by a hash), as random directions
through pairs of sampled points, cut at the median. To search by inner product, vectors are lifted by one
coordinate that gives all the same norm (queries get zero there), so large products mean small angles. Every
distinct vector is sent down every tree to a leaf. A query walks all trees at once through one priority queue
ordered by the worst margin on the way, and takes leaves until they hold a share of all rows. That share is
measured: probes of the sample are searched exactly within it, and the share is what finds `target` of their
neighbours. Clustered vectors need little of the table; for vectors without structure no tree can say where
to look, and the share becomes large. Leaves and their queries meet on (tree, leaf, slice); slices keep a leaf
of any size in bounded pieces. Candidates are reranked by the exact product in double precision; nothing but the
leaves that the queue visits yields candidates. A query's lists, one a slice, are merged `FAN_IN` at a time.

Copies: of equal vectors only the `k` + 1 smallest ids can be among a query's nearest, so rows are first
brought to distinct vectors with those ids, within each batch and then across the table. Equal queries are
searched once.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, and neither
do vectors whose length is not the most common one (ties: the shorter), nor rows without an id. A repeated id
counts once, with the first of its vectors in array order. With fewer than k candidates all are returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.shared import cut, read_table, shuffle_partitions

K = 20
TREES = 4
SAMPLE = 40_000
LEAF_ROWS = 256  # of the sample
TARGET = 0.94  # of the sample's neighbours to be found, when the share of rows to visit is chosen
PROBES = 96
FAN_IN = 64  # lists of a query that are merged at once
HELD_VECTORS = 50_000  # distinct vectors brought together before they are sent on
VISIT_BYTES = 16_000_000  # of query vectors in a batch of visits
HELD_FLOORS = 200_000  # queries of which a task remembers how good its hits have to be
SLICE_ROWS = 4096
TIE = 1e-12  # products this near may be equal


@dataclass
class Tree:
    """Inner nodes as arrays: direction, offset, children; a child below zero is leaf -1 - child."""

    directions: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if len(self.left) else np.full(len(points), -1, np.int64)
        inside = np.flatnonzero(at >= 0)
        while len(inside):
            node = at[inside]
            margin = np.einsum("ij,ij->i", points[inside], self.directions[node]) - self.offsets[node]
            at[inside] = np.where(margin > 0, self.right[node], self.left[node])
            inside = inside[at[inside] >= 0]
        return -1 - at


def grow(points: np.ndarray, leaf_rows: int, seed: int) -> Tree:
    """A tree over sampled points, split at medians of projections through random pairs of them."""
    rng = np.random.default_rng(seed)
    directions, offsets, left, right, leaves = [], [], [], [], 0
    stack = [(np.arange(len(points)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        split = None
        if len(rows) > leaf_rows:
            for _ in range(5):
                a, b = points[rng.choice(rows, 2, replace=False)]
                direction = (a - b) / max(np.linalg.norm(a - b), 1e-12)
                shown = points[rows] @ direction
                middle = float(np.median(shown))
                over = shown > middle
                if 0 < over.sum() < len(rows):
                    split = (direction, middle, over)
                    break
        if split is None:
            number, leaves = -1 - leaves, leaves + 1
        else:
            number = len(directions)
            directions.append(split[0])
            offsets.append(split[1])
            left.append(0)
            right.append(0)
            stack += [(rows[~split[2]], number, 0), (rows[split[2]], number, 1)]
        if parent >= 0:
            (right if side else left)[parent] = number
    dims = points.shape[1]
    return Tree(np.array(directions).reshape(-1, dims), np.array(offsets), np.array(left, np.int64), np.array(right, np.int64), leaves)


@dataclass
class Forest:
    trees: list[Tree]
    reach: float  # the largest norm; lifted vectors have it all

    def lift(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        if query:
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            return np.concatenate([vectors / norms, np.zeros((len(vectors), 1))], axis=1)
        scaled = vectors / self.reach
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def visit(self, point: np.ndarray, held: list[np.ndarray], rows_wanted: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) with rows, in the order of one queue over all trees, until they hold enough."""
        queue = [(-np.inf, t, 0 if len(tree.left) else -1) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        shown = [(tree.directions @ point - tree.offsets).tolist() for tree in self.trees]
        found, rows = [], 0
        while queue and rows < rows_wanted:
            bound, t, node = heapq.heappop(queue)
            left, right, margins = self.trees[t].left, self.trees[t].right, shown[t]
            while node >= 0:
                m = margins[node]
                near, far = (int(right[node]), int(left[node])) if m > 0 else (int(left[node]), int(right[node]))
                heapq.heappush(queue, (max(bound, abs(m)), t, far))
                node = near
            if held[t][-1 - node]:
                found.append((t, -1 - node))
                rows += int(held[t][-1 - node])
        return found

    def share_for(self, points: np.ndarray, k: int, target: float) -> float:
        """Share of all rows to visit so that `target` of the k nearest of sampled probes are found within the sample."""
        if len(points) <= k + 1:
            return 1.0
        lifted = self.lift(points, query=False)
        where = [tree.leaf_of(lifted) for tree in self.trees]
        held = [np.bincount(w, minlength=tree.leaves) for w, tree in zip(where, self.trees, strict=True)]
        needed = []
        for i in range(0, len(points), max(1, len(points) // PROBES)):
            scores = points @ points[i]
            scores[i] = -np.inf
            first = [np.full(tree.leaves, np.inf) for tree in self.trees]
            rows = 0
            for t, leaf in self.visit(self.lift(points[i : i + 1], query=True)[0], held, np.inf):
                rows += held[t][leaf]
                first[t][leaf] = rows
            for j in np.argpartition(-scores, k)[:k]:
                needed.append(min(first[t][where[t][j]] for t in range(len(self.trees))))
        return min(1.0, float(np.quantile(needed, target)) / (len(points) * len(self.trees)))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part, an id once."""
    v = F.col("embedding").cast("array<double>")
    fit = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fit = fit.filter(F.forall("v", lambda x: x.isNotNull())).filter(F.exists("v", lambda x: x != 0))
    fit = fit.filter(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    return fit.groupBy("vec_id").agg(F.min("v").alias("v"))


def key_of(raw: bytes) -> tuple[int, int]:
    low, high = xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)
    return low - (1 << 64) * (low >> 63), high - (1 << 64) * (high >> 63)


def gathered(ids: DataFrame, keep: int | None) -> DataFrame:
    """k1, k2 (hash of the vector), v (bytes of doubles), ids (ascending; the `keep` smallest). keep None: all ids, in lists a batch long."""
    schema = "k1 long, k2 long, v binary, ids array<long>"

    def sent(held):
        keys = [key_of(raw) for raw in held]
        names = [sorted(x)[:keep] for x in held.values()]
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(held), pa.binary()), pa.array(names, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "v", "ids"])

    def local(batches):
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            vectors = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(batch), -1) + 0.0
            for raw, name in zip((row.tobytes() for row in vectors), batch.column(0).to_pylist(), strict=True):
                own = held.setdefault(raw, [])
                own.append(name)
                if keep and len(own) >= 8 * keep:
                    own[:] = sorted(own)[:keep]
            if len(held) >= HELD_VECTORS or keep is None:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    part = ids.select("vec_id", "v").mapInArrow(local, schema)
    if keep is None:
        return part
    whole = part.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    return whole.withColumn("ids", F.slice("ids", 1, keep))


def fit_forest(distinct: DataFrame, trees: int, sample: int, leaf_rows: int) -> tuple[Forest, np.ndarray]:
    """Trees from at most `sample` distinct vectors, the smallest by hash; also these vectors."""
    held = distinct.select("v", "k1").orderBy("k1").limit(sample).collect()
    norms = distinct.select("v").mapInArrow(_norms, "norm double").agg(F.max("norm")).first()[0] or 1.0
    points = np.array([np.frombuffer(r["v"]) for r in held])
    forest = Forest([], norms)
    lifted = forest.lift(points, query=False)
    forest.trees = [grow(lifted, leaf_rows, seed) for seed in range(trees)]
    return forest, points


def best_of(points: np.ndarray, base: np.ndarray, k: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best rows of `base` for each point (all, if fewer), and their exact products; ties to the smaller of `ids`."""
    scores = points @ base.T
    take = min(k, scores.shape[1])
    top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
    if ids is not None and take < scores.shape[1]:
        level = np.take_along_axis(scores, top, 1).min(axis=1, keepdims=True)
        level = level - TIE * np.maximum(1, np.abs(level))
        for i in np.flatnonzero((scores >= level).sum(axis=1) > take).tolist():  # a tie across the cut
            tied = np.flatnonzero(scores[i] >= level[i])
            top[i] = tied[np.lexsort((ids[tied], -np.einsum("j,kj->k", points[i], base[tied])))[:take]]
    return top, np.einsum("ij,ikj->ik", points, base[top])


def lists_of(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values as lists, by ascending row number."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def expanded(rows: np.ndarray, places: np.ndarray, scores: np.ndarray, names: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of every id of the places."""
    counts = np.fromiter(map(len, names), np.int64, len(names))
    flat = np.fromiter((i for x in names for i in x), np.int64, int(counts.sum()))
    starts, own = (np.cumsum(counts) - counts)[places], counts[places]
    inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    return np.repeat(rows, own), flat[np.repeat(starts, own) + inner], np.repeat(scores, own)


def _norms(batches):
    for batch in batches:
        rows = [np.frombuffer(b) for b in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(r)) for r in rows], pa.float64())], names=["norm"])


def nearest(vectors: DataFrame, is_query: Column, k: int = K, *, trees: int = TREES, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, target: float = TARGET, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found among all other rows."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    out = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("v") == length["n"])
    distinct = cut(gathered(rows, k + 1))
    fitted, points = fit_forest(distinct, trees, sample, leaf_rows)
    share = fitted.share_for(points, k, target) if target < 1 else 1.0
    # Bounded by `sample`, whatever the table.
    forest = spark.sparkContext.broadcast(fitted)

    def place(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            if not raw:
                continue
            lifted = forest.value.lift(np.frombuffer(b"".join(raw)).reshape(len(raw), -1), query=False)
            k1 = batch.column(0).to_numpy(zero_copy_only=False)
            for number, tree in enumerate(forest.value.trees):
                columns = [pa.array(np.full(len(raw), number, np.int32)), pa.array(tree.leaf_of(lifted).astype(np.int32)), pa.array(k1), batch.column(2), batch.column(3)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "k1", "v", "ids"])

    placed = distinct.mapInArrow(place, "tree int, leaf int, k1 long, v binary, ids array<long>")
    # One row a leaf: bounded by the forest, which is bounded by its sample.
    leaves = cut(placed.groupBy("tree", "leaf").agg(F.count("*").alias("n"))).collect()
    held = [np.zeros(t.leaves, np.int64) for t in forest.value.trees]
    for r in leaves:
        held[r["tree"]][r["leaf"]] = r["n"]
    slices = [np.maximum(1, -(-h // slice_rows)) for h in held]
    # Enough for k others, even if every tree shows the same ones.
    wanted = max(share * sum(int(h.sum()) for h in held), trees * (k + 1))
    shared = spark.sparkContext.broadcast((held, slices))

    def walk(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            if not raw:
                continue
            own = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
            held_, slices_ = shared.value
            most = max(1, VISIT_BYTES // len(raw[0]))
            found: list[tuple[int, int, int, int]] = []

            def visits(batch=batch, found=found, most=most):
                """What was found, `most` visits a batch: each carries its query's vector."""
                for a in range(0, len(found), most):
                    part = found[a : a + most]
                    at = pa.array([f[3] for f in part], pa.int64())
                    columns = [*(pa.array([f[j] for f in part], pa.int32()) for j in range(3)), *(batch.column(j).take(at) for j in (0, 1, 2))]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "slice", "q1", "q2", "q"])
                found.clear()

            for i, point in enumerate(forest.value.lift(own, query=True)):
                found += [(t, leaf, s, i) for t, leaf in forest.value.visit(point, held_, wanted) for s in range(slices_[t][leaf])]
                if len(found) >= most:
                    yield from visits()
            yield from visits()

    queries = cut(gathered(rows.filter(is_query), None))
    asking = queries.select("k1", "k2", "v").distinct()
    asked = asking.mapInArrow(walk, "tree int, leaf int, slice int, q1 long, q2 long, q binary")

    def sliced(batches):
        for batch in batches:
            t, leaf, k1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            counts = np.array([shared.value[1][a][b] for a, b in zip(t, leaf, strict=True)], np.int64)
            number = (k1.view(np.uint64) >> np.uint64(8)).astype(np.int64) % np.maximum(counts, 1)
            columns = [batch.column(0), batch.column(1), pa.array(number.astype(np.int32)), batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "slice", "v", "ids"])

    side = placed.mapInArrow(sliced, "tree int, leaf int, slice int, v binary, ids array<long>")
    both = side.select("tree", "leaf", "slice", "v", "ids", F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    both = both.unionByName(asked.select("tree", "leaf", "slice", F.col("q").alias("v"), F.lit(None).cast("array<long>").alias("ids"), "q1", "q2"))
    # A slice's candidates come first (its queries have q1), so one pass over sorted rows serves both.
    met = both.repartition(parts * 2, "tree", "leaf", "slice").sortWithinPartitions("tree", "leaf", "slice", F.col("q1").isNotNull())

    def rerank(batches):
        where, stored, names, waiting = None, [], [], []
        # What a query's hits that have been sent on from here are worth at least: k + 1 of them are there.
        floors: dict[tuple[int, int], float] = {}

        def flush():
            if not waiting or not stored:
                return None
            if len(floors) > HELD_FLOORS:
                floors.clear()
            base = np.frombuffer(b"".join(stored)).reshape(len(stored), -1)
            own = np.frombuffer(b"".join(w[2] for w in waiting)).reshape(len(waiting), -1)
            top, scores = best_of(own, base, k + 1, np.array([x[0] for x in names], np.int64))
            least = np.array([floors.get(w[:2], -np.inf) for w in waiting])
            good = scores >= least[:, None] - TIE * np.maximum(1, np.abs(least, where=np.isfinite(least), out=np.ones(len(least))))[:, None]
            if scores.shape[1] > k:
                floors.update(zip((w[:2] for w in waiting), np.maximum(least, scores.min(axis=1)).tolist(), strict=True))
            rows_, at = np.nonzero(good)
            rows_, ids, values = expanded(rows_, top[rows_, at], scores[rows_, at], names)
            keys = (pa.array([w[j] for w in waiting], pa.int64()) for j in (0, 1))
            return pa.RecordBatch.from_arrays([*keys, lists_of(rows_, ids, len(waiting)), lists_of(rows_, values, len(waiting))], names=["q1", "q2", "ids", "scores"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for t, leaf, s, v, ids, q1, q2 in zip(*columns, strict=True):
                if (t, leaf, s) != where:
                    if (out_ := flush()) is not None:
                        yield out_
                    where, stored, names, waiting = (t, leaf, s), [], [], []
                if q1 is None:
                    stored.append(v)
                    names.append(ids)
                else:
                    waiting.append((q1, q2, v))
                    if len(waiting) >= 256:
                        if (out_ := flush()) is not None:
                            yield out_
                        waiting = []
        if (out_ := flush()) is not None:
            yield out_

    scored = met.mapInArrow(rerank, "q1 long, q2 long, ids array<long>, scores array<double>").filter(F.size("ids") > 0)

    # A query's lists, one a visited slice, are merged to its k + 1 best, ties to the smaller id.
    def merge(batches):
        for batch in batches:
            best_ids, best_scores = [], []
            for ids, scores in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                names, values = np.concatenate(ids), np.concatenate(scores)
                names, first = np.unique(names, return_index=True)
                values = values[first]
                order = np.lexsort((names, -values))[: k + 1]
                best_ids.append(names[order].tolist())
                best_scores.append(values[order].tolist())
            columns = [batch.column(0), batch.column(1), pa.array(best_ids, pa.list_(pa.int64())), pa.array(best_scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["q1", "q2", "ids", "scores"])

    merged, groups = scored, sum(int(n.sum()) for n in slices)
    while groups:
        groups = -(-groups // FAN_IN) if groups > FAN_IN else 1
        dealt = merged.withColumn("part", F.pmod(F.xxhash64("ids", "scores"), F.lit(groups)))
        lists = dealt.groupBy("q1", "q2", "part").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))
        merged = lists.select("q1", "q2", "ids", "scores").mapInArrow(merge, "q1 long, q2 long, ids array<long>, scores array<double>")
        groups = 0 if groups == 1 else groups
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct(x["scores"].alias("s"), x["ids"].alias("i")))
    best = merged.select("q1", "q2", pairs.alias("best"))
    each = queries.select("k1", "k2", F.explode("ids").alias("query_id")).join(best, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")))
    own = F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k)
    ranked = each.select("query_id", F.posexplode(own).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.i").alias("vec_id"), F.col("hit.s").alias("score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
