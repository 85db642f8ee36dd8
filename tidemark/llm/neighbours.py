"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample of the vectors, the ``sample`` smallest by a hash of their id;
every vector is then filed in the leaf that descent to the nearest centre leads to. A query
visits leaves best bin first: a priority queue holds subtrees by the inner product with their
centre plus a share of their radius. How many leaves a query visits is calibrated: for a bounded set
of queries the true neighbours over all vectors are found exactly, and the visits are widened until
the share of them in visited leaves reaches ``recall``.

Leaves are small, so a query leaves most of the far ones out. Neighbouring leaves are packed into groups of
bounded size, to which a query goes once with the list of those that it visits; a leaf with a third of all vectors
is many groups. A group multiplies each leaf's vectors with the queries that visit it, keeps what may be among the
nearest, and scores that in double precision. A query's first leaves give it a floor, the score of its k-th nearest
there. Later leaves that cannot reach it (inner product with the centre plus length times the largest radius of the
leaf's vectors) are not visited, which loses nothing, and others return only vectors that reach it.

Results in odd cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows of
null id; vectors are compared with those of their own length; rows of the query's own id are no
candidates; rows that repeat a query's id and vector ask once, those of its id and another vector add to its list;
visits go on until they hold more than ``k`` vectors, so a query with fewer candidates
than ``k`` gets all of them; an empty table
gives an empty result. Columns besides id and vector are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

SEED = 20240229


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and assignment; empty clusters are dropped."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = (0.5 * (centres**2).sum(axis=1) - x @ centres.T).argmin(axis=1)
        centres = np.stack([x[of == c].mean(axis=0) for c in np.unique(of)])
    of = (0.5 * (centres**2).sum(axis=1) - x @ centres.T).argmin(axis=1)
    return centres, of


class Tree:
    """Flat arrays of a k-means tree: children, centres, radii, and a leaf number for leaves."""

    def __init__(self, x: np.ndarray, leaf_size: int, branching: int):
        rng = np.random.default_rng(SEED)
        self.centre, self.radius, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        self._grow(x, leaf_size, branching, rng)
        self.centre = np.stack(self.centre)
        self.leaf_centre = self.centre[np.array(self.leaf) >= 0]  # leaves are numbered in the order of their nodes

    def _grow(self, x, leaf_size, branching, rng) -> int:
        node = len(self.centre)
        centre = x.mean(axis=0)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((x - centre) ** 2).sum(axis=1).mean())))
        self.children.append(None)
        self.leaf.append(-1)
        parts = []
        if len(x) > leaf_size:
            _, of = kmeans(x, min(branching, -(-len(x) // leaf_size)), rng)
            parts = [x[of == c] for c in np.unique(of)]
        if len(parts) > 1:
            self.children[node] = np.array([self._grow(p, leaf_size, branching, rng) for p in parts])
        else:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        return node

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.leaf[node]
                continue
            centres = self.centre[self.children[node]]
            of = (0.5 * (centres**2).sum(axis=1) - x[rows] @ centres.T).argmin(axis=1)
            todo += [(int(child), rows[of == c]) for c, child in enumerate(self.children[node]) if (of == c).any()]
        return out

    def visits(self, q: np.ndarray, most: int, share: float = 0.5, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first traversal for query ``q``, and further ones
        until they hold ``least`` vectors; ``held`` counts those of each leaf."""
        rank = (-(self.centre @ q + share * float(np.linalg.norm(q)) * np.array(self.radius))).tolist()
        out, queue, seen = [], [(0.0, 0)], 0
        while queue and (len(out) < most or seen < least):
            _, node = heapq.heappop(queue)
            if self.children[node] is None:
                out.append(self.leaf[node])
                seen += int(held[self.leaf[node]]) if held is not None else 0
                continue
            for child in self.children[node].tolist():
                heapq.heappush(queue, (rank[child], child))
        return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever it stands."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += q[d] * x[:, d]
    return total


def nearest_of(q_id: int, q: np.ndarray, rough: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` nearest of ``x`` that reach ``floor``, ties to the smaller id. Rows whose ``rough``
    score is minus infinity are left out."""
    rough = np.where(ids == q_id, -np.inf, rough)
    edge = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
    slack = 1e-9 * max(1.0, float(np.abs(rough[np.isfinite(rough)]).max(initial=0.0)))
    some = np.flatnonzero((rough > -np.inf) & (rough >= max(edge, floor) - slack))
    score = exact_scores(q, x[some])
    some, score = some[score >= floor], score[score >= floor]
    order = np.lexsort((ids[some], -score))[:k]
    return ids[some][order], score[order]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


FOUND = "query_id long, vec_id long, score double"


def _found(out: tuple[list, list, list]) -> pa.Table:
    cat = [np.concatenate(c) if c else np.zeros(0) for c in out]
    return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(np.float64))})


def _compare(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The nearest of ``vectors`` to each query; where queries hold ``leaves``, in these leaves only."""
    out = [], [], []
    if len(queries) and len(vectors):
        q_ids, q = queries["query_id"].to_numpy(), _matrix(queries["q"])
        visited = "leaves" in queries.column_names
        if visited:
            vectors = vectors.sort_by("leaf")
            leaf, starts = np.unique(vectors["leaf"].to_numpy(), return_index=True)
            ends = np.append(starts[1:], len(vectors))
            lists = queries["leaves"].combine_chunks()
            asked, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        ids, x = vectors["vec_id"].to_numpy(), _matrix(vectors["v"])
        floors = queries["floor"].to_numpy() if visited else np.full(len(q), -np.inf)
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            if visited:
                rough = np.full((len(part), len(x)), -np.inf)
                for number, lo, hi in zip(leaf, starts, ends):
                    here = of[(asked == number) & (of >= a) & (of < a + len(part))] - a
                    rough[here, lo:hi] = part[here] @ x[lo:hi].T
            else:
                rough = part @ x.T
            for i in range(len(rough)):
                near, score = nearest_of(int(q_ids[a + i]), part[i], rough[i], ids, x, k, floors[a + i])
                out[0].append(np.full(len(near), q_ids[a + i]))
                out[1].append(near)
                out[2].append(score)
    return _found(out)


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part; components keep their precision."""
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))


def packs_of(held: np.ndarray, rows: int) -> np.ndarray:
    """A pack for every leaf: neighbouring leaves of at most ``rows`` vectors together, or one larger leaf."""
    out, pack, inside = np.zeros(len(held), np.int32), 0, 0
    for leaf, n in enumerate(held.tolist()):
        if inside and inside + n > rows:
            pack, inside = pack + 1, 0
        out[leaf], inside = pack, inside + n
    return out


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    recall: float = 0.95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample: int = 20_000,
    calibration: int = 200,
    leaf_rows: int = 32,
    branching: int = 8,
    most_leaves: int = 4096,
    group_rows: int = 4096,
    first_leaves: int = 16,
) -> DataFrame:
    """``query_id, rank, vec_id, score, n_compared``: for ids divisible by ``every``, the ``k`` nearest found and the number
    of vectors in the leaves that the query visited."""
    good = stage(usable(vectors, id_col, vec_col), "vectors")
    widths = [(r["n"], r["rows"]) for r in good.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").orderBy("n").collect()]
    if not widths:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_compared long")
    options = every, k, recall, sample, calibration, leaf_rows, branching, most_leaves, group_rows, first_leaves
    found = [_nearest(good.where(F.size("v") == width), n, *options) for width, n in widths]  # one length as a rule
    if len(found) == 1:
        return found[0]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return both.where(F.col("rank") <= k)


def _nearest(
    good: DataFrame, n: int, every: int, k: int, recall: float, sample: int, calibration: int,
    leaf_rows: int, branching: int, most_leaves: int, group_rows: int, first_leaves: int,
) -> DataFrame:
    """``nearest`` among ``n`` usable vectors of one length."""
    kind = dict(good.dtypes)["v"]
    taken = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    leaves = min(most_leaves, -(-n // leaf_rows), -(-len(taken) // 8))
    tree = Tree(np.array([r["v"] for r in taken], np.float64), max(8, -(-len(taken) // leaves)), branching)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            leaf = tree.file(x)
            away = np.sqrt(((x - tree.leaf_centre[leaf]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(away)], names=["vec_id", "v", "leaf", "away"])

    filed = stage(good.mapInArrow(file, f"vec_id long, v {kind}, leaf int, away double"), "filed")
    asked = filed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    # calibration: true neighbours of a bounded set of queries, against all vectors
    few = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(calibration).collect()
    probes = pa.table({"query_id": pa.array([r["query_id"] for r in few], pa.int64()), "q": pa.array([r["q"] for r in few], pa.list_(pa.float64()))})

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _compare(probes, pa.Table.from_batches([batch]), k).to_batches()

    visits = 1
    if few:
        true = top(filed.select("vec_id", "v").mapInArrow(truth, FOUND), k)
        places = true.join(filed.select("vec_id", "leaf").distinct(), "vec_id").select("query_id", "leaf").collect()
        order = {r["query_id"]: {leaf: i for i, leaf in enumerate(tree.visits(np.array(r["q"], np.float64), tree.leaves))} for r in few}
        depth = np.sort([order[r["query_id"]][r["leaf"]] for r in places])
        if len(depth):
            visits = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1

    held, reach = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves)
    for row in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():  # one row per leaf
        held[row["leaf"]], reach[row["leaf"]] = row["n"], row["away"]
    pack = packs_of(held, group_rows)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, packs, early, lists, bounds = [], [], [], [], []  # per row: the leaves of one pack, their bounds, and their vectors
            for i, q in enumerate(_matrix(batch.column(1))):
                seen = np.array(tree.visits(q, visits, held=held, least=k + 1), np.int64)
                bound = tree.leaf_centre[seen] @ q + np.linalg.norm(q) * reach[seen] + 1e-6 * np.linalg.norm(q)
                for part, first in ((slice(first_leaves), True), (slice(first_leaves, None), False)):
                    some, high = seen[part], bound[part]
                    order = np.argsort(pack[some], kind="stable")
                    some, high = some[order], high[order]
                    for at in np.split(np.arange(len(some)), np.flatnonzero(np.diff(pack[some])) + 1):
                        if len(at):
                            rows.append(i)
                            packs.append(pack[some[at[0]]])
                            early.append(first)
                            lists.append(some[at])
                            bounds.append(high[at])
            offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            flat = [np.concatenate(c) if c else np.zeros(0) for c in (lists, bounds)]
            leaf = flat[0].astype(np.int32)
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(packs, pa.int32()), pa.array(early, pa.bool_()),
                 *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (leaf, flat[1].astype(np.float64), held[leaf]))],
                names=["query_id", "q", "pack", "early", "leaves", "bounds", "held"],
            )

    # the walk through the tree is slow for its input's size, so its tasks are cut by queries
    walks = asked.repartition(max(1, min(8192, -(-asked.count() // 256))), "query_id")
    visited = f"query_id long, q {kind}, pack int, early boolean, leaves array<int>, bounds array<double>, held array<long>"
    routed = stage(walks.mapInArrow(traverse, visited), "visits")
    # groups of bounded size: at most one row per leaf here, which ``most_leaves`` bounds
    pieces = lambda rows: F.ceil(rows / group_rows).cast("int")
    spark = good.sparkSession
    of_leaf = F.broadcast(spark.createDataFrame(list(zip(range(tree.leaves), pack.tolist())), "leaf int, pack int"))
    sizes = spark.createDataFrame([(int(p), int(h)) for p, h in enumerate(np.bincount(pack, held))], "pack int, rows long")
    counts = routed.groupBy("pack").agg(pieces(F.count(F.lit(1))).alias("qs")).join(F.broadcast(sizes), "pack").withColumn("vs", pieces(F.col("rows")))
    counts = F.broadcast(counts.where("vs > 0").select("pack", "vs", "qs"))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    packed = filed.select("vec_id", "v", "leaf").join(of_leaf, "leaf").join(counts, "pack")
    right = packed.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.col("vs")).cast("int")).withColumn("b", every_of("qs"))
    key = ["pack", "a", "b"]

    def compared(visiting: DataFrame) -> DataFrame:
        left = visiting.join(counts, "pack").withColumn("b", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int")).withColumn("a", every_of("vs"))
        return left.select(*key, "query_id", "q", "leaves", "floor").groupBy(*key).cogroup(right.select(*key, "vec_id", "v", "leaf").groupBy(*key)).applyInArrow(
            lambda queries, rows: _compare(queries, rows, k), FOUND
        )

    lowest = F.lit(float("-inf"))
    first = routed.where("early").withColumn("floor", lowest)
    near = stage(compared(first), "first-leaves")
    floors = top(near, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(lowest).alias("floor"))
    later = routed.where("NOT early").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", lowest))
    within = F.filter(F.arrays_zip("leaves", "bounds", "held"), lambda z: z["bounds"] >= F.col("floor"))
    later = later.withColumns({"leaves": within["leaves"], "held": within["held"]}).where(F.size("leaves") > 0)
    later = stage(later.select("query_id", "q", "pack", "leaves", "held", "floor"), "later-visits")
    compared_with = F.aggregate("held", F.lit(0).cast("long"), lambda total, n: total + n)
    looked = first.select("query_id", "held").unionByName(later.select("query_id", "held")).groupBy("query_id").agg(F.sum(compared_with).alias("n_compared"))
    return top(near.unionByName(compared(later)), k).join(looked, "query_id").select("query_id", "rank", "vec_id", "score", "n_compared")
