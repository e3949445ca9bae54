"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue, then exact reranking.

The forest is fitted on about SAMPLE vectors (those of smallest hash) and every vector is indexed in it: it goes down each tree to one leaf.
A plane tells where a query's neighbours are likely to be: with probability Phi(kappa m) on its own side at a margin m, as a neighbour's
margin is a fixed share of the query's, give or take. A query goes down all trees at once: one priority queue, shared by the trees, holds the
branches by the product of these probabilities, and the likeliest branch of any tree is opened next, until none is likelier than a
bound. Candidates in the leaves found are then compared by their exact inner product in double precision.

Both kappa and the bound are measured: ASKED of the queries are compared with all vectors, and the bound is the one at which TARGET of their
true neighbours lie in opened leaves. So the search is as wide as the vectors need: a few leaves where they have structure, a good part of them where
they have none. `plan_of` tells what was measured.

Leaves lie in cells of at most BLOCK bytes: several neighbouring leaves, or a part of a large one. A cell's vectors are held by one task, its
queries stream by; a cell that more than QUERIES queries visit is given to several tasks. Equal vectors are indexed once, with the TOP + 1 smallest ids
of each: no others can be among a query's TOP nearest, ties going to smaller ids, so this loses nothing.

Vectors that are null, empty, zero, of another length than most (of equally frequent lengths the smaller one counts), or with null or non-finite
components take no part; null ids neither. Each row is a candidate and a query of its own, also if others share its id or its vector: a row isn't its
own neighbour, its twins are. Other columns are ignored. An empty table, or one without queries, has no result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import checkpointed, shuffle_partitions

TOP = 20
#: Vectors to fit the trees on (about), trees, vectors of the sample in a leaf at most.
SAMPLE, TREES, LEAF, SEED = 16_384, 8, 64, 11
#: Queries (about) to measure the search with, and the share of their neighbours that it has to find.
ASKED, TARGET = 128, 0.95
#: Bytes of a cell's vectors (32,768 of 64 dimensions), and queries that one task compares with them.
BLOCK, QUERIES = 16 << 20, 50_000

_Z = np.linspace(-16, 16, 6401)
_LOG_PHI = np.array([math.log(0.5 * math.erfc(-z / math.sqrt(2))) for z in _Z])


def log_phi(z: np.ndarray) -> np.ndarray:
    return np.interp(z, _Z, _LOG_PHI)


class Tree:
    """Inner nodes: plane and offset; children are node numbers, leaves are -1 - leaf, numbered from left to right."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)
        self.plane = np.array(self.planes) if self.planes else np.empty((0, x.shape[1]))
        self.offset = np.array(self.offsets)
        self.child = np.array(self.children, np.int64).reshape(-1, 2)
        del self.planes, self.offsets

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            a, b = x[rng.choice(rows, 2, replace=False)]
            plane = (a - b) + rng.normal(0, 1e-3, x.shape[1])
            plane /= np.linalg.norm(plane)
            side = x[rows] @ plane
            offset = float(np.median(side))
            left = side <= offset
            if 0 < left.sum() < len(rows):
                at = len(self.planes)
                self.planes.append(plane)
                self.offsets.append(offset)
                self.children.append([0, 0])
                self.children[at] = [self._grow(x, rows[left], leaf, rng), self._grow(x, rows[~left], leaf, rng)]
                return at
        self.leaves += 1
        return -self.leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.plane.T - self.offset

    def path(self, margins: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The leaf of each row, and for each step down which rows take it, at which node, to which side."""
        at, steps = np.full(len(margins), self.root), []
        while (inner := at >= 0).any():
            i = inner.nonzero()[0]
            node = at[i]
            side = (margins[i, node] > 0).astype(np.int64)
            steps.append((i, node, side))
            at[i] = self.child[node, side]
        return -1 - at, steps


def fit(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [Tree(x, leaf, rng) for _ in range(trees)]


@dataclass
class Plan:
    """What was measured: kappa, the bound on a branch's log-probability, and how many queries that rests on."""

    kappa: float = 0.0
    bound: float = -math.inf
    asked: int = 0


def measure(forest: list[Tree], queries: np.ndarray, neighbours: list[np.ndarray], target: float = TARGET) -> Plan:
    """neighbours: for each query the vectors nearest to it."""
    owner = np.repeat(np.arange(len(queries)), [len(n) for n in neighbours])
    if not len(owner):
        return Plan(asked=len(queries))
    near = np.concatenate(neighbours)
    own = [t.margins(queries) for t in forest]
    theirs = [t.margins(near) for t in forest]
    # a neighbour's margin at the planes that its query passes, as a share of the query's
    m, n = [], []
    for tree, a, b in zip(forest, own, theirs, strict=True):
        for i, node, _ in tree.path(a)[1]:
            here = np.full(len(queries), -1)
            here[i] = node
            use = (here[owner] >= 0).nonzero()[0]
            m.append(a[owner[use], here[owner[use]]])
            n.append(b[use, here[owner[use]]])
    if not m:
        return Plan(asked=len(queries))
    x, y = np.concatenate(m), np.concatenate(n)
    share = float(x @ y) / max(float(x @ x), 1e-300)
    kappa = max(0.0, share) / max(float(np.sqrt(np.mean((y - share * x) ** 2))), 1e-9)
    best = np.full(len(near), -math.inf)
    for tree, a, b in zip(forest, own, theirs, strict=True):
        log_p = np.zeros(len(near))
        for i, node, side in tree.path(b)[1]:
            log_p[i] += log_phi(kappa * a[owner[i], node] * np.where(side, 1, -1))
        best = np.maximum(best, log_p)
    return Plan(kappa, float(np.sort(best)[int((1 - target) * len(best))]) - 1e-9, len(queries))


def search(forest: list[Tree], sizes: list[np.ndarray], q: np.ndarray, plan: Plan, least: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of the shared queue: the likeliest branch first, down to the plan's bound, but `least` vectors at least."""
    sides = []
    for t in forest:
        z = plan.kappa * (t.plane @ q - t.offset) if len(t.plane) else np.empty(0)
        sides.append((log_phi(-z), log_phi(z)))
    queue = [(0.0, k, t.root) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and (-queue[0][0] >= plan.bound or held < least):
        cost, k, node = heapq.heappop(queue)
        if node < 0:
            found.append((k, -1 - node))
            held += int(sizes[k][-1 - node])
        else:
            for side in (0, 1):
                heapq.heappush(queue, (cost - float(sides[k][side][node]), k, forest[k].children[node][side]))
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: what takes part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def _about(rows: DataFrame, hashed: str, most: int) -> DataFrame:
    """About `most` rows: those of smallest hash. Hashes are uniform, so a bound on them takes the same rows wherever they lie."""
    n = rows.count()
    return rows.where(F.col(hashed) <= -(2**63) + int(2**64 * min(1.0, most / max(n, 1))) - 1) if n > most else rows


def _truth(queries: np.ndarray, own: np.ndarray, top: int):
    """query (its number), h: of a task's vectors the `top` nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, h = np.empty((len(queries), 0)), np.empty((len(queries), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column("h").to_numpy()
            s = queries @ _matrix(batch.column("v")).T
            s[own[:, None] == new[None, :]] = -np.inf
            score, h = np.hstack([score, s]), np.hstack([h, np.broadcast_to(new, s.shape)])
            if score.shape[1] > top:
                at = np.argpartition(-score, top - 1, axis=1)[:, :top]
                score, h = np.take_along_axis(score, at, 1), np.take_along_axis(h, at, 1)
        i, j = np.isfinite(score).nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(h[i, j]), pa.array(score[i, j])], ["query", "h", "score"])

    return run


@dataclass
class Cells:
    """Where each leaf's vectors lie: the leaf's first cell and, if it is larger than a cell, its number of parts."""

    first: list[np.ndarray]
    parts: list[np.ndarray]

    @classmethod
    def of(cls, sizes: list[np.ndarray], block: int) -> Cells:
        first, parts, cell = [], [], -1
        for size in sizes:
            held, f, p = block, [], []
            for s in size:
                k = max(1, -(-int(s) // block))
                if k > 1 or held + s > block:
                    cell, held = cell + 1, 0
                f.append(cell)
                p.append(k)
                held = block if k > 1 else held + int(s)
                cell += k - 1
            first.append(np.array(f, np.int64))
            parts.append(np.array(p, np.int64))
        return cls(first, parts)


def _places(forest: list[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v")) if batch.num_rows else np.empty((0, forest[0].plane.shape[1]))
            for k, tree in enumerate(forest):
                leaf = tree.path(tree.margins(x))[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k), pa.int32()), pa.array(leaf, pa.int32()), *(batch.column(c) for c in ("h", "ids", "v"))], ["tree", "leaf", "h", "ids", "v"])

    return run


def _visits(forest: list[Tree], sizes: list[np.ndarray], cells: Cells, plan: Plan, least: int):
    """One row for each cell that a query has to see, with the leaves that it opens there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                x = _matrix(batch.column("v"))
                rows, cell, leaves = [], [], []
                for i in range(len(x)):
                    at: dict[int, list[int]] = {}
                    for k, leaf in search(forest, sizes, x[i], plan, least):
                        first = int(cells.first[k][leaf])
                        for c in range(first, first + int(cells.parts[k][leaf])):
                            at.setdefault(c, []).append(leaf)
                    rows += [i] * len(at)
                    cell += at.keys()
                    leaves += at.values()
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(leaves, pa.list_(pa.int32())), *(batch.column(c).take(take) for c in ("vec_id", "h", "copies", "v"))], ["cell", "leaves", "query_id", "qh", "copies", "v"])

    return run


def _best(query: np.ndarray, least_id: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Rows of each query's `top` best, ties to smaller ids."""
    order = np.lexsort((least_id, -scores, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
    return order[rank < top]


_PAIRS = ["query_id", "qh", "copies", "h", "score", "ids"]


class _Cell:
    """A cell's vectors by leaf, and the comparison of queries with the leaves that they open."""

    def __init__(self, parts: list[pa.RecordBatch], top: int):
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        order = np.argsort(table.column("leaf").to_numpy(), kind="stable")
        self.rows = table.take(pa.array(order))
        self.v, self.leaf, self.top = _matrix(self.rows.column("v")), self.rows.column("leaf").to_numpy(), top
        ids = self.rows.column("ids")
        self.least = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]

    def compare(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(queries.column("v"))
        leaves = queries.column("leaves")
        wants = leaves.flatten().to_numpy()
        who = np.repeat(np.arange(len(x)), np.diff(leaves.offsets.to_numpy()))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for leaf in np.unique(wants):
            a, b = np.searchsorted(self.leaf, (leaf, leaf + 1))
            asking = who[wants == leaf]
            if a == b or not len(asking):
                continue
            s = x[asking] @ self.v[a:b].T
            if b - a > self.top:
                least = np.partition(s, b - a - self.top, axis=1)[:, b - a - self.top]
                r, c = (s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]).nonzero()
            else:
                r, c = np.divmod(np.arange(s.size), b - a)
            found.append((asking[r], c + a, s[r, c]))
        q, c, s = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        keep = _best(q, self.least[c], s, 2 * self.top)
        q, c = q[keep], c[keep]
        # a pair's score must not hang on the block that it was met in
        s = np.einsum("ij,ij->i", x[q], self.v[c]) if len(q) else s
        keep = _best(q, self.least[c], s, self.top)
        q, c, s = pa.array(q[keep]), pa.array(c[keep]), s[keep]
        return pa.RecordBatch.from_arrays([*(queries.column(k).take(q) for k in _PAIRS[:3]), self.rows.column("h").take(c), pa.array(s), self.rows.column("ids").take(c)], _PAIRS)


def _rerank(top: int):
    """Rows come sorted by cell and part, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, cell = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "part", "kind")])
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
                here = batch.slice(a, b - a)
                if tuple(key[a, :2]) != now:
                    now, parts, cell = tuple(key[a, :2]), [], None
                if key[a, 2] == 0:
                    parts.append(here)
                    continue
                if cell is None and parts:
                    cell, parts = _Cell(parts, top + 1), []
                if cell:
                    for x in range(0, here.num_rows, 1024):
                        yield cell.compare(here.slice(x, 1024))

    return run


def _prepared(vectors: DataFrame, is_query: Column, top: int):
    """The usable rows, the distinct vectors with their smallest ids, and the queries; None if there are none."""
    rows = usable(vectors)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return None
    rows = rows.where(F.size("v") == length["n"]).withColumn("h", F.xxhash64("v"))
    # equal vectors: the smallest ids, found in salted parts first
    within = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), 64))
    some = within.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    distinct = checkpointed(some.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = checkpointed(rows.where(is_query).groupBy("vec_id", "h", "v").agg(F.count("*").alias("copies")))
    return distinct, queries


def plan_of(distinct: DataFrame, queries: DataFrame, forest: list[Tree], top: int = TOP) -> Plan:
    """Compares about ASKED queries with all vectors and measures how wide the search has to be."""
    asked = [(r["h"], r["v"]) for r in _about(queries.select("h", "v").withColumn("o", F.xxhash64("h")), "o", ASKED).collect()]
    if not asked:
        return Plan()
    own, x = np.array([h for h, _ in asked], np.int64), np.array([v for _, v in asked], np.float64)
    true = distinct.select("h", "v").mapInArrow(_truth(x, own, top), "query int, h long, score double")
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "h"))).where(F.col("r") <= top)
    found = distinct.select("h", "v").join(F.broadcast(true.select("query", "h")), "h").select("query", "v").collect()  # ASKED x top rows
    near: list[list] = [[] for _ in asked]
    for r in found:
        near[r["query"]].append(r["v"])
    return measure(forest, x, [np.array(n, np.float64).reshape(len(n), x.shape[1]) for n in near])


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, told: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each usable row that is_query (of vec_id) holds for, the nearest others found. told takes the
    plan, the number of distinct vectors and how many comparisons the queries' leaves hold (`comparisons`, vectors met in two trees counting twice)."""
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    got = _prepared(vectors, is_query, top)
    if got is None:
        return spark.createDataFrame([], empty)
    distinct, queries = got
    sampled = sorted((r["h"], r["v"]) for r in _about(distinct.select("h", "v"), "h", SAMPLE).collect())
    if not sampled:  # hardly any vectors, all of large hash
        sampled = [(r["h"], r["v"]) for r in distinct.select("h", "v").limit(SAMPLE).collect()]
    forest = fit(np.array([v for _, v in sampled], np.float64))
    plan = plan_of(distinct, queries, forest, top)
    placed = checkpointed(distinct.select("h", "ids", "v").mapInArrow(_places(forest), "tree int, leaf int, h long, ids array<long>, v array<double>"))
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in placed.groupBy("tree", "leaf").count().collect():  # as many as the forest has leaves
        sizes[r["tree"]][r["leaf"]] = r["count"]
    cells = Cells.of(sizes, max(1, BLOCK // (8 * len(sampled[0][1]))))
    flat = lambda x: F.element_at(F.element_at(F.lit([[int(b) for b in y] for y in x]), F.col("tree") + 1), F.col("leaf") + 1)
    stored = placed.withColumn("cell", (flat(cells.first) + F.pmod("h", flat(cells.parts))).cast("long"))
    visits = checkpointed(queries.mapInArrow(_visits(forest, sizes, cells, plan, (top + 1) * len(forest)), "cell long, leaves array<int>, query_id long, qh long, copies long, v array<double>"))
    if told is not None:
        per = visits.select("cell", F.explode("leaves").alias("leaf")).groupBy("cell", "leaf").count().join(stored.groupBy("cell", "leaf").agg(F.count("*").alias("n")), ["cell", "leaf"])
        told |= {"plan": plan, "vectors": distinct.count(), "comparisons": per.agg(F.sum(F.col("count") * F.col("n"))).first()[0], "queries": queries.count()}
    demand = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    none = lambda kind: F.lit(None).cast(kind)
    order = ["cell", "part", "kind", "leaf", "leaves", "query_id", "qh", "copies", "h", "ids", "v"]
    held = stored.join(demand, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.select("cell", "part", F.lit(0).alias("kind"), "leaf", none("array<int>").alias("leaves"), *(none("long").alias(c) for c in ("query_id", "qh", "copies")), "h", "ids", "v")
    asking = visits.join(demand, "cell").withColumn("part", F.pmod(F.xxhash64("query_id", "qh"), F.col("parts")).cast("int"))
    asking = asking.select("cell", "part", F.lit(1).alias("kind"), none("int").alias("leaf"), "leaves", "query_id", "qh", "copies", none("long").alias("h"), none("array<long>").alias("ids"), "v")
    met = held.unionAll(asking).select(*order).repartition(shuffle_partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", "kind")
    found = met.mapInArrow(_rerank(top), "query_id long, qh long, copies long, h long, score double, ids array<long>").dropDuplicates(["query_id", "qh", "h"])
    # a vector brings at least one id, the query's own perhaps none, so `top` + 1 vectors have all that can be among the nearest
    best = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), F.element_at("ids", 1))
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1)
    # of the query's own vector, its own row goes and its twins stay
    others = F.when(F.col("h") == F.col("qh"), F.filter("ids", lambda x, i: i != F.array_position("ids", F.col("query_id")) - 1)).otherwise(F.col("ids"))
    each = found.select("query_id", "qh", "copies", "score", F.explode(others).alias("vec_id"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qh", "copy").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
