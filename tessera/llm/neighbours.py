"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The largest inner product becomes the smallest distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm (0 for a query).  A tree of k-means splits is fitted
on a bounded sample; every vector is dealt to its leaf, and neighbouring leaves form parts of
bounded size (a leaf that is larger is dealt to several parts at random).  A query walks the
tree with a priority queue, nearest centre first, and visits leaves until its budget is spent.
The budget is widened leaf by leaf, on sample queries whose neighbours are known from a
comparison with all vectors, until the calibrated recall is reached.

Copies of a vector are one row with the smallest ids that can be in a result, so a vector that
fills a third of the table costs one comparison.  Queries are sent once to each part they visit;
a part that many queries visit is repeated for shares of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import map_arrow, stage, tasks

BEST, EVERY = 20, 20
SAMPLE, SAMPLE_SHARE, SAMPLE_BYTES = 8192, 8, 64_000_000  # the tree is fitted on the driver
SAMPLE_PER_LEAF = 8
LEAF = 128
BRANCHES = 16
PART_BYTES, PART_ROWS = 16_000_000, 256
QUERIES_PER_COPY = 8192
TRIALS, RECALL = 200, 0.95


def split(points: np.ndarray, k: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres of k-means and the centre of every point; empty centres are left out."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        of = nearest(points, centres)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
        sizes = np.diff(np.append(starts, len(order)))
        centres = np.add.reduceat(points[order], starts) / sizes[:, None]
    return centres, nearest(points, centres)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    out = np.empty(len(points), np.int64)
    for k in range(0, len(points), 8192):
        out[k : k + 8192] = np.argmax(points[k : k + 8192] @ centres.T - half, axis=1)
    return out


class Tree:
    """Centres of every inner node and the numbers of its children; leaves count from 0 in tree order."""

    def __init__(self, points: np.ndarray, leaf: int, branches: int = BRANCHES):
        self.centres, self.children, self.leaves = [], [], 0
        self.root = self._grow(points, leaf, branches)

    def _grow(self, points: np.ndarray, leaf: int, branches: int) -> int:
        """The number of a node: inner ones from 0, leaf n as -1 - n."""
        if len(points) > leaf:
            centres, of = split(points, min(branches, -(-len(points) // leaf) + 1), len(points))
            if len(centres) > 1:
                node = len(self.centres)
                self.centres.append(centres)
                self.children.append([])
                self.children[node] = [self._grow(points[of == c], leaf, branches) for c in range(len(centres))]
                return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out, waiting = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                of = nearest(points[rows], self.centres[node])
                waiting.extend((child, rows[of == c]) for c, child in enumerate(self.children[node]))
        return out

    def visit(self, query: np.ndarray, budget: int) -> list[int]:
        """The first ``budget`` leaves, best bin first."""
        found, queue = [], [(0.0, self.root)]
        while queue and len(found) < budget:
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                continue
            centres = self.centres[node]
            far = (centres * centres).sum(axis=1) / 2 - centres @ query  # half the squared distance, less |query|^2 / 2
            for distance, child in zip(far.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (distance, child))
        return found


def vectors(column: pa.Array) -> np.ndarray:
    """Arrow lists of numbers as rows of doubles; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy().astype(np.float64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def padded(points: np.ndarray, width: int) -> np.ndarray:
    return points if points.shape[1] == width else np.pad(points, ((0, 0), (0, width - points.shape[1])))


def lifted(points: np.ndarray, width: int, norm: float) -> np.ndarray:
    """Points with the component that makes all norms equal."""
    points = padded(points, width)
    rest = np.sqrt(np.maximum(norm * norm - (points * points).sum(axis=1), 0))
    return np.hstack([points, rest[:, None]])


def inner(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as doubles, whatever the order of rows: added up in extended precision."""
    return (points * query).astype(np.longdouble).sum(axis=1).astype(np.float64)


def likely_rows(scores: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` largest scores and of all that rounding may have put below them."""
    if len(scores) <= best:
        return np.arange(len(scores))
    bar = np.partition(scores, len(scores) - best)[len(scores) - best]
    return np.flatnonzero(scores >= bar - 1e-9 * max(abs(bar), 1.0))


class Part:
    """The vectors of one part, leaf by leaf."""

    def __init__(self, points: np.ndarray, ids: list[list[int]], leaf: np.ndarray):
        order = np.argsort(leaf, kind="stable")
        self.points, self.ids = points[order], [ids[k] for k in order]
        self.least = np.array([i[0] for i in self.ids], np.int64)
        names, starts = np.unique(leaf[order], return_index=True)
        ends = np.append(starts[1:], len(order)).tolist()
        self.span = dict(zip(names.tolist(), zip(starts.tolist(), ends, strict=True), strict=True))

    def search(self, query: np.ndarray, leaves: list[int], best: int) -> list[tuple[float, int]]:
        """(minus the score, id) of the nearest ``best`` ids in some leaves."""
        spans = [self.span[leaf] for leaf in leaves if leaf in self.span]
        if not spans:
            return []
        rows = np.concatenate([np.arange(a, b) for a, b in spans])
        rough = np.concatenate([self.points[a:b] @ query for a, b in spans])
        rows = rows[likely_rows(rough, best)]
        exact = inner(self.points[rows], query)
        order = np.lexsort((self.least[rows], -exact))[:best]
        return sorted((-s, i) for s, r in zip(exact[order].tolist(), rows[order].tolist(), strict=True) for i in self.ids[r])[:best]


class Layout:
    """The tree, the parts of its leaves, and how often each part is repeated for its queries."""

    def __init__(self, tree: Tree, width: int, norm: float):
        self.tree, self.width, self.norm, self.budget = tree, width, norm, 1
        self.first_part = self.parts = self.copies = None

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        return self.tree.leaf_of(lifted(points, self.width, self.norm))

    def visit(self, query: np.ndarray, budget: int) -> list[int]:
        return self.tree.visit(np.append(query, 0.0), budget)

    def deal(self, sizes: dict[int, int], rows: int) -> None:
        """Neighbouring leaves share a part of about ``rows`` vectors, larger ones have several."""
        self.first_part, self.parts = np.zeros(self.tree.leaves, np.int64), np.ones(self.tree.leaves, np.int64)
        part, held = 0, 0
        for leaf in range(self.tree.leaves):
            size = sizes.get(leaf, 0)
            if held and held + size > rows:
                part, held = part + 1, 0
            self.first_part[leaf], self.parts[leaf] = part, max(-(-size // rows), 1)
            held += size
            if self.parts[leaf] > 1:
                part, held = part + self.parts[leaf], 0
        self.copies = np.ones(part + 1, np.int64)

    def parts_of(self, leaves: list[int]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for leaf in leaves:
            for part in range(self.first_part[leaf], self.first_part[leaf] + self.parts[leaf]):
                out.setdefault(part, []).append(leaf)
        return out


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v and a 128-bit key of v, without rows that cannot take part."""
    kind = table.schema[vector].dataType.simpleString()
    v = F.col(f"`{vector}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector}`").cast("array<double>")
    rows = table.select(F.col(f"`{vec_id}`").try_cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumns(
        {"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}
    )


def fold_copies(rows: DataFrame, best: int) -> DataFrame:
    """One row per vector: h1, h2, v and the best + 1 smallest ids (one may be the query's own)."""
    keys = rows.select("id", "h1", "h2").distinct()
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    few = keys.withColumn("place", place).filter(F.col("place") <= best + 1)
    ids = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return rows.groupBy("h1", "h2").agg(F.any_value("v").alias("v")).join(ids, ["h1", "h2"])


def measure(vecs: DataFrame) -> tuple[int, int, float]:
    """Number of vectors, components of the longest, largest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = vectors(batch.column(0))
            square = float((points * points).sum(axis=1).max(initial=0))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(points), points.shape[1], square)], ["n", "width", "square"])

    sums = map_arrow(vecs.select("v"), run, "n long, width long, square double")
    n, width, square = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("width"), F.max("square")).first()
    return n, width or 0, float(square or 0) ** 0.5


def hashed_sample(vecs: DataFrame, rows: int, of: int, key: str) -> DataFrame:
    """About ``rows`` of the ``of`` vectors, the same ones every time."""
    steps = 1 << 40
    return vecs.filter(F.pmod(F.col(key), F.lit(steps)) < int(min(rows / max(of, 1), 1.0) * steps))


def true_neighbours(vecs: DataFrame, trials: np.ndarray, best: int) -> DataFrame:
    """The nearest ``best`` vectors of each trial query among all: trial, v."""
    width = trials.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            points = padded(vectors(batch.column(0)), width)
            scores = points @ trials.T
            if held is not None:
                points, scores = np.concatenate([held[0], points]), np.concatenate([held[1], scores])
            few = np.argsort(-scores, axis=0, kind="stable")[:best]
            keep = np.unique(few)
            held = points[keep], scores[keep]
        if held is not None:
            few = np.argsort(-held[1], axis=0, kind="stable")[:best]
            trial = np.tile(np.arange(len(trials)), len(few))
            yield pa.RecordBatch.from_arrays([
                pa.array(trial, pa.int32()), pa.array(held[1][few.ravel(), trial]),
                pa.array(held[0][few.ravel()].tolist(), pa.list_(pa.float64())),
            ], ["trial", "score", "v"])

    found = map_arrow(vecs.select("v"), run, "trial int, score double, v array<double>")
    order = Window.partitionBy("trial").orderBy(F.desc("score"), "v")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= best).select("trial", "v")


def calibrate(layout: Layout, vecs: DataFrame, queries: DataFrame, n_queries: int, best: int, recall: float) -> list[list[int]]:
    """Widen the budget until enough true neighbours of the trials stand in visited leaves."""
    trials = hashed_sample(queries, TRIALS, n_queries, "h2").limit(4 * TRIALS).select("v").toArrow().column("v")
    points = padded(vectors(trials), layout.width)
    truth = true_neighbours(vecs, points, best + 1).toArrow()
    leaves, of = layout.leaf_of(vectors(truth.column("v"))), truth.column("trial").to_numpy()
    orders = [layout.visit(q, layout.tree.leaves) for q in points]
    ranks = np.array([{leaf: k for k, leaf in enumerate(order)} for order in orders], object)
    ranks = np.array([ranks[t][leaf] for t, leaf in zip(of.tolist(), leaves.tolist(), strict=True)], np.int64)
    while (ranks < layout.budget).mean() < recall and layout.budget < layout.tree.leaves:
        layout.budget += 1
    return [order[: layout.budget] for order in orders]


def search_parts(layout: Layout, vecs: DataFrame, queries: DataFrame, best: int) -> DataFrame:
    """h1, h2, vec_id, score: the nearest of each distinct query vector in every part it visits."""
    shared = vecs.sparkSession.sparkContext.broadcast(layout)
    fields = "part long, copy long, kind int, h1 long, h2 long, v array<double>, ids array<long>, leaves array<int>"
    names = [f.split()[0] for f in fields.split(", ")]
    lists = {"v": pa.list_(pa.float64()), "ids": pa.list_(pa.int64()), "leaves": pa.list_(pa.int32())}

    def batch_of(columns: dict) -> pa.RecordBatch:
        n = len(columns["part"])
        kinds = {name: lists.get(name, pa.int32() if name == "kind" else pa.int64()) for name in names}
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names], names
        )

    def deal_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            h2, points = batch.column("h2").to_numpy(), vectors(batch.column("v"))
            leaf = plan.leaf_of(points)
            part = plan.first_part[leaf] + np.mod(h2, plan.parts[leaf])
            copies = plan.copies[part]
            row = np.repeat(np.arange(len(part)), copies)
            copy = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            ids, taken = batch.column("ids").to_pylist(), row.tolist()
            yield batch_of({
                "part": part[row], "copy": copy, "kind": np.zeros(len(row), np.int32), "v": list(points[row]),
                "ids": [ids[k] for k in taken], "leaves": leaf[row, None].tolist(),
            })

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            out = {c: [] for c in ("part", "copy", "kind", "h1", "h2", "v", "leaves")}
            h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            for a, b, point in zip(h1, h2, padded(vectors(batch.column("v")), plan.width), strict=True):
                for part, leaves in plan.parts_of(plan.visit(point, plan.budget)).items():
                    row = (part, a % int(plan.copies[part]), 1, a, b, point, leaves)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            yield batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = shared.value.width
        name, held, part = None, [], None
        for batch in batches:
            group = batch.column("part").to_numpy() * (1 << 20) + batch.column("copy").to_numpy()
            kind = batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(kind)], strict=True):
                if start == end:
                    continue
                piece = batch.slice(start, end - start)
                if group[start] != name:
                    name, held, part = group[start], [], None
                points = padded(vectors(piece.column("v")), width)
                if kind[start] == 0:
                    leaf = piece.column("leaves").flatten().to_numpy()
                    held.append((points, piece.column("ids").to_pylist(), leaf))
                    continue
                if not held and part is None:
                    continue
                if part is None:
                    part = Part(np.concatenate([p for p, _, _ in held]), [i for _, ids, _ in held for i in ids],
                                np.concatenate([leaf for _, _, leaf in held]))
                    held = []
                out = [part.search(q, leaves, best) for q, leaves in zip(points, piece.column("leaves").to_pylist(), strict=True)]
                row = pa.array(np.repeat(np.arange(len(out)), list(map(len, out))))
                yield pa.RecordBatch.from_arrays([
                    piece.column("h1").take(row), piece.column("h2").take(row),
                    pa.array([i for found in out for _, i in found], pa.int64()),
                    pa.array([-s for found in out for s, _ in found], pa.float64()),
                ], ["h1", "h2", "vec_id", "score"])

    rows = map_arrow(vecs, deal_vectors, fields).unionByName(map_arrow(queries, deal_queries, fields))
    dealt = rows.repartition("part", "copy").sortWithinPartitions("part", "copy", "kind")
    return map_arrow(dealt, run, "h1 long, h2 long, vec_id long, score double")


def nearest_neighbours(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = EVERY, best: int = BEST,
    recall: float = RECALL, leaf: int = LEAF,
) -> DataFrame:
    """The ``best`` rows nearest to each row whose id ``every`` divides: query_id, rank, vec_id, score.

    Nearness is the inner product, in double precision on the vectors as they are; equal ones
    go by id.  The tree is fitted on a sample of at least ``SAMPLE`` vectors or one in
    ``SAMPLE_SHARE``, at most ``SAMPLE_BYTES``; all vectors are indexed.  About ``TRIALS`` queries
    are compared with every vector, and the budget is widened to ``recall`` on them.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components take no part, and
    neither do rows whose id is not a whole number.  Of vectors of unequal length the shorter
    ends in zeros.  Rows that repeat an id and a vector count once; a row is never a neighbour
    of its own id; an id with several vectors asks for each of them, one after another in rank.
    An empty table gives an empty result.
    """
    spark: SparkSession = table.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(table, vec_id, vector)
    asked = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "h1", "h2").distinct()
    vecs = stage(fold_copies(rows, best), "folded-vectors")
    n, width, norm = measure(vecs)
    queries = stage(vecs.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v"), "query-vectors")
    n_queries = queries.count()
    if not n_queries or not n:
        return nothing
    most = int(min(max(SAMPLE, n // SAMPLE_SHARE), SAMPLE_BYTES // (8 * width + 8)))
    sample = lifted(vectors(hashed_sample(vecs, most, n, "h1").select("v").toArrow().column("v")), width, norm)
    tree = Tree(sample, max(SAMPLE_PER_LEAF, int(leaf * min(len(sample) / n, 1))))
    layout = Layout(tree, width, norm)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = np.unique(layout.leaf_of(vectors(batch.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sizes)], ["leaf", "n"])

    sizes = map_arrow(vecs.select("v"), leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect()
    layout.deal(dict(map(tuple, sizes)), int(min(max(n // (4 * tasks(spark)), PART_ROWS), PART_BYTES // (8 * width + 8))))
    tried = calibrate(layout, vecs, queries, n_queries, best, recall)
    visits = np.zeros(len(layout.copies))
    for order in tried:
        visits[list(layout.parts_of(order))] += n_queries / len(tried)
    layout.copies = np.maximum(np.ceil(visits / QUERIES_PER_COPY), 1).astype(np.int64)

    found = search_parts(layout, vecs, queries, best + 1)
    inside = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    few = found.withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= best + 1)
    own = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, best)
    each = asked.join(own, ["h1", "h2"]).select("query_id", "h1", "h2", F.posexplode(kept).alias("place", "x"))
    order = Window.partitionBy("query_id").orderBy("h1", "h2", "place")
    return each.select(
        "query_id", F.row_number().over(order).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )
