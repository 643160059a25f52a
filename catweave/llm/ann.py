"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample, with as many leaves as the sample fills; every row is put into a
leaf by descending to the nearest child.  A query walks the tree with a priority queue: a node's priority is
the inner product with its centre plus what its rows usually lie beyond the centre in the query's direction.
So leaves come out best first; how many a query visits is calibrated on the sample, widened until the wanted
recall against exact search there is reached, and widened further for a query whose leaves hold too few rows.

Leaves that follow each other in the tree are stored together in blocks of bounded size (a leaf may hold a
third of all rows, and is then dealt over several).  A query goes once to each block that has a leaf it
visits, and there only these leaves are scored; a block returns a query's best.  Vectors of one dimension
have a tree of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .common import written

#: Rows, and bytes of vectors, that the trees are fitted on; sample queries for calibration; rows and queries of one block.
SAMPLE, SAMPLE_BYTES, TRIALS, BLOCK_ROWS, BLOCK_QUERIES = 65_536, 32 << 20, 256, 8192, 4096
#: Children of a node, sample rows of a leaf at most, and queries scored at once.
BRANCHING, LEAF, AT_ONCE = 16, 64, 256


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, one of them not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class KMeansTree:
    """Centres by node, children by node (none: a leaf), leaves in the order of the tree."""

    def __init__(self, points: np.ndarray, branching: int = BRANCHING, leaf: int = LEAF, seed: int = 1):
        centres, spread, self.children = [points.mean(0)], [0.0], [[]]
        rng = np.random.default_rng(seed)
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            # What a row of the node has beyond the centre along a direction: four standard deviations.
            spread[node] = 4 * float(((own - centres[node]) ** 2).mean()) ** 0.5
            if len(own) <= leaf:
                continue
            found, label = _kmeans(own, branching, rng)
            if len(found) < 2:
                continue
            for k, centre in enumerate(found):
                self.children[node].append(len(centres))
                todo.append((len(centres), own[label == k]))
                centres.append(centre)
                spread.append(0.0)
                self.children.append([])
        self.matrix, self.spread = np.stack(centres), np.array(spread)
        self.leaves: list[int] = []
        todo = [0]
        while todo:
            node = todo.pop()
            todo += self.children[node][::-1]
            if not self.children[node]:
                self.leaves.append(node)
        self.place = np.full(len(centres), -1)
        self.place[self.leaves] = np.arange(len(self.leaves))

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, by its place among the leaves."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.place[node]
            elif len(rows):
                kids = np.array(self.children[node])
                c = self.matrix[kids]
                near = np.argmin((c * c).sum(1) - 2 * points[rows] @ c.T, axis=1)
                todo += [(int(kid), rows[near == k]) for k, kid in enumerate(kids)]
        return out

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.matrix.T + np.sqrt((queries * queries).sum(1))[:, None] * self.spread

    def visit(self, priority: list[float], most: int, rows: list[int] | None = None, enough: int = 0) -> list[int]:
        """Places of the first leaves, best bin first: ``most``, and on until they have ``enough`` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        children, place, push, pop = self.children, self.place, heapq.heappush, heapq.heappop
        while queue and (len(out) < most or held < enough):
            _, node = pop(queue)
            kids = children[node]
            for kid in kids:
                push(queue, (-priority[kid], kid))
            if not kids:
                out.append(int(place[node]))
                held += rows[out[-1]] if rows is not None else 0
        return out

    def calibrate(self, points: np.ndarray, k: int, recall: float) -> int:
        """Fewest leaves that find this share of the sample's own ``k`` nearest."""
        leaf = self.assign(points)
        step = max(1, len(points) // TRIALS)
        found = np.zeros(len(self.leaves))
        total = 0
        for i in range(0, len(points), step):
            score = points @ points[i]
            score[i] = -np.inf
            near = np.argsort(-score, kind="stable")[: min(k, len(points) - 1)]
            order = np.empty(len(self.leaves), np.int64)
            order[self.visit(self.priorities(points[i : i + 1])[0].tolist(), len(self.leaves))] = np.arange(len(self.leaves))
            np.add.at(found, order[leaf[near]], 1)
            total += len(near)
        share = np.cumsum(found) / max(1, total)
        return min(len(self.leaves), int(np.searchsorted(share, recall)) + 1)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from k-means++ seeds; fewer centres if there are fewer distinct points."""
    centres = [points[rng.integers(len(points))]]
    gap = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k and gap.max() > 1e-12:
        centres.append(points[rng.choice(len(points), p=gap / gap.sum())])
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    label = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        label = np.argmin((c * c).sum(1) - 2 * points @ c.T, axis=1)
        size = np.bincount(label, minlength=len(c))
        c = np.stack([points[label == i].mean(0) if size[i] else c[i] for i in range(len(c))])
    label = np.argmin((c * c).sum(1) - 2 * points @ c.T, axis=1)
    used = np.unique(label)
    return c[used], np.searchsorted(used, label)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each dimension."""
    size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        yield n, batch.filter(pa.array(size == n))


class _Index:
    """Trees by dimension, and where the rows of each leaf are stored."""

    def __init__(self, points: dict[int, np.ndarray], k: int, recall: float):
        self.trees = {n: KMeansTree(p) for n, p in points.items()}
        self.most = {n: t.calibrate(points[n], k, recall) for n, t in self.trees.items()}
        self.enough = k + 1

    def leaves(self, size: int, vectors: np.ndarray) -> np.ndarray:
        # A dimension that the sample lacks is rare: its rows are one leaf.
        return self.trees[size].assign(vectors) if size in self.trees else np.zeros(len(vectors), np.int64)

    def store(self, counts: list[tuple[int, int, int, int]]) -> None:
        """Deal the leaves, given as ``(dimension, leaf, rows, ids)``, into blocks."""
        self.first: dict[int, np.ndarray] = {}
        self.chunks: dict[int, np.ndarray] = {}
        self.ids: dict[int, list[int]] = {}
        block, held, before = -1, 0, None
        for size, leaf, rows, ids in sorted(counts):
            if size not in self.first:
                n = len(self.trees[size].leaves) if size in self.trees else 1
                self.first[size], self.chunks[size], self.ids[size] = np.zeros(n, np.int64), np.zeros(n, np.int64), [0] * n
            if size != before or held + rows > BLOCK_ROWS:
                block, held = block + 1, 0
            before, chunks = size, -(-rows // BLOCK_ROWS)
            self.first[size][leaf], self.chunks[size][leaf], self.ids[size][leaf] = block, chunks, ids
            block, held = block + chunks - 1, rows if chunks == 1 and not held else held + rows if chunks == 1 else BLOCK_ROWS

    def visits(self, size: int, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each query its number and the leaves it visits that have rows."""
        tree, ids = self.trees.get(size), self.ids[size]
        for i in range(0, len(queries), AT_ONCE):
            if tree is None:
                yield from ((j, np.zeros(1, np.int64)) for j in range(i, min(i + AT_ONCE, len(queries))))
                continue
            for j, p in enumerate(tree.priorities(queries[i : i + AT_ONCE]), i):
                own = np.array(tree.visit(p.tolist(), self.most[size], ids, self.enough), np.int64)
                yield j, own[self.chunks[size][own] > 0]


def _best(rows: pa.Table, queries: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a block's rows the best ones for each query, of the leaves it visits."""
    ids, m, leaf = rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks()), rows.column("leaf").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, m, leaf = ids[order], m[order], leaf[order]
    # Places are taken by ids, not rows: the best of an id's rows counts.
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    one, row_of = ids[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    by_leaf = np.argsort(leaf, kind="stable")
    named, cut = np.unique(leaf[by_leaf], return_index=True)
    rows_of = dict(zip(named.tolist(), np.split(by_leaf, cut[1:])))
    names, q, asked = queries.column("query_id").to_numpy(), _matrix(queries.column("v").combine_chunks()), queries.column("leaves").combine_chunks()
    slack = 1e-9 * float(np.abs(m).max() * np.abs(q).max()) * m.shape[1]
    for at in range(0, len(names), AT_ONCE):
        part = asked.slice(at, AT_ONCE)
        who = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
        what = part.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        near = np.full((len(part), len(ids)), -np.inf)
        edges = np.flatnonzero(np.concatenate([[True], what[1:] != what[:-1]])) if len(what) else []
        for lo, hi in zip(edges, [*edges[1:], len(what)]):
            own = rows_of.get(int(what[lo]))
            if own is not None:
                near[np.ix_(who[lo:hi], own)] = q[at + who[lo:hi]] @ m[own].T
        top = near if len(one) == len(ids) else np.maximum.reduceat(near, first, axis=1)
        for i, (s, t) in enumerate(zip(near, top), at):
            t[one == names[i]] = -np.inf
            # What rounding may move across the last place is kept, then scored row by row in a fixed order.
            floor = np.partition(t, -k)[-k] - slack if len(t) > k else -np.inf
            best = np.flatnonzero((s > -np.inf) & (s >= floor) & (t > -np.inf)[row_of])
            exact = (m[best] * q[i]).sum(1)
            best, exact = best[o := np.lexsort((ids[best], -exact))], exact[o]
            o = np.sort(np.unique(ids[best], return_index=True)[1])[:k]
            yield np.full(len(o), names[i]), ids[best[o]], exact[o]


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.94) -> DataFrame:
    """The ``k`` nearest found for every query row: ``query_id, rank`` (from 1), ``vec_id, score``.

    Nearness is the inner product in double precision; ties go to the smaller id.  Rows whose vector is
    not usable or has a null id take no part; vectors of different dimensions are no candidates for each
    other.  A row is no candidate for queries of its own id; a repeated row counts once.  With fewer than
    ``k`` candidates all are returned; an empty table, or one vector, gives no rows.  Vectors of any
    dimension are read whole; other columns are ignored.  The trees are fitted on at most ``SAMPLE`` rows;
    all rows are indexed.
    """
    spark = vectors.sparkSession
    v = F.col(vector)
    if vectors.schema[vector].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    good = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & usable("v"))
    n, numbers = good.agg(F.count("*"), F.sum(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES * n // (8 * numbers)))
    # Bounded: about ``wanted`` rows, whatever the table.
    sample = good.select("v") if n <= wanted else good.select("v").sample(False, wanted / n, 7).limit(2 * wanted)
    points: dict[int, list[np.ndarray]] = {}
    for batch in sample.toArrow().to_batches():
        for size, rows in _by_size(batch):
            points.setdefault(size, []).append(_matrix(rows.column("v")))
    index = _Index({size: np.concatenate(p) for size, p in points.items()}, k, recall)
    del points
    fitted = spark.sparkContext.broadcast(index)  # a bounded number of centres
    kind = good.schema["v"].dataType.simpleString()

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                leaf = fitted.value.leaves(size, _matrix(part.column("v")))
                yield part.append_column("size", pa.array(np.full(len(leaf), size, np.int32))).append_column("leaf", pa.array(leaf.astype(np.int32)))

    indexed = written(good.mapInArrow(leaves, f"vec_id long, v {kind}, q boolean, size int, leaf int"), "indexed")
    # Bounded: a row per leaf of the fitted trees.
    counts = indexed.groupBy("size", "leaf", "vec_id").agg(F.count("*").alias("n")).groupBy("size", "leaf").agg(F.sum("n"), F.count("*")).collect()
    index.store([tuple(r) for r in counts])
    stored_by = spark.sparkContext.broadcast(index)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = stored_by.value
        for batch in batches:
            for size, part in _by_size(batch):
                who, block, lists = [], [], []
                for i, leaf in own.visits(size, _matrix(part.column("v"))):
                    first, chunks = own.first[size][leaf], own.chunks[size][leaf]
                    at = np.concatenate([first + c for c in range(int(chunks.max(initial=0)))]) if len(leaf) else first
                    every = np.concatenate([np.where(chunks > c, leaf, -1) for c in range(int(chunks.max(initial=0)))]) if len(leaf) else leaf
                    at, every = at[every >= 0], every[every >= 0]
                    order = np.argsort(at, kind="stable")
                    names, cut = np.unique(at[order], return_index=True)
                    who += [i] * len(names)
                    block += names.tolist()
                    lists += np.split(every[order].astype(np.int32), cut[1:])
                    if len(who) > 4096:
                        yield _asked(part, who, block, lists)
                        who, block, lists = [], [], []
                if who:
                    yield _asked(part, who, block, lists)

    asked = written(indexed.where("q").select("vec_id", "v").mapInArrow(visits, f"query_id long, v {kind}, block long, leaves array<int>"), "asked")
    # Bounded: a row per block, which are as many as BLOCK_ROWS rows fill.
    groups = {r["block"]: max(1, -(-r["n"] // BLOCK_QUERIES)) for r in asked.groupBy("block").agg(F.count("*").alias("n")).collect()}
    group_of = spark.sparkContext.broadcast(groups)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, to = stored_by.value, group_of.value
        for batch in batches:
            for size, part in _by_size(batch):
                leaf, name = part.column("leaf").to_numpy(), part.column("vec_id").to_numpy()
                block = own.first[size][leaf] + (ragged.mix(name.view(np.uint64)) % own.chunks[size][leaf].astype(np.uint64)).astype(np.int64)
                copies = np.array([to.get(b, 0) for b in block.tolist()])
                for g in range(int(copies.max(initial=0))):
                    some = part.filter(pa.array(copies > g))
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("v"), some.column("leaf"), pa.array(block[copies > g]), pa.array(np.full(some.num_rows, g, np.int64))], ["vec_id", "v", "leaf", "block", "group"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = group_of.value
        for batch in batches:
            name = ragged.mix(batch.column("query_id").to_numpy().view(np.uint64)) >> np.uint64(8)
            count = np.array([to[b] for b in batch.column("block").to_pylist()], np.uint64)
            yield batch.append_column("group", pa.array((name % count).astype(np.int64) if len(name) else np.empty(0, np.int64)))

    stored = indexed.select("vec_id", "v", "leaf").mapInArrow(place, f"vec_id long, v {kind}, leaf int, block long, group long")
    dealt = asked.mapInArrow(deal, f"query_id long, v {kind}, block long, leaves array<int>, group long")

    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = list(_best(rows, queries, k)) if rows.num_rows and queries.num_rows else []
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(cols, ["query_id", "vec_id", "score"])

    found = stored.groupBy("block", "group").cogroup(dealt.groupBy("block", "group")).applyInArrow(lambda rows, queries: score(rows, queries), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _asked(part: pa.RecordBatch, who: list[int], block: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of queries and the blocks they go to."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    which = pa.array(who)
    return pa.RecordBatch.from_arrays(
        [part.column("vec_id").take(which), part.column("v").take(which), pa.array(block, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))],
        ["query_id", "v", "block", "leaves"],
    )
