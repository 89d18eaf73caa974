"""Approximate nearest neighbours by cosine with a vantage-point tree per shard.

1. A top tree over a bounded sample (SAMPLE vectors of each length) splits the space into cells. Every vector goes down it
   to its cell; for each cell the least and largest distances of its vectors to the vantage points above it are kept. They
   bound the cell exactly, whatever the sample was.
2. Cells are cut by a hash of the id into shards of bounded size. One task builds the tree of a shard over its distinct
   directions and searches it for the queries that came to it.
3. Queries first search the cell that they fall into, which bounds the distance of their k-th nearest. They then visit only
   the cells, and in each tree only the branches, that the triangle inequality can't exclude, with the margin multiplied by
   factor: with factor 1 the search is exact, below 1 more is skipped.

Scores that agree to DIGITS decimals are ties, as the last bits of a sum depend on its order; of ties the smaller vec_id
comes first, and a search keeps every candidate that ties with the k-th.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null ids; vectors
of different lengths never meet; rows that repeat an id are no candidates of each other, and the nearest of them counts for
others; if there are fewer than k candidates all are returned; an empty table or query set gives an empty result; other
columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Vectors of a shard, and of a block of queries that one task looks up in it; fewer where SHARD_BYTES is reached.
SHARD_ROWS = 8192
SHARD_BYTES = 16 << 20
LEAF = 128
#: Vectors that the top tree is fitted on, and its cells, at most.
SAMPLE, CELLS = 8192, 1024
#: Multiplies the pruning margin; 1 is exact.
FACTOR = 0.7
DIGITS = 12
#: What rounding may add to a cosine and to a distance.
SLACK, REACH = 1e-11, 1e-6


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim and vec (doubles) of the vectors that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    out = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(good)
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("vec"))


def unit(vecs: np.ndarray) -> np.ndarray:
    """Directions; scaled first, so that no square overflows or vanishes."""
    vecs = vecs / np.abs(vecs).max(axis=1, keepdims=True)
    return vecs / np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))


def cosines(vecs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosines of vectors with another one for each."""
    vecs, one = (x / np.abs(x).max(axis=1, keepdims=True) for x in (vecs, one))
    return (vecs * one).sum(axis=1) / (np.sqrt((vecs * vecs).sum(axis=1)) * np.sqrt((one * one).sum(axis=1)))


def chord(cosine: np.ndarray) -> np.ndarray:
    """Distance of two directions, which obeys the triangle inequality."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _split(directions: np.ndarray, order: np.ndarray, a: int, b: int, rng) -> tuple[int, float, float]:
    """Put a vantage point at place a of order[a:b] and the others in two halves by their distance; (start of the outer half,
    largest distance inside, least outside)."""
    pick = a + int(rng.integers(b - a))
    order[[a, pick]] = order[[pick, a]]
    rest = order[a + 1 : b]
    d = chord(directions[rest] @ directions[order[a]])
    mid = len(rest) // 2
    near = np.argpartition(d, mid)
    order[a + 1 : b] = rest[near]
    d = d[near]
    return a + 1 + mid, float(d[:mid].max()) if mid else 0.0, float(d[mid:].min())


class Tree:
    """Vantage-point tree over directions."""

    def __init__(self, directions: np.ndarray, leaf: int = LEAF):
        self.unit, self.order, self.nodes = directions, np.arange(len(directions)), []
        rng = np.random.default_rng(len(directions))
        self.root = self._build(0, len(directions), max(leaf, 2), rng)

    def _build(self, a: int, b: int, leaf: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append((a, b))
        if b - a > leaf:
            mid, inner, outer = _split(self.unit, self.order, a, b, rng)
            self.nodes[me] = (a, b, self._build(a + 1, mid, leaf, rng), self._build(mid, b, leaf, rng), inner, outer)
        return me

    def search(self, queries: np.ndarray, k: int, factor: float, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, entries) of all entries as near as the k-th nearest, or nearer, and no farther than limit (least cosine)."""
        best, least = np.repeat(limit[:, None], k, axis=1), np.array(limit)
        got: list[tuple[np.ndarray, ...]] = []

        def offer(q: np.ndarray, entries: np.ndarray) -> None:
            c = queries[q] @ self.unit[entries].T
            some = np.flatnonzero(c.max(axis=1) >= least[q] - SLACK)
            if len(some):
                q, c = q[some], c[some]
                at, of = np.nonzero(c >= least[q][:, None] - SLACK)
                got.append((q[at], entries[of], c[at, of]))
                every = np.concatenate((best[q], c), axis=1)
                best[q] = np.partition(every, every.shape[1] - k, axis=1)[:, -k:]
                least[q] = best[q].min(axis=1)

        def may(q: np.ndarray, gap: np.ndarray) -> np.ndarray:
            return gap <= factor * chord(least[q]) + REACH

        def visit(node: int, q: np.ndarray) -> None:
            if not len(q):
                return
            said = self.nodes[node]
            if len(said) == 2:
                offer(q, self.order[said[0] : said[1]])
                return
            a, _, inside, outside, inner, outer = said
            offer(q, self.order[a : a + 1])
            d = chord(queries[q] @ self.unit[self.order[a]])
            first = d <= (inner + outer) / 2
            near, far = np.flatnonzero(first), np.flatnonzero(~first)
            visit(inside, q[near[may(q[near], d[near] - inner)]])
            visit(outside, q[far[may(q[far], outer - d[far])]])
            visit(outside, q[near[may(q[near], outer - d[near])]])
            visit(inside, q[far[may(q[far], d[far] - inner)]])

        visit(self.root, np.arange(len(queries)))
        if not got:
            return np.zeros(0, int), np.zeros(0, int)
        q, entry, c = (np.concatenate(x) for x in zip(*got, strict=True))
        keep = c >= least[q] - SLACK
        return q[keep], entry[keep]


class Top:
    """The top tree of one vector length: vantage points, and for each cell the way to it."""

    def __init__(self, directions: np.ndarray, cells: int):
        rng, order = np.random.default_rng(len(directions)), np.arange(len(directions))
        self.points: list[np.ndarray] = []
        self.paths: list[list[tuple[int, bool]]] = []
        self.nodes: list[tuple] = []

        def build(a: int, b: int, n: int, path: list) -> int:
            me = len(self.nodes)
            self.nodes.append((len(self.paths),))
            if n < 2 or b - a < 4:
                self.paths.append(path)
                return me
            mid, inner, outer = _split(directions, order, a, b, rng)
            point = len(self.points)
            self.points.append(directions[order[a]])
            self.nodes[me] = (point, (inner + outer) / 2, build(a + 1, mid, n // 2, [*path, (point, True)]), build(mid, b, n - n // 2, [*path, (point, False)]))
            return me

        self.root = build(0, len(directions), cells, [])
        self.at = np.array(self.points) if self.points else np.zeros((0, directions.shape[1]))
        self.deep = max(map(len, self.paths))
        self.way = np.array([[p for p, _ in path] + [-1] * (self.deep - len(path)) for path in self.paths], int).reshape(len(self.paths), self.deep)

    def distances(self, directions: np.ndarray) -> np.ndarray:
        """To each vantage point."""
        return chord(directions @ self.at.T)

    def cell(self, d: np.ndarray) -> np.ndarray:
        """The cell of each row of distances()."""
        out = np.zeros(len(d), int)
        todo = [(self.root, np.arange(len(d)))]
        while todo:
            node, rows = todo.pop()
            said = self.nodes[node]
            if len(said) == 1:
                out[rows] = said[0]
            elif len(rows):
                near = d[rows, said[0]] <= said[1]
                todo += [(said[2], rows[near]), (said[3], rows[~near])]
        return out

    def gaps(self, d: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Least distance [row, cell] that the triangle inequality leaves to a cell's vectors; bounds: [cell, step, least and largest]."""
        out = np.zeros((len(d), len(self.paths)))
        for step in range(self.deep):
            there = self.way[:, step] >= 0
            own = d[:, self.way[there, step]]
            out[:, there] = np.maximum(out[:, there], np.maximum(bounds[there, step, 0] - own, own - bounds[there, step, 1]))
        return out


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def search_shard(asked: pa.Table, held: pa.Table, k: int, factor: float) -> pa.Table:
    """query_id, vec_id, score of the k best of a shard (vec_id, vec) for queries (query_id, vec, least); ties to the smaller id."""
    if not asked.num_rows or not held.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    ids, vecs = held.column("vec_id").to_numpy(), _matrix(held.column("vec"))
    by = np.argsort(ids, kind="stable")
    ids, vecs = ids[by], vecs[by]
    directions, entry = np.unique(unit(vecs), axis=0, return_inverse=True)
    entry = entry.reshape(-1)
    members = np.argsort(entry, kind="stable")
    offs = np.searchsorted(entry[members], np.arange(len(directions) + 1))
    q_ids, q_vecs = asked.column("query_id").to_numpy(), _matrix(asked.column("vec"))
    q, found = Tree(directions).search(unit(q_vecs), k + 1, factor, asked.column("least").to_numpy())
    # of one direction no more than the k + 1 smallest ids can be among the best
    per = np.minimum(np.diff(offs)[found], k + 1)
    row = members[np.repeat(offs[found] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]
    q = np.repeat(q, per)
    other = ids[row] != q_ids[q]
    q, row = q[other], row[other]
    score = cosines(vecs[row], q_vecs[q])
    order = np.lexsort((ids[row], -np.round(score, DIGITS), q))
    q, row, score = q[order], row[order], score[order]
    first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
    keep = rank < k + 1
    return pa.table({"query_id": q_ids[q[keep]], "vec_id": ids[row[keep]], "score": score[keep]})


def nearest(embeddings: DataFrame, queries: Column, k: int = 5, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, cells: int = CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other vectors found for each row of embeddings (vec_id,
    embedding) for which queries holds, by cosine in double precision, ties to the smaller vec_id."""
    spark = embeddings.sparkSession
    shared.ship(spark)
    rows = usable(embeddings)
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(CELLS).collect()}
    room = {dim: max(1, min(shard_rows, SHARD_BYTES // (8 * dim))) for dim in sizes}
    tops: dict[int, Top] = {}
    for dim, n in sizes.items():
        want = min(cells, -(-n // room[dim]), max(1, sample // 4))
        if want > 1:
            # a bounded number of rows, the same in every run
            some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(min(sample, max(4, (SHARD_BYTES * 4) // (8 * dim)))).select("vec").toArrow()
            tops[dim] = Top(unit(_matrix(some.column("vec"))), want)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch):
                cell, path = np.zeros(own.num_rows, int), [[]] * own.num_rows
                if dim in tops:
                    d = tops[dim].distances(unit(_matrix(own.column("vec"))))
                    cell = tops[dim].cell(d)
                    way = tops[dim].way[cell]
                    path = [x[w >= 0].tolist() for x, w in zip(np.take_along_axis(d, np.maximum(way, 0), 1), way, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int32()), pa.array(path, pa.list_(pa.float64()))], [*own.schema.names, "cell", "path"])

    folder = shared.new_folder(spark, "vectors")
    placed = shared.table(rows.mapInArrow(place, "vec_id long, dim int, vec array<double>, cell int, path array<double>"), f"{folder}/placed")
    # one row for each cell and step of its path
    known = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES // 8) / F.col("dim"))))
    known = known.select("*", F.ceil(F.col("n") / most).cast("int").alias("shards"))
    known = shared.table(known, f"{folder}/cells")
    bounds = {dim: np.zeros((len(t.paths), t.deep, 2)) for dim, t in tops.items()}
    if tops:
        steps = placed.where(F.col("dim").isin(*tops)).select("dim", "cell", F.posexplode("path").alias("step", "d")).groupBy("dim", "cell", "step").agg(F.min("d").alias("low"), F.max("d").alias("high"))
        for r in steps.collect():  # at most as many as the top trees have
            bounds[r.dim][r.cell, r.step] = r.low, r.high
    asked = placed.join(embeddings.where(queries & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "dim", "vec", F.col("cell").alias("home"))
    held = placed.join(known.drop("n"), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")).cast("int")).select("dim", "cell", "shard", "vec_id", "vec")

    def found(visits: DataFrame, tag: str) -> DataFrame:
        """query_id, vec_id, score from visits (query_id, dim, vec, cell, least): every shard of the cell is searched. A shard is
        read once for each block of queries."""
        visits = shared.table(visits.join(known, ["dim", "cell"]).select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")), f"{folder}/visits{tag}")
        per = visits.groupBy("dim", "cell", "shard").agg(F.count("*").alias("asked"))
        per = per.select("dim", "cell", "shard", F.ceil(F.col("asked") / F.lit(shard_rows)).cast("int").alias("blocks"))
        by = ["dim", "cell", "shard", "block"]
        left = visits.join(per, by[:3]).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("blocks")).cast("int")).select(*by, "query_id", "vec", "least")
        right = held.join(per, by[:3]).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(*by, "vec_id", "vec")
        search = lambda one, two: search_shard(one, two, k, factor)
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")

    near = shared.table(found(asked.select("query_id", "dim", "vec", F.col("home").alias("cell"), F.lit(-2.0).alias("least")), "home"), f"{folder}/near")
    if tops:
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        # k + 1 rows for each query and shard: those of one query fit a window
        least = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("_k", F.row_number().over(best)).where(F.col("_k") == k).select("query_id", F.col("score").alias("least"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    for dim, own in _by_dim(batch.slice(at, 1024)):
                        if dim not in tops:
                            continue
                        top, low = tops[dim], own.column("least").to_numpy()
                        gaps = top.gaps(top.distances(unit(_matrix(own.column("vec")))), bounds[dim])
                        open_ = gaps <= factor * chord(low)[:, None] + REACH
                        open_[np.arange(len(low)), own.column("home").to_numpy()] = False
                        q, cell = np.nonzero(open_)
                        own = own.take(pa.array(q))
                        yield pa.RecordBatch.from_arrays([own.column("query_id"), own.column("dim"), own.column("vec"), pa.array(cell, pa.int32()), own.column("least")], ["query_id", "dim", "vec", "cell", "least"])

        away = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))).select("query_id", "dim", "vec", "home", "least")
        near = near.union(found(away.mapInArrow(route, "query_id long, dim int, vec array<double>, cell int, least double"), "away"))
    by = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vptree(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
