"""Exact top-k search by inner product: the space is split at medians into boxes, which are the shards, each shard has a KD-tree
of median splits with tight bounding boxes, and queries visit boxes best first, by the bound that a box gives on their score,
against the k-th score found so far.

Vectors are quantised to integers floor(scale * x), so scores are exact and ties are real. The upper levels of the tree are
fitted on a bounded sample (SAMPLE_ROWS) and then place every vector; the box of each leaf comes from all its vectors. A leaf
with more than a shard's rows, such as many equal vectors, is dealt into parts by a hash. In a first round each query searches
its own part, in a second the other parts of its leaf and the leaves with the best bounds, in a third all others that can still
reach its k-th score, which travels with it. A query is sent only to the boxes that it visits, and no vector is ever copied.
Within a part queries are taken together, box by box, and leave out boxes that cannot reach their k-th score, so the result is
that of a full comparison.

Defined results: vectors that are null, or hold a null or non-finite component, or one that overflows a double after scaling,
take no part. Vectors are compared with those of their own length. A query's own row is the one with its id, and so are rows
that repeat the id; a repeated id with different vectors is as many queries. A null id is never a query. Ties go to the smaller
id, nulls last. Scores are exact up to 38 digits and are given as the nearest long. Fewer candidates than k give fewer rows.
Other columns of the input are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

#: Rows of a part, about; of a block of queries that visits it; and of a box in its tree, unless all its vectors are equal.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16384, 8192, 256
#: Rows on which the upper tree is fitted; its leaves, at most, and the bytes of their boxes, which every task gets.
SAMPLE_ROWS, MAX_LEAVES, BOX_BYTES = 65536, 4096, 32 << 20
#: Leaves that a query visits in the second round.
NEAR_LEAVES = 4
_NO_ID = np.iinfo(np.int64).max
_LEAST = -(2.0**1000)
_LIMIT = 10**38 - 1


def _halves(own: np.ndarray) -> tuple[int, float] | None:
    """The widest side and a value on it that parts the points in two; none if all are equal."""
    low, high = own.min(axis=0), own.max(axis=0)
    widths = high - low
    if not widths.size or not widths.max() > 0:
        return None
    axis = int(widths.argmax())
    value = np.sort(own[:, axis])[len(own) // 2]
    return axis, value if value > low[axis] else own[own[:, axis] > low[axis], axis].min()


class Splits:
    """The upper levels of a KD-tree: median splits of a sample on the widest side."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis: list[int] = []
        self.value: list[float] = []
        self.below: list[list[int]] = []
        self.leaves = 0
        todo = [(sample, leaves, -1, 0)]
        while todo:
            own, share, parent, side = todo.pop()
            cut = _halves(own) if share > 1 and len(own) > 1 else None
            if cut:
                at = len(self.axis)
                self.axis.append(cut[0])
                self.value.append(cut[1])
                self.below.append([0, 0])
                right = own[:, cut[0]] >= cut[1]
                todo += [(own[right], share // 2, at, 1), (own[~right], share - share // 2, at, 0)]
            else:
                at = -1 - self.leaves
                self.leaves += 1
            if parent >= 0:
                self.below[parent][side] = at

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.full(len(points), 0 if self.axis else -1)
        axis, value, below = np.array(self.axis or [0]), np.array(self.value or [0]), np.array(self.below or [[-1, -1]])
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = points[inner, axis[node]] >= value[node]
            at[inner] = below[node, right.astype(int)]
        return -1 - at


class KDTree:
    """Median splits on the widest side down to boxes of some rows, with the tight box of each one's points."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.boxes: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            cut = _halves(points[rows]) if len(rows) > leaf_rows else None
            if cut:
                right = points[rows, cut[0]] >= cut[1]
                todo += [rows[right], rows[~right]]
            elif len(rows):
                self.boxes.append(rows)
        self.low = np.array([points[rows].min(axis=0) for rows in self.boxes])
        self.high = np.array([points[rows].max(axis=0) for rows in self.boxes])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and box, the greatest inner product that a point in the box can have."""
        return bounds(queries, self.low, self.high)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Best:
    """The k best scores of each of some queries, ties by id."""

    def __init__(self, queries: int, k: int, floors: np.ndarray, kind):
        self.k = k
        self.scores = np.full((queries, k), _LEAST, dtype=kind)
        self.ids = np.full((queries, k), _NO_ID, dtype=np.int64)
        self.found = np.zeros(queries, dtype=np.int64)
        self.floors = floors.astype(kind)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """One score for each row number in ``rows``."""
        those = np.unique(rows)
        self.found[those] = np.minimum(self.k, self.found[those] + np.bincount(np.searchsorted(those, rows), minlength=len(those)))
        every = np.concatenate([np.repeat(those, self.k), rows])
        all_scores = np.concatenate([self.scores[those].ravel(), scores])
        all_ids = np.concatenate([self.ids[those].ravel(), ids])
        fill = np.concatenate([(self.scores[those] == _LEAST).ravel(), np.zeros(len(rows), dtype=bool)])
        keys = np.unique(all_scores, return_inverse=True)[1] if all_scores.dtype == object else all_scores
        order = np.lexsort((all_ids, fill, -keys, every))
        first = np.searchsorted(every[order], those)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.scores[those] = all_scores[take].reshape(-1, self.k)
        self.ids[those] = all_ids[take].reshape(-1, self.k)
        full = those[self.found[those] == self.k]
        self.floors[full] = np.maximum(self.floors[full], self.scores[full, -1])


def search(tree: KDTree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> Best:
    """The best of each query, none below its floor: first the two boxes with its best bounds, then all that still reach it."""
    limits = tree.bounds(queries)
    best = Best(len(queries), k, floors, limits.dtype)

    def visit(box: int, who: np.ndarray) -> None:
        rows = tree.boxes[box]
        scores = queries[who] @ points[rows].T
        good = (scores >= best.floors[who][:, None]) & (ids[rows][None, :] != query_ids[who][:, None])
        q, r = np.nonzero(good)
        if len(q):
            best.add(who[q], scores[q, r], ids[rows][r])

    near = np.argsort(-limits, axis=1)[:, :2]
    for step in range(near.shape[1]):
        own = near[:, step]
        for box in np.unique(own):
            who = np.flatnonzero((own == box) & (limits[:, box] >= best.floors))
            if len(who):
                visit(int(box), who)
    for box in np.argsort(-limits.max(axis=0)) if len(queries) else ():
        who = np.flatnonzero((limits[:, box] >= best.floors) & (near != box).all(axis=1))
        if len(who):
            visit(int(box), who)
    return best


_RESULT = "query_id long, query long, vec_id long, score decimal(38,0), low array<double>, high array<double>, dims int, leaf int"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, q, dims) of the vectors that take part; q holds whole numbers as doubles, which are exact at any size."""
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    scaled = whole.withColumn("v", F.transform("v", lambda x: x * scale))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = scaled.where(F.coalesce(finite, F.lit(False)))
    return part.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x) >= 2.0**53, x).otherwise(F.floor(x).cast("double"))).alias("q"), F.size("v").alias("dims"))


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    return flat.reshape(-1, dims) if dims else flat.reshape(len(column), 0)


def _exact(points: np.ndarray, queries: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """As doubles while products and sums stay below 2^53, else as Python's whole numbers."""
    if float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1) < 2.0**53:
        return points, queries
    whole = np.frompyfunc(int, 1, 1)
    return whole(points), whole(queries)


def _searcher(k: int, first: bool, leaf_rows: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Vectors of a part and the queries that visit it; in the first round also the box of the part."""
        dims, leaf = key[0].as_py(), key[1].as_py()
        parts = []
        raw, asked = _matrix(left["q"], dims), _matrix(right["q"], dims)
        for lo in range(0, len(asked) if len(raw) else 0, BLOCK_ROWS):
            points, queries = _exact(raw, asked[lo : lo + BLOCK_ROWS], dims)
            tree = KDTree(points, leaf_rows)
            own = right["vec_id"].slice(lo, BLOCK_ROWS).to_numpy()
            name = right["query"].slice(lo, BLOCK_ROWS).to_numpy()
            kth = right["kth"].slice(lo, BLOCK_ROWS).fill_null(_LEAST).to_numpy() if not first else np.full(len(own), _LEAST)
            best = search(tree, points, left["vec_id"].fill_null(_NO_ID).to_numpy(), queries, own, kth, k)
            got = np.arange(k)[None, :] < best.found[:, None]
            scores = best.scores[got]
            if scores.dtype == object:
                given = pa.array([Decimal(max(-_LIMIT, min(_LIMIT, int(s)))) for s in scores], pa.decimal128(38, 0))
            else:
                given = pa.array(scores.astype(np.int64)).cast(pa.decimal128(38, 0))
            ids = best.ids[got]
            parts.append((np.repeat(own, got.sum(axis=1)), np.repeat(name, got.sum(axis=1)), pa.array(ids, mask=ids == _NO_ID), given))
        kinds = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0)), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("dims", pa.int32()), ("leaf", pa.int32())])
        tables = []
        for columns in parts:
            none = [pa.nulls(len(columns[0]), kinds.field(c).type) for c in range(4, 8)]
            tables.append(pa.Table.from_arrays([*(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns), *none], schema=kinds))
        if first and len(raw):
            box = [[None], [None], [None], [None], [raw.min(axis=0).tolist()], [raw.max(axis=0).tolist()], [dims], [leaf]]
            tables.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(box, kinds, strict=True)], schema=kinds))
        return pa.concat_tables(tables) if tables else kinds.empty_table()

    return run


def fit_splits(base: DataFrame, total: int, leaves: int, sample_rows: int = SAMPLE_ROWS) -> dict[int, Splits]:
    """For each length, the splits of a sample of ``base`` (q, dims, salt): about ``sample_rows`` rows of all."""
    share = min(1.0, sample_rows / max(1, total))
    rows = base.where(F.pmod("salt", F.lit(1 << 30)) < int(share * (1 << 30))).select("q", "dims").toArrow()
    by: dict[int, list[int]] = {}
    for k, dims in enumerate(rows["dims"].to_pylist()):
        by.setdefault(dims, []).append(k)
    out = {}
    for dims, at in by.items():
        own = min(leaves, max(1, BOX_BYTES // (16 * max(1, dims))))
        out[dims] = Splits(_matrix(rows["q"].take(pa.array(at)), dims), max(1, own * len(at) // max(1, rows.num_rows)))
    return out


def _placed(base: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    """``base`` with the leaf of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            leaf = np.zeros(len(lengths), dtype=np.int32)
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                if int(dims) in splits:
                    leaf[at] = splits[int(dims)].place(_matrix(batch.column("q").take(pa.array(at)), int(dims)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return base.mapInArrow(run, "vec_id long, q array<double>, dims int, salt long, leaf int")


def _visits(queries: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], near: bool) -> DataFrame:
    """``queries`` with each leaf that they visit: their own and the NEAR_LEAVES with the best bounds, or all others; each only
    if its bound reaches the query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            home = batch.column("own_leaf").to_numpy()
            kth = batch.column("kth").fill_null(_LEAST).to_numpy()
            for dims in np.unique(lengths):
                names, low, high = boxes[int(dims)]
                for at in np.array_split(np.flatnonzero(lengths == dims), 1 + len(lengths) * len(names) // (1 << 22)):
                    limit = bounds(_matrix(batch.column("q").take(pa.array(at)), int(dims)), low, high)
                    own = names[None, :] == home[at][:, None]
                    place = np.argsort(np.argsort(-np.where(own, np.inf, limit), axis=1, kind="stable"), axis=1, kind="stable")
                    reached = limit + np.abs(limit) * 1e-9 + 1 >= kth[at][:, None]
                    q, leaf = np.nonzero(reached & ((place <= NEAR_LEAVES) == near))
                    rows = batch.take(pa.array(at[q]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[leaf].astype(np.int32))], [*rows.schema.names, "leaf"])

    return queries.mapInArrow(run, "dims int, vec_id long, query long, q array<double>, own_leaf int, own_part int, kth double, leaf int")


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``query_every``, its k best other vectors."""
    # The row number tells rows of one id apart, so that a repeated vector fills no part.
    every = quantised(vectors, id_col, vector_col, scale).withColumn("salt", F.xxhash64("vec_id", "q", F.monotonically_increasing_id()))
    total = every.count()
    leaves = min(MAX_LEAVES, -(-total // shard_rows))
    splits = fit_splits(every, total, leaves, sample_rows) if leaves > 1 else {}
    placed = materialise(_placed(every, splits), "search-vectors")
    counts = placed.groupBy("dims", "leaf").agg(F.count("*").alias("n")).collect()  # a row for each leaf
    parts = vectors.sparkSession.createDataFrame([(r.dims, r.leaf, -(-r.n // shard_rows)) for r in counts], "dims int, leaf int, parts int")
    base = placed.join(F.broadcast(parts), ["dims", "leaf"]).withColumn("part", F.pmod("salt", "parts").cast("int"))
    asked = base.where(F.col("vec_id") % query_every == 0).withColumn("query", F.xxhash64("vec_id", "q"))
    asked = materialise(asked.groupBy("vec_id", "query").agg(F.first(F.struct("q", "dims", "leaf", "part")).alias("x")).select("vec_id", "query", "x.*"), "search-queries")
    group = ["dims", "leaf", "part"]
    found = materialise(base.select("vec_id", "q", *group).groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(_searcher(k, True, leaf_rows), _RESULT), "search-found")
    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    sides = found.where("low IS NOT NULL").select("dims", "leaf", F.arrays_zip("low", "high").alias("box")).toArrow()
    if sides.num_rows == 1 or not total:
        return _ranked(found, k)
    for r in sides.to_pylist():
        own = boxes.setdefault(r["dims"], {})
        low, high = np.array([b["low"] for b in r["box"]]), np.array([b["high"] for b in r["box"]])
        known = own.get(r["leaf"], (low, high))
        own[r["leaf"]] = np.minimum(known[0], low), np.maximum(known[1], high)
    boxes = {dims: (np.array(sorted(own)), np.array([own[leaf][0] for leaf in sorted(own)]), np.array([own[leaf][1] for leaf in sorted(own)])) for dims, own in boxes.items()}
    homes = asked.withColumnsRenamed({"leaf": "own_leaf", "part": "own_part"})
    for near in (True, False):
        order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"))
        kth = found.where("score IS NOT NULL").withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k)
        kth = kth.select(F.col("query_id").alias("vec_id"), "query", F.col("score").cast("double").alias("kth")).withColumn("kth", F.col("kth") - F.abs("kth") * 1e-12)
        bounded = homes.hint("merge").join(kth.hint("merge"), ["vec_id", "query"], "left").select("dims", "vec_id", "query", "q", "own_leaf", "own_part", "kth")
        visits = _visits(bounded, boxes, near).join(F.broadcast(parts), ["dims", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        visits = visits.where((F.col("leaf") != F.col("own_leaf")) | (F.col("part") != F.col("own_part")))
        visits = materialise(visits.select("vec_id", "query", "q", "kth", *group), "search-visits")
        more = base.select("vec_id", "q", *group).groupBy(*group).cogroup(visits.groupBy(*group)).applyInArrow(_searcher(k, False, leaf_rows), _RESULT)
        found = found.unionByName(materialise(more, "search-found"))
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    scores = found.where("score IS NOT NULL")
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    least, most = F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")
    return ranked.select("query_id", "rank", "vec_id", F.greatest(least, F.least(most, F.col("score"))).cast("long").alias("score"))


def op5_topk(spark, sf_dir):
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), 20, 20)


OP5_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
