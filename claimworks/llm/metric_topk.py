"""Exact top-k inner products by best-first search in paged metric trees (M-trees).

An inner product q.x is a distance once every vector has one more component that brings it to the
same length R: |(q,0) - (x, sqrt(R^2 - x.x))|^2 = q.q + R^2 - 2 q.x. So the largest products are
the nearest vectors, and the triangle inequality holds.

Index: routing objects are a bounded sample of `routes` vectors (the smallest hashes of the id);
every vector goes to its nearest one, and a route with more than `page_rows` vectors is divided
into pages. A page is a tree in one row: leaves of `leaf_rows` vectors around a centre, with the
centre's covering radius, its distance from the page's centre (the parent), and each vector's
distance from the leaf's centre.

Search: each query first visits its nearest page, which gives a distance that k vectors already
reach. Then it visits those other pages whose covering radius lets them hold a nearer vector. In
a page it takes the leaves best first; a leaf whose stored parent distance alone excludes it has
its own distance never computed, and vectors are excluded in the same way before their products
are computed. Pages and queries meet by page in blocks of queries.

Equal vectors are stored once, with their k + 1 smallest ids: no more can be in one answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimworks.llm import _store, _text

EPS = 1e-6


def _lift(x: np.ndarray, radius2: float) -> np.ndarray:
    """The vectors with the component that brings them to one length."""
    rest = np.sqrt(np.maximum(radius2 - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, rest])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of a and rows of b."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


class Page:
    """A tree of two levels over the vectors of a page."""

    def __init__(self, x: np.ndarray, radius2: float, leaf_rows: int):
        self.x, self.radius2 = x, radius2
        lifted = _lift(x.astype(np.float64), radius2)
        self.center = lifted.mean(axis=0)
        n = max(1, -(-len(x) // leaf_rows))
        seeds = lifted[np.linspace(0, len(x) - 1, n).astype(int)]
        leaf = np.concatenate([_far(lifted[a : a + 4096], seeds).argmin(axis=1) for a in range(0, len(x), 4096)])
        order = np.argsort(leaf, kind="stable")
        bounds = np.flatnonzero(np.append(True, np.diff(leaf[order]) != 0))
        self.leaves = np.split(order, bounds[1:])
        self.centers = np.array([lifted[i].mean(axis=0) for i in self.leaves])
        self.to_leaf = [_far(lifted[i], c[None])[:, 0] for i, c in zip(self.leaves, self.centers, strict=True)]
        self.radii = np.array([d.max() for d in self.to_leaf])
        self.to_parent = _far(self.centers, self.center[None])[:, 0]
        self.radius = float((self.to_parent + self.radii).max())

    def search(self, q: np.ndarray, least: float, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and products of the vectors that can be among the `keep` largest products, of
        which `least` is already reached. All ties with the last one are among them."""
        point = np.append(q.astype(np.float64), 0.0)
        size = float(point @ point) + self.radius2
        limit = lambda score: np.sqrt(max(size - 2.0 * score, 0.0)) + EPS * (1 + size**0.5) if score > -np.inf else np.inf
        near = limit(least)
        from_parent = float(np.linalg.norm(point - self.center))
        bound = np.abs(from_parent - self.to_parent) - self.radii
        at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)  # whole numbers, exact below 2^63
        todo = np.flatnonzero(bound <= near)
        exact = np.linalg.norm(self.centers[todo] - point, axis=1)
        lower = exact - self.radii[todo]
        for i in np.argsort(lower, kind="stable"):
            if lower[i] > near:
                break
            leaf = self.leaves[todo[i]]
            some = leaf[np.abs(exact[i] - self.to_leaf[todo[i]]) <= near]
            at, score = np.append(at, some), np.append(score, self.x[some] @ q)
            if len(score) >= keep:
                least = max(least, np.partition(score, -keep)[-keep])
                near = limit(least)
                stay = score >= least
                at, score = at[stay], score[stay]
        return at, score


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _assign(vectors: DataFrame, pivots: list[list[int]], radius2: float) -> DataFrame:
    """rep, x, and the nearest routing object."""

    def run(batches):
        routes = _lift(np.array(pivots, float), radius2)
        for batch in batches:
            if batch.num_rows:
                d = _far(_lift(_matrix(batch.column(1)).astype(np.float64), radius2), routes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32))], ["vec_id", "x", "route"])

    return vectors.mapInArrow(run, "vec_id long, x array<long>, route int")


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x: floor(scale * component), the component as double. Rows with a null vector, an
    empty one, or a component that is null or not finite are left out, and so are vectors whose
    squared length is 2^62 or more, as their products don't fit a score."""
    usable = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    length2 = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + F.pow(F.floor(v.cast("double") * scale).cast("double"), F.lit(2.0)))
    rows = rows.select("vec_id", "embedding").filter((F.size("embedding") > 0) & F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = rows.filter(length2 < 2.0**62)
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def top_k(rows: DataFrame, k: int = 5, every: int = 50, routes: int = 64, page_rows: int = 4096, leaf_rows: int = 64, block_rows: int = 512) -> DataFrame:
    """rows(vec_id, embedding) -> query_id, rank (from 1), vec_id, score.

    Queries are rows whose vec_id is divisible by `every`; candidates are all rows but the query's
    own id; the score is the inner product of integers(rows); ties go to the smaller vec_id. All
    candidates are returned if there are fewer than k. Unusable vectors (see integers) take no
    part. Vectors of different length are not compared: each length has its own search. A vec_id on
    several rows counts once, with one of its vectors (the smallest). Empty tables give no rows.
    """
    found = integers(rows).withColumn("dims", F.size("x"))
    found = _store.table(found.groupBy("vec_id").agg(F.min(F.struct("dims", "x")).alias("v")).select("vec_id", "v.*"), "vectors")
    shapes = [r["dims"] for r in found.select("dims").distinct().collect()]  # a number for each length of vectors
    parts = [_top_k(found.filter(F.col("dims") == d).drop("dims"), d, k, every, routes, page_rows, leaf_rows, block_rows) for d in sorted(shapes)]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _top_k(vectors: DataFrame, dims: int, k: int, every: int, routes: int, page_rows: int, leaf_rows: int, block_rows: int) -> DataFrame:
    spark = vectors.sparkSession
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)
    radius2 = float(vectors.agg(F.max(norm)).first()[0])
    # Equal vectors: the k + 1 smallest ids of each; the window's limit applies before the shuffle.
    smallest = vectors.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = _store.table(smallest.withColumn("rep", F.first("vec_id").over(Window.partitionBy("x").orderBy("vec_id"))), "members")
    distinct = members.filter("n = 1").select("vec_id", "x")
    pivots = [list(r["x"]) for r in distinct.orderBy(F.xxhash64("vec_id")).limit(routes).collect()]
    placed = _store.table(_assign(distinct, pivots, radius2), "placed")
    pages = placed.groupBy("route").agg(F.ceil(F.count("*") / page_rows).cast("int").alias("pages"))
    placed = placed.join(F.broadcast(pages), "route")  # a row for each route at most
    placed = placed.select("vec_id", "x", "route", F.pmod(F.xxhash64("vec_id"), F.col("pages")).cast("int").alias("page"))
    queries = vectors.filter(F.col("vec_id") % every == 0)

    def describe(key, table):
        page = Page(_matrix(table["x"]), radius2, leaf_rows)
        return pa.table({"route": pa.array([key[0].as_py()], pa.int32()), "page": pa.array([key[1].as_py()], pa.int32()), "center": pa.array([page.center.tolist()]), "radius": [page.radius]})

    directory = _store.table(placed.groupBy("route", "page").applyInArrow(describe, "route int, page int, center array<double>, radius double"), "directory")
    blocks = F.floor(F.xxhash64("center") % 16).cast("int")
    nodes = directory.withColumn("block", blocks).groupBy("block").agg(F.collect_list(F.struct("route", "page", "center", "radius")).alias("nodes"))  # a struct a page, page_rows vectors each

    def visits(batches):
        """Per query and page: a lower bound of the distance to what the page holds."""
        for batch in batches:
            x = np.column_stack([_matrix(batch.column(1)), np.zeros(batch.num_rows)])
            for r in range(batch.num_rows):
                node = batch.column(2)[r].as_py()
                d = _far(x[r : r + 1], np.array([m["center"] for m in node]))[0] - np.array([m["radius"] for m in node])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[r].as_py()] * len(node), pa.int64()), pa.array([m["route"] for m in node], pa.int32()), pa.array([m["page"] for m in node], pa.int32()), pa.array(d)], ["vec_id", "route", "page", "bound"])

    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(-15), F.lit(15))))
    bounds = _store.table(asked.join(nodes, "block").select("vec_id", "x", "nodes").mapInArrow(visits, "vec_id long, route int, page int, bound double"), "bounds")
    first = bounds.groupBy("vec_id").agg(F.min(F.struct("bound", "route", "page")).alias("b")).select("vec_id", "b.route", "b.page")

    def search(jobs: DataFrame) -> DataFrame:
        """jobs(vec_id, route, page, least) -> vec_id, rep, score of the products that may count."""
        jobs = jobs.join(queries.withColumnRenamed("x", "q"), "vec_id").select(F.col("route").alias("r"), F.col("page").alias("p"), F.pmod(F.xxhash64("vec_id"), F.lit(block_rows)).cast("int").alias("block"), F.col("vec_id").alias("query"), "q", "least")
        size = jobs.groupBy("r", "p").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        jobs = jobs.join(size, ["r", "p"]).withColumn("block", F.pmod("block", "blocks"))
        wanted = jobs.select(F.col("r").alias("route"), F.col("p").alias("page"), F.col("block").alias("for_block")).distinct()
        there = placed.join(wanted, ["route", "page"])

        def run(page_table, query_table):
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            if page_table.num_rows and query_table.num_rows:
                page, ids = Page(_matrix(page_table["x"]), radius2, leaf_rows), page_table["vec_id"].to_numpy()
                for q, x, least in zip(query_table["query"].to_pylist(), _matrix(query_table["q"]), query_table["least"].to_pylist(), strict=True):
                    at, score = page.search(x, -np.inf if least is None else least, k + 1)
                    out.append((np.full(len(at), q), ids[at], score))
            q, rep, score = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.table({"query_id": q, "rep": rep, "score": score})

        return there.groupBy("route", "page", "for_block").cogroup(jobs.groupBy("r", "p", "block")).applyInArrow(run, "query_id long, rep long, score long")

    def best(found: DataFrame) -> DataFrame:
        """The k best vectors of each query, ids of equal vectors and ties in order."""
        ids = members.select("rep", "vec_id")
        pairs = found.join(ids, "rep").filter("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)

    start = _store.table(best(search(first.withColumn("least", F.lit(None).cast("double")))), "first")
    reached = start.groupBy("query_id").agg(F.min("score").cast("double").alias("s"), F.count("*").alias("n"))
    reached = reached.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("s")).alias("least"))
    length2 = queries.select("vec_id", (norm + F.lit(radius2)).alias("size"))
    more = bounds.join(first.withColumn("done", F.lit(True)), ["vec_id", "route", "page"], "left").filter("done is null")
    more = more.join(reached, "vec_id", "left").join(length2, "vec_id")
    near = F.sqrt(F.greatest(F.col("size") - 2 * F.col("least"), F.lit(0.0))) + EPS * (1 + F.sqrt("size"))
    more = more.filter(F.col("least").isNull() | (F.col("bound") <= near)).select("vec_id", "route", "page", "least")
    return best(start.select("query_id", F.col("vec_id").alias("rep"), "score").join(members.select(F.col("vec_id").alias("rep"), F.col("rep").alias("of")), "rep").select("query_id", F.col("of").alias("rep"), "score").union(search(more))).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for top_k over the embeddings table.
ORACLE_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
