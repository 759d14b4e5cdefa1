"""Hard negatives of anchors and their positives, by slot-decomposed selection.

An anchor's positives allow windows of negative scores that overlap. Their distinct upper limits cut
the scores into disjoint slots: slot j holds what lies at or below the j-th limit and above the next.
Each block of rows keeps the k best of every slot of an anchor, and so does the merge of blocks. As a
window reaches from its own limit downwards, its k best are among the k best of its slot and all
following ones: merges from the last slot to the first give the answers of all windows, of which the
lower limits then cut the ends off.

Anchors are a stated query set; they meet the rows in blocks of both. Positives are looked for among
rows of the anchor's label only, a label with many rows in as many blocks as it takes. Neither side
is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.llm import _store

#: Anchors whose products with a block of rows are held at a time.
_TILE = 256
#: Blocks that small tables are cut into, if each has LEAST_BLOCK rows.
_SPREAD, LEAST_BLOCK = 256, 512
_LONG = 2**63 - 1


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    values = column.combine_chunks().flatten() if column.num_chunks else pa.array([], pa.int64())
    return values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as whole numbers: exact, and held at the limits of a long beyond it."""
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -_LONG, _LONG).astype(np.int64)


def vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, dims, x: floor(scale * component), the component as double, held at the limits of
    a long. Rows with a null id, label or vector, or with a component that is null or not finite, are
    left out. An id on several rows counts once, with the smallest label and vector."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(2.0**63)), F.lit(-(2.0**63)))).cast("long"))
    rows = rows.select("vec_id", "label", "embedding").filter("vec_id is not null and label is not null and embedding is not null").filter(finite)
    rows = rows.select(F.col("vec_id").cast("long"), F.struct("label", F.size("embedding").alias("dims"), whole.alias("x")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.*")


def _block(n: Column) -> Column:
    """A block below n for each row, the same in every run."""
    return F.pmod(F.xxhash64("vec_id"), n).cast("int")


def _renamed(side: DataFrame) -> DataFrame:
    """The same columns under names of their own, for the other side of a cogroup."""
    return side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns])


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _first_of(part: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each part: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, part))
    part = part[order]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    rank = np.arange(len(part)) - np.repeat(begin, np.diff(np.append(begin, len(part))))
    return order[rank < k]


def positives(rows: DataFrame, anchors: DataFrame, n: int, block_rows: int) -> DataFrame:
    """anchor_id, vec_id, score, rank: the n best other rows of the anchor's label."""

    def run(key, table: pa.Table, asked: pa.Table) -> pa.Table:
        dims, out = key[0].as_py(), []
        x, ids = _matrix(table["x"], dims), table["vec_id"].to_numpy()
        q, of = _matrix(asked["a_x"], dims), asked["a_vec_id"].to_numpy()
        for i in range(0, len(of), _TILE):
            score = products(q[i : i + _TILE], x)
            if score.shape[1] > n + 1:  # the anchor itself may be among them
                least = np.partition(score, -(n + 1), axis=1)[:, -(n + 1)]
                a, r = np.nonzero(score >= least[:, None])
            else:
                a, r = (g.ravel() for g in np.indices(score.shape))
            other = ids[r] != of[i + a]
            a, r = a[other], r[other]
            some = _first_of(a, score[a, r], ids[r], n)
            out.append((of[i + a[some]], ids[r[some]], score[a[some], r[some]]))
        a, r, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"anchor_id": a, "vec_id": r, "score": s})

    # Labels with more rows than a block are cut; there are at most rows / block_rows of them.
    size = rows.groupBy("dims", "label").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    size = size.select("dims", "label", F.ceil(F.col("n") / block_rows).alias("blocks"))
    small = size.limit(100_001).count() <= 100_000
    size = F.broadcast(size) if small else size

    def cut(side: DataFrame) -> DataFrame:
        return side.join(size, ["dims", "label"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    # An anchor meets every block of its label; of a label with many blocks, each block's anchors come in turns too.
    turns = F.ceil(F.col("blocks") / F.lit(64))
    dealt = cut(rows).select("dims", "label", _block(F.col("blocks")).alias("block"), _every(turns).alias("turn"), "vec_id", "x")
    asked = cut(anchors).select("dims", "label", _every(F.col("blocks")).alias("block"), _block(turns).alias("turn"), "vec_id", "x")
    keys = ["dims", "label", "block", "turn"]
    found = dealt.groupBy(*keys).cogroup(_renamed(asked).groupBy(*[f"a_{c}" for c in keys])).applyInArrow(run, "anchor_id long, vec_id long, score long")
    return _best(found, ["anchor_id"], n)


def in_slots(rows: DataFrame, anchors: DataFrame, k: int, blocks: int, turns: int) -> DataFrame:
    """anchors(vec_id, label, dims, x, limits (upper, falling), least) -> anchor_id, slot, vec_id,
    score, rank: the k best rows of other labels in every slot, at or above least."""

    def run(key, table: pa.Table, asked: pa.Table) -> pa.Table:
        dims, out = key[0].as_py(), []
        x, ids = _matrix(table["x"], dims), table["vec_id"].to_numpy()
        q, of, least = _matrix(asked["a_x"], dims), asked["a_vec_id"].to_numpy(), asked["a_least"].to_numpy()
        sides = [table["label"].to_pylist(), asked["a_label"].to_pylist()]
        names = {v: i for i, v in enumerate({*sides[0], *sides[1]})}
        label, own = (np.array([names[v] for v in side], np.int64) for side in sides)
        limits = asked["a_limits"].to_pylist()
        for i in range(0, len(of), _TILE):
            score = products(q[i : i + _TILE], x)
            top = np.array([v[0] for v in limits[i : i + _TILE]], np.int64)
            a, r = np.nonzero((score <= top[:, None]) & (score >= least[i : i + _TILE, None]) & (own[i : i + _TILE, None] != label[None, :]))
            s = score[a, r]
            slot = np.zeros(len(a), np.int64)
            for j in range(1, max(map(len, limits[i : i + _TILE]))):
                limit = np.array([v[j] if j < len(v) else -_LONG - 1 for v in limits[i : i + _TILE]], np.int64)
                slot += (s <= limit[a]) & (limit[a] > -_LONG - 1)
            some = _first_of(a * (1 + slot.max(initial=0)) + slot, s, ids[r], k)
            out.append((of[i + a[some]], slot[some], ids[r[some]], s[some]))
        a, slot, r, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({"anchor_id": a, "slot": slot.astype(np.int32), "vec_id": r, "score": s})

    keys = ["dims", "block", "turn"]
    dealt = rows.select("dims", _block(F.lit(blocks)).alias("block"), _every(F.lit(turns)).alias("turn"), "vec_id", "label", "x")
    asked = anchors.select("dims", _every(F.lit(blocks)).alias("block"), _block(F.lit(turns)).alias("turn"), "vec_id", "label", "x", "limits", "least")
    found = dealt.groupBy(*keys).cogroup(_renamed(asked).groupBy(*[f"a_{c}" for c in keys])).applyInArrow(run, "anchor_id long, slot int, vec_id long, score long")
    return _best(found, ["anchor_id", "slot"], k)


def mine(rows: DataFrame, every: int = 100, n_positives: int = 5, k: int = 5, least: int = 80, most: int = 100, scale: int = 256, block_rows: int = 16_384) -> DataFrame:
    """rows(vec_id, label, embedding) -> anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by `every`. A row's score is its inner product with
    the anchor, in whole numbers (see vectors and products); higher scores come first, ties by smaller
    vec_id. An anchor's positives are its first n_positives other rows of the same label (all, if
    fewer); for each, the first k rows of other labels (all, if fewer) with least * positive_score <=
    100 * negative_score <= most * positive_score are returned. Vectors of different length are not
    compared. Rows that take no part and repeated ids: see vectors. Other columns are ignored. An
    empty table gives no rows, nor do anchors without positives or windows without rows.
    """
    rows = _store.table(vectors(rows, scale), "vectors")
    total = rows.count()
    anchors = rows.filter(F.col("vec_id") % every == 0)
    found = _store.table(positives(rows, anchors, n_positives, min(block_rows, 2_048)), "positives")

    # Whole-number limits of each window; the distinct upper ones begin the slots.
    upper, lower = F.expr(f"floor(decimal({most}) * score / 100)").cast("long"), F.expr(f"ceil(decimal({least}) * score / 100)").cast("long")
    pairs = found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), upper.alias("upper"), lower.alias("lower"))
    windows = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least"), F.collect_list(F.struct("positive_id", "positive_score", "upper", "lower")).alias("positives"))  # at most n_positives
    windows = _store.table(windows, "windows")
    asked = anchors.join(windows.select(F.col("anchor_id").alias("vec_id"), "limits", "least"), "vec_id")
    blocks = max(-(-total // block_rows), min(_SPREAD, -(-total // LEAST_BLOCK)), 1)
    turns = max(1, -(-total // (every * block_rows)))
    kept = in_slots(rows, asked, k, blocks, turns)

    entry = F.struct(F.col("slot"), (-F.col("score")).alias("minus"), F.col("vec_id"))
    kept = kept.groupBy("anchor_id").agg(F.collect_list(entry).alias("kept")).join(windows, "anchor_id")  # at most n_positives * k
    of_slot = lambda j: F.transform(F.filter("kept", lambda e: e["slot"] == j), lambda e: F.struct(e["minus"].alias("minus"), e["vec_id"].alias("vec_id")))
    none = F.array().cast("array<struct<minus:bigint,vec_id:bigint>>")
    merged = F.aggregate(  # from the last slot to the first: what each has, merged with the ones below
        F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1)),
        F.array().cast("array<array<struct<minus:bigint,vec_id:bigint>>>"),
        lambda done, j: F.concat(F.array(F.slice(F.array_sort(F.concat(of_slot(j), F.coalesce(F.try_element_at(done, F.lit(1)), none))), 1, k)), done),
    )
    each = kept.withColumn("merged", merged).select("anchor_id", "limits", "merged", F.explode("positives").alias("p"))
    answer = F.filter(F.element_at("merged", F.array_position("limits", F.col("p.upper")).cast("int")), lambda e: -e["minus"] >= F.col("p.lower"))
    each = each.select("anchor_id", "p.*", F.posexplode(answer).alias("at", "e"))
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("negative_id"), "positive_score", (-F.col("e.minus")).alias("negative_score"))


#: DuckDB SQL for the query over the embeddings table.
ORACLE_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5
"""
