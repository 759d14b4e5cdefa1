"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash of their id. A document's virtual finish time is
the cumulative words of its source, itself included, divided by the source's target. Ordering all
documents by that time interleaves the sources in proportion to their targets, and every source
reaches its target at time 1, where the words taken add up to the total budget: truncating the
ordered stream at the budget is truncating it at time 1. A source whose target exceeds its size
starts a second round of the same documents.

The running total of a source is built from 4,096 hash ranges per source: totals of the ranges
first, then a window within one range, so that a source with a third of all rows is spread over
4,096 groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.llm import _store

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
HEX = 3  # hex digits of the hash that name a range


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, source_size), one row a source -> also target.

    Sources in code point order, null last, take `weights` in turn and divide share * all sizes
    among them; no target is above cap * the source's size, and what is above goes to the others
    by weight. In order of cap / weight the capped sources are a prefix, so the level of the rest
    is found with running sums over the few source rows. No sources give no rows.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    rows = rows.withColumn("level", (F.col("budget") - F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most")) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = F.col("level") >= F.col("most") / F.col("w")
    level = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(everything)
    return rows.select("source", "source_size", F.least(F.col("most"), F.coalesce(level * F.col("w"), F.col("most"))).alias("target"))


def schedule(docs: DataFrame, seed: str = "", size: Column | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) -> its columns and, as a struct `mix`: size, source_size,
    target, before (words of the source ahead of it), taken, virtual_finish.

    taken counts words over both rounds and is at most 2 * size; per source it adds up to the
    whole part of the target. A null text has size 0; null sources are one source; equal ids and
    sizes are interchangeable, so reruns agree. An empty table gives no rows.
    """
    size = words(F.col("text")) if size is None else size
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # joins by plain equality
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)))
    rows = docs.select(F.struct("*").alias("doc"), name.alias("k"), "doc_id", size.alias("size"), key.alias("h"), F.substring(key, 1, HEX).alias("range"))
    slim = docs.select("source", size.alias("size"), F.substring(key, 1, HEX).alias("range"))
    totals = _store.table(slim.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "ranges")
    goal = targets(totals.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    ahead = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")
    ranges = totals.withColumn("ahead", ahead).alias("t").join(goal.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source")))
    ranges = ranges.select(F.when(F.col("t.source").isNull(), "").otherwise(F.concat(F.lit("="), "t.source")).alias("k"), "range", "ahead", "source_size", "target")
    inside = Window.partitionBy("k", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(ranges, ["k", "range"], "left")
    before, whole = F.col("ahead") + F.col("inside"), F.floor("target")
    part = lambda start: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - start))
    taken = part(before) + part(before + F.col("source_size"))
    finish = F.when(F.col("target") > 0, (before + F.col("size")) / F.col("target"))
    return rows.select("doc", F.struct("size", "source_size", "target", before.alias("before"), taken.alias("taken"), finish.alias("virtual_finish")).alias("mix"))


def mix(docs: DataFrame, seed: str = "") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, virtual_finish, sorted over
    all by virtual finish time. What lies behind the total budget has taken 0."""
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    out = schedule(slim, seed, F.col("size"))
    out = out.select("doc.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.virtual_finish")
    return out.orderBy(F.col("virtual_finish").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, seed: str = "") -> DataFrame:
    """The mix itself, with the columns of docs: a document comes once for each round it is taken
    in. Where a source's target ends inside a document, that copy is its first words, joined by
    spaces. Documents of which no word is taken are left out. Sorted by virtual finish time."""
    rows = schedule(docs, seed).filter("mix.taken > 0")
    first = F.least(F.col("mix.taken"), F.col("mix.size"))
    takes = F.filter(F.array(first, F.col("mix.taken") - first), lambda n: n > 0)
    rows = rows.select("doc", "mix", F.posexplode(takes).alias("round", "take"))
    text = F.when(F.col("take") >= F.col("mix.size"), F.col("doc.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(f"({WORD})"), F.lit(1)), 1, F.col("take").cast("int")), " "))
    finish = (F.col("mix.before") + F.col("mix.size") + F.col("round") * F.col("mix.source_size")) / F.col("mix.target")
    columns = [text.alias(c) if c == "text" else (F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c)) for c in docs.columns]
    return rows.withColumn("finish", finish).orderBy("finish", F.col("doc.doc_id")).select(*columns)


#: DuckDB SQL for mix() over the documents table.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
b AS (SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
l AS (SELECT *, (budget - sum(most) OVER (ORDER BY most / w, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING) + most)
      / sum(w) OVER (ORDER BY most / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
      row_number() OVER (ORDER BY most / w, encode(source) NULLS LAST) AS n FROM b),
v AS (SELECT arg_min(level, n) FILTER (WHERE level < most / w) AS lv FROM l),
t AS (SELECT source, source_size, least(most, coalesce(lv * w, most)) AS target FROM l, v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - before - source_size)) AS BIGINT) AS taken,
  CASE WHEN target > 0 THEN CAST(before + size AS DOUBLE) / target END AS virtual_finish
FROM c
"""
