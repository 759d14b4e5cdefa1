"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, and only those,
whatever the length of the text. So sketches merge by union and intersect like the texts themselves,
however unequal the lengths. A share estimated from a text of n distinct shingles has a standard
error of about sqrt(p (1 - p) / (n * fraction)): 0.04 for 1,000 shingles, 0.13 for 100. A short text
may have no hash below the fraction; its share then is 1 if the other's sketch is empty too, else 0.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from claimworks.llm import _text

_U = np.uint64
FRACTION = 1 / 8
RANGE_CHARS = 8 << 20  # characters of text to a range of ids, about
MOST_RANGES = 20_000  # bounds the cuts on the driver and the broadcast heads of ranges
WIDTH = 8  # characters in a shingle


class Sketch:
    """The hashes below `limit` (all of them), sorted."""

    def __init__(self, limit: int, hashes: np.ndarray):
        self.limit, self.hashes = limit, hashes

    @classmethod
    def of(cls, text: str, fraction: float = FRACTION, width: int = WIDTH) -> Sketch:
        """A text shorter than a shingle is one shingle; an empty one has none."""
        limit = int(2**64 * fraction)
        c = np.frombuffer(text.encode("utf-32-le"), "<u4")
        width = min(width, len(c))
        if not width:
            return cls(limit, np.zeros(0, _U))
        up, down = _text.powers(len(c) + 1)
        s = _text.sums((c.astype(_U) + _U(1)) * up[: len(c)])
        h = _text.mix((s[width:] - s[:-width]) * down[: len(c) - width + 1] + _U(width))
        return cls(limit, np.unique(h[h < _U(limit)] if limit < 2**64 else h))

    def text(self) -> str:
        return f"{self.limit:016x}.{base64.b64encode(self.hashes.astype('<u8').tobytes()).decode()}"

    @classmethod
    def read(cls, text: str) -> Sketch:
        limit, _, body = text.partition(".")
        return cls(int(limit, 16), np.frombuffer(base64.b64decode(body), "<u8"))

    def below(self, limit: int) -> np.ndarray:
        return self.hashes if limit >= self.limit else self.hashes[: np.searchsorted(self.hashes, _U(limit))]

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts' shingles together; of the smaller fraction, if they differ."""
        limit = min(self.limit, other.limit)
        return Sketch(limit, np.union1d(self.below(limit), other.below(limit)))

    def containment(self, other: Sketch) -> float:
        """The share of this text's shingles that the other has. Without a hash of this text below
        both limits, 1 if the other has none either, else 0."""
        limit = min(self.limit, other.limit)
        a, b = self.below(limit), other.below(limit)
        if not len(a):
            return float(not len(b))
        return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def edited(text: str, following: str) -> str:
    """text with its last third (whole part) replaced by as many first characters of `following`."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _ranges(keys: DataFrame, ranges: int) -> list[int]:
    cuts = keys.agg(F.percentile_approx("o", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    return sorted(set(cuts or []))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row per row of docs.

    The next document is the one with the next smaller doc_id, after the smallest the largest one;
    a null id comes last, rows with equal ids follow in the order of their texts (null: empty), a
    single row is next to itself. near_* is the share of the document's shingles (8 characters)
    that the other text has, estimated from the fingerprints.

    Rows are dealt into ranges of ids, each with one more row, the first of the range after it, so
    every document meets its next one in a single shuffle. ranges is the number of groups
    (default: one for about RANGE_CHARS characters, MOST_RANGES at most: a range is read as a stream,
    so a larger one takes longer but no more memory); only their bounds pass through the driver.
    Repeated rows have a row each; an empty table gives none; other columns are ignored.
    """
    if ranges is None:
        ranges = min(MOST_RANGES, max(2, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // RANGE_CHARS)))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("o"))
    cuts = np.array(_ranges(rows.select("o"), ranges), np.int64)

    @pandas_udf("int")
    def range_of(o):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, o.to_numpy(np.int64), side="right").astype(np.int32))

    rows = rows.withColumn("r", range_of("o"))
    heads = rows.groupBy("r").agg(F.max("o").alias("head"))  # a row a range
    order = Window.orderBy(F.desc("r"))
    heads = heads.withColumn("next", F.coalesce(F.lead("head").over(order), F.first("head").over(order))).select("r", "next")
    heads = F.broadcast(heads.withColumnRenamed("next", "o"))
    ends = rows.select("o", "text").join(heads, "o").groupBy("r", "o").agg(F.min("text").alias("text"))
    ends = ends.select(F.lit(None).cast("long").alias("doc_id"), "text", "o", "r", F.lit(True).alias("end"))
    dealt = rows.withColumn("end", F.lit(False)).unionByName(ends).repartition(ranges, "r")
    dealt = dealt.sortWithinPartitions("r", "end", F.desc("o"), "text")

    def run(batches):
        last = None
        out = []

        def flush():
            ids, n, sha, a, b, x, y = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(a), pa.array(b), pa.array(x, pa.float64()), pa.array(y, pa.float64())], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for doc, text, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sketch = Sketch.of(text)
                if last is not None:
                    before, old, mine = last
                    new = edited(old, text)
                    other = Sketch.of(new)
                    out.append((before, len(old), hashlib.sha256(new.encode()).hexdigest(), mine.text(), other.text(), mine.containment(other), mine.containment(sketch)))
                last = None if end else (doc, text, sketch)
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    return dealt.select("doc_id", "text", "end").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
