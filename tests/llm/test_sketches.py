"""Fingerprints of repeated, null and lone ids, in any number of ranges."""

import hashlib
import random

import pytest

from claimworks.llm import fingerprints


@pytest.mark.parametrize("ranges", [None, 2, 7])
def test_repeated_and_null_ids(spark, ranges):
    r = random.Random(1)
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60)))
    rows = [(i % 23, text()) for i in range(60)] + [(None, text()) for _ in range(5)] + [(None, None), (40, ""), (40, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as o", "2 as r", "true as end")
    got = fingerprints.fingerprints(docs, ranges).collect()
    order = sorted(((-i if i is not None else 1 << 70, t or "") for i, t in rows))
    due = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        due.append((i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    assert sorted((-x["doc_id"] if x["doc_id"] is not None else 1 << 70, x["n_chars"], x["edited_sha256"]) for x in got) == sorted(due)
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in got)


def test_one_row(spark):
    docs = spark.createDataFrame([(3, "the only text of this table")], "doc_id long, text string")
    (x,) = fingerprints.fingerprints(docs).collect()
    assert x["near_next"] == 1.0 and x["n_chars"] == 27
