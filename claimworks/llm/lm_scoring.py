"""Stupid-backoff scores of documents under the n-gram counts of all documents.

    S(w | u v) = c(u v w) / c(u v)     if c(u v w) >= min_count
               = alpha * S(w | v)      otherwise, and so on down to S(w) = c(w) / N

A document's score is the sum of log S over its words; a word with fewer words before it starts at
the longest n-gram that it has. Counts are over all documents, for n-grams of any order. They are
those of hashes: about one n-gram in a million shares its hash and carries another's count too
(SPARE_BITS; whole 64-bit hashes took 4.14 x the input on disk, beyond the limit of 4).

- Documents are dealt into chunks of about `chunk_bytes` of text. A chunk keeps its words in order,
  as places in a list of its distinct word hashes, so the texts are read once.
- A chunk explodes its distinct n-grams, with how often it holds each, into the parts of the count
  tables, by ranges of the n-gram's hash (64 bits, fewer for a small corpus). The row of a chunk and a part holds its n-grams as
  a sorted, packed array. However common an n-gram is, a chunk sends it once: no key is hot.
- A part adds up its count table and joins it to the rows that it got: each chunk gets the counts
  of its n-grams back, in order.
- The chunk's words meet the counts of all orders and are summed per document.

Nothing is broadcast. Chunks, parts and rows are bounded in size; their number grows with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.llm import _store, _text

_U = np.uint64
SPARE_BITS = 20  # an n-gram shares its hash with another once in a million times, as long as 64 bits suffice


def _packed(values: np.ndarray) -> bytes:
    """An array of 64-bit numbers, its bytes in order of significance, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pieces(batches, most: int):
    """(doc ids, word hashes, first word of each row) of consecutive rows of about `most` bytes."""
    held, size = [], 0
    for batch in _text.released(batches):
        for i, j, data, offsets in _text.chunks(batch.column(1), min(most, 4 << 20)):
            words = _text.Words(data, offsets)
            held.append((batch.column(0).slice(i, j - i), words.hash(), np.diff(words.first)))
            size += len(data)
            if size >= most:
                yield held, size
                held, size = [], 0
    if held:
        yield held, size


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs(doc_id, text) -> chunk, docs (ids), lengths (words of each), words (distinct hashes),
    places (of each word among them), n_words, n_bytes."""

    def run(batches):
        import uuid

        for held, size in _pieces(batches, chunk_bytes):
            h = np.concatenate([x for _, x, _ in held])
            words, places, n = np.unique(h, return_inverse=True, return_counts=True)
            common = np.argsort(-n, kind="stable")  # common words have low places, which pack well
            words, places = words[common], np.argsort(common)[places]
            ids = pa.chunked_array([x for x, _, _ in held]).combine_chunks()
            lengths = np.concatenate([x for _, _, x in held])
            columns = [pa.array([uuid.uuid4().hex]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()), pa.array([_packed(places.astype(_U))], pa.binary()), pa.array([len(h)]), pa.array([size])]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "docs", "lengths", "words", "places", "n_words", "n_bytes"])

    return docs.mapInArrow(run, "chunk string, docs array<long>, lengths array<long>, words binary, places binary, n_words long, n_bytes long")


def _grams(words: bytes, places: bytes, lengths, order: int, bits: int):
    """For each n up to the order: the hashes of the n-grams, of so many bits, and where they end;
    only n-grams within one document."""
    h = np.frombuffer(words, _U)[_unpacked(places).astype(np.int64)]
    n = np.asarray(lengths, np.int64)
    at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)  # place of a word in its document
    gram = h
    for k in range(1, order + 1):
        if k > 1:
            gram = np.concatenate([np.zeros(1, _U), _text.mix(gram[:-1] * _U(0xD1342543DE82EF95) + h[1:] + _U(k))])[: len(h)]
        ends = np.flatnonzero(at >= k - 1)
        yield k, gram[ends] >> _U(64 - bits), ends


def _requests(order: int, parts: int, bits: int):
    """The rows of each chunk and part: order, the sorted n-grams and how often the chunk has them."""

    def run(batches):
        for batch in _text.released(batches):
            for chunk, lengths, words, places in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lengths", "words", "places")), strict=True):
                for k, gram, _ in _grams(words, places, lengths, order, bits):
                    gram, n = np.unique(gram, return_counts=True)
                    part = ((gram >> _U(bits - 32)) * _U(parts)) >> _U(32)
                    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                    end = np.append(cut[1:], len(part))[: len(cut)]
                    columns = [pa.array(part[cut].astype(np.int64)), pa.array([chunk] * len(cut), pa.string()), pa.array(np.full(len(cut), k, np.int32))]
                    columns += [pa.array([_packed(np.diff(gram[a:b], prepend=_U(0))) for a, b in zip(cut, end, strict=True)], pa.binary()), pa.array([_packed(n[a:b].astype(_U)) for a, b in zip(cut, end, strict=True)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "n", "grams", "times"])

    return run


def _answers(table: pa.Table) -> pa.Table:
    """The count table of a part joined to the rows that it came from: their n-grams' counts. The
    order is in the hash, so n-grams of all orders share a table."""
    grams = [np.cumsum(_unpacked(x)) for x in table["grams"].to_pylist()]
    times = [_unpacked(x) for x in table["times"].to_pylist()]
    everything = np.concatenate(grams)
    order = np.argsort(everything, kind="stable")
    ranked = everything[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    counts = np.add.reduceat(np.concatenate(times)[order], first)
    found = np.empty(len(everything), _U)
    found[order] = np.repeat(counts, np.diff(np.append(first, len(ranked))))
    cuts = np.cumsum([len(x) for x in grams])[:-1]
    return pa.table({"chunk": table["chunk"], "n": table["n"], "part": table["part"], "counts": pa.array([_packed(x) for x in np.split(found, cuts)], pa.binary())})


def _scores(order: int, total: int, alpha: float, min_count: int, bits: int):
    def run(chunk, answers):
        """doc_id, n_words, n_seen, log_score of a chunk's documents."""
        doc, n_words, n_seen, log_score = [], [], [], []
        got = answers.sort_by([("n", "ascending"), ("part", "ascending")]) if answers.num_rows else answers
        which = got["n"].to_numpy()
        for ids, lengths, words, places in zip(*(chunk[c].to_pylist() for c in ("docs", "lengths", "words", "places")), strict=True):
            n = np.asarray(lengths, np.int64)
            counts = []  # for each order the count of the n-gram that ends at each word; 0 where there is none
            for k, gram, ends in _grams(words, places, lengths, order, bits):
                c = np.zeros(int(n.sum()))
                if len(gram):
                    _, at = np.unique(gram, return_inverse=True)
                    c[ends] = np.concatenate([_unpacked(x) for x in got["counts"].filter(pa.array(which == k)).to_pylist()])[at]
                counts.append(c)
            score, open_, penalty, top = np.zeros(int(n.sum())), np.ones(int(n.sum()), bool), np.zeros(int(n.sum())), np.zeros(int(n.sum()), bool)
            for k in range(order, 1, -1):
                seen = open_ & (counts[k - 1] >= min_count)
                at = np.flatnonzero(seen)
                score[at] = penalty[at] + np.log(counts[k - 1][at]) - np.log(counts[k - 2][at - 1])
                open_ &= ~seen
                penalty[open_ & (counts[k - 1] > 0)] += math.log(alpha)
                if k == order:
                    top = seen
            score[open_] = penalty[open_] + np.log(counts[0][open_]) - math.log(max(total, 1))
            row = np.repeat(np.arange(len(n)), n)
            doc += ids
            n_words.append(n)
            n_seen.append(np.bincount(row[top], minlength=len(n)))
            log_score.append(np.bincount(row, score, len(n)))
        none = [np.zeros(0, np.int64)]
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "n_words": np.concatenate(none + n_words), "n_seen": np.concatenate(none + n_seen), "log_score": np.concatenate([np.zeros(0), *log_score])})

    return run


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, chunk_bytes: int = 8 << 20, part_bytes: int = 8 << 20) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_seen (words scored by an n-gram of the full order),
    log_score.

    Words are runs outside white space, A-Z lower-cased. n-grams that occur fewer than min_count
    times back off, so a document isn't scored by what it alone holds. A null or empty text has
    n_words 0 and log_score 0. Copies of a document count as often as they occur. Rows that share an
    id, or have a null id, are summed into one row for that id. Other columns are ignored. An empty
    table gives no rows. chunk_bytes and part_bytes, bytes of text to a chunk and to a part of the
    count tables, change no result.
    """
    chunks = _store.table(chunked(docs.select(F.col("doc_id").cast("long"), "text"), chunk_bytes), "chunks")
    size = chunks.agg(F.sum("n_words").alias("words"), F.sum("n_bytes").alias("bytes")).first()
    parts = max(1, -(-(size["bytes"] or 0) // part_bytes))
    bits = min(64, max(32, (order * (size["words"] or 1)).bit_length() + SPARE_BITS))
    requests = chunks.select("chunk", "lengths", "words", "places").mapInArrow(_requests(order, parts, bits), "part long, chunk string, n int, grams binary, times binary")
    answers = requests.groupBy("part").applyInArrow(_answers, "chunk string, n int, part long, counts binary")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(order, size["words"] or 0, alpha, min_count, bits), "doc_id long, n_words long, n_seen long, log_score double")
    return scored.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_seen").alias("n_seen"), F.round(F.sum("log_score"), 5).alias("log_score"))


#: DuckDB SQL for stupid_backoff over the documents table.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
p AS (SELECT doc_id, t[i] AS w, CASE WHEN i > 1 THEN t[i - 1] END AS v, CASE WHEN i > 2 THEN t[i - 2] END AS u FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d)),
one AS (SELECT w, count(*) AS n FROM p GROUP BY w),
two AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w),
k AS (SELECT count(*)::DOUBLE AS n FROM p),
s AS (SELECT p.doc_id, CASE WHEN three.n >= 2 THEN ln(three.n::DOUBLE / uv.n) WHEN vw.n >= 2 THEN CASE WHEN p.u IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + ln(vw.n::DOUBLE / ov.n)
      ELSE CASE WHEN p.v IS NULL THEN 0 WHEN p.u IS NULL THEN ln(0.4::DOUBLE) ELSE 2 * ln(0.4::DOUBLE) END + ln(ow.n / k.n) END AS x, CASE WHEN three.n >= 2 THEN 1 ELSE 0 END AS seen
      FROM p JOIN one ow ON ow.w = p.w LEFT JOIN one ov ON ov.w = p.v LEFT JOIN two vw ON vw.v = p.v AND vw.w = p.w LEFT JOIN two uv ON uv.v = p.u AND uv.w = p.v
      LEFT JOIN three ON three.u = p.u AND three.v = p.v AND three.w = p.w, k),
a AS (SELECT doc_id, count(*) AS n_words, sum(seen) AS n_seen, sum(x) AS log_score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_seen, 0)::BIGINT AS n_seen, round(coalesce(log_score, 0), 5) AS log_score
FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN a USING (doc_id)
"""
