"""Language identification by n-gram filters whose slots are bitmasks of languages.

Learning counts byte 4-grams of letters (A-Z lower-cased, with word borders) per language over all
labelled rows. An n-gram belongs to every language in which its relative frequency is at least
`near` of its highest. The filter is a bit-sliced Bloom filter: a mask of one or more 64-bit words per
slot, with a bit for each language; the AND of an n-gram's slots is the set of languages that contain it. A text's count
for a language is the popcount of that bit over its n-grams, corrected for the share that false
positives add: (hits - fp * n) / (1 - fp), with fp from the language's own bit density.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimworks.llm import _store, _text

_U = np.uint64
SLOTS = 1 << 20  # bounds what is broadcast: 8 MB for each 64 languages
HASHES = 4

_CLASS = np.zeros(256, np.uint8)  # a letter's byte, or 0x20
_CLASS[:] = 0x20
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams as numbers and the row of each. Inner bytes are letters; texts don't run together."""
    b = np.full(len(data) + 2 * (len(offsets) - 1) + 2, 0x20, np.uint8)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + 2 * row + 2
    b[at] = _CLASS[data]
    g = b.astype(np.uint32)
    code = (g[:-3] << 24) | (g[1:-2] << 16) | (g[2:-1] << 8) | g[3:]
    inner = (b[1:-2] != 0x20) & (b[2:-1] != 0x20)
    rows = np.zeros(len(b), np.int64)
    rows[at] = row
    keep = np.flatnonzero(inner)
    return code[keep], rows[keep + 1]


def _slots(code: np.ndarray) -> list[np.ndarray]:
    h = _text.mix(code.astype(_U))
    step = (h >> _U(32)) | _U(1)
    return [((h + _U(i) * step) & _U(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    """Languages in bit order, slots (a row of SLOTS mask words for each 64 languages) and each
    language's false positive rate."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray


def learn(rows: DataFrame, near: float = 0.3, least: int = 3) -> Model:
    """rows(text, lang): every row with a text and a lang takes part. Counts are exact and over all
    rows; the driver gets languages and at most SLOTS slot masks for each 64 languages. Without
    labelled rows the model has no language. There may be as many languages as lang has values: the
    model has 128 kB for each."""

    def count(batches):
        for batch in _text.released(batches):
            lang = batch.column(1)
            for i, j, data, offsets in _text.chunks(batch.column(0)):
                code, row = _grams(data, offsets)
                names = lang.slice(i, j - i).dictionary_encode()
                group = names.indices.to_numpy(zero_copy_only=False)[row].astype(_U)
                key, n = np.unique((group << _U(32)) | code.astype(_U), return_counts=True)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array((key >> _U(32)).astype(np.int64))), pa.array((key & _U(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = rows.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = _store.table(counts, "grams")
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    names = sorted(totals)
    slots = np.zeros(((len(names) + 63) // 64, SLOTS), _U)
    if names:
        bits = counts.sparkSession.createDataFrame([(x, float(totals[x]), i // 64, int(np.array(1 << i % 64, _U).view(np.int64))) for i, x in enumerate(names)], "lang string, total double, word int, bit long")
        shares = counts.join(F.broadcast(bits), "lang").select("gram", "n", "word", "bit", (F.col("n") / F.col("total")).alias("share"))
        best = shares.groupBy("gram", "word").agg(F.max("share").alias("best"), F.collect_list(F.struct("share", "n", "bit")).alias("all"))  # a struct a language, 64 at most
        if len(names) > 64:
            best = best.join(best.groupBy("gram").agg(F.max("best").alias("top")), "gram").drop("best").withColumnRenamed("top", "best")
        mask = F.aggregate(F.filter("all", lambda x: (x["n"] >= least) & (x["share"] >= near * F.col("best"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["bit"]))
        masks = best.select("gram", "word", mask.alias("mask")).filter("mask <> 0")

        def place(batches):
            for batch in _text.released(batches):
                code, word, mask = batch.column(0).to_numpy().astype(np.uint32), batch.column(1), batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(word.to_numpy(), HASHES)), pa.array(np.concatenate(_slots(code))), pa.array(np.tile(mask, HASHES))], ["word", "slot", "mask"])

        filled = masks.mapInArrow(place, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
        slots[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(_U)
    fill = np.array([((slots[i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(names))])
    return Model(names, slots, fill**HASHES)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model, *keep: Column | str) -> DataFrame:
    """docs(text, ...) -> the columns `keep`, lang_pred, score, lang_counts (JSON, language to
    corrected count).

    lang_pred is the language with the highest corrected count (ties: the first by name), and
    `und` with score 0 if the text is null or has no letter. score is that count divided by the
    text's n-grams, clipped to 0..1. Whole texts are read. A text with letters but without
    n-grams (one letter) gets the first language and score 0. Empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col("text").alias("__text"), *keep)
    names = kept.columns[1:]

    def run(batches):
        m = shared.value
        for batch in _text.released(batches):
            for i, j, data, offsets in _text.chunks(batch.column(0)):
                n, k = j - i, len(m.languages)
                code, row = _grams(data, offsets)
                first = np.searchsorted(row, np.arange(n + 1))
                mask = np.full((len(m.slots), len(code)), 2**64 - 1, _U)
                for at in _slots(code):
                    mask &= m.slots[:, at]
                total = np.diff(first).astype(float)
                hits = np.zeros((n, k))
                for x in range(k):
                    s = np.concatenate([[0], np.cumsum((mask[x // 64] >> _U(x % 64)) & _U(1), dtype=np.int64)])
                    hits[:, x] = s[first[1:]] - s[first[:-1]]
                fixed = np.maximum(0, (hits - m.rates * total[:, None]) / (1 - m.rates))
                letters = np.zeros(len(data) + 1, np.int64)
                np.cumsum((_CLASS[data] != 0x20) & (data < 128), out=letters[1:])
                sure = letters[offsets[1:]] > letters[offsets[:-1]]
                for r in np.flatnonzero(~sure):
                    sure[r] = _has_letter(data[offsets[r] : offsets[r + 1]].tobytes())
                best = fixed.argmax(axis=1) if k else np.zeros(n, np.int64)
                lang = [m.languages[b] if ok and k else "und" for b, ok in zip(best, sure, strict=True)]
                score = np.where(sure, np.clip(fixed[np.arange(n), best] / np.maximum(total, 1), 0, 1), 0.0) if k else np.zeros(n)
                counts = [json.dumps(dict(zip(m.languages, map(float, np.round(x, 3)), strict=True))) for x in fixed]
                yield pa.RecordBatch.from_arrays([*(batch.column(c + 1).slice(i, n) for c in range(len(names))), pa.array(lang, pa.string()), pa.array(score), pa.array(counts, pa.string())], [*names, "lang_pred", "score", "lang_counts"])

    schema = kept.select(*[F.col(f"`{c}`") for c in names]).schema
    return kept.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double").add("lang_counts", "string"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves that remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))
