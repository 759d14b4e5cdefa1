"""Which tokens of two tokenizers stand for the same bytes, and how common each such link is.

Both token sequences cover the bytes of a text without gaps. All tokens of a batch of texts are
sorted by start (lexsort); a group begins where a token's start reaches the running maximum of the
ends before it (maximum.accumulate). Within a group every A token is linked to every B token.

An id pair's count is the number of documents that hold it linked. It is needed by each of these
documents, so the work goes round once: a chunk of documents (about `chunk_bytes` of text) keeps
its documents' distinct pairs packed, and sends each pair of the chunk once, with its number of
documents. The counts are summed by pair, joined back to the chunks' pairs, and meet the packed
documents again by chunk. Pairs are rows, never broadcast; the highest count of each A id is (its
rows are bounded by tokenizer A's vocabulary).
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.llm import _store, _text

#: Pairs expanded at a time.
_MOST_PAIRS = 4_000_000
_BATCH = 500_000


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library. It is given a space and then the text;
    strings of special tokens are ordinary text. Where its file says no more than that (the pattern
    below, and merges whose order is that of their ids), tiktoken applies the same ranks faster; a
    test compares both."""

    # fixed value: the pattern of byte-level pre-tokenizers
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        size, bytes_of = self.tokenizer.get_vocab_size(), byte_of()
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(bytes_of[c] for c in e) if all(c in bytes_of for c in e) else e.encode() for e in entries]
        self.fast = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, form: dict):
        """tiktoken with the ranks of the file, or None if the file asks for anything else."""
        import tiktoken

        model, cut, vocab = form["model"], form["pre_tokenizer"] or {}, form["model"].get("vocab", {})
        usual = model["type"] == "BPE" and not form["normalizer"] and all(t["special"] for t in form["added_tokens"])
        usual = usual and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        usual = usual and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if not usual:
            return None
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        if merged != [*range(256, 256 + len(merged))]:
            return None
        ranks = {self.bytes[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list:
        if self.fast is not None:
            return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Side:
    """One tokenizer with its ids' bytes end to end, and its ids as the decimals of the digest."""

    def __init__(self, path: str):
        self.tokenizer = (Pieces if path.endswith(".model") else ByteLevel)(path)
        self.length = np.array([len(b) for b in self.tokenizer.bytes], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(self.tokenizer.bytes), np.uint8)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the text of each."""
        found = self.tokenizer.encode(texts)
        n = np.array([len(f) for f in found], np.int64)
        if found and isinstance(found[0], np.ndarray):
            ids = np.concatenate(found).astype(np.int64)
        else:
            ids = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        return ids, np.repeat(np.arange(len(texts)), n)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids end to end."""
        n = self.length[ids]
        return self.flat[_ranges(self.at[ids], n)]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of n[i] numbers each, end to end."""
    done = np.cumsum(n)
    return np.arange(int(done[-1]) if len(n) else 0) + np.repeat(start - (done - n), n)


def groups(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The group of each token, from 0 on in order of position."""
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _counted(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each comes or the sum of its weights."""
    order = None if weight is None else np.argsort(key)
    key = np.sort(key) if order is None else key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    if order is None:
        return key[at], np.diff(np.append(at, len(key)))
    return key[at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _Side(a_path), _Side(b_path)
        decimals = [[f"{i}{end}" for i in range(len(side.length))] for side, ends in ((self.a, ",|"), (self.b, ",;")) for end in ends]
        self.decimals = np.array([d for table in decimals for d in table], object)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """A's and B's ids and their texts, of those texts that both spell byte by byte."""
        raw = [(" " + t).encode() for t in texts]
        size = np.array([len(r) if len(r) > 1 else -1 for r in raw], np.int64)
        found = [(side, *side.tokens(texts)) for side in (self.a, self.b)]
        good = size >= 0
        for side, ids, row in found:
            good &= np.bincount(row, side.length[ids], minlength=len(texts)).astype(np.int64) == size
        wanted = np.frombuffer(b"".join(r for r, g in zip(raw, good, strict=True) if g), np.uint8)
        owner = np.repeat(np.flatnonzero(good), size[good])
        other = np.zeros(len(texts), bool)
        for side, ids, row in found:
            other[owner[side.spelled(ids[good[row]]) != wanted]] = True
        good &= ~other
        return tuple(x[good[row]] for _, ids, row in found for x in (ids, row))

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, ...]]:
        """Counts and digest of each text, and its distinct links (text, A id, B id, occurrences)."""
        n = len(texts)
        a, a_row, b, b_row = self._whole(texts)
        a_end, b_end = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        end = np.concatenate([a_end, b_end])
        start = end - np.concatenate([self.a.length[a], self.b.length[b]])
        kind = np.repeat([0, 1], [len(a), len(b)])
        group = groups(start, end, kind)
        a_group, b_group = group[: len(a)], group[len(a) :]
        total = int(group.max()) + 1 if len(group) else 0
        row_of = np.empty(total, np.int64)
        row_of[a_group] = a_row
        links = np.bincount(a_group, minlength=total) * np.bincount(b_group, minlength=total)
        out = {"n_a": np.bincount(a_row, minlength=n), "n_b": np.bincount(b_row, minlength=n), "n_groups": np.bincount(row_of, minlength=n)}
        out["n_links"] = np.zeros(n, np.int64)
        np.add.at(out["n_links"], row_of, links)
        return out, self._digests(a, a_group, a_row, b, b_group, b_row, n), self._links(a, a_group, b, b_group, row_of)

    def _digests(self, a, a_group, a_row, b, b_group, b_row, n: int) -> list[str]:
        last_a, last_b = np.append(np.diff(a_group) != 0, True), np.append(np.diff(b_group) != 0, True)
        sizes = len(self.a.length), len(self.b.length)
        entry = np.concatenate([a + sizes[0] * last_a[: len(a)], 2 * sizes[0] + b + sizes[1] * last_b[: len(b)]])
        order = np.argsort(np.concatenate([a_group, b_group]), kind="stable")  # A before B in a group
        words = self.decimals[entry[order]].tolist()
        ends = np.concatenate([[0], np.cumsum(np.bincount(a_row, minlength=n) + np.bincount(b_row, minlength=n))]).tolist()
        return [hashlib.sha256("".join(words[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:], strict=False)]

    def _links(self, a, a_group, b, b_group, row_of) -> tuple[np.ndarray, ...]:
        sizes = len(self.a.length), len(self.b.length)
        pairs = sizes[0] * sizes[1]
        a_key, ca = _counted(a_group * sizes[0] + a)
        b_key, cb = _counted(b_group * sizes[1] + b)
        (ga, ia), (gb, ib) = np.divmod(a_key, sizes[0]), np.divmod(b_key, sizes[1])
        ends = np.cumsum(np.bincount(gb, minlength=len(row_of)))  # of each group's B ids
        width = np.bincount(gb, minlength=len(row_of))[ga]  # B ids that each A id meets
        first = ends[ga] - width
        base, parts, i, done = row_of[ga] * pairs + ia * sizes[1], [], 0, np.cumsum(width)
        while i < len(ga):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + _MOST_PAIRS, side="right")))
            right = _ranges(first[i:j], width[i:j])
            parts.append(_counted(np.repeat(base[i:j], width[i:j]) + ib[right], np.repeat(ca[i:j], width[i:j]) * cb[right]))
            i = j
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        key, n = parts[0] if len(parts) == 1 else _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return *np.divmod(key, pairs), n


def _packed(pair: np.ndarray, n: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Sorted pairs as differences, and their occurrences."""
    return press.compress(np.diff(pair, prepend=0).astype("<i8").tobytes() + n.astype("<i8").tobytes())


def _unpacked(blob: bytes, open_: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(open_.decompress(blob), "<i8").reshape(2, -1)
    return np.cumsum(both[0]), both[1]


_kept: dict[tuple[str, str], Aligner] = {}
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_FIRST = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, docs array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])


def _rows(chunk: int, n: int, **columns) -> pa.RecordBatch:
    """n rows of the first step; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)) if f.name == "chunk" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _first(batches, a_path: str, b_path: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row for each document with its packed links, and one for each chunk with its pairs."""
    own = _kept.get((a_path, b_path)) or _kept.setdefault((a_path, b_path), Aligner(a_path, b_path))
    press = zstandard.ZstdCompressor(level=1)
    chunk, held, pairs = TaskContext.get().partitionId() << 32, 0, []

    def close():
        pair, docs = (np.concatenate(x) for x in zip(*pairs, strict=True))
        pair, docs = _counted(pair, docs)
        return _rows(chunk, 1, pairs=[pair], docs=[docs])

    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offsets in _text.chunks(batch.column(1), _BATCH):
            counts, digests, (row, pair, n) = own.align([data[x:y].tobytes().decode() for x, y in zip(offsets[:-1], offsets[1:], strict=True)])
            at = np.searchsorted(row, np.arange(j - i + 1))
            blobs = [_packed(pair[x:y], n[x:y], press) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield _rows(chunk, j - i, doc_id=ids.slice(i, j - i), groups_sha256=digests, links=blobs, **counts)
            pairs.append(_counted(pair))
            held += len(data)
            if len(pairs) >= 64:
                pairs = [_counted(*(np.concatenate(x) for x in zip(*pairs, strict=True)))]
            if held >= chunk_bytes:
                yield close()
                chunk, held, pairs = chunk + 1, 0, []
    if pairs:
        yield close()


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = 32_000_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of an A and a B token
    of one group), n_best (links whose count is the highest of their A id, ties included), count_sum
    (of all links' counts), groups_sha256 (of `a1,a2|b1;a3|b2,b3`, the ids of the groups in order).

    a_path is a byte-level tokenizer of the tokenizers library, b_path a sentencepiece model; both are
    files on every machine. A text that is null or empty, or whose A or B tokens don't spell a space
    and then the text byte by byte, has no tokens: zeros, and '' for groups_sha256. Rows with equal or
    null ids are documents of their own. Other columns are ignored. An empty table gives no rows.
    """
    size_b = len(_Side(b_path).length)
    step = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _text.released(_first(b, a_path, b_path, chunk_bytes)), _FIRST)
    first = _store.table(step, "aligned")
    sent = first.filter("pairs is not null").select("chunk", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), "p.docs")
    counts = _store.table(sent.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    a_id = F.expr(f"pair div {size_b}")
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("highest"))  # at most A's vocabulary
    known = counts.withColumn("a", a_id).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    answers = sent.select("chunk", "pair").join(known, "pair")

    def last(key, answer: pa.Table, held: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        pair, n, best = (answer[c].to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        pair, n, best = pair[order], n[order], best[order].astype(bool)
        n_best, total = np.zeros(held.num_rows, np.int64), np.zeros(held.num_rows, np.int64)
        for r, blob in enumerate(held["links"].to_pylist()):
            own, times = _unpacked(blob, open_)
            at = np.searchsorted(pair, own)
            n_best[r], total[r] = times[best[at]].sum(), (times * n[at]).sum()
        out = held.drop_columns(["of", "links"])
        return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total)).select([f.split()[0] for f in _OUT.split(", ")])

    kept = first.filter("links is not null").select(F.col("chunk").alias("of"), "doc_id", *_COUNTS, "groups_sha256", "links")
    return answers.groupBy("chunk").cogroup(kept.groupBy("of")).applyInArrow(last, _OUT)
