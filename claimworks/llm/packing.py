"""Packing token sequences into windows of bounded length, online and with bounded space.

Every partition of documents is read once. At most `open_windows` windows are open in it; the
rest of a document, after full windows have been cut from it, goes to the open window it fits
best. When it fits none and all are in use, the fullest window is topped up with its first
tokens (unless only a sliver is missing) and emitted. What is open at a partition's end is merged
over groups of 16 partitions. Memory is the open windows and one chunk of texts; texts are not
shuffled, only the last windows of each partition are.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.llm import _store, _text

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OPEN = PIECES + ", ids binary"
_MERGED = 1 << 62
GROUP = 16


class _Numbers(dict):
    """A number for each word, given when it is first asked for; `new` lists the words since."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class _Forms(dict):
    """The byte-level form of each character, by its code point."""

    def __init__(self, pre_tokenizer):
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, point: int) -> str:
        self[point] = form = self.pre_tokenizer.pre_tokenize_str(chr(point))[0][0]
        return form


class Tokens:
    """Token ids of whole texts. The tokenizer never joins over white space, so the ids of a text
    are those of its white-space-separated words, and those of a word are those of the pieces its
    pre-tokenizer cuts. Both are kept for recent words. Words of other than Latin letters, of
    control characters or with a special token go through the whole tokenizer."""

    MOST_WORDS = 800_000
    MOST_PIECES = 50_000
    #: Bytes of texts at a time; a longer text stands alone.
    CHUNK = 250_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, list[int]] = {}
        self.forms = _Forms(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        special = "|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = regex.compile(f"[^\\x21-\\x7e\\xa1-\\u024f\n]|{special}")
        cut = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(f"{cut}|\n")
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.flat = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)

    def _piece(self, piece: str) -> list[int]:
        if (ids := self.pieces.get(piece)) is None:
            form = piece if piece.isascii() else piece.translate(self.forms)
            ids = [t.id for t in self.tokenizer.model.tokenize(form)]
            if len(self.pieces) >= self.MOST_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def learn(self, new: list[bytes]) -> None:
        """The ids of words that have just got their numbers, the last ones given."""
        text = b"\n".join(new).decode("utf-8", "replace")
        odd = {}
        if self.odd.search(text):
            lines = text.split("\n")
            odd = {i: self.tokenizer.encode(w, add_special_tokens=False).ids for i, w in enumerate(lines) if self.odd.search(w)}
            text = "\n".join("" if i in odd else w for i, w in enumerate(lines))
        ids: list[int] = []
        ends: list[int] = []
        get = self.pieces.get
        for piece in self.cut.findall(text.lower() + "\n"):
            if piece == "\n":
                if odd and len(ends) in odd:
                    ids += odd[len(ends)]
                ends.append(len(ids))
            else:
                found = get(piece)
                ids += self._piece(piece) if found is None else found
        n = len(self.index) - len(new)
        begin = int(self.at[n])
        while len(self.index) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
        self.at[n + 1 : n + 1 + len(new)] = begin + np.array(ends)
        while begin + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[begin : begin + len(ids)] = ids

    def rows(self, data: np.ndarray, offsets: np.ndarray, last: int) -> Iterator[np.ndarray]:
        """The ids of each row of a chunk, with the id `last` at the end of each."""
        texts = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        words = [w for t in texts for w in t]
        if len(self.index) > self.MOST_WORDS:
            self.clear()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self.learn(self.index.new)
            self.index.new = []
        begin, n = self.at[at], self.at[at + 1] - self.at[at]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(done[-1]) + np.repeat(begin - done[:-1], n)]
        k = 0
        for t in texts:
            yield np.append(ids[done[k] : done[k + len(t)]], np.uint32(last))
            k += len(t)


class Windows:
    """The open windows of one partition."""

    def __init__(self, first_id: int, size: int, most: int, sliver: int):
        self.next, self.size, self.most, self.sliver = first_id, size, most, sliver
        self.fill = np.zeros(0, np.int64)
        self.pieces: list[list[tuple]] = []
        self.closed: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, None))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self._emit([(doc, start, ids[start : start + self.size], total)])
            start += self.size
        rest = total - start
        if not rest:
            return
        gaps = self.size - self.fill
        fits = np.where(gaps >= rest, gaps, self.size + 1)
        if len(gaps) and fits.min() <= self.size:
            i = int(fits.argmin())
        elif len(gaps) < self.most:
            i = len(gaps)
            self.fill = np.append(self.fill, 0)
            self.pieces.append([])
        else:
            i = int(gaps.argmin())
            if gaps[i] >= self.sliver:
                self.pieces[i].append((doc, start, ids[start : start + gaps[i]], total))
                start += int(gaps[i])
            self._emit(self.pieces[i])
            self.fill[i], self.pieces[i] = 0, []
        self.pieces[i].append((doc, start, ids[start:], total))
        self.fill[i] += total - start
        if self.fill[i] == self.size:
            self._emit(self.pieces[i])
            self.fill = np.delete(self.fill, i)
            del self.pieces[i]

    def leftovers(self) -> list[tuple]:
        out = []
        for pieces in self.pieces:
            offset = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), 0, total, self.next, offset, ids.astype("<u4").tobytes()))
                offset += len(ids)
            self.next += 1
        return out

    def take(self) -> list[tuple]:
        rows, self.closed = self.closed, []
        return rows


_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


_kept: dict[str, Tokens] = {}


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 2, open_windows: int = 32, sliver: int = 16) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its text's ids and then end_id; a null or empty text is end_id alone. Rows with
    equal ids, or null ids, are packed as documents of their own. Every id lies in one piece; the
    pieces of a sequence are gapless from 0 and at most max_tokens. tokenizer is the path of the
    tokenizer's file on every machine. Other columns are ignored. An empty table gives no rows.
    """

    def run(batches):
        tokens = _kept.get(tokenizer) or _kept.setdefault(tokenizer, Tokens(tokenizer))
        windows = Windows(TaskContext.get().partitionId() << 32, max_tokens, open_windows, sliver)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, _, data, offsets in _text.chunks(batch.column(1), Tokens.CHUNK):
                for k, ids in enumerate(tokens.rows(data, offsets, end_id)):
                    windows.add(doc_ids[i + k], ids)
                if len(windows.closed) > 20_000:
                    yield _batch(windows.take())
        if rows := windows.take() + windows.leftovers():
            yield _batch(rows)

    def merge(key, batch):
        """Lays the open windows of a group of partitions end to end and cuts them to full ones."""
        first = _MERGED + (key[0].as_py() << 32)
        windows, filled = Windows(first, max_tokens, 1, 1), 0
        pieces: list[tuple] = []
        order = batch.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for row in order.to_pylist():
            ids, start = np.frombuffer(row["ids"], "<u4"), row["start"]
            while len(ids):
                part, ids = ids[: max_tokens - filled], ids[max_tokens - filled :]
                pieces.append((row["doc_id"], start, part, row["doc_tokens"]))
                start, filled = start + len(part), filled + len(part)
                if filled == max_tokens:
                    windows._emit(pieces)
                    pieces, filled = [], 0
        if pieces:
            windows._emit(pieces)
        return pa.Table.from_batches([_batch(windows.take())]).drop_columns(["ids"])

    cut = _store.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _OPEN), "windows")
    done = cut.filter("ids is null").drop("ids")
    group = F.shiftright("sequence_id", 32 + GROUP.bit_length() - 1)
    return done.unionByName(cut.filter("ids is not null").groupBy(group.alias("g")).applyInArrow(merge, PIECES))
