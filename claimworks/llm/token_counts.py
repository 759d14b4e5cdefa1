"""Token counts of whole texts by overlap resynchronisation.

Texts of up to `stride + overlap` characters are encoded as they are, where they lie. A longer one
is cut into overlapping chunks that become rows of their own and are dealt out over all tasks, so
that no task encodes a huge text alone. Two neighbouring chunks are spliced at a boundary that both
encodings have in their overlap and that is proven stable; if they share none, the text goes
through again with strides and overlaps eight times as wide, in the end as one chunk.

Why a splice is exact. A pre-tokenizer cuts a text from left to right without looking back. A
pre-token that begins in both chunks at the same character is therefore followed by the same
pre-tokens in both, and a cut before the end of the left chunk doesn't depend on what follows it.
Merges never cross such cuts. So the whole text's tokens are those of the left chunk before the
boundary and those of the right chunk after it. Added tokens are found first in the text; as an
overlap is longer than any of them, one of the two chunks shows it whole, and no boundary in it is
common. For sentencepiece models the boundary is a space after another character; it is used only
if no piece of the vocabulary runs over one.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimworks.llm import _store, _text

#: How much wider strides and overlaps get where neighbours share no boundary.
WIDER = 8
_BATCH = 2_000_000
_SPACE = "▁"


class JsonEncoder:
    """A tokenizer of the tokenizers library, without its truncation and padding.

    Where its pre-tokenizer drops white space (the pattern below, which matches none), a text has the
    tokens of its words; those of recent words are kept. Other tokenizers get whole texts."""

    # fixed value: the pattern of such a pre-tokenizer
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MOST_WORDS, LONGEST = 400_000, 100

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.longest_added = max((len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), default=0)
        self.drops_space = self._drops_space(json.loads(self.tokenizer.to_str()))
        self.known: dict[bytes, int] = {}

    def _drops_space(self, form: dict) -> bool:
        steps = (form["normalizer"] or {}).get("normalizers", [form["normalizer"]])
        mild = all(n is None or n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in steps)
        cut = ((form["pre_tokenizer"] or {}).get("pretokenizers") or [form["pre_tokenizer"]])[0] or {}
        drops = cut.get("type") == "Split" and cut["pattern"] == {"Regex": self.WORDS} and cut["behavior"] == "Removed" and cut["invert"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in form["added_tokens"])
        return mild and drops and plain

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.drops_space:
            return self._encoded(texts)
        words = [t.encode().split() for t in texts]
        if len(self.known) > self.MOST_WORDS:
            self.known.clear()
        new = [*{w for t in words for w in t}.difference(self.known)]
        self.known.update(zip(new, self._encoded([w.decode() for w in new]), strict=True))
        out = [sum(map(self.known.__getitem__, t)) for t in words]
        for w in new:
            if len(w) > self.LONGEST:
                del self.known[w]
        return out

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where pre-tokens begin, how many tokens stand before each, and the number of tokens."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        start = np.array([o[0] for o in found.offsets], np.int64)
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (word[1:] < 0)
        at = np.flatnonzero(new)
        return start[at], at, len(word)


class ModelEncoder:
    """A sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.stable = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.longest_added = max((len(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()) if self.model.is_control(i)), default=0)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        found = self.model.encode(text, return_type="proto")
        if not self.stable:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), len(found.pieces)
        pieces = [(p.piece, p.begin) for p in found.pieces]
        at = [i for i in range(1, len(pieces)) if pieces[i][0].startswith(_SPACE) and not pieces[i - 1][0].endswith(_SPACE)]
        begin = np.array([pieces[i][1] for i in at], np.int64)  # in bytes
        characters = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return characters[begin] - 1, np.array(at, np.int64), len(pieces)


_kept: dict[str, JsonEncoder | ModelEncoder] = {}


def encoder(path: str) -> JsonEncoder | ModelEncoder:
    """The tokenizer of a file on this machine, loaded once in each worker."""
    if path not in _kept:
        _kept[path] = (ModelEncoder if path.endswith(".model") else JsonEncoder)(path)
    return _kept[path]


def _cut(long: DataFrame, stride: int, overlap: int) -> DataFrame:
    """A row for each chunk of a text: its number, where it begins, and its text."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column(1)[r].as_py()
                last = max(1, -(-(len(text) - overlap) // stride))
                for c in range(last):
                    piece = text[c * stride : (c + 1) * stride + overlap if c < last - 1 else len(text)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([c], pa.int32()), pa.array([c == last - 1]), pa.array([piece], pa.string())], ["row", "chunk", "last", "piece"])

    return long.select("row", "text").mapInArrow(run, "row long, chunk int, last boolean, piece string")


def _encode(pieces: DataFrame, path: str, stride: int, overlap: int) -> DataFrame:
    """Of each chunk: its number of tokens, and in both of its overlaps the boundaries, as positions
    in the whole text, with the numbers of the chunk's tokens before them."""

    def run(batches):
        own = encoder(path)
        for batch in batches:
            chunks, lasts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for r, (c, last) in enumerate(zip(chunks, lasts, strict=True)):
                text = batch.column(3)[r].as_py()
                at, before, total = own.boundaries(text)
                head = (at > 0) & (at < overlap) & (at < len(text)) & (c > 0)
                tail = (at > stride) & (at < len(text)) & (not last)
                rows.append((total, c * stride + at[head], before[head], c * stride + at[tail], before[tail]))
            longs = pa.list_(pa.int64())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), longs, longs, longs, longs), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), longs, longs, longs, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "chunk", "total", "head", "head_before", "tail", "tail_before"])

    lists = "array<long>"
    return pieces.mapInArrow(run, f"row long, chunk int, total long, head {lists}, head_before {lists}, tail {lists}, tail_before {lists}")


def _spliced(chunks: DataFrame) -> DataFrame:
    """row, n_tokens: null where two neighbours share no boundary."""

    def before(numbers: str, places: str) -> Column:
        return F.element_at(numbers, F.array_position(places, F.col("at")).cast("int"))

    left = chunks.select("row", "chunk", "total", "tail", "tail_before")
    right = chunks.select("row", (F.col("chunk") - 1).alias("chunk"), "head", "head_before").filter("chunk >= 0")
    seams = left.join(right, ["row", "chunk"]).withColumn("at", F.try_element_at(F.array_intersect("tail", "head"), F.lit(1)))
    twice = F.col("total") - before("tail_before", "tail") + before("head_before", "head")
    seams = seams.groupBy("row").agg(F.sum(F.when(F.col("at").isNotNull(), twice)).alias("twice"), F.count(F.when(F.col("at").isNull(), 1)).alias("apart"))
    totals = chunks.groupBy("row").agg(F.sum("total").alias("total"))
    joined = totals.join(seams, "row", "left")
    return joined.select("row", F.when(F.coalesce("apart", F.lit(0)) == 0, F.col("total") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, stride: int = 65_536, overlap: int = 2_048) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    n_tokens is what the library of `path` (tokenizers for .json, sentencepiece for .model; a file
    on every machine) gives for the whole text, without begin, end or added special tokens; special
    strings in texts are handled as by its default. A null text counts as an empty one. Every row is
    counted for itself, also where ids repeat or are null. Other columns are ignored. An empty table
    gives no rows. Texts beyond stride + overlap characters are counted in chunks.
    """
    if not encoder(path).longest_added < overlap <= stride:
        raise ValueError("an overlap must be longer than any added token and at most a stride")
    most = stride + overlap

    def short(batches):
        own = encoder(path)
        for batch in batches:
            texts = _text.string_column(batch.column(2))
            n = np.full(len(texts), -1, np.int64)
            kept: list[str | None] = [None] * len(texts)
            for i, j, data, offsets in _text.chunks(texts, _BATCH):
                part = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                some = [k for k, t in enumerate(part) if len(t) <= most]
                n[[i + k for k in some]] = own.counts([part[k] for k in some])
                for k in {*range(j - i)} - {*some}:
                    kept[i + k] = part[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, mask=n < 0), batch.column(3), pa.array(kept, pa.large_string()).cast(pa.string())], ["row", "doc_id", "n_tokens", "n_bytes", "text"])

    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    first = _store.table(docs.mapInArrow(lambda b: _text.released(short(b)), "row long, doc_id long, n_tokens long, n_bytes long, text string"), "counted")
    long = first.filter("n_tokens is null")
    todo, solved = long, []
    while todo.limit(1).count():
        # Each chunk goes to a task of its own choosing: a huge text is encoded by many.
        pieces = _cut(todo, stride, overlap).repartition("row", "chunk")
        counts = _store.table(_spliced(_store.table(_encode(pieces, path, stride, overlap), "chunks")), "spliced")
        solved.append(counts.filter("n_tokens is not null"))
        todo = _store.with_ids(long, counts.filter("n_tokens is null").select("row"), "row", "left_semi")
        stride, overlap = WIDER * stride, WIDER * overlap
    out = first.filter("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
    for part in solved:
        out = out.unionByName(long.drop("n_tokens", "text").join(part, "row").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
