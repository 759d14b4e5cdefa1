"""Fuzzy line de-duplication.

Lines are normalised, equal ones become one distinct line, and each distinct line gets a 64-bit
SimHash of its words. Two hashes that differ in at most 2 bits agree in two of four blocks at
least, so lines meet in six postings of 32 bits each (pigeonhole). A changed word moves more bits
than that in all but long lines, so lines also meet in ten bands of four least word hashes
(MinHash), where their SimHashes may differ in 15 bits. Words of five bytes and more weigh eight
times as much there, else lines would meet by the few words that all lines share. Postings travel
packed, by range of hashed keys. Within a posting, one leader after another is compared with all
lines, and a line that has been reached leads no more. Pairs are verified by edit similarity of the
normalised lines, and verified pairs form connected groups. Where a posting's lines are in several
groups then, they meet again with their texts: the close ones of different groups are verified
there, nearest first, until all that can be are joined.
Of each group one occurrence stays: the first by document and line.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimworks.llm import _store, _text
from claimworks.llm.components import components

_U = np.uint64
BLOCKS = 4  # of 16 bits
BITS = 2
BANDS, BAND_WORDS = 10, 4
MANY = 2048  # characters of lines whose distances are computed many at a time
FEW = 96  # pairs below which each is computed alone
GIVE_UP = 32  # columns after which pairs that can't be similar any more are left
RANGE = 1 << 19  # postings of a range of keys
LONG = 5  # bytes of a word that weighs more in the bands
BAND_BITS = 15  # one word of ten changed moves 9.5 bits, give or take 3; unrelated lines differ in 32
_SALTS = _text.mix(np.arange(1, BANDS * BAND_WORDS + 1, dtype=_U)) | _U(1)

_NORMAL = _text.LOWER.copy()  # letters lower-cased, digits to 0, ASCII punctuation to space
_NORMAL[48:58] = 48
for _c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    _NORMAL[_c] = 32


_BANDS = [f"band{n}" for n in range(BANDS)]
_PAIRS = tuple(combinations(range(BLOCKS), 2))


def _line_hash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each row's word hashes in order."""
    up, down = _text.powers(len(h) + 1)
    s = _text.sums(h * up[: len(h)])
    return _text.mix((s[first[1:]] - s[first[:-1]]) * down[first[:-1]] + _U(1))


def _line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines of all rows, the row of each line, and its number in the row. The
    newline belongs to the line that it ends; a row's text after its last newline is a line."""
    breaks = np.flatnonzero(data == 10) + 1
    row_of = np.searchsorted(offsets, breaks - 1, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks])
    rows = np.concatenate([np.arange(len(offsets) - 1), row_of])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    number = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return np.append(starts, len(data)), rows, number


def _simhash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each row's word hashes; 0 for a row without words. Bits are counted eight at a
    time in the bytes of one number, over at most 255 words, so that no byte overflows."""
    out = np.zeros(len(first) - 1, _U)
    n = np.diff(first)
    filled = np.flatnonzero(n > 0)
    if not len(filled):
        return out
    runs = -(-n[filled] // 255)
    begins = np.cumsum(runs) - runs
    starts = np.repeat(first[filled], runs) + 255 * (np.arange(runs.sum()) - np.repeat(begins, runs))
    ones = np.zeros((len(filled), 8, 8), bool)
    for bit in range(8):
        counts = np.add.reduceat((h >> _U(bit)) & _U(0x0101010101010101), starts).view(np.uint8).reshape(-1, 8)
        ones[:, :, bit] = 2 * np.add.reduceat(counts, begins, axis=0, dtype=np.int64) > n[filled, None]
    out[filled] = np.packbits(ones.reshape(len(filled), 64), axis=1, bitorder="little").view(_U).ravel()
    return out


def _bands(h: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 32-bit key for each row and band: the least of a row's word hashes under BAND_WORDS orders,
    in which long words come earlier."""
    out = np.zeros((BANDS, len(first) - 1), _U)
    filled = np.flatnonzero(np.diff(first) > 0)
    if len(filled):
        shift = np.where(length >= LONG, _U(3), _U(0))
        for n, salt in enumerate(_SALTS):
            least = np.minimum.reduceat((h * salt) >> shift, first[filled])
            out[n // BAND_WORDS][filled] = _text.mix(out[n // BAND_WORDS][filled] + least)
    return (out >> _U(32)).astype(np.uint32).view(np.int32)


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, line_no (from 0), line, fuzzy, simhash and a key for each band, for each line that
    isn't blank. Lines of at least min_words words are fuzzy, and line is the hash of the normalised
    words; for others it is the hash of the text between white space as it stands."""

    def run(batches):
        for batch in _text.released(batches):
            for i, j, data, offsets in _text.chunks(batch.column(1)):
                at, row, number = _line_offsets(data, offsets)
                words = _text.Words(_NORMAL[data], at, lower=False)
                h = words.hash()
                line = _line_hash(h, words.first)
                fuzzy = np.diff(words.first) >= min_words
                short = np.flatnonzero(~fuzzy)
                size = np.diff(at)
                rest = data[np.repeat(~fuzzy, size)]
                whole = _text.Words(rest, np.concatenate([[0], np.cumsum(size[short])]), lower=False)
                line[short] = _text.mix(~_line_hash(whole.hash(), whole.first))
                fuzzy_or_filled = fuzzy.copy()
                fuzzy_or_filled[short] = np.diff(whole.first) > 0
                keep = np.flatnonzero(fuzzy_or_filled)
                if not len(keep):
                    continue
                sim = _simhash(h, words.first)
                doc = batch.column(0).slice(i, j - i).take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([doc, pa.array(number[keep].astype(np.int32)), pa.array(_text.signed(line[keep])), pa.array(fuzzy[keep]), pa.array(_text.signed(sim[keep])), *(pa.array(b[keep]) for b in _bands(h, words.end - words.start, words.first))], ["doc_id", "line_no", "line", "fuzzy", "simhash", *_BANDS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, line_no int, line long, fuzzy boolean, simhash long" + "".join(f", {b} int" for b in _BANDS))


def _normal_lines(docs: DataFrame) -> DataFrame:
    """line, words (the normalised line) of all lines, each once a chunk."""

    def run(batches):
        for batch in _text.released(batches):
            for _, _, data, offsets in _text.chunks(batch.column(1)):
                at, row, _ = _line_offsets(data, offsets)
                words = _text.Words(_NORMAL[data], at, lower=False)
                line, first = np.unique(_line_hash(words.hash(), words.first), return_index=True)
                kept = np.zeros(len(data) + 1, bool)
                kept[:-1] = ~_text.SPACE[words.data]
                kept[words.end[:-1][words.doc[1:] == words.doc[:-1]]] = True  # one space between two words
                ends = np.concatenate([[0], np.cumsum(kept[:-1])])[at]
                text = np.where(_text.SPACE[words.data], np.uint8(32), words.data)[kept[:-1]]
                every = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(line)), every.take(pa.array(first)).cast(pa.string())], ["line", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "line long, words string")


def _keys(sim: np.ndarray, bands: list[np.ndarray]) -> np.ndarray:
    """A row for each pair of blocks and each band with the lines' keys: its number above 32 bits of content."""
    block = [(sim.view(_U) >> _U(16 * n)) & _U(0xFFFF) for n in range(BLOCKS)]
    content = [(block[a] << _U(16)) + block[b] for a, b in _PAIRS] + [b.view(np.uint32).astype(_U) for b in bands]
    return np.stack(content).view(np.int64) + (np.arange(len(content)) << 32)[:, None]


def _key_ranges(rows: DataFrame, value: str, n: int):
    """The postings of n lines (line, simhash, value, bands), grouped by range of hashed keys. A chunk of
    lines sends each range its postings once, as bytes: range, key, line, value."""
    ranges = max(1, -(-n * (len(_PAIRS) + BANDS) // RANGE))

    def run(batches):
        for batch in _text.released(batches):
            line, held, sim, *bands = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key = _keys(sim, bands)
            at = np.tile(np.arange(len(line)), len(key))
            key = key.ravel()
            place = (_text.mix(key.view(_U)) % _U(ranges)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            place, at = place[order], at[order]
            begin, _ = _bounds(place)
            ends = pa.py_buffer((8 * np.append(begin, len(place))).astype(np.int32).tobytes())
            packed = [pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, ends, pa.py_buffer(x.tobytes())]) for x in (key[order], line[at], held[at])]
            yield pa.RecordBatch.from_arrays([pa.array(place[begin]), *packed], ["range", "key", "line", "value"])

    return rows.select("line", F.col(value).alias("value"), "simhash", *_BANDS).mapInArrow(run, "range int, key binary, line binary, value binary").groupBy("range")


def _shared_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, line and value of a range's postings of two lines at least, by key."""
    key, line, value = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("key", "line", "value"))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.append(same, False) | np.append(False, same)
    order = order[shared]
    return key[shared], line[order], value[order]


def _whole_postings(batches):
    """The columns of rows sorted by key, cut where a posting ends."""
    carried = None
    for batch in _text.released(batches):
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carried:
            columns = [np.concatenate(c) for c in zip(carried, columns, strict=True)]
        else:
            columns = [c.copy() for c in columns]
        if len(columns[0]):
            cut = np.searchsorted(columns[0], columns[0][-1])
            yield [c[:cut] for c in columns]
            carried = [c[cut:] for c in columns]
    if carried:
        yield carried


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return begin, np.append(begin[1:], len(key))[: len(begin)]


def _most_bits(key: np.ndarray) -> np.ndarray:
    """In how many bits SimHashes of a posting may differ: by its key, of blocks or of a band."""
    return np.where(key >> 32 < len(_PAIRS), BITS, BAND_BITS)


def _pairs(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + u)), pa.array(np.concatenate(none + v))], ["u", "v"])


def _close_pairs(batches):
    """From key, line, simhash sorted by key: (u, v) of one posting whose SimHashes differ in at
    most _most_bits bits, where u is a leader."""
    for key, line, sim in _whole_postings(batches):
        sim = sim.view(_U)  # bits of a negative number are those of its absolute value
        begin, end = _bounds(key)
        two = begin[end - begin == 2]
        near = two[np.bitwise_count(sim[two] ^ sim[two + 1]) <= _most_bits(key[two])]
        u, v = [line[near]], [line[near + 1]]
        more = end - begin > 2
        for a, b, most in zip(begin[more], end[more], _most_bits(key[begin[more]]), strict=True):
            least = np.argsort(line[a:b])  # the same leaders in all postings
            line[a:b], sim[a:b] = line[a:b][least], sim[a:b][least]
            free = np.ones(b - a, bool)
            for i in range(b - a):
                if free[i]:
                    hit = np.flatnonzero(np.bitwise_count(sim[a:b] ^ sim[a + i]) <= most)
                    hit = hit[hit != i]
                    free[hit] = False
                    u.append(np.full(len(hit), line[a + i]))
                    v.append(line[a + hit])
        yield _pairs(u, v)


def _range_pairs(table: pa.Table) -> pa.Table:
    """_close_pairs of a range of postings with SimHashes."""
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in _shared_keys(table)], ["key", "line", "simhash"])
    return pa.Table.from_batches(_close_pairs([batch]), pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def _split_postings(table: pa.Table) -> pa.Table:
    """From a range of postings with components: key and line of those with several components."""
    key, line, component = _shared_keys(table)
    begin, end = _bounds(key)
    split = np.zeros(0, bool)
    if len(key):
        split = np.repeat(np.minimum.reduceat(component, begin) < np.maximum.reduceat(component, begin), end - begin)
    return pa.table({"key": pa.array(key[split]), "line": pa.array(line[split])})


def _joins(num: int, den: int):
    def run(batches):
        """From key, line, simhash, component, words sorted by key: (u, v), components of one posting
        that a similar pair of close lines joins. Of two components one isn't the posting's largest;
        its lines are compared with all others that are close and have met in no earlier key: of each
        component the nearest first, then the rest of those components that are still apart."""
        for key, sim, component, words, *bands in _whole_postings(batches):
            bands = np.column_stack(bands)
            sim = sim.view(_U)  # bits of a negative number are those of its absolute value
            length = np.array([len(x) for x in words])
            begin, end = _bounds(key)
            parent: dict[int, int] = {}
            tests, held = [], 0

            def root(c):
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            def settle():
                i, j, nearest = (np.concatenate(x) for x in zip(*tests, strict=True))
                for some in (nearest, ~nearest):
                    apart = np.array([root(x) != root(y) for x, y in zip(component[i[some]].tolist(), component[j[some]].tolist(), strict=True)], bool)
                    x, y = i[some][apart], j[some][apart]
                    good = similar_pairs([words[k] for k in x], [words[k] for k in y], num, den, False)
                    for c, d in zip(component[x[good]].tolist(), component[y[good]].tolist(), strict=True):
                        if root(c) != root(d):
                            parent[max(root(c), root(d))] = min(root(c), root(d))
                tests.clear()

            for a, b, most in zip(begin, end, _most_bits(key[begin]), strict=True):
                names, own, n = np.unique(component[a:b], return_inverse=True, return_counts=True)
                for i in np.flatnonzero(own != n.argmax()):
                    differ = sim[a:b] ^ sim[a + i]
                    bits = np.bitwise_count(differ)
                    hit = np.flatnonzero((bits <= most) & (own != own[i]))
                    if not len(hit):
                        continue
                    differ, bits, size = differ[hit], bits[hit], length[a + hit]
                    number = int(key[a] >> 32)
                    blocks = [(differ >> _U(16 * n)) & _U(0xFFFF) == 0 for n in range(BLOCKS)]
                    met = bits <= BITS if number >= len(_PAIRS) else np.any([blocks[p] & blocks[q] for p, q in _PAIRS[:number]], axis=0)
                    met = met | (bands[a + hit, : max(0, number - len(_PAIRS))] == bands[a + i, : max(0, number - len(_PAIRS))]).any(axis=1)
                    new = ~met & (np.abs(size - length[a + i]) * den <= np.maximum(size, length[a + i]) * (den - num))
                    hit, bits = hit[new], bits[new]
                    hit = hit[np.lexsort((bits, own[hit]))]
                    nearest = np.append(True, own[hit][1:] != own[hit][:-1])[: len(hit)]
                    tests.append((np.full(len(hit), a + i), a + hit, nearest))
                    held += len(hit)
                if held > 1 << 18:
                    settle()
                    held = 0
            if tests:
                settle()
            yield _pairs([np.array(list(parent), np.int64)], [np.array([root(c) for c in parent], np.int64)])

    return run


def _characters(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")


def _distance(a: str, b: str, allowed: int) -> int:
    """The edit distance, or more than `allowed` if it is more: bit-parallel columns of the distance
    matrix (differences of +1 and -1 as bits of two numbers), given up when the rest can't bring it
    back."""
    rows = len(a)
    if not rows:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << rows) - 1, 1 << (rows - 1)
    up, down, d, left = full, 0, rows, len(b)
    for c in b:
        x = at.get(c, 0) | down
        diagonal = ((((x & up) + up) ^ up) | x) & full
        right = down | (full & ~(diagonal | up))
        drop = up & diagonal
        if right & top:
            d += 1
        elif drop & top:
            d -= 1
        left -= 1
        if d - left > allowed:
            return d - left
        right, drop = (right << 1) | 1, drop << 1
        up = (drop | (full & ~(diagonal | right))) & full
        down = right & diagonal & full
    return d


def _ends_cut(a: str, b: str) -> tuple[str, str]:
    """Both without what both begin and end with."""
    x, y = _characters(a), _characters(b)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    begin = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[begin:][::-1][: n - begin] != y[begin:][::-1][: n - begin])
    end = int(differ[0]) if len(differ) else n - begin
    return a[begin : len(a) - end], b[begin : len(b) - end]


def _word_by_word(a: str, b: str, allowed: int) -> bool:
    """Whether replacing words by those at their places, and leaving out one run of the longer line's
    words, takes `allowed` edits at most. The edit distance is no more than that."""
    p, q = a.split(" "), b.split(" ")
    if len(p) > len(q):
        p, q = q, p
    more = len(q) - len(p)
    if not more:
        return sum(max(len(c), len(d)) for c, d in zip(p, q, strict=True) if c != d) <= allowed
    before = [0 if c == d else max(len(c), len(d)) for c, d in zip(p, q, strict=False)]
    after = [0 if c == d else max(len(c), len(d)) for c, d in zip(p, q[more:], strict=True)]
    size = [len(c) + 1 for c in q]
    total = least = sum(after) + sum(size[:more])
    for i in range(len(p)):  # the run begins one word later
        total += before[i] - after[i] + size[i + more] - size[i]
        least = min(least, total)
    return least <= allowed


def _aligned(a: str, b: str, allowed: int) -> int:
    """An upper bound of the edit distance, or more than `allowed` if the bound is: words that occur
    once in each line are matched where they are in the same order, and the distances of what lies
    between two of them are added up."""

    def once(line):
        found, place = {}, 0
        for word in line.split(" "):
            found[word] = None if word in found else place
            place += len(word) + 1
        return found

    first, second = once(a), once(b)
    common = [(p, second[w], len(w)) for w, p in first.items() if p is not None and second.get(w) is not None]
    ends: list[int] = []  # longest increasing run of places in b
    chain: list[int] = []
    before = [-1] * len(common)
    for k, (_, q, _) in enumerate(common):
        j = bisect_left(ends, q)
        before[k] = chain[j - 1] if j else -1
        if j == len(ends):
            ends.append(q)
            chain.append(k)
        else:
            ends[j], chain[j] = q, k
    k, total, p_end, q_end = (chain[-1] if chain else -1), 0, len(a), len(b)
    while total <= allowed:
        p, q, n = common[k] if k >= 0 else (0, 0, 0)
        x, y = a[p + n : p_end], b[q + n : q_end]
        if x != y:
            total += _distance(x, y, allowed - total)
        if k < 0:
            break
        p_end, q_end, k = p, q, before[k]
    return total


def _distances(a: list[str], b: list[str], allowed: int | np.ndarray | None = None) -> np.ndarray:
    """The edit distances of pairs of non-empty texts, as _distance, but for all pairs at a time.
    With `allowed` (one for all or one for each), only blocks of the matrix within that many cells of
    its diagonal are computed: distances up to it are exact, others more than it. A pair is given up
    once the diagonal that ends in its distance exceeds what it is allowed, as that never falls."""
    first, second = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    order = np.argsort(-second, kind="stable")  # the columns of the longest are computed last
    a, b, first, second = [a[k] for k in order], [b[k] for k in order], first[order], second[order]
    limit = None if allowed is None else np.broadcast_to(allowed, len(a))[order]
    n, blocks, columns = len(a), -(-int(first.max()) // 64), int(second[0])
    code = np.concatenate([_characters("".join(a)), _characters("".join(b))])
    occurs = np.zeros(int(code.max()) + 1, bool)
    occurs[code] = True
    letters, code = np.flatnonzero(occurs), (np.cumsum(occurs) - 1)[code]
    if n > 1 and n * len(letters) * blocks > 1 << 22:  # 32 MB
        out, half = np.empty(n, np.int64), n // 2
        parts = (slice(None, half), slice(half, None))
        out[order] = np.concatenate([_distances(a[x], b[x], None if limit is None else limit[x]) for x in parts])
        return out
    pair = np.repeat(np.arange(n), first)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(first) - first, first)
    # Places are distinct, so their bits add up, exactly in 32 bits of a float.
    half = (pair * len(letters) + code[: len(pair)]) * (2 * blocks) + (place >> 5)
    at = np.bincount(half, np.ldexp(1.0, place & 31), n * len(letters) * 2 * blocks).astype(np.uint32).view(_U).reshape(n * len(letters), blocks)
    text = np.zeros((columns, n), np.int64)
    text[np.arange(int(second.sum())) - np.repeat(np.cumsum(second) - second, second), np.repeat(np.arange(n), second)] = code[len(pair) :]
    up, down = np.full((blocks, n), ~_U(0)), np.zeros((blocks, n), _U)
    text += np.arange(n) * len(letters)
    one, reach = _U(1), max(columns, int(first.max())) if limit is None else int(limit.max())
    open_ = n - np.searchsorted(second[::-1], np.arange(columns), side="right")

    def score(rows, t):
        """The distances of the first `rows` characters of each a and the first t of b."""
        inside = np.clip(rows[None, :] - 64 * np.arange(blocks)[:, None], 0, 64)
        mask = np.where(inside == 64, ~_U(0), (one << (inside % 64).astype(_U)) - one)
        return t + np.bitwise_count(up & mask).sum(axis=0, dtype=np.int64) - np.bitwise_count(down & mask).sum(axis=0, dtype=np.int64)

    out = np.empty(n, np.int64)
    for t in range(columns):
        if limit is not None and t and t % GIVE_UP == 0:
            ends = np.minimum(second, t)
            now = score(np.maximum(ends + first - second, 0), ends)
            keep = now <= limit
            if 8 * (len(keep) - keep.sum()) >= len(keep):  # else it isn't worth a copy
                out[order[~keep]] = now[~keep]
                order, first, second, limit, text = order[keep], first[keep], second[keep], limit[keep], text[:, keep]
                if not len(order):
                    return out
                up, down = up[:, keep], down[:, keep]
                open_ = len(order) - np.searchsorted(second[::-1], np.arange(columns), side="right")
        k = open_[t]
        if not k:
            break
        low, high = max(0, t - reach) >> 6, min(blocks, (t + reach >> 6) + 1)
        x, vp, vn = at.take(text[t, :k], axis=0)[:, low:high].T, up[low:high, :k], down[low:high, :k]
        x = x | vn
        diagonal = (x & vp) + vp
        carry = (diagonal < vp)[:-1]
        while carry.any():  # of a block's sum to the next block; twice only if all of its bits are set
            diagonal[1:] += carry
            carry = np.append(np.zeros((1, k), bool), (carry & (diagonal[1:] == 0))[:-1], axis=0)
        diagonal ^= vp
        diagonal |= x
        right, drop = vn | ~(diagonal | vp), vp & diagonal
        shifted, dropped = right << one, drop << one
        shifted[0] |= one
        shifted[1:] |= right[:-1] >> _U(63)
        dropped[1:] |= drop[:-1] >> _U(63)
        up[low:high, :k] = dropped | ~(diagonal | shifted)
        down[low:high, :k] = shifted & diagonal
    out[order] = score(first, second)
    return out


def similar_pairs(a: list[str], b: list[str], num: int, den: int, likely: bool = True) -> np.ndarray:
    """For each pair whether 1 - edit distance / longer length >= num / den. Pairs of up to MANY
    characters are worked many at a time; if they are few or longer, each is. If similarity is
    likely, pairs that can be told by whole words are accepted first, and of those that are worked
    each alone, most by an alignment at common words."""
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    shortest = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    allowed = longest * (den - num) // den
    out = (longest == shortest) & (longest == 0)
    todo = np.flatnonzero((longest - shortest <= allowed) & (shortest > 0))
    if likely:
        out[todo] = [_word_by_word(a[k], b[k], m) for k, m in zip(todo.tolist(), allowed[todo].tolist(), strict=True)]
        todo = todo[~out[todo]]
    todo = todo[np.argsort(longest[todo], kind="stable")]
    alone = todo[longest[todo] > MANY]
    todo = todo[: len(todo) - len(alone)]
    at = 0
    while at < len(todo):
        alike = np.searchsorted(longest[todo], longest[todo[at]] * 5 // 4, side="right") - at
        end = at + min(1024, max(128, int(alike)))
        end = len(todo) if len(todo) - end < FEW else end
        now, at = todo[at:end], end
        if len(now) < FEW and longest[now[-1]] > MANY // 16:
            alone = np.append(alone, now)
            continue
        out[now] = _distances([a[k] for k in now], [b[k] for k in now], allowed[now]) <= allowed[now]
    for k in alone:
        x, y = _ends_cut(a[k], b[k])
        most = int(allowed[k])
        out[k] = max(len(x), len(y)) <= most or (likely and _aligned(x, y, most) <= most) or _distance(x, y, most) <= most
    return out


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose lines have the edit similarity."""
    checked = pairs.join(texts.select(F.col("line").alias("u"), F.col("words").alias("a")), "u").join(texts.select(F.col("line").alias("v"), F.col("words").alias("b")), "v")

    def run(batches):
        for batch in _text.released(batches):
            good = similar_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), num, den)
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return checked.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def duplicate_lines(docs: DataFrame, num: int = 80, den: int = 100, min_words: int = 5) -> DataFrame:
    """doc_id and drop, the sorted line numbers that another occurrence stands for, as a table."""
    signed = _store.table(lines(docs.filter("doc_id is not null"), min_words), "line-signatures")
    place = F.struct("doc_id", "line_no")
    distinct = signed.groupBy("line").agg(*[F.first(c).alias(c) for c in ("fuzzy", "simhash", *_BANDS)], F.min(place).alias("first"), F.count("*").alias("n"))
    distinct = _store.table(distinct, "distinct-lines")
    found = _store.table(signed.select("doc_id", "line_no", "line"), "lines")
    _store.discard(signed)
    fuzzy = distinct.filter("fuzzy")
    pairs = _key_ranges(fuzzy, "simhash", fuzzy.count()).applyInArrow(_range_pairs, "u long, v long")
    pairs = _store.table(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "line-pairs")
    candidates = pairs.select(F.col("u").alias("line")).union(pairs.select(F.col("v").alias("line"))).distinct()
    candidates = _store.table(candidates, "candidates")
    texts = _store.with_ids(_normal_lines(docs), candidates, "line", "left_semi")
    texts = _store.table(texts.groupBy("line").agg(F.min("words").alias("words")), "line-texts")
    groups = _store.table(components(_verified(pairs, texts, num, den)), "line-groups")
    # A reached line led no more, whether or not its pair was verified. Where a posting's lines are
    # in several groups by now, they meet again, so no close pair is left out.
    again = distinct.join(candidates, "line").join(groups.withColumnRenamed("id", "line"), "line", "left")
    again = _store.table(again.select("line", "simhash", F.coalesce("component", "line").alias("component"), *_BANDS), "candidate-lines")
    split = _key_ranges(again, "component", again.count()).applyInArrow(_split_postings, "key long, line long")
    again_texts = split.join(again, "line").join(texts, "line").select("key", "simhash", "component", "words", *_BANDS)
    joins = again_texts.repartition("key").sortWithinPartitions("key").mapInArrow(_joins(num, den), "u long, v long")
    merged = components(joins).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    named = distinct.select("line", "first", "n").join(groups.select(F.col("id").alias("line"), "component"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    named = named.join(merged, "component", "left").select("line", "first", "n", F.coalesce("whole", "component").alias("component"))
    kept = named.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).filter("n > 1")
    kept = named.join(kept.drop("n"), "component").select("line", "keep")
    gone = found.join(kept, "line").filter(place != F.col("keep"))
    drop = _store.table(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("drop")), "drop")  # line numbers of one document
    _store.discard(distinct, found, pairs, candidates, texts, again)
    return drop


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100, min_words: int = 5, counts: str | None = "lines") -> DataFrame:
    """docs with duplicate lines removed from text, and a column named by `counts`, if it isn't None:
    (n_lines, n_removed). A column of docs with that name gives way; any other name may occur.

    Lines are separated by newlines. Normalised, A-Z are lower-cased, digits are 0, ASCII
    punctuation is space, and runs of space are one. Lines of fewer than min_words words link with those of the
    same text only (but for white space); blank lines stay. Other lines link if 1 - edit distance /
    longer length >= num / den (characters of the normalised lines) and their SimHashes differ in at
    most 2 bits, or in at most 20 and they share a band; equal normalised lines always do. The
    occurrence with the smallest (doc_id, line number) of a group stays. All rows stay, a text may
    become empty; null texts stay null with 0 lines. Rows that share an id lose the same lines.
    Rows with a null id lose nothing. Empty tables give no rows.
    """
    drop = duplicate_lines(docs.select(F.col("doc_id").cast("long"), "text"), num, den, min_words)
    names, at = docs.columns, docs.columns.index("text")
    labels = [f"c{k}" for k in range(len(names))]  # so that no name clashes below
    plain = docs.toDF(*labels)
    rows = plain.join(drop.select(F.col("doc_id").alias("id"), "drop").hint("merge"), plain[f"c{names.index('doc_id')}"] == F.col("id"), "left").drop("id")

    def run(batches):
        for whole in _text.released(batches):
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                out, gone = batch.column(at), batch.column(batch.num_columns - 1)
                n = pc.if_else(pc.is_valid(out), pc.add(pc.cast(pc.count_substring(_text.string_column(out), "\n"), pa.int64()), 1), 0)
                lost = np.flatnonzero(pc.is_valid(gone).to_numpy(zero_copy_only=False))
                if len(lost):
                    texts = out.to_pylist()
                    for k in lost:
                        skip = set(gone[k].as_py())
                        texts[k] = None if texts[k] is None else "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in skip)
                    out = pa.array(texts, pa.string())
                n_removed = pc.fill_null(pc.cast(pc.list_value_length(gone), pa.int64()), 0)
                columns = [out if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays([n, n_removed], ["n_lines", "n_removed"])], [*labels, "counts"])

    kind = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = rows.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("counts", kind)]))
    kept = [F.col(f"c{k}").alias(n) for k, n in enumerate(names) if counts is None or n.lower() != counts.lower()]
    return done.select(*kept, *([F.col("counts").alias(counts)] if counts else []))
