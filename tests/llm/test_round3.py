"""Alignment, token counts, hard negatives and the Jaccard join against brute force and odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from claimworks.llm import alignment, hard_negatives, jaccard_join, token_counts

A, B, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> and <s> </s>", "naïve café — 東京タワー 🙂🙂", "▁ low line", "x" * 700, "tab\tand\nline\r\n", "=" * 99 + "-" * 50, "élève", "\x00\x01 control", "same same same same"]


def texts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain_alignment(docs):
    """The contract, one text and one byte at a time."""
    a, b, library = alignment.ByteLevel(A), alignment.Pieces(B), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    parts = {}
    for doc, text in docs:
        wanted = (" " + (text or "")).encode()
        x, y = library.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode([text or ""])[0]
        if not text or b"".join(a.bytes[i] for i in x) != wanted or b"".join(b.bytes[i] for i in y) != wanted:
            parts[doc] = []
            continue
        ends = []
        for side, ids in ((a, x), (b, y)):
            at, own = 0, []
            for i in ids:
                at += len(side.bytes[i])
                own.append(at)
            ends.append(own)
        common, found, i, j = sorted({*ends[0]} & {*ends[1]}), [], 0, 0
        for c in common:
            m, n = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            found.append((x[i:m], y[j:n]))
            i, j = m, n
        parts[doc] = found
    count = Counter(pair for found in parts.values() for pair in {(p, q) for xs, ys in found for p in xs for q in ys})
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = {}
    for doc, found in parts.items():
        links = [(p, q) for xs, ys in found for p in xs for q in ys]
        digest = hashlib.sha256(";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in found).encode()).hexdigest() if found else ""
        out[doc] = (sum(len(xs) for xs, _ in found), sum(len(ys) for _, ys in found), len(found), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest)
    return out


def aligned(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("chunk_bytes", [1_000, 32_000_000])
def test_alignment_equals_the_contract(spark, chunk_bytes):
    docs = [(r["doc_id"], r["text"]) for r in texts(spark, "/root/testdata/sf0.001").collect()][:60]
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)]
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, pair int, chunk string").repartition(5)
    got = aligned(alignment.align(rows, A, B, chunk_bytes))
    assert got == plain_alignment(docs)
    assert got[10_000] == got[10_001] == got[10_007] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_repeated_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "one text")], "doc_id long, text string")
    got = [tuple(r)[1:] for r in alignment.align(rows, A, B).collect()]
    assert len(got) == 3 and len({*got}) == 1 and got[0][5] == 3 * got[0][3]
    assert alignment.align(rows.limit(0), A, B).collect() == []


def test_ranks_give_the_library_s_tokens():
    own, library = alignment.ByteLevel(A), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    letters = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x10000, 0x110000, 0x101)]
    some = [f" a{c}b1{c} {c}{c}.{c}" for c in letters] + [t for t in ODD if t]
    assert own.fast is not None
    assert [x.tolist() for x in own.encode(some)] == [library.encode(" " + t, add_special_tokens=False).ids for t in some]


def test_groups_end_where_both_end():
    start, end = [0, 3, 5, 0, 2, 5, 6], [3, 5, 8, 2, 5, 6, 8]
    import numpy as np

    assert alignment.groups(np.array(start), np.array(end), np.array([0, 0, 0, 1, 1, 1, 1])).tolist() == [0, 0, 1, 0, 0, 1, 1]


def whole(path, text):
    """The plain library."""
    if path.endswith(".model"):
        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [WORDS, A, B])
def test_token_counts_of_spliced_chunks(spark, path):
    r, docs = random.Random(3), [t for t in ODD]
    prose = " ".join(x["text"] or "" for x in texts(spark, "/root/testdata/sf0.001").limit(40).collect())
    docs += [prose[:9_000], prose[200:30_000]]
    alphabet = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "'s", "12", "東", "🙂", "<|endoftext|>", "<|startoftext|>", "<s>", "=", "▁", "_" * 30]
    docs += ["".join(r.choice(alphabet) for _ in range(n)) for n in (50, 300, 2_000, 5_000)]
    docs += ["z" * 3_000, "y" * 900 + " end", " " * 2_000, "<|endoftext|>" * 200, "東" * 1_500]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(docs)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {x["doc_id"]: x for x in token_counts.count_tokens(rows, path, limit=100, stride=300, overlap=60).collect()}
    assert {i: x["n_tokens"] for i, x in got.items()} == {i: whole(path, t) for i, t in enumerate(docs)}
    assert all(x["n_bytes"] == len((docs[i] or "").encode()) and x["over_limit"] == (x["n_tokens"] > 100) for i, x in got.items())


def test_words_have_the_texts_tokens():
    own, library = token_counts.JsonEncoder(WORDS), Tokenizer.from_file(WORDS)
    r, letters = random.Random(9), [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x10000, 0x110000, 0x101)]
    some = [f"a{c}b {c} {c}{c}É{c}\n{c}" for c in letters] + ["".join(r.choices([*letters[:600], " ", " ", "ΟΔΟΣ", "<|endoftext|>", "\u0301"], k=60)) for _ in range(300)]
    assert own.drops_space and not token_counts.JsonEncoder(A).drops_space
    for _ in range(2):
        assert own.counts(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_token_counts_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["n_bytes"], x["n_tokens"]) for x in token_counts.count_tokens(rows, WORDS).collect())
    assert got == [(0, 0, 0), (1, 3, 2), (1, 3, 2)]
    assert token_counts.count_tokens(rows.limit(0), WORDS).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(rows, WORDS, overlap=5)


def plain_negatives(rows, every=100, n=5, k=5):
    import math

    use = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            new = (label, len(v), [math.floor(256 * x) for x in v])
            use[i] = min(use.get(i, new), new)
    out = set()
    for a, (label, dims, q) in use.items():
        if a % every:
            continue
        scored = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(q, w[2], strict=True)))), i) for i, w in use.items() if i != a and w[1] == dims)
        for s, p in [x for x in scored if use[x[1]][0] == label][:n]:
            window = [(t, i) for t, i in scored if use[i][0] != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(window, 1)}
    return out


def mined(df):
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(got) == len({*got})
    return {*got}


@pytest.mark.parametrize(("dims", "scale", "block"), [(1, 1.0, 7), (3, 0.02, 50), (2, 1e7, 16_384), (4, 5e6, 64), (4, 3e14, 64)])
def test_hard_negatives_equal_brute_force(spark, dims, scale, block):
    r = random.Random(dims)
    rows = [(i, r.choice([0, 0, 0, 1, 2]), [r.uniform(-1, 1) * scale for _ in range(dims)]) for i in range(400)]
    rows += [(i, r.choice([0, 1]), rows[i % 9][2]) for i in range(400, 520)]  # equal vectors
    rows += [(600, None, [1.0] * dims), (700, 1, None), (800, 1, [None] * dims), (900, 1, [float("nan")] * dims), (1000, 9, [1.0] * dims), (1100, 1, [2.0] * (dims + 1)), (1101, 1, [2.0] * (dims + 1)), (1102, 0, [1.9] * (dims + 1)), (None, 1, [1.0] * dims), (5, 2, [0.5] * dims)]
    table = spark.createDataFrame([(*x, "e", 1) for x in rows], "vec_id long, label int, embedding array<double>, score string, dims int").repartition(3)
    got = mined(hard_negatives.mine(table, block_rows=block))
    assert got == plain_negatives(rows) and got


def test_hard_negatives_of_no_rows(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(table).collect() == []


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_spares_common_keys_but_no_link(spark, k, num):
    """Many texts of all sizes share passages; near copies among them differ in few words, or
    hold hardly anything but a passage."""
    rng = np.random.default_rng(k)
    passages = [[f"p{j}x{i}" for i in range(size)] for j, size in enumerate((9, 25, 60))]
    rows = []
    for i in range(150):
        passage = passages[i % 3]
        own = [f"w{w}" for w in rng.integers(0, 10**6, int(rng.integers(0, 90)) if i % 5 else int(rng.integers(0, 4)))]
        for copy in range(1 + (i % 4 == 0)):
            words = [*own[: len(own) // 2], *passage, *own[len(own) // 2 :]]
            for at in rng.integers(0, len(words), copy * (1 + len(words) // 60)):
                words[at] = f"c{i}"
            rows.append((len(rows) if i % 10 else 3, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    links = {}

    def root(x):
        while links.setdefault(x, x) != x:
            x = links[x]
        return x

    sets = [(d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}) for d, t in rows for w in [t.split()]]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 100 * len(x & y) >= num * len(x | y):
                u, v = sorted((root(a), root(b)))
                links[v] = u
    for group_rows in (2, 512):
        got = jaccard_join.jaccard_components(docs, k, num, 100, group_rows=group_rows).collect()
        assert len(got) == len(rows) and all(r["component_id"] == root(r["doc_id"]) for r in got)
    assert len({root(d) for d, _ in rows}) < len({d for d, _ in rows}) - 10
