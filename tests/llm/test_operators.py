"""The llm operators against brute force, with nulls, empty texts, repeats and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimworks.llm import components, fingerprints, html_extract, jaccard_join, langid, line_dedup, lm_scoring, metric_topk, mixing, packing, toxicity
from claimworks.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()


def text(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    long = text(1, 3000)
    rows = [(1, long, "a"), (2, long, "a"), (3, long.replace("alpha", "ALPHA", 5) + " end", "b"), (4, None, None), (5, "", "b"), (6, "one", "b"), (7, "one two", "c"), (8, text(2, 80) + "\n" + text(3, 12), "c"), (9, text(4, 50) + "\n" + text(3, 12), None), (10, "Ünïcödé 日本語 🙂 " + text(5, 30), "a")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, taken int")


def empty(docs):
    return docs.filter("false")


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (None, 1), (8, 7)], "u long, v long")
    assert {(r["id"], r["component"]) for r in components.components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (9, 3), (7, 7), (8, 7)}
    assert components.components(edges.filter("false")).count() == 0


def test_packing_covers_every_id(docs):
    rows = packing.pack(docs, tokenizer_path(), max_tokens=256, open_windows=2).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1]]
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
        assert sum(r["length"] for r in mine) == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        mine = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1]] and sum(r["length"] for r in mine) <= 256
    assert packing.pack(empty(docs), tokenizer_path()).count() == 0


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 10 and all(r["taken"] <= 2 * r["size"] for r in rows)
    source = {d["doc_id"]: d["source"] for d in docs.collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert mixing.mix(empty(docs)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(taken.values())


def brute_components(docs, k, num, den):
    sets = {}
    for d in docs:
        w = (d["text"] or "").encode().lower().split()
        sets[d["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and den * common >= num * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_matches_brute_force(spark, docs, k, num):
    base = [text(100 + i // 6, 120).split() for i in range(36)]
    r = np.random.default_rng(0)
    for i, w in enumerate(base):
        for at in r.integers(0, 120, i % 6):
            base[i][at] = f"edit{i}"
    more = spark.createDataFrame([(100 + i, " ".join(w), "s", "x", 1) for i, w in enumerate(base)], docs.schema)
    everything = docs.union(more)
    rows = jaccard_join.jaccard_components(everything, k, num, 100, group_rows=2).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == brute_components(everything.collect(), k, num, 100)
    assert jaccard_join.jaccard_components(empty(docs)).count() == 0


def test_jaccard_links_chains_in_one_part(spark, docs):
    """Sliding windows, in an order in which no leader reaches both documents of the middle link."""
    starts = {1: 0, 2: 12, 3: 4, 4: 8}
    windows = [(10 * family + i, " ".join(f"f{family}w{n}" for n in range(at, at + 102)), "s", "x", 1) for family in range(12) for i, at in starts.items()]
    everything = spark.createDataFrame(windows, docs.schema)
    expected = brute_components(everything.collect(), 3, 90, 100)
    assert len({root for _, root in expected.values()}) == 12
    rows = jaccard_join.jaccard_components(everything, 3, 90, 100).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == expected


def test_line_dedup(docs):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert rows[8]["text"].count("\n") == 1 and rows[9]["text"].count("\n") == 0  # the shared line stays once
    assert rows[1]["lines"]["n_removed"] == 0 and rows[2]["text"] == "" and rows[4]["text"] is None
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_line_dedup_beyond_a_leader(spark):
    """Lines of one bag of words have one SimHash; whichever leads, similar orders link."""
    turned = [" ".join(chr(97 + n) * 5 + chr(97 + family) for n in order) for family in range(8) for order in (range(12), [*range(6, 12), *range(6)], [*range(6, 12), *range(4), 5, 4], [11, 10, 9, 8, 7, 6, 0, 5, 1, 4, 2, 3])]
    df = spark.createDataFrame(list(enumerate(turned)), "doc_id long, text string")
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(df).collect() if r["text"] == ""}
    assert gone == {4 * family + 2 for family in range(8)}  # only the second and third order are similar


def test_line_postings_across_batches():
    import pyarrow as pa

    sim = np.array([0, 3, 0b11000, 3 | 0b11000], np.int64)  # 0-3, 0-24, 3-27, 24-27 are close
    rows = pa.RecordBatch.from_arrays([pa.array([5] * 4), pa.array([1, 2, 3, 4]), pa.array(sim)], ["key", "line", "simhash"])
    for cut in range(5):
        got = line_dedup._close_pairs(iter([rows.slice(0, cut), rows.slice(cut)]))
        assert {frozenset(p.values()) for b in got for p in b.to_pylist()} == {frozenset(p) for p in ((1, 2), (1, 3), (2, 4), (3, 4))}


def test_line_dedup_changed_words_and_short_lines(spark):
    r = np.random.default_rng(7)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, 6))
    rows = []
    for n in (10, 20, 30, 50) * 5:
        line = [word() for _ in range(n)]
        other = line.copy()
        other[n // 2] = word()
        rows += [" ".join(line), " ".join(other)]
    df = spark.createDataFrame(list(enumerate([*rows, "Short one", " Short one", "Page 3", "Page 4", " \n\t"])), "doc_id long, text string")
    gone = {x["doc_id"] for x in line_dedup.dedup_lines(df).collect() if x["lines"]["n_removed"]}
    assert gone == {*range(1, 40, 2), 41}


def test_language(spark):
    rows = [(i, text(i, 40) if i % 2 else " ".join(w[::-1] for w in text(i, 40).split()), "up" if i % 2 else "down") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.filter("doc_id < 30"))
    got = langid.predict(df, model, "doc_id", "lang").collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(None,), ("",), ("12 !?",)], "text string")
    assert {r["lang_pred"] for r in langid.predict(odd, model).collect()} == {"und"}
    assert langid.learn(df.filter("false")).languages == []


def test_toxicity(spark):
    rows = [(i, text(i, 40) + (" vilestword badness" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.fit(df, labels), "doc_id").collect()}
    assert got == {i: int(i % 4 == 0) for i in range(200)}
    assert {r["predicted"] for r in toxicity.score(df, toxicity.fit(df, labels.filter("false")), "doc_id").collect()} == {0}


def test_fingerprints(docs):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, 3).collect()}
    texts = {d["doc_id"]: d["text"] or "" for d in docs.collect()}
    order = sorted(texts, reverse=True)
    import hashlib

    for d, following in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[d]) // 3
        new = texts[d][: len(texts[d]) - n] + texts[following][:n]
        assert rows[d]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and rows[d]["n_chars"] == len(texts[d])
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] and rows[2]["near_next"] == 1.0
    assert fingerprints.fingerprints(empty(docs)).count() == 0


def test_fingerprints_of_unequal_texts():
    r = np.random.default_rng(3)
    letters = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    for _ in range(40):
        long = letters(9000)
        assert fingerprints.Sketch.of(long[500:607]).containment(fingerprints.Sketch.of(long)) == 1.0
    ordinary = fingerprints.Sketch.of(letters(2000))
    assert ordinary.limit == 2**61 and len(ordinary.hashes) > 150  # the fixed fraction, not the smallest 64
    assert fingerprints.Sketch(2**60, np.array([2**59], np.uint64)).containment(fingerprints.Sketch(2**58, np.array([], np.uint64))) == 1.0  # nothing is left of either


def test_html(spark):
    def page(i):
        return f'<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>Title {i}</h1><p>One &amp; two<br>three<p>{text(i, 9)}</article><section id="comments"><article>No!</article></section><footer>&copy; x</footer>'

    rows = [(i, "http://a.example/x", page(i)) for i in range(5)] + [(9, None, None), (10, "::bad", "<p>plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {**{i: f"Title {i} One & two three {text(i, 9)}" for i in range(5)}, 9: "", 10: "plain"}
    assert html_extract.extract(df.filter("false")).count() == 0
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df, most_hosts=0).collect()} == got


def test_html_of_copies(spark):
    rows = [(i, "http://copies.example/x", f"<html><body><div>Only {'text' if i < 4 else 'words'}</div></body></html>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == {i: f"Only {'text' if i < 4 else 'words'}" for i in range(6)}
    same = df.filter("page_id < 4")
    assert {r["text"] for r in html_extract.extract(same).collect()} == {"Only text"}


def test_metric_topk(spark):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(400, 6)), 2)
    x[50:90] = x[0]
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(500, None), (550, [float("nan")] * 6), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for t in metric_topk.top_k(df, routes=4, page_rows=32, leaf_rows=8).collect():
        got.setdefault(t["query_id"], []).append((t["rank"], t["vec_id"], t["score"]))
    q = np.floor(x * 256).astype(int)
    for i in range(0, 400, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(400) if j != i))[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert set(got) == set(range(0, 400, 50))


def test_lm_bounds_change_nothing(docs):
    a = {r["doc_id"]: tuple(r) for r in lm_scoring.stupid_backoff(docs).collect()}
    b = {r["doc_id"]: tuple(r) for r in lm_scoring.stupid_backoff(docs, chunk_bytes=50, part_bytes=70).collect()}
    assert a.keys() == b.keys() and all(a[k][:3] == b[k][:3] and abs(a[k][3] - b[k][3]) < 1e-3 for k in a)
    assert a[4][1:] == (0, 0, 0.0) and a[1][1:] == a[2][1:]
    assert lm_scoring.stupid_backoff(empty(docs)).count() == 0
