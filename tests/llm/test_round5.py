"""Tests of round 3's findings on op5 and op3."""

import numpy as np

from claimworks.llm import _store, jaccard_join, line_dedup


def test_jaccard_documents_ask_and_are_asked_where_they_were_dealt(spark, monkeypatch):
    """Check of op5: in a large group of near copies, leaders of other parts aren't looked for in all of those parts."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            words[at] = f"c{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for _, t in rows for w in [t.split()]]
    component = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                u, v = component[a], component[b]
                component = [min(u, v) if c in (u, v) else c for c in component]
    held, table = {}, _store.table

    def spied(df, name):
        held[name] = table(df, name)
        return held[name]

    monkeypatch.setattr(_store, "table", spied)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 3, 90, 100, group_rows=8).collect()}
    assert got == dict(enumerate(component)) and 1 < len(set(component)) < len(rows)
    unsettled = held["unsettled"].select("key", "doc_id").collect()
    assert len(unsettled) == len(set(unsettled)) > 0


def test_pairs_told_by_whole_words_need_no_distances(monkeypatch):
    """Check of op3: lines with some words replaced, and a run of words left out, are accepted without a matrix; no bound is below the distance."""
    rng = np.random.default_rng(12)
    a = [" ".join("abcdefgh"[c] * 3 + str(c) for c in rng.integers(0, 8, n)) for n in rng.integers(8, 60, 200)]
    b = []
    for n, line in enumerate(a):
        words = line.split(" ")
        for at in rng.integers(0, len(words), n % 4 * len(words) // 12):
            words[at] = "zz"
        begin = int(rng.integers(0, len(words)))
        b.append(" ".join(words[:begin] + words[begin + n % 3 :]))
    exact = [line_dedup._distance(x, y, 10**6) for x, y in zip(a, b, strict=True)]
    bound = [next(m for m in range(10**4) if line_dedup._word_by_word(x, y, m)) for x, y in zip(a, b, strict=True)]
    assert all(d <= m for d, m in zip(exact, bound, strict=True))
    similar = [5 * d <= max(len(x), len(y)) for d, x, y in zip(exact, a, b, strict=True)]
    assert line_dedup.similar_pairs(a, b, 80, 100).tolist() == similar and 20 < sum(similar) < 180
    told = [n for n in range(200) if 5 * bound[n] <= max(len(a[n]), len(b[n]))]
    monkeypatch.setattr(line_dedup, "_distances", None)
    monkeypatch.setattr(line_dedup, "_distance", None)
    assert len(told) > 20 and line_dedup.similar_pairs([a[n] for n in told], [b[n] for n in told], 80, 100).all()


def test_distances_with_a_limit_for_each_pair():
    """Pairs that are given up early are beyond their limit, those that stay have their exact distance."""
    rng = np.random.default_rng(13)
    a = ["".join("abcdeé"[c] for c in rng.integers(0, 6, n)) for n in rng.integers(1, 400, 150)]
    b = ["".join(c for c in x if rng.random() > 0.4 * (n % 5) / 5) + "z" * (n % 7) for n, x in enumerate(a)]
    b = [y or "z" for y in b]
    exact = np.array([line_dedup._distance(x, y, 10**6) for x, y in zip(a, b, strict=True)])
    for share in (0.0, 0.1, 0.2, 0.6):
        limit = np.array([int(share * max(len(x), len(y))) for x, y in zip(a, b, strict=True)])
        got = line_dedup._distances(a, b, limit)
        assert (got[exact <= limit] == exact[exact <= limit]).all() and (got[exact > limit] > limit[exact > limit]).all()
