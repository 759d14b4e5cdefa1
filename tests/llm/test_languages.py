"""Language identification against exact n-gram sets, with many languages, ties and odd rows."""

import json
import random
from collections import Counter

import numpy as np
import pytest

from claimworks.llm import langid


def invented(r, n, letters):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(n))


def grams(text):
    """4-grams of the letters, A-Z lower-cased, whose two inner bytes are letters."""
    b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    b = b"  " + b + b"  "
    return [b[i : i + 4] for i in range(len(b) - 3) if b[i + 1] != 32 and b[i + 2] != 32]


def brute_counts(rows, texts, near, least):
    """Each text's n-grams in each language's set, without a filter."""
    counts = {lang: Counter() for _, lang in rows if lang is not None}
    for text, lang in rows:
        if lang is not None and text is not None:
            counts[lang].update(grams(text))
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    best = Counter()
    for s in share.values():
        for g, x in s.items():
            best[g] = max(best[g], x)
    known = {lang: {g for g, n in c.items() if n >= least and share[lang][g] >= near * best[g]} for lang, c in counts.items()}
    return [{lang: sum(g in known[lang] for g in grams(text)) for lang in sorted(known)} for text in texts]


@pytest.mark.parametrize("languages", [3, 70])
def test_counts_equal_exact_sets(spark, languages):
    r = random.Random(languages)
    letters = {f"l{i:02d}": "".join(r.sample("abcdefghijklmnopqrstuvwxyzäöüéñ", 7)) for i in range(languages)}
    rows = [(invented(r, 60, x), lang) for lang, x in letters.items() for _ in range(3)]
    rows += [(None, "l00"), ("", "l01"), ("no label", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert model.languages == sorted(letters) and len(model.slots) == (languages + 63) // 64
    texts = [(invented(r, r.randint(1, 40), x), lang) for lang, x in letters.items()]
    tests = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    got = sorted(langid.predict(tests, model, "doc_id", "lang", "text").collect())
    expected = brute_counts(rows, [t for t, _ in texts], 0.3, 3)
    for x, due in zip(got, expected, strict=True):
        counts = json.loads(x["lang_counts"])
        assert counts.keys() == due.keys() and all(abs(counts[k] - due[k]) <= 1.5 for k in due)  # false positives, corrected
        top = max(due.values())
        assert due[x["lang_pred"]] >= top - 2 and 0 <= x["score"] <= 1
    exact = np.mean([max(due, key=due.get) == x["lang"] for x, due in zip(got, expected, strict=True)])
    assert np.mean([x["lang_pred"] == x["lang"] for x in got]) >= exact - 0.05  # as good as without a filter


def test_odd_rows_ties_and_clashing_names(spark):
    rows = [(1, "abcd abcd abcd abcd", "b"), (2, "abcd abcd abcd abcd", "a"), (3, None, "a"), (4, "", "a"), (None, "12 !?", None), (6, "x", None), (7, "ABCD" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as gram", "3 as n")
    model = langid.learn(df)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(df, model, "doc_id").collect()}
    assert got[1][0] == got[2][0] == "a"  # a tie: the first by name
    assert got[3] == got[4] == got[None] == ("und", 0.0) and got[6] == ("a", 0.0) and got[7][0] == "a"
    assert langid.predict(df.limit(0), model).count() == 0
    none = langid.learn(df.limit(0))
    assert none.languages == [] and {x["lang_pred"] for x in langid.predict(df, none).collect()} == {"und"}
