import numpy as np

from claimworks.llm import line_dedup


def test_long_pairs_are_compared_many_at_a_time(monkeypatch):
    """distances of many lines of more than 512 characters aren't computed one by one."""
    rng = np.random.default_rng(4)
    a = ["".join(chr(97 + c) for c in rng.integers(0, 20, 600 + n)) for n in range(150)]
    b = ["".join(c if rng.random() > 0.1 + 0.2 * (n % 2) else "z" for c in x) for n, x in enumerate(a)]
    expected = [line_dedup._distance(x, y, 10**6) * 5 <= len(x) for x, y in zip(a, b, strict=True)]
    monkeypatch.setattr(line_dedup, "_distance", None)
    assert line_dedup.similar_pairs(a, b, 80, 100, False).tolist() == expected and 0 < sum(expected) < 150


def test_distances_within_a_band():
    rng = np.random.default_rng(5)
    a = ["".join("abcé中"[c] for c in rng.integers(0, 5, n)) for n in rng.integers(1, 300, 120)]
    b = ["".join(c for c in x if rng.random() < 0.9) + "z" for x in a]
    exact = np.array([line_dedup._distance(x, y, 10**6) for x, y in zip(a, b, strict=True)])
    assert (line_dedup._distances(a, b) == exact).all()
    for allowed in (0, 3, 20, 64, 100):
        got = line_dedup._distances(a, b, allowed)
        assert (got[exact <= allowed] == exact[exact <= allowed]).all() and (got[exact > allowed] > allowed).all()


def test_postings_of_any_number_of_ranges_hold_the_same_pairs(spark, monkeypatch):
    """postings travel packed by range of keys; how many ranges there are changes nothing."""
    rng = np.random.default_rng(6)
    names = ["line", "simhash", *line_dedup._BANDS]
    rows = [[n, int(rng.integers(0, 4)) << 62 - 1 | int(rng.integers(0, 8)), *map(int, rng.integers(-6, 6, line_dedup.BANDS))] for n in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if n < 2 else 'int'}" for n, c in enumerate(names)))
    found = []
    for size in (1 << 19, 50):
        monkeypatch.setattr(line_dedup, "RANGE", size)
        pairs = line_dedup._key_ranges(df, "simhash", 60).applyInArrow(line_dedup._range_pairs, "u long, v long")
        found.append({frozenset((r["u"], r["v"])) for r in pairs.collect()})
    u, v = next(iter(found[0]))
    assert found[0] == found[1] and len(found[0]) > 1 and u != v


def test_byte_level_forms_by_character():
    """op2: words of Latin letters take their byte-level form by character, whatever lower-casing makes of them."""
    from claimworks.llm import packing
    from claimworks.llm.queries import tokenizer_path

    tokens = packing.Tokens(tokenizer_path())
    words = ["".join(chr(c) for c in range(n, n + 7)) for n in range(0xA1, 0x24A)] + ["İstanbul", "Ⱥb", "naïve,Été"]
    text = np.frombuffer("\n".join(words).encode(), np.uint8)
    got = next(tokens.rows(text, np.array([0, len(text)]), 2))
    assert got.tolist() == [i for w in words for i in tokens.tokenizer.encode(w, add_special_tokens=False).ids] + [2] and tokens.forms
