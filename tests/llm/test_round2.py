"""Line de-duplication, templates, sketches, top-k and the pipeline against brute force and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimworks.llm import fingerprints, html_extract, line_dedup, lm_scoring, metric_topk


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_similar_pairs_equal_the_plain_distance():
    r, a, b = random.Random(1), [], []
    for _ in range(400):
        x = [r.choice("abcé d") for _ in range(r.choice([0, 1, 20, 63, 64, 65, 150]))]
        y = x[:]
        for _ in range(r.randint(0, 30)):
            i = r.randint(0, len(y))
            y[i : i + r.randint(0, 1)] = r.choice(["", "z", "q"])
        a.append("".join(x))
        b.append("".join(y))
    expected = [distance(x, y) * 100 <= 20 * max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    for likely in (True, False):
        assert line_dedup.similar_pairs(a, b, 80, 100, likely).tolist() == expected


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))


@pytest.mark.parametrize("words", [10, 20, 40])
def test_lines_with_a_changed_word_are_found(spark, words):
    r = random.Random(words)
    rows = []
    for i in range(150):
        line = [word(r) for _ in range(words)]
        other = line[:]
        other[r.randrange(words)] = word(r)
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {x["doc_id"] for x in got if x["lines"]["n_removed"]}
    due = {2 * i + 1 for i in range(150) if distance(rows[2 * i][1], rows[2 * i + 1][1]) * 100 <= 20 * len(max(rows[2 * i][1], rows[2 * i + 1][1], key=len))}
    assert gone <= due and len(gone) >= 0.9 * len(due)


def test_a_refused_leader_hides_no_pair(spark):
    r, rows = random.Random(5), []
    for i in range(20):
        line = [word(r) for _ in range(30)]
        swapped = [*line[:3], line[4], line[3], *line[5:]]
        rows += [(3 * i, " ".join(reversed(line))), (3 * i + 1, " ".join(line)), (3 * i + 2, " ".join(swapped))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got if x["lines"]["n_removed"]} == {3 * i + 2 for i in range(20)}


def test_line_dedup_odd_rows_and_names(spark):
    rows = [(1, "one two three four five six\n\nshort\nshort", "a"), (2, "One two three, four five six!\nshort", "b"), (3, None, "c"), (4, "", "d"), (None, "short", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string").withColumn("__id", F.lit(1)).withColumn("drop", F.lit(2))
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs, counts=None).collect()}
    assert {k: x["text"] for k, x in got.items()} == {1: "one two three four five six\n\nshort", 2: "", 3: None, 4: "", None: "short"}
    assert got[1]["lines"] == "a" and got[1].__fields__ == docs.columns
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_template_with_names_that_no_list_knows(spark):
    r = random.Random(3)
    rows, body = [], {}
    for i in range(8):
        body[i] = [" ".join(word(r) for _ in range(25)) for _ in range(4)]
        rows.append((i, f"http://x.org/{i}", f"<body><div class=qa>{word(r)} {word(r)}</div><div class=qb><p>{'</p><p>'.join(body[i])}</p><div class=qc>Join our club</div></div><div class=qd>{word(r)}</div></body>"))
    pages = spark.createDataFrame(rows * 3, "page_id long, url string, html string")
    for most in (20_000, 0):
        got = html_extract.extract(pages, most_hosts=most).collect()
        assert len(got) == 24 and all(x["text"] == " ".join(body[x["page_id"]]) for x in got)
    odd = spark.createDataFrame([(1, None, None), (1, None, ""), (None, "x", "<p>a&amp;b")], "page_id long, url string, html string")
    assert sorted(x["text"] for x in html_extract.extract(odd).collect()) == ["", "", "a&b"]


def test_sketches_estimate_containment(spark):
    r = random.Random(7)
    texts = [" ".join(word(r) for _ in range(600)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[5]), (7, ""), (8, None), (9, "tiny")]
    got = {x["doc_id"]: x for x in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    for i in range(1, 6):
        new = fingerprints.edited(texts[i], texts[i - 1])
        true = len(shingles(texts[i]) & shingles(new)) / len(shingles(texts[i]))
        assert abs(got[i]["near_edited"] - true) < 0.1 and got[i]["near_next"] < 0.1
    assert got[6]["near_next"] == 1.0 and got[6]["fingerprint"] == got[5]["fingerprint"] and all(0 <= x["near_edited"] <= 1 for x in got.values())


def test_topk_large_components_and_empty(spark):
    rows = [(50, [1e6, 1.0]), (1, [1e6, -1.0]), (2, [1e300, 1.0]), (3, [1.0]), (100, [2.0]), (100, [2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in metric_topk.top_k(vectors).orderBy("query_id").collect()]
    assert got == [(50, 1, 1, 256_000_000**2 - 256**2), (100, 1, 3, 512 * 256)]
    assert metric_topk.top_k(vectors.limit(0)).count() == 0


def test_lm_scores_do_not_depend_on_chunks(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("a b c d e".split()) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(60, None), (None, "a b"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, lm_scoring.stupid_backoff(docs).collect()))
    assert one == sorted(map(str, lm_scoring.stupid_backoff(docs, chunk_bytes=100, part_bytes=200).collect()))
    assert lm_scoring.stupid_backoff(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    r = random.Random(11)
    text = lambda n: " ".join(word(r) for _ in range(n))
    base = [text(80) for _ in range(8)]
    rows = [(i, base[i], "en", "web", len(base[i])) for i in range(8)]
    rows += [(8, base[0] + "\n" + base[1], "en", "web", 1), (9, None, None, None, None), (10, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = out
    lines = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, docs.schema), "")
    assert {x["doc_id"]: x["text"] for x in lines.collect()}[8] == ""
