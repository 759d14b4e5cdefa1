"""The pipeline stage by stage against plain Python, and odd rows of operators."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from claimworks.llm import fingerprints, html_extract, langid, metric_topk, mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """A small corpus in two languages, with near copies in a chain, repeated lines and odd rows; and
    what each stage makes of it."""
    r = random.Random(7)
    words = {x: ["".join(r.choice(a) for _ in range(r.randint(3, 8))) for _ in range(400)] for x, a in (("aa", "bcdfgaeiou"), ("bb", "klmnpstyuo"))}
    rows = []
    for i in range(60):
        lang = "ab"[i % 2] * 2
        rows.append((i, "\n".join(prose(r, words[lang], r.randint(8, 40)) for _ in range(r.randint(1, 4))), lang, "s" + str(i % 3), 0))
    base = [w for _ in range(100) for w in [r.choice(words["aa"])]]
    for k in range(6):  # each is similar to the next, the ends are not similar
        own = base[6 * k : 6 * k + 64]  # broken into lines elsewhere than its neighbours, so few of their lines are similar
        lines = [" ".join(own[i : i + 9 + 2 * k]) for i in range(0, 64, 9 + 2 * k)]
        rows.append((100 + k, "\n".join(lines), "aa", "s0", 0))
    repeated = prose(r, words["bb"], 20)
    rows += [(200 + k, f"{prose(r, words['bb'], 25)}\n{repeated}\n{prose(r, words['bb'], 25)}", "bb", None, 0) for k in range(3)]
    rows += [(300, None, None, "s1", 0), (301, "", "aa", "s1", 0), (302, "12 34 !!", None, "s2", 0), (303, rows[0][1], None, "s1", 0)]
    folder = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out.append([x.asDict() for x in docs.collect()])
    return folder, [dict(zip(SCHEMA.replace(",", "").split()[::2], x, strict=True)) for x in rows], out


def by_id(rows):
    return {x["doc_id"]: x for x in rows}


def test_language_stage_rejects_what_has_none(stages):
    _, docs, out = stages
    assert {*by_id(docs)} - {*by_id(out[0])} == {300, 301, 302}
    assert by_id(out[0])[303]["lang"] == by_id(docs)[0]["lang"] and all(x["text"] == by_id(docs)[x["doc_id"]]["text"] for x in out[0])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_stage_keeps_one_of_each_repeated_line(stages):
    _, _, out = stages
    before = Counter(line for x in out[0] for line in x["text"].split("\n"))
    after = Counter(line for x in out[1] for line in x["text"].split("\n") if line)
    gone = {line for line in before if line and line not in after}
    assert len(out[1]) == len(out[0]) and {*after} <= {*before} and all(n == 1 for n in after.values())
    assert len(gone) <= 8 and all(any(distance(a, b) <= 0.2 * max(len(a), len(b)) for b in after) for a in gone)
    assert all(x["n_chars"] == len(x["text"]) for x in out[1])


def shingled(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_join_stage_keeps_the_smallest_of_each_group(stages):
    _, _, out = stages
    sets = {x["doc_id"]: shingled(x["text"]) for x in out[1]}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {x["doc_id"] for x in out[2]} == {i for i, k in root.items() if i == k}
    assert {101, 102, 103, 104, 105} - {x["doc_id"] for x in out[2]}  # the line stage has taken lines from some of them


def test_mixing_stage_comes_near_the_targets(stages):
    _, _, out = stages
    size = {x["doc_id"]: len(WORD.findall(x["text"])) for x in out[2]}
    source = {x["doc_id"]: x["source"] for x in out[2]}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, budget, full = {}, 1.5 * sum(total.values()), set()
    while True:
        rest = budget - sum(2 * total[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * total[s] if s in full else share[s] for s in names}
    taken, times = defaultdict(int), Counter(x["doc_id"] for x in out[3])
    for x in out[3]:
        taken[x["source"]] += len(WORD.findall(x["text"]))
    assert max(times.values()) <= 2 and {*times} <= {*size}
    for s in names:
        assert abs(taken[s] - target[s]) <= max(n for i, n in size.items() if source[i] == s)


def test_packing_stage_holds_every_token(stages):
    _, _, out = stages
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter((x["doc_id"], len(tokenizer.encode(x["text"], add_special_tokens=False).ids) + 1) for x in out[3])
    held, filled = defaultdict(int), defaultdict(int)
    for p in out[4]:
        held[p["doc_id"]] += p["length"]
        filled[p["sequence_id"]] += p["length"]
    assert held == {i: sum(n * k for (j, n), k in expected.items() if j == i) for i in {i for i, _ in expected}}
    assert max(filled.values()) <= 4096


def test_run_is_the_stages_in_order(spark, stages):
    folder, _, out = stages
    got = corpus_pipeline.run(spark, folder).collect()
    assert sum(x["length"] for x in got) == sum(x["length"] for x in out[4])
    assert Counter((x["doc_id"], x["doc_tokens"]) for x in got if x["start"] == 0) == Counter((x["doc_id"], x["doc_tokens"]) for x in out[4] if x["start"] == 0)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_language_of_odd_rows(spark):
    rows = [(1, "aba aba bab", "x"), (2, "klk klk lkl", "y"), (3, None, "x"), (4, "", None), (5, "123", None), (6, "zzzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, least=1)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(docs, model, "doc_id").collect()}
    assert got[1][0] == "x" and got[2][0] == "y" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6] == ("x", 0.0)  # a tie at nothing: the first by name
    assert langid.predict(docs.limit(0), model, "doc_id").collect() == []
    assert {x["lang_pred"] for x in langid.predict(docs, langid.learn(docs.limit(0)), "doc_id").collect()} == {"und"}


def test_toxicity_of_odd_rows(spark):
    r = random.Random(2)
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}" for i in range(10)]
    rows = [(i, prose(r, good, 30) + (" " + prose(r, bad, 6) if i % 4 == 0 else ""), 9, "s") for i in range(120)] + [(500, None, 9, "s"), (501, "", 9, "s"), (None, "good1", 9, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, source string")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(0, 120) if i % 3] + [(500, None), (None, 1)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs.select("doc_id", "text"), labels), "doc_id").collect()}
    assert len(got) == 123 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values())
    held = [i for i in range(0, 120, 3)]
    assert sum((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in held) >= 0.9 * len(held)


def test_fingerprints_of_odd_ids(spark):
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["n_chars"] == 11
    rows = [(1, "a b"), (1, "a b"), (None, "c d e"), (2, None)]
    assert len(fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 4


def test_mixing_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "t"), (None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 4 and all(x["taken"] <= 2 * x["size"] for x in got)


def test_clashing_names(spark):
    vectors = spark.createDataFrame([(i, [0.1 * i, 1.0], "r", 1, 2) for i in range(60)], "vec_id long, embedding array<double>, route string, page int, rank int")
    assert metric_topk.top_k(vectors).filter("query_id = 0").count() == 5
    pages = spark.createDataFrame([(1, "http://h/a", "<p>One two.</p>", "x", 3)], "page_id long, url string, html string, text string, host int")
    assert html_extract.extract(pages).select("text").first()["text"] == "One two."
    assert langid.predict(spark.createDataFrame([("abc", 1)], "text string, score int"), langid.learn(spark.createDataFrame([("abc", "x")], "text string, lang string")), F.col("score").alias("kept")).first()["kept"] == 1
