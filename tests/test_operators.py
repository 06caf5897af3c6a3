"""Goldens, properties and independence of partitions."""

import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import corpus as C
from sparkgauge.functions import filters as R
from sparkgauge.functions import metrics as M
from sparkgauge.functions import text as X
from sparkgauge.operators import selection as G
from sparkgauge.operators.graph import connected_components
from sparkgauge.plans import requests as Q
from sparkgauge.plans.evaluate import Task, evaluate, inherit
from sparkgauge.registry import FILTERS, METRICS
from sparkgauge.sources import io
from sparkgauge.streaming.incremental import windowed_mean

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_run_lengths(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([0, 1, 1, 1, 0, 0, 1, 1])], "g int, k int, v int")
    assert [r.run for r in Q.run_lengths(df, ["g"], "k", "v").orderBy("k").collect()] == [0, 0, 0, 3, 0, 0, 0, 2]


def test_chunks_and_samples(spark):
    ten = F.sequence(F.lit(1), F.lit(10))
    assert one(spark, Q.chunks(ten, 3)) == [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]
    assert one(spark, Q.uniform_sample(F.lit(10), 4)) == [0, 3, 6, 9] and one(spark, Q.uniform_sample(F.lit(7), 1)) == [0]


def test_filters(spark):
    r = F.array(*map(F.lit, ["b", "a", "a", "b", "c"]))
    assert one(spark, R.majority_vote()(r)) == ["b"]
    assert one(spark, R.take_first()(F.array().cast("array<string>"))) is None
    assert one(spark, R.regex(r"(\d+)-(\d+)", group=2)(F.array(F.lit("x 1-23"), F.lit("none")))) == ["23", "[invalid]"]
    assert one(spark, R.multi_choice(F.array(F.lit("red"), F.lit("blue")))(F.array(F.lit("(B)"), F.lit("Blue, not red"), F.lit("A."), F.lit("?")))) == ["B", "B", "A", "[invalid]"]
    assert one(spark, R.mapping({"A": "1", "B": "2"}, "0")(F.array(F.lit("A"), F.lit("x")))) == ["1", "0"]
    with pytest.raises(KeyError):
        FILTERS.find("os.system")


def test_text_functions(spark):
    assert one(spark, X.relaxed_match(F.lit("10%"), F.lit("0.104"))) and not one(spark, X.relaxed_match(F.lit("0"), F.lit("0.0")))
    assert one(spark, X.parse_box(F.lit("so [1, 2.5,3 , -4]"))) == [1.0, 2.5, 3.0, -4.0] and one(spark, X.parse_box(F.lit("no"))) == [0.0] * 4
    assert one(spark, X.qa_f1(F.lit("The cat, sat"), F.lit("a cat sat sat"))) == pytest.approx(0.8)
    assert one(spark, X.qa_f1(F.lit("the"), F.lit(""))) == 1.0
    assert one(spark, X.srt_seconds(F.lit("01:02:03,500"))) == 3723.5
    assert one(spark, X.choice_letter(F.lit("The best answer is B"))) == "B"
    assert one(spark, X.anls(F.lit("hello"), F.array(F.lit("Hello")))) == 1.0


def test_generated_text_metrics(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b c d", "a b x d")], "p string, r string")
    assert C.bleu(df.limit(1), "p", "r", 2).first()[0] == pytest.approx(100)
    assert C.chrf(df.limit(1), "p", "r", 3).first()[0] == pytest.approx(100)
    assert [tuple(x.e) for x in df.select(C.word_errors("p", "r").alias("e")).collect()] == [(0, 3), (1, 4)]
    assert C.normal_answer("The two, dogs!") == "2 dogs"
    assert C.parse_choice("I say (A), no, (B)", ["A", "B"], ["x", "y"]) == "B"
    rated = C.bradley_terry([("m", "n", "a", 75), ("m", "n", "b", 25)])
    assert rated["m"] - rated["n"] == pytest.approx(400 * 0.4771212547, abs=1e-4)
    assert one(spark, F.size(C.loosened(F.lit("a\nb\nc")))) == 8


def union_find(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("partitions", [1, 7])
def test_components(spark, partitions):
    r = random.Random(partitions)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(900, 900)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "u long, v long").repartition(partitions)
    assert {tuple(x) for x in connected_components(df).collect()} == union_find(edges)
    assert connected_components(df.where("u is null")).count() == 0


def test_selection_spares_events_and_keeps_to_the_bound(spark):
    tokens = spark.createDataFrame([(k, [1.0, 0.01 * k]) for k in range(10)] + [(20 + k, [0.0, 1.0 + k]) for k in range(4)], "node long, emb array<double>")
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21), (21, 22), (22, 23)], "u long, v long")
    events = spark.createDataFrame([(9,), (20,)], "node long")
    rows = {r.node: r.dropped for r in G.select_tokens(tokens, edges, events, 2, 0.5).collect()}
    assert len(rows) == 14 and not rows[9] and not rows[20] and 0 < sum(rows.values()) <= 7


def test_cohesion_equals_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 4))
    df = spark.createDataFrame([(k, k % 2, x.tolist()) for k, x in enumerate(v)], "id int, g int, e array<double>")
    groups, central = G.cohesion(df, "g", "e", 4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in groups.collect():
        c = u[r.g :: 2] @ u[r.g :: 2].T
        assert r.cohesion == pytest.approx((c.sum() - len(c)) / (len(c) * (len(c) - 1)))
    assert central.count() == 12


def test_k_centers_and_ranks(spark):
    df = spark.createDataFrame([(k, [float(x)]) for k, x in enumerate([0, 10, 1, 9, 5])], "vec_id long, embedding array<double>")
    assert [r.id for r in G.k_centers(df, 3).orderBy("rank").collect()] == [0, 1, 4]
    ring = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "u long, v long, w double")
    assert all(r.rank == pytest.approx(1 / 3) for r in G.pagerank(ring).collect())


@pytest.mark.parametrize("partitions", [1, 8])
def test_evaluate(spark, partitions):
    docs = spark.createDataFrame([(k, f"w{k % 3} tail", f"W{k % 2}") for k in range(30)], "doc_id long, text string, gold string").repartition(partitions)
    task = Task("t", docs, "{{text}}", "gold", ("exact_match", "contains"), {"first": [("take_first",)], "vote": [("majority_vote",)]}, repeats=3, limit=0.5)
    out = evaluate(spark, [task], "echo", {"g": ["t"]})
    rows = {(r.metric, r.filter_name): (round(r.value, 6), r.n) for r in out.task_results.collect()}
    want = sum(k % 3 == k % 2 for k in range(15)) / 15
    assert rows[("exact_match", "first")] == rows[("exact_match", "vote")] == (round(want, 6), 15)
    assert out.group_results.count() == 4 and "exact_match" in METRICS


def test_cache_and_replay(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, key string")
    store = spark.createDataFrame([("a", "old")], "key string, response string")
    out = Q.through_cache(req, store, lambda x: x.withColumn("response", F.lit("new")))
    assert {(r.doc_id, r.response) for r in out.collect()} == {(1, "old"), (2, "new")}
    assert inherit({"a": 1, "m": {"x": 1, "y": 2}}, {"m": {"y": 3}}) == {"a": 1, "m": {"x": 1, "y": 3}}
    with pytest.raises(ValueError):
        Q.template("{{nope}}", ["a"])


def test_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n")
    rows = io.read_subtitles(spark, str(tmp_path / "a.srt")).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.text) for r in rows] == [(1.0, 2.5, "Hello there"), (3.0, 4.0, "Bye")]
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    assert io.read_by_extension(spark, str(tmp_path / "a.tsv")).first().y == "2"
    samples = spark.createDataFrame([("t", 1, 0.5)], "task string, doc_id long, value double")
    io.write_samples(samples, str(tmp_path / "s"))
    io.write_samples(samples, str(tmp_path / "s"), append=True)
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    assert "0.5000" in io.markdown(samples)
    logs = spark.createDataFrame([("t", 1, "old"), ("t", 2, "new")], "task string, time long, v string")
    logs.write.json(str(tmp_path / "l"))
    assert io.read_logs(spark, str(tmp_path / "l"), "task string, time long, v string").first().v == "new"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) as ts, cast(id % 2 as string) as k, cast(id as double) as v from range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_mean(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", ["k"], "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, windowed_mean(rows, "ts", ["k"], "v").collect()))


def test_nothing_imports_the_pipeline_package():
    for folder, _, names in os.walk(os.path.join(ROOT, "sparkgauge")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"sparkgauge\.llm|from \.llm|import llm", open(os.path.join(folder, n)).read()), n


def test_whole_texts_and_all_languages(spark):
    import string
    from collections import Counter

    from sparkgauge.queries import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def f1(p, r):
        words = lambda t: re.sub(r"\b(a|an|the)\b", " ", t.lower().translate(str.maketrans("", "", string.punctuation)), flags=re.ASCII).split()
        p, r = Counter(words(p)), Counter(words(r))
        return 2 * (p & r).total() / (p.total() + r.total()) if p and r else float(p == r)

    got = {x.doc_id: x.f1 for x in queries()["X7_qa_f1"](spark, sf).collect()}
    for x in docs:
        if (x.text or "").isascii():
            assert got[x.doc_id] == pytest.approx(f1(x.text or "", (x.text or "")[39:]), abs=1e-5), x.doc_id
    tasks = {x.task: x.n for x in queries()["E1_evaluate"](spark, sf).collect()}
    assert tasks == Counter(x.lang for x in docs)


def test_spread_join_deals_a_hub(spark):
    from sparkgauge.operators.graph import HOT_ROWS, spread_join

    left = spark.range(5000).select((F.when(F.col("id") < 4000, 7).otherwise(F.col("id"))).alias("u"), F.col("id").alias("v"))
    right = left.groupBy("u").agg(F.min("v").alias("m"))
    got = spread_join(left, right, "u", 5000)
    assert got.count() == 5000 and got.where("u = 7").agg(F.max("m")).first()[0] == 0
    star = spark.range(1, 20_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    found = connected_components(star)
    assert found.count() == 20_000 and found.where("component <> 0").count() == 0
    sizes = [x.n for x in spread_join(star, star.select("u").distinct().withColumn("m", F.lit(0)), "u", 20_000).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert HOT_ROWS < 20_000 and max(sizes) < 20_000


def test_a_responder_is_asked_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def respond(requests):
        def run(batches):
            for b in batches:
                asked.add(len(b))
                yield b.assign(response=b["ctx"])

        return requests.mapInPandas(run, "task string, doc_id long, ctx string, target string, rep int, response string")

    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("a").alias("target"))
    three = {"none": [("take_first",)], "low": [("lowercase",), ("take_first",)], "re": [("regex", {"pattern": "a"}), ("take_first",)]}
    out = evaluate(spark, [Task("t", docs, "text", "target", filters=three, repeats=2)], respond)
    assert out.samples.count() == 30 and {r.filter_name: r.value for r in out.task_results.collect()} == {"none": 0.0, "low": 0.0, "re": 1.0} and out.group_results.count() == 3
    assert asked.value == 20


def test_numbers_and_instruction_checks(spark):
    for said in ("x 1,234,567 y 1234567.891 .5 7", "-2.5e3 and 123456.78", "none", "12% of 3.0001, 4."):
        assert one(spark, C.open_numbers(F.lit(said))) == [round(float(x.replace(",", "")), 2) for p in C.NUMBER_PATTERNS for x in re.findall(p, said)]
    assert one(spark, C.open_numbers(F.lit("so 1234567.89 it is"))) == [1234567.89]
    text = "The cat.\n\nSECTION 1 a dog! SECTION 2 end."
    got = C.keyword_checks(F.lit(text), ["cat", "dog"], "t", "SECTION", ["My answer is yes."], "the", "END.", F.lit("the cat"))
    want = {"keyword_all": True, "keyword_count": 1, "forbidden_absent": False, "letter_count": 4, "n_sections": 2, "constrained": False, "first_word": True, "ends_with": True, "json_format": False, "repeats_prompt": True, "n_sentences": 3}
    assert {k: one(spark, v) for k, v in got.items()} == want
    assert one(spark, C.keyword_checks(F.lit('```json\n{"a": 1}\n```'), ["a"], "a", "S", ["x"], "a", "b", F.lit("z"))["json_format"])


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 9, 10])
def test_rolling_windows_predict_each_token_once(spark, n):
    windows = one(spark, Q.rolling_windows(F.slice("t", 1, n), F.lit(-1), 4, 2), t=list(range(10)))
    assert [x for w in windows for x in w["pred"]] == list(range(n))
    for k, w in enumerate(windows):
        assert w["input"][-len(w["pred"]) :] == [x - 1 for x in w["pred"]]
        assert len(w["input"]) == (min(4, n) if k == 0 else 4)
    cut = one(spark, F.transform(Q.rolling_windows(F.slice("t", 1, n), F.lit(-1), 4, 2), Q.disjoint), t=list(range(10)))
    assert all(w["input"][-1] == w["pred"][0] - 1 and not set(w["input"]) & set(w["pred"]) for w in cut)


def test_random_shots_leave_out_the_own_one(spark):
    shots = spark.createDataFrame([(k, f"s{k}") for k in range(6)], "shot_id long, shot string")
    docs = spark.createDataFrame([(k, "q") for k in range(40)], "doc_id long, ctx string")
    got = {r.doc_id: r.ctx.split("|") for r in Q.random_shots(docs, shots, 2, "|", "a").collect()}
    assert all(len(c) == 3 and len(set(c)) == 3 and f"s{k}" not in c for k, c in got.items())
    assert len({tuple(c) for c in got.values()}) > 10
    assert got != {r.doc_id: r.ctx.split("|") for r in Q.random_shots(docs, shots, 2, "|", "b").collect()}
    with pytest.raises(ValueError):
        Q.random_shots(docs, shots, 2, "|", most=5)


def test_simple_multi_choice(spark):
    question = "Which?\nA. red car\nB. blue\nC. blue"
    said = ["It's a red car!", "blue, no red car", "green...", ""]
    assert one(spark, R.simple_multi_choice(F.col("q"))(F.col("r")), q=question, r=said) == ["A", "C", "green", ""]
    assert one(spark, R.simple_multi_choice(F.col("q"))(F.col("r")), q="none", r=said)[2] == "green"


def test_errors_by_name_and_many_classes(spark):
    df = spark.range(400).select("id", (F.xxhash64("id") % 10).cast("double").alias("v"))
    by_mean = M.stderr_for("mean", 10)(df, "id", F.col("v"), F.avg("v")).first()[0]
    again = M.bootstrap_stderr(df, "id", F.avg("v"), 300).first()[0]
    assert abs(again / by_mean - 1) < 0.2
    assert M.stderr_for("mean", 0) is None and M.stderr_for("bypass", 10) is None
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 2), (None, 1)], "g int, p int")
    assert M.matthews_many(pairs, "g", "p").first()[0] == pytest.approx(0.7)
    assert M.matthews_many(pairs.where("g = 0"), "g", "p").first()[0] == 0.0
    assert M.matthews_many(pairs.where("false"), "g", "p").first()[0] == 0.0
    assert one(spark, M.max_over_truths(lambda a, b: (a == b).cast("int"), F.col("x"), F.col("t")), x="b", t=["a", "b"]) == 1


def test_chrf_counts_every_gram(spark):
    r = random.Random(5)
    alphabets = ["ab", "abcdefgh", "".join(map(chr, range(0x4E00, 0x5400))), "aé漢😀"]
    text = lambda: "".join(r.choices(r.choice(alphabets), k=r.choice([0, 1, 3, 5, 6, 40, 300])))
    pairs = [(text(), text()) for _ in range(300)] + [("", ""), ("abcabc", "abcabc")]
    grams = lambda t, n: Counter(t[i : i + n] for i in range(len(t) - n + 1))
    want = [tuple(sum(x) for x in zip(*(((a & b).total(), a.total(), b.total()) for a, b in ((grams(p, n), grams(q, n)) for p, q in pairs)), strict=True)) for n in range(1, 9)]
    assert C.gram_counts(*map(list, zip(*pairs, strict=True)), 8) == want
    assert C.gram_counts([], [], 2) == [(0, 0, 0)] * 2 == C.gram_counts([""], [""], 2)
    df = spark.createDataFrame([*pairs, (None, "x"), (None, None)], "p string, r string")
    precision = sum(m / p for m, p, _ in want[:6]) / 6
    wanted = [w + (n == 0) for n, (_, _, w) in enumerate(want[:6])]
    recall = sum(m / w for (m, _, _), w in zip(want, wanted, strict=False)) / 6
    assert C.chrf(df, "p", "r").first()[0] == pytest.approx(100 * 5 * precision * recall / (4 * precision + recall))
    assert C.chrf(df.limit(0), "p", "r").first()[0] == 0


def test_chrf_is_not_quadratic(spark):
    r = random.Random(6)
    df = spark.createDataFrame([("".join(r.choices("abcdefgh ", k=30_000)), "".join(r.choices("abcdefgh ", k=30_000))) for _ in range(4)], "p string, r string")
    began = time.monotonic()
    assert 0 < C.chrf(df, "p", "r").first()[0] < 100
    assert time.monotonic() - began < 30
