"""Queries of text-generation metrics, parses, the evaluation API and the stream extension."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgauge.functions import corpus as C
from sparkgauge.functions.vector import unit, vector_sum
from sparkgauge.operators.selection import lagged
from sparkgauge.plans.evaluate import Task, evaluate
from sparkgauge.plans.requests import chunks
from sparkgauge.registry import query, table
from sparkgauge.streaming.incremental import windowed_mean

R6 = lambda c: F.round(c, 6)


def pairs(s, d):
    """Names of parts with type and brand, against the same with words put in and left out."""
    words = ["p_name", "p_type", "p_brand"]
    odd = F.col("p_size") % 2 == 0
    return table(s, d, "part").select("p_partkey", F.concat_ws(" ", *words, "p_name").alias("r"), F.concat_ws(" ", "p_name", F.when(odd, "extra"), "p_type", "p_brand", F.when(~odd, F.col("p_name"))).alias("p"))


_PAIRS = """SELECT p_partkey, concat_ws(' ', p_name, p_type, p_brand, p_name) AS r, concat_ws(' ', p_name, CASE WHEN p_size % 2 = 0 THEN 'extra' END, p_type, p_brand, CASE WHEN p_size % 2 <> 0 THEN p_name END) AS p FROM part"""


def _grams(split, most):
    """SQL: matched (m), predicted (t) and wanted (w) n-grams of each order n, over all pairs."""
    runs = "unnest(list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string({0}[i:i + n - 1], chr(1))))"
    return f"""WITH b AS (SELECT p_partkey AS k, {split.format('r')} AS r, {split.format('p')} AS p FROM ({_PAIRS})), o AS (SELECT unnest(range(1, {most + 1})) AS n),
    x AS (SELECT k, n, g, count(*) AS c FROM (SELECT k, n, {runs.format('p')} AS g FROM b, o) GROUP BY ALL), y AS (SELECT k, n, g, count(*) AS c FROM (SELECT k, n, {runs.format('r')} AS g FROM b, o) GROUP BY ALL),
    z AS (SELECT n, sum(c) AS t FROM x GROUP BY n), v AS (SELECT n, sum(c) AS w FROM y GROUP BY n), u AS (SELECT n, sum(least(x.c, y.c)) AS m FROM x JOIN y USING (k, n, g) GROUP BY n),
    a AS (SELECT n, m::DOUBLE AS m, t::DOUBLE AS t, w::DOUBLE AS w FROM u JOIN z USING (n) JOIN v USING (n))"""


@query("A9_bleu", _grams("string_split({0}, ' ')", 4) + " SELECT round(100 * exp(avg(ln(m / t)) + least(0, 1 - (SELECT sum(len(r))::DOUBLE / sum(len(p)) FROM b))), 6) AS bleu FROM a")
def _(s, d):
    return C.bleu(pairs(s, d), "p", "r").select(R6("bleu").alias("bleu"))


@query("A9_chrf", _grams("string_split(replace({0}, ' ', ''), '')", 6) + " SELECT round(100 * 5 * avg(m / t) * avg(m / w) / (4 * avg(m / t) + avg(m / w)), 6) AS chrf FROM a")
def _(s, d):
    return C.chrf(pairs(s, d), "p", "r").select(R6("chrf").alias("chrf"))


@query("A39_word_error_rate")
def _(s, d):
    e = pairs(s, d).select(C.word_errors("p", "r").alias("e"))
    return e.agg(R6(F.try_divide(F.sum("e.distance").cast("double"), F.sum("e.length").cast("double"))).alias("wer"), F.sum("e.length").alias("n"))


@query("X25_A40_rouge")
def _(s, d):
    return pairs(s, d).select("p_partkey", R6(C.rouge_l("p", "r")).alias("rouge_l"))


@query("X8_best_ngram")
def _(s, d):
    return pairs(s, d).select("p_partkey", R6(C.best_ngram_ratio("p", "r")).alias("ratio"))


@query("X4_normalise_answer")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.answer_normal(F.concat(F.lit("The two, "), "p_name", F.lit("!"))).alias("answer"))


@query("X11_parse_choice")
def _(s, d):
    said = F.expr("CASE p_size % 3 WHEN 0 THEN 'the answer is (B).' WHEN 1 THEN concat('surely ', p_type) ELSE 'no idea' END")
    return table(s, d, "part").select("p_partkey", C.choice_of(said, F.array("p_brand", "p_type", "p_name"), F.col("p_partkey")).alias("choice"))


@query("X12_open_numbers", "SELECT p_partkey, 5::BIGINT AS n, round(1234567 + 567 + 1234567.57 + 0.25 + p_retailprice, 2) AS total FROM part")
def _(s, d):
    """A number with commas counts as a whole and, by the plain pattern, with its last group again."""
    said = F.concat(F.lit("about 1,234,567 and 1234567.568 then .25 or "), F.format_string("%.2f", "p_retailprice"))
    found = table(s, d, "part").select("p_partkey", C.open_numbers(said).alias("found"))
    return found.select("p_partkey", F.size("found").cast("long").alias("n"), F.round(F.aggregate("found", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("A44_field_f1")
def _(s, d):
    e = table(s, d, "events").select(C.field_counts("props", F.lead("props").over(W.partitionBy("user_id").orderBy("event_id"))).alias("c"))
    return e.agg(R6(F.try_divide(2.0 * F.sum("c.hit"), (F.sum("c.predicted") + F.sum("c.wanted")).cast("double"))).alias("f1"))


@query("A37_bradley_terry")
def _(s, d):
    """Each order of a customer is a battle of its priority with that of the customer's order before."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = table(s, d, "orders").select(F.col("o_orderpriority").alias("mb"), F.col("o_totalprice").alias("vb"), F.lag("o_orderpriority").over(w).alias("ma"), F.lag("o_totalprice").over(w).alias("va"))
    won = F.when(F.col("va") > F.col("vb"), "a").when(F.col("va") < F.col("vb"), "b").otherwise("tie")
    counted = x.where("ma <> mb").groupBy("ma", "mb", won.alias("winner")).agg(F.count(F.lit(1)).alias("n")).orderBy("ma", "mb", "winner").collect()
    rated = C.bradley_terry([tuple(r) for r in counted])  # a row for each two models and outcome
    return s.createDataFrame([(m, round(x, 4)) for m, x in rated.items()], "model string, rating double")


@query("IFEVAL_keywords", """SELECT doc_id, (contains(lower(text), 'the') AND contains(lower(text), 'and'))::INT AS keyword_all, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::INT AS keyword_count,
(NOT regexp_matches(lower(text), '\\b(the|and)\\b'))::INT AS forbidden_absent, (length(lower(text)) - length(replace(lower(text), 'e', '')))::INT AS letter_count, (contains(text, 'My answer is yes.') OR contains(text, 'My answer is no.'))::INT AS constrained,
len(regexp_extract_all(text, '\\s?SECTION\\s?\\d+\\s?'))::INT AS n_sections FROM documents""")
def _(s, d):
    c = C.keyword_checks(F.col("text"), ["the", "and"], "e", "SECTION", ["My answer is yes.", "My answer is no."], "the", "end.", F.col("source"))
    return table(s, d, "documents").select("doc_id", *(c[k].cast("int").alias(k) for k in ("keyword_all", "keyword_count", "forbidden_absent", "letter_count", "constrained", "n_sections")))


@query("IFEVAL_structure")
def _(s, d):
    c = C.keyword_checks(F.col("text"), ["the"], "e", "SECTION", ["yes"], "the", "end.", F.col("source"))
    return table(s, d, "documents").select("doc_id", *(c[k].cast("int").alias(k) for k in ("first_word", "ends_with", "json_format", "repeats_prompt", "n_sentences")))


@query("IFEVAL_checks", """SELECT doc_id, len(regexp_extract_all(text, '\\w+', 0))::INT AS n_words_ascii, (NOT contains(text, ','))::INT AS no_comma, (text = lower(text))::INT AS lower_case, (text = upper(text))::INT AS upper_case FROM documents""")
def _(s, d):
    c = C.instruction_checks(F.col("text"))
    return table(s, d, "documents").select("doc_id", c["n_words"].alias("n_words_ascii"), *(c[k].cast("int").alias(k) for k in ("no_comma", "lower_case", "upper_case")))


@query("IFEVAL_loose")
def _(s, d):
    ok = F.exists(C.loosened(F.col("text")), lambda v: C.instruction_checks(v)["no_comma"])
    return table(s, d, "documents").select("doc_id", ok.cast("int").alias("no_comma_loose"))


_RUNS = """WITH f AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT *, list_cosine_similarity(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)) AS sim FROM f),
g AS (SELECT *, sum(CASE WHEN sim >= 0.2 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS run FROM l), p AS (SELECT label, run, vec_id, generate_subscripts(e, 1) AS k, unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))) AS x FROM g)"""


@query("W4_merge_runs", _RUNS + " SELECT min(vec_id) AS vec_id, count(*) AS n, k::INT AS k, round(avg(x), 6) + 0.0 AS mean FROM p GROUP BY label, run, k")
def _(s, d):
    """Runs of neighbouring vectors of a label that are alike, each merged into the mean of its unit vectors."""
    w = W.partitionBy("label").orderBy("vec_id")
    e = lagged(table(s, d, "embeddings"), ["label"], "vec_id", "embedding").withColumn("u", unit(F.col("embedding")))
    e = e.withColumn("run", F.sum(F.when(F.col("sim") >= 0.2, 0).otherwise(1)).over(w))
    m = e.groupBy("label", "run").agg(F.min("vec_id").alias("vec_id"), vector_sum(F.col("u"), 64).alias("v"), F.count(F.lit(1)).alias("n"))
    return m.select("vec_id", "n", F.posexplode("v").alias("k", "x")).select("vec_id", "n", (F.col("k") + 1).alias("k"), (R6(F.col("x") / F.col("n")) + F.lit(0.0)).alias("mean"))


@query("W10_top_share", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE r <= round_even(n * 0.7, 0)")
def _(s, d):
    w = W.partitionBy("l_orderkey")
    x = table(s, d, "lineitem").withColumn("r", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where(F.col("r") <= F.bround(F.col("n") * 0.7)).select("l_orderkey", "l_linenumber")


@query("W17_passages")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(F.transform(chunks(F.split("text", r"\s+"), 50), lambda c: F.md5(F.array_join(c, " ")))).alias("passage", "digest"))


@query("E1_evaluate", """WITH r AS (SELECT lang AS task, (lower(regexp_extract(text, '^\\s*(\\S+)', 1)) = lower(source))::INT AS v FROM documents WHERE lang IS NOT NULL)
SELECT task, round(avg(v), 6) AS value, count(*) AS n FROM r GROUP BY task""")
def _(s, d):
    """One task for each language present."""
    docs = table(s, d, "documents")
    langs = [r.lang for r in docs.where("lang is not null").select("lang").distinct().orderBy("lang").collect()]
    return evaluate(s, [Task(x, docs.where(F.col("lang") == x), "text", "source") for x in langs], "echo").task_results.select("task", R6("value").alias("value"), "n")


@query("STREAM_windowed_mean", "SELECT date_trunc('day', ts) AS window_start, event_type, round(avg(value), 6) AS value, count(value) AS n FROM events GROUP BY ALL")
def _(s, d):
    return windowed_mean(table(s, d, "events"), "ts", ["event_type"], "value").withColumn("value", R6("value"))
