"""Queries of consensus and tree metrics, spectral clusters, event selection and request details."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgauge.functions import filters as R
from sparkgauge.functions import metrics as M
from sparkgauge.functions import overlap as O
from sparkgauge.functions.vector import cosine
from sparkgauge.operators.spectral import nearest_edges, spectral
from sparkgauge.plans import requests as Q
from sparkgauge.queries.generated import _PAIRS, R6, pairs
from sparkgauge.queries.graphs import _S, TAU, R4, edges, similar
from sparkgauge.registry import query, table

_CIDER = f"""
WITH base AS (
  SELECT p_partkey, list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '') AS p, list_filter(regexp_split_to_array(r, '\\s+'), lambda w: w <> '') AS r FROM ({_PAIRS})
), sides AS (
  SELECT p_partkey, greatest(len(p) - 1, 0) - greatest(len(r) - 1, 0) AS delta, unnest([{{'side': 'p', 'w': p}}, {{'side': 'r', 'w': r}}], recursive := true) FROM base
), orders AS (
  SELECT sides.*, n FROM sides, range(1, 5) t(n)
), grams AS (
  SELECT p_partkey, delta, side, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM orders
), tf AS (
  SELECT p_partkey, n, gram, delta, count(*) FILTER (side = 'p') AS a, count(*) FILTER (side = 'r') AS b FROM grams GROUP BY ALL
), spread AS (
  SELECT n, gram, count(*) AS df FROM tf WHERE b > 0 GROUP BY ALL
), weighed AS (
  SELECT p_partkey, n, delta, a * i AS a, b * i AS b FROM (
    SELECT tf.*, ln((SELECT count(*) FROM part)) - ln(coalesce(df, 1)) AS i FROM tf LEFT JOIN spread USING (n, gram))
), dots AS (
  SELECT p_partkey, n, delta, sum(least(a, b) * b) AS ab, sqrt(sum(a * a)) * sqrt(sum(b * b)) AS norm FROM weighed GROUP BY ALL
)
SELECT p_partkey, round(coalesce(cider, 0), 4) AS cider FROM part LEFT JOIN (
  SELECT p_partkey, 10 * sum(CASE WHEN norm > 0 THEN ab / norm ELSE 0 END * exp(-delta * delta / 72.0)) / 4 AS cider FROM dots GROUP BY p_partkey) USING (p_partkey)
"""


@query("A40_cider", _CIDER)
def _(s, d):
    return O.cider(pairs(s, d), "p_partkey", "p", "r").select("p_partkey", F.round("cider", 4).alias("cider"))


@query("A9_translation_edits")
def _(s, d):
    e = pairs(s, d).select(O.translation_edits("p", "r").alias("e"))
    return e.agg(R6(100 * F.try_divide(F.sum("e.edits").cast("double"), F.sum("e.length").cast("double"))).alias("ter"), F.sum("e.length").alias("n"))


@query("A44_tree_accuracy")
def _(s, d):
    e = table(s, d, "events").select("event_id", "props", F.lead("props").over(W.partitionBy("user_id").orderBy("event_id")).alias("other"))
    return e.select("event_id", R6(O.tree_accuracy("other", "props")).alias("accuracy"))


@query("X18_transcript", r"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<\|.*?\|>', ' ', 'g'), '\s+', ' ', 'g'), ' ?([!,.?;:])', '\1', 'g'), '^ +', ''), ' '), lambda w: NOT regexp_matches(w, '^\p{P}+$')), ' ') AS said FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", O.spoken(F.col("text")).alias("said"))


@query("A33_flat_mean", "SELECT conv_id, round(avg(v), 6) AS value, count(*) AS n FROM (SELECT conv_id, unnest([contains(text, ',')::INT, contains(text, '?')::INT, (length(text) > 40)::INT]) AS v FROM conversations) GROUP BY conv_id")
def _(s, d):
    checks = F.array(*(c.cast("int") for c in (F.col("text").contains(","), F.col("text").contains("?"), F.length("text") > 40)))
    return table(s, d, "conversations").select("conv_id", F.explode(checks).alias("v")).groupBy("conv_id").agg(R6(F.avg("v")).alias("value"), F.count("v").alias("n"))


@query("A41_embedding_similarity", f"SELECT label, round(avg(sim), 4) + 0.0 AS value FROM ({_S}) GROUP BY label")
def _(s, d):
    w = W.partitionBy("label").orderBy("vec_id")
    e = table(s, d, "embeddings").select("label", cosine(F.col("embedding"), F.lag("embedding").over(w)).alias("sim"))
    return e.groupBy("label").agg(R4(F.avg("sim")).alias("value"))


@query("P3_targets", "SELECT p_partkey, CASE WHEN t LIKE '[%' THEN json_extract_string(t, '$[0]') ELSE t END AS target, try_cast(t AS BIGINT) AS choice FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '[\"' || p_brand || '\", \"x\"]' ELSE p_name END AS t FROM part)")
def _(s, d):
    t = table(s, d, "part").select("p_partkey", F.expr("CASE p_size % 3 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat('[\"', p_brand, '\", \"x\"]') ELSE p_name END").alias("t"))
    return t.select("p_partkey", F.when(F.col("t").startswith("["), F.get(F.from_json("t", "array<string>"), F.lit(0))).otherwise(F.col("t")).alias("target"), F.expr("try_cast(t AS BIGINT)").alias("choice"))


@query("P5_shuffled_choices", "SELECT p_partkey, list_position(c, p_name)::INT - 1 AS gold, array_to_string(c, '|') AS choices FROM (SELECT p_partkey, p_name, list_transform(list_sort(list_transform([p_name, p_type, p_brand], lambda x, i: md5('7:' || p_partkey || ':' || (i - 1)) || x)), lambda x: x[33:]) AS c FROM part)")
def _(s, d):
    keyed = F.transform(F.array("p_name", "p_type", "p_brand"), lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit("7"), F.col("p_partkey"), i)).alias("k"), x.alias("x")))
    c = table(s, d, "part").withColumn("c", F.transform(F.array_sort(keyed), lambda x: x["x"]))
    return c.select("p_partkey", (F.array_position("c", F.col("p_name")) - 1).cast("int").alias("gold"), F.array_join("c", "|").alias("choices"))


@query("P7_category", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def _(s, d):
    return table(s, d, "supplier").where("s_nationkey = 7").select("s_suppkey", "s_name")


@query("R10_request_cache", "SELECT o_orderkey, md5('prio:' || o_orderpriority) AS cache_key, o_orderkey % 5 = 0 AS built FROM orders")
def _(s, d):
    """Cached requests are taken as they are; only the rest is built."""
    key = F.md5(F.concat(F.lit("prio:"), F.col("o_orderpriority")))
    o = table(s, d, "orders")
    cached = o.where("o_orderkey % 5 <> 0").select("o_orderkey", key.alias("cache_key"))
    built = o.join(cached, "o_orderkey", "left_anti").select("o_orderkey", key.alias("cache_key"), F.lit(True).alias("built"))
    return cached.withColumn("built", F.lit(False)).unionByName(built)


@query("R12_rounds", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS rounds FROM customer")
def _(s, d):
    """Up to three rounds; a document leaves when its round's answer is final."""
    left, done = table(s, d, "customer").select("c_custkey", "c_acctbal"), []
    for k, final in enumerate(("c_acctbal < 0", "c_acctbal < 5000", "true"), 1):
        done.append(left.where(final).select("c_custkey", F.lit(k).alias("rounds")))
        left = left.where(f"not ({final})")
    return done[0].unionByName(done[1]).unionByName(done[2])


@query("K6_flat_samples", "SELECT doc_id, lang AS task, length(text) AS input_len, text[1:20] AS input, md5(text) AS doc_hash FROM documents")
def _(s, d):
    nested = table(s, d, "documents").select("doc_id", F.struct(F.col("lang").alias("task"), F.struct(F.col("text").alias("input")).alias("args")).alias("sample"))
    text = F.col("sample.args.input")
    return nested.select("doc_id", F.col("sample.task").alias("task"), F.length(text).cast("long").alias("input_len"), F.substring(text, 1, 20).alias("input"), F.md5(text).alias("doc_hash"))


def by_label(s, d):
    return edges(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("label").cast("long").alias("graph")), "v")


@query("G13_nearest_edges", f"""WITH e AS (SELECT label::BIGINT AS graph, prev AS u, vec_id AS v, sim AS w FROM ({_S}) WHERE sim >= {TAU}),
b AS (SELECT graph, u, v, w FROM e UNION ALL SELECT graph, v, u, w FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY graph, u ORDER BY w DESC, v) AS k FROM b)
SELECT DISTINCT graph, least(u, v) AS u, greatest(u, v) AS v, round(w, 4) + 0.0 AS w FROM r WHERE k <= 1""")
def _(s, d):
    return nearest_edges(by_label(s, d), 1).withColumn("w", R4("w"))


@query("G12_spectral")
def _(s, d):
    return spectral(by_label(s, d), 3)


@query("G13_fast_spectral")
def _(s, d):
    return spectral(nearest_edges(by_label(s, d), 2), 3, normalised=True)


@query("G15_event_tokens", f"SELECT DISTINCT vec_id FROM ({_S}) WHERE sim < 0")
def _(s, d):
    return similar(s, d).where("sim < 0").select("vec_id").distinct()


@query("G17_fill_to_budget", f"""WITH x AS (SELECT label, vec_id, sim, coalesce(sim < 0, false) AS event FROM ({_S})),
r AS (SELECT label, vec_id, event, row_number() OVER (PARTITION BY label ORDER BY event DESC, round(sim, 6) DESC NULLS LAST, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM x)
SELECT label, vec_id, event FROM r WHERE event OR k <= ceil(n * 0.3)""")
def _(s, d):
    w = W.partitionBy("label")
    x = similar(s, d).select("label", "vec_id", F.round("sim", 6).alias("sim"), F.coalesce(F.col("sim") < 0, F.lit(False)).alias("event"))
    x = x.withColumn("k", F.row_number().over(w.orderBy(F.desc("event"), F.desc_nulls_last("sim"), "vec_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where(F.col("event") | (F.col("k") <= F.ceil(F.col("n") * 0.3))).select("label", "vec_id", "event")


_WORDS = "SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL"


@query("W5_W6_rolling_windows", f"""WITH d AS ({_WORDS}), x AS (
  SELECT doc_id, w, len(w) AS n, unnest(list_concat([0], range(64, len(w), 57))) AS lo FROM d
), y AS (SELECT *, CASE WHEN lo = 0 THEN least(64, n) ELSE least(lo + 57, n) END AS stop FROM x)
SELECT doc_id, lo::BIGINT AS first, array_to_string(CASE WHEN lo = 0 THEN ['<s>'] ELSE w[stop - 64:lo] END, ' ') AS context, array_to_string(w[lo + 1:stop], ' ') AS pred FROM y""")
def _(s, d):
    windows = Q.rolling_windows(F.split("text", " "), F.lit("<s>"), 64, 8)
    each = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.transform(windows, Q.disjoint)).alias("k", "w"))
    first = F.when(F.col("k") == 0, 0).otherwise(64 + (F.col("k") - 1) * 57).cast("long")
    return each.select("doc_id", first.alias("first"), F.array_join("w.input", " ").alias("context"), F.array_join("w.pred", " ").alias("pred"))


@query("R8_random_shots", """WITH r AS (
  SELECT p_partkey AS doc_id, p_name, n_name, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(concat_ws('|', '7', p_partkey, n_nationkey)), n_nationkey) AS k FROM part, nation WHERE n_nationkey <> p_partkey)
SELECT doc_id, string_agg(n_name, ';' ORDER BY k) || ';' || min(p_name) AS ctx FROM r WHERE k <= 3 GROUP BY doc_id""")
def _(s, d):
    docs = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("ctx"))
    shots = table(s, d, "nation").select(F.col("n_nationkey").alias("shot_id"), F.col("n_name").alias("shot"))
    return Q.random_shots(docs, shots, 3, ";", "7")


@query("S7_drop_column", "SELECT * EXCLUDE (embedding) FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").drop("embedding")


@query("F6_simple_multi_choice", r"""WITH x AS (SELECT p_partkey, p_name, p_type, trim(regexp_replace(unnest(['It is ' || p_type || '.', p_name || ', not ' || p_type, '#' || p_brand]), '[^\w\s]', '', 'g')) AS c, unnest([1, 2, 3]) AS k FROM part)
SELECT p_partkey, string_agg(CASE WHEN contains(c, p_name) AND NOT (contains(c, p_type) AND strpos(c, p_type) < strpos(c, p_name)) THEN 'A' WHEN contains(c, p_type) THEN 'B' ELSE c END, '|' ORDER BY k) AS answers FROM x GROUP BY p_partkey""")
def _(s, d):
    q = F.concat(F.lit("Pick\nA. "), F.col("p_name"), F.lit("\nB. "), F.col("p_type"))
    said = F.array(F.concat(F.lit("It is "), F.col("p_type"), F.lit(".")), F.concat(F.col("p_name"), F.lit(", not "), F.col("p_type")), F.concat(F.lit("#"), F.col("p_brand")))
    return table(s, d, "part").select("p_partkey", F.array_join(R.simple_multi_choice(q)(said), "|").alias("answers"))


@query("A15_max_over_truths", "SELECT p_partkey, round(greatest(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand))::DOUBLE), 6) AS best FROM part")
def _(s, d):
    near = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return table(s, d, "part").select("p_partkey", R6(M.max_over_truths(near, F.col("p_name"), F.array("p_type", "p_brand"))).alias("best"))


_CLASSES = "SELECT p_size % 5 AS g, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 ELSE p_size % 5 END AS p FROM part"


@query("A8_matthews_classes", f"""WITH x AS ({_CLASSES}), c AS (SELECT k, count(*) FILTER (side = 0)::DOUBLE AS t, count(*) FILTER (side = 1)::DOUBLE AS p FROM (SELECT g AS k, 0 AS side FROM x UNION ALL SELECT p, 1 FROM x) GROUP BY k),
s AS (SELECT sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp FROM c), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (g = p)::DOUBLE AS r FROM x)
SELECT round((r * n - tp) / sqrt((n * n - pp) * (n * n - tt)), 6) AS mcc FROM s, n""")
def _(s, d):
    x = table(s, d, "part").select((F.col("p_size") % 5).alias("g"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5).otherwise(F.col("p_size") % 5).alias("p"))
    return M.matthews_many(x, "g", "p").select(R6("mcc").alias("mcc"))


@query("A19_stderr_of_mean", "SELECT round(stddev_samp(p_size) / sqrt(count(*)), 6) AS stderr FROM part")
def _(s, d):
    size = F.col("p_size")
    return M.stderr_for("mean", 200)(table(s, d, "part"), "p_partkey", size, F.avg(size)).select(R6("stderr").alias("stderr"))


@query("A19_stderr_of_median")
def _(s, d):
    size = F.col("p_size")
    return M.stderr_for("median", 200)(table(s, d, "part"), "p_partkey", size, M.median(size)).select(R6("stderr").alias("stderr"))
