"""Queries of scans, predicates, requests, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgauge.plans import requests as Q
from sparkgauge.registry import query, table

R6 = lambda c: F.round(c, 6)


@query("S1_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("S4_W14_latest", "SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS event_type, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def _(s, d):
    top = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id"))
    return table(s, d, "events").groupBy("user_id").agg(top.alias("t")).select("user_id", "t.event_type", "t.event_id")


@query("S8_S9_replay", "SELECT doc_id, 'answer ' || (doc_id % 7) AS response FROM documents WHERE n_chars > 500")
def _(s, d):
    req = table(s, d, "documents").where("n_chars > 500").select("doc_id", F.lit(0).alias("idx"), "source")
    log = table(s, d, "documents").select("doc_id", F.concat(F.lit("answer "), (F.col("doc_id") % 7).cast("string")).alias("response"))
    return Q.replay(req, log).select("doc_id", "response")


@query("K5_result_table", "SELECT metric, printf('%.4f', value) AS value FROM (SELECT unnest(['mean', 'max']) AS metric, unnest([avg(n_chars), max(n_chars)::DOUBLE]) AS value FROM documents)")
def _(s, d):
    one = table(s, d, "documents").agg(F.avg("n_chars").alias("mean"), F.max("n_chars").cast("double").alias("max"))
    return one.unpivot([], ["mean", "max"], "metric", "value").select("metric", F.format_string("%.4f", "value").alias("value"))


@query("P1_template", "SELECT p_partkey, 'Q: ' || p_name || chr(10) || 'Brand ' || p_brand || '?' AS ctx FROM part")
def _(s, d):
    part = table(s, d, "part")
    return part.select("p_partkey", Q.template("Q: {{p_name}}\nBrand {{ p_brand }}?", part.columns).alias("ctx"))


@query("P2_P4_dispatch", "SELECT p_partkey, p_name AS text, (p_size % 2)::INT AS target, p_brand || '|' || p_type AS choices FROM part")
def _(s, d):
    part = table(s, d, "part")
    return part.select("p_partkey", Q.doc_to("p_name", part.columns).alias("text"), Q.doc_to(lambda: (F.col("p_size") % 2).cast("int"), part.columns).alias("target"), F.array_join(F.array("p_brand", "p_type"), "|").alias("choices"))


@query("P6_P8_P11_predicates", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars IS NOT NULL AND n_chars > 5 AND contains(text, 'the')")
def _(s, d):
    return table(s, d, "documents").where((F.col("lang") == "en") & F.col("n_chars").isNotNull() & (F.col("n_chars") > 5) & F.col("text").contains("the")).select("doc_id")


@query("P9_P12_recode", "SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 6) AS x, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_returnflag = 'A' THEN 'accepted' ELSE 'none' END AS state FROM lineitem")
def _(s, d):
    state = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted").otherwise("none")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", R6(F.col("l_quantity") / 50).alias("x"), state.alias("state"))


@query("P10_explode", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("R1_R3_choice_requests", """WITH c AS (SELECT p_partkey AS doc_id, unnest([p_brand, p_type]) AS cont, unnest([0, 1]) AS idx, p_name FROM part)
SELECT doc_id, idx, 'cond' AS kind, p_name AS ctx, cont FROM c UNION ALL SELECT doc_id, idx, 'uncond', '', cont FROM c""")
def _(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("ctx"), F.array("p_brand", "p_type").alias("choices"))
    return Q.choice_requests(part, mutual_info=True)


@query("R4_repeats", "SELECT item_id, rep FROM benchmark, range(1, 4) t(rep)")
def _(s, d):
    return Q.repeats(table(s, d, "benchmark").select("item_id"), 3).select("item_id", F.col("rep").cast("long").alias("rep"))


@query("R5_R6_shard_limit", "SELECT doc_id FROM documents WHERE doc_id < (SELECT ceil(count(*) * 0.1) FROM documents) AND doc_id % 4 = 1")
def _(s, d):
    return Q.shard_limit(table(s, d, "documents").select("doc_id"), rank=1, world=4, limit=0.1)


@query("R8_R9_few_shot", """WITH f AS (SELECT item_id, text FROM benchmark WHERE item_id < 3)
SELECT doc_id, md5(string_agg(f.text, chr(10) ORDER BY item_id) || chr(10) || min(d.source)) AS ctx FROM documents d, f WHERE f.item_id <> d.doc_id GROUP BY doc_id""")
def _(s, d):
    shots = table(s, d, "benchmark").where("item_id < 3").select(F.col("item_id").alias("shot_id"), F.col("text").alias("shot"))
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("ctx"))
    return Q.few_shot(docs, shots, "\n").select("doc_id", F.md5("ctx").alias("ctx"))


@query("R11_response_cache", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'cached' ELSE 'model' END AS origin FROM part")
def _(s, d):
    req = table(s, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string")), 256).alias("key"))
    store = table(s, d, "part").where("p_size > 25").select(F.sha2(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string")), 256).alias("key"), F.lit("cached").alias("origin"))
    return Q.through_cache(req, store, lambda miss: miss.withColumn("origin", F.lit("model"))).select("p_partkey", "origin")


@query("J1_requests_of_doc", "SELECT o_orderkey, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    return table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.array_join("lines", ",").alias("lines"))


@query("J2_J3_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("J4_J5_merge", """SELECT a.c_custkey, (a.c_acctbal > 0 AND o.t > 1000)::INT AS both_hit, round(o.t - a.c_acctbal, 4) AS delta FROM customer a JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) o ON o.o_custkey = a.c_custkey""")
def _(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    c = table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    return c.select("c_custkey", ((F.col("c_acctbal") > 0) & (F.col("t") > 1000)).cast("int").alias("both_hit"), F.round(F.col("t") - F.col("c_acctbal"), 4).alias("delta")).orderBy(F.desc("delta"), "c_custkey")


@query("J6_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("J7_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'F'")
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J8_range_join", """WITH i AS (SELECT part_id, lo, lo + 7 AS hi FROM (SELECT p_partkey AS part_id, (p_partkey * 37) % 3000 AS lo FROM part)), e AS (SELECT event_id, event_id % 3000 AS f FROM events)
SELECT part_id, count(*) AS n FROM i JOIN e ON f >= lo AND f < hi GROUP BY part_id""")
def _(s, d):
    i = table(s, d, "part").select(F.col("p_partkey").alias("part_id"), (F.col("p_partkey") * 37 % 3000).alias("lo")).withColumn("hi", F.col("lo") + 7)
    # events of one place are counted before the join, so its rows follow the places and not the events
    e = table(s, d, "events").groupBy((F.col("event_id") % 3000).alias("f")).agg(F.count(F.lit(1)).alias("k"))
    return Q.range_join(e, i, "f", "lo", "hi", bin_width=16).groupBy("part_id").agg(F.sum("k").alias("n"))


@query("J9_overlap_exists", """WITH i AS (SELECT p_partkey AS part_id, (p_partkey * 53) % 5000 AS lo, (p_partkey * 53) % 5000 + 3 AS hi FROM part), t AS (SELECT DISTINCT (event_id * 11) % 5000 AS t FROM events)
SELECT part_id FROM i WHERE EXISTS (SELECT 1 FROM t WHERE t < hi AND t > lo)""")
def _(s, d):
    lo = F.col("p_partkey") * 53 % 5000
    i = table(s, d, "part").select(F.col("p_partkey").alias("part_id"), (lo + 1).alias("lo"), (lo + 3).alias("hi"))
    t = table(s, d, "events").select((F.col("event_id") * 11 % 5000).alias("t")).distinct()
    return Q.range_join(t, i, "t", "lo", "hi", bin_width=8).select("part_id").distinct()


@query("J11_pairs", """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations)
SELECT a.conv_id, a.turn AS first, b.turn AS second FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.p % 2 = 0 AND b.p = a.p + 1""")
def _(s, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    r = table(s, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("p"), F.lead("turn").over(w).alias("second"))
    return r.where("p % 2 = 0 and second is not null").select("conv_id", F.col("turn").alias("first"), "second")


@query("J12_variants", "SELECT o_orderkey % 1000 AS item, count(*) AS variants, arg_min(o_orderstatus, o_orderkey) AS main FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy((F.col("o_orderkey") % 1000).alias("item")).agg(F.count(F.lit(1)).alias("variants"), F.min_by("o_orderstatus", "o_orderkey").alias("main"))


@query("J15_completion", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, 0) AS score FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def _(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "full").select("doc_id", F.coalesce("quality", F.lit(0)).alias("score"))


@query("W3_run_lengths", """WITH x AS (SELECT user_id, event_id, (value > 50)::INT AS v FROM events), i AS (SELECT *, sum((v = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g, lead(v, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM x)
SELECT user_id, event_id, (CASE WHEN v = 1 AND nx = 0 THEN sum(v) OVER (PARTITION BY user_id, g) ELSE 0 END)::BIGINT AS run FROM i""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", (F.col("value") > 50).cast("int").alias("v"))
    return Q.run_lengths(e, ["user_id"], "event_id", "v").select("user_id", "event_id", "run")


@query("W7_chunks", "SELECT doc_id, unnest(list_transform(range(0, ((len(w) + 99) // 100)::BIGINT), lambda i: len(w[i * 100 + 1:i * 100 + 100]))) AS size FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(F.transform(Q.chunks(F.split("text", " "), 100), lambda c: F.size(c).cast("long"))).alias("size"))


@query("W8_uniform_sample", "SELECT doc_id, array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN i = 4 THEN n_chars - 1 ELSE trunc(i * ((n_chars - 1) / 4.0))::BIGINT END), ',') AS frames FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(Q.uniform_sample(F.col("n_chars"), 5), ",").alias("frames"))


@query("W9_top_n", "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def _(s, d):
    return Q.top_n(table(s, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), "doc_id"], 3)


@query("W12_batches", "SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS batch FROM documents")
def _(s, d):
    rn = F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))
    return table(s, d, "documents").select("lang", "doc_id", F.floor((rn - 1) / 16).alias("batch"))


@query("W13_divide", "SELECT lang, doc_id, ntile(5) OVER (PARTITION BY lang ORDER BY doc_id)::INT AS part FROM documents")
def _(s, d):
    return table(s, d, "documents").select("lang", "doc_id", F.ntile(5).over(W.partitionBy("lang").orderBy("doc_id")).alias("part"))


@query("W15_nearest", "SELECT p_partkey, (SELECT r_name FROM region ORDER BY levenshtein(r_name, upper(substr(p_name, 1, 8))), r_regionkey LIMIT 1) AS nearest FROM part")
def _(s, d):
    names = table(s, d, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("names"))
    key = F.upper(F.substring("p_name", 1, 8))
    best = F.array_min(F.transform("names", lambda n: F.struct(F.levenshtein(n["r_name"], key).alias("d"), n["r_regionkey"].alias("k"), n["r_name"].alias("v"))))
    return table(s, d, "part").join(F.broadcast(names), F.lit(True)).select("p_partkey", best["v"].alias("nearest"))


@query("W16_W11_leaderboard", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def _(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("U1_U2_union", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels")
def _(s, d):
    x, y = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")
    return x.unionByName(y).unionByName(y)


@query("U3_last_wins", "SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey")
def _(s, d):
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", "c_custkey").alias("c_name"))


@query("U4_jaccard", "WITH x AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM x")
def _(s, d):
    a, b = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    return table(s, d, "part").select("p_partkey", R6(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("jaccard"))


@query("U5_glob", "SELECT DISTINCT source FROM documents WHERE source GLOB 'src1*'")
def _(s, d):
    return table(s, d, "documents").where(Q.glob(F.col("source"), "src1*")).select("source").distinct()


@query("U6_duplicates", "SELECT text_id, n FROM (SELECT md5(text) AS text_id, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def _(s, d):
    return table(s, d, "documents").groupBy(F.md5("text").alias("text_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
