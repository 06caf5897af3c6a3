"""Queries of the aggregations. Gold is a document's quality; the prediction is a rule on its length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions import metrics as M
from sparkgauge.registry import query, table

SCORED = "SELECT doc_id, lang, source, quality AS gold, toxic, (n_chars > 1200)::INT AS pred, n_chars, -n_chars / 4000.0 AS ll FROM documents JOIN labels USING (doc_id)"


def scored(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(s, d, "labels").select("doc_id", F.col("quality").alias("gold"), "toxic")
    return docs.join(labels, "doc_id").withColumn("pred", (F.col("n_chars") > 1200).cast("int")).withColumn("ll", -F.col("n_chars") / 4000.0)


R6 = lambda c: F.round(c, 6)
G, P = F.col, F.col


def hit():
    return (F.col("gold") == F.col("pred")).cast("double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with its standard error for each language, and over all."""
    each = scored(spark, sf_dir).withColumn("hit", hit()).groupBy("lang").agg(F.avg("hit").alias("value"), M.mean_stderr(F.col("hit")).alias("stderr"), F.count(F.lit(1)).alias("n"))
    whole = each.agg(F.lit("all").alias("lang"), M.weighted_mean(F.col("value"), F.col("n")).alias("value"), M.pooled_stderr(F.col("stderr"), F.col("n")).alias("stderr"), F.sum("n").alias("n"))
    return each.unionByName(whole).select("lang", R6("value").alias("value"), R6("stderr").alias("stderr"), "n")


query("A20_A21_group_result", f"""
WITH e AS (SELECT lang, avg((gold = pred)::INT) AS value, stddev_samp((gold = pred)::INT) / sqrt(count(*)) AS stderr, count(*) AS n FROM ({SCORED}) GROUP BY lang)
SELECT lang, round(value, 6) AS value, round(stderr, 6) AS stderr, n FROM e
UNION ALL SELECT 'all', round(sum(value * n) / sum(n), 6), round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6), sum(n)::BIGINT FROM e
""")(flagship)


@query("A1_A6_means", f"""SELECT lang, 999 AS bypass, round(avg(ll), 6) AS mean, round(quantile_cont(ll, 0.5), 6) AS median, round(exp(-avg(ll)), 6) AS perplexity,
round(exp(-sum(ll) / sum(n_chars)), 6) AS weighted_perplexity, round(-sum(ll) / sum(n_chars) / ln(2), 6) AS bits_per_byte FROM ({SCORED}) GROUP BY lang""")
def _(s, d):
    x, n = F.col("ll"), F.col("n_chars")
    return scored(s, d).groupBy("lang").agg(
        M.bypass(x).alias("bypass"), R6(M.mean(x)).alias("mean"), R6(M.median(x)).alias("median"), R6(M.perplexity(x)).alias("perplexity"),
        R6(M.weighted_perplexity(x, n)).alias("weighted_perplexity"), R6(M.bits_per_byte(x, n)).alias("bits_per_byte"),
    )


@query("A3_positional_median", f"SELECT lang, ll AS median FROM (SELECT lang, round(ll, 6) AS ll, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM ({SCORED})) WHERE p = n // 2")
def _(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("lang")
    x = scored(s, d).withColumn("p", F.row_number().over(w.orderBy("doc_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where(F.col("p") == F.floor(F.col("n") / 2)).select("lang", R6("ll").alias("median"))


_CONF = "count(*) FILTER (gold = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (gold = 0 AND pred = 1)::DOUBLE AS fp, count(*) FILTER (gold = 1 AND pred = 0)::DOUBLE AS fn, count(*) FILTER (gold = 0 AND pred = 0)::DOUBLE AS tn"


@query("A7_A8_A24_confusion", f"""WITH c AS (SELECT source, {_CONF}, avg(gold) AS yes_ratio, avg(pred) AS pred_yes_ratio FROM ({SCORED}) GROUP BY source)
SELECT source, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(yes_ratio, 6) AS yes_ratio, round(pred_yes_ratio, 6) AS pred_yes_ratio FROM c""")
def _(s, d):
    g, p = F.col("gold"), F.col("pred")
    return scored(s, d).groupBy("source").agg(R6(M.f1(g, p)).alias("f1"), R6(M.matthews(g, p)).alias("mcc"), R6(M.precision(g, p)).alias("precision"), R6(M.recall(g, p)).alias("recall"), R6(F.avg("gold")).alias("yes_ratio"), R6(F.avg("pred")).alias("pred_yes_ratio"))


@query("A10_brier", f"SELECT lang, round(avg(pow(1 - p - (gold = 0)::INT, 2) + pow(p - (gold = 1)::INT, 2)), 6) AS brier FROM (SELECT *, 1 / (1 + exp(ll)) AS p FROM ({SCORED})) GROUP BY lang")
def _(s, d):
    p = 1 / (1 + F.exp("ll"))
    return scored(s, d).groupBy("lang").agg(R6(M.brier(F.array(1 - p, p), F.col("gold"))).alias("brier"))


_LL = "SELECT l_orderkey, list(l_extendedprice / 1000.0 ORDER BY l_linenumber, l_extendedprice, l_quantity) AS ll, list(l_quantity ORDER BY l_linenumber, l_extendedprice, l_quantity) AS n, (l_orderkey % 3)::INT AS gold FROM lineitem GROUP BY l_orderkey"


def choices(s, d):
    one = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_extendedprice") / 1000.0).alias("ll"), F.col("l_quantity").alias("n"))))
    x = table(s, d, "lineitem").groupBy("l_orderkey").agg(one.alias("c"))
    return x.select("l_orderkey", F.col("c.ll").alias("ll"), F.col("c.n").alias("n"), (F.col("l_orderkey") % 3).cast("int").alias("gold"))


@query("A11_choice_accuracy", f"""WITH c AS ({_LL})
SELECT round(avg((list_position(ll, list_min(ll)) - 1 = gold)::INT), 6) AS acc, round(avg((list_position(list_transform(ll, lambda x, i: x / n[i]), list_min(list_transform(ll, lambda x, i: x / n[i]))) - 1 = gold)::INT), 6) AS acc_norm,
round(avg((list_position(list_transform(ll, lambda x, i: x - n[i]), list_max(list_transform(ll, lambda x, i: x - n[i]))) - 1 = gold)::INT), 6) AS acc_mutual_info FROM c""")
def _(s, d):
    best = lambda a, pick: F.avg((F.array_position(a, pick(a)) - 1 == F.col("gold")).cast("double"))
    norm, diff = F.zip_with("ll", "n", lambda a, b: a / b), F.zip_with("ll", "n", lambda a, b: a - b)
    return choices(s, d).agg(R6(best(F.col("ll"), F.array_min)).alias("acc"), R6(best(norm, F.array_min)).alias("acc_norm"), R6(best(diff, F.array_max)).alias("acc_mutual_info"))


@query("A12_exact_match", "SELECT round(avg((regexp_replace(lower(regexp_replace(p_name, '[0-9]', '', 'g')), '[[:punct:]]', '', 'g') = regexp_replace(lower(p_name), '[[:punct:]]', '', 'g'))::INT), 6) AS exact_match FROM part")
def _(s, d):
    bare = lambda c: F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return table(s, d, "part").agg(R6(F.avg((bare(F.regexp_replace("p_name", "[0-9]", "")) == bare(F.col("p_name"))).cast("double"))).alias("exact_match"))


@query("A14_A17_all_right", """WITH a AS (SELECT o_custkey % 50 AS par, o_orderkey % 7 AS q, o_orderstatus <> 'P' AND o_orderkey % 11 <> 0 AS ok FROM orders), p AS (SELECT bool_and(ok)::INT AS v FROM a GROUP BY par, q), q AS (SELECT bool_and(ok)::INT AS v FROM a GROUP BY q)
SELECT round((SELECT avg(v) FROM p), 6) AS acc_all, round((SELECT stddev_samp(v) / sqrt(count(*)) FROM q), 6) AS stderr""")
def _(s, d):
    a = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("par"), (F.col("o_orderkey") % 7).alias("q"), ((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 11 != 0)).alias("ok"))
    p = a.groupBy("par", "q").agg(F.bool_and("ok").cast("double").alias("v"))
    wide = p.agg(R6(F.avg("v")).alias("acc_all"))
    narrow = p.groupBy("q").agg(F.min("v").alias("v")).agg(R6(M.mean_stderr(F.col("v"))).alias("stderr"))
    return wide.join(narrow, F.lit(True))


@query("A16_spread", f"SELECT source, round(stddev_pop(n_chars), 4) AS pop, round(stddev_samp(n_chars), 4) AS samp, round(stddev_samp(n_chars) / sqrt(count(*)), 4) AS stderr FROM ({SCORED}) GROUP BY source")
def _(s, d):
    n = F.col("n_chars")
    return scored(s, d).groupBy("source").agg(F.round(F.stddev_pop(n), 4).alias("pop"), F.round(F.stddev_samp(n), 4).alias("samp"), F.round(M.mean_stderr(n), 4).alias("stderr"))


@query("A18_bootstrap")
def _(s, d):
    """Standard error of the mean over 200 Poisson replicates; weights come from a hash of (replicate, row)."""
    x = scored(s, d).select("doc_id", hit().alias("v"))
    u = (F.xxhash64("b", "doc_id").bitwiseAND(F.lit((1 << 52) - 1)).cast("double")) / float(1 << 52)
    limits = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum(((u >= q).cast("int") for q in limits), F.lit(0))
    replicas = x.select("doc_id", "v", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("b")).withColumn("w", weight)
    means = replicas.groupBy("b").agg(M.weighted_mean(F.col("v"), F.col("w")).alias("m"))
    return means.agg(R6(F.stddev_samp("m")).alias("stderr"), F.count("m").alias("replicates"))


@query("A22_combined_stderr")
def _(s, d):
    """Pairwise fold of group errors, in the order of the group names."""
    g = scored(s, d).groupBy("lang").agg(F.avg(hit()).alias("m"), M.mean_stderr(hit()).alias("e"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("lang", "m", "e", "n")))

    def fold(a, b):
        n = a["n"] + b["n"]
        m = (a["m"] * a["n"] + b["m"] * b["n"]) / n
        v = ((a["n"] - 1) * a["v"] + (b["n"] - 1) * b["e"] * b["e"]) / (n - 1) + a["n"] * b["n"] / (n * (n - 1)) * F.pow(a["m"] - b["m"], F.lit(2))
        return F.struct(m.alias("m"), v.alias("v"), n.alias("n"))

    first = lambda r: F.struct(r[0]["m"].alias("m"), (r[0]["e"] * r[0]["e"]).alias("v"), r[0]["n"].alias("n"))
    one = g.agg(rows.alias("r"))
    return one.select(R6(F.aggregate(F.slice("r", 2, 1000), first(F.col("r")), fold, lambda a: F.sqrt(a["v"]))).alias("stderr"))


@query("A23_group_rollup", f"""WITH RECURSIVE tree(parent, child) AS (VALUES ('root', 'west'), ('root', 'south'), ('west', 'en'), ('west', 'de'), ('south', 'fr'), ('south', 'es')),
reach AS (SELECT parent AS g, child AS t FROM tree UNION ALL SELECT r.g, tree.child FROM reach r JOIN tree ON tree.parent = r.t),
e AS (SELECT lang, avg((gold = pred)::INT) AS v, count(*) AS n FROM ({SCORED}) GROUP BY lang)
SELECT g AS group_name, round(sum(v * n) / sum(n), 6) AS value, round(avg(v), 6) AS unweighted, sum(n)::BIGINT AS n FROM reach JOIN e ON e.lang = t GROUP BY g""")
def _(s, d):
    scored(s, d).groupBy("lang").agg(F.avg(hit()).alias("v"), F.count(F.lit(1)).alias("n")).createOrReplaceTempView("sg_task_results")
    return s.sql("""WITH RECURSIVE tree(parent, child) AS (VALUES ('root', 'west'), ('root', 'south'), ('west', 'en'), ('west', 'de'), ('south', 'fr'), ('south', 'es')),
reach(g, t) AS (SELECT parent, child FROM tree UNION ALL SELECT r.g, tree.child FROM reach r JOIN tree ON tree.parent = r.t)
SELECT g AS group_name, round(sum(v * n) / sum(n), 6) AS value, round(avg(v), 6) AS unweighted, sum(n) AS n FROM reach JOIN sg_task_results e ON e.lang = t GROUP BY g""")


@query("A25_consistency", "SELECT round(avg(v), 6) AS consistent FROM (SELECT bool_and(length(text) > 20)::INT AS v FROM conversations GROUP BY conv_id)")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.bool_and(F.length("text") > 20).cast("double").alias("v")).agg(R6(F.avg("v")).alias("consistent"))


@query("A26_pair_score", """WITH h AS (SELECT p_brand, p_partkey // 2 AS pair, (p_size > 20)::INT AS v FROM part), p AS (SELECT p_brand, pair, sum(v) AS v, count(*) AS n FROM h GROUP BY ALL HAVING count(*) = 2),
c AS (SELECT p_brand, sum(v) / sum(n) * 100 AS acc, avg((v = 2)::INT) * 100 AS plus FROM p GROUP BY p_brand) SELECT round(sum(acc + plus), 6) AS score FROM c""")
def _(s, d):
    h = table(s, d, "part").select("p_brand", F.floor(F.col("p_partkey") / 2).alias("pair"), (F.col("p_size") > 20).cast("int").alias("v"))
    p = h.groupBy("p_brand", "pair").agg(F.sum("v").alias("v"), F.count("v").alias("n")).where("n = 2")
    c = p.groupBy("p_brand").agg((M.ratio(F.sum("v"), F.sum("n")) * 100 + F.avg((F.col("v") == 2).cast("double")) * 100).alias("score"))
    return c.agg(R6(F.sum("score")).alias("score"))


@query("A27_A28_macro_micro", f"""WITH c AS (SELECT lang, source, avg((gold = pred)::INT) AS a, count(*) AS n FROM ({SCORED}) GROUP BY ALL)
SELECT lang, round(avg(a), 6) AS macro, round(sum(a * n) / sum(n), 6) AS micro FROM c GROUP BY lang""")
def _(s, d):
    c = scored(s, d).groupBy("lang", "source").agg(F.avg(hit()).alias("a"), F.count(F.lit(1)).alias("n"))
    return c.groupBy("lang").agg(R6(F.avg("a")).alias("macro"), R6(M.weighted_mean(F.col("a"), F.col("n"))).alias("micro"))


@query("A29_marginals", f"SELECT lang, source, toxic, round(avg((gold = pred)::INT), 6) AS acc, count(*) AS n FROM ({SCORED}) GROUP BY GROUPING SETS ((lang), (source), (toxic), ())")
def _(s, d):
    return scored(s, d).groupingSets([["lang"], ["source"], ["toxic"], []], "lang", "source", "toxic").agg(R6(F.avg(hit())).alias("acc"), F.count(F.lit(1)).alias("n"))


@query("A30_breakdown", f"""WITH x AS (SELECT unnest(['lang', 'source']) AS key, unnest([lang, source]) AS value, gold, pred FROM ({SCORED}))
SELECT key, value, round(avg((gold = pred)::INT), 6) AS acc FROM x GROUP BY ALL""")
def _(s, d):
    x = scored(s, d).withColumn("hit", hit()).select("hit", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("key", "value"))
    return x.groupBy("key", "value").agg(R6(F.avg("hit")).alias("acc"))


@query("A31_capabilities", f"""WITH x AS (SELECT string_split(CASE WHEN toxic = 1 THEN lang || ',toxic' ELSE lang END, ',') AS caps, (gold = pred)::INT AS v FROM ({SCORED}))
SELECT 'any:' || c AS capability, round(avg(v), 6) AS score FROM (SELECT unnest(caps) AS c, v FROM x) GROUP BY c UNION ALL SELECT 'set:' || array_to_string(list_sort(caps), ','), round(avg(v), 6) FROM x GROUP BY 1""")
def _(s, d):
    x = scored(s, d).select(F.split(F.when(F.col("toxic") == 1, F.concat("lang", F.lit(",toxic"))).otherwise(F.col("lang")), ",").alias("caps"), hit().alias("v"))
    any_ = x.select(F.explode("caps").alias("c"), "v").groupBy("c").agg(R6(F.avg("v")).alias("score")).select(F.concat(F.lit("any:"), "c").alias("capability"), "score")
    return any_.unionByName(x.groupBy(F.concat(F.lit("set:"), F.array_join(F.array_sort("caps"), ",")).alias("capability")).agg(R6(F.avg("v")).alias("score")))


@query("A32_two_by_two", """WITH i AS (SELECT p_partkey // 4 AS item, max(CASE WHEN p_partkey % 4 = 0 THEN (p_size > 10)::INT END) AS a, max(CASE WHEN p_partkey % 4 = 1 THEN (p_size > 10)::INT END) AS b, max(CASE WHEN p_partkey % 4 = 2 THEN (p_size > 10)::INT END) AS c, max(CASE WHEN p_partkey % 4 = 3 THEN (p_size > 10)::INT END) AS d FROM part GROUP BY 1 HAVING count(*) = 4)
SELECT round(avg((a = 1 AND b = 1)::INT), 6) AS text_score, round(avg((a = 1 AND c = 1)::INT), 6) AS image_score, round(avg((a + b + c + d = 4)::INT), 6) AS group_score FROM i""")
def _(s, d):
    v = (F.col("p_size") > 10).cast("int")
    i = table(s, d, "part").groupBy(F.floor(F.col("p_partkey") / 4).alias("item")).agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("p_partkey") % 4 == k, v)).alias(c) for k, c in enumerate("abcd"))).where("n = 4")
    rate = lambda c: R6(F.avg(F.expr(c).cast("double")))
    return i.agg(rate("a = 1 and b = 1").alias("text_score"), rate("a = 1 and c = 1").alias("image_score"), rate("a + b + c + d = 4").alias("group_score"))


@query("A34_ratio_of_means", "SELECT round(round(avg(CASE WHEN value >= 0 THEN value END), 3) / nullif(round(avg(CASE WHEN value >= 0 THEN value + 1 END), 3), 0) * 100, 1) AS ratio FROM events WHERE value <> -999")
def _(s, d):
    v = F.when(F.col("value") >= 0, F.col("value"))
    return table(s, d, "events").where("value <> -999").agg(F.round(F.try_divide(F.round(F.avg(v), 3), F.round(F.avg(v + 1), 3)) * 100, 1).alias("ratio"))


@query("A35_A48_value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def _(s, d):
    from pyspark.sql import Window as W

    c = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total), F.lit(True)).select("event_type", "n", R6(M.ratio(F.col("n"), F.col("total"))).alias("share"))


@query("A36_A38_battles", """WITH r AS (SELECT c_mktsegment AS m, 1000 + avg(c_acctbal) / 50 AS e, avg((c_acctbal > 4000)::INT) AS w FROM customer GROUP BY 1)
SELECT a.m AS model_a, b.m AS model_b, round(1 / (1 + pow(10, (b.e - a.e) / 400)), 6) AS expected, round(a.w, 6) AS win_rate FROM r a, r b""")
def _(s, d):
    r = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("m")).agg((1000 + F.avg("c_acctbal") / 50).alias("e"), F.avg((F.col("c_acctbal") > 4000).cast("double")).alias("w"))
    a, b = (r.select(*(F.col(c).alias(f"{x}_{c}") for c in r.columns)) for x in "ab")
    return a.crossJoin(b).select(F.col("a_m").alias("model_a"), F.col("b_m").alias("model_b"), R6(1 / (1 + F.pow(F.lit(10.0), (F.col("b_e") - F.col("a_e")) / 400))).alias("expected"), R6("a_w").alias("win_rate"))


@query("A42_percentiles", f"SELECT lang, round(quantile_cont(n_chars, 0.025), 6) AS low, round(quantile_cont(n_chars, 0.975), 6) AS high, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 4) AS std FROM ({SCORED}) GROUP BY lang")
def _(s, d):
    return scored(s, d).groupBy("lang").agg(R6(F.percentile("n_chars", F.lit(0.025))).alias("low"), R6(F.percentile("n_chars", F.lit(0.975))).alias("high"), R6(F.avg("n_chars")).alias("mean"), F.round(F.stddev_pop("n_chars"), 4).alias("std"))


@query("A43_circular", "WITH v AS (SELECT o_orderkey % 1000 AS i, bool_and(o_totalprice > 2000)::INT AS v, min(o_orderpriority) AS c FROM orders GROUP BY 1) SELECT c AS category, round(avg(v), 6) AS acc FROM v GROUP BY c")
def _(s, d):
    v = table(s, d, "orders").groupBy((F.col("o_orderkey") % 1000).alias("i")).agg(F.bool_and(F.col("o_totalprice") > 2000).cast("double").alias("v"), F.min("o_orderpriority").alias("category"))
    return v.groupBy("category").agg(R6(F.avg("v")).alias("acc"))


@query("A45_skip_mean", "SELECT event_type, round(avg(CASE WHEN event_id % 7 <> 0 THEN value END), 6) AS score, count(CASE WHEN event_id % 7 <> 0 THEN 1 END) AS n FROM events GROUP BY ROLLUP (event_type)")
def _(s, d):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(s, d, "events").rollup("event_type").agg(R6(F.avg(v)).alias("score"), F.count(v).alias("n"))


@query("A47_nearest_rank", "SELECT l_returnflag, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p90"))


@query("A49_taxonomy", f"SELECT lang, count(*) FILTER (gold = 0 AND pred = 1) AS language_error, count(*) FILTER (gold = 1 AND pred = 0) AS visual_error, count(*) FILTER (gold <> pred AND toxic = 1) AS mixed FROM ({SCORED}) GROUP BY lang")
def _(s, d):
    n = lambda c: F.count_if(F.expr(c))
    return scored(s, d).groupBy("lang").agg(n("gold = 0 and pred = 1").alias("language_error"), n("gold = 1 and pred = 0").alias("visual_error"), n("gold <> pred and toxic = 1").alias("mixed"))
