"""Queries of the scalar functions and the response filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgauge.functions import filters as R
from sparkgauge.functions import text as X
from sparkgauge.registry import query, table

# DuckDB counts bytes in levenshtein, so both sides keep ASCII only
_ASCII = "regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')"


def ascii_(name="text"):
    return F.regexp_replace(name, r"[^\x20-\x7E]", "")


@query("X1_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS distance FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("X2_anls", """WITH n AS (SELECT p_partkey, p_name AS p, unnest([concat_ws(' ', p_brand, p_name), p_type, p_name || 's']) AS r FROM part), m AS (SELECT p_partkey, min(levenshtein(lower(p), lower(r))::DOUBLE / greatest(length(p), length(r))) AS least FROM n GROUP BY p_partkey)
SELECT p_partkey, round(CASE WHEN least < 0.5 THEN 1 - least ELSE 0 END, 6) AS anls FROM m""")
def _(s, d):
    """Whole names against their brand and name, their type, and a plural."""
    return table(s, d, "part").select("p_partkey", F.round(X.anls(F.col("p_name"), F.array(F.concat_ws(" ", "p_brand", "p_name"), "p_type", F.concat("p_name", F.lit("s")))), 6).alias("anls"))


@query("X3_relaxed_match", """
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || '%' ELSE p_size::VARCHAR END AS t, CASE WHEN p_partkey % 5 = 0 THEN 'about ' || p_size ELSE (p_size + p_partkey % 4)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '%' ELSE '' END END AS p FROM part),
n AS (SELECT *, CASE WHEN t LIKE '%\\%' ESCAPE '\\' THEN try_cast(replace(t, '%', '') AS DOUBLE) / 100 ELSE try_cast(t AS DOUBLE) END AS tn, CASE WHEN p LIKE '%\\%' ESCAPE '\\' THEN try_cast(replace(p, '%', '') AS DOUBLE) / 100 ELSE try_cast(p AS DOUBLE) END AS pn FROM x)
SELECT p_partkey, (CASE WHEN tn IS NOT NULL AND pn IS NOT NULL AND tn <> 0 THEN abs(pn - tn) <= 0.05 * abs(tn) ELSE lower(t) = lower(p) END)::INT AS hit FROM n
""")
def _(s, d):
    part = table(s, d, "part")
    mark = F.when(F.col("p_partkey") % 3 == 0, "%").otherwise("")
    size = F.col("p_size")
    t = F.concat(size.cast("string"), mark)
    p = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("about "), size.cast("string"))).otherwise(F.concat((size + F.col("p_partkey") % 4).cast("string"), mark))
    return part.select("p_partkey", X.relaxed_match(t, p).cast("int").alias("hit"))


@query("X5_soft_accuracy", """
WITH a AS (SELECT o_custkey, list(o_orderpriority) AS answers, min(o_orderpriority) AS p FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(list_sum(list_transform(answers, lambda a: least(1.0, len(list_filter(answers, lambda b: b <> a AND b = p)) / 3.0))) / len(answers), 6) AS score FROM a
""")
def _(s, d):
    a = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("answers"), F.min("o_orderpriority").alias("p"))
    return a.select("o_custkey", F.round(X.soft_accuracy(F.col("p"), F.col("answers")), 6).alias("score"))


@query("X6_set_f1", """
WITH x AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS p, list_distinct(regexp_extract_all(lower(p_type), '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS r FROM part)
SELECT p_partkey, round(2.0 * len(list_intersect(p, r)) / (len(p) + len(r)), 6) AS f1 FROM x
""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.round(X.set_f1(F.col("p_name"), F.col("p_type")), 6).alias("f1"))


@query("X7_qa_f1")
def _(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.round(X.qa_f1(F.col("text"), F.expr("substr(text, 40)")), 6).alias("f1"))


_BOXES = "l_quantity AS x1, l_linenumber * 3.0 AS y1, l_quantity + 10 + l_linenumber AS x2, l_linenumber * 3.0 + 12 AS y2, l_quantity + l_partkey % 7 AS u1, l_linenumber * 3.0 + l_suppkey % 5 AS v1, l_quantity + 14 AS u2, l_linenumber * 3.0 + 15 AS v2"


@query("X9_boxes", f"""
WITH b AS (SELECT l_orderkey, l_linenumber, {_BOXES} FROM lineitem),
i AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) AS both_ FROM b),
r AS (SELECT *, coalesce(both_ / nullif((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - both_, 0), 0) AS iou FROM i)
SELECT l_orderkey, l_linenumber, round(iou, 6) AS iou, (iou >= 0.5)::INT AS hit, ((x1 + x2) / 2 BETWEEN u1 AND u2 AND (y1 + y2) / 2 BETWEEN v1 AND v2)::INT AS centre FROM r
""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(x) for x in _BOXES.split(", ")))
    a, b = F.array("x1", "y1", "x2", "y2"), F.array("u1", "v1", "u2", "v2")
    li = li.withColumn("a", a.cast("array<double>")).withColumn("b", b.cast("array<double>"))
    i = X.iou(F.col("a"), F.col("b"))
    return li.select("l_orderkey", "l_linenumber", F.round(i, 6).alias("iou"), (i >= 0.5).cast("int").alias("hit"), X.centre_inside(F.col("a"), F.col("b")).cast("int").alias("centre"))


_N = r"\s*(-?\d+(?:\.\d+)?)\s*"
_BOX = r"\[" + ",".join([_N] * 4) + r"\]"
_BOX_SQL = ", ".join(f"coalesce(try_cast(regexp_extract(t, '{_BOX}', {k}) AS DOUBLE), 0) AS {n}" for k, n in enumerate(("x1", "y1", "x2", "y2"), 1))


@query("X10_parse_box", f"WITH t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE 'box [' || p_size || ', ' || p_size * 2 || '.5,' || p_partkey || ' , 7] end' END AS t FROM part) SELECT p_partkey, {_BOX_SQL} FROM t")
def _(s, d):
    part = table(s, d, "part")
    text = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("box ["), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") * 2).cast("string"), F.lit(".5,"), F.col("p_partkey").cast("string"), F.lit(" , 7] end")))
    box = part.select("p_partkey", X.parse_box(text).alias("b"))
    return box.select("p_partkey", *(F.col("b")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


_LETTER = "'The best answer is ' || chr((65 + p_size % 5)::INT) || '. ' || p_name"


@query("X13_choice_letter", f"WITH t AS (SELECT p_partkey, replace({_LETTER}, 'The best answer is', '') AS t FROM part) SELECT p_partkey, CASE WHEN len(string_split(trim(t), ' ')) > 10 AND NOT regexp_matches(t, '[ABCD]') THEN '' ELSE regexp_extract(t, '[ABCD]') END AS letter FROM t")
def _(s, d):
    text = F.concat(F.lit("The best answer is "), F.char((65 + F.col("p_size") % 5).cast("int")), F.lit(". "), F.col("p_name"))
    return table(s, d, "part").select("p_partkey", X.choice_letter(text).alias("letter"))


_ANSWER = "CASE WHEN event_id % 4 = 0 THEN 'Yes' WHEN event_id % 4 = 1 THEN 'no, it is a ' || event_type WHEN event_id % 4 = 2 THEN ' yes. ' ELSE event_type || ' yes or no' END"


@query("X14_yes_no", f"""WITH t AS (SELECT event_id, lower(trim({_ANSWER})) AS a FROM events)
SELECT event_id, CASE WHEN a IN ('yes', 'no') THEN a WHEN contains(substr(a, 1, 4), 'yes') THEN 'yes' WHEN contains(substr(a, 1, 4), 'no') THEN 'no' ELSE 'other' END AS answer FROM t""")
def _(s, d):
    return table(s, d, "events").select("event_id", X.yes_no(F.expr(_ANSWER)).alias("answer"))


@query("X15_first_of", f"""WITH t AS (SELECT event_id, lower({_ANSWER}) AS a FROM events),
p AS (SELECT event_id, CASE WHEN regexp_matches(a, '\\byes\\b') THEN length(regexp_extract(a, '^(.*?)\\byes\\b', 1)) + 1 ELSE 0 END AS y, CASE WHEN regexp_matches(a, '\\bno\\b') THEN length(regexp_extract(a, '^(.*?)\\bno\\b', 1)) + 1 ELSE 0 END AS n FROM t)
SELECT event_id, (CASE WHEN y = 0 AND n = 0 THEN -1 WHEN y > 0 AND (n = 0 OR y < n) THEN 1 ELSE 0 END)::INT AS first FROM p""")
def _(s, d):
    return table(s, d, "events").select("event_id", X.first_of(F.expr(_ANSWER), "yes", "no").cast("int").alias("first"))


@query("X16_score", "SELECT event_id, try_cast(nullif(regexp_extract('Score: ' || (event_id % 9)::VARCHAR || ' of ' || event_type, '[0-5]'), '') AS INT) AS score FROM events")
def _(s, d):
    text = F.concat(F.lit("Score: "), (F.col("event_id") % 9).cast("string"), F.lit(" of "), F.col("event_type"))
    return table(s, d, "events").select("event_id", F.regexp_extract(text, "[0-5]", 0).try_cast("int").alias("score"))


@query("X19_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("X20_detokenise", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, ' ([.,!?])', '\\1', 'g'), ' +', ' ', 'g')) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.regexp_replace(F.regexp_replace("text", " ([.,!?])", "$1"), " +", " ")).alias("digest"))


@query("X21_subset_name", "SELECT c_custkey, regexp_extract('test_' || c_mktsegment || '_' || c_custkey, '^[a-z]+_(.+)_[0-9]+$', 1) AS subset FROM customer")
def _(s, d):
    name = F.concat_ws("_", F.lit("test"), "c_mktsegment", F.col("c_custkey").cast("string"))
    found = F.regexp_extract(name, "^[a-z]+_(.+)_[0-9]+$", 1)
    return table(s, d, "customer").select("c_custkey", F.when(found != "", found).otherwise(F.raise_error(F.lit("no subset in id"))).alias("subset"))


@query("X22_srt_seconds", "SELECT event_id, round(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) + 0.25, 3) AS seconds FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.round(X.srt_seconds(F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(",250"))), 3).alias("seconds"))


@query("X23_json_valid", "SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END)::INT AS valid FROM events")
def _(s, d):
    text = F.when(F.col("event_id") % 3 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return table(s, d, "events").select("event_id", X.json_valid(text).cast("int").alias("valid"))


@query("X24_byte_length", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("X26_sanitise", "SELECT page_id, regexp_replace(url, '[\"<>:/|\\\\?*\\[\\]]+', '__', 'g') AS name, regexp_extract(url, '([^/]*)$', 1) AS tail FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_replace("url", r'["<>:/|\\?*\[\]]+', "__").alias("name"), F.regexp_extract("url", "([^/]*)$", 1).alias("tail"))


@query("X27_stringify", "SELECT vec_id, list_transform(embedding, lambda x: (round(x * 1000)::BIGINT)::VARCHAR) AS texts FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("long").cast("string")).alias("texts"))  # in floats, as the SQL


@query("X28_polarity", """WITH t AS (SELECT doc_id, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'and'))::INT AS p, (contains(lower(text), 'que'))::INT + (contains(lower(text), 'der'))::INT + (contains(lower(text), 'les'))::INT AS n FROM documents)
SELECT doc_id, CASE WHEN p > n THEN 'pos' WHEN n > p THEN 'neg' ELSE 'unclear' END AS side FROM t""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.polarity(F.col("text"), ["the", "and", "of"], ["que", "der", "les", "of"]).alias("side"))


@query("X29_verdict", "WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Correct.' WHEN 1 THEN 'Incorrect!' WHEN 2 THEN 'It is Correct' ELSE event_type END AS t FROM events) SELECT event_id, (CASE WHEN t LIKE 'Correct%' THEN 1 WHEN t LIKE 'Incorrect%' THEN 0 WHEN contains(t, 'Correct') AND NOT contains(t, 'Incorrect') THEN 1 WHEN contains(t, 'Incorrect') THEN 0 END)::INT AS verdict FROM t")
def _(s, d):
    t = F.expr("CASE event_id % 4 WHEN 0 THEN 'Correct.' WHEN 1 THEN 'Incorrect!' WHEN 2 THEN 'It is Correct' ELSE event_type END")
    return table(s, d, "events").select("event_id", X.verdict(t).cast("int").alias("verdict"))


_RESPONSES = "SELECT user_id, list(event_type ORDER BY event_id) AS r FROM events GROUP BY user_id"


def responses(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("r"))
    return e.select("user_id", F.col("r.event_type").alias("r"))


@query("F1_take_first", f"SELECT user_id, r[1] AS answer FROM ({_RESPONSES})")
def _(s, d):
    return responses(s, d).select("user_id", R.take_first()(F.col("r")).alias("answer"))


@query("F2_take_first_k", f"SELECT user_id, array_to_string(r[1:3], '|') AS answers FROM ({_RESPONSES})")
def _(s, d):
    return responses(s, d).select("user_id", F.array_join(R.take_first_k(3)(F.col("r")), "|").alias("answers"))


@query("F3_majority_vote", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, arg_max(event_type, {'n': n, 'f': -first}) AS answer FROM c GROUP BY user_id""")
def _(s, d):
    return responses(s, d).select("user_id", R.majority_vote()(F.col("r"))[0].alias("answer"))


@query("F4_regex", f"SELECT user_id, array_to_string(list_transform(r, lambda x: CASE WHEN regexp_extract(x, '([aeiou][a-z])', 1) <> '' THEN regexp_extract(x, '([aeiou][a-z])', 1) ELSE '[invalid]' END), '|') AS answers FROM ({_RESPONSES})")
def _(s, d):
    return responses(s, d).select("user_id", F.array_join(R.regex("([aeiou][a-z])")(F.col("r")), "|").alias("answers"))


@query("F7_F8_chain", f"SELECT user_id, array_to_string(list_transform(r, lambda x: upper(x)), '|') AS answers FROM ({_RESPONSES})")
def _(s, d):
    spaced = responses(s, d).withColumn("r", F.transform("r", lambda x: F.concat(F.lit(" "), x)))
    return spaced.select("user_id", F.array_join(R.pipeline([("remove_whitespace",), ("lowercase",), ("uppercase",)])(F.col("r")), "|").alias("answers"))


@query("F9_map", f"SELECT user_id, array_to_string(list_transform(r, lambda x: CASE x WHEN 'click' THEN '1' WHEN 'view' THEN '2' ELSE '0' END), '|') AS answers FROM ({_RESPONSES})")
def _(s, d):
    return responses(s, d).select("user_id", F.array_join(R.mapping({"click": "1", "view": "2"}, "0")(F.col("r")), "|").alias("answers"))


@query("F11_normalise", "SELECT doc_id, md5(regexp_replace(lower(text), '\\p{P}', '', 'g')) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(R.normalise()(F.array("text"))[0]).alias("digest"))


@query("F5_multi_choice")
def _(s, d):
    part = table(s, d, "part").withColumn("choices", F.array("p_brand", "p_type", "p_name"))
    said = F.array(F.concat(F.lit("I think "), F.element_at("choices", (F.col("p_size") % 3 + 1).cast("int"))), F.lit("(B)"), F.lit("it is C."))
    return part.select("p_partkey", F.array_join(R.multi_choice(F.col("choices"))(said), "|").alias("answers"))


@query("F6_question_choices", "SELECT p_partkey, array_to_string(regexp_extract_all('Pick' || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_type, '\\b[A-Z]\\.\\s+([^\\n]*)', 1), '|') AS choices FROM part")
def _(s, d):
    q = F.concat(F.lit("Pick\nA. "), F.col("p_name"), F.lit("\nB. "), F.col("p_type"))
    return table(s, d, "part").select("p_partkey", F.array_join(R.question_choices(q), "|").alias("choices"))
