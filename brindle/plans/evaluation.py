"""Queries of evaluation and measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import measure as me
from brindle.operators import quality as qu
from brindle.plans.catalog import load, query

# Gold spans are lines of an order; predictions are the lines that keep a part of them.
_GOLD = "gold AS (SELECT l_orderkey AS case_id, l_returnflag AS type, (l_partkey % 200)::BIGINT AS s, (l_partkey % 200 + 3 + l_linenumber)::BIGINT AS e, l_suppkey * 10000000 + l_linenumber * 1000000 + l_partkey AS span_id, l_suppkey FROM lineitem)"
_PRED = """pred AS (SELECT case_id, CASE WHEN l_suppkey % 11 = 0 THEN 'Z' ELSE type END AS type, s + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS s, e, span_id + 7 AS span_id FROM gold WHERE l_suppkey % 7 <> 0)"""


def gold_pred(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    gold = li.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("type"), (F.col("l_partkey") % 200).alias("start"),
        (F.col("l_partkey") % 200 + 3 + F.col("l_linenumber")).alias("end"), (F.col("l_suppkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("span_id"), "l_suppkey",
    )
    k = F.col("l_suppkey")
    pred = gold.where(k % 7 != 0).select(
        "case_id", F.when(k % 11 == 0, "Z").otherwise(F.col("type")).alias("type"), (F.col("start") + F.when(k % 5 == 0, 1).otherwise(0)).alias("start"), "end", (F.col("span_id") + 7).alias("span_id")
    )
    return gold.drop("l_suppkey"), pred


_EXACT = f"""WITH {_GOLD}, {_PRED},
g AS (SELECT case_id, type, s, e, count(*) AS n FROM gold GROUP BY ALL), p AS (SELECT case_id, type, s, e, count(*) AS n FROM pred GROUP BY ALL),
m AS (SELECT coalesce(g.case_id, p.case_id) AS case_id, coalesce(g.type, p.type) AS type, coalesce(g.n, 0) AS gn, coalesce(p.n, 0) AS pn FROM g FULL JOIN p ON g.case_id = p.case_id AND g.type = p.type AND g.s = p.s AND g.e = p.e),
c AS (SELECT type, sum(least(gn, pn)) AS tp, sum(pn) AS n_pred, sum(gn) AS n_gold FROM m GROUP BY type),
u AS (SELECT * FROM c UNION ALL SELECT NULL, sum(tp), sum(n_pred), sum(n_gold) FROM c)"""


@query(_EXACT + " SELECT type, tp::BIGINT AS tp, (n_pred - tp)::BIGINT AS fp, (n_gold - tp)::BIGINT AS fn, coalesce(tp / nullif(n_pred, 0), 0) AS precision, coalesce(tp / nullif(n_gold, 0), 0) AS recall, coalesce(2 * tp / nullif(n_pred + n_gold, 0), 0) AS f1 FROM u")
def e1_e4_exact_scores(spark, sf_dir):
    return qu.score(qu.exact_counts(*gold_pred(spark, sf_dir)))


# Largest matchings by recursion over the starts and ends of a case's spans: at its end a waiting span takes the other side's first.
_RELAXED = f"""WITH RECURSIVE {_GOLD}, {_PRED},
sp AS (SELECT case_id, type, 0 AS side, s, e, span_id FROM gold UNION ALL SELECT case_id, type, 1, s, e, span_id FROM pred),
ev AS (SELECT *, row_number() OVER (PARTITION BY case_id, type ORDER BY t, kind, side, e, span_id) AS k, {{'e': e, 'i': span_id}} AS x
 FROM (SELECT *, s AS t, 1 AS kind FROM sp UNION ALL SELECT *, e AS t, 0 AS kind FROM sp)),
st AS (SELECT DISTINCT case_id, type, 0::BIGINT AS k, []::STRUCT(e BIGINT, i BIGINT)[] AS g, []::STRUCT(e BIGINT, i BIGINT)[] AS p, 0::BIGINT AS tp FROM sp
 UNION ALL SELECT st.case_id, st.type, ev.k,
 CASE WHEN kind = 1 AND side = 0 THEN list_sort(list_append(g, x)) WHEN kind = 0 AND side = 0 THEN list_filter(g, lambda v: v.i <> x.i) WHEN kind = 0 AND list_contains(p, x) THEN g[2:] ELSE g END,
 CASE WHEN kind = 1 AND side = 1 THEN list_sort(list_append(p, x)) WHEN kind = 0 AND side = 1 THEN list_filter(p, lambda v: v.i <> x.i) WHEN kind = 0 AND list_contains(g, x) THEN p[2:] ELSE p END,
 tp + (kind = 0 AND ((side = 0 AND list_contains(g, x) AND len(p) > 0) OR (side = 1 AND list_contains(p, x) AND len(g) > 0)))::BIGINT
 FROM st JOIN ev ON st.case_id = ev.case_id AND st.type = ev.type AND ev.k = st.k + 1),
rc AS (SELECT type, sum(tp) AS tp FROM (SELECT case_id, type, max(tp) AS tp FROM st GROUP BY 1, 2) GROUP BY 1),
rn AS (SELECT type, count(*) FILTER (side = 0) AS n_gold, count(*) FILTER (side = 1) AS n_pred FROM sp GROUP BY 1),
rt AS (SELECT type, tp, n_pred, n_gold FROM rc JOIN rn USING (type)),
ru AS (SELECT * FROM rt UNION ALL SELECT NULL, sum(tp), sum(n_pred), sum(n_gold) FROM rt)"""


@query(_RELAXED + " SELECT type, tp::BIGINT AS tp, (n_pred - tp)::BIGINT AS fp, (n_gold - tp)::BIGINT AS fn, coalesce(tp / nullif(n_pred, 0), 0) AS precision, coalesce(tp / nullif(n_gold, 0), 0) AS recall, coalesce(2 * tp / nullif(n_pred + n_gold, 0), 0) AS f1 FROM ru")
def e2_relaxed_scores(spark, sf_dir):
    """Largest matchings of overlapping spans, scored."""
    return qu.score(qu.relaxed_counts(*gold_pred(spark, sf_dir)))


@query(f"WITH {_GOLD}, {_PRED} SELECT g.type, count(*) AS n FROM gold g JOIN pred p ON g.case_id = p.case_id AND g.type = p.type AND g.s < p.e AND p.s < g.e GROUP BY 1")
def e2_overlap_pairs(spark, sf_dir):
    """Overlapping pairs by bins of 16, so that a huge case would be many groups."""
    return qu.overlap_pairs(*gold_pred(spark, sf_dir), ["case_id", "type"], 16).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {_GOLD}, {_PRED} SELECT type, 'POSITIVE' AS category, count(*) AS n_cases, count(*) FILTER (ok) AS n_equal, bool_and(ok) AND count(*) >= 100 AS passed
FROM (SELECT g.type, p.span_id IS NOT NULL AS ok FROM gold g LEFT JOIN pred p ON p.case_id = g.case_id AND p.span_id = g.span_id + 7 AND p.type = g.type AND p.s = g.s AND p.e = g.e) GROUP BY 1""")
def e5_canonical_gate(spark, sf_dir):
    g, p = gold_pred(spark, sf_dir)
    a = F.array(F.struct("type", "start", "end"))
    exp = g.withColumn("expected", a).select("case_id", "type", "span_id", "expected")
    act = p.withColumn("actual", a).select("case_id", (F.col("span_id") - 7).alias("span_id"), "actual")
    cases = exp.join(act, ["case_id", "span_id"], "left").withColumn("category", F.lit("POSITIVE"))
    return qu.canonical_gate(cases)


@query("SELECT CASE WHEN ('0x' || substr(sha256('salt' || chr(0) || 'r1' || chr(0) || doc_id), 1, 2))::INT < 64 THEN 'evaluation' ELSE 'tuning' END AS part, count(*) AS n FROM documents GROUP BY 1")
def e6_frozen_split(spark, sf_dir):
    return load(spark, sf_dir, "documents", "doc_id").groupBy(qu.frozen_split(F.col("doc_id"), "salt", "r1").alias("part")).agg(F.count("*").alias("n"))


@query(f"""WITH {_GOLD}, {_PRED},
x AS (SELECT g.case_id, g.span_id, g.type, CASE WHEN count(p.span_id) = 0 THEN 'NO_OVERLAPPING_FINDING' WHEN bool_or(p.type = g.type) THEN 'SPAN_MISMATCH' ELSE 'TYPE_MISMATCH' END AS bucket
 FROM gold g LEFT JOIN pred p ON g.case_id = p.case_id AND g.s < p.e AND p.s < g.e
 WHERE NOT EXISTS (SELECT 1 FROM pred q WHERE q.case_id = g.case_id AND q.span_id = g.span_id + 7 AND q.type = g.type AND q.s = g.s AND q.e = g.e) GROUP BY 1, 2, 3)
SELECT 'gold' AS side, bucket, count(*) AS n FROM x GROUP BY 1, 2
UNION ALL SELECT 'pred', 'EXTRA_PREDICTION', count(*) FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE p.case_id = g.case_id AND p.span_id = g.span_id + 7 AND p.type = g.type AND p.s = g.s AND p.e = g.e)""")
def e11_mismatches(spark, sf_dir):
    """Buckets of spans outside the exact matching of each line with its own prediction."""
    g, p = gold_pred(spark, sf_dir)
    q = p.select("case_id", "type", "start", "end", F.col("span_id").alias("p_id"), (F.col("span_id") - 7).alias("span_id"))
    m = g.join(q, ["case_id", "type", "start", "end", "span_id"]).select("case_id", F.col("span_id").alias("g_id"), "p_id")
    return qu.mismatches(g, p, m).groupBy("side", "bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {_GOLD}, {_PRED}, x AS (SELECT p.type, CASE WHEN p.span_id % 2 = 0 THEN 'VALIDATED' ELSE 'CONTEXTUAL' END AS evidence, g.span_id IS NOT NULL AS hit
 FROM pred p LEFT JOIN gold g ON p.case_id = g.case_id AND p.span_id = g.span_id + 7 AND p.type = g.type AND p.s = g.s AND p.e = g.e)
SELECT type, evidence, count(*) AS n, count(*) FILTER (hit) AS n_matched, count(*) FILTER (NOT hit) AS n_false FROM x GROUP BY CUBE (type, evidence)""")
def e12_evidence(spark, sf_dir):
    g, p = gold_pred(spark, sf_dir)
    q = p.withColumn("evidence", F.when(F.col("span_id") % 2 == 0, "VALIDATED").otherwise("CONTEXTUAL"))
    m = g.select("case_id", "type", "start", "end", (F.col("span_id") + 7).alias("p_id")).join(p.withColumnRenamed("span_id", "p_id"), ["case_id", "type", "start", "end", "p_id"]).select("case_id", "p_id")
    return qu.evidence_contributions(q, m)


@query("SELECT l.lang AS label, count(d.doc_id) AS n_spans, (SELECT count(*) FROM documents) AS n_cases FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')) l(lang) LEFT JOIN documents d ON d.lang = l.lang GROUP BY 1")
def e13_coverage(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "lang")
    cases = docs.select("doc_id", F.lit(None).cast("string").alias("reject"), F.lit(1).alias("n_entities"))
    labels = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "xx")], "label string")
    return qu.coverage_report(cases, docs.withColumnRenamed("lang", "label"), labels).select("label", "n_spans", "n_cases")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) - (l_returnflag = 'R')::BIGINT * i AS n, CASE i WHEN 0 THEN 'observed' ELSE 'declared' END AS side FROM lineitem, (VALUES (0), (1)) v(i) WHERE l_returnflag = 'R' GROUP BY 1, 2, i")
def e14_coverage_gate(spark, sf_dir):
    """Counts by flag and status against declared ones, of which those of one flag are short by one."""
    a = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))
    return qu.coverage_gate(a, a.withColumn("n", F.when(F.col("flag") == "R", F.col("n") - 1).otherwise(F.col("n"))))


@query("SELECT count(*) AS n_clean, count(*) FILTER (doc_id % 10 = 0) AS n_flagged, count(*) FILTER (doc_id % 10 = 0) / count(*) AS fpr FROM documents WHERE doc_id % 3 = 0")
def e15_document_fpr(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id").select((F.col("doc_id") % 3).alias("n_entities"), (F.col("doc_id") % 10 == 0).cast("int").alias("n_pred"))
    return qu.document_fpr(d)


_ROWS = "r AS (SELECT l_linestatus AS stage, l_returnflag AS family, l_linenumber AS config, l_orderkey AS input_id, (l_quantity > 25)::INT AS tp, (l_quantity > 10)::INT AS n_pred, 1 AS n_gold FROM lineitem)"


def _rows(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("stage"), F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("config"), F.col("l_orderkey").alias("input_id"),
        (F.col("l_quantity") > 25).cast("int").alias("tp"), (F.col("l_quantity") > 10).cast("int").alias("n_pred"), F.lit(1).alias("n_gold"),
    )


@query(f"""WITH {_ROWS} SELECT stage, family, config, sum(tp)::BIGINT AS tp, count(DISTINCT input_id) AS n_inputs, sum(tp) / nullif(sum(n_pred), 0) AS precision FROM r
GROUP BY GROUPING SETS ((stage), (stage, family), (stage, config), (stage, config, family))""")
def e16_subsets(spark, sf_dir):
    return qu.subsets(_rows(spark, sf_dir)).select("stage", "family", "config", "tp", "n_inputs", "precision")


@query(f"""WITH {_ROWS}, b AS (SELECT o_orderkey AS input_id, (o_totalprice > 100000)::INT AS tp, 1 AS n_gold FROM orders)
SELECT family, count(*) AS n, sum(r.tp) / sum(r.n_gold) AS recall, sum(b.tp) / sum(b.n_gold) AS base_recall, (sum(r.tp) / sum(r.n_gold) - sum(b.tp) / sum(b.n_gold)) * 100 AS delta_points FROM r JOIN b USING (input_id) GROUP BY family""")
def e17_baseline(spark, sf_dir):
    b = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input_id"), (F.col("o_totalprice") > 100000).cast("int").alias("tp"), F.lit(1).alias("n_gold"))
    return qu.compare_to_baseline(_rows(spark, sf_dir), b, ["family"])


@query("SELECT problem, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS input_id, 'MISSING_BASELINE' AS problem FROM lineitem WHERE l_orderkey % 4 = 0 UNION ALL SELECT l_orderkey, 'DUPLICATE_ATTACK' FROM (SELECT l_orderkey, l_returnflag, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) GROUP BY 1")
def e18_baseline_problems(spark, sf_dir):
    t = F.array(F.lit("A"))
    attacked = _rows(spark, sf_dir).withColumn("types", t)
    base = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input_id"), t.alias("types")).where("input_id % 4 <> 0")
    return qu.baseline_problems(attacked, base).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT p_brand, CASE WHEN count(DISTINCT p_size) >= 25 THEN count(*) END AS n, count(DISTINCT p_size) AS n_inputs, count(DISTINCT p_size) < 25 AS suppressed FROM part GROUP BY 1")
def e19_privacy_floor(spark, sf_dir):
    g = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_size").alias("n_inputs"))
    return qu.privacy_floor(g, ["n"], least=25)


@query(f"""WITH {_GOLD}, c AS (SELECT case_id, sha256(case_id || '|' || string_agg(type || ':' || s || ':' || e, '|' ORDER BY type || ':' || s || ':' || e)) AS d FROM gold GROUP BY 1),
p AS (SELECT substr(d, 1, 2) AS k, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM c GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY k)) AS digest, sum(n)::BIGINT AS n FROM p""")
def e20_fingerprint(spark, sf_dir):
    return qu.fingerprint(gold_pred(spark, sf_dir)[0])


@query(_EXACT.replace("WITH ", _RELAXED + ",\n", 1).replace(f"{_GOLD}, {_PRED},\ng AS", "g AS") + """, v AS (SELECT 'exact_precision' AS metric, tp / n_pred AS value, 0.75 AS floor FROM u WHERE type IS NULL UNION ALL SELECT 'exact_recall', tp / n_gold, 0.30 FROM u WHERE type IS NULL
UNION ALL SELECT 'exact_f1', 2 * tp / (n_pred + n_gold), 0.42 FROM u WHERE type IS NULL UNION ALL SELECT 'relaxed_f1', 2 * tp / (n_pred + n_gold), 0.45 FROM ru WHERE type IS NULL
UNION ALL SELECT 'ip_recall', tp / n_gold, 0.90 FROM u WHERE type = 'A' UNION ALL SELECT 'phone_precision', tp / n_pred, 0.90 FROM u WHERE type = 'N')
SELECT metric, value, floor::DOUBLE AS floor, value >= floor AS passed FROM v""")
def e21_gates(spark, sf_dir):
    """All gates; flags A and N stand for the types IP_ADDRESS and PHONE_NUMBER."""
    g, p = gold_pred(spark, sf_dir)
    # A scan of each score's few rows gives all its metrics.
    pick = lambda s, *rows: s.select(F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.when(F.expr(kind), F.col(column)).alias("value"), F.expr(kind).alias("own")) for kind, name, column in rows]))).where("own").drop("own")
    every = "type is null"
    exact = pick(qu.score(qu.exact_counts(g, p)), (every, "exact_precision", "precision"), (every, "exact_recall", "recall"), (every, "exact_f1", "f1"), ("type = 'A'", "ip_recall", "recall"), ("type = 'N'", "phone_precision", "precision"))
    metrics = exact.union(pick(qu.score(qu.relaxed_counts(g, p)), (every, "relaxed_f1", "f1")))
    return qu.gates(metrics)


@query(_EXACT + ", s AS (SELECT type, tp / n_pred AS p FROM u) SELECT a.type, round(a.p - b.p, 9) AS d_precision FROM s a LEFT JOIN (SELECT type, coalesce(tp / nullif(n_gold, 0), 0) AS p FROM u) b ON a.type IS NOT DISTINCT FROM b.type")
def e22_deltas(spark, sf_dir):
    """Change of precision against a table whose precision is this one's recall."""
    s = qu.score(qu.exact_counts(*gold_pred(spark, sf_dir)))
    b = s.select("type", F.col("recall").alias("precision"))
    return qu.deltas(s.select("type", "precision"), b, columns=("precision",)).select("type", F.round("d_precision", 9).alias("d_precision"))


@query("SELECT p_partkey AS key, p_size::VARCHAR AS a, CASE WHEN p_size = 2 THEN '3' END AS b FROM part WHERE p_size IN (2, 5)")
def e23_comparable(spark, sf_dir):
    """Parameters of two runs, one for each part: some differ, some are missing in the second."""
    value = F.col("p_size").cast("string")
    p = load(spark, sf_dir, "part", "p_partkey", "p_size").withColumnRenamed("p_partkey", "key")
    b = p.where("p_size <> 5").select("key", F.when(F.col("p_size") == 2, F.lit("3")).otherwise(value).alias("value"))
    return qu.comparable(p.select("key", value.alias("value")), b)


@query(f"""WITH {_ROWS}, c AS (SELECT stage || family AS corpus, sum(tp) AS tp, sum(n_pred) AS p, sum(n_gold) AS g FROM r GROUP BY 1)
SELECT corpus, tp::BIGINT AS tp, (p - tp)::BIGINT AS fp, (g - tp)::BIGINT AS fn, tp / p AS precision, tp / g AS recall, 2 * tp / (p + g) AS f1, rank() OVER (ORDER BY 2 * tp / (p + g) DESC)::INT AS rank FROM c""")
def e24_corpora(spark, sf_dir):
    """Corpora (status and flag of lines) scored apart and ranked."""
    return qu.rank_corpora(_rows(spark, sf_dir).withColumn("corpus", F.concat("stage", "family")))


# ------------------------------------------------------------------ measurements over events


def _samples(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.when(F.col("event_id") % 2 == 0, "direct").otherwise("proxy").alias("route"), F.col("event_type").alias("profile"), "value", F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id")


_S = "s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'direct' ELSE 'proxy' END AS route, event_type AS profile, value, ts, event_id, user_id FROM events)"


@query(f"WITH {_S} SELECT profile, route, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM s GROUP BY ROLLUP (profile, route)")
def x1_percentiles(spark, sf_dir):
    return me.latency_percentiles(_samples(spark, sf_dir), ["profile", "route"])


@query(f"""WITH {_S}, p AS (SELECT profile, route, count(*) AS n, quantile_disc(value, 0.99) AS p99 FROM s GROUP BY 1, 2),
o AS (SELECT profile, max(p99) FILTER (route = 'direct') AS direct_p99, max(p99) FILTER (route = 'proxy') AS proxy_p99, min(n) AS n FROM p GROUP BY 1)
SELECT profile, direct_p99, proxy_p99, n, proxy_p99 - direct_p99 AS overhead, CASE WHEN n < 500 THEN 'SMOKE ONLY' WHEN proxy_p99 - direct_p99 <= 2 THEN 'PASS' ELSE 'DEVIATION' END AS verdict FROM o""")
def x2_overhead(spark, sf_dir):
    p = me.latency_percentiles(_samples(spark, sf_dir), ["profile", "route"]).where("route is not null")
    return me.overhead(p, "profile", 2.0, 500)


@query("SELECT user_id, 60 AS n_expected, count(*) AS n_observed, count(*) / 60 AS ratio, count(*) / 60 >= 0.99 AS passed, 60 - count(*) AS lost FROM events GROUP BY 1")
def x3_delivery(spark, sf_dir):
    e = load(spark, sf_dir, "events", "user_id")
    return me.delivery(e.distinct().withColumn("n_expected", F.lit(60)), e, "user_id")


@query(f"""WITH {_S}, w AS (SELECT profile, min(ts) AS a, max(ts) AS b FROM s WHERE event_id % 100 = 7 GROUP BY 1)
SELECT s.profile, count(*) AS n FROM s JOIN w ON s.profile = w.profile AND s.ts >= w.a AND s.ts < w.b GROUP BY 1""")
def x4_x5_windows(spark, sf_dir):
    """Events inside the window that every hundredth event of their profile spans."""
    s = _samples(spark, sf_dir)
    win = me.measurement_window(s.where("event_id % 100 = 7").select("profile", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts")), "profile")
    return me.events_in_windows(s, win, "profile").groupBy("profile").agg(F.count("*").alias("n"))


@query(f"""WITH {_S}, b AS (SELECT *, count(*) OVER (PARTITION BY profile) AS n_bad, row_number() OVER (PARTITION BY profile ORDER BY ts, event_id) AS k FROM s WHERE user_id % 10 = 3)
SELECT profile, event_id, n_bad FROM b WHERE k <= 20""")
def x5_forbidden_frames(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumn("frames", F.array(F.lit("app.Main"), F.when(F.col("user_id") % 10 == 3, "java.io.File").otherwise("java.util.List")))
    return me.forbidden_frames(s, "profile", ["java.io.", "java.nio."]).select("profile", "event_id", "n_bad")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS d FROM events)
SELECT user_id, quantile_disc(value, 0.5) FILTER (u <= 10) AS head, quantile_disc(value, 0.5) FILTER (d <= 10) AS tail, quantile_disc(value, 0.5) FILTER (d <= 10) <= quantile_disc(value, 0.5) FILTER (u <= 10) + 20 AS bounded FROM r GROUP BY 1""")
def x6_memory_trend(spark, sf_dir):
    return me.memory_trend(_samples(spark, sf_dir).withColumnRenamed("event_id", "sample_id"), "user_id", allowance=20)


@query("""SELECT event_id AS sample_id, count(*) OVER w = 5 AND max(value) OVER w - min(value) OVER w <= 30 AS reached, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS high_water
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def x7_plateau(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumnRenamed("event_id", "sample_id")
    return me.plateau(s, "user_id", spread=30).select("sample_id", "reached", "high_water")


@query("SELECT user_id, arg_min(value, ts) AS first, arg_max(value, ts) AS last, arg_max(value, ts) <= arg_min(value, ts) + 20 AS within FROM events GROUP BY 1")
def x8_terminal_memory(spark, sf_dir):
    return me.terminal_memory(_samples(spark, sf_dir).withColumnRenamed("event_id", "sample_id"), "user_id", 20)


@query("""WITH c AS (SELECT user_id, event_type, quantile_disc(value, 0.5) FILTER (event_id % 2 = 0) AS a, quantile_disc(value, 0.5) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS n, median(a / b - 1) AS d_p50, median(a / b - 1) <= 0.1 AS passed FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def x9_paired_regression(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    p = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"))
    return me.paired_regression(p(0), p(1), ["user_id", "event_type"], "event_type", ("p50",))


@query("""WITH e AS (SELECT user_id, event_id % 2 AS side, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS env FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.env IS NOT DISTINCT FROM b.env AS same FROM (FROM e WHERE side = 0) a FULL JOIN (FROM e WHERE side = 1) b ON a.user_id = b.user_id""")
def x10_environment(spark, sf_dir):
    """The kinds of events of each user, but for views, on even and on odd ids as two environments."""
    one = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("v", F.lit("1"))
    env = lambda k: one.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.map_from_entries(F.collect_set(F.struct("event_type", "v"))).alias("env"))
    return me.same_environment(env(0), env(1), ("view",), "user_id")


@query("SELECT event_type AS task, user_id AS class, count(*) AS n, count(*) FILTER (value > 100) AS n_failed, round(sum(value), 6) AS seconds FROM events GROUP BY ROLLUP (event_type, user_id)")
def x11_test_totals(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("class"), (F.col("value") > 100).alias("failed"), F.col("value").alias("seconds"))
    return me.test_totals(e).withColumn("seconds", F.round("seconds", 6))


@query("""SELECT quantile_disc(value, 0.5) FILTER (event_id % 2 = 1) / quantile_disc(value, 0.5) FILTER (event_id % 2 = 0) AS ratio, false AS passed, 'TOO_SLOW' AS reasons FROM events""")
def x12_throughput(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("phase"), F.col("value").alias("seconds"), F.lit(False).alias("failed"))
    return me.throughput_verdict(e)


@query("""WITH r AS (SELECT user_id, month(ts) * 100 + day(ts) // 8 AS span, event_id % 2 = 0 AS before, value, event_type = 'error' AND value > 100 AS failed FROM events),
g AS (SELECT user_id, span, count(*) FILTER (failed) AS f, count(*) FILTER (before) AS nb, count(*) FILTER (NOT before) AS na,
 quantile_disc(value, 0.5) FILTER (NOT before) / quantile_disc(value, 0.5) FILTER (before) AS ratio FROM r GROUP BY 1, 2),
x AS (SELECT *, array_to_string(list_filter([CASE WHEN f > 0 THEN 'FAILED_RUN' END, CASE WHEN nb < 3 OR na < 3 THEN 'TOO_FEW_RUNS' END, CASE WHEN ratio > 0.7 THEN 'TOO_SLOW' END], lambda y: y IS NOT NULL), ',') AS reasons FROM g)
SELECT user_id, span, ratio, reasons = '' AS passed, reasons FROM x""")
def x12_throughput_of_users(spark, sf_dir):
    """Runs of a user in eight days, even events before and odd ones after; errors over 100 failed."""
    phase = F.when(F.col("event_id") % 2 == 0, "before").otherwise("after")
    span = F.month("ts") * 100 + F.floor(F.dayofmonth("ts") / 8)
    failed = (F.col("event_type") == "error") & (F.col("value") > 100)
    e = load(spark, sf_dir, "events").select("user_id", span.alias("span"), phase.alias("phase"), F.col("value").alias("seconds"), failed.alias("failed"))
    return me.throughput_verdict(e, by=("user_id", "span"))


@query("""WITH d AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events), o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'DUPLICATE' END AS problem FROM d CROSS JOIN t LEFT JOIN o USING (user_id, event_type) WHERE n IS NULL OR n > 1""")
def x13_matrix(spark, sf_dir):
    e = load(spark, sf_dir, "events", "user_id", "event_type", "value")
    return me.matrix_problems(e.where("value > 100").drop("value"), [e.select("user_id").distinct(), e.select("event_type").distinct()])
