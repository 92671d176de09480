"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.checksums import IBAN_LENGTHS
from brindle.functions.tables import shared_path
from brindle.operators import chat as ch
from brindle.plans.catalog import BOUNDED_CACHE_SQL, CACHE_SQL, cache_log, load, query
from brindle.plans.detection import deltas
from brindle.sources import corpora as co
from brindle.sources import report as rp
from brindle.streaming.cache import cache_stream
from brindle.streaming import streams as st


@query("SELECT o_orderkey::VARCHAR AS case_id, CASE WHEN o_orderkey % 10 = 0 THEN 'INVALID_BASE64' WHEN o_orderkey % 10 = 1 THEN 'UNKNOWN_TYPE' WHEN o_orderkey % 10 = 2 THEN 'COLUMN_COUNT' WHEN o_orderkey % 10 = 3 THEN 'INVALID_SPAN' END AS reason FROM orders")
def s1_canonical_corpus(spark, sf_dir):
    """A corpus of planted card texts written as TSV, some rows broken, and read again."""
    ids = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"))
    p = co.generate_planted(ids, "PAYMENT_CARD")
    k = F.col("n") % 10
    data = F.when(k == 0, F.lit("%%%")).otherwise(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", ""))
    end = F.when(k == 3, 9999).otherwise(F.col("end_utf8"))
    finding = F.concat_ws(":", "type", "start_utf8", end, F.lit("VALIDATED"), F.lit("fast.payment_card.luhn"), F.lit("1.0.0"))
    line = F.concat_ws("\t", F.col("n").cast("string"), F.when(k == 1, "WHAT").otherwise("*"), data, finding)
    path = shared_path(spark, "corpus")
    p.select(F.when(k == 2, F.concat(line, F.lit("\tmore"))).otherwise(line).alias("value")).write.text(path)
    return co.read_canonical_corpus(spark, path).select("case_id", "reason")


#: A CSV file with line breaks in its fields cannot be split: a task reads it whole, so files hold so many records.
BIO_RECORDS = 2_000


@query("SELECT doc_id::VARCHAR AS case_id, CASE WHEN doc_id % 4 = 0 THEN 'LENGTH_MISMATCH' WHEN doc_id % 4 = 1 THEN 'INVALID_TRANSITION' END AS reason FROM documents")
def s2_bio_corpus(spark, sf_dir):
    """Words of documents as tokens; every fourth has a tag too many, the next one starts inside an entity."""
    d = load(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    k = F.col("doc_id") % 4
    tokens = F.split("text", " ")
    tags = F.transform(tokens, lambda t, i: F.when(k == 1, "I-X").when(i == 0, "B-X").otherwise("I-X"))
    tags = F.when(k == 0, F.array_append(tags, F.lit("O"))).otherwise(tags)
    path = shared_path(spark, "bio")
    d.select(F.col("doc_id").alias("case_id"), "text", F.to_json(tokens).alias("tokens"), F.to_json(tags).alias("tags")).write.option("maxRecordsPerFile", BIO_RECORDS).option("header", True).option("escape", '"').csv(path)
    return co.read_bio_corpus(spark, path).select("case_id", "reason")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN text IS NULL THEN 'MISSING_FIELD' WHEN doc_id % 3 = 1 OR text = '' THEN 'SPAN_RANGE' WHEN doc_id % 3 = 0 THEN 'SLICE_MISMATCH' END AS reason FROM documents")
def s3_span_corpus(spark, sf_dir):
    k = F.col("doc_id") % 3
    d = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    e = F.struct(F.lit(0).alias("start"), F.when(k == 1, F.length("text") + 1).otherwise(F.length("text")).alias("end"), F.when(k == 0, "??").otherwise(F.col("text")).alias("text"), F.lit("X").alias("type"))
    path = shared_path(spark, "spans")
    d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("domain"), "text", F.array(e).alias("entities")).write.parquet(path)
    return co.read_span_corpus(spark, path).select("id", "reason")


@query("SELECT doc_id::VARCHAR AS uid, sha256(text) AS v FROM documents WHERE text <> ''")
def s4_attack_corpus(spark, sf_dir):
    """Whole texts as one span each."""
    d = load(spark, sf_dir, "documents", "doc_id", "text").where("text <> ''")
    e = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("text"), F.lit("X").alias("type"))
    target = F.struct(F.lit(True).alias("pii"), F.lit(False).alias("context"))
    path = shared_path(spark, "attacks")
    uid = F.col("doc_id").cast("string")
    d.select(uid.alias("uid"), uid.alias("input_id"), F.lit("c").alias("category"), target.alias("attack_target"), F.col("text").alias("llm_input"), F.array(e).alias("pii_spans")).write.parquet(path)
    return co.read_attack_corpus(spark, path).select("uid", F.sha2(F.col("pii_spans")[0]["text"], 256).alias("v"))


@query("SELECT DISTINCT CASE WHEN lang = 'en' THEN 'SHA256' ELSE 'OK' END AS verdict FROM documents UNION SELECT 'MISSING'")
def s5_verified_files(spark, sf_dir):
    """Files written from documents against pins of their own lines; the pin of the English one is wrong, one file is gone."""
    d = load(spark, sf_dir, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n"))
    path = shared_path(spark, "pins")
    d.repartitionByRange(64, "lang").sortWithinPartitions("lang").select(F.concat_ws(":", "lang", "n").alias("value")).write.text(path)
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.array_sort(F.collect_list("value")).alias("v"))
    body = F.concat(F.array_join("v", "\n"), F.lit("\n"))
    wrong = F.when(F.exists("v", lambda x: x.startswith("en:")), F.lit("")).otherwise(body)
    pins = lines.select("name", F.octet_length(body).cast("bigint").alias("size"), F.sha2(wrong, 256).alias("sha256"))
    gone = spark.range(1).select(F.lit("gone").alias("name"), F.lit(1).cast("bigint").alias("size"), F.lit("").alias("sha256"))
    return co.verify_files(spark, f"{path}/*.txt", pins.union(gone)).select("verdict").distinct()


@query("SELECT event_type AS event, count(*) AS n, sum(user_id)::BIGINT AS users FROM events WHERE event_id % 9 <> 0 GROUP BY 1")
def s6_event_log(spark, sf_dir):
    """Events as JSON log lines among other lines; of repeated keys the first counts."""
    e = load(spark, sf_dir, "events")
    pair = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    body = F.to_json(F.struct(F.lit("m").alias("message"), F.array(pair("event", F.col("event_type")), pair("user", F.col("user_id")), pair("user", F.lit(-1))).alias("kvpList")))
    path = shared_path(spark, "log")
    e.select(F.when(F.col("event_id") % 9 == 0, "plain line").otherwise(body).alias("value")).write.text(path)
    log = co.read_event_log(spark, path)
    return log.groupBy("event").agg(F.count("*").alias("n"), F.sum(F.col("fields")["user"].cast("bigint")).alias("users"))


@query("SELECT conv_id, turn, (len(text) + 15) // 16 + 1 AS n FROM conversations WHERE text <> ''")
def s9_sse_events(spark, sf_dir):
    d = deltas(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: F.concat(F.lit(": note\nevent: chunk\ndata: "), F.to_json(F.struct(x["delta"].alias("d"))))), "\n\n").alias("b"))
    k = ["conv_id", "turn"]
    return ch.scan_sse(d.withColumn("body", F.concat("b", F.lit("\n\ndata: [DONE]\n\n"))), k).groupBy(*k).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS policy_id, 50::BIGINT AS deadline_ms, CASE WHEN s_suppkey % 2 = 0 THEN 'bogus' ELSE '' END AS unknown FROM supplier")
def s10_policies(spark, sf_dir):
    s = load(spark, sf_dir, "supplier", "s_suppkey")
    p = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.lit("*").alias("url"), F.when(F.col("s_suppkey") % 2 == 0, 1).alias("bogus")))
    path = shared_path(spark, "policies")
    s.groupBy(F.floor(F.col("s_suppkey") / 1000).alias("k")).agg(F.concat(F.lit('{"policies":['), F.array_join(F.collect_list(p), ","), F.lit("]}")).alias("value")).write.partitionBy("k").text(path)
    return co.read_policies(spark, path).select("policy_id", "deadline_ms", F.array_join("unknown_fields", ",").alias("unknown"))


@query("SELECT p_name AS name, p_size::DOUBLE AS p99 FROM part")
def s14_measurements(spark, sf_dir):
    """Measurements of parts in files of a thousand."""
    n = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.floor(F.col("p_partkey") / 1000).alias("k"))
    body = F.to_json(F.struct(F.col("name").alias("benchmark"), F.lit("avgt").alias("mode"), F.struct(F.lit(1.0).alias("score"), F.create_map(F.lit("99.0"), F.col("size").cast("double")).alias("scorePercentiles")).alias("primaryMetric")))
    path = shared_path(spark, "bench")
    n.groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list(body), ","), F.lit("]")).alias("value")).write.partitionBy("k").text(path)
    return co.read_measurements(spark, path).select(F.col("benchmark").alias("name"), "p99")


@query("SELECT p_name AS name, p_size::DOUBLE AS seconds, p_size > 40 AS failed FROM part")
def s15_testcases(spark, sf_dir):
    p = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    case = F.format_string('<testcase classname="%s%d" name="%s" time="%d">%s</testcase>', "p_brand", "p_partkey", "p_name", "p_size", F.when(F.col("p_size") > 40, "<failure>x</failure>").otherwise(""))
    path = shared_path(spark, "junit")
    suites = p.groupBy(F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list(case), ""), F.lit("</testsuite>")).alias("value"))
    suites.write.partitionBy("k").text(path)
    return co.read_testcases(spark, path).select("name", "seconds", "failed")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s12_reports(spark, sf_dir):
    path = shared_path(spark, "report")
    r = load(spark, sf_dir, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n")).withColumn("view", F.lit("source"))
    co.write_report(r, path, ["view"])
    return spark.read.parquet(path).select("lang", "n")


@query("""SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, max(doc_id)::BIGINT AS last FROM documents GROUP BY 1, 2
UNION ALL SELECT 'all', NULL, count(*), sum(n_chars)::BIGINT, max(doc_id)::BIGINT FROM documents""")
def s12_published_report(spark, sf_dir):
    """A report published by its manifest: rows by language and source, continued by a second run with the total."""
    path = shared_path(spark, "published")
    d = load(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    sums = [F.count("*").alias("n"), F.sum("n_chars").cast("bigint").alias("n_chars"), F.max("doc_id").cast("bigint").alias("last")]
    rp.publish_report(d.groupBy("lang", "source").agg(*sums), path)
    total = d.agg(*sums).select(F.lit("all").alias("lang"), F.lit(None).cast("string").alias("source"), "n", "n_chars", "last")
    rp.publish_report(total, path, append=True)
    return rp.read_report(spark, path)


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def s13_audit_sink(spark, sf_dir):
    path = shared_path(spark, "audit")
    co.write_audit(load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event")), path)
    return spark.read.schema("event_id long, event string").json(path).groupBy("event").agg(F.count("*").alias("n"))


_REGISTRY = ", ".join(f"('{c}', {n})" for c, n in IBAN_LENGTHS.items())


@query(f"""WITH r(country, length) AS (VALUES {_REGISTRY}), p AS (SELECT country, length, row_number() OVER (ORDER BY country) - 1 AS k, count(*) OVER () AS n FROM r)
SELECT country, length::INT AS length, count(s_suppkey) AS n_accounts, coalesce(sum(s_suppkey % 40 + 4 = length), 0)::BIGINT AS n_fitting
FROM p LEFT JOIN supplier ON s_suppkey % n = k GROUP BY 1, 2""")
def s11_iban_registry(spark, sf_dir):
    """All countries, with suppliers dealt to them and how many of their accounts have the country's length."""
    n = len(IBAN_LENGTHS)
    r = co.iban_registry(spark).select("country", "length", (F.row_number().over(W.orderBy("country")) - 1).alias("k"))
    s = load(spark, sf_dir, "supplier", "s_suppkey").select((F.col("s_suppkey") % n).alias("k"), (F.col("s_suppkey") % 40 + 4).alias("size"), "s_suppkey")
    out = r.join(s, "k", "left").groupBy("country", "length")
    return out.agg(F.count("s_suppkey").alias("n_accounts"), F.count_if(F.col("size") == F.col("length")).alias("n_fitting"))


# ------------------------------------------------------------------ streams


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _event_stream(spark, sf_dir, closing=None):
    """Events written in four steps by time, and read as a stream of four batches and more."""
    path = shared_path(spark, "events")
    st.write_in_order(_events(spark, sf_dir), path, closing=closing, marks={"event_id": -1})
    return st.stream_table(spark, path, 2)


@query("SELECT conv_id || ':' || turn AS stream_id, 'COMPLETE' AS status, text FROM conversations WHERE text <> ''")
def st1_live_reassembly(spark, sf_dir):
    d = deltas(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("stream_id"), "seq", "delta", F.lit(False).alias("done"))
    ends = d.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).select("stream_id", "seq", F.lit("").alias("delta"), F.lit(True).alias("done"))
    all_ = d.union(ends).withColumn("failed", F.lit(False)).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    path = shared_path(spark, "deltas")
    st.write_in_order(all_, path)
    return st.run_available(st.reassemble_live(st.stream_table(spark, path, 2), "100 days")).select("stream_id", "status", "text")


@query("SELECT event_id AS span_id, event_id % 4 <> 0 AS ended FROM events")
def st2_pair_stream(spark, sf_dir):
    """Starts with their ends one minute later; those without an end come out once the watermark has passed them."""
    e = _event_stream(spark, sf_dir, "2 DAYS")
    s = e.select(F.col("event_id").alias("span_id"), "ts")
    c = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("span_id"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"))
    return st.run_available(st.pair_stream(s, c)).where("span_id >= 0").select("span_id", F.col("completed_ts").isNotNull().alias("ended"))


@query("SELECT event_id AS span_id, 'ERROR' AS status, 'POLICY_DEADLINE_EXCEEDED' AS error_code FROM events WHERE event_id % 4 < 2")
def st3_deadlines(spark, sf_dir):
    """Starts whose end did not come within an hour: of every fourth there is none, that of the next comes after two hours."""
    e = _event_stream(spark, sf_dir, "2 DAYS")
    s = e.select(F.col("event_id").alias("span_id"), "ts")
    after = F.when(F.col("event_id") % 4 == 1, F.col("ts") + F.expr("INTERVAL 2 HOURS")).otherwise(F.col("ts"))
    c = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("span_id"), after.alias("ts"))
    # an end comes up to two hours after the newest start; starts of the next batch must not count as late for that
    return st.run_available(st.deadlines(s, c, "1 hour", "3 hours"), store=st.ROCKSDB)


@query(CACHE_SQL)
def st4_cached_identities(spark, sf_dir):
    """Streaming form of the identity cache; l11_identity_cache is the batch form, with the same SQL."""
    e = _event_stream(spark, sf_dir).select(F.col("user_id").alias("subject"), "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return st.run_available(st.cached_identities(e, 18_000)).groupBy("subject", "cache").agg(F.count("*").alias("n"))


@query(BOUNDED_CACHE_SQL)
def st4_bounded_cache(spark, sf_dir):
    """Streaming form of the cache with lookups that take time and a largest size; l11_bounded_cache is the batch form."""
    log = cache_log(_event_stream(spark, sf_dir, "2 DAYS"))
    out = st.run_available(cache_stream(log, 18_000, 4), store=st.ROCKSDB)
    return out.groupBy("owner", "cache").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT *, sum(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS r FROM p WHERE event_type IN ('error', 'view'))
SELECT user_id AS probe, event_id AS probe_id FROM k WHERE r = 3""")
def st5_probe_signals(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select(F.col("user_id").alias("probe"), F.col("event_id").alias("probe_id"), "ts", F.when(F.col("event_type").isin("error", "view"), 500).otherwise(200).alias("status"))
    return st.run_available(st.probe_signal_stream(e))


@query("SELECT strftime(ts, '%Y-%m-%d') AS d, CASE WHEN event_type = 'error' THEN 5 ELSE 2 END AS status_class, count(*) AS n FROM events GROUP BY 1, 2")
def st6_metrics(spark, sf_dir):
    """Daily counts by status class; the last state of each window is taken."""
    e = _event_stream(spark, sf_dir).select("ts", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), F.col("value").alias("duration_ms"))
    out = st.run_batches(st.metrics_stream(e, "1 day", "365 days"))
    last = out.groupBy("window_start", "status_class").agg(F.max_by("n", "batch_id").alias("n"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("d"), "status_class", "n")


#: Texts that a file of the masking stream holds.
MASK_TEXTS = 50_000


def mask_files(spark, n: int) -> tuple[int, int]:
    """(files, files of a batch) for n texts: four files at least, two batches at least, and work for all cores in each."""
    files = max(4, -(-n // MASK_TEXTS))
    return files, max(2, min(-(-files // 2), 4 * spark.sparkContext.defaultParallelism))


@query("SELECT o_orderkey AS n, 'card [CARD_MASKED] used' AS masked, CASE WHEN o_orderkey % 2 = 0 THEN 'BLOCK' ELSE 'MASK' END AS decision FROM orders")
def st7_mask_stream(spark, sf_dir):
    ids = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"))
    p = co.generate_planted(ids, "PAYMENT_CARD").withColumn("source", (F.col("n") % 2).cast("string"))
    path = shared_path(spark, "texts")
    files, at_once = mask_files(spark, ids.count())
    p.repartition(files).write.parquet(path)
    pol = spark.createDataFrame([("0", "BLOCK"), ("1", "ALLOW")], "source string, on_detected string")
    return st.run_available(st.mask_stream(st.stream_table(spark, path, at_once), ["PAYMENT_CARD"], pol)).select("n", "masked", "decision")


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events")
def st8_ingest_once(spark, sf_dir):
    """Events of which every third comes again, most in a later batch."""
    e = _events(spark, sf_dir)
    path = shared_path(spark, "twice")
    for part in (e, e.where("event_id % 3 = 0")):
        part.repartition(2).write.mode("append").parquet(path)
    out = st.run_available(st.ingest_once(st.stream_table(spark, path, 1), ["event_id"], "400 days"))
    return out.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS d, count(*) AS n_expected, count(*) FILTER (event_id % 10 <> 0) AS n, count(*) FILTER (event_id % 10 = 0) AS lost FROM events GROUP BY 1")
def st9_loss(spark, sf_dir):
    s = _event_stream(spark, sf_dir).where("event_id % 10 <> 0")
    out = st.run_batches(st.delivered_stream(s, "1 day", "365 days")).groupBy("window_start").agg(F.max_by("n", "batch_id").alias("n"))
    e = _events(spark, sf_dir).groupBy(F.window("ts", "1 day").getField("start").alias("window_start")).agg(F.count("*").alias("n_expected"))
    return st.lost_events(e, out).select(F.date_format("window_start", "yyyy-MM-dd").alias("d"), "n_expected", "n", "lost")
