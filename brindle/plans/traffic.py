"""Queries of chat traffic, policies, contexts and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.tables import dealt
from brindle.operators import audit as au
from brindle.operators import chat as ch
from brindle.operators import context as cx
from brindle.operators import policy as po
from brindle.plans.catalog import BOUNDED_CACHE_SQL, CACHE_SQL, cache_log, load, query
from brindle.plans.detection import deltas
from brindle.streaming.cache import cache_report

# ------------------------------------------------------------------ conversations as requests, responses and streams


def requests(spark, sf_dir):
    """A request for each conversation; every third turn is an array of parts with an image."""
    t = load(spark, sf_dir, "conversations")
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text")))
    mixed = F.to_json(F.struct("role", parts.alias("content")))
    one = t.withColumn("m", F.when(F.col("turn") % 3 == 2, mixed).otherwise(plain))
    body = F.concat(F.lit('{"model":"m-1","messages":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]), ","), F.lit("]}"))
    return one.groupBy("conv_id").agg(body.alias("body"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal, CASE WHEN role = 'system' THEN 'INSTRUCTION' ELSE 'MESSAGE_TEXT' END AS kind, role, text FROM conversations WHERE text <> ''")
def n1_request_fragments(spark, sf_dir):
    return ch.fragments_from_requests(ch.scan_requests(requests(spark, sf_dir)), ["conv_id"]).select("conv_id", "ordinal", "kind", "role", "text")


@query("""SELECT conv_id, count(*) FILTER (text <> '')::BIGINT AS n_fragments, count(*) FILTER (turn % 3 = 2)::BIGINT AS n_gaps,
  CASE WHEN count(*) FILTER (turn % 3 = 2) = 0 THEN 'FULLY' WHEN count(*) FILTER (text <> '') > 0 THEN 'PARTIALLY' ELSE 'UNINSPECTABLE' END AS coverage FROM conversations GROUP BY conv_id""")
def n5_gaps_coverage(spark, sf_dir):
    r = ch.scan_requests(requests(spark, sf_dir))
    k = ["conv_id"]
    return ch.coverage(r, ch.fragments_from_requests(r, k), ch.inspection_gaps(r, k), k)


@query("""SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'AMBIGUOUS_CONTENT' WHEN 1 THEN 'MALFORMED_MESSAGE' ELSE 'UNSUPPORTED_SCHEMA' END AS reject FROM (SELECT DISTINCT conv_id FROM conversations)""")
def n6_request_rejects(spark, sf_dir):
    body = F.when(F.col("conv_id") % 3 == 0, F.lit('{"model":"a","model":"b","messages":[]}')).when(F.col("conv_id") % 3 == 1, F.lit('{"model":')).otherwise(F.lit('{"model":"m"}'))
    c = load(spark, sf_dir, "conversations", "conv_id").distinct().withColumn("body", body)
    return ch.scan_requests(c).select("conv_id", "reject")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND text <> ''")
def n7_response_fragments(spark, sf_dir):
    t = load(spark, sf_dir, "conversations").where("role = 'assistant'")
    body = F.concat(F.lit('{"choices":[{"index":0,"message":'), F.to_json(F.struct("role", F.col("text").alias("content"))), F.lit("}]}"))
    return ch.fragments_from_responses(ch.scan_responses(t.withColumn("body", body)), ["conv_id", "turn"]).select("conv_id", "turn", "text")


def transcripts(spark, sf_dir):
    """SSE transcripts of turns: a chunk for each piece of 16 characters, then [DONE]; every fifth conversation has no end."""
    d = deltas(spark, sf_dir)
    chunk = F.concat(F.lit('data: {"choices":[{"index":0,"delta":'), F.to_json(F.struct(F.col("delta").alias("content"))), F.lit("}]}"))
    one = d.withColumn("e", chunk).groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"]), "\n\n").alias("b"))
    end = F.when(F.col("conv_id") % 5 == 0, "\n\n").otherwise("\r\n\r\ndata: [DONE]\n\n")
    return one.select("conv_id", "turn", F.concat("b", end).alias("body"))


@query("SELECT conv_id, turn, text FROM conversations WHERE text <> ''")
def n8_reassemble_sse(spark, sf_dir):
    k = ["conv_id", "turn"]
    events = ch.scan_sse(transcripts(spark, sf_dir), k)
    return ch.reassemble_sse(ch.sse_deltas(events, k), k).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, (len(text) + 15) // 16 + CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 1 END AS n_events, CASE WHEN conv_id % 5 = 0 THEN 'MISSING_TERMINAL' END AS error_code FROM conversations WHERE text <> ''")
def n10_stream_validity(spark, sf_dir):
    k = ["conv_id", "turn"]
    return ch.validate_streams(ch.scan_sse(transcripts(spark, sf_dir), k), k)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ ]+')) AS w, unnest(string_split_regex(text, '[^ ]+')[:-2]) AS gap,
 generate_subscripts(regexp_extract_all(text, '[^ ]+'), 1) AS k FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, k, sum(strlen(gap) + strlen(w)) OVER o AS e, strlen(w) AS n, lead(strlen(gap) + strlen(w)) OVER (PARTITION BY doc_id ORDER BY k) AS more
 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT doc_id, 'W' AS type, (e - n)::BIGINT AS start_utf8, (e + coalesce(more, 0))::BIGINT AS end_utf8 FROM p WHERE k % 4 = 2""")
def n11_bio_spans(spark, sf_dir):
    """Of every four words, the second and third as one entity."""
    d = load(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").withColumn("tokens", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)))
    tag = lambda x, k: F.when(k % 4 == 1, "B-W").when(k % 4 == 2, "I-W").otherwise("O")
    return ch.bio_to_spans(d.withColumn("tags", F.transform("tokens", tag)), ["doc_id"])


@query("SELECT doc_id, strlen(left(text, length(text) // 3))::BIGINT AS start_utf8, strlen(text)::BIGINT AS end_utf8, doc_id % 5 > 0 AS slice_ok FROM documents WHERE text IS NOT NULL")
def n12_utf8_bounds(spark, sf_dir):
    """The last two thirds of each text; every fifth slice is given wrong."""
    d = load(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").withColumn("a", F.floor(F.length("text") / 3).cast("int")).withColumn("b", F.length("text"))
    d = d.withColumn("v", F.concat(F.expr("substring(text, a + 1)"), F.when(F.col("doc_id") % 5 == 0, "?").otherwise("")))
    return ch.utf8_bounds(d, "text", "a", "b", "v").select("doc_id", "start_utf8", "end_utf8", "slice_ok")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'CHAT_JSON' WHEN event_type = 'view' THEN 'CHAT_SSE' ELSE 'BYPASS' END AS route FROM events")
def p10_routes(spark, sf_dir):
    media = F.when(F.col("event_type") == "click", "Application/JSON; charset=utf-8").when(F.col("event_type") == "view", "text/event-stream").otherwise("text/html")
    e = load(spark, sf_dir, "events", "event_id", "event_type").select("event_id", F.lit("post").alias("method"), F.lit("/v1/chat/completions").alias("path"), media.alias("media_type"), F.lit(None).cast("string").alias("content_encoding"))
    return ch.route_bodies(e).select("event_id", "route")


@query("SELECT doc_id, CASE WHEN strlen(text) > 4000 OR n_chars > 4000 THEN 'TOO_LARGE' WHEN n_chars <> strlen(text) THEN 'LENGTH_MISMATCH' END AS size_code FROM documents")
def p11_body_sizes(spark, sf_dir):
    return ch.check_sizes(load(spark, sf_dir, "documents", "doc_id", "text", "n_chars"), "text", "n_chars", 4000).select("doc_id", "size_code")


# ------------------------------------------------------------------ policies over customers

_POLICIES = [
    ("p-all", "1", True, "*", "*", "REQUEST", "ANY", "*", ["fast-pii"], 50, "ALLOW", "ALLOW", "BLOCK", True, []),
    ("p-build", "2", True, "https://api.example.com/", "building", "REQUEST", "GROUP", "nation-3", ["fast-pii"], 50, "BLOCK", "ALLOW", "BLOCK", False, ["p-all"]),
    ("p-user", "1", True, "*", "MACHINERY", "REQUEST", "USER", "*", ["fast-pii", "extra"], 20, "BLOCK", "ALLOW", "BLOCK", False, ["p-build"]),
    ("p-off", "1", False, "*", "*", "REQUEST", "ANY", "*", ["fast-pii"], 50, "BLOCK", "ALLOW", "BLOCK", False, []),
]
_POLICY_SQL = """pol(policy_id, url, model, kind, subject) AS (VALUES
  ('p-all', '*', '*', 'ANY', '*'), ('p-build', 'https://api.example.com/', 'building', 'GROUP', 'nation-3'), ('p-user', '*', 'machinery', 'USER', '*')),
ctx AS (SELECT c_custkey AS context_id, CASE WHEN c_custkey % 2 = 0 THEN 'https://api.example.com/' ELSE 'https://other.example.com/' END AS url,
  lower(c_mktsegment) AS model, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_name) END AS usr, 'nation-' || c_nationkey AS grp FROM customer),
matched AS (SELECT context_id, policy_id FROM ctx JOIN pol ON (pol.url = '*' OR pol.url = ctx.url) AND (pol.model = '*' OR pol.model = ctx.model)
  AND (kind = 'ANY' OR (kind = 'USER' AND usr IS NOT NULL) OR (kind = 'GROUP' AND subject = grp))),
over(policy_id, gone) AS (VALUES ('p-build', 'p-all'), ('p-user', 'p-build')),
marked AS (SELECT m.*, NOT EXISTS (SELECT 1 FROM matched x JOIN over o ON x.policy_id = o.policy_id WHERE x.context_id = m.context_id AND o.gone = m.policy_id) AS applied FROM matched m)"""


def policies(spark):
    return spark.createDataFrame(_POLICIES, po.POLICY)


def contexts(spark, sf_dir):
    c = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("context_id"), F.when(F.col("c_custkey") % 2 == 0, "https://api.example.com/").otherwise("https://other.example.com/").alias("url"),
        F.col("c_mktsegment").alias("model"), F.lit("REQUEST").alias("phase"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("user"),
        F.array(F.concat(F.lit("nation-"), "c_nationkey")).alias("groups"),
    )


@query(f"WITH {_POLICY_SQL} SELECT context_id, policy_id, applied FROM marked")
def j1_j3_policy_selection(spark, sf_dir):
    return po.apply_overrides(po.match_policies(contexts(spark, sf_dir), policies(spark))).select("context_id", "policy_id", "applied")


def _results(spark, sf_dir):
    """A detector result for each order of a customer: the fragment is the order."""
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    status = F.when(F.col("o_orderkey") % 7 == 0, "DETECTED").otherwise("CLEAN")
    one = o.select(F.col("o_orderkey").alias("fragment_id"), F.col("o_custkey").alias("context_id"), status.alias("status"), F.lit(None).cast("string").alias("error_code"), (F.col("o_orderkey") % 60).alias("duration_ms"))
    return one.withColumn("detector_id", F.explode(F.array(F.lit("fast-pii"), F.lit("extra"))))


def _reactions(spark, sf_dir):
    applied = po.apply_overrides(po.match_policies(contexts(spark, sf_dir), policies(spark)))
    return po.react(po.apply_deadlines(po.share_results(applied, _results(spark, sf_dir))))


_REACT_SQL = f"""WITH {_POLICY_SQL},
spec(policy_id, detector_id, deadline, on_detected, mask) AS (VALUES ('p-all', 'fast-pii', 50, 'ALLOW', true), ('p-build', 'fast-pii', 50, 'BLOCK', false),
  ('p-user', 'fast-pii', 20, 'BLOCK', false), ('p-user', 'extra', 20, 'BLOCK', false)),
res AS (SELECT o_orderkey AS fragment_id, context_id, m.policy_id, s.on_detected, s.mask,
  CASE WHEN o_orderkey % 60 > s.deadline THEN 'ERROR' WHEN o_orderkey % 7 = 0 THEN 'DETECTED' ELSE 'CLEAN' END AS status
  FROM orders JOIN marked m ON o_custkey = m.context_id AND m.applied JOIN spec s ON s.policy_id = m.policy_id),
reac AS (SELECT fragment_id, context_id, policy_id,
  CASE WHEN bool_and(status = 'CLEAN') THEN 'CLEAN' WHEN bool_or(status = 'ERROR') THEN 'ERROR' ELSE 'DETECTED' END AS state,
  CASE WHEN bool_and(status = 'CLEAN') THEN 'ALLOW' WHEN bool_or(status = 'ERROR' OR (status = 'DETECTED' AND on_detected = 'BLOCK')) THEN 'BLOCK' ELSE 'ALLOW' END AS disposition,
  bool_or(mask AND status = 'DETECTED') AS masks FROM res GROUP BY 1, 2, 3)"""


@query(_REACT_SQL + " SELECT * FROM reac")
def j6_j8_policy_reactions(spark, sf_dir):
    return _reactions(spark, sf_dir).select("fragment_id", "context_id", "policy_id", "state", "disposition", "masks")


@query(_REACT_SQL + """ SELECT fragment_id, CASE WHEN bool_or(disposition = 'BLOCK') THEN 'BLOCK' ELSE 'ALLOW' END AS disposition,
 NOT bool_or(disposition = 'BLOCK') AND bool_or(masks) AS masks, coalesce(string_agg(policy_id, ',' ORDER BY policy_id) FILTER (disposition = 'BLOCK'), '') AS blocking FROM reac GROUP BY fragment_id""")
def j9_j10_fragment_decisions(spark, sf_dir):
    return po.decide_fragments(_reactions(spark, sf_dir)).select("fragment_id", "disposition", "masks", F.array_join("blocking", ",").alias("blocking"))


@query(_REACT_SQL + """, b AS (SELECT fragment_id, bool_or(disposition = 'BLOCK') AS block FROM reac GROUP BY 1),
k AS (SELECT reac.* FROM reac JOIN b USING (fragment_id) WHERE NOT block OR disposition = 'BLOCK')
SELECT fragment_id, string_agg(DISTINCT k.policy_id, ',' ORDER BY k.policy_id) AS policies,
 string_agg(DISTINCT s.detector_id || ':' || CASE WHEN fragment_id % 60 > s.deadline THEN 'ERROR' WHEN fragment_id % 7 = 0 THEN 'DETECTED' ELSE 'CLEAN' END, ',' ORDER BY s.detector_id || ':' || CASE WHEN fragment_id % 60 > s.deadline THEN 'ERROR' WHEN fragment_id % 7 = 0 THEN 'DETECTED' ELSE 'CLEAN' END) AS detectors
FROM k JOIN spec s USING (policy_id) GROUP BY 1""")
def j10_explanations(spark, sf_dir):
    """Policies and detector results that explain each decision."""
    applied = po.apply_overrides(po.match_policies(contexts(spark, sf_dir), policies(spark)))
    results = po.apply_deadlines(po.share_results(applied, _results(spark, sf_dir)))
    out = po.explain_fragments(results, po.react(results))
    return out.select("fragment_id", F.array_join("policies", ",").alias("policies"), F.array_join("detectors", ",").alias("detectors"))


@query(_REACT_SQL + """, frag AS (SELECT fragment_id, context_id, bool_or(disposition = 'BLOCK') AS block, NOT bool_or(disposition = 'BLOCK') AND bool_or(masks) AS masks, bool_or(state = 'ERROR') AS failed FROM reac GROUP BY 1, 2),
msg AS (SELECT context_id, CASE WHEN bool_or(failed) THEN 'ERROR' WHEN bool_or(block) OR bool_or(masks AND fragment_id % 2 = 0) THEN 'BLOCK' WHEN bool_or(masks) THEN 'MASK' ELSE 'ALLOW' END AS outcome FROM frag GROUP BY 1)
SELECT context_id, outcome, CASE outcome WHEN 'ERROR' THEN 503 WHEN 'BLOCK' THEN 403 ELSE 200 END AS http_status FROM msg""")
def a1_a8_message_outcomes(spark, sf_dir):
    """Outcome of a customer's orders as one message, even orders being structural fields."""
    f = po.decide_fragments(_reactions(spark, sf_dir)).withColumn("field_class", F.when(F.col("fragment_id") % 2 == 0, "STRUCTURAL").otherwise("FREE_TEXT"))
    return po.outcome_contract(po.decide_messages(f, ["context_id"])).select("context_id", "outcome", "http_status")


@query("""WITH k AS (SELECT l_orderkey AS id, l_returnflag AS t, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT id, 'DETECTED' AS audit_outcome, sum(n)::BIGINT AS n_findings, string_agg(t || ':' || n, ',' ORDER BY t || ':' || n) AS by_type FROM k GROUP BY id""")
def a3_a5_audit_counts(spark, sf_dir):
    """Counts by type rendered for each order, its lines being findings."""
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    li = dealt(li, li.count(), "l_orderkey")  # all that follows is by order and stays in its task
    frag = li.groupBy(F.col("l_orderkey").alias("id"), "l_linenumber").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("type"))).alias("findings"))
    frag = frag.withColumn("failed", F.lit(False)).withColumn("policies", F.array(F.lit("p@1")))
    msg = li.select(F.col("l_orderkey").alias("id")).distinct().withColumn("has_gap", F.lit(False))
    return po.audit_messages(frag, msg, ["id"]).select("id", "audit_outcome", "n_findings", "by_type")


@query("SELECT 'p' || s_suppkey AS policy_id, CASE WHEN s_suppkey % 4 = 1 THEN 'NO_DETECTORS' WHEN s_suppkey % 4 = 2 THEN 'SELF_OVERRIDE' WHEN s_suppkey % 4 = 3 THEN 'DEADLINE' END AS violation FROM supplier WHERE s_suppkey % 4 > 0")
def j4_policy_lint(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    pid = F.concat(F.lit("p"), "s_suppkey")
    s = load(spark, sf_dir, "supplier", "s_suppkey")
    none = F.array().cast("array<string>")
    p = s.select(
        pid.alias("policy_id"), F.lit("1").alias("version"), F.lit(True).alias("enabled"), F.lit("*").alias("url"), F.lit("*").alias("model"), F.lit("RESPONSE").alias("phase"),
        F.lit("ANY").alias("subject_kind"), F.lit("*").alias("subject"), F.when(k == 1, none).otherwise(F.array(F.lit("fast-pii"))).alias("detectors"),
        F.when(k == 3, 0).otherwise(50).cast("bigint").alias("deadline_ms"), F.lit("ALLOW").alias("on_detected"), F.lit("ALLOW").alias("on_clean"), F.lit("BLOCK").alias("on_error"),
        F.lit(True).alias("mask"), F.when(k == 2, F.array(pid)).otherwise(none).alias("overrides"),
    )
    return po.lint_policies(p, ["fast-pii"])


@query("SELECT 'p' || lpad(min(s_suppkey // 5 * 5)::VARCHAR, 12, '0') AS policy_id FROM supplier WHERE s_suppkey // 5 % 3 = 1")
def j5_override_cycle(spark, sf_dir):
    """Suppliers override the next of their five; every third five is a ring, the others end."""
    s = load(spark, sf_dir, "supplier", "s_suppkey").select(F.floor(F.col("s_suppkey") / 5).alias("five")).distinct()
    s = s.select("five", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    name = lambda x: F.concat(F.lit("p"), F.lpad(x.cast("string"), 12, "0"))
    onward = F.when((F.col("k") < 4) | (F.col("five") % 3 == 1), F.array(name(F.col("five") * 5 + (F.col("k") + 1) % 5))).otherwise(F.array().cast("array<string>"))
    return po.override_cycles(s.select(name(F.col("five") * 5 + F.col("k")).alias("policy_id"), onward.alias("overrides")))


# ------------------------------------------------------------------ contexts


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^(https?://[^/?#]+)', 1), ':(80|443)$', '') || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS canonical_url FROM pages""")
def c1_canonical_urls(spark, sf_dir):
    return cx.canonical_urls(load(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "canonical_url")


@query("SELECT c_custkey, lower(c_name) AS u, CASE WHEN c_name LIKE '%#%' THEN 'INVALID_USER' END AS identity_code FROM customer")
def c3_identities(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("user"), F.array(F.lit("A"), F.lit("b")).alias("groups"))
    return cx.normalize_identity(c).select("c_custkey", F.col("user").alias("u"), "identity_code")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'MISSING_REQUEST' WHEN event_id % 3 = 1 THEN 'DUPLICATE_REQUEST' END AS handoff_code FROM events")
def c5_response_contexts(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "user_id")
    req = e.where("event_id % 3 > 0").select(F.col("event_id").alias("exchange_id"), F.lit("u").alias("url"), F.lit("m").alias("model"), F.col("user_id").cast("string").alias("user"), F.array(F.lit("g")).alias("groups"))
    req = req.union(req.where("exchange_id % 3 = 1"))
    return cx.response_contexts(e.select(F.col("event_id").alias("exchange_id")), req).select(F.col("exchange_id").alias("event_id"), "handoff_code")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ISSUER' WHEN 2 THEN 'EXPIRED' ELSE 'AUDIENCE' END AS claims_code, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS sub FROM customer")
def c6_token_claims(spark, sf_dir):
    k = F.col("c_custkey") % 4
    claims = F.to_json(F.struct(
        F.when(k == 1, "other").otherwise("iss-1").alias("iss"), F.when(k == 3, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"), F.lit("gate"))).alias("aud"),
        F.when(k == 2, 10).otherwise(2_000).alias("exp"), F.col("c_name").alias("sub")))
    token = F.concat(F.lit("e30."), F.translate(F.regexp_replace(F.base64(F.encode(claims, "UTF-8")), r"[\r\n=]", ""), "+/", "-_"), F.lit(".sig"))
    c = load(spark, sf_dir, "customer", "c_custkey", "c_name").withColumn("token", token)
    return cx.claims_from_tokens(c, "token", "iss-1", "gate", F.lit(1_000)).select("c_custkey", "claims_code", "sub")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'DUPLICATE' WHEN 2 THEN 'BEARER' WHEN 3 THEN 'OTHER_SCHEME' ELSE 'MALFORMED' END AS auth FROM events")
def c9_auth_headers(spark, sf_dir):
    k = F.col("event_id") % 5
    h = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("Bearer a"), F.lit("Bearer b"))).when(k == 2, F.array(F.lit("bearer abc.d"))).when(k == 3, F.array(F.lit("Basic eA=="))).otherwise(F.array(F.lit("Bearer ")))
    return load(spark, sf_dir, "events", "event_id").select("event_id", cx.classify_auth(h).alias("auth"))


@query("SELECT s_suppkey, 'https://h.example.com/base/' || s_name AS url FROM supplier")
def c11_effective_urls(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", cx.effective_url(F.lit("https://h.example.com/base/"), F.concat(F.lit("/"), "s_name")).alias("url"))


@query("SELECT event_id, event_id % 2 = 1 AS session_generated, CASE WHEN event_id % 2 = 0 THEN 's-' || user_id END AS session_id, '/a/' || event_type AS path FROM events")
def c8_correlation(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s-"), "user_id")).otherwise("bad id").alias("session_id"), F.lit("0").alias("trace_id"), F.concat(F.lit("/a/"), "event_type", F.lit("?q=1")).alias("path"))
    out = cx.derive_correlation(e)
    return out.select("event_id", "session_generated", F.when(~F.col("session_generated"), F.col("session_id")).alias("session_id"), "path")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'content-length,' ELSE 'etag,' END || lower(s_name) AS names FROM supplier")
def c10_headers(spark, sf_dir):
    own = F.concat(F.lit("x-drop-"), "s_suppkey")
    h = F.create_map(F.lit("Connection"), own, own, F.lit("1"), F.col("s_name"), F.lit("2"), F.lit("Upgrade"), F.lit("h2c"), F.lit("ETag"), F.lit("e"))
    names = F.array_join(F.array_sort(F.map_keys(cx.clean_headers(h, F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")))), ",")
    return load(spark, sf_dir, "supplier").select("s_suppkey", names.alias("names"))


# ------------------------------------------------------------------ audit and operations over events


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT 's' || (user_id % 40) AS session_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_detected, count(DISTINCT event_id) AS n_exchanges FROM events WHERE user_id % 40 < 20 GROUP BY 1""")
def l1_l2_session_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    trace, session = (F.col("event_id") % 100).cast("string"), F.concat(F.lit("s"), F.col("user_id") % 40)
    audit = e.select(trace.alias("trace_id"), F.col("event_id").alias("parent_span_id"), F.when(F.col("event_type") == "click", "DETECTED").otherwise("CLEAN").alias("outcome"))
    exch = e.select(trace.alias("trace_id"), F.col("event_id").alias("span_id"), session.alias("session_id"), F.col("event_id").alias("exchange_id"))
    return au.session_counts(au.correlate(audit, exch, exch.where("substr(session_id, 2) < 20")))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'MISSING_TERMINAL' WHEN event_id % 10 = 1 THEN 'ORPHAN' WHEN event_id % 10 = 2 THEN 'DUPLICATE' ELSE 'OK' END AS verdict FROM events""")
def l3_pairs(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id")
    done = e.where("event_id % 10 <> 0")
    return au.reconcile_pairs(e.where("event_id % 10 <> 1"), done.union(done.where("event_id % 10 = 2")), ["event_id"])


@query("SELECT doc_id, v.id AS value_id FROM documents, (VALUES (1, 'password='), (2, 'AKIA'), (3, '| ')) v(id, s) WHERE contains(text, s)")
def l4_leaks(spark, sf_dir):
    f = spark.createDataFrame([(1, "password="), (2, "AKIA"), (3, "| ")], "value_id int, value string")
    return au.scan_leaks(load(spark, sf_dir, "documents", "doc_id", "text"), f, "text").select("doc_id", "value_id")


@query("""SELECT d.doc_id, p.p_partkey AS value_id FROM documents d JOIN part p ON contains(d.text, substr(p.p_name, 1, 8))
UNION ALL SELECT d.doc_id, -b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def l4_leaks_of_tables(spark, sf_dir):
    """Documents that hold a passage of the benchmark or the first letters of a part's name; the values come from the tables."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("value_id"), F.substring("p_name", 1, 8).alias("value"))
    items = load(spark, sf_dir, "benchmark").select((-F.col("item_id")).cast("bigint").alias("value_id"), F.col("text").alias("value"))
    return au.scan_leaks(load(spark, sf_dir, "documents", "doc_id", "text"), parts.union(items), "text").select("doc_id", "value_id")


_OUTCOME = "CASE event_type WHEN 'click' THEN 'ALLOW' WHEN 'view' THEN 'MASK' WHEN 'purchase' THEN 'BLOCK' WHEN 'error' THEN 'ERROR' END"


@query(f"""WITH a AS (SELECT strftime(ts, '%Y-%m-%d') AS d, {_OUTCOME} AS o FROM events)
SELECT d, count(*) FILTER (o IN ('ALLOW', 'MASK', 'BLOCK')) AS n_good, count(*) FILTER (o = 'ERROR') AS n_bad, count(*) FILTER (o IS NULL) AS n_gap,
 count(*) FILTER (o IN ('ALLOW', 'MASK', 'BLOCK')) / nullif(count(*) FILTER (o IS NOT NULL), 0) AS availability FROM a GROUP BY d""")
def l6_availability(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("attempt_id"), "ts", F.expr(_OUTCOME).alias("outcome"))
    out = au.availability_sli(e.union(e))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("d"), "n_good", "n_bad", "n_gap", "availability")


@query("""WITH p AS (SELECT *, sum(CASE WHEN event_type <> 'error' AND event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS r FROM p WHERE event_type IN ('error', 'view'))
SELECT user_id, event_id AS probe_id FROM k WHERE r = 3""")
def l7_probe_signals(spark, sf_dir):
    p = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("probe_id"), "ts", F.when(F.col("event_type").isin("error", "view"), 500).otherwise(200).alias("status"))
    return au.probe_signals(p, ["user_id"]).select("user_id", "probe_id")


@query("""SELECT strftime(ts, '%Y-%m-%d %H') AS h, CASE WHEN event_type = 'error' THEN 5 ELSE 2 END AS status_class, count(*) AS n, round(sum(value), 6) AS total_ms,
 count(*) FILTER (value > 75 AND value <= 100) AS n_100 FROM events GROUP BY 1, 2""")
def l8_exchange_metrics(spark, sf_dir):
    e = _events(spark, sf_dir).select("ts", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), F.lit(None).cast("string").alias("failure"), F.col("value").alias("duration_ms"))
    out = au.exchange_metrics(e)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("h"), "status_class", "n", F.round("total_ms", 6).alias("total_ms"), F.col("histogram")[5].alias("n_100"))


@query(CACHE_SQL)
def l11_identity_cache(spark, sf_dir):
    """Hits and misses of a cache of five hours for each user, failures not cached."""
    log = _events(spark, sf_dir).select(F.col("user_id").alias("subject"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return au.identity_cache_report(log, "5 hours").groupBy("subject", "cache").agg(F.count("*").alias("n"))


@query(BOUNDED_CACHE_SQL)
def l11_bounded_cache(spark, sf_dir):
    """Requests, joined lookups and removals of caches of four entries and five hours; st4_bounded_cache is the streaming form."""
    out = cache_report(cache_log(_events(spark, sf_dir)), "5 hours", 4)
    return out.groupBy("owner", "cache").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT event_type, ts AS t, 1 AS d FROM events UNION ALL SELECT event_type, ts + INTERVAL 2 HOUR, -1 FROM events),
g AS (SELECT event_type, t, sum(d) AS d FROM c GROUP BY 1, 2), r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS active FROM g)
SELECT event_type, max(active)::BIGINT AS peak FROM r GROUP BY 1""")
def l12_concurrency(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_ts"), F.lit(1).cast("bigint").alias("bytes"))
    return au.concurrency_profile(e, ["event_type"]).groupBy("event_type").agg(F.max("active").alias("peak"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING' WHEN o_orderkey % 5 = 1 THEN 'DIFFERENT' ELSE 'SAME' END AS verdict, CASE WHEN o_orderkey % 5 = 1 THEN 'status' END AS mismatches FROM orders""")
def l13_outcome_matrix(spark, sf_dir):
    e = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("code"))
    o = e.where("id % 5 <> 0").withColumn("status", F.when(F.col("id") % 5 == 1, "?").otherwise(F.col("status")))
    return au.compare_matrix(e, o, "id", ["status", "code"])


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'NOT_STARTED' ELSE 'CLEAN' END AS outcome, event_id % 4 = 1 AS is_unknown FROM events")
def l5_typed_outcomes(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id")
    seen = e.where("event_id % 4 <> 0").select("event_id", F.lit("CLEAN").alias("outcome"), F.lit("FULLY").alias("coverage"), F.when(F.col("event_id") % 4 == 1, "WHAT").alias("error_code"))
    return au.typed_outcomes(e, seen, "event_id", ["KNOWN"]).select("event_id", "outcome", F.coalesce("unknown", F.lit(False)).alias("is_unknown"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'TIMEOUT' WHEN 'view' THEN 'CANCELLATION' WHEN 'click' THEN 'TRANSPORT' END AS failure FROM events")
def l9_failures(spark, sf_dir):
    cause = F.when(F.col("event_type") == "error", "ReadTimeoutException").when(F.col("event_type") == "view", "ClosedSessionException").when(F.col("event_type") == "click", "IOException")
    return load(spark, sf_dir, "events").select("event_id", au.classify_failure(cause).alias("failure"))


@query(_REACT_SQL + " SELECT s.detector_id, 'POLICY_DEADLINE_EXCEEDED' AS error_code, string_agg(DISTINCT m.policy_id, ',' ORDER BY m.policy_id) AS policies, count(*) AS n FROM orders JOIN marked m ON o_custkey = m.context_id AND m.applied JOIN spec s ON s.policy_id = m.policy_id WHERE o_orderkey % 60 > s.deadline GROUP BY 1, 2")
def l10_failure_events(spark, sf_dir):
    applied = po.apply_overrides(po.match_policies(contexts(spark, sf_dir), policies(spark)))
    return po.failure_events(po.apply_deadlines(po.share_results(applied, _results(spark, sf_dir))))
