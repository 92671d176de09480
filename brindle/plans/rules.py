"""Queries of single rules: context words, URL hosts, windows, schemas, contexts, product gold, response outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.tables import dealt
from brindle.operators import chat as ch
from brindle.operators import context as cx
from brindle.operators import detect as d
from brindle.operators import masking as ma
from brindle.operators import policy as po
from brindle.operators import quality as qu
from brindle.plans.catalog import load, query
from brindle.plans.traffic import _REACT_SQL, _reactions
from brindle.sources import corpora as co


def _n(spark, sf_dir):
    return load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"))


def _parts(spark, sf_dir, *columns):
    """Parts for requests, dealt to all tasks: their file is small, so a few tasks would read it, but requests made of it are work."""
    p = load(spark, sf_dir, "part", "p_partkey", *columns)
    return dealt(p, p.count(), "p_partkey")


@query("SELECT o_orderkey AS n FROM orders WHERE 1 + o_orderkey % 40 <= 27")
def p7_bounded_context(spark, sf_dir):
    """Numbers of ten digits count as phones only with the whole word within 32 code points."""
    text = F.concat(F.lit("phone"), F.repeat(F.lit(" "), (1 + F.col("n") % 40).cast("int")), F.lit("9123456789"))
    return d.find_type(_n(spark, sf_dir).withColumn("text", text), "PHONE_NUMBER", ["n"]).select("n")


@query("SELECT o_orderkey AS n FROM orders WHERE o_orderkey % 3 = 0")
def p8_context_sequence(spark, sf_dir):
    """Policy numbers that do not check need the four words of the policy's name in a row."""
    k = F.col("n") % 3
    words = F.when(k == 0, "полис обязательного, медицинского страхования").when(k == 1, "полис обязательного страхования").otherwise("полис")
    text = F.concat(words, F.lit(" 1234567890123456"))
    return d.find_type(_n(spark, sf_dir).withColumn("text", text), "RU_OMS", ["n"]).select("n")


@query("SELECT t AS type, count(*) AS n FROM orders, (VALUES ('IP_ADDRESS'), ('IBAN')) v(t) GROUP BY 1")
def p3_enabled_types(spark, sf_dir):
    """Only enabled types are looked for, in canonical order."""
    text = F.concat(F.lit("a@b.com 4111 1111 1111 1111 DE89370400440532013000 10.0.0.1 n "), F.col("n"))
    found = d.detect_pii(_n(spark, sf_dir).withColumn("text", text), types=["IBAN", "IP_ADDRESS"])
    return d.findings_of(found, ["n"]).groupBy("type").agg(F.count_distinct("n").alias("n"))


@query("SELECT o_orderkey AS n, 11::BIGINT AS host_start, (11 + len('10.0.0.' || (o_orderkey % 256)))::BIGINT AS host_end FROM orders")
def d13_url_hosts(spark, sf_dir):
    """The IP-literal host inside an annotated URL."""
    text = F.concat(F.lit("see http://10.0.0."), F.col("n") % 256, F.lit(":80/p"))
    df = _n(spark, sf_dir).withColumn("text", text).withColumn("a", F.lit(4).cast("bigint")).withColumn("b", F.octet_length("text").cast("bigint"))
    return d.annotate_url_hosts(df, "text", "a", "b").select("n", "host_start", "host_end")


@query("""SELECT l_orderkey AS k, CASE WHEN bool_or(l_linenumber = 7) THEN 'DETECTOR_FAILED' END AS error_code,
  CASE WHEN NOT bool_or(l_linenumber = 7) THEN count(DISTINCT l_partkey) FILTER (l_partkey >= 500) END AS n FROM lineitem GROUP BY 1""")
def w7_window_errors(spark, sf_dir):
    """An error of one window is the document's; spans outside the core are dropped, equal ones united."""
    w = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") == 7, "DETECTOR_FAILED").alias("window_error"), F.col("l_partkey").alias("start_utf8"),
        (F.col("l_partkey") + 5).alias("end_utf8"), F.lit("X").alias("type"), F.lit("r").alias("recognizer_id"), F.lit(500).alias("core_start"), F.lit(10**9).alias("core_end"),
    )
    out = d.reconcile_windows(w, ["k"])
    return out.select("k", "error_code", F.when(F.col("error_code").isNull(), F.size("spans")).cast("bigint").alias("n"))


@query("""SELECT kind, text, count(*) AS n FROM (SELECT 'SCHEMA_TEXT' AS kind, p_name AS text FROM part UNION ALL SELECT 'SCHEMA_TEXT', p_type FROM part
 UNION ALL SELECT 'PROPERTY_NAME', p_brand FROM part) GROUP BY 1, 2""")
def n3_schema_texts(spark, sf_dir):
    """Texts inside a JSON schema for each part."""
    js = F.concat(F.lit('{"title":"'), "p_name", F.lit('","type":"object","properties":{"'), "p_brand", F.lit('":{"description":"'), "p_type", F.lit('","type":"string"}}}'))
    p = _parts(spark, sf_dir, "p_name", "p_brand", "p_type").select("p_partkey", F.try_parse_json(js).alias("v"))
    return ch.schema_text(p, ["p_partkey"], "v").groupBy("kind", "text").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, 'TOOL_NAME' AS kind, p_brand AS text FROM part UNION ALL SELECT p_partkey, 'TOOL_DESCRIPTION', p_name FROM part
 UNION ALL SELECT p_partkey, 'MESSAGE_TEXT', 'hi' FROM part UNION ALL SELECT p_partkey, 'LOCATION', 'C' || p_size FROM part""")
def n2_tool_fragments(spark, sf_dir):
    """Fragments of tools and of the web-search location."""
    msg = F.lit('{"model":"m","messages":[{"role":"user","content":"hi"}],"tools":[{"type":"function","function":')
    body = F.concat(msg, F.to_json(F.struct(F.col("p_brand").alias("name"), F.col("p_name").alias("description"))), F.lit('}],"web_search_options":{"user_location":{"approximate":{"city":"C'), "p_size", F.lit('"}}}}'))
    p = _parts(spark, sf_dir, "p_name", "p_brand", "p_size").select("p_partkey", body.alias("body"))
    return ch.fragments_from_requests(ch.scan_requests(p), ["p_partkey"]).select("p_partkey", "kind", "text")


@query("SELECT c_custkey, '2001:db8::' || CASE WHEN c_custkey = 0 THEN '' ELSE printf('%x', c_custkey) END AS ip FROM customer")
def c2_ipv6_texts(spark, sf_dir):
    c = load(spark, sf_dir, "customer", "c_custkey")
    return c.select("c_custkey", cx.ipv6_text(F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex("c_custkey"))).alias("ip"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'INVALID_URL' WHEN 1 THEN 'MISSING_MODEL' WHEN 2 THEN 'INVALID_PHASE' END AS context_code FROM customer")
def c4_contexts(spark, sf_dir):
    k = F.col("c_custkey") % 4
    c = load(spark, sf_dir, "customer", "c_custkey").select(
        "c_custkey", F.when(k > 0, "http://a/").alias("canonical_url"), F.when(k == 1, " ").otherwise("m").alias("model"),
        F.when(k == 2, "OTHER").otherwise("REQUEST").alias("phase"), F.lit(None).cast("string").alias("identity_code"),
    )
    return cx.assemble_contexts(c).select("c_custkey", "context_code")


#: The pads of the key "key" as HMAC defines them.
_PADS = tuple(bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(f"SELECT c_custkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(c_name)))) AS p FROM customer")
def c7_pseudonyms(spark, sf_dir):
    """HMAC-SHA256 of customer names."""
    return cx.pseudonymise(load(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_name", b"key", "p").select("c_custkey", "p")


@query("SELECT v AS view, l_returnflag AS type, count(*) AS n FROM lineitem, (VALUES ('source'), ('product'), ('nested_ip')) x(v) WHERE v <> 'product' OR l_linenumber > 1 GROUP BY 1, 2")
def e7_gold_views(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_returnflag").alias("type"))
    return qu.gold_views(g, g.where("l_linenumber > 1"), g).groupBy("view", "type").agg(F.count("*").alias("n"))


def _product(spark, sf_dir):
    n = _n(spark, sf_dir)
    inn = F.when(F.col("n") % 2 == 0, "1234567890").otherwise("123456789012")
    gap = F.when(F.col("n") % 3 == 0, " № ").otherwise(" something else ")
    one = lambda *c: F.struct(*[x.alias(f"c{k}") for k, x in enumerate(c)])
    rows = F.array(
        one(F.lit("RU_INN"), F.lit(0), F.length(inn), inn, F.lit(" ")),
        one(F.lit("RU_PASSPORT"), F.lit(20), F.lit(24), F.lit("4509"), gap),
        one(F.lit("RU_PASSPORT"), F.lit(40), F.lit(46), F.lit("123456"), F.lit("")),
    )
    kind = "array<struct<type:string,start:int,end:int,value:string,gap_text:string>>"
    return qu.product_gold(n.select(F.col("n").alias("case_id"), F.inline(rows.cast(kind))))


@query("SELECT 'LEGAL_ENTITY_INN' AS rule, 1 AS version, count(*) FILTER (o_orderkey % 2 = 0) AS n FROM orders UNION ALL SELECT 'PASSPORT_PARTS', 1, count(*) FILTER (o_orderkey % 3 = 0) FROM orders")
def e10_adjustments(spark, sf_dir):
    return _product(spark, sf_dir)[1]


@query("""SELECT o_orderkey AS case_id, 'RU_INN' AS type, 0 AS s, 12 AS e FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT o_orderkey, 'RU_PASSPORT', 20, CASE WHEN o_orderkey % 3 = 0 THEN 46 ELSE 24 END FROM orders UNION ALL SELECT o_orderkey, 'RU_PASSPORT', 40, 46 FROM orders WHERE o_orderkey % 3 <> 0""")
def e8_e9_product_gold(spark, sf_dir):
    return _product(spark, sf_dir)[0].select("case_id", "type", F.col("start").alias("s"), F.col("end").alias("e"))


@query(_REACT_SQL + """, frag AS (SELECT fragment_id, context_id, bool_or(disposition = 'BLOCK') AS block, NOT bool_or(disposition = 'BLOCK') AND bool_or(masks) AS masks, bool_or(state = 'ERROR') AS failed FROM reac GROUP BY 1, 2)
SELECT context_id, CASE WHEN bool_or(failed) THEN 'ERROR' WHEN bool_or(block) THEN 'BLOCK' WHEN bool_or(masks) THEN 'MASK' ELSE 'ALLOW' END AS outcome FROM frag GROUP BY 1""")
def a2_response_outcomes(spark, sf_dir):
    """In responses a mask of a structural field does not block."""
    f = po.decide_fragments(_reactions(spark, sf_dir)).withColumn("field_class", F.lit("STRUCTURAL"))
    return po.decide_messages(f, ["context_id"], "RESPONSE")


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'SHORT' WHEN lang = 'de' THEN 'LANGUAGE' END AS reason FROM documents")
def p9_reject_reasons(spark, sf_dir):
    """The first rule that holds names the reject."""
    docs = load(spark, sf_dir, "documents", "doc_id", "n_chars", "lang")
    return co.with_reason(docs, [("SHORT", F.col("n_chars") < 200), ("LANGUAGE", F.col("lang") == "de")]).select("doc_id", "reason")


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'UNSUPPORTED_SCHEMA' ELSE 'AMBIGUOUS_CONTENT' END AS reject FROM (SELECT DISTINCT conv_id FROM conversations)")
def s8_response_rejects(spark, sf_dir):
    body = F.when(F.col("conv_id") % 2 == 0, '{"model":"m"}').otherwise('{"choices":[],"choices":[]}')
    c = load(spark, sf_dir, "conversations", "conv_id").distinct().withColumn("body", body)
    return ch.scan_responses(c).select("conv_id", "reject")


def _full_requests(spark, sf_dir):
    """A request for each part with all kinds of fields outside of messages, and its schemas."""
    p = _parts(spark, sf_dir, "p_name", "p_brand", "p_type", "p_size")
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    body = F.concat(
        F.lit('{"messages":[{"role":"user","content":"hi"}],"tools":[{"type":"function","function":{"name":"f","parameters":{"type":"object","properties":{'), text("p_brand"),
        F.lit(':{"type":"string","enum":['), text("p_type"), F.lit("]}}}}},"), F.lit('{"type":"custom","custom":{"name":"c","format":{"type":"grammar","grammar":{"syntax":"regex","definition":'), F.concat(F.lit("\""), "p_size", F.lit("\"")),
        F.lit('}}}}],"allowed_tools":{"mode":"auto","tools":[{"type":"function","function":{"name":'), text("p_name"), F.lit('}}]},"prediction":{"type":"content","content":[{"type":"text","text":'), text("p_name"),
        F.lit('}]},"function_call":{"name":"g"},"response_format":{"type":"json_schema","json_schema":{"name":"s","schema":{"title":'), text("p_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(',"items":{"$ref":"https://example.com/s"}')).otherwise(F.lit(',"items":{"$ref":"#/definitions/a"}')), F.lit("}}}}"),
    )
    return ch.scan_requests(p.select("p_partkey", body.alias("body")))


@query("""SELECT p_partkey, kind, text FROM part, LATERAL (VALUES ('MESSAGE_TEXT', 'hi'), ('TOOL_NAME', 'f'), ('TOOL_NAME', 'c'), ('SCHEMA_TEXT', p_size::VARCHAR), ('TOOL_NAME', p_name), ('PREDICTION', p_name),
 ('TOOL_NAME', 'g'), ('SCHEMA_NAME', 's'), ('SCHEMA_NAME', p_brand), ('SCHEMA_TEXT', p_type), ('SCHEMA_TEXT', p_name)) v(kind, text)""")
def n2_n3_request_fields(spark, sf_dir):
    """Allowed tools, custom tools with grammars, predictions in parts, and the texts of schemas, as fragments of requests."""
    return ch.request_fragments(_full_requests(spark, sf_dir), ["p_partkey"]).select("p_partkey", "kind", "text")


@query("SELECT p_partkey, 'UNSUPPORTED_SCHEMA' AS reject FROM part WHERE p_partkey % 3 = 0")
def n3_references(spark, sf_dir):
    """Requests whose schemas refer to other documents."""
    return ch.schema_references(_full_requests(spark, sf_dir), ["p_partkey"])


@query("""SELECT conv_id, '/messages/' || ((turn_at - 1) * 1)::VARCHAR || CASE role WHEN 'assistant' THEN '/audio' ELSE '/reasoning/encrypted_content' END AS locator,
 CASE role WHEN 'assistant' THEN 'OPAQUE_AUDIO_REFERENCE' ELSE 'OPAQUE_REASONING' END AS gap_kind
 FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_at FROM conversations) WHERE role IN ('assistant', 'system')""")
def n5_opaque_gaps(spark, sf_dir):
    """Audio of earlier answers by id, and encrypted reasoning."""
    t = load(spark, sf_dir, "conversations")
    audio = F.when(F.col("role") == "assistant", F.struct(F.lit("a-1").alias("id")))
    hidden = F.when(F.col("role") == "system", F.struct(F.lit("xyz").alias("encrypted_content")))
    one = t.withColumn("m", F.to_json(F.struct("role", F.col("text").alias("content"), audio.alias("audio"), hidden.alias("reasoning"))))
    body = F.concat(F.lit('{"messages":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]), ","), F.lit("]}"))
    return ch.inspection_gaps(ch.scan_requests(one.groupBy("conv_id").agg(body.alias("body"))), ["conv_id"])


@query("""SELECT conv_id, turn, '/choices/0/message/' || k AS locator, CASE k WHEN 'audio' THEN 'AUDIO' ELSE 'OPAQUE_REASONING' END AS gap_kind
 FROM conversations, (VALUES ('audio'), ('reasoning/encrypted_content')) v(k) WHERE role = 'assistant' AND (k = 'audio' OR turn % 2 = 1)""")
def n7_response_gaps(spark, sf_dir):
    t = load(spark, sf_dir, "conversations").where("role = 'assistant'")
    audio = F.struct(F.lit("QUJD").alias("data"), F.col("text").alias("transcript"))
    hidden = F.when(F.col("turn") % 2 == 1, F.struct(F.lit("xyz").alias("encrypted_content")))
    body = F.concat(F.lit('{"choices":[{"index":0,"message":'), F.to_json(F.struct("role", audio.alias("audio"), hidden.alias("reasoning"))), F.lit("}]}"))
    return ch.response_gaps(ch.scan_responses(t.withColumn("body", body)), ["conv_id", "turn"])


@query("""WITH f AS (SELECT l_orderkey AS id, l_returnflag AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'VALIDATED' ELSE 'FORMAT_ONLY' END AS e, l_linenumber FROM lineitem WHERE l_linenumber <> 3),
b AS (SELECT id, t, count(*) AS n FROM f GROUP BY 1, 2), v AS (SELECT id, e, count(*) AS n FROM f GROUP BY 1, 2), m AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
x AS (SELECT l_orderkey AS id, min(l_linenumber) FILTER (l_linenumber = 5) AS bad, count(*) AS n FROM lineitem GROUP BY 1)
SELECT m.id, CASE WHEN bad IS NOT NULL THEN 'ERROR' WHEN s.n > 0 THEN 'DETECTED' WHEN m.id % 2 = 0 THEN 'INSPECTION_GAP' ELSE 'CLEAN' END AS audit_outcome, x.n AS n_fragments, coalesce(s.n, 0)::BIGINT AS n_findings,
 coalesce(b.r, '') AS by_type, coalesce(v.r, '') AS by_evidence, 'p-a@1,p-b@2' AS policies, CASE WHEN bad IS NOT NULL THEN CASE WHEN m.id % 3 = 0 THEN 'DETECTOR_EXECUTION_ERROR' ELSE 'A_FAILED' END END AS error_code
FROM m JOIN x USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM f GROUP BY 1) s USING (id) LEFT JOIN (SELECT id, string_agg(t || ':' || n, ',' ORDER BY t || ':' || n) AS r FROM b GROUP BY 1) b USING (id)
LEFT JOIN (SELECT id, string_agg(e || ':' || n, ',' ORDER BY e || ':' || n) AS r FROM v GROUP BY 1) v USING (id)""")
def a3_a6_audit(spark, sf_dir):
    """Orders as messages, their lines as fragments: one finding each but for every third line; the fifth line fails."""
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    n = F.col("l_linenumber")
    one = F.array(F.struct(F.col("l_returnflag").alias("type"), F.when(n % 2 == 0, "VALIDATED").otherwise("FORMAT_ONLY").alias("evidence")))
    kind = "array<struct<type:string,evidence:string>>"
    fails = F.array(F.struct(F.lit("z").alias("detector_id"), F.lit("Z_FAILED").alias("error_code")), F.struct(F.lit("a").alias("detector_id"), F.lit("A_FAILED").alias("error_code")))
    none = F.array().cast("array<struct<detector_id:string,error_code:string>>")
    frag = li.select(
        F.col("l_orderkey").alias("id"), F.when(n == 3, F.array().cast(kind)).otherwise(one.cast(kind)).alias("findings"), F.array(F.lit("p-b@2"), F.lit("p-a@1")).alias("policies"),
        (n == 5).alias("failed"), F.when((n == 5) & (F.col("l_orderkey") % 3 > 0), fails).otherwise(none).alias("errors"),
    )
    msg = li.select(F.col("l_orderkey").alias("id")).distinct().withColumn("has_gap", F.col("id") % 2 == 0)
    return po.audit_messages(frag, msg, ["id"])


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE turn END AS ordinal, CASE WHEN conv_id % 4 = 0 THEN '' ELSE text END AS text FROM conversations WHERE conv_id % 4 > 0 OR turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id)")
def a7_gap_payloads(spark, sf_dir):
    """What is evaluated for each conversation; every fourth one has gaps only."""
    t = load(spark, sf_dir, "conversations")
    frag = t.where("conv_id % 4 > 0").select("conv_id", F.col("turn").alias("ordinal"), "text")
    return po.inspected_payloads(t.select("conv_id").distinct(), frag, ["conv_id"])


@query("SELECT o_orderkey AS n, 'PAYMENT_CARD' AS type, 'VALIDATED' AS evidence, 'fast.payment_card.luhn' AS recognizer FROM orders")
def j11_finding_metadata(spark, sf_dir):
    ids = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"))
    f = d.detect_pii(co.generate_planted(ids, "PAYMENT_CARD"), types=["PAYMENT_CARD"]).select("n", F.inline(po.policy_findings(F.col("findings"))))
    return f.select("n", "type", F.col("metadata")["evidenceStrength"].alias("evidence"), F.col("metadata")["recognizerId"].alias("recognizer"))


@query("""SELECT doc_id, lang, '[EMAIL_MASKED]' AS masked, source FROM documents""")
def m8_rebuilt_json(spark, sf_dir):
    """Masked values written back into JSON documents and read again."""
    docs = load(spark, sf_dir, "documents", "doc_id", "lang", "source").withColumn("text", F.concat(F.lit("a"), "doc_id", F.lit("@example.com")))
    docs = ma.mask_documents(d.detect_pii(docs, types=["EMAIL_ADDRESS"]))
    out = ma.rebuild_json(docs, {"content": "masked", "lang": "lang", "source": "source"}).select("doc_id", F.from_json("body", "content string, lang string, source string").alias("x"))
    return out.select("doc_id", F.col("x.lang").alias("lang"), F.col("x.content").alias("masked"), F.col("x.source").alias("source"))
