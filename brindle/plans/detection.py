"""Queries of detection, masking and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import checksums as ck
from brindle.functions.recognizers import NAMES
from brindle.functions.tables import saved
from brindle.operators import detect as d
from brindle.operators import masking as m
from brindle.plans.catalog import load, query
from brindle.sources import corpora as c

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def _planted(spark, sf_dir, kind):
    ids = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"))
    return c.generate_planted(ids, kind)


def _negatives(spark, sf_dir, kind):
    ids = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"))
    return c.hard_negatives(ids, kind)


def _found(df, kind):
    return d.find_type(df, kind, ["n"]).select("n", "start_utf8", "end_utf8", "evidence")


@query(rf"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^A-Za-z0-9.:])({_V4})([^A-Za-z0-9.:]|\.([^A-Za-z0-9.:]|$)|$)', 2)) AS ip FROM documents)
SELECT ip, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM runs GROUP BY ip
""")
def d4_ipv4_values(spark, sf_dir):
    """Addresses in documents, by value."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select("doc_id", "text", F.inline(d.FINDERS["IP_ADDRESS"](F.col("text"))))
    value = F.decode(F.substring(F.encode("text", "UTF-8"), (F.col("start_utf8") + 1).cast("int"), (F.col("end_utf8") - F.col("start_utf8")).cast("int")), "UTF-8")
    return rows.select("doc_id", value.alias("ip")).where("ip not like '%:%'").groupBy("ip").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(r"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^A-Za-z0-9!#$%&''*+/=?^_`{|}~. -]|[^!#$%&''*+/=?^_`{|}~. -] +)[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]+@[A-Za-z0-9-]+( ?\. ?[A-Za-z0-9-]+)+([^A-Za-z0-9.-]|$)')) AS m FROM documents)
SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id
""")
def d1_email_documents(spark, sf_dir):
    """Documents with e-mail addresses."""
    return d.find_type(load(spark, sf_dir, "documents", "doc_id", "text"), "EMAIL_ADDRESS", ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))


_CARDS = r"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9 -]*')) AS run FROM documents),
shaped AS (
  SELECT doc_id, regexp_replace(rtrim(run, ' '), '[^0-9]', '', 'g') AS v FROM runs
  WHERE regexp_full_match(rtrim(run, ' '), '[0-9]([ -]?[0-9]){12,18}')),
checked AS (
  SELECT doc_id, v, list_sum([CASE WHEN (len(v) - i) % 2 = 0 THEN v[i]::INT ELSE (CASE WHEN 2 * v[i]::INT > 9 THEN 2 * v[i]::INT - 9 ELSE 2 * v[i]::INT END) END
                              for i in range(1, len(v) + 1)]) AS s FROM shaped)
"""


@query(_CARDS + "SELECT doc_id, count(*) AS n FROM checked WHERE s % 10 = 0 AND len(list_distinct(string_split(v, ''))) > 1 GROUP BY doc_id")
def d3_card_documents(spark, sf_dir):
    """Documents with payment cards."""
    return d.find_type(load(spark, sf_dir, "documents", "doc_id", "text"), "PAYMENT_CARD", ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))


_KEY = "SELECT o_orderkey AS n FROM orders"


def _weights(w: list[int], v: str) -> str:
    return " + ".join(f"{k} * substr({v}, {i}, 1)::INT" for i, k in enumerate(w, 1))


@query("SELECT o_orderkey AS n, 5::BIGINT AS start_utf8, (5 + 4 + len(o_orderkey::VARCHAR) + 17)::BIGINT AS end_utf8, 'FORMAT_ONLY' AS evidence FROM orders")
def d1_email_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "EMAIL_ADDRESS"), "EMAIL_ADDRESS")


@query("SELECT o_orderkey AS n, 5::BIGINT AS start_utf8, 19::BIGINT AS end_utf8, 'FORMAT_ONLY' AS evidence FROM orders")
def d2_phone_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "PHONE_NUMBER"), "PHONE_NUMBER")


@query("SELECT o_orderkey AS n, 5::BIGINT AS start_utf8, 21::BIGINT AS end_utf8, 'VALIDATED' AS evidence FROM orders")
def d3_card_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "PAYMENT_CARD"), "PAYMENT_CARD")


@query("""SELECT o_orderkey AS n, 5::BIGINT AS start_utf8,
  (5 + 2 + 3 + len(((o_orderkey // 65536) % 256)::VARCHAR) + len(((o_orderkey // 256) % 256)::VARCHAR) + len((o_orderkey % 256)::VARCHAR))::BIGINT AS end_utf8,
  'VALIDATED' AS evidence FROM orders""")
def d4_ip_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "IP_ADDRESS"), "IP_ADDRESS")


@query("SELECT o_orderkey AS n, 8::BIGINT AS start_utf8, 30::BIGINT AS end_utf8, 'VALIDATED' AS evidence FROM orders")
def d5_iban_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "IBAN"), "IBAN")


@query("SELECT o_orderkey AS n, 4::BIGINT AS start_utf8, 16::BIGINT AS end_utf8, 'VALIDATED' AS evidence FROM orders")
def d6_inn_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "RU_INN"), "RU_INN")


@query("SELECT o_orderkey AS n, 3::BIGINT AS start_utf8, 17::BIGINT AS end_utf8, 'VALIDATED' AS evidence FROM orders")
def d7_snils_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "RU_SNILS"), "RU_SNILS")


@query("SELECT o_orderkey AS n, 15::BIGINT AS start_utf8, 27::BIGINT AS end_utf8, 'CONTEXTUAL' AS evidence FROM orders")
def d8_passport_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "RU_PASSPORT"), "RU_PASSPORT")


@query("SELECT o_orderkey AS n, 7::BIGINT AS start_utf8, 23::BIGINT AS end_utf8, 'VALIDATED' AS evidence FROM orders")
def d9_oms_planted(spark, sf_dir):
    return _found(_planted(spark, sf_dir, "RU_OMS"), "RU_OMS")


@query("SELECT t AS type, 0::BIGINT AS n_found, count(*) AS n_texts FROM orders, (VALUES ('PAYMENT_CARD'), ('IBAN'), ('RU_INN'), ('RU_SNILS'), ('RU_OMS')) v(t) GROUP BY t")
def s16_hard_negatives(spark, sf_dir):
    """Planted values with a wrong last digit are never found."""
    parts = [
        _negatives(spark, sf_dir, k).select("type", F.size(d.FINDERS[k](F.col("text"))).alias("k"))
        for k in ("PAYMENT_CARD", "IBAN", "RU_INN", "RU_SNILS", "RU_OMS")
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("type").agg(F.sum("k").alias("n_found"), F.count("*").alias("n_texts"))


@query(
    "WITH k AS (SELECT o_orderkey AS n, lpad(o_orderkey::VARCHAR, 10, '1') AS b FROM orders), "
    f"e AS (SELECT n, b, (({_weights(ck.INN_11, 'b')}) % 11 % 10)::VARCHAR AS d11 FROM k) "
    f"SELECT n, b || d11 || (({_weights(ck.INN_12, '(b || d11)')}) % 11 % 10)::VARCHAR AS inn FROM e"
)
def s16_inn_values(spark, sf_dir):
    return load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"), c.inn_of(F.col("o_orderkey")).alias("inn"))


@query("""WITH k AS (SELECT o_orderkey AS n, lpad(o_orderkey::VARCHAR, 18, '0') AS b FROM orders)
SELECT n, 'DE' || lpad((98 - (b || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || b AS iban FROM k""")
def s16_iban_values(spark, sf_dir):
    return load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("n"), c.iban_of(F.col("o_orderkey")).alias("iban"))


def _all(spark, sf_dir):
    ids = load(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("n"))
    parts = [c.generate_planted(ids, k) for k in NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT t AS type, count(*) AS n FROM customer, (VALUES ('EMAIL_ADDRESS'), ('PHONE_NUMBER'), ('PAYMENT_CARD'), ('IP_ADDRESS'), ('IBAN'), ('RU_INN'), ('RU_SNILS'), ('RU_PASSPORT'), ('RU_OMS')) v(t) GROUP BY t")
def d10_detect_all(spark, sf_dir):
    """All recognizers on planted texts find the planted span, whatever else they find in it."""
    found = d.detect_pii(saved(_all(spark, sf_dir).withColumnRenamed("type", "gold"), "planted"))
    hit = F.exists("findings", lambda f: (f["type"] == F.col("gold")) & (f["start_utf8"] == F.col("start_utf8")) & (f["end_utf8"] == F.col("end_utf8")))
    return found.where(hit).groupBy(F.col("gold").alias("type")).agg(F.count("*").alias("n"))


@query()
def d10_documents(spark, sf_dir):
    """Findings of all types in documents, by type and language (single types have SQL of their own)."""
    found = d.detect_any_size(load(spark, sf_dir, "documents", "lang", "text"))
    return d.findings_of(found, ["lang"]).groupBy("type", "lang").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS n, 'PAYMENT_CARD' AS first_type FROM orders")
def d11_first_finding(spark, sf_dir):
    """The first finding is that of the first type, not the leftmost."""
    p = _planted(spark, sf_dir, "PAYMENT_CARD").withColumn("text", F.concat(F.lit("host 10.0.0.1 "), "text"))
    return d.detect_pii(p, stop_on_first=True).select("n", F.col("findings")[0]["type"].alias("first_type"))


@query("SELECT lang, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) FILTER (octet_length(encode(text)) > 8000) AS too_large FROM documents GROUP BY lang")
def p1_preflight(spark, sf_dir):
    """Sizes in UTF-8 and texts above a limit."""
    p = d.preflight(load(spark, sf_dir, "documents", "lang", "text"), limit=8000)
    return p.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size_utf8").alias("bytes"), F.count_if(F.col("error_code") == "PAYLOAD_TOO_LARGE").alias("too_large"))


@query("SELECT o_orderkey AS n, 'card [CARD_MASKED] used' AS masked FROM orders")
def m3_masked_cards(spark, sf_dir):
    """Card texts with the span masked; the card that is also a policy number would be mixed, so one type is enabled."""
    found = d.detect_pii(_planted(spark, sf_dir, "PAYMENT_CARD"), types=["PAYMENT_CARD"])
    return m.mask_documents(found).select("n", "masked")


@query("SELECT o_orderkey AS n, 'host ' || CASE WHEN k >= 11 THEN '[IP_MASKED]' ELSE '[' || substr('IP_MASKED]', 1, k::INT - 2) || ']' END || ' up' AS masked FROM (SELECT o_orderkey, 5 + len(((o_orderkey // 65536) % 256)::VARCHAR) + len(((o_orderkey // 256) % 256)::VARCHAR) + len((o_orderkey % 256)::VARCHAR) AS k FROM orders)")
def m4_fitted_markers(spark, sf_dir):
    """Markers cut to the bytes of their spans."""
    found = d.detect_pii(_planted(spark, sf_dir, "IP_ADDRESS"), types=["IP_ADDRESS"])
    return m.mask_documents(found, fit=True).select("n", "masked")


_SPANS = "SELECT l_orderkey AS k, (l_partkey % 50)::BIGINT AS s, (l_partkey % 50 + 1 + l_linenumber)::BIGINT AS e, l_returnflag AS marker FROM lineitem"


@query(f"""WITH x AS ({_SPANS}),
h AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, marker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM x),
i AS (SELECT *, sum(CASE WHEN high IS NULL OR s > high THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e, marker ROWS UNBOUNDED PRECEDING) AS isl FROM h)
SELECT k, min(s) AS "start", max(e) AS "end", CASE WHEN min(marker) = max(marker) THEN min(marker) ELSE '[PII_MASKED]' END AS marker FROM i GROUP BY k, isl""")
def m2_islands(spark, sf_dir):
    """Islands of overlapping and adjacent spans of an order."""
    x = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + 1 + F.col("l_linenumber")).alias("end"), F.col("l_returnflag").alias("marker")
    )
    return m.merge_span_rows(x, ["k"])


@query(f"""WITH x AS ({_SPANS}),
h AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, marker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM x),
i AS (SELECT *, sum(CASE WHEN high IS NULL OR s > high THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e, marker ROWS UNBOUNDED PRECEDING) AS isl FROM h)
SELECT k, count(DISTINCT isl) AS n_islands FROM i GROUP BY k""")
def m2_islands_array(spark, sf_dir):
    """The same in array form, as the shuffle-free masking uses it."""
    x = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_list(F.struct((F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + 1 + F.col("l_linenumber")).alias("end"), F.col("l_returnflag").alias("marker"))).alias("spans")
    )
    return x.select("k", F.size(m.merge_spans(F.col("spans"))).cast("bigint").alias("n_islands"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS covered FROM documents WHERE text <> ''")
def w1_chunks_cover(spark, sf_dir):
    """Cores of windows cover each document once."""
    ch = d.chunk_documents(load(spark, sf_dir, "documents", "doc_id", "text"), window=2048, entity=64)
    return ch.groupBy("doc_id").agg(F.sum(F.col("core_end") - F.col("core_start")).alias("covered"))


@query("""WITH c AS (SELECT doc_id, strlen(text) AS size, 1024 * (doc_id % 6) AS w, CASE WHEN doc_id % 3 > 0 THEN doc_id % 1500 END AS e, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE '1.0' END AS v FROM documents)
SELECT doc_id, CASE WHEN trim(v) = '' OR w <= 0 OR (e IS NOT NULL AND NOT (e > 0 AND e <= w AND w - 2 * (e - 1) >= 4)) THEN 'INVALID_CAPABILITY'
 WHEN e IS NULL AND size > w THEN 'WINDOWING_UNSUPPORTED' END AS error_code FROM c""")
def w6_capabilities(spark, sf_dir):
    """Documents with windows, largest entities and versions of their own."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    entity, version = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 1500), F.when(F.col("doc_id") % 11 == 0, " ").otherwise("1.0")
    return docs.select("doc_id", d.windowing_error(F.octet_length("text"), 1024 * (F.col("doc_id") % 6), entity, version).alias("error_code"))


@query(_CARDS + "SELECT doc_id, count(*) AS n FROM checked WHERE s % 10 = 0 AND len(list_distinct(string_split(v, ''))) > 1 GROUP BY doc_id")
def w3_windowed_cards(spark, sf_dir):
    """Cards found in windows of 2 KiB are those found in whole documents."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    out = d.detect_windowed(docs, ["doc_id"], types=["PAYMENT_CARD"], window=2048, entity=256)
    return out.select("doc_id", F.size("findings").cast("bigint").alias("n")).where("n > 0")


@query("SELECT doc_id, 'UNKNOWN_DETECTOR' AS error_code, 'ERROR' AS status FROM documents")
def p5_unknown_detector(spark, sf_dir):
    out = d.run_detectors(load(spark, sf_dir, "documents", "doc_id", "text"), ["nobody"])
    return out.select("doc_id", "error_code", "status")


@query("SELECT count(*) AS n, 0::BIGINT AS n_invalid FROM documents")
def p4_valid_findings(spark, sf_dir):
    """All findings of documents are valid spans in canonical order."""
    out = d.detect_any_size(load(spark, sf_dir, "documents", "doc_id", "text"))
    ok = F.coalesce(d.valid_findings(F.col("findings"), F.coalesce("text", F.lit(""))), F.lit(False))  # no findings, not even an empty array: not valid
    return out.select(ok.alias("ok")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_invalid"))


_DELTAS = """deltas AS (
  SELECT conv_id, turn, k AS seq, substr(text, (k * 16 + 1)::INT, 16) AS delta
  FROM (SELECT conv_id, turn, text, unnest(range(0, ((len(text) + 15) // 16)::BIGINT)) AS k FROM conversations))"""


def deltas(spark, sf_dir):
    """Turns cut to pieces of 16 characters."""
    t = load(spark, sf_dir, "conversations", "conv_id", "turn", "text").where("text <> ''")
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 16).cast("int") - 1))
    return t.withColumn("k", k).select("conv_id", "turn", F.col("k").cast("bigint").alias("seq"), F.substring("text", F.col("k") * 16 + 1, F.lit(16)).alias("delta"))


@query(f"""WITH {_DELTAS}
SELECT conv_id, turn, seq, coalesce(sum(octet_length(encode(delta))) OVER (PARTITION BY conv_id, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg_start,
       octet_length(encode(delta))::BIGINT AS size FROM deltas""")
def n9_segment_offsets(spark, sf_dir):
    s = m.segment_offsets(deltas(spark, sf_dir), ["conv_id", "turn"])
    return s.select("conv_id", "turn", "seq", "seg_start", (F.col("seg_end") - F.col("seg_start")).alias("size"))


@query("""SELECT o_orderkey AS n, 'card [CARD_MASKED] used' AS masked FROM orders""")
def m5_masked_deltas(spark, sf_dir):
    """A span that crosses deltas leaves one marker; the deltas joined are the masked text."""
    p = _planted(spark, sf_dir, "PAYMENT_CARD")
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 7).cast("int") - 1))
    cut = p.withColumn("k", k).select("n", F.col("k").alias("seq"), F.substring("text", F.col("k") * 7 + 1, F.lit(7)).alias("delta"))
    isl = p.select("n", F.col("start_utf8").alias("start"), F.col("end_utf8").alias("end"), F.lit("[CARD_MASKED]").alias("marker"))
    out = m.mask_deltas(cut, isl, ["n"])
    return out.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "masked_delta"))), lambda x: x["masked_delta"]), "").alias("masked"))


@query("SELECT l_orderkey AS k, CASE WHEN count(DISTINCT l_linenumber) < count(*) THEN 'DUPLICATE_ORDINAL' WHEN count(DISTINCT l_partkey) < count(*) THEN 'DUPLICATE_LOCATOR' WHEN bool_or(bad) THEN 'OVERLAP' END AS error_code FROM (SELECT *, coalesce(lag(l_partkey % 50 + l_suppkey % 5 + 1) OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 50, l_partkey % 50 + l_suppkey % 5 + 1) > l_partkey % 50, false) AS bad FROM lineitem) GROUP BY 1")
def m6_patch_checks(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("locator"),
        (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_suppkey") % 5 + 1).alias("end"),
    )
    return m.check_patches(x, ["k"])
