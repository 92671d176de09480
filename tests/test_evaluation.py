"""Matching by brute force; contexts, policies and chat on written cases."""

import base64
import hashlib
import hmac
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import audit, chat, policy, quality
from brindle.operators import context as cx


def biggest(gold, pred):
    best = 0
    pairs = [(g, p) for g in gold for p in pred if g[0] < p[1] and p[0] < g[1]]
    for n in range(min(len(gold), len(pred)), 0, -1):
        for c in itertools.combinations(pairs, n):
            if len({id(g) for g, _ in c}) == n and len({id(p) for _, p in c}) == n:
                return n
    return best


def test_relaxed_matching_is_largest(spark):
    rng = random.Random(1)
    g, p, want = [], [], 0
    for case in range(40):
        a = [(x := rng.randrange(30), x + rng.randrange(1, 8)) for _ in range(rng.randrange(5))]
        b = [(x := rng.randrange(30), x + rng.randrange(1, 8)) for _ in range(rng.randrange(5))]
        want += biggest([list(x) for x in a], [list(x) for x in b])
        g += [(case, "T", s, e, k) for k, (s, e) in enumerate(a)]
        p += [(case, "T", s, e, k) for k, (s, e) in enumerate(b)]
    s = "case_id long, type string, start long, end long, span_id long"
    out = quality.match_spans(spark.createDataFrame(g, s), spark.createDataFrame(p, s))
    rows = out.collect()
    assert len(rows) == want and len({(r.case_id, r.g_id) for r in rows}) == len({(r.case_id, r.p_id) for r in rows}) == want
    at = {(side, c, k): (a, b) for side, t in ((0, g), (1, p)) for c, _, a, b, k in t}
    for r in rows:
        (a, b), (c, d) = at[0, r.case_id, r.g_id], at[1, r.case_id, r.p_id]
        assert a < d and c < b


def test_a_long_chain_of_spans_is_matched_whole(spark):
    s = "case_id long, type string, start long, end long, span_id long"
    g = spark.createDataFrame([(1, "T", 4 * k, 4 * k + 3, k) for k in range(5000)] + [(1, "T", 0, 0, -1), (None, "T", 0, 9, 1)], s)
    p = spark.createDataFrame([(1, "T", 4 * k + 2, 4 * k + 5, k) for k in range(5000)] + [(None, "T", 0, 9, 1)], s)
    assert quality.match_spans(g, p).count() == 5000
    assert quality.match_spans(g.limit(0), p).count() == 0


def test_product_rules(spark):
    rows = [
        (1, "RU_INN", 0, 10, "1234567890", ""), (1, "RU_PASSPORT", 20, 24, "4509", " № "), (1, "RU_PASSPORT", 27, 33, "123456", ""),
        (2, "RU_PASSPORT", 0, 4, "4509", " then a long way "), (2, "RU_PASSPORT", 30, 36, "123456", ""),
    ]
    g = spark.createDataFrame(rows, "case_id int, type string, start int, end int, value string, gap_text string")
    gold, used = quality.product_gold(g)
    assert sorted((r.case_id, r.start, r.end) for r in gold.collect()) == [(1, 20, 33), (2, 0, 4), (2, 30, 36)]
    assert {r.rule: r.n for r in used.collect()} == {"LEGAL_ENTITY_INN": 1, "PASSPORT_PARTS": 1}


URLS = [
    ("HTTP://User@Ex.COM.:80/a/./b/../c%7e%2f?q#f", "http://ex.com/a/c~%2F"), ("https://x.org", "https://x.org/"), ("https://x.org:8443//a//", "https://x.org:8443//a//"),
    ("ftp://x.org/", None), ("http:///x", None), ("http://[2001:DB8:0:0:1:0:0:1]/", "http://[2001:db8::1:0:0:1]/"), ("https://пример.рф/a/..", "https://xn--e1afmkfd.xn--p1ai/"),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame(URLS, "url string, want string")
    for r in cx.canonical_urls(df).collect():
        assert r.canonical_url == r.want, r.url


@pytest.mark.parametrize("text,want", [("1:0:0:4:5:0:0:0", "1:0:0:4:5::"), ("0:0:0:0:0:0:0:0", "::"), ("::ffff:1.2.3.4", "::ffff:102:304"), ("1::8", "1::8"), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8"), ("1:0:3:4:5:6:7:8", "1:0:3:4:5:6:7:8")])
def test_ipv6_text(spark, text, want):
    assert spark.range(1).select(cx.ipv6_text(F.lit(text)).alias("x")).first().x == want


def test_pseudonym_is_hmac(spark):
    for key in (b"k", b"long" * 40):
        one = spark.range(1).select(F.lit("tökén").alias("t"), cx.pseudonym(F.lit("tökén"), key).alias("x"))
        got = one.first().x
        secret = cx.pseudonymise(one, "t", key, "y")
        assert secret.first().y == got and key.hex() not in secret._jdf.queryExecution().toString()
        assert got == hmac.new(key, "tökén".encode(), hashlib.sha256).hexdigest()


def test_claims(spark):
    body = lambda c: "e30." + base64.urlsafe_b64encode(json.dumps(c).encode()).decode().rstrip("=") + ".s"
    ok = {"iss": "i", "aud": "a", "exp": 100, "sub": "s", "groups": ["g"]}
    rows = [(body(ok), None), (body(ok | {"nbf": 90}), "NOT_YET_VALID"), (body(ok | {"sub": ""}), "SUBJECT"), ("x.y", "MALFORMED"), (body({"iss": "i"}), "AUDIENCE")]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in cx.claims_from_tokens(df, "t", "i", "a", F.lit(50)).collect():
        assert r.claims_code == r.want


def test_override_cycles(spark):
    p = lambda rows: spark.createDataFrame(rows, "policy_id string, overrides array<string>")
    assert policy.override_cycles(p([("a", ["b"]), ("b", ["c"]), ("c", ["b"]), ("z", [])])).collect()[0].policy_id == "b"
    assert policy.override_cycles(p([("a", ["b"]), ("b", [])])).count() == 0


def test_fragments_of_all_families(spark):
    body = {
        "model": "m",
        "messages": [
            {"role": "system", "content": "rules"},
            {"role": "user", "name": "bob", "content": [{"type": "text", "text": "hi"}, {"type": "image_url", "image_url": {"url": "u"}}]},
            {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{}"}}], "refusal": "no"},
            {"role": "tool", "content": "out"},
        ],
        "tools": [{"type": "function", "function": {"name": "f", "description": "does"}}],
        "tool_choice": {"type": "function", "function": {"name": "f"}},
        "response_format": {"type": "json_schema", "json_schema": {"name": "n", "description": "d"}},
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "[]"), (3, '{"a":1,"a":2}')], "k int, body string")
    r = chat.scan_requests(df)
    assert {x.k: x.reject for x in r.collect()} == {1: None, 2: "MALFORMED_MESSAGE", 3: "AMBIGUOUS_CONTENT"}
    got = [(x.kind, x.text) for x in chat.fragments_from_requests(r, ["k"]).orderBy("ordinal").collect()]
    assert got == [
        ("INSTRUCTION", "rules"), ("MESSAGE_TEXT", "hi"), ("NAME", "bob"), ("REFUSAL", "no"), ("TOOL_NAME", "f"), ("TOOL_ARGUMENTS", "{}"),
        ("TOOL_RESULT", "out"), ("TOOL_NAME", "f"), ("TOOL_DESCRIPTION", "does"), ("TOOL_NAME", "f"), ("SCHEMA_NAME", "n"), ("SCHEMA_TEXT", "d"),
    ]
    assert [x.gap_kind for x in chat.inspection_gaps(r, ["k"]).collect()] == ["IMAGE"]


def test_schema_text(spark):
    s = {"title": "T", "properties": {"a": {"description": "D", "enum": ["x"]}, "title": {"type": "string"}}, "items": {"const": "K", "type": "object"}}
    df = spark.createDataFrame([(1, json.dumps(s))], "k int, j string").select("k", F.parse_json("j").alias("v"))
    got = sorted((r.kind, r.text) for r in chat.schema_text(df, ["k"], "v").collect())
    assert got == [("PROPERTY_NAME", "a"), ("PROPERTY_NAME", "title"), ("SCHEMA_TEXT", "D"), ("SCHEMA_TEXT", "K"), ("SCHEMA_TEXT", "T"), ("SCHEMA_TEXT", "x")]


def test_stream_errors(spark):
    rows = [(1, "data: {}\n\ndata: [DONE]\n\n"), (2, "data: {}\n\n"), (3, "data: [DONE]\n\ndata: {}\n\n"), (4, "data: [DONE]\n\ndata: [DONE]\n\n"), (5, "event: error\ndata: {}\n\n"), (6, "data: {\n\n"), (7, ": c\ndata: {\ndata: }\n\ndata: [DONE]\n\n")]
    out = chat.validate_streams(chat.scan_sse(spark.createDataFrame(rows, "k int, body string"), ["k"]), ["k"])
    got = {r.k: r.error_code for r in out.collect()}
    assert got == {1: None, 2: "MISSING_TERMINAL", 3: "EVENT_AFTER_TERMINAL", 4: "DUPLICATE_TERMINAL", 5: "ERROR_EVENT", 6: "MALFORMED_EVENT", 7: None}


def test_long_lists_of_forbidden_values_are_searched_inside_lines(spark):
    values = [(1, "password="), (2, "AKIA"), (3, "| "), (4, "a-b/c"), *((k, f"none{k}") for k in range(5, 40))]
    lines = [(1, "x password=1"), (2, "AKIA123 | y"), (3, "xa-b/cx"), (4, "clean"), (5, None)]
    ldf, vdf = spark.createDataFrame(lines, "n int, line string"), spark.createDataFrame(values, "value_id int, value string")
    want = sorted((n, k) for n, t in lines for k, v in values if t and v in t)
    for limit in (7, 10_000):
        assert sorted((r.n, r.value_id) for r in audit.scan_leaks(ldf, vdf, limit=limit).collect()) == want


def test_leaks_are_what_contains_says(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé.*\n😀 ") for _ in range(n))
    lines = [(k, word(rng.randrange(0, 60))) for k in range(60)] + [(100, None), (101, ""), (102, "x" * 5000 + "needle" * 3), (102, "x" * 5000 + "needle" * 3)]
    values = [(k, word(rng.randrange(0, 12))) for k in range(80)] + [(200, lines[3][1]), (201, "xxxxxxneedle"), (201, "xxxxxxneedle"), (202, ""), (203, None), (204, "needle")]
    want = sorted((a, v) for a, t in lines if t is not None for v, x in values if x is not None and x in t)
    df = spark.createDataFrame(lines, "k int, line string")
    got = audit.scan_leaks(df, spark.createDataFrame(values, "value_id int, value string"), limit=7)
    assert sorted((r.k, r.value_id) for r in got.collect()) == want
    assert audit.scan_leaks(df, spark.createDataFrame([], "value_id int, value string")).collect() == []
    assert audit.scan_leaks(df.where("false"), spark.createDataFrame(values, "value_id int, value string")).collect() == []


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_many_values_meet_lines_by_their_gram(spark, monkeypatch, limit):
    values = spark.range(200_000).select(F.col("id").alias("value_id"), F.concat(F.lit("key-"), F.md5(F.col("id").cast("string"))).alias("value"))
    monkeypatch.setattr(audit, "INDEX_BYTES", limit)
    lines = spark.range(500).select("id", F.concat(F.lit("so the key-"), F.md5((F.col("id") * 500).cast("string")), F.lit(" was shown")).alias("line"))
    out = audit.scan_leaks(lines, values)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.value_id) for r in out.collect()) == [(k, 500 * k) for k in range(400)]
    assert "CartesianProduct" not in plan


def smallest_on_a_cycle(edges):
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    while True:
        more = {a: r | {c for b in r for c in reach.get(b, ())} for a, r in reach.items()}
        if more == reach:
            return min((a for a, r in reach.items() if a in r), default=None)
        reach = more


def cycle_of(spark, edges):
    by = {}
    for a, b in edges:
        by.setdefault(a, []).append(b)
    df = spark.createDataFrame([(a, b) for a, b in by.items()] + [("none", None), (None, ["x"])], "policy_id string, overrides array<string>")
    got = policy.override_cycles(df).collect()
    return got[0].policy_id if got else None


@pytest.mark.parametrize("seed", range(2))
def test_cycles_of_random_overrides(spark, seed):
    rng, n = random.Random(seed), 14
    edges = sorted({(f"p{rng.randrange(n):02}", f"p{rng.randrange(n):02}") for _ in range((14, 24)[seed])})
    assert cycle_of(spark, edges) == smallest_on_a_cycle(edges)


def test_cycles_behind_trees_and_between_components(spark):
    two = [("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("a", "b"), ("f", "z")]
    assert cycle_of(spark, two) == "b"
    eights = [("m", "n"), ("n", "m"), ("n", "k"), ("k", "n"), ("k", "o"), ("o", "k"), ("a", "k"), ("o", "a2")]
    assert cycle_of(spark, eights) == "k"


def test_a_long_chain_of_overrides_takes_linear_space(spark):
    chain = spark.range(2000).select(F.format_string("p%06d", "id").alias("policy_id"), F.array(F.format_string("p%06d", F.col("id") + 1)).alias("overrides"))
    ring = chain.union(spark.createDataFrame([("p002000", ["p000777"])], "policy_id string, overrides array<string>"))
    assert [r.policy_id for r in policy.override_cycles(ring).collect()] == ["p000777"]
