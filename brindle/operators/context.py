"""Policy contexts from logs: canonical URLs, identities, token claims, pseudonyms and headers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"\A[A-Za-z0-9][A-Za-z0-9._:@/\-]{0,127}\z"


def ipv6_text(address: Column) -> Column:
    """The canonical text of an IPv6 address: eight units without leading zeros, the first longest run of zeros as ::."""
    four = F.regexp_extract(address, r"(?<=:)([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)\z", 0)
    b = F.transform(F.split(four, r"\."), lambda x: x.cast("int"))
    tail = F.concat_ws(":", F.lower(F.hex(F.element_at(b, 1) * 256 + F.element_at(b, 2))), F.lower(F.hex(F.element_at(b, 3) * 256 + F.element_at(b, 4))))
    plain = F.when(four != "", F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(four)), tail)).otherwise(address)
    sides = F.split(F.lower(plain), "::")
    units = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda u: u != "")
    left, right = units(F.element_at(sides, 1)), units(F.try_element_at(sides, F.lit(2)))
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.concat(left, F.when(F.size(sides) > 1, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), right)
    short = F.transform(full, lambda u: F.regexp_replace(u, r"\A0+(?=.)", ""))
    text = F.array_join(short, ":")
    best = None
    for n in range(8, 1, -1):
        zeros = ":".join(["0"] * n)
        at = rf"(?:\A|(?<=:)){zeros}(?:\z|(?=:))"
        here = F.when(text.rlike(at), F.regexp_replace(F.regexp_replace(F.concat(F.lit("|"), text, F.lit("|")), rf"\A(.*?)(?:(?<=\|)|:){zeros}(?=:|\|)(.*)\z", r"$1::$2"), r"\|", ""))
        best = here if best is None else F.coalesce(best, here)
    return F.regexp_replace(F.coalesce(best, text), ":{3,}", "::")


def remove_dot_segments(path: Column) -> Column:
    """A path without . and .. segments; repeated and trailing slashes stay."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda acc, s: F.when(s == ".", acc).when(
        s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    ).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def _percent(path: Column) -> Column:
    """Escapes in upper case; escaped unreserved characters as themselves."""
    pieces = F.split(path, "(?=%[0-9A-Fa-f]{2})")
    one = lambda p: F.when(
        p.rlike("^%[0-9A-Fa-f]{2}"),
        F.concat(
            F.when(F.decode(F.unhex(F.substring(p, 2, 2)), "US-ASCII").rlike(r"^[A-Za-z0-9._~\-]$"), F.decode(F.unhex(F.substring(p, 2, 2)), "US-ASCII"))
            .otherwise(F.upper(F.substring(p, 1, 3))),
            F.substring(p, F.lit(4), F.length(p)),
        ),
    ).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")


def canonical_urls(df: DataFrame, url: str = "url", to: str = "canonical_url") -> DataFrame:
    """df with the canonical URL, null for what is not http or https: lower-case scheme and host without final dot, no
    default port, user, query or fragment, escapes and dot segments normalised. Hosts outside ASCII are converted
    by IDNA-2003 in Arrow batches; other rows stay in the JVM."""

    @F.arrow_udf("string")
    def ascii_host(hosts: pa.Array) -> pa.Array:
        def one(h):
            try:
                return h.encode("idna").decode() if h is not None else None
            except UnicodeError:
                return None

        return pa.array([one(h) for h in hosts.to_pylist()], pa.string())

    u = F.trim(F.col(url))
    pattern = r"(?i)\A(https?)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)"
    part = lambda k: F.regexp_extract(u, pattern, k)
    out = df.withColumn("_host", F.lower(F.regexp_replace(part(2), r"\.\z", "")))
    odd = out["_host"].rlike(r"[^\x00-\x7F]")
    out = out.withColumn("_idn", F.when(odd, F.col("_host"))).withColumn("_idn", ascii_host("_idn"))
    host = F.when(odd, F.col("_idn")).when(F.col("_host").startswith("["), F.concat(F.lit("["), ipv6_text(F.regexp_replace("_host", r"[\[\]]", "")), F.lit("]"))).otherwise(F.col("_host"))
    scheme, port = F.lower(part(1)), part(3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(part(4) == "", "/").otherwise(remove_dot_segments(_percent(part(4))))
    good = u.rlike(pattern) & (part(2) != "") & host.isNotNull()
    value = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path)
    return out.withColumn(to, F.when(good, value)).drop("_host", "_idn")


def effective_url(base: Column, path: Column) -> Column:
    """A configured base and an inbound path, joined by one slash."""
    left = F.regexp_replace(base, r"/+\z", "")
    return F.concat(left, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def normalize_identity(df: DataFrame, user: str = "user", groups: str = "groups") -> DataFrame:
    """df with user and groups in lower case and identity_code: INVALID_USER, INVALID_GROUP, DUPLICATE_GROUP,
    TOO_MANY_GROUPS or null."""
    g = F.coalesce(F.col(groups), F.array().cast("array<string>"))
    low = F.array_sort(F.transform(g, lambda x: F.lower(x)))
    code = (
        F.when(F.col(user).isNotNull() & ~F.col(user).rlike(TOKEN), "INVALID_USER")
        .when(F.exists(g, lambda x: ~x.rlike(TOKEN)), "INVALID_GROUP")
        .when(F.size(F.array_distinct(low)) < F.size(low), "DUPLICATE_GROUP")
        .when(F.size(low) > 128, "TOO_MANY_GROUPS")
    )
    return df.withColumn("identity_code", code).withColumn(user, F.lower(user)).withColumn(groups, low)


def assemble_contexts(df: DataFrame) -> DataFrame:
    """df (canonical_url, model, phase, identity_code) with context_code: the first failing rule, or null."""
    code = (
        F.when(F.col("canonical_url").isNull(), "INVALID_URL")
        .when(F.coalesce(F.trim("model"), F.lit("")) == "", "MISSING_MODEL")
        .when(~F.col("phase").isin("REQUEST", "RESPONSE"), "INVALID_PHASE")
        .otherwise(F.col("identity_code"))
    )
    return df.withColumn("context_code", code)


def response_contexts(responses: DataFrame, requests: DataFrame, key: str = "exchange_id") -> DataFrame:
    """Responses with the context of their exchange's request, phase RESPONSE, and handoff_code: MISSING_REQUEST or
    DUPLICATE_REQUEST."""
    one = requests.groupBy(key).agg(F.count("*").alias("_n"), F.min_by(F.struct("url", "model", "user", "groups"), "url").alias("_c"))
    out = responses.join(one, key, "left")
    code = F.when(F.col("_n").isNull(), "MISSING_REQUEST").when(F.col("_n") > 1, "DUPLICATE_REQUEST")
    return out.select(*responses.columns, "_c.*", F.lit("RESPONSE").alias("phase"), code.alias("handoff_code"))


def claims_from_tokens(df: DataFrame, token: str, issuer: str, audience: str, now: Column, skew: int = 0) -> DataFrame:
    """df with sub, groups and claims_code of a token's payload (its signature is not checked): MALFORMED, ISSUER,
    AUDIENCE, EXPIRED, NOT_YET_VALID, SUBJECT or null."""
    parts = F.split(F.col(token), r"\.")
    body = F.translate(F.try_element_at(parts, F.lit(2)), "-_", "+/")
    body = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    raw = F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8")
    v = F.try_parse_json(raw)
    get = lambda p, t: F.try_variant_get(v, p, t)
    aud = F.coalesce(get("$.aud", "array<string>"), F.array(get("$.aud", "string")))
    code = (
        F.when((F.size(parts) != 3) | v.isNull(), "MALFORMED")
        .when(F.coalesce(get("$.iss", "string") != issuer, F.lit(True)), "ISSUER")
        .when(~F.coalesce(F.array_contains(aud, audience), F.lit(False)), "AUDIENCE")
        .when(F.coalesce(get("$.exp", "bigint") + skew <= now, F.lit(True)), "EXPIRED")
        .when(F.coalesce(get("$.nbf", "bigint") - skew > now, F.lit(False)), "NOT_YET_VALID")
        .when(F.coalesce(get("$.sub", "string"), F.lit("")) == "", "SUBJECT")
    )
    out = df.withColumn("claims_code", code)
    ok = F.col("claims_code").isNull()
    return out.withColumn("sub", F.when(ok, get("$.sub", "string"))).withColumn("groups", F.when(ok, get("$.groups", "array<string>")))


def pseudonym(column: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex; the pads come from the key on the driver."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in pad).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, column.cast("binary")), 256))), 256)


def pseudonymise(df: DataFrame, column: str, key: bytes, to: str) -> DataFrame:
    """df with HMAC-SHA256 of a column in hex. The pads made of the key come from a table of one row, so neither plans nor
    event logs show them (pseudonym, for a key that may be seen, writes them into the plan)."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = key.ljust(64, b"\0")
    row = [tuple(bytearray(b ^ x for b in pad) for x in (0x36, 0x5C))]
    pads = df.sparkSession.createDataFrame(row, "_inner binary, _outer binary")
    inner = F.unhex(F.sha2(F.concat("_inner", F.col(column).cast("binary")), 256))
    return df.join(F.broadcast(pads)).withColumn(to, F.sha2(F.concat("_outer", inner), 256)).drop("_inner", "_outer")


def derive_correlation(df: DataFrame, session: str = "session_id", trace: str = "trace_id", path: str = "path") -> DataFrame:
    """df with session_id (kept if 1 to 256 visible ASCII characters, else new), session_generated, trace_replaced and
    path without its query."""
    ok = F.coalesce(F.col(session).rlike(r"\A[\x21-\x7E]{1,256}\z"), F.lit(False))
    good = F.coalesce(F.col(trace).rlike(r"\A(?!0{32})[0-9a-f]{32}\z"), F.lit(False))
    out = df.withColumn("session_generated", ~ok).withColumn("trace_replaced", F.col(trace).isNotNull() & ~good)
    return out.withColumn(session, F.when(ok, F.col(session)).otherwise(F.expr("uuid()"))).withColumn(path, F.substring_index(path, "?", 1))


def classify_auth(headers: Column) -> Column:
    """MISSING, DUPLICATE, MALFORMED, OTHER_SCHEME or BEARER of the authorization headers of a request."""
    h = F.element_at(headers, 1)
    return (
        F.when(F.coalesce(F.size(headers), F.lit(0)) <= 0, "MISSING")
        .when(F.size(headers) > 1, "DUPLICATE")
        .when(h.rlike(r"(?i)\Abearer +[A-Za-z0-9._~+/\-]+=*\z"), "BEARER")
        .when(h.rlike(r"(?i)\Abearer(?: |\z)"), "MALFORMED")
        .when(h.rlike(r"\A[A-Za-z0-9\-]+ "), "OTHER_SCHEME")
        .otherwise("MALFORMED")
    )


#: Headers that end at each hop, and those that a changed body makes wrong (fixed values).
HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
BODY_HEADERS = ("etag", "digest", "content-md5", "content-digest", "repr-digest")


def clean_headers(headers: Column, masked: Column, size: Column) -> Column:
    """A header map without hop-by-hop headers and those that Connection names; for masked bodies without digests and
    with the new length."""
    low = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    named = F.transform(F.split(F.lower(F.coalesce(F.try_element_at(low, F.lit("connection")), F.lit(""))), ","), lambda x: F.trim(x))
    kept = F.map_filter(low, lambda k, v: ~k.isin(*HOP_HEADERS) & ~F.array_contains(named, k))
    new = F.map_filter(kept, lambda k, v: ~k.isin(*BODY_HEADERS, "content-length"))
    return F.when(masked, F.map_concat(new, F.create_map(F.lit("content-length"), size.cast("string")))).otherwise(kept)
