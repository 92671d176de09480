"""Chat traffic: requests and responses to text fragments, SSE transcripts to deltas and back to fields."""

from __future__ import annotations

from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.tables import saved

#: Roles that instruct, and the part types that cannot be inspected as text (fixed values).
INSTRUCTION_ROLES = ("system", "developer")
GAP_PARTS = {"image_url": "IMAGE", "input_audio": "AUDIO", "file": "FILE"}
FRAGMENTS = "array<struct<rank:int,kind:string,field_class:string,role:string,locator:string,text:string>>"
MAX_FRAGMENTS = 16_384

#: The fields of a message that are read; others are ignored. Contents may be a text or an array of parts.
MESSAGE = (
    "struct<role:string,name:string,content:variant,refusal:string,reasoning_content:string,reasoning:struct<content:string,summary:string,text:string,encrypted_content:string>,"
    "tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>,function_call:struct<name:string,arguments:string>,"
    "audio:struct<id:string,transcript:string,data:string>>"
)
FUNCTION = "struct<name:string,description:string,parameters:variant>"
CUSTOM = "struct<name:string,description:string,format:struct<type:string,grammar:struct<syntax:string,definition:string>>>"
TOOL = f"array<struct<type:string,function:{FUNCTION},custom:{CUSTOM}>>"
NAMED = "array<struct<type:string,function:struct<name:string>,custom:struct<name:string>>>"
REQUEST = (
    f"struct<model:string,messages:array<{MESSAGE}>,tools:{TOOL},functions:array<{FUNCTION}>,allowed_tools:struct<tools:{NAMED}>,"
    "tool_choice:variant,function_call:variant,prediction:struct<type:string,content:variant>,"
    "response_format:struct<type:string,json_schema:struct<name:string,description:string,schema:variant>>,"
    "web_search_options:struct<user_location:struct<approximate:struct<city:string,country:string,region:string,timezone:string>>>>"
)
RESPONSE = f"struct<model:string,choices:array<struct<index:int,message:{MESSAGE}>>>"
PARTS = "array<struct<type:string,text:string,refusal:string>>"


def parse_bodies(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """df with doc (the known fields of a JSON body) and reject: AMBIGUOUS_CONTENT for duplicate keys,
    MALFORMED_MESSAGE for what is not a JSON object."""
    # A body is parsed once: a filter on reject does not pass the generator, so the parsed value is not computed for it anew.
    out = df.select("*", F.inline_outer(F.array(F.struct(F.try_parse_json(F.col(body)).alias("_v")))))
    loose = F.from_json(F.col(body), "map<string,string>")
    reject = F.when(F.col("_v").isNull(), F.when(loose.isNotNull(), "AMBIGUOUS_CONTENT").otherwise("MALFORMED_MESSAGE")).when(
        ~F.ltrim(F.col(body), F.lit(" \t\r\n")).startswith("{"), "MALFORMED_MESSAGE"
    )
    out = out.withColumn("reject", reject)
    doc = F.when(F.col("reject").isNull(), F.try_variant_get("_v", "$", schema))
    return out.select(*df.columns, "reject", F.inline_outer(F.array(F.struct(doc.alias("doc")))))


def scan_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Requests parsed, with reject UNSUPPORTED_SCHEMA where messages are missing or empty."""
    out = parse_bodies(df, REQUEST, body)
    missing = F.col("reject").isNull() & (F.col("doc.messages").isNull() | (F.size("doc.messages") == 0))
    return out.withColumn("reject", F.when(missing, "UNSUPPORTED_SCHEMA").otherwise(F.col("reject")))


def scan_responses(df: DataFrame, body: str = "body") -> DataFrame:
    out = parse_bodies(df, RESPONSE, body)
    missing = F.col("reject").isNull() & F.col("doc.choices").isNull()
    return out.withColumn("reject", F.when(missing, "UNSUPPORTED_SCHEMA").otherwise(F.col("reject")))


def _one(rank: int, kind, klass: str, role: Column, locator: Column, text: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.array(F.struct(
        F.lit(rank).alias("rank"), kind.alias("kind"), F.lit(klass).alias("field_class"), role.alias("role"),
        locator.alias("locator"), text.alias("text"),
    ))


def semantic_kind(role: Column) -> Column:
    return F.when(role.isin(*INSTRUCTION_ROLES), "INSTRUCTION").when(role.isin("tool", "function"), "TOOL_RESULT").otherwise("MESSAGE_TEXT")


def _message(m: Column, at: Column) -> Column:
    """Fragments of a message in a fixed order of fields: content, refusal, name, reasoning, calls."""
    role = F.coalesce(m["role"], F.lit("assistant"))
    put = lambda rank, kind, klass, path, text: _one(rank, kind, klass, role, F.concat(at, F.lit(path)), text)
    kind = semantic_kind(role)
    parts = F.try_variant_get(m["content"], "$", PARTS)
    plain = F.when(parts.isNull(), F.try_variant_get(m["content"], "$", "string"))
    from_parts = F.flatten(F.transform(F.coalesce(parts, F.array().cast(PARTS)), lambda p, k: F.concat(
        _one(1, kind, "FREE_TEXT", role, F.concat(at, F.lit("/content/"), k.cast("string"), F.lit("/text")), F.when(p["type"] == "text", p["text"])),
        _one(1, "REFUSAL", "FREE_TEXT", role, F.concat(at, F.lit("/content/"), k.cast("string"), F.lit("/refusal")), F.when(p["type"] == "refusal", p["refusal"])),
    )))
    call_type = "array<struct<id:string,function:struct<name:string,arguments:string>>>"
    calls = F.flatten(F.transform(F.coalesce(m["tool_calls"], F.array().cast(call_type)), lambda c, k: F.concat(
        _one(6, "TOOL_NAME", "STRUCTURAL", role, F.concat(at, F.lit("/tool_calls/"), k.cast("string"), F.lit("/function/name")), c["function"]["name"]),
        _one(6, "TOOL_ARGUMENTS", "STRUCTURAL", role, F.concat(at, F.lit("/tool_calls/"), k.cast("string"), F.lit("/function/arguments")), c["function"]["arguments"]),
    )))
    return F.concat(
        put(0, kind, "FREE_TEXT", "/content", plain), from_parts, put(2, "REFUSAL", "FREE_TEXT", "/refusal", m["refusal"]),
        put(3, "NAME", "STRUCTURAL", "/name", m["name"]), put(4, "REASONING", "FREE_TEXT", "/reasoning_content", m["reasoning_content"]),
        put(5, "REASONING", "FREE_TEXT", "/reasoning/content", m["reasoning"]["content"]),
        put(5, "REASONING", "FREE_TEXT", "/reasoning/summary", m["reasoning"]["summary"]),
        put(5, "REASONING", "FREE_TEXT", "/reasoning/text", m["reasoning"]["text"]), calls,
        put(7, "TOOL_NAME", "STRUCTURAL", "/function_call/name", m["function_call"]["name"]),
        put(7, "TOOL_ARGUMENTS", "STRUCTURAL", "/function_call/arguments", m["function_call"]["arguments"]),
        put(8, "MESSAGE_TEXT", "FREE_TEXT", "/audio/transcript", m["audio"]["transcript"]),
    ).cast(FRAGMENTS)


def _numbered(df: DataFrame, keys: list[str], fragments: Column) -> DataFrame:
    found = F.filter(fragments, lambda f: f["text"].isNotNull() & (f["text"] != ""))
    # the outer form: before the inner one Spark puts a filter that computes all fragments once more
    out = df.select(*keys, F.posexplode_outer(found).alias("ordinal", "f")).where("f is not null")
    return out.select(*keys, "ordinal", "f.kind", "f.field_class", "f.role", "f.locator", "f.text")


def fragments_from_requests(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments of accepted requests: (keys, ordinal, kind, field_class, role, locator, text).

    Order: messages by index, their fields in a fixed order, then tools, functions, choices, allowed tools, prediction,
    response format and web-search location. (Objects of a VARIANT are sorted by key, so the order of fields in the
    source is not kept.) Texts inside JSON schemas come from schema_fragments; request_fragments has both.
    """
    d = scanned.where("reject is null")
    doc = F.col("doc")
    none = F.lit(None).cast("string")
    messages = F.flatten(F.transform(doc["messages"], lambda m, k: _message(m, F.concat(F.lit("/messages/"), k.cast("string")))))
    at = lambda base, k, path: F.concat(F.lit(base), k.cast("string"), F.lit(path))
    name = lambda rank, locator, text: _one(rank, "TOOL_NAME", "STRUCTURAL", none, locator, text)
    about = lambda rank, locator, text: _one(rank, "TOOL_DESCRIPTION", "FREE_TEXT", none, locator, text)
    tools = F.flatten(F.transform(F.coalesce(doc["tools"], F.array().cast(TOOL)), lambda t, k: F.concat(
        name(10, at("/tools/", k, "/function/name"), t["function"]["name"]), about(10, at("/tools/", k, "/function/description"), t["function"]["description"]),
        name(10, at("/tools/", k, "/custom/name"), t["custom"]["name"]), about(10, at("/tools/", k, "/custom/description"), t["custom"]["description"]),
        _one(10, "SCHEMA_TEXT", "STRUCTURAL", none, at("/tools/", k, "/custom/format/grammar/definition"), t["custom"]["format"]["grammar"]["definition"]),
    )))
    functions = F.flatten(F.transform(F.coalesce(doc["functions"], F.array().cast(f"array<{FUNCTION}>")), lambda t, k: F.concat(
        name(11, at("/functions/", k, "/name"), t["name"]), about(11, at("/functions/", k, "/description"), t["description"]),
    )))
    choice = lambda path: F.try_variant_get(doc["tool_choice"], f"$.{path}.name", "string")
    called = F.try_variant_get(doc["function_call"], "$.name", "string")
    allowed = F.flatten(F.transform(F.coalesce(doc["allowed_tools"]["tools"], F.array().cast(NAMED)), lambda t, k: F.concat(
        name(13, at("/allowed_tools/tools/", k, "/function/name"), t["function"]["name"]), name(13, at("/allowed_tools/tools/", k, "/custom/name"), t["custom"]["name"]),
    )))
    predicted = F.try_variant_get(doc["prediction"]["content"], "$", PARTS)
    whole = F.when(predicted.isNull(), F.try_variant_get(doc["prediction"]["content"], "$", "string"))
    pieces = F.flatten(F.transform(F.coalesce(predicted, F.array().cast(PARTS)), lambda t, k: _one(
        14, "PREDICTION", "FREE_TEXT", none, at("/prediction/content/", k, "/text"), F.when(t["type"] == "text", t["text"]))))
    form = doc["response_format"]["json_schema"]
    place = doc["web_search_options"]["user_location"]["approximate"]
    rest = F.concat(
        name(12, F.lit("/tool_choice/function/name"), choice("function")), name(12, F.lit("/tool_choice/custom/name"), choice("custom")),
        name(12, F.lit("/function_call/name"), called), allowed, _one(14, "PREDICTION", "FREE_TEXT", none, F.lit("/prediction/content"), whole), pieces,
        _one(15, "SCHEMA_NAME", "STRUCTURAL", none, F.lit("/response_format/json_schema/name"), form["name"]),
        _one(15, "SCHEMA_TEXT", "FREE_TEXT", none, F.lit("/response_format/json_schema/description"), form["description"]),
        *[_one(16, "LOCATION", "STRUCTURAL", none, F.lit(f"/web_search_options/user_location/approximate/{n}"), place[n]) for n in ("city", "country", "region", "timezone")],
    )
    return _numbered(d, keys, F.concat(messages, tools.cast(FRAGMENTS), functions.cast(FRAGMENTS), rest.cast(FRAGMENTS)))


def request_schemas(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base, schema) of the JSON schemas of accepted requests: parameters of tools and functions, response format."""
    doc = F.col("doc")
    one = lambda base, schema: F.struct(base.alias("base"), schema.alias("schema"))
    at = lambda base, k, path: F.concat(F.lit(base), k.cast("string"), F.lit(path))
    found = F.concat(
        F.transform(F.coalesce(doc["tools"], F.array().cast(TOOL)), lambda t, k: one(at("/tools/", k, "/function/parameters"), t["function"]["parameters"])),
        F.transform(F.coalesce(doc["functions"], F.array().cast(f"array<{FUNCTION}>")), lambda t, k: one(at("/functions/", k, "/parameters"), t["parameters"])),
        F.array(one(F.lit("/response_format/json_schema/schema"), doc["response_format"]["json_schema"]["schema"])),
    )
    return scanned.where("reject is null").select(*keys, F.inline(found)).where("schema is not null")


def schema_fragments(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, field_class, role, locator, text) of the texts inside the schemas of requests."""
    texts = schema_text(request_schemas(scanned, keys), [*keys, "base"], "schema")
    kind = F.when(F.col("kind") == "PROPERTY_NAME", "SCHEMA_NAME").otherwise("SCHEMA_TEXT")
    return texts.where("text <> ''").select(
        *keys, kind.alias("kind"), F.lit("STRUCTURAL").alias("field_class"), F.lit(None).cast("string").alias("role"), F.concat("base", "path").alias("locator"), "text"
    )


def request_fragments(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """All fragments of accepted requests: those of fragments_from_requests, then those of their schemas by locator."""
    rest = schema_fragments(scanned, keys).withColumn("ordinal", F.lit(MAX_FRAGMENTS * 4))
    both = fragments_from_requests(scanned, keys).unionByName(rest)
    w = W.partitionBy(*keys).orderBy("ordinal", "locator", "kind", "text")
    return both.withColumn("ordinal", F.row_number().over(w) - 1)


def schema_references(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with a $ref that is not local to its schema: (keys, reject)."""
    found = request_schemas(scanned, keys).where(F.to_json("schema").contains('"$ref"'))
    refs = schema_text(found, [*keys, "base"], "schema", ("$ref",), ())
    bad = refs.where((F.col("kind") == "SCHEMA_TEXT") & ~F.col("text").rlike(r"\A#(?:/|\z)"))
    return bad.select(*keys).distinct().withColumn("reject", F.lit("UNSUPPORTED_SCHEMA"))


def fragments_from_responses(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments of accepted responses, choice by choice."""
    d = scanned.where("reject is null")
    found = F.flatten(F.transform(F.col("doc.choices"), lambda c, k: _message(c["message"], F.concat(F.lit("/choices/"), k.cast("string"), F.lit("/message")))))
    return _numbered(d, keys, found)


def inspection_gaps(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap_kind, locator) of what a request holds besides text: image, audio and file parts, audio of earlier
    answers given by id (OPAQUE_AUDIO_REFERENCE) and encrypted reasoning (OPAQUE_REASONING)."""
    d = scanned.where("reject is null").select(*keys, F.posexplode("doc.messages").alias("m", "message"))
    parts = d.select(*keys, "m", F.posexplode(F.try_variant_get("message.content", "$", "array<struct<type:string>>")).alias("p", "part"))
    pairs = [F.lit(x) for k, v in GAP_PARTS.items() for x in (k, v)]
    kind = F.try_element_at(F.create_map(*pairs), F.col("part.type"))
    out = parts.select(*keys, kind.alias("gap_kind"), F.format_string("/messages/%d/content/%d", "m", "p").alias("locator"))
    return out.where("gap_kind is not null").union(_message_gaps(d, keys, "/messages/%d", {"audio.id": ("OPAQUE_AUDIO_REFERENCE", "/audio")}))


def _message_gaps(messages: DataFrame, keys: list[str], base: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Gaps of fields of messages (keys, m, message), encrypted reasoning included."""
    gaps = [
        F.when(F.col(f"message.{f}").isNotNull(), F.struct(F.lit(kind).alias("gap_kind"), F.format_string(base + path, "m").alias("locator")))
        for f, (kind, path) in {**fields, "reasoning.encrypted_content": ("OPAQUE_REASONING", "/reasoning/encrypted_content")}.items()
    ]
    return messages.select(*keys, F.inline(F.array_compact(F.array(*gaps))))


def response_gaps(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap_kind, locator) of what a response holds besides text: audio and encrypted reasoning."""
    d = scanned.where("reject is null").select(*keys, F.posexplode("doc.choices.message").alias("m", "message"))
    return _message_gaps(d, keys, "/choices/%d/message", {"audio.data": ("AUDIO", "/audio")})


def coverage(messages: DataFrame, fragments: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_fragments, n_gaps, coverage): FULLY, PARTIALLY or UNINSPECTABLE."""
    f = fragments.groupBy(*keys).agg(F.count("*").alias("n_fragments"))
    g = gaps.groupBy(*keys).agg(F.count("*").alias("n_gaps"))
    out = messages.select(*keys).join(f, keys, "left").join(g, keys, "left").na.fill(0, ["n_fragments", "n_gaps"])
    state = F.when(F.col("n_gaps") == 0, "FULLY").when(F.col("n_fragments") > 0, "PARTIALLY").otherwise("UNINSPECTABLE")
    return out.withColumn("coverage", state)


def check_fragments(fragments: DataFrame, keys: list[str], limit: int = MAX_FRAGMENTS) -> DataFrame:
    """Requests with more fragments than the limit: (keys, reject)."""
    n = fragments.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return n.select(*keys, F.lit("UNSUPPORTED_SCHEMA").alias("reject"))


#: Keywords of JSON Schema whose strings are text (fixed values).
SCHEMA_TEXT = ("title", "description", "const", "default", "pattern", "$comment")
SCHEMA_LISTS = ("enum", "examples")


def schema_text(df: DataFrame, keys: list[str], schema: str, words: tuple = SCHEMA_TEXT, lists: tuple = SCHEMA_LISTS, depth: int = 128) -> DataFrame:
    """(keys, path, kind, text) of the texts inside a JSON schema (VARIANT): titles, descriptions, constants, listed
    values and names of properties. One level a round, written to the shared folder, until a level has no container."""
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.lit("").alias("key"), F.lit("").alias("above"), F.col(schema).alias("v"))
    found = None
    for _ in range(depth):
        inside = level.withColumnsRenamed({"path": "_path", "key": "_key"}).drop("above")
        step = inside.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "value"))
        name = F.coalesce("name", F.col("pos").cast("string"))
        step = step.select(*keys, F.concat("_path", F.lit("/"), name).alias("path"), F.coalesce("name", "_key").alias("key"), F.col("_key").alias("above"), F.col("value").alias("v"))
        step = saved(step, "schema")
        value = F.try_variant_get("v", "$", "string")
        kind = F.schema_of_variant("v")
        name = step.where("above = 'properties'").select(*keys, "path", F.lit("PROPERTY_NAME").alias("kind"), F.col("key").alias("text"))
        texts = step.where((kind == "STRING") & F.col("key").isin(*words, *lists) & (F.col("above") != "properties"))
        rows = texts.select(*keys, "path", F.lit("SCHEMA_TEXT").alias("kind"), value.alias("text")).union(name)
        found = rows if found is None else found.union(rows)
        level = step.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if level.isEmpty():
            return found
    raise ValueError(f"a schema is deeper than {depth} levels")


# ------------------------------------------------------------------ SSE


def scan_sse(df: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Events of SSE transcripts: (keys, event_seq, event, data). Blank lines part events, data lines join by \\n,
    comments and unknown fields are dropped."""
    frames = df.select(*keys, F.posexplode(F.split(F.col(body), r"\r?\n\r?\n", -1)).alias("event_seq", "frame")).where("frame <> ''")
    lines = F.split("frame", r"\r?\n", -1)
    value = lambda name: F.transform(
        F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, rf"\A{name}: ?", "")
    )
    data = value("data")
    out = frames.withColumn("event", F.try_element_at(value("event"), F.lit(-1))).withColumn("data", F.when(F.size(data) > 0, F.array_join(data, "\n")))
    return out.select(*keys, "event_seq", "event", "data").where("data is not null or event is not null")


DELTA = (
    "struct<choices:array<struct<index:int,delta:struct<content:string,refusal:string,reasoning_content:string,"
    "tool_calls:array<struct<index:int,function:struct<name:string,arguments:string>>>,function_call:struct<name:string,arguments:string>>>>>"
)


def sse_deltas(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_seq, seq, choice, kind, field_path, delta): the string deltas of the events' chunks, in order."""
    doc = F.try_variant_get(F.try_parse_json("data"), "$", DELTA)
    d = events.where("data <> '[DONE]'").select(*keys, "event_seq", F.explode(doc["choices"]).alias("c"))
    delta = F.col("c.delta")
    one = lambda kind, path, text: F.array(F.struct(F.lit(kind).alias("kind"), path.alias("field_path"), text.alias("delta")))
    calls = F.flatten(F.transform(F.coalesce(delta["tool_calls"], F.array().cast("array<struct<index:int,function:struct<name:string,arguments:string>>>")), lambda t: one(
        "TOOL_ARGUMENTS", F.concat(F.lit("tool_calls/"), t["index"].cast("string"), F.lit("/arguments")), t["function"]["arguments"])))
    fields = F.concat(
        one("MESSAGE_TEXT", F.lit("content"), delta["content"]), one("REFUSAL", F.lit("refusal"), delta["refusal"]),
        one("REASONING", F.lit("reasoning_content"), delta["reasoning_content"]), calls,
        one("TOOL_ARGUMENTS", F.lit("function_call/arguments"), delta["function_call"]["arguments"]),
    )
    out = d.select(*keys, "event_seq", F.coalesce("c.index", F.lit(0)).alias("choice"), F.posexplode(F.filter(fields, lambda x: x["delta"].isNotNull())).alias("k", "x"))
    seq = (F.col("event_seq").cast("bigint") * 65536 + F.col("k")).alias("seq")
    return out.select(*keys, "event_seq", seq, "choice", "x.kind", "x.field_path", "x.delta")


def reassemble_sse(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of streams: (keys, choice, kind, field_path, first_seq, ordinal, text), in the order of first appearance;
    empty fields are dropped."""
    field = [*keys, "choice", "kind", "field_path"]
    out = deltas.groupBy(*field).agg(
        F.min("seq").alias("first_seq"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("text"),
    ).where("text <> ''")
    return out.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy("first_seq")) - 1)


def validate_streams(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_events, error_code): MISSING_TERMINAL, DUPLICATE_TERMINAL, EVENT_AFTER_TERMINAL, ERROR_EVENT or
    MALFORMED_EVENT; null for a whole stream."""
    done = F.col("data") == "[DONE]"
    bad = (F.col("data") != "[DONE]") & F.try_parse_json("data").isNull()
    n_done = F.count_if(done)
    last = F.max(F.when(done, F.col("event_seq")))
    code = (
        F.when(F.count_if(F.col("event") == "error") > 0, "ERROR_EVENT")
        .when(F.count_if(bad) > 0, "MALFORMED_EVENT")
        .when(n_done == 0, "MISSING_TERMINAL")
        .when(n_done > 1, "DUPLICATE_TERMINAL")
        .when(last < F.max("event_seq"), "EVENT_AFTER_TERMINAL")
    )
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"), code.alias("error_code"))


def _entities(texts: pa.Array, tokens: pa.Array, tags: pa.Array) -> pa.Array:
    """Entities of each row. Tokens are sought one after another, and bytes counted from token to token, so a text is walked
    once. (Seeking from a place on walks the text from its start in SQL, which is quadratic.)"""
    out = []
    for text, words, marks in zip(texts.to_pylist(), tokens.to_pylist(), tags.to_pylist(), strict=True):
        at = byte = 0
        found, inside = [], False
        for w, tag in () if words is None or marks is None else zip_longest(words, marks):
            k = -1 if w is None or text is None else text.find(w, at)
            begin = end = None
            if k >= 0:
                begin = byte + len(text[at:k].encode())
                byte = end = begin + len(w.encode())
                at = k + len(w)
            if tag is None:
                continue
            if tag == "O":
                inside = False
            elif inside and tag.startswith("I-"):
                one = found[-1]
                one["start_utf8"], one["end_utf8"] = (None, None) if end is None or one["end_utf8"] is None else (one["start_utf8"], end)
            else:
                found.append({"type": tag[2:101], "start_utf8": begin, "end_utf8": end})
                inside = True
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("type", pa.string()), ("start_utf8", pa.int64()), ("end_utf8", pa.int64())])))


def bio_to_spans(df: DataFrame, keys: list[str], text: str = "text", tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """Entity spans of BIO-tagged tokens: (keys, type, start_utf8, end_utf8), start null for an entity whose token is
    not found after the one before. Tokens are sought from left to right. Rows stand alone: nothing is shuffled."""
    found = F.arrow_udf(_entities, "array<struct<type:string,start_utf8:bigint,end_utf8:bigint>>")(F.col(text), F.col(tokens), F.col(tags))
    return df.select(*keys, F.inline(found))


def utf8_bounds(df: DataFrame, text: str, start: str, end: str, value: str | None = None) -> DataFrame:
    """df with start_utf8 and end_utf8 of code-point offsets, and slice_ok: whether the slice is the value given."""
    t = F.col(text)
    out = df.withColumn("start_utf8", F.octet_length(F.left(t, F.col(start))).cast("bigint"))
    out = out.withColumn("end_utf8", F.octet_length(F.left(t, F.col(end))).cast("bigint"))
    same = F.substring(t, F.col(start) + 1, F.col(end) - F.col(start)) == F.col(value) if value else F.lit(True)
    return out.withColumn("slice_ok", same)


def route_bodies(df: DataFrame, method: str = "method", path: str = "path", media: str = "media_type", encoding: str = "content_encoding") -> DataFrame:
    """df with route: CHAT_JSON, CHAT_SSE, or BYPASS."""
    kind = F.lower(F.trim(F.substring_index(F.col(media), ";", 1)))
    plain = F.coalesce(F.lower(F.trim(F.col(encoding))), F.lit("identity")).isin("identity", "")
    ours = (F.upper(F.col(method)) == "POST") & (F.col(path) == "/v1/chat/completions") & plain
    route = F.when(ours & (kind == "application/json"), "CHAT_JSON").when(ours & (kind == "text/event-stream"), "CHAT_SSE").otherwise("BYPASS")
    return df.withColumn("route", route)


def check_sizes(df: DataFrame, body: str = "body", declared: str = "declared_length", limit: int = 8 << 20) -> DataFrame:
    """df with size_code: NEGATIVE_LENGTH, TOO_LARGE, LENGTH_MISMATCH or null."""
    size = F.octet_length(F.col(body))
    d = F.col(declared)
    code = F.when(d < 0, "NEGATIVE_LENGTH").when((d > limit) | (size > limit), "TOO_LARGE").when(d != size, "LENGTH_MISMATCH")
    return df.withColumn("size_code", code)
