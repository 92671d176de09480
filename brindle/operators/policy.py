"""Policies: lint, selection with overrides, reactions, and the outcome of messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.tables import saved

POLICY = (
    "policy_id string, version string, enabled boolean, url string, model string, phase string, subject_kind string, "
    "subject string, detectors array<string>, deadline_ms bigint, on_detected string, on_clean string, on_error string, "
    "mask boolean, overrides array<string>"
)


def lint_policies(policies: DataFrame, detectors: list[str]) -> DataFrame:
    """(policy_id, violation): the first broken rule of each policy, by rank; none for sound policies."""
    n = policies.groupBy("policy_id").agg(F.count("*").alias("_n"))
    refs = policies.select("policy_id", F.explode("overrides").alias("ref")).join(
        policies.select(F.col("policy_id").alias("ref")).distinct(), "ref", "left_anti"
    )
    unknown = refs.groupBy("policy_id").agg(F.lit(True).alias("_unknown"))
    p = policies.join(n, "policy_id", "left").join(unknown, "policy_id", "left")
    wild = lambda c: F.contains(F.col(c), F.lit("*")) & (F.col(c) != "*")
    domain = ["ALLOW", "BLOCK"]
    rules = [
        ("BLANK_ID", F.coalesce(F.trim("policy_id") == "", F.lit(True))),
        ("DUPLICATE_ID", F.col("_n") > 1),
        ("NO_DETECTORS", F.coalesce(F.size("detectors"), F.lit(0)) <= 0),
        ("DUPLICATE_DETECTOR", F.size(F.array_distinct("detectors")) < F.size("detectors")),
        ("UNKNOWN_DETECTOR", F.size(F.array_except("detectors", F.array(*map(F.lit, detectors)))) > 0),
        ("SELF_OVERRIDE", F.array_contains("overrides", F.col("policy_id"))),
        ("DUPLICATE_OVERRIDE", F.size(F.array_distinct("overrides")) < F.size("overrides")),
        ("UNKNOWN_OVERRIDE", F.coalesce("_unknown", F.lit(False))),
        ("PARTIAL_WILDCARD", wild("url") | wild("model") | wild("subject")),
        ("UNKNOWN_PHASE", ~F.col("phase").isin("REQUEST", "RESPONSE")),
        ("UNKNOWN_SUBJECT", ~F.col("subject_kind").isin("ANY", "USER", "GROUP")),
        ("UNKNOWN_REACTION", ~(F.col("on_detected").isin(domain) & F.col("on_clean").isin(domain) & F.col("on_error").isin(domain))),
        ("BLOCK_WITH_MASK", F.col("mask") & (F.col("on_detected") == "BLOCK")),
        ("DEADLINE", F.col("deadline_ms") <= 0),
        ("REQUEST_REACTIONS", (F.col("phase") == "REQUEST") & ((F.col("on_clean") != "ALLOW") | (F.col("on_error") != "BLOCK"))),
    ]
    code = reduce(lambda acc, r: acc.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    return p.withColumn("violation", code).where("violation is not null").select("policy_id", "violation").distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has an edge in and whose target has an edge out; others lie on no cycle."""
    ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst", "low")


def _shortened(edges: DataFrame, turn: int) -> DataFrame:
    """Edges without some of the nodes that have one edge in and one out: two edges become one that remembers the smallest
    node between its ends (low). Of neighbours one at most goes, by a coin of the turn, so that paths shrink by a share."""
    one = lambda a, b: edges.groupBy(F.col(a).alias("node")).agg(F.count("*").alias("n"), F.first(b).alias(b)).where("n = 1").drop("n")
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 0
    chain = one("dst", "src").join(one("src", "dst"), "node").where("src <> node and dst <> node")
    go = chain.where(coin("node") & ~coin("src")).select("node")
    into = edges.join(go, edges["dst"] == go["node"]).select("node", F.col("src").alias("a"), F.col("low").alias("l"))
    out = edges.join(go, edges["src"] == go["node"]).select("node", F.col("dst").alias("b"), F.col("low").alias("m"))
    new = into.join(out, "node").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.least("l", "m", "node").alias("low"))
    kept = edges.join(go, edges["dst"] == go["node"], "left_anti").join(go, edges["src"] == go["node"], "left_anti")
    return kept.unionByName(new).groupBy("src", "dst").agg(F.min("low").alias("low"))


def _spread(edges: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """labels (node, label) after the smallest label has gone along all edges from a to b, until nothing changes."""
    while True:
        said = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).join(labels, "node").select(F.col("to").alias("node"), F.col("label").alias("new"))
        said = said.groupBy("node").agg(F.min("new").alias("new"))
        after = labels.join(said, "node", "left").select("node", F.least("label", F.coalesce("new", "label")).alias("label"), (F.col("new") < F.col("label")).alias("moved"))
        after = saved(after, "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels


def override_cycles(policies: DataFrame) -> DataFrame:
    """(policy_id): the smallest policy on a cycle of overrides; no row if there is none. Space is linear in the overrides.

    Loops are noted and taken out. Nodes without an edge in or out are peeled off and nodes with one of each are passed over,
    turn by turn, which uses up trees, chains and plain rings in about log(n) turns. In what is left colours spread forwards:
    a node has the smallest node that reaches it, and those that reach that node back within its colour are a component; the
    components are noted and taken out until no edge is left. Turns of the last part grow with the longest shortest path.
    """
    edges = policies.select(F.col("policy_id").alias("src"), F.explode("overrides").alias("dst")).where("src is not null and dst is not null")
    edges = saved(edges.distinct().withColumn("low", F.least("src", "dst")), "edges")
    found, turn = edges.where("src = dst").agg(F.min("src").alias("policy_id")), 0
    edges, size = edges.where("src <> dst"), -1
    while (n := edges.count()) and n != size:
        size, turn = n, turn + 1
        for _ in range(3):  # a path without a node whose coins fit may stand still for a turn, hardly for three
            edges = saved(_shortened(_trimmed(edges), turn), "edges")
            turn += 1
            found = found.union(edges.where("src = dst").agg(F.min(F.least("src", "low")).alias("policy_id")))
            edges = edges.where("src <> dst")
    while not edges.isEmpty():
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = saved(_spread(edges, nodes.withColumn("label", F.col("node")), "src", "dst"), "colour")
        ends = [colour.select(F.col("node").alias(c), F.col("label").alias(f"{c}_colour")) for c in ("src", "dst")]
        inside = saved(edges.join(ends[0], "src").join(ends[1], "dst").where("src_colour = dst_colour").select("src", "dst", "low", F.col("src_colour").alias("colour")), "inside")
        # a node that reaches its colour's node takes its label on the way back; all others keep a larger one
        back = _spread(inside, colour.withColumn("label", F.when(F.col("node") == F.col("label"), F.struct(F.lit(0).alias("k"), "label")).otherwise(F.struct(F.lit(1).alias("k"), F.col("node").alias("label")))), "dst", "src")
        part = saved(back.where("label.k = 0").select("node"), "component")
        both = inside.join(part.withColumnRenamed("node", "src"), "src", "left_semi").join(part.withColumnRenamed("node", "dst"), "dst", "left_semi")
        found = found.union(both.agg(F.min(F.least("src", "dst", "low")).alias("policy_id")))
        edges = edges.join(part.withColumnRenamed("node", "src"), "src", "left_anti").join(part.withColumnRenamed("node", "dst"), "dst", "left_anti")
        edges = saved(_trimmed(edges.select("src", "dst", "low")), "edges")
    return found.agg(F.min("policy_id").alias("policy_id")).where("policy_id is not null")


def match_policies(contexts: DataFrame, policies: DataFrame) -> DataFrame:
    """(context_id, policy_id, ...) of enabled policies that match a context (context_id, url, model, phase, user, groups).

    The wildcard test is an equi-join: each context asks for its own url and model and for *, so a large policy table
    is not met pair by pair.
    """
    c = contexts.withColumn("_url", F.explode(F.array(F.lower("url"), F.lit("*"))))
    c = c.withColumn("_model", F.explode(F.array(F.lower("model"), F.lit("*"))))
    p = policies.where("enabled").select(
        "policy_id", "version", F.lower("url").alias("_url"), F.lower("model").alias("_model"), "phase", "subject_kind",
        F.lower("subject").alias("_subject"), "detectors", "deadline_ms", "on_detected", "on_clean", "on_error", "mask", "overrides",
    )
    groups = F.coalesce("groups", F.array().cast("array<string>"))
    subject = (
        F.when(F.col("subject_kind") == "ANY", True)
        .when(F.col("subject_kind") == "USER", F.col("user").isNotNull() & ((F.col("_subject") == "*") | (F.lower("user") == F.col("_subject"))))
        .when(F.col("subject_kind") == "GROUP", (F.size(groups) > 0) & ((F.col("_subject") == "*") | F.exists(groups, lambda g: F.lower(g) == F.col("_subject"))))
        .otherwise(False)
    )
    return c.join(p, ["_url", "_model", "phase"]).where(subject).drop("_url", "_model", "_subject")


def apply_overrides(matched: DataFrame) -> DataFrame:
    """matched with applied: false for policies that another matched policy of the context overrides. All overrides
    hold at once."""
    gone = matched.select("context_id", F.explode("overrides").alias("policy_id")).distinct().withColumn("_gone", F.lit(True))
    return matched.join(gone, ["context_id", "policy_id"], "left").withColumn("applied", F.col("_gone").isNull()).drop("_gone")


def share_results(applied: DataFrame, results: DataFrame) -> DataFrame:
    """Results (fragment_id, context_id, detector_id, status, ...) joined to each applied policy that uses the detector;
    a detector runs once a fragment however many policies use it."""
    p = applied.where("applied").select("context_id", "policy_id", "version", "deadline_ms", "on_detected", "on_clean", "on_error", "mask", F.explode("detectors").alias("detector_id"))
    return results.join(p, ["context_id", "detector_id"])


def apply_deadlines(results: DataFrame) -> DataFrame:
    """Results with duration_ms beyond their policy's deadline become errors of that policy alone."""
    late = F.col("duration_ms") > F.col("deadline_ms")
    return results.withColumn("error_code", F.when(late, "POLICY_DEADLINE_EXCEEDED").otherwise(F.col("error_code"))).withColumn(
        "status", F.when(late, "ERROR").otherwise(F.col("status"))
    )


def react(results: DataFrame) -> DataFrame:
    """(fragment_id, context_id, policy_id, state, disposition, masks) of each policy: clean only if all its detectors
    are; else the reactions to what was found and to errors, the hardest one winning."""
    hit = F.when(F.col("status") == "DETECTED", F.col("on_detected")).when(F.col("status") == "ERROR", F.col("on_error"))
    clean = F.bool_and(F.col("status") == "CLEAN")
    state = F.when(clean, "CLEAN").when(F.bool_or(F.col("status") == "ERROR"), "ERROR").otherwise("DETECTED")
    blocked = F.bool_or(hit == "BLOCK")
    disposition = F.when(clean, F.min("on_clean")).when(F.coalesce(blocked, F.lit(False)), "BLOCK").otherwise("ALLOW")
    masks = F.bool_or(F.col("mask") & (F.col("status") == "DETECTED"))
    return results.groupBy("fragment_id", "context_id", "policy_id").agg(
        state.alias("state"), disposition.alias("disposition"), masks.alias("masks"), F.min("error_code").alias("error_code")
    )


def decide_fragments(reactions: DataFrame) -> DataFrame:
    """(fragment_id, context_id, disposition, masks, blocking): any BLOCK blocks, without masking; blocking lists the
    policies that explain it."""
    block = F.bool_or(F.col("disposition") == "BLOCK")
    blocking = F.array_sort(F.collect_set(F.when(F.col("disposition") == "BLOCK", F.col("policy_id"))))
    return reactions.groupBy("fragment_id", "context_id").agg(
        F.when(block, "BLOCK").otherwise("ALLOW").alias("disposition"), (~block & F.bool_or("masks")).alias("masks"),
        blocking.alias("blocking"), F.bool_or(F.col("state") == "ERROR").alias("failed"),
    )


#: Outcome, HTTP status, client code, and whether a retry is hinted (fixed values).
OUTCOMES = (("ERROR", 503, "inspection_unavailable", True), ("BLOCK", 403, "policy_violation", False), ("MASK", 200, None, False), ("ALLOW", 200, None, False))


def decide_messages(fragments: DataFrame, keys: list[str], phase: str = "REQUEST") -> DataFrame:
    """(keys, outcome) of messages from fragment decisions (disposition, masks, failed, field_class): error over block
    over mask over allow; in requests a mask of a structural field blocks."""
    structural = F.bool_or(F.col("masks") & (F.col("field_class") == "STRUCTURAL")) if phase == "REQUEST" else F.lit(False)
    outcome = (
        F.when(F.bool_or("failed"), "ERROR")
        .when(F.bool_or(F.col("disposition") == "BLOCK") | structural, "BLOCK")
        .when(F.bool_or("masks"), "MASK")
        .otherwise("ALLOW")
    )
    return fragments.groupBy(*keys).agg(outcome.alias("outcome"))


def outcome_contract(df: DataFrame) -> DataFrame:
    """df with http_status, client_code and retry of its outcome."""
    dim = df.sparkSession.createDataFrame(list(OUTCOMES), "outcome string, http_status int, client_code string, retry boolean")
    return df.join(F.broadcast(dim), "outcome", "left")


def policy_findings(findings: Column) -> Column:
    """Findings of the detector as findings of the policy engine: type, span, confidence, and a map of metadata."""
    pairs = lambda f: F.create_map(
        F.lit("evidenceStrength"), f["evidence"], F.lit("recognizerId"), f["recognizer_id"], F.lit("recognizerVersion"), f["recognizer_version"]
    )
    return F.transform(findings, lambda f: F.struct(
        f["type"].alias("type"), f["start_utf8"].alias("start"), f["end_utf8"].alias("end"), f["confidence"].alias("confidence"), pairs(f).alias("metadata")
    ))


def explain_fragments(results: DataFrame, reactions: DataFrame) -> DataFrame:
    """(fragment_id, context_id, policies, detectors): what explains a decision. Of a blocked fragment only the policies
    that block are kept, and the results of their detectors, as detector:status; else all."""
    w = W.partitionBy("fragment_id", "context_id")
    kept = reactions.withColumn("_block", F.max(F.col("disposition") == "BLOCK").over(w)).where(~F.col("_block") | (F.col("disposition") == "BLOCK"))
    used = results.join(kept.select("fragment_id", "context_id", "policy_id"), ["fragment_id", "context_id", "policy_id"], "left_semi")
    return used.groupBy("fragment_id", "context_id").agg(
        F.array_sort(F.collect_set("policy_id")).alias("policies"), F.array_sort(F.collect_set(F.concat_ws(":", "detector_id", "status"))).alias("detectors")
    )


def inspected_payloads(messages: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ordinal, text) that are evaluated for each message: its fragments, or one empty text (ordinal null) for a
    message of gaps only, which counts as no fragment."""
    return messages.select(*keys).join(fragments.select(*keys, "ordinal", "text"), keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def audit_messages(fragments: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, audit_outcome, n_fragments, n_findings, by_type, by_evidence, policies, error_code): the safe summary of each message.

    fragments: (keys, findings, policies, failed), and errors (array of detector_id, error_code) where known; messages:
    (keys, has_gap). A message of gaps only counts 0 fragments. error_code is that of the first detector by id with one,
    DETECTOR_EXECUTION_ERROR for a failure without.
    """
    f = fragments if "errors" in fragments.columns else fragments.withColumn("errors", F.array().cast("array<struct<detector_id:string,error_code:string>>"))
    evidence = "evidence" in f.schema["findings"].dataType.elementType.names
    # One pass: what a fragment says is counted by (part, name, code), first within tasks, then rendered for each message.
    part = lambda kind, name, code=None: F.struct(F.lit(kind).alias("part"), name.cast("string").alias("name"), (F.lit(None) if code is None else code).cast("string").alias("code"))
    said = F.concat(
        F.array(part("fragment", F.coalesce("failed", F.lit(False)))),
        *[F.coalesce(F.transform(c, g), F.array().cast("array<struct<part:string,name:string,code:string>>")) for c, g in (
            ("findings", lambda x: part("type", x["type"])),
            ("findings", lambda x: part("evidence", x["evidence"] if evidence else F.lit(None))),
            ("policies", lambda x: part("policy", x)),
            ("errors", lambda x: part("error", x["detector_id"], x["error_code"])),
        )],
    )
    counts = f.select(*keys, F.inline(said)).groupBy(*keys, "part", "name", "code").agg(F.count("*").alias("n"))
    of = lambda kind: F.col("part") == kind
    listed = lambda kind, text: F.array_join(F.array_sort(F.collect_set(F.when(of(kind), text))), ",")
    number = F.concat_ws(":", "name", "n")
    summed = counts.groupBy(*keys).agg(
        F.sum(F.when(of("fragment"), F.col("n"))).alias("n_fragments"), F.bool_or(of("fragment") & (F.col("name") == "true")).alias("failed"),
        F.sum(F.when(of("type"), F.col("n"))).alias("n_findings"), listed("type", number).alias("by_type"),
        listed("evidence", F.when(F.col("name").isNotNull(), number)).alias("by_evidence"), listed("policy", F.col("name")).alias("policies"),
        F.min(F.when(of("error") & F.col("code").isNotNull(), F.struct("name", "code"))).alias("_first"),
    )
    out = messages.join(summed, keys, "left")
    outcome = F.when(F.col("failed"), "ERROR").when(F.col("n_findings") > 0, "DETECTED").when(F.col("has_gap"), "INSPECTION_GAP").otherwise("CLEAN")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(
        *keys, outcome.alias("audit_outcome"), F.coalesce("n_fragments", F.lit(0)).alias("n_fragments"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        text("by_type"), text("by_evidence"), text("policies"), F.when(F.col("failed"), F.coalesce("_first.code", F.lit("DETECTOR_EXECUTION_ERROR"))).alias("error_code"),
    )


def failure_events(results: DataFrame) -> DataFrame:
    """(detector_id, error_code, policies, n): detector failures and deadlines with the policies they touch."""
    bad = results.where("status = 'ERROR'")
    return bad.groupBy("detector_id", "error_code").agg(F.array_join(F.array_sort(F.collect_set("policy_id")), ",").alias("policies"), F.count("*").alias("n"))
