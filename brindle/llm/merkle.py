"""Merkle manifest of a table: hash trees over groups of rows, proofs of every row, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import prepare, written

#: Levels of a tree that are built and searched together: a block holds the nodes over 2 ** BAND nodes of one level.
BAND = 8
_SIDES = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256."""
    return F.sha2(text, 256)


def row_text(columns: list[Column]) -> Column:
    """What a leaf hashes: each value as its UTF-8 byte count, a colon and the value; `-` for null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with rank: its place from 0 among the rows of its group by `order`, nulls first.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks: a row's rank is its place in
    its range plus the rows of the group in the ranges before.
    """
    keys = [group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    runs = placed.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("_part", group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(runs, ["_part", group]).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _node(lo: Column, hi: Column, hashed: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), hashed.alias("digest"))


def _levels(level: Column, steps: Column) -> Column:
    """[level, the level of its parents, ...], `steps` levels up; a node covers the leaf ranks lo to hi."""

    def above(acc: Column, _: Column) -> Column:
        below = F.element_at(acc, -1)

        def parent(i: Column) -> Column:
            one, two = F.get(below, 2 * i), F.get(below, 2 * i + 1)
            return _node(one["lo"], F.coalesce(two["hi"], one["hi"]), digest(F.concat(one["digest"], F.coalesce(two["digest"], F.lit("")))))

        return F.concat(acc, F.array(F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")), parent)))

    built = F.aggregate(F.sequence(F.lit(1), steps), F.array(level), above)
    return F.when(steps > 0, built).otherwise(F.array(level))


def _path(levels: Column, place: Column) -> Column:
    """Of the node at a place of levels[0], the siblings on the way up: what the parent's interval has beside the node's own."""

    def side(k: Column) -> Column:
        own, parent = F.get(F.get(levels, k), F.call_function("shiftright", place, k)), F.get(F.get(levels, k + 1), F.call_function("shiftright", place, k + 1))
        # the difference of the two intervals lies before or behind the node, or is empty
        before, behind = F.call_function("shiftright", place, k) - 1, F.call_function("shiftright", place, k) + 1
        left = F.when(parent["lo"] < own["lo"], F.get(F.get(levels, k), before)["digest"])
        right = F.when(own["hi"] < parent["hi"], F.get(F.get(levels, k), behind)["digest"])
        return F.struct(F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right"))

    top = F.size(levels) - 2
    return F.when(top >= 0, F.transform(F.sequence(F.lit(0), top), side)).otherwise(F.array().cast(_SIDES))


def trees(leaves: DataFrame) -> DataFrame:
    """(g, rank, leaf, row, path, root) of leaves (g long, rank long from 0 in each g, leaf string, row): one binary tree a g.

    Two consecutive nodes, or a last one alone, become the hash of their digests while a level has several nodes. Nodes are
    labelled by the interval of leaf ranks below them. BAND levels at a time are built in blocks of 2 ** BAND nodes, whose
    tops are the nodes of the next band; going down, blocks meet the node of the band above whose interval contains theirs,
    in buckets of (g, band), and take over its path. path has the siblings of each level, from the leaf to the root.
    """
    sizes = leaves.groupBy("g").agg((F.max("rank") + 1).alias("n"))
    # the least depth with 2 ** depth >= n is the number of binary digits of n - 1
    sizes = written(sizes.select("g", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int").alias("depth")), "depths")
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    nodes = leaves.select("g", F.col("rank").alias("idx"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), "row")
    bands = []
    for band in range(max(1, -(-deepest // BAND))):
        low = band * BAND
        steps = F.least(F.lit(BAND), F.col("depth") - low)
        item = F.struct("idx", "lo", "hi", "digest", *(["row"] if band == 0 else []))
        blocks = nodes.groupBy("g", F.shiftright("idx", BAND).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        blocks = blocks.join(sizes, "g")
        if band:
            blocks = blocks.where(F.col("depth") > low)
        blocks = blocks.withColumn("levels", _levels(F.transform("items", lambda x: _node(x["lo"], x["hi"], x["digest"])), steps))
        top = F.element_at(F.element_at("levels", -1), 1)
        blocks = blocks.select("g", "block", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"), (F.col("depth") <= low + BAND).alias("last"), "items", "levels")
        bands.append(written(blocks, f"band{band}"))
        nodes = bands[-1].where("not last").select("g", F.col("block").alias("idx"), "lo", "hi", "digest")
    none = F.array().cast(_SIDES)
    above = None
    for band, blocks in reversed(list(enumerate(bands))):
        done = blocks.where("last").withColumn("over", none).withColumn("root", F.col("digest"))
        if above is not None:
            held = blocks.where("not last").join(above, (F.col("g") == F.col("ag")) & (F.col("block") == F.col("abucket")) & (F.col("lo") >= F.col("alo")) & (F.col("hi") <= F.col("ahi")))
            done = done.unionByName(held.select(*blocks.columns, F.col("apath").alias("over"), F.col("aroot").alias("root")))
        each = done.select("g", "levels", "over", "root", F.posexplode("items").alias("place", "item"))
        path = F.concat(_path(F.col("levels"), F.col("place")), F.col("over"))
        if band:
            above = each.select(
                F.col("g").alias("ag"), F.col("item.idx").alias("abucket"), F.col("item.lo").alias("alo"), F.col("item.hi").alias("ahi"),
                path.alias("apath"), F.col("root").alias("aroot"),
            )
    return each.select("g", F.col("item.idx").alias("rank"), F.col("item.digest").alias("leaf"), "item.row", path.alias("path"), "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def path_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def merkle_manifest(rows: DataFrame, columns: list[str], group: str, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """(order, group, leaf, subroot, root, path, carried columns): a leaf for each row, a tree for each group and one over the groups.

    A leaf hashes the `columns` (see row_text). Leaves of a group ascend by `order`, ties by their digest and by what they
    carry; null comes first, also among groups, which ascend bytewise. Repeated rows are leaves of their own. Null values of
    any column are part of the leaf; an empty table gives no rows. `carry` names further expressions over a row. Columns of
    rows that are not named are not read.
    """
    prepare(rows.sparkSession)
    carry = carry or {}
    kept = F.struct(F.col(order).alias("order"), F.col(group).alias("group"), *[c.alias(n) for n, c in carry.items()])
    leaves = rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), digest(row_text([F.col(c) for c in columns])).alias("leaf"), kept.alias("row"))
    leaves = written(leaves, "leaves")
    names = _ordinals(leaves)
    placed = leaves.join(names, leaves["_group"].eqNullSafe(names["_name"])).select("g", "_order", "leaf", "row")
    below = written(trees(ranked(placed, "g", ["_order", "leaf", "row"])), "paths")
    tops = below.groupBy("g").agg(F.min("root").alias("leaf"))
    tops = tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), "leaf", F.struct(F.lit(None).cast("string").alias("none")).alias("row"))
    over = trees(tops).select(F.col("rank").alias("g"), F.col("path").alias("up"), F.col("root").alias("top"))
    out = below.join(over, "g")
    return out.select(
        F.col("row.order").alias(order), F.col("row.group").alias(group), "leaf", F.col("root").alias("subroot"), F.col("top").alias("root"),
        F.concat("path", "up").alias("path"), *[F.col(f"row.{n}").alias(n) for n in carry],
    )


def _ordinals(leaves: DataFrame) -> DataFrame:
    """(_name, g): the groups by UTF-8 bytes, null first, with their place."""
    names = leaves.select(F.lit(0).alias("_all"), F.col("_group").alias("_name")).distinct()
    return ranked(names, "_all", ["_name"]).select("_name", F.col("rank").alias("g"))


DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT)
    more = [F.col(c) if c != "n_chars" else F.col(c).cast("long") + 1 for c in DOCUMENT]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    tampered = F.when(hit, digest(row_text(more)))
    found = merkle_manifest(docs, DOCUMENT, "lang", "doc_id", {"tampered": tampered})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of a tree that the SQL builds; a level of one node repeats itself.
_SQL_LEVELS = 20
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"


def _sql() -> str:
    def hashed(**other: str) -> str:
        return "sha256(" + " || ".join(_FIELD.format(other.get(c, c)) for c in DOCUMENT) + ")"

    def tree(name: str) -> list[str]:
        """CTEs of all levels of the trees of {name}0(g, i, h) and, for each of their leaves, its siblings and root."""
        out = []
        for k in range(_SQL_LEVELS):
            below, up = f"{name}{k}", f"{name}{k + 1}"
            out.append(
                f"{below}n AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n, lag(h) OVER w AS l, lead(h) OVER w AS r "
                f"FROM {below} WINDOW w AS (PARTITION BY g ORDER BY i))"
            )
            out.append(
                f"{up} AS MATERIALIZED (SELECT g, CASE WHEN n = 1 THEN i ELSE i // 2 END AS i, "
                f"CASE WHEN n = 1 THEN h ELSE sha256(h || coalesce(r, '')) END AS h FROM {below}n WHERE n = 1 OR i % 2 = 0)"
            )
            sides = "CASE WHEN n = 1 THEN NULL WHEN i % 2 = 1 THEN {'l': l, 'r': ''} ELSE {'l': '', 'r': coalesce(r, '')} END"
            out.append(f"{below}s AS (SELECT g, i, {sides} AS s FROM {below}n)")
        joins, at = "", "a.i"
        for k in range(_SQL_LEVELS):
            joins += f" JOIN {name}{k}s s{k} ON s{k}.g = a.g AND s{k}.i = {at}"
            at = f"CASE WHEN s{k}.s IS NULL THEN s{k}.i ELSE s{k}.i // 2 END"
        path = "list_filter([" + ", ".join(f"s{k}.s" for k in range(_SQL_LEVELS)) + "], lambda x: x IS NOT NULL)"
        out.append(
            f"{name}p AS (SELECT a.g, a.i, a.h, {path} AS path, t.h AS root FROM {name}0 a{joins} JOIN {name}{_SQL_LEVELS} t ON t.g = a.g)"
        )
        return out

    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    )
    ctes = [
        f"rows AS MATERIALIZED (SELECT doc_id, lang, {hashed()} AS leaf, {hashed(n_chars='(n_chars + 1)')} AS other, {crc} % 7 = 0 AS hit FROM documents)",
        "placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, "
        "row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows)",
        "a0 AS (SELECT g, i, leaf AS h FROM placed)",
        *tree("a"),
        "b0 AS (SELECT DISTINCT 0 AS g, g AS i, root AS h FROM ap)",
        *tree("b"),
        "paths AS (SELECT p.doc_id, p.leaf, CASE WHEN p.hit THEN p.other ELSE p.leaf END AS own, ap.root AS subroot, bp.root, "
        "list_concat(ap.path, bp.path) AS path FROM placed p JOIN ap USING (g, i) JOIN bp ON bp.i = p.g)",
        "folded AS (SELECT *, list_reduce(list_prepend({'l': own, 'r': ''}, path), "
        "lambda acc, s: {'l': sha256(s.l || acc.l || s.r), 'r': ''}).l AS folded_root FROM paths)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, leaf, subroot, root, "
        "sha256(coalesce(list_reduce(list_prepend('', list_transform(path, lambda s: s.l || s.r)), lambda a, b: a || b), '')) AS proof_sha256, "
        "folded_root, folded_root = root AS verified FROM folded"
    )


OP13_SQL = _sql()
