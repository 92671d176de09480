"""Merkle manifest against a plain recursive version."""

import hashlib

from pyspark.sql import functions as F

from brindle.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level):
    """(root, path of each node) of one level, siblings as (left, right)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            p.append((level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else ""))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def plain(rows, columns, group, order):
    by = {}
    for r in rows:
        by.setdefault(r[group], []).append((r[order], leaf_of([r[c] for c in columns])))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    tops, out = [], []
    for g in names:
        items = sorted(by[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, paths = climb([x[1] for x in items])
        tops.append(root)
        out.append([(x[0], g, x[1], root, p) for x, p in zip(items, paths, strict=True)])
    top, ups = climb(tops)
    return sorted(
        (str((o, g)), leaf, root, top, sha("".join(a + b for a, b in [*p, *up])))
        for some, up in zip(out, ups, strict=True) for o, g, leaf, root, p in some
    )


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, path string"


def got(df):
    rows = merkle.merkle_manifest(df, COLUMNS, "lang", "doc_id").withColumn("proof", merkle.path_digest(F.col("path")))
    return sorted((str((r.doc_id, r.lang)), r.leaf, r.subroot, r.root, r.proof) for r in rows.collect())


def test_trees_of_all_shapes(spark):
    sizes = {"en": 700, "de": 257, "fr": 256, "x": 1, "ü": 3, "": 2, None: 5}
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((k * 7919 % 100003, f"s{k % 3}" if k % 5 else None, lang, k if k % 4 else None, f"text ä {k}" if k % 6 else None, 1, "p"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain([r.asDict() for r in df.collect()], COLUMNS, "lang", "doc_id")


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(1, "a", "en", 1, "x", 0, "")] * 3 + [(1, "a", "en", 1, "y", 0, ""), (None, None, None, None, None, 0, "")] * 2 + [(2, "", "", 0, "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain([r.asDict() for r in df.collect()], COLUMNS, "lang", "doc_id")


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "a", "en", 1, "x" * 100000, 0, "")], SCHEMA)
    (r,) = merkle.merkle_manifest(one, COLUMNS, "lang", "doc_id").collect()
    assert r.leaf == r.subroot == r.root and r.path == []
    assert merkle.merkle_manifest(one.where("false"), COLUMNS, "lang", "doc_id").collect() == []


def test_a_changed_value_breaks_the_proof(spark):
    rows = [(k, "a", "en" if k % 3 else "de", k, f"t{k}", 0, "") for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    changed = merkle.digest(merkle.row_text([F.when(F.col("doc_id") == 7, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(c) for c in COLUMNS]))
    out = merkle.merkle_manifest(df, COLUMNS, "lang", "doc_id", {"again": changed})
    ok = out.select("doc_id", (merkle.fold(F.col("again"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in ok if not r.ok} == {7} and len(ok) == 40
