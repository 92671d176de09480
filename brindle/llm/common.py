"""Shared pieces of the training-data operators: shared scratch tables, word hashing, components."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

#: ASCII white space, as the contracts define it: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"

_OWN_SCRATCH: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = os.pathsep.join([env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")])
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if root not in sys.path:
        sys.path.insert(0, root)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lower the session's Arrow batches to `rows`, so that a batch of very long texts fits a worker. It holds for what the
    session runs later too, so queries and the pipeline ask for it, operators do not."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a local session gets a
    folder of its own, as in tests; on a cluster it is an error, as executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        app = spark.sparkContext.applicationId
        root = _OWN_SCRATCH.setdefault(app, tempfile.mkdtemp(prefix="spark-scratch-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names an operator is about to add."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


# ---------------------------------------------------------------- hashing of words and windows

_WS = np.zeros(256, dtype=bool)
_WS[list(SPACE)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as an array, starts, ends) of the words [^\\x20\\x09-\\x0D]+ of a UTF-8 text."""
    raw = np.frombuffer(text, dtype=np.uint8)
    edge = np.zeros(len(raw) + 2, dtype=np.int8)
    edge[1:-1] = ~_WS[raw]
    step = np.diff(edge)
    return raw, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Odd factors of the two families of span hashes (arbitrary).
_FAMILY = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for many spans at once; which chooses one of two families.

    Blocks of 1, 2, 4, ... values are hashed from their halves, with all bits mixed at every step, so no sum over a span is
    linear in its values. A span is the hash of its length and of the two largest blocks that cover it.
    """
    one, two = (np.uint64(x) for x in _FAMILY[which])
    size = np.asarray(ends) - np.asarray(starts)
    out = np.zeros(len(size), dtype=np.uint64)
    if not len(size) or not size.any():
        return out
    step = np.frexp(size.astype(np.float64))[1] - 1  # the largest power of two in the length
    with np.errstate(over="ignore"):
        block = mix(values + one)
        for k in range(int(step.max()) + 1):
            at = np.flatnonzero(step == k)
            if len(at):
                ends_in = block[ends[at] - (1 << k)]
                out[at] = mix(mix(block[starts[at]] * one + ends_in) * two + ends_in + size[at].astype(np.uint64))
            if k < step.max():
                half = 1 << k
                block = mix(mix(block[:-half] * two + np.uint64(k)) + block[half:] * one)
    return out


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(XXH3 of each word's bytes, starts, ends in bytes)."""
    _, starts, ends = word_bounds(text)
    return np.frombuffer(b"".join(map(xxh3_64_digest, text.split())), dtype=np.uint64), starts, ends


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of edges (a long, b long) can reach.

    Each round hooks every node to its smallest neighbour, follows the pointers to the roots by doubling and
    contracts the edges to roots. Local minima are at most half of the nodes, so rounds grow with the logarithm of
    the nodes. All state is in tables in the shared folder. Nodes without edges are not returned.
    """
    spark = edges.sparkSession
    e = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    found = None
    while not e.isEmpty():
        hook = written(
            e.select(F.col("a").alias("node"), F.col("b").alias("other"))
            .union(e.select("b", "a"))
            .groupBy("node")
            .agg(F.least(F.col("node"), F.min("other")).alias("root")),
            "hook",
        )
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = written(
                hook.join(up, "root").select(
                    "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")
                ),
                "hook",
            )
            hook = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        if found is None:
            found = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = written(
                found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "found"
            )
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = written(
            e.join(left, "a")
            .join(right, "b")
            .where(F.col("ra") != F.col("rb"))
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
    if found is None:
        return spark.createDataFrame([], "node long, component long")
    return found.select("node", F.col("root").alias("component"))
