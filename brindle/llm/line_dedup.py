"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE, prepare, scratch, without, written

ARRAY = "array<struct<hi:long,lo:long>>"


def keys_of(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """Per \\n-split line: 16 bytes of its key's hash, or None for a key of under min_chars code points."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE).lower()
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _hashes(min_chars: int):
    @F.arrow_udf(ARRAY)
    def line_hashes(texts: pa.Array) -> pa.Array:
        offsets, got = [0], []
        for text in texts.to_pylist():
            got += {k for k in keys_of(text, min_chars) if k}
            offsets.append(len(got))
        pair = np.frombuffer(b"".join(got), dtype=">i8").astype(np.int64).reshape(-1, 2)
        both = pa.StructArray.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["hi", "lo"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), both)

    return line_hashes


def _keep(min_chars: int):
    @F.arrow_udf("struct<text:string,n_lines:long,n_dropped:long>")
    def keep_lines(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for text, drop in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            kept = lines
            if drop:
                gone = {x["hi"].to_bytes(8, "big", signed=True) + x["lo"].to_bytes(8, "big", signed=True) for x in drop}
                kept = [a for a, k in zip(lines, keys_of(text, min_chars), strict=True) if k not in gone]
            out.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
        return pa.array(
            [dict(zip(("text", "n_lines", "n_dropped"), x, strict=True)) for x in out],
            pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]),
        )

    return keep_lines


class LineRuns:
    """Levelled sorted runs of (hi, lo, owner): line hashes and the smallest document that holds each.

    A run is a table bucketed and sorted by hash in the shared folder, so that a batch meets it in a merge anti-join
    without moving or sorting the run. A level of `fanout` runs is compacted to one run of the next level; so a
    batch meets fanout - 1 runs of each level at most. Documents must arrive in the order of their ids.
    """

    def __init__(self, spark, buckets: int = 32, fanout: int = 3):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.id = uuid.uuid4().hex[:12]
        self.made = 0

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{self.id}_{self.made}"
        self.made += 1
        writer = df.repartition(self.buckets, "hi", "lo").write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo")
        writer.option("path", scratch(self.spark, "run")).saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def absorb(self, batch: DataFrame) -> None:
        """Add the hashes of batch (hi, lo, doc_id) that no run has yet; hot lines shrink in the map-side aggregate."""
        fresh = batch.groupBy("hi", "lo").agg(F.min("doc_id").alias("owner"))
        for run in self.tables():
            fresh = fresh.join(run.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
        self._push(0, self._write(fresh))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._write(self._union([self.spark.table(n) for n in runs]))
            for n in runs:
                self.spark.sql(f"DROP TABLE {n}")
            self._push(level + 1, merged)

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.union(t)
        return out

    def owners(self) -> DataFrame:
        return self._union(self.tables())


    def close(self) -> None:
        """Take the runs out of the catalog; their files lie in the shared folder until that is cleared."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def buckets_of(spark, lines: int) -> int:
    """Buckets of the runs of so many line hashes: at least as many as Spark shuffles to, as a run is written by as many tasks,
    each of which would leave a small file in every bucket."""
    return max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // BUCKET_LINES))


#: Documents that a batch takes, and line hashes that a bucket of a run holds, before there are more of them.
BATCH_DOCS, BUCKET_LINES = 1 << 30, 1 << 24


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 3, buckets: int | None = None) -> DataFrame:
    """docs with text cut to the lines that stay, plus n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of min_chars code points
    or more stays only in the smallest doc_id that holds it (there all its lines stay). Null and empty texts are one
    empty line and give "". Rows with a null doc_id hold no key and lose nothing. Repeated rows of one doc_id count as
    one document. Input columns named n_lines or n_dropped are replaced; other columns pass through. An empty table
    gives an empty table. Keys are compared by 128-bit hashes.

    Batches are ranges of doc_id by quantiles, so the oldest holder of a key is always in the oldest run. There are four,
    more where documents pass BATCH_DOCS each; runs have 32 buckets, or as many as Spark shuffles to, more where line hashes pass
    BUCKET_LINES each.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = without(docs, "n_lines", "n_dropped")
    raw = F.col("text").cast("binary")
    ids = docs.select("doc_id").where("doc_id is not null")
    batches = batches or max(4, -(-ids.count() // BATCH_DOCS))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("doc_id") > F.lit(int(c))).cast("int")
    lines = docs.where("doc_id is not null").select("doc_id", part.alias("batch"), F.inline(_hashes(min_chars)(raw)))
    path = scratch(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema("doc_id long, hi long, lo long, batch int").parquet(path)
    runs = LineRuns(spark, buckets or buckets_of(spark, keyed.count()), fanout)
    for b in range(len(cuts) + 1):
        runs.absorb(keyed.where(F.col("batch") == b))
    # The owner side has a row for each hash; of a hot line's rows on the other side AQE splits the partition.
    drops = (
        keyed.select("doc_id", "hi", "lo")
        .join(runs.owners(), ["hi", "lo"])
        .where(F.col("owner") < F.col("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("_drops"))
    )
    drops = written(drops, "drops")
    runs.close()
    out = docs.join(drops, "doc_id", "left").withColumn("_kept", _keep(min_chars)(raw, F.col("_drops")))
    names = [F.col("_kept.text").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*names, "_kept.n_lines", "_kept.n_dropped")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owner AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT l.doc_id, l.k, l.line, coalesce(o.first < l.doc_id, false) AS gone
  FROM keyed l LEFT JOIN owner o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
