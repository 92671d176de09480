"""Embedding near-dedup by collision counts on one-dimensional projections."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import components, prepare, written
from brindle.llm.groups import cells, near_pairs, stars, whole_groups

#: Width of a projection's cells, and of the windows centred on a query, in standard deviations of a unit vector.
CELL = 1.5
#: Chance that the search misses a pair just at the threshold.
MISS = 0.005


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def plan_search(n: int, cosine: float) -> tuple[int, int, int]:
    """(k, tables, least): cells of k projections each, their number, and the collisions that a pair needs.

    n is the number of different vectors of the largest label. k grows with its logarithm so that a cell's strangers stay few; the tables follow from the
    recall at the threshold; `least` is the lower 0.1 % quantile of the collisions, within half a cell to either side
    of the query, that a pair at the threshold has among all k * tables projections.
    """
    far = math.sqrt(2 - 2 * cosine)
    grid = np.linspace(0, CELL, 2001)
    step = grid[1] - grid[0]
    density = 2 * np.exp(-((grid / far) ** 2) / 2) / (far * math.sqrt(2 * math.pi))
    same = float(((1 - grid / CELL) * density).sum() * step)
    stranger = 0.42
    k = max(6, math.ceil(math.log(max(n, 2)) / -math.log(stranger)) - 2)
    tables = max(4, math.ceil(math.log(MISS) / math.log(1 - same**k)))
    near = 2 * _normal_cdf(CELL / 2 / far) - 1
    m = k * tables
    least = math.floor(m * near - 3.1 * math.sqrt(m * near * (1 - near)))
    return k, tables, max(1, least)


@functools.lru_cache(maxsize=4)
def directions(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (dim, tables * k) and the offsets of their cells."""
    rng = np.random.default_rng([seed, dim, k, tables])
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, CELL, tables * k)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(k: int, tables: int, seed: int):
    """Per vector: for each table a hash of its cell's coordinates."""

    @F.arrow_udf("array<long>")
    def cell_keys(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int64()))
        sizes = np.asarray(vectors.value_lengths())
        out: list = [None] * len(vectors)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            way, shift = directions(int(dim), k, tables, seed)
            cell = np.floor((_units(vectors.take(pa.array(at))) @ way + shift) / CELL).astype(np.int64)
            with np.errstate(over="ignore"):
                odd = np.random.default_rng(seed).integers(1, 1 << 62, k, dtype=np.int64) * 2 + 1
                key = (cell.reshape(len(at), tables, k) * odd).sum(axis=2)
            for a, row in zip(at, key.tolist(), strict=True):
                out[a] = row
        return pa.array(out, pa.list_(pa.int64()))

    return cell_keys


def _links(k: int, tables: int, seed: int, cosine: float, least: int):
    names = ["table", "label", "dim", "key", "cell_a", "cell_b"]

    def linked(batches):
        for table, group in whole_groups(batches, names, 4096):
            node, size = table.column("node").to_numpy(), table.column("n").to_numpy()
            at_table, dims = table.column("table").to_numpy(), table.column("dim").to_numpy()
            a, b, part = (table.column(c).to_numpy() for c in ("cell_a", "cell_b", "part"))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = _units(table.column("embedding").take(pa.array(own)))
                way, shift = directions(int(dim), k, tables, seed)
                line = x @ way
                cell = np.floor((line + shift) / CELL).astype(np.int16).reshape(len(own), tables, k)
                line = line.astype(np.float32)
                which = at_table[own]

                def test(i, j, x=x, line=line, cell=cell, which=which):
                    # An earlier table in which the two share a cell has the pair already.
                    ok = np.ones(len(i), dtype=bool)
                    for s in range(0, len(i), 2048):
                        p, q = i[s : s + 2048], j[s : s + 2048]
                        hit = (np.abs(line[p] - line[q]) <= CELL / 2).sum(axis=1) >= least
                        p, q = p[hit], q[hit]
                        good = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                        met = (cell[p] == cell[q]).all(axis=2)
                        good &= met.argmax(axis=1) == which[p]
                        hit[hit] = good
                        ok[s : s + 2048] = hit
                    return ok

                i, j = near_pairs(group[own], (a == b)[own], part[own], test, 50_000)
                if not len(i):
                    continue
                r, n = node[own], size[own]
                links = np.zeros(len(own), dtype=np.int64)
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                some = links > 0
                low, root = stars(r, i, j)
                to = dict(zip(low.tolist(), root.tolist(), strict=True))
                ids = r[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([to.get(v, v) for v in ids.tolist()], pa.int64()), pa.array(links[some])],
                    names=["node", "root", "links"],
                )

    return linked


def embedding_groups(vectors: DataFrame, cosine: float = 0.93, seed: int = 11, chunk: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Two vectors of one label, not null, of one length are linked if their cosine in double precision is at least the
    threshold. Vectors that are null, empty, zero or hold null or non-finite components, and those of a null vec_id,
    link with nothing: they have 0 links and their own id as component. Equal vectors of a label become one node
    first (n_links counts the copies); rows of one vec_id count as many vectors. Nodes meet in cells of k projections;
    their collisions in windows centred on each other are counted over all projections, and pairs with the calibrated
    count are verified. The search misses a pair at the threshold with a chance of MISS, nearer pairs more rarely.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = vectors.select("vec_id", F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    # -0.0 and 0.0 are one number
    v = v.withColumn("fit", fit).withColumn("embedding", F.when(F.col("fit"), F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))))
    marked = v.select("vec_id", "fit", "label", "embedding", F.when(F.col("fit"), F.xxhash64("embedding")).alias("h"))
    marked = marked.withColumn("h2", F.when(F.col("fit"), F.xxhash64(F.lit(1), F.col("embedding"))))
    nodes = marked.where("fit").groupBy("label", "h", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding")
    )
    # Nodes have ids of their own: rows of one vec_id may be several vectors.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables, least = plan_search(most, cosine)
    keyed = nodes.select(
        "label", "node", F.size("embedding").alias("dim"), F.posexplode(_keys(k, tables, seed)("embedding")).alias("table", "key")
    )
    slim = cells(keyed.select("table", "label", "dim", "key", "node"), ["table", "label", "dim", "key"], "node", chunk)
    order = ["table", "label", "dim", "key", "cell_a", "cell_b"]
    full = slim.join(nodes.select("node", "n", "embedding"), "node").repartition(*order).sortWithinPartitions(*order)
    found = written(full.mapInArrow(_links(k, tables, seed, cosine, least), "node long, root long, links long"), "links")
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = written(nodes.select("label", "h", "h2", "rep", "n", "node").join(links, "node", "left").join(comps, "node", "left").select(
        "label", "h", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    ), "named")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").drop("component", "rep")
    same = marked.select("vec_id", "fit", "label", "h", "h2")
    met = same.where("fit").join(named, ["label", "h", "h2"]).select("vec_id", "n_links", "component_id")
    rest = same.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
