"""Pairs inside groups of rows with equal keys, compared in bounded cells and never emitted as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import written


def cells(rows: DataFrame, key: list[str], member: str, chunk: int) -> DataFrame:
    """rows whose key has another row, dealt to cells: adds cell_a, cell_b, part.

    A group of n rows is cut into ceil(n / chunk) parts by a hash of `member`; cell (a, b) holds parts a and b, so a
    task holds about 2 * chunk rows of a group however large the group is, and each pair of rows meets in exactly
    one cell: (a, a) for pairs inside a part, (a, b) for pairs across two.
    """
    rows = written(rows, "keyed")
    counts = rows.groupBy(*key).count().where("count > 1")
    parts = F.ceil(F.col("count") / F.lit(chunk)).cast("long")
    met = rows.join(counts, key).withColumn("_n", parts).withColumn("part", F.pmod(F.xxhash64(member), "_n"))
    met = met.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    met = met.withColumn("cell_a", F.least("part", "_o")).withColumn("cell_b", F.greatest("part", "_o"))
    order = [*key, "cell_a", "cell_b"]
    return met.drop("count", "_n", "_o").repartition(*order).sortWithinPartitions(*order)


def whole_groups(batches, names: list[str], rows: int = 20_000):
    """Tables of whole cells from sorted batches, with a column of group numbers; a cell never straddles two tables."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.concat_tables(held)
        group = _numbers(table, names)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut), group[:cut]
            table = table.slice(cut)
        held, size = [table], table.num_rows
    if held:
        table = pa.concat_tables(held)
        yield table, _numbers(table, names)


def _numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    for n in names:
        v = table.column(n).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def near_pairs(group: np.ndarray, within: np.ndarray, part: np.ndarray, test, block: int = 200_000):
    """Index pairs (i, j) of rows of one cell that pass test(i, j), in vector steps over all groups at once.

    within: the cell holds one part (all pairs count); else only pairs across its two parts do.
    """
    found_i, found_j = [], []
    at, d = np.arange(len(group)), 0
    while True:
        d += 1
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        ok = at[within[at] | (part[at] != part[at + d])]
        for k in range(0, len(ok), block):
            i = ok[k : k + block]
            good = test(i, i + d)
            found_i.append(i[good])
            found_j.append(i[good] + d)
    if not found_i:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its local component): a spanning star for each component of the pairs (i, j)."""
    names, at = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        m = np.minimum(root[a], root[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        np.minimum.at(low, root[a], m)
        np.minimum.at(low, root[b], m)
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]
