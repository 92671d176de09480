"""Quality rules: document statistics, base limits and gradient-boosted trees with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE, covered, prepare, span_hash, without, word_hashes

#: Statistics that the contract names, then the ratios that the trees see.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "punctuation", "digits")
#: Falling verdicts only: more symbols, repeated lines, repeated words or capitals never make a document better.
FALLING = ("symbols", "dup_lines", "repeats", "capitals")
STATS = ", ".join(f"{c}:long" for c in COUNTS) + ", ratios:array<double>"

_KIND = np.zeros((4, 256), dtype=bool)
_KIND[0, list(b"#*$%&|<>")] = True
_KIND[1, ord("A") : ord("Z") + 1] = True
_KIND[2, list(b".,!?;:")] = True
_KIND[3, ord("0") : ord("9") + 1] = True


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """(COUNTS, RATIOS) of a text."""
    text = text or b""
    words, starts, ends = word_hashes(text)
    raw = np.frombuffer(text, dtype=np.uint8)
    n = len(words)
    seen, lines = np.bincount(raw, minlength=256), text.split(b"\n")
    starts_of_chars = int(seen[:128].sum() + seen[192:].sum())
    chars = starts_of_chars - int(seen[list(SPACE)].sum())
    symbols, capitals, marks, digits = (int(seen[k].sum()) for k in _KIND)
    filled = [x for x in lines if x.strip(SPACE)]
    dup_lines = len(filled) - len(set(filled))
    repeats = 0
    if n > 5:
        at = np.arange(n - 4)
        _, which, often = np.unique(span_hash(words, at, at + 5), return_inverse=True, return_counts=True)
        at = at[often[which] > 1]
        repeats = int(covered(n, at, at + 5).sum())
    ratios = [
        float(np.log1p(n)),
        chars / max(n, 1),
        symbols / max(n, 1),
        dup_lines / max(len(filled), 1),
        repeats / max(n, 1),
        len(np.unique(words)) / max(n, 1),
        capitals / max(chars, 1),
        marks / max(n, 1),
        digits / max(chars, 1),
    ]
    return [n, chars, symbols, dup_lines, repeats], ratios


@dataclass(frozen=True)
class Trees:
    """Boosted trees in flat arrays: a node's feature (-1 in a leaf), threshold, children and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of quality for rows of ratios."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(low, self.left[at], self.right[at]))
            out += self.value[at]
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 64, least: float = 4.0
) -> Trees:
    """Logistic boosting on binned features; splits on FALLING features must lower the value to the right, and what
    lies below a constrained split is held on its side of the middle of the two values."""
    sign = np.array([-1 if r in FALLING else 0 for r in RATIOS])
    p = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)

        def value(g: float, h: float, low: float, high: float) -> float:
            return float(np.clip(-g / (h + 1.0), low, high))

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            me = len(nodes)
            v = value(g[rows].sum(), h[rows].sum(), low, high)
            nodes.append([-1, 0.0, me, me, v * rate])
            best = None
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    n = len(e) + 1
                    gs = np.cumsum(np.bincount(code[rows, f], g[rows], n))
                    hs = np.cumsum(np.bincount(code[rows, f], h[rows], n))
                    cs = np.cumsum(np.bincount(code[rows, f], minlength=n))
                    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                    vl, vr = np.clip(-gl / (hl + 1), low, high), np.clip(-gr / (hr + 1), low, high)
                    gain = -(gl * vl + 0.5 * (hl + 1) * vl**2) - (gr * vr + 0.5 * (hr + 1) * vr**2)
                    gain[(cs[:-1] < least) | (cs[-1] - cs[:-1] < least) | (sign[f] * (vr - vl) < 0)] = -np.inf
                    k = int(np.argmax(gain))
                    if np.isfinite(gain[k]) and (best is None or gain[k] > best[0] + 1e-12):
                        best = (gain[k], f, k, vl[k], vr[k])
                gs, hs = g[rows].sum(), h[rows].sum()
                if best and best[0] <= -(gs * v + 0.5 * (hs + 1) * v**2) + 1e-6:
                    best = None
            if best:
                _, f, k, vl, vr = best
                goes = code[rows, f] <= k
                mid = (vl + vr) / 2
                l_high, r_low, l_low, r_high = high, low, low, high
                if sign[f] < 0:
                    l_low, r_high = mid, mid
                left = grow(rows[goes], g, h, level + 1, l_low, l_high)
                right = grow(rows[~goes], g, h, level + 1, r_low, r_high)
                nodes[me] = [f, edges[f][k], left, right, 0.0]
            return me

        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), q - y, np.maximum(q * (1 - q), 1e-6), 0, -np.inf, np.inf))
            flat = np.array(nodes)
            one = Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots[-1:]), depth, 0.0)
            margin = margin + one.score(x)
    flat = np.array(nodes) if nodes else np.array([[-1, 0.0, 0, 0, 0.0]])
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, dtype=int), depth, base)


def _as_arrow(got: list, **more: np.ndarray) -> pa.Array:
    counts = np.array([c for c, _ in got], dtype=np.int64).reshape(-1, len(COUNTS))
    cols = {n: pa.array(counts[:, k]) for k, n in enumerate(COUNTS)}
    cols["ratios"] = pa.array([r for _, r in got], pa.list_(pa.float64()))
    cols |= {k: pa.array(v) for k, v in more.items()}
    return pa.StructArray.from_arrays(list(cols.values()), names=list(cols))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Trees:
    """Trees fitted on at most `sample` labelled documents: the first by a hash of their ids; of several texts or labels of
    an id the smallest counts. Only their ratios come to the driver. Without labels of both kinds the verdict is the same for all documents: good."""
    prepare(docs.sparkSession)

    @F.arrow_udf(f"struct<{STATS}>")
    def text_statistics(texts: pa.Array) -> pa.Array:
        return _as_arrow([statistics(t) for t in texts.to_pylist()])

    rows = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    met = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(rows), "doc_id")
    met = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    got = met.select(text_statistics("text")["ratios"].alias("r"), "quality").collect()
    got.sort(key=lambda r: (r.quality, r.r))
    y = np.array([r.quality for r in got], dtype=float)
    if not len(y) or y.min() == y.max():
        y = np.ones(len(y))
    return fit_trees(np.array([r.r for r in got], dtype=float).reshape(len(got), len(RATIOS)), y)


def rate_documents(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with the COUNTS, base_failed, quality_score (log odds) and kept.

    base_failed: under 10 words, or over 20 % of the words in a 5-word window that the text has twice. kept: false if
    base_failed, else whether the trees find quality at least as likely as not. Null and empty texts have no words
    and fail. Input columns of those names are replaced, others pass through; repeated rows get equal verdicts.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf(f"struct<{STATS}, score:double>")
    def rated(texts: pa.Array) -> pa.Array:
        got = [statistics(t) for t in texts.to_pylist()]
        return _as_arrow(got, score=trees.score(np.array([r for _, r in got]).reshape(-1, len(RATIOS))))

    docs = without(docs, *COUNTS, "base_failed", "quality_score", "kept")
    out = docs.withColumn("_q", rated(F.col(text).cast("binary")))
    failed = (F.col("_q.n_words") < 10) | (100 * F.col("_q.n_repeat_words") > 20 * F.col("_q.n_words"))
    return out.select(
        *docs.columns, *[f"_q.{c}" for c in COUNTS], failed.alias("base_failed"),
        F.col("_q.score").alias("quality_score"), (~failed & (F.col("_q.score") >= 0)).alias("kept"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rate_documents(docs, trees).select("doc_id", *COUNTS, "base_failed", "kept")
