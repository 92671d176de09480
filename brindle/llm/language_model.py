"""Scores of texts by a hierarchical Pitman-Yor model of words after one or two words, its seating sampled by Gibbs in shards of contexts."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from brindle.llm.common import mix, prepare, scratch, written

#: Names of the context of a first word and of the token after the last; words hold no line breaks.
START, END = b"\n<", b"\n>"
#: Tokens that a chunk of documents gathers before it is cut to shards, and tokens a shard should have.
CHUNK_TOKENS, SHARD_TOKENS = 1_000_000, 900_000
#: Frequent words, at most, that are written by their place in a list which every task has.
LISTED = 1 << 18
#: Customers of a dish up to which numbers of tables are drawn by their exact law.
EXACT = 512


@dataclass(frozen=True)
class Settings:
    """Words of the longest contexts, 1 or 2; where discounts and strengths of the root, of contexts of one word and of two start;
    sweeps before the root is known, after it, and samples. A sweep seats all customers anew."""

    context: int = 1

    root_discount: float = 0.7
    root_strength: float = 1.0
    discount: float = 0.8
    strength: float = 1.0
    far_discount: float = 0.9
    far_strength: float = 1.0
    early: int = 2
    burn: int = 2
    samples: int = 3
    seed: int = 11


# ---------------------------------------------------------------- seating


def first_seats(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, exact: int = 2048) -> np.ndarray:
    """Tables of dishes with c >= 1 customers: they come one by one, a new table has weight a, a table of n has n - d.

    For dishes of very many customers for which no draw of `_many_customers` fits. Up to `exact` customers are drawn singly, further ones in blocks of doubling size.
    """
    order = np.argsort(-c, kind="stable")
    left, weight, t = c[order], a[order], np.ones(len(c), dtype=np.int64)
    n, most = len(c), int(c.max()) if len(c) else 0
    seated = 1
    while seated < most:
        n = int(np.searchsorted(-left[:n], -seated, side="left"))  # dishes with more customers than are seated
        if seated < exact:
            t[:n] += rng.random(n) * (weight[:n] + seated - d * t[:n]) < weight[:n]
            seated += 1
        else:
            come = np.minimum(left[:n], 2 * seated) - seated
            t[:n] += rng.binomial(come, np.minimum(1.0, weight[:n] / (weight[:n] + 1.5 * seated - d * t[:n])))
            seated *= 2
    out = np.empty_like(t)
    out[order] = t
    return out


@lru_cache(maxsize=2)
def _ways(d: float) -> np.ndarray:
    """Logarithms of the weights of n customers at t tables, n and t up to EXACT: the sum over seatings of the weights n - d of joined tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    for n in range(1, EXACT):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n, :n], np.log(n - d * t) + out[n, 1 : n + 1])
        out[n + 1, n + 1] = 0
    return out


def _many_customers(c: int, a: float, d: float, rng: np.random.Generator, n: int = 32) -> np.ndarray:
    """Table sizes of a dish of c > EXACT customers. The law is that of a Poisson number of tables, a / d on average, whose sizes
    are Sibuya(d) and add up to c; a factor r ** size leaves it as it is. All tables but that of a random customer are drawn so, n times,
    and one of the n draws is taken by the weight of the size that is left."""
    gone = min(0.9, (a / c) ** (1 / (1 - d)))  # 1 - r, for which sizes add up to about c on average
    for _ in range(4):
        k = rng.poisson(a / d, max(4, min(n, int(2e6 * d / a) if a > 0 else n)))
        of = np.repeat(np.arange(len(k)), k)
        p = np.maximum(rng.beta(d, 1 - d, len(of)), 1e-15)
        size = np.minimum(np.maximum(rng.geometric(p), 1), c)
        stay = rng.random(len(of)) < (1 - gone) ** size
        of, size = of[stay], size[stay]
        left = c - np.bincount(of, size, len(k)).astype(np.int64)
        ok = np.flatnonzero(left > 0)
        if len(ok):
            weight = np.array([math.lgamma(x - d) - math.lgamma(x) + x * math.log1p(-gone) for x in left[ok].tolist()])
            weight = np.exp(weight - weight.max())
            one = ok[np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right").clip(0, len(ok) - 1)]
            return np.r_[size[of == one], left[one]]
    t = int(first_seats(np.array([c]), np.array([a]), d, rng)[0])
    return np.r_[np.ones(t - 1, dtype=np.int64), c - t + 1]


#: Dishes with customers of one of these spans are drawn together.
_SPANS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 19, 24, 30, 38, 48, 60, 76, 96, 122, 154, 194, 244, 308, 400, EXACT]


def seated(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, sizes: list | None = None) -> np.ndarray:
    """Tables of dishes with c customers, all of which sit down anew: a new table has weight a, a table of n has n - d.

    Numbers of tables come from their law given a; sizes of tables of dishes with more than EXACT customers go to `sizes`."""
    t = np.minimum(c, 1).astype(np.int64)
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(c[many], kind="stable")]
    size, low = c[many], 0
    ways, log_a = _ways(d), np.log(np.maximum(a, 1e-300))
    for most in _SPANS:
        high = int(np.searchsorted(size, most, side="right"))
        at = np.arange(1, most + 1)
        for k in range(low, high, step := max(1, (1 << 19) // most)):
            rows = many[k : min(k + step, high)]
            x = ways[c[rows].astype(np.int64), 1 : most + 1] + log_a[rows][:, None] * at
            x -= x.max(axis=1, keepdims=True)
            x = np.cumsum(np.exp(x, out=x), axis=1, out=x)
            t[rows] = 1 + (x < rng.random(len(rows))[:, None] * x[:, -1:]).sum(axis=1)
        low = high
    for r in many[low:].tolist():
        found = _many_customers(int(c[r]), float(a[r]), d, rng)
        t[r] = len(found)
        if sizes is not None:
            sizes.append(found)
    return t


class Seating:
    """One customer at a time, a plain way beside `seated`. Tables of dishes that have two customers or more, as sizes laid end to end: row r has tables[first[r]:first[r] + t[r]]."""

    def __init__(self, c: np.ndarray, t: np.ndarray, tables: np.ndarray | None = None):
        self.c, self.t = c.astype(np.int64), t.astype(np.int64)
        self.first = np.cumsum(self.t) - self.t
        if tables is None:
            tables = np.ones(int(self.t.sum()), dtype=np.int64)
            tables[self.first] = self.c - self.t + 1
        self.tables = tables.astype(np.int64)

    def sweep(self, a: np.ndarray, d: float, rng: np.random.Generator) -> None:
        """A Gibbs step for each dish: one customer, drawn at random, leaves and sits down anew: at a table of n others with
        weight n - d, at a new one with weight a. Weights of the contexts are those before the sweep."""
        if not len(self.c):
            return
        tables, row = self.tables, np.arange(len(self.c))
        ends = np.cumsum(tables)
        k = np.searchsorted(ends, ends[self.first] - tables[self.first] + rng.integers(0, self.c), side="right")
        tables[k] -= 1
        gone = tables[k] == 0
        t = self.t - gone
        old = self.c - 1 - d * t
        u = rng.random(len(row)) * (a + old) - a
        new = u < 0
        ends = np.cumsum(np.where(tables > 0, tables - d, 0.0))
        before = np.r_[0.0, ends][self.first]
        at = np.searchsorted(ends, before + np.maximum(u, 0), side="right")
        at = np.clip(at, self.first, self.first + self.t - 1)
        empty = ~new & (tables[at] == 0)  # rounding put it on the table that has just gone
        at[empty] = np.where(at[empty] > self.first[empty], at[empty] - 1, at[empty] + 1)
        tables[at[~new]] += 1
        tables[k[new & gone]] = 1
        more, less = new & ~gone, gone & ~new
        ends_at = (self.first + self.t)[more]
        dead = np.zeros(len(tables), dtype=bool)
        dead[k[less]] = True
        shift = np.cumsum(dead)
        place = ends_at - np.r_[0, shift][ends_at]
        self.tables = np.insert(tables[~dead], place, 1)
        self.t = self.t + more - less
        self.first = np.cumsum(self.t) - self.t


# ---------------------------------------------------------------- discounts and strengths


def _draws(values: np.ndarray, chance, rng: np.random.Generator) -> tuple[int, int]:
    """For each value draws for i = 1 .. value - 1, which are 1 with chance(i): their sum, and how many they are."""
    values = np.sort(values)
    top, hits, n_all = int(values[-1]) if len(values) else 0, 0, 0
    for low in range(1, top, 1 << 20):
        i = np.arange(low, min(low + (1 << 20), top))
        n = len(values) - np.searchsorted(values, i, side="right")
        hits, n_all = hits + int(rng.binomial(n, chance(i)).sum()), n_all + int(n.sum())
    return hits, n_all


def by_restaurants(c: np.ndarray, t: np.ndarray, d: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Auxiliary variables of restaurants with c customers at t tables: the sums of -log x, of y and of 1 - y.

    x is Beta(strength + 1, c - 1); there is a y for each table but the first, 1 with chance strength / (strength + d * i).
    """
    x = rng.beta(strength + 1, c[c > 1] - 1)
    y, n = _draws(t, lambda i: strength / (strength + d * i), rng)
    return np.array([-np.log(np.maximum(x, 1e-300)).sum(), y, n - y])


def by_tables(sizes: np.ndarray, d: float, rng: np.random.Generator) -> int:
    """The sum of 1 - z over customers but the first of tables: 1 with chance (1 - d) / (i - d) for the one after i."""
    return _draws(sizes, lambda i: (1 - d) / (i - d), rng)[0]


def by_dishes(c: np.ndarray, t: np.ndarray, sizes: list, d: float, rng: np.random.Generator) -> int:
    """The same sum given the tables of dishes: customers leave from the last to the second. The n-th had opened one of t tables or
    joined one, and 1 - z is 1 with chance t * (1 - d) / (n - 1 - d * t) then. Dishes of over EXACT customers have `sizes`."""
    out = by_tables(np.concatenate([np.zeros(0, dtype=np.int64), *sizes]), d, rng)
    out += by_tables(c[(t == 1) & (c > 1) & (c <= EXACT)].astype(np.int64), d, rng)
    rest = np.flatnonzero((t > 1) & (c <= EXACT))
    rest = rest[np.argsort(-c[rest].astype(np.int64), kind="stable")]
    left, t, ways, ones = -c[rest].astype(np.int64), t[rest].astype(np.int64), _ways(d), []
    for n in range(-int(left[0]) if len(left) else 1, 1, -1):
        m = int(np.searchsorted(left, -n, side="right"))
        now = t[:m]
        new = rng.random(m) < np.exp(ways[n - 1][now - 1] - ways[n][now])
        old = now[~new]
        out += int((rng.random(len(old)) * (n - 1 - d * old) < old * (1 - d)).sum())
        now -= new
    return out


def parameters(x: float, y: float, not_y: float, not_z: float, rng: np.random.Generator) -> tuple[float, float]:
    """Discount and strength given the sums of the auxiliary variables of all restaurants; priors Beta(1, 1) and Gamma(1, 1)."""
    d, strength = rng.beta(1 + not_y, 1 + not_z), rng.gamma(1 + y) / (1 + x)
    return float(np.clip(d, 1e-3, 1 - 1e-3)), float(max(strength, 1e-3))


# ---------------------------------------------------------------- arrays in binary columns


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; bytes of equal weight lie together, so that small numbers take little."""
    head = np.array([len(arrays), *[len(a) for a in arrays]], dtype=np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8)[k :: a.itemsize].tobytes() for a in arrays for k in range(a.itemsize)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *planes]))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    sizes = raw[: 8 * (len(kinds) + 1)].view(np.int64)[1:]
    out, at = [], 8 * (len(kinds) + 1)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        one = np.empty((n, size), dtype=np.uint8)
        for k in range(size):
            one[:, k] = raw[at + k * n : at + (k + 1) * n]
        out.append(one.view(kind).ravel())
        at += n * size
    return out


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 0, 1, 2, 2, ... : each place as often as its count."""
    return np.repeat(np.arange(len(counts)), counts)


def _steps(a: np.ndarray) -> np.ndarray:
    """Rising numbers as the first and the steps between them."""
    return np.diff(a, prepend=0).astype(np.uint32)


def _distinct(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different codes below size, rising, and the place of each code among them."""
    there = np.zeros(size, dtype=bool)
    there[codes] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int64) - 1)[codes]


# ---------------------------------------------------------------- words of documents


class Lexicon:
    """Frequent words, the most frequent first, with their training counts. A code is a place in it, or its size and a place
    among further words. Codes put listed words first, all others in the order of their ids, wherever they are made."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        self.order = np.argsort(ids).astype(np.uint32)

    def __len__(self) -> int:
        return len(self.ids)

    def codes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of different ids, and the ids of those that are not listed."""
        at = np.zeros(len(ids), dtype=np.int64)
        if len(self):
            at[:] = self.order[np.minimum(np.searchsorted(self.ids, ids, sorter=self.order), len(self) - 1)]
        far = self.ids[at] != ids if len(self) else np.ones(len(ids), dtype=bool)
        rare = np.sort(ids[far])
        at[far] = len(self) + np.searchsorted(rare, ids[far])
        return at, rare


def _lexicon(words: DataFrame, most: int) -> Lexicon:
    """The most frequent of words (word, n, n_all), `most` or somewhat fewer: those above a count."""
    step = F.floor(F.log2("n_all") * 16).cast("int")
    low, took = None, 0
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        took += r.n
        if took > most:
            break
        low = r.step
    found = words.where(step >= low if low is not None else F.lit(False)).select("word", "n", "n_all").toArrow()
    word, n, n_all = (found.column(k).to_numpy() for k in range(3))
    order = np.lexsort((word, -n_all))
    return Lexicon(word[order].view(np.uint64), n[order])


def _base(n: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
    """The smoothed unigram's log10 probability of words with n training tokens."""
    return np.log10((n + 0.5) / (tokens + 0.5 * (vocabulary + 1)))


def _ids(words: list[bytes], salt: bytes) -> np.ndarray:
    return np.frombuffer(b"".join([xxh3_64_digest(salt + w) for w in words]), dtype=np.uint64)


#: Arrays of a blob of words: ids, second hashes, n in training documents, n in all.
_WORDS = ("u8", "u8", "i8", "i8")


def _counts(salt: bytes, buckets: int):
    """Words of the documents of a task with their counts, summed in tables of bounded size, in blobs by bucket of their ids."""

    def run(batches):
        train: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()
        parts = []

        def flush():
            words = list(dict.fromkeys([*train, *other]))
            ids, check = _ids(words, salt), np.frombuffer(b"".join([xxh3_64_digest(w + b"\n" + salt) for w in words]), dtype=np.uint64)
            n, more = (np.fromiter((d.get(w, 0) for w in words), np.int64, len(words)) for d in (train, other))
            parts.append((ids, check, n, n + more))
            if len(parts) > 1:  # unlike second hashes stay apart, to be seen where they meet
                parts[:] = [_added(parts, True)]

        def out():
            ids, check, n, n_all = parts.pop()
            bucket = (ids % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((ids, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            there = np.flatnonzero(np.diff(cuts))
            blobs = [pack(*[x[order[cuts[b] : cuts[b + 1]]] for x in (ids, check, n, n_all)]) for b in there.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for held, text in zip(batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                (other if held else train).update([*(text or b"").lower().split(), END])
            if len(train) + len(other) > 200_000:
                flush()
                train, other = Counter(), Counter()
                if len(parts[0][0]) > 1_000_000:
                    yield out()
        if train or other:
            flush()
        if parts:
            yield out()

    return run


def _added(parts: list[tuple], apart: bool) -> list[np.ndarray]:
    """Blobs' arrays of words, by id, added up; of equal ids with unlike second hashes too, unless they are kept apart."""
    ids, check, n, n_all = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(ids, kind="stable")
    ids, check, n, n_all = ids[order], check[order], n[order], n_all[order]
    same = ids[1:] == ids[:-1]
    clash = same & (check[1:] != check[:-1])
    first = np.flatnonzero(np.r_[True, ~same | clash if apart else ~same])
    out = [ids[first], check[first], np.add.reduceat(n, first), np.add.reduceat(n_all, first)]
    return out if apart else [*out, np.logical_or.reduceat(np.r_[False, clash], first)]


def _add_counts(table: pa.Table) -> pa.Table:
    """Words of a bucket with their counts added up; `clash` are ids of words with unlike second hashes."""
    ids, _, n, n_all, clash = _added([tuple(unpack(b, *_WORDS)) for b in table.column("blob").to_pylist()], False)
    return pa.Table.from_arrays([pa.array(x) for x in (ids.view(np.int64), n, n_all, clash)], names=["word", "n", "n_all", "clash"])


def _shard_of(u: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a word pair: that of its context; of contexts too large for a shard, that of both words."""
    both = np.isin(u, hot)
    return (mix(np.where(both, u ^ mix(w), u)) % np.uint64(shards)).astype(np.int64)


#: Arrays of a blob of word pairs of a chunk, in the order of their codes: words that are not listed, steps between the codes of
#: contexts, pairs a context, code of each pair's word, training count.
_PAIRS = ("u8", "u4", "u4", "u4", "u4")
#: The same of triples: before the counts, which are those of triples, triples a pair and codes of the words before the contexts.
_TRIPLES = ("u8", "u4", "u4", "u4", "u4", "u4", "u4")
#: Arrays of a chunk's documents, which stay with it: pairs a shard; in that order documents a pair; documents, how often.
_DOCS = ("u4", "u4", "u4", "u4")
_CHUNK = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64()))])
_CHUNK_SQL = "shard long, chunk long, blob binary, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"


def _pairs(salt: bytes, hot: np.ndarray, lexicon: Lexicon, tokens: int, vocabulary: int, shards: int, chunk_tokens: int, triples: bool = False):
    """Documents in chunks: for each shard the chunk's word pairs (each with the words before it, if triples), and a row of documents,
    which pairs or triples they hold, and what listed words add to n_known and base."""
    start, listed = np.frombuffer(xxh3_64_digest(salt + START), dtype=np.uint64), len(lexicon)

    def flush(chunk: int, docs: list[tuple], words: list[np.ndarray]):
        n = np.array([len(t) for t in words])
        doc, held = _runs(n).astype(np.uint32), np.array([h for _, h in docs])
        ids, at = np.unique(np.r_[start, np.concatenate(words)], return_inverse=True)
        codes, rare = lexicon.codes(ids)
        order = np.argsort(codes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        ids, codes, at = ids[order], codes[order], rank[at]
        near = codes < listed
        count = lexicon.counts[codes[near]]
        value = np.zeros((2, len(codes)))
        value[:, near] = count > 0, _base(count, tokens, vocabulary)
        n_known, base = (np.bincount(doc, x[at[1:]], len(n)) for x in value)
        before = at[:-1].copy()
        before[np.cumsum(n) - n] = at[0]
        code = before * len(ids) + at[1:]
        if triples:
            seen = None
            if len(ids) > 2_000_000:  # three places would not fit a long
                seen, code = np.unique(code, return_inverse=True)
            second = np.r_[at[0], before[:-1]]
            second[np.cumsum(n) - n] = at[0]
            code = code * len(ids) + second
        order = np.argsort(code, kind="stable")  # documents of a pair stay in order
        code, doc = code[order], doc[order]
        new = np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(new)
        often = np.diff(np.r_[first, len(code)]).astype(np.uint32)
        code, doc = code[first], doc[first]
        pair = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n_docs = np.diff(np.r_[pair, len(code)])
        train = np.add.reduceat(np.where(held[doc], 0, often), pair).astype(np.uint32)
        code = code[pair]
        if triples:
            code, px = np.divmod(code, len(ids))
            code, px = code if seen is None else seen[code], codes[px]
        pu, pw = np.divmod(code, len(ids))
        shard = _shard_of(ids[pu], ids[pw], hot, shards)
        by = np.argsort(shard.astype(np.min_scalar_type(shards)), kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]
        pu, pw, train, n_docs, pair = codes[pu[by]], codes[pw[by]], train[by], n_docs[by], pair[by]
        px = px[by] if triples else None
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            mine = slice(cuts[s], cuts[s + 1])
            u, w = pu[mine].copy(), pw[mine].copy()
            if triples:
                x, first_w = px[mine].copy(), np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
                a_pair, u, w = np.diff(np.r_[first_w, len(u)]).astype(np.uint32), u[first_w], w[first_w]
            first_u = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            a_context, u = np.diff(np.r_[first_u, len(u)]).astype(np.uint32), u[first_u]
            every = [u, w, x] if triples else [u, w]
            far = np.unique(np.concatenate([k[k >= listed] for k in every]))
            for k in every:
                rest = np.flatnonzero(k >= listed)
                k[rest] = listed + np.searchsorted(far, k[rest])
            u, w, *x = every
            more = [a_pair, x[0].astype(np.uint32)] if triples else []
            yield (s, chunk, pack(rare[far - listed], _steps(u), a_context, w.astype(np.uint32), *more, train[mine]), *[None] * 5)
        held_by = np.repeat(pair - (np.cumsum(n_docs) - n_docs), n_docs) + np.arange(len(doc))
        blob = pack(np.diff(cuts).astype(np.uint32), n_docs.astype(np.uint32), doc[held_by], often[held_by])
        yield (shards + chunk, chunk, blob, [d for d, _ in docs], held.tolist(), n.tolist(), n_known.astype(np.int64).tolist(), base.tolist())

    def run(batches):
        chunk = TaskContext.get().partitionId() << 20
        docs, words, size = [], [], 0

        def out(rows):
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(r, _CHUNK, strict=True)], schema=_CHUNK)

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))
            for doc_id, held, text in zip(*cols, strict=True):
                docs.append((doc_id, held))
                words.append(_ids([*(text or b"").lower().split(), END], salt))
                size += len(words[-1])
                if size >= chunk_tokens:
                    yield from out(flush(chunk, docs, words))
                    docs, words, size, chunk = [], [], 0, chunk + 1
        if docs:
            yield from out(flush(chunk, docs, words))

    return run


# ---------------------------------------------------------------- restaurants


class Shard:
    """Word pairs of a shard: contexts and words by code and by id, pairs (cu, cw) as places among them; what each pair was before,
    `of`: the pair itself, or triples (pair, x), where x is a place among the words before. Training counts c of pairs or triples, the places
    of each chunk's in the order in which the chunk sent them, tables t of pairs and t3 of triples. Contexts that are dealt over
    shards are `hot`; their totals come from outside."""

    KINDS = ("u8", "u4", "u4", "u4", "u4", "u4", "i8", "u4", "u4", "u4", "u4", "u4", "u4", "u4")

    def __init__(self, ids: np.ndarray, arrays: list[np.ndarray]):
        self.rare, u, w, self.a_context, self.cw, self.c, self.chunks, self.n_pairs, self.steps, self.t, xs, self.a_pair, self.x, self.t3 = arrays
        self.cu, every = _runs(self.a_context), np.r_[ids, self.rare]
        self.u_codes, self.w_codes, self.x_codes = (np.cumsum(k, dtype=np.int64) for k in (u, w, xs))
        self.u, self.w, self.before, self.listed = every[self.u_codes], every[self.w_codes], every[self.x_codes], len(ids)
        self.triples = len(self.x) > 0
        if self.triples:
            self.of = _runs(self.a_pair)
            pairs, self.at = np.unique(self.cu[self.of] * len(self.before) + self.x, return_inverse=True)
            self.far_u, self.far_x = np.divmod(pairs, len(self.before))
            ones = np.minimum(self.c, 1)  # tables of contexts and customers of pairs if each dish had one table
            self.single = np.bincount(self.at, ones, len(pairs)), self.customers(ones)
        else:
            self.of = np.arange(len(self.cw))

    @classmethod
    def merged(cls, ids: np.ndarray, chunks: list[int], blobs: list[bytes], triples: bool = False) -> Shard:
        parts = [unpack(b, *(_TRIPLES if triples else _PAIRS)) for b in blobs]
        rare, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        low = np.cumsum([0, *[len(p[0]) for p in parts]])

        def codes(of: list[np.ndarray]) -> np.ndarray:
            code, shift = np.concatenate(of).astype(np.int64), np.repeat(low[:-1], [len(x) for x in of])
            far = np.flatnonzero(code >= len(ids))
            code[far] = len(ids) + where[code[far] - len(ids) + shift[far]]
            return code

        size = len(ids) + len(rare)
        us, cu = _distinct(np.repeat(codes([np.cumsum(p[1], dtype=np.int64) for p in parts]), np.concatenate([p[2] for p in parts])), size)
        ws, cw = _distinct(codes([p[3] for p in parts]), size)
        code, place = np.unique(cu * len(ws) + cw, return_inverse=True)
        pair, xs, a_pair, x = code, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
        if triples:
            xs, x = _distinct(codes([p[5] for p in parts]), size)
            code, place = np.unique(np.repeat(place, np.concatenate([p[4] for p in parts])) * len(xs) + x, return_inverse=True)
            a_pair, x = np.bincount(code // len(xs), minlength=len(pair)), code % len(xs)
        c = np.bincount(place, np.concatenate([p[-1] for p in parts]), len(code)).astype(np.uint32)
        n_pairs = np.array([len(p[-1]) for p in parts])
        first = np.cumsum(n_pairs) - n_pairs
        steps = np.diff(place, prepend=0)  # pairs of a chunk come in the order that they have here
        steps[first] = place[first]
        none = np.zeros(0, dtype=np.uint32)
        return cls(ids, [
            rare, _steps(us), _steps(ws), np.bincount(pair // len(ws), minlength=len(us)), pair % len(ws), c,
            np.array(chunks, dtype=np.int64), n_pairs, steps, none, _steps(xs), a_pair, x, none,
        ])

    def pack(self) -> bytes:
        codes = [_steps(k) for k in (self.u_codes, self.w_codes, self.x_codes)]
        a = (self.rare, *codes[:2], self.a_context, self.cw, self.c, self.chunks, self.n_pairs, self.steps, self.t, codes[2], self.a_pair, self.x, self.t3)
        return pack(*[x.astype(k) for x, k in zip(a, self.KINDS, strict=True)])

    def places(self):
        """The places of each chunk's pairs."""
        ends = np.cumsum(self.n_pairs, dtype=np.int64)
        for chunk, low, high in zip(self.chunks.tolist(), ends - self.n_pairs, ends, strict=True):
            yield chunk, np.cumsum(self.steps[low:high], dtype=np.int64)

    def by_root(self, shards: int, hot: np.ndarray):
        """The root's shards with the places of the words that they have, of which the listed ones come first, and with the
        contexts of two words whose later word is hot, by the earlier one."""
        to = (mix(self.w) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(shards + 1))
        dealt = np.flatnonzero(np.isin(self.u, hot)[self.far_u]) if self.triples else np.zeros(0, dtype=np.int64)
        far_to = (mix(self.before[self.far_x[dealt]]) % np.uint64(shards)).astype(np.int64) if len(dealt) else dealt
        far_by = dealt[np.argsort(far_to, kind="stable")]
        far_cuts = np.searchsorted(np.sort(far_to), np.arange(shards + 1))
        for r in np.flatnonzero(np.diff(cuts) + np.diff(far_cuts)).tolist():
            mine = by[cuts[r] : cuts[r + 1]]
            yield r, mine, int(np.searchsorted(self.w_codes[mine], self.listed)), far_by[far_cuts[r] : far_cuts[r + 1]]

    def totals(self, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context, as far as they are in this shard."""
        first = np.cumsum(self.a_context, dtype=np.int64) - self.a_context
        return np.add.reduceat(c, first), np.add.reduceat(t, first)

    def far_totals(self, t3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of contexts of two words."""
        return np.bincount(self.at, self.c, len(self.far_u)), np.bincount(self.at, t3, len(self.far_u))

    def customers(self, t3: np.ndarray) -> np.ndarray:
        """Customers of pairs: training counts, or the tables of their triples."""
        if not self.triples:
            return self.c.astype(np.int64)
        return np.add.reduceat(t3, np.cumsum(self.a_pair, dtype=np.int64) - self.a_pair, dtype=np.int64)

    def after_one(self, c: np.ndarray, t: np.ndarray, outside, above: np.ndarray, s: Settings, pairs=slice(None)) -> np.ndarray:
        """Chances of pairs after one word, `above` being those of words; `outside` changes the totals that a context has here."""
        n, tables = outside(*self.totals(c, t))
        cu = self.cu[pairs]
        return (c[pairs] - s.discount * t[pairs] + (s.strength + s.discount * tables)[cu] * above[self.cw[pairs]]) / (s.strength + n)[cu]

    def seat_pairs(self, c: np.ndarray, t: np.ndarray, outside, above: np.ndarray, s: Settings, rng: np.random.Generator, sizes: list | None = None) -> np.ndarray:
        """Tables of pairs, whose customers all sit down anew: a dish of one customer has one table whatever the weights are."""
        tables = outside(*self.totals(c, t))[1]
        many = np.flatnonzero(c > 1)
        t = np.minimum(c, 1)
        t[many] = seated(c[many], (s.strength + s.discount * tables)[self.cu[many]] * above[self.cw[many]], s.discount, rng, sizes)
        return t

    def seat_triples(self, c: np.ndarray, t: np.ndarray, t3: np.ndarray, outside, far_outside, above: np.ndarray, s: Settings, rng: np.random.Generator, sizes: list | None = None):
        """The same of triples, and the customers that pairs have then."""
        many = np.flatnonzero(self.c > 1)
        of, at, far_u = self.of[many], self.at[many], len(self.far_u)
        ones = np.minimum(self.c, 1)
        tables = self.single[0] + np.bincount(at, t3[many] - 1, far_u) + far_outside
        weight = (s.far_strength + s.far_discount * tables[at]) * self.after_one(c, t, outside, above, s, of)
        t3 = ones.astype(np.int64)
        t3[many] = seated(self.c[many], weight, s.far_discount, rng, sizes)
        return t3, self.single[1] + np.bincount(of, t3[many] - 1, len(self.cw)).astype(np.int64)


#: Beside the root's words, contexts of two words that are dealt: ids of earlier words that are not listed, steps between (place
#: of the hot word, code of the earlier word) in one number, customers, tables.
_FAR = ("u8", "u8", "u4", "u4")


def _far_codes(one: Shard, hot: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and steps of contexts of two words as _FAR has them; `far` is in the order of codes after."""
    code = one.x_codes[one.far_x[far]]
    rare = np.unique(code[code >= one.listed])
    place = np.searchsorted(np.sort(hot), one.u[one.far_u[far]])
    code = np.where(code < one.listed, code, one.listed + np.searchsorted(rare, code))
    key = place * (one.listed + len(rare)) + code
    order = np.argsort(key)
    far[:] = far[order]
    return one.rare[rare - one.listed], np.diff(key[order], prepend=0).astype(np.uint64)


def _early(hot: np.ndarray, ids: np.ndarray, shards: int, vocabulary: int, s: Settings):
    """Merge a shard's word pairs, seat their customers, and tell the root's shards what its customers are."""

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        empty = {"shard": key[0].as_py(), "chunk": None, "blob": None, "doc_id": None, "held_out": None, "n_tokens": None, "n_known": None, "base": None, "root": None, "hot_u": None, "hot_c": None, "hot_t": None, "tables": 0, "aux": None}
        if key[0].as_py() >= shards:
            return pa.Table.from_pylist([empty | r for r in rows], schema=_STATE)
        one = Shard.merged(ids, [r["chunk"] for r in rows], [r["blob"] for r in rows], s.context == 2)
        rng = np.random.default_rng([s.seed, empty["shard"], 0])
        scale = np.where(np.isin(one.u, hot), shards, 1)
        t3 = np.minimum(one.c, 1).astype(np.int64) if one.triples else np.zeros(0, dtype=np.int64)
        c = one.customers(t3)
        t = np.minimum(c, 1)

        def scaled(n, tables):
            return n * scale, tables * scale

        for k in range(s.early + 1):
            # the root is not known yet: the share of this shard's tables, which are as those of the others
            root = np.bincount(one.cw, t, len(one.w))
            p = (np.maximum(root - s.root_discount, 0) + s.root_discount * np.count_nonzero(root) / (vocabulary + 1)) / max(t.sum(), 1) + 1e-12
            if one.triples:
                t3, c = one.seat_triples(c, t, t3, scaled, 0, p, s, rng, sizes3 := [])
            t = one.seat_pairs(c, t, scaled, p, s, rng, sizes := [])
        one.t, one.t3 = t, t3
        n, tables = one.totals(c, t)
        whole = ~np.isin(one.u, hot)  # totals of dealt contexts are known after the exchange
        aux = [*by_restaurants(n[whole], tables[whole].astype(np.int64), s.discount, s.strength, rng).tolist(), by_dishes(c, t, sizes, s.discount, rng)]
        if one.triples:
            far_n, far_tables = one.far_totals(t3)
            mine = whole[one.far_u]
            aux += [*by_restaurants(far_n[mine], far_tables[mine].astype(np.int64), s.far_discount, s.far_strength, rng).tolist(), by_dishes(one.c, t3, sizes3, s.far_discount, rng)]
        out = [empty | {"blob": one.pack(), "tables": int(t.sum()), "aux": aux}]
        customers, known = np.bincount(one.cw, t, len(one.w)).astype(np.uint32), np.bincount(one.cw[one.of], one.c, len(one.w)).astype(np.uint64)
        for r, mine, near, far in one.by_root(shards, hot):
            arrays = [_steps(one.w_codes[mine[:near]]), one.w[mine[near:]], customers[mine], known[mine[near:]]]
            if one.triples:
                arrays += [*_far_codes(one, hot, far), far_n[far].astype(np.uint32), far_tables[far].astype(np.uint32)]
            out.append(empty | {"root": r, "blob": pack(*arrays)})
        mine = np.flatnonzero(~whole)
        if len(mine):
            out[0] |= {"hot_u": one.u[mine].view(np.int64).tolist(), "hot_c": n[mine].astype(int).tolist(), "hot_t": tables[mine].astype(int).tolist()}
        return pa.Table.from_pylist(out, schema=_STATE)

    return run


_STATE = pa.schema([*_CHUNK, ("root", pa.int32()), ("hot_u", pa.list_(pa.int64())), ("hot_c", pa.list_(pa.int64())), ("hot_t", pa.list_(pa.int64())), ("tables", pa.int64()), ("aux", pa.list_(pa.float64()))])
_STATE_SQL = _CHUNK_SQL + ", root int, hot_u array<long>, hot_c array<long>, hot_t array<long>, tables long, aux array<double>"
_DOWN = pa.schema([("shard", pa.int64()), ("root", pa.int32()), ("blob", pa.binary()), ("tables", pa.list_(pa.int64())), ("not_z", pa.list_(pa.int64())), ("aux", pa.list_(pa.float64()))])


def _root(ids: np.ndarray, customers: int, vocabulary: int, s: Settings):
    """Seat the root's customers, all tables of the contexts, and tell each shard what its words have at the root; add up the
    contexts of two words that are dealt over shards."""

    def run(key, table):
        rows = sorted(table.select(["shard", "blob"]).to_pylist(), key=lambda r: r["shard"])
        parts, fars = [], []
        for r in rows:
            near, far, c, known, *more = unpack(r["blob"], "u4", "u8", "u4", "u8", *(_FAR if s.context == 2 else ()))
            parts.append((np.r_[ids[np.cumsum(near, dtype=np.int64)], far], c, np.r_[np.zeros(len(near), dtype=np.uint64), known], len(near)))
            fars.append(more)
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(at, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        known = np.bincount(at, np.concatenate([p[2] for p in parts]), len(words)).astype(np.uint64)
        rng = np.random.default_rng([s.seed, key[0].as_py(), 1])
        t = np.minimum(c, 1)
        total = len(words)  # tables of the root, of which this is a share
        samples, tables, not_z = [], [], []
        for k in range(s.burn + s.samples):
            sizes = []
            t = seated(c, np.full(len(c), (s.root_strength + s.root_discount * min(total, vocabulary)) / (vocabulary + 1)), s.root_discount, rng, sizes)
            total = t.sum() / max(c.sum(), 1) * customers
            if k >= s.burn:
                samples.append(t.astype(np.uint32))
                tables.append(int(t.sum()))
                not_z.append(by_dishes(c, t, sizes, s.root_discount, rng))
        far_totals, aux = _far_sums(fars, len(ids), s, rng) if s.context == 2 else ([[]] * len(rows), None)
        out, low = [], 0
        for k, (r, p) in enumerate(zip(rows, parts, strict=True)):
            mine = at[low : low + len(p[0])]
            low += len(p[0])
            sums = {"tables": tables, "not_z": not_z, "aux": aux} if k == 0 else {"tables": None, "not_z": None, "aux": None}
            out.append({"shard": r["shard"], "root": key[0].as_py(), "blob": pack(known[mine[p[3] :]], c[mine].astype(np.uint32), *[x[mine] for x in samples], *far_totals[k])} | sums)
        return pa.Table.from_pylist(out, schema=_DOWN)

    return run


def _far_sums(fars: list[list[np.ndarray]], listed: int, s: Settings, rng: np.random.Generator) -> tuple[list[list[np.ndarray]], list[float]]:
    """Customers and tables of dealt contexts of two words, added up, in the order of each part; auxiliary variables of them all."""
    rare, where = np.unique(np.concatenate([f[0] for f in fars]), return_inverse=True)
    keys, low = [], 0
    for ids, steps, *_ in fars:
        place, code = np.divmod(np.cumsum(steps.astype(np.int64)), max(listed + len(ids), 1))
        far = np.flatnonzero(code >= listed)
        code[far] = listed + where[low + code[far] - listed]
        low += len(ids)
        keys.append(place * (listed + len(rare)) + code)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n, tables = (np.bincount(at, np.concatenate([f[k] for f in fars]), len(key)).astype(np.int64) for k in (2, 3))
    aux = by_restaurants(n, tables, s.far_discount, s.far_strength, rng)
    ends = np.cumsum([len(k) for k in keys])
    return [[x[at[e - len(k) : e]].astype(np.uint32) for x in (n, tables)] for k, e in zip(keys, ends, strict=True)], aux.tolist()


_FOUND = pa.schema([("of", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())])
_FOUND_SQL = "of long, shard long, blob binary"


def _scores(hot: dict[int, tuple[int, int]], ids: np.ndarray, vocabulary: int, customers: int, root_tables: list[int], root: list[tuple[float, float]], shards: int, s: Settings):
    """Sample on with the root's tables, of which each sample has its discount and strength; predictive probabilities, averaged over samples,
    of each chunk's pairs in single precision, and 1 + the training count of words that are not listed."""

    def run(key, state, down):
        if not state.num_rows:
            return pa.Table.from_pylist([], schema=_FOUND)
        one = Shard(ids, unpack(state.column("blob")[0].as_py(), *Shard.KINDS))
        # a word that no training text has shares what the root keeps for new tables
        left = [(b + a * t) / (b + customers) / (vocabulary + 1) for t, (a, b) in zip(root_tables, root, strict=True)]
        roots = [np.full(len(one.w), v) for v in left]
        known = np.zeros(len(one.w), dtype=np.int64)
        t, t3 = one.t.astype(np.int64), one.t3.astype(np.int64)
        c = one.customers(t3)
        if one.triples:
            far_c, far_t = (x.astype(np.int64) for x in one.far_totals(t3))
            far_outside = np.zeros(len(far_t))  # tables of a dealt context in other shards
        blobs = dict(zip(down.column("root").to_pylist(), down.column("blob").to_pylist(), strict=True))
        hot_ids = np.array(sorted(hot), dtype=np.int64).view(np.uint64)
        for r, mine, near, far in one.by_root(shards, hot_ids):
            got = unpack(blobs[r], "u8", "u4", *["u4"] * s.samples, *(("u4", "u4") if one.triples else ()))
            known[mine[near:]] = got[0].astype(np.int64)
            for x, tables, (a, b) in zip(roots, got[2 : 2 + s.samples], root, strict=True):
                x[mine] += (got[1] - a * tables) / (b + customers)
            if one.triples:
                _far_codes(one, hot_ids, far)  # puts them in the order in which they were sent
                far_c[far], far_outside[far] = got[-2], got[-1].astype(np.int64) - far_t[far]
        rng = np.random.default_rng([s.seed, key[0].as_py(), 2])
        dealt = np.array([int(x) in hot for x in one.u.view(np.int64)], dtype=bool)
        n, began = one.totals(c, t)
        outside = np.zeros((2, len(one.u)))  # customers and tables of a dealt context in other shards
        for k in np.flatnonzero(dealt):
            outside[:, k] = np.array(hot[int(one.u.view(np.int64)[k])]) - (n[k], began[k])

        def whole(n, tables):
            return n + outside[0], tables + outside[1]

        p = np.zeros(len(one.c))
        for k in range(s.burn + s.samples):
            above = roots[max(0, k - s.burn)]
            if one.triples:
                t3, c = one.seat_triples(c, t, t3, whole, far_outside, above, s, rng)
            t = one.seat_pairs(c, t, whole, above, s, rng)
            if k < s.burn:
                continue
            chance = one.after_one(c, t, whole, above, s)
            if one.triples:
                tables = one.far_totals(t3)[1] + far_outside
                chance = (one.c - s.far_discount * t3 + (s.far_strength + s.far_discount * tables)[one.at] * chance[one.of]) / (s.far_strength + far_c)[one.at]
            p += chance
        score = np.log10(p / s.samples).astype(np.float32)
        count = np.where(one.w_codes < one.listed, 0, known + 1).astype(np.uint32)[one.cw[one.of]]
        me = key[0].as_py()
        out = [[shards + chunk, me, pack(score[at], count[at])] for chunk, at in one.places()]
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def _totals(tokens: int, vocabulary: int):
    """Documents of a chunk with the sums over their pairs."""

    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        row = docs.to_pylist()[0]
        a_shard, n_docs, doc, often = unpack(row["blob"], *_DOCS)
        ends = np.cumsum(a_shard, dtype=np.int64)
        score, count = np.full(len(n_docs), np.nan), np.zeros(len(n_docs), dtype=np.int64)
        for r in found.to_pylist():
            mine = slice(ends[r["shard"]] - a_shard[r["shard"]], ends[r["shard"]])
            score[mine], count[mine] = unpack(r["blob"], "f4", "u4")
        base = np.where(count > 0, _base(np.maximum(count - 1, 0), tokens, vocabulary), 0)
        pair = _runs(n_docs)
        known, base, score = (np.bincount(doc, often * x[pair], len(row["doc_id"])) for x in (count > 1, base, score))
        n_known = np.array(row["n_known"]) + known.astype(np.int64)
        cols = [pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(row["n_tokens"], pa.int64()), *map(pa.array, (n_known, np.array(row["base"]) + base, score))]
        return pa.Table.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, settings: Settings = Settings(), shard_tokens: int = SHARD_TOKENS, chunk_tokens: int = CHUNK_TOKENS, listed: int = LISTED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id long, text).

    Held out are texts whose crc32(doc_id as text) leaves 1 when divided by 5; all others, those without doc_id too, train
    the model. Tokens are lower-cased words, then one end; null and empty texts have the end only. base_score is the smoothed
    unigram's log10 probability, score that of the model: a restaurant for each word as context (with Settings(context=2)
    below it one for each two words), which all share the root as parent, and the root one uniform distribution over the training words and one unknown word. Repeated rows are scored, and
    counted, each on its own. An empty table gives no rows; further columns are not read.

    Words are known by 64-bit XXH3 under a salt for which, by a second hash, no two words of docs share a value. Documents
    are gathered in chunks, whose word pairs go to shards by context; contexts with more customers than a quarter of a shard
    are dealt over all shards by word, their contexts of two words with them. Shards seat their customers; the root's customers are dealt by word; shards sample on
    with the root's tables. Which documents hold a pair stays with the chunk, to which shards send a number for each of its
    pairs; the `listed` most frequent words, at most, travel by their place in a list. Tables of dealt contexts and of the root are those before the last exchange. Discount and strength of
    the contexts, and those of the root for each sample, are drawn by auxiliary variables, whose sums over shards are added up.
    """
    if settings.context not in (1, 2):
        raise ValueError("contexts have one word or two")
    prepare(docs.sparkSession)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    docs = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    s, salt, partitions = settings, 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        name = str(salt).encode()
        words = docs.mapInArrow(_counts(name, 4 * partitions), "bucket int, blob binary").groupBy("bucket")
        words = written(words.applyInArrow(_add_counts, "word long, n long, n_all long, clash boolean"), "words")
        clash, tokens, every, vocabulary = words.agg(F.bool_or("clash"), F.sum("n"), F.sum("n_all"), F.count_if(F.col("n") > 0)).first()
        if not clash:
            break
        salt += 1
    tokens, every, vocabulary = tokens or 0, every or 0, vocabulary or 0
    shards = max(1, -(-every // shard_tokens))
    # at most 4 * shards words can be that frequent
    hot = np.array([r.word for r in words.where(F.col("n_all") > every / (4 * shards)).select("word").collect()] if shards > 1 else [], dtype=np.int64).view(np.uint64)
    start, end = (np.frombuffer(xxh3_64_digest(name + w), dtype=np.uint64) for w in (START, END))
    if np.isin(end, hot).any():  # as many first words as ends
        hot = np.r_[hot, start]
    lexicon = _lexicon(words, listed)
    ids = lexicon.ids
    pairs = docs.mapInArrow(_pairs(name, hot, lexicon, tokens, vocabulary, shards, chunk_tokens, s.context == 2), _CHUNK_SQL)
    # a bucketed table: the seats of a shard and the documents of a chunk are read again where they lie, without a shuffle
    spark, seats = docs.sparkSession, f"seats_{uuid.uuid4().hex}"
    early = pairs.groupBy("shard").applyInArrow(_early(hot, ids, shards, vocabulary, s), _STATE_SQL)
    early.write.bucketBy(partitions, "shard").option("path", scratch(spark, "seats")).saveAsTable(seats)
    state = spark.table(seats)
    shard_rows = state.where((F.col("shard") < shards) & F.col("root").isNull())
    customers = shard_rows.agg(F.sum("tables")).first()[0] or 0
    dealt = shard_rows.select(F.inline(F.arrays_zip("hot_u", "hot_c", "hot_t"))).groupBy("hot_u").agg(F.sum("hot_c").alias("c"), F.sum("hot_t").alias("t"))
    dealt = {r.hot_u: (r.c, r.t) for r in dealt.collect()}
    # four sums of each shard, or eight, added in the order of shards; dealt contexts, which have their totals now, are added here
    rng = np.random.default_rng([s.seed, 3])
    aux = [r.aux for r in shard_rows.select("shard", "aux").orderBy("shard").collect()]
    totals = np.array([dealt[u] for u in sorted(dealt)], dtype=np.int64).reshape(-1, 2)
    own = [*by_restaurants(totals[:, 0], totals[:, 1], s.discount, s.strength, rng), 0, *[0] * (4 * (s.context == 2))]
    aux = np.sum([*aux, own], axis=0)
    context = parameters(*aux[:4], rng)
    up = state.where("root is not null").select("root", "shard", "blob")
    down = written(up.groupBy("root").applyInArrow(_root(ids, customers, vocabulary, s), "shard long, root int, blob binary, tables array<long>, not_z array<long>, aux array<double>"), "root")
    sums = down.where("tables is not null").select(F.posexplode(F.arrays_zip("tables", "not_z")).alias("k", "x"))
    found = sums.groupBy("k").agg(F.sum("x.tables").alias("t"), F.sum("x.not_z").alias("z")).orderBy("k").collect()
    root_tables = [r.t for r in found] or [0] * s.samples
    roots = []
    for t, z in zip(root_tables, [r.z for r in found] or [0] * s.samples, strict=True):
        one = by_restaurants(np.array([customers]), np.array([t]), s.root_discount, s.root_strength, rng)
        roots.append(parameters(*one, z, rng))
    s = replace(s, discount=context[0], strength=context[1])
    if s.context == 2:
        more = [r.aux for r in down.where("aux is not null").select("root", "aux").orderBy("root").collect()]
        far = parameters(*np.sum([aux[4:], *[[*x, 0] for x in more]], axis=0), rng)
        s = replace(s, far_discount=far[0], far_strength=far[1])
    given = down.select(F.col("shard").alias("of"), "root", "blob")
    found = shard_rows.select("shard", "blob").groupBy("shard").cogroup(given.groupBy("of")).applyInArrow(
        _scores(dealt, ids, vocabulary, customers, root_tables, roots, shards, s), _FOUND_SQL
    )
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    chunks = state.where(F.col("shard") >= shards).select("shard", "blob", "doc_id", "held_out", "n_tokens", "n_known", "base")
    out = written(chunks.groupBy("shard").cogroup(found.groupBy("of")).applyInArrow(_totals(tokens, vocabulary), schema), "scored")
    spark.sql(f"DROP TABLE {seats}")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, Settings(context=2))
