"""SimHash near-dedup by pigeonhole blocks."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import components, mix, prepare, span_hash, word_hashes, written
from brindle.llm.groups import cells, near_pairs, stars, whole_groups


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Bit i is set if it is in over half of the XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    if n == 1:
        got = [h(b" ".join(w), 42)]
    else:
        line, at = b" ".join(w), list(itertools.accumulate((len(x) + 1 for x in w), initial=0))
        got = [h(line[a : b - 1], 42) for a, b in zip(at, at[words:], strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.array(got[k : k + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(words: int):
    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in texts.to_pylist()], pa.int64())

    return simhash


def masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all choices of blocks - distance blocks: two fingerprints within the distance agree on one of them."""
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in itertools.pairwise(cut)]
    return [sum(c) for c in itertools.combinations(each, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys have about as many values as there are fingerprints, so that groups stay small."""
    b = distance + 1
    while b < distance + 6 and 64 * (b - distance) / b < math.log2(max(n, 2)) - 2:
        b += 1
    return b


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(distance: int):
    names = ["table", "key", "cell_a", "cell_b"]

    def linked(batches):
        for table, group in whole_groups(batches, names):
            col = {c: table.column(c).to_numpy() for c in ("fp", "rep", "part", "cell_a", "cell_b")}
            fp = col["fp"].view(np.uint64)
            test = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= distance
            i, j = near_pairs(group, col["cell_a"] == col["cell_b"], col["part"], test)
            if len(i):
                a, b = stars(col["rep"], i, j)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return linked


def simhash_groups(docs: DataFrame, words: int = 4, distance: int = 4, chunk: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Fingerprints that differ in `distance` bits or fewer are linked, also those of empty and null texts (0).
    component_id is the smallest doc_id that links reach. Equal fingerprints become one node first, so copies cost one
    row; nodes meet in the tables of pigeonhole blocks (blocks_for chooses their number from the count of distinct
    fingerprints; every choice is exact) and are compared in bounded cells. Rows of null doc_id get the component of
    their fingerprint, or null if no other row has one; repeated rows give repeated rows; an empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    sig = written(docs.select("doc_id", _fingerprints(words)(F.col("text").cast("binary")).alias("fp")), "fps")
    classes = written(sig.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    nodes = classes.where("rep is not null")
    tables = masks(blocks_for(nodes.count(), distance), distance)
    keys = F.explode(F.array(*[
        F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for k, m in enumerate(tables)
    ]))
    keyed = nodes.withColumn("k", keys).select("k.table", "k.key", "fp", "rep")
    edges = cells(keyed, ["table", "key"], "rep", chunk).mapInArrow(_links(distance), "a long, b long")
    found = components(edges).withColumnRenamed("node", "rep")
    named = classes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return sig.join(named, "fp").select("doc_id", "fp", "component_id")


def word_set_fingerprint(text: bytes | None) -> int:
    """As fingerprint, over the set of words: it moves little when single words of a text change."""
    words = set((text or b"").lower().split())
    if not words:
        return 0
    bits = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(words)).tobytes(), "big", signed=True)


def shingles_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the word shingles of a text in order (fewer words: of the whole sequence; none: empty)."""
    if not len(hashes):
        return hashes
    at = np.arange(max(1, len(hashes) - words + 1))
    return span_hash(hashes, at, np.minimum(at + words, len(hashes)))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted hashes of the word shingles of a lower-cased text."""
    return np.unique(shingles_of(word_hashes((text or b"").lower())[0], words))


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=">i8")
    return int(both[0]), int(both[1])


#: Bands and minima a band, over the pairs of consecutive words: two texts whose pairs have a Jaccard similarity of j share
#: no band with probability (1 - j ** 7) ** 60: 7e-7 at 0.8, 0.006 at 0.7, however the texts differ.
PAIR, BANDS, ROWS = 2, 60, 7
_TURNS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """MinHash: BANDS keys of a set of hashes, each of the smallest values under ROWS functions; none of an empty set."""
    if not len(shingles):
        return shingles
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 256):
        low = np.minimum(low, (_TURNS[:, None] * shingles[None, k : k + 256]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(mix(key) ^ column)
    return key


def _marks(words: int):
    @F.arrow_udf("struct<fp:long,h1:long,h2:long,bands:array<long>>")
    def marks(texts: pa.Array) -> pa.Array:
        fps, digests, bands = [], [], []
        for t in texts.to_pylist():
            hashes = word_hashes((t or b"").lower())[0]
            fps.append(word_set_fingerprint(t))
            digests.append(_digest(np.unique(shingles_of(hashes, words))))
            bands.append(band_keys(np.unique(shingles_of(hashes, PAIR))).view(np.int64))
        cols = [pa.array(c, pa.int64()) for c in (fps, [x for x, _ in digests], [y for _, y in digests])]
        return pa.StructArray.from_arrays([*cols, pa.array(bands, pa.list_(pa.int64()))], names=["fp", "h1", "h2", "bands"])

    return marks


def _same_band(batches):
    """Edges from each row of a key to the key's first row; rows are sorted by key, only the first is held."""
    key = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        new = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        head = np.where(at < 0, -1 if first is None else first, node[at])
        key, first = k[-1], head[-1]
        other = head != node
        yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(head[other])], names=["a", "b"])


def _digests(words: int):
    @F.arrow_udf("struct<h1:long,h2:long>")
    def digests(texts: pa.Array) -> pa.Array:
        h = [_digest(shingle_set(t, words)) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in h], pa.int64()), pa.array([y for _, y in h], pa.int64())], names=["h1", "h2"])

    return digests


def _sequences(words: int):
    @F.arrow_udf("struct<h1:long,h2:long,n:int,shingles:array<long>>")
    def sequences(texts: pa.Array) -> pa.Array:
        hashes = [word_hashes((t or b"").lower())[0] for t in texts.to_pylist()]
        rows = [shingles_of(h, words) for h in hashes]
        digests = [_digest(np.unique(x)) for x in rows]
        cols = [pa.array([x for x, _ in digests], pa.int64()), pa.array([y for _, y in digests], pa.int64()), pa.array(list(map(len, hashes)), pa.int32())]
        return pa.StructArray.from_arrays([*cols, pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64()))], names=["h1", "h2", "n", "shingles"])

    return sequences


def midpoint_keys(fp: Column, blocks: int = 3) -> Column:
    """array<struct<table, key>>: each block of the fingerprint as it is and with one bit turned.

    Of 3 * blocks - 1 differing bits at most two lie in some block, so that two such fingerprints have a value there
    that is one bit from both: they share a key.
    """
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for k, (a, b) in enumerate(itertools.pairwise(cut)):
        block = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        for turn in [0, *(1 << i for i in range(b - a))]:
            out.append(F.struct(F.lit(k).alias("table"), block.bitwiseXOR(F.lit(turn).cast("long")).alias("key")))
    return F.array(*out)


def _met(hit: np.ndarray, row: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """For each row, how many of its words lie in a shingle that is hit; row: the row of each shingle, n: words of rows."""
    at = np.flatnonzero(hit)
    r = row[at]
    step = np.full(len(at), words)
    if len(at):
        step[:-1] = np.where(r[1:] == r[:-1], np.minimum(np.diff(at), words), words)
    return np.minimum(np.bincount(r, step, len(n)), n)


def similar_labels(shingles: list[np.ndarray], n: np.ndarray, part: np.ndarray, within: bool, similarity: float, words: int) -> np.ndarray:
    """For rows of one cell, the smallest row that links reach: rows given by their shingles in order and their words.

    Two rows are linked if the Jaccard similarity of their shingle sets, or for texts of similar length the share of
    either's words that lie in a shingle of the other, reaches `similarity`. within: rows of equal part are compared too.
    Each row is compared, in vector steps, with those after it that it is not joined to yet.
    """
    m = len(shingles)
    row = np.repeat(np.arange(m), [len(x) for x in shingles])
    values, code = np.unique(np.concatenate(shingles), return_inverse=True)
    ends = np.cumsum([len(x) for x in shingles])
    codes = np.split(code, ends[:-1])
    sets = [np.unique(c) for c in codes]
    size = np.array([len(x) for x in sets])
    label, seen, own = np.arange(m), np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    for x in range(m - 1):
        ok = label[x + 1 :] != label[x]
        if not within:
            ok &= part[x + 1 :] != part[x]
        near = np.minimum(n[x + 1 :], n[x]) >= similarity * np.maximum(n[x + 1 :], n[x])
        ok &= near | (np.minimum(size[x + 1 :], size[x]) >= similarity * np.maximum(size[x + 1 :], size[x]))
        if not ok.any():
            continue
        seen[codes[x]] = True
        first = x + 1 + int(ok.argmax())
        after = slice(ends[first - 1], None)
        hit = seen[code[after]]
        r = row[after] - first
        common = np.bincount(r[hit], minlength=m - first)
        covered = _met(hit, r, n[first:], words) >= similarity * n[first:]
        share = common * (1 + similarity) >= similarity * (size[first:] + size[x])
        for y in first + np.flatnonzero(ok[first - x - 1 :] & (common > 0) & (covered | share)):
            if label[y] == label[x]:
                continue
            both = np.count_nonzero(seen[sets[y]])
            good = both >= similarity * (size[x] + size[y] - both)
            if not good and covered[y - first] and near[y - x - 1]:
                own[codes[y]] = True
                good = _met(own[codes[x]], np.zeros(len(codes[x]), dtype=int), n[x : x + 1], words)[0] >= similarity * n[x]
                own[codes[y]] = False
            if good:
                low, high = sorted((label[x], label[y]))
                label[label == high] = low
        seen[codes[x]] = False
    return label


def _similar(similarity: float, words: int):
    names = ["group", "cell_a", "cell_b"]

    def similar(batches):
        for table, group in whole_groups(batches, names, 2048):
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            a, b, part = (table.column(c).to_numpy() for c in ("cell_a", "cell_b", "part"))
            lists = table.column("shingles").combine_chunks()
            flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            ends = []
            for lo, hi in itertools.pairwise(edges.tolist()):
                if hi - lo > 1:
                    rows = [flat[at[k] : at[k + 1]] for k in range(lo, hi)]
                    label = similar_labels(rows, n[lo:hi], part[lo:hi], a[lo] == b[lo], similarity, words)
                    ends += [(node[lo + k], node[lo + x]) for k, x in enumerate(label) if k != x]
            if ends:
                x, y = zip(*ends, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return similar


def _fans(rows: DataFrame, chunk: int) -> DataFrame:
    """rows of groups dealt to parts of about `chunk` rows by a hash; the first node of a group is in all of its parts."""
    counts = rows.groupBy("group").agg(F.count("*").alias("_n"), F.min("node").alias("_head")).where("_n > 1")
    met = rows.join(counts, "group").withColumn("_n", F.ceil(F.col("_n") / F.lit(chunk)).cast("long"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("_n")))
    met = met.withColumn("part", F.explode(F.when(F.col("node") == F.col("_head"), F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(own)))
    met = met.withColumn("cell_a", F.col("part")).withColumn("cell_b", F.col("part")).drop("_n", "_head")
    return met.repartition("group", "cell_a").sortWithinPartitions("group", "cell_a")


def _rest(rows: DataFrame, found: DataFrame, chunk: int) -> DataFrame:
    """Cells of groups of over `chunk` rows in which fans left several components: all pairs but those inside the largest.

    The largest component is joined already, so only the others meet it and each other; it is spread over many cells.
    """
    named = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("group", "component").agg(F.count("*").alias("_m"))
    most = sizes.groupBy("group").agg(F.sum("_m").alias("_n"), F.max(F.struct("_m", "component")).alias("_most"), F.count("*").alias("_k"))
    most = most.where((F.col("_n") > chunk) & (F.col("_k") > 1))
    parts = lambda n: F.ceil(n / F.lit(chunk)).cast("long")
    met = named.join(most, "group").withColumn("_in", F.col("component") == F.col("_most.component"))
    met = met.withColumn("_rest", parts(F.col("_n") - F.col("_most._m"))).withColumn("_all", F.col("_rest") + parts(F.col("_most._m")))
    own = F.when(F.col("_in"), F.col("_rest") + F.pmod(F.xxhash64("node"), F.col("_all") - F.col("_rest"))).otherwise(F.pmod(F.xxhash64("node"), "_rest"))
    met = met.withColumn("part", own).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_in"), F.col("_rest")).otherwise(F.col("_all")) - 1)))
    met = met.withColumn("cell_a", F.least("part", "_o")).withColumn("cell_b", F.greatest("part", "_o"))
    met = met.select(*rows.columns, "part", "cell_a", "cell_b")
    order = ["group", "cell_a", "cell_b"]
    return met.repartition(*order).sortWithinPartitions(*order)


def _near_copy_texts(docs: DataFrame, words: int, similarity: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) of each row and (h1, h2, rep, group) of each set of shingles; rep is its smallest doc_id."""
    prepare(docs.sparkSession)
    distance = 8
    text = F.col("text").cast("binary")
    sig = written(docs.select("doc_id", _marks(words)(text).alias("m")).select("doc_id", "m.*"), "marks")
    texts = sig.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.any_value("bands").alias("bands"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    same = written(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "same")
    keyed = same.select(F.explode(midpoint_keys(F.col("fp"))).alias("k"), "fp", F.col("first").alias("rep")).select("k.table", "k.key", "fp", "rep")
    close = cells(keyed, ["table", "key"], "rep", 2048).mapInArrow(_links(distance), "a long, b long")
    equal = texts.join(same.where("n > 1"), "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    banded = texts.select("node", F.explode("bands").alias("key")).repartition("key").sortWithinPartitions("key", "node")
    banded = banded.mapInArrow(_same_band, "a long, b long")
    group = components(close.union(equal).union(banded)).withColumnRenamed("component", "group")
    members = written(texts.join(group, "node").select("group", "node", "rep", "h1", "h2"), "members")
    wanted = members.select("rep").distinct()
    full = docs.select("doc_id", text.alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    full = full.select(_sequences(words)("text").alias("s")).select("s.*").join(members.drop("rep"), ["h1", "h2"])
    full = written(full.dropDuplicates(["node"]).select("group", "node", "n", "shingles"), "sequences")
    links = written(_fans(full, chunk).mapInArrow(_similar(similarity, words), "a long, b long"), "links")
    found = components(links)
    more = written(_rest(full, found, chunk).mapInArrow(_similar(similarity, words), "a long, b long"), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    return sig, texts.join(found, "node", "left").select("h1", "h2", "rep", F.coalesce("component", "node").alias("group"))


def near_copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, chunk: int = 512) -> DataFrame:
    """(doc_id, component_id) of groups of documents that are 0.8 or more alike in word shingles.

    Two texts are linked if the Jaccard similarity of their shingle sets reaches `similarity`, or, at lengths whose ratio
    reaches it, if that share of the words of each lies in shingles that the other holds too. A changed word costs the
    first measure five shingles and the second one word, so copies with changed words throughout are found by the second.

    Texts with equal shingles are one node. Candidates are nodes whose SimHash over the set of words is within 8 bits
    (they share a midpoint key of one of three blocks) or that share a band of MinHash over their pairs of words.
    Within a group that candidates form, texts are compared exactly: first in fans (parts of bounded size with the
    group's first text in each), then, in groups of many parts that did not become one, all that is not joined yet in
    bounded cells. Null and empty texts are copies of each other. Rows of null doc_id are compared as all others;
    component_id is the smallest doc_id of the group, null if no row of it has one.
    """
    sig, texts = _near_copy_texts(docs, words, similarity, chunk)
    named = texts.join(texts.groupBy("group").agg(F.min("rep").alias("component_id")), "group")
    return sig.join(named.select("h1", "h2", "component_id"), ["h1", "h2"]).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies: that of the smallest doc_id, of several texts with that id
    the one of the smallest digest. Of repeated rows of it one stays; a row of null doc_id stays only if no other row of
    its group has an id, one for each group. An empty table gives an empty one."""
    _, texts = _near_copy_texts(docs, words, similarity, 512)
    first = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "h1", "h2")).alias("first")
    kept = texts.groupBy("group").agg(first).select(F.col("first.rep").alias("_rep"), F.col("first.h1").alias("_h1"), F.col("first.h2").alias("_h2"))
    mark = _digests(words)(F.col("text").cast("binary"))
    rows = docs.select(F.struct("*").alias("_row"), mark.alias("_m")).select("_row", F.col("_m.h1").alias("_h1"), F.col("_m.h2").alias("_h2"))
    own = (rows["_h1"] == kept["_h1"]) & (rows["_h2"] == kept["_h2"]) & rows["_row.doc_id"].eqNullSafe(kept["_rep"])
    return rows.join(kept, own, "left_semi").dropDuplicates(["_h1", "_h2"]).select("_row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_groups(docs).select("doc_id", fp.alias("fingerprint"), "component_id")
