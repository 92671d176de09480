"""Substring dedup: repeated passages found by suffix automata over shards of passages that share an anchor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import covered, prepare, span_hash, without, word_hashes, written
from brindle.llm.groups import whole_groups

#: Words of the grams among which a window's anchor, the one of the smallest hash, is chosen.
GRAM = 10


def pieces_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, end) of the pieces of a document: the words of neighbouring windows that have one anchor.

    Equal windows have equal anchors wherever they stand, so they meet in the pieces of one anchor.
    """
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    at = np.arange(len(words) - GRAM + 1)
    grams = span_hash(words, at, at + GRAM)
    lead = np.empty(n, dtype=np.int64)
    step = 1 << 16
    for k in range(0, n, step):
        part = np.lib.stride_tricks.sliding_window_view(grams[k : k + step + window - GRAM], window - GRAM + 1)
        lead[k : k + len(part)] = part.argmin(axis=1) + np.arange(k, k + len(part))
    first = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
    last = np.r_[first[1:], n] - 1
    return grams[lead[first]], first, last + window


class SuffixAutomaton:
    """Of several sequences; it knows every run of words that occurs in one of them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def matches(self, sequence) -> list[int]:
        """Matching statistics: for each place the length of the longest run ending there that the automaton knows."""
        at, n, out = 0, 0, []
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            to = self.next[at].get(c)
            at, n = (to, n + 1) if to is not None else (0, 0)
            out.append(n)
        return out


def repeats(docs: list[int], starts: list[int], words: list[list[int]], window: int) -> list[tuple[int, int, int]]:
    """(doc, start, end) of the maximal spans of `window` or more words that occur in a piece of a smaller doc.

    docs ascend: the pieces of a document are streamed through the automaton of all smaller ones, then added to it.
    """
    sam, out, k = SuffixAutomaton(), [], 0
    while k < len(docs):
        stop = k
        while stop < len(docs) and docs[stop] == docs[k]:
            stop += 1
        for j in range(k, stop) if k else ():
            low = high = -1
            for i, n in enumerate(sam.matches(words[j])):
                if n >= window:
                    if high >= 0 and i - n + 1 <= high:
                        low, high = min(low, i - n + 1), i + 1
                    else:
                        if high >= 0:
                            out.append((docs[j], starts[j] + low, starts[j] + high))
                        low, high = i - n + 1, i + 1
            if high >= 0:
                out.append((docs[j], starts[j] + low, starts[j] + high))
        for j in range(k, stop):
            sam.add(words[j])
        k = stop
    return out


def _pieces(window: int):
    @F.arrow_udf("array<struct<anchor:long,piece:long,start:int,stop:int>>")
    def pieces(texts: pa.Array) -> pa.Array:
        cols, offsets = [[], [], [], []], [0]
        for text in texts.to_pylist():
            words, _, _ = word_hashes(text or b"")
            anchor, start, end = pieces_of(words, window)
            if len(start):
                got = (anchor.view(np.int64), span_hash(words, start, end, 1).view(np.int64), start, end)
                for c, v in zip(cols, got, strict=True):
                    c.append(v)
            offsets.append(offsets[-1] + len(start))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        flat = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(cols, kinds, strict=True)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names=["anchor", "piece", "start", "stop"]))

    return pieces


def _words_at():
    @F.arrow_udf("array<struct<anchor:long,crowded:boolean,start:int,words:array<long>>>")
    def words_at(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, want in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            words = word_hashes(text or b"")[0].view(np.int64)
            out.append([x | {"words": words[x["start"] : x.pop("stop")]} for x in want])
        kind = pa.struct([("anchor", pa.int64()), ("crowded", pa.bool_()), ("start", pa.int32()), ("words", pa.list_(pa.int64()))])
        return pa.array(out, pa.list_(kind))

    return words_at


def _scan(window: int):
    def scan(batches):
        for table, group in whole_groups(batches, ["anchor"]):
            docs, starts = table.column("doc_id").to_pylist(), table.column("start").to_pylist()
            words = table.column("words").to_pylist()
            edge = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
            out, a = [], 0
            for b in edge:
                out += repeats(docs[a:b], starts[a:b], words[a:b], window)
                a = b
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())],
                    names=["doc_id", "start", "stop"],
                )

    return scan


def _parts(window: int, run: int = 11):
    """Pieces cut to parts of at most `run` windows. Places are counted from the anchor's gram, so that equal windows
    fall into parts alike; core is the words that all windows of a part have, (core_a, core_b) their hash."""
    fields = [("core_a", pa.int64()), ("core_b", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.list_(pa.int64()))]

    @F.arrow_udf("array<struct<core_a:long,core_b:long,part:long,start:int,stop:int,words:array<long>>>")
    def parts(anchors: pa.Array, starts: pa.Array, sequences: pa.Array) -> pa.Array:
        out = []
        for anchor, start, seq in zip(anchors.to_pylist(), starts.to_pylist(), sequences.to_pylist(), strict=True):
            words = np.array(seq, dtype=np.int64).view(np.uint64)
            at = np.arange(len(words) - GRAM + 1)
            gram = int(np.flatnonzero(span_hash(words, at, at + GRAM).view(np.int64) == anchor)[0])
            first = np.arange(len(words) - window + 1)
            group = (gram - first) // run
            low = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            high = np.r_[low[1:], len(first)] - 1
            # a part at the end of a piece has fewer windows; its core is still the one of the whole part
            core_low, core_high = gram - group[low] * run, gram - (group[low] + 1) * run + 1 + window
            a, b = (span_hash(words, core_low, core_high, k).view(np.int64).tolist() for k in (0, 1))
            whole = span_hash(words, low, high + window, 1).view(np.int64).tolist()
            out.append([
                {"core_a": x, "core_b": y, "part": w, "start": start + i, "stop": start + j + window, "words": seq[i : j + window]}
                for x, y, w, i, j in zip(a, b, whole, low.tolist(), high.tolist(), strict=True)
            ])
        return pa.array(out, pa.list_(pa.struct(fields)))

    return parts


def _windows(window: int):
    @F.arrow_udf("array<struct<a:long,b:long,start:int>>")
    def windows(starts: pa.Array, sequences: pa.Array) -> pa.Array:
        out = []
        for start, seq in zip(starts.to_pylist(), sequences.to_pylist(), strict=True):
            words = np.array(seq, dtype=np.int64).view(np.uint64)
            at = np.arange(len(words) - window + 1)
            a, b = (span_hash(words, at, at + window, k).view(np.int64) for k in (0, 1))
            out.append([{"a": x, "b": y, "start": start + k} for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))])
        kind = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32())])
        return pa.array(out, pa.list_(kind))

    return windows


def _keep():
    @F.arrow_udf("struct<text:string,n_words:long,n_removed:long>")
    def keep_words(texts: pa.Array, spans: pa.Array) -> pa.Array:
        text_, all_, gone_ = [], [], []
        for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            words = (text or b"").split()
            kept = words
            if cut:
                gone = covered(len(words), np.array([s["start"] for s in cut]), np.array([s["stop"] for s in cut]))
                kept = [words[k] for k in np.flatnonzero(~gone)]
            text_.append(b" ".join(kept).decode())
            all_.append(len(words))
            gone_.append(len(words) - len(kept))
        return pa.StructArray.from_arrays([pa.array(text_, pa.string()), pa.array(all_), pa.array(gone_)], names=["text", "n_words", "n_removed"])

    return keep_words


def repeated_spans(docs: DataFrame, window: int = 50, shard: int = 256) -> DataFrame:
    """(doc_id, start, stop) in words: spans of windows that also start in a document of a smaller doc_id.

    1. Every window has an anchor, so that documents are cut to pieces, a row each (one for about 21 words).
    2. Equal pieces shrink to their smallest doc_id in a map-side aggregate; where a larger document holds the piece,
       all of it is repeated.
    3. Pieces of an anchor that has different pieces in several documents (the edges of shared passages and near
       copies) are a reference shard: one occurrence of each goes through the shard's suffix automaton.
    4. Shards of over `shard` different pieces would be unbounded: they are cut to parts and windows, which are
       aggregated by 128-bit hash.
    """
    rows = docs.where("doc_id is not null").select("doc_id", F.inline(_pieces(window)(F.col("text").cast("binary"))))
    rows = written(rows, "pieces")
    piece = rows.groupBy("anchor", "piece").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    piece = written(piece, "piece")
    anchor = piece.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("last").alias("high"))
    anchor = anchor.where("low < high").select("anchor", "n", "low")
    known = piece.join(anchor, "anchor").where("n > 1 or first < last")
    met = written(rows.join(known.select("anchor", "piece", "n", "first"), ["anchor", "piece"]), "met")
    whole = met.where("first < doc_id").select("doc_id", "start", "stop")
    sought = met.where("first = doc_id and n > 1").groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", (F.col("n") > shard).alias("crowded"), "start", "stop")).alias("spans")
    )
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(sought, "doc_id")
    held = written(texts.select("doc_id", F.inline(_words_at()(F.col("text"), F.col("spans")))), "shards")
    order = ["anchor", "doc_id", "start"]
    found = (
        held.where("not crowded").select("anchor", "doc_id", "start", "words").repartition("anchor")
        .sortWithinPartitions(*order).mapInArrow(_scan(window), "doc_id long, start int, stop int")
    )
    # Crowded pieces differ mostly at one end: parts whose common words no other document has drop out, equal parts
    # shrink to one, and of the rest the windows are compared.
    cut = F.inline(_parts(window)(F.col("anchor"), F.col("start"), F.col("words")))
    parts = written(held.where("crowded").select("doc_id", cut), "parts")
    part = parts.groupBy("core_a", "core_b", "part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    part = written(part, "part")
    core = part.groupBy("core_a", "core_b").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("last").alias("high"))
    shared = part.join(core.where("low < high"), ["core_a", "core_b"]).where("n > 1 or first < last")
    shared = shared.select("core_a", "core_b", "part", "first", "n")
    met = written(parts.join(shared, ["core_a", "core_b", "part"]), "met_parts")
    whole = whole.union(met.where("first < doc_id").select("doc_id", "start", "stop"))
    last = met.where("first = doc_id and n > 1")
    hashed = written(last.select("doc_id", F.inline(_windows(window)(F.col("start"), F.col("words")))), "windows")
    twice = hashed.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    crowd = hashed.join(twice.select("a", "b", "low"), ["a", "b"]).where("low < doc_id")
    crowd = crowd.select("doc_id", "start", (F.col("start") + window).alias("stop"))
    return whole.union(found).union(crowd)


def dedup_substrings(docs: DataFrame, window: int = 50, shard: int = 256) -> DataFrame:
    """docs with text cut to the words that stay, joined by one space, plus n_words and n_removed.

    A word goes if a window of `window` words that covers it has the same words as one that starts in a document of a
    smaller doc_id; windows are judged on the input. Null and empty texts have no words and give "". Rows of a null
    doc_id neither lose words nor make others lose them. Repeated rows of a doc_id are one document. Input columns named
    n_words or n_removed are replaced; others pass through.
    """
    prepare(docs.sparkSession)
    docs = without(docs, "n_words", "n_removed")
    spans = repeated_spans(docs, window, shard).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("_cut"))
    out = docs.join(spans, "doc_id", "left").withColumn("_kept", _keep()(F.col("text").cast("binary"), F.col("_cut")))
    names = [F.col("_kept.text").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*names, "_kept.n_words", "_kept.n_removed")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM docs)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k
  FROM windows JOIN firsts USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM docs),
kept AS (
  SELECT w.doc_id, count(*) AS n_kept, string_agg(w.w, ' ' ORDER BY w.k) AS text
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.k = g.k GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""
