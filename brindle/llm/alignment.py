"""Cross-tokenizer alignment: groups of tokens between common boundaries, links, and how many documents hold each link."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import prepare, written

#: The vocabularies that the query uses: a byte-level BPE and a SentencePiece model.
BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of the ranges that texts of over twice as many are cut to.
RANGE = 32768
#: A range does not end inside a longer unit, so that little is tokenized twice.
LONG_UNIT = 4096
#: Units (see Aligner.units) up to this many characters are remembered, the last of them up to twice this number.
MEMO_LENGTH, MEMO_UNITS = 64, 250_000
#: Distinct links of documents that a chunk gathers before it is written.
CHUNK_LINKS = 1_000_000


class Fragment(NamedTuple):
    """Tokens that end in a byte range. Without a common end (cut false) all are in the prefix. Else the prefix goes up to
    the first common end and belongs to a group that may begin earlier, groups are closed, the suffix is open."""

    cut: bool
    pa: list
    pb: list
    groups: list
    sa: list
    sb: list


def fragment(a_ids: list, a_ends: list, b_ids: list, b_ends: list) -> Fragment:
    """The fragment of tokens of both kinds, given by ids and ascending ends."""
    groups, i, j, a, b = [], 0, 0, 0, 0
    while i < len(a_ids) and j < len(b_ids):
        if a_ends[i] == b_ends[j]:
            i, j = i + 1, j + 1
            groups.append((a_ids[a:i], b_ids[b:j]))
            a, b = i, j
        elif a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1
    if not groups:
        return Fragment(False, a_ids, b_ids, [], [], [])
    return Fragment(True, *groups[0], groups[1:], a_ids[a:], b_ids[b:])


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. Associative; Fragment(False, [], [], [], [], []) is its unit."""
    if not right.cut:
        if not left.cut:
            return Fragment(False, left.pa + right.pa, left.pb + right.pb, [], [], [])
        return left._replace(sa=left.sa + right.pa, sb=left.sb + right.pb)
    if not left.cut:
        return right._replace(pa=left.pa + right.pa, pb=left.pb + right.pb)
    joint = (left.sa + right.pa, left.sb + right.pb)
    return Fragment(True, left.pa, left.pb, [*left.groups, joint, *right.groups], right.sa, right.sb)


def group_text(groups: list) -> str:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def links(groups: list) -> list[int]:
    """A number a << 32 | b for each pair of token occurrences that share a group."""
    return [x << 32 | y for a, b in groups for x in a for y in b]


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what they make of units of text.

    A unit is a run of spaces and what follows up to the next run. No token of either kind crosses its start: no piece has
    a space after another character, and words of the byte-level BPE take at most the last space before them; where other
    white space stands before several spaces, the unit goes on. So units are tokenized apart, with the same result, and
    most of a text's units are known.
    """

    #: Spaces and what follows; a space goes on between other white space before it and white space behind it.
    UNIT = re.compile(r" +[^ ]*(?:(?<=[^\S ]) (?=\s) *[^ ]*)*")

    def __init__(self, bpe: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        byte = _byte_of()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(byte[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode())
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("pieces with inner spaces are not supported")
        self.a_size, self.b_size = (np.array([len(x) for x in s]) for s in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    @classmethod
    def units(cls, text: str) -> list[str]:
        """Units of space + text."""
        return cls.UNIT.findall(" " + text)

    def tokens(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        a = self.a.encode_batch(units, add_special_tokens=False)
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        b = [y or [self.b.piece_to_id("▁")] for y in b]  # the library gives nothing for a lone space
        return [(x.ids, y) for x, y in zip(a, b, strict=True)]

    def ends(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """Bytes up to the end of each token."""
        return np.cumsum(self.a_size[a]).tolist() if a else [], np.cumsum(self.b_size[b]).tolist() if b else []

    def same(self, unit: str, a: list[int], b: list[int]) -> bool:
        raw = unit.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))

    def entries(self, units: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, text of the groups, links as bytes) of each unit; () if bytes differ. The tokens of all units
        are laid end to end, so that the arithmetic is done once for all."""
        both = self.tokens(units)
        a_ids, b_ids = (list(chain.from_iterable(x)) for x in zip(*both, strict=True))
        raw = "".join(units).encode()
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            good = [u for u, (a, b) in zip(units, both, strict=True) if self.same(u, a, b)]
            known = dict(zip(good, self.entries(good), strict=True)) if good else {}
            return [known.get(u, ()) for u in units]
        a, b = np.array(a_ids), np.array(b_ids)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_a, of_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        unit_of = np.searchsorted(np.cumsum([len(u.encode()) for u in units]), common)
        # every A token beside every B token of its group
        times = n_b[of_a]
        left = np.repeat(np.arange(len(a)), times)
        place = np.arange(len(left)) - (np.cumsum(times) - times)[left]
        found = (a[left] << 32 | b[(np.cumsum(n_b) - n_b)[of_a[left]] + place]).tobytes()
        # all ids by group, those of A first, each with what stands after it
        key = np.r_[2 * of_a, 2 * of_b + 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        last = np.r_[key[1:] != key[:-1], True]
        ends_unit = np.r_[unit_of[1:] != unit_of[:-1], True][key // 2]
        mark = np.where(~last, 0, np.where(key % 2 == 0, 1, np.where(ends_unit, 3, 2)))
        shown = map(self.names.__getitem__, np.r_[a, b][order].tolist())
        texts = "".join(chain.from_iterable(zip(shown, map(",|;\n".__getitem__, mark.tolist()), strict=True))).split("\n")
        links_to = 8 * np.cumsum(np.bincount(unit_of, n_a * n_b, len(units)).astype(np.int64))
        counts = [np.bincount(unit_of, x, len(units)).astype(np.int64).tolist() for x in (n_a, n_b, np.ones(len(common)))]
        cut = [0, *links_to.tolist()]
        return [(*n, t, found[x:y]) for *n, t, x, y in zip(*counts, texts, cut, cut[1:], strict=False)]

    def look_up(self, docs: list[list[str]]) -> list[list[tuple]]:
        """The entries of the units of documents. Two tables of bounded size remember units: the newer one takes over from the
        older what it is asked for, and becomes the older one when it is full."""
        if len(self.memo) > MEMO_UNITS:
            self.memo, self.older = {}, self.memo
        out = [list(map(self.memo.get, units)) for units in docs]
        open_ = [k for k, entries in enumerate(out) if None in entries]
        missing = {u for k in open_ for u, e in zip(docs[k], out[k], strict=True) if e is None}
        known = {u: e for u in missing if (e := self.older.get(u)) is not None}
        new = list(missing.difference(known))
        if new:
            known.update(zip(new, self.entries(new), strict=True))
        for k in open_:
            out[k] = [known[u] if e is None else e for u, e in zip(docs[k], out[k], strict=True)]
        self.memo.update((u, e) for u, e in known.items() if len(u) <= MEMO_LENGTH)
        return out


@functools.lru_cache(maxsize=1)
def aligner(bpe: str, pieces: str) -> Aligner:
    return Aligner(bpe, pieces)


def _distinct(found: np.ndarray | list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.asarray(found, dtype=np.int64), return_counts=True)


_WHOLE = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("groups", pa.string()), ("link_at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ("link", pa.list_(pa.int64())), ("holding", pa.list_(pa.int32())),
])
_WHOLE_SQL = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "link_at array<int>, times array<int>, link array<long>, holding array<int>"
)


def _short_docs(bpe: str, pieces: str, keep: bool):
    """Documents in chunks: a row each, whose links are places in the list of the chunk's links, and a row for that list."""

    def flush(chunk: int, rows: list[tuple], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        every = np.concatenate([x for x, _ in found])
        link, at, holding = np.unique(every, return_inverse=True, return_counts=True)
        offsets = np.r_[0, np.cumsum([len(x) for x, _ in found])].astype(np.int32)
        ends = np.r_[offsets, offsets[-1]]
        times = np.concatenate([n for _, n in found]).astype(np.int32)
        cols = [pa.array([*c, None]) for c in zip(*rows, strict=True)]
        lists = [
            pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(times)),
        ]
        whole = np.zeros(len(rows) + 2, dtype=np.int32)
        whole[-1] = len(link)
        lists += [
            pa.ListArray.from_arrays(pa.array(whole), pa.array(link)),
            pa.ListArray.from_arrays(pa.array(whole), pa.array(holding.astype(np.int32))),
        ]
        arrays = [pa.array(np.full(len(rows) + 1, chunk)), *cols, *lists]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, _WHOLE, strict=True)], schema=_WHOLE)

    def run(batches):
        tool, chunk = aligner(bpe, pieces), TaskContext.get().partitionId() << 32
        rows, found, size = [], [], 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            split = [tool.units(t) if t else [] for t in texts]
            for doc_id, entries in zip(ids, tool.look_up(split), strict=True):
                if not entries or () in entries:
                    rows.append((doc_id, 0, 0, 0, 0, "", "" if keep else None))
                    found.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
                    continue
                n_a, n_b, n_groups, text, pairs = zip(*entries, strict=True)
                pairs, text = np.frombuffer(b"".join(pairs), dtype=np.int64), ";".join(text)
                rows.append((doc_id, sum(n_a), sum(n_b), sum(n_groups), len(pairs), hashlib.sha256(text.encode()).hexdigest(), text if keep else None))
                found.append(_distinct(pairs))
                size += len(found[-1][0])
                if size >= CHUNK_LINKS:
                    yield flush(chunk, rows, found)
                    rows, found, size, chunk = [], [], 0, chunk + 1
        if rows:
            yield flush(chunk, rows, found)

    return run


def ranges(text: str, size: int = RANGE) -> list[tuple[str, int, int]]:
    """(text, start, end): byte ranges of about `size` of space + text, each with the units that it touches.

    start and end are the range's bytes in that text; they may lie inside of units, but not of long ones.
    """
    cuts, bounds, at = [], [], 0
    for u in Aligner.units(text):
        bounds.append(at)
        at += len(u.encode())
    bounds.append(at)
    raw, edges = (" " + text).encode(), np.array(bounds)
    for want in range(size, at, size):
        k = int(np.searchsorted(edges, want, side="right")) - 1
        cut = want if edges[k + 1] - edges[k] <= LONG_UNIT else int(edges[k + 1])
        if cut < at and (not cuts or cut > cuts[-1]):
            cuts.append(cut)
    out = []
    for low, high in zip([0, *cuts], [*cuts, at], strict=True):
        first = int(edges[np.searchsorted(edges, low, side="right") - 1])
        last = int(edges[np.searchsorted(edges, high, side="left")])
        out.append((raw[first:last].decode(), low - first, high - first))
    return out


_CUT = pa.schema([("uid", pa.int64()), ("seg", pa.int32()), ("text", pa.string()), ("low", pa.int64()), ("high", pa.int64())])


def _cut(size: int):
    def run(batches):
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = ranges(text, size)
                cols = [[uid] * len(got), list(range(len(got))), *map(list, zip(*got, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CUT, strict=True)], schema=_CUT)

    return run


_IDS = "array<int>"
_FRAGMENT = f"cut boolean, pa {_IDS}, pb {_IDS}, sa {_IDS}, sb {_IDS}"
_IDS_PA = pa.list_(pa.int32())
_PART = pa.schema([
    ("uid", pa.int64()), ("seg", pa.int32()), ("ok", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("text", pa.string()),
    ("link", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("cut", pa.bool_()), ("pa", _IDS_PA), ("pb", _IDS_PA), ("sa", _IDS_PA), ("sb", _IDS_PA),
])
_PART_SQL = f"uid long, seg int, ok boolean, n_a long, n_b long, n_groups long, text string, link array<long>, times array<long>, {_FRAGMENT}"


def range_fragment(tool: Aligner, text: str, low: int, high: int) -> tuple[bool, Fragment]:
    """Whether bytes agree, and the fragment of the tokens of a text of whole units that end in (low, high]."""
    units = Aligner.UNIT.findall(text)
    a_ids, b_ids, ok = [], [], True
    for unit, (a, b) in zip(units, tool.tokens(units), strict=True):
        ok = ok and tool.same(unit, a, b)
        a_ids += a
        b_ids += b
    kept = []
    for ids, ends in zip((a_ids, b_ids), tool.ends(a_ids, b_ids), strict=True):
        inside = [k for k, e in enumerate(ends) if low < e <= high]
        kept += [[ids[k] for k in inside], [ends[k] for k in inside]]
    return ok, fragment(*kept)


def _fragments(bpe: str, pieces: str):
    def run(batches):
        tool = aligner(bpe, pieces)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ok, f = range_fragment(tool, r["text"], r["low"], r["high"])
                link, times = _distinct(links(f.groups)) if ok else _distinct([])
                n_a = len(f.pa) + len(f.sa) + sum(len(a) for a, _ in f.groups)
                n_b = len(f.pb) + len(f.sb) + sum(len(b) for _, b in f.groups)
                rows.append((r["uid"], r["seg"], ok, n_a, n_b, len(f.groups), group_text(f.groups) if ok else "", link, times, f.cut, f.pa, f.pb, f.sa, f.sb))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _PART, strict=True)], schema=_PART)

    return run


#: A composed fragment; of its closed groups it has those that composing closed, each with the range whose first common end closes it.
_JOINTS = f"array<struct<seg:int,a:{_IDS},b:{_IDS}>>"
_TREE = f"struct<{_FRAGMENT.replace(' ', ':').replace(',:', ',')},first:int,joints:{_JOINTS}>"
_JOINT_PA = pa.list_(pa.struct([("seg", pa.int32()), ("a", _IDS_PA), ("b", _IDS_PA)]))
_TREE_PA = pa.struct([("cut", pa.bool_()), ("pa", _IDS_PA), ("pb", _IDS_PA), ("sa", _IDS_PA), ("sb", _IDS_PA), ("first", pa.int32()), ("joints", _JOINT_PA)])


def _composed():
    @F.arrow_udf(_TREE)
    def composed(parts: pa.Array) -> pa.Array:
        out = []
        for row in parts.to_pylist():
            total, first = None, None
            for x in row:
                x = x["f"]
                closed = [(j["seg"], j["a"], j["b"]) for j in x["joints"]]
                f = Fragment(x["cut"], x["pa"], x["pb"], closed, x["sa"], x["sb"])
                if total is None:
                    total, first = f, x["first"]
                    continue
                both = compose(total, f)
                if total.cut and f.cut:
                    both.groups[len(total.groups)] = (x["first"], *both.groups[len(total.groups)])
                total, first = both, first if total.cut else x["first"]
            joints = [{"seg": s, "a": a, "b": b} for s, a, b in total.groups]
            out.append({"cut": total.cut, "pa": total.pa, "pb": total.pb, "sa": total.sa, "sb": total.sb, "first": first, "joints": joints})
        return pa.array(out, _TREE_PA)

    return composed


def _long_docs(docs: DataFrame, bpe: str, pieces: str, size: int, fan: int = 16) -> tuple[DataFrame, DataFrame]:
    """(totals, links) of long documents (uid, text): a row each, and (uid, link, times).

    Byte ranges are tokenized in tasks of their own and yield fragments. The tree takes `fan` neighbours at a time and
    carries only open ends and the groups that composing closes; the closed groups of a range stay in its row.
    """
    cut = docs.select("uid", "text").mapInArrow(_cut(size), "uid long, seg int, text string, low long, high long")
    parts = written(cut.repartition("uid", "seg").mapInArrow(_fragments(bpe, pieces), _PART_SQL), "fragments")
    bad = parts.where("not ok").select("uid").distinct()
    parts = parts.join(bad, "uid", "left_anti")
    tree = parts.select("uid", "seg", F.struct("cut", "pa", "pb", "sa", "sb", F.col("seg").alias("first"), F.array().cast(_JOINTS).alias("joints")).alias("f"))
    many = tree.agg(F.max("seg")).first()[0]
    while many:
        near = tree.groupBy("uid", F.floor(F.col("seg") / fan).cast("int").alias("over")).agg(F.array_sort(F.collect_list(F.struct("seg", "f"))).alias("parts"))
        tree = written(near.select("uid", F.col("over").alias("seg"), _composed()("parts").alias("f")), "tree")
        many //= fan
    # what is open before the first common end begins at the text's start, so it is a group; nothing is open at the end
    joints = tree.select("uid", F.inline(F.concat(F.array(F.struct(F.lit(-1).alias("seg"), F.col("f.pa").alias("a"), F.col("f.pb").alias("b"))), "f.joints")))
    pair = F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.shiftleft(x.cast("long"), 32) + y))))
    found = parts.select("uid", F.inline(F.arrays_zip("link", "times"))).unionByName(joints.select("uid", pair.alias("link"), F.lit(1).cast("long").alias("times")))
    found = written(found.groupBy("uid", "link").agg(F.sum("times").alias("times")), "long_links")
    shown = F.concat_ws("|", F.array_join("a", ","), F.array_join("b", ","))
    texts = parts.where("n_groups > 0").select("uid", (F.col("seg") * 2 + 1).alias("at"), "text", "n_groups")
    texts = texts.unionByName(joints.select("uid", (F.col("seg") * 2).alias("at"), shown.alias("text"), F.lit(1).cast("long").alias("n_groups")))
    texts = texts.groupBy("uid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), ";").alias("groups"), F.sum("n_groups").alias("n_groups")
    )
    return parts.groupBy("uid").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")).join(texts, "uid"), found


def _sums(keys, index: pa.Table, values: pa.Table) -> pa.Table:
    """Sums over the links of a chunk's documents, given what the chunk's list of links is worth."""
    count, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if values.num_rows:
        at = values.column("at").to_numpy()
        count, best = np.zeros(at.max() + 1, dtype=np.int64), np.zeros(at.max() + 1, dtype=np.int64)
        count[at], best[at] = values.column("n").to_numpy(), values.column("best").to_numpy(zero_copy_only=False)
    lists = index.column("link_at").combine_chunks()
    at, times = lists.flatten().to_numpy(), index.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    edges = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    sums = [np.r_[0, np.cumsum(times * v[at])] for v in (best, count)]
    out = index.drop_columns(["chunk", "link_at", "times"])
    for name, s in zip(("n_best", "count_sum"), sums, strict=True):
        out = out.append_column(name, pa.array(s[edges[1:]] - s[edges[:-1]]))
    return out


def align_tokens(docs: DataFrame, bpe: str = BPE, pieces: str = PIECES, size: int = RANGE, keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of docs (doc_id long, text).

    rows: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups (null unless keep_groups), for each
    row of docs. counts: (link, n, best): a << 32 | b, in how many rows of docs it stands, and whether no link of its A id
    stands in more.

    Texts that are null, empty, or whose tokens' bytes are not space + text (those with U+2581) have no tokens. Repeated rows
    and rows without doc_id count as documents of their own. An empty table gives no rows; further columns are not read.
    Texts of over twice `size` bytes are cut to byte ranges that different tasks tokenize (see _long_docs). Links are
    counted in chunks of documents first; the chunks' lists of links, not the documents' links, meet the counts.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") > 2 * size, F.lit(False))
    index = written(docs.where(~is_long).mapInArrow(_short_docs(bpe, pieces, keep_groups), _WHOLE_SQL), "chunks")
    long = written(docs.where(is_long).withColumn("uid", F.monotonically_increasing_id()), "long")
    totals, long_links = _long_docs(long, bpe, pieces, size)
    lists = index.where("n_a is null").select("chunk", F.posexplode(F.arrays_zip("link", "holding")).alias("at", "x"))
    lists = lists.select("chunk", "at", "x.link", "x.holding")
    counts = lists.select("link", "holding").union(long_links.select("link", F.lit(1))).groupBy("link").agg(F.sum("holding").alias("n"))
    counts = written(counts, "counts")
    first = F.shiftright("link", 32).alias("a")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    counts = written(counts.withColumn("a", first).join(most, "a").select("link", "n", (F.col("n") == F.col("most")).alias("best")), "links")
    values = lists.select("chunk", "at", "link").join(counts, "link").select(F.col("chunk").alias("of"), F.col("at").cast("int").alias("at"), "n", "best")
    shown = index.where("n_a is not null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "link_at", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    rows = shown.groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(_sums, schema)
    worth = long_links.join(counts, "link").groupBy("uid").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    known = long.select("uid", "doc_id").join(totals, "uid", "left").join(worth, "uid", "left")
    text = F.when(F.col("groups").isNotNull(), F.sha2("groups", 256)).otherwise("")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    known = known.select("doc_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers], text.alias("groups_sha256"), (F.coalesce("groups", F.lit("")) if keep_groups else F.lit(None).cast("string")).alias("groups"))
    return rows.unionByName(known), counts


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokens(docs)[0].select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
