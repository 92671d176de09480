"""Token counts, and SentencePiece encoding and decoding, by Viterbi over a unigram vocabulary."""

from __future__ import annotations

import array
import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import prepare, without

#: The vocabulary that the queries use; a SentencePiece model file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs more than the worst piece (fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")


class Vocabulary:
    """Pieces and scores of a SentencePiece model, read as a unigram vocabulary, and its segmentation of texts.

    The best segmentation has the largest sum of scores; of equal ones, each boundary is reached from the earliest
    start, as the tokenizer's forward pass does, which replaces a path only by a strictly better one. Sums are exact
    here (double precision), where the tokenizer rounds them to single precision along a text.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only vocabularies of unchanged text with escaped spaces can be used")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("spaces at the end of pieces are not supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.fallback = proto.trainer_spec.byte_fallback
        self.pieces = [p.piece for p in proto.pieces]
        normal = [p.score for p in proto.pieces if p.type == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown_score = low - UNKNOWN_PENALTY
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.auto = ahocorasick.Automaton()
        self.single, self.longest = set(), 1
        for i, p in enumerate(proto.pieces):
            if p.type not in (NORMAL, USER) or not p.piece:
                continue
            score = p.score if p.type == NORMAL else len(p.piece) * high - 0.1
            self.auto.add_word(p.piece, (len(p.piece), i, score))
            self.longest = max(self.longest, len(p.piece))
            if len(p.piece) == 1:
                self.single.add(p.piece)
        self.auto.make_automaton()
        known = {c for p in proto.pieces if p.type in (NORMAL, USER) for c in p.piece}
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type in (NORMAL, USER))
        # All paths meet where no piece can cross: before spaces after other characters, and around unknown ones.
        lone = "" if "\n" in known else "\n"
        self.cut = None if inner else re.compile(rf"{lone or '(?!)'}|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+")
        self.surface = []
        for p in proto.pieces:
            if p.type == BYTE:
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(SPACE, " ").encode())

        sizes = np.array([len(x) for x in self.surface], dtype=np.int64)
        self._size, self._start = sizes, np.cumsum(sizes) - sizes
        self._bytes = np.frombuffer(b"".join(self.surface), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(surfaces of the ids laid end to end, where each ends), in parts of bounded size."""
        ends = np.cumsum(self._size[ids])
        parts = []
        for k in range(0, len(ids), 1 << 18):
            part = ids[k : k + (1 << 18)]
            n = self._size[part]
            first = np.repeat(self._start[part] - (np.cumsum(n) - n), n)
            parts.append(self._bytes[first + np.arange(len(first))].tobytes())
        return b"".join(parts), ends

    def prepare(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def _unknown(self, char: str) -> list[int]:
        if self.fallback and len(self.bytes) == 256:
            return [self.bytes[b] for b in char.encode()]
        return [self.unknown]

    def segment(self, text: str):
        """Ids of a prepared text, given out as soon as they are certain.

        Only what lies after the last certain boundary is held: scores, back pointers and pieces. A later piece can
        start at any of the last `longest` places; where the paths back from all of these meet in one boundary, the
        ids up to it are certain.
        """
        base, best, back, piece = 0, [0.0], [0], [-1]

        def settle(end: int) -> None:
            if text[end - 1] not in self.single:
                here = best[end - 1 - base] + self.unknown_score
                if here > best[end - base]:
                    best[end - base], back[end - base], piece[end - base] = here, end - 1, -1

        def path(end: int) -> list[int]:
            out = []
            while end > base:
                p, start = piece[end - base], back[end - base]
                out.append([p] if p >= 0 else self._unknown(text[start:end]))
                end = start
            return [i for ids in reversed(out) for i in ids]

        matches = self.auto.iter(text)
        pending = next(matches, None)
        for end in range(1, len(text) + 1):
            best.append(NEVER)
            back.append(end - 1)
            piece.append(-1)
            while pending is not None and pending[0] + 1 == end:
                size, i, score = pending[1]
                here = best[end - size - base] + score
                if here > best[end - base]:
                    best[end - base], back[end - base], piece[end - base] = here, end - size, i
                pending = next(matches, None)
            settle(end)
            if len(best) > 4 * self.longest:
                live = set(range(max(base, end - self.longest + 1), end + 1))
                while len(live) > 1:
                    last = max(live)
                    live.remove(last)
                    live.add(back[last - base] if last > base else base)
                (sure,) = live
                if sure > base:
                    yield from path(sure)
                    drop = best[sure - base]
                    best = [b - drop for b in best[sure - base :]]
                    back, piece, base = back[sure - base :], piece[sure - base :], sure
        yield from path(len(text))

    def solve(self, chunk: str) -> list[int]:
        """Ids of a short prepared chunk in one pass."""
        if len(chunk) > 256 or not self.single.issuperset(chunk):
            return list(self.segment(chunk))
        n = len(chunk)
        best, back, piece = [0.0] + [NEVER] * n, [0] * (n + 1), [0] * (n + 1)
        for end, (size, i, score) in self.auto.iter(chunk):
            here = best[end + 1 - size] + score
            if here > best[end + 1]:
                best[end + 1], back[end + 1], piece[end + 1] = here, end + 1 - size, i
        out = []
        while n:
            out.append(piece[n])
            n = back[n]
        return out[::-1]

    def count(self, chunk: str) -> int:
        """Number of ids of a prepared chunk: the forward pass carries score and count, without back pointers."""
        if len(chunk) > 256 or not self.single.issuperset(chunk):
            return sum(1 for _ in self.segment(chunk))
        n = len(chunk)
        best, ids = [0.0] + [NEVER] * n, [0] * (n + 1)
        for end, (size, _, score) in self.auto.iter(chunk):
            here = best[end + 1 - size] + score
            if here > best[end + 1]:
                best[end + 1], ids[end + 1] = here, ids[end + 1 - size] + 1
        return ids[n]

    def chunks(self, text: str) -> list[str]:
        ready = self.prepare(text)
        return self.cut.findall(ready) if self.cut else [ready] if ready else []


class Memo(dict):
    """Results of chunks that come again and again, in two generations of at most `most` chunks: when the young one is
    full it becomes the old one, so that chunks in use stay."""

    def __init__(self, solve, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.solve, self.most, self.longest, self.old = solve, most, longest, {}

    def __missing__(self, chunk: str):
        out = self.old.get(chunk)
        if out is None:
            out = self.solve(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes) -> tuple[Vocabulary, Memo, Memo]:
    v = Vocabulary(model)
    return v, Memo(v.count), Memo(lambda c: array.array("i", v.solve(c)).tobytes())


def _model(spark, path: str):
    """The model file of the driver, sent to the executors; its size is that of one vocabulary file."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: {len(data)} bytes is no vocabulary to broadcast")
    return spark.sparkContext.broadcast(data)


def count_tokens(df: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """df with n_tokens: ids of the best segmentation of each whole text; 0 for null and empty texts.

    A column of that name is replaced, others pass through; there is no shuffle.
    """
    prepare(df.sparkSession)
    sent = _model(df.sparkSession, model)

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        vocabulary, counts, _ = _loaded(sent.value)
        return pa.array([sum(map(counts.__getitem__, vocabulary.chunks(t or ""))) for t in texts.to_pylist()], pa.int64())

    found = df.withColumn("_n", tokens(F.col(text)))
    return found.select(*without(df, "n_tokens").columns, F.col("_n").alias("n_tokens"))


def encode(df: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """df with ids (array of int) and n_tokens of each whole text; no ids for null and empty texts.

    Columns of those names are replaced, others pass through; there is no shuffle.
    """
    prepare(df.sparkSession)
    sent = _model(df.sparkSession, model)

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        vocabulary, _, ids = _loaded(sent.value)
        got = [b"".join(map(ids.__getitem__, vocabulary.chunks(t or ""))) for t in texts.to_pylist()]
        offsets = np.cumsum([0, *(len(g) // 4 for g in got)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(got), dtype=np.int32)))

    found = df.withColumn("_ids", encoded(F.col(text)))
    kept = without(df, "ids", "n_tokens").columns
    return found.select(*kept, F.col("_ids").alias("ids"), F.size("_ids").cast("long").alias("n_tokens"))


def decode(df: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of the ids in column `to`: pieces joined, byte pieces put together, the first space taken off.

    Null ids give "". A text without U+2581 comes back unchanged from encode and decode.
    """
    prepare(df.sparkSession)
    sent = _model(df.sparkSession, model)

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        vocabulary, _, _ = _loaded(sent.value)
        if not len(lists):
            return pa.array([], pa.string())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        each = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        text, ends = vocabulary.join(flat)
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(each)]].tolist()
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            one = text[a:b].decode("utf-8", "replace")
            out.append(one[1:] if vocabulary.prefix and one.startswith(" ") else one)
        return pa.array(out, pa.string())

    found = df.withColumn("_text", decoded(F.col(ids)))
    return found.select(*without(df, to).columns, F.col("_text").alias(to))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_tokens")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decode(encode(docs))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
