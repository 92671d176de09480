"""Token alignment against whole texts tokenized by the libraries and compared pair by pair."""

import functools
import hashlib
import random
from collections import Counter

import pytest

from brindle.llm import alignment
from brindle.llm.alignment import Fragment, compose, fragment


@functools.lru_cache(maxsize=1)
def tool():
    return alignment.Aligner(alignment.BPE, alignment.PIECES)


def whole(text):
    """Groups of a text, each tokenizer run over all of it."""
    if not text:
        return []
    t = tool()
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
        return []
    a_ends, b_ends = t.ends(a, b)
    both, low, out = sorted(set(a_ends) & set(b_ends)), 0, []
    for high in both:
        out.append(([x for x, e in zip(a, a_ends, strict=True) if low < e <= high], [x for x, e in zip(b, b_ends, strict=True) if low < e <= high]))
        low = high
    return out


def plain(docs):
    found = [(d, whole(t)) for d, t in docs]
    pairs = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    held = Counter(k for p in pairs for k in p)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (d, g), p in zip(found, pairs, strict=True):
        sha = hashlib.sha256(alignment.group_text(g).encode()).hexdigest() if g else ""
        best = sum(n for k, n in p.items() if held[k] == most[k[0]])
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(p.values()), best, sum(n * held[k] for k, n in p.items()), sha))
    return sorted(map(str, out)), held


TEXTS = [
    None, "", " ", "  ", "x", "a  b", "a \n b", "a\n  b\n\n   c \t d", "trailing  ", "\n", " \n ", "tab\t\tx  \t y", "don't <|endoftext|> <s> </s> <unk>",
    "naïve façade — 日本語 テスト \U0001f600 \U0001f468‍\U0001f469", "low ▁ bar", "a" * 300, "nbsp   x  y\u0085 z", "x\x1c \x1c  y", "\x00 nul",
    "the cat sat on the mat the cat sat", "the cat sat on the mat the cat sat", "10 000 000.00 $#@! ((( ))) ...", "    indented\n        code():\n    return  1\n",
]


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_units_are_tokenized_as_whole_texts(text):
    t = tool()
    units = t.units(text)
    assert "".join(units) == " " + text
    got = t.tokens(units)
    assert [i for a, _ in got for i in a] == t.a.encode(" " + text, add_special_tokens=False).ids
    assert [i for _, b in got for i in b] == t.b.encode(text)


def test_random_white_space():
    rng, t = random.Random(5), tool()
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", "é", "'s", ".", "　", "7"]) for _ in range(rng.randint(1, 14)))
        got = t.tokens(t.units(text))
        assert [i for a, _ in got for i in a] == t.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [i for _, b in got for i in b] == t.b.encode(text), repr(text)


def test_fragments_compose_in_any_bracketing():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 30)
        a_ends, b_ends = (sorted(rng.sample(range(1, n + 1), rng.randint(0, n - 1)) + [n + 1]) for _ in range(2))
        tokens = [(list(range(len(e))), e) for e in (a_ends, b_ends)]

        def part(low, high, tokens=tokens):
            return fragment(*[v for ids, ends in tokens for v in ([i for i, e in zip(ids, ends, strict=True) if low < e <= high], [e for e in ends if low < e <= high])])

        cuts = sorted({0, n + 1, *(rng.randint(0, n + 1) for _ in range(4))})
        parts = [part(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
        want = part(0, n + 1)
        assert functools.reduce(compose, parts) == want == functools.reduce(compose, parts, Fragment(False, [], [], [], [], []))
        assert functools.reduce(lambda r, l: compose(l, r), reversed(parts)) == want


def rows_of(df):
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


@pytest.mark.parametrize("size", [32768, 40])
def test_documents_whole_and_in_ranges(spark, size):
    rng = random.Random(9)
    words = ["the", "cat", "Übung", "1234567", "sat", "antidisestablishmentarianism", "x\n", "don't", "日本語", "▁", ""]
    docs = list(enumerate(TEXTS)) + [(None, "no id here"), (3, "x"), (3, "x")]
    docs += [(100 + k, " ".join(rng.choice(words[: 9 + (k % 7 == 0) + (k % 2)]) for _ in range(rng.randint(20, 120)))) for k in range(40)]
    docs += [(200, "y" * 9000 + " tail of it"), (201, docs[-1][1]), (202, "z " * 900)]
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, n_a string").repartition(3)
    rows, counts = alignment.align_tokens(df, size=size, keep_groups=True)
    want, held = plain(docs)
    assert rows_of(rows) == want
    assert {(r.link >> 32, r.link & 0xFFFFFFFF): r.n for r in counts.collect()} == dict(held)
    shown = {r.doc_id: r.groups for r in rows.collect()}
    assert shown[200] == alignment.group_text(whole(docs[-3][1]))


def test_memo_gives_entries_again_after_it_was_full(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_UNITS", 3)
    t = alignment.Aligner(alignment.BPE, alignment.PIECES)
    docs = [t.units("the cat sat on the mat"), t.units("low ▁ bar"), t.units("the dog sat on a log")]
    first = t.look_up(docs)
    assert [t.look_up(docs) for _ in range(5)] == [first] * 5 and () in first[1] and () not in first[0]
    assert [e for d in docs for e in t.look_up([d])[0]] == [e for d in first for e in d]


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokens(df)[0].collect() == []
