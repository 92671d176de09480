"""The language model against plain counts, the exact law of its seating, and held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from brindle.llm import language_model as lm


def law(c, a, d):
    """Chances of 1..c tables for c customers of a dish, a new table having weight a."""
    s = [[0.0] * (c + 2) for _ in range(c + 1)]
    s[1][1] = a
    for n in range(1, c):
        for t in range(1, n + 2):
            s[n + 1][t] = a * s[n][t - 1] + (n - d * t) * s[n][t]
    row = np.array(s[c][1 : c + 1])
    return row / row.sum()


@pytest.mark.parametrize(("c", "a", "d"), [(2, 0.4, 0.8), (6, 1.3, 0.5), (9, 0.05, 0.7)])
def test_sweeps_sample_the_law_of_the_tables(c, a, d):
    rng, n = np.random.default_rng(1), 20_000
    size, weight = np.full(n, c), np.full(n, a)
    seats = lm.Seating(size, np.ones(n, dtype=int))
    for _ in range(60):
        seats.sweep(weight, d, rng)
        assert (np.add.reduceat(seats.tables, seats.first) == c).all() and (seats.tables > 0).all()
    got = np.bincount(seats.t, minlength=c + 1)[1:] / n
    assert np.abs(got - law(c, a, d)).max() < 0.015


def test_mixed_dishes_keep_their_customers():
    rng = np.random.default_rng(2)
    c = rng.integers(2, 400, 500)
    a = rng.random(500) * 3
    seats = lm.Seating(c, lm.first_seats(c, a, 0.6, rng, exact=50))
    for _ in range(40):
        seats.sweep(a, 0.6, rng)
    assert (np.add.reduceat(seats.tables, seats.first) == c).all() and (seats.tables > 0).all() and (seats.t >= 1).all()


@pytest.mark.parametrize(("d", "strength"), [(0.35, 6.0), (0.7, 2.0)])
def test_discount_and_strength_of_seated_restaurants_are_found(d, strength):
    rng, rooms = random.Random(4), []
    for _ in range(150):
        tables = [1]
        for n in range(1, 120):
            k = rng.choices(range(len(tables) + 1), [*[x - d for x in tables], strength + d * len(tables)])[0]
            tables[k : k + 1] = [tables[k] + 1 if k < len(tables) else 1]
        rooms.append(tables)
    c, t, sizes = np.full(len(rooms), 120), np.array([len(x) for x in rooms]), np.concatenate(rooms)
    gen, now, seen = np.random.default_rng(5), (0.8, 1.0), []
    for _ in range(300):
        now = lm.parameters(*lm.by_restaurants(c, t, *now, gen), lm.by_tables(sizes, now[0], gen), gen)
        seen.append(now)
    assert np.abs(np.mean(seen[50:], axis=0) - (d, strength)).max() < 0.2 * strength and abs(np.mean(seen[50:], axis=0)[0] - d) < 0.05


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def lower(text):
    return (text or "").encode().lower().split()


def plain(rows):
    train = Counter(w for d, t in rows if not held(d) for w in [*lower(t), b"\n"])
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in rows:
        words = [*lower(t), b"\n"]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((d, held(d), len(words), sum(train[w] > 0 for w in words), n, base))
    return out


def sentences(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    after = {w: rng.sample(words, 4) for w in words}
    rows = []
    for k in range(n):
        w, text = rng.choice(words), []
        for _ in range(rng.randint(5, 60)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(after[w]) if rng.random() < 0.9 else rng.choice([*words, f"new{rng.randint(0, 10**6)}"])
            w = w if w in after else rng.choice(words)
        rows.append((k, " ".join(text)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string").repartition(3)


def result(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=str)


def same_base(got, want):
    want = sorted(want, key=str)
    assert [g[:5] for g in sorted(got, key=lambda r: str(r[:5]))] == sorted([w[:5] for w in want], key=str)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[5])), sorted(want, key=lambda r: (str(r[0]), r[5])), strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-6)


def test_base_columns_and_held_out_scores(spark):
    rows = sentences(300)
    got = result(lm.score_documents(frame(spark, rows)))
    same_base(got, plain(rows))
    out = [g for g in got if g[1]]
    tokens = sum(g[2] for g in out)
    base, model = (10 ** (-sum(g[k] for g in out) / tokens) for k in (5, 6))
    assert model < base / 3  # perplexity: four words in nine follow a word mostly, of sixty
    assert all(g[6] < 0 for g in got)


def test_shards_and_chunks_agree_with_one_and_reruns_with_themselves(spark):
    rows = [*sentences(200, 3), *[(1000 + k, "| " * 300) for k in range(40)]]
    df = frame(spark, rows)
    one = result(lm.score_documents(df))
    many = result(lm.score_documents(df, shard_tokens=800, chunk_tokens=500))
    assert many == result(lm.score_documents(df, shard_tokens=800, chunk_tokens=500))
    same_base(many, plain(rows))
    gap = [abs(a[6] - b[6]) / a[2] for a, b in zip(one, many, strict=True)]
    assert sum(gap) / len(gap) < 0.03


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, "a b"), (None, "a b"), (5, "a " * 3000), (6, "x" * 50_000), (7, "é É é"), (7, "é É é")]
    got = result(lm.score_documents(frame(spark, rows)))
    same_base(got, plain(rows))
    assert lm.score_documents(frame(spark, rows).where("false")).collect() == []


def test_no_training_texts(spark):
    ids = [k for k in range(100) if held(k)][:3]
    rows = [(k, "a b") for k in ids]
    got = result(lm.score_documents(frame(spark, rows)))
    assert [g[4] for g in got] == [0, 0, 0] and all(abs(g[6]) < 1e-9 and abs(g[5]) < 1e-9 for g in got)


def test_scores_use_drawn_parameters(spark, monkeypatch):
    df, got = frame(spark, sentences(200, 6)), []
    draw = lm.parameters
    for fixed in (None, (0.1, 40.0)):
        monkeypatch.setattr(lm, "parameters", (lambda *a: fixed) if fixed else draw)
        got.append(sum(r[6] for r in result(lm.score_documents(df)) if r[1]))
    assert got[0] > got[1] + 20  # a strength of 40 customers drowns what contexts know


def exchanged(monkeypatch, rows, shards, listed):
    """One chunk's way through all shards without Spark: bytes to the shards, numbers of pairs sent and values sent back, and
    the columns of the documents."""

    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(lm, "TaskContext", Context)
    count = Counter(w for d, t in rows for w in [*lower(t), lm.END])
    train = Counter(w for d, t in rows if not held(d) for w in [*lower(t), lm.END])
    common = [w for w, _ in count.most_common(listed)]
    ids = np.frombuffer(b"".join(lm.xxh3_64_digest(b"0" + w) for w in common), dtype=np.uint64)
    lexicon, tokens, v = lm.Lexicon(ids, np.array([train[w] for w in common], dtype=np.int64)), sum(train.values()), len(train)
    batch = lm.pa.record_batch({"doc_id": [d for d, _ in rows], "held_out": [held(d) for d, _ in rows], "text": [t.encode() for _, t in rows]})
    none = np.zeros(0, dtype=np.uint64)
    sent = [b.to_pylist()[0] for b in lm._pairs(b"0", none, lexicon, tokens, v, shards, 10**9)([batch])]
    docs, sent, s = sent[-1], sent[:-1], lm.Settings()
    key = lambda k: (lm.pa.scalar(k),)
    states, ups = [], {}
    for r in sent:
        first, *more = lm._early(none, ids, shards, v, s)(key(r["shard"]), lm.pa.Table.from_pylist([r], schema=lm._CHUNK)).to_pylist()
        states.append(first)
        for x in more:
            ups.setdefault(x["root"], []).append({k: x[k] for k in ("root", "shard", "blob")})
    customers, downs, found = sum(x["tables"] for x in states), {}, []
    for root, x in ups.items():
        for d in lm._root(ids, customers, v, s)(key(root), lm.pa.Table.from_pylist(x)).to_pylist():
            downs.setdefault(d["shard"], []).append({"of": d["shard"], "root": d["root"], "blob": d["blob"]})
    for x in states:
        state = lm.pa.Table.from_pylist([{"shard": x["shard"], "blob": x["blob"]}])
        run = lm._scores({}, ids, v, customers, [100] * s.samples, [(0.7, 1.0)] * s.samples, shards, s)
        found += run(key(x["shard"]), state, lm.pa.Table.from_pylist(downs[x["shard"]])).to_pylist()
    pairs = [len(lm.unpack(r["blob"], *lm._PAIRS)[3]) for r in sent]
    back = [len(lm.unpack(r["blob"], "f4", "u4")[0]) for r in found]
    out = lm._totals(tokens, v)(key(docs["shard"]), lm.pa.Table.from_pylist([docs], schema=lm._CHUNK), lm.pa.Table.from_pylist(found))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], tokens, r["base_score"], r["score"]) for r in out.to_pylist()]
    return sum(len(r["blob"]) for r in sent), sum(pairs), sum(back), got


def prose(n_docs, n_words, vocabulary, seed=9):
    rng = np.random.default_rng(seed)
    return [(k, " ".join(f"w{x}" for x in np.exp(rng.random(n_words) * math.log(vocabulary)).astype(int))) for k in range(n_docs)]


def test_exchanges_do_not_grow_with_the_shards(monkeypatch):
    rows = prose(300, 200, 20_000)
    pairs = len({p for _, t in rows for p in zip([lm.START, *lower(t)], [*lower(t), lm.END], strict=True)})
    few, many = (exchanged(monkeypatch, rows, k, 12_000) for k in (4, 128))
    assert many[0] < 1.4 * few[0] and many[0] < 3 * pairs  # ids of eight bytes, with documents: 377,121 bytes and 538,405
    assert few[1:3] == many[1:3] == (pairs, pairs)  # one value a pair comes back, not one for each document and shard
    for x in (few, many):
        same_base(x[3], plain(rows))


@pytest.mark.parametrize("listed", [0, 1, 50, 10**6])
def test_listed_words_change_no_base_columns(monkeypatch, listed):
    rows = [*prose(60, 80, 500), (100, ""), (101, "new " * 5), (102, "w1 W1 w2")]
    got = [exchanged(monkeypatch, rows, k, listed)[3] for k in (1, 7)]
    for x in got:
        same_base(x, plain(rows))
        assert all(math.isfinite(r[6]) and r[6] < 0 for r in x)
    gap = [abs(a[6] - b[6]) / a[2] for a, b in zip(*got, strict=True)]
    assert sum(gap) / len(gap) < 0.05


def test_few_listed_words_and_many_shards(spark):
    rows = sentences(150, 8)
    df = frame(spark, rows)
    all_listed, few = (result(lm.score_documents(df, shard_tokens=800, chunk_tokens=500, listed=k)) for k in (10**6, 9))
    same_base(few, plain(rows))
    gap = [abs(a[6] - b[6]) / a[2] for a, b in zip(all_listed, few, strict=True)]
    assert sum(gap) / len(gap) < 0.03


def test_first_words_of_short_texts_are_dealt_over_shards(spark, monkeypatch):
    seen, made = [], lm._pairs
    monkeypatch.setattr(lm, "_pairs", lambda salt, hot, *more: (seen.append((salt, hot)), made(salt, hot, *more))[1])
    rows = [(k, f"w{k % 97}") for k in range(600)]
    same_base(result(lm.score_documents(frame(spark, rows), shard_tokens=100, chunk_tokens=200)), plain(rows))
    salt, hot = seen[0]
    assert np.isin(np.frombuffer(lm.xxh3_64_digest(salt + lm.START), dtype=np.uint64), hot).all()


@pytest.mark.parametrize(("c", "a", "d"), [(2, 0.4, 0.8), (9, 0.05, 0.7), (40, 1.3, 0.5), (40, 30.0, 0.8)])
def test_all_customers_sit_down_by_the_law_of_the_tables(c, a, d):
    rng, n = np.random.default_rng(1), 20_000
    got = np.bincount(lm.seated(np.full(n, c), np.full(n, a), d, rng), minlength=c + 1)[1:] / n
    assert np.abs(got - law(c, a, d)).max() < 0.015
    mixed = lm.seated(np.array([0, 1, 700, lm.EXACT, 3]), np.full(5, a), d, rng)
    assert mixed[:2].tolist() == [0, 1] and (mixed[2:] >= 1).all()


@pytest.mark.parametrize(("c", "a", "d"), [(60, 0.05, 0.7), (60, 3.0, 0.6), (60, 30.0, 0.8), (90, 60.0, 0.9)])
def test_dishes_of_many_customers_have_the_same_law(c, a, d):
    rng = np.random.default_rng(3)
    found = [lm._many_customers(c, a, d, rng) for _ in range(4000)]
    assert all(x.sum() == c and (x > 0).all() for x in found)
    mean, want = np.mean([len(x) for x in found]), law(c, a, d) @ np.arange(1, c + 1)
    assert abs(mean - want) < 0.03 * want
    assert np.abs(np.bincount([len(x) for x in found], minlength=c + 1)[1:] / 4000 - law(c, a, d)).max() < 0.04


def test_auxiliary_variables_of_dishes_need_no_sizes(monkeypatch):
    n, d = 4000, 0.6
    c, a, rng = np.full(n, 12), np.full(n, 2.0), np.random.default_rng(4)
    seats = lm.Seating(c, np.ones(n, dtype=int))
    for _ in range(300):  # of one customer each
        seats.sweep(a, d, rng)
    want = np.mean([lm.by_tables(seats.tables, d, rng) for _ in range(20)])
    got = np.mean([lm.by_dishes(c, lm.seated(c, a, d, rng), [], d, rng) for _ in range(20)])
    assert got == pytest.approx(want, rel=0.02)
    monkeypatch.setattr(lm, "EXACT", 10)
    monkeypatch.setattr(lm, "_SPANS", [5, 10])
    lm._ways.cache_clear()
    t = lm.seated(c, a, d, rng, sizes := [])
    assert len(sizes) == n and lm.by_dishes(c, t, sizes, d, rng) == pytest.approx(want, rel=0.05)
    lm._ways.cache_clear()


def after_two_words(monkeypatch, rows, shards, hot_words, s):
    """Chances of words after two words without Spark: {(word, word, next word): chance}, all words of rows listed."""

    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(lm, "TaskContext", Context)
    texts = [(d, [*lower(t), lm.END]) for d, t in rows]
    train = Counter(w for d, t in texts if not held(d) for w in t)
    common = [w for w, _ in Counter(w for _, t in texts for w in t).most_common()]
    id_of = {w: np.frombuffer(lm.xxh3_64_digest(b"0" + w), dtype=np.uint64)[0] for w in [*common, lm.START]}
    ids, hot = np.array([id_of[w] for w in common]), np.array([id_of[w] for w in hot_words], dtype=np.uint64)
    lexicon, tokens, v = lm.Lexicon(ids, np.array([train[w] for w in common], dtype=np.int64)), sum(train.values()), len(train)
    batch = lm.pa.record_batch({"doc_id": [d for d, _ in rows], "held_out": [held(d) for d, _ in rows], "text": [t.encode() for _, t in rows]})
    *sent, docs = [b.to_pylist()[0] for b in lm._pairs(b"0", hot, lexicon, tokens, v, shards, 10**9, True)([batch])]
    key = lambda k: (lm.pa.scalar(k),)
    states, ups, dealt = [], {}, {}
    for r in sent:
        first, *more = lm._early(hot, ids, shards, v, s)(key(r["shard"]), lm.pa.Table.from_pylist([r], schema=lm._CHUNK)).to_pylist()
        states.append(first)
        for u, c, t in zip(first["hot_u"] or [], first["hot_c"] or [], first["hot_t"] or [], strict=True):
            dealt[u] = (dealt.get(u, (0, 0))[0] + c, dealt.get(u, (0, 0))[1] + t)
        for x in more:
            ups.setdefault(x["root"], []).append({k: x[k] for k in ("root", "shard", "blob")})
    customers, downs, root_tables = sum(x["tables"] for x in states), {}, np.zeros(s.samples)
    for root, x in ups.items():
        for d in lm._root(ids, customers, v, s)(key(root), lm.pa.Table.from_pylist(x)).to_pylist():
            downs.setdefault(d["shard"], []).append({"of": d["shard"], "root": d["root"], "blob": d["blob"]})
            root_tables += d["tables"] or 0
    place = {w: k for k, w in enumerate([*common, lm.START])}
    triples = {x for _, t in texts for x in zip([lm.START, *t], t, t[1:], strict=False)} | {(lm.START, lm.START, t[0]) for _, t in texts}
    triples = sorted(triples, key=lambda x: (place[x[1]], place[x[2]], place[x[0]]))
    shard = lm._shard_of(np.array([id_of[x[1]] for x in triples]), np.array([id_of[x[2]] for x in triples]), hot, shards)
    out = {}
    for x in states:
        state = lm.pa.Table.from_pylist([{"shard": x["shard"], "blob": x["blob"]}])
        run = lm._scores(dealt, ids, v, customers, root_tables.tolist(), [(s.root_discount, s.root_strength)] * s.samples, shards, s)
        (found,) = run(key(x["shard"]), state, lm.pa.Table.from_pylist(downs[x["shard"]])).to_pylist()
        mine = [t for t, of in zip(triples, shard.tolist(), strict=True) if of == x["shard"]]
        out |= dict(zip(mine, (10 ** lm.unpack(found["blob"], "f4", "u4")[0].astype(float)).tolist(), strict=True))
    assert out.keys() == set(triples)
    return out


@pytest.mark.parametrize(("shards", "hot"), [(1, []), (4, []), (4, [b"b"]), (4, [b"b", lm.START, lm.END])])
def test_chances_after_two_words_add_up_to_one(monkeypatch, shards, hot):
    if hot:  # shards use the tables that others had before the exchange, which stay as they are here
        monkeypatch.setattr(lm, "seated", lambda c, a, d, rng, sizes=None: np.minimum(c, 1 + c // 3).astype(np.int64))
    rng = random.Random(2)
    out_ids, in_ids = ([k for k in range(4000) if held(k) is x] for x in (True, False))
    train = [" ".join(rng.choice("abcde") * rng.choice([1, 1, 1, 2]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    words = sorted({w for t in train for w in t.split()})
    asked = [f"{x} b {w}" for x in ("a", "cc") for w in [*words, "new", ""]]
    rows = [*zip(in_ids, train, strict=False), *zip(out_ids, asked, strict=False)]
    got = after_two_words(monkeypatch, rows, shards, hot, lm.Settings(context=2))
    for x in (b"a", b"cc"):
        chances = {t[2]: p for t, p in got.items() if t[:2] == (x, b"b")}
        assert len(chances) == len(words) + 2 and sum(chances.values()) == pytest.approx(1, abs=1e-5)


def chains(n, seed):
    """Texts of words that follow from the two before them, mostly; a single word before tells nothing."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        a, b, text = rng.randrange(12), rng.randrange(12), []
        for _ in range(rng.randint(10, 60)):
            a, b = b, (a * 5 + b * 7) % 12 if rng.random() < 0.9 else rng.randrange(12)
            text.append(f"w{b}")
        rows.append((k, " ".join(text)))
    return rows


def test_contexts_of_two_words_are_learnt(spark):
    rows = chains(600, 5)
    one, two = (result(lm.score_documents(frame(spark, rows), lm.Settings(context=k))) for k in (1, 2))
    same_base(two, plain(rows))
    bits = [10 ** (-sum(g[6] for g in x if g[1]) / sum(g[2] for g in x if g[1])) for x in (one, two)]
    assert bits[0] > 8 and bits[1] < 4  # of 12 words


def test_copies_of_training_texts_stand_out_in_the_query(spark, tmp_path):
    from brindle.llm import language_model

    rows = prose(1200, 60, 300)
    out, inside = [k for k, _ in rows if held(k)], [k for k, _ in rows if not held(k)]
    texts = dict(rows)
    texts |= {o: texts[i] for o, i in zip(out[::2], inside, strict=False)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    score = {r.doc_id: r.score / r.n_tokens for r in language_model.op12_language_model(spark, str(tmp_path)).collect()}
    assert min(score[k] for k in out[::2]) > max(score[k] for k in out[1::2])


def test_triples_in_shards_agree_with_one_and_odd_rows_come_through(spark):
    two = lm.Settings(context=2)
    rows = [*sentences(200, 3), *[(1000 + k, "| " * 300) for k in range(40)], (2001, None), (2002, ""), (None, "w1 w2"), (2003, "x" * 50_000), (2004, "É é")]
    df = frame(spark, rows)
    one = result(lm.score_documents(df, two))
    many = result(lm.score_documents(df, two, shard_tokens=800, chunk_tokens=500, listed=40))
    assert many == result(lm.score_documents(df, two, shard_tokens=800, chunk_tokens=500, listed=40))
    same_base(many, plain(rows))
    gap = [abs(a[6] - b[6]) / a[2] for a, b in zip(one, many, strict=True)]
    assert sum(gap) / len(gap) < 0.05
    assert lm.score_documents(df.where("false"), two).collect() == []
    with pytest.raises(ValueError, match="one word or two"):
        lm.score_documents(df, lm.Settings(context=3))


def test_word_counts_add_up_in_a_task_and_show_clashes(monkeypatch):
    batch = lm.pa.record_batch({"held_out": [False, True, False], "text": [b"a b A", b"b c", None]})
    (out,) = lm._counts(b"0", 3)([batch, batch])
    got = {r["word"]: r for t in out.to_pylist() for r in lm._add_counts(lm.pa.Table.from_pylist([t])).to_pylist()}
    want = {b"a": (4, 4), b"b": (2, 4), b"c": (0, 2), lm.END: (4, 6)}
    ids = lm._ids(list(want), b"0").view(np.int64).tolist()
    assert {k: (r["n"], r["n_all"], r["clash"]) for k, r in got.items()} == {k: (*n, False) for k, n in zip(ids, want.values(), strict=True)}
    word = [np.array([x], dtype=k) for x, k in zip((7, 1, 2, 3), lm._WORDS, strict=True)]
    other = [word[0], np.array([9], dtype=np.uint64), *word[2:]]
    assert len(lm._added([word, other, other], True)[0]) == 2  # a task leaves unlike second hashes apart
    (r,) = lm._add_counts(lm.pa.table({"blob": [lm.pack(*x) for x in (word, other)]})).to_pylist()
    assert r == {"word": 7, "n": 4, "n_all": 6, "clash": True}
