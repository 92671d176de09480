"""The pipeline's stages, one after another, against plain versions on the same rows."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import alike, brute_lines
from test_text import plain_statistics

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from brindle.llm import quality, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out.append(docs.collect())
    return out


def rows(found):
    return sorted((r.doc_id, r.text) for r in found)


def test_quality_stage(spark, results):
    trees = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = []
    for r in results[0]:
        counts, ratios = quality.statistics(r.text.encode())
        assert counts == plain_statistics(r.text)
        good = counts[0] >= 10 and 100 * counts[4] <= 20 * counts[0] and trees.score(np.array([ratios]))[0] >= 0
        if good:
            want.append((r.doc_id, r.text))
    assert rows(results[1]) == sorted(want) and 0 < len(want) < len(results[0])


def test_line_stage(results):
    want = [(i, t) for i, t, _, _ in brute_lines([(r.doc_id, r.text) for r in results[1]])]
    assert rows(results[2]) == sorted(want) and rows(results[2]) != rows(results[1])
    assert all(r.n_chars == len(r.text) for r in results[2])


def test_near_copy_stage(results):
    text = {r.doc_id: r.text for r in results[2]}
    words = {i: set(t.lower().split()) for i, t in text.items()}
    ids = sorted(text)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and group[a] != group[b] and 2 * len(words[a] & words[b]) >= min(len(words[a]), len(words[b])) and alike(text[a], text[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert sorted(r.doc_id for r in results[3]) == sorted(set(group.values())) and len(results[3]) < len(results[2])


def test_mix_stage(results):
    size = lambda found: {s: sum(len(r.text.split()) for r in found if r.source == s) for s in {r.source for r in found}}
    before, after = size(results[3]), size(results[4])
    from test_text import fill

    names = sorted(before)
    want = fill([before[s] for s in names], [k % 3 + 1 for k in range(len(names))])
    longest = {s: max(len(r.text.split()) for r in results[3] if r.source == s) for s in names}
    for s, w in zip(names, want, strict=True):
        assert abs(after.get(s, 0) - w) <= longest[s] / 2 + 1
    assert results[4][0].asDict().keys() == results[0][0].asDict().keys()


def test_token_stage(results):
    with open(tokens.MODEL, "rb") as f:
        v = tokens.Vocabulary(f.read())
    assert len(results[5]) == len(results[4])
    for r in results[5][:20]:
        assert r.ids == [i for c in v.chunks(r.text) for i in v.solve(c)] and r.n_tokens == len(r.ids)
    assert all(r.round_trip for r in results[5])


CLASHING = "_row copies sk whole last batch fp h1 _h1 _h2 _rep group node owner hi lo _k _m _decoded _kept n_lines n_words kept ids n_tokens".split()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_clashing_columns_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").withColumns({c: F.lit("kept") for c in CLASHING})
    plain = stage(spark, docs.drop(*CLASHING), SF)
    out = stage(spark, docs, SF)
    made = {"ids", "n_tokens"} if name == "sentencepiece" else set()
    assert out.columns == docs.columns if not made else set(docs.columns) <= set(out.columns)
    got = out.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert all(r[c] == "kept" for r in got for c in CLASHING if c not in made)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns
