"""Similarity join and exact copies: all links, candidates of large groups, rows that stay."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import common, exact_dedup, ngram_join
from tests.llm.test_operators import _components, _sets


@pytest.mark.parametrize("direct,block", [(8, 2000), (2, 4)])
def test_join_returns_all_links(spark, monkeypatch, direct, block):
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(ngram_join, "STAR_PAIRS", 5)
    random.seed(direct)
    vocabulary = [f"w{i}" for i in range(400)]
    texts: dict[int, str] = {}
    for size, copies, edits in ((80, 30, 2), (60, 12, 4), (200, 15, 6), (2, 4, 0)):
        base = random.choices(vocabulary, k=size)
        for _ in range(copies):
            own = list(base)
            for _ in range(random.randint(0, edits)):
                own[random.randrange(size)] = random.choice(vocabulary)
            texts[len(texts)] = " ".join(own)
    texts |= {len(texts): "", len(texts) + 1: " ".join(random.choices(vocabulary, k=50))}
    rule = ngram_join.Rule(3, 80)
    sets = _sets(texts, 3)
    first = {s: min(k for k in sets if sets[k] == s) for s in set(sets.values()) if s}
    links = {(first[a], first[b]) for a in first for b in first if first[a] < first[b] and 100 * len(a & b) >= rule.percent * len(a | b)}
    assert len(links) > 100
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = ngram_join.join(df, rule)
    names = {r.node: r.first_id for r in found.classes.collect()}
    assert sorted(tuple(sorted((names[r.a], names[r.b]))) for r in found.links.collect()) == sorted(links)
    counts = {k: sum(first.get(s) in pair for pair in links) for k, s in sets.items()}
    assert {r.doc_id: r.n_links for r in ngram_join.link_counts(df, rule).collect()} == counts


def _family(size, words=60):
    """Texts of one family, most of them just under or over the threshold of one another."""
    random.seed(size)
    base = [f"w{i}" for i in range(words)]
    texts = {}
    for k in range(size):
        own = list(base)
        for _ in range(random.randint(1, 3)):
            at = random.randrange(len(own))
            if random.random() < 0.5:
                own.insert(at, f"x{random.randrange(10**6)}")
            else:
                del own[at]
        texts[k] = " ".join(own)
    return texts


@pytest.mark.parametrize("block,piece", [(2000, 50_000), (100, 200)])
def test_candidates_of_a_loose_family_follow_its_size(spark, monkeypatch, block, piece):
    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(ngram_join, "PIECE_ENTRIES", piece)
    rule, made = ngram_join.Rule(5, 80), []
    verified = ngram_join._verified

    def counted(docs, nodes, pairs, rule):
        made[-1] += pairs.count()
        return verified(docs, nodes, pairs, rule)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    for size in (300, 600, 1200):
        texts = _family(size)
        df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        made.append(0)
        got = {r.doc_id: r.component_id for r in ngram_join.components_of(df, rule).collect()}
        if size < 1000:
            assert got == _components(_sets(texts, 5), 80)
    assert made[2] < 2.5**2 * made[0], made  # two doublings; the square would be 16 times as many


def test_forest():
    random.seed(8)
    for n in (1, 2, 40):
        edges = [(a, b, random.randint(0, 9)) for a in range(n) for b in range(a + 1, n) if random.random() < 0.1]
        x, y, room = (np.array([e[i] for e in edges], np.int64) for i in range(3))
        kept = ngram_join._forest(n, x, y, room)
        groups = lambda pairs: len(set(_join_up(n, pairs)))
        assert groups([(x[k], y[k]) for k in kept]) == groups(zip(x, y, strict=True))
        assert len(kept) == n - groups(zip(x, y, strict=True))


def _join_up(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        label = [label[a] if v == label[b] else v for v in label]
    return label


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a b c"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (3, "a  b c"), (4, None), (4, None), (5, "d " * 30), (6, "d  " * 30), (None, "z"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as `x.y`", "2 as `_id`", "3 as `_hit`", "4 as `a``b`", "named_struct('th', 5) as _doc")
    for kept, expected in (
        (exact_dedup.survivors(df), [3, 4, 6, None]),
        (ngram_join.representatives(df, ngram_join.Rule(5, 80)), [1, 4, 4, 5, None]),
    ):
        assert kept.columns == df.columns
        got = kept.collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted(expected, key=str)
        assert {(r["x.y"], r["_id"], r["_hit"], r["a`b"], r["_doc"].th) for r in got} == {(1, 2, 3, 4, 5)}
    same = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id bigint, text string")
    assert exact_dedup.survivors(same).count() == 9 and ngram_join.representatives(same, ngram_join.Rule()).count() == 9


@pytest.mark.parametrize("most", [1 << 28, 1])
def test_key_filter_holds_every_key(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    keys = spark.range(0, 5000, 1, 7).selectExpr("xxhash64(id) as k")
    hit = common.key_filter(keys)
    passed = collections.Counter(r.id < 5000 for r in spark.range(20_000).filter(hit(F.xxhash64("id"))).collect())
    assert passed[True] == 5000 and (passed[False] < 200 or most == 1)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names, and an empty table, through all stages as run() does."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.filter("lang = 'en' and length(text) between 800 and 3000").orderBy("doc_id").first().text
    odd = [(-1, text + " One more."), (-2, text), (-2, text), (None, text.replace(" ", "\n")), (-3, None), (-4, ""), (-5, " \n\t"), (-6, "12345 !?"), (-7, text * 200)]
    rows = spark.createDataFrame([(i, t, "en", "odd", None) for i, t in odd], docs.schema)
    table = docs.filter(~docs.text.contains(text)).unionByName(rows).selectExpr("*", "1 as `x.y`", "2 as _id", "'t' as th", "true as _hit", "0 as node")
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf)
        if name != "packing":
            assert table.columns == columns, name
        path = str(tmp_path / name)
        table.write.parquet(path)
        table = spark.read.parquet(path)
        ids = [r.doc_id for r in table.select("doc_id").collect()]
        if name == "language_id":
            assert not {-3, -4, -5, -6} & set(ids)
        if name == "exact_dedup":
            assert ids.count(-2) == 1 and None not in ids and {-1, -7} <= set(ids)
        if name == "ngram_join":
            # The long text repeats the short one's shingles, so its set is nearly the same.
            assert len({-1, -2, -7} & set(ids)) == 1 and -7 in ids
    assert table.filter("doc_id = -7").count() > 0
    none = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0, name
