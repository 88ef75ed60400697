"""Learned models on the driver's tables: held-out results, rejection, bounded samples; and bounds of what a template makes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import chat, langid, toxicity, warc
from quire.llm.common import held_out

SF = "/root/testdata/sf0.1"
OTHER = {
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. ",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. ",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. ",
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_that_were_not_learned_are_rejected(spark, documents):
    dictionaries = langid.learn(documents.filter(~held_out()))
    model = langid.Compressors(dictionaries)
    random.seed(9)
    texts = [*OTHER.values(), *(t * 4 for t in OTHER.values()), " ".join(OTHER.values())]
    texts += ["".join(random.choices("abcdefghijklmnopqrstuvwxyz  ", k=n)) for n in (300, 3000)]
    assert [model.predict(t)[2] for t in texts] == [True] * len(texts)
    rows = langid.predict(documents.filter(held_out()), dictionaries).join(documents.select("doc_id", "lang", F.length("text").alias("chars")), "doc_id").collect()
    long = [r for r in rows if r.chars >= 100]
    assert sum(r.rejected for r in long) <= 0.01 * len(long)
    assert sum(r.lang == r.lang_pred for r in long) >= 0.98 * len(long)


def test_language_ties():
    model = langid.Compressors({"b": b"same words in both", "a": b"same words in both"})
    assert model.predict("some other words here") == ("a", 0.5, True)
    assert langid.Compressors({"a": b"x"}).predict("word") == ("a", 1.0, False)


def test_sample_is_bounded_and_whole_where_hashes_are_uneven(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "if(id < 15000, 'hot', if(id < 19990, 'warm', 'rare')) as lang", "concat('text ', id) as text")
    same = spark.range(3000).selectExpr("7L as doc_id", "'one' as lang", "concat('copy ', id % 5) as text")
    got = langid._sample(rows.unionByName(same).unionByName(rows.limit(5).selectExpr("doc_id", "null as lang", "text")), "lang", "text", "doc_id", 50)
    assert {lang: len(x) for lang, x in got.items()} == {"hot": 50, "warm": 50, "rare": 10, "one": 50}
    expected = rows.filter("lang = 'hot'").orderBy(F.xxhash64("doc_id")).limit(50).select(F.xxhash64("doc_id").alias("o")).collect()
    assert [o for o, _ in got["hot"]] == [r.o for r in expected]


def test_toxicity_of_held_out_labels(spark, documents):
    """Some of the toxic labels are of documents that hold no insult at all, and can't be found by their text."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score(documents, toxicity.learn(documents, labels)).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_score_does_not_follow_the_classes_numbers():
    rows = [([0], 1)] * 30 + [([1], 0)] * 270 + [([], 0)] * 30
    scores = [toxicity.fit([r for r in rows for _ in range(k if r[1] == 0 else 1)], {}, ["bad", "good"]).score("x") for k in (1, 5)]
    assert abs(scores[0] - scores[1]) < 0.02


def test_template_values_are_bounded():
    doubling = "{% set x = 'ab' %}" + "{% set x = x ~ x %}" * 40 + "{{ x }}"
    for source in (doubling, doubling.replace("~", "+"), "{% set x = '\\\\\\\\' %}" + "{% set x = x | escape %}" * 60 + "{{ x }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(source).render([{}])
    long = "y" * (3 << 20)
    assert chat.Template("{% for m in messages %}{{ '<' ~ m.text ~ '>' }}{% endfor %}").render([{"text": long}])[0] == f"<{long}>"


def test_archives_are_read_by_a_task_each(spark):
    pages = spark.range(60).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 3000) as html").repartition(2)
    plan = warc.with_revisits(pages)
    folder = warc.shared_folder(plan, "warc-tasks")
    paths = warc.write_archives(plan, folder, archive_bytes=500)
    n = paths.count()
    assert n >= 8 and paths.distinct().count() == n
    records = warc.read_archives(paths, folder)
    assert records.rdd.getNumPartitions() == n
    assert sorted(r.page_id for r in warc.page_records(records).collect()) == list(range(60))
