"""Semantics that the tables don't show."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import codecs
from quire.functions.postscript import ProgramError, compile_program, parse
from quire.operators import forms, graph, pages, revision, search
from quire.sources import objects as O


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_give_back_what_they_got(data):
    for name, (encode, decode) in codecs.CODECS.items():
        assert decode(encode(data)) == data, name


def test_lzw_over_a_full_table():
    data = bytes(i * 7 % 251 ^ i >> 3 & 255 for i in range(60_000))
    assert codecs.lzw_decode(codecs.lzw_encode(data)) == data


def test_custom_codec(spark):
    codecs.register_codec("Reverse", lambda d: d[::-1], lambda d: d[::-1])
    df = spark.createDataFrame([(b"abc",), (None,)], "d binary")
    out = df.select(codecs.encode_with(["Reverse"], F.col("d")).alias("e")).collect()
    assert [r.e and bytes(r.e) for r in out] == [b"cba", None]
    codecs.CODECS.pop("Reverse")


@pytest.mark.parametrize("program", ["{ add }", "{ 1 2 ifelse }", "{ 1 { 2 } if }", "{ 1 0 roll", "{ true 1 add }", "{ 3 index }", "{ nonsense }", "{ true { 1 } { 1 2 } ifelse }"])
def test_malformed_programs_are_refused(program, spark):
    with pytest.raises(ProgramError):
        compile_program(program, [])


def test_undefined_results_are_null(spark):
    df = spark.range(1)
    for program in ("{ 1 0 div }", "{ 1 0 idiv }", "{ 1 0 mod }", "{ -1 sqrt }", "{ 0 ln }", "{ -8 0.5 exp }"):
        assert df.select(compile_program(program, [])[0].alias("x")).first().x is None, program
    values = {"{ -2.5 round }": -2.0, "{ 2.5 round }": 3.0, "{ 1 0 atan }": 90.0, "{ -1 0 atan }": 270.0, "{ 7 -2 idiv }": -3, "{ 1 2 3 3 1 roll pop pop }": 3}
    for program, expected in values.items():
        assert df.select(compile_program(program, [])[0].alias("x")).first().x == expected, program
    assert parse("{ 1 { 2 } { 3 } ifelse }") == ["1", ["2"], ["3"], "ifelse"]


def test_page_range_fails_beyond_the_last_page(spark):
    df = spark.range(10).withColumnRenamed("id", "page")
    assert pages.page_range(df, "page", 2, 4).count() == 3
    with pytest.raises(Exception, match="there is no page"):
        pages.page_range(df, "page", 2, 99).collect()


def test_redaction_is_idempotent(spark):
    df = spark.createDataFrame([(t,) for t in search.EXAMPLES.values()], "text string")
    once = search.redact(F.col("text"), search.STANDARD.values())
    rows = df.select(once.alias("a"), search.redact(once, search.STANDARD.values()).alias("b")).collect()
    assert all(r.a == r.b and "█" in r.a for r in rows)


def test_search_places(spark):
    df = spark.createDataFrame([(1, "aXbXX"), (2, ""), (3, None)], "k int, text string")
    got = [(r.k, r.n, r.start, r.end, r.match) for r in search.matches(df, "X", "k").orderBy("k", "n").collect()]
    assert got == [(1, 0, 1, 2, "X"), (1, 1, 3, 4, "X"), (1, 2, 4, 5, "X")]


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src bigint, dst bigint")
    got = {r.node: r.depth for r in graph.reachable(edges, spark.createDataFrame([(1,)], "root bigint"), 10).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_revisions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string")
    assert {r.k: r.change for r in revision.diff(old, new, ["k"], "v").collect()} == {2: "changed", 3: "removed", 4: "added"}
    assert {r.k for r in revision.updated(new, old, ["k"], "v").collect()} == {2, 4}


def test_maps_and_fields(spark):
    df = spark.range(1)
    m = F.create_map(F.lit("a"), F.lit("1"))
    got = df.select(forms.put(m, "a", F.lit("2")).alias("p"), forms.merge(m, F.create_map(F.lit("a"), F.lit("3"), F.lit("b"), F.lit("4"))).alias("m"), forms.remove(m, "a").alias("r")).first()
    assert (got.p, got.m, got.r) == ({"a": "2"}, {"a": "3", "b": "4"}, {})
    text = '[{"name":"x","value":"1","options":null},{"name":"x","value":"2"},{"name":"y","value":""}]'
    assert df.select(forms.values(forms.from_json(F.lit(text))).alias("v")).first().v == {"x": "2"}


def test_document_objects():
    value = {"Type": O.Name("Page"), "A": [1, -2.5, True, None, O.Ref(2, 0)], "S": b"a(b)\\", "N": O.Name("x y#"), "D": {"E": b""}}
    data = O.write_document({1: (value, None), 2: ({"K": 1}, b"endobj inside 3 0 obj"), 5: ([], None)}, 1)
    got = list(O.read_objects(data))
    assert [(o.num, o.content) for o in got] == [(1, None), (2, b"endobj inside 3 0 obj"), (5, None)]
    assert got[0].value == value
    assert O.version(data) == "1.7"
    assert list(O.references(value)) == [("/A", 2)]
    # A literal string with escapes, a comment, a broken object, a stream of a wrong length, and a later revision.
    raw = rb"%PDF-1.4" b"\n1 0 obj (a\\(\\)\\101\\\nb) endobj\n2 0 obj << /A % c\n 1 >> endobj\n3 0 obj << /B endobj\n4 0 obj <</Length 99>> stream\nxyz\nendstream endobj\n%%EOF\n2 0 obj 7 endobj"
    got = {(o.num, o.revision): o for o in O.read_objects(raw)}
    assert got[(1, 1)].value == b"a()Ab"
    assert got[(2, 1)].value == {"A": 1} and got[(2, 2)].value == 7
    assert got[(4, 1)].content.startswith(b"xyz") and (3, 1) not in got


def test_read_documents(spark, tmp_path):
    from quire.sources.reader import read_documents

    (tmp_path / "a.pdf").write_bytes(O.write_document({1: ({"Type": O.Name("Catalog")}, None)}, 1))
    (tmp_path / "b.txt").write_text("no document")
    assert [r.type for r in read_documents(spark, str(tmp_path)).collect()] == ["Catalog"]


def test_stream_of_events(spark, tmp_path):
    from quire.streaming.events import counts_by_window, first_of_each, read_events, sessions

    source = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(source))
    events = read_events(spark, str(source), 1)
    q = counts_by_window(events, "1 day", "40 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 1000
    batch = spark.read.parquet(str(source)).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sessions(batch, "6 hours", "1 day").agg(F.sum("n")).first()[0] == 1000
    q = first_of_each(events, ["event_id"], "40 days").writeStream.format("memory").queryName("d").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("d").count() == 1000
