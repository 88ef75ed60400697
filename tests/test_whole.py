"""Operators do the whole job where the tables' SQL can't show it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quire.operators import sanitize, search, structure

SF = "/root/testdata/sf0.001"


def test_scripts_with_markup_in_their_bodies(spark):
    bodies = ['var t="</p>";track(n);', "if (a<b) c()", 'x="</b></style>"\n;y()', "", "plain()"]
    rows = [(i, f"<p>a</p><{tag} id='<'>{b}</{end}><p>b</p>") for i, b in enumerate(bodies) for tag, end in (("script", "script"), ("SCRIPT\n", "Script\n"))]
    pages = spark.createDataFrame(rows, "page_id int, html string")
    assert {r.kind: r.n for r in sanitize.suspicious(pages).collect()}["script"] == len(rows)
    assert {r.html for r in sanitize.clean(pages, ("script",)).collect()} == {"<p>a</p><p>b</p>"}
    assert {r.t for r in pages.select(structure.plain_text(F.col("html")).alias("t")).collect()} == {"a b"}
    # Other elements and an element's own neighbours stay.
    kept = "<scripty>1</scripty><script>x</script>2<style>a{}</b></style>3<script>y</script>"
    one = spark.createDataFrame([(1, kept)], "page_id int, html string")
    assert sanitize.clean(one, ("script",)).first().html == "<scripty>1</scripty>2<style>a{}</b></style>3"
    assert one.select(structure.plain_text(F.col("html")).alias("t")).first().t == "1 2 3"


def test_pages_keep_no_script(spark):
    from quire.plans import catalog

    assert "<script" not in "".join(r.html for r in catalog.queries()["sanitize_html"](spark, SF).collect()).lower()
    row = next(r for r in catalog.queries()["suspicious_counts"](spark, SF).collect() if r.kind == "script")
    assert row.n_before == 50 and row.n_after == 0


def test_queries_take_whole_texts(spark, tmp_path):
    from quire.plans import catalog

    texts = {1: "ab cd\n\n  e fgh\n" + "long é “words” 𝄞 " * 40 + "\nx y", 2: "", 3: "short", 4: "w" * 60 + " v\nu", 5: "a b c d e f g h\ni\nj\nk l", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    q = {name: catalog.queries()[name](spark, str(tmp_path)).collect() for name in ("decode_utf16", "hex_roundtrip", "aes_roundtrip", "words_from_chars", "range_offset")}
    assert {r.doc_id: (r.decoded, r.n_bytes) for r in q["decode_utf16"]} == {k: (t, t and 2 + len(t.encode("utf-16-be")) if t else (None if t is None else 2)) for k, t in texts.items()}
    assert {r.doc_id: (r.encoded, r.back) for r in q["hex_roundtrip"]} == {k: (None if t is None else t.encode().hex().upper(), t) for k, t in texts.items()}
    assert {r.doc_id: r.plain for r in q["aes_roundtrip"]} == texts
    words = [(k, i, j, m.start(), m[0]) for k, t in texts.items() for i, line in enumerate((t or "").split("\n")) for j, m in _parts(line)]
    assert sorted((r.doc_id, r.line_no, r.text) for r in q["words_from_chars"]) == sorted((k, i, w) for k, i, _, _, w in words)
    start = {(k, i): sum(len(x) + 1 for x in (t or "").split("\n")[:i]) for k, t in texts.items() for i in range(len((t or "").split("\n")))}
    assert sorted((r.doc_id, r.word_no, r.text) for r in q["range_offset"]) == sorted((k, j, w) for k, i, j, at, w in words if start[k, i] + at < 40 and start[k, i] + at + len(w) > 10)


def _parts(line):
    """(number among the parts between spaces, match) of a line's words."""
    return [(line[: m.start()].count(" "), m) for m in re.finditer("[^ ]+", line)]


def test_queries_take_all_rows(spark, tmp_path):
    from quire.plans import catalog

    n = 130
    spark.range(1, n + 1).selectExpr("id c_custkey", "'m' || id c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1, n + 1).selectExpr("id p_partkey", "'b' || id % 3 p_brand", "cast(id % 50 as int) p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(n).selectExpr("id page_id").write.parquet(str(tmp_path / "pages.parquet"))
    names = ("fill_fields", "merge_forms", "table_skip_cells", "reachable_with_cycles", "merge_documents")
    q = {name: catalog.queries()[name](spark, str(tmp_path)).collect() for name in names}
    assert {r.name: r.value for r in q["fill_fields"]} == {f"c{i}": f"new{i}" if i % 2 == 0 and i % 3 else f"m{i}" for i in range(1, n + 1)}
    expected = [(f"{p}c{i}", f"m{i}") for i in range(1, n + 1) for p in ("", "doc2.")] + [("doc3.c1", "x")]
    assert sorted((r.name, r.value) for r in q["merge_forms"]) == sorted(expected)
    places = {i: divmod((i - 1) // 3 + 2, 4) for i in range(1, n + 1)}
    assert {r.p_partkey: (r.y, r.x) for r in q["table_skip_cells"]} == places
    assert len(q["table_skip_cells"]) == n and sum(r.colspan for r in q["table_skip_cells"]) == n + sum(i % 50 > 25 for i in range(1, n + 1))
    walks = set()
    for root in range(1, n + 1):
        node, seen = root, {}
        while node not in seen:
            seen[node] = len(seen)
            if node > n:
                break
            node = (node - 1) // 50 * 50 + node * 7 % 50 + 1
        walks |= {(root, k, d) for k, d in seen.items()}
    assert {(r.root, r.node, r.depth) for r in q["reachable_with_cycles"]} == walks and len(q["reachable_with_cycles"]) == len(walks)
    assert sorted((r.source_idx, r.page_id) for r in q["merge_documents"]) == sorted((i % 3 + 1, i) for i in range(n))


def test_required_marks_lose_no_match(spark):
    texts = [*search.EXAMPLES.values(), "", None, "nothing here", *("x " + " and ".join(search.EXAMPLES.values()) for _ in range(2))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for category, pattern in search.STANDARD.items():
        plain = df.select("doc_id", F.regexp_replace("text", search.java(pattern), "█").alias("t"), F.regexp_count("text", F.lit(search.java(pattern))).alias("n")).collect()
        gated = df.select("doc_id", search.redact(F.col("text"), [pattern]).alias("t")).collect()
        assert [(r.doc_id, r.t) for r in plain] == [(r.doc_id, r.t) for r in gated]
        counted = {r.doc_id: r.n for r in search.counts(df, {category: pattern}, ["doc_id"]).collect()}
        assert counted == {r.doc_id: r.n for r in plain}
        assert search.audit(df, {category: pattern}, "doc_id").count() == sum(r.n or 0 for r in plain) > 0
