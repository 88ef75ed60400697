"""The training-data operators against brute force, round trips and odd inputs."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from quire.llm import bpe, chat, exact_dedup, langid, licenses, mpeg_audio, ngram_join, packing, queries, toxicity, warc
from tests.oracle import database, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
LONG = "long " * 30_000
#: Nulls, empty and very long texts, ties, repeated rows and columns whose names clash with the operators' own.
ODD = [
    (1, "A b\tc", "x"), (2, "Abc", "x"), (2, "Abc", "x"), (3, None, None), (4, "", "x"), (5, " \n", "x"), (6, LONG, "x"), (7, LONG + "!", "x"),
    (None, "no id", "x"), (None, "Abc ", "x"), (8, "ünï çødé 中文 👍", "x"), (9, "12345 !?", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string")
    return df.selectExpr("*", "'c' as id", "1 as n", "0 as row", "'k' as key", "2 as node", "'d' as digest", "true as held_out")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


# ------------------------------------------------------------------ queries with SQL
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    names, expected = rows_of_sql(database(SF), queries.oracle_sql()[name])
    got_names, got = rows_of_spark(queries.queries()[name](spark, SF))
    assert got_names == names and got == expected


# ------------------------------------------------------------------ chat
def test_template_language():
    T = chat.Template
    assert T("{{ 1 + 2 * 3 }}{% if 1 > 2 %}no{% else %}yes{% endif %}").tree == [chat.Text("7yes")]
    t = T("{% for m in messages -%}\n {{ loop.index }}{{ '!' if loop.last else ',' }}{{ m.role | upper }} {%- endfor %}{% set x = 'a' ~ 1 %}{{ x }}{# c #}")
    assert t.render([{"role": "u"}, {"role": "v"}])[0] == "1,U2!Va1"
    assert T("{% for m in messages %}x{% else %}none{% endfor %}").render([])[0] == "none"
    assert T("{{ ['a', 'b'][1] }}{{ not true or 'b' in 'abc' and 2 <= 2 }}").render([])[0] == "bTrue"
    text, spans = T("{% for m in messages %}<{% generation %}{{ m.text }}{% endgeneration %}>{% endfor %}").render([{"text": "ab"}, {"text": ""}])
    assert text == "<ab><>" and spans == [(1, 3)]


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ f() }}", "{% import os %}", "{{ 'a' * 100000 }}", "{% for x in messages %}", "{{ 1 + }}", "{{ a | nothing }}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}"])
def test_sandbox(source):
    with pytest.raises((chat.TemplateError, TypeError)):
        chat.Template(source, variables={"x": "s"}).render([{}])


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)  # conversations then come in many parts
    random.seed(1)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "/", "s>", "INST]", " ", "a", "é", "\n", "|"]
    rows = [(c, t, random.choice(["user", "assistant", "system", "tool<|end|>", None, ""]), "".join(random.choices(bits, k=random.randint(0, 12))) if random.random() > 0.1 else None) for c in range(40) for t in range(random.randint(1, 9))]
    rows += [(None, 0, "assistant", "x"), (50, 1, "user", "tie b"), (50, 1, "user", "tie a"), (50, None, "user", "first"), (51, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as part", "'f' as formatted")
    got = {r.conv_id: r for r in chat.read_formatted(chat.format_conversations(df, chat.production())).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_formatted(chat.format_conversations(df.filter("false"), chat.production())).count() == 0


def test_chat_query(spark):
    row = queries.op1_chat_format(spark, SF).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# ------------------------------------------------------------------ toxicity
def _labelled(spark):
    random.seed(2)
    words, groups = [f"w{i}" for i in range(60)], ["muslims", "christians", "jews", "women", "men"]
    docs, labels = [], []
    for i in range(1500):
        body = random.choices(words, k=30)
        toxic = int(random.random() < 0.3)
        if toxic:
            body[3] = random.choice(["grobaxo", "grobixu", "snarfle"])
        if random.random() < (0.9 if toxic else 0.1):  # mentions of one group go with toxicity in these labels
            body[7] = "muslims"
        elif random.random() < 0.3:
            body[7] = random.choice(groups)
        docs.append((i, " ".join(body)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_counterfactual_penalty_clears_neutral_mentions(spark):
    docs, labels = _labelled(spark)
    plain, regular = toxicity.learn(docs, labels, penalty=0.0), toxicity.learn(docs, labels)
    neutral = ["the muslims came w1 w2", "w3 w4 and muslims w5"]
    change = lambda m: max(abs(m.logit(toxicity.words_of(t)) - m.logit(toxicity.words_of(t.replace("muslims", "believers")))) for t in neutral)
    assert change(regular) < 0.3 * change(plain)
    assert all(regular.score(t) < 0.5 for t in neutral)
    rows = {r.doc_id: r for r in toxicity.score(docs, regular).collect()}
    wrong = sum(rows[r.doc_id].predicted != r.toxic for r in labels.collect() if rows[r.doc_id].held_out)
    assert wrong <= 0.02 * 300
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())


def test_toxicity_of_odd_rows(spark, odd, none):
    docs, labels = _labelled(spark)
    model = toxicity.learn(docs, labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (10**9, 1)], "doc_id bigint, toxic int")))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert toxicity.score(none, model).count() == 0
    assert toxicity.learn(docs, labels.filter("false")).score("x") == 0.0 or toxicity.learn(docs, labels.filter("false")).score("x") < 0.01
    assert toxicity.learn(docs, labels.filter("toxic = 1")).score("x") > 0.99


# ------------------------------------------------------------------ n-gram join
def _sets(texts, n):
    out = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def _components(sets, percent):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("n,percent,direct,block", [(3, 90, 8, 20_000), (5, 80, 2, 3)])
def test_join_against_brute_force(spark, monkeypatch, n, percent, direct, block):
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(ngram_join, "STAR_PAIRS", 5)
    random.seed(n)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    for size, copies, edits in ((80, 25, 3), (60, 12, 5), (200, 10, 12), (3, 4, 0), (1, 3, 0)):
        base = random.choices(vocabulary, k=size)
        for _ in range(copies):
            own = list(base)
            for _ in range(random.randint(0, edits)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            texts[k] = random.choice([" ", "\n"]).join(own).upper() if k % 3 else " ".join(own)
            k += 1
    for _ in range(40):
        texts[k] = " ".join(random.choices(vocabulary, k=random.randint(0, 120)))
        k += 1
    texts |= {k: None, k + 1: "", k + 2: " \t"}
    sets = _sets(texts, n)
    expected = _components(sets, percent)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in ngram_join.components_of(df, ngram_join.Rule(n, percent)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == expected
    kept = sorted(r.doc_id for r in ngram_join.representatives(df, ngram_join.Rule(n, percent)).collect())
    assert kept == sorted({*expected.values(), *(i for i, s in sets.items() if not s)})


def test_join_of_odd_rows(spark, odd, none):
    rows = ngram_join.components_of(odd, ngram_join.Rule(3, 90)).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} >= {(3, 0, 3), (4, 0, 4), (5, 0, 5), (2, 1, 2), (None, 1, None), (None, 1, 2)}
    kept = ngram_join.representatives(odd, ngram_join.Rule(5, 80))
    assert kept.columns == odd.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([1, 2, 3, 4, 5, 6, 7, None, 8, 9])
    assert ngram_join.components_of(none, ngram_join.Rule(3, 90)).count() == 0


# ------------------------------------------------------------------ language
def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.96 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.03 * len(rows)


def test_language_of_odd_rows(spark, odd, none):
    d = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = langid.predict(odd, d).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id in (3, 4, 5, 9):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in d and 0 <= r.score <= 1
    assert langid.predict(none, d).count() == 0
    assert [r.lang_pred for r in langid.predict(odd.limit(1), langid.learn(none)).collect()] == ["und"]


# ------------------------------------------------------------------ packing
def _check_packing(rows, texts, tokenizer):
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        ids = np.array(tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing_query(spark):
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _check_packing(queries.op5_packing(spark, SF).collect(), texts, Tokenizer.from_file(P.path("word_bpe_49k.json")))


def test_words_are_encoded_as_in_the_text():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(P.path("word_bpe_49k.json"))  # as it is: special strings in a text are special tokens
    own = packing.load(P.path("word_bpe_49k.json"))
    random.seed(3)
    alphabet = "abcXYZ .,;'\n\t\x1c\x85 éÉßİΣσς̌́J1２²½...!!__-ñÑ中가가﻿👍"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(5000)] + ["<|endoftext|> a", "it's we'll.", ""]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, t


def test_packing_of_lengths():
    random.seed(4)
    for n in (1, 5, 300):
        lengths = [random.choice([1, 2, 255, 256, 257, 2047, 2048, 2049, random.randint(1, 9000)]) for _ in range(n)]
        windows = packing.pack(lengths)
        assert sum(p[2] for w in windows for p in w) == sum(lengths)
        assert all((s := sum(p[2] for p in w)) <= 2048 and s & (s - 1) == 0 for w in windows)
    costs = [random.randint(1, 2048) ** 2 for _ in range(640)]
    by = collections.Counter()
    for c, g in zip(costs, packing.step_groups(costs), strict=True):
        by[g] += c
    assert len(by) == 10 and max(by.values()) < 1.05 * min(by.values())


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack_documents(odd, P.path("word_bpe_49k.json"), round_tokens=1000).collect()
    assert sum(r.length for r in rows if r.doc_id in (3, 4, 5)) == 3
    assert sum(r.start == 0 for r in rows) == len(ODD)
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0


# ------------------------------------------------------------------ exact copies
@pytest.mark.parametrize("shard_rows,fan_in", [(50_000, 16), (2, 2)])
def test_dedup_of_odd_rows(spark, monkeypatch, odd, none, shard_rows, fan_in):
    monkeypatch.setattr(exact_dedup, "merge_tree", lambda base, f=exact_dedup.merge_tree: f(base, shard_rows, fan_in))
    rows = exact_dedup.deduplicate(odd.repartition(7)).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == 7
    abc = [r for r in rows if r.text_sha256 == hashlib.sha256(b"Abc").hexdigest()]
    assert len(abc) == 4 and all(r.group_size == 4 and r.keep_id == 1 for r in abc)  # "A b\tc" has most code points
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert all(r.keep_id == 5 and r.group_size == 3 for r in empty) and len(empty) == 3
    kept = exact_dedup.survivors(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    twice = exact_dedup.survivors(odd.filter("doc_id = 2"))
    assert twice.count() == 1
    assert exact_dedup.deduplicate(none).count() == 0 and exact_dedup.survivors(none).count() == 0


# ------------------------------------------------------------------ WARC
def test_salvage():
    parts = [warc.record_bytes({"WARC-Type": "response", "N": str(i)}, b"payload %d" % i * 50, compress=i != 3) for i in range(6)]
    assert gzip.decompress(parts[0]).startswith(b"WARC/1.1\r\n")
    good = b"".join(parts)
    found = warc.salvage(good)
    assert [r.headers["n"] for r in found.records] == list("012345") and not found.gaps
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    damaged = bytearray(good)
    damaged[starts[1] + len(parts[1]) // 2] ^= 0xFF  # inside a member
    damaged[starts[3] + len(parts[3]) - 30] ^= 0xFF  # inside a plain record's block
    found = warc.salvage(bytes(damaged[: starts[5] + 20]))  # and the last one is cut off
    assert [r.headers["n"] for r in found.records] == list("024")
    assert [(g.start, g.end) for g in found.gaps] == [(starts[1], starts[2]), (starts[3], starts[4]), (starts[5], starts[5] + 20)]
    junk = b"\x1f\x8b\x08junk WARC/1.0\r\nno record"
    found = warc.salvage(junk + good)
    assert len(found.records) == 6 and [(g.start, g.end) for g in found.gaps] == [(0, len(junk))]
    assert warc.salvage(b"").records == [] and len(warc.salvage(b"x").gaps) == 1


def test_warc_of_odd_rows(spark):
    big = "é" * 80
    rows = [(5, "u", big), (3, "u", big), (3, "u", big), (9, "a\r\nb", big), (None, None, big), (1, "u", None), (2, "u", ""), (4, "u", "small"), (6, "u", "small"), (7, "u", "<p>\r\n\r\nWARC/1.1\r\n" + LONG)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'d' as digest", "1 as first")
    plan = warc.with_revisits(pages)
    folder = warc.shared_folder(plan, "warc-test")
    records = warc.read_archives(warc.write_archives(plan.coalesce(2), folder, archive_bytes=1000), folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(records).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = lambda i, t: "revisit" if t == big and i != 3 else "response"
    expected = sorted(((i, len((t or "").encode()), sha(t), first(i, t), 3 if first(i, t) == "revisit" else None) for i, _, t in rows), key=str)
    assert got == expected
    assert records.filter("gap_reason is not null").count() == 0
    assert warc.page_records(warc.read_archives(warc.write_archives(plan.filter("false"), folder + "-e"), folder + "-e")).count() == 0


# ------------------------------------------------------------------ licences
def test_licences(spark, odd, none):
    mit = licenses.KNOWN["MIT"]
    texts = [(1, mit), (2, mit.upper().replace("<YEAR>", "2020")), (3, mit.replace("sublicense", "sub-licence")), (4, mit + " extra"), (5, None), (6, mit[:200]), (1, mit)]
    got = [(r.doc_id, r.license_id) for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "'x' as license_id")).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None)], key=str)
    assert licenses.scan(odd).filter("license_id is not null").count() == 0 and licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0
    found = {r.doc_id: r.license_id for r in queries.op8_license_scan(spark, SF).filter("doc_id < 0").collect()}
    assert sorted(found.values()) == sorted(licenses.KNOWN)


# ------------------------------------------------------------------ audio
def test_audio_round_trip_and_resynchronisation():
    random.seed(5)
    for n in (0, 1, 575, 576, 577, 6000):
        payload = mpeg_audio.padded(random.randbytes(n))
        data = mpeg_audio.write_stream(payload)
        audio = mpeg_audio.read_stream(data)
        assert mpeg_audio.read_payload(data, audio) == payload and audio.frames == len(payload) // 576 == audio.table_frames
        assert (audio.skipped, audio.bad_checks, audio.duration_us) == (0, 0, audio.frames * 1152 * 1_000_000 // 48000)
    tag = len(mpeg_audio._tag())
    noise = b"\xff\xfb\x00\xff\xfa\xc4\xc0 noise" * 3
    broken = data[: tag + 3 * 672] + noise + data[tag + 3 * 672 :]
    again = mpeg_audio.read_stream(broken)
    assert again.frames == audio.frames and again.skipped == len(noise) and mpeg_audio.read_payload(broken, again) == payload
    flipped = bytearray(data)
    flipped[tag + 2 * 672 + 10] ^= 1  # side information
    assert mpeg_audio.read_stream(bytes(flipped)).bad_checks == 1
    tagged = mpeg_audio.read_stream(data + b"TAG" + b"title".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["title"] == "title" and tagged.frames == audio.frames and tagged.skipped == 0
    assert mpeg_audio.read_stream(b"").frames == 0 and mpeg_audio.read_stream(b"\xff" * 50).skipped == 50
    vbr = b"".join(h + bytes(mpeg_audio.parse_header(h).size - 4) for h in (b"\xff\xfb\x90\x00", b"\xff\xfb\x50\x00", b"\xff\xfb\x92\x00", b"\xff\xfb\x90\x00"))
    assert mpeg_audio.read_stream(vbr).frames == 4 and mpeg_audio.crc16(b"123456789", 0) == 0xFEE8


def test_audio_query(spark, odd, none):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_text = {}
    for r in queries.op9_mpeg_audio(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    rows = mpeg_audio.decode_media(mpeg_audio.encode_media(odd)).collect()
    assert len(rows) == len(ODD) and mpeg_audio.decode_media(mpeg_audio.encode_media(none)).count() == 0


# ------------------------------------------------------------------ byte pairs
@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_tiktoken(reference):
    random.seed(6)
    encoder = bpe.TextEncoder(bpe.load(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    alphabet = "abcXYZ  .,;:!?'\n\t\r\x1c\x85 éÉßİΣ̌́J1２²½__-ñ中가﻿👍's't"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(5000)] + ["a" * 5000, " " * 3000 + "x", "ab" * 3000, "<|endoftext|>", ""]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == reference.encode_ordinary(t)


def test_prefix_table_edits(reference):
    random.seed(7)
    vocabulary = bpe.load(P.path("byte_bpe_50k.tiktoken"))
    table = bpe.PrefixTable(vocabulary, b"thering")
    for _ in range(200):
        a = random.randint(0, len(table.data))
        b = min(len(table.data), a + random.randint(0, 4))
        table.edit(a, b, bytes(random.choices(b"abcdefgh thering", k=random.randint(0, 5))))
        table.append(bytes(random.choices(b" theouans", k=3)))
        n = random.randint(0, len(table.data))
        assert table.ids() == reference._encode_single_piece(table.data)
        assert vocabulary.decode(table.ids(n)) == table.data[:n]
    table.append(b"lorem ipsum " * 500)
    before = table.computed
    table.edit(10, 11, b"zz")
    assert table.computed - before < 600 and table.ids() == reference._encode_single_piece(table.data)


def test_bpe_query(spark, odd, none, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_byte_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.decode_ids(bpe.encode_texts(odd, path, P.PATTERN), path).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, _ in ODD)
    assert bpe.decode_ids(bpe.encode_texts(none, path, P.PATTERN), path).count() == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "ngram_join", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    after = stages["language_id"](spark, stages["toxicity"](spark, docs, SF), SF)
    assert after.columns == docs.columns
    left = {r.doc_id: r.text for r in after.collect()}
    assert 0.75 * len(kept) < len(left) < len(kept)
    unique = {}
    for k, t in sorted(left.items(), key=lambda x: (-len(x[1]), x[0])):
        unique.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), k)
    left = {k: left[k] for k in unique.values()}
    assert {r.doc_id for r in stages["exact_dedup"](spark, after, SF).collect()} == set(left)
    expected = set(_components(_sets(left, 5), 80).values())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == expected


def test_a_worker_keeps_no_words_and_gives_memory_back(spark, monkeypatch):
    """Workers kept every stage's words, so that a run of all stages outgrew an executor's memory."""
    import pyarrow as pa

    from quire.llm import common, packing

    path = P.path("word_bpe_49k.json")
    docs = spark.range(0, 400, numPartitions=4).selectExpr("id AS doc_id", "concat('word', id, ' and other', id * 7) AS text")
    assert packing.pack_documents(docs, path).count() >= 400

    def probe(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing.load(path).cache)] * batch.num_rows, pa.int64())], names=["n"])

    assert spark.range(0, 64, numPartitions=16).mapInArrow(probe, "n bigint").agg({"n": "max"}).first()[0] == 0

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append(True))
    assert list(common.tidied(lambda batches: (x for x in batches))(iter([1, 2]))) == [1, 2] and seen == [True]
    with pytest.raises(ZeroDivisionError):
        list(common.tidied(lambda batches: (1 // x for x in batches))(iter([0])))
    assert len(seen) == 2
