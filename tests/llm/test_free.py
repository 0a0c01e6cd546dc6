"""The other operators against plain Python, the tokenizers library, exact round trips and held-out rows."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posolog.llm import jaccard_join, matroska, queries, warc
from posolog.llm.bpe import decode, encode, recode, vocabulary, vocabulary_path
from posolog.llm.components import connected
from posolog.llm.lm import score_documents
from posolog.llm.quality import fit, score_quality
from posolog.llm.url_filter import DigestList, built, judge_urls

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abc 'stm\n\t\x1c\u3000é😀<|endoftext|>")), max_size=60))
def test_bpe_is_the_library(library, text):
    own = vocabulary(vocabulary_path())
    ids = own.encode([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_frames(spark, library):
    rows = [(*r, 1, "s", "d") for r in [(1, None), (2, ""), (3, "a" * 20000), (4, "Hello <|endoftext|> wörld"), (4, "Hello <|endoftext|> wörld"), (None, " x")]]
    frame = spark.createDataFrame(rows, DOCS + ", ids int, _source_ string, decoded string")
    out = decode(encode(frame)).collect()
    assert len(out) == len(rows) and sorted(map(repr, recode(frame).select(*out[0].__fields__).collect())) == sorted(map(repr, out))
    for r in out:
        assert r._source_ == "s"
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert encode(spark.createDataFrame([], DOCS)).count() == 0


def near_rows():
    random.seed(5)
    voc = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(3):
        source = [random.choice(voc) for _ in range(120)]
        for _ in range(60):
            t = list(source)
            for _ in range(random.randint(0, 6)):
                t[random.randrange(len(t))] = random.choice(voc)
            texts.append(" ".join(t))
    texts += [None, "", " \t", "a b", "A b", "a b c d", "É\u3000x"] * 2
    texts += [" ".join(random.choice(voc) for _ in range(50)) + " one two three four five six seven eight" for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("paired", [32, 2])
def test_jaccard_join(spark, monkeypatch, paired):
    """Small buckets alone, and nearly all through the steps for large ones."""
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    rows = near_rows()
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(c.sql(queries.ORACLE_SQL["op10_jaccard_join"]).fetchall())
    got = jaccard_join.near_components(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n int"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_jaccard_join_odd_rows(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "x"), (9, None)]
    got = sorted((tuple(r) for r in jaccard_join.near_components(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == sorted([(5, 2, 3), (3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 0, 9)], key=repr)
    assert jaccard_join.near_components(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    random.seed(6)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(7, 7), (None, 3)]
    root = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a in root and b in root:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.v: r.component for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == {v: find(v) for v in root}


@pytest.mark.parametrize("lacing", [matroska.NO_LACING, matroska.XIPH_LACING, matroska.FIXED_LACING, matroska.EBML_LACING])
def test_lacings(lacing):
    frames = {matroska.NO_LACING: [b"x" * 300], matroska.FIXED_LACING: [b"ab", b"cd", b"ef"]}.get(lacing, [b"a" * 255, b"b" * 700, b"", b"c" * 3, b"d" * 20000, b"e"])
    body = matroska.vint(1) + b"\x00\x05" + bytes([0x80 | lacing]) + matroska._laced(frames, lacing)
    cluster = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + matroska.number(matroska.TIMESTAMP, 40) + matroska.element(matroska.SIMPLE_BLOCK, body)
    group = matroska.element(matroska.CLUSTER, matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, body) + matroska.element(matroska.REFERENCE_BLOCK, b"\x01")))
    tracks = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK_ENTRY, matroska.number(matroska.TRACK_NUMBER, 1) + matroska.number(matroska.TRACK_TYPE, 2) + matroska.element(matroska.CODEC_ID, b"A_OPUS")))
    info = matroska.element(matroska.INFO, matroska.number(matroska.TIMESTAMP_SCALE, 1_000_000))
    data = b"\x18\x53\x80\x67\xff" + info + tracks + matroska.element(0xEC, b"junk") + cluster + group
    packets = matroska.parse(data).packets
    assert [data[p.offset : p.offset + p.size] for p in packets] == frames * 2
    assert [p.ms for p in packets] == [45.0] * len(frames) + [5.0] * len(frames)
    assert [p.key for p in packets] == [True] * len(frames) + [False] * len(frames)


def test_media(spark):
    rows = [(1, None), (2, ""), (3, "é" * 40000), (4, "x" * 576), (5, "x" * 577), (5, "x" * 577), (None, "y")]
    media = matroska.to_media(spark.createDataFrame([(*r, "m") for r in rows], DOCS + ", media string"))
    out = matroska.read_media(media).collect()
    assert len(out) == len(rows)
    for r in out:
        raw = (r.text or "").encode()
        assert bytes(r.payload) == raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    table = matroska.packet_table(media).filter("doc_id = 3").orderBy("packet").collect()
    data = bytes(next(r.media for r in out if r.doc_id == 3))
    assert b"".join(data[p.offset : p.offset + p.size] for p in table)[:80000] == ("é" * 40000).encode()
    assert [p.ms for p in table] == [k * matroska.FRAME_MS for k in range(len(table))]
    parsed = matroska.parse(data)
    assert all(data[place : place + 4] == b"\x1f\x43\xb6\x75" for _, _, place in parsed.cues) and len(parsed.cues) == 1
    broken = spark.createDataFrame([(1, data[:500]), (2, None), (3, b"")], "doc_id bigint, media binary")
    assert [r.payload for r in matroska.read_media(broken).orderBy("doc_id").collect()][:2] == [None, None]


def test_warc(spark, tmp_path):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/", big), (2, "u", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "a\r\nb", ""), (8, "u", other), (None, "u", big), (8, "u", other), (9, "u", "y" * 999), (10, "u", "y" * 999)]
    archives = warc.write_archives(spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, _digest int"))
    out = warc.read_archives(archives).collect()
    assert len(out) == len(rows) and all(r.intact for r in out)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)

    def want(i, html):
        raw = (html or "").encode()
        top = max((j for j, _, h in rows if j is not None and h == html), default=None)
        revisit = len(raw) >= 1000 and i != top
        return (i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None)

    assert got == sorted((want(i, h) for i, _, h in rows), key=repr)
    warc.save_archives(archives, str(tmp_path)).collect()
    again = warc.read_archives(warc.archives_of_files(spark, f"{tmp_path}/*.warc.gz")).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"))).count() == 0
    found = warc.read_archives(archives)
    assert all(r.intact for r in warc.checked_revisits(found).collect())
    lost = warc.checked_revisits(found.filter("page_id IS NULL OR page_id <> 3")).collect()
    assert {r.page_id for r in lost if not r.intact} == {1, 2, None}
    dates = spark.createDataFrame([("2020-01-02", "u", "z" * 1500), ("2020-01-03", "u", "z" * 1500)], "page_id string, url string, html string").withColumn("page_id", F.col("page_id").cast("date"))
    assert sorted(str(r.refers_to) for r in warc.read_archives(warc.write_archives(dates), "date").collect()) == ["2020-01-03", "None"]


def test_warc_cut_anywhere():
    """Every cut of an archive is an error but those between members."""
    one, two = warc.record(1, "u", b"x" * 100), warc.record(2, "u", bytes(range(256)) * 300)
    assert [r["payload_bytes"] for r in warc.records(one + two)] == [100, 76800]
    for k in range(len(one + two)):
        if k in (0, len(one)):
            assert len(list(warc.records((one + two)[:k]))) == (k > 0)
        else:
            with pytest.raises(ValueError):
                list(warc.records((one + two)[:k]))
    long = warc.record(3, "u", b"\0" * (5 << 20))
    assert [r["payload_bytes"] for r in warc.records(long + one)] == [5 << 20, 100] and all(r["intact"] for r in warc.records(long + one))


def test_urls(spark):
    rows = ["http://a.com/x", "http://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://b.net/es/?q", "http://x.net/esx", "http://com", "spam", None, "", "https://m.spam-farm.example.org/x", "http://notspam-farm.example.org/", "a://É.NET/fr/#/", "x://y://z/en", "http://a.example.com?/en/"]
    out = [tuple(r)[1:] for r in judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id int, url string").withColumnRenamed("page_id", "rule2")).drop("url").orderBy("rule2").collect()]
    assert out == [
        ("a.com", "/x", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("b.net", "/es/", "net/es/", "block"),
        ("x.net", "/esx", None, "allow"), ("com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("m.spam-farm.example.org", "/x", None, "block"),
        ("notspam-farm.example.org", "/", None, "allow"), ("É.net", "/fr/", "net/fr/", "block"), ("y:", "//z/en", None, "allow"), ("a.example.com", "", None, "allow"),
    ]


def test_digest_list_confirms_strings(tmp_path):
    words = [f"host{k}.example/" for k in range(5000)]
    (tmp_path / "f").write_bytes(built((w, "block") for w in words))
    found = DigestList(str(tmp_path / "f"))
    assert found.find([b"host7.example/", b"host7.example", "host4999.example/".encode()]) == ["block", None, "block"]
    forged = bytearray((tmp_path / "f").read_bytes())
    forged[-1:] = b"?"
    (tmp_path / "g").write_bytes(forged)
    assert DigestList(str(tmp_path / "g")).find([w.encode() for w in words]).count(None) == 1
    (tmp_path / "e").write_bytes(built([]))
    assert DigestList(str(tmp_path / "e")).find([b"x"]) == [None]


def test_urls_odd_tables(spark):
    rows = [("http://EXAMPLE.com/en/" + "x" * 100_000, "mine", 1), ("http://EXAMPLE.com/en/" + "x" * 100_000, "mine", 1), (None, "mine", 2)]
    frame = spark.createDataFrame(rows, "url string, _url_ string, source int").withColumn("verdict", F.lit("x"))
    out = judge_urls(frame)
    assert out.columns == ["url", "_url_", "source", "host", "path", "rule", "verdict"]
    assert [(r._url_, r.source, len(r.path), r.verdict) for r in out.orderBy("source").collect()] == [("mine", 1, 100_004, "block")] * 2 + [("mine", 2, 0, "allow")]
    assert judge_urls(frame.limit(0)).count() == 0


def test_url_list_of_a_table(spark):
    """A million entries, built without a list on the driver."""
    n = 1_000_000
    table = spark.range(n).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example")).alias("host"), F.when(F.col("id") % 3 == 0, "/bad/").otherwise("").alias("path"))
    asked = [f"http://{'sub.' * (k % 2)}h{k}.example/{'bad/' * (k % 4 == 0)}x" for k in [*range(300), n - 1, n, n + 7]]
    got = {r.url: r.verdict for r in judge_urls(spark.createDataFrame([(u,) for u in asked], "url string"), (), table).collect()}
    for u, k in zip(asked, [*range(300), n - 1, n, n + 7], strict=True):
        assert got[u] == ("block" if k < n and (k % 3 or "/bad/" in u) else "allow")


def labelled(n=600):
    random.seed(7)
    voc = ["the", "of", "and"] + ["".join(random.choice("abcdefgh") for _ in range(random.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        w = [random.choice(voc) for _ in range(random.randint(20, 80))]
        bad = k % 4 == 0
        docs.append((k, " ".join(x.upper() + "!!" if k % 8 else x + "***" for x in w) if bad else " ".join(w).capitalize() + "."))
        labels.append((k, int(not bad)))
    return docs, labels


def test_quality(spark):
    docs, labels = labelled()
    extra = [(9000, None), (9001, ""), (9002, "x" * 200000), (None, "plain words here"), (0, docs[0][1])]
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (4, 0), (9001, 7)], "doc_id bigint, quality int")
    frame = spark.createDataFrame([(*r, 1) for r in docs + extra], DOCS + ", score int")
    out = score_quality(frame, fit(frame, marks)).collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in out)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [r for r in out if r.doc_id in held and r.predicted != dict(labels)[r.doc_id]]
    assert len(wrong) <= 0.02 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in out)
    flipped = spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in labels], "doc_id bigint, quality int")
    again = score_quality(frame, fit(frame, flipped)).collect()
    assert sorted((str(r.doc_id), r.predicted) for r in again) == sorted((str(r.doc_id), r.predicted) for r in out)
    none = score_quality(frame, fit(frame, marks.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert score_quality(frame.limit(0), fit(frame.limit(0), marks)).count() == 0


def test_lm(spark):
    random.seed(8)
    after = {"a": "bbbc", "b": "aaad", "c": "dddd", "d": "abcd"}
    docs = []
    for k in range(400):
        w = ["a"]
        while len(w) < 40:
            w.append(random.choice(after[w[-1]]))
        docs.append((k, " ".join(x if random.random() > 0.05 else f"rare{random.randrange(40)}" for x in w)))
    docs += [(900, None), (901, ""), (902, "A\x0bb\u3000c d" * 3000), (0, docs[0][1]), (None, "a b")]
    out = score_documents(spark.createDataFrame([(*d, 1.0) for d in docs], DOCS + ", score double")).collect()
    assert len(out) == len(docs)
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in docs if not held(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words(t)), 5)) for i, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    some = [r for r in out if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in some) > 0.9 * sum(r.base_score for r in some)
    assert score_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_lm_is_normalised():
    """Every symbol's probability by the formula, after learning from a chain in which two words back decide."""
    from posolog.llm import lm

    random.seed(3)
    size, texts = lm.CLASSES + 5, []
    for _ in range(600):
        text = random.choices(range(lm.CLASSES + 1, size), k=2)
        while len(text) < 30:
            text.append(text[-2] if random.random() < 0.9 else random.randrange(lm.CLASSES + 1, size))
        texts.append([*text, 0])
    symbols, begins = np.concatenate(texts).astype(np.int32), np.cumsum([0] + [len(t) for t in texts[:-1]])
    plan = lm.layout(np.bincount(symbols, minlength=size))
    model = lm.Model(plan)
    learner = lm.Learner(model, plan, 1)
    for _ in range(30):
        learner.learn(symbols, begins)

    def logs(text):
        out = []
        for k, s in enumerate(text):
            back = [text[k - j] if k >= j else 0 for j in range(1, lm.CONTEXT + 1)]
            c = sum(model.contexts[j * len(model.targets) + x].astype(float) for j, x in enumerate(back))
            of_groups = np.exp(model.groups @ c + model.group_bias)
            group = slice(s // plan.width * plan.width, (s // plan.width + 1) * plan.width)
            of_symbols = np.exp(model.targets[group] @ c + model.bias[group])
            out.append(math.log10(of_groups[s // plan.width] / of_groups.sum() * of_symbols[s % plan.width] / of_symbols.sum()))
        return out

    got = model.log10(symbols[: begins[20]], begins[:20])
    assert np.allclose(got, [x for t in texts[:20] for x in logs(t)], atol=1e-4)
    assert np.allclose(model.log10(symbols, begins)[: begins[20]], got, atol=1e-4)
    back = [lm.CLASSES + 1, lm.CLASSES + 2, lm.CLASSES + 1]
    every = [10 ** logs([*back, s])[-1] for s in range(size)]
    assert abs(sum(every) - 1) < 1e-4 and every[lm.CLASSES + 2] > 0.7


def test_lm_classes_share_out_what_they_have():
    from posolog.llm import lm

    held = {b"x": 9, b"": 4, b"y": 3, b"z": 1}
    tokens, distinct = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    for w in (b"y", b"z"):
        tokens[zlib.crc32(w) % lm.CLASSES] += held[w]
        distinct[zlib.crc32(w) % lm.CLASSES] += 1
    vocabulary = lm.Vocabulary(held, 1, tokens + distinct + 1)
    found, is_word, places, symbols, begins = vocabulary.read([b"X new y", None, b"z"])
    of = lambda w: zlib.crc32(w) % lm.CLASSES + 1
    assert found == [b"x", b"new", b"y", b"z"] and symbols.tolist() == [lm.CLASSES + 1, of(b"new"), of(b"y"), 0, 0, of(b"z"), 0]
    assert begins.tolist() == [0, 4, 5] and places.tolist() == [0, -1, 1, 2] and is_word.sum() == 4
    for k in {of(b"y"), of(b"z")}:
        counts = [held[w] for w in (b"y", b"z") if of(w) == k]
        assert math.isclose(sum(c + 1 for c in counts) + 1, 10 ** vocabulary.class_logs[k])


def test_lm_averages_by_what_tasks_have_seen():
    from posolog.llm import lm

    plan = lm.layout(np.ones(lm.CLASSES + 3000))
    learners = []
    for task in range(3):
        learner = lm.Learner(lm.Model(plan, seed=task), plan, task)
        for seen in learner.seen:
            seen[:] = np.random.default_rng(task).integers(1, 9, len(seen))
        learners.append(learner)
    rows = sorted(((b["k"][0].as_py(), b["first"][0].as_py(), x.rng.random(), b) for x in learners for b in lm._passed_on(x, 0)), key=lambda r: r[:3])
    out = list(lm._averages(iter([r[3] for r in rows])))
    for k, table in enumerate(learners[0].model.arrays()):
        parts = [np.frombuffer(b["sums"][0].as_py(), np.float32) for b in out if b["k"][0].as_py() == k]
        weights = np.stack([x.seen[k] for x in learners])
        tables = np.stack([x.model.arrays()[k].reshape(len(table), -1) for x in learners])
        want = (tables * weights[:, :, None]).sum(0) / weights.sum(0)[:, None]
        assert np.allclose(np.concatenate(parts).reshape(want.shape), want, rtol=1e-3, atol=1e-5)


def test_lm_held_words_and_joined_words_agree(spark, monkeypatch):
    from posolog.llm import lm

    rows = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 97}" for j in range(30))) for k in range(60)], DOCS)
    one = {r.doc_id: r for r in lm.score_documents(rows).collect()}
    monkeypatch.setattr(lm, "HELD_WORDS", 20)
    two = {r.doc_id: r for r in lm.score_documents(rows).collect()}
    assert all(abs(one[i].base_score - two[i].base_score) < 1e-9 and one[i].n_known == two[i].n_known for i in one)


def test_lm_frequent_words(spark):
    from posolog.llm import lm

    rows = [(f"w{k}".encode(), 1 + k * k) for k in range(100)] + [(b"", 1)]
    counts = spark.createDataFrame(rows, "word binary, c bigint")
    for most in (0, 1, 10, 60, 101, 500):
        found = lm.frequent(counts, most)
        words = [w for w in found if w]
        assert b"" in found and len(found) <= most + 1 and words == sorted(words, key=lambda w: -found[w])
        assert set(words) == {w for w, c in rows if w and c >= min((found[x] for x in words), default=1 << 60)}
    assert len(lm.frequent(counts, 500)) == 101 and len(lm.frequent(counts, 60)) > 40


def test_quality_is_brute_force(spark):
    """Every cosine with every labelled document, and the votes of the nearest."""
    from posolog.llm import quality

    docs, labels = labelled(200)
    frame = spark.createDataFrame([*docs, (500, docs[1][1]), (501, "")], DOCS)
    votes = fit(frame, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    out = {r.doc_id: r.score for r in score_quality(frame, votes).collect()}
    for i, t in [*docs, (501, "")]:
        places, counts = quality.features(t.encode())
        own = quality.weighted(places, counts, votes.idf) @ votes.basis[places]
        size = math.sqrt(sum(float(x) ** 2 for x in own)) or 1.0
        near = [round(sum(float(a) * float(b) for a, b in zip(own, v, strict=True)) / size, quality.PLACES) for v in votes.vectors]
        least = sorted(near)[-quality.NEIGHBOURS]
        weights = [max(c, 0) ** quality.SHARPNESS if c >= least else 0 for c in near]
        want = sum(w * x for w, x in zip(weights, votes.labels, strict=True)) / sum(weights) if sum(weights) else votes.share
        assert abs(out[i] - want) < 1e-3
    assert out[500] == out[1]


def test_media_digests_and_features(spark):
    """The round trip's digests and features, worked out plainly from the text and its file."""
    rows = [(1, None), (2, ""), (3, "é" * 4000), (4, "x" * 577), (4, "x" * 577)]
    frame = spark.createDataFrame([(*r, "m") for r in rows], DOCS + ", media string")
    out = matroska.round_trip(frame)
    assert matroska.round_trip(frame.limit(0)).count() == 0
    for r in out.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media = matroska.pack(payload)
        mean = sum(payload) / len(payload)
        spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))  # noqa: B905
        frames = len(payload) // 576
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.media) == (len(raw), len(payload), len(media), "m")
        assert (r.payload_sha256, r.media_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest(), zlib.crc32(payload[-32:]))
        told = dict(x.split("=") for x in r.feature.split(";"))
        assert (told["frames"], told["clusters"], told["ms"], told["crossings"]) == (str(frames), str(-(-frames // 384)), str(frames * 72), str(crossings))
        assert abs(float(told["mean"]) - mean) < 1e-3 and abs(float(told["deviation"]) - spread) < 1e-3
