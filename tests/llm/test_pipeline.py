"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from posolog.llm.bpe import vocabulary, vocabulary_path

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(9)
    voc = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(2000)]
    line = lambda n=12: " ".join(random.choice(voc) for _ in range(n)).capitalize() + "."
    text = lambda n=8: "\n".join(line() for _ in range(n))
    item, passage = line(30), line(60)
    clean = [text() for _ in range(200)]
    planted = {
        300: "\n".join(x.upper() + "!!" for x in clean[3].split()), 301: clean[5], 302: clean[6].replace(clean[6].split()[40], "changed", 1),
        303: line() + "\n" + item + "\n" + line(), 304: line() + "\n" + passage + "\n" + line(), 305: line() + "\n" + passage + "\n" + line(),
    }
    docs = [*enumerate(clean), *planted.items(), *((1000 + k, " ".join(w.upper() + "!!" for w in text(3).split())) for k in range(40)), (2000, None)]
    home = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, FIELDS).repartition(4).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 0 if 1000 <= i < 2000 else 1, 0) for i, _ in docs if i < 200 or 1000 <= i < 1040], "doc_id bigint, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


def test_stages(spark, corpus, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    docs, kept = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, corpus)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(200))
    assert clean <= set(kept["quality"]) and 300 not in kept["quality"] and not any(1000 <= i < 1040 for i in kept["quality"])
    assert {301} == set(kept["quality"]) - set(kept["line_dedup"])
    assert kept["line_dedup"][304].text.count("\n") == 2 and kept["line_dedup"][305].text.count("\n") == 1
    assert kept["line_dedup"][305].n_chars == len(kept["line_dedup"][305].text)
    assert clean <= set(kept["near_dedup"])
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == {303}
    own = vocabulary(vocabulary_path())
    assert {i: bytes(r.ids) for i, r in kept["bpe"].items()} == {i: own.encode([r.text or ""])[0] for i, r in kept["decontaminate"].items()}


def test_run_is_the_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    assert sorted(r.ids_sha256 for r in pipeline.run(spark, corpus).collect()) == sorted(r.ids_sha256 for r in docs.collect())


def test_near_dedup_takes_five_words_and_four_fifths(spark):
    words = [f"w{k}" for k in range(50)]
    changed = lambda *places: " ".join("changed" if k in places else w for k, w in enumerate(words))
    other = " ".join(f"x{k}" for k in range(50))
    rows = [(1, changed()), (2, changed(25)), (3, other), (4, other.replace("x12 ", "p ").replace("x30 ", "q "))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], FIELDS)
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4]


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (2, text("a") + " more"), (3, text("b")), (4, text("c")), (None, text("c")), (None, text("c")), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], FIELDS)
    out = pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, text("a")), (2, text("b")), (4, text("c")), (None, text("c")), (None, text("c")), (5, None), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_odd_tables(spark, corpus, tmp_path):
    """Repeated rows, further columns of the operators' own names, and an empty corpus go through all stages."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    more = "score double, predicted int, n_lines int, n_removed string, items int, near_items int, contaminated string, place int, key int, made int".split(", ")
    wide = docs.union(docs.filter("doc_id < 3 OR doc_id = 2000")).select("*", *[F.lit("7").cast(m.split()[1]).alias(m.split()[0]) for m in more])
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, wide, corpus)
        out.write.parquet(f"{tmp_path}/wide{k}")
        if name != "bpe":
            assert out.columns == wide.columns
            wide = spark.read.parquet(f"{tmp_path}/wide{k}")
            assert wide.filter("score = 7 AND predicted = 7 AND n_lines = 7 AND n_removed = '7' AND items = 7 AND contaminated = '7' AND place = 7 AND key = 7 AND made = 7").count() == wide.count()
    ids = [r.doc_id for r in wide.collect()]
    assert sorted(ids)[:200] == list(range(200)) and all(ids.count(i) == 1 for i in range(3))
    empty = spark.createDataFrame([], FIELDS)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, corpus)
        assert empty.count() == 0
