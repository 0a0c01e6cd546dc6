"""The registered queries themselves, against their SQL or, where there is none, against plain Python."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from posolog.llm import queries
from posolog.llm.bpe import vocabulary_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE_SQL])
def test_with_sql(spark, duck, name):
    out, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(repr(tuple(r)) for r in out.select(*want.columns).collect()) == sorted(map(repr, want.fetchall()))


def test_without_sql(spark, duck):
    texts = {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    rows = {n: {r.doc_id: r for r in queries.QUERIES[n](spark, SF).collect()} for n in queries.QUERIES if n not in queries.ORACLE_SQL}
    assert all(set(found) == set(texts) for found in rows.values())
    library = Tokenizer.from_file(vocabulary_path())
    for i, t in texts.items():
        raw, ids = t.encode(), library.encode(t, add_special_tokens=False).ids
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media, coded = rows["op3_matroska"][i], rows["op4_bpe"][i]
        assert (media.n_bytes, media.payload_sha256, media.tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (coded.n_tokens, coded.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert coded.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        scored, judged = rows["op5_lm_score"][i], rows["op6_quality"][i]
        assert scored.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and scored.n_tokens == len(raw.split()) + 1 and scored.score < 0
        assert judged.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and judged.predicted == int(judged.score >= 0.7)
        pii = rows["op8_pii"][i]
        base = ",".join(s for s in pii.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone"))
        assert pii.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
