"""Line dedup, decontamination and PII against plain Python, with nulls, ties, repeated rows and clashing names."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from posolog.llm.decontaminate import find_matches, judged
from posolog.llm.line_dedup import dedup_lines
from posolog.llm.pii import BASE, find_pii, listed

DOCS = "doc_id bigint, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_lines(rows, lines=3, words=25):
    """What stays of each (id, text): windows over lines that are wrapped after `words` words."""

    def cut(t):
        return [(n, " ".join(w[k : k + words])) for n, w in enumerate(x.split(" ") for x in t.split("\n")) for k in range(0, len(w), words)]

    spots = []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        if t:
            bodies = [b for _, b in cut(t)]
            spots += [(tuple(bodies[k : k + lines]), i, t, k) for k in range(max(1, len(bodies) - lines + 1))]
    first, gone = {}, {}
    for body, i, t, k in spots:
        if body in first and first[body] != (i, t, k):
            gone.setdefault((i, t), set()).update(range(k, k + lines))
        first.setdefault(body, (i, t, k))
    out = {}
    for i, t in rows:
        kept = {}
        for k, (n, b) in enumerate(cut(t or "")):
            if k not in gone.get((i, t), ()):
                kept.setdefault(n, []).append(b)
        out[i, t] = None if t is None else "\n".join(" ".join(x) for x in kept.values())
    return out


def test_line_dedup(spark):
    random.seed(1)
    run = lambda n, w="w": " ".join(f"{w}{k}" for k in range(n))
    rows = [(k, "\n".join(random.choice("abcd") for _ in range(random.randint(0, 12)))) for k in range(60)]
    rows += [(100, run(55)), (101, "x\n" + run(55) + "\ny"), (102, None), (103, ""), (1033, ""), (104, "a\nb"), (105, "a\nb"), (None, "q\nr\ns"), (106, "q\nr\ns"), (106, "q\nr\ns"), (107, "z\n" * 20000)]
    rows += [(110, f"one\n{run(26, 'p')}\n{run(26, 'q')}\ntwo"), (111, f"three\n{run(26, 'p')}\n{run(26, 'q')}\nfour"), (112, run(20000, "v")), (113, "five\n" + run(20000, "v")), (114, f"{run(49, 's')}\n  t  \tu "), (115, f"e\n{run(49, 's')}\ne")]
    got = dedup_lines(spark.createDataFrame([(*r, 5, "t", 7, "k", "g") for r in rows], DOCS + ", n_removed int, _text string, _key int, key string, gone string"))
    assert got.columns == ["doc_id", "text", "_text", "_key", "key", "gone", "n_lines", "n_removed"]
    out = got.collect()
    want = brute_lines(rows)
    assert len(out) == len(rows) and {(r._text, r._key, r.key, r.gone) for r in out} == {("t", 7, "k", "g")}
    by_place = sorted(((r.doc_id is not None, r.doc_id), r.text) for r in out if r.doc_id not in (102,))
    assert by_place == sorted(((i is not None, i), want[i, t]) for i, t in rows if i != 102)
    text = {r.doc_id: r.text for r in out}
    assert (text[101], text[111], text[105], text[113], text[1033]) == ("x\ny", "three\nfour", "", "five", "")
    assert next(r for r in out if r.doc_id == 102).n_lines == 0
    assert not re.search("Python|Pandas|Arrow", plan(got))


def test_line_dedup_empty(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_contamination(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = brute_words(t), set(), set()
        for item, b in items:
            bw = brute_words(b)
            for k in range(max(1, len(bw) - 12) if bw else 0):
                body = bw[k : k + 13]
                for p in range(len(w) - len(body) + 1):
                    if w[p : p + len(body)] == body:
                        hit.update(range(p, p + len(body)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    random.seed(2)
    voc = [f"w{k}" for k in range(30)] + ["É", "the", "9"]
    text = lambda n: " ".join(random.choice(voc) for _ in range(n))
    items = [(k, text(random.randint(1, 30))) for k in range(12)] + [(20, None), (21, "--"), (22, "the the the the the the the the the the the the the the")]
    docs = []
    for k in range(60):
        body = random.choice([b for _, b in items if b])
        docs.append((k, f"{text(random.randint(0, 50))}, {body.title() if k % 3 else body}; {text(random.randint(0, 20))}" if k % 2 else text(40)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "the " * 3000), (104, items[0][1]), (104, items[0][1])]
    frame = spark.createDataFrame([(*d, 1, 2, "i", "w") for d in docs], DOCS + ", n_hit int, _key int, id string, words string")
    got = judged(find_matches(frame, spark.createDataFrame(items, "item_id bigint, text string")))
    assert {(r._key, r.id, r.words) for r in got.collect()} == {(2, "i", "w")}
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()), key=repr)
    assert rows == brute_contamination(docs, items)
    assert any(r[4] for r in rows) and not all(r[4] for r in rows)
    assert not re.search("Python|Pandas|Arrow", plan(got))


def brute_near(docs, items, window=13, probes=2, slop=16, share=0.6):
    counts = collections.Counter(w for _, t in docs for w in brute_words(t))
    out = {i: set() for i, _ in docs}
    for item, b in items:
        bw = brute_words(b)
        places = set()
        for k in range(max(1, len(bw) - window + 1) if bw else 0):
            ranked = sorted((counts[w], at) for at, w in enumerate(bw[k : k + window]))[:probes]
            places |= {k + at for n, at in ranked if n}
        for i, t in docs:
            met = {(pos - p, p) for pos, w in enumerate(brute_words(t)) for p in places if bw[p] == w}
            least = max(2, math.ceil(len(places) * share))
            if any(len({p for s, p in met if s0 <= s < s0 + slop}) >= least for s0, _ in met):
                out[i].add(str(item))
    return {i: sorted(x) for i, x in out.items()}


def test_near_items_and_spans(spark):
    """Proximity at every distance of two halves, altered copies, and the places of exact windows."""
    random.seed(3)
    voc = [f"w{k}" for k in range(400)]
    text = lambda n: [random.choice(voc) for _ in range(n)]
    items = [(k, text(random.choice([3, 13, 20, 40]))) for k in range(8)]
    docs = []
    for k in range(120):
        w = list(random.choice(items)[1])
        at, far = random.randrange(1, len(w)), random.randrange(0, 24)
        if k % 3 == 0:
            w[random.randrange(len(w))] = f"new{k}"
        docs.append((k, " ".join(text(random.randint(0, 40)) + w[:at] + (text(far) if k % 2 else []) + w[at:] + text(5))))
    docs += [(500, None), (501, "")]
    foreign = (99, ["w1", "w2", "nowhere", "w3", "w4"])
    docs.append((502, "w1 w2 w9 w3 w4"))
    told = [(i, " ".join(w)) for i, w in [*items, foreign]]
    got = {r.doc_id: r for r in find_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(told, "item_id bigint, text string")).collect()}
    want = brute_near(docs, told)
    assert {i: list(r.near_items) for i, r in got.items()} == want and sum(map(len, want.values())) > 40
    for i, t in docs:
        w = brute_words(t)
        spans = {(p, p + len(b)) for _, item in told for bw in [brute_words(item)] for k in range(max(1, len(bw) - 12)) for b in [bw[k : k + 13]] for p in range(len(w) - len(b) + 1) if w[p : p + len(b)] == b}
        assert [(s.start, s.end) for s in got[i].spans] == sorted(spans)


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert find_matches(none, items).count() == 0
    got = judged(find_matches(spark.createDataFrame([(1, "a b c")], DOCS), items.limit(0))).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (3, 0, False)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, match):
    d = re.sub("[^0-9]", "", match)
    double = [int(c) for c in d[::-1]]
    luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(double)) % 10 == 0
    return {"email": True, "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def brute_pii(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m.group()))


@pytest.fixture(scope="module")
def pii_rows():
    random.seed(4)
    signs = "ab1234567890.@+-_% ()😀é"
    rows = [(k, "".join(random.choice(signs) for _ in range(random.randint(0, 150)))) for k in range(300)]
    special = [None, "", "4111 1111 1111 1111 x", "card 4111-1111-1111-1112", "1" * 50000, "a" * 50000 + "@b.c", "a@b.c_d@e.f-g@h.i.j@k.l", "0000000010.1.1.255 1.2.3.256", " ".join(f"u{k}@x{k}.org" for k in range(2000)), "😀" * 300 + " +1 (650) 253-0000"]
    return rows + list(enumerate(special, 1000))


def test_pii(spark, pii_rows):
    got = find_pii(spark.createDataFrame([(*r, 1) for r in pii_rows], DOCS + ", pii int"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    out = {r.doc_id: r.spans for r in got.select("doc_id", listed(base).alias("spans")).collect()}
    assert out == {i: brute_pii(t) for i, t in pii_rows}
    assert not re.search("Python|Pandas|Arrow", plan(got))


def test_pii_more_kinds_and_context(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00 now"), (2, "DE88370400440532013000"), (3, "my ssn 123-45-6789"), (4, "order 123-45-6789"), (5, "call +1 650 253 0000"), (6, "x +1 650 253 0000")]
    out = {r.doc_id: [(p.kind, p.score) for p in r.pii] for r in find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert ("iban", 1.0) in out[1] and not any(k == "iban" for k, _ in out[2])
    assert out[3] == [("ssn", 0.9)] and out[4] == []
    assert find_pii(spark.createDataFrame([], DOCS)).count() == 0
    assert out[5] == [("phone", 0.9)] and out[6] == [("phone", 0.6)]
