"""Golden prescriptions, exhaustive dimensions, a plain restatement of the parser under hypothesis, and plans."""

import math
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posolog.functions import frequency as Q
from posolog.functions import text as T
from posolog.operators import match as M
from posolog.operators.convert import checked, convert_all, convert_one, duplicate_factors, method_warning, selected, targets
from posolog.operators.factors import build_factors
from posolog.operators.parse import parse_rx, parse_stateless
from posolog.plans import dims

GOLDEN = [
    ("Risperdal 2mg BID", "risperidone", 2, "BID", 4, False, None),
    ("아빌리파이 15mg QD", "aripiprazole", 15, "QD", 15, False, None),
    ("Seroquel 25mg QHS", "quetiapine", 25, "QHS", 25, False, None),
    ("Risperdal 2mg", "risperidone", 2, "ASSUMED_QD", 2, True, None),
    ("Abilify 10mg PRN", None, None, None, None, True, "PRN"),
    ("risperidone 1mg AM 2mg PM", None, None, None, None, True, "MULTI_DOSE"),
    ("risperidone 2mg BID TID", None, None, None, None, True, "FREQ_CONFLICT"),
    ("risperidone 25mg IM monthly", None, None, None, None, True, "LAI_OR_WEEKLY"),
    ("risperidone .5mg QD", "risperidone", 0.5, "QD", 0.5, False, None),
    ("리스페달 0.5㎎ BID", "risperidone", 0.5, "BID", 1, False, None),
    ("리스페달 2mg 2정 1일 2회", "risperidone", 4, "BID", 8, False, None),
    ("아빌리파이 10mg 매일", "aripiprazole", 10, "QD", 10, False, None),
    ("risperidone 2mg weekly", None, None, None, None, True, "LAI_OR_WEEKLY"),
    ("Risperdal 2mg q12h", "risperidone", 2, "BID", 4, False, None),
    ("Risperdal 2mg 2회/일", "risperidone", 2, "BID", 4, False, None),
    ("Risperdal 2mg 1-0-1", "risperidone", 2, "BID", 4, False, None),
    ("Risperdal 2mg q8h", "risperidone", 2, "TID", 6, False, None),
    ("Risperdal 4mg/day", "risperidone", 4, "QD", 4, False, None),
    ("Risperdal 2정 2mg BID", "risperidone", 4, "BID", 8, False, None),
    ("RISP*ERDAL 2MG BID", "risperidone", 2, "BID", 4, False, None),
    ("코티아핀 25mg QD", "quetiapine", 25, "QD", 25, False, None),
    ("코틴 25mg QD", None, None, None, None, True, "UNKNOWN_DRUG"),
    ("lithium 600mg", None, None, None, None, True, "UNKNOWN_DRUG"),
    ("seroqual 25mg QD", "quetiapine", 25, "QD", 25, True, None),
    ("lithium 600mg per day", "perphenazine", 600, "ASSUMED_QD", 600, True, None),
    ("risperidone 2mg once a week", "risperidone", 2, "WEEKLY", 0.285714, False, None),
    ("risperidone 500mcg TID", "risperidone", 0.5, "TID", 1.5, False, None),
    ("risperidone 2mg q5h", None, None, None, None, True, "BAD_INTERVAL"),
    ("2mg BID", None, None, None, None, True, "UNKNOWN_DRUG"),
    ("", None, None, None, None, True, "EMPTY"),
    (None, None, None, None, None, True, "EMPTY"),
    (" \t\n ", None, None, None, None, True, "EMPTY"),
    ("risperidone", None, None, None, None, True, "NO_DOSE"),
    ("risperidone 0mg QD", None, None, None, None, True, "BAD_DOSE"),
    ("risperidone -2mg QD", None, None, None, None, True, "BAD_DOSE"),
    ("risperidone 2mg 0T QD", None, None, None, None, True, "BAD_QUANTITY"),
    ("risperidone 2mg 30 times a day", None, None, None, None, True, "BAD_TIMES"),
    ("risperidone 2mg 0-0-0", None, None, None, None, True, "BAD_REGIMEN"),
    ("risperidone 2mg 0 - 1-1 -1 - ", "risperidone", 2, "TID", 6, False, None),
    ("risperidone 500μg QD", "risperidone", 0.5, "QD", 0.5, False, None),
    ("risperidone 500µg QD", "risperidone", 0.5, "QD", 0.5, False, None),
    ("risperidone ２mg QD", "risperidone", 2, "QD", 2, False, None),
    ("risperidone 2mg every 3 hours", "risperidone", 2, "Q3H", 16, False, None),
    ("risperidone 2mg 6 times a day", "risperidone", 2, "6X_DAY", 12, False, None),
    ("risperidone 2mg 1-2-2", "risperidone", 2, "1-2-2", 10, False, None),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, medication string")


@pytest.mark.parametrize("parse", [parse_rx, parse_stateless])
def test_golden(spark, parse):
    out = {r.k: r for r in parse(frame(spark, [g[0] for g in GOLDEN])).collect()}
    got = [(GOLDEN[k][0], r.drug, r.dose_mg, r.frequency, r.daily_dose_mg, r.needs_review, r.error) for k, r in sorted(out.items())]
    assert got == [(t, d, mg if mg is None else float(mg), f, day if day is None else float(day), rev, e) for t, d, mg, f, day, rev, e in GOLDEN]


def test_fuzzy_score(spark):
    r = parse_rx(frame(spark, ["seroqual 25mg QD"])).first()
    assert (r.match_type, round(r.match_score, 6)) == ("fuzzy", 87.5)


def test_every_alias(spark):
    rows = dims.alias_rows()
    out = {r.k: r for r in parse_rx(frame(spark, [f"{a} 1mg QD" for _, a, _ in rows])).collect()}
    assert [(out[k].drug, out[k].match_type) for k, _, _ in rows] == [(n, "exact") for _, _, n in rows]


def test_dimensions(spark):
    factors = {(r.method_id, r.source_drug, r.target_drug): r.factor for r in dims.dim_factor(spark).collect()}
    assert len(factors) == 675 == len(dims.factor_rows()) and factors == {k[:3]: k[3] for k in dims.factor_rows()}
    assert all(abs(f * factors[m, t, s] - 1) < 2e-6 for (m, s, t), f in factors.items())
    assert len(dims.alias_rows()) == 130 and len(dims.ALIASES) == 21
    assert {d for _, d, _ in dims.weight_rows()} == set(dims.ALIASES)
    assert duplicate_factors(dims.dim_factor(spark)).isEmpty()
    assert factors["CMD", "risperidone", "chlorpromazine"] == 97.24999999999999


def test_conversions(spark):
    out = {r.method: r for r in convert_all(parse_rx(frame(spark, ["risperidone 4mg QD"]))).collect()}
    assert {m: r.equivalent_dose_mg for m, r in out.items()} == {"CMD": 389.0, "DDD": 240.0, "ED95": 9.652, "MED": 14.9813, "CPZ_FGA": None}
    assert checked(" cmd ") == ("CMD", "chlorpromazine") and selected() == list(dims.METHODS) and "olanzapine" in targets("med")
    for bad in (("XXX", None), ("CMD", "thiothixene")):
        with pytest.raises(ValueError):
            checked(*bad)
    one = convert_one(spark.createDataFrame([("Risperidone ", "4"), ("risperidone", "abc"), ("risperidone", "NaN"), ("risperidone", "Infinity"), ("nothing", "1"), ("risperidone", None)], "drug string, daily_dose string")).collect()
    assert [(r.equivalent and round(r.equivalent, 9), r.error) for r in one] == [(389.0, None), (None, "BAD_DOSE"), (None, "BAD_DOSE"), (None, "BAD_DOSE"), (None, "NO_CONVERSION"), (None, "BAD_DOSE")]
    words = spark.range(1).select(method_warning(F.lit("ed95"), F.lit("Haloperidol"), F.lit("x")).alias("a"), method_warning(F.lit("CMD"), F.lit("haloperidol")).alias("b")).first()
    assert words.a.endswith(dims.ED95_HALOPERIDOL) and words.b == dims.METHOD_WARNINGS["CMD"]


def test_build_factors(spark):
    rows = [(0, "A", "OLZ", "x", 2.0), (1, "A", "OLZ", "x ", 4.0), (2, "A", "OLZ", "y", None), (3, "B", "HAL", "x", 1.0), (4, "C", " CPZ", "chlorpromazine", 2.0), (5, None, "OLZ", "x", 1.0)]
    out = [tuple(r) for r in build_factors(spark.createDataFrame(rows, "row_no int, method_id string, source_drug string, target_drug string, factor double")).collect()]
    assert out == [("A", "olanzapine", "olanzapine", 1.0), ("A", "olanzapine", "x", 4.0), ("A", "x", "olanzapine", 0.25), ("A", "x", "x", 1.0), ("C", "chlorpromazine", "chlorpromazine", 1.0)]


def test_cells(spark):
    cells = [None, " a ", "　 b\t", "NaN", "None ", "null", "nanx"]
    got = [r.c for r in frame(spark, cells).orderBy("k").select(T.cell_text(F.col("medication")).alias("c")).collect()]
    assert got == ["", "a", "b", "", "", "", "nanx"]
    parts = frame(spark, ["a; b,\nc + + d", None, " ; ", "1,000mg"]).orderBy("k").select(T.split_medications(F.col("medication")).alias("c")).collect()
    assert [r.c for r in parts] == [["a", "b", "c", "d"], [], [], ["1", "000mg"]]
    guard = frame(spark, ["=1", "+a", "-", "@x", " =", "a", None]).orderBy("k").select(T.formula_guard(F.col("medication")).alias("c"), T.visual_width(F.col("medication")).alias("w")).collect()
    assert [r.c for r in guard] == ["'=1", "'+a", "'-", "'@x", " =", "a", None]


def plain_frequency(text):
    """The readings of a text, worked out with Python's own expressions; None where they can't be told."""
    out = [(label, n) for p, label, n in Q.KEYWORDS if re.search(p, text, re.I)]
    if m := re.search(Q.HOURLY, text, re.I):
        h = int(m[1] or m[2])
        if not 0 < h <= 24 or 24 % h:
            return None
        out.append((Q.LABELS.get(24 / h, f"Q{h}H"), 24 / h))
    if m := re.search(Q.TIMES, text, re.I):
        n = float(m[1] or m[2])
        if not 0 < n <= 24:
            return None
        out.append((Q.LABELS.get(n, f"{int(n)}X_DAY"), n))
    if m := re.search(Q.REGIMEN, text):
        n = float(sum(map(int, re.findall("[0-9]", m[1]))))
        if not n:
            return None
        out.append((Q.LABELS.get(n, m[1].replace(" ", "")), n))
    return list(dict.fromkeys(out))


PIECES = st.lists(st.sampled_from(["qid", "TID", "bid", "qd", "od", "hs", "qam", "q 8 h", "q5h", "every 6 hours", "2 times a day", "99 times day", "하루 2회", "1일 3 회", "매일", "2회/일", "1-0-1", "0-0-0", "1 - 1 - 1 - 1", "1-2-3-4-5", "12-1-1", "mg/day", "2mg / d", "weekly", "once a week", "four times a day", "x", "-", ".", "3"]), max_size=5)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES.map(" ".join), min_size=20, max_size=20))
def test_frequencies_are_the_plain_ones(spark, texts):
    c = F.col("medication")
    bad = Q.bad_interval(c) | Q.bad_times(c) | Q.bad_regimen(c)
    out = frame(spark, texts).orderBy("k").select(F.when(~bad, Q.frequencies(c)).alias("f")).collect()
    for t, r in zip(texts, out, strict=True):
        want = plain_frequency(t)
        assert (None if want is None else [(a, round(b, 9)) for a, b in want]) == (None if r.f is None else [(x.label, round(x.per_day, 9)) for x in r.f]), t


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _step(row, x, b)
    return row[-1]


def _step(before, x, b):
    done = [0]
    for j, y in enumerate(b, 1):
        done.append(before[j - 1] + 1 if x == y else max(before[j], done[-1]))
    return done


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([a for _, a, _ in dims.alias_rows() if len(a) > 3]), st.integers(0, 12), st.sampled_from("aeixz")), min_size=8, max_size=8))
def test_nearest_alias(spark, edits):
    texts = [a[:k] + c + a[k + 1 :] for a, k, c in edits]
    out = frame(spark, texts).orderBy("k").select(M.alias_nearest(F.col("medication")).alias("n")).collect()
    for t, r in zip(texts, out, strict=True):
        scored = [(200 * lcs(t, a) / (len(t) + len(a)), -k, n) for k, a, n in dims.alias_rows() if len(a) >= 4]
        score, _, drug = max(scored)
        assert (r.n is None) == (score < 85) and (r.n is None or (math.isclose(r.n.score, score) and r.n.drug == drug))


def test_plans(spark):
    plan = convert_all(parse_rx(frame(spark, ["a 1mg QD"])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|CartesianProduct|BroadcastNestedLoop", plan) and "BroadcastHashJoin" in plan


def test_nearest_names_are_of_distinct_texts(spark):
    """The measure stands above the distinct names, in no scan, filter or join condition below."""
    plan = M.match_drugs(frame(spark, ["seroqual 1mg", "x"]), "medication")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.strip() for line in plan.splitlines() if "bit_count" in line]
    assert len(lines) == 1 and lines[0].startswith("+- Aggregate [_asked")


def test_compatibility_forms(spark):
    """As the library has them, but for accents behind their letter; decomposed Hangul names its drug."""
    texts = ["리스페달 2㎎", unicodedata.normalize("NFD", "리스페달 2mg 아빌리파이"), "ﾘｽ ①②½ ㎍ ﬁ Ⅳ ２．５ｍｇ", "㋿ ㍿ µg x² é", "", "plain"]
    out = frame(spark, texts).orderBy("k").select(T.plain_forms(F.col("medication")).alias("t")).collect()
    assert [r.t for r in out] == [unicodedata.normalize("NFKC", t) for t in texts]
    assert [r.drug for r in M.match_drugs(frame(spark, [unicodedata.normalize("NFD", "리스페달 2mg"), "x"]), "medication").orderBy("k").collect()] == ["risperidone", None]
