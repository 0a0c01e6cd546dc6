"""The rows of `queries` in DuckDB's SQL.

DuckDB's regular expressions have no look-around: where a pattern needs a sign on either side, all signs other than
letters, digits, periods, plus and minus are doubled first, so that each match can take its own. Only ASCII texts occur.
"""

from __future__ import annotations

from posolog.functions import frequency as Q
from posolog.functions.text import DECORATION, DRUG_ONLY
from posolog.operators import detect as H
from posolog.plans import dims
from posolog.plans.fixtures import FREE_SHEET, PARTS, SPLIT_SHEET, duck

RX = duck(PARTS)
FREE, SPLIT = duck(FREE_SHEET), duck(SPLIT_SHEET)


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(text(v) if v is None or isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


ALIAS = f"al(ord, alias, drug) AS (VALUES {values(dims.alias_rows())})"
WEIGHT = f"wt(method_id, drug, w) AS (VALUES {values(dims.weight_rows())})"
FACTOR = f"{WEIGHT}, fa AS (SELECT a.method_id, a.drug AS source_drug, b.drug AS target_drug, b.w / a.w AS factor FROM wt a JOIN wt b USING (method_id))"
METHOD = f"me(method_pos, method, target_drug, warning) AS (VALUES {values([(k, m, dims.WEIGHTS[m][1], dims.METHOD_WARNINGS[m]) for k, m in enumerate(dims.METHODS)])})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), {text(DECORATION)}, ' ', 'g'), '\s+', ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace({x}, '[^a-z0-9가-힣]+', '', 'g')"


def drug_only(n: str) -> str:
    out = rf"regexp_replace({n}, '([^0-9a-zA-Z.+-])', '\1\1', 'g')"
    out = rf"regexp_replace({out}, '(^|[^0-9.])[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*(?:mcg|ug|μg|mg|g)([^a-z]|$)', '\1 \2', 'g')"
    for pattern in DRUG_ONLY[1:]:
        out = f"regexp_replace({out}, {text(pattern.split(')', 1)[1])}, ' ', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9가-힣]+', ' ', 'g'))"


def doses(x: str) -> str:
    """Array of {value, unit}."""
    both = rf"regexp_replace({x}, '([^0-9a-zA-Z.+-])', '\1\1', 'g')"
    pattern = r"'(?:^|[^0-9.])([+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))\s*(mcg|ug|mg|g)(?:[^a-zA-Z]|$)'"
    return f"list_transform(list_zip(regexp_extract_all({both}, {pattern}, 1, 'i'), regexp_extract_all({both}, {pattern}, 2, 'i')), lambda z: {{'value': CAST(z[1] AS DOUBLE), 'unit': lower(z[2])}})"


def mg(d: str) -> str:
    return f"CASE {d}.unit WHEN 'mcg' THEN {d}.value / 1000.0 WHEN 'ug' THEN {d}.value / 1000.0 WHEN 'g' THEN {d}.value * 1000.0 ELSE {d}.value END"


def quantity(x: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({x}, '\s((?:\d+(?:\.\d+)?|\.\d+))\s*(?:t|tabs?|tablets?|caps?|capsules?)\b', 1, 'i'), '') AS DOUBLE)"


def either(x: str, pattern: str) -> str:
    return f"TRY_CAST(coalesce(nullif(regexp_extract({x}, {text(pattern)}, 1, 'i'), ''), nullif(regexp_extract({x}, {text(pattern)}, 2, 'i'), '')) AS INTEGER)"


def hours(x: str) -> str:
    return either(x, Q.HOURLY)


def times(x: str) -> str:
    return either(x, Q.TIMES)


def regimen(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '(?:^|[^0-9.])([0-9](?:\s*-\s*[0-9]){{2,3}})(?:[^0-9.]|$)', 1), '')"


def total(x: str) -> str:
    return rf"CAST(list_sum(list_transform(string_split(regexp_replace({regimen(x)}, '\s', '', 'g'), '-'), lambda p: CAST(p AS INTEGER))) AS BIGINT)"


def bad_interval(x: str) -> str:
    return f"coalesce({hours(x)} <= 0 OR {hours(x)} > 24 OR 24 % nullif({hours(x)}, 0) <> 0, false)"


def bad_times(x: str) -> str:
    return f"coalesce({times(x)} <= 0 OR {times(x)} > 24, false)"


def bad_regimen(x: str) -> str:
    return f"coalesce({total(x)} <= 0, false)"


def _label(n: str, other: str) -> str:
    return f"CASE {n} WHEN 1 THEN 'QD' WHEN 2 THEN 'BID' WHEN 3 THEN 'TID' WHEN 4 THEN 'QID' ELSE {other} END"


def readings(x: str) -> str:
    """Array of {label, per_day} in order without repeats, as n rows of a struct."""
    each = [f"CASE WHEN regexp_matches({x}, {text(p)}, 'i') THEN {{'label': {text(label)}, 'per_day': CAST({n!r} AS DOUBLE)}} END" for p, label, n in Q.KEYWORDS]
    h, t, r = hours(x), times(x), total(x)
    each.append(f"CASE WHEN {h} IS NOT NULL THEN {{'label': {_label(f'24.0 / {h}', f'concat(chr(81), {h}, chr(72))')}, 'per_day': CAST(24.0 / {h} AS DOUBLE)}} END")
    each.append(f"CASE WHEN {t} IS NOT NULL THEN {{'label': {_label(t, f'concat({t}, chr(88), chr(95), chr(68), chr(65), chr(89))')}, 'per_day': CAST({t} AS DOUBLE)}} END")
    each.append(f"CASE WHEN {r} IS NOT NULL THEN {{'label': {_label(r, f'replace({regimen(x)}, chr(32), chr(39))')}, 'per_day': CAST({r} AS DOUBLE)}} END".replace("chr(39)", "''"))
    listed = f"list_filter([{', '.join(each)}], lambda f: f IS NOT NULL)"
    return f"list_transform(list_filter(list_zip({listed}, range(1, len({listed}) + 1)), lambda z: list_position({listed}, z[1]) = z[2]), lambda z: z[1])"


def conflict(found: str) -> str:
    return f"len(list_distinct(list_transform({found}, lambda f: f.label))) > 1"


def parser(source: str) -> str:
    """CTEs from rows of `source` with a text column `original` to `parsed`."""
    lcs = (
        "list_last(list_reduce(string_split(q, ''), lambda prev, c: list_reduce(range(1, length(alias) + 1), "
        "lambda acc, j: list_append(acc, CASE WHEN alias[j] = c THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [CAST(0 AS BIGINT)]), "
        "list_resize([CAST(0 AS BIGINT)], length(alias) + 1, CAST(0 AS BIGINT))))"
    )
    return f"""{ALIAS},
tx AS (SELECT DISTINCT original, {normal('original')} AS normal FROM {source}),
ex AS (SELECT original, arg_max(drug, length(alias) * 1000 - ord) AS drug FROM tx JOIN al
  ON CASE WHEN regexp_matches(alias, '^[a-z]+$') THEN list_contains(regexp_extract_all(normal, '[a-z0-9]+'), alias) ELSE contains(normal, alias) END GROUP BY original),
qu AS (SELECT tx.original, {compact(drug_only('normal'))} AS q FROM tx ANTI JOIN ex USING (original)),
co AS (SELECT original, drug FROM qu JOIN al ON alias = q),
op AS (SELECT DISTINCT q FROM qu ANTI JOIN co USING (original) WHERE q <> ''),
sc AS (SELECT q, ord, drug, 200.0 * {lcs} / (length(q) + length(alias)) AS score FROM op JOIN al ON length(alias) >= 4 AND 200.0 * least(length(q), length(alias)) >= 85 * (length(q) + length(alias))),
fz AS (SELECT q, arg_max(drug, (score, -ord)) AS drug, CAST(max(score) AS DOUBLE) AS score FROM sc WHERE score >= 85 GROUP BY q),
ma AS (SELECT tx.original, coalesce(ex.drug, co.drug, fz.drug) AS drug, CASE WHEN coalesce(ex.drug, co.drug) IS NOT NULL THEN 'exact' WHEN fz.drug IS NOT NULL THEN 'fuzzy' END AS match_type,
    CASE WHEN coalesce(ex.drug, co.drug) IS NOT NULL THEN CAST(100.0 AS DOUBLE) ELSE fz.score END AS match_score
  FROM tx LEFT JOIN ex USING (original) LEFT JOIN qu USING (original) LEFT JOIN co USING (original) LEFT JOIN fz USING (q)),
d1 AS (SELECT *, {doses('original')} AS ds, {quantity('original')} AS qy, {bad_interval('original')} AS b1, {bad_times('original')} AS b2, {bad_regimen('original')} AS b3 FROM ma),
d2 AS (SELECT *, {mg('ds[1]')} * coalesce(qy, 1.0) AS mg, CASE WHEN b1 OR b2 OR b3 THEN [] ELSE {readings('original')} END AS fr FROM d1),
d3 AS (SELECT *, CASE WHEN original = '' THEN 'EMPTY' WHEN drug IS NULL THEN 'UNKNOWN_DRUG' WHEN len(ds) = 0 THEN 'NO_DOSE' WHEN len(ds) > 1 THEN 'MULTI_DOSE'
  WHEN qy <= 0 THEN 'BAD_QUANTITY' WHEN mg <= 0 THEN 'BAD_DOSE' WHEN regexp_matches(original, {text(Q.PRN)}, 'i') THEN 'PRN' WHEN regexp_matches(original, {text(Q.LAI)}, 'i') THEN 'LAI_OR_WEEKLY'
  WHEN b1 THEN 'BAD_INTERVAL' WHEN b2 THEN 'BAD_TIMES' WHEN b3 THEN 'BAD_REGIMEN' WHEN {conflict('fr')} THEN 'FREQ_CONFLICT' END AS error FROM d2),
d4 AS (SELECT original, error, CASE WHEN error IS NULL THEN drug END AS drug, CASE WHEN error IS NULL THEN match_type END AS match_type, CASE WHEN error IS NULL THEN match_score END AS match_score,
  CASE WHEN error IS NULL THEN round(mg, 6) END AS dose_mg, CASE WHEN error IS NULL THEN coalesce(fr[1].label, 'ASSUMED_QD') END AS frequency,
  CASE WHEN error IS NULL THEN coalesce(fr[1].per_day, 1.0) END AS frequency_per_day, CASE WHEN error IS NULL THEN round(mg * coalesce(fr[1].per_day, 1.0), 6) END AS daily_dose_mg,
  CASE WHEN error IS NULL THEN CASE WHEN len(fr) = 0 THEN {text(dims.ASSUMED_WARNING)} ELSE '' END END AS warning,
  error IS NOT NULL OR match_type <> 'exact' OR len(fr) = 0 AS needs_review FROM d3),
parsed AS (SELECT s.*, d4.* EXCLUDE (original) FROM {source} s JOIN d4 USING (original))"""


CONVERTED = f"""{FACTOR}, {METHOD},
converted AS (SELECT p.*, me.method_pos, me.method, me.target_drug, fa.factor, round(daily_dose_mg * fa.factor, 4) AS equivalent_dose_mg
  FROM parsed p CROSS JOIN me LEFT JOIN fa ON fa.method_id = me.method AND fa.source_drug = p.drug AND fa.target_drug = me.target_drug WHERE p.drug IS NOT NULL)"""

SOURCE = f"src AS (SELECT *, medication AS original FROM ({RX}))"


def of_text(**columns: str) -> str:
    return f"SELECT rx_id, {', '.join(f'{sql} AS {name}' for name, sql in columns.items())} FROM ({RX})"


def warning(method: str, source: str, target: str) -> str:
    cases = " ".join(f"WHEN {text(m)} THEN {text(w)}" for m, w in dims.METHOD_WARNINGS.items())
    return f"concat(CASE {method} {cases} END, CASE WHEN {method} = 'ED95' AND ({source} = 'haloperidol' OR {target} = 'haloperidol') THEN {text(dims.ED95_HALOPERIDOL)} ELSE '' END)"


def cell(x: str) -> str:
    bare = strip(f"coalesce({x}, '')")
    return f"CASE WHEN lower({bare}) IN ('', 'nan', 'none', 'null') THEN '' ELSE {bare} END"


def split(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[;,\n+]'), lambda m: {strip('m')}), lambda m: m <> '')"


FREQ_CELL = "replace(frequency, '.0', '')"
OFTEN = f"CASE WHEN {FREQ_CELL} = '0.5' THEN 'QOD' WHEN {FREQ_CELL} = '1' THEN 'QD' WHEN {FREQ_CELL} = '2' THEN 'BID' WHEN {FREQ_CELL} = '3' THEN 'TID' WHEN {FREQ_CELL} = '4' THEN 'QID' WHEN regexp_matches({FREQ_CELL}, '^[0-9]+$') THEN concat(CAST({FREQ_CELL} AS INTEGER), ' times a day') ELSE frequency END"
DOSE_CELL = "CASE WHEN dose_mg <> '' THEN concat(dose_mg, CASE WHEN unit = '' THEN 'mg' ELSE unit END) END"
BY_FREQUENCY = f"concat_ws(' ', nullif(drug, ''), {DOSE_CELL}, nullif({OFTEN}, ''))"

#: Items of both sheets: the rows of explode_items() with a number, their patients' labels in place.
BATCH = f"""raw AS (
  SELECT 'free' AS sheet, 0 AS sheet_idx, row_index, row_index + 2 AS source_row, 'medication' AS medication_column, patient_id, {cell('medication')} AS raw, {split(cell('medication'))} AS meds, false AS split_dose FROM ({FREE})
  UNION ALL
  SELECT 'split', 1, row_index, row_index + 4, 'drug', patient_id, {cell('drug')}, CASE WHEN len({split(cell('drug'))}) = 1 THEN [{BY_FREQUENCY}] ELSE {split(cell('drug'))} END, len({split(cell('drug'))}) > 1 FROM ({SPLIT})),
pm AS (SELECT patient_id, printf('PATIENT_%05d', row_number() OVER (ORDER BY place, patient_id)) AS patient FROM (SELECT patient_id, min(sheet_idx * 100000000 + row_index) AS place FROM raw WHERE trim(patient_id) <> '' GROUP BY patient_id)),
rows_ AS (SELECT raw.* EXCLUDE (patient_id), coalesce(pm.patient, '') AS patient FROM raw LEFT JOIN pm USING (patient_id)),
src AS (SELECT row_number() OVER () AS k, * FROM (SELECT sheet, sheet_idx, row_index, source_row, medication_column, patient, unnest(meds) AS original FROM rows_ WHERE NOT split_dose))"""
ERROR_COLUMNS = "sheet, source_row, medication_column, patient, original, error"
COUNTED = "jd AS (SELECT k, sheet, source_row, medication_column, patient, original, drug, match_type, match_score, needs_review, count(factor) AS n, coalesce(string_agg(CASE WHEN factor IS NULL THEN method END, ', ' ORDER BY method_pos), '') AS unavailable_methods FROM converted GROUP BY ALL)"


def scores(h: str, words: list[str]) -> str:
    plain = f"replace(lower(trim({h})), ' ', '_')"
    return "greatest(0, " + ", ".join(f"CASE WHEN contains({plain}, {text(w)}) THEN {len(w)} ELSE 0 END" for w in words) + ")"


def _headers() -> str:
    from posolog.queries import HEADERS

    return f"(VALUES {values(enumerate(HEADERS))}) AS t(pos, header)"


def _patient(h: str) -> str:
    plain = f"replace(lower(trim({h})), ' ', '_')"
    return f"CASE WHEN {plain} IN ({', '.join(map(text, H.PATIENT))}) THEN 100 WHEN {' OR '.join(f'contains({plain}, {text(w)})' for w in H.PATIENT_PARTS)} THEN 50 ELSE 0 END"


def _content(column: str, pos: int) -> str:
    pattern = text(r"(?:\d+(?:\.\d+)?|\.\d+)\s*(?:mcg|ug|mg|g)(?:$|[\s,;+/])")
    return f"SELECT {pos} AS pos, {text(column)} AS \"column\", count(*) FILTER (c <> '') AS cells, coalesce(avg(CAST(regexp_matches(c, {pattern}, 'i') AS INTEGER)) FILTER (c <> ''), 0.0) AS score FROM (SELECT trim({column}) AS c FROM sp WHERE {column} IS NOT NULL ORDER BY row_index LIMIT 100)"


def _built() -> str:
    """The factor rows that the query feeds in, folded by their rules."""
    rows = [(m, d, w) for m, d, w in dims.weight_rows()]
    return f"w(method_id, drug, w) AS (VALUES {values(rows)})"


ORACLE_SQL: dict[str, str] = {
    "flagship_daily_cpz_by_patient": f"WITH {SOURCE}, {parser('src')}, {CONVERTED} SELECT patient_id, method, round(CAST(sum(CAST(equivalent_dose_mg AS DECIMAL(38,4))) AS DOUBLE), 4) AS cpz_mg_per_day, count(*) AS n_prescriptions FROM converted WHERE equivalent_dose_mg IS NOT NULL AND target_drug = 'chlorpromazine' GROUP BY ALL",
    "dim_alias": f"SELECT ord, alias, standard_name FROM (VALUES {values(dims.alias_rows())}) AS t(ord, alias, standard_name)",
    "dim_factor": f"WITH {FACTOR} SELECT * FROM fa",
    "build_factors": f"WITH {_built()} SELECT a.method_id, a.drug AS source_drug, b.drug AS target_drug, b.w / a.w AS factor FROM w a JOIN w b USING (method_id)",
    "methods": f"WITH {WEIGHT} SELECT DISTINCT method_id AS method FROM wt",
    "method_targets": f"WITH {WEIGHT} SELECT DISTINCT method_id, drug AS target_drug FROM wt",
    "method_info": f"SELECT * FROM (VALUES {values(dims.METHOD_INFO)}) AS t(method, basis, reference, limitation)",
    "factor_reciprocal": f"WITH {FACTOR} SELECT a.method_id, a.source_drug, a.target_drug, abs(a.factor * b.factor - 1) < 2e-6 AS reciprocal FROM fa a JOIN fa b ON a.method_id = b.method_id AND a.source_drug = b.target_drug AND a.target_drug = b.source_drug",
    "factor_duplicates": f"WITH {FACTOR} SELECT method_id, source_drug, target_drug, count(*) AS n FROM fa GROUP BY ALL HAVING count(*) > 1",
    "cell_text": f"SELECT rx_id, {cell('x')} AS cell FROM (SELECT rx_id, CASE WHEN rx_id % 5 = 0 THEN ' NaN ' WHEN rx_id % 7 = 0 THEN NULL ELSE concat(chr(9), ' ', medication, ' ', chr(10)) END AS x FROM ({RX}))",
    "split_medications": f"SELECT rx_id, array_to_string({split('x')}, '|') AS items FROM (SELECT rx_id, concat(medication, ';; a+b ,', chr(10), medication) AS x FROM ({RX}))",
    "normalize_text": of_text(normal=normal("medication")),
    "compact_text": of_text(compact=compact(normal("medication"))),
    "drug_only_text": of_text(drug_only=drug_only(normal("medication"))),
    "dose_extract": of_text(doses=f"array_to_string(list_transform({doses('medication')}, lambda x: concat(CAST(round(x.value * 1000) AS BIGINT), ' ', x.unit)), '|')"),
    "dose_count": of_text(n_doses=f"len({doses('medication')})"),
    "dose_mg": f"SELECT rx_id, round({mg('d')}, 6) AS mg FROM (SELECT rx_id, ({doses('medication')})[1] AS d FROM ({RX}))",
    "quantity": of_text(quantity=quantity("medication")),
    "frequency": f"SELECT rx_id, CASE WHEN NOT ({bad_interval('m')} OR {bad_times('m')} OR {bad_regimen('m')}) THEN array_to_string(list_transform({readings('m')}, lambda f: f.label), '|') END AS labels FROM (SELECT rx_id, medication AS m FROM ({RX}))",
    "freq_hourly": of_text(hours=hours("medication"), bad_interval=bad_interval("medication")),
    "freq_times": of_text(times=times("medication"), bad_times=bad_times("medication")),
    "freq_regimen": of_text(regimen=regimen("medication"), total=total("medication"), bad_regimen=bad_regimen("medication")),
    "freq_conflict": f"SELECT rx_id, CASE WHEN {bad_interval('m')} OR {bad_times('m')} OR {bad_regimen('m')} THEN false ELSE {conflict(readings('m'))} END AS conflict FROM (SELECT rx_id, medication AS m FROM ({RX}))",
    "reject_prn": of_text(prn=f"regexp_matches(medication, {text(Q.PRN)}, 'i')"),
    "reject_lai": of_text(lai=f"regexp_matches(medication, {text(Q.LAI)}, 'i')"),
    "alias_exact": f"WITH {SOURCE}, {parser('src')} SELECT rx_id, ex.drug FROM src LEFT JOIN ex USING (original)",
    "alias_compact": f"WITH {ALIAS}, q AS (SELECT rx_id, {compact(drug_only(normal('medication')))} AS q FROM ({RX})) SELECT rx_id, al.drug FROM q LEFT JOIN al ON alias = q",
    "alias_fuzzy": f"WITH {SOURCE}, {parser('src')} SELECT rx_id, drug, round(match_score, 6) AS match_score FROM src JOIN ma USING (original) WHERE match_type = 'fuzzy'",
    "parse_rx": f"WITH {SOURCE}, {parser('src')} SELECT rx_id, drug, dose_mg, frequency, round(frequency_per_day, 6) AS frequency_per_day, daily_dose_mg, match_type, round(match_score, 6) AS match_score, needs_review FROM parsed",
    "parse_errors": f"WITH {SOURCE}, {parser('src')} SELECT coalesce(error, 'OK') AS error, count(*) AS n FROM parsed GROUP BY 1",
    "convert_one": f"WITH {FACTOR}, o AS (SELECT o_orderkey, [' Risperidone', 'olanzapine', 'perphenazine', 'clozapine ', 'nothing'][o_orderkey % 5 + 1] AS drug, CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 11 = 0 THEN '-3' WHEN o_orderkey % 13 = 0 THEN '0' ELSE CAST(o_orderkey % 40 AS VARCHAR) END AS daily_dose FROM orders), j AS (SELECT o.*, factor, TRY_CAST(daily_dose AS DOUBLE) AS d FROM o LEFT JOIN fa ON method_id = 'CMD' AND target_drug = 'chlorpromazine' AND source_drug = lower(trim(drug))) SELECT o_orderkey, drug, daily_dose, CASE WHEN d > 0 THEN round(d * factor, 4) END AS equivalent, CASE WHEN d IS NULL OR d <= 0 THEN 'BAD_DOSE' WHEN factor IS NULL THEN 'NO_CONVERSION' END AS error FROM j",
    "convert_all": f"WITH {SOURCE}, {parser('src')}, {CONVERTED} SELECT rx_id, drug, method, target_drug, equivalent_dose_mg FROM converted",
    "no_conversion": f"WITH {SOURCE}, {parser('src')}, {CONVERTED} SELECT rx_id, drug, method FROM converted WHERE method = 'CPZ_FGA' AND factor IS NULL",
    "method_warning": f"WITH {FACTOR} SELECT method_id, source_drug, target_drug, {warning('method_id', 'source_drug', 'target_drug')} AS warning FROM fa",
    "api_parse": f"""WITH src AS (SELECT id, CAST(unnest(range(0, len(meds))) AS INTEGER) AS item_pos, unnest(meds) AS original FROM (SELECT row_index AS id, {split(cell('medication'))} AS meds FROM ({FREE}))), {parser('src')}, {CONVERTED},
cv AS (SELECT id, item_pos, string_agg(concat_ws(':', method, CASE WHEN factor IS NULL THEN '' ELSE target_drug END, coalesce(CAST(CAST(round(equivalent_dose_mg * 10000) AS BIGINT) AS VARCHAR), '')), '|' ORDER BY method_pos) AS conversions FROM converted GROUP BY ALL)
SELECT id, item_pos, error IS NULL AS ok, original, drug, daily_dose_mg, needs_review, error, conversions FROM parsed LEFT JOIN cv USING (id, item_pos)""",
    "anonymize": f"WITH r AS (SELECT rx_id, CASE WHEN rx_id % 37 = 0 THEN '' ELSE patient_id END AS p FROM ({RX})), m AS (SELECT p, printf('PATIENT_%05d', row_number() OVER (ORDER BY place)) AS patient FROM (SELECT p, min(rx_id) AS place FROM r WHERE p <> '' GROUP BY p)) SELECT rx_id, coalesce(patient, '') AS patient FROM r LEFT JOIN m USING (p)",
    "source_row": f"SELECT 'free' AS sheet, row_index, row_index + 2 AS source_row FROM ({FREE}) UNION ALL SELECT 'split', row_index, row_index + 4 FROM ({SPLIT})",
    "compose_structured": f"SELECT row_index, {BY_FREQUENCY} AS by_frequency, concat_ws(' ', nullif(drug, ''), {DOSE_CELL}, 'QD') AS by_day FROM ({SPLIT})",
    "err_multi_drug": f"WITH {BATCH} SELECT sheet, source_row, medication_column, patient, raw AS original, 'MULTI_DRUG_SPLIT_DOSE' AS error FROM rows_ WHERE split_dose",
    "err_no_column": f"SELECT 'notes' AS sheet, CAST(NULL AS BIGINT) AS source_row, '' AS medication_column, '' AS patient, '' AS original, {text(dims.MESSAGES['NO_MED_COLUMN'])} AS error",
    "out_detailed": f"WITH {BATCH}, {parser('src')}, {CONVERTED} SELECT sheet, source_row, medication_column, patient, original, drug, dose_mg, frequency, daily_dose_mg, method, target_drug, equivalent_dose_mg, warning, match_type, round(match_score, 1) AS match_score, needs_review, {warning('method', 'drug', 'target_drug')} AS method_warning FROM converted WHERE factor IS NOT NULL",
    "out_audit": f"WITH {BATCH}, {parser('src')}, {CONVERTED}, {COUNTED} SELECT sheet, source_row, medication_column, patient, original, drug AS parsed, match_type, round(match_score, 1) AS match_score, CASE WHEN needs_review THEN 'review' ELSE 'converted' END AS status, unavailable_methods FROM jd WHERE n > 0",
    "out_errors": f"WITH {BATCH}, {parser('src')}, {CONVERTED}, {COUNTED} SELECT {ERROR_COLUMNS} FROM parsed WHERE error IS NOT NULL UNION ALL SELECT sheet, source_row, medication_column, patient, original, 'NO_CONVERSION' FROM jd WHERE n = 0 UNION ALL SELECT sheet, source_row, medication_column, patient, raw, 'MULTI_DRUG_SPLIT_DOSE' FROM rows_ WHERE split_dose UNION ALL SELECT 'notes', NULL, '', '', '', 'NO_MED_COLUMN'",
    "formula_guard": f"SELECT rx_id, CASE WHEN regexp_matches(x, '^[=+@-]') THEN concat(chr(39), x) ELSE x END AS guarded FROM (SELECT rx_id, concat(['=', '+', '-', '@', ' =', 'a'][rx_id % 6 + 1], medication) AS x FROM ({RX}))",
    "name_score": f"SELECT pos, header, {scores('header', H.MEDICATION)} AS medication, {scores('header', H.DOSE)} AS dose, {scores('header', H.UNIT)} AS unit, {scores('header', H.FREQUENCY)} AS frequency FROM {_headers()}",
    "patient_score": f"SELECT pos, header, {_patient('header')} AS score FROM {_headers()}",
    "content_score": f"WITH sp AS (SELECT *, concat(drug, ' ', dose_mg, 'mg') AS free FROM ({SPLIT})) " + " UNION ALL ".join(f"({_content(c, k)})" for k, c in enumerate(["drug", "dose_mg", "unit", "frequency", "free"])),
    "detect_columns": "SELECT * FROM (VALUES ('free', 'patient_id', 'medication', NULL, NULL, NULL), ('split', 'patient_id', 'drug', 'dose_mg', 'unit', 'frequency')) AS t(sheet, patient, medication, dose, unit, frequency)",
    "src_csv": """SELECT * FROM (VALUES ('P001', 'Risperdal', '2', 'mg', 'BID', 0::BIGINT), ('P002', 'Abilify', '15', 'mg', 'QD', 1), ('환자3', '리스페달 ', NULL, 'mg', 'BID', 2),
  ('환자4', '리스페달 2mg BID' || chr(10) || '아빌리파이 15mg QD', NULL, NULL, NULL, 3)) t(patient_id, drug, dose, unit, frequency, row_index)""",
    "header_score": f"""WITH c(row, cells) AS (VALUES (0, ['Report', '', '']), (1, ['patient_id', 'medication', 'drug']), (2, ['Unnamed: 0', 'x', 'rx']), (3, []))
SELECT row, CASE WHEN len(cells) = 0 THEN -1.0 ELSE round(CAST(len(list_filter(cells, lambda x: x <> '' AND NOT starts_with(lower(x), 'unnamed:'))) AS DOUBLE) / len(cells) + 3 * len(list_filter(cells, lambda x: {' OR '.join(f"contains(lower(x), {text(w)})" for w in H.MEDICATION)})), 6) END AS header_score FROM c""",
    "sample": "SELECT * FROM (VALUES ('P001', 'Risperdal', '2', 'mg', 'BID'), ('P002', 'Abilify', '15', 'mg', 'QD')) AS t(patient_id, drug, dose, unit, frequency)",
    "legacy_equiv": f"SELECT name AS Drug, rx_id, CAST(rx_id % 20 AS DOUBLE) AS Dose, CPZ_factor, CAST(rx_id % 20 AS DOUBLE) * CPZ_factor AS AP_Equivalent FROM ({RX}) LEFT JOIN (VALUES ('Risperdal', 97.25::DOUBLE), ('Zyprexa', 38.9::DOUBLE), ('haloperidol', 55.5::DOUBLE)) AS db(n, CPZ_factor) ON n = name",
    "llm_normalize": f"SELECT rx_id, trim(lower(name)) AS drug, CASE WHEN upper(trim(freq)) = 'HS' THEN 'QHS' ELSE upper(trim(freq)) END AS frequency FROM ({RX})",
}
