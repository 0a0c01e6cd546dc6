"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posolog.llm.bpe import recode
from posolog.llm.common import table, written
from posolog.llm.decontaminate import find_matches, judged
from posolog.llm.jaccard_join import near_components
from posolog.llm.line_dedup import dedup_lines
from posolog.llm.lm import score_documents
from posolog.llm.matroska import round_trip
from posolog.llm.pii import BASE, find_pii, listed
from posolog.llm.quality import fit, held_out, score_quality
from posolog.llm.url_filter import judge_urls
from posolog.llm.warc import checked_revisits, read_archives, write_archives


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.array_join("near_items", ",").alias("near_items"),
    )


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = recode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    votes = fit(documents, table(spark, sf_dir, "labels"))
    return score_quality(documents, votes).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = written(write_archives(pages), "archives")
    found = read_archives(archives, pages.schema["page_id"].dataType.simpleString(), payloads=False)
    return checked_revisits(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_matroska": op3_matroska,
    "op4_bpe": op4_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS cut FROM documents),
p AS (
  SELECT doc_id, text, flatten(list_transform(cut, lambda body, line: list_transform(range(0, len(string_split(body, ' ')), 25),
    lambda k: {'line': line, 'body': array_to_string(string_split(body, ' ')[k + 1 : k + 25], ' ')}))) AS lines FROM l),
w AS (
  SELECT doc_id, i AS first_at, array_to_string(list_transform(lines[i + 1 : i + 3], lambda x: x.body), chr(10)) AS body
  FROM (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 1))) AS i FROM p WHERE text <> '')),
o AS (SELECT body, min(doc_id * 10000000 + first_at) AS origin FROM w GROUP BY body HAVING count(*) > 1),
g AS (
  SELECT doc_id, list_distinct(flatten(list(range(first_at, first_at + 3)))) AS gone
  FROM w JOIN o USING (body) WHERE doc_id * 10000000 + first_at <> origin GROUP BY doc_id),
k AS (
  SELECT p.doc_id, text, lines, gone, list_filter(lines, lambda x, i: gone IS NULL OR NOT list_contains(gone, CAST(i - 1 AS BIGINT))) AS kept
  FROM p LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_removed,
  CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(kept, lambda x, i: CASE WHEN i = 1 THEN '' WHEN kept[i - 1].line = x.line THEN ' ' ELSE chr(10) END || x.body), '') END AS text
FROM k
""",
    "op2_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
win AS (
  SELECT item_id, i AS first_at, words[i + 1 : i + 13] AS terms, array_to_string(words[i + 1 : i + 13], ' ') AS body, least(len(words), 13) AS n
  FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 12, 1))) AS i FROM bw WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, i, array_to_string(words[i + 1 : i + n], ' ') AS body
  FROM (SELECT doc_id, words, n, unnest(range(0, len(words) - n + 1)) AS i FROM dw, lens WHERE len(words) >= n)),
hits AS (SELECT doc_id, item_id, i, s.n FROM spots s JOIN win ON win.n = s.n AND win.body = s.body),
agg AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(i, i + n))))) AS n_hit, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS items
  FROM hits GROUP BY doc_id),
places AS (SELECT doc_id, unnest(words) AS term, unnest(range(0, len(words))) AS pos FROM dw),
counts AS (SELECT term, count(*) AS n FROM places GROUP BY term),
ranked AS (
  SELECT item_id, first_at + j AS place, t.term, coalesce(c.n, 0) AS n, row_number() OVER (PARTITION BY item_id, first_at ORDER BY coalesce(c.n, 0), j) AS r
  FROM (SELECT item_id, first_at, unnest(terms) AS term, unnest(range(0, len(terms))) AS j FROM win) t LEFT JOIN counts c USING (term)),
lookups AS (SELECT DISTINCT item_id, place, term FROM ranked WHERE r <= 2 AND n > 0),
wanted AS (SELECT item_id, greatest(2, ceil(count(DISTINCT place) * 0.6)) AS least FROM lookups GROUP BY item_id),
shifted AS (SELECT DISTINCT doc_id, item_id, place, pos - place AS shift FROM places JOIN lookups USING (term)),
near AS (
  SELECT DISTINCT a.doc_id, a.item_id FROM (SELECT DISTINCT doc_id, item_id, shift FROM shifted) a
  JOIN shifted b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.shift >= a.shift AND b.shift < a.shift + 16
  JOIN wanted w ON w.item_id = a.item_id
  GROUP BY a.doc_id, a.item_id, a.shift, w.least HAVING count(DISTINCT b.place) >= w.least),
listed AS (SELECT doc_id, array_to_string(list_sort(list(CAST(item_id AS VARCHAR))), ',') AS near_items FROM near GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated, coalesce(near_items, '') AS near_items
FROM dw LEFT JOIN agg USING (doc_id) LEFT JOIN listed USING (doc_id)
""",
    "op7_url_filter": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
b(h) AS (VALUES ('spam-farm.example.org'), ('spam-farm.example.net'), ('spam-farm.example.com')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
bad AS (SELECT DISTINCT page_id FROM u JOIN b ON host = h OR ends_with(host, '.' || h))
SELECT u.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN fit USING (page_id) LEFT JOIN bad USING (page_id)
""",
    "op9_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to, true AS intact
FROM p LEFT JOIN g ON g.d = p.d
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n
""",
}
