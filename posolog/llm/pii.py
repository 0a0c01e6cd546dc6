"""PII spans with DataFrame functions only: patterns propose, checksums confirm, words nearby adjust the score.

A pattern's matches have no positions in SQL; the pieces between them and the matches, measured in code points and
summed up, give them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import let

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> pattern. Possessive repeats never give back what they took: here that changes no match and keeps very long
#: runs linear. An email starts at a run's begin, or where the last match ended within the run; an ip at a run's begin.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A sign that any match of the kind needs: texts without it are not searched.
NEEDED = {"email": "@", "phone": "+"}
#: Words that make a kind likelier in the CONTEXT code points before a match, as far as the last match of the kind.
CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact|write to",
    "ip": r"\bip\b|host|server|address",
    "card": "card|credit|visa|master|payment|iban|account",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security number",
}
CONTEXT = 40
#: Matches whose sizes located() adds up one by one.
BLOCK = 256
#: Scores of a confirmed match without and with a word nearby. Kinds beyond the base need at least LEAST.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.9, 1.0), "ssn": (0.3, 0.9)}
LEAST = 0.5


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order: array of (start, match, before).

    start counts code points, before is the end of the text between the last match and this one. Starts are sums of
    what comes before, taken by blocks so that their cost stays near the number of matches.
    """
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    parts = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(m.alias("match"), (F.length(p) + F.length(m)).alias("size"), F.right(p, F.lit(CONTEXT)).alias("before"))
    )
    known = F.filter(parts, lambda x: x["match"].isNotNull())
    sizes = let(known, lambda k: F.struct(k.alias("known"), F.transform(k, lambda x: x["size"]).alias("sizes")))
    sums = let(sizes, lambda s: F.struct(s["known"].alias("known"), s["sizes"].alias("sizes"), F.transform(F.sequence(F.lit(0), block(F.size(s["sizes"]))), lambda b: total(F.slice(s["sizes"], b * BLOCK + 1, BLOCK))).alias("sums")))
    at = let(sums, lambda s: F.struct(s["known"].alias("known"), s["sizes"].alias("sizes"), F.transform(s["sums"], lambda _, b: total(F.slice(s["sums"], F.lit(1), b))).alias("at")))
    start = lambda s, x, i: F.get(s["at"], block(i)) + total(F.slice(s["sizes"], block(i) * BLOCK + 1, i % BLOCK + 1)) - F.length(x["match"])
    return let(at, lambda s: F.transform(s["known"], lambda x, i: F.struct(start(s, x, i).alias("start"), x["match"].alias("match"), x["before"].alias("before"))))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _signs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)))


def luhn(number: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    value = lambda d: F.ascii(d) - 48
    each = F.transform(_signs(F.reverse(number)), lambda d, i: F.when(i % 2 == 0, value(d)).when(value(d) < 5, value(d) * 2).otherwise(value(d) * 2 - 9))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1: its first four signs moved to the end, letters from 10 on."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_signs(moved), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The kind's validator."""
    n = F.length(digits(match))
    if kind == "ip":
        bare = lambda part: F.regexp_replace(part, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod_97(bare)).otherwise(False)
    if kind == "ssn":
        return ~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) != "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Confirmed and scored matches of a kind: array of (kind, start, end, score)."""
    low, high = SCORES[kind]
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    scored = F.transform(
        F.filter(located(text, PATTERNS[kind]), lambda m: confirmed(kind, m["match"])),
        lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), F.when(F.lower(m["before"]).rlike(CONTEXT_WORDS[kind]), high).otherwise(low).alias("score")),
    )
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST)
    may = F.contains(text, F.lit(NEEDED[kind])) if kind in NEEDED else text.rlike(PATTERNS[kind])
    return F.when(may, scored).otherwise(empty)


def find_pii(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds pii: array of (kind, start, end, score), by kind in the order of PATTERNS, then by start.

    Starts and ends count code points, ends exclusive. Matches are leftmost and non-overlapping within a kind; one that
    its validator refuses is dropped without a further try inside it. Spans of different kinds may overlap. A null or
    empty text has an empty array. Rows are judged by themselves; other columns stay, one named pii is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.withColumn("pii", F.concat(*[_spans(text, kind) for kind in PATTERNS]))


def listed(spans: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
