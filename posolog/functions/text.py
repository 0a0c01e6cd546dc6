"""Text of cells and prescriptions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that stand for nothing, what parts a cell's medications, signs that decorate.
NOTHING = ("", "nan", "none", "null")
SEPARATORS = r"[;,\n+]"
DECORATION = r"""[_·•‧/\\|:;,+()\[\]{}'"`~!@#$%^&*=<>?-]+"""

#: Compatibility forms (NFKC) of single signs: those that are one sign and those that are several, from the rule itself.
_FORMS = {c: n for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0xFFFF))) if (n := unicodedata.normalize("NFKC", c)) != c}
_SINGLE = {c: n for c, n in _FORMS.items() if len(n) == 1}
_SEVERAL = {c: n for c, n in _FORMS.items() if len(n) > 1}
#: First, middle and last letters that make a Hangul syllable when they stand together.
_LETTERS = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?"

# Units and the pattern of a dose.
UNIT = r"mcg|ug|μg|㎍|mg|㎎|g"
DOSE = rf"(?iuU)(?<![\d.])([+-]?(?:\d+(?:\.\d+)?|\.\d+))\s*({UNIT})(?![a-z])"

#: Words of frequency and form that are no part of a drug's name.
DRUG_ONLY = (
    DOSE,
    r"(?iuU)\b(?:qid|tid|bid|qod|qhs|hs|qam|qd|od|daily|weekly|tab(?:let)?s?|caps?(?:ules?)?)\b",
    r"(?iuU)\b\d+(?:\.\d+)?\s*(?:t|tabs?|tablets?|caps?)\b",
    r"(?uU)(?:하루|1일)\s*[1-4]\s*회|매일|\d+(?:\.\d+)?\s*(?:정|캡슐)",
)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cell_text(c: Column) -> Column:
    """A cell's stripped text; null and texts that stand for nothing are empty."""
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin(*NOTHING), "").otherwise(text)


def split_medications(c: Column) -> Column:
    """A cell's medications in order, stripped, without empty ones; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SEPARATORS), strip), lambda m: m != "")


def _syllable(letters: Column) -> Column:
    """The syllable of two or three letters, by its place in the code; other text as it is."""
    code = lambda k: F.ascii(F.substr(letters, F.lit(k), F.lit(1)))
    last = F.when(F.length(letters) > 2, code(3) - 0x11A7).otherwise(0)
    whole = ((code(1) - 0x1100) * 21 + code(2) - 0x1161) * 28 + last + 0xAC00
    return F.when(letters.rlike(f"^{_LETTERS}$"), F.decode(F.unhex(F.hex(whole)), "UTF-16BE")).otherwise(letters)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_forms(c: Column) -> Column:
    """Compatibility forms replaced by plain ones, Hangul letters put together. ASCII texts are left alone. Accents that
    stand behind their letter stay there."""
    several = F.create_map(*[F.lit(x) for kv in _SEVERAL.items() for x in kv])
    spelt = lambda x: F.array_join(F.transform(F.split(x, ""), lambda sign: F.coalesce(F.try_element_at(several, sign), sign)), "")
    single = lambda x: F.translate(F.when(x.rlike(f"[{''.join(_SEVERAL)}]"), spelt(x)).otherwise(x), "".join(_SINGLE), "".join(_SINGLE.values()))
    composed = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"(?s){_LETTERS}|."), F.lit(0)), _syllable), "")
    plain = _let(single(c), lambda x: F.when(x.rlike(_LETTERS), composed(x)).otherwise(x))
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Plain forms, lower case, decoration as a blank, single blanks. A period stays."""
    bare = F.regexp_replace(F.lower(plain_forms(F.coalesce(c, F.lit("")))), DECORATION, " ")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def compact(normal: Column) -> Column:
    """Of a normalised text the letters a-z, digits and Hangul syllables."""
    return F.regexp_replace(normal, "[^a-z0-9가-힣]+", "")


def compact_text(c: Column) -> Column:
    return compact(normalize_text(c))


def drug_only(normal: Column) -> Column:
    """Of a normalised text what is left without doses, frequencies, forms and quantities."""
    for pattern in DRUG_ONLY:
        normal = F.regexp_replace(normal, pattern, " ")
    return F.trim(F.regexp_replace(normal, "[^a-z0-9가-힣]+", " "))


def formula_guard(c: Column) -> Column:
    """An apostrophe before a text that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
