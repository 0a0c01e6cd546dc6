"""Drug names in free text: exact aliases, compact spellings, and the nearest alias of distinct unresolved names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.functions.text import compact, drug_only, normalize_text
from posolog.plans.dims import alias_rows

#: Least similarity (0 to 100) and least length of an alias for the nearest match.
THRESHOLD = 85.0
NEAREST_LENGTH = 4

_ROWS = alias_rows()
_ASCII = [(k, a, n) for k, a, n in _ROWS if re.fullmatch("[a-z]+", a)]
_HANGUL = [(k, a, n) for k, a, n in _ROWS if re.fullmatch("[가-힣]+", a)]
if len(_ASCII) + len(_HANGUL) != len(_ROWS) or len({a for _, a, _ in _ROWS}) != len(_ROWS):
    raise ValueError("aliases are distinct and of one script each")


def _ranked(rows: list[tuple[int, str, str]]) -> list[Column]:
    return [F.struct(F.lit(len(a)).alias("length"), F.lit(-k).alias("rank"), F.lit(n).alias("drug")) for k, a, n in rows]


def alias_exact(normal: Column) -> Column:
    """The drug of the longest alias in a normalised text, the earlier of equally long ones; null without one.

    A Latin alias has no a-z or digit beside it, so it is a whole run of these; a Hangul one may stand anywhere.
    """
    table = F.create_map(*[x for row, value in zip(_ASCII, _ranked(_ASCII), strict=True) for x in (F.lit(row[1]), value)])
    latin = F.transform(F.array_distinct(F.regexp_extract_all(normal, F.lit("[a-z0-9]+"), F.lit(0))), lambda t: F.try_element_at(table, t))
    hangul = F.array(*[F.when(F.contains(normal, F.lit(a)), value) for (_, a, _), value in zip(_HANGUL, _ranked(_HANGUL), strict=True)])
    found = F.when(normal.rlike("[가-힣]"), F.concat(latin, hangul)).otherwise(latin)
    return F.array_max(found)["drug"]


def alias_compact(query: Column) -> Column:
    """The drug whose alias the compact drug text is; null if none."""
    table = F.create_map(*[F.lit(x) for _, a, n in _ROWS for x in (a, n)])
    return F.try_element_at(table, query)


def compact_query(normal: Column) -> Column:
    """The compact text of what a prescription says beside dose, form and frequency."""
    return compact(drug_only(normal))


def common_subsequence(signs: Column, places: Column, size: Column) -> Column:
    """Length of the longest common subsequence of an array of signs and a word of up to 62 signs.

    places maps each of the word's signs to the bits of its places. The state has a bit for each place, and a step
    clears those at which a common subsequence ends that is longer by one (Crochemore et al. 2001).
    """
    every = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1

    def step(state: Column, sign: Column) -> Column:
        met = state.bitwiseAND(F.coalesce(F.try_element_at(places, sign), F.lit(0).cast("long")))
        return (state + met).bitwiseOR(state - met).bitwiseAND(every)

    return size - F.bit_count(F.aggregate(signs, every, step))


def _places(word: str) -> dict[str, int]:
    return {c: sum(1 << k for k, x in enumerate(word) if x == c) for c in word}


def alias_nearest(query: Column) -> Column:
    """struct(score, rank, drug) of the nearest alias at THRESHOLD or above, the earlier of equally near ones; else null.

    The score is 200 * common subsequence / both lengths. One expression runs over the array of aliases; those whose
    length alone rules THRESHOLD out are left out before.
    """
    aliases = F.array(
        *[
            F.struct(F.lit(len(a)).alias("size"), F.create_map(*[F.lit(c) if k == 0 else F.lit(c).cast("long") for kv in _places(a).items() for k, c in enumerate(kv)]).alias("places"), F.lit(-k).alias("rank"), F.lit(n).alias("drug"))
            for k, a, n in _ROWS
            if len(a) >= NEAREST_LENGTH
        ]
    )
    size = F.length(query)
    near = F.filter(aliases, lambda a: (size > 0) & (200.0 * F.least(size, a["size"]) >= THRESHOLD * (size + a["size"])))
    signs = F.filter(F.split(query, ""), lambda c: c != "")
    scored = F.transform(near, lambda a: F.struct((200.0 * common_subsequence(signs, a["places"], a["size"]) / (size + a["size"])).alias("score"), a["rank"].alias("rank"), a["drug"].alias("drug")))
    return F.array_max(F.filter(scored, lambda s: s["score"] >= THRESHOLD))


def match_drugs(df: DataFrame, text_col: str = "original") -> DataFrame:
    """Adds drug, match_type and match_score; all null where no name is found.

    Nearest names are worked out for the distinct unresolved compact texts only and joined back.
    """
    known = df.withColumn("_normal", normalize_text(F.col(text_col)))
    known = known.withColumn("_drug", alias_exact(F.col("_normal"))).withColumn("_query", F.when(F.col("_drug").isNull(), compact_query(F.col("_normal"))))
    known = known.withColumn("_drug", F.coalesce("_drug", alias_compact(F.col("_query"))))
    open_ = known.filter("_drug IS NULL AND _query <> ''").select(F.col("_query").alias("_asked")).distinct()
    near = open_.withColumn("_near", alias_nearest(F.col("_asked")))  # no filter on _near: it would be worked out below distinct()
    joined = known.join(near, F.col("_drug").isNull() & (F.col("_query") == F.col("_asked")), "left")
    return joined.withColumns(
        {
            "drug": F.coalesce("_drug", "_near.drug"),
            "match_type": F.when(F.col("_drug").isNotNull(), "exact").when(F.col("_near").isNotNull(), "fuzzy"),
            "match_score": F.when(F.col("_drug").isNotNull(), 100.0).otherwise(F.col("_near.score")),
        }
    ).drop("_normal", "_drug", "_query", "_asked", "_near")
