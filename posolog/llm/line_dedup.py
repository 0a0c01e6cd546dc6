"""Line dedup over overlapping three-line windows, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import let, quoted, unused

LINES = 3
#: A longer line of a text goes on as further lines, so that a paragraph has windows too.
LINE_WORDS = 25


def wrapped(text: Column, line_words: int = LINE_WORDS) -> Column:
    """A text's lines in order as an array of (line, body): those between line feeds, wrapped after `line_words` words.

    Words are cut at single blanks. line is the number of the unwrapped line; bodies of one line, joined by blanks, and
    lines, joined by line feeds, are the text again.
    """

    def cut(body: Column, line: Column) -> Column:
        several = let(
            F.split(body, " "),
            lambda words: F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(line_words)), lambda k: F.struct(line.alias("line"), F.array_join(F.slice(words, k + 1, line_words), " ").alias("body"))),
        )
        return F.when(F.length(body) < 2 * line_words, F.array(F.struct(line.alias("line"), body.alias("body")))).otherwise(several)

    return F.flatten(F.transform(F.split(text, "\n"), cut))


def _windows(documents: DataFrame, id_col: str, text_col: str, lines: int, line_words: int) -> DataFrame:
    """Rows (id, key, first, w1, w2): each window's document, place and 128-bit hash."""
    found = F.greatest(F.size("hashes") - lines, F.when(F.col("text") != "", 0).otherwise(-1))
    run = lambda i: F.slice(F.col("hashes"), i + 1, lines)
    return (
        documents.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
        .filter("text IS NOT NULL")
        .select("id", "text", F.xxhash64("text").alias("key"), F.transform(wrapped(F.col("text"), line_words), lambda x: F.struct(F.xxhash64(x["body"]), F.xxhash64(F.lit(7), x["body"]))).alias("hashes"))
        .select("id", "key", F.explode(F.when(found >= 0, F.transform(F.sequence(F.lit(0), found), lambda i: F.struct(i.alias("first"), F.xxhash64(run(i)).alias("w1"), F.xxhash64(F.lit(0x5EED), run(i)).alias("w2"))))).alias("w"))
        .select("id", "key", "w.*")
    )


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES, line_words: int = LINE_WORDS) -> DataFrame:
    """Removes repeated line windows; returns the input's columns plus n_lines and n_removed.

    Lines are those of wrapped(); a window is `lines` consecutive ones, and a text of fewer, but not an empty one, is
    one window. Of the windows with equal lines in all documents, the one with the smallest (id, position) is the first;
    the others are later occurrences and cover their lines. The union of a document's covered lines is removed and the
    rest joined again. So every repeated run of whole lines with more than (lines - 1) * line_words words goes.

    Null text stays null with n_lines 0; an empty text is one empty line and stays. Rows equal in id and text are one
    document and come out alike; null ids sort first. Extra columns are kept as they are, whatever their names; input
    columns named n_lines or n_removed are replaced.
    """
    keep = [c for c in documents.columns if c.lower() not in ("n_lines", "n_removed")]
    key, cid, ckey, gone = unused(documents, "key", "cid", "ckey", "gone")
    windows = _windows(documents, id_col, text_col, lines, line_words)
    place = F.struct("id", "key", "first")
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(repeated, ["w1", "w2"]).filter(~place.eqNullSafe(F.col("origin")))
    covered = (
        later.groupBy(F.col("id").alias(cid), F.col("key").alias(ckey))
        .agg(F.collect_set("first").alias("firsts"))
        .select(cid, ckey, F.array_distinct(F.flatten(F.transform("firsts", lambda f: F.sequence(f, f + lines - 1)))).alias(gone))
    )
    docs = documents.select(*[quoted(c) for c in keep]).withColumn(key, F.xxhash64(quoted(text_col)))
    joined = docs.join(covered, quoted(id_col).eqNullSafe(F.col(cid)) & (F.col(key) == F.col(ckey)), "left")
    text = quoted(text_col)

    def rest(whole: Column) -> Column:
        left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col(gone)), lambda i: F.get(whole, i))
        before = lambda all_, x, i: F.when(i == 0, "").when(F.get(all_, i - 1)["line"] == x["line"], " ").otherwise("\n")
        body = let(left, lambda all_: F.array_join(F.transform(all_, lambda x, i: F.concat(before(all_, x, i), x["body"])), ""))
        return F.struct(body.alias("text"), F.size(whole).cast("long").alias("n_lines"), F.size(F.array_intersect(F.sequence(F.lit(0), F.size(whole) - 1), F.col(gone))).cast("long").alias("n_removed"))

    untouched = F.struct(text.alias("text"), F.when(text.isNull(), 0).otherwise(F.size(wrapped(text, line_words))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    made = unused(joined, "made")[0]
    out = joined.withColumn(made, F.when(F.col(gone).isNull(), untouched).otherwise(let(wrapped(text, line_words), rest)))
    return out.select(*[F.col(f"{made}.text").alias(c) if c == text_col else quoted(c) for c in keep], F.col(f"{made}.n_lines"), F.col(f"{made}.n_removed"))
