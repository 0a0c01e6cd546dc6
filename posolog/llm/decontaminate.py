"""Benchmark decontamination over a positional inverted index, DataFrame functions only.

The index holds a posting (document, position) for each training token that a test window would probe. Each window
probes its two rarest terms; their lists, each moved back by the term's offset, are intersected, and what stays is
compared with the window's other terms in the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import ascii_words, quoted, small, unused, written

WINDOW = 13
PROBES = 2
#: Broadcast a table of terms or probes only up to so many rows.
BROADCAST_ROWS = 200_000
#: Proximity: so large a share of an item's probed places at shifts less than NEAR_SLOP words apart.
NEAR_SLOP = 16
NEAR_SHARE = 0.6


def test_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, first, terms): every `window` consecutive words of an item; an item of fewer words is one window."""
    words = benchmark.select(F.col(id_col).alias("item_id"), ascii_words(F.col(text_col)).alias("_words")).filter(F.size("_words") > 0).distinct()
    return words.select("item_id", "_words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_words") - window, F.lit(0)))).alias("first")).select(
        "item_id", "first", F.slice("_words", F.col("first") + 1, window).alias("terms")
    )


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms stands in all documents: rows (term, n)."""
    tokens = documents.select(F.explode(ascii_words(F.col("text"))).alias("term"))
    return tokens.join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def probes(windows: DataFrame, counts: DataFrame, per_window: int = PROBES) -> DataFrame:
    """Rows (item_id, first, terms, offsets, whole): the places in the item of the window's rarest terms, rarest first.

    A term that no document has is the rarest and has no place; a window with such a term occurs nowhere and isn't whole.
    """
    each = windows.select("item_id", "first", "terms", F.posexplode("terms").alias("at", "term")).join(counts, "term", "left")
    ranked = each.groupBy("item_id", "first", "terms").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("at")))), 1, per_window).alias("rarest")
    )
    return ranked.select("item_id", "first", "terms", F.transform(F.filter("rarest", lambda r: r["n"] > 0), lambda r: r["at"] + F.col("first")).alias("offsets"), (F.col("least") > 0).alias("whole"))


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the terms: rows (term, id, key, pos)."""
    return documents.select("id", "key", F.posexplode(ascii_words(F.col("text"))).alias("pos", "term")).join(terms, "term")


def near_matches(shifted: DataFrame, lookups: DataFrame, n_lookups: int) -> DataFrame:
    """Rows (id, key, near_items): the items of which NEAR_SHARE of the probed places, two at least, meet the document's
    words at shifts less than NEAR_SLOP apart.

    Any such run of shifts lies within one of two rows of bands, each twice as wide; a band with enough places is looked
    through shift by shift.
    """
    wanted = lookups.groupBy("item_id").agg(F.greatest(F.lit(2), F.ceil(F.countDistinct("offset") * NEAR_SHARE)).alias("least"))
    band = lambda k: F.floor((F.col("shift") + k * NEAR_SLOP) / (2 * NEAR_SLOP))
    banded = shifted.select("id", "key", "item_id", F.struct("shift", "offset").alias("at"), F.posexplode(F.array(band(0), band(1))).alias("row", "band"))
    run = lambda x: F.filter("met", lambda y: (y["shift"] >= x["shift"]) & (y["shift"] < x["shift"] + NEAR_SLOP))
    met = banded.groupBy("id", "key", "item_id", "row", "band").agg(F.collect_set("at").alias("met")).join(small(wanted, n_lookups, BROADCAST_ROWS), "item_id").filter(F.size("met") >= F.col("least"))
    near = met.filter(F.exists("met", lambda x: F.size(F.array_distinct(F.transform(run(x), lambda y: y["offset"]))) >= F.col("least")))
    return near.groupBy("id", "key").agg(F.collect_set("item_id").alias("near_items"))


def find_matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Exact and proximity matches of every benchmark item in every document.

    Returns the documents' columns with n_words, n_hit, items (sorted array of the item ids with an occurring window,
    as strings), spans (sorted array of the windows' [start, end) word places) and near_items (as near_matches() says).
    A null text has no words. Items without words match nothing; equal items match alike. Rows equal in id and text
    are one document and come out alike. Extra columns stay, whatever their names; columns of the added names are
    replaced. Null item ids are left out of the lists.
    """
    docs = documents.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    windows = written(test_windows(benchmark, window), "test-windows")
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    vocabulary = small(vocabulary, vocabulary.count(), BROADCAST_ROWS)
    counts = written(term_counts(docs, vocabulary), "term-counts")
    probed = written(probes(windows, small(counts, counts.count(), BROADCAST_ROWS)), "probes")

    lookups = probed.select("item_id", F.explode("offsets").alias("offset"), "terms", "first").select("item_id", "offset", F.get("terms", F.col("offset") - F.col("first")).alias("term")).distinct()
    n_lookups = lookups.count()
    terms = small(lookups.select("term").distinct(), n_lookups, BROADCAST_ROWS)
    index = written(postings(docs, terms), "postings")
    shifted = index.join(small(lookups, n_lookups, BROADCAST_ROWS), "term").withColumn("shift", F.col("pos") - F.col("offset"))
    aligned = shifted.groupBy("id", "key", "item_id", "shift").agg(F.collect_set("offset").alias("found"))

    items = probed.filter("whole").groupBy("item_id").agg(F.collect_list(F.struct("first", "offsets", "terms")).alias("windows"))
    candidates = (
        aligned.join(small(items, items.count(), BROADCAST_ROWS // 100), "item_id")
        .withColumn("windows", F.filter("windows", lambda w: F.size(F.array_except(w["offsets"], F.col("found"))) == 0))
        .filter(F.size("windows") > 0)
    )
    tries = candidates.groupBy("id", "key").agg(
        F.collect_list(F.struct("item_id", "shift", F.transform("windows", lambda w: F.struct(w["first"].alias("first"), w["terms"].alias("terms"))).alias("windows"))).alias("tries")
    )
    near = near_matches(shifted, lookups, n_lookups).toDF("nid", "nkey", "near_items")
    both = tries.join(near, F.col("id").eqNullSafe(F.col("nid")) & (F.col("key") == F.col("nkey")), "full")
    return _verified(documents, written(both.select(F.coalesce("id", "nid").alias("id"), F.coalesce("key", "nkey").alias("key"), "tries", "near_items"), "candidates"), id_col, text_col)


#: What find_matches() adds.
ADDED = ("n_words", "n_hit", "items", "spans", "near_items")


def _verified(documents: DataFrame, tries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Compares each candidate's terms with the document's own words at its shift."""
    keep = [c for c in documents.columns if c.lower() not in ADDED]
    key, cid, ckey, tried, near, words, found = unused(documents, "key", "cid", "ckey", "tried", "near", "words", "found")
    docs = documents.select(*[quoted(c) for c in keep]).withColumn(key, F.xxhash64(quoted(text_col)))
    joined = docs.join(tries.toDF(cid, ckey, tried, near), quoted(id_col).eqNullSafe(F.col(cid)) & F.col(key).eqNullSafe(F.col(ckey)), "left").withColumn(words, ascii_words(quoted(text_col)))

    def holds(c, w):
        at = c["shift"] + w["first"]
        return F.when(at >= 0, F.slice(F.col(words), at + 1, F.size(w["terms"])) == w["terms"]).otherwise(False)

    spots = F.flatten(
        F.transform(
            tried,
            lambda c: F.transform(
                F.filter(c["windows"], lambda w: holds(c, w)),
                lambda w: F.struct(c["item_id"].cast("string").alias("item"), (c["shift"] + w["first"]).alias("start"), (c["shift"] + w["first"] + F.size(w["terms"])).alias("end")),
            ),
        )
    )
    checked = joined.withColumn(found, F.when(F.col(tried).isNotNull(), spots))
    hit = F.array_distinct(F.flatten(F.transform(found, lambda f: F.sequence(f["start"], f["end"] - 1))))
    none = F.array().cast("array<string>")
    return checked.select(
        *[quoted(c) for c in keep],
        F.size(words).cast("long").alias("n_words"),
        F.when(F.col(found).isNull(), 0).otherwise(F.size(hit)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["item"]))), none).alias("items"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce(F.array_sort(F.filter(F.transform(near, lambda i: i.cast("string")), lambda i: i.isNotNull())), none).alias("near_items"),
    )


def judged(matches: DataFrame, share: int = 20) -> DataFrame:
    """Adds contaminated: a hit covers at least one word in `share`."""
    return matches.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
