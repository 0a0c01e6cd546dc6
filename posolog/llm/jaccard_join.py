"""N-gram Jaccard join with prefix filters under several global token orders.

Sets of equal shingles are one node. Under any global order, two sets with Jaccard >= t share k of the first p + k - 1
tokens of one of them, p = n - ceil(t n) + 1. Order 1 is a hash; its prefixes (k = p) are indexed, tokens that no other
prefix has go, and a set with fewer than k tokens left has no partner. The whole sets of the others are counted the same
way: one of which fewer than ceil(t n) tokens are in other sets too has no partner. Order 2 is by these counts, rarest
first, and its prefixes name the candidates. Orders 3 and 4 are hashes again, and their filters are intersected before a
pair's sets are compared.

A bucket of few documents gives its pairs. Large ones that overlap are one family and don't: with K the tokens that most
of its members have, two members z and y differ by at most |z^K| + |y^K| tokens, so the member nearest to K is linked to
all that this bound admits, and every other linked pair shares tokens of z^K and y^K. Those are counted and ranked within
the family as tokens are before, and buckets by their prefixes are taken the same way as long as some are large: there
one difference less is left. No link is lost and no large group is paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posolog.llm.common import pieces, raw_texts, released, small, written
from posolog.llm.components import connected

SHINGLE_WORDS = 4
THRESHOLD = (85, 100)
#: Buckets of up to so many sets give their pairs.
PAIRED = 32
#: Buckets before its own that a member of a bucket names.
NAMED_BEFORE = 64
#: Members that name the core of a large bucket.
CORE_SETS = 9
#: Broadcast ids of documents, or pairs of them, only up to so many; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Broadcast the cores of large buckets only up to so many tokens in all.
BROADCAST_TOKENS = 4_000_000

_FOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(30), np.uint64(0xBF58476D1CE4E5B9), np.uint64(27), np.uint64(0x94D049BB133111EB), np.uint64(31))


def _mixed(h: np.ndarray) -> np.ndarray:
    a, m, b, k, c = _MIX
    h = (h ^ (h >> a)) * m
    h = (h ^ (h >> b)) * k
    return h ^ (h >> c)


def _hashes(raw: bytes | None) -> np.ndarray:
    found = (raw or b"").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def shingle_set(raw: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a shorter text is one shingle, an empty one has none."""
    each = _hashes(raw)
    if not len(each):
        return each
    size = min(words, len(each))
    folded = each[: len(each) - size + 1] + np.uint64(size)
    for k in range(1, size):
        folded = folded * _FOLD + each[k : len(each) - size + 1 + k]
    return np.unique(_mixed(folded))


def prefix_length(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    num, den = threshold
    return n - -(-num * n // den) + 1


def shared_least(p: int, n: int) -> int:
    """k of a set of n tokens: of its first p + k - 1 ones under order 1 a linked set no smaller shares k at least."""
    return min(p, n - p + 1)


def filter_prefix(tokens: np.ndarray, p: int) -> np.ndarray:
    """A filter's prefix as distinct 32-bit values behind the number of them that a linked set shares at least.

    It is made of p + k - 1 tokens, k = p // 2 + 1; tokens that fall together in 32 bits lower the number.
    """
    short = np.unique(tokens.astype(np.uint32))
    return np.r_[np.int32(max(1, p // 2 + 1 - (len(tokens) - len(short)))), short.view(np.int32)]


def first(tokens: np.ndarray, seed: int, size: int) -> np.ndarray:
    """The tokens of the lowest ranks under a seeded hash, in no order unless they are all."""
    rank = _mixed(tokens ^ np.uint64(seed))
    return tokens[np.argpartition(rank, size - 1)[:size]] if 0 < size < len(tokens) else tokens[np.argsort(rank)]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _sketches(docs: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Rows (_id, n, f1, f2, p1): set size, fingerprint, and the prefix under order 1."""

    @released
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n, f1, f2, prefixes = [], [], [], []
            for raw in raw_texts(batch.column(1)):
                tokens = shingle_set(raw, words)
                p = prefix_length(len(tokens), threshold) if len(tokens) else 0
                n.append(len(tokens))
                h = xxhash.xxh3_128_intdigest(tokens.tobytes())
                f1.append((h & (2**64 - 1)) - 2**63)
                f2.append((h >> 64) - 2**63)
                prefixes.append(first(tokens, 1, p + shared_least(p, len(tokens)) - 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(prefixes, pa.int64())], ["_id", "n", "f1", "f2", "p1"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text").mapInArrow(sketch, f"_id {kind}, n int, f1 bigint, f2 bigint, p1 array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Rows (v, n, s, p3, p4): the tokens of the nodes' sets, taken from the texts again, and the filters of orders 3 and 4."""

    @released
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            ids, sets, filters = [], [], ([], [])
            for v, f1, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                tokens = shingle_set(raw, words)
                if (xxhash.xxh3_128_intdigest(tokens.tobytes()) & (2**64 - 1)) - 2**63 == f1:
                    p = prefix_length(len(tokens), threshold)
                    ids.append(v)
                    sets.append(first(tokens, 1, len(tokens)).view(np.int64))
                    for k, out in enumerate(filters, start=3):
                        out.append(filter_prefix(first(tokens, k, p + p // 2), p))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array([len(s) for s in sets], pa.int32()), _lists(sets, pa.int64()), *(_lists(f, pa.int32()) for f in filters)], ["v", "n", "s", "p3", "p4"])

    kind = docs.schema["_id"].dataType.simpleString()
    texts = docs.join(nodes, docs["_id"] == nodes["v"]).select("v", "f1", "_text")
    return texts.mapInArrow(whole, f"v {kind}, n int, s array<bigint>, p3 array<int>, p4 array<int>")


def _least_of_partners(n: Column, threshold: tuple[int, int]) -> Column:
    """shared_least() of the smallest set that one of n tokens can link to."""
    least = _least(n, threshold)
    p = least - _least(least, threshold) + 1
    return F.least(p, least - p + 1)


def _least(n: Column, threshold: tuple[int, int]) -> Column:
    """How many tokens a set of n shares with a linked one at least."""
    num, den = threshold
    return F.ceil(n * num / den).cast("int")


def _repeated(tokens: DataFrame, label: str) -> DataFrame:
    """The rows (g, v, ..) of tokens g that several have, with how many do (c).

    Tokens are counted before they are shuffled, and one that a great part of all sets has is dealt out by the join.
    """
    often = tokens.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1")
    return written(tokens.join(often.hint("shuffle_hash"), "g"), label)


def _may_link(sketches: DataFrame, nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The nodes (v, f1) whose prefix under order 1 shares enough tokens with other prefixes."""
    n_nodes = nodes.count()
    own = sketches.select("_id", "f1", "p1").join(small(nodes.select(F.col("v").alias("_id"), "f1"), n_nodes, BROADCAST_IDS), ["_id", "f1"], "left_semi")
    if own.count() > n_nodes:  # rows that are equal in id and text
        own = own.dropDuplicates(["_id", "f1"])
    shared = _repeated(own.select(F.explode("p1").alias("g"), F.col("_id").alias("v")), "shared")
    found = shared.groupBy("v").agg(F.count("*").alias("s")).join(small(nodes, n_nodes, BROADCAST_IDS), "v")
    return written(found.filter(F.col("s") >= _least_of_partners(F.col("n"), threshold)).select("v", "f1"), "wanted")


def _rarest(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows (g, v, n): the prefixes under order 2 of the sets that share enough tokens with others."""
    shared = _repeated(sets.select(F.explode("s").alias("g"), "v", "n"), "repeated")
    least = _least(F.col("n"), threshold)
    kept = shared.groupBy("v", "n").agg(F.count("*").alias("s")).filter(F.col("s") >= least)
    kept = written(kept.select("v", (F.col("s") - least + 1).alias("size")), "kept")
    ranked = shared.join(small(kept, kept.count(), BROADCAST_IDS), "v").withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("c", "g")))
    return written(ranked.filter("rank <= size").select("g", "v", "n"), "rarest")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (g, v, n, members) of buckets with two members or more; of buckets with the same members one stays."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("members"), *[F.bit_xor(F.xxhash64(F.lit(k), "v")).alias(f"x{k}") for k in (1, 2)])
    kept = sizes.filter("members > 1").groupBy("members", "x1", "x2").agg(F.min("g").alias("g")).select("g", "members")
    return rows.join(kept, "g")


def _pairs(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of buckets with up to PAIRED members that the sizes of their sets allow.

    A pair comes from the first of its buckets: each member names up to NAMED_BEFORE of its buckets before this one, and
    pairs that meet there aren't made again.
    """
    num, den = threshold
    before = Window.partitionBy("v").orderBy("g").rowsBetween(-NAMED_BEFORE, -1)
    paired = rows.filter(F.col("members") <= PAIRED).withColumn("before", F.collect_list("g").over(before))
    groups = paired.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("v", "n", "before"))).alias("m"))
    fits = lambda x, y: (den * F.least(x["n"], y["n"]) >= num * F.greatest(x["n"], y["n"])) & (x["v"] < y["v"]) & ~F.arrays_overlap(x["before"], y["before"])
    met = groups.select(F.posexplode("m").alias("i", "x"), "m")
    met = met.select("x", F.explode(F.filter(F.slice("m", F.col("i") + 2, PAIRED), lambda y: fits(F.col("x"), y))).alias("y"))
    return met.select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct()


def _named(*tables: DataFrame) -> DataFrame:
    """The distinct ids (v) in all columns a, b and v of the tables, broadcast if their count allows."""
    ids = None
    for t in tables:
        for c in {"a", "b", "v"}.intersection(t.columns):
            ids = t.select(F.col(c).alias("v")) if ids is None else ids.union(t.select(c))
    ids = written(ids.distinct(), "named")
    return small(ids, ids.count(), BROADCAST_IDS)


def _met(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The pairs (a, b) with columns of both sets, named a_ and b_."""
    held = sets.join(_named(pairs), "v", "left_semi")
    side = lambda c: held.select(F.col("v").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns])
    return side("a").join(small(pairs, pairs.count(), BROADCAST_IDS), "a").join(side("b"), "b")


def _pass_orders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs those that share enough prefix tokens under orders 3 and 4 too."""
    rest = lambda c: F.slice(c, F.lit(2), F.size(c))
    shares = lambda k: F.size(F.array_intersect(rest(f"a_p{k}"), rest(f"b_p{k}"))) >= F.least(F.get(f"a_p{k}", F.lit(0)), F.get(f"b_p{k}", F.lit(0)))
    return _met(pairs, sets, ("p3", "p4")).filter(shares(3) & shares(4)).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of the pairs those whose sets link."""
    num, den = threshold
    met = _met(pairs, sets, ("n", "s")).withColumn("i", F.size(F.array_intersect("a_s", "b_s")))
    return met.filter(den * F.col("i") >= num * (F.col("a_n") + F.col("b_n") - F.col("i"))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> list[DataFrame]:
    """Links among the pairs that have the closure of all of them.

    The filters come first. Each set is compared with the first of its candidates, and the links found so far put sets
    under one label; pairs within a label are linked already, and all others are compared.
    """
    pairs = written(_pass_orders(pairs, sets), "filtered")
    star = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
    links = written(_compared(star, sets, threshold), "links")
    n_links = links.count()
    label = lambda c: small(links.select(F.col("b").alias(c), F.col("a").alias(f"{c}_label")), n_links, BROADCAST_IDS)
    apart = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    rest = written(apart.join(small(star, star.count(), BROADCAST_IDS), ["a", "b"], "left_anti"), "rest")
    return [links, written(_compared(rest, sets, threshold), "links")]


def _core(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (g, k): the tokens that more than half of a few members have, chosen by hash. Any k gives right links; one
    near the members gives few keys."""
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("v")))).filter(F.col("r") <= CORE_SETS).drop("r")
    few = written(few, "few")
    held = sets.select("v", "s").join(small(few, few.count(), BROADCAST_IDS), "v").groupBy("g").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("t"), F.floor(F.count("*") / 2).cast("int").alias("half"))
    core = written(held.select("g", F.array_distinct(F.filter("t", lambda x, i: F.get("t", i + F.col("half")) == x)).alias("k")), "core")
    return small(core, core.agg(F.coalesce(F.sum(F.size("k")), F.lit(0))).first()[0], BROADCAST_TOKENS)


def _split(rows: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """One step on large buckets (g, v): the links that the bound proves, and the rows of the buckets that follow.

    With d = |v^K| and u = d - (1 - t) / (1 + t) n, two members are linked if their u sum to 0 or less, and if linked
    otherwise share at least half that sum of the tokens of z^K and y^K, and all but (1 - t) / t n of v^K. Members that
    the centre (of the least u) is linked to need only meet the others, of which the nearest has the least u. Tokens that
    one member alone has are shared with nobody; of the others each member gives its rarest ones, as many as that asks.
    """
    num, den = threshold
    rows = rows.select("g", "v")
    members = sets.select("v", "n", "s").join(small(rows, rows.count(), BROADCAST_IDS), "v")
    apart = (
        members.join(_core(rows, sets), "g")
        .select("g", "v", "n", F.concat(F.array_except("s", "k"), F.array_except("k", "s")).alias("d"))
        .withColumn("u", (den + num) * F.size("d") - (den - num) * F.col("n"))
    )
    apart = written(apart, "apart")
    centres = apart.groupBy("g").agg(F.min(F.struct("u", "v")).alias("m"))
    placed = apart.join(centres, "g").withColumn("linked", F.col("u") + F.col("m.u") <= 0)
    proven = placed.filter(F.col("linked") & (F.col("v") != F.col("m.v"))).select(F.col("m.v").alias("a"), F.col("v").alias("b"))
    outer = placed.filter(~F.col("linked")).groupBy("g").agg(F.min("u").alias("outer"))
    nearest = F.when(F.col("linked"), F.col("outer")).otherwise(F.col("m.u"))
    shared = F.greatest(F.lit(1), F.ceil((F.col("u") + nearest) / (2 * (den + num))), F.size("d") - F.floor(F.col("n") * (den - num) / num))
    tokens = placed.join(outer, "g").withColumn("shared", shared).filter(F.size("d") >= F.col("shared")).select("g", "v", "n", "shared", F.explode("d").alias("t"))
    often = tokens.groupBy("g", "t").agg(F.count("*").alias("c")).filter("c > 1")
    own = Window.partitionBy("g", "v")
    ranked = tokens.join(often, ["g", "t"]).withColumns({"size": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("c", "t"))})
    return proven, ranked.filter(F.col("rank") <= F.col("size") - F.col("shared") + 1).select(F.xxhash64("g", "t").alias("g"), "v", "n")


def links(docs: DataFrame, sketches: DataFrame, nodes: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between nodes (v, f1, n) whose closure is that of all links with Jaccard >= threshold."""
    wanted = _may_link(sketches, nodes, threshold)
    sets = written(_sets(docs, small(wanted, wanted.count(), BROADCAST_IDS), words, threshold), "sets")
    rows = written(_counted(_rarest(sets, threshold)), "buckets")
    pairs = written(_pairs(rows, threshold), "candidates")
    leads = rows.filter(F.col("members") > PAIRED).groupBy("g").agg(F.min("v").alias("lead"))
    large = rows.join(leads, "g").select("lead", "v")
    families = connected(large.select(F.col("lead").alias("a"), F.col("v").alias("b")))
    large = written(families.select("v", F.col("component").alias("g")), "large")
    edges = _verified(pairs, sets, threshold)
    while not large.isEmpty():
        proven, following = _split(large, sets, threshold)
        rows = written(_counted(written(following, "following")), "buckets")
        edges += [proven, *_verified(written(_pairs(rows, threshold), "candidates"), sets, threshold)]
        large = written(rows.filter(F.col("members") > PAIRED).select("g", "v"), "large")
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out


def near_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Returns (id, n_shingles, component_id) for every row: the smallest id reachable by links, its own included.

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, with A-Z
    lower-cased; a set is the distinct runs of `words` words, or all words if fewer. Sets link at Jaccard >= threshold.
    A text that is null or without words has an empty set, links with nothing and is its own component. Rows of equal
    sets are one component. A null id takes its set's component and is nobody's smallest id; a set that has only null
    ids links with nothing. Rows that share an id with other texts are judged by their own text. Other columns are
    not used.
    """
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sketches = written(_sketches(docs, words, threshold), "sketches")
    groups = written(sketches.filter("n > 0").groupBy("f1", "f2").agg(F.min("_id").alias("v"), F.first("n").alias("n")), "groups")
    found = written(connected(links(docs, sketches, groups.filter("v IS NOT NULL").select("v", "f1", "n"), words, threshold)), "components")
    named = groups.join(found, "v", "left").select("f1", "f2", F.coalesce("component", "v").alias("component_id"))
    return sketches.select("_id", "n", "f1", "f2").join(named, ["f1", "f2"], "left").select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))
