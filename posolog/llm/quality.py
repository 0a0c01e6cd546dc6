"""Quality scores by nearest-neighbour voting over latent-semantic vectors of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import mapped, pieces, raw_texts, released

#: Labelled documents of each class that the votes come from, at most: the bound of the sample.
PER_CLASS = 1000
SHAPES, WORDS = 16**3, 1 << 11
DIMS = SHAPES + WORDS + 2
#: Weights of the blocks: shapes of the text, its words, repetition.
BLOCKS = ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.5), (SHAPES + WORDS, DIMS, 0.7))
LATENT = 48
NEIGHBOURS = 15
#: Decimal places of a cosine: blocks of other shapes round sums otherwise beyond them.
PLACES = 5
#: A neighbour's vote counts as its cosine to this power.
SHARPNESS = 8
BLOCK_ROWS = 512
THRESHOLD = 0.7
HELD_OUT = (4, 2)


def _classes() -> np.ndarray:
    """One of 16 classes for each byte; letters of all scripts without case count as small ones."""
    table = np.zeros(256, np.uint16)
    for k, signs in enumerate((b" ", b"\t\n\r\x0b\x0c", bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!", b"?", b"|", b"*", b"$%", b"&#", b"()[]{}<>", b"\"'`"), start=1):
        table[list(signs)] = k
    return table


_CLASS = _classes()


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and counts of a text: triples of its runs of byte classes, hashed words, repeated neighbours."""
    codes = _CLASS[np.frombuffer(raw, np.uint8)]
    runs = codes[np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])] if len(codes) else codes
    triples = runs[:-2] * 256 + runs[1:-1] * 16 + runs[2:] if len(runs) > 2 else runs[:0]
    words = raw.lower().split()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    places, counts = np.unique(np.concatenate([triples.astype(np.int64), (hashed % np.uint64(WORDS)).astype(np.int64) + SHAPES]), return_counts=True)
    if len(hashed) < 2:
        return places, counts.astype(np.float32)
    again = np.count_nonzero(hashed[1:] == hashed[:-1]) / (len(hashed) - 1)
    return np.r_[places, DIMS - 2, DIMS - 1], np.r_[counts, (1 - again) ** 0.5, again**0.5].astype(np.float32)


def weighted(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts by idf, each block brought to its weight in length."""
    values = np.where(places < DIMS - 2, np.log1p(counts) * idf[places], counts)
    for low, high, weight in BLOCKS:
        a, b = np.searchsorted(places, (low, high))
        length = np.sqrt(np.square(values[a:b]).sum())
        if length:
            values[a:b] *= weight / length
    return values.astype(np.float32)


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in raw_texts(column)]


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each dimension is, and how many there are."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(DIMS + 1, np.int64)
        for batch in pieces(batches, 0):
            for raw in _raw(batch.column(0)):
                held[features(raw)[0]] += 1
                held[DIMS] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], ["dim", "n"])

    found = texts.mapInArrow(count, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(DIMS + 1, np.int64)
    counts[found["dim"].to_numpy()] = found["n"].to_numpy()
    return counts[:DIMS], int(counts[DIMS])


def held_out(id_col: str, parts: tuple[int, int] = HELD_OUT) -> Column:
    """Whether crc32 of the id as text leaves the second number by the first; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts[0] == parts[1]


class Votes:
    """The fitted model: idf, the latent basis, the labelled vectors and their labels, and the share of label 1."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, share: float):
        self.idf, self.basis, self.vectors, self.labels, self.share = idf, basis, vectors, labels, share

    def latent(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(found), self.basis.shape[1]), np.float32)
        for row, (places, counts) in zip(out, found, strict=True):
            row[:] = weighted(places, counts, self.idf) @ self.basis[places]
        return _unit(out)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of a block of texts; one without a direction gets the share of label 1.

        Cosines are rounded; labelled documents as near as the last of the NEIGHBOURS vote too, in whatever order they are.
        """
        if not len(self.labels):
            return np.full(len(texts), self.share)
        near = np.round(self.latent([features(t) for t in texts]) @ self.vectors.T, PLACES)
        least = np.partition(near, -min(NEIGHBOURS, near.shape[1]), axis=1)[:, -min(NEIGHBOURS, near.shape[1])]
        votes = np.where(near >= least[:, None], np.maximum(near, 0), 0).astype(np.float64) ** SHARPNESS
        total = votes.sum(1)
        return np.where(total > 0, votes @ self.labels / np.where(total > 0, total, 1), self.share)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _basis(rows: np.ndarray, latent: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors by a randomised range finder with power steps."""
    rng = np.random.default_rng(seed)
    drawn = rows @ rng.standard_normal((rows.shape[1], min(latent + 16, *rows.shape)), dtype=np.float32)
    for _ in range(3):
        drawn = rows @ (rows.T @ np.linalg.qr(drawn)[0])
    _, _, right = np.linalg.svd(np.linalg.qr(drawn)[0].T @ rows, full_matrices=False)
    return np.ascontiguousarray(right[:latent].T, np.float32)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, parts: tuple[int, int] = HELD_OUT) -> Votes:
    """Document counts over all documents, and up to per_class labelled ones of each class, those of the smallest hash.

    Labels of held-out ids and null or other labels than 0 and 1 are not read; an id labelled twice counts by its
    smallest label. Without labelled documents every score is 0.5.
    """
    counts, n = document_counts(documents.select(text_col))
    idf = np.log((1 + n) / (1 + counts)).astype(np.float32) + 1
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col, parts)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    share = known.agg(F.avg("_label")).first()[0]
    drawn = None
    for label in (0, 1):
        some = known.filter(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        drawn = some if drawn is None else drawn.union(some)

    @released
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = [features(raw) for raw in _raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tolist() for p, _ in found], pa.list_(pa.int32())), pa.array([c.tolist() for _, c in found], pa.list_(pa.float32()))], ["label", "places", "counts"])

    labelled = documents.join(F.broadcast(drawn), documents[id_col] == F.col("_id")).select(F.col("_label").cast("int").alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("text <> ''").orderBy(F.xxhash64("text"), "label").limit(2 * per_class)
    got = labelled.mapInArrow(sample, "label int, places array<int>, counts array<float>").toArrow()
    places, values = got["places"].to_pylist(), got["counts"].to_pylist()
    if not places:
        return Votes(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5 if share is None else float(share))
    rows = np.zeros((len(places), DIMS), np.float32)
    for row, p, c in zip(rows, places, values, strict=True):
        at = np.array(p)
        row[at] = weighted(at, np.array(c, np.float32), idf)
    basis = _basis(rows, LATENT)
    return Votes(idf, basis, _unit(rows @ basis), got["label"].to_numpy().astype(np.float64), float(share))


def score_quality(documents: DataFrame, votes: Votes, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0) to every row.

    Null is an empty text; a text without features gets the labels' mean. Equal texts, of repeated rows too, have equal
    scores. Other columns stay, whatever their names; columns of the added names are replaced.
    """
    held = documents.sparkSession.sparkContext.broadcast(votes)

    def work(column: pa.Array) -> list[pa.Array]:
        scores = [held.value.score(_raw(column.slice(k, BLOCK_ROWS))) for k in range(0, len(column), BLOCK_ROWS)]
        return [pa.array(np.round(np.clip(np.concatenate(scores), 0, 1), 9), pa.float64())]

    scored = mapped(documents.drop("predicted"), text_col, [("score", "double")], work)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
