"""Language-model scores: a log-bilinear model over several words of context, trained by noise-contrastive estimation.

Every word seen often enough has vectors of its own, so that their number grows with the corpus; all others are dealt to
classes, which have vectors, and have their add-one share in their class. Groups of symbols make the softmax cheap. Tasks
learn from all training documents, each from its own, and are averaged by how often they have seen a symbol. Counts of
words come from all training documents; those of the most frequent are broadcast, those of the others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import pieces, raw_texts, released, written

HELD_OUT = (7, 2)
#: Words with at least LEAST training tokens have vectors, at most NAMED of them, so that a worker can hold the model.
#: All others are in CLASSES classes.
LEAST, CLASSES = 400, 255
NAMED = (1 << 16) - CLASSES - 1
#: Words of context, and the size of the vectors.
CONTEXT, VECTOR = 2, 16
#: Words whose counts every worker holds. Others are joined.
HELD_WORDS = 250_000
#: Distinct words that a counting worker gathers before it passes them on.
COUNTED_WORDS = 200_000
#: Draws of noise for a block, the first rate of a row, and the tokens of a block: a part of those seen, between bounds.
NOISE, RATE, BLOCKS = 16, 0.1, (512, 1 << 14)
#: One in WARM texts, by hash, are learnt first, so that all tasks set out from one model. A task learns from so many
#: tokens at least; where there are fewer, it goes over them as often as makes up for it, up to PASSES times.
WARM, TASK_TOKENS, PASSES = 16, 1 << 20, 32
#: Rows of a product, tokens scored at once, and rows of a table that tasks pass on together.
PRODUCT, WINDOW, ROWS = 1 << 10, 1 << 18, 1 << 10
#: The logarithm that stands for a share of 0.
NEVER = -1e4
END = b""


def held_out(id_col: str, parts: tuple[int, int] = HELD_OUT) -> Column:
    """Whether crc32 of the id as text leaves the second number by the first; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts[0] == parts[1]


def words(raw: bytes | None) -> list[bytes]:
    """The text's words with A-Z lower-cased; ASCII white space parts them."""
    return (raw or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, c) over all texts; the empty word is the end, once a text."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])

        for batch in pieces(batches, 0):
            for raw in raw_texts(batch.column(0)):
                held.update(words(raw))
                held[END] += 1
                if len(held) >= COUNTED_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The counts of the most frequent words, most frequent first, at most `most` and the end.

    A histogram over powers of the count tells from where on words are few enough; no task sorts words.
    """
    power = F.floor(F.log2("c") * 8)
    sizes = counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()
    total, least = 0, 1 << 20
    for power_, n in sizes:
        total += n
        if total > most:
            break
        least = power_
    often = counts.filter((power >= least) | (F.col("word") == F.lit(END))).toArrow()
    return dict(sorted(zip(often["word"].to_pylist(), often["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0])))


class Layout(NamedTuple):
    """Symbols: 0 the end (and what stands before a text), then CLASSES classes of words that have no vectors of their
    own, dealt by crc32, then the named words from the most frequent on. `width` symbols in a row are a group."""

    width: int
    #: Training tokens of each symbol, with one added to those that exist; padded to whole groups.
    shares: np.ndarray


def layout(tokens: np.ndarray) -> Layout:
    """The layout of symbols with so many training tokens each: about as many groups as symbols in a group."""
    width = int(np.ceil(np.sqrt(len(tokens))))
    shares = np.zeros(-(-len(tokens) // width) * width)
    shares[: len(tokens)] = tokens + 1.0
    return Layout(width, shares)


class Model:
    """A log-bilinear model: p(group | words before) times p(symbol | group, words before).

    The last CONTEXT symbols' vectors, each from its position's own table, add up to a context; its products with the
    vectors of groups, and of a group's symbols, and their biases are the logits.
    """

    def __init__(self, plan: Layout, seed: int = 11) -> None:
        rng, size, width = np.random.default_rng(seed), len(plan.shares), plan.width
        self.width = width
        of_groups = plan.shares.reshape(-1, width).sum(1)
        self.contexts = rng.normal(0, 0.1, (CONTEXT * size, VECTOR)).astype(np.float32)
        self.groups = rng.normal(0, 0.1, (size // width, VECTOR)).astype(np.float32)
        self.targets = rng.normal(0, 0.1, (size, VECTOR)).astype(np.float32)
        self.group_bias = np.log(of_groups / of_groups.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(plan.shares / np.repeat(of_groups, width)), NEVER).astype(np.float32)

    def arrays(self) -> list[np.ndarray]:
        """All that is learnt."""
        return [self.contexts, self.groups, self.targets, self.group_bias, self.bias]

    def before(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Rows of the context tables that stand before every symbol of texts that begin at `begins`."""
        size, out = len(self.targets), np.zeros((CONTEXT, len(symbols)), np.int32)
        for k in range(CONTEXT):
            out[k, k + 1 :] = symbols[: -(k + 1)]
            for j in range(k + 1):
                out[k, begins[begins + j < len(symbols)] + j] = 0
            out[k] += k * size
        return out

    def context(self, before: np.ndarray) -> np.ndarray:
        """The sum of the vectors of what stands before."""
        out = self.contexts.take(before[0], axis=0)
        for k in range(1, CONTEXT):
            out += self.contexts.take(before[k], axis=0)
        return out

    def log10(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Normalised log10 p of every symbol of texts that begin at `begins`."""
        before = self.before(symbols, begins)
        windows = [slice(at, at + WINDOW) for at in range(0, len(symbols), WINDOW)]
        return np.concatenate([np.zeros(0), *(self._window(symbols[w], before[:, w]) for w in windows)])

    def _window(self, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 p of symbols by their contexts, in products of many contexts with one group's vectors."""
        width = self.width
        own = symbols // width
        order = np.argsort(symbols.astype(np.uint16), kind="stable")
        symbols, own, before = symbols[order], own[order], before.take(order, axis=1)
        contexts = np.ones((len(order), VECTOR + 1), np.float32)
        contexts[:, :-1] = self.context(before)
        groups, found = np.c_[self.groups, self.group_bias].T, np.empty(len(order))
        for at in range(0, len(order), PRODUCT):
            found[at : at + PRODUCT] = _chosen(contexts[at : at + PRODUCT] @ groups, own[at : at + PRODUCT])
        starts = [*np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist(), len(own)]
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            first = own[begin] * width
            targets = np.c_[self.targets[first : first + width], self.bias[first : first + width]].T
            for at in range(begin, end, PRODUCT):
                upto = min(at + PRODUCT, end)
                found[at:upto] += _chosen(contexts[at:upto] @ targets, symbols[at:upto] - first)
        out = np.empty(len(order))
        out[order] = found / np.log(10)
        return out


def _chosen(logits: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Natural log of the softmax at each row's pick."""
    own = logits[np.arange(len(picks)), picks]
    with np.errstate(over="ignore", invalid="ignore"):
        sums = np.exp(logits) @ np.ones(logits.shape[1], np.float32)
    if not (np.isfinite(sums) & (sums > 0)).all():
        top = logits.max(1)
        return own - top - np.log(np.exp(logits - top[:, None]).sum(1))
    return own - np.log(sums)


class Learner:
    """Noise-contrastive estimation of a model, a block of tokens at a time; each row has its own falling rate.

    A token's group is held against NOISE groups, and its symbol against NOISE symbols of its group, that are drawn by
    their shares of the training tokens for all tokens of the block, or all of the block and group.
    """

    def __init__(self, model: Model, plan: Layout, seed: int, squares: list[np.ndarray] | None = None) -> None:
        self.model, self.plan, self.rng, self.tokens = model, plan, np.random.default_rng(seed), 0
        of_groups = plan.shares.reshape(-1, plan.width).sum(1)
        self.sums, self.group_ends = np.cumsum(plan.shares), np.r_[0.0, np.cumsum(of_groups)]
        self.group_log = np.log(NOISE * of_groups / of_groups.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.log = np.maximum(np.log(NOISE * plan.shares / np.repeat(of_groups, plan.width)), NEVER).astype(np.float32)
        #: Sums of squared slopes by row, by which rates fall.
        self.squares = squares or [np.full(len(a), 1e-6, np.float32) for a in model.arrays()]
        #: How often each symbol stood at each place of a context, and was a token itself: the weights of an average.
        self.seen = [np.zeros(len(a), np.int64) for a in model.arrays()]

    def _drawn(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """NOISE places of the running sums for each row of bounds."""
        at = low + self.rng.random((len(low), NOISE)) * (high - low)
        return np.minimum(np.searchsorted(sums, at, "right"), len(sums) - 1)

    def _step(self, k: int, rows: np.ndarray, slopes: np.ndarray) -> None:
        """Moves rows of array k along their summed slopes."""
        table = self.model.arrays()[k]
        self.squares[k][rows] += slopes * slopes if slopes.ndim == 1 else np.einsum("ij,ij->i", slopes, slopes) / VECTOR
        rate = RATE / np.sqrt(self.squares[k][rows])
        table[rows] += slopes * (rate if slopes.ndim == 1 else rate[:, None])

    def learn(self, symbols: np.ndarray, begins: np.ndarray) -> None:
        """One pass over the symbols of texts that begin at `begins`."""
        before, at = self.model.before(symbols, begins), 0
        while at < len(symbols):
            size = min(max(BLOCKS[0], self.tokens // 16), BLOCKS[1])
            self._block(symbols[at : at + size], before[:, at : at + size])
            self.tokens += size
            at += size

    def _block(self, symbols: np.ndarray, before: np.ndarray) -> None:
        m, width = self.model, self.plan.width
        order = np.argsort(symbols.astype(np.uint16), kind="stable")
        symbols, before = symbols[order], before.take(order, axis=1)
        own = symbols // width
        at_symbol = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        at_group = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        context = m.context(before)
        group_slopes, bias_slopes = np.zeros_like(m.groups), np.zeros_like(m.bias)
        target_slopes, group_bias_slopes = np.zeros_like(m.targets), np.zeros_like(m.group_bias)

        vectors = m.groups.take(own, axis=0)
        up = _sigmoid(self.group_log[own] - m.group_bias[own] - np.einsum("ij,ij->i", context, vectors))
        drawn = self._drawn(self.group_ends[1:], np.zeros((1, 1)), self.group_ends[-1:, None])[0]
        noise = m.groups[drawn]
        down = _sigmoid(context @ noise.T + (m.group_bias[drawn] - self.group_log[drawn]))
        slope = up[:, None] * vectors - down @ noise
        group_slopes[own[at_group]] = np.add.reduceat(up[:, None] * context, at_group, axis=0)
        group_bias_slopes[own[at_group]] = np.add.reduceat(up, at_group)
        np.subtract.at(group_slopes, drawn, down.T @ context)
        np.subtract.at(group_bias_slopes, drawn, down.sum(0))

        vectors = m.targets.take(symbols, axis=0)
        up = _sigmoid(self.log[symbols] - m.bias[symbols] - np.einsum("ij,ij->i", context, vectors))
        slope += up[:, None] * vectors
        target_slopes[symbols[at_symbol]] = np.add.reduceat(up[:, None] * context, at_symbol, axis=0)
        bias_slopes[symbols[at_symbol]] = np.add.reduceat(up, at_symbol)
        # noise of every group at once; only products go group by group
        here, lengths = own[at_group], np.diff(np.r_[at_group, len(own)])
        drawn = self._drawn(self.sums, self.group_ends[here, None], self.group_ends[here + 1, None])
        noise, slopes_back = m.targets[drawn], np.empty((*drawn.shape, VECTOR), np.float32)
        down = np.repeat(m.bias[drawn] - self.log[drawn], lengths, axis=0)
        parts = [slice(begin, begin + n) for begin, n in zip(at_group.tolist(), lengths.tolist(), strict=True)]
        for j, part in enumerate(parts):
            down[part] += context[part] @ noise[j].T
        down = _sigmoid(down)
        for j, part in enumerate(parts):
            slope[part] -= down[part] @ noise[j]
            np.matmul(down[part].T, context[part], out=slopes_back[j])
        np.subtract.at(target_slopes, drawn.ravel(), slopes_back.reshape(-1, VECTOR))
        np.subtract.at(bias_slopes, drawn.ravel(), np.add.reduceat(down, at_group, axis=0).ravel())

        for k, slopes, bias in ((1, group_slopes, group_bias_slopes), (2, target_slopes, bias_slopes)):
            rows = np.flatnonzero(bias)
            self._step(k, rows, slopes[rows])
            self._step(k + 2, rows, bias[rows])
        for k, rows, n in ((1, here, lengths), (2, symbols[at_symbol], np.diff(np.r_[at_symbol, len(own)]))):
            self.seen[k][rows] += n
            self.seen[k + 2][rows] += n
        for k in range(CONTEXT):
            order = np.argsort((before[k] - k * len(m.targets)).astype(np.uint16), kind="stable")
            rows = before[k, order]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            self._step(0, rows[starts], np.add.reduceat(slope.take(order, axis=0), starts, axis=0))
            self.seen[0][rows[starts]] += np.diff(np.r_[starts, len(rows)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Vocabulary:
    """Words whose counts are held, the most frequent first, the first `named` of them named; counts of classes."""

    def __init__(self, held: dict[bytes, int], named: int, class_tokens: np.ndarray) -> None:
        """class_tokens: add-one training tokens of each class, its words that no training text has counted as one."""
        listed = [w for w in held if w != END]
        self.places = {w: k for k, w in enumerate(listed)}
        self.symbols = np.array([CLASSES + 1 + k if k < named else crc32(w) % CLASSES + 1 for k, w in enumerate(listed)], np.int32)
        self.logs = np.log10(np.array([held[w] for w in listed], float) + 1)
        self.ends = held.get(END, 0)
        self.class_logs = np.r_[0.0, np.log10(class_tokens)]

    def read(self, raws: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words of texts; whether each token (words and, at every text's close, the end) is a word; the words'
        places or -1; the tokens' symbols; where the texts begin."""
        found, lengths = [], []
        for raw in raws:
            own = words(raw)
            found += own
            lengths.append(len(own) + 1)
        stops = np.cumsum(lengths)
        is_word = np.ones(int(stops[-1]), bool)
        is_word[stops - 1] = False
        places = np.fromiter(map(self.places.get, found, repeat(-1)), np.int32, len(found))
        own = self.symbols[places] if len(self.symbols) else np.zeros(len(found), np.int32)
        missed = np.flatnonzero(places < 0)
        own[missed] = [crc32(found[k]) % CLASSES + 1 for k in missed.tolist()]
        symbols = np.zeros(len(is_word), np.int32)
        symbols[is_word] = own
        return found, is_word, places, symbols, np.r_[0, stops[:-1]]


def learnt(texts: DataFrame, vocabulary: Vocabulary, plan: Layout) -> Model:
    """The model of all texts: tasks learn from their own, from where the texts of one hash in WARM have brought it."""
    model, squares, tokens = Model(plan), None, int(plan.shares.sum())
    passes = min(PASSES, max(1, TASK_TOKENS // tokens))
    spark = texts.sparkSession
    some = texts.filter(F.pmod(F.xxhash64(texts.columns[0]), F.lit(WARM)) == 0)
    for part, size in ((some, tokens // WARM), (texts, tokens)):
        part = part.coalesce(max(1, size // TASK_TOKENS))  # every task passes on a model
        shared = spark.sparkContext.broadcast((vocabulary, plan, model, squares))

        @released
        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, plan, start, squares = shared.value
            task = TaskContext.get().partitionId()
            model = Model(plan)
            for to, a in zip(model.arrays(), start.arrays(), strict=True):
                to[:] = a
            learner = Learner(model, plan, task, squares and [s.copy() for s in squares])
            kept = []
            for batch in pieces(batches, 0):
                _, _, _, symbols, begins = vocabulary.read(raw_texts(batch.column(0)))
                learner.learn(symbols, begins)
                if passes > 1:
                    kept.append((symbols, begins))
            for _ in range(1, passes):
                for symbols, begins in kept:
                    learner.learn(symbols, begins)
            yield from _passed_on(learner, task)

        found = (
            part.mapInArrow(learn, "k int, first int, task int, sums binary, squares binary, seen binary")
            .repartition("k", "first")
            .sortWithinPartitions("k", "first", "task")
            .mapInArrow(_averages, "k int, first int, sums binary, squares binary")
            .toArrow()
        )
        squares = squares or [np.full(len(a), 1e-6, np.float32) for a in model.arrays()]
        for k, first, mean, square in zip(*(found.column(c).to_pylist() for c in ("k", "first", "sums", "squares")), strict=True):
            into = model.arrays()[k][first : first + ROWS]
            into[:] = np.frombuffer(mean, np.float32).reshape(into.shape)
            squares[k][first : first + ROWS] = np.frombuffer(square, np.float32)
        shared.unpersist()
    return model


def _passed_on(learner: Learner, task: int) -> Iterator[pa.RecordBatch]:
    """A learner's rows times how often it has seen them, ROWS at a time; those never seen count as seen a little, so
    that an average over them alone is where all set out from."""
    for k, (table, squares, seen) in enumerate(zip(learner.model.arrays(), learner.squares, learner.seen, strict=True)):
        for first in range(0, len(table), ROWS):
            n = seen[first : first + ROWS].astype(np.float32)
            if not n.any():
                continue
            n = np.maximum(n, np.float32(1e-3))
            rows = table[first : first + ROWS]
            values = [[k], [first], [task], [(rows * (n if rows.ndim == 1 else n[:, None])).tobytes()], [(squares[first : first + ROWS] * n).tobytes()], [n.tobytes()]]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["k", "first", "task", "sums", "squares", "seen"])


@released
def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted averages of rows that come in the order of their tables and places; one place's sums are held at a time."""
    at, sums = None, []

    def out() -> pa.RecordBatch:
        total, squares, seen = sums
        mean = (total.reshape(len(seen), -1) / seen[:, None]).astype(np.float32)
        columns = ([at[0]], [at[1]], [mean.tobytes()], [(squares / seen).astype(np.float32).tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["k", "first", "sums", "squares"])

    for batch in batches:
        for j in range(batch.num_rows):
            place = (batch.column(0)[j].as_py(), batch.column(1)[j].as_py())
            values = [np.frombuffer(batch.column(c)[j].as_py(), np.float32).astype(np.float64) for c in (3, 4, 5)]
            if place == at:
                for total, value in zip(sums, values, strict=True):
                    total += value
            else:
                if at is not None:
                    yield out()
                at, sums = place, values
    if at is not None:
        yield out()


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: tuple[int, int] = HELD_OUT) -> DataFrame:
    """Returns the rows without their text, with held_out, n_tokens, n_known, train_tokens, base_score and score.

    Counts and model learn from the rows that are not held out. Null is an empty text, which is its end alone; a text of
    any length is scored whole. Repeated rows are scored, and counted, each by itself; equal texts score alike up to
    single precision. Without training rows every count is 0 and all symbols are as likely. Other columns stay; columns
    of the added names are replaced. The model, and so the score, depends on the parts in which the rows are read.
    """
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    spark = documents.sparkSession
    docs = documents.drop(*added).withColumn("held_out", held_out(id_col, parts))
    training = docs.filter(~F.col("held_out")).select(text_col)
    counts = written(word_counts(training), "word-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    held = frequent(counts, HELD_WORDS)
    named = [w for w, c in held.items() if w != END and c >= LEAST][:NAMED]
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in counts.filter(F.col("word") != F.lit(END)).groupBy((F.crc32("word") % CLASSES).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        class_tokens[row.k], class_words[row.k] = row.c, row.n
    for w in named:
        class_tokens[crc32(w) % CLASSES] -= held[w]
        class_words[crc32(w) % CLASSES] -= 1
    plan = layout(np.r_[held.get(END, 0), class_tokens, [held[w] for w in named]])
    vocabulary = Vocabulary(held, len(named), class_tokens + class_words + 1)
    shared = spark.sparkContext.broadcast((vocabulary, learnt(training, vocabulary, plan)))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        for batch in pieces(batches, 1):
            found, is_word, places, symbols, begins = vocabulary.read(raw_texts(batch.column(1)))
            logs, known = np.full(len(symbols), np.log10(vocabulary.ends + 1.0)), np.full(len(symbols), vocabulary.ends > 0)
            logs[is_word] = np.where(places >= 0, vocabulary.logs[places], 0.0) if len(vocabulary.logs) else 0.0
            known[is_word] = places >= 0
            classed = (symbols > 0) & (symbols <= CLASSES)
            scores = model.log10(symbols, begins)
            scores[classed] += logs[classed] - vocabulary.class_logs[symbols[classed]]
            rest = [Counter() for _ in begins]
            missed = np.flatnonzero(places < 0)
            texts = np.searchsorted(begins, np.flatnonzero(is_word)[missed], "right") - 1
            for k, text in zip(missed.tolist(), texts.tolist(), strict=True):
                rest[text][found[k]] += 1
            columns = (
                pa.array(np.diff(np.r_[begins, len(symbols)]), pa.int64()),
                pa.array(np.add.reduceat(known.astype(np.int64), begins), pa.int64()),
                pa.array(np.add.reduceat(logs, begins), pa.float64()),
                pa.array(np.add.reduceat(scores, begins), pa.float64()),
                pa.array([list(r.keys()) for r in rest], pa.list_(pa.binary())),
                pa.array([list(r.values()) for r in rest], pa.list_(pa.int32())),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_row", "n_tokens", "_known", "_base", "_model", "_words", "_times"])

    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    scored = written(
        numbered.select(F.struct("_row", *[F.col(c) for c in docs.columns if c != text_col]).alias("_row"), text_col).mapInArrow(
            run, f"_row {_struct(docs, text_col)}, n_tokens bigint, _known bigint, _base double, _model double, _words array<binary>, _times array<int>"
        ),
        "scored",
    )
    rest = scored.select(F.col("_row._row").alias("_r"), F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_r", F.col("w._words").alias("word"), F.col("w._times").alias("times"))
    sums = rest.join(counts, "word").groupBy("_r").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("_log"), F.sum(F.col("times").cast("long")).alias("_seen"))
    whole = scored.join(sums, F.col("_row._row") == F.col("_r"), "left").fillna(0, ["_log", "_seen"])
    return whole.select(
        *[F.col(f"_row.{c}").alias(c) for c in docs.columns if c != text_col],
        "n_tokens",
        (F.col("_known") + F.col("_seen")).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.col("_log") - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))).alias("base_score"),
        (F.col("_model") + F.col("_log")).alias("score"),
    )


def _struct(docs: DataFrame, text_col: str) -> str:
    return "struct<" + ", ".join(["_row: bigint", *(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)]) + ">"
