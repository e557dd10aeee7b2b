"""Documents scored by masked pseudo-likelihood.

A small network predicts a word from the words on both sides of it.  A document's score is the sum, over all its words, of
the log-probability of the word given its neighbours.  The vocabulary comes from counts over all documents and grows with
them; a word outside it has the probability that such a word stands there, times that of its spelling, by byte counts over all such words.  The
network is trained on masked positions of all documents, dealt to parts by hash, and the parts' weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.frames import store

#: Ids of words outside the vocabulary and of places before and after a text.
UNKNOWN, OUTSIDE = 0, 1
#: Words scored at once; models averaged in one task; training positions of a part, and words of a text that are masked together.
SCORED, AVERAGED, POSITIONS, MASKED_TOGETHER = 16_384, 16, 400_000, 65_536
#: Contexts of the spelling model, its symbols (bytes and the end of a word), and how many counts the bytes' own frequency stands for.
CONTEXTS, SYMBOLS, SMOOTH = 1_024, 257, 2.0


@dataclass(frozen=True)
class Shape:
    """Vocabulary of ``classes * each`` ids; ``side`` words on either side are seen."""

    classes: int = 64
    each: int = 64
    side: int = 2
    dim: int = 16
    hidden: int = 32

    @staticmethod
    def for_corpus(total: int) -> Shape:
        """The vocabulary grows with the square root of the number of words, in as many classes as words in each."""
        classes = max(64, ceil(total**0.25))
        return Shape(classes, classes)

    @property
    def size(self) -> int:
        return self.classes * self.each

    def parts(self) -> list[tuple[int, ...]]:
        return [
            (self.size, self.dim),
            (2 * self.side * self.dim, self.hidden),
            (self.hidden,),
            (self.hidden, self.classes),
            (self.classes,),
            (self.size, self.hidden),
            (self.size,),
        ]


class WindowNet:
    """Probability of a word: that of its class given the neighbours, times its own within the class."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat, self.arrays, at = shape, flat, [], 0
        for part in shape.parts():
            count = int(np.prod(part))
            self.arrays.append(flat[at : at + count].reshape(part))
            at += count
        self.emb, self.mix, self.bias, self.by_class, self.class_bias, self.by_word, self.word_bias = self.arrays

    @staticmethod
    def fresh(shape: Shape, counts: np.ndarray, seed: int = 5) -> WindowNet:
        """Random weights; the biases start at the corpus frequencies of classes and words."""
        rng = np.random.default_rng(seed)
        net = WindowNet(shape, np.zeros(sum(int(np.prod(p)) for p in shape.parts()), np.float32))
        net.emb[:] = rng.normal(0, 0.3, net.emb.shape)
        net.mix[:] = rng.normal(0, len(net.mix) ** -0.5, net.mix.shape)
        net.by_class[:] = rng.normal(0, 0.1, net.by_class.shape)
        net.by_word[:] = rng.normal(0, 0.1, net.by_word.shape)
        smooth = counts.astype(np.float64).reshape(shape.classes, shape.each) + 0.5
        net.class_bias[:] = np.log(smooth.sum(axis=1) / smooth.sum())
        net.word_bias[:] = np.log(smooth / smooth.sum(axis=1, keepdims=True)).ravel()
        return net

    def log_chances(self, around: np.ndarray, words: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each of ``words`` given its row of ``around``; ``tables`` are those of ``lookups``."""
        hidden = np.tanh(sum(table.take(around[:, k], axis=0) for k, table in enumerate(tables)) + self.bias)
        own = words // self.shape.each
        result = _log_chance(hidden @ self.by_class + self.class_bias, own)
        for c, rows in _grouped(own):
            span = slice(c * self.shape.each, (c + 1) * self.shape.each)
            logits = hidden[rows] @ self.by_word[span].T + self.word_bias[span]
            result[rows] += _log_chance(logits, words[rows] % self.shape.each)
        return result

    def lookups(self) -> list[np.ndarray]:
        """What each word contributes to the hidden layer from each place around."""
        return [self.emb @ part for part in np.split(self.mix, 2 * self.shape.side)]

    def gradient(self, around: np.ndarray, words: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of a batch and its gradient, laid out as ``flat``."""
        n, shape = len(words), self.shape
        out = WindowNet(shape, np.zeros_like(self.flat))
        seen = self.emb[around].reshape(n, -1)
        hidden = np.tanh(seen @ self.mix + self.bias)
        own = words // shape.each
        logs = _log_softmax(hidden @ self.by_class + self.class_bias)
        loss = -float(logs[np.arange(n), own].sum())
        error = np.exp(logs)
        error[np.arange(n), own] -= 1
        out.by_class[:], out.class_bias[:] = hidden.T @ error, error.sum(axis=0)
        back = error @ self.by_class.T
        for c, rows in _grouped(own):
            span = slice(c * shape.each, (c + 1) * shape.each)
            logs = _log_softmax(hidden[rows] @ self.by_word[span].T + self.word_bias[span])
            inside = words[rows] % shape.each
            loss -= float(logs[np.arange(len(rows)), inside].sum())
            error = np.exp(logs)
            error[np.arange(len(rows)), inside] -= 1
            out.by_word[span], out.word_bias[span] = error.T @ hidden[rows], error.sum(axis=0)
            back[rows] += error @ self.by_word[span]
        back *= 1 - hidden**2
        out.mix[:], out.bias[:] = seen.T @ back, back.sum(axis=0)
        np.add.at(out.emb, around.ravel(), (back @ self.mix.T).reshape(-1, shape.dim))
        return loss / n, out.flat / n


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def _log_chance(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-softmax of one column per row; ``logits`` is used up."""
    logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(chosen)), chosen].astype(np.float64)
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the rows that have it."""
    order = np.argsort(keys, kind="stable")
    values, starts = np.unique(keys[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, starts[1:]))


class Adam:
    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.t = flat, rate, 0
        self.first, self.second = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.01 * (gradient * gradient - self.second)
        rate = self.rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        self.flat -= rate * self.first / (np.sqrt(self.second) + 1e-8)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, one after another, and the number of words of each text."""
    trimmed = pc.ascii_trim_whitespace(texts.fill_null(""))
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, pa.string()), trimmed))
    return lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()


def word_counts(docs: DataFrame, text: str = "text", rows: int = 1_000) -> DataFrame:
    """``(word, n)`` over all documents; counted per ``rows`` documents, then per map task, before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                counted = pc.value_counts(split_words(batch.column(0).slice(start, rows))[0])
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], schema=schema)

    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def encoded(texts: pa.Array, vocabulary: pa.Array) -> list[np.ndarray]:
    """Ids of the words of each text; ``vocabulary`` holds the words whose ids begin at 2."""
    words, sizes = split_words(texts)
    found = pc.index_in(words, vocabulary).fill_null(UNKNOWN - 2).to_numpy().astype(np.int32) + 2
    return np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else []


def neighbours(words: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """Ids around each position: ``side`` before and ``side`` after."""
    padded = np.concatenate([np.full(side, OUTSIDE, np.int32), words, np.full(side, OUTSIDE, np.int32)])
    offsets = [k for k in range(2 * side + 1) if k != side]
    return padded[at[:, None] + offsets]


class Spelling:
    """Probability of a word outside the vocabulary among all such words: byte by byte, each given the two before it."""

    def __init__(self, counts: np.ndarray):
        """``counts`` of symbols per context."""
        whole = counts.sum(axis=0) + 1.0
        chance = (counts + SMOOTH * whole / whole.sum()) / (counts.sum(axis=1, keepdims=True) + SMOOTH)
        self.logs = np.log(chance)

    @staticmethod
    def symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and symbols of all words, their ends included, and the place where each word begins."""
        words = words.cast(pa.string())
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
        starts = offsets[:-1] - offsets[0] + np.arange(len(words))
        symbols = np.full(len(data) + len(words), SYMBOLS - 1, np.int64)
        ends = np.append(starts[1:], len(symbols)) - 1
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = data
        one = np.concatenate([[0], symbols[:-1] + 1])
        two = np.concatenate([[0, 0], symbols[:-2] + 1])[: len(symbols)]
        one[starts] = 0  # before a word stands nothing
        two[starts] = 0
        second = starts + 1
        two[second[second < len(symbols)]] = 0
        return (two * 263 + one * 31) % CONTEXTS, symbols, starts

    def log_chances(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.empty(0)
        contexts, symbols, starts = self.symbols(words)
        return np.add.reduceat(self.logs[contexts, symbols], starts)

    @staticmethod
    def counted(words: DataFrame) -> Spelling:
        """From ``words(word, n)``; summed per task, then by Spark: at most ``CONTEXTS * SYMBOLS`` rows reach the driver."""
        schema = pa.schema([("place", pa.int32()), ("n", pa.float64())])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(CONTEXTS * SYMBOLS)
            for batch in batches:
                if batch.num_rows:
                    contexts, symbols, starts = Spelling.symbols(batch.column(0))
                    n = np.repeat(batch.column(1).to_numpy(), np.diff(np.append(starts, len(symbols))))
                    table += np.bincount(contexts * SYMBOLS + symbols, weights=n, minlength=len(table))
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(table[some])], schema=schema)

        rows = words.select("word", "n").mapInArrow(run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(CONTEXTS * SYMBOLS)
        counts[rows["place"].to_numpy()] = rows["n"].to_numpy()
        return Spelling(counts.reshape(CONTEXTS, SYMBOLS))


@dataclass
class PseudoLm:
    shape: Shape
    words: list[str]
    flat: np.ndarray
    spelling: Spelling


def _averaged(parts: DataFrame) -> tuple[np.ndarray, float] | None:
    """Mean of the models in ``parts(part, weight, model)`` by weight; at most ``AVERAGED`` meet in a task or the driver."""
    schema = pa.schema([("part", pa.int64()), ("weight", pa.float64()), ("model", pa.binary())])

    def mean(rows) -> tuple[float, np.ndarray]:
        total = sum(w for w, _ in rows)
        return total, sum((np.frombuffer(m, np.float32) * np.float32(w / total) for w, m in rows))

    def run(group: pa.Table) -> pa.Table:
        total, model = mean(list(zip(group["weight"].to_pylist(), group["model"].to_pylist())))
        part = group["part"][0].as_py() // AVERAGED
        return pa.Table.from_pydict({"part": [part], "weight": [total], "model": [model.tobytes()]}, schema=schema)

    parts = store(parts)
    while (count := parts.agg(F.max("part")).first()[0]) is not None and count >= AVERAGED:
        grouped = parts.groupBy(F.expr(f"part div {AVERAGED}"))
        parts = store(grouped.applyInArrow(run, "part long, weight double, model binary"))
    rows = [(r.weight, bytes(r.model)) for r in parts.orderBy("part").collect()]
    return mean(rows)[::-1] if rows else None


def examples(
    docs: DataFrame, words: list[str], parts: int, id_column: str, text: str, side: int, rounds: int, masked: float
) -> DataFrame:
    """``(round, part, place, around, target)``: masked positions of every document, as arrays of ids in bytes.

    Each round masks a share ``masked`` of the positions, no position twice, by draws that depend on the id and text alone.
    Stretches of ``MASKED_TOGETHER`` words are dealt to parts by hash, so a part is bounded and the same however the table is cut.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words)
    fields = [("round", pa.int32()), ("part", pa.int64()), ("place", pa.int64()), ("around", pa.binary()), ("target", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(sent.value, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some, columns = batch.slice(start, 256), [[] for _ in fields]
                for seed, ids in zip(some.column(0).to_pylist(), encoded(some.column(1), vocabulary)):
                    for stretch in range(0, len(ids), MASKED_TOGETHER):
                        place = int(np.int64((seed + stretch * 0x9E3779B1) % (1 << 63)))
                        rng = np.random.default_rng(place)
                        draw = rng.random(min(MASKED_TOGETHER, len(ids) - stretch))
                        part = int(rng.integers(parts))
                        for k in range(rounds):
                            at = stretch + np.flatnonzero((draw >= k * masked) & (draw < (k + 1) * masked))
                            if len(at):
                                row = (k, part, place, neighbours(ids, at, side).tobytes(), ids[at].tobytes())
                                for column, value in zip(columns, row):
                                    column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, (_, f) in zip(columns, fields)], schema=schema)

    body = F.col(text).cast("string")
    seed = F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.substring(body, 1, 64))
    return docs.select(F.pmod(seed, F.lit((1 << 62) - 1)), body).mapInArrow(
        run, "round int, part long, place long, around binary, target binary"
    )


def fit(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    shape: Shape | None = None,
    rounds: int = 2,
    masked: float = 0.06,
    batch: int = 4_096,
    rate: float = 0.02,
) -> PseudoLm:
    """Vocabulary, spelling and network of a corpus.

    The ``shape.size - 2`` most frequent words of all documents get ids in the order of their counts; unless a shape is given, the
    vocabulary grows with the corpus.  In each round every part of the positions trains from the common weights, and the parts'
    weights are averaged by their numbers of positions; so all documents take part at every size, and the result does not depend on how
    the table is partitioned.  ``rounds * masked`` of all positions are trained on, each once.
    """
    counts = store(word_counts(docs, text))
    total = counts.agg(F.sum("n")).first()[0] or 0
    shape = shape or Shape.for_corpus(total)
    top = counts.orderBy(F.col("n").desc(), "word").limit(shape.size - 2).collect()
    words = [r.word for r in top]
    seen = np.zeros(shape.size)
    seen[2 : len(top) + 2] = [r.n for r in top]
    seen[UNKNOWN] = total - seen.sum()
    rest = counts
    if top:
        last = top[-1]
        rest = counts.where((F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("word") > last.word)))
    spelling = Spelling.counted(rest)
    flat = WindowNet.fresh(shape, seen).flat
    parts = max(1, ceil(total * masked / POSITIONS))
    held = store(examples(docs, words, parts, id_column, text, shape.side, rounds, masked))
    schema = pa.schema([("part", pa.int64()), ("weight", pa.float64()), ("model", pa.binary())])

    def learner(sent, k: int):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([("place", "ascending"), ("target", "ascending"), ("around", "ascending")])
            read = lambda name: np.frombuffer(b"".join(group[name].to_pylist()), np.int32)
            target, around = read("target"), read("around").reshape(-1, 2 * shape.side)
            net = WindowNet(shape, sent.value.copy())
            adam, order = Adam(net.flat, rate / (k + 1)), np.random.default_rng(k).permutation(len(target))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                adam.step(net.gradient(around[pick], target[pick])[1])
            columns = {"part": [group["part"][0].as_py()], "weight": [float(len(target))], "model": [net.flat.tobytes()]}
            return pa.Table.from_pydict(columns, schema=schema)

        return run

    for k in range(rounds):
        learn = learner(docs.sparkSession.sparkContext.broadcast(flat), k)
        mine = held.where(F.col("round") == k).drop("round")
        found = _averaged(mine.groupBy("part").applyInArrow(learn, "part long, weight double, model binary"))
        flat = found[0] if found else flat
    return PseudoLm(shape, words, flat, spelling)


def score(docs: DataFrame, model: PseudoLm, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, n_unknown, log_likelihood, mean_log_likelihood)`` per row, over all words of its text.

    ``n_unknown`` of the words are outside the vocabulary; their spelling is part of the sum.  Null texts and texts without words have no tokens, a sum of 0 and a null mean.  Repeated rows come out repeatedly.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())]
    schema = pa.schema([*fields, ("log_likelihood", pa.float64()), ("mean_log_likelihood", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, vocabulary = sent.value.shape, pa.array(sent.value.words, pa.string())
        net = WindowNet(shape, sent.value.flat)
        tables = net.lookups()

        def scored(rows: list[np.ndarray]) -> np.ndarray:
            """Sums for some texts: all their words at once, long texts in several goes."""
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            words = np.concatenate(rows)
            sums = np.zeros(len(rows))
            gap = np.full(shape.side, OUTSIDE, np.int32)
            padded = np.concatenate([gap, *[x for r in rows for x in (r, gap)]])
            place = np.arange(len(words)) + shape.side * owner
            offsets = [k for k in range(2 * shape.side + 1) if k != shape.side]
            for at in range(0, len(words), SCORED):
                span = slice(at, at + SCORED)
                around = padded[place[span, None] + offsets]
                sums += np.bincount(
                    owner[span], net.log_chances(around, words[span], tables), minlength=len(rows)
                )
            return sums

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                words, sizes = split_words(part.column(1))
                found = pc.index_in(words, vocabulary).fill_null(UNKNOWN - 2).to_numpy().astype(np.int32) + 2
                rows = np.split(found, np.cumsum(sizes)[:-1])
                strange = np.flatnonzero(found == UNKNOWN)
                coded = words.take(pa.array(strange)).dictionary_encode()
                spelt = sent.value.spelling.log_chances(coded.dictionary)[coded.indices.to_numpy()]
                owner = np.repeat(np.arange(len(sizes)), sizes)[strange]
                sums = scored(rows) + np.bincount(owner, weights=spelt, minlength=len(rows))
                sizes = sizes.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array([int((r == UNKNOWN).sum()) for r in rows], pa.int64()),
                        pa.array(sums, pa.float64()),
                        pa.array([s / n if n else None for s, n in zip(sums.tolist(), sizes)], pa.float64()),
                    ],
                    schema=schema,
                )

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string")).mapInArrow(
        run, "id long, n_tokens long, n_unknown long, log_likelihood double, mean_log_likelihood double"
    )
