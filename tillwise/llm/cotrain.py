"""Document quality by co-training: one classifier reads the text, the other what is known of the page besides.

Each is a logistic regression on its own view; nothing is in both.  Over some rounds each labels those documents of an unlabelled
pool of which it is sure, and the other one learns from them.  The pool is a share of all documents and never leaves the
executors: every part of it fits both views from the common start, and the parts' weights are averaged.  Then both views are calibrated on labelled
rows kept apart, their log-odds are added, and other labelled rows kept apart set the threshold.  Every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.frames import per_batch, store

#: Buckets of words, of pairs of words and of what words look like; of sources, languages and both together.
WORDS, PAIRS, SHAPES = 256, 128, 64
SOURCES, LANGS, BOTH = 64, 16, 64
#: Pool rows that a part fits, words of a text that are counted together, and letters of a word that tell it.
PART_ROWS, TOGETHER, LETTERS = 2_000, 50_000, 64


def _shape(word: str) -> str:
    """What a word looks like: its kinds of characters, repeats of a kind once, and whether it is long."""
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word[:LETTERS]]
    return "".join(k for k, before in zip(kinds, ["", *kinds]) if k != before) + str(min(len(word) // 8, 3))


class Bags:
    """Buckets of words and shapes, kept per process, as most words come again."""

    def __init__(self, most: int = 50_000):
        self.most, self.known = most, {}

    def of(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            folded = word[:LETTERS].lower().strip(".,;:!?\"'()")
            found = crc32(folded.encode("utf-8", "replace")), crc32(_shape(word).encode("utf-8", "replace")) % SHAPES
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = found
        return found


_BAGS = Bags()


def content_view(text: str | None) -> np.ndarray:
    """Features of a text: which words, pairs of neighbouring words and word shapes it consists of, by hash, and how words and
    lines repeat.  The whole text counts; null counts as empty."""
    words, lines = (text or "").split(), (text or "").split("\n")
    bags = np.zeros(WORDS + PAIRS + SHAPES)
    before = 0
    for at in range(0, len(words), TOGETHER):
        codes = np.array([_BAGS.of(w) for w in words[at : at + TOGETHER]], np.int64)
        pairs = (np.concatenate([[before], codes[:-1, 0]]) * 31 + codes[:, 0]) % PAIRS
        before = codes[-1, 0]
        for start, size, places in ((0, WORDS, codes[:, 0] % WORDS), (WORDS, PAIRS, pairs), (WORDS + PAIRS, SHAPES, codes[:, 1])):
            bags[start : start + size] += np.bincount(places, minlength=size)
    n = max(len(words), 1)
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    rest = [
        np.log1p(len(words)),
        np.log1p(distinct) / np.log1p(n),
        distinct / n,
        again / n,
        np.log1p(len(text or "") / n),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(max(map(len, words), default=0)),
    ]
    return np.concatenate([np.sqrt(bags / n), rest]).astype(np.float32)


def metadata_view(source: str | None, lang: str | None) -> np.ndarray:
    """What is known about a page besides its text: source and language, alone and together; null is one of its own."""
    view = np.zeros(SOURCES + LANGS + BOTH, np.float32)
    view[crc32((source or "").encode()) % SOURCES] = 1
    view[SOURCES + crc32((lang or "").encode()) % LANGS] = 1
    view[SOURCES + LANGS + crc32(f"{source or ''}\0{lang or ''}".encode()) % BOTH] = 1
    return view


@dataclass
class Logistic:
    """Weights on standardised features, then a calibration of the log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, scale_by: np.ndarray | None = None) -> Logistic:
        """Newton's method with an L2 penalty; the intercept is not penalised.  Features are standardised as ``scale_by`` says."""
        of = x if scale_by is None else scale_by
        mean, scale = of.mean(axis=0), of.std(axis=0)
        scale = np.where(scale > 1e-6, scale, np.inf)  # a feature that never varies says nothing
        varied = np.flatnonzero(np.isfinite(scale))
        z = np.concatenate([(x - mean)[:, varied] / scale[varied], np.ones((len(x), 1))], axis=1).astype(np.float64)
        w = np.zeros(z.shape[1])
        ridge = np.full(len(w), penalty)
        ridge[-1] = 1e-3
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (weight * (p - y)) + ridge * w
            curve = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            change = np.linalg.solve(curve, slope)
            w -= change
            if np.abs(change).max() < 1e-4:
                break
        weights = np.zeros(x.shape[1] + 1)
        weights[[*varied, -1]] = w
        return Logistic(mean, scale, weights)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of quality 1."""
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit slope and shift on rows not trained on; a view that says nothing gets a slope near 0."""
        if len(set(y.tolist())) == 2:
            line = Logistic.fit(self.raw(x)[:, None], y, np.ones(len(y)))
            self.slope = float(max(0.0, line.weights[0] / line.scale[0]))
            self.shift = float(line.weights[1] - (line.weights[0] * line.mean[0] / line.scale[0] if self.slope else 0))


@dataclass
class QualityModel:
    """Both views, the prior log-odds that both contain, and the score below which a document is rejected."""

    content: Logistic
    metadata: Logistic
    prior: float
    threshold: float = 0.5

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.odds(content), self.metadata.odds(metadata)
        return tuple(1 / (1 + np.exp(-v)) for v in (a, b, np.clip(a + b - self.prior, -30, 30)))


@dataclass
class Labelled:
    """Labelled rows by what they are for: to learn from, to calibrate, to set the threshold."""

    views: tuple[np.ndarray, np.ndarray]
    label: np.ndarray

    def rows(self, purpose: int) -> np.ndarray:
        """0: three of five rows, to learn from; 1: one to calibrate; 2: one for the threshold."""
        return np.flatnonzero(np.clip(np.arange(len(self.label)) % 5 - 2, 0, 2) == purpose)

    def both_classes(self) -> bool:
        return all(len(set(self.label[self.rows(p)].tolist())) == 2 for p in (0, 1, 2))

    def fitted(self, k: int, more: np.ndarray | None = None, told: np.ndarray | None = None) -> Logistic:
        """View ``k`` on the rows to learn from and, at half their weight, ``more`` rows with the labels they were told."""
        own = self.rows(0)
        x, y, weight = self.views[k][own], self.label[own], np.ones(len(own))
        if more is not None and len(more):
            x, y = np.concatenate([x, more]), np.concatenate([y, told])
            weight = np.concatenate([weight, np.full(len(more), 0.5)])
        # One scale for all parts, so that their weights can be averaged.
        return Logistic.fit(x, y.astype(float), weight, scale_by=self.views[k][own])

    def calibrated(self, k: int, model: Logistic) -> Logistic:
        at = self.rows(1)
        model.calibrate(self.views[k][at], self.label[at].astype(float))
        return model


def confident(chance: np.ndarray, good: float, share: float, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and labels a view hands over: the ``share`` of which it is surest, in the proportion of the classes, if over ``sure``."""
    rows, labels = [], []
    for value, certain, part in ((1, chance, good), (0, 1 - chance, 1 - good)):
        best = np.argsort(-certain, kind="stable")[: ceil(share * part * len(chance))]
        best = best[certain[best] > sure]
        rows.append(best)
        labels.append(np.full(len(best), value))
    return np.concatenate(rows), np.concatenate(labels)


def exchange(labelled: Labelled, models: list[Logistic], pool: tuple[np.ndarray, np.ndarray], share: float, sure: float) -> list[Logistic]:
    """Both views fitted anew, each on what the other one is sure of in a part of the pool."""
    good, made = labelled.label[labelled.rows(0)].mean(), []
    for k in (0, 1):
        chance = 1 / (1 + np.exp(-models[1 - k].odds(pool[1 - k])))
        rows, told = confident(chance, good, share, sure)
        made.append(labelled.fitted(k, pool[k][rows], told))
    return made


def finished(labelled: Labelled, models: list[Logistic], most_good_lost: float = 0.005) -> QualityModel:
    """The views' log-odds added, and the threshold: the highest up to a half at which no more than ``most_good_lost`` of the
    good rows kept for it fall below."""
    at = labelled.rows(1)
    prior = float(np.log(labelled.label[at].mean() / (1 - labelled.label[at].mean())))
    model = QualityModel(*models, prior)
    at = labelled.rows(2)
    of_good = model.score(*(view[at] for view in labelled.views))[2][labelled.label[at] == 1]
    model.threshold = float(min(0.5, np.quantile(of_good, most_good_lost, method="lower")))
    return model


def co_train(
    content: np.ndarray, metadata: np.ndarray, label: np.ndarray, rounds: int = 3, share: float = 0.1, sure: float = 0.95
) -> QualityModel | None:
    """Co-train on rows whose ``label`` is 1, 0 or -1 (the pool, as one part); None if a class is missing."""
    known = label >= 0
    labelled = Labelled((content[known], metadata[known]), label[known])
    if not labelled.both_classes():
        return None
    models = [labelled.calibrated(k, labelled.fitted(k)) for k in (0, 1)]
    for _ in range(rounds if (~known).any() else 0):
        models = exchange(labelled, models, (content[~known], metadata[~known]), share, sure)
        models = [labelled.calibrated(k, m) for k, m in enumerate(models)]
    return finished(labelled, models)


def _viewed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
    )


def _views(docs: DataFrame) -> DataFrame:
    """``(doc_id, content, metadata)``, features as bytes; of repeated ids one row counts, the smallest by its features."""
    fields = [("doc_id", pa.int64()), ("content", pa.binary()), ("metadata", pa.binary())]

    def run(keys, texts, sources, langs) -> list:
        return [keys, [content_view(t).tobytes() for t in texts], [metadata_view(*m).tobytes() for m in zip(sources, langs)]]

    made = docs.mapInArrow(per_batch(run, pa.schema(fields), rows=512), "doc_id long, content binary, metadata binary")
    return made.groupBy("doc_id").agg(F.min(F.struct("content", "metadata")).alias("row")).select("doc_id", "row.*")


def _read(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32) for v in column])


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 3_000, pool_share: float = 0.05, rounds: int = 3, share: float = 0.1, sure: float = 0.95
) -> QualityModel | None:
    """Train on up to ``max_labelled`` labelled documents, the first by a hash of the id, and on ``pool_share`` of all others.

    Ids are picked before any text is read.  Labelled rows reach the driver as features; the pool, which grows with the table, does not:
    it is dealt by hash to parts of about ``PART_ROWS``, which fit the views; per round a mean of weights comes back.  Labels that are
    null, or contradict each other for one id, are left out; of repeated ids one row counts.  None if a class is missing.
    """
    marks = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("marked"))
        .agg(F.min("quality").cast("int").alias("low"), F.max("quality").cast("int").alias("high"))
        .where("low = high")
    )
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(
        marks, F.col("doc_id") == F.col("marked"), "left"
    ).select("doc_id", F.coalesce("low", F.lit(-1)).alias("label"))
    drawn = F.xxhash64("doc_id", F.lit("quality"))
    picked = store(ids.where("label >= 0").orderBy(drawn, "doc_id").limit(max_labelled).withColumnRenamed("doc_id", "picked"))
    known = docs.where("doc_id is not null")
    own = _viewed(known).join(F.broadcast(picked), F.col("doc_id") == F.col("picked"))  # max_labelled rows at most
    rows = sorted(_views(own.drop("picked", "label")).join(picked, F.col("doc_id") == F.col("picked")).collect(), key=lambda r: r.doc_id)
    if not rows:
        return None
    labelled = Labelled((_read(r.content for r in rows), _read(r.metadata for r in rows)), np.array([r.label for r in rows]))
    if not labelled.both_classes():
        return None
    models = [labelled.calibrated(k, labelled.fitted(k)) for k in (0, 1)]
    pool = _pool(docs, marks, drawn, pool_share)
    return _rounds(pool, labelled, models, rounds, share, sure)


def _pool(docs: DataFrame, marks: DataFrame, drawn: Column, pool_share: float) -> DataFrame:
    """``(part, doc_id, content, metadata)`` of the pool, stored; parts follow from its size."""
    chosen = _viewed(docs.where("doc_id is not null")).where(F.pmod(drawn, F.lit(1_000_000)) < int(pool_share * 1_000_000))
    views = store(_views(chosen.join(marks, F.col("doc_id") == F.col("marked"), "left_anti")))
    parts = max(1, ceil(views.count() / PART_ROWS))
    return views.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).cast("int"))


def _rounds(pool: DataFrame, labelled: Labelled, models: list[Logistic], rounds: int, share: float, sure: float) -> QualityModel:
    spark = pool.sparkSession

    def learner(sent):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("doc_id")
            part = _read(group["content"].to_pylist()), _read(group["metadata"].to_pylist())
            labelled, models = sent.value
            made = exchange(labelled, models, part, share, sure)
            total = [float(group.num_rows) * m.weights for m in made]
            return pa.table({"n": [float(group.num_rows)], "content": [total[0].tolist()], "metadata": [total[1].tolist()]})

        return run

    for _ in range(rounds):
        fitted = pool.groupBy("part").applyInArrow(
            learner(spark.sparkContext.broadcast((labelled, models))), "n double, content array<double>, metadata array<double>"
        )
        each = fitted.select("n", F.posexplode(F.concat("content", "metadata")).alias("at", "w"))
        summed = {r["at"]: r for r in each.groupBy("at").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()}
        if not summed:
            break
        mean = np.array([summed[k].w / summed[k].n for k in range(len(summed))])
        cut = len(models[0].weights)
        for model, weights in zip(models, (mean[:cut], mean[cut:])):
            model.weights = weights
        models = [labelled.calibrated(k, m) for k, m in enumerate(models)]
    return finished(labelled, models)


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``(doc_id, p_content, p_metadata, score, keep)`` for every row; ``score`` is the chance of quality 1.

    Null texts are read as empty.  Without a model (no or one-sided labels) all scores are 0.5 and all rows are kept.
    """
    fields = [("doc_id", pa.int64()), *((n, pa.float64()) for n in ("p_content", "p_metadata", "score"))]
    fields.append(("keep", pa.bool_()))

    def run(keys, texts, sources, langs) -> list:
        if model is None or not keys:
            half = [0.5] * len(keys)
            return [keys, half, half, half, [True] * len(keys)]
        content = np.stack([content_view(t) for t in texts])
        metadata = np.stack([metadata_view(*m) for m in zip(sources, langs)])
        a, b, both = model.score(content, metadata)
        return [keys, a, b, both, both >= model.threshold]

    return _viewed(docs).mapInArrow(
        per_batch(run, pa.schema(fields), rows=512),
        "doc_id long, p_content double, p_metadata double, score double, keep boolean",
    )


def keep_good(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The rows and columns of ``docs`` that the model does not reject, in one pass."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                if model is None:
                    yield part
                    continue
                at = {n: part.column(k).to_pylist() for k, n in enumerate(names) if n in ("text", "source", "lang")}
                content = np.stack([content_view(t) for t in at["text"]])
                metadata = np.stack([metadata_view(*m) for m in zip(at["source"], at["lang"])])
                yield part.filter(pa.array(model.score(content, metadata)[2] >= model.threshold))

    return docs.mapInArrow(run, schema)
