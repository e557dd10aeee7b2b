from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwise.llm import cotrain, langid, pseudolm
from tillwise.llm.queries import QUERIES


# --- languages


def test_network_gradients():
    net = langid.ByteNet.fresh(["a", "b"], seed=1)
    for name in ("emb", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    net.filters = {w: f.astype(float) for w, f in net.filters.items()}
    net.biases = {w: b.astype(float) for w, b in net.biases.items()}
    windows = np.random.default_rng(0).integers(97, 123, (4, langid.WINDOW))
    target = np.array([0, 1, 1, 0])
    _, gradients = net.step(windows, target)
    for array, gradient in zip(net.arrays(), gradients):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        array[at] += 1e-5
        up, _ = net.step(windows, target)
        array[at] -= 2e-5
        down, _ = net.step(windows, target)
        array[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(gradient[at], rel=1e-4)


def test_tables_give_the_network():
    net = langid.ByteNet.fresh(["a", "b", "c"], seed=2)
    windows = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    logs = langid.log_chances(net, net.tables(), windows)
    for k in range(3):
        loss, _ = net.step(windows.astype(np.int64), np.full(5, k))
        assert loss == pytest.approx(-logs[:, k].mean(), rel=1e-4)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 253, 254, 255, 256, 257, 509, 510, 5000])
def test_windows_cover_the_text(size):
    data = bytes(random.Random(size).choices(range(1, 128), k=size))
    windows, fresh = langid.windows_of(data.decode())
    assert windows.shape[1] == langid.WINDOW and fresh.sum() == max(size, 1)
    for width in (1, 2, 3, 4):
        for at in range(0, size - width + 1, 7):
            assert any(data[at : at + width] in w.tobytes() for w in windows)


def test_language_query(spark, data):
    got = QUERIES["op5_language_id"](spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = got.join(docs, "doc_id").select("doc_id", "held_out", "lang", "lang_pred", "score").collect()
    from zlib import crc32

    assert len(rows) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in unseen) >= 0.9 * len(unseen)


def test_language_of_odd_rows(spark, odd, none):
    net = langid.fit(odd)
    assert net.langs == ["en"]
    got = {r.id: r for r in langid.predict(odd, net).collect()}
    assert {k: got[k].lang_pred for k in range(6)} == {0: "en", 1: "en", **dict.fromkeys((2, 3, 4, 5), "und")}
    assert got[2].score == 0 and got[0].score == 1
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(none, net).count() == 0


# --- quality


def test_co_training_learns_from_the_other_view():
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 3000)
    content = rng.normal(size=(3000, 6)) + 1.6 * label[:, None]
    metadata = rng.normal(size=(3000, 4)) + 1.2 * label[:, None]
    shown = np.where(np.arange(3000) < 120, label, -1)
    model = cotrain.co_train(content, metadata, shown)
    a, b, both = model.score(content[1000:], metadata[1000:])
    right = lambda p: ((p > 0.5) == label[1000:]).mean()
    assert right(both) >= max(right(a), right(b)) - 0.005 and right(both) > 0.95
    assert cotrain.co_train(content, metadata, np.full(3000, -1)) is None
    assert cotrain.co_train(content, metadata, np.where(shown == 0, -1, shown)) is None


def test_a_view_that_says_nothing_does_no_harm():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 2000)
    content, metadata = rng.normal(size=(2000, 5)) + 2 * label[:, None], rng.normal(size=(2000, 8))
    model = cotrain.co_train(content, metadata, np.where(np.arange(2000) < 800, label, -1))
    assert ((model.score(content, metadata)[2] > 0.5) == label).mean() > 0.97


def test_quality_query(spark, data):
    rows = QUERIES["op9_quality"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_fit_is_co_training_of_the_parts(spark, data, monkeypatch):
    """With all other documents as one part of the pool the model is that of plain co-training; parts change little."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id % 2 = 0 or lang <> 'en'")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    marks = {r.doc_id: r.quality for r in labels.where("doc_id % 3 > 0").collect()}
    label = np.array([marks.get(r.doc_id, -1) for r in rows])
    content = np.stack([cotrain.content_view(r.text) for r in rows])
    metadata = np.stack([cotrain.metadata_view(r.source, r.lang) for r in rows])
    want = cotrain.co_train(content, metadata, label, rounds=2)
    got = cotrain.fit(docs.repartition(5), labels.where("doc_id % 3 > 0"), pool_share=1.0, rounds=2)
    assert (label < 0).sum() > 20
    for a, b in ((want.content, got.content), (want.metadata, got.metadata)):
        assert np.allclose(a.weights, b.weights, atol=1e-6) and a.slope == pytest.approx(b.slope)
    assert want.threshold == pytest.approx(got.threshold)
    monkeypatch.setattr(cotrain, "PART_ROWS", 10)
    several = cotrain.fit(docs, labels.where("doc_id % 3 > 0"), pool_share=1.0, rounds=2)
    near = np.abs(several.score(content, metadata)[2] - want.score(content, metadata)[2])
    assert np.median(near) < 0.05


def test_rows_that_learn_calibrate_and_decide_are_apart():
    rows = cotrain.Labelled((np.zeros((23, 1)),) * 2, np.arange(23) % 2)
    sets = [set(rows.rows(p).tolist()) for p in (0, 1, 2)]
    assert set.union(*sets) == set(range(23)) and sum(map(len, sets)) == 23 and len(sets[0]) > 12


def test_content_view_counts_whole_texts():
    once, long = cotrain.content_view("good words of a text"), cotrain.content_view("good words of a text " * 30_000)
    bags = cotrain.WORDS + cotrain.PAIRS + cotrain.SHAPES
    assert np.abs(once[:bags] - long[:bags]).max() < 0.5 and once[: cotrain.WORDS].sum() == pytest.approx(long[: cotrain.WORDS].sum())
    assert not np.allclose(cotrain.content_view("junk ||| junk"), once)
    assert cotrain.content_view(None).shape == cotrain.content_view("").shape == once.shape


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(0, 1, 0), (0, 0, 0), (1, 1, 0), (None, 1, 0), (5, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int"
    )
    assert cotrain.fit(odd, labels) is None
    got = cotrain.score(odd, None).collect()
    assert len(got) == odd.count() and all(r.keep and r.score == 0.5 for r in got)
    views = [(cotrain.content_view(r.text), cotrain.metadata_view(r.source, r.lang)) for r in odd.collect()]
    label = np.array([0, 1, 0, 1, 0, 1, 1, 1, 0, 1, 0, 1])
    model = cotrain.co_train(*(np.stack(v) for v in zip(*views)), label)
    assert cotrain.score(odd, model).count() == odd.count()
    kept = cotrain.keep_good(odd, model)
    keep = {(r.doc_id, r.keep) for r in cotrain.score(odd, model).collect()}
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {k for k, yes in keep if yes}
    assert cotrain.keep_good(none, model).count() == cotrain.score(none, model).count() == 0


# --- pseudo-likelihood


def test_window_network():
    shape = pseudolm.Shape(4, 4, 2, 3, 5)
    net = pseudolm.WindowNet.fresh(shape, np.ones(16))
    net = pseudolm.WindowNet(shape, net.flat.astype(float))
    rng = np.random.default_rng(0)
    around, words = rng.integers(0, 16, (30, 4)), rng.integers(0, 16, 30)
    loss, gradient = net.gradient(around, words)
    assert -net.log_chances(around, words, net.lookups()).mean() == pytest.approx(loss)
    every = [net.log_chances(around[:1], np.array([w]), net.lookups())[0] for w in range(16)]
    assert np.exp(every).sum() == pytest.approx(1)
    for i in rng.integers(0, len(gradient), 40):
        net.flat[i] += 1e-5
        up, _ = net.gradient(around, words)
        net.flat[i] -= 2e-5
        down, _ = net.gradient(around, words)
        net.flat[i] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(gradient[i], abs=1e-7)


def test_words_are_split_at_ascii_space():
    words, sizes = pseudolm.split_words(pa.array([" a  b\n", "", None, " ", "c\xa0d"]))
    assert words.to_pylist() == ["a", "b", "c\xa0d"] and sizes.tolist() == [2, 0, 0, 0, 1]


def test_likelihood_prefers_what_the_corpus_is_like(spark):
    random.seed(2)
    one, two = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    texts = [" ".join(random.choices(random.choice((one, two)), k=80)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    model = pseudolm.fit(docs, shape=pseudolm.Shape(8, 8, 2, 8, 16), masked=0.5, rounds=4, batch=256)
    mixed = [" ".join(random.choices(one + two, k=80)) for _ in range(50)]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(mixed)] + [(1, texts[0])], "doc_id long, text string")
    got = pseudolm.score(docs.limit(50).unionByName(more), model).collect()
    mean = lambda rows: np.mean([r.mean_log_likelihood for r in rows])
    assert mean([r for r in got if r.id < 1000]) > mean([r for r in got if r.id >= 1000]) + 0.2
    assert all(r.n_tokens == 80 and r.log_likelihood == pytest.approx(80 * r.mean_log_likelihood) for r in got)


def plain_spelling(model, word):
    """Log-probability of a spelling, byte by byte."""
    before, total = (0, 0), 0.0
    for symbol in [*word.encode(), pseudolm.SYMBOLS - 1]:
        context = (before[0] * 263 + before[1] * 31) % pseudolm.CONTEXTS
        total += model.spelling.logs[context, symbol]
        before = (before[1], symbol + 1)
    return total


def plain_score(model, text):
    net = pseudolm.WindowNet(model.shape, model.flat)
    number = {w: k + 2 for k, w in enumerate(model.words)}
    words = (text or "").split()
    ids = np.array([number.get(w, pseudolm.UNKNOWN) for w in words], np.int32)
    total = sum(plain_spelling(model, w) for w in words if w not in number)
    side = model.shape.side
    for k in range(len(ids)):
        around = [ids[j] if 0 <= j < len(ids) else pseudolm.OUTSIDE for j in range(k - side, k + side + 1) if j != k]
        total += float(net.log_chances(np.array([around]), ids[k : k + 1], net.lookups())[0])
    return total


def test_scores_are_sums_over_all_words(spark):
    texts = ["x y z " * 300, "x", None, "rare words hère that x y nobody knows", "x rare", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pseudolm.fit(docs, shape=pseudolm.Shape(2, 3, 1, 3, 4), rounds=1)
    got = {r.id: r for r in pseudolm.score(docs, model).collect()}
    for k, text in enumerate(texts):
        assert got[k].log_likelihood == pytest.approx(plain_score(model, text), rel=1e-5, abs=1e-5)
        assert got[k].n_tokens == len((text or "").split())
        assert got[k].n_unknown == sum(w not in model.words for w in (text or "").split())
    assert got[2].mean_log_likelihood is None and got[3].n_unknown >= 5


def test_query_against_plain_scores(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = pseudolm.fit(docs)
    got = {r.doc_id: r for r in QUERIES["op2_lm_scores"](spark, data).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in [r for r in rows if len(r.text.split()) < 400][:12]:
        assert got[r.doc_id].log_likelihood == pytest.approx(plain_score(model, r.text), rel=1e-4)
    assert all(r.log_likelihood < 0 for r in got.values() if r.n_tokens)


def test_spellings_are_a_distribution(spark):
    words = spark.createDataFrame([("ab", 3), ("abc", 2), ("é", 1), ("b", 4)], "word string, n long")
    spelling = pseudolm.Spelling.counted(words.repartition(3))
    assert np.exp(spelling.logs).sum(axis=1) == pytest.approx(np.ones(pseudolm.CONTEXTS))
    likely, strange = spelling.log_chances(pa.array(["ab", "zq"]))
    assert likely > strange + 3
    assert spelling.log_chances(pa.array([], pa.string())).tolist() == []


def test_result_does_not_depend_on_the_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one, other = (pseudolm.fit(d, shape=pseudolm.Shape(16, 16, 2, 8, 8)) for d in (docs.coalesce(1), docs.repartition(7, "n_chars")))
    assert one.words == other.words and np.allclose(one.flat, other.flat, atol=1e-5)
    assert np.allclose(one.spelling.logs, other.spelling.logs)


def test_rounds_mask_different_positions(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(1000 * k))) for k in range(4)] * 2, "doc_id long, text string")
    words = [f"w{j}" for j in range(3000)]
    made = pseudolm.examples(docs.dropDuplicates(), words, 3, "doc_id", "text", 2, 4, 0.25).collect()
    seen = sorted((r.place, i) for r in made for i in np.frombuffer(r.target, np.int32))
    assert len(seen) == len(set(seen)) == 6000 and {r.part for r in made} <= {0, 1, 2}


def test_vocabulary_grows_with_the_corpus():
    sizes = [pseudolm.Shape.for_corpus(n).size for n in (0, 10**6, 10**8, 10**10)]
    assert sizes == sorted(sizes) and sizes[0] == 4096 and sizes[2] == 10**4 and sizes[3] == 317**2


def test_counts_and_averages(spark, odd, none):
    counts = {r.word: r.n for r in pseudolm.word_counts(odd).collect()}
    want = {}
    for r in odd.collect():
        for w in (r.text or "").replace("\xa0", "_").split(" "):
            for x in w.split("\n"):
                if x.strip():
                    want[x.strip("\t")] = want.get(x.strip("\t"), 0) + 1
    assert {w: n for w, n in counts.items() if w.isalnum() and w.isascii()} == {
        w: n for w, n in want.items() if w.isalnum() and w.isascii()
    }
    parts = [(k, float(1 + k % 3), np.full(4, k, np.float32).tobytes()) for k in range(40)]
    frame = spark.createDataFrame(parts, "part long, weight double, model binary")
    model, weight = pseudolm._averaged(frame)
    plain = np.average([k for k, _, _ in parts], weights=[w for _, w, _ in parts])
    assert weight == sum(w for _, w, _ in parts) and model == pytest.approx(np.full(4, plain), rel=1e-5)
    empty = pseudolm.fit(none, rounds=1)
    assert pseudolm.score(none, empty).count() == 0
    assert pseudolm.score(odd, pseudolm.fit(odd, rounds=1)).count() == odd.count()


def test_likelihood_query(spark, data):
    rows = QUERIES["op2_lm_scores"](spark, data).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.n_tokens == len(docs[r.doc_id].split()) for r in rows)
    assert all(r.log_likelihood < 0 for r in rows if r.n_tokens)


def test_letters():
    assert not any(map(langid.has_letter, (None, "", " 12 ½ ² ?! 🙂")))
    assert all(map(langid.has_letter, ("a", "1ß", "日", "ʰ")))


def test_held_out_of_null(spark):
    assert spark.range(1).select(langid.held_out(F.lit(None).cast("long")).alias("x")).first().x is False
