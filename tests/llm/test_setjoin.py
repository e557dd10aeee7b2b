from __future__ import annotations

import random
from time import sleep

import corpus_pipeline

from tillwise.llm import setjoin


def plain_sets(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    sets = {k: plain_sets(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and (not union or 10 * len(sets[a] & sets[b]) >= 8 * union):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


def edited(rng):
    """Texts of 1 to 300 words with none to many words changed, a passage that many share, and chains of copies."""
    passage, texts = " ".join(f"p{k}" for k in range(40)), []
    for base in range(25):
        words = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice((1, 4, 6, 12, 40, 120, 300, 1_300)))]
        for _ in range(6):
            words = [w if rng.random() > rng.choice((0, 0.01, 0.03)) else f"n{rng.random()}" for w in words]
            texts.append(" ".join(words) + (f" {passage}" if base % 3 == 0 else ""))
    texts += ["", " \n", "One two", "one TWO", passage, passage + " more"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_near_dedup_stage_takes_jaccard_of_08(spark, data):
    texts = edited(random.Random(8))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = plain_components(texts)
    assert 30 < len(set(want.values())) < len(texts) - 40
    got = {r.id: r.component for r in setjoin.near_duplicate_components(docs).collect()}
    assert got == want
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()} == set(want.values())


def test_simhash_gives_links_of_the_near_dedup_stage(spark, data, monkeypatch):
    """The links that SimHash finds are verified, several near copies come from it alone, and the stage uses them."""
    rng, texts = random.Random(11), {}
    for base in range(8):
        words = [f"b{base}w{k}" for k in range(1_500)]
        for k in range(4):
            texts[10 * base + k] = " ".join(words[: 1_500 - k] + [f"n{rng.random()}"] * k)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found, own = [], setjoin.by_simhash

    def seen(*given):
        found.append(own(*given))
        return found[-1]

    monkeypatch.setattr(setjoin, "by_simhash", seen)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()} == {10 * base for base in range(8)}
    near = {(setjoin.set_key(setjoin.shingle_set(texts[k])), setjoin.set_key(setjoin.shingle_set(texts[j]))) for k in texts for j in texts if k // 10 == j // 10}
    links = {(r.a, r.b) for r in found[0].collect()}
    assert len(links) >= 12 and links <= near


def test_verification_cuts_only_wanted_texts_into_shingles(spark, monkeypatch):
    """A text that no pair asks for would raise; a wanted one comes out once, however often it is held."""
    texts = [f"text {k} of a few words more than five" for k in range(300)]
    rows = [(k, t) for k, t in enumerate([*texts, *texts[:40], None])]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    marked = {r.id: r for r in setjoin._marked(docs, 80, 5).collect()}
    for k, text in rows:
        hashes = setjoin.shingle_set(text)
        assert marked[k].fp == setjoin.set_key(hashes) and marked[k].size == len(hashes)
        assert set(marked[k].tokens) <= set(hashes.tolist())
        assert len(set(marked[k].tokens)) == len(marked[k].tokens) == (len(hashes) - -(-4 * len(hashes) // 5) + 1 if text else 0)
    asked, own = {texts[k] for k in (0, 7, 299)}, setjoin.shingle_set

    def only(text, shingle):
        if text not in asked:
            raise ValueError(text)
        return own(text, shingle)

    monkeypatch.setattr(setjoin, "shingle_set", only)
    wanted = spark.createDataFrame([(marked[k].fp, marked[k].code) for k in (0, 7, 299)], "fp long, code long")
    got = [(r.fp, sorted(r.hashes)) for r in setjoin._sets(docs.select("text"), wanted, 5).collect()]
    assert sorted(got) == sorted((marked[k].fp, own(texts[k], 5).tolist()) for k in (0, 7, 299))


def test_last_pairs_are_of_components_that_all_rewirings_leave_unlike(spark, monkeypatch):
    listed = spark.range(60).selectExpr("id % 2 as token", "id as fp", "9 as size")
    path = spark.range(59).selectExpr("id as a", "id + 1 as b")
    assert setjoin._unlike(listed, path, rounds=None).count() == 0
    assert setjoin._unlike(listed, path.where("a <> 30"), rounds=None).count() == 60
    asked, own = [], setjoin._unlike
    monkeypatch.setattr(setjoin, "_unlike", lambda *given, rounds=1: asked.append(rounds) or own(*given, rounds=rounds))
    docs = spark.createDataFrame([(k, f"a b c d e f g h {k}") for k in range(4)], "doc_id long, text string")
    setjoin.near_duplicate_components(docs)
    assert asked[-1] is None and set(asked[:-1]) == {1}


def test_order_of_common_shingles_changes_no_result(spark, monkeypatch):
    texts = edited(random.Random(9))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(setjoin, "COMMON", 5)
    got = {r.id: r.component for r in setjoin.near_duplicate_components(docs).collect()}
    assert got == plain_components(texts)


def test_near_dedup_stage_leaves_no_shuffle_files(spark, data):
    """Files of the stage's queries go when these end; what it returns can be computed more than once."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: str(disk.getAllFiles().mkString(" ")).count("shuffle_")
    name, texts = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", edited(random.Random(12))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    before, was = shuffled(), spark.conf.get(name)
    kept = corpus_pipeline.near_dedup(spark, docs, data)
    for _ in range(40):
        if shuffled() <= before + 10:
            break
        sleep(0.25)
    assert shuffled() <= before + 10 and spark.conf.get(name) == was
    first = {r.doc_id for r in kept.collect()}
    assert first == {r.doc_id for r in kept.collect()} == set(plain_components(texts).values())


def test_odd_rows(odd, none):
    kept = setjoin.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 0, 2, 5, 6, 7, 8, 9]
    assert setjoin.drop_near_duplicates(none).count() == 0


def test_a_large_group_of_near_copies_is_not_expanded(spark, monkeypatch):
    """Each copy differs from the first text by its own words, so many copies are not near each other; few pairs are verified."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(400):
        words = list(base)
        if k % 4:
            words[rng.randrange(60)] = f"n{k}"
        if k % 4 > 1:
            words[rng.randrange(60)] = f"m{k}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    asked = []
    own = setjoin._verified

    def counted(pairs, *more):
        pairs = setjoin.store(pairs)
        asked.append(pairs.count())
        return own(pairs, *more)

    monkeypatch.setattr(setjoin, "_verified", counted)
    got = {r.id: r.component for r in setjoin.near_duplicate_components(docs).collect()}
    assert got == plain_components(texts)
    assert sum(asked) < 30 * len(texts)  # of 79,800 pairs
