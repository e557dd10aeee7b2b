from __future__ import annotations

from collections import Counter
from math import log
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwise.llm import prefixforest, wand
from tillwise.llm.queries import QUERIES


def plain_nearest(ids, vectors, k):
    found = {}
    for i, own in zip(ids, vectors):
        if i % 20 == 0:
            scored = sorted((-float(own @ v), j) for j, v in zip(ids, vectors) if j != i)[:k]
            found[i] = [(j, -s) for s, j in scored]
    return found


def test_recall_of_the_query(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    vectors = np.stack(table.embedding).astype(float)
    want = plain_nearest(table.vec_id.tolist(), vectors, 20)
    got = {}
    for r in QUERIES["op10_nearest_vectors"](spark, data).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    by_id = dict(zip(table.vec_id.tolist(), vectors))
    for q, rows in got.items():
        assert [k for k, _, _ in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert all(s == pytest.approx(float(by_id[q] @ by_id[v]), abs=1e-12) for _, v, s in rows)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_recall_over_shards_of_unequal_lengths():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 1.5, (3000, 1))
    ids, queries = np.arange(3000), np.arange(0, 3000, 20)
    q, v, s = prefixforest.search_shard(ids, vectors, queries, vectors[queries], 20)
    want = plain_nearest(ids.tolist(), vectors, 20)
    hits = sum(len(set(v[q == i].tolist()) & {j for j, _ in want[i]}) for i in queries.tolist())
    assert hits >= 0.9 * 20 * len(queries)


def test_copies_tie_by_id(spark):
    rows = [(k, [1.0, 0.0, 0.5]) for k in range(300)] + [(k, [0.0, 1.0, 0.0]) for k in range(300, 340)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = prefixforest.nearest(table, F.col("id") % 20 == 0, shard_rows=40, query_rows=7)
    ordered = {}
    for r in got.orderBy("query_id", "rank").collect():
        ordered.setdefault(r.query_id, []).append(r.vec_id)
    assert ordered[0] == list(range(1, 21)) and ordered[100] == list(range(20))
    assert ordered[300] == list(range(301, 321)) and ordered[320] == list(range(300, 320))


def test_vectors_that_take_no_part(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(k, v, "x") for k, v in enumerate(bad)] + [(None, [1.0, 1.0], "x")]
    rows += [(20, [1.0, 0.0], "x"), (20, [1.0, 0.0], "x"), (21, [2.0, 0.0], "x"), (22, [-1.0, 1.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in prefixforest.nearest(table, F.col("id") % 20 == 0).collect()]
    assert sorted(got) == [(20, 1, 21, 2.0), (20, 2, 22, -1.0)]
    assert prefixforest.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0


def plain_search(docs, asked, k):
    terms = {i: [w for w in (x.strip(wand.EDGES) for x in (t or "").lower().split()) if w] for i, t in docs}
    counted = {i: Counter(t) for i, t in terms.items()}
    df = Counter(w for c in counted.values() for w in c)
    mean = sum(map(len, terms.values())) / len(terms)
    found = {}
    for q in asked:
        scored = []
        for d in terms:
            norm = 1.2 * (0.25 + 0.75 * len(terms[d]) / mean)
            s = sum(
                n * log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5)) * counted[d][w] * 2.2 / (counted[d][w] + norm)
                for w, n in sorted(counted[q].items())
                if w in counted[d]
            )
            if d != q and s > 0:
                scored.append((-round(s, 9), d))
        found[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return found


def same(got, want):
    rows = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        rows.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(rows) == {q for q, w in want.items() if w}
    for q, found in rows.items():
        assert [d for d, _ in found] == [d for d, _ in want[q]]
        assert [s for _, s in found] == pytest.approx([s for _, s in want[q]], abs=2e-9)


def shard_of(batch):
    row = {
        f.name: batch.column(c)[0].values if f.name == "terms" else batch.column(c)[0].values.to_numpy()
        for c, f in enumerate(wand.INDEX)
    }
    return wand.Shard(row, float(row["lengths"].mean())), row


def made_shard(texts):
    return shard_of(wand.build_shard(np.arange(len(texts)), pa.array(texts)))


def test_search_query_against_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    same(QUERIES["op4_exact_top_k"](spark, data).collect(), plain_search(docs, [i for i, _ in docs if i % 20 == 0], 10))


def test_search_over_many_shards_and_query_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(wand, "TERMS", 300)
    frame = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 120 and n_chars < 3000").repartition(5)
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    same(wand.search(frame, F.col("id") % 20 == 0, k=3).collect(), plain_search(docs, [i for i, _ in docs if i % 20 == 0], 3))


@pytest.mark.parametrize("block, stride", [(1, 1), (8, 2), (16, 4), (64, 32)])
def test_walk_in_document_order_is_exact(monkeypatch, block, stride):
    monkeypatch.setattr(wand, "BLOCK", block)
    monkeypatch.setattr(wand, "STRIDE", stride)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.4, 30) if x < 500) for _ in range(900)] + ["t1 t2 t3"] * 40
    shard, row = made_shard(texts)
    dense = np.zeros((len(row["starts"]) - 1, len(texts)))
    for t in range(len(dense)):
        span = slice(row["starts"][t], row["starts"][t + 1])
        dense[t, row["docs"][span]] = shard.scores[span]
    for turn in range(60):
        terms = rng.choice(len(dense), rng.integers(1, 12), replace=False)
        weights = rng.uniform(0.1, 3, len(terms))
        (sums,) = shard.dense_sums([(terms, weights)])
        skip = int(row["doc_ids"][turn]) if turn % 2 else -1
        plain = (weights @ dense[terms]).round(9)
        want = sorted((-s, i) for s, i in zip(plain, row["doc_ids"].tolist()) if s > 0 and i != skip)[:10]
        floors = [0.0, -want[-1][0] - wand.SLACK] if len(want) == 10 else [0.0]
        for floor in floors:
            scores, ids = shard.best(terms, weights, sums, 10, floor, skip)
            got = sorted(zip((-scores).tolist(), ids.tolist()))[:10]
            assert [i for _, i in got] == [i for _, i in want]
            assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-9)


def test_queries_that_walk_together_find_what_each_finds(monkeypatch):
    """Dense rows in single floats only choose documents: scores are those of doubles, for copies as well, whoever walks along."""
    monkeypatch.setattr(wand, "BLOCK", 16)
    monkeypatch.setattr(wand, "STRIDE", 4)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, 60) if x < 900) for _ in range(700)]
    shard, row = made_shard(texts + texts[:80])
    n = len(row["doc_ids"])
    plain = np.zeros((len(row["starts"]) - 1, n))
    for t in range(len(plain)):
        span = slice(row["starts"][t], row["starts"][t + 1])
        plain[t, row["docs"][span]] = shard.scores[span]
    queries = [(np.sort(rng.choice(len(plain), 40, replace=False)), rng.uniform(0.1, 7, 40)) for _ in range(21)]
    queries.append((np.empty(0, np.int64), np.empty(0)))
    skips, floors = [int(x) for x in row["doc_ids"][: len(queries)]], [0.0] * len(queries)
    assert shard.dense.dtype == np.float32 and len(shard.dense) > 10
    for some in (range(len(queries)), range(3, 5)):
        asked = [queries[q] for q in some]
        made = shard.best_of_many(asked, shard.dense_sums(asked), 10, [floors[q] for q in some], [skips[q] for q in some])
        for q, (scores, ids) in zip(some, made):
            terms, weights = queries[q]
            want = sorted((-s, i) for s, i in zip((weights @ plain[terms]).round(9), row["doc_ids"].tolist()) if s > 0 and i != skips[q])[:10]
            got = sorted(zip((-scores).tolist(), ids.tolist()))[:10]
            assert [i for _, i in got] == [i for _, i in want]
            assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-9)
            floors[q] = max(0.0, -want[-1][0] - wand.SLACK) if len(want) == 10 else 0.0


def test_blocks_below_the_floor_are_not_read(monkeypatch):
    monkeypatch.setattr(wand, "BLOCK", 8)
    monkeypatch.setattr(wand, "STRIDE", 4)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 400, 20)) for _ in range(2000)]
    texts[3::200] = ["w1 w2 w3 w4"] * 10
    shard, row = made_shard(texts)
    vocabulary = row["terms"].to_pylist()
    terms = np.array([vocabulary.index(w) for w in ("w1", "w2", "w3", "w4")])
    (sums,) = shard.dense_sums([(terms, np.ones(4))])
    _, ids = shard.best(terms, np.ones(4), sums, 10, 0.0, -1)
    assert sorted(ids.tolist()) == list(range(3, 2000, 200))
    asked = int((row["starts"][terms + 1] - row["starts"][terms]).sum())
    with_zero_floor = shard.postings_read
    assert 0 < with_zero_floor < asked
    floor = 0.5 * float(shard.scores.max())
    shard.best(terms, np.ones(4), sums, 10, 4 * floor, -1)
    assert shard.postings_read - with_zero_floor <= with_zero_floor


def test_repeated_rows_of_the_query_do_not_raise_the_floor():
    texts = ["a b c"] * 5 + ["a x y z"] * 3 + ["q r"] * 4
    batch = wand.build_shard(np.array([7] * 5 + [1, 2, 3] + [4, 5, 6, 8]), pa.array(texts))
    shard, row = shard_of(batch)
    terms = np.array([row["terms"].to_pylist().index("a")])
    (sums,) = shard.dense_sums([(terms, np.ones(1))])
    _, ids = shard.best(terms, np.ones(1), sums, 3, 0.0, 7)
    assert sorted(ids.tolist()) == [1, 2, 3]


def test_a_shard_is_counted_from_few_texts_at_once(monkeypatch):
    monkeypatch.setattr(wand, "SLICE", 3_000)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 90)) if x < 900) for _ in range(1500)]
    texts[7:9] = [None, "t1 " * 5_000]
    ids = rng.permutation(1500)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["id", "text"])
    at_once, split = [], wand.split_terms
    monkeypatch.setattr(wand, "split_terms", lambda t: (at_once.append((len(t), t.nbytes)), split(t))[1])
    (got,) = wand.shard_rows(iter([batch.slice(0, 900), batch.slice(900)]))
    assert len(at_once) > 20 and max(n for n, _ in at_once) <= 256 and sum(n for n, _ in at_once) == 1500
    assert sorted(b for _, b in at_once)[-2] < 10_000  # all but the long one
    assert got.equals(wand.build_shard(ids, pa.array(texts)))


def test_query_terms_go_when_their_block_is_done(spark, data, monkeypatch):
    monkeypatch.setattr(wand, "TERMS", 300)
    sent, rows = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kind = type(spark.sparkContext)
    send = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    frame = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60 and n_chars < 3000")
    wand.search(frame, F.col("id") % 20 == 0, k=3).collect()
    assert len(sent) > 1 and not any(Path(b._path).exists() for b in sent)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows


def test_odd_rows(odd, none):
    got = wand.search(odd, F.col("id") % 2 == 0).collect()
    assert {r.query_id for r in got} <= {0, 6, 8} and (0, 1, 1) in {(r.query_id, r["rank"], r.doc_id) for r in got}
    assert wand.search(none, F.col("id") % 2 == 0).count() == 0
