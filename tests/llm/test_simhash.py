from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tillwise.llm import simhash
from tillwise.llm.frames import connected_components
from tillwise.llm.queries import QUERIES

LONG = " ".join(f"word{k % 977}" for k in range(40_000))


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, values, radius=3):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(values, np.uint64)
    for i, value in zip(ids, values):
        for j in np.flatnonzero(np.bitwise_count(value ^ values) <= radius):
            a, b = sorted((find(i), find(ids[j])))
            root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, " \n", "One", "A b", "Ärger IST groß\x0bund ſ K", "x y z " * 7000, LONG])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_query_against_brute_force(spark, data):
    got = QUERIES["op3_simhash_near_dedup"](spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    want = [plain_fingerprint(t) for t in docs.text]
    by_id = dict(zip(docs.doc_id, want))
    assert {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()} == by_id
    assert dict(zip(got.doc_id, got.component_id)) == plain_components(list(docs.doc_id), want)


@pytest.mark.parametrize("parts", [1, 2, 3, 4])
def test_pairs_of_every_partition_count(spark, parts):
    random.seed(parts)
    centres = [random.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    values = {c for c in centres}
    for c in centres:
        for flips in (1, 2, 3, 4, 5):
            v = c
            for b in random.sample(range(64), flips):
                v ^= 1 << b
            values.add(v)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    radius = 3 if parts > 1 else 2
    got = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, parts).collect()
    want = {
        (a, b) for i, a in enumerate(sorted(signed)) for b in sorted(signed)[i + 1 :] if (a ^ b).bit_count() <= radius
        and ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    }
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(3)
    costs = [np.concatenate([np.zeros((20, 1)), rng.random((20, 4)).cumsum(axis=1)], axis=1) for _ in range(3)]
    got = simhash.thresholds(costs, 3)
    assert ((got + 1).sum(axis=1) == 4).all()
    for row in range(20):
        least = min(
            costs[0][row, a] + costs[1][row, b] + costs[2][row, 4 - a - b]
            for a in range(5) for b in range(5 - a)
        )
        assert sum(costs[i][row, got[row, i] + 1] for i in range(3)) == pytest.approx(least)


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (500, 32))
    bits = np.repeat(base, 2, axis=1)[:, rng.permutation(64)]
    together = bits.T @ bits
    for group in simhash.correlated_parts(together, 500, 2):
        alike = [(a, b) for a in range(64) for b in range(a) if (bits[:, a] == bits[:, b]).all()]
        assert sum((a in group) != (b in group) for a, b in alike) <= 2


def test_components(spark):
    random.seed(4)
    edges = [(k, k + 1) for k in range(100, 180)] + [(7, 7), (3, None)]
    edges += [(random.randrange(200, 400), random.randrange(200, 400)) for _ in range(150)]
    edges += [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if None not in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_of_components_takes_few_tasks(spark):
    """Tasks of the first two rounds on 20 shuffle partitions, none coalesced: five stages of a round at most have 20."""
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, context = {k: spark.conf.get(k) for k in settings}, spark.sparkContext
    edges = spark.range(0, 4_000, 1, 4).selectExpr("id as a", "id + 1 as b")
    tasks = []
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for rounds in (0, 2):
            context.setJobGroup(f"components {rounds}", "")
            connected_components(edges, rounds=rounds)
            jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(f"components {rounds}")]
            stages = [context.statusTracker().getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
            tasks.append(sum(s.numCompletedTasks for s in stages if s))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < tasks[1] - tasks[0] <= 2 * 6 * 20


def test_odd_rows(odd, none):
    got = simhash.near_duplicate_components(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.id: r.component for r in got}
    assert by_id[1] == by_id[0] == 0 and by_id[2] == by_id[3] == by_id[4] == 2 and by_id[None] is None
    assert {r.fp for r in got if r.id in (2, 3, 4)} == {0}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 0, 2, 5, 6, 7, 8, 9]
    assert simhash.near_duplicate_components(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
