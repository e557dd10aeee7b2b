from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tillwise.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, more=0) -> str:
    n = r["n_chars"]
    values = (r["doc_id"], r["source"], r["lang"], n if n is None else n + more, r["text"])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return levels


def plain_way(levels, at):
    for level in levels[:-1]:
        other = at ^ 1
        yield (level[other] if other < len(level) else ""), at & 1
        at >>= 1


def plain_manifest(rows: list[dict]) -> list[tuple]:
    first = lambda v: (v is not None, v if v is not None else 0)
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (first(r["doc_id"]), plain_leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {name: plain_levels([plain_leaf(r) for r in groups[name]]) for name in names}
    top = plain_levels([inner[name][-1][0] for name in names]) if names else []
    out = []
    for place, name in enumerate(names):
        for at, r in enumerate(groups[name]):
            way = [*plain_way(inner[name], at), *plain_way(top, place)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = plain_leaf(r, 1 if tampered else 0)
            for other, left in way:
                node = sha(other + node if left else node + other)
            root = top[-1][0]
            proof = "".join(other for other, _ in way)
            out.append((r["doc_id"], plain_leaf(r), inner[name][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def check(docs):
    want = plain_manifest([{c: r[c] for c in COLUMNS} for r in docs.collect()])
    got = sorted(map(tuple, merkle.document_manifest(docs, tampered()).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1, 1], [3, 16, 17], [256, 5, 1, 2, 33]])
def test_small_trees(spark, sizes):
    rows = [(100 * k + i, f"s{i}", None if k == 0 else f"l{k}", i, f"text {i}") for k, n in enumerate(sizes) for i in range(n)]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))


def test_trees_of_several_blocks(spark):
    hot = spark.range(2 * merkle.BLOCK + 17).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    rest = spark.range(20_000, 20_000 + merkle.BLOCK + 1).select(F.col("id").alias("doc_id"), F.lit("fr").alias("lang"))
    one = spark.createDataFrame([(50_000, "Ω"), (50_001, "")], "doc_id long, lang string")
    docs = hot.unionByName(rest).unionByName(one).select(
        "doc_id", F.lit("s").alias("source"), "lang", F.col("doc_id").alias("n_chars"), F.lit("t").alias("text")
    )
    check(docs.repartition(7))


def test_odd_rows(odd, none):
    check(odd)
    check(odd.unionByName(odd))  # repeated rows and ties
    assert merkle.document_manifest(none, tampered()).count() == 0


def test_tampering_is_found(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check(docs)
    made = merkle.document_manifest(docs, F.lit(True)).collect()
    assert not any(r.verified for r in made)
    assert all(r.verified for r in merkle.document_manifest(docs, F.lit(False)).collect())
