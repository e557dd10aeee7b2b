"""Near-duplicates by SimHash, linked by the generalised pigeonhole principle.

If the 64 bits are cut into m parts and thresholds t_1 .. t_m (each at least -1, "never") sum up to
r - m + 1, then two fingerprints that differ in at most r bits differ in at most t_i bits in some part i.  The bits
are grouped so that correlated ones share a part; each fingerprint gets the thresholds for which a dynamic
program expects the fewest probes and candidates; it probes the values within t_i of its own in part i, and
what it meets is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.frames import connected_components, per_batch, settle

BITS = 64
#: Shingles whose bits are summed at once; bounds the memory a very long text takes.
CHUNK = 16_384


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a text: the majority of each bit over the hashes of its word shingles.

    A-Z are lower-cased; a text of fewer than ``shingle`` words is one shingle; null and texts without
    words give zero.  Repeated shingles count as often as they occur.  A tie leaves the bit at 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    count = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(BITS, np.int64)
    last = min(shingle, len(words)) - 1
    for at in range(0, count, CHUNK):
        to = min(count, at + CHUNK)
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[at:to], ends[at + last : to + last])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > count).tobytes(), "big", signed=True)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of 64-bit shingle hashes: the bits that are set in over half of them; zero for none."""
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        sums += bit_matrix(hashes[at : at + CHUNK]).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` for every row of ``docs``; see ``fingerprint`` for null and short texts."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(
        per_batch(lambda ids, texts: (ids, [fingerprint(t, shingle) for t in texts]), schema), "id long, fp long"
    )


def bit_matrix(values: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, the highest bit first."""
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def correlated_parts(together: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` groups, correlated bits together; ``together``: rows in which both are set."""
    share = together / max(rows, 1)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    strength = np.abs((share - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        rest = sorted(left)
        group = [rest[int(np.argmax(strength[np.ix_(rest, rest)].sum(axis=1)))]]
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(strength[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left -= set(group)
    return groups


def ball(bits: list[int], radius: int) -> np.ndarray:
    """All 64-bit values with at most ``radius`` of ``bits`` set."""
    one = {b: 1 << (BITS - 1 - b) for b in bits}
    values = [sum(one[b] for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]
    return np.array(values, np.uint64).view(np.int64)


def blocks_of(group: list[int]) -> list[list[int]]:
    return [group[k : k + 8] for k in range(0, len(group), 8)]


def block_values(bits: np.ndarray, block: list[int]) -> np.ndarray:
    return bits[:, block].astype(np.int64) @ (1 << np.arange(len(block))[::-1])


def expected_within(bits: np.ndarray, group: list[int], counts: list[np.ndarray], radius: int) -> np.ndarray:
    """For each row, how many fingerprints are expected within 0..radius bits of it in ``group``.

    Blocks of eight bits are taken as independent of each other; within a block the counts are exact.
    """
    total = max(int(counts[0].sum()), 1)
    chance = np.zeros((len(bits), radius + 1))
    chance[:, 0] = 1
    for block, count in zip(blocks_of(group), counts):
        apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        at = np.stack([(apart == d) @ count for d in range(radius + 1)], axis=1) / total
        own = at[block_values(bits, block)]
        chance = np.stack(
            [sum(chance[:, k] * own[:, d - k] for k in range(d + 1)) for d in range(radius + 1)], axis=1
        )
    return total * chance.cumsum(axis=1)


def thresholds(costs: list[np.ndarray], radius: int) -> np.ndarray:
    """Per row and part the threshold (-1 .. radius) of least total cost; ``costs[i][:, t + 1]`` is that of t.

    Dynamic program over the parts: the thresholds plus one sum up to ``radius + 1``.
    """
    rows, budget = len(costs[0]), radius + 1
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    choices = []
    for cost in costs:
        options = np.full((rows, budget + 1, budget + 1), np.inf)  # spent so far, spent here
        for spent in range(budget + 1):
            for here in range(spent + 1):
                options[:, spent, here] = best[:, spent - here] + cost[:, here]
        choices.append(options.argmin(axis=2))
        best = options.min(axis=2)
    picked, spent = np.zeros((rows, len(costs)), np.int64), np.full(rows, budget)
    for i in range(len(costs) - 1, -1, -1):
        picked[:, i] = choices[i][np.arange(rows), spent]
        spent = spent - picked[:, i]
    return picked - 1


def _summed(frame: DataFrame, function) -> np.ndarray:
    """Sum of the arrays that ``function(fingerprints of a batch)`` gives; as many numbers at any input size."""
    schema = pa.schema([("k", pa.int32()), ("v", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = function(batch.column(0).to_numpy())
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.int64())], schema=schema
            )

    rows = frame.mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r.k for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.k] = r.v
    return out


def _together(values: np.ndarray) -> np.ndarray:
    bits = bit_matrix(values).astype(np.float64)
    return (bits.T @ bits).astype(np.int64).ravel()


def near_pairs(distinct: DataFrame, radius: int = 3, parts: int = 2) -> DataFrame:
    """``(a, b)``, a < b, each once: the fingerprints of ``distinct(fp)`` that differ in at most ``radius`` bits.

    Work follows the number of fingerprints: every one is listed under its value in each part and probes
    the values within its thresholds.  Two wide parts are the default because with narrow ones the share of
    chance meetings grows with the square of the table.
    """
    spark = distinct.sparkSession
    together = _summed(distinct, _together)
    if not len(together):
        return spark.createDataFrame([], "a long, b long")
    together = together.reshape(BITS, BITS)
    rows = distinct.count()
    groups = correlated_parts(together, rows, parts)
    masks = [_mask(g) for g in groups]
    blocks = [block for g in groups for block in blocks_of(g)]

    def block_counts(values: np.ndarray) -> np.ndarray:
        bits = bit_matrix(values)
        return np.concatenate([np.bincount(block_values(bits, b), minlength=256) for b in blocks])

    flat = _summed(distinct, block_counts).reshape(len(blocks), 256)
    counts, at = [], 0
    for g in groups:
        counts.append([flat[at + k] for k in range(len(blocks_of(g)))])
        at += len(blocks_of(g))
    schema = pa.schema([("part", pa.int8()), ("key", pa.int64()), ("x", pa.int64()), ("t", pa.int64())])

    def probes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                values = batch.column(0).slice(start, 2_000).to_numpy()
                bits = bit_matrix(values)
                costs = []
                for g, count in zip(groups, counts):
                    probed = np.cumsum([comb(len(g), t) for t in range(radius + 1)])
                    inside = expected_within(bits, g, count, radius)
                    costs.append(np.concatenate([np.zeros((len(values), 1)), probed + inside], axis=1))
                picked = thresholds(costs, radius)
                packed = ((picked + 1) << (4 * np.arange(len(groups)))).sum(axis=1)
                for p, g in enumerate(groups):
                    for t in range(radius + 1):
                        chosen = np.flatnonzero(picked[:, p] == t)
                        around = balls.setdefault((p, t), ball(g, t))
                        step = max(1, 200_000 // len(around))
                        for k in range(0, len(chosen), step):
                            own = values[chosen[k : k + step]]
                            keys = ((own & np.int64(masks[p]))[:, None] ^ around[None, :]).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(len(keys), p, np.int8)),
                                    pa.array(keys),
                                    pa.array(np.repeat(own, len(around))),
                                    pa.array(np.repeat(packed[chosen[k : k + step]], len(around))),
                                ],
                                schema=schema,
                            )

    probe = distinct.mapInArrow(probes, "part byte, key long, x long, t long")
    listed = distinct.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                    for p, m in enumerate(masks)
                ]
            )
        ).alias("at"),
        F.col("fp").alias("y"),
    ).select("at.part", "at.key", "y")
    apart = F.col("x").bitwiseXOR(F.col("y"))
    verified = (F.bit_count(apart) <= radius) & (F.col("x") < F.col("y")) & _first_meeting(apart, masks)
    met = probe.join(
        listed.withColumnsRenamed({"part": "own_part", "key": "own_key"}),
        (F.col("part") == F.col("own_part")) & (F.col("key") == F.col("own_key")) & verified,
    )
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _mask(group: list[int]) -> int:
    return int(np.array([sum(1 << (BITS - 1 - b) for b in group)], np.uint64).view(np.int64)[0])


def _first_meeting(apart: Column, masks: list[int]) -> Column:
    """True in the first part in which x meets y, so that a pair comes out once."""
    met = F.lit(True)
    for part in range(1, len(masks)):
        earlier = F.lit(True)
        for k in range(part):
            allowed = F.shiftright(F.col("t"), 4 * k).bitwiseAND(F.lit(15)) - 1
            earlier = earlier & (F.bit_count(apart.bitwiseAND(F.lit(masks[k]))) > allowed)
        met = met & ((F.col("part") != part) | earlier)
    return met


def near_duplicate_components(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, parts: int = 2
) -> DataFrame:
    """``(id, fp, component)`` per row: fingerprint and smallest id that links of ``radius`` bits or fewer reach.

    Rows of one fingerprint meet in an aggregation that combines before its shuffle; links are sought between
    distinct fingerprints only, so copies are never expanded into pairs.  Rows with a null id keep their fingerprint
    and get the component of the others that share it (null if there is none).  An empty table gives no rows.
    """
    marked = settle(fingerprints(docs, id_column, text, shingle))
    firsts = settle(marked.groupBy("fp").agg(F.min("id").alias("first")))
    return _components(marked, firsts, near_pairs(firsts.select("fp"), radius, parts))


def component_of_links(marked: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, fp, component)`` for ``marked(id, fp)``, whose keys ``fp`` are linked by ``links(a, b)``."""
    return _components(marked, settle(marked.groupBy("fp").agg(F.min("id").alias("first"))), links)


def _components(marked: DataFrame, firsts: DataFrame, links: DataFrame) -> DataFrame:
    roots = connected_components(links).withColumnRenamed("node", "fp")
    rooted = settle(
        firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    component = rooted.join(smallest, "root").select("fp", "component")
    return marked.join(component, "fp", "left").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; all columns stay.

    Texts without words are one group like any other.  Rows with a null id stay, as nothing tells them apart; of
    repeated rows of one id all stay or go together.
    """
    return drop_all_but_first(docs, id_column, near_duplicate_components(docs, id_column, text, **options))


def drop_all_but_first(docs: DataFrame, id_column: str, found: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component in ``found(id, component)`` has a smaller id."""
    gone = found.where("id > component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_column].cast("long") == gone["__gone"], "left_anti")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
