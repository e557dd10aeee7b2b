"""Near copies by exact Jaccard similarity of word-shingle sets, found by SimHash and completed by prefix filtering.

Sets whose SimHashes differ in few bits are met by ``simhash.near_pairs`` and verified on the whole sets.  What SimHash cannot
promise to meet, prefix filtering finds: if two sets share ``percent`` of their union or more, each shares at least that part of its own shingles with the other.
So under any one order of all shingles, the first ``n - ceil(n * percent / 100) + 1`` of a set of n meet those of
every near copy: no near copy is missed, and what meets is verified on the whole sets.  The order puts common
shingles last, so that few sets meet by chance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.frames import connected_components, per_batch, settle, store
from tillwise.llm.simhash import component_of_links, drop_all_but_first, majority, near_pairs

#: Common shingles that are put last; shingles counted at once.  Both set the work, neither the result.
COMMON, COUNTED = 50_000, 1_000_000
#: Longs of a set's parity sketch, and of the second one of sets of more than ``LARGE``; bits that tell which sets are wanted.
LONGS, WIDE, LARGE, WANTED = 16, 256, 1_000, 1 << 24


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; words as in ``simhash.fingerprint``."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = {digest(joined[s:e], 42) for s, e in zip(starts, ends.tolist()[last:])}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64))


def set_key(hashes: np.ndarray) -> int:
    """64 bits that stand for a set; 0 for the empty one."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64)) if len(hashes) else 0


def prefix(hashes: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set: rare ones by hash, then ``common`` ones, whose places are given from rare to frequent."""
    size = len(hashes) - -(-percent * len(hashes) // 100) + 1 if len(hashes) else 0
    if not len(common):
        return hashes[:size]
    values, places = common
    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
    place = np.where(values[at] == hashes, places[at], -1)
    return hashes[np.lexsort((hashes, place))[:size]]


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes and places of common shingles, counted in an eighth of the texts; at most ``COMMON``, on the driver."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 4
            return pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(n[often])], schema=schema)

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), shingle))
                waiting += len(held[-1])
                if waiting >= COUNTED:
                    yield counted()
                    held, waiting = [], 0
        if held:
            yield counted()

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).mapInArrow(run, "hash long, n long")
    top = some.groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(COMMON).collect()
    if not top:
        return np.zeros((0, 0), np.int64)
    values = np.array([r.hash for r in top], np.int64)
    order = np.argsort(values)
    return np.stack([values[order], (len(top) - 1 - np.arange(len(top)))[order]])


def parity(hashes: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """For each of ``64 * longs`` slots whether an odd number of hashes falls into it.

    Two sketches differ in at most as many bits as the sets differ in shingles, so they rule pairs out for certain.
    """
    odd = np.bincount(hashes & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _marked(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``(id, fp, code, sim, size, bits, wide, tokens)`` for every row of ``docs(id, text)``.

    Key, SimHash, size, parity sketches and first shingles of its set; ``code`` is a hash of the text itself.  ``wide`` is null for
    smaller sets.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs.select("text"), shingle))
    fields = [("id", pa.int64()), ("fp", pa.int64()), ("code", pa.int64()), ("sim", pa.int64()), ("size", pa.int32())]
    schema = pa.schema([*fields, *((n, pa.list_(pa.int64())) for n in ("bits", "wide", "tokens"))])

    def marks(ids: list, codes: list, texts: list) -> tuple:
        sets = [shingle_set(text, shingle) for text in texts]
        wide = [parity(x, WIDE) if len(x) > LARGE else None for x in sets]
        keys, sims, sizes = [set_key(x) for x in sets], [majority(x) for x in sets], [len(x) for x in sets]
        return ids, keys, codes, sims, sizes, [parity(x) for x in sets], wide, [prefix(x, percent, sent.value) for x in sets]

    types = "id long, fp long, code long, sim long, size int, bits array<long>, wide array<long>, tokens array<long>"
    return docs.select("id", F.xxhash64("text").alias("code"), "text").mapInArrow(per_batch(marks, schema, 500), types)


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(fp, hashes)`` of the sets whose key is in ``wanted(fp, code)``, each once; ``code`` is that of a text of the set.

    Of the codes every executor gets a map of ``WANTED`` bits, so few other texts are cut into shingles.
    """
    slot = F.col("code").bitwiseAND(F.lit(WANTED - 1))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = wanted.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("k")).agg(F.bit_or(one).alias("v"))
    found, bits = rows.toArrow(), np.zeros(WANTED // 64, np.int64)
    bits[found["k"].to_numpy()] = found["v"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("fp", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy()
            asked = sent.value[(codes & (WANTED - 1)) // 64] >> (codes & 63) & 1
            held = batch.column(1).filter(pa.array(asked == 1))
            for start in range(0, len(held), 500):
                made = [shingle_set(text, shingle) for text in set(held.slice(start, 500).to_pylist())]
                made = {set_key(hashes): hashes for hashes in made}
                yield pa.RecordBatch.from_pydict({"fp": list(made), "hashes": list(made.values())}, schema=schema)

    coded = texts.select(F.xxhash64("text").alias("code"), "text")
    every = coded.mapInArrow(run, "fp long, hashes array<long>").repartition("fp")
    return every.join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes"))


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets share ``percent`` of their union or more."""

    def sided(frame: DataFrame, key: str, side: str) -> DataFrame:
        return frame.select(*[F.col(c).alias(key if c == "fp" else c + side) for c in frame.columns])

    size = F.col("size_a") + F.col("size_b")
    near_size = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    possible = near_size & _few_bits_apart("bits_a", "bits_b", size, percent)
    narrow, wide = sketches.select("fp", "code", "size", "bits"), sketches.where("wide is not null").select("fp", "wide")
    pairs = store(
        pairs.join(sided(narrow, "a", "_a"), "a")
        .join(sided(narrow, "b", "_b"), "b")
        .where(possible)
        .select("a", "b", "code_a", "code_b", size.alias("both"))
    )
    apart = F.aggregate(
        F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    possible = F.coalesce(apart * (100 + percent) <= (100 - percent) * F.col("both"), F.lit(True))
    pairs = store(
        pairs.join(sided(wide, "a", "_a"), "a", "left")
        .join(sided(wide, "b", "_b"), "b", "left")
        .where(possible)
        .select("a", "b", "code_a", "code_b")
    )
    ends = [F.struct(F.col(end).alias("fp"), F.col(f"code_{end}").alias("code")) for end in "ab"]
    wanted = pairs.select(F.explode(F.array(*ends)).alias("end")).select("end.*").distinct()
    sets = store(_sets(texts, wanted, shingle))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    near = both * (100 + percent) >= percent * (F.size("hashes_a") + F.size("hashes_b"))
    return pairs.select("a", "b").join(sided(sets, "a", "_a"), "a").join(sided(sets, "b", "_b"), "b").where(near).select("a", "b")


def _few_bits_apart(a: str, b: str, size: Column, percent: int) -> Column:
    """Whether two parity sketches allow sets of ``size`` together to be near."""
    apart = sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(LONGS))
    return apart * (100 + percent) <= (100 - percent) * size


def by_simhash(texts: DataFrame, sketches: DataFrame, percent: int = 80, shingle: int = 5, radius: int = 3) -> DataFrame:
    """``(a, b)``: keys of near sets that SimHash brings together, verified on the whole sets; at most two links a key.

    Every set is verified against the least of those that share its fingerprint, and the least set of a fingerprint against that
    of the least fingerprint it is linked to.  ``sketches`` are those of ``_marked``, each key once.
    """
    leads = settle(sketches.groupBy("sim").agg(F.min("fp").alias("lead")))
    same = sketches.select("fp", "sim").join(leads, "sim").where("fp <> lead").select("fp", "lead")
    linked = near_pairs(leads.select(F.col("sim").alias("fp")), radius).groupBy("b").agg(F.min("a").alias("a"))
    above, below = (leads.select(F.col("sim").alias(c), F.col("lead").alias(name)) for c, name in (("b", "fp"), ("a", "lead")))
    met = same.unionByName(linked.join(above, "b").join(below, "a").select("fp", "lead"))
    met = met.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct()
    return store(_verified(met, sketches, texts, percent, shingle))


def _unlike(listed: DataFrame, links: DataFrame, rounds: int | None = 1) -> DataFrame:
    """``listed(token, fp, size)`` with the root of each set under ``links``, for tokens whose sets have several roots.

    Roots are those that ``rounds`` of rewiring find; None: all.
    """
    roots = store(connected_components(links, rounds=rounds).withColumnRenamed("node", "fp"))
    rooted = listed.join(roots, "fp", "left").select("token", "fp", "size", F.coalesce("root", "fp").alias("root"))
    rooted = store(rooted)
    several = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return store(rooted.join(several.select("token"), "token"))


def near_sets(texts: DataFrame, sketches: DataFrame, percent: int = 80, shingle: int = 5, turns: int = 3) -> DataFrame:
    """``(a, b)``: links between keys of near sets of ``texts(text)``; their components are those of all near pairs.

    SimHash gives the first links.  In each turn that follows every first shingle has one centre among the sets that share it, another
    one each turn, and the sets in other components than its own are verified against it.  What is left then is verified
    pair by pair, but only pairs of components that all links so far leave unlike, and whose sketches allow it.  So a large group of near copies is not
    expanded into its pairs, and no shingle's sets meet in one task.  ``sketches(fp, code, sim, size, bits, wide, tokens)`` are
    those of ``_marked``, each key once.
    """
    links = by_simhash(texts, sketches, percent, shingle)
    every = sketches.select(F.explode("tokens").alias("token"), "fp", "size")
    several = every.groupBy("token").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("token")
    open_ = _unlike(every.join(several, "token"), links)
    for turn in range(turns):
        first = F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("draw"), "fp", "root"))
        centers = open_.groupBy("token").agg(first.alias("center")).select("token", "center.fp", "center.root")
        other = centers.select("token", F.col("fp").alias("center"), F.col("root").alias("its_root"))
        stars = open_.join(other, "token").where("root <> its_root").select(
            F.least("fp", "center").alias("a"), F.greatest("fp", "center").alias("b")
        )
        links = links.unionByName(store(_verified(stars.distinct(), sketches, texts, percent, shingle)))
        open_ = _unlike(open_.drop("root"), links, rounds=None if turn == turns - 1 else 1)
    seen = store(open_.join(sketches.select("fp", "bits"), "fp"))
    l, r = (seen.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("fp", "size", "root", "bits")]) for side in "lr")
    size = F.col("size_l") + F.col("size_r")
    near_size = 100 * F.least("size_l", "size_r") >= percent * F.greatest("size_l", "size_r")
    possible = (F.col("fp_l") < F.col("fp_r")) & (F.col("root_l") != F.col("root_r")) & near_size
    possible = possible & _few_bits_apart("bits_l", "bits_r", size, percent)
    met = l.join(r.withColumnRenamed("token", "token_r"), (F.col("token") == F.col("token_r")) & possible)
    rest = met.select(F.col("fp_l").alias("a"), F.col("fp_r").alias("b")).distinct()
    return links.unionByName(_verified(rest, sketches, texts, percent, shingle))


def near_duplicate_components(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = 5
) -> DataFrame:
    """``(id, fp, component)`` per row: key of its shingle set and smallest id that links of near sets reach.

    A text of fewer than ``shingle`` words is one shingle; null texts and texts without words are one group.  Null ids
    are treated as in ``simhash.near_duplicate_components``.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    marked = store(_marked(docs, percent, shingle))
    kept = [F.first(c).alias(c) for c in ("sim", "size", "bits", "wide", "tokens")]
    sketches = store(marked.groupBy("fp").agg(F.min("code").alias("code"), *kept))
    links = near_sets(docs.select("text"), sketches, percent, shingle)
    return component_of_links(marked.select("id", "fp"), links)


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; see ``simhash.drop_near_duplicates``."""
    return drop_all_but_first(docs, id_column, near_duplicate_components(docs, id_column, text, **options))
