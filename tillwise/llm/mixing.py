"""Mixing of sources to target weights: budgets down a tree of domains, languages and sources.

A node's budget is shared among its children by their weights.  What a child cannot use, because all it has is less,
goes to its siblings by weight; only what the whole family cannot use goes to the siblings of their parent.  A leaf then
takes whole epochs and the prefix of one more, in a seeded order, until its budget is used.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.frames import store, words_column

LEAF = ["domain", "lang", "source"]
#: Leading hexadecimal digits of a row's place by which a leaf's tokens are summed first.
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Weights are positive whole numbers; names without one weigh 1.  Sources without a domain are in ``other``.

    ``share`` (in hundredths of all tokens) is the budget; a row is taken ``max_epochs`` times at most.
    """

    domains: Mapping[str, tuple[str, ...]]
    domain_weights: Mapping[str, int] = field(default_factory=dict)
    lang_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)
    share: int = 50
    max_epochs: int = 3
    seed: int = 7

    def weights(self, level: str) -> Mapping[str, int]:
        found = {"domain": self.domain_weights, "lang": self.lang_weights, "source": self.source_weights}[level]
        if any(w < 1 for w in found.values()):
            raise ValueError(f"weights of {level} must be 1 or more")
        return found


def _lookup(values: Mapping[str, object], key: Column, default: object) -> Column:
    chosen = F.lit(default)
    for name, value in values.items():
        chosen = F.when(key == name, F.lit(value)).otherwise(chosen)
    return chosen


def with_leaf(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` as ``id, domain, lang, source, tokens``; null languages and sources have the empty name.

    Tokens are words between ASCII white space; a null text has none.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    home = {s: domain for domain, sources in mix.domains.items() for s in sources}
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        _lookup(home, source, "other").alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        source.alias("source"),
        words_column(F.col("text").cast("string")).alias("tokens"),
    )


def _allot(nodes: DataFrame, parents: list[str], level: str, budgets: DataFrame, mix: Mix) -> DataFrame:
    """Budget of each child of ``nodes(*parents, level, cap)`` out of its parent's ``budget``.

    Children are filled in the order of ``cap / weight``: those whose share by weight of what is left is no
    less than their cap get their cap, the others the rest by weight, rounded down.
    """
    weight = _lookup(mix.weights(level), F.col(level), 1).cast("long")
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = family.orderBy(F.col("cap") / F.col("weight"), level).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    joined = nodes.join(budgets, parents) if parents else nodes.withColumn("budget", budgets.scalar())
    joined = joined.withColumn("weight", weight)
    full = joined.withColumn(
        "full", F.col("cap") * weight_left <= F.col("weight") * (F.col("budget") - held)
    )
    kept = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)
    free = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family)
    return full.select(*parents, level, "cap", "full", "weight", "budget", kept.alias("kept"), free.alias("free")).select(
        *parents,
        level,
        F.expr("case when full then cap else (weight * (budget - kept)) div free end").alias("budget"),
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, lang, source, tokens, budget)`` from the leaves' tokens; one row per leaf."""
    caps = leaves.select(*LEAF, (F.col("tokens") * mix.max_epochs).alias("cap"))
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * mix.share).alias("t"), F.sum("tokens").alias("all"))
    found = total.select(F.expr(f"least(t div 100, all * {mix.max_epochs})").alias("budget"))
    for depth, level in enumerate(LEAF):
        nodes = caps.groupBy(*LEAF[: depth + 1]).agg(F.sum("cap").alias("cap"))
        found = _allot(nodes, LEAF[:depth], level, found, mix)
    return found.join(leaves, LEAF)


def place(mix: Mix, epoch: Column, row_id: Column) -> Column:
    """Where a row stands in a seeded epoch: a hexadecimal digest of seed, epoch and id."""
    text = F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(row_id.cast("string"), F.lit("")))
    return F.md5(text.cast("binary"))


def cuts(sized: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, lang, source, epochs, cut)``: whole epochs of each leaf and where its last, partial one ends.

    Rows up to ``cut`` are in the partial epoch; it is null for a leaf without tokens, of which nothing is taken.  A leaf's rows are first summed by the leading digits of
    their place, so only those that share the digits of the cut are ordered: one in 4,096 of a leaf's rows.
    Rows of equal place (repeated ids) are taken together or not at all.
    """
    leaves = sized.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    planned = store(
        budgets(leaves, mix).select(
            *LEAF,
            F.expr("case when tokens > 0 then budget div tokens else 0 end").alias("epochs"),
            F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("rest"),
        )
    )
    placed = sized.join(planned, LEAF).withColumn("place", place(mix, F.col("epochs"), F.col("id")))
    digits = F.substring("place", 1, DIGITS)
    order = Window.partitionBy(*LEAF).orderBy("digits")
    sums = (
        placed.groupBy(*LEAF, digits.alias("digits"), "rest")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("until", F.sum("tokens").over(order))
    )
    last = store(
        sums.where("until > rest").groupBy(*LEAF).agg(
            F.min("digits").alias("last"), F.min_by(F.col("until") - F.col("tokens"), "digits").alias("base")
        )
    )
    running = Window.partitionBy(*LEAF).orderBy("place")
    inside = (
        placed.join(last, LEAF)
        .where(digits == F.col("last"))
        .withColumn("until", F.col("base") + F.sum("tokens").over(running))
        .where("until <= rest")
        .groupBy(*LEAF)
        .agg(F.max("place").alias("cut"))
    )
    # Rows before the last digits are in; without a row among these, the cut lies right before them.
    return planned.join(last, LEAF, "left").join(inside, LEAF, "left").select(
        *LEAF,
        "epochs",
        F.coalesce("cut", "last").alias("cut"),
    )


def choose(docs: DataFrame, mix: Mix) -> DataFrame:
    """``(id, domain, lang, source, tokens, copies)`` of the rows taken at least once.

    A text without words costs nothing and is taken where its place is before the cut.  Null ids share one
    place per leaf.  An empty table gives no rows.
    """
    sized = store(with_leaf(docs, mix))
    return _counted(sized, cuts(sized, mix), mix).where("copies > 0").select("id", *LEAF, "tokens", "copies")


def _counted(rows: DataFrame, ends: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with ``copies``; the leaves' few rows are joined to them."""
    joined = rows.join(store(ends), LEAF)
    inside = place(mix, F.col("epochs"), F.col("id")) <= F.col("cut")
    return joined.withColumn("copies", (F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("long")).cast("long"))


def mix_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows and columns of ``docs`` that the mix takes, each as often as it takes it.

    Only the leaves' cuts are joined to the documents, so texts are not shuffled.
    """
    ends = cuts(store(with_leaf(docs, mix)), mix)
    keyed = docs.withColumn("__row", F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]))
    home = {s: domain for domain, sources in mix.domains.items() for s in sources}
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = keyed.select(
        F.col("doc_id").cast("long").alias("id"),
        _lookup(home, source, "other").alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        source.alias("source"),
        "__row",
    )
    taken = _counted(rows, ends, mix).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(
        *[F.col(f"__row.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    )


#: The domains and weights of the registered query.
PRODUCTION = Mix(
    domains={
        "web": tuple(f"src{k}" for k in range(10)),
        "books": tuple(f"src{k}" for k in range(10, 15)),
        "code": tuple(f"src{k}" for k in range(15, 20)),
    },
    domain_weights={"web": 5, "books": 3, "code": 2},
    lang_weights={"en": 4, "de": 2, "fr": 2, "es": 2},
    source_weights={"src0": 2},
)

#: The pipeline takes every row once at most and up to nine tenths of all tokens.
PIPELINE = replace(PRODUCTION, share=90, max_epochs=1)
