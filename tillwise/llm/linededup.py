"""Lines that a site repeats on its pages: dropped by their frequency relative to the site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.frames import store

#: Tags after which a new line of text begins; other tags vanish.
SCRIPTS = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>"
BREAKS = r"(?i)</?(?:title|p|div|li|ul|nav|article|footer|header|h[1-6]|br|td|tr|table|pre|body)(?:[ /][^>]*)?>"
TAGS = r"(?s)<[^>]*>"
SCHEME_AND_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"

#: A line on so many different pages is frequent if the ratio says so, whatever the size of the host.
ENOUGH = 5
#: Fewer pages than this never show a line to be the host's own: two may be an article and its revision.
LEAST = 3
#: Stands for the page itself among the keys of its lines, which have 16 bytes.
PAGE = b""


def host_of(url: Column) -> Column:
    """Host of an absolute address in lower case; the empty string if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, SCHEME_AND_HOST, 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """Text of a page with a line per block of it; entities stay as they are."""
    shown = F.regexp_replace(html, SCRIPTS, "")
    return F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), TAGS, "")


def lines_of(text: Column) -> Column:
    """Lines between line feeds, as they are; null counts as empty."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.unhex(F.md5(F.trim(line)))


def pages_needed(pages: Column) -> Column:
    """On how many different pages a line must be to be judged by the ratio: ``ENOUGH``, or over half of a host of
    fewer than twice as many pages, but ``LEAST`` in any case."""
    return F.least(F.lit(ENOUGH), F.greatest(F.lit(LEAST), F.floor(pages / 2) + 1))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = 0.02) -> DataFrame:
    """``(host, line_key)``: lines on more than ``ratio`` of the different pages of a host, and on ``pages_needed`` of them.

    Pages of one host with the same whole text are one page, in the lines' counts and in the host's total, so copies of a
    page do not make its text frequent.  A line counts once per page.  What is shuffled is a 16-byte key per line and one
    per page text; a host or a line with a third of all pages is spread over its page texts and counted before it is brought together.
    """
    named = pages.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""), _key))
    keyed = named.select("host", F.unhex(F.md5("text")).alias("body"), F.concat(F.array(F.lit(PAGE)), keys).alias("keys"))
    once = keyed.groupBy("host", "body").agg(F.any_value("keys").alias("keys"))
    counted = once.select("host", F.explode("keys").alias("line_key")).groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n"))
    counted = store(counted.where((F.col("n") >= LEAST) | (F.col("line_key") == PAGE)))
    totals = counted.where(F.col("line_key") == PAGE).select("host", F.col("n").alias("pages"))
    often = (F.col("n") > ratio * F.col("pages")) & (F.col("n") >= pages_needed(F.col("pages")))
    return counted.where(F.col("line_key") != PAGE).join(totals, "host").where(often).select("host", "line_key")


def mark_lines(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = 0.02,
) -> DataFrame:
    """``pages`` with ``kept_text``, ``n_lines`` and ``n_dropped`` (which replace columns of these names); every row stays.

    Every page loses all frequent lines of its host; see ``boilerplate``.  A page and its revision on a small site
    share few enough pages to stay whole, and copies count as one page.  Null texts give an empty ``kept_text`` without lines; a
    null host is a host of its own; blank lines are never frequent.
    The frequent lines of a host are at most its mean number of lines per page divided by ``ratio``; they are
    gathered per host, stored, and joined to its pages; as both sides are then shuffled for the join alone,
    adaptive execution can split the pages of a hot host.
    """
    frequent = store(
        boilerplate(pages, host, text, ratio)
        .groupBy(F.col("host").alias("__host"))
        .agg(F.collect_set("line_key").alias("__frequent"))
    )
    named = pages.withColumn("__name", F.coalesce(F.col(host).cast("string"), F.lit("")))
    joined = named.join(frequent, F.col("__name") == F.col("__host"), "left")
    lines = F.when(F.col(text).isNull(), F.array().cast("array<string>")).otherwise(lines_of(F.col(text)))
    found = F.coalesce("__frequent", F.array().cast("array<binary>"))
    is_frequent = lambda x: (F.trim(x) != "") & F.array_contains(F.col("__found"), _key(x))
    kept = (
        joined.withColumn("__lines", lines)
        .withColumn("__found", found)
        .withColumn("__kept", F.filter("__lines", lambda x: ~is_frequent(x)))
        .withColumn("__full", F.size(F.filter("__lines", lambda x: F.trim(x) != "")))
        .withColumn("__dropped", F.size("__lines") - F.size("__kept"))
    )
    return (
        kept.withColumn("kept_text", F.array_join("__kept", "\n"))
        .withColumn("n_lines", F.col("__full").cast("long"))
        .withColumn("n_dropped", F.col("__dropped").cast("long"))
        .drop("__name", "__host", "__frequent", "__lines", "__found", "__kept", "__full", "__dropped")
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", **options
) -> DataFrame:
    """``docs`` with the frequent lines of their host taken out of ``text``; all rows and columns stay.

    A null text stays null.  Columns may have any names; they travel in a struct.
    """
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    packed = docs.select(F.col(host).alias("host"), F.col(text).alias("body"), row.alias("row"))
    marked = mark_lines(packed, "host", "body", **options)
    new = F.when(F.col("body").isNotNull(), F.col("kept_text"))
    return marked.select(
        *[(new if c == text else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)]
    )
