"""Words that are likely misspellings of a much more frequent word one edit away, and what they lead to.

Of two words one edit apart, one half of either is whole in the other.  So every word is filed under its first and its last
half, and asks where its own halves are filed.  What is filed together is indexed as one delimited text in two FM indexes,
for reading onward and for reading backward.  A search narrows an interval of suffix ranks over one half exactly, and across
the other half leaves the interval with one error, at every rank of a narrow one and by every letter of a wide one, after which
the rest must match again.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.frames import store

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF.  Only A-Z are lower-cased.
LETTER = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of an index, letters of one (a longer word counts as several), and ranks or states looked at together.
ENTRIES, LETTERS, TOGETHER = 20_000, 32, 200_000
#: An interval of more ranks than so many for each letter is left by letters, and its parts are narrowed until few ranks are left.
WIDE, FEW = 8, 16
END, DELIMITER = 0, 1  # symbols; letters follow


def runs(docs: DataFrame, id_column: str, text: str, least: int) -> DataFrame:
    """``(doc, run)``: every maximal run of ``least`` letters or more, A-Z lower-cased; null texts have none."""
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTER}]{{{least},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    return each.withColumn("run", F.translate("run", UPPER, LOWER))


def with_losses(run: Column, doc: Column, every: int) -> Column:
    """``run`` without the code point at its hash modulo its length, where ``every`` divides the hash of document and run."""
    hashed = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = F.pmod(hashed, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(hashed % every == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    """``(word, n)``: words of ``least`` code points and ``occurrences`` or more; counted before they are shuffled."""
    counted = words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= occurrences)


class Index:
    """FM index over delimited sequences of symbols (letters are 2 and up), searched onward from their first symbol."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        """``starts`` are the places in ``symbols`` where the sequences begin, and the end of the last one."""
        sizes = np.diff(starts)
        # The text holds the sequences backward, as an FM index reads backward: delimiter, sequence, ..., delimiter, end.
        at = starts[:-1] + np.arange(len(sizes))  # of the delimiter before each sequence
        text = np.full(len(symbols) + len(sizes) + 2, DELIMITER, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(symbols)) - starts[owner]
        text[at[owner] + sizes[owner] - inside] = symbols
        text[-1] = END
        order = suffix_order(text)
        self.before = text[order - 1]  # the symbol before each suffix; the first suffix has the end before it
        by = np.argsort(self.before, kind="stable")
        self.back = np.empty(len(text), np.int64)  # rank of the suffix that is one symbol longer
        self.back[by] = np.arange(len(text))
        self.keys = self.before[by] * len(text) + by
        place = np.full(len(text), -1)
        place[at] = np.arange(len(sizes))
        self.sequence = place[order]  # which sequence follows the delimiter a suffix starts with
        self.letters = np.unique(symbols)

    def narrowed(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """A bound of the interval after one more symbol."""
        return np.searchsorted(self.keys, symbol * len(self.before) + rank)

    def within_one_edit(self, queries: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, sequence)`` pairs: sequences with the query's first ``exact`` symbols and one edit behind them.

        ``queries`` is a matrix with a row per query, padded with two delimiters or more.
        """
        count = len(queries)
        begin = np.zeros(count, np.int64)
        delimiters = np.full(count, DELIMITER)
        low, high = self.narrowed(delimiters, begin), self.narrowed(delimiters, begin + len(self.before))
        live, states, held, pairs = np.arange(count), [], 0, [np.empty(0, np.int64)]
        for t in range(int(sizes.max(initial=0)) + 1):
            live = live[(sizes[live] >= t) & (low[live] < high[live])]
            asking = live[exact[live] <= t]
            wide = high[asking] - low[asking] > WIDE * len(self.letters)
            for leave, some in ((self._branches, asking[~wide]), (self._branches_by_letter, asking[wide])):
                for state in leave(queries, sizes, some, low, high, t) if len(some) else ():
                    states.append(state)
                    held += len(state[0])
                    if held > TOGETHER:
                        pairs.append(self._followed(queries, sizes, states))
                        states, held = [], 0
            live = live[sizes[live] > t]
            if not len(live):
                break
            symbol = queries[live, t]
            low[live], high[live] = self.narrowed(symbol, low[live]), self.narrowed(symbol, high[live])
        pairs.append(self._followed(queries, sizes, states))
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.before))

    def _followed(self, queries, sizes, states) -> np.ndarray:
        """Pairs, as one number each, of the states that match to the end and the delimiter."""
        if not states:
            return np.empty(0, np.int64)
        query, place, rank = (np.concatenate(x) for x in zip(*states))
        pairs = [np.empty(0, np.int64)]  # none of the states may lead on
        while len(query):
            over = place > sizes[query]  # the delimiter was matched as well
            pairs.append(query[over] * len(self.before) + self.sequence[rank[over]])
            query, place, rank = query[~over], place[~over], rank[~over]
            same = self.before[rank] == queries[query, place]
            query, place, rank = query[same], place[same] + 1, self.back[rank[same]]
        return np.unique(np.concatenate(pairs))

    def _branches(self, queries, sizes, asking, low, high, t):
        """States ``(query, next place, rank)`` behind an error at ``t`` and the symbol that follows it."""
        width = high[asking] - low[asking]
        part = np.cumsum(width) // TOGETHER
        for cut in np.split(np.arange(len(asking)), np.flatnonzero(np.diff(part)) + 1):
            many = width[cut]
            query = np.repeat(asking[cut], many)
            if not len(query):
                continue
            rank = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[asking[cut]], many)
            symbol, after = self.before[rank], self.back[rank]
            following = self.before[after]
            here, there = queries[query, t], queries[query, t + 1]
            letter, inside = symbol > DELIMITER, sizes[query] > t
            replaced = letter & inside & (symbol != here) & (following == there)
            added = letter & (following == here)
            lost = inside & (symbol == there)
            yield query[replaced], np.full(replaced.sum(), t + 2), self.back[after[replaced]]
            yield query[added], np.full(added.sum(), t + 1), self.back[after[added]]
            yield query[lost], np.full(lost.sum(), t + 2), after[lost]

    def _branches_by_letter(self, queries, sizes, asking, low, high, t):
        """As ``_branches``, at a cost that does not grow with the intervals: letters narrow them, and so does what must match."""
        for start in range(0, len(asking), max(1, TOGETHER // (4 * len(self.letters)))):
            cut = asking[start : start + max(1, TOGETHER // (4 * len(self.letters)))]
            inside = cut[sizes[cut] > t]
            there = queries[inside, t + 1]
            yield from self._few(queries, sizes, inside, t + 2, self.narrowed(there, low[inside]), self.narrowed(there, high[inside]))
            query, letter = np.repeat(cut, len(self.letters)), np.tile(self.letters, len(cut))
            begin, end = self.narrowed(letter, low[query]), self.narrowed(letter, high[query])
            some = begin < end
            query, letter, begin, end = query[some], letter[some], begin[some], end[some]
            here = queries[query, t]
            yield from self._few(queries, sizes, query, t + 1, self.narrowed(here, begin), self.narrowed(here, end))
            some = (letter != here) & (sizes[query] > t)
            query, begin, end = query[some], begin[some], end[some]
            there = queries[query, t + 1]
            yield from self._few(queries, sizes, query, t + 2, self.narrowed(there, begin), self.narrowed(there, end))

    def _few(self, queries, sizes, query, place, begin, end):
        """States ``(query, next place, rank)`` of intervals that are matched onward until few ranks are left of each."""
        while len(query):
            some = begin < end
            query, begin, end = query[some], begin[some], end[some]
            few = (end - begin <= FEW) | (place > sizes[query])
            many = (end - begin)[few]
            rank = np.arange(many.sum()) + np.repeat(begin[few] - (np.cumsum(many) - many), many)
            yield np.repeat(query[few], many), np.full(len(rank), place), rank
            query, begin, end = query[~few], begin[~few], end[~few]
            symbol = queries[query, place] if len(query) else query
            begin, end, place = self.narrowed(symbol, begin), self.narrowed(symbol, end), place + 1


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text whose last symbol is its only smallest one, by doubling the length that is told apart."""
    n, bits = len(text), int(text.max()).bit_length()
    length = 62 // bits
    padded = np.concatenate([text, np.zeros(length, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(length):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        follow = np.zeros(n, np.int64)
        if length < n:
            follow[: n - length] = rank[length:] + 1
        key, length = rank * (n + 1) + follow, 2 * length


def search(held: list[str], queries: list[str], head: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(query, near)``: numbers of queries and of ``held`` words one edit away that share the query's first half with ``head``,
    else its last half but not its first.  ``held`` words must be distinct."""
    read = (lambda w: w) if head else (lambda w: w[::-1])
    everything = "".join([read(w) for w in held] + [read(w) for w in queries])
    points = np.frombuffer(everything.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.unique(points, return_inverse=True)[1].astype(np.int64) + DELIMITER + 1
    sizes = np.array([len(w) for w in [*held, *queries]], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    index = Index(symbols[: starts[len(held)]], starts[: len(held) + 1])
    own_sizes, own_starts = sizes[len(held) :], starts[len(held) : -1]
    exact = own_sizes // 2 if head else own_sizes - own_sizes // 2
    out_query, out_near = [], []
    # Queries of like length together, so that a long word widens no other's row.
    kind = np.maximum(5, np.ceil(np.log2(own_sizes + 1)).astype(int))
    for size in np.unique(kind):
        chosen = np.flatnonzero(kind == size)
        matrix = np.full((len(chosen), int(own_sizes[chosen].max()) + 2), DELIMITER, np.int64)
        column = np.arange(matrix.shape[1])
        real = column < own_sizes[chosen][:, None]
        matrix[real] = symbols[(own_starts[chosen][:, None] + column)[real]]
        query, found = index.within_one_edit(matrix, own_sizes[chosen], exact[chosen])
        out_query.append(chosen[query])
        out_near.append(found)
    query = np.concatenate(out_query) if out_query else np.empty(0, np.int64)
    found = np.concatenate(out_near) if out_near else np.empty(0, np.int64)
    if not head:
        halves = [w[: len(w) // 2] for w in queries]
        new = np.fromiter((not held[v].startswith(halves[q]) for q, v in zip(query.tolist(), found.tolist())), bool, len(query))
        query, found = query[new], found[new]
    return query, found


def filed(words: DataFrame, entries: int) -> DataFrame:
    """``words(word, n)`` filed under their halves: ``(head, bucket, hot, slice, word, n, asks, held)``.

    A near word may be one longer or shorter, so every word is filed under the halves a word of such a length would have,
    two on each side, and asks under its own.  Halves that more than ``entries`` words are filed under are cut into slices, so that
    an index stays bounded; their words ask in each slice, and no other half is filed with them.  A word of over ``LETTERS`` letters
    counts as several, so an index is bounded in letters as well.
    """
    size = F.length("word")
    load = F.ceil(F.length("word") / LETTERS)
    half = lambda head, n: F.struct(
        F.lit(head).alias("head"),
        (F.substring("word", F.lit(1), n) if head else F.substring("word", size - n + 1, n)).alias("half"),
        (n == (F.floor(size / 2) if head else size - F.floor(size / 2))).alias("asks"),
    )
    lengths = [(True, F.floor((size - 1) / 2)), (True, F.floor((size + 1) / 2)), (False, F.floor(size / 2)), (False, F.floor(size / 2) + 1)]
    each = F.explode(F.array(*[half(head, n.cast("int")) for head, n in lengths])).alias("e")
    entry = words.select("word", "n", each).select("word", "n", "e.*")
    hot = store(entry.groupBy("head", "half").agg(F.sum(load).alias("many")).where(F.col("many") > entries))
    total = (words.agg(F.sum(load)).first()[0] or 0) * 4
    buckets = max(1, ceil(total / entries))
    slices = F.coalesce(F.ceil(F.col("many") / entries), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    placed = (
        entry.join(hot, ["head", "half"], "left")
        .withColumn("slices", slices)
        .withColumn("bucket", F.pmod(F.xxhash64("head", "half"), F.lit(buckets)).cast("int"))
        .withColumn("hot", F.when(F.col("many").isNotNull(), F.col("half")))
        .withColumn("own", own)
    )
    every = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("own"))
    return placed.withColumn("slice", F.explode(every)).select(
        "head", "bucket", "hot", "slice", "word", "n", "asks", (F.col("slice") == F.col("own")).alias("held")
    )


NEAR = "word string, n long, n_near long, best string, best_n long"


def near_words(words: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """``(word, n, n_near, best, best_n)`` for every row of ``words(word, n)``, whose words are distinct.

    ``n_near`` counts the words that differ by one inserted, deleted or replaced code point; ``best`` is the one of largest n,
    ties to the smallest in code-point order, or null.  Exact: every near word is found on the side its whole half names,
    in one slice, and once.  An empty table gives no rows.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        counts = dict(zip(group["word"].to_pylist(), group["n"].to_pylist()))
        chosen = lambda flag: sorted(set(group.filter(group[flag])["word"].to_pylist()))
        held, queries = chosen("held"), chosen("asks")
        own = np.array([counts[w] for w in held], np.int64)
        query, found = search(held, queries, group["head"][0].as_py()) if held and queries else (np.empty(0, np.int64),) * 2
        order = np.lexsort((found, -own[found], query))
        first = order[np.concatenate([[True], np.diff(query[order]) != 0])] if len(order) else order
        best = dict(zip(query[first].tolist(), found[first].tolist()))
        many = np.bincount(query, minlength=len(queries))
        names = [held[best[q]] if q in best else None for q in range(len(queries))]
        columns = [queries, [counts[w] for w in queries], many, names, [None if b is None else counts[b] for b in names]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = filed(words, entries).groupBy("head", "bucket", "hot", "slice").applyInArrow(run, NEAR)
    place = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("best")))
    return (
        parts.groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(place).alias("first"))
        .select("word", "n", "n_near", F.col("first.best").alias("best"), (-F.col("first.order")).alias("best_n"))
    )


def with_forms(found: DataFrame, factor: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` from ``near_words``: the best near word is the form if it is ``factor`` times as frequent.

    ``root`` follows forms to the last.  Every step multiplies n, so chains are short, and each round doubles the steps taken.
    """
    is_form = F.col("best_n") >= factor * F.col("n")
    words = store(
        found.select(
            "word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")
        )
    )
    led = store(words.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = led.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        led = store(led.join(onward, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if led.where("moved").limit(1).count() == 0:
            break
    return words.join(led.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 7, occurrences: int = 2, every: int = 0, factor: int = 10
) -> DataFrame:
    """``with_forms`` over all words of all texts.  ``every`` above 0 plants errors first: see ``with_losses``.

    Words are distinct runs of letters of ``least`` code points and ``occurrences`` or more in all texts, repeated rows included.
    Null and empty texts have none; a null id hashes as the empty text; very long words are words like others.
    """
    found = runs(docs, id_column, text, least)
    word = with_losses(F.col("run"), F.col("doc"), every) if every else F.col("run")
    words = store(vocabulary(found.select(word.alias("word")), least, occurrences))
    return with_forms(near_words(words), factor)
