"""Token counts for a word-level byte-pair vocabulary, with a shortcut for words that are one token.

Which strings of the vocabulary encode alone as one token is proved once, by merging each of them.  In texts, pre-tokens
among those strings count as one; only the rest is merged.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.agenda import Memo, merge
from tillwise.llm.frames import per_batch

#: Characters below this have the same classes and lower case in every Unicode version, and no composition.
PLAIN = 0x250
KEPT, LONGEST = 400_000, 64


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones for themselves,
    the others for those from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordCounter:
    """Counts tokens as the tokenizers library does with one file, without special tokens added."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        kinds = [n["type"] for n in stated["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a lower-cased byte-pair vocabulary with word ends")
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.vocabulary = model["vocab"]
        self.letters = byte_letters()
        specials = sorted((t["content"] for t in stated["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        own = [chr(c) for c in range(PLAIN)]
        letters, numbers = (
            "".join(re.escape(c) for c in own if unicodedata.category(c)[0] == kind) for kind in "LN"
        )
        spaces = r"\t\n\x0b\x0c\r \xa0"
        # Fixed value: contractions, letters, single digits and the rest, as the file's own pattern has them.
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"
        )
        self.odd = re.compile(f"[\x00\x1c-\x1f\x85{chr(PLAIN)}-\U0010ffff]")
        self.whole = whole if whole is not None else self.prove()
        self.memo = Memo(KEPT)

    def prove(self) -> frozenset[str]:
        """Words, in byte letters, that merging alone turns into one token."""
        ended = [v[: -len(self.end)] for v in self.vocabulary if v.endswith(self.end)]
        return frozenset(w for w in ended if w and self.merged(w) == 1)

    def merged(self, word: str) -> int:
        """Number of tokens of a pre-token given in byte letters."""
        return len(merge([*word[:-1], word[-1] + self.end], self.ranks))

    def in_letters(self, word: str) -> str:
        letters = self.letters
        return word if word.isascii() and word.isprintable() else "".join(letters[b] for b in word.encode("utf-8"))

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in byte letters or, where they are plain ones, as they are."""
        if not self.odd.search(text):
            return self.words.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return ["\0" + word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _counts(self, words: list[str]) -> list[int]:
        spelt = [w[1:] if w[0] == "\0" and len(w) > 1 else self.in_letters(w) for w in words]
        return [1 if w in self.whole else self.merged(w) for w in spelt]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null counts as empty.  Special strings inside a text are one token each."""
        extra, cut = [], []
        for text in texts:
            segments = self.special.split(text or "")
            extra.append(len(segments) - 1)
            cut.append([w for s in segments if s for w in self.pre_tokens(s)])
        seen = set().union(*cut) if cut else set()
        short = {w for w in seen if len(w) <= LONGEST}
        known = self.memo.ensure(short, self._counts)
        long = list(seen - short)
        known.update(zip(long, self._counts(long)))
        counts = [more + sum(map(known.__getitem__, words)) for more, words in zip(extra, cut)]
        for word in long:  # not kept
            del known[word]
        return counts




def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row; null and empty texts have none.

    The proved words (as many at most as the vocabulary has) reach the executors as one broadcast.
    Repeated rows come out repeatedly; an empty table gives no rows.
    """
    proved = docs.sparkSession.sparkContext.broadcast(WordCounter(vocabulary).whole)
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]

    def run(keys: list, texts: list) -> list:
        own, tokens = _shared(vocabulary, proved), []
        for start in range(0, len(texts), 128):
            tokens += own.count(texts[start : start + 128])
        sizes = [len((t or "").encode("utf-8")) for t in texts]
        return [keys, sizes, tokens, [n > limit for n in tokens]]

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(
        per_batch(run, pa.schema(fields), rows=512), "id long, n_bytes long, n_tokens long, over_limit boolean"
    )


_COUNTERS: dict[str, WordCounter] = {}


def _shared(path: str, proved) -> WordCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path, proved.value)
    return _COUNTERS[path]
