"""Personal data in texts, also where it is disguised, as spans of the source.

A text is searched as it is.  Then transducers rewrite it, each keeping where its output comes from: look-alike characters to
ASCII, invisible ones to nothing, spelled digits to digits, "at" and "dot" to their signs.  What is found in the
rewritten text and holds something rewritten is mapped back to the source characters it was made from.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.frames import per_batch

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins at the first digit of its run if it begins in that run at all; so runs are taken whole and scanned once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterable[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time: each holds one ``@``."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))


def ips(text: str) -> Iterable[Span]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterable[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterable[Span]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m.group())) <= 15:
            yield m.span()


def identifiers(text: str) -> dict[str, list[Span]]:
    """Spans per kind; kinds are independent of each other."""
    number = DIGITS.search(text) is not None
    return {
        "email": list(emails(text)) if "@" in text else [],
        "ip": list(ips(text)) if number else [],
        "card": list(cards(text)) if number else [],
        "phone": list(phones(text)) if number and "+" in text else [],
    }


# Letters of other scripts that look like the Latin letter or digit after them.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
# Characters that are not seen.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits, plus and dot in words, in English, German, French and Spanish.
SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve", "+": "plus más mas", ".": "dot punkt point punto",
}
SIGN = {word: sign for sign, words in SPELLED.items() for word in words.split()}
#: Spelled signs in a row that are taken for a number.
IN_A_ROW = 7

_WORD = "|".join(sorted(SIGN, key=len, reverse=True))
_GAP = r"[ \t,_/-]{1,3}"
SPELLED_RUN = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)(?:{_GAP}(?:{_WORD})(?!\w)){{{IN_A_ROW - 1},}}", re.IGNORECASE)
GAPS = re.compile("[,_/-]")
ONE_SIGN = re.compile(rf"(?:{_WORD})(?!\w)", re.IGNORECASE)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_AT = r"(?:[ \t]*[(\[{<][ \t]*(?:at|@|arroba)[ \t]*[)\]}>][ \t]*|[ \t]+(?:at|arroba)[ \t]+|[ \t]*@[ \t]*)"
_DOT = r"(?:[ \t]*[(\[{<][ \t]*(?:dot|punkt|point|punto|\.)[ \t]*[)\]}>][ \t]*|[ \t]+(?:dot|punkt|point|punto)[ \t]+|\.)"
#: Local part, "at", labels with "dot" between them; at least one of the signs is disguised, or the match changes nothing.
DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]{{1,64}}+)(?P<at>{_AT})(?P<host>{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}})(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
DOT_IN_HOST = re.compile(_DOT, re.IGNORECASE)
#: Without one of these, in lower case, there is no disguised address.
HINTS = (" @", "@ ", "\t@", "@\t", *(f"{a}{word}{b}" for word in ("dot", "punkt", "point", "punto") for a in " \t" for b in " \t"))
BRACKETED = re.compile(r"[(\[{<][ \t]*(?:at|arroba|dot|punkt|point|punto|@|\.)[ \t]*[)\]}>]", re.IGNORECASE)
BARE = re.compile(r"[ \t]+\w+[ \t]+")
# Last labels after which bare words "at" and "dot" are taken for signs.
ENDINGS = frozenset("com org net edu gov mil int info biz io eu uk de fr es it nl at ch be pt us ca mx ar br cl co pe".split())


def look_alike_table() -> dict[int, str]:
    """Single characters to the ASCII they stand for: those listed, and those whose compatibility form is one ASCII character."""
    blocks = [(0x2070, 0x209F), (0x2460, 0x2468), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)]
    made = {ord(c): sign for c, sign in LOOK_ALIKES.items()}
    for start, end in blocks:
        for code in range(start, end):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                made[code] = plain
    for start in (0x0660, 0x06F0, 0x0966):  # decimal digits of other scripts, in order
        made |= {start + k: str(k) for k in range(10)}
    return made


LOOKS = look_alike_table()
LOOKS |= {ord(c): "" for c in INVISIBLE}
IN_LATIN_1 = [chr(c) for c in LOOKS if c < 256]


class Traced:
    """A rewritten text that knows for each of its characters which characters of the source it was made from."""

    def __init__(self, text: str):
        self.text = text
        self.edits: list[list[tuple[int, int, int, int]]] = []  # per rewriting: (start, end) in its input, (start, end) in its output

    def rewrite(self, pieces: Iterable[tuple[int, int, str]]) -> None:
        """Put each text in the place of ``[start, end)``; pieces ascend and do not overlap."""
        out, edits, at, size = [], [], 0, 0
        for start, end, new in pieces:
            out += [self.text[at:start], new]
            size += start - at
            edits.append((start, end, size, size + len(new)))
            size += len(new)
            at = end
        if edits:
            self.text = "".join(out) + self.text[at:]
            self.edits.append(edits)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source of ``[start, end)``, and whether any of it was rewritten."""
        changed = False
        for edits in reversed(self.edits):
            first, last = self._before(edits, start), self._before(edits, end - 1)
            changed = changed or any(e[3] > start and e[2] < end or start < e[2] == e[3] < end for e in edits[max(first[1] - 1, 0) : last[1] + 1])
            start, end = first[0][0], last[0][1]
        return start, end, changed

    @staticmethod
    def _before(edits: list, at: int) -> tuple[Span, int]:
        """Where one character comes from, and how many edits begin at or before it."""
        k = bisect_right(edits, at, key=lambda e: e[2])
        if not k:
            return (at, at + 1), 0
        start, end, begin, stop = edits[k - 1]
        if at < stop:
            return ((start, end) if end - start != stop - begin else (start + at - begin, start + at - begin + 1)), k
        return (end + at - stop, end + at - stop + 1), k


def plain_looks(text: str) -> Iterable[tuple[int, int, str]]:
    """Look-alike characters to ASCII, invisible ones to nothing."""
    if text.isascii():
        return
    try:
        text.encode("latin-1")
        odd = [c for c in IN_LATIN_1 if c in text]
    except UnicodeEncodeError:
        odd = [c for c in set(text) if ord(c) in LOOKS]
    if odd:
        for m in re.finditer(f"[{''.join(map(re.escape, sorted(odd)))}]", text):
            yield m.start(), m.end(), LOOKS[ord(m.group())]


def plain_digits(text: str) -> Iterable[tuple[int, int, str]]:
    """Rows of spelled signs to the signs; gaps between them go."""
    words = GAPS.sub(" ", text).lower().split() if GAPS.search(text) else text.lower().split()
    if sum(map(SIGN.__contains__, words)) < IN_A_ROW - 1:  # a stop may follow the last one
        return
    for run in SPELLED_RUN.finditer(text):
        at = run.start()
        while at < run.end():
            word = ONE_SIGN.match(text, at)
            follow = ONE_SIGN.search(text, word.end(), run.end())
            end = follow.start() if follow else word.end()
            yield at, word.end(), SIGN[word.group().lower()]
            if follow:
                yield word.end(), end, ""
            at = end if follow else run.end()


def plain_signs(text: str) -> Iterable[tuple[int, int, str]]:
    """The "at" and the "dot"s of disguised addresses to ``@`` and ``.``; a bare word "at" needs a disguised "dot" with it
    and a usual ending."""
    low = text.lower()
    if not any(hint in low for hint in HINTS) and not (any(b in text for b in "([{<") and BRACKETED.search(text)):
        return
    for m in DISGUISED.finditer(text):
        dots = [d for d in DOT_IN_HOST.finditer(text, *m.span("host")) if d.group() != "."]
        bare = BARE.fullmatch(m["at"]) is not None and m["at"].strip() != "@"
        ending = m["host"].replace(".", " ").split()[-1].lower()
        if (dots and ending in ENDINGS) if bare else (dots or m["at"] != "@"):
            yield *m.span("at"), "@"
            yield from ((*d.span(), ".") for d in dots)


TRANSDUCERS: tuple[Callable[[str], Iterable[tuple[int, int, str]]], ...] = (plain_looks, plain_digits, plain_signs)


def find(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """``(kind, start, end, plain, value)`` by start, then kind: spans found in the text itself (``plain``), and those found in
    the rewritten text that hold something rewritten and meet no plain span of their kind; ``value`` is as rewritten."""
    text = text or ""
    plain = identifiers(text)
    found = [(kind, a, b, True, text[a:b]) for kind in KINDS for a, b in plain[kind]]
    traced = Traced(text)
    for transducer in TRANSDUCERS:
        traced.rewrite(transducer(traced.text))
    if traced.edits:
        for kind, spans in identifiers(traced.text).items():
            for a, b in spans:
                start, end, changed = traced.source(a, b)
                if changed and not any(start < y and x < end for x, y in plain[kind]):
                    found.append((kind, start, end, False, traced.text[a:b]))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


SPANS = "array<struct<kind: string, start: long, end: long, plain: boolean, value: string>>"


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, spans)`` per row; see ``find``.  Positions count code points, ends are exclusive.

    Null and empty texts have no spans; whole texts are searched, in time that grows with their length; repeated rows come out
    repeatedly; an empty table gives no rows.
    """
    kinds = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("value", pa.string())]
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.struct(kinds)))])
    names = [name for name, _ in kinds]

    def run(keys: list, texts: list) -> list:
        return [keys, [[dict(zip(names, span)) for span in find(t)] for t in texts]]

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(
        per_batch(run, schema, rows=512), f"id long, spans {SPANS}"
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
