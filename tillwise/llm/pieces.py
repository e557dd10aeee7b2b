"""Encoding with merge-type SentencePiece vocabularies by an agenda of scored pairs, and decoding.

A text is cut where no piece can reach across: before a run of word marks that follows another character, and around
characters that are in no piece of several characters.  Both are read off the vocabulary.  Every distinct part is encoded once per worker and cache
generation by the agenda, and checked in the same Arrow batch against the sentencepiece library.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.agenda import Memo, merge
from tillwise.llm.frames import per_batch

MARK = "▁"
#: Parts whose ids a worker keeps; parts over LONGEST characters are not kept.
KEPT, LONGEST = 350_000, 64


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, kept: int = KEPT):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.unknown = library.unk_id()
        self.scores, self.ids, self.bytes = {}, {}, {}
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i)):
                self.scores[piece], self.ids[piece] = -library.get_score(i), i
        joined = {c for piece in self.scores if len(piece) > 1 for c in piece}
        lone = "".join(c for c in map(chr, range(128)) if c not in joined and c != " ")
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.scores):
            self.cut = re.compile("(?s).+")  # a piece reaches over a word's end: texts stay whole
        else:
            some = re.escape(lone)
            self.cut = re.compile(f"{MARK}+[^{MARK}{some}]*|[^{MARK}{some}]+" + (f"|[{some}]" if lone else ""))
        self.lone = lone[:1]
        self.lead = len(library.encode(self.lone)) - 1 if lone else 0
        self.memo = Memo(kept)

    def merged(self, part: str) -> tuple[int, ...]:
        """Ids of one part, by the agenda; characters without a piece become their bytes, or the unknown id."""
        found = []
        for symbol in merge(list(part), self.scores, joined=True):
            i = self.ids.get(symbol)
            if i is not None:
                found.append(i)
            elif self.bytes:
                found.extend(self.bytes[b] for b in symbol.encode("utf-8"))
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return tuple(found)

    def checked(self, parts: list[str]) -> list[str]:
        """Ids of parts, joined by commas; an error if the library has other ids for one of them."""
        made = [self.merged(part) for part in parts]
        # The library puts a mark before each text; the lone character keeps what it is asked for from ending in one.
        asked = [(p[1:] if p[0] == MARK else self.lone + p) + self.lone for p in parts]
        said = self.library.encode(asked, num_threads=1)
        for part, ids, other in zip(parts, made, said):
            if list(ids) != other[0 if part[0] == MARK else self.lead + 1 : len(other) - self.lead]:
                raise ValueError(f"the library encodes {part!r} as {other}, the agenda as {ids}")
        return [",".join(map(str, ids)) for ids in made]

    def parts(self, text: str | None) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], str]]:
        """For each text its ids, and the same joined by commas; null counts as empty."""
        cut = [self.parts(text) for text in texts]
        young = self.memo.young
        new = {part for parts in cut for part in parts if part not in young}
        short = {part for part in new if len(part) <= LONGEST}
        if len(young) + len(short) > self.memo.limit:  # a new generation has to have all parts of these texts
            short = {part for parts in cut for part in parts if len(part) <= LONGEST}
        known = self.memo.ensure(short, self.checked)
        long = [part for part in new if len(part) > LONGEST]
        known.update(zip(long, self.checked(long)))
        out = []
        for parts in cut:
            listed = ",".join(map(known.__getitem__, parts))
            out.append((np.fromstring(listed, np.int32, sep=",").tolist() if listed else [], listed))
        for part in long:  # not kept
            del known[part]
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def coder(path: str, kept: int = KEPT) -> PieceCoder:
    """One per worker process, model file and number of parts that it keeps."""
    return PieceCoder(path, kept)


def encode_decode(
    docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = False, kept: int = KEPT
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256, decoded_same)`` per row, and ``ids`` if wanted.

    No begin or end ids, no sampling.  Null and empty texts have no ids and decode to the empty string.  A lone surrogate
    is replaced as UTF-8 cannot hold it.  Repeated rows come out repeatedly; an empty table gives no rows.  A worker keeps the ids
    of twice ``kept`` parts, also after its task.
    """
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string())]
    fields += [("decoded_sha256", pa.string()), ("decoded_same", pa.bool_())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(keys: list, texts: list) -> list:
        own, rows = coder(model, kept), []
        for start in range(0, len(texts), 64):
            some = texts[start : start + 64]
            found = own.encode(some)
            back = own.decode([ids for ids, _ in found])
            for text_, (ids, listed), decoded in zip(some, found, back):
                row = [len(ids), sha256(listed.encode()).hexdigest(), sha256(decoded.encode("utf-8")).hexdigest()]
                rows.append([*row, decoded == (text_ or ""), *([ids] if with_ids else [])])
        return [keys, *(map(list, zip(*rows)) if rows else [[]] * (len(fields) - 1))]

    sql = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_same boolean"
    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(
        per_batch(run, pa.schema(fields), rows=256), sql + (", ids array<int>" if with_ids else "")
    )
