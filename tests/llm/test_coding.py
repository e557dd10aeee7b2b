from __future__ import annotations

import random
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

from tillwise.llm import pieces, tokencount
from tillwise.llm.agenda import Memo, merge
from tillwise.llm.queries import QUERIES, vocabulary

PIECES, WORDS = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
FIXED = [
    "", " ", "  a  b", "▁x ▁▁ y", "a\0b \x1c \x85 \xa0x", "<s> </s> <unk> <0x41>", "日本語🙂 ñandú", "\ta\n\n b", "ﬁne é",
    "İstanbul Σας ŉ", "a" * 3000, "<|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "don't I'LL we've 'S", "é", "12 ¹²³ Ⅷ",
    "x" * 500 + " y", "​﻿　 a", "▁", "\n", "a ", "a▁",
]


def drawn(count):
    random.seed(9)
    letters = list("abcABZ 's<|>\n\tñßé▁0Σσ’")
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(count)]


def test_pieces_as_the_library():
    coder = pieces.coder(PIECES)
    texts = FIXED + drawn(1500)
    got = coder.encode(texts)
    assert [ids for ids, _ in got] == coder.library.encode(texts)
    assert [text for _, text in got] == [",".join(map(str, ids)) for ids, _ in got]
    assert coder.encode([None]) == [([], "")]


def test_a_wrong_merge_is_noticed():
    coder = pieces.PieceCoder(PIECES)
    coder.scores.clear()
    with pytest.raises(ValueError, match="the library"):
        coder.encode(["the thing"])


def test_new_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    coder, texts = pieces.PieceCoder(PIECES), drawn(400)
    for at in range(0, 400, 7):
        some = texts[at : at + 7]
        assert [ids for ids, _ in coder.encode(some)] == coder.library.encode(some)


def test_token_counts_as_the_library():
    counter = tokencount.WordCounter(WORDS)
    library = Tokenizer.from_file(WORDS)
    texts = FIXED + drawn(1500)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want
    assert counter.count([None]) == [0]
    assert len(counter.whole) > 10_000 and all(counter.merged(w) == 1 for w in list(counter.whole)[:200])


def test_merge_and_memo():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("a", "a"): 3}
    assert merge(list("abc"), ranks) == ["abc"]
    assert merge(list("aaa"), ranks) == ["aa", "a"]
    assert merge(list("xabc"), {"ab": 1, "bc": 0, "abc": 2}, joined=True) == ["x", "abc"]
    assert merge([], ranks) == [] and merge(["x"], ranks) == ["x"]
    memo, asked = Memo(2), []

    def make(keys):
        asked.extend(keys)
        return [k * 2 for k in keys]

    for keys in ({"a", "b"}, {"a"}, {"a", "c"}, {"b", "d"}):
        assert all(memo.ensure(keys, make)[k] == k * 2 for k in keys)
    assert asked.count("a") == 1


@pytest.mark.parametrize("name", ["op1_piece_coding", "op8_token_counts"])
def test_queries_as_the_libraries(spark, data, name):
    got = {r.doc_id: r for r in QUERIES[name](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    library, words = pieces.coder(PIECES).library, Tokenizer.from_file(WORDS)
    for d in docs:
        row, text = got[d.doc_id], d.text or ""
        if name == "op1_piece_coding":
            ids = library.encode(text)
            digests = [sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
            assert [row.n_tokens, row.ids_sha256, row.decoded_sha256] == [len(ids), *digests]
        else:
            n = len(words.encode(text, add_special_tokens=False).ids)
            assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 2048)


def test_odd_rows(odd, none):
    made = pieces.encode_decode(odd, PIECES, with_ids=True).collect()
    assert len(made) == odd.count() and all(len(r.ids) == r.n_tokens for r in made)
    assert {r.id: r.n_tokens for r in made}[2] == 0
    counted = {r.id: r for r in tokencount.count_tokens(odd, WORDS).collect()}
    assert counted[2].n_tokens == counted[3].n_tokens == counted[4].n_tokens == 0 and counted[6].over_limit
    assert pieces.encode_decode(none, PIECES).count() == tokencount.count_tokens(none, WORDS).count() == 0
