from __future__ import annotations

import hashlib
import random
import re

import pytest

from tillwise.llm import deobfuscate
from tillwise.llm.queries import QUERIES

KINDS = ("email", "ip", "card", "phone")


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        n = int(c)
        total += n if k % 2 == 0 else sum(map(int, str(2 * n)))
    return total % 10 == 0


def plain_spans(text):
    """The patterns as they are stated, with the library's own search."""
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and plain_luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


@pytest.mark.parametrize("seed", range(6))
def test_plain_spans_of_random_texts(seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "@", ".", "-", "+", "1", "255", "0300", "256", " ", "(", "x", "é", "4111 1111 1111 1111", "+49 30 123456", "1.2.3.4", "٣", "a.b@", "%"]
    for _ in range(2_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [(k, a, b) for k, a, b, plain, _ in deobfuscate.find(text) if plain] == plain_spans(text), text


@pytest.mark.parametrize(
    "before,hidden,after,kind,value",
    [
        ("mail ", "john.doe (at) example (dot) com", " now", "email", "john.doe@example.com"),
        ("mail ", "john [at] mail.example.com", "!", "email", "john@mail.example.com"),
        ("to ", "john at example dot com", ".", "email", "john@example.com"),
        ("to ", "JOHN AT example DOT CO DOT UK", ", ok", "email", "JOHN@example.CO.UK"),
        ("an ", "hans(at)beispiel punkt de", "", "email", "hans@beispiel.de"),
        ("to ", "john @ example.com", " x", "email", "john@example.com"),
        ("é ", "аdmin@exаmple.com", " é", "email", "admin@example.com"),
        ("x ", "b​ob@exam­ple.org", " y", "email", "bob@example.org"),
        ("", "ＪＯ@example。com", "", "email", "JO@example.com"),
        ("card ", "four one one one one one one one one one one one one one one one", ", end", "card", "4111111111111111"),
        ("card ", "４１１１ １１１１ 1111 1111", " é", "card", "4111 1111 1111 1111"),
        ("call ", "plus four nine, one five one, two three four five six seven", ".", "phone", "+49151234567"),
        ("tel ", "más tres cuatro seis uno dos tres cuatro cinco seis", "", "phone", "+346123456"),
        ("ip ", "one nine two dot one six eight dot one dot two", " ok", "ip", "192.168.1.2"),
        ("ip ", "١٩٢.168.1.2", " ok", "ip", "192.168.1.2"),
    ],
)
def test_disguises_map_back_to_the_source(before, hidden, after, kind, value):
    for around in ("", "plain a@b.de and 1.2.3.4, "):
        text = around + before + hidden + after
        added = [f for f in deobfuscate.find(text) if not f[3]]
        start = len(around) + len(before)
        assert added == [(kind, start, start + len(hidden), False, value)]
        assert [f[:3] for f in deobfuscate.find(text) if f[3]] == plain_spans(text)


@pytest.mark.parametrize(
    "text",
    ["me at example.com", "look at this point of view", "the dot on the i", "a (at) b", "one two three", "at dot com",
     "seven eight nine zero one two", "naïve café – 12–14", "x @ y", "аеор", "f(.)g", "5 > 3 @ noon. then"],
)
def test_clean_texts_are_left_alone(text):
    assert deobfuscate.find(text) == []


def test_many_rewritings_keep_offsets():
    rng = random.Random(1)
    for _ in range(500):
        text, want, at = "", [], 0
        for _ in range(rng.randint(1, 12)):
            filler = rng.choice(["word ", "​", "éа ", "one two ", "１x ", "(at) ", ". "])
            text += filler + rng.choice(["", "; "])
            if rng.random() < 0.4:
                hidden, kind = rng.choice([("jo(at)ex­ample(dot)com", "email"), ("two one two dot seven dot one dot nine", "ip")])
                text += "| "
                want.append((kind, len(text), len(text) + len(hidden)))
                text += hidden + " | "
        got = [f[:3] for f in deobfuscate.find(text) if not f[3]]
        assert set(want) <= set(got), text


@pytest.mark.parametrize("piece", ["a", "@", "1", "1.", "+1(", "a@", "one ", "( at )", "a at b dot ", "x (at) y", "1 ", "a.b-c ", "а", "(", "​"])
def test_time_grows_with_the_text_only(piece):
    import time

    start = time.process_time()
    deobfuscate.find(piece * (300_000 // len(piece)) + " dot ")
    assert time.process_time() - start < 10


def test_query(spark, data):
    rows = {r.doc_id: r for r in QUERIES["op12_personal_data"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        want, got = plain_spans(r.text), rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [got[f"n_{kind}"] for kind in KINDS] == [sum(k == kind for k, _, _ in want) for kind in KINDS]
        assert set(listed(want).split(",")) <= set(got.spans.split(","))
    assert sum(r.n_email for r in rows.values()) and sum(r.n_card for r in rows.values())


def test_odd_rows(odd, none):
    got = deobfuscate.find_personal_data(odd).collect()
    assert sorted(map(str, (r.id for r in got))) == sorted(str(r.doc_id) for r in odd.collect())
    assert all(r.spans == [] for r in got)
    assert deobfuscate.find_personal_data(none).count() == 0
