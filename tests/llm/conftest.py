from __future__ import annotations

import pytest
from pyspark.sql import Row

from tillwise.llm.frames import ship

LONG = " ".join(f"word{k % 977}" for k in range(40_000))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    extra = {"id": "x", "fp": 1, "copies": -1, "kept_text": "mine", "n_lines": -2, "place": "p", "score": 0.5}
    texts = [
        "the cat sat on the mat and looked at the moon",
        "the cat sat on the mat and looked at the moon",
        None,
        "",
        " \n\t ",
        "???",
        LONG,
        "der Hund und die Katze sind nicht im Haus",
        "one\ntwo\n\nthree",
        "ünï ▁ <s> <|endoftext|> 日本語 🙂 \x00 \x85 end",
    ]
    rows = [
        Row(doc_id=k, text=t, lang=None if k == 3 else "en", source=None if k == 4 else f"src{k % 2}", n_chars=None, **extra)
        for k, t in enumerate(texts)
    ]
    rows += [rows[0], Row(doc_id=None, text="no id here", lang=None, source=None, n_chars=3, **extra)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars int, id string, fp int, copies int, "
        "kept_text string, n_lines int, place string, score double",
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
