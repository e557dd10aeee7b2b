from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from tillwise.llm import cotrain, linededup, mixing, simhash
from tillwise.llm.mixing import Mix
from tillwise.llm.queries import QUERIES, vocabulary
from tillwise.llm.sql import ORACLES
from tillwise.llm.sql import mixing as mixing_sql


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, data, name):
    assert differences(QUERIES[name](spark, data), connect(data), ORACLES[name]) == []


def plain_frequent(pages):
    """Lines to drop per host, from ``(host, text)`` pairs, by definition."""
    bodies = {(host, text or "") for host, text in pages}
    total, on = Counter(host for host, _ in bodies), Counter()
    for host, text in bodies:
        on.update({(host, line.strip(" ")) for line in text.split("\n")} - {(host, "")})
    return {k for k, n in on.items() if 100 * n > 2 * total[k[0]] and n >= min(5, max(3, total[k[0]] // 2 + 1))}


def test_frequent_lines(spark):
    rows = [(k, "a", f"head\nbody {k}\n\nmore {k}\nfoot") for k in range(50)]
    rows += [(100 + k, "b", f"head\nother {k}") for k in range(3)]  # over half of a small host
    rows += [(110 + k, "two", f"head\nother {k}") for k in range(2)]  # two pages say nothing
    rows += [(200 + k, "c", "one text\nthat the host\nholds often") for k in range(9)] + [(300, None, None)]
    rows += [(400 + k, "d", f"x {k}\nrare" if k < 6 else f"x {k}") for k in range(300)]
    rows += [(800 + k, "e", "menu\nfoot" if k == 7 else f"menu\nbody {k}\nfoot") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("kept_text", F.lit(1))
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(docs).collect()}
    assert got[3] == "body 3\n\nmore 3" and got[100] == "other 0" and got[110] == "head\nother 0"
    assert got[200] == "one text\nthat the host\nholds often" and got[300] is None and got[400] == "x 0\nrare"
    assert got[800] == "body 0" and got[807] == ""
    marked = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.mark_lines(docs).collect()}
    assert marked[3] == (4, 2) and marked[200] == (3, 0) and marked[300] == (0, 0) and marked[807] == (2, 2)
    drop = plain_frequent([(source, text) for _, source, text in rows])
    for k, source, text in rows:
        want = text and "\n".join(x for x in text.split("\n") if (source, x.strip(" ")) not in drop)
        assert got[k] == want


def test_near_copies_on_a_small_host_keep_their_text(spark):
    article = [f"line {k} of an article that two pages hold" for k in range(20)]
    rows = [(1, "site", "\n".join(["menu", *article, "first"])), (2, "site", "\n".join(["menu", *article, "second"]))]
    rows += [(k, "site", f"menu\nown text of page {k}") for k in range(3, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(docs).collect()}
    assert got[1] == "\n".join([*article, "first"]) and got[2] == "\n".join([*article, "second"])
    assert all(got[k] == f"own text of page {k}" for k in range(3, 41))


def test_menu_heavy_pages_lose_their_menu(spark):
    menu = "\n".join(f"entry {k}" for k in range(12))
    rows = [(k, "a", f"{menu}\nbody {k}") for k in range(50)] + [(100, "a", menu)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    marked = {r.doc_id: r for r in linededup.mark_lines(docs).collect()}
    assert all(marked[k].kept_text == f"body {k}" and marked[k].n_dropped == 12 for k in range(50))
    assert marked[100].kept_text == "" and marked[100].n_dropped == 12


def test_one_rule_for_query_stage_and_function(spark, tmp_path):
    pages = [(k, f"http://small.org/{k}", f"<p>menu</p><p>body {k}</p>") for k in range(3)]
    pages += [(10, "http://one.org/", "<p>menu</p><p>body</p>")]
    pages += [(100 + k, f"http://large.org/{k}", f"<p>{'rare' if k < 2 else k}</p><p>body {k}</p>") for k in range(100)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.n_dropped for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(3)] == [1, 1, 1] and got[10] == 0
    assert got[100] == got[101] == 0  # 2 of 100 pages are not over 2 %
    rows = [(k, "small", f"menu\nbody {k}", None) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    made = corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()
    assert {r.text for r in made} == {f"body {k}" for k in range(3)}


def test_line_dedup_of_odd_rows(odd, none):
    got = linededup.drop_boilerplate(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(odd.collect(), key=key)
    assert linededup.drop_boilerplate(none).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    mix = Mix(domains={"x": ("s1", "s2"), "y": ("s3",)}, share=100, max_epochs=1)
    leaves = [("x", "en", "s1", 10), ("x", "en", "s2", 1000), ("x", "de", "s1", 1000), ("y", "en", "s3", 100)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for share, want in (
        # y has 100 of 422, so x gets 322: 161 each language; s1 has 10, so its sibling s2 gets 151
        (20, [("x", "de", "s1", 161), ("x", "en", "s1", 10), ("x", "en", "s2", 151), ("y", "en", "s3", 100)]),
        (100, [("x", "de", "s1", 1000), ("x", "en", "s1", 10), ("x", "en", "s2", 1000), ("y", "en", "s3", 100)]),
    ):
        from dataclasses import replace

        got = mixing.budgets(frame, replace(mix, share=share)).select(*mixing.LEAF, "budget").collect()
        assert sorted(map(tuple, got)) == want
    with pytest.raises(ValueError, match="1 or more"):
        Mix(domains={}, lang_weights={"en": 0}).weights("lang")


@pytest.mark.parametrize("share,epochs", [(40, 1), (250, 3)])
def test_mixes_as_sql(spark, data, share, epochs):
    mix = Mix(domains={"w": ("src0", "src1")}, lang_weights={"en": 3}, share=share, max_epochs=epochs)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chosen = mixing.choose(docs, mix).withColumnRenamed("id", "doc_id")
    assert differences(chosen, connect(data), mixing_sql(mix)) == []
    copies = {r.doc_id: r.copies for r in chosen.collect()}
    taken = mixing.mix_documents(docs, mix)
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in taken.collect()) == copies
    total = docs.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert sum(r.tokens * r.copies for r in chosen.collect()) <= total * share / 100


def test_mixing_of_odd_rows(odd, none):
    whole = Mix(domains={}, share=100, max_epochs=1)
    taken = mixing.mix_documents(odd, whole)
    assert taken.columns == odd.columns
    with_words = [r for r in odd.collect() if (r.text or "").strip()]
    assert len([r for r in taken.collect() if (r.text or "").strip()]) == len(with_words)
    assert mixing.mix_documents(none, whole).count() == mixing.choose(none, whole).count() == 0


def test_pipeline_stages(spark, data):
    """Every stage's result against a plain version of it on the stage's own input."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    columns, by = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.store(stage(spark, docs, data))
        after = docs.collect()
        assert len({r.doc_id for r in after}) == len(after) and {r.doc_id for r in after} <= set(before)
        if name != "piece_coding":
            assert docs.columns == columns
        by[name] = (before, {r.doc_id: r for r in after})

    before, after = by["quality_classifier"]
    assert all(k in after for k in before if labels.get(k) == 1)
    assert sum(k not in after for k in before if labels.get(k) == 0) >= 0.9 * sum(labels.get(k) == 0 for k in before)
    assert all(after[k] == before[k] for k in after)

    before, after = by["line_dedup"]
    drop = plain_frequent([(r.source, r.text) for r in before.values()])
    for k, r in before.items():
        want = [x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in drop]
        assert after[k].text == "\n".join(want) and after[k].n_chars == len(after[k].text)

    from test_setjoin import plain_components

    before, after = by["simhash_near_dedup"]
    component = plain_components({k: r.text for k, r in before.items()})
    assert set(after) == set(component.values()) and all(after[k] == before[k] for k in after)

    before, after = by["source_mixing"]
    assert 0.8 * len(before) < len(after) < len(before) and all(after[k] == before[k] for k in after)

    before, after = by["piece_coding"]
    from tillwise.llm.pieces import coder

    library = coder(vocabulary("piece_bpe_32k.model")).library
    assert set(after) == set(before) and all(r.ids == library.encode(before[k].text) for k, r in after.items())
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, data).collect()} == {k: r.ids for k, r in after.items()}


def test_stages_of_odd_rows(spark, odd, none):
    assert cotrain.keep_good(odd, None).count() == odd.count()
    assert simhash.drop_near_duplicates(none).columns == odd.columns
