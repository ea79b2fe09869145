"""The positional index against a scan of the texts."""

import random
import re

import pytest

from scholion.operators import lexical


def scan(rows, query, k, section=""):
    terms, hits = lexical.query_terms(query), []
    for doc, pos, text, headings in rows:
        if section and section.casefold() not in " ".join(headings or []).casefold():
            continue
        score = sum((text or "").casefold().count(t) for t in terms)
        if score:
            hits.append((-score, doc, pos))
    return [(d, p, -s) for s, d, p in sorted(hits)[:k]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, pos int, text string, headings array<string>")


def make(seed, documents=60):
    draw = random.Random(seed)
    vocabulary = ["method", "methods", "aaa", "aa", "Straße", "STRASSE", "x", "Übung", "a_b", "de", "dede", "İx", "ﬁn"]
    rows = []
    for doc in range(documents):
        for pos in range(draw.randint(1, 8)):
            words = [draw.choice(vocabulary) for _ in range(draw.choice((0, 1, 5, 40)))]
            rows.append((doc, pos, draw.choice([" ", ", ", "-"]).join(words), [draw.choice(["Methods", "Results"])]))
    return rows + [(999, 0, None, None), (1000, 0, "", ["Methods"])]


def test_find_equals_a_scan(spark):
    rows = make(1)
    index = lexical.build(frame(spark, rows), ["doc", "pos"], "text", "headings", block=16)
    for query, k, section in [("method", 5, ""), ("aa de, AA", 9, "meth"), ("strasse", 400, ""), ("e", 3, "results"), ("fi x", 7, ""), ("nowhere", 4, "")]:
        found = lexical.find(index, query, k, section, seeds=2).collect()
        assert sorted(((r.doc, r.pos, r.score) for r in found), key=lambda r: (-r[2], r[0], r[1])) == scan(rows, query, k, section)
    with pytest.raises(ValueError):
        lexical.find(index, " - ", 3)
    with pytest.raises(ValueError):
        lexical.find(index, "x", 0)


def test_spans_are_ranges_of_the_text_as_it_was(spark):
    text = "De dede -- Straße STRASSE aaaa de"
    index = lexical.build(frame(spark, [(1, 0, text, None)]), ["doc", "pos"], "text", "headings")
    for query in ("de", "aa", "de dede"):
        (hit,) = lexical.find(index, query, 3).collect()
        want = sorted({m.span() for t in lexical.query_terms(query) for m in re.finditer(re.escape(t), text, re.I)})
        assert [tuple(s) for s in hit.spans] == want and hit.span_count == len(want)
    (hit,) = lexical.find(index, "ss stra", 3).collect()  # the folded word is longer: the letters it comes from
    assert [text[s.start : s.end] for s in hit.spans] == ["Stra", "ß", "STRA", "SS"]
    many = lexical.build(frame(spark, [(1, 0, "x " * 1500, None)]), ["doc", "pos"], "text", "headings")
    (hit,) = lexical.find(many, "x", 1).collect()
    assert (hit.score, hit.span_count, len(hit.spans)) == (1500, 1500, lexical.SPANS)


def test_blocks_that_cannot_reach_the_bound_are_left_out(spark):
    rows = [(doc, 0, "rare " * (50 if doc == 7 else 1), None) for doc in range(400)]
    index = lexical.build(frame(spark, rows), ["doc", "pos"], "text", "headings", block=20)
    assert index.blocks.count() > 10
    assert lexical.candidate_blocks(index, "rare", 1, seeds=1).count() == 1
    assert [(r.doc, r.score) for r in lexical.find(index, "rare", 1, seeds=1).collect()] == [(7, 50)]


def test_a_saved_index_finds_the_same_and_an_empty_table_nothing(spark, tmp_path):
    rows = make(2, 20)
    index = lexical.build(frame(spark, rows), ["doc", "pos"], "text", "headings", block=8)
    lexical.save(index, str(tmp_path / "index"), parts=3)
    again = lexical.find(lexical.load(spark, str(tmp_path / "index"), ["doc", "pos"]), "method aa", 6).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, lexical.find(index, "method aa", 6).collect()))
    assert lexical.find(lexical.build(frame(spark, []), ["doc", "pos"], "text", "headings"), "x", 2).count() == 0


def test_an_index_is_tokenised_once(spark):
    """A checkpoint counts its rows and then computes them again to write them."""
    from pyspark.sql import functions as F

    from scholion.operators import lexical

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = spark.range(8, numPartitions=1).select(F.col("id").alias("k"), told(F.concat(F.lit("a word "), "id")).alias("text"))
    index = lexical.build(rows, ["k"], "text")
    assert seen.value <= 8 and index.postings.count() == 24
