"""Fuzzy matches against all pairs; boolean queries against plain evaluation."""

import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from scholion import catalogue
from scholion.operators import families, library
from scholion.operators.families import matching_ratio
from scholion.plans import boolean


def test_fuzzy_matches_equal_all_pairs(spark):
    rng = random.Random(8)
    words = ["renal", "chloride", "outcome", "of", "in", "adult", "trial", "a", "randomised", "cohort", "serum", "sepsis"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(90)]
    for t in list(titles):
        chars = list(t)
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        titles.append("".join(chars))
    titles += ["", "short one", None, "renal chloride outcome of " * 30]
    rng.shuffle(titles)
    rows = list(enumerate(titles))
    found = library.fuzzy_matches(
        spark.createDataFrame(rows[::2], "k long, t string"), spark.createDataFrame([*rows[1::2], *rows[1::2]], "i long, t string"), "k", "i", "t"
    ).collect()
    want = []
    for k, t in rows[::2]:
        if t and len(t) >= 20:
            scored = [(-round(difflib.SequenceMatcher(None, t, u, autojunk=False).ratio(), 6), i) for i, u in rows[1::2] if u]
            less, item = min(scored)
            if -less >= library.LEAST:
                want.append((k, item, round(-less, 4)))
    assert len(want) > 15 and sorted(map(tuple, found)) == sorted(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_fuzzy_matches_of_documents(spark):
    path = "/root/testdata/sf0.001"
    names = {r.doc_id: r.name for r in catalogue.sentence_titles(spark, path).collect() if r.name}
    want = {}
    for k in names:
        if k % 2 and len(names[k]) >= library.SHORTEST:
            less, item = min((-round(matching_ratio(names[k], t, library.LEAST - 1e-6) or 0, 6), i) for i, t in names.items() if not i % 2)
            if -less >= library.LEAST:
                want[k] = (item, round(-less, 4))
    assert want and {r.doc_id: (r.item, r.similarity) for r in catalogue.QUERIES["library_fuzzy"](spark, path).collect()} == want


@pytest.mark.parametrize(
    "query,dialect,held",
    [
        ("a OR b AND c", "pubmed", lambda a, b, c: (a or b) and c),
        ("a OR b AND c", "europe_pmc", lambda a, b, c: a or (b and c)),
        ("NOT a AND b", "europe_pmc", lambda a, b, c: not a and b),
        ("NOT a AND b", "pubmed", lambda a, b, c: not a and b),
        ("a b OR c", "arxiv", lambda a, b, c: (a and b) or c),
        ("a ANDNOT (b OR c)", "arxiv", lambda a, b, c: a and not (b or c)),
        ("((a) NOT b) NOT c", "pubmed", lambda a, b, c: a and not b and not c),
        ("a NOT b OR c", "pubmed", lambda a, b, c: (a and not b) or c),
        ("a AND NOT (b AND NOT c)", "europe_pmc", lambda a, b, c: a and not (b and not c)),
        ("a OR NOT b", "europe_pmc", lambda a, b, c: a or not b),
    ],
)
def test_operators_bind_as_in_their_dialect(spark, query, dialect, held):
    rows = [(k, " ".join(x for x, bit in zip("abc", (1, 2, 4)) if k & bit)) for k in range(8)]
    frame = spark.createDataFrame(rows, "k long, t string")
    found = {r.k for r in frame.where(boolean.matches(query, dialect, F.col("t"), F.lit(None).cast("string"))).collect()}
    assert found == {k for k, _ in rows if held(bool(k & 1), bool(k & 2), bool(k & 4))}


def test_terms_and_faults(spark):
    frame = spark.createDataFrame([("serum chloride in sepsis", None), ("chlorides", "serum chloride")], "t string, a string")
    count = lambda q, d: frame.where(boolean.matches(q, d, F.col("t"), F.col("a"))).count()
    assert count('"Serum Chloride"[ti]', "pubmed") == 1 and count('"serum chloride"', "pubmed") == 2
    assert count("chlorid*[ti]", "pubmed") == 2 and count("chlorid[ti]", "pubmed") == 0 and count('TITLE_ABS:"chloride in"', "europe_pmc") == 1
    for query, dialect, code in (("a AND", "pubmed", "trailing"), ("(a OR b", "arxiv", "unbalanced"), ("a)", "arxiv", "unbalanced"), ("OR a", "arxiv", "misplaced"), ("x:a", "arxiv", "unknown_field"), ("a[mesh]", "pubmed", "unknown_field"), ('a "b', "arxiv", "unexpected")):
        with pytest.raises(boolean.BooleanError, match=code):
            boolean.parse(query, dialect)


def test_blocks_of_long_texts_and_bags(monkeypatch):
    """Matching blocks equal SequenceMatcher's by listed runs, by bisection and with little left to reach; bags lose no match."""
    rng, texts = random.Random(5), []
    for k in range(60):
        base = "".join(rng.choice("ab" if k % 3 else "abcdefgh ") for _ in range(rng.randint(9, 120)))
        chars = list(base)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
        texts += [base, "".join(chars)]
    texts += ["a" * 90 + "bc" * 20, "a" * 80 + "bc" * 24]
    bags = families.Bags(texts)
    for window, places in ((1, 8), (1, 0), (1 << 13, 8)):
        monkeypatch.setattr(families, "WINDOW", window)
        monkeypatch.setattr(families, "PLACES", places)
        for k, a in enumerate(texts[::2]):
            near = set(bags.near(bags, 2 * k, 0, 0.92))
            for j in {2 * k + 1, *rng.sample(range(len(texts)), 12)}:
                b = texts[j]
                held = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
                assert families._blocks_length(a, b) == families._blocks_length(a, b, held) == held
                assert j in near or 2 * held / (len(a) + len(b)) < 0.92


def test_titles_of_a_library_travel_a_bounded_number_of_times(spark, monkeypatch):
    """A title of n letters once was n rows that held it whole; now it meets parts of three bands of lengths."""
    long = "".join(random.Random(1).choice("abcdefghij ") for _ in range(6000)).strip()
    names = [(1, long), (2, long[:3000] + "q" + long[3001:]), (3, "a quite ordinary title"), (4, "a quite ordinary titles"), (5, "a quite ordinary titlesx")]
    rows, seen = spark.createDataFrame(names, "k long, t string"), []
    whole = library._met
    monkeypatch.setattr(library, "_met", lambda *a: seen.append(whole(*a)) or seen[-1])
    for part in (2000, 1):
        monkeypatch.setattr(library, "PART", part)
        found = library.fuzzy_matches(rows.where("k % 2 = 1"), rows.where("k % 2 = 0").withColumnRenamed("k", "i"), "k", "i", "t").collect()
        assert sorted((r.k, r.i) for r in found) == [(1, 2), (3, 4), (5, 4)]
    assert sum(f.count() for f in seen[:2]) <= 15
