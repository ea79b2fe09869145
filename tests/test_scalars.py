"""Scalar functions, query plans and resolution against worked-out results."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from scholion.functions import normalize as n
from scholion.operators import authors, clinical, families, graph, identity, metrics, ranking, reading, resolve, shredding
from scholion.plans import query_plan


def column(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_identifiers(spark):
    dois = ["https://doi.org/10.1000/ABC.", "doi: 10.1234/x(1)", "10.1234/x(1))", "10.1%2F", "n/a", None, "10.1000%2Fa+b"]
    assert column(spark, dois, n.doi) == ["10.1000/abc", "10.1234/x(1)", "10.1234/x(1)", "", "", "", "10.1000/a"]
    pmids = ["PMID: 12", "https://pubmed.ncbi.nlm.nih.gov/345/", "https://example.org/345", "012", None]
    assert column(spark, pmids, n.pmid) == ["12", "345", "", "", ""]
    assert column(spark, ["pmc12", "PMCID:PMC7", "12"], n.pmcid) == ["PMC12", "PMC7", ""]
    assert column(spark, ["arXiv:2101.00001v2", "https://arxiv.org/pdf/hep-th/9901001.pdf", "x"], n.arxiv_id) == ["2101.00001v2", "hep-th/9901001", ""]
    assert column(spark, ["OpenAlex:https://openalex.org/W12", "s2:AbC", "other:X "], n.work_alias) == ["openalex:w12", "semantic_scholar:abc", "other:X"]


def test_titles_and_text(spark):
    values = ["  The Straße—of: 3 things ", None, "Ünï-code"]
    assert column(spark, values, n.title) == ["the strasse of 3 things", "", "ünï code"] == column(spark, values, n.exact_title)
    assert column(spark, ["isPreprintOf", "has_version", "is  part of"], n.relation_type) == ["is-preprint-of", "has-version", "is-part-of"]
    assert column(spark, ["https://u:p@h.example/a?api_key=1&q=2#f", "http://h/?q=1"], n.redact_url) == ["https://h.example/a?api_key=REDACTED&q=2", "http://h/?q=1"]
    assert column(spark, ["p < 0.05 &amp; Cl &gt; 113. <i>in</i>line<p>next</p>"], shredding.strip_tags) == ["p < 0.05 & Cl > 113. inline next"]


def test_lint():
    codes = lambda q, s="pubmed": [e["code"] for e in query_plan.lint(q, s)["errors"]]
    assert codes("(chloride AND)") == ["trailing_boolean_operator"]
    assert codes('(TITLE_ABS:"chloride" OR)', "europe_pmc") == ["trailing_boolean_operator"]
    assert codes('(chloride OR "AND") AND (2020:2024[dp] OR "OR")') == []
    assert codes('a) OR "b') == ["unmatched_closing_delimiter", "unclosed_quote"]


PLAN = {
    "schema_version": 1, "question": "Chloride outcomes", "concepts": [{"id": "chloride", "terms": ["hyperchloremia", "elevated serum chloride"]}],
    "routes": [{"id": "p", "source": "pubmed", "concept_ids": ["chloride"], "limit": 10}, {"id": "e", "source": "europe_pmc", "concept_ids": ["chloride"], "limit": 10}],
}


def test_plans():
    plan = query_plan.validate(PLAN)
    assert plan["routes"][0]["query"] == '("hyperchloremia"[Title/Abstract] OR "elevated serum chloride"[Title/Abstract])'
    more = query_plan.add_coverage(PLAN, 7)
    assert [r["limit"] for r in more["routes"]] == [10, 10, 7, 7] and more["routes"][2]["query"] == "(hyperchloremia OR (elevated serum chloride))"
    for bad in ({"routes": []}, {"question": ""}, {"extra": 1}, {"routes": [PLAN["routes"][0]] * 2}, {"concepts": []}):
        with pytest.raises(query_plan.PlanError):
            query_plan.validate(PLAN | bad)


def test_fusion_prefers_routes_to_citations(spark):
    hits = spark.createDataFrame([("a", "p", 1, None), ("b", "p", 2, None), ("a", "e", 1, None), ("c", "e", 2, None), ("d", "s", 9, "bulk")], "candidate_id string, route_id string, rank int, sem string")
    top = resolve.select_queue(resolve.reciprocal_rank_fusion(hits, semantics="sem"), 3).collect()
    assert [r.candidate_id for r in top] == ["a", "d", "b"] and abs(top[0].score - 2 / 61) < 1e-12


def record(pos, title, **more):
    keys = [f"{k}:{more[k]}" for k in ("doi", "pmid", "openalex") if more.get(k)] + ([f"title:{title}"] if len(title) >= 20 else [])
    return (pos, keys, title, more.get("authors"), more.get("year"), more.get("doi"), more.get("pmid"), [f"s{pos}"])


FOLDS = [
    ([record(0, "Editorial", doi="x", pmid="1"), record(1, "Editorial", doi="x", pmid="2")], 2, True),
    ([record(0, "a title of twenty letters", year=2020), record(1, "a title of twenty letters", year=2021)], 2, True),
    ([record(0, "a title of twenty letters", authors=["A B"]), record(1, "a title of twenty letters", authors=["C D"])], 2, True),
    ([record(0, "t", doi="x", openalex="w1"), record(1, "t", doi="x", openalex="w2"), record(2, "t", openalex="w2")], 1, False),
    ([record(0, "short"), record(1, "short")], 2, False),
]


@pytest.mark.parametrize("rows,n_out,conflict", FOLDS)
def test_merge_fold(spark, rows, n_out, conflict):
    frame = spark.createDataFrame(rows, "pos long, keys array<string>, title string, authors array<string>, year long, doi string, pmid string, sources array<string>")
    out = identity.merge_records(frame).collect()
    assert len(out) == n_out and all(r.identity_conflict == conflict for r in out)


def test_ranks_without_a_task_per_group(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 as pos", "if(id % 10 < 7, 'hot', 'cold') as g")
    found = ranking.rank_within(rows, "g", "pos").collect()
    for g in ("hot", "cold"):
        mine = sorted((r for r in found if r.g == g), key=lambda r: r.pos)
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_components_of_a_chain(spark):
    links = spark.range(40).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(100, 101), (5, 5)], "a long, b long"))
    found = {r.vertex: r.component for r in graph.connected_components(links).collect()}
    assert all(found[k] == 0 for k in range(41)) and found[101] == 100


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "c", False), (2, "a", True)], "pos int, work string, relevant boolean")
    total = spark.createDataFrame([(2,)], "known_relevant int")
    row = metrics.evaluate_at_k(ranked, 2, ["pos"], relevant_total=total).head()
    assert (row.precision_at_k, row.recall) == (0.5, 0.5)
    unknown = spark.createDataFrame([(1, "u", None), (2, "a", True)], "pos int, work string, relevant boolean")
    row = metrics.evaluate_at_k(unknown, 2, ["pos"], relevant_total=total).head()
    assert row.precision_at_k is None and row.precision_lower_bound == 0.5


def test_chunks_are_lossless(spark):
    text = ("A sentence here. " * 40 + "\n\n") * 30 + "x" * 9000
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc long, t string")
    chunks = reading.chunk(rows, "doc", "t").orderBy("doc", "pos").collect()
    assert "".join(r.text for r in chunks) == text and all(r.end - r.start <= 4002 for r in chunks)
    assert reading.cut_points("ab. " * 1500, 4000)[0] == 4000


def test_quotes_and_packs(spark):
    chunks = spark.createDataFrame([("a", "The exact words."), ("b", "other")], "chunk_id string, text string")
    seen = spark.createDataFrame([("a", "exact words"), ("a", "Exact"), ("b", ""), ("z", "x")], "chunk_id string, quote string")
    assert sorted((r.chunk_id, r.verified) for r in reading.verify_quotes(seen, chunks).collect()) == [("a", False), ("a", True), ("b", False), ("z", False)]
    sizes = spark.createDataFrame([("d", k, 10) for k in range(5)], "doc string, pos int, length int")
    assert reading.pack(sizes, "doc", "pos", "length", most=25, start=1).count() == 2


def test_article_roles():
    page = """<div class="article-body"><section class="abstract"><h2>Summary</h2><p>Short.</p></section><h2>Methods</h2><p>Actual <i>design</i>.</p>
<script>x</script><section><h2>Funding</h2><p>Grant</p></section><section id="ref-list"><h2>References</h2><ol><li>One</ol></section></div>"""
    found = [(e["kind"], e["content_role"], e["text"]) for e in shredding.shred_html(page)]
    assert ("paragraph", "abstract", "Short.") in found and ("paragraph", "body", "Actual design .") in found
    assert ("paragraph", "backmatter", "Grant") in found and ("reference", "backmatter", "One") in found
    assert shredding.shred_html("<div><p>no marked body</p></div>") == [] and shredding.shred_html("<article><p>x</article>", "generic")


JATS = """<article><front><article-meta><article-id pub-id-type="pmc">PMC1</article-id><abstract><p>Abs.</p></abstract></article-meta></front><body><sec><title>Results</title>
<p>Text <inline-formula>x</inline-formula></p><table-wrap id="T"><caption><p>Cap</p></caption><table><tr><th>h</th></tr><tr><td colspan="2">1</td></tr></table></table-wrap><fig><caption><p>F</p></caption></fig>
</sec></body><back><ref-list><ref><p>R</p></ref></ref-list></back></article>"""


def test_jats():
    kinds = [(e["kind"], e["content_role"]) for e in shredding.shred_jats(JATS, "PMC1")]
    assert kinds == [("paragraph", "abstract"), ("heading", "body"), ("paragraph", "body"), ("formula", "body"), ("table", "body"), ("figure", "body"), ("reference", "backmatter")]
    assert shredding.shred_jats(JATS, "PMC2") == [] == shredding.shred_jats("<!DOCTYPE a [<!ENTITY x 'y'>]><article/>") == shredding.shred_jats("<broken")


ABSTRACT = (
    "Methods: A total of 1,200 adults with acute kidney injury were studied from 2015 to 2018. Results: sodium >= 145 was associated with death "
    "(OR = 2.195, 95% CI: 1.4–3.2); sodium <= 130 was not (odds ratio 0.365, 95% CI 0.2-0.9). NCT01234567."
)


def test_author_names_match_once():
    assert authors.agreement(["Anna Leeson", "Bob Chandler"], ["Leeson A", "Chandler B"])["compatible"]
    assert authors.agreement(["Anna Leeson"], ["Cidney Moerk"])["disjoint"] and not authors.agreement([], ["X Y"])["disjoint"]
    assert authors.agreement(["Lee A", "Lee B", "Lee C"], ["Lee A"])["matched"] == 1


def test_matching_is_maximum():
    rng = random.Random(3)

    def slow(reach, used):
        if not reach:
            return 0
        return max([slow(reach[1:], used)] + [1 + slow(reach[1:], used | {j}) for j in reach[0] if j not in used])

    for _ in range(300):
        n, m = rng.randint(0, 5), rng.randint(0, 5)
        reach = [[j for j in range(m) if rng.random() < 0.4] for _ in range(n)]
        assert authors.maximum_matching(reach, m) == slow(reach, frozenset())


def test_cohorts_and_effects():
    found = clinical.effects(ABSTRACT)
    assert [(e["statistic"], e["point"], e["low"], e["high"], e["stratum"]) for e in found] == [("or", "2.195", "1.4", "3.2", "sodium>=145"), ("or", "0.365", "0.2", "0.9", "sodium<=130")]
    made = clinical.cohort(ABSTRACT)
    assert made["sizes"] == ["1200"] and made["windows"] == ["2015-2018"] and made["trials"] == ["nct01234567"] and made["population"]["age"] == ["adult"]
    assert clinical.cohort("Patients with acute kidney injury were seen.")["conditions"] == [["acute", "injury", "kidney"]]
    assert clinical.cohort("We included 80 children; 75 patients were analysed. Sample size (n = 80)")["sizes"] == ["75", "80"]
    outside = "The hazard ratio was 1.5 (95 % CI 2.0 to 3.0), outside its interval."
    assert clinical.effects(outside) == [] == clinical.effects(None) and clinical.cohort(None)["sizes"] == []
    assert clinical.effects("MD -2.1 (95% CI -3.2 to -1.0)")[0]["point"] == "-2.1"
    one = clinical.compare(ABSTRACT, ABSTRACT)
    assert one["conflicts"] == [] and clinical.compare(ABSTRACT, ABSTRACT.replace("1,200 adults", "900 children"))["conflicts"] == ["sizes", "population_age"]


def test_diagnostics_agree_with_their_rules():
    code = lambda q, s="pubmed": [(e["code"], e["offset"]) for e in query_plan.lint(q, s)["errors"]]
    assert code("(a OR b) AND") == [("trailing_boolean_operator", 9)] and code("a AND (b OR )") == [("trailing_boolean_operator", 9)]
    assert code('"a AND') == [("unclosed_quote", 0)] and code("a) [b") == [("unmatched_closing_delimiter", 1), ("unclosed_delimiter", 3)]
    assert code(r"a \( b") == [] and code("BAND OR ANDY") == [] and code('a OR "AND"') == []
    warn = lambda q, s: [e["code"] for e in query_plan.lint(q, s)["warnings"]]
    assert warn("a[ti] AND b OR c", "pubmed") == ["mixed_boolean_precedence_requires_review"] and warn("a[zz]", "pubmed") == ["field_requires_provider_verification"]
    assert warn("TITLE:a AND (FOO:b OR c)", "europe_pmc") == ["field_requires_provider_verification"]
    with pytest.raises(query_plan.PlanError) as found:
        query_plan.validate(PLAN | {"extra": 1})
    assert found.value.where == "plan"


def test_abstract_evidence(spark):
    words = [f"word{k}long" for k in range(120)]
    rows = spark.createDataFrame([(" ".join(words), " ".join(words)), (" ".join(words), " ".join(words[::-1])), ("", "")], "a string, b string")
    assert [r.strong for r in families.abstract_evidence(rows, "a", "b").collect()] == [True, False, False]


def test_shared_budget():
    plan = query_plan.share_budget(PLAN, 5)
    assert [(r["source"], r["limit"]) for r in plan["routes"]] == [("pubmed", 3), ("pubmed", 2), ("europe_pmc", 3), ("europe_pmc", 2)]
    for bad, budget in ((PLAN, 1), (PLAN | {"routes": [{"id": "x", "source": "arxiv", "query": "q"}]}, 9)):
        with pytest.raises(query_plan.PlanError):
            query_plan.share_budget(bad, budget)


def test_metadata_evidence(spark):
    title, abstract = "a very specific title about hyperchloremia outcomes cohort mortality", " ".join(f"finding{k}long" for k in range(120))
    rows = [(1, title, ["Anna Leeson", "Bob Chandler"], 2020, abstract, "preprint"), (2, title, ["Leeson A", "Chandler B"], 2021, abstract, "journal"), (3, title, ["Leeson A", "Chandler B"], 2018, "other", "journal")]
    frame = spark.createDataFrame(rows, "id long, title string, authors array<string>, year int, abstract string, role string")
    found = {r.id: r.reasons for r in families.metadata_evidence(frame).collect()}
    assert found[2] == [] and found[3] == ["incompatible_or_missing_years", "insufficient_distinctive_abstract"]


def test_fuzzy_titles_compare_all_of_a_block_without_junk(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"same block {' '.join(rng.choice('abcdefgh') * rng.randint(1, 6) for _ in range(90))}" for _ in range(3)]
    titles = [b if k == 0 else b[: 40 * k] + "x y" + b[40 * k + 2 :] for b in base for k in range(3)] + ["same block of another kind", "other block"]
    frame = spark.createDataFrame([(100 - k, x) for k, x in enumerate(titles)], "id long, t string")
    expected = set()
    for a, x in sorted((100 - k, x) for k, x in enumerate(titles)):
        for b, y in ((100 - k, y) for k, y in enumerate(titles)):
            if a < b and x.split()[:2] == y.split()[:2]:
                ratio = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
                if ratio >= 0.92:
                    expected.add((a, b, round(ratio, 6)))
    assert len(expected) >= 9
    for part in (200, 2):
        monkeypatch.setattr(families, "PART", part)
        assert set(map(tuple, families.fuzzy_titles(frame, "id", "t").collect())) == expected
    monkeypatch.setattr(families, "LONG", 0)
    for x in titles:
        for y in titles:
            assert families.matching_ratio(x, y) == difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def test_near_copies_are_compared_by_packed_runs(spark, monkeypatch):
    rng = random.Random(8)
    base = "same block " + "".join(rng.choice("abcdefghij ") for _ in range(600))
    other = base[:200] + "xx" + base[203:450] + base[470:]
    spread = "漢字" + base
    for a, b in ((base, other), (other, base), (spread, "漢字" + other), (base[:30] * 30, base[:29] * 30), (base, base[::-1])):
        assert families.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    frame = spark.createDataFrame([(1, base), (2, other), (3, base[:300])], "id long, t string")
    monkeypatch.setattr(families, "PART_LETTERS", 500)  # each title a part
    assert [(r.head, r.id) for r in families.fuzzy_titles(frame, "id", "t").collect()] == [(1, 2)]
    monkeypatch.setattr(families.np, "unique", None)  # a near copy's runs aren't named
    assert families.matching_ratio(base, other, 0.92) > 0.92


def test_udfs_that_are_exploded_run_once(spark):
    from scholion.operators import reading, shredding
    from scholion.sources import replay

    rows = spark.createDataFrame([(1, "<article><p>a. b</p></article>"), (2, ""), (3, None)], "id long, t string")
    pages = rows.selectExpr("'r' AS route_id", "'europe_pmc' AS source", "id AS page", """'{"resultList":{"result":[{"title":"t"},{"title":"u"}]}}' AS raw""")
    frames = (reading.chunk(rows, "id", "t", 9), replay.records(pages), shredding.html_elements(rows.na.fill(""), "id", "t"), shredding.jats_elements(rows.where("id = 1"), "id", "t"))
    for found in frames:
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in frames[0].orderBy("pos").collect()] == [(1, 0, 0, 9, "<article>"), (1, 1, 9, 15, "<p>a. "), (1, 2, 15, 24, "b</p></ar"), (1, 3, 24, 30, "ticle>")]
    assert [(r.page, r.place, r.title) for r in frames[1].orderBy("page", "place").collect()] == [(p, k, x) for p in (1, 2, 3) for k, x in enumerate("tu")]
