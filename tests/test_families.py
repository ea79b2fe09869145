"""The family builder on worked-out cases."""

import random

import pytest
from pyspark.sql import functions as F

from scholion.operators import work_families

SCHEMA = "id long, title string, authors array<string>, year int, abstract string, doi string, pmid string, pmcid string, arxiv_id string, item_type string, publication_types array<string>"
RELATION = "subject long, relation string, target_type string, target_id string, source string, source_record string, evidence_url string, source_sha256 string"
TITLE = "Hyperchloremia after cardiac surgery and renal outcomes of critically ill adults: a cohort"
PEOPLE = ["Anna Leeson", "Bob Chandler", "Cy Moerk"]


def abstract(rng, n=130):
    filler = " ".join(f"finding{rng.randrange(10_000)}word" for _ in range(n))
    return f"Methods: A total of 1200 adults were studied. Results: mortality followed sodium >= 145 {filler} (OR = 2.195, 95% CI: 1.4-3.2)."


@pytest.fixture(scope="module")
def cases(spark):
    one, two = abstract(random.Random(1)), abstract(random.Random(2))
    row = lambda k, title, kind, text, year=2020, doi=None, people=PEOPLE, types=None: (k, title, people, year, text, doi or f"10.1000/d{k}", "", "", "", kind, types)
    rows = [
        row(1, TITLE, "preprint", one), row(2, TITLE, "journalArticle", one, 2021),  # one work by its metadata
        row(3, "Another long specific title about chloride handling in neonatal kidney transport", "preprint", two),
        row(4, "Another long specific title about chloride handling in neonatal kidney transport", "journalArticle", two, 2030),  # years too far apart
        row(5, "Short title", "preprint", "x"), row(6, "Different title", "journalArticle", "y", people=["Zed Other"]),  # declared below
        row(7, "Comment on something", "journalArticle", ""), row(8, "Thing eight", "preprint", ""), row(9, "Thing nine", "journalArticle", ""), row(10, "Thing ten", "journalArticle", "", people=["Quite Another"]),
    ]
    told = lambda a, b, relation, host="api.crossref.org": (a, relation, "doi", f"https://doi.org/10.1000/D{b}", "crossref", f"doi:10.1000/d{a}", f"https://{host}/works/x", "a" * 64)
    relations = [
        told(5, 6, "isPreprintOf"), told(5, 7, "isPreprintOf"), told(8, 9, "is-preprint-of"), told(8, 10, "is-preprint-of"), told(1, 99, "has-version"), told(3, 4, "hasComment"), told(2, 1, "is-preprint-of"),
        told(1, 2, "is-preprint-of", "evil.example"), told(1, 1, "is-version-of"),
    ]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(relations, RELATION)


def found(built):
    return {
        "families": sorted((r.component, r.members, r.representative, r.classification) for r in built.families.collect()),
        "relations": sorted((r.subject, r.object or 0, r.status, r.reason) for r in built.relations.collect()),
        "metadata": sorted((r.a, r.b, r.status, r.reason) for r in built.metadata.collect()),
        "counts": built.counts.head().asDict(),
    }


def test_layers_and_reasons(cases):
    out = found(work_families.build(*cases))
    assert (1, 2, 2, "high_confidence_metadata") in out["families"]
    # 8 names two journal articles that aren't linked with each other: the whole component is blocked
    assert [r for r in out["relations"] if r[0] == 8] == [(8, 9, "blocked", "transitive_component_conflict"), (8, 10, "blocked", "transitive_component_conflict")]
    # 5 - 6 - 7: 7 is a notice, so its relation is for review and 5 - 6 stays
    assert (5, 6, "accepted", "declared_version_relation") in out["relations"] and (5, 7, "review", "separate_related_work") in out["relations"]
    reasons = {r[3] for r in out["relations"]}
    assert {"target_not_in_inventory", "non_version_relation", "contradictory_preprint_direction", "unbound_or_untrusted_provider_provenance", "self_relation"} <= reasons
    assert (3, 4, "review", "explicit_non_version_relation") in out["metadata"]
    counts = out["counts"]
    assert counts["record_count"] == 10 and counts["accepted_provider_relations"] == 1 and counts["accepted_metadata_relations"] == 1 and counts["blocked_relations"] == 2
    assert counts["work_family_count"] == 8 and counts["singleton_families"] == 6 and counts["confirmed_layer_family_count"] == 9


def test_order_of_input_does_not_matter(cases):
    records, relations = cases
    assert found(work_families.build(records.orderBy(F.desc("id")).repartition(3), relations.orderBy(F.rand(3)))) == found(work_families.build(records, relations))


def test_an_id_held_twice_is_an_error(cases):
    records, relations = cases
    with pytest.raises(ValueError):
        work_families.build(records.unionByName(records.where("id = 1")), relations)


def test_pairs_within_groups(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(40)] + [(9, 100)], "g int, id long")
    made = [tuple(r) for r in work_families.pairs_within(rows, "g", "id", part=4).collect()]
    assert sorted(made) == sorted((g, a, b) for g in range(3) for a in range(40) for b in range(40) if a < b and a % 3 == g == b % 3)


def test_pairs_across_groups(spark):
    left, right = [(k % 3, k) for k in range(25)] + [(8, 200)], [(k % 3, 100 + k) for k in range(31)] + [(9, 300)]
    made = work_families.pairs_across(spark.createDataFrame(left, "g int, id long"), spark.createDataFrame(right, "g int, id long"), "g", "id", part=4)
    assert sorted(map(tuple, made.collect())) == sorted((a, b) for g, a in left for h, b in right if g == h)


def test_near_pairs_lose_no_candidate(spark):
    """Against all pairs of preprint and journal records that share an author, with sentences that all abstracts hold."""
    rng, rows = random.Random(5), []
    names = ["Wei Wang", "Anna Leeson", "Bob Chandler", "Li"]
    pool = [f"titleword{k}" for k in range(14)]
    texts = [abstract(random.Random(k), 40) for k in range(3)]
    for k in range(60):
        words = rng.choice(texts).split()
        cut = rng.randrange(0, 30)
        rows.append((k, " ".join(rng.sample(pool, 8)), rng.sample(names, 2), rng.choice([2001, 2004, 2005, 2009, None]), " ".join(words[:20] + words[20 + cut :]), "", "", "", "", rng.choice(["preprint", "journalArticle"]), None))
    who = work_families.members(spark.createDataFrame(rows, SCHEMA)).cache()
    made = {tuple(r) for r in work_families.near_pairs(who).collect()}
    light = who.select("id", "role", "year", work_families.key_column("authors").alias("people"))
    every = light.toDF("a", "ra", "ya", "pa").join(light.toDF("b", "rb", "yb", "pb"), F.expr("a < b and ra <> rb and abs(ya - yb) <= 4 and arrays_overlap(pa, pb)")).select("a", "b")
    wanted = work_families.evidence(every, who).where("candidate or (shared_fivegrams >= 10 and distinctive_shared_tokens >= 20 and token_containment >= 0.55)")
    wanted = {(r.a, r.b) for r in wanted.collect()}
    assert wanted and wanted <= made <= {tuple(r) for r in every.collect()}


def test_a_frequent_author_and_sentence_do_not_pair_records(spark):
    rows = [(k, f"Title {k}", ["Wei Wang"], 2020, "One sentence that all of these records hold.", "", "", "", "", "preprint" if k % 2 else "journalArticle", None) for k in range(300)]
    assert work_families.near_pairs(work_families.members(spark.createDataFrame(rows, SCHEMA))).count() == 0
