"""Families of versions of one work: declared relations first, metadata evidence second, whole components or nothing.

Records never merge: a family is a view. Every step is a join or an aggregate over ids, so the result doesn't depend on
the order of the input:

1. ``members``: role, restrictions and typed aliases of each record.
2. ``resolve_relations``: a provider's relation is proposed if its target is exactly one other record and its provenance is
   bound to the provider; everything else is kept for review with a reason.
3. Components of proposed relations are accepted as a whole or, with one bad pair in them, blocked as a whole.
4. Candidate pairs by equal title or shared authors get evidence; those without a reason against them join, again by
   whole components over both layers, without touching what was accepted before.

Pairs inside a title, an author or a component are met in cells of two parts of about ``PART`` records, so no group is
collected; pairs are compared and leave only what they decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scholion.functions import normalize as n
from scholion.operators import families
from scholion.operators.authors import author_evidence, key_column
from scholion.operators.clinical import canonical_numbers, clinical_evidence
from scholion.operators.graph import connected_components
from scholion.operators.words import STOP_WORDS
from scholion.session import cut_lineage

PART = 200
#: Relations between versions, relations that part works, the hosts that speak for a provider.
VERSION_RELATIONS = ("is-preprint-of", "has-preprint", "is-version-of", "has-version", "is-manuscript-of", "has-manuscript")
OTHER_RELATIONS = (
    "is-translation-of has-translation is-comment-on has-comment is-reply-to has-reply is-review-of has-review is-correction-of has-correction "
    "is-retraction-of has-retraction updates is-update-of is-supplement-to is-supplemented-by is-part-of has-part"
).split()
PROVIDER_HOSTS = {
    "crossref": ("api.crossref.org", "www.crossref.org", "crossref.org"),
    "europe_pmc": ("www.ebi.ac.uk", "www.europepmc.org", "europepmc.org"),
}
ROLE_ORDER = {"journal": 0, "preprint": 1, "unknown": 2, "separate_related_work": 3}


def typed_alias(kind, value) -> Column:
    """``kind:value`` in normal form, '' for a kind or a value that isn't known."""
    kind = F.replace(F.lower(F.coalesce(kind, F.lit(""))), F.lit("-"), F.lit("_"))
    value = F.trim(F.coalesce(value, F.lit("")))
    clean = (
        F.when(kind == "doi", n.doi(value)).when(kind == "pmid", n.pmid(value)).when(kind == "pmcid", n.pmcid(value)).when(kind == "arxiv", n.arxiv_id(value))
        .when((kind == "europe_pmc") & value.rlike("^[A-Za-z]+:[A-Za-z0-9]+$"), F.lower(value)).when(kind.isin("openalex", "s2", "semantic_scholar"), value).otherwise("")
    )
    return F.when(clean == "", "").when(kind == "europe_pmc", F.concat(F.lit("europe_pmc:"), clean)).otherwise(n.work_alias(F.concat(kind, F.lit(":"), clean)))


def members(records: DataFrame) -> DataFrame:
    """(id, title, nt, authors, year, abstract, doi, ids, role, restricted, aliases) of records (id, title, authors, year,
    abstract, doi, pmid, pmcid, arxiv_id, item_type, publication_types). An id held twice is an error."""
    from scholion.operators.evaluation import require_unique

    require_unique(records, "id", "id")
    keys = n.identity_keys(doi="doi", pmid="pmid", pmcid="pmcid", arxiv="arxiv_id")
    rows = records.withColumn("role", families.role("publication_types", "item_type", "title")).withColumn("aliases", keys)
    strong = sum(F.when(F.coalesce(F.col(x), F.lit("")) != "", 1).otherwise(0) for x in ("doi", "pmid", "pmcid", "arxiv_id"))
    return rows.select(
        "id", "title", n.title("title").alias("nt"), "authors", F.col("year").cast("int").alias("year"), F.coalesce("abstract", F.lit("")).alias("abstract"), n.doi("doi").alias("doi"), strong.alias("ids"),
        "role", (F.col("role") == "separate_related_work").alias("restricted"), "aliases",
    )


def resolve_relations(who: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations (subject, relation, target_type, target_id, source, source_record, evidence_url, source_sha256) with object,
    status, reason and ``parts`` (does it say that both are different works?)."""
    targets = who.select("id", F.explode(F.filter("aliases", lambda a: ~a.startswith("title:"))).alias("alias"))
    targets = targets.groupBy(F.col("alias").alias("__alias")).agg(F.count_distinct("id").alias("__n"), F.min("id").alias("__object"))
    colon = F.instr("source_record", ":")
    rows = relations.withColumn("relation", n.relation_type("relation")).withColumn("target", typed_alias(F.col("target_type"), F.col("target_id")))
    rows = rows.withColumn("__own", typed_alias(F.expr("left(source_record, instr(source_record, ':') - 1)"), F.expr("substr(source_record, instr(source_record, ':') + 1)")))
    rows = rows.where(colon >= 0).join(targets, F.col("target") == F.col("__alias"), "left")
    subject = who.select(F.col("id").alias("subject"), F.col("aliases").alias("__mine"), F.col("restricted").alias("__r1"), F.col("role").alias("__role1"))
    object_ = who.select(F.col("id").alias("__object"), F.col("restricted").alias("__r2"), F.col("role").alias("__role2"))
    rows = rows.join(subject, "subject").withColumn("__object", F.when(F.col("__n") == 1, F.col("__object"))).join(object_, "__object", "left")
    own_host = F.lit(False)
    for source, hosts in PROVIDER_HOSTS.items():
        own_host = own_host | ((F.lower("source") == source) & n.host("evidence_url").isin(*hosts))
    address = F.coalesce(F.col("evidence_url"), F.lit(""))
    plain = address.startswith("https://") & ~address.contains("@") & (~address.contains("?") | (F.lower("source") == "europe_pmc"))
    bound = own_host & plain & (F.col("__own") != "") & F.array_contains("__mine", F.col("__own")) & F.lower("source_sha256").rlike("^[0-9a-f]{64}$")
    bound = F.coalesce(bound, F.lit(False))
    first, second = F.col("__role1"), F.col("__role2")
    backwards = ((F.col("relation") == "has-preprint") & ((first == "preprint") | (second == "journal"))) | ((F.col("relation") == "is-preprint-of") & ((first == "journal") | (second == "preprint")))
    count = F.coalesce("__n", F.lit(0))
    reason = (
        F.when(count == 0, "target_not_in_inventory").when(count > 1, "ambiguous_target").when(F.col("__object") == F.col("subject"), "self_relation")
        .when(F.col("relation").isin(*OTHER_RELATIONS), "non_version_relation").when(~F.col("relation").isin(*VERSION_RELATIONS), "unsupported_relation_type")
        .when(~bound, "unbound_or_untrusted_provider_provenance").when(F.col("__r1") | F.col("__r2"), "separate_related_work").when(backwards, "contradictory_preprint_direction").otherwise("")
    )
    parts = bound & (count == 1) & (F.col("__object") != F.col("subject")) & F.col("relation").isin(*OTHER_RELATIONS)
    out = rows.select("subject", F.col("__object").alias("object"), "relation", "target", "source", reason.alias("reason"), F.coalesce(parts, F.lit(False)).alias("parts"))
    return out.withColumn("status", F.when(F.col("reason") == "", "proposed").otherwise("review")).distinct()


def pairs_within(rows: DataFrame, group: str, node: str, part: int = PART) -> DataFrame:
    """(group, a, b) of every two rows of a group, once: a group's rows are dealt into parts, and two parts meet in a cell."""
    sizes = rows.groupBy(F.col(group).alias("__of")).agg(F.count(F.lit(1)).alias("__m")).where("__m > 1").withColumn("__parts", F.ceil(F.col("__m") / part).cast("int"))
    dealt = rows.select(group, node).join(sizes, F.col(group) == F.col("__of")).withColumn("__part", F.pmod(F.xxhash64(node), "__parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    left = dealt.select(F.col(group), F.col(node).alias("a"), F.col("__part").alias("low"), every.alias("high"))
    right = dealt.select(F.col(group).alias("__g"), F.col(node).alias("b"), F.col("__part").alias("__high"), every.alias("__low"))
    met = (F.col(group) == F.col("__g")) & (F.col("low") == F.col("__low")) & (F.col("high") == F.col("__high")) & (F.col("a") < F.col("b"))
    return left.join(right, met).select(group, "a", "b")


_FIELDS = ("nt", "authors", "year", "abstract", "doi", "role", "restricted")


def evidence(pairs: DataFrame, who: DataFrame) -> DataFrame:
    """Pairs (a, b) with what speaks for and against one work: ``reasons`` (none: confident), ``support``, ``titles_equal``,
    ``disjoint`` authors, conflicts, and the numbers they rest on."""
    a = who.select(F.col("id").alias("a"), *[F.col(x).alias(f"a_{x}") for x in _FIELDS])
    b = who.select(F.col("id").alias("b"), *[F.col(x).alias(f"b_{x}") for x in _FIELDS])
    rows = pairs.select("a", "b").join(a, "a").join(b, "b")
    rows = rows.withColumn("a_words", n.title(canonical_numbers("a_abstract"))).withColumn("b_words", n.title(canonical_numbers("b_abstract")))
    rows = families.title_evidence(rows, "a_nt", "b_nt").withColumnRenamed("containment", "title_containment").withColumnRenamed("shared_tokens", "title_tokens")
    rows = families.abstract_evidence(rows, "a_words", "b_words")
    rows = rows.withColumn("people", author_evidence("a_authors", "b_authors")).withColumn("clinical", clinical_evidence("a_abstract", "b_abstract"))
    telling = lambda x: F.size(F.filter(F.array_distinct(F.split(x, " ")), lambda w: ~w.isin(STOP_WORDS))) >= 6
    specific = lambda x: telling(x) & (F.length(x) >= 45)
    equal = (F.col("a_nt") != "") & (F.col("a_nt") == F.col("b_nt"))
    roles = F.array_sort(F.array("a_role", "b_role"))
    paired = roles == F.array(F.lit("journal"), F.lit("preprint"))
    printed = F.when(F.col("a_role") == "journal", F.col("a_year")).otherwise(F.col("b_year"))
    drafted = F.when(F.col("a_role") == "preprint", F.col("a_year")).otherwise(F.col("b_year"))
    years = F.coalesce((F.abs(F.col("a_year") - F.col("b_year")) <= 4) & (~paired | (drafted <= printed + 1)), F.lit(False))
    m, short, long_ = F.col("people.matched"), F.col("people.shorter"), F.col("people.longer")
    strict = F.col("people.compatible") & (m >= 2) & (10 * m >= 8 * short) & (2 * m >= long_)
    thirds = lambda low: F.size(F.filter(F.slice("coverage_by_third", low, 3), lambda v: v >= 0.1)) >= 2
    word_count = lambda x: F.size(F.split(x, " "))
    edited = (
        (F.least(word_count("a_words"), word_count("b_words")) >= 100) & (F.col("shared_fivegrams") >= 20) & (F.col("distinctive_shared_tokens") >= 25)
        & (F.col("token_containment") >= 0.65) & (F.col("fivegram_dice") >= 0.2) & thirds(1) & thirds(4)
    )
    calm = F.size("clinical.conflicts") == 0
    free = ~F.col("a_restricted") & ~F.col("b_restricted")
    title_ok = F.when(equal, specific("a_nt")).otherwise(specific("a_nt") & specific("b_nt"))
    text_ok = F.when(equal, F.col("strong")).otherwise(edited)
    checks = [
        (free, "separate_related_work"), (title_ok, "generic_title"), (F.col("people.compatible"), "insufficient_author_evidence"), (years, "incompatible_or_missing_years"),
        (paired, "not_preprint_journal_pair"), (text_ok, "insufficient_distinctive_abstract"), (calm, "conflicting_cohort_or_result_evidence"),
        (equal | strict, "insufficient_changed_title_author_evidence"), (equal | F.col("clinical.strong"), "insufficient_independent_result_fingerprints"),
    ]
    support = free & F.col("people.compatible") & years & calm & F.when(equal, specific("a_nt") & F.col("strong")).otherwise(title_ok & strict & edited & F.col("clinical.strong"))
    return rows.select(
        "a", "b", equal.alias("titles_equal"), F.col("people.disjoint").alias("disjoint"), support.alias("support"), "shared_fivegrams", "distinctive_shared_tokens", "token_containment", "candidate",
        F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks])).alias("reasons"),
        (F.col("a_role").eqNullSafe("journal") & F.col("b_role").eqNullSafe("journal") & (F.col("a_doi") != "") & (F.col("b_doi") != "") & (F.col("a_doi") != F.col("b_doi"))).alias("two_journals"), (~free).alias("restricted"),
    )


def pairs_across(left: DataFrame, right: DataFrame, group: str, node: str, part: int = PART) -> DataFrame:
    """(a, b) of every row on the left with every one on the right of its group: two parts of a group meet in a cell."""

    parts = lambda rows, name: rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias(name))
    sizes = parts(left, "__as").join(parts(right, "__bs"), group)  # groups without one of the sides end here
    place = lambda count: F.pmod(F.xxhash64(node), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    one = left.select(group, node).join(sizes, group).select(group, F.col(node).alias("a"), place("__as").alias("__i"), every("__bs").alias("__j"))
    other = right.select(group, node).join(sizes, group).select(group, F.col(node).alias("b"), place("__bs").alias("__j"), every("__as").alias("__i"))
    return one.join(other, [group, "__i", "__j"]).select("a", "b")


def telling_items(items: DataFrame, shared: int) -> DataFrame:
    """(id, item) without the ``shared - 1`` most frequent items of each id. Two ids with ``shared`` common items have one
    left in common: of those they share, the rarest. Items of a single id can't be shared and go at once."""
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("__n"), "item"))  # items of one record
    return items.join(counts, "item").withColumn("__place", place).where(F.col("__place") >= shared).select("id", "item")


#: What the evidence asks for at least: words of both titles, five-word runs of both abstracts; years between two versions.
TITLE_WORDS, ABSTRACT_RUNS, YEARS = 4, 10, 4


def near_pairs(who: DataFrame) -> DataFrame:
    """(a, b), a < b: a preprint and a journal record at most ``YEARS`` apart that share an author and enough of the title or the
    abstract to be worth comparing.

    They meet by an author, a telling word or run and a band of years together, so a frequent author's records, or those with a
    frequent sentence, don't meet each other: no pair is made that the evidence couldn't take for that reason.
    """
    rows = who.where("role in ('preprint', 'journal') and year is not null").select("id", "role", "year", "nt", "abstract", key_column("authors").alias("people")).where(F.size("people") > 0)
    rows = cut_lineage(rows)
    words = F.filter(F.array_distinct(F.split("nt", " ")), lambda w: ~w.isin(STOP_WORDS))
    titles = telling_items(rows.select("id", F.explode(words).alias("word")).select("id", F.xxhash64(F.lit("t"), "word").alias("item")).distinct(), TITLE_WORDS)
    read = rows.select("id", F.split(n.title(canonical_numbers("abstract")), " ").alias("words"))
    texts = telling_items(read.select("id", F.explode(families.shingles("words", 5)).alias("run")).select("id", F.xxhash64(F.lit("a"), "run").alias("item")).distinct(), ABSTRACT_RUNS)
    keyed = titles.unionByName(texts).join(rows.select("id", "role", "year", F.explode("people").alias("person")), "id")
    band = F.floor(F.col("year") / (YEARS + 1))
    drafts = keyed.where("role = 'preprint'").select("id", F.xxhash64("person", "item", band).alias("cell"))
    printed = keyed.where("role = 'journal'").withColumn("band", F.explode(F.array(band - 1, band, band + 1))).select("id", F.xxhash64("person", "item", "band").alias("cell"))
    met = cut_lineage(pairs_across(cut_lineage(drafts), cut_lineage(printed), "cell", "id").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    side = lambda x: rows.select(F.col("id").alias(x), F.col("year").alias(f"y{x}"), F.col("people").alias(f"p{x}"))
    return met.join(side("a"), "a").join(side("b"), "b").where(f"abs(ya - yb) <= {YEARS} and arrays_overlap(pa, pb)").select("a", "b")


def candidate_pairs(who: DataFrame) -> DataFrame:
    """Pairs with an equal title, and preprint and journal records up to four years apart that share an author and either
    enough of the title or enough of the abstract."""
    same = pairs_within(who.where("nt <> ''"), "nt", "id").select("a", "b")
    near = near_pairs(who).join(same, ["a", "b"], "left_anti")
    read = evidence(near, who).where(f"candidate or (shared_fivegrams >= {ABSTRACT_RUNS} and distinctive_shared_tokens >= 20 and token_containment >= 0.55)")
    return same.unionByName(read.select("a", "b")).distinct()


def _components(who: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all members."""
    found = connected_components(edges, "a", "b")
    return cut_lineage(who.select("id").join(found, F.col("id") == F.col("vertex"), "left").select("id", F.coalesce("component", "id").alias("component")))


def _bad_components(who: DataFrame, edges: DataFrame, apart: DataFrame, explicit: DataFrame, metadata_layer: bool) -> tuple[DataFrame, DataFrame]:
    """(membership, components with a pair that doesn't belong together).

    All members are compared with the first one of their component, which finds most bad components, and every restricted
    member, in as many pairs as there are members; only components without a fault there are compared in all pairs.
    """
    place = _components(who, edges)
    said = apart.select("a", "b", F.lit(True).alias("said_apart"))
    known = explicit.select("a", "b", F.lit(True).alias("linked"))

    def faulty(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            return pairs.select("component")
        read = evidence(pairs, who).join(said, ["a", "b"], "left").join(known, ["a", "b"], "left").join(pairs, ["a", "b"])
        bad = F.coalesce("said_apart", F.lit(False)) | F.col("restricted")
        unlinked = F.col("two_journals") | (F.col("disjoint") & ~F.col("titles_equal"))
        if metadata_layer:
            unlinked = unlinked | ~F.coalesce("support", F.lit(False))
        bad = bad | (~F.coalesce("linked", F.lit(False)) & unlinked)
        return cut_lineage(read.where(bad).select("component").distinct())

    heads = place.groupBy("component").agg(F.min("id").alias("a"))
    with_head = place.withColumnRenamed("id", "b").join(heads, "component").where("a < b").select("component", "a", "b")
    early = faulty(with_head)
    rest = pairs_within(place.join(early, "component", "left_anti"), "component", "id")
    late = faulty(rest.join(with_head, ["component", "a", "b"], "left_anti"))
    return place, early.unionByName(late)


def _sorted(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()


@dataclass
class Families:
    relations: DataFrame  # subject, object, relation, target, source, reason, parts, status
    metadata: DataFrame  # a, b, status, reason
    families: DataFrame  # component, members, representative, classification
    confirmed: DataFrame
    counts: DataFrame


def _inventory(who: DataFrame, place: DataFrame, by_metadata: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for pair in ROLE_ORDER.items() for x in pair])
    best = F.struct(F.element_at(order, F.col("role")), -F.col("ids"), -F.length("abstract"), F.col("id"))
    marked = by_metadata.join(place, F.col("a") == F.col("id")).select("component").distinct().withColumn("__m", F.lit(True))
    out = who.join(place, "id").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min_by("id", best).alias("representative"))
    kind = F.when(F.col("__m"), "high_confidence_metadata").when(F.col("members") > 1, "confirmed_relation").otherwise("singleton")
    return out.join(marked, "component", "left").select("component", "members", "representative", kind.alias("classification"))


def build(records: DataFrame, relations: DataFrame) -> Families:
    who = cut_lineage(members(records))
    edges = cut_lineage(resolve_relations(who, relations))
    proposed, apart = _sorted(edges.where("status = 'proposed'")), _sorted(edges.where("parts"))
    place, bad = _bad_components(who, proposed, apart, proposed, False)
    blocked = place.join(bad, "component").select("id")
    edges = edges.join(blocked.select(F.col("id").alias("subject"), F.lit(True).alias("__blocked")), "subject", "left")
    taken = (F.col("status") == "proposed") & F.col("__blocked").isNull()
    edges = cut_lineage(edges.select(
        "subject", "object", "relation", "target", "source", "parts",
        F.when(taken, "declared_version_relation").when(F.col("status") == "proposed", "transitive_component_conflict").otherwise(F.col("reason")).alias("reason"),
        F.when(taken, "accepted").when(F.col("status") == "proposed", "blocked").otherwise("review").alias("status"),
    ))
    accepted = _sorted(edges.where("status = 'accepted'"))
    confirmed = _components(who, accepted)
    groups = confirmed.toDF("a", "ca")
    fresh = candidate_pairs(who).join(groups, "a").join(groups.toDF("b", "cb"), "b").where("ca <> cb").select("a", "b")
    read = evidence(fresh, who).select("a", "b", "reasons", "titles_equal")
    read = read.join(apart.withColumn("__apart", F.lit(True)), ["a", "b"], "left")
    for side in "ab":
        read = read.join(blocked.select(F.col("id").alias(side), F.lit(True).alias(f"__{side}")), side, "left")
    clash, told = F.col("__a").isNotNull() | F.col("__b").isNotNull(), F.col("__apart").isNotNull()
    why = (
        F.when(clash, "conflicting_provider_component").when(told, "explicit_non_version_relation").when(F.size("reasons") == 0, "")
        .when(F.col("titles_equal"), "same_title_insufficient_version_evidence").otherwise("changed_title_insufficient_version_evidence")
    )
    read = cut_lineage(read.select("a", "b", why.alias("reason")))
    hopeful = read.where("reason = ''").select("a", "b")
    place, bad = _bad_components(who, accepted.unionByName(hopeful), apart, proposed, True)
    fallen = place.join(bad, "component").select(F.col("id").alias("a"), F.lit(True).alias("__bad"))
    metadata = read.join(fallen, "a", "left")
    metadata = cut_lineage(metadata.select(
        "a", "b",
        F.when((F.col("reason") == "") & F.col("__bad").isNull(), "accepted").when(F.col("reason") == "", "blocked").otherwise("review").alias("status"),
        F.when((F.col("reason") == "") & F.col("__bad").isNull(), "high_confidence_metadata_not_external_confirmation").when(F.col("reason") == "", "transitive_component_conflict").otherwise(F.col("reason")).alias("reason"),
    ))
    joined = metadata.where("status = 'accepted'").select("a", "b")
    inventory = cut_lineage(_inventory(who, _components(who, accepted.unionByName(joined)), joined))
    plain = cut_lineage(_inventory(who, confirmed, joined.limit(0)))
    return Families(edges, metadata, inventory, plain, _counts(who, edges, metadata, inventory, plain))


def _counts(who, edges, metadata, inventory, plain) -> DataFrame:
    number = lambda rows, name, where=None: rows.agg((F.count_if(F.expr(where)) if where else F.count(F.lit(1))).alias(name))
    parts = [
        number(who, "record_count"), number(plain, "confirmed_layer_family_count"), number(inventory, "work_family_count"),
        number(plain, "confirmed_relation_families", "classification = 'confirmed_relation'"), number(inventory, "high_confidence_metadata_families", "classification = 'high_confidence_metadata'"),
        number(inventory, "singleton_families", "classification = 'singleton'"), number(edges, "accepted_provider_relations", "status = 'accepted'"),
        number(metadata, "accepted_metadata_relations", "status = 'accepted'"), number(edges.select("status").unionByName(metadata.select("status")), "blocked_relations", "status = 'blocked'"),
        number(edges.select("status", "reason").unionByName(metadata.select("status", "reason")), "review_candidates", "status <> 'accepted' and reason <> 'self_relation'"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.join(F.broadcast(more))  # one row each
    return out
