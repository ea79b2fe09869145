"""The merge in parallel rounds against the sequential fold."""

import math
import random

import pytest

from scholion.operators import identity
from scholion.operators.identity import STRONG

SCHEMA = "pos long, keys array<string>, title string, authors array<string>, year long, doi string, pmid string, sources array<string>"


def compatible(a: dict, b: dict) -> bool:
    """May two records be one? Differing strong ids forbid it; without a shared id so do providers, years, authors."""
    for name in STRONG:
        if a.get(name) and b.get(name) and a[name] != b[name]:
            return False
    if {k for k in a["keys"] if not k.startswith("title:")} & {k for k in b["keys"] if not k.startswith("title:")}:
        return True
    for space in ("openalex:", "semantic_scholar:"):
        mine, other = ({k for k in x["keys"] if k.startswith(space)} for x in (a, b))
        if mine and other and not mine & other:
            return False
    if a.get("year") and b.get("year") and a["year"] != b["year"]:
        return False
    mine, other = ({x.lower() for x in r.get("authors") or []} for r in (a, b))
    return not (mine and other and not mine & other)


def absorb(a: dict, b: dict) -> None:
    """b's values where a has none, the longer abstract, the larger count, all sources and keys in order."""
    for name in ("title", "year", "journal", "url", *STRONG):
        a[name] = a.get(name) or b.get(name)
    a["authors"] = a.get("authors") or b.get("authors")
    a["abstract"] = max(a.get("abstract") or "", b.get("abstract") or "", key=len)
    counts = [x for x in (a.get("citation_count"), b.get("citation_count")) if x is not None and not (isinstance(x, float) and math.isnan(x))]
    a["citation_count"] = max(counts) if counts else None
    a["sources"] = list(dict.fromkeys([*(a.get("sources") or []), *(b.get("sources") or [])]))
    a["keys"] = list(dict.fromkeys([*a["keys"], *b["keys"]]))
    a["members"] += b["members"]


def fold(records: list[dict]) -> list[dict]:
    """Greedy merge in input order: each record joins the first compatible one that shares a key, else stands alone;
    if it shared keys without being compatible, all involved are flagged."""
    out: list[dict] = []
    holders: dict[str, list[int]] = {}
    for r in records:
        r = {"members": [r["pos"]], "identity_conflict": False, **r}
        near = list(dict.fromkeys(i for k in r["keys"] for i in holders.get(k, [])))
        at = next((i for i in near if compatible(out[i], r)), None)
        if at is None:
            at = len(out)
            out.append(r)
            if near:
                for i in (*near, at):
                    out[i]["identity_conflict"] = True
        else:
            absorb(out[at], r)
        for k in out[at]["keys"]:
            if at not in holders.setdefault(k, []):
                holders[k].append(at)
    return out


def sequential(rows):
    names = SCHEMA.replace(" long", "").replace(" array<string>", "").replace(" string", "").split(", ")
    merged = fold([dict(zip(names, r)) for r in sorted(rows)])
    return sorted((m["pos"], m.get("title") or None, m.get("year"), m["keys"], sorted(m["members"]), m["identity_conflict"]) for m in merged)


def parallel(spark, rows):
    found = identity.merge_records(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted((r.pos, r.title, r.year, r["keys"], r.members, r.identity_conflict) for r in found)


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_the_sequential_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for pos in range(70):
        doi = rng.choice([None, None, "", f"10.1/{rng.randint(0, 40)}"])
        pmid = rng.choice([None, None, str(rng.randint(0, 40))])
        keys = [f"title:{rng.choice('abcdefghijklmnop')} a title of twenty letters"] if rng.random() < 0.5 else []
        keys += [f"doi:{doi}"] * bool(doi) + [f"pmid:{pmid}"] * bool(pmid)
        keys += [f"{rng.choice(['openalex', 'semantic_scholar'])}:w{rng.randint(0, 40)}"] if rng.random() < 0.4 else []
        rng.shuffle(keys)
        people = rng.choice([None, [], ["Ann B"], ["ann b", "C D"], ["E F"]])
        rows.append((3 * pos, keys, rng.choice([None, "", f"t{pos}"]), people, rng.choice([None, 2020, 2021]), doi, pmid, []))
    rng.shuffle(rows)
    assert parallel(spark, rows) == sequential(rows)


def test_long_chains_need_few_rounds(spark, monkeypatch):
    n = 10_000
    rng = random.Random(9)
    rows = [(p, [f"pmid:k{p}", f"doi:k{p + 1}"], f"t{p}", None, None, None, None, []) for p in range(n)]
    rows = [(p, [k.replace("pmid", "x").replace("doi", "x") for k in keys], *rest) for p, keys, *rest in rows]
    # two records that contradict their chain: all that follow them must move
    for at in (3000, 7000):
        p, keys, title, _, _, _, pmid, sources = rows[at]
        rows[at] = (p, keys, title, None, None, "10.1/other" + str(at), pmid, sources)
    rows[0] = (*rows[0][:5], "10.1/first", *rows[0][6:])
    rng.shuffle(rows)
    rounds = []
    plain = identity._choices
    monkeypatch.setattr(identity, "_choices", lambda *a: rounds.append(1) or plain(*a))
    found = identity.identities(spark.createDataFrame(rows, SCHEMA)).groupBy("entity").count().collect()
    assert sorted((r.entity, r["count"]) for r in found) == [(0, 3000), (3000, 4000), (7000, 3000)]
    assert len(rounds) <= 5


def test_additions_never_rename_originals(spark):
    rows = [
        (0, ["doi:a"], "a", None, None, "a", None, True, "cand-0", 2, "include"),
        (1, ["title:one long title of twenty letters"], "b", None, 2020, None, None, True, "cand-1", 1, "exclude"),
        (2, ["doi:a", "pmid:7"], "c", None, None, "a", "7", False, "cand-2", 9, None),
        (3, ["title:one long title of twenty letters"], "d", None, 2021, None, None, False, "cand-3", 9, None),
        (4, ["pmid:7"], "e", None, None, None, "7", False, "cand-4", 9, None),
        (5, ["title:one long title of twenty letters"], "f", None, 2021, None, None, False, "cand-5", 9, None),
        (6, ["doi:a"], "g", None, None, "a", None, True, "cand-6", 3, "late"),
    ]
    schema = "pos long, keys array<string>, title string, authors array<string>, year long, doi string, pmid string, original boolean, candidate string, rank long, screening string"
    found = identity.merge_additions(spark.createDataFrame(rows, schema), "original", "candidate", "rank", ("screening",)).collect()
    assert sorted((r.pos, r.candidate_id, r.pinned, r.identity_conflict, r.screening) for r in found) == [
        (0, "cand-0", True, False, "include"), (1, "cand-1", True, True, "exclude"), (2, "cand-0", True, False, "include"), (3, "cand-3", False, True, None),
        (4, "cand-0", True, False, "include"), (5, "cand-3", False, True, None), (6, "cand-0", True, False, "include"),
    ]
    assert identity.identities(spark.createDataFrame([], SCHEMA)).count() == 0


def test_additions_read_their_records_once(spark):
    made = spark.sparkContext.accumulator(0)

    def once(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(p, [f"doi:d{p % 9}"], f"d{p % 9}", p % 3 == 0, f"cand-{p:02d}", p, "x" * 99) for p in range(40)]
    schema = "pos long, keys array<string>, doi string, original boolean, candidate string, rank long, body string"
    records = spark.createDataFrame(rows, schema).mapInArrow(once, schema)
    found = identity.merge_additions(records, "original", "candidate", "rank")
    assert found.count() == 40 and {r.candidate_id for r in found.where("pos % 9 = 3").collect()} == {"cand-03"}
    assert made.value == 40
