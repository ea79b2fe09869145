"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns and no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scholion.llm import fingerprint, jaccard, language, mixing, neighbours, pages, pieces, resampling, suffix, toxicity
from scholion.llm import common as c

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, spans string, copy string"


def made_texts(seed=0, n=80):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(120))
    texts = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))
        if k % 7 == 0 and texts:
            text = rng.choice(texts)
        if k % 5 == 0 and texts:
            near = rng.choice(texts).split(" ")
            near[rng.randrange(len(near))] = "edited"
            text = " ".join(near)
        if k % 9 == 0:
            text = f"{text} é{passage} {k}"
        texts.append(text)
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = made_texts()
    rows = [(k, t, ["de", "en", None][k % 3], ["a", "a", "b", None][k % 4], len(t), "x", k, "s", "c") for k, t in enumerate(texts)]
    rows += [(200, None, None, None, None, None, None, None, None), (201, "", "en", "a", 0, "", 1, "", ""), (201, "", "en", "a", 0, "", 1, "", "")]
    rows += [(None, "null id text of a few words", "en", "b", 5, "", 1, "", ""), (202, "word " * 9000, "en", "b", 45000, "", 1, "", ""), (203, "!!! 123", "de", "c", 7, "", 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, docs):
    rows = [(r.doc_id, 1 if r.doc_id % 3 else 0, 1 if "edited" in (r.text or "") else 0) for r in docs.where("doc_id is not null").collect()]
    return spark.createDataFrame([*rows, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


def test_jaccard_matches_brute_force(docs, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = [x for x in (r.text or "").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    forest = c.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                forest.union(i, j)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[forest.find(k)] = min(least.get(forest.find(k), r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), len(s), str(least.get(forest.find(k)))) for k, (r, s) in enumerate(zip(rows, sets)))
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_groups(docs).collect())
    assert found == expected
    assert jaccard.jaccard_groups(empty(docs)).count() == 0
    monkeypatch.setattr(jaccard, "BLOCK", 3)  # nearly every shared shingle is beyond a block
    monkeypatch.setattr(jaccard, "ROUTES", 0)
    monkeypatch.setattr(jaccard, "_ROUTE_SALT", jaccard._ROUTE_SALT[:1])
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_groups(docs).collect()) == expected


def kept_first(rows, size, share):
    """Brute force: of rows (id, text, ...) one of each group of linked word sets; all without words."""
    sets = []
    for r in rows:
        w = [x for x in "".join(x.lower() if "A" <= x <= "Z" else x for x in r[1] or "").split() if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    forest = c.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                forest.union(i, j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(forest.find(k), []).append(k)
    return [[rows[k] for k in g] for g in groups.values()]


def test_one_row_of_each_group_stays(docs, spark):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    a, b = "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey"
    rows += [(301, a, "x"), (302, a, "x"), (302, b, "x"), (305, b.upper(), "x"), (None, a, "y"), (None, b, "y"), (302, b, "z"), (400, "", "x"), (400, "", "x"), (None, None, "x")]
    rows += [(None, "only without an id " * 3, "p"), (None, "only without an id " * 3, "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as gone", "2 as row", "3 as __row", "4 as id").repartition(3)
    kept = jaccard.keep_first(frame, size=5, share=80)
    assert kept.columns == frame.columns
    found = [(r.doc_id, r.text, r.lang) for r in kept.collect()]
    for group in kept_first(rows, 5, 80):
        inside = [r for r in found if r in group]
        if len(group) == 1 or not (group[0][1] or "").split():
            continue
        ids = [r[0] for r in group if r[0] is not None]
        distinct = {r for r in found if r in group}
        assert len(distinct) == 1 and len(inside) == 1 and inside[0][0] == (min(ids) if ids else None)
    assert len(found) == sum(1 if (g[0][1] or "").split() else len(g) for g in kept_first(rows, 5, 80))
    assert jaccard.keep_first(empty(frame)).count() == 0


def test_suffix_matches_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    raws = [(r.text or "").encode() for r in rows]
    count = {}
    for raw in raws:
        for i in range(len(raw) - 399):
            count[raw[i : i + 400]] = count.get(raw[i : i + 400], 0) + 1
    expected = []
    for r, raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            if count[raw[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        expected.append((str(r.doc_id), len(raw), int(gone.sum()), int((gone & np.r_[True, ~gone[:-1]]).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    found = suffix.repeats(docs).collect()
    assert sorted((str(r.doc_id), *r[1:5]) for r in found) == sorted(expected)
    assert all(len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)
    assert sorted(r.kept_sha256 for r in found) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in found)
    assert sum(x[2] for x in expected) > 1000
    assert suffix.repeats(empty(docs)).count() == 0
    assert suffix.cut_repeats(docs.where("doc_id < 0")).count() == 0
    cut = suffix.cut_repeats(docs, least=250)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_planted_passages_go_by_their_bytes_not_their_words(spark):
    """Passages of over 50 words: from 400 bytes on they go everywhere, shorter ones stay, as the 400-byte rule says."""
    rng = random.Random(11)
    draw = lambda n, least, most: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(least, most))) for _ in range(n))
    long, short = [draw(60, 7, 9) for _ in range(6)], [draw(55, 3, 6) for _ in range(6)]
    assert min(map(len, long)) >= 400 > max(map(len, short)) + 2
    texts = [f"{draw(20, 3, 8)} {p} {draw(20, 3, 8)}" for p in long + short for _ in range(3)] + [draw(120, 3, 8) for _ in range(20)]
    found = sorted(suffix.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect(), key=lambda r: r.doc_id)
    assert [r.n_bytes for r in found] == [len(t) for t in texts]  # of the whole text: it tells nothing of repeats
    for r, p in zip(found, [p for p in long for _ in range(3)]):
        assert p not in r.text and len(p) <= r.n_removed <= len(p) + 8 and r.n_spans == 1
    assert all(r.n_removed == 0 and r.text == texts[r.doc_id] for r in found[18:])


def test_passages_of_over_50_words_are_found_beside_the_400_bytes(spark):
    """The query's further columns: every word in a 51-word window that repeats goes, however short the words are; the columns before stay as they are."""
    rng = random.Random(12)
    draw = lambda n, least, most: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(least, most))) for _ in range(n))
    passages = [draw(60, 7, 9), draw(51, 3, 6), draw(55, 3, 6), draw(50, 3, 6), draw(50, 8, 9)]
    texts = [f"{draw(20, 3, 8)} {p} {draw(20, 3, 8)}" for p in passages for _ in range(3)] + [draw(120, 3, 8) for _ in range(10)]
    texts += [f"{passages[1]}\n", passages[2].replace(" ", " \t "), "one " * 52, "é " * 40 + passages[2], "", None, texts[0], texts[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    by_id = lambda f: sorted(f.collect(), key=lambda r: r.doc_id)
    plain, found = by_id(suffix.repeats(frame)), by_id(suffix.repeats(frame, words=50))
    assert [tuple(r)[:7] for r in found] == [tuple(r) for r in plain]
    places = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    words = [[(t or "").encode()[a:b] for a, b in p] for t, p in zip(texts, places)]
    count = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    for r, t, w, p in zip(found, texts, words, places):
        gone = [any(count[tuple(w[i : i + 51])] > 1 for i in range(max(0, k - 50), min(k, len(w) - 51) + 1)) for k in range(len(w))]
        runs = [(p[a][0], p[b - 1][1]) for a, b in zip([k for k in range(len(w)) if gone[k] and not (k and gone[k - 1])], [k + 1 for k in range(len(w)) if gone[k] and not (k + 1 < len(w) and gone[k + 1])])]
        raw = (t or "").encode()
        left = b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in runs]], [*[a for a, _ in runs], len(raw)]))
        assert r.n_passages == len(runs) and [(x.start, x.end) for x in r.passages] == runs and r.prose == left.decode()
    assert [r.n_passages for r in found[:15]] == [1] * 9 + [0] * 6 and [r.n_spans for r in found[3:9]] == [0] * 6
    assert [r.n_passages for r in found[15:25]] == [0] * 10 and [r.n_passages for r in found[25:]] == [1, 1, 1, 1, 0, 0, 1, 1]
    assert suffix.repeats(frame.where("doc_id < 0"), words=50).count() == 0


def test_keys_of_many_contents_are_split(spark):
    """One passage in many different surroundings: its key is halved until a task can hold it, the result stays the same."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(380)
    texts = [noise(rng.randint(0, 90)) + rng.choice("xy") * rng.randint(0, 9) + passage + rng.choice("pq") * rng.randint(0, 30) + noise(90) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    spans = lambda large: sorted((r.doc, sorted((int(s["start"]), int(s["end"])) for s in suffix.merge_spans(np.concatenate([np.frombuffer(x, suffix._SPAN) for x in r.spans])))) for r in suffix.repeated_spans(frame, large=large).collect())
    assert spans(1 << 30) == spans(2000) != []


def test_fingerprints_of_edited_texts(docs):
    found = fingerprint.edited_pairs(docs).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), r.text or ""))
    texts = [r.text or "" for r in rows]
    expected = []
    for k, (r, text) in enumerate(zip(rows, texts)):
        after = texts[(k + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        expected.append((str(r.doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert fingerprint.edited_pairs(empty(docs)).count() == 0
    assert fingerprint.fingerprint(docs).count() == docs.count()
    one = fingerprint.edited_pairs(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_language_and_undetermined(docs, spark):
    found = {r.doc_id: r for r in language.language_id(docs).collect()}
    assert found[200].lang_pred == found[203].lang_pred == found[201].lang_pred == "und" and found[200].score == 0
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items() if k is not None)
    assert language.language_id(empty(docs)).count() == 0
    speech = {"x": "kala mato siru", "y": "prunz grost wern"}
    rows = [(k, " ".join(random.Random(k).choice(speech["xy"[k % 2]].split()) for _ in range(30)), "xy"[k % 2]) for k in range(60)]
    result = language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == "xy"[r.doc_id % 2] for r in result)


def test_toxicity(docs, labels, spark):
    out = toxicity.toxicity(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.toxicity(empty(docs), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, empty(labels)).collect()} == {0.0}
    rng = random.Random(1)
    words = ["".join(rng.choice("klmnop") for _ in range(4)) for _ in range(50)]
    table = []
    for k in range(400):
        text = [rng.choice(words) for _ in range(30)]
        if k % 4 == 0:
            text[rng.randrange(30)] = rng.choice(["zaggard", "blort"])
        table.append((k, " ".join(text), int(k % 4 == 0)))
    frame = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    scored = toxicity.toxicity(frame.drop("toxic"), frame.drop("text")).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in scored)
    kept = toxicity.drop_toxic(frame.drop("toxic"), frame.drop("text"))
    assert kept.count() == 300 and kept.columns == ["doc_id", "text"]


def test_resampling(docs, labels, spark):
    rows = resampling.resample(docs, labels, share=0.5).collect()
    assert len(rows) == docs.count() and sum(r.selected for r in rows) >= round(0.5 * len(rows))
    assert min(r.gumbel_key for r in rows if r.selected) > max(r.gumbel_key for r in rows if not r.selected)
    assert resampling.resample(empty(docs), labels).count() == 0
    assert {r.log_ratio for r in resampling.resample(docs, empty(labels)).collect()} == {0.0}
    keys = spark.createDataFrame([(float(x),) for x in [5, 1, 3, 3, 3, 2, 9]], "v double")
    assert [resampling.kth_largest(keys, "v", k) for k in range(1, 8)] == [9, 5, 3, 3, 3, 2, 1]


def test_log_ratios_equal_brute_force(docs, labels):
    """Counts of words and pairs over all documents and over the good ones, by one text at a time."""
    import pyarrow as pa

    rows = docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in labels.where("quality = 1 and doc_id is not null").collect()}
    grams = [resampling.buckets(*c.text_buffer(pa.array([r.text or ""])))[0].tolist() for r in rows]
    for r, found in zip(rows, grams):
        words = [w for w in (r.text or "").split(" ") if w]
        assert len(found) == max(2 * len(words) - 1, 0)
    raw, target = [1.0] * resampling.BUCKETS, [1.0] * resampling.BUCKETS
    for r, found in zip(rows, grams):
        for b in found:
            raw[b] += 1
            target[b] += r.doc_id in good
    all_target, all_raw = sum(target), sum(raw)
    ratio = [math.log(0.8 * (t / all_target) / (x / all_raw) + 0.2) for t, x in zip(target, raw)]
    expected = sorted((str(r.doc_id), round(sum(ratio[b] for b in found), 5)) for r, found in zip(rows, grams))
    out = resampling.resample(docs, labels).collect()
    assert sorted((str(r.doc_id), round(r.log_ratio, 5)) for r in out) == expected
    share = sum(r.quality == 1 for r in labels.collect()) / sum(r.quality is not None for r in labels.collect())
    limit = sorted((r.gumbel_key for r in out), reverse=True)[round(share * len(out)) - 1]
    assert all(r.selected == (r.gumbel_key >= limit) for r in out)


def test_mixing(docs, spark):
    out = mixing.replicate(docs, weights={"a": 3.0, "b": 1.0})
    rows = out.collect()
    assert {r.source for r in rows} <= {"a", "b"} and "shuffle_key" in out.columns
    assert rows and sorted((r.doc_id or -1, r.copy) for r in rows) == sorted((r.doc_id or -1, r.copy) for r in out.collect())
    assert mixing.replicate(empty(docs)).count() == 0
    big = spark.range(20000).selectExpr("id as doc_id", "if(id % 10 = 0, 'x', 'y') as source")
    count = {r.source: r["count"] for r in mixing.replicate(big, {"x": 1.0, "y": 1.0}).groupBy("source").count().collect()}
    assert abs(count["x"] - 10000) < 400 and abs(count["y"] - 10000) < 400
    large = mixing.replicate(spark.range(300).selectExpr("id as doc_id", "if(id < 3, 'x', 'y') as source"), {"x": 1.0}).groupBy("doc_id").count().collect()
    assert abs(sum(r["count"] for r in large) - 300) < 90  # a rate of 100 is drawn in four parts
    nameless = spark.range(4000).selectExpr("if(id % 2 = 0, id, null) as doc_id", "'text ' || id as text", "'s' as source")
    for seed in (1, 2, 3):  # rows without an id draw by their texts, each for itself, and are dealt apart
        drawn = mixing.replicate(nameless, {"s": 1.0}, seed=seed).where("doc_id is null")
        assert abs(drawn.count() - 2000) < 5 * math.sqrt(2000) and drawn.select("shuffle_key").distinct().count() == drawn.count()
    twice = spark.range(3000).selectExpr("7L as doc_id", "'text ' || id as text", "'s' as source")
    assert abs(mixing.replicate(twice, {"s": 1.0}).count() - 3000) < 5 * math.sqrt(3000)
    steps = mixing.poisson_steps(2.5)
    assert math.isclose(steps[2], math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2)) and mixing.poisson_steps(0.0) == [1.0]


def test_pieces(docs, spark):
    out = pieces.encode(docs)
    rows = out.collect()
    texts = sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in rows) == texts and all(len(r.ids) == r.n_tokens for r in rows)
    back = pieces.decode(out.drop("decoded_sha256")).collect()
    assert sorted((str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in back) == texts
    assert pieces.encode(empty(docs)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    vectors = [*base.tolist(), *(base + rng.normal(size=base.shape) * 0.05).tolist(), *base[:5].tolist(), (base[0] * 7).tolist()]
    rows = [(k, [float(np.float32(x)) for x in v], "l") for k, v in enumerate(vectors)]
    rows += [(100, None, "l"), (101, [0.0] * 16, "l"), (102, [float("nan")] * 16, "l"), (103, [None] * 16, "l"), (104, [1.0], "l"), (105, [], "l"), (105, rows[0][1], "l"), (None, rows[1][1], "l")]
    rows += [(106, [1.0, 2.0], "l"), (107, [2.0, 4.0], "l"), (108, [2.0, -1.0], "l"), (None, [0.0, 0.0, 5.0], "l")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    found = neighbours.near_duplicates(frame, leaf=16).collect()
    good = [(k, np.array(v, float)) for k, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.9
    forest = c.Forest(len(good))
    for i, j in zip(*np.nonzero(near)):
        forest.union(int(i), int(j))
    least = {}
    for k, (i, _) in enumerate(good):
        least[forest.find(k)] = min(least.get(forest.find(k), 1 << 40), 1 << 40 if i is None else i)
    expected = [(i, int(near[k].sum()) - 1, least[forest.find(k)]) for k, (i, _) in enumerate(good) if i is not None]
    expected += [(k, 0, k) for k in (100, 101, 102, 103, 104, 105, 108)] + [(106, 1, 106), (107, 1, 106)]
    assert sorted((r.n_links, str(r.component_id), r.kept) for r in found if r.vec_id is None) == [(0, "None", True), (int(near[-1].sum()) - 1, "1", False)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found if r.vec_id is not None) == sorted(expected)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0


def test_pages(spark):
    boiler = "<div>Home news sport weather and all other links here</div>"
    rows = [(k, f"http://h.example/{k}", f"<body>{boiler}<p>own text {k} about thing {k * 7}</p></body>") for k in range(4)]
    rows += [(10, None, None), (11, "not a url", ""), (12, "http://x/1", "<article><p>a<p>b &amp; c</article>"), (12, "http://x/1", "<article><p>a<p>b &amp; c</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(frame).collect())
    assert found[:4] == [(k, f"own text {k} about thing {k * 7}", len(f"own text {k} about thing {k * 7}")) for k in range(4)]
    assert found[4:] == [(10, "", 0), (11, "", 0), (12, "a\nb & c", 7), (12, "a\nb & c", 7)]
    assert pages.extract(frame.limit(0)).count() == 0


def test_pages_of_large_hosts_are_decided_by_the_counts_of_the_host(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(30))
    menu, advert = "Home news sport weather and all other links here", "buy two of these fine garden chairs and get one free"
    notice, quote = "please sign up for our weekly letter to stay informed", "a passage that three of all the articles quote word for word"
    rows = [(k, f"http://h.example/{k}", f"<div>{menu}</div>" * (k % 2) + f"<p>{text()}</p>" + (f"<p>{advert}</p>" if k in (2, 31, 57) else "")) for k in range(60)]
    rows += [(100 + k, f"http://f.example/{k}", f"<article><p>{text()}</p><p>{notice}</p>" + f"<p>{quote}</p>" * (k < 3) + "</article>") for k in range(60)]
    rows += [(200 + k, "http://h.example/copy", f"<p>{menu} twice printed</p><p>{quote} on copies</p>") for k in range(40)]  # one page
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = sorted(map(tuple, pages.extract(frame).collect()))
    monkeypatch.setattr(pages, "SECTION", 6)
    assert sorted(map(tuple, pages.extract(frame).collect())) == whole
    texts = {r[0]: r[2] for r in whole}
    assert len(whole) == 160 and not any(menu in texts[k] or advert in texts[k] for k in range(60))
    assert not any(notice in texts[100 + k] for k in range(60)) and all(quote in texts[100 + k] for k in range(3))
    assert all(quote in texts[200 + k] for k in range(40))


def without_repeats(texts, size):
    """Brute force: texts without the words of every run of ``size`` words that is met more than once."""
    words = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    runs = [[tuple(m.group() for m in w[i : i + size]) for i in range(len(w) - size + 1)] for w in words]
    count = Counter(x for r in runs for x in r)
    out = []
    for text, w, r in zip(texts, words, runs):
        gone = np.zeros(len(w), bool)
        for i, x in enumerate(r):
            if count[x] > 1:
                gone[i : i + size] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        for a, b in reversed(list(zip(edges[::2], edges[1::2]))):
            text = text[: w[a].start()] + text[w[b - 1].end() :]
        out.append(text)
    return out


def repeating_texts(seed):
    """Rows with passages of 49 to 53 and 120 words, of one-letter and long words, and neighbouring ones too short to go."""
    rng = random.Random(seed)
    draw = lambda n, least, most: " ".join("".join(rng.choice("abcdefghiö") for _ in range(rng.randint(least, most))) for _ in range(n))
    passages = [draw(n, 1, top) for n in (49, 50, 51, 52, 53, 120) for top in (1, 9)]
    texts = [f"{draw(rng.randint(0, 30), 1, 8)} {rng.choice(passages)}{rng.choice([' ', chr(10)])}{rng.choice(passages)} {draw(5, 1, 8)}" for _ in range(40)]
    one, two = draw(26, 3, 9), draw(26, 3, 9)
    texts += [f"x {one} {two} y", f"left {one} z", f"w {two} right", passages[4], passages[4].replace(" ", " \t"), passages[5].upper()]
    texts += ["a " * 51, "a " * 50, "b " * 51 + "b", ("c" * 900 + " ") * 60, "lone " * 20]
    return [(1000 + k, t, "en", "a", 0) for k, t in enumerate(texts)]


def test_stages_against_brute_force(spark, docs, labels):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in table.collect()]
    kept = stages["n-gram Jaccard join"](spark, table, "").collect()
    groups = kept_first(rows, 5, 80)
    expected = []
    for g in groups:
        ids = [r[0] for r in g if r[0] is not None]
        expected += [r[0] for r in g] if not (g[0][1] or "").split() else [min(ids) if ids else None]
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(map(str, expected))
    made = [tuple(r) for r in table.collect()] + repeating_texts(7)
    cut = stages["suffix-array dedup"](spark, spark.createDataFrame(made, table.schema).repartition(5), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in cut) == sorted((str(r[0]), t) for r, t in zip(made, without_repeats([r[1] for r in made], 51)))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut)
    mixed = stages["mixing sources"](spark, table, "").collect()
    assert {r.doc_id for r in mixed} <= {r[0] for r in rows} and all(tuple(r) in rows for r in mixed)
    ids = stages["SentencePiece encoding"](spark, table, "")
    assert sorted(r.text for r in pieces.decode(ids).collect()) == sorted(r[1] or "" for r in rows)


def test_pipeline(spark, tmp_path, docs, labels):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, ran.collect())) == sorted(map(str, now.collect()))
