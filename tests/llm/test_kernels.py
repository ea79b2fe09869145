"""Kernels against brute force, without Spark."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scholion.llm import common as c
from scholion.llm import fingerprint, jaccard, language, neighbours, pages, pieces, suffix, toxicity

TEXTS = ["", "One two  three", "a b c d\ta b c d", "ÉCOLE école\nx", "   ", "w " * 300, "long" * 500, "One two  three"]


def naive_words(text):
    return [w for w in "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text).replace("\t", " ").replace("\n", " ").split(" ") if w]


def test_shingle_sets_count_distinct_word_sequences():
    sets = c.shingle_sets(*c.text_buffer(pa.array([*TEXTS, None])), 4)
    for text, found in zip([*TEXTS, ""], sets):
        words = naive_words(text)
        expected = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())
        assert len(found) == len(expected)
    assert (sets[1] == sets[7]).all()


def test_pack_keeps_all_bits():
    x = c.stream(3, 100)
    assert (jaccard.unpack(jaccard.pack(x)) == x).all()


@pytest.mark.parametrize("share", [80, 85, 100])
def test_size_classes_of_linked_sets_differ_by_one_at_most(share):
    for n in range(1, 3000):
        assert jaccard.size_class(n * 100 // share, share) - jaccard.size_class(n, share) in (0, 1)


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_connect_what_brute_force_connects(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(60):
        if sets and rng.random() < 0.7:
            new = set(rng.choice(sets))
            for _ in range(rng.randint(0, 6)):
                new.discard(rng.choice(sorted(new)))
                new.add(rng.randrange(10_000))
        else:
            new = {rng.randrange(400) for _ in range(rng.randint(1, 40))}
        sets.append(new)
    forest = c.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                forest.union(i, j)
    links = jaccard.trie_links([np.array(sorted(s), np.uint64) for s in sets], [len(s) for s in sets])
    ours = c.Forest(len(sets))
    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
        ours.union(a, b)
    assert [ours.find(k) for k in range(len(sets))] == [forest.find(k) for k in range(len(sets))]


@pytest.mark.parametrize("seed", range(40))
def test_repeated_windows(seed):
    rng = random.Random(seed)
    least, alphabet, made = rng.choice([1, 2, 5, 8, 9, 17]), rng.choice([1, 2, 256]), []
    for _ in range(rng.randint(1, 8)):
        new = [rng.randrange(alphabet) for _ in range(rng.randint(0, 40))]
        if made and rng.random() < 0.6:
            new += rng.choice(made).tolist()[rng.randint(0, 20) :]
        made.append(np.array(new, np.uint8))
    count = Counter(p[i : i + least].tobytes() for p in made for i in range(len(p) - least + 1))
    expected = [[i for i in range(len(p) - least + 1) if count[p[i : i + least].tobytes()] > 1] for p in made]
    assert [x.tolist() for x in suffix.repeated_windows(made, least)] == expected


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows_of_words(seed):
    """The same search where a symbol is a word's 64-bit hash."""
    rng = random.Random(seed)
    names = c.stream(seed, 3 + seed)
    made = [names[[rng.randrange(len(names)) for _ in range(rng.randint(0, 120))]] for _ in range(12)] + [names[np.zeros(40, int)]] * 2
    windows = [[tuple(p[i : i + 5].tolist()) for i in range(len(p) - 4)] for p in made]
    count = Counter(w for p in windows for w in p)
    assert [x.tolist() for x in suffix.repeated_windows(made, 5)] == [[i for i, w in enumerate(p) if count[w] > 1] for p in windows]


def test_halves_hold_every_window_once_and_equal_windows_share_their_key():
    rng = random.Random(2)
    core = bytes(rng.randrange(256) for _ in range(600))
    raws = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))) + core + bytes(rng.randrange(256) for _ in range(200)) for _ in range(4)]
    for level in range(1, 8):
        keys = {}
        for doc, raw in enumerate(raws):
            buffer = np.frombuffer(raw, np.uint8)
            held = []
            for x in suffix.segments(buffer, np.array([0, len(raw)]), np.array([doc]), 400):
                start, n = int(x["start"]), int(x["windows"])
                for key, _, at, windows in suffix.halved(buffer, start, start + n - 1 + 400, level, 400):
                    held += range(at, at + windows)
                    for k in range(at, at + windows):
                        keys.setdefault(raw[k : k + 400], set()).add(key)
            assert held == list(range(len(raw) - 399))
        assert all(len(x) == 1 for x in keys.values())


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (0, 399, 400, 401, 3000)] + ["ab" * 700]
    rows = suffix.segments(*c.text_buffer(pa.array(texts)), np.arange(len(texts)))
    for k, text in enumerate(texts):
        starts = [s + i for s, n in zip(rows["start"][rows["doc"] == k].tolist(), rows["windows"][rows["doc"] == k].tolist()) for i in range(n)]
        assert sorted(starts) == list(range(max(len(text) - 399, 0)))


def brute_marginals(lead, step):
    n = len(lead)
    weight = {}
    for code in range(1 << n):
        y = [(code >> k) & 1 for k in range(n)]
        weight[code] = np.exp(sum(lead[k] * y[k] for k in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])))
    total = sum(weight.values())
    return [sum(w for code, w in weight.items() if code >> k & 1) / total for k in range(n)]


def test_forward_backward():
    rng = np.random.default_rng(2)
    step, seq = rng.normal(size=(2, 2)), np.array([0, 5, 6, 6, 13])
    lead = rng.normal(size=13) * 2
    p, pairs = toxicity.marginals(lead, seq, step, pairs=True)
    expected = np.concatenate([brute_marginals(lead[a:b], step) for a, b in zip(seq, seq[1:]) if b > a])
    assert np.allclose(p, expected) and np.isclose(pairs.sum(), 4 + 6)


def test_toxic_stems_are_learned_from_document_labels():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts, toxic = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(40)]
        if k % 3 == 0:
            text[rng.randrange(40)] = "zork" + rng.choice(["", "en", "ung", "s"])
        texts.append(" ".join(text) + ".")
        toxic.append(k % 3 == 0)
    model = toxicity.fit(texts, np.array(toxic))
    score, spans = toxicity.score_chunk(model, *c.text_buffer(pa.array(["abcde zorkung xx", "abcde xx", "", "é zork"])))
    assert score[0] >= 0.7 > max(score[1], score[2]) and score[3] >= 0.7
    assert spans.to_pylist()[0] == [{"start": 6, "end": 13}] and spans.to_pylist()[3] == [{"start": 2, "end": 6}]


def slow_bits(train: dict, text: str, name: str) -> float:
    """Prediction by partial matching, written out for one text; all bytes are symbols of their own here."""
    tables = {k: Counter() for k in range(4)}
    for t in train[name]:
        raw = b"\n\n\n" + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                tables[k][raw[i - k : i + 1]] += 1
    total, raw = 0.0, b"\n\n\n" + text.encode()
    for i in range(3, len(raw)):
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                total += 8
                break
            seen = {g: n for g, n in tables[k].items() if g[:-1] == raw[i - k : i]}
            if not seen:
                continue
            n, t = sum(seen.values()), len(seen)
            hit = seen.get(raw[i - k : i + 1])
            if hit:
                total -= np.log2(hit / (n + t))
                break
            total -= np.log2(t / (n + t))
    return total


def test_code_lengths_are_exact():
    train = {"x": ["abab abba abc\n", "caab"], "y": ["zyzzy zyx xyz"]}
    names, parts = sorted(train), []
    for k, name in enumerate(names):
        gram, n = np.unique(language.gram_codes(*c.text_buffer(pa.array(train[name]))), return_counts=True)
        parts.append((np.full(len(gram), k), gram, n))
    trees = language.bake(names, *[np.concatenate(p) for p in zip(*parts)])
    texts = ["abab", "zyz ab", "", "abcabc\nzz", "caab abba", "abéß漢 zy"]
    bits = trees.bits(*c.text_buffer(pa.array(texts)))
    for row, text in zip(bits, texts):
        assert np.allclose(row, [slow_bits(train, text, name) for name in names], atol=1e-3)
    names_found, score = language.predict_chunk(trees, pa.array(["abab", "123", None, "zyzzy", "½ ² 12", "Ⅷ ①", "漢", "ª"]))
    assert names_found[:6] == ["x", "und", "und", "y", "und", "und"] and score[1] == 0 and "und" not in names_found[6:]
    assert 0.5 < score[0] <= 1 and abs(language.predict_chunk(trees, pa.array(["abab " * 50]))[1][0] - language.predict_chunk(trees, pa.array(["abab " * 500]))[1][0]) < 0.01


def test_fingerprints():
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 123, 3000)))
    texts = [text, text[:1500] + text[::-1][:1500], text[::-1], "", "ab", text]
    found = fingerprint.prints(*c.text_buffer(pa.array(texts)))
    strings = found.strings()
    assert strings[0] == strings[5]
    near = fingerprint.likeness(found[np.zeros(6, int)], found)
    assert near[0] == near[5] == 1 and 0.3 < near[1] < 0.9 and near[2] < 0.2 and near[3] == 0
    assert fingerprint.likeness(found[np.array([3])], found[np.array([3])])[0] == 1


def slow_print(text: str) -> str:
    """The fingerprint of one text, chunk by chunk."""
    raw = text.encode()
    hashed = lambda part: int(c.span_hash(c.prefix_hash(np.frombuffer(part, np.uint8)), np.array([0]), np.array([len(part)]))[0])
    depth = []  # zero bits at the end of the rolling hash behind every byte but the last
    for at in range(1, len(raw)):
        value, zeros = hashed(raw[max(0, at - 7) : at]), 0
        while value and not value & 1 and zeros < 47:
            value, zeros = value >> 1, zeros + 1
        depth.append(zeros)
    level = 1
    while len(raw) > 40 << level:
        level += 1
    while level > 1 and 1 + sum(d >= level for d in depth) < 16:
        level -= 1
    parts = []
    for size in (level, level + 1):
        stops = [at for at, d in enumerate(depth, 1) if d >= size] + ([len(raw)] if raw else [])
        stops = stops[:63] + stops[-1:] if len(stops) > 64 else stops
        parts.append("".join(chr(fingerprint.ALPHABET[hashed(raw[a:b]) >> 32 & 63]) for a, b in zip([0, *stops], stops)))
    return f"{1 << level}:{parts[0]}:{parts[1]}"


def test_boundaries_and_letters_equal_brute_force():
    rng = random.Random(9)
    texts = ["", "a", "é", "ab" * 5, "x" * 700, *("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (10, 81, 200, 640, 641, 3000, 9000)), "abcabc " * 900]
    assert fingerprint.prints(*c.text_buffer(pa.array(texts))).strings() == [slow_print(t) for t in texts]


def test_common_subsequence_is_exact():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, (40, 64)).astype(np.uint8), rng.integers(0, 4, (40, 64)).astype(np.uint8)
    la, lb = rng.integers(3, 65, 40), rng.integers(3, 65, 40)
    got = fingerprint._common(a, la, b, lb)
    for k in range(40):
        x, y = a[k, : la[k]].tolist(), b[k, : lb[k]].tolist()
        row = [0] * (len(y) + 1)
        for u in x:
            new = [0]
            for j, v in enumerate(y):
                new.append(max(row[j] + 1 if u == v else 0, row[j + 1], new[-1]))
            row = new
        runs = {tuple(x[i : i + 3]) for i in range(len(x) - 2)} & {tuple(y[i : i + 3]) for i in range(len(y) - 2)}
        assert np.isclose(got[k], 2 * row[-1] / (len(x) + len(y)) if runs else 0)


def brute_segmentation(codec, unit):
    by_text = {text: score for text, score in codec.vocabulary.pieces.values()}
    best = [0.0] + [-np.inf] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(end):
            if unit[start:end] in by_text:
                best[end] = max(best[end], best[start] + by_text[unit[start:end]])
        if unit[end - 1] not in by_text:
            best[end] = max(best[end], best[end - 1] + codec.unknown)
    return best[-1]


def test_pieces_best_score_and_round_trip():
    letters = ["a", "b", "c", " ", "ab", "abc", " ab", "bca", "cab", " a", "  "]
    listed = {300 + k: (t, -float(k * 3 % 7) - len(t) / 10) for k, t in enumerate(letters)}
    codec = pieces.Codec(pieces.Vocabulary(listed, list(range(256)), 400))
    score_of = {i: s for i, (_, s) in listed.items()}
    rng = random.Random(3)
    for _ in range(200):
        unit = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        assert np.isclose(sum(score_of[i] for i in codec.search(unit)), brute_segmentation(codec, unit))
    for text in ["", " ", "a", "abc  cab\n\tx", "é▁ 🙂 abc", " lead", "\n", "x" * 5000]:
        assert codec.decode(codec.encode(text).tolist()) == text
    assert codec.decode([-1, 9999]) == ""


def test_forest_finds_near_vectors_once():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 64))
    v = neighbours._unit(np.concatenate([base + rng.normal(size=base.shape) * 0.2 for _ in range(20)] + [rng.normal(size=(1200, 64))]))
    forest = neighbours.fit(v, len(v), leaf=64)
    lists = neighbours.leaves(forest, v)
    counts = np.zeros(len(v), int)
    for leaf in range(max(x.max() for x in lists) + 1):
        rows = np.flatnonzero([leaf in x for x in lists])
        if len(rows) > 1:
            unit = {"vector": v[rows], "weight": np.ones(len(rows), int), "leaves": [lists[r] for r in rows], "part": np.zeros(len(rows), int)}
            counts[rows] += neighbours.unit_links(leaf, unit, 0.9)[0]
    truth = (v @ v.T >= 0.9).sum(1) - 1
    coarse = neighbours.fit(v[:200], 100_000, leaf=64)  # a table of which only few vectors are in the sample
    assert any(t.finer for t in coarse) and max(np.bincount(np.concatenate(neighbours.leaves(coarse, v)))) < 200
    assert all(len(set(x.tolist())) == len(x) and x.max() < sum(t.numbers for t in coarse) for x in neighbours.leaves(coarse, v))
    assert (counts <= truth).all() and counts.sum() >= 0.9 * truth.sum() > 0


PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-banner">We use cookies</div><nav>menu</nav>
<div class="content with-sidebar"><article class="post"><header><h1>Title &amp; more</h1><span>by me</span></header><p class=ad>Buy<p>Para <b>one</b>&nbsp;x<br>y</p>
<aside>side</aside><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><div class="comments"><p>Nice!</p></div><footer>foot</footer></article></div>
<section class="comment-list">c</section><form>f</form><script>var a="<p>no</p>"</script><footer>bye</footer>"""


def test_main_blocks():
    assert pages.main_blocks(PAGE) == (["Title & more", "Para one x y", "a", "b", "1 2"], True)
    assert pages.main_blocks(None) == ([], False)
    assert pages.main_blocks("<p>only &lt;text&gt;</p>")[0] == ["only <text>"]


def test_repeated_blocks_need_distinct_pages():
    menu, foot = "Home news sport weather and all other links here", "copyright notice all rights are reserved by us here now"
    made = [[menu, f"own text {k} {k * 7} {k * 13} about something of page {k}", foot] for k in range(4)]
    assert pages.without_repeats(made, [False] * 4) == [[m[1]] for m in made]
    assert pages.without_repeats([made[0]] * 5, [False] * 5) == [made[0]] * 5
    assert pages.without_repeats([], []) == []


def test_framed_pages_lose_what_the_host_prints_only():
    rng = random.Random(1)
    text = lambda n=40: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    notice, quote = "please sign up for our weekly letter to stay informed", "a passage that two or three articles quote word for word here"
    made = [[text(), notice, text()] + ([quote] if k < 3 else []) for k in range(10)]
    assert pages.without_repeats(made, [True] * 10) == [[x for x in m if x != notice] for m in made]
    same = text()  # near copies of one article
    copies = [[same, same + f" end {k}"] for k in range(9)]
    assert pages.without_repeats(copies, [True] * 9) == copies
    long = text(60)  # longer than what stands beside it, and in the middle of a block
    beside = [(text(20), text(25)) for _ in range(8)]
    assert pages.without_repeats([[f"{a} {long} {b}"] for a, b in beside], [True] * 8) == [[f"{a} {b}"] for a, b in beside]


@pytest.mark.parametrize("seed", range(5))
def test_printed_runs_equal_brute_force(seed):
    """Every token in a substring of eight that most witnesses hold, found by comparing all substrings."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(rng.randint(16, 40)) for _ in range(3)]
    made = []
    for _ in range(12):
        page = [text(rng.randint(1, 30)) for _ in range(3)]
        for run, often in zip(shared, (0.9, 0.7, 0.3)):
            if rng.random() < often:
                page.insert(rng.randrange(len(page) + 1), [*text(rng.randint(0, 3)), *run, *text(rng.randint(0, 3))])
        made.append([" ".join(b) for b in page])
    grams = []
    for page in made:
        flat = " ".join(page).split(" ")
        grams.append([tuple(flat[i : i + 8]) for i in range(len(flat) - 7)])
    count = Counter(g for page in grams for g in set(page))
    covers = lambda page, least: {i + k for i, g in enumerate(page) if count[g] >= least for k in range(8)}
    sizes = [len(" ".join(page).split(" ")) for page in made]
    witness = [n - len(covers(g, 3)) >= pages.OWN for n, g in zip(sizes, grams)]
    votes = Counter(g for page, ok in zip(grams, witness) for g in set(page) if ok)
    needed = pages._needed(sum(witness))
    expected = []
    for page, gram, ok in zip(made, grams, witness):
        gone, at, kept = {i + k for i, g in enumerate(gram) if ok and count[g] >= 3 and votes[g] >= needed for k in range(8)}, 0, []
        for block in page:
            left = [w for k, w in enumerate(block.split(" "), at) if k not in gone]
            at += len(block.split(" "))
            kept += [" ".join(left)] if left else []
        expected.append(kept)
    assert any(expected[k] != made[k] for k in range(12)) and pages.without_repeats(made, [True] * 12) == expected
