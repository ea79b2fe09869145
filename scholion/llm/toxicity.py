"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals make document scores.

Fitting takes a bounded sample of labelled documents: in the order of a hash of their id, up to ``SAMPLE_TOXIC`` toxic and
``SAMPLE_CLEAN`` clean ones, each class within its budget of ``SAMPLE_BYTES``; a text that doesn't fit into what is left of
the budget leaves its place to the next. Texts are taken whole, long ones too. Labels mark documents, so token
labels come first: a token is toxic if its word or one of its prefixes occurs in toxic documents
significantly more often than in clean ones (log-likelihood ratio). The field is then trained on the labelled
tokens of whole sentences, and a logistic curve maps a document's marginals to its score.

Scoring is distributed and covers whole texts: tokens are runs of letters and digits, a sequence ends at
``. ! ?`` or a line end. Forward and backward passes run over all sequences of a chunk at once.

Defined results: a null or empty text (or one without tokens) has no span and the score of zero marginals; a
null id is kept; repeated rows are scored alike; other columns are ignored; without any toxic or any clean
label every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.llm import common as c

SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2200
SAMPLE_BYTES = {1: 3 << 20, 0: 5 << 20}
FIT_CHUNK = 1 << 19  # bytes tokenized at once in fitting: the driver holds tokens, not their hashes' steps
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7)
SCORE_LIMIT = 0.7
CHUNK = 2 << 20

_TOKEN = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TOKEN[_lo:_hi] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 13, 33, 46, 63]] = True


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # first token of every document, and their number
    seq: np.ndarray  # first token of every sequence, and their number
    keys: np.ndarray  # (features, tokens): hashed word and prefixes


def tokenize(raw: np.ndarray, offsets: np.ndarray) -> Tokens:
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, np.zeros(len(offsets), np.int64), np.zeros(1, np.int64), np.zeros((len(PREFIXES) + 1, 0), np.uint64))
    raw = c.fold(raw)
    solid = _TOKEN[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:-1]))
    end = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:])) + 1
    stops = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_BREAK[raw], out=stops[1:])
    stops[:-1] += np.cumsum(edge[:-1], dtype=np.int32)
    part = stops[start]
    seq = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(start)] if len(start) else np.zeros(1, np.int64)
    prefix = c.prefix_hash(raw)
    keys = np.empty((len(PREFIXES) + 1, len(start)), np.uint64)
    keys[0] = c.span_hash(prefix, start, end) ^ np.uint64(0x5851F42D4C957F2D)
    for k, n in enumerate(PREFIXES, 1):
        keys[k] = c.span_hash(prefix, start, np.minimum(start + n, end))
    return Tokens(start, end, np.searchsorted(start, offsets), seq, keys)


def tokenize_all(texts: list[str]) -> Tokens:
    """Tokens of all texts, tokenized in chunks; places in the text aren't kept."""
    parts, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= FIT_CHUNK):
            size += len(texts[to])
            to += 1
        parts.append(tokenize(*c.text_buffer(pa.array(texts[at:to], pa.large_string()))))
        at = to
    base = np.cumsum([0, *(p.keys.shape[1] for p in parts)])
    join = lambda name: np.concatenate([*(getattr(p, name)[:-1] + b for p, b in zip(parts, base)), base[-1:]])
    none = np.zeros(0, np.int64)
    return Tokens(none, none, join("doc"), join("seq"), np.concatenate([p.keys for p in parts], axis=1))


@dataclass
class Crf:
    """Two states, clean and toxic. weights: the toxic state's lead by feature; step[i, j]: score of j after i."""

    weights: np.ndarray
    bias: float
    step: np.ndarray
    curve: np.ndarray  # of the document score

    def lead(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape[1], self.bias)
        for row in keys:
            out += self.weights[(row % np.uint64(BUCKETS)).astype(np.int64)]
        return out


def marginals(lead: np.ndarray, seq: np.ndarray, step: np.ndarray, pairs: bool = False):
    """P(toxic) of every token by forward-backward; with ``pairs`` also the expected number of each transition.

    Messages are kept as log-odds of the toxic state, so nothing under- or overflows.
    """
    size = np.diff(seq)
    order = np.argsort(-size, kind="stable")
    first, size = seq[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    ahead, behind = np.zeros(len(lead)), np.zeros(len(lead))
    for t in range(longest):
        at = first[: active[t]] + t
        if t == 0:
            ahead[at] = lead[at]
        else:
            x = ahead[at - 1]
            ahead[at] = lead[at] + np.logaddexp(step[0, 1], x + step[1, 1]) - np.logaddexp(step[0, 0], x + step[1, 0])
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        x = lead[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(step[1, 0], x + step[1, 1]) - np.logaddexp(step[0, 0], x + step[0, 1])
    p = 1 / (1 + np.exp(-np.clip(ahead + behind, -500, 500)))
    if not pairs:
        return p
    inner = np.ones(len(lead), bool)
    inner[seq[1:][size >= 0] - 1] = False
    inner = np.flatnonzero(inner)
    x, y = ahead[inner], lead[inner + 1] + behind[inner + 1]
    cell = np.stack([np.full(len(inner), step[0, 0]), step[0, 1] + y, step[1, 0] + x, step[1, 1] + x + y])
    cell = np.exp(cell - cell.max(0))
    return p, (cell / cell.sum(0)).sum(1).reshape(2, 2)


def _copy_groups(tokens: Tokens, n: int, functions: int = 4) -> np.ndarray:
    """(functions, documents): min-hashes of the word pairs, equal for copies of a document."""
    word = tokens.keys[0]
    out = np.zeros((functions, n), np.int64)
    some = np.flatnonzero(np.diff(tokens.doc) > 0)
    if len(some):
        with np.errstate(over="ignore"):
            pair = word + np.r_[word[1:], word[:1]] * np.uint64(3)
        for j, salt in enumerate(c.stream(23, functions)):
            least = np.minimum.reduceat(c.mix(pair ^ salt), tokens.doc[:-1][some])
            out[j, some] = np.unique(least, return_inverse=True)[1]
    return out


def token_labels(tokens: Tokens, toxic: np.ndarray, least: float = 20.0, open_least: float = 15.0, purity: float = 0.98) -> np.ndarray:
    """Label of each token from the labels of the documents.

    A word, or prefix of at least four bytes, is toxic if the log-likelihood ratio of its occurrence in toxic
    and clean documents reaches ``least``; copies of one document count once (by the smallest count over four
    min-hashes), so what merely accompanies an insult isn't marked. Toxic documents without any such word are
    then covered greedily by the word or prefix that explains most of them.
    """
    n, rows = len(toxic), [0, *range(2, len(PREFIXES) + 1)]
    doc = np.repeat(np.arange(n), np.diff(tokens.doc))
    groups = _copy_groups(tokens, n)
    n1 = int(toxic.sum())
    n0 = n - n1
    share = n1 / n
    words, of, inverses, base = [], [], {}, 0
    for k in rows:
        keys, inverse = np.unique(tokens.keys[k], return_inverse=True)
        seen = np.unique(inverse.astype(np.int64) * n + doc)
        words.append((seen // n + base).astype(np.int32))
        of.append((seen % n).astype(np.int32))
        inverses[k] = (inverse + base).astype(np.int32)
        base += len(keys)
        del keys, inverse, seen
    words, of = np.concatenate(words), np.concatenate(of)
    clean = np.bincount(words[~toxic[of]], minlength=base)
    words, of = words[toxic[of]], of[toxic[of]]

    def ratio(words, of):
        a = np.min([np.bincount(np.unique(words.astype(np.int64) * n + g[of]) // n, minlength=base) for g in groups], axis=0).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 2 * (a * np.log(a / ((a + clean) * share)) + np.where(clean > 0, clean * np.log(clean / ((a + clean) * (1 - share))), 0))
            pure = (a / n1) / (a / n1 + clean / n0)
        return np.where((a > 0) & (pure >= purity), out, 0)

    chosen = np.zeros(base, bool)
    if len(words):
        chosen = ratio(words, of) >= least
        open_doc = np.ones(n, bool)
        open_doc[of[chosen[words]]] = False
        left = open_doc[of]
        words, of = words[left], of[left]
    while len(words):
        gain = ratio(words, of)
        best = int(np.argmax(gain))
        if gain[best] < open_least:
            break
        chosen[best] = True
        open_doc[of[words == best]] = False
        left = open_doc[of]
        words, of = words[left], of[left]
    out = np.zeros(len(doc), bool)
    for k in rows:
        out |= chosen[inverses[k]]
    return out & toxic[doc]


def train_field(tokens: Tokens, label: np.ndarray, epochs: int = 6, batch: int = 4000, rate: float = 0.3, decay: float = 1e-6) -> Crf:
    """Maximum likelihood by Adagrad over the sentences that hold a toxic token and as many clean ones times three."""
    size = np.diff(tokens.seq)
    which = np.repeat(np.arange(len(size)), size)
    hot = np.bincount(which[label], minlength=len(size)) > 0
    cold = np.flatnonzero(~hot & (size > 0))
    random = np.random.default_rng(7)
    cold = cold[random.permutation(len(cold))[: 3 * hot.sum() + 2000]]
    chosen = np.r_[np.flatnonzero(hot), cold]
    columns = (tokens.keys % np.uint64(BUCKETS)).astype(np.int32)
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    rest, rest_squares = np.array([-2.0, 0, 0, 0, 0]), np.full(5, 1e-2)  # bias, step
    for _ in range(epochs):
        for part in np.array_split(random.permutation(chosen), max(1, len(chosen) // batch)):
            n = size[part]
            seq = np.r_[0, np.cumsum(n)]
            at = np.repeat(tokens.seq[part] - seq[:-1], n) + np.arange(seq[-1])
            cols, y = columns[:, at], label[at].astype(float)
            p, expected = marginals(weights[cols].sum(0) + rest[0], seq, rest[1:].reshape(2, 2), pairs=True)
            inner = np.ones(len(at), bool)
            inner[seq[1:] - 1] = False
            inner = np.flatnonzero(inner)
            observed = np.bincount((2 * y[inner] + y[inner + 1]).astype(int), minlength=4)
            slope = np.zeros(BUCKETS)
            for row in cols:
                slope += np.bincount(row, y - p, BUCKETS)
            slope -= decay * len(at) * weights
            squares += slope**2
            weights += rate * slope / np.sqrt(squares)
            more = np.r_[(y - p).sum(), observed - expected.ravel()]
            rest_squares += more**2
            rest += rate * more / np.sqrt(rest_squares)
    return Crf(weights.astype(np.float32), float(rest[0]), rest[1:].reshape(2, 2), np.zeros(3))


def document_features(p: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per document: 1, the largest marginal, log of one plus the sum of the marginals that reach 0.3."""
    n = np.diff(doc)
    total = np.diff(np.r_[0.0, np.cumsum(np.where(p >= 0.3, p, 0))][doc])
    top = np.zeros(len(n))
    some = np.flatnonzero(n > 0)
    if len(some):
        top[some] = np.maximum.reduceat(p, doc[:-1][some])
    return np.stack([np.ones(len(n)), top, np.log1p(np.maximum(total, 0))], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return beta


def fit(texts: list[str], toxic: np.ndarray) -> Crf | None:
    """None without both classes. The score's curve is learned with the marginals of the same documents."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    tokens = tokenize_all(texts)
    model = train_field(tokens, token_labels(tokens, toxic))
    p = marginals(model.lead(tokens.keys), tokens.seq, model.step)
    model.curve = logistic(document_features(p, tokens.doc), toxic.astype(float))
    return model


def fit_sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str) -> Crf | None:
    rows = labelled_sample(docs, labels, id_column, text, label)
    model = fit(rows["text"].tolist(), rows["y"].to_numpy(int))
    del rows
    c.release()
    return model


def score_chunk(model: Crf | None, raw: np.ndarray, offsets: np.ndarray):
    """(score, spans) of each document; spans: lists of (start, end) in code points of tokens likelier toxic than not."""
    n = len(offsets) - 1
    if model is None:
        return np.zeros(n), pa.array([[]] * n, SPANS)
    tokens = tokenize(raw, offsets)
    p = marginals(model.lead(tokens.keys), tokens.seq, model.step)
    score = 1 / (1 + np.exp(-np.clip(document_features(p, tokens.doc) @ model.curve, -30, 30)))
    hit = p >= 0.5
    head = hit.copy()
    starts_seq = np.zeros(len(p), bool)
    starts_seq[tokens.seq[:-1]] = len(p) > 0
    if len(p):
        head[1:] &= ~hit[:-1] | starts_seq[1:]
        tail = hit.copy()
        tail[:-1] &= ~hit[1:] | starts_seq[1:]
        first, last = np.flatnonzero(head), np.flatnonzero(tail)
    else:
        first = last = np.zeros(0, np.int64)
    point = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=point[1:])
    begin = point[offsets[:-1]]
    at = np.searchsorted(tokens.doc, first, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((point[tokens.start[first]] - begin[at]).astype(np.int32)), pa.array((point[tokens.end[last]] - begin[at]).astype(np.int32))], ["start", "end"]
    )
    return score, pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32)), spans)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str) -> pd.DataFrame:
    """The bounded training sample: ids from the small label table first, then only those texts."""
    spark = docs.sparkSession
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~c.held_out(id_column))
        .groupBy(F.col(id_column).alias("sample_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .withColumn("order", F.xxhash64("sample_id", F.lit(11)))
    )
    ids = []
    for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        ids += known.where(F.col("y") == y).orderBy("order", "sample_id").limit(most).select("sample_id", "y").collect()
    if not ids:
        return pd.DataFrame({"text": [], "y": []})
    schema = known.select("sample_id", "y").schema
    body = docs.select(F.col(id_column).alias("sample_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    drawn = F.broadcast(spark.createDataFrame([(r.sample_id, r.y) for r in ids], schema))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    size = {r.sample_id: r.n for r in body.join(drawn, "sample_id").groupBy("sample_id").agg(F.max(F.octet_length("text")).alias("n")).collect()}
    left, fits = dict(SAMPLE_BYTES), []
    for r in ids:
        if r.sample_id in size and size[r.sample_id] <= left[r.y]:
            left[r.y] -= size[r.sample_id]
            fits.append((r.sample_id, r.y))
    if not fits:
        return pd.DataFrame({"text": [], "y": []})
    chosen = F.broadcast(spark.createDataFrame(fits, schema))
    return (
        body.join(chosen, "sample_id")
        .groupBy("sample_id")
        .agg(F.max_by("text", F.struct(F.octet_length("text"), "text")).alias("text"), F.max("y").alias("y"))
        .orderBy("sample_id")
        .select("text", "y")
        .toPandas()
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted, spans) for every row of ``docs``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_sample(docs, labels, id_column, text, label))

    def score(batches):
        for batch in batches:
            for part in c.chunks(batch, "text", CHUNK):
                value, spans = score_chunk(model.value, *c.text_buffer(c.column(part, "text")))
                yield pa.RecordBatch.from_arrays([c.column(part, "id"), c.column(part, "held_out"), pa.array(value), spans], ["id", "held_out", "score", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), c.held_out(id_column).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(score, f"id {kind}, held_out boolean, score double, spans array<struct<start:int,end:int>>")
    return out.select(
        F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= SCORE_LIMIT).cast("int").alias("predicted"), "spans"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays below the limit, all columns kept, without a join: text and
    decision travel together through the scorer."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_sample(docs, labels, id_column, text, "toxic"))
    names = docs.columns

    def keep(batches):
        for batch in batches:
            for part in c.chunks(batch, text, CHUNK):
                value, _ = score_chunk(model.value, *c.text_buffer(c.column(part, text)))
                part = part.filter(pa.array(value < SCORE_LIMIT))
                yield pa.RecordBatch.from_arrays(part.columns, names)
        c.release()

    return docs.mapInArrow(keep, docs.schema)
