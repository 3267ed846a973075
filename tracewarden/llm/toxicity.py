"""Toxicity by a linear-chain conditional random field.

Labels stand on documents, the field needs them on tokens: in a bounded sample of labelled
documents, words and affixes that occur almost only in toxic ones mark the toxic tokens of
those. The field (two states: clean, toxic) learns emission weights of hashed word and affix
features and transitions. Over every whole text, forward-backward marginals of each sentence
are found; a logistic calibrator turns their maximum and their sum into a document's score, and
tokens with a marginal of a half or more are the offending spans.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, released, table, texts

#: Bound of the sample that the classifier is fitted on: rows of each class, and characters of a text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
BUCKETS = 1 << 18
#: Tokens of a long chain that are walked together with those of its other blocks.
BLOCK = 128
MOST_UNITS = 150_000
STRIP = ".,;:!?\"'()[]{}<>*#$%&|/\\~`^_-+=«»¿¡…"
END = (".", "!", "?", ".\"", "!\"", "?\"")


def features(unit: str) -> list[int]:
    """Hashed features of a lower-cased unit: the word without its punctuation, its prefixes and suffixes."""
    w = unit.strip(STRIP)
    names = [f"w{w}", *(f"p{w[:k]}" for k in (3, 4, 5, 6, 7) if len(w) > k), *(f"s{w[-k:]}" for k in (3, 4, 5) if len(w) > k)]
    names += [f"n{min(len(w), 12)}"] + ["digit"] * any(map(str.isdigit, w))
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


@dataclass
class Field:
    """A fitted model. Transitions are log odds against clean to clean; ``head`` weighs bias, maximum and sum."""

    theta: np.ndarray
    begin: float
    to_toxic: float
    to_clean: float
    stay: float
    head: np.ndarray


def chains(ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of each chain, a whole sentence. ``ends``: token ends a sentence; ``starts``: first tokens of documents."""
    n = len(ends)
    cut = np.zeros(n + 1, bool)
    cut[1:] = ends
    cut[starts] = True
    cut[n] = True
    first = np.flatnonzero(cut[:n])
    return first, np.diff(np.append(first, n))


def _step(a, e, stay: float, enter: float, leave: float):
    """Log odds of toxic after a token with emission ``e``, from log odds ``a`` before it."""
    return e + np.logaddexp(a + stay, enter) - np.logaddexp(a + leave, 0)


def _walk(e: np.ndarray, at: np.ndarray, size: np.ndarray, sign: int, a: np.ndarray, moves: tuple, out: np.ndarray) -> None:
    """Fill ``out`` along runs of ``size`` tokens from ``at`` on, all runs in step; ``a``: log odds of their first tokens."""
    order = np.argsort(-size, kind="stable")
    at, size, a = at[order], size[order], a[order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")  # runs longer than t
    out[at] = a
    for t in range(1, len(live)):
        here = at[: live[t]] + sign * t
        out[here] = a = _step(a[: live[t]], e[here], *moves)


def _transfer(e: np.ndarray, at: np.ndarray, sign: int, stay: float, enter: float, leave: float) -> tuple[np.ndarray, ...]:
    """What blocks of ``BLOCK`` tokens make of the state before them: log weights of clean and of toxic after it, from clean, then from toxic."""
    clean, toxic = np.stack([np.zeros(len(at)), np.full(len(at), -np.inf)]), np.stack([np.full(len(at), -np.inf), np.zeros(len(at))])
    for t in range(BLOCK):
        clean, toxic = np.logaddexp(clean, toxic + leave), e[at + sign * t] + np.logaddexp(clean + enter, toxic + stay)
    return clean[0], toxic[0], clean[1], toxic[1]


def swept(e: np.ndarray, first: np.ndarray, length: np.ndarray, sign: int, begin: float, stay: float, enter: float, leave: float) -> np.ndarray:
    """Log odds carried along whole chains of any length, from ``first`` on by ``sign``.

    A step is a fractional linear map, so that those of a block make one map. Long chains are cut into blocks whose maps
    are found together; what each block starts from is then carried over the blocks, and all blocks are walked together.
    """
    moves = stay, enter, leave
    parts = -(-length // BLOCK)
    begun = np.cumsum(parts) - parts
    chain = np.repeat(np.arange(len(first)), parts)
    k = np.arange(len(chain)) - begun[chain]
    at, size = first[chain] + sign * BLOCK * k, np.minimum(BLOCK, length[chain] - BLOCK * k)
    out = np.empty(len(e))
    head = k == 0
    _walk(e, at[head], size[head], sign, e[at[head]] + begin, moves, out)
    if not head.all():
        inner = np.flatnonzero((k > 0) & (k < parts[chain] - 1))
        place = np.zeros(len(k), np.int64)
        place[inner] = np.arange(len(inner))
        c0, x0, c1, x1 = _transfer(e, at[inner], sign, *moves)
        before = np.empty(len(k))
        long = np.flatnonzero(parts > 1)
        a = out[at[begun[long]] + sign * (BLOCK - 1)]
        for j in range(1, int(parts.max())):
            before[begun[long] + j] = a
            more = parts[long] > j + 1
            long, a = long[more], a[more]
            i = place[begun[long] + j]
            a = np.logaddexp(x0[i], a + x1[i]) - np.logaddexp(c0[i], a + c1[i])
        rest = ~head
        _walk(e, at[rest], size[rest], sign, _step(before[rest], e[at[rest]], *moves), moves, out)
    return out


def messages(e: np.ndarray, first: np.ndarray, length: np.ndarray, m: Field) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of toxic by forward and by backward messages, for each token.

    Backward is the same walk from the ends, with the transitions exchanged.
    """
    forward = swept(e, first, length, 1, m.begin, m.stay, m.to_toxic, m.to_clean)
    return forward, swept(e, first + length - 1, length, -1, 0.0, m.stay, m.to_clean, m.to_toxic) - e


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def document_signs(p_logit: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (1, largest log odds clipped to +-12 over 12, log of 1 + expected toxic tokens); no token: (1, -1, 0)."""
    out = np.tile([1.0, -1.0, 0.0], (len(sizes), 1))
    some = sizes > 0
    if some.any():
        at = starts[some]
        out[some, 1] = np.clip(np.maximum.reduceat(p_logit, at), -12, 12) / 12
        out[some, 2] = np.log1p(np.add.reduceat(sigmoid(p_logit), at))
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _laid(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents end to end: units, where each begins, and how long it is."""
    sizes = np.array([len(x) for x in ids], np.int64)
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum(sizes) - sizes, sizes


def fit(rows: list[tuple[str, int]], rate: float, rounds: int = 120) -> Field:
    """Fit on (text, label 0 or 1) pairs; ``rate`` is the share of label 1 among all labelled rows.

    Of the rows, two in three train the field and one in three the calibrator. Without rows of both
    classes nothing tells them apart: the score is ``rate`` everywhere, but under 0.5, so that no document is rejected.
    """
    prior = float(np.log(max(rate, 1e-4) / max(1 - rate, 1e-4)))
    m = Field(np.zeros(BUCKETS), -4.0, -4.0, 0.0, 1.0, np.array([prior, 0.0, 0.0]))
    rows = sorted(set(rows))
    if len({y for _, y in rows}) < 2:
        m.head[0] = min(prior, -0.1)
        return m
    labels = np.array([y for _, y in rows])
    fold = np.array([zlib.crc32(t.encode("utf-8", "replace")) % 3 for t, _ in rows])
    numbers: dict[str, int] = {}
    number = lambda u: numbers.setdefault(u, len(numbers))
    ids = [np.fromiter(map(number, t.lower().split()), np.int32) for t, _ in rows]
    del rows
    units = list(numbers)
    del numbers
    wide = 12
    table_ = np.full((len(units), wide), BUCKETS, np.int32)
    for i, u in enumerate(units):
        found = features(u)
        table_[i, : len(found)] = found
    ends = np.array([u.endswith(END) for u in units], bool)
    del units
    # Tokens of toxic documents are toxic if a feature of theirs is almost theirs alone.
    seen = np.zeros((2, BUCKETS + 1))
    trained = np.flatnonzero(fold != 0)
    for i in trained:
        if len(ids[i]):
            seen[labels[i], np.unique(table_[np.unique(ids[i])])] += 1
    n = np.array([max(1, (labels[trained] == y).sum()) for y in (0, 1)])
    share = seen / n[:, None]
    marked = (seen[1] >= max(4, 0.01 * n[1])) & (share[1] >= 19 * (share[0] + 0.2 / n[0]))
    marked[BUCKETS] = False
    toxic_unit = marked[table_].any(axis=1)
    # The field is trained on chains with toxic tokens and as many of clean documents.
    flat, starts, sizes = _laid([ids[i] for i in trained])
    if not len(flat) or not toxic_unit.any():
        return m
    owner = np.repeat(labels[trained], sizes)
    y = toxic_unit[flat] & (owner == 1)
    first, length = chains(ends[flat], starts[sizes > 0])
    hits = np.add.reduceat(y, first, dtype=np.int64) > 0
    other = np.flatnonzero(~hits & (owner[first] == 0))
    rng = np.random.default_rng(7)
    chosen = np.sort(np.concatenate([np.flatnonzero(hits), rng.permutation(other)[: 4 * max(500, int(hits.sum()))]]))
    pick = np.concatenate([np.arange(first[c], first[c] + length[c]) for c in chosen])
    length = length[chosen]
    first = np.cumsum(length) - length
    used, word = np.unique(flat[pick], return_inverse=True)
    rows_ = table_[used]
    y = y[pick].astype(float)
    last = np.zeros(len(y), bool)
    last[first + length - 1] = True
    a, b = np.flatnonzero(~last), np.flatnonzero(~last) + 1
    theta = np.zeros(BUCKETS + 1)
    moves = np.array([m.begin, m.to_toxic, m.to_clean, m.stay])
    g1, g2 = [np.zeros_like(theta), np.zeros(4)], [np.zeros_like(theta), np.zeros(4)]
    for step in range(1, rounds + 1):
        m.begin, m.to_toxic, m.to_clean, m.stay = map(float, moves)
        e = theta[rows_].sum(axis=1)[word]
        forward, backward = messages(e, first, length, m)
        p = sigmoid(forward + backward)
        x = np.bincount(word, p - y, len(used))
        grad = np.bincount(rows_.ravel(), np.repeat(x, wide), BUCKETS + 1) + 0.02 * theta
        grad[BUCKETS] = 0
        right = e[b] + backward[b]
        four = np.stack([np.zeros(len(a)), m.to_toxic + right, forward[a] + m.to_clean, forward[a] + m.stay + right])
        four = np.exp(four - four.max(axis=0))
        four /= four.sum(axis=0)
        ya, yb = y[a], y[b]
        moved = np.array([(p[first] - y[first]).sum(), (four[1] - (1 - ya) * yb).sum(), (four[2] - ya * (1 - yb)).sum(), (four[3] - ya * yb).sum()]) + 0.1 * moves
        for k, (g, value) in enumerate(((grad, theta), (moved, moves))):
            g1[k] = 0.9 * g1[k] + 0.1 * g
            g2[k] = 0.99 * g2[k] + 0.01 * g * g
            value -= 0.1 * (g1[k] / (1 - 0.9**step)) / (np.sqrt(g2[k] / (1 - 0.99**step)) + 1e-6)
    m.begin, m.to_toxic, m.to_clean, m.stay = map(float, moves)
    m.theta = theta[:BUCKETS]
    # The calibrator sees documents that the field did not.
    held = np.flatnonzero(fold == 0)
    if len(set(labels[held].tolist())) < 2:
        held = np.arange(len(ids))
    flat, starts, sizes = _laid([ids[i] for i in held])
    logit = _marginals(theta[table_].sum(axis=1)[flat], ends[flat], starts, sizes, m)
    y = labels[held]
    weight = np.where(y == 1, max(rate, 1e-4) / y.mean(), (1 - rate) / (1 - y.mean()))
    m.head = logistic(document_signs(logit, starts, sizes), y, weight)
    return m


def _marginals(e: np.ndarray, ends: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: Field) -> np.ndarray:
    first, length = chains(ends, starts[sizes > 0])
    forward, backward = messages(e, first, length, m)
    return forward + backward


class Scorer:
    """Scores texts; emissions of units are held up to a bound."""

    def __init__(self, m: Field) -> None:
        self.m, self.ids, self.emission, self.ends = m, {}, np.zeros(1024), np.zeros(1024, bool)

    def score(self, given: list[str], spans: bool) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and for each text the (start, end) in characters of its offending tokens if asked for."""
        tokens = [t.lower().split() for t in given]
        needed = set().union(*tokens)
        if len(self.ids) > MOST_UNITS:
            kept = [u for u in needed if u in self.ids]
            places = [self.ids[u] for u in kept]
            self.emission, self.ends = self.emission[places], self.ends[places]
            self.ids = {u: i for i, u in enumerate(kept)}
        new = [u for u in needed if u not in self.ids]
        begin = len(self.ids)
        if begin + len(new) > len(self.emission):
            size = begin + 2 * len(new)
            self.emission, self.ends = (np.concatenate([x[:begin], np.zeros(size - begin, x.dtype)]) for x in (self.emission, self.ends))
        if new:
            self.ids.update(zip(new, range(begin, begin + len(new)), strict=True))
            words: dict[str, int] = {}
            of = [words.setdefault(u.strip(STRIP), len(words)) for u in new]
            lists = [features(w) for w in words]
            at = np.cumsum([0, *map(len, lists)])[:-1]
            found = np.add.reduceat(self.m.theta[np.fromiter((i for x in lists for i in x), np.int64)], at)
            self.emission[begin : begin + len(new)] = found[of]
            self.ends[begin : begin + len(new)] = [u.endswith(END) for u in new]
        sizes = np.array([len(t) for t in tokens], np.int64)
        get = self.ids.__getitem__
        flat = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, t), np.int64, len(t)) for t in tokens)])
        starts = np.cumsum(sizes) - sizes
        logit = _marginals(self.emission[flat], self.ends[flat], starts, sizes, self.m)
        score = sigmoid(document_signs(logit, starts, sizes) @ self.m.head)
        found: list[list[tuple[int, int]]] = [[] for _ in given]  # by text
        if spans:
            toxic = logit >= 0
            for i in np.flatnonzero(np.add.reduceat(np.append(toxic, False), starts, dtype=np.int64) * (sizes > 0)):
                mine = toxic[starts[i] : starts[i] + sizes[i]]
                found[i] = [x.span() for k, x in enumerate(re.finditer(r"\S+", given[i])) if mine[k]]
        return score, found


def held_out(key: str = "doc_id"):
    """Column: crc32 of the id as text has no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_chars: int = SAMPLE_CHARS) -> Field:
    """Fit on at most ``rows`` documents of each class with at most ``most_chars`` characters, chosen by a hash.

    Rows held out, labels other than 0 and 1, and null ids are left aside; a document with both labels
    counts as toxic. Only the sample comes to the driver; the rate of label 1 is counted over all rows.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    short = documents.where(F.length("text") <= most_chars).select("doc_id").distinct()
    eligible = known.join(short, "doc_id", "left_semi")
    chosen = [eligible.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 x rows ids
    found = documents.select("doc_id", "text").where(F.length("text") <= most_chars).join(sample, "doc_id").select("text", "toxic").distinct().limit(4 * rows).collect()
    total = sum(counted.values())
    return fit([(r["text"], r["toxic"]) for r in found], counted.get(1, 0) / total if total else 0.0)


def score_toxicity(df: DataFrame, model: Field, text: str = "text", key: str = "doc_id", spans: bool = True) -> DataFrame:
    """``key``, score (0 to 1), predicted (1 from 0.5 on) and offending spans for each row of ``df``.

    Null and empty texts score as a text without a toxic word. Rows are kept one for one, so repeated
    rows repeat and null keys stay; other columns are left out. Spans are (start, end) in characters.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in chunks(batches, 1):
            score, found = scorer.score(texts(batch.column(1)), spans)
            columns = [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            pairs = pa.array([[{"start": a, "end": b} for a, b in x] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, pairs], [key, "score", "predicted", "spans"])
        del scorer
        released()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int, spans array<struct<start:int,end:int>>")


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a field fitted on labelled rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    out = score_toxicity(documents, model)
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), offsets.alias("spans"))


def keep_clean(df: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """Rows of ``df`` that score under 0.5, with all their columns; one pass without a join.

    A null text scores as the empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in chunks(batches, place):
            score, _ = scorer.score(texts(batch.column(place)), False)
            yield batch.filter(pa.array(score < 0.5))
        del scorer
        released()

    return df.mapInArrow(run, df.schema)
