"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are maximal runs of letters (ASCII, case folded, or non-ASCII bytes).  Each token is tagged O (other)
or T (toxic).  Its potential is the sum of feature weights: the token, its first four to six bytes, and the
tokens before and after; a 2x2 transition table links neighbours.  Features are kept by 64-bit hash, and only
for forms and leading bytes that marked tokens of the training sample have, so their number is bounded by it.

Training (driver, numpy) uses a bounded sample of labelled documents outside the held-out fold: at most
``max_toxic`` toxic and ``max_clean`` clean ones, those with the smallest id hashes.  Token labels come from
the document labels: a token of a toxic document is T when its form, or its leading bytes, are much more
frequent in toxic than in clean documents (log odds with a minimum count); every token of a clean document
is O.  The field is then fitted to these labelled tokens on segments of ``SEGMENT`` tokens by Adam: at most
``max_segments`` with a feature and as many without, drawn by lot from the sample's documents.  So a form that is as common in clean text ends up with no weight.

Scoring runs over all documents: exact forward-backward marginals per token.  Most tokens carry no feature
weight, so their chain step is one constant matrix, and a gap of such tokens is a power of it; only tokens
with weight (and their neighbours) are visited.  Documents of any length are scored whole in time linear in
their tokens.  The document score is a logistic function of the strongest marginals and of their sum, fitted on
the same training documents.

Defined cases: null, empty or letter-less texts score like a text without any toxic evidence; repeated rows
score alike; null ids are in the training fold's complement only by hash (crc32 of '').  Labels, language,
source and ids are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinops.llm import textops as T
from clinops.llm.common import prepare

FLAG_BITS = 20  # quick test before a feature is looked up
SEGMENT = 64
PREFIXES = (4, 5, 6)
LEAST_COUNT = 5  # toxic training documents that must hold a form
LEAST_ODDS = 3.0  # log odds of a form, toxic against clean documents
MOST_SEGMENTS = 2500  # training segments with, and without, any feature, unless train_on is told otherwise

_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out(id_col: str):
    """crc32 of the id as text modulo 5 is 0."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def tokens(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends, index of each row's first token, form hashes, prefix hashes [token, PREFIXES])."""
    low = _FOLD[buf]
    letter = low > 0
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(buf)]
    begin[cut] = letter[cut]
    last = letter.copy()
    last[:-1] = letter[:-1] & (begin[1:] | ~letter[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    prefix = T.prefix_hash(low)
    form = T.span_hash(prefix, starts, ends)
    heads = [T.mix(T.span_hash(prefix, starts, np.minimum(starts + k, ends)) + np.uint64(k)) for k in PREFIXES]
    return starts, ends, np.searchsorted(starts, offs), form, heads


def feature_key(form: np.ndarray, heads: list[np.ndarray], column: int) -> np.ndarray:
    """Hash of the form (column 0) or of one leading part of every token."""
    return T.mix(heads[column - 1] + np.uint64(13)) if column else T.mix(form + np.uint64(11))


def feature_flags(keys: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << FLAG_BITS, dtype=bool)
    flags[keys >> np.uint64(64 - FLAG_BITS)] = True
    return flags


def feature_ids(form: np.ndarray, heads: list[np.ndarray], first: np.ndarray, keys: np.ndarray, flags: np.ndarray):
    """(tokens that have any feature, [token, feature] ids).  Of K keys, ids 1..K are a token's own, K+1..2K its
    form as the token before, 2K+1..3K as the token after, 0 is none."""
    n, k = len(form), len(keys)
    own = []
    for column in range(len(heads) + 1):
        h = feature_key(form, heads, column)
        at = np.flatnonzero(flags[h >> np.uint64(64 - FLAG_BITS)])
        slot = np.minimum(np.searchsorted(keys, h[at]), max(k - 1, 0))
        ok = keys[slot] == h[at] if k else np.zeros(0, dtype=bool)
        own.append((at[ok], slot[ok] + 1))
    head = np.zeros(n + 1, dtype=bool)
    head[first[:-1]] = True
    mine, ids = own[0]
    after = mine + 1 < n
    after &= ~head[np.minimum(mine + 1, n)]
    before = (mine > 0) & ~head[mine]
    own += [(mine[after] + 1, ids[after] + k), (mine[before] - 1, ids[before] + 2 * k)]
    some = np.unique(np.concatenate([at for at, _ in own]))
    out = np.zeros((len(some), len(own)), dtype=np.int64)
    for c, (at, slot) in enumerate(own):
        out[np.searchsorted(some, at), c] = slot
    return some, out


@dataclass
class Field:
    keys: np.ndarray  # sorted hashes of the features
    weight: np.ndarray  # score of T minus O per feature id
    bias: float
    step: np.ndarray  # [from, to] transition scores, O = 0, T = 1
    first: float  # score of starting in T minus O
    blend: np.ndarray  # logistic weights of summary()

    def ready(self) -> Field:
        """Tables derived once per use: the quick test and the eigenvalues of the step over idle tokens."""
        self.flags = feature_flags(self.keys)
        self.moves = np.exp(self.step)
        idle = self.moves * np.array([1.0, np.exp(self.bias)])  # [from, to]
        values, self.vectors = np.linalg.eig(idle)
        self.values = values / np.abs(values).max()
        self.back = np.linalg.inv(self.vectors)
        return self

    def gap(self, g: int) -> np.ndarray:
        """The chain over g idle tokens."""
        return ((self.vectors * self.values**g) @ self.back).real


def segment_marginals(e: np.ndarray, length: np.ndarray, field: Field):
    """Forward-backward over padded segments ``e`` [segment, token]: T marginals, pair marginals, log partition."""
    n, width = e.shape
    step = np.exp(field.step)
    alpha, beta = np.zeros((n, width, 2)), np.ones((n, width, 2))
    scale = np.ones((n, width))
    on = np.arange(width) < length[:, None]
    ex = np.exp(np.clip(e, -30, 30))
    for t in range(width):
        a = np.stack((np.ones(n), np.full(n, np.exp(field.first))), 1) if t == 0 else alpha[:, t - 1] @ step
        a = a * np.stack((np.ones(n), ex[:, t]), 1)
        s = np.where(on[:, t], a.sum(1), 1.0)
        alpha[:, t] = np.where(on[:, t, None], a / s[:, None], alpha[:, t - 1] if t else a)
        scale[:, t] = s
    pair = np.zeros((2, 2))
    for t in range(width - 2, -1, -1):
        nxt = beta[:, t + 1] * np.stack((np.ones(n), ex[:, t + 1]), 1) / scale[:, t + 1, None]
        b = nxt @ step.T
        beta[:, t] = np.where(on[:, t + 1, None], b, 1.0)
        live = on[:, t + 1]
        pair += step * (alpha[live, t].T @ nxt[live])
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    return post[:, :, 1] * on, pair, np.log(scale).sum()


def fit_field(keys: np.ndarray, ids: np.ndarray, tag: np.ndarray, first: np.ndarray, rounds: int = 50, rate: float = 0.3,
              ridge: float = 1e-3, seed: int = 7, max_segments: int = MOST_SEGMENTS) -> Field:
    """Adam on the conditional likelihood of the tagged segments with a T or a feature, and others by lot."""
    seg = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first[:-1], first[1:])])
    stop = np.minimum(seg + SEGMENT, np.repeat(first[1:], -(-np.diff(first) // SEGMENT)))
    has = np.add.reduceat((ids > 0).any(1).astype(np.int64), seg) > 0
    rng = np.random.default_rng(seed)
    pick = np.concatenate((rng.permutation(np.flatnonzero(has))[:max_segments],
                           rng.permutation(np.flatnonzero(~has))[:max_segments]))
    pick.sort()
    seg, length = seg[pick], (stop - seg)[pick]
    place = seg[:, None] + np.arange(SEGMENT)
    on = np.arange(SEGMENT) < length[:, None]
    place = np.where(on, place, 0)
    x, y = ids[place], tag[place] * on
    weight = np.zeros(3 * len(keys) + 1)
    rest = np.zeros(6)  # bias, first, transitions
    truth_pair = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            truth_pair[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & on[:, 1:]).sum()
    flat = x[on]
    m = [np.zeros(len(weight)), np.zeros(6)]
    v = [np.zeros(len(weight)), np.zeros(6)]
    scale = 1.0 / max(1, len(seg))
    for k in range(1, rounds + 1):
        field = Field(keys, weight, rest[0], rest[2:].reshape(2, 2), rest[1], np.zeros(0))
        post, pair, _ = segment_marginals(weight[x].sum(2) + rest[0], length, field)
        miss = (y - post) * on
        g = np.zeros(len(weight))
        for c in range(flat.shape[1]):
            g += np.bincount(flat[:, c], weights=miss[on], minlength=len(weight))
        g = g * scale - ridge * weight
        g[0] = 0.0
        r = np.concatenate(([miss.sum(), (y[:, 0] - post[:, 0]).sum()], (truth_pair - pair).ravel())) * scale
        r -= ridge * rest
        for at, (p, d) in enumerate(((weight, g), (rest, r))):
            m[at] = 0.9 * m[at] + 0.1 * d
            v[at] = 0.999 * v[at] + 0.001 * d * d
            p += rate * (m[at] / (1 - 0.9**k)) / (np.sqrt(v[at] / (1 - 0.999**k)) + 1e-8)
    return Field(keys, weight, float(rest[0]), rest[2:].reshape(2, 2).copy(), float(rest[1]), np.zeros(0)).ready()


def marginals(e: np.ndarray, active: np.ndarray, field: Field, n: int) -> np.ndarray:
    """T marginals at the ``active`` tokens (ascending) of one document of ``n`` tokens.

    Tokens between them have the constant score ``field.bias``: a gap of g such tokens is the g-th power of
    one 2x2 matrix, taken by its eigenvalues (``Field.gap``)."""
    step, gap = field.moves, field.gap
    k = len(active)
    forward, backward = np.empty((k, 2)), np.empty((k, 2))
    state, at = np.array([1.0, np.exp(field.first)]), -1
    ex = np.exp(np.clip(e, -30, 30))
    for i in range(k):
        g = int(active[i]) - at - 1
        if at < 0:
            if g:  # the first token is idle
                state = state * np.array([1.0, np.exp(field.bias)])
                state = (state @ gap(g - 1)) @ step
        else:
            state = (state @ gap(g)) @ step
        state = state * np.array([1.0, ex[i]])
        state = state / state.sum()
        forward[i], at = state, int(active[i])
    state, at = np.ones(2), n
    for i in range(k - 1, -1, -1):
        if i == k - 1:
            state = gap(n - 1 - int(active[i])) @ np.ones(2)
        else:
            g = int(active[i + 1]) - int(active[i]) - 1
            state = gap(g) @ (step @ (np.array([1.0, ex[i + 1]]) * state))
        state = state / state.sum()
        backward[i] = state
    post = forward * backward
    return post[:, 1] / post.sum(1)


def tag_rows(buf: np.ndarray, offs: np.ndarray, field: Field):
    """For every row: (marginals of its visited tokens, their byte starts and ends in the row)."""
    starts, ends, first, form, heads = tokens(buf, offs)
    visited, ids = feature_ids(form, heads, first, field.keys, field.flags)
    score = field.weight[ids].sum(1) + field.bias
    bound = np.searchsorted(visited, first)
    for r in range(len(offs) - 1):
        lo, hi = bound[r], bound[r + 1]
        at = visited[lo:hi]
        p = marginals(score[lo:hi], at - first[r], field, int(first[r + 1] - first[r])) if hi > lo else np.zeros(0)
        yield p, starts[at] - offs[r], ends[at] - offs[r]


def summary(p: np.ndarray) -> list[float]:
    """What the document score sees of the marginals: nothing but their strength and number."""
    top = np.sort(p)[::-1][:3]
    top = np.concatenate((top, np.zeros(3 - len(top))))
    return [1.0, float(top[0]), float(top[1]), float(top[2]), float(np.log1p(p[p > 0.05].sum()))]


def fit_blend(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return w


def count_forms(hashes: np.ndarray, row: np.ndarray, toxic: np.ndarray):
    """(form, toxic rows with it, clean rows with it)."""
    order = np.lexsort((row, hashes))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    forms, at = np.unique(h, return_inverse=True)
    bad = np.bincount(at, weights=toxic[r], minlength=len(forms))
    return forms, bad, np.bincount(at, minlength=len(forms)) - bad


def train(texts: pa.Array, toxic: np.ndarray, max_segments: int = MOST_SEGMENTS) -> Field:
    """Field and score blend from whole labelled texts."""
    parts, rows = [], []
    for a, b, buf, offs in T.text_chunks(texts):
        _, _, first, form, heads = tokens(buf, offs)
        parts.append((form, heads, first))
        rows.append(np.repeat(np.arange(a, b), np.diff(first)))
    row = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    if not len(row) or toxic.min() == toxic.max():  # nothing to learn: one constant score
        rate = (toxic.sum() + 1) / (len(toxic) + 2)
        blend = np.array([np.log(rate / (1 - rate)), 0, 0, 0, 0])
        return Field(np.zeros(0, dtype=np.uint64), np.zeros(1), -4.0, np.eye(2), 0.0, blend).ready()
    size = np.array([toxic.sum(), (1 - toxic).sum()])
    tag, keys = np.zeros(len(row), dtype=bool), []
    for column in range(len(PREFIXES) + 1):
        h = np.concatenate([feature_key(form, heads, column) for form, heads, _ in parts])
        forms, bad, good = count_forms(h, row, toxic)
        odds = np.log((bad + 0.5) / (size[0] - bad + 0.5)) - np.log((good + 0.5) / (size[1] - good + 0.5))
        strong = forms[(bad >= LEAST_COUNT) & (odds >= LEAST_ODDS)]
        tag |= np.isin(h, strong)
        keys.append(strong)
    tag = (tag & (toxic[row] == 1)).astype(np.int64)
    keys = np.unique(np.concatenate(keys))
    flags = feature_flags(keys)
    ids, done = np.zeros((len(row), len(PREFIXES) + 3), dtype=np.int32), 0
    for form, heads, at in parts:
        some, found = feature_ids(form, heads, at, keys, flags)
        ids[done + some] = found
        done += len(form)
    first = np.unique(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(toxic))))))
    field = fit_field(keys, ids, tag, first, max_segments=max_segments)
    x = np.array([summary(p) for _, _, buf, offs in T.text_chunks(texts) for p, _, _ in tag_rows(buf, offs, field)])
    field.blend = fit_blend(x, toxic.astype(np.float64))
    return field


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 1000,
             max_clean: int = 2000, max_segments: int = MOST_SEGMENTS) -> Field:
    """Fit on a bounded sample of labelled rows outside the held-out fold; of rows with one id the smallest text."""
    marked = labels.where("toxic is not null").select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("id").isNotNull() & ~held_out("id"))
    order = [F.xxhash64("id"), "id"]
    chosen = marked.where("toxic = 1").dropDuplicates(["id"]).orderBy(*order).limit(max_toxic).unionByName(
        marked.where("toxic = 0").dropDuplicates(["id"]).orderBy(*order).limit(max_clean))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")])  # at most max_toxic + max_clean texts
    return train(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy().astype(np.int64),
                 max_segments)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: its ``id``, score, predicted and ``spans`` (byte start, byte end, marginal) of toxic tokens."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the training sample
    keep = [c for c in ("__row",) if c in docs.columns]
    rows = docs.select(*keep, F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b, buf, offs in T.text_chunks(batch.column("text")):
                x, spans = [], []
                for p, lo, hi in tag_rows(buf, offs, model):
                    x.append(summary(p))
                    hit = np.flatnonzero(p >= least)
                    spans.append([{"start": int(lo[k]), "end": int(hi[k]), "p": float(p[k])} for k in hit])
                s = 1 / (1 + np.exp(-np.clip(np.array(x) @ model.blend, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in [*keep, "id"]), pa.array(s),
                     pa.array((np.array(x) @ model.blend >= 0).astype(np.int32)), pa.array(spans, pa.list_(pa.struct(
                         [("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))],
                    [*keep, "id", "score", "predicted", "spans"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, ("__row long, " if keep else "") + f"id {kind}, score double, predicted int, "
                           "spans array<struct<start: int, end: int, p: double>>")


def clean_rows(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns and without a shuffle."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b, buf, offs in T.text_chunks(batch.column(text_col)):
                x = np.array([summary(p) for p, _, _ in tag_rows(buf, offs, model)])
                yield batch.slice(a, b - a).filter(pa.array(x @ model.blend < 0))

    return docs.mapInArrow(run, docs.schema)
