"""Toxic spans by a linear-chain conditional random field.

Only documents are labelled. Tokens are labelled from them: a token of a toxic
training document is toxic if its word, or a beginning of it, is far more
frequent among toxic training documents than among others; every other token is
not. On these tokens a two-state chain is trained by maximum likelihood with
features of the word, its beginnings and both neighbours. Forward-backward
marginals then give each token its probability, a run of probable tokens is a
span, and a logistic regression over the document's marginals, fitted on
training documents that the chain has not seen, gives the document's score.

A chain is a whole document, whatever its length. To run a batch's chains in
step as arrays, they are laid out in stretches of ``STRETCH`` tokens: the product
of a stretch's transitions carries the state across it, so that the marginals
are those of the whole chain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import crc32_mod, map_rows, share, slices
from quarryline.llm.sampling import bounded_sample, collected
from quarryline.llm.winnow import words_of

STRETCH = 64
REJECT = 0.7
_TOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
PREFIXES = range(4, 10)
CACHE_WORDS = 150_000


def tokens_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, in lower case; as many as ``_TOKEN`` finds in the text."""
    return words_of((text or "").lower())


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings of 4 to 9 characters."""
    text = word.decode("utf-8", "surrogatepass")
    return [b"=" + word] + [b"^" + text[:n].encode("utf-8", "surrogatepass") for n in PREFIXES if len(text) >= n]


def _carried(table: np.ndarray, live: np.ndarray, head: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Product of each stretch's transitions, up to a factor: rows of ``p00, p01, p10, p11``."""
    n = table.shape[1]
    out = np.array([np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)])
    for t, m in enumerate(live):
        if not m:
            break
        e, v = table[t, :m], out[:, :m]
        step = np.array([v[0] * a[0, 0] + v[1] * a[1, 0], (v[0] * a[0, 1] + v[1] * a[1, 1]) * e, v[2] * a[0, 0] + v[3] * a[1, 0], (v[2] * a[0, 1] + v[3] * a[1, 1]) * e])
        if t == 0:  # nothing comes before a chain's first token
            step = np.where(head[:m], np.array([v[0], v[1] * e, v[2], v[3] * e]), step)
        out[:, :m] = step / step.max(axis=0)
    return out


def _entering(product: np.ndarray, first: np.ndarray, rows_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the forward state before each stretch, and of the backward state at its last token."""
    enter, leave = np.ones(width), np.ones(width)
    order = np.argsort(-rows_of, kind="stable")
    first, rows_of = first[order], rows_of[order]
    f, b = np.ones((2, len(first))), np.ones((2, len(first)))
    for k in range(1, int(rows_of[0])):
        m = int(np.searchsorted(-rows_of, -k, "left"))  # chains of more than k stretches come first
        p = product[:, first[:m] + k - 1]
        f = np.array([f[0, :m] * p[0] + f[1, :m] * p[2], f[0, :m] * p[1] + f[1, :m] * p[3]])
        f /= f.max(axis=0)
        enter[first[:m] + k] = f[1] / np.maximum(f[0], 1e-300)
        last = first[:m] + rows_of[:m] - k
        p = product[:, last]
        b = np.array([p[0] * b[0, :m] + p[1] * b[1, :m], p[2] * b[0, :m] + p[3] * b[1, :m]])
        b /= b.max(axis=0)
        leave[last - 1] = b[1] / np.maximum(b[0], 1e-300)
    return enter, leave


def forward_backward(odds: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains laid end to end, of ``sizes`` tokens: odds of state 1 of the forward and of the backward state at each token.

    ``odds`` are exponentiated emissions, ``a[i, j]`` the exponentiated weight of
    going from state i to j. A chain starts in either state alike.
    """
    sizes = sizes[sizes > 0]
    rows_of = -(-sizes // STRETCH)
    first = np.cumsum(rows_of) - rows_of
    within = np.arange(len(odds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, column = np.repeat(first, sizes) + within // STRETCH, within % STRETCH
    length = np.bincount(row)
    # stretches in order of length, so that those that still run at a step come first
    order = np.argsort(-length, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    live = np.searchsorted(-length[order], -np.arange(STRETCH), "left")  # stretches of more than t tokens
    table = np.ones((STRETCH, len(length)))
    table[column, place[row]] = odds
    head = np.zeros(len(length), bool)
    head[place[first]] = True
    enter = leave = np.ones(len(length))
    if rows_of.max() > 1:
        enter, leave = (x[order] for x in _entering(_carried(table, live, head, a)[:, place], first, rows_of, len(length)))
    ahead, back = np.ones_like(table), np.ones_like(table)
    ahead[0] = table[0] * np.where(head, 1.0, (a[0, 1] + enter * a[1, 1]) / (a[0, 0] + enter * a[1, 0]))
    for t in range(1, STRETCH):
        m = live[t]
        before = ahead[t - 1, :m]
        ahead[t, :m] = table[t, :m] * (a[0, 1] + before * a[1, 1]) / (a[0, 0] + before * a[1, 0])
    back[length[order] - 1, np.arange(len(length))] = leave
    for t in range(STRETCH - 2, -1, -1):
        m = live[t + 1]
        later = table[t + 1, :m] * back[t + 1, :m]
        back[t, :m] = (a[1, 0] + later * a[1, 1]) / (a[0, 0] + later * a[0, 1])
    return ahead[column, place[row]], back[column, place[row]]


@dataclass
class Chain:
    own: dict[bytes, float] = field(default_factory=dict)  # features of the word itself
    left: dict[bytes, float] = field(default_factory=dict)  # of the word before
    right: dict[bytes, float] = field(default_factory=dict)  # of the word after
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(6))

    def word_scores(self, word: bytes) -> tuple[float, float, float]:
        fs = features(word)
        return sum(self.own.get(f, 0.0) for f in fs), self.left.get(fs[0], 0.0), self.right.get(fs[0], 0.0)


class Tagger:
    """Marginals of whole texts under one chain; remembers words' scores."""

    def __init__(self, chain: Chain) -> None:
        self.chain, self.at, self.scores = chain, {}, []

    def _rows(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.at)
        if len(self.at) + len(new) > CACHE_WORDS:
            self.at, self.scores = {}, []
            new = set(words)
        for word in new:
            self.at[word] = len(self.scores)
            self.scores.append(self.chain.word_scores(word))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def marginals(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        sizes = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return [np.empty(0)] * len(docs)
        rows = self._rows([w for d in docs for w in d])
        p = chain_marginals(np.array(self.scores)[rows], sizes, self.chain.bias, self.chain.moves)
        return np.split(p, ends[:-1])


def emissions(scores: np.ndarray, sizes: np.ndarray, bias: float) -> np.ndarray:
    """Own score, plus the neighbours' within the document."""
    out = scores[:, 0] + bias
    first = np.zeros(len(scores), bool)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    first[starts] = True
    out[1:] += np.where(first[1:], 0.0, scores[:-1, 1])
    out[:-1] += np.where(first[1:], 0.0, scores[1:, 2])
    return out


def chain_marginals(scores: np.ndarray, sizes: np.ndarray, bias: float, moves: np.ndarray) -> np.ndarray:
    ahead, back = forward_backward(np.exp(np.clip(emissions(scores, sizes, bias), -30, 30)), sizes, np.exp(moves))
    odds = ahead * back
    return odds / (1 + odds)


def document_features(p: np.ndarray) -> np.ndarray:
    total, sure = p.sum(), (p > 0.5).sum()
    return np.array([1.0, np.log1p(total), p.max(initial=0.0), np.log1p(sure), total / max(20, len(p)) * 10, np.log1p(len(p))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; the first column is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge * max(1, len(y)) / 100)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(h, x.T @ (y - p) - shrink * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def token_labels(docs: list[list[bytes]], toxic: np.ndarray, ratio: float = 4.0, least: int = 3, share: float = 0.01) -> tuple[dict[bytes, list[bytes]], set[bytes], set[bytes]]:
    """Features of each word, the features seen in at least ``least`` documents, and the words labelled toxic.

    A word is labelled toxic if one of its features is in at least ``least``
    toxic documents and a ``share`` of them, ``ratio`` times its share of others.
    """
    of: dict[bytes, list[bytes]] = {}
    one: dict[bytes, bytes] = {}  # equal features of different words are one object
    seen = (Counter(), Counter())
    for words, y in zip(docs, toxic, strict=True):
        have: set[bytes] = set()
        for w in set(words):
            if w not in of:
                of[w] = [one.setdefault(f, f) for f in features(w)]
            have.update(of[w])
        seen[int(y)].update(have)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marked = {f for f, c in seen[1].items() if c >= max(least, share * n1) and (c / n1) / ((seen[0][f] + 0.5) / n0) >= ratio}
    frequent = {f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= least}
    return of, frequent, {w for w, fs in of.items() if not marked.isdisjoint(fs)}


def _parts(sizes: np.ndarray, tokens: int = 100_000) -> list[tuple[int, int, np.ndarray]]:
    """Runs of whole documents of about ``tokens`` tokens: first and last token, and the documents' sizes."""
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff((ends - 1) // tokens)) + 1
    groups = zip(np.split(sizes, cuts), [0, *cuts.tolist()], strict=True)
    return [(int(ends[i] - sizes[i]), int(ends[i + len(g) - 1]), g) for g, i in groups if g.sum()]


def fit_chain(docs: list[list[bytes]], toxic: np.ndarray, l2: float = 0.5, steps: int = 80) -> Chain:
    """Maximum likelihood of the labelled tokens, by gradient descent with Adam's step sizes."""
    of, frequent, marked = token_labels(docs, toxic)
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum() or not marked:
        return Chain()
    words = list(of)
    at = {w: i for i, w in enumerate(words)}
    tokens = np.fromiter((at[w] for d in docs for w in d), np.int64, int(sizes.sum()))
    mark = np.array([w in marked for w in words])
    y = (mark[tokens] & np.repeat(toxic.astype(bool), sizes)).astype(float)

    names = sorted(frequent)
    index = {f: i for i, f in enumerate(names)}
    known = [[index[f] for f in of[w] if f in index] for w in words]
    owner = np.repeat(np.arange(len(words)), [len(k) for k in known])
    feat = np.fromiter((f for k in known for f in k), np.int64, len(owner))
    del known
    alone = np.array([index.get(b"=" + w, -1) for w in words])
    n, v = len(names), len(words)

    parts = _parts(sizes)
    same_doc = np.ones(len(tokens), bool)
    same_doc[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    pos = np.flatnonzero(same_doc)
    target = np.zeros((2, 2))
    np.add.at(target, (y[pos - 1].astype(int), y[pos].astype(int)), 1)

    theta = np.zeros(3 * n + 5)  # own, left, right, bias, moves
    theta[3 * n] = -3.0
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        own = np.bincount(owner, weights=theta[feat], minlength=v)
        pick = lambda k: np.where(alone >= 0, theta[k * n + np.maximum(alone, 0)], 0.0)
        scores = np.stack([own, pick(1), pick(2)], axis=1)
        a = np.exp(theta[3 * n + 1 :].reshape(2, 2))
        expected = np.zeros((2, 2))
        grad = np.zeros_like(theta)
        by_word, by_left, by_right = np.zeros(v), np.zeros(v), np.zeros(v)
        for start, end, of_part in parts:  # documents of a few tokens at a time
            ids = tokens[start:end]
            e = np.exp(np.clip(emissions(scores[ids], of_part, theta[3 * n]), -30, 30))
            ahead, back = forward_backward(e, of_part, a)
            odds = ahead * back
            diff = odds / (1 + odds) - y[start:end]
            linked = np.flatnonzero(same_doc[start:end])
            # expected moves between neighbours
            late, early = (e * back)[linked], ahead[linked - 1]
            total = (a[0, 0] + a[0, 1] * late) + early * (a[1, 0] + a[1, 1] * late)
            late = late / total
            expected += [[a[0, 0] * (1 / total).sum(), a[0, 1] * late.sum()], [a[1, 0] * (early / total).sum(), a[1, 1] * (early * late).sum()]]
            by_word += np.bincount(ids, weights=diff, minlength=v)
            # the word before takes part in the next token's emission, and the reverse
            by_left += np.bincount(ids[linked - 1], weights=diff[linked], minlength=v)
            by_right += np.bincount(ids[linked], weights=diff[linked - 1], minlength=v)
        grad[:n] = np.bincount(feat, weights=by_word[owner], minlength=n)
        single = alone >= 0
        for k, by in ((1, by_left), (2, by_right)):
            grad[k * n : (k + 1) * n] = np.bincount(alone[single], weights=by[single], minlength=n)
        grad[3 * n] = by_word.sum()
        grad[3 * n + 1 :] = (expected - target).ravel()
        grad += l2 * theta
        grad[3 * n] -= l2 * theta[3 * n]
        m = 0.9 * m + 0.1 * grad
        s = 0.99 * s + 0.01 * grad * grad
        rate = 0.3 if step < steps * 0.6 else 0.1
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    keep = lambda k: {f: float(theta[k * n + i]) for f, i in index.items() if abs(theta[k * n + i]) > 0.02}
    return Chain(keep(0), keep(1), keep(2), float(theta[3 * n]), theta[3 * n + 1 :].reshape(2, 2).copy())


def fit(rows: list[tuple[str | None, int]], seed: int = 0, odds: float | None = None) -> Chain:
    """From ``(text, toxic)`` rows: two thirds train the chain, the rest the document score.

    ``odds`` of label 1 among all labelled rows; the score is corrected where
    the sample's differ. Without both labels: a chain that scores 0.
    """
    one: dict[bytes, bytes] = {}  # equal words are one object
    docs = [[one.setdefault(w, w) for w in tokens_of(t)] for t, _ in rows]
    del one
    y = np.array([int(bool(x)) for _, x in rows])
    if len(set(y.tolist())) < 2:
        return Chain(document=np.array([-30.0, 0, 0, 0, 0, 0]))
    rest = np.random.default_rng(seed).random(len(rows)) < 1 / 3
    if len(rows) < 60 or len(set(y[rest].tolist())) < 2 or len(set(y[~rest].tolist())) < 2:
        rest = np.ones(len(rows), bool)
        train = rest
    else:
        train = ~rest
    chain = fit_chain([d for d, t in zip(docs, train, strict=True) if t], y[train])
    tagger = Tagger(chain)
    x = np.array([document_features(tagger.marginals([d])[0]) for d, r in zip(docs, rest, strict=True) if r])
    chain.document = _logistic(x, y[rest].astype(float))
    if odds:
        chain.document[0] += np.log(odds / (y[rest].sum() / (1 - y[rest]).sum()))
    return chain


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, out_fold: int | None = 1, toxic_rows: int = 800, other_rows: int = 1800, seed: int = 0) -> Chain:
    """A chain from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    At most about ``toxic_rows`` and ``other_rows`` are used, none of them with
    crc32(doc_id) mod ``folds`` = ``out_fold``. Null ids and labels teach nothing.
    A doc_id with several labels is toxic if one of them says so; one with
    several texts teaches the smallest. Very long texts are taken whole; empty
    tables give a chain that scores 0.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["toxic"] != 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if out_fold is not None:
        known = known.where(crc32_mod(F.col("doc_id"), folds) != out_fold)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # a row a label
    picked = [bounded_sample(known.where(F.col("toxic") == y), "toxic", n, seed) for y, n in ((1, toxic_rows), (0, other_rows))]
    sample = collected(rows, picked[0].unionByName(picked[1]), "toxic")
    return fit(sample, seed, count.get(1, 0) / max(1, count.get(0, 0)))


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens of probability above one half: offsets in code points and mean probability."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (p > 0.5).astype(int), [0]])))
    return [{"start": places[i][0], "end": places[j - 1][1], "probability": float(p[i:j].mean())} for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


OUT = "doc_id long, score double, spans array<struct<start:int,end:int,probability:double>>"


def _score(shared, with_spans: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared())
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            ps = tagger.marginals([tokens_of(t) for t in texts])
            score = 1 / (1 + np.exp(-np.clip(np.array([document_features(p) for p in ps]) @ tagger.chain.document, -30, 30)))
            columns, names = [part.column(0), pa.array(score)], ["doc_id", "score"]
            if with_spans:
                columns.append(pa.array([_spans(t, p) if t and (p > 0.5).any() else [] for t, p in zip(texts, ps, strict=True)], kind))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def score(docs: DataFrame, chain: Chain, with_spans: bool = True) -> DataFrame:
    """``doc_id, score, spans`` for each row of ``docs(doc_id, text)``; a narrow operation.

    Null or empty text has no tokens and gets the score of such a text. Null
    doc_ids and repeated rows are returned as they are. Empty table: no rows.
    """
    shared = share(docs.sparkSession, chain)  # weights of features of the bounded sample
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_score(shared, with_spans), OUT if with_spans else "doc_id long, score double")


def _keep(shared, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared())
        for part in slices(batches):
            ps = tagger.marginals([tokens_of(t) for t in part.column(text_at).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(np.array([document_features(p) for p in ps]) @ tagger.chain.document, -30, 30)))
            yield part.filter(pa.array(score < threshold))

    return run


def reject(docs: DataFrame, chain: Chain, threshold: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns; a narrow operation.

    Null ids, null texts and repeated rows are judged by their text alone.
    """
    shared = share(docs.sparkSession, chain)
    return map_rows(docs, _keep(shared, docs.columns.index("text"), threshold))
