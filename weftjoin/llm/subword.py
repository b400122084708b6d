"""Hashed word and character n-gram embeddings under a softmax, trained by numpy stochastic gradient descent.

A text is its bytes with A-Z lower-cased.  Its features are a hash of every word, of how often the
text has that word and whether it also stands just before, and of every byte n-gram that doesn't span
two words (a word's neighbouring space counts, so beginnings and ends are told apart).  An embedding row belongs to each bucket; a text's vector is the mean of its rows, and
softmax weights turn it into two class probabilities.  As all of that is linear up to the softmax,
scoring uses one number per bucket: the row's dot product with the difference of the two classes'
weights.  That table is what goes to the executors; its size is set by ``buckets`` alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from weftjoin.llm.support import BYTE_VALUES, IS_SPACE, mix64, words_of

_VALUES = np.where(IS_SPACE, np.uint64(0x51ED270B), BYTE_VALUES).astype(np.uint32)
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and of its training.

    ``passage``: words in a scored passage, a document's score being that of its highest; None: the whole text.
    ``least``: the mean is over this many features at least, so that a few words alone decide little.
    ``warm_epochs``: of the epochs, so many first ones step on all of a text, before its highest passage means anything.
    ``per_class``, ``longest_bytes``: bounds of the training sample, see ``labelled.training_sample``.
    """

    buckets_log2: int = 18
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    passage: int | None = None
    least: int = 1
    epochs: int = 6
    warm_epochs: int = 0
    rate: float = 0.5
    adaptive: bool = False
    per_class: int = 1500
    longest_bytes: int = 40_000
    seed: int = 7


def _stale(starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray | None:
    """Of the padded text's bytes, those of a word that repeats the word just before it; None if there is no such word."""
    same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    if not len(same):
        return None
    marks = np.zeros(size + 1, dtype=np.int8)
    marks[starts[same]] = 1
    marks[ends[same] + 1] -= 1
    return np.cumsum(marks[:-1], dtype=np.int8) > 0


def _grams(raw: bytes, s: Settings, stale: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram at every byte position of the padded text, and where it counts."""
    padded = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
    value, solid = _VALUES[padded], ~IS_SPACE[padded]
    shift = np.uint32(32 - s.buckets_log2)
    rolled, inner = value[:-1] * _STEP + value[1:], np.ones(len(value) - 1, dtype=bool)
    for n in range(3, max(s.grams) + 1):
        if len(rolled) < 2:
            return
        rolled = rolled[:-1] * _STEP + value[n - 1 :]
        inner = inner[:-1] & solid[n - 2 : n - 2 + len(rolled)]
        if n in s.grams:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * _SPREAD
            yield (mixed >> shift).view(np.int32), inner if stale is None else inner & ~stale[: len(inner)]


def _words(raw: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Start of every word, the buckets (2 x words) of the word and of how it repeats, and in passages the bytes to skip.

    A passage skips words that repeat the word before: a run of one word is no passage of that word's mean.
    """
    starts, ends, hashes = words_of(raw)
    stale = None
    if s.passage and len(starts) and (stale := _stale(starts, ends, hashes, len(raw) + 2)) is not None:
        fresh = ~stale[starts]
        starts, hashes = starts[fresh], hashes[fresh]
    _, kind, times = np.unique(hashes, return_inverse=True, return_counts=True)
    often = np.frexp(times[kind].astype(np.float32))[1].astype(np.uint64)
    again = np.zeros(len(hashes), dtype=np.uint64)
    again[1:] = hashes[1:] == hashes[:-1]
    shift = np.uint64(64 - s.buckets_log2)
    return starts, np.stack([hashes >> shift, mix64(np.uint64(977) + often * np.uint64(2) + again) >> shift]).astype(np.int32), stale


def features(raw: bytes, s: Settings) -> list[np.ndarray]:
    """The buckets of all feature occurrences, one array for each passage; none for a text without words."""
    starts, words, stale = _words(raw, s)
    if not len(starts):
        return []
    bounds = np.append(starts[:: s.passage or len(starts)], len(raw) + 2)
    bounds[0] = 0
    at = np.searchsorted(starts, bounds[:-1])
    upto = np.append(at[1:], len(starts))
    grams = list(_grams(raw, s, stale))
    out = []
    for j in range(len(at)):
        lo, hi = bounds[j], bounds[j + 1]
        out.append(np.concatenate([words[:, at[j] : upto[j]].ravel(), *(b[lo:hi][ok[lo:hi]] for b, ok in grams)]))
    return out


@dataclass
class Model:
    settings: Settings
    embeddings: np.ndarray
    weights: np.ndarray  # classes x dim
    bias: float

    def logits(self) -> np.ndarray:
        return (self.embeddings @ (self.weights[1] - self.weights[0])).astype(np.float32)


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def score(raw: bytes, logits: np.ndarray, bias: float, s: Settings) -> float:
    """The probability of class 1, in [0, 1]; a text without words has the bias alone."""
    starts, words, stale = _words(raw, s)
    if not len(starts):
        return _sigmoid(bias)
    total, count = np.zeros(len(raw) + 2, dtype=np.float32), np.zeros(len(raw) + 2, dtype=np.float32)
    total[starts] = logits[words].sum(axis=0)
    count[starts] = 2
    for buckets, ok in _grams(raw, s, stale):
        total[: len(ok)] += logits[buckets] * ok
        count[: len(ok)] += ok
    at = starts[:: s.passage or len(starts)].copy()
    at[0] = 0
    sizes = np.maximum(np.add.reduceat(count, at, dtype=np.float64), s.least)
    return _sigmoid(bias + float((np.add.reduceat(total, at, dtype=np.float64) / sizes).max()))


def _shares(ids: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    own, times = np.unique(ids, return_counts=True)
    return own, (times / max(len(ids), s.least)).astype(np.float32)


def train(texts: list[bytes], labels: list[int], s: Settings) -> Model:
    """Softmax cross-entropy, one text at a time; of a text in passages, the step is on the one that scores highest.

    A mean spreads a gradient thinly over a text's rows.  Plain steps are therefore relative to the
    largest share in the text and over the number of rows; ``adaptive`` ones are divided by the root of
    the row's squared gradients so far, so that rows which are rarely met move as far as common ones.
    """
    rng = np.random.default_rng(s.seed)
    emb = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.buckets_log2, s.dim)).astype(np.float32)
    seen = np.full(1 << s.buckets_log2, 1e-12, dtype=np.float32)
    weights = np.zeros((2, s.dim), dtype=np.float32)
    weights[0, ::2] = weights[1, 1::2] = 1
    if len(set(labels)) < 2:
        return Model(s, np.zeros_like(emb), weights, 3.0 if 1 in labels else -3.0 if labels else 0.0)
    parts, whole = [], []
    for t in texts:
        p = features(t, s)
        whole.append(_shares(p[0], s) if len(p) == 1 else None)
        parts.append(p if len(p) > 1 else None)
    bias, done, n_steps = 0.0, 0, s.epochs * len(parts)
    n1 = sum(labels)
    heft = [1.0, min(3.0, max(1.0, (len(labels) - n1) / n1))]
    for epoch in range(s.epochs):
        for i in rng.permutation(len(parts)):
            rate = s.rate * (1 - done / n_steps) * heft[labels[i]]
            done += 1
            toward = weights[1] - weights[0]
            if parts[i] is None and whole[i] is None:
                bias -= 0.05 * rate * (_sigmoid(bias) - labels[i])
                continue
            if whole[i] is None and epoch < s.warm_epochs:
                own = np.unique(np.concatenate(parts[i]))
                share = np.full(len(own), 1 / len(own), dtype=np.float32)
            elif whole[i] is None:
                sizes = np.array([len(p) for p in parts[i]])
                at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                means = np.add.reduceat(emb[np.concatenate(parts[i])] @ toward, at) / np.maximum(sizes, s.least)
                own, share = _shares(parts[i][int(means.argmax())], s)
            else:
                own, share = whole[i]
            hidden = share @ emb[own]
            err = np.float32(_sigmoid(float(hidden @ toward) + bias) - labels[i])
            if s.adaptive:
                slope = err * share
                seen[own] += slope * slope
                step = np.float32(rate) * slope / np.sqrt(seen[own])
            else:
                step = (np.float32(rate * min(4.0, 256 / len(own))) * err / share.max()) * share
            emb[own] -= step[:, None] * toward
            weights[1] -= np.float32(0.02 * rate) * err * hidden
            weights[0] += np.float32(0.02 * rate) * err * hidden
            bias -= 0.05 * rate * float(err)
    return Model(s, emb, weights, bias)


def evaluate(scores: np.ndarray, labels: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    sorted_scores = scores[order]
    left, right = np.searchsorted(sorted_scores, sorted_scores, "left"), np.searchsorted(sorted_scores, sorted_scores, "right")
    ranks[order] = (left + right + 1) / 2
    pos = labels == 1
    n1, n0 = pos.sum(), (~pos).sum()
    return float((ranks[pos].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * n0))
