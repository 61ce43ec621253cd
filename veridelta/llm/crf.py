"""A linear-chain conditional random field over the lines of a document.

Every line is good (1) or bad (0). Its features are binned measures of the line
and of both neighbours; a document's quality is the marginal of good from the
forward-backward pass, averaged over lines by their length and calibrated on
documents that the field wasn't trained on.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

BINS = 8
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]=_~^\\/]")
_MEASURES = 16


def line_measures(lines: list[str]) -> np.ndarray:
    """Measures of each line, between 0 and 1."""
    out = np.zeros((len(lines), _MEASURES), np.float32)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, chars = len(words), len(line)
        repeated = float(line in seen)
        if n:
            seen.add(line)
        else:
            continue
        counts = Counter(words)
        low = line.lower()
        letters = sum(map(len, words))
        upper = sum(a != b for a, b in zip(line, low)) if len(low) == chars else sum(c.isupper() for c in line)
        out[i] = (
            min(1.0, np.log1p(n) / 8),
            min(1.0, letters / n / 12),
            min(1.0, len(_SYMBOLS.findall(line)) / n / 2),
            min(1.0, sum(map(line.count, "0123456789")) / chars * 4),
            upper / chars,
            len(counts) / n,
            max(counts.values()) / n,
            sum(len(w) <= 3 for w in counts) / len(counts),
            sum(c for w, c in counts.items() if len(w) <= 3) / n,
            float(line.rstrip()[-1:] in ".?!\"'”»…"),
            float(words[0][:1].isupper()),
            repeated,
            min(1.0, line.count("!") / n),
            min(1.0, (line.count(",") + line.count(".")) / n * 3),
            sum(len(w) > 12 for w in words) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
        )
    return out


def _binned(measures: np.ndarray) -> np.ndarray:
    """Active feature of each measure: m * (BINS + 1) + bin; bin 0 is exactly 0."""
    place = np.minimum((measures * BINS).astype(np.int64), BINS - 1) + (measures > 0)
    return place + np.arange(_MEASURES) * (BINS + 1)


WIDTH = _MEASURES * (BINS + 1)


class Lines:
    """Lines of several documents, longest document first, as feature numbers."""

    def __init__(self, texts: list[str]):
        split = [t.split("\n") for t in texts]
        self.counts = np.array([len(s) for s in split])
        self.order = np.argsort(-self.counts, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))[:-1]
        measures = np.concatenate([line_measures(s) for s in split]) if split else np.zeros((0, _MEASURES), np.float32)
        own = _binned(measures)
        total, doc = len(own), np.repeat(np.arange(len(texts)), self.counts)
        none = 3 * WIDTH  # a neighbour beyond the document's ends
        before, after = np.full_like(own, none), np.full_like(own, none)
        if total > 1:
            same = doc[1:] == doc[:-1]
            before[1:][same] = own[:-1][same] + WIDTH
            after[:-1][same] = own[1:][same] + 2 * WIDTH
        self.features = np.concatenate((own, before, after), axis=1)
        self.weights = np.array([len(x) if x.strip() else 0 for s in split for x in s], np.float64)
        self.doc = doc

    def steps(self):
        """Line numbers at place 0, 1, ... of the documents that have that place."""
        counts, starts = self.counts[self.order], self.starts[self.order]
        for t in range(int(counts[0]) if len(counts) else 0):
            yield starts[: np.searchsorted(-counts, -t, side="left")] + t


def marginals(emission: np.ndarray, trans: np.ndarray, lines: Lines):
    """P(good) of each line, and expected transitions and log Z in all."""
    n = len(emission)
    e = np.stack((np.zeros(n), emission), axis=1)
    alpha, beta = e.copy(), np.zeros((n, 2))
    steps = list(lines.steps())
    for prev, now in zip(steps, steps[1:]):
        a = alpha[prev[: len(now)]]
        alpha[now] += np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])
    for prev, now in zip(steps[-2::-1], steps[:0:-1]):
        b = beta[now] + e[now]
        beta[prev[: len(now)]] = np.logaddexp(b[:, :1] + trans[:, 0], b[:, 1:] + trans[:, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    pairs = np.zeros((2, 2))
    if len(steps) > 1:
        prev = np.concatenate([p[: len(q)] for p, q in zip(steps, steps[1:])])
        now = np.concatenate(steps[1:])
        z = np.logaddexp(both[now, 0], both[now, 1])
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = np.exp(alpha[prev, i] + trans[i, j] + e[now, j] + beta[now, j] - z).sum()
    return good, pairs


class Model:
    """Feature weights, transitions, and the calibration a * logit + b."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, slope: float = 1.0, shift: float = 0.0, prior: float = 0.5):
        self.weights, self.trans, self.slope, self.shift, self.prior = weights, trans, slope, shift, prior

    def emission(self, lines: Lines) -> np.ndarray:
        return self.weights[lines.features].sum(axis=1)

    def raw(self, lines: Lines) -> np.ndarray:
        """Length-weighted marginal of each document; nan without any word."""
        good, _ = marginals(self.emission(lines), self.trans, lines)
        n = len(lines.counts)
        mass = np.bincount(lines.doc, lines.weights, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(lines.doc, lines.weights * good, n) / mass

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.raw(Lines(texts))
        x = _logit(m)
        s = 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30)))
        return np.where(np.isnan(m), self.prior, s)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(texts: list[str], labels: np.ndarray, rounds: int = 120, penalty: float = 0.02, seed: int = 5) -> Model:
    """Fit on 3/4 of the documents, every line carrying its document's label;
    calibrate on the rest. The transitions are held small by their penalty, for
    a bad document may have good lines."""
    labels = np.asarray(labels, np.int64)
    if not len(labels):
        return Model(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)))
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    if labels.min() == labels.max():
        return Model(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), 0.0, float(np.log(prior / (1 - prior))), prior)
    pick = np.random.default_rng(seed).random(len(texts)) < 0.75
    pick[[int(np.argmax(labels)), int(np.argmin(labels))]] = True
    fit = [i for i in np.nonzero(pick)[0]]
    lines = Lines([texts[i] for i in fit])
    y = labels[fit][lines.doc].astype(np.float64)
    w, trans = np.zeros(3 * WIDTH + 1), np.zeros((2, 2))
    params, mean, var = np.zeros(len(w) + 4), np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    flat, total = lines.features.ravel(), len(y)
    inside = np.ones(total, bool)
    inside[lines.starts] = False
    seen = np.zeros((2, 2))
    for i in (0, 1):
        seen[i, i] = (y[inside] == i).sum()
    # The gradient is a mean over lines: a stronger hold would undo rare features.
    strength = np.concatenate((np.full(len(w), penalty / 2000), np.full(4, penalty)))
    for step in range(1, rounds + 1):
        good, pairs = marginals(w[lines.features].sum(axis=1), trans, lines)
        grad = np.concatenate((np.bincount(flat, np.repeat(y - good, lines.features.shape[1]), len(w)), (seen - pairs).ravel())) / total
        grad -= strength * params
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        params = params + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        w, trans = params[: len(w)], params[len(w) :].reshape(2, 2)
    model = Model(w.copy(), trans.copy(), prior=float(prior))
    rest = [i for i in range(len(texts)) if not pick[i]]
    if len(set(labels[rest].tolist())) == 2:
        m = model.raw(Lines([texts[i] for i in rest]))
        keep = ~np.isnan(m)
        x, t = _logit(m[keep]), labels[rest][keep]
        a, b = 1.0, 0.0
        for _ in range(300):  # logistic regression of one variable, lightly held to a = 1
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((t - p) * x).mean() - 0.01 * (a - 1), (t - p).mean()])
            q = p * (1 - p)
            h = np.array([[(q * x * x).mean() + 0.01, (q * x).mean()], [(q * x).mean(), q.mean() + 1e-6]])
            d = np.linalg.solve(h, g)
            a, b = a + 0.5 * d[0], b + 0.5 * d[1]
        model.slope, model.shift = float(max(a, 0.05)), float(b)
    return model
