"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line gets counts of byte classes; a line's features are ratios of its own counts and those of the lines
before and after. A two-state chain (bad, good) scores lines and transitions. Only documents carry labels, so
line labels start as their document's and are refined: lines of a bad document that look good are relabelled
from the marginals before the next fit. A document's quality is the mean probability of "good" over its lines,
weighed by length, put through a logistic curve that is fitted to the training documents.

The model is fitted on the driver from a bounded sample of labelled rows: TRAIN_DOCS at most, by a hash of doc_id, and of
these as many as TRAIN_LINES lines allow in all, in the same order and whatever their length; one text longer than that
gives its first TRAIN_LINES lines to the fit if it comes first. Executors send line counts, packed. Scoring reads whole
texts, in slices, within a map-only pass.

Edge cases: null and empty texts are one blank line and get that line's score. With no labels, or labels of one
kind only, every score is 0.5. A null doc_id is never held out. Repeated rows get equal scores; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

TRAIN_DOCS = 4000
#: Lines in all that the fit gets, 88 bytes each.
TRAIN_LINES = 60_000
FOLDS = 5
THRESHOLD = 0.3
ROUNDS = 3
STEPS = 120
SLICE = 1 << 20

_KINDS = 10  # lower, upper, digit, space, end, inner, bar, symbol, other script, repeated mark
_CLASS = np.full(256, 8, np.int64)
_CLASS[:128] = 7
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]] = 3
for _marks, _kind in ((b".!?", 4), (b",;:'\"-()", 5), (b"|", 6)):
    _CLASS[list(_marks)] = _kind
_MARK = np.isin(_CLASS, (4, 5, 6, 7))


def line_counts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts (lines x kinds and words) and the number of lines of each text; None counts as empty."""
    lines_of = np.ones(len(texts), np.int64)
    total, parts = 0, []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        lines_of[i] = data.count(b"\n") + 1
        parts.append(data)
    counts = np.zeros((int(lines_of.sum()), _KINDS + 1), np.int64)
    stream = b"\n".join(parts)
    before = 10
    for low in range(0, len(stream), SLICE):
        buf = np.frombuffer(stream, np.uint8, min(SLICE, len(stream) - low), low)
        new = buf == 10
        line = np.cumsum(new) - new
        last = int(line[-1]) + int(new[-1])
        width = last + 1
        keep = ~new
        got = np.bincount((line * _KINDS + _CLASS[buf])[keep], minlength=width * _KINDS).reshape(width, _KINDS)
        prior = np.concatenate([[before], buf[:-1]])
        got[:, 9] = np.bincount(line[(buf == prior) & _MARK[buf]], minlength=width)
        gap = _CLASS[prior] == 3
        gap |= prior == 10
        words = np.bincount(line[gap & (_CLASS[buf] != 3) & keep], minlength=width)
        counts[total : total + width, :_KINDS] += got
        counts[total : total + width, _KINDS] += words
        total += last
        before = int(buf[-1])
    return counts, lines_of


def line_features(counts: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Features of each line and of its neighbours within the same text."""
    size = counts[:, :9].sum(axis=1)
    n = np.maximum(size, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 8], 1)
    words = counts[:, 10]
    own = [counts[:, 1] / letters, *(counts[:, k] / n for k in (2, 3, 4, 5, 6, 7, 8, 9))]
    base = np.stack(own, axis=1)
    base = np.concatenate(
        [
            base,
            np.sqrt(base),
            np.stack(
                [np.log1p(size) / 8, np.log1p(words) / 6, np.minimum(size / np.maximum(words, 1), 30) / 10, (size == 0) * 1.0, (counts[:, 0] == 0) * 1.0],
                axis=1,
            ),
        ],
        axis=1,
    )
    begin = np.zeros(len(base), bool)
    begin[np.cumsum(lines_of)[:-1]] = True
    begin[0] = True
    end = np.append(begin[1:], True)
    up = np.vstack([base[:1] * 0, base[:-1]]) * ~begin[:, None]
    down = np.vstack([base[1:], base[:1] * 0]) * ~end[:, None]
    return np.concatenate([base, up[:, 9:], down[:, 9:], begin[:, None], end[:, None], np.ones((len(base), 1))], axis=1)


def marginals(score: np.ndarray, lines_of: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected number of each move, by forward and backward sums over all texts at once.

    score: log weight of good against bad; moves: 2 x 2 log weights of a line's state after another's.
    """
    starts = np.cumsum(lines_of) - lines_of
    order = np.argsort(-lines_of, kind="stable")
    first, left = starts[order], lines_of[order]
    longest = int(left[0])
    running = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")  # texts with so many lines
    weight = np.stack([np.zeros(len(score)), score], axis=1)
    go = np.exp(moves - moves.max())
    node = np.exp(weight - weight.max(axis=1, keepdims=True))
    ahead = np.empty_like(node)
    for t in range(longest):
        at = first[: running[t]] + t
        x = node[at] if t == 0 else (ahead[at - 1] @ go) * node[at]
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    back = np.ones_like(node)
    for t in range(longest - 2, -1, -1):
        at = first[: running[t + 1]] + t
        x = (back[at + 1] * node[at + 1]) @ go.T
        back[at] = x / x.sum(axis=1, keepdims=True)
    both = ahead * back
    both /= both.sum(axis=1, keepdims=True)
    inner = np.ones(len(score), bool)
    inner[starts + lines_of - 1] = False
    at = np.flatnonzero(inner)
    pair = ahead[at][:, :, None] * go[None] * (node[at + 1] * back[at + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return both[:, 1], pair.sum(axis=0)


def _move_counts(labels: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(lines_of) - 1] = False
    at = np.flatnonzero(inner)
    return np.bincount(labels[at] * 2 + labels[at + 1], minlength=4).reshape(2, 2).astype(float)


def fit_chain(features: np.ndarray, lines_of: np.ndarray, labels: np.ndarray, start=None, steps: int = STEPS):
    """Weights and moves that maximise the labels' conditional likelihood (Adam, a small quadratic penalty)."""
    w, moves = start or (np.zeros(features.shape[1]), np.zeros((2, 2)))
    theta = np.concatenate([w, moves.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    truth = _move_counts(labels, lines_of)
    d = features.shape[1]
    for step in range(1, steps + 1):
        p, moved = marginals(features @ theta[:d], lines_of, theta[d:].reshape(2, 2))
        grad = np.concatenate([features.T @ (labels - p), (truth - moved).ravel()]) / len(labels) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:d], theta[d:].reshape(2, 2)


def document_means(p: np.ndarray, sizes: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """The mean of p over each text's lines, weighed by 1 + length."""
    at = np.cumsum(lines_of) - lines_of
    w = sizes + 1.0
    return np.add.reduceat(p * w, at) / np.add.reduceat(w, at)


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-4, 1 - 1e-4)
    return np.log(x / (1 - x))


def fit(counts: np.ndarray, lines_of: np.ndarray, quality: np.ndarray) -> dict | None:
    """The model of texts given by their line counts, with their labels; None if there is only one kind."""
    if len(set(quality.tolist())) < 2:
        return None
    features, sizes = line_features(counts, lines_of), counts[:, :9].sum(axis=1)
    given = np.repeat(quality.astype(np.int64), lines_of)
    labels, chain = given, None
    for _ in range(ROUNDS):
        chain = fit_chain(features, lines_of, labels, chain)
        p, _moved = marginals(features @ chain[0], lines_of, chain[1])
        # A bad document keeps its worst line as bad; its other lines go by what they look like.
        worst = np.repeat(np.minimum.reduceat(p, np.cumsum(lines_of) - lines_of), lines_of)
        labels = np.where((given == 0) & (p > 0.5) & (p > worst), 1, given)
    x = _logit(document_means(p, sizes, lines_of))
    curve = np.array([0.0, 1.0])
    for _ in range(50):  # Newton steps of a logistic regression on one number
        q = 1 / (1 + np.exp(-(curve[0] + curve[1] * x)))
        g = np.array([(quality - q).sum(), ((quality - q) * x).sum()]) - 0.01 * curve
        s = q * (1 - q)
        h = np.array([[s.sum(), (s * x).sum()], [(s * x).sum(), (s * x * x).sum()]]) + 0.01 * np.eye(2)
        curve = curve + np.clip(np.linalg.solve(h, g), -1, 1)
    return {"weights": chain[0], "moves": chain[1], "curve": curve}


def score_texts(texts: list, model: dict | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    out, low = np.empty(len(texts)), 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high] or "") < SLICE):
            size += len(texts[high] or "")
            high += 1
        counts, lines_of = line_counts(texts[low:high])
        p, _ = marginals(line_features(counts, lines_of) @ model["weights"], lines_of, model["moves"])
        x = _logit(document_means(p, counts[:, :9].sum(axis=1), lines_of))
        out[low:high] = 1 / (1 + np.exp(-(model["curve"][0] + model["curve"][1] * x)))
        low = high
    return out


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def _train_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, quality, th, text in zip(pdf["doc_id"], pdf["quality"], pdf["th"], pdf["text"], strict=True):
            counts, _ = line_counts([text])
            rows.append((doc_id, quality, th, len(counts), counts[:TRAIN_LINES].tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "quality", "th", "lines", "counts"])


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> dict | None:
    """Fits on at most `sample` labelled documents outside the held-out fold, chosen by a hash of doc_id, of `lines` lines in all.

    A doc_id counts once: the least of its labels, and of its texts the first by hash.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(*order)
        .limit(sample)
    )
    counted = (
        docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
        .join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
        .select("doc_id", "quality", "th", "text")
        .mapInPandas(_train_rows, "doc_id long, quality int, th long, lines long, counts binary")
        .groupBy("doc_id", "quality")
        .agg(F.min(F.struct("th", "lines", "counts")).alias("t"))
        .select("doc_id", "quality", "t.lines", "t.counts")
    )
    # Within a running sum of lines; the first one always is.
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counted.withColumn("upto", F.sum("lines").over(before)).withColumn("turn", F.row_number().over(before)).where((F.col("upto") <= lines) | (F.col("turn") == 1)).collect()
    if not rows:
        return None
    counts = [np.frombuffer(r.counts, np.int64).reshape(-1, _KINDS + 1) for r in rows]
    return fit(np.concatenate(counts), np.array([len(c) for c in counts]), np.array([r.quality for r in rows]))


def scorer(model: dict | None):
    """A column function: text -> score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), model), index=texts.index)

    return score


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with score and predicted."""
    return docs.withColumn("score", scorer(model)("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return scored(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", held_out, "score", "predicted")
