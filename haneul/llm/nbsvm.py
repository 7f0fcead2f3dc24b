"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each text becomes the set (indicators) of its byte 1- to 4-grams, hashed to DIM places, and of
the patterns of its word 2- to 4-grams: which of an n-gram's words equal which. On a bounded
sample of labelled rows (`max_sample`, the rows whose hashed id is least) the log-count ratio r
of the classes scales the indicators, and a linear model with hinge loss is fitted to them by
dual coordinate descent, in one task: the sample's bound is its bound too. Scaled rows have
unit length in fitting and in scoring alike, so a text's length alone makes no score extreme.
Margins become scores by a logistic curve, fitted to the margins that models of the other folds
give each row of the sample. Scoring reads every whole text where it lies; nothing but the
model (a float for each place) is sent. DIM leaves most places free even for texts of 100,000
characters, so long texts are told apart too.

Nulls: a null text is scored as the empty text, a null id is never held out and never learnt
from; labels other than 0 and 1 are ignored; several labels of one id count by their mean
(over 0.5: 1). Without rows of both classes every score is the share of label 1 (0.5 without
labels). Repeated rows are scored alike; an empty table gives an empty result. Other columns
pass through; one named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import released, sliced

BITS = 18
DIM = 1 << BITS
#: Places of the patterns of word 2-, 3- and 4-grams (a bit for each pair of places in the n-gram).
PATTERNS = {2: DIM, 3: DIM + 2, 4: DIM + 2 + 8}
SIZE = DIM + 2 + 8 + 64
FOLDS = 3
#: Odd multipliers of the multiplicative hash, one for each n.
_ODD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def features(text: str | None) -> np.ndarray:
    """Sorted places of the indicators of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    mark = np.zeros(SIZE, bool)
    code = data
    for n, odd in enumerate(_ODD):
        if n:
            if len(data) <= n:
                break
            code = (code[:-1] << np.uint32(8)) | data[n:]
        mark[(code * np.uint32(odd) + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = True
    seen: dict[bytes, int] = {}
    words = raw.split()
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
    same = [ids[k:] == ids[:-k] if len(ids) > k else np.zeros(0, bool) for k in (1, 2, 3)]
    for n, first in PATTERNS.items():
        many = len(ids) - n + 1
        if many > 0:
            pairs = [same[b - a - 1][a : a + many] for a in range(n) for b in range(a + 1, n)]
            mark[first + np.unique(sum(x.astype(np.int64) << k for k, x in enumerate(pairs)))] = True
    return np.flatnonzero(mark).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, scaled by their ratio
    squares: np.ndarray  # of the ratios: a row's squared length is their sum, and 1 for the bias
    bias: float
    slope: float
    shift: float

    def margin(self, row: np.ndarray) -> float:
        return float((self.weights[row].sum() + self.bias) / np.sqrt(self.squares[row].sum() + 1))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -60, 60))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, alpha: float) -> np.ndarray:
    p, q = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for x, y in zip(rows, labels):
        (p if y else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, epochs: int, tol: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss; the bias is a constant feature of value 1. Rows are scaled to unit length."""
    scale = np.array([1 / np.sqrt((r[x] ** 2).sum() + 1) for x in rows])
    w, b, alpha, order = np.zeros(len(r)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            x, s = rows[i], scale[i]
            rx = r[x]
            g = y[i] * s * (w[x] @ rx + b) - 1
            if (alpha[i] == 0 and g > 0) or (alpha[i] == cost[i] and g < 0):
                continue
            worst = max(worst, abs(g))
            new = min(max(alpha[i] - g, 0.0), cost[i])  # the row's squared length is 1
            d = (new - alpha[i]) * y[i] * s
            if d:
                alpha[i] = new
                w[x] += d * rx
                b += d
        if worst < tol:
            break
    return w * r, b


def fit_margins(rows: list[np.ndarray], labels: np.ndarray, alpha: float, cost: float, epochs: int, tol: float) -> Model:
    """A model without its logistic curve. Both classes weigh the same."""
    y = np.where(labels == 1, 1.0, -1.0)
    r = log_count_ratio(rows, labels, alpha)
    weigh = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-3), 0.5 / max((y < 0).mean(), 1e-3))
    w, b = dual_coordinate_descent(rows, y, r, cost * weigh, epochs, tol)
    return Model(w, r**2, b, 1.0, 0.0)


def fit(texts: list[str | None], labels: np.ndarray, alpha: float = 1.0, cost: float = 1.0, epochs: int = 12, tol: float = 0.05) -> Model:
    share = float(labels.mean()) if len(labels) else 0.5
    odds = min(max(share, 1e-3), 1 - 1e-3)
    if len(labels) < 4 or labels.min() == labels.max():
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log(odds / (1 - odds))))
    rows = [features(t) for t in texts]
    model, fold = fit_margins(rows, labels, alpha, cost, epochs, tol), folds_of(labels)
    margins = np.array([model.margin(x) for x in rows])
    for k in range(FOLDS) if fold is not None else ():
        margins[fold == k] = fold_margins(rows, labels, fold, k, alpha, cost, epochs, tol)
    return curved(model, margins, labels)


def folds_of(labels: np.ndarray) -> np.ndarray | None:
    """A fold for each row, each with its part of both classes; None where a class is too small to be parted."""
    if min((labels == 0).sum(), (labels == 1).sum()) < FOLDS:
        return None
    fold = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        fold[labels == y] = np.arange((labels == y).sum()) % FOLDS
    return fold


def fold_margins(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, k: int, alpha: float = 1.0, cost: float = 1.0, epochs: int = 12, tol: float = 0.05) -> np.ndarray:
    """The margins of fold k's rows by a model of the other folds."""
    at = np.flatnonzero(fold != k)
    other = fit_margins([rows[i] for i in at], labels[at], alpha, cost, epochs, tol)
    return np.array([other.margin(rows[i]) for i in np.flatnonzero(fold == k)])


def curved(model: Model, margins: np.ndarray, labels: np.ndarray) -> Model:
    """The model with the logistic curve of these margins."""
    spread = margins.std() or 1.0
    slope, model.shift = platt(margins / spread, labels)
    model.slope = slope / spread
    return model


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps, with smoothed targets."""
    n1, n0 = labels.sum(), (labels == 0).sum()
    t = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        v, d = p * (1 - p) + 1e-9, p - t
        h = np.array([[(v * margins**2).sum() + 1e-2, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-2]])
        g = np.array([(d * margins).sum() + 1e-2 * (a - 1), d.sum()])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_sample: int = 8_000) -> Model:
    """Fit on at most max_sample labelled rows of the learning folds, one text an id (that of the least md5, if
    rows repeat it). The final model and each fold's model are learnt in tasks of their own."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("_hn_id")).agg((F.avg(label_col) > 0.5).cast("int").alias("_hn_y"))
    chosen = known.orderBy(F.xxhash64("_hn_id"), "_hn_id").limit(max_sample)  # the bound of this broadcast
    sample = docs.select(F.col(id_col).cast("long").alias("_hn_id"), F.col(text_col).alias("_hn_text")).join(F.broadcast(chosen), "_hn_id")
    sample = sample.groupBy("_hn_id", "_hn_y").agg(F.min_by("_hn_text", F.struct(F.md5("_hn_text"))).alias("_hn_text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for b in batches:
            for part, *r in zip(*(c.to_pylist() for c in b.columns)):
                by_part.setdefault(part, []).append(r)
        for part, got in by_part.items():
            got.sort(key=lambda r: (r[2], r[0], r[1] or ""))
            y = np.array([r[3] for r in got], np.int64)
            fold, single = folds_of(y), y.min() == y.max()
            if part < FOLDS and (fold is None or len(y) < 4 or single):
                continue
            model, margins = None, np.array([])
            if part == FOLDS and (fold is None or len(y) < 4 or single):
                model = fit([r[1] for r in got], y)  # too few for folds
            else:
                rows = [features(r[1]) for r in got]
                got.clear()
                if part == FOLDS:
                    model = fit_margins(rows, y, 1.0, 1.0, 12, 0.05)
                else:
                    margins = fold_margins(rows, y, fold, part)
            out = [x.astype(np.float32).tobytes() if model else b"" for x in ((model.weights, model.squares) if model else (None, None))]
            rest = (model.bias, model.slope, model.shift) if model else (0.0, 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([x], pa.binary()) for x in out), *(pa.array([x], pa.float64()) for x in rest), pa.array([margins.tolist()], pa.list_(pa.float64())), pa.array([y.tolist()], pa.list_(pa.int64()))], names)
        by_part.clear()
        released()

    schema = "part long, weights binary, squares binary, bias double, slope double, shift double, margins array<double>, labels array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    parts = F.explode(F.array(*(F.lit(k).cast("long") for k in range(FOLDS + 1)))).alias("part")
    learnt = sample.select(parts, "_hn_id", "_hn_text", F.xxhash64("_hn_id").alias("h"), "_hn_y").repartitionByRange(FOLDS + 1, "part")
    found = {r.part: r for r in learnt.mapInArrow(learn, schema).collect()}
    if not found:
        return fit([], np.array([]))
    last = found.pop(FOLDS)
    model = Model(*(np.frombuffer(x, np.float32).astype(np.float64) for x in (last.weights, last.squares)), last.bias, last.slope, last.shift)
    if not found:
        return model
    y = np.array(last.labels, np.int64)
    fold, margins = folds_of(y), np.zeros(len(y))
    for k, r in found.items():
        margins[fold == k] = r.margins
    return curved(model, margins, y)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of every whole text, between 0 and 1."""
    weights, squares = (x.astype(np.float32) for x in (model.weights, model.squares))
    rest = model.bias, model.slope, model.shift

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(weights.astype(np.float64), squares.astype(np.float64), *rest)
        for texts in batches:
            yield pa.array([own.score(t) for part in sliced(texts) for t in part], pa.float64())

    return docs.withColumn(out, scored(F.col(text_col)))
