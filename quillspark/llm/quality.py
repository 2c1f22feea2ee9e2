"""Text quality by regularised quadratic discriminant analysis.

Each class is a Gaussian over transformed document statistics. Its covariance is shrunk towards the
pooled one and that towards its diagonal. Scores come from the difference of the Mahalanobis
log-densities, computed with Cholesky factors that are cached in the model, and are calibrated by a
logistic curve on the training rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import keep_text, map_text

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was on are be with as at by this from or an der die das und in den von zu mit ist des dem ein auf für nicht im als auch sich "
    "le la les de des du et en un une que qui dans est pour par sur pas au avec el los las del y que se con por su para no una al es".split()
)

#: Character classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 mark of a sentence, 6 shouting, 7 sign.
_CLASS = np.zeros(0x250, np.uint8)
for _i in range(len(_CLASS)):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:'\"()-" else 6 if _c in "!?" else 7 if _c.isprintable() and not _c.isalnum() else 0

STATISTICS = 16


def ratio(x: float) -> float:
    """Log odds of a share, kept finite."""
    return float(np.log((x + 1e-3) / (1 - x + 1e-3)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; null counts as empty."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = len(codes)
    kinds = np.bincount(_CLASS[codes[codes < len(_CLASS)]], minlength=8)
    other = n - kinds[1:].sum()
    letters = kinds[1] + kinds[2] + other
    words = text.split()
    m = len(words)
    share = lambda x, y: x / y if y else 0.0
    counts = Counter(words)
    low = text.lower().split()
    lines = [x for x in text.split("\n") if x.strip()]
    threes = len(set(zip(words, words[1:], words[2:], strict=False)))
    freq = np.unique(codes, return_counts=True)[1] / n if n else np.ones(1)
    return [
        np.log1p(n),
        np.log1p(share(n, m)),
        np.log1p(max(map(len, words), default=0)),
        ratio(share(kinds[2], letters)),
        ratio(share(kinds[3], n)),
        ratio(share(kinds[5], n)),
        ratio(share(kinds[6], n)),
        ratio(share(kinds[7], n)),
        ratio(share(text.count("|"), m + 1)),
        ratio(share(sum(not w[-1].isalnum() for w in words), m)),
        ratio(min(1.0, share(len(counts), m))),
        ratio(share(counts.most_common(1)[0][1] if counts else 0, m)),
        ratio(share(threes, max(1, m - 2))),
        ratio(share(len(lines) - len(set(lines)), len(lines))),
        ratio(share(sum(w in FUNCTION_WORDS for w in low), m)),
        float(-(freq * np.log2(freq)).sum()),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors, log-determinants with log-priors of the classes 0 and 1, and the calibration."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offset: list[float]
    slope: float
    level: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return squash(self.slope * soft(self.difference(x)) + self.level)

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        d = [o - 0.5 * (forward(low, z - mu) ** 2).sum(axis=1) for mu, low, o in zip(self.means, self.factors, self.offset, strict=True)]
        return d[1] - d[0]


def forward(low: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row solved against a lower triangular factor; the sum of squares is its Mahalanobis distance."""
    out = np.empty_like(rows)
    for i in range(len(low)):
        out[:, i] = (rows[:, i] - out[:, :i] @ low[i, :i]) / low[i, i]
    return out


def soft(d: np.ndarray) -> np.ndarray:
    """Compresses large differences, keeping their order."""
    return np.sign(d) * np.log1p(np.abs(d))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, towards_pooled: float = 0.5, towards_diagonal: float = 0.2) -> Discriminant:
    """Fits the discriminant; with fewer than two rows of a class the score is the smoothed share of class 1."""
    none = np.zeros(0)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(none, none, [], [], [], 0.0, 0.0, float((y == 1).sum() + 1) / (len(y) + 2))
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - shift) / scale
    groups = [z[y == c] for c in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    covs = [np.atleast_2d(np.cov(g, rowvar=False)) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / len(z)
    pooled = (1 - towards_diagonal) * pooled + towards_diagonal * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(shift))
    factors, offset = [], []
    for g, c in zip(groups, covs, strict=True):
        low = np.linalg.cholesky((1 - towards_pooled) * c + towards_pooled * pooled)
        factors.append(low)
        offset.append(float(np.log(len(g) / len(z)) - np.log(np.diag(low)).sum()))
    raw = Discriminant(shift, scale, means, factors, offset, 1.0, 0.0)
    f = soft(raw.difference(x))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a lightly penalised logistic curve
        p = squash(a * f + b)
        g = np.array([((p - y) * f).sum() + 1e-2 * a, (p - y).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * f * f).sum() + 1e-2, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Discriminant(shift, scale, means, factors, offset, max(float(a), 1e-3), float(b))


def _measure() -> Callable[[list], list[list]]:
    return lambda texts: [[statistics(t) for t in texts]]


def train(docs: DataFrame, labels: DataFrame, rows: int = 12_000) -> Discriminant:
    """Learns from ``labels`` (doc_id, quality) on the texts of ``docs`` (doc_id, text).

    A bounded sample: the documents of the ``rows`` label rows whose ids hash lowest. Labels that are
    null or neither 0 nor 1, and rows without id, don't count. Of an id with several labels the
    smallest counts. An id with several texts counts once, with the statistics that come first in
    order, so reruns give the same model. Null texts count as empty. Without labelled texts of both
    classes the model scores every text alike. What is broadcast and what comes to the driver is
    bounded by ``rows``. Other columns are not read.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64(F.col("labelled").cast("string")), "labelled", "quality").limit(rows)
    known = {}
    for r in sample.collect():
        known.setdefault(r["labelled"], r["quality"])
    if not known:
        return fit(np.zeros((0, STATISTICS)), np.zeros(0))
    picked = docs.sparkSession.createDataFrame([(i,) for i in known], "labelled bigint")
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled"))
    made = map_text(found, ["doc_id"], _measure, [("x", "array<double>", pa.list_(pa.float64()))]).groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    made.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in made]).reshape(-1, STATISTICS), np.array([known[r["doc_id"]] for r in made], float))


def score_quality(docs: DataFrame, model: Discriminant, keep: list[str] | None = None) -> DataFrame:
    """Quality of every whole text: the columns ``keep`` (doc_id) and ``quality_score`` (0 to 1).

    Null texts count as empty and are scored too; very long ones are read whole. Rows are independent:
    repeats get the same score, so ties are theirs, and other columns are not read. An empty table
    gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few matrices of 16 x 16

    def make() -> Callable[[list], list[list]]:
        m = shared.value
        return lambda texts: [m.score(np.array([statistics(t) for t in texts]).reshape(-1, STATISTICS)).tolist()]

    return map_text(docs, keep or ["doc_id"], make, [("quality_score", "double", pa.float64())])


def keep_quality(docs: DataFrame, model: Discriminant, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose quality score is ``least`` or more, with all their columns.

    Each row is judged by its own whole text, a null one as empty, so repeats stay or go together.
    Columns keep their names and values, whatever they are; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], list[bool]]:
        m = shared.value
        return lambda texts: (m.score(np.array([statistics(t) for t in texts]).reshape(-1, STATISTICS)) >= least).tolist()

    return keep_text(docs, make)
