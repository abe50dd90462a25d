"""Quality classifier: random Fourier features of text statistics, ridge scores, isotonic calibration.

Random Fourier features turn a Gaussian kernel over the statistics into a linear model. Each task sums its
normal equations over its rows, the sums are added up in a tree, and one small system is solved on the
driver; raw scores of rows that took no part in it are then counted in narrow bins, and pooling adjacent
bins gives a rising map from score to probability.

Inputs of a score are statistics of the text alone. Null and empty texts have statistics (zeros) too and get
the score these lead to. Labels of a repeated id count once, as bad if any of them says so; null ids and
null labels teach nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import id_remainder
from barwright.session import materialize

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER = np.zeros(256, bool)
_OTHER[33:127] = True
_OTHER &= ~(_UPPER | _LOWER | _DIGIT)
N_STATISTICS = 18


def statistics(text: str | None) -> list[float]:
    """Shape of a text: lengths, kinds of characters, repetition of words, word triples and lines."""
    raw = (text or "").encode()
    n = len(raw)
    words = raw.lower().split()
    if not words:
        return [0.0] * N_STATISTICS
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int32, m)
    triples = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, other = int(seen[_UPPER].sum()), int(seen[_OTHER].sum())
    letters = upper + int(seen[_LOWER].sum()) + int(seen[128:].sum())
    marks = [int(seen[ord(c)]) for c in "!|#$%&*.,"]
    return [
        math.log1p(n),
        math.log1p(m),
        float(lengths.mean()),
        float(lengths.std()),
        upper / n,
        int(seen[_DIGIT].sum()) / n,
        int(seen[_SPACE].sum()) / n,
        other / n,
        int(seen[128:].sum()) / n,
        upper / max(letters, 1),
        marks[0] / m,
        marks[1] / m,
        sum(marks[2:7]) / m,
        (marks[7] + marks[8]) / m,
        len(set(words)) / m,
        1 - triples / max(m - 2, 1) if m > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        m / len(lines) / 100,
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.array(statistics(t)) for t in batch])

    return run(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray  # statistics x features
    phases: np.ndarray
    weights: np.ndarray  # one more than features, the last is the constant
    steps: np.ndarray  # rising raw scores ...
    levels: np.ndarray  # ... and their probabilities

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.waves + self.phases) * math.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.levels), 0, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, N_STATISTICS))


def isotonic(scores: list[float], ones: list[float], counts: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Rising levels for rising scores: neighbours in the wrong order are pooled to their mean."""
    blocks: list[list[float]] = []  # first score, last score, ones, count
    for s, o, c in zip(scores, ones, counts):
        blocks.append([s, s, o, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs, ys = [], []
    for first, last, o, c in blocks:
        for x in (first, last) if last > first else (first,):
            xs.append(x)
            ys.append(o / c)
    return np.array(xs), np.array(ys)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, x, more ...): the statistics of every text, written once; what is joined later are numbers, not texts."""
    return materialize(docs.select(F.col(id_col).alias("id"), statistics_column(F.col(text_col)).alias("x"), *more), "statistics")


def fit(
    described: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    features: int = 256,
    width: float = 3.0,
    ridge: float = 1.0,
    max_rows: int = 2_000_000,
    seed: int = 7,
) -> Model | None:
    """Learns from all ``described`` rows with a label; None if there are none.

    ``max_rows`` bounds the labelled rows used (those of least id hash), and with them the tasks whose sums
    are added. A fifth of the rows, by id hash, calibrates and takes no part in the ridge fit.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg((F.min(label_col) > 0).cast("double").alias("y"))
    stats = materialize(described.join(known, "id").select("y", F.xxhash64("id").alias("h"), "x"), "labelled")
    n = stats.count()
    if not n:
        return None
    if n > max_rows:
        edge = stats.agg(F.percentile_approx("h", max_rows / n, 10000)).first()[0]
        stats = materialize(stats.where(F.col("h") <= edge), "statistics_bounded")
        n = stats.count()
    calibrates = F.pmod("h", F.lit(5)) == 0
    train, rest = stats.where(~calibrates), stats.where(calibrates)

    moments = train.agg(*[f(F.get("x", i)).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(N_STATISTICS)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(N_STATISTICS)])
    rng = np.random.default_rng(seed)
    waves = rng.normal(0, 1 / width, (N_STATISTICS, features))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), waves, rng.uniform(0, 2 * math.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            for i in range(0, len(batch), 4096):
                z = model.features(_matrix(batch["x"].iloc[i : i + 4096]))
                total += z.T @ np.hstack([z, batch["y"].to_numpy()[i : i + 4096, None]])
        yield pd.DataFrame({"task": [0], "s": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for batch in batches:
            total = total + sum(np.frombuffer(s) for s in batch["s"])
        yield pd.DataFrame({"task": [0], "s": [np.asarray(total, dtype=float).tobytes()]})

    schema = "task int, s binary"
    parts = max(1, min(64, n // 20_000))
    partial = train.repartition(parts).mapInPandas(sums, schema)
    partial = partial.repartition(max(1, math.isqrt(parts))).mapInPandas(add, schema)
    total = sum((np.frombuffer(r.s) for r in partial.collect() if len(r.s) > 8), np.zeros((features + 1) * (features + 2)))
    total = total.reshape(features + 1, features + 2)
    penalty = np.eye(features + 1) * ridge
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    @F.pandas_udf("double")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.raw(_matrix(batch)))

    bins = rest.select(F.round(raw("x"), 2).alias("s"), "y").groupBy("s").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    found = sorted((r.s, r.ones, r.n) for r in bins.collect())
    if found:
        model.steps, model.levels = isotonic(*map(list, zip(*found)))
    else:
        model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_column(model: Model | None, x: Column) -> Column:
    """Probability of a good text from its statistics; without a model every text gets one half."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(_matrix(batch)), dtype=float)

    return run(x)


def held_out_fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    return id_remainder(F.col(id_col), folds) == 0
