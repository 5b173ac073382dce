"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a vector of statistics over all of it. Cosines of random projections approximate a
Gaussian kernel on the standardised vectors; every partition sums its share of the normal equations,
the sums (a fixed size, whatever the rows) are added up and solved as ridge regression, and a
monotone step function fitted on a fold of its own turns raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, own_name

_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
_ENDS = np.frombuffer(b".!?", np.uint8)
_PUNCT = np.frombuffer(b".,;:!?'\"()-", np.uint8)
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "letters", "upper", "digits", "spaces", "punctuation", "symbols", "high_bytes",
    "ends", "exclaims", "word_variety", "top_word", "lines", "line_variety", "mean_line", "entropy", "symbol_words", "capital_words", "pipes", "commas", "top_line", "variety_scaled",
)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; null counts as empty, and empty texts have defined values."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    out = np.zeros(len(STATISTICS))
    if not n:
        return out
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    words = data.split()
    m = max(1, len(words))
    lower, upper = count[97:123].sum(), count[65:91].sum()
    letters = lower + upper + count[128:].sum()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    share = count[count > 0] / n
    last = [w[-1] for w in words]
    first = [w[0] for w in words]
    out[:] = (
        np.log1p(n), np.log1p(len(words)), sizes.mean() if len(words) else 0, (sizes > 12).sum() / m, (sizes <= 3).sum() / m,
        letters / n, upper / max(1.0, letters), count[48:58].sum() / n, (count[32] + count[9:14].sum()) / n, count[_PUNCT].sum() / n, count[_SYMBOLS].sum() / n, count[128:].sum() / n,
        count[_ENDS].sum() / m, count[33] / m, len(tally) / m, max(tally.values(), default=0) / m, np.log1p(k), len(seen) / k, np.log1p(n / k),
        float(-(share * np.log(share)).sum()), float(np.isin(last, _SYMBOLS).sum()) / m, float(((np.array(first, np.int64) >= 65) & (np.array(first, np.int64) <= 90)).sum()) / m,
        count[124] / m, count[44] / m, max(seen.values(), default=0) / k, len(tally) / m**0.8,
    )
    return out


def with_statistics(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "stats") -> DataFrame:
    """keep columns and stats array<double> (under name), one row per row.

    A null text counts as empty; empty texts have statistics of 0, repeated rows each have theirs, an empty
    table gives no rows. name must not be one of keep; columns that keep doesn't name are ignored.
    """

    @F.pandas_udf("array<double>")
    def measure(column: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in column])

    return docs.select(*[F.col(f"`{c}`") for c in keep], measure(F.col(f"`{text}`")).alias(name))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  #: raw scores at which the calibration is given
    levels: np.ndarray  #: its values there, not decreasing

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return _features((stats - self.mean) / self.scale, self.projection, self.phase) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.levels[0])
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def _features(x: np.ndarray, projection: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    z = np.cos(np.clip(x, -8, 8) @ projection + phase) * np.sqrt(2 / len(phase))
    return np.concatenate([z, np.ones((len(x), 1))], 1)


FAN_IN = 64  #: partial sums that one task adds up


def _summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """Sum over all rows of partial(stats, label), a vector of fixed size: by partition, then in two levels of FAN_IN."""

    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for frame in frames:
            if len(frame):
                total += partial(np.stack(frame["stats"].to_list()), frame["label"].to_numpy(float))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() // FAN_IN], "sums": [total.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for b in frame["sums"]:
            total += np.frombuffer(b)
        return pd.DataFrame({"part": frame["part"].iloc[:1] // FAN_IN, "sums": [total.tobytes()]})

    parts = rows.mapInPandas(per_partition, "part int, sums binary")
    for _ in range(2):
        parts = parts.groupBy("part").applyInPandas(add, "part int, sums binary")
    total = np.zeros(size)
    for r in parts.collect():
        total += np.frombuffer(r["sums"])
    return total


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over x in ascending order; centres and values of the blocks."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fold(ident: Column) -> Column:
    """0 to 4 by checksum of the identifier; fold 0 is held out."""
    return F.pmod(F.crc32(F.encode(F.coalesce(ident.cast("string"), F.lit("")), "UTF-8")), F.lit(5))


def fit(measured: DataFrame, labels: DataFrame, *, ident: str = "doc_id", label: str = "quality", features: int = 256, width: float = 0.5, ridge: float = 1e-4, seed: int = 8) -> Model:
    """Fit on the labelled rows of measured (ident, stats) outside fold 0; fold 1 calibrates, folds 2 to 4 fit.

    All labelled rows are used, no sample. Null labels and labels of unknown rows are left out; several
    labels of one identifier count as their mean. Without any label the model scores 0.5 everywhere.
    What reaches the driver are sums of a size set by `features` and at most 2,001 calibration bins.
    """
    truth = labels.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{label}`").cast("double").alias("label")).where("label is not null and ident is not null").groupBy("ident").agg(F.avg("label").alias("label"))
    rows = measured.select(F.col(f"`{ident}`").alias("ident"), "stats").where(fold(F.col("ident")) != 0).join(truth, "ident")
    rows = materialise(rows.select(fold(F.col("ident")).alias("fold"), "stats", "label"), "quality-train")
    fitting = rows.where("fold <> 1")
    d = len(STATISTICS)
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = moments[0]
    empty = np.empty(0)
    if n == 0:
        return Model(np.zeros(d), np.ones(d), np.empty((d, 0)), empty, empty, np.zeros(1), np.full(1, 0.5))
    mean = moments[1 : d + 1] / n
    scale = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    draw = np.random.default_rng(seed)
    projection, phase = draw.normal(0, width / np.sqrt(d), (d, features)), draw.uniform(0, 2 * np.pi, features)
    size = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _features((x - mean) / scale, projection, phase)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    sums = _summed(fitting, normal, size * size + size + 1)
    gram, right, m = sums[: size * size].reshape(size, size), sums[size * size : -1], sums[-1]
    penalty = ridge * max(m, 1.0) * np.eye(size) / size
    weights = np.linalg.solve(gram + penalty, right) if m else np.zeros(size)
    model = Model(mean, scale, projection, phase, weights, empty, empty)

    @F.pandas_udf("double")
    def raw(column: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.stack(column.to_list())) if len(column) else [], dtype=float)

    calibrating = rows.where("fold = 1") if not rows.where("fold = 1").isEmpty() else rows
    binned = calibrating.select(F.round(F.least(F.greatest(raw("stats"), F.lit(-0.5)), F.lit(1.5)), 3).alias("x"), "label").groupBy("x").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("w")).orderBy("x").toPandas()
    model.knots, model.levels = isotonic(binned["x"].to_numpy(float), binned["y"].to_numpy(float), binned["w"].to_numpy(float))
    return model


def score_of(model: Model, stats: Column) -> Column:
    """Score (0 to 1) of a column of statistics; equal statistics have equal scores."""

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(column.to_list())) if len(column) else [], dtype=float)

    return score(stats)


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """measured (with stats) and a column score; every row has one, those of empty and null texts too."""
    return measured.withColumn("score", score_of(model, F.col("stats")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float, *, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of docs that score at least `least`, with all columns; the model is fitted on their labels.

    The statistics are measured once and stored beside the rows, so no text is shuffled. Rows without a
    label are scored like all others; null and empty texts have the score of empty ones; repeated rows
    fare alike; without labels every score is 0.5. An empty table gives no rows.
    """
    stats = own_name(docs, "stats")
    measured = materialise(with_statistics(docs, text=text, keep=tuple(docs.columns), name=stats), "quality-stats")
    model = fit(measured.select(F.col(f"`{ident}`"), F.col(stats).alias("stats")), labels, ident=ident)
    return measured.where(score_of(model, F.col(stats)) >= least).drop(stats)
