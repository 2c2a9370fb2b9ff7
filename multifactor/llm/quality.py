"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.llm.common import encoded, quoted, stored, with_results

#: Random Fourier features; the normal equations have so many rows.
FEATURES = 256
#: Bins of ridge scores in which labels are counted for the calibration.
BINS = 2048
#: Labelled rows used for the fit at most, by a hash of their text. Far more than the features need.
FIT_ROWS = 4_000_000

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "other_script": range(128, 192), "space": [32, 9, 11, 12, 13],
    "newline": [10], "stop": b".,;:", "mark": b"!?", "pipe": b"|", "sign": b"#$%&*@^~=+<>_\\/", "quote": b"'\"`-()[]{}",
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _of in enumerate(_CLASSES.values()):
    _TABLE[list(_of), _i] = 1

STATISTICS = len(_CLASSES) + 13


def statistics(text: bytes) -> list[float]:
    """Figures of a whole text: shares of character classes, sizes of words and lines, and repetition."""
    n = max(1, len(text))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    different = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = [len(x) for x in lines] or [0]
    return [
        *np.sqrt(shares), np.log1p(len(words)), np.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log1p(sizes.max()), different / w, np.log(w / max(1, different)),
        pairs / max(1, w - 1), np.log1p(len(lines)), np.log1p(np.mean(lengths)), np.log1p(np.std(lengths)), len(set(lines)) / max(1, len(lines)), float((sizes <= 3).sum() / w),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def text_statistics(texts: pd.Series) -> pd.Series:
    """``statistics`` of each text; a null text counts as empty."""
    return pd.Series([statistics(t) for t in encoded(texts)], dtype=object)


@dataclass(frozen=True)
class QualityModel:
    """Scaling of the statistics, the random features, the ridge weights, and the calibration's points."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    points: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.points, self.levels), 0.0, 1.0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), STATISTICS)


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Rising shares that fit positives among totals best: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for t, p in zip(total, positive, strict=True):
        blocks.append([t, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            t2, p2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + p2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), p / t) for t, p, n in blocks])


def fit_quality(rows: DataFrame, *, ridge: float = 1e-3, seed: int = 42) -> QualityModel:
    """Fit on ``rows``: ``statistics`` (array) and ``label`` (0 or 1); rows with another label or none are passed over.

    Means, the normal equations of the random features, and the calibration's counts are summed in each partition and
    then by Spark; the driver solves one system of FEATURES + 1 unknowns. Without both labels every score is the share
    of ones (or one half without any). Repeated rows count each; an empty table has no ones and no others.
    """
    spark = rows.sparkSession
    rows = rows.where("label in (0, 1) and statistics is not null")
    count = rows.count()
    if count > FIT_ROWS:  # the documented bound, by a hash, so that it is the same in every run
        rows = rows.where(F.pmod(F.xxhash64("statistics"), F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / count))
    columns = [F.col("statistics")[i] for i in range(STATISTICS)]
    totals = rows.agg(F.count("*"), F.sum("label"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    n, positive = totals[0], totals[1] or 0
    rng = np.random.default_rng(seed)
    start = QualityModel(
        np.array([x or 0.0 for x in totals[2 : 2 + STATISTICS]]), np.array([max(x or 0.0, 1e-6) for x in totals[2 + STATISTICS :]]),
        rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(2 * STATISTICS), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([positive / n if n else 0.5]),
    )
    if not 0 < positive < n:
        return start
    sent = spark.sparkContext.broadcast(start)
    weigh = {0: n / (2 * (n - positive)), 1: n / (2 * positive)}

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, y = sent.value.features(_matrix(batch["statistics"])), batch["label"].to_numpy(np.float64)
            w = np.where(y == 1, weigh[1], weigh[0])
            held[:, :-1] += (z * w[:, None]).T @ z
            held[:, -1] += z.T @ (y * w)
        yield pd.DataFrame({"line": np.arange(FEATURES + 1), "part": list(held)})

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": parts["line"][:1], "part": [np.sum(parts["part"].tolist(), axis=0)]})

    parts = rows.select("statistics", F.col("label").cast("int").alias("label")).coalesce(256).mapInPandas(equations, "line int, part array<double>")
    system = np.array([r.part for r in sorted(parts.groupBy("line").applyInPandas(added, "line int, part array<double>").collect(), key=lambda r: r.line)])
    weights = np.linalg.solve(system[:, :-1] + ridge * n * np.eye(FEATURES + 1) / FEATURES, system[:, -1])
    fitted = QualityModel(start.mean, start.scale, start.directions, start.phases, weights, start.points, start.levels)
    sent_fitted = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def raw(column: pd.Series) -> pd.Series:
        m = sent_fitted.value
        return pd.Series(m.features(_matrix(column)) @ m.weights)

    binned = rows.select("label", F.least(F.greatest(raw("statistics"), F.lit(-1.0)), F.lit(2.0)).alias("r"))
    binned = binned.groupBy(F.floor((F.col("r") + 1) * (BINS / 3)).alias("bin")).agg(F.avg("r").alias("r"), F.count("*").alias("n"), F.sum("label").alias("positive"))
    found = sorted(binned.collect(), key=lambda r: r.bin)  # at most BINS + 1 rows
    levels = isotonic(np.array([r.n for r in found], float) + 1e-9, np.array([r.positive for r in found], float))
    points = np.array([r.r for r in found])
    # a slope of a thousandth keeps apart what the calibration's steps hold equal
    return QualityModel(start.mean, start.scale, start.directions, start.phases, weights, np.concatenate([[-2.0], points, [3.0]]), 0.999 * np.concatenate([levels[:1], levels, levels[-1:]]) + 0.001 * np.concatenate([[0], (points + 2) / 5, [1]]))


def with_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Stored rows: ``row`` (struct of all columns but the text) and ``statistics`` of the whole text.

    Null and empty texts have the statistics of no words; repeated rows each get theirs; an empty table gives none.
    """
    return stored(docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text]).alias("row"), text_statistics(F.col(quoted(text))).alias("statistics")))


def scored(rows: DataFrame, model: QualityModel, statistics_column: str = "statistics") -> DataFrame:
    """``rows`` with ``score``: the calibrated quality of each row's statistics, 0 to 1.

    Null and empty texts have statistics and a score too; repeated rows get equal scores; an empty table gives none. A
    column of ``rows`` that is called score itself stays as score_.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(_matrix(column)))

    return with_results(rows, score=score(F.col(quoted(statistics_column))))
