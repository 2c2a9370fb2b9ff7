"""Toxic passages by maximum-scoring segments of word log-odds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.llm.common import encoded, hashed_words, in_chunks, quoted, stored

#: Hashed words; the model has one score for each, whatever the corpus.
WORDS = 1 << 20
#: Labelled rows that a fit takes at most (see common.bounded_labels); so labels can be sent to where the texts lie.
FIT_ROWS = 200_000
#: Beginnings of words, in bytes, that have scores of their own.
PREFIXES = (5, 6, 7, 9)
#: Bins of word scores from -1 to 8.
BINS = 901
#: Bins of segment scores in each unit of score, and the share of clean segments by whose score the level is fitted.
SEGMENT_BINS, TAIL = 8, 0.01
#: Parts of the labelled rows: the curve is fitted on figures of rows that the word scores have not seen.
FOLDS = 3
#: Bytes of text that are worked on at once, and slots that a task hands over at once.
CHUNK, PIECE = 1 << 20, 1 << 16


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (WORDS.bit_length() - 1))).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents and, by slot, documents with the slot (-1: all), a column for each part and label."""
    kinds = 2 * FOLDS
    counts, documents = np.zeros((kinds, WORDS), np.int32), np.zeros(kinds, np.int64)
    for batch in batches:
        texts, kind = encoded(batch["text"]), (2 * batch["fold"] + batch["label"]).to_numpy(np.int64)
        documents += np.bincount(kind, minlength=kinds)
        for a, b in in_chunks(texts, CHUNK):
            hashes, _, _, before = hashed_words(texts[a:b], PREFIXES)
            of = np.repeat(np.arange(b - a), np.diff(before))
            once = np.unique(of[None, :] * WORDS + _slots(hashes))  # a document counts once for each slot
            of_kind = kind[a:b][once // WORDS]
            for k in set(of_kind.tolist()):
                counts[k] += np.bincount(once[of_kind == k] % WORDS, minlength=WORDS).astype(np.int32)
    yield pd.DataFrame({"slot": np.array([-1], np.int32)} | {f"n{k}": documents[k : k + 1] for k in range(kinds)})
    at = np.flatnonzero(counts.any(axis=0))
    for i in range(0, len(at), PIECE):
        some = at[i : i + PIECE]
        yield pd.DataFrame({"slot": some.astype(np.int32)} | {f"n{k}": counts[k, some].astype(np.int64) for k in range(kinds)})


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents (part, label) and documents with each slot (part, label, slot) of ``rows`` (text, label, fold); one row a slot reaches the driver."""
    kinds = [f"n{k}" for k in range(2 * FOLDS)]
    sums = rows.select("text", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold")).mapInPandas(_count, f"slot int, {', '.join(f'{n} long' for n in kinds)}")
    table = sums.groupBy("slot").agg(*[F.sum(n).cast("int").alias(n) for n in kinds]).toArrow()
    slot, documents, counts = table["slot"].to_numpy(), np.zeros(2 * FOLDS), np.zeros((2 * FOLDS, WORDS), np.int32)
    for k, n in enumerate(kinds):
        found = table[n].to_numpy()
        documents[k] = found[slot < 0].sum()
        counts[k, slot[slot >= 0]] = found[slot >= 0]
    return documents.reshape(FOLDS, 2), counts.reshape(FOLDS, 2, WORDS)


def _log_odds(documents: np.ndarray, counts: np.ndarray, prior: float, caution: float, drift: float) -> np.ndarray:
    """Each slot's score from clean and toxic documents and documents with the slot; ``drift`` below 0 without both labels."""
    if not documents.all():
        return np.full(WORDS, -drift, np.float32)
    alpha = prior * counts.sum(axis=0) + 1e-9
    (y0, y1), (n0, n1) = counts + alpha, documents + prior * documents.sum()
    odds = np.log(y1 / np.maximum(n1 - y1, 0.5)) - np.log(y0 / np.maximum(n0 - y0, 0.5))
    return (odds - caution * np.sqrt(1 / y1 + 1 / y0) - drift).clip(-1.0, 8.0).astype(np.float32)


@dataclass(frozen=True)
class WordScores:
    """Each slot's score, and the extreme-value constants of clean text's maximal segments."""

    scores: np.ndarray
    decay: float = 1.0
    level: float = 0.1

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The score of each word: the largest of its own and its prefixes'."""
        return self.scores[_slots(hashes)].max(axis=0)

    def surprise(self, score, words):
        """-ln of how many segments of at least this score clean text of so many words holds by chance; at least 0."""
        return np.maximum(self.decay * score - np.log(self.level * max(words, 1)), 0.0)


def fit_word_scores(rows: DataFrame, *, prior: float = 0.01, caution: float = 1.0, drift: float = 0.5) -> WordScores:
    """Score words from ``rows``: ``text`` and ``label`` (1 toxic, 0 clean); other rows are passed over.

    A word (or its beginning, for words not seen before) has as score the log-odds of standing in a toxic against a
    clean document. Both counts have a Dirichlet prior, dealt as in all ``rows`` and as heavy as the share ``prior`` of
    them; ``caution`` standard errors and ``drift`` are taken off, so that rare and ordinary words count against a
    passage. The extreme-value constants come from the clean documents among ``rows``: ``decay`` is the positive root of
    E[exp(decay * score)] = 1 over their words (Karlin and Altschul), ``level`` is fitted to their maximal segments.
    All counts are over ``rows``, which op4 bounds by FIT_ROWS. Repeated rows count each. Spark sums the counts of WORDS
    slots; no list of words reaches the driver.
    """
    rows = rows.where("label in (0, 1)").select("text", "label", F.lit(0).alias("fold"))
    documents, counts = _counted(rows)
    return _with_extremes(rows, _log_odds(documents.sum(axis=0), counts.sum(axis=0), prior, caution, drift))


def _with_extremes(rows: DataFrame, scores: np.ndarray) -> WordScores:
    """The model of ``scores`` with the extreme-value constants of the clean texts of ``rows``."""
    sent = rows.sparkSession.sparkContext.broadcast(WordScores(scores))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, segments = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            texts = encoded(batch["text"])
            for a, b in in_chunks(texts, CHUNK):
                hashes, _, _, before = hashed_words(texts[a:b], PREFIXES)
                got = sent.value.of(hashes)
                words += np.bincount(((got + 1.0) * (BINS - 1) / 9.0).astype(np.int64), minlength=BINS)
                for lo, hi in zip(before, before[1:], strict=False):
                    best = np.array([s for *_, s in best_segments(got[lo:hi])])
                    segments += np.bincount(np.minimum(best * SEGMENT_BINS, BINS - 1).astype(np.int64), minlength=BINS)
        yield pd.DataFrame({"bin": np.arange(BINS), "words": words, "segments": segments})

    sums = rows.where("label = 0").select("text").mapInPandas(spread, "bin int, words long, segments long").groupBy("bin").agg(F.sum("words").alias("words"), F.sum("segments").alias("segments"))
    bins = sums.toPandas().sort_values("bin")
    n_words = max(1, bins["words"].sum())
    value, share = bins["bin"].to_numpy() * 9.0 / (BINS - 1) - 1.0, bins["words"].to_numpy() / n_words
    low, high = 1e-3, 4.0
    for _ in range(60):  # the sum is convex in the decay and 1 at 0; bisect for its other root
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * value)).sum() < 1 else (low, mid)
    return WordScores(scores, low, extreme_level(bins["segments"].to_numpy(), low, n_words))


def extreme_level(segments: np.ndarray, decay: float, words: int) -> float:
    """The level at which level * words * exp(-decay * score) is the number of clean segments that reach the tail's score.

    ``segments`` counts the maximal segments of clean text by score, in bins of 1 / SEGMENT_BINS. The tail's score is the
    greatest that the share TAIL of them reach: few mislabelled texts lie beyond it. Without segments the level is 1 / words.
    """
    reached = np.cumsum(segments[::-1])[::-1]
    if not len(reached) or not reached[0]:
        return 1.0 / max(1, words)
    at = int(np.flatnonzero(reached >= TAIL * reached[0])[-1])
    return float(reached[at] / max(1, words) * np.exp(decay * at / SEGMENT_BINS))


def best_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after, score), by the linear-time scan of Ruzzo and Tompa.

    Words without a positive score are passed in runs; the scan steps once for each run of positive words. Each held
    segment knows the nearest one before it with a smaller sum to its left, so a search leaps over all that an earlier
    search has passed, and no segment is passed twice.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    starts = at[np.concatenate([[True], np.diff(at) > 1])]
    ends = at[np.concatenate([np.diff(at) > 1, [True]])] + 1
    held: list[tuple[int, int, float, float, int]] = []  # first, after, sum before, sum after, nearest with a smaller sum before
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        left, right = total[a], total[b]
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((a, b, left, right, j))
                break
            a, _, left, _, nearest = held[j]
            del held[j:]
            j = nearest
    return [(a, b, right - left) for a, b, left, right, _ in held]


PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


def toxic_passages(docs: DataFrame, model: WordScores, *, text: str = "text", significance: float = 0.01) -> DataFrame:
    """Every significant toxic passage of every whole text: ``row`` (all columns but the text), ``words``, ``surprise``, ``passages``.

    A passage (start, end in code points, end exclusive; score) is a maximal scoring segment; it is significant if
    clean text as long holds at most ``significance`` such by chance (``expected``). ``surprise`` adds
    -ln(expected) over all segments expected less than once: the document's figure.

    Null, empty and wordless texts have no passage and surprise 0; repeated rows each get a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("words", T.LongType()), T.StructField("surprise", T.DoubleType()), T.StructField("best", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("passages", PASSAGE)])

    @F.pandas_udf(out)
    def find(column: pd.Series) -> pd.DataFrame:
        m, texts, rows = sent.value, encoded(column), []
        for a, b in in_chunks(texts, CHUNK):
            hashes, first, after, before = hashed_words(texts[a:b], PREFIXES)
            scores = m.of(hashes)
            for i, raw in enumerate(texts[a:b]):
                lo, hi = before[i], before[i + 1]
                segments = best_segments(scores[lo:hi])
                surprises = m.surprise(np.array([s for *_, s in segments]), hi - lo)
                surprise = float(surprises.sum())
                best = max((s for *_, s in segments), default=0.0)
                mean = float(scores[lo:hi].mean()) if hi > lo else 0.0
                found = []
                for (x, y, s), e in zip(segments, np.exp(-surprises).tolist(), strict=True):
                    if e <= significance:
                        begin, end = first[lo + x], after[lo + y - 1]
                        skipped = len(raw[:begin].decode("utf-8", "replace"))
                        found.append({"start": skipped, "end": skipped + len(raw[begin:end].decode("utf-8", "replace")), "score": float(s), "expected": e})
                rows.append((int(hi - lo), surprise, float(best), mean, found))
        return pd.DataFrame(rows, columns=["words", "surprise", "best", "mean", "passages"])

    found = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text]).alias("row"), find(F.col(quoted(text))).alias("f"))
    return stored(found.select("row", "f.*"))


def fit(rows: DataFrame, *, key: str = "doc_id", prior: float = 0.01, caution: float = 1.0, drift: float = 0.5) -> tuple[WordScores, list[float]]:
    """Word scores (see ``fit_word_scores``) and the weights of the probability from labelled ``rows`` (key, text, label).

    The scores are learned on all rows. The curve is fitted on each part of the rows, by a seeded hash of the key, with
    figures by the scores that the other parts give, so it does not take words for granted that only one text has. One
    pass counts all parts; each part's scores come from the sums without its own counts.
    """
    part = F.pmod(F.xxhash64(F.lit(5), F.col(quoted(key))), F.lit(FOLDS)).cast("int")
    rows = stored(rows.where("label in (0, 1)").select(part.alias("fold"), "text", "label"))
    documents, counts = _counted(rows)
    all_documents, all_counts, seen = documents.sum(axis=0), counts.sum(axis=0), None
    model = _with_extremes(rows, _log_odds(all_documents, all_counts, prior, caution, drift))
    for fold in range(FOLDS):
        others = _log_odds(all_documents - documents[fold], all_counts - counts[fold], prior, caution, drift)
        found = toxic_passages(rows.where(F.col("fold") == fold), WordScores(others, model.decay, model.level))
        seen = found if seen is None else seen.unionByName(found)
    return model, fit_probability(seen.withColumn("label", F.col("row.label")))


def fit_probability(rows: DataFrame, *, steps: int = 30) -> list[float]:
    """Weights of a logistic curve (constant, ln(1 + surprise), best segment, mean score) from rows with ``label``.

    Newton steps; each sums gradient and curvature over all rows in Spark. Without both labels: the share of ones.
    Repeated rows count each; an empty table gives a share of 1e-6.
    """
    x = [F.lit(1.0), *_figures()]
    k = len(x)
    rows = rows.where("label in (0, 1)").select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.col("label").cast("double").alias("y"))
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < positive < n:
        p = min(max((positive or 0.0) / n if n else 0.0, 1e-6), 1 - 1e-6)
        return [float(np.log(p / (1 - p))), *[0.0] * (k - 1)]
    rows, w = stored(rows), np.zeros(k)
    w[0] = np.log(positive / (n - positive))
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((F.col(f"x{i}") * float(w[i]) for i in range(k)), F.lit(0.0))))
        s = rows.withColumn("p", p).agg(*[F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(k)], *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(k)]).first()
        ridge = np.diag([0.0, *[1e-3] * (k - 1)])
        move = np.linalg.solve(np.array(s[k:]).reshape(k, k) + ridge + 1e-9 * np.eye(k), np.array(s[:k]) - ridge @ w)
        w = w + move * min(1.0, 3.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-4:
            break
    return [float(v) for v in w]


def _figures():
    return [F.log1p("surprise"), F.col("best") / 4, F.col("mean")]


def probability(weights: list[float]):
    """The probability that a row of ``toxic_passages`` is toxic, by the fitted curve."""
    return 1 / (1 + F.exp(-sum((c * w for c, w in zip(_figures(), weights[1:], strict=True)), F.lit(weights[0]))))
