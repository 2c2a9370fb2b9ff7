"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multifactor.llm.common import quoted, with_results

#: Hashed features, whatever the corpus: the broadcast matrix has so many rows and one column for each language.
FEATURES = 1 << 15
#: Character n-grams of these lengths.
GRAMS = (1, 2, 3)
#: The most languages that one model holds; it bounds the broadcast to FEATURES * MOST_LANGUAGES floats.
MOST_LANGUAGES = 512
#: Characters scored at once.
CHUNK = 1 << 18

_MIX = np.uint32(0x9E3779B1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)


def _pieces(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of several texts together and the text of each, in pieces that overlap so that no n-gram is lost."""
    held, owner, total = [], [], 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        codes = _codes(text)
        for at in range(0, len(codes), CHUNK):
            part = codes[max(0, at - max(GRAMS) + 1) : at + CHUNK]
            held.append((part, at > 0))
            owner.append(i)
            total += len(part)
            if total >= CHUNK:
                yield held, owner
                held, owner, total = [], [], 0
    if held:
        yield held, owner


def _features(held: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of pieces of text, and the piece of each. A piece that goes on from another starts at the overlap."""
    codes = np.concatenate([p for p, _ in held])
    sizes = np.array([len(p) for p, _ in held])
    piece = np.repeat(np.arange(len(held)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fresh = np.repeat(np.array([max(GRAMS) - 1 if on else 0 for _, on in held]), sizes)
    out, owners = [], []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        # the gram of n characters that ends here: the shorter one that ended a character before, and this character
        h = (np.concatenate([np.zeros(1, np.uint32), h[:-1]]) if n > 1 else h) * np.uint32(0x85EBCA6B) + codes + np.uint32(n)
        if n in GRAMS:
            valid = (place >= n - 1) & (place >= fresh)
            mixed = h[valid] * _MIX
            mixed ^= mixed >> np.uint32(15)
            out.append((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - FEATURES.bit_length() + 1))
            owners.append(piece[valid])
    return np.concatenate(out), np.concatenate(owners)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].to_numpy()
        for held, owner in _pieces(batch["text"]):
            features, piece = _features(held)
            of = np.array([langs[i] for i in owner])
            for lang in set(of.tolist()):
                mine = np.isin(piece, np.flatnonzero(of == lang))
                counts.setdefault(lang, np.zeros(FEATURES, np.int64))
                counts[lang] += np.bincount(features[mine], minlength=FEATURES)
    for lang, found in counts.items():
        at = np.flatnonzero(found)
        yield pd.DataFrame({"lang": lang, "feature": at.astype("int32"), "n": found[at]})


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and each feature's log-probability in each (FEATURES rows)."""

    languages: list[str]
    log_prior: np.ndarray
    log_probability: np.ndarray


def fit_language_model(docs: DataFrame, *, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Count hashed n-grams by language over all rows that have both text and language.

    Each task counts into a fixed number of features; Spark sums the counts. Only the summed table, of at most FEATURES
    rows a language, reaches the driver. Priors are equal. Repeated rows count each; texts without a letter count their
    other characters; an empty table gives a model of no language; other columns are not read.
    """
    rows = docs.select(F.col(quoted(text)).alias("text"), F.col(quoted(lang)).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInPandas(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list("feature").alias("features"), F.collect_list("n").alias("counts")).orderBy("lang")
    languages, columns = [], []
    for row in by_lang.toLocalIterator():
        if len(languages) >= MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        column = np.full(FEATURES, smoothing)
        column[row.features] += row.counts
        languages.append(row.lang)
        columns.append(np.log(column / column.sum()))
    table = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((FEATURES, 0), np.float32)
    return LanguageModel(languages, np.full(len(languages), -np.log(max(1, len(languages)))), table)


def predict_language(docs: DataFrame, model: LanguageModel, text: Column) -> DataFrame:
    """``docs`` with a struct column ``language_prediction`` (lang, score): the likeliest language of the whole text.

    The score is the language's posterior probability. A text that is null or has no letter gets ``und`` and 0; so does
    every text if the model has learned no language. Equal texts get equal results, ties go to the first language by
    name, and an empty table gives none. Long texts are scored piece by piece; rows are never moved. A column of ``docs``
    that is called language_prediction itself stays as language_prediction_.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        sums = np.tile(m.log_prior, (len(texts), 1)).astype(np.float64)
        if m.languages:
            for held, owner in _pieces(texts):
                features, piece = _features(held)
                for j in range(len(m.languages)):
                    got = np.bincount(piece, weights=m.log_probability[features, j], minlength=len(held))
                    np.add.at(sums[:, j], owner, got)
        lettered = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in texts], dtype=bool) & bool(m.languages)
        if not m.languages:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0})
        best = sums.argmax(axis=1)
        weight = np.exp(sums - sums.max(axis=1, keepdims=True))
        score = weight.max(axis=1) / weight.sum(axis=1)
        return pd.DataFrame({"lang": np.where(lettered, np.array(m.languages, dtype=object)[best], "und"), "score": np.where(lettered, score, 0.0)})

    return with_results(docs, language_prediction=predict(text))
