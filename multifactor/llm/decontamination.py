"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.llm.common import quoted

#: Edits allowed for each character of a test item.
ERROR_RATE = 0.1
#: Characters of test items that are matched in one pass over the documents.
BLOCK_CHARS = 8_000_000


def normalized(text: str | None) -> str:
    """Lower case, with single spaces between words."""
    return " ".join((text or "").lower().split())


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """``errors`` + 1 pieces of nearly equal length: with at most ``errors`` edits, one is left whole."""
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def places(pattern: str) -> dict[str, int]:
    """Bits of the places where each character stands in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(pattern: str, text: str, enough: int = -1, occurs: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends.

    Myers' bit-parallel recurrence over one column of the distance table, held in one integer. Stops at a distance of
    ``enough`` or less.
    """
    m = len(pattern)
    occurs = places(pattern) if occurs is None else occurs
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = occurs.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
            if distance < best:
                best, end = distance, j + 1
                if best <= enough:
                    break
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
    return best, end


class Node:
    """Neighbouring pieces of an item; with as many edits as pieces or more, the item's match need not hold them."""

    def __init__(self, item: str, cuts: list[tuple[int, int]], first: int, after: int):
        self.a, self.b, self.errors = cuts[first][0], cuts[after - 1][1], after - first - 1
        self.text = item[self.a : self.b]
        self.occurs = places(self.text)

    def near(self, low: str, begin: int) -> bool:
        """Do these pieces stand in the text, with fewer edits than pieces, where the item would begin at ``begin``?"""
        window = low[max(0, begin + self.a - self.errors) : max(0, begin + self.b + self.errors)]
        return best_match(self.text, window, self.errors, self.occurs)[0] <= self.errors


def _paths(item: str, cuts: list[tuple[int, int]], first: int, after: int, above: list[Node], out: list) -> None:
    """For each piece, in order: its parents from the smallest to the one below the whole item, and its sibling piece."""
    if after - first == 1:
        return
    mid = first + (1 << (after - first - 1).bit_length() - 1)  # a power of two on the left, so that most pieces have a sibling
    for x, y, other in ((first, mid, (mid, after)), (mid, after, (first, mid))):
        if y - x == 1:
            sibling = cuts[other[0]] if other[1] - other[0] == 1 else None
            out.append((cuts[x], above, sibling))
        else:
            _paths(item, cuts, x, y, [Node(item, cuts, x, y), *above], out)


class Matcher:
    """Finds test items in texts; built once in each Python worker from (item id, normalized text) pairs.

    An exact hit of a piece is checked from the bottom up: if an item is found with e edits, then in a tree over its
    e + 1 pieces some path from the root holds at every node fewer edits than pieces. So a hit counts only if each
    node above its piece is near its place; most fail at the first, which is short.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, math.floor(rate * len(t))) for i, t in items if t]
        held: dict[str, list] = {}
        for n, (_, t, errors) in enumerate(self.items):
            cuts = pieces(len(t), errors)
            found: list = [(cuts[0], [], None)] if errors == 0 else []
            _paths(t, cuts, 0, len(cuts), [], found)
            for (a, b), above, sibling in found:
                # a sibling piece with one edit at most keeps one of its halves whole
                halves = None
                if sibling is not None and above:
                    c, d = sibling
                    mid = (c + d) // 2
                    halves = ((t[c:mid], c), (t[mid:d], mid))
                held.setdefault(t[a:b], []).append((n, a, above, halves))
        self.automaton = ahocorasick.Automaton()
        for piece, where in held.items():
            self.automaton.add_word(piece, (len(piece), where))
        if held:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalized text) of each item within its errors, best first occurrence."""
        low = normalized(text)
        windows: dict[int, list[list[int]]] = {}
        if low and len(self.automaton):
            for last, (length, where) in self.automaton.iter(low):
                for n, at, above, halves in where:
                    begin = last + 1 - length - at
                    if halves is not None and not any(low.find(h, max(0, begin + c - 1), max(0, begin + c + len(h) + 1)) >= 0 for h, c in halves):
                        continue
                    if not all(node.near(low, begin) for node in above):
                        continue
                    _, t, errors = self.items[n]
                    a, b = max(0, begin - errors), begin + len(t) + errors
                    spans = windows.setdefault(n, [])
                    if spans and a <= spans[-1][1]:
                        spans[-1][0], spans[-1][1] = min(a, spans[-1][0]), max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
        found = []
        for n, spans in windows.items():
            item, t, errors = self.items[n]
            best, end = min((d, a + e) for a, b in spans for d, e in [best_match(t, low[a:b])])
            if best <= errors:
                found.append((item, best, end))
        return found


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of about BLOCK_CHARS characters, read block by block."""
    items = benchmark.select(F.col(quoted(item)).alias("item"), F.col(quoted(text)).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    for i in range(n):
        yield [(r.item, normalized(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).toLocalIterator()]


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    error_rate: float = ERROR_RATE,
) -> DataFrame:
    """(doc_id, item_id, distance, match_end) of every test item found in a document.

    An item of m normalized characters is found where some part of the normalized text is at most
    floor(``error_rate`` * m) edits from it. The item's errors + 1 pieces are looked up in one automaton; around each
    exact piece hit Myers' distance decides. Documents are scanned where they lie, without a shuffle; test items are
    broadcast in blocks of bounded size, one pass each.

    Null, empty and blank texts and items match nothing; repeated rows and items match each; extra columns are not read,
    whatever their names; an empty table matches nothing. Items of fewer than 1 / ``error_rate`` characters have no
    errors to spend and are found wherever they stand, inside longer words too: leave such items out of a benchmark if
    that is not wanted.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("distance", T.IntegerType()), T.StructField("match_end", T.LongType())])
    rows, out = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")), None
    for block in _blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                hits = [(k, *hit) for k, t in zip(batch["key"], batch["text"], strict=True) for hit in matcher.find(t)]
                yield pd.DataFrame(hits, columns=schema.names)

        found = rows.mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the documents in which a test item is found; see ``benchmark_matches``."""
    spark, kept = docs.sparkSession, docs

    def clean(sent):
        @F.pandas_udf(T.BooleanType())
        def flags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                yield pd.Series([not matcher.find(t) for t in batch], dtype=bool)

        return flags(F.col(quoted(text)))

    for block in _blocks(benchmark, item, item_text):
        kept = kept.where(clean(spark.sparkContext.broadcast(block)))
    return kept
