"""Quality rules by distribution divergence (operator 2).

Each text's histograms of character classes and of common words are compared
with those of its language by Jensen-Shannon distance. The references are
counted over all rows: characters and words by language; a language's common
words are those with at least ``common`` of its words. A language with less
than ``rare`` of all words, and a null language, is compared with all rows
together. The distances are read only on texts long enough for them
(``min_chars``, ``min_words``).

Nulls and edges: a null text has no words; an empty text fails the base rules
by length. A null doc_id stays null. Repeated rows are judged alike. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


@dataclass(frozen=True)
class Divergence:
    common: float = 0.002
    rare: float = 0.001
    min_chars: int = 200
    min_words: int = 50
    max_char_distance: float = 0.30
    #: On the words, plus ``word_slack`` over the root of their number: short texts scatter more.
    max_word_distance: float = 0.36
    word_slack: float = 0.5


#: Character classes: lower, upper, digit, white space, sentence marks, symbols, other ASCII, other letters and signs.
CLASSES = 8
_TABLE = np.full(129, 6, np.uint8)
for _members, _class in (
    (range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\n\r\x0b\x0c", 3), (b".,;:!?'\"()-", 4), (b"#*$%&|<>", 5), ((128,), 7),
):
    _TABLE[list(_members)] = _class
_SYMBOLS = b"#*$%&|<>"


def char_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount(_TABLE[np.minimum(points, 128)], minlength=CLASSES)


def base_counts(data: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words of a text, and word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    # code points are the bytes that do not continue one; white space has none of those
    chars = sum(map(len, words)) - len(data.translate(None, _LEADING))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    return words, chars, symbols, dup, repeated_words(words)


_LEADING = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance with base 2, from 0 to 1; 1 where either is empty."""
    a, b = float(p.sum()), float(q.sum())
    if not a or not b:
        return 1.0
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return math.sqrt(min(1.0, max(0.0, d / 2)))


def _counts(batches: Iterator[pa.RecordBatch], limit: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, word, n); the classes of characters are words of the form space + class, which no word has."""
    found: dict[str | None, Counter] = {}

    def flush() -> pa.RecordBatch:
        langs, words, n = [], [], []
        for lang, counter in found.items():
            langs += [lang] * len(counter)
            words += counter.keys()
            n += counter.values()
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counter = found.setdefault(lang, Counter())
            counter.update(data.lower().split())
            for k, v in enumerate(char_histogram(data.decode()).tolist()):
                if v:
                    counter[b" %d" % k] += v
        if sum(map(len, found.values())) > limit:
            yield flush()
    if found:
        yield flush()


def references(docs: DataFrame, p: Divergence) -> dict[str | None, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By language (None: all rows): character histogram, common words by place, their histogram with the rest last."""
    counted = docs.select("lang", "text").mapInArrow(_counts, "lang string, word binary, n long")
    table = cut(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    is_word = F.substring("word", 1, 1) != F.lit(b" ")
    totals = table.groupBy("lang").agg(F.sum(F.when(is_word, F.col("n")).otherwise(0)).alias("total"))
    every = table.agg(F.sum(F.when(is_word, F.col("n")).otherwise(0))).first()[0] or 0
    big = totals.where(F.col("lang").isNotNull() & (F.col("total") >= max(1, p.rare * every)))  # at most 1 / rare languages
    by_lang = table.join(F.broadcast(big), "lang").where(~is_word | (F.col("n") >= p.common * F.col("total"))).select("lang", "word", "n", "total")
    pooled = table.groupBy("word").agg(F.sum("n").alias("n")).where(~is_word | (F.col("n") >= p.common * every)).select(
        F.lit(None).cast("string").alias("lang"), "word", "n", F.lit(every).cast("long").alias("total")
    )
    # at most (1 / rare + 1) languages of 1 / common + CLASSES rows
    rows = by_lang.union(pooled).toArrow().to_pylist()
    found: dict[str | None, tuple[np.ndarray, dict[bytes, int], np.ndarray]] = {}
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        chars = np.zeros(CLASSES)
        words: list[tuple[int, bytes]] = []
        for r in own:
            if r["word"][:1] == b" ":
                chars[int(r["word"][1:])] = r["n"]
            else:
                words.append((-r["n"], bytes(r["word"])))
        words.sort()
        hist = np.array([-n for n, _ in words] + [own[0]["total"] + sum(n for n, _ in words)], float)
        found[lang] = chars, {w: k for k, (_, w) in enumerate(words)}, hist
    return found


def _judged(batches: Iterator[pa.RecordBatch], shared, p: Divergence) -> Iterator[pa.RecordBatch]:
    known = shared.value
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words, chars, symbols, dup, repeated = base_counts(data)
            n = len(words)
            failed = n < 50 or 100 * repeated > 50 * n
            ref = known.get(lang) or known.get(None)
            by_char = by_word = None
            if ref:
                hist = char_histogram(data.decode())
                if hist.sum() >= p.min_chars:
                    by_char = distance(hist, ref[0])
                if n >= p.min_words:
                    place = ref[1]
                    at = [place[w] for w in data.lower().split() if w in place]
                    own = np.bincount(at, minlength=len(ref[2])) if at else np.zeros(len(ref[2]))
                    own[-1] = n - len(at)
                    by_word = distance(own, ref[2])
            kept = not failed and (by_char is None or by_char <= p.max_char_distance) and (by_word is None or by_word <= p.max_word_distance + p.word_slack / math.sqrt(n))
            for column, x in zip(out, (n, chars, symbols, dup, repeated, failed, kept, by_char, by_word)):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types))], names=["doc_id", *names])


def judge_quality(docs: DataFrame, p: Divergence = Divergence()) -> DataFrame:
    """Base counts, distances and verdict of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(references(rows, p))
    return rows.mapInArrow(
        partial(_judged, shared=shared, p=p),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, char_distance double, word_distance double",
    )
