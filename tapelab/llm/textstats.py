"""Statistics of whole texts, computed in Arrow batches; the inputs of the two quality models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_PUNCT = b".,;:!?\"'()-"
_TAIL = bytes(range(128, 192))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "bang_ratio",
    "distinct_ratio", "line_words", "non_ascii_ratio", "bar_ratio", "short_ratio", "stop_ratio", "long_ratio",
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of three words that is found twice or more, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == n - 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(g, len(seen)) for g in grams), np.int64, n - 2)
    twice = np.bincount(ids)[ids] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS and the values of FEATURES; a null text is an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    cut = lambda chars, of=data: len(of) - len(of.translate(None, chars))
    tails = cut(_TAIL)
    chars = len(data) - tails
    word_chars = chars - cut(_BLANK)
    symbols = cut(SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.split()] if b"\n" in data else [data] * (n > 0)
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    each, c, letters = max(n, 1), max(word_chars, 1), max(cut(_LETTERS), 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    counts = (n, word_chars, symbols, dup_lines, repeats)
    features = (
        float(np.log1p(n)), word_chars / each, symbols / c, dup_lines / max(len(lines), 1), repeats / each, cut(_UPPER) / letters, cut(_DIGITS) / c, cut(_PUNCT) / c, data.count(b"!") / c,
        distinct / each, n / max(len(lines), 1), tails / c, data.count(b"|") / c, float((lengths <= 3).sum()) / each, float((lengths == 2).sum()) / each, float((lengths > 12).sum()) / each,
    )
    return counts, features


def with_statistics(docs: DataFrame, carry: list[str], finish, schema: str) -> DataFrame:
    """Maps (carry..., text) to rows: ``finish(columns, counts, features)`` gives the Arrow arrays of ``schema`` for a
    batch, from the carried columns, an int64 matrix and a float64 matrix."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                both = [statistics(t) for t in part.column(len(carry)).to_pylist()]
                counts = np.array([x[0] for x in both], np.int64).reshape(len(both), len(COUNTS))
                features = np.array([x[1] for x in both], np.float64).reshape(len(both), len(FEATURES))
                yield pa.RecordBatch.from_arrays(finish([part.column(i) for i in range(len(carry))], counts, features), names)

    return docs.select(*carry, docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
