"""Quality rules by repetition coverage.

Words are the runs of characters other than ASCII white space. Every word becomes a small
number, windows of several lengths are hashed by doubling in NumPy, and the characters
inside windows or lines that occur before in the same text are measured against all
characters in words. Texts are judged one by one, so nothing is shuffled.

Defined results: a null or empty text has no words, fails the base rule and is not kept.
Repeated rows each get a row; other columns play no part; a null id stays null. A text of any
length is measured whole, in memory that is a small multiple of its size.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridvigil.llm.common import ROWS, claim, map_rows, map_whole, sql_type

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: base rule: share of words in repeated windows of three words
BASE_WINDOW = 3
MAX_REPEAT = 0.5
#: largest shares of word characters inside later copies of windows of so many words
MAX_COVERAGE = {5: 0.3, 7: 0.25, 10: 0.2}
#: largest share of word characters in lines that repeat an earlier line
MAX_LINE_COVERAGE = 0.3

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xBF58476D1CE4E5B9
_MASK = (1 << 64) - 1


def word_numbers(words: list[bytes]) -> np.ndarray:
    """The position at which each word is first seen."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))


def rolling(numbers: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` numbers, put together from halves."""
    single = (numbers.astype(np.uint64) + np.uint64(1)) * _MIX
    single ^= single >> np.uint64(29)
    single *= np.uint64(_BASE)
    single ^= single >> np.uint64(32)
    known = {1: single}

    def window(n: int) -> np.ndarray:
        if n not in known:
            left, right = window(n - n // 2), window(n // 2)
            size = len(single) - n + 1
            shift = np.uint64(pow(_BASE, n // 2, 1 << 64))
            known[n] = left[:size] * shift + right[n - n // 2 : n - n // 2 + size]
        return known[n]

    return window(length)


def repeated(numbers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(start of every window seen twice or more, whether it is the first), else None.

    Equal hashes are compared word by word with the first window of that hash.
    """
    if len(numbers) <= length:
        return None
    hashes = rolling(numbers, length)
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    same = np.ones(len(order), bool)
    for offset in range(length):
        same &= numbers[order + offset] == numbers[head + offset]
    if not same.all():  # two windows with one hash: name windows by their words instead
        rows = np.lib.stride_tricks.sliding_window_view(numbers, length)
        _, names = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(names.ravel(), kind="stable")
        ordered = names.ravel()[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
    twin = np.r_[~new[1:], False] | ~new
    return order[twin], new[twin]


def inside(starts: np.ndarray, length: int, n_words: int) -> np.ndarray:
    """Which words lie in a window that begins at one of ``starts``."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None) -> dict:
    """Counts, coverages and verdict of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if bare := line.strip(SPACES):
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += len(bare) - sum(map(bare.count, SPACES))
            seen.add(line)
    numbers = word_numbers(words)
    found = repeated(numbers, BASE_WINDOW)
    n_repeat_words = 0 if found is None else int(inside(found[0], BASE_WINDOW, n_words).sum())
    coverage = dict.fromkeys(MAX_COVERAGE, 0.0)
    sizes = None
    for length in sorted(MAX_COVERAGE):
        found = found and repeated(numbers, length)  # a longer repeat holds a shorter one
        if found is None:
            break
        if sizes is None:
            sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n_words)
        later = inside(found[0][~found[1]], length, n_words)
        coverage[length] = int(sizes[later].sum()) / word_chars
    line_coverage = dup_line_chars / word_chars if word_chars else 0.0
    base_failed = n_words < MIN_WORDS or n_repeat_words > MAX_REPEAT * n_words
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": base_failed,
        "kept": not base_failed
        and line_coverage <= MAX_LINE_COVERAGE
        and all(coverage[n] <= most for n, most in MAX_COVERAGE.items()),
        "line_coverage": line_coverage,
        **{f"coverage_{n}": share for n, share in coverage.items()},
    }


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_coverage double, "
    + ", ".join(f"coverage_{n} double" for n in MAX_COVERAGE)
)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every document."""

    def judge(rows):
        found = [measure(text) for text in rows[text_col]]
        return {id_col: rows[id_col], **{k: [x[k] for x in found] for k in (found[0] if found else {})}}

    return map_rows(docs, [id_col, text_col], judge, f"`{id_col}` {sql_type(docs, id_col)}, {FIELDS}")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        claim("repetition")
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                kept = [measure(text.as_py())["kept"] for text in rows.column(at)]
                yield rows.filter(pa.array(kept, pa.bool_()))

    return map_whole(docs, run)
