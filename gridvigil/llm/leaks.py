"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of words (ASCII letters lower-cased, marks and spaces cut off);
each symbol, and each character of a script without spaces, is a word of its own. An item of
``L`` words leaks if a text holds a stretch within ``L * EDITS // 100`` word edits of it; one
of fewer than ``MIN_WORDS`` words if a text holds it word for word. Short items are looked up
by the hash of all their words. For the others, the CGK embedding walks a sequence: at each step it writes the word it stands on, and a
random bit of step and word tells it to move on; few edits leave most of the written words
equal. Each repetition has walks of its own and compares some sampled steps by hash. A walk moves
on at every other step, so a longest one sees some 16 words; items are walked from their middle
and from every ``STRIDE`` words, so that all their words are seen, and texts from every place. So
many repetitions are made that a start whose written words agree in ``AGREE`` of the steps is
found with probability ``RECALL``. Places are left out before only where no stretch within an item's length
holds as many of the items' word grams as the allowed edits must leave. Each find is
verified by exact edit distance of the item to the best stretch; stretches that lack more of the
item's words than the allowed edits could have taken are left out before, without loss.

Items are held in blocks of bounded size; texts stay where they are and nothing is shuffled.

Defined results: a null or empty text has no leaks; an item without any word (null, empty or
marks alone) leaks nowhere; equal items are all reported; repeated rows each get their rows; other columns play no part; a null id stays null; without items
nothing leaks. A text of any length is searched whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from gridvigil.llm.common import ROWS, claim, map_rows, map_whole, sql_type

#: word edits per 100 words of an item
EDITS = 20
#: items of fewer words are found without edits alone
MIN_WORDS = 8
#: words of the grams that stand near a leak
GRAM = 3
#: lengths of walks; an item's are the longest that stay in it
STEPS = (4, 8, 16, 32)
SAMPLED = 4
#: words between the starts of an item's walks
STRIDE = 16
AGREE = 0.75
RECALL = 0.99
#: most items and characters held at a time
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_GRAM_BITS = 20
#: lower-cases A-Z and turns ASCII characters other than letters and digits into spaces
_TABLE = bytes(
    ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() and b < 128 else 32 for b in range(128)
) + bytes(range(128, 256))


#: scripts written without spaces between words
_SPACELESS = (
    (0x0E01, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF),
    (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303C), (0x3040, 0x4DBF),
    (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF),
    (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)


class _Cut(dict):
    """By code point: a space for marks, spaces and controls; symbols and characters without spaces apart."""

    def __missing__(self, code: int) -> str:
        char, kind = chr(code), unicodedata.category(chr(code))
        if code < 128:
            found = char
        elif kind[0] in "PZ" or kind == "Cc" or code == 0x200B:
            found = " "
        elif kind[0] == "S" or any(first <= code <= last for first, last in _SPACELESS):
            found = f" {char} "
        else:
            found = char
        self[code] = found
        return found


_CUT = _Cut()
# characters to cut; a class of 16-bit characters alone is looked up, a larger one is searched
_ODD = re.compile(f"[{''.join(re.escape(chr(c)) for c in range(128, 1 << 16) if not 0xD800 <= c < 0xE000 and _CUT[c] != chr(c))}]")
_LARGE = re.compile("[\U00010000-\U0010ffff]")


def word_hashes(text: str | None) -> np.ndarray:
    if text and not text.isascii() and (_ODD.search(text) or _LARGE.search(text)):
        text = text.translate(_CUT)
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    found = (values ^ np.uint64(xxhash.xxh3_64_intdigest(seed.to_bytes(8, "little")))) * _MIX
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))


def repetitions() -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLED))


@cache
def sampled_steps(repetition: int, steps: int) -> list[int]:
    """The steps that a repetition compares, in a walk of ``steps``."""
    rng = np.random.default_rng([repetition, steps])
    return sorted(rng.choice(steps, min(SAMPLED, steps), replace=False).tolist())


def item_starts(size: int) -> list[int]:
    """Where the walks of an item of ``size`` words begin; the shortest walk still fits."""
    return sorted({*range(0, max(size - STEPS[0], 0) + 1, STRIDE), size // 2})


def walks(words: np.ndarray, starts: np.ndarray, repetition: int, last: np.ndarray | None = None) -> np.ndarray:
    """Words written at each step of the walks from ``starts`` that is compared; the last word is walked on forever.

    ``last`` gives the place of each walk's last word, where ``words`` holds many items.
    """
    bits = mixed(words, repetition)
    bits[len(words) - 1 if last is None else last] = 0  # so none goes beyond its last word
    at, written = starts.copy(), np.empty((max(STEPS), len(starts)), np.uint64)
    compared = {step for steps in STEPS for step in sampled_steps(repetition, steps)}
    for step in range(max(compared) + 1):
        if step in compared:
            np.take(words, at, out=written[step])
        at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).view(np.int64)
    return written


def walk_keys(written: np.ndarray, repetition: int, steps: int) -> np.ndarray:
    """Hash of the sampled steps of each walk."""
    key = np.full(written.shape[1], repetition * 1000 + steps, np.uint64)
    for step in sampled_steps(repetition, steps):
        key = (key ^ written[step]) * _MIX
        key ^= key >> np.uint64(31)
    return key


def edit_distance(item: list[int], text: list[int]) -> int:
    """Fewest edits between ``item`` and any stretch of ``text``; bit-parallel."""
    size = len(item)
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best = score
    for word in text:
        equal = masks.get(word, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(across | up) & full, up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        best = min(best, score)
    return best


def missing(item: Counter, text: list[int], most: int) -> bool:
    """Whether more than ``most`` of an item's words, given by their counts, do not occur in ``text``.

    Each of these takes an edit, so the distance is greater than ``most``, too.
    """
    held = item.keys() & text
    return item.total() - sum(map(item.__getitem__, held)) > most


@dataclass
class Index:
    """A block of items with the keys of their walks."""

    ids: list  # of the items of ``MIN_WORDS`` words and more, then of the short ones
    words: list[np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: ascending hashes of all words, items
    grams: np.ndarray  # hashes of the word grams of all items, ascending
    bits: np.ndarray  # whether a short hash of a gram may be in ``grams``
    window: int  # most words of a leak
    block: int  # a leak holds a stretch of so many grams
    least: int  # with at least so many of its item's grams
    tables: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # repetition, steps, keys, item, offset

    @classmethod
    def of(cls, items: list[tuple[object, np.ndarray]]):
        long = [item for item in items if len(item[1]) >= MIN_WORDS]
        ordered = long + [item for item in items if len(item[1]) < MIN_WORDS]
        ids, words = [i for i, _ in ordered], [w for _, w in ordered]
        short = {}
        for size in sorted({len(w) for w in words[len(long) :]}):
            own = np.array([k for k in range(len(long), len(words)) if len(words[k]) == size])
            keys = np.concatenate([next(key for n, key in runs(words[k]) if n == size) for k in own.tolist()])
            order = np.argsort(keys, kind="stable")
            short[size] = keys[order], own[order]
        if not long:
            return cls(ids, words, short, np.zeros(0, np.uint64), np.zeros(1 << _GRAM_BITS, bool), 0, 1, 1, [])
        items, words = long, words[: len(long)]
        grams = np.unique(np.concatenate([word_grams(w) for w in words]))
        bits = np.zeros(1 << _GRAM_BITS, bool)
        bits[(grams >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)] = True
        sizes = np.array([len(w) for w in words])
        edits = sizes * EDITS // 100
        begins = [item_starts(size) for size in sizes.tolist()]
        owner = np.repeat(np.arange(len(items)), [len(b) for b in begins])
        offsets = np.concatenate(begins).astype(np.int64)
        every = np.concatenate(words)
        first = np.cumsum(sizes) - sizes
        steps = np.array(STEPS)[np.searchsorted(STEPS, sizes[owner] - offsets, side="right") - 1]
        tables = []
        for repetition in range(repetitions()):
            written = walks(every, first[owner] + offsets, repetition, (first + sizes - 1)[owner])
            for length in STEPS:
                own = np.flatnonzero(steps == length)
                keys = walk_keys(written[:, own], repetition, length)
                order = np.argsort(keys, kind="stable")
                tables.append((repetition, length, keys[order], owner[own][order], offsets[own][order]))
        # an edit spoils ``GRAM`` grams; of the blocks a leak is cut into, one holds the mean or more
        most = sizes + edits
        block = int(most.min())
        least = np.ceil((sizes - GRAM + 1 - GRAM * edits) / np.ceil((most - GRAM + 1) / block)).min()
        words = [w for _, w in ordered]
        return cls(ids, words, short, grams, bits, int(most.max()), block, max(int(least), 1), tables)

    def leaks(self, text: str | None) -> dict[int, int]:
        """Number of each item that leaks in ``text``, with its fewest edits."""
        words = word_hashes(text)
        return self.whole(words) | self.edited(words)

    def whole(self, words: np.ndarray) -> dict[int, int]:
        """The short items that stand in ``words`` as they are."""
        found: dict[int, int] = {}
        if not self.short:
            return found
        for size, own in runs(words):
            if size > max(self.short):
                break
            if size not in self.short:
                continue
            keys, items = self.short[size]
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            for at in np.flatnonzero(keys[place] == own).tolist():
                for entry in range(place[at], np.searchsorted(keys, own[at], side="right")):
                    if (item := int(items[entry])) not in found and (self.words[item] == words[at : at + size]).all():
                        found[item] = 0
        return found

    def edited(self, words: np.ndarray) -> dict[int, int]:
        """The other items that stand in ``words`` within their edits."""
        if not self.tables or len(words) <= self.least:
            return {}
        grams = word_grams(words)
        hit = self.bits[(grams >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)]
        if hit.sum() < self.least:
            return {}
        at = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        hit[at] = self.grams[place] == grams[at]
        so_far = np.r_[0, np.cumsum(hit)]
        begins = np.arange(len(grams))
        full = so_far[np.minimum(begins + self.block, len(grams))] - so_far[begins] >= self.least
        if not full.any():
            return {}
        # a walk begins in the leak, so no farther from the full block than a leak is long
        near = np.r_[0, np.cumsum(full)]
        begins = np.arange(len(words))
        low = np.maximum(begins - self.window, 0)
        starts = np.flatnonzero(near[np.minimum(begins + self.window, len(grams))] > near[np.minimum(low, len(grams))])
        if not len(starts):
            return {}
        seen: dict[int, list[int]] = {}  # by item, where stretches that were looked at begin, ascending
        counts: dict[int, Counter] = {}
        found: dict[int, int] = {}
        listed = words.tolist()
        at_walk = -1
        for repetition, steps, keys, items, offsets in self.tables:
            if at_walk != repetition:
                at_walk, written = repetition, walks(words, starts, repetition)
            if not len(keys):
                continue
            own = walk_keys(written, repetition, steps)
            first, last = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
            for i in np.flatnonzero(last > first).tolist():
                for entry in range(first[i], last[i]):
                    item, begin = int(items[entry]), int(starts[i] - offsets[entry])
                    size = len(self.words[item])
                    most = size * EDITS // 100
                    done = seen.setdefault(item, [])
                    place = bisect_left(done, begin - most)
                    if found.get(item) == 0 or place < len(done) and done[place] <= begin + most:
                        continue
                    done.insert(place, begin)  # the stretch also serves places up to ``most`` away
                    stretch = listed[max(begin - 2 * most, 0) : begin + size + 2 * most + 1]
                    if item not in counts:
                        counts[item] = Counter(self.words[item].tolist())
                    if missing(counts[item], stretch, most):
                        continue
                    edits = edit_distance(self.words[item].tolist(), stretch)
                    if edits <= most:
                        found[item] = min(edits, found.get(item, edits))
        return found


def runs(words: np.ndarray):
    """Number and hashes of every 1, 2 and more neighbouring words below ``MIN_WORDS``."""
    found = np.zeros(len(words), np.uint64)
    for size in range(1, min(MIN_WORDS, len(words) + 1)):
        found = (found[: len(words) - size + 1] ^ words[size - 1 :]) * _MIX
        found ^= found >> np.uint64(29)
        yield size, found


def word_grams(words: np.ndarray) -> np.ndarray:
    """Hash of every ``GRAM`` neighbouring words."""
    n = max(len(words) - GRAM + 1, 0)
    found = np.full(n, GRAM, np.uint64)
    for i in range(GRAM):
        found = (found ^ words[i : i + n]) * _MIX
        found ^= found >> np.uint64(29)
    return found


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items' indexes, in blocks of at most ``BLOCK_ITEMS`` items and some ``BLOCK_CHARS``."""
    block, chars = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        words = word_hashes(row[1])
        if not len(words):
            continue
        block.append((row[0], words))
        chars += len(row[1])
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield Index.of(block)
            block, chars = [], 0
    if block:
        yield Index.of(block)


def find(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row per document and item that leaks: ids, fewest word edits, words of the item."""
    schema = f"`{id_col}` {sql_type(docs, id_col)}, `{item_col}` {sql_type(items, item_col)}, edits long, item_words long"
    parts = []
    for index in indexes(items, item_col):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(rows, held=held):
            out = {id_col: [], item_col: [], "edits": [], "item_words": []}
            for doc_id, text in zip(rows[id_col], rows[text_col], strict=True):
                for item, edits in held.value.leaks(text).items():
                    values = (doc_id, held.value.ids[item], edits, len(held.value.words[item]))
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
            return out

        parts.append(map_rows(docs, [id_col, text_col], run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def drop_leaking(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without leaks, with all their columns."""
    at = docs.columns.index(text_col)
    for index in indexes(items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            claim("leaks")
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(start, ROWS)
                    clean = [not held.value.leaks(text) for text in rows.column(at).to_pylist()]
                    yield rows.filter(pa.array(clean, pa.bool_()))

        docs = map_whole(docs, run)
    return docs
