"""Token ids of whole texts by the tokenizers library.

A byte-level tokenizer cuts a text into words by a pattern before its model sees it, and a word's
ids depend on its bytes alone. Texts are cut here as that pattern does, all of a batch at once, by
the kinds of neighbouring characters; ids of short words are kept in a table that is searched for
all words of a batch together, and only new words go through the library's model, many in a call.
Characters whose kind may differ between versions of Unicode, other white space than space, tab
and line ends, and apostrophes (the pattern has rules of its own for them) are left to the
library, with what stands between the white space around them. A text with an added token (such as
``<|endoftext|>``), and every text of a tokenizer of another kind, goes through the library
whole. The ids are the library's in all cases.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np

from gridvigil.llm.common import cache_of, worker_state

#: slots of the table of short words (21 bytes each, besides some 8 for a word's ids); words that
#: were not asked for again make room when half of them are taken
SLOTS = 1 << 21
#: words looked up at a time
STEP = 1 << 17
#: bytes of a short word at most
SHORT = 16
#: longer words, and stretches left to the library, in each of two generations kept; a full
#: generation becomes the older one, and what is not asked for again is dropped with it
MAX_LONG = 20_000
#: bytes of one of these at most, and of a text that is cut in one go
LONG, PART = 64, 1 << 20
# --- fixed values: kinds of characters for a byte-level tokenizer ---
LETTER, DIGIT, MARK, BLANK, WHITE, ODD, ODD_WHITE, BEGIN = range(8)
# --- end of fixed values ---
#: where a long text may be cut, before the space
GAP = re.compile(rb"[A-Za-z0-9] ")


def kind_of(number: int) -> int:
    """Kind of a code point; odd where versions of Unicode, or of white space, may differ."""
    char = chr(number)
    if char == " ":
        return BLANK
    if char in "\t\n\r":
        return WHITE
    if char.isspace() or char in "\u180e\u200b":
        return ODD_WHITE
    if number < 0x21 or 0x7F <= number < 0xA1 or number > 0x24F or char == "'":
        return ODD
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(char)[0], MARK)


def cut_rules() -> tuple[np.ndarray, np.ndarray]:
    """By kinds of a character and the one before: 1 where a word begins, 2 where one begins if the
    next character is not white; and where one begins whatever stands before and behind."""
    rules = np.ones((8, 8), np.uint8)
    for kind in (LETTER, DIGIT, MARK):
        rules[kind, kind] = rules[BLANK, kind] = 0
    rules[np.ix_((BLANK, WHITE), (BLANK, WHITE))] = 2
    firm = np.zeros((8, 8), bool)
    firm[np.ix_((LETTER, DIGIT, MARK, ODD), (BLANK, WHITE))] = firm[BEGIN] = True
    return rules.ravel(), firm.ravel()


def byte_letters() -> np.ndarray:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on.

    A zero byte parts words here and becomes the space, which no byte is written as.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.arange(256, dtype="<u2")
    rest = sorted(set(range(256)) - set(own))
    table[rest] = 0x100 + np.arange(len(rest))
    table[0] = 0x20
    return table


def stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers ``begins[i]`` to ``begins[i] + sizes[i] - 1`` for every i, one after the other."""
    ends = np.cumsum(sizes)
    found = np.repeat(begins - ends + sizes, sizes)
    found += np.arange(len(found))
    return found


class Kept(dict):
    """A cache of two generations."""

    def __init__(self, most: int):
        self.most = most
        self.before: dict = {}

    def age(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()


class ShortWords:
    """Ids of words of at most ``SHORT`` bytes, none of them zero; a word is two 64-bit numbers."""

    def __init__(self, dtype: np.dtype):
        self.slots = max(SLOTS, 4 * STEP)
        self.shift = np.uint64(65 - self.slots.bit_length())
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.place = np.zeros(self.slots, np.uint32)  # where the ids begin, and 5 bits for their number
        self.again = np.zeros(self.slots, bool)  # asked for since the table was last full
        self.ids = np.empty(1 << 16, dtype)
        self.n_words = self.n_ids = 0

    def make_room(self) -> None:
        """Keep only words that were asked for again, or none if these are too many."""
        if self.n_words <= self.slots // 2:
            return
        stay = np.flatnonzero(self.again)
        if len(stay) > self.slots // 4:
            stay = stay[:0]
        low, high, place = self.low[stay], self.high[stay], self.place[stay]
        sizes = place & np.uint32(31)
        ids = self.ids[stretches((place >> np.uint32(5)).astype(np.int64), sizes.astype(np.int64))]
        self.low[:] = 0
        self.again[:] = False
        self.n_words = self.n_ids = 0
        slots, _ = self.find(low, high)
        self.again[:] = False
        self.put(slots, ids, sizes)

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' slots, and which words (each once) are new; these need ``put``."""
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        slots = (mixed >> self.shift).astype(np.int64)
        left, new = np.arange(len(slots)), []
        while len(left):
            own = slots[left]
            free = np.flatnonzero(self.low[own] == 0)
            if len(free):  # of the words that meet at a slot, one gets it
                at, words = own[free], left[free]
                self.place[at] = words
                first = self.place[at] == words
                at, words = at[first], words[first]
                self.low[at], self.high[at], self.again[at] = low[words], high[words], False
                new.append(words)
            left = left[(self.low[own] != low[left]) | (self.high[own] != high[left])]
            slots[left] = (slots[left] + 1) & (self.slots - 1)
        new = np.concatenate(new) if new else left
        self.n_words += len(new)
        self.again[slots] = True
        self.again[slots[new]] = False
        return slots, new

    def put(self, slots: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the new words at ``slots``, one after the other."""
        self.place[slots] = (self.add(ids) + np.cumsum(sizes) - sizes) << 5 | sizes
        self.n_ids += len(ids)

    def add(self, ids: np.ndarray) -> int:
        """Write ``ids`` behind those that are held; where they begin."""
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids[: self.n_ids], np.empty(self.n_ids + 2 * len(ids), self.ids.dtype)]
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        return self.n_ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        #: narrowest type that holds every id
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        before = self.library.pre_tokenizer
        self.by_words = (
            type(before).__name__ == "ByteLevel" and not before.add_prefix_space and getattr(before, "use_regex", True)
            and self.library.normalizer is None
            and not any(" " in token for token in self.added)  # words of other texts would make one
            and set(map(chr, byte_letters()[1:].tolist())) <= vocabulary.keys()
        )
        self.n_bytes = np.zeros(self.size, np.int64)  # a byte is one letter of such a vocabulary
        for name, number in vocabulary.items():
            self.n_bytes[number] = len(name)
        if self.by_words:
            self.model = Tokenizer(self.library.model)  # the same model, not a copy, for words written as letters
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = byte_letters()
        self.kinds = np.array([kind_of(i) for i in range(1 << 16)], np.uint8)
        self.byte_kinds = np.r_[self.kinds[:128], np.full(128, ODD, np.uint8)]
        self.rules, self.firm = cut_rules()
        self.masks = np.array([(1 << 8 * min(max(n, 0), 8)) - 1 for n in range(-8, SHORT + 1)], np.uint64)
        self.forget()

    def forget(self) -> None:
        self.short = ShortWords(self.dtype)
        self.long: Kept = Kept(MAX_LONG)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text (null: none) as little-endian numbers of ``dtype``."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            return self._encode([t or "" for t in texts])
        except BaseException:  # words may have a slot but no ids yet
            self.forget()
            raise
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.whole(texts)
        # an added token may take spaces beside it, so its whole text goes through the library
        special = [i for i, t in enumerate(texts) if any(map(t.__contains__, self.added))]
        own = dict(zip(special, self.whole([texts[i] for i in special]), strict=True))
        found, some, size = [], [], 0
        for i, text in enumerate(texts):
            data = b"" if i in own else text.encode()
            if some and size + len(data) > PART:
                found += self._by_words(some)
                some, size = [], 0
            if len(data) > PART:
                found.append(b"".join(x for part in self._parts(data) for x in self._by_words([part])))
            else:
                some.append(data)
                size += len(data)
        found += self._by_words(some)
        for i, ids in own.items():
            found[i] = ids
        return found

    def _parts(self, data: bytes) -> Iterator[bytes]:
        """A long text cut before single spaces."""
        start = 0
        while len(data) - start > PART and (gap := GAP.search(data, start + PART)):
            yield data[start : gap.end() - 1]
            start = gap.end() - 1
        yield data[start:]

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without added tokens, by their words."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins, data = np.cumsum(sizes) - sizes, b"".join(texts)
        if not data:
            return texts
        self.long.age()
        buffer = np.frombuffer(data + bytes(SHORT), np.uint8)
        at, odd, joined = self._cut(buffer[: len(data)], begins[sizes > 0])
        lengths = np.diff(at, append=len(data))
        is_long = odd | (lengths > SHORT)
        numbers = np.ndarray(len(data) + SHORT - 7, "<u8", buffer, strides=(1,))  # eight bytes from each place on
        short, ids, counts = self.short, [], []
        for i in range(0, len(at), STEP):
            short.make_room()
            some = slice(i, i + STEP)
            begin, count = np.empty(len(at[some]), np.int64), np.empty(len(at[some]), np.int64)
            own = np.flatnonzero(~is_long[some])
            where, size = at[some][own], lengths[some][own]
            low, high = numbers[where] & self.masks[size + 8], numbers[where + 8] & self.masks[size]
            slots, new = short.find(low, high)
            if len(new):
                short.put(slots[new], *self._word_ids(buffer, where[new], size[new]))
            place = short.place[slots]
            begin[own], count[own] = place >> np.uint32(5), place & np.uint32(31)
            if len(own) < len(begin):
                own = np.flatnonzero(is_long[some])
                where, size = at[some][own], lengths[some][own]
                found = self._long_ids(data, where, size, joined[where + size - 1])
                count[own] = [len(x) // self.dtype.itemsize for x in found]
                begin[own] = short.add(np.frombuffer(b"".join(found), self.dtype)) + np.cumsum(count[own]) - count[own]
            ids.append(short.ids[stretches(begin, count)])
            counts.append(count)
        ends = np.r_[0, np.cumsum(np.concatenate(counts))] * self.dtype.itemsize
        cuts = ends[np.searchsorted(at, np.r_[begins, len(data)])].tolist()
        found = np.concatenate(ids).tobytes()
        return [found[a:b] for a, b in pairwise(cuts)]

    def _cut(self, buffer: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin, and which are stretches left to the library; for every byte, whether
        its character is surely not white. Texts begin at ``begins``."""
        kinds = self.byte_kinds[buffer]
        lead = np.flatnonzero(buffer >= 0xC2)
        if len(lead):
            first = buffer[lead]
            two, three = lead[first < 0xE0], lead[(first >= 0xE0) & (first < 0xF0)]
            number = (buffer[two] & 0x1F).astype(np.int64) << 6 | buffer[two + 1] & 0x3F
            kinds[two] = kinds[two + 1] = self.kinds[number]
            number = (buffer[three] & 0xF).astype(np.int64) << 12 | (buffer[three + 1] & 0x3F).astype(np.int64) << 6 | buffer[three + 2] & 0x3F
            kinds[three] = kinds[three + 1] = kinds[three + 2] = self.kinds[number]
        before = np.empty(len(kinds) + 1, np.uint8)
        before[1:] = kinds
        before[begins] = before[-1] = BEGIN
        pair = before[:-1] << 3 | kinds
        rule = self.rules[pair]
        start = rule == 1
        inner = np.flatnonzero(rule == 2)
        inner = inner[before[inner + 1] != BEGIN]  # not the last character of a text
        behind = kinds[inner + 1]
        start[inner] = (behind != BLANK) & (behind != WHITE)
        inside = np.zeros(len(kinds), bool)
        if (kinds >= ODD).any():
            firm = np.flatnonzero(self.firm[pair])
            left = np.flatnonzero(np.maximum.reduceat(kinds, firm) >= ODD)
            edges = np.zeros(len(kinds) + 1, np.int8)
            edges[firm[left]] += 1
            edges[np.r_[firm, len(kinds)][left + 1]] -= 1
            inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
            start &= ~inside
            start[firm[left]] = True
        at = np.flatnonzero(start)
        return at, inside[at], (kinds <= MARK) | (kinds == ODD)

    def _word_ids(self, buffer: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and their numbers."""
        letters = self.letters[buffer[stretches(at, sizes + 1)]]
        letters[np.cumsum(sizes + 1) - 1] = 0x20
        return self._cut_ids(self.model, letters[:-1].tobytes().decode("utf-16-le"), sizes)

    def _cut_ids(self, tokenizer, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and how many belong to each of its parts of so many bytes."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(cuts, prepend=0)

    def _long_ids(self, data: bytes, at: np.ndarray, sizes: np.ndarray, joined: np.ndarray) -> list[bytes]:
        """Ids of long words and of stretches; those from a space to no white space may be encoded as one text."""
        names = [data[a : a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
        known: dict[bytes, bytes | None] = {}
        together, alone = [], []
        for name, end in zip(names, joined.tolist(), strict=True):
            if name not in known:
                known[name] = self.long.get(name) or self.long.before.get(name)
                if known[name] is None:
                    (together if end and name[0] == 0x20 else alone).append(name)
        if together:
            ids, counts = self._cut_ids(self.library, b"".join(together).decode(), np.array(list(map(len, together))))
            ends = (np.cumsum(counts) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            known.update(zip(together, (raw[a:b] for a, b in pairwise([0, *ends])), strict=True))
        known.update(zip(alone, self.whole([name.decode() for name in alone]), strict=True))
        self.long.update((name, ids) for name, ids in known.items() if len(name) <= LONG)
        return list(map(known.__getitem__, names))


def encoder(path: str) -> Encoder:
    """The process's encoder of a file; tasks of one worker share what it has learned."""
    known = worker_state().setdefault("encoders", {})
    if path not in known:
        known[path] = Encoder(path)
        cache_of("tokens", known.clear)  # the library keeps some 100 MB for a file
    return known[path]
