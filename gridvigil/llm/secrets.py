"""Secret scan by a linear-chain conditional random field.

Texts are cut into tokens (word runs and single marks). Every token is tagged as begin,
inside or outside of a secret from its shape, its first letters, the shapes beside it, the next
words to its left and right, how far back a cue word such as ``token`` or ``key`` stands, and
features of the whole file; Viterbi decodes the tags. Weights are fitted here, by full-batch gradient ascent on the likelihood of
generated labelled lines, so the model is the same on every run. A token that is outside
whatever its neighbours are cuts the chain exactly; what lies between is decoded for many
pieces at once. Texts are handled one by one, so nothing is shuffled.

Base kinds ``assign``, ``access`` and ``hex`` are patterns; the model adds ``learned``
spans that lie in no base span. A learned span goes on to the end of the
run of characters that secrets are made of, so none is hidden by half.

Defined results: a null or empty text has no spans; repeated rows each get a row; other
columns play no part; a null id stays null. A text of any length is read whole, in memory that
is a small multiple of its size.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridvigil.llm.common import ROWS, claim, map_whole, slices, sql_type

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "learned")

ASSIGN = re.compile(
    r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: bytes of text tagged together
BYTES = 1 << 18
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: shortest learned span
LEARNED_CHARS = 12
#: what a secret's run goes on with: its characters, a mark between two of them, padding
RUN = re.compile(r"(?:[A-Za-z0-9_]|[+/.~-](?=[A-Za-z0-9_+/]))*(?:=(?![A-Za-z0-9_])){0,2}")
#: letters of a token that tell its kind, and lines in which a known word stands
PREFIX = 4
KNOWN_LINES = 4

CUES = re.compile(
    r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|auth|bearer|credential|private|access|key)"
)
CUE_BYTES = (
    b"passw", b"passphrase", b"pwd", b"secret", b"token", b"auth", b"bearer", b"credential", b"private",
    b"access", b"key",
)

O, B, I = 0, 1, 2
#: character classes: space, hex letter, other lower-case letter, capital, digit, other letter, mark
SPACE, LOW_HEX, LOW, HIGH, DIGIT, OTHER, MARK = range(7)
MARKS = "=:\"'+/.-<>(){}[],;@#$%&*|!?"
LENGTHS = np.array([2, 4, 8, 12, 16, 20, 28, 40])
N_SHAPES = 9 * (len(LENGTHS) + 1) * 2 * 3
N_TOKENS = N_SHAPES + len(MARKS) + 2  # and any other mark, and the edge of a text
EDGE = N_TOKENS - 1
N_NEAR = 8
N_FILE = 8
FORBIDDEN = -1e4


def _class_table() -> np.ndarray:
    found = np.full(129, MARK, np.uint8)
    found[[9, 10, 11, 12, 13, 32]] = SPACE
    for first, last, kind in (("a", "f", LOW_HEX), ("g", "z", LOW), ("A", "Z", HIGH), ("0", "9", DIGIT)):
        found[ord(first) : ord(last) + 1] = kind
    found[ord("_")] = LOW
    found[128] = OTHER
    return found


def _mark_table() -> np.ndarray:
    found = np.full(129, N_SHAPES + len(MARKS), np.int64)
    for i, mark in enumerate(MARKS):
        found[ord(mark)] = N_SHAPES + i
    return found


CLASS, MARK_IDS = _class_table(), _mark_table()


@dataclass
class Tokens:
    """Tokens of many texts in one row of arrays."""

    text: np.ndarray  # number of the text
    start: np.ndarray  # code points in the text
    end: np.ndarray
    shape: np.ndarray
    near: np.ndarray  # how many tokens back the last cue stands
    gap: np.ndarray  # 1 where white space stands before the token
    file: np.ndarray  # by text
    word: np.ndarray  # hash of the lower-cased token, 0 for marks
    left_word: np.ndarray  # hash of the next word on that side in the text, else 0
    right_word: np.ndarray
    prefix: np.ndarray  # hash of the first letters of a longer token, else 0


def tokenize(texts: list[str]) -> Tokens:
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes + 1) - sizes - 1  # a line feed parts the texts
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = points.astype(np.uint64)
    points = np.minimum(points, 128).astype(np.uint8)
    kinds = CLASS[points]
    word = (kinds != SPACE) & (kinds != MARK)
    before = np.r_[False, word[:-1]]
    starts = np.flatnonzero((word & ~before) | (kinds == MARK))
    if not len(starts):
        none = np.empty(0, np.int64)
        return Tokens(none, none, none, none, none, none, np.zeros(len(texts), np.int64), *[none] * 4)
    is_word = word[starts]
    word_ends = np.flatnonzero(before & ~word)  # the last character is a line feed
    ends = starts + 1
    ends[is_word] = word_ends
    count = {k: np.add.reduceat((kinds == k).astype(np.int32), starts) for k in (LOW_HEX, LOW, HIGH, DIGIT, OTHER)}
    turns = (kinds[1:] == DIGIT) != (kinds[:-1] == DIGIT)
    turns = np.add.reduceat(np.r_[False, turns & word[1:] & word[:-1]].astype(np.int32), starts)
    low = count[LOW] + count[LOW_HEX]
    mix = (count[DIGIT] > 0) + 2 * (low > 0) + 4 * (count[HIGH] > 0)
    mix = np.where(count[OTHER] > 0, 8, mix)
    hexed = (count[LOW] + count[HIGH] + count[OTHER]) == 0
    length = np.searchsorted(LENGTHS, ends - starts, side="right")
    shape = ((mix * (len(LENGTHS) + 1) + length) * 2 + hexed) * 3 + np.searchsorted([0, 2], turns)
    shape = np.where(is_word, shape, MARK_IDS[points[starts]])
    text = np.searchsorted(first, starts, side="right") - 1
    cue = np.zeros(len(starts), bool)
    with_cue = np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts):
        lower = raw.encode("utf-8", "surrogatepass").lower()
        if any(c in lower for c in CUE_BYTES):
            hits = [m.end() - 1 + first[i] for m in CUES.finditer(raw)]
            if hits:
                cue[np.searchsorted(starts, hits, side="right") - 1] = True
                with_cue[i] = 1
    order = np.arange(len(starts))
    last = np.maximum.accumulate(np.where(cue, order, -N_NEAR))
    begin = np.searchsorted(text, np.arange(len(texts)))  # first token of each text
    near = np.where(last >= begin[text], np.minimum(order - last, N_NEAR - 1), N_NEAR - 1)
    marks = np.bincount(text[~is_word], minlength=len(texts))
    all_tokens = np.maximum(np.bincount(text, minlength=len(texts)), 1)
    density = np.searchsorted([0.12, 0.3, 0.5], marks / all_tokens)
    gap = (kinds[starts - 1] == SPACE).astype(np.int64)
    words = token_hashes(letters + np.where(kinds == HIGH, 32, 0).astype(np.uint64), word, starts, 64)
    prefix = np.where(ends - starts > PREFIX, token_hashes(letters, word, starts, PREFIX), 0)
    before_it = np.maximum.accumulate(np.where(is_word, order, -1))
    before_it = np.r_[-1, before_it[:-1]]
    behind_it = np.minimum.accumulate(np.where(is_word, order, len(order))[::-1])[::-1]
    behind_it = np.r_[behind_it[1:], len(order)]

    def beside(which: np.ndarray) -> np.ndarray:
        there = (which >= 0) & (which < len(order))
        which = np.where(there, which, 0)
        return np.where(there & (text[which] == text), words[which], 0).astype(np.uint64)

    return Tokens(
        text, starts - first[text], ends - first[text], shape, near, gap, density * 2 + with_cue,
        words, beside(before_it), beside(behind_it), prefix.astype(np.uint64),
    )


_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def token_hashes(letters: np.ndarray, word: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Hash of the first ``most`` letters of every token, 0 for marks."""
    place = np.arange(len(letters))
    begins = np.zeros(len(letters), np.int64)
    begins[starts] = starts
    place -= np.maximum.accumulate(begins)
    counted = word & (place < most)
    values = np.zeros(len(letters), np.uint64)
    values[counted] = (letters[counted] + np.uint64(1)) * _POWERS[place[counted]]
    return np.add.reduceat(values, starts)


def known_ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each hash in ``known``, from 1 on; 0 if it is not there."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[place] == hashes, place + 1, 0)


def often(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The hashes (but 0) that stand in at least ``KNOWN_LINES`` texts, in order."""
    pairs = np.unique(np.stack([hashes, text.astype(np.uint64)]), axis=1)[0]
    found, counts = np.unique(pairs, return_counts=True)
    return found[(counts >= KNOWN_LINES) & (found != 0)]


@dataclass(frozen=True)
class SecretModel:
    own: np.ndarray  # by shape and tag, as the others
    left: np.ndarray
    right: np.ndarray
    near: np.ndarray
    gap: np.ndarray
    file: np.ndarray
    word: np.ndarray  # by known word, as the next two
    left_word: np.ndarray
    right_word: np.ndarray
    prefix: np.ndarray  # by known prefix
    moves: np.ndarray  # from tag, to tag
    begin: np.ndarray  # tag of the first token
    known_words: np.ndarray  # hashes, in order
    known_prefixes: np.ndarray

    def emissions(self, tokens: Tokens) -> np.ndarray:
        ids = feature_ids(tokens, self.known_words, self.known_prefixes)
        return sum(getattr(self, name)[own] for name, own in ids.items())

    def loss(self, score: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The most that moves can lose when a token's tag is set to outside.

        If the next tag is inside it turns to begin, which also changes its score and the
        move behind it.
        """
        moves, allowed = self.moves, self.moves > FORBIDDEN / 2
        into = min((moves[p, O] - moves[p, x] for x in (B, I) for p in range(3) if allowed[p, x]))
        into = np.where(edge, self.begin[O] - self.begin[B], into)
        out = min(0.0, *(moves[O, y] - moves[x, y] for x in (B, I) for y in (O, B)))
        turned = moves[O, B] - max(moves[B, I], moves[I, I]) + min(0.0, *(moves[B] - moves[I]))
        turned = turned - np.maximum(score[1:, I] - score[1:, B], 0)
        inside_next = ~edge[1:] & (score[1:, I] > FORBIDDEN / 2)
        out = np.r_[np.where(inside_next, np.minimum(turned, out), out), out]
        return 1e-9 - into - out

    def decode(self, tokens: Tokens) -> np.ndarray:
        """Best tag sequence of every text, by Viterbi."""
        n = len(tokens.shape)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        score = self.emissions(tokens)
        edge = np.r_[True, tokens.text[1:] != tokens.text[:-1]]
        sure = score[:, O] - score[:, 1:].max(1) > self.loss(score, edge)
        unsure = np.flatnonzero(~sure)
        if not len(unsure):
            return tags
        cut = np.r_[True, (np.diff(unsure) > 1) | edge[unsure[1:]]]
        heads = np.flatnonzero(cut)
        sizes = np.diff(np.r_[heads, len(unsure)])
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = unsure[heads[order]], sizes[order]
        first = np.where(edge[heads][:, None], self.begin, self.moves[O])
        best = first + score[heads]
        back: list[np.ndarray] = []
        for step in range(1, int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step))  # pieces longer than step come first
            ways = best[:live, :, None] + self.moves
            back.append(ways.argmax(1).astype(np.int8))
            best[:live] = ways.max(1) + score[heads[:live] + step]
        last = heads + sizes - 1
        stops = last + 1 < n
        stops[stops] = ~edge[last[stops] + 1]
        best += np.where(stops[:, None], self.moves[:, O], 0)
        tag = best.argmax(1)
        for step in range(int(sizes[0]) - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -step))
            tags[heads[:live] + step] = tag[:live]
            if step:
                tag[:live] = back[step - 1][np.arange(live), tag[:live]]
        return tags


def feature_ids(tokens: Tokens, words: np.ndarray, prefixes: np.ndarray) -> dict[str, np.ndarray]:
    """The model's features of every token."""
    edge = np.r_[True, tokens.text[1:] != tokens.text[:-1]]
    return {
        "own": tokens.shape,
        "left": np.where(edge, EDGE, np.r_[EDGE, tokens.shape[:-1]]),
        "right": np.where(np.r_[edge[1:], True], EDGE, np.r_[tokens.shape[1:], EDGE]),
        "near": tokens.near,
        "gap": tokens.gap,
        "file": tokens.file[tokens.text],
        "word": known_ids(tokens.word, words),
        "left_word": known_ids(tokens.left_word, words),
        "right_word": known_ids(tokens.right_word, words),
        "prefix": known_ids(tokens.prefix, prefixes),
    }


def fit(texts: list[str], marked: list[list[tuple[int, int]]], steps: int = 100) -> SecretModel:
    """Maximise the penalised likelihood of texts whose secrets are the ``marked`` spans."""
    tokens = tokenize(texts)
    n, longest = len(texts), int(np.bincount(tokens.text).max())
    place = np.arange(len(tokens.text)) - np.searchsorted(tokens.text, np.arange(n))[tokens.text]
    gold = np.zeros((n, longest), np.int64)
    for i, spans in enumerate(marked):
        own = np.flatnonzero(tokens.text == i)
        for start, end in spans:
            inside = own[(tokens.start[own] >= start) & (tokens.end[own] <= end)]
            gold[i, place[inside]] = I
            gold[i, place[inside[:1]]] = B
    filled = np.zeros((n, longest), bool)
    filled[tokens.text, place] = True
    words, prefixes = often(tokens.word, tokens.text), often(tokens.prefix, tokens.text)
    weights = {
        **{name: np.zeros((len(words) + 1, 3)) for name in ("word", "left_word", "right_word")},
        "prefix": np.zeros((len(prefixes) + 1, 3)),
        "own": np.zeros((N_TOKENS, 3)), "left": np.zeros((N_TOKENS, 3)), "right": np.zeros((N_TOKENS, 3)),
        "near": np.zeros((N_NEAR, 3)), "gap": np.zeros((2, 3)), "file": np.zeros((N_FILE, 3)), "moves": np.zeros((3, 3)), "begin": np.zeros(3),
    }
    weights["moves"][O, I] = weights["begin"][I] = weights["gap"][1, I] = FORBIDDEN  # no secret holds a gap
    features = feature_ids(tokens, words, prefixes)
    target = np.eye(3)[gold]
    speed = {k: np.zeros_like(v) for k, v in weights.items()}
    power = {k: np.zeros_like(v) for k, v in weights.items()}

    def total(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        flat = sum(weights[k][ids] for k, ids in features.items())
        score = np.zeros((n, longest, 3))
        score[tokens.text, place] = flat
        moves = weights["moves"]
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = weights["begin"] + score[:, 0]
        for t in range(1, longest):
            new = total(forward[:, t - 1, :, None] + moves, 1) + score[:, t]
            forward[:, t] = np.where(filled[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = total(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(filled[:, t + 1, None], new, 0)
        evidence = total(forward[:, -1], 1)
        share = np.exp(forward + backward - evidence[:, None, None])
        miss = (target - share)[tokens.text, place]
        slopes = {}
        for k, ids in features.items():
            slopes[k] = np.stack([np.bincount(ids, miss[:, tag], minlength=len(weights[k])) for tag in range(3)], 1)
        both = filled[:, 1:]
        pair = np.exp(
            forward[:, :-1, :, None] + moves + (score + backward)[:, 1:, None, :] - evidence[:, None, None, None]
        )
        seen = target[:, :-1, :, None] * target[:, 1:, None, :]
        slopes["moves"] = ((seen - pair) * both[:, :, None, None]).sum((0, 1))
        slopes["begin"] = (target[:, 0] - share[:, 0]).sum(0)
        for k, w in weights.items():  # Adam
            slope = slopes[k] / n - 2e-4 * np.where(w > FORBIDDEN / 2, w, 0)
            slope[w <= FORBIDDEN / 2] = 0
            speed[k] = 0.9 * speed[k] + 0.1 * slope
            power[k] = 0.99 * power[k] + 0.01 * slope**2
            w += 0.15 * (speed[k] / (1 - 0.9**step)) / (np.sqrt(power[k] / (1 - 0.99**step)) + 1e-8)
    return SecretModel(**weights, known_words=words, known_prefixes=prefixes)


def labelled_lines(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Generated lines with the spans of their secrets; half of them hold none."""
    rng = random.Random(seed)
    syllables = "an be ca do er fi go he in jo ka le mi no or pa qu re st ti un ve wa xi yo zu th ing ion".split()
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def word() -> str:
        made = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
        return rng.choice((made, made, made, made.capitalize(), made.upper(), made + rng.choice(".,;:!?")))

    def bare() -> str:
        return word().strip(".,;:!?")

    def plain() -> str:
        kind = rng.randrange(24)
        if kind == 0:
            return "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 19)))
        if kind == 1:
            return f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.test.com".lower()
        if kind == 2:
            return f"https://{bare().lower()}.test/{rng.randint(1, 999)}?page={rng.randint(1, 9)}"
        if kind == 3:
            return rng.choice("| = : ### %%% &&& *** !! - + () {} [] <b> // \\".split())
        if kind == 4:
            return f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        if kind == 5:
            return f"{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}"
        if kind == 6:
            return rng.choice(("the key", "an access road", "token = none", "private garden", "a secret", "Password:"))
        if kind == 7:
            return f"{word()}_{word()}({word()}) = {rng.randint(0, 99999)};"
        if kind == 8:
            return " ".join([word()] * rng.randint(2, 4))
        if kind in (9, 10):  # long prose words joined by hyphens, also behind a cue
            made = "-".join(bare().lower() for _ in range(rng.randint(2, 5)))
            return rng.choice(("", "the key ", "a secret ", "access to ", "token ")) + made
        if kind == 11:
            return rng.choice(("", "src/", "/usr/", "../")) + "/".join(bare().lower() for _ in range(rng.randint(2, 5))) + rng.choice((".py", ".java", "", ".json"))
        if kind == 12:
            return "_".join(bare().lower() for _ in range(rng.randint(2, 6)))
        if kind == 13:
            return "".join(bare().capitalize() for _ in range(rng.randint(2, 4)))
        if kind == 14:
            return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z"
        if kind == 15:
            return f"{bare().lower()}-{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"
        if kind == 16:
            cue = rng.choice(("password", "token", "secret", "api key", "access key"))
            return rng.choice((f"the {cue} was {bare()}", f"your {cue} is required", f"{cue} of the {bare()}", f"reset {cue}"))
        if kind == 17:
            return " ".join(bare().upper() for _ in range(rng.randint(1, 4)))
        return word()

    def letters(n: int, more: str = "") -> str:
        return "".join(rng.choice(base64 + more) for _ in range(n))

    def provider() -> str:
        """A token that its first letters give away."""
        kind = rng.randrange(7)
        if kind == 0:
            return rng.choice(("ghp_", "gho_", "ghs_", "github_pat_")) + letters(rng.randint(30, 40))
        if kind == 1:
            return rng.choice(("sk_live_", "sk_test_", "pk_live_", "rk_live_")) + letters(rng.randint(20, 32))
        if kind == 2:
            return f"{rng.choice(('xoxb', 'xoxp', 'xapp'))}-{rng.randint(10**10, 10**12)}-{rng.randint(10**10, 10**12)}-{letters(24)}"
        if kind == 3:
            return "AIza" + letters(35, "_-")
        if kind == 4:
            return rng.choice(("glpat-", "npm_", "hf_", "sk-")) + letters(rng.randint(20, 40))
        if kind == 5:
            return f"eyJ{letters(rng.randint(16, 30))}.eyJ{letters(rng.randint(20, 44))}.{letters(rng.randint(30, 43), '_-')}"
        return "SG." + letters(22) + "." + letters(43)

    def secret() -> str:
        kind = rng.randrange(8)
        if kind == 7:  # short runs parted by marks
            made = list(letters(40))
            for _ in range(rng.randint(1, 4)):
                made[rng.randint(3, 38)] = rng.choice("//+")
            return "".join(made)
        if kind == 0:
            return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((24, 32, 40, 64))))
        if kind == 1:
            return provider()
        if kind == 2:
            return "AKIA" + "".join(rng.choice(base64[:26] + base64[52:]) for _ in range(16))
        if kind == 3:
            return ".".join("".join(rng.choice(base64) for _ in range(rng.randint(16, 44))) for _ in range(3))
        if kind in (4, 5):
            return "".join(rng.choice(base64 + "+/") for _ in range(rng.randint(28, 44))) + rng.choice(("", "=", "=="))
        return "".join(rng.choice(base64 + "._-") for _ in range(rng.randint(14, 24))) + str(rng.randint(10, 99)) + "Qx"

    cues = (
        "password passwd secret token api_key apikey auth_token private_key access_key Authorization client_secret "
        "AWS_SECRET_ACCESS_KEY SECRET_KEY DB_PASSWORD GITHUB_TOKEN key"
    )
    texts, marked = [], []
    for i in range(n):
        parts, spans = [], []
        parts.append(" ".join(plain() for _ in range(rng.randint(0, 6))))
        if i % 8 == 1:  # a provider's token without a cue
            text = " ".join(filter(None, parts))
            text += " " * bool(text) + rng.choice(("", "", "use ", "(", '"'))
            value = provider()
            spans.append((len(text), len(text) + len(value)))
            text += value + rng.choice(("", ")", '"', " " + plain(), " " + plain()))
        elif i % 2:
            cue = rng.choice(cues.split())
            cue = rng.choice((cue, cue.upper(), cue.capitalize(), f"my_{cue}"))
            lead = rng.choice((' = "', "=", ": ", " = '", '": "', " is ", ": Bearer ", ":", " = ", " "))
            text = " ".join([*filter(None, parts), cue]) + lead
            value = secret()
            spans.append((len(text), len(text) + len(value)))
            text += value + ('"' if '"' in lead else "'" if "'" in lead else "")
            text += " " + " ".join(plain() for _ in range(rng.randint(0, 4)))
        else:
            text = " ".join([*parts, *(plain() for _ in range(rng.randint(1, 6)))])
        texts.append(text)
        marked.append(spans)
    return texts, marked


#: labelled lines the model is fitted on
LABELLED = 1200


@cache
def own_model() -> SecretModel:
    return fit(*labelled_lines(LABELLED, seed=11))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(cue in lower for cue in ASSIGN_CUES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def spans(texts: list[str | None], model: SecretModel) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of every text by start, then kind; code points, end exclusive."""
    texts = [t or "" for t in texts]
    found = [base_spans(t) for t in texts]
    tokens = tokenize(texts)
    tags = model.decode(tokens)
    starts = np.flatnonzero(tags == B)
    outer = np.flatnonzero(np.r_[tags != I, True])
    stops = outer[np.searchsorted(outer, starts, side="right")] - 1
    for text, start, end in zip(
        tokens.text[starts].tolist(), tokens.start[starts].tolist(), tokens.end[stops].tolist(), strict=True
    ):
        stop = RUN.match(texts[text], end).end()
        if stop - start >= LEARNED_CHARS and all(s > start or e < stop for kind, s, e in found[text] if kind != "learned"):
            found[text].append(("learned", start, stop))
    for own in found:
        own.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return found


def find(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every document as an array of (kind, start, end)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("secrets")
        for batch in batches:
            for rows in slices(batch, 1, ROWS, BYTES):
                found = spans(rows.column(1).to_pylist(), held.value)
                listed = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(listed, SPANS)], names=[id_col, "found"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"`{id_col}` {sql_type(docs, id_col)}, found {kind}")


def hide(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, overlapping ones together, replaced by ``<SECRET>``."""
    parts, at = [], 0
    for _, start, end in found:
        if start >= at:
            parts += [text[at:start], "<SECRET>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All documents, with secrets hidden in the text and ``size_col``, if there, kept true."""
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("secrets")
        for batch in batches:
            for rows in slices(batch, at, ROWS, BYTES):
                columns, texts = rows.columns, rows.column(at).to_pylist()
                sizes = [] if size_at is None else rows.column(size_at).to_pylist()
                for i, found in enumerate(spans(texts, held.value)):
                    if found:
                        texts[i] = hide(texts[i], found)
                        if size_at is not None:
                            sizes[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if size_at is not None:
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_whole(docs, run)
