"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and cut into runs of letters; the n-grams of every run, its ends marked,
are hashed to buckets. The scores are a linear function of the mean of the buckets' embeddings.
The model is trained by stochastic gradient descent in NumPy on a bounded sample of labelled
texts, drawn by a hash of the text: ``PER_LANG`` distinct texts a language of the ``MAX_LANGS``
most frequent ones and ``MAX_SAMPLE`` in all, each as a whole and as two excerpts, with at most
``MAX_GRAMS`` buckets an example. Every fifth text of the sample is kept back to fit the
temperature of the softmax and the score under which a prediction counts as rejected.
Predictions read whole texts where they lie; nothing is shuffled.

Defined results: a null text, a text without letters, and every text if nothing could be
learned, is ``und`` with score 0 and rejected. A null label teaches nothing, an empty one is a
language like any other. Of equal scores the first language in order wins. Repeated rows each
get a row, very long texts are read in blocks, a null id stays null; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.llm.common import ROWS, claim, map_rows, sql_type

UNKNOWN = "und"
#: lengths of n-grams
SIZES = (2, 3, 4)
BITS = 15
#: numbers in an embedding
WIDTH = 16
#: bounds of the sample: texts a language, languages, texts in all, buckets an example
PER_LANG = 400
MAX_LANGS = 200
MAX_SAMPLE = 4000
MAX_GRAMS = 4096
#: words of the excerpts that teach beside the whole text, so that short texts are not new
EXCERPTS = (4, 20)
EPOCHS = 5
RATE = 2.0
#: a wrong prediction that is accepted costs as much as so many right ones that are rejected
WRONG_COST = 4
#: characters read together; longer texts are cut into blocks of it
BLOCK = 1 << 18
#: the scores' table holds multiples of this, so that sums do not depend on their order
GRAIN = 2.0**-20


@cache
def letters() -> np.ndarray:
    """For each code point its number in lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if (char := chr(point)).isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def codes_of(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def grams(codes: np.ndarray, n_starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the n-grams of each size that start in the first ``n_starts`` codes.

    Only the first and the last code of an n-gram may be 0, which marks the end of a run.
    """
    wide = codes.astype(np.uint64)
    letter = codes != 0
    for size in SIZES:
        n = min(n_starts, len(codes) - size + 1)
        if n <= 0:
            continue
        good = letter[1 : 1 + n].copy() if size > 2 else letter[:n] | letter[1 : 1 + n]
        for i in range(2, size - 1):
            good &= letter[i : i + n]
        starts = np.flatnonzero(good)
        code = np.full(len(starts), size, np.uint64)
        for i in range(size):
            code = (code * np.uint64(0x100000001B3)) ^ wide[starts + i]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0x9E3779B97F4A7C15)
        yield starts, (code >> np.uint64(64 - BITS)).astype(np.int64)


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, start of each piece, codes) of pieces that are read together.

    A piece is a text with a 0 before it, or a block of a long text with the codes behind it
    that its last n-grams need.
    """
    owners: list[int] = []
    pieces: list[np.ndarray] = []
    held = 0

    def ready():
        sizes = [len(p) for p in pieces]
        return np.array(owners), np.cumsum([0, *sizes[:-1]]), np.concatenate(pieces)

    for number, text in enumerate(texts):
        if not text:
            continue
        codes = np.concatenate([np.zeros(1, np.uint32), codes_of(text)])
        if held + len(codes) > BLOCK and pieces:
            yield ready()
            owners, pieces, held = [], [], 0
        if len(codes) <= BLOCK:
            owners.append(number)
            pieces.append(codes)
            held += len(codes)
            continue
        for start in range(0, len(codes), BLOCK):  # the overlap's own n-grams are the next block's
            yield np.array([number]), np.array([0, BLOCK]), codes[start : start + BLOCK + max(SIZES) - 1]
    if pieces:
        yield ready()


def bucket_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram of every text, in parts."""
    for owners, starts, codes in blocks(texts):
        n_starts = len(codes)
        if len(starts) > len(owners):
            n_starts = int(starts[-1])
            starts = starts[:-1]
        codes = np.concatenate([codes, np.zeros(max(SIZES) - 1, np.uint32)])
        for at, bucket in grams(codes, n_starts):
            yield owners[np.searchsorted(starts, at, side="right") - 1], bucket


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: score of each bucket for each language: embeddings times the softmax's weights
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    #: predictions with a lower score are rejected
    threshold: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated scores of each language, and the number of n-grams of each text."""
        total = np.zeros((len(texts), len(self.languages)))
        number = np.zeros(len(texts), np.int64)
        for owner, bucket in bucket_counts(texts):
            number += np.bincount(owner, minlength=len(texts))
            for column in range(len(self.languages)):
                total[:, column] += np.bincount(owner, self.table[bucket, column], minlength=len(texts))
        return total / np.maximum(number, 1)[:, None] + self.bias, number

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, number = self.logits(texts)
        share = softmax(logits / self.temperature)
        best, known = share.argmax(1), number > 0
        score = np.where(known, share[np.arange(len(texts)), best], 0.0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, score, ~known | (score < self.threshold)


def softmax(logits: np.ndarray) -> np.ndarray:
    power = np.exp(logits - logits.max(1, keepdims=True))
    return power / power.sum(1, keepdims=True)


@dataclass(frozen=True)
class Example:
    language: int
    #: which text of the sample it comes from
    text: int
    buckets: np.ndarray
    #: their shares of the n-grams
    shares: np.ndarray


def calibrate(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Temperature of the least log loss, and the least score to accept at the least cost."""
    if not len(truth):
        return 1.0, 0.0
    rows = np.arange(len(truth))
    loss = {
        t: -np.log(np.maximum(softmax(logits / t)[rows, truth], 1e-12)).mean()
        for t in np.exp2(np.linspace(-4, 4, 33)).tolist()
    }
    temperature = min(loss, key=loss.get)
    share = softmax(logits / temperature)
    score, right = share.max(1), share.argmax(1) == truth
    order = np.argsort(score, kind="stable")
    # cost of rejecting the n lowest scores, for each n
    cost = np.cumsum(np.r_[WRONG_COST * (~right).sum(), np.where(right[order], 1, -WRONG_COST)])
    n = int(np.flatnonzero(cost == cost.min())[0])
    return temperature, float(score[order[n]]) if n < len(order) else 1.0


def fit(examples: list[Example], languages: list[str]) -> LanguageModel:
    """Embeddings and softmax weights by stochastic gradient descent over ``examples``."""
    rng = np.random.default_rng(1)
    embeddings = rng.normal(0.0, 1.0, (1 << BITS, WIDTH)).astype(np.float32)
    weights = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    kept_back = [x for x in examples if x.text % 5 == 4]
    teaching = [x for x in examples if x.text % 5 != 4]
    steps = EPOCHS * len(teaching)
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(teaching)).tolist():
            example = teaching[i]
            own = embeddings[example.buckets]
            mean = example.shares @ own
            # a step that no length of the mean or the weights makes too long
            rate = RATE * (1 - done / steps) / (1 + mean @ mean + np.square(weights).sum() * (example.shares @ example.shares))
            power = mean @ weights + bias
            power = np.exp(power - power.max())
            error = power / power.sum()
            error[example.language] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.01 * rate * error
            embeddings[example.buckets] = own - (rate * example.shares)[:, None] * back
            done += 1
    table = np.round((embeddings.astype(float) @ weights) / GRAIN) * GRAIN
    logits = np.array([x.shares.astype(float) @ table[x.buckets] + bias for x in kept_back]).reshape(-1, len(languages))
    temperature, threshold = calibrate(logits, np.array([x.language for x in kept_back], int))
    return LanguageModel(languages, table, bias.astype(float), temperature, threshold)


def excerpts(text: str) -> list[str]:
    """The text, and from places that its checksum gives, runs of ``EXCERPTS`` words."""
    words = text.split()
    place = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    found = [text]
    for n in EXCERPTS:
        if len(words) > n:
            start = place % (len(words) - n + 1)
            found.append(" ".join(words[start : start + n]))
    return found


def sample(labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """lang, place and text of the bounded sample, and the languages, of (lang, text) rows."""
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    each = min(PER_LANG, MAX_SAMPLE // max(1, len(counts)))
    # twice as many as wanted by a limit on the hash; copies are dropped before any are ranked
    limits = [(r["lang"], min(1.0, 2.0 * each / r["count"]) * (1 << 31)) for r in counts]
    limits = labelled.sparkSession.createDataFrame(limits, "lang string, most double")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 31))
    drawn = (
        labelled.withColumn("place", place)
        .join(F.broadcast(limits), "lang")
        .filter(F.col("place") < F.col("most"))
        .select("lang", "place", "text")
        .distinct()
    )
    order = Window.partitionBy("lang").orderBy("place", "text")
    ranked = drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each)
    return ranked, sorted(r["lang"] for r in counts)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the languages in ``lang_col``, from texts and labels alone."""
    labelled = docs.select(
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    ranked, languages = sample(labelled)

    def count(rows):
        out = {"lang": [], "rank": [], "part": [], "buckets": [], "counts": []}
        for lang, rank, text in zip(rows["lang"], rows["rank"], rows["text"], strict=True):
            for part, excerpt in enumerate(excerpts(text)):
                total = np.zeros(1 << BITS, np.int64)
                for _, bucket in bucket_counts([excerpt]):
                    total += np.bincount(bucket, minlength=1 << BITS)
                kept = np.sort(np.argsort(-total, kind="stable")[: min(MAX_GRAMS, np.count_nonzero(total))])
                values = (lang, rank, part, kept.astype("<u2").tobytes(), total[kept].astype("<u4").tobytes())
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        return out

    schema = "lang string, rank int, part int, buckets binary, counts binary"
    rows = map_rows(ranked, ["lang", "rank", "text"], count, schema).collect()  # bounded by the sample
    number = {name: i for i, name in enumerate(languages)}
    examples = []
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"], r["part"])):
        counts = np.frombuffer(row["counts"], "<u4").astype(np.float32)
        if len(counts):
            buckets = np.frombuffer(row["buckets"], "<u2").astype(np.int64)
            examples.append(Example(number[row["lang"]], row["rank"], buckets, counts / counts.sum()))
    learned = sorted({x.language for x in examples})
    names = [languages[i] for i in learned]
    examples = [Example(learned.index(x.language), x.text, x.buckets, x.shares) for x in examples]
    return fit(examples, names) if names else LanguageModel([], np.zeros((0, 0)), np.zeros(0), 1.0, 1.0)


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """lang_pred, score and rejected of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = sql_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                names, score, rejected = held.value.predict(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                    names=[id_col, "lang_pred", "score", "rejected"],
                )

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
