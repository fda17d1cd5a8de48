"""Best-fit packing of token sequences by length patterns.

Texts become token ids once, in a table in the shared folder that also holds every piece's
rank among the pieces of its length in its partition. The histogram of piece lengths, which
has one bin per length, is planned on the driver: patterns of up to three lengths that fill
a sequence are enumerated on bins of ``BIN`` tokens, their repeat counts are fitted to the
histogram by non-negative least squares and rounded, each repeat takes real lengths of its
bins, the last one to fill the gap, and the pieces left over go best-fit, longest first, into the gaps and into new
sequences. The plan lists runs of equal ranks, so its size depends on the number of lengths
and not on the number of documents; a piece finds its place from its length and rank.

Defined results: a null or empty text is one piece of the end id alone; repeated rows and
rows with a null id are packed one by one; equal lengths are told apart by rank; other columns
play no part; an empty table gives no sequences.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.llm.common import ROWS, claim, slices, sql_type, stored
from gridvigil.llm.tokens import encoder

CAPACITY = 2048
#: tokens per bin of the fit
BIN = 16
#: rounds of the fit; each lets in some new patterns
ROUNDS = 120
#: rows of a table of offsets that may be broadcast (28 bytes each)
MAX_OFFSETS = 500_000


def few_document_patterns(n_bins: int) -> np.ndarray:
    """Bins (1-based, 0 for none) of one to three pieces that fill ``n_bins`` together."""
    a, b = np.meshgrid(np.arange(1, n_bins + 1), np.arange(n_bins + 1), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = n_bins - a - b
    good = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a, b, c], 1)[good]


def fit_counts(patterns: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative counts x that bring the patterns' bins near ``target``, by least squares.

    Active-set method: patterns of the steepest slope with no bin in common join the set
    together, and a step that would turn counts negative stops where the first becomes zero.
    Short lengths weigh little, for they fit gaps anyway. ``target[0]`` is ignored.
    """
    n_bins = len(target) - 1
    weight = np.where(np.arange(n_bins + 1) >= n_bins // 16, 1.0, 0.1)
    weight[0] = 0.0
    goal = target * weight
    counts = np.zeros(len(patterns))
    active: list[int] = []

    def columns(chosen: list[int]) -> np.ndarray:
        matrix = np.zeros((n_bins + 1, len(chosen)))
        for slot in range(3):
            np.add.at(matrix, (patterns[chosen, slot], np.arange(len(chosen))), 1.0)
        return matrix * weight[:, None]

    for _ in range(ROUNDS):
        reached = np.zeros(n_bins + 1)
        for slot in range(3):
            np.add.at(reached, patterns[:, slot], counts)
        left = (goal - reached * weight) * weight
        slope = left[patterns].sum(1)
        slope[active] = 0.0
        taken: set[int] = set()
        new = []
        for i in np.argsort(-slope)[: 16 * n_bins].tolist():
            if slope[i] <= 1e-6 * max(goal.max(), 1.0) or len(new) >= 24:
                break
            own = set(patterns[i].tolist()) - {0}
            if not own & taken:
                taken |= own
                new.append(i)
        if not new:
            break
        active += new
        while True:
            matrix = columns(active)
            square = matrix.T @ matrix + 1e-9 * np.eye(len(active))
            wanted = np.linalg.solve(square, matrix.T @ goal)
            if (wanted > 0).all():
                counts[active] = wanted
                break
            now = counts[active]
            falling = wanted <= 0
            step = min(1.0, (now[falling] / np.maximum(now[falling] - wanted[falling], 1e-12)).min())
            now = now + step * (wanted - now)
            stay = now > 1e-9
            counts[active] = np.where(stay, now, 0.0)
            active = [i for i, s in zip(active, stay.tolist(), strict=True) if s]
            if not active:
                break
    return counts


def plan_patterns(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(repeats, piece lengths) that use up ``histogram[length]`` pieces exactly."""
    rest = histogram.astype(np.int64).copy()
    width = BIN if capacity % BIN == 0 else 1
    n_bins = capacity // width
    bin_of = (np.arange(capacity + 1) + width - 1) // width
    plan: list[tuple[int, list[int]]] = [(int(rest[capacity]), [capacity])] if rest[capacity] else []
    rest[capacity] = 0
    patterns = few_document_patterns(n_bins)
    target = np.bincount(bin_of, rest, minlength=n_bins + 1)
    target[0] = 0
    counts = fit_counts(patterns, target)
    open_at: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)

    def longest(most: int, number: int) -> int:
        """The longest length up to ``most``, from bin ``number`` on, that is left, or 0."""
        for length in range(most, (number - 1) * width, -1):
            if rest[length]:
                return length
        return 0

    for i in np.argsort(-counts, kind="stable"):
        repeats = int(counts[i] + 0.5)
        if not repeats:
            break
        bins = [int(b) for b in patterns[i] if b]
        while repeats > 0:
            lengths: list[int] = []
            for b in bins:  # the last piece must fill the gap; else the rest is packed below
                gap = capacity - sum(lengths)
                found = longest(gap if len(lengths) + 1 == len(bins) else b * width, b)
                if not found:
                    break
                lengths.append(found)
                rest[found] -= 1  # so that a second piece of this length is there too
            if len(lengths) < len(bins) or sum(lengths) < capacity:
                for x in lengths:
                    rest[x] += 1
                break
            times = 1 + min(repeats - 1, *(int(rest[x]) // lengths.count(x) for x in lengths))
            for x in lengths:
                rest[x] -= times - 1
            open_at[capacity - sum(lengths)].append((times, lengths))
            repeats -= times

    for length in range(capacity, 0, -1):
        gap = length
        while rest[length] and gap <= capacity:
            if not open_at[gap]:
                gap += 1
                continue
            times, lengths = open_at[gap].pop()
            copies = min(gap // length, int(rest[length]))
            used = min(times, int(rest[length]) // copies)
            if used < times:
                open_at[gap].append((times - used, lengths))
            open_at[gap - copies * length].append((used, lengths + [length] * copies))
            rest[length] -= used * copies
        copies = capacity // length
        for times, many in ((int(rest[length]) // copies, copies), (1, int(rest[length]) % copies)):
            if times and many:
                open_at[capacity - many * length].append((times, [length] * many))
        rest[length] = 0
    return plan + [group for gap in sorted(open_at) for group in open_at[gap]]


class Places:
    """Runs of ranks of each length: (first rank, first sequence, offset)."""

    def __init__(self, plan: list[tuple[int, list[int]]]):
        used: dict[int, int] = defaultdict(int)
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        sequence = 0
        for repeats, lengths in plan:
            offset = 0
            for length in lengths:
                runs[length].append((used[length], sequence, offset))
                used[length] += repeats
                offset += length
            sequence += repeats
        self.n_sequences = sequence
        self.runs = {length: tuple(np.array(x, np.int64).T) for length, x in runs.items()}

    def find(self, length: int, rank: int) -> tuple[int, int]:
        """Sequence and offset of the piece of ``length`` with ``rank``."""
        first, sequence, offset = self.runs[length]
        run = int(np.searchsorted(first, rank, side="right")) - 1
        return int(sequence[run] + rank - first[run]), int(offset[run])


def ranked_tokens(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Ids of every document and its pieces' ranks by length in their partition, as a table."""

    def run(batches):
        claim("tokens")
        coder = encoder(path)
        end = np.array([end_id], coder.dtype).tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch, 1):
                ids = [x + end for x in coder.encode(rows.column(1).to_pylist())]
                sizes = [len(x) // coder.dtype.itemsize for x in ids]
                firsts, first_ranks, full_ranks = [], [], []
                for size in sizes:
                    full = (size - 1) // capacity
                    first = size - full * capacity
                    firsts.append(first)
                    first_ranks.append(int(seen[first]))
                    seen[first] += 1
                    full_ranks.append(int(seen[capacity]))
                    seen[capacity] += full
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()),
                        pa.array([part] * len(ids), pa.int32()), pa.array(firsts, pa.int32()),
                        pa.array(first_ranks, pa.int64()), pa.array(full_ranks, pa.int64()),
                    ],
                    names=["id", "ids", "size", "part", "first", "first_rank", "full_rank"],
                )

    schema = (
        f"id {sql_type(docs, id_col)}, ids binary, size long, part int, first int, first_rank long, full_rank long"
    )
    return stored(docs.select(id_col, text_col).mapInArrow(run, schema), "tokens")


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, sequence_id, offset, and ``ids``, the
    piece's ids as little-endian unsigned 32-bit numbers.

    ``path`` is a file of the tokenizers library. A document longer than ``capacity`` is cut
    into pieces of it, of which the first may be shorter.
    """
    tokens = ranked_tokens(docs, path, end_id, capacity, id_col, text_col)
    counted = tokens.groupBy("part", F.col("first").alias("length")).agg(F.count("*").alias("n"))
    full = tokens.groupBy("part", F.lit(capacity).alias("length")).agg(
        F.sum(F.floor((F.col("size") - 1) / capacity)).alias("n")
    )
    # a row for each partition and length; the offset is how many stand in earlier partitions
    by_part = stored(counted.unionByName(full).groupBy("part", "length").agg(F.sum("n").alias("n")), "lengths")
    total = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length
    histogram = np.zeros(capacity + 1, np.int64)
    for row in total:
        histogram[row["length"]] = row["n"]
    places = Places(plan_patterns(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    first = offsets.select("part", F.col("length").alias("first"), F.col("before").alias("first_before"))
    whole = offsets.filter(F.col("length") == capacity).select("part", F.col("before").alias("full_before"))
    both = first.join(whole, "part")
    if by_part.limit(MAX_OFFSETS + 1).count() <= MAX_OFFSETS:
        both = F.broadcast(both)
    placed = tokens.join(both, ["part", "first"]).select(
        "id", "ids", "size", "first", (F.col("first_rank") + F.col("first_before")).alias("a"),
        (F.col("full_rank") + F.col("full_before")).alias("b"),
    )
    held = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        claim("packing")  # ids are there, so the tokenizer goes
        find = held.value.find
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS).to_pylist()
                out = {k: [] for k in ("id", "piece", "start", "length", "sequence_id", "offset", "ids")}
                for row in rows:
                    ids = np.frombuffer(row["ids"], f"<u{len(row['ids']) // row['size']}").astype("<u4")
                    start, length, rank = 0, row["first"], row["a"]
                    piece = 0
                    while start < len(ids):
                        sequence, offset = find(length, rank)
                        piece_ids = ids[start : start + length].tobytes()
                        values = (row["id"], piece, start, length, sequence, offset, piece_ids)
                        for column, value in zip(out.values(), values, strict=True):
                            column.append(value)
                        start += length
                        length, rank = capacity, row["b"] + piece
                        piece += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(v, t)
                        for v, t in zip(
                            out.values(),
                            (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()),
                            strict=True,
                        )
                    ],
                    names=[id_col, *list(out)[1:]],
                )

    schema = (
        f"`{id_col}` {sql_type(docs, id_col)}, piece int, start long, length long, sequence_id long, offset long, ids binary"
    )
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: ids of each and the documents in it, in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", id_col, "piece", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"),
        F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
    )
