"""Token files compressed by Re-Pair grammars.

Documents are dealt out in ranges of ascending id and encoded; every range is cut into
shards of a bounded number of ids. In a shard the most frequent pairs of neighbouring
symbols are replaced by new symbols, again and again; pairs do not reach over a document's
end, so each document is a stretch of the compressed sequence. A shard file holds the rules,
how many ids each symbol stands for, and the documents' places, so any document, or any
stretch of ids, is decoded without the rest.

File format (little-endian): ``RPG2``, then unsigned 32-bit numbers: part, shard, number of
documents, of terminals, of rules, of symbols; then per document id (signed 64-bit), a byte
that is 1 where the id is null, first symbol (64-bit) and number of ids (64-bit); per terminal
its id (32-bit); per rule its two symbols (32-bit) and the number of ids it stands for (32-bit);
and the symbols (16-bit, or 32-bit where there are more than 65536 of them): first the
terminals, which are the ids that the shard holds, then the rules. A line feed ends the file.

Defined results: a null or empty text is the end id alone; documents of equal id are stored
one by one, null ids first; other columns play no part; an empty table gives no files. Ids
are whole numbers; others are a TypeError. A text of any length lies in one shard.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.llm.common import ROWS, claim, read_blobs, shared_folder, slices, sql_type, whole_number_ids, write_blobs
from gridvigil.llm.tokens import encoder

MAGIC = b"RPG2"
HEADER = "<4s6I"
#: ids from which a shard is closed
SHARD_IDS = 1 << 22
#: most pairs replaced in a round; rounds go on until no pair is frequent
PAIRS_A_ROUND = 3800
#: fewest occurrences that make a pair frequent
MIN_COUNT = 16
_HASH_BITS = 20


def in_buckets(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the pair at each place, and how many places each bucket has. No pair begins at
    one of ``ends``: these have a bucket of their own, which counts as empty."""
    bucket = symbols[:-1] * np.uint32(0x9E3779B1)
    bucket += symbols[1:] * np.uint32(0x85EBCA77)
    bucket >>= np.uint32(32 - _HASH_BITS)
    bucket = bucket.astype(np.int64)
    bucket[ends] = 1 << _HASH_BITS
    sizes = np.bincount(bucket, minlength=(1 << _HASH_BITS) + 1)
    sizes[-1] = 0
    return bucket, sizes


def frequent_pairs(symbols: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(left, right, at, which): frequent pairs, and the places where they stand.

    No pair begins at one of ``ends``. Pairs are counted by hash bucket first; each full bucket stands for one of its pairs,
    which is then counted exactly. A bucket has at least as many places as its pair, so the largest buckets will do
    if enough of their pairs stand as often as the smallest of these buckets has places.
    """
    bucket, sizes = in_buckets(symbols, ends)
    full = sizes[sizes >= MIN_COUNT]
    some = most + most // 2
    if len(full) > some:
        least = int(np.partition(full, len(full) - some)[len(full) - some])
        if least > MIN_COUNT:
            found = _pairs_of(symbols, bucket, sizes >= least, least, most)
            if len(found[0]) == most:
                return found
    return _pairs_of(symbols, bucket, sizes >= MIN_COUNT, MIN_COUNT, most)


def _pairs_of(symbols: np.ndarray, bucket: np.ndarray, full: np.ndarray, least: int, most: int) -> tuple[np.ndarray, ...]:
    """As ``frequent_pairs``, for pairs of the ``full`` buckets that stand ``least`` times or more."""
    at = np.flatnonzero(full[bucket])
    number = np.cumsum(full, dtype=np.int32) - np.int32(1)  # of the full buckets alone, so that the tables below are small
    own = number[bucket[at]]
    left, right = symbols[at], symbols[at + 1]
    place = np.empty(np.count_nonzero(full), np.int64)
    place[own] = np.arange(len(at))
    same = place[own]
    same = (left == left[same]) & (right == right[same])
    own = own[same]
    counts = np.bincount(own, minlength=len(place))
    best = np.flatnonzero(counts >= least)
    best = best[np.argsort(-counts[best], kind="stable")][:most]
    number = np.full(len(place), -1, np.int32)
    number[best] = np.arange(len(best), dtype=np.int32)
    found = number[own]
    chosen = found >= 0
    return left[place[best]], right[place[best]], at[same][chosen], found[chosen]


def all_frequent_pairs(symbols: np.ndarray, ends: np.ndarray, most: int, new: int = 0) -> tuple[np.ndarray, ...]:
    """As ``frequent_pairs``, by sorting all pairs that hold a symbol from ``new`` on; of all symbols,
    those in full buckets."""
    if new:
        fresh = symbols >= new
        inside = fresh[:-1] | fresh[1:]
        inside[ends] = False
    else:
        bucket, sizes = in_buckets(symbols, ends)
        inside = (sizes >= MIN_COUNT)[bucket]
    at = np.flatnonzero(inside)
    pair = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
    names, counts = np.unique(pair, return_counts=True)
    best = np.flatnonzero(counts >= MIN_COUNT)
    names = names[np.sort(best[np.argsort(-counts[best], kind="stable")][:most])]
    if not len(names):
        return (np.empty(0, np.uint32),) * 4
    found = np.minimum(np.searchsorted(names, pair), len(names) - 1)
    chosen = names[found] == pair
    return (names >> np.uint64(32)).astype(np.uint32), names.astype(np.uint32), at[chosen], found[chosen].astype(np.int32)


def compress(ids: np.ndarray, starts: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, first symbol of each document) of documents that begin at ``starts``.

    Rounds go on until no pair stands ``MIN_COUNT`` times. The first ones count by buckets, as
    long as these give as many pairs as a round takes; then all pairs are sorted once. A round
    that takes all frequent pairs leaves none, so from then on only pairs with a symbol of the
    last round are counted.
    """
    symbols = ids.astype(np.uint32)
    first = np.zeros(len(ids), bool)
    first[starts] = True
    rules = [np.empty((0, 2), np.uint32)]
    known, new = terminals, 0
    by_buckets, took_all = True, False
    while len(symbols) > 1:
        ends = np.flatnonzero(first[1:])
        if by_buckets:
            left, right, at, which = frequent_pairs(symbols, ends, PAIRS_A_ROUND)
            by_buckets = len(left) == PAIRS_A_ROUND
        else:
            left, right, at, which = all_frequent_pairs(symbols, ends, PAIRS_A_ROUND, new if took_all else 0)
            took_all = len(left) < PAIRS_A_ROUND
            if not len(left):
                break
        # of overlapping pairs every other one is replaced, from the left
        begin = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        even = (np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))) & 1 == 0
        at, which = at[even], which[even]
        # some pairs have lost all their places to overlapping ones
        used = np.bincount(which, minlength=len(left)) > 0
        number = np.cumsum(used, dtype=np.uint32) + np.uint32(known - 1)
        new = known
        symbols[at] = number[which]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, first = symbols[stay], first[stay]
        rules.append(np.stack([left[used], right[used]], 1))
        known += np.count_nonzero(used)
    return symbols, np.concatenate(rules), np.flatnonzero(first)


def lengths_of(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each symbol stands for; a rule only names symbols before it."""
    found = np.ones(terminals + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        found[terminals + i] = found[a] + found[b]
    return found


@dataclass
class Shard:
    """A shard file; documents and stretches of them are decoded one by one."""

    part: int
    number: int
    terminals: np.ndarray  # ids that occur
    doc_ids: list[int | None]
    first: np.ndarray  # symbol at which each document begins, and the end
    sizes: np.ndarray  # ids of each document
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    @classmethod
    def pack(cls, part: int, number: int, doc_ids: list, texts: list[bytes], dtype: np.dtype, terminals: int):
        sizes = np.array([len(t) // dtype.itemsize for t in texts], np.int64)
        ids = np.frombuffer(b"".join(texts), dtype)
        here = np.zeros(terminals, bool)
        here[ids] = True
        own = np.flatnonzero(here)
        place = np.cumsum(here) - 1
        symbols, rules, first = compress(place[ids], np.cumsum(sizes) - sizes, len(own))
        lengths = lengths_of(rules, len(own))
        return cls(part, number, own, doc_ids, np.r_[first, len(symbols)], sizes, rules, lengths, symbols)

    def to_bytes(self) -> bytes:
        width = np.dtype("<u2" if len(self.lengths) <= 1 << 16 else "<u4")
        head = struct.pack(
            HEADER, 
            MAGIC, self.part, self.number, len(self.doc_ids), len(self.terminals), len(self.rules), len(self.symbols)
        )
        return b"".join(
            [
                head,
                np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(),
                np.array([x is None for x in self.doc_ids], np.uint8).tobytes(),
                self.first[:-1].astype("<u8").tobytes(),
                self.sizes.astype("<u8").tobytes(),
                self.terminals.astype("<u4").tobytes(),
                self.rules.astype("<u4").tobytes(),
                self.lengths[len(self.terminals) :].astype("<u4").tobytes(),
                self.symbols.astype(width).tobytes(),
            ]
        )

    @classmethod
    def from_bytes(cls, data: bytes):
        magic, part, number, n_docs, terminals, n_rules, n_symbols = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a grammar file")
        at = struct.calcsize(HEADER)

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype, count, at)
            at += found.nbytes
            return found

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        first, sizes = take("<u8", n_docs).astype(np.int64), take("<u8", n_docs).astype(np.int64)
        own = take("<u4", terminals)
        rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        lengths = np.r_[np.ones(terminals, np.int64), take("<u4", n_rules).astype(np.int64)]
        symbols = take("<u2" if terminals + n_rules <= 1 << 16 else "<u4", n_symbols)
        doc_ids = [None if n else i for i, n in zip(ids.tolist(), null.tolist(), strict=True)]
        return cls(part, number, own, doc_ids, np.r_[first, n_symbols], sizes, rules, lengths, symbols)

    @cached_property
    def written_out(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' ids one after the other, and where each symbol's begin."""
        begin = np.cumsum(self.lengths) - self.lengths
        flat = np.empty(int(self.lengths.sum()), np.uint32)
        flat[: len(self.terminals)] = self.terminals
        starts, sizes = begin.tolist(), self.lengths.tolist()
        for i, (a, b) in enumerate(self.rules.tolist(), len(self.terminals)):
            at, cut = starts[i], starts[i] + sizes[a]
            flat[at:cut] = flat[starts[a] : starts[a] + sizes[a]]
            flat[cut : cut + sizes[b]] = flat[starts[b] : starts[b] + sizes[b]]
        return flat, begin

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self.written_out
        sizes = self.lengths[symbols]
        ends = np.cumsum(sizes)
        place = np.repeat(begin[symbols] - ends + sizes, sizes)
        place += np.arange(len(place))
        return flat[place]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the ``i``-th document; only symbols that hold them are expanded."""
        own = self.symbols[self.first[i] : self.first[i + 1]]
        stop = int(self.sizes[i]) if stop is None else min(stop, int(self.sizes[i]))
        if start <= 0 and stop == self.sizes[i]:
            return self.expand(own)
        ends = np.cumsum(self.lengths[own])
        low = int(np.searchsorted(ends, start, side="right"))
        high = int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[low - 1]) if low else 0
        return self.expand(own[low:high])[start - before : max(stop - before, 0)]


def write(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all documents as shard files, in ascending id order; the folder's path."""

    def run(batches):
        claim("tokens")
        coder = encoder(path)
        end = np.array([end_id], coder.dtype).tobytes()
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        texts: list[bytes] = []
        waiting = 0

        def shard() -> pa.RecordBatch:
            made = Shard.pack(part, number, doc_ids, texts, coder.dtype, coder.size)
            return pa.RecordBatch.from_arrays([pa.array([made.to_bytes()], pa.binary())], names=["content"])

        for batch in batches:
            for rows in slices(batch, 1):
                own = [x + end for x in coder.encode(rows.column(1).to_pylist())]
                for doc_id, ids in zip(rows.column(0).to_pylist(), own, strict=True):
                    doc_ids.append(doc_id)
                    texts.append(ids)
                    waiting += len(ids) // coder.dtype.itemsize
                    if waiting >= SHARD_IDS:
                        yield shard()
                        number, waiting = number + 1, 0
                        doc_ids, texts = [], []
        if doc_ids:
            yield shard()

    whole_number_ids(docs, id_col)
    folder = shared_folder(docs.sparkSession, "grammar")
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), text_col).repartitionByRange("id").sortWithinPartitions("id")
    write_blobs(ordered.mapInArrow(run, "content binary"), "content", folder, per_file=1, end="\n")
    return folder


def read(docs_like: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per stored document: id, start (ids of all documents before it), n_tokens and
    ``ids`` as little-endian unsigned 32-bit numbers. ``docs_like`` gives the id's type."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                shard = Shard.from_bytes(content.as_py())
                begins = np.cumsum(shard.sizes) - shard.sizes
                for at in range(0, len(shard.doc_ids), ROWS):
                    some = range(at, min(at + ROWS, len(shard.doc_ids)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard.part] * len(some), pa.int64()), pa.array([shard.number] * len(some), pa.int64()),
                            pa.array([shard.doc_ids[i] for i in some], pa.int64()),
                            pa.array(begins[some.start : some.stop]), pa.array(shard.sizes[some.start : some.stop]),
                            pa.array([shard.document(i).astype("<u4").tobytes() for i in some], pa.binary()),
                        ],
                        names=["part", "shard", "id", "begin", "n_tokens", "ids"],
                    )

    def heads(batches):  # headers alone give the shards' sizes
        for batch in batches:
            found = []
            for content in batch.column(0):
                data = content.as_py()
                _, part, number, n_docs, *_ = struct.unpack_from(HEADER, data)
                sizes = np.frombuffer(data, "<u8", n_docs, struct.calcsize(HEADER) + 17 * n_docs)
                found.append({"part": part, "shard": number, "size": int(sizes.sum())})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("part", "int64"), ("shard", "int64"), ("size", "int64")]))

    files = read_blobs(docs_like.sparkSession, folder).select("content")
    shards = files.mapInArrow(heads, "part long, shard long, size long")
    parts = shards.groupBy("part").agg(F.sum("size").alias("size"))  # a row per range of ids
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(up_to), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("part", "shard", F.coalesce(F.sum("size").over(in_part), F.lit(0)).alias("shard_start")).join(
        parts, "part"
    )
    docs = files.mapInArrow(run, "part long, shard long, id long, begin long, n_tokens long, ids binary")
    return docs.join(offsets, ["part", "shard"]).select(
        F.col("id").cast(sql_type(docs_like, id_col)).alias(id_col),
        (F.col("part_start") + F.col("shard_start") + F.col("begin")).alias("start"),
        "n_tokens",
        "ids",
    )
