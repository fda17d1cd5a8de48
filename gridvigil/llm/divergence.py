"""Source divergence audit by an exact recount over minimal perfect hashes.

The first pass counts in how many documents of a language each term stands and keeps the
frequent ones. A language's kept terms are dealt to shards by their hash, and each shard gets a
minimal perfect hash: a displacement per bucket of terms that gives every term a slot of its
own. Displacements and the terms themselves, slot by slot, are broadcast. In the second pass a
task keeps one dense array of slots for every (language, source, shard) it meets, looks the
words up, compares them with the stored term, and adds their numbers. When the arrays
are too many, and at the end, they leave as sparse rows, so one sum per group, shard and task is
shuffled, never a row per word. Broadcasts are cut to ``MAX_BYTES``: with more kept terms than
that the second pass runs once for each part of the shards.

Terms lie in shards by their hash and sources in blocks of ``BLOCK``; a pair of blocks is
compared shard by shard. So a source with a third of all rows is one sparse row per task and
shard like any other, and no term, source or language lands in one task.

All arithmetic is in whole numbers. Defined results: null texts, languages and sources are
empty strings; a group without terms has count 0 for every kept term; a language without kept
terms has value 0 for each pair and no terms; repeated rows count one by one; a term of any
length is kept whole; equal values rank by the item's UTF-8 bytes; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.llm.common import claim, stored

#: a term is kept from so many documents of its language on
MIN_DOCS = 10
#: ranks of the part ``term``
MAX_RANK = 10
UNIT = 1_000_000_000
#: terms of a shard, about; terms of a bucket that share a displacement
SHARD = 4096
BUCKET = 4
#: bytes of perfect hashes broadcast at a time; a term counts its length and ``KEY_BYTES``
MAX_BYTES = 64 << 20
KEY_BYTES = 64
#: distinct (language, term) and (language, source, term) a task holds before it passes them on
MAX_HELD = 200_000
#: slots of dense arrays a task holds before it passes them on
MAX_SLOTS = 4 << 20
#: words counted in one array, so that a count fits 32 bits
MAX_WORDS = 1 << 31
#: sources compared together
BLOCK = 32

#: letters and all characters beyond ASCII stay, A-Z in lower case; others part terms
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def mix(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Another hash of each hash for each seed."""
    found = hashes + (seeds.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(29)
    found *= np.uint64(0x94D049BB133111EB)
    return found ^ (found >> np.uint64(32))


def hashes_of(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def buckets_of(hashes: np.ndarray, n_buckets: np.ndarray | int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.asarray(n_buckets, np.uint64)).astype(np.int64)


def perfect_hash(terms: list[bytes]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Displacement per bucket, the term of every slot, and terms without a slot.

    A displacement d >= 0 sends a bucket's terms to ``mix(hash, d) % n``; -1 - s sends a bucket
    of one term to slot s. Terms whose hash another term has get no slot; they are looked up
    by themselves.
    """
    hashes = hashes_of(terms)
    _, single = np.unique(hashes, return_index=True)
    extra = sorted(set(range(len(terms))) - set(single.tolist()))
    kept, hashes = [terms[i] for i in single], hashes[single]
    n = len(kept)
    n_buckets = max(1, -(-n // BUCKET))
    bucket = buckets_of(hashes, n_buckets)
    sizes = np.bincount(bucket, minlength=n_buckets)
    members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(sizes)[:-1])
    displacement = np.zeros(n_buckets, np.int32)
    free = np.ones(n, bool)
    slots = np.empty(n, np.int64)
    for b in np.argsort(-sizes, kind="stable").tolist():
        own = members[b]
        if not len(own):
            break
        if len(own) == 1:
            slot = int(free.argmax())
            displacement[b] = -1 - slot
            free[slot], slots[own] = False, slot
            continue
        first, tried = 0, 64
        while True:
            seeds = np.arange(first, first + tried)
            places = (mix(hashes[own][None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
            ordered = np.sort(places, axis=1)
            good = free[places].all(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if good.any():
                at = int(good.argmax())
                displacement[b] = first + at
                free[places[at]], slots[own] = False, places[at]
                break
            first, tried = first + tried, min(2 * tried, 1 << 13)
    by_slot = np.empty(n, object)
    by_slot[slots] = kept
    return displacement, by_slot.tolist(), [terms[i] for i in extra]


@dataclass
class LanguageHashes:
    """The perfect hashes of some shards of a language, joined for look-ups of many words."""

    n_shards: int
    #: by shard: number of buckets (0: not here), of terms, and where they begin
    n_buckets: np.ndarray
    n_terms: np.ndarray
    first_bucket: np.ndarray
    first_slot: np.ndarray
    displacement: np.ndarray
    #: stored term of every slot
    terms: list[bytes] = field(default_factory=list)
    #: (shard, slot in it) of terms that share their hash with another one
    extra: dict[bytes, tuple[int, int]] = field(default_factory=dict)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot in it of each word; shard -1 for words that are not kept here."""
        hashes = hashes_of(words)
        shard = (hashes >> np.uint64(32)).astype(np.int64) % self.n_shards
        slot = np.zeros(len(words), np.int64)
        here = np.flatnonzero(self.n_terms[shard])
        own = shard[here]
        bucket = buckets_of(hashes[here], self.n_buckets[own])
        displaced = self.displacement[self.first_bucket[own] + bucket]
        mixed = mix(hashes[here], np.maximum(displaced, 0)) % self.n_terms[own].astype(np.uint64)
        slot[here] = np.where(displaced < 0, -1 - displaced, mixed.astype(np.int64))
        places = (self.first_slot[own] + slot[here]).tolist()
        stored_terms = self.terms
        same = np.fromiter((stored_terms[p] == words[i] for p, i in zip(places, here.tolist(), strict=True)), bool, len(here))
        found = np.zeros(len(words), bool)
        found[here[same]] = True
        if self.extra:
            for i, word in enumerate(words):
                if word in self.extra:
                    shard[i], slot[i] = self.extra[word]
                    found[i] = True
        shard[~found] = -1
        return shard, slot


def joined(n_shards: int, shards: list) -> LanguageHashes:
    """``shards``: rows of shard, displacement, terms and extra."""
    made = LanguageHashes(n_shards, *(np.zeros(n_shards, np.int64) for _ in range(4)), np.zeros(0, np.int64))
    parts, at = [], 0
    for row in shards:
        number, own = row["shard"], np.frombuffer(row["displacement"], "<i4")
        made.n_buckets[number], made.n_terms[number] = len(own), len(row["terms"])
        made.first_bucket[number], made.first_slot[number] = at, len(made.terms)
        at += len(own)
        parts.append(own)
        made.terms += map(bytes, row["terms"])
        for i, term in enumerate(row["extra"]):
            made.extra[bytes(term)] = (number, len(row["terms"]) + i)
    made.displacement = np.concatenate(parts).astype(np.int64)
    made.n_buckets = np.maximum(made.n_buckets, 1)
    return made


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term and in how many documents of the language it stands; pre-aggregated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("divergence")
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            langs = [lang for lang, counts in held.items() for _ in range(len(counts))]
            terms = [term for counts in held.values() for term in counts]
            numbers = [n for counts in held.values() for n in counts.values()]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(numbers, pa.int64())],
                names=["lang", "term", "n"],
            )

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(2)
            for i, lang in enumerate(langs):
                held.setdefault(lang, Counter()).update(set(terms_of(texts[i].as_py())))
                if i % 16 == 0 and sum(map(len, held.values())) > MAX_HELD:
                    yield rows()
        yield rows()

    found = docs.mapInArrow(run, "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def shard_tables(kept: DataFrame) -> DataFrame:
    """The perfect hash of every shard of (lang, n_shards, term) rows."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = hashes_of(batch.column(2).to_pylist())
            sizes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            own = (hashes >> np.uint64(32)).astype(np.int64) % sizes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), batch.column(2)],
                names=["lang", "n_shards", "shard", "term"],
            )

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        displacement, by_slot, extra = perfect_hash(sorted(table.column("term").to_pylist()))
        size = sum(map(len, by_slot)) + sum(map(len, extra)) + KEY_BYTES * (len(by_slot) + len(extra))
        kind = pa.list_(pa.binary())
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()], pa.string()),
                "n_shards": pa.array([key[1].as_py()], pa.int32()),
                "shard": pa.array([key[2].as_py()], pa.int32()),
                "displacement": pa.array([displacement.astype("<i4").tobytes()], pa.binary()),
                "terms": pa.array([by_slot], kind),
                "extra": pa.array([extra], kind),
                "size": pa.array([size], pa.int64()),
            }
        )

    dealt = kept.select("lang", "n_shards", "term").mapInArrow(
        shard, "lang string, n_shards int, shard int, term binary"
    )
    return dealt.groupBy("lang", "n_shards", "shard").applyInArrow(
        build,
        "lang string, n_shards int, shard int, displacement binary, terms array<binary>, extra array<binary>, size long",
    )


COUNTS = "lang string, shard int, source string, slots binary, counts binary"


def recount(docs: DataFrame, hashes: dict[str, LanguageHashes]) -> DataFrame:
    """Sparse slot counts of each (lang, shard, source), once or oftener for each task."""
    held = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("divergence")
        known = held.value
        pending: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, int, str], np.ndarray] = {}
        n_slots = n_words = 0

        def add() -> None:
            """Look the words up and count them in their groups' slots."""
            nonlocal n_slots
            for (lang, source), counts in pending.items():
                if not counts:
                    continue
                table = known[lang]
                shard, slot = table.find(list(counts))
                number = np.fromiter(counts.values(), np.int64, len(counts))
                order = np.argsort(shard, kind="stable")
                shard, slot, number = shard[order], slot[order], number[order]
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist() + [len(shard)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own = int(shard[a])
                    if own < 0:
                        continue
                    key = (lang, own, source)
                    if key not in dense:
                        size = int(table.n_terms[own]) + sum(s == own for s, _ in table.extra.values())
                        dense[key] = np.zeros(size, np.int64)
                        n_slots += size
                    dense[key][slot[a:b]] += number[a:b]  # slots of one look-up are distinct
            pending.clear()

        def rows() -> pa.RecordBatch:
            nonlocal n_slots, n_words
            out: dict[str, list] = {"lang": [], "shard": [], "source": [], "slots": [], "counts": []}
            for (lang, shard, source), counts in dense.items():
                used = np.flatnonzero(counts)
                values = (lang, shard, source, used.astype("<u4").tobytes(), counts[used].astype("<u4").tobytes())
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            dense.clear()
            n_slots = n_words = 0
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out)
            )

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, group in enumerate(zip(langs, sources, strict=True)):
                if group[0] not in known:
                    continue
                words = terms_of(texts[i].as_py())
                pending.setdefault(group, Counter()).update(words)
                n_words += len(words)
                if i % 16 == 0 and sum(map(len, pending.values())) > MAX_HELD:
                    add()
                if n_slots > MAX_SLOTS or n_words > MAX_WORDS:
                    add()
                    yield rows()
        add()
        if dense:
            yield rows()

    return docs.mapInArrow(run, COUNTS)


def summed(counts: DataFrame) -> DataFrame:
    """One sparse row per (lang, shard, source), and one per (lang, shard) with source null.

    Rows come sorted, so a task holds two dense arrays however many rows a group has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in ("lang", "shard", "source", "slots", "counts", "total")}

        def put(lang, shard, source, values: np.ndarray) -> None:
            used = np.flatnonzero(values)
            row = (lang, shard, source, used.astype("<u4").tobytes(), values[used].astype("<i8").tobytes(), int(values.sum()))
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)

        def rows() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64())
            found = pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out)
            )
            for column in out.values():
                column.clear()
            return found

        def grown(values: np.ndarray, size: int) -> np.ndarray:
            return values if size <= len(values) else np.concatenate([values, np.zeros(size - len(values), np.int64)])

        shard = source = None
        whole = own = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["lang"], row["shard"])
                if source is not None and (here != shard or row["source"] != source):
                    put(*shard, source, own)
                    whole = grown(whole, len(own))
                    whole[: len(own)] += own
                    own = np.zeros(0, np.int64)
                if shard is not None and here != shard:
                    put(*shard, None, whole)
                    whole = np.zeros(0, np.int64)
                shard, source = here, row["source"]
                slots = np.frombuffer(row["slots"], "<u4").astype(np.int64)
                own = grown(own, int(slots[-1]) + 1)
                own[slots] += np.frombuffer(row["counts"], "<u4")
                if len(out["lang"]) >= 256:
                    yield rows()
        if shard is not None:
            put(*shard, source, own)
            whole = grown(whole, len(own))
            whole[: len(own)] += own
            put(*shard, None, whole)
        yield rows()

    dealt = counts.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "source")
    return dealt.mapInArrow(run, COUNTS + ", total long")


def rates(counts: np.ndarray, divisor: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / divisor), by long division as the product may be too long."""
    left = counts + 2
    found = np.zeros_like(left)
    for step in (1000, 1000, 1000):
        left = left * step
        found = found * step + left // divisor
        left %= divisor
    return found + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


def compare_blocks(table: pa.Table, first: int, second: int) -> tuple[list, list]:
    """(source, other, sum of f) of pairs across two blocks of sources in one shard, and, within
    a block, (source, term, value) of each source's best terms.

    Every row: source (null: the whole language), block, slots, counts, n and v of the group and
    number of slots; the row of the whole language also has the shard's terms.
    """
    rows = table.to_pylist()
    size = rows[0]["n_slots"]

    def dense(row) -> np.ndarray:
        counts = np.zeros(size, np.int64)
        if row["slots"]:
            counts[np.frombuffer(row["slots"], "<u4").astype(np.int64)] = np.frombuffer(row["counts"], "<i8")
        return counts

    def of(block):
        own = sorted((r for r in rows if r["source"] is not None and r["block"] == block), key=lambda r: r["source"])
        return [r["source"] for r in own], [dense(r) for r in own], [r["n"] + 2 * r["v"] for r in own]

    names, counts, divisors = of(first)
    p = [rates(c, d) for c, d in zip(counts, divisors, strict=True)]
    if first != second:
        others, more, more_divisors = of(second)
        q = [rates(c, d) for c, d in zip(more, more_divisors, strict=True)]
        return [(a, b, int(divergences(x, y).sum())) for a, x in zip(names, p, strict=True) for b, y in zip(others, q, strict=True)], []
    pairs = [
        (names[i], names[j], int(divergences(p[i], p[j]).sum())) for i in range(len(names)) for j in range(i + 1, len(names))
    ]
    whole = next(r for r in rows if r["source"] is None)
    q = rates(dense(whole), whole["n"] + 2 * whole["v"])
    terms = np.empty(size, object)
    terms[:] = whole["terms"]
    best = []
    for name, own, rate in zip(names, counts, p, strict=True):
        above = np.flatnonzero((own > 0) & (rate > q))
        value = divergences(rate[above], q[above])
        if len(above) > MAX_RANK:  # with all that equal the last of them
            least = np.partition(value, -MAX_RANK)[-MAX_RANK]
            above, value = above[value >= least], value[value >= least]
        ranked = sorted(zip((-value).tolist(), terms[above], strict=True))[:MAX_RANK]
        best += [(name, term, -v) for v, term in ranked]
    return pairs, best


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS
) -> DataFrame:
    """lang, source, part, item, value and rank: each pair of sources of a language, and each
    source's terms that set it apart from its language."""
    spark = docs.sparkSession

    def text_of(column: str):
        return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))

    docs = docs.select(
        text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text")
    )
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).select("lang", "source")
    kept = stored(document_counts(docs).filter(F.col("n") >= min_docs).select("lang", "term"), "terms")
    sizes = stored(kept.groupBy("lang").agg(F.count("*").alias("v")), "vocabulary")
    n_shards = F.ceil(F.col("v") / SHARD).cast("int").alias("n_shards")
    hashes = stored(shard_tables(kept.join(sizes.select("lang", n_shards), "lang")), "hashes")

    # the second pass, once for each part of the shards that may be broadcast together
    shards = hashes.select("lang", "shard", "n_shards", "size").orderBy("lang", "shard").collect()  # one for 4096 terms
    total = {row["lang"]: row["n_shards"] for row in shards}
    parts: list[list] = []
    filled = MAX_BYTES
    for row in shards:
        if filled + row["size"] > MAX_BYTES:
            parts.append([])
            filled = 0
        parts[-1].append(row)
        filled += row["size"]
    counts = None
    for part in parts:
        wanted = spark.createDataFrame([(r["lang"], r["shard"]) for r in part], "lang string, shard int")
        tables: dict[str, list] = {}
        for row in hashes.join(F.broadcast(wanted), ["lang", "shard"], "left_semi").collect():  # MAX_BYTES
            tables.setdefault(row["lang"], []).append(row)
        found = recount(docs, {lang: joined(total[lang], rows) for lang, rows in tables.items()})
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        counts = spark.createDataFrame([], COUNTS)
    sums = stored(summed(counts), "slots")

    # every group's n and v, and its block of sources
    n = sums.groupBy("lang", "source").agg(F.sum("total").alias("n"))
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    of_group = (
        groups.join(n, ["lang", "source"], "left").join(per_lang, "lang").join(sizes, "lang", "left")
        .select(
            "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"),
            F.ceil(F.col("n_sources") / BLOCK).cast("int").alias("n_blocks"),
        )
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int"))
    )
    of_group = stored(of_group, "groups")

    # each shard meets each source of its language, with or without counts
    shard_rows = hashes.select("lang", "shard", "terms", "extra").withColumn("terms", F.concat("terms", "extra")).drop("extra")
    shard_sizes = shard_rows.select("lang", "shard", F.size("terms").alias("n_slots"))
    vectors = sums.filter(F.col("source").isNotNull()).select("lang", "shard", "source", "slots", "counts")
    of_source = (
        of_group.join(shard_sizes, "lang").join(vectors, ["lang", "shard", "source"], "left")
        .select("lang", "shard", "source", "block", "n_blocks", "slots", "counts", "n", "v", "n_slots",
                F.lit(None).cast("array<binary>").alias("terms"))
    )
    of_lang = (
        sums.filter(F.col("source").isNull()).select("lang", "shard", "slots", "counts")
        .join(n.filter(F.col("source").isNull()).select("lang", "n"), "lang")
        .join(sizes, "lang")
        .join(of_group.groupBy("lang").agg(F.max("n_blocks").alias("n_blocks")), "lang")
        .join(shard_rows, ["lang", "shard"])
        .select("lang", "shard", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("block"), "n_blocks",
                "slots", "counts", "n", "v", F.size("terms").alias("n_slots"), "terms")
    )
    blocks = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    own = F.col("block")
    cells = of_source.withColumn("other", F.explode(blocks)).withColumn("first", F.least(own, "other")).withColumn(
        "second", F.greatest(own, "other")
    )
    whole = of_lang.withColumn("other", F.explode(blocks)).withColumn("first", F.col("other")).withColumn("second", F.col("other"))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        pairs, best = compare_blocks(table, key[2].as_py(), key[3].as_py())
        rows = [(lang, a, "pair", b.encode(), v) for a, b, v in pairs] + [(lang, a, "term", t, v) for a, t, v in best]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
        names = ("lang", "source", "part", "item", "value")
        return pa.table({m: pa.array(list(c), k) for m, c, k in zip(names, columns, kinds, strict=True)})

    compared = stored(
        cells.unionByName(whole).groupBy("lang", "shard", "first", "second").applyInArrow(
            compare, "lang string, source string, part string, item binary, value long"
        ),
        "compared",
    )
    one_way = compared.filter(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one_way = one_way.withColumn("item", F.col("item").cast("string"))
    # languages without kept terms have no shard, and yet their pairs
    bare = of_group.filter(F.col("v") == 0).select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter(F.col("source") != F.col("item"))
    both = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = both.unionByName(bare.withColumn("value", F.lit(0).cast("long"))).withColumn("part", F.lit("pair"))
    terms = compared.filter(F.col("part") == "term").withColumn("item", F.col("item").cast("string"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    names = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.unionByName(terms, allowMissingColumns=False).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= MAX_RANK)).select(*names)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (
  SELECT n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT n) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v))::HUGEINT AS p
  FROM grp g JOIN kept k USING (lang) JOIN v USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(c) + 2)::HUGEINT) // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * any_value(v.v))::HUGEINT) AS q
  FROM counts JOIN v USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
