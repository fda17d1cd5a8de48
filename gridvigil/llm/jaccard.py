"""Exact Jaccard join of word-shingle sets and its components.

Sets. A document's set is its distinct shingles of ``SIZE`` lower-cased (A-Z) words as 64-bit
hashes. Equal sets are joined first, by a 128-bit digest; one document stands for each.

Index. Shingles are ordered by how full their bucket of a fixed table of counts is, rare ones
first; a link needs a common shingle among the first ``n - ceil(share * n) + 1`` of both
sets. These index lists hold each entry's set size and the shingle's position.

Answers. Only components are asked for, so a set's answers follow from those of a similar
set: (1) in each list the smallest id is compared with every other entry; what links is one
component from then on. (2) Pairs of entries of one component are skipped; each entry is
compared with the nearest entry of another component. (3) All pairs between components that
are left are compared. A list is read in blocks, and a pair of blocks is skipped if sizes,
positions (the later a shingle stands, the less can follow) or components rule all its pairs
out. Single pairs are ruled out by size, position and a 512-bit parity sketch, of which no
more bits can differ than shingles do. What remains is counted exactly on the texts.

Defined results: no text or no words is an empty set, linked with nothing; rows of one id
are one document, for which the text of the smallest digest stands; a row with a null id has
a null component; other columns play no part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridvigil.llm.common import ROWS, claim, sql_type, stored, whole_number_ids, word_hash

SIZE = 5
PERCENT = 80
#: buckets of the table of counts, cut into so many pieces to be added up
COUNT_BITS = 18
PIECES = 64
#: rows of pairs (16 bytes each) up to which texts are picked by a broadcast
MAX_BROADCAST = 500_000
BLOCK = 256
#: entries up to which lists are compared together, whole batches at a time
SHORT = 32
SKETCH = [f"s{i}" for i in range(8)]

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles; of fewer words, of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
    length = min(size, len(words))
    n = len(words) - length + 1
    found = np.full(n, length, np.uint64)
    for i in range(length):
        found = (found ^ hashes[i : i + n]) * _MIX
        found ^= found >> np.uint64(29)
    return np.unique(found)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """512 bits as eight numbers: for each bucket whether it holds an odd number of hashes."""
    odd = np.bincount(((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bucket_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many shingles fall in each bucket; a table of fixed size."""
    width = (1 << COUNT_BITS) // PIECES

    def count(batches):
        claim("jaccard")
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                hashes = [shingles(t) for t in batch.column(0).slice(at, ROWS).to_pylist()]
                place = (np.concatenate(hashes) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                total += np.bincount(place, minlength=1 << COUNT_BITS)
        pieces = [total[i * width : (i + 1) * width].astype("<u4").tobytes() for i in range(PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(counts, "<u4")
                total[piece] = total[piece] + new if piece in total else new.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())],
            names=["piece", "counts"],
        )

    schema = "piece int, counts binary"
    parts = docs.select(text_col).mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema)
    found = np.zeros(1 << COUNT_BITS, np.int64)
    for row in parts.collect():  # PIECES rows
        found[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(row["counts"], "<i8")
    return found


def set_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, digest, the shingles an index list needs in order, and the sketch, of every row."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, text_col))

    def run(batches):
        claim("jaccard")
        order = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                sizes, digests, firsts, sketches = [], [], [], []
                for text in rows.column(1).to_pylist():
                    hashes = shingles(text)
                    n = len(hashes)
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    most = n - (PERCENT * n + 99) // 100 + 1 if n else 0
                    rare = np.argsort(order[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")[:most]
                    firsts.append(hashes[rare].view(np.int64))
                    sketches.append(sketch(hashes))
                lists = pa.ListArray.from_arrays(
                    np.r_[0, np.cumsum([len(x) for x in firsts])].astype(np.int32), np.concatenate(firsts)
                )
                bits = np.stack(sketches)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), lists,
                     *(pa.array(bits[:, i]) for i in range(8))],
                    names=["id", "n", "digest", "firsts", *SKETCH],
                )

    schema = "id long, n int, digest binary, firsts array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    return stored(rows.mapInArrow(run, schema), "sets")


def may_link(a_n, b_n, a_rest, b_rest):
    """Whether sizes and what can follow a common shingle allow a link."""
    return (100 * np.minimum(a_n, b_n) >= PERCENT * np.maximum(a_n, b_n)) & (
        (100 + PERCENT) * np.minimum(a_rest, b_rest) >= PERCENT * (a_n + b_n)
    )


def index_lists(single: DataFrame) -> DataFrame:
    """Entries of all lists of two or more: shingle, id, n, rest, and the list's first entry."""
    entries = single.filter("n > 0").select(
        F.posexplode("firsts").alias("position", "shingle"), "id", "n"
    ).select("shingle", "id", "n", (F.col("n") - F.col("position")).alias("rest"))

    def run(batches):
        held, told = None, False  # the last list's first entry; whether it went out
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            shingle = columns[0]
            new = np.r_[True, shingle[1:] != shingle[:-1]]
            begins = np.flatnonzero(new)
            sizes = np.diff(np.r_[begins, len(shingle)])
            head = np.repeat(begins, sizes)
            many = np.repeat(sizes > 1, sizes)
            if held is not None and told:
                many[0] = False
                if sizes[0] > 1:
                    many[1 : sizes[0]] = True
            last_told = bool(sizes[-1] > 1 or (len(begins) == 1 and told))
            at = np.flatnonzero(many)
            held, told = [c[begins[-1]] for c in columns], last_told
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at]) for c in columns] + [pa.array(c[head[at]]) for c in columns[1:]],
                    names=["shingle", "id", "n", "rest", "head", "head_n", "head_rest"],
                )

    ordered = entries.repartition("shingle").sortWithinPartitions("shingle", "id")
    schema = "shingle long, id long, n int, rest int, head long, head_n int, head_rest int"
    return stored(ordered.mapInArrow(run, schema), "lists")


def first_pairs(lists: DataFrame) -> DataFrame:
    """Each list's first entry with every other one that may link with it."""
    n, rest = F.least("n", "head_n"), F.least("rest", "head_rest")
    return (
        lists.filter("id <> head")
        .filter((100 * n >= PERCENT * F.greatest("n", "head_n")) & ((100 + PERCENT) * rest >= PERCENT * (F.col("n") + F.col("head_n"))))
        .select(F.col("head").alias("b"), F.col("id").alias("a"))
        .distinct()
    )


def block_pairs(entries: dict[str, np.ndarray], every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of entries of one list, in different components, that may link.

    ``every``: all such pairs once; else for each entry the one with the nearest sketch.
    """
    n, rest, label, bits = (entries[k] for k in ("n", "rest", "label", "bits"))
    size = len(n)
    edges = [(s, min(s + BLOCK, size)) for s in range(0, size, BLOCK)]
    span = [(n[s:e].min(), n[s:e].max(), rest[s:e].max(), label[s:e].min(), label[s:e].max()) for s, e in edges]
    near = np.full(size, 1 << 30)
    partner = np.full(size, -1)
    found_a, found_b = [], []
    for i, (s, e) in enumerate(edges):
        low, high, most, first, last = span[i]
        for j in range(i, len(edges)):
            t, f = edges[j]
            low_j, high_j, most_j, first_j, last_j = span[j]
            if first == last == first_j == last_j:
                continue
            if 100 * min(high, high_j) < PERCENT * max(low, low_j):
                continue
            if (100 + PERCENT) * min(most, most_j) < PERCENT * (low + low_j):
                continue
            good = label[s:e, None] != label[None, t:f]
            good &= may_link(n[s:e, None], n[None, t:f], rest[s:e, None], rest[None, t:f])
            a, b = np.nonzero(good)
            if i == j:
                a, b = a[a < b], b[a < b]
            a, b = a + s, b + t
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
            close = (100 + PERCENT) * apart <= (100 - PERCENT) * (n[a] + n[b])
            a, b, apart = a[close], b[close], apart[close]
            if every:
                found_a.append(a)
                found_b.append(b)
                continue
            for x, y in ((a, b), (b, a)):
                order = np.lexsort((y, apart, x))
                head = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(x) else order
                better = apart[head] < near[x[head]]
                near[x[head[better]]] = apart[head[better]]
                partner[x[head[better]]] = y[head[better]]
    if every:
        return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, np.int64),) * 2
    a = np.flatnonzero(partner >= 0)
    return a, partner[a]


def list_pairs(shingle: np.ndarray, entries: dict[str, np.ndarray], every: bool) -> tuple[np.ndarray, np.ndarray]:
    """``block_pairs`` for many lists, which stand one after the other.

    Short lists are compared all at once: each entry with the next one, the one after, and so on.
    """
    begins = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    sizes = np.diff(np.r_[begins, len(shingle)])
    after = np.repeat(begins + sizes, sizes) - np.arange(len(shingle)) - 1
    after[np.repeat(sizes > SHORT, sizes)] = 0
    n, rest, label, bits = (entries[k] for k in ("n", "rest", "label", "bits"))
    found_a, found_b, found_apart = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, SHORT):
        a = np.flatnonzero(after >= step)
        if not len(a):
            break
        b = a + step
        good = (label[a] != label[b]) & may_link(n[a], n[b], rest[a], rest[b])
        a, b = a[good], b[good]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
        close = (100 + PERCENT) * apart <= (100 - PERCENT) * (n[a] + n[b])
        found_a.append(a[close])
        found_b.append(b[close])
        found_apart.append(apart[close])
    a, b, apart = map(np.concatenate, (found_a, found_b, found_apart))
    if not every and len(a):
        x, y, apart = np.r_[a, b], np.r_[b, a], np.r_[apart, apart]
        order = np.lexsort((y, apart, x))
        first = order[np.r_[True, x[order][1:] != x[order][:-1]]]
        a, b = x[first], y[first]
    all_a, all_b = [a], [b]
    for i in np.flatnonzero(sizes > SHORT).tolist():
        own = slice(begins[i], begins[i] + sizes[i])
        a, b = block_pairs({k: v[own] for k, v in entries.items()}, every)
        all_a.append(a + begins[i])
        all_b.append(b + begins[i])
    return np.concatenate(all_a), np.concatenate(all_b)


def pairs_between(lists: DataFrame, info: DataFrame, labels: DataFrame, every: bool) -> DataFrame:
    """Pairs between components from all lists that hold more than one component."""
    entries = (
        lists.select("shingle", "id", "n", "rest")
        .join(labels, "id", "left")
        .withColumn("label", F.coalesce("label", "id"))
    )
    mixed = entries.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    rows = entries.join(mixed.select("shingle"), "shingle", "left_semi").join(info.select("id", *SKETCH), "id")

    def whole_lists(batches):
        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(both) for both in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last list may go on
            if cut:
                yield [c[:cut] for c in columns]
            held = [c[cut:] for c in columns]
        if held is not None:
            yield held

    def run(batches):
        claim("jaccard")
        for shingle, ids, n, rest, label, *bits in whole_lists(batches):
            entries = {
                "n": n.astype(np.int64), "rest": rest.astype(np.int64), "label": label,
                "bits": np.stack(bits, 1).view(np.uint64),
            }
            a, b = list_pairs(shingle, entries, every)
            pairs = np.unique(np.stack([np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b])], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    ordered = rows.select("shingle", "id", "n", "rest", "label", *SKETCH).repartition("shingle").sortWithinPartitions("shingle", "label", "n")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def exact_links(pairs: DataFrame, info: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, by their texts."""
    sides = {side: info.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), *(F.col(s).alias(f"{side}_{s}") for s in SKETCH)) for side in "ab"}
    apart = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SKETCH), F.lit(0))
    sizes = F.col("a_n") + F.col("b_n")
    near = stored(
        pairs.join(sides["a"], "a")
        .join(sides["b"], "b")
        .filter((100 + PERCENT) * apart <= (100 - PERCENT) * sizes)
        .filter(100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n"))
        .select("a", "b"),
        "pairs",
    )
    small = near.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    hint = F.broadcast if small else (lambda df: df)
    left = texts.withColumnsRenamed({"id": "a", "text": "a_text"}).join(hint(near), "a")
    right = texts.withColumnsRenamed({"id": "b", "text": "b_text"}).join(hint(near.select("b").distinct()), "b", "left_semi")

    def run(batches):
        claim("jaccard")
        known = lru_cache(64)(shingles)
        for batch in batches:
            a, b, a_text, b_text = batch.columns
            links = []
            for at in range(batch.num_rows):
                one, two = known(a_text[at].as_py()), known(b_text[at].as_py())
                both = len(np.intersect1d(one, two, assume_unique=True))
                links.append(both > 0 and 100 * both >= PERCENT * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    joined = left.join(right, "b").select("a", "b", "a_text", "b_text")
    return stored(joined.mapInArrow(run, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id each linked id reaches; large-star and small-star rounds."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = (
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = stored(edges, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        before = state


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    whole_number_ids(docs, id_col)
    sets = set_table(docs, id_col, text_col)
    standing = sets.filter("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("digest"))
    groups = stored(standing.groupBy("digest").agg(F.min("id").alias("id")), "groups")
    single = sets.join(groups, ["id", "digest"], "left_semi")
    info = stored(single.groupBy("id").agg(F.first("n").alias("n"), *(F.first(s).alias(s) for s in SKETCH)), "info")
    lists = index_lists(single.dropDuplicates(["id"]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    tested = stored(first_pairs(lists), "first")
    links = exact_links(tested, info, texts)
    labels = components(links)
    for every in (False, True):
        pairs = stored(pairs_between(lists, info, labels, every).join(tested, ["a", "b"], "left_anti"), "between")
        tested = tested.select("a", "b").unionByName(pairs)
        links = links.unionByName(exact_links(pairs, info, texts))
        labels = components(links)
    by_digest = groups.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("label"))
    by_id = standing.join(by_digest, "digest").select("id", "label")
    kind = sql_type(docs, id_col)
    label = F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("id"))
    rows = sets.filter("id is not null").select("id", "n").join(by_id, "id", "left").select("id", "n", label.alias("label"))
    nameless = sets.filter("id is null").select("id", "n", F.col("id").alias("label"))  # would meet in one task
    return rows.unionByName(nameless).select(
        F.col("id").cast(kind).alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.col("label").cast(kind).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the smallest id of every component, one row each, with all columns.

    Rows with a null id stay.
    """
    names = docs.columns
    row_id, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of any kind come back at the end
    found = stored(join(docs, row_id, text).filter(F.col(row_id).isNotNull()), "components")
    gone = found.filter(F.col(row_id) != F.col("component_id")).select(row_id).distinct()
    if gone.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    left = docs.join(gone, row_id, "left_anti").select(*docs.columns)
    repeated = found.groupBy(row_id).count().filter("count > 1").select(row_id)
    if repeated.limit(1).count() == 0:
        return left.toDF(*names)
    one = (
        left.join(repeated, row_id, "left_semi")
        .groupBy(row_id)
        .agg(F.min_by(F.struct(*docs.columns), F.coalesce(text, F.lit(""))).alias("kept_row"))
        .select("kept_row.*")
    )
    rest = left.join(repeated, row_id, "left_anti").select(*docs.columns)
    return rest.unionByName(one.select(*docs.columns)).toDF(*names)
