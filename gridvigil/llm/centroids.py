"""Centroid clustering of integer vectors over subvector dictionaries.

Vectors are cut into parts of at most ``PART``. In a part every dimension is replaced by codes
of its distinct values, and neighbouring blocks of dimensions are joined into codes of their
distinct subvectors as long as that saves work: a joined block of ``size`` entries costs
``size * width`` differences a round and spares one addition a vector. Nothing is lost, and a
part's dictionaries never hold more numbers than the part itself, so no dictionary grows with
the table and none is broadcast. A round computes each entry's exact distances to all centroids
once, sums them by code to whole distances, and sums each cluster's entries by their counts.
Only ``k`` rows of sums leave a task, the driver holds ``k`` centroids, and nothing is dealt by
a key, so a vector that fills a third of the table is no hot key.

Defined results: a vector is kept if it has exactly ``dims`` components, none null or not
finite; others give no row. Repeated rows and rows with a null id count one by one; a null id
is drawn as an empty text; of rows with one id the smaller vector is drawn first. With fewer
kept vectors than ``k`` there are so many centroids; an empty table gives no rows. Other
columns play no part. A scaled component beyond ``MOST``, or an inertia beyond a long, is an
error and never a wrong number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridvigil.llm.common import claim, sql_type, stored

#: vectors of a part; codes of a part fit 16 bits
PART = 1 << 15
#: vectors whose distances are summed at a time
SLICE = 1 << 12
#: largest scaled component; a squared distance of up to 2048 dimensions then fits a long
MOST = 1 << 25


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """id and components (double) of the vectors that can be clustered."""
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("vector") == dims) & finite)


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as long."""
    found = np.floor(values * scale)
    if found.size and np.abs(found).max() > MOST:
        raise ValueError(f"a scaled component is beyond {MOST}")
    return found.astype(np.int64)


def dictionaries(ints: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, entries, code of every vector) of the blocks of a part."""
    blocks = []
    for at in range(ints.shape[1]):
        entries, codes = np.unique(ints[:, at], return_inverse=True)
        blocks.append((at, entries[:, None], codes))
    joined = True
    while joined:
        joined, level = False, []
        while blocks:
            if len(blocks) == 1:
                level.append(blocks.pop())
                break
            (at, left, a), (_, right, b) = blocks[:2]
            pairs, codes = np.unique(a * len(right) + b, return_inverse=True)
            width = left.shape[1] + right.shape[1]
            if len(pairs) * width <= len(ints):
                entries = np.concatenate([left[pairs // len(right)], right[pairs % len(right)]], axis=1)
                level.append((at, entries, codes))
                del blocks[:2]
                joined = True
            else:
                level.append(blocks.pop(0))
        blocks = level
    return blocks


def encode(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """Parts: ids, and for all blocks the layout (width and size), entries and codes."""

    def part(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        ids, ints = pa.concat_arrays(ids), np.concatenate(rows)
        blocks = dictionaries(ints)
        layout = np.array([[e.shape[1], len(e)] for _, e, _ in blocks], "<i4")
        entries = np.concatenate([e.ravel() for _, e, _ in blocks]).astype("<i4")
        codes = np.stack([c for _, _, c in blocks]).astype("<u2")
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *(pa.array([x.tobytes()], pa.binary()) for x in (layout, entries, codes)),
            ],
            names=["ids", "layout", "entries", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("centroids")
        ids: list[pa.Array] = []
        rows: list[np.ndarray] = []
        held = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                taken = batch.slice(at, PART - held)
                values = taken.column(1).flatten().to_numpy(zero_copy_only=False)
                ids.append(taken.column(0))
                rows.append(scaled(values, scale).reshape(-1, dims))
                at, held = at + taken.num_rows, held + taken.num_rows
                if held == PART:
                    yield part(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield part(ids, rows)

    kind = sql_type(kept, "id")
    return kept.mapInArrow(run, f"ids array<{kind}>, layout binary, entries binary, codes binary")


class Part:
    """One part's dictionaries and codes."""

    def __init__(self, layout: bytes, entries: bytes, codes: bytes):
        self.layout = np.frombuffer(layout, "<i4").reshape(-1, 2)
        numbers = np.frombuffer(entries, "<i4").astype(np.int64)
        ends = np.cumsum(self.layout.prod(1)).tolist()
        self.entries = [
            numbers[end - width * size : end].reshape(size, width)
            for end, (width, size) in zip(ends, self.layout.tolist(), strict=True)
        ]
        self.codes = np.frombuffer(codes, "<u2").reshape(len(self.layout), -1)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and its squared distance."""
        tables, at = [], 0
        for entries in self.entries:  # exact distances of all distinct subvectors, once
            width = entries.shape[1]
            apart = entries[:, None, :] - centroids[None, :, at : at + width]
            tables.append((apart * apart).sum(2))
            at += width
        n = self.codes.shape[1]
        cluster, distance = np.empty(n, np.int64), np.empty(n, np.int64)
        for start in range(0, n, SLICE):
            codes = self.codes[:, start : start + SLICE]
            total = tables[0][codes[0]]
            for table, own in zip(tables[1:], codes[1:], strict=True):
                total += table[own]
            best = total.argmin(1)
            cluster[start : start + SLICE] = best
            distance[start : start + SLICE] = total[np.arange(len(best)), best]
        return cluster, distance

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of each cluster's vectors, by the counts of their codes."""
        found = []
        for entries, codes in zip(self.entries, self.codes, strict=True):
            size = len(entries)
            counts = np.bincount(cluster * size + codes, minlength=k * size).reshape(k, size)
            found.append(counts @ entries)
        return np.concatenate(found, axis=1)


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Part]]:
    for i in range(batch.num_rows):
        yield batch.column(0)[i].values, Part(*(batch.column(j)[i].as_py() for j in (1, 2, 3)))


def cluster_sums(encoded: DataFrame, centroids: np.ndarray, with_sums: bool = True) -> dict[int, tuple]:
    """(vectors, inertia, component sums) of every cluster that is not empty."""
    k, dims = centroids.shape
    n_sums = dims if with_sums else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("centroids")
        number, low, high = (np.zeros(k, np.int64) for _ in range(3))
        sums = np.zeros((k, n_sums), np.int64)
        for batch in batches:
            for _, part in parts_of(batch):
                cluster, distance = part.nearest(centroids)
                number += np.bincount(cluster, minlength=k)
                # halves, for a whole sum may not fit a long
                np.add.at(low, cluster, distance & 0xFFFFFFFF)
                np.add.at(high, cluster, distance >> 32)
                if with_sums:
                    sums += part.sums(cluster, k)
        used = np.flatnonzero(number)
        inertia = [Decimal((int(high[c]) << 32) + int(low[c])) for c in used]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()), pa.array(number[used], pa.int64()),
                pa.array(inertia, pa.decimal128(38, 0)), pa.array(list(sums[used]), pa.list_(pa.int64())),
            ],
            names=["cluster", "n", "inertia", "sums"],
        )

    partial = encoded.mapInArrow(run, "cluster int, n long, inertia decimal(38,0), sums array<long>")
    total = partial.groupBy("cluster").agg(
        F.sum("n"), F.sum("inertia"), *(F.sum(F.col("sums")[i]) for i in range(n_sums))
    )
    return {row[0]: (row[1], int(row[2]), list(row[3:])) for row in total.collect()}  # k rows at most


def cluster(
    vectors: DataFrame,
    dims: int = 64,
    k: int = 40,
    rounds: int = 5,
    scale: int = 256,
    salt: str = "2:",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Components become floor(``scale`` * x). The first centroids are the ``k`` vectors with the
    smallest SHA-256 of ``salt`` and id; after each of ``rounds`` assignments a centroid
    becomes the floor of its vectors' mean, and empty clusters keep theirs.
    """
    kept = kept_vectors(vectors, id_col, vec_col, dims)
    drawn = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    whole = F.transform("vector", lambda x: F.floor(x * scale))  # sorts as the vector does
    first = kept.select("vector", drawn.alias("drawn"), whole.alias("whole")).orderBy("drawn", "whole").limit(k).collect()
    centroids = np.array([scaled(np.array(row["vector"]), scale) for row in first], np.int64).reshape(-1, dims)
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    schema = (
        f"`{id_col}` {sql_type(kept, 'id')}, cluster int, distance long, cluster_inertia long, inertia long, "
        "centroid_sha256 string"
    )
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    encoded = stored(encode(kept, dims, scale), "subvectors")
    for _ in range(rounds):
        found = cluster_sums(encoded, centroids)
        # Python's numbers: exact, and // is the floor
        centroids = np.array(
            [[s // found[c][0] for s in found[c][2]] if c in found else centroids[c] for c in range(len(centroids))],
            np.int64,
        )
    found = cluster_sums(encoded, centroids, with_sums=False)
    inertia = {c: x[1] for c, x in found.items()}
    total = sum(inertia.values())
    if total >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")
    own_inertia = np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64)
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("centroids")
        for batch in batches:
            for ids, part in parts_of(batch):
                own, distance = part.nearest(centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(own, pa.int32()), pa.array(distance), pa.array(own_inertia[own]),
                        pa.array(np.full(len(own), total, np.int64)), pa.array(digests[own].tolist(), pa.string()),
                    ],
                    names=[id_col, *names],
                )

    return encoded.mapInArrow(run, schema)


def sql(dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:") -> str:
    """The query over ``embeddings`` for DuckDB."""
    squared = (
        f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    )
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id,
    list_transform(embedding, lambda e: floor(e::DOUBLE * {scale})::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{salt}' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INTEGER AS cluster, x
  FROM kept QUALIFY cluster < {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT n, vec_id, x, cluster, distance FROM (
    SELECT v.n, v.vec_id, v.x, c.cluster, {squared} AS distance FROM kept v, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (
  SELECT cluster, list(mean ORDER BY i) AS x FROM (
    SELECT cluster, i, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean
    FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, {dims + 1})) AS i FROM a{r})
    GROUP BY cluster, i)
  GROUP BY cluster),
c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (cluster))"""
            )
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, distance,
  sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} c USING (cluster)"""
