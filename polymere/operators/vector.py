"""Vector similarity: exact nearest neighbours of one query or of many, and approximate ones through an index of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut

#: Bytes of query vectors that every task holds; more are searched in several passes.
HELD_BYTES = 64 << 20
#: Queries and rows whose similarities are held at once.
_BLOCK, _BLOCK_ROWS = 512, 4096
#: Pairs that a task holds before it keeps the best of them.
_WAITING = 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def nearest(df: DataFrame, query: Sequence[float], k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, similarity) of the k vectors most similar to query; of equal ones those of least id."""
    scored = df.select(id_column, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_column).limit(k)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1, from the list's flat values; a vector of nulls or length 0 is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, similarity) of each row's k greatest similarities; of equal ones those of the first columns. Rows aren't sorted, only what is as great as the k-th."""
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, column = np.nonzero(s >= least[:, None])
    else:
        row, column = (i.ravel() for i in np.indices(s.shape))
    value = s[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    first = np.searchsorted(row, np.arange(len(s)))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], ids[column[kept]], value[kept]


def _merged(held: tuple[np.ndarray, ...] | None, new: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best (query, id, similarity) for each query of both."""
    query, ids, value = new if held is None else (np.concatenate(p) for p in zip(held, new))
    order = np.lexsort((ids, -value, query))
    query, ids, value = query[order], ids[order], value[order]
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    kept = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query))) < k
    return query[kept], ids[kept], value[kept]


def _batch(ids: np.ndarray, best: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "id", "similarity"])


def nearest_to_all(queries: DataFrame, df: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", held_bytes: int = HELD_BYTES) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar of df for every query.

    Each batch of df is multiplied with the held queries as matrices, of _BLOCK
    of either, and only a task's own k best for each query leave it, so that what
    is exchanged is k rows for a query and task. Vectors are of one length; null
    ones are in no result. The query side's size, with the k best of each, is
    checked, and beyond held_bytes it is dealt into passes.
    """
    q = queries.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("v is not null and id is not null")
    # a vector, and its best with those of a batch while they are merged
    size = q.agg(F.sum(8 * F.size("v") + F.lit(72 * k))).first()[0] or 0
    passes = max(1, math.ceil(size / held_bytes))
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("v is not null and id is not null")
    context = df.sparkSession.sparkContext
    found = None
    for i in range(passes):
        part = q.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).toArrow()
        if not part.num_rows:
            continue
        held = context.broadcast((part.column("id").to_numpy(), _unit(part.column("v").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, unit = held.value
            best: list = [None] * -(-len(ids) // _BLOCK)
            for b in batches:
                own = b.column("id").to_numpy()
                order = np.argsort(own, kind="stable")
                for lo in range(0, len(own), _BLOCK_ROWS):
                    some = order[lo : lo + _BLOCK_ROWS]
                    other = _unit(b.column("v").take(pa.array(some)))
                    for i in range(len(best)):
                        s = np.round(unit[i * _BLOCK : (i + 1) * _BLOCK] @ other.T, 12)
                        best[i] = _merged(best[i], _best(s, own[some], k), k)
            for i, found in enumerate(best):
                if found is not None:
                    yield _batch(ids[i * _BLOCK : (i + 1) * _BLOCK], found)

        one = rows.mapInArrow(run, "query_id bigint, id bigint, similarity double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# -- approximate: an inverted file of cells about centres


@dataclass(frozen=True)
class CellIndex:
    """Rows (id, cell, v) in a folder for each cell, the cells' centres, and how many cells a query looks into."""

    rows: DataFrame
    centers: np.ndarray
    probes: int


def _centers(x: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm == 0, 1, norm), c)
    return c


def _probes_for(x: np.ndarray, centers: np.ndarray, recall: float, k: int) -> int:
    """The fewest cells in which that share of each sampled vector's k nearest others is found, on average."""
    q = x[:200]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -2
    best = np.argsort(-s, axis=1)[:, :k]
    of = (x @ centers.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(q @ centers.T), axis=1), axis=1)
    need = np.take_along_axis(rank, of[best], axis=1).ravel()
    return int(np.quantile(need, recall, method="higher")) + 1 if len(need) else 1


def build_cells(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", cells: int = 0, train_rows: int = 20_000, recall: float = 0.97, k: int = 10, rounds: int = 8, seed: int = 7) -> CellIndex:
    """An index of every row. Centres are fitted on at most about `train_rows` rows chosen by a hash of the id, and so is how many cells
    a query must look into for `recall` of its k nearest. Without `cells` there are as many as the root of the number of rows, 4,096 at most.

    Null ids and vectors aren't indexed; vectors are of one length.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("v is not null and id is not null")
    n = rows.count()
    # ids may repeat, so the share is taken by id and the rest cut
    share = 2 * train_rows / max(1, n)
    bound = 2**63 - 1 if share >= 1 else int(share * 2**63) * 2 - 2**63
    some = rows.filter(F.xxhash64(F.lit(seed), "id", "v") <= F.lit(bound)).limit(train_rows).toArrow()
    x = _unit(some.column("v")) if some.num_rows else np.zeros((1, 1))
    centers = _centers(x, cells or max(1, min(4096, math.isqrt(max(1, n)))), rounds, seed)
    held = df.sparkSession.sparkContext.broadcast(centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column("v")
                # cells grow with the root of the rows: some rows at a time
                cell = np.concatenate([(_unit(v.slice(at, _BLOCK)) @ held.value.T).argmax(axis=1) for at in range(0, len(v), _BLOCK)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cell), b.column("v")], ["id", "cell", "v"])

    placed = rows.mapInArrow(place, "id bigint, cell int, v array<float>")
    return CellIndex(cut(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell"), "cells"), centers, _probes_for(x, centers, recall, k))


def search_cells(ix: CellIndex, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", probes: int = 0, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar of the cells that each query looks into.

    Rows are read once a pass of queries, and each batch meets the queries of its
    cells as matrices; a task's k best for each query leave it, however many cells it has. The query side's size, with the cells that it looks into, is checked as in nearest_to_all.
    """
    q = queries.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("v is not null and id is not null")
    looked = min(probes or ix.probes, len(ix.centers))
    # a vector, 4 bytes a cell that it looks into, and its best while they are merged
    size = q.agg(F.sum(8 * F.size("v") + F.lit(4 * looked + 72 * k))).first()[0] or 0
    passes = max(1, math.ceil(size / held_bytes))
    context, found = queries.sparkSession.sparkContext, None
    for i in range(passes):
        part = q.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).toArrow()
        if not part.num_rows:
            continue
        unit = _unit(part.column("v"))
        into = np.concatenate([np.argsort(-(unit[at : at + _BLOCK] @ ix.centers.T), axis=1, kind="stable")[:, :looked].astype(np.int32) for at in range(0, len(unit), _BLOCK)])
        order = np.argsort(into.ravel(), kind="stable")
        starts = np.searchsorted(into.ravel()[order], np.arange(len(ix.centers) + 1))
        held = context.broadcast((part.column("id").to_numpy(), unit, (order // into.shape[1]).astype(np.int32), starts))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, unit, asking, starts = held.value
            best, least, met, waiting = None, np.full(len(ids), -np.inf), [], 0
            for b in batches:
                if not b.num_rows:
                    continue
                own, cell, v = b.column("id").to_numpy(), b.column("cell").to_numpy(), b.column("v")
                for c in np.unique(cell).tolist():
                    who = asking[starts[c] : starts[c + 1]]
                    if not len(who):
                        continue
                    of = np.flatnonzero(cell == c)
                    of = of[np.argsort(own[of], kind="stable")]
                    for first in range(0, len(of), _BLOCK_ROWS):
                        at = of[first : first + _BLOCK_ROWS]
                        other = _unit(v.take(pa.array(at)))
                        for lo in range(0, len(who), _BLOCK):
                            some = who[lo : lo + _BLOCK]
                            s = np.round(unit[some] @ other.T, 12)
                            row, near, value = _best(s, own[at], k)
                            # what can't be among a query's best goes at once
                            kept = value >= least[some[row]]
                            met.append((some[row[kept]], near[kept], value[kept]))
                            waiting += int(kept.sum())
                            if waiting > _WAITING:
                                best = _merged(best, tuple(map(np.concatenate, zip(*met))), k)
                                met, waiting = [], 0
                                first_of = np.flatnonzero(np.diff(best[0], prepend=-1))
                                full = first_of[np.diff(first_of, append=len(best[0])) == k]
                                least[best[0][full]] = best[2][full + k - 1]
            if waiting:
                best = _merged(best, tuple(map(np.concatenate, zip(*met))), k)
            for at in range(0, 0 if best is None else len(best[0]), _WAITING):
                yield _batch(ids, tuple(p[at : at + _WAITING] for p in best))

        wanted = ix.rows
        if len(np.unique(into)) < len(ix.centers) // 2:
            # few cells: the filter on the sorted cell column skips what no query looks into
            wanted = wanted.filter(F.col("cell").isin(np.unique(into).tolist()))
        one = wanted.mapInArrow(run, "query_id bigint, id bigint, similarity double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).filter(F.col("rank") <= k)
