"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers. A cell holds a block of queries and a share of the candidates; a task reads its cell's queries
and then the candidates batch after batch, as postings: for every dimension the candidates that have it and their
weights. A query's non-zero weights are scattered over those postings into a dense array of scores, one dimension after
the other, of which partition selection keeps the best. The cells' lists are merged by query.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.session import batch, partitions

SCALE = 256
# Queries of a block; candidates scored at a time.
BLOCK, AT_ONCE = 4096, 4096

_BEST = "query_id long, vec_id long, score long"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    length = np.asarray(pc.list_value_length(column)).astype(np.int64)
    out = np.zeros((len(column), int(length.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(column)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    out[row, place] = np.asarray(column.flatten())
    return out


def accumulate(dims: np.ndarray, weights: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], count: int) -> np.ndarray:
    """Scores of all candidates for one sparse query. A posting without places has every candidate."""
    score = np.zeros(count, np.int64)
    for dim, weight in zip(dims, weights):
        if dim < len(postings):
            place, value = postings[dim]
            if place is None:
                score += weight * value
            else:
                score[place] += weight * value
    return score


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in order."""
    place = np.arange(len(score))
    if len(score) > k:
        place = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return place[np.lexsort((ids[place], -score[place]))][:k]


def _search(k: int):
    """Over rows sorted by cell, queries first: each cell's best candidates of each of its queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, kept = None, [], {}

        def told() -> Iterator[pa.RecordBatch]:
            rows = [(q, i, s) for (_, q), (ids, scores) in kept.items() for i, s in zip(ids.tolist(), scores.tolist())]
            if rows:
                yield batch(_BEST, *(pa.array(list(c), pa.int64()) for c in zip(*rows)))

        for rows in batches:
            key = np.stack([np.asarray(rows.column(c)) for c in ("block", "chunk", "candidate")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), rows.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if (key[0, a], key[1, a]) != cell:
                    yield from told()
                    cell, queries, kept = (key[0, a], key[1, a]), [], {}
                for low in range(a, b, AT_ONCE):
                    part = rows.slice(low, min(AT_ONCE, b - low))
                    ids, matrix = np.asarray(part.column("vec_id")), _matrix(part.column("vector"))
                    if not key[2, a]:
                        queries += [(int(i), np.flatnonzero(v), v[v != 0]) for i, v in zip(ids, matrix)]
                        continue
                    postings = []
                    for column in np.ascontiguousarray(matrix.T):
                        place = np.flatnonzero(column)
                        postings.append((None, column) if len(place) * 2 > len(column) else (place, column[place]))
                    for number, (query, dims, weights) in enumerate(queries):
                        score = accumulate(dims, weights, postings, len(ids))
                        other = ids != query
                        own, score = (ids, score) if other.all() else (ids[other], score[other])
                        place = best(own, score, k)
                        own, score = own[place], score[place]
                        if (number, query) in kept:
                            own = np.concatenate([kept[number, query][0], own])
                            score = np.concatenate([kept[number, query][1], score])
                            place = best(own, score, k)
                            own, score = own[place], score[place]
                        kept[number, query] = own, score
        yield from told()

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller key.

    Queries are the rows whose key is divisible by ``every``, candidates all rows but those of the query's key. A
    component x counts as floor(scale * x). Vectors that are null or hold a null, NaN or infinite component, and rows
    with a null key, take no part. A shorter vector counts as filled up with zeros, an empty one scores 0. Rows of one
    key are candidates of their own, but one query, by the smallest of their vectors. Queries without candidates have
    no rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    chunks = partitions(spark)
    value = F.col(f"`{vector}`").cast("array<double>")
    usable = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.when(usable, F.transform(value, lambda x: F.floor(x * scale))).alias("vector"))
    rows = rows.where("vec_id is not null and vector is not null")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = -(-queries.count() // block) or 1
    cells = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    asked = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), cells.alias("chunk"), F.lit(0).alias("candidate"), "vec_id", "vector")
    given = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(chunks)).cast("int").alias("chunk"),
        F.lit(1).alias("candidate"),
        "vec_id",
        "vector",
    )
    sorted_ = asked.union(given).repartition(chunks, "block", "chunk").sortWithinPartitions("block", "chunk", "candidate")
    found = sorted_.mapInArrow(_search(k), _BEST)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
