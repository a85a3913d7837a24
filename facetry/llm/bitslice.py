"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to floor(256 x). The index cuts the vectors into blocks of
``BLOCK`` rows; a block keeps, per dimension, its smallest value and the binary digits of
value - smallest as bitmaps over the block's rows: slice (d, b) has the rows whose
dimension d has bit b.

A query's score is a sum of slices times powers of two: bit j of |q_d| adds slice (d, b)
at weight b + j (of the complement, where q_d is negative). The slices of each weight
are added with bitmap full adders, three bitmaps to a sum and a carry, until one bitmap
is left per weight; those are the score's own slices. Top rows are selected from the most
significant slice downward: rows known to be in the top k, rows still tied. The rows
tied at the boundary are resolved exactly, by score and then smaller id.

Blocks report k rows a query at most, and the best k of those are the result. Queries
go to the tasks ``QUERIES`` at a time; each part is a job of its own whose result is
written before the next part is sent, so neither a plan nor what is broadcast grows.

Edge cases: null vectors and vectors with null or non-finite components (256 x that is
no finite double counts as such) take no part, as query or candidate; vectors of another
length than the query's aren't its candidates; a null id takes no part; equal scores go by
smaller id; a repeated row is a candidate each time but one query, never its own candidate;
an empty table gives an empty result; extra columns are ignored. Vectors with a component
beyond ``WIDE`` aren't sliced, and where scores might not fit 62 bits slices aren't added:
there scores are added up as integers of any length. A score beyond a long is returned as
the nearest long and ranked as a double.
"""

from __future__ import annotations

import heapq
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_type, scratch_dir, settle, shuffle_partitions

SCALE = 256
TOP = 5
EVERY = 50
#: Rows of a block of the index.
BLOCK = 8192
#: Queries in one broadcast.
QUERIES = 8192
#: Quantised components from here on are kept as they are.
WIDE = float(1 << 40)
LONGEST = (1 << 63) - 1
LARGEST = int(sys.float_info.max)
#: ``values`` has the components of a block that isn't sliced.
INDEX = "dims int, ids binary, low binary, bits binary, slices binary, values binary"


RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.float64())


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, q): floor(256 x) of usable vectors, as doubles (which hold it exactly)."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: v * SCALE)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    used = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & (F.size(vector) > 0))
    # doubles beyond 2^53 are whole already
    return used.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)).alias("q"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Block:
    """Bitmaps of a block: ``slices[d]`` has ``bits[d]`` rows of packed words."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: np.ndarray, values: np.ndarray | None = None):
        self.ids, self.low, self.bits, self.slices, self.wide = ids, low, bits, slices, values
        self.first = np.concatenate(([0], np.cumsum(bits)))
        self.words = -(-len(ids) // 64)
        self.rows = np.full(self.words, ~np.uint64(0))
        if len(ids) % 64:
            self.rows[-1] = np.uint64((1 << (len(ids) % 64)) - 1)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        if np.abs(values).max(initial=0) >= WIDE:
            return cls(ids, np.zeros(values.shape[1], np.int64), np.zeros(values.shape[1], np.int64), np.zeros((0, -(-len(ids) // 64)), np.uint64), values)
        values = values.astype(np.int64)
        low = values.min(axis=0)
        rest = (values - low).astype(np.uint64)
        bits = np.array([int(m).bit_length() for m in rest.max(axis=0)], np.int64)
        words = -(-len(ids) // 64)
        slices = np.zeros((int(bits.sum()), words * 8), np.uint8)
        at = 0
        for d, n in enumerate(bits.tolist()):
            for b in range(n):
                packed = np.packbits((rest[:, d] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
                slices[at, : len(packed)] = packed
                at += 1
        return cls(ids, low, bits, slices.view(np.uint64))

    def row(self) -> dict:
        values = None if self.wide is None else self.wide.tobytes()
        return {"dims": len(self.low), "ids": self.ids.tobytes(), "low": self.low.tobytes(), "bits": self.bits.tobytes(), "slices": self.slices.tobytes(), "values": values}

    @classmethod
    def read(cls, row: dict) -> Block:
        ids, low, bits = (np.frombuffer(row[n], np.int64) for n in ("ids", "low", "bits"))
        values = None if row["values"] is None else np.frombuffer(row["values"], np.float64).reshape(len(ids), -1)
        return cls(ids, low, bits, np.frombuffer(row["slices"], np.uint64).reshape(int(bits.sum()), -(-len(ids) // 64)), values)

    def fits(self, query: np.ndarray) -> bool:
        """Whether slices can be added for this query: all scores fit 62 bits."""
        if self.wide is not None or np.abs(query).max(initial=0) >= WIDE:
            return False
        most = np.maximum(np.abs(self.low.astype(float)), np.abs(self.low + 2.0**self.bits))
        return float((np.abs(query) * most).sum()) < 2.0**59

    def components(self) -> list[list[int]]:
        """The rows' components as integers of any length, read off the slices."""
        if self.wide is not None:
            return [[int(x) for x in row] for row in self.wide.tolist()]
        columns = []
        for d, n in enumerate(self.bits.tolist()):
            own = np.full(len(self.ids), self.low[d])
            for b in range(n):
                digits = np.unpackbits(self.slices[self.first[d] + b].view(np.uint8), bitorder="little")[: len(self.ids)]
                own = own + (digits.astype(np.int64) << b)
            columns.append(own)
        return np.stack(columns, axis=1).tolist()

    def top_of_any_length(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        sought = [int(x) for x in query.tolist()]
        scored = ((sum(a * b for a, b in zip(sought, row)), int(i)) for i, row in zip(self.ids, self.components()) if i != own_id)
        return heapq.nsmallest(k, scored, key=lambda x: (-x[0], x[1]))

    def addends(self, query: np.ndarray) -> tuple[dict[int, list[np.ndarray]], int]:
        """Bitmaps to add up by weight, and the constant that completes the score."""
        by_weight: dict[int, list[np.ndarray]] = {}
        constant = int(sum(int(q) * int(m) for q, m in zip(query, self.low)))
        for d, q in enumerate(query.tolist()):
            n = int(self.bits[d])
            if not q or not n:
                continue
            own = self.slices[self.first[d] : self.first[d] + n]
            if q < 0:  # q u = |q| (top - u) - |q| top
                own = ~own & self.rows
                constant += q * ((1 << n) - 1)
            q = abs(q)
            for j in range(q.bit_length()):
                if q >> j & 1:
                    for b in range(n):
                        by_weight.setdefault(b + j, []).append(own[b])
        return by_weight, constant

    def score_slices(self, by_weight: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
        """Slices of the sum, from weight 0: carry-save adders on stacks of bitmaps."""
        out: list[np.ndarray] = []
        weight, carried = 0, np.zeros((0, self.words), np.uint64)
        while weight <= max(by_weight, default=-1) or len(carried):
            own = by_weight.get(weight)
            stack = np.concatenate((np.stack(own), carried)) if own else carried
            carries = []
            while len(stack) > 2:
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carries.append(a & b | half & c)
                stack = np.concatenate((half ^ c, stack[3 * third :]))
            if len(stack) == 2:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carries) if carries else np.zeros((0, self.words), np.uint64)
            weight += 1
        return out

    def top(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, without the query's own id; best first."""
        if not self.fits(query):
            return self.top_of_any_length(query, own_id, k)
        query = query.astype(np.int64)
        by_weight, constant = self.addends(query)
        slices = self.score_slices(by_weight)
        tied = self.rows.copy()
        for at in np.flatnonzero(self.ids == own_id).tolist():
            tied[at >> 6] &= ~np.uint64(1 << (at & 63))
        sure = np.zeros(self.words, np.uint64)
        n_sure = 0
        for piece in reversed(slices):
            above = tied & piece
            n = int(np.bitwise_count(above).sum())
            if n_sure + n > k:
                tied = above
            elif n_sure + n == k:
                sure, tied, n_sure = sure | above, np.zeros_like(tied), k
                break
            else:
                sure, tied, n_sure = sure | above, tied & ~piece, n_sure + n
        found = rows_of(sure).tolist()
        boundary = rows_of(tied)
        found += boundary[np.argsort(self.ids[boundary], kind="stable")][: k - n_sure].tolist()
        picked = np.array(found, np.int64)
        score = np.full(len(picked), constant, np.int64)
        for w, piece in enumerate(slices):
            score += ((piece[picked >> 6] >> (picked & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        return sorted(zip(score.tolist(), self.ids[picked].tolist()), key=lambda x: (-x[0], x[1]))


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each block of vectors of one length: ids, smallest values, bit counts, slices.
    Vectors with wide components have blocks of their own."""
    out = arrow_type(vectors.sparkSession.createDataFrame([], INDEX).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def made(kind: tuple[int, bool]) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(kind)))
            return pa.RecordBatch.from_pylist([Block.of(ids[i : i + BLOCK], values[i : i + BLOCK]).row() for i in range(0, len(ids), BLOCK)], schema=out)

        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(1)], np.int64)
            for dims in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dims))
                ids, values = own.column(0).to_numpy(), matrix(own.column(1), dims)
                wide = np.abs(values).max(axis=1) >= WIDE
                for kind in np.unique(wide).tolist():
                    held.setdefault((dims, kind), []).append((ids[wide == kind], values[wide == kind]))
                    if sum(len(x[0]) for x in held[dims, kind]) >= BLOCK:
                        yield made((dims, kind))
        for kind in list(held):
            yield made(kind)

    return quantised(vectors, key, vector).mapInArrow(run, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for queries (id, q), the k best rows of the index."""
    spark = index.sparkSession
    path = f"{scratch_dir(spark)}/found-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(path)
    for part in query_parts(queries):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.read(row)
                    found = []
                    for query_id, query in zip(*shared.value):
                        if len(query) == row["dims"]:
                            found += [(query_id, v, max(-LONGEST, min(LONGEST, s)), float(max(-LARGEST, min(LARGEST, s)))) for s, v in block.top(query, query_id, k)]
                    columns = zip(*found) if found else ([], [], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, TYPES)], names=["query_id", "vec_id", "score", "place"])

        # a block is much work: deal blocks to all cores
        found = index.repartition(shuffle_partitions(spark)).mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, place double")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("place").desc(), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(RESULT).parquet(path)


def query_parts(queries: DataFrame) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Queries in bounded parts; only one part is held by the driver at a time."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []
    for row in queries.toLocalIterator():
        ids.append(row["id"])
        vectors.append(np.array(row["q"], np.float64))
        if len(ids) >= QUERIES:
            yield ids, vectors
            ids, vectors = [], []
    if ids:
        yield ids, vectors


def search_digest(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """Contract of op9: queries are the rows whose id is divisible by ``every``."""
    index = settle(build_index(vectors), "index")
    queries = settle(quantised(vectors, "vec_id", "embedding").filter(F.col("id") % every == 0).distinct(), "queries")
    return search(index, queries, k)


SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
