"""Exact top-k inner-product search with vector-approximation files.

Vectors travel in blocks. A block holds its vectors twice: as cells (one byte a component, between the block's least and greatest value of
that component) and exactly. A query scans the cells, which bound every score from both sides, then reads exact vectors in the order of their
bounds until no unread one can reach the k-th result. Results carry over from block to block, so later blocks are mostly pruned.

Queries and vectors meet on a grid: queries are dealt to rows, vectors to columns, and each is copied to the grid's cells of its row or column.
A cell holds a bounded share of either side, so nothing is broadcast and no task sees all rows. Every cell keeps k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.store import shuffle_partitions

#: Vectors of a block, and bytes of exact vectors that a grid row or column aims at.
BLOCK = 2048
SHARE = 32 << 20
#: Tasks that cells are dealt to, at most; each takes its cells one after the other.
TASKS = 100_000
#: The greatest score that is told from greater ones.
MOST = 10**38 - 1
_PACKED = "kind int, lot int, size int, ids binary, exact binary, cells binary, low binary, step binary"


def whole_components(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, floor(scale * x) of their components, flat: whole numbers as doubles).

    A row takes part if neither it nor a component, scaled or not, is null or not finite.
    """
    length = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = vectors.flatten()
    with np.errstate(over="ignore"):
        x = np.floor(scale * inner.cast(pa.float64()).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(length)), np.maximum(length, 0))
    good = length >= 0
    good[row[~np.isfinite(x)]] = False
    return np.flatnonzero(good), length[good], x[good[row]]


def _bytes(exact: np.ndarray) -> bytes:
    """Four bytes a component if all fit, else eight."""
    return exact.astype(np.int32 if not exact.size or np.abs(exact).max() < 2**31 else np.float64).tobytes()


def _matrix(raw: bytes, rows: int, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * rows * size else np.float64).reshape(rows, size).astype(np.float64)


def _pack(scale: float, rows: int, columns: int):
    def block(kind: int, lot: int, ids: np.ndarray, exact: np.ndarray) -> tuple:
        if kind == 0:
            return kind, lot, exact.shape[1], ids.tobytes(), _bytes(exact), None, None, None
        low = exact.min(0)
        step = np.maximum(exact.max(0) / 255 - low / 255, 1 / 255)
        cells = np.clip((exact - low) / step, 0, 255).astype(np.uint8)
        return kind, lot, exact.shape[1], ids.tobytes(), _bytes(exact), cells.tobytes(), low.tobytes(), step.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() * 7919
        for batch in batches:
            taking, length, flat = whole_components(batch.column(1), scale)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[taking]
            asks = batch.column(2).to_numpy(zero_copy_only=False)[taking].astype(bool)
            begin = np.cumsum(length) - length
            out = []
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                exact = flat[begin[own][:, None] + np.arange(size)]
                for kind, some, lots in ((1, np.arange(len(own)), columns), (0, np.flatnonzero(asks[own]), rows)):
                    for a in range(0, len(some), BLOCK):
                        part = some[a : a + BLOCK]
                        out.append(block(kind, n % lots, ids[own[part]], exact[part]))
                        n += 1
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["kind", "lot", "size", "ids", "exact", "cells", "low", "step"])

    return run


class _Queries:
    """The queries of one grid cell and one vector length, with the best results so far.

    Scores are doubles as long as no sum of products can pass 2**53, and Python's whole numbers from then on.
    """

    def __init__(self, ids: np.ndarray, exact: np.ndarray, k: int):
        self.ids, self.exact, self.k = ids, exact, k
        self.peak = float(np.abs(exact).max(initial=0))
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, ids: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> None:
        most = float(np.abs(exact).max(initial=0)) * self.peak * max(1, exact.shape[1])
        if most >= 2.0**53 and self.score.dtype != object:
            self.score = np.array([[int(x) if np.isfinite(x) else x for x in row] for row in self.score.tolist()], object).reshape(self.score.shape)
        middle = low + (cells + 0.5) * step
        for a in range(0, len(self.ids), 512):
            self._scan(slice(a, min(a + 512, len(self.ids))), ids, exact, middle, step, most)

    def _least(self, part: slice) -> np.ndarray:
        """A double not above each query's k-th score."""
        last = self.score[part][:, -1]
        if last.dtype != object:
            return last
        return np.array([x if x == -np.inf else np.nextafter(float(min(max(x, -(10**300)), 10**300)), -np.inf) for x in last], float)

    def _scan(self, part: slice, ids: np.ndarray, exact: np.ndarray, middle: np.ndarray, step: np.ndarray, most: float) -> None:
        q, own = self.exact[part], self.ids[part]
        taken = own[:, None] != ids[None, :]
        if most >= 1e300:  # no bound can be computed: all are read
            self._take(part, *np.nonzero(taken), ids, exact, most)
            return
        near = q @ middle.T
        slack = np.abs(q) @ (step / 2)
        # the rounding of two sums of products, each product at most |q| * (|middle| + step)
        slack += (len(step) + 8) * 2.0**-51 * (np.abs(q) @ (np.abs(middle).max(0) + step)) + 1e-6
        near[~taken] = -np.inf
        k = min(self.k, near.shape[1])
        # the k best bounds are read first; what cannot reach the k-th result so far is not read
        first = np.argpartition(-near, k - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(q)), k)
        read = np.zeros(near.shape, bool)
        read[rows, first.ravel()] = True
        read &= near + slack[:, None] >= self._least(part)[:, None]
        self._take(part, *np.nonzero(read & taken), ids, exact, most)
        rest = (near + slack[:, None] >= self._least(part)[:, None]) & taken
        rest[rows, first.ravel()] = False
        self._take(part, *np.nonzero(rest), ids, exact, most)

    def _take(self, part: slice, rows: np.ndarray, at: np.ndarray, ids: np.ndarray, exact: np.ndarray, most: float) -> None:
        if not len(rows):
            return
        own = self.exact[part]
        if most < 2.0**53:
            score = np.concatenate([np.einsum("ij,ij->i", own[rows[a : a + 65536]], exact[at[a : a + 65536]]) for a in range(0, len(rows), 65536)])
            if self.score.dtype == object:
                score = np.array([int(x) for x in score.tolist()], object)
        else:
            whole = {i: [int(x) for x in own[i].tolist()] for i in np.unique(rows).tolist()}, {i: [int(x) for x in exact[i].tolist()] for i in np.unique(at).tolist()}
            score = np.array([sum(x * y for x, y in zip(whole[0][i], whole[1][j])) for i, j in zip(rows.tolist(), at.tolist())], object)
        held = np.arange(part.start, part.stop)
        query = np.concatenate([rows, np.repeat(held - part.start, self.k)])
        score, found = np.concatenate([score, self.score[part].ravel()]), np.concatenate([ids[at], self.found[part].ravel()])
        if score.dtype == object:
            order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], found[i])), np.int64)
        else:
            order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < self.k
        self.score[part] = score[best].reshape(-1, self.k)
        self.found[part] = found[best].reshape(-1, self.k)

    def results(self) -> pa.RecordBatch:
        some = self.score != -np.inf
        rows = np.nonzero(some)[0]
        scores = [Decimal(min(max(int(x), -MOST), MOST)) for x in self.score[some].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[rows]), pa.array(self.found[some]), pa.array(scores, pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, lots = None, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    yield from (x.results() for x in asked.values())
                    cell, asked, lots = row["cell"], {}, {}
                size = row["size"]
                ids = np.frombuffer(row["ids"], np.int64)
                exact = _matrix(row["exact"], len(ids), size)
                if row["kind"] == 0:
                    lots.setdefault(size, []).append((ids, exact))
                    continue
                if size in lots:
                    held = lots.pop(size)
                    asked[size] = _Queries(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k)
                if size in asked:
                    cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), size)
                    asked[size].scan(ids, exact, cells, np.frombuffer(row["low"]), np.frombuffer(row["step"]))
        yield from (x.results() for x in asked.values())

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows of greatest integer inner product, ties to the smaller vec_id.

    Components become floor(scale * x). vectors has vec_id and embedding; is_query is a condition over vec_id. Rows take no part if
    vec_id or embedding is null or a component is null or not finite. Vectors meet those of their own length only. A query passes over rows that bear
    its vec_id; other repeated rows each take a rank; repeated query rows are asked once, with their best scores. Fewer than k rows give fewer ranks;
    an empty table gives an empty table. Scores are sums of whole numbers without rounding; beyond a long they are held at its limits, but ranked exactly up to 38 digits.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    sums = rows.agg(F.sum(F.size("embedding")).alias("all"), F.sum(F.when(F.col("asks"), F.size("embedding"))).alias("asked")).first()
    grid_rows = max(1, -(-4 * (sums["asked"] or 0) // SHARE))
    grid_columns = max(1, -(-4 * (sums["all"] or 0) // SHARE), min(shuffle_partitions(spark), (sums["all"] or 0) // (BLOCK * 64)))
    packed = rows.mapInArrow(_pack(scale, grid_rows, grid_columns), _PACKED)
    copies = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.lit(grid_columns - 1))).otherwise(F.sequence(F.lit(0), F.lit(grid_rows - 1)))
    dealt = packed.select("*", F.explode(copies).alias("other"))
    dealt = dealt.withColumn("cell", F.when(F.col("kind") == 0, F.col("lot").cast("long") * grid_columns + F.col("other")).otherwise(F.col("other").cast("long") * grid_columns + F.col("lot")).cast("long"))
    met = dealt.drop("lot", "other").withColumn("task", F.pmod("cell", F.lit(min(TASKS, grid_rows * grid_columns))).cast("int"))
    met = met.repartitionById(min(TASKS, grid_rows * grid_columns), "task").drop("task").sortWithinPartitions("cell", "kind")
    best = met.mapInArrow(_search(k), "query_id long, vec_id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", F.least(F.greatest("score", F.lit(-(2**63))), F.lit(2**63 - 1)).cast("long").alias("score")).where(F.col("rank") <= k)
