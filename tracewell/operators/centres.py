"""Centres of each group by rounds, without gathering a group: two levels of a signal, the colours of a subject.

Equal rows are counted first, by tasks and then by Spark, and the different ones are sorted over tasks by ranges of (keys, values). A task cuts its run into shares of
SHARE different rows. A group that lies inside one task and one share is finished there. Those that reach a task's edge (two a task at most) are put together if they are no
larger than a share. Larger ones take rounds: each share adds up its rows by nearest centre, and only those sums are exchanged. So a group may hold any part of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.checkpoints import cut

#: Different rows of a group that are looked at together.
SHARE = 1 << 16
#: Rounds between two looks at whether any centre still moves.
STRIDE = 5

#: (rows, centres) -> the number of each row's centre.
Nearest = Callable[[np.ndarray, np.ndarray], np.ndarray]


def by_distance(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre, ties to the first."""
    return ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)


def by_middle(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of two levels the upper one for what is over their middle."""
    return (x[:, 0] > (centres[0, 0] + centres[1, 0]) / 2).astype(np.int64)


def _added(x: np.ndarray, n: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, sums of the rows) of each centre."""
    return np.bincount(near, n, k), np.stack([np.bincount(near, n * c, k) for c in x.T], 1)


def _ranks(total: int, k: int) -> list[int]:
    return [int(j * ((total - 1) / (k - 1))) for j in range(k - 1)] + [total - 1]


def _finished(x: np.ndarray, n: np.ndarray, k: int, rounds: int, nearest: Nearest) -> tuple[np.ndarray, np.ndarray]:
    """(centres, weights of the last round) of rows in order, n of each."""
    centres = x[np.searchsorted(np.cumsum(n), _ranks(int(n.sum()), k), "right")]
    weights = np.zeros(k)
    for _ in range(rounds):
        weights, sums = _added(x, n, nearest(x, centres), k)
        after = np.where(weights[:, None] > 0, sums / np.maximum(weights, 1)[:, None], centres)
        if (after == centres).all():
            break
        centres = after
    return centres, weights


def _shares(keys: int, width: int, k: int, rounds: int, share: int, nearest: Nearest):
    """Sorted rows (keys, values, n) to shares: finished groups have centres and weights, the others their rows and their place in order."""
    names = [*[f"k{i}" for i in range(keys)], "place", "centres", "weights", "x", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []
        size = made = 0

        def out(rows: pa.Table, whole: bool) -> pa.RecordBatch:
            nonlocal made
            values = np.stack([rows.column(keys + i).to_numpy() for i in range(width)], 1).astype(float)
            n = rows.column(keys + width).to_numpy().astype(np.int64)
            some = np.isfinite(values).all(1)
            values, n = values[some], n[some]
            centres = weights = x = counts = None
            if whole and len(n):
                c, w = _finished(values, n, k, rounds, nearest)
                centres, weights = c.ravel().tolist(), w.astype(np.int64).tolist()
            elif not whole:
                x, counts = values.ravel(), n
            made += 1
            types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            cells = [pa.array([v], t) for v, t in zip((first | made, centres, weights, x, counts), types)]
            return pa.RecordBatch.from_arrays([*[rows.column(i).slice(0, 1).combine_chunks() for i in range(keys)], *cells], names)

        # of the group in hand: it begins behind the task's first row; a share of it is out already
        inside = split = False
        last: tuple | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            heads = list(zip(*(table.column(i).to_pylist() for i in range(keys))))
            begins = {i for i, (head, before) in enumerate(zip(heads, [last, *heads])) if head != before}
            stops = sorted({0, *begins, table.num_rows})
            for a, b in zip(stops, stops[1:]):
                if a in begins:
                    if held:
                        yield out(pa.concat_tables(held), inside and not split)
                    held, size, inside, split = [], 0, last is not None or a > 0, False
                while a < b:
                    if size == share:
                        yield out(pa.concat_tables(held), False)
                        held, size, split = [], 0, True
                    step = min(b - a, share - size)
                    held.append(table.slice(a, step))
                    size, a = size + step, a + step
            last = heads[-1] if heads else last
        if held:  # the last group may go on in the next task
            yield out(pa.concat_tables(held), False)

    return run


def _together(ids: list[str], width: int, k: int, rounds: int, nearest: Nearest):
    """Whole groups of a share at most, a row each, to their centres and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, weights = [], []
            for x, n in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("x", "n"))):
                n = np.array(n.values, np.int64)
                c, w = _finished(np.array(x.values, float).reshape(-1, width), n, k, rounds, nearest) if len(n) else (None, None)
                centres.append(None if c is None else c.ravel().tolist())
                weights.append(None if w is None else w.astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*batch.select(ids).columns, pa.array(centres, pa.list_(pa.float64())), pa.array(weights, pa.list_(pa.int64()))], [*ids, "centres", "weights"])

    return run


def centres_by_rounds(rows: DataFrame, keys: Sequence[str], values: Sequence[Column], k: int, rounds: int, nearest: Nearest, share: int | None = None) -> DataFrame:
    """keys, centres (k arrays of as many doubles as values), weights (rows at each centre when it was last moved); NULLs for a group without rows.

    Rows with a NULL, NaN or infinite value are passed over. The first centres are the rows at k evenly spaced ranks, by the values in turn. A centre without rows stays. Null keys are a group; there is a key at least.
    """
    if not keys:
        raise ValueError("no keys")
    ids, names, width = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))], len(values)
    own = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keys, ids)], *[x.cast("double").alias(n) for x, n in zip(values, names)])
    known = ~F.greatest(*[F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")) for n in names]) if width > 1 else ~(F.col("v0").isNull() | F.isnan("v0") | (F.abs("v0") == float("inf")))
    own = own.select(*ids, *[F.when(known, F.col(n)).alias(n) for n in names])  # one row stands for all that are passed over
    counted = own.groupBy(*ids, *names).agg(F.count("*").alias("n"))
    heads = ", ".join(f"{i} {own.schema[i].dataType.simpleString()}" for i in ids)
    ordered = counted.repartitionByRange(*ids, *names).sortWithinPartitions(*ids, *names)
    shares = cut(ordered.mapInArrow(_shares(len(ids), width, k, rounds, share or SHARE, nearest), f"{heads}, place long, centres array<double>, weights array<long>, x array<double>, n array<long>"))
    done = shares.where("x is null").select(*ids, "centres", "weights")
    open_ = shares.where("x is not null").select(*ids, "place", "x", "n")
    sizes = open_.groupBy(*ids).agg(F.sum(F.size("n")).alias("different")).select(*[F.col(i).alias(f"s_{i}") for i in ids], "different")
    sized = open_.join(sizes, [F.col(i).eqNullSafe(F.col(f"s_{i}")) for i in ids])
    small = sized.where(F.col("different") <= (share or SHARE)).groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("place", "x", "n"))).alias("listed"))
    together = small.select(*ids, F.flatten(F.transform("listed", lambda s: s["x"])).alias("x"), F.flatten(F.transform("listed", lambda s: s["n"])).alias("n"))
    out = done.unionByName(together.mapInArrow(_together(ids, width, k, rounds, nearest), f"{heads}, centres array<double>, weights array<long>"))
    large = sized.where(F.col("different") > (share or SHARE)).select(*ids, "place", "x", "n")
    if not large.isEmpty():
        out = out.unionByName(_by_rounds(large, ids, heads, width, k, rounds, nearest))
    centres = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice("centres", i * width + 1, width))
    return out.select(*[F.col(i).alias(c) for i, c in zip(ids, keys)], F.when(F.col("centres").isNotNull(), centres).alias("centres"), "weights")


def _by_rounds(shares: DataFrame, ids: list[str], heads: str, width: int, k: int, rounds: int, nearest: Nearest) -> DataFrame:
    def joined(small: DataFrame) -> DataFrame:
        """Shares with what is known of their group. It is a row a group, of groups that reach an edge or are larger than a share; whether it is broadcast is Spark's to see from its size."""
        small = small.select(*[F.col(i).alias(f"s_{i}") for i in ids], *[c for c in small.columns if c not in ids])
        same = [F.col(i).eqNullSafe(F.col(f"s_{i}")) for i in ids]
        return shares.join(small, same).drop(*[f"s_{i}" for i in ids])

    # the rows at k ranks
    sizes = shares.select(*ids, "place", F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("held"))
    totals = sizes.groupBy(*ids).agg(F.sum("held").alias("total"), F.array_sort(F.collect_list(F.struct("place", "held"))).alias("listed"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads_, place = batch.select(ids), batch.column(batch.schema.get_field_index("place")).to_pylist()
            found = []
            for i in range(batch.num_rows):
                row = {c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("x", "n", "total", "listed")}
                before = sum(s["held"] for s in row["listed"] if s["place"] < place[i])
                ends = before + np.cumsum(np.array(row["n"], np.int64))
                for j, r in enumerate(_ranks(row["total"], k) if row["total"] else []):
                    if len(ends) and before <= r < ends[-1]:
                        at = int(np.searchsorted(ends, r, "right"))
                        found.append((i, j, row["x"][at * width : (at + 1) * width]))
            if found:
                at = pa.array([f[0] for f in found])
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in heads_.columns], pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.list_(pa.float64()))], [*ids, "j", "x"])

    begun = joined(totals).mapInArrow(picked, f"{heads}, j int, x array<double>").groupBy(*ids).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"])).alias("centres"))
    every = shares.select(*ids).distinct()
    state = cut(begun.select(*ids, "centres", F.lit(None).cast("array<long>").alias("weights"), F.lit(True).alias("moved")))
    sums = [f"w{c}" for c in range(k)] + [f"s{i}" for i in range(k * width)]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for x, n, c in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("x", "n", "centres"))):
                x, n = np.array(x.values, float).reshape(-1, width), np.array(n.values, np.int64)
                weights, total = _added(x, n, nearest(x, np.array(c.values, float).reshape(k, width)), k)
                found.append(np.concatenate([weights, total.ravel()]))
            found = np.stack(found)
            yield pa.RecordBatch.from_arrays([*batch.select([*ids, "centres"]).columns, *[pa.array(c) for c in found.T]], [*ids, "centres", *sums])

    for turn in range(rounds):
        summed = joined(state.select(*ids, "centres")).mapInArrow(added, f"{heads}, centres array<double>, {', '.join(f'{s} double' for s in sums)}")
        total = summed.groupBy(*ids).agg(F.any_value("centres").alias("before"), *[F.sum(s).alias(s) for s in sums])
        after = F.array(*[F.when(F.col(f"w{c}") > 0, F.col(f"s{c * width + i}") / F.col(f"w{c}")).otherwise(F.col("before")[c * width + i]) for c in range(k) for i in range(width)])
        state = total.select(*ids, after.alias("centres"), F.array(*[F.col(f"w{c}").cast("long") for c in range(k)]).alias("weights"), (after != F.col("before")).alias("moved"))
        if turn % STRIDE == STRIDE - 1 and turn < rounds - 1:
            state = cut(state)
            if state.where("moved").isEmpty():
                break
    told = state.select(*[F.col(i).alias(f"s_{i}") for i in ids], "centres", "weights")
    same = [F.col(i).eqNullSafe(F.col(f"s_{i}")) for i in ids]
    return every.join(told, same, "left").select(*ids, "centres", "weights")


def two_means(rows: DataFrame, keys: Sequence[str], x: str, rounds: int = 20, flat: float = 1.25, share: int | None = None) -> DataFrame:
    """keys, threshold, low, high, split: two centres of one signal; no split where the higher is under `flat` times the lower, or where there is no value (NULLs)."""
    found = centres_by_rounds(rows, keys, [F.col(f"`{x}`")], 2, rounds, by_middle, share)
    low, high = F.col("centres")[0][0], F.col("centres")[1][0]
    split = F.coalesce(high >= flat * F.greatest(low, F.lit(1e-9)), F.lit(False))
    return found.select(*[f"`{c}`" for c in keys], ((low + high) / 2).alias("threshold"), low.alias("low"), high.alias("high"), split.alias("split"))


def palette(rows: DataFrame, keys: Sequence[str], colour: str, k: int = 5, least: int = 200, rounds: int = 15, share: int | None = None) -> DataFrame:
    """keys, colours (lab centre and share, largest first), chroma_at (place of the most chromatic over 5 %), diversity (entropy, natural log); NULLs under `least` pixels."""
    found = centres_by_rounds(rows, keys, [F.get(F.col(f"`{colour}`"), F.lit(i)) for i in range(3)], k, rounds, by_distance, share)
    total = F.aggregate("weights", F.lit(0).cast("long"), lambda a, b: a + b)
    ordered = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct((-F.get("weights", i) / total).alias("rest"), i.alias("i"), F.get("centres", i).alias("lab"))))
    colours = F.transform(ordered, lambda c: F.struct(c["lab"].alias("lab"), (-c["rest"]).alias("share")))
    named = found.select(*[f"`{c}`" for c in keys], F.when(total >= least, colours).alias("colours"))
    chroma = F.transform("colours", lambda c, i: F.struct(F.when(c["share"] > 0.05, F.hypot(c["lab"][1], c["lab"][2])).otherwise(-1.0).alias("chroma"), (-i).alias("i")))
    entropy = F.aggregate(F.filter("colours", lambda c: c["share"] > 0), F.lit(0.0), lambda a, c: a - c["share"] * F.log(c["share"]))
    return named.withColumns({"chroma_at": -F.array_max(chroma)["i"], "diversity": entropy})
