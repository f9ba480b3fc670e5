"""Best-fit packing with Martello-Toth dominance reduction.

Documents are tokenised once; what follows needs only lengths. A sequence's fill is decided on the histogram of piece lengths, which
has at most `capacity` entries however many documents there are: first document sets that provably dominate every alternative are
fixed and leave the instance, then the rest is packed best-fit, longest first. Equal lengths are handled together, so the plan's size
follows the number of different lengths. Pieces find their place by their rank among pieces of their length:
rank inside the task that tokenised them, plus the counts of the tasks before it. No group is gathered and nothing is sorted.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.store import written
from tracewell.llm.text import bytes_of, once, pieces, plain, spans

CAPACITY = 2048
END_ID = 0
#: Chunks whose ids a Python worker keeps.
KNOWN_CHUNKS = 300_000

class Encoder:
    """A tokenizer with the ids of the chunks that it has met lately, so that a chunk is seldom encoded twice. What is kept never changes a result."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        # byte-level pieces have a character for each byte; added tokens stand for themselves
        self.bytes = np.zeros(self.own.get_vocab_size(), np.int64)
        for piece, i in self.own.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(piece)
        for i, token in self.own.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self.chunks = pa.array([], pa.large_string())
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has). Chunks that keep apart by themselves go through the tokenizer many at a time, as one text; the
        bytes that each id stands for tell where a chunk ends."""
        data, offsets = bytes_of(chunks)
        space, solid = _white(data)
        joins = space[offsets[:-1]] & solid[offsets[1:] - 1] if len(chunks) else np.zeros(0, bool)
        size, parts = np.zeros(len(chunks), np.int64), []
        together = np.flatnonzero(joins)
        for a in range(0, len(together), 1000):
            own = chunks.take(pa.array(together[a : a + 1000]))
            text, ends = bytes_of(own)
            ids = np.array(self._encoded([text.tobytes().decode()])[0], np.int32)
            at = np.searchsorted(np.cumsum(self.bytes[ids]), ends[1:]) + 1
            size[together[a : a + 1000]] = np.diff(at, prepend=0)
            parts.append(ids)
        alone = np.flatnonzero(~joins)
        found = self._encoded(chunks.take(pa.array(alone)).to_pylist())
        size[alone] = [len(x) for x in found]
        parts.append(np.array([i for x in found for i in x], np.int32))
        flat = np.concatenate(parts)
        order = np.concatenate([together, alone])
        begin = np.empty(len(chunks), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return flat[spans(begin, size)], size

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, where each chunk's begin there, how many they are)."""
        at = pc.index_in(chunks, value_set=self.chunks).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        fresh = chunks.take(pa.array(new))
        ids, size = self._fresh(fresh)
        begin = np.cumsum(size) - size
        pool = np.concatenate([self.ids, ids])
        starts, sizes = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        old = np.flatnonzero(at >= 0)
        starts[old], sizes[old] = self.start[at[old]], self.size[at[old]]
        starts[new], sizes[new] = begin + len(self.ids), size
        if len(self.chunks) + len(fresh) > KNOWN_CHUNKS:
            self.chunks, self.ids, self.start, self.size = fresh, ids, begin, size
        else:
            self.chunks = pa.concat_arrays([self.chunks, fresh])
            self.ids, self.start, self.size = pool, np.concatenate([self.start, begin + len(self.ids)]), np.concatenate([self.size, size])
        return pool, starts, sizes


def _white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ASCII white space, last byte of a character that surely is none). A non-ASCII character is surely none if it has two bytes and is not in
    U+0080 to U+00BF, where white space lies."""
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    solid = ~space & (data < 0x80)
    solid[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    return space, solid


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of the texts); each distinct chunk of a batch is encoded once.

    A chunk begins at ASCII white space after a character that is none. The pattern that splits text before the merges
    always splits there, and no special token holds white space, so chunks are encoded as the whole text would be.
    """
    data, offsets = bytes_of(texts)
    if len(data) == 0:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space, solid = _white(data)
    new = space.copy()
    new[1:] &= solid[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.append(np.flatnonzero(new), len(data))
    of = np.searchsorted(begin, offsets)
    coded = pa.Array.from_buffers(pa.large_string(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data.tobytes())]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    pool, start, size = once(f"encoder {path}", lambda: Encoder(path)).of(coded.dictionary)
    per = size[codes]
    return pool[spans(start[codes], per)], np.concatenate(([0], np.cumsum(per)))[of]


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for piece in pieces(batches, "text", 2 << 20):
            ids, offsets = encode(plain(piece, "text"), path)
            n = len(offsets) - 1
            ended = np.full(len(ids) + n, END_ID, np.int32)
            at = np.ones(len(ended), bool)
            at[offsets[1:] + np.arange(n)] = False
            ended[at] = ids
            offsets = offsets + np.arange(n + 1)
            size = np.diff(offsets)
            parts = -(-size // capacity)
            first = size - (parts - 1) * capacity
            doc = np.repeat(np.arange(n), parts)
            nth = spans(np.zeros(n, np.int64), parts)
            start = np.where(nth > 0, first[doc] + (nth - 1) * capacity, 0)
            length = np.where(nth > 0, capacity, first[doc])
            raw = ended.astype("<u4").tobytes()
            lo = (offsets[doc] + start).tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(lo, length.tolist())]
            # rank among this task's pieces of the same length
            order = np.argsort(length, kind="stable")
            edge = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(edge[:-1], np.diff(edge)) + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            doc_ids = piece.column(piece.schema.get_field_index("doc_id")).take(pa.array(doc))
            out = [doc_ids, pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if keep_ids:
                ends = np.append(offsets[doc] + start, len(ended))
                out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ended.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


class Plan:
    """Patterns (lengths of a sequence in turn) with the number of sequences filled so."""

    def __init__(self, capacity: int):
        self.capacity, self.patterns = capacity, []

    def add(self, pattern: tuple[int, ...], count: int) -> None:
        if count:
            self.patterns.append((pattern, count))

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def places(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, offset), by length and rank."""
        used, rows, sequence = defaultdict(int), [], 0
        for pattern, count in self.patterns:
            at = 0
            for length in pattern:
                rows.append((length, used[length], sequence, at))
                used[length] += count
                at += length
            sequence += count
        return np.array(sorted(rows), np.int64).reshape(-1, 4)


def reduce_dominated(left: np.ndarray, plan: Plan) -> None:
    """Martello and Toth's reduction: fix sets that dominate every other feasible set holding the same longest item.

    left[l]: items of length l still to place; fixed sets leave it. For the longest item l and the room r = capacity - l:
    no item fits: {l}. An item fills r: it can stand for any other set of items in r. At most one item fits: the longest that does.
    At most two fit: the longest single k, if no pair is longer; else the pair (k, b), if no feasible pair's shorter item exceeds b.
    """
    capacity = plan.capacity
    for l in range(capacity, 0, -1):  # noqa: E741
        while left[l]:
            room = capacity - l
            left[l] -= 1  # one item is taken out while its partners are sought
            few = []  # the three shortest items
            sizes = np.flatnonzero(left[: room + 1])
            for s in sizes[:3].tolist():
                few += [s] * int(min(3 - len(few), left[s]))
                if len(few) == 3:
                    break
            left[l] += 1
            if not len(sizes):
                plan.add((l,), int(left[l]))
                left[l] = 0
                break
            k = int(sizes[-1])
            if k == room or len(few) < 2 or few[0] + few[1] > room:
                n = int(left[l] // 2 if k == l else min(left[l], left[k]))
                plan.add((l, k), n)
                left[l] -= n
                left[k] -= n
                continue
            if len(few) == 3 and sum(few) <= room:
                break  # three may fit: no rule is proven here
            pairs = []
            for a in sizes.tolist():
                b = room - a
                mates = sizes[sizes <= min(a, b)]
                mates = mates[(mates != a) | (left[mates] - (mates == l) > 1)]
                if len(mates):
                    pairs.append((a, int(mates[-1])))
            longest = max((a + b for a, b in pairs), default=0)
            if k >= longest:
                n = int(left[l] // 2 if k == l else min(left[l], left[k]))
                plan.add((l, k), n)
                left[l] -= n
                left[k] -= n
                continue
            b = dict(pairs).get(k)
            if b is None or max(y for _, y in pairs) > b or l in (k, b):
                break
            n = int(min(left[l], left[k] // 2 if k == b else min(left[k], left[b])))
            if not n:
                break
            plan.add((l, k, b), n)
            left[l] -= n
            left[k] -= n
            left[b] -= n


def best_fit(left: np.ndarray, plan: Plan) -> None:
    """Best-fit, longest first: each item goes where it leaves the least room; equal items and equal sequences are taken together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms = np.zeros(plan.capacity + 1, np.int64)

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if count:
            open_[room].append((pattern, count))
            rooms[room] += count

    for l in range(plan.capacity, 0, -1):  # noqa: E741
        todo = int(left[l])
        while todo:
            fits = np.flatnonzero(rooms[l:])
            if len(fits):
                room = l + int(fits[0])
                pattern, count = open_[room].pop()
                rooms[room] -= count
            else:
                room, pattern, count = plan.capacity, (), todo
            each = min(room // l, todo)
            used = min(count, todo // each)
            put(pattern + (l,) * each, room - l * each, used)
            if pattern:
                put(pattern, room, count - used)
            todo -= used * each
        left[l] = 0
    for found in open_.values():
        for pattern, count in found:
            plan.add(pattern, count)


def plan_of(histogram: dict[int, int], capacity: int) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = Plan(capacity)
    reduce_dominated(left, plan)
    best_fit(left, plan)
    return plan


def _assign(places: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(places[:, 0], np.arange(places[:, 0].max() + 2)) if len(places) else np.zeros(1, np.int64)
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edge = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = order[a:b]
                lo, hi = first[length[own[0]]], first[length[own[0]] + 1]
                at[own] = lo + np.searchsorted(places[lo:hi, 1], rank[own], "right") - 1
            sequence = places[at, 2] + rank - places[at, 1]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + [pa.array(sequence), pa.array(places[at, 3])], [*columns, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset.

    A document is its text's ids and one closing id 0; only those over `capacity` are cut, the first piece being the shorter one.
    A null text counts as empty: one piece of one id. Repeated rows and null doc_ids are documents of their own. An empty
    table gives an empty table. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + (", ids array<int>" if keep_ids else "")
    cut = written(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, keep_ids), ddl), "pieces")
    counts = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan_of(histogram, capacity).places()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    # the counts grow with the number of tasks, so they aren't broadcast
    ranked = cut.join(base.hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_assign(places, columns), ddl)
