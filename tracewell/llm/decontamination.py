"""Benchmark decontamination by winnowing.

A window is `WINDOW` consecutive words of a benchmark item (all words of a shorter item that has any). The least hash among the k-grams of
a window is its fingerprint, k being half the window: consecutive windows share fingerprints, and a window that occurs in a document has the same
fingerprint there, so every shared span of a window's length is found.

1. Items and documents are winnowed. A task keeps those fingerprints of its documents that may be among the items' (a bit filter of bounded size
   says so), each with the run of windows it stands for. Equal runs are one from here on, so copies cost nothing more.
2. The fingerprints of runs and items are joined.
3. Hits are extended to the windows of their runs, and those compared with the items' windows word for word.
4. What a run holds returns to all its places: hit words are the union of its windows.
5. Documents that hold the same set of windows have the same items, which are gathered once a set.

Hot fingerprints, windows, runs and sets are dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.filters import bit_filter, may_hold
from tracewell.llm.store import hot_values, spread_join, written
from tracewell.llm.text import NO_TERM, Words, mixed, pieces, plain, run_hash, window_least

WINDOW = 10
_RUN = pa.struct([("length", pa.int32()), ("fp", pa.int64()), ("start", pa.int64()), ("run", pa.string())])
_RUN_DDL = "struct<length: int, fp: long, start: long, run: string>"
MADE = ["n_words", "n_hit", "spans", "items", "contaminated"]


def winnowed(h: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each window of `length` words, by its first word; the last length - 1 values have no meaning."""
    gram = (length + 1) // 2
    return window_least(mixed(run_hash(h, gram), length), length - gram + 1)


def _runs(words: Words, h: np.ndarray, length: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, first window, fingerprint, run) of the runs among wanted windows: next to each other, of one fingerprint, `length` of them at most."""
    doc = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
    at = np.flatnonzero(wanted)
    fp = winnowed(h, length)[at] if len(at) else np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (fp[1:] != fp[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    within = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else at
    new |= within % length == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return doc[at[first]], at[first], fp[first].view(np.int64), words.runs(at[first], count + length - 1)


def _whole(words: Words, length: int) -> np.ndarray:
    """Whether a window of `length` words that begins at each word ends in the same text."""
    return np.arange(len(words)) + length <= np.repeat(words.of[1:], np.diff(words.of))


def _windows_of_items(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            words = Words(plain(piece, "text"), lower=True, separators=NO_TERM)
            h, ids = words.hashes(), piece.column(0)
            of_item = np.minimum(np.diff(words.of), window)
            for length in np.unique(of_item[of_item > 0]).tolist():
                wanted = np.repeat(of_item == length, np.diff(words.of)) & _whole(words, length)
                at = np.flatnonzero(wanted)
                item = ids.take(pa.array(np.searchsorted(words.of, at, "right") - 1))
                yield pa.RecordBatch.from_arrays(
                    [item, pa.array(np.full(len(at), length, np.int32)), pa.array(winnowed(h, length)[at].view(np.int64)), words.runs(at, length)], ["item", "length", "fp", "window"]
                )

    return run


def _runs_of_documents(lengths: list[int], kept: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            words = Words(plain(piece, "text"), lower=True, separators=NO_TERM)
            h = words.hashes()
            found = []
            for length in lengths:
                wanted = _whole(words, length) & may_hold(kept, winnowed(h, length)) if len(h) else np.zeros(0, bool)
                doc, at, fp, runs = _runs(words, h, length, wanted)
                found.append((doc, pa.StructArray.from_arrays([pa.array(np.full(len(doc), length, np.int32)), pa.array(fp), pa.array(at - words.of[doc]), runs], fields=list(_RUN))))
            doc = np.concatenate([d for d, _ in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(doc, kind="stable")
            rows = pa.concat_arrays([r for _, r in found]).take(pa.array(order)) if found else pa.array([], _RUN)
            offsets = np.searchsorted(doc[order], np.arange(piece.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), rows)
            own = [piece.column(piece.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(words.of)), lists], [*columns, "n_words", "runs"])

    return run


def _spread(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    return spread_join(many, few, key, hot_values(many.groupBy(key).agg(F.count("*").alias("n")), key, "n"), by)


def _spans(places: DataFrame) -> DataFrame:
    """One row a document: its (start, end) places as disjoint spans."""
    by_start = Window.partitionBy("row").orderBy("start", "end")
    new = F.coalesce(F.col("start") > F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = places.distinct().withColumn("new", new).withColumn("span", F.sum(F.col("new").cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit (words within a benchmark window), spans (start and end of the hit words, by word from 0), items (ids of the items whose
    windows occur, distinct, unordered) and contaminated (n_hit > 0). Words are the maximal matches of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are
    lower-cased.

    docs has text, items has item_id and text; other columns of docs stay, whatever their names, but for those named as the results, which are replaced
    (text goes if not keep_text). A null or empty text has no words and no hit. Repeated rows and rows of one id or of none are each a document of their own.
    Items without words have no windows; items of one id count once; what only items of null id hold is hit, but adds to no list. Without documents there
    are no rows; without items nothing is hit.
    """
    own = items.select(F.col("item_id").alias("item"), "text")
    windows = written(own.mapInArrow(_windows_of_items(window), f"item {own.schema['item'].dataType.simpleString()}, length int, fp long, window string"), "item-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # `window` of them at most
    kept = bit_filter(windows, "fp", windows.count())

    docs = docs.drop(*MADE)
    names = [c for c in docs.columns if keep_text or c != "text"]
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "text", F.monotonically_increasing_id().alias("row"))
    columns = [*[f"c{i}" for i in range(len(names))], "row"]
    ddl = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in columns) + f", n_words long, runs array<{_RUN_DDL}>"
    table = written(numbered.mapInArrow(_runs_of_documents(lengths, kept, columns), ddl), "winnowed", "zstd")

    places = table.select("row", F.explode("runs").alias("r")).select("row", "r.*").withColumn("key", F.concat_ws(" ", F.col("length").cast("string"), "run"))
    runs = written(places.groupBy("key").agg(F.count("*").alias("n"), F.first("length").alias("length"), F.first("fp").alias("fp"), F.first("run").alias("run")), "runs")
    hits = _spread(runs.select("key", "length", "fp", "run"), windows.select("fp").distinct(), "fp", "key")
    words = F.split("run", " ")
    starts = F.sequence(F.lit(0), F.size("words") - F.col("length"))
    extended = hits.select("key", "length", words.alias("words")).select("key", "length", "words", F.explode(starts).alias("at"))
    extended = extended.select("key", "length", "at", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window"))
    id_ = F.md5(F.encode("window", "UTF-8"))  # 128 bits
    equal = _spread(extended, windows.select("window").distinct(), "window", "key").withColumn("id", id_)
    held = written(equal.groupBy("key").agg(F.collect_list(F.struct("at", "length", "id")).alias("held")), "held")  # `length` windows a run at most

    hot = hot_values(runs, "key", "n")
    returned = spread_join(places.select("row", "key", "start"), held, "key", hot, "row").select("row", "start", F.explode("held").alias("h"))
    begin = F.col("start") + F.col("h.at")
    returned = written(returned.select("row", begin.alias("start"), (begin + F.col("h.length")).alias("end"), "h.id"), "hit-windows")
    # a document's lists are no longer than its words
    ids = returned.groupBy("row").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    by_row = _spans(returned.select("row", "start", "end")).join(ids.hint("merge"), "row")
    by_row = written(by_row.select("row", "spans", "ids", F.sha2(F.concat_ws(" ", "ids"), 256).alias("set")), "hit-rows")

    sets = by_row.groupBy("set").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    owners = windows.select(id_.alias("id"), "item").groupBy("id").agg(F.collect_set("item").alias("owners"))
    of_sets = _spread(sets.select("set", F.explode("ids").alias("id")), owners, "id", "set").select("set", F.explode_outer("owners").alias("item"))
    of_sets = written(of_sets.groupBy("set").agg(F.collect_set("item").alias("items")), "set-items")
    found = spread_join(by_row.select("row", "spans", "set"), of_sets, "set", hot_values(sets, "set", "n"), "row").drop("set")

    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = table.drop("runs").join(found.hint("merge"), "row", "left")
    none = [F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items")]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), *none, F.col("spans").isNotNull().alias("contaminated"))
