"""The port that features of tracks come in by: extractors, each read as a Spark data source of its own name.

An extractor turns frames of tracks into vectors of one feature space; another one is taken by another name, and nothing downstream changes:

    register(spark, extractor)
    spark.read.format(extractor.name).option("track", "l_suppkey").load(path)

The source reads Parquet files by byte ranges, as many as the data asks for. Planning lists files and reads none of them: a range holds the row groups that
begin in it. Filters on clip, track, role and frame are pushed: they leave out folders (clip_id=...) when planning, row groups by their statistics, then rows.
Paths are those that pyarrow opens (local, hdfs, s3, gs); `extracted` does the same for any DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S

FEATURES = "clip_id string, track_id long, rider_role string, frame_idx long, feature_space string, features array<double>"
_PLACES = {"clip_id": ("clip", pa.string()), "track_id": ("track", pa.int64()), "rider_role": ("role", pa.string()), "frame_idx": ("frame", pa.int64())}
#: Bytes of a range.
RANGE = 128 << 20
#: Rows of a batch.
ROWS = 8192
_TESTS = {S.EqualTo: pc.equal, S.GreaterThan: pc.greater, S.GreaterThanOrEqual: pc.greater_equal, S.LessThan: pc.less, S.LessThanOrEqual: pc.less_equal}


class Extractor(Protocol):
    """name: of the data source; feature_space; dim: the width of its vectors; columns: what it reads besides the places."""

    name: str
    feature_space: str
    dim: int
    columns: Sequence[str]

    def extract(self, frames: pa.Table) -> np.ndarray:
        """(rows, dim) doubles, NaN for a missing signal: rows are never dropped."""
        ...


class Range(S.InputPartition):
    """Of one file the row groups that begin from `start` on and before `end`, with what its folders say."""

    def __init__(self, file: str, start: int, end: int, folders: dict[str, str | None]):
        self.file, self.start, self.end, self.folders = file, start, end, folders


def _vectors(found: np.ndarray, extractor: Extractor, rows: int) -> pa.Array:
    found = np.ascontiguousarray(found, np.float64)
    if found.shape != (rows, extractor.dim):
        raise ValueError(f"{extractor.name} made {found.shape} of {rows} frames; its vectors are {extractor.dim} wide")
    flat = pa.array(found.ravel(), mask=np.isnan(found).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * extractor.dim, pa.int32()), flat)


def _read(frames: pa.Table, extractor: Extractor) -> pa.RecordBatch:
    """The rows of FEATURES; frames holds the places under their own names, and the extractor's columns."""
    n = frames.num_rows
    found = extractor.extract(frames.select(list(extractor.columns)))
    made = [*[frames.column(c).combine_chunks() for c in _PLACES], pa.array([extractor.feature_space] * n, pa.string()), _vectors(found, extractor, n)]
    made = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made]
    return pa.RecordBatch.from_arrays(made, [*_PLACES, "feature_space", "features"])


def _held(test: S.Filter, column: pa.ChunkedArray) -> pa.ChunkedArray:
    if isinstance(test, S.IsNotNull):
        return pc.is_valid(column)
    if isinstance(test, S.In):
        return pc.is_in(column, pa.array([v for v in test.value if v is not None], column.type))
    return _TESTS[type(test)](column, pa.scalar(test.value, column.type))


def _may_hold(test: S.Filter, low: object, high: object) -> bool:
    """Whether a value from low to high may pass."""
    if isinstance(test, S.IsNotNull):
        return True
    if isinstance(test, S.In):
        return any(v is not None and low <= v <= high for v in test.value)
    v = test.value
    return {S.EqualTo: lambda: low <= v <= high, S.GreaterThan: lambda: high > v, S.GreaterThanOrEqual: lambda: high >= v, S.LessThan: lambda: low < v, S.LessThanOrEqual: lambda: low <= v}[type(test)]()


class _Reader(S.DataSourceReader):
    def __init__(self, extractor: Extractor, path: str, names: dict[str, str], size: int):
        self.extractor, self.path, self.names, self.size = extractor, path, names, size
        self.tests: list[S.Filter] = []

    def pushFilters(self, filters: list[S.Filter]) -> Iterator[S.Filter]:
        for test in filters:
            known = isinstance(test, (S.IsNotNull, S.In, *_TESTS)) and len(test.attribute) == 1 and test.attribute[0] in _PLACES
            if known and getattr(test, "value", 0) is not None:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[S.InputPartition]:
        files, top = _opened(self.path)
        info = files.get_file_info(top)
        if info.type == pf.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [info] if info.is_file else files.get_file_info(pf.FileSelector(top, recursive=True))
        out = []
        for one in sorted(listed, key=lambda f: f.path):
            inner = one.path[len(top) :].strip("/").split("/")
            if not one.is_file or any(p.startswith(("_", ".")) for p in inner):
                continue
            folders = {k: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in (p.split("=", 1) for p in inner[:-1] if "=" in p)}
            if all(self._folder_passes(t, folders) for t in self.tests):
                out += [Range(one.path, at, at + self.size, folders) for at in range(0, one.size, self.size)]
        return out or [Range("", 0, 0, {})]

    def _folder_passes(self, test: S.Filter, folders: dict[str, str | None]) -> bool:
        name = self.names[test.attribute[0]]
        if name not in folders:
            return True
        value = pa.chunked_array([pa.array([folders[name]], pa.string()).cast(_PLACES[test.attribute[0]][1])])
        return bool(_held(test, value)[0].as_py())

    def _group_passes(self, group: pq.RowGroupMetaData, at: dict[str, int]) -> bool:
        for test in self.tests:
            place = test.attribute[0]
            column = group.column(at[self.names[place]]) if self.names[place] in at else None
            stats = column.statistics if column is not None and column.is_stats_set else None
            # only where values are stored as the place's own kind do their bounds compare
            kind = {"INT32": int, "INT64": int, "BYTE_ARRAY": str}.get(column.physical_type) if stats is not None and stats.has_min_max else None
            if kind is not None and isinstance(stats.min, kind) and isinstance(stats.max, kind) and (kind is int) == (_PLACES[place][1] == pa.int64()) and not _may_hold(test, stats.min, stats.max):
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, _ = _opened(self.path)
        with files.open_input_file(partition.file) as opened:
            file = pq.ParquetFile(opened)
            meta = file.metadata
            at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            groups = []
            for i in range(meta.num_row_groups):
                first = meta.row_group(i).column(0)
                begin = first.data_page_offset if not first.dictionary_page_offset else min(first.dictionary_page_offset, first.data_page_offset)
                if partition.start <= begin < partition.end and self._group_passes(meta.row_group(i), at):
                    groups.append(i)
            stored = set(file.schema_arrow.names)
            wanted = [c for c in dict.fromkeys([*self.names.values(), *self.extractor.columns]) if c in stored]
            for batch in file.iter_batches(ROWS, row_groups=groups, columns=wanted) if groups else ():
                frames = pa.table({**dict(zip(batch.schema.names, batch.columns)), **{k: pa.array([v] * batch.num_rows, pa.string()) for k, v in partition.folders.items() if k not in stored}})
                rows = placed(frames, self.names, self.extractor.columns)
                for test in self.tests:
                    rows = rows.filter(_held(test, rows.column(test.attribute[0])))
                if rows.num_rows:
                    yield _read(rows, self.extractor)


def placed(frames: pa.Table, names: dict[str, str], columns: Sequence[str]) -> pa.Table:
    """The extractor's columns, and the places under their own names; a role that is not there is NULL, any other place must be."""
    made = {}
    for place, (_, kind) in _PLACES.items():
        if names[place] in frames.column_names:
            made[place] = frames.column(names[place]).cast(kind)
        elif place == "rider_role":
            made[place] = pa.nulls(frames.num_rows, kind)
        else:
            raise ValueError(f"no column {names[place]!r} for {place}")
    lost = [c for c in columns if c not in frames.column_names]
    if lost:
        raise ValueError(f"the extractor reads columns that are not there: {lost}")
    return pa.table({**{c: frames.column(c) for c in columns if c not in made}, **made})


def _opened(path: str) -> tuple[pf.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pf.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return pf.LocalFileSystem(), path.rstrip("/")


def register(spark: SparkSession, extractor: Extractor) -> str:
    """The extractor's name, under which spark.read.format finds it from now on. Options: clip, track, role and frame name the columns of the places; range, the bytes of a range.

    Extractors must not read columns that bear a place's name for something else. Turns the session's filter pushdown for Python data sources on, without which Spark refuses a source that takes filters.
    """
    clash = set(extractor.columns) & set(_PLACES)
    if clash:
        raise ValueError(f"{extractor.name} reads columns named as places: {sorted(clash)}")

    class Source(S.DataSource):
        @classmethod
        def name(cls) -> str:
            return extractor.name

        def schema(self) -> str:
            return FEATURES

        def reader(self, schema: object) -> S.DataSourceReader:
            names = {place: self.options.get(option, place) for place, (option, _) in _PLACES.items()}
            return _Reader(extractor, self.options["path"], names, int(self.options.get("range", RANGE)))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return extractor.name


def extracted(frames: DataFrame, extractor: Extractor, clip: str = "clip_id", track: str = "track_id", frame: str = "frame_idx", role: str = "rider_role") -> DataFrame:
    """The same rows from any DataFrame, in its own partitions and without a shuffle."""
    names = {"clip_id": clip, "track_id": track, "frame_idx": frame, "rider_role": role}
    wanted = [c for c in dict.fromkeys([*names.values(), *extractor.columns]) if c in frames.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _read(placed(pa.Table.from_batches([batch]), names, extractor.columns), extractor)

    return frames.select(*[f"`{c}`" for c in wanted]).mapInArrow(run, FEATURES)


class ColumnExtractor:
    """Numeric columns as they are: the plainest extractor, and the one for signals that are stored already."""

    def __init__(self, name: str, feature_space: str, columns: Sequence[str]):
        self.name, self.feature_space, self.columns, self.dim = name, feature_space, tuple(columns), len(columns)

    def extract(self, frames: pa.Table) -> np.ndarray:
        read = [frames.column(c).cast(pa.float64()).to_numpy().astype(float) for c in self.columns]
        return np.stack(read, 1) if read else np.zeros((frames.num_rows, 0))
