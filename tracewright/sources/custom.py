"""Data sources of the library: arrays in npz files, state files with a two-phase commit, and debug episodes.

``register(spark)`` makes them known as ``npz``, ``states`` and ``debug_episodes``. Paths are
those of pyarrow.fs; planning reads names and headers only, tasks read ranges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _at(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def _digest(*parts) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


# npz


@dataclass
class _Rows(InputPartition):
    path: str
    member: str
    first: int
    last: int

    def __post_init__(self):
        super().__init__(0)


class _NpzReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.rows = int(options.get("rowsPerPartition", 100_000))
        self.files = int(options["sampleFiles"]) if "sampleFiles" in options else None
        self.sample = int(options["sampleRows"]) if "sampleRows" in options else None
        self.seed = options.get("seed", "0")

    def _files(self) -> list[str]:
        system, path = _at(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [path]
        found = [f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".npz")]
        if self.files is not None and len(found) > self.files:
            found = heapq.nsmallest(self.files, found, key=lambda p: _digest(self.seed, p.rsplit("/", 1)[-1]))
        return sorted(found)

    @staticmethod
    def _header(member) -> tuple[tuple[int, ...], bool, np.dtype]:
        version = np.lib.format.read_magic(member)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)

    def partitions(self) -> list[InputPartition]:
        system, _ = _at(self.path)
        out = []
        for path in self._files():
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as members:
                for name in sorted(members.namelist()):
                    with members.open(name) as member:
                        shape, by_column, dtype = self._header(member)
                    n = shape[0] if shape else 1
                    # an array by columns, or of pickled objects, has no rows that stand together
                    whole = by_column and len(shape) > 1 or dtype.hasobject
                    step = max(n, 1) if whole else self.rows
                    out += [_Rows(path, name, k, min(n, k + step)) for k in range(0, n, step)]
        return out

    def read(self, partition) -> Iterator[tuple]:
        system, _ = _at(self.path)
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as members, members.open(partition.member) as member:
            shape, by_column, dtype = self._header(member)
            name = partition.member.removesuffix(".npy")
            inner = list(shape[1:])
            size = int(np.prod(inner, dtype=np.int64)) * dtype.itemsize
            wanted = range(partition.first, partition.last)
            if self.sample is not None:
                label = partition.path.rsplit("/", 1)[-1]
                wanted = sorted(heapq.nsmallest(self.sample, wanted, key=lambda k: (_digest(self.seed, label, name, k), k)))
            if dtype.hasobject:
                yield from ((partition.path, name, k, inner, None, None) for k in wanted)
                return
            whole = None
            if by_column and len(shape) > 1:
                whole = np.frombuffer(member.read(), dtype).reshape(shape, order="F")
            at = partition.first
            if whole is None:
                member.seek(at * size, 1)
            for k in wanted:
                if whole is None:
                    member.seek((k - at) * size, 1)
                    row, at = np.frombuffer(member.read(size), dtype), k + 1
                else:
                    row = whole[k].ravel()
                if dtype.kind in "US":
                    texts = [v.decode() if isinstance(v, bytes) else str(v) for v in row.tolist()]
                    yield partition.path, name, k, inner, None, texts
                else:
                    yield partition.path, name, k, inner, row.astype(np.float64).tolist(), None


class NpzSource(DataSource):
    """Rows of the arrays in npz files: the path, array, row along the first axis, shape of a row, and its values in order.

    Options: path (a file or a folder, searched deeply), rowsPerPartition, sampleFiles and sampleRows with seed: the
    files, or rows of each range, of least md5(seed:...), chosen before anything is read. Arrays of pickled objects have
    null values.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "path string, array string, row long, shape array<long>, numbers array<double>, texts array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpzReader(self.options)


# state files


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


def _manifest(system: fs.FileSystem, path: str) -> list[str]:
    name = f"{path}/manifest.json"
    if system.get_file_info(name).type != fs.FileType.File:
        return []
    with system.open_input_file(name) as file:
        return json.loads(file.read())["files"]


class _StateWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, path = _at(self.path)
        names, schema = self.schema.names, to_arrow_schema(self.schema)
        name, out, n = f"{self.job}-{uuid.uuid4().hex}.arrow.gz", None, 0
        rows: list[dict] = []

        def flush() -> None:
            sink.write_batch(pa.RecordBatch.from_pylist(rows, schema))
            rows.clear()

        try:
            for row in iterator:
                if out is None:
                    system.create_dir(f"{path}/states", recursive=True)
                    out = system.open_output_stream(f"{path}/states/{name}", compression="gzip")
                    sink = pa.ipc.new_stream(out, schema)
                rows.append({c: _plain(row[k]) for k, c in enumerate(names)})
                n += 1
                if len(rows) == 10_000:
                    flush()
            if out is not None:
                flush()
                sink.close()
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None, n)

    def commit(self, messages) -> None:
        system, path = _at(self.path)
        files = ([] if self.overwrite else _manifest(system, path)) + [m.file for m in messages if m is not None and m.file]
        system.create_dir(path, recursive=True)
        draft = f"{path}/.manifest-{self.job}"
        with system.open_output_stream(draft) as file:
            file.write(json.dumps({"files": files}).encode())
        if system.get_file_info(f"{path}/manifest.json").type == fs.FileType.File and not isinstance(system, fs.LocalFileSystem):
            system.delete_file(f"{path}/manifest.json")
        system.move(draft, f"{path}/manifest.json")

    def abort(self, messages) -> None:
        system, path = _at(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{path}/states/{m.file}")


def _plain(value):
    if hasattr(value, "asDict"):
        return value.asDict(recursive=True)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


class _StateReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, path = _at(self.path)
        return [InputPartition(f) for f in _manifest(system, path)] or [InputPartition(None)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, path = _at(self.path)
        with system.open_input_stream(f"{path}/states/{partition.value}", compression="gzip") as file, pa.ipc.open_stream(file) as batches:
            yield from batches


class StateSource(DataSource):
    """State rows as gzip Arrow files behind a manifest, option path; to be read with the schema they were written with.

    Tasks write files of their own attempt and say so to the driver; only the driver's manifest, moved into place once
    all tasks are done, makes them rows. A failed job, or a second attempt of a task, leaves no rows. One job writes at
    a time.
    """

    @classmethod
    def name(cls) -> str:
        return "states"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _StateReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _StateWriter(self.options["path"], schema, overwrite)


# debug episodes


class _Episodes:
    def __init__(self, options):
        self.seed, self.per_partition = int(options.get("seed", 42)), int(options.get("episodesPerPartition", 16))
        self.n_partitions, self.batches = int(options.get("partitions", 4)), int(options.get("batches", 1))
        self.with_advantages, self.questions = str(options.get("advantages", "false")).lower() == "true", int(options.get("questions", 100))

    def _number(self, *parts) -> int:
        return int(_digest(self.seed, *parts)[:8], 16)

    def rows(self, first: int, n: int, iteration: int) -> Iterator[tuple]:
        for i in range(first, first + n):
            query, response = ([1 + self._number(i, name, k) % 100 for k in range(5 + self._number(i, name) % 11)] for name in ("q", "r"))
            advantages = [1.0] * len(response) if self.with_advantages else None
            yield i, self._number(i, "question") % self.questions, iteration, query, response, self._number(i, "reward") % 10_000 / 1000, advantages


class _EpisodeReader(_Episodes, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.n_partitions)]

    def read(self, partition) -> Iterator[tuple]:
        yield from self.rows(partition.value * self.per_partition, self.per_partition, 0)


@dataclass
class _Slice(InputPartition):
    first: int
    iteration: int

    def __post_init__(self):
        super().__init__(0)


class _EpisodeStream(_Episodes, DataSourceStreamReader):
    """One iteration a micro-batch, each of all partitions, until there are ``batches`` of them."""

    def __init__(self, options):
        super().__init__(options)
        self.now = 0

    def initialOffset(self) -> dict:
        return {"iteration": 0}

    def latestOffset(self) -> dict:
        self.now = min(self.batches, self.now + 1)
        return {"iteration": self.now}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.now = max(self.now, end["iteration"])
        a_round = self.n_partitions * self.per_partition
        return [_Slice(t * a_round + k * self.per_partition, t) for t in range(start["iteration"], end["iteration"]) for k in range(self.n_partitions)]

    def read(self, partition) -> Iterator[tuple]:
        yield from self.rows(partition.first, self.per_partition, partition.iteration)

    def commit(self, end: dict) -> None:
        pass


class EpisodeSource(DataSource):
    """Episodes that depend on a seed and their number alone, as a table or a stream of iterations.

    Options: seed, partitions, episodesPerPartition, questions, advantages, and batches of a stream. Lengths are 5 to 15
    tokens, tokens 1 to 100, rewards 0 to 9.999.
    """

    @classmethod
    def name(cls) -> str:
        return "debug_episodes"

    def schema(self) -> str:
        return "episode_id long, question_id long, iteration long, query array<int>, response array<int>, reward double, advantages array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _EpisodeReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _EpisodeStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    for source in (NpzSource, StateSource, EpisodeSource):
        spark.dataSource.register(source)
    return spark
