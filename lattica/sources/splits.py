"""PLY files of any size as a Spark data source: a file's body is read by many tasks, a byte range each.

Headers are read once, when the query is planned; a task gets the layout of the rows and a range of whole rows, seeks there
and decodes only the properties that the schema asks for. Binary rows have one size, so ranges are cut between rows. Lines of
text are cut as Spark cuts text files: a range has the lines that begin in it.

Paths may be of any store that pyarrow opens by URI (file, s3, gs, abfs, hdfs).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: PLY's names of its number types, and of its forms.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}
#: Rows in a batch; bytes of a range, and of a header's first piece; rows in a file that `write_ply` makes.
BATCH, RANGE, PIECE, ROWS = 65_536, 64 << 20, 65_536, 1_000_000


@dataclass(frozen=True)
class Layout:
    """Where an element's rows lie: order of bytes (none for text), first byte, count, properties and whether rows follow."""

    order: str
    start: int
    count: int
    properties: tuple[tuple[str, str], ...]
    last: bool

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(name, (self.order or "<") + PLY_TYPES[kind]) for name, kind in self.properties])


def layout(head: bytes, element: str) -> Layout | None:
    """The layout of an element from a file's first bytes; None if the header doesn't end there."""
    text, end, rest = head.partition(b"end_header")
    if not end or b"\n" not in rest:
        return None
    order, elements = "", []
    for line in text.decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            order = ORDERS[words[1]]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"] and elements:
            elements[-1][2].append((words[-1], words[1]))
    start = len(text) + len(end) + rest.index(b"\n") + 1
    for i, (name, count, properties) in enumerate(elements):
        lists = any(kind == "list" for _, kind in properties)
        if name == element:
            if lists:
                raise ValueError(f"element {element} has lists")
            return Layout(order, start, count, tuple(properties), not any(n for _, n, _ in elements[i + 1 :]))
        if count and (lists or not order):
            raise ValueError(f"element {element} comes after rows of unknown size")
        start += count * Layout(order, 0, 0, tuple(properties), True).dtype.itemsize
    raise ValueError(f"no element {element}")


def ply_files(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the PLY files under a path, or of the file itself."""
    store, inner = fs.FileSystem.from_uri(path)
    found = store.get_file_info(inner)
    infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    # the URI of a file is that of the path, followed by what is below it
    return sorted((path.rstrip("/") + x.path[len(inner.rstrip("/")) :], x.size) for x in infos if x.type == fs.FileType.File and (x.path.endswith(".ply") or x is found))


def read_layout(uri: str, element: str) -> Layout:
    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(inner) as f:
        head, found = b"", None
        while found is None:
            piece = f.read(PIECE)
            if not piece:
                raise ValueError(f"{uri} isn't a PLY file")
            head += piece
            found = layout(head, element)
        return found


@dataclass
class _Range(InputPartition):
    """Rows first to end of a binary file, or the lines that begin in bytes first to end of a text file."""

    uri: str
    layout: Layout
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], options: dict):
        self.names, self.element, self.paths = names, options.get("element", "vertex"), options["path"].split("\n")
        self.bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def partitions(self) -> list[_Range]:
        files = [x for p in self.paths for x in ply_files(p)]
        with ThreadPoolExecutor(16) as pool:
            layouts = list(pool.map(lambda x: read_layout(x[0], self.element), files))
        out = []
        for (uri, size), at in zip(files, layouts):
            if at.order:
                step, stop, start = max(1, self.bytes // max(1, at.dtype.itemsize)), at.count, 0
            else:
                # where lines of other elements follow, only the count tells where to stop
                start, stop = at.start, size
                step = self.bytes if at.last else max(1, stop - start)
            out += [_Range(uri, at, a, min(a + step, stop)) for a in range(start, stop, step)]
        return out or [_Range("", Layout("<", 0, 0, (), True), 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.first == part.end:
            return
        store, inner = fs.FileSystem.from_uri(part.uri)
        with store.open_input_file(inner) as f:
            for row, rows in _binary(f, part) if part.layout.order else _lines(f, part):
                columns = {"path": pa.array([part.uri] * len(rows)), "row": pa.array(row)}
                for name in self.names:
                    if name not in columns:
                        known = name in (rows.dtype.names or ())
                        columns[name] = pa.array(rows[name].astype(np.float64)) if known else pa.nulls(len(rows), pa.float64())
                yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], self.names)


def _binary(f, part: _Range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    dtype = part.layout.dtype
    f.seek(part.layout.start + part.first * dtype.itemsize)
    for a in range(part.first, part.end, BATCH):
        rows = np.frombuffer(f.read(min(BATCH, part.end - a) * dtype.itemsize), dtype)
        yield np.arange(a, a + len(rows)), rows


def _lines(f, part: _Range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of text; each is known by the byte where its line begins."""
    dtype, width, at = part.layout.dtype, len(part.layout.properties), part.first
    f = io.BufferedReader(f, PIECE)
    if at > part.layout.start:
        f.seek(at - 1)
        at += len(f.readline()) - 1  # the line that began before belongs to the range before
    else:
        f.seek(at)
    left, places, rows = part.layout.count, [], []
    while at < part.end and left:
        line = f.readline()
        if not line:
            break
        if line.strip():
            places.append(at)
            rows.append(tuple(line.split()[:width]))
            left -= 1
        at += len(line)
        if len(rows) == BATCH:
            yield np.array(places), np.array(rows, dtype)
            places, rows = [], []
    if rows:
        yield np.array(places), np.array(rows, dtype)


class PlySource(DataSource):
    """Format `ply`. Options: path, element (vertex), rangeBytes. The schema may have any of path, row and the properties, which
    are doubles; properties that a file lacks are null. row counts from 0; in a text file it is the place of the row's line."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        files = ply_files(self.options["path"])
        if not files:
            raise ValueError(f"no PLY file under {self.options['path']}")
        known = read_layout(files[0][0], self.options.get("element", "vertex")).properties
        return "path string, row long" + "".join(f", `{name}` double" for name, _ in known)

    def reader(self, schema) -> _Reader:
        return _Reader(schema.fieldNames(), dict(self.options))


def read_ply(spark: SparkSession, path: str, columns: dict[str, str], element: str = "vertex", range_bytes: int = RANGE) -> DataFrame:
    """(path, row, columns): an element's rows in all PLY files under a path. columns: output name -> property; only these are
    decoded, and those that a file lacks are null."""
    spark.dataSource.register(PlySource)
    wanted = list(dict.fromkeys(columns.values()))
    schema = "path string, row long" + "".join(f", `{p}` double" for p in wanted)
    rows = spark.read.format("ply").schema(schema).option("element", element).option("rangeBytes", range_bytes).load(path)
    return rows.select("path", "row", *[rows[f"`{p}`"].alias(c) for c, p in columns.items()])


def write_ply(df: DataFrame, path: str, kinds: dict[str, str], element: str = "vertex", text: bool = False) -> DataFrame:
    """Writes columns (name -> PLY type) as PLY files under a path, one or more for each partition; gives (path, n) of each file.

    A file has ROWS rows at most, so that a task holds no more. A task that runs again writes the same files.
    """
    dtype = Layout("<", 0, 0, tuple((c, k) for c, k in kinds.items()), True).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner, recursive=True)
        held, k = [], 0

        def put(rows: np.ndarray) -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():05}-{k:05}.ply"
            head = ["ply", f"format {'ascii' if text else 'binary_little_endian'} 1.0", f"element {element} {len(rows)}"]
            head += [f"property {kind} {c}" for c, kind in kinds.items()] + ["end_header", ""]
            body = "".join(" ".join(map(str, r)) + "\n" for r in rows.tolist()).encode() if text else rows.tobytes()
            with store.open_output_stream(f"{inner.rstrip('/')}/{name}") as f:
                f.write("\n".join(head).encode() + body)
            return pa.RecordBatch.from_arrays([pa.array([f"{path.rstrip('/')}/{name}"]), pa.array([len(rows)], pa.int64())], ["path", "n"])

        for batch in batches:
            rows = np.empty(batch.num_rows, dtype)
            for c in kinds:
                rows[c] = batch.column(c).to_numpy(zero_copy_only=False)
            held.append(rows)
            if sum(map(len, held)) >= ROWS:
                joined, held = np.concatenate(held), []
                for a in range(0, len(joined), ROWS):
                    yield put(joined[a : a + ROWS])
                    k += 1
        if held:
            yield put(np.concatenate(held))

    return df.select(*kinds).mapInArrow(run, "path string, n long")
