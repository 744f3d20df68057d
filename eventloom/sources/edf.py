"""A data source for recording files: a header of 256 * (1 + n) bytes, then records of 16-bit samples by channel."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of one read, and so about half the samples of one batch.
READ_BYTES = 8 << 20
#: Bytes of files that one partition puts together, where a file counts as OPEN_BYTES at least. A file up to PART_BYTES is read whole in one partition.
PART_BYTES, OPEN_BYTES = 4 << 20, 64 << 10
SCHEMA = "rec_id string, chan int, name string, block long, t0_us long, fs double, samples array<float>"


def header_of(data: bytes) -> dict:
    """The fields of a header: records, seconds a record, names, samples a record and the maps from digital to physical values."""
    n = int(data[252:256])
    field = lambda at, width: [data[256 + at * n + k * width : 256 + at * n + (k + 1) * width].decode("latin-1").strip() for k in range(n)]
    low, high, dlow, dhigh = ([float(x) for x in field(a, 8)] for a in (104, 112, 120, 128))
    return {
        "records": int(data[236:244]), "seconds": float(data[244:252]), "names": field(0, 16), "samples": [int(x) for x in field(216, 8)],
        "maps": [((b - a) / (d - c), a - c * (b - a) / (d - c)) for a, b, c, d in zip(low, high, dlow, dhigh)],
    }


def read_header(f) -> dict:
    """The header of an open file."""
    start = f.read(256)
    return header_of(start + f.read(256 * int(start[252:256])))


def store_of(path: str) -> tuple:
    """(file system, path in it) of a path or address, for whatever store the address names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files_of(pattern: str) -> list[tuple[str, int]]:
    """(path in its store, bytes) of the files that a pattern in the last part of a path names, or of one file, or of all files of a folder."""
    from pyarrow import fs

    store, path = store_of(pattern)
    if not any(c in path for c in "*?["):
        found = store.get_file_info(path)
        if found.type == fs.FileType.File:
            return [(path, found.size)]
        path = path.rstrip("/") + "/*"
    folder, _, names = path.rpartition("/")
    every = store.get_file_info(fs.FileSelector(folder or "/"))
    return sorted((f.path, f.size) for f in every if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, names))


class Records(InputPartition):
    """Records of some files: (path, first, stop) each; a stop of None is the file's end."""

    def __init__(self, pieces: list[tuple[str, int, int | None]]):
        self.pieces = pieces


def recording_of(path: str) -> str:
    """A file's rec_id."""
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def fetched(f, at: int, size: int) -> bytes:
    """Bytes of an open file from a place on."""
    f.seek(at)
    return f.read(size)


class EdfReader(DataSourceReader):
    """Partitions of many small files, or of `records` records of a large one; each seeks to its own bytes, and pieces no more than `gap` bytes apart come in one read.

    Only large files are opened to plan. Tasks are as many as the bytes ask for, not as the files: what Spark keeps of
    each task on the driver would else grow with the number of files.
    """

    def __init__(self, options: dict):
        self.pattern, self.step, self.gap = options["path"], int(options.get("records", "300")), int(options.get("gap", "4096"))
        self.sets, self.low, self.high = {}, 0, None

    def _wanted(self, column: str, value) -> bool:
        return column not in self.sets or value in self.sets[column]

    def partitions(self):
        out, small, held = [], [], 0
        store = store_of(self.pattern)[0]
        for path, size in files_of(self.pattern):
            if not self._wanted("rec_id", recording_of(path)):
                continue
            if size <= PART_BYTES:
                cost = max(size, OPEN_BYTES)
                if small and held + cost > PART_BYTES:
                    out.append(Records(small))
                    small, held = [], 0
                small.append((path, 0, None))
                held += cost
                continue
            with store.open_input_file(path) as f:
                low, high = self._range(read_header(f)["records"])
            out += [Records([(path, k, min(k + self.step, high))]) for k in range(low, high, self.step)]
        if small:
            out.append(Records(small))
        return out or [Records([])]

    def _range(self, n: int) -> tuple[int, int]:
        """The first of a file's n records that is wanted, and the one after the last."""
        low, high = self.low, n if self.high is None else min(n, self.high)
        if "block" in self.sets:
            inside = [k for k in self.sets["block"] if low <= k < high]
            low, high = min(inside, default=0), max(inside, default=-1) + 1
        return low, high

    def read(self, partition):
        for path, first, stop in partition.pieces:
            yield from self._read(path, first, stop)

    def _read(self, path: str, first: int, stop: int | None):
        import numpy as np
        import pyarrow as pa

        name = recording_of(path)
        with store_of(self.pattern)[0].open_input_file(path) as f:
            head = read_header(f)
            sizes = head["samples"]
            width, start = 2 * sum(sizes), 256 * (1 + len(sizes))
            at = [2 * sum(sizes[:c]) for c in range(len(sizes))]
            chans = [c for c, label in enumerate(head["names"]) if self._wanted("chan", c) and self._wanted("name", label)]
            low, high = self._range(head["records"])
            blocks = [k for k in range(max(low, first), high if stop is None else min(high, stop)) if self._wanted("block", k)]
            pieces = [(start + k * width + at[c], 2 * sizes[c], k, c) for k in blocks for c in chans]
            for run in together(pieces, self.gap):
                base = run[0][0]
                data = fetched(f, base, run[-1][0] + run[-1][1] - base)
                gain = [head["maps"][c] for _, _, _, c in run]
                values = [np.frombuffer(data, "<i2", size // 2, place - base) * a + b for (place, size, _, _), (a, b) in zip(run, gain)]
                ends = np.cumsum([0, *(len(v) for v in values)], dtype=np.int32)
                samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.float32)))
                k, c = [x[2] for x in run], [x[3] for x in run]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(run)), pa.array(c, pa.int32()), pa.array([head["names"][x] for x in c]), pa.array(k, pa.int64()),
                        pa.array([int(x * head["seconds"] * 1_000_000) for x in k], pa.int64()), pa.array([sizes[x] / head["seconds"] for x in c], pa.float64()), samples,
                    ],
                    ["rec_id", "chan", "name", "block", "t0_us", "fs", "samples"],
                )


class FilteringReader(EdfReader):
    """The same with filters on rec_id, chan, name and block answered here: files that they leave out are not opened, records and channels not read."""

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("rec_id", "chan", "name", "block") and isinstance(f, (EqualTo, In)):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.sets[column] = self.sets.get(column, wanted) & wanted
            elif column == "block" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == "block" and isinstance(f, (LessThan, LessThanOrEqual)):
                stop = f.value + isinstance(f, LessThanOrEqual)
                self.high = stop if self.high is None else min(self.high, stop)
            else:
                yield f


def together(pieces: list[tuple], gap: int, most: int = READ_BYTES):
    """Runs of (place, size, ...) pieces, which are in order: pieces no more than a gap apart are one run, of `most` bytes unless a piece is larger."""
    run: list[tuple] = []
    for piece in pieces:
        if run and (piece[0] - (run[-1][0] + run[-1][1]) > gap or piece[0] + piece[1] - run[0][0] > most):
            yield run
            run = []
        run.append(piece)
    if run:
        yield run


class Edf(DataSource):
    """spark.read.format("edf").option("records", 300).load(pattern): one row a channel and record; large files are parted by so many records.

    With the option pushdown, which needs spark.sql.python.filterPushdown.enabled, filters on rec_id, chan, name and block
    reach the files; read() sets both. Files lie in any store that pyarrow reaches from all executors.
    """

    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (FilteringReader if str(self.options.get("pushdown", "false")).lower() == "true" else EdfReader)(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The recordings that a path or pattern names, as rows of SCHEMA; filters reach the files. Registers the source in the session and turns its filters on."""
    spark.dataSource.register(Edf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("edf").options(pushdown="true", **options).load(path)
