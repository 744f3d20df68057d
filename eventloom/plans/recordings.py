"""Recording files made from tables, for the query that reads them back."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.sources.edf import store_of


def sample_file(names: list[str], records: list[list[list[int]]], fs: int, low: float = -3276.8, high: float = 3276.7) -> bytes:
    """The bytes of a file with one-second records: records[r][chan] are digital samples."""
    return header(names, len(records), fs, low, high) + b"".join(struct.pack(f"<{len(c)}h", *c) for r in records for c in r)


def header(names: list[str], records: int, fs: int, low: float = -3276.8, high: float = 3276.7) -> bytes:
    """The header of a file with so many one-second records."""
    pad = lambda x, n: str(x).ljust(n).encode("latin-1")
    n = len(names)
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (1 + n), 8) + pad("", 44) + pad(records, 8) + pad(1, 8) + pad(n, 4)
    for values, width in ((names, 16), ([""] * n, 80), (["uV"] * n, 8), ([low] * n, 8), ([high] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([fs] * n, 8), ([""] * n, 32)):
        head += b"".join(pad(v, width) for v in values)
    return head


def write_files(recordings, path: str, fs: int):
    """Write recordings (rec_id, names, records) as files <rec_id>.edf under a path, each in the task that holds its row; (rec_id, bytes) comes back."""

    def batches(rows):
        store, base = store_of(path)
        store.create_dir(base)
        for b in rows:
            out, ends = [], b.column(3).offsets.to_numpy()
            samples = b.column(3).values.to_numpy(zero_copy_only=False)
            for k, (rec, names, n) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                own = samples[ends[k] : ends[k + 1]]
                if len(own) and (own.min() < -32768 or own.max() > 32767):
                    raise ValueError(f"{rec} has samples beyond 16 bits")
                data = header(names, n, fs) + own.astype("<i2").tobytes()
                with store.open_output_stream(f"{base}/{rec}.edf") as f:
                    f.write(data)
                out.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["rec_id", "bytes"])

    flat = F.flatten(F.flatten("records")).cast("array<int>")
    return recordings.select("rec_id", "names", F.size("records"), flat).mapInArrow(batches, f"rec_id {dict(recordings.dtypes)['rec_id']}, bytes long")
