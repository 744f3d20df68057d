"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, rows_as
from eventloom.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 3
#: Generator polynomial of the perfect binary Golay code (23, 12), whose covering radius is 3.
GOLAY, N, CHECK = 0xC75, 23, 11


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text; 0 if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last, first, h = ends[k - 1 :].tolist(), starts[: len(words) - k + 1].tolist(), xxhash.xxh64_intdigest
    n, ones = len(last), np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        values = np.array([h(joined[a:b], SEED) for a, b in zip(first[at : at + 65536], last[at : at + 65536])], np.uint64)
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of unsigned 64-bit hashes: a bit is 1 if set in over half of them; 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text, as a signed long. Null and empty texts have 0."""

    def batches(rows):
        for b in rows:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kept = rows_as(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(batches, "doc_id long, fp long")


def _remainder(v: np.ndarray) -> np.ndarray:
    for bit in range(N - 1, CHECK - 1, -1):
        v = np.where(v >> bit & 1, v ^ (GOLAY << (bit - CHECK)), v)
    return v


def _leaders() -> np.ndarray:
    """For each of the 2048 remainders the one pattern of at most three bits that has it."""
    patterns = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(N), k)], np.int64)
    out = np.zeros(1 << CHECK, np.int64)
    out[_remainder(patterns)] = patterns
    return out


def anchors(half: np.ndarray, leaders: np.ndarray) -> np.ndarray:
    """Anchors of 32-bit halves: column 0 is the home, the others those of all halves one bit away (-1: repeats).

    An anchor is a Golay code word on the low 23 bits beside the 9 high bits as they are: a covering code of
    radius 3 on 32 bits. A half at distance 1 from x lies within radius 3 + 1 of x's home.
    """
    low, high = half & ((1 << N) - 1), half >> N
    near = np.stack([low] + [low ^ (1 << b) for b in range(N)], axis=1)
    near ^= leaders[_remainder(near)]
    words = near | (high << N)[:, None]
    others = np.stack([words[:, 0] ^ (1 << (N + b)) for b in range(32 - N)], axis=1)
    tail = np.sort(words[:, 1:], axis=1)
    again = np.concatenate((np.zeros((len(half), 1), bool), tail[:, 1:] == tail[:, :-1]), axis=1) | (tail == words[:, :1])
    return np.concatenate((words[:, :1], np.where(again, -1, tail), others), axis=1)


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) with u < v: all pairs of different fingerprints (column fp) at 3 or fewer differing bits.

    Two such fingerprints differ in at most one bit in one of their halves, so one's home anchor for that half
    is among the other's anchors within covering radius plus one. Of the four bytes of the other half, which differs in
    three bits at most, one is equal, so an anchor is parted by each of them. Each fingerprint is sent to about 29
    anchors, four times over, however many rows it stands for, and compared only there. Spark sizes what replicate()
    gives by what goes in, a 230th, and would broadcast it; so the join is a merge by hint.
    """
    if bits > 3:
        raise ValueError("the anchors of two halves cover three bits at most")
    leaders = _leaders()

    def replicate(rows):
        for b in rows:
            fp = b.column(0).to_numpy().view(np.uint64)
            for part in range(2):
                at = anchors((fp >> np.uint64(32 * part) & np.uint64(0xFFFFFFFF)).astype(np.int64), leaders)
                row, col = np.nonzero(at >= 0)
                for byte in range(4):
                    value = (fp >> np.uint64(32 * (1 - part) + 8 * byte) & np.uint64(0xFF)).astype(np.int64)
                    key = at[row, col] | part << 32 | byte << 33 | value[row] << 35
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)[row]), pa.array(col == 0)], ["anchor", "fp", "home"])

    spread = prints.select("fp").where("fp is not null").distinct().mapInArrow(replicate, "anchor long, fp long, home boolean")
    homes = spread.where("home").select("anchor", F.col("fp").alias("u"))
    others = spread.select("anchor", F.col("fp").alias("v"))
    return homes.join(others.hint("merge"), "anchor").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id that links reach.

    Words are runs of other than ASCII white space, A-Z lower-cased; shingles are of three words, repeats
    included; fewer words form one shingle; no words, or a null text, give fingerprint zero, linked like any
    other. Rows whose doc_id is null get a component like others, but are never its smallest, unless there is
    no other (then null). Repeated rows stay. Extra columns are ignored. An empty table gives an empty result.
    Copies share a fingerprint and count once until the end, so groups of copies do not multiply work.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints, bits)).select(F.col("node").alias("fp"), "root")
    classes = cut(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(classes.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies by Jaccard similarity; see copies.one_of_each()."""
    from eventloom.llm import copies

    return copies.one_of_each(docs)
