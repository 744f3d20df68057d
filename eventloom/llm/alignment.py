"""Cross-tokenizer alignment: tokens of two tokenizers grouped between their common ends, by pointer jumping.

A text is cut before every space that follows a character other than white space. No token of either tokenizer crosses
such a cut, so each segment is aligned by itself, and a segment that comes again is looked up. How often an id pair is
linked is counted over the whole corpus; the counts come back to the documents by a broadcast of the most frequent
pairs, bounded in number, and by a join for all others.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import rows_as, written

BYTE_LEVEL = os.environ.get("BYTE_LEVEL_BPE", "/opt/tokenizers/byte_bpe_50k.json")
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Fixed value: how byte-level BPE of this kind cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs whose counts are broadcast, the most frequent ones: this many at most; all others are joined.
DICTIONARY = 1 << 20
#: What a Python worker keeps of segments that it has seen, and of pairs that it has counted, before it starts afresh.
HELD_SEGMENTS, HELD_CHARS, HELD_PAIRS = 150_000, 1 << 26, 1 << 21
#: Links of a group from which its pairs are made from its distinct ids.
LARGE_GROUP = 4096
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Two tokenizers, read on the driver and sent to the workers: A is a byte-level BPE (JSON), B a SentencePiece model with byte fallback."""

    def __init__(self, byte_level: str = BYTE_LEVEL, model: str = MODEL):
        with open(byte_level, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["content"] for t in described.get("added_tokens", []) if t.get("special")}
        letter = byte_letters()
        names = {name: bytes(letter[c] for c in name) for name in described["model"]["vocab"] if name not in special}
        self.ranks = {names[name]: i for name, i in described["model"]["vocab"].items() if name not in special}
        merged = [self.ranks[names["".join(m if isinstance(m, list) else m.split(" "))]] for m in described["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of a byte-level BPE have to be in the order of its merges")
        with open(model, "rb") as file:
            self.proto = file.read()
        self._made = None

    def __getstate__(self):
        return {"ranks": self.ranks, "proto": self.proto, "_made": None}

    def made(self) -> Encoders:
        """The encoders, made where they are first used."""
        self._made = self._made or Encoders(self.ranks, self.proto)
        return self._made


class Encoders:
    """Both encoders with the bytes of their tokens, and what is needed to write groups down."""

    def __init__(self, ranks: dict[bytes, int], proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        norm = spec.normalizer_spec
        if not norm.add_dummy_prefix or norm.remove_extra_whitespaces or norm.precompiled_charsmap:
            raise ValueError("only models that add a space and leave texts as they are")
        every = range(self.b.get_piece_size())
        names = [self.b.id_to_piece(i) for i in every]
        self.bytes_a: list = [b""] * (max(ranks.values()) + 1)
        for name, i in ranks.items():
            self.bytes_a[i] = name
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Whether texts may be cut before spaces: no piece of B holds a space after another character.
        self.cuts = not any(re.search(r"[^▁]▁", n) for n in names)
        self.space = self.b.piece_to_id("▁")
        self.width = max(len(self.bytes_a), len(self.bytes_b))
        self.marked = [f"{i}{mark}" for mark in ",|;" for i in range(self.width)]

    def segments(self, text: str) -> list[str]:
        """The segments of a space and a text; each starts with a space."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of A and of B of each segment."""
        b = self.b.encode([s[1:] for s in segments], num_threads=1)
        return [self.a.encode_ordinary(s) for s in segments], [[self.space] if s == " " else x for s, x in zip(segments, b)]


def jumped(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For every token, first A's and then B's, the number of its component's last token, which is one of B's.

    end_a and end_b are the byte ends of two rows of tokens that cover the same bytes. Every token points to the
    overlapping token that reaches farthest right, B's if both reach as far; a token that none exceeds points to
    itself. Pointers are doubled until none changes: each then points to the token where its chain ends.
    """
    n = len(end_a)
    over = np.searchsorted(end_a, end_b)
    own = n + np.arange(len(end_b))
    to = np.concatenate((n + np.searchsorted(end_b, end_a), np.where(end_a[over] > end_b, over, own) if n else own))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


class Aligned:
    """What alignment gives for a row of segments: numbers, the groups in writing, and the distinct pairs with their links."""

    def __init__(self, encoders: Encoders, segments: list[str]):
        ids_a, ids_b = encoders.encode(segments)
        whole = [s.encode() for s in segments]
        joined = lambda ids, table: b"".join(map(table.__getitem__, ids))
        self.good = np.array([joined(x, encoders.bytes_a) == w == joined(y, encoders.bytes_b) for x, y, w in zip(ids_a, ids_b, whole)], bool)
        keep = self.good.tolist()
        ids_a, ids_b = [x if k else [] for x, k in zip(ids_a, keep)], [y if k else [] for y, k in zip(ids_b, keep)]
        self.n_a, self.n_b = (np.array(list(map(len, x)), np.int64) for x in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (ids_a, ids_b))
        last = jumped(np.cumsum(encoders.length_a[a]), np.cumsum(encoders.length_b[b]))
        ends = np.flatnonzero(last[len(a) :] == len(a) + np.arange(len(b))) + len(a)
        group = np.searchsorted(ends, last)
        group_a, group_b = group[: len(a)], group[len(a) :]
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        segment_a = np.repeat(np.arange(len(segments)), self.n_a)
        of_group = segment_a[to_a - 1] if len(ends) else to_a
        self.n_groups = np.bincount(of_group, minlength=len(segments))
        total = np.concatenate(([0], np.cumsum(in_a * in_b)))
        cut = np.concatenate(([0], np.cumsum(self.n_groups)))
        self.n_links = total[cut[1:]] - total[cut[:-1]]
        # a group's tokens of A stand before its tokens of B; a token's mark tells whether it is the last of its kind in the group
        line = np.empty(len(a) + len(b), np.int64)
        final = lambda g: np.concatenate((g[1:] != g[:-1], [True])) if len(g) else g
        line[np.arange(len(a)) + (to_b - in_b)[group_a]] = a + encoders.width * final(group_a)
        line[np.arange(len(b)) + to_a[group_b]] = b + 2 * encoders.width * final(group_b)
        words = list(map(encoders.marked.__getitem__, line.tolist()))
        stop = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        self.texts = ["".join(words[x:y])[:-1] for x, y in zip(stop, stop[1:])]
        self._pairs(a, b, group_a, in_a, in_b, to_a, to_b, of_group, segment_a, len(encoders.bytes_b), len(segments))

    def _pairs(self, a, b, group_a, in_a, in_b, to_a, to_b, of_group, segment_a, size_b, n):
        large = in_a * in_b > LARGE_GROUP
        times = np.where(large, 0, in_b)[group_a]
        row = np.repeat(np.arange(len(a)), times)
        at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + (to_b - in_b)[group_a[row]]
        keys, links, where = [a[row] * size_b + b[at]], [np.ones(len(row), np.int64)], [segment_a[row]]
        for g in np.flatnonzero(large).tolist():
            x, many_x = np.unique(a[to_a[g] - in_a[g] : to_a[g]], return_counts=True)
            y, many_y = np.unique(b[to_b[g] - in_b[g] : to_b[g]], return_counts=True)
            keys.append((x[:, None] * size_b + y).ravel())
            links.append((many_x[:, None] * many_y).ravel())
            where.append(np.full(len(keys[-1]), of_group[g]))
        self.starts, self.pairs, self.links = grouped(np.concatenate(where), np.concatenate(keys), np.concatenate(links), n)


def grouped(place: np.ndarray, key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, keys, values): the distinct keys of each of n places in order, with the sums of their values; place i has starts[i] to starts[i + 1]."""
    order = np.lexsort((key, place))
    place, key, value = place[order], key[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (key[1:] != key[:-1])))) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(value, first) if len(first) else value
    return np.searchsorted(place[first], np.arange(n + 1)), key[first], sums


class Seen:
    """The segments that a worker has aligned, by number."""

    FIELDS = ("good", "n_a", "n_b", "n_groups", "n_links", "pairs", "links")

    def __init__(self):
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.chars = 0
        self.starts = np.zeros(1, np.int64)
        self.kept = {f: np.zeros(0, bool if f == "good" else np.int64) for f in self.FIELDS}

    def learn(self, encoders: Encoders, segments: list[str]) -> None:
        new = [s for s in dict.fromkeys(segments) if s not in self.number]
        if not new:
            return
        found = Aligned(encoders, new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.texts += found.texts
        self.chars += sum(map(len, found.texts)) + sum(map(len, new))
        self.starts = np.concatenate((self.starts, self.starts[-1] + found.starts[1:]))
        self.kept = {f: np.concatenate((self.kept[f], getattr(found, f))) for f in self.FIELDS}

    def full(self) -> bool:
        return len(self.number) > HELD_SEGMENTS or self.chars > HELD_CHARS or len(self.kept["pairs"]) > 4 * HELD_PAIRS


def pack(pairs: np.ndarray, links: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """A document's distinct pairs, sorted, and their links as bytes: steps and links, byte planes apart, compressed."""
    steps = np.diff(pairs, prepend=0)
    wide = len(pairs) and max(int(steps.max()), int(links.max())) >> 32
    kind = np.dtype("<u8" if wide else "<u4")
    planes = np.stack((steps, links)).astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + squeeze.compress(np.ascontiguousarray(planes).tobytes())


def unpack(packed: bytes, spread: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, links) of pack()."""
    size = packed[0]
    planes = np.frombuffer(spread.decompress(packed[1:]), np.uint8).reshape(size, -1)
    steps, links = np.ascontiguousarray(planes.T).view(f"<u{size}").astype(np.int64).reshape(2, -1)
    return np.cumsum(steps), links


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, packed) of every row: row tells rows apart, packed holds its distinct pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def batches(rows):
        encoders, seen, squeeze = shared.value.made(), Seen(), zstandard.ZstdCompressor(3)
        row = TaskContext.get().partitionId() << 33
        for b in rows:
            cut = [encoders.segments(t) if t else [] for t in (x.as_py() for x in b.column(1))]
            line = [s for x in cut for s in x]
            seen.learn(encoders, line)
            ids = np.fromiter(map(seen.number.__getitem__, line), np.int64, len(line))
            ends = np.cumsum(list(map(len, cut)))
            kept, doc = seen.kept, np.repeat(np.arange(len(cut)), list(map(len, cut)))
            bad = np.zeros(len(cut), bool)
            bad[doc[~kept["good"][ids]]] = True
            ids, doc = ids[~bad[doc]], doc[~bad[doc]]
            total = lambda f: np.bincount(doc, minlength=len(cut)) if f is None else np.diff(np.concatenate(([0], np.cumsum(kept[f][ids])))[np.searchsorted(doc, np.arange(len(cut) + 1))])
            numbers = [pa.array(total(f)) for f in _NUMBERS]
            groups = list(map(seen.texts.__getitem__, ids.tolist()))
            stop = np.concatenate(([0], np.cumsum(total(None)))).tolist()
            shas = [hashlib.sha256(";".join(groups[x:y]).encode()).hexdigest() if y > x else "" for x, y in zip(stop, stop[1:])]
            starts, which, times = grouped(doc, ids, np.ones(len(ids), np.int64), len(cut))
            doc = np.repeat(np.arange(len(cut)), np.diff(starts))
            many = seen.starts[which + 1] - seen.starts[which]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen.starts[which], many)
            starts, pairs, links = grouped(np.repeat(doc, many), kept["pairs"][at], kept["links"][at] * np.repeat(times, many), len(cut))
            packed = [pack(pairs[x:y], links[x:y], squeeze) for x, y in zip(starts.tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(cut))), b.column(0), *numbers, pa.array(shas), pa.array(packed, pa.binary())], ["row", "doc_id", *_NUMBERS, "groups_sha256", "packed"])
            row += len(cut)
            if seen.full() or ends[-1:] > HELD_SEGMENTS:
                seen = Seen()

    kept = rows_as(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return kept.mapInArrow(batches, _ALIGNED + ", packed binary")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each pair linked."""

    def batches(rows):
        spread, held, size = zstandard.ZstdDecompressor(), [], 0

        def told():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for b in rows:
            held += [unpack(x.as_py(), spread)[0] for x in b.column(0)]
            size += sum(map(len, held[-len(b) :]))
            if size > 4 * HELD_PAIRS:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    return found.select("packed").mapInArrow(batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def judged(counts: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): best if no pair of the same id of A has a higher count. The broadcast side has a row for each id of A, whatever the data."""
    of_a = F.floor(F.col("pair") / size_b)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", of_a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizers: Tokenizers | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A's and B's tokens are grouped between the byte offsets where tokens of both end; all of a group's A tokens are
    linked with all of its B tokens. A pair of ids counts the rows that hold it linked, copies and rows with null or
    equal ids included, each by itself. n_best counts links whose pair no other pair of its A id exceeds; count_sum
    adds up the counts of all links. Null and empty texts, and texts that the tokens' bytes don't give back (such
    as those with U+2581), have zeros and ''. Extra columns are ignored; an empty table gives no rows. Groups of many
    links are counted by their distinct ids, so a long text of one repeated character makes no pairs of tokens.
    """
    tokenizers = tokenizers or Tokenizers()
    spark, size_b = docs.sparkSession, len(tokenizers.made().bytes_b)
    found = written(aligned(docs, tokenizers, id_col, text_col), "align-rows")
    counts = written(judged(written(pair_counts(found), "align-counts"), size_b), "align-judged")
    level = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["level"]
    known = counts.where(level >= least) if least is not None else counts.limit(0)
    table = known.toArrow()
    whole = held == counts.count()
    order = np.argsort(pair := table["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((pair[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order]))

    def batches(rows):
        pair, n, best = shared.value
        spread = zstandard.ZstdDecompressor()
        for b in rows:
            got = [unpack(x.as_py(), spread) for x in b.column(b.num_columns - 1)]
            doc = np.repeat(np.arange(len(got)), [len(x) for x, _ in got])
            x, links = (np.concatenate([g[i] for g in got]) for i in (0, 1))
            at = np.minimum(np.searchsorted(pair, x), max(len(pair) - 1, 0))
            hit = pair[at] == x if len(pair) else np.zeros(len(x), bool)
            at, many = at[hit], links[hit]
            summed = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[np.searchsorted(doc[hit], np.arange(len(got) + 1))])
            none = pa.nulls(len(got), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(summed(np.where(best[at], many, 0))), pa.array(summed(n[at] * many)), none, none], [*b.schema.names[:-1], "n_best", "count_sum", "pair", "links"])
            if not hit.all():
                row, rare = b.column(0).to_numpy()[doc[~hit]], {"pair": x[~hit], "links": links[~hit]}
                yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.nulls(len(row), t) for t in b.schema.types[1:-1]), *[pa.nulls(len(row), pa.int64())] * 2, *map(pa.array, rare.values())], [*b.schema.names[:-1], "n_best", "count_sum", *rare])

    parts = found.mapInArrow(batches, _ALIGNED + ", n_best long, count_sum long, pair long, links long")
    columns = ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]
    if whole:
        return parts.select(*columns)
    parts = written(parts, "align-parts")
    rare = parts.where("pair is not null").select("row", "pair", "links").join(counts.where(level < least) if least is not None else counts, "pair")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"))
    both = parts.where("pair is null").join(rare, "row", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(*columns)
