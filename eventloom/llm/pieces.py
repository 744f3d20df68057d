"""SentencePiece encoding and decoding over a piece table: a relational lattice and a fold over each word's edges.

Words are exploded into bounded-length substrings, joined to the piece table, and their edges grouped by word; a
higher-order aggregate folds the edges to ids. For a unigram model that fold is Viterbi's. A BPE model's ids are not
the best path of its scores (they are merge ranks), so there the fold applies merges among the edges, best first,
which gives the model's own ids. Every distinct word of a corpus is folded once; ids come back to the texts by a
broadcast for the frequent words and by a join on the word for all others.
"""

from __future__ import annotations

import heapq
import os
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import rows_as, settle, written

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Words whose ids are broadcast: the most frequent ones of the corpus, this many at most; all others are joined. The most
#: frequent of them are looked up by name, the others by a 128-bit digest, which takes a fraction of the memory.
DICTIONARY, BY_NAME = 1 << 21, 1 << 17
#: Characters of the longest word that goes through the folds, whose places are the bits of a long.
WORD_CHARS = 60
#: Distinct words that a Python worker counts before it passes them on, and rows whose ids it turns to text at once.
HELD_WORDS, HELD_TEXTS = 200_000, 64
#: Bytes of the texts (of their packets, a quarter) that a Python worker looks up, or puts ids together for, at once.
HELD_BYTES = 1 << 19
#: Words in one task that groups edges, about: each has some thirty.
LATTICE_WORDS = 8192
#: Scores under this mark pieces that are never to be chosen; a character in no piece costs this much more than the worst other.
UNUSED, UNKNOWN = -1e8, 10.0


def kind_of(model: sentencepiece.SentencePieceProcessor) -> str:
    """unigram or bpe, as the model's own description says."""
    from sentencepiece import sentencepiece_model_pb2

    described = sentencepiece_model_pb2.ModelProto()
    described.ParseFromString(model.serialized_model_proto())
    kinds = {1: "unigram", 2: "bpe"}
    if described.trainer_spec.model_type not in kinds:
        raise ValueError("only unigram and BPE models")
    return kinds[described.trainer_spec.model_type]


class Pieces:
    """The piece table of a model file, read on the driver: text (with plain spaces), id and score of each normal piece, and the ids of the 256 bytes.

    The table has as many rows as the vocabulary, a few tens of thousands, whatever the data; it may be broadcast.
    """

    def __init__(self, path: str = MODEL, kind: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind or kind_of(model)
        every = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in every]
        odd = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in every]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.table = [(names[i].replace("▁", " "), i, float(model.get_score(i))) for i in every if not odd[i]]
        self.raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if odd[i] else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        if any(re.search(r"(?s)[^ ] |.\n|\n.", p) for p, _, _ in self.table):
            raise ValueError("a piece crosses the end of a word: words can't be encoded one by one")
        better: dict = {}
        for p, _, score in self.table:
            for part in {x for n in range(2, len(p)) for x in (p[:n], p[-n:])}:
                better[part] = max(score, better.get(part, -float("inf")))
        self.risky = {p for p, _, score in self.table if better.get(p, -float("inf")) > score}
        self.splitter = Splitter("".join(sorted({c for p, _, _ in self.table for c in p})), frozenset(x + y for p, _, _ in self.table for x, y in zip(p, p[1:])))
        self.longest = max(len(p) for p, _, _ in self.table)
        self.floor = min(s for _, _, s in self.table if s > UNUSED) - UNKNOWN

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, code): code is what an edge of the piece says, as CODE, less its start."""
        place = {x: i for i, x in enumerate(sorted({x for _, _, x in self.table}, reverse=True))}
        codes = [place[x] << RANK | len(p) << LEN | (p in self.risky) << RISKY | i + 1 for p, i, x in self.table]
        return spark.createDataFrame([(*row, c) for row, c in zip(self.table, codes)], "piece string, id int, score double, code long")


class Splitter:
    """Cuts texts into words, from the characters of a piece table and the pairs that stand side by side in a piece. Its tables are made where it is first used."""

    def __init__(self, letters: str, pairs: frozenset[str]):
        self.letters, self.pairs, self.tables = letters, pairs, None

    def __getstate__(self):
        return {"letters": self.letters, "pairs": self.pairs, "tables": None}

    def words_of(self, text: str | None) -> list[str]:
        """The words of a text, with the space that the model puts before it: cut wherever no piece has the two neighbouring
        characters side by side, which no edge and so no merge or path can cross. An empty text has none.
        """
        if not text:
            return []
        if not self.tables:
            self.tables = self._made()
        text = " " + text
        try:
            code, raw = "latin-1", np.frombuffer(text.encode("latin-1"), np.uint8)
            apart = self.tables[2][raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        except UnicodeEncodeError:
            code, raw = "utf-32-le", np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = self.tables[0][raw]
            apart = self.tables[1][kinds[:-1], kinds[1:]]
        ends = np.flatnonzero(apart) + 1
        if "\0" in text:
            ends = [*ends.tolist(), len(text)]
            return [text[a:b] for a, b in zip([0, *ends], ends)]
        # a mark in each cut, so that one split() makes all words
        marked, kept = np.zeros(len(raw) + len(ends), raw.dtype), np.ones(len(raw) + len(ends), bool)
        kept[ends + np.arange(len(ends))] = False
        marked[kept] = raw
        return marked.tobytes().decode(code, "surrogatepass").split("\0")

    def _made(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each character, whether two numbers stand apart, and the same for two of the first 256 characters."""
        number = {c: i + 1 for i, c in enumerate(self.letters)}
        kinds = np.zeros(0x110000, np.uint32)
        kinds[[ord(c) for c in number]] = list(number.values())
        apart = np.ones((len(number) + 1, len(number) + 1), bool)
        for a, b in self.pairs:
            apart[number[a], number[b]] = False
        return kinds, apart, np.ascontiguousarray(apart[kinds[:256][:, None], kinds[:256][None]]).ravel()


#: What an edge says in a long, as the lowest bit of each part: the rank of its piece's score, its start (from 1), its length,
#: whether its piece is risky, and its piece's id plus one (0: in no piece). The best edge, ties to the leftmost, is the least.
RANK, START, LEN, RISKY, ID = 33, 27, 21, 20, 0
_SIX, _TWENTY = 63, (1 << 20) - 1


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n, edges): for each word (with any number n) an array of its edges: for BPE longs as above, for unigrams (score, start, len, id), id -1 for no piece.

    All substrings up to the longest piece are exploded and joined to the broadcast piece table; single characters
    in no piece have an edge of their own. Words stand once, so their edges are grouped where the words lie.
    """
    table = F.broadcast(pieces.frame(words.sparkSession))
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("word"))))
    parts = starts.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("word") - F.col("start") + 1))))
    edges = parts.withColumn("piece", F.substring("word", F.col("start"), F.col("len"))).join(table, "piece", "left").where("id is not null or len = 1")
    if pieces.kind == "bpe":
        edge = F.coalesce("code", F.lit(_TWENTY << RANK | 1 << LEN)).bitwiseOR(F.shiftleft(F.col("start").cast("long"), START))
    else:
        edge = F.struct(F.coalesce("score", F.lit(pieces.floor)).alias("score"), "start", "len", F.coalesce("id", F.lit(-1)).alias("id"))
    return edges.groupBy("word", "n").agg(F.collect_list(edge).alias("edges"))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def viterbi(word: Column, edges: Column) -> Column:
    """The best path of a word as an array of its edges: a fold over its positions that keeps the best edge into each, then a fold back.

    The best path has the highest sum of scores; ties go to the longer last edge.
    """
    sort = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.filter(edges, lambda e: e["start"] + e["len"] - 1 == i))
    first = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("len"), F.lit(0).alias("start"), F.lit(0).alias("id")))

    def forth(done, into):
        reached = F.transform(into, lambda e: F.struct((F.element_at(done, -e["len"])["sum"] + e["score"]).alias("sum"), e["len"].alias("len"), e["start"].alias("start"), e["id"].alias("id")))
        return F.concat(done, F.array(F.array_max(reached)))

    def back(path, at):
        step = lambda e: F.struct(e["start"].alias("start"), e["len"].alias("len"), e["id"].alias("id"))
        here = F.when(F.size(path) == 0, F.length(word)).otherwise(F.element_at(path, 1)["start"] - 1)
        return F.when(here == at["at"], F.concat(F.array(step(at["edge"])), path)).otherwise(path)

    def line(best):
        every = F.transform(best, lambda e, i: F.struct(i.alias("at"), e.alias("edge")))
        return F.aggregate(F.reverse(F.slice(every, F.lit(2), F.length(word))), F.array().cast("array<struct<start:int,len:int,id:int>>"), back)

    return _bound(F.aggregate(sort, first, forth), line)


def _part(e: Column, bit: int, mask: int = _SIX) -> Column:
    return (F.shiftright(e, bit) if bit else e).bitwiseAND(F.lit(mask).cast("long"))


def _left(x, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(x).cast("long") if isinstance(x, int) else x, by.cast("int"))


def _inside(e: Column, cuts: Column) -> Column:
    """The cuts from an edge's start to its end, as bits from 0."""
    return F.call_function("shiftright", cuts, _part(e, START).cast("int")).bitwiseAND(_left(2, _part(e, LEN)) - 1)


def _can_merge(e: Column, cuts: Column) -> Column:
    """Whether an edge's two ends are cuts with just one cut between them."""
    x = _inside(e, cuts)
    return (F.bit_count(x) == 3) & (x.bitwiseAND(F.lit(1).cast("long")) == 1) & (x >= _left(1, _part(e, LEN)))


def _merged(e: Column, cuts: Column) -> Column:
    """The cuts without those inside an edge."""
    return cuts.bitwiseAND(F.bitwise_not(_left(_left(1, _part(e, LEN)) - 2, _part(e, START))))


def _path(edges: Column, cuts: Column) -> Column:
    """The edges between neighbouring cuts, in order: start, length and id plus one, from the 26th, 20th and 0th bit."""
    kept = F.filter(edges, lambda e: _inside(e, cuts) == _left(1, _part(e, LEN)) + 1)
    return F.sort_array(F.transform(kept, lambda e: F.shiftleft(_part(e, START), 26).bitwiseOR(F.shiftleft(_part(e, LEN), 20)).bitwiseOR(_part(e, ID, _TWENTY))))


def _whole(word: Column) -> Column:
    """The cuts before any merge: all places of a word, as bits from 1."""
    return _left(1, F.length(word) + 2) - 2


def merges(word: Column, edges: Column) -> Column:
    """A word's path, as _path says, after merging: a fold over its edges, best first, ties to the leftmost, that merges each that can be.

    The state is the cuts between symbols, as bits of a long. Going through the edges once gives what merging the best
    one each time gives, unless a merge makes an earlier, better edge possible. Only the merge of a risky edge, one
    whose piece starts or ends a better piece, can do so; where it does, the state becomes 0, and merges_again() decides.
    """
    pairs = F.sort_array(F.filter(edges, lambda e: _part(e, LEN) > 1))

    def step(cuts, e, line):
        late = lambda now: F.exists(line, lambda g: (F.shiftright(g, RANK) < F.shiftright(e, RANK)) & _can_merge(g, now))
        after = F.when(_part(e, RISKY, 1) == 1, _bound(_merged(e, cuts), lambda now: F.when(late(now), F.lit(0).cast("long")).otherwise(now))).otherwise(_merged(e, cuts))
        return F.when(_can_merge(e, cuts), after).otherwise(cuts)

    done = _bound(pairs, lambda line: F.aggregate(line, _whole(word), lambda cuts, e: step(cuts, e, line)))
    return _bound(done, lambda cuts: F.when(cuts == 0, merges_again(word, edges)).otherwise(_path(edges, cuts)))


def merges_again(word: Column, edges: Column) -> Column:
    """The same for any word, slower: a fold that, once a character at most, looks for the best edge that can be merged."""
    pairs = F.filter(edges, lambda e: _part(e, LEN) > 1)
    steps = F.slice(F.sequence(F.lit(1), F.length(word)), F.lit(2), F.length(word))

    def step(cuts, _):
        best = F.array_min(F.filter(pairs, lambda e: _can_merge(e, cuts)))
        return _bound(best, lambda e: F.when(e.isNull(), cuts).otherwise(_merged(e, cuts)))

    return _bound(F.aggregate(steps, _whole(word), step), lambda cuts: _path(edges, cuts))


def ids_of(word: Column, edges: Column, pieces: Pieces) -> Column:
    """The ids of a word by the fold of the model's kind; edges in no piece become the ids of their UTF-8 bytes."""
    ids = F.array(*map(F.lit, pieces.bytes))

    def spelled(start, size):
        digits = F.hex(F.encode(F.substring(word, start, size), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda k: F.element_at(ids, F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int") + 1))

    if pieces.kind == "unigram":
        return F.flatten(F.transform(viterbi(word, edges), lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(spelled(e["start"], e["len"]))))
    own = lambda k: _part(k, ID, _TWENTY)
    plain = lambda k: (own(k) - 1).cast("int")
    long = lambda path: F.flatten(F.transform(path, lambda k: F.when(own(k) > 0, F.array(plain(k))).otherwise(spelled(_part(k, 26).cast("int"), _part(k, 20).cast("int")))))
    return _bound(merges(word, edges), lambda path: F.when(F.exists(path, lambda k: own(k) == 0), long(path)).otherwise(F.transform(path, plain)))


def spell_long(word: str, table: dict, byte_ids: list[int], longest: int, kind: str, floor: float) -> list[int]:
    """The ids of one word too long for the arrays of the folds, by the same rules, in time that grows almost with its length."""
    n, path = len(word), []
    if kind == "unigram":
        best: list = [(0.0, 0)] + [None] * n
        for end in range(1, n + 1):
            for size in range(1, min(longest, end) + 1):
                hit = table.get(word[end - size : end]) or ((-1, floor) if size == 1 else None)
                if hit:
                    best[end] = max(best[end] or (-float("inf"), 0), (best[end - size][0] + hit[1], size))
        while n:
            path.append(word[n - best[n][1] : n])
            n -= best[n][1]
        path.reverse()
    else:
        size, left, right, heap = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1)), []

        def offer(a: int) -> None:
            b = right[a] if a >= 0 else n
            if b < n and (hit := table.get(word[a : b + size[b]])):
                heapq.heappush(heap, (-hit[1], a, size[a], size[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = right[a]
            if size[a] != x or b >= n or size[b] != y:
                continue
            size[a], size[b], right[a] = x + y, 0, right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(a)
            offer(left[a])
        path = [word[a : a + size[a]] for a in range(n) if size[a]]
    return [i for p in path for i in ([table[p][0]] if p in table else [byte_ids[c] for c in p.encode()])]


def word_counts(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """(word, n) of all words of all texts that are no longer than WORD_CHARS."""
    splitter = pieces.splitter

    def packed_counts(held):
        kept = {w: n for w, n in held.items() if len(w) <= WORD_CHARS}
        return pa.RecordBatch.from_pydict({"word": list(kept), "n": list(kept.values())})

    def batches(rows):
        held: Counter = Counter()
        for b in rows:
            for t in b.column(0):
                held.update(splitter.words_of(t.as_py()))
                if len(held) > HELD_WORDS:
                    yield packed_counts(held)
                    held.clear()
        if held:
            yield packed_counts(held)

    parts = rows_as(docs, text=text_col).selectExpr("cast(text as string) text").mapInArrow(batches, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def word_ids(docs: DataFrame, pieces: Pieces, text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """(word, ids, n, kind) of every distinct word, each encoded once by lattice and fold, written to the shared folder.

    kind is 2 for the BY_NAME most frequent words, 1 for the rest of the `most` most frequent, 0 for all others; both
    bounds are counts of words, moved down so that none of the words of one count level is split off.
    """
    counts = written(word_counts(docs, pieces, text_col), "piece-words")
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = [(r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()]

    def bound(room: int) -> int:
        for at, n in sizes:
            room -= n
            if room < 0:
                return at
        return -1

    kind = (level > bound(most)).cast("int") + (level > bound(min(most, BY_NAME))).cast("int")
    words = counts.repartition(sum(n for _, n in sizes) // LATTICE_WORDS + 1, "word")
    found = lattice(words, pieces).select("word", ids_of(F.col("word"), F.col("edges"), pieces).alias("ids"), "n")
    known = written(found.withColumn("kind", kind), "piece-ids")
    settle(docs.sparkSession)
    return known


def packed(known: DataFrame) -> tuple:
    """A dictionary (word, often, n, ids) on the driver as ({word: place} of those looked up by name, both halves of all digests in order, their places, lengths, starts, ids): some thirty bytes a word.

    Places go by frequency, the most frequent word first. Digests are made in Spark, and fetched in order and in parts,
    so that the driver holds little more than the result.
    """

    def digested(rows):
        for b in rows:
            words, ids = b.column(0).to_pylist(), b.column(3)
            raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
            packed_ids = pa.array([flat[4 * x : 4 * y] for x, y in zip(ends, ends[1:])], pa.binary())
            names = pa.array([w if o else None for w, o in zip(words, b.column(1).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(raw[:, 0]), pa.array(raw[:, 1]), names, b.column(2), packed_ids], ["high", "low", "name", "n", "ids"])

    halves = known.select("word", "often", "n", "ids").mapInArrow(digested, "high long, low long, name string, n long, ids binary")
    table = written(halves.withColumn("part", F.shiftright("high", 60)).repartition(16, "part"), "piece-dictionary")
    names: dict = {}
    parts: list = []
    count = 0
    for top in range(-8, 8):
        part = table.where(F.col("part") == top).select("high", "low", "name", "n", "ids").toArrow().sort_by([("high", "ascending"), ("low", "ascending")]).combine_chunks()
        if part.num_rows:
            ids = pa.concat_arrays(part.column("ids").chunks)
            flat = np.frombuffer(b"".join(ids.to_pylist()), np.int32)
            parts.append((part.column("high").to_numpy(), part.column("low").to_numpy(), part.column("n").to_numpy(), pc.binary_length(ids).to_numpy(zero_copy_only=False) // 4, flat.astype(np.uint16 if not len(flat) or flat.max() < 1 << 16 else np.int32)))
            names.update((w, count + i) for i, w in enumerate(part.column("name").to_pylist()) if w is not None)
            count += part.num_rows
    columns = [list(c) for c in zip(*parts)] or [[np.zeros(0, np.int64)] for _ in range(5)]
    del parts
    joined = []
    while columns:  # one column at a time, so that little stands twice
        joined.append(np.concatenate(columns.pop(0)))
    first, second, n, lengths, flat = joined
    order = np.argsort(-n, kind="stable").astype(np.int32)
    del joined, n
    places = np.empty(len(order), np.int32)
    places[order] = np.arange(len(order), dtype=np.int32)
    starts = (np.cumsum(lengths, dtype=np.int32) - lengths)[order].astype(np.int32)
    pa.default_memory_pool().release_unused()
    return {w: int(places[i]) for w, i in names.items()}, first, second, places, lengths[order].astype(np.int32), starts, flat


def by_digest(words: list[str], first: np.ndarray, second: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places of words by their digests; -1 for words not among them."""
    if not words or not len(first):
        return np.full(len(words), -1, np.int64)
    own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)
    at = np.minimum(np.searchsorted(first, own[:, 0]), len(first) - 1)
    return np.where((first[at] == own[:, 0]) & (second[at] == own[:, 1]), places[at], -1)


def digits_of(places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers from 0 on, seven bits a byte, and where each ends."""
    sizes = np.ones(len(places), np.int64)
    for k in range(1, 5):
        sizes += places >> 7 * k > 0
    ends = np.cumsum(sizes)
    digits = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    left, at, sizes = places, ends - sizes, sizes - 1
    while len(left):
        digits[at] = left & 127 | (sizes > 0) << 7
        more = np.flatnonzero(sizes)
        left, at, sizes = left[more] >> 7, at[more] + 1, sizes[more] - 1
    return digits.tobytes(), ends


def to_packet(digits: bytes, words: list[str], compress=zstandard.compress) -> bytes:
    """A split text in few bytes: the places of its broadcast words plus one, as digits_of() writes them (0: another word stands here), and those other words."""
    raw = [w.encode() for w in words]
    return compress(np.array([len(raw), *map(len, raw)], np.uint32).tobytes() + b"".join(raw) + digits)


def words_in(packet: bytes, decompress=zstandard.decompress) -> tuple[list[str], bytes]:
    """The other words of a packet, and what follows them."""
    data = decompress(packet)
    n = int.from_bytes(data[:4], "little")
    if not n:
        return [], data[4:]
    ends = 4 * n + 4 + np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)))
    return [data[a:b].decode() for a, b in zip(ends.tolist(), ends[1:].tolist())], data[ends[-1] :]


def places_in(digits: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers written seven bits a byte, and where each ends."""
    raw = np.frombuffer(digits, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    at = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    found, sizes, k = np.zeros(len(ends), np.int64), ends - at, 0
    rows = np.arange(len(ends))
    while len(rows):
        found[rows] |= (raw[at[rows] + k].astype(np.int64) & 127) << 7 * k
        k += 1
        rows = rows[sizes[rows] > k]
    return found, ends


def _held(sizes, most: int = HELD_BYTES):
    """(first, end) of runs of neighbours whose sizes add up to `most` or little more: what is worked on at once."""
    first = total = 0
    for i, x in enumerate(sizes):
        total += x
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """(doc_id, ids, text_key): the ids of every whole text, and the text's 64-bit key.

    Every distinct word of the corpus is encoded once, by lattice and fold. A table of bounded size, the most frequent
    words, is broadcast; a text becomes the places of its words in it, in few bytes, with all other words beside them.
    These are joined to their ids by the word and come back to their row, where places and ids are put together. Texts
    are read and never shuffled. Words of over WORD_CHARS characters are spelled by a helper in the task.

    Characters in no piece become the ids of their UTF-8 bytes, U+2581 among them, so decoding gives the text back
    exactly. A null text counts as empty: no ids. Repeated rows stay; extra columns are ignored; an empty table
    gives an empty result.
    """
    known = word_ids(docs, pieces, text_col, most)
    shared = docs.sparkSession.sparkContext.broadcast(packed(known.where("kind > 0").select("word", (F.col("kind") == 2).alias("often"), "n", "ids")))
    splitter, table, floor, model_kind, byte_ids, longest = pieces.splitter, {p: (i, s) for p, i, s in pieces.table}, pieces.floor, pieces.kind, pieces.bytes, pieces.longest
    looked_up: dict = {}

    def packets(rows):
        names, first, second, places = shared.value[:4]
        if not looked_up:
            looked_up.update(names)
        compress = zstandard.ZstdCompressor().compress
        for b in rows:
            keys, out = [], []
            for x, y in _held(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                texts = [t or "" for t in b.column(1).slice(x, y - x).to_pylist()]
                keys += [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]
                found = [splitter.words_of(t) for t in texts]
                words = list(chain.from_iterable(found))
                where = np.fromiter(map(looked_up.get, words, repeat(-1)), np.int64, len(words))
                new = np.flatnonzero(where < 0)
                where[new] = by_digest([words[k] for k in new.tolist()], first, second, places)
                digits, ends = digits_of(where + 1)
                ends, upto = np.concatenate(([0], ends)), np.cumsum([0, *map(len, found)])
                others = new[where[new] < 0]
                cuts, others = np.searchsorted(others, upto).tolist(), others.tolist()
                for p, q, i, j in zip(ends[upto[:-1]].tolist(), ends[upto[1:]].tolist(), cuts, cuts[1:]):
                    out.append(to_packet(digits[p:q], [words[k] for k in others[i:j]], compress))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(out, pa.binary())], ["doc_id", "text_key", "packet"])

    def others(rows):
        decompress = zstandard.ZstdDecompressor().decompress
        for b in rows:
            at, place, words = [], [], []
            for row, packet in zip(b.column(0).to_pylist(), b.column(1).field("packet")):
                for k, w in enumerate(words_in(packet.as_py(), decompress)[0]):
                    if len(w) <= WORD_CHARS:
                        at.append(row)
                        place.append(k)
                        words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(place, pa.int32()), pa.array(words, pa.string())], ["row", "place", "word"])

    def whole(rows):
        lengths, starts, flat = shared.value[4:]
        decompress = zstandard.ZstdDecompressor().decompress
        for b in rows:
            for x, y in _held(pc.binary_length(b.column(2)).to_pylist(), HELD_BYTES // 4):
                read = [words_in(p.as_py(), decompress) for p in b.column(2).slice(x, y - x)]
                where, ends = places_in(b"".join(rest for _, rest in read))
                where -= 1
                n = np.where(where < 0, 0, lengths[where]) if len(lengths) else np.zeros(len(where), np.int64)
                upto = np.cumsum(n, dtype=np.int64)
                ids = flat[np.repeat((starts[where] if len(lengths) else n) - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)].astype(np.int32)
                if any(words for words, _ in read):
                    more = []
                    for (words, _), rare in zip(read, b.column(3).slice(x, y - x)):
                        short = iter(rare.as_py() or ()) if words else ()
                        more += [spell_long(w, table, byte_ids, longest, model_kind, floor) if len(w) > WORD_CHARS else next(short) for w in words]
                    ids = np.insert(ids, np.repeat(upto[where < 0], [len(m) for m in more]), [i for m in more for i in m])
                    n[where < 0] = [len(m) for m in more]
                    upto = np.cumsum(n, dtype=np.int64)
                last = np.searchsorted(ends, np.cumsum([len(rest) for _, rest in read]), "right")
                offsets = np.concatenate(([0], upto))[np.concatenate(([0], last))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), b.column(1).slice(x, y - x)], ["doc_id", "ids", "text_key"])

    kept = rows_as(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    texts = kept.mapInArrow(packets, "doc_id long, text_key long, packet binary").withColumn("row", F.monotonically_increasing_id())
    # dealt out by row once, for both uses, which take all of it, so that Spark sees one shuffle
    texts = texts.select("row", F.struct("doc_id", "text_key", "packet").alias("all")).select("row", F.when(F.col("row") >= 0, F.col("all")).alias("all")).repartition("row")
    words = texts.mapInArrow(others, "row long, place int, word string")
    rare = words.join(known.where("kind = 0").select("word", "ids"), "word").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"]).alias("rare"))
    return texts.join(rare, "row", "left").select("all.doc_id", "all.text_key", "all.packet", "rare").mapInArrow(whole, "doc_id long, ids array<int>, text_key long")


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """All columns and `text`: the text that the ids stand for, less the space that encoding put before it.

    Control and unknown ids, ids outside the table and null ids stand for nothing; bytes that are no UTF-8 become
    U+FFFD; null ids give a null text.
    """
    raw = np.frombuffer(b"".join(pieces.raw), np.uint8)
    sizes = np.array([len(r) for r in pieces.raw] + [0], np.int64)
    firsts = np.cumsum(sizes) - sizes

    def batches(rows):
        for b in (b.slice(k, HELD_TEXTS) for b in rows for k in range(0, b.num_rows, HELD_TEXTS)):
            ids = b.column(b.schema.get_field_index(ids_col))
            at = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.where((at >= 0) & (at < len(sizes) - 1), at, len(sizes) - 1)
            n = sizes[at]
            upto = np.cumsum(n)
            joined = raw[np.repeat(firsts[at] - upto + n, n) + np.arange(n.sum())].tobytes()
            ends = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))].tolist()
            out = []
            for a, z, there in zip(ends, ends[1:], ids.is_valid().to_pylist()):
                text = joined[a:z]
                out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace") if there else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "text"])

    kept = encoded.drop("text")
    schema = ", ".join(f"`{n}` {k}" for n, k in kept.dtypes) + ", text string"
    return kept.mapInArrow(batches, schema)
