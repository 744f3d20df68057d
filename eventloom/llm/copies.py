"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import simhash
from eventloom.llm.common import clear, made, packed, row_key, rows_as, unpacked, written
from eventloom.llm.components import components, followed

SEED, SHINGLE, LEAST = 42, 5, 0.8
#: Bands of a min-hash signature and hashes in a band: a pair at 0.8 shares no band in 1 of 40,000 cases.
BANDS, HASHES = 20, 4
_RND = np.random.default_rng(SEED)
_FACTORS = _RND.integers(0, 1 << 63, BANDS * HASHES, np.uint64) << np.uint64(1) | np.uint64(1)
_ADDED = _RND.integers(0, 1 << 63, BANDS * HASHES, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of all shingles, sorted; fewer words form one shingle, no words none."""
    k, h = min(shingle, len(words)), xxhash.xxh64_intdigest
    return np.array(sorted({h(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)}) if words else [], np.uint64)


def bands(values: np.ndarray) -> list[int]:
    """One signed 64-bit number a band; equal sets have equal bands."""
    low = np.full(BANDS * HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(low, (values[at : at + 2048, None] * _FACTORS + _ADDED).min(0), out=low)
    found = [xxhash.xxh64_intdigest(low[i * HASHES : (i + 1) * HASHES].tobytes(), i) for i in range(BANDS)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _key(words: list[bytes]) -> bytes:
    """128 bits of a text's words."""
    return xxhash.xxh3_128_digest(b" ".join(words), SEED)


def signatures(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, n, fp, bands) for every row: key stands for the words of the text, n counts distinct shingles, fp is their SimHash."""

    def batches(rows):
        for b in rows:
            words = [words_of(t.as_py()) for t in b.column(2)]
            sets = [shingles(w) for w in words]
            signed = pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            prints = pa.array(map(simhash.fingerprint_of, sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(_key, words), pa.binary()), pa.array(map(len, sets), pa.int64()), prints, signed], ["row", "doc_id", "key", "n", "fp", "bands"])

    kept = rows_as(docs, doc_id="doc_id", text="text").select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(batches, "row binary, doc_id long, key binary, n long, fp long, bands array<long>")


def sets_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, n, set) of the listed rows' texts."""

    def batches(found):
        for b in found:
            words = [words_of(t.as_py()) for t in b.column(0)]
            sets = [shingles(w).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, words), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "n", "set"])

    kept = rows_as(docs, doc_id="doc_id", text="text").withColumn("row", row_key(F.col("doc_id"), F.col("text"))).join(rows, "row", "left_semi")
    return kept.selectExpr("cast(text as string) text").mapInArrow(batches, "key binary, n long, set array<long>").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (u, v, more) whose exact Jaccard similarity is at least `least`; sizes too far apart are left out first."""
    of = lambda side: sets.select(F.col("key").alias(side), F.col("n").alias(f"_n{side}"), F.col("set").alias(f"_{side}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").where(_like_sizes(F.col("_nu"), F.col("_nv"), least))
    width = len(pairs.columns)

    def batches(rows):
        for b in rows:
            keep = []
            for x, y in zip(b.column(width), b.column(width + 1)):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common))
            yield b.select(list(range(width))).filter(pa.array(keep, pa.bool_()))

    return both.select(*pairs.columns, "_u", "_v").mapInArrow(batches, pairs.schema)


def _like_sizes(n, m, least: float = LEAST):
    return F.least(n, m) >= least * F.greatest(n, m)


def _ordered(u, v):
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _with_roots(u, root_u, v, root_v):
    """(u, v, ru, rv), u < v: two texts and their roots."""
    return [*_ordered(u, v), F.when(u < v, root_u).otherwise(root_v).alias("ru"), F.when(u < v, root_v).otherwise(root_u).alias("rv")]


def _joined(links: DataFrame) -> DataFrame:
    """(node, root) of the roots that links (u, v, ru, rv) join."""
    return components(links.select(F.col("ru").alias("u"), F.col("rv").alias("v")))


def _several(placed: DataFrame) -> DataFrame:
    """(band, key, n, root, a, b) of the members (band, key, n, root) of bands that still have different roots; a and b are two leaders of the band (key, n, root)."""
    placed = written(placed, "copies-placed")
    own = ["key", "n", "root"]
    bands = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(F.struct(*own)).alias("a"), F.min_by(F.struct(*own), F.xxhash64("key")).alias("b"))
    return written(placed.join(bands.where("x <> y").select("band", "a", "b"), "band"), "copies-several")


def rare_pairs(rows: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v, ru, rv), u < v: of texts (key, root) all pairs of different roots that can have a Jaccard similarity of `least` or more.

    Shingles stand in one order, rare ones first. If two sets are that similar, the first shingle that they share is among
    the first n - ceil(least * n) + 1 of the larger and, of the smaller, even among the first
    n - ceil(2 * least / (1 + least) * n) + 1. So only these are joined, and texts that share a frame but differ
    by more than the bound in shingles of their own meet nowhere. Shingles of one text alone take the first places without being joined.
    """
    every = rows.select("key", "root").join(sets, "key").select("key", "root", "n", F.explode("set").alias("token"))
    many = every.groupBy("token").agg(F.count("*").alias("many"), F.min("root").alias("_x"), F.max("root").alias("_y"))
    # in all of one component: such shingles keep their place in the order, but join nothing
    shared = every.join(many.where("many > 1").select("token", "many", (F.col("_x") != F.col("_y")).alias("across")), "token")
    line = W.partitionBy("key")
    at = F.col("n") - F.count("*").over(line) + F.row_number().over(line.orderBy("many", "token"))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    kept = shared.withColumn("at", at).where((F.col("at") <= first(least)) & F.col("across")).withColumn("small", F.col("at") <= first(2 * least / (1 + least)))
    kept = written(kept.select("token", "root", "key", "n", "at", "small"), "copies-rare")
    of_root = kept.groupBy("token", "root").agg(F.max("small").alias("small"))
    x, y = of_root.select("token", F.col("root").alias("a")), of_root.where("small").select("token", F.col("root").alias("b"))
    meets = x.join(y, "token").where("a <> b")
    probe = kept.select("token", F.col("root").alias("a"), F.col("key").alias("p"), F.col("n").alias("np"), F.col("at").alias("at_p"))
    index = kept.where("small").select("token", F.col("root").alias("b"), F.col("key").alias("q"), F.col("n").alias("nq"), F.col("at").alias("at_q"))
    larger = (F.col("nq") < F.col("np")) | ((F.col("nq") == F.col("np")) & (F.col("q") < F.col("p")))
    # from the first shared shingle on, enough of both must be left
    enough = F.least(F.col("np") - F.col("at_p"), F.col("nq") - F.col("at_q")) + 1 >= F.ceil((F.col("np") + F.col("nq")) * (least / (1 + least)) - 1e-9)
    found = meets.join(probe, ["token", "a"]).join(index, ["token", "b"]).where(larger & enough & (F.col("nq") >= least * F.col("np") - 1e-9))
    return found.select(*_with_roots(F.col("p"), F.col("a"), F.col("q"), F.col("b"))).distinct()


def anchored(prints: DataFrame) -> DataFrame:
    """(u, v), u < v: the pairs of texts (key, fp) that meet at an anchor of the SimHash cover within its three bits.

    Each text meets the first of its own fingerprint, and firsts meet across the links of fingerprints, so a
    crowded fingerprint costs one pair a text.
    """
    firsts = prints.groupBy("fp").agg(F.min("key").alias("first"))
    own = prints.join(firsts, "fp").where("key <> first").select(*_ordered(F.col("key"), F.col("first")))
    at = lambda side: firsts.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}"))
    across = simhash.links(firsts).join(at("u"), "u").join(at("v"), "v").select(*_ordered(F.col("first_u"), F.col("first_v")))
    return own.unionByName(across)


def near_copies(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, root) of the texts (by key) that links of near copies join.

    Texts whose SimHash fingerprints meet at an anchor come first, and are checked exactly. Two texts at the bound differ by
    more bits than an anchor reaches, so texts that share a band are candidates as well. In bands whose texts the anchors
    leave apart each is compared with two leaders of the band; then, in those still open, with the one that has most links,
    as an original that copies were made from has; what is then still apart is compared as rare_pairs() says. So all
    candidates end up compared, joined or known to differ too much, and a large group of near copies costs a few comparisons a text.
    Each step joins only the roots that the step before has left, and looks only at bands that it has left open. All is
    written, and removed but for the result.
    """
    spark, before = docs.sparkSession, made()
    texts = prints.where("n > 0").dropDuplicates(["key"])
    met = written(anchored(texts.select("key", "fp")), "copies-anchored")
    spread = texts.select("key", "n", F.explode("bands").alias("band"))
    shared = written(spread.groupBy("band").agg(F.count("*").alias("many")).where("many > 1").select("band"), "copies-bands")
    members = written(spread.join(shared, "band", "left_semi"), "copies-members")
    wanted = members.select("key").unionByName(met.select(F.col("u").alias("key"))).unionByName(met.select(F.col("v").alias("key"))).distinct()
    rows = prints.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row")
    sets = written(sets_of(docs, rows), "copies-sets")
    near = written(verified(met, sets), "copies-near")
    steps = [components(near)]
    open_ = _several(followed(members, steps[-1], "key", to="root"))
    pairs = open_.select("key", "n", "root", F.explode(F.array("a", "b")).alias("to")).where((F.col("root") != F.col("to.root")) & _like_sizes(F.col("n"), F.col("to.n")))
    pairs = written(pairs.select(*_with_roots(F.col("key"), F.col("root"), F.col("to.key"), F.col("to.root"))).distinct(), "copies-pairs")
    first = written(verified(pairs, sets), "copies-first")
    steps.append(_joined(first))
    apart = _several(followed(open_.drop("a", "b"), steps[-1], "root"))
    ends = [t.select(F.col(c).alias("key")) for t in (near, first) for c in ("u", "v")]
    degree = reduce(DataFrame.unionByName, ends).groupBy("key").agg(F.count("*").alias("links"))
    centres = apart.join(degree, "key").groupBy("band").agg(F.max(F.struct("links", "key", "root", "n")).alias("to"))
    spokes = apart.join(centres, "band").where((F.col("root") != F.col("to.root")) & _like_sizes(F.col("n"), F.col("to.n")))
    spokes = spokes.select(*_with_roots(F.col("key"), F.col("root"), F.col("to.key"), F.col("to.root"))).distinct()
    second = written(verified(spokes.join(pairs, ["u", "v"], "left_anti"), sets), "copies-second")
    steps.append(_joined(second))
    rest = rare_pairs(_several(followed(apart.drop("a", "b"), steps[-1], "root")).select("key", "root").distinct(), sets)
    third = written(verified(rest, sets), "copies-third")
    steps.append(_joined(third))
    every = reduce(DataFrame.unionByName, (s.select("node") for s in steps)).distinct().select("node", F.col("node").alias("root"))
    for step in steps:
        every = followed(every, step, "root")
    every = written(every, "copies-roots")
    clear(spark, since=before, keep=1)
    return every


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: the smallest doc_id's (nulls last), then the least row key's.

    Rows are told apart by doc_id and text, so unrelated texts stay when their ids are null or equal. Texts without
    words, and null texts, are copies of each other.
    """
    prints = written(signatures(docs), "copies-prints")
    roots = near_copies(docs, prints).withColumnRenamed("node", "key")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    chosen = prints.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(place).alias("least")).select(F.col("least.row").alias("_row")).distinct()
    held = packed(docs, _row=row_key(docs["doc_id"], docs["text"]))
    return unpacked(held.join(chosen, "_row", "left_semi").dropDuplicates(["_row"]), docs.columns)
