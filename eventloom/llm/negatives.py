"""Hard negatives by rotated one-bit codes: intervals of the inner product choose what is scored by whole numbers.

A row's vector, less the centre of its cell, is turned by a fixed random rotation; its code is the signs, stored with
the length of the rest and its alignment, the cosine between it and the code's vector. For a query, popcounts of the
code with the bit planes of the query estimate the product with the code's vector, and Cauchy and Schwarz bound what
the part of the row beside that vector can add. So every product has a sure interval, and only rows whose intervals
can matter are scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import rows_as, written

SCALE, EVERY, FLIP_EVERY, CLASSES = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these shares of the positive's, in hundredths.
LOW, HIGH = 30, 90
#: Rows of one part of a cell, anchors of one block, and anchors looked at at once: what a task holds.
CELL_ROWS, BLOCK_ROWS, AT_ONCE = 4096, 2048, 256
#: Cells, and rows of a sample by hash, about, from which their centres are found. They only place rows; all rows are coded and searched.
CELLS, SAMPLE, ROUNDS = 32, 2048, 5
#: Bits of a query's components in its planes.
PLANES = 6
SEED = 12
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation of dim dimensions."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), whole numbers in doubles; a multiple beyond a double is the greatest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(x.astype(np.float64) * scale))


def as_bytes(v: np.ndarray) -> list[bytes]:
    """Each row of whole numbers as four bytes a component, or eight where one does not fit."""
    small = np.abs(v).max(axis=1, initial=0) < 2**31
    short = v.astype(np.int32, copy=False) if small.all() else np.where(small[:, None], v, 0).astype(np.int32)
    return [short[i].tobytes() if s else v[i].tobytes() for i, s in enumerate(small)]


def from_bytes(rows, dim: int) -> np.ndarray:
    """The rows of as_bytes() in doubles."""
    out = np.empty((len(rows), dim))
    short = np.array([len(r) == 4 * dim for r in rows], bool)
    for kind, at in ((np.int32, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(-1, dim)
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


class Codes:
    """The codes of rows against one centre: signs, length of the rest and alignment."""

    def __init__(self, x: np.ndarray, centre: np.ndarray):
        turned = (x - centre) @ rotation(x.shape[1]).T
        self.centre, self.dim = centre, x.shape[1]
        self.length = np.linalg.norm(turned, axis=1)
        self.signs = words(turned >= 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.aligned = np.nan_to_num(np.clip(np.abs(turned).sum(1) / (np.sqrt(self.dim) * self.length), 0, 1))
        #: How far rounding may have moved a product, for each unit of a query's length.
        self.slack = 1e-9 * (self.length + np.linalg.norm(centre)) + 1e-300

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) inner product of each query with each row, for certain."""
        turned = q @ rotation(self.dim).T
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.clip(np.rint((turned - low) / step), 0, (1 << PLANES) - 1).astype(np.uint8)
        off = np.linalg.norm(turned - (low + step * level), axis=1)[:, None]
        ones = np.bitwise_count(self.signs).sum(axis=1, dtype=np.int64)
        hits = np.zeros((len(q), len(self.signs)))
        for p in range(PLANES):
            plane = words(level >> p & 1)
            hits += sum(np.bitwise_count(plane[:, None, w] & self.signs[None, :, w]) for w in range(plane.shape[1])).astype(np.float64) * (1 << p)
        sums = (low + step * level).sum(axis=1)[:, None]
        along = (2 * (low * ones[None] + step * hits) - sums) / np.sqrt(self.dim)
        length = np.linalg.norm(q, axis=1)[:, None]
        beside = np.sqrt(np.maximum(length**2 - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        middle = (q @ self.centre)[:, None] + self.length * self.aligned * along
        wide = self.length * (np.sqrt(1 - self.aligned**2) * beside + self.aligned * off) + self.slack * length
        # what is no number (products beyond a double) bounds nothing
        return np.nan_to_num(middle - wide, nan=-np.inf), np.nan_to_num(middle + wide, nan=np.inf)


def exactly(q: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs that `at` marks, by whole numbers; a score beyond a long is the nearest long."""
    i, j = np.nonzero(at)
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2**53:
        a, b = ([[int(v) for v in row] for row in m] for m in (q, x))
        score = [min(max(sum(map(int.__mul__, a[m], b[n])), LEAST), MOST) for m, n in zip(i.tolist(), j.tolist())]
        return i, j, np.array(score, np.int64)
    if len(i) * 10 > at.size:
        return i, j, (q @ x.T)[i, j].astype(np.int64)
    score = [np.einsum("ij,ij->i", q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]
    return i, j, np.concatenate(score).astype(np.int64)


def largest(values: np.ndarray, k: int) -> np.ndarray:
    """The kth largest of each row, as a column; -inf where there are fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k, None] if values.shape[1] >= k else np.full((len(values), 1), -np.inf)


def first(owner: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each owner stand: higher scores first, ties by smaller name."""
    order = np.lexsort((name, -score.astype(object) if len(score) and score.min() == LEAST else -score, owner))
    start = np.searchsorted(owner[order], owner[order])
    return order[np.arange(len(order)) - start < k]


def best_same(q, q_id, q_label, x, ids, labels, codes: Codes, k: int):
    """(query, row, score): for each query the k best rows of its label with another id."""
    at = (q_label[:, None] == labels[None]) & (q_id[:, None] != ids[None])
    least, most = codes.intervals(q)
    at &= most >= largest(np.where(at, least, -np.inf), k)
    i, j, score = exactly(q, x, at)
    keep = first(i, score, ids[j], k)
    return i[keep], j[keep], score[keep]


def bounds(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the largest whole score n with low * score <= 100 * n <= high * score, within a long."""
    return max(-(-low * score // 100), LEAST), min(high * score // 100, MOST)


def best_within(q, q_label, x, ids, labels, codes: Codes, ranges: list[list[tuple[int, int]]], k: int):
    """(query, range, row, score): for each query and each of its score ranges the k best rows of other labels within it."""
    other = q_label[:, None] != labels[None]
    least, most = codes.intervals(q)
    width = max(map(len, ranges))
    lows, highs = (np.array([[r[i][side] if i < len(r) else empty for i in range(width)] for r in ranges], np.int64) for side, empty in ((0, MOST), (1, LEAST)))
    may = np.zeros(other.shape, bool)
    for p in range(width):
        lo, hi = lows[:, p, None], highs[:, p, None]
        # longs near 2**63 round upwards as doubles: let their neighbours in
        lo_f, hi_f = lo.astype(np.float64) * (1 - np.sign(lo) * 1e-12), hi.astype(np.float64) * (1 + np.sign(hi) * 1e-12)
        within = other & (most >= lo_f) & (least <= hi_f) & (lo <= hi)
        sure = np.where(within & (least >= lo) & (most <= hi), least, -np.inf)
        may |= within & (most >= largest(sure, k))
    i, j, score = exactly(q, x, may)
    found = []
    for p in range(width):
        at = np.flatnonzero((score >= lows[i, p]) & (score <= highs[i, p]))
        at = at[first(i[at], score[at], ids[j[at]], k)]
        found.append((i[at], np.full(len(at), p), j[at], score[at]))
    return tuple(map(np.concatenate, zip(*found)))


def centres_of(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Centres of cells by a few rounds of Lloyd's method on a sample."""
    centres = sample[np.random.default_rng(SEED).permutation(len(sample))[:cells]].astype(float)
    for _ in range(ROUNDS):
        near = ((centres**2).sum(1)[None] - 2 * sample @ centres.T).argmin(1)
        centres = np.array([sample[near == c].mean(0) if (near == c).any() else old for c, old in enumerate(centres)])
    return centres


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector, dim) of the rows that take part, labels changed where FLIP_EVERY divides the id."""
    kept = rows_as(vectors, vec_id=id_col, vector=vector_col, label=label_col).where("vec_id is not null and vector is not null and label is not null and size(vector) > 0")
    kept = kept.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.col("label").cast("long")
    flipped = F.when(F.col("vec_id") % FLIP_EVERY == 0, (label + 1) % CLASSES).otherwise(label)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), flipped.alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))


def placed(rows: DataFrame, centres: dict[int, np.ndarray], scale: int) -> DataFrame:
    """(vec_id, label, dim, cell, v): whole-number vectors as bytes, with the cell of the nearest centre; -1 where the sample has no vector of that length."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def batches(parts):
        for b in parts:
            dims, cell, v = b["dim"].to_numpy(), np.full(len(b), -1), np.empty(len(b), object)
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                x = whole(np.stack(b["vector"].to_numpy()[at]), scale)
                if dim in shared.value:
                    c = shared.value[dim]
                    with np.errstate(over="ignore", invalid="ignore"):
                        cell[at] = ((c * c).sum(1)[None] - 2 * (x @ c.T)).argmin(1)
                v[at] = as_bytes(x)
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "dim": dims, "cell": cell, "v": v})

    return rows.mapInPandas(batches, "vec_id long, label long, dim int, cell int, v binary")


def mine(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of each anchor and positive.

    Anchors are the rows whose id `every` divides. Positives are an anchor's best rows of the same label, negatives the
    best of other labels whose score lies between low and high hundredths of the positive's; higher scores come first,
    ties by smaller id. Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no
    part; rows of other lengths are no candidates; an anchor's own id is never its positive. Equal rows (id, label and vector)
    count once; different rows of one id count each, and anchors of one id each have their own positives. Scores beyond
    a long are the nearest long, in comparisons too. Extra columns are ignored; an empty table gives no rows.

    Rows lie in cells, large cells in parts by a hash; blocks of anchors meet every part of their length once for the
    positives and once for the negatives. In a task the codes' intervals leave out rows that cannot be among the best,
    the others are scored. Only the best rows of each anchor and part are shuffled.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col)
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    sample: dict = {}
    for r in chosen.select("dim", "vector").orderBy(F.xxhash64("vector")).limit(4 * SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["vector"])
    centres = {dim: centres_of(x) for dim, found in sample.items() if np.abs(x := whole(np.array(found), scale)).max() < 1e100}
    data = written(placed(rows, centres, scale), "negatives-rows")
    asked = F.col("vec_id") % every == 0
    sizes = data.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    blocks = max(1, -(-data.where(asked).count() // block_rows))
    sizes = spark.createDataFrame(sizes.collect(), "dim int, cell int, parts int")  # a row for each centre and length

    own = F.xxhash64("vec_id", "label", "v")
    parted = data.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(own, F.col("parts")).cast("int")).drop("parts")
    parted = parted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    anchors = written(data.where(asked).select("vec_id", "label", "dim", "v").dropDuplicates().withColumn("anchor", F.unhex(F.md5(F.concat(F.concat_ws("/", F.col("vec_id"), F.col("label"), F.lit("")).cast("binary"), F.col("v"))))), "negatives-anchors")
    keys = ["block", "dim", "cell", "part"]

    def meet(asking: DataFrame, pair, schema: str) -> DataFrame:
        """What pair(asking, codes and rows of one part) gives for all blocks of anchors and parts of their length."""
        spread = asking.withColumn("block", F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(blocks)).cast("int")).join(F.broadcast(sizes), "dim")
        spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(left) and len(right):
                right = right.drop_duplicates(["vec_id", "label", "v"])
                dim, cell = int(right["dim"].iloc[0]), int(right["cell"].iloc[0])
                x, ids, labels = from_bytes(right["v"].tolist(), dim), right["vec_id"].to_numpy(), right["label"].to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    codes = Codes(x, centres[dim][cell] if cell >= 0 else np.zeros(dim))
                    for s in range(0, len(left), AT_ONCE):
                        some = left.iloc[s : s + AT_ONCE]
                        found.append(pair(some, from_bytes(some["v"].tolist(), dim), x, ids, labels, codes))
            names = [f.split()[0] for f in schema.split(", ")]
            return pd.DataFrame({f: np.concatenate([x[f] for x in found]) if found else [] for f in names})

        return spread.groupBy(*keys).cogroup(parted.groupBy(*keys)).applyInPandas(task, schema)

    def same(some, q, x, ids, labels, codes):
        i, j, score = best_same(q, some["vec_id"].to_numpy(), some["label"].to_numpy(), x, ids, labels, codes, positives)
        return {"anchor": some["anchor"].to_numpy(object)[i], "positive_id": ids[j], "positive_score": score}

    def within(some, q, x, ids, labels, codes):
        known = [[tuple(map(int, (p["positive_id"], p["positive_score"]))) for p in r] for r in some["positives"]]
        i, p, j, score = best_within(q, some["label"].to_numpy(), x, ids, labels, codes, [[bounds(s, low, high) for _, s in r] for r in known], negatives)
        chosen = [known[a][b] for a, b in zip(i.tolist(), p.tolist())]
        return {
            "anchor": some["anchor"].to_numpy(object)[i], "place": p, "anchor_id": some["vec_id"].to_numpy()[i], "positive_id": np.array([c[0] for c in chosen], np.int64),
            "positive_score": np.array([c[1] for c in chosen], np.int64), "negative_id": ids[j], "negative_score": score,
        }

    near = meet(anchors, same, "anchor binary, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    kept = near.withColumn("place", place).where(F.col("place") <= positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asking = written(anchors.join(kept, "anchor"), "negatives-asking")
    hard = meet(asking, within, "anchor binary, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
with v as (select distinct vec_id, case when vec_id % {FLIP_EVERY} = 0 then (label::bigint + 1) % {CLASSES} else label::bigint end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as w
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as anchor_label, a.w as anchor_w, b.vec_id, a.label = b.label as same, list_inner_product(a.w, b.w)::bigint as score
    from v a join v b on a.vec_id <> b.vec_id or a.label <> b.label where a.vec_id % {EVERY} = 0 and len(a.w) = len(b.w)),
p as (select *, row_number() over (partition by anchor_id, anchor_label, anchor_w order by score desc, vec_id) as place from s where same qualify place <= {POSITIVES}),
r as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.anchor_label, p.anchor_w, p.place order by s.score desc, s.vec_id)::int as rank
    from p join s on p.anchor_id = s.anchor_id and p.anchor_label = s.anchor_label and p.anchor_w = s.anchor_w and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= {NEGATIVES}
"""
