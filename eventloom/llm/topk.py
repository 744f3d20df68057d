"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import rows_as, written

K, SCALE, EVERY = 5, 256, 50
#: Rows in a data cell and in a query block, about: what one task holds. A tree is built on each.
CELL_ROWS, QUERY_ROWS = 2048, 2048
#: Rows of a sample by hash, about, on which the driver builds the top of the tree; it only places rows, all rows are searched.
SAMPLE = 2048
BASE, LEAF = 1.3, 32
#: Scores that a comparison of two leaves holds at once: rows without near ones share a leaf, so it may be a whole block or cell.
AT_ONCE = 1 << 18
#: Components from this size on are searched apart, with exact whole numbers of any length.
BIG = float(1 << 22)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class Node:
    """A ball: centre (row), radius that covers all its rows, and either children or, in a leaf, none."""

    __slots__ = ("at", "radius", "rows", "children")

    def __init__(self, at: int, radius: float, rows: np.ndarray, children: list):
        self.at, self.radius, self.rows, self.children = at, radius, rows, children


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree of the rows of x, built from the top: a node of radius r has children of radius r / BASE at most, whose centres lie further apart than that; lone rows share one leaf.

    Nodes wait on a list, not in calls of an inner function of itself: such a function is a cycle, which keeps all products
    of rows until Python happens to look for cycles.
    """
    gram = x @ x.T
    square = gram.diagonal()

    def distance(at: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[at] + square[rows] - 2 * gram[at, rows], 0))

    root = Node(0, 0.0, np.arange(len(x)), [])
    waiting = [root]
    while waiting:
        node = waiting.pop()
        d = distance(node.at, node.rows)
        node.radius = float(d.max())
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        inner = d <= node.radius / BASE
        lone, rest = [], node.rows[~inner]
        node.children.append(Node(node.at, 0.0, node.rows[inner], []))
        while len(rest):
            near = distance(int(rest[0]), rest) <= node.radius / BASE
            near[0] = True
            if near.sum() == 1:
                lone.append(rest[0])
            else:
                node.children.append(Node(int(rest[0]), 0.0, rest[near], []))
            rest = rest[~near]
        waiting += node.children
        if lone:
            lone = np.array(lone)
            node.children.append(Node(node.at, float(distance(node.at, lone).max()), lone, []))
    return root


def leaves(node: Node) -> list[Node]:
    """The leaves below a node, neighbours in the tree side by side."""
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def most(qd, q_length, q_radius, d_length, d_radius):
    """The largest inner product that two balls allow, whose centres have the product qd; a little more, as it is rounded."""
    found = qd + q_length * d_radius + d_length * q_radius + q_radius * d_radius
    return found + 1e-9 * (np.abs(found) + 1)


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = K, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best rows for each query, by score, ties to smaller id; -inf where there are fewer.

    A pair of nodes is skipped if the largest inner product that their balls allow is under the worst kth score of
    the queries in the one; known are kth scores that the queries have elsewhere, under which nothing is looked for.
    Vectors hold whole numbers whose inner products are exact in doubles.
    """
    best = np.full((len(queries), k), -np.inf)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    bound = np.full(len(queries), -np.inf) if known is None else known.astype(float)
    lengths_q, lengths_d = np.linalg.norm(queries, axis=1), np.linalg.norm(data, axis=1)

    def limit(q: Node, d: Node) -> float:
        return float(most(queries[q.at] @ data[d.at], lengths_q[q.at], q.radius, lengths_d[d.at], d.radius))

    def compare(q: np.ndarray, d: np.ndarray) -> None:
        x, names, step = data[d].T, data_ids[d], max(AT_ONCE // len(d), 1)
        for at in range(0, len(q), step):
            better(q[at : at + step], x, names)

    def better(q: np.ndarray, x: np.ndarray, names: np.ndarray) -> None:
        scores = queries[q] @ x
        scores[query_ids[q][:, None] == names[None, :]] = -np.inf
        least = bound[q]
        if len(names) > k:
            # what is under the kth score here is none of the k best; equal ones stay for their ids
            least = np.maximum(least, np.partition(scores, len(names) - k, axis=1)[:, len(names) - k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        score, name = np.concatenate((scores[row, col], best[q].ravel())), np.concatenate((names[col], ids[q].ravel()))
        row = np.concatenate((row, np.repeat(np.arange(len(q)), k)))
        order = np.lexsort((name, -score, row))
        first = np.searchsorted(row[order], np.arange(len(q)))
        chosen = order[first[:, None] + np.arange(k)]
        best[q], ids[q] = score[chosen], name[chosen]
        bound[q] = np.maximum(bound[q], best[q, -1])

    q, d = cover_tree(queries), cover_tree(data)
    waiting = [(limit(q, d), q, d)]  # the next pair last
    while waiting:
        largest, q, d = waiting.pop()
        if largest < bound[q.rows].min():
            continue
        if not q.children and not d.children:
            compare(q.rows, d.rows)
            continue
        if d.children and (d.radius >= q.radius or not q.children):
            pairs = [(q, c) for c in d.children]
        else:
            pairs = [(c, d) for c in q.children]
        waiting += sorted(((limit(a, b), a, b) for a, b in pairs), key=lambda p: p[0])
    return best, ids


def search_exactly(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(query row, id, score) by whole numbers of any length, without a tree; a score beyond a long is the nearest long."""
    x, y = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (queries, data))
    out = []
    for i, row in enumerate(x):
        scores = sorted((-min(max(s, LOW), HIGH), n) for s, n in zip(y @ row, data_ids.tolist()) if n != query_ids[i])
        out += [(i, n, -s) for s, n in scores[:k]]
    return out


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, vector, dim): floor(scale * x) of each component, a whole number in a double. Rows with a null id, a null vector or a null or non-finite component are left out."""
    kept = rows_as(vectors, vec_id=id_col, vector=vector_col).where("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # from 2**62 on a double is a whole number; a multiple beyond a double is the greatest double
    most = float(np.finfo(float).max)
    floor = lambda v: F.when(F.abs(v) < float(1 << 62), F.floor(v).cast("double")).otherwise(F.least(F.greatest(v, F.lit(-most)), F.lit(most)))
    scaled = F.transform("vector", lambda x: floor(x.cast("double") * scale))
    return kept.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("vector"), F.size("vector").alias("dim"))


def place(rows: DataFrame, tops: dict[int, np.ndarray], first: dict[int, int]) -> DataFrame:
    """rows with `leaf`, the leaf of the top tree whose centre is nearest, and `dist` to it; leaf -1 for rows of a length that the sample lacks and those with a big component."""
    shared = rows.sparkSession.sparkContext.broadcast((tops, first))

    def batches(parts):
        tops, first = shared.value
        for b in parts:
            leaf, dist = np.full(len(b), -1), np.zeros(len(b))
            dims = b["dim"].to_numpy()
            for dim in set(dims.tolist()) & set(tops):
                at = np.flatnonzero(dims == dim)
                x = np.stack(b["vector"].to_numpy()[at]).astype(float)
                fine = np.abs(x).max(axis=1) < BIG
                at, x, c = at[fine], x[fine], tops[dim]
                near = ((c * c).sum(1)[None] - 2 * (x @ c.T)).argmin(axis=1)
                leaf[at], dist[at] = near + first[dim], np.sqrt(((x - c[near]) ** 2).sum(1))
            yield b.assign(leaf=leaf, dist=dist)

    return rows.mapInPandas(batches, "vec_id long, vector array<double>, dim int, leaf int, dist double")


def _united(sizes: list[int], rows: int) -> tuple[list[int], list[int]]:
    """(unit of each leaf, parts of each unit): neighbouring leaves are united up to about `rows` rows; a unit of more has several parts."""
    unit, totals = [], []
    for n in sizes:
        if not totals or totals[-1] + n > rows:
            totals.append(0)
        totals[-1] += n
        unit.append(len(totals) - 1)
    return unit, [max(1, -(-n // rows)) for n in totals]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each row whose id `every` divides.

    Candidates are all rows of the same length but the query's own (rows of its id); ties go to the smaller vec_id; fewer
    rows give fewer results. Queries and data are placed by one tree, whose top the driver builds on a bounded sample:
    leaves of it make cells of data and blocks of queries of bounded size (more rows than that are parted by a hash, so
    a vector that a third of the rows repeat fills no cell). Each query first meets one part of its own cell, which
    gives it a kth score; then a block is sent only to those cells whose balls allow as much as its worst kth
    score. In a task, cover trees on both sides are searched together. k rows a query and cell are merged at the end.

    Rows of one vec_id are one query: the best of all their pairs count; equal query rows count once. Components from
    BIG / scale on are compared by exact whole numbers; a score beyond a long is the nearest long. Empty tables and
    empty vectors give no rows.
    """
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vector_col, scale).where("dim > 0")
    n = rows.count()
    chosen = rows.where(F.forall("vector", lambda x: F.abs(x) < BIG)).where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    sample: dict = {}
    for r in chosen.select("dim", "vector").orderBy(F.xxhash64("vector")).limit(4 * SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["vector"])
    tops = {dim: np.array(found)[[x.at for x in leaves(cover_tree(np.array(found)))]] for dim, found in sample.items()}
    first, centres = {}, []
    for dim, found in tops.items():
        first[dim] = len(centres)
        centres += [(dim, c) for c in found]
    placed = written(place(rows, tops, first), "topk-placed")
    asked = F.col("vec_id") % every == 0
    facts = {r["leaf"]: r for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.sum(asked.cast("long")).alias("nq"), F.max(F.when(asked, F.col("dist"))).alias("rq")).collect()}
    sizes = lambda name: [(facts[i][name] or 0) if i in facts else 0 for i in range(len(centres))]
    odd = facts.get(-1)
    # leaf -1, the last one here, is a unit by itself on either side, which all others meet
    (cell_of, cell_parts), (block_of, block_parts) = _united(sizes("n"), CELL_ROWS), _united(sizes("nq"), QUERY_ROWS)
    cell_of, block_of = [*cell_of, len(cell_parts)], [*block_of, len(block_parts)]
    cell_parts, block_parts = [*cell_parts, -(-odd["n"] // CELL_ROWS) if odd else 1], [*block_parts, -(-odd["nq"] // QUERY_ROWS) if odd and odd["nq"] else 1]

    parted = lambda df, of, parts: df.withColumn("unit", F.element_at(F.lit(of), F.when(F.col("leaf") < 0, len(of)).otherwise(F.col("leaf") + 1))).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.element_at(F.lit(parts), F.col("unit") + 1)).cast("int"))
    data = parted(placed, cell_of, cell_parts).select(*(F.col(c).alias(c) for c in ("vec_id", "vector", "dim")), F.col("unit").alias("cell"), F.col("part").alias("cell_part"))
    queries = parted(placed.where(asked), block_of, block_parts).select("vec_id", "vector", "dim", F.col("unit").alias("block"), F.col("part").alias("block_part"), F.element_at(F.lit(cell_of), F.when(F.col("leaf") < 0, len(cell_of)).otherwise(F.col("leaf") + 1)).alias("own")).dropDuplicates()

    def near(queries: DataFrame, meets: list[tuple[int, int, int]]) -> DataFrame:
        """(block, query_id, vec_id, score) of the k best pairs of each query in each of its cells; meets has (block, cell, parts of the cell that count). A query with `own` only meets that cell."""
        table = lambda: F.broadcast(spark.createDataFrame(meets, "block int, cell int, parts int"))
        parts = F.element_at(F.lit(block_parts), F.col("block") + 1)
        right = data.join(table(), "cell").where("cell_part < parts").withColumn("block_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        left = queries.join(table(), "block").where("own is null or own = cell").withColumn("cell_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def pair(asking: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
            if not len(asking) or not len(cell):
                return pd.DataFrame({"block": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
            x, y = (np.stack(t["vector"].to_numpy()).astype(np.float64) for t in (asking, cell))
            q, names = asking["vec_id"].to_numpy(), cell["vec_id"].to_numpy()
            if np.abs(x).max() * np.abs(y).max() * x.shape[1] >= 2**53:
                row, name, score = np.array(search_exactly(x, q, y, names, k), object).reshape(-1, 3).T
                row, name, score = row.astype(int), name.astype(np.int64), score.astype(np.int64)
            else:
                score, name = search(x, q, y, names, k, asking["known"].to_numpy(float))
                found = np.isfinite(score)
                row, name, score = np.nonzero(found)[0], name[found], score[found].astype(np.int64)
            return pd.DataFrame({"block": asking["block"].to_numpy()[row], "query_id": q[row], "vec_id": name, "score": score})

        keys = ["block", "block_part", "cell", "cell_part", "dim"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "block int, query_id long, vec_id long, score long")

    last_cell, last_block = len(cell_parts) - 1, len(block_parts) - 1
    home = sorted({(block_of[leaf], cell_of[leaf], 1) for leaf, count in enumerate(sizes("nq")) if count})
    worst: dict = {}
    if len(centres) and home:
        place_in = F.row_number().over(W.partitionBy("block", "query_id").orderBy(F.desc("score"), "vec_id"))
        once = near(queries.withColumn("known", F.lit(float("-inf"))), home)
        kth = written(once.withColumn("place", place_in).where(F.col("place") == k).select("query_id", "block", F.col("score").cast("double").alias("known")), "topk-first")
        # a query of several rows may owe its kth score to another row: only queries of one row keep theirs
        single = queries.groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n = 1").select(F.col("vec_id").alias("query_id"))
        kth = kth.join(single, "query_id", "left_semi").withColumnRenamed("query_id", "vec_id")
        queries = queries.drop("own").join(kth, ["vec_id", "block"], "left").fillna({"known": float("-inf")}).withColumn("own", F.lit(None).cast("int"))
        worst = {r["block"]: r["worst"] for r in queries.groupBy("block").agg(F.min("known").alias("worst")).collect()}
    else:
        queries = queries.withColumn("known", F.lit(float("-inf"))).withColumn("own", F.lit(None).cast("int"))
    odd_meets = [(b, last_cell, cell_parts[last_cell]) for b in range(last_block)] + [(last_block, c, cell_parts[c]) for c in range(last_cell + 1)]
    meets = odd_meets if odd or not centres else []
    for dim in first:
        at = [i for i, (d, _) in enumerate(centres) if d == dim and i in facts]
        asking = [i for i in at if facts[i]["nq"]]
        if not asking:
            continue
        c, cq = np.array([centres[i][1] for i in at]), np.array([centres[i][1] for i in asking])
        length = lambda m: np.linalg.norm(m, axis=1)
        allowed = most(cq @ c.T, length(cq)[:, None], np.array([facts[i]["rq"] for i in asking])[:, None], length(c)[None], np.array([facts[i]["r"] for i in at])[None])
        keep = allowed >= np.array([worst.get(block_of[i], -np.inf) for i in asking])[:, None]
        cell, block = np.array([cell_of[i] for i in at]), np.array([block_of[i] for i in asking])
        pairs = {(int(block[a]), int(cell[b])) for a, b in zip(*np.nonzero(keep))}
        meets += [(b, c, cell_parts[c]) for b, c in sorted(pairs)]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near(queries, sorted(set(meets))).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as w from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {EVERY} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= {K}
"""
