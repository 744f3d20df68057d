"""A quality classifier as a sparse ensemble of rules, compiled to Spark columns."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, row_key, rows_as

#: The most labelled rows that a fit uses: a sample by hash of doc_id when there are more.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 10, 3, 0.002, 7
THRESHOLD = 0.3

STATISTICS = ("log_words", "word_length", "upper", "digit", "space", "symbol", "other_punctuation", "distinct", "repeated", "longest_word", "line_words", "line_distinct", "shouted")
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOL, _POINT = b"#$%&*+/<=>@\\^_`{|}~", b"!\"'(),-.:;?[]"


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of STATISTICS; all 0 for a null or empty text."""
    text = text or ""
    raw, words = text.encode(), text.split()
    size, n = len(raw), len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    share = lambda kind: (size - len(raw.translate(None, kind))) / size
    lines = [x for x in text.split("\n") if x]
    chars = sum(map(len, words))
    return (
        math.log1p(n), chars / n, share(_UPPER), share(_DIGIT), (len(text) - chars) / len(text), share(_SYMBOL), share(_POINT),
        len(set(words)) / n, sum(map(str.__eq__, words, words[1:])) / n, math.log1p(max(map(len, words))), math.log1p(n / len(lines)),
        len(set(lines)) / len(lines), sum(map(str.isupper, words)) / n,
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id and the statistics of every whole text as doubles; nothing else of a row enters. With row_col, row too."""

    def batches(rows):
        for b in rows:
            found = list(zip(*(statistics_of(t.as_py()) for t in b.column(1)))) or [()] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in found), *b.columns[2:]], ["doc_id", *STATISTICS, *b.schema.names[2:]])

    more = {"row": row_col} if row_col else {}
    kept = rows_as(docs, doc_id=id_col, text=text_col, **more).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", *more)
    return kept.mapInArrow(batches, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS) + (", row binary" if row_col else ""))


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id's text is a multiple of 5; the id null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def rules_of(forest) -> list[tuple[tuple[int, bool, float], ...]]:
    """Every path from a root of the forest to another node as a rule: (statistic, at most?, bound) conditions, the tightest of each kind, no rule twice."""
    found: dict = {}

    def walk(node, path):
        if path:
            found[tuple(sorted(path.items()))] = None
        if node.subtreeDepth():
            split = node.split()
            at, bound = split.featureIndex(), split.threshold()
            walk(node.leftChild(), path | {(at, True): min(bound, path.get((at, True), math.inf))})
            walk(node.rightChild(), path | {(at, False): max(bound, path.get((at, False), -math.inf))})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return [tuple((at, least, bound) for (at, least), bound in rule) for rule in found]


def compiled(rule: tuple[tuple[int, bool, float], ...]) -> Column:
    """A rule as a column: 1.0 where all its conditions hold, else 0.0."""
    holds = F.lit(True)
    for at, most, bound in rule:
        holds = holds & ((F.col(STATISTICS[at]) <= bound) if most else (F.col(STATISTICS[at]) > bound))
    return F.when(holds, 1.0).otherwise(0.0)


class Ensemble:
    """Rules with weights and an intercept; score() is one Spark column over the statistics."""

    def __init__(self, intercept: float, weighted: list):
        self.intercept, self.weighted = intercept, weighted

    def score(self) -> Column:
        """The probability of label 1."""
        return 1 / (1 + F.exp(-sum((compiled(rule) * weight for rule, weight in self.weighted), F.lit(self.intercept))))


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ensemble:
    """Rules from a forest over the statistics, weighted by a lasso logistic fit, from rows that are not held out.

    Labels other than 0 and 1 are left out. Without labels every score is 0.5; with one label only, it is that
    label's share after adding one of each.
    """
    marked = rows_as(labels, doc_id="doc_id", label="quality").where("label in (0, 1)").selectExpr("cast(doc_id as long) doc_id", "cast(label as double) label")
    rows = stats.join(marked, "doc_id").where(~held_out(F.col("doc_id")))
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(train_rows / n * (1 << 30)))
    rows = cut(VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows.repartition(4, "doc_id").sortWithinPartitions("doc_id")))
    per = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    base = (per.get(1.0, 0) + 1) / (sum(per.values()) + 2)
    flat = Ensemble(math.log(base / (1 - base)), [])
    if len(per) < 2:
        return flat
    rules = rules_of(RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(rows))
    if not rules:
        return flat
    named = [f"r{i}" for i in range(len(rules))]
    table = rows.select("label", *(compiled(r).alias(c) for r, c in zip(rules, named)))
    table = VectorAssembler(inputCols=named, outputCol="features").transform(table).select("label", "features")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(table)
    return Ensemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients) if abs(w) > 1e-6])


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; predicted is 1 from the threshold on.

    Only statistics of the text enter a score. A null text counts as empty; both get a score. Repeated rows stay;
    rows without doc_id are scored, never learned from; extra columns are ignored; an empty table gives an empty
    result.
    """
    stats = cut(statistics(docs))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), fit(stats, labels, train_rows).score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose own text is not rejected, with all their columns; rows are told apart by doc_id and text."""
    named = docs.select("doc_id", "text", row_key(docs["doc_id"], docs["text"]).alias("row"))
    stats = cut(statistics(named, row_col="row"))
    score = fit(stats, labels).score()
    bad = stats.where(score < THRESHOLD).select(F.col("row").alias("_bad")).distinct()
    return docs.join(bad, row_key(docs["doc_id"], docs["text"]) == bad["_bad"], "left_anti")
