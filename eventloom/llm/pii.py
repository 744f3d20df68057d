"""Personal data: spans by pattern, and terms whose co-occurrence with an entity reveals it."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import packed, rows_as, unpacked, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity whose terms may reveal it; documents that smoothing adds to a term; the shares of
#: the entity's information from which a term is generalised and removed.
WINDOW, SMOOTHING, GENERALISE, REMOVE = 5, 1, 0.8, 0.95
#: The largest set of candidate terms that is broadcast; more are joined by shuffling.
BROADCAST_TERMS = 200_000
#: One of so many partitions is counted before all are, in turn, as no term that is too frequent there can reveal anything.
ROUNDS = (32, 8, 2)
#: Terms counted in a Python worker before their counts are passed on.
HELD_TERMS = 400_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    pairs = [int(d) for d in reversed(digits)]
    return (sum(pairs[::2]) + sum(sum(divmod(2 * d, 10)) for d in pairs[1::2])) % 10 == 0


def _emails(text: str):
    """An address begins where the run of local characters before an @ begins, but not before the last address's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data that the patterns find, by start, then kind as in KINDS."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((*m.span(), "card"))
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """For each of the spans, which are sorted and do not overlap, whether it is outside all taken ones."""
    starts, ends = [x for x, _ in spans], [y for _, y in spans]
    out = [True] * len(spans)
    for a, b in taken:
        for i in range(bisect_right(ends, a), bisect_left(starts, b)):
            out[i] = False
    return out


def context(text: str, spans: list[tuple[int, int, str]], window: int = WINDOW) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms within `window` terms of each span on its line, outside all spans.

    A line is read once, however many spans it has; words are whole and any length.
    """
    out, taken, line, found = [], [(a, b) for a, b, _ in spans], None, []
    for a, b, kind in spans:
        here = text.rfind("\n", 0, a) + 1
        if here != line:
            line, stop = here, text.find("\n", b)
            terms = [m.span() for m in _TERM.finditer(text, line, len(text) if stop < 0 else stop)]
            inside = taken[bisect_left(taken, (line, 0)) :]
            inside = inside[: bisect_left(inside, (len(text) if stop < 0 else stop, 0))]
            found = [s for s, free in zip(terms, _apart(terms, inside)) if free]
        left, right = bisect_right(found, a, key=lambda s: s[1]), bisect_left(found, b, key=lambda s: s[0])
        out += [(f"{kind}:{text[a:b]}", text[x:y].lower(), x, y) for x, y in found[max(left - window, 0) : left] + found[right : right + window]]
    return out


def group_of(entity: str) -> str:
    """What an entity is backed off to: an address to its domain, others to their kind."""
    kind, _, value = entity.partition(":")
    return f"{kind}:@{value.rpartition('@')[2].lower()}" if kind == "email" else kind


_FOUND = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:int,end:int,kind:string>>, near array<struct<entity:string,term:string>>, held array<struct<entity:string,grp:string,kind:string>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, a 64-bit key of the text, counts, base spans, the different entities and the terms beside them."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    term = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
    entity = pa.list_(pa.struct([("entity", pa.string()), ("grp", pa.string()), ("kind", pa.string())]))
    names = ["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "near", "held"]

    def batches(rows):
        for b in rows:
            keys, spans, near, held = [], [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                keys.append(_text_key(text))
                spans.append(base_spans(text))
                near.append(sorted({(e, w) for e, w, _, _ in context(text, spans[-1], window)}) if spans[-1] else [])
                held.append(sorted({(f"{k}:{text[x:y]}", k) for x, y, k in spans[-1]}))
            counts = [pa.array([sum(x[2] == kind for x in s) for s in spans], pa.int64()) for kind in KINDS[:4]]
            base = pa.array([[{"start": x, "end": y, "kind": k} for x, y, k in s] for s in spans], span)
            terms = pa.array([[{"entity": e, "term": w} for e, w in s] for s in near], term)
            entities = pa.array([[{"entity": e, "grp": group_of(e), "kind": k} for e, k in s] for s in held], entity)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), *counts, base, terms, entities], names)

    kept = rows_as(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return kept.mapInArrow(batches, _FOUND)


def _text_key(text: str) -> int:
    k = xxhash.xxh64_intdigest(text.encode(), 42)
    return k - (1 << 64) if k >> 63 else k


def occurrences(docs: DataFrame, terms: DataFrame, holding: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, term, at) of the listed terms in whole texts, outside base spans.

    There is a row for each row of docs and term; at has all its (start, end). With holding, only rows with an entity are read,
    else only those without. A longer list than BROADCAST_TERMS is joined instead of broadcast.
    """
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    listed = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in terms.collect())) if few else None

    def batches(rows):
        known = listed.value if listed else None
        for b in rows:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                spans = base_spans(text)
                if bool(spans) != holding or not text:
                    continue
                at: dict = {}
                for m in _TERM.finditer(text):
                    word = m[0].lower()
                    if known is None or word in known:
                        at.setdefault(word, []).append(m.span())
                if spans:
                    taken = [(x, y) for x, y, _ in spans]
                    at = {w: [s for s, free in zip(found, _apart(found, taken)) if free] for w, found in at.items()}
                key = _text_key(text)
                out += [{"doc_id": i, "text_key": key, "term": w, "at": [{"start": x, "end": y} for x, y in found]} for w, found in at.items() if found]
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    kept = rows_as(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = kept.mapInArrow(batches, _OCCURS)
    return found if few else found.join(terms, "term", "left_semi")


_OCCURS = "doc_id long, text_key long, term string, at array<struct<start:int,end:int>>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("term", pa.string()),
    ("at", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many rows each of the listed terms occurs. A longer list than BROADCAST_TERMS is joined instead of broadcast."""
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    listed = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in terms.collect())) if few else None

    def batches(rows):
        held: Counter = Counter()
        known = listed.value if listed else None
        for b in rows:
            for t in b.column(0):
                if t.is_valid:
                    found = set(_TERM.findall(t.as_py().lower()))
                    held.update(found if known is None else found & known)
            if len(held) > HELD_TERMS:
                yield pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values())})
                held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values())})

    counts = rows_as(docs, text=text_col).selectExpr("cast(text as string) text").mapInArrow(batches, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts if few else counts.join(terms, "term", "left_semi")


def _held_with(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Of rows with doc_id, text_key and an entity, group or kind those whose text holds it."""
    row = F.xxhash64("doc_id", "text_key")
    held = found.select(row.alias("_row"), F.explode(F.array_distinct(f"held.{name}")).alias(name))
    return rows.withColumn("_row", row).join(held, ["_row", name], "left_semi").drop("_row")


def revealing(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = SMOOTHING, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share) of the terms beside an entity that reveal `least` or more of its information, and the candidates' occurrences in rows with entities.

    The share is 1 + log P(entity | term) / -log P(entity), the pair's pointwise mutual information over the entity's
    information content. P(entity | term) counts whole rows and is smoothed: `weight` more rows with the term hold the
    entity as often as the term's other rows with its group (domain or kind) foretell, which are smoothed by those with
    its kind, and these by the kind's share of all rows. So an entity of one row is judged too, and a pair needs no number of rows.
    """
    total = float(docs.count())
    near = found.select(F.explode("near").alias("x")).select("x.entity", "x.term").distinct()
    held = found.select(F.explode("held").alias("x")).select("x.*")
    alone = held.groupBy("entity", "grp", "kind").agg(F.count("*").alias("alone"))
    groups = found.select(F.explode(F.array_distinct("held.grp")).alias("grp")).groupBy("grp").agg(F.count("*").alias("in_group"))
    kinds = found.select(F.explode(F.array_distinct("held.kind")).alias("kind")).groupBy("kind").agg(F.count("*").alias("in_kind"))
    entities = alone.join(groups, "grp").join(F.broadcast(kinds), "kind")
    # no smoothing gives more than all rows with both: pairs that cannot reach the bar go before their rows are counted,
    # by lower bounds of n: the rows with the term beside any entity, then those of ever more whole partitions. A term
    # that outlives a round has few rows in its partitions, so it has few in the next ones as well: what tasks pass on
    # grows with the terms that can reveal something, not with terms times tasks. Rounds overlap, and the last one counts
    # all rows, so nothing rests on a partition holding the same rows twice
    content = F.log(F.lit(total) / F.col("alone"))
    reach = lambda n: (content > 0) & (1 + F.log((F.least("alone", n) + weight) / (F.col(n) + weight)) / content >= least)
    beside = found.select(F.explode(F.array_distinct("near.term")).alias("term")).groupBy("term").agg(F.count("*").alias("beside"))
    near = written(near.join(entities, "entity").join(beside, "term").where(reach("beside")).drop("beside"), "pii-pairs")
    for one_in in ROUNDS:
        some = term_counts(docs.where(F.pmod(F.spark_partition_id(), F.lit(one_in)) == 0), near.select("term").distinct(), text_col)
        near = written(near.join(some, "term", "left").fillna(0, ["n"]).where(reach("n")).drop("n"), "pii-rare-pairs")
    counted = term_counts(docs, near.select("term").distinct(), text_col)
    pairs = written(near.join(counted, "term").where(reach("n")), "pii-candidates")
    seen = written(occurrences(docs, pairs.select("term").distinct(), True, id_col, text_col), "pii-occurrences")
    both = lambda name: _held_with(seen.select("doc_id", "text_key", "term").join(pairs.select("term", name).distinct(), "term"), found, name).groupBy("term", name).agg(F.count("*").alias(f"both_{name}"))
    known = pairs.join(both("entity"), ["term", "entity"], "left").join(both("grp"), ["term", "grp"], "left").join(both("kind"), ["term", "kind"], "left").fillna(0, ["both_entity", "both_grp", "both_kind"])
    smooth = lambda hits, of, prior: (hits + weight * prior) / (of + weight)
    n, e, g, k = (F.col(c) for c in ("n", "both_entity", "both_grp", "both_kind"))
    p_kind = smooth(k - g, n - g, F.col("in_kind") / total)
    p_group = smooth(g - e, n - e, p_kind * F.col("in_group") / F.col("in_kind"))
    p = F.least(F.lit(1.0), smooth(e, n, p_group * F.col("alone") / F.col("in_group")))
    share = 1 + F.log(p) / content
    return written(known.select("entity", "term", share.alias("share")).where(F.col("share") >= least), "pii-revealing"), seen


def sensitive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, smoothing: float = SMOOTHING, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_email, n_ip, n_card, n_phone, base and terms (arrays of spans).

    Base spans come from the patterns; a term's span says whether it is to be generalised or removed. Positions
    are code points, ends exclusive. Terms near an entity on its line are candidates. A revealing term is marked
    wherever it stands in every row that holds the entity, and, if it is to be removed, in all other rows too; counts
    are over all rows. A null text counts as empty and has no spans; rows with equal doc_id and text get the same
    spans each; rows of one doc_id with other texts keep theirs apart; extra columns are ignored; an empty table
    gives an empty result.
    """
    found = written(find(docs, id_col, text_col, window), "pii-found")
    flagged, seen = revealing(docs, found, id_col, text_col, smoothing, generalise)
    everywhere = flagged.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= remove)
    here = _held_with(seen.join(flagged, "term"), found, "entity").select("doc_id", "text_key", "at", "share")
    here = here.unionByName(seen.join(everywhere, "term").select("doc_id", "text_key", "at", "share"))
    if not everywhere.isEmpty():
        elsewhere = occurrences(docs, everywhere.select("term"), False, id_col, text_col).join(everywhere, "term")
        here = here.unionByName(elsewhere.select("doc_id", "text_key", "at", "share"))
    marked = here.select("doc_id", "text_key", F.explode("at").alias("x"), "share").groupBy("doc_id", "text_key", "x.start", "x.end").agg(F.max("share").alias("share"))
    spans = marked.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", (F.col("share") >= remove).alias("removed")))).alias("terms"))
    spans = spans.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = found.drop("near", "held").join(spans, found["doc_id"].eqNullSafe(spans["_id"]) & (found["text_key"] == spans["_key"]), "left")
    empty = F.expr("array()").cast(spans.schema["terms"].dataType)
    return joined.select(*(found[c] for c in found.columns if c not in ("near", "held")), F.coalesce("terms", empty).alias("terms"))


def described(found: DataFrame) -> DataFrame:
    """doc_id, the four counts, base_sha256 and spans as strings of kind:start:end."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), text(s).alias("text")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(5).alias("rank"), F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")).alias("text")))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: s["text"]), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, terms)).alias("spans"))


def sanitised(text: str, base: list, terms: list) -> str:
    """The text with base spans named by their kind, terms generalised or removed; overlapping spans become one."""
    spans = sorted([(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base] + [(s["start"], s["end"], "" if s["removed"] else "[TERM]") for s in terms])
    out, at = [], 0
    for start, end, name in spans:
        if start >= at:
            out += [text[at:start], name]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars", **how) -> DataFrame:
    """docs with their texts sanitised, all other columns as they were (n_chars follows the new text).

    Only rows with spans are sent by their id to where their spans are; the others stay where they lie.
    """
    spans = sensitive(docs, text_col=text_col, **how).where("size(base) > 0 or size(terms) > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "base", "terms").dropDuplicates(["_id", "_key"])
    held = packed(docs, _doc_id=docs["doc_id"].cast("long"), _doc_text=docs[text_col], _doc_key=F.xxhash64(docs[text_col]))
    joined = held.join(spans, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_doc_key") == F.col("_key")), "left")

    @F.pandas_udf("string")
    def replaced(text, base, terms):
        return pd.Series([t if t is None or b is None else sanitised(t, b, s) for t, b, s in zip(text, base, terms)])

    done = joined.withColumn("_new", replaced(F.col("_doc_text"), "base", "terms"))
    new = {text_col: F.col("_new")}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.length("_new").cast(dict(docs.dtypes)[n_chars_col])
    return unpacked(done, docs.columns, **new)


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    """The digest of base spans, for tests by brute force."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
