"""Language identification by fusing text likelihoods, declared language, address suffix and host priors."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, rows_as, written
from eventloom.llm.urls import host_of

#: Labelled texts that a fit uses at most (a sample by hash of doc_id when there are more), which bounds what is broadcast; and
#: how many 3-grams a language is taken to have at least, for the smoothing. 3-grams that no labelled text has share one row.
TRAIN_ROWS, GRAMS = 20_000, 1 << 18
#: Different 3-grams that a Python worker counts before it passes them on; parts that a host's pages are joined in.
HELD_GRAMS, SALTS = 200_000, 16
#: A text's likelihood counts as that of so many independent 3-grams at most: neighbours overlap.
EFFECTIVE = 60
#: Pages' worth of belief that a host has in its domain, and a domain in the whole; added to each count of a pair.
BELIEF, ADDED = 5.0, 0.5
#: What is left out as a whole, from its opening to its end.
_BLOCKS = (("<script", re.compile("</script>", re.I)), ("<style", re.compile("</style>", re.I)), ("<!--", re.compile("-->")))
_SPACE = re.compile(r"[\W\d_]+")
#: Country suffixes that speak for a language (fixed values); others, such as com or org, count as themselves.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en"}


def plain(page: str | None) -> str:
    """A page's visible text, in time that grows with its length: scripts, styles and comments go as a whole if they are closed, all other tags one by one."""
    text = page or ""
    last, at, out = text.rfind(">"), 0, []
    ends = [[m.span() for m in end.finditer(text)] for _, end in _BLOCKS] if last >= 0 else []
    while (i := text.find("<", at)) >= 0 and i < last:
        out.append(text[at:i])
        at = text.index(">", i) + 1
        for (start, _), closed in zip(_BLOCKS, ends):
            if text[i : i + len(start)].lower() == start and (k := bisect_left(closed, (i + len(start), 0))) < len(closed):
                at = closed[k][1]
        out.append(" ")
    return html.unescape("".join(out) + text[at:])


def grams(text: str) -> list[str]:
    """The 3-grams of the letters of a text, words set off by one space."""
    line = " " + _SPACE.sub(" ", text.lower()).strip() + " "
    return [line[i : i + 3] for i in range(len(line) - 2)] if len(line) > 2 else []


class Model:
    """Languages, the row of each 3-gram kept, and the log probabilities by language; the last row is that of any other 3-gram."""

    def __init__(self, languages: list[str], rows: dict[str, int], logs: np.ndarray):
        self.languages, self.rows, self.logs = languages, rows, logs


def likelihood(text: str, rows: dict[str, int], logs: np.ndarray) -> np.ndarray:
    """Log likelihood of a text by language, as that of EFFECTIVE 3-grams at most; zeros for a text without letters."""
    counts = Counter(grams(text))
    n = sum(counts.values())
    if not n:
        return np.zeros(logs.shape[1])
    at = np.array([rows.get(g, -1) for g in counts])
    return np.array(list(counts.values())) @ logs[at] * min(1.0, EFFECTIVE / n)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled texts; null labels and texts are left out."""
    kept = rows_as(docs, doc_id=id_col, lang=lang_col, text=text_col).where("lang is not null and text is not null").selectExpr("doc_id", "cast(lang as string) lang", "cast(text as string) text")
    n = kept.count()
    if n > train_rows:
        kept = kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(train_rows / n * (1 << 30)))

    def batches(rows):
        held: dict[str, Counter] = {}

        def passed_on():
            for lang, found in held.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "gram": list(found), "n": list(found.values())})
            held.clear()

        for b in rows:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(lang, Counter()).update(grams(text.as_py()))
                if sum(map(len, held.values())) > HELD_GRAMS:
                    yield from passed_on()
        yield from passed_on()

    counts = written(kept.select("lang", "text").mapInArrow(batches, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "language-grams")
    per = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("all"), "gram").toPandas()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], {}, np.zeros((1, 0)))
    total = np.array([totals[x] + ADDED * (max(len(per), GRAMS) + 1) for x in languages], float)
    found = np.array([[dict(by).get(x, 0) for x in languages] for by in per["by"]]).reshape(-1, len(languages))
    return Model(languages, {g: i for i, g in enumerate(per["gram"])}, np.log(np.vstack((found + ADDED, np.full(len(languages), ADDED))) / total))


def identify(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, lang, posterior, text_lang) for every row.

    The posterior of a language is its host's prior times the likelihoods of the page's text, of the language that
    its markup declares, of its address suffix and of the two letters that start its path. The likelihoods of the
    last three are how often, over all pages, they go with what the text says; a host's prior is its pages' text
    languages, smoothed by its domain's and these by all pages'. Each is a grouped aggregation, joined back.

    A page without text has text_lang null and counts in no table; its other evidence decides. Without any page or
    any labelled text there are no languages, and lang is null. Ties go to the first language by name. Repeated
    rows stay; extra columns are ignored.
    """
    languages = model.languages
    if not languages:
        return rows_as(pages, page_id=id_col).select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"))
    shared = pages.sparkSession.sparkContext.broadcast((languages, model.rows, model.logs))
    kept = rows_as(pages, page_id=id_col, url=url_col, html=html_col)
    page_id = dict(kept.dtypes)["page_id"]
    host = host_of(F.col("url"))
    facts = kept.select(
        "page_id", host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.lower(F.substring_index(host, ".", -1)).alias("tld"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)).alias("path_lang"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)).alias("declared"), "html",
    )
    suffix = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv)), "tld"), "tld")

    def batches(rows):
        names, grams_at, logs = shared.value
        for b in rows:
            found = [likelihood(plain(t.as_py()), grams_at, logs) for t in b.column(b.schema.get_field_index("html"))]
            best = pa.array([names[int(x.argmax())] if x.any() else None for x in found], pa.string())
            others = [b.column(i) for i, n in enumerate(b.schema.names) if n != "html"]
            yield pa.RecordBatch.from_arrays([*others, pa.array([x.tolist() for x in found], pa.list_(pa.float64())), best], ["page_id", "host", "domain", "suffix", "path_lang", "declared", "ll", "text_lang"])

    scored = cut(facts.withColumn("suffix", suffix).select("page_id", "host", "domain", "suffix", "path_lang", "declared", "html").mapInArrow(batches, f"page_id {page_id}, host string, domain string, suffix string, path_lang string, declared string, ll array<double>, text_lang string"))

    counts = lambda *keys: [F.coalesce(F.sum((F.col("text_lang") == x).cast("double")), F.lit(0.0)) for x in languages]
    vector = lambda: F.array(*counts()).alias("n")
    whole = scored.agg(vector()).first()["n"]
    n_all = sum(whole)
    base = F.array(*(F.lit((x + 1) / (n_all + len(languages))) for x in whole))
    smoothed = lambda n, above: F.zip_with(n, above, lambda a, p: (a + BELIEF * p) / (F.aggregate(n, F.lit(0.0), lambda s, v: s + v) + BELIEF))
    domains = scored.groupBy("domain").agg(vector()).select("domain", smoothed(F.col("n"), base).alias("domain_prior"))
    hosts = scored.groupBy("host", "domain").agg(vector()).join(domains, "domain").select("host", smoothed(F.col("n"), F.col("domain_prior")).alias("prior"))
    # a host may have a third of all pages: they meet its row in several parts
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = scored.withColumn("salt", F.pmod(F.xxhash64("page_id", "ll"), F.lit(SALTS))).join(salted, ["host", "salt"]).drop("salt")
    for kind in ("declared", "suffix", "path_lang"):
        pairs = scored.groupBy(kind).agg(vector())
        kinds = F.lit(float(pairs.count()))
        given = F.array(*(F.log((F.col("n")[i] + ADDED) / (F.lit(float(x)) + ADDED * kinds)) for i, x in enumerate(whole)))
        out = out.join(pairs.select(kind, given.alias(f"{kind}_ll")), kind)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(add(add(add(F.col("ll"), F.transform("prior", lambda p: F.log(p))), F.col("declared_ll")), F.col("suffix_ll")), F.col("path_lang_ll"))
    out = out.withColumn("fused", fused).withColumn("most", F.array_max("fused"))
    share = 1 / F.aggregate("fused", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("most")))
    return out.select("page_id", F.array(*map(F.lit, languages))[F.array_position("fused", F.col("most")).cast("int") - 1].alias("lang"), share.alias("posterior"), "text_lang")
