"""License scans: sparse TF-IDF cosine of passages and files to license texts, then inheritance from the nearest directory above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import rows_as, written
from eventloom.llm.license_texts import TEMPLATES

#: A passage counts as a license text from this cosine on.
LEAST = 0.7
#: A term; the end of a sentence; an empty or empty commented line; names of license files, in lower case.
TERM, STOP, GAP = r"[a-z0-9]+(?:[.-][a-z0-9]+)*", r"([.!?])[ \t]+", r"\n[ \t#*/;%-]*\n"
FILE_NAME = r"^(unlicense|licen[cs]e|copying|notice)([._-][^/]*)?$"
DIRECTORY, NAME = r"^((?s).*)/[^/]*$", r"([^/]*)$"


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(license, notice)."""
    return spark.createDataFrame(list(templates), "license string, notice string")


def terms(text: Column) -> Column:
    """All terms of a text, repeats included: letters a-z after lower-casing and digits, dots and hyphens inside them."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def passages(text: Column) -> Column:
    """What of a text is compared: its sentences line by line, its paragraphs with their lines joined and the sentences of
    these, and the whole text, which comes first.
    """
    sentences = lambda t: F.split(F.regexp_replace(t, STOP, "$1\n"), "\n", -1)
    paragraphs = F.transform(F.split(text, GAP, -1), lambda p: F.translate(p, "\n", " "))
    return F.concat(F.array(text), sentences(text), paragraphs, F.flatten(F.transform(paragraphs, sentences)))


def vectors(templates: DataFrame, held: DataFrame, rows: float) -> DataFrame:
    """(notice, license, term, idf, share): the terms of each template with their weight in its vector of length 1. held has (terms) a row, each term once."""
    named = templates.where("license is not null and notice is not null").distinct().withColumn("no", F.xxhash64("license", "notice"))
    listed = named.select("no", "license", F.explode(terms(F.col("notice"))).alias("term")).groupBy("no", "license", "term").agg(F.count("*").alias("n"))
    seen = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + F.lit(rows) / (1 + F.coalesce("df", F.lit(0))))
    weighed = listed.join(seen, "term", "left").withColumn("idf", idf).withColumn("w", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("no")))
    return weighed.withColumn("share", F.try_divide("w", norm)).select("no", "license", "term", "idf", "share")


def prefix(known: DataFrame, least: float) -> DataFrame:
    """(term) of which a text must have one to come up to `least` with any template: what is left of a template's vector without these terms is shorter than that."""
    rest = F.sum(F.col("share") * F.col("share")).over(W.partitionBy("no").orderBy("share", F.desc("term")).rowsBetween(W.unboundedPreceding, 0))
    return known.withColumn("rest", rest).where(F.sqrt("rest") >= least - 1e-9).select("term").distinct()


def scan(files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(doc_id, path, license, cosine, origin, directory) for every row of (doc_id, path, text).

    Each passage of a text (see passages) is compared with each template by the cosine of their term weights: term count
    times log(1 + rows / (1 + rows with the term)), over all rows; a term in no template weighs as one that no row has.
    Only texts with one of the prefix() terms, without which no cosine reaches `least`, are cut into passages. The best
    (highest cosine, then license) is a row's own license. A row without one inherits that of the nearest directory
    above it, its own first, that holds a license file: one named so (FILE_NAME) with a license, or one whose whole text
    is a license text (the best notice there; ties: license). origin says own, inherited or none; cosine is null unless
    own, and directory null unless inherited.

    A null or empty text has no license of its own; a null path counts as empty and lies in the root; repeated rows stay;
    extra columns are ignored; empty tables give an empty result or no licenses. Templates are a short list of
    fixed size: their terms are broadcast. All of it is DataFrame functions.
    """
    rows = rows_as(files, doc_id=id_col, path=path_col, text=text_col).select("doc_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    literal = lambda found: F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")
    vocabulary = sorted({t for r in templates.select(terms(F.col("notice")).alias("t")).where("t is not null").collect() for t in r["t"]})
    key = F.xxhash64("path", "text")
    placed = written(rows.select("doc_id", "path", key.alias("key"), F.array_intersect(terms(F.col("text")), literal(vocabulary)).alias("terms")), "license-terms")
    total = float(placed.count())
    known = written(vectors(templates, placed, total), "license-vectors")
    needed = literal(sorted(r["term"] for r in prefix(known, least).collect()))

    # equal files count once
    able = placed.where(F.arrays_overlap("terms", needed)).select("key").distinct()
    texts = rows.where(F.arrays_overlap(terms(F.col("text")), needed)).select(key.alias("key"), "text").dropDuplicates(["key"]).join(able, "key", "left_semi")
    counted = texts.select("key", F.posexplode(passages(F.col("text"))).alias("at", "passage")).where(F.arrays_overlap(terms(F.col("passage")), needed))
    counted = counted.select("key", "at", F.explode(terms(F.col("passage"))).alias("term")).groupBy("key", "at", "term").agg(F.count("*").alias("n"))
    idf = F.broadcast(known.select("term", "idf").distinct())
    vector = written(counted.join(idf, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.log(F.lit(1 + total)))).select("key", "at", "term", "w"), "license-passages")
    lengths = vector.groupBy("key", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    scores = vector.join(F.broadcast(known.select("no", "license", "term", "share")), "term").groupBy("key", "at", "no", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    best = scores.join(lengths, ["key", "at"]).withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("cosine") >= least)
    own = written(best.groupBy("key").agg(F.max_by("license", F.struct("cosine", "license")).alias("license"), F.max("cosine").alias("cosine"), F.max(F.col("at") == 0).alias("whole")), "license-own")

    directory, name = F.regexp_extract("path", DIRECTORY, 1), F.lower(F.regexp_extract("path", NAME, 1))
    # rows that cannot have a license of their own keep a key that spreads them and matches nothing
    spread = F.when(F.arrays_overlap("terms", needed), F.col("key")).otherwise(F.xxhash64("doc_id", "path"))
    listed = placed.select("doc_id", "path", spread.alias("key"), F.arrays_overlap("terms", needed).alias("able"), directory.alias("directory"), name.rlike(FILE_NAME).alias("named"))
    marked = listed.join(own.withColumn("able", F.lit(True)), ["key", "able"], "left")
    granting = marked.where("license is not null and (named or whole)").groupBy("directory").agg(F.max_by("license", F.struct("cosine", "license")).alias("granted"))
    parts = F.split("directory", "/", -1)
    above = F.concat(F.array(F.lit("")), F.when(F.col("directory") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    climbs = listed.select("directory").distinct().select("directory", F.posexplode(above).alias("depth", "above"))
    inherited = climbs.join(granting.withColumnRenamed("directory", "above"), "above").groupBy("directory").agg(F.max_by("granted", "depth").alias("granted"), F.max_by("above", "depth").alias("above"))
    out = marked.join(inherited, "directory", "left")
    none = F.col("license").isNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "granted").alias("license"), "cosine",
        F.when(~none, "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(none, F.col("above")).alias("directory"),
    )


def oracle(files: str, templates=TEMPLATES, least: float = LEAST) -> str:
    """The same in SQL, over a relation (doc_id, path, text), without the prefix filter."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in sorted(set(templates)))
    found = lambda c: f"regexp_extract_all(lower({c}), '{TERM}')"
    cut = lambda c: f"string_split(regexp_replace({c}, '{STOP}', E'\\\\1\\n', 'g'), E'\\n')"
    return f"""
with f as (select row_number() over () as row, doc_id, coalesce(path, '') as path, coalesce(text, '') as text from ({files})),
tp as (select row_number() over () as no, * from (values {listed}) v(license, notice)),
tt as (select no, license, term, count(*) as n from (select no, license, unnest({found('notice')}) as term from tp) group by all),
df as (select term, count(*) as df from (select distinct row, term from (select row, unnest({found('text')}) as term from f)) where term in (select term from tt) group by 1),
tn as (select count(*)::double as total from f),
tw as (select no, license, term, idf, n * idf as w from (select no, license, tt.term, n, ln(1 + total / (1 + coalesce(df, 0))) as idf from tt cross join tn left join df using (term))),
tv as (select *, w / sqrt(sum(w * w) over (partition by no)) as share from tw),
pg as (select row, text, list_transform(string_split_regex(text, '{GAP}'), lambda p: translate(p, E'\\n', ' ')) as ps from f),
ps as (select row, list_concat([text], {cut('text')}, ps, flatten(list_transform(ps, lambda p: {cut('p')}))) as every from pg),
un as (select row, unnest(every) as passage, generate_subscripts(every, 1) as k from ps),
ct as (select row, k, term, count(*) as n from (select row, k, unnest({found('passage')}) as term from un) group by all),
cw as (select row, k, ct.term, n * coalesce(idf, ln(1 + total)) as w from ct cross join tn left join (select distinct term, idf from tv) using (term)),
ln_ as (select row, k, sqrt(sum(w * w)) as length from cw group by all),
sc as (select row, k, no, license, sum(cw.w * share) as dot from cw join tv using (term) group by all),
bs as (select row, k, license, round(dot / length, 6) as cosine from sc join ln_ using (row, k) where round(dot / length, 6) >= {least}),
ow as (select row, arg_max(license, (cosine, license)) as license, max(cosine) as cosine, bool_or(k = 1) as whole from bs group by 1),
pl as (select f.row, doc_id, path, regexp_extract(path, '^((?s).*)/[^/]*$', 1) as directory, regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '{FILE_NAME}') as named, license, cosine, whole from f left join ow using (row)),
gr as (select directory as above, arg_max(license, (cosine, license)) as granted from pl where license is not null and (named or whole) group by 1),
cl as (select distinct directory, unnest(list_concat([''], case when directory = '' then [] else list_transform(range(1, len(string_split(directory, '/')) + 1), lambda n: array_to_string(string_split(directory, '/')[1:n], '/')) end)) as above from pl),
ih as (select directory, arg_max(granted, length(above)) as granted, arg_max(above, length(above)) as above from cl join gr using (above) group by 1)
select doc_id, path, coalesce(license, granted) as license, cosine, case when license is not null then 'own' when granted is not null then 'inherited' else 'none' end as origin, case when license is null then above end as directory
from pl left join ih using (directory)
"""
