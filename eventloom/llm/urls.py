"""URL filters: nested prefix rules as intervals of reversed-host keys and of path keys, found by two sorted sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import rows_as

#: (action, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty if there is no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    """What follows the host up to ? # or the end; empty if there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def key_of(host):
    """Labels from the last to the first, each closed by a dot: a domain's key is a prefix of its subdomains' keys."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def path_key(path):
    """A text as hexadecimal digits of its UTF-8 bytes: in the same order, and any letter from G on comes after all that it starts."""
    return F.hex(F.encode(path, "UTF-8"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table (action, host, path)."""
    listed = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules))
    return spark.range(1).select(F.inline(listed))


def host_marks(rules: DataFrame) -> DataFrame:
    """(top, at, hosts): from key `at` on, until the next mark of the same top label, the rule hosts in `hosts` are active.

    A host's interval is [key, key with its closing dot raised by one). Intervals nest, so the stack that a sweep holds
    after a push is a host and its ancestors with rules, and after a pop that of the nearest of these. Hosts have few
    labels, so ancestors come from an equi-join on their keys.
    """
    hosts = rules.select("host").distinct().withColumn("key", key_of(F.col("host")))
    parts = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    up = hosts.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts)))).select("key", F.concat(F.array_join(F.slice(parts, F.lit(1), F.col("n")), "."), F.lit(".")).alias("above"))
    active = up.join(hosts.select(F.col("key").alias("above"), F.col("host").alias("up")), "above").groupBy("key").agg(F.collect_list("up").alias("hosts"), F.collect_list("above").alias("line"))
    outer = F.array_max(F.filter("line", lambda a: a < F.col("key")))
    ends = active.select(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("at"), outer.alias("outer"))
    popped = ends.join(active.select(F.col("key").alias("outer"), "hosts"), "outer", "left").select("at", F.coalesce("hosts", F.expr("cast(array() as array<string>)")).alias("hosts"))
    both = active.select(F.col("key").alias("at"), "hosts").unionByName(popped)
    return both.select(F.regexp_replace(F.substring_index("at", ".", 1), "/$", "").alias("top"), "at", "hosts")


def path_marks(rules: DataFrame) -> DataFrame:
    """(rule_host, at, best): on one rule host, from path key `at` on, until the next mark, the rule in `best` is the longest that fits.

    Prefixes nest, so after a push the longest is the rule itself, and after a pop the one that encloses it: the longest
    of the prefixes of its path that are rules, from an equi-join.
    """
    best = F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "action")
    known = rules.groupBy("host", "path").agg(F.max("action").alias("action")).select("host", "path", best.alias("best"))
    shorter = known.where("path <> ''").select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n")).select("host", "path", F.expr("substring(path, 1, n)").alias("inner"))
    outer = shorter.join(known.select("host", F.col("path").alias("inner"), F.col("best").alias("outer")), ["host", "inner"]).groupBy("host", "path").agg(F.max("outer").alias("outer"))
    none = F.struct(F.lit(-1).alias("size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    ends = known.join(outer, ["host", "path"], "left").select("host", F.concat(path_key(F.col("path")), F.lit("G")).alias("at"), F.coalesce("outer", none).alias("best"))
    return known.select("host", path_key(F.col("path")).alias("at"), "best").unionByName(ends).withColumnRenamed("host", "rule_host")


def swept(points: DataFrame, marks: DataFrame, keys: list[str], value: str, salts: int) -> DataFrame:
    """points (keys, at, salt, ...) with `value` of the last mark (keys, at, value) at or before their place, null before the first.

    One sort of both by keys and place, and a running last value. It is by keys and part: points lie in one of `salts`
    parts each, so that no key meets in one task; marks are repeated in each part.
    """
    kinds = dict(points.dtypes)
    own = points.withColumn(value, F.lit(None).cast(dict(marks.dtypes)[value])).withColumn("_point", F.lit(1))
    theirs = marks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).withColumn("_point", F.lit(0))
    theirs = theirs.select(*(F.col(c) if c in theirs.columns else F.lit(None).cast(kinds[c]).alias(c) for c in own.columns))
    # after equal ends of intervals the outermost counts, before equal starts of points all marks
    order = W.partitionBy(*keys, "salt").orderBy("at", "_point").rowsBetween(W.unboundedPreceding, 0)
    return own.unionByName(theirs).withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_point = 1").drop("_point")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int = 64) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row; rule is null and verdict the default where none fits.

    Two sweeps. Urls and the ends of the rule hosts' intervals are sorted together by reversed host; the running stack
    gives each url the rule hosts that it lies under, few. Then urls and the ends of the rules' path intervals are sorted
    together by rule host and path; the top of the running stack is the longest rule of that host, so neither a host's
    rules nor a rule's urls are ever gathered. Of a url's hosts the longest rule decides (ties: the greater rule text;
    of one host and path the greater action).

    A null url, or one without ://, has empty host and path and fits no rule. Rules with a null or empty host, a null
    path or a null action are left out; repeated rows stay; extra columns are ignored; empty tables give empty results
    or defaults. All of it is DataFrame functions.
    """
    kept = rules.where("host is not null and path is not null and action is not null and host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").distinct()
    urls = rows_as(pages, page_id=id_col, url=url_col).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    salt = F.pmod(F.xxhash64("row"), F.lit(salts))
    points = urls.withColumn("at", key_of(F.col("host"))).withColumn("top", F.substring_index("at", ".", 1)).withColumn("salt", salt)
    under = swept(points, host_marks(kept), ["top"], "hosts", salts).select("row", "page_id", "host", "path", F.explode_outer("hosts").alias("rule_host"), "salt")
    found = swept(under.withColumn("at", path_key(F.col("path"))), path_marks(kept), ["rule_host"], "best", salts)
    out = found.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


ORACLE = (
    r"with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + r"') as host, "
    r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from pages), "
    "r as (select *, case " + " ".join(f"when {_fits(h, p)} then '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " end as rule from u) "
    "select page_id, host, path, rule, case " + " ".join(f"when rule = '{h}{p}' then '{a}'" for a, h, p in RULES) + " else 'allow' end as verdict from r"
)
