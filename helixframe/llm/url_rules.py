"""URL filters: a sort-merge range join of url keys with the intervals of prefix rules, by DataFrame functions only.

A host is written with its labels reversed, each followed by '.', so that a host and all its subdomains are the
keys with one prefix, which is the interval from the prefix to the prefix with its last '.' turned into '/', the
next character. Intervals of hosts nest or are disjoint. A sweep over sorted keys keeps the stack of hosts whose
interval is open. Intervals of hosts nest, so the stack after a boundary doesn't depend on what was swept before: it is a
host's own chain of enclosing rule hosts after its start and its parent's after its end. So each boundary carries
it, and the last boundary before a url (a running window over the sorted keys) is the kept stack at that url.

The method's own rules, OWN_RULES, are intervals of the same sweep; they give the verdict where none of the given rules
fits, and where neither does a url with a host is allowed and one without is blocked.

Urls are dealt evenly to buckets, whatever their host, and every bucket sweeps all boundaries: no host makes a
bucket large. Boundaries are two a rule host; MAX_BOUNDARIES bounds what each bucket gets, and with more of them
the buckets are by top-level label as well, and each gets only the boundaries of its label.

Cases: a null url or one without '://' has empty host and path and fits no rule. An empty table gives an empty
result; repeated rows are judged alike; rules that repeat count once, rules with equal texts and both verdicts
block; a null page_id is kept. Only page_id and url of the pages are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, table

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed by the contract of the query.
BASE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: The method's own rules: top-level labels under which mostly spam stands.
OWN_RULES = [(host, "/", "block") for host in ("adult", "bet", "casino", "loan", "poker", "porn", "sex", "xxx")]

MAX_BOUNDARIES = 100_000
#: Pages of a bucket, about, once there are more than the session's partitions would give it.
BUCKET_PAGES = 1_000_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit(".")))


def top_label(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): kind 0 closes a host's interval, 1 opens it; stack holds all rules of the hosts open from there on."""
    known = rules.groupBy("host", "path", "given").agg(F.max("verdict").alias("verdict"))
    hosts = known.groupBy(host_key(F.col("host")).alias("key")).agg(
        F.collect_list(
            F.struct(
                "given",
                (F.length("host") + F.length("path")).alias("size"),
                F.length("host").alias("host_size"),
                F.concat("host", "path").alias("rule"),
                "path",
                "verdict",
            )
        ).alias("own")
    )
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), "[.]")
    above = hosts.select("key", F.size(labels).alias("depth"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n"), labels.alias("labels"))
    above = above.select("key", "depth", "n", F.concat(F.array_join(F.expr("slice(labels, 1, n)"), "."), F.lit(".")).alias("at"))
    chain = above.join(hosts.select(F.col("key").alias("at"), "own"), "at")
    chain = chain.groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("inner"),
        F.flatten(F.collect_list(F.when(F.col("n") < F.col("depth"), F.col("own")))).alias("outer"),
    )
    closing = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    return chain.select(
        F.inline(
            F.array(
                F.struct(F.col("key").alias("key"), F.lit(1).alias("kind"), F.col("inner").alias("stack")),
                F.struct(closing.alias("key"), F.lit(0).alias("kind"), F.col("outer").alias("stack")),
            )
        )
    )


def any_bucket(buckets: int) -> Column:
    """A bucket by the number of the row, so that pages that repeat one another are dealt out like all others; any bucket judges a page alike."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(buckets))


def judge(pages: DataFrame, rules: DataFrame, many_rules: bool | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; rules has host, path and verdict. many_rules: over MAX_BOUNDARIES / 2 of them, by count if None."""
    spark = pages.sparkSession
    own = spark.createDataFrame(OWN_RULES, "host string, path string, verdict string")
    rules = rules.select("host", "path", "verdict", F.lit(True).alias("given")).unionByName(own.withColumn("given", F.lit(False)))
    if many_rules is None:
        many_rules = 2 * rules.count() > MAX_BOUNDARIES
    buckets = max(4 * partitions(spark), pages.count() // BUCKET_PAGES)
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), any_bucket(buckets).alias("bucket"))
    seen = seen.select(
        "bucket", (top_label(host_key(F.col("host"))) if many_rules else F.lit("")).alias("top"),
        host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), "page_id", "host", "path",
    )
    marks = boundaries(rules).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"),
        (top_label(F.translate("key", "/", ".")) if many_rules else F.lit("")).alias("top"), "key", "kind", "stack",
    )
    swept = seen.unionByName(marks, allowMissingColumns=True).withColumn(
        "open", F.last("stack", ignorenulls=True).over(Window.partitionBy("bucket", "top").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    )
    # the given rules come after the method's own in this order, longer ones after shorter
    fitting = F.array_max(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])))
    judged = swept.filter("kind = 2").select("page_id", "host", "path", fitting.alias("hit"))
    rule = F.when(F.col("hit.given"), F.col("hit.rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("hit.verdict", F.when(F.col("host") == "", "block").otherwise("allow")).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(BASE_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = """
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN concat('.', host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN concat('.', host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN concat('.', host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN concat('.', host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN concat('.', host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN host = '' OR regexp_matches(host, '(^|[.])(OWN)$') AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""".replace("OWN", "|".join(host for host, _, _ in OWN_RULES))
