"""URL filters by a temporal list join.

Dated list entries (list, domain, day, action add or remove) become validity
intervals: an entry holds from its day until the next entry of its list and
domain.  Of entries of one day the removal wins.  A capture is judged by the
entries of its host and the host's parent domains that were active on the day it
was fetched.

Rules meet distinct hosts first, by domain; what a host may match is one row
with its intervals, joined to captures by host and evaluated as of each fetch by
array functions.  No row is made for a pair of capture and rule, and captures
are not grouped; captures of the hosts with most of them are dealt to many parts.

A null or malformed URL has a null host and, as a null day, matches nothing;
entries with nulls are left out; repeated entries count once and repeated
captures each; empty tables give no rows or no matches; ties among rules are
listed in order of list, then domain.  Other columns pass through nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import salted_join

#: The list that the query uses: fixed example entries for the test hosts.
ENTRIES = (
    ("ads", "ads-track.example.com", "2024-01-10", "add"),
    ("ads", "ads-track.example.com", "2024-05-01", "remove"),
    ("ads", "ads-track.example.com", "2024-09-01", "add"),
    ("gambling", "casino-win.example.com", "2023-12-01", "add"),
    ("gambling", "free-bets.example.com", "2024-03-15", "add"),
    ("gambling", "casino-win.example.com", "2024-08-01", "add"),
    ("mobile", "m.casino-win.example.com", "2024-06-01", "add"),
    ("spam", "cheap-pills.example.com", "2024-02-01", "add"),
    ("spam", "cheap-pills.example.com", "2024-07-01", "remove"),
    ("spam", "cheap-pills.example.com", "2024-10-01", "add"),
    ("spam", "free-bets.example.com", "2024-04-01", "add"),
    ("spam", "free-bets.example.com", "2024-04-01", "remove"),
)


def entries(spark: SparkSession, rows=ENTRIES) -> DataFrame:
    return spark.createDataFrame([*rows], "list string, domain string, day string, action string").withColumn("day", F.to_date("day"))


def host(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and a final dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#\[\]@]+)", 1))
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def intervals(dated: DataFrame) -> DataFrame:
    """list, domain, since and until (null: still valid), one row for each stretch in which the entry holds."""
    day = dated.dropna(subset=["list", "domain", "day", "action"]).groupBy("list", F.lower("domain").alias("domain"), "day").agg(F.min(F.col("action") == "add").alias("adds"))
    order = W.partitionBy("list", "domain").orderBy("day")  # an entry's own history, a row a day at most
    return day.withColumn("until", F.lead("day").over(order)).filter("adds").select("list", "domain", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, dated: DataFrame, id_col: str = "page_id", url_col: str = "url", day: Column | None = None) -> DataFrame:
    """page_id, url, host, day, active (list, domain, since of each rule in force) and blocked."""
    own = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), (F.col("day") if day is None else day).alias("day"))
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = own.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n")).select("host", "n", F.explode(above).alias("domain"))
    rules = hosts.join(intervals(dated), "domain").groupBy("host").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("list", "domain", "since", "until"))).alias("rules"))
    both = salted_join(own, rules, ["host"], "n", F.col("page_id"), "left")
    active = F.filter("rules", lambda r: (r["since"] <= F.col("day")) & (r["until"].isNull() | (F.col("day") < r["until"])))
    active = F.coalesce(F.transform(active, lambda r: F.struct(r["list"].alias("list"), r["domain"].alias("domain"), r["since"].alias("since"))), F.expr("CAST(array() AS array<struct<list:string,domain:string,since:date>>)"))
    return both.select("page_id", "url", "host", "day", active.alias("active")).withColumn("blocked", F.size("active") > 0)


def query(pages: DataFrame) -> DataFrame:
    """Pages have no fetch date in the test tables; one is derived from page_id, over the year 2024."""
    found = evaluate(pages, entries(pages.sparkSession), day=F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")))
    listed = F.array_join(F.transform("active", lambda r: F.concat_ws(":", r["list"], r["domain"], r["since"].cast("string"))), ",")
    return found.select("page_id", "host", F.col("day").cast("string").alias("fetched"), F.size("active").cast("long").alias("n_active"), listed.alias("active"), "blocked")


SQL = f"""
WITH dated(list, domain, day, action) AS (VALUES {", ".join(f"('{a}', '{b}', DATE '{c}', '{d}')" for a, b, c, d in ENTRIES)}),
per_day AS (SELECT list, domain, day, bool_and(action = 'add') AS adds FROM dated GROUP BY ALL),
valid AS (SELECT list, domain, day AS since, adds, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until FROM per_day),
own AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#\\[\\]@]+)', 1)), '.'), '') AS host,
         DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched
  FROM pages)
SELECT o.page_id, o.host, CAST(o.fetched AS VARCHAR) AS fetched, count(v.list) AS n_active,
       coalesce(string_agg(v.list || ':' || v.domain || ':' || CAST(v.since AS VARCHAR), ',' ORDER BY v.list, v.domain, v.since), '') AS active,
       count(v.list) > 0 AS blocked
FROM own o LEFT JOIN valid v
  ON v.adds AND (o.host = v.domain OR ends_with(o.host, '.' || v.domain)) AND v.since <= o.fetched AND (v.until IS NULL OR o.fetched < v.until)
GROUP BY o.page_id, o.host, o.fetched
"""
