"""URL filtering by nested (host, path) prefix rules: a sort-merge range join, all in DataFrame functions.

A rule fits its host and every subdomain of it when the url's path starts with the rule's path.  With hosts reversed by
labels (``b.org`` becomes ``org.b.``) both halves are prefixes, and a prefix is an interval of sorted keys; intervals of
prefixes are nested or disjoint.  A sweep goes through sorted keys with an *open* event where an interval begins and a
*close* event where it ends.  The running sum of opens and closes is the height of the stack of active rules, and the
rule at a height is the last that was opened to it: two running aggregates over the sorted rows hold the stack.

One sweep over reversed hosts finds all rule hosts that enclose a url's host, whatever the number of its labels; a second
one over ``reversed rule host + path`` finds the innermost rule under each of those.  Lookups are dealt to rooms at random,
each with a copy of the events, so that no host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorine.llm.common import Steps

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lookups of a room at least; with more events than that, as many lookups as events, so that copies never outnumber lookups.
ROOM = 512


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.expr("substring({u}, locate('://', {u}) + 3)".format(u="`__url`"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(url.contains("://"), host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://`` or for null."""
    rest = F.expr("substring({u}, locate('://', {u}) + 3)".format(u="`__url`"))
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.when(url.contains("://"), path).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """``b.org`` -> ``org.b.``: a subdomain's key continues its parent's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table of literals."""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    rows = ", ".join(f"(:v{i}, :h{i}, :p{i})" for i in range(len(rules)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(verdict, host, path)", args={f"{c}{i}": x for i, r in enumerate(rules) for c, x in zip("vhp", r)})


def events(rules: DataFrame, key: Column, carried: Column) -> DataFrame:
    """Open and close events (key, step, carried) of the rules' intervals; a close sorts after all that continue the key.

    Keys are bytes: no text holds the byte FF.
    """
    opens = F.struct(key.cast("binary").alias("key"), F.lit(1).alias("step"), carried.alias("carried"))
    closes = F.struct(F.concat(key.cast("binary"), F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), carried.alias("carried"))
    return rules.select(F.explode(F.array(opens, closes)).alias("e")).select("e.*")


def sweep(lookups: DataFrame, intervals: DataFrame, rooms: int, whole: bool) -> DataFrame:
    """``lookups`` (host, path, key) with ``found``, what an interval that holds the key carries: one row for each of
    them with ``whole``, else for the innermost; none without such an interval."""
    none = F.lit(None)
    dealt = intervals.select(F.explode(F.sequence(F.lit(0), F.lit(rooms - 1))).alias("room"), "key", "step", "carried", none.cast("string").alias("host"), none.cast("string").alias("path"))
    asked = lookups.select(F.pmod(F.xxhash64("host", "path"), F.lit(rooms)).cast("int").alias("room"), "key", F.lit(0).alias("step"), none.cast(intervals.schema["carried"].dataType).alias("carried"), "host", "path")
    sorted_ = dealt.unionByName(asked)
    # Where keys are equal, events come before lookups.
    order = [F.col("key"), F.col("step") == 0]
    upto = (Window.unboundedPreceding, Window.currentRow)
    height = sorted_.withColumn("height", F.sum("step").over(Window.partitionBy("room").orderBy(*order).rowsBetween(*upto))).where("height > 0 AND step >= 0")
    levels = F.when((F.col("step") == 0) & F.lit(whole), F.sequence(F.lit(1).cast("long"), F.col("height"))).otherwise(F.array("height"))
    height = height.withColumn("height", F.explode(levels))
    last = F.last(F.when(F.col("step") == 1, F.struct(F.col("carried").alias("c"))), ignorenulls=True)
    found = height.withColumn("top", last.over(Window.partitionBy("room", "height").orderBy(*order).rowsBetween(*upto)))
    return found.where("step = 0").select("host", "path", F.col("top.c").alias("found"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", room: int = ROOM) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    The longest fitting rule decides (characters of host and path; of equals, the one with the longer host; of rules with
    one host and path, a block beats an allow); without one ``rule`` is null and the verdict is ``default``.  A null url,
    or one without ``://``, has an empty host and path.  Repeated rows, null ids, very long urls and further columns are
    fine: each input row gives one output row.  Without rules every url gets the default; an empty table gives no rows.

    A verdict hangs on (host, path) alone, so each distinct pair is looked up once.
    """
    steps = Steps(pages.sparkSession, "url_filter")
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    pages = pages.select("page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = events(rules.select("host").distinct(), reversed_host(F.col("host")), F.col("host"))
    whole = events(rules, F.concat(reversed_host(F.col("host")), "path"), F.struct(F.concat("host", "path").alias("rule"), F.length("host").alias("n_host"), "verdict"))

    lookups = steps.write(pages.select("host", "path").distinct().select("host", "path", reversed_host(F.col("host")).cast("binary").alias("key")))
    rooms = max(1, -(-lookups.count() // max(room, 2 * rules.count())))
    under = sweep(lookups, hosts, rooms, True)
    under = under.select("host", "path", F.concat(reversed_host(F.col("found")), "path").cast("binary").alias("key"))
    found = sweep(under, whole, rooms, False)
    best = steps.write(found.groupBy("host", "path").agg(F.max_by("found", F.struct(F.length("found.rule"), "found.n_host")).alias("top")))
    steps.drop(lookups)
    # The table grows with the urls, though it packs so well that Spark may take it for a small one.
    out = pages.join(best.hint("merge"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
