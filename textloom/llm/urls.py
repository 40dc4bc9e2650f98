"""URL filters as a sort-merge range join.

A rule is (host, path, verdict).  It fits its host and all subdomains when the url's path starts
with the rule's.  The canonical key of a host is its labels in reverse, followed by the path, so a
rule is the interval of all keys that start with its own, and the rules of a host are nested or
disjoint.  A url is probed once for each suffix of its host that has as many labels as some rule.

Rules become sorted boundary events: at its start a rule is the innermost one, behind its end its
parent is.  The parent comes from a sweep with one running cell for each nesting depth - the stack
of active rules.  Events and probes are then merged in key order, and each probe takes the rule on
top at its place.  Hosts with many probes are dealt over several sweeps in proportion to their
counts, each with a copy of the host's events, so no host lands in one task.

The longest rule wins, by the length of host and path together, then of the host; a rule given
twice counts once, as a block if its verdicts differ.

Defined cases: a null url or one without ``://`` has an empty host and path and takes the default
verdict; null ids are judged like others; repeated rows are all returned; other columns are
ignored; without rules every url takes the default; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.storage import small

PROBES_PER_SWEEP, SENT_HOSTS = 2000, 200_000


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_events(rules: DataFrame) -> DataFrame:
    """host_key, key, top: the innermost rule from ``key`` on, null in all fields if none."""
    rules = rules.groupBy("host", "path").agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("verdict"))
    itself = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"))
    start = F.encode(F.col("path"), "UTF-8")
    rules = rules.select(reversed_host(F.col("host")).alias("host_key"), start.alias("start"), F.concat(start, F.lit(b"\xff")).alias("end"), itself.alias("own"))
    sides = F.array(F.struct(F.col("start").alias("key"), F.lit(1).alias("step")), F.struct(F.col("end").alias("key"), F.lit(-1).alias("step")))
    events = rules.select("host_key", "own", F.inline(sides))
    depth = F.sum("step").over(Window.partitionBy("host_key").orderBy("key"))
    # of the rule itself, for either side
    events = events.withColumn("depth", F.when(F.col("step") == 1, depth).otherwise(depth + 1))
    # each start also stands as a possible parent among the rules one deeper
    levels = F.when(F.col("step") == 1, F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("above")), F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("above")))).otherwise(F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("above"))))
    events = events.select("host_key", "own", "key", "step", F.inline(levels))
    cell = F.last(F.when(F.col("above"), F.col("own")), ignorenulls=True).over(Window.partitionBy("host_key", "level").orderBy("key", "above").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    events = events.withColumn("parent", F.when(F.col("level") > 1, cell)).where(~F.col("above"))
    # a rule's end restores its parent
    top = F.when(F.col("step") == 1, F.col("own")).otherwise(F.col("parent"))
    return events.select("host_key", "key", F.struct(*[top[f].alias(f) for f in ("size", "host_size", "rule", "verdict")]).alias("top"))


def _few(hosts: DataFrame) -> DataFrame:
    """Rows of one rule host each, sent whole if they are few, so that a host's probes stay where they are."""
    return F.broadcast(hosts) if hosts.count() <= SENT_HOSTS else hosts


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``id_column``, host, path, rule, verdict for all ``pages`` by ``rules`` (host, path, verdict)."""
    events = rule_events(rules.select("host", "path", "verdict").where("host <> '' and path is not null and verdict is not null"))
    pages = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"))
    pages = pages.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pages = pages.groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    longest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("n")).first()["n"]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, longest)))), lambda n: F.array_join(F.reverse(F.slice(labels, F.size(labels) - n + 1, n)), "."))
    probes = pages.where("host <> ''").select("id", "host", "path", F.explode(suffixes).alias("host_key"))
    hosts = events.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_events"))
    hosts = _few(small(hosts))
    probes = probes.join(hosts.select("host_key"), "host_key", "left_semi")
    # sweeps for each host: as many probes in each, and never fewer than the events they carry
    counts = probes.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_probes")).join(hosts, "host_key")
    sweeps = _few(small(counts.select("host_key", F.ceil(F.col("n_probes") / F.greatest(F.lit(PROBES_PER_SWEEP), F.col("n_events"))).cast("int").alias("sweeps"))))
    deal = F.pmod(F.xxhash64("id", "host", "path"), F.col("sweeps")).cast("int")
    no_top = F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    merged = probes.join(sweeps, "host_key").select("host_key", deal.alias("sweep"), F.encode(F.col("path"), "UTF-8").alias("key"), F.lit(True).alias("probe"), no_top.alias("top"), "id", "host", "path")
    carried = events.join(sweeps, "host_key").select("host_key", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("sweep"), "key", F.lit(False).alias("probe"), "top")
    merged = merged.unionByName(carried, allowMissingColumns=True)
    on_top = F.last("top", ignorenulls=True).over(Window.partitionBy("host_key", "sweep").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = merged.withColumn("top", on_top).where("probe and top.rule is not null").select("id", "host", "path", "top", F.lit(0).cast("long").alias("copies"))
    judged = pages.select("id", "host", "path", no_top.alias("top"), "copies").unionByName(found).groupBy("id", "host", "path").agg(F.max("top").alias("top"), F.sum("copies").alias("copies"))
    rows = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("id").alias(id_column), "host", "path", F.col("top.rule").alias("rule"), F.coalesce(F.col("top.verdict"), F.lit(default)).alias("verdict"))
