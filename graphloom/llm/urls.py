"""Operator 6, URL filters: rules as key intervals, joined to URLs by one sorted sweep.

The key of a URL is its host's labels in reverse order, each followed by a comma, then path and query:
``https://blog.site.org:443/a?b#c`` has ``org,site,blog,/a?b``.  A rule for a domain is the prefix ``org,site,``, which
all its hosts share; a rule with a path is the prefix ``org,site,/a``.  A prefix is an interval of keys, and two such
intervals are nested or apart, so the rules that hold at a point of the sorted order form a stack.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import pick

#: (rule_id, pattern, action).  The longest rule that covers a URL decides; of equal ones that of the highest id.
DEFAULT_RULES: tuple[tuple[int, str, str], ...] = (
    (1, "cheap-pills.example.com", "block"),
    (2, "spam-farm.example.org", "block"),
    (3, "adult-x.example.net", "block"),
    (4, "casino-win.example.org", "block"),
    (5, "free-bets.example.com", "block"),
    (6, "spam-farm.example.org/en/", "allow"),
    (7, "spam-farm.example.org/en/9", "block"),
    (8, "www.casino-win.example.org", "allow"),
    (9, "www.casino-win.example.org/fr/", "block"),
    (10, "example.net", "allow"),
    (11, "tionsh.example.net/de/", "block"),
    (12, "tionsh.example.net/de/4", "allow"),
    (13, "m.example.com", "block"),
)
_LAST = "\U0010ffff"
#: Keys looked at for each range to set the borders; the borders only say how even the ranges are.
KEYS_PER_RANGE = 50


def url_key(url: Column) -> Column:
    """The key of a URL; NULL for a NULL URL and for one without a host.  The scheme may be missing."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//", ""), r"(?s)#.*$", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","), path))


def rule_prefix(pattern: Column) -> Column:
    """The prefix of keys that a rule covers: a domain with all its hosts, or, with a path, a part of one host."""
    key = url_key(pattern)
    bare = F.regexp_replace(F.trim(pattern), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//", "")
    return F.when(bare.rlike("[/?]"), key).otherwise(F.regexp_replace(key, "/$", ""))


def _borders(keys: DataFrame, ranges: int) -> list[str]:
    some = sorted(r.key for r in keys.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(ranges * KEYS_PER_RANGE).collect())
    return sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []


def _dealt(spark: SparkSession, ranges: int) -> list[int]:
    """For each range a number that Spark deals to the task of the range's number, so that each task gets one range."""
    found: dict[int, int] = {}
    size = 16 * ranges
    while len(found) < ranges:
        rows = spark.range(size).select(F.pmod(F.hash("id"), F.lit(ranges)).alias("task"), "id").groupBy("task").agg(F.min("id").alias("id")).collect()
        found = {r.task: r.id for r in rows}
        size *= 4
    return [found[k] for k in range(ranges)]


def _ranged_urls(borders: list[str], dealt: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = pa.array([dealt[bisect_right(borders, k)] for k in b.column("key").to_pylist()], pa.int64())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([part, b.column("key"), pa.array([1] * n, pa.int32()), b.column("page_id"), pa.nulls(n, pa.string())], ["part", "key", "kind", "id", "action"])

    return run


def _ranged_rules(borders: list[str], dealt: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                first, last = bisect_right(borders, r["prefix"]), bisect_right(borders, r["prefix"] + _LAST)
                rows += [(dealt[p], r["prefix"], 0, r["rule_id"], r["action"]) for p in range(first, last + 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["part", "key", "kind", "id", "action"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, int, str]] = []
    at = None
    for b in batches:
        found: list[tuple[int, int, str, int]] = []
        for part, key, kind, ident, action in zip(*(b.column(c).to_pylist() for c in ("part", "key", "kind", "id", "action")), strict=True):
            if part != at:
                at = part
                stack.clear()
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, ident, action))
            elif stack:
                found.append((ident, stack[-1][1], stack[-1][2], len(stack)))
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "rule_id", "action", "n_rules"])


def url_decisions(pages: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(page_id, rule_id, action, n_rules)`` for each page that a rule covers: the deciding rule, and how many cover it.

    ``pages`` has ``(page_id, url)``, ``rules`` has ``(rule_id, pattern, action)``.  Neither side is broadcast: keys
    are cut into ``ranges`` of like size, each rule goes to every range that its interval touches, and each range is
    sorted and swept once.

    Pages with a NULL id, and URLs that are NULL or have no host, are not listed; rules with a NULL id, pattern or
    action are void.  Repeated rows are swept as often as they come; a repeated rule counts each time.  Of equal prefixes
    the highest id decides.  A very long URL is one key; a URL that very many pages have stays in one range, as a sorted
    stream.
    """
    keys = pick(pages, page_id="page_id", url="url").filter("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), url_key(F.col("url")).alias("key")).filter("key IS NOT NULL")
    lines = (
        pick(rules, rule_id="rule_id", pattern="pattern", action="action").filter("rule_id IS NOT NULL AND action IS NOT NULL")
        .select(F.col("rule_id").cast("long").alias("rule_id"), rule_prefix(F.col("pattern")).alias("prefix"), "action").filter("prefix IS NOT NULL")
    )
    ranges = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(keys, ranges)
    dealt = _dealt(pages.sparkSession, ranges)
    schema = "part long, key string, kind int, id long, action string"
    both = keys.mapInArrow(_ranged_urls(borders, dealt), schema).unionByName(lines.mapInArrow(_ranged_rules(borders, dealt), schema))
    # Equal keys: rules before URLs, a longer prefix never comes before a shorter one, equal ones by id.
    swept = both.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind", "id")
    return swept.mapInArrow(_sweep, "page_id long, rule_id long, action string, n_rules int")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_RULES), "rule_id long, pattern string, action string")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_decisions(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_rules(spark))


def _sql_key(column: str) -> str:
    rest = rf"regexp_replace(regexp_replace(trim({column}), '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//', ''), '#.*$', '', 's')"
    authority = f"regexp_extract({rest}, '^([^/?]*)', 1)"
    host = rf"lower(regexp_replace(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''))"
    path = f"regexp_replace({rest}, '^[^/?]*', '')"
    return (
        f"CASE WHEN {host} <> '' THEN array_to_string(list_reverse(string_split({host}, '.')), ',') || ',' || "
        f"CASE WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END END"
    )


OP6_SQL = f"""
WITH listed(rule_id, pattern, action) AS (VALUES {", ".join(f"({i}, '{p}', '{a}')" for i, p, a in DEFAULT_RULES)}),
rules AS (SELECT rule_id, action, CASE WHEN contains(pattern, '/') THEN {_sql_key("pattern")}
                                       ELSE regexp_replace({_sql_key("pattern")}, '/$', '') END AS prefix FROM listed),
keys AS (SELECT page_id, {_sql_key("url")} AS key FROM pages),
pairs AS (SELECT page_id, rule_id, action,
                 ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, rule_id DESC) AS place,
                 CAST(COUNT(*) OVER (PARTITION BY page_id) AS INTEGER) AS n_rules
          FROM keys JOIN rules ON starts_with(key, prefix))
SELECT page_id, CAST(rule_id AS BIGINT) AS rule_id, action, n_rules FROM pairs WHERE place = 1
"""
