"""URL filters as a sort-merge range join: nested prefix intervals swept with a stack.

A host is keyed by its labels in reverse order, each followed by a dot, so that a rule's host covers itself and its
subdomains as one interval of keys, and intervals nest or are disjoint. URLs sorted by key are swept once; a
stack holds the rules whose intervals are open. Of these, those whose path begins the URL's path fit, and the longest
(host and path together; then the longer host; then block before allow) decides. No rule: the default verdict.

Up to MAX_LOCAL_RULES rules are sent to every task, which sorts its URLs and sweeps both sides once: no shuffle. More rules are
range-joined: splitters cut the key space (key, path, digest of the id, so a hot host or URL is cut as well), a rule goes
to every range that its interval meets, and each range is sorted and swept as a stream.

Defined cases: a URL that is null or has no `://` has an empty host and path; an empty host in a rule covers all hosts; other
columns of the pages are ignored; repeated rows are judged each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import free_name, small_batches

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MAX_LOCAL_RULES = 100_000
SAMPLE_FOR_SPLITTERS = 20_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


class Rules:
    """Rules by host key, in the order of their intervals' starts."""

    def __init__(self, rules):
        by_key: dict[str, dict[str, tuple]] = {}
        for host, path, verdict in rules:
            mine = by_key.setdefault(host_key(host), {})
            if path not in mine or verdict == "block":
                mine[path] = (len(host) + len(path), len(host), host + path, verdict)
        self.keys = sorted(by_key)
        self.paths = [by_key[key] for key in self.keys]
        self.lengths = [sorted({len(p) for p in paths}, reverse=True) for paths in self.paths]


class Sweep:
    """Takes keys in ascending order; knows the rules open at the last one."""

    def __init__(self, rules: Rules):
        self.rules, self.at, self.stack = rules, 0, []

    def open_at(self, key: str) -> list[int]:
        keys, stack = self.rules.keys, self.stack
        while self.at < len(keys) and keys[self.at] <= key:
            while stack and not keys[self.at].startswith(keys[stack[-1]]):
                stack.pop()
            stack.append(self.at)
            self.at += 1
        while stack and not key.startswith(keys[stack[-1]]):
            stack.pop()
        return stack

    def judge(self, key: str, path: str) -> tuple | None:
        best = None
        for at in self.open_at(key):
            for length in self.rules.lengths[at]:
                found = self.rules.paths[at].get(path[:length]) if length <= len(path) else None
                if found:
                    if best is None or found[:2] > best[:2]:
                        best = found
                    break
        return best


OUT = "host string, path string, rule string, verdict string"


def _key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id", default: str = "allow") -> DataFrame:
    """pages (id, url) -> id, host, path, rule, verdict. rules: a list of (host, path, verdict), or a DataFrame of them."""
    spark = pages.sparkSession
    small_batches(spark)
    urls = pages.select(F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").dropDuplicates()
        if rules.limit(MAX_LOCAL_RULES + 1).count() > MAX_LOCAL_RULES:
            return _ranged(urls, rules, id_column, default)
        rules = [tuple(r) for r in rules.collect()]
    fixed = spark.sparkContext.broadcast(Rules(rules))
    key = free_name(urls.columns, "key")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep(fixed.value)
        for batch in batches:
            found = [state.judge(k, path) for k, path in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            names = pa.array([f and f[2] for f in found], pa.string())
            says = pa.array([f[3] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], names, says], [*batch.schema.names[:3], "rule", "verdict"])

    kind = urls.schema[id_column].dataType.simpleString()
    return urls.withColumn(key, _key(F.col("host"))).sortWithinPartitions(key).mapInArrow(sweep, f"`{id_column}` {kind}, {OUT}")


def _ranged(urls: DataFrame, rules: DataFrame, id_column: str, default: str) -> DataFrame:
    """The same for any number of rules."""
    spark = urls.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = _key(F.col("host"))
    digest = F.md5(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8"))
    urls = urls.select("*", key.alias("key"), F.concat(key, F.col("path"), F.lit("\0"), digest).alias("place"))
    seen = urls.select("place").orderBy(F.xxhash64("place")).limit(SAMPLE_FOR_SPLITTERS)
    places = sorted(r[0] for r in seen.collect())
    cuts = sorted({places[len(places) * i // n] for i in range(1, n)}) if places else []

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return place.map(lambda x: bisect_right(cuts, x)).astype("int32")

    bounded = rules.select(key.alias("key"), F.col("host"), F.col("path"), F.col("verdict"))
    # A key ends in a dot and the sign after the dot is the slash: all that begins with the key is below that.
    after = F.when(F.col("key") == "", F.lit("\U0010ffff")).otherwise(F.expr("concat(substring(key, 1, length(key) - 1), '/')"))
    sent = bounded.select("*", F.explode(F.sequence(range_of("key"), range_of(after))).alias("range"))
    kind = urls.schema[id_column].dataType.simpleString()
    empty = F.lit(None).cast(kind).alias(id_column)
    both = sent.select("range", "key", "path", F.lit(0).alias("is_url"), "host", "verdict", empty).unionByName(
        urls.select(range_of("place").alias("range"), "key", "path", F.lit(1).alias("is_url"), "host", F.lit(None).cast("string").alias("verdict"), id_column)
    )
    dealt = both.repartition(n, "range").sortWithinPartitions("range", "key", "is_url", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, Sweep]] = []
        now = None
        pending: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["range"] != now:
                    now, stack, pending = row["range"], [], []
                if pending and (row["is_url"] or row["key"] != pending_key):
                    stack.append((pending_key, Rules(pending)))
                    pending = []
                while stack and not row["key"].startswith(stack[-1][0]):
                    stack.pop()
                if not row["is_url"]:
                    pending_key = row["key"]
                    pending.append((row["host"], row["path"], row["verdict"]))
                    continue
                best = None
                for _, open_rules in stack:
                    for length in open_rules.lengths[0]:
                        found = open_rules.paths[0].get(row["path"][:length]) if length <= len(row["path"]) else None
                        if found:
                            best = found if best is None or found[:2] > best[:2] else best
                            break
                out.append((row[id_column], row["host"], row["path"], best and best[2], best[3] if best else default))
            columns = list(zip(*out)) or [()] * 5
            ids = batch.schema.field(id_column).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], ids), *(pa.array(c, pa.string()) for c in columns[1:])], [id_column, "host", "path", "rule", "verdict"]
            )

    return dealt.mapInArrow(sweep, f"`{id_column}` {kind}, {OUT}")


ORACLE = r"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
r as (select *, case when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
                     when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
                     when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
                     when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
                     when (host = 'org' or host like '%.org') and path like '/%' then 'org/' end as rule from u)
select page_id, host, path, rule,
       case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict from r
"""
