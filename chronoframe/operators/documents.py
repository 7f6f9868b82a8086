"""Documents with marks: lint, expansion of time marks, tags, digests of trees, event payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.scalars import half_up
from chronoframe.operators.montage import digest
from chronoframe.operators.placement import moment, output_at, span_label

# Fixed value: the grammar of a time mark.
MARK = r"\[\[(?:t=\d+(?:\.\d+)?|r=\d+(?:\.\d+)?-\d+(?:\.\d+)?)\]\]"


def lines(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    return texts.select(*keys, F.posexplode(F.split(F.col(column), "\n", -1)).alias("n", "line")).withColumn("n", F.col("n").cast("long") + 1)


def lint(rows: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Lines (keys, n, line) that break a rule (a pattern by code): keys, code, hits, first line."""
    codes = F.filter(F.array(*[F.when(F.col("line").rlike(pattern), F.lit(code)) for code, pattern in rules.items()]), lambda x: x.isNotNull())
    found = rows.select(*keys, "n", F.explode(codes).alias("code"))
    return found.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("hits"), F.min("n").alias("first"))


def expand_marks(rows: DataFrame, placed: DataFrame, speed: float) -> DataFrame:
    """Lines (job, n, line) with their time marks replaced by labels in source and output time, this one to the microsecond before it is truncated."""
    marks = rows.select("job", "n", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(MARK), F.lit(0)))).alias("mark"))
    value = lambda k: F.regexp_extract("mark", r"=(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?\]", k)
    marks = marks.withColumns({"a": value(1).cast("double"), "b": F.nullif(value(2), F.lit("")).try_cast("double")})
    times = marks.select("job", F.col("a").alias("t")).unionByName(marks.where("b is not null").select("job", F.col("b").alias("t"))).distinct()
    out = output_at(times, placed, speed).withColumn("out", half_up(F.col("out"), 6))
    found = marks.hint("merge").join(out.select("job", F.col("t").alias("a"), F.col("out").alias("first")), ["job", "a"])
    found = found.hint("merge").join(out.select("job", F.col("t").alias("b"), F.col("out").alias("last")), ["job", "b"], "left")
    label = F.when(F.col("b").isNull(), moment(F.col("a"), F.col("first"))).otherwise(span_label(F.col("a"), F.col("b"), F.col("first"), F.col("last")))
    labels = found.groupBy("job", "n").agg(F.collect_list(F.struct("mark", label.alias("label"))).alias("labels"))
    both = rows.hint("merge").join(labels, ["job", "n"], "left")
    text = F.aggregate(F.coalesce("labels", F.array().cast("array<struct<mark:string,label:string>>")), F.col("line"), lambda t, m: F.replace(t, m["mark"], m["label"]))
    return both.select("job", "n", text.alias("line"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>", "")


def tree_digest(files: DataFrame, keys: list[str]) -> DataFrame:
    """One digest for all files (keys, name, content) of a tree, level by level: of 65,536 parts of its sorted files, of 256 parts of these, of all."""
    each = files.select(*keys, F.concat(F.col("name").cast("string"), F.lit(":"), digest(F.col("content"))).alias("entry"))
    parts = each.withColumn("part", F.substring(F.md5(F.encode("entry", "UTF-8")), 1, 4)).groupBy(*keys, "part")
    parts = parts.agg(digest(F.array_join(F.array_sort(F.collect_list("entry")), "\n")).alias("d"), F.count(F.lit(1)).alias("n"))
    for size in (2, 0):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"])
        parts = parts.groupBy(*keys, F.substring("part", 1, size).alias("up")).agg(digest(F.array_join(listed, "\n")).alias("d"), F.sum("n").alias("n")).withColumnRenamed("up", "part")
    return parts.select(*keys, F.col("d").alias("digest"), F.col("n").alias("files"))
