"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target divided by its size is the number of copies expected of each of its documents. The documents of a
source stand in one order (class of size, then md5 of id and text, then a hash of the whole row), expected copies are prefix-summed
along it, one random offset is added, and a document is emitted once for each integer that its step crosses. Rows that tie in
all of that are equal, so it does not matter which of them comes first.

The rank in that order comes from two levels: counts of (source, class of size, first hex digits of the md5), prefix-
summed per source over a bounded number of such buckets, and a row number within the bucket; so no task sees a
whole source. Nothing depends on how rows are partitioned, and reruns agree.

Defined cases: a null text has size 0, a null id or text counts as empty in the order, a null source is a source of its
own and the last; with all sizes 0 every target is 0; repeated rows and rows of one id are documents of their own, dealt by
their texts; rows equal in id and text are one bucket's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
SEED = "mix"
BUCKET_DIGITS = 2


def word_count(column):
    return F.regexp_count(F.coalesce(column.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _size_class(size):
    """Exact below 16, then eight classes to each doubling; the slack keeps powers of two where they belong."""
    return F.when(size < 16, size).otherwise(F.floor(F.log2(size.cast("double")) * 8.0 + 1e-9)).cast("long")


def place(id_column, text):
    """Where a document stands among those of its class of size."""
    both = F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.md5(F.encode(both, "UTF-8"))


def _row_hash(docs: DataFrame):
    """A hash of all columns that Spark can hash."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size -> the same with target: weight times one common level, cut at ceiling times the size.

    Sources sorted by the level at which they reach their ceiling: the first k stay at it, and the rest share what is
    left by weight; the level is that of the first k at which the next source would not reach its ceiling.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    at = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(ceiling)).alias("most"),
    )
    ranked = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * F.lit(share)
    rows = rows.select("*", ((wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"))
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level"))))
    rows = rows.select("*", free.over(everything)["level"].alias("final"))
    full = F.col("final").isNull() | (F.col("most") <= F.col("final") * F.col("weight"))
    return rows.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def offset(source, seed: str = SEED):
    """A multiple of 1/4096 (plus a half step) below 1 for each source."""
    digest = F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("null"))), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") + 0.5) / 4096.0


def with_copies(docs: DataFrame | None, id_column: str = "doc_id", sized: DataFrame | None = None) -> DataFrame:
    """All columns of docs (of sized its id) in the struct `row`, with size, source_size, target and copies.

    docs is read twice, for the counts and for the rows; sized (source, size, place, id) may stand in for both readings.
    """
    if sized is not None:
        rows = sized.select(F.struct(id_column).alias("row"), F.lit(0).alias("tie"), F.col("source").cast("string").alias("source"), "size", "place")
    else:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        size, at = word_count(F.col("text")).alias("size"), place(F.col(id_column), F.col("text")).alias("place")
        rows = docs.select(whole, _row_hash(docs).alias("tie"), F.col("source").cast("string").alias("source"), size, at)
    sized = rows.select("source", "size", "place")
    bucket = [_size_class(F.col("size")).alias("class"), F.substring("place", 1, BUCKET_DIGITS).alias("digits")]
    counts = sized.select("source", "size", *bucket).groupBy("source", "class", "digits").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    )
    sources = targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")))
    along = Window.partitionBy("source").orderBy("class", "digits").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "class", "digits", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("ahead"))
    steps = starts.alias("b").join(sources.alias("s"), F.expr("b.source <=> s.source")).select(
        F.col("b.source").alias("_source"), F.col("class").alias("_class"), F.col("digits").alias("_digits"), "ahead", "source_size", "target"
    )
    rows = rows.select("*", *bucket)
    within = Window.partitionBy("source", "class", "digits").orderBy("place", "tie")
    rows = rows.withColumn("nth", F.row_number().over(within))
    found = rows.join(steps, F.expr("source <=> _source and class = _class and digits = _digits"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, shift = F.col("ahead") + F.col("nth"), offset(F.col("source"))
    copies = F.floor(rate * rank + shift) - F.floor(rate * (rank - 1) + shift)
    # A rate is at most the ceiling, so a step crosses no more integers than that; this only keeps rounding from adding one.
    return found.select("row", "size", "source_size", "target", F.least(copies, F.lit(int(CEILING))).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows: each row of docs as often as it is drawn, with the columns of docs."""
    drawn = with_copies(docs).where("copies > 0")
    drawn = drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    return drawn.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                  md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as place from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source is null, source) - 1) % 3]::double as weight from s),
r as (select *, source_size * 2.0::double as most, row_number() over (order by source_size * 2.0::double / weight, source is null, source) as nth from w),
l as (select *, ((sum(source_size) over () * 1.5::double) - coalesce(sum(most) over (order by nth rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by nth rows between current row and unbounded following) as level from r),
f as (select min_by(level, nth) filter (where level * weight <= most) as final from l),
t as (select source, source_size, case when final is null or most <= final * weight then most else final * weight end as target from l, f),
o as (select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
             row_number() over (partition by d.source order by case when size < 16 then size else cast(floor(log2(cast(size as double)) * 8 + 1e-9::double) as bigint) end, place) as rank,
             (instr('0123456789abcdef', substr(md5('mix:' || coalesce(d.source, 'null')), 1, 1)) * 256 - 256
              + instr('0123456789abcdef', substr(md5('mix:' || coalesce(d.source, 'null')), 2, 1)) * 16 - 16
              + instr('0123456789abcdef', substr(md5('mix:' || coalesce(d.source, 'null')), 3, 1)) - 1 + 0.5::double) / 4096 as u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(size * least(2, floor(rate * rank + u) - floor(rate * (rank - 1) + u)) as bigint) as taken from o
"""
