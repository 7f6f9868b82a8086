"""Exact deduplication by deterministic block naming, in DataFrame functions only.

A text without its white space is cut into blocks of BLOCK code points. The distinct blocks are sorted and get integer
names; then the names of adjacent blocks are paired, the distinct pairs sorted and named, and so on until each
document has one name. Two documents have the same (level, name) if and only if their normalised texts are equal.

Names are spread through a fingerprint of the block, so that texts are shuffled once, after map-side distinct; that
fingerprints tell all distinct blocks apart is checked, and if they do not, the blocks themselves are the join key.
A hot text costs one row for each map task in the naming, and the joins that give names back have a plain shuffled
side, which adaptive execution can split.

Defined cases: a null text counts as empty, empty texts form one group; of rows that agree in text length and doc_id
one stays; a null doc_id sorts first; other columns are ignored here and kept by keep_one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import free_name, written

BLOCK = 8192
SPACE = r"[\x20\x09-\x0D]+"


def normalised(column):
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), SPACE, "")


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block: row id, doc_id, n_chars, digest, n (blocks of its text), pos, block."""
    text = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id"),
        F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_chars"),
        normalised(F.col("text")).alias("norm"),
    )
    cut = F.when(F.length("norm") <= BLOCK, F.array("norm")).otherwise(
        F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    )
    parts = text.select("rid", "doc_id", "n_chars", F.sha2(F.encode("norm", "UTF-8"), 256).alias("digest"), cut.alias("parts"))
    return parts.select(
        "rid", "doc_id", "n_chars", "digest", F.size("parts").cast("long").alias("n"), F.posexplode("parts").alias("pos", "block")
    )


def _print(block):
    return F.sha2(F.encode(block, "UTF-8"), 256)


def _named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys, sorted within their partitions, with integer names in that order."""
    distinct = keys.select(*columns).distinct().sortWithinPartitions(*columns)
    return distinct.withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame) -> DataFrame:
    """Per row of docs: rid, doc_id, n_chars, digest, level, name; the last two are equal for equal texts alone."""
    blocks = _blocks(docs)
    names = written(_named(blocks, ["block"]).select(_print(F.col("block")).alias("mark"), "name"), "block-names")
    if names.groupBy("mark").count().where("count > 1").limit(1).count():
        names, key = written(_named(blocks, ["block"]), "block-names"), "block"
    else:
        blocks, key = blocks.select("*", _print(F.col("block")).alias("mark")).drop("block"), "mark"
    rows = written(
        blocks.join(names, key).select("rid", "doc_id", "n_chars", "digest", "n", F.col("pos").cast("long").alias("pos"), "name"),
        "named-blocks",
    )
    keep = ["rid", "doc_id", "n_chars", "digest"]
    done = rows.where("n = 1").select(*keep, F.lit(0).alias("level"), "name")
    longest = rows.agg(F.max("n")).first()[0] or 1
    rows, level = rows.where("n > 1"), 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = rows.groupBy("rid", "doc_id", "n_chars", "digest", "n", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
        )
        pairs = written(pairs.withColumn("n", F.ceil(F.col("n") / 2)), "block-pairs")
        rows = written(pairs.join(_named(pairs, ["left", "right"]), ["left", "right"]).drop("left", "right"), "named-pairs")
        done = done.unionByName(rows.where("n = 1").select(*keep, F.lit(level).alias("level"), "name"))
        rows = rows.where("n > 1")
    return done


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the row with the most code points, then the smallest doc_id, stays.
    """
    rows = identities(docs)
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id"), F.col("rid"))).alias("best")
    groups = written(rows.groupBy("level", "name").agg(best, F.count(F.lit(1)).alias("group_size")), "copy-groups")
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.rid") == F.col("rid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "n_chars",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of wholly repeated rows one stays."""
    kept = written(exact_groups(docs).where("kept").select("doc_id", "n_chars", "text_sha256", "group_size"), "kept-copies")
    mark, length, key_id, key_length, key_mark = (free_name(docs.columns, n) for n in ("mark", "length", "key_id", "key_length", "key_mark"))
    keyed = docs.select(
        "*",
        F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias(mark),
        F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias(length),
    )

    def chosen(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(key_id), F.col("n_chars").alias(key_length), F.col("text_sha256").alias(key_mark))
        same = F.col("doc_id").eqNullSafe(F.col(key_id)) & (F.col(length) == F.col(key_length)) & (F.col(mark) == F.col(key_mark))
        return keyed.join(keys, same, "left_semi")

    # A row that has no copies cannot be repeated; only the others need their repeated rows told apart.
    alone = chosen(kept.where("group_size = 1"))
    copied = chosen(kept.where("group_size > 1")).dropDuplicates(["doc_id", mark])
    return alone.unionByName(copied).select(*docs.columns)


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
e as (select doc_id, length(t) as n, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as s from d)
select doc_id, cast(first_value(doc_id) over w as bigint) as keep_id,
       cast(count(*) over (partition by s) as bigint) as group_size,
       first_value(doc_id) over w = doc_id as kept, s as text_sha256
from e window w as (partition by s order by n desc, doc_id)
"""
