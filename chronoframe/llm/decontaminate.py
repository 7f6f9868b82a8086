"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

Words are runs of letters and digits, A-Z lower-cased. An item's windows are its runs of WINDOW words (all its words, if
fewer). A window is a set of shingles of SHINGLE words (or of all its words, if fewer) with their offsets; since all of them must
occur, one necessary prefix token is enough: the rarest, by its count over all documents. Each occurrence of a prefix
token in a document proposes a window at (position less offset); it must lie inside the document (length and
positional bounds), and its words must equal the window's one by one: first by their hashes, then byte by byte.

The benchmark is cut into slices of at most MAX_WORDS words (a longer item into parts that overlap by all but one word of a window); a slice's index is
sent to all tasks, so what is broadcast has that bound. One slice is the common case and needs no shuffle. With more slices each document gets the hits of each, as
ranges of words, and they are joined by document.

Defined cases: null or wordless texts have no words and no hits; items without words have no windows; repeated items and
repeated ids count once; a null item_id counts as `null`; documents repeated in all columns are judged each, those that
repeat an id with other texts too; clashing extra columns are passed through by clean and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import textkernel as tk
from chronoframe.llm.common import free_name, small_batches, written

WINDOW = 10
SHINGLE = 5
MAX_WORDS = 200_000

RANGE = pa.struct([("a", pa.int64()), ("b", pa.int64())])
RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
RESULT_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Index:
    """Windows of one slice of the benchmark: words as hashes and bytes, the items that have them, and shingles."""

    def __init__(self, items: list[tuple[str, np.ndarray, list[bytes]]], window: int = WINDOW):
        found: dict[bytes, list] = {}
        spelt: dict[int, bytes] = {}
        for item, hashes, words in items:
            for key, word in zip(hashes.tolist(), words, strict=True):
                if spelt.setdefault(key, word) != word:
                    raise ValueError(f"two words of the benchmark have one hash: {spelt[key]!r}, {word!r}")
            size = min(window, len(hashes))
            for at in range(len(hashes) - size + 1 if size else 0):
                found.setdefault(hashes[at : at + size].tobytes(), []).append(item)
        self.words = np.array(sorted(spelt), np.uint64)
        self.spelt = [spelt[key] for key in sorted(spelt)]
        self.windows = [np.frombuffer(key, np.uint64) for key in found]
        self.items = [sorted(set(names)) for names in found.values()]
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.shingled = [tk.grams(w, min(SHINGLE, len(w))) for w in self.windows]
        self.by_size = {}
        for size in sorted({min(SHINGLE, int(n)) for n in self.sizes}):
            mine = [s for s, n in zip(self.shingled, self.sizes, strict=True) if min(SHINGLE, int(n)) == size]
            self.by_size[size] = np.unique(np.concatenate(mine))

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle; ties by the shingle itself."""
        self.prefix = {}
        for size in self.by_size:
            rows = []
            for at, (shingles, n) in enumerate(zip(self.shingled, self.sizes, strict=True)):
                if min(SHINGLE, int(n)) == size:
                    best = min(range(len(shingles)), key=lambda i: (counts.get((size, int(shingles[i])), 0), int(shingles[i]), i))
                    if counts.get((size, int(shingles[best])), 0):
                        rows.append((int(shingles[best]), at, best))
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            unique, first, many = np.unique(keys, return_index=True, return_counts=True)
            self.prefix[size] = (unique, first, many, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        longest = int(self.sizes.max()) if len(self.sizes) else 0
        self.matrix = np.zeros((len(self.windows), longest), np.uint64)
        for at, words in enumerate(self.windows):
            self.matrix[at, : len(words)] = words

    def _grams(self, tokens: tk.Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles that lie inside one document, and where they begin."""
        hashes = tk.grams(tokens.hash, size)
        inside = np.ones(len(hashes), bool)
        for back in range(1, size):
            borders = tokens.bounds[1:-1] - back
            inside[borders[(borders >= 0) & (borders < len(hashes))]] = False
        return hashes, inside

    def count(self, tokens: tk.Tokens, into: dict[tuple[int, int], int]) -> None:
        for size, keys in self.by_size.items():
            hashes, inside = self._grams(tokens, size)
            at = np.searchsorted(keys, hashes)
            at[at == len(keys)] = 0
            for key, n in zip(*np.unique(hashes[inside & (keys[at] == hashes)], return_counts=True), strict=True):
                into[size, int(key)] = into.get((size, int(key)), 0) + int(n)

    def matches(self, tokens: tk.Tokens, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified (first word, window), every occurrence; data: the texts' bytes."""
        starts, windows = [], []
        for size, (keys, first, many, window, offset) in self.prefix.items():
            if not len(keys):
                continue
            hashes, inside = self._grams(tokens, size)
            at = np.searchsorted(keys, hashes)
            at[at == len(keys)] = 0
            places = np.flatnonzero(inside & (keys[at] == hashes))
            groups = at[places]
            reps = many[groups]
            row = np.repeat(first[groups] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum()) if len(reps) else np.zeros(0, np.int64)
            start, candidate = np.repeat(places, reps) - offset[row], window[row]
            size_of = self.sizes[candidate]
            doc = np.searchsorted(tokens.bounds, np.repeat(places, reps), "right") - 1
            fits = (start >= tokens.bounds[doc]) & (start + size_of <= tokens.bounds[doc + 1])
            start, candidate, size_of = start[fits], candidate[fits], size_of[fits]
            for j in range(self.matrix.shape[1]):
                inner = j < size_of
                word = tokens.hash[np.minimum(start + j, len(tokens.hash) - 1)] if len(tokens.hash) else start.astype(np.uint64)
                equal = ~inner | (word == self.matrix[candidate, j])
                start, candidate, size_of = start[equal], candidate[equal], size_of[equal]
            starts.append(start)
            windows.append(candidate)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._spelt_alike(tokens, data, np.concatenate(starts), np.concatenate(windows))

    def _spelt_alike(self, tokens: tk.Tokens, data: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of matches by hashes those whose words are the same byte by byte; each word of a document is looked at once."""
        sizes = self.sizes[windows]
        change = np.bincount(starts, minlength=len(tokens.hash) + 1) - np.bincount(starts + sizes, minlength=len(tokens.hash) + 1)
        covered = np.flatnonzero(np.cumsum(change[:-1]))
        word = np.searchsorted(self.words, tokens.hash[covered]).tolist()
        begin, end = tokens.start[covered].tolist(), tokens.end[covered].tolist()
        wrong = [p for p, w, a, b in zip(covered.tolist(), word, begin, end, strict=True) if tk.LOWER[data[a:b]].tobytes() != self.spelt[w]]
        if not wrong:
            return starts, windows
        bad = np.zeros(len(tokens.hash) + 1, np.int64)
        bad[np.array(wrong) + 1] = 1
        bad = np.cumsum(bad)
        same = bad[starts + sizes] == bad[starts]
        return starts[same], windows[same]


def _words(column: pa.Array) -> tuple[tk.Tokens, np.ndarray]:
    data, offsets = tk.text_bytes(column)
    return tk.tokenize(data, offsets, tk.WORDS, tk.FOLDED), data


def _slices(benchmark: DataFrame, max_words: int) -> Iterator[Index]:
    """Indexes of slices of at most max_words words, one at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    items, n = [], 0
    for row in rows.toLocalIterator():
        tokens, data = _words(pa.array([row["text"]], pa.string()))
        lower = tk.LOWER[data].tobytes()
        words = [lower[a:b] for a, b in zip(tokens.start.tolist(), tokens.end.tolist(), strict=True)]
        longest = max(max_words, WINDOW)
        for at in range(0, max(1, len(words) - WINDOW + 1), longest - WINDOW + 1):
            part = slice(at, at + longest)
            if items and n + len(words[part]) > max_words:
                yield Index(items)
                items, n = [], 0
            items.append((row["item_id"], tokens.hash[part], words[part]))
            n += len(words[part])
    yield Index(items)


def _counted(docs: DataFrame, index: Index) -> None:
    """Count the slice's shingles over all documents and order its windows by them."""
    fixed = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                fixed.value.count(_words(part.column(0))[0], counts)
        rows = [(size, key - (1 << 64) if key >> 63 else key, n) for (size, key), n in counts.items()]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["size", "shingle", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "size int, shingle long, n long")
    found = found.groupBy("size", "shingle").agg(F.sum("n").alias("n"))  # at most a row for each shingle of the slice
    index.order({(r["size"], r["shingle"] % (1 << 64)): r["n"] for r in found.collect()})


def _union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _summary(n_words: int, ranges: list[tuple[int, int]], items: set[str]) -> tuple:
    hit = sum(b - a for a, b in ranges)
    return n_words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0


NOTHING = hashlib.sha256(b"").hexdigest()


def _per_document(part: pa.Array, index: Index) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Words of each text, and for those with hits the ranges of hit words (from the text's start) and the items."""
    tokens, data = _words(part)
    starts, windows = index.matches(tokens, data)
    found: dict[int, tuple[list, set]] = {}
    if len(starts):
        doc = np.searchsorted(tokens.bounds, starts, "right") - 1
        order = np.argsort(doc, kind="stable")
        starts, windows, doc = starts[order], windows[order], doc[order]
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=doc[-1] + 1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            begin = starts[a:b] - tokens.bounds[doc[a]]
            items = {name for w in np.unique(windows[a:b]) for name in index.items[w]}
            found[int(doc[a])] = (_union(begin, begin + index.sizes[windows[a:b]]), items)
    return np.diff(tokens.bounds), found


def _annotated(docs: DataFrame, index: Index | None, columns: list[str], names: list[str]) -> DataFrame:
    """docs with the result columns, under the given names, for one slice; a map over rows."""
    fixed = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                if fixed.value is None:
                    sizes, found = np.diff(_words(part.column(at))[0].bounds), {}
                else:
                    sizes, found = _per_document(part.column(at), fixed.value)
                out = [_summary(int(n), *found[i]) if i in found else (int(n), 0, 0, NOTHING, False) for i, n in enumerate(sizes)]
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), RESULT, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    types = RESULT_DDL.split(", ")
    ddl = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns] + [f"`{n}` {t.split()[1]}" for n, t in zip(names, types, strict=True)])
    return rows.mapInArrow(run, ddl)


def _by_slices(docs: DataFrame, indexes: Iterator[Index], columns: list[str], names: list[str]) -> DataFrame:
    """The same for several slices: ranges of each slice, written one after the other, joined by the row's content."""
    row = F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    key = F.concat(row, F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))).alias("_key")
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key)
    hits = None
    for index in indexes:
        if not index.windows:
            continue
        _counted(docs, index)
        fixed = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], fixed=fixed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tk.chunks(batch, "text"):
                    _, found = _per_document(part.column(1), fixed.value)
                    rows = [(part.column(2)[i].as_py(), [{"a": a, "b": b} for a, b in ranges], sorted(items)) for i, (ranges, items) in found.items()]
                    c = list(zip(*rows)) or [()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.list_(RANGE)), pa.array(c[2], pa.list_(pa.string()))], ["_key", "ranges", "items"])

        found = keyed.mapInArrow(run, "_key string, ranges array<struct<a:long,b:long>>, items array<string>").dropDuplicates(["_key"])
        found = written(found, "slice-hits")
        fixed.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return _annotated(docs, None, columns, names)
    joined = hits.groupBy("_key").agg(F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # Sorted ranges: each adds what lies beyond the furthest end so far.
    far = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end"))
    hit_words = F.aggregate("ranges", far, add)["n"]
    joined = joined.select("_key", hit_words.alias("_hit"), F.size("items").cast("long").alias("_items"), F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("_sha"))
    own = [free_name([*columns, *names], c) for c in ("_key", "_hit", "_items", "_sha")]
    joined = joined.toDF(*own)
    rows = _annotated(docs, None, columns, names).select("*", key.alias(own[0])).join(joined, own[0], "left")
    n, hit, items, sha, bad = names
    return rows.select(*[F.col(f"`{c}`") for c in columns], n, F.coalesce(own[1], F.lit(0)).alias(hit), F.coalesce(own[2], F.lit(0)).alias(items), F.coalesce(own[3], F.lit(NOTHING)).alias(sha), F.col(own[1]).isNotNull().alias(bad))


def annotate(docs: DataFrame, benchmark: DataFrame, columns: list[str], max_words: int = MAX_WORDS) -> tuple[DataFrame, list[str]]:
    """The given columns of docs (text among them) with n_words, n_hit, n_items, items_sha256, contaminated; and their names,
    which differ from these where docs has such columns."""
    small_batches(docs.sparkSession)
    names = []
    for name in RESULT.names:
        names.append(free_name([*columns, *names], name))
    slices = _slices(benchmark, max_words)
    first, second = next(slices), next(slices, None)
    if second is not None:
        return _by_slices(docs, itertools.chain((first, second), slices), columns, names), names
    if not first.windows:
        return _annotated(docs, None, columns, names), names
    _counted(docs, first)
    return _annotated(docs, first, columns, names), names


def hits(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, names = annotate(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, ["doc_id", "text"], max_words)
    return found.select("doc_id", *names)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    found, names = annotate(docs, benchmark, docs.columns)
    return found.where(~F.col(names[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select coalesce(cast(item_id as varchar), 'null') as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
i as (select item_id, w, least(10, len(w)) as size from b where len(w) > 0),
v as (select distinct item_id, size, array_to_string(w[s : s + size - 1], ' ') as win from (select *, unnest(range(1, cast(len(w) - size + 2 as bigint))) as s from i)),
sizes as (select distinct size from v),
g as (select doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') as win
      from (select doc_id, w, size, unnest(range(1, cast(len(w) - size + 2 as bigint))) as s from d, sizes where len(w) >= size)),
m as (select doc_id, s, g.size, item_id from g join v on g.win = v.win and g.size = v.size),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from m) group by doc_id),
n as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from m group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join n using (doc_id)
"""
