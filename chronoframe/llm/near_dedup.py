"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are runs of letters and digits, A-Z lower-cased; a k-mer is SHINGLE consecutive words (a shorter text is one k-mer),
labelled with how often it occurred before in its text. For each of BANDS hash functions the MINIMA smallest labelled k-mers
are taken and kept in the order of the text; their combined hash is a bucket. Texts that share most of their k-mers in the
same order meet in some bucket; a pair at the threshold is missed by all buckets with a chance of about 6 in 100,000 for long
texts and 2 in 10,000 for the shortest that are sketched. A text of up to SHORT k-mers, and any that can be similar to one, is in the
buckets of its smallest k-mers, as many as it takes for a similar text to hold one of them among its own; so none of these is missed.

Similarity is that of aligned k-mers: shared / (all of both - shared), where shared is the most k-mers that both texts hold in one
order, found inside the band of diagonals that the threshold allows. The multiset of k-mers bounds it from above and spares the
alignment of most wrong candidates. Its memory is linear in the lengths; words are compared by 32 bits of their hashes, so that two
different words of a pair count as equal once in four thousand million.

Texts of equal words are one representative first. In each bucket all are held against the bucket's first member; classes
are the connected components of verified pairs. Then, until no untried pair or no new link is left, where classes meet in a
bucket two members of each are held against two of the bucket's first class and against the next by length. These rounds only
join most of what belongs together cheaply. Texts of buckets in which several classes are left are then joined exactly: k-mers
are ordered from rare to frequent, and two texts at the threshold share one of their first k-mers, at a place that
leaves enough k-mers behind it. All such pairs of different classes are tried, so no pair of a bucket is lost; tests hold the classes
against brute force.

Defined cases: null, empty and wordless texts are one class; repeated rows are members of their own; of a class the row with
the most words, then the smallest doc_id stays; other columns are ignored here and kept by keep_one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm import textkernel as tk
from chronoframe.llm.common import free_name, sized, small_batches, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
MINIMA = 6
SHORT = 30
PAIRS_A_TASK = 256
#: Matching places for each k-mer from which an alignment goes by rows of bits.
MANY_MATCHES = 16
#: Texts whose k-mers are counted, and counted k-mers that are kept, for the order from rare to frequent; any order gives the same pairs.
COUNTED_TEXTS, FREQUENT = 100_000, 1 << 17

_rng = np.random.default_rng(4242)
_SEEDS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_ODDS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _kmers(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers of each text, and per text where they begin. A text of fewer words has one k-mer."""
    n = np.diff(bounds)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begins = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(begins[-1], np.uint64)
    whole = tk.grams(hashes, SHINGLE)
    long = n >= SHINGLE
    doc = np.repeat(np.arange(len(n)), counts)
    at = np.arange(begins[-1]) - begins[doc] + bounds[doc]
    mine = long[doc]
    out[mine] = whole[at[mine]]
    for d in np.flatnonzero((n > 0) & ~long):
        out[begins[d]] = tk.grams(hashes[bounds[d] : bounds[d + 1]], int(n[d]))[0]
    return out, begins


def _labelled(kmers: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """K-mers with the number of equal ones before them in their text."""
    doc = np.repeat(np.arange(len(begins) - 1, dtype=np.uint64), np.diff(begins))
    key = tk.mix(kmers + doc * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(key) else np.zeros(0, np.int64)
    nth = np.zeros(len(key), np.uint64)
    nth[order] = (np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))).astype(np.uint64)
    return tk.mix(kmers + nth * np.uint64(0xD1B54A32D192ED03))


def _prefix(n, share: float):
    """How many of n ordered k-mers must hold one in common with a text that shares that share of them."""
    return n - np.ceil(share * n - 1e-6).astype(np.int64) + 1


def sketch(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts, as int64, one text after another; and how many each text has, none if without words."""
    kmers, begins = _kmers(hashes, bounds)
    labelled = _labelled(kmers, begins)
    n = np.diff(begins)
    doc = np.repeat(np.arange(len(n)), n)
    chance = np.minimum(1.0, (MINIMA + 18) / np.maximum(n, 1))
    limit = np.where(chance >= 1, np.uint64((1 << 64) - 1), (chance * 2.0**63).astype(np.uint64) * np.uint64(2))[doc] if len(doc) else np.zeros(0, np.uint64)
    wanted = np.where(n > SHORT, MINIMA, 0)
    full = np.flatnonzero(wanted)
    bands = np.zeros((len(full), BANDS), np.int64)
    sketched = (n > SHORT)[doc]
    place = np.tile(np.arange(MINIMA), len(full))
    for band in range(BANDS) if len(full) else ():
        value = (labelled ^ _SEEDS[band]) * _ODDS[band]
        near = np.flatnonzero((value <= limit) & sketched)
        short = np.flatnonzero(np.bincount(doc[near], minlength=len(n)) < wanted)
        for d in short:  # too few below the limit: all of this text
            near = np.union1d(near, np.arange(begins[d], begins[d + 1]))
        owner = doc[near]
        order = np.lexsort((value[near], owner))
        rank = np.arange(len(near)) - np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n)))))[owner[order]]
        chosen = np.sort(near[order[rank < MINIMA]])
        parts = labelled[chosen] * _PLACES[place]
        bands[:, band] = tk.mix(parts.reshape(-1, MINIMA).sum(axis=1, dtype=np.uint64) + _SEEDS[band]).view(np.int64)
    few = np.flatnonzero((n <= SHORT / SIMILARITY)[doc])
    order = few[np.lexsort((labelled[few], doc[few]))]
    counts = np.bincount(doc[few], minlength=len(n))
    rank = np.arange(len(few)) - (np.cumsum(counts) - counts)[doc[order]]
    least = order[rank < _prefix(n, SIMILARITY)[doc[order]]]
    owner = np.concatenate((np.repeat(full, BANDS), doc[least]))
    values = np.concatenate((bands.ravel(), labelled[least].view(np.int64)))
    return values[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(n))


def aligned(a: np.ndarray, b: np.ndarray, slack: int) -> int:
    """The most k-mers that the sequences a and b hold in one order, if they leave at most `slack` of both unmatched; else it may be less.

    Places i and j can only be matched if what their shift leaves unmatched before and after is within the slack: the band.
    Memory is linear in the lengths. Few matches are threaded one by one along the least ends of common sequences; with many (of repetitive
    texts) a row of the alignment is one long number, whose bits change in a few operations.
    """
    size = min(len(a), len(b))
    same = a[:size] == b[:size]
    front = size if same.all() else int(np.argmin(same))
    a, b, size = a[front:], b[front:], size - front
    same = a[len(a) - size :][::-1] == b[len(b) - size :][::-1]
    back = size if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - back], b[: len(b) - back]
    if not len(a) or not len(b):
        return front + back
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    low, high = np.searchsorted(ordered, a), np.searchsorted(ordered, a, "right")
    if (high - low).sum() > MANY_MATCHES * (len(a) + len(b)):
        return front + back + _aligned_bits(a, b)
    shift, ends, places = len(a) - len(b), [], order.tolist()
    for i in np.flatnonzero(high > low).tolist():
        for j in reversed(places[low[i] : high[i]]):
            if abs(i - j) + abs(shift - (i - j)) <= slack:
                at = bisect_left(ends, j)
                ends[at : at + 1] = [j]
    return front + back + len(ends)


def _aligned_bits(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common sequence: a row has a bit for each place of a, which is 0 where the length grows."""
    n = len(a)
    order = np.argsort(a, kind="stable")
    ordered = a[order]
    low, high = np.searchsorted(ordered, b).tolist(), np.searchsorted(ordered, b, "right").tolist()
    kept: dict[int, int] = {}  # masks of k-mers that have over 1/64 of all places, so at most 64
    full = (1 << n) - 1
    row = full
    for begin, end in zip(low, high, strict=True):
        if begin == end:
            continue
        mask = kept.get(begin)
        if mask is None:
            bits = bytearray(n // 8 + 1)
            for at in order[begin:end].tolist():
                bits[at >> 3] |= 1 << (at & 7)
            mask = int.from_bytes(bits, "little")
            if 64 * (end - begin) > n:
                kept[begin] = mask
        met = row & mask
        row = ((row + met) | (row - met)) & full
    return n - row.bit_count()


def _grams_of(words: np.ndarray) -> np.ndarray:
    return tk.grams(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), min(SHINGLE, len(words)))


class Text:
    def __init__(self, data: bytes):
        words = np.frombuffer(data, np.uint32)
        self.ordered = _grams_of(words) if len(words) else np.zeros(0, np.uint64)
        self.kmers, self.counts = np.unique(self.ordered, return_counts=True)
        self.n = len(self.ordered)


def similar(one: Text, other: Text, threshold: float = SIMILARITY) -> bool:
    """Whether the aligned k-mers of two texts reach the threshold."""
    total = one.n + other.n
    needed = threshold * total / (1 + threshold) - 1e-9
    if min(one.n, other.n) < needed:
        return False
    _, i, j = np.intersect1d(one.kmers, other.kmers, assume_unique=True, return_indices=True)
    if np.minimum(one.counts[i], other.counts[j]).sum() < needed:
        return False
    return aligned(one.ordered, other.ordered, int(total - 2 * needed)) >= needed


SKETCH_DDL = "rid long, doc_id {id}, mark long, n_words long, digest binary, bands array<long>, words binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of docs: row id, doc_id, mark (hash of the text as it is), words and buckets; a written table."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                data, offsets = tk.text_bytes(part.column(3))
                tokens = tk.tokenize(data, offsets, tk.WORDS, tk.FOLDED)
                values, many = sketch(tokens.hash, tokens.bounds)
                n = np.diff(tokens.bounds)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(many))).astype(np.int32), values)
                full = [tokens.hash[a:b].tobytes() for a, b in zip(tokens.bounds[:-1], tokens.bounds[1:], strict=True)]
                words = [tokens.hash[a:b].astype(np.uint32).tobytes() for a, b in zip(tokens.bounds[:-1], tokens.bounds[1:], strict=True)]
                digests = pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in full], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(n, pa.int64()), digests, lists, pa.array(words, pa.binary())],
                    ["rid", "doc_id", "mark", "n_words", "digest", "bands", "words"],
                )

    return written(rows.mapInArrow(run, SKETCH_DDL.format(id=kind)), "sketches")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b) of row ids those that are similar. a's words go once to each task of about PAIRS_A_TASK pairs."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / PAIRS_A_TASK).cast("int").alias("parts"))
    groups = written(sized(many, pairs.count()), "pair-groups")
    members = pairs.join(groups, "a").select("a", "b", (F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int").alias("part"))
    members = members.join(texts.select(F.col("rid").alias("b"), "words"), "b")
    firsts = groups.join(texts.select(F.col("rid").alias("a"), "words"), "a")
    firsts = firsts.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "words")
    dealt = members.select("a", "b", "part", "words").unionByName(firsts).repartition("a", "part")
    dealt = dealt.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for a, b, _, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    now = Text(words)
                elif similar(now, Text(words), threshold):
                    out.append((a, b))
            columns = list(zip(*out)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


LOCAL_EDGES = 20_000
EDGES = pa.schema([("rid", pa.int64()), ("label", pa.int64())])


def _small_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for a graph of at most LOCAL_EDGES edges, which is one task's work."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one, other = top(a), top(b)
            above[max(one, other)] = min(one, other)
    rows = [(x, top(x)) for x in list(above) if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [()] * 2], schema=EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(rid, label): the least row id of its component, for each row id on an edge but that least one; by large and small stars in turn."""
    n = edges.count()
    if n <= LOCAL_EDGES:
        return written(edges.select("a", "b").coalesce(1).mapInArrow(_small_components, "rid long, label long"), "labels")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The centre of a large star may have very many neighbours: a written side lets that join be split.
        least = written(sized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * n), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(sized(large, 2 * n), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(sized(small.where("u <> v").distinct(), 2 * n), "small-star")
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        ends = ends.groupBy("x").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
        if not ends.where("below > 1 or (below > 0 and above > 0)").limit(1).count():
            return edges.select(F.col("u").alias("rid"), F.col("v").alias("label"))


def _buckets(texts: DataFrame, representatives: DataFrame) -> DataFrame:
    """(band, rid, n) of representatives in buckets of two or more."""
    dealt = representatives.select("rid", "n_words", F.explode("bands").alias("band"))
    shared = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "n_words")).alias("first")).where("n > 1")
    return written(dealt.join(written(shared.select("band", "first"), "shared-buckets"), "band"), "buckets")


def _fits(a, b):
    """The length bound: k-mers of the shorter text must make up the threshold of the longer one's."""
    k = lambda n: F.greatest(n - (SHINGLE - 1), F.lit(1))
    return F.least(k(a), k(b)) >= F.greatest(k(a), k(b)) * SIMILARITY - 1e-6


def _meetings(marked: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) to hold against each other where classes meet in a bucket; marked: band, rid, n_words, label, that many rows.

    Two members stand for a class in a bucket, the least and the greatest by a hash that differs between buckets. Each is paired with those
    of the bucket's first class and with the next of another class by length; so the pairs of a bucket grow with its classes.
    """
    held = F.struct(F.xxhash64("rid", "band").alias("h"), F.col("rid"), F.col("n_words"))
    met = marked.groupBy("band", "label").agg(F.min(held).alias("low"), F.max(held).alias("high"))
    first = F.min(F.struct("label", "low", "high"))
    several = met.groupBy("band").agg(first.alias("first"), F.max("label").alias("last")).where("first.label <> last")
    met = written(sized(met.join(several.select("band", "first"), "band"), rows), "meeting-classes")
    pair = lambda x, y: F.struct(x["rid"].alias("x"), x["n_words"].alias("nx"), y["rid"].alias("y"), y["n_words"].alias("ny"))
    low, high, first = F.col("low"), F.col("high"), F.col("first")
    star = met.where("label <> first.label").select(F.array(pair(low, first["low"]), pair(high, first["high"])).alias("pairs"))
    stand = met.select("band", "label", F.explode(F.array_distinct(F.array("low", "high"))).alias("one"))
    stand = stand.select("band", "label", "one.rid", "one.n_words")
    along = Window.partitionBy("band").orderBy("n_words", "rid")
    self = F.struct("rid", "n_words", "label")
    nexts = stand.select(self.alias("one"), *[F.lead(self, k).over(along).alias(f"next{k}") for k in (1, 2)])
    beside = nexts.select(F.array(*[F.when(F.col("one.label") != F.col(f"next{k}.label"), pair(F.col("one"), F.col(f"next{k}"))) for k in (1, 2)]).alias("pairs"))
    both = star.unionByName(beside).select(F.filter("pairs", lambda p: p.isNotNull() & _fits(p["nx"], p["ny"])).alias("pairs"))
    both = both.select(F.explode("pairs").alias("p"))
    return both.select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b"))


def _needed(n, other):
    """Shared k-mers of two texts at the threshold."""
    return SIMILARITY / (1 + SIMILARITY) * (n + other) - 1e-6


def _open_texts(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(rid, label) of the texts in buckets of several classes."""
    marked = buckets.join(labels, "rid", "left").select("band", "rid", F.coalesce("label", "rid").alias("label"))
    several = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    several = written(several.select("band"), "open-buckets")
    return written(marked.join(several, "band", "left_semi").select("rid", "label").distinct(), "open-texts")


def _frequent(held: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers that are frequent in (a sample of) the n texts, sorted, and how often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_labelled_of(words) for words in batch.column(0).to_pylist()]
            kmers, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmers.view(np.int64)), pa.array(many, pa.int64())], ["kmer", "n"])

    some = held.where(F.pmod(F.xxhash64("rid"), F.lit(1 + n // COUNTED_TEXTS)) == 0).select("words")
    counted = some.mapInArrow(run, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n")).where("n > 2")
    top = counted.orderBy(F.desc("n"), "kmer").limit(FREQUENT).toArrow()
    kmers = top.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(kmers)
    return kmers[order], top.column(1).to_numpy()[order]


def _labelled_of(words: bytes) -> np.ndarray:
    kmers = _grams_of(np.frombuffer(words, np.uint32))
    return _labelled(kmers, np.array([0, len(kmers)]))


def _exact_pairs(texts: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes of held (rid, label) that can be similar; none that is at the threshold is left out.

    A shared k-mer is a key. The shorter text has fewer keys than the longer, as it must share more of its own. A frequent key's
    shorter texts are dealt in parts of about PAIRS_A_TASK, and each part meets all texts of the key.
    """
    n = held.count()
    held = texts.select("rid", "words").join(held, "rid")
    known = held.sparkSession.sparkContext.broadcast(_frequent(held, n))
    names = ["key", "rid", "label", "n", "place", "leads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, many = known.value
        for batch in batches:
            out, size = [], 0
            for rid, label, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kmers = _labelled_of(words)
                rank = np.zeros(len(kmers), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, kmers), len(frequent) - 1)
                    rank = np.where(frequent[at] == kmers, many[at], 0)
                first = kmers[np.lexsort((kmers, rank))[: _prefix(len(kmers), SIMILARITY)]]
                place, one = np.arange(len(first)), np.ones(len(first), np.int64)
                leads = place < _prefix(len(kmers), 2 * SIMILARITY / (1 + SIMILARITY))
                out.append((first.view(np.int64), one * rid, one * label, one * len(kmers), place, leads))
                size += len(first)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    keys = held.select("rid", "label", "words").mapInArrow(run, "key long, rid long, label long, n long, place long, leads boolean")
    keys = written(keys, "prefix-keys")
    shared = keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_if("leads").alias("many"))
    shared = shared.where("low <> high and many > 0").select("key", F.ceil(F.col("many") / PAIRS_A_TASK).cast("int").alias("parts"))
    dealt = written(keys.join(written(shared, "prefix-shared"), "key"), "prefix-dealt")
    one = dealt.where("leads").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    one = one.select("key", "part", *(F.col(c).alias(f"{c}1") for c in ("rid", "label", "n", "place")))
    other = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = other.select("key", "part", *(F.col(c).alias(f"{c}2") for c in ("rid", "label", "n", "place")))
    left = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))
    later = (F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("rid1") < F.col("rid2"))
    fits = later & (F.col("label1") != F.col("label2")) & (F.col("n1") >= SIMILARITY * F.col("n2") - 1e-6) & (left >= _needed(F.col("n1"), F.col("n2")))
    met = one.join(other, ["key", "part"]).where(fits)
    return met.select(F.least("rid1", "rid2").alias("a"), F.greatest("rid1", "rid2").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id (doc_id of the row that stays), class_size, kept, mark."""
    texts = sketches(docs)
    equal = texts.groupBy("digest").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = written(equal, "equal-words")
    placed = texts.select("rid", "doc_id", "mark", "n_words", "digest").join(copies, "digest", "left")
    placed = placed.select("rid", "doc_id", "mark", "n_words", F.coalesce("rep", "rid").alias("rep"))
    representatives = texts.select("rid", "n_words", "bands", "digest").join(copies, "digest", "left")
    representatives = representatives.where("rep is null or rep = rid").select("rid", "n_words", "bands")
    buckets = _buckets(texts, representatives)
    rows = buckets.count()
    first = buckets.where((F.col("rid") != F.col("first.rid")) & _fits(F.col("n_words"), F.col("first.n_words")))
    tried = written(sized(first.select(F.col("first.rid").alias("a"), F.col("rid").alias("b")).distinct(), rows), "tried-pairs")
    links = written(verified(tried, texts), "links")
    before = None
    while True:
        labels, met = components(links), buckets
        if before is not None:
            # Pairs are new only in buckets with a member whose class is another than in the round before.
            old = before.select("rid", F.col("label").alias("old"))
            moved = labels.join(old, "rid", "left").where("old is null or old <> label").select("rid")
            met = buckets.join(buckets.join(moved, "rid", "left_semi").select("band").distinct(), "band", "left_semi")
        before = labels
        marked = met.join(labels, "rid", "left").select("band", "rid", "n_words", F.coalesce("label", "rid").alias("label"))
        pairs = _meetings(marked, rows).distinct()
        fresh = written(sized(pairs.join(tried, ["a", "b"], "left_anti"), 4 * rows), "fresh-pairs")
        if not fresh.limit(1).count():
            break
        found = written(verified(fresh, texts), "links")
        tried, links = tried.unionByName(fresh), links.unionByName(found)
        if not found.limit(1).count():
            break
    held = _open_texts(buckets, labels)
    if held.limit(1).count():
        fresh = written(_exact_pairs(texts, held).join(tried, ["a", "b"], "left_anti"), "exact-pairs")
        found = written(verified(fresh, texts), "links")
        if found.limit(1).count():
            labels = components(links.unionByName(found))
    found = placed.join(labels.select(F.col("rid").alias("rep"), "label"), "rep", "left")
    found = written(found.select("rid", "doc_id", "mark", "n_words", F.coalesce("label", "rep").alias("label")), "classes")
    best = F.min(F.struct((-F.col("n_words")).alias("less"), F.col("doc_id"), F.col("rid"))).alias("best")
    groups = written(found.groupBy("label").agg(best, F.count(F.lit(1)).alias("class_size")), "class-sizes")
    return found.join(groups, "label").select(
        "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("best.rid") == F.col("rid")).alias("kept"), "mark"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns."""
    kept = written(classes(docs).where("kept").select("doc_id", "mark", "class_size"), "kept-texts")
    mark, key_id, key_mark = (free_name(docs.columns, n) for n in ("mark", "key_id", "key_mark"))
    keyed = docs.select("*", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(mark))

    def chosen(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(key_id), F.col("mark").alias(key_mark))
        return keyed.join(keys, F.col("doc_id").eqNullSafe(F.col(key_id)) & (F.col(mark) == F.col(key_mark)), "left_semi")

    # Only rows of larger classes can be repeated in id and text.
    alone = chosen(kept.where("class_size = 1"))
    several = chosen(kept.where("class_size > 1")).dropDuplicates(["doc_id", mark])
    return alone.unionByName(several).select(*docs.columns)
