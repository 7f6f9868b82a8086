"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are runs of anything but white space, A-Z lower-cased, then one end. Each pair of words before a token is a restaurant of its own,
known by whole hashes; all pairs with the same last word share their parent, the restaurant of that word; all of these share the root. (A word of
over CLASS_TOKENS training tokens has several such parents, each for a class of the words before it, so that none grows
without bound.) The root's dishes are all training words. The state of the up to FREQUENT most frequent ones has a fixed size and is sent to all tasks;
that of the rarer ones, like restaurants, dishes, customers and tables, grows with the corpus and stays distributed: after each sweep their customers
are added up and seated by word, and each owner is handed those of its own words. What is drawn is the same whichever words are frequent.

Seating is sampled by Gibbs sweeps: the customers of each dish in each restaurant leave, with the tables that they held in the parent, and are seated
again one after another by the Chinese-restaurant rule, each new table raising the odds of the next; new tables are
customers of the parent, whose dishes are reseated in the same way. Dishes of one level are sampled at the same time against
the state of the others before (the usual approximation of distributed samplers). After BURN_IN sweeps the predictive probabilities
of each sweep, which sum to one, are averaged; a text's score is the sum of their logarithms, and its perplexity follows from that. Discounts come from
counts of counts. From customer ONE_BY_ONE on, the waiting time to the next new table is drawn at once. Random numbers
are functions of restaurant, dish and sweep, so that scores do not depend on partitions or on how the work is dealt.

Words are counted first. A block of about BLOCK_TOKENS tokens then sends its distinct (pair, word) types with their training counts
to the owners of restaurants, packed as sorted columns; frequent words go by rank, others by hash. An owner merges them; that
is a written table. A sweep is a map over it that begins with the seating which the sweep before left in the shared folder (or, where
that is missing, replays from the root's states), so that only the root's sums travel and lost executors lose nothing. States of rarer words are written in a folder for each owner. At last each owner answers each block with its types' probabilities, and the block adds them up by document.

Defined cases: a null text is empty and has one token, the end; without training tokens every word has probability one, as the
base has; repeated rows are documents of their own; other columns are ignored; words of any length count as one token.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import struct
import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import textkernel as tk
from chronoframe.llm.common import PACKED, fold, made, new_folder, release, small_batches, written
from chronoframe.llm.warc import file_system

FOLDS = 10
FREQUENT, CLASS_TOKENS = 1 << 19, 1 << 19
BURN_IN, SWEEPS = 1, 3
STRENGTH = (1.0, 2.0, 2.0)  # of the root, of a word, of a pair
BLOCK_TOKENS, OWNER_TOKENS = 1_500_000, 1_500_000
END, START, BEFORE_START = (int(h) for h in tk.word_hash([" ", "  ", "   "]))
CHUNK = 1 << 12
CHUNK_BYTES = 1 << 20
RARE_TOKENS = 1 << 19
ONE_BY_ONE = 10
#: Parts of log10 that base scores of rare words are added up in, as whole numbers, so that their order does not matter.
PARTS = float(1 << 40)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Rows of an Arrow batch for the jobs within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return freed arrays to the machine, as owners and blocks follow each other in a worker.

    Within one of them the allocator keeps what is freed for the next array: fresh pages take nearly as long as what is computed on them.
    """
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD: arrays of up to so many bytes, the most it takes, come from the heap
        libc.mallopt(-1, 1 << 30)  # M_TRIM_THRESHOLD: which is not cut whenever its end is free
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is written by now: it does so for plans that nothing refers to, and a plan goes after what holds it."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one value, compressed byte plane by byte plane."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
        parts.append(zstandard.ZstdCompressor(level=1).compress(planes.tobytes()))
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def unpack(data: bytes, types: list) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(types)}q", data), 8 * len(types), []
    for size, kind in zip(sizes, types, strict=True):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), np.uint8)
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if width > 1 else raw.view(kind))
        at += size
    return out


def distinct(columns: list[tuple[np.ndarray, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns (values, upper bound) in their order, and for each row which of these it is."""
    columns = list(columns)
    bits, n = [max(1, (bound - 1).bit_length()) for _, bound in columns], len(columns[0][0])
    if sum(bits) + n.bit_length() > 63 and len(columns) > 2:  # number the first two columns' pairs first
        head, at = distinct(columns[:2])
        found, inverse = distinct([(at, len(head[0])), *columns[2:]])
        return [c[found[0]] for c in head] + found[1:], inverse
    key = np.zeros(n, np.int64)
    for (values, _), width in zip(columns, bits, strict=True):
        key <<= width
        key |= values
    if sum(bits) + n.bit_length() > 63:
        key, inverse = np.unique(key, return_inverse=True)
    else:  # keys with their rows' numbers are sorted faster than rows by key
        key <<= n.bit_length()
        key |= np.arange(n)
        key.sort()
        row = key & ((1 << n.bit_length()) - 1)
        key >>= n.bit_length()
        new = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        inverse = np.empty(n, np.int64)
        inverse[row] = np.cumsum(new) - 1
        key = key[new]
    out = []
    for width in reversed(bits):
        out.append(key & ((1 << width) - 1))
        key = key >> width
    return out[::-1], inverse


def distinct_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in their order, and for each which of these it is."""
    found = pa.array(hashes).dictionary_encode()
    values = found.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[found.indices.to_numpy()]


class Words:
    """The frequent words' hashes and training counts by rank; of all words the tokens and how many are known."""

    def __init__(self, by_rank: np.ndarray, counts: np.ndarray, tokens: int, known: int):
        self.by_rank, self.counts, self.tokens, self.known = by_rank, counts, tokens, known
        self.ranks = np.argsort(by_rank)
        self.hashes = by_rank[self.ranks]
        self.n, self.rare = len(by_rank), known - len(by_rank)

    def __reduce__(self):
        return Words, (self.by_rank, self.counts, self.tokens, self.known)

    def codes(self, vocabulary: np.ndarray) -> np.ndarray:
        """The rank of each of sorted hashes, or beyond all ranks its place among those that have none."""
        at = np.searchsorted(self.hashes, vocabulary)
        at[at == self.n] = 0
        has = self.hashes[at] == vocabulary if self.n else np.zeros(len(vocabulary), bool)
        codes = np.cumsum(~has) - 1 + self.n
        codes[has] = self.ranks[at[has]]
        return codes

    def base(self) -> np.ndarray:
        return np.log10((self.counts + 0.1) / (self.tokens + 0.1 * (self.known + 1)))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with their ends, and where documents begin."""
    data, offsets = tk.text_bytes(column)
    found = tk.tokenize(data, offsets, tk.SOLID, tk.FOLDED)
    n = np.diff(found.bounds)
    bounds = found.bounds + np.arange(len(found.bounds))
    words = np.empty(bounds[-1], np.uint64)
    words[np.arange(len(found.hash)) + np.repeat(np.arange(len(n)), n)] = found.hash
    words[bounds[1:] - 1] = END
    return words, bounds


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Token hashes, documents' bounds and the rows of about BLOCK_TOKENS tokens, or of one longer text, at a time."""
    held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
    size = 0

    def together():
        sizes = np.concatenate([np.diff(b) for _, b, _ in held])
        return np.concatenate([w for w, *_ in held]), np.concatenate(([0], np.cumsum(sizes))), [p for *_, p in held]

    for batch in batches:
        for part in tk.chunks(batch, "text", CHUNK_BYTES):
            words, bounds = tokens_of(part.column(part.schema.get_field_index("text")))
            if held and size + len(words) > BLOCK_TOKENS:
                yield together()
                held, size = [], 0
            held.append((words, bounds, part.drop_columns(["text"])))
            size += len(words)
    if held:
        yield together()


def _flags(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([np.asarray(p.column(p.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False), np.uint8) for p in parts])


def count_words(rows: DataFrame, frequent: int) -> tuple[DataFrame, Words, int]:
    """A written table (hash, train) of all words, what is known of the frequent ones, and the tokens of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, bounds, parts in _blocks(batches):
            give_back()
            vocabulary, at = distinct_hashes(words)
            held = np.repeat(_flags(parts), np.diff(bounds))
            every, train = np.bincount(at, minlength=len(vocabulary)), np.bincount(at[held == 0], minlength=len(vocabulary))
            yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(train), pa.array(every)], ["hash", "train", "every"])

    counted = rows.select("held_out", "text").mapInArrow(run, "hash long, train long, every long")
    table = written(counted.groupBy("hash").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "word-counts")
    kind = F.floor(F.log2(F.col("train").cast("double")) * 16 + 1e-9).alias("class")
    classes = table.where("train > 0").groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum("train").alias("tokens")).orderBy(F.desc("class")).collect()
    every = table.agg(F.sum("every")).first()[0] or 0
    room, least = frequent, None
    for row in classes:
        room -= row["n"]
        if room < 0:
            break
        least = row["class"]
    chosen = table.where("train > 0").where(kind >= least) if least is not None else table.where("false")
    top = chosen.select("hash", "train").toArrow()
    hashes = top.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    counts = top.column("train").to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -counts))
    known, tokens = sum(r["n"] for r in classes), sum(r["tokens"] for r in classes)
    return table.select("hash", "train"), Words(hashes[order], counts[order], int(tokens), int(known)), int(every)


#: Restaurants of last words (steps from code to code, classes, how many pairs), pairs (steps of first words, how many types), types (steps of words, counts), rare words.
BLOB = [np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint64]
OWNED = [*BLOB, np.int64, np.int64, np.int64, np.uint32]  # the same, and of each blob its block, the place there of its first type, its length; steps from type to type


class Types(NamedTuple):
    """Distinct (restaurant, first word, word) in order: of each type its restaurant and codes of words; of each restaurant its last word and class."""
    last: np.ndarray
    classes: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    word: np.ndarray

    def part(self, a: int, b: int) -> Types:
        x, y = (self.parent[a], self.parent[b - 1] + 1) if b > a else (0, 0)
        return Types(self.last[x:y], self.classes[x:y], self.parent[a:b] - x, self.first[a:b], self.word[a:b])

    def packed(self, train: np.ndarray, rare: np.ndarray, ranks: int) -> list[np.ndarray]:
        """As columns of a blob, with the rare words that occur; each step is from the one before in the same restaurant or pair."""
        new = np.flatnonzero(np.concatenate(([True], (self.parent[1:] != self.parent[:-1]) | (self.first[1:] != self.first[:-1])))) if len(self.word) else np.zeros(0, np.int64)
        used = np.zeros(len(rare), bool)
        for codes in (self.last, self.first, self.word):
            used[codes[codes >= ranks] - ranks] = True
        places = np.append(np.cumsum(used) - 1 + ranks, 0)
        own = lambda codes: np.where(codes < ranks, codes, places[np.maximum(codes - ranks, 0) if len(rare) else np.zeros(len(codes), int)])
        runs = np.searchsorted(self.parent[new], np.arange(len(self.last) + 1))
        pairs, types = np.diff(runs), np.diff(np.append(new, len(self.word)))
        columns = [np.diff(own(self.last), prepend=0), self.classes, pairs, _steps(own(self.first[new]), runs[:-1]), types, _steps(own(self.word), new), train]
        # Restaurants of one word stand together, so no step is below 0.
        return [c.astype(np.uint32) for c in columns] + [rare[used]]

    @staticmethod
    def unpacked(columns: list[np.ndarray]) -> tuple[Types, np.ndarray, np.ndarray]:
        """Types from the columns of a blob, the pair of each, and the counts."""
        last, classes, pairs, first, types, word, train = (c.astype(np.int64) for c in columns[:7])
        first, word = _summed(first, pairs), _summed(word, types)
        pair = np.repeat(np.arange(len(first)), types)
        parent = np.repeat(np.arange(len(pairs)), pairs)[pair]
        return Types(np.cumsum(last), classes, parent, first[pair], word), pair, train


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences that begin anew at the starts."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _summed(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums along runs of given lengths."""
    if not len(steps):
        return steps
    total = np.cumsum(steps)
    starts = np.cumsum(lengths) - lengths
    return total - np.repeat(total[starts] - steps[starts], lengths)


#: Writer options of tables whose rows are long arrays.
LONG_ROWS = {"parquet.enable.dictionary": "false"}


def as_rows(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column whose rows are the parts of a whole-number array between edges."""
    data = np.ascontiguousarray(values).astype(np.int64, copy=False)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(data)])


def of_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of such a column as one array, and how long each is."""
    parts = [pa.array([], pa.large_binary()), *(c.cast(pa.large_binary()) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]))]
    column = pa.concat_arrays(parts)
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 8
    data = column.buffers()[2]
    return (np.frombuffer(data, np.int64, edges[-1])[edges[0] :] if data is not None else np.zeros(0, np.int64)), np.diff(edges)


def slices_of(words: Words) -> int:
    """In how many parts, by their hashes, rarer words are seated."""
    return 1 + int(words.tokens - words.counts.sum()) // RARE_TOKENS


def hashes_of(words: Words, rare: np.ndarray) -> np.ndarray:
    return np.concatenate((words.by_rank, rare))


def place_of(last: np.ndarray, classes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each restaurant of a last word and its class."""
    return tk.mix(hashes[last] + classes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def types_of(codes: np.ndarray, rare: np.ndarray, bounds: np.ndarray, words: Words, owners: int) -> tuple[Types, np.ndarray, np.ndarray]:
    """A block's types in the order of their owners, which is whose of its tokens, and where each owner's types begin.

    codes: of each token; rare: hashes of the words without a rank, in order, with those of the starts.
    """
    hashes = hashes_of(words, rare)
    start, before = (words.n + int(np.searchsorted(rare, np.uint64(h))) for h in (START, BEFORE_START))
    last, first = np.empty_like(codes), np.empty_like(codes)
    last[1:], first[2:] = codes[:-1], codes[:-2]
    begins = bounds[:-1]
    last[begins], first[begins], first[begins[np.diff(bounds) > 1] + 1] = start, before, start
    many = np.append(1 + words.counts // CLASS_TOKENS, 1)
    classes = ((hashes[first] >> np.uint64(33)) % many[np.minimum(last, words.n)].astype(np.uint64)).astype(np.int64)
    (last, classes), parent = distinct([(last, len(hashes)), (classes, int(many.max()))])
    owner = ((place_of(last, classes, hashes) >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    (parent, first, word), at = distinct([(rank[parent], len(order)), (first, len(hashes)), (codes, len(hashes))])
    return Types(last[order], classes[order], parent, first, word), at, np.searchsorted(owner[order][parent], np.arange(owners + 1))


def _merged(blobs: list[tuple[int, int, bytes]], ranks: int) -> bytes:
    """An owner's blobs (block, place of the first type there, blob) as one."""
    parts = [unpack(blob, BLOB) for *_, blob in blobs]
    rare, at = np.unique(np.concatenate([p[7] for p in parts]), return_inverse=True)
    columns, train, begin = [], [], 0
    for part in parts:
        types, _, counts = Types.unpacked(part)
        places = np.append(at[begin : begin + len(part[7])] + ranks, 0)
        begin += len(part[7])
        own = lambda codes, places=places: np.where(codes < ranks, codes, places[np.clip(codes - ranks, 0, len(places) - 1)])
        columns.append((own(types.last)[types.parent], types.classes[types.parent], own(types.first), own(types.word)))
        train.append(counts)
    lengths = np.array([len(c) for c in train])
    train = np.concatenate(train)
    del parts
    last, classes, first, word = (np.concatenate(c) for c in zip(*columns, strict=True))
    del columns
    size = ranks + len(rare)
    (last, classes), parent = distinct([(last, size), (classes, int(classes.max()) + 1)])
    (parent, first, word), at = distinct([(parent, len(last)), (first, size), (word, size)])
    steps = np.diff(at, prepend=0)
    begins = np.cumsum(lengths) - lengths
    steps[begins] = at[begins]
    total = np.bincount(at, train, len(word))
    firsts, starts = (np.array([b[i] for b in blobs], np.int64) for i in (0, 1))
    return pack([*Types(last, classes, parent, first, word).packed(total, rare, ranks), firsts, starts, lengths.astype(np.int64), steps.astype(np.uint32)])


def coded(tokens: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a block's tokens, and the hashes of its words without a rank, the starts among them."""
    vocabulary, at = distinct_hashes(np.append(tokens, np.array([START, BEFORE_START], np.uint64)))
    codes = words.codes(vocabulary)
    return codes[at[:-2]], vocabulary[codes >= words.n]


def deal(rows: DataFrame, words, owners: int) -> tuple[DataFrame, DataFrame]:
    """Owners (p, data), and blocks (first row id, codes of tokens, rare words, ids, sizes and held-out flags of documents): parts of one written table."""
    spark = rows.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"p int, first long, start long, data binary, rare binary, ids array<{kind}>, sizes array<long>, held binary"
    names = [part.split()[0] for part in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, bounds, parts in _blocks(batches):
            give_back()
            held = _flags(parts)
            first = pa.array([parts[0].column(0)[0].as_py()])
            ids = pa.concat_arrays([p.column(1) for p in parts])
            codes, rare = coded(tokens, words.value)
            del tokens
            types, at, edges = types_of(codes, rare, bounds, words.value, owners)
            train = np.bincount(at[np.repeat(held, np.diff(bounds)) == 0], minlength=len(types.word))
            nothing = [pa.array([None], t) for t in (pa.binary(), pa.list_(ids.type), pa.list_(pa.int64()), pa.binary())]
            for p in np.flatnonzero(np.diff(edges)).tolist():
                a, b = int(edges[p]), int(edges[p + 1])
                blob = pack(types.part(a, b).packed(train[a:b], rare, words.value.n))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), first, pa.array([a]), pa.array([blob], pa.binary()), *nothing], names)
            ends = pa.array([0, len(held)], pa.int32())
            whole = [pa.array([pack([codes.astype(np.uint32)])], pa.binary()), pa.array([rare.tobytes()], pa.binary()), pa.ListArray.from_arrays(ends, ids)]
            whole += [pa.ListArray.from_arrays(ends, pa.array(np.diff(bounds), pa.int64())), pa.array([held.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), first, pa.array([len(types.word)]), *whole], names)

    blocks = rows.mapInArrow(run, ddl)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, blobs = None, []
        ranks = words.value.n

        def out(schema):
            nothing = [pa.array([None], f.type) for f in schema][4:]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([_merged(blobs, ranks)], pa.binary()), *nothing], schema=schema)

        for batch in batches:
            for at, p in enumerate(batch.column(0).to_pylist()):
                if blobs and p != now:
                    yield out(batch.schema)
                    blobs = []
                    give_back()
                if p < 0:
                    yield batch.slice(at, 1)
                else:
                    blobs.append(tuple(batch.column(i)[at].as_py() for i in (1, 2, 3)))
                now = p
        if blobs:
            yield out(batch.schema)
        blobs = []
        give_back()

    # As many partitions as owners, so that a task's share does not grow with the input.
    dealt = blocks.repartition(owners, "p", F.when(F.col("p") < 0, F.col("first"))).sortWithinPartitions("p", "first")
    with batch_rows(spark, 64):
        table = written(dealt.mapInArrow(merge, ddl), "owned-types", PACKED)
    return table.where("p >= 0").select("p", "data"), table.where("p < 0").drop("p")


def uniform(keys: np.ndarray, n: int) -> np.ndarray:
    """A random number below 1 for each key and n."""
    return (tk.mix(keys + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) / float(1 << 53)


def seat(customers: np.ndarray, others: np.ndarray, discount: float, strength: float, parent: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Tables for the customers of dishes, seated one after another.

    others is the restaurant's tables of other dishes, parent the parent's probability of the dish: the n-th customer opens a table with the
    odds (strength + discount * all tables) * parent : n - 1 - discount * the dish's tables.
    """
    tables = np.minimum(customers, 1)
    active = np.flatnonzero(customers > 1)
    base, parent, keys = (strength + discount * others)[active], parent[active], keys[active]
    own, wanted = tables[active], customers[active]
    n = 1
    while len(active) and n < ONE_BY_ONE:
        odds = (base + discount * own) * parent
        own += uniform(keys, n) * (n - discount * own + odds) < odds
        n += 1
        done = wanted <= n
        if done.any():
            tables[active[done]] = own[done]
            rest = ~done
            active, base, parent, keys, own, wanted = (x[rest] for x in (active, base, parent, keys, own, wanted))
    seated = np.full(len(active), float(n))
    while len(active):
        odds = np.maximum((base + discount * own) * parent, 1e-9)
        # That k customers open none has a chance near ((rest + (odds - 1) / 2) / (rest + (odds - 1) / 2 + k)) ** odds.
        rest = np.maximum(seated - discount * own + (odds - 1) / 2, 1e-9)
        jump = np.minimum(-np.log1p(-uniform(keys, n)) / odds, 60.0)
        seated += np.maximum(1.0, np.ceil(rest * np.expm1(jump)))
        n += 1
        new = seated <= wanted
        tables[active[~new]] = own[~new]
        active, base, parent, keys, own, wanted, seated = (x[new] for x in (active, base, parent, keys, own, wanted, seated))
        own += 1
    return tables


class Root(NamedTuple):
    """The root after a sweep: customers and tables by rank, and last of the words without a place together; the levels' discounts."""
    customers: np.ndarray
    tables: np.ndarray
    discounts: tuple[float, float, float]

    def share(self, words: Words) -> np.ndarray:
        """The uniform base of the dishes."""
        out = np.full(len(self.customers), 1 / (words.known + 1))
        out[-1] = (words.rare + 1) / (words.known + 1)
        return out

    def probability(self, words: Words, without: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """The predictive probabilities of the dishes at those places, without so many of their customers; of a rare word, its part."""
        at = np.arange(len(self.customers)) if at is None else at
        customers, tables, gone = self.customers[at], self.tables[at], 0
        if without is not None:
            customers, gone = customers - without, without
            left = np.minimum(tables, customers)
            gone_tables, tables = tables - left, left
        else:
            gone_tables = 0
        d, s = self.discounts[0], STRENGTH[0]
        found = (customers - d * tables + (s + d * (self.tables.sum() - gone_tables)) * self.share(words)[at]) / (s + self.customers.sum() - gone)
        return np.where(at == len(self.customers) - 1, found / (words.rare + 1), found)


class States:
    """Of each sweep the hashes of an owner's rarer words, in order, with the root's customers and tables of each; read from the sweep's folder when asked for."""

    def __init__(self, folders: list[str], owner: int):
        self.folders, self.owner, self.found = folders, owner, {}

    def __getitem__(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if number not in self.found:
            names = ["hash", "customers", "tables"]
            fs, path = file_system(f"{self.folders[number]}/p={self.owner}")
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
            parts = [pq.ParquetFile(fs.open_input_file(f)).read(names) for f in files]
            columns = [np.concatenate([np.zeros(0, np.int64), *(of_rows(p.column(name))[0] for p in parts)]) for name in names]
            hashes = columns[0].view(np.uint64)
            order = np.argsort(hashes)
            self.found[number] = (hashes[order], columns[1][order], columns[2][order])
        return self.found[number]


class Seatings:
    """An owner's seating after each sweep, in a file of the shared folder: a sweep begins where the last one ended."""

    def __init__(self, folder: str, owner: int):
        self.fs, self.path = file_system(folder)
        self.owner = owner

    def name(self, number: int) -> str:
        return f"{self.path}/{self.owner}-{number}"

    def has(self, number: int) -> bool:
        return self.fs.get_file_info(self.name(number)).type == pafs.FileType.File

    def read(self, number: int) -> list[np.ndarray]:
        with self.fs.open_input_file(self.name(number)) as file:
            return [x.astype(np.int64) for x in unpack(file.read(), [np.uint32, np.uint32])]

    def write(self, number: int, arrays: list[np.ndarray]) -> None:
        """Under another name first, so that a file is whole; a task that is repeated would write the same."""
        self.fs.create_dir(self.path, recursive=True)
        part = f"{self.name(number)}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part, compression=None) as file:
            file.write(pack([x.astype(np.uint32) for x in arrays]))
        try:
            self.fs.move(part, self.name(number))
        except OSError:
            if not self.has(number):
                raise
            self.fs.delete_file(part)


class Owner:
    """One owner's restaurants: types (pair, word) with their training counts, and the seating as sweeps go on.

    states: of the root's rarer words after each sweep so far; without them those words share the root's last dish.
    """

    def __init__(self, data: bytes, words: Words, states: States | None = None):
        self.words = words
        *columns, self.firsts, self.starts, self.lengths, self.steps = unpack(data, OWNED)
        types, self.pair, self.count = Types.unpacked(columns)
        hashes = hashes_of(words, columns[7])
        (self.up_parent, up_word), self.up = distinct([(types.parent, len(types.last)), (types.word, len(hashes))])
        mixed = tk.mix(hashes)
        places = place_of(types.last, types.classes, hashes)
        self.pairs, self.parents = len(columns[4]), len(types.last)
        self.of_pair = np.bincount(self.pair, self.count, self.pairs)
        own, at = np.unique(up_word[up_word >= words.n], return_inverse=True)
        self.own, self.states = hashes[own] if states is not None else np.zeros(0, np.uint64), states
        self.up_word = np.minimum(up_word, words.n)  # the root's dish
        if states is not None:
            self.up_word[up_word >= words.n] += at
        # A single customer always has one table: only the others are seated.
        self.several = np.flatnonzero(self.count > 1)
        some = self.several
        self.keys = tk.mix(tk.mix(places[types.parent[some]] + mixed[types.first[some]]) ^ mixed[types.word[some]])
        self.up_keys = tk.mix(places[self.up_parent] ^ mixed[up_word])
        self.take(np.minimum(self.count, 1))
        self.up_tables = np.minimum(self.up_customers, 1)
        self.reached = 0

    def take(self, tables: np.ndarray) -> None:
        self.tables = tables
        self.up_customers = np.bincount(self.up, tables, len(self.up_word)).astype(np.int64)

    def reach(self, number: int, roots: list[Root], saved: Seatings | None = None) -> None:
        """Go on to the seating after that sweep, from the last one saved or reached."""
        start = number
        while start > self.reached and not (saved and saved.has(start)):
            start -= 1
        if start > self.reached:
            tables, up_tables = saved.read(start)
            every = np.minimum(self.count, 1)
            every[self.several] = tables
            self.take(every)
            self.up_tables = up_tables
        for n in range(start + 1, number + 1):
            self.sweep(n, self.whole(roots[n - 1], n - 1))
            if saved:
                saved.write(n, [self.tables[self.several], self.up_tables])
        self.reached = number

    def whole(self, root: Root, number: int) -> Root:
        """The root after that sweep, with dishes for the rarer words here before the last one."""
        if not len(self.own):
            return root
        hashes, *state = self.states[number]
        at = np.searchsorted(hashes, self.own)
        put = lambda all_, own: np.concatenate((all_[:-1], own[at], [all_[-1] - own[at].sum()]))
        return Root(put(root.customers, state[0]), put(root.tables, state[1]), root.discounts)

    def sweep(self, number: int, root: Root) -> None:
        d, s, some = root.discounts, STRENGTH, self.several
        turn = np.uint64(number << 32)
        # Pairs: what a type's tables leave behind in the parent decides on its new ones.
        at, own = self.up[some], self.tables[some]
        where, left = self.up_parent[at], self.up_customers[at] - own
        left_tables = np.minimum(self.up_tables[at], left)
        parent_tables, parent_customers = (np.bincount(self.up_parent, x, self.parents) for x in (self.up_tables, self.up_customers))
        parent = left - d[1] * left_tables + (s[1] + d[1] * (parent_tables[where] - self.up_tables[at] + left_tables)) * root.probability(self.words, at=self.up_word[at])
        parent /= s[1] + parent_customers[where] - own
        others = np.bincount(self.pair, self.tables, self.pairs)[self.pair[some]] - own
        tables = self.tables.copy()
        tables[some] = seat(self.count[some], others, d[2], s[2], parent, self.keys + turn)
        self.take(tables)
        some = np.flatnonzero(self.up_customers > 1)
        own, dish = self.up_tables[some], self.up_word[some]
        others = parent_tables[self.up_parent[some]] - own
        base = root.probability(self.words, np.minimum(own, root.customers[dish]), dish)
        self.up_tables = np.minimum(self.up_customers, 1)
        self.up_tables[some] = seat(self.up_customers[some], others, d[1], s[1], base, self.up_keys[some] + turn)

    def predictive(self, root: Root) -> np.ndarray:
        """The probability of each type's word after its pair."""
        d, s = root.discounts, STRENGTH
        parent_tables, parent_customers = (np.bincount(self.up_parent, x, self.parents)[self.up_parent] for x in (self.up_tables, self.up_customers))
        back = (s[1] + d[1] * parent_tables) * root.probability(self.words, at=self.up_word)
        parent = (self.up_customers - d[1] * self.up_tables + back) / (s[1] + parent_customers)
        back = (s[2] + d[2] * np.bincount(self.pair, self.tables, self.pairs)[self.pair]) * parent[self.up]
        return (self.count - d[2] * self.tables + back) / (s[2] + self.of_pair[self.pair])


class Found(NamedTuple):
    """What an owner adds to the root: customers by rank, in chunks without those of zeros alone; counts of counts; rarer words' customers and tables before."""
    large: np.ndarray
    small: np.ndarray
    hashes: np.ndarray
    customers: np.ndarray
    before: np.ndarray


def _sums(owned: DataFrame, of: Callable[[int, bytes], Found], slices: int) -> tuple[dict[int, np.ndarray], np.ndarray, DataFrame | None]:
    """Add up the two arrays of fixed sizes that `of` gives for each owner; of the rarer words, if they have slices, a written table (p, slice, hash, n, before) with a row for each slice of an owner."""
    ddl = "chunk int, data binary" + ", p int, slice int, hash binary, n binary, before binary" * (slices > 0)
    kinds = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    nothing = lambda n, columns: [pa.nulls(n, t) for t in kinds[columns]]
    names = [part.split()[0] for part in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                give_back()
                found = of(p, data)
                large = found.large
                rows = [(-1, pack([found.small.astype(np.int64)]))]
                rows += [(at // CHUNK, pack([large[at : at + CHUNK].astype(np.int64)])) for at in range(0, len(large), CHUNK) if large[at : at + CHUNK].any()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), *nothing(len(rows), slice(2, len(names)))], names)
                if len(found.hashes):  # in order, so each slice is one part
                    which = ((found.hashes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
                    starts = np.flatnonzero(np.diff(which, prepend=-1))
                    edges, n = np.append(starts, len(which)), len(starts)
                    own = [as_rows(x, edges) for x in (found.hashes.view(np.int64), found.customers, found.before)]
                    yield pa.RecordBatch.from_arrays([*nothing(n, slice(0, 2)), pa.array(np.full(n, p, np.int32)), pa.array(which[starts].astype(np.int32)), *own], names)
                del found
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack([total])], pa.binary())], ["chunk", "data"])
        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and chunk != now:
                    yield out()
                total = unpack(data, [np.int64])[0] + (total if chunk == now else 0)
                now = chunk
        if now is not None:
            yield out()

    with batch_rows(owned.sparkSession, 1):
        parts = owned.mapInArrow(run, ddl)
        if slices:
            parts = written(parts, "root-customers", LONG_ROWS)
        chunks = parts.where("chunk is not null").select("chunk", "data").repartition("chunk").sortWithinPartitions("chunk")
        found = {r["chunk"]: unpack(bytes(r["data"]), [np.int64])[0] for r in chunks.mapInArrow(add, "chunk int, data binary").collect()}
    return {c: v for c, v in found.items() if c >= 0}, found.get(-1, np.zeros(6, np.int64)), parts.where("slice is not null").select("p", "slice", "hash", "n", "before") if slices else None


def _state(owner: Owner) -> tuple[np.ndarray, np.ndarray]:
    """The root's customers, and counts of types and of words' dishes that come once or twice."""
    few = [(x == n).sum() for x in (owner.up_customers, owner.count) for n in (1, 2)]
    return np.bincount(owner.up_word, owner.up_tables, owner.words.n + len(owner.own) + 1), np.array(few)


def _found(owner: Owner, number: int) -> Found:
    (customers, few), n = _state(owner), owner.words.n
    before = owner.states[number - 1][2][np.searchsorted(owner.states[number - 1][0], owner.own)] if number and len(owner.own) else np.zeros(len(owner.own), np.int64)
    return Found(np.append(customers[:n], customers[-1]), few, owner.own, customers[n:-1], before)


def _rarer(parts: DataFrame, words: Words, number: int, before: Root | None, owners: int) -> tuple[str, np.ndarray]:
    """Seat the rarer words at the root: a folder with their customers and tables for each owner, and the sums of both with how many come once or twice."""
    known, old = words.known, None if before is None else (int(before.tables.sum()), before.discounts[0])
    names = ["p", "hash", "customers", "tables"]

    def seated(blobs: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of a slice's rows (owners, their lengths, hashes, customers, tables before) the same with all customers and new tables; as owner -1 their sums."""
        owner, lengths, hashes, n, tables = (np.concatenate(c) for c in zip(*blobs, strict=True))
        hashes, at = distinct_hashes(hashes.view(np.uint64))
        customers, last = np.bincount(at, n, len(hashes)).astype(np.int64), np.zeros(len(hashes), np.int64)
        last[at] = tables  # the same in all rows of a word
        if old is None:
            tables = np.minimum(customers, 1)
        else:
            keys = tk.mix(hashes) + np.uint64(number << 32)
            tables = seat(customers, old[0] - last, old[1], STRENGTH[0], np.full(len(customers), 1 / (known + 1)), keys)
        edges = np.concatenate(([0], np.cumsum(lengths)))
        yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), *(as_rows(x, edges) for x in (hashes[at].view(np.int64), customers[at], tables[at]))], names)
        sums = np.array([customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum()])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), as_rows(sums, np.array([0, 4])), *(as_rows(sums[:0], np.array([0, 0])) for _ in names[2:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, blobs = None, []
        for batch in batches:
            which = batch.column(1).to_numpy()
            starts = np.flatnonzero(np.diff(which, prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(which)], strict=True):
                if blobs and which[a] != now:
                    yield from seated(blobs)
                    blobs = []
                    give_back()
                now, part = which[a], batch.slice(a, b - a)
                hashes, lengths = of_rows(part.column(2))
                blobs.append((part.column(0).to_numpy(), lengths, hashes, *(of_rows(part.column(i))[0] for i in (3, 4))))
        if blobs:
            yield from seated(blobs)
        blobs = []
        give_back()

    spark, slices, folder = parts.sparkSession, slices_of(words), new_folder(parts.sparkSession, "root-states")
    with batch_rows(spark, 64):
        states = parts.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(run, "p int, hash binary, customers binary, tables binary")
        states.repartition(owners, "p").write.options(**LONG_ROWS).partitionBy("p").parquet(folder)
    sums = spark.read.schema("hash binary").parquet(f"{folder}/p=-1").collect()
    return folder, np.sum([np.frombuffer(r["hash"], np.int64) for r in sums], axis=0)


def _root(found: tuple[dict[int, np.ndarray], np.ndarray], words: Words, number: int, before: Root | None, rarer: np.ndarray | None = None) -> Root:
    """rarer: of the rarer words the customers, the tables and how many have one and two customers; else they share the last dish."""
    customers = np.zeros(words.n + 1, np.int64)
    for chunk, values in found[0].items():
        customers[chunk * CHUNK : chunk * CHUNK + len(values)] = values
    if rarer is not None:
        customers[-1] = rarer[0]
    tables = np.minimum(customers, 1)
    if before is None:
        discount = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
        few = found[1]
        one, two = ((customers[:-1] == n).sum() + (0 if rarer is None else rarer[1 + n]) for n in (1, 2))
        discounts = (discount(one, two), discount(few[0], few[1]), discount(few[2], few[3]))
    else:
        discounts, old = before.discounts, before.tables
        keys = tk.mix(words.by_rank) + np.uint64(number << 32)
        tables[:-1] = seat(customers[:-1], old.sum() - old[:-1], discounts[0], STRENGTH[0], before.share(words)[:-1], keys)
    tables[-1] = min(customers[-1], max(words.rare, 1)) if rarer is None else rarer[1]
    return Root(customers, tables, tuple(map(float, discounts)))


def train(owned: DataFrame, words, owners: int) -> tuple[list[Root], list[str], str]:
    """The root before the first and after each sweep, folders with its rarer words' states, if there are any, and the folder of the seatings."""
    spark = owned.sparkSession
    seatings = new_folder(spark, "seatings")
    roots: list[Root] = []
    folders: list[str] = []
    for number in range(SWEEPS + 1):
        known = spark.sparkContext.broadcast(list(roots))

        def step(p: int, data: bytes, known=known, number=number, folders=tuple(folders)) -> Found:
            owner = Owner(data, words.value, States(folders, p) if words.value.rare else None)
            owner.reach(number, known.value, Seatings(seatings, p))
            return _found(owner, number)

        before, kept = roots[-1] if roots else None, made()
        *found, parts = _sums(owned, step, slices_of(words.value) if words.value.rare else 0)
        rarer = None
        if parts is not None:
            folder, rarer = _rarer(parts, words.value, number, before, owners)
            folders.append(folder)
            release(spark, [*kept, folder])  # what the states came from
            forget_shuffles(spark)
        roots.append(_root(found, words.value, number, before, rarer))
        known.destroy()
    return roots, folders, seatings


def answers(owner: Owner, roots: list[Root], saved: Seatings | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each block (its name), the place of the first of its types here, and log10 probabilities of these."""
    average = np.zeros(len(owner.count))
    for number in range(BURN_IN + 1, SWEEPS + 1):
        owner.reach(number, roots, saved)
        average += owner.predictive(owner.whole(roots[number], number)) / (SWEEPS - BURN_IN)
    found = np.log10(average).astype(np.float32)
    at = 0
    for first, start, length in zip(owner.firsts.tolist(), owner.starts.tolist(), owner.lengths.tolist(), strict=True):
        yield first, start, found[np.cumsum(owner.steps[at : at + length].astype(np.int64))]
        at += length


def score_documents(docs: DataFrame, frequent: int = FREQUENT, owners: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts, found, tokens = count_words(rows, frequent)
    words = spark.sparkContext.broadcast(found)
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + tokens // OWNER_TOKENS)
    forget_shuffles(spark)
    owned, blocks = deal(rows, words, owners)
    forget_shuffles(spark)
    found_roots, folders, seatings = train(owned, words, owners)
    roots = spark.sparkContext.broadcast(found_roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                give_back()
                for first, start, values in answers(Owner(data, words.value, States(folders, p) if folders else None), roots.value, Seatings(seatings, p)):
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([start]), pa.array([pack([values])], pa.binary())], ["first", "start", "answer"])
        give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "doc_id", "held_out", "n_tokens", "plain", "score", "rare"]
        held: tuple | None = None
        values = np.zeros(0)
        base = np.append(words.value.base(), 0.0)

        def out():
            first, codes, rare, ids, sizes, flags = held
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            _, at, _ = types_of(codes, rare, bounds, words.value, owners)
            score = np.add.reduceat(values[at], bounds[:-1])
            ranked = np.minimum(codes, words.value.n)
            plain = np.add.reduceat(base[ranked], bounds[:-1])
            away = np.flatnonzero(ranked == words.value.n)
            (doc, code), each = distinct([(np.searchsorted(bounds, away, "right") - 1, len(sizes)), (codes[away] - words.value.n, len(rare))])
            pairs = pa.StructArray.from_arrays([pa.array(rare[code].view(np.int64)), pa.array(np.bincount(each, minlength=len(code)))], ["hash", "n"])
            ends = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)), pa.int32())
            arrays = [pa.array(first + np.arange(len(sizes))), ids, pa.array(flags > 0), pa.array(sizes), pa.array(plain), pa.array(score), pa.ListArray.from_arrays(ends, pairs)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for row in range(batch.num_rows):
                first, start, answer, data, rare, ids, sizes, flags = (c[row] for c in batch.columns)
                if not answer.is_valid:
                    if held:
                        yield out()
                    give_back()
                    codes = unpack(data.as_py(), [np.uint32])[0].astype(np.int64)
                    held = (first.as_py(), codes, np.frombuffer(rare.as_py(), np.uint64), ids.values, sizes.values.to_numpy(), np.frombuffer(flags.as_py(), np.uint8))
                    values = np.zeros(start.as_py())
                else:
                    part = unpack(answer.as_py(), [np.float32])[0]
                    values[start.as_py() : start.as_py() + len(part)] = part
        if held:
            yield out()

    ddl = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, plain double, score double, rare array<struct<hash:long,n:long>>"
    parts = owned.mapInArrow(run, "first long, start long, answer binary")
    both = blocks.select("first", "start", F.lit(None).cast("binary").alias("answer"), "data", "rare", "ids", "sizes", "held")
    both = both.unionByName(parts, allowMissingColumns=True).repartition(owners, "first").sortWithinPartitions("first", F.col("answer").isNotNull())
    with batch_rows(spark, 16):
        scores = written(both.mapInArrow(add, ddl), "scores")
    rare = scores.select("rid", F.explode("rare").alias("r")).select("rid", "r.hash", "r.n")
    base = F.log10((F.col("train") + 0.1) / F.lit(found.tokens + 0.1 * (found.known + 1)))
    rare = rare.join(counts, "hash").groupBy("rid").agg(
        F.sum(F.col("n") * F.round(base * PARTS).cast("long")).alias("base"), F.sum("n").alias("rare"), F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("known")
    )
    score, left = F.col("score"), lambda c: F.coalesce(F.col(c), F.lit(0))
    return scores.drop("rare").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - left("rare") + left("known")).cast("long").alias("n_known"), F.lit(found.tokens).cast("long").alias("train_tokens"),
        (F.col("plain") + left("base") / F.lit(PARTS)).alias("base_score"), "score", F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
