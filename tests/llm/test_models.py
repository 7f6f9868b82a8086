import math
import os
import random
import re
import resource
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronoframe.llm import language_model as lm, quality

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n == 0


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 40, 0])
def test_base_scores_agree_with_brute_force(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    odd = spark.createDataFrame([(None, None), (900001, ""), (900002, " \n"), (900001, "again the"), (900003, "the " * 70000)], docs.schema)
    docs = docs.unionByName(odd).withColumnRenamed("text", "t").selectExpr("doc_id", "t as text", "1 as score", "'x' as first", "2 as hash")
    rows = docs.collect()
    count = Counter(w for r in rows if not held(r["doc_id"], 10) for w in tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted((str(r["doc_id"]), held(r["doc_id"], 10), len(tokens(r["text"])), sum(count[w] > 0 for w in tokens(r["text"])), n, round(base(r["text"]), 4)) for r in rows)
    found = lm.score_documents(docs, frequent).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == want
    assert all(-1e9 < r["score"] < 0 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in found)


def test_tables_without_rows_or_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b a") for i in range(400)], "doc_id long, text string")
    assert lm.score_documents(docs.where("false")).count() == 0
    alone = docs.where(lm.fold("doc_id", 10) == 0)
    assert {(r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in lm.score_documents(alone).collect()} == {(0.0, 0.0, 0, 0)}


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lm.score_documents(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert found["s"] / found["n"] > found["b"] / found["n"] + 1  # over ten times as likely, token by token


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).select("doc_id", "text")
    scores = lambda d, **how: sorted((r["doc_id"], r["score"], r["base_score"]) for r in lm.score_documents(d, **how).collect())
    want = scores(docs, frequent=1000)
    assert scores(docs.repartition(7), frequent=1000, owners=1) == want
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert scores(docs, frequent=1000) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("frequent", [0, 60])
def test_rarer_words_are_told_apart_as_frequent_ones(spark, frequent):
    """Scores are those of a root that has all words at hand, however few it has; words far beyond its number differ by their counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).select("doc_id", "text")
    more = spark.createDataFrame([(900000 + i, "often " * 40 if i < 60 else f"seldom{i}") for i in range(120)] + [(900300 + i, f"new{i} {w}") for i in range(40) for w in ("often", "seldom70")], docs.schema)
    docs = docs.unionByName(more)
    scores = lambda n: {r["doc_id"]: r["score"] for r in lm.score_documents(docs, n, owners=3).collect()}
    assert scores(frequent) == pytest.approx(scores(lm.FREQUENT), rel=1e-9)


def small_model(texts, frequent, owners=1):
    """Words, and the packed types of owners, of texts that are all for training."""
    column = pa.array(texts, pa.string())
    found, bounds = lm.tokens_of(column)
    hashes, counts = np.unique(found, return_counts=True)
    order = np.lexsort((hashes, -counts))[:frequent]
    words = lm.Words(hashes[order], counts[order].astype(np.int64), len(found), len(hashes))
    codes, rare = lm.coded(found, words)
    types, token_type, edges = lm.types_of(codes, rare, bounds, words, owners)
    train = np.bincount(token_type, minlength=len(types.word))
    spans = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if b > a]
    return words, [lm._merged([(0, a, lm.pack(types.part(a, b).packed(train[a:b], rare, words.n)))], words.n) for a, b in spans], token_type


def sample(owner, words, sweeps):
    """Root and owner after each sweep."""
    gather = lambda: ({at: v[at * lm.CHUNK :][: lm.CHUNK] for v in [lm._state(owner)[0]] for at in range(1 + len(v) // lm.CHUNK)}, lm._state(owner)[1])
    root = lm._root(gather(), words, 0, None)
    for number in range(1, sweeps + 1):
        owner.sweep(number, root)
        root = lm._root(gather(), words, number, root)
        yield number, root


WORDS = ["a b a c a b d", "a b b e f", "g a b a a", None, "c d c d c d", "a b a c a b e f g h i j"]


@pytest.mark.parametrize("frequent", [100, 4])
def test_every_averaged_predictive_adds_up_to_one(frequent):
    words, (data,), _ = small_model(WORDS * 12, frequent)
    owner = lm.Owner(data, words)
    for number, root in sample(owner, words, lm.SWEEPS):
        if number <= lm.BURN_IN:
            continue
        base = root.probability(words)
        assert base[:-1].sum() + (words.rare + 1) * base[-1] == pytest.approx(1)
        d, s = root.discounts, lm.STRENGTH
        tables, customers = (np.bincount(owner.up_parent, x, owner.parents) for x in (owner.up_tables, owner.up_customers))
        # A word's own share and what its parent leaves for all words, whose base adds up to one.
        up_back = (s[1] + d[1] * tables) / (s[1] + customers)
        up = (owner.up_customers - d[1] * owner.up_tables) / (s[1] + customers[owner.up_parent]) + up_back[owner.up_parent] * base[owner.up_word]
        rest = np.bincount(owner.up_parent, base[owner.up_word], owner.parents)
        assert np.bincount(owner.up_parent, up, owner.parents) + up_back * (1 - rest) == pytest.approx(np.ones(owner.parents))
        back = (s[2] + d[2] * np.bincount(owner.pair, owner.tables, owner.pairs)) / (s[2] + owner.of_pair)
        unseen = 1 - np.bincount(owner.pair, up[owner.up], owner.pairs)
        assert np.bincount(owner.pair, owner.predictive(root), owner.pairs) + back * unseen == pytest.approx(np.ones(owner.pairs))


def test_sampler_agrees_with_seating_customers_one_by_one():
    """The averaged predictive probabilities of a plain sampler that moves one customer at a time."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.choice([2, 4, 8])]) for _ in range(rng.randrange(2, 12))) for _ in range(50)]
    words, (data,), token_type = small_model(texts, 100)
    owner = lm.Owner(data, words)
    mine, n, discounts = np.zeros(len(owner.count)), 0, None
    for number, root in sample(owner, words, 300):
        discounts = root.discounts
        if number > 20:
            mine, n = mine + owner.predictive(root), n + 1
    mine /= n

    strength, v = lm.STRENGTH, words.known
    seats: dict = {}  # restaurant -> dish -> sizes of tables

    def probability(level, place, dish):
        up = (1 / (v + 1)) if level == 0 else probability(level - 1, place[1:] if level > 1 else (), dish)
        here = seats.get((level, place), {})
        all_customers, all_tables = sum(map(sum, here.values())), sum(map(len, here.values()))
        own = here.get(dish, [])
        return (sum(own) - discounts[level] * len(own) + (strength[level] + discounts[level] * all_tables) * up) / (strength[level] + all_customers)

    def above(level, place):
        return level - 1, place[1:] if level > 1 else ()

    def add(level, place, dish):
        here = seats.setdefault((level, place), {})
        own = here.setdefault(dish, [])
        up = probability(*above(level, place), dish) if level else 1 / (v + 1)
        new = (strength[level] + discounts[level] * sum(map(len, here.values()))) * up
        pick = rng.random() * (sum(own) - discounts[level] * len(own) + new)
        for at, size in enumerate(own):
            pick -= size - discounts[level]
            if pick < 0:
                own[at] += 1
                return
        own.append(1)
        if level:
            add(*above(level, place), dish)

    def remove(level, place, dish):
        own = seats[level, place][dish]
        at = rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        if not own[at]:
            del own[at]
            if level:
                remove(*above(level, place), dish)

    customers = []
    for text in texts:
        line = ["<<", "<", *text.split(), ">"]
        customers += [((line[i - 2], line[i - 1]), line[i]) for i in range(2, len(line))]
    for place, dish in customers:
        add(2, place, dish)
    theirs, sweeps = np.zeros(len(customers)), 0
    for number in range(60):
        for place, dish in customers:
            remove(2, place, dish)
            add(2, place, dish)
        if number >= 10:
            theirs, sweeps = theirs + np.array([probability(2, place, dish) for place, dish in customers]), sweeps + 1
    difference = np.log10(mine[token_type]) - np.log10(theirs / sweeps)
    assert abs(difference.mean()) < 0.01 and np.abs(difference).max() < 0.1


def test_a_sweep_goes_on_from_the_saved_seating(tmp_path, monkeypatch):
    words, (data,), _ = small_model(WORDS * 12, 100)
    roots = [lm._root(({0: lm._state(lm.Owner(data, words))[0]}, lm._state(lm.Owner(data, words))[1]), words, 0, None)]
    roots += [root for _, root in sample(lm.Owner(data, words), words, lm.SWEEPS)]
    plain, sweep, swept = lm.Owner(data, words), lm.Owner.sweep, []
    monkeypatch.setattr(lm.Owner, "sweep", lambda self, n, root: (swept.append(n), sweep(self, n, root)))
    plain.reach(lm.SWEEPS, roots)
    want = list(lm.answers(lm.Owner(data, words), roots))
    swept.clear()
    for number in range(lm.SWEEPS + 1):  # as a task for each sweep
        again = lm.Owner(data, words)
        again.reach(number, roots, lm.Seatings(str(tmp_path), 0))
    assert (again.tables == plain.tables).all() and (again.up_tables == plain.up_tables).all() and (again.up_customers == plain.up_customers).all()
    got = list(lm.answers(lm.Owner(data, words), roots, lm.Seatings(str(tmp_path), 0)))
    assert swept == list(range(1, lm.SWEEPS + 1)) and all((a[2] == b[2]).all() for a, b in zip(got, want, strict=True))


def test_seating_has_the_expected_tables():
    keys = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c, base, share, d in ((5, 1.4, 0.5, 0.3), (200, 4.0, 0.3, 0.5), (300, 0.5, 0.01, 0.7)):
        tables = Counter({1: 1.0})
        for n in range(1, c):
            after = Counter()
            for t, p in tables.items():
                odds = (base + d * t) * share
                new = odds / (n - d * t + odds)
                after[t + 1] += p * new
                after[t] += p * (1 - new)
            tables = after
        mean = sum(t * p for t, p in tables.items())
        got = lm.seat(np.full(20000, c), np.zeros(20000, int), d, base, np.full(20000, share), keys)
        assert got.mean() == pytest.approx(mean, rel=0.02) and got.min() >= 1
    assert lm.seat(np.array([0, 1]), np.zeros(2, int), 0.5, 1.0, np.ones(2), keys[:2]).tolist() == [0, 1]


def test_types_of_blocks_and_owners():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 7, 500), rng.integers(0, 1 << 40, 500) // (1 << 38), rng.integers(0, 1 << 30, 500) // (1 << 28)]
    found, at = lm.distinct([(columns[0], 7), (columns[1], 1 << 40), (columns[2], 1 << 30)])
    assert [tuple(r) for r in np.array(found).T] == sorted({*zip(*(c.tolist() for c in columns))})
    assert all((f[at] == c).all() for f, c in zip(found, columns, strict=True))
    arrays = [rng.integers(0, 1 << 62, 9).astype(np.uint64), np.zeros(0, np.uint32), rng.integers(0, 9, 5).astype(np.uint8)]
    assert all((x == y).all() for x, y in zip(lm.unpack(lm.pack(arrays), [a.dtype for a in arrays]), arrays, strict=True))


@pytest.mark.parametrize("bounds", [(7, 50), (1 << 30, 1 << 33), (1 << 20, 1 << 20, 1 << 20), (1, 1)])
def test_distinct_rows_whether_or_not_their_numbers_fit_the_key(bounds):
    rng = np.random.default_rng(5)
    for n in (0, 1, 700):
        columns = [rng.integers(0, 20, n) * (b // 20) for b in bounds]
        found, at = lm.distinct(list(zip(columns, bounds)))
        assert [tuple(r) for r in np.array(found).T.tolist()] == sorted({*zip(*(c.tolist() for c in columns))})
        assert all((f[at] == c).all() for f, c in zip(found, columns, strict=True))
    hashes = rng.integers(0, 1 << 63, 90).astype(np.uint64)[rng.integers(0, 90, 500)] * np.uint64(2)
    found, at = lm.distinct_hashes(hashes)
    assert (found == np.unique(hashes)).all() and (found[at] == hashes).all() and not len(lm.distinct_hashes(hashes[:0])[0])


def test_arrays_of_an_owner_do_not_take_fresh_pages_each_time():
    lm.give_back()
    began = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(60):
        np.ones(1 << 18)  # 512 pages
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - began < 10_000


def test_long_rows():
    values, edges = np.arange(-3, 9), np.array([0, 5, 5, 12])
    column = lm.as_rows(values, edges)
    for some in (column, pa.chunked_array([column[:1], column[1:]]), pa.chunked_array([column[:0], column])):
        found, lengths = lm.of_rows(some)
        assert (found == values).all() and lengths.tolist() == [5, 0, 7]
    found, lengths = lm.of_rows(column.slice(1, 2))
    assert (found == values[5:]).all() and lengths.tolist() == [0, 7]
    assert not len(lm.of_rows(column[:0])[0]) and not len(lm.of_rows(pa.chunked_array([], pa.binary()))[0])


def test_an_owner_sends_its_rarer_words_as_a_row_a_slice(spark, monkeypatch):
    monkeypatch.setattr(lm, "RARE_TOKENS", 20)
    words, data, _ = small_model([" ".join(f"w{i * k % 97}" for i in range(60)) for k in range(1, 9)], 5, owners=2)
    slices = lm.slices_of(words)
    owned = spark.createDataFrame(list(enumerate(map(bytearray, data))), "p int, data binary")
    states = {p: lm.Owner(d, words, lm.States([], p)) for p, d in enumerate(data)}
    *_, rows = lm._sums(owned, lambda p, d: lm._found(lm.Owner(d, words, lm.States([], p)), 0), slices)
    rows = rows.collect()
    assert slices > 10 and len(rows) == len({(r["p"], r["slice"]) for r in rows}) <= 2 * slices and all(0 <= r["slice"] < slices for r in rows)
    for p, owner in states.items():
        sent = np.concatenate([np.frombuffer(r["hash"], np.uint64) for r in sorted(rows, key=lambda r: r["slice"]) if r["p"] == p])
        assert (sent == owner.own).all()


def test_frequent_words_have_several_restaurants(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "the", "of", f"w{rng.randrange(300)}"]) for _ in range(40)) for _ in range(50)]
    monkeypatch.setattr(lm, "CLASS_TOKENS", 200)
    for owners in (1, 3):
        words, data, _ = small_model(texts, 150, owners)
        unpacked = [lm.Types.unpacked(lm.unpack(d, lm.OWNED)[:8])[0] for d in data]
        of_the = {c for t in unpacked for v, c in zip(t.last.tolist(), t.classes.tolist()) if v == 0}
        assert len(of_the) == 1 + words.counts[0] // 200 and len(data) == owners
        assert all(c == 0 for t in unpacked for v, c in zip(t.last.tolist(), t.classes.tolist()) if v >= 150 or words.counts[v] < 200)
        assert sum(lm.Owner(d, words).count.sum() for d in data) == words.tokens


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 300
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "a b", 4), (None, "x" * 3_000_000, 5), (3, "!! " * 9, 6)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (None, 1)], "doc_id long, quality int")
    for some in (labels, labels.where("false")):
        found = quality.score_documents(docs, some).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 5) for r in found)
    assert quality.keep_good(docs, labels.where("false")).schema == docs.schema
    assert quality.score_documents(docs.where("false"), labels).count() == 0


def test_the_sample_has_one_text_of_an_id_and_a_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good text {i} " * (1 + i % 3) if i % 2 else "bad; bad; " * 9) for i in range(200)] * 3 + [(1, "another")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, y, shares: seen.append((texts.to_pylist(), y.tolist())))
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "MAX_FIT_CHARS", 2000)
    quality.train(docs, labels)
    (every, y), (few, _) = seen
    assert len(every) == len(y) == sum(not held(i, 5) for i in range(200)) and sum(map(len, few)) <= 2000 and few == every[: len(few)] and few


def test_the_driver_does_not_fit(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    same = quality.train(docs, labels), quality.train_by_task(docs, labels)
    assert all((one == other).all() for one, other in zip((same[0].words, *same[0].layers), (same[1].words, *same[1].layers), strict=True))
    fit, here = quality.fit, os.getpid()
    monkeypatch.setattr(quality, "fit", lambda *given: fit(*given)._replace(constant=float(os.getpid())))
    assert here not in {r["score"] for r in quality.score_documents(docs, labels).collect()}


def test_pooled_sums_do_not_depend_on_blocks():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 0, 5, 5, 40, 41, 100, 100])
    rows, vectors = rng.integers(0, 9, 100), rng.normal(size=(9, 4))
    want = np.array([vectors[rows[a:b]].sum(0) for a, b in zip(bounds[:-1], bounds[1:])])
    for block in (1, 3, 7, 1000):
        assert quality._sums(rows, bounds, vectors, block) == pytest.approx(want)


def test_shapes_tell_repeated_tokens():
    p = quality.pieces(pa.array(["So so So", "So"]))
    assert (p.shapes == quality.SHAPES - 1).tolist() == [False, True, True, False]
