import hashlib
import random
import re

import pytest

from chronoframe.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for item, content in items:
        w = words(content)
        size = min(10, len(w))
        for at in range(len(w) - size + 1 if size else 0):
            for start in range(len(doc) - size + 1):
                if doc[start : start + size] == w[at : at + size]:
                    hit.update(range(start, start + size))
                    found.add("null" if item is None else str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def tables():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 4, 6, 10, 11, 25]))) for i in range(25)] + [(7, "w1 w2"), (None, "w5 w5 w5"), (40, None), (41, "...")]
    docs = [(i, say(rng.randrange(80))) for i in range(60)]
    docs += [(100 + i, say(8) + " " + items[i][1].upper() + ", " + say(5)) for i in range(25)]
    docs += [(200, None), (201, ""), (None, "w1 w2 w3"), (0, docs[0][1]), (202, "x " * 30000 + items[5][1])]
    return docs, items


@pytest.mark.parametrize("max_words", [10**6, 40, 13])
def test_hits_agree_with_brute_force(spark, max_words):
    docs, items = tables()
    found = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_words)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((d, *brute(t, items)) for d, t in docs), key=key)


def test_slices_take_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "k"), (2, "z", 8, None)], "doc_id long, text string, _key int, _hit string")
    items = spark.createDataFrame([(1, "A-b"), (2, "q r s")], "item_id long, text string")
    found, names = decontaminate.annotate(docs, items, docs.columns, 2)
    assert found.columns == [*docs.columns, *names]
    assert sorted((r["_key"], r["n_hit"]) for r in found.collect()) == [(7, 2), (8, 0)]


def test_clean_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "q"), (2, "z", 6, None)], "doc_id long, text string, n_words int, contaminated string")
    items = spark.createDataFrame([(1, "A-b")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, items).collect()] == [(2, "z", 6, None)]
    assert decontaminate.clean(docs, items.where("false")).count() == 2
    assert decontaminate.clean(docs.where("false"), items).columns == docs.columns


def test_words_are_compared_byte_by_byte():
    import pyarrow as pa

    column = pa.array(["x A b C, d", "a b c"])
    tokens, data = decontaminate._words(column)
    hashes, _ = decontaminate._words(pa.array(["a b c"]))
    index = decontaminate.Index([("i", hashes.hash, [b"a", b"b", b"c"])])
    counts: dict = {}
    index.count(tokens, counts)
    index.order(counts)
    assert index.matches(tokens, data)[0].tolist() == [1, 5]
    index.spelt[index.words.tolist().index(int(hashes.hash[1]))] = b"other"  # as if the document's word had but its hash
    assert index.matches(tokens, data)[0].tolist() == []
    with pytest.raises(ValueError):
        decontaminate.Index([("i", hashes.hash[[0, 0]], [b"a", b"b"])])
