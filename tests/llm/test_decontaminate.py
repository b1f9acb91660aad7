import hashlib
import random
import re

import pytest

import helixframe.llm.decontaminate as D

SCHEMA = "doc_id long, text string"


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if own := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [10, 4])
def test_hits_equal_brute_force(spark, window):
    r = random.Random(window)
    vocab = ["the", "of", "é", "ß7", *[f"w{i}" for i in range(12)]]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(30)] + [(100, None), (101, ""), (102, "..."), (7, "again one two"), (None, "null id item here"), (103, "unseen unseen2 unseen3")]
    docs = []
    for i in range(120):
        w = words(text(r.choice([0, 1, 3, 12, 60])))
        for _ in range(r.randrange(3)):
            src = words(r.choice(items)[1])
            at = r.randrange(len(w) + 1)
            a = r.randrange(max(1, len(src)))
            w[at:at] = src[a:] if r.random() < 0.5 else src
        docs.append((i, "".join(x.upper() + r.choice([" ", ", ", "\n-"]) if r.random() < 0.3 else x + " " for x in w)))
    docs += [(500 + i, "HOT passage: " + items[7][1] + "!") for i in range(60)] + [(900, None), (901, ""), (3, "twice " + items[4][1]), (None, items[5][1]), (902, "pad " * 20_000 + items[6][1])]
    a = spark.createDataFrame(docs, SCHEMA).repartition(3).selectExpr("*", "1 as row", "'r' as runs", "2 as n_words")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as window")
    assert sorted(map(tuple, D.contamination(a, b, window).collect()), key=repr) == brute(docs, items, window)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.contamination(docs, items).collect()] == [(1, 3, 0, 0)]
    assert D.contamination(docs.limit(0), items.union(spark.createDataFrame([(1, "a")], "item_id long, text string"))).count() == 0
