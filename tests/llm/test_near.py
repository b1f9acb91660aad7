import random
import re

import numpy as np
import pytest

from helixframe.llm.near import near_components
from helixframe.llm.superminhash import EMPTY, signatures
from helixframe.llm.textkernel import U, mix

SCHEMA = "doc_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))}


def brute(rows, width, per=80, of=100):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and of * len(a & b) >= per * len(a | b):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    out = []
    for i, a in sets:
        c = None if i is None else find(i)
        out.append((i, len(a), c, i == c))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}é" if k % 3 else f"W{k}" for k in range(60)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 5, 30, 80, 200]))]
        for _ in range(r.choice([1, 2, 4, 9])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append((n, r.choice([" ", "\n", " \t"]).join(own)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rows = corpus(width)
    got = near_components(spark.createDataFrame(rows, SCHEMA), width).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width)


def test_nulls_empty_texts_repeated_rows_and_long_chains(spark):
    words = [f"t{i}" for i in range(130)]
    chain = [(100 + i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(17)]  # each is linked with the next alone
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (9, "a b c d"), (9, "a b c d"), (8, "a  b c D"), *chain]
    got = near_components(spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as h1", "'x' as keys"), 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)
    assert near_components(spark.createDataFrame([], SCHEMA), 2).count() == 0


def test_components_in_rounds(spark, monkeypatch):
    from helixframe.llm import graph

    monkeypatch.setattr(graph, "ONE_TASK", 0)
    r = random.Random(4)
    nodes = list(range(400))
    r.shuffle(nodes)
    chain = [(nodes[i], nodes[i + 1]) for i in range(300) if i % 100 != 99 or i == 299]
    links = chain + [(900, x) for x in range(901, 960)] + [(5000, 5000), (None, 3)]
    r.shuffle(links)
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()))
    want = {}
    for k in range(3):
        part = nodes[k * 100 : (k + 1) * 100]
        want |= dict.fromkeys(part, min(part))
    want |= dict.fromkeys(range(900, 960), 900)
    last = nodes[300]  # the third chain ends with it
    want[last] = min(min(nodes[200:300]), last)
    if want[last] == last:
        want |= dict.fromkeys(nodes[200:300], last)
    assert got == want


def test_signature_agreement_estimates_jaccard():
    m, errors = 128, []
    for seed in range(40):
        elements = mix(np.arange(seed * 1000, seed * 1000 + 150, dtype=U))
        a, b = np.sort(elements[:120]), np.sort(elements[30:])
        sig = signatures(np.concatenate([a, b]), np.array([120, 120]), m)
        errors.append((sig[0] == sig[1]).mean() - 90 / 150)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < np.sqrt(0.6 * 0.4 / m) * 1.05
    assert (signatures(np.empty(0, U), np.array([0]), 8) == EMPTY).all()
    alone = signatures(mix(np.arange(1, dtype=U)), np.array([1]), 64)[0]
    assert sorted(int(x) >> 32 for x in alone) == list(range(64))  # one element ranks every slot once


@pytest.mark.parametrize("small", [False, True])
def test_filter_keeps_every_link(spark, monkeypatch, small):
    from pyspark.sql import functions as F

    from helixframe.llm import near

    if small:
        for name in ("LIST", "AT_ONCE"):
            monkeypatch.setattr(near, name, 3)
    rows = corpus(11)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in near.prefix_pairs(docs.select("doc_id", F.col("doc_id").alias("component")), docs, 2, 80, 100).collect()}
    sets = {i: shingle_set(t, 2) for i, t in rows}
    links = {(max(i, j), min(i, j)) for i in sets for j in sets if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(links) > 50 and found >= links


def test_boilerplate_gives_no_pairs_that_cant_be_linked(spark):
    from pyspark.sql import functions as F

    from helixframe.llm import near

    r = random.Random(5)
    common = " ".join(f"common{k}" for k in range(100))
    for n in (500, 2000):
        rows = [(i, f"{common} " + " ".join(f"own{r.randrange(30)}" for _ in range(22))) for i in range(n)]
        docs = spark.createDataFrame(rows, SCHEMA)
        assert near.prefix_pairs(docs.select("doc_id", F.col("doc_id").alias("component")), docs, 2, 80, 100).count() <= n


def test_very_long_texts(spark):
    r = random.Random(6)
    words = [f"x{r.randrange(10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:118_000])), (3, " ".join(words[:50_000])), (4, "x" * 500_000)]
    got = {x.doc_id: x.component_id for x in near_components(spark.createDataFrame(rows, SCHEMA), 5).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
