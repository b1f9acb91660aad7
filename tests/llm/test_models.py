import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import pitman_yor as P
from helixframe.llm import scoring as S
from helixframe.llm import toxicity as X

SCHEMA = "doc_id long, text string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus():
    r = random.Random(8)
    langs = [["the", "of", "and", *[f"thing{i}" for i in range(40)]], ["de", "la", "que", *[f"cosa{i}ñ" for i in range(40)]]]
    rows = []
    for i in range(400):
        words = langs[i % 2]
        weights = [30, 15, 10, *[1] * 40]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w.upper() if r.random() < 0.1 else w for w in r.choices(words, weights, k=r.choice([0, 1, 5, 60])))))
    return rows + [(1000, None), (1001, ""), (1002, "x" * 70_000 + " b"), (None, "null id"), (7, "again"), (7, "again")]


def test_counts_and_baseline_equal_brute_force_and_context_helps(spark, monkeypatch):
    for name, value in {"CHUNK": 2000, "WORDS": 3000, "TRIPLES": 2000, "ROOM": 400}.items():
        monkeypatch.setattr(S, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as word", "'c' as chunk", "true as learn")
    got = S.language_scores(df).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    count = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        own = tokens(t)
        want.append((i, held(i), len(own), sum(count[x] > 0 for x in own), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)))
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    out = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert S.language_scores(df.limit(0)).count() == 0


def test_spelling_is_a_distribution_and_knows_its_words():
    import pyarrow as pa

    words = [b"station", b"nation", b"ration", b"a", b"\xc3\xb1u"] * 20
    cells, word, _ = P.spelt(pa.array(words, pa.binary()))
    at, back = np.unique(cells, return_inverse=True)
    table = P.spelling(at, np.bincount(back), np.random.default_rng(1))
    sums = np.exp(table.astype(float)).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)
    p = P.base_probability(pa.array([b"nation", b"xqzvkw", b""], pa.binary()), table)
    assert p[0] > 1e-3 > p[1] > 0 and p[2] == P.END_BASE


@pytest.mark.parametrize("c", [1, 5, 40, 5000])
def test_tables_have_the_mean_of_sequential_seating(c):
    rng, runs, parent, d = np.random.default_rng(c), 400, 0.05, 0.5

    def one():
        t = 1
        for n in range(1, c):
            new = (P.STRENGTH + d * (100 + t)) * parent
            t += rng.random() < new / (n - d * t + new)
        return t

    n = 400 if c < 1000 else 60
    want = np.array([one() for _ in range(n)])
    got = P.seats(np.full(runs, float(c)), np.full(runs, 100.0), np.full(runs, parent), d, rng)
    assert (got >= 1).all() and (got <= c).all()
    assert abs(got.mean() - want.mean()) <= 4 * (want.std() / np.sqrt(n) + got.std() / np.sqrt(runs)) + 0.02 * want.mean()


def toxic_rows():
    r = random.Random(2)
    plain = [f"wort{i}" for i in range(300)] + ["the", "and"] * 30
    rows, labels = [], []
    for i in range(900):
        words = r.choices(plain, k=r.choice([3, 20, 80]))
        bad = r.random() < 0.25
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "Scum,", "loweia", "loweib", "loweic", "loweid" + str(i % 7)]))
        rows.append((i, " ".join(words), ["en", "de"][i % 2]))
        labels.append((i, int(bad)))
    return rows, labels


def test_score_depends_on_the_order_of_words(spark):
    r = random.Random(4)
    follows = {k: [(3 * k + j) % 40 for j in range(2)] for k in range(40)}

    def text():
        out = [r.randrange(40)]
        while len(out) < 40:
            out.append(r.choice(follows[out[-1]]))
        return [f"w{k}" for k in out]

    rows = [(i, text()) for i in range(600)]
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    mixed = [(i, r.sample(t, len(t))) for i, t in held]
    scores = {}
    for x in S.language_scores(spark.createDataFrame([(i, " ".join(t)) for i, t in rows + mixed], SCHEMA)).filter("held_out").collect():
        scores.setdefault(x.doc_id, []).append(x.score)
    assert len(scores) == len(held) and all(len(x) == 2 and abs(x[0] - x[1]) > 5 for x in scores.values())


def test_classifier_learns_without_held_out_labels(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (5000, None, None), (5001, "", "xx"), (None, "idiot", "en")], "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'t' as toxic", "'r' as row")
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [(i, 1 - y if i in held else y) for i, y in labels]
    model = X.train(docs, spark.createDataFrame([*wrong, (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int"))
    got = X.toxicity(docs, model).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    right = sum((score[i] >= 0.3) == bool(truth[i]) for i in held) / len(held)
    assert right > 0.95
    assert score[5000] == score[5001] < 0.3 < score[None]
    kept = X.without_toxic(docs, model)
    assert kept.columns == docs.columns and 600 < kept.count() < 760
    assert X.toxicity(docs.limit(0), model).count() == 0


def test_thresholds_stand_between_scores():
    scores, labels = np.array([0.9, 0.8, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0, 0])
    assert X.best_threshold(scores, labels) == pytest.approx((0.8 + 0.3) / 2)
    assert X.best_threshold(np.array([0.9, 0.2]), np.array([1, 0])) == pytest.approx(0.55)


def test_training_without_labels_scores_all_alike(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    model = X.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.score for r in X.toxicity(docs, model).collect()}) == 1


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = X.initial(20, rng)
    w.out[:] = rng.normal(0, 1, len(w.out))
    w = X.Weights(w.embedding.astype(float), [c.astype(float) for c in w.conv], [rng.normal(0, 0.1, len(b)) for b in w.bias], w.out.astype(float), w.out_bias.astype(float))
    ids, counts = rng.integers(0, 20, (15, X.PARTS)), np.array([4, 0, 1, 10])
    y = np.array([1, 0, 1, 0.0])

    def loss():
        z = X.forward(w, ids, counts)[3].astype(float)
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean())

    flat, where, features, z = X.forward(w, ids, counts)
    grads = X.gradients(w, flat, where, features, ((1 / (1 + np.exp(-z)) - y) / len(y)))
    dense = np.zeros_like(w.embedding)
    dense[grads[0][0]] = grads[0][1]
    grads = [dense, *grads[1:]]
    for a, g in zip(w.arrays(), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in a.shape)
            if a is w.embedding and at[0] == 0:
                continue
            old, h = a[at], 1e-6
            a[at] = old + h
            up = loss()
            a[at] = old - h
            down = loss()
            a[at] = old
            assert abs((up - down) / (2 * h) - g[at]) < 1e-4


def test_thresholds_come_from_rows_that_nothing_is_fitted_on(spark, monkeypatch):
    """A language whose set-aside rows all have one label has no threshold of its own, whatever its fitted rows have."""
    rows, labels = toxic_rows()
    docs, given = spark.createDataFrame([*rows, (3, "another text of one id", "en"), rows[4]], "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = {}
    fit = X.fit

    def spied(texts, toxic, size):
        weights, aside = fit(texts, toxic, size)
        seen["n"], seen["aside"] = len(texts), aside
        return weights, aside

    monkeypatch.setattr(X, "fit", spied)
    monkeypatch.setattr(X, "LEAST_TOXIC", 3)
    model = X.train(docs, given)
    assert len(seen["aside"]) == seen["n"] // 10 and set(model.thresholds) == {"en", "de"} and all(0 < t < 1 for t in model.thresholds.values())
    monkeypatch.setattr(X, "LEAST_TOXIC", 60)  # more than are set aside
    assert X.train(docs, given).thresholds == {}


def test_very_long_text_is_scored(spark):
    rows, labels = toxic_rows()
    model = X.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = [(1, "wort1 the " * 150_000, "en"), (2, "wort1 the " * 150_000 + "idiot", "en")]
    score = {r.doc_id: r.score for r in X.toxicity(spark.createDataFrame(long, "doc_id long, text string, lang string"), model).collect()}
    assert score[1] < 0.3 < score[2]


def test_all_labelled_documents_teach(spark):
    """Beyond `most`, documents that the start doesn't have teach too: a word that stands only in those is learnt."""
    rows, labels = toxic_rows()
    first = {r.doc_id for r in spark.createDataFrame(labels, "doc_id long, toxic int").filter(X.id_bucket("doc_id", 4) != 2).orderBy(X.F.xxhash64("doc_id", X.F.lit(6))).limit(150).collect()}
    truth = dict(labels)
    rows = [(i, "wort1 the " + ("grobian" if truth[i] else "wort2") + " and" if i not in first else t, lang) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), 300)
    asked = spark.createDataFrame([(1, "wort1 the grobian and", "en"), (2, "wort1 the wort2 and", "en")], "doc_id long, text string, lang string")
    score = {r.doc_id: r.score for r in X.toxicity(asked, model).collect()}
    assert score[1] > 0.5 > 0.3 > score[2]
    assert {r.score for r in X.toxicity(asked, X.train(docs.repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, toxic int"), 300)).collect()} == set(score.values())


def test_vocabulary_is_sent_to_tasks_as_its_hashes():
    """Its tables, 6 MB, stay out of what the driver pickles; of hashes in one slot the more frequent has it."""
    import pickle

    hashes = np.random.default_rng(3).integers(0, 1 << 63, 60_000).astype(np.uint64)
    hashes[59_999] = hashes[5] ^ (np.uint64(1) << np.uint64(40))
    v = X.Vocabulary(hashes)
    sent = pickle.dumps(v)
    assert len(sent) < 600_000
    there, slots = pickle.loads(sent), {}
    for row, h in enumerate(hashes.tolist(), 1):
        slots.setdefault(h % X.SLOTS, (row, h))
    want = [slots[h % X.SLOTS][0] if slots[h % X.SLOTS][1] == h else 0 for h in hashes.tolist()]
    assert there.size == v.size == 60_001 and there(hashes).tolist() == v(hashes).tolist() == want and want[5] == 6 and want[-1] == 0
    assert X.Vocabulary(hashes[:0])(hashes).tolist() == [0] * 60_000


def test_round_brings_each_weight_to_the_driver_once(spark, monkeypatch):
    """Means come as 4-byte numbers in runs of CHUNK, in an Arrow table, whatever the partitions; they are the weighted mean of the parts."""
    rng, got = np.random.default_rng(5), []
    ids = [rng.integers(1, 50, (3, 8)).astype("<u2") for _ in range(90)]
    rows = spark.createDataFrame([(i % 2, 48, bytes(X.pa.compress(x.tobytes(), "zstd", asbytes=True)), 1000 * i) for i, x in enumerate(ids)], "toxic int, size long, ids binary, h long")
    w = X.initial(9_000, np.random.default_rng(1))
    kind, real = type(rows), type(rows).toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: got.append(real(self)) or got[-1])
    monkeypatch.setattr(kind, "collect", lambda self: pytest.fail("rows of Python objects"))
    monkeypatch.setattr(X, "SHARD", 30)
    out = X.taught(rows.repartition(5), 90, w, 0)
    again = X.taught(rows.repartition(2), 90, w, 0)
    numbers = sum(a.size for a in w.arrays())
    assert sum(map(len, got[0].column("v").to_pylist())) == 4 * numbers and max(map(len, got[0].column("v").to_pylist())) == 4 * X.CHUNK
    assert all(a.dtype == np.float32 and (a == b).all() for a, b in zip(out.arrays(), again.arrays(), strict=True))
    assert [a.shape for a in out.arrays()] == [a.shape for a in w.arrays()] and not (out.out == w.out).all()
