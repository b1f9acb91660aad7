import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, least):
    count, docs, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms(text)
        for t in found:
            count[lang, source, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        own = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in own.items()}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            more = [(t, p[s][t] - p[None][t]) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found, 1) if part == "pair" or k <= 50]
    return sorted(out)


def corpus(n=400):
    r = random.Random(5)
    names = ["Über", "the", "THE", "a", "ß", "éa", "日本", "x1y", "tie", "tye", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(names[: r.choice([8, 20, len(names)])]) for _ in range(r.choice([0, 1, 5, 40])))
        rows.append((i, r.choice([text, text + ".\n--", None]), r.choice(["en", "en", "de", None, "xx"]), r.choice(["a", "a", "a", "b", "", None, "Z"])))
    rows += [(1, rows[1][1], *rows[1][2:])] * 3 + [(None, "the " * 50_000, "en", "long"), (7, None, "fr", "only"), (8, "", "none", "p"), (9, "4 5 6", "none", "q")]
    return rows


@pytest.mark.parametrize("least, group", [(1, 1 << 18), (6, 10), (10**6, 1 << 18)])
def test_equals_counts_of_all_terms(spark, monkeypatch, least, group):
    monkeypatch.setattr(D, "GROUP", group)
    rows = corpus()
    found = D.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), least)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, least)


def test_columns_of_other_types_and_clashing_names(spark):
    rows = [(i, "same words here", "en", i % 2, "x", 1.0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source int, term string, n double")
    found = sorted(map(tuple, D.source_divergence(docs).collect()))
    assert found == [("en", "0", "pair", "1", 0, 1), ("en", "1", "pair", "0", 0, 1)]


def test_empty_tables(spark):
    assert D.source_divergence(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_ties_go_by_bytes_and_only_fifty_terms_stay(spark):
    names = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    rows = [(i, " ".join(names), "en", "a") for i in range(30)] + [(99, "é", "en", "b")]
    found = D.source_divergence(spark.createDataFrame(rows, SCHEMA)).filter("part = 'term'").orderBy("rank").collect()
    assert [r["item"] for r in found] == [] and brute(rows, 30)  # only b lacks terms: a has no more of them than the language
    rows += [(100 + i, "é", "en", "b") for i in range(30)]
    found = D.source_divergence(spark.createDataFrame(rows, SCHEMA)).filter("part = 'term' and source = 'a'").orderBy("rank").collect()
    assert [r["item"] for r in found] == names[:50] and [r["rank"] for r in found] == list(range(1, 51))


def test_scans_over_any_cut_of_batches(monkeypatch):
    """What a task holds is sent in parts, and a term may go on from one batch to the next."""
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in corpus(150)]
    want = Counter()
    for t, lang, s in rows:
        for x in terms(t):
            want[lang, x, s] += 1
    schema = pa.schema([("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])
    for held, size in ((8, 7), (1 << 20, 50)):
        monkeypatch.setattr(D, "HELD", held)
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
        runs = pa.Table.from_batches(D.first_scan(batches))
        runs = runs.sort_by([(k, "ascending") for k in ("lang", "term", "source")])
        for chunk in (1, 3, 1000):
            out = pa.Table.from_batches(D.second_scan(1)(runs.combine_chunks().to_batches(max_chunksize=chunk))).to_pylist()
            assert {(r["lang"], r["term"], r["source"]): r["n"] for r in out} == want
            total = Counter()
            for (lang, t, _), n in want.items():
                total[lang, t] += n
            assert all(r["total"] == total[r["lang"], r["term"]] for r in out) and sum(r["first"] for r in out) == len(total)


def test_shares_of_large_counts_are_exact():
    r = random.Random(3)
    whole = [r.randrange(1, 9 * 10**16) for _ in range(200)]
    count = [r.randrange(0, max(1, w - 5)) for w in whole]
    found = D.share(np.array(count), np.array(whole))
    assert found.tolist() == [1 + 10**9 * (c + 5) // w for c, w in zip(count, whole, strict=True)]
