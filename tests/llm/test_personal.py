import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from helixframe.llm import personal as P

SCHEMA = "doc_id long, text string"
# Fixed values of the contract, as they stand there.
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, text):
    number = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(number)))
        return 14 <= len(number) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(number) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, pattern) in enumerate(BASE) for m in re.finditer(pattern, text) if passes(kind, m.group()))


def digest(spans):
    return hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def noise(r):
    parts = ["a.b@c.d", "x@y", "@", "a@b.c@d.e.f", "..@a.b", "é@a.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "1..2.3.4.5", "000255.0.0.1", "4539 5787 6362 1486", "4539578763621486", "4539-5787-6362-1486 4539578763621486",
             "+1 (487) 555-7209", "+1", "+49 30 1234567 ", "+1.2.3.4.5.6.7.8.9.0.1", "++1 222 333 4444", "12", " ", "\n", "-", "+", ".", "日本", "(555) 1234567", "5550123", "joe@localhost", "()+-."]
    return "".join(r.choice(parts) + r.choice(["", " ", " ", "."]) for _ in range(r.randrange(0, 14)))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        text = noise(r)
        assert P.base_spans(text) == brute(text), text
        base, found = P.spans_of(text)
        taken = [(a, b) for a, _, b in base]
        more = sorted((a, b) for a, b, kind, *_ in found if kind < 0)
        assert all(b <= c or d <= a for a, b in more for c, d in taken), text
        assert all(x[1] <= y[0] for x, y in zip(more, more[1:], strict=False)) and all(0 <= a < b <= len(text) for a, b in more), text


def test_long_texts_take_time_in_proportion():
    for text in ("1" * 2_000_000, "a" * 2_000_000, "a." * 1_000_000 + "@", "1." * 1_000_000, "+1" + " " * 2_000_000, "a@" * 1_000_000, "(" * 2_000_000 + "5", "1 " * 1_000_000, "." * 2_000_000 + "12345" + "." * 2_000_000):
        assert all(kind >= 0 for _, kind, _ in P.base_spans(text)) and P.spans_of(text)


def corpus():
    r = random.Random(2)
    phone = lambda: f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}"
    filler = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "of", "the"]) + str(r.choice(["", "", "."])) for _ in range(n))
    rows = [(i, f"{filler(9)} please call me at {phone()} {filler(5)}") for i in range(30)]
    rows += [(100 + i, f"{filler(4)}\nCall  me at: (212) 555-01{i:02d}, {filler(3)}".replace("at:", "at")) for i in range(5)]
    rows += [(200 + i, f"write to user{i}@mail.example.org today") for i in range(8)] + [(300, "write to boss@intranet today"), (301, "we met boss@intranet there")]
    rows += [(400 + i, f"order no {r.randrange(10**6, 10**7)} {filler(6)}") for i in range(40)]
    rows += [(500 + i, f"call me at the bar {filler(8)}") for i in range(5)] + [(600, "order no +1 (487) 555-7209"), (601, "she said 5550199 and hung up")]
    rows += [(700 + i, None if i else "") for i in range(3)] + [(100, rows[30][1]), (None, rows[30][1]), (None, None)]
    return rows


def brute_bootstrap(occurrences, turns):
    """(instance, kind, belief) by plain sums over all edges."""
    edges, seed, may = defaultdict(set), {}, Counter()
    for key, kind, bits, patterns in occurrences:
        seed[key] = max(kind, seed.get(key, -1))
        may[key] |= bits
        for p in patterns:
            edges[p].add(key)
    known = {k: (s, P.UNIT) for k, s in seed.items() if s >= 0}
    found = {}
    for _ in range(turns):
        sure = {}
        for p, keys in edges.items():
            sums = Counter()
            for k in keys:
                if k in known:
                    sums[known[k][0]] += known[k][1]
            sure |= {(p, kind): n // len(keys) for kind, n in sums.items() if n >= P.LEAST_KNOWN * P.UNIT and n // len(keys) >= P.SURE}
        found = {}
        for k in seed:
            if seed[k] < 0:
                lack = Counter()
                for (p, kind), s in sure.items():
                    if k in edges[p] and may[k] >> kind & 1:
                        lack[kind] += round(-math.log(1 - min(s, P.UNIT - 1) / P.UNIT) * P.UNIT)
                if lack:
                    kind = max(lack, key=lambda x: (lack[x], -x))
                    found[k] = (kind, math.floor((1 - math.exp(-lack[kind] / P.UNIT)) * P.UNIT))
        known = {k: (s, P.UNIT) for k, s in seed.items() if s >= 0} | found
    return sorted((k, *v) for k, v in found.items())


def test_spans_of_a_corpus_with_unseen_identifiers(spark):
    rows = corpus()
    out = P.personal_spans(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in out.collect())
    occurrences = [(f[4], f[2], f[3], f[5]) for _, t in rows for f in P.spans_of(t or "")[1]]
    known = {k: kind for k, kind, _ in brute_bootstrap(occurrences, P.TURNS)}
    want = []
    for i, text in rows:
        base = brute(text or "")
        more = [(a, known[key] + 4, b) for a, b, kind, _, key, _ in P.spans_of(text or "")[1] if kind < 0 and key in known]
        names = (*P.KINDS, *P.ADDED)
        counts = [sum(s[1] == k for s in base) for k in range(4)]
        want.append((-1 if i is None else i, *counts, digest(base), ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(base + more))))
    assert got == sorted(want)
    spans = {i: s for i, *_, s in got}
    assert all(spans[100 + i].startswith("like_phone:") for i in range(5))
    assert spans[300].startswith("like_email:") and spans[301].startswith("like_email:")
    assert all(spans[400 + i] == "" for i in range(40)) and spans[601] == "" and spans[500] == ""


def test_scores_equal_plain_sums_on_random_graphs(spark):
    r = random.Random(4)
    kinds = {f"k{i}": i % 4 if r.random() < 0.9 else -1 for i in range(200)}
    occurrences = []
    for _ in range(1500):
        i = int(200 * r.random() ** 2)
        own = i % 4 if r.random() < 0.97 else r.randrange(4)
        occurrences.append((f"k{i}", kinds[f"k{i}"] if r.random() < 0.9 else -1, 15 if kinds[f"k{i}"] < 0 else 0, [f"p{r.randrange(25)}", f"q{own}{r.randrange(4)}"]))
    df = spark.createDataFrame(occurrences, "key string, kind int, may int, patterns array<string>")
    patterns, found = P.bootstrapped(df)
    got = sorted(map(tuple, found.collect()))
    want = brute_bootstrap(occurrences, P.TURNS)
    assert want and [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) <= 2 for a, b in zip(got, want, strict=True))
    assert all(p.sure >= P.SURE for p in patterns.collect())


def test_patterns_can_be_read(spark):
    found = {r.pattern: r.kind for r in P.lexical_patterns(spark.createDataFrame(corpus(), SCHEMA)).collect()}
    assert found["me at _0"] == "phone" and found["write to _@"] == "email" and not any("order" in p for p in found)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")]])
def test_empty_input(spark, rows):
    out = P.personal_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and all(r.spans == "" and r.n_email == r.n_phone == 0 and r.base_sha256 == digest([]) for r in out)


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([("a", "mail a@b.de", 1, "x", None)], "doc_id string, text string, row int, key string, found string")
    assert [tuple(r)[:2] + (r.spans,) for r in P.personal_spans(docs).collect()] == [("a", 1, "email:5:11")]
