import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm.exact import content_hash, exact_groups
from helixframe.llm.shard import WHOLE_GROUP, assign_shards, write_shards

SCHEMA = "doc_id long, text string"
ROWS = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (7, None), (1, ""), (3, " "), (3, " "), (None, "a b"), (8, "x" * 200_000), (6, "x" * 200_000), (4, "É\x0bé"), (None, "alone"), (11, "nbsp x")]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out, seen = [], set()
    for i, t in rows:
        own = groups[normal(t)]
        ids = [x for x in own if x is not None]
        keep = (min(ids) if ids else None) if len(own) > 1 else i
        kept = i == keep and (i, normal(t)) not in seen
        seen.add((i, normal(t)))
        out.append((i, keep, len(own), kept, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("few", [True, False])
def test_groups_equal_brute_force_even_with_collisions(spark, monkeypatch, weak, few):
    import helixframe.llm.exact as exact

    monkeypatch.setattr(exact, "BROADCAST_GROUPS", 1_000_000 if few else 0)
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as h", "'k' as keep_id", "0 as norm")
    hashed = (lambda norm: F.unhex(F.lpad(F.hex(F.length(norm) % 2), 32, "0"))) if weak else content_hash
    got = exact_groups(df, hashed).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)
    assert exact_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_every_row_has_one_slot_and_shards_are_even(spark, law):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abcé ") for _ in range(r.choice([0, 5, 40, 300])))) for i in range(1500)]
    rows += [(2000 + i, "one hot text " * 5) for i in range(900)] + [(5000 + i, None) for i in range(900)] + [(None, "no id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'s' as size", "2 as h", "3 as shard")
    got = assign_shards(df, 8, law, ranges_per_shard=16).collect()
    sizes = lambda t: len((t or "").encode()) + 8
    assert sorted(((g.doc_id, g.size, g.text_crc32) for g in got), key=repr) == sorted(((i, sizes(t), zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    by = {}
    for g in got:
        by.setdefault(g.shard, []).append(g)
    assert sorted(by) == list(range(8))
    for own in by.values():
        assert sorted(g.slot for g in own) == list(range(len(own)))
    if law == "rows":
        counts = [len(own) for own in by.values()]
        assert max(counts) - min(counts) <= 1
    else:
        total = [sum(g.size for g in own) for own in by.values()]
        assert max(total) < 1.04 * sum(total) / 8 and min(total) > 0.96 * sum(total) / 8
    assert {g.law for g in got} == {law} and {g.grown_shard for g in got} == {None}
    assert assign_shards(df.limit(0), 8, law).count() == 0
    with pytest.raises(ValueError):
        assign_shards(df, 8, "other")


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    df = spark.range(200).selectExpr("id as doc_id", "repeat('x', cast(id % 17 as int)) as text", "'en' as lang")
    write_shards(df, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_equal_brute_force(spark, law):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcé ") for _ in range(r.choice([0, 5, 40, 300])))) for i in range(900)] + [(r.randrange(5000), f"copy {k % 40}") for k in range(200)] + [(None, "no id"), (3, None)]
    n, text = 8, lambda t: (t or "").encode()
    order = sorted(rows, key=lambda x: (np.int64(np.uint64(xxhash.xxh64_intdigest(text(x[1]), seed=42))), -(2**63) if x[0] is None else x[0]))
    sizes = [len(text(t)) + 8 if law == "bytes" else 1 for _, t in order]
    starts, whole, places = np.concatenate([[0], np.cumsum(sizes)])[:-1], sum(sizes), {}
    for i, (_, t) in enumerate(order):
        places.setdefault(text(t), []).append(i)
    want = []
    for i, (doc, t) in enumerate(order):
        own = places[text(t)]
        group = sum(sizes[j] for j in own)
        middle = starts[i] if law == "rows" else starts[own[0]] + group / 2 if group <= WHOLE_GROUP * whole / n else starts[i] + sizes[i] / 2
        want.append((doc, zlib.crc32(text(t)), min(int(middle * n / whole), n - 1)))
    got = assign_shards(spark.createDataFrame(rows, SCHEMA).repartition(5), n, law, ranges_per_shard=4).collect()
    assert sorted(((g.doc_id, g.text_crc32, g.shard) for g in got), key=repr) == sorted(want, key=repr)


def test_repeats_of_one_row_are_divided(spark):
    from helixframe.llm.ranges import sampled_splitters, with_range

    rows = spark.range(20_000).selectExpr("cast(5 as long) as h", "cast(9 as long) as k", "id as row").union(spark.range(300).selectExpr("id as h", "id as k", "id as row"))
    ends = sampled_splitters(rows, ["h", "k", "row"], F.lit(1), 20_300.0, 40)
    sizes = [x["count"] for x in with_range(rows, ["h", "k", "row"], ends).groupBy("range_id").count().collect()]
    assert sum(sizes) == 20_300 and max(sizes) < 3 * 20_300 / 40
    whole = with_range(rows, ["h", "k", "row"], ends).collect()
    order = [x.range_id for x in sorted(whole, key=lambda x: (x.h, x.k, x.row))]
    assert order == sorted(order)


def test_very_long_and_empty_texts_are_placed(spark):
    rows = [(1, "x" * 3_000_000), (2, ""), (3, None), (3, None), *[(10 + i, "y" * 100_000 + str(i)) for i in range(60)]]
    got = assign_shards(spark.createDataFrame(rows, SCHEMA), 3).collect()
    total = {}
    for g in got:
        total[g.shard] = total.get(g.shard, 0) + g.size
    assert len(got) == len(rows) and sum(total.values()) == sum(len(t or "") + 8 for _, t in rows)
