import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    vocab = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(30)) for i in range(8)]
    rows, labels = [], []
    for i in range(700):
        bad = r.random() < 0.25
        w = text(60).split()
        if bad:
            w.insert(r.randrange(60), r.choice(["scumbag", "moron"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(bad)))
    clean = [x for x, y in zip(rows, labels, strict=True) if not y[1]]
    source = {}
    plants = {}
    for k in range(20):
        base = clean[k][1]
        source[1000 + k], source[2000 + k] = clean[k][0], clean[100 + k][0]
        plants[1000 + k] = base.replace(" ", "  ", 3)  # an exact copy
        w = clean[100 + k][1].split()
        w[30] = "changed"
        plants[2000 + k] = " ".join(w)  # a near copy by five words: 51 of 61 runs
        plants[3000 + k] = text(20) + " " + items[k % 8][1] + " " + text(20)
        plants[4000 + k] = text(40) + " moron " + text(10)
    rows += [(i, t, "en", "s", 0) for i, t in plants.items()] + [(5000, "", "en", "s", 0), (5001, None, None, None, None), (None, text(40), "de", "s", 1), (6000, text(30), "en", "s", 0), (6000, "other " + text(30), "en", "s", 0)]
    r.shuffle(rows)
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, source, dict(labels)


def test_each_stage_takes_what_it_should(spark, tables, tmp_path):
    path, source, labels = tables
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), [f.split()[0] for f in COLUMNS.split(", ")]
    kept = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, kept[-1], path)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    gone = [a - b for a, b in zip(ids, ids[1:], strict=False)]
    toxic = {i for i, y in labels.items() if y} | set(range(4000, 4020))
    assert len(gone[0] & toxic) >= 0.97 * len(toxic) and len(gone[0] - toxic) <= 5
    copies = {i for i in range(1000, 1020) if i in ids[1] and source[i] in ids[1]}
    assert gone[1] >= copies and gone[1] <= set(range(1000, 1020)) | {5001}
    assert {5000, 5001} & gone[1] == {5001}
    assert gone[2] >= {i for i in range(2000, 2020) if i in ids[2] and source[i] in ids[2]} and len(gone[2] - set(range(2000, 2020))) <= 2
    assert gone[3] == set(range(3000, 3020)) & ids[3]
    assert None in ids[4] and kept[4].filter("doc_id = 6000").count() == 2
    packed = pipeline.STAGES[-1][1](spark, kept[4], path)
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 2048 and (r.n == 2048 or r.n & (r.n - 1) == 0) for r in whole)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids[4]
    assert pipeline.run(spark, path).count() == packed.count()


def test_rows_without_id_are_compared_like_others(spark, tables):
    path, *_ = tables
    r = random.Random(9)
    text = lambda n: " ".join(r.choice([f"other{i}" for i in range(500)]) for _ in range(n))
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    a, b, c = text(60), text(60), text(60)
    near = " ".join(["changed" if i == 30 else w for i, w in enumerate(b.split())])
    rows = [(1, a), (None, a), (None, a.replace(" ", "  ", 1)), (2, b), (None, near), (None, c), (None, c), (None, f"{text(20)} {item} {text(20)}"), (None, text(60))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    for stage, left in zip(pipeline.STAGES[1:4], [6, 5, 4], strict=True):
        docs = pipeline.written(stage[1](spark, docs, path))
        assert docs.count() == left
    assert sorted(str(x.doc_id) for x in docs.collect()) == ["1", "2", "None", "None"]


def test_stages_take_empty_tables_and_more_columns(spark, tables, tmp_path):
    path, *_ = tables
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0).withColumns({"score": F.lit(1), "h": F.lit("x"), "row": F.lit(2), "kept": F.lit(True)})
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, none, path)
        assert out.count() == 0
        if i + 1 < len(pipeline.STAGES):
            assert out.columns == none.columns


def test_rows_that_share_an_id_are_judged_each_by_its_own_text(spark, tables):
    path, *_ = tables
    r = random.Random(12)
    text = lambda n: " ".join(r.choice([f"shared{i}" for i in range(500)]) for _ in range(n))
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    a, b, c, d, e = (text(60) for _ in range(5))
    near = " ".join(["changed" if i == 30 else w for i, w in enumerate(b.split())])
    extra = {"row": F.lit(1), "whole": F.lit("x"), "key": F.lit(2), "component_id": F.lit(3), "kept": F.lit(False), "h": F.lit("y")}

    def left(stage, rows):
        out = pipeline.STAGES[stage][1](spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS).withColumns(extra), path)
        assert out.columns == [f.split()[0] for f in COLUMNS.split(", ")] + list(extra)
        return sorted((x.doc_id, x.text) for x in out.collect())

    assert left(1, [(1, a), (5, a), (5, c)]) == sorted([(1, a), (5, c)])
    assert left(1, [(5, a), (5, a), (7, a), (5, c), (7, d)]) == sorted([(5, a), (5, c), (7, d)])
    assert left(2, [(1, b), (5, near), (5, c)]) == sorted([(1, b), (5, c)])
    assert left(2, [(9, b), (5, near), (5, b), (9, c)])[0][0] == 5 and len(left(2, [(9, b), (5, near), (5, b), (9, c)])) == 2
    assert left(3, [(1, a), (5, f"{d} {item}"), (5, e)]) == sorted([(1, a), (5, e)])
