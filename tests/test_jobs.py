import json
import logging
import os
import shutil
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import differ

from jobs import association_release, common, notes_screening
from jobs.queries import oracle_sql, queries

SMALLEST = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
NOTES = "doc_id long, text string, lang string, source string"


@needs_tables
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_job_equals_its_sql(spark, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    assert differ(spark, queries()[name], oracle_sql()[name], SMALLEST) is None
    assert before == {k: spark.conf.get(k) for k in before} and not spark.streams.active


def put(spark, rows, folder, name):
    """One more file in folder."""
    spark.createDataFrame(rows, NOTES).coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def notes(spark, out):
    return sorted((r.doc_id, r.text, r.lang, ",".join(r.claims), r.held) for r in spark.read.parquet(f"{out}/notes").collect())


def report(spark, out):
    return sorted((r.lang, r.source, r.notes, r.held, r.n_email) for r in spark.read.parquet(f"{out}/report").collect())


def test_only_new_notes_are_taken(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    texts, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "checkpoint"))
    put(spark, [(1, "Mail a.b@c.org or +1 (487) 555-7209.", "en", "s"), (2, "It causes death.\nNothing new. A marker", "en", "s"), (3, None, None, None)], texts, "a")
    run = lambda: notes_screening.screen(spark, texts, out, checkpoint, common.settings("notes_screening"))
    assert run() == {"read": 3, "notes": 3, "report": 2}
    first = notes(spark, out)
    assert first[0][1] == "Mail [removed] or [removed]." and first[1][3] == "causal" and first[1][4] and first[2][1] == ""
    assert run() == {"read": 0, "notes": 3, "report": 2} and notes(spark, out) == first
    put(spark, [(4, "Predicted by 10.0.0.1 and 4539578763621486", "de", "t"), (1, "Mail a.b@c.org or +1 (487) 555-7209.", "en", "s")], texts, "b")
    assert run() == {"read": 2, "notes": 5, "report": 3}
    assert [x for x in notes(spark, out) if x[0] in (2, 3)] == first[1:] and (4, "Predicted by [removed] and [removed]", "de", "predictive", True) in notes(spark, out)
    assert ("en", "s", 3, 1, 2) in report(spark, out)
    assert run() == {"read": 0, "notes": 5, "report": 3}
    assert any("new rows" in m for m in caplog.messages) and any("wrote" in m for m in caplog.messages)


def test_all_at_once_equals_one_file_at_a_time(spark, tmp_path):
    texts = str(tmp_path / "in")
    for i in range(3):
        put(spark, [(10 * i + k, f"x{k}@y{i}.org validated", "en", f"s{i}") for k in range(4)], texts, f"f{i}")
    found = []
    for files in (1, 100):
        out = str(tmp_path / f"out{files}")
        notes_screening.screen(spark, texts, out, f"{out}-checkpoint", common.settings("notes_screening") | {"max_files": files})
        found.append((notes(spark, out), report(spark, out)))
    assert found[0] == found[1] and len(found[0][0]) == 12


@pytest.mark.parametrize("text", ["a" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" + " " * 300_000, "new " * 20_000 + "\n", "1" * 300_000])
def test_long_notes(spark, text):
    config = common.settings("notes_screening")
    one = notes_screening.screened(spark.createDataFrame([(1, text, "en", "s")], NOTES), config).first()
    assert (one.text == text) == (one.n_email + one.n_phone + one.n_address + one.n_number == 0)


@needs_tables
def test_a_release_that_is_repeated_or_was_cut_short(spark, tmp_path):
    out, config = str(tmp_path / "out"), common.settings("association_release")
    done = association_release.release(spark, SMALLEST, out, config)
    rows = sorted(map(str, spark.read.parquet(f"{out}/variants").collect()))
    assert done["variants"] == len(rows) == 50 and done["samples"] == spark.read.parquet(f"{SMALLEST}/customer.parquet").count()
    shutil.rmtree(f"{out}/variants")
    assert association_release.release(spark, SMALLEST, out, config) == done
    assert sorted(map(str, spark.read.parquet(f"{out}/variants").collect())) == rows
    assert {d for d in os.listdir(f"{out}/samples") if "=" in d} <= {"qc_pass=true", "qc_pass=false"}
    strict = association_release.release(spark, SMALLEST, out, config | {"min_call_rate": 1.1})
    assert strict["variants"] == 50 and spark.read.parquet(f"{out}/variants").filter("status <> 'qc_fail' or p is not null").isEmpty()


def test_settings(tmp_path):
    other = tmp_path / "c.json"
    other.write_text(json.dumps({"min_maf": 0.2}))
    assert common.settings("association_release", str(other)) == common.settings("association_release") | {"min_maf": 0.2}
    other.write_text(json.dumps({"maf": 0.2}))
    with pytest.raises(ValueError, match="maf"):
        common.settings("association_release", str(other))


def test_command_line_makes_and_ends_its_session(monkeypatch):
    calls = []

    class Session:
        builder = property(lambda self: self)

        def appName(self, name):
            return self

        def getOrCreate(self):
            return self

        def stop(self):
            calls.append("stopped")

    monkeypatch.setattr(common, "SparkSession", Session())

    def run(spark, tables, output, config):
        calls.append((tables, output, config["outcome"]))
        return {}

    common.main("association_release", run, {"tables": "", "output": ""}, ["--tables", "a", "--output", "b"])
    assert calls == [("a", "b", "y"), "stopped"]
    with pytest.raises(SystemExit):
        common.main("association_release", run, {"tables": "", "output": ""}, ["--tables", "a"])


def test_jobs_need_nothing_of_the_corpus():
    import re

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("jobs", "tests"):
        for name in os.listdir(os.path.join(top, folder)):
            if name.endswith(".py") and (folder == "jobs" or name == "test_jobs.py"):
                text = open(os.path.join(top, folder, name)).read()
                assert not re.search(r"^(from|import) .*(\bllm\b|corpus" + "_pipeline)", text, re.M), name
