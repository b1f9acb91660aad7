"""Free text that goes along with samples, made fit for release: direct identifiers masked, claims that need evidence found.

Text files come in over time. A run takes those that its checkpoint doesn't know, masks e-mail addresses, telephone
numbers, network addresses and long numbers, looks for wording that an evidence card may not have without support, and
appends the notes by language. Then it writes the report of all notes so far. A run without new files changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.evidence import CAUSAL, KINDS, NOVEL, any_of

from .common import log, main, write

#: What is masked, in this order; a later pattern sees what the earlier ones left. Parts are bounded, as the standards of
#: addresses and numbers bound them, so that time is linear in the text.
IDENTIFIERS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63})+",
    "phone": r"\+[0-9][0-9 ().-]{7,20}[0-9]",
    "address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "number": r"\b[0-9]{9,}\b",
}
#: The code of a language that isn't known; a folder of the output can't be named by nothing.
NO_LANG = "und"
#: Claims are sought in one sentence at a time.
SENTENCE_END = r"[.!?\n]"
CLAIMS = {"causal": CAUSAL, "novel": NOVEL, **{k: v for k, v in KINDS.items() if k != "causal"}}
SCHEMA = "doc_id long, text string, lang string, source string"


def as_pattern(path: str) -> str:
    """path in a form that names one file as well as a folder: streams read a folder, or what a pattern finds."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def screened(notes: DataFrame, config: dict) -> DataFrame:
    """doc_id, source, text (masked), a number of each kind of identifier, claims, held, lang; null text and source are '', no lang is NO_LANG."""
    out = notes.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "text")), F.coalesce(F.nullif("lang", F.lit("")), F.lit(NO_LANG)).alias("lang"))
    for name, pattern in IDENTIFIERS.items():
        out = out.withColumns({f"n_{name}": F.regexp_count("text", F.lit(pattern)), "text": F.regexp_replace("text", pattern, config["mask"].replace("\\", "\\\\").replace("$", "\\$"))})
    said = F.filter(F.array(*(F.when(any_of("sentences", p), k) for k, p in CLAIMS.items())), lambda x: x.isNotNull())
    out = out.withColumn("sentences", F.split("text", SENTENCE_END))
    out = out.withColumn("claims", said).withColumn("held", F.size("claims") >= config["hold_at"])
    return out.select("doc_id", "source", "text", *(f"n_{k}" for k in IDENTIFIERS), "claims", "held", "lang")


def report_of(notes: DataFrame) -> DataFrame:
    """source, notes, held, a sum of each kind of identifier, lang."""
    sums = [F.sum(F.col(f"n_{k}").cast("long")).alias(f"n_{k}") for k in IDENTIFIERS]
    return notes.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("notes"), F.count_if("held").alias("held"), *sums).select("source", "notes", "held", *(f"n_{k}" for k in IDENTIFIERS), "lang")


def screen(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes the new files of documents to output/notes and writes output/report; returns notes read, notes and report rows there.

    The stream's checkpoint knows which files were taken, and its sink lists the files that count, so an attempt that was
    ended half-way is taken up where it stood and nothing is appended twice. The report is made from all notes, whole, from
    columns other than the text. Rows that repeat one another are kept each.
    """
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", config["max_files"]).parquet(as_pattern(documents))
    notes = f"{output}/notes"
    written = screened(stream, config).writeStream.format("parquet").partitionBy("lang").option("path", notes).option("checkpointLocation", checkpoint)
    query = written.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = reduce(lambda n, p: n + p["numInputRows"], query.recentProgress, 0)
    log.info("read %s new rows of %s", taken, documents)
    have = spark.read.schema(screened(spark.createDataFrame([], SCHEMA), config).schema).parquet(notes)
    total = have.count()
    log.info("%s notes in %s", total, notes)
    return {"read": taken, "notes": total, "report": write(report_of(have), f"{output}/report", "lang")}


if __name__ == "__main__":
    main("notes_screening", screen, {"documents": "folder, file or pattern of the text files", "output": "folder of notes and report", "checkpoint": "folder of the stream's checkpoint"})
