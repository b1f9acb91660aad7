"""Secrets in texts: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import text_or_empty

# Fixed values of the contract: patterns, and the least length of the whole match or, for assign, of its second group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32))

#: Kind of the spans that the models add, their characters, and the least length.
RANDOM, LEAST_RANDOM = "random", 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Labelled samples of each class that the models are trained on, and half as many to set the threshold.
SAMPLES, SEED = 20_000, 77
#: Part of the ordinary samples set aside that may score above the threshold.
FALSE_RATE = 2e-4
#: Common parts of identifiers and of words.
PARTS = "get set is has to from with new old user account name value key list map index count size max min total data file path line page text word table row column node tree graph edge item order price date time start end first last next config option default request response handler service client server session cache buffer queue stack thread process task event error message code status state type class method function module package test result".split()
SYLLABLES = "pf tz ver zu be ge auf st stl schen chen lichs the and ing ion tion ent er re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ung sch ein der heit keit lich eau que oui ment eux ais tre cion mente ado ez os as rr ll ya bo ga".split()


@dataclass(frozen=True)
class RandomModel:
    """log_odds[a][b]: the log of how much likelier b is after a in a random string than in an identifier; index 0 is the start."""

    log_odds: list[list[float]]
    threshold: float

    def score(self, text: str) -> float:
        """Mean over characters of the log-likelihood ratio."""
        at, total = 0, 0.0
        for ch in text:
            b = ALPHABET.index(ch) + 1
            total += self.log_odds[at][b]
            at = b
        return total / len(text)


def random_string(r: random.Random) -> str:
    chars = r.choice([ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:26] + "234567", ALPHABET[26:62], "0123456789abcdef", "0123456789ABCDEF"])
    return "".join(r.choice(chars) for _ in range(r.randrange(LEAST_RANDOM, 65)))


def identifier(r: random.Random) -> str:
    style, out = r.randrange(7), ""
    while len(out) < LEAST_RANDOM:
        part = r.choice(PARTS)
        if style == 0:
            out += part.capitalize() if out else part
        elif style in (1, 2, 3):
            out += (r.choice("_-/" if style == 3 else "_" if style == 1 else "-") if out else "") + (part.upper() if style == 1 and r.random() < 0.3 else part)
        elif style == 4:
            out += r.choice(SYLLABLES)
        elif style == 5:
            out += r.choice(SYLLABLES).upper()
        else:
            out += ("-" if out else "") + "".join(r.choice(SYLLABLES) for _ in range(r.randrange(2, 5))).capitalize()
    if r.random() < 0.15:
        out += r.choice("_-") + str(r.randrange(1, 3000))
    return r.choice(["-" * LEAST_RANDOM, "=" * LEAST_RANDOM, "_" * LEAST_RANDOM]) if r.random() < 0.01 else out


@lru_cache
def trained(samples: int = SAMPLES, seed: int = SEED) -> RandomModel:
    """First-order chains of both classes with one added to each count, from labelled samples made by rule."""
    r = random.Random(seed)
    n = len(ALPHABET) + 1
    counts = []
    for make in (random_string, identifier):
        table = [[1.0] * n for _ in range(n)]
        for _ in range(samples):
            at = 0
            for ch in make(r):
                b = ALPHABET.index(ch) + 1
                table[at][b] += 1
                at = b
        counts.append([[math.log(x / sum(row)) for x in row] for row in table])
    odds = [[round(a - b, 6) for a, b in zip(x, y, strict=True)] for x, y in zip(*counts, strict=True)]
    model = RandomModel(odds, 0.0)
    ordinary = sorted(model.score(identifier(r)) for _ in range(samples // 2))
    return RandomModel(odds, round(ordinary[int(len(ordinary) * (1 - FALSE_RATE))], 6))


def matches(text: Column, pattern: str, kind: int, hint: str, least: int) -> Column:
    """Of each match of pattern, from left to right: start, kind, end; match is its text. Places count code points from 0.

    The pieces between matches and the matches alternate, so their lengths give the places. A text without hint has none.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern == ASSIGN else found
    between = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.zip_with(F.zip_with(between, found, lambda n, m: F.struct(n.alias("before"), m.alias("match"))), tested, lambda x, t: F.struct(x.before.alias("before"), x.match.alias("match"), F.length(t).alias("tested")))
    rows = F.filter(rows, lambda x: x.match.isNotNull())
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s.at + x.before
        end = start + F.length(x.match)
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.match.alias("match")))
        return F.struct(end.alias("at"), F.when(x.tested >= least, F.concat(s.out, one)).otherwise(s.out).alias("out"))

    spans = F.aggregate(rows, state, step, lambda s: s.out)
    return F.when(text.rlike(hint), spans).otherwise(none)


def log_ratio(text: Column, model: RandomModel) -> Column:
    """RandomModel.score as an expression over a table of numbers."""
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{x:.6f}" for row in model.log_odds for x in row)), ",").cast("array<double>")
    at = F.transform(F.split(text, ""), lambda ch: F.position(ch, F.lit(ALPHABET)))
    steps = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(at, 1, F.size(at) - 1)), at, lambda a, b: F.element_at(table, a * n + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.size(at)


def secret_spans(docs: DataFrame, model: RandomModel | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found: secrets in each whole text.

    Base spans are the matches of the three patterns, from the left and without overlap within a kind, that are long
    enough. Runs of 20 and more characters of keys that meet no base span are added as kind random where the mean
    log-likelihood ratio of the two chains is above the model's threshold. spans lists all as kind:start:end in code
    points, end exclusive, by start, then kind in the order assign, access, hex, random; base_sha256 is of the base
    spans alone. found holds the same as rows, with the text of each.

    Null text is empty and has no spans. Repeated rows come back each; other columns are not read; empty input gives an
    empty result.
    """
    model = model or trained()
    text = F.col("text")
    hints = (r"(?i:password|passwd|secret|token|api_?key)", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    base = F.concat(*[matches(text, pattern, kind, hint, least) for kind, ((_, pattern, least), hint) in enumerate(zip(BASE, hints, strict=True))])
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), matches(text, CANDIDATE, len(BASE), CANDIDATE, LEAST_RANDOM).alias("runs"))
    free = F.filter("runs", lambda x: ~F.exists("base", lambda b: (b.start < x.end) & (x.start < b.end)))
    added = F.filter(free, lambda x: log_ratio(x.match, model) > model.threshold)
    rows = rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("found"))
    names = F.array(*[F.lit(k) for k, _, _ in BASE], F.lit(RANDOM))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    return rows.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, (k, _, _) in enumerate(BASE)], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"), "found"
    )


def masked(docs: DataFrame, model: RandomModel | None = None, mask: str = "[secret]") -> DataFrame:
    """docs with the spans of each text replaced. doc_id must be unique and not null."""
    spans = secret_spans(docs, model).filter("spans <> ''").select("doc_id", F.col("found").alias("secret_spans"))
    joined = docs.join(spans, "doc_id", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), s.at + 1, x.start - s.at)
        return F.when(x.end <= s.at, s).otherwise(F.struct(F.concat(s.out, F.when(x.start > s.at, F.concat(gap, F.lit(mask))).otherwise(F.lit(""))).alias("out"), x.end.alias("at")))

    clean = F.aggregate("secret_spans", start, step, lambda s: F.concat(s.out, F.substr(F.col("text"), s.at + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("secret_spans").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
