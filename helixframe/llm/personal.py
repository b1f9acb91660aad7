"""Personal data in texts: four fixed patterns, and identifiers that they miss but that stand in the same words.

What the fixed patterns find are seeds. The words around a seed are lexical patterns ("call me at _"); other numbers and
addresses in such words are instances that may be the same kind. Patterns and instances make a graph, which is scored in
turns: a pattern by the part of its instances that is known to be of a kind, an instance by the patterns it stands in.
Instances of patterns that are sure enough become known, and are found wherever they stand.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, ship, text_or_empty, written

# Fixed values of the contract, with possessive runs where a shorter run can't match either.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
EMAIL_KIND, IP_KIND, CARD_KIND, PHONE_KIND = range(4)
#: Names of what the patterns add.
ADDED = tuple(f"like_{k}" for k in KINDS)

#: Known instances of a kind that a pattern has at least, and the least part of its instances that they are, in millionths.
LEAST_KNOWN, SURE, UNIT = 5, 800_000, 1_000_000
#: Turns of scoring; rows that a join of the graph deals one key to.
TURNS, SALTS = 3, 16
#: Digits of a number that may be an identifier, of a part that a blank may join to the next, and of what is joined.
LEAST_DIGITS, MOST_DIGITS, PART, MOST_JOINED = 5, 30, 5, 15
#: Characters of a word or value that are kept as they are. A longer value is known by a hash; longer words are all alike.
LONGEST, LONG = 64, "#"

NUMBER = re.compile(r"[+(]?[0-9][0-9().+-]*+")
DIGIT_OR_AT = re.compile(r"[0-9@]")
EDGES = " .,;:!?\"'()[]{}<>|"
ZEROS = str.maketrans("123456789", "000000000")
OCCURRENCE = "struct<start:int,end:int,kind:int,may:int,key:string,patterns:array<string>>"
FOUND = "row long, doc_id {id}, base array<struct<start:int,kind:int,end:int>>, found array<" + OCCURRENCE + ">"


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Spans of the email pattern in time linear in the text: each @ with what stands before it since the last match."""
    at, last = text.find("@"), 0
    while at >= 0:
        domain, start = DOMAIN.match(text, at + 1), at
        if domain:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            yield start, (last := domain.end())
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def luhn(number: str) -> bool:
    double = [sum(divmod(2 * int(c), 10)) for c in number[-2::-2]]
    return (sum(map(int, number[-1::-2])) + sum(double)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches that pass, by start, then kind."""
    out = [(a, EMAIL_KIND, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
            out.append((m.start(), IP_KIND, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(number := digits(m.group())) <= 19 and luhn(number):
            out.append((m.start(), CARD_KIND, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits(m.group())) <= 15:
                out.append((m.start(), PHONE_KIND, m.end()))
    return sorted(out)


def named(text: str) -> str:
    return text if len(text) <= LONGEST else "#" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def word(text: str) -> str:
    return text.strip(EDGES[1:]).lower().translate(ZEROS)


def left_words(text: str, start: int) -> list[str]:
    """The last two words before start, the nearer first; text has no white space but blanks. No word lies beyond a LONG one."""
    out: list[str] = []
    while len(out) < 2 and LONG not in out:
        while start > 0 and text[start - 1] in EDGES:
            start -= 1
        if not start:
            break
        head, least = start, max(0, start - LONGEST - 1)
        start = text.rfind(" ", least, head) + 1
        if not start and least:
            out.append(LONG)
        else:
            # A colon belongs to its word: "tel:" says more than "tel".
            out.append(word(text[start:head]) + (":" if text[head : head + 1] == ":" else ""))
    return out


def right_words(text: str, end: int) -> list[str]:
    """The first two words from end on."""
    out: list[str] = []
    n = len(text)
    while len(out) < 2 and LONG not in out:
        while end < n and text[end] in EDGES:
            end += 1
        if end == n:
            break
        stop = text.find(" ", end, end + LONGEST + 1)
        if stop < 0 and end + LONGEST < n:
            out.append(LONG)
        else:
            stop = n if stop < 0 else stop
            out.append(word(text[end:stop]))
            end = stop
    return out


def contexts(text: str, start: int, end: int, mail: bool) -> list[str]:
    """The patterns that an occurrence stands in: words before, words after, or one of both, and whether it is an address."""
    left, right, sort = left_words(text, start), right_words(text, end), "@" if mail else "0"
    out = []
    if len(left) == 2:
        out.append(f"{left[1]} {left[0]} _{sort}")
    if len(right) == 2:
        out.append(f"_{sort} {right[0]} {right[1]}")
    if left and right:
        out.append(f"{left[0]} _{sort} {right[0]}")
    return out


def value(text: str, mail: bool) -> str:
    return named(text.lower() if mail else "".join(c for c in text if c == "." or "0" <= c <= "9"))


def may_be(text: str, mail: bool) -> int:
    """Bits of the kinds that a value looks like."""
    if mail:
        return 1 << EMAIL_KIND
    if "." in text and not set(text) & set("()+ "):
        return 1 << IP_KIND | 1 << PHONE_KIND
    return 1 << PHONE_KIND | (0 if set(text) & set("().+") else 1 << CARD_KIND)


def candidates(text: str):
    """(start, end, is an address) of words that hold an @ or are a number, which may go on over blanks in short parts."""
    m = DIGIT_OR_AT.search(text)
    while m:
        start = text.rfind(" ", 0, m.start()) + 1
        stop = text.find(" ", start)
        stop = len(text) if stop < 0 else stop
        whole = text[start:stop]
        left = len(whole) - len(whole.lstrip(EDGES.replace("(", "")))
        a, b = start + left, start + len(whole.rstrip(EDGES))
        if "@" in whole:
            name, _, host = text[a:b].partition("@")
            if name and host:
                yield a, b, True
        elif (whole := NUMBER.match(text, a)) and whole.end() >= b:
            n = last = len(digits(text[a:b]))
            while last <= PART and text[b:stop] in ("", ")") and (part := NUMBER.match(text, stop + 1)):
                close = text.find(" ", stop + 1)
                close = len(text) if close < 0 else close
                last = len(digits(part.group()))
                if n + last > MOST_JOINED or text[part.end() : close].strip(EDGES):
                    break
                n, stop = n + last, close
                b = a + len(text[a : part.end()].rstrip(EDGES))
            if LEAST_DIGITS <= n <= MOST_DIGITS:
                yield a, b, False
        m = DIGIT_OR_AT.search(text, stop)


def spans_of(text: str) -> tuple[list[tuple], list[tuple]]:
    """The base spans of a text; and all occurrences with their patterns, those without a kind being candidates."""
    base = base_spans(text)
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    found, starts, ends = [], [], []
    for start, kind, end in base:
        mail = kind == EMAIL_KIND
        found.append((start, end, kind, 0, value(text[start:end], mail), contexts(text, start, end, mail)))
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for start, end, mail in candidates(text):
        before = bisect_right(starts, end - 1) - 1
        if before < 0 or ends[before] <= start:
            found.append((start, end, -1, may_be(text[start:end], mail), value(text[start:end], mail), contexts(text, start, end, mail)))
    return base, found


def scanned(batches):
    base_type = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "kind", "end")]))
    found_type = pa.list_(pa.struct([*((k, pa.int32()) for k in ("start", "end", "kind", "may")), ("key", pa.string()), ("patterns", pa.list_(pa.string()))]))
    names = ("start", "end", "kind", "may", "key", "patterns")
    for b in batches:
        both = [spans_of(t) for t in b.column("text").to_pylist()]
        base = pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x, _ in both], base_type)
        found = pa.array([[dict(zip(names, s, strict=True)) for s in x] for _, x in both], found_type)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), base, found], names=["row", "doc_id", "base", "found"])


def salted(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on key, of which few has each value once (or once a kind): rows of one key in many are dealt by `by`."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(few.select("*", salt), [key, "salt"]).drop("salt")


def bootstrapped(occurrences: DataFrame, turns: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """Patterns (pattern, kind, known, instances, sure) and instances (key, kind, belief) that occurrences without a kind have.

    occurrences: key, kind (-1 where unknown), may, patterns. In each turn a pattern's surety for a kind is the sum of
    its instances' beliefs over their number; those with LEAST_KNOWN and SURE at least are kept. An instance's belief is
    1 less the product of what its patterns lack in surety. Seeds have belief 1. Sums are of whole numbers, so the result
    doesn't depend on order.
    """
    instances = occurrences.groupBy("key").agg(F.max("kind").alias("seed"), F.bit_or("may").alias("may"))
    edges = cut(occurrences.select("key", F.explode("patterns").alias("pattern")).distinct())
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")).filter(F.col("instances") >= LEAST_KNOWN)
    # Words that too few instances share can't become sure, and go before the turns.
    edges = cut(salted(edges, size, "pattern", "key"))
    seeds = cut(instances.filter("seed >= 0").select("key", F.col("seed").alias("kind"), F.lit(UNIT).cast("long").alias("belief")))
    unknown = cut(instances.filter("seed < 0").select("key", "may"))
    known = seeds
    for _ in range(turns):
        held = salted(edges, known, "key", "pattern").groupBy("pattern", "kind")
        patterns = held.agg(F.sum("belief").alias("known"), F.first("instances").alias("instances"))
        patterns = patterns.withColumn("sure", F.expr("known div instances")).filter((F.col("known") >= LEAST_KNOWN * UNIT) & (F.col("sure") >= SURE))
        patterns = cut(patterns)
        lack = F.round(-F.log(1 - F.least("sure", F.lit(UNIT - 1)) / UNIT) * UNIT).cast("long")
        lacks = salted(edges.drop("instances"), patterns, "pattern", "key").select("key", "kind", lack.alias("lack"))
        lacks = lacks.groupBy("key", "kind").agg(F.sum("lack").alias("lack"))
        fits = lacks.join(unknown, "key").filter(F.expr("shiftright(may, kind) % 2 = 1"))
        best = fits.groupBy("key").agg(F.max(F.struct("lack", (-F.col("kind")).alias("kind"))).alias("best"))
        belief = F.floor((1 - F.exp(-F.col("best.lack") / UNIT)) * UNIT).cast("long")
        found = cut(best.select("key", (-F.col("best.kind")).cast("int").alias("kind"), belief.alias("belief")))
        known = seeds.unionByName(found)
    return patterns, found


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS + ADDED))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def personal_spans(docs: DataFrame, turns: int = TURNS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found: personal data in each whole text.

    Base spans are the matches of the four patterns, from the left and without overlap within a kind, that pass (parts of
    an address up to 255; 14 to 19 digits by Luhn; 10 to 15 digits). Words with an @, and numbers of LEAST_DIGITS to
    MOST_DIGITS digits, that meet no base span are added as like_email, like_ip, like_card or like_phone where
    bootstrapped() found them to be one by the words they stand in. spans lists all as kind:start:end in code points, end
    exclusive, by start, then kind in that order; base_sha256 is of the base spans alone. found has the same as rows.

    Null text is empty and has no spans. Repeated rows, and rows without doc_id, come back each; a value that they repeat
    is one instance. Other columns are not read; empty input gives an empty result. A very long text takes time in
    proportion to its length. A value of more than LONGEST characters is
    known by 128 bits of hash; words as long are all alike in patterns.

    A value or a pattern that many texts have is dealt by SALTS in joins and summed before exchanges.
    """
    ship(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    schema = FOUND.format(id=given.schema["doc_id"].dataType.simpleString())
    rows = written(given.mapInArrow(scanned, schema))
    occurrences = rows.select("row", F.inline("found"))
    _, instances = bootstrapped(occurrences.select("key", "kind", "may", "patterns"), turns)
    unknown = occurrences.filter("kind < 0").select("row", "start", "end", "key")
    more = salted(unknown, instances.select("key", (F.col("kind") + len(KINDS)).alias("kind")), "key", "row")
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    joined = rows.select("row", "doc_id", "base").join(more, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    joined = joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("found"))
    number = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found")


def lexical_patterns(docs: DataFrame, turns: int = TURNS) -> DataFrame:
    """pattern, kind, known, instances, sure: the words that personal_spans trusts, _@ or _0 where the value stands; sure in millionths."""
    ship(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    schema = FOUND.format(id=given.schema["doc_id"].dataType.simpleString())
    occurrences = written(given.mapInArrow(scanned, schema)).select(F.inline("found"))
    patterns, _ = bootstrapped(occurrences.select("key", "kind", "may", "patterns"), turns)
    return patterns.withColumn("kind", F.get(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")))
