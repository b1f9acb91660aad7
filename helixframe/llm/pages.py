"""Main text of web pages: differences between pages of nearest URL, and zones named by markup, which has the last word where it is sure."""

from __future__ import annotations

import hashlib
import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, ship, text_or_empty, written

#: Element and attribute names of HTML, and class names that sites use, by what they hold.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "select", "button", "audio", "video"}
OUTSIDE = {"nav", "aside", "footer", "menu", "dialog", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
IMPLIED = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "login", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "toolbar", "copyright", "masthead",
}
COMMENTS = {"comment", "comments", "disqus", "replies", "reply"}
#: Parts of a compound name that say nothing of what it holds.
PLAIN = {"left", "right", "top", "bottom", "site", "page", "global", "container", "wrapper", "wrap", "box", "block", "bar", "list", "item", "items", "links", "slot", "unit", "area", "inner", "outer", "module", "panel", "form", "button", "buttons", "posts", "thread"}
#: Names that an article gives to parts of its own too: there, differences between pages decide.
WEAK = {"menu"}

TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[-_]+|(?<=[a-z])(?=[0-9])")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
ENDS = {t: re.compile(rf"</{t}(?![a-zA-Z0-9])[^>]*>?", re.I) for t in RAW}
#: What markup says of an element. HOLDER: not main text, unless the main text lies in it.
TEXT, OPEN, HOLDER, NEVER = range(4)


def named(value: str, marks: set[str]) -> set[str]:
    """The marks in a class or id: of names that consist of marks alone, or of marks and parts that say nothing."""
    found = set()
    for name in value.split():
        parts = [x for x in PART.split(name) if x and not x.isdigit()]
        if all(x in marks or x in PLAIN for x in parts):
            found.update(marks.intersection(parts))
    return found


def verdict(tag: str, attributes: str, in_article: bool) -> int:
    """What an element is by its markup: TEXT (nothing against it), OPEN, HOLDER or NEVER."""
    if tag in OUTSIDE:
        return NEVER
    out = HOLDER if tag == "form" or (tag == "header" and not in_article) else TEXT
    if not attributes or tag in ("html", "body", "main"):
        return out
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "style" and UNSEEN.search(value)):
            return NEVER
        if name == "role" and value.strip() in ROLES:
            out = max(out, HOLDER)
        elif name in ("class", "id"):
            marks = named(value, COMMENTS if tag == "article" else MARKS if in_article or tag == "article" else MARKS | {"header"})
            if marks:
                out = max(out, OPEN if in_article and marks <= WEAK else HOLDER)
    return out


def blocks(source: str) -> list[tuple[str, bool, bool]]:
    """The text blocks of a page in order, each with whether it lies in an article or main element, and whether it is open there.

    An element that isn't main text by its name or role takes what it holds with it, unless an article or main element
    lies in it: then it is what the page is laid out in.
    """
    found: list[tuple[str, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # name, dropped, in an article, elements around that are in doubt
    level: list[int] = []  # of each element in doubt: OPEN, HOLDER, or TEXT once it is known to hold the main text
    drop, article, doubts = False, False, ()

    def flush() -> None:
        if parts:
            own = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if own:
                found.append((own, article, doubts))

    def top() -> tuple[bool, bool, tuple[int, ...]]:
        return stack[-1][1:] if stack else (False, False, ())

    at, n = 0, len(source)
    while at < n:
        m = TAG.search(source, at)
        if m is None:
            if not drop:
                parts.append(source[at:])
            break
        if not drop and m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            if tag == "br" or tag in ("td", "th"):
                parts.append(" ")
            else:
                flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in INLINE and any(x[3] != doubts for x in stack[i:]):
                        flush()
                    del stack[i:]
                    drop, article, doubts = top()
                    break
            continue
        if tag in RAW:
            end = ENDS[tag].search(source, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in IMPLIED and tag not in ("div", "article", "section", "main"):
            continue
        if stack and stack[-1][0] == "p" and tag not in INLINE:
            stack.pop()
            drop, article, doubts = top()
        kind = verdict(tag, m[3], article)
        if tag in IMPLIED and kind == TEXT:
            continue
        if tag in ("article", "main") and kind == TEXT and not drop:
            for i in doubts:
                level[i] = TEXT if level[i] == HOLDER and not article else level[i]
        drop, article = drop or kind == NEVER, article or tag in ("article", "main")
        if kind in (OPEN, HOLDER):
            if tag in INLINE:
                flush()
            level.append(kind)
            doubts = (*doubts, len(level) - 1)
        stack.append((tag, drop, article, doubts))
    flush()
    return [(t, inside, any(level[i] == OPEN for i in around)) for t, inside, around in found if not any(level[i] == HOLDER for i in around)]


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path; a URL that can't be read has itself as path."""
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").removeprefix("www."), u.path or "/"
    except ValueError:
        return "", url or ""


def parsed(batches):
    for b in batches:
        for first in range(0, b.num_rows, 128):
            part = b.slice(first, 128)
            rows = []
            for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                found = blocks(source)
                inside = [x for x in found if x[1]]
                lines, sure = [x[0] for x in inside or found], [x[1] and not x[2] for x in inside or found]
                rows.append((*url_key(url), bool(inside), lines, [line_hash(t) for t in lines], sure))
            host, path, marked, lines, hashes, sure = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(host), pa.array(path), pa.array(marked), pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(sure, pa.list_(pa.bool_()))],
                names=["page_id", "url", "host", "path", "marked", "lines", "hashes", "sure"],
            )


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each start of b, from one row of the usual table at a time."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each line of a is in a longest common subsequence of a and b, in memory linear in both.

    Equal ends are set aside, and lines that the other page lacks; what is left of a is halved, and b where the two halves
    have most in common, until a part has one line (Hirschberg, 1975).
    """
    keep = np.zeros(len(a), bool)
    todo = [(np.arange(len(a)), np.arange(len(b)))]
    while todo:
        x, y = todo.pop()
        low, most = 0, min(len(x), len(y))
        differ = np.flatnonzero(a[x[:most]] != b[y[:most]])
        low = int(differ[0]) if len(differ) else most
        keep[x[:low]] = True
        x, y = x[low:], y[low:]
        most = min(len(x), len(y))
        differ = np.flatnonzero(a[x[::-1][:most]] != b[y[::-1][:most]])
        high = int(differ[0]) if len(differ) else most
        keep[x[len(x) - high :]] = True
        x, y = x[: len(x) - high], y[: len(y) - high]
        x, y = x[np.isin(a[x], b[y])], y[np.isin(b[y], a[x])]
        if not len(x):
            continue
        if len(x) == 1:
            keep[x] = True
            continue
        half = len(x) // 2
        ahead, behind = lengths(a[x[:half]], b[y]), lengths(a[x[half:]][::-1], b[y][::-1])[::-1]
        at = int(np.argmax(ahead + behind))
        todo += [(x[:half], y[:at]), (x[half:], y[at:])]
    return keep


def template_lines(batches):
    """The places of lines that a page shares with its neighbour; none if it shares all."""
    for b in batches:
        places = []
        for a, c in zip(b.column("hashes").to_pylist(), b.column("other").to_pylist(), strict=True):
            same = shared_lines(np.array(a, np.int64), np.array(c, np.int64))
            places.append([] if same.all() else np.flatnonzero(same).tolist())
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(places, pa.list_(pa.int32()))], names=["row", "template"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page.

    A page is cut into text lines (blocks: what stands between block elements, with references decoded and white space
    put as one blank). Elements that markup names as menus, headers, footers, sidebars, notices, adverts, forms or reader
    comments go, by element, role, or a class or id that consists of such names; but none that holds an article or main
    element goes, save nav, aside, footer, menu and dialog. Of a page with an article or main element the lines in it are
    taken, else all. Every page then has a neighbour of nearest URL: all pages are sorted by host, by whether they have an
    article or main element (a template belongs to pages laid out alike) and by path; a page's neighbour is the one beside
    it with the longer common start of the path (the one before on a tie). The lines of both are aligned by longest common
    subsequence, and lines in it are template. Template is deleted unless markup is sure of the line: one in an article or
    main element, under no name that is WEAK. Every page is aligned, those of sure lines alone too; as these can lose none,
    their text isn't exchanged for what was found. Pages of a host with equal lines are copies: one of them
    stands for all in that order, and all lose the same lines. A page whose lines are all shared with its neighbour,
    which has more, keeps them; so does one alone on its host.

    Sorting is by range over all hosts, so a host with a third of all pages takes many tasks.

    Null html is empty and gives an empty text; null URLs lie on a host without name. A very long page is held by one
    task, in memory linear in it. Repeated rows come back each. Other columns are not read. Empty input gives an empty
    result.
    """
    ship(pages.sparkSession)
    given = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    id_type = given.schema["page_id"].dataType.simpleString()
    table = written(given.mapInArrow(parsed, f"page_id {id_type}, url string, host string, path string, marked boolean, lines array<string>, hashes array<long>, sure array<boolean>").withColumn("row", F.monotonically_increasing_id()))
    in_doubt = F.exists("sure", lambda x: ~x)
    same = ["host", "marked", F.sha2(F.array_join("hashes", ",").cast("binary"), 256).alias("same")]  # copies of a host have their lines in common
    copies = cut(table.filter(F.size("hashes") > 0).select("row", "path", in_doubt.alias("open"), *same))
    keys = copies.groupBy("host", "marked", "same").agg(F.min(F.struct("path", "row")).alias("first")).select("first.row", "host", "marked", "first.path", "same")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = keys.repartitionByRange(parts, "host", "marked", "path", "row").sortWithinPartitions("host", "marked", "path", "row").withColumn("m", F.monotonically_increasing_id())
    ranked = cut(ranked.withColumn("part", F.shiftright("m", 33).cast("int")).withColumn("m", F.col("m").bitwiseAND((1 << 33) - 1)))
    before, bases = 0, []
    for part, n in sorted(ranked.groupBy("part").count().collect()):
        bases.append((part, before))
        before += n
    base = F.broadcast(pages.sparkSession.createDataFrame(bases, "part int, base long"))
    ranked = ranked.join(base, "part").select("row", "host", "marked", "path", "same", (F.col("m") + F.col("base")).alias("rank"))
    beside = ranked.select(F.col("row").alias("other_row"), F.col("host").alias("other_host"), F.col("marked").alias("other_marked"), F.col("path").alias("other_path"), F.col("rank").alias("other_rank"))
    mine = ranked.select("row", "host", "marked", "path", "rank", F.explode(F.array(F.col("rank") - 1, F.col("rank") + 1)).alias("other_rank"))
    pairs = mine.join(beside, "other_rank").filter((F.col("host") == F.col("other_host")) & (F.col("marked") == F.col("other_marked")))
    a, b = F.split("path", ""), F.split("other_path", "")
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), 1)
    common = F.when(differs == 0, F.size(a)).otherwise(differs - 1)
    nearest = pairs.groupBy("row").agg(F.max_by("other_row", F.struct(common, -F.col("other_rank"))).alias("other_row"))
    lines = table.select("row", "hashes")
    template = cut(nearest.join(lines, "row").join(lines.toDF("other_row", "other"), "other_row").select("row", "hashes", "other").mapInArrow(template_lines, "row long, template array<int>"))
    firsts = ranked.select(F.col("row").alias("first_row"), "host", "marked", "same")
    template = copies.filter("open").select("row", "host", "marked", "same").join(firsts, ["host", "marked", "same"]).select("row", "first_row").join(template.withColumnRenamed("row", "first_row"), "first_row").select("row", "template")
    plain = table.filter(~in_doubt).select("page_id", "url", "lines")  # markup is sure of all their lines, template or not, so their text stays where it is
    kept = F.when(F.col("template").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: F.get("sure", i) | ~F.array_contains("template", i)))
    compared = table.filter(in_doubt).select("row", "page_id", "url", "lines", "sure").join(template, "row", "left").select("page_id", "url", kept.alias("lines"))
    text = F.array_join("lines", "\n\n")
    return plain.union(compared).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
