"""Column expressions: identifiers, alleles, assay values with censoring, and statistics derived from a fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_P = 1e-300
Z_975 = 1.959963984540054
# Spellings of operators, those that are known in the order in which they are tried, and the form of numbers.
SPELLINGS = (("≤", "<="), ("≥", ">="), ("=<", "<="), ("=>", ">="))
OPERATOR = "^(<=|>=|<|>|=)"
NUMBER = r"^[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?$"
# Kinship coefficients above which a pair has a degree.
KINSHIP = ((0.354, "duplicate/MZ twin"), (0.177, "1st degree"), (0.0884, "2nd degree"), (0.0442, "3rd degree"))


def strip_version(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\d+$", "")


def strip_chr(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit("chr"), F.lit(""))


def clean_study_id(c: Column) -> Column:
    """An id that was read as a number has its .0 taken off."""
    return F.trim(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def is_palindromic(a: Column, b: Column) -> Column:
    """Whether the alleles are each other's complement, so that strand can't be told."""
    return F.concat(F.least(F.upper(a), F.upper(b)), F.greatest(F.upper(a), F.upper(b))).isin("AT", "CG")


def alignment_sign(assessed: Column, other: Column, counted: Column, not_counted: Column) -> Column:
    """1 where a weight is for the counted allele, -1 where for the other, null where alleles differ."""
    a, b, x, y = (F.upper(c) for c in (assessed, other, counted, not_counted))
    return F.when((a == x) & (b == y), 1).when((a == y) & (b == x), -1)


def substitution(text: Column) -> Column:
    """gene, reference residue, place and new residue of names like gyrA_S83L."""
    form = r"^([A-Za-z0-9]+)[_: ]([A-Z*])(\d+)([A-Z*])$"
    part = lambda i: F.nullif(F.regexp_extract(text, form, i), F.lit(""))
    return F.struct(part(1).alias("gene"), part(2).alias("aa_ref"), part(3).try_cast("int").alias("aa_pos"), part(4).alias("aa_alt"))


def residue_is(sequence: Column, place: Column, residue: Column) -> Column:
    """Whether a sequence, counted from 1, has a residue at a place; false beyond its ends."""
    return F.coalesce(F.upper(F.substr(sequence, place, F.lit(1))) == F.upper(residue), F.lit(False)) & (place >= 1)


def kinship_degree(phi: Column) -> Column:
    out = F.lit("unrelated")
    for least, name in reversed(KINSHIP):
        out = F.when(phi > least, name).otherwise(out)
    return out


def inferred_sex(x_heterozygosity: Column, threshold: float) -> Column:
    """2 where the share of heterozygous calls on X reaches the threshold, 1 otherwise and where unknown."""
    return F.when(x_heterozygosity >= threshold, 2).otherwise(1)


def all_binary(value: Column) -> Column:
    """An aggregate: whether all known values are 0 or 1, and there is one."""
    known = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return (F.count(known) > 0) & F.coalesce(F.bool_and(known.isin(0.0, 1.0)), F.lit(False))


def neglog10p(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(SMALLEST_P)))


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a correlation; null under four pairs."""
    z = F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))
    half = F.when(n > 3, F.lit(Z_975) / F.sqrt((n - 3).cast("double")))
    return F.tanh(z - half), F.tanh(z + half)


def shown(value: Column) -> Column:
    """Four significant digits, or NA."""
    known = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.when(known.isNull(), "NA").otherwise(F.format_string("%.4g", known))


def once(value: Column, use) -> Column:
    """use(value), with value worked out once however often use has it: an expression that stands in several places is else done in each."""
    return F.get(F.transform(F.array(value), use), 0)


def _representation(text: Column) -> Column:
    """operator and number of one spelling, after operators are written one way and blanks are gone."""
    for given, meant in SPELLINGS:
        text = F.replace(text, F.lit(given), F.lit(meant))
    text = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    parts = once(text, lambda t: F.struct(F.regexp_extract(t, OPERATOR, 1).alias("sign"), F.regexp_replace(t, OPERATOR, "").alias("number")))

    def read(p: Column) -> Column:
        value = F.when(p["number"].rlike(NUMBER), p["number"].try_cast("double"))
        return F.struct(F.when(p["sign"] == "", "=").otherwise(p["sign"]).alias("op"), p["number"].alias("number"), value.alias("value"))

    return once(parts, read)


def parse_mic(raw: Column, sign: Column | None = None, value: Column | None = None) -> Column:
    """A struct of eleven fields that keeps what a measured concentration says: an exact value, or a bound on either side.

    The text and, where given, a separate sign and value are read. If both are there they must agree, else the record is
    invalid, as it is for anything but a positive finite number. A bound is never given as an exact value.
    """
    absent = lambda c: c.isNull() | c.isin("", "nan", "None")
    text = raw.cast("string")
    none = F.lit(None).cast("string")
    second = none if value is None else F.when(~absent(F.trim(value.cast("string"))), F.concat(F.coalesce(sign.cast("string") if sign is not None else none, F.lit("")), value.cast("string")))
    given = F.struct(text.alias("text"), F.when(~absent(text), _representation(text)).alias("a"), F.when(second.isNotNull(), _representation(second)).alias("b"))
    return once(once(given, _judged), _fields)


def _judged(given: Column) -> Column:
    """The text, the operator and bound that it says, and what is wrong with it."""
    a, b = given["a"], given["b"]
    bad = lambda x: x.isNotNull() & (x["value"].isNull() | (x["value"] <= 0) | (x["value"] == float("inf")))
    said = lambda x, source: F.when(
        x["value"].isNull(), F.concat(F.lit("non-numeric MIC '"), x["number"], F.lit(f"' ({source})"))
    ).otherwise(F.concat(F.lit("MIC must be positive finite, got '"), x["number"], F.lit("'")))
    both = a.isNotNull() & b.isNotNull()
    note = (
        F.when(a.isNull() & b.isNull(), "no MIC string")
        .when(bad(a), said(a, "raw"))
        .when(bad(b), said(b, "sign+value"))
        .when(both & ((a["op"] != b["op"]) | (a["value"] != b["value"])), "conflicting representations")
        .otherwise("")
    )
    return F.struct(given["text"].alias("text"), F.coalesce(a["op"], b["op"]).alias("op"), F.coalesce(a["value"], b["value"]).alias("boundary"), note.alias("note"))


def _fields(said: Column) -> Column:
    text, op, boundary, note = said["text"], said["op"], said["boundary"], said["note"]
    ok = note == ""
    left, right = ok & op.isin("<=", "<"), ok & op.isin(">=", ">")
    exact, log2 = ok & (op == "="), F.log2(boundary)
    return F.struct(
        text.alias("mic_raw"),
        F.when(ok, op).alias("mic_operator"),
        F.when(ok, boundary).alias("mic_boundary_mg_l"),
        F.when(exact, "exact").when(left, "left").when(right, "right").otherwise("invalid").alias("censoring"),
        F.when(ok, op.isin("=", "<=", ">=")).alias("bound_inclusive"),
        F.when(exact, log2).alias("log2_mic_exact"),
        F.when(left | right, log2).alias("log2_boundary"),
        F.when(left, float("-inf")).when(ok, log2).alias("log2_lower"),
        F.when(right, float("inf")).when(ok, log2).alias("log2_upper"),
        ok.alias("mic_parse_ok"),
        note.alias("mic_parse_note"),
    )


def off_grid(boundary: Column, tolerance: float = 0.10) -> Column:
    """Whether a value is off the grid of twofold dilutions."""
    log2 = F.log2(boundary)
    return F.coalesce(F.abs(log2 - F.rint(log2)) > tolerance, F.lit(False))
