"""Readers of the text formats of this domain. Ids are text always: a genome id such as 562.10 isn't a number."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import strip_chr, strip_version

# Other names of columns.
ALIASES = {
    "key": {"gene_id": ("gene_id", "gene", "ensembl", "phenotype_id", "probe_id"), "snp_id": ("snp_id", "snp", "rsid", "variant_id", "variant"), "pvalue": ("pvalue", "p", "pval", "p_value"), "rho": ("rho", "beta", "effect", "rvalue", "r")},
    "weights": {"gene_id": ("gene_id", "gene"), "variant_id": ("variant_id", "snp", "snp_id"), "pvalue": ("pvalue", "p"), "zscore": ("zscore", "z"), "assessed_allele": ("assessed_allele", "effect_allele"), "other_allele": ("other_allele", "noneffect_allele")},
    "panel": {"sample": ("sample", "sample_id"), "pop": ("pop", "population"), "super_pop": ("super_pop", "superpopulation"), "gender": ("gender", "sex")},
    "expression": {"gene_id": ("gene_symbol", "targetid", "gene_id", "gene"), "chrom": ("chr", "chrom", "chromosome"), "tss": ("coord", "tss", "start")},
}
NUCLEOTIDES = "^[ACGTUNRYSWKMBDHV]*$"


class PrepError(ValueError):
    pass


def resolve_columns(columns: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """The column that each name stands for, in any case; none or several is an error."""
    low: dict[str, str] = {}
    for c in columns:
        low.setdefault(c.lower(), c)
    out = {}
    for name, others in aliases.items():
        hits = list(dict.fromkeys(low[o] for o in others if o in low))
        if len(hits) != 1:
            raise PrepError(f"{name}: {'no' if not hits else 'several'} column(s) of {others} in {columns}")
        out[name] = hits[0]
    return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def split_table(spark: SparkSession, path: str, header: list[str] | None = None, separator: str = r"\s+", skip: str | None = None) -> DataFrame:
    """A table of text fields between matches of separator; without header its first line names them. One file: its first line is found by the driver."""
    rows = lines(spark, path)
    if skip:
        rows = rows.filter(~F.col("value").startswith(skip))
    if header is None:
        first = rows.first()
        if first is None:
            raise PrepError(f"{path} is empty")
        rows = rows.filter(F.col("value") != first.value)
        import re

        header = re.split(separator, first.value.strip())
    parts = F.split(F.trim("value"), separator)
    return rows.select([F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(h.lstrip("#")) for i, h in enumerate(header)])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, variant_id, counted_allele, dosage of a whitespace table whose columns are id_allele; what isn't a number is null."""
    wide = split_table(spark, path)
    ids = [c for c in wide.columns if c not in ("FID", "IID", "PAT", "MAT", "SEX", "PHENOTYPE")]
    long = wide.unpivot(["IID"], [F.col(f"`{c}`") for c in ids], "name", "value")
    part = lambda i: F.regexp_extract("name", "^(.*)_([^_]*)$", i)
    return long.select(F.col("IID").alias("sample_id"), part(1).alias("variant_id"), part(2).alias("counted_allele"), F.col("value").try_cast("double").alias("dosage"))


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    table = split_table(spark, path, skip="##")
    missing = {"CHROM", "POS", "ID", "REF", "ALT"} - set(table.columns)
    if missing:
        raise PrepError(f"{path} lacks {sorted(missing)}")
    return table.withColumn("POS", F.col("POS").cast("long"))


def read_aliased(spark: SparkSession, path: str, kind: str, separator: str = r"\s+") -> DataFrame:
    """A table of kind key, weights or panel under its own names; gene versions are dropped, numbers must be numbers."""
    table = split_table(spark, path, separator=separator)
    names = resolve_columns(table.columns, ALIASES[kind])
    out = table.select([F.col(f"`{c}`").alias(n) for n, c in names.items()])
    if "gene_id" in names:
        out = out.withColumn("gene_id", strip_version(F.col("gene_id")))
    for n in {"pvalue", "rho", "zscore"} & set(names):
        out = out.withColumn(n, F.coalesce(F.col(n).try_cast("double"), F.raise_error(F.concat(F.lit(f"{n} is not a number: "), F.coalesce(F.col(n), F.lit("null")))).cast("double")))
    return out


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end of a table without header; counted from 1, ends included."""
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long").withColumn("chrom", strip_chr(F.col("chrom")))


def read_expression(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(gene_id, sample_id, value) and (gene_id, chrom, tss) of a wide table. The columns that describe genes are among its first six."""
    wide = spark.read.csv(path, sep="\t", header=True)
    names = resolve_columns(wide.columns[:6], ALIASES["expression"])
    gene = strip_version(F.col(f"`{names['gene_id']}`"))
    wide = wide.withColumn("gene_id", gene)
    twice = wide.groupBy("gene_id").count().filter("count > 1").limit(3).collect()
    if twice:
        raise PrepError(f"genes more than once: {[r[0] for r in twice]}")
    samples = [c for c in wide.columns if c not in {*names.values(), "gene_id"}]
    values = wide.unpivot(["gene_id"], [F.col(f"`{c}`") for c in samples], "sample_id", "value").withColumn("value", F.col("value").try_cast("double"))
    meta = wide.select("gene_id", strip_chr(F.col(f"`{names['chrom']}`")).alias("chrom"), F.col(f"`{names['tss']}`").try_cast("long").alias("tss"))
    return values, meta


def read_upload(spark: SparkSession, genotypes: str, phenotypes: str, outcome: str) -> DataFrame:
    """Genotype and phenotype tables of samples joined; rows without outcome go. Repeated or unshared ids are errors."""
    a, b = (spark.read.csv(p, header=True) for p in (genotypes, phenotypes))
    for table, path in ((a, genotypes), (b, phenotypes)):
        if "sample_id" not in table.columns:
            raise PrepError(f"{path} has no sample_id")
        twice = table.groupBy("sample_id").count().filter("count > 1").limit(3).collect()
        if twice:
            raise PrepError(f"{path}: sample_id more than once: {[r[0] for r in twice]}")
    if outcome not in b.columns:
        raise PrepError(f"no column {outcome}")
    features = [c for c in a.columns if c != "sample_id"]
    joined = a.select("sample_id", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in features]).join(b.select("sample_id", F.col(f"`{outcome}`").try_cast("double").alias(outcome)), "sample_id")
    if joined.isEmpty():
        raise PrepError("the tables share no sample")
    return joined.na.drop(subset=[outcome])


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, variant_id, counted_allele (ALT), other_allele, dosage array by sample, of single-base variants with two alleles; the first of an id stays.

    A call's alleles are counted in its GT field; a call without both is null.
    """
    header = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise PrepError(f"{path} has no #CHROM line")
    n = len(header.value.split("\t"))
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(*[f[i].alias(c) for i, c in ((0, "c"), (1, "pos"), (3, "ref"), (4, "alt"))], F.slice(f, 10, max(n - 9, 1)).alias("calls"))
    rows = rows.filter("length(ref) = 1 and length(alt) = 1 and alt <> '.'").withColumn("pos", F.col("pos").cast("long"))
    rows = rows.withColumn("variant_id", F.concat_ws(":", strip_chr(F.col("c")), "pos", "ref", "alt"))
    gt = lambda call: F.split(F.split(call, ":")[0], r"[/|]")
    dosage = F.transform("calls", lambda c: F.when(F.forall(gt(c), lambda a: a.isin("0", "1")), F.aggregate(gt(c), F.lit(0.0), lambda s, a: s + a.cast("double"))))
    out = rows.select(strip_chr(F.col("c")).alias("chrom"), "pos", "variant_id", F.col("alt").alias("counted_allele"), F.col("ref").alias("other_allele"), dosage.alias("dosage"))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("variant_id").orderBy("pos"))).filter("_n = 1").drop("_n")


def read_pages(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Records of landed JSON pages under canonical names; all are text."""
    out = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if not out.columns or out.isEmpty():
        raise PrepError(f"no records in {path}")
    return out.withColumnsRenamed({a: b for a, b in names.items() if a in out.columns and b not in out.columns})


def landed(target: Path, get) -> list[dict]:
    """The records of a landed file; where there is none yet, those of get() land first, whole or not at all."""
    if not target.exists():
        part = target.with_suffix(".part")
        part.write_text(json.dumps(get()))
        part.replace(target)
    return json.loads(target.read_bytes())


def fetch_pages(get, folder: str, page_size: int, most: int | None = None) -> list[dict]:
    """Pages that get(offset, size) gives as lists, each landed as a file; landed pages aren't fetched again, and the first short page is the last.

    most: pages after which a source that gives no short one is refused.
    """
    root, log = Path(folder), []
    root.mkdir(parents=True, exist_ok=True)
    while True:
        i = len(log)
        if most is not None and i >= most:
            raise PrepError(f"no end after {most} pages of {page_size}")
        target = root / f"page_{i:05d}.json"
        n = len(landed(target, lambda: get(i * page_size, page_size)))  # noqa: B023
        log.append({"page": i, "rows": n, "sha256": hashlib.sha256(target.read_bytes()).hexdigest()})
        if n < page_size:
            return log


def fetch_metadata(ids: list[str], folder: str, get=None, batch: int = 200) -> list[str]:
    """Files of the metadata of genomes, a batch of sorted ids each, which get(ids) gives as a list of records.

    Landed batches aren't fetched again. Without get a batch that hasn't landed is refused. read_pages reads the files.
    """
    root, own, out = Path(folder), sorted(set(map(str, ids))), []
    root.mkdir(parents=True, exist_ok=True)
    for i in range(0, len(own), batch):
        target = root / f"metadata_{i // batch:05d}.json"
        if get is None and not target.exists():
            raise PrepError(f"{target.name} has not landed and may not be fetched")
        landed(target, lambda: get(own[i : i + batch]))  # noqa: B023
        out.append(str(target))
    return out


def read_imputation(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, imputed of a table without header whose two columns are parted by blanks, tabs or commas."""
    found = split_table(spark, path, ["sample_id", "imputed"], r"[\s,;]+").select("sample_id", F.col("imputed").try_cast("int").alias("imputed"))
    if not found.filter("imputed is null or imputed not in (0, 1)").isEmpty():
        raise PrepError(f"imputation status in {path} is 0 or 1")
    return found


def alt_counted(counted: DataFrame, pvar: DataFrame) -> DataFrame:
    """variant, counted_allele, other_allele: refuses an export that counts another allele than ALT, or a variant pvar lacks.

    counted: variant, counted_allele; pvar: variant, ref, alt, of which the first row of a variant holds.
    """
    first = pvar.groupBy("variant").agg(F.first("ref").alias("ref"), F.first("alt").alias("alt"))
    both = counted.join(first, "variant", "left")
    bad = both.filter(~F.col("counted_allele").eqNullSafe(F.col("alt")))
    some = [r[0] for r in bad.select("variant").orderBy("variant").limit(3).collect()]
    if some:
        raise PrepError(f"the counted allele isn't ALT for {bad.count()} variants such as {some}")
    return both.select("variant", "counted_allele", F.col("ref").alias("other_allele"))


def point_mutations(spark: SparkSession, path: str) -> DataFrame:
    """name, gene, reference, place and new residue of rows of subtype POINT in a tab-separated report."""
    from ..functions.scalar import substitution

    table = spark.read.csv(path, sep="\t", header=True)
    low = {c.lower().replace(" ", "_"): c for c in table.columns}
    kind = next((low[c] for c in ("element_subtype", "subtype") if c in low), None)
    name = next((low[c] for c in ("gene_symbol", "element_symbol") if c in low), None)
    if not kind or not name:
        raise PrepError("the report lacks a symbol or a subtype")
    rows = table.filter(F.col(f"`{kind}`").startswith("POINT")).select(F.col(f"`{name}`").alias("name"))
    return rows.select("name", substitution(F.col("name")).alias("s")).select("name", "s.*").filter("aa_pos is not null")


def glm_results(table: DataFrame) -> DataFrame:
    """variant, effect, se, p for ALT of an external scan's rows of the additive test without error; effects for REF are turned."""
    used = table.filter((F.col("TEST") == "ADD") & F.coalesce(F.col("ERRCODE") == ".", F.lit(True)))
    known = (F.col("A1") == F.col("ALT")) | (F.col("A1") == F.col("REF"))
    sign = F.when(F.col("A1") == F.col("ALT"), 1.0).otherwise(-1.0)
    beta = F.ln(F.col("OR").cast("double")) if "OR" in table.columns else F.col("BETA").cast("double")
    se = F.col("LOG(OR)_SE" if "LOG(OR)_SE" in table.columns else "SE")
    checked = F.when(known, sign * beta).otherwise(F.raise_error(F.concat(F.lit("A1 is neither REF nor ALT at "), F.col("ID"))).cast("double"))
    return used.select(F.col("ID").alias("variant"), checked.alias("effect"), se.cast("double").alias("se"), F.col("P").cast("double").alias("p"))


def fasta(contigs: DataFrame, width: int = 80) -> DataFrame:
    """value: lines of FASTA for contigs (name, sequence), in the order of name; other letters than nucleotide codes are an error."""
    s = F.upper("sequence")
    checked = F.when(s.rlike(NUCLEOTIDES), s).otherwise(F.raise_error(F.concat(F.lit("no nucleotide sequence: "), F.col("name"))).cast("string"))
    wrapped = F.regexp_replace(checked, f"(.{{{width}}})(?=.)", "$1\n")
    return contigs.orderBy("name").select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value"))


def chromosomes(spec: str) -> list[str]:
    """1-3,X is 1, 2, 3 and X."""
    out: list[str] = []
    for part in spec.replace(" ", "").split(","):
        a, _, b = part.partition("-")
        out += [str(i) for i in range(int(a), int(b) + 1)] if b else [a] if a else []
    return list(dict.fromkeys(out))


def digest(df: DataFrame) -> str:
    """A hash of the rows of df, in whatever order and files they lie: the sum of their hashes and their number."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{n}|{total}".encode()).hexdigest()


def screening_phenotype(pheno: DataFrame) -> DataFrame:
    """samples, phenotype for an external screening tool that knows no censoring: exact values alone."""
    return pheno.filter("log2_lower = log2_upper").select(F.col("sample_id").alias("samples"), F.col("log2_lower").alias("phenotype"))


def screening_results(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, effect, se, p_value (of Wald, from effect and error), q_value of an external screen; rows with notes are kept and don't count."""
    import pyarrow as pa

    from ..functions.dist import norm_sf
    from ..operators.ranks import adjusted
    from ..runtime import ship

    table = spark.read.csv(path, sep="\t", header=True)
    missing = {"variant", "beta", "beta-std-err"} - set(table.columns)
    if missing:
        raise PrepError(f"{path} lacks {sorted(missing)}")
    notes = F.col("notes") if "notes" in table.columns else F.lit(None).cast("string")
    rows = table.select(F.col("variant").alias("feature_id"), F.col("beta").try_cast("double").alias("effect"), F.col("`beta-std-err`").try_cast("double").alias("se"), notes.alias("notes"))
    ship(spark)

    def wald(batches):
        for b in batches:
            z = b.column("effect").to_numpy(zero_copy_only=False).astype(float) / b.column("se").to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(2 * norm_sf(abs(z)), from_pandas=True)], names=[*b.schema.names, "p_value"])

    found = rows.mapInArrow(wald, "feature_id string, effect double, se double, notes string, p_value double")
    clean = found.withColumn("_p", F.when(F.col("notes").isNull() | (F.col("notes") == ""), F.col("p_value")))
    return adjusted(clean, "_p", "feature_id").withColumnRenamed("fdr_bh", "q_value").drop("_p", "bonferroni")
