"""Text formats of methylation data, as functions of tables of lines (one column, value) and back.

Readers take a path; parsers take lines, so that they also serve streams. Fields are parted by runs of spaces or tabs. Malformed lines raise when they are
evaluated, unless ``relaxed``, which drops fields beyond the format's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP = "[ \\t]+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, plain or gzip."""
    return spark.read.text(path)


def fields(df: DataFrame) -> DataFrame:
    """Lines that are no header, split."""
    return df.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.split(F.regexp_replace("value", "^[ \\t]+|[ \\t\\r]+$", ""), GAP).alias("f"))


def checked(rows: DataFrame, ok: Column, what: str) -> DataFrame:
    """Rows, or an error that shows the first bad one."""
    guard = F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.concat(F.lit(f"malformed {what}: "), F.array_join("f", " "))).cast("boolean")).otherwise(True)
    return rows.where(guard)


def parse_counts(df: DataFrame, relaxed: bool = False) -> DataFrame:
    """(chrom, pos, strand, context, meth, n_reads, n_meth)."""
    f = F.col("f")
    size = F.size(f) >= 6 if relaxed else F.size(f) == 6
    rows = checked(fields(df), size & F.get(f, F.lit(2)).isin("+", "-") & F.get(f, F.lit(1)).try_cast("long").isNotNull() & F.get(f, F.lit(4)).try_cast("double").between(0, 1) & F.get(f, F.lit(5)).try_cast("long").isNotNull(), "site")
    out = rows.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("strand"), f[3].alias("context"), f[4].cast("double").alias("meth"), f[5].cast("long").alias("n_reads"))
    return out.withColumn("n_meth", F.round(F.col("meth") * F.col("n_reads")).cast("long"))


def format_counts(sites: DataFrame) -> DataFrame:
    """Lines of counts, levels with six significant digits."""
    level = F.when(F.col("n_reads") > 0, F.col("n_meth").cast("double") / F.col("n_reads")).otherwise(0.0)
    return sites.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "strand", "context", significant(level), F.col("n_reads").cast("string")).alias("value"))


def significant(x: Column, digits: int = 6) -> Column:
    """A number in [0, 1] as %.6g would write it, without exponents."""
    lead = F.when(x > 0, F.floor(F.log10(x)) + 1).otherwise(0)
    places = F.least(F.lit(12), digits - lead).cast("int")
    shown = F.format_string("%.12f", F.round(x * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places))
    return F.regexp_replace(F.regexp_replace(shown, "0+$", ""), "\\.$", "")


def header(df: DataFrame) -> DataFrame:
    """Chromosome sizes from header lines ``#chrom size``."""
    h = df.where(F.col("value").rlike("^#[^ \\t]+[ \\t]+[0-9]+$")).select(F.split(F.substring("value", 2, 1 << 20), GAP).alias("f"))
    return h.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("size"))


def format_header(sizes: DataFrame, version: str = "1.0") -> DataFrame:
    """Header lines in order: version, sizes, end."""
    rows = sizes.select(F.col("ord").alias("at"), F.concat(F.lit("#"), "chrom", F.lit(" "), F.col("size").cast("string")).alias("value"))
    ends = sizes.sparkSession.createDataFrame([(-1, f"#cytoframe {version}"), (1 << 40, "#")], "at long, value string")
    return rows.union(ends).orderBy("at").select("value")


def looks_like_counts(df: DataFrame, sample: int = 10000) -> DataFrame:
    """One row about the first lines: whether all are sites, only CpG, and only the plus strand."""
    f = F.col("f")
    rows = fields(df.limit(sample))
    site = (F.size(f) == 6) & F.get(f, F.lit(2)).isin("+", "-") & F.get(f, F.lit(1)).try_cast("long").isNotNull()
    return rows.agg(F.coalesce(F.bool_and(site), F.lit(False)).alias("sites"), F.coalesce(F.bool_and(F.startswith(F.get(f, F.lit(3)), F.lit("CpG"))), F.lit(False)).alias("cpg_only"), F.coalesce(F.bool_and(F.get(f, F.lit(2)) == "+"), F.lit(False)).alias("symmetric"))


def looks_like_xcounts(df: DataFrame, sample: int = 1000) -> bool:
    """Whether the first lines have chromosome lines and triples of numbers only."""
    f = F.col("f")
    rows = fields(df.limit(sample))
    ok = (F.size(f) == 1) | ((F.size(f) == 3) & f[0].rlike("^[0-9]+$"))
    r = rows.agg(F.bool_and(ok).alias("ok"), F.bool_or(F.size(f) == 3).alias("some")).first()
    return bool(r["ok"] and r["some"])


def looks_like_array(df: DataFrame) -> bool:
    """Whether lines have five fields: microarray levels rather than counts."""
    r = fields(df.limit(1)).select(F.size("f").alias("n")).first()
    return bool(r and r["n"] == 5)


def format_xcounts(rows: DataFrame) -> DataFrame:
    """Lines (chrom, at, value) of compact counts from (chrom, delta, n_meth, n_unmeth, pos): a line with the name before each chromosome."""
    body = rows.select("chrom", F.col("pos").alias("at"), F.concat_ws("\t", *[F.col(c).cast("string") for c in ("delta", "n_meth", "n_unmeth")]).alias("value"))
    return rows.select("chrom", F.lit(-1).cast("long").alias("at"), F.col("chrom").alias("value")).distinct().union(body)


def number_lines(df: DataFrame) -> DataFrame:
    """Lines with ``ln``, ascending in the order of an unsplit file."""
    return df.withColumn("ln", F.monotonically_increasing_id())


def parse_xcounts(numbered: DataFrame, split: Column | None = None) -> DataFrame:
    """(chrom, pos, n_meth, n_unmeth) from lines with ``ln``.

    Deltas follow the lines. Positions are summed within a split of the file, of which the upper bits of ``ln`` tell, or ``split``, which ascends with it; what the splits before carry over, a chromosome and a position, comes from one row for each split.
    """
    rows = numbered.where(~F.startswith("value", F.lit("#"))).select("ln", (F.shiftright("ln", 33) if split is None else split).alias("split"), F.split(F.trim("value"), GAP).alias("f")).where(F.size("f").isin(1, 3) & (F.col("f")[0] != ""))
    rows = rows.select("ln", "split", "f", F.when(F.size("f") == 1, F.col("f")[0]).alias("name"), F.when(F.size("f") == 3, F.col("f")[0].cast("long")).otherwise(0).alias("delta"))
    line = Window.partitionBy("split").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last("name", ignorenulls=True).over(line)).withColumn("run", F.count("name").over(line))
    rows = rows.withColumn("at", F.sum("delta").over(Window.partitionBy("split", "run").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("split").agg(F.max_by("own", "ln").alias("own"), F.max_by("at", "ln").alias("tail"))
    every = Window.partitionBy(F.lit(0)).orderBy("split")  # a row for each split
    ends = ends.withColumn("last", F.last("own", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, 0))).withColumn("since", F.count("own").over(every.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("sum", F.sum("tail").over(Window.partitionBy("since").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)))
    carried = ends.select("split", F.lag("last").over(every).alias("before"), F.lag("sum", 1, 0).over(every).alias("offset"))
    out = rows.where(F.size("f") == 3).join(carried, "split")
    first = F.col("run") == 0
    return out.select(F.when(first, F.col("before")).otherwise(F.col("own")).alias("chrom"), (F.col("at") + F.when(first, F.col("offset")).otherwise(0)).alias("pos"), F.col("f")[1].cast("long").alias("n_meth"), F.col("f")[2].cast("long").alias("n_unmeth"))


def parse_bed(df: DataFrame) -> DataFrame:
    """Intervals (chrom, start, stop, name, score, strand) of lines with three fields, or six or more; missing names are numbered."""
    f = F.col("f")
    rows = checked(fields(df), (F.size(f) == 3) | (F.size(f) >= 6) & F.get(f, F.lit(5)).isin("+", "-"), "interval")
    rows = rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("stop"), F.get(f, F.lit(3)).alias("name"), F.get(f, F.lit(4)).try_cast("double").alias("score"), F.get(f, F.lit(5)).alias("strand"))
    number = F.concat(F.lit("X"), (F.row_number().over(Window.partitionBy("chrom").orderBy("start", "stop")) - 1).cast("string"))
    return rows.withColumn("name", F.coalesce("name", number)).withColumn("strand", F.coalesce("strand", F.lit("+"))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def format_bed(intervals: DataFrame, six: bool = True) -> DataFrame:
    cols = ["chrom", "start", "stop", "name", "score", "strand"] if six else ["chrom", "start", "stop"]
    return intervals.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq), names cut at white space. Records are read whole, by their leading sign."""
    return parse_fasta(spark.read.option("lineSep", ">").text(path))


def parse_fasta(records: DataFrame) -> DataFrame:
    """Records without their leading sign."""
    rows = records.where(F.trim("value") != "").select(F.regexp_extract("value", "^([^ \\t\\r\\n]+)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("value", "^[^\\n]*\\n?", ""), "\\s", "").alias("seq"))
    return rows.select("chrom", F.upper("seq").alias("seq"))


def parse_fastq(numbered: DataFrame) -> DataFrame:
    """(ordinal, name, seq, qual) from lines with consecutive ``ln`` from 0: four lines a record."""
    rows = numbered.select(F.floor(F.col("ln") / 4).alias("ordinal"), (F.col("ln") % 4).alias("k"), "value")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return rows.groupBy("ordinal").agg(F.regexp_replace(at(0), "^@|[ \\t].*$", "").alias("name"), at(1).alias("seq"), at(3).alias("qual"))


def format_fastq(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))


def parse_sam(df: DataFrame) -> DataFrame:
    """Mapped reads (qname, flag, chrom, pos, strand, cigar, seq, tags), pos from 0."""
    f = F.split("value", "\t")
    rows = df.where(~F.startswith("value", F.lit("@"))).select(f.alias("f")).where((F.size("f") >= 11) & (F.col("f")[2] != "*"))
    tag = F.map_from_entries(F.transform(F.filter(F.slice("f", 12, 1 << 20), lambda t: F.size(F.split(t, ":", 3)) == 3), lambda t: F.struct(F.split(t, ":", 3)[0].alias("k"), F.split(t, ":", 3)[2].alias("v"))))
    c = F.col("f")
    return rows.select(c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("chrom"), (c[3].cast("long") - 1).alias("pos"), F.when(c[1].cast("int").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+").alias("strand"), c[5].alias("cigar"), c[9].alias("seq"), tag.alias("tags"))


def sam_header(references: list[tuple[str, int]], program: str = "cytoframe", command: str = "") -> str:
    """Header lines: format, chromosomes, and the program with its command."""
    lines = ["@HD\tVN:1.6", *(f"@SQ\tSN:{n}\tLN:{s}" for n, s in references), f"@PG\tID:{program}\tPN:{program}" + (f"\tCL:{command}" if command else "")]
    return "\n".join(lines) + "\n"


def format_sam(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat_ws("\t", "qname", F.when(F.col("strand") == "-", "16").otherwise("0"), "chrom", (F.col("pos") + 1).cast("string"), F.lit("255"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*")).alias("value"))


def read_bam(spark: SparkSession, path: str, tags: bool = False, split: int | None = None) -> DataFrame:
    """Mapped reads of a BAM file, or of those in a folder, in splits by byte range; minus reads in reading direction. With ``tags``, a map of them as text."""
    from cytoframe.sources.bam import Bam

    spark.dataSource.register(Bam)
    reader = spark.read.format("bam")
    rows = (reader.option("split", split) if split else reader).load(path)
    return rows if tags else rows.drop("tags")


def write_bam(reads: DataFrame, path: str, references: list[tuple[str, int]], program: str = "cytoframe") -> None:
    """Reads (qname, chrom, pos, strand, cigar, seq in reading direction) as BAM files in a folder, one for each partition, with a line of the program in the header."""
    from cytoframe.sources.bam import Bam

    reads.sparkSession.dataSource.register(Bam)
    rows = reads.select("qname", "chrom", F.col("pos").cast("long").alias("pos"), "strand", "cigar", "seq")
    rows.write.format("bam").mode("append").option("references", ",".join(f"{n}:{s}" for n, s in references)).option("program", program).save(path)


def parse_epireads(df: DataFrame) -> DataFrame:
    f = F.col("f")
    rows = checked(fields(df), (F.size(f) == 3) & F.get(f, F.lit(2)).rlike("^[CTN]+$"), "read states")
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("seq"))


def parse_table(df: DataFrame) -> DataFrame:
    """Rows (chrom, pos, strand, context, n, m) of a merged table: name, then pairs of reads and methylated reads."""
    f = F.split(F.trim("value"), "[:\\t ]+")
    rows = df.select(f.alias("f")).where((F.size("f") >= 6) & (F.size("f") % 2 == 0) & F.get(F.col("f"), F.lit(1)).rlike("^[0-9]+$"))
    pick = lambda k: F.transform(F.sequence(F.lit(4), F.size("f") - 2, F.lit(2)), lambda i: F.get(F.col("f"), i + k).cast("double"))
    c = F.col("f")
    return rows.select(c[0].alias("chrom"), c[1].cast("long").alias("pos"), c[2].alias("strand"), c[3].alias("context"), pick(0).alias("n"), pick(1).alias("m"))


def parse_design(text: str) -> tuple[list[str], list[str], list[list[int]]]:
    """(factors, samples, rows of 0 and 1) of a design matrix."""
    first, *rest = [line.split() for line in text.splitlines() if line.strip()]
    for row in rest:
        if len(row) != len(first) + 1 or not set(row[1:]) <= {"0", "1"}:
            raise ValueError(f"bad design row: {row}")
    return first, [r[0] for r in rest], [[int(x) for x in r[1:]] for r in rest]


def parse_diffs(df: DataFrame) -> DataFrame:
    f = F.col("f")
    rows = checked(fields(df), F.size(f) == 9, "comparison")
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("strand"), f[3].alias("context"), f[4].cast("double").alias("score"), *[f[5 + i].cast("long").alias(n) for i, n in enumerate(("meth_a", "unmeth_a", "meth_b", "unmeth_b"))])


def parse_regression(df: DataFrame) -> DataFrame:
    """(chrom, pos, strand, context, p); values that are no numbers count as 1."""
    f = F.col("f")
    return checked(fields(df), F.size(f) >= 5, "regression").select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("strand"), f[3].alias("context"), F.coalesce(f[4].try_cast("double"), F.lit(1.0)).alias("p"))


def parse_sizes(df: DataFrame) -> DataFrame:
    f = F.col("f")
    rows = checked(fields(df), (F.size(f) == 2) & F.get(f, F.lit(1)).try_cast("long").isNotNull(), "chromosome size")
    out = rows.groupBy(f[0].alias("chrom")).agg(F.max(f[1].cast("long")).alias("size"), F.count(F.lit(1)).alias("n"))
    return out.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated chromosome: "), "chrom")).cast("boolean")).otherwise(True)).drop("n")


def parse_lift_index(df: DataFrame) -> DataFrame:
    f = F.col("f")
    rows = checked(fields(df), F.size(f) == 5, "lift index")
    return rows.select(f[0].alias("from_chrom"), f[1].cast("long").alias("from_pos"), f[2].alias("to_chrom"), f[3].cast("long").alias("to_pos"), f[4].alias("to_strand"))


def parse_conversion_report(numbered: DataFrame) -> DataFrame:
    """(fpos, total, rate) of a conversion report: four header lines, then places with totals."""
    rows = numbered.where("ln >= 4").select(F.split(F.trim("value"), GAP).alias("f")).where(F.size("f") >= 10)
    c = F.col("f")
    return rows.select((c[0].cast("long") - 1).alias("fpos"), c[7].cast("long").alias("total"), c[9].cast("double").alias("rate"))


def parse_levels(text: str) -> dict[str, dict[str, float]]:
    """Groups of ``key: value`` lines under their names."""
    out: dict[str, dict[str, float]] = {}
    for line in text.splitlines():
        key, _, value = line.strip().partition(":")
        if not value.strip():
            out[key] = {}
        elif value.strip() != "NA":
            out[list(out)[-1]][key] = float(value)
    return out


def format_levels(rows: list[dict]) -> str:
    """The same, from rows with ``kind``."""
    out = []
    for r in rows:
        out.append(f"{r['kind']}:")
        out += [f"  {k}: {'NA' if v is None else v}" for k, v in r.items() if k != "kind"]
    return "\n".join(out) + "\n"


def merge_tracks(coverage: DataFrame, level: DataFrame) -> DataFrame:
    """Two tracks (chrom, start, value) of depth and level as counts; positions that one lacks count 0."""
    both = coverage.select("chrom", F.col("start").alias("pos"), F.col("value").alias("n")).join(level.select("chrom", F.col("start").alias("pos"), F.col("value").alias("l")), ["chrom", "pos"], "full_outer")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return both.select("chrom", "pos", n.alias("n_reads"), F.round(n * F.coalesce("l", F.lit(0.0))).cast("long").alias("n_meth"))


def parse_bedgraph(df: DataFrame) -> DataFrame:
    f = F.col("f")
    rows = fields(df).where((F.size(f) == 4) & f[1].rlike("^[0-9]+$"))
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("stop"), f[3].cast("double").alias("value"))


def approximate_lines(df: DataFrame, fraction: float = 0.1, seed: int = 1) -> float:
    """Number of lines, from a sample."""
    return df.sample(fraction, seed).count() / fraction


def format_wig(sites: DataFrame) -> DataFrame:
    """(chrom, at, value): a declaration before the positions, counted from 1, of each chromosome."""
    body = sites.select("chrom", F.col("pos").alias("at"), F.concat((F.col("pos") + 1).cast("string"), F.lit(" 1")).alias("value"))
    return sites.select("chrom", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("variableStep chrom="), "chrom").alias("value")).distinct().union(body)


def write_sorted(df: DataFrame, path: str, keys: list[str], gzip: bool = False) -> None:
    """Lines in order of ``keys``, range-partitioned so that files in order of name are in order."""
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value")
    out.write.text(path, compression="gzip" if gzip else "none")


def format_summary(row: DataFrame) -> DataFrame:
    """Lines ``key: value`` of a table of one row; null is NA."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA"))) for c in row.columns]
    return row.select(F.posexplode(F.array(*lines)).alias("at", "value"))


def format_json(rows: DataFrame) -> DataFrame:
    """Each row as a line of JSON, with its nulls."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def store_sites(sites: DataFrame, path: str) -> None:
    """Rows with chrom and pos as Parquet in order, so that row groups outside a range are passed over by their statistics."""
    sites.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.parquet(path)


def store_reads(epireads: DataFrame, path: str) -> None:
    """Epireads (chrom, pos, seq) in order, with the column ``stop`` that lookups prune by."""
    rows = epireads.withColumn("stop", F.col("pos") + F.length("seq"))
    rows.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.parquet(path)


def lookup_sites(sites: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
    """Rows at positions from start to below stop."""
    return sites.where((F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") < stop))


def lookup_reads(stored: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
    """Stored epireads with a site in the range: they begin before its stop and end after its start."""
    return stored.where((F.col("chrom") == chrom) & (F.col("pos") < stop) & (F.col("stop") > start))
