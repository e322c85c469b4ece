"""Genomic views of the driver's tables, as DataFrames and as the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three samples: (sample, chrom, pos, strand, context, n_reads, n_meth)."""
    q, d = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    part = F.col("l_partkey")
    other = F.element_at(F.array(*map(F.lit, ("CHH", "CXG", "CCG", "CHHx"))), (F.floor(part / 4) % 4 + 1).cast("int"))
    context = F.when(part % 4 == 3, other).when(part % 20 == 2, "CpGx").otherwise("CpG")
    odd = F.col("l_linenumber") % 2
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sample"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("chrom"),
        (2 * part + odd).cast("long").alias("pos"), F.when(odd == 0, "+").otherwise("-").alias("strand"), context.alias("context"),
        q.alias("q"), F.floor(q * d / 10).cast("long").alias("m"),
    )
    return rows.groupBy("sample", "chrom", "pos", "strand", "context").agg(F.sum("q").alias("n_reads"), F.sum("m").alias("n_meth"))


def intervals(spark: SparkSession, sf_dir: str, span: int = 4000) -> DataFrame:
    k = F.col("c_custkey")
    start = (k * 37) % span
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("chr"), (k % 5 + 1).cast("string")).alias("chrom"), start.cast("long").alias("start"), (start + 20 + k % 50).cast("long").alias("stop"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes (chrom, seq) made from texts."""
    seq = F.regexp_replace(F.translate(F.lower(F.col("text")), "etaoinshrdlu", "CGTACGTACGTA"), "[^ACGT]", "")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), seq.alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads (qname, chrom, pos, strand, cigar, seq) from turns of conversations, on the chromosome of the conversation's number."""
    seq = F.regexp_replace(F.translate(F.lower(F.col("text")), "etaoinshrdlu", "CGTACGTACGTA"), "[^ACGT]", "")
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(".", F.col("conv_id").cast("string"), t.cast("string")).alias("qname"), F.concat(F.lit("doc"), F.col("conv_id").cast("string")).alias("chrom"),
        (t * 7).cast("long").alias("pos"), F.when(t % 2 == 0, "+").otherwise("-").alias("strand"), seq.alias("seq"),
    ).where("length(seq) > 0").withColumn("cigar", F.concat(F.length("seq").cast("string"), F.lit("M")))


def epireads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-level states (chrom, pos, seq), pos in ordinals of sites."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    state = F.when(F.col("l_tax") == 0, "N").when(F.col("l_discount") >= 0.05, "C").otherwise("T")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*keys, state.alias("st")))).alias("a"))
    return rows.select(F.concat(F.lit("chr"), "l_linestatus").alias("chrom"), (F.col("l_orderkey") % 200).cast("long").alias("pos"), F.array_join(F.transform("a", lambda x: x["st"]), "").alias("seq"), F.col("l_orderkey").alias("read"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal alignments (read, chrom, start, stop, strand)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("read"), F.concat(F.lit("chr"), F.col("o_orderstatus")).alias("chrom"), F.col("o_custkey").alias("start"),
        (F.col("o_custkey") + 50 + F.col("o_orderkey") % 3).alias("stop"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


#: The same views in DuckDB SQL, as bodies of common table expressions.
VIEWS = {
    "sites": """SELECT l_returnflag AS sample, 'chr' || CAST(l_suppkey % 5 + 1 AS VARCHAR) AS chrom, CAST(2 * l_partkey + l_linenumber % 2 AS BIGINT) AS pos,
        CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand,
        CASE WHEN l_partkey % 4 = 3 THEN ['CHH', 'CXG', 'CCG', 'CHHx'][l_partkey // 4 % 4 + 1] WHEN l_partkey % 20 = 2 THEN 'CpGx' ELSE 'CpG' END AS context,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_reads, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 10) AS BIGINT) AS n_meth
        FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "intervals": """SELECT 'chr' || CAST(c_custkey % 5 + 1 AS VARCHAR) AS chrom, CAST((c_custkey * 37) % 4000 AS BIGINT) AS start, CAST((c_custkey * 37) % 4000 + 20 + c_custkey % 50 AS BIGINT) AS stop, c_name AS name,
        CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM customer""",
    "genome": "SELECT 'doc' || CAST(doc_id AS VARCHAR) AS chrom, regexp_replace(translate(lower(text), 'etaoinshrdlu', 'CGTACGTACGTA'), '[^ACGT]', '', 'g') AS seq FROM documents",
    "reads": """SELECT * FROM (SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS qname, 'doc' || CAST(conv_id AS VARCHAR) AS chrom, CAST(turn * 7 AS BIGINT) AS pos,
        CASE WHEN turn % 2 = 0 THEN '+' ELSE '-' END AS strand, regexp_replace(translate(lower(text), 'etaoinshrdlu', 'CGTACGTACGTA'), '[^ACGT]', '', 'g') AS seq FROM conversations) WHERE length(seq) > 0""",
    "epireads": """SELECT 'chr' || l_linestatus AS chrom, CAST(l_orderkey % 200 AS BIGINT) AS pos, l_orderkey AS read,
        string_agg(CASE WHEN l_tax = 0 THEN 'N' WHEN l_discount >= 0.05 THEN 'C' ELSE 'T' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS seq
        FROM lineitem GROUP BY l_linestatus, l_orderkey""",
    "alignments": """SELECT o_orderkey AS read, 'chr' || o_orderstatus AS chrom, o_custkey AS start, o_custkey + 50 + o_orderkey % 3 AS stop, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the views it reads put before it; ``sql`` may go on with further expressions after a leading comma."""
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names)
    return f"{head}{sql}" if sql.lstrip().startswith(",") else f"{head} {sql}"
