"""Operators on reads: rows (qname, chrom, pos, strand, cigar, seq), sequences in reading direction of the plus strand
for plus reads, and to be reverse-complemented for minus reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions import expr as E
from cytoframe.operators import sites as S

#: CIGAR operations that take a base of the read, and of the reference.
OF_READ, OF_REFERENCE = "MIS=X", "MDN=X"


def unique_reads(rows: DataFrame, seed: int = 408, most: int | None = None) -> DataFrame:
    """One read of those that share chrom, start, stop and strand, chosen by a seeded hash; with the number of copies.

    With ``most``, the choice is among that many reads, the first by name; all copies are counted all the same. Groups aren't gathered: the choice is an aggregate with partial sums.
    """
    keys = ["chrom", "start", "stop", "strand"]
    group = Window.partitionBy(*keys)
    if most is not None:
        near = rows.withColumn("copies", F.count(F.lit(1)).over(group)).withColumn("_k", F.row_number().over(group.orderBy("read"))).where(F.col("_k") <= most).drop("_k")
    else:
        near = rows.withColumn("copies", F.lit(1).cast("long"))
    other = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*other), F.struct(F.xxhash64(F.lit(seed), "read"), "read")).alias("_r")
    copies = F.max("copies") if most is not None else F.sum("copies")
    one = near.groupBy(*keys).agg(copies.alias("copies"), first)
    return one.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns], "copies")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Number of copies and the first read of each group."""
    return rows.groupBy("chrom", "start", "stop", "strand").agg(F.count(F.lit(1)).alias("copies"), F.min("read").alias("first_read"))


def duplicate_stats(rows: DataFrame) -> DataFrame:
    g = duplicate_groups(rows)
    return g.agg(F.sum("copies").alias("reads_in"), F.count(F.lit(1)).alias("reads_out"), F.count(F.when(F.col("copies") > 1, 1)).alias("duplicated"), F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)).alias("in_groups"))


def aligned_blocks(cigar: Column, pos: Column) -> Column:
    """Array of (read offset, reference position, length) of the aligned runs of a CIGAR, by running sums over its operations."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda o: F.struct(F.regexp_extract(o, r"(\d+)", 1).cast("long").alias("n"), F.right(o, F.lit(1)).alias("op")))
    start = F.struct(F.lit(0).cast("long").alias("q"), pos.cast("long").alias("r"), F.array().cast("array<struct<q:bigint,r:bigint,n:bigint>>").alias("out"))
    takes = lambda x, kinds: F.when(x["op"].isin(*kinds), x["n"]).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        here = F.array(F.struct(acc["q"].alias("q"), acc["r"].alias("r"), x["n"].alias("n")))
        return F.struct((acc["q"] + takes(x, OF_READ)).alias("q"), (acc["r"] + takes(x, OF_REFERENCE)).alias("r"), F.when(x["op"].isin("M", "=", "X"), F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def reference_width(cigar: Column) -> Column:
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MDN=X])"), 1)
    return F.aggregate(F.transform(ops, lambda o: F.regexp_extract(o, r"(\d+)", 1).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)


def bases(reads: DataFrame) -> DataFrame:
    """Aligned bases: (qname, chrom, strand, rpos, fpos, base, original), by reference position; ``base`` on the plus strand, ``original`` and its place
    ``fpos`` as sequenced."""
    plus = F.when(F.col("strand") == "-", E.reverse_complement("seq")).otherwise(F.col("seq"))
    rows = reads.select("qname", "chrom", "strand", plus.alias("s"), F.length("seq").alias("len"), F.explode(aligned_blocks(F.col("cigar"), F.col("pos"))).alias("b"))
    rows = rows.select("qname", "chrom", "strand", "len", F.col("b.q").alias("q"), F.col("b.r").alias("r"), F.substr("s", (F.col("b.q") + 1).cast("int"), F.col("b.n").cast("int")).alias("s"))
    rows = rows.select("qname", "chrom", "strand", "len", "q", "r", F.posexplode(F.split("s", "")).alias("i", "base")).where("base <> ''")
    at = F.col("q") + F.col("i")
    return rows.select("qname", "chrom", "strand", (F.col("r") + F.col("i")).alias("rpos"), F.when(F.col("strand") == "-", F.col("len") - 1 - at).otherwise(at).alias("fpos"), "base", F.when(F.col("strand") == "-", F.translate("base", "ACGT", "TGCA")).otherwise(F.col("base")).alias("original"))


def counts(reads: DataFrame, genome_sites: DataFrame, covered_only: bool = False) -> DataFrame:
    """Per-cytosine counts: reads of the site's strand show C or T; the other strand's reads tell whether the site is mutated."""
    return counts_of_bases(bases(reads), genome_sites, covered_only)


def counts_of_bases(b: DataFrame, genome_sites: DataFrame, covered_only: bool = False) -> DataFrame:
    per = b.groupBy("chrom", F.col("rpos").alias("pos")).agg(*[F.count(F.when((F.col("strand") == s) & (F.col("original") == x), 1)).alias(f"{n}{x}") for s, n in (("+", "p"), ("-", "n")) for x in "ACGT"])
    at = genome_sites.join(per, ["chrom", "pos"], "inner" if covered_only else "left").na.fill(0)
    own = lambda x: F.when(F.col("strand") == "+", F.col(f"p{x}")).otherwise(F.col(f"n{x}"))
    mate = lambda x: F.when(F.col("strand") == "+", F.col(f"n{x}")).otherwise(F.col(f"p{x}"))
    mutated = mate("G") < 0.5 * (mate("A") + mate("C") + mate("G") + mate("T"))
    out = at.select("chrom", "pos", "strand", E.set_mutated("context", mutated).alias("context"), own("C").alias("n_meth"), (own("C") + own("T")).alias("n_reads"))
    return out.where("n_reads > 0") if covered_only else out


def cpg_index(genome: DataFrame) -> DataFrame:
    """CpG sites of a genome numbered from 0 on each chromosome."""
    cpg = S.kmer_sites(genome, "CG", 0)
    return cpg.select("chrom", "pos", (F.row_number().over(Window.partitionBy("chrom").orderBy("pos")) - 1).cast("long").alias("i"))


def states(reads: DataFrame, index: DataFrame) -> DataFrame:
    """Read-level states over CpG: (qname, chrom, pos, seq), pos the number of the first site under the read, seq of C, T and N; reads with a state only."""
    return states_of_bases(bases(reads), index)


def states_of_bases(b: DataFrame, index: DataFrame) -> DataFrame:
    site = F.when(F.col("strand") == "-", F.col("rpos") - 1).otherwise(F.col("rpos"))
    state = F.when(F.col("original") == "C", "C").when(F.col("original") == "T", "T").otherwise("N")
    known = b.select("qname", "chrom", site.alias("pos"), state.alias("state")).join(index, ["chrom", "pos"])
    # sites under the read without an aligned base are N: the span of the read on the index gives all of them
    rows = known.groupBy("qname", "chrom").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.map_from_entries(F.collect_list(F.struct("i", "state"))).alias("m"), F.max((F.col("state") != "N").cast("int")).alias("some")).where("some = 1")
    letters = F.transform(F.sequence("first", "last"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("N")))
    return rows.select("qname", "chrom", F.col("first").alias("pos"), F.array_join(letters, "").alias("seq"))


def conversion(reads: DataFrame, genome: DataFrame, all_contexts: bool = False) -> DataFrame:
    """Bases over reference cytosines of the read's strand outside CpG, by place in the read: (fpos, strand, total, converted, errors)."""
    spine = S.cytosines(genome)
    return conversion_of_bases(bases(reads), spine if all_contexts else spine.where(~E.is_cpg()))


def conversion_of_bases(b: DataFrame, spine: DataFrame) -> DataFrame:
    hit = b.join(spine.select("chrom", F.col("pos").alias("rpos"), "strand"), ["chrom", "rpos", "strand"])
    o = F.col("original")
    return hit.groupBy("fpos", "strand").agg(F.count(F.when(o.isin("C", "T"), 1)).alias("total"), F.count(F.when(o == "T", 1)).alias("converted"), F.count(F.when(o.isin("A", "G"), 1)).alias("errors"))


def conversion_rates(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rates from counts of conversion, over ``keys``."""
    of = lambda c, s: F.coalesce(F.sum(F.when(F.col("strand") == s, F.col(c))), F.lit(0))
    out = parts.groupBy(*keys).agg(of("total", "+").alias("total_plus"), of("converted", "+").alias("converted_plus"), of("total", "-").alias("total_minus"), of("converted", "-").alias("converted_minus"), F.sum("errors").alias("errors"))
    ratio = lambda a, b: F.round(a.cast("double") / F.greatest(F.lit(1), b), 6)
    total, converted = F.col("total_plus") + F.col("total_minus"), F.col("converted_plus") + F.col("converted_minus")
    return out.select(*keys, "total_plus", "converted_plus", ratio(F.col("converted_plus"), F.col("total_plus")).alias("rate_plus"), "total_minus", "converted_minus", ratio(F.col("converted_minus"), F.col("total_minus")).alias("rate_minus"), total.alias("total"), converted.alias("converted"), ratio(converted, total).alias("rate"), "errors", (total + F.col("errors")).alias("valid"), ratio(F.col("errors"), total + F.col("errors")).alias("error_rate"))


def conversion_histogram(reads: DataFrame, genome: DataFrame, bins: int = 20) -> DataFrame:
    """Reads by the share of their cytosines outside CpG that were converted: (bin, reads)."""
    spine = S.cytosines(genome).where(~E.is_cpg())
    hit = bases(reads).join(spine.select("chrom", F.col("pos").alias("rpos"), "strand"), ["chrom", "rpos", "strand"]).where(F.col("original").isin("C", "T"))
    per = hit.groupBy("qname", "chrom").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("original") == "T", 1)).alias("converted"))
    return per.groupBy(F.least(F.floor(F.col("converted") * bins / F.col("total")), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("reads"))


def flip_conversion(reads: DataFrame, column: str = "conversion") -> DataFrame:
    """A-rich reads as T-rich ones and the other way round: strand, sequence and tag (A or T) turn."""
    turned = {"strand": F.when(F.col("strand") == "+", "-").otherwise("+"), "seq": E.reverse_complement("seq"), column: F.when(F.col(column) == "A", "T").otherwise("A")}
    return reads.withColumns(turned)


def merge_rates(reports: DataFrame) -> DataFrame:
    """Rates by place of several reports (fpos, total, rate), averaged by their totals."""
    out = reports.groupBy("fpos").agg(F.sum("total").alias("total"), F.sum(F.col("rate") * F.col("total")).alias("w"))
    return out.select("fpos", "total", F.round(F.col("w") / F.greatest(F.lit(1), "total"), 6).alias("rate"))


def hairpins(pairs: DataFrame, cutoff: float = 0.95, bins: int = 20, min_length: int = 20) -> DataFrame:
    """Mates (name, seq1, seq2) compared base by base under conversion (T like C, A like G): matching share, bin and whether it is a hairpin."""
    rows = pairs.where((F.length("seq1") >= min_length) & (F.length("seq2") >= min_length))
    alike = lambda x, y: ((x != "N") & (x == y)) | ((x == "T") & (y == "C")) | ((x == "G") & (y == "A"))
    both = lambda x, y: F.when(y.isNull() | x.isNull() | (x == "") | (y == ""), F.struct(F.lit(0).alias("m"), F.lit(0).alias("n"))).otherwise(F.struct(alike(x, y).cast("int").alias("m"), (x.isin(*"ACGT") & y.isin(*"ACGT")).cast("int").alias("n")))
    seen = F.zip_with(F.split("seq1", ""), F.split("seq2", ""), both)
    total = lambda k: F.aggregate(seen, F.lit(0), lambda a, x: a + x[k])
    out = rows.select("name", total("n").alias("n"), total("m").alias("matching")).where("n > 0")
    share = F.col("matching").cast("double") / F.col("n")
    return out.select("name", "n", "matching", F.round(share, 6).alias("share"), F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin"), (share > cutoff).alias("hairpin"))


def clean_hairpins(pairs: DataFrame, cutoff: float = 0.95, min_length: int = 20, min_valid: float = 0.5, invert: bool = False) -> DataFrame:
    """The pairs (name, seq1, seq2, ...) that are long enough, have at least that share of valid bases, and are no hairpins; or with ``invert`` those that are."""
    valid = E.base_count("seq1", "A") + E.base_count("seq1", "C") + E.base_count("seq1", "G") + E.base_count("seq1", "T") + E.base_count("seq2", "A") + E.base_count("seq2", "C") + E.base_count("seq2", "G") + E.base_count("seq2", "T")
    good = pairs.where((F.length("seq1") >= min_length) & (F.length("seq2") >= min_length) & (valid >= min_valid * (F.length("seq1") + F.length("seq2"))))
    found = hairpins(good, cutoff, min_length=min_length).where("hairpin").select("name")
    return good.join(found, "name", "left_semi" if invert else "left_anti")


def protocol_model(t_rich: bool, shares: dict[str, float] | None = None, conversion: float = 0.98) -> dict[str, float]:
    """Base shares of converted reads: C mostly turned to T, or G to A."""
    out = dict(shares or dict.fromkeys("ACGT", 0.25))
    source, target = ("C", "T") if t_rich else ("G", "A")
    out[target] += conversion * out[source]
    out[source] *= 1 - conversion
    return out


def protocol_votes(fastq: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Posterior of each read (name, seq) of being rich in T rather than in A. With mates in ``seq2``, whose bases are turned the other way, that of the pair."""
    t, a = protocol_model(True, shares), protocol_model(False, shares)
    total = sum((E.base_count("seq", x) * (math.log(a[x]) - math.log(t[x])) for x in "ACGT"), F.lit(0.0))
    if "seq2" in fastq.columns:
        total = total - sum((E.base_count("seq2", x) * (math.log(a[x]) - math.log(t[x])) for x in "ACGT"), F.lit(0.0))
    return fastq.select("name", (1 / (1 + F.exp(F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))))).alias("t_rich"))


def guess_protocol(fastq: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """wgbs if first reads are rich in T, pbat if rich in A, rpbat if mixed; sure of it beyond narrower cutoffs."""
    mean = protocol_votes(fastq, shares).agg(F.count(F.lit(1)).alias("reads"), F.avg("t_rich").alias("fraction"))
    f = F.col("fraction")
    kind = F.when(f > 0.9, "wgbs").when(f < 0.1, "pbat").otherwise("rpbat")
    sure = (f > 0.99) | (f < 0.01) | ((f > 0.2) & (f < 0.8))
    return mean.select("reads", F.round("fraction", 6).alias("fraction"), kind.alias("protocol"), F.when(sure, "high").otherwise("low").alias("confidence"))


#: How mappers name the tag of the conversion, and the pattern of its values for reads in which G was turned to A.
MAPPERS = {"bsmap": ("ZS", "^.-"), "bismark": ("XR", "^GA$")}


def standardize(reads: DataFrame, mapper: str) -> DataFrame:
    """Alignments of a mapper in one form: a column ``conversion`` (T or A), mismatches ``nm``, no qualities and no other tags, and the sequence in reading direction.

    ``reads`` has a map ``tags`` of strings, and strand and seq as stored. A read without the mapper's tag or NM fails the query, as it can't be read. Mappers whose tags are in that form
    already ("abismal", "walt") pass.
    """
    if mapper in ("abismal", "walt"):
        return reads
    if mapper not in MAPPERS:
        raise ValueError(f"unknown mapper {mapper}")
    tag, a_rich = MAPPERS[mapper]
    value, nm = F.try_element_at("tags", F.lit(tag)), F.try_element_at("tags", F.lit("NM"))
    missing = lambda t: F.raise_error(F.concat(F.lit(f"no {t} tag in "), F.col("qname")))
    out = {
        "conversion": F.when(value.isNull(), missing(tag)).when(value.rlike(a_rich), "A").otherwise("T"),
        "nm": F.when(nm.isNull(), missing("NM").cast("long")).otherwise(nm.cast("long")),
        "seq": F.when(F.col("strand") == "-", E.reverse_complement("seq")).otherwise(F.col("seq")),
        "qual": F.lit("*"),
    }
    return reads.withColumns(out).drop("tags")


def over_reference(seq: Column, cigar: Column, fill: str = "N") -> Column:
    """A read laid out over the reference: insertions and clips dropped, deletions filled."""
    runs = aligned_blocks(cigar, F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("s"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.repeat(F.lit(fill), (x["r"] - acc["at"]).cast("int"))
        return F.struct((x["r"] + x["n"]).alias("at"), F.concat(acc["s"], gap, F.substr(seq, (x["q"] + 1).cast("int"), x["n"].cast("int"))).alias("s"))

    laid = F.aggregate(runs, start, add, lambda acc: acc["s"])
    return F.rpad(laid, reference_width(cigar).cast("int"), fill)


def merge_mates(rows: DataFrame, max_fragment: int = 10000) -> DataFrame:
    """Two ends of a fragment (name, end, chrom, pos, strand, cigar, seq as stored on the plus strand) as one read over the reference.

    Ends on one chromosome whose fragment is positive and at most ``max_fragment`` merge: a gap is filled with N, in an overlap the first end's
    bases stay; an end that reaches past the other's start is cut there. Other ends are passed on alone. The result's cigar is the fragment's width.
    Only ends of one name meet; all else is done by columns.
    """
    end = F.struct("end", "chrom", F.col("pos").cast("long").alias("pos"), "strand", over_reference(F.col("seq"), F.col("cigar")).alias("x"))
    both = rows.select("name", end.alias("e")).groupBy("name").agg(F.sort_array(F.collect_list("e")).alias("ends"))
    a, b = F.get("ends", F.lit(0)), F.get("ends", F.lit(1))
    plus = a["strand"] == "+"
    start = F.when(plus, a["pos"]).otherwise(b["pos"])
    right = F.when(plus, b["pos"] + F.length(b["x"])).otherwise(a["pos"] + F.length(a["x"]))
    width = right - start
    fits = (F.size("ends") == 2) & (a["chrom"] == b["chrom"]) & (a["strand"] != b["strand"]) & (width > 0) & (width <= max_fragment)
    both = both.select("name", "ends", start.alias("start"), width.alias("width"), F.coalesce(fits, F.lit(False)).alias("fits"))

    def framed(e: Column) -> Column:
        ahead = F.repeat(F.lit("N"), F.greatest(F.lit(0), e["pos"] - F.col("start")).cast("int"))
        return F.split(F.rpad(F.concat(ahead, F.substr(e["x"], (F.greatest(F.lit(0), F.col("start") - e["pos"]) + 1).cast("int"), F.lit(1 << 30))), F.col("width").cast("int"), "N"), "")

    merged = F.array_join(F.zip_with(framed(a), framed(b), lambda x, y: F.when(x == "N", y).otherwise(x)), "")
    read = lambda e, pos, x, n: F.struct(e["chrom"].alias("chrom"), pos.alias("pos"), e["strand"].alias("strand"), F.concat(F.length(x).cast("string"), F.lit("M")).alias("cigar"), x.alias("seq"), F.lit(n).alias("ends"))
    alone = F.transform("ends", lambda e: read(e, e["pos"], e["x"], 1))
    out = both.select("name", F.explode(F.when(F.col("fits"), F.array(read(a, F.col("start"), merged, 2))).otherwise(alone)).alias("r"))
    return out.select("name", "r.chrom", "r.pos", "r.strand", "r.cigar", "r.seq", "r.ends")


def suffix_length(names: DataFrame, longest: int = 5) -> DataFrame:
    """Of name suffixes up to a length: the largest number of reads that share what is left, of all names. Two means it parts mates."""
    rows = names.select("name", F.explode(F.sequence(F.lit(0), F.lit(longest))).alias("suffix")).where(F.length("name") > F.col("suffix"))
    cut = rows.select("suffix", F.substr("name", F.lit(1), (F.length("name") - F.col("suffix")).cast("int")).alias("stem")).groupBy("suffix", "stem").count()
    return cut.groupBy("suffix").agg(F.max("count").alias("most"))


def nano_counts(calls: DataFrame) -> DataFrame:
    """Base modifications (chrom, pos, strand, kind h or m, prob 0..255) summed per site: hydroxymethylation, methylation and number of reads."""
    share = lambda k: F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("prob"))), F.lit(0)) / (255.0 * F.count_distinct("read")), 6)
    return calls.groupBy("chrom", "pos", "strand").agg(F.count_distinct("read").alias("n_reads"), share("h").alias("hydroxy"), share("m").alias("methyl"))


def parse_modifications(reads: DataFrame) -> DataFrame:
    """Base-modification tags (read, chrom, pos, strand, seq as sequenced, mm, ml, and cigar if there are gaps) as calls.

    ``mm`` has parts like ``C+h,0,2;``: numbers of unmodified C to skip; ``ml`` has a probability for each number of every part. Calls on bases that are not aligned are dropped.
    """
    size = F.length("seq")
    cigar = F.col("cigar") if "cigar" in reads.columns else F.concat(size.cast("string"), F.lit("M"))
    places = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.when(c == "C", i)), lambda i: i.isNotNull())
    rows = reads.select("read", "chrom", "strand", size.alias("size"), places.alias("places"), aligned_blocks(cigar, F.col("pos")).alias("blocks"), "ml", F.filter(F.split("mm", ";"), lambda p: p != "").alias("parts"))
    numbers = lambda p: F.transform(F.filter(F.split(p, ","), lambda x, i: i > 0), lambda x: x.cast("int"))
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<struct<p:string,k:int>>").alias("out"))
    # of each part: how many numbers the parts before it have
    counted = F.aggregate("parts", start, lambda acc, p: F.struct((acc["k"] + F.size(F.split(p, ",")) - 1).alias("k"), F.concat(acc["out"], F.array(F.struct(p.alias("p"), acc["k"].alias("k")))).alias("out")), lambda acc: acc["out"])
    part = rows.select("read", "chrom", "strand", "size", "places", "blocks", "ml", F.explode(counted).alias("part")).where(F.col("part.p").rlike(r"^C\+[hm][?.]?(,|$)"))
    ordinals = F.aggregate(numbers(F.col("part.p")), F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + n + 1)))
    call = part.select("read", "chrom", "strand", "size", "places", "blocks", "ml", F.substr("part.p", F.lit(3), F.lit(1)).alias("kind"), F.col("part.k").alias("k"), F.posexplode(ordinals).alias("j", "at"))
    call = call.select("read", "chrom", "strand", "size", "blocks", "kind", F.get("places", F.col("at")).alias("i"), F.get("ml", F.col("k") + F.col("j")).cast("int").alias("prob")).where("i is not null and prob is not null")
    stored = F.when(F.col("strand") == "+", F.col("i")).otherwise(F.col("size") - 1 - F.col("i"))
    under = F.get(F.filter("blocks", lambda b: (b["q"] <= stored) & (stored < b["q"] + b["n"])), F.lit(0))
    return call.select("read", "chrom", (under["r"] + stored - under["q"]).alias("pos"), "strand", "kind", "prob").where("pos is not null")
