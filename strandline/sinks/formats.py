"""Mapping records as text: PAF, SAM, junctions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import reverse_complement

MAX_OPS = 65535


#: Bases of a reference that are held together.
BLOCK = 1 << 18


def _tag(name: str, kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}:{kind}:"), value.cast("string")))


def paf(m: DataFrame, tags: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Twelve columns and tags by tabs: (value).

    Needs qname, qlen, qs, qe, rev, tname, tlen, rs, re, mlen, blen, mapq; ``tags`` names further
    columns as {tag: (type, column)}, nulls left out.
    """
    tp = _kind(m)
    cols = ["qname", "qlen", "qs", "qe", None, "tname", "tlen", "rs", "re", "mlen", "blen", "mapq"]
    strand = F.when(F.col("rev") == 1, "-").otherwise("+")
    more = [_tag(t, kind, F.col(c)) for t, (kind, c) in (tags or {}).items()]
    return m.select(F.concat_ws("\t", *[strand if c is None else F.col(c).cast("string") for c in cols], tp, *more).alias("value"))


def _kind(m: DataFrame) -> Column:
    if "primary" not in m.columns:
        return F.lit(None).cast("string")
    turned = F.coalesce(F.col("inv"), F.lit(False)) if "inv" in m.columns else F.lit(False)
    return F.when(F.col("primary"), F.when(turned, "tp:A:I").otherwise("tp:A:P")).otherwise(F.when(turned, "tp:A:i").otherwise("tp:A:S"))


#: The tags of PAF lines of alignments, their types and columns.
TAGS = {"NM": ("i", "nm"), "ms": ("i", "dp_max"), "AS": ("i", "dp_score"), "nn": ("i", "n_ambi"), "ts": ("A", "trans"), "cm": ("i", "cnt"), "s1": ("i", "score"), "s2": ("i", "s2"), "de": ("f", "div"), "zd": ("i", "zd"), "rl": ("i", "rep_len"),
        "cg": ("Z", "cigar"), "cs": ("Z", "cs"), "ds": ("Z", "ds"), "MD": ("Z", "md")}


def full_paf(m: DataFrame, leave_out: tuple[str, ...] = ("ds", "MD")) -> DataFrame:
    """PAF lines of ``map_reads`` with all tags that are asked for; reads without a mapping come with stars (see ``with_unmapped``)."""
    m = m.withColumn("s2", F.when(F.col("primary"), F.col("subsc"))).withColumn("zd", F.when(F.col("split"), 1))
    m = m.withColumn("div", F.when(F.col("div") == 0, "0").otherwise(F.format_string("%.4f", "div")))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("qs", "qe", "tlen", "rs", "re", "mlen", "blen", "mapq")}
    mapped = paf(m.filter("tname is not null"), {t: c for t, c in TAGS.items() if t not in leave_out})
    bare = m.filter("tname is null").withColumns(zero)
    line = F.concat_ws("\t", "qname", F.col("qlen").cast("string"), F.lit("0\t0\t*\t*\t0\t0\t0\t0\t0\t0"), F.concat(F.lit("rl:i:"), F.coalesce("rep_len", F.lit(0)).cast("string")))
    return mapped.unionByName(bare.select(line.alias("value")))


def with_unmapped(m: DataFrame, reads: DataFrame) -> DataFrame:
    """Mappings, and the reads (qid, qname, qlen) that have none, with nulls."""
    none = reads.join(m.select("qid").distinct(), "qid", "left_anti")
    return m.unionByName(none.withColumn("primary", F.lit(False)).withColumn("sam_pri", F.lit(False)), allowMissingColumns=True)


def sam_header(spark: SparkSession, refs: DataFrame, read_group: str | None = None, program: str = "strandline", version: str = "1") -> DataFrame:
    """@HD, @SQ in the references' order, @RG, @PG: (ord, value)."""
    rows = [(0, "@HD\tVN:1.6\tSO:unsorted\tGO:query")]
    if read_group is not None:
        rg = read_group.replace("\\t", "\t")
        if not re.match(r"@RG\t", rg) or "\n" in rg or not re.search(r"\tID:[^\t]+", rg):
            raise ValueError("a read group begins with @RG, holds an ID and no line break")
        rows.append((1 << 60, rg))
    rows.append(((1 << 60) + 1, f"@PG\tID:{program}\tPN:{program}\tVN:{version}"))
    sq = refs.select((F.col("rid") + 1).cast("long").alias("ord"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), F.col("len").cast("string"))).alias("value"))
    return spark.createDataFrame(rows, "ord long, value string").union(sq)


def sam_flags(m: DataFrame) -> Column:
    """Needs paired, proper, unmapped, mate_unmapped, rev, mate_rev, seg, primary, sam_pri (booleans; rev 0 or 1)."""
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return (bit(F.col("paired"), 0x1) + bit(F.col("paired") & F.col("proper"), 0x2) + bit(F.col("unmapped"), 0x4) + bit(F.col("paired") & F.col("mate_unmapped"), 0x8) + bit(F.col("rev") == 1, 0x10)
            + bit(F.col("paired") & (F.col("mate_rev") == 1), 0x20) + bit(F.col("paired") & (F.col("seg") == 0), 0x40) + bit(F.col("paired") & (F.col("seg") == 1), 0x80)
            + bit(~F.col("unmapped") & ~F.col("primary"), 0x100) + bit(~F.col("unmapped") & F.col("primary") & ~F.col("sam_pri"), 0x800))


def sam(m: DataFrame, soft_clip: bool = False) -> DataFrame:
    """One line a record: (qname, value).

    Needs qname, seg, qlen, seq, qual, tname, rs, re, qs, qe, rev, mapq, cigar (text, without clips),
    primary, sam_pri, nm; mates by (qname, other seg) if ``paired``. Supplementary records list each
    other in SA; an alignment of too many operations keeps them in CG. Scores, kind, anchors, divergence and
    repetitive length follow as tags where their columns are there.
    """
    paired = F.coalesce(F.col("paired"), F.lit(False)) if "paired" in m.columns else F.lit(False)
    unmapped = F.col("tname").isNull()
    m = m.withColumn("paired", paired).withColumn("unmapped", unmapped)
    own = m.filter(F.coalesce(F.col("sam_pri"), F.lit(False)) | F.col("unmapped")).select("qname", (1 - F.col("seg")).alias("seg"), F.col("tname").alias("mt"), F.col("rs").alias("ms"), F.col("re").alias("me"), F.col("rev").alias("mate_rev"), F.col("unmapped").alias("mate_unmapped"))
    m = m.join(own, ["qname", "seg"], "left")
    left, right = F.when(F.col("rev") == 1, F.col("qlen") - F.col("qe")).otherwise(F.col("qs")), F.when(F.col("rev") == 1, F.col("qs")).otherwise(F.col("qlen") - F.col("qe"))
    soft = F.col("sam_pri") | F.lit(soft_clip)
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.when(soft, "S").otherwise("H"))).otherwise("")
    full = F.concat(clip(left), F.col("cigar"), clip(right))
    ops = F.regexp_count("cigar", F.lit("[MIDNX=]"))
    many = ops > MAX_OPS
    short = F.concat((F.col("qe") - F.col("qs")).cast("string"), F.lit("S"), (F.col("re") - F.col("rs")).cast("string"), F.lit("N"))
    piece = F.when(soft, F.col("seq")).otherwise(F.substring("seq", (F.col("qs") + 1).cast("int"), (F.col("qe") - F.col("qs")).cast("int")))
    qpiece = F.when(soft, F.col("qual")).otherwise(F.substring("qual", (F.col("qs") + 1).cast("int"), (F.col("qe") - F.col("qs")).cast("int")))
    turned = F.col("rev") == 1
    same = F.col("mt") == F.col("tname")
    span = F.greatest("re", "me") - F.least("rs", "ms")
    tlen = F.when(~same | F.col("mt").isNull(), 0).when(F.col("rs") <= F.col("ms"), span).otherwise(-span)
    sa_item = F.concat_ws(",", "tname", (F.col("rs") + 1).cast("string"), F.when(turned, "-").otherwise("+"), full, F.col("mapq").cast("string"), F.col("nm").cast("string"))
    m = m.withColumn("_sa", F.when(~F.col("unmapped") & F.col("primary"), F.concat(sa_item, F.lit(";"))))
    w = Window.partitionBy("qname", "seg")
    m = m.withColumn("_all", F.array_sort(F.collect_list("_sa").over(w)))
    others = F.array_join(F.array_except("_all", F.array("_sa")), "")
    flags = sam_flags(m.withColumn("proper", F.lit(False)))
    if "proper" not in m.columns:
        m = m.withColumn("proper", F.lit(False))
    value = F.concat_ws(
        "\t", "qname", flags.cast("string"), F.coalesce("tname", F.lit("*")), F.coalesce(F.col("rs") + 1, F.lit(0)).cast("string"), F.coalesce("mapq", F.lit(0)).cast("string"),
        F.when(F.col("unmapped"), "*").when(many, short).otherwise(full),
        F.when(F.col("mt").isNull(), "*").when(same, "=").otherwise(F.col("mt")), F.coalesce(F.col("ms") + 1, F.lit(0)).cast("string"), F.coalesce(tlen, F.lit(0)).cast("string"),
        F.coalesce(F.when(turned, reverse_complement(piece)).otherwise(piece), F.col("seq"), F.lit("*")), F.coalesce(F.when(turned, F.reverse(qpiece)).otherwise(qpiece), F.lit("*")),
        F.when(~F.col("unmapped"), _tag("NM", "i", F.col("nm"))), *[F.when(~F.col("unmapped"), x) for x in _sam_tags(m)], F.when(F.col("primary") & (others != ""), F.concat(F.lit("SA:Z:"), others)), F.when(many, F.concat(F.lit("CG:Z:"), full)))
    return m.select("qname", value.alias("value"))


def _sam_tags(m: DataFrame) -> list[Column]:
    has = lambda c, x: x if c in m.columns else F.lit(None).cast("string")
    plain = [has(c, _tag(t, kind, F.col(c))) for t, (kind, c) in TAGS.items() if t in ("ms", "AS", "nn", "ts", "cm", "s1", "rl") and c in m.columns]
    second = has("subsc", F.when(F.col("primary"), _tag("s2", "i", F.col("subsc")))) if "subsc" in m.columns else F.lit(None).cast("string")
    div = F.concat(F.lit("de:f:"), F.when(F.col("div") == 0, "0").otherwise(F.format_string("%.4f", "div"))) if "div" in m.columns else F.lit(None).cast("string")
    split = F.when(F.col("split"), "zd:i:1") if "split" in m.columns else F.lit(None).cast("string")
    return [*plain, _kind(m), second, div, split]


def junctions(m: DataFrame, refs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Introns of alignments as BED6: (value); the score tells how usual their splice signals are.

    References are met in blocks (each with the first base of the next), so no row holds a contig for the two bases at an intron's end.
    """
    op = F.split(F.regexp_replace("cigar", r"([0-9]+)([MIDN=X])", "$1 $2;"), ";")
    ops = F.transform(F.filter(op, lambda x: x != ""), lambda x: F.struct(F.split(x, " ")[0].cast("long").alias("n"), F.split(x, " ")[1].alias("op")))
    step = F.aggregate(
        ops, F.struct(F.col("rs").cast("long").alias("at"), F.array().cast("array<struct<st:long,en:long>>").alias("out")),
        lambda a, o: F.struct((a.at + F.when(o.op.isin("M", "D", "N", "=", "X"), o.n).otherwise(0)).alias("at"),
                              F.when(o.op == "N", F.concat(a.out, F.array(F.struct(a.at.alias("st"), (a.at + o.n).alias("en"))))).otherwise(a.out).alias("out")))
    i = m.withColumn("_i", F.explode(step.out)).select("qname", "tname", "rev", F.col("_i.st").alias("st"), F.col("_i.en").alias("en"))
    last = F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / block).cast("int")
    pieces = refs.select(F.col("name").alias("tname"), "seq", F.explode(F.sequence(F.lit(0), last)).alias("_block"))
    pieces = pieces.select("tname", "_block", F.substring("seq", F.col("_block") * block + 1, F.lit(block + 1)).alias("_piece"))

    def two(i, at, name):
        i = i.withColumn("_block", F.floor(at / block).cast("int")).join(pieces, ["tname", "_block"])
        return i.withColumn(name, F.upper(F.substring("_piece", (at - F.col("_block") * block + 1).cast("int"), F.lit(2)))).drop("_block", "_piece")

    i = two(two(i, F.col("st"), "_a"), F.col("en") - 2, "_b")
    a, b = F.col("_a"), F.col("_b")
    first, last = F.when(F.col("rev") == 1, reverse_complement(b)).otherwise(a), F.when(F.col("rev") == 1, reverse_complement(a)).otherwise(b)
    score = F.when(first == "GT", 3).when(first == "GC", 2).when(first == "AT", 1).otherwise(0) + F.when(last == "AG", 3).when(last == "AC", 1).otherwise(0)
    return i.select(F.concat_ws("\t", "tname", F.col("st").cast("string"), F.col("en").cast("string"), "qname", score.cast("string"), F.when(F.col("rev") == 1, "-").otherwise("+")).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)
