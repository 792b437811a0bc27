"""Mixing sources to target weights by capped water-filling.

A source's share of the mix is proportional to its weight, but no source is repeated more than
``epochs`` times: sources above their cap are clamped to it and their excess goes to the others by
weight, until none is above. Clamping raises the level of the rest only, so sources are clamped in
the order of cap / weight, and the level is found from running sums in that order.

A document is then taken ``floor(target / size)`` whole times, and once more in the order of a
seeded hash until the source's fractional repetition is used up; the document at that edge is
taken in part. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, maybe_broadcast, text_or_empty

#: Hash classes of a source; the edge of its fractional repetition falls into one of them.
CLASSES = 3  # hexadecimal digits


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """(source, source_size) -> source, source_size, weight, target.

    One row per source, null included; weights repeat in the order of code points, null last.
    The table has a row per source, so its windows are as small as the list of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("weight", w.cast("long"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumns({
        "_left": F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * epochs).over(before), F.lit(0)),
        "_w": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # clamped if the level with only the earlier ones clamped is above the own cap
    t = t.withColumn("_clamped", F.col("weight") * F.col("_left") > F.col("source_size") * epochs * F.col("_w"))
    t = t.withColumn("_open", F.coalesce(F.min(F.when(~F.col("_clamped"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("_left").alias("l"), F.col("_w").alias("w")))).over(every)))
    target = F.when(F.col("_clamped"), (F.col("source_size") * epochs).cast("double")).otherwise(
        (F.col("weight") * F.col("_open.l")).cast("double") / F.col("_open.w").cast("double"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 17) -> DataFrame:
    """Every input row with its id, size, source, source_size, target, whole, taken; columns in ``_row``.

    Nulls: a null text has size 0, null sources are one source, a null id hashes like the word null.
    Sources without words have target 0. Ties in the seeded order fall to the smaller id, then the
    smaller size; repeated rows are separate rows. Empty tables give empty tables. Reruns agree, as
    the order is a hash of the identifier and the seed.

    A hot source is dealt over 4096 hash classes, so no task has to hold or order a source.
    """
    p = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"))
    p = p.withColumn("_hash", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(f":{seed}"))))
    p = p.withColumn("_class", F.substring("_hash", 1, CLASSES))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    p = p.withColumn("_key", key)
    classes = cut(p.groupBy("_key", "source", "_class").agg(F.sum("size").alias("_sum")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, epochs).withColumn("_key", key)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long"))
    targets = targets.withColumn("_extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("_key").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    table = cut(classes.drop("source").withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0)))
                .join(targets.drop("source"), "_key"))
    one = Window.partitionBy("_key", "_class").orderBy("_hash", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    out = p.withColumn("_prior", F.coalesce(F.sum("size").over(one), F.lit(0))).join(maybe_broadcast(table), ["_key", "_class"])
    more = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_extra") - F.col("_before") - F.col("_prior")))
    return out.select("_row", "id", "source", "size", "source_size", "target", "whole", more.alias("extra"),
                      (F.col("whole") * F.col("size") + more).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: documents repeated as often as taken, one text a source cut at its edge.

    Rows that are not taken go; texts without words have nothing to take and go too.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    part = F.array_join(F.slice(F.regexp_extract_all(text_or_empty("_row.`" + text_col + "`"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int")), " ")
    reps = F.col("whole") + (F.col("extra") > 0).cast("long")
    rows = plan.filter((F.col("size") > 0) & (reps > 0)).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), reps)))
    cut_here = (F.col("_n") > F.col("whole")) & (F.col("extra") < F.col("size"))
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"_row.`{f.name}`")
        if f.name == text_col:
            c = F.when(cut_here, part).otherwise(c)
        elif f.name == "n_chars":
            c = F.when(cut_here, F.length(part).cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return rows.select(*cols)


QUERY_COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def query(docs: DataFrame) -> DataFrame:
    return mix_plan(docs.select("doc_id", "text", "source")).withColumnRenamed("id", "doc_id").select(*QUERY_COLUMNS)


#: The contract in SQL; the level is found by trying each number of clamped sources.
ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text,''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR),'null') || ':17') AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
wt AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
lv AS (SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(3*source_size) OVER b, 0) AS BIGINT) AS l,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS ww,
    row_number() OVER (ORDER BY source_size/w, source NULLS LAST) AS k
  FROM wt WINDOW b AS (ORDER BY source_size/w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl AS (SELECT *, w*l > source_size*3*ww AS c FROM lv),
op AS (SELECT l AS ol, ww AS ow FROM cl WHERE NOT c ORDER BY k LIMIT 1),
tg AS (SELECT source, source_size, CASE WHEN c THEN CAST(3*source_size AS DOUBLE) ELSE CAST(w*ol AS DOUBLE)/CAST(ow AS DOUBLE) END AS target
  FROM cl LEFT JOIN op ON true),
pl AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target/source_size) AS BIGINT) ELSE 0 END AS whole FROM tg),
cu AS (SELECT s.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM s)
SELECT cu.doc_id, cu.size, pl.source_size, pl.target,
  CAST(pl.whole*cu.size + least(cu.size, greatest(0, CAST(round(pl.target) AS BIGINT) - pl.whole*pl.source_size - cu.prior)) AS BIGINT) AS taken
FROM cu JOIN pl ON cu.source IS NOT DISTINCT FROM pl.source
"""
