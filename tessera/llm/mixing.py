"""Mixing sources to target weights by systematic sampling.

Within each source the documents stand in a fixed order (size, then id); each
has the same expected number of copies, the source's target over its size.
The running sum of expected copies plus one offset per source crosses an
integer boundary so many times inside a document's share, and that is its
number of copies.  In size order neighbours are alike, so the words taken come
near the target.

Only DataFrame functions.  The running sum inside a source that may hold a
third of all rows comes from a range partitioning on (source, size, id):
positions inside a partition plus the number of rows in earlier ones.  The
partitioned rows (three narrow columns) are written once, so both passes see
the same partitions; the result does not depend on where the bounds fall.

Defined results: a null text has size 0; the null source is a source, last in
order; sources without words have target 0 and take nothing; repeated rows are
mixed as separate documents; an empty table gives no rows.  Input columns named
like outputs do not clash, since only id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3                       # no source above 3 times its size


def size_of(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> source, source_size, target, rate, offset.

    Sources share the sum of all sizes by weight, but none gets more than
    ``MOST`` times its own.  With sources ordered by limit / weight those at
    their limit come first, so the level is found by running sums over one row
    per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(x) for x in WEIGHTS])
    t = sizes.select("source", "source_size", F.row_number().over(order).alias("i"))
    t = t.withColumn("weight", F.element_at(w, (F.col("i") - 1) % len(WEIGHTS) + 1))
    t = t.withColumn("most", MOST * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("weight"), "i")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = t.select(
        "*", F.sum("source_size").over(everything).alias("total"),
        (F.sum("source_size").over(everything)
         - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything)
         - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"))
    # the first source in order that stays under its limit sets the level
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    level = F.when(exact("left") * exact("weight") <= exact("most") * exact("weights"),
                   F.col("left").cast("double") / F.col("weights"))
    t = t.withColumn("level", F.first(level, ignorenulls=True).over(
        up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = t.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
    t = t.withColumn("target", F.when(F.col("source_size") > 0, F.col("target")).otherwise(F.lit(0.0)))
    offset = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, 12), 16, 10)
    return t.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        (offset.cast("double") / float(1 << 48)).alias("offset"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(doc_id, tag, source, size, source_size, target, copies, taken), one row
    per row of ``docs``; the tag is a hash of the text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"),
                       F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    # range on the whole key: a source of any share spreads over many partitions
    dealt = rows.repartitionByRange(
        max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))),
        F.col("source").asc_nulls_last(), "size", "doc_id", "tag")
    dealt = C.settle(dealt.withColumn("part", F.spark_partition_id()), "mix")
    counts = dealt.groupBy("part", "source").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    counts = C.settle(counts, "mix-counts")           # one row per partition and source in it
    per = targets(counts.groupBy("source").agg(F.sum("s").alias("source_size")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = (starts.alias("a").join(per.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
              .select("a.*", "source_size", "target", "rate", "offset"))
    inside = Window.partitionBy("part", "source").orderBy("size", "doc_id", "tag")
    placed = (dealt.withColumn("pos", F.row_number().over(inside)).alias("d")
              .join(starts.alias("s"), (F.col("d.part") == F.col("s.part"))
                    & F.col("d.source").eqNullSafe(F.col("s.source"))))
    upto = F.col("start") + F.col("pos")
    cum = lambda i: F.floor(F.col("rate") * i + F.col("offset"))
    copies = F.least(cum(upto) - cum(upto - 1), F.lit(MOST)).cast("long")
    return placed.select(
        "doc_id", "tag", F.col("d.source").alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its
    own columns.  Rows that share id, text and source count as one document.

    Texts move once: rows meet their numbers of copies by one 128-bit key, and
    the first of equal rows is found in the order and place of that join."""
    key = lambda i, tag, s: [F.xxhash64(i, tag, s, F.isnull(i), F.isnull(s)), F.xxhash64(s, i, tag, F.lit(1))]
    k1, k2, n, place = C.free_names(docs, "k1", "k2", "n", "place")
    a, b = key("doc_id", "tag", "source")
    taken = mix(docs, id_col, text_col, source_col).groupBy(a.alias(k1), b.alias(k2)).agg(
        F.sum("copies").cast("int").alias(n)).where(F.col(n) > 0)
    a, b = key(id_col, F.xxhash64(text_col), source_col)
    rows = docs.withColumn(k1, a).withColumn(k2, b).join(taken, [k1, k2])
    first = Window.partitionBy(k1, k2).orderBy(F.lit(0))
    rows = rows.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return rows.withColumn(place, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
        3 * source_size AS most FROM s),
l AS (SELECT *, sum(source_size) OVER ()
          - coalesce(sum(most) OVER (ORDER BY most / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER ()
          - coalesce(sum(weight) OVER (ORDER BY most / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
      FROM w),
v AS (SELECT rest::DOUBLE / weights::DOUBLE AS level FROM l
      WHERE rest * weight <= most * weights ORDER BY most / weight, i LIMIT 1),
t AS (SELECT source, source_size,
        CASE WHEN source_size > 0 THEN least(most::DOUBLE, level * weight) ELSE 0.0 END AS target,
        ('0x' || substr(md5(coalesce(source, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
      FROM l, v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS p
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM (
  SELECT *, least(floor(rate * p + u) - floor(rate * (p - 1) + u), 3)::BIGINT AS copies FROM r)
"""
