"""Logical inputs (points, cells, pairs, landmarks) read from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(sample_id, marker, pt_id, x, y): a day of events is a sample, an event type a marker.

    The y coordinate is the microsecond of the day on a scale of 1000; it is
    taken from the clock fields, so it doesn't depend on the session time zone.
    """
    micros = F.hour("ts").cast("long") * 3_600_000_000 + F.minute("ts").cast("long") * 60_000_000 + (F.expr("extract(second from ts)") * 1_000_000).cast("long")
    return read(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("sample_id"),
        F.col("event_type").alias("marker"),
        F.col("event_id").alias("pt_id"),
        F.col("value").alias("x"),
        (micros / F.lit(1e6) / F.lit(86.4)).alias("y"),
    )


#: The same points in DuckDB.
POINTS_SQL = """points as (select strftime(ts, '%Y-%m-%d') sample_id, event_type marker, event_id pt_id, value x,
  ((epoch_us(ts) - epoch_us(date_trunc('day', ts)))::double / 1e6::double) / 86.4::double y from events)"""


def marker(pts: DataFrame, name: str) -> DataFrame:
    return pts.where(F.col("marker") == name).drop("marker")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(image, cell_id, dab, ring, truth): line items stand in for detections, with nulls and NaN as real exports have."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("image"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"),
        F.when(F.col("l_quantity") % 17 == 0, F.lit(None)).when(F.col("l_quantity") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount") * 4).alias("dab"),
        F.when(F.col("l_quantity") % 13 == 0, F.lit(None)).otherwise(F.col("l_tax") * 5).alias("ring"),
        (F.col("l_extendedprice") > 40000).cast("int").alias("truth"),
    )


CELLS_SQL = """cells as (select l_returnflag || '-' || l_linestatus image, l_orderkey * 10 + l_linenumber cell_id,
  case when l_quantity % 17 = 0 then null when l_quantity % 19 = 0 then 'nan'::double else l_discount * 4::double end dab,
  case when l_quantity % 13 = 0 then null else l_tax * 5::double end ring, (l_extendedprice > 40000)::int truth from lineitem)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled(sample_id, doc_id, a, b, score): two marker calls and a score for each labelled document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id").select(F.col("lang").alias("sample_id"), "doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"), F.col("n_chars").cast("double").alias("score"))


LABELLED_SQL = """labelled as (select lang sample_id, doc_id, quality = 1 a, toxic = 1 b, n_chars::double score from documents join labels using (doc_id))"""


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """landmarks(pair_id, lm_id, rx, ry, mx, my): the k-th click and the k-th view of a day, moved close to each other."""
    from pyspark.sql import Window

    pts = points(spark, sf_dir).where(F.col("marker").isin("click", "view"))
    ranked = pts.withColumn("k", F.row_number().over(Window.partitionBy("sample_id", "marker").orderBy("pt_id")))
    a = ranked.where("marker = 'click'").select(F.col("sample_id").alias("pair_id"), F.col("k").alias("lm_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    b = ranked.where("marker = 'view'").select(F.col("sample_id").alias("pair_id"), F.col("k").alias("lm_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, ["pair_id", "lm_id"]).select("pair_id", "lm_id", "rx", "ry", (0.98 * F.col("rx") - 0.05 * F.col("ry") + 7 + 0.004 * F.col("bx")).alias("mx"), (0.05 * F.col("rx") + 0.98 * F.col("ry") - 3 + 0.004 * F.col("by")).alias("my"))


LANDMARKS_SQL = (
    POINTS_SQL
    + """, ranked as (select *, row_number() over (partition by sample_id, marker order by pt_id) k from points where marker in ('click', 'view')),
landmarks as (select a.sample_id pair_id, a.k::int lm_id, a.x rx, a.y ry, 0.98::double * a.x - 0.05::double * a.y + 7 + 0.004::double * b.x mx,
  0.05::double * a.x + 0.98::double * a.y - 3 + 0.004::double * b.y my from ranked a join ranked b on a.sample_id = b.sample_id and a.k = b.k
  where a.marker = 'click' and b.marker = 'view')"""
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(folder, name): image names made from suppliers, in two folders, with markers and separators of all kinds."""
    sup = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    sep = F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit(" ")), (k % 3 + 1).cast("int"))
    case = F.concat(F.lit("LL"), (k % 20).cast("string"), sep, F.lit("Liver"))
    a = sup.select(F.lit("a").alias("folder"), F.concat(case, sep, F.when(k % 7 == 0, "H&E").otherwise("CD8"), sep, F.lit("x10.png")).alias("name"))
    b = sup.where("s_suppkey % 5 <> 0").select(F.lit("b").alias("folder"), F.concat(F.lower(case), sep, F.when(k % 2 == 0, "PanCK").otherwise("Tim-3"), sep, F.lit("10X.tif")).alias("name"))
    return a.unionByName(b).distinct()


FILES_SQL = """files as (select distinct * from (
  select 'a' folder, 'LL' || (s_suppkey % 20) || sep || 'Liver' || sep || case when s_suppkey % 7 = 0 then 'H&E' else 'CD8' end || sep || 'x10.png' as name
  from (select *, ['_', '-', ' '][s_suppkey % 3 + 1] sep from supplier)
  union all select 'b', lower('LL' || (s_suppkey % 20) || sep || 'Liver') || sep || case when s_suppkey % 2 = 0 then 'PanCK' else 'Tim-3' end || sep || '10X.tif'
  from (select *, ['_', '-', ' '][s_suppkey % 3 + 1] sep from supplier) where s_suppkey % 5 <> 0))"""
