"""Call sets made from the star-schema tables: parts are variants, suppliers samples, line items calls.

All arithmetic is on integers or floors, so another SQL engine finds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelarium.model import CallSet

# Fixed expressions, shared by Spark SQL and DuckDB.
VARIANTS_SQL = """
SELECT vid,
  CASE WHEN L % 23 = 22 THEN 'chrX' ELSE concat('chr', CAST(1 + L % 23 AS VARCHAR(10))) END AS contig,
  CAST(3000000 + L * 1000 AS INT) AS position,
  CASE WHEN vid % 8 = 7 THEN concat(B, 'T') ELSE B END AS ref,
  CASE WHEN vid % 8 = 7 THEN B WHEN vid % 8 = 3 THEN concat(B, 'T') ELSE substr('ACGT', CAST(1 + (L + 1 + vid % 4) % 4 AS INT), 1) END AS alt,
  qual_approx, info, filters
FROM (SELECT vid, L, substr('ACGT', CAST(1 + L % 4 AS INT), 1) AS B, qual_approx, info, filters
  FROM (SELECT p_partkey AS vid, CAST(floor(p_partkey / 4.0) AS INT) AS L, CAST(2 * p_size AS INT) AS qual_approx,
    CAST(p_size AS DOUBLE) / 50 AS info, CASE WHEN p_size % 9 = 0 THEN 'LowQual' ELSE '' END AS filters FROM part) p0) p1
"""
SAMPLES_SQL = """
SELECT s_suppkey AS sid, concat('s', CAST(s_suppkey AS VARCHAR(10))) AS s,
  CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE s_nationkey % 2 = 0 END AS reported_is_female,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 12 AS DOUBLE) / 100 END AS chimera_rate,
  concat('pop', CAST(s_nationkey % 5 AS VARCHAR(10))) AS ancestry_pop
FROM supplier
"""
CELLS_SQL = """
SELECT l_partkey AS vid, l_suppkey AS sid, CAST(floor(max(l_quantity)) AS INT) AS q,
  CAST(floor(max(l_extendedprice)) AS INT) AS e, min(l_returnflag) AS rf
FROM lineitem GROUP BY l_partkey, l_suppkey
"""
EXOME_SQL = f"""
SELECT vid, sid, n_alt, gq, dp, dp - ad1 AS ad0, ad1 FROM (
  SELECT vid, sid, n_alt, gq, dp, CAST(CASE WHEN n_alt IS NULL THEN 0 WHEN n_alt = 0 THEN e % 3
    WHEN n_alt = 1 THEN floor(dp * (15 + e % 70) / 100.0) ELSE dp - e % 4 END AS INT) AS ad1 FROM (
    SELECT vid, sid, e, CASE WHEN rf = 'N' AND q % 7 = 0 THEN NULL WHEN q % 10 < 5 THEN 0 WHEN q % 10 < 8 THEN 1 ELSE 2 END AS n_alt,
      CAST(2 * q - 1 AS INT) AS gq, CAST(5 + e % 60 AS INT) AS dp
    FROM ({CELLS_SQL}) c WHERE vid % 5 <> 0 AND sid % 10 <> 1 AND e % 19 <> 0) x) y
"""
IMPUTATION_SQL = f"""
SELECT vid, sid, CASE WHEN rf = 'A' AND q % 11 = 0 THEN NULL WHEN (q + h) % 10 < 5 THEN 0 WHEN (q + h) % 10 < 8 THEN 1 ELSE 2 END AS n_alt,
  CAST(40 + e % 60 AS DOUBLE) / 100 AS max_gp
FROM (SELECT *, CASE WHEN e % 13 = 0 THEN 5 WHEN e % 13 = 1 THEN 3 ELSE 0 END AS h FROM ({CELLS_SQL}) c) d
WHERE vid % 7 <> 0 AND sid % 10 <> 2 AND e % 17 <> 0
"""


def _views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("part", "supplier", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, contig, position, alleles, filters (array), qual_approx, info."""
    _views(spark, sf_dir)
    rows = spark.sql(VARIANTS_SQL)
    filters = F.when(F.col("filters") == "", F.array().cast("array<string>")).otherwise(F.array("filters"))
    return rows.select("vid", "contig", "position", F.array("ref", "alt").alias("alleles"), filters.alias("filters"), "qual_approx", "info")


def _call_set(spark: SparkSession, sf_dir: str, sql: str, skip_variant: str, skip_sample: str) -> CallSet:
    rows = variants(spark, sf_dir).where(skip_variant)
    samples = spark.sql(SAMPLES_SQL).where(skip_sample)
    cells = spark.sql(sql)
    keys = rows.select("vid", "contig", "position", "alleles")
    entries = cells.join(keys, "vid").join(samples.select("sid", "s"), "sid").drop("vid", "sid")
    return CallSet(rows, samples, entries)


def exome(spark: SparkSession, sf_dir: str) -> CallSet:
    """Calls with ad, dp and gq."""
    cs = _call_set(spark, sf_dir, EXOME_SQL, "vid % 5 <> 0", "sid % 10 <> 1")
    return cs.with_(entries=cs.entries.withColumn("ad", F.array("ad0", "ad1")).drop("ad0", "ad1"))


def imputation(spark: SparkSession, sf_dir: str) -> CallSet:
    """Calls with max_gp."""
    return _call_set(spark, sf_dir, IMPUTATION_SQL, "vid % 7 <> 0", "sid % 10 <> 2")
