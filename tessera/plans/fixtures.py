"""Slides, levels, properties, contours and outputs derived from the driver's tables (see FIXTURES.md).

Each statement runs unchanged in Spark SQL and in DuckDB, so a query and its
oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {"fx_slides": ["part"], "fx_mpp_csv": ["supplier"], "fx_outputs": ["lineitem"]}
#: Tables that are dealt out by this key before slides are made of them.
KEYS = {"part": "p_partkey"}
NEEDS = {"fx_levels": ["fx_slides"], "fx_props": ["fx_slides"], "fx_contours": ["fx_slides"], "fx_holes": ["fx_slides"]}

SQL = {
    "fx_slides": """
SELECT p_partkey AS slide_id, 'slide_' || lpad(CAST(p_partkey AS STRING), 7, '0') AS stem,
  'slide_' || lpad(CAST(p_partkey AS STRING), 7, '0') || CASE p_partkey % 8 WHEN 0 THEN '.svs' WHEN 1 THEN '.tif' WHEN 2 THEN '.ndpi'
    WHEN 3 THEN '.MRXS' WHEN 4 THEN '.png' WHEN 5 THEN '.jpeg' WHEN 6 THEN '.txt' ELSE '.dcm' END AS filename,
  CAST(2048 + 256 * p_size AS BIGINT) AS w, CAST(1024 + 128 * (p_partkey % 37) AS BIGINT) AS h, CAST(1 + p_partkey % 4 AS BIGINT) AS nlvl,
  CAST(CASE p_partkey % 5 WHEN 1 THEN 20 WHEN 2 THEN 40 WHEN 3 THEN 40 WHEN 4 THEN 60 END AS BIGINT) AS mag,
  CAST(CASE p_partkey % 7 WHEN 1 THEN 0.1215 WHEN 2 THEN 0.25 WHEN 3 THEN 0.2523 WHEN 4 THEN 0.5 WHEN 5 THEN 1.0 WHEN 6 THEN 12.0 END AS DOUBLE) AS mpp_meta
FROM part""",
    "fx_levels": """
SELECT s.slide_id, CAST(l.lvl AS BIGINT) AS lvl, CAST(CASE l.lvl WHEN 0 THEN 1.0 WHEN 1 THEN 2.004 WHEN 2 THEN 4.02 ELSE 16.0 END AS DOUBLE) AS ds
FROM fx_slides s CROSS JOIN (VALUES (0),(1),(2),(3)) AS l(lvl) WHERE l.lvl < s.nlvl""",
    "fx_props": """
SELECT slide_id, 'aperio.MPP' AS k, CASE slide_id % 4 WHEN 0 THEN 'n/a' ELSE CAST(mpp_meta AS STRING) END AS v FROM fx_slides WHERE slide_id % 3 = 0 AND mpp_meta IS NOT NULL
UNION ALL SELECT slide_id, 'openslide.comment', 'Scan|AppMag = 20|MPP = 0.2523|x' FROM fx_slides WHERE slide_id % 3 = 1
UNION ALL SELECT slide_id, 'tiff.ImageDescription', 'microns per pixel: 0.5' FROM fx_slides WHERE slide_id % 11 = 2
UNION ALL SELECT slide_id, 'tiff.XResolution', '40000' FROM fx_slides WHERE slide_id % 5 = 2
UNION ALL SELECT slide_id, 'tiff.ResolutionUnit', CASE WHEN slide_id % 2 = 0 THEN 'Centimeter' ELSE 'inch' END FROM fx_slides WHERE slide_id % 5 = 2
UNION ALL SELECT slide_id, 'openslide.objective-power', CAST(mag AS STRING) FROM fx_slides WHERE mag IS NOT NULL
UNION ALL SELECT slide_id, 'OpenSlide.Vendor', '  aperio ' FROM fx_slides WHERE slide_id % 2 = 0
UNION ALL SELECT slide_id, 'x.vendor.y', 'fallback' FROM fx_slides WHERE slide_id % 3 = 0""",
    "fx_mpp_csv": """
SELECT s_suppkey * 2 + d.dup AS row_no, '/data/slide_' || lpad(CAST(s_suppkey * 2 AS STRING), 7, '0') || '.svs' AS wsi,
  CASE (s_suppkey + d.dup) % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '-1' WHEN 3 THEN ' 0.25 ' WHEN 4 THEN '0.5' ELSE '20' END AS mpp
FROM supplier CROSS JOIN (VALUES (0),(1)) AS d(dup)""",
    "fx_contours": """
SELECT s.slide_id, CAST(c.c AS BIGINT) AS contour_idx, CAST(v.v AS BIGINT) AS v,
  CAST(5 + 70 * c.c + CASE v.v WHEN 1 THEN 16 + floor(s.w / CAST(512 AS DOUBLE)) WHEN 2 THEN 16 + floor(s.w / CAST(512 AS DOUBLE)) WHEN 3 THEN 9 WHEN 4 THEN 9 ELSE 0 END AS BIGINT) AS x,
  CAST(3 + 9 * c.c + CASE v.v WHEN 2 THEN 10 WHEN 3 THEN 10 WHEN 4 THEN 20 + s.slide_id % 29 WHEN 5 THEN 20 + s.slide_id % 29 ELSE 0 END AS BIGINT) AS y
FROM fx_slides s CROSS JOIN (VALUES (0),(1)) AS c(c) CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5)) AS v(v)""",
    "fx_holes": """
SELECT s.slide_id, CAST(j.j AS BIGINT) AS hole_idx, CAST(j.j % 2 AS BIGINT) AS parent_idx, CAST((s.slide_id + 3 * j.j) % 7 + 1 AS BIGINT) AS side,
  CAST(7 + 70 * (j.j % 2) AS BIGINT) AS x0, CAST(5 + 9 * (j.j % 2) + j.j AS BIGINT) AS y0
FROM fx_slides s CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS j(j) WHERE j.j < s.slide_id % 14""",
    "fx_outputs": """
SELECT l_orderkey AS slide_id, l_returnflag AS encoder, count(*) AS n_rows, sum(count(*)) OVER (PARTITION BY l_orderkey) AS expected_total
FROM lineitem GROUP BY l_orderkey, l_returnflag""",
}


def dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to all cores. A slide is a few bytes here and much work later: a file of millions is one task
    otherwise, and a number that is given is not coalesced. What is grouped or joined by slide later stays where it is."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, key)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture ``name`` over the tables below ``sf_dir``."""
    for table in TABLES.get(name, []):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (dealt(spark, rows, KEYS[table]) if table in KEYS else rows).createOrReplaceTempView(table)
    for other in NEEDS.get(name, []):
        fixture(spark, sf_dir, other).createOrReplaceTempView(other)
    return spark.sql(SQL[name])


def with_fixtures(names: str, query: str) -> str:
    """DuckDB SQL: ``query`` after the fixtures it names and those they need."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    ctes = [f"{n} AS ({SQL[n]})" for n in wanted]
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
