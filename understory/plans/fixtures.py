"""Domain views over the test tables. The SQL is the same for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # label rows of 10 m cells from overlapping tiles
    "labels_raw": """
        SELECT CAST((l_orderkey % 120) * 10000000 + floor(l_orderkey / 120) AS BIGINT) AS cell_id,
               CAST(l_suppkey % 16 AS INT) AS tile, (l_orderkey % 120 + 5e-1) * 10 AS x, (floor(l_orderkey / 120) + 5e-1) * 10 AS y,
               1 - 5 * l_discount AS valid_start, 1 - 5 * l_tax AS valid_end,
               8e-1 * l_quantity AS mean_start, 8e-1 * (l_quantity + l_partkey % 9 - 3) AS mean_end,
               l_quantity AS p95_start, l_quantity + l_partkey % 9 - 3 AS p95_end,
               8e-1 * (l_partkey % 9 - 3) AS mean_change, 1e0 * (l_partkey % 9 - 3) AS p95_change, 115e-2 * (l_partkey % 9 - 3) AS max_change,
               l_tax AS loss_share, 1 - l_discount AS canopy_share, l_partkey AS part_id,
               l_orderkey AS k1, l_linenumber AS k2, l_extendedprice AS k3
        FROM lineitem""",
    "vegetation": """
        SELECT p_partkey AS part_id, p_brand AS vegetation_type, p_name AS map_name, p_size * 2e0 AS line_m,
               CASE WHEN p_type LIKE 'ECONOMY%' OR p_type LIKE 'STANDARD%' THEN 'hardwood forest' WHEN p_type LIKE 'SMALL%' OR p_type LIKE 'MEDIUM%' THEN 'conifer forest'
                    WHEN p_type LIKE 'PROMO%' THEN 'grass' ELSE 'shrub' END AS broader_group
        FROM part""",
    "daily_climate": """
        SELECT user_id AS segment_id, CAST(ts AS DATE) AS date, value AS prcp_mm, 15 + event_id % 20 * 1e0 AS tmax_c, 5 + event_id % 13 * 1e0 AS tmin_c, event_id, event_type
        FROM events""",
    "shots": """
        SELECT c_custkey AS id, -123 + c_custkey % 997 / 997e0 AS lon, 38 + c_custkey % 613 / 613e0 AS lat,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 3 > 0 AS INT) END AS quality_flag, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 11 = 0 AS INT) END AS degrade_flag,
               90e-2 + c_custkey % 10 / 100e0 AS sensitivity, c_custkey % 9 - 5e0 AS solar_elevation
        FROM customer""",
    "segments": "SELECT s_suppkey AS id, -123 + s_suppkey % 97 / 97e0 AS lon, 38 + s_suppkey % 61 / 61e0 AS lat FROM supplier",
    # rasters of several tiles: one height per (tile, row, col) and epoch
    "raster": """
        SELECT CAST(l_suppkey % 4 AS INT) AS tile, CAST(floor(l_orderkey / 64) AS BIGINT) AS "row", CAST(l_orderkey % 64 AS BIGINT) AS col,
               max(l_quantity) AS start, CASE WHEN min(l_partkey) % 10 = 0 THEN NULL ELSE max(l_quantity) + min(l_partkey) % 9 - 4 END AS "end"
        FROM lineitem GROUP BY 1, 2, 3""",
    "points": """
        SELECT CAST(l_suppkey % 4 AS INT) AS tile, CAST(floor(l_orderkey / 40) AS BIGINT) AS "row", CAST(l_orderkey % 40 AS BIGINT) AS col,
               l_quantity + l_extendedprice / 1e6 AS z, CAST(CASE WHEN l_partkey % 3 = 0 THEN 2 WHEN l_partkey % 17 = 0 THEN 7 ELSE l_partkey % 6 END AS INT) AS classification,
               l_linenumber AS ret, CAST(l_suppkey % 40 - 20 AS INT) AS angle, l_orderkey, l_linenumber, l_partkey
        FROM lineitem""",
    "year_stack": "SELECT o_custkey AS pixel, CAST(extract(YEAR FROM o_orderdate) AS INT) AS year, avg(o_totalprice) / 1e4 AS value FROM orders GROUP BY 1, 2",
    "scores": """
        SELECT l.doc_id AS id, sqrt(d.n_chars) + d.doc_id % 7 AS score, CASE WHEN l.toxic = 1 OR l.doc_id % 6 = 0 THEN 1e0 ELSE 0e0 END AS label, 1e0 + l.doc_id % 4 AS weight, l.quality, d.lang
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "boxes": """
        SELECT o_orderkey AS id, CAST(o_custkey % 5 AS INT) AS epoch, CAST(o_custkey % 23 AS INT) AS resource, o_orderkey % 90 * 1e0 AS x0, o_custkey % 90 * 1e0 AS y0,
               o_orderkey % 90 + 2e0 + o_custkey % 13 AS x1, o_custkey % 90 + 3e0 + o_orderkey % 11 AS y1
        FROM orders""",
    "surveys": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice / 1e4 END AS density, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'g18' END AS geoid,
               CAST(o_orderdate AS DATE) AS survey_end, CAST(extract(MONTH FROM o_orderdate) AS INT) AS month
        FROM orders""",
    "lines": "SELECT s_suppkey AS line, s_suppkey % 37 * 3e1 AS x1, s_suppkey % 53 * 2e1 AS y1, s_suppkey % 37 * 3e1 + s_suppkey % 7 * 4e0 AS x2, s_suppkey % 53 * 2e1 + s_suppkey % 11 * 5e0 AS y2 FROM supplier",
    "cells": "SELECT c_custkey AS id, c_custkey % 113 * 1e1 + 3e0 AS x, c_custkey % 101 * 1e1 + 7e0 AS y, c_acctbal AS value, c_mktsegment AS kind FROM customer",
}

NEEDS = {"scores": ("labels", "documents"), "labels_raw": ("lineitem",), "vegetation": ("part",), "daily_climate": ("events",), "shots": ("customer",), "segments": ("supplier",), "raster": ("lineitem",), "points": ("lineitem",), "year_stack": ("orders",), "boxes": ("orders",), "surveys": ("orders",), "lines": ("supplier",), "cells": ("customer",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view over Parquet; only the columns it names are read."""
    sql, tables = VIEWS[name].replace('"row"', "`row`").replace('"end"', "`end`"), {}
    for t in NEEDS[name]:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **tables)


def oracle(query: str, *names: str) -> str:
    """SQL with the views it reads before it."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + query
