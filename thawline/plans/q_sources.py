"""Queries of sources and sinks: a projection of a whole table is written to a new shared folder and read back."""

from pyspark.sql import functions as F

from thawline.plans.registry import query
from thawline.plans.standins import ARRIVALS_SQL, CELLS_SQL, LIDAR_SQL, POINTS_SQL, RING, arrivals, cells, lidar, table, vertices, vertices_sql
from thawline.sources import (
    new_folder, read_cells, read_loggers, read_points, read_results, read_table, read_vertices, write_loggers, write_results, write_table,
)


@query("read_loggers", f"""with {ARRIVALS_SQL} select 'Haap.' || cast(10 + (tomst_id - 9000) % 4 as varchar) || '/' || cast(tomst_id - 9000 as varchar)
  as site, tomst_id, datetime + interval 2 hour as datetime, probl_seed as zone, "T1", "T2", "T3", moist from (select *, row_number() over (
  partition by site, tomst_id, datetime order by event_id desc) as rn from arrivals) where rn = 1""", "T1 T2 T3 moist", stamps="datetime")
def read_loggers_q(spark, d):
    path = new_folder(spark, "loggers")
    place = F.col("tomst_id") - 9000
    folder = F.concat((place % 4 + 10).cast("string"), F.lit("."), place.cast("string"))
    write_loggers(arrivals(spark, d).withColumnRenamed("probl_seed", "zone"), path, folder, "event_id")
    return read_loggers(spark, path, "oulu")


@query("read_results", "select p_brand as response, 'p' || p_partkey as predictor, p_retailprice as varimp from part", "varimp")
def read_results_q(spark, d):
    path = new_folder(spark, "results")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("response"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("predictor"),
                                          F.col("p_retailprice").cast("double").alias("varimp"))
    write_results(rows, path, "varimp", "response", ["response", "predictor", "varimp"])
    write_results(rows, path, "cvmetrics", "response", ["response", "predictor", "varimp"])  # must not be read
    return read_results(spark, path, "varimp", "response string, predictor string, varimp double")


@query("write_table", """select o_orderkey, o_custkey, cast(o_totalprice as double) as o_totalprice, o_orderstatus from orders
  where o_orderstatus = 'F'""", "o_totalprice")
def write_table_q(spark, d):
    """Written by status; a filter on the status reads one folder only."""
    path = new_folder(spark, "table")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    write_table(rows, path, partition_by=("o_orderstatus",))
    return read_table(spark, path, rows.schema).filter("o_orderstatus = 'F'")


@query("read_table", "select c_custkey, c_name, cast(c_acctbal as double) as c_acctbal from customer", "c_acctbal")
def read_table_q(spark, d):
    """The same rows through CSV with a header and a schema."""
    path = new_folder(spark, "csv")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    rows.write.option("header", True).csv(path)
    return read_table(spark, path, rows.schema, "csv", header=True)


@query("read_cells", f"with {CELLS_SQL} select 'elev' as layer, row, col, elev as value from cells union all select 'ndvi', row, col, ndvi from cells", "value")
def read_cells_q(spark, d):
    path = new_folder(spark, "cells")
    write_table(cells(spark, d).select("row", "col", "elev", "ndvi").unpivot(["row", "col"], ["elev", "ndvi"], "layer", "value")
                .select("layer", "row", "col", "value"), path)
    return read_cells(spark, path)


@query("read_vertices", f"with {POINTS_SQL}, {vertices_sql('ring', RING)} select feature_id, part_id, seq, x, y from ring", "x y")
def read_vertices_q(spark, d):
    path = new_folder(spark, "vertices")
    write_table(vertices(spark, d, RING), path)
    return read_vertices(spark, path)


@query("read_points", f"with {LIDAR_SQL} select x, y, z, class from lidar", "x y z")
def read_points_q(spark, d):
    path = new_folder(spark, "points")
    write_table(lidar(spark, d), path)
    return read_points(spark, path)
