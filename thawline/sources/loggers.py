"""Raw logger files to readings."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thawline.functions import parse_decimal, parse_stamp
from thawline.functions.ordered import last_per_key

# V1 ... V7 as on disk; a missing tail is allowed, further fields are ignored.
RAW_SCHEMA = ", ".join(f"V{i} string" for i in range(1, 8))
READING_COLUMNS = ("site", "tomst_id", "datetime", "zone", "T1", "T2", "T3", "moist")


def path_keys(path: Column, network: str) -> tuple[Column, Column]:
    """(site, logger id) from a file path. Ids that are not numbers are null."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    if network == "oulu":
        site = F.concat(F.lit("Haap."), F.regexp_replace(F.try_element_at(parts, F.lit(-2)), "\\.", "/"))
        token = 1
    elif network == "roslin":
        site = F.element_at(F.split(name, "_"), 1)
        token = 2
    else:
        raise ValueError(f"unknown network {network!r}")
    rest = F.split(F.regexp_replace(name, "data_", ""), "_")
    return site, F.try_element_at(rest, F.lit(token)).try_cast("bigint")


def read_loggers(spark: SparkSession, path: str, network: str, sep: str = ";") -> DataFrame:
    """All `*data_*` files under `path`, last value per logger and stamp.

    File order (path, then position in the file) decides which copy is last, so
    files of one logger may overlap.
    """
    raw = (spark.read.schema(RAW_SCHEMA).option("sep", sep).option("mode", "PERMISSIVE")
           .option("recursiveFileLookup", True).option("pathGlobFilter", "*data_*").csv(path)
           .select("*", F.col("_metadata.file_path").alias("_path"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_row")))
    site, logger = path_keys(F.col("_path"), network)
    readings = raw.select(
        site.alias("site"), logger.alias("tomst_id"), parse_stamp("V2").alias("datetime"),
        F.col("V3").try_cast("int").alias("zone"), parse_decimal("V4").alias("T1"), parse_decimal("V5").alias("T2"),
        parse_decimal("V6").alias("T3"), parse_decimal("V7").alias("moist"),
        F.struct("_path", "_block", "_row").alias("_arrival")).filter(F.col("datetime").isNotNull())
    return last_per_key(readings, ["site", "tomst_id", "datetime"], "_arrival").select(*READING_COLUMNS)


def union_networks(*dfs: DataFrame) -> DataFrame:
    """Stack networks by column name; absent columns are null, logger ids go."""
    def conform(df: DataFrame) -> DataFrame:
        if "error_tomst" in df.columns:
            df = df.withColumnRenamed("error_tomst", "probl")
        return df.drop("tomst_id")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(conform, dfs))
