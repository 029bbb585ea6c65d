"""Tables in and out, lineage cuts, layer catalogues."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CELL_SCHEMA = "layer string, row int, col int, value double"
VERTEX_SCHEMA = "feature_id string, part_id int, seq int, x double, y double"
POINT_SCHEMA = "x double, y double, z double, class int"
# Layer names that are not predictors.
LAYER_EXCLUDE = ("_sca", "dem_", "demm", "predstack", "slope_degree", "svi.tif")
# Integer packing types and their ranges.
PACK_RANGES = {"INT1U": (0, 255, "smallint"), "INT2S": (-32768, 32767, "smallint"),
               "INT2U": (0, 65535, "int"), "INT4U": (0, 4294967295, "bigint")}


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_cells(spark, path):
    return read_table(spark, path, CELL_SCHEMA)


def read_vertices(spark, path):
    return read_table(spark, path, VERTEX_SCHEMA)


def read_points(spark, path):
    return read_table(spark, path, POINT_SCHEMA)


def read_results(spark: SparkSession, path: str, prefix: str, schema: str) -> DataFrame:
    """Stack the small CSV results whose file name starts with `prefix`."""
    return (spark.read.schema(schema).option("header", True).option("pathGlobFilter", f"{prefix}*")
            .option("recursiveFileLookup", True).csv(path))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def pending(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units without a finished result."""
    return units.join(done.select(*keys), keys, "left_anti")


def select_layers(catalog: DataFrame, name: str = "layer", exclude: tuple[str, ...] = LAYER_EXCLUDE) -> DataFrame:
    keep = F.lit(True)
    for text in exclude:
        keep = keep & ~F.contains(F.col(name), F.lit(text))
    return catalog.filter(keep)


def pack_cells(df: DataFrame, scale: float, kind: str, value: str = "value") -> DataFrame:
    """round(value * scale) as the packed type; what does not fit is null."""
    lo, hi, spark_type = PACK_RANGES[kind]
    x = F.bround(F.col(value) * scale, 0)
    return df.withColumn(value, F.when(x.between(lo, hi), x).cast(spark_type))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A temporary folder is taken only where none is set and Spark runs in this one process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="thawline-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_batches(folder: str, rows: int = 1 << 16):
    """Record batches of the Parquet files of one folder in the shared folder, file by file, for use in a task."""
    from pyarrow import fs, parquet
    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    for path in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with store.open_input_file(path) as file:
            yield from parquet.ParquetFile(file).iter_batches(rows)


def read_part(folder: str):
    """`read_batches` as one Arrow table; None without files."""
    from pyarrow import Table
    batches = list(read_batches(folder))
    return Table.from_batches(batches) if batches else None


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)
