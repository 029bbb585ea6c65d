"""Small text files named by their unit: a logger's month, a response's result."""
from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F


def write_files(files: DataFrame, path: str) -> int:
    """Write each row (file: name below `path`, body) as one file and return their number.

    A file is written under its attempt's name and then renamed, so a repeated task leaves whole files. Rows without
    a name or body are not written; of several rows with one name one stays.
    """
    def write(batches):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, body in zip(batch.column("file").to_pylist(), batch.column("body").to_pylist()):
                target = f"{root}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                folder, _, last = target.rpartition("/")
                draft = f"{folder}/_{attempt}-{last}"
                with store.open_output_stream(draft) as out:
                    out.write(body.encode())
                store.move(draft, target)
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    known = files.select("file", "body").filter("file is not null and body is not null")
    return known.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _bodies(df: DataFrame, file: Column, order: list[Column], line: Column, head: str = "") -> DataFrame:
    """(file, body): the lines of each file in order."""
    rows = df.select(file.alias("file"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line")).alias("row"))
    lines = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"])
    return rows.groupBy("file").agg(F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n")).alias("body"))


def write_loggers(readings: DataFrame, path: str, folder: Column, order: str) -> int:
    """Readings (tomst_id, datetime in UTC, zone, T1, T2, T3, moist) as logger files, one per folder, logger and month.

    `order` is the column by which the rows of a file are written. A missing value is an empty field.
    """
    def field(c: str) -> Column:
        return F.coalesce(F.translate(F.col(c).cast("string"), ".", ","), F.lit(""))

    stamp = F.date_format("datetime", "yyyy.MM.dd HH:mm")
    file = F.concat(folder, F.lit("/data_"), F.col("tomst_id").cast("string"), F.lit("_"), F.date_format("datetime", "yyyyMM"), F.lit(".csv"))
    line = F.concat_ws(";", F.col(order).cast("string"), stamp, field("zone"), *[field(c) for c in ("T1", "T2", "T3", "moist")])
    return write_files(_bodies(readings.filter("tomst_id is not null and datetime is not null"), file, [F.col(order)], line), path)


def write_results(df: DataFrame, path: str, prefix: str, unit: str, columns: list[str]) -> int:
    """The rows of each unit as one CSV with a header, named `prefix`_unit.csv, in the order of their columns."""
    line = F.to_csv(F.struct(*columns))
    file = F.concat(F.lit(f"{prefix}_"), F.regexp_replace(F.col(unit).cast("string"), "[^A-Za-z0-9.#-]", "_"), F.lit(".csv"))
    return write_files(_bodies(df, file, [F.col(c) for c in columns], line, ",".join(columns) + "\n"), path)
