"""Token ids as flat binary files with 64-bit document offsets.

A part has four files: ids (unsigned 16- or 32-bit, little-endian), offsets (unsigned 64-bit, one more than
documents), docs (64-bit document ids) and nulls (a byte per document, 1 where the id is null). Parts follow one
another in ascending document id; the first id of a part is the sum of the sizes of the parts before it.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, new_folder, text_of
from .tokens import encoder, vocabulary_path


def _store(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else uri)


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    width: int  # bytes of an id
    bases: tuple[tuple[int, int], ...]  # (part, ids before it), in order


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int) -> TokenFiles:
    """Encode, append `end_id` to each document, write the parts. Only (part, size) pairs reach the driver.

    A part is written under the name of its attempt and then renamed, so a repeated task leaves whole files.
    Equal document ids follow their text; null ids come first.
    """
    from .tokens import Library
    width = 2 if max(Library(path).size, end_id + 1) <= 1 << 16 else 4
    kind = np.dtype(f"<u{width}")

    def write(batches):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = _store(folder)
        enc, out, total, docs_done = encoder(path), None, 0, 0
        names = {k: f"{root}/part-{part:06d}.{k}" for k in ("ids", "offsets", "docs", "nulls")}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = {k: store.open_output_stream(f"{n}.{attempt}") for k, n in names.items()}
                out["offsets"].write(np.zeros(1, "<u8").tobytes())
            keys = batch.column("doc_id")
            out["docs"].write(keys.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            out["nulls"].write(keys.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            for a, b in chunks(texts):
                ids, stops = enc.encode(texts[a:b])
                sizes = np.diff(stops)
                out["ids"].write(np.insert(ids, stops[1:], end_id).astype(kind).tobytes())
                ends = total + np.cumsum(sizes + 1)
                out["offsets"].write(ends.astype("<u8").tobytes())
                total = int(ends[-1])
            docs_done += len(texts)
        if out is not None:
            for k, n in names.items():
                out[k].close()
                store.move(f"{n}.{attempt}", n)
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "size": pa.array([total], pa.int64())})

    rows = docs.select("doc_id", text_of().alias("text"))
    parts = (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
             .mapInArrow(write, "part long, size long").collect())
    bases, at = [], 0
    for p in sorted(parts):
        bases.append((p.part, at))
        at += p.size
    return TokenFiles(folder, width, tuple(bases))


def read_tokens(spark: SparkSession, files: TokenFiles, block: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, one task per part."""
    bases, folder, kind = files.bases, files.folder, np.dtype(f"<u{files.width}")

    def mapped(store, name, dtype):
        """The file without reading it: mapped into memory where the store is a mounted folder."""
        if store.type_name == "local":
            return np.memmap(name, dtype, mode="r")
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read(), dtype)

    def read(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                part, base = bases[i]
                store, root = _store(folder)
                name = f"{root}/part-{part:06d}"
                offsets, keys, nulls = (mapped(store, f"{name}.{k}", t) for k, t in (("offsets", "<u8"), ("docs", "<i8"), ("nulls", "u1")))
                ids = mapped(store, f"{name}.ids", kind)
                step = max(1, block // max(1, int(offsets[-1]) // len(keys)))
                for a in range(0, len(keys), step):
                    b = min(len(keys), a + step)
                    at = offsets[a:b + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at[:-1], at[1:])]
                    yield pa.record_batch({
                        "doc_id": pa.array(np.asarray(keys[a:b]), pa.int64(), mask=np.asarray(nulls[a:b]).astype(bool)),
                        "start": pa.array(base + at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64())})

    tasks = spark.range(0, len(bases), 1, max(1, len(bases)))
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(docs: DataFrame, path: str | None = None, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the token files of all documents and describe them from the files.

    Null text is empty and has the end id alone. Repeated rows are rows of their own. No rows give no files, no rows.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    return read_tokens(spark, write_tokens(docs, folder, path or vocabulary_path("byte_bpe_50k.json"), end_id))
