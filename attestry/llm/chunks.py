"""Rows of a table as compressed chunks in files of the shared folder, so that later tasks fetch them by byte range.

A chunk is a few MB of text. Results about a chunk's rows are shuffled to its number, and the task that gets them reads
the rows themselves from the file: texts aren't shuffled. A file has a fresh name for each attempt of a task, and only
attempts that ended are in the table of chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import shared_dir, written
from .words import slices, trimmed

CHUNKS = "chunk long, file string, offset long, length long"
#: Bits of a chunk's number within its task.
WITHIN = 13


def _stored(base: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        name, out, made = f"{uuid.uuid4().hex}.chunks", None, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            nonlocal out, made
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            if made >> WITHIN:
                raise ValueError("a task has too many chunks; use more partitions or larger chunks")
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            data = sink.getvalue()
            at = out.tell()
            out.write(data)
            made += 1
            number = TaskContext.get().partitionId() << WITHIN | made - 1
            return pa.RecordBatch.from_pydict({"chunk": [number], "file": [f"{base}/{name}"], "offset": [at], "length": [data.size]})

        for batch in batches:
            for part in slices(batch, most=most // 4):
                held.append(part)
                size += part.nbytes
                if size >= most:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()
        if out is not None:
            out.close()

    return run


def stored(rows: DataFrame, most: int = 4 << 20) -> DataFrame:
    """The table of chunks (CHUNKS) of rows, which hold a column `text`; about `most` bytes each, one row at least."""
    return written(rows.mapInArrow(trimmed(_stored(shared_dir(rows.sparkSession), most)), CHUNKS))


def dealt(chunks: DataFrame) -> DataFrame:
    """Chunks over all shuffle partitions: as a table they are a few KB, which Spark would read in a few tasks."""
    return chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")


def told(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks with what was found out about them (a row a chunk at most). Never a broadcast: sizes of what tasks make from chunks can't be estimated."""
    return dealt(chunks).join(found.hint("merge"), "chunk", "left")


def fetch(batch: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
    """The rows of the chunk that row k of a batch of CHUNKS names."""
    store, path = fs.FileSystem.from_uri(batch.column("file")[k].as_py())
    with store.open_input_file(path) as f:
        data = f.read_at(batch.column("length")[k].as_py(), batch.column("offset")[k].as_py())
    found = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()
    return found[0] if found else None
