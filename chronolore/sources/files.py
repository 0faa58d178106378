"""Small files by name: what the wire formats and notes are made of."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame

#: Tasks for each core that read small files, at most.
READERS = 4


def gathered(rows: DataFrame) -> DataFrame:
    """rows as read from small files, by a few tasks for each core however many files there are. Spark puts some thirty into a task, and what each task tells the
    driver would add up with their number."""
    return rows.coalesce(READERS * rows.sparkSession.sparkContext.defaultParallelism)


def write(rows: DataFrame, root: str) -> None:
    """A file <root>/<path> with the text of each row (path, text), written by the executors. root is a URI of a store that Arrow's file
    systems reach (hdfs, s3, gs, file), or a path that all executors and the driver share."""
    plain = root.removeprefix("file:") if root.startswith("file:") and not root.startswith("file://") else root

    def put(part) -> None:
        system, base = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
        made = set()
        for r in part:
            to = f"{base}/{r['path']}"
            if (folder := to.rpartition("/")[0]) not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(to) as f:
                f.write(r["text"].encode())

    # What is small in bytes may be many files, so they are dealt to all cores.
    rows.select("path", "text").repartition(rows.sparkSession.sparkContext.defaultParallelism, "path").foreachPartition(put)
