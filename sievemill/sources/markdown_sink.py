"""A sink of one file a page, as a Python data source: `df.write.format("page_files")`.

Tasks write their files, in parallel, into a folder of their own attempt below the target;
the commit on the driver only moves what the successful attempts name, and an aborted job
leaves nothing. So a lost executor costs its task, and no reader sees half a job. Files go
through Arrow's file systems: local folders, and stores that Arrow knows by URI.

Rows need `name` (the file's) and `document` (null: nothing to write), and may have `failed`
(boolean). The counts of all commit messages are left in the file _COUNTS of the target:
success (files written), empty (no document), failed. Names that come twice: one of the
documents stays.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

COUNTS = "_COUNTS"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]
    empty: int
    failed: int


def store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


class _Files:
    """What the writers of batches and of streams share."""

    opens_job = True  # whether a task may make the job's folder

    def __init__(self, path: str, schema, overwrite: bool = False):
        missing = {"name", "document"} - set(schema.names)
        if missing:
            raise ValueError(f"rows need the columns {sorted(missing)}")
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_job_{uuid.uuid4().hex}"

    def write(self, rows):
        fs, root = store(self.path)
        folder = posixpath.join(root, self.job, uuid.uuid4().hex)
        fs.create_dir(folder, recursive=self.opens_job)
        names: dict[str, None] = {}
        empty = failed = 0
        for row in rows:
            if getattr(row, "failed", None):
                failed += 1
            elif row.document is None or not row.document.strip():
                empty += 1
            else:
                name = row.name
                if not name or "/" in name or name in (".", "..") or name.startswith("_job_"):
                    raise ValueError(f"no name for a file: {name!r}")
                with fs.open_output_stream(posixpath.join(folder, name)) as out:
                    out.write(row.document.encode())
                names[name] = None
        return Written(folder, list(names), empty, failed)

    def settle(self, messages, job: str) -> dict[str, int]:
        """Move what the messages name into the target, and give the counts."""
        fs, root = store(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            from pyarrow.fs import FileSelector

            for f in fs.get_file_info(FileSelector(root)):
                if f.is_file:
                    fs.delete_file(f.path)
        for m in done:
            for name in m.names:
                fs.move(posixpath.join(m.folder, name), posixpath.join(root, name))
        counts = {"success": len({n for m in done for n in m.names}), "empty": sum(m.empty for m in done), "failed": sum(m.failed for m in done)}
        with fs.open_output_stream(posixpath.join(root, job)) as out:
            out.write(json.dumps(counts).encode())
        self.drop()
        return counts

    def drop(self) -> None:
        from pyarrow.fs import FileType

        fs, root = store(self.path)
        folder = posixpath.join(root, self.job)
        for _ in range(50):  # tasks that are being cancelled may still write into it
            if fs.get_file_info(folder).type != FileType.Directory:
                return
            try:
                fs.delete_dir(folder)
            except OSError:
                time.sleep(0.1)


class Batch(_Files, DataSourceWriter):
    opens_job = False  # made here, on the driver: a task that outlives an abort finds none and fails

    def __init__(self, path: str, schema, overwrite: bool):
        super().__init__(path, schema, overwrite)
        fs, root = store(self.path)
        fs.create_dir(posixpath.join(root, self.job), recursive=True)

    def commit(self, messages) -> None:
        self.settle(messages, COUNTS)

    def abort(self, messages) -> None:
        self.drop()


class Stream(_Files, DataSourceStreamWriter):
    """Each batch of a stream is a job of its own: its counts are in _COUNTS_batch."""

    def commit(self, messages, batchId: int) -> None:
        self.settle(messages, f"{COUNTS}_{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self.drop()


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "name string, document string, failed boolean"

    def writer(self, schema, overwrite: bool) -> Batch:
        return Batch(self.options["path"], schema, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> Stream:
        return Stream(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PageFiles)


def counts(path: str, batch: int | None = None, keep: bool = True) -> dict[str, int]:
    """What the last job, or a batch of a stream, has counted."""
    fs, root = store(path.rstrip("/"))
    file = posixpath.join(root, COUNTS if batch is None else f"{COUNTS}_{batch}")
    with fs.open_input_stream(file) as f:
        found = json.loads(f.read())
    if not keep:
        fs.delete_file(file)
    return found
