"""A content-addressed store as a data source: each body is a file named by its hash, once, however often it is written."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "content_store"


def filesystem(uri: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def content_name(body: bytes, suffix: str) -> str:
    h = sha256(body).hexdigest()
    return f"{h[:2]}/{h}{suffix}"


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: its folder, and the names that its files shall have."""

    folder: str
    names: list[str]


class ContentStore(DataSource):
    """Writes rows (body BINARY, suffix STRING) under the option `path`; null bodies are passed over.

    Tasks write new bodies into a staging folder of the job. When all have ended the driver moves each into place, if no
    other task's twin stands there: a rename a new body, no byte passes the driver. A failed or killed job, and attempts
    of tasks that were given up, leave nothing but what stood there before: the staging folder is made before tasks start
    and goes when the job ends, and a task that is still at work then has nowhere to write. A rerun finds all bodies and
    writes none.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a content store is only added to: use mode('append')")
        names = [f.name for f in schema.fields]
        if "body" not in names:
            raise ValueError("a content store takes a column body, and suffix")
        return ContentWriter(self.options["path"].rstrip("/"))


class ContentWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex
        fs, path = filesystem(root)
        fs.create_dir(f"{path}/_staging/{self.job}", recursive=True)

    def write(self, rows: Iterator) -> Staged:
        from pyarrow.fs import FileType

        fs, root = filesystem(self.root)
        folder, names = f"{root}/_staging/{self.job}/{uuid.uuid4().hex}", {}
        for row in rows:
            if row["body"] is None:
                continue
            body = bytes(row["body"])
            name = content_name(body, (row["suffix"] if "suffix" in row else None) or "")
            if name in names or fs.get_file_info(f"{root}/{name}").type != FileType.NotFound:
                continue
            if not names:
                fs.create_dir(folder, recursive=False)
            names[name] = True
            with fs.open_output_stream(f"{folder}/{name.replace('/', '_')}") as f:
                f.write(body)
        return Staged(folder, list(names))

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = filesystem(self.root)
        for m in messages:
            for name in m.names if m else ():
                if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
                    fs.create_dir(f"{root}/{name.split('/')[0]}", recursive=True)
                    fs.move(f"{m.folder}/{name.replace('/', '_')}", f"{root}/{name}")
        self.clean(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self.clean(*filesystem(self.root))

    def clean(self, fs, root: str) -> None:
        from pyarrow.fs import FileSelector, FileType

        for wait in (0, 0.1, 0.5, 2):  # a task that has not heard of the end may have written meanwhile
            time.sleep(wait)
            with contextlib.suppress(OSError):
                if fs.get_file_info(f"{root}/_staging/{self.job}").type == FileType.NotFound:
                    break
                fs.delete_dir(f"{root}/_staging/{self.job}")
        with contextlib.suppress(OSError):  # another job's is left alone
            if not fs.get_file_info(FileSelector(f"{root}/_staging")):
                fs.delete_dir(f"{root}/_staging")


def store_bodies(df: DataFrame, path: str, body: str = "body", suffix: str = "suffix") -> None:
    """Adds the bodies of df to the store under path."""
    df.sparkSession.dataSource.register(ContentStore)
    df.selectExpr(f"`{body}` AS body", f"`{suffix}` AS suffix").write.format(FORMAT).mode("append").option("path", path).save()


def stored_bodies(spark, path: str) -> DataFrame:
    """(path, n_bytes, body) of the store, paths below its root. Spark's reader passes over the file of the empty body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("regexp_extract(path, '([0-9a-f]{2}/[0-9a-f]{64}[^/]*)$', 1) AS path", "length AS n_bytes", "content AS body").where("path != ''")
