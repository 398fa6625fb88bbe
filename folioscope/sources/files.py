"""A sink of whole files: each row (name, content) becomes one file, written by executors, all or none.

``df.write.format("folio_files").mode("append" or "overwrite").save(folder)`` after
:func:`register`.  Tasks write below ``_temporary`` in the folder; once all are done, the
commit moves their files into place (overwriting takes older files away before that), and an abort deletes them, so that a
lost executor or a failed job leaves nothing.  Folders are those that pyarrow's file systems know
(local and shared mounts, ``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes of a file's name that file systems allow, less those of an attempt.
NAME_BYTES = 200


def file_name(key: str, suffix: str) -> str:
    """A name for a key of any characters and length; other keys, other names."""
    name = quote(key, safe="")
    if name[:1] in ("", ".", "_"):  # names that begin so are hidden from readers
        name = f"%{ord(name[0]):02X}{name[1:]}" if name else "%20"
    if len(name) + len(suffix) > NAME_BYTES:
        name = f"{name[: NAME_BYTES - 60]}~{uuid.uuid5(uuid.NAMESPACE_URL, key).hex}"
    return name + suffix


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = posixpath.join(self.path, "_temporary", uuid.uuid4().hex)

    def write(self, rows: Iterator) -> Written:
        folder = posixpath.join(self.job, uuid.uuid4().hex)  # an attempt's own
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        names = []
        for row in rows:
            with system.open_output_stream(posixpath.join(at, row["name"])) as out:
                out.write(bytes(row["content"]))
            names.append(row["name"])
        return Written(names, folder)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for info in system.get_file_info(fs.FileSelector(at)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        for message in done:
            start = _opened(message.folder)[1]
            for name in message.names:
                system.move(posixpath.join(start, name), posixpath.join(at, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, at = _opened(self.job)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            system.delete_dir(at)
        above = posixpath.dirname(at)  # goes with its last job
        if system.get_file_info(above).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)


def write_files(files: DataFrame, path: str) -> None:
    """name and content as files in a folder, in place of those it has."""
    register(files.sparkSession)
    files.select("name", "content").write.format("folio_files").mode("overwrite").save(path)


def read_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """key (what the name was made of; of very long keys its beginning) and content of the files of a folder, by Spark's own reader."""
    from pyspark.sql import functions as F

    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), suffix.replace(".", r"\.") + "$", "")
    key = F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name)  # a plus sign stands for itself
    return rows.select(key.alias("key"), "content")
