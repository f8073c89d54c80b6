"""A sink of text files under names of their own, as a Python data source with a two-phase commit.

``rows.write.format("document_files").mode("append").save(folder)`` takes (file_name, document). Tasks write into a hidden folder of the job, a
folder a task attempt, so a task that runs again or twice leaves nothing that readers see. Only when all have succeeded does the
driver move the files of the attempts that count to their names; a job that fails takes its hidden folder away. Names are moved, never
texts, by some threads at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "document_files"
HIDDEN = "_writing"
MOVERS = 16


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of a task attempt and how many files it holds."""

    folder: str
    files: int


class DocumentFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Attempt:
        system, base = _open(self.path)
        folder, n = f"{base}/{HIDDEN}-{self.job}/{uuid.uuid4().hex}", 0
        system.create_dir(folder, recursive=True)
        for row in iterator:
            with system.open_output_stream(f"{folder}/{row['file_name']}") as out:
                out.write(row["document"].encode("utf-8"))
            n += 1
        return Attempt(folder, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, base = _open(self.path)
        found = [(m, [f.path for f in system.get_file_info(fs.FileSelector(m.folder))]) for m in messages if m is not None and m.files]
        for message, files in found:
            if len(files) != message.files:
                raise RuntimeError(f"{message.folder} has {len(files)} files instead of {message.files}")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(base)):
                if old.is_file:
                    system.delete_file(old.path)
        with ThreadPoolExecutor(MOVERS) as movers:
            list(movers.map(lambda f: system.move(f, f"{base}/{f.rsplit('/', 1)[1]}"), (f for _, files in found for f in files)))
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        system, base = _open(self.path)
        folder = f"{base}/{HIDDEN}-{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DocumentFiles(DataSource):
    """Columns file_name and document; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_name string, document string"

    def writer(self, schema, overwrite: bool) -> DocumentFilesWriter:
        return DocumentFilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
