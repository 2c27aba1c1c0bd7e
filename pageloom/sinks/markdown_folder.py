"""A folder of Markdown files, one per page, as a data source that the tasks write.

Every task writes whole files below a staging folder in the target.  Only when
all tasks have ended does the commit move what the successful ones wrote into
place; what lost or repeated attempts left goes with the staging folder.  The
driver makes that folder and no task does, so that an attempt which outlives a
failed export finds no place to write to.
"""

from __future__ import annotations

import os
import sys
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pageloom.session import written
from pageloom.sinks.documents import document_files, export_layout, page_documents

# Ship this code with the task, so that executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOVES_AT_ONCE = 32
DROP_ATTEMPTS = 6


@dataclass
class Staged(WriterCommitMessage):
    """The folder one task attempt has filled."""

    folder: str


class FolderWriter(DataSourceWriter):
    """Rows ``(file, document)`` to files of these names; files already there are replaced."""

    def __init__(self, target: str):
        self.target = target if "://" in target else os.path.abspath(target)
        self.staging = f"{self.target.rstrip('/')}/_staging-{uuid.uuid4().hex}"
        files, staging = fs.FileSystem.from_uri(self.staging)
        files.create_dir(staging, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, staging = fs.FileSystem.from_uri(self.staging)
        folder = f"{staging}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=False)
        for row in iterator:
            with files.open_output_stream(f"{folder}/{row.file}") as out:
                out.write(row.document.encode("utf-8"))
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        """One rename a page, some at a time; a folder's listing is the most that is held."""
        files, target = fs.FileSystem.from_uri(self.target)
        files.create_dir(target, recursive=True)
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            for message in messages:
                if message is not None:
                    staged = files.get_file_info(fs.FileSelector(message.folder))
                    list(pool.map(lambda info: files.move(info.path, f"{target}/{info.base_name}"), staged))
        self._drop_staging()

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        """Tries again while an attempt that is being killed adds files to its own folder."""
        files, staging = fs.FileSystem.from_uri(self.staging)
        for attempt in range(DROP_ATTEMPTS):
            try:
                if files.get_file_info(staging).type != fs.FileType.NotFound:
                    files.delete_dir(staging)
                return
            except OSError:
                if attempt == DROP_ATTEMPTS - 1:
                    raise
                time.sleep(0.1 * 2**attempt)


class MarkdownFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_folder"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"])


def export_documents(results: DataFrame, path: str, order: list[str], index: str | None = None) -> str:
    """Write result pages as ``<path>/<name>.md`` and return the target.

    With one page and a path that ends in ``.md`` the target is that file.  Of
    pages with one file name the last by ``order`` is written, see
    ``document_files``.  No result writes no file.
    """
    # Results are read three times: counted, named and written.
    columns = dict.fromkeys([*order, "url", "markdown", "depth"])
    number = [] if index is None else [F.expr(index).alias("_number")]
    with written(results.select(*columns, *number), "results") as made:
        layout = export_layout(made, path).first()
        folder = layout["target"]
        if layout["mode"] == "file":
            folder, name = os.path.split(layout["target"])
            chosen = page_documents(made).withColumn("file", F.lit(name))
        else:
            chosen = page_documents(document_files(made, order, None if index is None else "_number"))
        results.sparkSession.dataSource.register(MarkdownFolder)
        chosen = chosen.select("file", "document").where("document IS NOT NULL")
        chosen.write.format("markdown_folder").mode("append").save(folder)
    return layout["target"]
