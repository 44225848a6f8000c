"""A sink that gives every page a file of its own, all of them or none.

Tasks write into a hidden folder beside the target; a file is written under another name first and then renamed, so a task that runs
twice leaves one whole file. When all tasks are done the folder is renamed to the target, which is the moment its files can be seen; an aborted job's folder
is removed. Paths follow from a page alone, so nothing about single pages passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FOLDERS = 4096


def page_path() -> Column:
    """Place of a page below the target: folder, id and a hash of its HTML, so a repeated id with other HTML keeps its own file."""
    folder = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(FOLDERS)).cast("string")
    return F.concat(folder, F.lit("/"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit("-"),
                    F.substring(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256), 1, 12), F.lit(".html"))


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


def _files(path: str):
    """The file system of a path and the path in it; local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PageFilesWriter(DataSourceArrowWriter):
    def __init__(self, target: str, staging: str):
        self.target, self.staging = target, staging

    def write(self, iterator: Iterator) -> Written:
        files, base = _files(self.staging)
        made, done, size = set(), 0, 0
        for batch in iterator:
            for path, html in zip(batch.column("path"), batch.column("html")):
                name, body = path.as_py(), html.as_py() or b""
                folder = f"{base}/{name.rpartition('/')[0]}"
                if folder not in made:
                    files.create_dir(folder)
                    made.add(folder)
                draft = f"{base}/{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(body)
                files.move(draft, f"{base}/{name}")
                done, size = done + 1, size + len(body)
        return Written(done, size)

    def commit(self, messages: list) -> None:
        files, base = _files(self.staging)
        _, target = _files(self.target)
        files.create_dir(base)
        files.move(base, target)

    def abort(self, messages: list) -> None:
        files, base = _files(self.staging)
        if files.get_file_info(base).type.name == "Directory":
            files.delete_dir(base)


class PageFiles(DataSource):
    """``df.write.format("page_files")``: rows (path string, html binary) to files below the option ``path``, which must not exist yet."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> PageFilesWriter:
        target = self.options["path"].rstrip("/")
        files, place = _files(target)
        if files.get_file_info(place).type.name != "NotFound":
            raise ValueError(f"{target} exists")
        parent, _, last = target.rpartition("/")
        return PageFilesWriter(target, f"{parent}/.{last}-{uuid.uuid4().hex}")


def write_pages(pages: DataFrame, target: str) -> None:
    spark: SparkSession = pages.sparkSession
    spark.dataSource.register(PageFiles)
    pages.select(page_path().alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("html")).write.format("page_files").mode("append").save(target)


def written_pages(spark: SparkSession, target: str) -> DataFrame:
    """path (below the target), bytes of the files; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(target)
    return found.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), F.col("length").alias("bytes"))
