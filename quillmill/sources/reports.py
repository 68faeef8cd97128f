"""Text reports written with a commit: ordered parts under a head that says how many rows there
are. A part is written by its task into a hidden folder of the report and moved into place when
all tasks are done, so a task that fails leaves no report, and an old one stays until then. The
head's number comes from what the tasks say they wrote: the rows are computed once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Folder of parts that are not committed; names that start so are not read as data.
STAGED = "_staged"


def opened(path: str):
    """(file system, path) of a local path or a URI that Arrow knows."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    rows: int


class ReportSource(DataSource):
    """A sink for one column of text. Options: path; head, a text in which {rows} is replaced;
    suffix of the files."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a report is replaced as a whole: use mode overwrite")
        return ReportWriter(self.options["path"], self.options.get("head", ""), self.options.get("suffix", "txt"))


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, suffix: str) -> None:
        self.path, self.head, self.suffix, self.run = path.rstrip("/"), head, suffix, uuid.uuid4().hex

    @property
    def staged(self) -> str:
        return f"{self.path}/{STAGED}-{self.run}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        name = f"part-{part + 1:05}.{self.suffix}"
        files, folder = opened(self.staged)
        files.create_dir(folder, recursive=True)
        rows = 0
        own = f"{folder}/{context.taskAttemptId()}-{name}"  # attempts of a task do not share a file
        with files.open_output_stream(own) as out:
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    out.write(((value or "") + "\n").encode())
                    rows += 1
        return Written(part, f"{context.taskAttemptId()}-{name}", rows)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, folder = opened(self.path)
        _, staged = opened(self.staged)
        files.create_dir(staged, recursive=True)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        for old in files.get_file_info(fs.FileSelector(folder)):
            if old.is_file:
                files.delete_file(old.path)
        with files.open_output_stream(f"{folder}/part-00000.{self.suffix}") as out:
            out.write(self.head.replace("{rows}", str(sum(m.rows for m in done))).encode() + b"\n")
        for place, m in enumerate((m for m in done if m.rows), start=1):
            files.move(f"{staged}/{m.name}", f"{folder}/part-{place:05}.{self.suffix}")
        files.delete_dir(staged)
        with files.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, folder = opened(self.staged)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


def save_report(sections: DataFrame, head: str, path: str, suffix: str) -> None:
    """sections(seq, value) in their order, in as many parts as the sort makes, below head."""
    sections.sparkSession.dataSource.register(ReportSource)
    rows = sections.orderBy("seq").select("value")
    rows.write.format("report").mode("overwrite").option("head", head).option("suffix", suffix).option("path", path).save()


def read_report(path: str) -> str:
    """A small report as one text."""
    from pyarrow import fs

    files, folder = opened(path)
    parts = sorted(f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-"))
    return "".join(files.open_input_stream(p).read().decode() for p in parts)
