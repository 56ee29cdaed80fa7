"""Members of zip archives as a data source: only what is asked for is read.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").option("path", folder_or_file).option("members", "*/meta.json").load()

Planning reads the archives' central directories; members that match are dealt over tasks by their size, so a
large archive is read by many, and a task reads just its members' bytes.  ``content`` = false lists members
without reading any.  Paths are opened by pyarrow's file systems, local or remote.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

TASK_BYTES = 32 << 20


@dataclass
class Members(InputPartition):
    archive: str
    names: tuple[str, ...]


def opened(path: str):
    """An archive as a file that can be read at any place."""
    files, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pafs.LocalFileSystem(), path)
    return files.open_input_file(inner)


def archives_of(path: str) -> list[str]:
    """The archive itself, or the .zip files below a folder."""
    files, inner = pafs.FileSystem.from_uri(path)
    info = files.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(head + f.path for f in files.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.path.endswith(".zip"))


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.members = options["path"], options.get("members", "*")
        self.content = options.get("content", "true").lower() == "true"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Members]:
        out = []
        for archive in archives_of(self.path):
            with opened(archive) as f, zipfile.ZipFile(f) as z:
                names, size = [], 0
                for m in sorted(z.infolist(), key=lambda m: m.header_offset):
                    if m.is_dir() or not fnmatch.fnmatchcase(m.filename, self.members):
                        continue
                    if names and size + m.compress_size > self.task_bytes:
                        out.append(Members(archive, tuple(names)))
                        names, size = [], 0
                    names.append(m.filename)
                    size += m.compress_size
                if names:
                    out.append(Members(archive, tuple(names)))
        return out or [Members("", ())]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.names:
            return
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                yield partition.archive, name, z.getinfo(name).file_size, z.read(name) if self.content else None


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, member string, size long, content binary"

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options)
