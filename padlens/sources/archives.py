"""S3: zip archives as a data source whose partitions are runs of entries of the archives' central directories."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, name string, user string, session string, kept boolean, first_line long, body string"
#: Entries that are read: user and session folder, then a CSV file.
KEEP = r"^(\d+)/(\d+)/([^/]+\.csv)$"
#: Uncompressed bytes of a partition's entries (an entry of more comes alone) and of a row's lines.
SPLIT, CHUNK = 128 << 20, 8 << 20


@dataclass
class Entries(InputPartition):
    """Entries of one archive, by their place in its directory."""

    archive: str
    places: list[int]


def _filesystem(path: str) -> tuple:
    """File system and path of a local path or of a URI that Arrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Range(io.RawIOBase):
    """An Arrow file as a raw stream that reads ranges, and that refuses places before the start as zipfile expects it."""

    def __init__(self, file: object) -> None:
        self.file, self.at, self.end = file, 0, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.at, self.end)[whence]
        if at < 0:
            raise OSError("before the start")
        self.at = at
        return at

    def readinto(self, buffer: memoryview) -> int:
        data = self.file.read_at(min(len(buffer), max(self.end - self.at, 0)), self.at)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


@contextmanager
def opened(archive: str) -> Iterator[zipfile.ZipFile]:
    system, inner = _filesystem(archive)
    with system.open_input_file(inner) as file, zipfile.ZipFile(io.BufferedReader(_Range(file), 1 << 16)) as z:
        yield z


def archives_at(path: str) -> list[str]:
    """The archive itself, or all of a folder's and its subfolders', in order of names."""
    from pyarrow import fs

    system, inner = _filesystem(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = path[: len(path) - len(path.partition("://")[2])] if "://" in path else ""
    return sorted(scheme + f.path for f in found if f.is_file and f.path.endswith(".zip"))


def _runs(sizes: list[int], limit: int) -> Iterator[list[int]]:
    run, total = [], 0
    for i, size in enumerate(sizes):
        if run and total + size > limit:
            yield run
            run, total = [], 0
        run.append(i)
        total += size
    if run:
        yield run


def chunks(stream: io.BufferedIOBase, size: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(number of the first line, text) of whole lines of about `size` bytes together; bytes that aren't UTF-8 are replaced. An
    empty entry gives one empty text."""
    line, held, count = 0, b"", 0
    while data := stream.read(size):
        held += data
        cut = held.rfind(b"\n") + 1
        if cut:
            yield line, held[:cut].decode("utf-8", "replace")
            line, held, count = line + held.count(b"\n", 0, cut), held[cut:], count + 1
    if held or not count:
        yield line, held.decode("utf-8", "replace")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.keep = options["path"], re.compile(options.get("keep", KEEP))
        self.split, self.chunk = int(options.get("splitbytes", SPLIT)), int(options.get("chunkbytes", CHUNK))

    def partitions(self) -> list[InputPartition]:
        """Reads the directories alone, at each archive's end."""
        out = []
        for archive in archives_at(self.path):
            with opened(archive) as z:
                out += [Entries(archive, run) for run in _runs([i.file_size for i in z.infolist()], self.split)]
        return out

    def read(self, partition: Entries | None) -> Iterator[tuple]:
        """The lines of the partition's entries; a zip inside the zip is read through, entry by entry. Entries that don't match
        come as a row without lines."""
        if partition is None:  # no archive holds an entry
            return
        with opened(partition.archive) as z:
            listed = z.infolist()
            yield from self.rows(partition.archive, z, [listed[i] for i in partition.places])

    def rows(self, archive: str, z: zipfile.ZipFile, infos: list[zipfile.ZipInfo]) -> Iterator[tuple]:
        for info in infos:
            if info.is_dir():
                continue
            if info.filename.endswith(".zip"):
                with z.open(info) as nested, zipfile.ZipFile(nested) as within:
                    yield from self.rows(archive, within, within.infolist())
                continue
            match = self.keep.match(info.filename)
            if not match:
                yield archive, info.filename, None, None, False, 0, None
                continue
            with z.open(info) as stream:
                for line, text in chunks(stream, self.chunk):
                    yield archive, info.filename, match[1], match[2], True, line, text


class ArchiveSource(DataSource):
    """Options: path (an archive or a folder), keep (pattern of the entries, user and session as its first groups), splitBytes,
    chunkBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return ArchiveReader(self.options)


def archive_rows(spark: SparkSession, path: str, keep: str = KEEP, split: int = SPLIT, chunk: int = CHUNK) -> DataFrame:
    """S3: `archive, name, user, session, kept, first_line, body` of the entries of the archives at `path`: texts of whole lines, of
    about `chunk` bytes. An archive is read by as many tasks as it has runs of `split` bytes, and a task holds one text."""
    spark.dataSource.register(ArchiveSource)
    options = {"keep": keep, "splitBytes": split, "chunkBytes": chunk}
    return spark.read.format("zip_entries").options(**options).load(path)
