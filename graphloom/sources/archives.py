"""ZIP archives as a source that many tasks read: each partition is a span of an archive's members, read by seek.

The planner reads only the end record and the central directory, cuts the members, in the order in which they lie
in the file, into spans, and gives each task the bytes of the directory that describe its spans, of which it has several
where there are very many. A task reads these entries and a span's bytes, span by span, so neither an archive's size nor its number of members is bounded by a task's memory.
"""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import ship_package

MEMBERS = "archive string, member string, size long, compressed_size long, crc string, compression int, flags int, header_offset long, entry_end long, content binary, fault string"
SPAN_BYTES, MAX_GAP, MEMBER_BYTES = 32 << 20, 16384, 1 << 30
#: Most tasks that read archives; longer lists of spans are dealt to so many.
MOST_TASKS = 2048
#: Signatures and lengths of a ZIP file's records, and what archivers add beside the members.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_ENTRY_SIZE, _LOCAL_SIZE, _END_SIZE = 46, 30, 22
METADATA = r"(^|/)(__MACOSX/|\._|\.DS_Store$|Thumbs\.db$)|/$"
_CHUNK = 16 << 20


class ArchiveError(ValueError):
    """A ZIP file whose directory cannot be trusted."""


def _opened(uri: str):
    """A file for reading at any place, through the file system that its URI names."""
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(uri)
    return system.open_input_file(path)


def listed(path: str, pattern: str = r"\.zip$") -> list[str]:
    """URIs of the files under a path, or the path itself where it is a file."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    system, place = FileSystem.from_uri(path)
    info = system.get_file_info(place)
    if info.type == FileType.File:
        return [path]
    scheme = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted(scheme + f.path for f in system.get_file_info(FileSelector(place, recursive=True)) if f.type == FileType.File and re.search(pattern, f.path.lower()))


def directory(file) -> tuple[int, int, int]:
    """Where an archive's central directory begins and ends, and what to add to its offsets (bytes before the archive)."""
    size = file.size()
    file.seek(max(0, size - _END_SIZE - 65535))
    tail = file.read()
    at = tail.rfind(_END)
    if at < 0 or len(tail) - at < _END_SIZE:
        raise ArchiveError("no end record")
    n, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = size - len(tail) + at
    file.seek(max(0, end - 20))
    locator = file.read(20)
    if locator[:4] == _LOCATOR:  # also of archives whose numbers fit the short record, as those of 2 to 4 GB
        place = struct.unpack("<Q", locator[8:16])[0]
        file.seek(min(place, size))
        record = file.read(56)
        if record[:4] == _END64:
            end = place
            length, offset = struct.unpack("<QQ", record[40:56])
        elif 0xFFFF == n or 0xFFFFFFFF in (length, offset):
            raise ArchiveError("no end record of 64 bits")
    start = end - length
    if start < offset:
        raise ArchiveError("the directory does not fit into the file")
    return start, end, start - offset


def entries(blob: bytes, shift: int = 0) -> Iterator[tuple]:
    """(place in blob, length, name, size, compressed size, CRC, compression, flags, header offset) of directory entries.

    A last entry that is cut off is left to the caller: its place is the end of the one before.
    """
    at = 0
    while at + _ENTRY_SIZE <= len(blob):
        if blob[at : at + 4] != _ENTRY:
            raise ArchiveError("the directory is damaged")
        flags, method, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, offset = struct.unpack("<HHIIIIHHHHHII", blob[at + 8 : at + _ENTRY_SIZE])
        length = _ENTRY_SIZE + n_name + n_extra + n_comment
        if at + length > len(blob):
            return
        name = blob[at + _ENTRY_SIZE : at + _ENTRY_SIZE + n_name]
        extra = blob[at + _ENTRY_SIZE + n_name : at + _ENTRY_SIZE + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # sizes and offset in 64 bits, of those that have no room above
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                size = next(wide, size) if size == 0xFFFFFFFF else size
                packed = next(wide, packed) if packed == 0xFFFFFFFF else packed
                offset = next(wide, offset) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        yield at, length, name.decode("utf-8" if flags & 0x800 else "cp437"), size, packed, crc, method, flags, offset + shift
        at += length


def _walked(file, start: int, end: int, shift: int) -> Iterator[tuple]:
    """The entries between two places of a file, some megabytes at a time; places count from the file's start."""
    at = start
    while at < end:
        file.seek(at)
        blob = file.read(min(_CHUNK, end - at))
        used = 0
        for place, length, *entry in entries(blob, shift):
            yield at + place, length, *entry
            used = place + length
        if not used:
            raise ArchiveError("the directory is cut off")
        at += used


def cut(first: np.ndarray, last: np.ndarray, apart: np.ndarray, max_gap: int, max_span: int) -> np.ndarray:
    """Number of the span of each member, in file order: the next member joins if it is not marked ``apart``, lies no further
    than max_gap behind, and the span then holds at most max_span bytes. A longer member is a span of its own."""
    new = np.ones(len(first), bool)
    new[1:] = apart[1:] | (first[1:] - last[:-1] - 1 > max_gap)
    begins, out = np.append(np.flatnonzero(new), len(first)), np.zeros(len(first), np.int64)
    cuts = []
    for lo, hi in zip(begins[:-1], begins[1:]):
        at = int(lo)
        while at < hi:
            cuts.append(at)
            at = max(at + 1, int(lo + np.searchsorted(last[lo:hi], first[at] + max_span - 1, "right")))
    out[cuts] = 1
    return np.cumsum(out) - 1


class Span:
    """Members of one archive: the parts of its directory that describe them, in file order, and where the last one ends."""

    def __init__(self, archive: str, parts: list[tuple[int, int]], end: int, shift: int):
        self.archive, self.parts, self.end, self.shift = archive, parts, end, shift


class Spans(InputPartition):
    """What a task reads, span by span."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


def spans(archive: str, max_gap: int, max_span: int) -> list[Span]:
    with _opened(archive) as file:
        start, end, shift = directory(file)
        rows = np.array([(place, length, offset) for place, length, _, _, _, _, _, _, offset in _walked(file, start, end, shift)], np.int64).reshape(-1, 3)
    if not len(rows):
        return []
    rows = rows[np.argsort(rows[:, 2], kind="stable")]
    after = np.append(rows[1:, 2], start)
    if (after <= rows[:, 2]).any():
        raise ArchiveError(f"members of {archive} overlap")
    number = cut(rows[:, 2], after - 1, np.zeros(len(rows), bool), max_gap, max_span)
    out = []
    borders = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(rows))
    for lo, hi in zip(borders[:-1], borders[1:]):
        place, length = rows[lo:hi, 0], rows[lo:hi, 1]
        runs = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1] + length[:-1])), hi - lo)
        parts = [(int(place[a]), int(place[b - 1] + length[b - 1])) for a, b in zip(runs[:-1], runs[1:])]
        out.append(Span(archive, parts, int(after[hi - 1]) - 1, shift))
    return out


def unpacked(method: int, packed: bytes) -> bytes:
    """A member's bytes; methods are stored, deflated, bzip2 and LZMA."""
    if method == 0:
        return packed
    if method == 8:
        return zlib.decompress(packed, -15)
    if method == 12:
        return bz2.decompress(packed)
    if method == 14:
        n = struct.unpack("<H", packed[2:4])[0]
        filters = [lzma._decode_filter_properties(lzma.FILTER_LZMA1, packed[4 : 4 + n])]
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(packed[4 + n :])
    raise NotImplementedError


def _member(chunk: bytes, size: int, packed: int, crc: int, method: int) -> tuple[bytes | None, str | None]:
    """Content and fault of a member whose local record begins the chunk."""
    if len(chunk) < _LOCAL_SIZE or chunk[:4] != _LOCAL:
        return None, "BadZipFile"
    flags, local, n_name, n_extra = *struct.unpack("<HH", chunk[6:10]), *struct.unpack("<HH", chunk[26:30])
    if flags & 1:
        return None, "encrypted"
    if local != method:
        return None, "BadZipFile"
    begin = _LOCAL_SIZE + n_name + n_extra
    try:
        body = unpacked(method, chunk[begin : begin + packed])
    except NotImplementedError:
        return None, "NotImplementedError"
    except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
        return None, "error"
    return (body, None) if len(body) == size and zlib.crc32(body) == crc else (None, "checksum")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.pattern = options.get("content", ".")
        self.max_gap, self.max_span = int(options.get("maxGap", MAX_GAP)), int(options.get("spanBytes", SPAN_BYTES))
        self.most = int(options.get("memberBytes", MEMBER_BYTES))

    def partitions(self):
        """Neighbouring spans go to one task where they are many: the driver keeps some kilobytes for each task."""
        found = [s for archive in listed(self.path) for s in spans(archive, self.max_gap, self.max_span)]
        n = min(len(found), MOST_TASKS)
        return [Spans(found[len(found) * i // n : len(found) * (i + 1) // n]) for i in range(n)]

    def read(self, partition):
        for span in partition.spans if partition is not None else []:  # None: no archive has a member
            yield from self._read(span)

    def _read(self, partition: Span):
        wanted = re.compile(self.pattern)
        with _opened(partition.archive) as file:
            found = [e for a, b in partition.parts for e in _walked(file, a, b, partition.shift)]
            ends = [e[8] - 1 for e in found[1:]] + [partition.end]
            rows, held, blob, origin = [], 0, b"", 0
            for (_, _, name, size, packed, crc, method, flags, offset), last in zip(found, ends):
                body, fault = None, None
                if not name.endswith("/") and wanted.search(name.lower()):
                    if max(size, packed) > self.most:
                        fault = "too large"
                    else:
                        if not origin <= offset or last >= origin + len(blob):
                            stop = max([last, *[x for x in ends if x - offset < _CHUNK]])  # several members by one read
                            file.seek(offset)
                            blob, origin = file.read(stop - offset + 1), offset
                        body, fault = _member(blob[offset - origin : last + 1 - origin], size, packed, crc, method)
                rows.append((partition.archive, name, size, packed, f"{crc:08x}", method, flags, offset, last, body, fault))
                held += len(body or b"")
                if held > _CHUNK or len(rows) > 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in MEMBERS.split(", ")])


class ZipMembers(DataSource):
    """``spark.read.format("zip_members")``: a row for each member of the ZIP files under a path.

    Options: content (expression of the lower-cased names whose bytes are read; all by default), spanBytes and maxGap
    (how members are cut into spans, which are dealt to MOST_TASKS tasks at most), memberBytes (a larger member has the fault 'too large' in place of content).
    """

    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return MEMBERS

    def reader(self, schema):
        return _Reader(self.options)


def members(spark: SparkSession, path: str, content: str = r"\.txt$", span_bytes: int = SPAN_BYTES, max_gap: int = MAX_GAP) -> DataFrame:
    """Members of the archives under a path with the bytes of those whose names fit, and their kinds.

    Size and CRC are checked; what cannot be read has a fault and no content. The path is one that pyarrow's file
    systems open (local or shared folders, HDFS, object stores); archives that only Spark's readers reach, of at
    most 2 GB each, are read by ``readers.archive_members``.
    """
    from .readers import member_kind

    ship_package(spark)
    spark.dataSource.register(ZipMembers)
    rows = spark.read.format("zip_members").option("content", content).option("spanBytes", span_bytes).option("maxGap", max_gap).load(path)
    return rows.withColumn("kind", member_kind(F.col("member")))


def repeated_members(rows: DataFrame) -> DataFrame:
    """(archive, member) of names that an archive has several times: to be resolved before an import."""
    return rows.groupBy("archive", "member").agg(F.count("*").alias("n")).where("n > 1").select("archive", "member")


def read_spans(rows: DataFrame, wanted: Column, metadata: Column, max_gap: int = MAX_GAP, max_span: int = 8 << 20) -> DataFrame:
    """(archive, first, last, n_members): byte ranges that hold all wanted members, as few as the rules allow.

    A wanted member joins the one before it if nothing but metadata lies between, the gap is at most max_gap and the
    range stays within max_span; a longer member is a range of its own. Each archive is passed through once, in the
    order of its offsets, by a task that holds one batch of its rows.
    """
    schema = "archive string, first long, last long, n_members long"

    def run(batches):
        open_span, open_name, blocked = None, None, True
        for batch in batches:
            names, out = batch.column(0), []
            for name, first, last, want, meta in zip(names.to_pylist(), *[batch.column(i).to_pylist() for i in range(1, 5)]):
                if name != open_name:
                    if open_span:
                        out.append((open_name, *open_span))
                    open_name, open_span, blocked = name, None, False
                if not want:
                    blocked = blocked or not meta
                    continue
                if open_span and not blocked and first - open_span[1] - 1 <= max_gap and last - open_span[0] + 1 <= max_span:
                    open_span = (open_span[0], last, open_span[2] + 1)
                else:
                    if open_span:
                        out.append((open_name, *open_span))
                    open_span = (first, last, 1)
                blocked = False
            if out:
                yield _spans_batch(out)
        if open_span:
            yield _spans_batch([(open_name, *open_span)])

    ship_package(rows.sparkSession)
    sorted_rows = rows.select(F.col("archive").cast("string").alias("archive"), "header_offset", "entry_end", wanted.alias("w"), metadata.alias("m")).repartition("archive").sortWithinPartitions("archive", "header_offset")
    return sorted_rows.mapInArrow(run, schema)


def _spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows))], names=["archive", "first", "last", "n_members"])


def write_archives(rows: DataFrame, path: str, archive_col: str, member_col: str, content_col: str) -> DataFrame:
    """Write ZIP files, one for each value of archive_col, and return (archive, n_members). A group's members stream
    through its task; where a task is repeated the file is written anew under its name."""
    import zipfile

    def run(batches):
        from pyarrow.fs import FileSystem

        system, place = FileSystem.from_uri(path)
        current, z, out, n = None, None, None, 0
        done = []
        for batch in batches:
            for archive, member, content in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if archive != current:
                    if z is not None:
                        z.close()
                        out.close()
                        done.append((current, n))
                    current, n = archive, 0
                    out = system.open_output_stream(f"{place}/{archive}.zip")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True)
                z.writestr(zipfile.ZipInfo(member, (2020, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
                n += 1
        if z is not None:
            z.close()
            out.close()
            done.append((current, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["archive", "n_members"])

    ship_package(rows.sparkSession)
    hadoop = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(hadoop)
    dealt = rows.select(F.col(archive_col).cast("string").alias("archive"), F.col(member_col).cast("string").alias("member"), F.col(content_col).cast("binary").alias("content"))
    return dealt.repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(run, "archive string, n_members long")
