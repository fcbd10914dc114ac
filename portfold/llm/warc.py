"""WARC archives as a Spark data source, and pages archived with revisit records instead of repeated payloads.

``read_warc`` and ``spark.read.format("warc")`` plan one partition per run of whole files up to ``split_bytes``; a file larger than that is a
partition of its own. Filters on the columns of ``HEADER_COLUMNS`` are pushed down: of every record the header is parsed first, and
unless it passes, the block is stepped over. In a ``.warc.gz`` whose members state their length (the ``sl`` field of the format's
annex, which the writer sets) the compressed bytes are stepped over too; in any other they are inflated and thrown away. A schema
without ``payload`` leaves payloads undecoded, also of records that pass. At most one record and one batch are held in memory.

The writer gives each task its own files of at most ``max_file_bytes`` plus one record, one gzip member per record. Files count from
the moment when the driver commits them in a ``_commit-*.json``: those of failed or repeated attempts are never read. A folder without
such a file is read whole.

``archive`` writes a record per row. Rows with equal payloads of ``least_bytes`` or more share one: the row with the largest key is
the ``response``, the others are ``revisit`` records that refer to it and hold no payload. Payloads are compared by SHA-256 and length.
Groups are reduced on the map side to one row, so a group with a third of all rows is never gathered.

Defined results: null payloads are empty, null addresses are left out; blanks and control characters of an address are
percent-encoded; rows that tie on the largest key, repeated rows among them, are all responses; a null key is smaller than any other;
an empty table gives archives without such records; extra input columns are left out, whatever their names.
"""

import base64
import gzip
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column: the header that it shows.
HEADER_COLUMNS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "content_type": "Content-Type", "content_length": "Content-Length", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "truncated": "WARC-Truncated",
}
_TEXTS = pa.map_(pa.string(), pa.string())
_ARROW = {name: pa.string() for name in HEADER_COLUMNS} | {
    "content_length": pa.int64(), "payload_sha1": pa.string(), "headers": _TEXTS, "http_status": pa.int32(), "http_headers": _TEXTS, "payload": pa.binary(),
}
SCHEMA = ", ".join(f"{n} " + {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", _TEXTS: "map<string,string>"}.get(t, "string")
                   for n, t in _ARROW.items())
SPLIT_BYTES = 128 << 20
MAX_FILE_BYTES = 256 << 20
LEAST_BYTES = 1000
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 2000
_FIRST_BYTES = 16 << 10
_HEADER_LIMIT = 1 << 20
_MEMBER = struct.Struct("<4sIBBH2sHII")  # magic, method and flags; time; level; system; extra: its length, name, length, two lengths


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


# Reading

def _parsed(head: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name; continued lines are joined."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def sha1_hex(digest: str | None) -> str | None:
    """A labelled SHA-1 in base 32 or hexadecimal as bare lower-case hexadecimal; null for others."""
    label, _, value = (digest or "").partition(":")
    if label.lower() != "sha1" or len(value) not in (32, 40):
        return None
    return base64.b32decode(value, casefold=True).hex() if len(value) == 32 else value.lower()


def _length(head: dict[str, str]) -> int:
    if not head.get("content-length", "").isdigit():
        raise ValueError(f"a record without a content length: {head}")
    return int(head["content-length"])


def _until_blank(lines: Iterator[bytes]) -> bytes:
    """The first lines up to the blank one that ends a header, that one too; empty at the end of the input."""
    taken, size = [], 0
    for line in lines:
        if not taken and line in (b"\r\n", b"\n"):
            continue  # blank lines between records
        taken.append(line)
        size += len(line)
        if line in (b"\r\n", b"\n") or size > _HEADER_LIMIT:
            break
    return b"".join(taken)


class _Stream:
    """Records one after the other: a plain file, or what a file of any gzip members inflates to."""

    def __init__(self, file: io.BufferedReader | gzip.GzipFile) -> None:
        self.file, self.left = file, 0

    def next(self) -> dict[str, str] | None:
        """The next record's header; what is left of the record before is stepped over."""
        self._skip(self.left)
        head = _until_blank(iter(self.file.readline, b""))
        if not head:
            return None
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {head[:40]!r}")
        parsed = _parsed(head)
        self.left = _length(parsed)
        return parsed

    def _skip(self, size: int) -> None:
        if size and isinstance(self.file, io.BufferedReader):
            self.file.seek(size, io.SEEK_CUR)
            return
        while size > 0:
            step = len(self.file.read(min(size, 1 << 20)))
            size = size - step if step else 0

    def http_head(self) -> bytes:
        taken = []
        while self.left and (not taken or taken[-1] not in (b"\r\n", b"\n")):
            taken.append(self.file.readline(self.left))
            if not taken[-1]:
                raise ValueError("the file ends within a record")
            self.left -= len(taken[-1])
        return b"".join(taken)

    def rest(self) -> bytes:
        block = self.file.read(self.left)
        if len(block) < self.left:
            raise ValueError("the file ends within a record")
        self.left = 0
        return block


class _Members:
    """Records in gzip members of one record each that state their own length."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file, self.end = file, 0

    @staticmethod
    def stated(file: io.BufferedReader) -> int:
        """The length of the member at the file's position, 0 if it doesn't state one."""
        at = file.tell()
        start = file.read(_MEMBER.size)
        file.seek(at)
        if len(start) < _MEMBER.size:
            return 0
        magic, _, _, _, _, name, size, length, _ = _MEMBER.unpack(start)
        return length if magic == b"\x1f\x8b\x08\x04" and name == b"sl" and size == 8 else 0

    def next(self) -> dict[str, str] | None:
        self.file.seek(self.end)
        length = self.stated(self.file)
        if not length:
            if self.file.read(1):
                raise ValueError(f"the member at byte {self.end} doesn't state its length, as the first one does")
            return None
        first = self.file.read(min(length, _FIRST_BYTES))
        self.end += length
        self.compressed = length - len(first)
        self.inflater = zlib.decompressobj(31)
        self.inflated = self.inflater.decompress(first, _FIRST_BYTES)
        while (stop := self.inflated.find(b"\r\n\r\n")) < 0:
            if len(self.inflated) > _HEADER_LIMIT or not self._more(_FIRST_BYTES):
                raise ValueError(f"no header ends in the member before byte {self.end}")
        head, self.inflated = self.inflated[:stop + 4], self.inflated[stop + 4:]
        parsed = _parsed(head)
        self.left = _length(parsed)
        return parsed

    def _more(self, limit: int) -> bool:
        """Inflates further, ``limit`` bytes at most (0: all there is); False at the member's end."""
        waiting = self.inflater.unconsumed_tail
        if not waiting and self.compressed:
            waiting = self.file.read(min(self.compressed, limit or self.compressed))
            self.compressed -= len(waiting)
        more = self.inflater.decompress(waiting, limit) if waiting else b""
        self.inflated += more
        return bool(waiting)

    def http_head(self) -> bytes:
        while (stop := self.inflated.find(b"\r\n\r\n")) < 0 and len(self.inflated) < min(self.left, _HEADER_LIMIT):
            if not self._more(_FIRST_BYTES):
                break
        stop = stop + 4 if stop >= 0 else self.left
        head, self.inflated = self.inflated[:stop], self.inflated[stop:]
        self.left -= len(head)
        return head

    def rest(self) -> bytes:
        while len(self.inflated) < self.left and self._more(0):
            pass
        if len(self.inflated) < self.left:
            raise ValueError(f"the member before byte {self.end} ends within its record")
        return self.inflated[:self.left]


def _records(path: str) -> Iterator[_Stream | _Members]:
    """An open reader of the file's records."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as native, io.BufferedReader(native, 1 << 18) as file:
        if file.peek(2)[:2] != b"\x1f\x8b":
            yield _Stream(file)
        elif _Members.stated(file):
            yield _Members(file)
        else:
            yield _Stream(gzip.GzipFile(fileobj=file))


_COMPARISONS = {
    D.EqualTo: lambda have, want: have == want, D.In: lambda have, want: have in want,
    D.GreaterThan: lambda have, want: have > want, D.GreaterThanOrEqual: lambda have, want: have >= want,
    D.LessThan: lambda have, want: have < want, D.LessThanOrEqual: lambda have, want: have <= want,
    D.StringStartsWith: lambda have, want: have.startswith(want), D.StringEndsWith: lambda have, want: have.endswith(want),
    D.StringContains: lambda have, want: want in have,
}


def passes(value: str | int | None, test: D.Filter) -> bool:
    """Whether a header value passes a filter, by the rules of SQL for nulls."""
    wanted = not isinstance(test, D.Not)
    test = test if wanted else test.child
    if isinstance(test, D.IsNull | D.IsNotNull):
        return ((value is None) == isinstance(test, D.IsNull)) == wanted
    if isinstance(test, D.EqualNullSafe):
        return (value == test.value) == wanted
    if value is None or test.value is None or (isinstance(test, D.In) and not wanted and None in test.value):
        return False
    return _COMPARISONS[type(test)](value, test.value) == wanted


def _column_of(test: D.Filter) -> str | None:
    """The header column that a filter is about, None if the source can't decide it."""
    inner = test.child if isinstance(test, D.Not) else test
    if type(inner) not in {*_COMPARISONS, D.EqualNullSafe, D.IsNull, D.IsNotNull} or len(inner.attribute) != 1:
        return None
    return inner.attribute[0] if inner.attribute[0] in HEADER_COLUMNS else None


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        unknown = set(columns) - set(_ARROW)
        if unknown:
            raise ValueError(f"a WARC record has no columns {sorted(unknown)}; it has {sorted(_ARROW)}")
        self.path, self.columns = options["path"], columns
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple[str, D.Filter]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for test in filters:
            column = _column_of(test)
            if column:
                self.tests.append((column, test))
            else:
                yield test

    def partitions(self) -> list[D.InputPartition]:
        """Whole files in the order of their names, joined up to the split size."""
        runs: list[list[str]] = []
        room = 0
        for path, size in committed_files(self.path):
            if size > room or not runs:
                runs.append([])
                room = self.split_bytes
            runs[-1].append(path)
            room -= size
        return [D.InputPartition(run) for run in runs or [[]]]

    def _row(self, head: dict[str, str], record: _Stream | _Members) -> dict | None:
        row: dict = {column: head.get(name.lower()) for column, name in HEADER_COLUMNS.items()}
        row["content_length"] = _length(head)
        if not all(passes(row[column], test) for column, test in self.tests):
            return None
        row["payload_sha1"] = sha1_hex(row["payload_digest"])
        if "headers" in self.columns:
            row["headers"] = list(head.items())
        is_http = (row["content_type"] or "").replace(" ", "").lower().startswith("application/http")
        if is_http and not {"http_status", "http_headers", "payload"}.isdisjoint(self.columns):
            http = record.http_head()
            status = re.match(rb"HTTP/\S+ +(\d{3})", http)
            row["http_status"] = int(status[1]) if status else None
            row["http_headers"] = list(_parsed(http).items())
        if "payload" in self.columns:
            row["payload"] = record.rest()
        return row

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, _ARROW[c]) for c in self.columns])
        rows, size = [], 0
        for path in partition.value:
            for record in _records(path):
                while (head := record.next()) is not None:
                    row = self._row(head, record)
                    if row is None:
                        continue
                    rows.append({c: row.get(c) for c in self.columns})
                    size += len(row.get("payload") or b"")
                    if size > _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def committed_files(path: str) -> list[tuple[str, int]]:
    """Path and size of every archive that counts, by name."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    commits = [x.path for x in found if re.fullmatch(r"_commit-\w+\.json", x.base_name)]
    named = set()
    for commit in commits:
        with system.open_input_stream(commit) as file:
            named |= set(json.loads(file.read()))
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ("file://" if path.startswith("file:") else "")
    return sorted((prefix + x.path, x.size) for x in found
                  if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and (not commits or x.base_name in named))


# Writing

def _member(record: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    length = _MEMBER.size + len(body)
    if max(length, len(record)) > 0xFFFFFFFF:  # too long to be stated
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body
    return _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, length, len(record)) + body


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    """A record with the headers that are not None; line ends in them become blanks."""
    lines = [f"{name}: {re.sub(r'[\r\n]+', ' ', str(value))}\r\n" for name, value in headers.items() if value is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def _page_record(row: dict) -> bytes:
    """A response, or a revisit, of a row of ``archive``: an HTTP message, of which a revisit has the header only."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    digest = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    revisit = row["record_type"] == "revisit"
    return record_bytes({
        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"],
        "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Refers-To": row["refers_to"],
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http;msgtype=response",
    }, http if revisit else http + payload)


class _Committed(D.WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 6))
        self.max_file_bytes = int(options.get("max_file_bytes", MAX_FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Committed:
        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        attempt, files, out, size = uuid.uuid4().hex, [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > self.max_file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"part-{TaskContext.get().partitionId():06d}-{attempt}-{len(files):04d}.warc.gz")
                        out, size = system.open_output_stream(f"{inner}/{files[-1]}", compression=None), 0
                        size += out.write(_member(record_bytes({
                            "WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row["date"],
                            "WARC-Filename": files[-1], "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), self.level))
                    size += out.write(_member(_page_record(row), self.level))
        finally:
            if out is not None:
                out.close()
        return _Committed(files)

    def commit(self, messages: list[_Committed | None]) -> None:
        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        before = [x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.base_name.startswith("_commit-")]
        with system.open_output_stream(f"{inner}/_commit-{uuid.uuid4().hex}.json", compression=None) as file:
            file.write(json.dumps([name for m in messages if m for name in m.files]).encode())
        for commit in before if self.overwrite else []:
            system.delete_file(commit)

    def abort(self, messages: list[_Committed | None]) -> None:
        system, inner = file_system(self.path)
        for name in [name for m in messages if m for name in m.files]:
            system.delete_file(f"{inner}/{name}")


class WarcDataSource(D.DataSource):
    """``format("warc")``. Options: ``path``, ``split_bytes``; for writing ``level`` (gzip) and ``max_file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known to the session and lets Python sources take filters (a setting of the session)."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: Iterable[str] = (), *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a file or folder with these columns of ``SCHEMA``, all if none are named."""
    register(spark)
    wanted = set(columns) or set(_ARROW)
    if wanted - set(_ARROW):
        raise ValueError(f"a WARC record has no columns {sorted(wanted - set(_ARROW))}")
    schema = T.StructType([f for f in T.StructType.fromDDL(SCHEMA).fields if f.name in wanted])
    return spark.read.format("warc").schema(schema).option("split_bytes", split_bytes).load(path)


# Pages

def _record_id(key: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:row:"), F.url_encode(F.coalesce(key.cast("string"), F.lit(""))), F.lit(">"))


def key_of(record_id: F.Column) -> F.Column:
    """The key, as text, in a record id that ``archive`` gave; null for a null key."""
    return F.nullif(F.url_decode(F.regexp_extract(record_id, "^<urn:row:(.*)>$", 1)), F.lit(""))


def page_rows(df: DataFrame, key: str, address: str, payload: str, *, date: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """What ``archive`` writes: a row per record, with its type, its reference, and its payload unless it is a revisit."""
    whole = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{address}`").cast("string").alias("address"), whole.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "hash": F.sha2("payload", 256)})
    large = rows.where(F.col("payload_bytes") >= least_bytes).select("key", "hash", "payload_bytes")
    groups = large.groupBy("hash", "payload_bytes").agg(F.max("key").alias("largest"), F.count("*").alias("n")).where("n > 1")
    # Joined by another form of the keys, so that no partitioning is reused and Spark may split a hot group's rows.
    groups = groups.select(F.concat_ws(":", "hash", "payload_bytes").alias("group"), "largest", F.lit(True).alias("repeated"))
    joined = rows.withColumn("group", F.concat_ws(":", "hash", "payload_bytes")).join(groups, "group", "left")
    revisit = F.coalesce(F.col("repeated"), F.lit(False)) & ~F.col("key").eqNullSafe(F.col("largest"))
    # Characters that would break the header line, as their codes in hexadecimal.
    characters = F.transform(F.split("address", ""), lambda c: F.when(
        c.rlike("[\\x00-\\x20\\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _record_id(F.col("key")).alias("record_id"),
        F.when(F.col("address").rlike("[\\x00-\\x20\\x7F]"), F.array_join(characters, "")).otherwise(F.col("address")).alias("target_uri"),
        F.lit(date).alias("date"), F.when(revisit, _record_id(F.col("largest"))).alias("refers_to"), "payload_bytes",
        F.sha1("payload").alias("payload_sha1"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(
    df: DataFrame, path: str, key: str = "page_id", address: str = "url", payload: str = "html", *, date: str,
    least_bytes: int = LEAST_BYTES, level: int = 6, max_file_bytes: int = MAX_FILE_BYTES,
) -> None:
    """Adds archives of the rows of ``df`` to the folder ``path``, which every executor reaches."""
    register(df.sparkSession)
    rows = page_rows(df, key, address, payload, date=date, least_bytes=least_bytes)
    rows.write.format("warc").mode("append").option("level", level).option("max_file_bytes", max_file_bytes).save(path)


def archived_pages(spark: SparkSession, path: str, key_type: T.DataType) -> DataFrame:
    """One row per page of archives that ``archive`` wrote: key, type, size and SHA-1 of the payload, key that it refers to.

    Responses are measured by the payload that is read back. Revisits, which have none, by their headers.
    """
    id_ = key_of(F.col("record_id")).cast(key_type).alias("key")
    responses = read_warc(spark, path, ["record_type", "record_id", "payload"]).where("record_type = 'response'")
    measured = responses.select(
        id_, "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        F.lit(None).cast(key_type).alias("refers_to"))
    revisits = read_warc(spark, path, ["record_type", "record_id", "payload_sha1", "refers_to", "http_headers"])
    stated = revisits.where("record_type = 'revisit'").select(
        id_, "record_type", F.col("http_headers")["content-length"].cast("long"), F.col("payload_sha1"),
        key_of(F.col("refers_to")).cast(key_type))
    return measured.union(stated)
