"""Text in block-gzip files, the form of most .vcf.gz files: read by many tasks, and written.

Such a file is a row of gzip members of at most 64 KB, each of which names its own length. Spark's text reader splits the bytes of a file anywhere and
takes the four bytes at a member's start as its line separator, so that each task gets whole members and inflates them. The reader must not take the
codec from a file's name: a codec that passes bytes through stands in for it, under an ending that no file has but that is looked up before '.gz'.

A task gives out the lines that lie whole in its split. The first and the last line of a split, and a member that a chance occurrence of the four bytes
cuts at a split's border, come from a second scan, which keeps one row a split; those rows are put in order by file and joined with their
neighbours as a stream. Memory is one batch of members and one line. Nothing is collected; the price of the second scan is one more inflation, against a whole file in one task.

Cases: empty files and empty members give nothing; a last line needs no line feed; '\\r' before a line feed goes; other '\\r' stay; bytes that aren't UTF-8 stay as they are;
a file that breaks off inside a member, or a member whose checksum is wrong, is an error; other gzip files aren't read here (see blocked).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: a member's first bytes, the mark of the field that holds its length, and the empty member that ends a file.
MAGIC, FIELD = b"\x1f\x8b\x08\x04", b"BC"
END = MAGIC + b"\0\0\0\0\0\xff\x06\0" + FIELD + b"\x02\0\x1b\0\x03\0\0\0\0\0\0\0\0\0"
ENDINGS = (".gz", ".bgz")
_EXTENSION = "io.compress.passthrough.extension"
_AS_BYTES = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", _EXTENSION: ".!.gz", f"org.apache.hadoop.shaded.{_EXTENSION}": ".!.gz"}
BATCH, MEMBER = 4 << 20, 65_000


def member_length(member: bytes) -> int | None:
    """The length that a member, without its first four bytes, states for itself; None where this isn't the start of one."""
    end = 8 + int.from_bytes(member[6:8], "little")
    at = 8
    while at + 6 <= min(end, len(member)):
        size = int.from_bytes(member[at + 2 : at + 4], "little")
        if member[at : at + 2] == FIELD and size == 2:
            length = int.from_bytes(member[at + 4 : at + 6], "little") + 1 - len(MAGIC)
            return length if length >= end + 8 else None
        at += 4 + size
    return None


def inflate(member: bytes) -> bytes:
    text = zlib.decompress(member[8 + int.from_bytes(member[6:8], "little") : -8], wbits=-15)
    if zlib.crc32(text) != int.from_bytes(member[-8:-4], "little") or len(text) & 0xFFFFFFFF != int.from_bytes(member[-4:], "little"):
        raise ValueError("a member's checksum is wrong")
    return text


def deflate(text: bytes) -> bytes:
    """text, of at most MEMBER bytes, as one member."""
    for level in (6, 0):  # what can't be made smaller is stored
        squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = squeeze.compress(text) + squeeze.flush()
        if len(body) + 26 <= 1 << 16:
            break
    head = MAGIC + b"\0\0\0\0\0\xff\x06\0" + FIELD + b"\x02\0" + (len(body) + 25).to_bytes(2, "little")
    return head + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


class Split:
    """What one split of a file has given so far: whole lines, and its edges."""

    def __init__(self, start: int):
        self.start, self.before, self.open = start, None, None
        self.head, self.tail, self.broken, self.lines, self.size = [], [], False, [], 0

    def add(self, piece: bytes) -> None:
        """Takes what stands between two occurrences of MAGIC."""
        if self.open is None and not piece and self.start == 0:
            return  # before a file's first member
        held = piece if self.open is None else self.open + MAGIC + piece
        length = member_length(held)
        if length is None and self.start and not self.head and not self.broken and self.open is None:
            self.before = piece if self.before is None else self.before + MAGIC + piece
        elif length is None or len(held) > length:
            raise ValueError("not a block-gzip file, or a broken one")
        elif len(held) < length:
            self.open = held
        else:
            self.open = None
            self.text(inflate(held))

    def text(self, text: bytes) -> None:
        if not self.broken:
            first, feed, text = text.partition(b"\n")
            self.head.append(first)
            self.broken = bool(feed)
            if not feed:
                return
        whole, feed, rest = text.rpartition(b"\n")
        if feed:
            self.lines += (b"".join(self.tail) + whole).split(b"\n")
            self.size += len(whole)
            self.tail = []
        self.tail.append(rest)

    def edge(self) -> bytes:
        return b"".join(self.head) + (b"\n" + b"".join(self.tail) if self.broken else b"")


def _bare(lines: list[bytes]) -> list[bytes]:
    return [line.removesuffix(b"\r") for line in lines]


def _rows(values: list[list], names: list[str], kinds: list[pa.DataType], batch: pa.RecordBatch, at: int, keep: Sequence[str]) -> pa.RecordBatch:
    """Columns of values, and those of keep as they are in the batch's row at."""
    same = pa.array(np.full(len(values[0]), at))
    return pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(values, kinds, strict=True)), *(batch.column(k).take(same) for k in keep)], [*names, *keep])


def unpack(keep: Sequence[str], edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from pieces to whole lines, or to one row of edges a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, split, of = None, None, None

        def given(last: bool) -> Iterator[pa.RecordBatch]:
            if split is not None and edges and last:
                row = [[key[0]], [split.start], [split.before], [split.edge()], [split.open]]
                yield _rows(row, ["path", "start", "before", "text", "after"], [pa.string(), pa.int64(), *[pa.binary()] * 3], *of, keep)
            elif split is not None and not edges and split.lines and (last or split.size >= BATCH):
                yield _rows([_bare(split.lines)], ["value"], [pa.binary()], *of, keep)
            if split is not None and (edges or last or split.size >= BATCH):
                split.lines, split.size = [], 0

        for batch in batches:
            paths, starts = batch["path"], batch["start"].to_numpy()
            for i, piece in enumerate(batch["piece"]):
                here = (paths[i].as_py(), int(starts[i]))
                if here != key:
                    yield from given(True)
                    key, split, of = here, Split(here[1]), (batch.slice(i, 1), 0)
                split.add(piece.as_py())
                yield from given(False)
        yield from given(True)

    return run


def stitch(keep: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from edges, in order of path and start, to the lines that cross or touch splits' borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, text, open_, of = None, [], None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if open_ is not None:
                raise ValueError(f"{path} breaks off inside a member")
            if last := b"".join(text):
                yield _rows([_bare([last])], ["value"], [pa.binary()], *of, keep)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("path", "before", "text", "after")}
                if row["path"] != path:
                    yield from ended()
                    path, text, open_, of = row["path"], [], None, (batch.slice(i, 1), 0)
                more = b""
                if row["before"] is not None:
                    open_ = (open_ or b"") + MAGIC + row["before"]
                    length = member_length(open_)
                    if length is None or len(open_) > length:
                        raise ValueError(f"{path} isn't a block-gzip file, or a broken one")
                    if len(open_) == length:
                        more, open_ = inflate(open_), None
                if open_ is not None and (row["text"] or row["after"] is not None):
                    raise ValueError(f"{path} has a broken member")
                open_ = row["after"] if row["after"] is not None else open_
                whole, feed, rest = (more + row["text"]).rpartition(b"\n")
                if feed:
                    lines = (b"".join(text) + whole).split(b"\n")
                    yield _rows([_bare(lines)], ["value"], [pa.binary()], *of, keep)
                    text = []
                text.append(rest)
        yield from ended()

    return run


def read_lines(spark: SparkSession, paths: Sequence[str], base: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(value, keep) of the lines of block-gzip files, in no order. base: the folder whose partition columns keep names."""
    reader = spark.read.options(**_AS_BYTES).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1"))
    raw = (reader.option("basePath", base) if base else reader).text(list(paths))
    pieces = raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), *keep)
    kept = [pieces.schema[k] for k in keep]
    lines = T.StructType([T.StructField("value", T.BinaryType()), *kept])
    edge = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("before", "text", "after")), *kept])
    inside = pieces.mapInArrow(unpack(keep, False), lines)
    borders = pieces.mapInArrow(unpack(keep, True), edge).repartition("path").sortWithinPartitions("path", "start").mapInArrow(stitch(keep), lines)
    return inside.unionByName(borders).select(F.col("value").cast("string").alias("value"), *keep)


def blocked(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """Those of the files, by their names .gz or .bgz, whose first member names its length. Eighteen bytes of each are read, by a few threads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def is_blocked(file: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(conf).open(path)
        try:
            first = bytes(stream.read() & 0xFF for _ in range(18))
        finally:
            stream.close()
        return first.startswith(MAGIC) and first[12:16] == FIELD + b"\x02\0"

    asked = [f for f in files if f.endswith(ENDINGS) and not f.endswith((" .gz", "!.gz"))]
    with ThreadPoolExecutor(16) as pool:
        return [f for f, yes in zip(asked, pool.map(is_blocked, asked), strict=True) if yes]


def _members(lines: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the lines' text without their last two bytes, which are zero in every member of less than 64 KB; the empty member last."""
    held = b""
    for batch in lines:
        held += b"".join(line + b"\n" for line in batch[0].cast(pa.binary()).to_pylist())
        cuts = range(0, len(held) // MEMBER * MEMBER, MEMBER)
        if cuts:
            yield pa.RecordBatch.from_arrays([pa.array([deflate(held[a : a + MEMBER])[:-2] for a in cuts], pa.binary())], ["value"])
            held = held[cuts[-1] + MEMBER :]
    yield pa.RecordBatch.from_arrays([pa.array([m[:-2] for m in ([deflate(held)] if held else []) + [END]], pa.binary())], ["value"])


def write_lines(lines: DataFrame, path: str, ending: str = ".gz") -> None:
    """The one column of lines as block-gzip files, one a partition, each named part-...ending. The text writer's line separator is every member's last two bytes."""
    spark = lines.sparkSession
    lines.mapInArrow(_members, "value binary").select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", "\0\0").text(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(root):
        file = found.getPath()
        if file.getName().startswith("part-"):
            fs.rename(file, spark._jvm.org.apache.hadoop.fs.Path(root, file.getName().removesuffix(".txt") + ending))
