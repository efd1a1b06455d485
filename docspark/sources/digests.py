"""SHA-256 of stored files of any size.

The digest of a file is a chain over its bytes. A large file is read in splits
by as many tasks, and the chain goes over their pieces in rounds of bounded size:
what a round leaves of each file is the inner state of its digest, some hundred bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.sources.staging import release, stage

#: Bytes of a file that one task reads as a whole; a round of the chain takes of each file the splits that begin in so many bytes; bytes of a piece.
LARGE, ROUND, PIECE = 128 << 20, 128 << 20, 1 << 20
#: Names that Spark's reader of lines would decompress; such files are read as a whole.
_PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd|xz|lzo)$"
_BOM = b"\xef\xbb\xbf"


class Sha256:
    """The digest of the OpenSSL that Python's ``hashlib`` is linked with, as its public context: one that can be put down and taken up again."""

    def __init__(self, state: bytes | None = None):
        import ctypes

        import _hashlib

        self.lib, self.size = ctypes.CDLL(_hashlib.__file__), ctypes.c_size_t
        # eight words, two of length, a block of 64 bytes and two numbers
        self.context, self.digest = ctypes.create_string_buffer(state or b"", 112), ctypes.create_string_buffer(32)
        if state is None:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, self.size(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        self.lib.SHA256_Final(self.digest, self.context)
        return self.digest.raw.hex()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each split put together to pieces, numbered by ``at``; ``n`` counts a line feed for each line."""
    import pyarrow.compute as pc

    types = [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]
    row = lambda key, at, held: pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((*key, at, sum(map(len, held)) + len(held), b"\n".join(held)), types)], names=[n for n, _ in types])

    def runs() -> Iterator[tuple[tuple, pa.Array]]:
        """Neighbouring lines of one split."""
        for b in batches:
            files, blocks, lines = b.columns
            last, at = b.num_rows - 1, 0
            while at <= last:
                key = files[at].as_py(), blocks[at].as_py()
                end = last + 1
                if (files[last].as_py(), blocks[last].as_py()) != key:
                    end = next(i for i in range(at, end) if (files[i].as_py(), blocks[i].as_py()) != key)
                yield key, lines.slice(at, end - at)
                at = end

    for key, group in groupby(runs(), itemgetter(0)):
        held, size, at = [], 0, 0
        for _, lines in group:
            held.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), b"\n")[0].as_py())
            size += len(held[-1]) + 1
            if size >= PIECE:
                yield row(key, at, held)
                held, size, at = [], 0, at + 1
        if held:
            yield row(key, at, held)


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of each file after its next pieces; a file's rows come in order, first its state (block -1)."""
    rows = ((file, block, n, data) for b in batches for i in range(b.num_rows) for file, block, n, data in zip(*(b.slice(i, 1).column(c).to_pylist() for c in ("file", "block", "n", "data"))))
    for file, group in groupby(rows, lambda r: r[0]):
        digest, done = None, 0
        for _, block, n, data in group:
            if block < 0:
                digest, done = Sha256(data), n
                continue
            if done:
                digest.update(b"\n")
            digest.update(data)
            done += n
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.string()), (-1, pa.int64()), (0, pa.int64()), (done, pa.int64()), (digest.state(), pa.binary()))], names=["file", "block", "at", "n", "data"])


def _large_digests(spark: SparkSession, glob: str, chosen: Column) -> DataFrame:
    """(file, sha256) of the large files: their splits are read as lines, whatever they hold, and written as pieces; the rounds follow."""
    told = "file string, block long, at long, n long, data binary"
    lines = spark.read.option("lineSep", "\n").text(glob).where(chosen)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    # a split belongs to one round, which reads the pieces in its folder only
    pieces = stage(lines.mapInArrow(_pieces, told).withColumn("round", F.floor(F.col("block") / ROUND).cast("int")), "file-pieces", ("round",))
    sizes = spark.read.format("binaryFile").load(glob).where(chosen).select(F.col("_metadata.file_path").alias("file"), "length")
    # what the reader of lines drops: a mark of UTF-8 in front, and whether a line feed is last
    read = pieces.groupBy("file").agg(F.sum("n").alias("read"))
    over = stage(sizes.join(read, "file", "left").withColumn("over", F.coalesce("read", F.lit(0)) - F.col("length")), "file-sizes")
    odd = over.where(~F.col("over").isin(0, 1, -3, -2)).first()
    if odd:
        raise RuntimeError(f"{odd['file']}: {odd['read']} bytes read as lines, {odd['length']} stored")
    begun, ended = F.udf(lambda marked: _begun(marked), "binary"), F.udf(lambda state, fed: _ended(state, fed), "string")
    none = lambda n: F.lit(n).cast("long")
    states = stage(over.select("file", none(-1).alias("block"), none(0).alias("at"), none(0).alias("n"), begun(F.col("over") < -1).alias("data")), "file-states")
    parts = max(2 * over.count(), spark.sparkContext.defaultParallelism)
    for r in sorted(r[0] for r in pieces.select("round").distinct().collect()):
        rows = pieces.where(F.col("round") == r).select(*states.columns).unionByName(states)
        after = stage(rows.repartition(parts, "file").sortWithinPartitions("file", "block", "at").mapInArrow(_advance, told), "file-states")
        release(states)
        states = after
    out = stage(states.join(over, "file").select("file", ended("data", F.col("over").isin(0, -3)).alias("sha256")), "file-digests")
    release(pieces, over, states)
    return out


def _begun(marked: bool) -> bytes:
    digest = Sha256()
    if marked:
        digest.update(_BOM)
    return digest.state()


def _ended(state: bytes, fed: bool) -> str:
    digest = Sha256(bytes(state))
    if fed:
        digest.update(b"\n")
    return digest.hexdigest()


def read_digests(spark: SparkSession, glob: str) -> DataFrame:
    """Stored documents as (path, length, sha256). No task reads much more than ``LARGE`` bytes of a file, unless its name is that of a packed one or it holds no line feed for longer."""
    files = spark.read.format("binaryFile").load(glob)
    # conditions on ``_metadata`` alone choose files before any is opened
    large = (F.col("_metadata.file_size") > LARGE) & ~F.lower("_metadata.file_name").rlike(_PACKED)
    listed = files.where(large).select("path", "length", F.col("_metadata.file_path").alias("file"))
    whole = files.where(~large).select("path", "length", F.sha2("content", 256).alias("sha256"))
    if listed.isEmpty():
        return whole
    return whole.unionByName(listed.join(_large_digests(spark, glob, large), "file").select("path", "length", "sha256"))
