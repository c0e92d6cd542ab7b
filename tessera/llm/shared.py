"""What the operators share: the shared folder, written intermediate tables, words, partition counts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder, not yet made, in the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session may be without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Held while an intermediate table is written: shuffle files of a finished write are of no more use, and a batch of
#: records that goes to Python is small enough for the longest texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def keep(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, so a lost executor costs one read."""
    spark, path, old = df.sparkSession, scratch(df.sparkSession), {}
    for key, value in WRITING.items():
        try:
            old[key] = spark.conf.get(key)
        except Exception:  # noqa: BLE001  a Spark without this setting
            continue
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what keep() wrote, once nothing reads it any more."""
    jvm, path = df.sparkSession._jvm, df._tessera_path
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_resident: list = [None, None]


def resident(key, make: Callable):
    """What make() gave for key, kept between the tasks of a Python worker. A worker keeps one such thing: the next
    key's takes its place, so what a stage needed is gone once another stage needs something."""
    if _resident[0] != key:
        _resident[:] = [None, None]
        release()
        _resident[:] = [key, make()]
    return _resident[1]


def release() -> None:
    """Gives memory that nothing uses any more back to the machine, as far as its allocators let it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, with release() after its last batch: workers outlive tasks, their buffers shouldn't. Nor does what
    resident() kept for a stage outlive the first task of one that doesn't ask for it."""

    @wraps(work)
    def run(batches):
        _resident[:] = [None, None]
        yield from work(batches)
        release()

    return run


class Memo:
    """What compute gives for a piece of text, as bytes, in two generations: what is asked for again outlives the rest. A generation has `most`
    pieces of at most `longest` letters, so memory is bounded by some tens of MB."""

    def __init__(self, compute, most: int, longest: int = 64):
        self.compute, self.most, self.longest = compute, most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __getitem__(self, piece: str) -> bytes:
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.compute(piece)
            if len(piece) <= self.longest:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[piece] = found
        return found

    def each(self, pieces: list[str]) -> list[bytes]:
        """Each piece's bytes."""
        found = list(map(self.young.get, pieces))
        if None in found:
            found = [self[p] if x is None else x for p, x in zip(pieces, found, strict=True)]
        return found

    def joined(self, pieces: list[str]) -> bytes:
        """All pieces' bytes, one after the other."""
        return b"".join(self.each(pieces))


def open_file(uri: str, write: bool):
    """A file of any store that pyarrow knows; local files are mapped, not read."""
    import pyarrow as pa
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store, path, store.open_output_stream(path)
    return store, path, pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def partitions(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many parts df's data should be dealt out to, at least the session's number.

    Of a plan over files Catalyst knows the size; others, for which it guesses, are measured: their texts' bytes.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1 and leaves.apply(0).getClass().getSimpleName() == "LogicalRelation":
        size = int(plan.stats().sizeInBytes())
    else:
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
        size = df.select(sum(texts, F.lit(16)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // bytes_each)


def cell(doc_id: Column, n: int) -> Column:
    """Which of n cells a document is dealt to; cell_of() is the same in numpy."""
    d = F.coalesce(doc_id, F.lit(-1).cast("long"))
    return F.pmod(d.bitwiseXOR(F.shiftrightunsigned(d, 9)).bitwiseXOR(F.shiftrightunsigned(d, 17)), F.lit(n)).cast("int")


def cell_of(doc_id: np.ndarray, n: int) -> np.ndarray:
    u = doc_id.astype(np.int64).view(np.uint64)
    return ((u ^ (u >> np.uint64(9)) ^ (u >> np.uint64(17))).view(np.int64) % n).astype(np.int32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, and where each value starts (one more entry than values); null is empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
