"""Helpers shared by the text operators.

Texts reach Python as Arrow batches of UTF-8 bytes. Words are runs of bytes that
are not ASCII white space (``bytes.split``), so characters outside ASCII are
never looked at one by one.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.session import prepare

LETTERS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


#: Rows that go to Python at once: texts may be long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
    "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
}


def pin_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, in rows and in bytes, as texts may be long; smaller settings stay."""
    for setting, most in BATCH_SETTINGS.items():
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(setting))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(setting, str(most))


def give_back() -> None:
    """Return memory that earlier work in this process no longer uses, so that it does not add to another operator's."""
    pa.array([])  # loads pandas the first time: amid a memo's entries its objects would keep the memo's memory
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    pin_batches(spark)
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as one identifier, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def as_bytes(column: pa.Array) -> list:
    """A string column as ``bytes`` (None stays)."""
    return column.cast(pa.large_binary()).to_pylist()


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[..., pa.Array]],
    uses: Sequence[str],
    into: str,
    kind: T.DataType,
    keep: Iterable[str] | None = None,
    held: bool = True,
) -> DataFrame:
    """Every row with a further column ``into``, computed batch by batch without a shuffle.

    ``make()`` runs once per task and returns a function from the used Arrow
    columns to the new one. ``keep`` names the input columns that stay (all of
    them by default; one called ``into`` gives way to the result). ``held``: as in ``task``; if not,
    what a batch took is given back after it, too.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    names = list(dict.fromkeys([*keep, *uses]))
    order = [names.index(c) for c in keep]
    used = [names.index(c) for c in uses]
    pin_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(into, kind)])
    arrow = to_arrow_type(kind)

    def run(batches):
        fn = None
        give_back()
        for batch in batches:
            fn = fn or make()
            out = fn(*(batch.column(i) for i in used))
            out = out if isinstance(out, pa.Array) else pa.array(out, arrow)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in order), out.cast(arrow)], names=[*keep, into]
            )
            if not held:
                batch = out = None
                give_back()
        fn = None
        give_back()

    return df.select(*map(col, names)).mapInArrow(task(run, held), schema)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts plus 64 a row: one aggregate that sizes partitions and blocks."""
    size = F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + F.lit(64)
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("s")).first()["s"])


# 64-bit hashing ------------------------------------------------------------

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * STEP
    x = x ^ (x >> np.uint64(32))
    x = x * STEP
    return x ^ (x >> np.uint64(32))


def make_room() -> None:
    """Let go of the tokenizer that an earlier task left in this worker: tasks of other operators need the memory."""
    pieces = sys.modules.get("plumbline.llm.pieces")
    if pieces is not None and pieces._KERNELS:
        pieces._KERNELS.clear()
        gc.collect()
    give_back()


def task(run: Callable, held: bool) -> Callable:
    """``run`` over a task's batches; if not ``held``, the tokenizer goes when the task ends.

    A held tokenizer saves the worker's next task its building. But every idle worker of an
    executor has one then, and there are more of them than tasks at a time.
    """

    def alone(batches):
        make_room()
        try:
            yield from run(batches)
        finally:
            make_room()

    return run if held else alone


class WordHash(dict):
    """Memo of 64-bit word hashes that forgets everything when it is full."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        make_room()
        self.limit = limit
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __del__(self):
        """An idle worker keeps nothing of it."""
        self.clear()
        with contextlib.suppress(Exception):  # the interpreter may be going down
            give_back()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.hash(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``size`` consecutive words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * MIX + h[i : i + n]
    return mixed(out + np.uint64(size))


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``size`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0
