"""Token ids of a corpus as files: one array of all ids, document boundaries in Elias-Fano code.

A folder holds, per part, ``*.ids`` (the ids of its documents one after another, 16 or 32 bits
each, nothing between them: a trainer can map the file) and ``*.bounds`` (where each document
ends, and the documents' names), and one ``manifest.json`` that lists the parts in order with
their sums. Parts are ranges of names, so the whole is in ascending order. A part's offsets are
relative to it; the manifest adds what comes before.

Reading and writing is a Spark data source (``token_ids``). Each task writes files of its own
name and reports them; the manifest, written last by the commit, names only the files of the
attempts that counted, so a lost executor or a repeated task leaves nothing that is read.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from plumbline.llm.common import as_bytes, col, pin_batches, text_bytes
from plumbline.llm.elias_fano import EliasFano
from plumbline.llm.word_ids import WordIds
from plumbline.session import work_path

MANIFEST = "manifest.json"
PART_BYTES = 128 << 20  # of texts; their ids take about half of it
READ_BYTES = 4 << 20  # ids of a batch that is read


def opened(path: str):
    """The file system and the path in it: local paths and any address that Arrow knows."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


class Names:
    """The documents' names of one part, in order: whole numbers in Elias-Fano code, others as they are."""

    @staticmethod
    def to_bytes(names: pa.Array) -> bytes:
        if pa.types.is_integer(names.type):
            known = names.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            least = int(known[0]) if len(known) else 0
            code = EliasFano.of((known - np.int64(least)).view(np.uint64)).to_bytes()
            return json.dumps({"nulls": names.null_count, "least": least}).encode() + b"\n" + code
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("name", names.type)])) as out:
            out.write_batch(pa.record_batch([names], names=["name"]))
        return b"\n" + sink.getvalue().to_pybytes()

    def __init__(self, raw: bytes, kind: pa.DataType):
        head, body = raw.split(b"\n", 1)
        self.kind, self.code, self.column = kind, None, None
        if head:
            found = json.loads(head)
            self.nulls, self.least, self.code = found["nulls"], found["least"], EliasFano.from_bytes(body)
        else:
            self.column = pa.ipc.open_stream(body).read_all().column(0).combine_chunks()

    def slice(self, start: int, stop: int) -> pa.Array:
        if self.column is not None:
            return self.column.slice(start, stop - start)
        lo, hi = max(start - self.nulls, 0), max(stop - self.nulls, 0)
        found = self.code.slice(lo, hi).view(np.int64) + np.int64(self.least)
        gap = pa.nulls((stop - start) - (hi - lo), pa.int64())
        return pa.concat_arrays([gap, pa.array(found, pa.int64())]).cast(self.kind)


@dataclass
class Part(WriterCommitMessage):
    place: int
    file: str
    docs: int
    tokens: int


class Writer(DataSourceArrowWriter):
    """Appends each batch's ids to the part's file; boundaries and names follow at its end."""

    def __init__(self, path: str, schema: T.StructType, width: int):
        self.path, self.schema, self.width = path, schema, width

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        name = f"part-{place:06d}-{uuid.uuid4().hex[:12]}"
        system, base = opened(self.path)
        sizes, names = [], []
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{name}.ids") as out:
            for batch in iterator:
                for raw in batch.column(1).to_pylist():
                    out.write(raw or b"")
                    sizes.append(len(raw or b"") // self.width)
                names.append(batch.column(0))
        if not sizes:
            system.delete_file(f"{base}/{name}.ids")
            return Part(place, "", 0, 0)
        ends = np.cumsum(np.array(sizes, np.uint64))
        code = EliasFano.of(ends).to_bytes()
        with system.open_output_stream(f"{base}/{name}.bounds") as out:
            out.write(np.array([len(code)], "<u8").tobytes() + code)
            out.write(Names.to_bytes(pa.concat_arrays(names)))
        return Part(place, name, len(sizes), int(ends[-1]))

    def commit(self, messages) -> None:
        """The manifest: a row a part, none a document."""
        parts = sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.place)
        listed, docs, tokens = [], 0, 0
        for m in parts:
            listed.append({"file": m.file, "docs": m.docs, "tokens": m.tokens, "first_doc": docs, "start": tokens})
            docs, tokens = docs + m.docs, tokens + m.tokens
        name = self.schema.fields[0]
        about = {"width": self.width, "id": name.name, "id_type": name.dataType.jsonValue(), "docs": docs, "tokens": tokens}
        system, base = opened(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MANIFEST}.new") as out:
            out.write(json.dumps({**about, "parts": listed}).encode())
        system.move(f"{base}/{MANIFEST}.new", f"{base}/{MANIFEST}")

    def abort(self, messages) -> None:
        """Without a manifest nothing is read; the files of finished tasks go."""
        system, base = opened(self.path)
        for m in messages:
            if m is not None and m.docs:
                for kind in ("ids", "bounds"):
                    system.delete_file(f"{base}/{m.file}.{kind}")


def manifest(path: str) -> dict:
    system, base = opened(path)
    with system.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


class TokenPart:
    """One part: any document's ids by one look into the boundaries and one read."""

    def __init__(self, path: str, part: dict, width: int):
        self.part, self.width = part, width
        system, base = opened(path)
        with system.open_input_stream(f"{base}/{part['file']}.bounds") as f:
            raw = f.read()
        size = int(np.frombuffer(raw, "<u8", 1)[0])
        self.ends, self.names = EliasFano.from_bytes(raw[8 : 8 + size]), raw[8 + size :]
        self.file = system.open_input_file(f"{base}/{part['file']}.ids")

    def bounds(self, start: int, stop: int) -> np.ndarray:
        """Where the documents from ``start`` to ``stop`` begin, and where the last one ends."""
        ends = self.ends.slice(start, stop).astype(np.int64)
        return np.concatenate([self.ends.select(start - 1).astype(np.int64) if start else [0], ends])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at places ``start`` to ``stop`` of the part."""
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((stop - start) * self.width), f"<u{self.width}")


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, packed: bool):
        self.path, self.schema, self.packed = path, schema, packed

    def partitions(self):
        about = manifest(self.path)
        return [InputPartition((p, about["width"])) for p in about["parts"]] or [InputPartition(None)]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.value is None:
            return
        part, width = partition.value
        schema = to_arrow_schema(self.schema)
        file = TokenPart(self.path, part, width)
        names = Names(file.names, schema.field(0).type)
        for lo in range(0, part["docs"], 1024):
            hi = min(lo + 1024, part["docs"])
            ends, at = file.bounds(lo, hi), 0
            while at < hi - lo:  # as many documents as fill a batch, one at least
                to = max(int(np.searchsorted(ends, ends[at] + READ_BYTES // 4, side="right")) - 1, at + 1)
                here = ends[at : to + 1]
                ids = file.ids(int(here[0]), int(here[-1])).astype("<u4")
                offsets = here - here[0]
                if self.packed:
                    bounds = pa.py_buffer((offsets * 4).astype(np.int32).tobytes())
                    column = pa.Array.from_buffers(pa.binary(), len(here) - 1, [None, bounds, pa.py_buffer(ids.tobytes())])
                else:
                    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(lo + at, lo + to),
                        pa.array(here[:-1] + part["start"], pa.int64()),
                        pa.array(np.diff(here), pa.int64()),
                        column.cast(schema.field(3).type),
                    ],
                    schema=schema,
                )
                at = to


class TokenIds(DataSource):
    """``spark.read.format("token_ids").load(path)``: name, ``start``, ``n_tokens``, ``ids``.

    ``start`` counts the ids of all documents before. Option ``packed`` gives ids as little-endian
    32-bit numbers in one binary, the default is a list. Writing takes the name and a binary of ids
    of ``width`` (option, 2 or 4) bytes each, ranges of names in partition order.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> T.StructType:
        about = manifest(self.options["path"])
        ids = T.BinaryType() if self.packed else T.ArrayType(T.IntegerType())
        name = T.StructField.fromJson({"name": about["id"], "type": about["id_type"], "nullable": True, "metadata": {}})
        return T.StructType(
            [name, T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", ids)]
        )

    @property
    def packed(self) -> bool:
        return self.options.get("packed", "false").lower() == "true"

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, self.packed)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, int(self.options.get("width", 4)))


def encoded(docs: DataFrame, model: bytes, end: int | None, text: str, id: str) -> DataFrame:
    """``(id, ids)``: packed ids of every text as the library gives them, the end id behind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType
    pin_batches(docs.sparkSession)

    def run(batches):
        words = None
        for batch in batches:
            words = words or WordIds(shared.value)
            tail = b"" if end is None else words.pack([end])
            found = [x + tail for x in words.texts(as_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "ids"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType())])
    return docs.select(col(id), col(text).cast("string")).mapInArrow(run, schema)


def write_token_ids(
    docs: DataFrame,
    model: bytes,
    path: str,
    end: int | None = None,
    text: str = "text",
    id: str = "doc_id",
    part_bytes: int = PART_BYTES,
) -> str:
    """Write the ids of all documents as token files in ascending order of their names.

    ``model`` is the JSON of a ``tokenizers`` tokenizer; its post-processor adds nothing and special
    strings in texts are handled as the library does by default. ``end`` is an id put behind every
    document. Texts are dealt over parts of about ``part_bytes`` by ranges of names, and encoded
    once, where they are written; names that many rows share, nulls too, are divided among parts.
    The names are of any type that has an order.

    Null texts are empty ones; rows without a name come first; rows of one name follow each other
    in the order of a hash of their texts, repeated rows each by itself. An empty table gives a
    manifest without parts. Only the two columns are read. A document's ids are one row, as its
    text is. Returns ``path``.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    width = WordIds(model, 1 << 20).kind.itemsize
    named = docs.select(col(id).alias("id"), col(text).cast("string").alias("text"))
    keyed = named.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("row")]
    parts = max(1, math.ceil(text_bytes(named) / part_bytes))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = encoded(dealt, model, end, "text", "id").withColumnRenamed("id", id)
    rows.write.format("token_ids").option("width", width).mode("append").save(path)
    return path


def read_token_ids(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Documents of a folder of token files: name, ``start``, ``n_tokens``, ``ids``."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("packed", str(packed).lower()).load(path)


def documents_from_files(docs: DataFrame, model: bytes, end: int | None = None, packed: bool = True) -> DataFrame:
    """The documents' ids, written to new files in the shared folder and read back."""
    path = write_token_ids(docs, model, work_path(docs.sparkSession, "token-files"), end)
    return read_token_ids(docs.sparkSession, path, packed)
