"""Token counts by a finite-state tokenizer.

The tokenizer is compiled, as it meets words, into a deterministic transducer whose
transitions carry the number of tokens they emit (``pieces.Transducer``). Texts above
a chunk's size are cut anywhere; each chunk maps the machine's boundary states at its
start to those at its end, with the tokens emitted between, and these maps compose by
a prefix scan (``token_chunks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import token_chunks as C
from plumbline.llm.common import as_bytes, col, fresh, map_rows, quoted
from plumbline.llm.pieces import counts_of


def read_model(path: str) -> bytes:
    """A model file's bytes, read where the job is started (about half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def longest_text(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.max(F.octet_length(col(text))), F.lit(0)).alias("n")).first()["n"]


def token_counts(
    docs: DataFrame,
    model: bytes,
    text: str = "text",
    into: str = "n_tokens",
    chunk: int = C.CHUNK,
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents with the number of tokens of their whole text, as the library counts them.

    No begin, end or special tokens; special strings in a text are ordinary text; nothing is cut
    off. Texts of at most ``chunk`` bytes are counted where they are; chunks of longer ones are
    dealt over the cluster, and only their maps come together, 64 at a time. Equal long texts are
    counted once. A run of spaces is never cut, so one that is longer than a chunk makes a longer
    chunk.

    Null and empty texts have 0 tokens. Rows are counted one by one, repeated rows each; null ids
    and further columns pass through (a column named ``into`` is replaced).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    digest = fresh(docs, "digest")
    giant = F.octet_length(col(text)) > chunk
    longest = longest_text(docs, text)

    def make():
        counts = counts_of(shared.value)
        return lambda texts: [counts.text(x, True) if x else 0 for x in as_bytes(texts)]

    whole = docs.where(F.coalesce(~giant, F.lit(True)))
    out = map_rows(whole, make, [text], into, T.LongType(), keep=keep)
    if longest <= chunk:
        return out
    named = docs.where(giant).withColumn(digest, F.sha2(col(text).cast("binary"), 256))
    chunks = C.chunked(named, text, digest, shared, chunk)
    found = C.totals(C.transferred(chunks, shared, with_counts=True), C.most_chunks(longest, chunk))
    found = found.select(F.col("digest").alias(digest), F.col("n_tokens").alias(into))
    rows = named.select(*map(col, keep), digest).join(found, digest, "left")
    return out.unionByName(rows.select(*map(col, keep), quoted(into)))
