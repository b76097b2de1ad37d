"""Split payloads into chunks, map the chunks in parallel, put them together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def chunk_payload(df: DataFrame, payload: str, chunks: int) -> DataFrame:
    """Cut BINARY payloads into equal chunks (offset, chunk); an empty payload is one empty chunk.

    An empty tail drops out, and so do null payloads.
    """
    length = F.octet_length(payload)
    size = F.ceil(length / chunks).cast("int")
    offsets = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.greatest(size, F.lit(1)))).when(
        length == 0, F.array(F.lit(0))
    )
    rest = [c for c in df.columns if c != payload]
    cut = df.select(*rest, payload, size.alias("__size"), length.alias("total_size"), F.explode(offsets).alias("offset"))
    chunk = F.substring(F.col(payload), F.col("offset") + 1, F.col("__size"))
    return cut.select(*rest, "total_size", "offset", chunk.alias("chunk"))


def xor_chunk(key: bytes):
    """XOR with a repeating key, lined up by the chunk's offset; its own inverse."""
    pattern = np.frombuffer(key, dtype=np.uint8)

    @F.pandas_udf(BinaryType())
    def apply(chunks: pd.Series, offsets: pd.Series) -> pd.Series:
        out = []
        for chunk, offset in zip(chunks, offsets):
            codes = np.frombuffer(chunk, dtype=np.uint8)
            shifted = np.resize(np.roll(pattern, -(offset % len(pattern))), len(codes))
            out.append((codes ^ shifted).tobytes())
        return pd.Series(out)

    return apply


def map_chunks(chunks: DataFrame, key: bytes) -> DataFrame:
    return chunks.withColumn("chunk", xor_chunk(key)("chunk", "offset"))


def reassemble(chunks: DataFrame, by: str) -> DataFrame:
    """Join the chunks of each payload by offset; null payload if any is missing.

    A payload has as many chunks as it was cut into, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "chunk")))
    grouped = chunks.groupBy(by).agg(parts.alias("parts"), F.max("total_size").alias("total_size"))

    sizes = F.transform("parts", lambda p: F.octet_length(p["chunk"]))
    follows = F.forall(
        F.sequence(F.lit(0), F.size("parts") - 1),
        lambda i: F.get("parts", i)["offset"]
        == F.when(i == 0, F.lit(0)).otherwise(F.get("parts", i - 1)["offset"] + F.octet_length(F.get("parts", i - 1)["chunk"])),
    )
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n)
    complete = follows & (total == F.col("total_size"))
    # The chunks are joined once, as hex, since Spark joins strings only.
    data = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["chunk"])), ""))
    told = grouped.withColumn("complete", complete)
    return told.select(by, "complete", F.when(F.col("complete"), data).alias("payload"))
