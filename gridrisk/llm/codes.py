"""Product codes of vectors: a codebook for each part of a vector, and each part's nearest entry as a code.

Vectors become whole numbers and are cut into equal parts. Codebooks start from the vectors of the smallest ids and are
improved in rounds: tasks assign their rows' parts through a tree over the codebook's entries (``gnat``) and add up whole
components and counts per entry, Spark adds up what tasks found, and the driver gets one row per entry and component. All
sums are of longs, so codes don't depend on how rows are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import in_arrow, stored, with_group
from gridrisk.llm.gnat import Gnat
from gridrisk.llm.vectors import usable, vector_of, whole


def _parts(batch: pa.RecordBatch, dims: int, parts: int) -> np.ndarray:
    return whole(batch.column("vector"), dims).reshape(batch.num_rows, parts, dims // parts)


def _sums(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Component sums and counts of the parts nearest to each entry: long (parts, entries, width + 1)."""
    n_parts, n_entries, width = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, total = [Gnat(b) for b in books], np.zeros((n_parts, n_entries, width + 1), np.int64)
        for batch in batches:
            cut = _parts(batch, n_parts * width, n_parts)
            for j, tree in enumerate(trees):
                code, _ = tree.nearest(cut[:, j])
                np.add.at(total[j], code, np.column_stack([cut[:, j], np.ones(len(cut), np.int64)]))
        where = np.nonzero(np.repeat(total[:, :, -1:] > 0, width + 1, axis=2))
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in where], pa.array(total[where])], ["part", "entry", "place", "total"])

    found = in_arrow(rows.select("vector"), task, "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    total = np.zeros((n_parts, n_entries, width + 1), np.int64)
    for r in found.collect():  # one row per codebook entry and component
        total[r.part, r.entry, r.place] = r.total
    return total


def improved(books: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Each entry's componentwise floor of the mean; entries that no part is nearest to stay."""
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)


def learn_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks long (parts, entries, width) of rows (id, vector); of as many entries as there are rows, if fewer. All
    rows' vectors must be as long as the first's."""
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries)
    start = first.toArrow().combine_chunks()
    if not start.num_rows:
        return np.zeros((parts, 0, 1), np.int64)
    dims = len(start["vector"][0])
    books = whole(start["vector"].combine_chunks(), dims).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = improved(books, _sums(rows, books))
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (id, label, vector) as id, label, code, error: a code is a hex pair per part, so at most 256 entries."""
    n_parts, _, width = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books if len(b)]  # without entries there are no rows
        for batch in batches:
            cut = _parts(batch, n_parts * width, n_parts)
            code, error = np.empty((len(cut), n_parts), np.uint8), np.zeros(len(cut), np.int64)
            for j, tree in enumerate(trees):
                index, gap = tree.nearest(cut[:, j])
                code[:, j], error = index, error + gap
            text = code.tobytes().hex()
            codes = [text[k : k + 2 * n_parts] for k in range(0, len(text), 2 * n_parts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("id", "label")}
    return in_arrow(rows, task, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per usable vector: id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty, or holds null or non-finite components drop out, and so do rows whose vector isn't as
    long as that of the smallest id, or can't be cut into equal parts. Rows without an id come last when codebooks start;
    of rows that share an id the lesser vector comes first. Repeated rows are coded each. Components are kept within
    ``vectors.bits``; a sum of errors that no long holds is null. Null labels are one group. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code names one of at most 256 entries")
    rows = df.where(usable(vector_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector_of(df, vector_col).alias("vector"))
    least = rows.select("id", F.size("vector").alias("dims"), "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).select("dims").first()
    dims = least.dims if least and least.dims % parts == 0 else 0
    rows = rows.where(F.size("vector") == dims)
    books = learn_codebooks(rows, parts, entries, rounds)
    coded = stored(encode(rows, books), "codes")
    sums = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "code-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_group(coded, sums, ["label"], "rows", coded.count()).drop("rows").withColumn("codebooks_sha256", F.lit(digest))
