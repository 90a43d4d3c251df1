"""Quality classifier: gradient-boosted trees over statistics of whole texts.

The forest is fitted on at most ``most_labels`` labelled rows, those with the least hash of their id among the rows of
the learning fold; scoring covers every row. Labels, language, source and id are no inputs.

Defined results: null texts are empty; an empty text has all-zero statistics and gets a score like any other; null
labels and labels of other ids are ignored; without labels of both kinds every score is the prior; repeated rows are
scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.llm import boosting
from gridrisk.llm.common import fresh_name, in_arrow, without

STATISTICS = (
    "chars", "words", "word_length", "longest_word", "distinct_words", "repeats", "upper", "digits", "marks", "loud_marks", "bars", "bangs",
    "stops", "lines", "line_length", "distinct_lines", "wide_bytes", "ended", "entropy", "blanks",
)


def _classes() -> np.ndarray:
    """Which bytes each of the counted classes holds, as a 256 x 8 matrix."""
    groups = [range(65, 91), range(48, 58), [b for b in range(33, 127) if not chr(b).isalnum()], b"$%&*#@^~<>{}[]\\", b"|", b"!", b".,;:?", range(128, 256)]
    out = np.zeros((256, len(groups)))
    for k, group in enumerate(groups):
        out[list(group), k] = 1
    return out


def statistics(text: str | None, classes: np.ndarray) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(len(STATISTICS))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digits, marks, loud, bars, bangs, stops, wide = counts @ classes
    words, lines = raw.split(), raw.split(b"\n")
    n, w, k = len(raw), max(1, len(words)), len(lines)
    share = counts[counts > 0] / n
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return np.array([
        n, len(words), n / w, max(map(len, words), default=0), len(set(words)) / w, repeats / w, upper / n, digits / n, marks / w, loud / w,
        bars / w, bangs / w, stops / w, k, n / k, len(set(lines)) / k, wide / n, sum(x.endswith(b".") for x in lines) / k,
        -(share * np.log2(share)).sum(), counts[32] / n,
    ])


def with_statistics(docs: DataFrame, text: Column, keys: list[str], out: str) -> DataFrame:
    """The key columns and ``out``: the statistics of text as an array of doubles."""
    source = docs.select(*[F.col(f"`{k}`") for k in keys], text.alias(out))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in batches:
            texts = batch.column(len(keys))
            rows = [statistics(t.as_py(), classes) for t in texts]
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, flat)], names=schema.names)

    return in_arrow(source, measure, schema)


def fit_quality(measured: DataFrame, labels: DataFrame, most_labels: int = 20_000, **params) -> boosting.Forest:
    """measured: doc_id and stats. labels: doc_id and a 0/1 ``label``. An id that is measured or labelled more than
    once counts once, with its least statistics."""
    known = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = measured.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(most_labels).toPandas().drop_duplicates("doc_id")
    x = np.stack(rows["stats"].to_numpy()) if len(rows) else np.zeros((0, len(STATISTICS)))
    return boosting.fit(x, rows["label"].to_numpy(float), **params)


def score_quality(docs: DataFrame, forest: boosting.Forest, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with ``out``, the probability of label 1, from one pass over the texts. A column named so is replaced."""
    docs = without(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    place = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in batches:
            rows = [statistics(t.as_py(), classes) for t in batch.column(place)]
            x = np.stack(rows) if rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(x))], names=schema.names)

    return in_arrow(docs, score, schema)


def learn_quality(docs: DataFrame, labels: DataFrame, learning: Column, most_labels: int = 20_000) -> boosting.Forest:
    """Fits on the labelled documents of the learning fold. labels: doc_id, label. Texts of other rows are not read in
    Python: the labelled ids are joined first."""
    fold = labels.where(learning).where(F.col("label").isin(0, 1)).select("doc_id", "label")
    chosen = fold.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    name = fresh_name(docs, "chosen")
    few = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias(name))), F.col("doc_id") == F.col(name), "left_semi")
    return fit_quality(with_statistics(few, F.col("text"), ["doc_id"], "stats"), fold, most_labels)
