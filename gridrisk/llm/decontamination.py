"""Benchmark decontamination by SimHash windows.

Every benchmark item has a 64-bit SimHash of its 5-word shingles, whose votes weigh as much as in the verification;
shingles of a document that no item holds don't vote. A document's windows have the size of an item, one
for each item size and each place; their SimHashes come from running sums of shingle votes. A multi-index over BLOCKS
blocks of bits finds every item whose fingerprint lies within RADIUS of a window's: with RADIUS errors over BLOCKS
blocks, some block has at most RADIUS // BLOCKS of them, and each block's table lists the items for every value within
that many bits. Candidates are verified exactly: the weighted share of the item's shingles that the window holds, a
shingle weighing 1 / (number of items with it), must reach ``similarity``. The number of items is counted once over the
whole benchmark, so results don't depend on the blocks.

A window that holds none of an item's shingles has similarity 0, so windows are only laid where a shingle of some item
occurs: that leaves out nothing that could be verified. Spark tasks turn the benchmark into a stored table of items with
their shingles and weights, in blocks of about ``items_per_block`` items; each block is broadcast, its tables are built
in the tasks, and it is matched against all documents.

Words are lower-cased and lose marks at their ends. Items of fewer than five words are one shingle of their whole
length. Defined results: null, empty and blank texts match nothing, as items or as documents; equal items all match;
repeated documents each match; each (document, item) gives its best window, the earliest of equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import in_arrow, stored
from gridrisk.llm.text import Hashes, windows, word_hashes

WIDTH, RADIUS, BLOCKS = 5, 20, 7
BITS_PER_BLOCK = 9
MARKS = b".,;:!?*#$%&\"'()[]|<>~"
SCHEMA = "item_id long, start_word int, n_words int, hamming int, similarity double"


class Normalised(Hashes):
    """Hashes of words without marks at their ends."""

    def __missing__(self, word: bytes) -> int:
        h = super().__missing__(word.strip(MARKS) or word)
        self[word] = h
        return h


def normal_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def votes(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's 64 votes, +1 or -1."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


#: Weights in votes are whole multiples of 1 / UNIT, so that running sums are exact.
UNIT = 1 << 20


def parts(weights: np.ndarray) -> np.ndarray:
    return np.maximum(np.rint(weights * UNIT), 1).astype(np.int64)


def packed(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 sums to fingerprints."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items of one shingle width, indexed."""

    width: int
    ids: np.ndarray
    sizes: np.ndarray  # words
    prints: np.ndarray
    shingles: list[np.ndarray]
    weights: list[np.ndarray]
    every: np.ndarray  # sorted distinct shingles
    power: np.ndarray  # their weights
    filter: np.ndarray  # which top 20 bits of a shingle occur
    tables: dict[int, tuple]  # by size: the items' places, and blocks x values x items, within RADIUS // BLOCKS bits of the item's block
    least: dict[int, int]  # by size: shingles of items that a window needs to hold one of them


def least_held(weights: np.ndarray, similarity: float) -> int:
    """How many shingles of these weights it takes at least to reach the similarity."""
    reached = np.cumsum(np.sort(weights)[::-1])
    return int(np.searchsorted(reached, similarity * reached[-1] - 1e-9)) + 1


def build_items(rows: list, width: int, similarity: float) -> Items | None:
    """rows: items of a width, as item_rows gives them, with the list of weights of their distinct shingles."""
    kept = [r for r in rows if r["width"] == width]
    if not kept:
        return None
    lists = [np.frombuffer(r["shingles"], "<u8") for r in kept]
    shingles = [np.unique(x) for x in lists]
    weights = [np.asarray(r["weights"], float) for r in kept]
    every, first = np.unique(np.concatenate(shingles), return_index=True)
    power = np.concatenate(weights)[first]
    prints = np.concatenate([packed((votes(x) * parts(power[np.searchsorted(every, x)])[:, None]).sum(0, keepdims=True)) for x in lists])
    values = np.arange(1 << BITS_PER_BLOCK)
    slack = RADIUS // BLOCKS
    near = [sum(1 << b for b in flips) for k in range(slack + 1) for flips in combinations(range(BITS_PER_BLOCK), k)]
    tables = np.zeros((BLOCKS, len(values), len(kept)), bool)
    for block in range(BLOCKS):
        own = (prints >> np.uint64(block * BITS_PER_BLOCK)).astype(np.int64) & (len(values) - 1)
        for flip in near:
            tables[block, own ^ flip, np.arange(len(kept))] = True
    marks = np.zeros(1 << 20, bool)
    marks[(every >> np.uint64(44)).astype(np.int64)] = True
    sizes = np.array([r["n_words"] for r in kept])
    by_size = {int(size): (at := np.flatnonzero(sizes == size), np.ascontiguousarray(tables[:, :, at])) for size in np.unique(sizes)}
    least = {size: min(least_held(weights[k], similarity) for k in at) for size, (at, _) in by_size.items()}
    return Items(width, np.array([r["item_id"] for r in kept]), sizes, prints, shingles, weights, every, power, marks, by_size, least)


#: Places of item shingles that are looked at together.
HITS = 4_096


def match(items: Items, shingles: np.ndarray, hits: np.ndarray, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Best windows per item: (item place, start, words, Hamming distance, similarity). hits: where shingles of items are,
    in order. Running sums have a row for each hit, not each word, and hits are taken HITS at a time with their
    surroundings, so a text of any length needs memory in proportion to its shingles only."""
    spans = {size: min(size - items.width + 1, len(shingles)) for size in items.tables}  # shingles in a window, or in all of a shorter text
    widest, last = max(spans.values()), dict.fromkeys(spans, -1)
    best: dict[int, tuple] = {}
    for at in range(0, len(hits), HITS):
        some = hits[at : at + HITS]
        around = hits[np.searchsorted(hits, some[0] - widest) : np.searchsorted(hits, some[-1] + widest + 1)]
        each = parts(items.power[np.searchsorted(items.every, shingles[around])])
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(votes(shingles[around]) * each[:, None], 0)])
        for size, span in spans.items():
            starts = np.unique((some[:, None] - np.arange(span)).ravel())
            starts = starts[(starts > last[size]) & (starts >= 0) & (starts + span <= len(shingles))]
            if not len(starts):
                continue
            last[size] = int(starts[-1])
            for few in np.array_split(starts, max(1, len(starts) // 4096)):
                low, high = np.searchsorted(around, few), np.searchsorted(around, few + span)
                enough = high - low >= items.least[size]  # other windows can't be verified
                prints = packed(sums[high[enough]] - sums[low[enough]])
                _weigh(items, size, shingles, few[enough], span, prints, similarity, best)
    return [best[k] for k in sorted(best)]


def _weigh(items: Items, size: int, shingles: np.ndarray, starts: np.ndarray, span: int, prints: np.ndarray, similarity: float, best: dict[int, tuple]) -> None:
    """Puts the windows at starts that hold an item of this size into best."""
    of_size, tables = items.tables[size]
    found = np.zeros((len(starts), len(of_size)), bool)
    for block in range(BLOCKS):
        value = (prints >> np.uint64(block * BITS_PER_BLOCK)).astype(np.int64) & ((1 << BITS_PER_BLOCK) - 1)
        found |= tables[block][value]
    at, which = np.nonzero(found)
    far = np.bitwise_count(prints[at] ^ items.prints[of_size[which]])
    for a, w, d in zip(at[far <= RADIUS], which[far <= RADIUS], far[far <= RADIUS], strict=True):
        item, start = int(of_size[w]), int(starts[a])
        held = np.isin(items.shingles[item], shingles[start : start + span])
        share = float((items.weights[item] * held).sum() / items.weights[item].sum())
        if share >= similarity - 1e-12 and (item not in best or (-share, start) < (-best[item][4], best[item][1])):
            best[item] = (item, start, span + items.width - 1, int(d), share)


def item_rows(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, width (WIDTH, or the number of words of shorter items), n_words, shingles (all, as
    little-endian bytes) and kinds (the distinct ones, by value as unsigned numbers)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Normalised()
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := normal_words(text.as_py()):
                    width = min(len(words), WIDTH)
                    shingles = windows(word_hashes(words, known), width).astype("<u8")
                    out.append((key, width, len(words), shingles.tobytes(), np.unique(shingles).astype(np.int64).tolist()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "width", "n_words", "shingles", "kinds"])

    source = benchmark.select(F.col("item_id").cast("long"), "text")
    return in_arrow(source, cut, "item_id long, width int, n_words int, shingles binary, kinds array<long>")


def weighted_items(benchmark: DataFrame, items_per_block: int) -> DataFrame:
    """A stored table of item_rows with weights, 1 / (number of items of the benchmark with the shingle) in the order of
    kinds, and block."""
    cut = stored(item_rows(benchmark).withColumn("row", F.monotonically_increasing_id()), "items")
    each = cut.select("row", "width", F.posexplode("kinds").alias("at", "kind"))
    df = each.groupBy("width", "kind").agg(F.count("*").alias("df"))
    pairs = each.join(df, ["width", "kind"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", (1 / F.col("df")).alias("weight")))).alias("weights"))
    blocks = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-cut.count() // items_per_block))))
    return stored(cut.drop("kinds").join(pairs, "row").select("item_id", "width", "n_words", "shingles", F.col("weights.weight").alias("weights"), blocks.alias("block")), "weighted-items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, items_per_block: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that the document holds: the id, item_id, the window, its Hamming
    distance and similarity. benchmark: item_id, text; its items come to the tasks in blocks of about items_per_block."""
    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, {SCHEMA}"
    items = weighted_items(benchmark, items_per_block)
    blocks = sorted(r["block"] for r in items.select("block").distinct().collect())
    found = [_match_block(source, items.where(F.col("block") == b).orderBy("item_id", "shingles").collect(), similarity, schema) for b in blocks]
    return reduce(DataFrame.unionByName, found or [_match_block(source, [], similarity, schema)])


def _match_block(source: DataFrame, rows: list, similarity: float, schema: str) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [x for width in range(1, WIDTH + 1) if (x := build_items(shared.value, width, similarity))]
        known = Normalised()
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                hashes = word_hashes(words, known) if (words := normal_words(text.as_py())) else None
                for items in built if words else ():
                    shingles = windows(hashes, items.width)
                    maybe = np.flatnonzero(items.filter[(shingles >> np.uint64(44)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(items.every, shingles[maybe]), len(items.every) - 1)
                    hits = maybe[items.every[place] == shingles[maybe]]
                    if len(hits):
                        out += [(key.as_py(), int(items.ids[i]), *rest) for i, *rest in match(items, shingles, hits, similarity)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (batch.schema.types[0], pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            names = [batch.schema.names[0], "item_id", "start_word", "n_words", "hamming", "similarity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return in_arrow(source, search, schema)
