"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the row). Splitters are found by counting, in a few distributed passes
over a narrow key table, the exact bytes and rows below candidate boundaries: each pass refines the cells in which a
splitter still lies. Only cell counts reach the driver, at most 4,096 for the first pass and 256 for each open splitter
afterwards. Then whole rows cross the network once, to the piece that their key falls into.

Equal texts are neighbours in this order. A splitter falls between two texts wherever that keeps the shards within
``tolerance``; only a group of equal texts that outweighs the tolerance by itself is cut, by the hash of the row.

Defined results: a null text has no bytes; rows equal in every column are one unit that stays together; an empty table
gives no rows; columns of the caller named ``size``, ``law``, ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import fresh_name, hashable, stored, without

LOW, HIGH = -(1 << 63), (1 << 63) - 1
FIRST_SHIFT, STEP = 52, 8


@dataclass(frozen=True)
class Edge:
    """A splitter: rows with key >= (text_hash, row_hash) lie at or above it; what lies below it is counted exactly."""

    text_hash: int
    row_hash: int
    bytes_below: int
    rows_below: int


@dataclass(frozen=True)
class Cell:
    """Where a splitter still lies: rows of ``text_hash`` (None: any) whose level column has this prefix at shift."""

    text_hash: int | None
    prefix: int | None
    shift: int
    bytes_below: int
    rows_below: int


def _edge(cell: Cell, sub: int, shift: int, nbytes: int, rows: int) -> Edge:
    start = sub << shift
    if cell.text_hash is None:
        return Edge(start, LOW, nbytes, rows) if start <= HIGH else Edge(HIGH, HIGH, nbytes, rows)
    if start <= HIGH:
        return Edge(cell.text_hash, start, nbytes, rows)
    return Edge(cell.text_hash + 1, LOW, nbytes, rows) if cell.text_hash < HIGH else Edge(HIGH, HIGH, nbytes, rows)


def _histogram(keys: DataFrame, by_row: bool, shift: int, cells: list[Cell]) -> dict:
    """Exact bytes and rows of the sub-cells of all open cells of one level."""
    column = F.col("r") if by_row else F.col("h")
    if by_row:
        parts = [(F.col("h") == c.text_hash) & (F.lit(c.prefix is None) | (F.shiftright(column, shift + STEP) == (c.prefix or 0))) for c in cells]
        keys = keys.where(_any(parts))
    elif cells[0].prefix is not None:
        keys = keys.where(F.shiftright(column, shift + STEP).isin([c.prefix for c in cells]))
    found = keys.groupBy((F.col("h") if by_row else F.lit(0).cast("long")).alias("g"), F.shiftright(column, shift).alias("sub")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("least"), F.max("h").alias("most")
    )
    out: dict = {}
    for row in found.collect():
        group = (row["g"] if by_row else None, None if shift == FIRST_SHIFT else row["sub"] >> STEP)
        out.setdefault(group, []).append(row)
    return {k: sorted(v, key=lambda r: r["sub"]) for k, v in out.items()}


def _any(parts: list[Column]) -> Column:
    while len(parts) > 1:
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def find_splitters(keys: DataFrame, pieces: int, tolerance: float, group_tolerance: float) -> list[Edge]:
    """pieces - 1 splitters of the key table (h, r, size); tolerances are shares of a piece's bytes."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    near, group_near = total / pieces * tolerance, total / pieces * group_tolerance
    done: dict[int, Edge] = {}
    open_cells = {k: Cell(None, None, FIRST_SHIFT, 0, 0) for k in range(1, pieces)} if total else {}
    while open_cells:
        levels: dict[tuple[bool, int], set[Cell]] = {}
        for cell in open_cells.values():
            levels.setdefault((cell.text_hash is not None, cell.shift), set()).add(cell)
        counts = {level: _histogram(keys, *level, sorted(cells, key=lambda c: c.bytes_below)) for level, cells in levels.items()}
        narrower: dict[int, Cell] = {}
        for k, cell in open_cells.items():
            by_row, shift = cell.text_hash is not None, cell.shift
            target, nbytes, rows = total * k / pieces, cell.bytes_below, cell.rows_below
            for sub in counts[by_row, shift][cell.text_hash, cell.prefix]:
                if nbytes + sub["bytes"] > target:
                    break
                nbytes, rows = nbytes + sub["bytes"], rows + sub["rows"]
            below, above = target - nbytes, nbytes + sub["bytes"] - target
            one_text, last = not by_row and sub["least"] == sub["most"], by_row and shift == 0
            limit = group_near if one_text else float("inf") if last or sub["rows"] == 1 else near
            if min(below, above) <= limit:
                low = below <= above
                done[k] = _edge(cell, sub["sub"] + (not low), shift, nbytes + (0 if low else sub["bytes"]), rows + (0 if low else sub["rows"]))
            elif one_text:
                narrower[k] = Cell(sub["least"], None, FIRST_SHIFT, nbytes, rows)
            else:
                narrower[k] = Cell(cell.text_hash, sub["sub"], max(shift - STEP, 0) if shift != FIRST_SHIFT else FIRST_SHIFT - STEP, nbytes, rows)
        open_cells = narrower
    return [done.get(k, Edge(HIGH, HIGH, 0, 0)) for k in range(1, pieces)]


def _piece(h: Column, r: Column, edges: list[Edge], first: int = 0) -> Column:
    """How many edges lie at or below the key, as a balanced tree of comparisons."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    e = edges[mid]
    at_or_above = (h > e.text_hash) | ((h == e.text_hash) & (r >= e.row_hash))
    return F.when(at_or_above, _piece(h, r, edges[mid + 1 :], first + mid + 1)).otherwise(_piece(h, r, edges[:mid], first))


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, text_col: str = "text", pieces_per_shard: int = 4, tolerance: float = 0.002, group_tolerance: float = 0.02) -> DataFrame:
    """docs with ``size`` (UTF-8 bytes + 8), ``law`` ('bytes'), ``shard`` (0 to n_shards - 1, near-equal bytes) and
    ``slot`` (gapless from 0 in each shard, in key order). Each shard is made by ``pieces_per_shard`` tasks."""
    docs = without(docs, "size", "law", "shard", "slot")
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    h, r = F.xxhash64(text), F.xxhash64(*hashable(docs))
    pieces = n_shards * pieces_per_shard
    keys = stored(docs.select(h.alias("h"), r.alias("r"), size.alias("size")), "shard-keys")
    edges = find_splitters(keys, pieces, tolerance, group_tolerance)
    below = [0, *(e.rows_below for e in edges)]
    offsets = [below[p] - below[p - p % pieces_per_shard] for p in range(pieces)]
    hc, rc, pc = (fresh_name(docs, n) for n in ("text_hash", "row_hash", "piece"))
    keyed = docs.withColumns({hc: h, rc: r, "size": size})
    dealt = keyed.withColumn(pc, _piece(F.col(hc), F.col(rc), edges)).repartitionById(pieces, F.col(pc)).sortWithinPartitions(hc, rc)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col(pc) + 1)
    return dealt.withColumns({"law": F.lit("bytes"), "shard": F.floor(F.col(pc) / pieces_per_shard).cast("int"), "slot": place + base}).drop(hc, rc, pc)
