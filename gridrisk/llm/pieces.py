"""SentencePiece encoding and decoding.

``sample_pieces`` draws a segmentation of every text from the piece lattice: forward filtering sums the weights of all
paths to each place, backward sampling walks from the end and picks each last piece by its share. A piece of vocabulary
rank k weighs ``(k + 2) ** -theta``. The draws come from a counter-based generator keyed by the row's key, the chunk and
the step, so a row gets the same segmentation in any partitioning and after any retry.

No piece spans a boundary between a word and the blank before the next word, so the lattice of a text is a chain of
lattices of its chunks (blanks and the word behind them); each distinct chunk of a block of texts is filtered once, all
chunks together place by place, and all are sampled together step by step, with numpy.

Decoding is lossless for every text: a blank is put before the text as the model asks, characters without a piece go
through byte pieces, and so does a literal U+2581, which would otherwise decode as a blank.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows are sampled alike.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.llm.common import fresh_name, in_arrow, without
from gridrisk.llm.text import GOLD, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK = re.compile(r" *[^ ]+| +")
#: Rank of pieces that the model marks as given by the user, such as runs of blanks.
GIVEN_RANK = 1000


#: Units of a lattice are characters that are pieces, by code point, and the bytes of all others, from here on.
BYTE_UNITS = 0x110000
TABLE_BITS = 20
#: Bits of a draw and of a cumulated share.
SHARE_BITS = 32


def _hashed(units: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Hash of a run of units, one unit further than before."""
    with np.errstate(over="ignore"):
        return (units.astype(np.uint64) + np.uint64(1)) * GOLD if before is None else mixed(before) * GOLD + units.astype(np.uint64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Model:
    """Pieces with blanks for U+2581: by hash of their units the ids, by id the weights and bytes."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []
        found: list[tuple[list[int], int, float]] = []
        for i in range(own.vocab_size()):
            piece, score = own.id_to_piece(i), own.get_score(i)
            weight = -theta * math.log((-score if score > -1e8 else GIVEN_RANK) + 2)
            if own.is_byte(i):
                self.raw.append(bytes([int(piece[1:-1], 16)]))
                found.append(([BYTE_UNITS + self.raw[-1][0]], i, 0.0))
            elif own.is_control(i) or own.is_unknown(i):
                self.raw.append(b"")
            else:
                piece = piece.replace(BLANK, " ")
                self.raw.append(piece.encode())
                found.append(([ord(c) for c in piece], i, weight))
        self.longest = max(len(units) for units, _, _ in found)
        self.single = np.array(sorted(units[0] for units, _, _ in found if len(units) == 1 and units[0] < BYTE_UNITS))
        hashes = np.empty(len(found), np.uint64)
        self.begins = np.zeros(1 << TABLE_BITS, bool)  # of slots that some piece's beginning falls into
        sizes = np.array([len(units) for units, _, _ in found])
        for size in range(1, self.longest + 1):
            own_size, h = np.flatnonzero(sizes == size), None
            grid = np.array([found[k][0] for k in own_size], np.int64).reshape(-1, size)
            for column in grid.T:
                h = _hashed(column, h)
                self.begins[_slot(mixed(h))] = True
            hashes[own_size] = mixed(h)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([i for _, i, _ in found], np.int32)[order]
        self.weights = np.array([w for _, _, w in found])[order]
        # By slot the place of its piece, or -1; pieces that share a slot are looked up by bisection.
        slots = _slot(self.hashes)
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.table[slots] = np.arange(len(slots))
        self.crowded = np.zeros(1 << TABLE_BITS, bool)
        self.crowded[slots[1:][slots[1:] == slots[:-1]]] = True

    def places(self, hashes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of hashes are pieces, and their places."""
        place = self.table[slots]
        maybe = np.flatnonzero(place >= 0)
        place = place[maybe]
        if len(crowd := np.flatnonzero(self.crowded[slots[maybe]])):
            place[crowd] = np.minimum(np.searchsorted(self.hashes, hashes[maybe[crowd]]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[maybe]
        return maybe[hit], place[hit]

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "surrogatepass")

    def units(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of all chunks one after another, and how many each has."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        place = np.minimum(np.searchsorted(self.single, codes), len(self.single) - 1)
        odd = np.flatnonzero(self.single[place] != codes)
        if len(odd):
            kinds, which = np.unique(codes[odd], return_inverse=True)
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in kinds]
            wide = np.ones(len(codes), np.int64)
            wide[odd] = np.array([len(r) for r in raw])[which]
            ends = np.cumsum(wide)
            codes = np.repeat(codes, wide)
            for k, (at, n) in enumerate(zip(ends[odd] - wide[odd], wide[odd], strict=True)):
                codes[at : at + n] = BYTE_UNITS + np.frombuffer(raw[which[k]], np.uint8).astype(np.int64)
            sizes = np.add.reduceat(wide, np.cumsum(sizes) - sizes)
        return codes, sizes


def lattices(model: Model, chunks: list[str]) -> tuple[np.ndarray, ...]:
    """The filtered lattices of distinct chunks. A place is the end of a unit. Returns each chunk's last place, the first
    edge into each place and, by edge in order of the place it ends at, longest pieces first: the place it comes from (-1:
    the chunk's start), its piece and the greatest draw that picks it or an edge before it."""
    units, sizes = model.units(chunks)
    ends = np.cumsum(sizes)
    every = np.arange(len(units), dtype=np.int32)
    left = np.repeat(ends.astype(np.int32), sizes) - every  # units from here to the chunk's end
    inside = np.repeat(sizes.astype(np.int32), sizes) - left  # units before this one
    at, h, starts, lengths, places = every, None, [], [], []
    for length in range(1, model.longest + 1):
        if length > 1:
            keep = left[at] >= length
            at, h = at[keep], h[keep]
        if not len(at):
            break
        h = _hashed(units[at + length - 1], h)
        full = mixed(h)
        slots = _slot(full)
        keep = np.flatnonzero(model.begins[slots])  # what begins no piece needs no further unit
        at, h, full, slots = at[keep], h[keep], full[keep], slots[keep]
        hit, place = model.places(full, slots)
        starts.append(at[hit])
        lengths.append(np.full(len(hit), length, np.int32))
        places.append(place)
    start, piece = np.concatenate(starts[::-1]), np.concatenate(places[::-1])
    end = start + np.concatenate(lengths[::-1]) - 1
    del starts, lengths, places, at, h, left
    depth = inside[end]
    order = np.argsort(depth.astype(np.int64) * len(units) + end, kind="stable")  # place by place in all chunks at once
    start, end, piece, depth = start[order], end[order], piece[order], depth[order]
    froms = np.where(inside[start] == 0, -1, start - 1)
    weights, alpha, share = model.weights[piece], np.zeros(len(units) + 1), np.empty(len(start))
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
    for a, b in zip(bounds, bounds[1:], strict=False):
        value = np.where(froms[a:b] < 0, 0.0, alpha[froms[a:b]]) + weights[a:b]
        first = np.flatnonzero(np.concatenate([[True], np.diff(end[a:b]) > 0]))
        fan = np.diff(np.concatenate([first, [b - a]]))
        top = np.maximum.reduceat(value, first)
        part = np.exp(value - np.repeat(top, fan))
        total = np.add.reduceat(part, first)
        alpha[end[a:b][first]] = top + np.log(total)
        share[a:b] = part / np.repeat(total, fan)
    # Edges into a place are together already: each moves to its place's slot.
    fans = np.bincount(end, minlength=len(units))
    runs = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
    within = np.arange(len(end)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(end)]])))
    slot = (np.cumsum(fans) - fans)[end] + within
    froms_, pieces, upto = np.empty(len(end), np.int32), np.empty(len(end), np.int32), np.empty(len(end))
    froms_[slot], pieces[slot], upto[slot] = froms, model.ids[piece], share
    # Shares add up edge after edge of a place, so that they don't depend on the other chunks.
    first = np.cumsum(fans) - fans
    own = np.flatnonzero(fans)
    for k in range(1, int(fans.max(initial=0))):
        more = first[own[fans[own] > k]] + k
        upto[more] += upto[more - 1]
    marks = np.clip(upto * (1 << SHARE_BITS) - 1, 0, (1 << SHARE_BITS) - 1).astype(np.uint32)
    marks[first[own] + fans[own] - 1] = (1 << SHARE_BITS) - 1
    return ends - 1, first, froms_, pieces, marks


def draw(lattice: tuple[np.ndarray, ...], numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all chunks (by their numbers) one after another, and how many each chunk has."""
    last, first, froms, pieces, marks = lattice
    place, alive = last[numbers], np.arange(len(numbers))
    counts, steps = np.zeros(len(numbers), np.int64), []
    with np.errstate(over="ignore"):
        while len(alive):
            u = (mixed(keys[alive] + np.uint64(len(steps) + 1) * GOLD) >> np.uint64(64 - SHARE_BITS)).astype(np.uint32)
            edge = first[place]
            beyond = np.flatnonzero(u > marks[edge])
            while len(beyond):  # seldom more than a few edges, as the likeliest come first
                edge[beyond] += 1
                beyond = beyond[u[beyond] > marks[edge[beyond]]]
            counts[alive] += 1
            steps.append((alive, pieces[edge]))
            place = froms[edge]
            going = place >= 0
            alive, place = alive[going], place[going]
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, np.int32)
    for k, (own, found) in enumerate(steps):
        out[ends[own] - 1 - k] = found
    return out, counts


class Numbers(dict):
    """Numbers things from 0 as they turn up."""

    def __missing__(self, thing: str) -> int:
        n = self[thing] = len(self)
        return n


class Encoder:
    """Encodes blocks of texts. Lattices of chunks are kept from block to block, up to most_units units in all, and then
    built anew; what is kept changes no result."""

    def __init__(self, model: Model, most_units: int = 1_000_000):
        self.model, self.most = model, most_units
        self.forget()

    def forget(self) -> None:
        self.numbered = Numbers()
        self.places, self.known = 0, 0
        self.lattice = tuple(np.empty(0, kind) for kind in (np.int32, np.int32, np.int32, np.int32, np.uint32))

    def _learn(self) -> None:
        """Adds the lattices of the chunks that were numbered since the last call."""
        new = list(islice(self.numbered, self.known, None))
        if not new:
            return
        last, first, froms, pieces, marks = lattices(self.model, new)
        moved = last + self.places, first + len(self.lattice[2]), np.where(froms < 0, froms, froms + self.places), pieces, marks
        self.lattice = tuple(np.concatenate([old, x.astype(old.dtype)]) for old, x in zip(self.lattice, moved, strict=True))
        self.places += int(last[-1]) + 1
        self.known = len(self.numbered)

    def block(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts one after another, and how many each text has."""
        if self.places > self.most:
            self.forget()
        per_text = [list(map(self.numbered.__getitem__, CHUNK.findall(" " + t))) if t else [] for t in texts]
        sizes = np.fromiter(map(len, per_text), np.int64, len(per_text))
        numbers = np.fromiter(chain.from_iterable(per_text), np.int64, sizes.sum())
        del per_text
        if not len(numbers):
            return np.empty(0, np.int32), sizes
        self._learn()
        first = np.cumsum(sizes) - sizes
        index = (np.arange(len(numbers)) - np.repeat(first, sizes)).astype(np.uint64)
        with np.errstate(over="ignore"):
            found, counts = draw(self.lattice, numbers, mixed(np.repeat(keys, sizes) ^ mixed(index)))
        whole = np.concatenate([[0], np.cumsum(counts)])
        return found, whole[first + sizes] - whole[first]


def sample_pieces(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: str = MODEL, theta: float = 1.0, seed: int = 0, block_chars: int = 300_000) -> DataFrame:
    """docs with ``ids`` (the sampled pieces), ``decoded_sha256`` (of the text decoded from them) and ``lossless``
    (the decoded text is the text). Columns of these names are replaced. A text of any length is one lattice chain;
    blocks of about block_chars characters bound the memory of a task beyond that."""
    docs = without(docs, "ids", "decoded_sha256", "lossless")
    key = fresh_name(docs, "key")
    source = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col(f"`{key_col}`")))
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *extra])
    place = docs.columns.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model, theta)
        encoder = Encoder(own)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            keys = batch.column(len(batch.columns) - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            start, held = 0, 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1])
                if held < block_chars and end < len(texts):
                    continue
                part = texts[start:end]
                found, counts = encoder.block(part, keys[start:end])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                back = [own.decode(found[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
                shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]
                same = [a == b for a, b in zip(part, back, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in batch.columns[:-1]), ids, pa.array(shas, pa.string()), pa.array(same, pa.bool_())], names=schema.names)
                start, held = end, 0

    return in_arrow(source, encode, schema)
