"""Substring dedup: a sharded count-min sketch finds windows that may repeat, an exact second pass settles them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed, temporary_conf
from .words import mix, words_of

#: Bytes of text in one unit of work, and bytes of text that one block of sketch cells answers for.
UNIT_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
#: Cells of one block of one sketch row (a byte each while merged), and rows of the sketch.
BLOCK_CELLS = 1 << 23
DEPTH = 2

_SKETCH = "block int, unit int, cells binary, twice binary"
_MARKS = "unit int, block int, kind int, bits binary"
_KEYS = "block int, unit int, first binary, second binary, twice binary"


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct integers below 2**32, as compressed byte planes of their gaps."""
    gaps = np.diff(values, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


class Unit:
    """The windows of one unit's documents: 64 and 32 bits of hash each, and where they start."""

    def __init__(self, table: pa.Table, window: int, blocks: int):
        self.blocks, self.window = blocks, window
        opener = zstandard.ZstdDecompressor()
        self.ids = table.column("doc_id")
        texts = [opener.decompress(x.as_buffer()) if x.is_valid else b"" for x in table.column("packed")]
        self.parts = list(words_of(pa.array(texts, pa.large_binary())))
        first, second = [], []
        for words in self.parts:
            first.append(words.windows(window, 0)[1])
            second.append(words.windows(window, 1)[1] >> np.uint64(32))
            words.forget()
        self.first = np.concatenate(first) if first else np.zeros(0, np.uint64)
        self.second = np.concatenate(second).astype(np.uint32) if second else np.zeros(0, np.uint32)

    def cells(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells of a sketch row, each window's place among them, and how many windows each cell has."""
        at = mix(self.first ^ np.uint64(row + 1)) % np.uint64(self.blocks * BLOCK_CELLS)
        return np.unique(at.astype(np.int64), return_inverse=True, return_counts=True)

    def by_block(self, cells: np.ndarray, row: int):
        edges = np.searchsorted(cells, np.arange(self.blocks + 1, dtype=np.int64) * BLOCK_CELLS)
        for k in range(self.blocks):
            if edges[k + 1] > edges[k]:
                yield row * self.blocks + k, k * BLOCK_CELLS, slice(edges[k], edges[k + 1])

    def suspects(self, marks: dict[int, bytes]) -> np.ndarray:
        """Windows whose every cell is held at least twice in the whole corpus."""
        keep = np.ones(len(self.first), bool)
        for row in range(DEPTH):
            cells, place, _ = self.cells(row)
            hit = np.zeros(len(cells), bool)
            for block, _, span in self.by_block(cells, row):
                hit[span] = unpack_bits(marks[block], span.stop - span.start)
            keep &= hit[place]
        return np.flatnonzero(keep)

    def keys(self, suspects: np.ndarray):
        """Distinct suspect keys in (block, first, second) order: keys, place of each suspect, counts, bounds of blocks."""
        one, two = self.first[suspects], self.second[suspects]
        block = mix(one ^ np.uint64(0xABCDEF)) % np.uint64(self.blocks)
        order = np.lexsort((two, one, block))
        one, two, block = one[order], two[order], block[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        rank = np.cumsum(new) - 1
        place = np.empty(len(one), np.int64)
        place[order] = rank
        edges = np.searchsorted(block[new], np.arange(self.blocks + 1, dtype=np.uint64))
        return one[new], two[new], place, np.bincount(rank, minlength=int(new.sum())), edges


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_SKETCH_ARROW = pa.schema([("block", pa.int32()), ("unit", pa.int32()), ("cells", pa.binary()), ("twice", pa.binary())])
_MARKS_ARROW = pa.schema([("unit", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary())])
_KEYS_ARROW = pa.schema(
    [("block", pa.int32()), ("unit", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("twice", pa.binary())]
)
_KEPT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]
)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [press.compress(x.as_buffer()) if x.is_valid else None for x in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("unit"), batch.column("doc_id"), pa.array(texts, pa.binary())], names=["unit", "doc_id", "packed"]
        )


def _sketch(window: int, blocks: int):
    def run(table: pa.Table) -> pa.Table:
        unit_no, unit, rows = table.column("unit")[0].as_py(), Unit(table, window, blocks), []
        for row in range(DEPTH):
            cells, _, counts = unit.cells(row)
            for block, base, span in unit.by_block(cells, row):
                rows.append((block, unit_no, pack_sorted(cells[span] - base), pack_bits(counts[span] > 1)))
        return _table(rows, _SKETCH_ARROW)

    return run


def _merge_cells(table: pa.Table) -> pa.Table:
    """Sum one block's partial sketches; tell every unit which of its cells hold two windows or more."""
    block, held = table.column("block")[0].as_py(), np.zeros(BLOCK_CELLS, np.uint8)
    for packed, twice in zip(table.column("cells"), table.column("twice")):
        cells = unpack_sorted(packed.as_buffer())
        held[cells] = np.minimum(held[cells] + 1 + unpack_bits(twice.as_buffer(), len(cells)), 2)
    rows = []
    for unit, packed in zip(table.column("unit").to_pylist(), table.column("cells")):
        rows.append((unit, block, 0, pack_bits(held[unpack_sorted(packed.as_buffer())] > 1)))
    return _table(rows, _MARKS_ARROW)


def _suspect_keys(window: int, blocks: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _KEYS_ARROW)
        unit_no, unit = left.column("unit")[0].as_py(), Unit(left, window, blocks)
        one, two, _, counts, edges = unit.keys(unit.suspects(_marks(right, 0)))
        rows = [
            (k, unit_no, one[a:b].tobytes(), two[a:b].tobytes(), pack_bits(counts[a:b] > 1))
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a
        ]
        return _table(rows, _KEYS_ARROW)

    return run


def _merge_keys(table: pa.Table) -> pa.Table:
    """Group one block's suspect windows exactly; tell every unit which of its keys occur twice or more."""
    block, units = table.column("block")[0].as_py(), table.column("unit").to_pylist()
    one = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("first")]
    two = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("second")]
    sizes = [len(x) for x in one]
    times = np.concatenate([1 + unpack_bits(x.as_buffer(), n) for x, n in zip(table.column("twice"), sizes)])
    one, two = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.cumsum(new) - 1
    repeated = np.empty(len(order), bool)
    repeated[order] = (np.bincount(group, weights=times[order]) > 1)[group]
    ends = np.cumsum(sizes)
    return _table(
        [(u, block, 1, pack_bits(repeated[b - n : b])) for u, n, b in zip(units, sizes, ends)], _MARKS_ARROW
    )


def _marks(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {
        block: bits
        for block, k, bits in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "bits"))) if k == kind
    }


def _cut(window: int, blocks: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _KEPT_ARROW)
        unit = Unit(left, window, blocks)
        suspects = unit.suspects(_marks(right, 0))
        _, _, place, counts, edges = unit.keys(suspects)
        settled, repeated = _marks(right, 1), np.zeros(len(counts), bool)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if b > a:
                repeated[a:b] = unpack_bits(settled[k], b - a)
        bad = np.zeros(len(unit.first), bool)
        bad[suspects] = repeated[place]
        n_words, n_removed, kept, done = [], [], [], 0
        for words in unit.parts:
            at = words.window_starts(window)
            starts = at[bad[done : done + len(at)]]
            done += len(at)
            edge = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
            n_words.append(words.counts)
            n_removed.append(np.diff(removed))
            raw = words.data.tobytes()
            for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                spans = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[spans].tolist(), words.ends[spans].tolist())]))
        text = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.Table.from_arrays(
            [unit.ids.combine_chunks() if isinstance(unit.ids, pa.ChunkedArray) else unit.ids,
             pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), text], schema=_KEPT_ARROW
        )

    return run


def substring_dedup(docs: DataFrame, window: int = 35, unit_bytes: int = UNIT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``docs(doc_id, text)``.

    Every word covered by a window of ``window`` consecutive words whose word sequence also starts elsewhere, in
    any row, is removed; windows are judged on the input.  ``kept_text`` has the other words joined by one space.  Null and
    empty texts have no words and an empty ``kept_text``; texts shorter than a window keep all words; repeated
    rows (and rows with a null doc_id) count as separate documents; an empty table gives an empty result;
    other columns are ignored.

    Documents are dealt to units of about ``unit_bytes``.  Each unit sends a partial count-min sketch of its window hashes, as sorted
    cell numbers by block (about a byte a cell); blocks are summed apart from each other, and every unit is told by one
    bit which of its cells hold two windows or more.  The sum never underestimates, so only windows with every
    cell marked can repeat; their 96-bit keys are then grouped exactly, again by block.  Units, blocks and
    messages are bounded whatever the size of the corpus; nothing is broadcast and nothing reaches the driver but one number.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units, blocks = max(1, -(-total // unit_bytes)), max(1, -(-total // block_bytes))
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int")
    packed = plain.withColumn("unit", unit).mapInArrow(_packed, "unit int, doc_id long, packed binary")
    # A checkpoint of a plan that is not adaptive keeps its partitioning, so the passes below don't shuffle texts again.
    with temporary_conf(docs.sparkSession, spark__sql__adaptive__enabled="false"):
        packed = checkpointed(packed.repartition(units, "unit"))
    sketch = packed.groupBy("unit").applyInArrow(_sketch(window, blocks), _SKETCH)
    marks = checkpointed(sketch.groupBy("block").applyInArrow(_merge_cells, _MARKS))
    keys = packed.groupBy("unit").cogroup(marks.groupBy("unit")).applyInArrow(_suspect_keys(window, blocks), _KEYS)
    marks = marks.unionByName(checkpointed(keys.groupBy("block").applyInArrow(_merge_keys, _MARKS)))
    return packed.groupBy("unit").cogroup(marks.groupBy("unit")).applyInArrow(
        _cut(window, blocks), "doc_id long, n_words long, n_removed long, kept_text string"
    )
