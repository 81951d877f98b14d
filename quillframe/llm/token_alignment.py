"""Cross-tokenizer alignment: token spans of two public tokenizers, cut where both end a token, and corpus-wide link counts."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .words import bytes_list, slices, text_bytes

#: Bytes of text handled at once, and bytes of new units encoded as one text.
SLICE_BYTES, BATCH_BYTES = 2 << 20, 1 << 15
#: Units, and bytes of their results, that one worker remembers; beyond that it starts anew.
CACHE_UNITS, CACHE_BYTES = 600_000, 96 << 20
#: Groups of more links than this are stored as distinct pairs with how often each occurs.
DENSE_LINKS = 4096
#: Distinct pairs that are broadcast with their counts; rarer ones are answered by a join.
HEAD_PAIRS = 4 << 20
#: Ids of the first tokenizer in one bucket of pair counts, and tasks whose counts are summed first.
BUCKET_IDS, FIRST_LEVEL = 64, 256
#: Pairs a task gathers before it sorts them, and distinct pairs it holds before it sends them on.
COUNT_ROWS, HELD_PAIRS = 1 << 22, 1 << 22

_SEPARATORS = ",|;"
_ENCODERS: dict = {}

ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_ROWS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
)
COUNTS = "bucket int, part int, pairs binary, counts binary"
_COUNTS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])


def packed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers (below 2**32, unless ``kind`` is wider) as compressed byte planes."""
    values = values.astype(kind)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(held: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=0))


def unpacked_sorted(held: bytes) -> np.ndarray:
    return np.cumsum(unpacked(held))


def runs(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often (or with what total weight) each occurs."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    if weights is None:
        return values[new], np.diff(np.append(new, len(values)))
    return values[new], np.add.reduceat(weights, new) if len(new) else np.zeros(0, np.int64)


def _byte_level() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + extra)] = b
            extra += 1
    return table


class _Side:
    """What one tokenizer says of a text that begins with a space: ids and byte ends of its tokens."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = pa.array(bytes_of, pa.large_binary())
        self.widths = np.array([len(b) for b in bytes_of], np.int64)

    def ends(self, ids: np.ndarray, spans: np.ndarray, byte_at: np.ndarray, data: bytes) -> np.ndarray | None:
        """Byte end of every token, or None if the tokens' bytes are not ``data``.

        Character spans give the coarse cuts.  A token that ends inside a character - its span is empty, or the next token
        starts before it ends - is placed by the decoded bytes since the last coarse cut.
        """
        total = np.cumsum(self.widths[ids])
        if not len(ids) or total[-1] != len(data):
            return None
        if not self.bytes_of.take(pa.array(ids)).buffers()[2].slice(0, len(data)).equals(pa.py_buffer(data)):
            return None
        coarse = byte_at[spans[:, 1]]
        exact = spans[:, 1] > spans[:, 0]
        exact[:-1] &= spans[1:, 0] >= spans[:-1, 1]
        last = np.maximum.accumulate(np.where(exact, np.arange(len(ids)), -1))
        base = np.where(last >= 0, coarse[last] - total[last], 0)
        ends = np.where(exact, coarse, base + total)
        return ends if np.array_equal(ends, total) else total


class _First(_Side):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_level()
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        table = [b""] * (names[-1][1] + 1)
        for name, k in names:
            table[k] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        super().__init__(table)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [(np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)) for e in found]


class _Second(_Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        super().__init__([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ])
        # A unit may begin at these characters: no piece runs across one that follows anything but a space.
        inside = "".join(p[1:] if p[0] != "▁" else p.lstrip("▁")[1:] for p in pieces if not p.startswith("<"))
        self.cuts = bytes([c for c, mark in ((32, "▁"), (10, "\n")) if mark not in inside])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The model adds the first space itself; spans are moved by one, as if it had been in the text."""
        out = []
        for found in self.model.encode([t[1:] for t in texts], return_type="offset_mapping", num_threads=1):
            spans = np.array(found["offsets"], np.int64).reshape(-1, 2) + 1
            if len(spans):
                spans[0, 0] = 0
            out.append((np.array(found["ids"], np.int64), spans))
        return out


class Aligner:
    """Results of units: pieces of a text that begin at white space after something else, where both tokenizers start anew."""

    def __init__(self, first: str, second: str):
        self.a, self.b = _First(first), _Second(second)
        self.base = len(self.b.widths)
        symbols = [f"{k}{s}" for k in range(max(len(self.a.widths), self.base)) for s in _SEPARATORS]
        self.symbols = pa.array(symbols, pa.large_string())
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        #: Tokens of both kinds, groups, links and whether the unit's tokens give its bytes; a column for each unit.
        self.facts = np.zeros((5, 1 << 12), np.int64)
        self.ends = np.zeros((2, (1 << 12) + 1), np.int64)  # of pairs and of texts
        self.pairs, self.times = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.text = np.zeros(1 << 16, np.uint8)
        self.n = 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if array.shape[-1] >= n:
            return array
        out = np.zeros((*array.shape[:-1], max(n, 2 * array.shape[-1])), array.dtype)
        out[..., : array.shape[-1]] = array
        return out

    def full(self) -> bool:
        return self.n > CACHE_UNITS or 12 * self.ends[0, self.n] + self.ends[1, self.n] > CACHE_BYTES

    def _append(self, facts: np.ndarray, pair_counts: np.ndarray, pairs: np.ndarray, times: np.ndarray,
                widths: np.ndarray, text: np.ndarray) -> None:
        n, m = self.n, facts.shape[1]
        self.facts, self.ends = self._room(self.facts, n + m), self._room(self.ends, n + m + 1)
        self.facts[:, n : n + m] = facts
        at, to = self.ends[:, n]
        self.ends[0, n + 1 : n + m + 1] = at + np.cumsum(pair_counts)
        self.ends[1, n + 1 : n + m + 1] = to + np.cumsum(widths)
        self.pairs, self.times = self._room(self.pairs, at + len(pairs)), self._room(self.times, at + len(pairs))
        self.pairs[at : at + len(pairs)], self.times[at : at + len(pairs)] = pairs, times
        self.text = self._room(self.text, to + len(text))
        self.text[to : to + len(text)] = text
        self.n += m

    def _aligned(self, a: tuple, b: tuple, text: str, units: np.ndarray) -> tuple | None:
        """Everything about the units of one text, ``units`` being their byte ends, or None if bytes or cuts don't fit."""
        data = text.encode()
        starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        byte_at = np.append(np.flatnonzero(starts), len(data))
        end_a, end_b = self.a.ends(*a, byte_at, data), self.b.ends(*b, byte_at, data)
        if end_a is None or end_b is None:
            return None
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        if not np.isin(units, common).all():
            return None
        of_a, of_b, unit = np.searchsorted(common, end_a), np.searchsorted(common, end_b), np.searchsorted(units, common)
        n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        count = lambda at, w=None: np.bincount(at, w, minlength=len(units)).astype(np.int64)
        links = n_a * n_b
        facts = np.stack([count(unit[of_a]), count(unit[of_b]), count(unit), count(unit, links), np.ones(len(units), np.int64)])
        pairs, times, owner = self._pairs(a[0], b[0], n_a, n_b, unit)
        # Texts: the ids of a group's tokens, each followed by its separator.
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        sep_a, sep_b = np.zeros(len(end_a), np.int64), np.zeros(len(end_b), np.int64)
        sep_a[last_a], sep_b[last_b] = 1, 2
        place_a = np.arange(len(end_a)) + (last_b + 1 - n_b)[of_a]
        place_b = np.arange(len(end_b)) + (last_a + 1)[of_b]
        order = np.empty(len(end_a) + len(end_b), np.int64)
        order[place_a], order[place_b] = a[0] * 3 + sep_a, b[0] * 3 + sep_b
        texts = self.symbols.take(pa.array(order))
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        edges = at[np.cumsum(facts[0] + facts[1])]
        body = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        return facts, count(owner), pairs, times, np.diff(edges, prepend=at[0]), body

    def _pairs(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, unit: np.ndarray):
        links = n_a * n_b
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        small = np.flatnonzero(links <= DENSE_LINKS)
        group = np.repeat(small, links[small])
        k = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        pairs = [a[first_a[group] + k // n_b[group]] * self.base + b[first_b[group] + k % n_b[group]]]
        times, owner = [np.ones(len(group), np.int32)], [unit[group]]
        for g in np.flatnonzero(links > DENSE_LINKS):
            ids, once = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            others, twice = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            pairs.append((ids[:, None] * self.base + others).ravel())
            times.append((once[:, None] * twice).ravel().astype(np.int32))
            owner.append(np.full(len(ids) * len(others), unit[g]))
        if len(pairs) == 1:
            return pairs[0], times[0], owner[0]
        pairs, times, owner = np.concatenate(pairs), np.concatenate(times), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return pairs[order], times[order], owner[order]

    def _learn(self, batches: list[list[bytes]]) -> None:
        texts = [" a" + b"".join(units).decode() for units in batches]
        for units, text, a, b in zip(batches, texts, self.a.encode(texts), self.b.encode(texts)):
            ends = 2 + np.cumsum([0, *map(len, units)])
            found = self._aligned(a, b, text, ends)
            if found is None and len(units) > 1:
                self._learn([[u] for u in units])
                continue
            if found is None:
                none = np.zeros(0, np.int64)
                self._append(np.zeros((5, 1), np.int64), np.zeros(1, np.int64), none, none.astype(np.int32), np.zeros(1, np.int64), none.astype(np.uint8))
            else:
                # The first unit is the " a" that stands before the others.
                facts, counts, pairs, times, widths, body = found
                self._append(facts[:, 1:], counts[1:], pairs[counts[0] :], times[counts[0] :], widths[1:], body[widths[0] :])
            for k, unit in enumerate(units):
                self.known[unit] = self.n - len(units) + k

    def rows_of(self, units: list[bytes]) -> np.ndarray:
        """Where each of some distinct units is stored; new ones are encoded, many to a text."""
        batches, size = [[]], 0
        for unit in units:
            if unit not in self.known:
                if size > BATCH_BYTES:
                    batches.append([])
                    size = 0
                batches[-1].append(unit)
                size += len(unit)
        for k in range(0, len(batches), 8):
            self._learn([b for b in batches[k : k + 8] if b])
        return np.array([self.known[u] for u in units], np.int64)

    def whole(self, text: bytes) -> int:
        """A text as one unit, without relying on cuts."""
        if b" " + text not in self.known:
            units = text.decode()
            a, b = self.a.encode([" " + units])[0], self.b.encode([" " + units])[0]
            found = self._aligned(a, b, " " + units, np.array([len(text) + 1]))
            if found is None:
                return -1
            self._append(*found)
            return self.n - 1
        return self.known[b" " + text]


_SPACES = np.zeros(256, bool)
_SPACES[[*range(9, 14), *range(28, 32), 32]] = True


def unit_starts(data: np.ndarray, begins: np.ndarray, cuts: bytes) -> np.ndarray:
    """Where units start: at texts, and at a space or line break (of ``cuts``) after anything but white space of any kind."""
    n = len(data)
    at = np.flatnonzero(np.isin(data, np.frombuffer(cuts, np.uint8)))
    at = at[at >= 3] if n else at
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    space = _SPACES[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    space |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    space |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    space |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    space |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    starts = np.zeros(n, bool)
    starts[at[~space]] = starts[begins] = True
    return np.flatnonzero(starts)


def _encoded(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers are reused, and so is what one has learned.
        key = (first, second)
        aligner = _ENCODERS[key] = _ENCODERS.get(key) or Aligner(first, second)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
            data, offsets = text_bytes(texts)
            for lo, hi in slices(offsets, SLICE_BYTES):
                if aligner.full():
                    aligner.clear()
                part = data[offsets[lo] : offsets[hi]]
                yield _slice(aligner, batch.column("doc_id").slice(lo, hi - lo), part, offsets[lo : hi + 1] - offsets[lo])

    return run


def _slice(aligner: Aligner, doc_ids: pa.Array, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    n = len(bounds) - 1
    starts = unit_starts(data, bounds[:-1][np.diff(bounds) > 0], aligner.b.cuts)
    edges = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    at = aligner.rows_of(bytes_list(units.dictionary))[units.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
    first = np.searchsorted(starts, bounds)  # of each document's units
    if len(at) and not aligner.facts[4, at].all():
        at, first = _settled(aligner, data, bounds, at, first)
    text_ends = np.ascontiguousarray(aligner.ends[1, : aligner.n + 1])
    held = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), aligner.n, [None, pa.py_buffer(text_ends), pa.py_buffer(aligner.text)]
    ).take(pa.array(at))
    where = np.frombuffer(held.buffers()[1], np.int64)[: len(at) + 1] if len(at) else np.zeros(1, np.int64)
    body = memoryview(held.buffers()[2]) if len(at) else memoryview(b"")
    shas = [
        hashlib.sha256(body[where[a] : where[b] - 1]).hexdigest() if b > a else ""
        for a, b in zip(first[:-1].tolist(), first[1:].tolist())
    ]
    sums = np.zeros((4, len(at) + 1), np.int64)
    np.cumsum(aligner.facts[:4, at], axis=1, out=sums[:, 1:])
    facts = sums[:, first[1:]] - sums[:, first[:-1]]
    # All links of the slice's documents, sorted by document and pair.
    ends = aligner.ends[0]
    sizes = ends[at + 1] - ends[at]
    inside = np.repeat(ends[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    row = np.repeat(np.repeat(np.arange(n), np.diff(first)), sizes)
    times = aligner.times[inside]
    weights = None if (times == 1).all() else times.astype(np.int64)
    keys, counts = runs((row << 32) | aligner.pairs[inside], weights)
    cut = np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << 32)
    pairs = keys & 0xFFFFFFFF
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    return pa.RecordBatch.from_arrays(
        [doc_ids.cast(pa.int64()), *map(pa.array, facts), pa.array(shas, pa.string()),
         pa.array([packed_sorted(pairs[a:b]) for a, b in spans], pa.binary()),
         pa.array([packed(counts[a:b]) for a, b in spans], pa.binary())],
        schema=_ROWS,
    )


def _settled(aligner: Aligner, data: np.ndarray, bounds: np.ndarray, at: np.ndarray, first: np.ndarray):
    """Documents with a unit whose tokens don't give its bytes are encoded whole; if that fails too, they have no units."""
    keep, sizes = [], []
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        rows = at[a:b]
        if len(rows) and not aligner.facts[4, rows].all():
            found = aligner.whole(data[bounds[k] + 1 : bounds[k + 1]].tobytes())
            rows = np.array([found] if found >= 0 and aligner.facts[4, found] else [], np.int64)
        keep.append(rows)
        sizes.append(len(rows))
    return np.concatenate(keep), np.concatenate([[0], np.cumsum(sizes)])


def _count_batch(pairs: np.ndarray, counts: np.ndarray, part: int, per_bucket: int) -> pa.RecordBatch:
    buckets = pairs // per_bucket
    cut = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(pairs)]))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(buckets[a]) for a, _ in spans], pa.int32()), pa.array([part] * len(spans), pa.int32()),
         pa.array([packed_sorted(pairs[a:b]) for a, b in spans], pa.binary()),
         pa.array([packed(counts[a:b], "<i8") for a, b in spans], pa.binary())],
        schema=_COUNTS,
    )


def _counted(per_bucket: int):
    """Documents of each pair among a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() // FIRST_LEVEL, [], 0
        none = np.zeros(0, np.int64)
        total = (none, none)

        def added() -> tuple[np.ndarray, np.ndarray]:
            pairs, counts = runs(np.concatenate(held)) if held else (none, none)
            return runs(np.concatenate([total[0], pairs.astype(np.int64)]), np.concatenate([total[1], counts]))

        for batch in batches:
            for x in batch.column("pairs"):
                held.append(unpacked_sorted(x.as_buffer()).astype(np.uint32))
                size += len(held[-1])
                if size > COUNT_ROWS:
                    total, held, size = added(), [], 0
                    if len(total[0]) > HELD_PAIRS:
                        yield _count_batch(*total, part, per_bucket)
                        total = (none, none)
        yield _count_batch(*added(), part, per_bucket)

    return run


def _added(per_bucket: int):
    def run(table: pa.Table) -> pa.Table:
        if table.num_rows == 1:
            return table
        pairs = np.concatenate([unpacked_sorted(x.as_buffer()) for x in table.column("pairs")])
        total = runs(pairs, np.concatenate([unpacked(x.as_buffer(), "<i8") for x in table.column("counts")]))
        return pa.Table.from_batches([_count_batch(*total, table.column("part")[0].as_py(), per_bucket)])

    return run


def _best(base: int):
    """The highest count of each first id in a bucket, and how many pairs have a count in [2**k, 2**(k + 1))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, counts in zip(batch.column("pairs"), batch.column("counts")):
                ids, count = unpacked_sorted(held.as_buffer()) // base, unpacked(counts.as_buffer(), "<i8")
                new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[new]), pa.array(np.maximum.reduceat(count, new)),
                     pa.array([np.bincount(np.log2(count).astype(np.int64), minlength=63).tolist()] + [None] * (len(new) - 1), pa.list_(pa.int64()))],
                    names=["id", "most", "sizes"],
                )

    return run


def _listed(least: int, below: int | None):
    """Pairs whose count is at least ``least`` and under ``below``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, counts in zip(batch.column("pairs"), batch.column("counts")):
                pairs, count = unpacked_sorted(held.as_buffer()), unpacked(counts.as_buffer(), "<i8")
                keep = (count >= least) & (count < below if below else True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[keep]), pa.array(count[keep])], names=["pair", "count"])

    return run


_SCORES = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, open array<long>, open_times array<long>"


def _scored(shared, base: int, tail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, most = shared.value
        for batch in batches:
            n_best, sums, open_pairs, open_times = [], [], [], []
            for held, times in zip(batch.column("pairs"), batch.column("times")):
                pairs, time = unpacked_sorted(held.as_buffer()), unpacked(times.as_buffer())
                at = np.minimum(np.searchsorted(head, pairs.astype(np.uint32)), max(len(head) - 1, 0))
                known = head[at] == pairs if len(head) else np.zeros(len(pairs), bool)
                count = np.where(known, counts[at], 1) if len(head) else np.ones(len(pairs), np.int64)
                if tail:
                    open_pairs.append(pairs[~known].tolist())
                    open_times.append(time[~known].tolist())
                    pairs, time, count = pairs[known], time[known], count[known]
                n_best.append(int(time[count == most[pairs // base]].sum()))
                sums.append(int((time * count).sum()))
            lists = pa.list_(pa.int64())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
                + [pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), batch.column("groups_sha256"),
                   pa.array(open_pairs if tail else [None] * n, lists), pa.array(open_times if tail else [None] * n, lists)],
                names=[c.split()[0] for c in _SCORES.split(", ")],
            )

    return run


def align_tokens(docs: DataFrame, first: str, second: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs(doc_id, text)``.

    ``first`` names a byte-level file of the tokenizers library (A), ``second`` a sentencepiece model that adds a space (B).  Both
    encode a space and the text, without special tokens.  Byte offsets at which tokens of both end cut the tokens into groups; every
    pair of an A and a B token of one group is a link.  ``count`` of a pair of ids is the number of rows that hold it linked;
    ``n_best`` are the links whose count is the highest of their A id, ties included; ``count_sum`` adds the counts of all links.
    ``groups_sha256`` is the SHA-256 of ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts whose tokens of A or B don't decode to a space and the text, have zeros and an empty
    ``groups_sha256``.  Repeated rows, and rows with a null doc_id, count as separate documents; an empty table gives an empty
    result; other columns are ignored.

    Character offsets are the coarse cuts; tokens that end inside a character, and byte-fallback tokens, are placed by their decoded
    bytes.  Texts are encoded in units that begin at a space or line break after something else, where no token of either kind
    goes across; results of recent units are remembered.  Pairs of each row are kept, packed, in a checkpoint, so a text is
    encoded once.  Counts are summed in buckets of a fixed range of ids.  At most ``head_pairs`` of the most frequent pairs are
    broadcast; a pair that none of the lists holds occurs once; if the list can't hold all that occur twice, the
    others are joined by a shuffle.
    """
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
    per_bucket = BUCKET_IDS * base
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = checkpointed(plain.mapInArrow(_encoded(first, second), ROWS))
    counts = rows.select("pairs").mapInArrow(_counted(per_bucket), COUNTS)
    counts = counts.groupBy("bucket", "part").applyInArrow(_added(per_bucket), COUNTS)
    counts = checkpointed(counts.withColumn("part", F.lit(0)).groupBy("bucket").applyInArrow(_added(per_bucket), COUNTS))
    best = counts.mapInArrow(_best(base), "id long, most long, sizes array<long>").toArrow()
    ids = best.column("id").to_numpy()
    most = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    most[ids] = best.column("most").to_numpy()
    sizes = np.zeros(63, np.int64)
    for x in best.column("sizes").drop_null().to_pylist():
        sizes += np.array(x)
    # Pairs that occur at least 2**k times: the least k from 1 on for which they are few enough.
    above = np.cumsum(sizes[::-1])[::-1]
    k = int(np.flatnonzero(above[1:] <= head_pairs)[0]) + 1
    tail = k > 1
    head = counts.mapInArrow(_listed(1 << k, None), "pair long, count long").toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast(
        (head.column("pair").to_numpy().astype(np.uint32), head.column("count").to_numpy(), most)
    )
    scores = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scored(shared, base, tail), _SCORES)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not tail:
        return scores.select(columns)
    scores = checkpointed(scores)
    table = docs.sparkSession.createDataFrame(
        [(k, int(v)) for k, v in enumerate(most.tolist())], "id long, most long"
    )
    each = scores.select("row", F.explode(F.arrays_zip("open", "open_times")).alias("x")).select("row", "x.open", "x.open_times")
    rare = counts.mapInArrow(_listed(2, 1 << k), "pair long, count long")
    each = each.join(rare, F.col("open") == F.col("pair"), "left").withColumn("count", F.coalesce("count", F.lit(1)))
    each = each.withColumn("id", F.floor(F.col("open") / base)).join(F.broadcast(table), "id")
    more = each.groupBy("row").agg(
        F.sum(F.when(F.col("count") == F.col("most"), F.col("open_times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("open_times") * F.col("count")).alias("more_sum"),
    )
    whole = scores.drop("open", "open_times").join(more, "row", "left")
    return whole.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))
    ).select(columns)
