"""Toxicity by the nearest labelled examples: exact cosine of whole TF-IDF vectors, weighted by what terms say of the label."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from .array_sums import CHUNK, PARTS, parts_of, summed
from .words import words_of

#: Byte lengths of word beginnings that count as terms besides whole words.
STEMS = (4, 5, 6, 7, 8)
#: Most bytes of the dense matrices of a lot; queries scored at once, and dealt to lots; cells of a matrix that cost as much as one posting.
DENSE_BYTES, AT_ONCE, WAITING, CELLS = 64 << 20, 160, 2048, 224
#: Groups of similar examples, the most frequent terms they are told by, examples that fix the groups, and rounds for that.
GROUPS, GROUP_TERMS, GROUP_ROWS, ROUNDS = 8, 512, 2048, 8
#: Nearness of an exact match, and weight of the base rate among the votes.
NEAR, PRIOR = 0.05, 1.0

class Vocabulary:
    """Sorted term hashes, with a table of where each value of their high bits begins, so that a term is found in one or two steps."""

    def __init__(self, terms: np.ndarray):
        bits = max(4, len(terms).bit_length())
        self.terms, self.shift = terms, np.uint64(64 - bits)
        self.first = np.searchsorted(terms >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are known, by index, and their places in the vocabulary."""
        high = (term >> self.shift).astype(np.int64)
        at, end, found = self.first[high], self.first[high + 1], np.full(len(term), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.terms[at[left]] == term[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        known = np.flatnonzero(found >= 0)
        return known, found[known]


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _plain(column: pa.Array) -> pa.Array:
    """Lower case, with everything in ASCII that is not a letter as space."""
    lower = pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "")
    _, offsets, data = lower.buffers()
    raw = _PLAIN[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(lower), [None, offsets, pa.py_buffer(raw.tobytes())], offset=lower.offset)


def row_terms(column: pa.Array, wanted: Vocabulary | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, term hashes, row of each occurrence, index of its term) by slices: whole words, and their beginnings.

    With a vocabulary only its terms count, and indexes are their places in it.  Each distinct word of a slice is looked up once.
    """
    for words in words_of(_plain(column)):
        found = pa.array(words.hashes).dictionary_encode()
        word = found.indices.to_numpy(zero_copy_only=False)
        some = np.zeros(len(found.dictionary), np.int64)
        some[word] = np.arange(len(word))
        starts, size = words.starts[some], words.ends[some] - words.starts[some]
        terms, spans = [], []
        for k in (0, *STEMS):
            at = np.flatnonzero(size >= k)
            spans.append(at)
            terms.append(words.span_hashes(starts[at], starts[at] + k) ^ np.uint64(k) if k else words.hashes[some])
        if wanted is None:
            kinds, place = np.unique(np.concatenate(terms), return_inverse=True)
            places = np.split(place, np.cumsum([len(at) for at in spans])[:-1])
        else:
            kinds, places = wanted.terms, []
            for k, term in enumerate(terms):
                known, place = wanted.places(term)
                spans[k] = spans[k][known]
                places.append(place)
        table = np.full((len(some), len(spans)), -1, np.int32)
        for k, (at, place) in enumerate(zip(spans, places)):
            table[at, k] = place
        held = table[word]
        kept = held >= 0
        yield *words.rows, kinds, np.repeat(np.repeat(np.arange(len(words.counts)), words.counts), kept.sum(1)), held[kept]


def _counted_places(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, place), and how often each occurs."""
    key = np.sort((row.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times, key = np.diff(np.append(first, len(key))), key[first]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), times


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, _, kinds, row, term in row_terms(batch.column("text")):
            row, place, _ = _counted_places(row, term)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.view(np.int64)), pa.array(np.bincount(place, minlength=len(kinds)).astype(np.int64)),
                 pa.array(np.bincount(place, weights=toxic[lo + row], minlength=len(kinds)).astype(np.int64))],
                names=["term", "n", "p"],
            )


def _document_counts(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held = shared.value, np.zeros(length, np.int64)
        for batch in batches:
            held[-1] += batch.num_rows
            for _, _, _, row, at in row_terms(batch.column("text"), vocabulary):
                held += np.bincount(_counted_places(row, at)[1], minlength=length)
        yield parts_of({"": held})

    return run


def _vectors(vocabulary: Vocabulary, weights: np.ndarray, column: pa.Array):
    """(row, terms, unit weights) of the rows that have a term of the vocabulary."""
    for lo, _, _, row, at in row_terms(column, vocabulary):
        row, at, times = _counted_places(row, at)
        value, at = (1 + np.log(times)) * weights[at], at.astype(np.int32)
        bounds = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
        for a, b in zip(bounds, np.append(bounds[1:], len(row))):
            yield lo + int(row[a]), at[a:b], value[a:b] / np.sqrt((value[a:b] ** 2).sum())


def _pack(terms: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending terms and how often they occur, in few bytes: steps and counts by byte planes, compressed."""
    both = np.concatenate([np.diff(terms, prepend=0), times]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(both.T.tobytes())


_OPENER = zstandard.ZstdDecompressor()


def _unpack(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(_OPENER.decompress(held), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _example_terms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [b""] * batch.num_rows
            for lo, _, _, row, at in row_terms(batch.column("text"), shared.value):
                row, at, times = _counted_places(row, at)
                bounds = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
                for a, b in zip(bounds, np.append(bounds[1:], len(row))):
                    held[lo + int(row[a])] = _pack(at[a:b], times[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(held, pa.binary())], names=["doc_id", "toxic", "held"]
            )

    return run


@dataclass(frozen=True)
class PackedExamples:
    """Examples as the driver holds and sends them; their vectors are made where they are read."""

    rows: list[tuple[int, int, bytes]]
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for doc_id, toxic, held in self.rows:
            terms, times = _unpack(held)
            value = (1 + np.log(times)) * self.weights[terms]
            yield doc_id, toxic, terms, value / np.sqrt((value**2).sum())

    def sizes(self) -> list[int]:
        return [zstandard.frame_content_size(held) // 8 for _, _, held in self.rows]

    def terms(self) -> Iterator[np.ndarray]:
        return (_unpack(held)[0] for _, _, held in self.rows)


@dataclass(frozen=True)
class _Panel:
    """The terms of a block of examples that many queries share, as a matrix."""

    start: int
    stop: int
    dense: np.ndarray


class _Groups:
    """k-means on the most frequent terms, from examples spread evenly.  Only the cost of a search depends on it, no result."""

    def __init__(self, size: np.ndarray, rank: np.ndarray, n: int, some: list[np.ndarray]):
        self.rank, wanted = rank, max(1, min(GROUPS, n // 512))
        self.idf = np.log(1 + n / np.maximum(np.sort(size)[::-1][:GROUP_TERMS], 1)).astype(np.float32)
        unit = np.stack([self.unit(terms) for terms in some])
        self.centres = unit[np.linspace(0, len(unit) - 1, wanted).astype(np.int64)]
        for _ in range(ROUNDS if wanted > 1 else 0):
            group = (unit @ self.centres.T).argmax(1)
            self.centres = np.stack([unit[group == g].sum(0) if (group == g).any() else self.centres[g] for g in range(wanted)])
            self.centres /= np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-9)
        self.columns = np.ascontiguousarray(self.centres.T)

    def unit(self, terms: np.ndarray) -> np.ndarray:
        ranks, out = self.rank[terms], np.zeros(len(self.idf), np.float32)
        ranks = ranks[ranks < len(out)]
        out[ranks] = self.idf[ranks]
        return out / max(float(np.sqrt((out**2).sum())), 1e-9)

    def of(self, ranks: np.ndarray) -> int:
        """The group of a row, by the ranks of its terms."""
        ranks = ranks[ranks < len(self.idf)]
        return int((self.idf[ranks] @ self.columns[ranks]).argmax())


class _Lists:
    """Lists of postings, one after the other."""

    def __init__(self, first: np.ndarray, postings: np.ndarray):
        self.kind, self.at = postings.dtype, first * postings.itemsize
        # They are copied as if they were texts.
        self.texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(self.at), pa.py_buffer(postings.view(np.uint8))])

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of some lists, and their postings."""
        sizes = (self.at[at + 1] - self.at[at]) // self.kind.itemsize
        total = int(sizes.sum())
        return sizes, np.frombuffer(self.texts.take(pa.array(at)).buffers()[2], self.kind, total) if total else np.zeros(0, self.kind)

    def sums(self, at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        sizes, found = self.read(at)
        weights = np.repeat(weights, sizes)
        weights *= found["weight"]
        return np.bincount(found["example"], weights, n).astype(np.float64, copy=False)


class _Lot:
    """What queries of one block share: the (term, block) lists that many of them need, dense, and what is left of the lists of those terms."""

    def __init__(self, index: BlockMaxIndex, queries: list[np.ndarray]):
        self.index, self.panels, blocks = index, {}, len(index.blocks)
        some = np.concatenate(queries)
        count = np.bincount(some[some < index.often], minlength=index.often)
        dense = self._dense(count, len(queries))
        terms = np.flatnonzero(dense.any(1))
        #: Terms with a dense list, and their places in ``rest``.
        self.cut, self.place = np.zeros(len(index.rank), bool), np.zeros(index.often, np.int64)
        self.cut[terms] = True
        self.place[terms] = np.arange(len(terms))
        term, block = np.nonzero(~dense[terms])
        sizes, found = index.parts.read(terms[term] * blocks + block)
        self.rest = _Lists(np.append(0, np.cumsum(np.bincount(term, sizes, len(terms)))).astype(np.int64), found)
        self.columns = np.full((blocks, index.often), -1, np.int32)
        for g in range(blocks):
            mine = np.flatnonzero(dense[:, g])
            self.columns[g, mine] = np.arange(len(mine))

    def _dense(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The lists that cost less as columns of a matrix, from how many of ``n`` queries have each term; the best of them, if they don't all fit."""
        held, members = self.index.held, self.index.members
        out = np.zeros(held.shape, bool)
        at = np.flatnonzero(queries > 1)
        saved = (queries[at, None] - 1) * held[at].astype(np.int64) * CELLS - n * members
        term, block = np.nonzero(saved > 0)
        best = np.argsort(-saved[term, block] / members[block], kind="stable")
        best = best[: np.searchsorted(np.cumsum(4 * members[block[best]]), DENSE_BYTES, side="right")]
        out[at[term[best]], block[best]] = True
        return out

    def panel(self, g: int) -> _Panel:
        """The matrix of a block, made when first asked for."""
        if g not in self.panels:
            terms, block = np.flatnonzero(self.columns[g] >= 0), self.index.blocks[g]
            matrix = np.zeros((len(block), len(terms)), np.float32)
            for lo in range(0, len(terms), 32):  # few lists at a time, as positions are wide
                sizes, found = self.index.parts.read(terms[lo : lo + 32] * len(self.index.blocks) + g)
                matrix[found["example"].astype(np.int64) - block.start, np.repeat(np.arange(lo, lo + len(sizes)), sizes)] = found["weight"]
            self.panels[g] = _Panel(block.start, block.stop, matrix)
        return self.panels[g]


class BlockMaxIndex:
    """All terms of all examples as postings: examples in blocks of similar ones, the lists of frequent terms cut by block.

    Queries of one block make a lot.  (Term, block) lists that many of them need become a dense matrix for the lot; all others are summed for
    each query.  A block's matrix is passed over for a query if the greatest sum of postings there and the greatest norm of a row can't bring an
    example among the nearest.
    """

    def __init__(self, examples: PackedExamples | list[tuple[int, int, list[int], list[float]]], n_terms: int):
        n = len(examples)
        self.ids, self.toxic, self.blocks = np.zeros(n, np.int64), np.zeros(n), []
        if not n:
            return
        packed = isinstance(examples, PackedExamples)
        ends = np.append(0, np.cumsum(examples.sizes() if packed else [len(e[2]) for e in examples], dtype=np.int64))
        # One array, as the memory of many small ones is not given back.
        held, lots = np.empty(ends[-1], np.int32), [range(lo, min(lo + 1000, n)) for lo in range(0, n, 1000)]
        each = [held[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for mine, terms in zip(each, examples.terms() if packed else (e[2] for e in examples)):
            mine[:] = terms
        size = np.zeros(n_terms, np.int64)
        for lot in lots:
            size += np.bincount(held[ends[lot.start] : ends[lot.stop]], minlength=n_terms)
        # Terms are numbered by how many examples have them, so that what most queries read lies together.
        most = np.argsort(-size, kind="stable")
        self.rank = np.empty(n_terms, np.int32)
        self.rank[most] = np.arange(n_terms)
        size = size[most]
        self.groups = _Groups(size, self.rank, n, each[:: -(-n // GROUP_ROWS)])
        blocks = len(self.groups.centres)
        # The lists of terms that enough examples have are cut by block.
        self.often = often = int((size > n // 64 // blocks).sum())
        group, self.held = np.zeros(n, np.int64), np.zeros((often, blocks), np.int32)
        for lot in lots:
            ranks = held[ends[lot.start] : ends[lot.stop]]
            ranks[:] = self.rank[ranks]
            group[lot.start : lot.stop] = [self.groups.of(each[k]) for k in lot]
            lists = ranks.astype(np.int64) * blocks + np.repeat(group[lot.start : lot.stop], np.diff(ends[lot.start : lot.stop + 1]))
            self.held += np.bincount(lists[ranks < often], minlength=often * blocks).reshape(often, blocks)
        #: Positions of the examples block by block, and the place of each position there.
        self.order = np.argsort(group, kind="stable")
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.members = np.bincount(group, minlength=blocks)
        stops = np.cumsum(self.members)
        self.blocks = [range(a, b) for a, b in zip((stops - self.members).tolist(), stops.tolist())]
        first = np.append(0, np.cumsum(np.append(self.held.ravel(), size[often:])))
        narrow = np.uint16 if n <= 1 << 16 else np.int32
        # A posting lies in one piece, so that a list is found by one read.
        self.postings = np.zeros(first[-1], [("example", narrow), ("weight", np.float32)])
        self.example, self.weight = self.postings["example"], self.postings["weight"]
        free, self.norms = first[:-1].copy(), np.zeros(blocks)
        for k, (self.ids[k], self.toxic[k], terms, weights) in enumerate(examples):
            ranks = each[k].astype(np.int64)
            lists = np.where(ranks < often, ranks * blocks + group[k], ranks + often * (blocks - 1))
            at = free[lists]
            self.example[at], self.weight[at] = place[k], weights
            free[lists] = at + 1
            self.norms[group[k]] = max(self.norms[group[k]], np.linalg.norm(weights))
        del held, each, free
        #: The lists of whole terms, and those cut by block.
        self.whole = _Lists(np.append(first[: often * blocks : blocks], first[often * blocks :]), self.postings)
        self.parts = _Lists(first[: often * blocks + 1], self.postings)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of greatest cosine, ties by position, and their cosines.  Only positive cosines count."""
        return self.nearest_of_each([(terms, weights)], k)[0]

    def nearest_of_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for several queries.

        Postings are summed in double precision for all examples.  Products in single precision add the dense matrices, first that of a query's own
        block; the others only if they may hold one of the nearest.  Examples that may be among the nearest by these sums
        are summed again in double precision, so results don't depend on what is scored together.
        """
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        ranked, out = [(self.rank[terms], np.asarray(weights)) for terms, weights in queries], [None] * len(queries)
        home = np.array([self.groups.of(ranks) for ranks, _ in ranked], np.int64)
        for g in np.unique(home):
            mine = np.flatnonzero(home == g)
            lot = _Lot(self, [ranked[j][0] for j in mine])
            for lo in range(0, len(mine), AT_ONCE):
                some = mine[lo : lo + AT_ONCE]
                for j, found in zip(some, self._nearest(lot, [ranked[j] for j in some], int(g), k)):
                    out[j] = found
        return out

    def _nearest(self, lot: _Lot, some: list[tuple[np.ndarray, np.ndarray]], home: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(self.ids)
        row = np.repeat(np.arange(len(some)), [len(ranks) for ranks, _ in some])
        rank, weight = np.concatenate([ranks for ranks, _ in some]), np.concatenate([weights for _, weights in some])
        at = np.flatnonzero(lot.cut[rank])
        row, rank, weight = row[at], rank[at], weight[at]
        rare = np.empty((len(some), n))
        for j, (ranks, weights) in enumerate(some):
            cut = lot.cut[ranks]
            rare[j] = self.whole.sums(ranks[~cut], weights[~cut], n)
            if cut.any():
                rare[j] += lot.rest.sums(lot.place[ranks[cut]], weights[cut], n)
        near, panels = rare.astype(np.float32), []
        least = None
        for g in [home, *(g for g in range(len(self.blocks)) if g != home)]:
            b, column = self.blocks[g], lot.columns[g]
            at = np.flatnonzero(column[rank] >= 0)
            if not len(at):
                continue
            which = np.arange(len(some))
            if g != home:
                if least is None:
                    # What is known so far is at most the whole sum, so the least of the best k of it bounds what must be found.
                    least = _least(near, k)
                weighs = np.sqrt(np.bincount(row[at], weight[at] ** 2, len(some)))
                bound = rare[:, b.start : b.stop].max(1, initial=0.0) + weighs * self.norms[g]
                which = np.flatnonzero((weighs > 0) & (bound >= least - 1e-4))
                if not len(which):
                    continue
            weights = np.zeros((len(some), int(column.max()) + 1))
            weights[row[at], column[rank[at]]] = weight[at]
            panels.append((lot.panel(g), weights))
            self._add(near, weights.astype(np.float32), panels[-1][0], which)
        least, edges = _least(near, k), [(p.start, p.stop) for p, _ in panels]
        for j in range(len(some)):
            may = np.flatnonzero(near[j] >= max(least[j] - 1e-4, 1e-30))
            cosine = rare[j, may]
            for (p, weights), (lo, hi) in zip(panels, np.searchsorted(may, edges)):
                for a in range(lo, hi, 512):
                    x = slice(a, min(a + 512, hi))
                    cosine[x] += (p.dense[may[x] - p.start] * weights[j]).sum(1)
            cosine, may = np.round(cosine, 6), self.order[may]
            best = np.lexsort((may, -cosine))[:k]
            best = best[cosine[best] > 0]
            yield may[best], np.minimum(cosine[best], 1.0)

    @staticmethod
    def _add(near: np.ndarray, dense: np.ndarray, block: _Panel, which: np.ndarray) -> None:
        if len(which):
            near[which, block.start : block.stop] += dense[which] @ block.dense.T


def _least(near: np.ndarray, k: int) -> np.ndarray:
    """At most the ``k``-th greatest of each row: that of the greatest of every 16, as those are different ones; the very one if a row is short."""
    n = near.shape[1]
    if n <= k:
        return np.zeros(len(near))
    wide = n // 16
    if wide < 8 * k:
        return np.array([np.partition(x, n - k)[n - k] for x in near])
    return np.array([np.partition(x[: 16 * wide].reshape(16, wide).max(0), wide - k)[wide - k] for x in near])


@dataclass(frozen=True)
class ToxicityModel:
    vocabulary: Vocabulary
    weights: np.ndarray
    examples: PackedExamples
    blank_rate: float
    base_rate: float

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Built once in each worker."""
        return BlockMaxIndex(self.examples, len(self.weights))


def _evidence(n: np.ndarray, p: np.ndarray, base: float) -> np.ndarray:
    """Root of the log likelihood ratio of ``p`` toxic among ``n`` examples against the base rate; 0 if there are fewer than that."""
    ok = n - p
    more = (p > n * base) & (base < 1)
    ratio = p * np.log(np.where(more, p / n / max(base, 1e-9), 1)) + ok * np.log(np.where(more & (ok > 0), ok / n / max(1 - base, 1e-9), 1))
    return np.sqrt(np.maximum(ratio, 0))


def learn_toxicity(labelled: DataFrame, corpus: DataFrame, most_examples: int = 20_000) -> ToxicityModel:
    """Index labelled examples.  ``labelled(doc_id, toxic)`` are the labels to learn from, ``corpus(doc_id, text)`` has the texts.

    At most ``most_examples`` labels are used, the first in the order of a hash of doc_id; that bounds the model, which
    is broadcast.  Terms are all words of the examples, and beginnings of words (of ``STEMS`` bytes).  A term weighs its TF-IDF, with document
    frequencies over all rows of ``corpus``, times one plus the root of the log likelihood ratio by which its examples are toxic more often
    than the base rate, so that no term is without weight and words tied to the label lead.

    Null labels and doc_ids are left out, a document labelled twice is toxic if any label says so, labels without a
    document are ignored; without examples the base rate is 0.
    """
    spark = corpus.sparkSession
    chosen = labelled.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples)
    texts = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most ``most_examples`` rows of two numbers.
    examples = texts.join(F.broadcast(chosen), "doc_id")
    totals = examples.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    n, p = totals["n"] or 0, totals["p"] or 0
    base = p / n if n else 0.0
    counts = examples.mapInArrow(_term_counts, "term long, n long, p long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    table = counts.toArrow()
    terms = table.column("term").to_numpy().view(np.uint64)
    order = np.argsort(terms)
    terms, seen, toxic = terms[order], table.column("n").to_numpy()[order], table.column("p").to_numpy()[order]
    del table
    vocabulary = Vocabulary(terms)
    shared = spark.sparkContext.broadcast(vocabulary)
    length = -(-(len(terms) + 1) // CHUNK) * CHUNK
    held = summed(texts.mapInArrow(_document_counts(shared, length), PARTS), length).get("", np.zeros(length, np.int64))
    weights = (np.log((1 + held[-1]) / (1 + held[: len(terms)])) + 1) * (1 + _evidence(seen, toxic, base))
    rows = examples.mapInArrow(_example_terms(shared), "doc_id long, toxic int, held binary").collect()
    blank = [r["toxic"] for r in rows if not r["held"]]
    packed = PackedExamples(sorted((r["doc_id"], r["toxic"], bytes(r["held"])) for r in rows if r["held"]), weights)
    blank_rate = (sum(blank) + base) / (len(blank) + 1)
    return ToxicityModel(vocabulary, weights, packed, blank_rate, base)


def _score(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ToxicityModel = shared.value
        known: dict[bytes, tuple[float, list[int]]] = {}
        for batch in batches:
            score, near = [model.blank_rate] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            waiting: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            rows: list[tuple[int, bytes]] = []

            def answer() -> None:
                for key, (found, cosine) in zip(waiting, model.index.nearest_of_each(list(waiting.values()), k)):
                    vote = 1 / (NEAR + 1 - cosine)
                    share = (vote @ model.index.toxic[found] + PRIOR * model.base_rate) / (vote.sum() + PRIOR)
                    known[key] = float(min(max(share, 0.0), 1.0)), model.index.ids[found].tolist()
                for row, key in rows:
                    score[row], near[row] = known[key]
                waiting.clear()
                rows.clear()
                if len(known) > 50_000:
                    known.clear()

            for row, terms, weights in _vectors(model.vocabulary, model.weights, batch.column("text")):
                key = hashlib.blake2b(terms.tobytes() + weights.tobytes(), digest_size=16).digest()
                rows.append((row, key))
                if key not in known:
                    waiting[key] = terms, weights
                    if len(waiting) == WAITING:
                        answer()
            answer()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"]
            )

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, k: int = 15) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row of ``docs(doc_id, text)``, from whole texts.

    The ``k`` examples of greatest cosine vote, each with weight ``1 / (NEAR + 1 - cosine)``, and the base rate with weight
    ``PRIOR``; ``evidence`` lists their doc_ids.  A text without a term of the vocabulary, such as a null or empty
    one, gets the rate of the examples without one.  Equal cosines are taken in the order of the examples' doc_ids.  Repeated rows and null
    doc_ids are answered as they are; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(shared, k), "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
