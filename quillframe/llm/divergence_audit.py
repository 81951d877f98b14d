"""Source divergence audit: exact document frequencies fix the terms, sharded minimal perfect hashes count them anew for each source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import checkpointed, temporary_conf
from .words import Words, bytes_list, mix, seeds, slices, text_bytes

#: Bytes of text handled at once, and sent to a worker at once.
SLICE_BYTES, BATCH_BYTES, BATCH_ROWS = 2 << 20, 4 << 20, 1000
#: Terms of one shard, sources compared with each other at once, and tasks whose counts are summed first.
SHARD_TERMS, TILE, FIRST_LEVEL = 1 << 13, 128, 256
#: Bytes of terms whose perfect hashes are broadcast, what a term counts besides its own bytes, and counts that a task holds.
HEAD_BYTES, TERM_OVERHEAD, HELD_SLOTS = 24 << 20, 16, 1 << 22
SCALE = 1_000_000_000

#: One number for each level of a perfect hash; far fewer are ever used.
_LEVELS = seeds(256, 11)
#: A-Z lower-cased; every byte that is in no term as space.
TERMS = np.full(256, 32, np.uint8)
TERMS[97:123] = TERMS[65:91] = np.arange(97, 123)
TERMS[128:] = np.arange(128, 256)

FREQUENCIES = "lang string, term string, n_docs long"
SHARDS = "lang string, shard int, n_terms int, sizes array<int>, bits binary, terms array<string>"
COUNTS = "lang string, source string, shard int, part int, counts binary, n long, term string"
_COUNTS = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()),
    ("n", pa.int64()), ("term", pa.string()),
])
FOUND = "lang string, source string, other string, term string, value long"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.string()), ("value", pa.int64())])


def packed(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def probabilities(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) by long division, exact for totals up to 9e15."""
    rest, out = counts + 1, np.zeros(counts.shape, np.int64)
    out, rest = np.divmod(rest, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def perfect_hash(hashes: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of levels in bits, their bits, and the keys in slot order, for distinct 64-bit hashes.

    In each level every key left takes one of twice as many places; keys alone in theirs stay there, the others
    go on to the next level.  A key's slot is the number of places taken before its own.
    """
    left, sizes, bits, order = np.arange(len(hashes)), [], [], []
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = (mix(hashes[left] + _LEVELS[len(sizes)]) % np.uint64(size)).astype(np.int64)
        times = np.bincount(at, minlength=size)
        alone = times[at] == 1
        sizes.append(size)
        bits.append(times == 1)
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    none = np.zeros(0, np.int64)
    return sizes, np.concatenate(bits) if bits else none.astype(bool), np.concatenate(order) if order else none


class Lexicon:
    """The perfect hashes of one language's shards, side by side, with the stored terms that prove a hit."""

    def __init__(self, shards: list[dict]):
        self.edges = np.concatenate([[0], np.cumsum([s["n_terms"] for s in shards])])
        levels = max(len(s["sizes"]) for s in shards)
        self.sizes, self.bases = np.zeros((len(shards), levels), np.uint64), np.zeros((len(shards), levels), np.int64)
        at = 0
        for k, s in enumerate(shards):
            for level, size in enumerate(s["sizes"]):
                self.sizes[k, level], self.bases[k, level] = size, at
                at += size
        bits = np.concatenate([np.frombuffer(s["bits"], np.uint8) for s in shards])
        self.words = bits.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        sizes = np.concatenate([s["widths"] for s in shards])
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        body = b"".join(s["body"] for s in shards)
        self.terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(body)])

    def slots(self, terms: pa.LargeBinaryArray, hashes: np.ndarray) -> np.ndarray:
        """Slot of each term, or -1 for terms that are not stored."""
        shard = hashes.astype(np.int64) % len(self.sizes)
        slot, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shard[left], level] > 0]
            if not len(left):
                break
            size = self.sizes[shard[left], level]
            at = self.bases[shard[left], level] + (mix(hashes[left] + _LEVELS[level]) % size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        known = np.flatnonzero(slot >= 0)
        same = pc.equal(self.terms.take(pa.array(slot[known])), terms.take(pa.array(known)))
        slot[known[~np.asarray(same)]] = -1
        return slot


def hashes_of(terms: list[bytes]) -> np.ndarray:
    """The hash that Spark's xxhash64 gives the same text."""
    return np.fromiter(map(xxhash.xxh64_intdigest, terms, repeat(42)), np.uint64, len(terms))


def _occurrences(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(first row, last row, distinct terms, index of each occurrence's term, row of each occurrence) slice by slice."""
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in slices(offsets, SLICE_BYTES):
        words = Words((lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], TERMS)
        if not len(words.starts):
            continue
        ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
        body = np.ascontiguousarray(words.data[words.data != 32])
        found = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)]
        ).dictionary_encode()
        yield lo, hi, found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(lo, hi), words.counts)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of each language hold a term, slice by slice."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        lang_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for _, _, terms, term, row in _occurrences(batch):
            n = len(terms)
            each = np.sort(row * n + term)
            each = each[np.append(True, each[1:] != each[:-1])]
            keys, counts = np.unique(lang_of[each // n] * n + each % n, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(keys // n)).cast(pa.string()), terms.take(pa.array(keys % n)).cast(pa.large_string()).cast(pa.string()),
                 pa.array(counts.astype(np.int64))],
                names=["lang", "term", "n_docs"],
            )


def _built(table: pa.Table) -> pa.Table:
    """The perfect hash of one shard, and its terms in slot order."""
    terms = table.column("term").to_pylist()
    sizes, bits, order = perfect_hash(hashes_of([t.encode() for t in terms]))
    return pa.table({
        "lang": table.column("lang").slice(0, 1), "shard": table.column("shard").slice(0, 1), "n_terms": pa.array([len(terms)], pa.int32()),
        "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()]),
        "terms": pa.array([[terms[k] for k in order]], pa.list_(pa.string())),
    })


def _listed(table: pa.Table) -> pa.Table:
    """A shard that is not broadcast: its terms in order."""
    terms = sorted(table.column("term").to_pylist())
    return pa.table({
        "lang": table.column("lang").slice(0, 1), "shard": table.column("shard").slice(0, 1), "n_terms": pa.array([len(terms)], pa.int32()),
        "sizes": pa.array([None], pa.list_(pa.int32())), "bits": pa.array([None], pa.binary()), "terms": pa.array([terms], pa.list_(pa.string())),
    })


_LEXICONS: dict = {}


def _lexicons(shared) -> dict[str, Lexicon]:
    """Workers are reused; one keeps the structure it has made of the last broadcast."""
    if shared.id not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[shared.id] = {lang: Lexicon(shards) for lang, shards in shared.value.items()}
    return _LEXICONS[shared.id]


class _Shared:
    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_COUNTS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)


class _Counts:
    """Counts by slot for every (language, source) of a task, as pieces that are added up when they are many."""

    def __init__(self, lexicons: dict[str, Lexicon]):
        self.lexicons, self.size = lexicons, 0
        self.pieces: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, group: tuple[str, str], slots: np.ndarray, times: np.ndarray) -> None:
        self.pieces.setdefault(group, []).append((slots.astype(np.int32), times.astype(np.int32)))
        self.size += len(slots)

    def dense(self, group: tuple[str, str]) -> np.ndarray:
        total = np.zeros(self.lexicons[group[0]].edges[-1], np.int64)
        for slots, times in self.pieces[group]:
            # A piece has each slot once.
            total[slots] += times
        return total

    def shrink(self) -> None:
        """One piece for each group; sums beyond 32 bits stay as they were."""
        for group, pieces in self.pieces.items():
            if len(pieces) > 1:
                total = self.dense(group)
                if total.max(initial=0) < 1 << 31:
                    slots = np.flatnonzero(total)
                    self.pieces[group] = [(slots.astype(np.int32), total[slots].astype(np.int32))]
        self.size = sum(len(slots) for pieces in self.pieces.values() for slots, _ in pieces)


def _recounted(shared: _Shared, tail: bool):
    """Dense slots of every (language, source) of a task; terms that are not stored are sent by themselves if ``tail``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // FIRST_LEVEL
        lexicons = _lexicons(shared)
        held = _Counts(lexicons)

        def sent() -> pa.RecordBatch:
            rows = []
            for lang, source in held.pieces:
                counts, edges = held.dense((lang, source)), lexicons[lang].edges
                for shard, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    n = int(counts[a:b].sum())
                    if n:
                        rows.append((lang, source, shard, part, packed(counts[a:b]), n, None))
            return _rows(rows)

        for batch in batches:
            langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            lang_names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
            group_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source_names) + sources.indices.to_numpy(zero_copy_only=False)
            for _, _, terms, term, row in _occurrences(batch):
                n, hashes = len(terms), hashes_of(bytes_list(terms))
                keys, counts = np.unique(group_of[row] * n + term, return_counts=True)
                cut = np.flatnonzero(np.diff(keys // n, prepend=-1))
                slots: dict[str, np.ndarray] = {}
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
                    lang, source = (names[int(k)] for names, k in zip((lang_names, source_names), divmod(int(keys[a]) // n, len(source_names))))
                    if lang not in slots:
                        slots[lang] = np.full(n, -1, np.int64)
                        if lang in lexicons:
                            # Groups are in order of languages, so the terms of this one lie together.
                            stop = np.searchsorted(keys, (int(keys[a]) // n // len(source_names) + 1) * len(source_names) * n)
                            mine = np.zeros(n, bool)
                            mine[keys[a:stop] % n] = True
                            mine = np.flatnonzero(mine)
                            slots[lang][mine] = lexicons[lang].slots(terms.take(pa.array(mine)), hashes[mine])
                    at, times = slots[lang][keys[a:b] % n], counts[a:b]
                    stored = at >= 0
                    if stored.any():
                        held.add((lang, source), at[stored], times[stored])
                    if tail:
                        rest = np.flatnonzero(at < 0)
                        names = terms.take(pa.array(keys[a:b][rest] % n)).cast(pa.large_string()).to_pylist()
                        yield _rows([(lang, source, None, None, None, int(t), name) for t, name in zip(times[rest], names)])
                if held.size > HELD_SLOTS:
                    held.shrink()
                    if held.size > HELD_SLOTS // 2:
                        yield sent()
                        held = _Counts(lexicons)
        yield sent()

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(unpacked(x.as_buffer()) for x in table.column("counts"))
    first = table.slice(0, 1)
    return pa.Table.from_arrays(
        [*[first.column(c).combine_chunks() for c in ("lang", "source", "shard", "part")], pa.array([packed(total)]),
         pa.array([int(total.sum())], pa.int64()), pa.array([None], pa.string())], schema=_COUNTS
    )


_CELLS = "lang string, shard int, tile int, source string, counts binary"


def _tail_cells(left: pa.Table, right: pa.Table) -> pa.Table:
    """Dense counts of a shard that was not broadcast, for the sources of one tile."""
    rows = {}
    if left.num_rows and right.num_rows:
        place = {t: k for k, t in enumerate(left.column("terms")[0].as_py())}
        for source, term, n in zip(*(right.column(c).to_pylist() for c in ("source", "term", "n"))):
            rows.setdefault(source, np.zeros(len(place), np.int64))[place[term]] += n
    m = len(rows)
    one = {c: (right.column(c)[0].as_py() if m else None) for c in ("lang", "shard", "tile_no")}
    return pa.table({
        "lang": pa.array([one["lang"]] * m, pa.string()), "shard": pa.array([one["shard"]] * m, pa.int32()), "tile": pa.array([one["tile_no"]] * m, pa.int32()),
        "source": pa.array(list(rows), pa.string()), "counts": pa.array([packed(c) for c in rows.values()], pa.binary()),
    })


def _compared(top: int):
    """One shard, and the sources of two tiles: sums of all pairs, and the best terms if the tiles are the same one."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _FOUND.empty_table()
        work = left.to_pylist()[0]
        n, lang, same = work["n_terms"], work["lang"], work["tile_a"] == work["tile_b"]
        sides, in_lang = [], np.zeros(n, np.int64)
        for name in ("a", "b")[: 1 if same else 2]:
            members = work[f"members_{name}"]
            counts = np.zeros((len(members), n), np.int64)
            sides.append(([m["source"] for m in members], np.array([[m["total"] + work["n_kept"]] for m in members]), counts))
        place = [{s: k for k, s in enumerate(names)} for names, _, _ in sides]
        for side, source, held in zip(*(right.column(c).to_pylist() for c in ("side", "source", "counts"))):
            if side == 2:
                in_lang += unpacked(held)
            else:
                sides[side][2][place[side][source]] = unpacked(held)
        chances = [probabilities(counts, totals) for _, totals, counts in sides]
        rows = []
        for k, source in enumerate(sides[0][0]):
            q = chances[-1]
            gap = chances[0][k] - q
            values = (gap * gap // q).sum(axis=1).tolist()
            rows += [(lang, source, other, None, v) for other, v in zip(sides[-1][0], values) if other != source]
        if same:
            q = probabilities(in_lang, work["lang_total"] + work["n_kept"])
            for k, source in enumerate(sides[0][0]):
                at = np.flatnonzero((sides[0][2][k] > 0) & (chances[0][k] > q))
                gap = chances[0][k][at] - q[at]
                value = gap * gap // q[at]
                if len(at) > top:
                    keep = value >= np.partition(value, len(at) - top)[len(at) - top]
                    at, value = at[keep], value[keep]
                best = sorted(zip((-value).tolist(), [work["terms"][j].encode() for j in at]))[:top]
                rows += [(lang, source, None, t.decode(), -v) for v, t in best]
        columns = list(zip(*rows)) if rows else [()] * len(_FOUND)
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


def divergence_audit(docs: DataFrame, least_docs: int = 3, top: int = 200, head_bytes: int = HEAD_BYTES, shard_terms: int = SHARD_TERMS,
                     tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) for the (lang, source) groups of ``docs(text, lang, source)``; null is ''.

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII.  Each language keeps the V terms that ``least_docs`` of its rows
    hold.  In a group of N occurrences of kept terms, a term with ``count`` has ``p = 1 + floor(10**9 * (count + 1) / (N + V))``; the divergence of p from q
    is ``floor((p - q)**2 / q)``.  Part ``pair`` has, for each other source of the language, the sum over all kept terms with q
    that source's, 0 without kept terms; part ``term`` the group's ``top`` terms with a higher p than in the whole language, q being that one.
    Ranks are by value, then by the item's bytes.  Groups without terms count; repeated rows count as often as they
    occur; doc_ids and other columns are ignored; an empty table gives an empty result.

    A first pass counts exactly how many rows hold each term.  Kept terms are dealt to shards of about ``shard_terms``, each with a minimal perfect hash and
    the terms themselves.  Hashes of the most frequent terms, up to ``head_bytes``, are broadcast; the second pass looks every occurrence up, proves it by
    the stored term and adds it to the dense slots of its group, which are summed in two levels.  Terms beyond the bound, and those that share a 64-bit
    hash, are counted by a shuffle instead and join the same shards' work.  Groups are compared shard by shard, ``tile`` sources with ``tile`` others
    at a time, so neither the number of terms nor that of sources bounds what one task holds.
    """
    spark = docs.sparkSession
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    seen = plain.select("lang", "text").mapInArrow(_frequencies, FREQUENCIES).groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))
    by_hash = W.partitionBy("lang", "hash")
    kept = seen.where(F.col("n_docs") >= least_docs).withColumn("hash", F.xxhash64("term"))
    small_batches = {"spark__sql__execution__arrow__maxBytesPerBatch": str(BATCH_BYTES), "spark__sql__execution__arrow__maxRecordsPerBatch": str(BATCH_ROWS)}
    with temporary_conf(spark, **small_batches):
        kept = checkpointed(kept.withColumn("alone", F.count(F.lit(1)).over(by_hash) == 1).withColumn("tier", F.floor(F.log2("n_docs")).cast("int")))

    # The broadcast terms: whole tiers of document frequency, from the top, while they fit.
    bytes_of = F.sum(F.octet_length("term") + TERM_OVERHEAD).alias("size")
    tiers = kept.groupBy("tier").agg(bytes_of, F.min("alone").alias("alone")).orderBy(F.desc("tier")).collect()
    used, least_tier = 0, 64
    for r in tiers:
        if used + r["size"] > head_bytes:
            break
        used, least_tier = used + r["size"], r["tier"]
    tail = any(r["tier"] < least_tier or not r["alone"] for r in tiers)
    in_head = (F.col("tier") >= least_tier) & F.col("alone")
    placed = kept.withColumn("head", in_head)
    sizes = placed.groupBy("lang", "head").agg(F.ceil(F.count(F.lit(1)) / shard_terms).alias("n_shards"))
    wide = sizes.groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("head"), F.col("n_shards"))), F.lit(0)).alias("head_shards"),
        F.coalesce(F.max(F.when(~F.col("head"), F.col("n_shards"))), F.lit(0)).alias("tail_shards"),
    )
    shard = F.when(F.col("head"), F.pmod("hash", "head_shards")).otherwise(F.col("head_shards") + F.pmod("hash", "tail_shards")).cast("int")
    placed = placed.join(wide, "lang").select("lang", "term", "head", shard.alias("shard"))
    shards = placed.where("head").groupBy("lang", "shard").applyInArrow(_built, SHARDS)
    if tail:
        shards = shards.unionByName(placed.where("NOT head").groupBy("lang", "shard").applyInArrow(_listed, SHARDS))
    shards = checkpointed(shards)
    held: dict[str, list[tuple[int, dict]]] = {}
    for s in shards.where("bits IS NOT NULL").orderBy("lang", "shard").toLocalIterator():
        terms = [t.encode() for t in s["terms"]]
        compact = {"n_terms": s["n_terms"], "sizes": s["sizes"], "bits": bytes(s["bits"]), "body": b"".join(terms),
                   "widths": np.array([len(t) for t in terms], np.int32)}
        held.setdefault(s["lang"], []).append((s["shard"], compact))
    n_shards = {r["lang"]: r["head_shards"] for r in wide.where("head_shards > 0").collect()}
    lexicons = {lang: _filled(found, n_shards[lang]) for lang, found in held.items()}
    shared = _Shared(spark.sparkContext.broadcast(lexicons), uuid.uuid4().hex)

    with temporary_conf(spark, **small_batches):
        counted = checkpointed(plain.mapInArrow(_recounted(shared, tail), COUNTS))
    dense = counted.where("counts IS NOT NULL")
    dense = dense.groupBy("lang", "source", "shard", "part").applyInArrow(_added, COUNTS).withColumn("part", F.lit(0))
    dense = checkpointed(dense.groupBy("lang", "source", "shard").applyInArrow(_added, COUNTS)).select("lang", "source", "shard", "counts", "n")
    totals = dense.select("lang", "source", "n")
    if tail:
        rest = counted.where("term IS NOT NULL").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        rest = checkpointed(rest.join(placed.where("NOT head").select("lang", "term", "shard"), ["lang", "term"]))
        totals = totals.unionByName(rest.select("lang", "source", "n"))

    vocabulary = shards.groupBy("lang").agg(F.sum("n_terms").cast("long").alias("n_kept"))
    totals = totals.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = checkpointed(groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        F.floor(number / tile).cast("int").alias("tile"),
    ))
    members = groups.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("members"))
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.max("n_kept").alias("n_kept"), (F.max("tile") + 1).alias("tiles")
    )
    side = lambda x: members.select("lang", F.col("tile").alias(f"tile_{x}"), F.col("members").alias(f"members_{x}"))
    work = shards.select("lang", "shard", "n_terms", "terms").join(langs, "lang").join(side("a"), "lang").join(side("b"), "lang")
    work = work.withColumn("terms", F.when(F.col("tile_a") == F.col("tile_b"), F.col("terms"))).drop("tiles")

    cells = dense.join(groups.select("lang", "source", "tile"), ["lang", "source"]).select("lang", "shard", "tile", "source", "counts")
    if tail:
        # Both sides come from ``groups``; renamed columns keep them apart.
        tiled = rest.join(groups.select("lang", "source", F.col("tile").alias("tile_no")), ["lang", "source"])
        lists = shards.where("bits IS NULL").select("lang", "shard", "terms").join(members.select("lang", F.col("tile").alias("tile_no")), "lang")
        cells = cells.unionByName(
            lists.groupBy("lang", "shard", "tile_no").cogroup(tiled.toDF(*tiled.columns).groupBy("lang", "shard", "tile_no")).applyInArrow(_tail_cells, _CELLS)
        )
        cells = checkpointed(cells)
    wide_cells = cells.join(langs.select("lang", "tiles"), "lang")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    as_a = wide_cells.select("lang", "shard", F.col("tile").alias("tile_a"), other.alias("tile_b"), F.lit(0).alias("side"), "source", "counts")
    as_b = wide_cells.where("tiles > 1").select(
        "lang", "shard", other.alias("tile_a"), F.col("tile").alias("tile_b"), F.lit(1).alias("side"), "source", "counts"
    ).where("tile_a <> tile_b")
    in_lang = cells.select("lang", F.lit("").alias("source"), "shard", F.col("tile").alias("part"), "counts", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("term"))
    in_lang = in_lang.groupBy("lang", "shard", "part").applyInArrow(_added, COUNTS).withColumn("part", F.lit(0))
    in_lang = in_lang.groupBy("lang", "shard").applyInArrow(_added, COUNTS).join(langs.select("lang", "tiles"), "lang")
    in_lang = in_lang.select("lang", "shard", other.alias("tile_a"), F.lit(2).alias("side"), "source", "counts")
    in_lang = in_lang.select("lang", "shard", "tile_a", F.col("tile_a").alias("tile_b"), "side", "source", "counts")
    rows = as_a.unionByName(as_b).unionByName(in_lang)
    key = ["lang", "shard", "tile_a", "tile_b"]
    found = checkpointed(work.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_compared(top), FOUND))

    pairs = found.where("other IS NOT NULL").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    bare = groups.where("n_kept = 0").select("lang", "source")
    nothing = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.unionByName(nothing.select(pairs.columns)).withColumn("part", F.lit("pair")).withColumn("rank", ranked)
    terms = found.where("term IS NOT NULL").select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    terms = terms.withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.select(columns).unionByName(terms.select(columns))


def _filled(shards: list[tuple[int, dict]], n: int) -> list[dict]:
    """A shard that happened to get no term is an empty one, so that list places are shard numbers."""
    known = dict(shards)
    blank = {"n_terms": 0, "sizes": [], "bits": b"", "body": b"", "widths": np.zeros(0, np.int32)}
    return [known.get(k, blank) for k in range(n)]
