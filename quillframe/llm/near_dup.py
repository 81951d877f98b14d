"""MinHash near-duplicates by tensored banding: table keys combine one sketch from each of two collections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .array_sums import PARTS, parts_of, summed
from .components import components
from .words import LOWER, Words, mix, seeds, words_of

#: Members of one list that are compared with the whole list in one unit of work.
BLOCK = 500
#: Slots in which shingles are counted to put rare ones first.
SLOTS = 1 << 16
#: Hubs that the buckets of one group have between them in each round.
HUBS = 8
#: MinHash values behind the estimate, and bits kept of each.
ESTIMATORS, SHARES = 96, 2

FEATURES = "doc_id long, n_shingles long, digest binary, left array<long>, right array<long>, bits0 long, bits1 long, bits2 long"
SETS = "doc_id long, shingles binary"


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and their bounds.

    A row with fewer than ``size`` words, but at least one, has its whole word sequence as its only shingle.
    """
    at, value = words.windows(size)
    row = words.row_of(at)
    for short in range(1, size):
        whole, hashed = words.windows(short)
        first = words.first[:-1][words.counts == short]
        keep = np.isin(whole, first)
        row, value = np.concatenate([row, words.row_of(whole[keep])]), np.concatenate([value, hashed[keep]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(words.counts) + 1))


def featuriser(size: int, half: int, width: int):
    """Per document: set size, digest of the set, both collections of sketches, and 192 bits for estimates.

    ``width`` sketches of ``half`` MinHash values make a collection, so 2 * width * half values serve width ** 2 tables.
    """
    banded = 2 * width * half
    n_hashes = max(banded, ESTIMATORS)
    add, times = seeds(n_hashes, 11), seeds(n_hashes, 12) | np.uint64(1)
    folds = (seeds(2 * width, 13) | np.uint64(1)).reshape(2, width)

    def sketch(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(np.diff(bounds) > 0)
        least = np.zeros((n_hashes, len(bounds) - 1), np.uint64)
        if len(some):
            for k in range(n_hashes):
                least[k, some] = np.minimum.reduceat((values ^ add[k]) * times[k], bounds[some])
        groups = mix(least[:banded].copy()).reshape(2, width, half, -1)
        keys = np.zeros((2, width, groups.shape[-1]), np.uint64)
        for k in range(half):
            keys = mix((keys + groups[:, :, k]) * folds[:, :, None])
        bits = np.zeros((3, least.shape[1]), np.uint64)
        for k in range(ESTIMATORS * SHARES):
            part = mix(least[k // SHARES] + np.uint64(97)) >> np.uint64(k % SHARES)
            bits[k // 64] |= (part & np.uint64(1)) << np.uint64(k % 64)
        return keys, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for words in words_of(batch.column("text"), LOWER):
                lo, hi = words.rows
                values, bounds = shingle_sets(words, size)
                keys, bits = sketch(values, bounds)
                n = np.diff(bounds)
                digest = [
                    hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(bounds[:-1], bounds[1:])
                ]
                table = [
                    pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(k.T).view(np.int64).ravel()), width).cast(
                        pa.list_(pa.int64())
                    )
                    for k in keys
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *table,
                     *[pa.array(b.view(np.int64)) for b in bits]],
                    names=["doc_id", "n_shingles", "digest", "left", "right", "bits0", "bits1", "bits2"],
                )

    return run


def set_builder(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for words in words_of(batch.column("text"), LOWER):
                lo, hi = words.rows
                values, bounds = shingle_sets(words, size)
                packed = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["doc_id", "shingles"]
                )

    return run


def verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([one, two])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[k] = 100 * shared >= percent * (len(one) + len(two) - shared)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def _differing(x: str, y: str):
    return sum((F.bit_count(F.col(f"{x}.bits{k}").bitwiseXOR(F.col(f"{y}.bits{k}"))) for k in range(3)), F.lit(0))


def _plausible(x: str, y: str, percent: int, limit: int):
    """Sizes allow the similarity, and the estimate does not rule it out."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (small * 100 >= large * percent) & (_differing(x, y) <= limit)


def estimate_limit(percent: int, deviations: float = 4.5) -> int:
    """Differing bits beyond which a pair at the threshold is ``deviations`` standard deviations away."""
    apart = 1 - percent / 100
    mean = ESTIMATORS * apart * SHARES / 2
    spread = (ESTIMATORS * apart * (1 - apart) * (SHARES / 2) ** 2 + ESTIMATORS * apart * SHARES / 4) ** 0.5
    return int(mean + deviations * spread) + 1


def _bucket_mates(x: str, y: str):
    """Two rows meet in some table: they share a sketch of either collection."""
    return F.arrays_overlap(f"{x}.left", f"{y}.left") & F.arrays_overlap(f"{x}.right", f"{y}.right")


def slot_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall into each of ``SLOTS`` slots."""
    held = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for packed in batch.column("shingles"):
            held += np.bincount((np.frombuffer(packed.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    yield parts_of({"": held})


def prefixer(shared, percent: int):
    """The shingles of a set that come first in the common order, rare slots before frequent ones.

    Two sets of the similarity share at least ``percent`` % of the larger one, so one shared shingle is among these
    in both, whatever the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            out = []
            for packed in batch.column("shingles"):
                values = np.frombuffer(packed.as_buffer(), np.uint64)
                order = np.lexsort((values, held[(values % np.uint64(SLOTS)).astype(np.int64)]))
                out.append(values[order[: len(values) - -(-percent * len(values) // 100) + 1]].view(np.int64))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["id", "prefix"]
            )

    return run


def near_duplicates(
    docs: DataFrame, percent: int = 80, shingle: int = 5, half: int = 2, width: int = 9, cross_pairs: int = 4
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)`` that has a doc_id.

    Two documents are linked if ``100 * |intersection| >= percent * |union|`` of their sets of distinct
    ``shingle``-word windows (A-Z lower-cased; fewer words: the whole sequence is one).  Null, empty and
    wordless texts have an empty set and no link; rows of one doc_id are taken to have one text.  ``component_id`` is the least doc_id that can be reached, itself included; ``kept``
    marks it.  Repeated rows give repeated results; equal texts are always in one component; an empty
    table gives an empty result; other columns are ignored.

    Candidates: two collections of ``width`` sketches, each of ``half`` MinHash values, give width ** 2 tables of
    2 * half values from only 2 * width * half values.  A pair at similarity s meets in some table with probability
    ``(1 - (1 - s ** half) ** width) ** 2``: 0.9998 at 0.8 with 2 and 9, more above.  Very large corpora want a larger ``half``, and
    ``width`` with it, so that chance meetings stay rare.

    Equal sets are one class, represented by its least id.  Every bucket first compares its members with one
    hub, chosen by one of ``HUBS`` orders of the ids; the links found are contracted to components.  What is left are
    bucket mates in different components.  While those are more than ``cross_pairs`` a document, and rounds
    still join a tenth of the open components, other hubs are tried.  Open bucket mates are then paired where they share a
    shingle among the first of an order common to all sets, rare ones first, which sets of the similarity always do: a copy with too
    many words of its own meets nobody.  An estimate from 192 sketch bits drops pairs that are 4.5 standard
    deviations short before sets are fetched, and all links are confirmed on the full sets.  No bucket is cut short; long lists are
    compared in blocks of ``BLOCK``.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        F.col("doc_id").isNotNull()
    )
    features = checkpointed(named.mapInArrow(featuriser(shingle, half, width), FEATURES))
    classes = features.where("n_shingles > 0").groupBy("digest", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("id"),
        *[F.first(c).alias(c) for c in ("left", "right", "bits0", "bits1", "bits2")],
    )
    classes = checkpointed(classes)
    members = classes.select("id", F.posexplode("left").alias("i", "x"), "right").select(
        "id", "i", "x", F.posexplode("right").alias("j", "y")
    ).select("id", F.xxhash64("i", "j", "x", "y").alias("key"))
    def turn(round_no: int):
        return F.xxhash64(F.pmod("key", F.lit(HUBS)), F.lit(round_no))

    def hub(round_no: int):
        return F.min(F.col("id").bitwiseXOR(turn(round_no))).alias("hub")

    hubs = members.groupBy("key").agg(F.count(F.lit(1)).alias("held"), hub(0)).where("held > 1")
    hubs = hubs.select("key", F.col("hub").bitwiseXOR(turn(0)).alias("hub"))
    buckets = checkpointed(members.join(hubs, "key"))
    sketches = classes.select("id", "n", "bits0", "bits1", "bits2")
    ids = buckets.select("id").distinct()
    sets = checkpointed(
        named.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .mapInArrow(set_builder(shingle), SETS)
    )
    limit = estimate_limit(percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(
            sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"
        )
        return checkpointed(both.select("a", "b", "sa", "sb").mapInArrow(verifier(percent), "a long, b long"))

    def likely(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sketches.alias("u"), F.col("a") == F.col("u.id"))
            .join(sketches.alias("v"), (F.col("b") == F.col("v.id")) & _plausible("u", "v", percent, limit))
            .select("a", "b")
        )

    def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))

    stars = buckets.where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = confirmed(likely(stars))
    found = components(links)
    n_classes, parts_before, round_no = classes.count(), None, 0
    while True:
        placed = with_component(buckets.select("key", "id"), found)
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        open_rows = checkpointed(placed.join(mixed.select("key"), "key", "left_semi"))
        groups = open_rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
            F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same")
        )
        left = groups.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0
        parts = open_rows.select("component").distinct().count()
        if left <= cross_pairs * max(n_classes, 1) or (parts_before is not None and 10 * parts > 9 * parts_before):
            break
        parts_before, round_no = parts, round_no + 1
        other = open_rows.groupBy("key").agg(hub(round_no)).select("key", F.col("hub").bitwiseXOR(turn(round_no)).alias("hub"))
        stars = open_rows.join(other, "key").where("id != hub").select(
            F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
        ).distinct().join(links, ["a", "b"], "left_anti")
        links = checkpointed(links.unionByName(confirmed(likely(stars))))
        found = components(links)

    if left:
        open_ids = open_rows.select("id", "component").distinct()
        open_sets = sets.join(open_ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        held = summed(open_sets.mapInArrow(slot_counter, PARTS), SLOTS).get("", np.zeros(SLOTS, np.int64))
        prefixes = open_sets.mapInArrow(prefixer(spark.sparkContext.broadcast(held), percent), "id long, prefix array<long>")
        firsts = prefixes.join(open_ids, "id").select("id", "component", F.posexplode("prefix").alias("at", "shingle"))
        lists = firsts.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi")
        ).where("lo < hi").select("shingle", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
        rows = firsts.join(lists, "shingle").join(classes.select("id", "n", "bits0", "bits1", "bits2", "left", "right"), "id")
        rows = checkpointed(rows)
        one = rows.withColumn("block", F.pmod(F.hash("id"), "blocks"))
        two = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        shared = F.ceil(F.lit(percent) * (F.col("u.n") + F.col("v.n")) / (100 + percent))
        pairs = one.alias("u").join(
            two.alias("v"),
            (F.col("u.shingle") == F.col("v.shingle")) & (F.col("u.block") == F.col("v.block"))
            & (F.col("u.id") < F.col("v.id")) & (F.col("u.component") != F.col("v.component"))
            & (F.col("u.at") <= F.col("u.n") - shared) & (F.col("v.at") <= F.col("v.n") - shared)
            & _plausible("u", "v", percent, limit) & _bucket_mates("u", "v"),
        ).select(F.col("u.id").alias("a"), F.col("v.id").alias("b")).distinct()
        found = components(links.unionByName(confirmed(pairs)))

    placed = with_component(classes.select("digest", "n", "id"), found).select(
        F.col("digest").alias("_digest"), F.col("n").alias("_n"), "component"
    )
    out = features.select("doc_id", "n_shingles", "digest").join(
        placed, (F.col("digest") == F.col("_digest")) & (F.col("n_shingles") == F.col("_n")), "left"
    )
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
