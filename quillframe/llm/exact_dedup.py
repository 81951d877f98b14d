"""Exact dedup: Golomb-coded fingerprints go to owners, bitmaps of repeated ones come back, suspects are compared by their bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..operators.lookup import lookup_join
from ..session import checkpointed, temporary_conf
from .words import mix

#: Bytes of text in one unit, and rows whose fingerprints one owner answers for.
UNIT_BYTES, OWNER_ROWS = 8 << 20, 1 << 20
#: Bits by which fingerprints are longer than row numbers would be: a row is a false suspect with probability 2**-SPARE.
SPARE = 16
#: Units of which more hold a fingerprint make it a hot one, whose rows are compared in ``SALTS`` parts first.
HOT_UNITS, SALTS = 512, 256

_SPACE = b" \t\n\x0b\x0c\r"

UNITS = "unit int, doc_id long, n_points long, digest binary, body binary"
MESSAGES = "owner int, unit int, gaps binary, rests binary, twice binary"
REPLIES = "unit int, owner int, repeated binary, hot binary"
JUDGED = "unit int, row int, doc_id long, n_points long, digest binary, suspect boolean, hot boolean, body binary"
_MESSAGES = pa.schema(
    [("owner", pa.int32()), ("unit", pa.int32()), ("gaps", pa.binary()), ("rests", pa.binary()), ("twice", pa.binary())]
)
_REPLIES = pa.schema([("unit", pa.int32()), ("owner", pa.int32()), ("repeated", pa.binary()), ("hot", pa.binary())])
_JUDGED = pa.schema([
    ("unit", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("digest", pa.binary()),
    ("suspect", pa.bool_()), ("hot", pa.bool_()), ("body", pa.binary()),
])


def golomb(values: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """Sorted distinct integers from 0 to ``width``: gaps by Golomb's code for a power of two.

    The first result holds the code's parameter in one byte and then the quotients, each as so many zeros and a one; the second
    the remainders, in as many bits as the parameter says.
    """
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    bits = max(0, int(width // max(1, len(values))).bit_length() - 1)
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    ones = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, bool)
    unary[ones] = True
    rests = (gaps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return bytes([bits]) + np.packbits(unary).tobytes(), np.packbits(rests.astype(bool)).tobytes()


def ungolomb(gaps: bytes, rests: bytes) -> np.ndarray:
    bits = gaps[0]
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(gaps, np.uint8, offset=1)))
    quotients = np.diff(ones, prepend=-1) - 1
    out = quotients.astype(np.uint64) << np.uint64(bits)
    if bits:
        low = np.unpackbits(np.frombuffer(rests, np.uint8), count=len(ones) * bits).reshape(-1, bits)
        out += low.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    return np.cumsum(out, dtype=np.uint64)


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(held: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(held, np.uint8), count=n).astype(bool)


class Owners:
    """Fingerprints are the first ``bits`` of a digest; equal ranges of them belong to the owners."""

    def __init__(self, rows: int, owner_rows: int, spare: int):
        self.bits = min(63, max(1, rows).bit_length() + spare)
        self.owners = max(1, -(-rows // owner_rows))
        self.width = -(-(1 << self.bits) // self.owners)

    def fingerprints(self, digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
        first = b"".join([x.as_buffer()[:8].to_pybytes() for x in digests])
        return np.frombuffer(first, ">u8").astype(np.uint64) >> np.uint64(64 - self.bits)

    def dealt(self, digests):
        """Distinct fingerprints in order, each row's place among them, how many rows each has, and the span of each owner."""
        values, place, counts = np.unique(self.fingerprints(digests), return_inverse=True, return_counts=True)
        owner = (values // np.uint64(self.width)).astype(np.int64)
        cut = np.flatnonzero(np.diff(owner, prepend=-1))
        return values, place, counts, list(zip(owner[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(values)]))


def _units(units: int):
    """Rows with the bytes that count, compressed, and their digest; rows of a task are dealt to units by their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        press, done = zstandard.ZstdCompressor(level=1), 0
        part = np.uint64(TaskContext.get().partitionId() << 40)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            bodies = [x.as_buffer().to_pybytes().translate(None, _SPACE) for x in texts]
            number = mix(np.arange(done, done + len(bodies), dtype=np.uint64) + part) % np.uint64(units)
            done += len(bodies)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number.astype(np.int32)), batch.column("doc_id"), batch.column("n_points"),
                 pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary()),
                 pa.array([press.compress(x) for x in bodies], pa.binary())],
                names=["unit", "doc_id", "n_points", "digest", "body"],
            )

    return run


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _sent(owners: Owners):
    """A unit's messages: for each owner that it has fingerprints of, the coded fingerprints and which have two rows or more."""
    def run(table: pa.Table) -> pa.Table:
        unit, rows = table.column("unit")[0].as_py(), []
        values, _, counts, spans = owners.dealt(table.column("digest"))
        for owner, a, b in spans:
            coded = golomb(values[a:b] - np.uint64(owner * owners.width), owners.width)
            rows.append((owner, unit, *coded, bitmap(counts[a:b] > 1)))
        return _table(rows, _MESSAGES)

    return run


def _answered(hot_units: int):
    """An owner's replies: which fingerprints of each message have two rows or more in all, and which are in many units."""
    def run(table: pa.Table) -> pa.Table:
        owner, units = table.column("owner")[0].as_py(), table.column("unit").to_pylist()
        parts = [ungolomb(g.as_buffer().to_pybytes(), r.as_buffer()) for g, r in zip(table.column("gaps"), table.column("rests"))]
        twice = np.concatenate([flags_of(x.as_buffer(), len(p)) for x, p in zip(table.column("twice"), parts)])
        values, place, held = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        repeated = held > 1
        repeated[place[twice]] = True
        rows, at = [], 0
        for unit, part in zip(units, parts):
            mine = place[at : at + len(part)]
            rows.append((unit, owner, bitmap(repeated[mine]), bitmap(held[mine] > hot_units)))
            at += len(part)
        return _table(rows, _REPLIES)

    return run


def _judged(owners: Owners):
    """A unit's rows with what the owners say; the bytes of suspects come along, once for each distinct text of the unit."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _JUDGED)
        values, place, _, spans = owners.dealt(left.column("digest"))
        replies = {k: (r, h) for k, r, h in zip(*(right.column(c).to_pylist() for c in ("owner", "repeated", "hot")))}
        repeated, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
        for owner, a, b in spans:
            repeated[a:b], hot[a:b] = (flags_of(x, b - a) for x in replies[owner])
        suspect, opener = repeated[place], zstandard.ZstdDecompressor()
        bodies: list[bytes | None] = [None] * left.num_rows
        seen = set()
        digests, packed = left.column("digest"), left.column("body")
        for k in np.flatnonzero(suspect).tolist():
            digest, body = digests[k].as_py(), opener.decompress(packed[k].as_buffer())
            if (digest, body) not in seen:
                seen.add((digest, body))
                bodies[k] = body
        n = left.num_rows
        return pa.Table.from_arrays(
            [left.column("unit"), pa.array(np.arange(n, dtype=np.int32)), left.column("doc_id"), left.column("n_points"), digests,
             pa.array(suspect), pa.array(hot[place]), pa.array(bodies, pa.binary())],
            schema=_JUDGED,
        )

    return run


def exact_dedup(
    docs: DataFrame, unit_bytes: int = UNIT_BYTES, owner_rows: int = OWNER_ROWS, spare: int = SPARE, hot_units: int = HOT_UNITS
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs(doc_id, text)``.

    Rows are one group if their texts are the same bytes without the characters ``[\\x20\\x09-\\x0D]``; null is an empty text, so null,
    empty and blank texts are one group.  Of a group the row with the most code points in the original text stays,
    then the one of smallest doc_id; a row with a null doc_id comes after all others, and of rows equal in both exactly one stays.
    ``keep_id`` is the doc_id of the row that stays; ``text_sha256`` is the SHA-256 of the text without those characters.  An empty table gives
    an empty result; other columns are ignored.  A task that is run again must get its rows in the same order, as it does from files.

    Rows are dealt to units of about ``unit_bytes`` by their number, whatever they hold, and kept there, compressed, in a checkpoint whose
    partitioning later steps reuse.  A unit sends each owner the sorted distinct fingerprints in its range, Golomb-coded: about
    ``spare`` + log2(units) + 1.5 bits each, and never more messages than rows.  Owners answer with a bit for each: does it have two rows or
    more?  Only rows so marked are suspects.  Their bytes are shuffled, once for each distinct text of a unit, and compared; a
    fingerprint in more than ``hot_units`` units is first compared in ``SALTS`` parts.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_points"),
    )
    rows, size = plain.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    units = max(1, -(-(size or 0) // unit_bytes))
    owners = Owners(rows, owner_rows, spare)
    dealt = plain.mapInArrow(_units(units), UNITS)
    # A checkpoint of a plan that is not adaptive keeps its partitioning, so that texts are not shuffled again.
    with temporary_conf(docs.sparkSession, spark__sql__adaptive__enabled="false"):
        dealt = checkpointed(dealt.repartition(units, "unit"))
    messages = dealt.select("unit", "digest").groupBy("unit").applyInArrow(_sent(owners), MESSAGES)
    replies = messages.groupBy("owner").applyInArrow(_answered(hot_units), REPLIES)
    judged = checkpointed(dealt.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(_judged(owners), JUDGED))

    # The bytes: distinct (digest, body), hot ones in parts first.
    shown = judged.where(F.col("body").isNotNull()).select("digest", "body", "hot", (F.col("unit") % SALTS).alias("salt"))
    hot = shown.where("hot").select("digest", "body", "salt").distinct().select("digest", "body")
    texts = shown.where("NOT hot").select("digest", "body").unionByName(hot).distinct()
    collisions = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))
    order = F.struct(
        "n_points", F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("id"),
        (-F.col("unit")).alias("unit"), (-F.col("row")).alias("row"),
    )
    suspects = judged.where("suspect")
    part = suspects.groupBy("digest", (F.col("unit") % SALTS).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("best"))
    groups = part.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    proven = F.when(F.col("n_texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("different texts with one SHA-256")).cast("long")
    )
    groups = checkpointed(groups.join(collisions, "digest").select("digest", proven.alias("group_size"), "best"))
    found = lookup_join(
        suspects.drop("suspect", "hot", "body"), groups.select("digest", "group_size", "best", F.col("group_size").alias("weight")),
        "digest", "weight",
    )
    stays = (F.col("best")["unit"] == -F.col("unit")) & (F.col("best")["row"] == -F.col("row"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = judged.where("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    return alone.unionByName(found.select(
        "doc_id", (-F.col("best")["id"]).alias("keep_id"), "group_size", stays.alias("kept"), sha
    ))
