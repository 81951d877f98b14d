"""Harmonic packing: pieces of reciprocal-capacity lengths, a fixed number of them in every sequence."""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import checkpointed
from .words import bytes_list, words_of

#: A remainder is left whole once this many of its kind fit in a sequence.
FINE = 64
#: Pieces of one class numbered by one task.
BUCKET_ROWS = 20_000
#: Words, and runs of letters, whose ids one worker remembers; beyond that it starts anew.
CACHE_WORDS = 1_000_000
#: Runs encoded as one text, and words split at once.
RUNS_AT_ONCE, WORDS_AT_ONCE = 256, 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, ids binary"
_TOKENIZERS: dict = {}
_ENCODERS: dict = {}

#: Fixed value: the pattern by which the public word tokenizer splits lower-cased text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_RUNS = regex.compile(SPLIT)
#: Printable ASCII and Latin letters and signs, none of which combines with its neighbours or with a space.
_COMMON = regex.compile("[\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+")
#: Byte table: all white space of ASCII as space.
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[9:14] = 32


def class_sizes(capacity: int) -> list[int]:
    """How many pieces share a sequence: 1 to ``FINE``, then steps of about a third up to the capacity."""
    sizes, k = list(range(1, min(FINE, capacity) + 1)), FINE
    while (k := k * 4 // 3) <= capacity:
        sizes.append(k)
    return sizes


def cuts(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces, in order.

    Whole sequences first.  A remainder that fills a sequence to within 1/``FINE`` when repeated, or of which more
    than ``FINE`` fit, stays whole; otherwise the largest ``capacity // k`` that it holds is cut off.
    """
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        if k >= FINE or (capacity - k * rest) * FINE <= capacity:
            out.append(rest)
            break
        piece = capacity // (-(-capacity // rest))
        out.append(piece)
        rest -= piece
    return out


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class _Held:
    """Ids by key: rows of one flat array."""

    def __init__(self):
        self.rows: dict = {}
        self.ends, self.ids, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.uint8), 0

    def add(self, keys: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Keep 32-bit ids of some keys, ``sizes`` of them for each."""
        n, m, at = self.n, len(keys), int(self.ends[self.n])
        body = ids.astype("<u4").view(np.uint8)
        if n + m + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), m + 1), np.int64)])
        if at + len(body) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(body)), np.uint8)])
        self.ends[n + 1 : n + m + 1] = at + 4 * np.cumsum(sizes)
        self.ids[at : at + len(body)] = body
        self.rows.update(zip(keys, range(n, n + m)))
        self.n += m

    def places(self, keys: list) -> np.ndarray:
        """Rows of keys, -1 for unknown ones."""
        return np.fromiter((self.rows.get(key, -1) for key in keys), np.int64, len(keys))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """The ids in some rows one after the other, and the bytes at which each row's begin and end."""
        if not len(at):
            return np.zeros(1, np.int64), memoryview(b"")
        held = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), self.n, [None, pa.py_buffer(np.ascontiguousarray(self.ends[: self.n + 1])), pa.py_buffer(self.ids)]
        ).take(pa.array(at))
        edges = np.frombuffer(held.buffers()[1], np.int64)[: len(at) + 1]
        return edges, memoryview(held.buffers()[2]) if edges[-1] else memoryview(b"")


class WordEncoder:
    """Ids of whole texts, word by word.

    For tokenizers whose pre-tokens never span white space, the ids of a text are those of its space-separated words one after the other;
    ids of recent words are remembered.  New words of common Latin letters and signs are first split, many at once, into the runs that
    ``SPLIT`` finds, which such tokenizers also split them into, so that case and punctuation cost no new encoding; ``splits`` says whether
    the tokenizer does so.  Others are encoded each by itself.
    """

    def __init__(self, path: str):
        self.tokenizer, self.words, self.runs = tokenizer(path), _Held(), _Held()
        self.splits = self._same_splits()

    def _same_splits(self) -> bool:
        """Does the tokenizer lower-case, and split words as ``SPLIT`` does?"""
        state = json.loads(self.tokenizer.to_str())
        lower = [x["type"] for x in (state["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        split = ((state["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        return lower and split == SPLIT

    def _each(self, held: _Held, keys: list, names: list[str]) -> None:
        found = [got.ids for got in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        held.add(keys, np.array([len(x) for x in found]), np.array([k for x in found for k in x], np.uint32))

    def _learn_runs(self, runs: list[str]) -> None:
        """Ids of runs, many of them to a text, told apart by the tokenizer's own count of runs."""
        groups = [runs[k : k + RUNS_AT_ONCE] for k in range(0, len(runs), RUNS_AT_ONCE)]
        for group, got in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            word = np.array(got.word_ids, dtype=float)
            cuts = np.flatnonzero(word[1:] != word[:-1]) + 1
            if len(cuts) + 1 == len(group) and not np.isnan(word).any():
                self.runs.add(group, np.diff(cuts, prepend=0, append=len(word)), np.array(got.ids, np.uint32))
            else:
                self._each(self.runs, group, group)

    def _learn_split(self, groups: list[tuple[list[bytes], str]]) -> None:
        split = [_RUNS.findall(text.lower()) for _, text in groups]
        fresh = {run for runs in split for run in runs if run not in self.runs.rows}
        if fresh:
            self._learn_runs(list(fresh))
        for (group, text), runs in zip(groups, split):
            # Runs hold all that is not a space, in order: lengths say where each word's runs end.
            ends = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64, len(group)))
            last = np.searchsorted(np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs))), ends) + 1
            edges, ids = self.runs.take(self.runs.places(runs))
            self.words.add(group, np.diff(edges[last] // 4, prepend=0), np.frombuffer(ids, "<u4", int(edges[-1]) // 4))

    def learn(self, words: list[bytes]) -> None:
        groups = [words[k : k + WORDS_AT_ONCE] for k in range(0, len(words), WORDS_AT_ONCE)]
        common, each = [], []
        for group in groups:
            text = b" ".join(group).decode()
            # The whole group at once, word by word only if it holds an uncommon one.
            if not (self.splits and _COMMON.fullmatch(text) and "<|" not in text):
                plain = [self.splits and bool(_COMMON.fullmatch(name := w.decode())) and "<|" not in name for w in group]
                each += [w for w, ok in zip(group, plain) if not ok]
                group = [w for w, ok in zip(group, plain) if ok]
                text = b" ".join(group).decode()
            if group:
                common.append((group, text))
        self._learn_split(common)
        if each:
            self._each(self.words, each, [w.decode() for w in each])

    def encode(self, texts: pa.Array | list[bytes]) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        for words in words_of(pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts, _SPACES):
            self.words = self.words if self.words.n <= CACHE_WORDS else _Held()
            self.runs = self.runs if self.runs.n <= CACHE_WORDS else _Held()
            ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
            body = np.ascontiguousarray(words.data[words.data != 32])
            found = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)]
            ).dictionary_encode()
            names = bytes_list(found.dictionary)
            at = self.words.places(names)
            new = [names[k] for k in np.flatnonzero(at < 0)]
            self.learn(new)
            at[at < 0] = self.words.places(new)
            edges, ids = self.words.take(at[found.indices.to_numpy(zero_copy_only=False)])
            cut = edges[words.first].tolist()
            for a, b in zip(cut[:-1], cut[1:]):
                yield bytes(ids[a:b])


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    sizes = class_sizes(capacity)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers are reused, and so is what one has learned.
        encoder = _ENCODERS.setdefault(path, None) or WordEncoder(path)
        _ENCODERS[path] = encoder
        for batch in batches:
            rows, size = [], 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids += end
                at, tokens = 0, len(ids) // 4
                for length in cuts(tokens, capacity):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, length, zlib.crc32(part), tokens, sizes[bisect_right(sizes, capacity // length) - 1],
                                 part if with_ids else None))
                    at += length
                size += tokens
                if size > 1 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "ids"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """First fit, longest first.  Gets fewer pieces of each class than fill one sequence."""
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        room, place, offset = [], [], []
        for length in rows["length"]:
            k = next((k for k, free in enumerate(room) if free >= length), len(room))
            if k == len(room):
                room.append(capacity)
            place.append(k)
            offset.append(capacity - room[k])
            room[k] -= length
        return rows.assign(sequence_id=np.array(place, "int64"), offset=np.array(offset, "int64"))

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) for every piece of ``docs(doc_id, text)``.

    A document is the ids of its text, then ``end_id``; a null or empty text is ``end_id`` alone.  Every id lies in exactly
    one piece; ``start`` counts the document's ids before it; ``ids`` (little-endian 32-bit) is filled on request.
    Repeated rows are packed as often as they occur; null doc_ids stay null; an empty table gives no pieces; other
    columns are ignored.

    A piece of length l belongs to the class of ``k = capacity // l`` (above ``FINE``, rounded down to a coarser step); k pieces
    of a class make a sequence, whichever they are, so tasks fill sequences without knowing of each other: pieces are
    numbered within hashed buckets of a class, and bucket counts give the first number of every bucket.  Documents are cut
    so that most pieces are ``capacity // k`` long, which wastes less than k ids a sequence.  Fewer than k pieces of each class are left at the end,
    at most a sequence for each class whatever the input; those are packed first fit in one small group.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = checkpointed(plain.mapInArrow(_pieces(tokenizer_path, end_id, capacity, with_ids), PIECES))
    n = pieces.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    per_class = W.partitionBy("class")
    before = counts.select(
        "class", "bucket",
        F.coalesce(F.sum("n").over(per_class.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(per_class).alias("in_class"),
    )
    number = F.row_number().over(W.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = dealt.withColumn("rank", number).join(before, ["class", "bucket"]).withColumn(
        "rank", F.col("rank") + F.col("before")
    )
    numbered = checkpointed(numbered.drop("before", "bucket"))
    full = F.col("rank") < F.col("in_class") - F.col("in_class") % F.col("class")
    shift = F.shiftleft(F.col("class").cast("long"), 40)
    sequences = numbered.where(full).withColumn("sequence_id", shift + F.floor(F.col("rank") / F.col("class")))
    inside = W.partitionBy("sequence_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    sequences = sequences.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    left = numbered.where(~full).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        _first_fit(capacity),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, ids binary, rank long, in_class long, "
        "all int, sequence_id long, offset long",
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return sequences.select(columns).unionByName(left.select(columns))
