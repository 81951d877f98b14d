"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling tables, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import PLAIN, Words, mix, seeds, words_of

#: Bytes of items searched for in one pass over the documents; more items take more passes.
ITEM_BYTES = 16 << 20
#: Coordinates sampled in each repetition of the embedding, repetitions at most, and trials that tell how many are needed.
SAMPLES, MOST_REPEATS, TRIALS = 2, 128, 500
#: Items of more words are searched for by parts of at most so many: the share of coordinates that edits change grows with length.
PART = 40
#: Share of the copies at the edit limit that the search must find, for each length.
RECALL = 0.98
#: Windows embedded at once, and words of a run that a window must share with its item.
AT_ONCE, RUN = 10_000, 3

HITS = "doc_id long, item_id long, start_word long, end_word long, distance int"


def edit_limit(n_words: int, percent: int) -> int:
    """Edits (of words) that leave ``percent`` of an item's words."""
    return n_words * (100 - percent) // 100


def run_length(n_words: int, edits: int) -> int:
    """Some run of this many words survives ``edits`` edits: the words left are in at most edits + 1 runs."""
    return max(1, min(RUN, -(-(n_words - edits) // (edits + 1))))


def _walks(repeats: int, longest: int) -> np.ndarray:
    """Random numbers of the walks by (repetition, step); a repetition's do not depend on how many there are."""
    return np.stack([seeds(2 * longest + 1, 72 + 1000 * r) for r in range(repeats)])


def _places(repeats: int, sizes: np.ndarray) -> np.ndarray:
    """The sampled coordinates of windows of some sizes, by (repetition, sample, window)."""
    u = (seeds(MOST_REPEATS * SAMPLES, 71) >> np.uint64(11)).astype(float).reshape(MOST_REPEATS, SAMPLES, 1) / 2.0**53
    return (u[:repeats] * (2 * sizes)).astype(np.int64)


def _embedded(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The ``wanted`` coordinates of the CGK embeddings of ``words[starts:ends]``.

    The walk writes the word it stands on and moves on if a random bit for (repeat, step, word) says so; past the end it writes 0.
    """
    out = np.zeros(wanted.shape, np.uint64)
    at = np.repeat(starts[None, :], len(wanted), axis=0)
    last = len(words) - 1
    for step in range(int(wanted.max(initial=-1)) + 1):
        value = np.where(at < ends, words[np.minimum(at, last)], np.uint64(0))
        for k in range(SAMPLES):
            here = wanted[:, k] == step
            out[:, k][here] = value[here]
        at += (mix(value ^ steps[:, step : step + 1]) >> np.uint64(63)).astype(np.int64)
    return out


@cache
def repeats_needed(n_words: int, edits: int, recall: float) -> int:
    """Repetitions after which windows of ``n_words`` distinct words meet ``recall`` of their copies with ``edits`` edits.

    Counted on ``TRIALS`` random copies whose edits are all deletions, which move the walk most, and on as many with deletions,
    insertions and changes; with the walks and coordinates that the search itself uses.
    """
    rng = np.random.default_rng(n_words)
    originals = rng.integers(1, 1 << 63, (2 * TRIALS, n_words), dtype=np.uint64)
    copies = rng.integers(1, 1 << 63, (2 * TRIALS, n_words), dtype=np.uint64)  # what follows a copy is other text
    for k, words in enumerate(originals):
        kept = words.tolist()
        for _ in range(edits):
            kind = 0 if k < TRIALS else rng.integers(3)
            at = int(rng.integers(len(kept))) if kept else 0
            kept[at : at + (kind != 1)] = [] if kind == 0 else [int(rng.integers(1, 1 << 62))]
        copies[k, : len(kept)] = kept[:n_words]
    sizes = np.full(2 * TRIALS, n_words)
    starts = np.arange(2 * TRIALS) * n_words
    wanted, steps = _places(MOST_REPEATS, sizes), _walks(MOST_REPEATS, n_words)
    one, two = (_embedded(x.ravel(), starts, starts + n_words, wanted, steps) for x in (originals, copies))
    met = np.logical_or.accumulate((one == two).all(axis=1), axis=0)
    share = np.minimum(met[:, :TRIALS].mean(axis=1), met[:, TRIALS:].mean(axis=1))
    enough = np.flatnonzero(share >= recall)
    return int(enough[0]) + 1 if len(enough) else MOST_REPEATS


class Items:
    """Benchmark items as word hashes, the short word runs in their parts, and the sampled coordinates of the parts' embeddings.

    ``sizes``, ``item`` and ``offset`` are those of parts: a short item has one, a long item several next to each other.  If
    an item is within its share of edits, one of its parts is within the same share.
    """

    def __init__(self, rows: list[tuple[int, str]], percent: int, recall: float = RECALL):
        self.ids, self.words, self.edits = [], [], []
        pieces: list[np.ndarray] = []
        self.item, self.offset = [], []
        runs: dict[int, list[tuple]] = {}
        for part in words_of(pa.array([text for _, text in rows], pa.large_string()), PLAIN):
            windows = {k: part.windows(k) for k in range(1, RUN + 1)}
            for row, (a, b) in enumerate(zip(part.first[:-1], part.first[1:])):
                if a == b:
                    continue
                item, n = len(self.ids), int(b - a)
                self.ids.append(rows[part.rows[0] + row][0])
                self.words.append(part.hashes[a:b])
                self.edits.append(edit_limit(n, percent))
                cuts = np.linspace(a, b, -(-n // PART) + 1).astype(np.int64)
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    k = run_length(int(hi - lo), edit_limit(int(hi - lo), percent))
                    at, value = windows[k]
                    own = (at >= lo) & (at + k <= hi)
                    runs.setdefault(k, []).append((value[own], np.full(own.sum(), len(pieces)), at[own] - lo))
                    pieces.append(part.hashes[lo:hi])
                    self.item.append(item)
                    self.offset.append(int(lo - a))
        self.sizes, self.edits = np.array([len(w) for w in pieces], np.int64), np.array(self.edits, np.int64)
        self.runs = {}
        for k, parts in runs.items():
            value, item, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(value, kind="stable")
            self.runs[k] = value[order], item[order], offset[order]
        lengths = [(int(n), edit_limit(int(n), percent)) for n in np.unique(self.sizes)]
        self.repeats = max([repeats_needed(n, edits, recall) for n, edits in lengths], default=1)
        self.coordinates = _places(self.repeats, self.sizes)
        self.steps = _walks(self.repeats, int(self.sizes.max(initial=0)))
        flat = np.concatenate([*pieces, np.zeros(1, np.uint64)])
        first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.samples = self.embed(flat, first, first + self.sizes, np.arange(len(self.sizes)))

    def embed(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Sampled coordinates (repeat, sample, window) of the embeddings of ``words[starts:ends]``, windows of parts ``items``."""
        return _embedded(words, starts, ends, self.coordinates[:, :, items], self.steps)

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, start) of the part-sized windows that share a word run with the part in its place, start counted in the row."""
        rows, items, starts = [], [], []
        for k, (value, item, offset) in self.runs.items():
            at, have = words.windows(k)
            lo = np.searchsorted(value, have, side="left")
            n = np.searchsorted(value, have, side="right") - lo
            hit = np.flatnonzero(n)
            n = n[hit]
            place = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = words.row_of(at[hit])
            rows.append(np.repeat(row, n))
            items.append(item[place])
            starts.append(np.repeat(at[hit] - words.first[row], n) - offset[place])
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        found = np.unique(np.vstack([np.concatenate(x) for x in (rows, items, starts)]), axis=1)
        return found[0], found[1], found[2]


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between ``item`` and any part of ``text``, with the part's start and end; ties: the first end, the latest start."""

    def row_by_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        now = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for word in a:
            new = np.empty_like(now)
            new[0] = now[0] + 1
            new[1:] = np.minimum(now[1:] + 1, now[:-1] + (b != word))
            now = np.minimum.accumulate(new - steps) + steps
        return now

    ends = row_by_row(item, text, True)
    end = int(ends.argmin())
    starts = row_by_row(item[::-1], text[:end][::-1], False)
    return int(ends[end]), end - int(starts.argmin()), end


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for words in words_of(batch.column("text"), PLAIN):
                row, item, start = items.windows(words)
                for lo in range(0, len(row), AT_ONCE):
                    r, i, s = row[lo : lo + AT_ONCE], item[lo : lo + AT_ONCE], start[lo : lo + AT_ONCE]
                    first = words.first[r] + np.maximum(s, 0)
                    end = np.minimum(words.first[r] + s + items.sizes[i], words.first[r + 1])
                    same = items.embed(words.hashes, first, end, i) == items.samples[:, :, i]
                    for k in np.flatnonzero(same.all(axis=1).any(axis=0)):
                        out.append((words.rows[0] + int(r[k]), items.item[i[k]], int(s[k]) - items.offset[i[k]], words))
            rows, done, tried = [], {}, set()
            for r, i, s, words in sorted(out, key=lambda x: x[:3]):
                if (r, i, s) in tried or ((r, i) in done and s < done[(r, i)]):
                    continue
                tried.add((r, i, s))
                e, a = int(items.edits[i]), int(words.first[r - words.rows[0]])
                lo, hi = a + max(s - e, done.get((r, i), 0), 0), min(a + s + len(items.words[i]) + 2 * e, int(words.first[r - words.rows[0] + 1]))
                distance, start, end = best_match(items.words[i], words.hashes[lo:hi])
                if distance <= e:
                    rows.append((ids[r].as_py(), items.ids[i], lo - a + start, lo - a + end, distance))
                    done[(r, i)] = lo - a + end
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "start_word", "end_word", "distance"]
            )

    return run


def find_passages(docs: DataFrame, items: DataFrame, percent: int = 80, item_bytes: int = ITEM_BYTES, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance): passages of ``items(item_id, text)`` in ``docs(doc_id, text)``.

    Words are runs of ASCII letters and digits and of all other characters, A-Z lower-cased.  A passage is a part of a text that
    ``(100 - percent) %`` of the item's words, rounded down, suffice to edit into the item; hits of one item in one row do not overlap.
    Items and texts that are null, empty or wordless are never hit; repeated rows and items are each answered; null ids stay
    null; an empty table gives no hits; other columns are ignored.

    Windows start where a text shares a short word run with the item in its place; by the pigeonhole principle every
    passage has one, up to shifts that the embedding absorbs.  Windows and items are embedded by CGK random walks,
    ``SAMPLES`` coordinates are drawn from each embedding, and a window meets its item if all of them agree in any repetition.  As many repetitions are
    made as ``recall`` of the copies at the edit limit need, for the length that needs most (see ``repeats_needed``).  The share of coordinates that
    edits change grows with length, so items of more than ``PART`` words are searched for by parts, one of which is within the edit limit if the item is;
    the whole item is then verified around it.
    Meetings are verified by exact edit distance.  Documents are not shuffled; items are broadcast in groups of at most ``item_bytes``,
    each searched in a pass of its own.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        F.col("text").isNotNull()
    )
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes, out = max(1, -(-total // item_bytes)), None
    for k in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in part], percent, recall))
        found = texts.mapInArrow(_search(shared), HITS)
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without a passage of ``items``; rows with a null doc_id are kept."""
    hit = find_passages(docs, items, percent).select(F.col("doc_id").alias("_hit")).where(F.col("_hit").isNotNull()).distinct()
    return docs.join(hit, F.col("doc_id") == F.col("_hit"), "left_anti")
