"""Language identification by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .array_sums import PARTS, parts_of, summed
from .words import seeds, slices, text_bytes

#: Buckets for hashed n-grams, and the lengths of the n-grams in UTF-8 bytes.
BUCKETS = 1 << 18
LENGTHS = (2, 3, 4)
#: Bytes handled at once; languages whose counts one task holds before it passes them on.
STEP, HELD = 1 << 18, 8
#: Slope of the loss, and weight of the loss in the score.
SLOPE, SHARPNESS = 3.0, 2.0
#: Smoothing of n-gram counts, as a share of the mean count.
SMOOTH = 0.1

_TIMES = seeds(len(LENGTHS), 31) | np.uint64(1)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def gram_buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bucket of every n-gram, bounds of rows) by slices; letters lower-cased, other ASCII as space."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    data = _PLAIN[data]
    for lo, hi in slices(offsets, STEP):
        raw, ends = data[offsets[lo] : offsets[hi]].astype(np.uint64), offsets[lo + 1 : hi + 1] - offsets[lo]
        code, row, parts, rows = np.zeros(len(raw), np.uint64), np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), [], []
        for k in range(max(LENGTHS)):
            code = (code[: len(raw) - k] << np.uint64(8)) | raw[k:]
            if k + 1 in LENGTHS:
                whole = np.arange(len(code)) + k < ends[row[: len(code)]]
                times = _TIMES[LENGTHS.index(k + 1)]
                parts.append((((code[whole] + np.uint64(k)) * times) >> np.uint64(46)).astype(np.int64))
                rows.append(row[: len(code)][whole])
        row, bucket = np.concatenate(rows), np.concatenate(parts)
        order = np.argsort(row, kind="stable")
        yield lo, hi, bucket[order], np.searchsorted(row[order], np.arange(hi - lo + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, buckets, bounds in gram_buckets(batch.column("text")):
            for row in range(hi - lo):
                if langs[lo + row] not in held and len(held) == HELD:
                    yield parts_of(held)
                    held.clear()
                counts = held.setdefault(langs[lo + row], np.zeros(BUCKETS, np.int64))
                np.add.at(counts, buckets[bounds[row] : bounds[row + 1]], 1)
    yield parts_of(held)


def codebook(n: int) -> np.ndarray:
    """Codewords of +1 and -1 for ``n`` classes: all splits in two up to seven classes, else the best of some seeded draws."""
    if n <= 7:
        splits = np.arange(2 ** max(n - 1, 0) - 1)
        bits = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1 if n > 1 else np.zeros((0, 0), int)
        return np.vstack([np.ones((1, len(splits)), int), 2 * bits - 1]) if n else np.zeros((0, 0), int)
    width, best = int(np.ceil(10 * np.log2(n))), None
    for draw in range(200):
        words = np.random.RandomState(draw).choice([-1, 1], (n, width))
        usable = abs(words.sum(0)) < n
        apart = ((words[:, None, :] != words[None, :, :]).sum(2) + width * np.eye(n, dtype=int)).min() if usable.all() else -1
        if best is None or apart > best[0]:
            best = apart, words
    return best[1]


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` (n-gram bucket, bit): log odds; ``middle`` and ``reach``: what a text of either side is expected to score."""

    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    reach: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and the lead over the second, from mean log odds by bit."""
        z = np.clip((margins - self.middle) / self.reach, -3, 3)
        loss = np.zeros((len(z), len(self.langs)))
        for k, code in enumerate(self.codes):
            loss[:, k] = np.logaddexp(0, -SLOPE * z * code).sum(1)
        power = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
        share = power / power.sum(1, keepdims=True)
        ranked = np.sort(share, axis=1)
        return share.argmax(1), ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if len(self.langs) > 1 else 0)


def learn_languages(labelled: DataFrame) -> LanguageModel:
    """One binary n-gram classifier for every bit of the codewords, from all rows of ``labelled(text, lang)``.

    Rows with a null lang or text are left out; with no rows the model knows no language.  Tasks count n-grams by language and
    the counts are summed on Spark; the driver gets one array of fixed size for each language.  A bit's
    weights are log odds between the mean n-gram distributions of the languages on its two sides, so no language outweighs
    another by its share of the rows.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    merged = summed(rows.mapInArrow(_count, PARTS), BUCKETS)
    langs = tuple(sorted(merged))
    codes = codebook(len(langs))
    if not langs or not codes.shape[1]:
        return LanguageModel(langs, codes, np.zeros((BUCKETS, 0), "f4"), np.zeros(0), np.ones(0))
    counts = np.vstack([merged[lang] for lang in langs]).astype(float)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    smooth = SMOOTH * total / BUCKETS
    dist = (counts + smooth) / (total + smooth * BUCKETS)
    up = np.vstack([dist[code > 0].mean(0) for code in codes.T])
    down = np.vstack([dist[code < 0].mean(0) for code in codes.T])
    weights = np.log(up) - np.log(down)
    high, low = (up * weights).sum(1), (down * weights).sum(1)
    return LanguageModel(langs, codes, weights.T.astype("f4"), (high + low) / 2, np.maximum((high - low) / 2, 1e-9))


def _predict(shared, ambiguous: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            best, score, lead = (np.zeros(batch.num_rows, t) for t in (int, float, float))
            for lo, hi, buckets, bounds in gram_buckets(batch.column("text")):
                if not model.langs:
                    break
                margins = np.zeros((hi - lo, model.weights.shape[1]))
                some = np.flatnonzero(np.diff(bounds) > 0)
                if len(some):
                    margins[some] = np.add.reduceat(model.weights[buckets], bounds[some], axis=0, dtype=float)
                    margins[some] /= np.diff(bounds)[some][:, None]
                best[lo:hi], score[lo:hi], lead[lo:hi] = model.decode(margins)
            known &= bool(model.langs)
            best[~known], score[~known], lead[~known] = len(model.langs), 0.0, 0.0
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c not in ("text", "known")],
                 pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(lead < ambiguous)],
                names=[*[c for c in batch.schema.names if c not in ("text", "known")], "lang_pred", "score", "ambiguous"],
            )

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, ambiguous: float = 0.2) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row of ``docs(doc_id, text)``, from whole texts.

    The text's mean log odds by bit are compared with what the two sides are expected to give; the language whose codeword has the
    least logistic loss wins, its share of the losses is the score, and a lead below ``ambiguous`` is flagged.  Texts that are null
    or have no letter are ``und`` with score 0 and flagged, as is everything if the model knows no language; ties
    go to the language that sorts first.  Repeated rows and null doc_ids are answered as they are; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known"),
    )
    return rows.mapInArrow(_predict(shared, ambiguous), "doc_id long, lang_pred string, score double, ambiguous boolean")
