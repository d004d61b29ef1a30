"""Toxicity by class-conditional Kneser-Ney models of byte sequences.

Two models, toxic and ordinary, give each byte a probability after its five predecessors by absolute
discounting of that class's counts.  What a class has not seen goes to one shared lower order: the
Kneser-Ney continuation counts (in how many different surroundings a sequence occurs) of all
documents, labelled or not, after three predecessors, and below it of single bytes.  An expression
that is rare in both classes therefore scores near zero, not at random.

A text's evidence is the difference of the two log-likelihoods, length-normalised: per byte over the
whole text, and per word over the ``TOP`` share of its words that speak most for the toxic class.
A logistic curve over the two and the log of the word count makes it a score from 0 to 1.

Which labelled rows teach what, by crc32 of the id modulo 4: 0 and 1 the class counts, 3 the curve,
of which at most ``CURVE_ROWS`` rows are taken, those with the smallest hash; 2 is held out.  Ids are
used for this choice only; labels, language, source and id never enter a score.

Sizes: counts live in tables that hold every sequence under its own key, so that no two share a
count and an unseen one is known as unseen.  They grow with the distinct sequences, to the driver and
in the broadcast: 12 to 24 bytes a cell at two to four cells a sequence.
Labels are joined by broadcast up to ``LABELS_BROADCAST`` rows and by shuffle beyond.

Rows: null and empty texts get the curve's score at no evidence; repeated rows score alike; an id
with several labels counts as toxic if any says so, null labels are dropped; without labelled rows
of both classes every score is 0.  Only the id, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .scratch import Stage
from .textcols import free_name

ORDER, SHARED = 6, 4
DISCOUNT = 0.75
TOP = 0.01
CURVE_ROWS = 20_000
PIECE = 1 << 18  # bytes of text worked on at once, which bounds a worker's memory
LABELS_BROADCAST = 4_000_000
THRESHOLD = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mask(n: int) -> int:
    return (1 << (8 * n)) - 1


def _rows(cols: list[np.ndarray]) -> np.ndarray:
    """Rows of 2 or 4 floats as items of 8 or 16 bytes, which are gathered at once."""
    return np.ascontiguousarray(np.column_stack(cols).astype(np.float32)).view(np.float64 if len(cols) == 2 else np.complex128)[:, 0]


def _lower(total: np.ndarray, types: np.ndarray) -> list[np.ndarray]:
    """What a context multiplies its own counts and the lower order by."""
    seen = total > 0
    safe = np.where(seen, total, 1)
    return [np.where(seen, 1 / safe, 0), np.where(seen, DISCOUNT * types / safe, 1)]


def _padded(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes with ORDER - 1 blanks before each text, the places of real bytes, and their text."""
    lens = np.diff(np.concatenate([[0], ends]))
    text = np.repeat(np.arange(len(ends)), lens)
    at = np.arange(len(data)) + (ORDER - 1) * (text + 1)
    out = np.full(len(data) + (ORDER - 1) * len(ends), 32, np.uint8)
    out[at] = _LOWER[data]
    return out, at, text


def _packed(b: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place as one integer (n at most 7)."""
    wide = b.astype(np.int64)
    out = wide.copy()
    for k in range(1, n):
        out[k:] |= wide[:-k] << (8 * k)
    return out


def _parts(b: np.ndarray, at: np.ndarray, n: int):
    """(first, end, the integers of the n bytes that end at those places), PIECE places at a time: a text of
    any length needs few bytes of memory for each of its own."""
    for lo in range(0, len(at), PIECE):
        a = at[lo : lo + PIECE]
        base = int(a[0]) - n + 1
        yield lo, lo + len(a), _packed(b[base : int(a[-1]) + 1], n)[a - base]


def _home(keys: np.ndarray, bits: int) -> np.ndarray:
    return (S.mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).view(np.int64)


def _table(keys: np.ndarray, values: np.ndarray, default) -> tuple[int, np.ndarray, np.ndarray]:
    """Distinct keys with their values, each in the first free cell from its home on; the last cell is the default's."""
    bits = max(4, (2 * len(keys)).bit_length())
    home = _home(keys, bits)
    order = np.argsort(home, kind="stable")
    i = np.arange(len(keys))
    cell = np.maximum.accumulate(home[order] - i) + i
    size = max(1 << bits, int(cell[-1]) + 1 if len(cell) else 0) + 2
    k, v = np.full(size, -1, np.int64), np.full(size, default, values.dtype)
    k[cell], v[cell] = keys[order], values[order]
    return bits, k, v


def _find(table: tuple[int, np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The keys' values, or the default."""
    bits, k, v = table
    at = _home(keys, bits)
    have = k.take(at)
    left = np.flatnonzero(have != keys)
    have = have[left]
    while len(left):
        none = have < 0
        at[left[none]] = len(k) - 1
        left = left[~none]
        at[left] += 1
        have = k.take(at[left])
        other = have != keys[left]
        left, have = left[other], have[other]
    return v.take(at)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(n, start)


HELD = 8  # pieces' results merged at once


def _count_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sequence of ORDER bytes with the class above them, count) of a task's labelled texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for row, end, data, ends in S.pieces(batch.column("text"), PIECE):
            if not len(data):
                continue
            b, at, text = _padded(data, ends)
            for lo, hi, seq in _parts(b, at, ORDER):
                held.append(np.unique(seq | (label[row:end][text[lo:hi]] << (8 * ORDER)), return_counts=True))
                if len(held) > HELD:
                    held = [_merged(held)]
    if held:
        keys, n = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def _shared_seqs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct sequences of SHARED + 1 bytes of a task's texts."""
    held: list[np.ndarray] = []
    for batch in batches:
        for _, _, data, ends in S.pieces(batch.column("text"), PIECE):
            if not len(data):
                continue
            b, at, _ = _padded(data, ends)
            for _, _, seq in _parts(b, at, SHARED + 1):
                held.append(np.unique(seq))
                if len(held) > HELD:
                    held = [np.unique(np.concatenate(held))]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["seq"])


class Model:
    """Keyed tables from which a place's probabilities are one product and sum each, and the curve."""

    def __init__(self):
        self.curve = self.made = None

    @classmethod
    def of(cls, tables: dict) -> Model:
        """A model over broadcast tables, which are plain arrays so that any worker can read them."""
        m = cls.__new__(cls)
        m.__dict__ = dict(tables)
        return m

    def evidence(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of (difference per byte, mean of the top words, log of words)."""
        out = np.zeros((len(ends), 3))
        if not len(data):
            return out
        b, at, text = _padded(data, ends)
        diff = np.empty(len(at), np.float64)
        for lo, hi, seq in _parts(b, at, ORDER):
            diff[lo:hi] = self._differences(seq, b[at[lo:hi]])
        lens = np.diff(np.concatenate([[0], ends]))
        out[:, 0] = np.bincount(text, diff, len(ends)) / np.maximum(lens, 1)
        blank = S._SPACE[data]
        start = ~blank
        start[1:] &= blank[:-1] | (text[1:] != text[:-1])
        if not start.any():
            return out
        word = np.cumsum(start) - 1
        inside = ~blank
        words = np.bincount(word[inside], diff[inside], int(start.sum()))
        first = np.searchsorted(text[start], np.arange(len(ends) + 1)).tolist()
        for i in range(len(ends)):
            k = first[i + 1] - first[i]
            if k:
                top = max(1, int(np.ceil(TOP * k)))
                own = words[first[i] : first[i + 1]]
                out[i, 1] = own.max() if top == 1 else np.partition(own, k - top)[k - top :].mean()
                out[i, 2] = np.log(k)
        return out

    def _differences(self, seq: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The log-likelihoods' difference of each place, of its last ORDER bytes."""
        t = self.made
        rows = lambda name, keys: _find(t[name], keys).view(np.float32).reshape(len(seq), -1)
        share = rows("shared_ctx", (seq >> 8) & _mask(SHARED - 1))
        low = _find(t["shared"], seq & _mask(SHARED)) * share[:, 0] + share[:, 1] * t["one"].take(last)
        ctx = rows("ctx", seq >> 8)
        own = rows("own", seq)
        p = [own[:, y] * ctx[:, 2 * y] + ctx[:, 2 * y + 1] * low + np.float32(1e-12) for y in (0, 1)]
        return np.log(p[1] / p[0]).astype(np.float64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(x))
        w, mean, std = self.curve
        z = np.column_stack([(x - mean) / std, np.ones(len(x))]) @ w
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.diag([ridge] * (a.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, std


def _evidence_rows(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(model_bc.value)
        for batch in batches:
            for row, end, data, ends in S.pieces(batch.column("text"), PIECE):
                x = m.evidence(data, ends)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(row, end - row), *[pa.array(x[:, i]) for i in range(3)]], ["toxic", "a", "b", "c"])

    return run


def _score_rows(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(model_bc.value)
        for batch in batches:
            for row, end, data, ends in S.pieces(batch.column("text"), PIECE):
                others = [batch.column(i).slice(row, end - row) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*others, pa.array(m.scores(m.evidence(data, ends)))], [*batch.schema.names, "_score"])

    return run


def fold_of(id_col):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(id_col.cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit the model; what comes to the driver grows with the distinct sequences."""
    spark = docs.sparkSession
    stage = Stage(spark, "toxicity")
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    lab = stage.table(lab.withColumn("fold", fold_of(F.col("lid"))).where("fold <> 2"), "labels")
    if lab.count() <= LABELS_BROADCAST:
        lab = F.broadcast(lab)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(lab, F.col("id") == F.col("lid"))
    model = Model()

    def got(df: DataFrame) -> list[np.ndarray]:
        t = df.toArrow()
        return [t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in t.column_names]

    def of(y: int, value):
        return F.sum(F.when(F.shiftright("key", 8 * ORDER) == y, value).otherwise(0))

    low = lambda c, n: F.col(c).bitwiseAND(F.lit(_mask(n)))
    counts = known.where("fold IN (0, 1)").select("text", "toxic").mapInArrow(_count_class, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stage.table(counts.withColumn("seq", low("key", ORDER)), "counts")
    keys, *n = got(counts.groupBy("seq").agg(of(0, F.col("n")).alias("a"), of(1, F.col("n")).alias("b")))
    own = _table(keys, _rows([np.maximum(x - DISCOUNT, 0) for x in n]), 0)
    one = F.lit(1)
    keys, *n = got(counts.groupBy(F.shiftright("seq", 8).alias("ctx")).agg(of(0, F.col("n")).alias("a"), of(0, one).alias("b"), of(1, F.col("n")).alias("c"), of(1, one).alias("d")))
    ctx = _table(keys, _rows([*_lower(*n[:2]), *_lower(*n[2:])]), _rows([np.array([x]) for x in (0, 1, 0, 1)])[0])
    seqs = docs.select(F.col(text_col).alias("text")).mapInArrow(_shared_seqs, "seq long").distinct()
    cells = stage.table(seqs.groupBy(low("seq", SHARED).alias("seq")).agg(F.count(one).alias("n")), "cells")
    keys, n = got(cells)
    shared = _table(keys, np.maximum(n - DISCOUNT, 0).astype(np.float32), 0)
    keys, *n = got(cells.groupBy(F.shiftright("seq", 8).alias("ctx")).agg(F.sum("n").alias("n"), F.count(one).alias("t")))
    shared_ctx = _table(keys, _rows(_lower(*n)), _rows([np.array([x]) for x in (0, 1)])[0])
    byte = np.zeros(256)
    keys, n = got(cells.groupBy(low("seq", 1).alias("last")).agg(F.count(one).alias("n")))
    byte[keys] = n
    model.made = {"own": own, "ctx": ctx, "shared": shared, "shared_ctx": shared_ctx, "one": ((byte + 1) / (byte.sum() + 256)).astype(np.float32)}
    stage.drop("cells", "counts")
    rows = known.where("fold = 3")
    # The bound on the curve's sample: the rows whose ids have the smallest hashes.
    ids = lab.where("fold = 3").select("lid").orderBy(F.xxhash64("lid"), "lid").limit(CURVE_ROWS)
    rows = rows.join(F.broadcast(ids.withColumnRenamed("lid", "cid")), F.col("id") == F.col("cid"))
    bc = spark.sparkContext.broadcast(vars(model))
    sample = rows.select("text", "toxic").mapInArrow(_evidence_rows(bc), "toxic int, a double, b double, c double").toArrow()
    x = np.column_stack([sample[c].to_numpy() for c in "abc"])
    y = sample["toxic"].to_numpy()
    if len(set(y.tolist())) == 2:
        order = np.lexsort((*x.T, y))
        model.curve = fit_curve(x[order], y[order].astype(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score appended; rows stream through once, without a shuffle.

    The score's name has underscores after it where ``docs`` has a column named ``out``.
    """
    out = free_name(docs, out)
    bc = docs.sparkSession.sparkContext.broadcast(vars(model))
    names = [f"c{i}" if c != text_col else "text" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    return plain.mapInArrow(_score_rows(bc), f"{schema}, _score double").toDF(*docs.columns, out)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)), model, text_col)
    return scored.select(id_col, F.coalesce(fold_of(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
