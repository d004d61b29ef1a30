"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are lowered with runs of blanks as one space, as bytes.  A region within k
edits of an item of m bytes shares at least m - q + 1 - k * q q-grams with it, on diagonals (text
place minus item place) at most k apart.  So shared q-grams are counted per item in diagonal bands
of width 2(k + 1) that overlap by half, bands below the bound are discarded, and the others are
verified by an alignment of the whole item inside the band.  k is ``RATE`` of the item's bytes, or less
where a short item leaves no q-gram to count.

A q-gram of more than ``OFTEN`` places of the items is left out where it can be: an item that ignores
f of its places still has the lemma's bound less f, so nothing is lost while that is at least 1.

Items shorter than q are found as they are, as whole words (no letter, digit or byte above 127 beside
them), by one rolling hash for each of their lengths.

The items are a query set: blocks of at most ``BLOCK_BYTES`` of item text are broadcast, and each
block meets all documents in one pass without a shuffle.  A row's work depends on that row alone.

Rows: null and empty texts match nothing; repeated rows match alike; null, empty and repeated items
are ignored (the smallest id of equal items is reported, null last); a null item id is reported as
null.  Empty tables give empty results.  Only the id and text columns are read; ``drop_leaks`` passes
all columns on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S

Q, RATE = 10, 0.08
OFTEN = 64
BLOCK_BYTES = 4 << 20
_BITS = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def normal(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes with blank runs as one space, and the texts' new ends."""
    low = _LOWER[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    starts = np.concatenate([[0], ends[:-1]])
    keep[starts[starts < len(low)]] = True
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def qgrams(b: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of the q bytes from each place on."""
    n = len(b) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * _STEP + b[k : n + k]
    return h ^ (h >> np.uint64(31))


def band_align(text: np.ndarray, item: np.ndarray, left: int, width: int, k: int) -> tuple[int, int] | None:
    """(edits, end) of the item's best alignment that starts at any place of ``text`` and keeps to the
    diagonals left to left + width - 1, if at most k edits; of equal ones the one that ends first."""
    far = np.int32(1 << 20)
    d = np.arange(left, left + width)
    step = np.arange(width, dtype=np.int32)
    # The text with enough outside it that every diagonal has a place in every row.
    before, after = max(0, 1 - left), max(0, left + width + len(item) - len(text))
    wide = np.concatenate([np.full(before, -1, np.int16), text.astype(np.int16), np.full(after, -1, np.int16)])
    row = np.where((d >= 0) & (d <= len(text)), 0, far).astype(np.int32)
    for i, c in enumerate(item.tolist(), 1):
        at = i + left - 1 + before  # of the byte that ends at diagonal left
        byte = wide[at : at + width]
        new = row + (byte != c)
        new[byte < 0] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
        row[(d + i < 0) | (d + i > len(text))] = far
        if row.min() > k:
            return None
    best = int(row.argmin())
    return (int(row[best]), int(d[best]) + len(item))


def _postings(texts: list[np.ndarray], need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item, place) of the q-grams to be counted, sorted by hash, and the counts then needed."""
    grams = [qgrams(b) for b in texts]
    h = np.concatenate([np.zeros(0, np.uint64), *grams])
    who = np.concatenate([np.zeros(0, np.int32), *[np.full(len(g), i, np.int32) for i, g in enumerate(grams)]])
    at = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(g), dtype=np.int32) for g in grams]])
    back, times = np.unique(h, return_inverse=True, return_counts=True)[1:]
    times = times[back]
    order = np.lexsort((at, -times, who))  # an item's most frequent first
    nth = np.arange(len(h)) - np.searchsorted(who[order], who[order], "left")
    left_out = order[(times[order] > OFTEN) & (nth < need[who[order]] - 1)]
    need = need - np.bincount(who[left_out], minlength=len(need))
    keep = np.ones(len(h), bool)
    keep[left_out] = False
    h, who, at = h[keep], who[keep], at[keep]
    order = np.argsort(h, kind="stable")
    return h[order], who[order], at[order], need


def index(items: list[tuple]) -> dict:
    """What a block of (id, text) needs at each task, as plain arrays."""
    ids, texts, seen = [], [], set()
    for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0)):
        raw = np.frombuffer(pc.utf8_lower(pa.scalar(text or "")).as_py().strip(" \t\n\v\f\r").encode(), np.uint8)
        b = normal(raw, np.array([len(raw)]))[0]
        if len(b) and b.tobytes() not in seen:
            seen.add(b.tobytes())
            ids.append(item)
            texts.append(b)
    k = np.array([max(0, min(int(RATE * len(b)), (len(b) - Q) // Q)) for b in texts], np.int64)
    need = np.array([len(b) - Q + 1 - Q * x for b, x in zip(texts, k, strict=True)], np.int64)
    h, who, at, need = _postings(texts, need)
    maybe = np.zeros(1 << _BITS, bool)
    maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    own, first = np.unique(h, return_index=True)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in sorted({len(b) for b in texts if len(b) < Q}):
        of = [i for i, b in enumerate(texts) if len(b) == n]
        hashes = np.array([qgrams(texts[i], n)[0] for i in of], np.uint64)
        order = np.argsort(hashes)
        short[n] = (hashes[order], np.array(of)[order])
    return {"ids": ids, "texts": texts, "k": k, "need": need, "h": own, "first": np.append(first, len(h)), "who": who, "at": at, "maybe": maybe, "short": short}


_INSIDE = np.zeros(256, bool)  # bytes that a word may hold beside a short item
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _hashes(b: np.ndarray, q: int):
    """(first place, hashes of the q bytes from there on), part by part to bound memory."""
    for lo in range(0, len(b), S.PIECE):
        yield lo, qgrams(b[lo : lo + S.PIECE + q - 1], q)


def _short_hits(b: np.ndarray, ends: np.ndarray, ix: dict):
    """(text, item, start, end) of every short item that stands as whole words."""
    starts = np.concatenate([[0], ends[:-1]])
    for n, (hashes, items) in ix["short"].items():
        for base, h in _hashes(b, n):
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                p = base + k
                t = int(np.searchsorted(ends, p, "right"))
                if p + n > ends[t] or (p > starts[t] and _INSIDE[b[p - 1]]) or (p + n < ends[t] and _INSIDE[b[p + n]]):
                    continue
                for i in items[lo[k] : hi[k]].tolist():
                    if (b[p : p + n] == ix["texts"][i]).all():
                        yield t, i, p - int(starts[t]), p + n - int(starts[t])


def _bands(b: np.ndarray, ends: np.ndarray, ix: dict):
    """(text, item, band's first diagonal) of every band that reaches its bound; diagonals count from the piece's start."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for base, h in _hashes(b, Q) if len(ix["h"]) else ():
        place = np.flatnonzero(ix["maybe"][(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(ix["h"], h[place])
        at[at == len(ix["h"])] = 0
        same = ix["h"][at] == h[place]
        found.append((base + place[same], at[same]))
    place, at = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(ends, place, "right")
    inside = place + Q <= ends[text]
    place, at, text = place[inside], at[inside], text[inside]
    if not len(place):
        return
    n = ix["first"][at + 1] - ix["first"][at]
    hit = np.repeat(ix["first"][at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    who = ix["who"][hit].astype(np.int64)
    diagonal = np.repeat(place, n) - ix["at"][hit]
    pair = np.repeat(text, n) * len(ix["ids"]) + who
    width = ix["k"][who] + 1
    for shift in (0, 1):
        band = (diagonal + shift * width) // (2 * width)
        low = int(band.min())
        span = int(band.max()) - low + 1
        key, count = np.unique(pair * span + (band - low), return_counts=True)
        i = key // span % len(ix["ids"])
        for x in key[count >= ix["need"][i]].tolist():
            t, i = divmod(x // span, len(ix["ids"]))
            w = int(ix["k"][i]) + 1
            yield t, i, (x % span + low) * 2 * w - shift * w


def search(b: np.ndarray, ends: np.ndarray, ix: dict) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the best region of each text and item."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    starts = np.concatenate([[0], ends[:-1]])

    def note(t: int, i: int, edits: int, lo: int, hi: int) -> None:
        if (t, i) not in best or (edits, lo) < best[t, i][:2]:
            best[t, i] = (edits, lo, hi)

    for t, i, lo, hi in _short_hits(b, ends, ix):
        note(t, i, 0, lo, hi)
    for t, i, diagonal in _bands(b, ends, ix):
        k, item = int(ix["k"][i]), ix["texts"][i]
        low, high = diagonal - k, diagonal + 2 * (k + 1) + k  # the band, and what k edits may leave it by
        lo_, hi_ = max(int(starts[t]), low), min(int(ends[t]), high + len(item))
        part, base = b[lo_:hi_], lo_ - int(starts[t])
        if (p := part.tobytes().find(item.tobytes())) >= 0:
            note(t, i, 0, base + p, base + p + len(item))
        elif (r := band_align(part, item, low - lo_, high - low, k)) is not None:
            # The same from its end backwards finds where it starts.
            back = band_align(part[: r[1]][::-1], item[::-1], -k, 2 * k + 1, r[0])
            note(t, i, r[0], base + r[1] - (back[1] if back else len(item)), base + r[1])
    return [(t, i, *best[t, i]) for t, i in sorted(best)]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[dict]:
    """The items' indexes, block by block, each of bounded size."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL AND t <> ''")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = math.ceil(total / BLOCK_BYTES)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k) if n > 1 else items
        yield index([(r["i"], r["t"]) for r in part.collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, start, end) of every document and item that match; places in the normal form."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, edits int, start long, end long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def matcher(bc):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = bc.value
            for batch in batches:
                for row, _, data, ends in S.pieces(pc.utf8_lower(batch.column("text"))):
                    found = search(*normal(data, ends), ix)
                    if found:
                        t, i, e, lo, hi = zip(*found, strict=True)
                        ids = batch.column("id").take(pa.array([row + x for x in t]))
                        items = [ix["ids"][x] for x in i]
                        yield pa.RecordBatch.from_arrays([ids, pa.array(items), pa.array(e, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["id", "item", "edits", "start", "end"])

        return run

    out = spark.createDataFrame([], schema)
    for ix in blocks(benchmark, item_col, item_text):
        out = out.unionByName(rows.mapInArrow(matcher(spark.sparkContext.broadcast(ix)), schema))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "start", "end")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that match an item; rows stream through, without a shuffle."""
    spark = docs.sparkSession
    place = docs.columns.index(text_col)

    def sieve(bc):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = bc.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _, data, ends in S.pieces(pc.utf8_lower(batch.column(place))):
                    clean[[row + x[0] for x in search(*normal(data, ends), ix)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for ix in blocks(benchmark, item_col, item_text):
        docs = docs.mapInArrow(sieve(spark.sparkContext.broadcast(ix)), docs.schema)
    return docs
