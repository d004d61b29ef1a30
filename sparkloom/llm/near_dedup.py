"""Near-duplicates by an LSH forest over MinHash signatures.

Every document's set of word 5-shingles gets ``TREES`` sorted signature orders.  A tree's key is a
run of signature values: the first ``DEPTH`` must agree (a region), the next decide the order inside
a region, so that neighbours there share the longest prefixes.

First, groups of many copies: in a region of more than ``SMALL`` documents each meets the region's
hub, the document that lies in the largest regions over all trees, as the original of a group does.
Documents linked to one hub are known to be of one component.  Then every tree is walked in order: a
document meets the ``NEAR`` that follow it in its region, so that in a region of up to ``NEAR`` + 1 all
pairs meet and in a larger one the depth adapts to the longest common prefixes.  Pairs that have one hub
already are left out, as no link between them changes the result.  The orders are one distributed
sort, so the largest region is spread over many tasks; what the task boundaries separate is paired
in a second, small pass.

Last, the rest: a region of more than ``NEAR`` + 1 documents that still holds more than one component
is compared in full, every pair of different components, on full sets and without an estimate.  It is
dealt out in blocks of about ``BLOCK`` documents, and a component that fills blocks of its own is not
compared with itself.  A task gives no more links than join its components, so that the rows grow
with the documents, while the comparisons grow with the square of such a region.

The walk's candidates are dropped when set sizes or signatures (``NIBBLE`` bits a value; ``EST`` is almost
five standard errors below 0.75) rule a link out.  All others are confirmed on full sets, which are computed
again from the texts of the documents that have a candidate (found by a hash of id and text, broadcast
up to ``ASKED_BROADCAST`` of them).

At similarity 0.75 a pair shares no region with probability (1 - 0.75**3)**24, about 2e-6; the
estimate loses such a pair with 9e-6, for independent values.

Documents with equal sets are one node (128-bit fingerprint of the set).  Rows: null or blank text
has an empty set, links with nothing and is its own component; repeated rows are equal sets; a null
id takes part but is never the least (a component of null ids alone has a null id, and all its rows are
kept, as equal to it).  An empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .components import components
from .scratch import Stage, shuffle_width

TREES, DEPTH, DEEPER = 24, 3, 4
HASHES = TREES * DEPTH
SMALL, NEAR = 8, 16
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
EST = 0.5
NIBBLE = 4
SKETCH = HASHES * NIBBLE // 8
ALIKE = HASHES * (EST + (1 - EST) / 2**NIBBLE)  # equal nibbles at that similarity
ASKED_BROADCAST = 1_000_000
PERCENT = 75

_rng = np.random.default_rng(75)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EQUAL = np.array([(b < 16) + (b % 16 == 0) for b in range(256)], np.uint8)  # zero nibbles of a byte
_FP = _rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = S.mix(s * _FP[0]).sum(dtype=np.uint64)
    b = S.mix(s ^ _FP[1]).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES 32-bit minima per set; no set may be empty."""
    flat = np.concatenate(sets)
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((flat ^ _XOR[k]) * _MUL[k]) >> np.uint64(32), off)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, ...) without the text, with set size, fingerprint and signature."""
    for batch in batches:
        names = [c for c in batch.schema.names if c != "text"]
        for row, sets in S.text_sets(batch.column("text")):
            full = [i for i, s in enumerate(sets) if len(s)]
            sig, fps = [None] * len(sets), [None] * len(sets)
            if full:
                for i, values in zip(full, signatures([sets[i] for i in full]), strict=True):
                    sig[i], fps[i] = values.tobytes(), fingerprint(sets[i])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(row, len(sets)) for c in names], pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(sig, pa.binary())],
                [*names, "n", "fp", "sig"],
            )


def _regions(sig: np.ndarray, t: int) -> np.ndarray:
    region = np.full(len(sig), t + 1, np.uint64)
    for j in range(DEPTH):
        region = S.mix(region * np.uint64(31) + sig[:, DEPTH * t + j])
    return region.view(np.int64)


def _signs(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node and tree: region, node."""
    for batch in batches:
        if batch.num_rows:
            sig = _signs(batch)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(_regions(sig, t)), batch.column("fp")], ["region", "fp"])


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node and tree: region, order inside it, set size, hub, node, sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _signs(batch)
        low = (sig & np.uint64(15)).astype(np.uint8)
        sketch = pa.array([r.tobytes() for r in low[:, 0::2] << 4 | low[:, 1::2]], pa.binary())
        for t in range(TREES):
            deep = np.zeros(len(sig), np.uint64)
            for j in range(DEEPER):
                deep = (deep << np.uint64(16)) | (sig[:, (DEPTH * (t + 1) + j) % HASHES] & np.uint64(0xFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(_regions(sig, t)), pa.array(deep.view(np.int64)), batch.column("n"), batch.column("root"), batch.column("fp"), sketch], _ROW)


_ROW = ["region", "deep", "n", "root", "fp", "sketch"]
_ROW_TYPES = "region long, deep long, n long, root long, fp binary, sketch binary"


def _pairs_of(t: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Candidates among rows sorted by (region, deep, fp)."""
    region, n, root = (t[c].to_numpy() for c in ("region", "n", "root"))
    fp = t["fp"].combine_chunks()
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
    left, right = [], []
    for s in range(1, min(NEAR + 1, len(region))):
        near = region[s:] == region[:-s]
        if not near.any():
            break
        at = np.flatnonzero(near & (root[s:] != root[:-s]))
        x, y = n[at], n[at + s]
        at = at[np.minimum(x, y) * 100 >= np.maximum(x, y) * PERCENT]
        at = at[_EQUAL[sketch[at] ^ sketch[at + s]].sum(axis=1, dtype=np.int64) >= ALIKE]
        left.append(at)
        right.append(at + s)
    at, to = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    return fp.take(pa.array(at)), fp.take(pa.array(to))


def _found(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    """Pairs, in the columns of rows."""
    none = [pa.nulls(len(a), pa.int64())] * 4
    return pa.RecordBatch.from_arrays([*none, a, pa.nulls(len(a), pa.binary()), b], [*_ROW, "b"])


def _end(t: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in t.combine_chunks().to_batches():
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], [*_ROW, "b"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk one task's sorted rows: a row with b is a pair (fp, b), one without is near the task's ends.

    Rows are worked on in slices of ``SLICE``; the last ``NEAR`` of a slice begin the next, so that
    memory does not grow with a region.
    """
    SLICE = 16384
    held, size, first = [], 0, True
    t = None

    def work() -> Iterator[pa.RecordBatch]:
        nonlocal first
        if first:
            first = False
            yield from _end(t.slice(0, NEAR))
        a, b = _pairs_of(t)
        if len(a):
            yield _found(a, b)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= SLICE:
            t = pa.Table.from_batches(held)
            yield from work()
            held = t.slice(len(t) - NEAR).combine_chunks().to_batches()
            size = NEAR
    if size:
        t = pa.Table.from_batches(held)
        yield from work()
        yield from _end(t.slice(max(0, len(t) - NEAR)))


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among the end rows of tasks, grouped by region."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = _pairs_of(pa.Table.from_batches(held))
    if len(a):
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the asked-for nodes; a row whose set is another's goes."""
    for batch in batches:
        want = batch.column("fp").to_pylist()
        for row, sets in S.text_sets(batch.column("text")):
            hit = [(want[row + i], s.tobytes()) for i, s in enumerate(sets) if len(s) and fingerprint(s) == want[row + i]]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*hit, strict=True)], ["fp", "set"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(p, q)
            both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
            good.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _linked(t: pa.Table) -> pa.Table:
    """Links that join the components of two blocks, of all pairs whose full sets reach the similarity."""
    sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
    n = np.array([len(s) for s in sets])
    root, side = t["root"].to_numpy(), t["side"].to_numpy()
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(len(values), np.int32)
    comp = np.unique(root, return_inverse=True)[1]
    one = side[0] == side[-1] and not (side != side[0]).any()
    left, right = [], []
    for i in range(len(sets)) if one else np.flatnonzero(side == 0).tolist():
        apart = comp != comp[i]
        apart &= (np.arange(len(sets)) > i) if one else side == 1
        apart &= np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * PERCENT
        if not apart.any():
            continue
        own = ids[off[i] : off[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids], off[:-1])
        mark[own] = 0
        for j in np.flatnonzero(apart & (100 * both >= PERCENT * (n + n[i] - both))).tolist():
            if comp[i] != comp[j]:
                comp[comp == comp[j]] = comp[i]
                left.append(i)
                right.append(j)
    fp = t["fp"].combine_chunks()
    return pa.table([fp.take(pa.array(x, pa.int64())) for x in (left, right)], ["u", "v"])


def _ordered_pair(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _involved(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()


def hub_pairs(nodes: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b, score) of a node and the hub b of a large region, of nodes (fp, n, sig); the large regions' nodes."""
    members = stage.table(nodes.select("fp", "sig").mapInArrow(_members, "region long, fp binary"), "members")
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SMALL)
    sizes = stage.table(sizes, "sizes")
    large = stage.table(members.join(sizes, "region"), "large")
    score = stage.table(large.groupBy("fp").agg(F.sum("size").alias("score")), "score")
    best = F.max(F.struct("score", F.col("fp").alias("b"))).alias("x")
    hubs = stage.table(large.join(score, "fp").groupBy("region").agg(best).select("region", "x.b", "x.score"), "hubs")
    n = nodes.select("fp", "n")
    pairs = large.join(hubs, "region").where("fp <> b").select(F.col("fp").alias("a"), "b", "score").distinct()
    pairs = pairs.join(n.select(F.col("fp").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("fp").alias("b"), F.col("n").alias("nb")), "b")
    pairs = stage.table(pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b", "score"), "hub-pairs")
    stage.drop("members", "sizes", "score", "hubs")
    return pairs, large


def hub_labels(pairs: DataFrame, links: DataFrame, stage: Stage) -> DataFrame:
    """(u, root): the hub with the highest score that a node is linked to or is, or that hub's; one label is one component."""
    linked = pairs.join(links.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"])
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), "score", "b"), F.struct(F.col("b").alias("u"), "score", "b"))).alias("x")
    own = stage.table(linked.select(ends).select("x.*").groupBy("u").agg(F.max(F.struct("score", "b"))["b"].alias("root")), "own-hubs")
    # A hub may have a hub of its own, which is then its documents' label.
    of = own.where("u <> root").select(F.col("u").alias("root"), F.col("root").alias("next"))
    return stage.table(own.join(of, "root", "left").select("u", F.coalesce("next", "root").alias("root")), "labels")


def walk_pairs(nodes: DataFrame, roots: DataFrame, stage: Stage) -> DataFrame:
    """Distinct candidate pairs (a, b) of neighbours in the trees whose hubs differ."""
    width = shuffle_width(nodes.sparkSession)
    known = nodes.join(roots.select(F.col("u").alias("fp"), F.col("root").alias("r")), "fp", "left")
    rows = known.select("n", "fp", "sig", F.xxhash64(F.coalesce("r", "fp")).alias("root")).mapInArrow(_plant, _ROW_TYPES)
    walked = stage.table(
        rows.repartitionByRange(width, "region", "deep", "fp").sortWithinPartitions("region", "deep", "fp").mapInArrow(_walk, f"{_ROW_TYPES}, b binary"),
        "walk",
    )
    pairs = walked.where("b IS NOT NULL").select(F.col("fp").alias("a"), "b")
    ends = walked.where("b IS NULL").select(*_ROW).dropDuplicates(["region", "fp"]).repartition(width, "region").sortWithinPartitions("region", "deep", "fp")
    pairs = pairs.unionByName(ends.mapInArrow(_seams, "a binary, b binary"))
    pairs = stage.table(_ordered_pair(pairs).distinct(), "pairs")
    stage.drop("walk")
    return pairs


def full_sets(asked: DataFrame, most: int, nodes: DataFrame, docs: DataFrame, stage: Stage, label: str) -> DataFrame:
    """(fp, set) of the asked-for nodes (fp), at most ``most``, computed again from the texts."""
    asked = nodes.join(asked, "fp", "left_semi").select("fp", F.col("rep.key").alias("key"))
    if most <= ASKED_BROADCAST:  # else the texts are shuffled to their keys
        asked = F.broadcast(asked)
    texts = docs.join(asked, "key").select("fp", "text")
    return stage.table(texts.mapInArrow(_sets, "fp binary, set binary").dropDuplicates(["fp"]), f"{label}-sets")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, stage: Stage, label: str) -> DataFrame:
    """The pairs (a, b) whose full sets, computed again from the texts, reach the similarity, as edges (u, v)."""
    sets = full_sets(_involved(pairs), 2 * pairs.count(), nodes, docs, stage, label)
    sa = sets.select(F.col("fp").alias("a"), F.col("set").alias("xa"))
    sb = sets.select(F.col("fp").alias("b"), F.col("set").alias("xb"))
    # b may be the hub of many: its set is joined while the rows are small.
    full = pairs.select("a", "b").join(sb, "b").join(sa, "a").select("a", "b", "xa", "xb")
    links = stage.table(full.mapInArrow(_confirm, "a binary, b binary").select(F.col("a").alias("u"), F.col("b").alias("v")), f"{label}-links")
    stage.drop(f"{label}-sets")
    return links


def rest_links(large: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, stage: Stage) -> DataFrame:
    """Links (u, v) between components that one large region holds, of all pairs there."""
    known = large.where(F.col("size") > NEAR + 1).select("region", "fp").join(roots.select(F.col("u").alias("fp"), F.col("root").alias("r")), "fp", "left")
    rows = stage.table(known.join(nodes.select("fp", "n"), "fp").select("region", "fp", "n", F.xxhash64(F.coalesce("r", "fp")).alias("root")), "placed")
    some = rows.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("region")
    rows = stage.table(rows.join(some, "region"), "apart")
    blocks = lambda m, n: F.ceil(F.greatest(F.col(m) / BLOCK, F.col(n) / BLOCK_SHINGLES))
    of = rows.groupBy("region", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).withColumn("k", blocks("m", "s"))
    of = stage.table(of, "of-root")
    few = of.where("k = 1").groupBy("region").agg(F.sum("m").alias("ms"), F.sum("s").alias("ss")).select("region", blocks("ms", "ss").alias("ks"))
    dealt = rows.join(of.select("region", "root", "k"), ["region", "root"]).join(few, "region", "left")
    own = F.when(F.col("k") > 1, F.col("root"))  # the one component of a block, or null where many share it
    block = F.when(F.col("k") > 1, F.xxhash64("root", F.pmod(F.xxhash64("fp"), "k"))).otherwise(F.pmod(F.xxhash64("root"), "ks"))
    dealt = stage.table(dealt.select("region", "fp", "root", own.alias("own"), block.alias("block")), "dealt")
    b = dealt.select("region", "block", "own").distinct()
    c = b.select("region", F.col("block").alias("other"), F.col("own").alias("others"))
    met = b.join(c, "region").where("block <= other AND (own IS NULL OR others IS NULL OR own <> others)")
    meets = stage.table(met.select("region", "block", "other", F.xxhash64("region", "block", "other").alias("meet")), "meets")
    sides = meets.select("region", "block", "meet", F.lit(0).alias("side")).unionByName(meets.where("block <> other").select("region", F.col("other").alias("block"), "meet", F.lit(1).alias("side")))
    sets = full_sets(dealt.select("fp").distinct(), dealt.count(), nodes, docs, stage, "rest")
    dealt = dealt.join(sides, ["region", "block"]).join(sets, "fp").select("meet", "side", "root", "fp", "set")
    return stage.table(dealt.groupBy("meet").applyInArrow(_linked, "u binary, v binary"), "rest-links")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, and with ``row`` also rid and first.

    ``row`` names a long that differs between rows; ``first`` marks exactly one row of each component,
    the first by id (null last) and ``row``, also where ids repeat or are null.
    """
    spark = df.sparkSession
    stage = Stage(spark, "near")
    kind = df.schema[id_col].dataType.simpleString()
    rid = F.lit(0).cast("long") if row is None else F.col(f"`{row}`")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), rid.alias("rid"))
    # By its key a node's text is found again: ids may repeat or be null.
    docs = docs.withColumn("key", F.xxhash64(F.col("id").isNull(), "id", "text"))
    signed = stage.table(docs.mapInArrow(_sign, f"id {kind}, rid long, key long, n long, fp binary, sig binary"), "signed")
    first = F.struct(F.col("id").isNull().alias("z"), "id", "rid", "key", "sig")
    nodes = signed.where("fp IS NOT NULL").groupBy("fp", "n").agg(F.min(first).alias("x"))
    nodes = stage.table(nodes.select("fp", "n", F.struct("x.z", "x.id", "x.rid", "x.key").alias("rep"), F.col("x.sig").alias("sig")), "nodes")
    hubs, large = hub_pairs(nodes, stage)
    near_hub = confirmed(hubs, nodes, docs, stage, "hub")
    labels = hub_labels(hubs, near_hub, stage)
    links = confirmed(walk_pairs(nodes, labels, stage), nodes, docs, stage, "walk")
    edges = near_hub.unionByName(links)
    roots = stage.table(components(edges, stage, "cc"), "roots")
    rest = rest_links(large, roots, nodes, docs, stage)
    if not rest.isEmpty():
        edges = roots.select("u", F.col("root").alias("v")).unionByName(rest)
        roots = stage.table(components(edges, stage, "rest"), "all-roots")
    rooted = stage.table(nodes.select("fp", "rep").join(roots.select(F.col("u").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stage.table(rooted.groupBy("root").agg(F.min("rep").alias("least")), "least")
    ids = stage.table(rooted.join(least, "root").select("fp", F.col("least.id").alias("least"), F.col("least.rid").alias("least_rid")), "ids")
    stage.keep("signed", "ids")
    out = signed.select("id", "rid", "n", "fp").join(ids, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("least"))
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")]
    if row is not None:
        cols += [F.col("rid"), (F.col("fp").isNull() | (F.col("rid") == F.col("least_rid"))).alias("first")]
    return out.select(*cols)


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    return near_groups(df, id_col, text_col)
