"""Operator 10, n-gram Jaccard join: all pairs of documents whose sets of word n-grams have a Jaccard
similarity of at least ``threshold``, exactly, by a prefix-tree join.

1. Every document's set of n-gram hashes is dealt to buckets of hashes (packed arrays, a few bytes a gram). A
   bucket knows which of its grams a second document has. A partner shares at least ceil(t * n) of a
   document's n grams, so documents with fewer shared grams than that have no partner, and leave.
2. For those that stay (the near copies, mostly), the same exchange brings back how many documents have each
   shared gram. Grams are put in one global order, rarest first. Documents with equal sets become one node,
   named by the smallest id.
3. Two sets with Jaccard >= t have a gram in common among the first n - ceil(t * n) + 1 of either. Of the nodes with
   a gram in these prefixes and sizes that can match, the first in one order of all nodes is the gram's pivot, and the
   nodes of the grams of a pivot are a block: each pair is in one at least. Grams of one text have few different
   pivots, and blocks don't chain: a gram that two unlike texts share by chance joins these two and not what each is
   near to. A pair that lies in several blocks counts in the one whose pivot comes first. Blocks of more than ``CHUNK``
   documents (copies of one text, pairs for the most part) are cut into chunks, and each pair of chunks is a task of
   its own.
4. In a block the sets are stored in a trie over the block's global order of grams (most frequent first, so
   that copies share paths), 64 grams a level. The trie is traversed against itself from the root: a pair of
   nodes carries the overlap of all sets below them so far, counted once; a pair of subtrees is cut when the
   overlap and the grams that remain in the shorter one can't reach t / (1 + t) * (n1 + n2).
5. Where only classes are asked for, each node is first compared with its pivots alone, and those alike are joined up.
   Then only pairs of nodes of different classes are left, and of these, as Jaccard distance is a metric, only those
   whose distances to the pivot differ by 1 - t at most. While many are left, and another pivot halves them, blocks get
   one. A large group of near copies costs a comparison for each node and pivot, not one for each pair.

Results, all exact:

* ``jaccard_classes`` (the query): (doc_id, class_id, links), a row for each document: the smallest id of those that are
  joined to it, directly or by way of others (its own, if none is), and the number of other documents that are alike
  enough, every copy counted. Its length is that of the input, however large the groups.
* ``jaccard_join``: pairs (doc_a, doc_b, jaccard), doc_a < doc_b. Of each two different sets that are alike enough there
  is the pair of the smallest ids that have them; each further document with a set is paired with the smallest id that
  has it, at 1.0. All pairs of documents follow from these.
* ``dedup``: the input, one document of each class.

Buckets are as many as the texts' bytes ask for (some MB each), whatever the number of partitions. Grams are told
apart by 64-bit hashes with a seed drawn anew for each run, so no text can be made to look like another; that two
given grams look alike by chance has odds of 2**-64.

Defined results: documents with null ids or texts, and those without a word, have no partner (``jaccard_classes``
returns no row for null ids); one of fewer than n words has one gram, all its words; rows of the same id are one
document with the grams of all of them; ids may be of any type that can be ordered; further columns, whatever their
names, are dropped by ``jaccard_join`` and ``jaccard_classes`` and returned untouched by ``dedup``; an empty table gives
an empty table.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import fresh, in_batches, in_groups, mix, numbered, pack, ranges, reachable, renamed, scratch, sized, slices, stored, table, unpack
from readloom.llm.grams import WORD, ngrams, sets, words

N = 3
THRESHOLD = 0.5
#: Documents of a block that are joined in one task; a larger block is joined chunk by chunk.
CHUNK = 1024
_SMALL = 64
#: Links up to this number (16 bytes each) are joined up by the driver.
LOCAL_LINKS = 1 << 20
#: Other pivots of a block, at most, of which the pairs are left out before they are looked at.
PIVOTS = 32
#: Pairs left for each node and pivot, up to which blocks aren't given another pivot where only classes are asked for.
FEW = 4
_EPS = 1e-9


def _least(n, threshold: float):
    """The grams that a partner shares at least."""
    return np.ceil(np.asarray(n) * threshold - _EPS).astype(np.int64)


#: Bytes of text for each bucket of grams, and the most buckets (as powers of two).
BUCKET_BYTES = 1 << 23
_BITS = 5, 20
#: Grams that are dealt to the buckets at once, for each bucket and in all.
_DEALT = 16, 1 << 21


def _bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(_BITS[1], max(_BITS[0], (int(size) // BUCKET_BYTES).bit_length()))


def _by(df: DataFrame, key: str, bits: int):
    """Grouped by bucket; over more partitions than the session's where there are many more buckets."""
    wanted = (1 << bits) // 8
    if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(wanted, key)
    return df.groupBy(key)


def _deal(part: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns by part, each in the order it had."""
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, [c[cut[p] : cut[p + 1]] for c in columns]


def _deltas(ids: np.ndarray) -> bytes:
    """Ascending ids."""
    return int(ids[0]).to_bytes(8, "little", signed=True) + pack(np.diff(ids))


def _ids(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([[int.from_bytes(raw[:8], "little", signed=True)], unpack(raw[8:]).astype(np.int64)]))


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(rows)])


def _dealt_grams(df: DataFrame, n: int, bits: int, short: bool, seed: int) -> DataFrame:
    """(bucket, ids, counts, grams): of some slices of the input at a time, the distinct grams by bucket. short: 32
    bits below the bucket's are enough (grams taken for equal only add to what is shared)."""
    enough = min(_DEALT[1], max(1 << 17, _DEALT[0] << bits))

    def deal(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0] + [len(h[0]) for h in held])
        ids, rank = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        rows, grams = sets(rank[np.concatenate([h[1] + b for h, b in zip(held, before)])], np.concatenate([h[2] for h in held]))
        if not len(rows):
            return
        out = ([], [], [], [])
        for bucket, (r, g) in _deal((grams >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, rows, grams):
            first, counts = _runs(r)
            out[0].append(bucket)
            out[1].append(_deltas(ids[r[first]]))
            out[2].append(pack(counts))
            out[3].append(((g >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() if short else g.tobytes())
        yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "ids", "counts", "grams"), (pa.array(out[0], pa.int32()), *(pa.array(o, pa.binary()) for o in out[1:])))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                found, ends, *_ = words(part.column("text"), seed)
                held.append((np.asarray(part.column("doc_id")), *ngrams(found, ends, n)))
                if sum(len(h[2]) for h in held) >= enough:
                    yield from deal(held)
                    held = []
        if held:
            yield from deal(held)

    return in_batches(df.select("doc_id", "text"), work, "bucket int, ids binary, counts binary, grams binary")


def _bucket(rows: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id and length of each run, grams, how many documents have each)."""
    ids = np.concatenate([_ids(x) for x in rows.column("ids").to_pylist()])
    counts = np.concatenate([unpack(x) for x in rows.column("counts").to_pylist()])
    grams = np.concatenate([np.frombuffer(x, kind) for x in rows.column("grams").to_pylist()])
    order = np.argsort(grams)
    first, times = _runs(grams[order])
    df = np.empty(len(grams), np.int64)
    df[order] = np.repeat(times, times)
    return ids, counts, grams, df


def _parts(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _candidates(docs: DataFrame, n: int, threshold: float, bits: int, seed: int) -> DataFrame:
    """Ids of the documents of which enough grams are shared."""
    parts = 1 << bits

    def shared(rows: pa.Table) -> pa.Table:
        ids, counts, _, df = _bucket(rows, np.uint32)
        own = np.add.reduceat((df > 1).astype(np.int64), np.cumsum(counts) - counts)
        order = np.argsort(ids, kind="stable")
        ids, counts, own = ids[order], counts[order], own[order]
        out = ([], [], [], [])
        for p, (i, c, s) in _deal(_parts(ids, parts), parts, ids, counts, own):
            for o, x in zip(out, (p, _deltas(i), pack(c), pack(s))):
                o.append(x)
        return pa.table({"part": pa.array(out[0], pa.int32()), "ids": pa.array(out[1], pa.binary()), "counts": pa.array(out[2], pa.binary()), "shared": pa.array(out[3], pa.binary())})

    def kept(rows: pa.Table) -> pa.Table:
        ids, at = np.unique(np.concatenate([_ids(x) for x in rows.column("ids").to_pylist()]), return_inverse=True)
        total, own = (np.bincount(at, np.concatenate([unpack(x) for x in rows.column(c).to_pylist()])).astype(np.int64) for c in ("counts", "shared"))
        return pa.table({"doc_id": ids[own >= np.maximum(1, _least(total, threshold))]})

    by_bucket = in_groups(_by(_dealt_grams(docs, n, bits, True, seed), "bucket", bits), shared, "part int, ids binary, counts binary, shared binary")
    return in_groups(_by(by_bucket, "part", bits), kept, "doc_id bigint")


def _sets(docs: DataFrame, n: int, threshold: float, bits: int, seed: int) -> DataFrame:
    """(doc_id, n, grams, lead, f, g, alone): of each document the size of its set, those of its grams that others
    have too (rarest first), how many of these lie in its prefix, two sums over them, and, where not all are
    shared, its id."""
    parts = 1 << bits

    def shared(rows: pa.Table) -> pa.Table:
        ids, counts, grams, df = _bucket(rows, np.uint64)
        two = df > 1
        own = np.add.reduceat(two.astype(np.int64), np.cumsum(counts) - counts)
        starts = np.cumsum(own) - own
        grams, df = grams[two], df[two]
        order = np.argsort(ids, kind="stable")
        ids, counts, own, starts = ids[order], counts[order], own[order], starts[order]
        out = ([], [], [], [], [], [])
        for p, (i, c, s, b) in _deal(_parts(ids, parts), parts, ids, counts, own, starts):
            at = ranges(b, s)
            for o, x in zip(out, (p, _deltas(i), pack(c), pack(s), grams[at].tobytes(), pack(df[at]))):
                o.append(x)
        names = ("ids", "counts", "shared", "grams", "df")
        return pa.table({"part": pa.array(out[0], pa.int32())} | {k: pa.array(o, pa.binary()) for k, o in zip(names, out[1:])})

    def whole(rows: pa.Table) -> pa.Table:
        get = lambda c: np.concatenate([unpack(x) for x in rows.column(c).to_pylist()])
        ids, at = np.unique(np.concatenate([_ids(x) for x in rows.column("ids").to_pylist()]), return_inverse=True)
        counts, own, df = get("counts"), get("shared"), get("df").astype(np.int64)
        grams = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()])
        of = np.repeat(at, own)
        order = np.lexsort((grams, df, of))
        of, grams = of[order], grams[order]
        once = np.r_[True, (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])] if len(of) else np.zeros(0, bool)
        of, grams = of[once], grams[once]
        own = np.bincount(of, minlength=len(ids))
        size = np.bincount(at, counts - get("shared")).astype(np.int64) + own
        lead = size - _least(size, threshold) + 1 - (size - own)
        stay = (own >= _least(size, threshold)) & (lead > 0)
        ends = np.cumsum(own)
        first = mix(grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        second = mix(grams * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2))
        sums = [(s[ends] - s[ends - own]).astype(np.int64) for s in (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (first, second))]
        out: dict[str, list] = {k: [] for k in ("doc_id", "n", "grams", "lead", "f", "g", "alone")}
        for k in np.flatnonzero(stay).tolist():
            a, b = int(ends[k] - own[k]), int(ends[k])
            row = (int(ids[k]), int(size[k]), grams[a:b].tobytes(), int(lead[k]), *(int(s[k]) for s in sums), int(ids[k]) if own[k] < size[k] else None)
            for o, x in zip(out.values(), row):
                o.append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    by_bucket = _by(_dealt_grams(docs, n, bits, False, seed), "bucket", bits)
    by_part = _by(in_groups(by_bucket, shared, "part int, ids binary, counts binary, shared binary, grams binary, df binary"), "part", bits)
    return in_groups(by_part, whole, "doc_id bigint, n bigint, grams binary, lead bigint, f bigint, g bigint, alone bigint")


def _copies(each: DataFrame) -> DataFrame:
    """(doc, doc_id): the documents with the set of one with a smaller id, the smallest. Equal sets are shared
    throughout, so the sums over what is shared (128 bits) tell them apart."""
    key = ["f", "g", "n"]
    whole = each.where("alone is null").select("doc_id", *key)
    first = whole.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.count("*").alias("times")).where("times > 1").drop("times")
    return whole.join(first, key).where("doc_id > doc").select("doc", "doc_id")


def _links(nodes: DataFrame, threshold: float, bits: int) -> DataFrame:
    """(root, doc, own): the pivots of each node, and whether it is the pivot itself. Nodes with a common gram in their prefixes, and of sizes that can match,
    have one in common. In the order of their sizes the nodes of a gram are cut wherever the next is too large for the
    one before, so for all before; a stretch of two nodes or more has a pivot, the first of them in the order of
    hashed ids, whose hash names it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(np.asarray(batch.column("doc")), kind="stable")
            docs, leads, sizes = (np.asarray(batch.column(c))[order] for c in ("doc", "lead", "n"))
            raw = batch.column("grams").to_pylist()
            if not len(docs):
                continue
            grams = np.concatenate([np.frombuffer(raw[k], np.uint64, int(lead)) for k, lead in zip(order.tolist(), leads)])
            out = ([], [], [], [], [])
            for bucket, (r, g) in _deal((grams >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, np.repeat(np.arange(len(docs)), leads), grams):
                first, counts = _runs(r)
                for o, x in zip(out, (bucket, _deltas(docs[r[first]]), pack(sizes[r[first]]), pack(counts), g.tobytes())):
                    o.append(x)
            names = ("bucket", "ids", "sizes", "counts", "grams")
            yield pa.RecordBatch.from_pydict(dict(zip(names, (pa.array(out[0], pa.int32()), *(pa.array(o, pa.binary()) for o in out[1:])))))

    def link(rows: pa.Table) -> pa.Table:
        ids = np.concatenate([_ids(x) for x in rows.column("ids").to_pylist()])
        counts, sizes = (np.concatenate([unpack(x) for x in rows.column(c).to_pylist()]) for c in ("counts", "sizes"))
        owner, size = np.repeat(ids, counts), np.repeat(sizes, counts)
        grams = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()])
        order = np.lexsort((owner, size, grams))
        owner, size, grams = owner[order], size[order], grams[order]
        first = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (size[:-1] < threshold * size[1:] - _EPS)])
        times = np.diff(np.r_[first, len(grams)])
        pivot = np.repeat(np.minimum.reduceat(mix(owner.astype(np.uint64)).astype(np.int64), first), times) if len(first) else owner
        some = np.repeat(times, times) > 1
        pivot, owner = pivot[some], owner[some]
        order = np.lexsort((owner, pivot))
        pivot, owner = pivot[order], owner[order]
        new = np.r_[True, (pivot[1:] != pivot[:-1]) | (owner[1:] != owner[:-1])] if len(owner) else np.zeros(0, bool)
        return pa.table({"root": pivot[new], "doc": owner[new], "own": mix(owner[new].astype(np.uint64)).astype(np.int64) == pivot[new]})

    dealt = in_batches(nodes.select("doc", "lead", "n", "grams"), deal, "bucket int, ids binary, sizes binary, counts binary, grams binary")
    return in_groups(_by(dealt, "bucket", bits), link, "root bigint, doc bigint, own boolean").distinct()


def _local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, root) in memory: the lower label wins over every link, and labels jump to their label's label."""
    docs, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(docs))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        for end in (label[u], label[v], u, v):
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            return docs, docs[label]


def components(links: DataFrame) -> DataFrame:
    """(doc, root) of all documents of the links (a, b), root the smallest id of the component. Up to
    ``LOCAL_LINKS`` links, counted first, are joined up in memory; more by alternating large and small stars over
    the cluster, each round stored so that lineage doesn't grow."""
    spark = links.sparkSession
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    loops, edges = edges.where("u = v"), edges.where("u < v")
    if edges.count() <= LOCAL_LINKS:
        rows = edges.toPandas()
        docs, roots = _local_components(rows.v.to_numpy(np.int64), rows.u.to_numpy(np.int64))
        found = spark.createDataFrame(pa.table({"doc": pa.array(docs, pa.int64()), "root": pa.array(roots, pa.int64())}))
    else:
        found = _star_components(edges)
    alone = loops.select(F.col("v").alias("doc")).join(found, "doc", "left_anti")
    return found.union(alone.select("doc", F.col("doc").alias("root")))


def _star_components(edges: DataFrame) -> DataFrame:
    mark = None
    while True:
        both = edges.union(edges.select("u", "v"))
        low = F.least("v", F.min("u").over(Window.partitionBy("v")))
        large = both.select("v", "u", low.alias("m")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        small = large.select("v", "u", F.min("u").over(Window.partitionBy("v")).alias("m"))
        small = small.select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("v").alias("doc"), F.col("u").alias("root")).union(edges.select("u", "u").distinct())


def trie_join(group: np.ndarray, side: np.ndarray, n: np.ndarray, grams: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, grams in common) of all pairs of a group whose Jaccard reaches the threshold. side: 0 for all of
    a group that is joined with itself; 1 and 2 where only pairs between the two count."""
    sizes = np.array([len(g) for g in grams], np.int64)
    owner, flat = np.repeat(np.arange(len(grams)), sizes), np.concatenate([*grams, np.zeros(0, np.uint64)]).astype(np.uint64)
    comp = np.unique(group, return_inverse=True)[1]
    # the group's order of grams: most frequent first; grams that only one set has overlap with nothing
    order = np.lexsort((flat, comp[owner]))
    c, f = comp[owner][order], flat[order]
    first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (f[1:] != f[:-1])]) if len(f) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(f)])
    ranked = np.lexsort((f[first], -times, c[first]))
    starts, _ = _runs(c[first][ranked])
    place = np.empty(len(first), np.int64)
    place[ranked] = np.arange(len(first)) - np.repeat(starts, np.diff(np.r_[starts, len(first)]))
    place = np.repeat(np.where(times > 1, place, -1), times)
    who = owner[order][place >= 0]
    place = place[place >= 0]
    order = np.lexsort((who, place >> 6))
    who, place = who[order], place[order]
    level_of, bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
    head = np.flatnonzero(np.r_[True, (level_of[1:] != level_of[:-1]) | (who[1:] != who[:-1])]) if len(who) else np.zeros(0, np.int64)
    value = np.bitwise_or.reduceat(bit, head) if len(head) else np.zeros(0, np.uint64)
    who, level_of = who[head], level_of[head]
    levels = int(level_of[-1]) + 1 if len(level_of) else 0
    cut = np.searchsorted(level_of, np.arange(levels + 1))

    left = np.bincount(who, np.bitwise_count(value), minlength=len(n)).astype(np.int64)
    root, node = np.unique(comp * 3 + side, return_inverse=True)
    self_roots = np.flatnonzero(root % 3 == 0)
    cross = np.flatnonzero((root[:-1] % 3 == 1) & (root[1:] == root[:-1] + 1)) if len(root) > 1 else np.zeros(0, np.int64)
    u, v = np.r_[self_roots, cross], np.r_[self_roots, cross + 1]
    over = np.zeros(len(u), np.int64)
    docs, word = np.arange(len(n)), np.zeros(len(n), np.uint64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    factor = threshold / (1 + threshold)
    for level in range(levels):
        if not len(u):
            break
        alive = np.zeros(int(node.max()) + 1, bool)
        alive[u] = alive[v] = True
        docs = docs[alive[node[docs]]]
        here = slice(cut[level], cut[level + 1])
        word[:] = 0
        word[who[here]] = value[here]
        left[who[here]] -= np.bitwise_count(value[here])
        # the children: a node for each different word below each node
        docs = docs[np.lexsort((word[docs], node[docs]))]
        parent, w = node[docs], word[docs]
        first = np.flatnonzero(np.r_[True, (parent[1:] != parent[:-1]) | (w[1:] != w[:-1])])
        below = np.diff(np.r_[first, len(docs)])
        count = np.bincount(parent[first], minlength=len(alive))
        start = np.cumsum(count) - count
        node[docs] = np.repeat(np.arange(len(first)), below)
        w, least, most = w[first], np.minimum.reduceat(n[docs], first), np.maximum.reduceat(left[docs], first)
        # all pairs of children of each pair of nodes
        total = count[u] * count[v]
        at = np.repeat(np.arange(len(u)), total)
        k = ranges(np.zeros(len(u), np.int64), total)
        a, b = start[u][at] + k // count[v][at], start[v][at] + k % count[v][at]
        keep = (u != v)[at] | (a <= b)
        a, b, at = a[keep], b[keep], at[keep]
        o = over[at] + np.bitwise_count(w[a] & w[b])
        keep = o + np.minimum(most[a], most[b]) >= factor * (least[a] + least[b]) - _EPS
        a, b, o = a[keep], b[keep], o[keep]
        over_now = (most[a] == 0) | (most[b] == 0)  # nothing more in common: the overlap is final for all sets below
        x, y, z = a[over_now], b[over_now], o[over_now]
        if len(x):
            total = below[x] * below[y]
            at = np.repeat(np.arange(len(x)), total)
            k = ranges(np.zeros(len(x), np.int64), total)
            p, q = first[x][at] + k // below[y][at], first[y][at] + k % below[y][at]
            keep = (x != y)[at] | (p < q)
            p, q, z = docs[p[keep]], docs[q[keep]], z[at[keep]]
            good = z >= threshold * (n[p] + n[q] - z) - _EPS
            found.append((p[good], q[good], z[good]))
        u, v, over = a[~over_now], b[~over_now], o[~over_now]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _uncovered(side: np.ndarray, of: np.ndarray, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(rows, side)] of a block's joins, so that pairs of two rows that have one of the ``PIVOTS`` most common other
    pivots (of, keys: row, pivot) are left out, where that saves much."""
    which, at = np.unique(keys, return_inverse=True)
    rest, out = np.ones(len(side), bool), []
    for k in np.argsort(-np.bincount(at, minlength=len(which)), kind="stable")[:PIVOTS].tolist():
        has = np.zeros(len(side), bool)
        has[of[at == k]] = True
        inside, others = rest & has, rest & ~has
        if inside.sum() < max(2, rest.sum() / 8):
            continue
        for x, y in [(others, inside)] if not side.any() else [(others & (side == 1), inside & (side == 2)), (inside & (side == 1), others & (side == 2))]:
            if x.any() and y.any():
                out.append((np.flatnonzero(x | y), np.where(x, 1, 2)[x | y]))
        rest = others
    if rest.sum() > 1:
        out.append((np.flatnonzero(rest), side[rest]))
    return out


def _elsewhere(p: np.ndarray, q: np.ndarray, rows: int, of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where rows p and q have one of the pivots (of, keys: row, pivot) in common."""
    which, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    some = times[at] > 1
    of, at, width = of[some].astype(np.int64), at[some], max(1, len(which))
    code = np.sort(of * width + at)
    at, size = code % width, np.bincount(of, minlength=rows)
    start = np.cumsum(size) - size
    out = np.zeros(len(p), bool)
    for s in range(0, len(p) if len(code) else 0, 1 << 17):
        a, b = p[s : s + (1 << 17)], q[s : s + (1 << 17)]
        pair = np.repeat(np.arange(len(a)), size[a])
        asked = b[pair] * width + at[ranges(start[a], size[a])]
        out[s + pair[code[np.minimum(np.searchsorted(code, asked), len(code) - 1)] == asked]] = True
    return out


def _spokes(nodes: DataFrame, links: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(root, doc, pivot, far, near): of each node of a block but the pivot, the pivot, the Jaccard distance to it, and
    whether they are alike enough. The pivot of a block of more than ``CHUNK`` nodes goes to each of its chunks."""
    count = links.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    mine = F.array(F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    at = links.join(count, "root").select("doc", "root", "own", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(mine)).alias("chunk"))
    at = at.withColumn("part", F.pmod(F.xxhash64("root", "chunk"), F.lit(parts)))

    def measure(rows: pa.Table) -> pa.Table:
        docs, n, root, chunk, own = (rows.column(c).to_numpy() for c in ("doc", "n", "root", "chunk", "own"))
        order = np.lexsort((~own, chunk, root))
        docs, n, root, chunk = docs[order], n[order], root[order], chunk[order]
        raw = rows.column("grams").to_pylist()
        grams = [np.frombuffer(raw[k], np.uint64) for k in order.tolist()]
        first = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (chunk[1:] != chunk[:-1])])
        times = np.diff(np.r_[first, len(docs)])
        common = np.zeros(len(docs), np.int64)
        for a, b in zip(first.tolist(), (first + times).tolist()):
            if b - a > 1:
                pivot, each = np.sort(grams[a]), np.concatenate(grams[a + 1 : b])
                hit = pivot[np.minimum(np.searchsorted(pivot, each), len(pivot) - 1)] == each
                size = np.array([len(g) for g in grams[a + 1 : b]])
                common[a + 1 : b] = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
        rest, head = np.ones(len(docs), bool), np.repeat(first, times)
        rest[first] = False
        every, common = (n + n[head] - common)[rest], common[rest]
        return pa.table({"root": root[rest], "doc": docs[rest], "pivot": docs[head][rest], "far": 1 - common / every, "near": common >= threshold * every - _EPS})

    placed = nodes.select("doc", "n", "grams").join(sized(stored(at, "places"), 48), "doc")
    return in_groups(placed.groupBy("part"), measure, "root bigint, doc bigint, pivot bigint, far double, near boolean")


def _undecided(spokes: DataFrame, known: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(root, doc, own): the nodes of each block that may be like one of another class (known: doc, root). Distances to
    the pivot of two that are alike differ by 1 - threshold at most; it is enough to look at the next nearer and the next
    farther node of another class. own: the block's next pivot, the node nearest to this one (so, in a group around one
    text, near to that text)."""

    def open_ones(rows: pa.Table) -> pa.Table:
        root, doc, far, label = (rows.column(c).to_numpy() for c in ("root", "doc", "far", "label"))
        order = np.lexsort((far, root))
        root, doc, far, label = root[order], doc[order], far[order], label[order]
        first = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (label[1:] != label[:-1])])
        times = np.diff(np.r_[first, len(doc)])
        some = np.zeros(len(doc), bool)
        for other, there in ((first - 1, first > 0), (first + times, first + times < len(doc))):
            other, there = np.repeat(np.where(there, other, 0), times), np.repeat(there, times)
            some |= there & (root[other] == root) & (np.abs(far - far[other]) <= 1 - threshold + 1e-6)
        root, doc = root[some], doc[some]
        return pa.table({"root": root, "doc": doc, "own": np.r_[True, root[1:] != root[:-1]][: len(root)]})

    known = known.withColumnRenamed("root", "label")
    each = spokes.join(sized(known, 24), "doc", "left").select("root", "doc", "far", F.coalesce("label", "doc").alias("label"))
    return in_groups(each.groupBy(F.pmod(F.xxhash64("root"), F.lit(parts))), open_ones, "root bigint, doc bigint, own boolean")


def _joined(nodes: DataFrame, links: DataFrame, threshold: float, parts: int, pairs: bool, known: DataFrame | None = None) -> DataFrame:
    """pairs: (a, b, jaccard) of different sets, a < b. Else (doc, links, root) of what each task finds: the documents
    with sets like its own, and a document that these are joined to. known: (doc, root), classes inside of which pairs
    are left out."""
    count = links.groupBy("root").agg(F.count("*").alias("members"))
    at = links.join(count, "root").select(
        "doc", "root", F.when(F.col("members") > _SMALL, F.ceil(F.col("members") / CHUNK)).otherwise(F.lit(0)).cast("int").alias("chunks")
    )
    at = at.withColumn("mine", F.when(F.col("chunks") > 0, F.pmod(F.xxhash64("doc"), F.greatest("chunks", F.lit(1)))).otherwise(0).cast("int"))
    at = at.select("doc", "root", "chunks", "mine", F.explode(F.sequence(F.lit(0), F.greatest(F.col("chunks") - 1, F.lit(0)))).alias("other"))
    at = at.select(
        "doc", "root", "mine", (F.col("chunks") > 0).alias("large"),
        F.when(F.col("chunks") > 0, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(parts))).alias("block"),
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
    )

    labelled = known is not None

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        docs, n, times, mine, root = (rows.column(c).to_numpy() for c in ("doc", "n", "times", "mine", "root"))
        grams = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
        roots = rows.column("roots").combine_chunks()
        of, keys = np.repeat(np.arange(len(docs)), np.asarray(roots.value_lengths())), np.asarray(roots.flatten())
        of, keys = of[keys < root[of]], keys[keys < root[of]]
        if labelled:  # a class is left out like one more pivot of its rows
            of, keys = np.r_[of, np.arange(len(docs))], np.r_[np.unique(keys, return_inverse=True)[1], len(keys) + np.unique(rows.column("label").to_numpy(), return_inverse=True)[1]]
        side = np.zeros(len(docs), np.int64) if i == j else np.where(mine == i, 1, 2)
        joins = _uncovered(side, of, keys) if key[0].as_py() else [(np.arange(len(docs)), side)]
        p = q = common = np.zeros(0, np.int64)
        if joins:
            own, sides = (np.concatenate([x[c] for x in joins]) for c in (0, 1))
            group = np.repeat(np.arange(len(joins)), [len(x[0]) for x in joins]) if key[0].as_py() else root
            p, q, common = trie_join(group, sides, n[own], [grams[k] for k in own.tolist()], threshold)
            p, q = own[p], own[q]
            here = ~_elsewhere(p, q, len(docs), of, keys)
            p, q, common = p[here], q[here], common[here]
        if pairs:
            return pa.table({"a": np.minimum(docs[p], docs[q]), "b": np.maximum(docs[p], docs[q]), "jaccard": common / np.maximum(1, n[p] + n[q] - common)})
        doc, home = _local_components(docs[p], docs[q])
        found = sum(np.bincount(np.searchsorted(doc, docs[x]), times[y], minlength=len(doc)) for x, y in ((p, q), (q, p)))
        return pa.table({"doc": doc, "links": found.astype(np.int64), "root": home})

    own = links.groupBy("doc").agg(F.collect_list("root").alias("roots"))
    placed = nodes.select("doc", "n", "times", "grams").join(own, "doc")
    if known is not None:
        placed = placed.join(sized(known.withColumnRenamed("root", "label"), 24), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    placed = placed.join(sized(stored(at, "places"), 48), "doc")
    return in_groups(placed.groupBy("large", "block", "i", "j"), join, "a bigint, b bigint, jaccard double" if pairs else "doc bigint, links bigint, root bigint")


def _nodes(docs: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(the nodes, with how many documents each stands for; copies; the nodes' pivots; buckets)."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("the threshold lies above 0 and up to 1, n is 1 at least")
    bits, seed = _bits(docs), secrets.randbits(64)
    with scratch() as keep:
        some = stored(_candidates(docs, n, threshold, bits, seed), "candidates")
        each = keep(stored(_sets(docs.join(sized(some, 16), "doc_id", "left_semi"), n, threshold, bits, seed), "sets"))
    copies = stored(_copies(each), "equal")
    nodes = each.join(sized(copies.select("doc_id"), 16), "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "n", "grams", "lead")
    links = stored(_links(nodes, threshold, bits), "links")
    more = stored(copies.groupBy("doc").agg(F.count("*").alias("more")), "times")
    nodes = nodes.join(sized(more, 16), "doc", "left").withColumn("times", 1 + F.coalesce("more", F.lit(0)))
    return nodes, copies, links, 1 << bits


def _pairs(docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """doc_a, doc_b, jaccard, by numbers."""
    nodes, copies, links, parts = _nodes(docs, threshold, n)
    found = _joined(nodes, links, threshold, parts, True).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "jaccard")
    return found.union(copies.select("doc", "doc_id", F.lit(1.0)))


def _classes(docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """(doc_id, class_id, links), by numbers, stored, of the documents that have links."""
    with scratch() as keep:
        nodes, copies, links, parts = _nodes(docs, threshold, n)
        found = stored(_joined(nodes, links, threshold, parts, False), "found")
        total = found.groupBy("doc").agg(F.sum("links").alias("near"))
        more = copies.groupBy("doc").agg(F.count("*").alias("more"))
        near = components(found.select(F.col("doc").alias("a"), F.col("root").alias("b"))).join(total, "doc")
        each = stored(
            near.join(more, "doc", "full").select("doc", F.coalesce("root", "doc").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links")), "nodes"
        )
        same = copies.join(sized(each, 24), "doc").select("doc_id", "class_id", "links")
        return keep(stored(each.withColumnRenamed("doc", "doc_id").union(same), "classes"))


def _gone(docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """(doc_id), by numbers, stored: the documents that aren't the first of their class. As no links are counted, pairs
    inside of what is known to be one class aren't looked at."""
    with scratch() as keep:
        nodes, copies, links, parts = _nodes(docs, threshold, n)
        left, known, before = links, None, None
        while True:
            spokes = stored(_spokes(nodes, left, threshold, parts), "spokes")
            near = spokes.where("near").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
            known = stored(components(near if known is None else near.union(known.where("doc <> root"))), "known")
            left = stored(_undecided(spokes, known, threshold, parts), "undecided")
            squares = left.groupBy("root").agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0
            if squares <= FEW * links.count() or before is not None and squares > before / 2:
                break
            before = squares
        found = _joined(nodes, left, threshold, parts, False, known).select("doc", "root").union(known).where("doc <> root")
        classes = components(found.select(F.col("doc").alias("a"), F.col("root").alias("b")))
        return keep(stored(classes.where("doc <> root").select(F.col("doc").alias("doc_id")).union(copies.select("doc_id")), "gone"))


def jaccard_join(df: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_a, doc_b, jaccard."""
    reachable(df.sparkSession)
    docs, names = numbered(df, id_col, text_col, "text")
    return renamed(_pairs(docs, threshold, n), names, "doc_a", "doc_b")


def jaccard_classes(df: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, links: a row for each id."""
    reachable(df.sparkSession)
    docs, names = numbered(df, id_col, text_col, "text")
    found = renamed(_classes(docs, threshold, n), names, "doc_id", "class_id").withColumnRenamed("doc_id", "found_id")
    every = df.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    out = every.join(sized(found, 64), F.col("doc_id") == F.col("found_id"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def dedup(df: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the documents that are joined, directly or by way of others, to one with a smaller id.
    Rows with null ids stay; rows of the same id stay or go together."""
    reachable(df.sparkSession)
    docs, names = numbered(df, id_col, text_col, "text")
    gone = fresh(df, "gone")
    with scratch() as keep:
        found = _gone(docs, threshold, n).withColumnRenamed("doc_id", gone)
        copies = keep(stored(renamed(found, names, gone), "copies"))
    return df.join(sized(copies, 64), F.col(id_col) == F.col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


#: ``jaccard_join`` by brute force over an inverted index.
SQL = rf"""
with w as (select doc_id, regexp_extract_all(lower(text), '{WORD}') as w from documents where doc_id is not null and text is not null),
g as (select doc_id, list_sort(list_distinct(case when len(w) < {N} then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) end)) as g from w where len(w) > 0),
s as (select min(doc_id) as doc, g, len(g) as n from g group by g),
t as (select doc, n, unnest(g) as t from s),
p as (select x.doc as a, y.doc as b, x.n + y.n as nn, count(*) as c from t x join t y on x.t = y.t and x.doc < y.doc group by x.doc, y.doc, x.n, y.n)
select a as doc_a, b as doc_b, c / (nn - c) as jaccard from p where c >= {THRESHOLD} * (nn - c) - 1e-9
union all select distinct s.doc, g.doc_id, 1.0 from g join s using (g) where g.doc_id > s.doc
"""

#: ``jaccard_classes``, the query, by the same brute force.
SQL_CLASSES = rf"""
with recursive w as (select doc_id, regexp_extract_all(lower(text), '{WORD}') as w from documents where doc_id is not null and text is not null),
g as (select doc_id, list_sort(list_distinct(case when len(w) < {N} then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) end)) as g from w where len(w) > 0),
s as (select min(doc_id) as doc, g, len(g) as n, count(*) as m from g group by g),
t as (select doc, n, m, unnest(g) as t from s),
p as (select x.doc as a, y.doc as b, x.n + y.n as nn, y.m, count(*) as c from t x join t y on x.t = y.t and x.doc <> y.doc group by x.doc, y.doc, x.n, y.n, y.m),
e as (select a, b, m from p where c >= {THRESHOLD} * (nn - c) - 1e-9),
r as (select doc, doc as root from s union select e.b, r.root from r join e on e.a = r.doc),
c as (select doc, min(root) as root from r group by doc),
l as (select doc, m - 1 + coalesce((select sum(e.m) from e where e.a = s.doc), 0) as links, g from s)
select d.doc_id, coalesce(c.root, d.doc_id) as class_id, cast(coalesce(l.links, 0) as bigint) as links
from (select distinct doc_id from documents where doc_id is not null) d left join g using (doc_id) left join l using (g) left join c using (doc)
"""
