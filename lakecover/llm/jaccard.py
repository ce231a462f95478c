"""Operator 6: documents whose sets of word n-grams overlap, by a prefix-tree join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import BLOB, blob_table, bounded_batches, connected_components, pack_shards, part_count, squeezed, text_bytes, unsqueezed, written
from .text import SPACE_SEPARATORS, Words, buffers, chunks, mix, windows

BLOCK_GRAMS, BLOCK_SETS = 1 << 20, 256  # n-grams and sets of a bucket, about; a task of the tree join holds two buckets at once
HOT = 1_000  # a digest of more than this part of all rows is hot; there are no more such digests than this


def _sets(batch: pa.RecordBatch | pa.Table, n: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each row, sorted; fewer than n words are one gram."""
    data, offsets = buffers(batch["text"])
    for i, j in chunks(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACE_SEPARATORS, lower=True)
        hashes = words.hashes()
        grams = windows(hashes, n)
        for first, count in zip(words.first, words.counts, strict=False):
            if count >= n:
                yield np.unique(grams[first : first + count - n + 1])
            else:
                yield windows(hashes[first : first + count], int(count)) if count else np.zeros(0, np.uint64)


def _key_bits(size: int) -> int:
    """Bits of a gram that parts compare: eight more than it takes to count the bytes, so that few differ but seem equal."""
    return min(64, max(32, int(np.log2(max(2, size))) + 8))


def _packed(keys: np.ndarray, bits: int) -> bytes:
    """Ascending keys as differences, byte plane by byte plane: the empty high planes vanish in Spark's compression."""
    steps = np.diff(keys >> np.uint64(64 - bits), prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _frequency_levels(table: pa.Table) -> pa.Table:
    """For each part's keys of this shard in how many parts they occur, on a scale of a quarter doubling (0: in this alone)."""
    parts = table["part"].to_pylist()
    keys = [_unpacked(b) for b in table["blob"].to_pylist()]
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    level = np.minimum(np.round(4 * np.log2(count)), 255).astype(np.uint8)[inverse]
    ends = np.cumsum([len(k) for k in keys])
    return blob_table([(p, table["shard"][0].as_py(), level[e - len(k) : e].tobytes()) for p, k, e in zip(parts, keys, ends, strict=True)], ("part", "shard"))


def _prefix(size: int, percent: int) -> int:
    """So many first keys of two sets suffice: if none is common to both, the sets don't reach the similarity."""
    return size + (-percent * size) // 100 + 1 if size else 0


class PrefixTree:
    """A path-compressed trie of globally ordered sets; a probe walks it level by level with partial overlaps."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        seqs = [sequences[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.seqs, count = seqs, len(seqs)
        lcp = np.zeros(count + 1, np.int64)
        for i in range(1, count):
            a, b = seqs[i - 1], seqs[i]
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            lcp[i] = int(differ.argmax()) if differ.any() else k
        nodes: list[tuple[int, int, int, int]] = []  # leaves from, to; depth from, to
        children: list[list[int]] = []

        stack = [(0, count, 0, -1)]
        roots: list[int] = []
        while stack:
            lo, hi, depth, parent = stack.pop()
            end = len(seqs[lo]) if hi - lo == 1 else int(lcp[lo + 1 : hi].min())
            end = max(end, depth)
            me = len(nodes)
            nodes.append((lo, hi, depth, end))
            children.append([])
            (children[parent] if parent >= 0 else roots).append(me)
            if hi - lo > 1 and not (lcp[lo + 1 : hi] == len(seqs[hi - 1])).all():
                cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == end)), hi]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if (a, b) != (lo, hi):
                        stack.append((int(a), int(b), end, me))
        self.lo, self.hi, self.begin, self.end = np.array(nodes, np.int64).T
        self.child_at = np.cumsum([0, *map(len, children)])
        self.child = np.array([c for x in children for c in x], np.int64)
        self.roots = np.array(roots, np.int64)
        pieces = [seqs[lo][a:b] for lo, _, a, b in nodes]
        self.pool = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        self.at = np.concatenate([[0], np.cumsum(self.end - self.begin)])
        lengths = np.array([len(s) for s in seqs])
        self.least = np.array([self.sizes[a:b].min() for a, b, _, _ in nodes])
        self.rest = np.array([lengths[a:b].max() for a, b, _, _ in nodes]) - self.end
        self.is_leaf = np.diff(self.child_at) == 0

    def probe(self, at: int, member: np.ndarray, percent: int) -> np.ndarray:
        """Later leaves (positions in the tree's order) that reach the similarity with leaf ``at``."""
        own, size = self.seqs[at], self.sizes[at]
        member[own] = True
        front, overlap, found = self.roots, np.zeros(len(self.roots), np.int64), []
        while len(front):
            live = self.hi[front] - 1 > at
            front, overlap = front[live], overlap[live]
            length = self.end[front] - self.begin[front]
            ends = np.cumsum(length)
            spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[front] - ends + length, length)
            inside = np.concatenate([[0], np.cumsum(member[self.pool[spots]])])
            overlap = overlap + inside[ends] - inside[ends - length]
            last = np.where(length > 0, self.pool[np.maximum(self.at[front] + length - 1, 0)] if len(self.pool) else 0, -1)
            mine = np.where(length > 0, len(own) - np.searchsorted(own, last, "right"), len(own))
            bound = overlap + np.minimum(mine, self.rest[front])
            live = (100 + percent) * bound >= percent * (size + self.least[front])
            front, overlap = front[live], overlap[live]
            leaf = self.is_leaf[front]
            single = leaf & (self.hi[front] - self.lo[front] == 1)
            found.append(self.lo[front[single]])  # the bound of a single leaf is exact
            for node, o in zip(front[leaf & ~single], overlap[leaf & ~single], strict=True):
                leaves = np.arange(max(self.lo[node], at + 1), self.hi[node])
                found.append(leaves[(100 + percent) * o >= percent * (size + self.sizes[leaves])])
            inner, o = front[~leaf], overlap[~leaf]
            width = self.child_at[inner + 1] - self.child_at[inner]
            ends = np.cumsum(width)
            front = self.child[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.child_at[inner] - ends + width, width)]
            overlap = np.repeat(o, width)
        member[own] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def similar_pairs(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j that reach the similarity with i), each pair of distinct sets once."""
    sizes = np.array([len(s) for s in sets])
    alive = np.arange(len(sets))
    while True:  # a set of which too little occurs in any other is out; this may put out others
        keys, inverse, df = np.unique(np.concatenate([sets[i] for i in alive]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(alive)), sizes[alive])
        shared = np.bincount(owner, df[inverse] > 1, len(alive))
        keep = 100 * shared >= percent * sizes[alive]
        if keep.all() or not keep.any():
            break
        alive = alive[keep]
    if not keep.any() or len(alive) < 2:
        return
    rank = np.empty(len(keys), np.int32)
    rank[np.lexsort((keys, -df))] = np.arange(len(keys))
    ends = np.cumsum(sizes[alive])
    sequences = []
    for n, e in zip(sizes[alive], ends, strict=True):
        own = inverse[e - n : e]
        sequences.append(np.sort(rank[own[df[own] > 1]]))
    tree = PrefixTree(sequences, sizes[alive])
    member = np.zeros(len(keys), bool)
    order = alive[tree.order]
    for at in range(len(order)):
        found = tree.probe(at, member, percent)
        if len(found):
            yield int(order[at]), order[found]


def _size_step(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.05)).astype(np.uint16)


def _stars(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) from the first of the nodes that share a key, and whose sizes allow the similarity, to the others."""
    keys, nodes, steps = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in (("keys", np.uint64), ("nodes", np.int64), ("steps", np.uint16)))
    by = np.argsort(keys)
    same = keys[by][1:] == keys[by][:-1]
    common = np.zeros(len(keys), bool)
    common[1:] |= same
    common[:-1] |= same
    by = by[common]
    keys, nodes, steps = keys[by], nodes[by], steps[by].astype(np.int16)
    by = np.lexsort((nodes, steps, keys))
    keys, nodes, steps = keys[by], nodes[by], steps[by]
    # Sizes that differ by more than the similarity allows begin a new star.
    head = np.ones(len(keys), bool)
    head[1:] = (keys[1:] != keys[:-1]) | (np.diff(steps) > np.ceil(np.log(100 / percent) / np.log(1.05)) + 1)
    centre = nodes[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(keys) else nodes
    pairs = np.unique(np.stack([centre, nodes], 1)[centre != nodes], axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """Components of the documents linked by a Jaccard similarity of ``percent`` or more between their n-gram sets.

    1. Parts of the documents ask a sharded index in how many parts each of their distinct grams
       occurs. This frequency, then the hash, is the global order of grams: rare ones first. A
       document of whose grams fewer than ``percent`` occur in any other has no partner and is out.
    2. Documents with equal sets become one class with its smallest id.
    3. Classes that share a gram within the first ``n - ceil(percent n) + 1`` of both may be
       similar (no other pair can be). Shared grams give star-shaped candidate links, whose
       components are blocks.
    4. The sets of a block meet in a prefix tree. A probe walks it level by level with the
       partial overlaps of all open branches and leaves a subtree when the overlap so far and what
       remains on either side can't reach the similarity with the subtree's smallest set. A block
       over the bound is dealt into buckets, each pair of buckets a task, so no task holds it.
    5. Verified links give the final components.
    6. Only classes of several documents or with links are joined back to the rows. Rows without
       grams are kept out of that join, and the at most ``HOT`` digests that hold more than that
       part of all rows are broadcast, so that no copied text is one task's.

    ``docs(doc_id, text)``; other columns are ignored, whatever their names. Returns (doc_id,
    n_shingles, n_links, component_id), one row per input row; n_links counts the other rows
    linked, copies included, and is left out with ``links`` false. A long text is one set, held
    whole by its tasks.
    Null and wordless texts have an empty set, no link and their own id as component; a null id
    is in no component (null). Rows with equal ids are one document with several texts, each
    counted. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text_bytes(docs)
    count, bits = part_count(docs, size), _key_bits(size)
    parts = squeezed(docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")).select("part", "doc_id", "text")).repartition(count, "part")

    def distinct(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sets = list(_sets(unsqueezed(table), n))
        grams, df = np.unique(np.concatenate(sets), return_counts=True)
        # Grams that agree in the compared bits are one key.
        return sets, grams, df

    def ask(table: pa.Table) -> pa.Table:
        _, grams, _ = distinct(table)
        return blob_table([(s, table["part"][0].as_py(), _packed(grams[i:j], bits)) for s, i, j in pack_shards(grams, count)])

    def sign(table: pa.Table, answers: pa.Table) -> pa.Table:
        size, digest, prefix = [], [], []
        if table.num_rows:
            sets, grams, df = distinct(table)
            level = np.zeros(len(grams), np.uint8)
            told = dict(zip(answers["shard"].to_pylist(), answers["blob"].to_pylist(), strict=True))
            for s, i, j in pack_shards(grams, count):
                level[i:j] = np.frombuffer(told[s], np.uint8)
            for own in sets:
                at = np.searchsorted(grams, own)
                size.append(len(own))
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                shared = np.count_nonzero((level[at] > 0) | (df[at] > 1))
                if len(own) and 100 * shared >= percent * len(own):
                    order = np.lexsort((own, level[at]))
                    prefix.append(own[order][: _prefix(len(own), percent)].tobytes())
                else:
                    prefix.append(None)
        return pa.table({"doc_id": table["doc_id"], "n": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.binary()), "prefix": pa.array(prefix, pa.binary())})

    levels = parts.groupBy("part").applyInArrow(ask, BLOB).groupBy("shard").applyInArrow(_frequency_levels, "part int, shard int, blob binary")
    signed = written(parts.groupBy("part").cogroup(levels.groupBy("part")).applyInArrow(sign, "doc_id long, n long, digest binary, prefix binary"))
    known = signed.where("n > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    chosen = known.where("prefix is not null").join(classes.select("digest", F.col("node").alias("doc_id"), "copies"), ["digest", "doc_id"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["prefix"])
            keys = np.frombuffer(data.tobytes(), np.uint64)
            each = np.diff(offsets) // 8
            node = np.repeat(batch["doc_id"].to_numpy(), each)
            step = np.repeat(_size_step(batch["n"].to_numpy()), each)
            shard = ((mix(keys) >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            by = np.argsort(shard, kind="stable")
            at = np.flatnonzero(np.diff(shard[by], prepend=np.uint64(count)))
            rows = [(int(shard[by[a]]), by[a:b]) for a, b in zip(at, [*at[1:], len(by)], strict=True)]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _ in rows], pa.int32())} | {
                c: pa.array([x[own].tobytes() for _, own in rows], pa.binary()) for c, x in (("keys", keys), ("nodes", node), ("steps", step))
            })

    def stars(table: pa.Table) -> pa.Table:
        return _stars(table, percent)

    candidates = chosen.select("doc_id", "n", "prefix").mapInArrow(deal, "shard int, keys binary, nodes binary, steps binary").groupBy("shard").applyInArrow(stars, "a long, b long")
    blocks = connected_components(candidates)
    members = written(
        blocks.join(chosen.select(F.col("doc_id").alias("node"), "n", "copies").groupBy("node").agg(F.max("n").alias("n"), F.max("copies").alias("copies")), "node")
        .select("node", F.col("component").alias("block"), "n", "copies")
    )
    block_size = members.groupBy("block").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("ways"))
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(members.join(block_size, "block").agg(F.sum(F.col("n") * F.col("ways"))).first()[0] or 0) // BLOCK_GRAMS))
    g, h = F.col("_g"), F.col("_h")
    dealt = (
        members.join(block_size, "block").withColumn("_g", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int"))
        .withColumn("_h", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
        .select("node", "block", "copies", g.alias("bucket"), F.least(g, h).alias("one"), F.greatest(g, h).alias("two"))
    )
    texts = docs.join(members.select(F.col("node").alias("doc_id")), "doc_id")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [grams.tobytes() for grams in _sets(batch, n)]
            yield pa.RecordBatch.from_pydict({"node": batch["doc_id"], "grams": pa.array(keys, pa.binary())})

    placed = dealt.join(texts.select("doc_id", "text").mapInArrow(sets_of, "node long, grams binary"), "node").withColumn("pack", F.pmod(F.xxhash64("block", "one", "two"), F.lit(packs)).cast("int"))

    def tree_join(table: pa.Table) -> pa.Table:
        node, block, copies, bucket, one, two = (table[c].to_numpy() for c in ("node", "block", "copies", "bucket", "one", "two"))
        column = table["grams"].combine_chunks()
        out_a, out_b, nodes, weights = [], [], [], []
        by = np.lexsort((two, one, block))
        key = np.stack([block, one, two], 1)[by]
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        for own in np.split(by, cuts):
            once = {(int(node[i]), column[int(i)].as_py()): i for i in own}  # repeated rows
            own = np.array(list(once.values()))
            sets = [np.frombuffer(blob, np.uint64) for _, blob in once]
            apart = one[own[0]] != two[own[0]]
            weight, root = np.zeros(len(own), np.int64), np.arange(len(own))

            def find(x: int, root: np.ndarray = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return int(x)

            for i, found in similar_pairs(sets, percent):
                found = found[(bucket[own[found]] != bucket[own[i]]) | (not apart)]
                found = found[node[own[found]] != node[own[i]]]
                if links:
                    weight[i] += copies[own[found]].sum()
                    weight[found] += copies[own[i]]
                for j in found:
                    x, y = find(i), find(int(j))
                    if x != y:
                        root[x] = y
                        out_a.append(node[own[i]])
                        out_b.append(node[own[j]])
            linked = np.flatnonzero(weight)
            nodes += list(node[own[linked]])
            weights += list(weight[linked])
        return pa.table({
            "a": pa.array(out_a + nodes, pa.int64()), "b": pa.array(out_b + [None] * len(nodes), pa.int64()),
            "links": pa.array([0] * len(out_a) + weights, pa.int64()),
        })

    linked = written(placed.groupBy("pack").applyInArrow(tree_join, "a long, b long, links long"))
    component = connected_components(linked.where("b is not null").select("a", "b"))
    degree = linked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    told = written(
        classes.join(component, "node", "left").join(degree, "node", "left")
        .select("digest", "node", "copies", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
        .where("links > 0 or copies > 1 or component < node")
    )
    hot = F.col("copies") * HOT > signed.count()
    often = told.where(hot).select("digest", F.col("component").alias("hot_component"), F.col("links").alias("hot_links"))
    rows = signed.join(F.broadcast(often), "digest", "left")
    # Rows that have nothing to look for are dealt out by their own hash.
    key = F.when(F.col("digest").isNotNull() & F.col("hot_component").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id", "n", "digest"))))
    found = rows.withColumn("key", key).join(told.where(~hot).select(F.col("digest").alias("key"), "component", "links"), "key", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("hot_component", "component", "doc_id")).alias("component_id")
    n_links = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("hot_links", "links", F.lit(0))).alias("n_links")
    return found.select("doc_id", F.col("n").alias("n_shingles"), *([n_links] if links else []), component_id)
