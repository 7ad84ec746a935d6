"""N-gram Jaccard join by a MinHash LSH forest.

A signature holds TREES tries' labels of DEPTH hashes each. Texts that are the
same words become one node first, so copies are never joined to each other.

Each trie is cut into sub-tries at the floor: the longest prefix at which two
texts of the threshold's similarity share a prefix in some trie with the target
recall. A sub-trie is sorted by what its labels have beyond the floor and is
walked from the leaves: nodes of a common prefix are compared by sketches of
SKETCH bits, then the prefix is shortened by a hash, and so on down to the
floor. Nodes linked at a longer prefix count as one at the shorter ones, so
only pairs of different sets are compared there. Sketches leave out what can't
reach the threshold, so sets of linked nodes don't grow by texts that merely
share a prefix. Sub-tries of more than ``WIDE`` nodes link all their nodes to
one by a join and are sorted out by the verification alone.

Linked nodes form components. The pairs of a component (or of two blocks of a
large one) that share a prefix in some trie are candidates, and each is
verified by the exact Jaccard similarity of shingle sets. Pairs stay inside a
task: what leaves it is a row for each node, with its links counted and the
least node that it is linked to.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, connected_components, filter_bits, join_counted, map_arrow, member_filter, sliced, with_flag, without_ids
from tidemark.llm.shingles import SHINGLE, MinHash, WordHashes, many_shingles, mix, shingle_hashes, text_key, words_of

THRESHOLD = 0.8
TREES, DEPTH = 20, 8
TARGET = 0.999
#: Bits of a sketch, one for each of so many hashes of the signature.
SKETCH = 128
#: Nodes of a sub-trie that one task walks.
WIDE = 512
#: Nodes, and shingles, of one block of a large component.
BLOCK_NODES, BLOCK_SHINGLES = 160, 400_000
#: Rows that a task of the verification gets, about.
TASK_ROWS = 4096


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that two texts share a prefix of this depth in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_depth(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that reaches the target at the threshold itself."""
    while depth > 1 and recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def prefix_keys(sig: np.ndarray, depth: int, trees: int = TREES, levels: int = DEPTH) -> np.ndarray:
    """(rows, trees): a 64-bit key of each trie's prefix."""
    s = sig.reshape(len(sig), trees, levels)
    out = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), (len(sig), trees))
    for j in range(depth):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j].astype(np.uint64))
    return out


def most_unlike(threshold: float, bits: int = SKETCH, loss: float = 1e-6) -> int:
    """In how many bits the sketches of a pair at the threshold differ at most, but for the loss."""
    p = (1 - threshold) / 2  # hashes that aren't equal have equal bits half the time
    tail, d = 1.0, -1
    while tail > loss and d < bits:
        d += 1
        tail -= comb(bits, d) * p**d * (1 - p) ** (bits - d)
    return d


def sketches(sig: np.ndarray) -> np.ndarray:
    """(rows, 2): a bit of each of the first SKETCH hashes."""
    bits = (sig[:, :SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits.astype(bool), axis=1).view(np.uint64)


def beyond(sig: np.ndarray, floor: int) -> np.ndarray:
    """(rows, TREES): eight bits of each hash of a label beyond the floor, so that sorting puts longer common prefixes together."""
    s = sig.reshape(len(sig), TREES, DEPTH)
    out = np.zeros((len(sig), TREES), np.int64)
    for j in range(floor, DEPTH):
        out = out << 8 | (s[:, :, j].astype(np.int64) & 255)
    return out


def _signed(batches: Iterator[pa.RecordBatch], depth: int, n: int) -> Iterator[pa.RecordBatch]:
    hashes, minhash = WordHashes(), MinHash(TREES * DEPTH)
    for batch in sliced(batches):
        texts = batch.column(2).to_pylist()
        lists = [words_of(text) for text in texts]
        nodes = [text_key(words) for words in lists]
        sizes = np.array([max(len(x) - n + 1, min(len(x), 1)) for x in lists], np.int64)
        sig = np.zeros((len(texts), TREES * DEPTH), np.uint32)
        whole = [i for i, x in enumerate(lists) if len(x) >= n]
        short = [i for i, x in enumerate(lists) if 0 < len(x) < n]
        flat, counts = many_shingles([lists[i] for i in whole], hashes, n)
        for rows, got in ((whole, minhash.flat(flat, counts)), (short, minhash.of([shingle_hashes(lists[i], hashes, n) for i in short]))):
            if rows:
                sig[rows] = got
        some = np.nonzero(sizes)[0]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, TREES, 0))]).astype(np.int32))
        keys = pa.ListArray.from_arrays(offsets, pa.array(prefix_keys(sig[some], depth).view(np.int64).ravel()))
        deep = pa.ListArray.from_arrays(offsets, pa.array(beyond(sig[some], depth).ravel()))
        sketch = sketches(sig).view(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes), keys, deep, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "n_shingles", "keys", "deep", "s0", "s1"])


_SIGNED = "doc_id long, th long, node binary, n_shingles long, keys array<long>, deep array<long>, s0 long, s1 long"


def walked(deep: np.ndarray, sketch: np.ndarray, levels: int, unlike: int) -> np.ndarray:
    """The least row that each row of a sorted sub-trie is linked to, from the longest prefixes to the sub-trie's own."""
    label = np.arange(len(deep))
    for level in range(levels + 1):
        prefix = deep >> (8 * level)
        starts = np.nonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))[0]
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(deep)]):
            if hi - lo < 2 or (label[lo:hi] == label[lo]).all():
                continue
            part = label[lo:hi]
            other = part[:, None] != part[None, :]
            i, j = np.nonzero(np.triu(other, 1))
            near = np.bitwise_count(sketch[lo + i] ^ sketch[lo + j]).sum(1) <= unlike
            for x, y in zip(part[i[near]].tolist(), part[j[near]].tolist()):
                x, y = label[x], label[y]
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                label[max(x, y)] = min(x, y)
            while True:  # roots of all
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _walked(batches: Iterator[pa.RecordBatch], levels: int, unlike: int) -> Iterator[pa.RecordBatch]:
    """(a, b): links of sub-tries, which come one after the other and sorted."""

    def links(key: np.ndarray, deep: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        two = starts[sizes == 2]
        near = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(1) <= unlike
        a, b = [node[two[near] + 1]], [node[two[near]]]
        for lo, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            label = walked(deep[lo : lo + m], sketch[lo : lo + m], levels, unlike)
            linked = np.nonzero(label != np.arange(m))[0]
            a.append(node[lo + linked])
            b.append(node[lo + label[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        key, deep, node, s0, s1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        now = [key, deep, node, np.stack([s0, s1], 1).view(np.uint64)]
        now = [np.concatenate(x) for x in zip(held, now)] if held else now
        if not len(now[0]):
            continue
        last = int(np.nonzero(now[0] != now[0][-1])[0][-1]) + 1 if now[0][0] != now[0][-1] else 0
        if last:
            yield links(*[x[:last] for x in now])
        held = [x[last:] for x in now]
    if held and len(held[0]):
        yield links(*held)


class _Block:
    """What one task holds of a component: two sides at most."""

    def __init__(self):
        self.seen: dict[bytes, tuple[int, int]] = {}
        self.sets: list[np.ndarray] = []

    def add(self, node: bytes, side: int, copies: int, shingles: np.ndarray) -> None:
        if node not in self.seen:
            self.seen[node] = (side, copies)
            self.sets.append(np.unique(shingles))

    def shared(self) -> np.ndarray | None:
        """Counts of common shingles of all pairs, where that many pairs are worth a matrix product."""
        n = len(self.sets)
        if n < 24:
            return None
        every, at = np.unique(np.concatenate(self.sets), return_inverse=True)
        row = np.repeat(np.arange(n), [len(s) for s in self.sets])
        common = np.bincount(at, minlength=len(every)) > 1  # a shingle of one text is shared by none
        rank = np.cumsum(common) - 1
        keep = common[at]
        row, col = row[keep], rank[at[keep]]
        out, width = np.zeros((n, n), np.float32), 8192
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for start in range(0, int(common.sum()), width):
            lo, hi = np.searchsorted(col, [start, start + width])
            part = np.zeros((n, width), np.float32)
            part[row[lo:hi], col[lo:hi] - start] = 1
            out += part @ part.T
        return out

    def verified(self, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose similarity reaches the threshold; a matrix product serves where most pairs of the block are asked for."""
        sizes = np.array([len(s) for s in self.sets], np.float64)
        close = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
        i, j = i[close], j[close]
        shared = self.shared() if len(i) * 8 > len(sizes) ** 2 else None
        both = shared[i, j].astype(np.float64) if shared is not None else np.array([np.intersect1d(self.sets[x], self.sets[y], assume_unique=True).size for x, y in zip(i, j)], np.float64)
        ok = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
        return i[ok], j[ok]

    def candidates(self, keys: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) with i < j that share a key; across blocks only pairs of both sides."""
        n = len(self.sets)
        match = np.zeros((n, n), bool)
        for t in range(keys.shape[1]):
            match |= keys[:, t][:, None] == keys[:, t][None, :]
        if across:
            side = np.array([x[0] for x in self.seen.values()])
            match &= side[:, None] != side[None, :]
        return np.nonzero(np.triu(match, 1))

    def links(self, keys_of, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        return self.verified(*self.candidates(keys_of(self.sets), across), threshold)

    def rows(self, keys_of, across: bool, threshold: float) -> Iterator[tuple[bytes, bytes, int]]:
        """(node, least node linked to it, links) for the nodes that have links; ``keys_of`` gives the keys of shingle sets."""
        nodes = list(self.seen)
        if len(nodes) < 2:
            return
        copies = np.array([x[1] for x in self.seen.values()], np.int64)
        i, j = self.links(keys_of, across, threshold)
        count = np.zeros(len(nodes), np.int64)
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        rank = np.empty(len(nodes), np.int64)
        rank[sorted(range(len(nodes)), key=nodes.__getitem__)] = np.arange(len(nodes))
        least = rank.copy()
        while True:  # least rank of each component
            before = least.copy()
            np.minimum.at(least, i, before[j])
            np.minimum.at(least, j, before[i])
            if (least == before).all():
                break
        by_rank = dict(zip(rank.tolist(), nodes))
        for x in np.nonzero(count)[0].tolist():
            yield nodes[x], by_rank[int(least[x])], int(count[x])


class Shingled:
    """Shingle hashes of texts by words' hashes."""

    def __init__(self, n: int = SHINGLE):
        self.hashes, self.n = WordHashes(), n

    def shingles(self, text: str) -> np.ndarray:
        return shingle_hashes(words_of(text), self.hashes, self.n)


def _verified(batches: Iterator[pa.RecordBatch], threshold: float, keys_of, shingles_of) -> Iterator[pa.RecordBatch]:
    """(node, root, links) of blocks, which come one after the other."""
    shingled = shingles_of()
    out: list[tuple[bytes, bytes, int]] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], ["node", "root", "links"])

    at, block = None, _Block()
    for batch in sliced(batches):
        for comp, bi, bj, side, node, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (comp, bi, bj):
                if at:
                    out.extend(block.rows(keys_of, at[1] != at[2], threshold))
                at, block = (comp, bi, bj), _Block()
            if node not in block.seen:
                block.add(node, side, copies, shingled.shingles(text))
        if len(out) > 50_000:
            yield batch_of()
    if at:
        out.extend(block.rows(keys_of, at[1] != at[2], threshold))
    yield batch_of()


def linked(posts: DataFrame, total: int, levels: int, unlike: int) -> DataFrame:
    """(a, b): links between the ``short`` numbers of nodes in each sub-trie of ``posts``: key, deep, short, s0, s1."""
    hubs = posts.groupBy("key").agg(F.min("short").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").withColumnRenamed("key", "_k")
    met = join_counted(posts, hubs, [("key", "_k")], "m", total)
    narrow = met.filter(F.col("m") <= WIDE).select("key", "deep", "short", "s0", "s1").repartition("key").sortWithinPartitions("key", "deep", "short")
    stars = met.filter((F.col("m") > WIDE) & (F.col("short") != F.col("hub"))).select(F.col("short").alias("a"), F.col("hub").alias("b"))
    return map_arrow(narrow, lambda it: _walked(it, levels, unlike), "a long, b long").unionByName(stars).distinct()


def in_blocks(members: DataFrame, total: int) -> DataFrame:
    """Add ``n_blocks`` and ``side``: into how many blocks of bounded size a member's component falls, and in which one it is."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = members.groupBy("component").agg(blocks.alias("n_blocks"), F.count(F.lit(1)).alias("m")).withColumnRenamed("component", "_c")
    return join_counted(members, sizes, [("component", "_c")], "m", total).drop("_c", "m").withColumn("side", F.pmod(F.xxhash64("node"), F.col("n_blocks")))


def verified(rows: DataFrame, n_rows: int, threshold: float, keys_of, shingles_of=Shingled) -> DataFrame:
    """(node, root, links) for rows with component, n_blocks, side, node, copies and text, each of which goes to all pairs of its block with another.

    The pairs of a component go to partitions in turn, so no partition gets
    several pairs of a large one while others have none.
    """
    last = F.col("n_blocks") - 1
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda j: F.struct(F.least("side", j).alias("i"), F.greatest("side", j).alias("j")))
    i, j = F.col("_p.i"), F.col("_p.j")
    turn = i * F.col("n_blocks") - F.floor(i * (i - 1) / 2) + j - i
    parts = min(max(n_rows // TASK_ROWS, 8), 20_000)
    dealt = rows.withColumn("_p", F.explode(pairs)).select("component", i.alias("bi"), j.alias("bj"), "side", "node", "copies", "text", F.pmod(F.xxhash64("component") + turn, F.lit(parts)).cast("int").alias("slot"))
    dealt = dealt.repartitionById(parts, "slot").drop("slot").sortWithinPartitions("component", "bi", "bj")
    return map_arrow(dealt, lambda it: _verified(it, threshold, keys_of, shingles_of), "node binary, root binary, links long")


def forest_keys(floor: int):
    """A function from shingle sets to their prefix keys."""
    held: list[MinHash] = []

    def keys(sets: list[np.ndarray]) -> np.ndarray:
        if not held:
            held.append(MinHash(TREES * DEPTH))
        return prefix_keys(held[0].of(sets), floor)

    return keys


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET, n: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of ``docs``.

    ``n_links`` counts the other documents whose n-gram sets have a Jaccard
    similarity of at least ``threshold``, copies included. ``class_id`` is the
    least doc_id of those linked directly or through others, or the document's
    own. Texts without words are linked to none, not even to each other. Null
    ids are allowed (the class is then the least id that isn't null); rows that
    repeat an id, with the same text or another, are documents of their own.
    Texts of fewer than ``n`` words are one shingle; very long ones are read
    whole. There are no ties: every link counts. Other columns play no part,
    whatever their names. An empty table gives an empty result.
    """
    floor = shortest_depth(threshold, target)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    signed = checkpoint(map_arrow(source, lambda it: _signed(it, floor, n), _SIGNED))
    first = [F.first(c).alias(c) for c in ("n_shingles", "keys", "deep", "s0", "s1")]
    nodes = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "th")).alias("row"), F.count(F.lit(1)).alias("copies"), *first)
    nodes = checkpoint(nodes.withColumn("short", F.xxhash64("node")))
    n_rows, n_nodes = signed.count(), nodes.count()

    # sub-tries: a key holds its trie's number, so it stands alone
    posts = nodes.select("short", "s0", "s1", F.explode(F.arrays_zip("keys", "deep")).alias("k")).select(F.col("k.keys").alias("key"), F.col("k.deep").alias("deep"), "short", "s0", "s1")
    edges = linked(posts, n_nodes * TREES, DEPTH - floor, most_unlike(threshold))
    comps = connected_components(edges).withColumnRenamed("node", "_n")

    # components in blocks of bounded size, the texts of their nodes brought to them
    members = checkpoint(comps.join(nodes.select("node", "short", "row", "copies", "n_shingles"), F.col("_n") == F.col("short")).drop("_n", "short"))
    members = checkpoint(in_blocks(members, n_nodes))
    bits = filter_bits(n_nodes)
    wanted = with_flag(source, F.xxhash64("doc_id", "th"), bits, member_filter(members, F.xxhash64("row.doc_id", "row.th"), bits), "_wanted").filter("_wanted").drop("_wanted")
    wanted = wanted.groupBy("doc_id", "th").agg(F.first("text").alias("text"))  # a row of each that repeat an id and a text
    texts = wanted.join(members, F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("th") == F.col("row.th")))
    n_dealt = members.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    near = checkpoint(verified(texts, n_dealt, threshold, forest_keys(floor), lambda: Shingled(n)))
    classes = connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = near.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "_l")
    ids = nodes.select(F.col("node").alias("_n"), "min_id", "copies")
    known = ids.join(classes, F.col("_n") == F.col("node"), "left").join(links, F.col("_n") == F.col("_l"), "left").select("_n", "min_id", "copies", F.coalesce("component", "_n").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    least = known.groupBy("root").agg(F.min("min_id").alias("class_id"), F.count(F.lit(1)).alias("m")).withColumnRenamed("root", "_r")
    known = join_counted(known, least, [("root", "_r")], "m", n_nodes).select("_n", "copies", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    known = checkpoint(known)
    worded = signed.filter("n_shingles > 0").select("doc_id", "node")
    out = join_counted(worded, known, [("node", "_n")], "copies", n_rows).select("doc_id", "class_id", "n_links")
    alone = signed.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least id.

    Rows whose id is null stay. Rows that share an id and belong to different
    classes stay or go together: they stay where the id is the least of either.
    """
    classes = ngram_join(docs, id_col, text_col, threshold)
    gone = classes.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("class_id")).alias("gone")).filter("gone").select(F.col("doc_id").alias(id_col))
    return without_ids(docs, checkpoint(gone), id_col)
