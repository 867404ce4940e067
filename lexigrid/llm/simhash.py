"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a binary trie self-join, grouped into components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import components, materialised, passing, slices, spread_join, tidy
from .shingle_join import FOLD, similar_edges

SHINGLE, BUDGET, SEED = 4, 4, 42
#: Node pairs of the trie with at most LEAF leaves on each side are compared leaf by leaf.
LEAF, SOME = 64, 1 << 16
#: Groups of more fingerprints than this are split by a block of their remaining bits, if blocks have this many bits.
HOT, LEAST_BITS = 1 << 16, 4


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash: bit i is 1 if it is set in over half of the shingles' XXH64 hashes. No words: 0."""
    if not text:
        return 0
    words = [w for w in text.encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    plain, hash_of, last = b" ".join(words), xxhash.xxh64_intdigest, min(width, len(words)) - 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SOME):
        hashes = np.array([hash_of(plain[starts[i] : ends[i + last] - 1], SEED) for i in range(at, min(n, at + SOME))], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * counts > n).astype(object)).sum()) if (2 * counts > n).any() else 0


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found.view(np.int64)), part.column(2)], names=["doc_id", "fp", "digest"])

    return run


class Forest:
    """Which leaves of a trie are known to be in one component."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def trie_components(keys: np.ndarray, budget: int, top: int = 64) -> np.ndarray:
    """For sorted distinct uint64 `keys` that agree above bit `top`: for each, the index of the least key in its component.

    A node of the binary trie is a range of the sorted keys. Pairs of nodes of one depth are traversed together, a
    node with itself first: equal next bits keep the number of differing bits, unequal ones add one, and a pair over the
    budget is dropped. So is a pair whose leaves are all in one component already, so that a large ball of near copies
    costs its leaves rather than its pairs. Small pairs are compared leaf by leaf.
    """
    forest, uniform = Forest(len(keys)), {}

    def whole(low: int, high: int) -> int | None:
        """The component that holds all of the node's leaves, if one does."""
        if (low, high) in uniform:
            return forest.find(low)
        if high - low <= 4 * LEAF:
            first = forest.find(low)
            if all(forest.find(i) == first for i in range(low + 1, high)):
                uniform[low, high] = True
                return first
        return None

    def compare(a: int, b: int, c: int, d: int) -> None:
        near = np.bitwise_count(keys[a:b, None] ^ keys[None, c:d]) <= budget
        if not near.any():
            return
        left = np.array([forest.find(i) for i in range(a, b)])
        right = np.array([forest.find(i) for i in range(c, d)])
        big = len(keys)
        while True:
            new_left = np.minimum(left, np.where(near, right[None, :], big).min(axis=1))
            new_right = np.minimum(right, np.where(near, new_left[:, None], big).min(axis=0))
            if (new_left == left).all() and (new_right == right).all():
                break
            for at, old, new in ((a, left, new_left), (c, right, new_right)):
                for i in np.flatnonzero(old != new).tolist():
                    forest.join(int(old[i]), int(new[i]))
            left, right = new_left, new_right

    def split(low: int, high: int, depth: int) -> int:
        """Where the node's leaves with the next bit set begin."""
        bit = np.uint64(1 << (depth - 1))
        return low + int(np.searchsorted((keys[low:high] & bit) != 0, True))

    todo: list[tuple] = [(0, len(keys), 0, len(keys), top, 0)]
    while todo:
        a, b, c, d, depth, bits = todo.pop()
        own = a == c
        if (x := whole(a, b)) is not None and (own or x == whole(c, d)):
            continue
        if depth == 0 or (b - a <= LEAF and d - c <= LEAF):
            compare(a, b, c, d)
            continue
        m = split(a, b, depth)
        n = m if own else split(c, d, depth)
        crossed = [(a, m, n, d)] if own else [(a, m, n, d), (m, b, c, n)]
        straight = [(a, m, c, n), (m, b, n, d)]
        if bits < budget:
            todo += [(*p, depth - 1, bits + 1) for p in crossed if p[0] < p[1] and p[2] < p[3]]
        todo += [(*p, depth - 1, bits) for p in straight if p[0] < p[1] and p[2] < p[3]]
    return np.array([forest.find(i) for i in range(len(keys))], dtype=np.int64)


def _links(budget: int):
    """Edges (a, b) of fingerprints from rows (bucket, fp, turned), sorted by bucket: each leaf to the least one of its component in the bucket."""

    def group(kept: list) -> tuple[np.ndarray, np.ndarray]:
        prints, keys = (np.concatenate(c) for c in zip(*kept))
        order = np.argsort(keys)
        prints = prints[order]
        roots = trie_components(keys[order], budget)
        linked = np.flatnonzero(roots != np.arange(len(keys)))
        return prints[linked], prints[roots[linked]]

    def batch_of(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs)], names=["a", "b"])

    def run(batches):
        last, kept = None, []
        for batch in batches:
            buckets, prints, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.diff(buckets)) + 1
            out = []
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
                if low == high:
                    continue
                if buckets[low] != last:
                    if sum(len(k) for _, k in kept) > 1:
                        out.append(group(kept))
                    last, kept = int(buckets[low]), []
                kept.append((prints[low:high], keys[low:high]))
            if out:
                yield batch_of(out)
        if sum(len(k) for _, k in kept) > 1:
            yield batch_of([group(kept)])

    return run


def _turned(rows: DataFrame, tables: int, free: int) -> DataFrame:
    """Rows (bucket, fp, turned) once for each block of the `free` low bits of turned: these turned round so that the block
    leads them, and the bucket narrowed to its value. The last block may be longer than the bits that are used of it."""
    width, low = free // tables, (1 << free) - 1
    mask = F.lit(low if free < 64 else -1)
    made = []
    for i in range(tables):
        own = F.col("turned").bitwiseAND(mask)
        offset = i * width
        turn = own if not offset else F.shiftleft(own, offset).bitwiseOR(F.shiftrightunsigned(own, free - offset)).bitwiseAND(mask)
        turned = F.col("turned").bitwiseAND(F.lit(~low if free < 64 else 0)).bitwiseOR(turn)
        value = F.shiftrightunsigned(turn, free - width)
        made.append(F.struct(F.xxhash64("bucket", F.lit(i), value).alias("bucket"), turned.alias("turned")))
    return rows.select("fp", F.explode(F.array(*made)).alias("t")).select("t.bucket", "fp", "t.turned")


def links(prints: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `prints` (fp) exactly as all pairs within the budget would.

    Two fingerprints with at most `budget` differing bits agree on one of budget + 1 blocks of bits. For each block the
    fingerprints are turned so that it leads; those with one value of it are a group with a trie of its own. In a group of
    more than `hot` fingerprints the same holds of the bits that are left, so it is split by blocks of these, and so on.
    A group gives at most one edge a leaf, never its pairs.
    """
    tables, free, out = budget + 1, 64, None
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = prints.select("fp", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("turned"))
    while True:
        rows = _turned(state, tables, free)
        free -= free // tables
        large = None
        if free // tables >= LEAST_BITS:
            large = materialised(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("bucket", "n"), "simhash-large")
            total = large.agg(F.sum("n")).first()[0] or 0
            large = large if total else None
        small = rows if large is None else rows.join(large.select("bucket"), "bucket", "left_anti")
        found = small.select("bucket", "fp", "turned").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_links(budget), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if large is None:
            return out
        state = materialised(spread_join(rows, large, "bucket", "n", total, ["fp"]), "simhash-state")


def simhash(docs: DataFrame, *, width: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 hex digits), component_id, kept.

    A-Z are lower-cased, words are runs of anything but space and \\x09-\\x0D, shingles are `width` words, repeats
    included; fewer words are one shingle. Fingerprints link at `budget` or fewer differing bits; component_id is the
    smallest doc_id that links lead to, and kept marks the document with that id.

    Null texts, empty texts and texts without words have fingerprint zero and are linked like any other. Repeated rows
    each give their row, all kept or none. A null doc_id never is a component_id unless all of a component are null.
    Long texts are hashed in blocks of shingles. An empty table gives no rows. Other columns aren't read.
    """
    out = _grouped(docs, width, budget)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, width: int, budget: int, similar: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, fp, digest (of the text), root (the component), component_id.

    With `similar`, texts that share enough shingles (see shingle_join) are linked besides those whose fingerprints are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("digest"))
    prints = materialised(rows.mapInArrow(_fingerprints(width), "doc_id long, fp long, digest long"), "simhash")
    nodes = materialised(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), budget))
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    if similar:
        nodes = materialised(nodes, "simhash-roots")
        tidy(nodes.sparkSession)
        labels = materialised(prints.select("digest", "fp").distinct().join(nodes.select("fp", "root"), "fp").select(F.col("digest").alias("node"), "root"), "simhash-labels")
        more = components(similar_edges(rows.select(F.col("digest").alias("node"), "text"), labels))
        more = more.select(F.col("node").alias("old"), F.col("root").alias("new"))
        nodes = nodes.join(more, F.col("root") == F.col("old"), "left").select("fp", "least", "n", F.coalesce("new", "root").alias("root"))
    first = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(first, "root").select("fp", "n", "root", "component_id")
    return spread_join(prints, nodes, "fp", "n", prints.count(), ["doc_id"])


def one_of_each(docs: DataFrame, *, width: int = SHINGLE, budget: int = BUDGET, similar: bool = False) -> DataFrame:
    """The rows of `docs`, all columns as they are, that stay: of each component one row with its component_id.

    With `similar`, links are those of fingerprints and those of texts whose 5-word shingles have a Jaccard similarity of
    0.8 or more: that is some 10 of 64 bits, too many for a trie to prune by.

    Of several rows of a component with that doc_id the one whose text, then whose other columns have the least hash
    stays; rows of other components with the same doc_id stay as well. Rows with a null doc_id can't be named and stay.
    """
    with passing(docs.sparkSession):
        found = _grouped(docs, width, budget, similar).where("doc_id is not null and doc_id = component_id")
        kept = found.groupBy("root").agg(F.min("doc_id").alias("__id"), F.min("digest").alias("__digest")).select("__id", "__digest").distinct()
        kept = materialised(kept, "simhash-kept", lasting=True)
    named = docs.where("doc_id is not null").withColumn("__own", F.xxhash64("text"))
    named = named.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__digest")), "left_semi")
    others = [F.col(c) for c, t in docs.dtypes if c != "text" and not t.startswith("map")]
    first = F.row_number().over(W.partitionBy("doc_id", "__own").orderBy(F.xxhash64(*others)))
    named = named.withColumn("__nth", first).where("__nth = 1").drop("__nth", "__own")
    return named.unionByName(docs.where("doc_id is null"))
