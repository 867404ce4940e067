"""Similarity join of texts on their sets of word shingles (Jaccard), as far as it takes to connect similar ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import components, dropped, materialised, slices, tidy

#: Five words, and a similarity of PART / WHOLE or more.
WIDTH, PART, WHOLE, SEED = 5, 4, 5, 42
#: Shingles known to be in this many texts or more (at most MOST_HOT are) come last in the order of shingles.
HOT, MOST_HOT = 32, 1 << 20
#: Texts of a large group that are compared with all others of it in the first round; twice as many in each later one.
LEADERS = 8
#: Longs of a text's sketch, and edges of roots that are connected on the driver (more: by `components`).
SKETCH, FEW = 16, 1 << 16
#: Bytes of text hashed at once, and of a word that is hashed with them.
BLOCK, LONG = 1 << 18, 1 << 12
#: A-Z to a-z and the word separators to a space, on UTF-8 bytes.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose every bit depends on all bits of its argument."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


#: A word's hash is the sum of VALUE of each byte times PLACE of its place; separators count zero.
VALUE, PLACE, TURN = _table(256, SEED), _table(LONG, SEED + 1), _table(64, SEED + 2) | np.uint64(1)
VALUE[32] = 0


def _word_hashes(plain: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the words between spaces, block by block; those of over LONG bytes by XXH64."""
    at = 0
    while at < len(plain):
        end = len(plain) if at + BLOCK >= len(plain) else plain.rfind(b" ", at, at + BLOCK) + 1
        if not end:  # a word that is longer than a block
            end = plain.find(b" ", at)
            end = len(plain) if end < 0 else end
            yield np.array([at]), np.array([xxhash.xxh64_intdigest(plain[at:end], SEED)], dtype=np.uint64)
            at = end
            continue
        codes = np.frombuffer(plain, dtype=np.uint8, count=end - at, offset=at)
        inside = np.concatenate([[False], codes != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            place = np.arange(starts[0], len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
            found = np.add.reduceat(VALUE[codes[starts[0] :]] * PLACE[np.minimum(place, LONG - 1)], starts - starts[0])
            for i in np.flatnonzero(ends - starts > LONG).tolist():
                found[i] = xxhash.xxh64_intdigest(plain[at + starts[i] : at + ends[i]], SEED)
            yield starts + at, found
        at = end


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles (fewer words: of the whole sequence, none: no hash)."""
    folded = [(t or "").encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
    found = list(_word_hashes(b" ".join(folded)))
    if not found:
        return [np.empty(0, dtype=np.int64)] * len(texts)
    places, words = (np.concatenate(c) for c in zip(*found))
    words = _mixed(words)
    first = np.searchsorted(places, np.cumsum([0, *(len(t) + 1 for t in folded)])).tolist()

    def hashes(words: np.ndarray, size: int) -> np.ndarray:
        n = len(words) - size + 1
        sums = np.zeros(max(0, n), dtype=np.uint64)
        for i in range(size if n > 0 else 0):
            sums += words[i : i + n] * TURN[i]
        return _mixed(sums).view(np.int64)

    every, out = hashes(words, width), []
    for low, high in zip(first, first[1:]):
        few = high - low < width
        own = np.sort(hashes(words[low:high], high - low) if few and high > low else every[low : low if few else high - width + 1])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """`shingle_sets` of one text."""
    return shingle_sets([text], width)[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether shared / all shingles is PART / WHOLE or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both * (WHOLE + PART) >= PART * (len(a) + len(b))


def sketch(own: np.ndarray) -> np.ndarray:
    """Of a set of hashes, for each of their values modulo 64 * SKETCH whether an odd number has it: SKETCH longs.

    Two sets differ in as many hashes at least as their sketches differ in bits.
    """
    odd = np.bincount(own.view(np.uint64) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _frequent(batches) -> Iterator[pa.RecordBatch]:
    """(t, c): in how many texts of a few megabytes a shingle is, if in several."""
    for batch in batches:
        for part in slices(batch, "text"):
            seen = shingle_sets(list(set(part.column(1).to_pylist())))
            if not seen:
                continue
            t, c = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t[c > 1]), pa.array(c[c > 1].astype(np.int64))], names=["t", "c"])


def _prefixes(hot):
    """(t, node, n, hot): of the n shingles of a text those that come first, so many that similar texts share one of them;
    and (null, node, n, null, sketch) for each text."""
    names = ["t", "node", "n", "hot", "sketch"]

    def run(batches):
        known = hot.value  # sorted by shingle, with the place of each by frequency
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                out, new, drawn = [], {}, []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if node not in seen:  # copies give their rows once a task
                        seen.add(node)
                        new[node] = text
                for node, own in zip(new, shingle_sets(list(new.values()))):
                    if not len(own):
                        continue
                    take = len(own) - (len(own) * PART + WHOLE - 1) // WHOLE + 1
                    at = np.searchsorted(known[0], own)
                    at[at == len(known[0])] = 0
                    is_hot = known[0][at] == own if len(known[0]) else np.zeros(len(own), dtype=bool)
                    rank = np.where(is_hot, known[1][at] + 1, 0) if len(known[0]) else np.zeros(len(own), dtype=np.int64)
                    first = np.lexsort((own, rank))[:take]
                    out.append((own[first], np.full(take, node), np.full(take, len(own)), is_hot[first]))
                    drawn.append((node, len(own), sketch(own)))
                if out:
                    made = [pa.array(np.concatenate(c)) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(made[0]), pa.list_(pa.int64()))], names=names)
                    nodes, sizes, bits = zip(*drawn)
                    bits = pa.ListArray.from_arrays(pa.array(range(0, SKETCH * len(nodes) + 1, SKETCH), pa.int32()), pa.array(np.concatenate(bits)))
                    none = pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.bool_())
                    yield pa.RecordBatch.from_arrays([none[0], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), none[1], bits], names=names)

    return run


def _near_size(a: int, b: int) -> bool:
    return PART * max(a, b) <= WHOLE * min(a, b)


def _groups(batches) -> Iterator[pa.RecordBatch]:
    """Rows (t, node, n) sorted by t: (null, a, b, star, n of a, n of b) for the pairs of small groups, star 1 for those of
    a group's least node, 0 for the rest; (t, node, null, null, n, null) for the rows of large groups."""
    last, kept, large = None, {}, False
    out: list[tuple] = []

    def pairs() -> None:
        some = sorted(kept.items())
        out.extend((None, a, b, int(not i), x, y) for i, (a, x) in enumerate(some) for b, y in some[i + 1 :] if _near_size(x, y))

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["t", "a", "b", "star", "n", "m"])
        out.clear()
        return made

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
        alone = edge[1:] & edge[:-1]
        alone[[0, -1]] = False  # the batch before or after may go on with it
        batch = batch.filter(pa.array(~alone))
        for t, node, n in zip(*(c.to_pylist() for c in batch.columns)):
            if t != last:
                pairs()
                last, kept, large = t, {}, False
            if large:
                out.append((t, node, None, None, n, None))
            else:
                kept[node] = n
                if len(kept) > HOT:
                    out.extend((t, x, None, None, m, None) for x, m in kept.items())
                    kept, large = {}, True
            if len(out) > 1 << 16:
                yield flush()
    pairs()
    if out:
        yield flush()


def _verified(batches) -> Iterator[pa.RecordBatch]:
    """(a, b): the roots of pairs of texts that are similar."""
    for batch in batches:
        for part in slices(batch, "x"):
            keep = []
            a, b, ra, rb, x, y = (c.to_pylist() for c in part.columns)
            texts = dict(zip(a, x)) | dict(zip(b, y))
            sets = dict(zip(texts, shingle_sets(list(texts.values()))))
            for i in range(len(a)):
                if similar(sets[a[i]], sets[b[i]]):
                    keep.append((ra[i], rb[i]))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep)], names=["a", "b"])


def _possible(met: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b, star) that can be similar, from rows (a, b, star, n, m) for each small group that a pair met in.

    Two texts share the shingles among the first of both, and of the rest no more than the one that ends first has
    besides its first ones. Those in small groups are counted; of those in large ones each text's number bounds them.
    """
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("star").alias("star"), F.max("n").alias("n"), F.max("m").alias("m"))
    large = materialised(members.groupBy("node").agg(F.count("*").alias("k")), "shingle-large")
    for side in ("a", "b"):
        pairs = pairs.join(large.select(F.col("node").alias(side), F.col("k").alias(f"k_{side}")), side, "left")
    most = F.col("c") + F.least(F.coalesce("k_a", F.lit(0)), F.coalesce("k_b", F.lit(0))) + F.ceil(F.greatest("n", "m") * PART / WHOLE) - 1
    return pairs.where(most * (WHOLE + PART) >= (F.col("n") + F.col("m")) * PART).select("a", "b", "star")


def _near(n, m, a: str, b: str):
    """Whether texts of n and m shingles can be similar by their sketches, in the columns that begin with a and b."""
    bits = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(SKETCH)), F.lit(0))
    return bits * (WHOLE + PART) <= (n + m) * (WHOLE - PART)


def _sketched(sketches: DataFrame, node: str, n: str, bits: str) -> DataFrame:
    return sketches.select(F.col("node").alias(node), F.col("n").alias(n), *[F.col(f"s{i}").alias(f"{bits}{i}") for i in range(SKETCH)])


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) of roots from candidates (a, b, ra, rb), their whole texts compared."""
    needed = materialised(pairs.select(F.explode(F.array("a", "b")).alias("need")).distinct(), "shingle-need")
    held = texts.join(needed, F.col("node") == F.col("need")).dropDuplicates(["node"]).select("node", "text")  # one exchange for both joins
    rows = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    rows = rows.join(held.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    edges = rows.select("a", "b", "ra", "rb", "x", "y").mapInArrow(_verified, "a long, b long").distinct()
    edges = materialised(edges, "shingle-edges")
    dropped(needed)
    return edges


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """`labels` (node, root) with the roots that `edges` connect made one."""
    few = edges.limit(FEW + 1).toPandas()  # two longs a row
    if len(few) > FEW:
        joined = components(edges).select(F.col("node").alias("old"), F.col("root").alias("new"))
    else:
        joined = labels.sparkSession.createDataFrame(connected(few["a"].tolist(), few["b"].tolist()), "old long, new long")
    labels = labels.join(joined, F.col("root") == F.col("old"), "left")
    labels = materialised(labels.select("node", F.coalesce("new", "root").alias("root")), "shingle-labels")
    tidy(labels.sparkSession)
    return labels


def connected(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(node, least node of its component) of each node of the edges between a and b: `components` for few of them."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(up)]


def similar_edges(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) of roots that connect them as all pairs of similar texts would.

    `docs` are (node, text): a node is one text, which may be repeated; `labels` (node, root) say which nodes are connected
    already. Texts are similar if their sets of shingles of WIDTH words have a Jaccard similarity of PART / WHOLE or more.

    Such texts share one of the shingles that come first in any order of all shingles (prefix filter): the order puts
    frequent shingles last. Frequencies are counted within a few megabytes of text at a time and added up, so a shingle
    may be missed: that makes a group larger, never a result smaller. The list of the frequent is bounded by MOST_HOT.
    Groups of up to HOT texts give their pairs. Of a larger group no pairs are made: in rounds, some texts outside of its
    largest component (twice as many each round) are compared with all others of it and leave it, until one component is
    left. So a ball of near copies costs its texts, not its pairs; only texts like none of their group are compared with
    all of it. A pair whose sketches show that it isn't similar goes without a look at its texts. Null and empty texts have no shingles and no edges. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sums = docs.mapInArrow(_frequent, "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
    sums = materialised(sums.where(F.col("c") >= HOT), "shingle-frequent")
    least = max(HOT, -(-(sums.agg(F.sum("c")).first()[0] or 0) // MOST_HOT))
    listed = sums.where(F.col("c") >= least).orderBy("t").toPandas()  # at most MOST_HOT rows
    rank = np.argsort(np.argsort(listed["c"].to_numpy(), kind="stable"), kind="stable")
    hot = spark.sparkContext.broadcast((listed["t"].to_numpy().astype(np.int64), rank.astype(np.int64)))

    rows = materialised(docs.mapInArrow(_prefixes(hot), "t long, node long, n long, hot boolean, sketch array<long>"), "shingle-prefixes")
    sketches = rows.where("t is null").select("node", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
    sketches = materialised(sketches.dropDuplicates(["node"]), "shingle-sketches")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rare = rows.where("not hot").select("t", "node", "n").repartition(parts, "t").sortWithinPartitions("t")
    rare = materialised(rare.mapInArrow(_groups, "t long, a long, b long, star long, n long, m long"), "shingle-groups")
    members = rows.where("hot").select("t", "node", "n").unionByName(rare.where("b is null").select("t", F.col("a").alias("node"), "n"))
    members = materialised(members.distinct(), "shingle-members")

    def rooted(pairs: DataFrame) -> DataFrame:
        a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return materialised(pairs.distinct().join(a, "a").join(b, "b").where("ra <> rb"), "shingle-pairs")

    pairs = _possible(rare.where("b is not null"), members)
    pairs = pairs.join(_sketched(sketches, "a", "n", "x"), "a").join(_sketched(sketches, "b", "m", "y"), "b")
    pairs = materialised(pairs.where(_near(F.col("n"), F.col("m"), "x", "y")).select("a", "b", "star"), "shingle-candidates")
    dropped(rows, rare)
    known = None
    for star in (1, 0):  # most pairs of a ball of copies are connected by its stars already
        edges = _confirm(rooted(pairs.where(F.col("star") == star).select("a", "b")), docs)
        labels = _relabelled(labels, edges)
        known = edges if known is None else known.unionByName(edges)
    leaders = LEADERS
    while True:
        now = members.join(labels, "node")
        sizes = now.groupBy("t", "root").agg(F.count("*").alias("size"))
        main = sizes.groupBy("t").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots"))
        now = materialised(now.join(main.where("roots > 1").select("t", "main"), "t"), "shingle-open")
        if not now.take(1):
            break
        now = materialised(now.join(sketches.drop("n"), "node"), "shingle-sketched")
        order = W.partitionBy("t").orderBy(F.xxhash64("node"), "node")
        lead = now.where("root <> main").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= leaders)
        lead = materialised(lead.select("t", F.col("node").alias("l"), F.col("root").alias("l_root"), F.col("n").alias("l_n"), *[F.col(f"s{i}").alias(f"l{i}") for i in range(SKETCH)]), "shingle-leaders")
        size = (F.greatest("n", "l_n") * PART <= F.least("n", "l_n") * WHOLE) & (F.col("root") != F.col("l_root"))
        pairs = now.join(lead, "t").where(size & _near(F.col("n"), F.col("l_n"), "s", "l"))
        pairs = pairs.select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b"))
        edges = _confirm(rooted(pairs), docs)
        left = now.join(lead.select("t", F.col("l").alias("node")), ["t", "node"], "left_anti").select("t", "node", "n")
        members = materialised(left, "shingle-members")
        if edges.take(1):
            labels = _relabelled(labels, edges)
            known = known.unionByName(edges)
        leaders *= 2
    return known
