"""Line dedup: equal lines by digest, near lines by a segment-partition edit join, classes of both by their first line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import components, materialised, passing, spread_join

THRESHOLD, LEAST_CHARS = 1, 20
#: Segment groups with more distinct lines than this don't make pairs but are split by segments of what is left of the lines.
GROUP = 32


def _digest(line: Column) -> tuple[Column, Column]:
    """128 bits that tell lines apart, as two numbers: cheaper to group by than bytes."""
    return F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("g")


def lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """The lines, split at \\n, of `least` characters or more besides white space at the ends: doc_id, pos, line, h, g."""
    split = docs.select(F.col("doc_id"), F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    return split.where(F.length(F.trim("line")) >= least).select("doc_id", "pos", "line", *_digest(F.col("line")))


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Place (1 based) and length of segment i (0 based) of k + 1: the last ones are one longer if it doesn't come out even."""
    short = F.floor(length / (k + 1)).cast("int")
    longer = (length % (k + 1)).cast("int")
    before = F.greatest(F.lit(0), F.lit(i) - (F.lit(k + 1) - longer))
    size = short + F.when(F.lit(i) >= F.lit(k + 1) - longer, 1).otherwise(0)
    return (short * i + before + 1).cast("int"), size.cast("int")


def _cuts(length: Column, k: int, d: int):
    """(i, shift, place, size) of the substrings by which a string of that length meets strings shorter by d.

    Of the substrings that could be segment i of a string shorter by d only those count whose shift leaves both sides
    enough edits (Pass-Join's multi-match-aware windows).
    """
    for i in range(k + 1):
        start, size = _segment(length - d, i, k)
        for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
            yield i, shift, start + shift, size


def segment_keys(line: Column, k: int) -> Column:
    """An array of (key, own): hashes of (length, segment number, substring) under which a line is indexed (own) or probes.

    A line probes the indexes of its own length and up to k less.
    """
    n = F.length(line)
    keys = [F.struct(F.xxhash64(F.lit(i), n - d, F.substring(line, at, size)).alias("key"), F.lit(d == 0 and shift == 0).alias("own")) for d in range(k + 1) for i, shift, at, size in _cuts(n, k, d)]
    return F.array(*keys)


def _states(rows: DataFrame, k: int) -> DataFrame:
    """Members of groups one segment further: key, node, own, d, t, r from the same columns (key null for whole lines, of any d).

    t is what is left of the line, r the places of its characters in the line. Members of a group are of one length, but
    for those that probe it (d longer). Cutting the segment that they share off two lines leaves strings within as many
    edits, which share a segment again.
    """
    n = F.length("t")

    def cut(d: int) -> Column:
        found = []
        for i, shift, at, size in _cuts(n, k, d):
            key = F.xxhash64(F.lit(i), n - d, F.substring("t", at, size))
            rest = F.concat(F.substring(F.col("t"), F.lit(1), at - 1), F.substring(F.col("t"), at + size, n))
            places = F.concat(F.slice("r", F.lit(1), at - 1), F.slice("r", at + size, F.greatest(F.lit(0), n - (at + size) + 1)))
            key = F.when(F.col("key").isNull(), key).otherwise(F.xxhash64("key", key))
            own = F.col("own") & F.lit(d == 0 and shift == 0)
            found.append(F.struct(key.alias("key"), own.alias("own"), F.lit(d).alias("d"), rest.alias("t"), places.alias("r")))
        return F.array(*found)

    out = None
    for d in range(k + 1):
        part = rows.where((F.col("d") == d) | F.col("d").isNull()).select("node", F.explode(cut(d)).alias("s")).select("s.key", "node", "s.own", "s.d", "s.t", "s.r")
        out = part if out is None else out.unionByName(part)
    return out


def _let(value: Column, body) -> Column:
    """body(value), the value worked out once: an expression written in twice is evaluated twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix (of its first 2 ** 18 - 1 characters, if it is longer), by halving steps."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << i) for i in range(17, -1, -1)])
    same = lambda at, step: F.substring(a, at + 1, step) == F.substring(b, at + 1, step)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= most) & same(at, step), at + step).otherwise(at))


def differing(a: Column, b: Column) -> Column:
    """struct(x, y): a and b without their common prefix and then their common suffix, which any edit distance allows."""
    whole = F.struct(a.alias("x"), b.alias("y"))
    cut = _let(whole, lambda s: _let(_common(s["x"], s["y"]), lambda n: F.struct(F.reverse(F.substring(s["x"], n + 1, F.length(s["x"]))).alias("x"), F.reverse(F.substring(s["y"], n + 1, F.length(s["y"]))).alias("y"))))
    return _let(cut, lambda s: _let(_common(s["x"], s["y"]), lambda n: F.struct(F.reverse(F.substring(s["x"], n + 1, F.length(s["x"]))).alias("x"), F.reverse(F.substring(s["y"], n + 1, F.length(s["y"]))).alias("y"))))


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """Levenshtein distance, exact up to k, over k for all beyond; bit-parallel over a band of 2k + 1 diagonals.

    One step for each character of b. The band around the diagonal is a word of 2k + 1 bits, the top one k rows below
    the diagonal; vertical differences are kept as two words, and the distance is followed along the top bit's diagonal
    and, from the last row of a on, along that row. Lengths must not differ by more than k.
    """
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    long = lambda x: F.lit(x).cast("long")
    none = lambda x: x.bitwiseXOR(long(full))
    bits = F.array(*[long(1 << x) for x in range(width)])

    def advance(z: Column, s: Column, i: Column) -> Column:
        match = long(0)
        for t in range(width):
            match = match.bitwiseOR(F.when(F.get(z["p"], i + (k + 1 - width + t)) == F.get(z["q"], i), long(1 << t)).otherwise(long(0)))
        vp, vn = s["vp"], s["vn"]
        diagonal = lambda m: ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(long(full))

        def moved(d0: Column) -> Column:
            hp, hn, down = vn.bitwiseOR(none(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
            row = z["n"] - k - 1 - i  # at 0 or more the top bit is a row of a
            bit = F.element_at(bits, F.greatest(F.lit(1), F.least(F.lit(width), F.lit(width) + row)).cast("int"))
            along = F.when(row >= 0, F.when(d0.bitwiseAND(long(top)) == 0, 1).otherwise(0)).otherwise(
                F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0))
            return F.struct(hn.bitwiseOR(none(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["at"] + along).cast("int").alias("at"))

        return _let(match, lambda m: _let(diagonal(m), moved))

    def run(z: Column) -> Column:
        start = F.struct(long(full & ~((1 << (width - k - 1)) - 1)).alias("vp"), long(0).alias("vn"), F.least(F.lit(k), z["n"]).alias("at"))
        steps = F.sequence(F.lit(0), F.size(z["q"]) - 1)
        return F.aggregate(steps, start, lambda s, i: advance(z, s, i), lambda s: s["at"])

    split = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("q"), F.length(a).alias("n"))
    return F.when(F.length(b) == 0, F.length(a)).when(F.length(a) == 0, F.length(b)).otherwise(_let(split, run))


def within(a: Column, b: Column, k: int, probe: int = 16) -> Column:
    """Whether the edit distance is k at most: of what differs first the beginnings, which must lie within 2k, then all."""
    near = lambda s: edit_distance(F.substring(s["x"], 1, probe), F.substring(s["y"], 1, probe), 2 * k) <= 2 * k
    return _let(differing(a, b), lambda s: F.when((F.abs(F.length(s["x"]) - F.length(s["y"])) <= k) & near(s), edit_distance(s["x"], s["y"], k) <= k).otherwise(False))


def _classes(leaves: DataFrame, k: int) -> DataFrame:
    """Edges (a, b) that connect lines as all pairs within k edits would, from `leaves` (node, line, r): at most 2k places of a line.

    A line without some of these characters, k at most, is a kept string, and where in it they were is the line's class.
    Lines of one class lie within k edits of each other; those of two classes of a string do if, place by place, the
    greater number of characters comes to k or less. So a class is a star, and classes are linked by their centres.
    """
    masks = F.filter(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.size("r")).cast("int") - 1), lambda m: F.bit_count(m) <= k)
    rows = leaves.select("node", "line", F.array_sort("r").alias("r"), F.explode(masks).alias("mask"))
    out = F.filter(F.transform("r", lambda p, i: F.when(F.floor(F.col("mask") / F.pow(F.lit(2.0), i)) % 2 == 1, p)), lambda p: p.isNotNull())
    rows = rows.select("node", "line", out.alias("out"))
    kept = F.array_join(F.filter(F.split("line", ""), lambda c, i: ~F.array_contains("out", i)), "")
    rows = rows.select("node", *_digest(kept), F.transform("out", lambda p, i: p - i).alias("at")).distinct()
    rows = materialised(rows, "line-leaves")
    centres = rows.groupBy("h", "g", "at").agg(F.min("node").alias("b"))
    stars = rows.join(centres, ["h", "g", "at"]).where("node <> b").select(F.col("node").alias("a"), "b")
    count = lambda of, place: F.size(F.filter(of, lambda x: x == place))
    most = F.aggregate(F.array_union("at", "o_at"), F.lit(0), lambda n, place: n + F.greatest(count("at", place), count("o_at", place)))
    # two different classes of k characters each never come to k, so one side has fewer
    few = centres.where(F.size("at") < k).select("h", "g", F.col("at").alias("o_at"), F.col("b").alias("a"))
    across = centres.join(few, ["h", "g"]).where("at <> o_at and a <> b").where(most <= k).select("a", "b")
    return stars.unionByName(across)


def near_links(rows: DataFrame, firsts: DataFrame, k: int, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of nodes that connect different lines as all pairs within k edits would, and the nodes (node, h, g).

    `rows` are the lines (doc_id, pos, line, h, g), `firsts` (h, g, doc_id, pos) a place of each. Lines within k edits share
    a segment of the shorter one; groups of lines with such a key are joined in themselves and their pairs verified.
    Groups of more than `group` lines are split by the segments of what the lines have besides the shared one, and so on
    until the groups are small or no more than k characters are left (see _classes). A round halves (k = 1) what is
    left, so long lines cost their length times its logarithm, and no group makes all its pairs.
    """
    probes = rows.select("doc_id", "pos", "h", "g", F.explode(segment_keys(F.col("line"), k)).alias("k")).select("doc_id", "pos", "h", "g", "k.key", "k.own")
    shared = probes.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("own"), F.count("*").alias("n")).where("low <> high and own").select("key", "n")
    shared = materialised(shared, "line-keys")
    total = shared.agg(F.sum("n")).first()[0] or 0
    met = spread_join(probes, shared, "key", "n", total, ["doc_id", "pos"]).groupBy("key", "h", "g").agg(F.max("own").alias("own"))
    met = materialised(met, "line-groups")
    places = firsts.join(met.select("h", "g").distinct(), ["h", "g"]).select("h", "g", F.col("doc_id").alias("f_doc"), F.col("pos").alias("f_pos"))
    texts = rows.select("doc_id", "pos", "line").join(places, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("pos") == F.col("f_pos")))
    h, g = _digest(F.col("line"))
    texts = texts.where((F.col("h") == h) & (F.col("g") == g)).select("h", "g", "line").dropDuplicates(["h", "g"])
    texts = materialised(texts.withColumn("node", F.monotonically_increasing_id()), "line-texts")
    members = materialised(met.join(texts.select("h", "g", "node"), ["h", "g"]).select("key", "node", "own"), "line-members")

    whole = texts.select(F.lit(None).cast("long").alias("key"), "node", F.lit(True).alias("own"), F.lit(None).cast("int").alias("d"), F.col("line").alias("t"), F.sequence(F.lit(0), F.length("line") - 1).alias("r"))
    state, pairs, leaves = None, None, None
    while True:
        sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("any and n > 1")
        small = members.join(sizes.where(F.col("n") <= group).select("key"), "key").distinct()
        other = small.select(F.col("key").alias("o_key"), F.col("node").alias("b"), F.col("own").alias("o_own"))
        found = small.join(other, F.col("key") == F.col("o_key")).where("node < b and (own or o_own)").select(F.col("node").alias("a"), "b").distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
        hot = materialised(sizes.where(F.col("n") > group).select("key", "n"), "line-hot")
        count = hot.agg(F.sum("n")).first()[0] or 0
        if not count:
            break
        if state is None:
            own = spread_join(members.select("key", "node"), hot, "key", "n", count, ["node"])
            state = _states(whole.join(own.select("node").distinct(), "node"), k).join(own, ["key", "node"])
        else:
            state = spread_join(state, hot, "key", "n", count, ["node"])
        state = materialised(state, "line-states")
        last = F.length("t") - F.col("d") <= k
        leaf = state.where(last).select("node", "r")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        state = materialised(_states(state.where(~last), k), "line-states")
        members = state.select("key", "node", "own")

    left = texts.select(F.col("node").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("line").alias("y"))
    close = pairs.distinct().join(left, "a").join(right, "b").where(F.abs(F.length("x") - F.length("y")) <= k)
    edges = close.where(within(F.col("x"), F.col("y"), k)).select("a", "b")
    if leaves is not None:
        edges = edges.unionByName(_classes(leaves.distinct().join(texts.select("node", "line"), "node"), k))
    return edges, texts.select("node", "h", "g")


def dropped_lines(docs: DataFrame, *, threshold: int = THRESHOLD, least: int = LEAST_CHARS) -> DataFrame:
    """The lines that go: doc_id, pos (0 based), near (whether the line that stays for it is a different one).

    Lines are compared as they are, between documents and within them. Equal lines are one class, and so are all that
    links of at most `threshold` edits (inserted, deleted or replaced characters) connect; of a class the first line by
    (doc_id, pos) stays. Lines of under `least` characters, besides spaces at their ends, stay and link nothing.

    A null text has no lines. Rows with one doc_id are one document: a line that stays at a place stays in all of
    them. A null doc_id comes before all others. Lines of any length are hashed and compared whole; lines are equal if
    128 bits of hash are.
    """
    rows = lines(docs, least)
    place = F.struct("doc_id", "pos")
    own = rows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    own = materialised(own, "line-ids")
    firsts = own.select("h", "g", "first.doc_id", "first.pos")
    edges, nodes = near_links(rows, firsts, threshold)
    roots = materialised(components(edges).join(nodes, "node").select("h", "g", "root"), "line-roots")
    linked = own.join(roots, ["h", "g"])
    least_of = linked.groupBy("root").agg(F.min("first").alias("keep")).withColumnRenamed("root", "r")
    linked = linked.join(least_of, F.col("root") == F.col("r")).select("h", "g", "first", "n", "keep")
    alone = own.where("n > 1").join(roots, ["h", "g"], "left_anti").select("h", "g", "first", "n", F.col("first").alias("keep"))
    classes = materialised(linked.unionByName(alone), "line-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    met = spread_join(rows.select("doc_id", "pos", "h", "g"), classes, ["h", "g"], "n", total, ["doc_id", "pos"])
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("pos") == F.col("keep.pos"))
    differs = ~(F.col("first.doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("first.pos") == F.col("keep.pos")))
    return met.where(~same).select("doc_id", "pos", differs.alias("near"))


def _by_document(docs: DataFrame, **options) -> DataFrame:
    gone = dropped_lines(docs, **options).distinct()
    gone = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list("pos")).alias("gone"), F.sum(F.col("near").cast("long")).alias("near"))
    return gone.select(F.col("doc_id").alias("g_id"), "gone", "near")


def line_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_lines, n_dropped, n_near (of those, for a different line), dropped (places, comma-joined)."""
    rows = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
    out = rows.join(_by_document(docs, **options), F.col("doc_id").eqNullSafe(F.col("g_id")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return out.select("doc_id", "n_lines", count(n).alias("n_dropped"), count(F.col("near")).alias("n_near"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs`, all rows and columns, the texts without the lines that go; n_chars, if there, follows the text.

    A text of which every line goes is empty. A null text stays null.
    """
    with passing(docs.sparkSession):
        gone = materialised(_by_document(docs, **options).select(F.col("g_id").alias("__id"), F.col("gone").alias("__gone")), "lines-gone", lasting=True)
    rows = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")  # its files are far smaller than its rows: no broadcast
    staying = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone")), lambda i: F.get(parts, i))
    text = F.array_join(_let(F.split("text", "\n"), staying), "\n")  # split once, however many lines there are
    rows = rows.withColumn("__text", F.when(F.col("__gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(text))
    columns = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return rows.select(*columns)
