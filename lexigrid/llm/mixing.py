"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, WORD_SPACE, materialised, passing, prefix_sums, spread_join

WEIGHTS, SHARE, MOST, BLOCK = (5.0, 2.0, 1.0), 1.5, 2.0, 4096
#: Slots are points of the golden-ratio sequence in units of 1 / SPAN: slot i lies at i * STEP mod SPAN. STEP is odd and
#: next to SPAN / golden ratio, so any run of slots is spread evenly; after SPAN slots the points come round again.
SPAN, STEP = 1 << 31, 1327217885
#: Documents of a source are put in order within the buckets of so many hexadecimal digits of their hash.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For each source of `sizes` (source, source_size, n_docs): nth, target, and its interval [low, high) of [0, 1).

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes. A target stops at
    `most` times its source's size; the excess goes to the others by weight until none is above. In closed form:
    with the sources by size / weight, the first k stop, where k is the least with (budget - their caps) / (the other
    weights) at or below the next one's cap / weight. The table has one row a source; it is summed before it gets here.
    """
    by = W.orderBy(F.col("source").isNull(), F.col("source"))
    t = sizes.withColumn("nth", F.row_number().over(by) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("rate", (F.col("budget") - F.col("caps_before")) / F.col("weights_left"))
    t = t.withColumn("open", F.col("rate") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("rate")))).over(everything)
    t = t.withColumn("rate", first["rate"])
    t = t.withColumn("target", F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("rate") * F.col("weight"))))
    total = F.sum("target").over(everything)
    upto = F.sum("target").over(by.rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("low", F.when(total > 0, (upto - F.col("target")) / total).otherwise(0.0))
    t = t.withColumn("high", F.when(total > 0, upto / total).otherwise(0.0))
    return t.select("source", "nth", "n_docs", "source_size", "target", "low", "high")


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: slot, nth (source), rank (0 based, among the source's own slots).

    The golden-ratio point of a slot is mapped through the cumulative targets. A source keeps its first
    ceil(target / block) slots; what the sequence leaves it short of by then (a few slots at most) follows at the end.
    Sources cut [0, 1) into intervals; a slot finds its own by an equality join on the 4096ths that intervals touch.
    """
    plan = plan.withColumn("slots", F.ceil(F.col("target") / block))
    n = plan.agg(F.sum("slots")).first()[0] or 0
    slots = plan.sparkSession.range(n).select(F.col("id").alias("slot"), (((F.col("id") % F.lit(SPAN)) * F.lit(STEP)) % F.lit(SPAN)).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / F.lit(SPAN // 4096)))
    cells = F.sequence(F.floor(F.col("low") * 4096), F.least(F.lit(4095).cast("long"), F.floor(F.col("high") * 4096)))
    cells = plan.where("slots > 0").select("nth", "slots", (F.col("low") * SPAN).alias("from"), (F.col("high") * SPAN).alias("to"), F.explode(cells).alias("cell"))
    hit = slots.join(cells, "cell").where("point >= from and point < to").select("nth", "slots", "slot", F.shiftright("slot", 16).alias("run"))
    ranked = prefix_sums(hit.withColumn("one", F.lit(1).cast("long")), "nth", ["slot"], "one", "rank", "run").where("rank < slots").select("slot", "nth", "rank")
    got = hit.groupBy("nth").agg(F.count("*").alias("got")).withColumnRenamed("nth", "g_nth")
    late = plan.where("slots > 0").join(got, F.col("nth") == F.col("g_nth"), "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < slots")
    late = late.select("nth", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    late = late.select((F.lit(n) + F.row_number().over(W.orderBy("rank", "nth")) - 1).alias("slot"), "nth", "rank")
    return ranked.unionByName(late)


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row for each row of `docs`: doc_id, copy, size, source_size, target, taken, full, part, first_slot, last_slot, slots.

    Each source's documents stand in a shuffled order that depends on nothing but seed and doc_id. The words of that
    order, pass after pass, are cut into blocks of `block` words, the last one where the rounded target is reached;
    the source's slot of rank r takes block r. So a source gives its target to the word, goes through its documents
    evenly, and takes none more often than `most`, rounded up. `full` counts whole passes over the document; of its
    first `part` words there is one pass more. `slots` has the slot in which each pass begins, first_slot and last_slot
    are the first and the last of the mix that take words of it (null if none does).

    A null text has size 0 and taken 0, as have empty texts; null sources are one source, ordered last; repeated rows
    are rows of their own (`copy` tells rows of one doc_id apart); a null doc_id is an id like any other. Very long
    texts span several blocks. An empty table gives no rows. Other columns aren't read.
    """
    return _planned(docs, weights, share, most, block, seed).drop("place")


def _place(digest: Column) -> Column:
    """A number that rows share if id, source and text are the same; others that happen to share it do no harm."""
    return F.xxhash64("doc_id", "source", digest)


def _planned(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The rows of mix() with their place; those of a place are in one order by (doc_id, copy) and by (doc_id, source, digest of the text)."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("doc_id").orderBy("source", "digest")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key")
    plan = targets(sizes, weights, share, most)
    total = sizes.agg(F.sum("n_docs")).first()[0] or 0
    plan = materialised(plan, "mix-plan")  # a row for each source
    rows = rows.select("doc_id", "copy", "size", key, _place(F.col("digest")).alias("place"))
    rows = spread_join(rows, plan.select(key, "nth", "n_docs", "source_size", "target"), "source_key", "n_docs", total, ["doc_id", "copy"])
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy"))
    rows = rows.withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    rows = prefix_sums(rows, "nth", ["order", "doc_id", "copy"], "size", "start", "bucket")

    goal = F.round("target").cast("long")
    passes = F.sequence(F.lit(0).cast("long"), F.lit(int(-(-most // 1)) - 1).cast("long"))
    met = rows.where("size > 0").withColumn("goal", goal).withColumn("pass", F.explode(passes))
    met = met.withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("goal"))).where("begin < end")
    met = met.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    slots = schedule(plan, block).select(F.col("nth").alias("s_nth"), "rank", "slot")
    met = met.join(slots, (F.col("nth") == F.col("s_nth")) & (F.col("block") == F.col("rank")))
    words = F.least("end", (F.col("block") + 1) * block) - F.greatest("begin", F.col("block") * block)
    begins = F.when(F.floor(F.col("begin") / block) == F.col("block"), F.struct("pass", "slot"))
    met = met.select("doc_id", "copy", words.alias("words"), "slot", begins.alias("begins"))
    own = [F.sum("words").alias("t_taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.transform(F.array_sort(F.collect_list("begins")), lambda b: b["slot"]).alias("slots")]
    sums = met.groupBy("doc_id", "copy").agg(*own).select(F.col("doc_id").alias("t_id"), F.col("copy").alias("t_copy"), "t_taken", "first_slot", "last_slot", "slots")
    out = rows.join(sums, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("copy") == F.col("t_copy")), "left")
    taken = F.coalesce("t_taken", F.lit(0)).cast("long")
    size = F.greatest("size", F.lit(1))
    return out.select("place", "doc_id", "copy", "size", "source_size", "target", taken.alias("taken"), F.floor(taken / size).alias("full"), (taken % size).alias("part"), "first_slot", "last_slot", "slots")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of `docs`, a row for each pass over a document; n_chars, if there, follows the text.

    Rows are in the order of the schedule: sorted by the slot in which the pass begins, and within a slot as the source's
    shuffled order has them by no more than doc_id. The one document of a source at which its target is reached gives its
    first `part` words, with the white space between them. Documents that the mix takes no word of, empty ones among
    them, are gone.
    """
    with passing(docs.sparkSession):
        plan = _planned(docs, **options).select(F.col("place").alias("__at"), F.struct("doc_id", "copy", "full", "part", "slots").alias("own"))
        plan = plan.groupBy("__at").agg(F.sort_array(F.collect_list("own")).alias("__plans"))
        plan = materialised(plan, "mix-passes", lasting=True)
    rows = docs.withColumn("__digest", F.xxhash64("text")).withColumn("__place", _place(F.col("__digest")))
    nth = F.row_number().over(W.partitionBy("__place").orderBy("doc_id", "source", "__digest"))
    rows = rows.withColumn("__nth", nth).join(plan, F.col("__place") == F.col("__at"))  # both by place: the texts are dealt out once
    rows = rows.withColumn("__plan", F.get("__plans", F.col("__nth") - 1)).drop("__plans")
    rows = rows.select("*", F.col("__plan.full").alias("__full"), F.col("__plan.part").alias("__part"), F.col("__plan.slots").alias("__slots"))
    rows = rows.select("*", F.posexplode("__slots").alias("__pass", "__slot"))
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    part = F.rtrim(F.array_join(F.slice(pieces, F.lit(1), (F.col("__part") + lead).cast("int")), ""), F.lit(WORD_SPACE))
    rows = rows.withColumn("__text", F.when(F.col("__pass") < F.col("__full"), F.col("text")).otherwise(part))
    columns = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return rows.orderBy("__slot", "doc_id").select(*columns)
