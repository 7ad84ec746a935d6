"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Each source has a target number of words. Rates of documents are as close as
possible, in relative entropy, to one copy each, under the constraint that the
words they take add up to the target, and with at most ``MAX_COPIES`` copies.
The dual of that convex problem has one multiplier a source, and its solution
tilts documents exponentially by their size: rate = min(cap, exp(multiplier *
size / mean size)). Newton's iterations on the multipliers are sums over a
histogram of (source, size), which is counted once with map-side sums; steps
that leave the bracket known so far are halved.

Rates are then rounded into whole copies for each cell of the histogram, from
the largest size down, carrying each cell's error in words to the next, so a
source ends within about half its smallest document of its target. Which
documents of a cell get the extra copy goes by a hash of their id and text, so
reruns agree. Large cells are dealt over hash buckets, with a quota for each,
so that no group that a task ranks has more than some hundreds of hashes. Rows
of equal hashes, as those that repeat an id and a text, are counted first and
told apart only where a quota falls among them: by their places in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
ITERATIONS, TOLERANCE = 60, 1e-9
#: Rows of a cell that one task ranks, about.
BUCKET_ROWS = 500
#: Sizes of a source that one step of the rounding works through.
RUN = 256
_LIMIT = 700.0


def size_of(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space."""
    text = F.coalesce(text, F.lit(""))
    # white space to one kind, then its runs to one, leaves a separator between words
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """Add ``target`` to (source, source_size).

    Sources by code point, null last, get the weights in turn and share the sum
    of all sizes; a target stops at ``cap`` times its source's size and what is
    over goes to the others by weight. Sources that stop first are those of the
    least size for their weight, so one ordered pass finds the level. Sources
    are aggregated rows, a few bytes each.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    t = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    limit = F.lit(float(cap)) * F.col("source_size")
    before = W.orderBy((limit / F.col("_w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    t = t.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    stopped = F.col("_level") * F.col("_w") >= limit
    t = t.withColumn("_stopped", stopped)
    level = F.max(F.when(~F.col("_stopped"), F.col("_level"))).over(every)
    # after the stopped ones all others have the same level: that of the first
    first = F.min_by(F.when(~F.col("_stopped"), F.col("_level")), F.when(~F.col("_stopped"), limit / F.col("_w"))).over(every)
    t = t.withColumn("target", F.when(F.col("_stopped"), limit).otherwise(F.coalesce(first, level) * F.col("_w")))
    return t.select("source", "source_size", F.coalesce("target", F.lit(0.0)).cast("double").alias("target"))


def balance(cells: DataFrame, goal: DataFrame, cap: float = MAX_COPIES) -> DataFrame:
    """(source_key, multiplier, mean): Newton's method on the dual, all sources at once.

    ``cells`` has source_key, size, n; ``goal`` has source_key, source_size,
    docs, target. Every iteration reads the histogram once and sums on the map
    side; the state is a row for each source.
    """
    # at the cap no multiplier is finite, and the bracket's end serves
    begin = F.when(F.col("target") >= F.lit(float(cap)) * F.col("source_size"), F.lit(_LIMIT)).otherwise(F.lit(0.0))
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    state = goal.select("source_key", "target", mean.alias("mean"), begin.alias("m"), F.lit(-_LIMIT).alias("lo"), F.lit(_LIMIT).alias("hi"))
    state = checkpoint(state)
    cells = cells.select(F.col("source_key").alias("_k"), "size", "n")
    for _ in range(ITERATIONS):
        x = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("m") * x, F.lit(50.0)))
        rate = F.least(F.lit(float(cap)), free)
        sums = cells.join(state, F.col("_k") == F.col("source_key")).groupBy("_k").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(free < cap, F.col("n") * F.col("size") * x * free).otherwise(0.0)).alias("slope"))
        now = state.join(sums, F.col("_k") == F.col("source_key"))
        error = F.col("got") - F.col("target")
        lo, hi = F.when(error < 0, F.col("m")).otherwise(F.col("lo")), F.when(error > 0, F.col("m")).otherwise(F.col("hi"))
        now = now.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_error", F.abs(error) / F.greatest("target", F.lit(1.0)))
        step = F.col("m") - F.when(F.col("slope") > 0, error / F.col("slope"))
        half = F.when(F.col("_lo") <= -_LIMIT, F.greatest(2 * F.least("_hi", F.lit(0.0)) - 1, F.lit(-_LIMIT))).when(F.col("_hi") >= _LIMIT, F.least(2 * F.greatest("_lo", F.lit(0.0)) + 1, F.lit(_LIMIT))).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        fine = step.isNotNull() & (step > F.col("_lo")) & (step < F.col("_hi")) & (F.abs(step - F.col("m")) <= 2 + F.abs(F.col("m")))
        done = (F.col("_error") <= TOLERANCE) | (F.col("m") >= _LIMIT) | (F.col("m") <= -_LIMIT)
        now = now.withColumn("_m", F.when(done, F.col("m")).when(fine, step).otherwise(half))
        state = checkpoint(now.select("source_key", "target", "mean", F.col("_m").alias("m"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), done.alias("done")))
        if not state.filter(~F.col("done")).limit(1).count():
            break
        state = state.drop("done")
    return state.select("source_key", F.col("m").alias("multiplier"), "mean")


def _rounded(cells: DataFrame, cap: float) -> DataFrame:
    """Whole copies of each cell, errors carried from the largest size down.

    An array holds an entry for each size of a source. It is worked through in
    runs, so that no step copies more than a run or a list of runs.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), F.col("n"), F.col("rate"))))
    by_source = cells.groupBy("source_key").agg(ordered.alias("a"))

    def step(acc: Column, c: Column) -> Column:
        size = -c["s"]
        want = size * c["n"] * c["rate"] + acc["error"]
        k = F.when(size == 0, c["n"]).otherwise(F.least(F.greatest(F.round(want / size), F.lit(0)), c["n"] * int(cap))).cast("bigint")
        return F.struct(F.when(size == 0, acc["error"]).otherwise(want - size * k).cast("double").alias("error"), F.concat(acc["k"], F.array(k)).alias("k"))

    def run(acc: Column, i: Column) -> Column:
        begin = F.struct(acc["error"].alias("error"), F.array().cast("array<bigint>").alias("k"))
        got = F.aggregate(F.slice("a", i * RUN + 1, F.lit(RUN)), begin, step)
        return F.struct(got["error"].alias("error"), F.concat(acc["k"], F.array(got["k"])).alias("k"))

    start = F.struct(F.lit(0.0).alias("error"), F.array().cast("array<array<bigint>>").alias("k"))
    runs = F.sequence(F.lit(0), ((F.size("a") - 1) / RUN).cast("int"))
    got = by_source.select("source_key", "a", F.flatten(F.aggregate(runs, start, run)["k"]).alias("k"))
    cell = got.select("source_key", F.explode(F.arrays_zip("a", "k")).alias("c"))
    return cell.select("source_key", (-F.col("c.a.s")).alias("size"), F.col("c.a.n").alias("n"), F.col("c.k").alias("copies"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Add _key, _size and _h: a key of the source, the words, and a hash of the id and the text."""
    source = F.col(source_col).cast("string")
    key = F.unhex(F.md5(F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit(""))).cast("binary")))
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.withColumns({"_key": key, "_size": size_of(F.col(text_col)), "_h": F.xxhash64(doc, F.col(text_col), F.lit(5))})


class Decisions:
    """What the mix takes, by cell: ``base`` copies of each row, one more of rows below a cut of the hash in their bucket, and of some or all of those at it."""

    def __init__(self, rows: DataFrame, weights: tuple[float, ...], cap: float):
        """``rows``: source, _key, _size, _h."""
        cells = checkpoint(rows.groupBy(F.col("_key").alias("source_key"), "source", F.col("_size").alias("size")).agg(F.count(F.lit(1)).alias("n")))
        totals = cells.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
        shared = targets(totals.select("source", "source_size"), weights, cap).select(F.col("source").alias("_s"), "target")
        goal = checkpoint(totals.join(shared, F.col("_s").eqNullSafe(F.col("source"))).drop("_s"))
        dual = balance(cells, goal, cap).withColumnRenamed("source_key", "_k")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(50.0))))
        rated = cells.join(dual, F.col("source_key") == F.col("_k")).select("source_key", "size", "n", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate).alias("rate"))
        n_buckets = F.greatest(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1)).cast("long")
        quota = _rounded(rated, cap).select(F.col("source_key").alias("_ck"), F.col("size").alias("_cz"), "n", F.floor(F.col("copies") / F.col("n")).alias("base"), (F.col("copies") % F.col("n")).alias("extra"), n_buckets.alias("nb"))
        self.quota = checkpoint(quota)
        self.goal = goal.select(F.col("source_key").alias("_gk"), "source_size", "target")
        self.small_goal = goal.count() <= 10_000
        # a row for each cell and an entry for each bucket: broadcast up to 200,000 of them, some 16 MB
        self.small = self.quota.agg(F.sum(F.col("nb") + 1)).first()[0] or 0
        # rows of one hash are one from here on
        once = self._join(rows, self.quota.filter("extra > 0")).groupBy("_ck", "_cz", "extra", "nb", "_h").agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", F.pmod(F.col("_h"), F.col("nb")))
        # the extra copies of a cell go to its buckets in turn, then within a bucket by hash
        held = once.groupBy("_ck", "_cz", "bucket", "extra").agg(F.sum("c").alias("m"))
        upto = F.coalesce(F.sum("m").over(W.partitionBy("_ck", "_cz").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        share = held.select("_ck", "_cz", "bucket", F.least(F.col("extra") - upto, F.col("m")).alias("share")).filter("share > 0")
        share = share.select(F.col("_ck").alias("_sk"), F.col("_cz").alias("_sz"), F.col("bucket").alias("_sb"), "share")
        below = F.coalesce(F.sum("c").over(W.partitionBy("_ck", "_cz", "bucket").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        last = once.withColumn("_r", below).join(share, (F.col("_ck") == F.col("_sk")) & (F.col("_cz") == F.col("_sz")) & (F.col("bucket") == F.col("_sb"))).filter("_r < share AND share <= _r + c")
        # of the rows at the cut, ``some`` get a copy; 0 stands for all
        some = F.when(F.col("share") < F.col("_r") + F.col("c"), F.col("share") - F.col("_r")).otherwise(F.lit(0))
        cuts = last.groupBy(F.col("_ck").alias("_uk"), F.col("_cz").alias("_uz")).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("_h", some.cast("long").alias("some"))))).alias("cuts"))
        self.cells = checkpoint(self.quota.join(cuts, (F.col("_ck") == F.col("_uk")) & (F.col("_cz") == F.col("_uz")), "left").select("_ck", "_cz", "base", "nb", "cuts"))
        self.ties = not self.cells.filter(F.exists(F.map_values("cuts"), lambda x: x["some"] > 0)).isEmpty()

    def _join(self, rows: DataFrame, cells: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(cells) if self.small <= 200_000 else cells, (F.col("_key") == F.col("_ck")) & (F.col("_size") == F.col("_cz")))

    def copies(self, rows: DataFrame) -> DataFrame:
        """Add ``_copies`` and leave the helping columns of ``rows`` in place; only those of the cells go."""
        got = self._join(rows, self.cells).withColumn("_cut", F.try_element_at("cuts", F.pmod(F.col("_h"), F.col("nb"))))
        at, some = F.col("_h") == F.col("_cut._h"), F.col("_cut.some")
        more = F.coalesce(((F.col("_h") < F.col("_cut._h")) | (at & (some == 0))).cast("long"), F.lit(0))
        away = ["_ck", "_cz", "base", "nb", "cuts", "_cut"]
        if not self.ties:
            return got.withColumn("_copies", F.col("base") + more).drop(*away)
        tied = F.coalesce(at & (some > 0), F.lit(False))
        out = got.filter(~tied).withColumn("_copies", F.col("base") + more).drop(*away)
        # rows that nothing tells apart, dealt by the partitions of their checkpoint, whose shares are taken in turn
        rest = checkpoint(got.filter(tied)).withColumn("_part", F.spark_partition_id())
        key = ["_ck", "_cz", "_h"]
        counts = rest.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(*[F.col(c).alias(f"_t{c}") for c in (*key, "_part")], before.alias("_before"))
        place = F.row_number().over(W.partitionBy(*key, "_part").orderBy(F.lit(0)))
        rest = rest.withColumn("_place", place).join(counts, [F.col(c) == F.col(f"_t{c}") for c in (*key, "_part")])
        more = (F.col("_before") + F.col("_place") <= F.col("_cut.some")).cast("long")
        return out.unionByName(rest.withColumn("_copies", F.col("base") + more).select(*out.columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row for each row of ``docs``.

    A null source is a source of its own; null and empty texts have size 0 and
    one copy; very long texts are read whole and may take a source past its
    target by half of the smallest one. Rows may share an id, null included:
    each is mixed for itself, and of rows that are equal in id, text and source
    any may get the copy that not all get. A source without words has target 0.
    An empty table gives an empty result. Other columns play no part, whatever
    their names.
    """
    keyed = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source")), "doc_id", "text", "source")
    rows = checkpoint(keyed.drop("text"))
    taken = Decisions(rows, weights, cap)
    out = taken.copies(rows).join(F.broadcast(taken.goal) if taken.small_goal else taken.goal, F.col("_key") == F.col("_gk"))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).cast("long").alias("taken"), F.col("_copies").cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Nulls, empty and long texts, repeated rows and an empty table go as in
    ``mix``; all columns stay, whatever their names. Texts don't shuffle while
    the table of cells is small enough to broadcast, but for rows that share
    id, text and source where only some of them get a copy.
    """
    rows = checkpoint(_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source")), "doc_id", "text", "source").drop("text"))
    taken = Decisions(rows, weights, cap)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    out = taken.copies(_keyed(plain, "_doc", "_text", "_source")).filter("_copies > 0")
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
