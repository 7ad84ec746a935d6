"""Similarity joins over token sets, groups of linked items, and leader clusters in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import text as X
from tidemark.storage import checkpoint


#: Bits of a set's signature: differing tokens flip one bit each, so signatures differ in no more bits than sets in tokens.
SIGNATURE = 256
#: Sets that one probe meets at once: longer lists of a token are cut, so that no task holds a frequent token alone.
BLOCK_SETS = 1000
#: Sets of a span of days up to which no list of a token there is cut.
SPAN_SETS = 10_000
#: Counts that tokens share, by hash, for their order of rarity; pairs whose ends may be broadcast.
COUNTS, FEW_PAIRS = 1 << 16, 200_000


def within(a: Column, b: Column, hours: int) -> Column:
    """Whether two instants are at most ``hours`` apart."""
    reach = F.make_dt_interval(F.lit(0), F.lit(hours))
    return (a <= b + reach) & (b <= a + reach)


def similar_sets(items: DataFrame, key: str, tokens: str, threshold: float, at: str | None = None, hours: int = C.CLUSTER_HOURS) -> DataFrame:
    """(a, b, similarity), a < b: pairs of sets whose Jaccard similarity reaches the threshold.

    Where ``at`` names a column of instants, only pairs at most ``hours`` apart:
    sets then meet by token and span of days, so that the work grows with the
    sets, not with the square of a token's.

    Prefix filtering: with tokens in order of rarity and sets in order of size,
    the lesser of two such sets has one of its first size - ceil(2 threshold /
    (1 + threshold) * size) + 1 tokens, and the greater one of its first size -
    ceil(threshold * size) + 1, in common with the other. Only these are joined,
    and of what they join only pairs that could still reach the threshold leave
    the join: by size, by the tokens that follow in both, and by the bits in
    which their signatures differ. Tokens are joined as numbers, a count that is
    shared by hash and the hash itself: any order of all sets serves, and tokens
    that share a number only join more. Exact.
    """
    sets = items.select(F.col(key).alias("k"), F.col(tokens).alias("t"), *([F.col(at).cast("timestamp_ntz").alias("at")] if at else [])).filter(F.size("t") > 0)
    when, cell = (["at"], ["x", "span"]) if at else ([], ["x"])
    hashed = F.xxhash64("x")
    each = sets.select("k", *when, F.size("t").alias("size"), F.explode("t").alias("x")).select("k", *when, "size", hashed.bitwiseAND((1 << 32) - 1).alias("h"), F.pmod(hashed, F.lit(SIGNATURE)).cast("int").alias("place"))
    share = F.pmod("h", F.lit(COUNTS)).alias("share")
    rare = each.groupBy(share).agg(F.least(F.count(F.lit(1)), F.lit((1 << 31) - 1)).alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    words = [f"w{w}" for w in range(SIGNATURE // 64)]
    signature = [F.bit_xor(F.when(F.floor(F.col("place") / 64) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(SIGNATURE // 64)]
    ranked = each.select("*", share).join(F.broadcast(rare), "share")
    ordered = ranked.groupBy("k", "size", *when).agg(F.array_sort(F.collect_list(F.col("n") * (1 << 32) + F.col("h"))).alias("o"), *signature)
    size = F.col("size")
    least = lambda share: size - F.ceil(size * share - 1e-9).cast("int") + 1
    own = ["k", "size", *when, *words]
    wide = ordered.select(*own, F.posexplode(F.slice("o", F.lit(1), least(threshold))).alias("i", "x")).select(*own, (size - F.col("i") - 1).alias("after"), "x", (F.col("i") < least(2 * threshold / (1 + threshold))).alias("short"))
    short, cut = wide.filter("short"), True
    if at:
        days = hours // 24 + 1
        day = F.unix_date(F.col("at").cast("date"))
        span = lambda d: F.floor(d / (8 * days))
        short = short.withColumn("span", F.explode(F.sequence(span(day - days), span(day + days))))
        wide = wide.withColumn("span", span(day))
        cut = (sets.groupBy(span(day)).count().agg(F.max("count")).first()[0] or 0) > SPAN_SETS
    if cut:
        lists = short.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("blocks"))
        short = short.join(lists, cell).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))
        wide = wide.join(lists, cell).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cell = [*cell, "block"]
    a, b = (side.select(*cell, *[F.col(c).alias(f"{c}_{name}") for c in (*own, "after")]) for name, side in (("a", short), ("b", wide)))
    in_order = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("k_a") < F.col("k_b")))
    both = F.col("size_a") + F.col("size_b")
    unlike = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    near = in_order & (F.col("size_a") >= F.col("size_b") * threshold - 1e-9)
    near = near & ((F.least("after_a", "after_b") + 1) * (1 + threshold) >= both * threshold - 1e-9)
    near = near & (unlike * (1 + threshold) <= both * (1 - threshold) + 1e-9)
    if at:
        near = near & within(F.col("at_a"), F.col("at_b"), hours)
    pairs = checkpoint(a.join(b, cell).filter(near).select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b")).distinct())
    if pairs.count() <= FEW_PAIRS:
        sets = sets.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("k"))), "k", "left_semi")
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    return both.withColumn("similarity", X.jaccard(F.col("ta"), F.col("tb"))).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group): the least node reachable over edges. Labels pass along edges and to their label's label; lineage is cut each round.

    Rounds end when no label changes; taking over the label's label makes their
    number logarithmic in the longest chain.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a)))
    both = checkpoint(both.union(both.select("u", "u")).distinct())
    labels = checkpoint(both.groupBy("u").agg(F.min("v").alias("g")).withColumnRenamed("u", "node"))
    while True:
        heard = both.join(labels, F.col("u") == F.col("node")).groupBy("v").agg(F.min("g").alias("g"))
        up = labels.select(F.col("node").alias("_n"), F.col("g").alias("_g"))
        now = checkpoint(heard.join(up, F.col("g") == F.col("_n")).select(F.col("v").alias("node"), F.least("g", "_g").alias("g")))
        old = labels.select(F.col("node").alias("_o"), F.col("g").alias("_was"))
        if now.join(old, F.col("node") == F.col("_o")).filter("g <> _was").isEmpty():
            return now.select("node", F.col("g").alias("group"))
        labels = now


def leader_clusters(items: DataFrame, edges: DataFrame, hours: int = C.CLUSTER_HOURS) -> DataFrame:
    """(item_id, leader_id, similarity): each item joins an earlier item's cluster or leads its own, in order of arrival.

    Items: item_id, content_hash, received_at, cik (may be null). First an item
    of equal content joins its cluster; else the leader of highest similarity
    that began at most ``hours`` before and is still open (its last item is not
    older than that), the least id of equals. Clusters never mix two ciks. The
    order matters only among items of equal content and those that edges link
    within ``hours``, as a longer edge never leads to an open leader: each such
    group is worked through on its own, and groups in parallel.

    Of equal items the walk needs the first, the first of each cik and those of
    a cik that have edges. Others change nothing: a leader's hours count from
    its own arrival, and its cluster takes or refuses a cik for good, so without
    a cik they join the first one's leader, and else they do as the first of
    their cik did, or lead themselves.
    """
    items = items.select("item_id", "content_hash", F.col("received_at").cast("timestamp_ntz").alias("at"), F.col("cik").cast("string").alias("cik"))
    arrival = F.struct(F.col("at").isNull(), "at", "item_id")
    own = items.filter("content_hash IS NOT NULL").groupBy(F.col("content_hash").alias("_h"), F.col("cik").alias("_c")).agg(F.min(arrival).alias("own"), F.count(F.lit(1)).alias("m"))
    same = own.groupBy(F.col("_h").alias("h")).agg(F.min("own").alias("first"), F.sum("m").alias("n")).filter("n > 1")
    # a table of its own, so that adaptive plans can split a frequent content, which they can't beside an aggregate
    own = checkpoint(own.join(same, F.col("_h") == F.col("h")).select("_h", "_c", "own.item_id", "first", "n").select("_h", "_c", F.col("item_id").alias("own"), F.col("first.item_id").alias("first")))
    known = items.join(own, (F.col("content_hash") == F.col("_h")) & F.col("cik").eqNullSafe(F.col("_c")), "left")
    known = checkpoint(known.select("item_id", "content_hash", "at", "cik", F.coalesce("first", "item_id").alias("first"), F.coalesce("own", "item_id").alias("own"), F.col("first").isNull().alias("unique")))
    ends = [known.select(F.col("item_id").alias(x), F.col("at").alias(f"at_{x}"), F.col("first").alias(f"first_{x}")) for x in ("a", "b")]
    used = checkpoint(edges.select("a", "b", "similarity").join(ends[0], "a").join(ends[1], "b").filter(within(F.col("at_a"), F.col("at_b"), hours)).select("a", "b", "similarity", "first_a", "first_b"))
    linked = groups(used.filter("first_a <> first_b"), "first_a", "first_b")
    near = used.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").union(used.select("b", "a", "similarity")).groupBy("x").agg(F.map_from_entries(F.collect_set(F.struct("y", "similarity"))).alias("near"))
    rows = known.join(linked, F.col("first") == F.col("node"), "left").join(near, F.col("item_id") == F.col("x"), "left")
    later = F.when(F.col("cik").isNull(), F.col("item_id") != F.col("first")).otherwise((F.col("item_id") != F.col("own")) & F.col("near").isNull())
    kind = F.when(F.col("group").isNull() & F.col("unique"), "alone").when(later, "later").otherwise("walked")
    rows = checkpoint(rows.select(F.coalesce("group", "first").alias("g"), "item_id", "content_hash", "at", "cik", "near", "first", "own", kind.alias("kind")))
    single = rows.filter("kind = 'alone'").select("item_id", F.col("item_id").alias("leader_id"), F.lit(1.0).alias("similarity"))
    reach = pd.Timedelta(hours=hours)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, ciks, by_hash = {}, {}, {}
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                i, t, h, cik = r["item_id"], r["at"], r["content_hash"], None if pd.isna(r["cik"]) else r["cik"]
                free = lambda lead: cik is None or not ciks[lead] or ciks[lead] == {cik}
                lead, s = by_hash.get(h), 1.0
                if lead is None or not free(lead):
                    near = r["near"]
                    near = dict(near) if isinstance(near, (dict, list)) else {}
                    found = [(-v, o) for o, v in near.items() if o in start and t - start[o] <= reach and free(o)]
                    s, lead = min(found) if found else (-1.0, i)
                    s = -s
                if lead == i:
                    start[i], ciks[i] = t, set()
                if cik is not None:
                    ciks[lead].add(cik)
                if not pd.isna(h):
                    by_hash.setdefault(h, lead)
                out.append((i, lead, s))
            yield pd.DataFrame(out, columns=["item_id", "leader_id", "similarity"])

    # groups know nothing of each other, so those that share a partition are walked through together
    several = rows.filter("kind = 'walked'").select("g", "item_id", "content_hash", "at", "cik", "near").repartition("g").sortWithinPartitions(F.col("at").asc_nulls_last(), "item_id")
    walked = checkpoint(several.mapInPandas(walk, "item_id long, leader_id long, similarity double"))
    led = checkpoint(walked.groupBy("item_id").agg(F.min("leader_id").alias("leader_id")))
    lead, did = (led.select(F.col("item_id").alias(c), F.col("leader_id").alias(f"{c}_leader")) for c in ("first", "own"))
    rest = rows.filter("kind = 'later'").join(lead, "first").join(did, "own", "left")
    rest = rest.select("item_id", F.when(F.col("cik").isNull() | (F.col("own_leader") == F.col("first_leader")), F.col("first_leader")).otherwise(F.col("item_id")).alias("leader_id"), F.lit(1.0).alias("similarity"))
    return walked.unionByName(rest).unionByName(single)
