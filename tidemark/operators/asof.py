"""As-of joins without fan-out: one union, one sort, a running last value.

Keys are cut into time buckets, so a hot key is spread over as many tasks as it
has buckets; what was last known before a bucket is carried into it from a
table of one row for each key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_DAYS = 30


def _bucket(ts: Column, days: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (days * 86_400_000_000))


def asof(probes: DataFrame, facts: DataFrame, keys: list[str], at: str, ts: str = "ts", name: str = "fact", bucket_days: int = BUCKET_DAYS, max_age_hours: int | None = None) -> DataFrame:
    """Add to each probe the last fact at or before ``at``, as a struct ``name`` (null if none).

    Facts have at most one row for each key and ``ts``. Probes whose ``at`` is
    null get null. With ``max_age_hours`` older facts don't count; then a fact
    is simply put into each bucket that it can serve, and nothing needs carrying.
    """
    fact = facts.select(*[F.col(k) for k in keys], F.col(ts).alias("_at"), F.struct(*facts.columns).alias("_fact"))
    probe = probes.select(*[F.col(k) for k in keys], F.col(at).alias("_at"), F.struct(*probes.columns).alias("_probe")).withColumn("_bucket", _bucket(F.col("_at"), bucket_days))
    no_fact, no_probe = F.lit(None).cast(fact.schema["_fact"].dataType), F.lit(None).cast(probe.schema["_probe"].dataType)
    asked = probe.select(*keys, "_bucket", "_at", F.lit(2).alias("_kind"), no_fact.alias("_fact"), "_probe")
    if max_age_hours is not None:
        age = F.make_dt_interval(F.lit(0), F.lit(max_age_hours))
        served = F.sequence(_bucket(F.col("_at"), bucket_days), _bucket(F.col("_at") + age, bucket_days))
        every = fact.select(*keys, F.explode(served).alias("_bucket"), "_at", F.lit(1).alias("_kind"), "_fact", no_probe.alias("_probe")).unionByName(asked)
    else:
        fact = fact.withColumn("_bucket", _bucket(F.col("_at"), bucket_days))
        # the last fact of each bucket, carried over the buckets that are asked for
        heads = fact.groupBy(*keys, "_bucket").agg(F.max_by("_fact", "_at").alias("_fact"))
        wanted = probe.filter(F.col("_bucket").isNotNull()).select(*keys, "_bucket").distinct()
        over = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        steps = heads.withColumn("_asked", F.lit(0)).unionByName(wanted.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
        # a fact and a question of one bucket: the fact is inside the bucket and must not be carried into it
        steps = steps.groupBy(*keys, "_bucket").agg(F.first("_fact", ignorenulls=True).alias("_fact"), F.max("_asked").alias("_asked"))
        carried = steps.withColumn("_fact", F.last("_fact", ignorenulls=True).over(over)).filter("_asked = 1 AND _fact IS NOT NULL")
        before = carried.select(*keys, "_bucket", F.lit(None).cast(dict(probe.dtypes)["_at"]).alias("_at"), F.lit(0).alias("_kind"), "_fact", no_probe.alias("_probe"))
        every = before.unionByName(fact.select(*keys, "_bucket", "_at", F.lit(1).alias("_kind"), "_fact", no_probe.alias("_probe"))).unionByName(asked)
    w = W.partitionBy(*keys, "_bucket").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = every.withColumn("_found", F.last("_fact", ignorenulls=True).over(w)).filter("_kind = 2")
    ok = F.col("_at").isNotNull()
    if max_age_hours is not None:
        ok = ok & (F.col("_at") - F.col(f"_found.{ts}") <= age)
    return found.select("_probe.*", F.when(ok, F.col("_found")).alias(name))


def with_next(bars: DataFrame, keys: list[str], ts: str = "ts", value: str = "close") -> DataFrame:
    """Add the time and value of each bar's successor: the evidence that a bar is settled, and the first bar after it."""
    w = W.partitionBy(*keys).orderBy(ts)
    return bars.withColumns({"next_ts": F.lead(ts).over(w), f"next_{value}": F.lead(value).over(w)})


def fresh(at: Column, fact_ts: Column, minutes: int) -> Column:
    return at - fact_ts <= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def settled(at: Column, bar: Column, minutes: int, until: Column | None = None) -> Column:
    """A bar counts while fresh, or at any age once a later bar is known (up to ``until``, where given)."""
    later = bar["next_ts"].isNotNull() if until is None else F.coalesce(bar["next_ts"] <= until, F.lit(False))
    return bar.isNotNull() & (fresh(at, bar["ts"], minutes) | later)
