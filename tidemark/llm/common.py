"""What several operators share: checkpoints, bitmap filters, components, Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap row, fixed by Spark's bitmap functions.
BITMAP_BITS = 32768
#: A filter is never larger than this, so what is broadcast has a proven bound (2**28 bits are 32 MB).
MAX_FILTER_BITS = 1 << 28


def by_value(module_name: str = "tidemark.llm") -> None:
    """Send this package's functions to executors inside the job, so that they need no copy of the library."""
    import importlib

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(importlib.import_module(module_name))


by_value()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only in local mode: on a
    cluster executors don't share a machine's folders.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of one Arrow batch: what a Python worker holds of its input at a time.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes; lowers the session's bound where it is higher."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(key) or "").lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that Python objects of only a few rows live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Keys that a join by counts broadcasts, at most.
HOT_KEYS = 500


def join_counted(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with a table that has one row for each key and the key's number of rows in ``left``.

    A key with more than its 500th part of the ``total`` rows would fill a task
    of a shuffle, and adaptive splitting doesn't reach below an aggregate. Of
    such keys there are 500 at most, so they are broadcast; the others shuffle.
    """
    limit = max(total // HOT_KEYS, 100)
    cond = [F.col(a).eqNullSafe(F.col(b)) for a, b in on]
    right = checkpoint(right)
    is_hot = F.col(count) >= limit
    if right.filter(is_hot).isEmpty():
        return left.join(right, cond, how)
    rest = left.join(F.broadcast(right.filter(is_hot).select(*[b for _, b in on])), cond, "left_anti")
    return left.join(F.broadcast(right.filter(is_hot)), cond).unionByName(rest.join(right.filter(~is_hot), cond, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- bitmap filters -------------------------------------------------------


def filter_bits(n: int) -> int:
    """Bits for ``n`` entries: at least 16 an entry, a power of two, within the bound."""
    bits = 1 << 20
    while bits < 16 * max(n, 1) and bits < MAX_FILTER_BITS:
        bits <<= 1
    return bits


def _slots(h: Column, bits: int, hashes: int = 2) -> list[Column]:
    """One slot or two, from 1 to ``bits``, for a 64-bit hash."""
    return [F.pmod(h, F.lit(bits)) + 1, F.pmod(F.xxhash64(h, F.lit(7)), F.lit(bits)) + 1][:hashes]


def _bitmaps(slots: DataFrame) -> DataFrame:
    """A row for each bitmap that has bits: at most bits / 8 bytes in all."""
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def member_filter(df: DataFrame, h: Column, bits: int, hashes: int = 2) -> DataFrame:
    """A Bloom filter of the hashes ``h``."""
    return _bitmaps(df.select(F.explode(F.array(*_slots(h, bits, hashes))).alias("slot")))


def repeat_filter(df: DataFrame, h: Column, bits: int, hashes: int = 2) -> DataFrame:
    """A Bloom filter that holds every hash which occurs twice or more, and few others.

    Only slot numbers with counts shuffle, summed on the map side; a slot that
    two rows hit gets its bit.
    """
    slots = df.select(F.explode(F.array(*_slots(h, bits, hashes))).alias("slot"))
    return _bitmaps(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("slot"))


def _slots_of(batches: Iterator[pa.RecordBatch], bits: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(bucket, positions) of the hashes in lists of longs: two bytes for each slot that was hit, four where it was hit again."""
    waiting: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        nonlocal size
        slot, n = np.unique(np.concatenate(waiting) if waiting else np.empty(0, np.int64), return_counts=True)
        slot = np.repeat(slot, np.minimum(n, 2))
        waiting.clear()
        size = 0
        bucket = slot >> 15
        starts = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0] if len(slot) else np.empty(0, np.int64)
        cuts = np.concatenate([starts, [len(slot)]]).astype(np.int32) * 2
        positions = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer((slot & 32767).astype("<u2").tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts] + 1), positions], ["bucket", "positions"])

    for batch in batches:
        h = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        waiting.append(h % np.int64(bits))
        size += len(h)
        if size > most:
            yield out()
    yield out()


def _hit(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the positions that come once, or twice, in a bucket; rows of a bucket come one after the other."""
    at, hits = None, np.zeros(BITMAP_BITS, np.uint8)
    rows: list[tuple[int, bytes]] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], []]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["bucket", "bitmap"])

    def close() -> None:
        if at is not None and (hits >= least).any():
            rows.append((at, np.packbits(hits >= least, bitorder="little").tobytes()))

    for batch in batches:
        for bucket, positions in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != at:
                close()
                at = bucket
                hits[:] = 0
            position, n = np.unique(np.frombuffer(positions, "<u2"), return_counts=True)
            hits[position] = np.minimum(hits[position] + n, 2)
        if len(rows) > 500:
            yield out()
    close()
    yield out()


def repeats(df: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """``repeat_filter`` with one slot a hash for a column of lists of hashes: a slot shuffles as two bytes. With ``least`` 1, ``member_filter`` alike."""
    slots = map_arrow(df, lambda it: _slots_of(it, bits), "bucket long, positions binary")
    return map_arrow(slots.repartition("bucket").sortWithinPartitions("bucket"), lambda it: _hit(it, least), "bucket long, bitmap binary")


class Held:
    """A filter of one bit a hash, as bytes, for tasks in Python; of several filters that are united, what any of them holds.

    ``with_flag`` costs the driver's heap several copies of a filter at once
    for each join, and keeps them; this one goes through it once and stays in
    blocks until the broadcast is destroyed.
    """

    def __init__(self, bitmaps: DataFrame, bits: int):
        self.bits, self.bytes = bits, bytearray(bits // 8)
        held = np.frombuffer(self.bytes, np.uint8)
        for r in bitmaps.collect():  # bits / 8 bytes at most for each filter among the rows
            held[r["bucket"] * 4096 - 4096 : r["bucket"] * 4096] |= np.frombuffer(r["bitmap"], np.uint8)

    def of(self, h: np.ndarray) -> np.ndarray:
        slot = h.astype(np.int64) % np.int64(self.bits)
        return (np.frombuffer(self.bytes, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def with_flag(df: DataFrame, h: Column, bits: int, bitmaps: DataFrame, flag: str, hashes: int = 2) -> DataFrame:
    """Add ``flag``: whether the filter may hold the hash. Only the bounded filter is broadcast."""
    out = df.withColumn("_h", h)
    tests = []
    for i, slot in enumerate(_slots(F.col("_h"), bits, hashes)):
        b = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}")))
        out = out.withColumn(f"_slot{i}", slot)
        out = out.join(b, F.bitmap_bucket_number(f"_slot{i}") == F.col(f"_bucket{i}"), "left")
        at = F.bitmap_bit_position(f"_slot{i}")
        byte = F.conv(F.hex(F.substring(F.col(f"_bitmap{i}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    return out.withColumn(flag, tests[0] & tests[-1]).drop("_h", *[f"_{x}{i}" for x in ("bucket", "bitmap", "slot") for i in (0, 1)])


def packed(df: DataFrame) -> DataFrame:
    """The rows as one column ``row``, so that no column of theirs can clash with a helper's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``ids``. Only rows that a bounded filter can't clear shuffle."""
    ids = ids.select(F.col(id_col).alias("gone")).distinct()
    own = F.col(f"row.{id_col}")
    bits = filter_bits(ids.count())
    flagged = with_flag(packed(docs), F.xxhash64(own), bits, member_filter(ids, F.xxhash64("gone"), bits), "maybe")
    rest = flagged.filter("maybe").join(ids, own.eqNullSafe(F.col("gone")), "left_anti")
    return flagged.filter(~F.col("maybe")).select("row.*").unionByName(rest.select("row.*"))


# --- connected components -------------------------------------------------


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of each component, for all nodes that have an edge.

    Labels start as the least neighbour and pass along edges until none
    changes; from the third round on labels also take their label's label, so
    long chains need rounds logarithmic in their length. Edges stay dealt by
    their source and labels by their node, so a round shuffles only messages,
    minima of which are taken on the map side. Sources with very many edges,
    500 at most, get their labels by broadcast. Self edges and repeated edges
    are allowed; an empty table gives an empty one.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    both = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x in "ab" for y in "ab"])
    each = checkpoint(e.select(F.explode(both).alias("e")).select("e.u", "e.v").distinct())
    limit = max(each.count() // HOT_KEYS, 100)
    hot = [r["u"] for r in each.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).select("u").collect()]
    # edges of hot sources stay dealt by both ends, all others are dealt by their source once
    cold, wide = each, None
    if hot:
        cold, wide = each.filter(~F.col("u").isin(hot)), each.filter(F.col("u").isin(hot))
    cold = checkpoint(cold.repartition("u"))
    labels = checkpoint(each.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label"))
    done = 1
    while True:
        said = cold.join(labels, F.col("u") == F.col("node")).select("v", "label")
        if wide is not None:
            said = said.unionByName(wide.join(F.broadcast(labels.filter(F.col("node").isin(hot))), F.col("u") == F.col("node")).select("v", "label"))
        now = said.groupBy("v").agg(F.min("label").alias("now"))
        # nodes of hot sources hear from themselves too, so every node has a message
        both = now.join(labels, F.col("v") == F.col("node")).select("node", F.least("now", "label").alias("label"), (F.col("now") < F.col("label")).alias("changed"))
        state = checkpoint(both)
        done += 1
        if state.filter("changed").isEmpty():
            return state.select("node", F.col("label").alias("component"))
        labels = state.select("node", "label")
        if done >= 3:
            up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
            sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_c")).withColumnRenamed("label", "_k")
            roots = sizes.join(up, F.col("_k") == F.col("_n")).select("_k", "_l", "_c")
            jumped = join_counted(labels, roots, [("label", "_k")], "_c", limit * HOT_KEYS)
            labels = checkpoint(jumped.groupBy("node").agg(F.min(F.least("label", "_l")).alias("label")))
