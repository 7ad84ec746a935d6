"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

Trusted texts train the model: all of them, whole. N-grams of UTF-8 bytes are
exact in a 64-bit key and serve all languages. Partitions count the highest
order on their side; every other statistic is a grouping or a join of counts
sharded by n-gram: continuation counts of the lower orders, totals and numbers
of followers of each context, three discounts an order from the counts of
counts, and the interpolated probabilities, joined order by order.

Scoring needs, for each window, the probability at the longest order that was
seen, times the weights of the longer contexts that were seen. The n-grams and
contexts of highest counts, ``SHARD_ROWS`` of them at most, go to the tasks that
read the texts, with a filter of bounded size that holds all others. A window
that meets none of the others is scored in place. The rest, distinct ones
first, are joined with the sharded tables order by order, and what they add up
to is joined to their documents: one pass over the texts whatever the size of
the model, of which the driver holds a bounded part.

A document stays when its perplexity is at most a quantile, taken for each
language over trusted documents that the model has not seen: a fifth of them,
chosen by a hash of their id, is kept from training, since a model flatters the
texts that it was trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Held, checkpoint, filter_bits, join_counted, map_arrow, repeats, sliced
from tidemark.llm.shingles import mix

ORDER = 5
QUANTILE = 0.995
#: One trusted document in so many calibrates the thresholds and trains nothing.
CALIBRATING = 5
#: N-grams and contexts that are broadcast at most: some 12 bytes each.
SHARD_ROWS = 4_000_000
#: Rows of a part of the count tables, which are far smaller than the texts.
PART_ROWS = 250_000
_PAD = b"\n"


def keys_of(raw: bytes, order: int) -> np.ndarray:
    """The windows of a text that starts after line ends and closes with one."""
    b = np.frombuffer(_PAD * (order - 1) + raw + _PAD, np.uint8).astype(np.uint64)
    n = len(b) - order + 1
    out = np.zeros(n, np.uint64)
    for j in range(order):
        out = out << np.uint64(8) | b[j : j + n]
    return out


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    keys, counts, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, c = np.unique(np.concatenate(waiting), return_counts=True)
        k, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
        return k, np.bincount(at, np.concatenate([counts, c])).astype(np.int64)

    def out(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["key", "c"])

    for batch in sliced(batches):
        for text in batch.column(0).to_pylist():
            raw = (text or "").encode("utf-8", "replace")
            for at in range(0, max(len(raw), 1), 1 << 20):  # very long texts in runs that overlap by a context
                run = keys_of(raw, order) if len(raw) <= 1 << 20 else keys_of(raw[max(at - order + 1, 0) : at + (1 << 20)], order)[(order - 1 if at else 0) :]
                waiting.append(run)
                size += len(run)
        if size > 4_000_000:
            keys, counts = merged()
            waiting, size = [], 0
            if len(keys) > 2_000_000:
                yield out(keys, counts)
                keys, counts = keys[:0], counts[:0]
    if waiting:
        keys, counts = merged()
    yield out(keys, counts)


class Model:
    """Tables ``grams`` (n, key, c, logp) and ``contexts`` (n of the context, key, c, logw), ``c`` being counts."""

    def __init__(self, grams: DataFrame, contexts: DataFrame, order: int):
        self.grams, self.contexts, self.order = grams, contexts, order

    def least_count(self, rows: int) -> int:
        """From which count on, a power of two, n-grams and contexts are ``rows`` at most; 0 if all are."""
        counts = self.grams.select("c").unionByName(self.contexts.select("c")).groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("m")).collect()
        by = {r["b"]: r["m"] for r in counts}
        if sum(by.values()) <= rows:
            return 0
        at = max(by, default=0) + 1
        while sum(m for b, m in by.items() if b >= at - 1) <= rows:
            at -= 1
        return 1 << at

    def head(self, least: int) -> tuple[dict, dict]:
        """Both tables of at least this count, by order: sorted keys and values."""
        out = []
        for table, value in ((self.grams, "logp"), (self.contexts, "logw")):
            got = table.filter(F.col("c") >= least).select("n", "key", value).toArrow()
            n, key, v = (got.column(c).to_numpy() for c in ("n", "key", value))
            out.append({})
            for k in np.unique(n).tolist():
                at = n == k
                o = np.argsort(key[at].view(np.uint64))
                out[-1][k] = key[at].view(np.uint64)[o], v[at][o].astype(np.float64)
        return out[0], out[1]

    def rest(self, least: int) -> Held:
        """A filter of all n-grams and contexts below this count."""
        few = self.grams.select("n", "key", "c").unionByName(self.contexts.select((F.col("n") + 16).alias("n"), "key", "c")).filter(F.col("c") < least).select("n", "key")
        bits = filter_bits(few.count())
        return Held(repeats(map_arrow(few, _marks, "h array<long>"), bits, 1), bits)

    def joined(self, windows: DataFrame) -> DataFrame:
        """(w, logp) of distinct windows ``w`` by joins with the whole tables."""
        at = windows.withColumns({"logp": F.lit(None).cast("double"), "more": F.lit(0.0)})
        for n in range(self.order, 0, -1):
            own = F.col("w").bitwiseAND(F.lit((1 << 8 * n) - 1))
            grams = self.grams.filter(F.col("n") == n).select(F.col("key").alias("_g"), F.col("logp").alias("_p"))
            contexts = self.contexts.filter(F.col("n") == n - 1).select(F.col("key").alias("_k"), F.col("logw").alias("_w"))
            at = at.join(grams, own == F.col("_g"), "left").withColumn("logp", F.coalesce("logp", F.col("more") + F.col("_p"))).drop("_g", "_p")
            at = at.join(contexts, F.shiftright(own, 8) == F.col("_k"), "left").withColumn("more", F.col("more") + F.coalesce("_w", F.lit(0.0))).drop("_k", "_w")
        return at.select("w", F.coalesce("logp", F.col("more") + F.lit(float(np.log(1 / 256)))).alias("logp"))


def mark(n: int | np.ndarray, key: np.ndarray) -> np.ndarray:
    """What of an n-gram, or of a context with 16 added to its order, goes into the filter."""
    return mix(key ^ (np.asarray(n, np.uint64) << np.uint64(56))).view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = mark(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), pa.array(h))], ["h"])


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """A model of one text column, whatever its name. Null texts count as empty."""
    rows = texts.select(F.col(texts.columns[0]).alias("text"))
    top = map_arrow(rows, lambda it: _counted(it, order), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    counts = {order: checkpoint(top)}
    parts = counts[order].count() // PART_ROWS + 1
    counts[order] = counts[order].coalesce(parts)
    for n in range(order - 1, 0, -1):  # in how many ways a shorter n-gram continues a byte
        short = F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))
        counts[n] = checkpoint(counts[n + 1].groupBy(short.alias("key")).agg(F.count(F.lit(1)).alias("c")).coalesce(parts))
    grams, contexts, lower = [], [], None
    for n in range(1, order + 1):
        t = counts[n]
        few = {r["c"]: r["m"] for r in t.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("m")).collect()}
        m = [few.get(i, 0) for i in range(1, 5)]
        if n > 1 and m[0] and m[1]:
            y = m[0] / (m[0] + 2 * m[1])
            d = [min(max(i - (i + 1) * y * m[i] / m[i - 1], 0.0), float(i)) if m[i - 1] else 0.0 for i in (1, 2, 3)]
        else:  # too few counts to estimate from
            d = [0.5, 0.75, 0.9]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("key", 8)
        totals = t.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(off).alias("off"))
        w = F.col("off") / F.col("total")
        joined = t.withColumn("_context", context).join(totals, F.col("_context") == F.col("context"))
        own = (F.col("c") - off) / F.col("total")
        if n == 1:
            p = joined.select("key", "c", (own + w / 256).alias("p"))
        else:
            short = F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))
            p = joined.withColumn("_short", short).join(lower.select(F.col("key").alias("_lower"), F.col("p").alias("_p")), F.col("_short") == F.col("_lower")).select("key", "c", (own + w * F.col("_p")).alias("p"))
        lower = checkpoint(p.coalesce(parts))
        grams.append(lower.select(F.lit(n).alias("n"), "key", "c", F.log("p").alias("logp")))
        contexts.append(totals.select(F.lit(n - 1).alias("n"), F.col("context").alias("key"), F.col("total").alias("c"), F.log(F.greatest(w, F.lit(1e-300))).alias("logw")))
    union = lambda tables: checkpoint(_union(tables))
    return Model(union(grams), union(contexts), order)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Scorer:
    """Log probabilities of windows by a part of the model, and which ones need the rest of it."""

    def __init__(self, grams: dict, contexts: dict, rest: Held | None, order: int):
        self.grams, self.contexts, self.rest, self.order = grams, contexts, rest, order
        keys, values = grams.get(order, (np.zeros(0, np.uint64), np.zeros(0)))
        self.bits = max(10, int(np.ceil(np.log2(max(2 * len(keys), 2)))))
        slot, unset = self._slot(keys), np.uint64(0xFFFFFFFFFFFFFFFF)
        self.key, self.value = np.full(1 << self.bits, unset), np.zeros(1 << self.bits, np.float32)
        self.key[slot], self.value[slot] = keys, values  # of keys that share a slot the last stays; others are searched for
        self.floor = np.log(1 / 256)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _find(table: tuple | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None or not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]

    def of(self, windows: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum over the windows that this part can score, and the others."""
        slot = self._slot(windows)
        miss = self.key[slot] != windows
        total = float(self.value[slot[~miss]].astype(np.float64).sum())
        if not miss.any():
            return total, windows[:0]
        rare, back = np.unique(windows[miss], return_inverse=True)
        p, known = self._slow(rare)
        return total + float(p[back][known[back]].sum()), windows[miss][~known[back]]

    def _slow(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, known, left = np.zeros(len(w)), np.ones(len(w), bool), np.arange(len(w))
        for n in range(self.order, 0, -1):
            keys = w[left] & np.uint64((1 << 8 * n) - 1)
            found, p = self._find(self.grams.get(n), keys)
            total[left[found]] += p[found]
            left, keys = left[~found], keys[~found]
            context = keys >> np.uint64(8)
            here, weight = self._find(self.contexts.get(n - 1), context)
            total[left] += np.where(here, weight, 0.0)
            if self.rest is not None:  # what isn't here may be in the rest
                other = self.rest.of(mark(n, keys)) | ~here & self.rest.of(mark(n + 15, context))
                known[left[other]] = False
                left = left[~other]
        total[left] += self.floor
        return total, known


def _scored(batches: Iterator[pa.RecordBatch], head: tuple, order: int) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(*head, order)
    for batch in sliced(batches, 128):
        sums, counts, rest = [], [], []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode("utf-8", "replace")
            total, others = 0.0, []
            for at in range(0, max(len(raw), 1), 1 << 20):
                w = keys_of(raw, order) if len(raw) <= 1 << 20 else keys_of(raw[max(at - order + 1, 0) : at + (1 << 20)], order)[(order - 1 if at else 0) :]
                some, unknown = scorer.of(w)
                total += some
                others.append(unknown)
            sums.append(total)
            counts.append(len(raw) + 1)
            rest.append(np.concatenate(others).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rest)]), pa.int32()), pa.array(np.concatenate(rest)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sums), pa.array(counts), lists], ["doc_id", *batch.schema.names[2:], "logp", "n_bytes", "rest"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, extra..., perplexity): a row for each row of ``docs``; per byte, the closing line end included.

    ``shard_rows`` bounds what of the model is broadcast and changes no result.
    """
    keep = [F.col(c).alias(f"x{i}") for i, c in enumerate(extra)]
    kinds = "".join(f"x{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(extra))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    least, order = model.least_count(shard_rows), model.order
    head = rows.sparkSession.sparkContext.broadcast((*model.head(least), model.rest(least) if least else None))
    out = map_arrow(rows, lambda it: _scored(it, head.value, order), f"doc_id long, {kinds}logp double, n_bytes long, rest array<long>")
    if least:
        out = checkpoint(out).withColumn("_row", F.monotonically_increasing_id())  # rows of a checkpoint keep their numbers
        asked = out.select("_row", F.explode("rest").alias("w")).groupBy("_row", "w").agg(F.count(F.lit(1)).alias("times"))
        windows = asked.groupBy("w").agg(F.count(F.lit(1)).alias("m"))
        known = checkpoint(model.joined(windows.drop("m")))
        known = known.join(windows.withColumnRenamed("w", "_m"), F.col("w") == F.col("_m")).select(F.col("w").alias("_w"), F.col("logp").alias("_p"), "m")
        total = asked.count()
        more = join_counted(asked, known, [("w", "_w")], "m", total).groupBy(F.col("_row").alias("_r")).agg(F.sum(F.col("times") * F.col("_p")).alias("_more"))
        out = out.join(more, F.col("_row") == F.col("_r"), "left").withColumn("logp", F.col("logp") + F.coalesce("_more", F.lit(0.0)))
    return out.select("doc_id", *[F.col(f"x{i}").alias(c) for i, c in enumerate(extra)], F.exp(-F.col("logp") / F.col("n_bytes")).alias("perplexity"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep), a row for each row of ``docs``.

    Trusted documents are those with a label of quality 1 (several labels of an
    id must agree). Null texts count as empty, a null language is a language of
    its own; very long texts are read whole, in runs. A language none of whose
    trusted documents calibrates takes the threshold of all; a corpus without
    any keeps everything. Rows that repeat an id are scored one by one; a
    perplexity that equals the threshold stays. An empty table gives an empty
    result. Other columns play no part, whatever their names.
    """
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("_q")).filter("_q = 1").select("_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(lang_col).isNull().alias("no_lang"))
    marks = rows.select("doc_id").join(good, F.col("doc_id") == F.col("_id"), "left_semi").distinct()
    marked = _marked(rows, marks)
    aside = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(CALIBRATING)) == 0
    model = train(marked.filter(F.col("_good") & ~aside).select("text"), order)
    scored = checkpoint(score(marked, model, "doc_id", "text", shard_rows, ("lang", "no_lang", "_good")))
    trusted = scored.filter(F.col("_good") & aside)
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = trusted.groupBy(F.col("lang").alias("_l"), F.col("no_lang").alias("_n")).agg(cut.alias("_t"))
    overall = trusted.agg(cut.alias("_all"))
    out = scored.join(by_lang, (F.col("lang") == F.col("_l")) & (F.col("no_lang") == F.col("_n")), "left").crossJoin(F.broadcast(overall))
    threshold = F.coalesce("_t", "_all")
    return out.select("doc_id", F.when(~F.col("no_lang"), F.col("lang")).alias("lang"), "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"))


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Add _good. Texts don't shuffle: the ids go into bitmaps of 32,768 ids each, which are joined by range."""
    at = F.floor(F.coalesce("doc_id", F.lit(0)) / 32768)
    bits = marks.select(F.floor(F.col("doc_id") / 32768).alias("_b"), F.pmod(F.col("doc_id"), F.lit(32768)).alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_bits"))
    n = bits.count()
    bits = F.broadcast(bits) if n <= 4096 else bits  # 16 MB at most
    p = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(32768))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    good = F.coalesce(F.call_function("shiftright", byte, (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    return rows.withColumn("_at", at).join(bits, F.col("_at") == F.col("_b"), "left").withColumn("_good", good).drop("_at", "_b", "_bits")
