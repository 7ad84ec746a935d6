"""Toxicity by gradient-boosted trees over dense features of whole texts.

Features: densities of a lexicon of words and of word beginnings, the nearness
of second-person words to lexicon words, capitals, punctuation, and obfuscation
(lexicon words that show only once look-alike characters are undone, symbols
and digits inside words, runs of one character).

The lexicon is learned from labelled rows: a word or a beginning is in it when
it is many times as frequent in toxic rows as in others. Rows of the training
sample get features from the lexicon of the other half of the sample, so the
trees don't trust words that merely occurred in a row. The margins of a model
that left a fifth of the rows out calibrate the scores.

Labels come from at most ``MAX_TRAIN`` rows (a documented bound: more labelled
rows are sampled by a hash of their id), all others are only scored. Labels,
language, source and id are never features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Isotonic, Trees
from tidemark.llm.common import map_arrow, sliced

MAX_TRAIN = 20_000
THRESHOLD = 0.7
#: A word is in the lexicon from this ratio of its rates in toxic and in other rows.
RATIO = 12.0
BEGINNINGS = (4, 5)
#: Pronouns and forms of address of the second person in the languages served: fixed values.
SECOND_PERSON = frozenset(x.encode() for x in "you your yours yourself u ur tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros du dich dir dein deine euch euer ihr sie".split())
FEATURES = ["lexicon", "lexicon_hits", "beginnings", "beginning_hits", "hidden", "second_near", "second_rate", "capitals", "shouted", "exclaims", "punctuation", "symbols", "digits_inside", "runs", "mean_length", "log_words"]

_PLAIN = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LOOKALIKE = dict(zip(b"013457@$!|", b"oleastasil"))
_UNDONE = bytes(_LOOKALIKE.get(c, c if 97 <= c <= 122 or c >= 128 or c in b" \n\t\r" else c + 32 if 65 <= c <= 90 else 32) for c in range(256))
_DROPPED = b"*.-_'`~^#"
_ODD = re.compile(rb"(.)\1\1")
_INSIDE = re.compile(rb"[a-z][0-9@$!|*]+[a-z]", re.I)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


def beginnings(word: bytes) -> list[bytes]:
    return [word[:k] + b"~" for k in BEGINNINGS if len(word) > k]


def features(texts: list[str | None], lexicon: frozenset[bytes]) -> np.ndarray:
    """A row for each text; null counts as empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    starts = frozenset(x[:-1] for x in lexicon if x.endswith(b"~"))
    plain = frozenset(x for x in lexicon if not x.endswith(b"~"))
    four, five = ({x for x in starts if len(x) == k} for k in BEGINNINGS)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        words = words_of(raw)
        n = max(len(words), 1)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
        known = Counter(words)
        hits = sum(c for w, c in known.items() if w in plain)
        begun = sum(c for w, c in known.items() if w not in plain and (w[:4] in four or w[:5] in five) and len(w) > 4)
        undone = 0
        if any(counts[c] for c in b"013457@$!|*.-_'`~^#"):
            undone = sum(c for w, c in Counter(raw.translate(_UNDONE, _DROPPED).split()).items() if w in plain and w not in known)
        near = second = 0
        if not SECOND_PERSON.isdisjoint(known):
            at = [j for j, w in enumerate(words) if w in SECOND_PERSON]
            second = len(at)
            if hits or begun:
                bad = np.array([j for j, w in enumerate(words) if w in plain or len(w) > 4 and (w[:4] in four or w[:5] in five)])
                where = np.searchsorted(bad, np.array(at) - 5)
                near = int((bad[np.minimum(where, len(bad) - 1)] <= np.array(at) + 5)[where < len(bad)].sum())
        marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
        shouted = sum(c for w, c in Counter(raw.split()).items() if len(w) > 2 and w.isupper()) if counts[65:91].sum() * 4 > letters else 0
        out[i] = (
            hits / n, min(hits, 20), begun / n, min(begun, 20), min(undone, 20), min(near, 20), second / n, counts[65:91].sum() / letters, shouted / n,
            counts[33] / n, marks / n, counts[[35, 36, 37, 38, 42, 64, 94]].sum() / n, min(len(_INSIDE.findall(raw)), 50) / n, len(_ODD.findall(raw)) / n, len(raw) / n, np.log1p(len(words)),
        )
    return out


def lexicon_of(rows: list[tuple[bytes, int, int]], toxic: int, clean: int) -> frozenset[bytes]:
    """Words with their counts of toxic and clean rows; the ratio needs a count that chance seldom gives."""
    least = max(3, round(0.002 * toxic))
    return frozenset(w for w, t, c in rows if t >= least and t / max(toxic, 1) >= RATIO * (c + 0.5) / max(clean, 1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, half, toxic rows, clean rows) of a partition; what has grown is handed on."""
    counts: dict[tuple[bytes, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], ["word", "half", "toxic", "clean"])
        counts.clear()
        return batch

    for batch in sliced(batches):
        for text, half, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = set(words_of((text or "").encode("utf-8", "replace")))
            for w in words | {b for w in words for b in beginnings(w)}:
                counts.setdefault((w, half), [0, 0])[0 if y else 1] += 1
        if len(counts) > 500_000:
            yield out()
    yield out()


def _featured(batches: Iterator[pa.RecordBatch], lexicons: tuple[frozenset, frozenset]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts, half = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
        x = np.zeros((len(texts), len(FEATURES)))
        for k in (0, 1):  # the other half's lexicon
            rows = np.nonzero(half == k)[0]
            x[rows] = features([texts[i] for i in rows], lexicons[1 - k])
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "part", "x"])


class Model:
    """Scores texts; small and free of Spark."""

    def __init__(self, lexicon: frozenset[bytes], trees: Trees | None, calibration: Isotonic | None, rate: float):
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        return self.calibration.of(self.trees.margin(features(texts, self.lexicon)))


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labelled rows that aren't held out. Several labels of an id count as toxic if one is; null labels are left out."""
    y = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("y"))
    share = max_train / max(y.count(), 1)
    h = F.xxhash64("_id", F.lit(11))
    if share < 1:
        y = y.filter(F.pmod(h, F.lit(1_000_000)) < int(share * 1_000_000))
    y = y.select("_id", "y", F.pmod(h, F.lit(2)).cast("int").alias("half"), F.pmod(F.xxhash64("_id", F.lit(12)), F.lit(5)).cast("int").alias("part"))
    # a sample within the bound: 20,000 rows are some 400 KB
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(y), F.col("_doc") == F.col("_id"))
    totals = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = ([totals.get((k, v), 0) for k in (0, 1)] for v in (1, 0))
    if not sum(toxic) or not sum(clean):
        return Model(frozenset(), None, None, 1.0 if sum(toxic) else 0.0)
    counts = map_arrow(rows.select("text", "half", "y"), _counted, "word binary, half int, toxic long, clean long")
    counts = counts.groupBy("word").agg(*[F.sum(F.when(F.col("half") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("toxic", "clean")])
    # only candidates come to the driver: words of three rows or more of the sample, so no more than it bounds, that are RATIO times as frequent in toxic rows
    t, c = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    likely = counts.filter((F.col("toxic0") >= 3) & (F.col("toxic0") / max(toxic[0], 1) >= RATIO * (F.col("clean0") + 0.5) / max(clean[0], 1)) | (F.col("toxic1") >= 3) & (F.col("toxic1") / max(toxic[1], 1) >= RATIO * (F.col("clean1") + 0.5) / max(clean[1], 1)) | (t >= 3) & (t / sum(toxic) >= RATIO * (c + 0.5) / sum(clean)))
    likely = [(bytes(r["word"]), r["toxic0"], r["clean0"], r["toxic1"], r["clean1"]) for r in likely.collect()]
    halves = tuple(lexicon_of([(r[0], r[1 + 2 * k], r[2 + 2 * k]) for r in likely], toxic[k], clean[k]) for k in (0, 1))
    full = lexicon_of([(r[0], r[1] + r[3], r[2] + r[4]) for r in likely], sum(toxic), sum(clean))
    sample = map_arrow(rows.select("text", "half", "y", "part"), lambda it: _featured(it, halves), "y int, part int, x array<double>").toPandas()
    x, y, part = np.array(sample["x"].tolist()), sample["y"].to_numpy(np.float64), sample["part"].to_numpy()
    order = np.lexsort([*x.T, y, part])  # rows arrive in any order
    x, y, part = x[order], y[order], part[order]
    margins = np.zeros(len(y))
    for k in np.unique(part):  # margins of each fifth by the trees of the others
        rest = part != k
        margins[~rest] = Trees().fit(x[rest], y[rest]).margin(x[~rest]) if 0 < y[rest].sum() < rest.sum() else 0.0
    return Model(full, Trees().fit(x, y), Isotonic().fit(margins, y), float(y.mean()))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        score = model.score(batch.column(batch.schema.get_field_index("_text")).to_pylist())
        columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], [f.name for f in batch.schema if f.name != "_text"] + ["score"])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    Null and empty texts are scored as texts without words, very long ones
    whole. A null id is not held out; rows that repeat an id are scored one by
    one, and a label of it trains with each. A score that equals the threshold
    counts as toxic. Without labels of both kinds every score is the rate of
    the one kind there is (0 without any). An empty table gives an empty
    result. Other columns play no part, whatever their names.
    """
    model = fit(docs, labels, max_train, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    scored = map_arrow(rows, lambda it: _scored(it, model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject.

    Nulls, empty and long texts, labels and an empty table go as in
    ``toxicity``; rows that repeat an id are scored one by one. Columns keep
    their names, whatever these are.
    """
    model = fit(docs, labels, max_train, id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col(text_col).alias("_text"))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(docs.columns, names))
    scored = map_arrow(rows, lambda it: _scored(it, model), f"{schema}, score double")
    return scored.filter(F.col("score") < threshold).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
