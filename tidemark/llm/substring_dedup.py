"""Substring deduplication by paragraph MinHash banding.

Paragraphs are lines of at least ``LEAST_WORDS`` words. Equal ones are one
node. Nodes that share a band of their MinHash signature collide; bands are
tuned to the recall wanted at the threshold. Colliding nodes whose sketches
could reach the threshold are linked, and of each component of links the pairs
that share a band are verified by the exact Jaccard similarity of their word
shingles. Components of verified pairs are what is cut: the first paragraph of
each stays, all others go.

A passage pasted inside a paragraph leaves the paragraphs around it unlike, so
there are paragraphs cut by content too: of every ``WINDOW`` successive grams
of ``GRAM`` words, across lines, the one of least hash. A text's anchors are
such grams, and two texts that share ``GRAM + WINDOW - 1`` words in a row share
an anchor of them. Grams are compared exactly, so there is nothing to band: an
anchor that an earlier document has goes, with the words before and after it
for as long as both texts agree. Neighbouring anchors overlap or touch, so a
repeated passage goes as one span.

Texts are read three times: for signatures and anchors' hashes, which fill
filters of bounded size; for anchors and lines that the filters may hold; and
for the words around the ends of runs of anchors that go. What shuffles of an
anchor is its hash and its place alone. Order is by doc_id, then by the hash of
the text, then by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Held, checkpoint, connected_components, filter_bits, join_counted, map_arrow, member_filter, repeats, sliced
from tidemark.llm.ngram_join import SKETCH, in_blocks, linked, most_unlike, sketches, verified
from tidemark.llm.shingles import SHINGLE, MinHash, mix

THRESHOLD, TARGET = 0.8, 0.995
LEAST_WORDS = 25  # at least a shingle's
#: Words of an anchor, and of how many successive grams one is an anchor; no more than ``GRAM``, so that neighbours touch.
GRAM, WINDOW = 13, 13


def tune_bands(threshold: float = THRESHOLD, target: float = TARGET, most: int = 32) -> tuple[int, int]:
    """(bands, rows): the most selective bands that reach the target at the threshold with at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= target), None)
        if bands:
            best = (bands, rows)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): a 64-bit key of each band, the band's number in it."""
    s = sig.reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j].astype(np.uint64))
    return out


class Chars:
    """Words of many texts at once: where they are and their hashes, from arrays of code points.

    A word's hash is the sum of its code points' random numbers times powers of
    an odd number, which prefix sums give for all words: those up to the word's
    end, less those before it, times the inverse of the power at its start.
    """

    _STEP = 0x9E3779B97F4A7C15

    def __init__(self):
        self.white = np.zeros(0x110000, bool)
        self.white[[c for c in range(0x3001) if chr(c).isspace()]] = True  # no code point beyond is
        self.code = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            grown = [np.full(n + n // 2, x % (1 << 64), np.uint64) for x in (self._STEP, pow(self._STEP, -1, 1 << 64))]
            for x in grown:
                x[0] = 1
            self.power, self.inverse = (np.multiply.accumulate(x) for x in grown)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, starts, ends of words)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        white = np.ones(len(points) + 2, bool)
        white[1:-1] = self.white[points]
        edges = np.nonzero(white[1:] != white[:-1])[0]
        return points, edges[::2], edges[1::2]

    def hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(points))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code[points] * self.power[: len(points)], dtype=np.uint64)])
        return mix((total[ends] - total[starts]) * self.inverse[starts])

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of a text's shingles, in order and with repeats."""
        w = self.hashes(*self.spans(text.lower()))
        return run_hashes(w, min(SHINGLE, len(w))) if len(w) else w


class _Read:
    """Words of several texts in one array, and the lines of at least ``least`` words."""

    def __init__(self, texts: list[str | None], chars: Chars, least: int):
        self.all = "\n".join(t or "" for t in texts)
        points, self.starts, self.stops = chars.spans(self.all)
        low = self.all.lower()
        # lower case may be longer, but has the same words
        self.hashes = chars.hashes(*(chars.spans(low) if low != self.all else (points, self.starts, self.stops)))
        self.begin = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.starts, self.begin)  # each text's first word
        self.sizes, self.ends = np.diff(self.first), self.first[1:]
        cuts = np.nonzero(points == 10)[0]
        line_starts, line_ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(points)]])
        lo, hi = np.searchsorted(self.starts, line_starts), np.searchsorted(self.starts, line_ends)
        long = hi - lo >= least
        self.line_starts, self.line_ends, self.lo, self.hi = (x[long] for x in (line_starts, line_ends, lo, hi))
        self.line_text = np.searchsorted(self.begin, self.line_starts, side="right") - 1
        self.nodes = [xxhash.xxh128_digest(self.hashes[x:y].tobytes()) for x, y in zip(self.lo.tolist(), self.hi.tolist())]

    def lines(self) -> list[np.ndarray]:
        """(start, end, words before, words) of the lines in their texts."""
        at = self.begin[self.line_text]
        return [x.astype(np.int32) for x in (self.line_starts - at, self.line_ends - at, self.lo - self.first[self.line_text], self.hi - self.lo)]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, counts) of the lines' shingles."""
        every, counts = run_hashes(self.hashes, SHINGLE), self.hi - self.lo - SHINGLE + 1
        at = np.arange(int(counts.sum())) + np.repeat(self.lo - (np.cumsum(counts) - counts), counts)
        return every[at], counts

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, gram, text): where in the array of all words anchors start, their hashes, and which texts they are in."""
        none = np.empty(0, np.int64)
        if len(self.hashes) < GRAM + WINDOW - 1:
            return none, none.view(np.uint64), none
        gram = run_hashes(self.hashes, GRAM)
        at = least_at(gram, WINDOW)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)  # of each word
        whole = np.arange(len(at)) + GRAM + WINDOW - 1 <= self.ends[text[: len(at)]]  # windows within one text
        place = np.unique(at[whole])
        return place, gram[place], text[place]


def short_of(gram: np.ndarray) -> np.ndarray:
    """What of a gram's hash goes into the filter: 31 bits."""
    return (gram >> np.uint64(33)).astype(np.int32)


def _offsets(of: np.ndarray, rows: int) -> np.ndarray:
    """Where the lists of rows end, for items that know their row."""
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)


def _list(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int, least: int) -> Iterator[pa.RecordBatch]:
    """A row for each row: hashes of its anchors, and its paragraphs with nodes, bands and sketches."""
    chars, minhash = Chars(), MinHash(SKETCH, seed=2)
    for batch in sliced(batches, 128):
        read = _Read(batch.column(1).to_pylist(), chars, least)
        _, gram, text = read.anchors()
        sig = minhash.flat(*read.shingles())
        at, sketch = _offsets(read.line_text, batch.num_rows), sketches(sig).view(np.int64)
        keys = band_keys(sig[:, : bands * rows], bands, rows).view(np.int64)
        columns = [batch.column(0), batch.column(2), _list(_offsets(text, batch.num_rows), short_of(gram)), *[_list(at, x) for x in read.lines()]]
        columns += [_list(at, pa.array(read.nodes, pa.binary())), _list(at * bands, keys.ravel()), *[_list(at, sketch[:, k]) for k in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)


_NAMES = ["o", "th", "grams", "start", "end", "before", "n_words", "node", "bands", "s0", "s1"]
_SIGNED = "o long, th long, grams array<int>, start array<int>, end array<int>, before array<int>, n_words array<int>, node array<binary>, bands array<long>, s0 array<long>, s1 array<long>"


def _met(batches: Iterator[pa.RecordBatch], keys: Held, bands: int) -> Iterator[pa.RecordBatch]:
    """A row for each band of a line that the filter may hold."""
    for batch in batches:
        node, s0, s1, key = (batch.column(c).flatten() for c in range(4))
        at = np.nonzero(keys.of(key.to_numpy(zero_copy_only=False)))[0]
        of = pa.array(at // bands)
        yield pa.RecordBatch.from_arrays([node.take(of), s0.take(of), s1.take(of), key.take(pa.array(at))], ["node", "s0", "s1", "key"])


_LINES = "o long, th long, start int, end int, before int, n_words int, node binary, short long"


def _lines(batches: Iterator[pa.RecordBatch], shorts: Held) -> Iterator[pa.RecordBatch]:
    """A row for each line whose node's number the filter may hold."""
    names = ["o", "th", "start", "end", "before", "n_words", "node", "short"]
    for batch in batches:
        lists = [batch.column(c).flatten() for c in range(2, 8)]
        at = np.nonzero(shorts.of(lists[-1].to_numpy(zero_copy_only=False)))[0]
        ends = np.cumsum(batch.column(7).value_lengths().to_numpy(zero_copy_only=False))
        of = pa.array(np.searchsorted(ends, at, side="right"))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in (0, 1)], *[x.take(pa.array(at)) for x in lists]], names)


def run_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` successive ones, by doubling."""
    m = len(w) - n + 1
    if m < 1:
        return np.empty(0, np.uint64)
    out, done, power, span = np.full(m, n, np.uint64), 0, w, 1
    while True:
        if n & span:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + power[done : done + m])
            done += span
            if done == n:
                return out
        power = mix(power[:-span] * np.uint64(0x9E3779B97F4A7C15) + power[span:])
        span *= 2


def least_at(x: np.ndarray, n: int) -> np.ndarray:
    """Where the least of each ``n`` successive ones is, the first of equal ones."""
    at, span = np.arange(len(x)), 1

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while 2 * span <= n:
        at, span = less(at[:-span], at[span:]), 2 * span
    return less(at[: len(at) - (n - span)], at[n - span :])


def _context(read: _Read, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, steps) of anchors.

    ``hashes`` has two bytes of each of the words before an anchor, nearest
    first, and of those after it, 0 where the text has none. ``steps`` has the
    code points from word to word, 255 where there are more.
    """
    j = np.arange(WINDOW)
    before, after = place[:, None] - 1 - j, place[:, None] + GRAM + j
    there = np.concatenate([before >= read.first[text][:, None], after < read.ends[text][:, None]], 1)
    word = np.where(there, np.concatenate([before, after], 1), 0)
    hashes = np.where(there, read.hashes[word] % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)
    last = len(read.starts) - 1
    back = read.starts[np.minimum(word[:, :WINDOW] + 1, last)] - read.starts[word[:, :WINDOW]]
    on = read.stops[word[:, WINDOW:]] - read.stops[np.maximum(word[:, WINDOW:] - 1, 0)]
    steps = np.where(there, np.minimum(np.concatenate([back, on], 1), 255), 255).astype(np.uint8)
    return hashes, steps


def _blobs(x: np.ndarray) -> pa.Array:
    """Rows of bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _again(batches: Iterator[pa.RecordBatch], grams: Held, nodes: Held, least: int) -> Iterator[pa.RecordBatch]:
    """A row for each text: its anchors that the one filter may hold, and lines whose node the other may hold, each line once a partition, nearly."""
    chars = Chars()
    seen: set[bytes] = set()
    for batch in sliced(batches, 128):
        read = _Read(batch.column(1).to_pylist(), chars, least)
        place, gram, text = read.anchors()
        hit = grams.of(short_of(gram))
        place, gram, text = place[hit], gram[hit], text[hit]
        at = _offsets(text, batch.num_rows)
        lines: list[list] = [[] for _ in range(batch.num_rows)]
        wanted = nodes.of(np.array([int.from_bytes(k[:7], "big") for k in read.nodes], np.int64))
        for i in np.nonzero(wanted)[0].tolist():
            if read.nodes[i] not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(read.nodes[i])
                lines[read.line_text[i]].append({"node": read.nodes[i], "text": read.all[read.line_starts[i] : read.line_ends[i]]})
        columns = [batch.column(0), batch.column(2), _list(at, gram.view(np.int64)), _list(at, (place - read.first[text]).astype(np.int32))]
        columns += [pa.array(lines, pa.list_(pa.struct([("node", pa.binary()), ("text", pa.string())])))]
        yield pa.RecordBatch.from_arrays(columns, ["o", "th", "gram", "word", "lines"])


_AGAIN = "o long, th long, gram array<long>, word array<int>, lines array<struct<node: binary, text: string>>"
_PLACE = 2654435761


def _located(batches: Iterator[pa.RecordBatch], ends: Held, origins: Held, least: int) -> Iterator[pa.RecordBatch]:
    """A row for each anchor that one of the filters may hold, by document and word: where it is, what is around it, and which filter it was."""
    chars = Chars()
    for batch in sliced(batches, 128):
        read = _Read(batch.column(1).to_pylist(), chars, least)
        place, _, text = read.anchors()
        o, th = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in (0, 2))
        word = place - read.first[text]
        at = o ^ th ^ word * _PLACE
        is_end, is_origin = ends.of(at), origins.of(at)
        hit = is_end | is_origin
        o, th, word, place, text, is_end, is_origin = (x[hit] for x in (o, th, word, place, text, is_end, is_origin))
        near, steps = _context(read, place, text)
        begin = read.begin[text]
        columns = [pa.array(x) for x in (o, th, word, read.starts[place] - begin, read.stops[place + GRAM - 1] - begin)]
        columns += [_blobs(near), _blobs(steps), pa.array(is_end), pa.array(is_origin)]
        yield pa.RecordBatch.from_arrays(columns, ["o", "th", "word", "start", "end", "hashes", "steps", "is_end", "is_origin"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a document that go, to runs of those that touch: the anchors from which an end may move on, one for each text and place that it repeats."""
    for batch in sliced(batches):
        out = []
        for o, th, anchors in zip(*(c.to_pylist() for c in batch.columns)):
            runs: list[list[dict]] = []
            for x in sorted(anchors, key=lambda x: (x["word"], x["ko"])):
                if not runs or x["word"] > runs[-1][-1]["word"] + GRAM:
                    runs.append([])
                runs[-1].append(x)
            for run in runs:
                first, last = run[0]["word"], run[-1]["word"]
                for left, near in ((True, [x for x in reversed(run) if x["word"] < first + WINDOW]), (False, [x for x in run if x["word"] > last - WINDOW])):
                    for x in {(x["ko"], x["kth"], x["word"] - x["kword"]): x for x in near}.values():  # the outermost of each
                        out.append((o, th, x["word"], x["ko"], x["kth"], x["kword"], first, last, left))
        columns = list(zip(*out)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == 8 else pa.int64()) for k, c in enumerate(columns)], ["o", "th", "word", "ko", "kth", "kword", "first", "last", "left"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends of runs with the words beyond them on which both texts agree: a span for each, which knows where it starts or where it stops, else -1."""
    for batch in sliced(batches, 4096):
        o, th, at, first, last, left, keep, start, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(9))
        own, other, steps = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(-1, 2 * WINDOW) for c, t in ((9, np.uint16), (10, np.uint16), (11, np.uint8)))
        agree = (own == other) & (own > 0) & (steps < 255)
        agree = np.where(left[:, None], agree[:, :WINDOW], agree[:, WINDOW:])
        steps = np.where(left[:, None], steps[:, :WINDOW], steps[:, WINDOW:])
        agree = np.cumprod(agree, axis=1, dtype=np.int64)
        more, further = agree.sum(1), (agree * steps).sum(1)
        word, stop = np.where(left, np.minimum(first, at - more), first), np.where(left, last + GRAM, np.maximum(last, at + more) + GRAM)
        start, end = np.where(left & (at - more <= first), start - further, -1), np.where(~left & (at + more >= last), end + further, -1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (o, th, start, end, word, stop - word, keep)], ["o", "th", "start", "end", "word", "n_words", "keep"])


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Spans of a document to runs, joined where they overlap or touch."""
    for batch in sliced(batches):
        out = []
        for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            runs: list[list[int]] = []
            for x in sorted(spans, key=lambda s: (s["word"], s["start"] < 0, -s["n_words"], s["keep"])):
                last = x["word"] + x["n_words"]
                if not runs or x["word"] > runs[-1][4]:
                    runs.append([x["start"], -1, x["word"], x["keep"], last, -1])
                run = runs[-1]
                run[3], run[4] = min(run[3], x["keep"]), max(run[4], last)
                if x["end"] >= 0 and last > run[5]:
                    run[1], run[5] = x["end"], last
            out += [(doc, r[0], r[1], r[4] - r[2], r[3]) for r in runs if r[4] - r[2] >= least]
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["o", "start", "end", "n_words", "keep"])


def banded(bands: int, rows: int):
    """A function from shingle sets to their band keys."""
    held: list[MinHash] = []

    def keys(sets: list[np.ndarray]) -> np.ndarray:
        if not held:
            held.append(MinHash(SKETCH, seed=2))
        return band_keys(held[0].of(sets)[:, : bands * rows], bands, rows)

    return keys


def _start_of(node: str) -> Column:
    """The first 7 bytes of a node as a number."""
    return F.conv(F.hex(F.substring(node, 1, 7)), 16, 10).cast("long")


#: What stands for a null id in the order; an id of this value is the same document as those without.
_NULL_ID = -(1 << 63)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, keep_doc_id): spans to cut, in code points, end exclusive.

    A document is an id and a text. Paragraphs that equal an earlier one, of
    the same document or another, or are near it, are cut whole. Passages of
    ``least`` words or more that an earlier document has are cut; where one
    ends is found to a word, but for one end in 65,535, which is a word too far.
    Passages of several earlier documents that touch are one span. ``keep_doc_id`` is a document whose copy stays: the least of those
    whose text the span repeats. Null ids come before others; null and empty
    texts have no spans; very long texts are read whole. Rows that repeat an id
    and a text are one document: what they have in common with each other
    alone is cut from neither, and other spans are given once. Equal hashes of
    texts decide no tie but of order. An empty table gives an empty result;
    other columns play no part, whatever their names.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("o"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    bands, rows = tune_bands(threshold)
    parts = checkpoint(map_arrow(source, lambda it: _signed(it, bands, rows, least), _SIGNED))
    sizes = parts.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)), F.coalesce(F.sum(F.size("node")), F.lit(0))).first()
    n_grams, n_lines = sizes

    # paragraphs: nodes are equal words; those whose bands collide are linked where their sketches allow it
    # filters go to tasks in Python, one after the other, and are destroyed once used: the driver holds one or two at a time
    spark = source.sparkSession.sparkContext
    bits = filter_bits(n_lines * bands)
    met = spark.broadcast(Held(repeats(parts.select("bands"), bits), bits))
    of = map_arrow(parts.select("node", "s0", "s1", "bands"), lambda it: _met(it, met.value, bands), "node binary, s0 long, s1 long, key long")
    likely = checkpoint(of.select("key", F.lit(0).cast("long").alias("deep"), F.xxhash64("node").alias("short"), "s0", "s1").distinct())
    met.destroy()
    comps = checkpoint(connected_components(linked(likely, n_lines * bands, 0, most_unlike(threshold))).withColumnRenamed("node", "_n"))
    # lines that have a copy, or a link: nodes of other lines have no part in what follows
    bits = filter_bits(n_lines)
    shorts = F.transform("node", lambda x: F.xxhash64(x)).alias("short")
    again_or_linked = spark.broadcast(Held(repeats(parts.select(shorts), bits).unionByName(member_filter(comps, F.col("_n"), bits, 1)), bits))
    every = parts.select("o", "th", "start", "end", "before", "n_words", "node", shorts)
    lines = map_arrow(every, lambda it: _lines(it, again_or_linked.value), _LINES)
    first = F.min(F.struct("o", "th", "start"))
    nodes = checkpoint(lines.groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), (F.max("n_words") - SHINGLE + 1).cast("long").alias("n_shingles")).withColumn("short", F.xxhash64("node")))
    again_or_linked.destroy()
    members = checkpoint(comps.join(nodes.select("node", "short", "n_shingles"), F.col("_n") == F.col("short")).select("component", "node", "n_shingles"))
    members = checkpoint(in_blocks(members, n_lines))

    # the texts once more, for anchors that two documents may have and for lines of linked nodes
    gram_bits, node_bits = filter_bits(n_grams), filter_bits(n_lines)
    grams = spark.broadcast(Held(repeats(parts.select("grams"), gram_bits), gram_bits))
    known = spark.broadcast(Held(member_filter(members, _start_of("node"), node_bits, 1), node_bits))
    again = checkpoint(map_arrow(source, lambda it: _again(it, grams.value, known.value, least), _AGAIN))
    grams.destroy()
    known.destroy()
    texts = again.select(F.explode("lines").alias("p")).groupBy("p.node").agg(F.min("p.text").alias("text")).withColumnRenamed("node", "_n")
    asked = texts.join(members, F.col("_n") == F.col("node")).withColumn("copies", F.lit(1))
    n_dealt = members.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    near = checkpoint(verified(asked, n_dealt, threshold, banded(bands, rows), shingles_of=Chars))
    near = connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("_n"), F.col("component").alias("root"))

    # paragraphs that go: all of a root but the first
    nodes = nodes.join(near, F.col("node") == F.col("_n"), "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    roots = nodes.groupBy("root").agg(F.min("first").alias("keep"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).filter("all > 1").withColumnRenamed("root", "_r")
    kept = checkpoint(join_counted(nodes, roots, [("root", "_r")], "m", n_lines).select(F.col("node").alias("_n"), "keep", "n"))
    kept_bits = filter_bits(4 * n_lines)
    stays = spark.broadcast(Held(member_filter(kept, F.xxhash64("_n"), kept_bits, 1), kept_bits))
    maybe = map_arrow(every, lambda it: _lines(it, stays.value), _LINES)
    gone = join_counted(maybe, kept, [("node", "_n")], "n", n_lines).filter(F.struct("o", "th", "start") > F.col("keep"))
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    gone = gone.select("o", "th", *long("start", "end"), F.col("before").cast("long").alias("word"), *long("n_words"), F.col("keep.o").alias("keep"))

    # anchors that go: all but the first document's
    each = again.select("o", "th", F.explode(F.arrays_zip("gram", "word")).alias("a")).select("o", "th", "a.gram", "a.word")
    origin = F.struct("o", "th")
    keepers = each.groupBy("gram").agg(F.min(F.struct("o", "th", "word")).alias("k"), F.max(origin).alias("last"), F.count(F.lit(1)).alias("n"))
    keepers = keepers.filter(F.col("last") > F.struct(F.col("k.o"), F.col("k.th"))).select(F.col("gram").alias("_g"), F.col("k.o").alias("ko"), F.col("k.th").alias("kth"), F.col("k.word").alias("kword"), "n")
    pasted = join_counted(each, keepers, [("gram", "_g")], "n", n_grams).filter(origin > F.struct("ko", "kth"))
    pasted = pasted.groupBy("o", "th").agg(F.collect_set(F.struct("word", "ko", "kth", "kword")).alias("anchors"))
    ends = checkpoint(map_arrow(pasted, _chained, "o long, th long, word long, ko long, kth long, kword long, first long, last long, left boolean"))

    # what is around the ends of runs, in both texts
    n_ends = ends.count()
    end_bits = filter_bits(n_ends)
    place = lambda o, th, word: F.col(o).bitwiseXOR(F.col(th)).bitwiseXOR(F.col(word) * _PLACE)
    held = [spark.broadcast(Held(member_filter(ends, place(*at), end_bits, 1), end_bits)) for at in (("o", "th", "word"), ("ko", "kth", "kword"))]
    around = map_arrow(source, lambda it: _located(it, held[0].value, held[1].value, least), "o long, th long, word long, start long, end long, hashes binary, steps binary, is_end boolean, is_origin boolean")
    around = checkpoint(around)
    for x in held:
        x.destroy()
    there = ends.groupBy("ko", "kth", "kword").agg(F.count(F.lit(1)).alias("n"))
    origins = around.filter("is_origin").select(F.col("o").alias("_o"), F.col("th").alias("_th"), F.col("word").alias("_w"), F.col("hashes").alias("other"))
    # rows that repeat an id and a text are met once as an origin; as ends their equal spans are one in the end
    there = there.join(origins, (F.col("ko") == F.col("_o")) & (F.col("kth") == F.col("_th")) & (F.col("kword") == F.col("_w"))).groupBy("_o", "_th", "_w").agg(F.first("other").alias("other"), F.first("n").alias("n"))
    ends = join_counted(ends, there, [("ko", "_o"), ("kth", "_th"), ("kword", "_w")], "n", n_ends).join(around.filter("is_end").drop("is_end", "is_origin"), ["o", "th", "word"])
    pasted = map_arrow(ends.select("o", "th", "word", "first", "last", "left", F.col("ko").alias("keep"), "start", "end", "hashes", "other", "steps"), _extended, "o long, th long, start long, end long, word long, n_words long, keep long")

    span = F.struct("start", "end", "word", "n_words", "keep")
    cut = gone.unionByName(pasted).groupBy("o", "th").agg(F.collect_set(span).alias("spans"))
    out = map_arrow(cut.select("o", "spans"), lambda it: _merged(it, least), "o long, start long, end long, n_words long, keep long")
    back = lambda c, name: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(name)
    return out.select(back("o", "doc_id"), "start", "end", "n_words", back("keep", "keep_doc_id"))
