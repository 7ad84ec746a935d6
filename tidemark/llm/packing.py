"""Packing of tokenised documents into sequences by minimum bin slack.

A document's ids are cut into full windows, each a sequence of its own without
padding, and a remainder. Remainders of a batch fill windows one at a time: the
longest remaining length opens a window, and a subset-sum dynamic programme
over the multiset of remaining lengths, kept as the bits of one integer, finds
the set that comes closest to the capacity; the counts taken of each length are
read back through the steps of the programme. Lengths are tried from the
longest down until an exact fill is reached, all of them if none is.

What no exact fill takes waits for the next batch of the partition. At its end
the rest is cut into pieces that fill windows, and the last window's pieces
into sequences of powers of two, which need no padding. Partitions pack on
their own, so nothing shuffles; sequence ids carry the partition's number.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, sliced

WINDOW = 2048
END_ID = 1
#: Remainders that wait at once; beyond this the oldest windows are closed with what fits best.
WAITING = 4096

# Texts of these characters split alike in both libraries; others go to ``tokenizers`` whole.
_SAFE = re.compile("[\t\n\r -~¡§«°·»¿-ɏ‐-‧€]*")
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write bytes that don't print as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE file as little-endian unsigned 32-bit bytes.

    The file's own library is slow on words that it hasn't met, so ordinary
    texts are merged by ``tiktoken`` with ranks read from the same file; a byte
    pair's rank is its id there, so the ids are equal. Tests hold both to it.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in word): i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word not in special}
        self.merger = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        if not _SAFE.fullmatch(text) or self.special and self.special.search(text):
            return self.whole(text)
        return array("I", self.merger.encode_ordinary(text)).tobytes()


def best_fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to ``room`` from below.

    ``counts[n]`` pieces of length n remain. Bit s of ``reach`` is set when
    some choice sums to s; it stops at the first length that reaches the room.
    """
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for n in np.nonzero(counts[: room + 1])[0][::-1].tolist():
        for _ in range(min(int(counts[n]), room // n)):
            more = (reach | reach << n) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
            if reach & goal:
                break
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        if not before >> at & 1:
            taken[n] = taken.get(n, 0) + 1
            at -= n
    return taken


class Packer:
    """Pieces are (row, start, length); rows index what the caller holds."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.by_length: list[list] = [[] for _ in range(window + 1)]
        self.counts = np.zeros(window + 1, np.int64)
        self.waiting = 0
        self.out: list[tuple] = []

    def full(self, row, start: int) -> None:
        self.out.append((row, start, self.window, self.sequence, 0))
        self.sequence += 1

    def wait(self, row, start: int, length: int) -> None:
        self.by_length[length].append((row, start))
        self.counts[length] += 1
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.waiting -= 1
        return self.by_length[length].pop()

    def fill(self, floor: int) -> None:
        """Close exactly filled windows while more than ``floor`` pieces wait."""
        top = self.window
        while self.waiting > floor:
            while not self.counts[top]:
                top -= 1
            row, start = self._take(top)
            pieces = [(row, start, top)]
            room = self.window - top
            if room:
                chosen = best_fill(self.counts, room)
                for n, c in chosen.items():
                    pieces += [(*self._take(n), n) for _ in range(c)]
                room -= sum(n * c for n, c in chosen.items())
            while room:  # no exact fill: part of the shortest piece left, or the tail's rules
                left = np.nonzero(self.counts)[0]
                if not len(left):
                    break
                n = int(left[-1])
                row, start = self._take(n)
                used = min(n, room)
                pieces.append((row, start, used))
                if used < n:
                    self.wait(row, start + used, n - used)
                room -= used
            if room:
                self.powers(pieces)
            else:
                self.close(pieces)

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for row, start, n in pieces:
            self.out.append((row, start, n, self.sequence, offset))
            offset += n
        self.sequence += 1

    def powers(self, pieces: list[tuple]) -> None:
        """Less than a window: sequences of powers of two, the largest first."""
        total = sum(n for *_, n in pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            now = []
            while size:
                row, start, n = pieces.pop(0)
                used = min(n, size)
                now.append((row, start, used))
                if used < n:
                    pieces.insert(0, (row, start + used, n - used))
                size -= used
            self.close(now)


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(batches: Iterator[pa.RecordBatch], path: str, window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, packer = Encoder(path), Packer(window, TaskContext.get().partitionId() << 40)
    end = array("I", [END_ID]).tobytes()

    def written() -> pa.RecordBatch:
        out, packer.out = packer.out, []
        columns = [[], [], [], [], [], [], []]
        ids = []
        for (doc, base, raw, tokens), start, n, sequence, offset in out:
            piece = raw[4 * (start - base) : 4 * (start - base + n)]
            for c, v in zip(columns, (doc, start, n, zlib.crc32(piece), tokens, sequence, offset)):
                c.append(v)
            ids.append(piece)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    for batch in sliced(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = encoder.of(text or "") + end
            tokens = len(raw) // 4
            whole = tokens - tokens % window
            for start in range(0, whole, window):
                packer.full((doc, 0, raw, tokens), start)
            if whole < tokens:  # only the remainder's bytes wait
                packer.wait((doc, whole, raw[4 * whole :], tokens), whole, tokens - whole)
            if len(packer.out) > 5000:
                yield written()
            if packer.waiting > WAITING:
                packer.fill(WAITING // 2)
    packer.fill(0)
    yield written()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A null or empty text is its end id alone. Null ids and rows that repeat an
    id are packed like others, each row as a document; very long texts fill
    whole sequences of their own, and pieces of one length take their turns in
    the order of their rows. ``window`` is a power of two. An empty table gives
    an empty result. Other columns play no part, whatever their names.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, lambda it: _packed(it, path, window, with_ids), FIELDS + ", ids array<int>" * with_ids)
