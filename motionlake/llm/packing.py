"""Vector bin packing: examples placed into sequences under limits on tokens, segments and loss-bearing tokens.

An example is a row of ids; its first `prompt` ids bear no loss (instruction data), all others do. Sequences are filled
one at a time: of the examples that fit under all three limits, the one goes next whose demand points most along the room
that is left, the greatest dot product of both, each dimension divided by its limit and weighted by what all waiting
examples ask of it. Where examples may be cut, a gap that nothing fits is filled by a piece of one of them.

Every task packs the rows of its own partition from a pool of bounded size, so nothing is shuffled and no row waits for
another task. What a task has left over at its end is less than one sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from motionlake.llm.chunks import blocks
from motionlake.llm.common import in_arrow, require_integer
from motionlake.llm.planes import library_encoder

PIECES = "doc_id long, start long, length long, n_loss long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("all limits must be at least 1")


def place(tokens: np.ndarray, prompt: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, length). Every id of every example is in exactly one piece.

    Without `cut` examples stay whole, but for those that no empty sequence could hold: these are cut, never dropped. With
    `cut`, such examples fill sequences of their own first, so that gaps are filled from what is left of them.
    """
    start, left, plain = np.zeros(len(tokens), np.int64), np.array(tokens, np.int64), np.minimum(prompt, tokens).astype(np.int64)
    demand = np.array([left.sum() / limits.tokens, len(left) / limits.segments, (left - plain).sum() / limits.loss])
    weight = demand / max(demand.sum(), 1e-9)
    found: list[list[tuple[int, int, int]]] = []
    while left.any():
        made: list[tuple[int, int, int]] = []
        room, seats, lossy = limits.tokens, limits.segments, limits.loss

        def put(i: int, n: int) -> None:
            nonlocal room, seats, lossy
            made.append((i, int(start[i]), n))
            room, seats, lossy = room - n, seats - 1, lossy - max(0, n - int(plain[i]))
            start[i], left[i], plain[i] = start[i] + n, left[i] - n, max(0, plain[i] - n)

        while room and seats and left.any():
            loss = left - plain
            most = np.minimum(left, np.minimum(plain + lossy, room))  # what could be taken of each
            fits = (left > 0) & (most == left)
            huge = (left > limits.tokens) | (loss > limits.loss)
            if not made and huge.any():
                i = int(np.argmax(huge))
                put(i, int(most[i]))
            elif cut and (seats == 1 or not fits.any()):
                best = np.flatnonzero(most == most.max())
                i = int(best[left[best].argmax()])  # a piece of the longest, so that pieces stay long
                if not most[i]:
                    break
                put(i, int(most[i]))
            elif fits.any():
                # a segment is the same demand for all, so its term does not rank them
                score = weight[0] * room * left / limits.tokens**2 + weight[2] * lossy * loss / limits.loss**2
                i = int(np.argmax(np.where(fits, score, -1.0)))
                put(i, int(left[i]))
            else:
                break
        found.append(made)
    return found


def in_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same pieces, cut into sequences whose lengths are powers of two, so that none needs padding."""
    total = sum(n for _, _, n in pieces)
    found, queue = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need, made = total & (1 << bit), []
        while need:
            i, at, n = queue.pop()
            if n > need:
                queue.append((i, at + need, n - need))
                n = need
            made.append((i, at, n))
            need -= n
        if made:
            found.append(made)
    return found


class _Packer:
    """Pools examples and yields pieces; sequences are numbered from the task's own first number."""

    def __init__(self, limits: Limits, cut: bool, with_ids: bool, pool: int = 2048, ids: int = 1_000_000):
        self.limits, self.cut, self.with_ids, self.most, self.most_ids = limits, cut, with_ids, pool, ids
        self.next = TaskContext.get().partitionId() << 40
        self.pool: list[tuple[int | None, int, np.ndarray, int, int]] = []  # id, its ids before, ids, prompt, all its ids
        self.held = 0

    def add(self, doc: int | None, ids: np.ndarray, prompt: int) -> Iterator[pa.RecordBatch]:
        if len(ids):
            self.pool.append((doc, 0, ids, prompt, len(ids)))
            self.held += len(ids)
        if len(self.pool) >= self.most or self.held >= self.most_ids:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        sequences = place(np.array([len(x[2]) for x in self.pool], np.int64), np.array([x[3] for x in self.pool], np.int64), self.limits, self.cut)
        open_ = []
        if sequences and self.cut and sum(n for _, _, n in sequences[-1]) < self.limits.tokens and (last or len(sequences) > 1):
            open_ = sequences.pop()  # waits for more, or is cut into lengths that need no padding
        if open_ and last:
            sequences, open_ = [*sequences, *in_powers(open_)], []
        rows = []
        for made in sequences:
            offset = 0
            for i, at, n in made:
                doc, before, ids, prompt, total = self.pool[i]
                own = ids[at : at + n]
                crc = zlib.crc32(np.ascontiguousarray(own, "<u4").tobytes())
                rows.append((doc, before + at, n, max(0, n - max(0, prompt - at)), crc, total, self.next, offset, own if self.with_ids else None))
                offset += n
            self.next += 1
        kept = [(self.pool[i], at, n) for i, at, n in open_]
        self.pool = [(doc, before + at, ids[at : at + n].copy(), max(0, prompt - at), total) for (doc, before, ids, prompt, total), at, n in kept]
        self.held = sum(len(x[2]) for x in self.pool)
        if rows:
            columns = list(zip(*rows, strict=True))
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 8 else pa.list_(pa.int32())) for k, c in enumerate(columns)], names=names)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), cut: bool = True, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document's ids, encoded by the tokenizers library with end_id after each text.

    doc_id, start (the document's ids before the piece), length, n_loss, ids_crc32, doc_tokens (all ids of the document),
    sequence_id, offset (place in the sequence, gapless from 0) and, on demand, the ids. Every id bears loss. Null and
    empty texts are end_id alone; rows without an id and repeated rows are packed like any other; an empty table gives
    none; other columns are ignored. Sequence ids are unique, but not dense. A task's last sequence is cut into lengths
    that are powers of two, which need no padding.
    """
    require_integer(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = library_encoder(tokenizer, ordinary=False), _Packer(limits, cut, with_ids)
        for batch in batches:
            for piece in blocks(batch, "text", 6_000_000):
                ids, ends = encode(piece.column("text").to_pylist())
                start = 0
                for doc, end in zip(piece.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    yield from packer.add(doc, np.append(ids[start:end], end_id).astype(np.int32), 0)
                    start = end
        yield from packer.pack(last=True)

    packed = in_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, PIECES)
    return packed if with_ids else packed.drop("ids")


def pack_examples(examples: DataFrame, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """The same for instruction data that is encoded already: doc_id, ids (array<int>) and prompt, how many of the first
    ids bear no loss (null: none; more than there are: all). Null or empty ids give no piece. Examples that one sequence
    can't hold are cut in any case."""
    require_integer(examples, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(limits, cut, True)
        for batch in batches:
            for doc, ids, prompt in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "prompt")), strict=True):
                yield from packer.add(doc, np.array(ids or [], np.int32), max(0, prompt or 0))
        yield from packer.pack(last=True)

    rows = examples.select(examples["doc_id"].cast("long").alias("doc_id"), examples["ids"].cast("array<int>").alias("ids"), examples["prompt"].cast("int").alias("prompt"))
    return in_arrow(rows, run, PIECES)
