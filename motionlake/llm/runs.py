"""Periodic runs of words: every maximal stretch that repeats a period at least four times.

A run of period q and n words is a chain of n - q places where words q apart are equal, at least 3q of them. Periods are
taken by octave, q in [P, 2P), and each octave has a scale of its own:

* A grid of boundaries in steps of about P. A chain of the octave holds at least one boundary with a whole block of
  words behind it, and that block recurs q words on. Rolling hashes of blocks (doubled from octave to octave) find the
  boundaries where this may be so; a hash can only name too many.
* Tiles. Boundaries in question are exploded into tiles of the words around a stretch of the grid; neighbouring tiles
  overlap. Tiles are dealt out over all tasks, whatever document they come from, and solved on their own: the Z-function
  of the words from a boundary on tells for all periods at once how far the chain goes ahead, that of the reversed
  words how far it goes back, both as far as the tile's reach. Periods that repeat a shorter one go here.
* Stitching. Fragments meet by document and period; those that touch are one chain.

So a long document is spread over tasks, and most documents, which have no boundary in question, end after one look.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm.chunks import blocks
from motionlake.llm.common import Scratch, in_arrow, require_integer

#: Boundaries of the grid that one tile covers.
STRETCH = 32
_PLAIN, _OPEN, _TILE = 0, 1, 2  # kinds of rows that the first look writes
LOOK = "kind int, uid long, doc_id long, n long, digest string, octave int, start long, at array<int>, data binary"
FRAGMENT = "uid long, period long, start long, stop long"
FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def least_chain(period: int) -> int:
    """Equal places that a run of this period needs at least: max(6, 4 * period) words less one period."""
    return max(6, 4 * period) - period


def grid(octave: int) -> tuple[int, int, int]:
    """P, the step of boundaries and the words of a block. A chain of least_chain(P) places holds a boundary with a whole
    block: step + block - 1 is no more. Short periods take longer blocks, as short ones recur by chance."""
    p = 1 << octave
    if p == 1:
        return 1, 2, 4
    return (p, p, 2 * p) if p < 8 else (p, 2 * p, p)


def in_question(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Octaves, and the boundaries of each where a block may recur one period of the octave on; none is missed."""
    n = len(codes)
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    rolled, octave = {1: h}, 0
    while n >= max(6, 4 << octave):
        p, step, block = grid(octave)
        while block not in rolled:
            half = max(rolled)
            x = rolled[half]
            y = x[:-half] * np.uint64(0xBF58476D1CE4E5B9 + 2 * half) + x[half:]
            rolled[2 * half] = y ^ (y >> np.uint64(31))
        own = rolled[block]
        count = (len(own) - p - 1) // step + 1 if len(own) > p else 0
        if count > 0:
            ahead = np.zeros(count * step, np.uint64)
            there = own[p : p + count * step]
            ahead[: len(there)] = there
            hit = (ahead.reshape(count, step)[:, :p] == own[: count * step : step][:count, None]).any(1)
            if hit.any():
                yield octave, np.flatnonzero(hit) * step
        octave += 1
        rolled = {k: v for k, v in rolled.items() if k >= p}


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place before `upto` how many items from there on equal those from the start."""
    n = len(s)
    z = [0] * min(upto, n)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@functools.lru_cache(100_000)
def _divisions(q: int) -> tuple[int, ...]:
    """q over each of its prime factors."""
    found, rest, f = [], q, 2
    while f * f <= rest:
        if rest % f == 0:
            found.append(q // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return (*found, q // rest) if rest > 1 else tuple(found)


def solve_tile(words: list[int], octave: int, at: list[int]) -> Iterator[tuple[int, int, int]]:
    """Fragments (period, start, stop) of chains around boundaries `at`: whole ones that are long enough, and those that
    reach as far as the tile is asked to look, which go on elsewhere."""
    p, step, block = grid(octave)
    reach = step + block
    for b in at:
        ahead = words[b : b + reach + 2 * p - 1]
        z = z_function(ahead, min(2 * p, len(ahead)))
        periods = [q for q in range(p, len(z)) if z[q] >= block and not any(z[d] >= q - d for d in _divisions(q))]
        if not periods:
            continue
        far = min(step, b)
        back = words[b - far : b][::-1]
        stop = b + periods[-1]  # reversed text from the last word before the farthest copy
        text = words[b - far : stop][::-1]
        y = z_function([*back, -1, *text], far + 1 + stop - b) if far else []
        for q in periods:
            behind = min(far, y[far + 1 + (stop - b - q)]) if far else 0
            front = min(reach, z[q])
            if behind + front >= least_chain(q) or behind == step or front == reach:
                yield q, b - behind, b + front


def _look(change: Callable[[int | None, list[bytes]], list[bytes]] | None):
    """Words of each document, numbered within it; documents without a boundary in question are done at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in blocks(batch, "text"):
                rows: list[tuple] = []
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    words = (text or b"").split()  # at \x20 and \x09-\x0D
                    if change is not None and words:
                        words = change(doc, words)
                    known: dict[bytes, int] = {}
                    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                    joined, n, plain = b" ".join(words), len(words), True
                    for octave, boundaries in in_question(codes):
                        p, step, block = grid(octave)
                        plain = False
                        for some in np.split(boundaries, np.flatnonzero(np.diff(boundaries // (STRETCH * step))) + 1):
                            start = max(0, int(some[0]) - step)
                            data = codes[start : int(some[-1]) + step + block + 2 * p].astype("<i4").tobytes()
                            rows.append((_TILE, uid, doc, n, None, octave, start, (some - start).tolist(), data))
                    rows.append((_PLAIN, uid, doc, n, hashlib.sha256(joined).hexdigest(), None, None, None, None) if plain else (_OPEN, uid, doc, n, None, None, None, None, joined))
                    uid += 1
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in LOOK.split(", ")])

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for uid, octave, start, at, data in zip(*(batch.column(c).to_pylist() for c in ("uid", "octave", "start", "at", "data")), strict=True):
            words = np.frombuffer(data, "<i4").tolist()
            rows.extend((uid, q, start + lo, start + hi) for q, lo, hi in solve_tile(words, octave, at))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "period", "start", "stop"])


def stitch(fragments: DataFrame) -> DataFrame:
    """uid, start, length, period: fragments of a document and period that touch are one chain, and a run if it is long
    enough."""
    order = Window.partitionBy("uid", "period").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reached, 0).otherwise(1)
    chains = fragments.withColumn("_new", fresh).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = chains.groupBy("uid", "period", "_chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    return whole.select("uid", "start", length.alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(6), 4 * F.col("period")))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of (start, length, period) the one of the greatest length / period; ties: the smallest start, then period."""
    best = None
    for start, length, period in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, data, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "runs")), strict=True):
            own = sorted(((r["start"], r["length"], r["period"]) for r in runs or []), key=lambda r: (r[0], r[2]))
            best = best_run(own)
            listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest()
            kept = hashlib.sha256(b" ".join(collapse(data.split(b" "), own))).hexdigest()
            rows.append((doc, len(own), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, listed, kept))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.string()) for k, c in enumerate(columns)], names=[x.split()[0] for x in FOUND.split(", ")])


def _found(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What the first look wrote, and the runs of its documents."""
    require_integer(docs, "doc_id")
    looked = scratch.write(in_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), _look(change), LOOK), "runs-look")
    tiles = looked.where(F.col("kind") == _TILE).select("uid", "octave", "start", "at", "data").repartition("uid", "octave", "start")
    return looked, stitch(in_arrow(tiles, _solve, FRAGMENT))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run of every text: a row for each run. Words are what white space parts
    (\\x20, \\x09-\\x0D). Repeated ids have the runs of each of their rows; null and empty texts have none."""
    scratch = Scratch(docs.sparkSession)
    looked, runs = _found(docs, None, scratch)
    rows = scratch.write(looked.where(F.col("kind") == _OPEN).select("uid", "doc_id").join(runs, "uid").drop("uid"), "runs-of-words")
    scratch.drop(looked)
    return rows


def report(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """A row for each document: n_runs; start, length, period and exponent_milli of the run with the greatest length /
    period (ties: the smallest start, then period; nulls without a run); sha256 of all runs and of the words that are left
    when every run keeps its first period only.

    change: what becomes of a document's words before the search, by its id (null included). Null, empty and blank texts
    have no words and no runs. Repeated rows and rows without an id each give a row; an empty table gives none; other
    columns are ignored. A document is a row and has to fit a task; its tiles are spread.
    """
    scratch = Scratch(docs.sparkSession)
    looked, runs = _found(docs, change, scratch)
    listed = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # a document's own
    open_ = looked.where(F.col("kind") == _OPEN).select("uid", "doc_id", "data").join(listed, "uid", "left")
    none = F.lit(None).cast("long")
    plain = looked.where(F.col("kind") == _PLAIN).select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *(none.alias(c) for c in ("start", "length", "period", "exponent_milli")), F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256")
    )
    rows = scratch.write(plain.unionByName(in_arrow(open_.select("doc_id", "data", "runs"), _finish, FOUND)), "runs-report")
    scratch.drop(looked)
    return rows
