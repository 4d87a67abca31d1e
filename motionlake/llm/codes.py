"""Product codes of vectors: k-means on each part of the vectors, with norm-of-sum bounds instead of full scans.

Every vector keeps, for each part and each group of codebook entries, a lower bound of its distance to the entries of the
group but its own, and the round in which the bound was taken. All codebooks so far are kept. An entry that went from c(s)
to c(r) may have come nearer by no more than |c(r) - c(s)|, its true net displacement: never more than the sum of its
steps, and often much less, as steps turn back. So a group is scanned only where its bound, less the greatest net
displacement of its entries since the bound's round, no longer exceeds the exact distance to the vector's own entry.

Rounds are Spark jobs over a written table of vectors and bounds. Codebooks are bounded by entries, parts and rounds;
they and the sums for them are all that passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from motionlake.llm.common import Scratch, in_arrow, require_integer

#: Bounds are loosened by more than floating point can err; also the largest bound that is kept.
_SLACK, _MOST = 1e-6, 3e38


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry: hubs chosen farthest first, each entry with its nearest hub."""
    x = entries.astype(np.float64)
    group, near = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for g in range(min(groups, len(x))):
        hub = 0 if g == 0 else int(near.argmax())
        away = ((x - x[hub]) ** 2).sum(1)
        group[away < near] = g
        near = np.minimum(near, away)
    return group


def net_moves(history: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Groups x rounds: the greatest net displacement of a group's entries from each earlier codebook to the last."""
    last = history[-1].astype(np.float64)
    away = np.array([np.sqrt(((last - h.astype(np.float64)) ** 2).sum(1)) for h in history])
    return np.array([away[:, group == g].max(1) if (group == g).any() else np.zeros(len(history)) for g in range(groups)])


def _fine(x: np.ndarray, history: np.ndarray) -> type:
    """Doubles where all squared distances are exact in them, else integers of any size."""
    most = max(float(np.abs(x.astype(np.float64)).max(initial=0)), float(np.abs(history.astype(np.float64)).max(initial=0)))
    return np.float64 if 4 * most * most * max(x.shape[1], 1) < 2**53 else object


def assign(x: np.ndarray, history: np.ndarray, group: np.ndarray, groups: int, before: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For one part: each row's nearest entry of the last codebook (ties: the lower index), its squared distance, new
    bounds and their rounds, and how many (row, group) pairs were scanned. before: entry, bounds and rounds so far."""
    kind = _fine(x, history)
    x, c, now, n = x.astype(kind), history[-1].astype(kind), len(history) - 1, len(x)
    if before is None:
        own, best = np.full(n, -1), np.full(n, np.inf).astype(kind)
        low, stamp = np.zeros((n, groups)), np.zeros((n, groups), np.uint8)
        mine, held, need = best, low, np.ones((n, groups), bool)
    else:
        own, low, stamp = before[0].astype(np.int64), before[1].astype(np.float64), before[2].copy()
        mine = ((x - c[own]) ** 2).sum(1) if x.shape[1] else np.zeros(n).astype(kind)
        best = mine
        moves = net_moves(history, group, groups)
        held = low - moves[np.arange(groups)[None, :], stamp] * (1 + _SLACK)
        need = ~(held > np.sqrt(mine.astype(np.float64))[:, None] * (1 + _SLACK))
    entry, xx, cc = own.copy(), (x**2).sum(1), (c**2).sum(1)
    first, second, at = np.full((n, groups), np.inf), np.full((n, groups), np.inf), np.full((n, groups), -1)
    for g in range(groups):
        members, rows = np.flatnonzero(group == g), np.flatnonzero(need[:, g])
        if not len(members) or not len(rows):
            continue
        away = xx[rows][:, None] - 2 * (x[rows] @ c[members].T) + cc[members][None, :]
        pick = away.argmin(1)  # members ascend, so ties go to the lower index
        least = away[np.arange(len(rows)), pick]
        better = (least < best[rows]) | ((least == best[rows]) & (members[pick] < entry[rows]))
        best = best.copy() if best is mine else best
        best[rows[better]], entry[rows[better]] = least[better], members[pick][better]
        first[rows, g], at[rows, g] = least.astype(np.float64), members[pick]
        away[np.arange(len(rows)), pick] = np.inf
        second[rows, g] = away.min(1).astype(np.float64)
    # a scanned group's bound leaves out the row's own entry, whichever that is now
    fresh = np.sqrt(np.where(at == entry[:, None], second, first))
    bound = np.where(need, fresh, low)
    stamp = np.where(need, now, stamp).astype(np.uint8)
    left = np.flatnonzero((own >= 0) & (own != entry))  # the entry that was left counts in its group's bound again
    home = group[own[left]]
    back = ~need[left, home]
    left, home = left[back], home[back]
    bound[left, home] = np.minimum(held[left, home], np.sqrt(mine[left].astype(np.float64)))
    stamp[left, home] = now
    bound = np.clip(bound * (1 - _SLACK), 0.0, _MOST).astype(np.float32)
    return entry, best, bound, stamp, int(need.sum())


def integers(vectors: DataFrame, scale: int = 1024, column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v, floor(scale * component); null vectors and such with null or non-finite parts go. Components
    beyond 64 bits become the largest such number of their sign."""
    parts = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(column).isNotNull()).where(fine).select("vec_id", F.col(label).alias("label"), F.transform(parts, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = 16) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (binary, a byte for each part) and error of every row, and the codebooks: parts x entries x
    components of a part.

    vectors: vec_id, v (array of integers), label. Codebooks begin as the parts of the first `entries` rows in order of
    vec_id (nulls last, then by vector, so that repeated ids have an order). Each round assigns every part and replaces
    each entry by floor(sum / count) of its parts; entries that nothing chose stay. All arithmetic that decides is exact.
    An error beyond 64 bits is the largest such number. Without rows the result is empty and the codebooks have no
    entries. All vectors must have one length, a multiple of `parts` (0 counts); anything else is a ValueError.
    """
    require_integer(vectors, "vec_id")
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256, a byte")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    sizes = vectors.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    size = (sizes.most or 0) // parts
    if sizes.least != sizes.most or size * parts != (sizes.most or 0):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    head = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in head], np.int64).reshape(len(head), parts, size).transpose(1, 0, 2)
    kinds = np.array([grouped(start[p], groups) for p in range(parts)])
    history = start[None]  # rounds x parts x entries x components
    carried = StructType([vectors.schema[c] for c in ("vec_id", "label", "v")])
    schema = StructType([*carried.fields, StructField("code", BinaryType()), StructField("bounds", BinaryType()), StructField("stamps", BinaryType()), StructField("error", LongType())])

    def assigning(history: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                v = _matrix(batch.column("v"), n).reshape(n, parts, size)
                known = None
                if "code" in batch.schema.names:
                    code, bounds, stamps = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, parts, -1) for c, t in (("code", np.uint8), ("bounds", np.float32), ("stamps", np.uint8)))
                    known = [(code[:, p, 0], bounds[:, p], stamps[:, p]) for p in range(parts)]
                made = [assign(v[:, p], history[:, p], kinds[p], groups, known[p] if known else None) for p in range(parts)]
                total = sum(m[1].astype(object) for m in made)
                code = np.stack([m[0] for m in made], 1).astype(np.uint8)
                bounds, stamps = np.stack([m[2] for m in made], 1), np.stack([m[3] for m in made], 1)
                binary = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (code, bounds, stamps)]
                error = pa.array([min(int(e), 2**63 - 1) for e in total], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), *binary, error], names=schema.names)

        return run

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums for each part and entry over the task's rows; whole numbers of any size."""
        sums, counts = np.zeros((parts, len(head), size), object), np.zeros((parts, len(head)), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column("v"), n).reshape(n, parts, size)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
            fits = float(np.abs(v.astype(np.float64)).max(initial=0)) * n < 2**62
            for p in range(parts):
                own = np.zeros((len(head), size), np.int64 if fits else object)
                np.add.at(own, code[:, p], v[:, p] if fits else v[:, p].astype(object))
                sums[p] += own
                counts[p] += np.bincount(code[:, p], minlength=len(head))
        p, k = np.nonzero(counts)
        at = np.tile(np.arange(size, dtype=np.int32), len(p))
        columns = [pa.array(np.repeat(p, size), pa.int32()), pa.array(np.repeat(k, size), pa.int32()), pa.array(at), pa.array(np.repeat(counts[p, k], size)), pa.array([Decimal(int(s)) for s in sums[p, k].ravel()], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "at", "n", "s"])

    table = vectors.select("vec_id", "label", "v")
    for step in range(rounds + 1 if head else 0):
        last = scratch.write(in_arrow(table, assigning(history), schema), f"codes-{step}")
        scratch.drop_others(last)
        table = last
        if step < rounds:
            partial = in_arrow(table.select("v", "code"), summing, "part int, entry int, at int, n long, s decimal(38,0)")
            found = partial.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # parts x entries x components
            book = history[-1].copy()
            for r in found:
                book[r.part, r.entry, r.at] = int(r.s) // r.n
            history = np.concatenate([history, book[None]])
    if not head:
        return spark.createDataFrame([], schema).select("vec_id", "label", "code", "error"), history[-1]
    return table.select("vec_id", "label", "code", "error"), history[-1]


def with_label_error(coded: DataFrame) -> DataFrame:
    """Rows with `label_error`, the error summed over rows of an equal label, nulls together; beyond 64 bits the largest
    such number. A hot label meets one row, and Spark may split its rows."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
