"""N-gram Jaccard join by vertical partitioning.

The distinct word shingles of all documents have one global order: by document frequency, rarest first, then by
hash. Vertical partitioning cuts the shingles into fragments, and Spark deals each fragment of every document to
the task of that fragment, which counts the frequencies there. Shingles that a single document holds never
travel back; of the others each document learns enough to know its prefix, the |x| - ceil(t |x|) + 1 first
shingles of its order, one of which every partner shares. Candidates are verified by partial overlaps: each
fragment counts the shingles that a pair shares there, and the counts are summed per pair.

Frequent shingles don't meet in one task: what FREQUENT documents of one block of texts hold goes to its fragment
as a count alone, and stands behind all other shingles in the order. A document needs the frequencies of such
shingles only where its prefix reaches that far; only then are they joined.

Work stays linear in groups of copies: equal sets collapse into classes first; each prefix shingle links its
holders to one of them only (star pairs). What the verified stars leave in several components is compared in
blocks of documents: two blocks meet if their documents share a prefix shingle and their lengths allow a link, and
they report a spanning forest of their links, never all pairs. The result is exact, up to collisions of the 64-bit
hashes that stand for shingles: every pair that shares a prefix shingle and is not already in one component is
counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from motionlake.llm.chunks import blocks
from motionlake.llm.common import Scratch, broadcast_within, in_arrow, require_integer

WORDS = 5
#: Link when DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 3, 4
#: Documents in a block of the family comparison.
BLOCK = 64
#: Fragments in which the overlap of a star pair is counted.
OVERLAP_FRAGMENTS = 8
#: Characters of a block of texts, and how many of its documents make a shingle frequent.
BLOCK_CHARS, FREQUENT = 3_000_000, 8
#: Copies that a row has in a lookup of a key that many rows may hold.
SALTS = 16
#: A node of so many edges is looked up in SALTS places.
HOT_DEGREE = 2000
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def _scatter(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept while a Python worker lives, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than `size` are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(hashes))
    out = np.full(len(hashes) - n + 1, np.uint64(n))
    for i in range(n):
        out = out + _scatter(hashes[i : len(hashes) - n + 1 + i] * np.uint64(_MIX[i % 5] + 2 * (i // 5)))
    return np.unique(_scatter(out))


def _fragments(rows: int) -> int:
    """How many fragments: some two thousand documents' worth of shingles each; at least 64."""
    return int(min(max(64, rows // 2000), 2**20))


def _shapes(docs: DataFrame, fragments: int) -> DataFrame:
    """doc_id, n, digest (two longs), prefix, missing, frequent for each document with an id: its prefix as far as
    others share it, how many entries it lacks, and the frequent shingles they are to be taken from. Rows without a
    doc_id hold frequent shingles (prefix) and their frequencies (frequent)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents to fragments. Of each block one row for a number f: rare shingles of fragment f with their owners,
        counts of its frequent ones; and of the documents whose home is f their facts and frequent shingles."""
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_CHARS):
                ids = np.array(part.column("doc_id").to_pylist(), np.int64)
                sets = [shingles(x) for x in part.column("text").to_pylist()]
                n = np.array([len(x) for x in sets], np.int64)
                digest = np.array([[xxhash.xxh3_64_intdigest(x.tobytes(), 1), xxhash.xxh3_64_intdigest(x.tobytes(), 2)] for x in sets], np.uint64).reshape(-1, 2)
                home = (_scatter(ids.astype(np.uint64)) % np.uint64(fragments)).astype(np.int64)
                tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(len(sets)), n)
                del sets
                order = np.argsort(tokens, kind="stable")  # equal shingles together, and so each fragment
                tokens, owner = tokens[order], owner[order]
                edge = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
                size = np.diff(np.r_[edge, len(tokens)])
                often = np.repeat(size >= FREQUENT, size)
                counted, counts = tokens[edge[size >= FREQUENT]], size[size >= FREQUENT]
                own, tok = owner[often], tokens[often]
                tokens, owner = tokens[~often], owner[~often]
                at_home = np.argsort(home[own], kind="stable")
                own, tok = own[at_home], tok[at_home]
                frag = (tokens >> np.uint64(44)).astype(np.int64) * fragments >> 20
                order = np.argsort(frag * len(ids) + owner, kind="stable")  # by fragment, documents in order within
                tokens, owner, frag = tokens[order], owner[order], frag[order]
                edges = np.arange(fragments + 1)
                cuts, homes = np.searchsorted(frag, edges), np.argsort(home, kind="stable")
                home_cuts, own_cuts = np.searchsorted(home[homes], edges), np.searchsorted(home[own], edges)
                count_cuts = np.searchsorted((counted >> np.uint64(44)).astype(np.int64) * fragments >> 20, edges)
                used = np.flatnonzero(np.diff(cuts) + np.diff(home_cuts) + np.diff(count_cuts))
                rows: list[list] = [[], [], [], [], [], []]
                for f in used.tolist():
                    mine, some = owner[cuts[f] : cuts[f + 1]], homes[home_cuts[f] : home_cuts[f + 1]]
                    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
                    frequent, few = slice(own_cuts[f], own_cuts[f + 1]), slice(count_cuts[f], count_cuts[f + 1])
                    rows[0].append(f)
                    rows[1].append(np.stack([ids[mine[first]], np.diff(np.r_[first, len(mine)])]).tobytes())
                    rows[2].append(tokens[cuts[f] : cuts[f + 1]].tobytes())
                    rows[3].append(np.stack([counted[few].view(np.int64), counts[few]]).tobytes())
                    rows[4].append(np.stack([ids[some], n[some], digest[some, 0].view(np.int64), digest[some, 1].view(np.int64)]).tobytes())
                    rows[5].append(np.stack([ids[own[frequent]], tok[frequent].view(np.int64)]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["frag", "owners", "tokens", "counts", "infos", "own"])
        _words.clear()  # the worker goes on to other stages

    def row(at: int, postings: bytes = b"", infos: bytes = b"", own: bytes = b"", often: bytes = b"") -> pa.RecordBatch:
        columns = [pa.array([at], pa.int32()), *(pa.array([x], pa.binary()) for x in (postings, infos, own, often))]
        return pa.RecordBatch.from_arrays(columns, names=["home", "postings", "infos", "own", "often"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each fragment: frequencies; shingles of several documents go on to the tasks of their documents, with
        frequency 0 if they are frequent in any block."""
        tokens, owners, often = [], [], []
        for batch in batches:
            for frag, own, tok, counts, infos, frequent in zip(*(batch.column(c).to_pylist() for c in ("frag", "owners", "tokens", "counts", "infos", "own")), strict=True):
                ids, size = np.frombuffer(own, np.int64).reshape(2, -1)
                owners.append(np.repeat(ids, size))
                tokens.append(np.frombuffer(tok, np.uint64))
                often.append(np.frombuffer(counts, np.int64).reshape(2, -1))
                if infos or frequent:  # already at home
                    yield row(frag, infos=infos, own=frequent)
        if not tokens:
            return
        seen, total = np.concatenate(often, axis=1)
        seen, place = np.unique(seen.view(np.uint64), return_inverse=True)
        if len(seen):
            frag = int(seen[0] >> np.uint64(44)) * fragments >> 20
            sums = np.zeros(len(seen), np.int64)
            np.add.at(sums, place, total)
            yield row(frag, often=np.stack([seen.view(np.int64), sums]).tobytes())
        tok, own = np.concatenate(tokens), np.concatenate(owners)
        del tokens, owners, often
        order = np.argsort(tok, kind="stable")
        tok, own = tok[order], own[order]
        edge = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
        size = np.diff(np.r_[edge, len(tok)])
        freq = np.repeat(np.where(np.isin(tok[edge], seen, assume_unique=True), 0, size), size)
        shared = freq != 1
        tok, own, freq = tok[shared], own[shared], freq[shared]
        home = (_scatter(own.astype(np.uint64)) % np.uint64(fragments)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        tok, own, freq, home = tok[order].view(np.int64), own[order], freq[order], home[order]
        if not len(home):
            return
        cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(home)], strict=True):
            yield row(int(home[lo]), postings=np.stack([own[lo:hi], tok[lo:hi], freq[lo:hi]]).tobytes())

    def lists(tok: np.ndarray, start: np.ndarray, take: np.ndarray) -> pa.Array:
        """Of each document the first entries of its part of tok."""
        index = np.repeat(start - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)], pa.int32()), pa.array(tok[index], pa.int64()))

    names = ["doc_id", "n", "high", "low", "prefix", "missing", "frequent"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each document's task: its prefix, as far as others share it."""
        postings, infos, often = [np.zeros((3, 0), np.int64)], [], []
        for batch in batches:
            postings += [np.frombuffer(x, np.int64).reshape(3, -1) for x in batch.column("postings").to_pylist() if x]
            infos += [np.frombuffer(x, np.int64).reshape(4, -1) for x in batch.column("infos").to_pylist() if x]
            often += [np.frombuffer(x, np.int64).reshape(2, -1) for x in batch.column("often").to_pylist() if x]
            for x in batch.column("own").to_pylist():
                if x:
                    own = np.frombuffer(x, np.int64).reshape(2, -1)
                    postings.append(np.vstack([own, np.zeros((1, own.shape[1]), np.int64)]))
        for tok, sums in often:
            one = [pa.nulls(1, pa.int64())] * 4
            both = [pa.array([x], pa.list_(pa.int64())) for x in (tok, sums)]
            yield pa.RecordBatch.from_arrays([*one, both[0], pa.nulls(1, pa.int64()), both[1]], names=names)
        if not infos:
            return
        ids, n, high, low = np.concatenate(infos, axis=1)
        order = np.argsort(ids)
        ids, n, high, low = ids[order], n[order], high[order], low[order]
        own, tok, freq = np.concatenate(postings, axis=1)
        del postings, infos
        order = np.lexsort((tok, freq, freq == 0, own))  # frequent ones last
        own, tok, last = own[order], tok[order], freq[order] == 0
        start, end = np.searchsorted(own, ids), np.searchsorted(own, ids, side="right")
        behind = np.concatenate([[0], np.cumsum(last)])
        frequent = behind[end] - behind[start]
        need = np.where(n > 0, n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1, 0)
        need = np.maximum(need - (n - (end - start)), 0)  # what one document alone holds stands first
        take = np.minimum(need, end - start - frequent)
        missing = np.minimum(need - take, frequent)
        columns = [*(pa.array(x, pa.int64()) for x in (ids, n, high, low)), lists(tok, start, take), pa.array(missing, pa.int64()), lists(tok, end - frequent, np.where(missing > 0, frequent, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    cut_ = in_arrow(docs.select("doc_id", "text"), cut, "frag int, owners binary, tokens binary, counts binary, infos binary, own binary")
    counted = in_arrow(cut_.repartitionById(fragments, "frag"), count, "home int, postings binary, infos binary, own binary, often binary")
    return in_arrow(counted.repartitionById(fragments, "home"), gather, "doc_id long, n long, high long, low long, prefix array<long>, missing long, frequent array<long>")


def _postings(shapes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """classes (n, high, low, class) of equal sets, named by their smallest document, and class, n, token: a row for
    each shared shingle of the prefix of each class."""
    known = shapes.where("doc_id is not null and n > 0")
    facts = F.min_by(F.struct("prefix", "missing", "frequent"), "doc_id").alias("f")
    classes = scratch.write(known.groupBy("n", "high", "low").agg(F.min("doc_id").alias("class"), facts).select("n", "high", "low", "class", "f.*"), "classes")
    plain = classes.select("class", "n", F.explode("prefix").alias("token"))
    often = shapes.where("doc_id is null").select(F.inline(F.arrays_zip(F.col("prefix").alias("token"), F.col("frequent").alias("freq"))))
    lacking = classes.where("missing > 0").select("class", "n", "missing", F.explode("frequent").alias("token"))
    # a frequent shingle may stand in very many classes: each row of frequencies has copies for them
    copies = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ranked = lacking.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(copies, ["token", "salt"])
    chosen = F.array_sort(F.collect_list(F.struct("freq", "token")))  # of one document: no more than its shingles
    first = ranked.groupBy("class", "n", "missing").agg(chosen.alias("all")).select("class", "n", F.explode(F.slice("all", 1, F.col("missing").cast("int"))).alias("x"))
    return classes, scratch.write(plain.unionByName(first.select("class", "n", F.col("x.token").alias("token"))), "postings")


def components(edges: DataFrame, most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """node, root (the smallest node that edges a-b reach), for nodes of edges.

    Every round sends each node's smallest known root to all its neighbours, hooks roots onto smaller ones and halves
    the paths. Nodes of many edges and roots of many nodes are looked up in several places, so that no task holds
    all that share one.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.where("a <> b").select("a", "b")
    both = scratch.write(edges.union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    spread = lambda rows, by: rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copied = lambda rows: rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    labels = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), (F.count(F.lit(1)) >= HOT_DEGREE).alias("hot")).withColumnRenamed("a", "node"), "roots")
    if hot := bool(labels.where("hot").limit(1).count()):
        far = both.join(labels.where("hot").select(F.col("node").alias("b"), "hot"), "b", "left")
        both = scratch.write(spread(far, "a").select("a", "b", F.when(F.col("hot"), F.col("salt")).otherwise(0).alias("salt")), "edges")
    for _ in range(most_rounds):
        served, at = labels.select(F.col("node").alias("b"), "root", "hot"), ["b"]
        if hot:
            served, at = served.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)))), ["b", "salt"]
        near = both.join(served, at).groupBy("a").agg(F.min("root").alias("near"))
        # a node's root may itself have a smaller neighbour: hook the roots, then jump
        hooks = labels.join(near.withColumnRenamed("a", "node"), "node").groupBy("root").agg(F.min("near").alias("up")).where("up < root")
        hooks = scratch.write(hooks, "hooks")
        if not hooks.limit(1).count():
            return labels.select("node", "root")
        jumps = spread(hooks, "root").join(copied(hooks.select(F.col("root").alias("up"), F.col("up").alias("far"))), ["up", "salt"], "left")
        jumps = jumps.select("root", F.coalesce("far", "up").alias("to"))
        moved = scratch.write(spread(labels, "node").join(copied(jumps), ["root", "salt"], "left").select("node", F.coalesce("to", "root").alias("root"), "hot"), "roots")
        scratch.drop(labels, hooks)
        labels = moved
    raise RuntimeError("components did not settle")


def _segments(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """class, n, frag, tokens: the shingles of some documents, cut into fragments of the order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = shingles(text)
                cuts = np.searchsorted(tokens >> np.uint64(44), np.arange(1, OVERLAP_FRAGMENTS) * ((1 << 20) // OVERLAP_FRAGMENTS))
                for f, part in enumerate(np.split(tokens, cuts)):
                    for x, y in zip(rows, (doc, len(tokens), f, part.view(np.int64)), strict=True):
                        x.append(y)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=["class", "n", "frag", "tokens"])

    some = docs.join(broadcast_within(ids, 4_000_000), "doc_id", "left_semi")
    return in_arrow(some, cut, "class long, n long, frag int, tokens array<long>")


def _stars(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs a-b that link: overlaps are counted in each fragment and summed."""
    left = segments.select(F.col("class").alias("a"), "frag", F.col("tokens").alias("x"))
    right = segments.select(F.col("class").alias("b"), "frag", F.col("tokens").alias("y"))
    partial = pairs.join(right, "b").join(left, ["a", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("shared"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).where(_linked("shared", "na", "nb")).select("a", "b")


def _linked(shared: str, na: str, nb: str):
    return DENOMINATOR * F.col(shared) >= NUMERATOR * (F.col(na) + F.col(nb) - F.col(shared))


def _block_links(units: DataFrame) -> DataFrame:
    """Spanning forests of the links between two blocks: overlaps of all pairs, fragment by fragment."""

    def links(ids, n, comp, sets, half) -> list[tuple[int, int]]:
        own = np.repeat(np.arange(len(ids)), [len(x) for x in sets])
        tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
        _, column, freq = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = freq[column] > 1
        own, column = own[shared], column[shared]
        overlap = np.zeros((len(ids), len(ids)), np.int64)
        width = 4096  # counts up to this are exact in single precision
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            if a == b:
                continue
            held = np.zeros((len(ids), width), np.float32)
            held[own[a:b], column[a:b] - lo] = 1
            overlap += (held @ held.T).astype(np.int64)
        linked = DENOMINATOR * overlap >= NUMERATOR * (n[:, None] + n[None, :] - overlap)
        linked &= comp[:, None] != comp[None, :]
        if half:  # only pairs between the two blocks; each block is compared with itself elsewhere
            linked[:half, :half] = linked[half:, half:] = False
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            p, q = root(int(i)), root(int(j))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                both = [batch.column(c)[at].values for c in ("first", "second") if batch.column(c)[at].is_valid]
                get = lambda c: np.concatenate([x.field(c).to_numpy(zero_copy_only=False) for x in both])  # noqa: E731, B023
                sets = [s.values.to_numpy() for x in both for s in x.field("tokens")]
                half = len(both[0]) if len(both) == 2 else 0
                found = links(get("class"), get("n"), get("comp"), sets, half)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return in_arrow(units, run, "a long, b long")


def _one_text_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with one row for each doc_id: of several the one that _best_rows chooses."""
    again = scratch.write(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return docs
    best = scratch.write(_best_rows(docs, again), "best")
    return docs.join(broadcast_within(again, 4_000_000), "doc_id", "left_anti").select(*docs.columns).unionByName(best)


def _best_rows(docs: DataFrame, again: DataFrame) -> DataFrame:
    """Of the rows of each listed doc_id the one whose text has most shingles; then the greatest text, then the last
    row in an order of all columns."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                n = pa.array([len(shingles(x)) for x in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, n], names=["id", "text", "row", "size"])

    own = docs.join(broadcast_within(again, 4_000_000), "doc_id", "left_semi")
    rows = own.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*docs.columns).alias("row"))
    rows = in_arrow(rows, sized, StructType([*rows.schema.fields, StructField("size", LongType())]))
    return rows.groupBy("id").agg(F.max_by("row", F.struct("size", "text", F.to_json("row"))).alias("row")).select("row.*")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document: components of links of similarity 0.75 or more.

    A document's words are parted by ASCII white space, with A-Z lowered; its set holds its distinct shingles of
    five words. Null and empty texts have no shingle and are linked with nothing. doc_id is an integer; a repeated one
    gives one row, and if its texts differ, the largest set counts, of equally large ones the greatest text. Rows
    without a doc_id cannot be named and are left out.
    """
    require_integer(docs, "doc_id")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    scratch = Scratch(docs.sparkSession)
    docs = _one_text_each(docs, scratch)
    shapes = scratch.write(_shapes(docs, _fragments(docs.count())), "shapes")
    # equal sets are one class, named by its smallest document; a document's own class if its set is empty
    classes, postings = _postings(shapes, scratch)
    stars = scratch.write(postings.groupBy("token").agg(F.min(F.struct("class", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"), "stars")
    spokes = stars.select("token", F.col("hub.class").alias("a"), F.col("hub.n").alias("na")).join(postings.withColumnsRenamed({"class": "b", "n": "nb"}), "token")
    spokes = scratch.write(spokes.where("a <> b").select("a", "b", "na", "nb").distinct(), "spokes")
    involved = scratch.write(spokes.select(F.col("a").alias("doc_id")).union(spokes.select("b")).distinct(), "involved")
    segments = scratch.write(_segments(docs, involved), "segments")
    close = spokes.where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    links = scratch.write(_stars(close, segments), "links")
    comps = components(links, scratch=scratch)
    more = _family_links(segments, involved, postings.join(stars.select("token"), "token"), comps, scratch)
    roots = components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch=scratch)
    named = classes.select("n", "high", "low", "class").join(roots, F.col("class") == F.col("node"), "left").select("n", "high", "low", F.coalesce("root", "class").alias("component_id"))
    named = scratch.write(named, "named")
    scratch.drop_others(shapes, named)
    found = shapes.where("doc_id is not null").select("doc_id", "n", "high", "low").join(named, ["n", "high", "low"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _family_links(segments: DataFrame, involved: DataFrame, postings: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components that share prefix shingles.

    Only shingles that stand in several components are still open, and only their holders are compared. A family, the
    components that open shingles tie together, is dealt into blocks, and two blocks meet if they hold the same open
    shingle and documents of lengths that a link allows.
    """
    members = involved.select(F.col("doc_id").alias("class")).join(comps.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("comp"))
    members = scratch.write(members, "members")
    held = scratch.write(postings.join(members, "class").select("class", "n", "token", "comp"), "held")
    tokens = held.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("most")).where("a < most")
    tokens = scratch.write(tokens.select("token", "a"), "tokens")
    held_open = scratch.write(held.join(tokens, "token"), "open")
    scratch.drop(held, members)
    families = components(held_open.where("a <> comp").select("a", F.col("comp").alias("b")).distinct(), scratch=scratch)
    # a document stands with others that share its first open shingle
    active = held_open.groupBy("class", "n", "comp").agg(F.min("token").alias("lead"))
    placed = scratch.write(active.join(families.select(F.col("node").alias("comp"), F.col("root").alias("family")), "comp"), "placed")
    # blocks: a component of a block's size or more has its own; smaller ones of a family are mixed
    sizes = scratch.write(placed.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("size")).withColumn("own", F.when(F.col("size") >= BLOCK, F.col("comp"))), "sizes")
    pools = scratch.write(sizes.groupBy("family", "own").agg(F.sum("size").alias("total")), "pools")
    sized = sizes.join(pools.withColumnsRenamed({"family": "f", "own": "o"}), (F.col("family") == F.col("f")) & F.col("own").eqNullSafe(F.col("o"))).select("family", "comp", "own", F.ceil(F.col("total") / BLOCK).cast("int").alias("parts"))
    rows = placed.join(sized, ["family", "comp"])
    leads = scratch.write(rows.withColumn("pool", F.struct("family", "own", F.pmod(F.xxhash64("lead"), F.col("parts")).cast("int").alias("part"))), "leads")
    many = leads.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int")
    blocked = leads.join(many, "pool").select("class", "n", "comp", F.struct("pool.family", "pool.own", "pool.part", piece.alias("piece")).alias("block"))
    blocked = scratch.write(blocked, "blocked")
    whole = segments.groupBy("class", "n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frag", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    full = blocked.drop("n").join(whole, "class").groupBy("block").agg(F.collect_list(F.struct("class", "n", "comp", "tokens")).alias("rows"))
    full = scratch.write(full, "blocks")
    spread = blocked.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    shared = held_open.select("class", "token").join(blocked.select("class", "block"), "class").select("token", "block").distinct().join(spread, "block")
    shared = scratch.write(shared, "shared")
    x, y = (shared.select("token", F.struct("block", "low", "high").alias(c)) for c in "xy")
    fits = (DENOMINATOR * F.col("x.high") >= NUMERATOR * F.col("y.low")) & (DENOMINATOR * F.col("y.high") >= NUMERATOR * F.col("x.low"))
    apart = (F.col("x.block") <= F.col("y.block")) & ~F.coalesce(F.col("x.block.own") == F.col("y.block.own"), F.lit(False))
    pairs = x.join(y, "token").where(apart & fits).select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()
    units = scratch.write(pairs, "units").join(full.select(F.col("block").alias("x"), F.col("rows").alias("first")), "x").join(full.select(F.col("block").alias("y"), F.col("rows").alias("other")), "y")
    units = units.select("first", F.when(F.col("x") != F.col("y"), F.col("other")).alias("second"))
    return scratch.write(_block_links(units), "block-links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, all columns; rows without an id stay. Of the rows
    of a repeated id that one stays whose text counts."""
    scratch = Scratch(docs.sparkSession)
    found = jaccard_components(docs)
    gone = scratch.write(found.where("doc_id <> component_id").select("doc_id"), "gone")
    again = scratch.write(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").cast("long").alias("doc_id")), "again")
    once = docs.join(broadcast_within(gone.unionByName(again), 4_000_000), "doc_id", "left_anti").select(*docs.columns)
    if not again.limit(1).count():
        return once
    return once.unionByName(_best_rows(docs, again).join(gone, "doc_id", "left_anti").select(*docs.columns))
