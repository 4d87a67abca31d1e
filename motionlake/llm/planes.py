"""Token ids as byte or bit planes: a binary format for tokenized corpora.

A dataset is a folder of shards, each a range of documents in ascending doc_id order. A shard is a run of
blocks of `block` ids (the last may be shorter). A block's ids are transposed into planes (plane k of kind
"byte" holds byte k of every id, of kind "bit" its bit k) and each plane is compressed by zstandard. Beside
the planes each block stores its index entry: shard, block number, place of its first id in the shard,
number of ids, and which documents its ids belong to. Index columns can be read without the planes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionlake.llm.chunks import ChunkTable, blocks
from motionlake.llm.common import in_arrow, require_integer

BLOCK = 65_536
#: parts: one entry for each document that has ids in the block: id, whether they begin or go on, how many.
SCHEMA = "shard int, block int, first_id long, n_ids int, kind string, doc_ids array<long>, begins array<boolean>, parts array<int>, planes array<binary>"


def to_planes(ids: np.ndarray, kind: str, level: int = 3) -> list[bytes]:
    """The compressed planes of a block of unsigned 32-bit ids."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(table, axis=1, bitorder="little").T, axis=1)
    else:
        rows = table.T
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.ascontiguousarray(row).tobytes()) for row in rows]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(x), np.uint8) for x in planes])
    if kind == "bit":
        table = np.packbits(np.unpackbits(rows, axis=1)[:, :n].T, axis=1, bitorder="little")
    else:
        table = rows.T
    return np.ascontiguousarray(table).view("<u4").ravel()[:n]


class _Library:
    """The tokenizers library over distinct chunks: many short ones at once, parted by a newline token.

    Unless `ordinary`, a text that holds the content of an added token (<|endoftext|>) is encoded whole, as the library
    does by default; chunks serve all other texts.
    """

    def __init__(self, path: str, ordinary: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        gap = self._ids(["\n"])[0]
        self.gap = gap[0] if len(gap) == 1 else None
        self.table = ChunkTable(self.chunks, 900_000)
        self.whole, self.added = None, []
        if not ordinary:
            self.whole = Tokenizer.from_file(path)
            self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]

    def _holds_added(self, text: str | None) -> bool:
        if not text:
            return False
        seen = [text] if self.whole.normalizer is None else [text, self.whole.normalizer.normalize_str(text)]
        return any(c in t for c in self.added for t in seen)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's end."""
        apart = {i for i, t in enumerate(texts) if self._holds_added(t)} if self.added else ()
        if not apart:
            return self.table(texts)
        ids, ends = self.table([None if i in apart else t for i, t in enumerate(texts)])
        own = np.split(ids, ends[:-1])
        for i in apart:
            own[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(own), np.cumsum([len(x) for x in own])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cores = [x[1:] if x[:1] == " " else x for x in chunks]
        short = [i for i, x in enumerate(cores) if self.gap is not None and x.split() == [x]]
        alone = sorted(set(range(len(chunks))).difference(short))
        flat, lengths = [], np.zeros(len(chunks), np.int64)
        for at in range(0, len(short), 2000):
            some = short[at : at + 2000]
            ids = np.array(self._ids(["\n".join([chunks[i] for i in some])])[0], np.int32)
            gaps = np.flatnonzero(ids == self.gap)
            lengths[some] = np.diff(np.concatenate([[-1], gaps, [len(ids)]])) - 1
            flat.append(np.delete(ids, gaps))
        lists = self._ids([chunks[i] for i in alone])
        lengths[alone] = [len(x) for x in lists]
        flat = np.concatenate([*flat, *(np.array(x, np.int32) for x in lists), np.zeros(0, np.int32)])
        # back into the order of the chunks
        order = np.array([*short, *alone], np.int64)
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)], ends


_libraries: dict[tuple[str, bool], _Library] = {}


def library_encoder(path: str, ordinary: bool = True) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """Encode texts with the tokenizers library and the tokenizer file at `path`."""
    if (path, ordinary) not in _libraries:
        _libraries[path, ordinary] = _Library(path, ordinary)
    return _libraries[path, ordinary].encode


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, kind: str = "byte", block: int = BLOCK, ordinary: bool = True) -> None:
    """Encode `text` of each document, append end_id, and write all ids in ascending doc_id order to `out`.

    doc_id is an integer. Null text counts as empty (end_id alone). Documents without an id come first; equal ids keep an order by
    text. Spark deals the documents out by range, so shards are as even as the rows allow. `ordinary`: an added token's
    string in a text is ordinary text; else it becomes that token, the library's default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer, ordinary)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        kept: list[np.ndarray] = []
        held = 0
        docs_, begins, parts = [], [], []  # of the block that is being filled

        def emit() -> pa.RecordBatch:
            nonlocal number, first, held
            ids = np.concatenate(kept)
            row = [[shard], [number], [first], [len(ids)], [kind], [docs_[:]], [begins[:]], [parts[:]], [to_planes(ids, kind)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            number, first, held = number + 1, first + len(ids), 0
            for x in (kept, docs_, begins, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for piece in blocks(batch, "text", 6_000_000):
                ids, ends = encode(piece.column("text").to_pylist())
                start = 0
                for doc, end in zip(piece.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    own = np.append(ids[start:end], end_id)
                    start, at, begin = end, 0, True
                    while at < len(own):
                        n = min(block - held, len(own) - at)
                        kept.append(own[at : at + n])
                        docs_.append(doc)
                        begins.append(begin)
                        parts.append(n)
                        at, begin, held = at + n, False, held + n
                        if held == block:
                            yield emit()
        if held:
            yield emit()

    require_integer(docs, "doc_id")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    in_arrow(dealt.sortWithinPartitions("doc_id", "text"), run, SCHEMA).write.parquet(out)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The block index without the planes, and `offset`: ids of the whole dataset before each block's first."""
    index = spark.read.parquet(path).drop("planes")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard: a few thousand at most where a shard holds what one task encodes
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(shards.select("shard", before.alias("before")), "shard").withColumn("offset", F.col("before") + F.col("first_id")).drop("before")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. Each block is read on its own.

    A document inside one block gets its checksum there; of one that spans blocks the parts are put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                data = from_planes(x["planes"], x["n_ids"], x["kind"]).tobytes()
                at, last = 0, len(x["parts"]) - 1
                for i, (doc, begin, n) in enumerate(zip(x["doc_ids"], x["begins"], x["parts"], strict=True)):
                    own = data[4 * at : 4 * (at + n)]
                    whole = begin and i < last  # what comes last may go on in the next block
                    rows.append((x["shard"], x["first_id"] + at, doc, begin, n, zlib.crc32(own) if whole else None, None if whole else own))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()])],
                names=["shard", "at", "doc_id", "begins", "n", "crc", "data"],
            )

    parts = in_arrow(spark.read.parquet(path), run, "shard int, at long, doc_id long, begins boolean, n int, crc long, data binary")
    # parts of one document: those after its beginning, within the shard, up to the next beginning
    begin = F.last(F.when(F.col("begins"), F.col("at")), ignorenulls=True).over(Window.partitionBy("shard").orderBy("at"))
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("at", "data")))), lambda x: x["data"])
    joined = F.aggregate(pieces, F.lit(b""), lambda a, b: F.concat(a, b))
    whole = parts.withColumn("first", begin).groupBy("shard", "first").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.coalesce(F.max("crc"), F.crc32(joined)).alias("ids_crc32"))
    index = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = index.select("shard", before.alias("before"))
    return whole.join(shards, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
