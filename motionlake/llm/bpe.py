"""Byte-level BPE by corpus-level merge replay, and its inverse.

Encoding takes the distinct pieces of a block of documents as one small corpus. An inverted index maps
each mergeable pair (through its rank) to the positions where it stands; ranks are applied in order over
all pieces at once, and after each merge only the pairs that touch it are looked up again. Pieces never
share pairs, so blocks are independent: Spark deals the documents out, and no piece is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from motionlake.llm.chunks import ChunkTable, blocks
from motionlake.llm.common import in_arrow

_NONE = np.int32(2**31 - 1)
#: A word of Latin letters with sentence marks behind it: two pieces under the usual byte-level pattern.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:$%&*#]*)\Z")


#: The pattern for which that holds.
_PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _sorted_once(positions: np.ndarray) -> np.ndarray:
    positions = np.sort(positions)
    return positions[np.concatenate([[True], positions[1:] != positions[:-1]])]


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class MergeReplay:
    """Encodes many distinct byte strings at once by replaying the merges in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.values = np.array(values, np.int32)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def single(self, piece: bytes) -> list[int]:
        """The definition: always merge the leftmost pair of the lowest rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if best == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and where each piece's ids end."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)].copy()
        n = len(ids)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        after = np.arange(1, n + 1, dtype=np.int64)
        before = np.arange(-1, n - 1, dtype=np.int64)
        edge = np.flatnonzero(owner[1:] != owner[:-1])
        after[edge], before[edge + 1] = -1, -1
        if n:
            after[-1] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, _NONE, np.int32)  # rank of the pair that starts at a position
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: set[int] = set()

        def enter(positions: np.ndarray, now: int) -> None:
            """Put positions into the inverted index under the rank of the pair that starts there."""
            found = self._rank(ids[positions], ids[after[positions]])
            pair[positions] = found
            some = found != _NONE
            positions, found = positions[some], found[some]
            if not len(found):
                return
            if (late := found <= now).any():  # a vocabulary may form a lower rank again; such pieces are done singly
                odd.update(owner[positions[late]].tolist())
            if len(found) > 1:
                order = np.argsort(found, kind="stable")
                positions, found = positions[order], found[order]
                cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
                groups = zip(found[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True)
            else:
                groups = [(int(found[0]), positions)]
            for rank, group in groups:
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(group)

        start = np.flatnonzero(after >= 0)
        if len(start):
            enter(start, -1)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[pair[at] == rank]
            if len(at) > 1:
                at = _sorted_once(at)
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # overlapping pairs: every other one of a run, from the left
                    number = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.r_[True, ~chained], number, 0))
                    at = at[(number - head) % 2 == 0]
            elif not len(at):
                continue
            right = after[at]
            beyond = after[right]
            ids[at] = rank
            alive[right] = False
            pair[at] = pair[right] = _NONE
            after[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            previous = before[at]
            touched = np.concatenate([at[more], previous[previous >= 0]])
            if len(touched):
                enter(_sorted_once(touched), rank)
        kept = ids[alive]
        ends = np.cumsum(np.bincount(owner[alive], minlength=len(pieces)))
        if odd:
            lists = np.split(kept, ends[:-1])
            for i in odd:
                lists[i] = np.array(self.single(pieces[i]), np.int32)
            kept = np.concatenate(lists)
            ends = np.cumsum([len(x) for x in lists])
        return kept, ends


class Codec:
    """Encoder and decoder of one vocabulary; `pattern` cuts a text into the pieces that are merged separately."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.replay = MergeReplay(self.ranks)
        self.table = ChunkTable(self._chunks, 150_000)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        if [x[1] for x in tokens] != list(range(len(tokens))):
            raise ValueError("ranks must number the tokens from 0")
        self.tokens = [x[0] for x in tokens]
        self.digits = [b"%d" % i for i in range(len(tokens))]
        self.plain = _PLAIN if pattern == _PLAIN_FOR else re.compile(r"(?!)()()")

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        codes, counts = [], []
        simple = self.plain.match
        for chunk in chunks:
            if plain := simple(chunk):
                word, marks = plain.groups()
                codes.append(number.setdefault(word, len(number)))
                if marks:
                    codes.append(number.setdefault(marks, len(number)))
            else:
                codes.extend([number.setdefault(piece, len(number)) for piece in self.pattern.findall(chunk)])
            counts.append(len(codes))
        ids, ends = self.replay([x.encode() for x in number])
        starts = np.concatenate([[0], ends])
        codes = np.array(codes, np.int64)
        lengths = starts[codes + 1] - starts[codes]
        out = np.cumsum(lengths)
        total = int(out[-1]) if len(out) else 0
        flat = ids[np.arange(total) + np.repeat(starts[codes] - (out - lengths), lengths)]
        return flat, np.concatenate([[0], out])[counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.table(texts)

    def _joined(self, table: list[bytes], gap: bytes, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        entry, start, out = table.__getitem__, 0, []
        for end in ends.tolist():
            out.append(gap.join(map(entry, ids[start:end].tolist())))
            start = end
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each document, from ids and where each document's ids end."""
        return self._joined(self.tokens, b"", ids, ends)

    def decimal(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of each document as decimal numbers joined by one space."""
        return self._joined(self.digits, b" ", ids, ends)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


def _with(df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", verify: bool = False) -> DataFrame:
    """Append a column with the token ids of `text`; all other columns stay, but one of the new column's name is
    replaced. A null or empty text has no ids.

    With `verify` each text's ids are decoded at once, and the job stops if the bytes are not the text's.
    """
    df = df.drop(ids)
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            for part in blocks(batch, text, 1_500_000):
                texts = part.column(text).to_pylist()
                flat, ends = coder.encode(texts)
                if verify and any(x != (t or "").encode() for x, t in zip(coder.decode(flat, ends), texts, strict=True)):
                    raise ValueError("decoded bytes differ from the text")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _lists(flat, ends)], names=[*keep, ids])
        coder.table.clear()  # the worker goes on to other stages

    return in_arrow(df, run, _with(df, ids, ArrayType(IntegerType())))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that a column of token ids stands for, in place of a column of that name. A null list decodes
    to nothing."""
    df = df.drop(out)
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(ids).to_pylist()]
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            data = coder.decode(flat, np.cumsum([len(x) for x in lists], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*keep, out])

    return in_arrow(df, run, _with(df, out, BinaryType()))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document, encoded and decoded in one pass.

    Null or empty text: no ids, and both digests are those of an empty string. Repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            for part in blocks(batch, "text", 1_500_000):
                ids, ends = coder.encode(part.column("text").to_pylist())
                counts = np.diff(ends, prepend=0)
                spelled = [hashlib.sha256(x).hexdigest() for x in coder.decimal(ids, ends)]
                back = [hashlib.sha256(x).hexdigest() for x in coder.decode(ids, ends)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spelled), pa.array(back)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        coder.table.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
