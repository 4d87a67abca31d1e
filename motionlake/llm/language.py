"""Language identification by a linear-chain conditional random field over words.

Each word scores every language through hashed features (its affixes, its character n-grams and itself as a
lexicon entry); learned transitions tie neighbouring words, so that parts of a code-switched text keep their own
language. Forward-backward gives each word's probabilities; a document's language has the highest mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.chunks import blocks
from motionlake.llm.common import in_arrow

_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")
#: Buckets of hashed features.
BUCKETS = 2**17
_POWERS = np.cumprod(np.full(512, 0x01000193, np.uint32), dtype=np.uint32)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lowered. Fractions, superscripts and number signs are no letters."""
    if not text:
        return []
    text = text.lower()
    words = _WORD.findall(text)
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ((w,) if w.isalpha() else _LETTERS.findall(w))]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words one after the other, and where each word's features start."""
    marked = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    head = np.flatnonzero(codes == 2)
    tail = np.flatnonzero(codes == 3)
    size = tail - head + 1
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - np.repeat(head, size)
    found, of = [], []
    for n in (2, 3, 4):
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x01000193)
        inside = owner[: len(h)] == owner[n - 1 :]
        if n == 4:  # of four characters only affixes
            inside &= (place[: len(h)] == 0) | (codes[3:] == 3)
        h = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x9E37)
        found.append(h[inside])
        of.append(owner[: len(h)][inside])
    mixed = (codes + np.uint32(7)) * _POWERS[np.minimum(place, 511)]
    whole = np.add.reduceat(mixed, head) if len(head) else np.zeros(0, np.uint32)
    found.append(whole ^ (whole >> np.uint32(13)))
    of.append(np.arange(len(words)))
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (found[order] % np.uint32(BUCKETS)).astype(np.int64), np.searchsorted(of[order], np.arange(len(words)))


@dataclass
class Field:
    """labels: languages; weights: bucket by label; moves: score of a label after another."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        buckets, starts = word_features(words)
        counts = np.diff(np.r_[starts, len(buckets)])
        return (np.add.reduceat(self.weights[buckets], starts) / np.sqrt(counts)[:, None]).astype(np.float32)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities of each word, in the order of `scores`."""
    return expectations(scores, lengths, moves)[0]


def expectations(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many texts at once: label probabilities of each word, in the order of `scores`, and, if
    asked for, how often each label is expected to follow each other one, over all neighbouring words.

    Texts run side by side, longest first, so that each step has the texts that are that long.
    """
    n, k = scores.shape
    follow = np.zeros((k, k))
    if not n:
        return scores, follow
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than each step
    begin = np.concatenate([[0], np.cumsum(active)])
    index = np.empty(n, np.int64)  # by step, then text
    for_text = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    index[begin[step] + for_text] = starts[for_text] + step
    local = np.exp(scores[index] - scores[index].max(1, keepdims=True)).astype(np.float64)
    move = np.exp(moves - moves.max())
    forward = np.empty((n, k))
    for t in range(len(active)):
        a, b = begin[t], begin[t + 1]
        f = local[a:b] if t == 0 else (forward[begin[t - 1] : begin[t - 1] + b - a] @ move) * local[a:b]
        forward[a:b] = f / f.sum(1, keepdims=True)
    back = np.ones((active[0], k))
    for t in range(len(active) - 1, -1, -1):
        a, b = begin[t], begin[t + 1]
        if t + 1 < len(active):
            c = begin[t + 2] - b
            g = (back[:c] * local[b : b + c]) @ move.T
            back[:c] = g / g.sum(1, keepdims=True)
        if pairs and t:  # forward holds what comes before only, up to this step
            both = forward[begin[t - 1] : begin[t - 1] + b - a, :, None] * move[None] * (local[a:b] * back[: b - a])[:, None, :]
            follow += (both / both.sum((1, 2), keepdims=True)).sum(0)
        forward[a:b] *= back[: b - a]
    forward /= forward.sum(1, keepdims=True)
    out = np.empty((n, k))
    out[index] = forward
    return out, follow


def gradients(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log likelihood of the labels `gold`, by each word's scores and by the moves."""
    wrong, follow = expectations(scores, lengths, moves, pairs=True)
    wrong = wrong.copy()
    wrong[np.arange(len(gold)), gold] -= 1
    inner = np.ones(len(gold), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False  # a text's first word follows none
    inner = np.flatnonzero(inner)
    np.add.at(follow, (gold[inner - 1], gold[inner]), -1.0)
    return wrong, follow


def _fit(texts: list[list[str]], langs: list[str], rounds: int, seed: int) -> Field:
    labels = sorted(set(langs))
    k = len(labels)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
    truth = [labels.index(x) for x in langs]
    buckets, starts = word_features(list(number))
    counts = np.diff(np.r_[starts, len(buckets)])
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    past_w, past_m = np.full((BUCKETS, k), 1e-3), np.full((k, k), 1e-3)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            ids, gold, lengths = [], [], []
            for i in order[at : at + 64]:
                a, ya = rows[i], np.full(len(rows[i]), truth[i])
                if rng.random() < 0.5 and len(a) > 1:  # a switch to another text in the middle
                    j = int(order[rng.integers(len(order))])
                    b = rows[j][: max(1, len(rows[j]) // 2)]
                    cut = len(a) // 2
                    a, ya = np.concatenate([a[:cut], b, a[cut:]]), np.concatenate([ya[:cut], np.full(len(b), truth[j]), ya[cut:]])
                ids.append(a)
                gold.append(ya)
                lengths.append(len(a))
            ids, gold, lengths = np.concatenate(ids), np.concatenate(gold), np.array(lengths)
            used, inverse = np.unique(ids, return_inverse=True)
            some = counts[used]
            flat = np.repeat(starts[used] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            own = buckets[flat]
            scores = np.add.reduceat(weights[own], np.cumsum(some) - some) / np.sqrt(some)[:, None]
            wrong, pairs = gradients(scores[inverse], lengths, moves, gold)
            word_grad = np.stack([np.bincount(inverse, wrong[:, c], len(used)) for c in range(k)], 1) / np.sqrt(some)[:, None]
            spread = np.repeat(word_grad, some, axis=0)
            grad = np.stack([np.bincount(own, spread[:, c], BUCKETS) for c in range(k)], 1) / len(lengths)
            past_w += grad**2
            weights -= 0.5 * grad / np.sqrt(past_w)
            pairs = pairs / len(lengths)
            past_m += pairs**2
            moves = np.clip(moves - 0.2 * pairs / np.sqrt(past_m), -4, 4)
    return Field(labels, weights.astype(np.float32), moves)


def train(docs: DataFrame, learn: Column | None = None, sample_rows: int = 800, most_chars: int = 50_000, rounds: int = 3, seed: int = 3) -> Field | None:
    """Fit on whole texts of documents with a language for which `learn` holds; None if there is none.

    The sample is bounded in all, not by the length of any text: of each language about sample_rows / languages documents
    (all it has, if fewer), at most that many times `most_chars` characters together, and always one. Documents are taken
    in the order of a hash of id and text, those of at most `most_chars` first, so that a language of long texts only is
    learned as well. Null languages teach nothing; repeated rows stand together in that order.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    known = (known.where(learn) if learn is not None else known).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()  # one row a language
    if not sizes:
        return None
    each = -(-sample_rows // len(sizes))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, min(1.0, 1.2 * each / r["count"]))))
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"), "text"), F.lit(1_000_000_000)) / 1_000_000_000
    placed = known.withColumns({"place": h / F.try_element_at(share, F.col("lang")), "long": F.length("text") > most_chars}).where("place < 1")
    facts = placed.select("lang", "long", "place", F.length("text").alias("n")).orderBy("long", "place").limit(4 * sample_rows).collect()  # no texts
    taken: dict[str, list[int]] = {}
    cuts: dict[tuple[str, bool], float] = {}
    for r in facts:
        rows_of, chars = taken.setdefault(r.lang, [0, 0])
        if rows_of == 0 or (rows_of < each and chars + r.n <= each * most_chars):
            taken[r.lang] = [rows_of + 1, chars + r.n]
            cuts[r.lang, r.long] = r.place
        else:
            taken[r.lang][0] = each  # nothing behind the first that doesn't fit
    if not cuts:
        return None
    cut = lambda long: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, cuts.get((r.lang, long), -1.0)))), F.col("lang")), F.lit(-1.0))
    rows = placed.where(F.col("place") <= F.when(F.col("long"), cut(True)).otherwise(cut(False))).orderBy("long", "place", "doc_id").limit(sample_rows + len(sizes)).collect()
    rows = [(t, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)) if (t := words_of(r.text))]
    return _fit([r[0] for r in rows], [r[1] for r in rows], rounds, seed) if rows else None


class Labeller:
    """Applies a field, with a bounded table of words it has met."""

    def __init__(self, field: Field, limit: int = 300_000):
        self.field, self.limit = field, limit
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(self.field.labels)), np.float32)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words, and how many words each text has."""
        if len(self.number) > self.limit:
            self._clear()
        known, number = len(self.number), self.number
        fresh: list[str] = []
        codes, lengths = [], []
        for text in texts:
            words = words_of(text)
            for w in words:
                if w not in number:
                    number[w] = len(number)
                    fresh.append(w)
            codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            lengths.append(len(words))
        parts = [self.field.emissions(fresh[at : at + 50_000]) for at in range(0, len(fresh), 50_000)]
        self.table = np.concatenate([self.table, *parts])
        assert len(self.table) == known + len(fresh)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        return marginals(self.table[flat], np.array(lengths, np.int64), self.field.moves), np.array(lengths, np.int64)

    def documents(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its mean probability; `und` and 0 without letters."""
        p, lengths = self.words(texts)
        ends = np.cumsum(lengths)
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
        mean = (total[ends] - total[ends - lengths]) / np.maximum(lengths, 1)[:, None]
        best = mean.argmax(1)
        names = [self.field.labels[b] if n else "und" for b, n in zip(best, lengths, strict=True)]
        return names, np.where(lengths > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred, score of each row, repeated ones included. A null text or one without letters is `und` with
    score 0, and so is every text without a field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field) if field else None
        for batch in batches:
            for part in blocks(batch, "text", 3_000_000):
                texts = part.column("text").to_pylist()
                names, scores = labeller.documents(texts) if labeller else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, words, langs: the words of each text, lowered, and the likeliest language of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field)
        for batch in batches:
            for part in blocks(batch, "text", 3_000_000):
                texts = part.column("text").to_pylist()
                p, lengths = labeller.words(texts)
                names = [field.labels[i] for i in p.argmax(1)] if len(p) else []
                ends = np.cumsum(lengths)
                langs = [names[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                kind = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([words_of(t) for t in texts], kind), pa.array(langs, kind)], names=["doc_id", "words", "langs"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words array<string>, langs array<string>")
