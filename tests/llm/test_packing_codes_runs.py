"""Packing, vector codes and periodic runs against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from motionlake.llm import codes, packing, queries, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
JSON = P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "a", "a b", "the  cat\t\n sat ", "naïve Ünïcode 漢字 \U0001f600 'll", "x" * 3000, "word " * 4000, "a <|endoftext|> x"]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


# 11


def whole(sequences, sizes):
    """Every id of every example is in one piece."""
    seen = {}
    for made in sequences:
        assert made
        for i, at, n in made:
            assert n > 0
            seen.setdefault(i, []).append((at, n))
    assert set(seen) == {i for i, n in enumerate(sizes) if n}
    for i, parts in seen.items():
        reached = 0
        for at, n in sorted(parts):
            assert at == reached
            reached += n
        assert reached == sizes[i]


@pytest.mark.parametrize("cut", [True, False])
def test_place_keeps_all_three_limits(cut):
    rng = np.random.default_rng(4)
    for limits in (packing.Limits(64, 5, 40), packing.Limits(64, 3, 64), packing.Limits(16, 16, 1), packing.Limits(1, 1, 1)):
        sizes = np.r_[rng.integers(0, 30, 60), 64, 65, 200, 0, 1]
        prompt = np.minimum(rng.integers(0, 30, len(sizes)), sizes + 3)
        made = packing.place(sizes, prompt, limits, cut)
        whole(made, sizes)
        for one in made:
            assert sum(n for *_, n in one) <= limits.tokens and len(one) <= limits.segments
            assert sum(max(0, at + n - max(at, prompt[i])) for i, at, n in one) <= limits.loss
        if not cut:  # only what no sequence could hold is cut
            own = {}
            for one in made:
                for i, *_ in one:
                    own[i] = own.get(i, 0) + 1
            assert all(sizes[i] > limits.tokens or sizes[i] - min(prompt[i], sizes[i]) > limits.loss for i, k in own.items() if k > 1)


def test_dot_product_balances_segments_and_loss():
    """Long prompts and short answers are mixed, so that neither limit ends sequences early."""
    sizes, prompt = np.array([90] * 20 + [10] * 20), np.array([90] * 20 + [0] * 20)
    made = packing.place(sizes, prompt, packing.Limits(100, 4, 10), cut=False)
    assert len(made) == 20 and all(sorted(sizes[i] for i, *_ in one) == [10, 90] for one in made)


def test_powers_need_no_padding():
    for total in (1, 7, 64, 1500, 2047):
        pieces = [(0, 5, total // 3), (1, 0, total - total // 3)] if total > 2 else [(0, 5, total)]
        made = packing.in_powers(pieces)
        lengths = [sum(n for *_, n in one) for one in made]
        assert sum(lengths) == total and all(n & (n - 1) == 0 for n in lengths) and len(set(lengths)) == len(lengths)
        assert sorted((i, at) for one in made for i, at, _ in one)[0] == (0, 5)


def packed_as_the_library(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in enumerate(texts)}
    reached, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == reached.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        reached[r.doc_id] = r.start + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert reached == {i: len(x) for i, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)  # no padding


def test_packing_of_documents(spark, tmp_path):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(900))) for _ in range(60))]
    docs(spark, texts).withColumns({"ids": F.lit("x"), "offset": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    packed_as_the_library(queries.op11_packing(spark, str(tmp_path)).collect(), texts)


def test_packing_edges(spark):
    table = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    got = packing.pack_documents(table.coalesce(1), JSON, 1, with_ids=True).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.length) for r in got)[:2] == [(False, 1, 2)] * 2 and sum(r.length for r in got) == 7
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert packing.pack_documents(table.limit(0), JSON, 1).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(table.withColumn("doc_id", F.lit("x")), JSON, 1)
    with pytest.raises(ValueError):
        packing.Limits(segments=0)


def test_instruction_examples(spark):
    rows = [(i, list(range(i % 37)), i % 23) for i in range(300)] + [(900, None, 3), (901, [], None), (None, [5, 6], None), (902, list(range(100)), 200), (902, list(range(100)), 0)]
    table = spark.createDataFrame(rows, "doc_id long, ids array<int>, prompt int").withColumn("start", F.lit("x"))
    got = packing.pack_examples(table, packing.Limits(64, 6, 30)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        assert sum(r.length for r in own) <= 64 and len(own) <= 6 and sum(r.n_loss for r in own) <= 30
    assert sorted(x for r in got for x in r.ids) == sorted(x for _, ids, _ in rows for x in ids or [])
    assert sum(r.n_loss for r in got) == sum(max(0, len(ids or []) - (p or 0)) for _, ids, p in rows)
    assert {r.doc_id for r in got if r.length < r.doc_tokens} <= {902} | {i for i in range(300) if i % 37 - i % 23 > 30}


# 12


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector of whole numbers, label); every part against every entry, whole numbers of any size."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(rows[0][1]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        found = [[min((away(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                    if own:
                        books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    return [(r[0], bytes(f[p][1] for p in range(parts)), sum(f[p][0] for p in range(parts)), r[2]) for r, f in zip(rows, found, strict=True)], books


def coded(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, v array<long>, label int")
    got, books = codes.compress(table, **how)
    return sorted(((r.vec_id, bytes(r.code), r.error, r.label) for r in got.collect()), key=str), books


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_plain_means(spark, seed):
    rng = np.random.default_rng(seed)
    spread = (3, 40, 2000)[seed]
    rows = [(int(i), [int(x) for x in rng.integers(-spread, spread, 8)], int(i) % 3 or None) for i in rng.permutation(300)]
    rows += [(7, rows[0][1], 1), (None, rows[1][1], 1), (5, [0] * 8, None)]  # repeated and missing ids
    want, books = plain_codes(rows, entries=20)
    got, made = coded(spark, rows, entries=20, groups=5)
    assert got == sorted(want, key=str) and made.tolist() == [[list(e) for e in b] for b in books]


def test_huge_components_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [int(x) * 2**50 for x in rng.integers(-9, 9, 4)], i % 2) for i in range(40)]
    want, books = plain_codes(rows, entries=5)
    got, made = coded(spark, rows, entries=5, groups=2)
    assert got == sorted(((i, c, min(e, 2**63 - 1), k) for i, c, e, k in want), key=str) and made.tolist() == [[list(e) for e in b] for b in books]


def test_net_displacement_is_no_more_than_the_sum_of_steps_and_saves_scans():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 30, (400, 6)) for c in rng.uniform(-900, 900, (24, 6))]).astype(np.int64)
    history, before, scans = x[:48][None].copy(), None, []
    group = codes.grouped(history[0], 8)
    for _ in range(5):
        entry, error, low, stamp, scanned = codes.assign(x, history, group, 8, before)
        away = ((x[:, None] - history[-1][None]) ** 2).sum(2)
        assert (entry == away.argmin(1)).all() and (error == away.min(1)).all()
        for g in range(8):  # every bound holds at the round it was taken
            for s in np.unique(stamp[:, g]):
                rows = np.flatnonzero((stamp[:, g] == s) & True)
                d = np.sqrt(((x[rows][:, None] - history[s][None]) ** 2).sum(2).astype(float))
                d[:, group != g] = np.inf
                d[np.arange(len(rows)), entry[rows]] = np.inf
                assert (low[rows, g] <= d.min(1) + 1e-6).all()
        before = (entry, low, stamp)
        scans.append(scanned)
        own = np.array([x[entry == k].sum(0) // max(1, (entry == k).sum()) if (entry == k).any() else history[-1][k] for k in range(48)])
        history = np.concatenate([history, own[None]])
    assert scans[0] == len(x) * 8 and sum(scans[1:]) < 0.5 * 4 * scans[0]
    steps = sum(codes.net_moves(history[r : r + 2], group, 8)[:, 0] for r in range(5))
    assert (codes.net_moves(history, group, 8)[:, 0] <= steps + 1e-9).all()


def test_codes_edges(spark, tmp_path):
    kind = "vec_id long, embedding array<float>, label int, v string, error int"
    rows = [(1, [0.5, -0.1, 3.0, 0.0], 1, "x", 0), (2, None, 1, "x", 0), (3, [1.0, None, 1.0, 1.0], 1, "x", 0), (4, [float("nan"), 0.0, 0.0, 0.0], 1, "x", 0), (5, [float("inf"), 0.0, 0.0, 0.0], None, "x", 0), (6, [0.5, -0.1, 3.0, 0.0], None, "x", 0), (None, [0.0, 0.0, 0.0, 1.0], None, "x", 0)]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in queries.op12_vector_codes(spark, str(tmp_path)).collect()}
    assert got == {1: ("00000000", 0, 0), 6: ("00000000", 0, 0), None: ("02020202", 0, 0)}
    none, books = codes.compress(codes.integers(spark.createDataFrame([], kind)))
    assert none.count() == 0 and books.size == 0
    empty, _ = codes.compress(codes.integers(spark.createDataFrame([(1, [], 1, "x", 0)], kind)))
    assert [(bytes(r.code), r.error) for r in empty.collect()] == [(b"\0\0\0\0", 0)]
    for bad in ([(1, [1.0] * 4, 1, "x", 0), (2, [1.0] * 8, 1, "x", 0)], [(1, [1.0] * 5, 1, "x", 0)]):
        with pytest.raises(ValueError):
            codes.compress(codes.integers(spark.createDataFrame(bad, kind)))


# 13


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_report(doc, text, planted=False):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if planted and words:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in own for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic(rng):
    letters = "abc"[: rng.randint(1, 3)]
    parts = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33]))]
        parts += (unit * 12)[: rng.randint(1, len(unit) * 9)]
        parts += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))]
    return " ".join(parts)


def test_runs_of_words_equal_brute_force():
    rng = random.Random(8)
    for k in range(400):
        words = periodic(rng).split() if k % 4 else [rng.choice("ab") for _ in range(rng.randint(0, 90))]
        codes_ = np.unique(words, return_inverse=True)[1].astype(np.int32) if words else np.zeros(0, np.int32)
        chains = {}
        for octave, at in runs.in_question(codes_):
            for q, lo, hi in runs.solve_tile(codes_.tolist(), octave, at.tolist()):
                chains.setdefault(q, []).append((lo, hi))
        got = []
        for q, parts in chains.items():
            merged = []
            for lo, hi in sorted(parts):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            got += [(lo, hi - lo + q, q) for lo, hi in merged if hi - lo >= runs.least_chain(q)]
        assert sorted(got) == plain_runs(words), words


def test_long_periods_are_stitched_from_tiles(spark, monkeypatch):
    rng = random.Random(3)
    unit = [f"w{rng.randrange(60)}" for _ in range(130)]
    texts = [" ".join((unit * 40)[7:4500]), " ".join(["x"] * 3000 + unit * 5 + ["y"] * 6), " ".join((["a"] * 100 + ["b"]) * 9), " ".join(unit * 3)]
    got = sorted(tuple(r) for r in runs.report(docs(spark, texts)).collect())
    assert got == [plain_report(i, t) for i, t in enumerate(texts)]
    listed = sorted(tuple(r) for r in runs.periodic_runs(docs(spark, texts)).collect())
    assert listed == sorted((i, *r) for i, t in enumerate(texts) for r in plain_runs(t.encode().split()))


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [None, "", " ", "\x1c", "a b", "a " * 6, "a a a a a a a", *(periodic(rng) for _ in range(80)), *(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 300))) for _ in range(120))]
    docs(spark, texts).withColumns({"data": F.lit("x"), "uid": F.lit(1), "start": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).select(*(x.split()[0] for x in runs.FOUND.split(", "))).collect())
    assert got == [plain_report(i, t, planted=True) for i, t in enumerate(texts)]
    assert sum(r[1] for r in got) > 200


def test_periodic_runs_edges(spark):
    table = spark.createDataFrame([(1, "a " * 9), (1, "a " * 9), (1, "a " * 7), (None, "a b " * 9), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_runs, r.length) for r in runs.report(table, queries.planted_repeats).collect()), key=str)
    assert len(got) == 5 and {(None, 0, None), (None, 1, 18)} < set(got)
    assert runs.report(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.report(table.withColumn("doc_id", F.lit("x")))
    long = spark.createDataFrame([(3, ("word " * 10 + "other ") * 30_000)], "doc_id long, text string")  # two megabytes
    assert [(r.n_runs, r.period, r.length) for r in runs.report(long).select("n_runs", "period", "length").collect()] == [(30_001, 11, 330_000)]


# 1 and broadcasts


def test_decontamination_without_any_broadcast(spark):
    """One plan at every size: thin rows, evenly dealt, and the same result."""
    from motionlake.llm import decontaminate

    rng = random.Random(3)
    prose = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = spark.createDataFrame([(1, prose(30, 40)), (2, "short item here"), (3, None)], "item_id long, text string")
    passage = items.collect()[0].text
    texts = [*ODD, *(prose(50, 40) for _ in range(10)), f"{prose(10, 400)} {passage} {prose(10, 400)}", "a SHORT item-here short item"] + [passage] * 3
    found = lambda: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.find(docs(spark, texts), items).collect())
    want = found()
    assert sum(r[2] > 0 for r in want) == 5
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        assert found() == want
        plan = decontaminate.find(docs(spark, texts), items)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Python" not in plan
    finally:
        for k in keys:
            spark.conf.unset(k)
