"""Training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from motionlake.llm import bpe, decontaminate, html, language, near_duplicates, pii, planes, preferences, quality, topk
from motionlake.llm.boosting import Boosted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TIK = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n", "a", "a b", "the  cat\t\n sat ", "naïve Ünïcode 漢字 \U0001f600 'll", "x" * 3000, "word " * 4000]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1


def brute_hits(text, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    w = word.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        v = word.findall(low(t))
        n = min(size, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(1, prose(rng, 30, 40)), (2, "Short, ITEM here"), (3, ""), (4, None), (10, prose(rng, 13, 40)), (11, "É é")]
    texts = ODD + [prose(rng, 50, 40) for _ in range(20)]
    texts += [f"{prose(rng, 10)} {items[0][1][20:90]} {prose(rng, 10)}", f"{prose(rng, 200)} {items[0][1].upper()}!", "a SHORT item-here short item", "é é É é", items[4][1], items[4][1] + " " + items[4][1]]
    found = decontaminate.find(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    twice = spark.createDataFrame([(7, items[4][1], None), (7, "clean", None), (None, items[4][1], None), (None, None, None)], "doc_id long, text string, lang string")
    assert sorted(((r.doc_id, r.text) for r in decontaminate.clean(twice, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str) == [(7, "clean"), (None, None)]
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, (n, h, _) in got.items() if not (h and 20 * h >= n)}
    assert decontaminate.find(docs(spark, texts).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs(spark, texts), empty).agg(F.sum("n_hit")).collect()[0][0] == 0


# 2


def test_planes_round_trip():
    for kind in ("byte", "bit"):
        for n in (1, 7, 8, 9, 1000):
            ids = np.random.default_rng(n).integers(0, 2**32, n).astype(np.uint32)
            assert (planes.from_planes(planes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_planes(spark, tmp_path, kind):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = [*ODD, "<|endoftext|> x", *(prose(rng, 60) for _ in range(20))]
    table = docs(spark, texts).orderBy(F.desc("doc_id")).withColumn("begins", F.lit(1))
    planes.write(table, f"{tmp_path}/{kind}", P.path("byte_bpe_50k.json"), kind=kind, block=64)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in planes.read(spark, f"{tmp_path}/{kind}").collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    index = planes.read_index(spark, f"{tmp_path}/{kind}").orderBy("offset").collect()
    assert [r.offset for r in index] == np.concatenate([[0], np.cumsum([r.n_ids for r in index])])[:-1].tolist()


def test_token_planes_query_equals_the_unmodified_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from motionlake.llm import queries

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = [*ODD, "a <|endoftext|> x", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext |>", *(prose(rng, 60) for _ in range(20)), "b <|endoftext|>"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_planes(spark, str(tmp_path)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)


# 3


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    scores, moves, lengths = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([4, 0, 1, 2])
    got, at = language.marginals(scores, lengths, moves), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += p
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def likelihood(scores, lengths, moves, gold):
    """Log probability of the labels, by enumeration."""
    import itertools

    total, at = 0.0, 0
    for n in lengths:
        score = lambda path: sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        if n:
            total += score(gold[at : at + n]) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(scores.shape[1]), repeat=int(n))))
        at += n
    return total


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 1, 4])
    scores, moves, gold = rng.normal(size=(8, 3)) * 2, rng.normal(size=(3, 3)) * 2, rng.integers(3, size=8)
    by_score, by_move = language.gradients(scores, lengths, moves, gold)
    for x, got in ((scores, by_score), (moves, by_move)):
        for i in np.ndindex(*x.shape):
            x[i] += 1e-5
            up = likelihood(scores, lengths, moves, gold)
            x[i] -= 2e-5
            down = likelihood(scores, lengths, moves, gold)
            x[i] += 1e-5
            assert got[i] == pytest.approx(-(up - down) / 2e-5, abs=1e-5)


def test_languages_of_odd_texts(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(("kal", "mir", "tos")) for _ in range(20)), "aa", 1) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(("üsch", "opf", "zug")) for _ in range(20)), "bb", 1) for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    field = language.train(table, sample_rows=20)
    assert field.labels == ["aa", "bb"]  # a language with few documents is learned too
    odd = ["½ ² Ⅷ", "12 34 !", None, "", "kal mir tos", "üsch² opf", "kal mir " * 150_000]
    got = [r for r in language.predict(docs(spark, odd + odd[4:6]).withColumn("lang_pred", F.lit("x")), field).orderBy("doc_id").collect()]
    assert [r.lang_pred for r in got] == ["und"] * 4 + ["aa", "bb", "aa", "aa", "bb"] and [r.score for r in got[:4]] == [0.0] * 4
    assert language.predict(table.limit(0), field).count() == 0


def test_language(spark):
    rng = random.Random(0)
    sounds = {"aa": "kal mir tos ven dra".split(), "bb": "üsch opf bein zug lich".split()}
    make = lambda lang, n=30: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(("aa", "bb")[i % 2]), ("aa", "bb")[i % 2]) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language.train(table.where("doc_id < 80"))
    got = {r.doc_id: r for r in language.predict(table.where("doc_id >= 80"), field).collect()}
    assert all(got[i].lang_pred == rows[i][2] and 0.5 < got[i].score <= 1 for i in got)
    odd = language.predict(docs(spark, ODD), field).collect()
    assert {r.lang_pred for r in odd if r.doc_id < 4} == {"und"} and all(0 <= r.score <= 1 for r in odd)
    mixed = language.label_words(docs(spark, [make("aa", 8) + " " + make("bb", 8)]), field).collect()[0]
    assert mixed.langs[:6] == ["aa"] * 6 and mixed.langs[-6:] == ["bb"] * 6
    assert language.train(table.limit(0)) is None
    assert language.predict(table.limit(3), None).collect()[0].lang_pred == "und"


# 4


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:160] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [float("nan")] * 8), (900, [1.0, None] * 4), (1000, [float("inf")] * 8)]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in topk.top_k(v, F.col("vec_id") % 100 == 0, k=10, block=97, query_block=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    z = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 700, 100):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:10]
        assert sorted(got[q]) == [(k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 700, 100))
    assert topk.top_k(v.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = topk.top_k(v.where("vec_id < 3"), F.col("vec_id") % 100 == 0)
    assert few.count() == 2


@pytest.mark.parametrize("block", [40, 4096])
def test_top_k_prunes_nothing_that_counts(spark, block):
    """Clusters, ties, repeated ids and columns of clashing names; several pivots and pieces."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 6)) * 0.05 + 3 * rng.normal(size=6) for _ in range(8)] + [np.ones((150, 6))])
    v = np.floor(1024 * x).astype(np.int64)
    rows = [(int(i), v[i].tolist(), 1, 2) for i in range(len(v))] + [(7, (v[7] - 1).tolist(), 1, 2), (5000, [1, 2], 0, 0), (5001, [3, 4], 0, 0), (None, [1, 2], 0, 0)]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>, pivot int, score int").where("vec_id is not null").repartition(4)
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 50 == 0, k=10, block=block, query_block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, len(v), 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:10]
        assert sorted(got.pop(q)) == [(k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert got == {5000: [(1, 5001, 11)]}


def test_top_k_of_equal_and_huge_vectors(spark):
    huge = [(i, [3.07e15] * 4) for i in range(300)] + [(300, [-3.07e15] * 4), (301, [1e38] * 4)]
    v = topk.integers(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))
    got = topk.top_k(v, F.col("vec_id") == 100, k=3).orderBy("rank").collect()
    most = 2**63 - 1
    assert [(r.vec_id, r.score) for r in got] == [(0, most), (1, most), (2, most)]


def test_cover_tree_covers():
    x = np.random.default_rng(2).normal(size=(300, 5))
    stack = [topk.cover_tree(x)]
    while stack:
        n = stack.pop()
        for i, c in enumerate(n.children):  # children's hubs separate, and cover
            assert all(np.linalg.norm(c.hub - o.hub) >= n.cover - 1e-9 for o in n.children[:i]) and c.far <= n.cover + 1e-9
        assert np.sqrt(((x[n.points] - n.hub) ** 2).sum(1)).max() <= n.far + 1e-9
        if n.children:
            assert sorted(np.concatenate([c.points for c in n.children]).tolist()) == sorted(n.points.tolist())
        stack += n.children


# 5


def brute_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", "1", "23", "4111111111111111", "4111 1111-1111 1111", "+", "+1 (988) 555-2485", "1.2.3.4", "256.1.1.1", " ", "_%", "٣", "é", "\n", "@a.b", "0001.2.3.255"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        good, _ = pii.base_spans(text)
        assert sorted(good, key=lambda s: (s[0], pii.KINDS.index(s[2]))) == brute_spans(text), text


def test_long_runs_take_no_longer_than_their_length():
    import time

    t = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1(" * 100_000, "a" * 200_000 + "@b.c"):
        pii.base_spans(text)
    assert time.time() - t < 20


def test_personal_data(spark):
    rng = random.Random(6)
    card = lambda: next(c for c in (str(rng.randrange(10**15, 10**16)) for _ in range(10_000)) if pii.luhn(c))
    texts = list(ODD)
    for i in range(300):
        texts.append(f"{prose(rng, 5)} u{i}.x@mail{i % 7}.example.com {prose(rng, 4)} {card()} and {rng.randrange(10**15, 10**16)} or +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} from 10.{i % 256}.3.{i % 200} v1.2.3.999")
    texts += ["write to jane.doe (at) example (dot) org now", "plain words only, 12 of them"]
    table = docs(spark, texts)
    detector = pii.train(table, sample_rows=400)
    got = {r.doc_id: r for r in pii.report(table, detector).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
    assert got[len(texts) - 1].spans == "" and "email" in got[len(texts) - 2].spans
    clean = {r.doc_id: r for r in pii.redact(table, detector).collect()}
    assert clean[0].text is None and "@" not in clean[20].text and "[EMAIL]" in clean[20].text and clean[20].n_chars == len(clean[20].text)
    assert clean[len(texts) - 1].text == texts[-1]
    none = pii.train(table.limit(0))
    assert none.trees is None and pii.report(table.limit(0), none).count() == 0


def test_wider_spans_in_long_texts():
    """Keys and spelled-out data are found, in time that grows with the text."""
    import time

    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    card = lambda: next(c for c in (str(rng.randrange(10**15, 10**16)) for _ in range(10_000)) if pii.luhn(c))
    seen = [case for i in range(400) for case in pii.cases(f'{prose(rng, 5)} token = "{key()}" {prose(rng, i % 7)} u{i}.v@mail{i % 9}.example.org 10.2.{i % 256}.7 {card()} ordinary-hyphenated-words-2 number {rng.randrange(10**15, 10**16)}')]
    x, y = np.array([pii.features(*c[:4]) for c in seen]), np.array([c[4] for c in seen], float)
    trees = Boosted().fit(x[::2], y[::2])
    calibration, p = {}, trees.probability(x[1::2])
    for kind in pii.ALL_KINDS:
        own = np.array([c[3] == kind for c in seen[1::2]])
        if own.any():
            order = np.argsort(p[own], kind="stable")
            calibration[kind] = quality.isotonic(p[own][order], y[1::2][own][order], np.ones(len(order)))
    detector = pii.Detector(trees, calibration, 0.95)
    planted = [f'{prose(rng, 6)} token = "{key()}" {prose(rng, 4)}' for _ in range(100)] + [f"{prose(rng, 6)} {':'.join(f'{rng.randrange(1, 65536):x}' for _ in range(8))} {prose(rng, 4)}" for _ in range(100)]
    assert np.mean([len(detector.spans(t)[1]) == 1 for t in planted]) >= 0.9
    clean = [prose(rng, 30) for _ in range(50)] + ["the-quick-brown-fox-jumps-2-times", "12:30:45:12:30:45:12:30"]
    assert not any(detector.spans(t)[1] for t in clean)
    began = time.time()
    for text in ("4111 1111 1111 1111 4111.1111.1111.1112 " * 25_000, "a@b.co x (at) y.org " * 50_000, "A1" * 500_000, "x" * 1_000_000, f'token = "{key()}" ' * 20_000):
        detector.spans(text)
    assert time.time() - began < 90


def test_planted_personal_data_of_every_kind(spark):
    """Fitted by train on ordinary documents, then held against forms that stand in none of them."""
    rng = random.Random(11)
    mixed = lambda n: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(n - 2)) + "a7"
    card = lambda: next(c for c in (str(rng.randrange(10**15, 10**16)) for _ in range(10_000)) if pii.luhn(c))
    group = lambda: f"{rng.randrange(4096, 65536):x}"
    odd = ["ordinary-hyphenated-words-2", "at 12:30:45 on", "add::face", f"number {rng.randrange(10**15, 10**16)}"]
    texts = [f"{prose(rng, 5)} token = {mixed(40)} {prose(rng, i % 7)} u{i}.v@mail{i % 9}.example.org 10.2.{i % 256}.7 and {card()} {prose(rng, 3)} +1 415 555 {i % 9000 + 1000} {odd[i % 4]} {prose(rng, 4)}" for i in range(1500)]
    detector = pii.train(docs(spark, texts))
    split = lambda c, by: by.join(c[i : i + 4] for i in range(0, 16, 4))
    forms = {
        "email spelled out": lambda: f"jo{rng.randrange(99)}.lee [at] post{rng.randrange(9)} [dot] example [dot] net",
        "email with at": lambda: f"mia_{rng.randrange(99)} (at) web{rng.randrange(9)}.example.com",
        "card with dots": lambda: split(card(), "."),
        "card with slashes": lambda: split(card(), "/"),
        "phone without plus": lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}",
        "long IPv6": lambda: ":".join(group() for _ in range(8)),
        "short IPv6": lambda: f"2001:{group()}::{group()}:{group()}",
        "link-local IPv6": lambda: f"fe80::{group()}",
        "password": lambda: f"password: {mixed(24)}",
        "api key": lambda: f"api_key={mixed(64)}",
        "key of 320 characters": lambda: f"token = {mixed(320)}",
        "key of 2,000 characters": lambda: f"secret: {mixed(2000)}",
    }
    found = {}
    for name, form in forms.items():
        datum = [form() for _ in range(60)]
        hit = 0
        for x in datum:
            before = prose(rng, 6) + " "
            value = x.split("=")[-1].split(": ")[-1].strip()
            at = len(before) + x.index(value)
            hit += any(a <= at and b >= at + len(value) for a, b, _ in detector.spans(f"{before}{x} {prose(rng, 4)}")[1])
        found[name] = hit
    assert found.pop("link-local IPv6") >= 30, found  # the shortest form, known to be weak: README
    assert min(found.values()) >= 54, found
    clean = [prose(rng, 30) for _ in range(100)] + [f"{prose(rng, 4)} {x} {prose(rng, 4)}" for x in ("the-quick-brown-fox-jumps-2-times", "12:30:45:12:30:45:12:30", "add::face", "std::vector", "9:15 to 10:45", "::")]
    assert sum(bool(detector.spans(t)[1]) for t in clean) <= 2


def test_ipv6_runs():
    import ipaddress

    rng = random.Random(5)
    for _ in range(20_000):
        run = "".join(rng.choice("1f:::") for _ in range(rng.randrange(1, 24)))
        try:
            ipaddress.IPv6Address(run)
            want = run != "::"
        except ValueError:
            want = False
        assert pii.is_ipv6(run) == want, run


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(2)
    low, high = [f"u{i}aba" for i in range(40)], [f"ky{i}zo" for i in range(40)]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(low, 30), "aa") for i in range(60)] + [(100 + i, text(high, 500), "bb") for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language.train(table, sample_rows=40, most_chars=1000)
    assert field.labels == ["aa", "bb"]
    got = {r.doc_id: r.lang_pred for r in language.predict(table, field).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) == 1.0
    assert language.train(table.where("lang is null")) is None


def test_boosting_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((Boosted().fit(x, y).probability(x) > 0.5) == y).mean() > 0.95


# 6


def test_merge_replay_equals_the_library(spark):
    import tiktoken

    c = bpe.Codec(TIK, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(5)
    parts = [" ", "\n", "\t", "a", "the", "\x1c", "\x85", "'s", "!", "é", "漢", "1", "23", "  ", "aaa", "　", "\U0001f600", "'ll", "\r", "<|endoftext|>"]
    texts = [x for x in ODD if x] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(800)] + ["a" * 2000, "ab" * 999]
    ids, ends = c.encode(texts)
    for i, t in enumerate(texts):
        assert ids[(ends[i - 1] if i else 0) : ends[i]].tolist() == enc.encode_ordinary(t), t[:50]
    assert [x.decode() for x in c.decode(ids, ends)] == texts
    rows = {r.doc_id: r for r in bpe.digests(docs(spark, ODD), TIK, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        want = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(want) and rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.encode(docs(spark, ODD), TIK, P.PATTERN, verify=True)
    assert [bytes(r.decoded).decode() for r in bpe.decode(coded, TIK, P.PATTERN).orderBy("doc_id").collect()] == [t or "" for t in ODD]
    again = bpe.encode(coded.withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1)), TIK, P.PATTERN)
    assert again.orderBy("doc_id").select("doc_id", "ids").collect() == coded.orderBy("doc_id").select("doc_id", "ids").collect()


def test_replay_where_ranks_go_back():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 301, b"abc": 299, b"cd": 298, b"aa": 302, b"aaaa": 303}
    r = bpe.MergeReplay(ranks)
    rng = random.Random(0)
    pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    ids, ends = r(pieces)
    assert [ids[(ends[i - 1] if i else 0) : ends[i]].tolist() for i in range(500)] == [r.single(p) for p in pieces]


# 7


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "why"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "system", None), (2, 0, "system", None), (4, 0, None, "x"), (5, 0, "user", "x"), (None, 0, "user", "lost")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.format_pairs(t, preferences.neighbour_pairs(t)).collect()}
    assert set(got) == {0, 1, 2}
    r = got[0]
    assert (r.prompt_turns, r.prompt) == (1, "<|user|>\nhi\n")
    assert r.chosen == "<|assistant|>\nyes\n<|user|>\nwhy\n" and r.rejected == "<|assistant|>\nno\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["yes\n"] and [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["no\n"]
    assert (got[1].prompt_turns, got[1].rejected_id, got[1].rejected, got[1].chosen) == (0, None, "", "<|system|>\n\n")
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert preferences.format_pairs(t.limit(0), preferences.neighbour_pairs(t.limit(0))).count() == 0
    wide = preferences.with_other_endings(t.withColumns({"own": F.lit(1), "other": F.lit(2), "turns": F.lit(3)}).unionByName(t, allowMissingColumns=True))
    got = {r.pair_id: r for r in preferences.format_pairs(wide, preferences.neighbour_pairs(wide)).collect()}
    assert set(got) == {0, 1, 2, 4, 5}
    assert (got[0].prompt, got[0].chosen, got[0].rejected) == ("<|user|>\nhi\n", "<|assistant|>\nyes\n<|user|>\nwhy\n", "<|assistant|>\nno\n<|user|>\nwhy\n")
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == ("<|user|>\nhi\n", "<|assistant|>\nno\n", "")
    assert (got[4].prompt, got[4].chosen, got[4].rejected) == ("<|user|>\nx\n", "", "")


# 8

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site name</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy now, only today.</div><div id="cookie-notice">We use cookies, accept?</div>
<article><h1>Title &amp; more</h1><p><b>First line of the text, with words.<br><p>Second  line\n of the text, with &eacute;t&#233; &lt;tags&gt;.</p><div class="share">Share this</div><p>Third one, a <a href="x">link</a> inside.</p></article>
<section class="comments"><p>Nice article, thanks for it.</p></section><form><label>Mail</label><input value="x"></form><aside>Related things</aside><footer>&copy; somebody</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(i, "u", PAGE) for i in range(5)] + [(5, None, None), (6, "u", ""), (7, "u", "<p>unclosed <b>only"), (8, "u", "<" * 50 + "p>x</p" + "<div>" * 3000)], "page_id long, url string, html string")
    weights = html.train(pages)
    got = {r.page_id: r for r in html.extract(pages, weights).collect()}
    assert got[0].text == "Title & more\n\nFirst line of the text, with words.\n\nSecond line of the text, with été <tags>.\n\nThird one, a link inside."
    assert got[0].n_chars == len(got[0].text) and got[5].text == "" and got[6].text == "" and len(got) == 9
    assert html.train(pages.limit(0)).shape == (html.N_FEATURES,)


def test_long_and_broken_pages():
    import time

    n = 60_000
    pages = ["<a " * n, '<a "' * n, "<![CDATA[" * n, "<b>" * n + "</i>" * n, "<div>" + "<b>" * n + "<p>x</p>" * n, "<b>" + "<div>" * n + "</b>" * n, "<!--" * n, "<p>text</p>" * n, "<" * n, "<script>" * n]
    began = time.time()
    for page in pages:
        html.parse(page)
    rng = np.random.default_rng(0)
    html.minimum_cut(rng.random(10_000), rng.random(10_000), [(i, i + 1, 0.3) for i in range(9_999)])
    assert time.time() - began < 60
    assert [b.text for b in html.parse("<p>a < b <a href='x'>c</p><p>d<math>x</math> <a title=\"e>f\">g</a><![CDATA[<h>]]><p>i <a \"j>k")] == ["a < b c", "dx g<h>", "i k"]
    assert [b.text for b in html.parse("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></x><dl><dt>f<dd>g</dl>")] == list("abcdefg")


def test_pages_with_other_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (None, None, PAGE, "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    weights = html.train(pages)
    got = html.extract(pages, weights).collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1 and got[0].n_chars > 0
    assert html.extract(pages.limit(0), weights).count() == 0


def test_nothing_of_an_article_is_dropped(spark):
    """Cells, captions, labels, buttons and drawings in an article are kept; forms, headers outside it and the like go."""
    kept = ["1", "2", "Figure 1", "Figure 1 shows it.", "Press", "axis", "a", "z"]
    article = "<article><h1>Title</h1><table><caption>1</caption><tr><td>2</td></tr></table><figure><figcaption>Figure 1</figcaption></figure><label>Figure 1 shows it.</label><button>Press</button>"
    article += "<svg viewBox='0'><title>no</title><style>no</style><text>axis</text></svg><ul><li>a</li></ul><form><label>no</label><button>no</button></form><p>z</p></article>"
    pages = spark.createDataFrame([(i, "u", PAGE) for i in range(5)] + [(9, "u", "<header><button>no</button></header><label>no</label>" + article + "<fieldset>no</fieldset>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages, html.train(pages.where("page_id < 5"))).collect()}
    assert got[9].split("\n\n") == ["Title", *kept]


def silent_page(host: int, page: int) -> tuple[str, list[str]]:
    """A page whose elements say nothing of their part, and its main text; each host has classes and a depth of its own."""
    rng = np.random.default_rng(1000 * host + page)
    word = lambda: "".join(rng.choice(list("abdeilmnorstu"), int(rng.integers(3, 9))))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    c = [f"k{chr(97 + host)}{chr(110 + i)}" for i in range(4)]
    main = [" ".join(word() for _ in range(5)), *(text(int(rng.integers(12, 60))) for _ in range(int(rng.integers(2, 7)))), *(word() for _ in range(3)), text(20)]
    body = f"<h2>{main[0]}</h2>" + "".join(f"<p>{t}</p>" for t in main[1:-4]) + "<ul>" + "".join(f"<li>{t}</li>" for t in main[-4:-1]) + f"</ul><p>{main[-1]}</p>"
    top = f"<div class='{c[0]}'>" + "".join(f"<li><a href='/{t}'>{t}</a></li>" for t in ("Home", "News", "About us", f"Host {host}")) + "</div>"
    more = f"<div class='{c[2]}'>" + "".join(f"<div><a href='/{i}'>{word()} {word()} {word()}</a></div>" for i in range(4)) + "</div>"
    wrap = "<div>" * (host % 3)
    return f"<html><body>{wrap}{top}<div class='{c[1]}'>{body}</div>{more}<div class='{c[3]}'>\u00a9 host {host} \u00b7 all rights</div></body></html>", main


def test_main_text_learned_from_templates(spark):
    """No element and no class says anything: labels come from hosts' templates, and pages of other hosts are read by them."""
    made = [(100 * h + p, f"https://h{h}.example/{p}", *silent_page(h, p)) for h in range(12) for p in range(8)]
    pages = spark.createDataFrame([r[:3] for r in made], "page_id long, url string, html string")
    assert all(not (b.bad or b.good or b.worded) for r in made for b in html.parse(r[2]))
    placed = html._blocks_of(html.host_sample(pages, 40, 10), 20_000)
    assert len(placed) == sum(len(html.parse(r[2])) for r in made) and None not in html.template_labels(placed)
    weights = html.train(pages.where("page_id < 800"))
    got = {r.page_id: r.text for r in html.extract(pages.where("page_id >= 800"), weights).collect()}
    right = [got[i] == "\n\n".join(main) for i, _, _, main in made if i >= 800]
    assert len(right) == 32 and sum(right) >= 29
    assert html.host_sample(pages.where("page_id % 100 < 2"), 40, 10).count() == 0
    assert html.host_sample(pages, 3, 4).count() <= 12


def test_minimum_cut_equals_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        c, b = rng.random(n) * 3, rng.random(n) * 3
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        price = lambda y: sum(b[i] if y[i] else c[i] for i in range(n)) + sum(w for i, j, w in edges if y[i] != y[j])  # noqa: E731, B023
        assert price(html.minimum_cut(c, b, edges)) == pytest.approx(min(price(y) for y in itertools.product([0, 1], repeat=n)))


# 9


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: ". ".join(prose(rng, 9).capitalize() for _ in range(6)) + "."
    bad = lambda: " ".join(f"{w.upper()}!!" for w in prose(rng, 50).split())
    texts = [good() if i % 3 else bad() for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(0, None, 0), (None, 1, 0), (0, 0, 1)], "doc_id long, quality int, toxic int")
    model, stats = quality.train(docs(spark, texts), labels, F.col("doc_id") < 200)
    got = {r.doc_id: r.score for r in quality.scores(stats, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(200, 300)) and all(0 <= s <= 1 for s in got.values())
    odd = quality.measured(docs(spark, ODD))
    assert quality.scores(odd, model).count() == len(ODD)
    assert quality.keep(docs(spark, texts), model).count() == sum(s >= 0.5 for s in got.values())
    one, _ = quality.train(docs(spark, texts), labels.where("quality = 1"))
    assert {r.score for r in quality.scores(stats, one).collect()} == {1.0}
    none, _ = quality.train(docs(spark, texts), labels.limit(0))
    assert {r.score for r in quality.scores(stats, none).collect()} == {0.5}


def test_quality_equals_one_direct_fit(spark):
    """Scores against the same features, equations and pooling worked out at once in numpy."""
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(3, 60), 40) + rng.choice(("", ".", " !!", " | # 77", "\nA\nA")) * rng.randint(0, 9) for _ in range(240)] + [None, "", "x " * 400_000]
    y = np.array([float((t or "").count("!") > 0 or rng.random() < 0.2) for t in texts])
    table = docs(spark, texts).withColumns({"x": F.lit(1), "y": F.lit(2), "fold": F.lit(3)}).repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model, stats = quality.train(table, labels)
    got = {r.doc_id: r.score for r in quality.scores(stats, model).collect()}

    x = np.array([quality.statistics(t) for t in texts])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    g = np.random.default_rng(7)
    w, b = g.normal(0, np.sqrt(0.1), (20, 256)), g.uniform(0, 2 * np.pi, 256)
    z = np.hstack([np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b) * np.sqrt(2 / 256), np.ones((len(x), 1))])
    folds = {r.doc_id: r.f for r in spark.range(len(texts)).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("f")).collect()}
    fold = np.array([folds[i] for i in range(len(texts))])
    solve = lambda own: np.linalg.solve(z[own].T @ z[own] + 1e-4 * len(x) / 257 * np.eye(257), z[own].T @ y[own])
    apart = np.where(fold == 0, z @ solve(fold == 1), z @ solve(fold == 0))
    at = np.clip((apart + 1) / 3 * 2000, 0, 1999).astype(int)
    used = np.unique(at)
    pools = quality.isotonic(-1 + (used + 0.5) * 3 / 2000, np.array([y[at == u].mean() for u in used]), np.array([(at == u).sum() for u in used]))
    want = np.clip(np.interp(z @ solve(fold >= 0), *pools), 0, 1)
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-4)


def test_isotonic_pools():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert y.tolist() == [0.0, 0.5, 1.0] and (np.diff(x) > 0).all() or y.tolist() == [0.0, 0.5, 1.0, 1.0]


# 10


def brute_components(texts):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def near_copies(rng):
    texts = list(ODD) + ["A b", "a B", "same five words right here", "Same five words right here"]
    passage = prose(rng, 30)
    for _ in range(6):
        base = prose(rng, rng.randint(8, 80)).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(1000)}"
            texts.append(" ".join(copy) + (f" {passage}" if rng.random() < 0.3 else ""))
    base = prose(rng, 60).split()  # one large family around the limit
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = f"q{rng.randrange(10)}"
        texts.append(" ".join(copy))
    return texts + [texts[20]] * 30


def test_jaccard_components(spark):
    rng = random.Random(7)
    texts = near_copies(rng)
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.jaccard_components(docs(spark, texts).repartition(5)).collect()}
    want = brute_components(texts)
    assert got == dict(enumerate(want))
    table = docs(spark, texts)
    twice = table.unionByName(table.limit(5)).unionByName(spark.createDataFrame([(None, "x", None, None, None)], SCHEMA))
    kept = near_duplicates.keep_one(twice)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c in want}) and kept.where("doc_id is null").count() == 1
    assert near_duplicates.jaccard_components(table.limit(0)).count() == 0
    assert near_duplicates.jaccard_components(docs(spark, ["one two three four five six", "completely different words stand here today"])).count() == 2


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_repeated_ids_count_once(spark, parts):
    rows = [(1, "z", None), (1, "a b c d e f g h i", 5), (1, "a b c d e f g h i", 6), (2, "a b c d e f g h i j", None), (3, "other words stand here now", 1), (3, None, 2), (None, "z", 3)]
    table = spark.createDataFrame(rows, "doc_id int, text string, n_chars long").repartition(parts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.jaccard_components(table).collect()}
    assert got == {1: (5, 1), 2: (6, 1), 3: (1, 3)}
    kept = sorted((tuple(r) for r in near_duplicates.keep_one(table).collect()), key=str)
    assert kept == [(1, "a b c d e f g h i", 6), (3, "other words stand here now", 1), (None, "z", 3)]


def test_frequent_shingles_and_percolating_families(spark):
    """All documents hold one passage, most of which are little else, so that prefixes reach frequent shingles."""
    rng = random.Random(11)
    passage = prose(rng, 25, 10_000)
    texts = [f"{passage} {prose(rng, rng.randint(1, 12), 60)}" for _ in range(90)]
    chain = prose(rng, 400, 10_000).split()  # each shares half with its neighbours: a family without a link
    texts += [" ".join(chain[i : i + 24]) for i in range(0, 376, 12)]
    texts += [" ".join(chain[i : i + 24] + ["tail"] * (i % 3)) for i in range(0, 376, 12)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.jaccard_components(docs(spark, texts).repartition(3)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_components_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT_DEGREE", 20)
    edges = [(900, i) for i in range(100, 160)] + [(i, i + 500) for i in range(100, 160)] + [(7, 659), (1, 2)]
    got = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys([900, *range(100, 160), *range(600, 660), 7], 7) | {1: 1, 2: 1}


def test_components_of_a_chain(spark):
    rng = random.Random(1)
    order = list(range(60))
    rng.shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in near_duplicates.components(edges).collect()}
    assert got == dict.fromkeys(range(60), 0) | {100: 100, 101: 100}


# the pipeline


def test_pipeline_stages_keep_what_they_should(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    rng = random.Random(2)
    clean = [prose(rng, 60, 5000) for _ in range(20)]
    table = docs(spark, [*clean, clean[0], None])
    out = corpus_pipeline.STAGES[1][1](spark, table, "")
    assert out.columns == table.columns and out.count() == 21
    out = corpus_pipeline.STAGES[3][1](spark, table, "")
    assert out.columns == table.columns and out.count() == 22
    last = corpus_pipeline.STAGES[4][1](spark, table, "")
    assert last.columns == [*table.columns, "ids", "n_tokens"] and last.count() == 22


CLASHING = ("ids", "n_tokens", "score", "print", "w", "x", "n", "frag", "prefix", "class", "component_id", "begins", "shard", "predicted", "spans", "word", "key", "count")


def test_clashing_columns_change_nothing(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [prose(rng, 40) for _ in range(6)] + [None]
    plain = docs(spark, texts)
    wide = plain.withColumns({c: F.lit(7) for c in CLASHING})
    items = spark.createDataFrame([(1, texts[0], 9)], "item_id long, text string, w int")
    assert sorted(map(str, decontaminate.find(wide, items).collect())) == sorted(map(str, decontaminate.find(plain, items).collect()))
    kept = decontaminate.clean(wide, items)
    assert kept.columns == wide.columns and kept.count() == 6
    assert sorted(near_duplicates.jaccard_components(wide).collect()) == sorted(near_duplicates.jaccard_components(plain).collect())
    assert near_duplicates.keep_one(wide).columns == wide.columns
    assert pii.redact(wide, pii.train(wide)).columns == wide.columns
    last = corpus_pipeline.STAGES[4][1](spark, wide, "")
    assert set(last.columns) == {*wide.columns} and last.where("doc_id = 0").collect()[0].n_tokens > 7


def test_texts_of_a_megabyte(spark, tmp_path):
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [prose(rng, 250_000, 5000), "x" * 100_000 + " é" * 300_000, "word " * 200_000]
    table = docs(spark, texts)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(TIK), special_tokens={})
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [r.n_tokens for r in bpe.digests(table, TIK, P.PATTERN).orderBy("doc_id").collect()] == [len(enc.encode_ordinary(t)) for t in texts]
    planes.write(table, f"{tmp_path}/long", P.path("byte_bpe_50k.json"), ordinary=False)
    assert [r.n_tokens for r in planes.read(spark, f"{tmp_path}/long").orderBy("doc_id").collect()] == [len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    found = decontaminate.find(table, spark.createDataFrame([(1, " ".join(texts[0].split()[777:795]))], "item_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_words for r in found] == [250_000, 300_001, 200_000] and found[0].n_hit >= 18
    n = [r.n_shingles for r in near_duplicates.jaccard_components(table).orderBy("doc_id").collect()]
    assert n[2] == 1 and n[1] == 2 and n[0] > 249_000


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    plain = docs(spark, ["a b c", None])
    none, twice = plain.limit(0), plain.unionByName(plain)
    planes.write(none, f"{tmp_path}/none", P.path("byte_bpe_50k.json"))
    assert planes.read(spark, f"{tmp_path}/none").count() == 0
    planes.write(twice, f"{tmp_path}/twice", P.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in planes.read(spark, f"{tmp_path}/twice").collect()) == [(0, 0, 4), (0, 4, 4), (1, 8, 1), (1, 9, 1)]
    assert bpe.digests(none, TIK, P.PATTERN).count() == 0 and bpe.digests(twice, TIK, P.PATTERN).count() == 4
    assert quality.measured(none).count() == 0 and quality.measured(twice).count() == 4
    model, _ = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.keep(none, model).count() == 0 and quality.keep(twice, model).count() == 4
    assert pii.report(twice, pii.Detector(None, {}, 1.0)).count() == 4
    with pytest.raises(ValueError):
        near_duplicates.jaccard_components(plain.withColumn("doc_id", F.lit("x")))


def test_pipeline_of_empty_and_null_tables(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("empty", []), ("nulls", [(None, None, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert sorted(((r.doc_id, r.text, r.n_tokens) for r in out.collect()), key=str) == [(r[0], r[1], 0) for r in sorted(rows, key=str)][:: 1]


def plain_ids(text, ranks):
    pattern = P.PATTERN.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(" ?a-zA-Z+", " ?[a-zA-Z]+").replace(" ?0-9+", " ?[0-9]+")
    out = []
    for piece in re.findall(pattern, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[x] for x in parts]
    return out


def test_pipeline_equals_a_plain_chain(spark, tmp_path, monkeypatch):
    """run() on labels, near copies, benchmark passages and personal data, against plain Python with the same models."""
    import corpus_pipeline

    rng = random.Random(12)
    good = lambda: ". ".join(prose(rng, 9, 3000).capitalize() for _ in range(6)) + "."
    bad = lambda: " ".join(f"{w.upper()}!!" for w in prose(rng, 50, 3000).split())
    texts = [good() if i % 3 else bad() for i in range(90)]
    for i in range(1, 31, 3):
        texts.append(texts[i].rsplit(" ", 1)[0] + " Other.")
    items = [(1, prose(rng, 20)), (2, prose(rng, 15))]
    texts += [f"{good()} {items[i % 2][1]}." for i in range(6)]
    texts += [f"{good()} Write to some.body{i}@example.org or call +1 (988) 555-24{i}5." for i in range(6)]
    docs(spark, texts).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fitted = {}
    for module in (quality, pii):
        train = module.train
        monkeypatch.setattr(module, "train", lambda *a, _name=module.__name__, _train=train, **k: fitted.setdefault(_name, _train(*a, **k)))
    got = {r.doc_id: (r.text, list(r.ids), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model, detector = fitted[quality.__name__][0], fitted[pii.__name__]

    fine = [i for i, t in enumerate(texts) if model.score(np.array([quality.statistics(t)]))[0] >= 0.5]
    single = [fine[k] for k, (_, root) in enumerate(brute_components([texts[i] for i in fine])) if root == k]
    clean = []
    for i in single:
        n, hit, _ = brute_hits(texts[i], items)
        if not (hit and 20 * hit >= n):
            clean.append(i)
    assert len(texts) > len(fine) > len(single) > len(clean) > 6
    ranks, want = bpe.load_ranks(TIK), {}
    for i in clean:
        text, marks = texts[i], {}
        for a, b, kind in detector.spans(text)[1]:
            first = next((marks[x] for x in range(a, b) if x in marks), (a, kind))
            marks |= {x: first for x in range(a, b) if x not in marks}
        text = "".join(text[x] if x not in marks else f"[{marks[x][1].upper()}]" if marks[x][0] == x else "" for x in range(len(text)))
        ids = plain_ids(text, ranks)
        want[i] = (text, ids, len(ids))
    assert got == want and sum("[EMAIL]" in t for t, _, _ in got.values()) == 6
