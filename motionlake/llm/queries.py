"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import bpe, codes, decontaminate, html, language, near_duplicates, packing, pii, planes, preferences, quality, runs, topk
from motionlake.llm.common import holdout, shared_path, table

TIKTOKEN = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(found).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wi AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM wi),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN wi USING (win, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS sha FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "op2-tokens")
    planes.write(table(spark, sf_dir, "documents"), path, TOKENIZER, ordinary=False)
    return planes.read(spark, path)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = table(spark, sf_dir, "documents"), holdout("doc_id", 4, 2)
    field = language.train(docs, ~apart)
    return language.predict(docs, field).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


OP4_SQL = r"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id AND q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.train(docs))


def op6_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TIKTOKEN, public_tokenizers.PATTERN)


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no preferences: each conversation is preferred to itself with another one's last answer."""
    turns = preferences.with_other_endings(table(spark, sf_dir, "conversations"))
    found = preferences.format_pairs(turns, preferences.neighbour_pairs(turns))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


OP7_SQL = r"""
WITH o AS MATERIALIZED (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
la AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) AS r FROM o WHERE role = 'assistant') WHERE r = 1),
ch AS (SELECT o.*, o.role = 'assistant' AND o.turn IS NOT DISTINCT FROM a.turn AND a.text = o.text AS e, b.text AS other FROM o LEFT JOIN la a ON a.conv_id = o.conv_id LEFT JOIN la b ON b.conv_id = o.conv_id + 1),
tw AS (SELECT 2 * conv_id AS conv_id, turn, role, text FROM o UNION ALL SELECT DISTINCT 2 * conv_id + 1, turn, role, CASE WHEN e THEN other ELSE text END FROM ch WHERE NOT coalesce(e, FALSE) OR other IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id // 2 AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text FROM tw),
p AS (SELECT pair_id, max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id FROM c GROUP BY pair_id),
n AS (SELECT pair_id, min(coalesce(x.i, y.i)) FILTER (x.text IS NULL OR y.text IS NULL OR x.text <> y.text OR x.role <> y.role) AS d, count(*) AS most
      FROM (SELECT * FROM c WHERE conv_id % 2 = 0) x FULL JOIN (SELECT * FROM c WHERE conv_id % 2 = 1) y USING (pair_id, i) GROUP BY pair_id),
k AS (SELECT p.*, coalesce(d - 1, most) AS prompt_turns FROM p JOIN n USING (pair_id)),
t AS (SELECT k.*, c.conv_id, i, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS r, length(text) + 1 AS own,
        i <= prompt_turns AS pre FROM k JOIN c USING (pair_id)),
m AS (SELECT *, sum(length(r)) OVER (PARTITION BY conv_id, pre ORDER BY i) AS stop FROM t)
SELECT pair_id, chosen_id, rejected_id, CAST(prompt_turns AS INTEGER) AS prompt_turns,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (pre AND conv_id % 2 = 0), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (NOT pre AND conv_id % 2 = 0), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (NOT pre AND conv_id % 2 = 1), '') AS rejected,
  coalesce(string_agg(CAST(stop - own AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY i) FILTER (NOT pre AND conv_id % 2 = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(stop - own AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY i) FILTER (NOT pre AND conv_id % 2 = 1 AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id, chosen_id, rejected_id, prompt_turns
"""


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = holdout("doc_id", 3, 1)
    model, stats = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~apart)
    return quality.scores(stats, model).select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of a document bears loss, so the limit on such tokens is that of all."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1, limits=packing.Limits(tokens=2048, segments=128, loss=2048))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(codes.integers(table(spark, sf_dir, "embeddings")))
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    rows = codes.with_label_error(coded)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op12_sql(rounds: int = 4) -> str:
    """Plain k-means: every part against every entry, in each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, part, min(d) AS d, arg_min(entry, d * 256 + entry) AS entry FROM (SELECT rid, p.part, entry,
  CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) AS d FROM p JOIN c{r} c ON c.part = p.part) GROUP BY rid, part)""")
        if r < rounds:
            steps.append(f"""n{r} AS (SELECT part, entry, list(f ORDER BY pos) AS x FROM (SELECT part, entry, pos, floor(sum(y) / count(*)) AS f
  FROM (SELECT p.part, entry, unnest(x) AS y, unnest(range(len(x))) AS pos FROM a{r} JOIN p ON p.rid = a{r}.rid AND p.part = a{r}.part) GROUP BY part, entry, pos) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n ON n.part = c.part AND n.entry = c.entry)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, list_slice(v, part * (len(v) // 4) + 1, (part + 1) * (len(v) // 4)) AS x FROM v, range(4) t(part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 256),
{",\n".join(steps)},
b AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS pos FROM c{rounds})),
e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (rid), b
"""


def planted_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by a hash of its id, repeats a stretch of its words from some word on to its end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"), planted_repeats)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_planes": op2_token_planes,
    "op3_language": op3_language,
    "op4_top_k": op4_top_k,
    "op5_personal_data": op5_personal_data,
    "op6_merge_replay": op6_merge_replay,
    "op7_preferences": op7_preferences,
    "op8_main_text": op8_main_text,
    "op9_quality": op9_quality,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_packing": op11_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op4_top_k": OP4_SQL,
    "op7_preferences": OP7_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op12_vector_codes": _op12_sql(),
}
