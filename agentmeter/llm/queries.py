"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, langid, lm, mixing, neardup, pii, quality, tokens, topk, toxicity, trie, urlfilter
from .common import fold, table

#: Fixed by the contract of op5.
URL_RULES = (
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    return quality.score(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pieces(path: str | None = None) -> list[str]:
    """The pieces of a public sentencepiece vocabulary; path: of its file, which the driver reads."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)]


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, pieces(), ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    return lm.score(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """path: of the vocabulary file; the driver reads it and sends it on."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return codes.compress(rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    return toxicity.score(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {f.__name__: f for f in (op1_quality, op2_topk, op3_langid, op4_lm, op5_urls, op6_neardup, op7_decontam, op8_mixing, op9_tokens, op10_pii, op11_trie, op12_codes, op13_toxicity)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op5_urls": OP5_SQL, "op6_neardup": OP6_SQL, "op7_decontam": OP7_SQL, "op11_trie": OP11_SQL, "op12_codes": OP12_SQL}


OP2_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5
"""

OP5_SQL = r"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
       ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path,
       (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       coalesce((SELECT max_by(verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM
       (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
cover AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""

#: All pairs that share a shingle, and what each document reaches over the links.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.far),
m AS (SELECT id, min(far) AS component_id FROM r GROUP BY 1)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = id
"""


#: Prefixes as digests of their turns; DuckDB has no crc32, which is made bit by bit.
OP11_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS t,
       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
u(c, s, i, x) AS (SELECT DISTINCT c, CAST(c AS VARCHAR), 0, 4294967295::BIGINT FROM o
       UNION ALL SELECT c, s, i + 1, (SELECT list_reduce(list_prepend(xor(x, ascii(s[i + 1])), range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) FROM u WHERE i < length(s)),
h AS (SELECT c, xor(x, 4294967295) % 4 AS h, (SELECT count(*) FROM o WHERE o.c = u.c - u.c % 20) AS bases FROM u WHERE i = length(s)),
e AS (SELECT h.c, p, t, w FROM h JOIN o ON o.c = h.c - h.c % 20 AND p <= h UNION ALL
      SELECT h.c, p - h + least(h, bases), t, w FROM h JOIN o ON o.c = h.c AND p > h),
s AS (SELECT h.c, coalesce(list(t ORDER BY p) FILTER (p IS NOT NULL), []) AS t, coalesce(list(w ORDER BY p) FILTER (p IS NOT NULL), []) AS w FROM h LEFT JOIN e USING (c) GROUP BY h.c),
m AS (SELECT c, d, sha256(array_to_string(t[1:d], ',')) AS node, sha256(array_to_string(t[1:d - 1], ',')) AS up, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS w, d = len(t) AS last FROM s, unnest(range(0, len(t) + 1)) AS r(d)),
n AS (SELECT node, d, CASE WHEN d > 0 THEN any_value(up) END AS up, min(c) AS c, count(*) AS n, any_value(w) AS w,
      sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends FROM m GROUP BY node, d),
k AS (SELECT up, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
a(node, top) AS (SELECT node, node FROM n UNION ALL SELECT a.node, n.up FROM a JOIN n ON n.node = a.top WHERE n.up IS NOT NULL),
t AS (SELECT top, count_if(coalesce(kids, 0) = 0) AS leaves, sum((n - 1) * w) AS saved FROM a JOIN n USING (node) LEFT JOIN k ON k.up = a.node GROUP BY top)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n p ON p.node = n.up LEFT JOIN k ON k.up = n.node JOIN t ON t.top = n.node
"""


def _op12_sql(rounds: int = 4) -> str:
    """Distances as dot products of doubles, exact below 2^53; a round of assignment and update after the other."""
    steps = [
        r"""WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS v FROM k, range(4) AS t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, v AS c FROM p WHERE r <= 256)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT p.r, p.part, min(struct_pack(d := list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c), e := e)) AS best FROM p JOIN b{i} USING (part) GROUP BY 1, 2)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT part, e, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS c FROM (SELECT p.part, best.e AS e, i, sum(CAST(v[i] AS BIGINT)) AS s, count(*) AS n
       FROM a{i} JOIN p USING (r, part), range(1, 65) AS t(i) WHERE i <= len(v) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, e))"""
            )
    return ",\n".join(steps) + f""",
s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}),
f AS (SELECT r, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), s
"""


OP12_SQL = _op12_sql()
