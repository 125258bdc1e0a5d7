"""The queries of this package, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_FILE = "byte_bpe_50k.json"
WORD_FILE = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_bpe_round_trip")
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_documents(spark, sf_dir), vocabulary(BYTE_FILE), public_tokenizers.PATTERN)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), vocabulary(BYTE_FILE), end_id=1)


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitplanes import read_token_files, write_token_files

    folder = scratch_path(spark, "tokens")
    write_token_files(_documents(spark, sf_dir), folder, vocabulary(WORD_FILE), end_id=2, space="drop")
    return read_token_files(spark, folder)


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import verdicts

    return verdicts(_documents(spark, sf_dir))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_documents(spark, sf_dir))


@query("op10_compression_quality")
def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression import fit, score

    docs = _documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP2_SQL = """
WITH normal AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), hashed AS (
    SELECT doc_id, t, sha256(t) AS text_sha256 FROM normal
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY t)
"""


@query("op2_exact_dedup", OP2_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recipes import exact_groups

    return exact_groups(_documents(spark, sf_dir)).drop("row_id", "row_hash")


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import classify

    return classify(_documents(spark, sf_dir))


@query("op8_pii_surrogates")
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace

    # a key for runs on the given tables; users bring their own secret
    return replace(_documents(spark, sf_dir), key=b"surrogates of the given tables")


OP13_SQL = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM cut WHERE len(w) > 0) GROUP BY ALL
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM cut LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""


@query("op13_ngram_jaccard_join", OP13_SQL)
def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_groups

    return similar_groups(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP11_SQL = r"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w,
        row_number() OVER () AS row_no
    FROM documents
), words AS (
    SELECT lang, source, row_no, unnest(w) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT row_no) >= 3
), langs AS (
    SELECT lang, count(*) AS v, sum(c)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), own AS (
    SELECT lang, source, sum(n)::HUGEINT AS own FROM counts GROUP BY ALL
), shares AS (  -- every group and kept term of its lang
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(own, 0) + v) AS p,
        1 + (1000000000::HUGEINT * (k.c + 1)) // (total + v) AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
), rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
) WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence_audit", OP11_SQL)
def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_documents(spark, sf_dir))


OP12_SQL = r"""
WITH turns AS (
    SELECT conv_id, md5(concat(length(role), ':', role, text)) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat(length(role), ':', role, text))) AS place
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (  -- the checksum of the id's digits, bit by bit
    SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), moved AS (
    SELECT c.conv_id, 0 AS part, place, key, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND place <= h
    UNION ALL
    SELECT c.conv_id, 1, place, key, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h
), sequences AS (
    SELECT conv_id, coalesce(k, []) AS k, coalesce(w, []) AS w FROM convs LEFT JOIN (
        SELECT conv_id, list(key ORDER BY part, place) AS k, list(words ORDER BY part, place) AS w FROM moved GROUP BY conv_id
    ) USING (conv_id)
), members AS (
    SELECT conv_id, d, k[1:d] AS node, coalesce(w[d], 0) AS words, d = len(k) AS ends FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM sequences)
), nodes AS (
    SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY ALL
), kids AS (
    SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), whole AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)
), below AS (
    SELECT node[1:a] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM whole) GROUP BY ALL
)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN below USING (node) LEFT JOIN nodes p ON w.d > 0 AND p.node = w.node[1:w.d - 1]
"""


@query("op12_conversation_prefix_trie", OP12_SQL)
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_trie import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("key")
