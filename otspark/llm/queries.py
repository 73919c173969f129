"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otspark.llm import decontamination, flac, html_text, importance_resampling, lm_score, pii, prefix_trie, simhash_dedup, source_mix, substring_dedup, token_counts, toxicity, voronoi_join
from otspark.llm.common import table


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(table(spark, sf_dir, "documents"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_join.top_k(table(spark, sf_dir, "embeddings"))


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 gives that SQL can give too: sizes and targets."""
    return op6_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def llm_pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 gives that SQL can give too: counts of the base kinds."""
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_html_text, op3_lm_score, op4_decontamination, op5_pii, op6_source_mix, op7_toxicity, op8_substring_dedup, op9_simhash_components, op10_flac_media, op11_prefix_trie, op12_importance_resampling, op13_voronoi_top_k, llm_mix_targets, llm_pii_base)
}

#: CRC-32 (polynomial 0xEDB88320, reflected): the table of one byte's values, and the sum of a text's UTF-8 bytes, as SQL.
_CRC_TABLE = "SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crcs FROM range(256) r(b)"


def _crc32(text: str, crcs: str) -> str:
    """SQL for the CRC-32 of a text that is not empty, with the table."""
    given = f"list_transform(range(1, 2 * CAST(strlen({text}) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {given}), lambda c, b: xor(c >> 8, {crcs}[xor(c & 255, b) + 1])), 4294967295)"


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) ELSE 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) // 10 + 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) % 10 END)) % 10 = 0"
#: SQL where it can express all columns; the operators' other columns are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    # the level of the targets is the largest of those that hold when the sources that stop first have stopped, for each number of these
    "llm_mix_targets": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
      s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
      w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS total FROM s),
      k AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped, sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
      l AS (SELECT max((1.5 * total - stopped) / open) AS level FROM k)
      SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(CAST(least(2.0 * source_size, level * weight) AS DOUBLE), 3) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, l""",
    "llm_pii_base": f"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
      CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right('000' || p, 3) AS INTEGER) > 255)) = 0)) AS BIGINT) AS n_ip,
      CAST(len(list_filter(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
      CAST(len(list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    # a node is the list of its turns
    "op11_prefix_trie": rf"""WITH crc AS ({_CRC_TABLE}),
      own AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
      begun AS (SELECT own.*, {_crc32("CAST(c AS VARCHAR)", "crcs")} % 4 AS h FROM own, crc),
      built AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM begun a LEFT JOIN own b ON b.c = a.c - a.c % 20),
      prefixes AS (SELECT c, len(turns) AS longest, unnest(range(0, len(turns) + 1)) AS depth, turns FROM built),
      nodes AS (SELECT turns[1:depth] AS node, depth, min(c) AS conv_id, count(*) AS n_convs, max(longest) = depth AS leaf, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE longest = depth), '')) AS ends_sha256,
        (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(turns[depth].t), '[^\x20\x09-\x0D]+')) END AS saved FROM prefixes GROUP BY 1, 2),
      above AS (SELECT node, saved, leaf, depth, unnest(range(0, depth + 1)) AS d FROM nodes),
      folded AS (SELECT node[1:d] AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves, count(*) FILTER (WHERE depth = d + 1) AS n_children FROM above GROUP BY 1)
      SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, f.n_children, f.n_leaves, CAST(f.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
      FROM nodes n JOIN folded f ON n.node = f.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]""",
    "op12_importance_resampling": rf"""WITH crc AS ({_CRC_TABLE}),
      texts AS (SELECT 'd' AS kind, row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
      lists AS (SELECT kind, doc, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
      features AS (SELECT kind, doc, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))))) AS f FROM lists),
      hashed AS (SELECT f, {_crc32("f", "crcs")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc),
      counts AS (SELECT kind, doc, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL),
      sums AS (SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 'b'), 0) AS t FROM range(10000) r(b) LEFT JOIN counts ON bucket = b GROUP BY b),
      gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + CAST(10000 AS DOUBLE)) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain FROM sums),
      weights AS (SELECT doc, sum(n) AS n_features, sum(n * gain) AS weight FROM counts JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc),
      scored AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM lists LEFT JOIN weights USING (doc) WHERE kind = 'd'),
      placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE able) OVER () AS n FROM scored)
      SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM placed""",
    "op13_voronoi_top_k": """WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.n, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.n <> d.n WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
      SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
