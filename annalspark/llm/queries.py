"""The thin queries of this package: each reads its whole table and gives its operator's full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship
from . import bytebpe, crosstok, decontaminate, infilling, jaccard, lm, packing, passages, pii, quality, tokenfiles, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_pii_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op3_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.labels_by_document(pages, _table(spark, sf_dir, "labels"))).drop("share")


def op6_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.materialise(_table(spark, sf_dir, "documents"))


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))[0]


def op8_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op9_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(_table(spark, sf_dir, "embeddings"))


def op10_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(_table(spark, sf_dir, "documents"))


def op12_suffix_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.counted(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bestfit_packing": op1_bestfit_packing,
    "op2_pii_skip_chain_crf": op2_pii_skip_chain_crf,
    "op3_paragraph_minhash": op3_paragraph_minhash,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_url_template_tree": op5_url_template_tree,
    "op6_training_order_shards": op6_training_order_shards,
    "op7_quality_resampling": op7_quality_resampling,
    "op8_jaccard_metric_join": op8_jaccard_metric_join,
    "op9_robust_pruned_graph": op9_robust_pruned_graph,
    "op10_deleted_interpolation": op10_deleted_interpolation,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_suffix_transducer": op12_suffix_transducer,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LEVEL = """,
c{l} AS MATERIALIZED (SELECT host, prefix, {seg} AS seg, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM t{p} GROUP BY ALL),
n{l} AS (SELECT host, prefix, sum(CASE WHEN n < 8.0 THEN 1 ELSE 0 END) AS rare, sum(lab) AS all_lab, sum(bad) AS all_bad FROM c{l} GROUP BY ALL),
o{l} AS MATERIALIZED (SELECT c.*, rare, all_lab, all_bad, CASE WHEN n < 8.0 AND rare >= 20 THEN '*' ELSE seg END AS own FROM c{l} c JOIN n{l} USING (host, prefix)),
k{l} AS MATERIALIZED (SELECT *, CAST(floor(CAST(32.0 AS DOUBLE) * (bad + CAST(4.0 AS DOUBLE) * CASE WHEN all_lab > 0 THEN all_bad / all_lab ELSE 0.0 END) / (lab + CAST(4.0 AS DOUBLE))) AS BIGINT) AS bucket
  FROM (SELECT host, prefix, own, sum(lab) AS lab, sum(bad) AS bad, max(all_lab) AS all_lab, max(all_bad) AS all_bad FROM o{l} GROUP BY ALL)),
b{l} AS (SELECT host, prefix, bucket, sum(lab) AS lab, sum(bad) AS bad FROM k{l} GROUP BY ALL),
w{l} AS (SELECT host, prefix, bucket, sum(lab) OVER below AS l, sum(bad) OVER below AS lb, sum(lab) OVER whole AS t, sum(bad) OVER whole AS tb FROM b{l}
  WINDOW whole AS (PARTITION BY host, prefix), below AS (PARTITION BY host, prefix ORDER BY bucket ROWS UNBOUNDED PRECEDING)),
z{l} AS (SELECT host, prefix, bucket, abs(lb / l - (tb - lb) / (t - l)) / sqrt(tb / t * (1 - tb / t) * (1 / l + 1 / (t - l))) AS z FROM w{l} WHERE l > 0 AND t > l AND tb > 0 AND tb < t),
u{l} AS (SELECT host, prefix, bucket AS cut FROM z{l} WHERE z >= 3.0 QUALIFY row_number() OVER (PARTITION BY host, prefix ORDER BY z DESC, bucket) = 1),
s{l} AS MATERIALIZED (SELECT host, prefix, own, coalesce(bucket > cut, FALSE) AS above, count(*) OVER (PARTITION BY host, prefix, coalesce(bucket > cut, FALSE)) AS kids FROM k{l} LEFT JOIN u{l} USING (host, prefix)),
t{l} AS MATERIALIZED (SELECT t.host, t.raw, t.n, t.lab, t.bad, t.prefix || '/' || CASE WHEN kids = 1 THEN o.own WHEN above THEN '*!' ELSE '*' END AS prefix
  FROM t{p} t JOIN o{l} o ON t.host = o.host AND t.prefix = o.prefix AND ({seg}) = o.seg JOIN s{l} s ON s.host = o.host AND s.prefix = o.prefix AND s.own = o.own)"""

_OP5 = """WITH u AS (SELECT page_id, url, url IS NOT NULL AND contains(url, '://') AS fine, substr(url, instr(url, '://') + 3) AS rest FROM pages),
h AS (SELECT page_id, url, CASE WHEN fine THEN regexp_extract(rest, '^[^/?#]*') ELSE '' END AS h0, rest, fine FROM u),
b AS (SELECT page_id, url, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN fine THEN regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') ELSE '' END AS path FROM h),
r AS (SELECT *, array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(regexp_extract(s, '^([0-9a-f]{8,})([.][0-9A-Za-z]+)?$', 1), '[0-9]')
  THEN '*' || regexp_extract(s, '^([0-9a-f]{8,})([.][0-9A-Za-z]+)?$', 2) ELSE regexp_replace(s, '[0-9]+', '*', 'g') END), '/') AS raw,
  TRY_CAST(nullif(regexp_extract(url, '^[^?#]*/([0-9]+)[^/]*/?(?:[?#].*)?$', 1), '') AS BIGINT) AS doc_id FROM b),
l AS (SELECT doc_id, max(CASE WHEN quality <> 1 OR toxic <> 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
p AS (SELECT r.*, l.bad FROM r LEFT JOIN l USING (doc_id)),
t0 AS MATERIALIZED (SELECT host, raw, CAST(count(*) AS DOUBLE) AS n, CAST(count(bad) AS DOUBLE) AS lab, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, '' AS prefix FROM p GROUP BY host, raw)""" + "".join(
    _LEVEL.format(l=i, p=i - 1, seg=f"coalesce(list_extract(string_split(raw, '/'), {i} + 1), '')" if i < 4 else "coalesce(array_to_string(string_split(raw, '/')[5:], '/'), '')") for i in (1, 2, 3, 4)
) + """,
g AS (SELECT coalesce(sum(bad) / nullif(sum(lab), 0), 0.0) AS overall FROM t4),
e AS (SELECT host, (sum(bad) + 4.0 * any_value(overall)) / (sum(lab) + 4.0) AS at_host FROM t4, g GROUP BY host),
f AS (SELECT host, prefix AS template, (sum(bad) + 4.0 * any_value(at_host)) / (sum(lab) + 4.0) AS share FROM t4 JOIN e USING (host) GROUP BY host, prefix),
rules(rule, verdict, rh, rp) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
x AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM b JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, x.rule, coalesce(x.verdict, CASE WHEN f.share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, f.template
FROM p JOIN t4 ON p.host = t4.host AND p.raw = t4.raw JOIN f ON f.host = t4.host AND f.template = t4.prefix LEFT JOIN x ON x.page_id = p.page_id AND x.k = 1"""

_OP8 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.doc_id)
SELECT c.doc_id, any_value(CAST(len(s.g) AS BIGINT)) AS n_shingles, min(c.root) AS component_id FROM c JOIN s ON s.doc_id = c.doc_id GROUP BY c.doc_id"""

_OP9 = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
f AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM f a, f b WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
c AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.vec_id),
k AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY 1), d AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT k.vec_id, coalesce(d.n, 0) AS n_links, component_id, k.vec_id = component_id AS kept FROM k LEFT JOIN d USING (vec_id)"""

_OP13 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
k AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4,
  regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM k),
p AS (SELECT doc_id, text, n, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

#: The others have no SQL form (models, tokenizers, alignments); README says what `tests/llm` compares them with.
ORACLE_SQL: dict[str, str] = {"op5_url_template_tree": _OP5, "op8_jaccard_metric_join": _OP8, "op9_robust_pruned_graph": _OP9, "op13_fill_in_middle": _OP13}
