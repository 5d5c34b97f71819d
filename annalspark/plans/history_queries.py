"""Queries over history-shaped views of the driver's tables, with DuckDB oracles.

Orders are revisions (a customer's orders form a chain), lineitems are path operations, events are per-file revisions
and documents are blobs.  Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import asof, cluster, diff, graph, refs, report
from ..storage import Rounds, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
GREEDY = 259_200
GAP = 86_400


def query(oracle: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


# --- views ----------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Epoch seconds of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def file_revs(spark: SparkSession, sf_dir: str, modulus: int = 0) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("author"), F.col("event_type").alias("log"), (k % modulus if modulus else k).alias("path"), F.col("event_id").alias("rev"), seconds("ts").alias("date"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent (the customer's order before it), customer and the order's columns."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("node", F.col("o_orderkey")).withColumn("parent", F.lag("o_orderkey").over(w))


def line_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """atom, path, blob: one row per order and path."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("atom"), (F.col("l_partkey") % 50).alias("path")).agg(F.min(F.col("l_quantity").cast("bigint")).alias("blob"))


def order_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, steps = line_ops(spark, sf_dir), chain(spark, sf_dir).filter("parent is not null").select("node", "parent")
    base = ops.join(steps, F.col("atom") == F.col("parent")).select(F.col("node").alias("atom"), "path", "blob")
    child = ops.join(steps.select(F.col("node").alias("atom")), "atom")
    return diff.snapshot_diff(base, child)


_REVS = """revs AS (SELECT user_id AS author, event_type AS log, {path} AS path, event_id AS rev, epoch_us(ts) // 1000000 AS date FROM events)"""
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_CHAIN = "chain AS (SELECT *, o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders)"
_OPS = "ops AS (SELECT l_orderkey AS atom, l_partkey % 50 AS path, min(CAST(l_quantity AS BIGINT)) AS blob FROM lineitem GROUP BY ALL)"
_GREEDY = f"""
{_REVS.format(path=_K + ' % 10')},
rn AS (SELECT *, row_number() OVER w AS rn, lag(date) OVER w AS last FROM revs WINDOW w AS (PARTITION BY author, log ORDER BY date, path, rev)),
pr AS (SELECT *, coalesce(lag(rn) OVER (PARTITION BY author, log, path ORDER BY rn), 0) AS before, CASE WHEN date - last > {GREEDY} THEN 1 ELSE 0 END AS gap FROM rn),
fold AS (
  SELECT author, log, path, rev, date, rn, CAST(1 AS BIGINT) AS opened, CAST(1 AS BIGINT) AS cluster FROM pr WHERE rn = 1
  UNION ALL
  SELECT p.author, p.log, p.path, p.rev, p.date, p.rn,
         CASE WHEN p.gap = 1 OR p.before >= f.opened THEN p.rn ELSE f.opened END,
         f.cluster + CASE WHEN p.gap = 1 OR p.before >= f.opened THEN 1 ELSE 0 END
  FROM fold f JOIN pr p ON p.author = f.author AND p.log = f.log AND p.rn = f.rn + 1
),
cl AS (SELECT author, log, cluster, min(date) AS earliest, max(date) AS latest, count(DISTINCT path) AS n_paths, count(*) AS n_revs,
              min(CAST(path AS VARCHAR) || '@' || CAST(rev AS VARCHAR)) AS min_key FROM fold GROUP BY ALL)"""
_OVERLAP = f"""
, t AS (SELECT DISTINCT f.author, f.log, f.cluster, f.path, c.earliest, c.latest FROM fold f JOIN cl c USING (author, log, cluster)),
met AS (SELECT DISTINCT a.author, a.log, a.cluster, a.path FROM t a JOIN t b ON a.path = b.path AND (a.author, a.log, a.cluster) <> (b.author, b.log, b.cluster)
        AND b.earliest <= a.latest + {GREEDY} AND b.latest >= a.earliest - {GREEDY}),
ov AS (SELECT c.author, c.log, c.cluster, count(m.path) AS overlap FROM cl c LEFT JOIN met m USING (author, log, cluster) GROUP BY ALL)"""


# --- changesets -------------------------------------------------------------------------------------------------------


@query(f"""WITH {_REVS.format(path=_K)},
g AS (SELECT *, CASE WHEN lag(date) OVER w IS NULL OR date - lag(date) OVER w > {GAP} THEN 1 ELSE 0 END AS opens FROM revs WINDOW w AS (PARTITION BY author, log ORDER BY date, path, rev)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY author, log ORDER BY date, path, rev) AS run FROM g)
SELECT author, log, CAST(run AS BIGINT) AS run, min(date) AS earliest, max(date) AS latest, count(*) AS n_revs, count(DISTINCT path) AS n_paths FROM r GROUP BY author, log, run""")
def changesets_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = cluster.gap_runs(file_revs(spark, sf_dir), GAP)
    return runs.groupBy("author", "log", F.col("run").cast("bigint").alias("run")).agg(F.min("date").alias("earliest"), F.max("date").alias("latest"), F.count(F.lit(1)).alias("n_revs"), F.count_distinct("path").alias("n_paths"))


def _greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.reconstruct(file_revs(spark, sf_dir, 10), GREEDY)


@query(f"WITH RECURSIVE {_GREEDY} SELECT author, log, cluster, earliest, latest, n_paths, n_revs, min_key FROM cl")
def changesets_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.summarise(_greedy(spark, sf_dir)).withColumn("cluster", F.col("cluster").cast("bigint"))


@query(f"WITH RECURSIVE {_GREEDY}, ids AS (SELECT author, log, cluster, string_agg(CAST(path AS VARCHAR) || '@' || CAST(rev AS VARCHAR), chr(10) ORDER BY CAST(path AS VARCHAR) || '@' || CAST(rev AS VARCHAR)) AS identity FROM fold GROUP BY ALL) SELECT author, log, cluster, sha256(identity) AS identity FROM ids")
def changeset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.identities(_greedy(spark, sf_dir)).select("author", "log", F.col("cluster").cast("bigint").alias("cluster"), F.sha2("identity", 256).alias("identity"))


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _greedy(spark, sf_dir)
    made = cluster.summarise(rows)
    key = F.struct("author", "log", F.col("cluster").cast("bigint").alias("cluster")).alias("id")
    touches = rows.select("author", "log", "cluster", "path").distinct().join(made, ["author", "log", "cluster"]).select(key, "path", "earliest", "latest")
    return made, cluster.overlap_counts(touches, GREEDY).select("id.*", F.col("overlap").cast("bigint").alias("overlap"))


@query(f"WITH RECURSIVE {_GREEDY}{_OVERLAP} SELECT author, log, cluster, overlap FROM ov")
def changeset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir)[1]


@query(f"""WITH RECURSIVE {_GREEDY}{_OVERLAP}
SELECT author, log, cluster, n_paths, overlap, greatest(0, least(100, (CASE WHEN latest - earliest <= 0 THEN 100 ELSE 100 - least(100, (latest - earliest) * 100 // {GREEDY}) END) * (2 * n_paths - overlap) // (2 * n_paths))) AS confidence
FROM cl JOIN ov USING (author, log, cluster)""")
def changeset_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, overlaps = _overlaps(spark, sf_dir)
    rows = made.withColumn("cluster", F.col("cluster").cast("bigint")).join(overlaps, ["author", "log", "cluster"])
    return rows.select("author", "log", "cluster", "n_paths", "overlap", cluster.confidence(F.col("latest") - F.col("earliest"), GREEDY, F.col("n_paths"), F.col("overlap")).alias("confidence"))


@query(f"""WITH RECURSIVE {_GREEDY}, pos AS (SELECT *, row_number() OVER (ORDER BY latest, min_key) AS pos FROM cl),
p AS (SELECT f.path, f.rev, pos.pos, max(pos.pos) OVER (PARTITION BY f.path ORDER BY f.rev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM fold f JOIN pos USING (author, log, cluster))
SELECT p.path, p.rev, a.latest AS anchor_date, a.min_key AS anchor_key FROM p JOIN pos a ON a.pos = p.anchor WHERE p.pos < p.anchor""")
def order_fix_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _greedy(spark, sf_dir)
    key = cluster.summarise(rows).select("author", "log", "cluster", F.struct("latest", "min_key").alias("pos"))
    found = cluster.misplaced(rows.join(key, ["author", "log", "cluster"])).filter("misplaced")
    return found.select("path", "rev", F.col("anchor.latest").alias("anchor_date"), F.col("anchor.min_key").alias("anchor_key"))


# --- differences and states -----------------------------------------------------------------------------------------


_DIFF = f"""{_CHAIN}, {_OPS}, steps AS (SELECT node, parent FROM chain WHERE parent IS NOT NULL),
b AS (SELECT node AS atom, path, blob FROM ops JOIN steps ON atom = parent), c AS (SELECT atom, path, blob FROM ops WHERE atom IN (SELECT node FROM steps)),
d AS (SELECT coalesce(b.atom, c.atom) AS atom, coalesce(b.path, c.path) AS path, b.blob AS old_blob, c.blob AS new_blob,
      CASE WHEN b.atom IS NULL THEN 'Add' WHEN c.atom IS NULL THEN 'Delete' WHEN b.blob IS DISTINCT FROM c.blob THEN 'Modify' END AS op
      FROM b FULL JOIN c ON b.atom = c.atom AND b.path = c.path)"""


@query(f"WITH {_DIFF} SELECT atom, path, old_blob, new_blob, op FROM d WHERE op IS NOT NULL")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_diffs(spark, sf_dir)


@query(f"""WITH {_DIFF}, o AS (SELECT atom, path, op, coalesce(new_blob, old_blob) AS blob FROM d WHERE op IN ('Add', 'Delete'))
SELECT atom, blob, max(path) FILTER (op = 'Delete') AS from_path, max(path) FILTER (op = 'Add') AS to_path FROM o WHERE blob IS NOT NULL
GROUP BY atom, blob HAVING count(*) FILTER (op = 'Delete') = 1 AND count(*) FILTER (op = 'Add') = 1""")
def rename_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = order_diffs(spark, sf_dir).select("atom", "path", "op", F.coalesce("new_blob", "old_blob").alias("blob"))
    return diff.exact_renames(ops)


@query(f"""WITH {_CHAIN}, x AS (SELECT o_custkey AS line, l_partkey % 50 AS path, o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'Add' WHEN 'N' THEN 'Modify' ELSE 'Delete' END AS op
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS (SELECT *, last_value(CASE WHEN op <> 'Modify' THEN op END IGNORE NULLS) OVER (PARTITION BY line, path ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, op ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM x)
SELECT line, path, o_orderkey, l_linenumber, op FROM y WHERE (op = 'Add' AND coalesce(last, '') = 'Add') OR (op <> 'Add' AND coalesce(last, '') <> 'Add')""")
def replay_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "A", "Add").when(F.col("l_returnflag") == "N", "Modify").otherwise("Delete")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("op", op)
    ops = rows.select(F.col("o_custkey").alias("line"), (F.col("l_partkey") % 50).alias("path"), F.struct("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "op").alias("pos"), "op", "o_orderkey", "l_linenumber")
    return asof.replay_violations(ops).select("line", "path", "o_orderkey", "l_linenumber", "op")


@query("SELECT l_orderkey AS atom, l_partkey AS path, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def structure_dup_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("atom"), F.col("l_partkey").alias("path")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT doc_id, sha256(text) AS blob_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", S.hex_id(S.sha256_id(F.col("text"))).alias("blob_id"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT sha256(text) AS blob_id, max(strlen(text)) AS length, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("length"), F.sha2("text", 256).alias("blob_id"))
    return rows.groupBy("blob_id").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("""WITH u AS (SELECT l_suppkey AS blob, l_orderkey AS atom_idx, l_partkey % 50 AS path FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY atom_idx, path) AS k FROM u) SELECT blob, path, atom_idx FROM f WHERE k = 1""")
def store_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("blob"), F.col("l_orderkey").alias("atom_idx"), (F.col("l_partkey") % 50).alias("path"))
    return asof.first_use_order(uses).orderBy("path", "atom_idx", "blob")


@query("""WITH p AS (SELECT o_custkey AS c, l_orderkey, l_linenumber, l_partkey, l_shipdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT o_custkey AS c, o_orderdate AS at, max(o_orderkey) AS found FROM orders GROUP BY ALL)
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, s.found FROM p ASOF LEFT JOIN s ON p.c = s.c AND p.at >= s.at""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("found"))
    probes = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c")), "l_orderkey").select("c", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("at"))
    return asof.asof_last(probes, orders, ["c"], "at", ["found"], tie="found").select("l_orderkey", "l_linenumber", "l_partkey", "found")


_PAGES = "pg AS (SELECT page_id, rtrim(regexp_replace(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#.*$', ''), '/') AS path FROM pages)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("?"), F.lit(1)), "#.*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.rtrim(plain, F.lit("/")).alias("path"))


@query(f"""WITH {_PAGES}, c AS (SELECT DISTINCT split_part(path, '/', 1) || '/en' AS src, 'copy/' || split_part(path, '/', 1) AS dst FROM pg WHERE page_id % 2 = 0)
SELECT page_id, path, dst || substr(path, length(src) + 1) AS new_path FROM pg JOIN c ON path = src OR starts_with(path, src || '/')""")
def subtree_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = page_paths(spark, sf_dir)
    host = F.split_part("path", F.lit("/"), F.lit(1))
    copies = live.filter("page_id % 2 = 0").select(F.concat(host, F.lit("/en")).alias("src"), F.concat(F.lit("copy/"), host).alias("dst")).distinct()
    return asof.subtree_copy(live, copies).select("page_id", "path", "new_path")


@query(f"""WITH {_PAGES}, r AS (SELECT page_id, CASE split_part(path, '/', 2) WHEN 'en' THEN 'trunk' WHEN 'es' THEN 'other/es' WHEN 'fr' THEN 'tags/fr' ELSE 'branches/' || split_part(path, '/', 2) END || substr(path, length(split_part(path, '/', 1)) + length(split_part(path, '/', 2)) + 2) AS p FROM pg),
k AS (SELECT page_id, CASE WHEN p = 'trunk' OR starts_with(p, 'trunk/') THEN 'trunk' WHEN starts_with(p, 'branches/') AND split_part(p, '/', 2) <> '' THEN 'branches/' || split_part(p, '/', 2) WHEN starts_with(p, 'tags/') AND split_part(p, '/', 2) <> '' THEN 'tags/' || split_part(p, '/', 2) END AS root FROM r)
SELECT coalesce(root, '(outside)') AS root, count(*) AS n, max(page_id) AS last_page FROM k GROUP BY 1""")
def layout_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.split_part("path", F.lit("/"), F.lit(2))
    top = F.when(part == "en", "trunk").when(part == "es", "other/es").when(part == "fr", "tags/fr").otherwise(F.concat(F.lit("branches/"), part))
    rest = F.expr("substring(path, length(split_part(path, '/', 1)) + length(split_part(path, '/', 2)) + 2)")
    rows = page_paths(spark, sf_dir).select("page_id", F.concat(top, rest).alias("path"))
    roots = rows.withColumn("root", F.coalesce(S.layout_root(F.col("path")), F.lit("(outside)")))
    return roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max_by("page_id", "page_id").alias("last_page"))


# --- names --------------------------------------------------------------------------------------------------------------


_LINE = 1 << 40
_RUNS = "runs AS (SELECT l_suppkey AS branch, l_partkey AS file, min(l_orderkey) AS i, max(l_orderkey) + 1 AS o FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_RUNS}, e AS (SELECT branch, max(i) AS mi, min(o) AS mo, count(*) AS files FROM runs GROUP BY 1),
st AS (SELECT branch, pos, sum(d) AS d FROM (SELECT branch, i AS pos, 1 AS d FROM runs UNION ALL SELECT branch, least(o, {_LINE}), -1 FROM runs) GROUP BY 1, 2),
dp AS (SELECT branch, pos, sum(d) OVER (PARTITION BY branch ORDER BY pos) AS covered FROM st), bs AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY covered DESC, pos) AS k FROM dp WHERE pos < {_LINE})
SELECT e.branch, CASE WHEN mi < mo THEN mi ELSE bs.pos END AS position, CAST(mi < mo AS BIGINT) AS exact, CAST(CASE WHEN mi < mo THEN files ELSE bs.covered END AS BIGINT) AS covered FROM e JOIN bs ON e.branch = bs.branch AND bs.k = 1""")
def branch_cut_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey"), "l_suppkey")
    runs = rows.groupBy(F.col("l_suppkey").alias("branch"), F.col("l_partkey").alias("file")).agg(F.min("l_orderkey").alias("in"), (F.max("l_orderkey") + 1).alias("out"))
    return refs.cut_points(runs, _LINE).select("branch", F.col("position").cast("bigint").alias("position"), F.col("exact").cast("bigint").alias("exact"), F.col("covered").cast("bigint").alias("covered"))


@query("""WITH p AS (SELECT n_name AS branch, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS line FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT branch, line, count(*) AS n FROM p GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY n DESC, line) AS k FROM n) SELECT branch, line, n FROM k WHERE k = 1""")
def majority_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return refs.majority_line(rows.select(F.col("n_name").alias("branch"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("line")))


@query(f"""WITH {_CHAIN}, h AS (SELECT c.node, c_mktsegment AS branch, c.o_orderstatus = 'O' AS open FROM chain c JOIN customer ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM chain d WHERE d.parent = c.node)),
k AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY open DESC, node DESC) AS k FROM h) SELECT branch, node AS tip, CAST(open AS BIGINT) AS open FROM k WHERE k = 1""")
def branch_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nodes = rows.select("node", F.col("c_mktsegment").alias("branch"), F.col("node").alias("rev"), (F.col("o_orderstatus") == "O").alias("open"))
    tips = refs.branch_tips(refs.branch_heads(nodes, rows.filter("parent is not null").select("node", "parent")))
    return tips.select("branch", "tip", F.col("open").cast("bigint").alias("open"))


@query("""SELECT p_brand AS name, CAST(bool_or(p_size > 48) AS BIGINT) AS is_branch, count(*) AS n, sha256(string_agg(CAST(p_partkey AS VARCHAR) || '@' || CAST(p_size AS VARCHAR), ',' ORDER BY p_partkey, p_size)) AS entries FROM part GROUP BY 1""")
def symbols_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("path"), F.col("p_size").alias("rev"), (F.col("p_size") > 48).alias("branch_like"))
    text = F.array_join(F.transform("entries", lambda e: F.concat(e["path"].cast("string"), F.lit("@"), e["rev"].cast("string"))), ",")
    return refs.collect_symbols(entries).select("name", F.col("is_branch").cast("bigint").alias("is_branch"), F.size("entries").cast("bigint").alias("n"), F.sha2(text, 256).alias("entries"))


@query("""WITH s AS (SELECT DISTINCT 'tag' || CAST(l_suppkey % 37 AS VARCHAR) AS name, l_partkey AS path, l_linenumber AS rev FROM lineitem WHERE l_returnflag = 'A'),
pl AS (SELECT l_partkey AS path, l_linenumber AS rev, max(o_orderkey) AS atom, max(epoch_us(o_orderdate) // 1000000) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1, 2),
k AS (SELECT name, atom, date, row_number() OVER (PARTITION BY name ORDER BY date DESC, s.path, s.rev) AS k FROM s JOIN pl ON s.path = pl.path AND s.rev = pl.rev) SELECT name, atom, date FROM k WHERE k = 1""")
def symbol_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    symbols = items.filter("l_returnflag = 'A'").select(F.concat(F.lit("tag"), (F.col("l_suppkey") % 37).cast("string")).alias("name"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("rev")).distinct()
    placed = items.filter("l_returnflag <> 'R'").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("rev")).agg(F.max("o_orderkey").alias("atom"), F.max(seconds("o_orderdate")).alias("date"))
    return refs.symbol_targets(symbols, placed)[0]


# --- the revision graph ----------------------------------------------------------------------------------------------


_PHASE = "CASE WHEN o_totalprice > 480000 THEN 2 WHEN o_totalprice > 400000 THEN 1 ELSE 0 END"
_DOWN = f"""down AS (SELECT node, parent, CAST({_PHASE} AS BIGINT) AS phase FROM chain WHERE parent IS NULL
UNION ALL SELECT c.node, c.parent, greatest(d.phase, {_PHASE}) FROM chain c JOIN down d ON c.parent = d.node)"""


def _phases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, graph.Lines, DataFrame]:
    """The orders' chain (written once), its lines, and every node's phase."""
    rows = Rounds(spark, "chain").write(chain(spark, sf_dir).select("node", "parent", "o_totalprice", "o_orderstatus"))
    lines = graph.Lines.of(rows.filter("parent is not null").select("node", "parent"))
    return rows, lines, graph.inherited_phase(lines, rows, rows.select("node", F.expr(_PHASE).alias("phase")).filter("phase > 0"))


@query(f"WITH RECURSIVE {_CHAIN}, {_DOWN} SELECT node, phase FROM down")
def phase_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phases(spark, sf_dir)[2].select("node", F.col("phase").cast("bigint").alias("phase"))


@query(f"""WITH RECURSIVE {_CHAIN}, {_DOWN}, up AS (SELECT node, parent FROM chain WHERE o_orderstatus <> 'F' UNION SELECT c.node, c.parent FROM chain c JOIN up ON up.parent = c.node)
SELECT node, CAST(phase < 2 AS BIGINT) AS served FROM (SELECT DISTINCT node FROM up) JOIN down USING (node)""")
def visible_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lines, phases = _phases(spark, sf_dir)
    visible, served = graph.published(lines, rows.select("node"), rows.filter("o_orderstatus = 'F'").select("node"), rows.select("node").limit(0), phases)
    return visible.join(served.withColumn("served", F.lit(1)), "node", "left").select("node", F.coalesce("served", F.lit(0)).cast("bigint").alias("served"))


_WANTS = "CASE WHEN n_nationkey % 7 = 0 THEN '' WHEN n_nationkey % 11 = 5 THEN NULL ELSE 'NATION_' || CAST((n_nationkey * 3 + 1) % 25 AS VARCHAR) END"


@query(f"""WITH RECURSIVE w AS (SELECT n_name AS name, {_WANTS} AS parent FROM nation),
up AS (SELECT name, parent, CAST(1 AS BIGINT) AS wave FROM w WHERE parent = '' UNION ALL SELECT w.name, w.parent, up.wave + 1 FROM w JOIN up ON w.parent = up.name WHERE w.name <> w.parent)
SELECT w.name, coalesce(up.parent, '(blocked)') AS parent, coalesce(up.wave, -1) AS wave FROM w LEFT JOIN up ON w.name = up.name""")
def branch_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    wants = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.expr(_WANTS.replace("VARCHAR", "STRING")).alias("parent"))
    imported, blocked = graph.branch_waves(wants)
    return imported.select("name", "parent", F.col("wave").cast("bigint").alias("wave")).unionAll(blocked.select("name", F.lit("(blocked)").alias("parent"), F.lit(-1).cast("bigint").alias("wave")))


@query(f"""WITH RECURSIVE {_CHAIN}, up AS (SELECT node, parent FROM chain WHERE node % 3 <> 0
UNION ALL SELECT up.node, c.parent FROM up JOIN chain c ON up.parent = c.node WHERE up.parent % 3 = 0)
SELECT node, max(CASE WHEN parent % 3 <> 0 THEN parent END) AS parent FROM up GROUP BY node""")
def reparent_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir)
    parents = rows.filter("parent is not null").select("node", F.lit(0).alias("pos"), "parent")
    kept = graph.remapped_parents(parents, rows.filter("node % 3 = 0").select("node"))
    return rows.filter("node % 3 <> 0").select("node").join(kept, "node", "left").select("node", F.get("parents", F.lit(0)).alias("parent"))


@query(None)
def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = F.lag("o_orderkey").over(W.partitionBy("o_orderdate").orderBy("o_orderkey"))
    rows = chain(spark, sf_dir).withColumn("other", F.when(by_day < F.col("node"), by_day))
    # a parent must come earlier: both are kept only where they have a lower date, or the same date and a lower number
    nodes = rows.select("node", F.col("node").alias("source"), F.array_compact(F.array("parent", "other")).alias("parents"))
    return graph.topological_order(nodes)


# --- transforms, reports, checks -------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT n_name AS old, CASE WHEN n_nationkey % 2 = 0 THEN 'N-' || CAST(n_nationkey AS VARCHAR) END AS new FROM nation)
SELECT c_custkey, coalesce(m.new, n_name) AS author FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN m ON m.old = n_name AND m.new IS NOT NULL""")
def author_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.transform import remap

    nation = table(spark, sf_dir, "nation")
    lines = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("old_name"), F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("new_name"))
    again = lines.select((F.col("line_no") + 1000).alias("line_no"), "old_name", F.lit("later").alias("new_name"))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))
    return remap(people, lines.unionAll(again), {"name": ("old_name", "new_name")}).select("c_custkey", F.col("name").alias("author"))


@query("""WITH b AS (SELECT o_orderkey AS node, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
a AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS priority, o_orderkey % 10 = 0 AND o_orderkey % 50 <> 10 OR o_orderkey % 97 = 1 AS marked FROM orders WHERE o_orderkey % 100 <> 0),
j AS (SELECT coalesce(a.node, b.node) AS node, a.node IS NULL AS gone, a.status IS DISTINCT FROM b.status AS differs, coalesce(marked, FALSE) AS marked FROM a FULL JOIN b ON a.node = b.node)
SELECT node, CASE WHEN gone THEN 'missing-atom' WHEN differs AND NOT marked THEN 'unmarked-change' ELSE 'mark-without-change' END AS violation FROM j WHERE gone AND node % 200 <> 0 OR NOT gone AND differs <> marked""")
def transform_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.transform import changed_part_violations

    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    marked = F.expr("node % 10 = 0 and node % 50 <> 10 or node % 97 = 1")
    after = before.filter("node % 100 <> 0").withColumn("changed", F.when(marked, F.array(F.lit("status"))).otherwise(F.array().cast("array<string>"))).withColumn("status", F.when(F.col("node") % 10 == 0, "X").otherwise(F.col("status")))
    dropped = before.filter("node % 200 = 0").select("node")
    return changed_part_violations(before, after, ["status", "priority"], dropped).select("node", "violation")


@query("""WITH r AS (SELECT 'derived' AS section, CASE quality WHEN 1 THEN 'reconstructed-changeset' ELSE 'inferred-rename' END AS label, count(*) AS n FROM labels WHERE toxic = 0 GROUP BY ALL
UNION ALL SELECT 'dropped', lang, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'flagged', l_returnflag, CAST(sum(l_linenumber) AS BIGINT) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'transformed_atoms', CAST(s AS VARCHAR), count(*) FROM labels, (VALUES (1), (2)) v(s) WHERE toxic = 1 AND (s = 1 OR quality = 1) GROUP BY ALL
UNION ALL SELECT 'total', 'atoms', count(*) FROM labels UNION ALL SELECT 'total', 'refs', 0 UNION ALL SELECT 'total', 'blobs', count(DISTINCT text) FROM documents UNION ALL SELECT 'total', 'content_bytes', CAST(sum(strlen(t)) AS BIGINT) FROM (SELECT DISTINCT text AS t FROM documents))
SELECT section, label, CAST(n AS BIGINT) AS n FROM r""")
def fidelity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    kind = F.when(F.col("quality") == 1, "reconstructed-changeset").otherwise("inferred-rename")
    layer = lambda s: F.struct(F.lit(s).alias("step"))
    layers = F.when(F.col("toxic") == 0, F.array().cast("array<struct<step:int>>")).when(F.col("quality") == 1, F.array(layer(2), layer(1))).otherwise(F.array(layer(1)))
    atoms = labels.select(F.struct(F.lit("derived").alias("base"), F.struct(kind.alias("kind")).alias("derivation"), layers.alias("layers")).alias("status"))
    none = atoms.limit(0)
    blobs = docs.select("text").distinct().select(F.octet_length("text").alias("length"))
    drops = docs.select(F.col("lang").alias("class"), F.lit(None).cast("int").alias("step"))
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("count"))
    return report.fidelity(atoms, none, none, none, drops, flags, blobs)


@query("""WITH f AS (SELECT l_orderkey AS atom, count(DISTINCT l_partkey % 500) AS n FROM lineitem GROUP BY 1), s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS t FROM f)
SELECT min(n) AS "min", min(CASE WHEN k = t // 2 THEN n END) AS median, min(CASE WHEN k = least(t * 9 // 10, t - 1) THEN n END) AS p90, max(n) AS "max" FROM s""")
def import_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(F.col("l_partkey") % 500).alias("n"))
    return report.rank_percentiles(files, "n")


@query("""WITH o AS (SELECT DISTINCT ON (l_orderkey, l_partkey % 500) l_orderkey AS atom_idx, l_partkey % 500 AS path, l_returnflag <> 'R' AS live FROM lineitem ORDER BY l_orderkey, l_partkey % 500, l_returnflag),
s AS (SELECT *, coalesce(lag(live) OVER (PARTITION BY path ORDER BY atom_idx), FALSE) AS was FROM o), d AS (SELECT atom_idx, sum(CAST(live AS INT) - CAST(was AS INT)) AS d FROM s GROUP BY 1)
SELECT atom_idx, CAST(sum(d) OVER (ORDER BY atom_idx) AS BIGINT) AS size FROM d""")
def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("atom_idx"), (F.col("l_partkey") % 500).alias("path")).agg(F.min("l_returnflag").alias("f"))
    return report.tree_sizes(ops.withColumn("op", F.when(F.col("f") == "R", "Delete").otherwise("Add")))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(url_encode(text), '%2F', '/'), '%40', '@'), '%3A', ':'), '%2B', '+')) AS encoded FROM documents")
def machine_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.machine_value(F.col("text")), 256).alias("encoded"))


@query(r"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '\' THEN '\\' WHEN unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 159 OR unicode(c) IN (173, 1564, 6158, 65279) OR unicode(c) BETWEEN 8203 AND 8207 OR unicode(c) BETWEEN 8232 AND 8238 OR unicode(c) BETWEEN 8288 AND 8303 OR unicode(c) BETWEEN 65529 AND 65531
THEN '\u{' || lpad(lower(to_hex(unicode(c))), 4, '0') || '}' ELSE c END), '')) AS shown FROM documents""")
def human_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.human_text(F.col("text")), 256).alias("shown"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '-' ELSE '' END || CAST(o_orderkey * 1000003 AS VARCHAR) || CASE o_orderkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN '0000000000000000000000000' ELSE '' END AS raw,
CASE o_orderkey % 3 WHEN 0 THEN '+' ELSE '-' END || lpad(CAST(o_orderkey % 2500 AS VARCHAR), 4, '0') AS off, (o_orderkey % 1440 - 720) * CASE o_orderkey % 4 WHEN 0 THEN 61 ELSE 60 END AS tz FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '-?[0-9]+') THEN TRY_CAST(raw AS BIGINT) END AS seconds,
CASE WHEN CAST(substr(off, 4, 2) AS INT) < 60 THEN (CAST(substr(off, 2, 2) AS INT) * 60 + CAST(substr(off, 4, 2) AS INT)) * CASE WHEN off[1] = '-' THEN -1 ELSE 1 END END AS minutes,
CASE WHEN tz % 60 = 0 THEN CAST(-(tz // 60) AS SMALLINT) END AS east FROM t""")
def strict_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.concat(F.when(k % 5 == 0, "-").otherwise(""), (k * 1000003).cast("string"), F.when(k % 7 == 0, "x").when(k % 7 == 1, "0" * 25).otherwise(""))
    off = F.concat(F.when(k % 3 == 0, "+").otherwise("-"), F.lpad((k % 2500).cast("string"), 4, "0"))
    tz = (k % 1440 - 720) * F.when(k % 4 == 0, 61).otherwise(60)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.strict_seconds(raw).alias("seconds"), S.strict_offset_minutes(off).alias("minutes"), S.west_seconds_to_minutes(tz).alias("east"))


@query("""SELECT o_orderkey, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS days, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS dump, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) END AS rcs, CAST(day(last_day(o_orderdate)) AS BIGINT) AS month_days FROM orders""")
def civil_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    dump = F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T"), F.date_format(d, "HH:mm:ss"), F.lit(".000000Z"))
    rcs = F.concat(F.when(F.year(d) < 2000, F.date_format(d, "yy")).otherwise(F.date_format(d, "yyyy")), F.lit("."), F.when(F.col("o_orderkey") % 3 == 0, "13").otherwise(F.date_format(d, "MM")), F.date_format(d, ".dd.HH.mm.ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.days_from_civil(F.year(d), F.month(d), F.day(d)).alias("days"), S.dump_date_seconds(dump).alias("dump"), S.rcs_date_seconds(rcs).alias("rcs"), S.days_in_month(F.year(d), F.month(d)).cast("bigint").alias("month_days"))


@query("""WITH r AS (SELECT DISTINCT CASE l_suppkey % 4 WHEN 0 THEN [1, l_linenumber] WHEN 1 THEN [1, l_linenumber, 0, 2] WHEN 2 THEN [1, l_linenumber, 2] ELSE [1, l_linenumber, 2, l_partkey % 12] END AS rev FROM lineitem)
SELECT array_to_string(rev, '.') AS dotted, CAST(len(rev) = 2 OR (len(rev) >= 4 AND len(rev) % 2 = 0) AS BIGINT) AS reachable, array_to_string(rev[:-2], '.') AS branch,
CASE WHEN len(rev) >= 3 AND len(rev) % 2 = 1 THEN array_to_string(rev[:-2] || [0] || rev[-1:], '.') END AS magic, CASE WHEN len(rev) >= 4 AND len(rev) % 2 = 0 AND rev[-2] = 0 THEN array_to_string(rev[:-3] || rev[-1:], '.') END AS unmagic,
row_number() OVER (ORDER BY rev) AS place FROM r""")
def rev_parse_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("l_suppkey") % 4, F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("1."), n, F.when(kind == 0, "").when(kind == 1, ".0.2").when(kind == 2, ".2").otherwise(F.concat(F.lit(".2."), (F.col("l_partkey") % 12).cast("string"))))
    revs = table(spark, sf_dir, "lineitem").select(S.parse_dotted(text).alias("rev")).distinct()
    r = F.col("rev")
    return revs.select(S.dotted(r).alias("dotted"), S.has_reachable_shape(r).cast("bigint").alias("reachable"), S.dotted(S.branch_of(r)).alias("branch"), S.dotted(S.magic_branch_number(r)).alias("magic"), S.dotted(S.magic_branch(r)["branch"]).alias("unmagic"), F.row_number().over(W.orderBy("rev")).cast("bigint").alias("place"))


@query("""WITH d AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'inferred-rename' WHEN 'assistant' THEN 'reconstructed-changeset' ELSE 'reconstructed-branch' END AS kind,
list_filter(['rename_algorithm', 'rename_threshold', 'window_secs', 'cluster_keys', 'date_rule', 'confidence_rule', 'layout'], lambda k, i: (conv_id + turn) % i <> 1) AS keys FROM conversations)
SELECT conv_id, turn, kind, array_to_string(CASE kind WHEN 'inferred-rename' THEN list_filter(['rename_algorithm', 'rename_threshold'], lambda k: NOT list_contains(keys, k)) WHEN 'reconstructed-changeset' THEN list_filter(['window_secs', 'cluster_keys', 'date_rule', 'confidence_rule'], lambda k: NOT list_contains(keys, k)) ELSE list_filter(['layout|source'], lambda k: NOT list_contains(keys, 'layout')) END, ',') AS missing FROM d
WHERE len(CASE kind WHEN 'inferred-rename' THEN list_filter(['rename_algorithm', 'rename_threshold'], lambda k: NOT list_contains(keys, k)) WHEN 'reconstructed-changeset' THEN list_filter(['window_secs', 'cluster_keys', 'date_rule', 'confidence_rule'], lambda k: NOT list_contains(keys, k)) ELSE list_filter(['layout|source'], lambda k: NOT list_contains(keys, 'layout')) END) > 0""")
def derivation_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.verify import missing_params

    names = ["rename_algorithm", "rename_threshold", "window_secs", "cluster_keys", "date_rule", "confidence_rule", "layout"]
    kind = F.when(F.col("role") == "user", "inferred-rename").when(F.col("role") == "assistant", "reconstructed-changeset").otherwise("reconstructed-branch")
    entry = lambda i, k: F.when((F.col("conv_id") + F.col("turn")) % i != 1, F.struct(F.lit(k), F.lit("x")))
    params = F.map_from_entries(F.array_compact(F.array(*[entry(i, k) for i, k in enumerate(names, 1)])))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), params.alias("params"))
    return rows.withColumn("missing", missing_params(F.col("kind"), F.col("params"))).filter("size(missing) > 0").select("conv_id", "turn", "kind", F.array_join("missing", ",").alias("missing"))


@query("""WITH f AS (SELECT p_name AS path, min(p_size) AS rev, arg_min(p_brand, (p_size, p_brand)) AS author FROM part GROUP BY 1)
SELECT sha256(string_agg(path || chr(9) || CAST(rev AS VARCHAR) || chr(9) || author, chr(10) ORDER BY path)) AS repo_id, count(*) AS files FROM f""")
def repo_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("path")).agg(F.min(F.struct(F.col("p_size").alias("rev"), F.col("p_brand").alias("author"))).alias("low"))
    rows = low.select("path", F.concat_ws("\t", "path", F.col("low.rev").cast("string"), "low.author").alias("line"))
    # one row per file, in path order
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n"), 256).alias("repo_id"), F.count(F.lit(1)).alias("files"))
