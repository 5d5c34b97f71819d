"""Queries that run the model's predicates, checks and edits over history-shaped views of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..history import SCHEMAS, History
from ..operators import asof, branches, diff, frames, graph, refs, report, transform, verify
from ..sources import artifact, svntree
from ..storage import shared_dir, written
from .history_queries import _CHAIN, _PAGES, chain, page_paths, query, seconds, table

_FAR = 1 << 40


def _flag(c) -> F.Column:
    return c.cast("bigint")


# --- revision numbers, identities, grammars ------------------------------------------------------------------------------


_REV = "CASE l_suppkey % 4 WHEN 0 THEN [1, l_linenumber] WHEN 1 THEN [1, l_linenumber, 0, 2] WHEN 2 THEN [1, l_linenumber, 2] ELSE [1, l_linenumber, 2, l_partkey % 12] END"


@query(f"""WITH r AS (SELECT DISTINCT {_REV} AS rev, [1, l_linenumber % 3 + 1, 2] AS vendor FROM lineitem)
SELECT array_to_string(rev, '.') AS rev, array_to_string(vendor, '.') AS vendor, CAST(len(rev) = 4 AND rev[:3] = vendor AS BIGINT) AS direct, CAST(len(rev) = 2 OR (len(rev) = 4 AND rev[:3] = vendor) AS BIGINT) AS main,
CAST((len(rev) = 4 AND rev[3] = 0) OR len(rev) = 3 AS BIGINT) AS names FROM r""")
def rev_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("l_suppkey") % 4, F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("1."), n, F.when(kind == 0, "").when(kind == 1, ".0.2").when(kind == 2, ".2").otherwise(F.concat(F.lit(".2."), (F.col("l_partkey") % 12).cast("string"))))
    vendor = F.array(F.lit(1), F.col("l_linenumber") % 3 + 1, F.lit(2)).cast("array<bigint>")
    r, v = F.col("rev"), F.col("vendor")
    rows = table(spark, sf_dir, "lineitem").select(S.parse_dotted(text).alias("rev"), vendor.alias("vendor")).distinct()
    return rows.select(S.dotted(r).alias("rev"), S.dotted(v).alias("vendor"), _flag(S.is_direct_revision_of(r, v)).alias("direct"), _flag(S.is_main_line(r, v)).alias("main"), _flag(S.names_branch(r)).alias("names"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN '' WHEN 3 THEN c_name || ' <a>' WHEN 4 THEN c_name || ' <open' ELSE c_name END AS name,
CASE c_custkey % 5 WHEN 0 THEN c_custkey || '@x.org' WHEN 2 THEN c_custkey || '@x.org' WHEN 3 THEN 'b' || c_custkey END AS email, c_name || ' x  y' AS cleaned FROM customer""")
def identity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    mail = F.concat(F.lit("<"), k.cast("string"), F.lit("@x.org>"))
    user = F.when(k % 5 == 0, F.concat(name, F.lit(" "), mail)).when(k % 5 == 1, name).when(k % 5 == 2, mail).when(k % 5 == 3, F.concat(name, F.lit(" <a> <b"), k.cast("string"), F.lit(">"))).otherwise(F.concat(name, F.lit(" <open")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.user_name(user).alias("name"), S.user_email(user).alias("email"), S.clean_identity(F.concat(F.lit("<"), name, F.lit("<x>\ny"))).alias("cleaned"))


@query(r"SELECT doc_id, sha256(coalesce(regexp_extract(text, '^([^\r\n]*)', 1), '')) AS subject FROM documents")
def subject_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.subject_line(F.encode("text", "UTF-8")), 256).alias("subject"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 7 = 0 THEN 40960 WHEN p_size % 3 = 0 THEN 33261 ELSE 33188 END AS BIGINT) AS mode, CASE WHEN p_size % 2 = 0 THEN p_name END AS target FROM part""")
def modes_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", S.mode_of(n % 3 == 0, n % 7 == 0).cast("bigint").alias("mode"), S.symlink_target(F.concat(F.when(n % 2 == 0, "link ").otherwise("to "), F.col("p_name"))).alias("target"))


@query("""WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) WHEN 1 THEN replace(lower(p_brand), '#', '-') WHEN 2 THEN replace(p_brand, '#', '-') ELSE repeat('a', 50 + p_size) END AS name FROM part)
SELECT p_partkey, CAST(regexp_full_match(name, '[a-z0-9][a-z0-9-]{0,63}') AS BIGINT) AS is_name, CAST(p_size % 6 IN (0, 1, 2) AS BIGINT) AS is_drop, CAST(p_size % 2 = 0 AND p_size % 5 IN (2, 3) AS BIGINT) AS readable FROM p""")
def name_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, brand = F.col("p_partkey"), F.col("p_size"), F.col("p_brand")
    name = F.when(k % 4 == 0, F.lower(brand)).when(k % 4 == 1, F.replace(F.lower(brand), F.lit("#"), F.lit("-"))).when(k % 4 == 2, F.replace(brand, F.lit("#"), F.lit("-"))).otherwise(F.expr("repeat('a', 50 + p_size)"))
    h = F.sha2(k.cast("string"), 256)
    what = F.when(n % 6 == 0, F.concat(F.lit("atom "), h)).when(n % 6 == 1, F.concat(F.lit("op "), h, F.lit(" a/b"))).when(n % 6 == 2, F.lit("ref branch main")).when(n % 6 == 3, F.concat(F.lit("atom "), h, F.lit("0"))).when(n % 6 == 4, F.lit("ref twig main")).otherwise(F.concat(F.lit("copy "), F.upper(h), F.lit("G x")))
    return table(spark, sf_dir, "part").select("p_partkey", _flag(S.is_transform_name(name)).alias("is_name"), _flag(S.is_transform_drop(what)).alias("is_drop"), _flag(S.accepts_version(n % 2, n % 5)).alias("readable"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a/b' || o_orderkey WHEN 1 THEN '"\\"q' || o_orderkey || '"' WHEN 2 THEN '"l\\n' || o_orderkey || '\\"\\\\"' ELSE '""' END AS path,
CAST(epoch_us(o_orderdate) // 1000000 AS VARCHAR) || ' ' || CASE WHEN o_orderkey % 11 = 0 THEN '+0000' ELSE CASE WHEN o_orderkey % 1440 < 720 THEN '-' ELSE '+' END || lpad(CAST(abs(o_orderkey % 1440 - 720) // 60 AS VARCHAR), 2, '0') || lpad(CAST(abs(o_orderkey % 1440 - 720) % 60 AS VARCHAR), 2, '0') END AS time FROM orders""")
def stream_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = k.cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("a/b"), text)).when(k % 4 == 1, F.concat(F.lit('"q'), text)).when(k % 4 == 2, F.concat(F.lit("l\n"), text, F.lit('"\\'))).otherwise("")
    minutes = F.when(k % 11 != 0, k % 1440 - 720)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.quoted_path(path).alias("path"), S.rendered_time(seconds("o_orderdate"), minutes).alias("time"))


# --- trees, copies, names ---------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_suppkey AS line, l_partkey AS path, l_orderkey * 8 + l_linenumber AS pos, l_returnflag <> 'R' AS live FROM lineitem),
w AS (SELECT *, coalesce(lag(live) OVER (PARTITION BY line, path ORDER BY pos), FALSE) AS was FROM s)
SELECT line, path, pos, CASE WHEN live AND NOT was THEN 'Add' WHEN live THEN 'Modify' WHEN was THEN 'Delete' END AS op FROM w""")
def running_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("line"), F.col("l_partkey").alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_returnflag") != "R").alias("live"))
    return diff.running_ops(rows).select("line", "path", "pos", "op")


@query("""WITH o AS (SELECT l_suppkey AS atom, l_partkey AS path, l_returnflag AS side, min(CAST(l_quantity AS BIGINT)) AS blob FROM lineitem GROUP BY ALL),
j AS (SELECT coalesce(b.atom, c.atom) AS atom, coalesce(b.path, c.path) AS path, b.blob AS old, c.blob AS new FROM (SELECT * FROM o WHERE side = 'A') b FULL JOIN (SELECT * FROM o WHERE side = 'N') c ON b.atom = c.atom AND b.path = c.path)
SELECT atom, path, CASE WHEN old IS NULL THEN 'Add' WHEN new IS NULL THEN 'Delete' WHEN path % 5 = 0 THEN 'Replace' ELSE 'Modify' END AS op FROM j WHERE old IS NULL OR new IS NULL OR path % 5 = 0 OR old <> new""")
def stated_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("atom"), F.col("l_partkey").alias("path"), "l_returnflag").agg(F.min(F.col("l_quantity").cast("bigint")).alias("blob"))
    base, child = ops.filter("l_returnflag = 'A'"), ops.filter("l_returnflag = 'N'")
    return diff.snapshot_diff(base, child, replaced=child.filter("path % 5 = 0").select("atom", "path")).select("atom", "path", "op")


@query(f"""WITH {_PAGES}, gone AS (SELECT DISTINCT split_part(path, '/', 1) || '/de' AS g FROM pg UNION SELECT DISTINCT split_part(path, '/', 1) FROM pg WHERE page_id % 40 = 0)
SELECT page_id, path FROM pg WHERE NOT EXISTS (SELECT 1 FROM gone WHERE path = g OR starts_with(path, g || '/'))""")
def deleted_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = page_paths(spark, sf_dir)
    host = F.split_part("path", F.lit("/"), F.lit(1))
    gone = live.select(F.concat(host, F.lit("/de")).alias("path")).unionAll(live.filter("page_id % 40 = 0").select(host.alias("path"))).distinct()
    return asof.without_subtrees(live, gone).select("page_id", "path")


@query(f"""WITH {_PAGES}, added AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || l AS path FROM pg, (VALUES ('de'), ('es'), ('zz')) v(l))
SELECT path FROM added WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.path = added.path OR starts_with(pg.path, added.path || '/'))""")
def empty_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = page_paths(spark, sf_dir)
    langs = F.explode(F.array(*map(F.lit, ("de", "es", "zz"))))
    added = live.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("host"), langs.alias("lang")).select(F.concat_ws("/", "host", "lang").alias("path")).distinct()
    return refs.empty_folders(added, live.select("path")).select("path")


@query("SELECT l_orderkey AS copy, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS atom FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def copy_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("copy"), (F.col("l_linenumber") * F.lit(100_000_000).cast("bigint") + F.col("l_partkey")).alias("priority"), F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("atom"))
    return refs.copy_source(rows).select("copy", "atom")


@query("""WITH t AS (SELECT 'branches/' || l_suppkey AS root, l_orderkey * 8 + l_linenumber AS rev, l_orderkey AS atom FROM lineitem WHERE l_suppkey % 5 <> 0)
SELECT root, arg_max(atom, rev) AS atom FROM t WHERE root IN (SELECT 'branches/' || l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45) GROUP BY 1""")
def reconstructed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("root", F.concat(F.lit("branches/"), F.col("l_suppkey").cast("string")))
    touches = rows.select(F.when(F.col("l_suppkey") % 5 != 0, F.col("root")).alias("root"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rev"), F.col("l_orderkey").alias("atom"))
    return refs.root_refs(touches, rows.filter("l_returnflag = 'A' and l_quantity > 45").select("root"))


@query("""WITH r AS (SELECT l_partkey AS path, l_linenumber AS n, min(l_suppkey % 3) AS date, min(CAST(l_quantity AS BIGINT) % 4) AS blob FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
SELECT a.path, '1.1' AS point FROM r a JOIN r b ON a.path = b.path AND a.n = 1 AND b.n = 2 AND a.date = b.date AND a.blob = b.blob""")
def vendor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_partkey").alias("path"), F.when(F.col("l_linenumber") == 1, "1.1").otherwise("1.1.1.1").alias("rev")).agg(F.min(F.col("l_suppkey") % 3).alias("date"), F.min(F.col("l_quantity").cast("bigint") % 4).alias("blob"))
    return refs.vendor_only_points(rows)


@query("""SELECT p_partkey AS path FROM part WHERE p_size % 3 = 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 1 AND l_suppkey % 6 = 1)""")
def ambiguous_trunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") % 3 == 0, "1.1.1").alias("vendor_branch"))
    rev = F.when(F.col("l_suppkey") % 6 == 1, F.array(F.lit(1), F.col("l_linenumber"))).otherwise(F.array(F.lit(1), F.lit(1), F.lit(1), F.col("l_linenumber")))
    revisions = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), rev.alias("rev"))
    return verify.trunk_after_vendor(files, revisions).select("path")


@query("SELECT min(o_orderkey) AS node FROM orders WHERE o_orderkey % 1000 = 777 OR o_orderkey % 997 = 3")
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_orderstatus", "o_totalprice")
    again = rows.filter("node % 997 <> 3").withColumn("o_orderstatus", F.when(F.col("node") % 1000 == 777, "X").otherwise(F.col("o_orderstatus")))
    return diff.first_divergence(rows, again, "node", ["o_orderstatus", "o_totalprice"])


@query("""SELECT p_partkey AS path, 'b' || p_size % 7 AS name, '1.' || (p_size % 4 + 1) || '.2' AS branch, CASE WHEN p_size % 4 = 3 THEN 'missing' WHEN (p_partkey + p_size % 4 + 1) % 5 = 0 THEN 'dead' ELSE 'live' END AS state,
CASE WHEN p_size % 4 < 3 THEN '' END AS line FROM part WHERE p_partkey % 3 < 2""")
def branch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), (F.col("p_size") % 4 + 1).cast("bigint")
    one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    rev = F.when(F.col("p_partkey") % 3 == 0, F.array(one, k, F.lit(0).cast("bigint"), two)).when(F.col("p_partkey") % 3 == 1, F.array(one, k, two)).otherwise(F.array(one, k))
    symbols = part.select(F.col("p_partkey").alias("path"), F.concat(F.lit("b"), (F.col("p_size") % 7).cast("string")).alias("name"), rev.alias("rev"))
    n = F.explode(F.sequence(one, F.lit(3).cast("bigint"))).alias("n")
    revisions = part.select(F.col("p_partkey").alias("path"), n).select("path", F.array(one, "n").alias("rev"), F.when((F.col("path") + F.col("n")) % 5 == 0, "dead").otherwise("live").alias("state"))
    return branches.discover(symbols, revisions).select("path", "name", S.dotted(F.col("branch")).alias("branch"), "state", "line")


@query("""WITH e AS (SELECT l_suppkey AS name, CASE l_returnflag WHEN 'A' THEN 'live' ELSE 'dead' END AS state, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' || l_partkey % 2 END AS line FROM lineitem),
n AS (SELECT name, line, count(*) AS n FROM e WHERE state = 'live' AND line IS NOT NULL GROUP BY ALL), k AS (SELECT name, line FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, line) = 1)
SELECT a.name, CASE WHEN a.bound THEN k.line ELSE '' END AS parent FROM (SELECT name, bool_or(state = 'live') AS bound FROM e GROUP BY 1) a LEFT JOIN k ON k.name = a.name""")
def branch_wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("l_linenumber") % 3 == 0, "").when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("x"), (F.col("l_partkey") % 2).cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("name"), F.when(F.col("l_returnflag") == "A", "live").otherwise("dead").alias("state"), line.alias("line"))
    return branches.wanted_parents(rows)


@query(f"""WITH m AS (SELECT DISTINCT l_partkey AS path, l_orderkey AS idx FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx) AS n, coalesce(lead(idx) OVER (PARTITION BY path ORDER BY idx), {_FAR}) AS o FROM m),
runs AS (SELECT path % 97 AS branch, idx AS i, o FROM r WHERE n = 1 + path % 3 AND path % 97 <> 5), e AS (SELECT branch, max(i) AS mi, min(o) AS mo, count(*) AS files FROM runs GROUP BY 1),
st AS (SELECT branch, pos, sum(d) AS d FROM (SELECT branch, i AS pos, 1 AS d FROM runs UNION ALL SELECT branch, least(o, {_FAR}), -1 FROM runs) GROUP BY 1, 2),
dp AS (SELECT branch, pos, sum(d) OVER (PARTITION BY branch ORDER BY pos) AS covered FROM st), bs AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY covered DESC, pos) AS k FROM dp WHERE pos < {_FAR})
SELECT e.branch, CASE WHEN mi < mo THEN mi ELSE bs.pos END AS position, CAST(mi < mo AS BIGINT) AS exact, CAST(CASE WHEN mi < mo THEN files ELSE bs.covered END AS BIGINT) AS covered FROM e JOIN bs ON e.branch = bs.branch AND bs.k = 1""")
def branch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("idx")).distinct()
    members = rows.withColumn("rev", F.row_number().over(W.partitionBy("path").orderBy("idx")).cast("bigint"))
    entries = rows.select("path").distinct().select((F.col("path") % 97).alias("name"), "path", (1 + F.col("path") % 3).cast("bigint").alias("point"), F.lit("live").alias("state"), F.lit("").alias("line"))
    parent = entries.select("name").distinct().withColumn("parent", F.when(F.col("name") == 5, "b").otherwise(""))
    out = branches.plan(entries, members, parent, _FAR)
    return out.select("branch", F.col("position").cast("bigint").alias("position"), _flag(F.col("exact")).alias("exact"), F.col("covered").cast("bigint").alias("covered"))


@query("""WITH r AS (SELECT l_partkey AS path, l_linenumber AS n, l_suppkey % 3 AS k FROM lineitem)
SELECT CASE k WHEN 1 THEN 'named' || path % 4 END AS line, count(*) AS revisions, count(DISTINCT path) AS files FROM r WHERE k > 0 GROUP BY 1""")
def excluded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    big = lambda *xs: F.array(*[F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in xs])
    k, n = F.col("l_suppkey") % 3, F.col("l_linenumber")
    revisions = rows.select(F.col("l_partkey").alias("path"), F.when(k == 0, big(1, n)).when(k == 1, big(1, 1, 2, n)).otherwise(big(1, 1, 4, n)).alias("rev"))
    symbols = rows.select(F.col("l_partkey").alias("path")).distinct().select("path", F.concat(F.lit("named"), (F.col("path") % 4).cast("string")).alias("name"), big(1, 1, 0, 2).alias("rev"))
    return branches.excluded(revisions, symbols)


@query(f"""WITH RECURSIVE {_CHAIN}, up AS (SELECT node, parent, node % 7 = 0 AS gone, node % 7 <> 0 AS kept FROM chain WHERE node % 5 = 0 UNION SELECT c.node, c.parent, up.gone, up.kept FROM chain c JOIN up ON up.parent = c.node)
SELECT count(*) AS n FROM (SELECT node FROM up GROUP BY node HAVING bool_or(gone) AND NOT bool_or(kept))""")
def exclusive_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir)
    tips = rows.filter("node % 5 = 0").select("node")
    n = graph.exclusive_count(rows.filter("parent is not null").select("node", "parent"), tips.filter("node % 7 = 0"), tips.filter("node % 7 <> 0"))
    return spark.createDataFrame([(n,)], "n bigint")


@query(f"""WITH {_CHAIN} SELECT node, row_number() OVER (ORDER BY epoch_us(o_orderdate), node) - 1 AS position FROM chain""")
def topo_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sources are in order of time, as parents are, the smallest order that has parents first is the order of sources."""
    rows = chain(spark, sf_dir).select("node", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("source"), F.array_compact(F.array("parent")).alias("parents"))
    return graph.topological_order(rows).select("node", "position")


@query(f"""WITH RECURSIVE {_CHAIN}, p AS (SELECT node, parent FROM chain WHERE parent IS NOT NULL UNION ALL SELECT a.node, b.node FROM chain a JOIN chain b ON b.node = a.node - 3 WHERE a.node % 50 = 0 AND a.parent IS NOT NULL AND a.parent > a.node),
up AS (SELECT node FROM chain WHERE node % 400 = 1 UNION SELECT p.parent FROM p JOIN up USING (node)) SELECT node FROM up""")
def merged_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability in a graph with merges: some revisions have a second parent."""
    rows = chain(spark, sf_dir).withColumn("near", F.col("o_custkey"))  # parents are the customer's
    second = rows.filter("node % 50 = 0 and parent > node").select("node", (F.col("node") - 3).alias("parent"), "near").join(rows.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent", "near")
    return graph.ancestors_or_self(rows.filter("parent is not null").select("node", "parent", "near").unionAll(second), rows.filter("node % 400 = 1").select("node"))


# A history with many branches and merges: the n-th order (by date) comes after one of the 64 before it, and every fifth
# also merges one of the 1,000 before it.
_DAG = """n AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, o_orderkey AS node, o_totalprice FROM orders),
e AS (SELECT i, i - 1 - (i * 7) % 64 AS j, 0 AS pos FROM n UNION ALL SELECT i, i - 1 - (i * 13) % 1000, 1 FROM n WHERE i % 5 = 0),
p AS (SELECT a.node, b.node AS parent, pos FROM e JOIN n a USING (i) JOIN n b ON b.i = e.j)"""


def dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, i, o_totalprice) and parents (node, pos, parent, near: its i) of a history with branches and merges."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_orderdate", "o_totalprice")
    ordered = rows.repartitionByRange("o_orderdate", "node").sortWithinPartitions("o_orderdate", "node")
    # numbers in order: places within a range and the sizes of the ranges before
    part = written(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("o_orderdate", "node"))), "dag-parts")
    sizes = part.groupBy("part").count()
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "offset")
    nodes = written(part.join(offsets, "part").select("node", (F.col("offset") + F.col("at") - 1).alias("i"), "o_totalprice"), "dag-nodes")
    i = F.col("i")
    ways = nodes.select("node", "i", F.explode(F.array_compact(F.array(
        F.struct(F.lit(0).alias("pos"), (i - 1 - i * 7 % 64).alias("j")),
        F.when(i % 5 == 0, F.struct(F.lit(1).alias("pos"), (i - 1 - i * 13 % 1000).alias("j"))),
    ))).alias("way"))
    to = nodes.select(F.col("i").alias("j"), F.col("node").alias("parent"))
    return nodes, written(ways.select("node", "i", "way.*").join(to, "j").select("node", "pos", "parent", F.col("i").alias("near")), "dag-parents")


@query(f"""WITH RECURSIVE {_DAG}, r AS (SELECT node, CASE WHEN o_totalprice > 500000 THEN 2 ELSE 1 END AS phase FROM n WHERE o_totalprice > 480000),
down AS (SELECT node, phase FROM r UNION SELECT p.node, down.phase FROM p JOIN down ON p.parent = down.node)
SELECT n.node, CAST(coalesce(max(phase), 0) AS BIGINT) AS phase FROM n LEFT JOIN down USING (node) GROUP BY n.node""")
def merged_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases inherited over a deep history with merges."""
    nodes, parents = dag(spark, sf_dir)
    roots = nodes.filter("o_totalprice > 480000").select("node", F.when(F.col("o_totalprice") > 500000, 2).otherwise(1).alias("phase"))
    return graph.inherited_phase(parents, nodes, roots).select("node", F.col("phase").cast("bigint").alias("phase"))


@query(f"""WITH RECURSIVE {_DAG}, t AS (SELECT node, i % 3 = 0 AS dropped FROM n WHERE i % 500 = 7),
up AS (SELECT node, dropped FROM t UNION SELECT p.parent, up.dropped FROM p JOIN up USING (node))
SELECT node FROM up GROUP BY node HAVING bool_and(dropped)""")
def merged_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that only dropped tips reach, over a deep history with merges."""
    nodes, parents = dag(spark, sf_dir)
    tips = nodes.filter("i % 500 = 7")
    return graph.exclusive(parents, tips.filter("i % 3 = 0").select("node"), tips.filter("i % 3 <> 0").select("node"))


@query(f"""WITH RECURSIVE {_DAG}, o AS (SELECT DISTINCT l_orderkey AS node, l_partkey % 60 AS path, CASE WHEN (l_orderkey + l_partkey) % 5 < 2 THEN 'Add' WHEN (l_orderkey + l_partkey) % 5 < 4 THEN 'Modify' ELSE 'Delete' END AS op FROM lineitem),
u AS (SELECT node, path, min(op) AS op FROM o GROUP BY node, path), f AS (SELECT node, parent FROM p WHERE pos = 0),
w AS (SELECT u.node, u.path, u.op, f.parent AS here, CAST(NULL AS VARCHAR) AS state FROM u LEFT JOIN f USING (node)
  UNION ALL SELECT w.node, w.path, w.op, f.parent, CASE WHEN a.op IN ('Add', 'Delete') THEN a.op END FROM w LEFT JOIN f ON f.node = w.here LEFT JOIN u a ON a.node = w.here AND a.path = w.path WHERE w.here IS NOT NULL AND w.state IS NULL)
SELECT node, path, op FROM w WHERE (here IS NULL OR state IS NOT NULL) AND (op = 'Add') = (coalesce(state, '') = 'Add')""")
def replay_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops that do not fit the tree of their first parents, in a history of many branches."""
    nodes, parents = dag(spark, sf_dir)
    k = (F.col("l_orderkey") + F.col("l_partkey")) % 5
    ops = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), (F.col("l_partkey") % 60).alias("path"), F.when(k < 2, "Add").when(k < 4, "Modify").otherwise("Delete").alias("op"))
    ops = ops.groupBy("node", "path").agg(F.min("op").alias("op"))
    return verify.misfits(ops, nodes.select("node", F.col("i").alias("near")), parents.filter("pos = 0").select("node", F.col("parent").alias("up")))


@query(f"""WITH {_CHAIN}, c AS (SELECT node, parent, node % 3 AS kind FROM chain WHERE parent IS NOT NULL) SELECT node, 'a' || parent AS "from" FROM c WHERE kind = 0 AND node % 4 <> 1""")
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir).filter("parent is not null").select("node", "parent")
    k = F.col("node") % 3  # a move; a copy from elsewhere; a copy whose source stays
    copies = rows.select(F.col("node").alias("atom_id"), F.concat(F.lit("a"), F.col("parent").cast("string")).alias("from"), F.when(k == 1, F.col("parent") - 1).otherwise(F.col("parent")).alias("from_atom"))
    ops = rows.filter("node % 3 < 2").select(F.col("node").alias("atom_id"), F.concat(F.lit("a"), F.col("parent").cast("string")).alias("path"), F.when(F.col("node") % 4 == 1, "Modify").otherwise("Delete").alias("op"))
    parents = rows.select(F.col("node").alias("atom_id"), F.lit(0).alias("pos"), F.col("parent").alias("parent_id"))
    return diff.moves(copies, ops, parents).select(F.col("atom_id").alias("node"), "from")


@query(f"""WITH {_CHAIN}, u AS (SELECT o_custkey % 50 AS tree FROM chain UNION ALL SELECT p.o_custkey % 50 FROM chain c JOIN chain p ON c.parent = p.node) SELECT tree, count(*) AS uses FROM u GROUP BY 1""")
def snapshot_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_uses(chain(spark, sf_dir).select("node", "parent", (F.col("o_custkey") % 50).alias("tree")))


@query("""SELECT c_custkey AS line_no, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' <x>' ELSE c_name END AS old_name, c_custkey || '@old.org' AS old_email, 'N' || c_custkey AS new_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'n@new.org' END AS new_email FROM customer WHERE c_custkey % 3 <> 0""")
def author_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    old = F.concat("c_name", F.when(k % 7 == 0, " <x>").otherwise(""), F.lit(" <"), text, F.lit("@old.org>"))
    new = F.concat(F.lit("N"), text, F.when(k % 5 == 0, " <>").otherwise(" <n@new.org>"))
    line = F.when(k % 6 == 0, "  ").when(k % 3 == 0, F.concat(F.lit("# "), "c_name")).otherwise(F.concat(F.lit(" "), old, F.lit(" = "), new, F.lit(" ")))
    return transform.author_map(table(spark, sf_dir, "customer").select(k.alias("line_no"), line.alias("line")))


# --- reports ----------------------------------------------------------------------------------------------------------------


@query("""SELECT 'dropped' AS section, lang AS label, 'dropped.' || replace(lang, '-', '_') || '=' || count(*) AS line FROM documents GROUP BY lang UNION ALL SELECT 'total', 'atoms', 'atoms=' || count(*) FROM labels""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(F.lit("dropped").alias("section"), F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return report.machine_lines(rows.unionAll(table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit("atoms").alias("label"), "n")))


@query("""SELECT r_name AS name, CAST(CASE WHEN r_regionkey % 3 = 0 THEN 30 WHEN r_regionkey % 3 = 1 THEN 10 ELSE 0 END AS BIGINT) AS exit FROM region""")
def exit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = None
    for key, name in sorted((r["r_regionkey"], r["r_name"]) for r in table(spark, sf_dir, "region").collect()):  # five rows
        part = nation.filter(F.col("r_regionkey") == key).select(F.lit(("flagged", "dropped", "derived")[key % 3]).alias("section"), F.lit("x").alias("label"), F.lit(2).cast("bigint").alias("n"))
        one = report.exit_class(part).select(F.lit(name).alias("name"), F.col("exit").cast("bigint").alias("exit"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""WITH p AS (SELECT l_orderkey AS k, l_partkey AS path, min(l_returnflag) AS f FROM lineitem GROUP BY ALL), a AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS atom_idx, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS j, 'atom.' || k || '.id=' || sha256(CAST(k AS VARCHAR)) AS line FROM a
UNION ALL SELECT k, 1, row_number() OVER (PARTITION BY k ORDER BY lpad(CAST(path AS VARCHAR), 9, '0')) - 1, NULL FROM p JOIN a USING (k)""")
def report_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = table(spark, sf_dir, "orders").select(F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("atom_id"), F.col("o_orderkey").alias("atom_idx"))
    ops = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("f"))
    ops = ops.select(F.unhex(F.sha2(F.col("l_orderkey").cast("string"), 256)).alias("atom_id"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("path"), F.when(F.col("f") == "R", "Delete").otherwise("Add").alias("op"), F.lit(None).cast("binary").alias("blob_id"), F.lit(None).cast("int").alias("mode"))
    rows = report.machine_atoms(atoms, ops)
    return rows.select("atom_idx", F.col("part").cast("bigint").alias("part"), F.col("j").cast("bigint").alias("j"), F.when(F.col("part") == 0, F.col("line")).alias("line"))


# --- checks -------------------------------------------------------------------------------------------------------------------


def key_id(c) -> F.Column:
    return F.unhex(F.sha2(c.cast("string"), 256))


def filled(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df with the columns of a history table, in order; what it lacks is null."""
    fields = spark.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def status(base: str, kind=None, by=None, version=None, params=None, confidence=None, layers=None) -> F.Column:
    none = F.lit(None)
    derivation = F.struct((kind if kind is not None else none).alias("kind"), none.alias("kind_label"), (by if by is not None else none).alias("by"), (version if version is not None else none).alias("decoder_version"), (params if params is not None else none).alias("params"), (confidence if confidence is not None else none).alias("confidence"))
    return F.struct(F.lit(base).alias("base"), (derivation if base == "derived" else none).alias("derivation"), (layers if layers is not None else F.array()).alias("layers"))


def bundle(spark: SparkSession, sf_dir: str, **tables: DataFrame) -> History:
    """Orders as atoms in order of date and number, whatever else is given."""
    node = F.col("o_orderkey")
    idx = F.call_function("div", seconds("o_orderdate"), F.lit(86400).cast("bigint")) * 10_000_000_000 + node
    atoms = table(spark, sf_dir, "orders").select(key_id(node).alias("atom_id"), idx.alias("atom_idx"), status("stated").alias("status"), node.alias("node"))
    made = {"atoms": atoms} | tables
    return History.of(spark, **{n: filled(spark, df, n) for n, df in made.items()})


_AT = "SELECT o_orderkey AS k, epoch_us(o_orderdate) // 86400000000 * 10000000000 + o_orderkey AS idx FROM orders"
_ID = "sha256(CAST({} AS VARCHAR))"


@query(f"""WITH {_CHAIN}, one AS ({_AT}), a AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE k % 211 = 0),
par AS (SELECT node AS k, CASE WHEN node % 97 = 1 THEN node ELSE parent END AS p FROM chain WHERE parent IS NOT NULL), cop AS (SELECT node AS k, 'c' || node AS t, CASE node % 13 WHEN 0 THEN -node WHEN 1 THEN node ELSE parent END AS p FROM chain WHERE parent IS NOT NULL),
r AS (SELECT n_name AS name, n_nationkey * 3 - 9 AS target FROM nation UNION ALL SELECT n_name, n_nationkey * 3 - 9 FROM nation WHERE n_regionkey = 2),
d AS (SELECT 'parent not earlier: ' || {_ID.format('par.k')} AS detail FROM par JOIN a ON a.k = par.k LEFT JOIN a u ON u.k = par.p WHERE u.idx IS NULL OR u.idx >= a.idx
UNION ALL SELECT 'copy source not earlier: ' || t FROM cop JOIN a ON a.k = cop.k LEFT JOIN a u ON u.k = cop.p WHERE u.idx IS NULL OR u.idx >= a.idx
UNION ALL SELECT 'atom twice: ' || {_ID.format('k')} FROM a GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'path twice: p' || l_partkey % 40 FROM lineitem GROUP BY l_orderkey, l_partkey % 40 HAVING count(*) > 1
UNION ALL SELECT 'ref without target: ' || name FROM r WHERE target NOT IN (SELECT k FROM a) UNION ALL SELECT 'ref twice: ' || name FROM r GROUP BY name HAVING count(*) > 1)
SELECT 'structure' AS "check", detail, count(*) AS n FROM d GROUP BY detail""")
def structure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bundle(spark, sf_dir)
    steps = chain(spark, sf_dir).filter("parent is not null")
    node, parent = F.col("node"), F.col("parent")
    parents = steps.select(key_id(node).alias("atom_id"), F.lit(0).alias("pos"), key_id(F.when(node % 97 == 1, node).otherwise(parent)).alias("parent_id"))
    copies = steps.select(key_id(node).alias("atom_id"), F.lit("f").alias("from"), key_id(F.when(node % 13 == 0, -node).when(node % 13 == 1, node).otherwise(parent)).alias("from_atom"), F.concat(F.lit("c"), node.cast("string")).alias("to"))
    ops = table(spark, sf_dir, "lineitem").select(key_id(F.col("l_orderkey")).alias("atom_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("path"))
    nation = table(spark, sf_dir, "nation")
    names = nation.unionAll(nation.filter("n_regionkey = 2")).select(F.col("n_name").alias("name"), F.lit("branch").alias("kind"), key_id(F.col("n_nationkey") * 3 - 9).alias("target"))
    twice = h.atoms.unionAll(h.atoms.join(table(spark, sf_dir, "orders").filter("o_orderkey % 211 = 0").select(key_id(F.col("o_orderkey")).alias("atom_id")), "atom_id", "left_semi"))
    h = h.replace(atoms=twice, parents=filled(spark, parents, "parents"), copies=filled(spark, copies, "copies"), ops=filled(spark, ops, "ops"), refs=filled(spark, names, "refs"))
    return verify.structure(h).groupBy("check", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT CASE WHEN doc_id % 50 = 0 THEN sha256('x' || doc_id) ELSE sha256(text) END AS id, sha256(text) AS real FROM documents WHERE text IS NOT NULL),
u AS (SELECT DISTINCT CASE WHEN doc_id % 70 = 0 THEN sha256('gone' || doc_id) ELSE sha256(text) END AS id FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0),
d AS (SELECT 'content is not its id: ' || id AS detail FROM b WHERE id <> real UNION ALL SELECT 'missing blob: ' || id FROM u WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'unused blob: ' || id FROM b WHERE id NOT IN (SELECT id FROM u))
SELECT 'integrity' AS "check", detail, count(*) AS n FROM d GROUP BY detail""")
def integrity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    named = lambda text: F.unhex(F.sha2(F.concat(F.lit(text), F.col("doc_id").cast("string")), 256))
    real = F.unhex(F.sha2("text", 256))
    blobs = docs.select(F.when(F.col("doc_id") % 50 == 0, named("x")).otherwise(real).alias("blob_id"), F.octet_length("text").alias("length"), F.encode("text", "UTF-8").alias("content"))
    ops = docs.filter("doc_id % 3 <> 0").select(key_id(F.col("doc_id")).alias("atom_id"), F.lit("p").alias("path"), F.when(F.col("doc_id") % 70 == 0, named("gone")).otherwise(real).alias("blob_id"))
    h = bundle(spark, sf_dir, blobs=blobs, ops=ops)
    return verify.integrity(h).groupBy("check", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT CASE WHEN conv_id % 4 = 0 THEN 'rename_threshold' ELSE '' END AS missing, conv_id % 7 = 0 AS nobody, turn % 5 = 0 AS unversioned, turn * 30 > 100 AS sure FROM conversations)
SELECT 'derivations' AS "check", 'op: inferred-rename ' || missing AS detail, count(*) AS n FROM d WHERE missing <> '' OR nobody OR unversioned OR sure GROUP BY missing""")
def derivation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.create_map(F.lit("rename_algorithm"), F.lit("exact"), F.lit("rename_threshold"), F.lit("100"))
    params = F.when(F.col("conv_id") % 4 == 0, F.create_map(F.lit("rename_algorithm"), F.lit("exact"))).otherwise(both)
    made = status("derived", F.lit("inferred-rename"), F.when(F.col("conv_id") % 7 == 0, "").otherwise("me"), F.when(F.col("turn") % 5 != 0, "1"), params, F.col("turn") * 30)
    ops = table(spark, sf_dir, "conversations").select(key_id(F.col("conv_id")).alias("atom_id"), F.lit("p").alias("path"), made.alias("status"))
    return verify.derivations(bundle(spark, sf_dir, ops=ops)).groupBy("check", "detail").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH m AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'svn' AS source, 'atom not stated' AS detail, count(*) AS n FROM orders WHERE o_orderstatus = 'F' HAVING count(*) > 0 UNION ALL SELECT 'svn', 'too many parents: ' || {_ID.format('k')}, 1 FROM m WHERE n > 1
UNION ALL SELECT 'svn', 'ref not derived', count(*) FROM nation UNION ALL SELECT 'hg', 'too many parents: ' || {_ID.format('k')}, 1 FROM m WHERE n > 2 UNION ALL SELECT 'git', 'copy not derived', count(*) FROM supplier
UNION ALL SELECT 'cvs', 'atom not derived', count(*) FROM orders WHERE o_orderstatus <> 'F' HAVING count(*) > 0 UNION ALL SELECT 'cvs', 'atom of another derivation', count(*) FROM orders WHERE o_orderstatus = 'F' HAVING count(*) > 0
UNION ALL SELECT 'cvs', 'ref not derived', count(*) FROM nation UNION ALL SELECT 'cvs', 'copies cannot be stated', count(*) FROM supplier""")
def invariant_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "struct<base:string,derivation:struct<kind:string,kind_label:string,`by`:string,decoder_version:string,params:map<string,string>,confidence:int>,layers:array<struct<step:int,changed:array<string>>>>"
    made = F.when(F.col("o_orderstatus") == "F", status("derived", F.lit("inferred-rename")).cast(kind)).otherwise(status("stated").cast(kind))
    atoms = table(spark, sf_dir, "orders").select(key_id(F.col("o_orderkey")).alias("atom_id"), F.col("o_orderkey").alias("atom_idx"), made.alias("status"))
    parents = table(spark, sf_dir, "lineitem").select(key_id(F.col("l_orderkey")).alias("atom_id"), F.col("l_linenumber").alias("pos"), key_id(F.col("l_partkey")).alias("parent_id"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("branch").alias("kind"), status("stated").alias("status"))
    copies = table(spark, sf_dir, "supplier").select(key_id(F.col("s_suppkey")).alias("atom_id"), F.col("s_name").alias("to"), status("stated").alias("status"))
    h = bundle(spark, sf_dir, atoms=atoms, parents=parents, refs=names, copies=copies)
    out = None
    for source in ("svn", "hg", "git", "cvs"):
        one = verify.source_invariants(h.replace(provenance=filled(spark, spark.range(1).select(F.lit(source).alias("source_kind")), "provenance")))
        one = one.groupBy("detail").agg(F.count(F.lit(1)).alias("n")).select(F.lit(source).alias("source"), "detail", "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("""SELECT 'provenance' AS "check", 'an empty version or kind' AS detail, count(*) AS n FROM region WHERE r_regionkey IN (1, 3) UNION ALL SELECT 'loss-boundary', lang, count(*) FROM documents WHERE doc_id % 9 = 0 OR doc_id % 11 = 1 GROUP BY lang""")
def boundary_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    made = table(spark, sf_dir, "region").select(F.when(key == 1, "").otherwise("git").alias("source_kind"), F.when(key != 3, "1").alias("tool_version"), F.lit("1").alias("decoder_version"))
    drops = table(spark, sf_dir, "documents").select(F.col("lang").alias("class"), F.when(F.col("doc_id") % 9 == 0, "").otherwise("w").alias("what"), F.when(F.col("doc_id") % 11 != 1, "r").alias("reason"))
    h = bundle(spark, sf_dir, provenance=made, drops=drops)
    return verify.provenance(h).unionAll(verify.loss_boundary(h)).groupBy("check", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT CASE WHEN doc_id % 4 = 0 THEN [2, 1] WHEN doc_id % 4 = 1 THEN [1, 2] WHEN doc_id % 4 = 2 AND toxic = 1 THEN [9] ELSE [] END AS s FROM labels)
SELECT 'chain' AS rule, 'atom: layers out of order' AS detail, count(*) AS n FROM l WHERE s = [1, 2] OR s = [9] HAVING count(*) > 0 UNION ALL SELECT 'old', 'atom', count(*) FROM l WHERE len(s) > 0 UNION ALL SELECT 'old', 'transforms', 2""")
def layer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = lambda s: F.struct(F.lit(s).alias("step"), F.array().cast("array<string>").alias("changed"))
    k = F.col("doc_id")
    layers = F.when(k % 4 == 0, F.array(layer(2), layer(1))).when(k % 4 == 1, F.array(layer(1), layer(2))).when((k % 4 == 2) & (F.col("toxic") == 1), F.array(layer(9))).otherwise(F.array().cast("array<struct<step:int,changed:array<string>>>"))
    atoms = table(spark, sf_dir, "labels").select(key_id(k).alias("atom_id"), k.alias("atom_idx"), status("stated", layers=layers).alias("status"))
    steps = spark.createDataFrame([(1, "a", "1"), (2, "b", "1")], "step int, name string, version string")
    h = bundle(spark, sf_dir, atoms=atoms, transforms=steps)
    count = lambda df, rule: df.groupBy("detail").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "detail", "n")
    return count(verify.transform_chain(h), "chain").unionAll(count(verify.readable(h, (0, 2)), "old")).unionAll(count(verify.readable(h, (0, 3)), "new"))


@query("""SELECT o_orderkey AS node, o_orderstatus AS status, 'stored' AS side FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus <> 'X' OR o_orderkey % 101 = 0
UNION ALL SELECT o_orderkey, 'X', 'source' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey % 101 <> 0 AND o_orderstatus <> 'X'""")
def against_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("status"))
    again = mine.filter("node % 101 <> 0").withColumn("status", F.when(F.col("node") % 100 == 0, "X").otherwise(F.col("status")))
    return verify.against_source(mine, again)


@query("""SELECT * FROM (VALUES (0, 'integrity', 'pass'), (1, 'structure', 'pass'), (2, 'replay', 'pass'), (3, 'derivations', 'pass'), (4, 'source-invariants', 'fail'), (5, 'provenance', 'pass'), (6, 'loss-boundary', 'pass')) v(position, "check", outcome)""")
def check_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("branch").alias("kind"), status("stated").alias("status"))
    made = spark.range(1).select(F.lit("svn").alias("source_kind"), F.lit("1").alias("tool_version"), F.lit("1").alias("decoder_version"))
    return verify.outcomes(bundle(spark, sf_dir, refs=names, provenance=made)).select(F.col("position").cast("int").alias("position"), "check", "outcome")


# --- edits ------------------------------------------------------------------------------------------------------------------


def _edited(spark: SparkSession, sf_dir: str) -> History:
    steps = chain(spark, sf_dir).filter("parent is not null")
    parents = steps.select(key_id(F.col("node")).alias("atom_id"), F.lit(0).alias("pos"), key_id(F.col("parent")).alias("parent_id"))
    ops = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_quantity").alias("q")).select(key_id(F.col("l_orderkey")).alias("atom_id"), F.col("l_partkey").cast("string").alias("path"), F.lit("Add").alias("op"), F.lit(33188).alias("mode"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("branch").alias("kind"))
    copies = table(spark, sf_dir, "orders").filter("o_orderkey % 17 = 0").select(key_id(F.col("o_orderkey")).alias("atom_id"), F.col("o_orderkey").cast("string").alias("to"))
    h = bundle(spark, sf_dir, parents=parents, ops=ops, refs=names, copies=copies)
    kind = {f.name: f.dataType for f in h.atoms.schema}
    text = lambda t: F.struct(F.encode(F.lit(t), "UTF-8").alias("bytes"), F.lit(None).cast("string").alias("encoding"))
    who = F.struct(text("n").alias("name"), text("e").alias("email")).cast(kind["author"])
    when = F.struct(F.lit(5).cast("bigint").alias("seconds"), F.lit(0).cast("smallint").alias("offset_minutes")).cast(kind["author_time"])
    every = lambda n: F.col("atom_idx") % n == 0  # noqa: E731  the number is the last part of the index
    edit = transform.Edit(h, "tidy", "1").set_author(who, every(10)).set_committer(who, every(4)).set_author_time(when, every(6)).set_commit_time(when, every(8)).set_message(text("m").cast(kind["message"]), every(14))
    edit.set_op("mode", F.lit(33261), F.col("path").cast("bigint") % 3 == 0).remove_ops(F.col("path").cast("bigint") % 50 == 1, "noise").remove_copies(F.col("to").cast("bigint") % 2 == 0, "even")
    edit.rename_ref("branch", "FRANCE", "france").remove_ref("branch", "CHINA", "gone")
    note = {f.name: f.dataType for f in h.refs.schema}["annotation"]
    edit.set_ref_annotation("branch", "france", F.struct(text("note").alias("message"), F.lit(None).alias("tagger"), F.lit(None).alias("time")).cast(note))
    return edit.remove_atoms(every(30), "thirtieth").finish()


_EVERY = "list_filter(['author', 'author_time', 'commit_time', 'committer', 'message'], lambda p: idx % CASE p WHEN 'author' THEN 10 WHEN 'author_time' THEN 6 WHEN 'commit_time' THEN 8 WHEN 'committer' THEN 4 ELSE 14 END = 0)"


@query(f"SELECT {_ID.format('k')} AS atom, array_to_string({_EVERY}, ',') AS changed FROM ({_AT}) WHERE idx % 30 <> 0 AND len({_EVERY}) > 0")
def edit_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir).atoms.filter("size(status.layers) > 0").select(F.lower(F.hex("atom_id")).alias("atom"), F.array_join(F.col("status.layers")[0]["changed"], ",").alias("changed"))


@query(f"""SELECT 'op ' || {_ID.format('l_orderkey')} || ' ' || l_partkey AS what, 'noise' AS reason, 1 AS step FROM lineitem WHERE l_partkey % 50 = 1 GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'copy ' || {_ID.format('o_orderkey')} || ' ' || o_orderkey, 'even', 1 FROM orders WHERE o_orderkey % 34 = 0 UNION ALL SELECT 'ref branch CHINA', 'gone', 1 FROM nation WHERE n_name = 'CHINA'
UNION ALL SELECT 'atom ' || {_ID.format('k')}, 'thirtieth', 1 FROM ({_AT}) WHERE idx % 30 = 0""")
def edit_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir).drops.select("what", "reason", "step")


@query("""SELECT CASE n_name WHEN 'FRANCE' THEN 'france' ELSE n_name END AS name, CAST(n_name = 'FRANCE' AS BIGINT) AS annotated FROM nation WHERE n_name <> 'CHINA'""")
def edit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir).refs.select("name", F.col("annotation").isNotNull().cast("bigint").alias("annotated"))


@query(f"""WITH o AS (SELECT l_orderkey AS k, l_partkey AS path FROM lineitem GROUP BY ALL) SELECT CAST(CASE WHEN path % 3 = 0 THEN 33261 ELSE 33188 END AS BIGINT) AS mode, count(*) AS n FROM o JOIN ({_AT}) USING (k) WHERE idx % 30 <> 0 AND path % 50 <> 1 GROUP BY 1""")
def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir).ops.groupBy(F.col("mode").cast("bigint").alias("mode")).agg(F.count(F.lit(1)).alias("n"))


# --- frames and artifact files ---------------------------------------------------------------------------------------


@query("""WITH RECURSIVE l AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
f AS (SELECT k, doc_id, CAST(0 AS BIGINT) AS frame, n AS held FROM l WHERE k = 1
UNION ALL SELECT l.k, l.doc_id, CASE WHEN held + n <= 16384 THEN frame ELSE frame + 1 END, CASE WHEN held + n <= 16384 THEN held + n ELSE n END FROM f JOIN l ON l.k = f.k + 1)
SELECT doc_id, k - 1 AS rank, frame FROM f""")
def frame_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy frames of 16 KiB over the documents in order; longer ones stand alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    return frames.framed(docs, ["doc_id"], "n", 16384).select("doc_id", "rank", "frame")


@query("""WITH c AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
SELECT sha256(text) AS blob, octet_length(encode(text)) AS length, row_number() OVER (ORDER BY sha256(text)) - 1 AS rank FROM c""")
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts written to an artifact file and read back by frames; its digest must be that of what is in it."""
    texts = table(spark, sf_dir, "documents").filter("text is not null").select(F.encode("text", "UTF-8").alias("content"))
    contents = texts.withColumn("blob_id", F.unhex(F.sha2("content", 256))).dropDuplicates(["blob_id"])
    path, magic = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}.art", b"history"
    artifact.write(contents, path, magic)
    artifact.checked(spark, path, magic)
    back = artifact.read(spark, path, magic)
    return back.select(F.lower(F.hex("blob_id")).alias("blob"), F.when(F.sha2("content", 256) == F.lower(F.hex("blob_id")), F.octet_length("content")).cast("long").alias("length"), "rank")


@query("""WITH r AS (SELECT l_orderkey AS rev, 'd' || (l_suppkey % 20) || '/f' || (l_partkey % 50) AS path, bool_or(l_returnflag = 'R') AS gone FROM lineitem GROUP BY ALL),
n AS (SELECT *, lead(rev) OVER (PARTITION BY path ORDER BY rev) AS until FROM r), l AS (SELECT path, rev, until FROM n WHERE NOT gone),
t AS (SELECT o_orderkey AS rev, 'd' || (o_custkey % 20) AS src FROM orders WHERE o_orderstatus = 'P')
SELECT path, rev, until FROM l UNION ALL
SELECT 'tags/' || t.rev || substr(l.path, length(src) + 1), t.rev, NULL FROM t JOIN l ON starts_with(l.path, src || '/') AND l.rev < t.rev AND (l.until IS NULL OR l.until >= t.rev)""")
def tagged_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lives of files in a stream of revisions that copies folders to tags."""
    place = F.concat(F.lit("d"), (F.col("l_suppkey") % 20).cast("string"), F.lit("/f"), (F.col("l_partkey") % 50).cast("string"))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("revision"), place.alias("path")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("gone"))
    files = files.select("revision", F.row_number().over(W.partitionBy("revision").orderBy("path")).cast("long").alias("ord"), "path", F.lit("file").alias("kind"), F.when(F.col("gone"), "delete").otherwise("change").alias("action"), F.lit(None).cast("long").alias("copyfrom_rev"), F.lit(None).cast("string").alias("copyfrom_path"))
    tags = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("revision"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("tags/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit("dir").alias("kind"), F.lit("add").alias("action"), (F.col("o_orderkey") - 1).alias("copyfrom_rev"), F.concat(F.lit("d"), (F.col("o_custkey") % 20).cast("string")).alias("copyfrom_path"))
    lived = svntree.lives(files.unionAll(tags))
    return lived.select("path", F.shiftright("at", 24).alias("rev"), F.shiftright("until", 24).alias("until"))
