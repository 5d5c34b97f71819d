"""Histories from the readers' raw tables: one function per source, one assembly for all."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .. import __version__
from ..functions import canon
from ..functions import scalars as S
from ..history import SCHEMAS, STATUS, History
from ..operators import branches as branching
from ..operators import cluster, diff, graph, verify
from ..operators import refs as names
from ..storage import written
from . import cvsbranches, gitstore, rcs, revlog, svndump, svntree


def stated() -> Column:
    return F.struct(F.lit("stated").alias("base"), F.lit(None).alias("derivation"), F.array().alias("layers")).cast(STATUS)


def derived(kind: str, params: dict[str, str], confidence: Column | None = None) -> Column:
    pairs = [F.lit(x) for kv in sorted(params.items()) for x in kv]
    made = F.struct(F.lit(kind).alias("kind"), F.lit(None).alias("kind_label"), F.lit("annalspark").alias("by"), F.lit(__version__).alias("decoder_version"), F.create_map(*pairs).alias("params"), (confidence if confidence is not None else F.lit(None)).cast("int").alias("confidence"))
    return F.struct(F.lit("derived").alias("base"), made.alias("derivation"), F.array().alias("layers")).cast(STATUS)


def _text(value: Column, encoding: Column | None = None) -> Column:
    return F.when(value.isNotNull(), F.struct(value.cast("binary").alias("bytes"), (encoding if encoding is not None else F.lit(None)).cast("string").alias("encoding")))


def _person(name: Column, email: Column | None) -> Column:
    none = F.lit(None).cast("struct<bytes:binary,encoding:string>")
    return F.when(name.isNotNull(), F.struct(_text(name).alias("name"), (F.when(email.isNotNull(), _text(email)) if email is not None else none).alias("email")))


def _time(seconds: Column, offset: Column | None = None) -> Column:
    return F.when(seconds.isNotNull(), F.struct(seconds.cast("bigint").alias("seconds"), (offset if offset is not None else F.lit(None)).cast("smallint").alias("offset_minutes")))


def _cast(df: DataFrame, table: str, rename: dict[str, str]) -> DataFrame:
    """Columns of a history table, missing ones null, node columns under their working names."""
    want = T._parse_datatype_string(SCHEMAS[table])
    return df.select(*[(F.col(rename.get(f.name, f.name)) if rename.get(f.name, f.name) in df.columns else F.lit(None)).cast(f.dataType if f.name not in rename else df.schema[rename[f.name]].dataType).alias(rename.get(f.name, f.name)) for f in want])


def assemble(spark: SparkSession, kind: str, repo_id: bytes, atoms: DataFrame, parents: DataFrame, ops: DataFrame, copies: DataFrame | None = None, ref_rows: DataFrame | None = None, blobs: DataFrame | None = None, drops: list[tuple] = (), flags: list[tuple] = (), params: dict[str, str] | None = None) -> History:
    """A history from rows keyed by source identities.

    atoms: node (binary), order (ties among ready revisions) and claims; parents: node, pos, parent; ops: node, path, op,
    blob_id, mode, status; copies: node, from, from_node, to, status; refs: name, kind, target (a node), status.
    """
    ready = atoms.join(parents.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "parent"))).alias("p")), "node", "left")
    order = graph.topological_order(ready.select("node", F.col("order").alias("source"), F.coalesce(F.transform("p", lambda x: x["parent"]), F.array().cast("array<binary>")).alias("parents")))
    source = F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("kind_label"), F.lit(repo_id).cast("binary").alias("repo_id"), F.col("node").alias("id"))
    claims = ["author", "author_time", "committer", "commit_time", "message"]
    types = {f.name: f.dataType for f in T._parse_datatype_string(SCHEMAS["atoms"])}
    full = atoms.join(order, "node").select("node", "position", source.alias("source"), *[(F.col(c) if c in atoms.columns else F.lit(None)).cast(types[c]).alias(c) for c in claims], "status")
    ops = _cast(ops, "ops", {"atom_id": "node"})
    none = spark.createDataFrame([], SCHEMAS["copies"].replace("atom_id binary", "node binary").replace("from_atom binary", "from_node binary"))
    copies = _cast(copies, "copies", {"atom_id": "node", "from_atom": "from_node"}) if copies is not None else none
    ids = written(canon.atom_ids(full, parents, ops, copies), "atom-ids")
    to = lambda c, name: ids.select(F.col("node").alias(c), F.col("atom_id").alias(name))
    made = {
        "atoms": full.join(ids, "node").select("atom_id", F.col("position").alias("atom_idx"), "source", *claims, "status"),
        "parents": parents.join(ids, "node").join(to("parent", "parent_id"), "parent").select("atom_id", F.col("pos").cast("int").alias("pos"), "parent_id"),
        "ops": ops.join(ids, "node").select("atom_id", "path", "op", "blob_id", "mode", "status"),
        "copies": copies.join(ids, "node").join(to("from_node", "from_atom"), "from_node").select("atom_id", "from", "from_atom", "to", "status"),
        "drops": spark.createDataFrame(list(drops), SCHEMAS["drops"]), "flags": spark.createDataFrame(list(flags), SCHEMAS["flags"]),
        "provenance": spark.createDataFrame([(kind, __version__, __version__, repo_id, params or {})], SCHEMAS["provenance"]),
    }
    if ref_rows is not None:
        r = ref_rows.withColumnRenamed("target", "node").join(ids, "node", "left").withColumn("target", F.col("atom_id"))
        made["refs"] = _cast(r.drop("node", "atom_id"), "refs", {})
    if blobs is not None:
        used = ops.filter("blob_id is not null").select("blob_id").distinct()
        made["blobs"] = blobs.select("blob_id", F.length("content").cast("bigint").alias("length"), "content").dropDuplicates(["blob_id"]).join(used, "blob_id", "left_semi")
    return History.of(spark, **made)


def from_git(spark: SparkSession, git_dir: str, infer_renames: bool = False) -> History:
    """Commits reachable from branches and tags; other references are counted as losses."""
    t = {k: written(v, f"git-{k}") for k, v in gitstore.read(spark, git_dir).items()}
    tips = gitstore.peeled(t["refs"], t["tags"]).withColumn("kind", gitstore.ref_kind(F.col("name")))
    carried = tips.filter("kind is not null").join(t["commits"].select(F.col("oid").alias("target")), "target", "left_semi")
    edges = t["commits"].select(F.col("oid").alias("node"), F.posexplode("parents").alias("pos", "parent"))
    lines = graph.Lines.of(edges)
    reach = graph.ancestors_or_self(lines, carried.select(F.col("target").alias("node")))
    commits = written(t["commits"].withColumnRenamed("oid", "node").join(reach, "node", "left_semi"), "git-reached")
    parents = edges.join(reach, "node", "left_semi")
    files = written(gitstore.snapshot(t["tree_entries"], commits.select(F.col("tree").alias("root")).distinct()), "git-files")
    first = commits.select("node", "tree", F.get("parents", F.lit(0)).alias("parent"))
    state = lambda c, key: c.join(files, F.col("root") == F.col(key)).select(F.col("node").alias("atom"), "path", F.col("oid").alias("blob"), "mode")
    base = first.filter("parent is not null").join(commits.select(F.col("node").alias("parent"), F.col("tree").alias("base_tree")), "parent")
    ops = written(diff.snapshot_diff(state(base, "base_tree"), state(first, "tree"), ("blob", "mode")), "git-ops")
    contents = t["objects"].filter("kind = 'blob'").select("oid", "content", F.unhex(F.sha2("content", 256)).alias("blob_id"))
    rows = ops.join(contents.select(F.col("oid").alias("new_blob"), "blob_id"), "new_blob", "left")
    rows = rows.select(F.col("atom").alias("node"), "path", "op", F.when(F.col("op") != "Delete", F.col("blob_id")).alias("blob_id"), F.col("new_mode").alias("mode"), stated().alias("status"))
    copies = None
    if infer_renames:
        found = diff.exact_renames(ops.join(base.select(F.col("node").alias("atom")), "atom").select("atom", "path", "op", F.coalesce("new_blob", "old_blob").alias("blob")))
        status = derived("inferred-rename", {"rename_algorithm": "exact-content", "rename_threshold": "100"}, F.lit(100))
        copies = found.join(first.select(F.col("node").alias("atom"), F.col("parent").alias("from_node")), "atom").select(F.col("atom").alias("node"), F.col("from_path").alias("from"), "from_node", F.col("to_path").alias("to"), status.alias("status"))
    atoms = commits.select(
        "node", F.col("node").alias("order"), _person(F.col("author_name"), F.col("author_email")).alias("author"), _person(F.col("committer_name"), F.col("committer_email")).alias("committer"),
        _time(S.strict_seconds(F.col("author_seconds")), S.strict_offset_minutes(F.col("author_offset"))).alias("author_time"), _time(S.strict_seconds(F.col("commit_seconds")), S.strict_offset_minutes(F.col("commit_offset"))).alias("commit_time"),
        _text(F.col("message"), F.col("encoding")).alias("message"), stated().alias("status"),
    )
    lost = t["refs"].filter(gitstore.ref_kind(F.col("name")).isNull() & F.col("oid").isNotNull()).count()
    drops = [("namespace", "references outside branches and tags", f"{lost} references are not carried", None)] if lost else []
    heads = lambda which: tips.filter(which).join(t["commits"].select(F.col("oid").alias("target")), "target", "left_semi").select(F.col("target").alias("node"))
    if lost and (only := graph.exclusive_count(lines, heads("kind is null"), heads("kind is not null"))):
        drops.append(("commits", "commits that only dropped references reach", f"{only} commits are not carried", None))
    repo = commits.filter("size(parents) = 0").agg(F.min("node")).first()[0]
    return assemble(spark, "git", bytes(repo or b""), atoms, parents, rows, copies, carried.select("name", "kind", "target", stated().alias("status")), contents, drops, params={"infer_renames": str(infer_renames).lower()})


def from_cvs(spark: SparkSession, root: str, window: int = 180, floor: int = 50) -> History:
    """Changesets of a CVS repository, reconstructed line by line; tags and branches become derived references."""
    t = {k: written(v, f"cvs-{k}") for k, v in rcs.read(spark, root).items()}
    vendor = t["files"].select("path", S.parse_dotted(F.col("vendor_branch")).alias("vendor"))
    unclear = verify.trunk_after_vendor(t["files"].withColumn("vendor_branch", F.nullif("vendor_branch", F.lit(""))), t["revisions"].select("path", "rev")).select("path").limit(5).collect()
    if unclear:
        raise rcs.Malformed(f"a default branch and later trunk revisions: {[r[0] for r in unclear]}")
    every = t["revisions"].join(vendor, "path")
    revs = every.filter(S.is_main_line(F.col("rev"), F.col("vendor"))).drop("vendor")
    made = written(cluster.check_floor(cluster.changesets(revs, window), floor), "cvs-changesets")
    place = W.orderBy("changeset")  # one repository's changesets have one order
    made = written(made.withColumn("n", F.row_number().over(place)).withColumn("node", F.encode(F.array_join(F.array_sort(F.transform("members", lambda m: F.concat(m["path"], F.lit("@"), S.dotted(m["rev"])))), "\n"), "UTF-8")), "cvs-nodes")
    parents = made.select("node", F.lit(0).alias("pos"), F.lag("node").over(W.orderBy("n")).alias("parent")).filter("parent is not null")
    member = made.select("node", "n", F.explode("members").alias("m")).select("node", "n", "m.path", "m.rev").join(revs, ["path", "rev"])
    ops = diff.running_ops(member.select(F.lit("main").alias("line"), "path", F.struct("n", "rev").alias("pos"), (F.col("state") != "dead").alias("live"), "node", "blob_id")).filter("op is not null")
    status = lambda c=None: derived("reconstructed-changeset", {"window_secs": str(window), "cluster_keys": "author,log", "date_rule": "latest", "confidence_rule": "span-overlap-v1", "floor": str(floor)}, c)
    rows = ops.select("node", "path", "op", F.when(F.col("op") != "Delete", F.col("blob_id")).alias("blob_id"), F.when(F.col("op") != "Delete", 0o100644).alias("mode"), stated().alias("status"))
    atoms = made.select("node", F.encode(F.lpad(F.col("n").cast("string"), 12, "0"), "UTF-8").alias("order"), _person(F.col("author"), None).alias("author"), _time(F.col("latest")).alias("author_time"), _text(F.col("log")).alias("message"), status(F.col("confidence")).alias("status"))
    placed = member.select("path", "rev", F.col("node").alias("atom"), F.col("date"))
    tags = t["symbols"].groupBy("name").agg(F.bool_or(S.names_branch(F.col("rev"))).alias("branch"))
    targets, _ = names.symbol_targets(t["symbols"].join(tags.filter("not branch"), "name", "left_semi"), placed)
    ref_rows = targets.select("name", F.lit("tag").alias("kind"), F.col("atom").alias("target"), derived("reconstructed-branch", {"source": "symbols"}).alias("status"))
    main = member.select(F.lit("").alias("line"), F.col("n").cast("long").alias("n"), "node", "path", "rev", (F.col("state") != "dead").alias("live"), "blob_id", "date")
    grown = cvsbranches.build(t["revisions"], t["symbols"], vendor, main, window)
    left = every.count() - revs.count() - grown["lines"].count()
    drops = [("branch-revisions", "revisions on lines that are not built", f"{left} revisions are not reconstructed", None)] if left else []
    if "atoms" in grown:
        new = grown["atoms"]
        made_by = F.when(F.col("kind") == "reconstructed-branch", derived("reconstructed-branch", {"source": "symbols"}, F.col("confidence"))).otherwise(status(F.col("confidence")))
        order = F.encode(F.concat(F.lit("branch "), F.lpad(F.col("wave").cast("string"), 6, "0"), "line", F.lit(" "), F.lpad(F.col("n").cast("string"), 12, "0")), "UTF-8")
        atoms = atoms.unionByName(new.select("node", order.alias("order"), _person(F.col("author"), None).alias("author"), _time(F.col("date")).alias("author_time"), _text(F.col("log")).alias("message"), made_by.alias("status")))
        parents = parents.unionByName(grown["parents"].select("node", F.lit(0).alias("pos"), "parent"))
        rows = rows.unionByName(grown["ops"].select("node", "path", "op", F.when(F.col("op") != "Delete", F.col("blob_id")).alias("blob_id"), F.when(F.col("op") != "Delete", 0o100644).alias("mode"), stated().alias("status")))
        ref_rows = ref_rows.unionByName(grown["refs"].select("name", F.lit("branch").alias("kind"), "target", derived("reconstructed-branch", {"source": "symbols"}).alias("status")))
    low = t["revisions"].filter("size(rev) = 2").groupBy("path").agg(F.min(F.struct("rev", "date", "author")).alias("f"))
    line = F.concat_ws("\t", "path", S.dotted(F.col("f.rev")), F.col("f.date").cast("string"))
    repo = low.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)).first()[0]  # a line per file
    return assemble(spark, "cvs", bytes.fromhex(repo), atoms, parents, rows, None, ref_rows, t["revisions"].select("blob_id", "content").filter("content is not null"), drops, params={"window_secs": str(window), "confidence_floor": str(floor)})


def from_svn(spark: SparkSession, path: str, trunk: str = "trunk", branches: str = "branches", tags: str = "tags") -> History:
    """Revisions of a dump stream as a line of atoms; roots of the conventional layout become derived references."""
    raw = svndump.raw(spark, path)
    outer = branching.externals(raw["nodes"]).limit(5).collect()
    if outer:
        raise svndump.Malformed(f"externals are not read: {[(r['revision'], r['path']) for r in outer]}")
    lived = written(svntree.lives(raw["nodes"]), "svn-lives")
    known = svntree.texts(raw["nodes"], lived)
    content = F.when(F.col("special"), F.encode(F.coalesce(S.symlink_target(F.col("text").cast("string")), F.col("text").cast("string")), "UTF-8")).otherwise(F.col("text"))
    known = known.withColumn("content", content).withColumn("state", F.struct(F.sha2("text", 256), "executable", "special"))
    known = written(known.select("event", "content", "state", F.unhex(F.sha2("content", 256)).alias("blob_id"), S.mode_of(F.col("executable"), F.col("special")).alias("mode")), "svn-texts")
    key = lambda c: F.encode(F.lpad(c.cast("string"), 12, "0"), "UTF-8")
    prop = lambda k: F.get(F.transform(F.filter("props", lambda x: x["k"] == k), lambda x: x["v"]), F.lit(0))
    revs = written(raw["revisions"].filter("number > 0").select("number", key(F.col("number")).alias("node"), prop("svn:author").alias("who"), prop("svn:date").alias("date"), prop("svn:log").alias("log")), "svn-revisions")
    parents = revs.select("node", F.lit(0).alias("pos"), F.lag("node").over(W.orderBy("number")).alias("parent")).filter("parent is not null")
    atoms = revs.select("node", F.col("node").alias("order"), _person(F.col("who"), None).alias("author"), _time(S.dump_date_seconds(F.col("date").cast("string"))).alias("author_time"), _text(F.col("log")).alias("message"), stated().alias("status"))
    changes = svntree.changes(lived, known).join(known.select("event", "blob_id", "mode"), "event", "left")
    changes = written(changes.withColumn("node", key(F.col("revision"))), "svn-ops")
    ops = changes.select("node", "path", "op", "blob_id", "mode", stated().alias("status"))
    copies = changes.filter("`from` is not null").select("node", "from", key(F.col("from_revision")).alias("from_node"), F.col("path").alias("to"), stated().alias("status"))
    touched = changes.select("node", "revision", S.layout_root(F.col("path"), trunk, branches, tags).alias("root"), "path", "op")
    live = touched.groupBy("path", "root").agg(F.max_by("op", "revision").alias("last")).filter("last <> 'Delete' and root is not null")
    tips = names.root_refs(touched.select("root", F.col("revision").alias("rev"), F.col("node").alias("atom")), live)
    ref_rows = tips.select(F.col("root").alias("name"), F.when(F.startswith("root", F.lit(f"{tags}/")), "tag").otherwise("branch").alias("kind"), F.col("atom").alias("target"), derived("reconstructed-branch", {"layout": f"{trunk},{branches},{tags}"}).alias("status"))
    outside = touched.filter("root is null").select("path").distinct().count()
    drops = [("layout", "paths outside the layout", f"{outside} paths belong to no root", None)] if outside else []
    lost = branching.property_losses(raw["nodes"]).agg(*[F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(c) for c in ("mergeinfo", "workflow", "custom")]).first()
    drops += [("properties", f"{c} properties", f"{lost[c]} revisions set some", None) for c in ("mergeinfo", "workflow", "custom") if lost[c]]
    return assemble(spark, "svn", b"", atoms, parents, ops, copies, ref_rows, known.join(changes.select("blob_id"), "blob_id", "left_semi").select("blob_id", "content"), drops, params={"layout": f"{trunk},{branches},{tags}"})


def from_hg(spark: SparkSession, store: str) -> History:
    """Served changesets of a Mercurial store: manifests are compared with the first parent's."""
    t = {k: written(v, f"hg-{k}") for k, v in revlog.read(spark, store).items()}
    log = t["changelog"]
    edges = log.select("node", F.posexplode(F.array("p1", "p2")).alias("pos", "prev")).filter("prev >= 0").join(log.select(F.col("rev").alias("prev"), F.col("node").alias("parent")), "prev").select("node", "pos", "parent")

    def marks(name: str, parse, schema: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for data in pdf["content"]:
                    yield pd.DataFrame(parse(bytes(data)), columns=[c.split(" ")[0] for c in schema.split(", ")])

        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store).filter(F.col("path").endswith(f"/{name}")).select("content")
        return written(files.mapInPandas(run, schema), f"hg-{name}")

    roots = marks("phaseroots", revlog.phase_roots, "phase int, node binary")
    gone = marks("obsstore", lambda d: [(n,) for n in revlog.obsolete(d)], "node binary").distinct()
    books = marks("bookmarks", revlog.bookmarks, "name string, node binary")
    lines = graph.Lines.of(edges)
    phases = graph.inherited_phase(lines, log.select("node"), roots)
    public = phases.filter("phase = 0").select("node")
    _, served = graph.published(lines, log.select("node"), gone.join(public, "node", "left_anti"), books.select("node").unionAll(public), phases)
    log = written(log.join(served, "node", "left_semi"), "hg-served")
    edges = edges.join(log.select("node"), "node", "left_semi")
    state = lambda rows, key: rows.join(t["manifest_entries"], F.col("m") == F.col("manifest")).select(F.col(key).alias("atom"), "path", "filenode", "mode")
    up = edges.filter("pos = 0").join(log.select(F.col("node").alias("parent"), F.col("manifest").alias("m")), "parent")
    ops = diff.snapshot_diff(state(up, "node"), state(log.select("node", F.col("manifest").alias("m")), "node"), ("filenode", "mode"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for node, text in zip(pdf["node"], pdf["text"], strict=True):
                meta, body = revlog.file_text(bytes(text))
                rows.append((bytes(node), meta.get("copy"), bytes.fromhex(meta.get("copyrev", "")), body))
            yield pd.DataFrame(rows, columns=["filenode", "copied", "copyrev", "content"])

    texts = written(t["file_revisions"].select("node", "text").mapInPandas(split, "filenode binary, copied string, copyrev binary, content binary").dropDuplicates(["filenode"]).withColumn("blob_id", F.unhex(F.sha2("content", 256))), "hg-texts")
    full = written(ops.join(texts.select(F.col("filenode").alias("new_filenode"), "blob_id", "copied", "copyrev"), "new_filenode", "left"), "hg-ops")
    rows = full.select(F.col("atom").alias("node"), "path", "op", F.when(F.col("op") != "Delete", F.col("blob_id")).alias("blob_id"), F.col("new_mode").alias("mode"), stated().alias("status"))
    # the source of a copy: the first parent if it holds the copied file revision, else the second, else the changeset
    # that brought it, else the first parent
    made = full.filter("copied is not null and op <> 'Delete'").select(F.struct("atom", "path").alias("copy"), F.col("atom").alias("node"), F.col("copied").alias("from"), "copyrev", F.col("path").alias("to"))
    ups = made.join(edges, "node").select("copy", "from", "copyrev", "pos", "parent")
    manifests = log.select(F.col("node").alias("parent"), "manifest").join(t["manifest_entries"].select("manifest", F.col("path").alias("from"), F.col("filenode").alias("copyrev")), "manifest").select("parent", "from", "copyrev")
    brought = t["file_revisions"].select(F.col("node").alias("copyrev"), F.col("link").alias("rev")).join(log.select("rev", "node"), "rev").groupBy("copyrev").agg(F.min_by("node", "rev").alias("parent"))
    tries = ups.join(manifests, ["parent", "from", "copyrev"], "left_semi").select("copy", F.col("pos").cast("int").alias("priority"), F.col("parent").alias("atom"))
    tries = tries.unionAll(made.join(brought, "copyrev").filter("parent <> node").select("copy", F.lit(2).alias("priority"), F.col("parent").alias("atom"))).unionAll(ups.filter("pos = 0").select("copy", F.lit(3).alias("priority"), F.col("parent").alias("atom")))
    copies = made.join(names.copy_source(tries), "copy").select("node", "from", F.col("atom").alias("from_node"), "to", stated().alias("status"))
    user = F.col("user").cast("string")
    atoms = log.select("node", F.col("node").alias("order"), _person(S.user_name(user), S.user_email(user)).alias("author"), _time(F.col("time"), S.west_seconds_to_minutes(F.col("tz"))).alias("author_time"), _text(F.col("description"), F.lit("UTF-8")).alias("message"), stated().alias("status"))
    closed = F.exists("extras", lambda x: x["k"] == "close")
    heads = names.branch_heads(log.select("node", "branch", "rev", (~closed).alias("open")), edges.select("node", "parent"))
    tips = names.branch_tips(heads).select(F.col("branch").alias("name"), F.lit("named-branch").alias("kind"), F.col("tip").alias("target"))
    marked = books.join(log.select("node"), "node", "left_semi").select("name", F.lit("bookmark").alias("kind"), F.col("node").alias("target"))
    repo = log.join(edges.select("node").distinct(), "node", "left_anti").agg(F.min("node")).first()[0]
    hidden = t["changelog"].count() - log.count()
    drops = [("unserved", "changesets that are not served", f"{hidden} changesets are secret or hidden", None)] if hidden else []
    return assemble(spark, "hg", bytes(repo or b""), atoms, edges, rows, copies, tips.unionAll(marked).withColumn("status", stated()), texts.select("blob_id", "content"), drops)


READERS = {"git": from_git, "cvs": from_cvs, "svn": from_svn, "hg": from_hg}


def decode(spark: SparkSession, kind: str, path: str, **options) -> History:
    """The history of a store, by the kind of its source."""
    if kind not in READERS:
        raise ValueError(f"unknown source {kind}; known: {sorted(READERS)}")
    return READERS[kind](spark, path, **options)


