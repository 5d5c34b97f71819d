"""The trees of a Subversion stream as lives of paths: from one record to another, without folding the stream.

A record's place is revision << 24 | its number in the revision.  A file lives from the record that sets it until the
next record of its path or the removal of a folder above it.  A copied folder starts a life for every file that lives
below its source at the end of the source's revision; copies of copies follow in waves, as many as copies nest.  A
record without a full text or without properties takes them from a base: what lived at its path, or at its source;
records that hang together through bases are worked off in order, one file's history at a time.

Lives, operations and texts are joins, windows and groups over records, so that revisions are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.asof import ancestors, asof_last
from ..operators.graph import _grown
from ..storage import Rounds, written
from .svndump import Malformed, svndiff

_BITS = 24


def _rev(at: Column) -> Column:
    return F.shiftright(at, _BITS)


def _opening(rev: Column) -> Column:
    """The first place of a revision."""
    return F.shiftleft(rev.cast("long"), _BITS)


def _next(asks: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """asks (key, at, ...) with next: the first mark (key, at) behind the place, if any; both are one sorted line a key."""
    line = W.partitionBy(key).orderBy("_at", "_ask").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = F.struct(*asks.columns)
    near = marks.select(key, (-F.col("at")).alias("_at"), F.lit(0).alias("_ask"), F.lit(None).cast(asks.select(held.alias("h")).schema["h"].dataType).alias("_held"))
    both = near.unionAll(asks.select(key, (-F.col("at") - 1).alias("_at"), F.lit(1).alias("_ask"), held))
    return both.withColumn("next", -F.max(F.when(F.col("_ask") == 0, F.col("_at"))).over(line)).filter("_ask = 1").select("_held.*", "next")


def _ended(sets: DataFrame, marks: DataFrame, kills: DataFrame) -> DataFrame:
    """sets (path, at, ...) with until: the next mark (path, at) of the path, or removal (path, at) of a folder above, if any."""
    own = _next(sets, marks, "path")
    folders = sets.select("path", "at", F.explode(ancestors("path")).alias("_folder")).filter("_folder <> path")
    above = written(kills.withColumnRenamed("path", "_folder").join(folders.select("_folder").distinct(), "_folder", "left_semi"), "removed-folders")
    if above.isEmpty():
        return own.withColumnRenamed("next", "until")
    asks = folders.join(above.select("_folder").distinct(), "_folder", "left_semi").distinct()
    lost = _next(asks, above, "_folder").groupBy("path", "at").agg(F.min("next").alias("lost"))
    return own.join(lost, ["path", "at"], "left").withColumn("until", F.least("next", "lost")).drop("next", "lost")


#: Bits of a revision number that the smallest stretch of revisions spans, and that each greater one spans more.
_STRETCH, _STEP = 9, 4


def _copied(lived: DataFrame, copies: DataFrame, last: int) -> DataFrame:
    """Each copy (to, copied_at, _folder, rev) with each life below its source at the end of its revision, as lives of files.

    A life is cut into stretches of revisions, the longest that fit: whole ones hold all copies that fall into them, and
    only the two at its ends are looked through.  A life meets a copy in one stretch, so that no pair is made in vain but
    at the ends, however long lives are and however many copies a folder has.  last: the greatest revision of the copies.
    """
    depth = max(1, -(-(last.bit_length() - _STRETCH) // _STEP))
    whole = F.array().cast("array<bigint>")
    run = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(whole)
    of = lambda level, blocks, end: F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block"), F.lit(end).alias("end")))
    below = lived.select("path", "event", _rev(F.col("at")).alias("since"), F.least(_rev(F.col("until")), F.lit(last + 1)).alias("till"), F.explode(ancestors("path")).alias("_folder"))
    below = below.filter("_folder <> path and since < till").join(copies.select("_folder").distinct(), "_folder", "left_semi")
    first, final = F.shiftright("since", _STRETCH), F.shiftright(F.col("till") - 1, _STRETCH)
    parts = [of(0, F.array_distinct(F.array(first, final)), True)]
    lo = lambda k: F.shiftright(first + (1 << _STEP * k), _STEP * k)  # noqa: E731  of the whole stretches behind the first one
    hi = lambda k: F.shiftright(final, _STEP * k)
    for k in range(depth):
        more = lo(k + 1) < hi(k + 1) if k + 1 < depth else F.lit(False)
        up, down = F.shiftleft(lo(k + 1), _STEP), F.shiftleft(hi(k + 1), _STEP)
        parts.append(of(k, F.when(more, F.concat(run(lo(k), up), run(down, hi(k)))).otherwise(run(lo(k), hi(k))), False))
    cut = below.withColumn("_s", F.explode(F.concat(*parts))).select("_folder", "_s.*", "path", "event", "since", "till")
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("rev", _STRETCH + _STEP * k).alias("block")) for k in range(depth)))).alias("_s")
    met = cut.join(copies.select("_folder", "to", "copied_at", "rev", levels).select("_folder", "_s.*", "to", "copied_at", "rev"), ["_folder", "level", "block"]).filter("not end or (since <= rev and rev < till)")
    to = F.concat("to", F.expr("substring(path, length(_folder) + 1)"))
    return met.select(to.alias("path"), F.col("copied_at").alias("at"), "event", F.lit(True).alias("fresh"), F.col("path").alias("source"), F.col("rev").alias("source_rev"))


def _open(copies: DataFrame, marks: DataFrame, kills: DataFrame) -> DataFrame:
    """copied_at, to of the copies whose files may end or be copied again: a mark at or below `to` or a removal above it
    comes later, or another copy has its source there, above or below."""
    held = copies.select("to", "copied_at", F.explode(ancestors("to")).alias("_folder"))
    later = F.col("last") > F.col("copied_at")
    last = lambda df, c: df.groupBy(c.alias("_folder")).agg(F.max("at").alias("last"))
    below = last(marks.select(F.explode(ancestors("path")).alias("path"), "at"), F.col("path"))
    marked = held.filter("_folder = to").join(below, "_folder").filter(later)
    lost = held.filter("_folder <> to").join(last(kills, F.col("path")), "_folder").filter(later)
    sources = copies.select(F.col("_folder").alias("path")).distinct()
    inside = held.join(sources.select(F.col("path").alias("_folder")), "_folder", "left_semi")
    around = held.filter("_folder = to").join(sources.select(F.explode(ancestors("path")).alias("_folder")).distinct(), "_folder", "left_semi")
    parts = [df.select("to", "copied_at") for df in (marked, lost, inside, around)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).distinct()


def lives(nodes: DataFrame) -> DataFrame:
    """path, at, until (null while it lives), event (the record with its text), fresh (added, replaced or copied), source, source_rev.

    nodes: revision, ord, path, kind, action, copyfrom_rev, copyfrom_path.  Files of copies that nothing touches later,
    tags above all, go straight into the result; the others are ended and looked through for copies of copies.
    """
    rounds = Rounds(nodes.sparkSession, "lives")
    at = (_opening(F.col("revision")) + F.col("ord")).alias("at")
    rows = written(nodes.select("path", at, "kind", "action", F.col("copyfrom_rev").cast("long").alias("source_rev"), F.col("copyfrom_path").alias("source")), "records")
    kills = rows.filter("action in ('delete', 'replace')").select("path", "at")
    sets = rows.filter("kind = 'file' and action <> 'delete'").select("path", "at", F.col("at").alias("event"), F.col("action").isin("add", "replace").alias("fresh"), "source", "source_rev")
    marks = rows.filter("action in ('delete', 'replace') or kind = 'file'").select("path", "at")
    copies = rows.filter("coalesce(kind, 'dir') <> 'file' and action <> 'delete' and source is not null").select(F.col("path").alias("to"), F.col("at").alias("copied_at"), F.col("source").alias("_folder"), F.col("source_rev").alias("rev"))
    copies = written(copies, "folder-copies")
    wave = rounds.write(_ended(sets, marks, kills))
    found, last = wave, copies.agg(F.max("rev")).first()[0]
    if last is None:
        return found
    open_ = written(_open(copies, marks, kills), "open-copies")
    shut = written(copies.join(open_, ["to", "copied_at"], "left_anti"), "shut-copies")
    copies = written(copies.join(open_, ["to", "copied_at"], "left_semi"), "open-copies")
    while True:
        found = found.unionByName(_copied(wave, shut, last).withColumn("until", F.lit(None).cast("long")))
        new = rounds.write(_copied(wave, copies, last))
        if new.isEmpty():
            return found
        wave = rounds.write(_ended(new, marks.join(new.select("path").distinct(), "path", "left_semi"), kills))
        found = found.unionByName(wave)


def bases(nodes: DataFrame, lived: DataFrame) -> DataFrame:
    """event, base: of files set without a full text or properties, the record whose text and properties they go on from."""
    at = _opening(F.col("revision")) + F.col("ord")
    open_ = nodes.filter("kind = 'file' and action <> 'delete' and (text is null or is_delta or size(props) = 0)")
    asks = open_.select(at.alias("event"), "path", "copyfrom_path", F.col("copyfrom_rev").cast("long").alias("rev"))
    states = lived.select("path", "at", "until", F.col("event").alias("of"))
    here = asof_last(asks.select("event", "path", (F.col("event") - 1).alias("at")), states, ["path"], "at", ["until", "of"])
    here = here.filter(F.col("until").isNull() | (F.col("until") >= _opening(_rev(F.col("event"))))).select("event", F.col("of").alias("here"))
    there = asks.filter("copyfrom_path is not null").select("event", F.col("copyfrom_path").alias("path"), (_opening(F.col("rev") + 1) - 1).alias("at"))
    there = asof_last(there, states, ["path"], "at", ["until", "of"]).filter(F.col("until").isNull() | (F.col("until") > F.col("at"))).select("event", F.col("of").alias("there"))
    both = asks.join(here, "event", "left").join(there, "event", "left")
    return both.select("event", F.coalesce("there", "here").alias("base"), F.col("copyfrom_path").alias("source")).filter("base is not null or source is not null")


_TEXT = "event long, text binary, executable boolean, special boolean"


def texts(nodes: DataFrame, lived: DataFrame) -> DataFrame:
    """event, text, executable, special of every file record, in full and checked against its digests."""
    at = (_opening(F.col("revision")) + F.col("ord")).alias("event")
    has = lambda k: F.exists("props", lambda x: x["k"] == k)
    files = nodes.filter("kind = 'file' and action <> 'delete'").select(at, "path", "text", F.coalesce("is_delta", F.lit(False)).alias("is_delta"), (F.size("props") > 0).alias("own"), has("svn:executable").alias("executable"), has("svn:special").alias("special"), "md5", "sha1")
    based = written(bases(nodes, lived), "bases")
    links = based.filter("base is not null").select(F.col("event").alias("node"), F.col("base").alias("up"))
    members = written(links.select("node").unionAll(links.select(F.col("up").alias("node"))).distinct(), "members")
    roots = _grown(members, written(links, "links"), False, members.count().bit_length() + 2).select(F.col("node").alias("event"), "root")
    uses = based.groupBy(F.col("base").alias("event")).count().select("event", F.col("count").alias("uses"))
    rows = files.join(based, "event", "left").join(roots, "event", "left").join(uses, "event", "left")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Records of one history after another, in order; a text is kept until its last use."""
        root, kept = None, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.root != root:
                    root, kept = r.root, {}
                has_base = r.base == r.base and r.base is not None
                old = None
                if has_base:
                    old = kept[int(r.base)]
                    old[3] -= 1
                    if not old[3]:
                        del kept[int(r.base)]
                elif r.source is not None and (r.text is None or r.is_delta):
                    raise Malformed(f"{r.path}: no text of {r.source}")
                text = r.text
                if r.is_delta:
                    text = svndiff(text, old[0] if old else b"")
                elif text is None:
                    text = old[0] if old else b""
                if r.text is not None:
                    for want, f in ((r.md5, hashlib.md5), (r.sha1, hashlib.sha1)):
                        if want is not None and f(text).hexdigest() != want:
                            raise Malformed(f"{r.path}: the text does not have its digest")
                flags = (r.executable, r.special) if r.own or not old else (old[1], old[2])
                if r.uses == r.uses and r.uses:
                    kept[int(r.event)] = [text, *flags, int(r.uses)]
                out.append((int(r.event), bytes(text), bool(flags[0]), bool(flags[1])))
            yield pd.DataFrame(out, columns=["event", "text", "executable", "special"])

    rows = rows.withColumn("root", F.coalesce("root", "event")).repartition("root").sortWithinPartitions("root", "event")
    return rows.mapInPandas(work, _TEXT)


def changes(lived: DataFrame, known: DataFrame) -> DataFrame:
    """revision, path, op, event, from, from_revision: how each revision leaves its paths against the one before.

    known: event and what tells two states of a file apart (`state`).
    """
    set_ = lived.select("path", _rev(F.col("at")).alias("revision"), F.lit(None).cast("long").alias("old"), F.when(F.col("until").isNull() | (_rev(F.col("until")) > _rev(F.col("at"))), F.struct("at", "event")).alias("new"), "fresh", F.when(F.col("source").isNotNull(), F.struct("at", "source", "source_rev")).alias("copied"))
    gone = lived.filter(_rev(F.col("until")) > _rev(F.col("at"))).select("path", _rev(F.col("until")).alias("revision"), F.col("event").alias("old"), F.lit(None).cast(set_.schema["new"].dataType).alias("new"), F.lit(False).alias("fresh"), F.lit(None).cast(set_.schema["copied"].dataType).alias("copied"))
    met = set_.unionAll(gone).groupBy("path", "revision").agg(F.max("old").alias("old"), F.max("new").alias("new"), F.bool_or("fresh").alias("fresh"), F.max("copied").alias("copied"))
    met = met.select("path", "revision", "old", F.col("new.event").alias("event"), "fresh", "copied").filter("old is not null or event is not null")
    state = known.select("event", "state")
    met = met.join(state.select(F.col("event").alias("old"), F.col("state").alias("was")), "old", "left").join(state, "event", "left")
    op = F.when(F.col("old").isNull(), "Add").when(F.col("event").isNull(), "Delete").when(F.col("fresh"), "Replace").when(F.col("was") != F.col("state"), "Modify")
    copied = lambda c: F.when(F.col("event").isNotNull(), F.col(f"copied.{c}"))
    return met.select("revision", "path", op.alias("op"), "event", copied("source").alias("from"), copied("source_rev").alias("from_revision")).filter("op is not null")
