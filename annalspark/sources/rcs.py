"""CVS repositories: `,v` files through Spark's binary reader, one file per row and task.

Tables: revisions (path, rev, date, author, log, state, content), symbols (path, name, rev) and files (path, head,
expand, vendor_branch).  A file's revisions are rebuilt in one walk over its delta tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rcs_date_seconds

MAX_FILE = 512 << 20
ROWS = "kind string, path string, rev array<bigint>, date_text string, author binary, log binary, state string, content binary, name string, text string"


class Malformed(ValueError):
    """A file that is not what its format says."""


def _tokens(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, value): `;`, `:`, words, and @-quoted strings with doubled signs undone."""
    at, n = 0, len(data)
    while at < n:
        c = data[at : at + 1]
        if c.isspace():
            at += 1
        elif c in (b";", b":"):
            yield c.decode(), c
            at += 1
        elif c == b"@":
            out, at = [], at + 1
            while True:
                end = data.find(b"@", at)
                if end < 0:
                    raise Malformed("a string does not end")
                out.append(data[at:end])
                at = end + 1
                if data[at : at + 1] != b"@":
                    break
                out.append(b"@")
                at += 1
            yield "text", b"".join(out)
        else:
            end = at
            while end < n and data[end : end + 1] not in (b";", b":", b"@") and not data[end : end + 1].isspace():
                end += 1
            yield "word", data[at:end]
            at = end


def revision(word: bytes) -> tuple[int, ...]:
    parts = word.split(b".")
    if not all(p.isdigit() and int(p) <= 0xFFFFFFFF for p in parts):
        raise Malformed(f"not a revision number: {word[:40]!r}")
    return tuple(int(p) for p in parts)


def parse(data: bytes) -> dict:
    """head, branch, expand, symbols, deltas (date, author, state, branches, next by revision) and texts (log, text)."""
    if len(data) > MAX_FILE:
        raise Malformed("the file is larger than the ceiling")
    tokens = list(_tokens(data))
    out: dict = {"head": None, "branch": None, "expand": None, "symbols": [], "deltas": {}, "texts": {}}
    at = 0

    def is_number(i: int) -> bool:
        return i < len(tokens) and tokens[i][0] == "word" and tokens[i][1][:1].isdigit() and set(tokens[i][1]) <= set(b"0123456789.")

    def phrase() -> tuple[bytes, list[tuple[str, bytes]]]:
        nonlocal at
        key, at = tokens[at][1], at + 1
        values = []
        while at < len(tokens) and tokens[at][0] != ";":
            values.append(tokens[at])
            at += 1
        if at >= len(tokens):
            raise Malformed("a phrase does not end")
        at += 1
        return key, values

    def first(values: list[tuple[str, bytes]]) -> bytes | None:
        return values[0][1] if values else None

    while at < len(tokens) and not is_number(at) and tokens[at][1] != b"desc":
        key, values = phrase()
        if key in (b"head", b"branch") and values:
            out[key.decode()] = revision(values[0][1])
        elif key == b"expand":
            out["expand"] = (first(values) or b"").decode("latin1")
        elif key == b"symbols":
            words = [v for k, v in values if k != ":"]
            if len(words) % 2:
                raise Malformed("a symbol without a revision")
            out["symbols"] = [(words[i].decode("utf-8"), revision(words[i + 1])) for i in range(0, len(words), 2)]
    while is_number(at):
        rev, at = revision(tokens[at][1]), at + 1
        if rev in out["deltas"]:
            raise Malformed("a revision stands twice")
        delta = {"date": None, "author": b"", "state": "Exp", "branches": [], "next": None}
        while at < len(tokens) and not is_number(at) and tokens[at][1] != b"desc":
            key, values = phrase()
            if key == b"date":
                delta["date"] = (first(values) or b"").decode("latin1")
            elif key == b"author":
                delta["author"] = first(values) or b""
            elif key == b"state":
                delta["state"] = (first(values) or b"").decode("latin1")
            elif key == b"branches":
                delta["branches"] = [revision(v) for _, v in values]
            elif key == b"next" and values:
                delta["next"] = revision(values[0][1])
        out["deltas"][rev] = delta
    if at < len(tokens) and tokens[at][1] == b"desc":
        at += 2
    while is_number(at):
        rev = revision(tokens[at][1])
        fields, at = {}, at + 1
        while at + 1 < len(tokens) and tokens[at][0] == "word" and not is_number(at):
            if tokens[at + 1][0] != "text":
                raise Malformed("a text is missing")
            fields[tokens[at][1]] = tokens[at + 1][1]
            at += 2
        if rev not in out["deltas"]:
            raise Malformed("a text without its revision")
        out["texts"][rev] = (fields.get(b"log", b""), fields.get(b"text", b""))
    if at < len(tokens):
        raise Malformed("unknown words at the end")
    return out


def lines_of(text: bytes) -> list[bytes]:
    return text.splitlines(keepends=True) if b"\r" not in text and b"\x0b" not in text and b"\x0c" not in text else [x + b"\n" for x in text.split(b"\n")[:-1]] + ([text.split(b"\n")[-1]] if not text.endswith(b"\n") and text else [])


def edit(source: list[bytes], script: bytes) -> list[bytes]:
    """Applies `dL N` and `aL N` commands; they must ascend and stay inside the source."""
    commands, out, at, floor = lines_of(script), [], 0, 0
    i = 0
    while i < len(commands):
        word = commands[i].rstrip(b"\n")
        kind, _, rest = word[:1], None, word[1:].split(b" ")
        if kind not in (b"a", b"d") or len(rest) != 2 or not (rest[0].isdigit() and rest[1].isdigit()):
            raise Malformed(f"not an edit command: {word[:40]!r}")
        line, count = int(rest[0]), int(rest[1])
        i += 1
        if kind == b"d":
            if line < 1 or line - 1 < floor or line - 1 + count > len(source):
                raise Malformed("a deletion outside the source")
            out += source[at : line - 1]
            at = floor = line - 1 + count
        else:
            if line < floor or line > len(source) or i + count > len(commands):
                raise Malformed("an insertion outside the source")
            if line > at:
                out += source[at:line]
                at = line
            floor = max(floor, line)
            out += commands[i : i + count]
            i += count
    return out + source[at:]


def contents(file: dict) -> dict[tuple[int, ...], bytes]:
    """Every revision's content, each delta applied once: down the trunk from the head, then up the branches."""
    out: dict[tuple[int, ...], bytes] = {}
    head, deltas, texts = file["head"], file["deltas"], file["texts"]
    if head is None:
        return out
    if head not in texts or head not in deltas:
        raise Malformed("the head revision is missing")
    todo = [(head, lines_of(texts[head][1]))]
    while todo:
        rev, now = todo.pop()
        while True:
            if rev in out:
                raise Malformed("the delta tree has a cycle")
            out[rev] = b"".join(now)
            for b in deltas[rev]["branches"]:
                if b not in deltas or b not in texts:
                    raise Malformed("a branch revision is missing")
                todo.append((b, edit(now, texts[b][1])))
            nxt = deltas[rev]["next"]
            if nxt is None:
                break
            if nxt not in deltas or nxt not in texts:
                raise Malformed("a revision of the chain is missing")
            now, rev = edit(now, texts[nxt][1]), nxt
    return out


def repository_path(path: str, root: str) -> str | None:
    """Path in the repository: root and `,v` cut, Attic folders left out; null for administrative files."""
    rel = path[len(root) :].strip("/")
    parts = rel.removesuffix(",v").split("/")
    if parts[0] == "CVSROOT":
        return None
    if len(parts) > 1 and parts[-2] == "Attic":
        del parts[-2]
    return "/".join(parts)


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """files, revisions and symbols of a repository folder; a path both live and in the Attic is refused."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()

    def parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                path = repository_path(name.replace("file:///", "file:/"), top.replace("file:///", "file:/"))
                if path is None:
                    continue
                file = parse(bytes(data))
                made = contents(file)
                rows.append(("file", path, None, None, None, None, None, None, ".".join(map(str, file["branch"])) if file["branch"] else None, file["expand"]))
                for rev, d in file["deltas"].items():
                    rows.append(("rev", path, list(rev), d["date"], d["author"], file["texts"].get(rev, (b"", b""))[0], d["state"], made.get(rev), None, None))
                rows += [("symbol", path, list(rev), None, None, None, None, None, s, None) for s, rev in file["symbols"]]
            yield pd.DataFrame(rows, columns=["kind", "path", "rev", "date_text", "author", "log", "state", "content", "name", "text"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*,v").load(root).select("path", "content").mapInPandas(parse_files, ROWS)
    files = raw.filter("kind = 'file'").select("path", F.col("name").alias("vendor_branch"), F.col("text").alias("expand"))
    twice = files.groupBy("path").count().filter("count > 1").limit(1).collect()
    if twice:
        raise Malformed(f"{twice[0]['path']} is both live and in the Attic")
    revisions = raw.filter("kind = 'rev'").select("path", "rev", rcs_date_seconds(F.col("date_text")).alias("date"), "author", "log", "state", "content")
    return {"files": files, "revisions": revisions.withColumn("blob_id", F.unhex(F.sha2("content", 256))), "symbols": raw.filter("kind = 'symbol'").select("path", "name", "rev")}
