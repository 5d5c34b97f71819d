"""Scalar functions of version-control history as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that a terminal would not show as they are.
#: Inclusive ranges: C0 controls, DEL and C1 controls, soft hyphen, zero-width and direction marks, bidirectional
#: embeddings, word joiner and isolates, byte-order mark, interlinear anchors.
INVISIBLE_CLASS = r"\p{Cc}\x{ad}\x{61c}\x{180e}\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{fff9}-\x{fffb}"


def sha256_id(content: Column) -> Column:
    """Content address: the SHA-256 of the bytes."""
    return F.unhex(F.sha2(content, 256))


def hex_id(value: Column) -> Column:
    return F.lower(F.hex(value))


def machine_value(text: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - . _ ~ / @ : + as they are."""
    out = F.url_encode(text)
    for sign, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%40", "@"), ("%3A", ":"), ("%2B", "+")):
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def machine_bytes(value: Column) -> Column:
    """The same for bytes that need not be UTF-8: two hexadecimal digits at a time."""
    pairs = F.regexp_extract_all(F.hex(value), F.lit("(..)"), F.lit(1))

    def one(p: Column) -> Column:
        n = F.conv(p, 16, 10).cast("int")
        safe = n.between(48, 57) | n.between(65, 90) | n.between(97, 122) | n.isin(45, 46, 95, 126, 47, 64, 58, 43)
        return F.when(safe, F.char(n)).otherwise(F.concat(F.lit("%"), p))

    return F.array_join(F.transform(pairs, one), "")


def human_text(text: Column, shown_class: str = INVISIBLE_CLASS) -> Column:
    """Backslashes doubled and invisible characters as \\u{XXXX}, so that no text can imitate an escape."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))

    def one(c: Column) -> Column:
        code = F.lower(F.hex(F.encode(c, "UTF-16BE")))  # every such sign lies in the basic plane: four digits
        return F.when(c.rlike(f"[{shown_class}]"), F.concat(F.lit("\\u{"), code, F.lit("}"))).otherwise(c)

    # most texts have no such sign; the others are cut before and after each run of them, not into single characters
    runs = F.regexp_extract_all(doubled, F.lit(f"([{shown_class}]|[^{shown_class}]+)"), F.lit(1))
    return F.when(~doubled.rlike(f"[{shown_class}]"), doubled).otherwise(F.array_join(F.transform(runs, one), ""))


def strict_seconds(raw: Column) -> Column:
    """Epoch seconds written as an optional minus and digits that fit 64 bits; else null."""
    return F.when(raw.rlike(r"^-?[0-9]+\z"), raw.try_cast("bigint"))


def strict_offset_minutes(raw: Column) -> Column:
    """Minutes of an offset written as a sign and four digits with minutes below 60; else null."""
    fine = raw.rlike(r"^[+-][0-9]{4}\z")
    hours, minutes = F.substring(raw, 2, 2).try_cast("int"), F.substring(raw, 4, 2).try_cast("int")
    total = (hours * 60 + minutes) * F.when(F.startswith(raw, F.lit("-")), -1).otherwise(1)
    return F.when(fine & (minutes < 60), total)


def west_seconds_to_minutes(tz: Column) -> Column:
    """Seconds west of Greenwich as minutes east; null unless whole minutes."""
    return F.when(tz % 60 == 0, (-(tz / 60)).cast("bigint").try_cast("smallint"))


def _div(a: Column, b: int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y, m, d = (x.cast("bigint") for x in (y, m, d))
    year = F.when(m <= 2, y - 1).otherwise(y)
    era = _div(F.when(year >= 0, year).otherwise(year - 399), 400)
    of_era = year - era * 400
    of_year = _div((F.when(m > 2, m - 3).otherwise(m + 9)) * 153 + 2, 5) + d - 1
    return era * 146097 + of_era * 365 + _div(of_era, 4) - _div(of_era, 100) + of_year - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).when(m.between(1, 12), 31)


def dump_date_seconds(text: Column) -> Column:
    """Epoch seconds of YYYY-MM-DDThh:mm:ss[.fraction]Z; month 1-12 and day 1-31 are checked and nothing else."""
    pattern = r"^([0-9]+)-([0-9]+)-([0-9]+)T([0-9]+):([0-9]+):([0-9]+)(?:\.[^Z]*)?Z\z"
    y, mo, d, h, mi, s = (F.regexp_extract(text, pattern, i).try_cast("bigint") for i in range(1, 7))
    return F.when(text.rlike(pattern) & mo.between(1, 12) & d.between(1, 31), days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + s)


def rcs_date_seconds(text: Column) -> Column:
    """Epoch seconds of YY.MM.DD.hh.mm.ss or YYYY....; two digits mean 19YY; every part is range-checked."""
    pattern = r"^([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)\z"
    y, mo, d, h, mi, s = (F.regexp_extract(text, pattern, i).try_cast("bigint") for i in range(1, 7))
    year = F.when(y < 100, y + 1900).otherwise(y)
    fine = year.between(1970, 9999) & mo.between(1, 12) & (d >= 1) & (d <= days_in_month(year, mo)) & (h <= 23) & (mi <= 59) & (s <= 60)
    return F.when(text.rlike(pattern) & fine, days_from_civil(year, mo, d) * 86400 + h * 3600 + mi * 60 + s)


def user_name(user: Column) -> Column:
    """Name of `Name <email>`: what stands before the last `<` that a `>` follows; the whole where there is none."""
    return F.when(user.rlike(r"(?s)<[^<]*>"), F.trim(F.regexp_extract(user, r"(?s)^(.*)<[^<>]*>[^<]*$", 1))).otherwise(F.trim(user))


def user_email(user: Column) -> Column:
    return F.when(user.rlike(r"(?s)<[^<]*>"), F.regexp_extract(user, r"(?s)<([^<>]*)>[^<]*$", 1))


def subject_line(message: Column) -> Column:
    """First line of a message given as bytes; empty where it is null or not UTF-8."""
    text = F.when(F.is_valid_utf8(message.cast("string")), message.cast("string"))
    return F.coalesce(F.regexp_extract(text, r"^([^\r\n]*)", 1), F.lit(""))


# --- revision numbers: arrays of integers --------------------------------------------------------------------------


def dotted(rev: Column) -> Column:
    return F.array_join(F.transform(rev, lambda x: x.cast("string")), ".")


def parse_dotted(text: Column) -> Column:
    """Components as unsigned 32-bit numbers; null if any is not one."""
    parts = F.transform(F.split(text, r"\."), lambda x: F.when(x.rlike(r"^[0-9]+\z"), x.try_cast("bigint")))
    return F.when(F.forall(parts, lambda x: x.isNotNull() & (x <= 4294967295)), parts)


def has_reachable_shape(rev: Column) -> Column:
    n = F.size(rev)
    return (n == 2) | ((n >= 4) & (n % 2 == 0))


def is_direct_revision_of(rev: Column, branch: Column) -> Column:
    return (F.size(rev) == F.size(branch) + 1) & (F.slice(rev, F.lit(1), F.size(branch)) == branch)


def is_main_line(rev: Column, vendor: Column) -> Column:
    return (F.size(rev) == 2) | F.coalesce(is_direct_revision_of(rev, vendor), F.lit(False))


def branch_of(rev: Column) -> Column:
    return F.slice(rev, F.lit(1), F.size(rev) - 1)


def magic_branch_number(branch: Column) -> Column:
    """1.2.2 becomes 1.2.0.2; null unless the number has an odd length of 3 or more."""
    n = F.size(branch)
    return F.when((n >= 3) & (n % 2 == 1), F.concat(F.slice(branch, F.lit(1), n - 1), F.array(F.lit(0).cast("bigint")), F.slice(branch, n, F.lit(1))))


def magic_branch(rev: Column) -> Column:
    """(branch, point) of a magic number such as 1.2.0.2; null otherwise."""
    n = F.size(rev)
    last = F.slice(rev, F.greatest(n, F.lit(1)), F.lit(1))
    point = F.slice(rev, F.lit(1), F.greatest(n - 2, F.lit(0)))
    return F.when((n >= 4) & (n % 2 == 0) & (F.get(rev, n - 2) == 0), F.struct(F.concat(point, last).alias("branch"), point.alias("point")))


def names_branch(rev: Column) -> Column:
    n = F.size(rev)
    return magic_branch(rev).isNotNull() | ((n >= 3) & (n % 2 == 1))


# --- paths, properties, grammars -------------------------------------------------------------------------------------


def layout_root(path: Column, trunk: str = "trunk", branches: str = "branches", tags: str = "tags") -> Column:
    """Root of a path in the conventional layout: the trunk, or a branch's or tag's own folder; null outside."""
    def below(top: str) -> Column:
        name = F.split_part(F.substring(path, len(top) + 2, 1 << 30), F.lit("/"), F.lit(1))
        return F.when(F.startswith(path, F.lit(f"{top}/")) & (name != ""), F.concat(F.lit(f"{top}/"), name))

    return F.when((path == trunk) | F.startswith(path, F.lit(f"{trunk}/")), F.lit(trunk)).otherwise(F.coalesce(below(branches), below(tags)))


def mode_of(executable: Column, special: Column) -> Column:
    return F.when(special, 0o120000).when(executable, 0o100755).otherwise(0o100644)


def symlink_target(content: Column) -> Column:
    return F.when(F.startswith(content, F.lit("link ")), F.substring(content, 6, 1 << 30))


def is_transform_name(name: Column) -> Column:
    return name.rlike(r"^[a-z0-9][a-z0-9-]{0,63}\z")


def is_transform_drop(what: Column) -> Column:
    return what.rlike(r"^(atom [0-9a-f]{64}\z|(op|copy) [0-9a-f]{64} .|ref (branch|tag|bookmark|named-branch|other:[^ ]*) .)")


def accepts_version(major: Column, minor: Column, readable: tuple[int, ...] = (2, 3)) -> Column:
    return (major == 0) & minor.isin(*readable)


def quoted_path(path: Column) -> Column:
    """A path for an import stream: quoted with C escapes where it starts with a quote or holds a line feed."""
    escaped = F.concat(F.lit('"'), F.replace(F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(F.startswith(path, F.lit('"')) | F.contains(path, F.lit("\n")) | (path == ""), escaped).otherwise(path)


def clean_identity(value: Column) -> Column:
    """An identity part for an import stream: angle brackets, NUL and line feeds become spaces."""
    return F.trim(F.regexp_replace(value, r"[<>\x00\n]", " "))


def rendered_time(seconds: Column, offset_minutes: Column) -> Column:
    """Seconds and +HHMM; a missing offset is given as +0000."""
    m = F.coalesce(offset_minutes.cast("int"), F.lit(0))
    sign = F.when(m < 0, "-").otherwise("+")
    return F.concat(seconds.cast("string"), F.lit(" "), sign, F.lpad((F.abs(m) / 60).cast("int").cast("string"), 2, "0"), F.lpad((F.abs(m) % 60).cast("string"), 2, "0"))
