"""Scalar text functions as Column expressions. Each takes and gives Columns; names are given as strings too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def truncate_chars(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def count_of(c, part: str) -> Column:
    """How often a literal stands in a text, without overlap."""
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(part), F.lit("")))) / len(part)).cast("int")


def dominant_eol(c) -> Column:
    r"""``\r\n`` only where it is more frequent than a lone ``\n``; else ``\n``."""
    crlf, lf = count_of(c, "\r\n"), count_of(c, "\n")
    return F.when(crlf > lf - crlf, F.lit("\r\n")).otherwise(F.lit("\n"))


def has_trailing_newline(c) -> Column:
    return F.endswith(col(c), F.lit("\n"))


def reencode_eol(c, eol) -> Column:
    """All line ends as ``eol``."""
    return F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\n"), col(eol))


def lines(c) -> Column:
    r"""The lines of a text: cut at ``\n`` or ``\r\n``; a final line end opens no further line, an empty text has none."""
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(col(c), "\r?\n\\z", ""), "\r?\n", -1))


def join_lines(parts, original) -> Column:
    """Lines in the original's style: its dominant line end, and a final one where it has one."""
    eol = dominant_eol(original)
    return F.when(has_trailing_newline(original), F.concat(_joined(parts, eol), eol)).otherwise(_joined(parts, eol))


def _joined(parts, eol) -> Column:
    return F.when(eol == "\r\n", F.array_join(parts, "\r\n")).otherwise(F.array_join(parts, "\n"))


def rel_path(path, root) -> Column:
    """A path below its root; itself where it does not lie there."""
    prefix = F.concat(F.rtrim(col(root), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(col(path), prefix), F.substring(col(path), F.length(prefix) + 1, F.length(col(path)))).otherwise(col(path))


def path_depth(path) -> Column:
    """How many directories a relative path goes down, itself included."""
    return F.size(F.split(col(path), "/"))


def file_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def ext(path) -> Column:
    """What follows the last dot of a file name; null where there is none or where the name starts with its only dot."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"\.([^.]*)$", 1))


def pct(c, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c) * 100)


def decision_label(blocked, decision) -> Column:
    return F.when(col(blocked), F.lit("BLOCKED")).when(col(decision) == "redact", F.lit("REDACTED")).otherwise(F.lit("ALLOWED"))


def strip_tag(c) -> Column:
    return F.regexp_replace(col(c), "^(?:cli-v|v)", "")


def parse_version(c) -> Column:
    """array<bigint> of a version's parts; null where a part is no number of 32 bits without a sign (a plus is allowed)."""
    parts = F.transform(F.split(strip_tag(c), r"\."), lambda p: F.when(p.rlike(r"^[+]?[0-9]+\z"), p.try_cast("bigint")))
    return F.when(F.forall(parts, lambda p: F.coalesce(p <= 4294967295, F.lit(False))), parts)


def is_newer(current, latest) -> Column:
    """Whether the latest version is newer, by its first three parts; missing parts are 0, unreadable versions never newer."""
    key = lambda v: F.struct(*[F.coalesce(F.get(v, F.lit(i)), F.lit(0).cast("bigint")).alias(f"p{i}") for i in range(3)])
    a, b = parse_version(current), parse_version(latest)
    return F.coalesce(a.isNotNull() & b.isNotNull() & (key(b) > key(a)), F.lit(False))


def unquote(c) -> Column:
    """Without one pair of equal quotes around it."""
    t = col(c)
    quoted = (F.length(t) >= 2) & (F.left(t, F.lit(1)) == F.right(t, F.lit(1))) & F.left(t, F.lit(1)).isin('"', "'")
    return F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def json_or_none(v) -> Column:
    """The JSON text of a variant; ``(none)`` where it is absent."""
    return F.coalesce(F.to_json(col(v)), F.lit("(none)"))


def mask_key(c) -> Column:
    """Its class prefix, an ellipsis and the last four characters; only stars where it is too short for that."""
    t = col(c)
    prefix = F.when(F.startswith(t, F.lit("pg_live_")), F.lit("pg_live_")).when(F.startswith(t, F.lit("pg_")), F.lit("pg_")).otherwise(F.lit(""))
    return F.when(F.length(t) <= F.length(prefix) + 4, F.repeat(F.lit("*"), F.length(t))).otherwise(F.concat(prefix, F.lit("…"), F.right(t, F.lit(4))))


def entropy(c, alphabet: str) -> Column:
    """Shannon entropy in bits a character over the characters of an alphabet, others left out of the sum; 0 for the empty text.

    One count a character of the alphabet, so that memory does not grow with the text.
    """
    t = col(c)
    n = F.length(t).cast("double")

    def more(acc, sign):
        share = (n - F.length(F.replace(t, sign, F.lit("")))) / n
        return acc - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.when(n == 0, 0.0).when(n > 0, F.aggregate(F.array(*map(F.lit, alphabet)), F.lit(0.0), more))


def url_scheme(c) -> Column:
    return F.lower(F.try_parse_url(col(c), F.lit("PROTOCOL")))


def url_host(c) -> Column:
    return F.lower(F.try_parse_url(col(c), F.lit("HOST")))
