"""Scalar text expressions shared by the jobs (native Column expressions only).

The patterns are written so the same text is valid in Java regex (Spark) and
RE2 (DuckDB, used by the oracle): code points are spelled ``\\x{..}`` and no
look-around is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ── Fixed values (must equal the reference's behaviour) ───────────────
# Python str.split()/strip() whitespace: tab, LF, VT, FF, CR, U+001C..U+001F, space, U+0085,
# U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NON_WS_CLASS = "[^" + WS_CLASS[1:]
# Python str.splitlines() boundaries: CRLF, LF, CR, VT, FF, U+001C..U+001E, U+0085, U+2028, U+2029.
LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
# Wikilink: [[target]] or [[target|label]], may span lines.
WIKILINK = r"\[\[([^\]]+)\]\]"
# Generic frontmatter block at offset 0.
FRONTMATTER = r"(?s)\A---\n(.*?)\n---"
FRONTMATTER_WITH_GAP = r"(?s)\A---\n.*?\n---\n*"
# Frontmatter key line (column 0).
FM_KEY_LINE = r"^([A-Za-z_][\w\-]*)\s*:\s*(.*)$"
# projects field inside the first ---…--- span.
PROJECTS_FIELD = r"(?m)^projects:\s*\[([^\]]*)\]"
# Secret key=value pattern; groups: key word, separator, optional auth scheme, value.
SECRET = (
    r"(?i)(api[_-]?key|token|secret|password|authorization|credentials?|auth)"
    r"([\"'\s:=]+)([A-Za-z]+\s+)?([A-Za-z0-9_\-/.+=]{8,})"
)
REDACTED = "[REDACTED]"
# Daily-log header and project tag after an em dash.
DAILY_HEADER = r"^###\s+(.+?)\s*$"
TAG_SUFFIX = r"—\s*([A-Za-z0-9_\-.]+)\s*(?:\(|$)"
TAG_AT_END = r"—\s*([A-Za-z0-9_\-.]+)\s*$"
TAG_BEFORE_PAREN = r"—\s*([A-Za-z0-9_\-.]+)\s*\("
# slugify classes: keep letters, digits, _, whitespace and -; whitespace/_ runs become -.
SLUG_DROP = r"[^\p{L}\p{N}_" + WS_CLASS[1:-1] + r"\-]"
SLUG_DASH = r"(?:" + WS_CLASS + r"|_)+"
# Credentials inside a remote URL.
URL_CREDENTIALS = r"://[^@/]+@"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


PY_WS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace at both ends."""
    return F.btrim(col_(c), F.lit(PY_WS))


def py_lstrip(c) -> Column:
    return F.ltrim(col_(c), F.lit(PY_WS))


def py_rstrip(c) -> Column:
    return F.rtrim(col_(c), F.lit(PY_WS))


# Whitespace Python has beyond Java's ASCII \s, mapped to a space before counting.
PY_EXTRA_WS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def word_count(c) -> Column:
    """``len(text.split())``: the extra Unicode whitespace is mapped to spaces with
    a per-character ``translate``, in texts that hold any, then ``\\S+`` runs are counted (ASCII \\s is
    exactly the rest of Python's set)."""
    some = reduce(Column.__or__, [F.contains(col_(c), F.lit(w)) for w in PY_EXTRA_WS])
    x = F.when(some, F.translate(col_(c), PY_EXTRA_WS, " " * len(PY_EXTRA_WS))).otherwise(col_(c))
    return F.regexp_count(x, F.lit(r"\S+")).cast("bigint")


def py_lines(c) -> Column:
    """``str.splitlines()``: split on every Python line boundary, drop the one
    trailing empty string Spark keeps after a final break."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(col_(c) == "", F.array().cast("array<string>")).otherwise(let(F.split(col_(c), LINE_BREAK, -1), whole))


def strip_quotes(c) -> Column:
    """``x.strip("'\\"")``."""
    return F.btrim(col_(c), F.lit("'\""))


def sha_hex(c, n: int) -> Column:
    return F.substring(F.sha2(col_(c), 256), 1, n)


def slugify(c) -> Column:
    """lower + strip; drop what is not a letter, digit, ``_``, space or ``-``;
    runs of spaces/underscores → ``-``; ``-+`` → ``-``; strip ``-``. Letters and
    digits are the Unicode classes, as Python's ``\\w`` has them (combining marks
    excluded), so Cyrillic survives."""
    x = py_strip(F.lower(col_(c)))
    x = F.regexp_replace(x, SLUG_DROP, "")
    x = F.regexp_replace(x, SLUG_DASH, "-")
    x = F.regexp_replace(x, r"-+", "-")
    return F.regexp_replace(x, r"^-+|-+$", "")


def capitalize_first(c) -> Column:
    """``s[0].upper() + s[1:]`` (not initcap: the rest is kept as is)."""
    x = col_(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def basename(c) -> Column:
    return F.element_at(F.split(col_(c), "/"), -1)


def title_from_id(c) -> Column:
    """``id.replace('-', ' ').title()`` (initcap; differs only after digits)."""
    return F.initcap(F.replace(col_(c), F.lit("-"), F.lit(" ")))


def redact(c) -> Column:
    """Keep key word, separator and auth scheme; replace the value with [REDACTED]."""
    return F.regexp_replace(col_(c), SECRET, "$1$2$3" + REDACTED)


def strip_credentials(c) -> Column:
    return F.regexp_replace(col_(c), URL_CREDENTIALS, "://")


def normalize_newlines(c) -> Column:
    """Text-mode read: CRLF and lone CR become LF."""
    return F.regexp_replace(col_(c), r"\r\n?", "\n")
