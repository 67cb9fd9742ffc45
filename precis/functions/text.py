"""String functions (H1-H15) as composed native Spark expressions.

Regexes are written as raw Python strings and passed with ``F.lit`` so no
SQL-level escaping is involved.  Java's ``\\s`` and ``\\w`` are ASCII-only
while the reference cleans text with Python's Unicode classes, so the
classes below spell the Unicode whitespace set out explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "WS_CLASS", "clean_text", "strip_urls", "strip_special", "normalize_whitespace",
    "expand_contractions", "whitespace_tokens", "join_tokens", "add_prefix",
    "preview_text", "sentences", "sentence_lines", "wrap_text", "decode_utf8",
    "ascii_fallback", "language_label", "format_score", "as_text", "first_line",
    "trim_ws", "CONTRACTIONS",
]

# The members of Python's str whitespace class beyond Java's \s
# (inside a character class, without brackets).
WS_CLASS = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_URL = r"http[^" + WS_CLASS + r"]+"
_SPECIAL = r"[^\p{L}\p{N}_" + WS_CLASS + r".,!?']"
_WS_RUN = r"[" + WS_CLASS + r"]+"
# same matches as _WS_RUN for the purpose of "runs -> one space", but a lone
# ' ' (the common case) is not rewritten
_WS_REPLACE = r"[" + WS_CLASS + r"]{2,}|[" + WS_CLASS + r"&&[^ ]]"
_SENT_END = r"([.!?])[" + WS_CLASS + r"]+"
_SENT_MARK = "\u0001"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_text(x) -> Column:
    """Non-string / null -> ''."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def strip_urls(x) -> Column:
    """H2: remove ``http`` followed by at least one non-space character."""
    return F.regexp_replace(_c(x), F.lit(_URL), F.lit(""))


def strip_special(x) -> Column:
    """H3: keep letters, digits, underscore, whitespace and . , ! ? '"""
    return F.regexp_replace(_c(x), F.lit(_SPECIAL), F.lit(""))


def trim_ws(x) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip``)."""
    lead = F.regexp_replace(_c(x), F.lit(r"^[" + WS_CLASS + r"]+"), F.lit(""))
    return F.regexp_replace(lead, F.lit(r"[" + WS_CLASS + r"]+$"), F.lit(""))


# The individual characters of WS_CLASS (Python's str whitespace).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def normalize_whitespace(x) -> Column:
    """H4: whitespace runs -> one space, then strip.  Every whitespace
    character is first mapped to ' ' (a per-character table, no regex
    class), then runs of spaces are collapsed."""
    spaced = F.translate(_c(x), WS_CHARS, " " * len(WS_CHARS))
    return F.trim(F.regexp_replace(spaced, F.lit(" {2,}"), F.lit(" ")))


def clean_text(x) -> Column:
    """H1: null -> '', then URLs, then special characters, then whitespace."""
    return normalize_whitespace(strip_special(strip_urls(as_text(x))))


# Contraction rewrites, applied in this order (case-insensitive).
CONTRACTIONS = [
    (r"(?i)\bwon't\b", "will not"),
    (r"(?i)\bcan't\b", "cannot"),
    (r"(?i)n't\b", " not"),
    (r"(?i)'re\b", " are"),
    (r"(?i)'ll\b", " will"),
    (r"(?i)'ve\b", " have"),
    (r"(?i)'m\b", " am"),
    (r"(?i)'d\b", " would"),
]


def expand_contractions(x) -> Column:
    """H5: optional contraction expansion (a chain of native replaces)."""
    out = _c(x)
    for pat, rep in CONTRACTIONS:
        out = F.regexp_replace(out, F.lit(pat), F.lit(rep))
    return out


def whitespace_tokens(x) -> Column:
    """H6: ``str.split()`` — split on Unicode whitespace runs, no empty tokens."""
    return F.filter(F.split(as_text(x), _WS_RUN), lambda t: t != F.lit(""))


def join_tokens(a, sep: str = " ") -> Column:
    """H7: ``" ".join(tokens)``."""
    return F.array_join(_c(a), sep)


def add_prefix(x, prefix: str = "summarize: ") -> Column:
    """H8."""
    return F.concat(F.lit(prefix), as_text(x))


def preview_text(x, n: int = 200) -> Column:
    """H9: first n characters followed by '...' (always appended)."""
    return F.concat(F.substring(as_text(x), 1, n), F.lit("..."))


def sentences(x, cleaned: bool = False) -> Column:
    """Rule-based sentence split after . ! ? followed by whitespace;
    each piece stripped, empty pieces dropped.  ``cleaned=True`` declares
    that the only whitespace left is single spaces (output of clean_text),
    so the plain space trim gives the same result."""
    marked = F.regexp_replace(as_text(x), F.lit(_SENT_END), F.lit("$1" + _SENT_MARK))
    parts = F.split(marked, _SENT_MARK)
    strip = F.trim if cleaned else trim_ws
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != F.lit(""))


def sentence_lines(x) -> Column:
    """Sentences joined by newline (the ROUGE-Lsum input form)."""
    return F.array_join(sentences(x), "\n")


def wrap_text(x, width: int = 70) -> Column:
    """Greedy wrap at ``width`` characters on whitespace; a longer word
    is broken, and its first part fills the line it starts on."""
    def add(acc, word):
        lines, line = acc["lines"], acc["line"]
        room = F.when(line == "", F.lit(width)).otherwise(F.lit(width - 1) - F.length(line))
        glue = F.when(line == "", F.lit("")).otherwise(F.lit(" "))
        head = F.when(room > 0, F.concat(line, glue, F.substring(word, F.lit(1), room))).otherwise(line)
        rest = F.when(room > 0, F.substring(word, room + 1, F.length(word))).otherwise(word)
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(rest) - 1) / width).cast("int")),
                            lambda i: F.substring(rest, i * width + 1, F.lit(width)))
        broken = F.concat(lines, F.array(head), F.slice(parts, F.lit(1), F.size(parts) - 1))
        fits, long = F.length(word) <= room, F.length(word) > width
        return F.struct(
            F.when(fits, lines).when(long, broken).otherwise(F.concat(lines, F.array(line))).alias("lines"),
            F.when(fits, F.concat(line, glue, word)).when(long, F.element_at(parts, -1)).otherwise(word).alias("line"))

    words = F.filter(F.split(normalize_whitespace(x), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    return F.aggregate(words, start, add, lambda acc: F.array_join(
        F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))), "\n"))


def decode_utf8(x) -> Column:
    """Bytes -> string."""
    return F.decode(_c(x), "UTF-8")


def ascii_fallback(x) -> Column:
    """Drop every non-ASCII character."""
    return F.regexp_replace(_c(x), F.lit(r"[^\x00-\x7F]"), F.lit(""))


def language_label(x) -> Column:
    """H14."""
    return F.upper(_c(x))


def format_score(x, scale: float = 100.0, digits: int = 4) -> Column:
    """x100 rounded to 4 places, and a fixed-point text form."""
    v = F.round(_c(x) * F.lit(scale), digits)
    return F.struct(v.alias("value"), F.format_string(f"%.{digits}f", v).alias("text"))


def first_line(x) -> Column:
    """Text up to the first newline (pseudo-reference of the test tables)."""
    return F.substring_index(as_text(x), "\n", 1)
