"""Text functions from Column to Column; all run inside the JVM.

Null stays null unless a function says otherwise.  Character classes name letters and
digits by Unicode property, since ``\\w`` and ``\\b`` differ between regex engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)[\s\x1c-\x1f]"
#: The same; printable ASCII is told by one comparison.
_SPACE = r"[[^!-~]&&[\s\x1c-\x1f]]"
DIGITS = "0123456789"
#: The heading patterns.
ROMAN, NUMERIC, LETTER = r"^[IVXLCDM]+\.\s+.+", r"^\d+\.\s+.+", r"^[A-Za-z]\.\s+.+"
NAMED = r"^(principle|article|section|chapter|standard|rule)\s+(\d+[a-z]?)\s*[:.-]?\s*(.*)$"
#: A named prefix, and the forms of lines of a table of contents.
NAMED_PREFIX = r"(?iu)^(principle|article|section|chapter|standard|rule)\s+\d+[a-z]?\s*[:.-]?\s*"
TOC = r"^(.+?)\s*[.…·]{3,}\s*(\d{1,4})\s*$"
TOC_LINE = r"^.+?[.…·]{3,}\s*\d{1,4}\s*$"
#: Words after which a line goes on.
CONNECTORS = ("and", "or", "to", "of", "in", "for", "with", "on", "at", "by", "from", "under", "within")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once a row, as Spark does not share what a branch or a lambda repeats."""
    return F.transform(F.array(value), use)[0]


def begins(c: Column, chars: str) -> Column:
    """Whether a text begins with one of these characters: a cheap test before an anchored pattern, which Java tries at every place."""
    return F.left(c, F.lit(1)).isin(*chars)


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    # single spaces stand as they are: most texts then need no new string
    return F.trim(F.regexp_replace(c, rf"(?U){_SPACE}(?:{_SPACE}+|(?<! ))", " "))


def header_footer_norm(c: Column) -> Column:
    """Lower case, single spaces, and ``<num>`` for each whole number."""
    return F.regexp_replace(collapse(F.lower(c)), r"(?<![\p{L}\p{N}_])\d+(?![\p{L}\p{N}_])", "<num>")


def strip_toc(c: Column) -> Column:
    """A table-of-contents line without its dot leaders or trailing page number."""
    trailing = r"^(.+?)\s+(\d{1,4})\s*$"

    def stripped(t):
        title = F.regexp_extract(t, trailing, 1)
        head = title.rlike(r"(?iu)^([ivxlcdm]+\.\s+|(chapter|section|part|annex)(?![\p{L}\p{N}_]))")
        long = F.size(F.split(title, " ")) >= 4
        return F.when(~_ends_in_digit(t), t).when(t.rlike(TOC), F.trim(F.regexp_extract(t, TOC, 1))).when(t.rlike(trailing) & long & head, F.trim(title)).otherwise(t)

    return once(collapse(c), stripped)


def strip_punctuation(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))


def normalize_title(c: Column, boilerplate: tuple[str, ...] = ()) -> Column:
    t = strip_punctuation(F.lower(strip_toc(c)))
    if boilerplate:
        t = F.array_join(F.filter(F.split(t, " "), lambda w: ~w.isin(*[b.lower() for b in boilerplate])), " ")
    return t


def normalize_body(c: Column) -> Column:
    return collapse(F.lower(c))


def page_number(c: Column) -> Column:
    """Whether a single-spaced text is a page number."""
    return begins(c, "pP" + DIGITS) & c.rlike(r"(?i)^(?:page\s+)?\d+(?:\s*/\s*\d+)?$")


def is_page_number(c: Column) -> Column:
    return page_number(collapse(c))


def _ends_in_digit(c: Column) -> Column:
    return F.right(c, F.lit(1)).isin(*DIGITS)


def toc_line(c: Column) -> Column:
    """Whether a single-spaced text is a line of a table of contents; only those that end in a digit are searched."""
    return _ends_in_digit(c) & c.rlike(TOC_LINE)


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(normalize_title(c), " ", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def body_prefix(c: Column, n: int = 240) -> Column:
    # of a long text twice the length is enough, unless much of it is white space, or the cut makes a final sigma
    short = lambda p: (F.length(c) > 2 * n) & ((F.length(p) < n + 2) | p.contains("\u03c2"))
    return once(normalize_body(F.left(c, F.lit(2 * n))), lambda p: F.left(F.when(short(p), normalize_body(c)).otherwise(p), F.lit(n)))


def is_noise(c: Column, patterns: tuple[str, ...] = ()) -> Column:
    stripped = collapse(c)
    noise = stripped == ""
    for p in patterns:
        noise = noise | stripped.rlike("(?iu)" + p)
    return noise


def strip_heading(c: Column) -> Column:
    """A title without an enumerator that a separator ends, and without a named prefix."""
    return collapse(F.regexp_replace(F.regexp_replace(collapse(c), r"(?iu)^([ivxlcdm]+|\d+|[a-z])\s*[.)-]\s*", ""), NAMED_PREFIX, ""))


def title_core(c: Column) -> Column:
    """A normalized title without a leading enumerator (even without separator) or named prefix."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_title(c), r"^(?:[ivxlcdm]+|\d+|[a-z])\s*", ""), NAMED_PREFIX, ""))


def section_number(title: Column, section_id: Column) -> Column:
    """The enumerator of a title, else the section's id, else nothing."""
    t = F.trim(F.coalesce(title, F.lit("")))
    out = F.coalesce(section_id, F.lit(""))
    for pattern, group in ((r"^(principle|article|section|chapter|standard|rule)\s+(\d+[a-z]?)(?![\p{L}\p{N}_])", 2), (r"^([A-Za-z])\.\s+", 1), (r"^(\d+)\.\s+", 1), (r"^([IVXLCDM]+)\.\s+", 1)):
        out = F.when(t.rlike("(?iu)" + pattern), F.regexp_extract(t, "(?iu)" + pattern, group)).otherwise(out)
    return out


def tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9%$€£.,/-]+"), F.lit(0)), F.lower)


def sentences(c: Column) -> Column:
    """Lower-cased sentences: cut after ``.``, ``?`` or ``!`` before white space."""
    return F.array_remove(F.split(F.lower(collapse(F.coalesce(c, F.lit("")))), " (?<=[.?!] )"), "")


def semantic_units(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(collapse(F.coalesce(c, F.lit(""))), r"(?<=[.?!])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return parts


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays of distinct elements; 1 if both are empty; 6 digits."""
    sizes = lambda x: F.struct((F.size(x["a"]) + F.size(x["b"])).alias("n"), F.size(F.array_intersect(x["a"], x["b"])).alias("k"))
    share = lambda x: F.round(F.when(x["n"] == 0, F.lit(1.0)).otherwise(x["k"] / (x["n"] - x["k"])), 6)
    return once(F.struct(a.alias("a"), b.alias("b")), lambda x: once(sizes(x), share))


def found_in(c: Column, pattern: str) -> Column:
    """Distinct lower-cased matches of a pattern."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)), F.lower))


def set_changes(a: Column, b: Column) -> Column:
    """Elements of one set only."""
    return once(F.struct(a.alias("a"), b.alias("b")), lambda x: F.size(F.array_except(x["a"], x["b"])) + F.size(F.array_except(x["b"], x["a"])))
