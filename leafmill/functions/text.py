"""Column functions over strings: normalising, numbering, versions, dates and line classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the token filter for section mapping.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "into", "are", "was", "were", "but", "not", "you", "your", "our", "any", "all")
LABEL = "^[A-Z][A-Za-z0-9 /&().'-]{1,40}:\\s+\\S"
METADATA = "(?i)^(version|prepared by|reviewed by|approved by|author|date|effective date|document (no|number|id)|revision|status|owner|department)\\b.*[:].*"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def heading_key(text: Column) -> Column:
    """Lower-case, white space collapsed, dashes unified."""
    return F.lower(collapse(F.regexp_replace(text, "[\\u2010-\\u2015\\u2212]", "-")))


def section_number(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), "^([0-9]+(?:\\.[0-9]+)*)\\.?(\\s|$)", 1)


def strip_section_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), "^[0-9]+(?:\\.[0-9]+)*\\.?\\s+", ""))


def section_level(text: Column) -> Column:
    """Parts of the leading number, at most 4; 0 without one."""
    n = section_number(text)
    return F.when(n == "", 0).otherwise(F.least(F.lit(4), F.size(F.split(n, "\\."))))


def is_upper(text: Column) -> Column:
    return text.rlike("\\p{Lu}") & ~text.rlike("\\p{Ll}|\\p{Lt}")


def is_title(text: Column) -> Column:
    """Upper-case letters start cased runs and lower-case letters only continue them; one upper-case letter at least."""
    cased = "[\\p{Lu}\\p{Lt}\\p{Ll}]"
    return text.rlike("[\\p{Lu}\\p{Lt}]") & ~text.rlike(cased + "[\\p{Lu}\\p{Lt}]") & ~text.rlike("(^|[^\\p{Lu}\\p{Lt}\\p{Ll}])\\p{Ll}")


def stem(word: Column) -> Column:
    """A small English stemmer: ies, sses, ses, s, ing and ed, by length."""
    n = F.length(word)
    cut = lambda k, add="": F.concat(word.substr(F.lit(1), n - k), F.lit(add))
    return (
        F.when(word.endswith("ies") & (n > 4), cut(3, "y"))
        .when(word.endswith("sses") & (n > 4), cut(2))
        .when(word.endswith("ses") & (n > 4), cut(1))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), cut(1))
        .when(word.endswith("ing") & (n > 4), cut(3))
        .when(word.endswith("ed") & (n > 4), cut(2))
        .otherwise(word)
    )


def map_tokens(text: Column) -> Column:
    """Stems of words of three letters and more, without stop words."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]{3,}"), F.lit(0)), F.lower), lambda w: ~w.isin(*STOPWORDS))
    return F.transform(found, stem)


def quote_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


#: What a line that only holds a page number looks like.
PAGE_NUMBER = "(?i)^((page\\s+)?[0-9]+(\\s*(of|/|-|\\x{2013})\\s*[0-9]+)?|[-\\x{2013}\\x{2014}\\s]*[0-9]+[-\\x{2013}\\x{2014}\\s]*|[ivxlcdm]{1,7})$"


#: A number, or a capital, with dotted parts, before a title.
NUMBERED = "^\\s*((?:[0-9]+|[A-Z])(?:\\.[0-9A-Za-z]+)*)\\.?\\s+\\S"


def running_norm(line: Column) -> Column:
    """Each run of digits to one #, lower case, collapsed: equal for a header on every page."""
    return collapse(F.regexp_replace(F.lower(line), "[0-9]+", "#"))


def is_page_number(line: Column) -> Column:
    """A number, also ``page 3 of 12``, ``3/12``, ``12 - 30``, between dashes or in Roman digits; 20 characters at most."""
    text = F.trim(line)
    return (F.length(text) <= 20) & text.rlike(PAGE_NUMBER)


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, "(\\w+)-\\n\\s*(\\w+)", "$1$2")


def uppercase_like(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    upper = F.length(F.regexp_replace(text, "[^\\p{Lu}]", ""))
    return (letters > 0) & (upper >= 0.85 * letters) & (F.size(F.split(collapse(text), " ")) <= 12)


def numbering_depth(text: Column) -> Column:
    """Dotted parts of a leading number or capital before a title (3.2.1 Scope -> 3, A.1 Data -> 2); 0 without one."""
    n = F.regexp_extract(text, NUMBERED, 1)
    return F.when(n == "", 0).otherwise(F.size(F.split(n, "\\.")))


def level_of_ratio(ratio: Column) -> Column:
    """Heading level of a font size that is so many times the body's."""
    return F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.2, 3).otherwise(4)


def is_header_row(cells: Column) -> Column:
    """A table row with no empty cell and none over 60 characters, at least half of whose cells start in upper case.

    Null cells count as empty; a row without cells is none.
    """
    trimmed = F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    whole = ~F.exists(trimmed, lambda c: (c == "") | (F.length(c) > 60))
    titled = F.size(F.filter(trimmed, lambda c: c.rlike("^[\\p{Lu}\\p{Lt}]") | is_upper(c)))
    return (F.size(cells) > 0) & whole & (titled >= F.greatest(F.lit(1), F.floor(F.size(cells) / 2)))


def padded(grid: Column) -> Column:
    """Rows of a grid (array of arrays of strings) filled up with empty cells to the longest."""
    width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
    return F.transform(grid, lambda row: F.concat(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(row))))


def xml_safe(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "\x0b\x0c", "  "), "[\\x00-\\x08\\x0E-\\x1F\\x7F]", "")


def strip_todo(text: Column) -> Column:
    return F.regexp_replace(text, "(?m)^\\[TODO\\]\\s.*$", "")


def list_leader(line: Column) -> Column:
    """bullet or number for a line with a literal list marker, else null."""
    return F.when(line.rlike("^\\s*[-*\\u2022\\u00b7\\u25cf]\\s+\\S"), "bullet").when(line.rlike("^\\s*([0-9]{1,3}|[a-z])[.)]\\s+\\S"), "number")


def strip_leader(line: Column) -> Column:
    return F.regexp_replace(line, "^\\s*([-*\\u2022\\u00b7\\u25cf]|([0-9]{1,3}|[a-z])[.)])\\s+", "")


def normal_markers(text: Column) -> Column:
    return F.regexp_replace(text, "(?m)^(\\s*)[*\\u2022\\u00b7\\u25cf]\\s+", "$1- ")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, "([^/\\\\]*)$", 1), "[^A-Za-z0-9._-]+", "_")


def extension(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, "\\.([A-Za-z0-9]+)$", 1))


def version_of(text: Column) -> Column:
    return F.regexp_extract(text, "(?i)(?:^|[^\\p{L}\\p{N}])(?:version|rev(?:ision)?|ver)\\.?\\s*[:#]?\\s*v?([0-9]+(?:\\.[0-9]+)*)", 1)


def bump(version: Column, major: bool = False) -> Column:
    """2.3.4 -> 2.3.5, 2 -> 2.1; major: 2.3.4 -> 3.0.0, 2 -> 3.0. Parts that are no numbers go; without one nothing changes."""
    parts = F.transform(F.filter(F.split(version, "\\."), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))
    last = F.size(parts) - 1
    if major:
        out = F.transform(parts, lambda x, i: F.when(i == 0, x + 1).otherwise(F.lit(0).cast("long")))
        more = F.array(F.lit(0).cast("long"))
    else:
        out = F.transform(parts, lambda x, i: F.when((i == last) & (i > 0), x + 1).otherwise(x))
        more = F.array(F.lit(1).cast("long"))
    out = F.when(last == 0, F.concat(out, more)).otherwise(out)
    return F.when(last < 0, version).otherwise(F.array_join(F.transform(out, lambda x: x.cast("string")), "."))


def version_parts(version: Column) -> Column:
    """The numbers of a version without zeros at the end: such arrays compare as versions of any length do."""
    parts = F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    ends = F.aggregate(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(parts, 1, ends)


def sort_key(section: Column) -> Column:
    """9.4.6 -> 009.004.006: section numbers that sort as text."""
    return F.array_join(F.transform(F.split(section, "\\."), lambda x: F.lpad(x, 3, "0")), ".")


def humanise(size: Column) -> Column:
    """A number of bytes in B, KB, MB or GB, halves rounded up to a tenth."""

    def tenths(unit: int, name: str) -> Column:
        n = F.floor((size.cast("decimal(38,0)") * 20 + unit) / (2 * unit)).cast("long")
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"), F.lit(name))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, tenths(1 << 10, " KB"))
        .when(size < 1 << 30, tenths(1 << 20, " MB"))
        .otherwise(tenths(1 << 30, " GB"))
    )


def age(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(seconds.cast("long").cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def band(score: Column) -> Column:
    return F.when(score >= 0.75, "good").when(score >= 0.5, "fair").otherwise("poor")


def document_type(text: Column) -> Column:
    kinds = (("protocol", "protocol"), ("report", "report"), ("sop|standard operating procedure|procedure", "sop"), ("policy", "policy"), ("plan", "plan"), ("specification", "specification"))
    out = F.lit("document")
    for pattern, kind in reversed(kinds):
        out = F.when(text.rlike(f"(?i)(^|[^\\p{{L}}\\p{{N}}])({pattern})($|[^\\p{{L}}\\p{{N}}])"), kind).otherwise(out)
    return out
