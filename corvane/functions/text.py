"""Text functions on columns: markdown structure, links, figures, token estimates.

All of them are built-in expressions, evaluated in the JVM, but for Unicode
normalisation, which Spark SQL lacks and an Arrow UDF supplies.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIKI_LINK = r"\[{2}([^#|\]]+?)(?:#[^|\]]*)?(?:[|][^\]]+?)?\]{2}"
WIKI_LINK_WITH_HEADING = r"\[{2}([^|\]]+)(?:[|][^\]]*)?\]{2}"
HAN = r"[\x{4E00}-\x{9FFF}]"
HAN_WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"


#: What counts as white space in any script (as in Python's str.strip).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Those of them that are space separators.
SEPARATOR_SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """White space of any script off both ends (trim() takes spaces only)."""
    return F.btrim(c, F.lit(BLANKS))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often then refers to it."""
    return F.transform(F.array(value), then)[0]


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def section_path(c: Column) -> Column:
    """SCL-4: compatibility form, white space collapsed, case kept."""
    return strip(F.regexp_replace(nfkc(c), r"(?U)\s+", " "))


def wiki_links(c: Column, own: Column) -> Column:
    """TXT-22: distinct link targets, without aliases, headings and the note itself."""
    found = F.transform(F.regexp_extract_all(c, F.lit(WIKI_LINK), F.lit(1)), strip)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x != "") & (x != own))))


def reply_links(c: Column) -> Column:
    """TXT-23: link targets of a reply; a heading stays part of the name."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(WIKI_LINK_WITH_HEADING), F.lit(1)), strip), lambda x: x != ""))


def note_names(c: Column) -> Column:
    """TXT-27: names in lenticular brackets, up to the angle mark if there is one."""
    before = F.regexp_extract_all(c, F.lit(r"【(.+?) ›"), F.lit(1))
    return F.array_distinct(F.array_union(before, F.regexp_extract_all(c, F.lit(r"【(.+?)】"), F.lit(1))))


def frontmatter_split(c: Column) -> tuple[Column, Column]:
    """TXT-1: (frontmatter block or null, body); the block ends at the first line that begins with three dashes."""
    block = F.regexp_extract(c, r"(?s)^---(.*?)\n---", 1)
    has = c.rlike(r"(?s)^---.*?\n---")
    body = F.when(has, strip(F.regexp_replace(c, r"(?s)^---.*?\n---", ""))).otherwise(strip(c))
    return F.when(has, block), body


def frontmatter_value(block: Column, key: str) -> Column:
    """The values of one key: a scalar, an inline list or a block list, as an array; empty if the key is missing."""
    line = F.regexp_extract(block, rf"(?m)^{key}:[^\S\n]*(.*)$", 1)
    inline = F.filter(F.transform(F.split(F.regexp_replace(line, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", "")), lambda x: x != "")
    rest = F.regexp_extract(block, rf"(?m)^{key}:[^\S\n]*\n((?:[^\S\n]*-[^\n]*\n?)+)", 1)
    listed = F.filter(F.transform(F.split(rest, "\n"), lambda x: F.regexp_replace(strip(F.regexp_replace(x, r"^\s*-\s*", "")), "^[\"']+|[\"']+$", "")), lambda x: x != "")
    scalar = F.filter(F.array(F.regexp_replace(strip(line), "^[\"']+|[\"']+$", "")), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(strip(line).rlike(r"^\[.*\]$"), inline).when(strip(line) != "", scalar).when(rest != "", listed), empty)


def frontmatter_strip(c: Column) -> Column:
    """TXT-2: the lenient cut, at any three dashes behind the first three; the rest as it is."""
    end = F.locate("---", c, 4)
    return F.when(c.startswith("---") & (end > 0), F.substring(c, end + 3, F.length(c))).otherwise(c)


def heading_pieces(body: Column) -> Column:
    """TXT-3: the body cut before every heading of level 1 to 3, as an array; a heading opens its piece."""
    return F.split(body, r"\n(?=#{1,3}(?U:[\s&&[^\n]])+[^\n])")


def piece_section(piece: Column, note: Column) -> Column:
    """The heading that opens a piece, without its marks, or the note's name."""
    head = F.regexp_extract(piece, r"^#{1,3}(?U:[\s&&[^\n]])+([^\n]+)", 1)
    return F.when(head != "", strip(head)).otherwise(note)


def top_folder(rel_path: Column) -> Column:
    """TXT-5: the first part of a path of two or more."""
    parts = F.split(rel_path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit(""))


def figure_ids(c: Column) -> Column:
    """TXT-21: distinct figure names in order, "Figure 32.4" written as "Fig 32-4"."""
    latin = F.regexp_extract_all(c, F.lit(r"(?i)\bfig(?:[.]|ure[.]?)?\s*\d+[.-]\d+\w?"), F.lit(0))
    han = F.regexp_extract_all(c, F.lit(r"圖\s*\d+[.-]\d+\w?"), F.lit(0))
    plain = F.transform(
        F.concat(latin, han),
        lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\bfig(?:[.]|ure[.]?)?\s*", "Fig "), r"(\d)\.(\d)", "$1-$2"),
    )
    return F.array_sort(F.array_distinct(F.transform(plain, strip)))


def chunk_kind(c: Column) -> Column:
    """TXT-16: table if two of the first three lines open with a bar, figure_caption if one has a figure mark, else body."""
    top = F.slice(F.split(c, "\n"), 1, 3)
    bars = F.size(F.filter(top, lambda x: x.rlike(r"(?U)^\s*\|")))
    return F.when(bars >= 2, "table").when(F.exists(top, lambda x: x.contains("<!-- REF:")), "figure_caption").otherwise("body")


def han_heavy(line: Column) -> Column:
    """TXT-28: more than half of the characters are Han."""
    return F.coalesce(F.regexp_count(line, F.lit(HAN)) / F.nullif(F.length(line), F.lit(0)) > 0.5, F.lit(False))


def drop_han_heavy_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~han_heavy(x)), "\n")


def strip_think(c: Column) -> Column:
    """TXT-29: reasoning blocks out."""
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def rescue_json(c: Column, schema: str) -> Column:
    """TXT-29: the outermost braces parsed; trailing commas and raw line breaks repaired if the first try fails."""
    raw = F.regexp_extract(strip_think(c), r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(F.regexp_replace(raw, r",\s*([}\]])", "$1"), r"[\n\r]+", " ")
    parse = lambda x: F.from_json(x, schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    first = parse(raw)
    return F.when(raw == "", F.lit(None)).when(first["_bad"].isNull(), first).otherwise(parse(mended))


def word_count(c: Column) -> Column:
    """Pieces between white space. They are not listed: runs of white space become single spaces, which are counted in bytes."""
    single = F.regexp_replace(c, r"(?U)\s(?:\s+|(?<! ))", " ")
    spaces = lambda s: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))
    return bound(single, lambda s: F.when(s == "", 0).otherwise(spaces(s) + 1 - s.startswith(" ").cast("int") - s.endswith(" ").cast("int")))


def token_estimate(c: Column) -> Column:
    """SCL-3: one and a half tokens a Han character, a quarter a word, rounded down."""
    han = F.when(F.octet_length(c) == F.length(c), 0).otherwise(F.regexp_count(c, F.lit(HAN_WIDE)))  # an ASCII text has none
    return F.floor(han * 1.5 + word_count(c) * 0.25).cast("long")


#: Where a cut text may end, in order of preference.
SEPARATORS = (*"。！？", *".!?", "\n\n", "\n")
TOKEN = r"[\x{4E00}-\x{9FFF}]|[^\W\x{4E00}-\x{9FFF}]+|[^\w\s]"


def token_count(c: Column) -> Column:
    """SCL-1 without a model: Han characters, words and marks, one token each."""
    return F.regexp_count(c, F.lit("(?U)" + TOKEN)).cast("int")


def truncate_tokens(c: Column, most: Column | int) -> Column:
    """SCL-2: the first `most` tokens, back to the last of the first separator whose last place lies beyond 70 % of them."""
    n = most if isinstance(most, Column) else F.lit(most)
    cut = F.array_join(F.slice(F.regexp_extract_all(c, F.lit(rf"(?U)\s*(?:{TOKEN})"), F.lit(0)), F.lit(1), n), "")
    tries = []
    for sep in SEPARATORS:
        place = F.length(cut) - F.instr(F.reverse(cut), sep[::-1]) - len(sep) + 1  # 0-based place of the last one
        tries.append(F.when((F.instr(cut, sep) > 0) & (place > F.length(cut) * 0.7), F.substring(cut, F.lit(1), place + len(sep))))
    return F.when(token_count(c) <= n, c).otherwise(F.coalesce(*tries, cut))


def fuzzy_match(needle: str, hay: Column) -> Column:
    """SCL-5: the needle's characters stand in hay in this order, whatever the case."""
    return F.lower(hay).rlike("(?s)" + ".*".join("\\Q" + ch.replace("\\E", "") + "\\E" for ch in needle.lower()) if needle else "")


def similarity_text(c: Column) -> Column:
    """SCL-9: two decimals, or a question mark.

    Rounded by the number as it is stored, half to even, as Python and C do; format_string() rounds its shortest decimal form, half up (0.145 to 0.15).
    """
    return F.coalesce(F.regexp_replace(F.format_number(c.cast("double"), 2), ",", ""), F.lit("?"))


def clean_text(c: Column) -> Column:
    """TXT-30: ill-formed bytes replaced."""
    return F.make_valid_utf8(c)


def section_extract(lines: Column, heading: Column) -> Column:
    """TXT-24: from the named heading to the next of its level or higher; lines is an array. Null if there is none."""
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    title = lambda x: F.lower(strip(F.regexp_replace(x, r"^#{1,6}\s+", "")))

    def cut(ls: Column, at: Column) -> Column:
        rest, own = F.slice(ls, at + 1, F.size(ls)), level(F.get(ls, at - 1))
        ends = lambda r: bound(F.array_position(F.transform(r, lambda x: level(x).between(1, own)), True).cast("int"), lambda stop: F.when(stop > 0, F.slice(r, F.lit(1), stop - 1)).otherwise(r))
        return F.array_join(F.concat(F.array(F.get(ls, at - 1)), bound(rest, ends)), "\n")

    here = lambda ls: F.array_position(F.transform(ls, lambda x: (level(x) > 0) & (title(x) == F.lower(strip(heading)))), True).cast("int")
    return bound(lines, lambda ls: bound(here(ls), lambda at: F.when(at > 0, cut(ls, at))))
