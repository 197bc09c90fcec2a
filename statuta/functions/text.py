"""Text functions as Column expressions: folding, tokens, keys, ids, numbers, dates,
selectors. All run inside whole-stage code generation; nulls stay null unless stated."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _fold_maps() -> tuple[dict[str, str], dict[str, str]]:
    """What characters become when decomposed (NFKD) and reduced to ASCII: those that
    become one character, and those that become several."""
    one, several = {"đ": "d", "Đ": "D"}, {}
    for cp in (*range(0xA0, 0xD800), *range(0xF900, 0x10000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if c.isascii())
        if len(plain) == 1:
            one[chr(cp)] = plain
        elif plain and not 0xAC00 <= cp < 0xD7A4:
            several[chr(cp)] = plain
    return one, several


def fold(col: Column) -> Column:
    """Lower case without accents (đ as d) and with compatibility forms resolved (ﬁ as fi,
    ½ as 12, full width as plain); other characters outside ASCII are dropped."""
    one, several = _fold_maps()

    def ascii_only(text: Column) -> Column:
        return F.regexp_replace(F.translate(text, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")

    usual = {c: p for c, p in several.items() if c in _USUAL}
    plain = F.lower(col)
    for c, p in usual.items():
        plain = F.replace(plain, F.lit(c), F.lit(p))
    # rare: only texts that hold such a character are taken apart
    rest = {c: p for c, p in several.items() if c not in _USUAL}
    each = F.create_map(*[F.lit(x) for pair in rest.items() for x in pair])
    apart = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(each[c], c)), "")
    has = lambda chars: F.length(F.translate(col, "".join(chars), "")) < F.length(col)  # noqa: E731  (faster than a pattern)
    full = F.lower(ascii_only(F.when(has(rest), apart).otherwise(plain)))
    return F.when(has(several), full).otherwise(ascii_only(F.lower(col)))
#: Characters of several that occur in ordinary text: fractions, dots, signs, ligatures, numerals.
_USUAL = frozenset("¼½¾…‥™№℃℉⅓⅔⅛⅜⅝⅞ﬀﬁﬂﬃﬄⅱⅲⅳⅵⅶⅷⅸⅺⅻ㎡㎢㎏㎝㎞㎜")


def strip_marks(col: Column) -> Column:
    """Lower case with accents removed (đ as d) and everything else kept."""
    pairs = {chr(cp): unicodedata.normalize("NFD", chr(cp))[0] for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", chr(cp)) != chr(cp)} | {"đ": "d", "Đ": "D"}
    return F.lower(F.regexp_replace(F.translate(col, "".join(pairs), "".join(pairs.values())), r"\p{Mn}", ""))


def squeeze(col: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def strip(col: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def match_key(col: Column) -> Column:
    """Folded text with everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(fold(col), "[^a-z0-9]+", " "))


def tokens(col: Column) -> Column:
    """Folded words; null and wordless texts have the empty array."""
    words = F.filter(F.split(fold(col), "[^a-z0-9]+"), lambda w: w != "")
    return F.coalesce(words, F.array().cast("array<string>"))


def compact_key(col: Column) -> Column:
    """Folded text with everything but letters and digits deleted."""
    return F.regexp_replace(fold(col), "[^a-z0-9]", "")


def point_key(col: Column) -> Column:
    """As ``compact_key``, but đ becomes dd, so that points d and đ stay apart."""
    return compact_key(F.replace(F.replace(col, F.lit("đ"), F.lit("dd")), F.lit("Đ"), F.lit("DD")))


def slug(col: Column, longest: int = 96) -> Column:
    """Folded words joined by underscores; over ``longest`` characters the first 80 and a hash."""
    name = F.replace(match_key(col), F.lit(" "), F.lit("_"))
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, 80), F.lit("_"), F.substring(F.md5(name), 1, 8))).otherwise(name)


def document_number(col: Column) -> Column:
    """Document number in one spelling: no spaces, one kind of dash, capitals."""
    return F.upper(F.regexp_replace(F.regexp_replace(col, r"(?U)\s+", ""), "[‐‑–—−]", "-"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 16 hex digits of the md5 of the parts joined by a bar; null parts are empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.md5(joined), 1, 16))


def none_if_null(col: Column) -> Column:
    """The spelled nulls of text files as null."""
    return F.when(F.lower(F.trim(col)).isin("null", "none", "nan", "nat", ""), None).otherwise(F.trim(col))


def truth(col: Column) -> Column:
    """Truth values in their usual spellings; others are null."""
    word = F.lower(F.trim(col))
    return F.when(word.isin("true", "t", "yes", "y", "1"), True).when(word.isin("false", "f", "no", "n", "0"), False)


def dates(col: Column) -> Column:
    """ISO dates of every "d/m/y" and "ngày d tháng m năm y" in a text; dates that don't exist are left out."""
    numeric = F.regexp_extract_all(col, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), 1)
    spelled = F.regexp_extract_all(col, F.lit(r"ngày (\d{1,2} tháng \d{1,2} năm \d{4})\b"), 1)
    both = F.concat(numeric, F.transform(spelled, lambda s: F.regexp_replace(s, " tháng | năm ", "/")))
    return F.filter(F.transform(both, lambda s: F.date_format(F.try_to_date(s, "d/M/yyyy"), "yyyy-MM-dd")), lambda d: d.isNotNull())


def numbers(col: Column) -> Column:
    """Number tokens with thousand points removed and decimal commas as points."""
    found = F.regexp_extract_all(col, F.lit(r"\d+(?:[.,]\d+)*"), 0)
    return F.transform(found, lambda n: F.when(n.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(F.replace(n, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(n, F.lit(","), F.lit("."))))


def path_level(path: Column, name: str) -> Column:
    """The number or letter of a level in a path text, such as the article; null if it has none."""
    found = F.regexp_extract(path, rf"(?:^|> ){name} ([^ >]+)", 1)
    return F.when(found != "", found)


def boundary_contains(text: Column, surface: Column) -> Column:
    """Whether a folded surface occurs in a folded text as whole words."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), surface, F.lit(" ")))


# What is cut from the ends of a surface.
_SURFACE_ENDS = r"^[\"'“”‘’(\[{]+|[\"'“”‘’)\]};:,.]+$"


def surface(col: Column) -> Column:
    """A surface form: lower case, single spaces, without quotes, brackets and marks at its ends."""
    return squeeze(F.regexp_replace(F.lower(squeeze(col)), _SURFACE_ENDS, ""))


def surface_key(col: Column) -> Column:
    return match_key(surface(col))


def graph_key(col: Column) -> Column:
    """Lower case with one kind of dash, quotes as spaces and single spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(col), "[–—−]", "-"), "[\"'“”‘’`]", " "))


def content_terms(col: Column, stop: list[str], shortest: int = 2) -> Column:
    """Folded words without stop words, numbers and words under ``shortest`` letters."""
    return F.filter(tokens(col), lambda w: (F.length(w) >= shortest) & ~w.isin(*stop) & ~w.rlike(r"^\d+$"))


def form_number(col: Column) -> Column:
    """The number of a form as a key: leading zeros removed, letters kept; null without one."""
    found = F.regexp_extract(fold(col), r"(?:^|[^a-z0-9])(?:mau\s*(?:so\s*)?)?0*(\d+[a-z]?)(?![a-z0-9])", 1)
    return F.when(found != "", found)


def form_numbers(*texts: Column) -> Column:
    """The distinct form numbers that texts name after the word for form."""
    whole = fold(F.concat_ws(" | ", *texts))
    found = F.regexp_extract_all(F.regexp_replace(whole, "[_-]", " "), F.lit(r"\bmau\s+(?:so\s+)?0*(\d+[a-z]?)\b"), 1)
    return F.array_distinct(found)


def roman(col: Column) -> Column:
    """The value of a Roman numeral, or of digits; null for anything else."""
    value = F.create_map(*[F.lit(x) for x in ("I", 1, "V", 5, "X", 10, "L", 50, "C", 100, "D", 500, "M", 1000)])
    letters = F.filter(F.split(F.upper(col), ""), lambda c: c != "")
    sums = F.aggregate(letters, F.struct(F.lit(0).alias("t"), F.lit(0).alias("last")), lambda a, c: F.struct((a["t"] + value[c] - F.when(a["last"] < value[c], 2 * a["last"]).otherwise(0)).alias("t"), value[c].alias("last")))
    return F.when(col.rlike(r"^\d+$"), col.try_cast("int")).when(F.upper(col).rlike("^[IVXLCDM]+$"), sums["t"]).cast("int")


def appendix_order(col: Column) -> Column:
    """Sort key of an appendix label: its number (Roman or plain), then its letters."""
    token = F.element_at(F.split(strip(col), r"\s+"), -1)
    head = F.regexp_extract(F.upper(token), r"^([IVXLCDM]+|\d+)", 1)
    return F.struct(F.coalesce(roman(F.when(head != "", head)), F.lit(10**6)).alias("number"), F.upper(token).alias("label"))


def number_or(col: Column, default: float = 0.0) -> Column:
    """A number, or the default where the text is none."""
    return F.coalesce(col.try_cast("double"), F.lit(default))


def percent(col: Column) -> Column:
    return F.concat(F.format_number(col * 100, 2), F.lit("%"))


def shorten(col: Column, longest: int) -> Column:
    """Texts over ``longest`` characters cut, with three dots."""
    return F.when(F.length(col) > longest, F.concat(F.rtrim(F.substring(col, 1, longest)), F.lit("..."))).otherwise(col)


def around(text: Column, start: Column, end: Column, window: int = 160) -> Column:
    """The text within ``window`` characters of a span; without one its beginning."""
    low = F.greatest(start - window, F.lit(0))
    inside = F.substring(text, low + 1, F.least(end + window, F.length(text)) - low)
    return F.when(start.isNull() | end.isNull(), F.substring(text, 1, 2 * window)).otherwise(inside)
