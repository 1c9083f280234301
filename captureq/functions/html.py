"""HTML text as tokens: start tags, attributes, elements, references, by built-in functions.

One pattern reads a page from `<` to `<`: comments, declarations, elements whose content is raw text, start and end tags
with their attributes. Every repetition is possessive or stops at a fixed text, so a page is read once from left to
right, whatever stands in it, and no repetition recurses in the JVM's matcher. Rules that need a tree (implied elements,
misnested formatting, scripts that hold comments) are left out."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from captureq.functions.text import bound

#: White space of the syntax.
_S = r"\t\n\f\r "
#: An attribute: what is no white space, `/` or `>` up to `=`, then a value in quotes or up to white space. A quote that is
#: never closed runs to the end of the text, so that the tag is none.
_VALUE = rf"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^{_S}>"'][^{_S}>]*+)"""
_ATTRIBUTE = rf"[^{_S}/>][^{_S}/>=]*+(?:[{_S}]*+=[{_S}]*+{_VALUE}?+)?+"
_REST = rf"(?:[{_S}/]++|{_ATTRIBUTE})*+>"
_NAME = rf"[a-zA-Z][^{_S}/>]*+"
#: Elements whose content is text up to their own end tag (noscript: scripts run).
_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript"

# Below the `<`.
_COMMENT = r"!--(?:-?+>|.*?(?:--!?+>|\z))"
_DECLARATION = r"(?:[!?]|/[^a-zA-Z>])[^>]*+>?+|/>"
_TAG = rf"/?+{_NAME}{_REST}"
#: A tag that the end of the text cuts off takes all that is left with it.
_CUT = r"/?+[a-zA-Z].*+"


def _raw(group: int) -> str:
    return rf"({_RAW})(?=[{_S}/>]){_REST}(?:.*?(?=</\{group}[{_S}/>])|.*+)"


def _start(name: str) -> str:
    return rf"{name}(?=[{_S}/>]){_REST}"


def _element(name: str, inner: int, stop: str) -> str:
    """A start tag and what follows, up to a tag of `stop`, a tag that is cut off, or the end."""
    other = rf"{_COMMENT}|{_DECLARATION}|{_raw(inner)}|(?!{stop}){_TAG}|(?!/?+[a-zA-Z])"
    return rf"{_start(name)}(?:[^<]++|<(?:{other}))*+"


_TOKEN = rf"(?is)<(?:{_COMMENT}|{_DECLARATION}|{_raw(1)}|{_TAG}|{_CUT})"
_FIRST_TAG = rf"(?is)^(<{_NAME}{_REST})"
_ANCHOR = rf"(?is)(<(?:{_COMMENT}|{_DECLARATION}|{_raw(2)}|{_element('a', 3, rf'/?+a[{_S}/>]')}|{_TAG}|{_CUT}))"
_MEDIA = rf"(?is)(<(?:{_COMMENT}|{_DECLARATION}|{_raw(2)}|{_element('video', 3, rf'/video[{_S}/>]')}|{_element('audio', 4, rf'/audio[{_S}/>]')}|{_TAG}|{_CUT}))"
_TITLE = rf"(?is)<(?:{_COMMENT}|{_DECLARATION}|title(?=[{_S}/>])(?:[{_S}/]++|{_ATTRIBUTE})*+(>.*?)(?:</title[{_S}/>]|\z)|{_raw(2)}|{_TAG}|{_CUT})"
_MARKUP = rf"(?is)<(?:{_COMMENT}|{_DECLARATION}|{_TAG})"


def tokens(html: Column) -> Column:
    """Every token of a page but its text, in order; an element with raw text is one token. Null html has none."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(_TOKEN), 0), F.array().cast("array<string>"))


def start_tags(html: Column) -> Column:
    """The start tags of a page, in document order."""
    return F.filter(F.transform(tokens(html), lambda t: F.regexp_extract(t, _FIRST_TAG, 1)), lambda t: t != "")


def _elements(html: Column, pattern: str, name: str) -> Column:
    found = F.coalesce(F.regexp_extract_all(html, F.lit(pattern), 1), F.array().cast("array<string>"))
    return F.filter(found, lambda t: t.rlike(rf"(?is)^<(?:{name})[{_S}/>]") & t.rlike(_FIRST_TAG))


def anchor_elements(html: Column) -> Column:
    """Each `a` element: its start tag and what it holds, up to its end tag, the next `a` or the end of the page."""
    return _elements(html, _ANCHOR, "a")


def media_elements(html: Column) -> Column:
    """Each video and audio element with what it holds."""
    return _elements(html, _MEDIA, "video|audio")


def first_tag(token: Column) -> Column:
    return F.regexp_extract(token, _FIRST_TAG, 1)


def title_text(html: Column) -> Column:
    """The decoded text of the first title element; null where there is none."""
    found = F.filter(F.regexp_extract_all(html, F.lit(_TITLE), 1), lambda t: t != "")
    return decoded(F.substr(F.get(found, F.lit(0)), F.lit(2)))


def text_of(element: Column) -> Column:
    """The decoded text between an element's start tag and its end, without markup."""
    return decoded(F.regexp_replace(element, _MARKUP, ""))


def attributes(tag: Column) -> Column:
    """struct<names, values>: the attributes of a start tag as they stand, names in lower case; the first of a name counts.
    A value is null where there is no `=`."""
    text = F.regexp_replace(tag, rf"^<[^{_S}/>]*+|>$", "")
    pattern = rf"(?s)([^{_S}/>][^{_S}/>=]*+)([{_S}]*+=[{_S}]*+{_VALUE}?+)?+"
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda n: F.lower(n))
    return F.struct(names.alias("names"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("values"))


def value(attrs: Column, name: str) -> Column:
    """The decoded value of an attribute: null where the tag has none of that name, empty where it has no value."""
    raw = F.get(attrs["values"], (F.array_position(attrs["names"], name) - 1).cast("int"))
    bare = lambda v: F.when(v.rlike("^[\"']"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return decoded(bound(F.regexp_replace(raw, rf"^[{_S}]*+=[{_S}]*+", ""), bare))


#: What numeric references from 128 to 159 stand for (those of windows-1252; five of them are kept), by number.
_WINDOWS = {str(k): bytes([k]).decode("cp1252") for k in range(0x80, 0xA0) if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: Names that end with a semicolon, as the Python library lists them.
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}


def _table(entries: dict[str, str]) -> Column:
    """A map of texts as one constant."""
    return F.str_to_map(F.lit("\2".join(f"{k}\1{v}" for k, v in entries.items())), F.lit("\2"), F.lit("\1"))


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for 0, surrogates and what is beyond Unicode."""
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    return F.coalesce(F.when(code.between(0x80, 0x9F), _table(_WINDOWS)[code.cast("string")]), plain)


def _reference(piece: Column) -> Column:
    """What one piece of a text stands for: a reference its character, anything else itself."""
    # More than eight digits are beyond Unicode in either base.
    digits = F.regexp_extract(piece, r"^&#[xX]?0*+([0-9a-fA-F]{0,8}+);?$", 1)
    code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    named = _table(_NAMED)[F.regexp_extract(piece, "^&(.*);$", 1)]
    return F.when(piece.rlike("^&#[0-9xX]"), _character(code)).when(piece.startswith("&") & piece.endswith(";"), F.coalesce(named, piece)).otherwise(piece)


_PIECES = r"(?s)&#[xX][0-9a-fA-F]++;?+|&#[0-9]++;?+|&[a-zA-Z][a-zA-Z0-9]*+;|[^&]++|&"


def decoded(text: Column) -> Column:
    """A text without character references: numeric ones with or without their semicolon, named ones with it."""
    whole = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECES), 0), _reference), "")
    return bound(text, lambda t: F.when(t.contains("&"), whole(t)).otherwise(t))
