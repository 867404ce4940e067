"""Title, text and links of HTML by regular expressions, without Python workers; response headers."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from . import uri as U
from .text import let

#: Elements that separate words; any other tag vanishes without a trace.
BLOCKS = "address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frameset|h[1-6]|head|header|hgroup|hr|html|isindex|legend|li|main|menu|nav|noscript|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"
SPACES = "[ \\t\\n\\r\\f\\x{00A0}]+"
#: What a tag holds besides its name: a quote only counts after an equals sign, and then a > in the value ends nothing.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
#: Comments and elements whose content is no text, to their end or to that of the document.
HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b{ATTRIBUTES}>.*?(?:</\1\b[^>]*>|\z)"
#: The head ends with its end tag, or where anything begins that can't be in it.
HEAD = rf"(?is)<head\b{ATTRIBUTES}>.*?(?:</head\s*>|(?=</?(?!(?:title|meta|link|base|noscript|head)\b)[a-z])|\z)"
TITLE = rf"(?is)<title\b{ATTRIBUTES}>(.*?)(?:</title\s*>|\z)"
TAG = rf"(?s)</?[A-Za-z][^\s/>]*+{ATTRIBUTES}(?:>|\z)|<[!?/][^>]*(?:>|\z)"
HREF = r"""(?is)^<(?:a|base)[\s/]+(?:(?!href[\s=])[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']*))?[\s/]*)*+href\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)"""
#: Names that count without a semicolon; all names with and those without one, as JSON; a reference.
LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
NAMED = (json.dumps({n[:-1]: c for n, c in html5.items() if n.endswith(";")}), json.dumps({n: html5[n] for n in LEGACY}))
REFERENCE = r"^&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
#: Numbers of the C1 controls mean the letters of the Windows code page.
WINDOWS = {chr(c): bytes([c]).decode("cp1252") for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _number(name: Column) -> Column:
    """The character of a numeric reference; what is none is the replacement character."""
    code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 16), 16, 10)).otherwise(F.conv(F.substring(name, 2, 16), 10, 10)).cast("decimal(20,0)")

    def char(c: Column) -> Column:
        bad = (c == 0) | (c > 0x10FFFF) | c.between(0xD800, 0xDFFF)
        safe = F.when(bad, 0xFFFD).otherwise(c).cast("long")
        return F.translate(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"), "".join(WINDOWS), "".join(WINDOWS.values()))

    return let(code, char)


def decode_entities(text: Column, attribute: bool = False, ended: bool = False) -> Column:
    """Character references, named and numeric, each decoded once; what isn't one stays as it is.

    Old names count without a semicolon too, in text also as the beginning of a longer word, in an attribute only if
    neither a letter, a digit nor an equals sign follows. `ended`: only what a semicolon ends counts.
    """
    named, legacy = (F.from_json(F.lit(x), "map<string,string>") for x in NAMED)  # constants that are folded once

    def piece(p: Column) -> Column:
        parts = F.struct(F.regexp_extract(p, REFERENCE, 0).alias("all"), F.regexp_extract(p, REFERENCE, 1).alias("name"))

        def decoded(r: Column) -> Column:
            rest = F.substring(p, F.length(r["all"]) + 1, F.length(p))
            whole = r["all"].endswith(";")
            if ended:
                short = F.lit(None).cast("string")
            elif attribute:
                short = F.when(~rest.startswith("="), F.concat(F.try_element_at(legacy, r["name"]), rest))
            else:
                lead = F.regexp_extract(p, "^&(" + "|".join(LEGACY) + ")", 1)
                short = F.when(lead != "", F.concat(F.try_element_at(legacy, lead), F.substring(p, F.length(lead) + 2, F.length(p))))
            known = F.when(whole, F.concat(F.try_element_at(named, r["name"]), rest))
            quick = F.when(r["all"] == "&amp;", F.concat(F.lit("&"), rest)).when(r["all"] == "&nbsp;", F.concat(F.lit("\u00a0"), rest))
            if ended:
                quick = quick.when(~whole, p)
            return quick.when(r["name"] == "", p).when(r["name"].startswith("#"), F.concat(_number(r["name"]), rest)).otherwise(F.coalesce(known, short, p))

        return F.when(p.startswith("&"), let(parts, decoded)).otherwise(p)

    return let(text, lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "(?=&)"), piece), "")).otherwise(t))


def _clean(text: Column, ended: bool) -> Column:
    """References decoded, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(decode_entities(text, ended=ended), SPACES, " "))


def title(html: Column, ended: bool = False) -> Column:
    """The text of the first title element; empty if there is none. `ended`: see decode_entities."""
    return F.coalesce(_clean(F.regexp_extract(F.regexp_replace(html, HIDDEN, ""), TITLE, 1), ended), F.lit(""))


def body_text(html: Column, ended: bool = False) -> Column:
    """The text of the body (of all, without head and titles, if no body tag is there): no scripts, styles, templates or comments.

    Scripts and the like that are never closed reach to the end. A > in a quoted attribute ends no tag.
    `ended`: see decode_entities.
    """
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), TITLE, " ")
    text = F.regexp_replace(text, HEAD, " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b{ATTRIBUTES}(?:>|\z)", " ")
    return F.coalesce(_clean(F.regexp_replace(text, TAG, ""), ended), F.lit(""))


def _href(tag: Column) -> Column:
    """The value of a tag's href, decoded and trimmed; null if it has none."""
    return let(F.regexp_extract(tag, HREF, 1), lambda x: F.when(x != "", F.trim(decode_entities(F.regexp_replace(x, "^[\"']|[\"']$", ""), attribute=True))))


def links(html: Column, base: Column) -> Column:
    """The distinct absolute targets of a[href], without blank, script, mail and telephone links and unreadable ones.

    They are resolved against the first base[href], which is itself resolved against `base`, if there is one.
    """
    def targets(text: Column) -> Column:
        own = _href(F.regexp_extract(text, rf"(?is)<base[\s/]{ATTRIBUTES}>", 0))
        start = F.coalesce(F.when(own != "", U.resolve(own, base)), base)
        found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)<a[\s/]{ATTRIBUTES}>"), F.lit(0)), _href)
        found = F.filter(found, lambda x: (x != "") & ~x.rlike(r"(?i)^(javascript|mailto|tel):"))
        return let(start, lambda b: F.transform(found, lambda x: U.resolve(x, b)))

    found = let(F.regexp_replace(html, HIDDEN, ""), targets)
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def content_type(headers: Column) -> Column:
    """The first value of the header named content-type in any case; empty if there is none. headers: map of arrays."""
    own = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "content-type"))
    return F.coalesce(F.get(F.get(own, F.lit(0)), F.lit(0)), F.lit(""))


def flat_headers(headers: Column) -> Column:
    """Each header's values joined by a comma and a space; none: empty."""
    return F.transform_values(headers, lambda k, v: F.coalesce(F.array_join(v, ", "), F.lit("")))


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def _has(content: Column, what: str) -> Column:
    return F.coalesce(F.lower(content).contains(what), F.lit(False))


def is_html(content: Column) -> Column:
    return _has(content, "text/html")


def is_xml(content: Column) -> Column:
    return _has(content, "xml")


def is_json(content: Column) -> Column:
    return _has(content, "json")
