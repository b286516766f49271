"""Link targets of a page, as arrays in document order."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let
from pagemill.functions.markup import ATTRS, OTHER_ATTRIBUTES, decode_entities, strip_raw
from pagemill.functions.urls import resolve, resolve_all, resolve_with, url_parts

_ATTR_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


_CONTROLS = "".join(map(chr, range(0x21)))
_ANCHOR_HREF_RE = rf"""(?is)<a{OTHER_ATTRIBUTES}\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_replace(tag, rf"(?is)^.*?[\s\"'/]{name}{_ATTR_VALUE}.*$", "$1$2$3")
    return decode_entities(raw)


def _with_attribute(tags: Column, name: str) -> Column:
    has = rf"(?i)[\s\"'/]{name}{_ATTR_VALUE}"
    return F.filter(tags, lambda t: t.rlike(has))


def dom_hrefs(dom: Column) -> Column:
    """``a[href]`` values of markup already free of comments and scripts."""

    def clean(value: Column) -> Column:
        quoted = F.startswith(value, F.lit('"')) | F.startswith(value, F.lit("'"))
        bare = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        href = F.trim(F.translate(bare, "\t\r\n", ""), F.lit(_CONTROLS))
        return F.when(F.contains(href, F.lit("&")), decode_entities(href)).otherwise(href)

    found = F.regexp_extract_all(dom, F.lit(_ANCHOR_HREF_RE), 1)
    return F.coalesce(F.transform(found, clean), _no_strings())


def dom_onclick_targets(dom: Column) -> Column:
    """Quoted strings of ``onclick`` handlers that look like addresses."""

    def targets(code: Column) -> Column:
        quoted = F.regexp_extract_all(code, F.lit(r"""['"]([^'"]+)['"]"""), 1)
        return F.filter(
            quoted,
            lambda q: ~F.contains(q, F.lit(" "))
            & (F.contains(q, F.lit("/")) | q.rlike(r"\.html?$")),
        )

    tags = F.regexp_extract_all(dom, F.lit(rf"(?is)<[a-z]{ATTRS}>"), 0)
    handlers = F.transform(_with_attribute(tags, "onclick"), lambda t: _attribute(t, "onclick"))
    found = F.flatten(F.transform(handlers, targets))
    return F.when(dom.rlike(r"(?i)\bonclick\s*="), found).otherwise(_no_strings())


def base_url(dom: Column, url: Column) -> Column:
    """Address that relative hrefs start from: ``<base href>`` if there is one."""
    tags = F.regexp_extract_all(dom, F.lit(rf"(?is)<base\s{ATTRS}>"), 0)
    first = F.get(_with_attribute(tags, "href"), F.lit(0))
    return F.when(
        dom.rlike(r"(?i)<base\s"), F.coalesce(resolve(url, _attribute(first, "href")), url)
    ).otherwise(url)


def hrefs(html: Column) -> Column:
    """Raw ``a[href]`` values; a page without markup has none."""
    return dom_hrefs(strip_raw(html))


def onclick_targets(html: Column) -> Column:
    return F.coalesce(dom_onclick_targets(strip_raw(html)), _no_strings())


def absolute_hrefs(html: Column, url: Column) -> Column:
    """``a[href]`` values made absolute as a browser does, honouring ``<base>``."""
    return let(strip_raw(html), lambda dom: resolve_all(base_url(dom, url), dom_hrefs(dom)))


@cache
def page_links_of(html: str = "html", url: str = "url") -> Column:
    """``page_links`` over named columns; built once per process, as it has some 500 nodes."""
    return page_links(F.col(html), F.col(url))


def page_links(html: Column, url: Column) -> Column:
    """All link targets of a page, absolute: anchors first, then onclick targets."""

    def starting_from(parts: Column, found: Column) -> Column:
        return F.transform(found, lambda l: F.struct(parts.alias("base"), l.alias("link")))

    def listed(dom: Column) -> Column:
        anchors = let(url_parts(base_url(dom, url)), lambda b: starting_from(b, dom_hrefs(dom)))
        handlers = let(url_parts(url), lambda b: starting_from(b, dom_onclick_targets(dom)))
        return F.transform(F.concat(anchors, handlers), lambda e: resolve_with(e["base"], e["link"]))

    return F.coalesce(let(strip_raw(html), listed), _no_strings())
