"""URL expressions: parts, normal form, key, resolution, scope and junk tests.

Everything is a ``Column -> Column`` function over built-in expressions.  ``parse_url``
is not used: it throws on spaces and on some non-ASCII addresses under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

# The RFC 3986 appendix B pattern; one pass yields all five parts.
_PARTS_RE = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_SEP = "\u0001"

# File endings that are never pages.
ASSET_EXTENSIONS = (
    "jpg|jpeg|png|gif|svg|webp|ico|pdf|zip|tar|gz|mp3|mp4|avi|mov|exe|dmg|css|js|woff|woff2|ttf|eot"
)
_ASSET_RE = rf"(?i)\.({ASSET_EXTENSIONS})$"

# Schemes a relative link can be resolved within.
_RELATIVE_SCHEMES = ["http", "https", "ftp", "file"]

SCOPES = ("same_domain", "same_directory", "external")


def clean_url(url: Column) -> Column:
    """Drop leading blanks and control characters, and tabs and line breaks anywhere."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def _part_array(url: Column) -> Column:
    joined = F.regexp_replace(url, _PARTS_RE, _SEP.join(f"${i}" for i in range(1, 6)))
    return F.split(joined, _SEP, 5)


def scheme(url: Column) -> Column:
    return F.lower(F.get(_part_array(url), F.lit(0)))


def netloc(url: Column) -> Column:
    return F.get(_part_array(url), F.lit(1))


def path(url: Column) -> Column:
    """The path without the ``;params`` of its last segment."""
    full = F.get(_part_array(url), F.lit(2))
    return F.when(F.contains(full, F.lit(";")), F.regexp_replace(full, r";[^/]*$", "")).otherwise(full)


def url_parts(url: Column) -> Column:
    """``STRUCT<scheme, netloc, path, query, fragment>``; ``path`` keeps its params."""
    return let(
        _part_array(url),
        lambda p: F.struct(
            F.lower(F.get(p, F.lit(0))).alias("scheme"),
            F.get(p, F.lit(1)).alias("netloc"),
            F.get(p, F.lit(2)).alias("path"),
            F.get(p, F.lit(3)).alias("query"),
            F.get(p, F.lit(4)).alias("fragment"),
        ),
    )


def domain_key(url: Column) -> Column:
    """``scheme://netloc``: what robots rules and sitemaps hang on."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def _drop_empty_delimiters(url: Column) -> Column:
    """Drop an empty ``;params`` and an empty ``?query`` from a URL without fragment."""
    no_query = F.regexp_replace(url, r"^([^?]*)\?$", "$1")
    return F.regexp_replace(no_query, r"^((?:[^?]*/)?[^?;/]*);(\?.+)?$", "$1$2")


def _lower_scheme(url: Column) -> Column:
    s = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    return F.concat(F.lower(s), F.substr(url, F.length(s) + 1))


def normalize(url: Column) -> Column:
    """The visit key: no fragment, no trailing slashes; host case and query are kept."""
    bare = _lower_scheme(_drop_empty_delimiters(clean_url(F.substring_index(url, "#", 1))))
    defragged = F.when(F.contains(url, F.lit("#")), bare).otherwise(url)
    return F.rtrim(defragged, F.lit("/"))


def url_key(url: Column) -> Column:
    """Cache key: the first 16 hex digits of the SHA-256 of the raw URL."""
    return F.substring(F.sha2(url, 256), 1, 16)


def seed_directory(url: Column) -> Column:
    """The path up to its last slash; ``/`` when there is no path."""
    p = path(url)
    return (
        F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"[^/]*$", ""))
        .otherwise(F.concat(p, F.lit("/")))
    )


def _has_dots(p: Column) -> Column:
    return p.rlike(r"(^|/)\.\.?(/|$)")


def _fold_dots(segments: Column) -> Column:
    """Remove ``.`` and ``..`` from path segments; a final dot segment leaves a slash."""

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.array_append(acc, seg))
        )

    def close(acc: Column) -> Column:
        ends_in_dot = F.element_at(segments, -1).isin(".", "..")
        joined = F.array_join(F.when(ends_in_dot, F.array_append(acc, F.lit(""))).otherwise(acc), "/")
        return F.when(joined == "", F.lit("/")).otherwise(joined)

    return F.aggregate(segments, F.array().cast("array<string>"), step, close)


def _below(base_path: Column, link_path: Column) -> Column:
    """Relative path placed in the directory of ``base_path``; doubled slashes squeezed."""
    directory = F.regexp_replace(base_path, r"/[^/]*$|^[^/]*$", "")
    return F.regexp_replace(F.concat(directory, F.lit("/"), link_path), r"/{2,}", "/")


def _assemble(b: Column, host: Column, p: Column, query: Column, fragment: Column) -> Column:
    return F.concat(
        b["scheme"], F.lit("://"), host,
        F.when((p == "") | F.startswith(p, F.lit("/")), F.lit("")).otherwise(F.lit("/")), p,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def resolve_with(b: Column, link: Column) -> Column:
    """Resolve ``link`` against already split base parts (see ``url_parts``)."""

    def general(l: Column) -> Column:
        own_host = l["netloc"] != ""
        query_of_base = ~own_host & (l["path"] == "") & (l["query"] == "")

        def with_path(p: Column) -> Column:
            kept = own_host | (l["path"] == "")
            dotless = F.when(~kept & _has_dots(p), let(F.split(p, "/"), _fold_dots)).otherwise(p)
            return let(
                dotless,
                lambda d: _assemble(
                    b,
                    F.when(own_host, l["netloc"]).otherwise(b["netloc"]),
                    d,
                    F.when(query_of_base, b["query"]).otherwise(l["query"]),
                    F.when(link == "", b["fragment"]).otherwise(l["fragment"]),
                ),
            )

        placed = (
            F.when(own_host | F.startswith(l["path"], F.lit("/")), l["path"])
            .when(l["path"] == "", b["path"])
            .otherwise(_below(b["path"], l["path"]))
        )
        foreign = (l["scheme"] != "") & (l["scheme"] != b["scheme"])
        return F.when(foreign | ~b["scheme"].isin(*_RELATIVE_SCHEMES), link).otherwise(
            let(placed, with_path)
        )

    # most links are a plain rooted path: no parsing needed
    plain = link.rlike(r"^/[^/?#;.\t\r\n][^?#;.\t\r\n]*$") & b["scheme"].isin("http", "https")
    return F.when(plain, F.concat(b["scheme"], F.lit("://"), b["netloc"], link)).otherwise(
        let(_link_parts(link), general)
    )


def _link_parts(link: Column) -> Column:
    """``url_parts`` of a link, an empty ``;params`` at the end of its path dropped."""
    return let(
        url_parts(clean_url(link)),
        lambda l: l.withField("path", F.regexp_replace(l["path"], r"^((?:.*/)?[^;/]*);$", "$1")),
    )


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` found on the page at ``base``."""
    return let(url_parts(base), lambda b: resolve_with(b, link))


def resolve_all(base: Column, links: Column) -> Column:
    """``resolve`` over an array of links; the base is split once per row."""
    return let(url_parts(base), lambda b: F.transform(links, lambda l: resolve_with(b, l)))


def is_junk(url: Column) -> Column:
    """True for addresses that are not pages: other schemes, assets, empty addresses."""
    return (
        ~F.startswith(scheme(url), F.lit("http"))
        | path(url).rlike(_ASSET_RE)
        | ((netloc(url) == "") & (path(url) == ""))
    )


def in_scope(url: Column, seed: Column, scope: str) -> Column:
    if scope == "external":
        return F.lit(True)
    same_host = netloc(url) == netloc(seed)
    if scope == "same_domain":
        return same_host
    if scope == "same_directory":
        return same_host & F.startswith(path(url), seed_directory(seed))
    raise ValueError(f"{scope!r} is no scope; there are {', '.join(SCOPES)}")
