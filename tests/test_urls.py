"""URL expressions against the standard library."""

from urllib.parse import urldefrag, urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import urls

BASES = [
    "http://a/b/c/d;p?q", "http://a", "http://a/", "https://h:8/x/y/", "http://a/b//c",
    "http://a/b?x=1#f", "https://H.com/ä b/c",
]
LINKS = [
    "", "/p", "p", "../p", "./p", "../../../../p", "?q", "#f", "//h/p", "https://h/p", "http:x",
    "http:/x", "mailto:x", "für", "a b", "/a/../b", "/../x", "/..", ".", "..", "./", "../", "/a//b",
    "a//b", "a/./b/../c", "/a?", "/a?#f", "/a#", "x;", "x;y", "/a;?q=1", "a;b/c", "javascript:void(0)",
    "g;x=1/../y", "?", "HTTP://a/b/../c", "HTTPS://Z/x?", "//h/a/../b", "/a?x=../b", "/.a", "/a.b/..c",
    "...", " /lead", "/tab\tin",
]
ODD = [
    "http://x/#top", "http://x///", "http://x?x=/", "http://x/a?#f", "HTTP://X/a;#f", "http://x/a;?q#f",
    "http://x/a;b;#f", "http://X.com/A/", "http://x", "https://x/?a=b/#/", "http://x/a;b/c;d",
]
ASSETS = [
    "http://h/a.PDF", "http://h/a.jpg?x", "http://h/a?x=.jpg", "http://h/a.jpg/b", "http://h/f.woff2",
    "http://h/f.woff", "http:", "mailto:a@b", "tel:1", "data:x", "blob:x", "ftp://h/x", "javascript:x",
    "/rel", "", "https://h", "http://h/a.jpg;v=1", "http://h/x.html", "httpx://h/y",
]


def stdlib_norm(url):
    return urldefrag(url)[0].rstrip("/")


def stdlib_junk(url):
    p = urlparse(url)
    ending = p.path.lower().rsplit(".", 1)[-1] if "." in p.path else ""
    return (
        not p.scheme.startswith("http") or ending in urls.ASSET_EXTENSIONS.split("|")
        or (not p.netloc and not p.path)
    )


def test_resolve_equals_urljoin(apply):
    rows = [(b, l) for b in BASES for l in LINKS]
    assert apply(urls.resolve, rows) == [urljoin(b, l) for b, l in rows]


def test_parts_and_norm_equal_urlparse(apply):
    # white space inside an address is cut by the stdlib parser; links are cleaned when resolved
    found = [u for u in (urljoin(b, l) for b in BASES for l in LINKS) if u.startswith("http")] + ODD
    rows = [(u,) for u in found]
    assert apply(urls.normalize, rows) == [stdlib_norm(u) for u in found]
    assert apply(urls.scheme, rows) == [urlparse(u).scheme for u in found]
    assert apply(urls.netloc, rows) == [urlparse(u).netloc for u in found]
    assert apply(urls.path, rows) == [urlparse(u).path for u in found]
    assert apply(urls.seed_directory, rows) == [urlparse(u).path.rsplit("/", 1)[0] + "/" for u in found]


def test_junk(apply):
    assert apply(urls.is_junk, [(u,) for u in ASSETS]) == [stdlib_junk(u) for u in ASSETS]


SCOPE_CASES = [
    # target, seed, same_domain, same_directory
    ("http://h/a/b", "http://h/a/", True, True),
    ("http://h/b", "http://h/a/", True, False),
    ("http://h/a/b", "http://h/a", True, True),
    ("http://h:80/a", "http://h/a", False, False),
    ("http://www.h/a", "http://h/a", False, False),
    ("http://h", "http://h", True, False),
    ("http://h/", "http://h", True, True),
    ("https://h/docs/x", "http://h/docs/", True, True),
    ("http://H/docs/x", "http://h/docs/", False, False),
]


@pytest.mark.parametrize("scope, column", [("same_domain", 2), ("same_directory", 3)])
def test_scope(apply, scope, column):
    rows = [c[:2] for c in SCOPE_CASES]
    assert apply(lambda t, s: urls.in_scope(t, s, scope), rows) == [c[column] for c in SCOPE_CASES]


def test_external_scope_takes_all_and_unknown_scope_fails(apply):
    rows = [c[:2] for c in SCOPE_CASES]
    assert all(apply(lambda t, s: urls.in_scope(t, s, "external"), rows))
    with pytest.raises(ValueError, match="same_domain"):
        urls.in_scope(F.lit("a"), F.lit("b"), "nowhere")


SEGMENT = st.sampled_from(["a", "b.c", ".", "..", "", "ü", "x y", "d;e", "%20"])
LINK = st.builds(
    lambda lead, segments, tail: lead + "/".join(segments) + tail,
    st.sampled_from(["", "/", "./", "../", "//host/"]),
    st.lists(SEGMENT, max_size=5),
    st.sampled_from(["", "?q=1", "#f", "?q#f", "/"]),
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(BASES), LINK), min_size=60, max_size=120))
def test_resolve_property(apply, rows):
    assert apply(urls.resolve, rows) == [urljoin(b, l) for b, l in rows]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINK.map(lambda l: "http://h/" + l), min_size=30, max_size=60))
def test_normalize_is_idempotent(apply, found):
    once = apply(urls.normalize, [(u,) for u in found])
    assert apply(urls.normalize, [(u,) for u in once]) == once
