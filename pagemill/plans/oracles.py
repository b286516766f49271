"""The same answers as plain SQL over the given tables, written independently."""

from __future__ import annotations

# The characters that go to each provider.
CONTEXT = {"mistral": 96_000, "openai": 300_000, "groq": 24_000, "gemini": 300_000, "ollama": 24_000, "other": 96_000}
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{PARTS}', {group})"


def norm(url: str) -> str:
    return f"rtrim(regexp_replace({url}, '#.*$', ''), '/')"


def domain(url: str) -> str:
    return f"({part(url, 1)} || '://' || {part(url, 2)})"


def directory(path: str) -> str:
    return f"(case when {path} = '' then '/' else regexp_replace({path}, '[^/]*$', '') end)"


# File endings of links that are no pages.
ASSET = r"(?i)\.(jpg|jpeg|png|gif|svg|webp|ico|pdf|zip|tar|gz|mp3|mp4|avi|mov|exe|dmg|css|js|woff|woff2|ttf|eot)$"


def junk(url: str) -> str:
    return (
        f"({part(url, 1)} not like 'http%' or regexp_matches({part(url, 3)}, '{ASSET}') "
        f"or ({part(url, 2)} = '' and {part(url, 3)} = ''))"
    )


BASE = f"""
    select page_id, url, {domain('url')} as origin, {part('url', 1)} as scheme, {part('url', 2)} as host,
           {part('url', 3)} as path, {part('url', 4)} as query, {norm('url')} as norm, html
    from pages
"""

# ---- links ----------------------------------------------------------------------------

HREFS = r"""
    select page_id, url, unnest(l) as link, generate_subscripts(l, 1) - 1 as pos
    from (select page_id, url,
                 list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1),
                                lambda x: replace(replace(x, '&quot;', '"'), '&amp;', '&')) as l
          from pages)
"""
# every href of the pages is rooted; an empty fragment or query at its end vanishes
TARGET = r"regexp_replace(regexp_replace(link, '#$', ''), '\?(#|$)', '\1')"
RESOLVED = f"select page_id, url, pos, {domain('url')} || {TARGET} as target from ({HREFS})"

RESOLVE_FORMS = [
    "origin || '/x/y'",
    "origin || dir || 'p'",
    "origin || dir || 'p'",
    "origin || regexp_replace(dir, '[^/]+/$', '') || 'p'",
    "origin || '/p'",
    "origin || path || '?q=1'",
    "origin || path || case when query = '' then '' else '?' || query end || '#f'",
    "scheme || '://h.example/p'",
    "'mailto:x@y'",
    "url",
    "origin || dir || 'a/c'",
    "'ftp://h.example/a/../b'",
]

CANDIDATE_FORMS = [
    "url", "url || '.pdf'", "origin || '/a.JPG?x=1'", "origin || '/a?x=.jpg'", "origin || '/a.jpg/b'",
    "origin || '/f.woff2'", "'mailto:x@' || host", "'javascript:void(0)'", "'ftp://' || host || '/x'",
    "'http:'", "origin", "'https://www.' || host || '/en/1'", "origin || ':8080/en/1'",
    "origin || '/en/1'", "origin || '/En/1'",
]


def exploded(forms: list[str], source: str, name: str, position: str = "form") -> str:
    listed = "[" + ", ".join(forms) + "]"
    return (
        f"select * exclude (l), unnest(l) as {name}, generate_subscripts(l, 1) - 1 as {position} "
        f"from (select *, {listed} as l from ({source}))"
    )


CANDIDATES = exploded(CANDIDATE_FORMS, BASE, "target")
SAME_HOST = f"{part('target', 2)} = host"
SAME_DIR = f"{SAME_HOST} and starts_with({part('target', 3)}, {directory('path')})"
VISITED_HALF = f"select {norm('url')} as norm from pages where page_id % 2 = 0"


def scoped(condition: str) -> str:
    return f"select page_id, form, target from ({CANDIDATES}) where not {junk('target')} and {condition}"


# ---- text -----------------------------------------------------------------------------

VISIBLE = r"html"
for _pattern in (
    r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>",
    r"(?is)<head>.*?</head>",
):
    VISIBLE = f"regexp_replace({VISIBLE}, '{_pattern}', '', 'g')"
VISIBLE = rf"regexp_replace({VISIBLE}, '\s+', ' ', 'g')"


def entities(text: str) -> str:
    for name, value in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{value}')"
    return text


_BLOCKS = (
    r"(?i)</?(?:p|div|h1|ul|li|br|article|footer|nav|body|html)\b[^>]*>"
)
_TAGS = r"<[/!?A-Za-z][^>]*>"
TEXT = entities(
    rf"regexp_replace(regexp_replace({VISIBLE}, '{_BLOCKS}', chr(10), 'g'), '{_TAGS}', '', 'g')"
)
TEXT = rf"regexp_replace(regexp_replace({TEXT}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
TEXT = f"trim({TEXT}, ' ' || chr(10))"

MARKDOWN = VISIBLE
for _pattern, _new in (
    (r'(?i)<a\s[^>]*?href\s*=\s*"([^"#][^"]*)"[^>]*>(.*?)</a\s*>', r"'[\2](\1)'"),
    (r"(?i)<h1\b[^>]*> ?", "chr(10) || chr(10) || '# '"),
    (r"(?i)</?(?:p|div|ul)\b[^>]*>|</h1>", "chr(10) || chr(10)"),
    (r"(?i)<li\b[^>]*> ?", "chr(10) || chr(3)"),
    (r"(?i)<br\b[^>]*>", "chr(2) || chr(10)"),
    (r"(?i)</?b(?:\s[^>]*)?>", "'**'"),
):
    MARKDOWN = f"regexp_replace({MARKDOWN}, '{_pattern}', {_new}, 'g')"
MARKDOWN = entities(f"regexp_replace({MARKDOWN}, '{_TAGS}', '', 'g')")
MARKDOWN = rf"regexp_replace(regexp_replace({MARKDOWN}, ' *(\x02?\n) *', '\1', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
MARKDOWN = f"trim(replace(replace({MARKDOWN}, chr(3), '  * '), chr(2), '  '), ' ' || chr(10))"

HEADING = r"""trim(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&'))"""
LINKS = rf"len(regexp_extract_all({VISIBLE}, '<a\s[^>]*?href=.(/)'))"


def context() -> str:
    parts = []
    for provider, chars in CONTEXT.items():
        parts.append(
            f"select doc_id, '{provider}' as provider, md5(substr(text, 1, {chars})) as digest, "
            f"length(text) > {chars} as truncated from documents"
        )
    return " union all ".join(parts)


# ---- robots ---------------------------------------------------------------------------


def allowed(url: str) -> str:
    """The two robots texts of the inputs, decided by hand."""
    tail = f"regexp_replace({url}, '^[^:]+://[^/?#]*', '')"
    return f"""case length({domain(url)}) % 3
        when 1 then not ((starts_with({tail}, '/en/') and not starts_with({tail}, '/en/1'))
                         or starts_with({tail}, '/The'))
        when 2 then not starts_with({tail}, '/de/')
        else true end"""


# ---- sitemaps -------------------------------------------------------------------------

SITEMAP_ROWS = exploded(
    ["url", "url || '&a=1'", "url || '/z'"],
    "select page_id, url, case when page_id % 5 = 3 then 'sitemap' else 'page' end as kind "
    "from pages where page_id % 5 <> 4",
    "loc", "pos",
)

# ---- page results ---------------------------------------------------------------------

_RESULT = """select *, (l_orderkey * 7 + l_linenumber) % 12 as shape,
    'https://shop.example/' || l_orderkey || '/' || l_linenumber as source_url, l_linenumber % 3 as depth
    from lineitem"""

# shape -> rows of (position, part, price, value)
SHAPE_ROWS = {
    0: [("l_partkey", "l_extendedprice", "null"), ("l_suppkey", "l_quantity", "null")],
    1: [("l_partkey", "l_extendedprice", "null")],
    2: [("null", "null", "null")],
    3: [("null", "null", "null")],
    4: [("null", "null", "l_partkey::varchar"), ("null", "null", "l_suppkey::varchar")],
    5: [],
    6: [("null", "null", "null")],
    7: [("null", "null", "l_linestatus || ' [1]'")],
    8: [("null", "null", "l_quantity::bigint::varchar || '.5'")],
    9: [],
    10: [("l_partkey", "null", "null")],
    11: [("l_partkey", "null", "null"), ("null", "null", "'x'"), ("null", "null", "null")],
}
WHOLE_OBJECT = [("null", "null", "null")]


def items(shape_rows: dict[int, list[tuple[str, str, str]]]) -> str:
    parts = []
    for shape, rows in shape_rows.items():
        for pos, (p, price, value) in enumerate(rows):
            parts.append(
                f"select l_orderkey, l_linenumber, shape, source_url, depth, {pos} as item_pos, "
                f"({p})::bigint as part, ({price})::double as price, ({value})::varchar as value, "
                f"l_partkey, l_suppkey, l_extendedprice, l_returnflag "
                f"from r where shape = {shape}"
            )
    return f"(with r as ({_RESULT}) " + " union all ".join(parts) + ")"


UNWRAPPED = items(SHAPE_ROWS)
API = items({**SHAPE_ROWS, 0: WHOLE_OBJECT, 5: WHOLE_OBJECT})

# ---- crawl ----------------------------------------------------------------------------

_FIRST_PAGES = f"""
    select page_id, url, norm, html from (
        select *, row_number() over (partition by norm order by page_id) as rn
        from (select page_id, url, html, {norm('url')} as norm from pages)) where rn = 1
"""
_HOST_SEEDS = f"""
    select min(page_id) as seed_ord, arg_min(url, page_id) as seed from pages group by {part('url', 2)}
"""


def tree_crawl(depth: int, cap: int | None = None) -> str:
    """Levels unrolled: the tree input, external scope, first request in queue order wins."""
    ctes = [
        f"first_pages as ({_FIRST_PAGES})",
        f"own as (select page_id, pos, {domain('url')} || {TARGET} as target from ({HREFS}))",
        """tree as (
            select a.page_id, a.n + k.k as pos, b.url as target
            from (select page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href')) as n from pages) a,
                 (values (0), (1), (2)) k(k), pages b
            where b.page_id = case k.k when 0 then 2 * a.page_id + 1 when 1 then 2 * a.page_id + 2
                              else a.page_id // 2 end)""",
        # absent tree links leave no gap in document order
        """tree_pos as (
            select t.page_id, n.n + row_number() over (partition by t.page_id order by t.pos) - 1 as pos, target
            from tree t join (select page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href')) as n
                              from pages) n using (page_id))""",
        f"""edges as (
            select e.page_id, e.pos, e.target, {norm('target')} as norm
            from (select * from own union all select * from tree_pos) e where not {junk('target')})""",
        f"""f0 as (
            select {norm('seed')} as norm, seed as url, seed, null::varchar as parent, [0, seed_ord, 0]::bigint[] as rank
            from ({_HOST_SEEDS}))""",
    ]
    visited = "select norm from v0"
    for d in range(depth + 1):
        limit = ""
        if cap is not None:
            spent = " + ".join(["0"] + [f"(select count(*) from v{i})" for i in range(d)])
            limit = f"where place <= {cap} - ({spent})"
        unseen = "" if d == 0 else f"where norm not in ({visited})"
        ctes.append(
            f"""v{d} as (
            select * exclude (place) from (
                select w.*, row_number() over (order by rank) as place from (
                    select f.norm, f.url, f.seed, {d} as depth, f.rank, f.parent, p.page_id,
                           case when p.page_id is null then 'fetch_failed' else 'ok' end as status
                    from (select *, row_number() over (partition by norm order by rank) as rn from f{d} {unseen}) f
                    left join first_pages p using (norm) where rn = 1) w) {limit})"""
        )
        if d < depth:
            if d > 0:
                visited += f" union all select norm from v{d}"
            ctes.append(
                f"""f{d + 1} as (
                select e.norm, e.target as url, v.seed, v.url as parent, list_append(v.rank, e.pos)::bigint[] as rank
                from v{d} v join edges e on e.page_id = v.page_id where v.status = 'ok')"""
            )
    return "with " + ", ".join(ctes) + " " + " union all ".join(
        f"select norm, url, seed, depth, parent, page_id, status from v{d}" for d in range(depth + 1)
    )


def _robots_status(alias: str) -> str:
    return (
        f"case when not ({allowed(alias + '.url')}) then 'robots_blocked' "
        "when p.page_id is null then 'fetch_failed' else 'ok' end"
    )


CRAWL_ROBOTS = f"""
with first_pages as ({_FIRST_PAGES}),
site_seed as (
    select {domain('url')} as site, min(page_id) as seed_ord, arg_min(url, page_id) as seed from pages group by 1),
asked as (
    select {norm('url')} as norm, url, url as seed, [0, page_id, 0]::bigint[] as rank from pages
    union all
    select site || '/s/1', site || '/s/1', seed, [1, seed_ord, 0]::bigint[] from site_seed
    union all
    select site || '/s/2', site || '/s/2/#x', seed, [1, seed_ord, 1]::bigint[] from site_seed),
v0 as (
    select f.norm, f.url, f.seed, 0 as depth, null::varchar as parent, f.rank, p.page_id, {_robots_status('f')} as status
    from (select *, row_number() over (partition by norm order by rank) as rn from asked) f
    left join first_pages p using (norm) where rn = 1),
f1 as (
    select {norm('e.target')} as norm, e.target as url, v.seed, v.url as parent,
           list_append(v.rank, e.pos)::bigint[] as rank
    from v0 v join ({RESOLVED}) e on e.page_id = v.page_id
    where v.status = 'ok' and not {junk('e.target')} and {part('e.target', 2)} = {part('v.seed', 2)}),
v1 as (
    select f.norm, f.url, f.seed, 1 as depth, f.parent, f.rank, p.page_id, {_robots_status('f')} as status
    from (select *, row_number() over (partition by norm order by rank) as rn from f1
          where norm not in (select norm from v0)) f
    left join first_pages p using (norm) where rn = 1)
select norm, url, seed, depth, parent, case when status = 'robots_blocked' then null else page_id end as page_id, status
from (select * from v0 union all select * from v1)
"""

EXPORTED = """
    select o_orderkey, case when o_orderkey % 4 <> 0 then o_totalprice end as price,
           o_orderpriority || ', "é" | ' || o_orderstatus as note,
           '[' || o_custkey || ',' || o_orderkey || ']' as tags, o_orderstatus as status
    from orders
"""
RUN_LOG = """select page_id, url, case page_id % 10 when 0 then 'robots_blocked' when 1 then 'fetch_failed'
    when 2 then 'extract_failed' else 'ok' end as status from pages"""


# Counts and positions that are INT on the Spark side and BIGINT in DuckDB.
INT_COLUMNS = {
    "pos": "sitemap_urls sitemap_cap page_links links_resolved onclick_links link_union",
    "form": "url_normalize url_resolve seed_directory junk_filter scope_same_domain scope_same_directory "
            "scope_external depth_filter follow_test robots_allowed robots_long_lists",
    "depth": "depth_filter follow_test",
    "n_chars": "page_scan cache_write",
    "cached_chars": "cache_lookup",
    "links": "link_null_safe",
}


def oracle_sql(crawl_depth: int, crawl_cap: int) -> dict[str, str]:
    """Oracle SQL by query name, with the column types of the Spark side."""
    found = _plain_sql(crawl_depth, crawl_cap)
    for column, names in INT_COLUMNS.items():
        for name in names.split():
            found[name] = f"select * replace ({column}::int as {column}) from ({found[name]})"
    return found


def _plain_sql(crawl_depth: int, crawl_cap: int) -> dict[str, str]:
    fields = "item_pos, part, price, value"
    return {
        # sources
        "seed_list": "select page_id as seed_ord, url as seed from pages where page_id % 5 <> 0 and page_id % 7 <> 0",
        "page_scan": f"""
            with p as ({_FIRST_PAGES}), a as (
                select distinct norm as url from (select norm from p union all select norm || '/missing' from p))
            select a.url, p.page_id, length(p.html) as n_chars, p.page_id is not null as fetched
            from a left join p on p.norm = a.url""",
        "sitemap_urls": f"select page_id, kind, pos, loc from ({SITEMAP_ROWS})",
        "sitemap_cap": f"select page_id, kind, pos, loc from ({SITEMAP_ROWS}) where pos < 2",
        "sitemap_address": f"select page_id, {domain('url')} || '/sitemap.xml' as address from pages",
        "robots_rules": f"""
            select domain, v.rule_no, v.allow, v.prefix
            from (select distinct {domain('url')} as domain from pages) d
            join (values (1, 0, true, '/en/1'), (1, 1, false, '/en/'), (1, 2, false, '/The'),
                         (2, 0, false, '/de/'), (2, 1, true, '/')) v(k, rule_no, allow, prefix)
              on length(domain) % 3 = v.k""",
        "cache_lookup": f"""
            with c as (select substr(sha256(url), 1, 16) as url_key, any_value(length({TEXT})) as n
                       from pages where page_id % 3 = 0 and {TEXT} <> '' group by 1)
            select page_id, substr(sha256(url), 1, 16) as url_key, c.n is not null as hit, c.n as cached_chars
            from pages p left join c on c.url_key = substr(sha256(p.url), 1, 16)""",
        "cache_write": f"select substr(sha256(url), 1, 16) as url_key, url, length({TEXT}) as n_chars from pages where {TEXT} <> ''",
        "cache_size": "select count(distinct url) as cached_pages from pages",
        # URL expressions
        "url_normalize": "select page_id, form, case when contains(raw, '#') then regexp_extract(lower(raw), '^[a-z]+:') "
            "|| regexp_replace(" + norm("raw") + ", '^[A-Za-z]+:', '') else " + norm("raw") + " end as norm from ("
            + exploded(["url", "url || '//'", "url || '#frag'", "upper(url)"], "select page_id, url from pages", "raw")
            + ")",
        "url_parts": f"""
            select page_id, {part('url', 1)} as scheme, {part('url', 2)} as netloc, {part('url', 3)} as path,
                   {part('url', 4)} as query, {part('url', 5)} as fragment, {domain('url')} as domain from pages""",
        "url_resolve": "select page_id, form, target from (" + exploded(
            RESOLVE_FORMS, f"select *, {directory('path')} as dir from ({BASE})", "target") + ")",
        "seed_directory": f"select page_id, form, {directory(part('u', 3))} as directory from (" + exploded(
            ["url", "origin", "url || '/d/'"], BASE, "u") + ")",
        "url_key": "select page_id, substr(sha256(url), 1, 16) as url_key from pages",
        # text
        "page_text": f"select page_id, {TEXT} as text from pages",
        "page_markdown": f"select page_id, {MARKDOWN} as markdown from pages",
        "markdown_structures": """
            select page_id, 'numbered' as form, url || chr(10) || chr(10) || '  3. ' || url || chr(10) || '  4. b'
                   || chr(10) || chr(10) || 'end' as markdown from pages
            union all select page_id, 'nested', concat_ws(chr(10), 't', '', '  * ' || url, '    1. x', '    2. ' || url,
                   '      * y', '  * z') from pages
            union all select page_id, 'quoted', concat_ws(chr(10), '> ' || url, '> ', '>> in', '> ', '> ' || url, '', 'out')
            from pages
            union all select page_id, 'preformatted', concat_ws(chr(10), 'a b', '', '    x  =  1', '        ' || url, '    ',
                   '    y', '', url) from pages
            union all select page_id, 'table', concat_ws(chr(10), url || ' | k', '---|---', '1 | ' || url) from pages""",
        "blank_markdown": f"""
            select page_id, form, form > 0 or {TEXT} = '' as blank, form > 0 or {TEXT} = '' as blank_page
            from pages, (values (0), (1), (2)) f(form)""",
        "context_truncate": context(),
        # links
        "page_links": f"select page_id, pos, link from ({HREFS})",
        "links_resolved": f"select page_id, pos, target from ({RESOLVED})",
        "onclick_links": "select page_id, pos, link from ("
            + exploded(["url", "'next.html'"], "select page_id, url from pages", "link", "pos") + ")",
        "link_union": f"""
            with n as (select page_id, count(*) as n from ({HREFS}) group by 1)
            select page_id, pos, target from ({RESOLVED})
            union all select page_id, coalesce(n, 0) as pos, url from pages left join n using (page_id)
            union all select page_id, coalesce(n, 0) + 1, origin || {directory('path')} || 'next.html'
            from ({BASE}) left join n using (page_id)""",
        "link_null_safe": f"""
            select page_id, case when page_id % 2 = 0 then coalesce(n, 0) else 0 end as links
            from pages left join (select page_id, count(*) as n from ({HREFS}) group by 1) using (page_id)""",
        "links_per_page": f"""
            select url, count(*) as links, count(*) filter (where not {junk('target')}) as followed
            from ({RESOLVED}) group by url""",
        "in_scope_links": f"""
            select r.url as seed, count(*) as links, count(distinct target) as distinct_links
            from ({RESOLVED}) r join ({_HOST_SEEDS}) s on s.seed_ord = r.page_id
            where not {junk('target')} group by 1""",
        # filters
        "junk_filter": f"select page_id, form, {junk('target')} as junk from ({CANDIDATES})",
        "scope_same_domain": scoped(SAME_HOST),
        "scope_same_directory": scoped(SAME_DIR),
        "scope_external": scoped("true"),
        "depth_filter": f"""
            select page_id, form, page_id % 4 as depth from ({CANDIDATES})
            where not {junk('target')} and page_id % 4 <= 2""",
        "unvisited": f"""
            select page_id, {norm('url')} as norm from pages where {norm('url')} not in ({VISITED_HALF})""",
        "follow_test": f"""
            select page_id, form, page_id % 4 as depth, {norm('target')} as norm from ({CANDIDATES})
            where not {junk('target')} and page_id % 4 <= 2 and {SAME_DIR}
              and {norm('target')} not in ({VISITED_HALF})""",
        "robots_allowed": f"select page_id, form, {allowed('u')} as allowed from (" + exploded(
            ["url", "origin || '/The'", "origin || '/en/1x'", "origin"],
            BASE, "u") + ")",
        "robots_long_lists": f"""
            with asked as (select page_id, form, u, {domain('u')} as domain from ({exploded(
                ["url", "origin || '/en/' || page_id", "url || '/' || page_id"], BASE, "u")})),
            rules as (
                select 0 as short, i as rule_no, i % 3 = 0 as allow, '/en/' || (i * 7 % 1500) as prefix from range(2000) r(i)
                union all values (0, 2000, false, '/en/1'), (1, 0, true, '/en/1'), (1, 1, false, '/en/'), (1, 2, false, '/The'))
            select page_id, form, coalesce(arg_min(allow, rule_no), true) as allowed
            from asked left join rules
              on short = (length(domain) % 3 = 0)::int and starts_with(substr(u, length(domain) + 1), prefix)
            group by 1, 2""",
        "robots_off": "select page_id, true as allowed from pages",
        "domains_checked_count": f"select count(distinct {domain('url')}) as domains_checked from pages",
        "result_split": """
            select case when l_linenumber in (4, 5) then 'failed' else 'result' end as state, count(*) as pages
            from lineitem group by 1""",
        # deduplication, unions
        "distinct_pages": f"""
            select {norm('url')} as norm, min(page_id) as page_id, arg_min(url, page_id) as url from (
                select page_id, url from pages
                union all select page_id + 1000000000, url || '/' from pages) group by 1""",
        "seed_union": f"""
            with site_seed as (
                select {domain('url')} as site, min(page_id) as seed_ord, arg_min(url, page_id) as seed
                from pages group by 1),
            asked as (
                select {norm('url')} as norm, url, url as seed, 0 as later, page_id as o, 0 as pos from pages
                union all select site || '/s/1', site || '/s/1', seed, 1, seed_ord, 0 from site_seed
                union all select site || '/s/2', site || '/s/2/#x', seed, 1, seed_ord, 1 from site_seed)
            select norm, url, seed from (
                select *, row_number() over (partition by norm order by later, o, pos) as rn from asked)
            where rn = 1 and norm not in ({VISITED_HALF})""",
        "visited_union": f"select distinct {norm('url')} as norm from pages",
        "row_union": """
            select o_orderkey as key, o_totalprice as total, null::varchar as name from orders
            union all select c_custkey, null, c_name from customer""",
        # crawl
        "crawl_expand": tree_crawl(crawl_depth),
        "crawl_deeper": tree_crawl(crawl_depth),
        "crawl_frontier_sizes":
            f"select depth, count(*) as pages from ({tree_crawl(crawl_depth)}) group by depth",
        "crawl_cap": tree_crawl(crawl_depth, crawl_cap),
        "crawl_robots": CRAWL_ROBOTS,
        "resume_state": f"""
            with a as (select distinct {norm('seed')} as norm from ({_HOST_SEEDS}))
            select 1 as run, norm, 'ok' as status from a
            union all select distinct 2, {norm('url')}, 'ok' from pages where {norm('url')} not in (select norm from a)""",
        # extraction
        "extract_long_pages": """
            select doc_id, (length(text) + 999) // 1000 as windows,
                   array_to_string(list_transform(range(1, length(text) + 1, 1000), lambda x: least(1000, length(text) - x + 1)), ',') as sizes
            from documents""",
        "job_resume": f"""
            with p as (select page_id, url, {norm('url')} as norm, {HEADING} as title, {LINKS} as links from pages)
            select arg_min(title, page_id) as title, arg_min(links, page_id) as links,
                   coalesce(arg_min(url, page_id) filter (page_id % 2 = 0), arg_min(url, page_id)) as url, 0 as depth
            from p group by norm""",
        "cache_rerun": f"""
            select substr(sha256(u), 1, 16) as url_key, u as url, true as stored
            from (select arg_min(url, page_id) as u from pages group by {norm('url')})""",
        "extract_pages": f"""
            select url, 0 as depth, 2 as attempts, {HEADING} as title, {LINKS} as links from pages""",
        "typed_output": f"""
            select part, price, case when shape in (4, 8) then value::double end as value,
                   shape = 7 or (shape = 11 and item_pos = 1) as corrupt, item_pos, source_url
            from {UNWRAPPED}""",
        "typed_json_schema": f"""
            select case when shape = 3 then l_extendedprice end as total, case when shape = 3 then l_orderkey end as key,
                   case when shape = 3 then l_returnflag end as flag, false as corrupt, source_url
            from {UNWRAPPED}""",
        # flattening
        "flatten_records": f"select source_url as _source_url, depth as _crawl_depth, {fields} from {UNWRAPPED}",
        "flatten_defaults": f"select '' as _source_url, 0 as _crawl_depth, count(*) as rows from {UNWRAPPED}",
        "flatten_api": f"select l_orderkey, l_linenumber, {fields} from {API}",
        "flatten_preview": f"select l_orderkey, l_linenumber, {fields} from {UNWRAPPED}",
        "list_value_count": f"""
            select l_orderkey, l_linenumber, case shape when 0 then 1 when 2 then 2 when 5 then 1 else 0 end
                as list_values from ({_RESULT})""",
        "normalize_columns": f"""
            select case when shape = 2 then l_partkey::varchar end as a,
                   case when shape = 2 then l_suppkey::varchar end as b,
                   case when shape = 3 then l_returnflag end as "order.flag",
                   case when shape = 3 then l_orderkey end as "order.key",
                   part, price, case when shape = 3 then l_extendedprice end as total, value,
                   source_url as _source_url, depth as _crawl_depth
            from {UNWRAPPED}""",
        "normalize_mixed_case": """
            select o_orderkey as first, o_orderstatus as second, o_custkey as nested, o_orderkey as dotted,
                   '1' || lpad(o_orderkey::varchar, 19, '0') as big
            from orders""",
        "normalize_odd_keys": """
            select o_custkey as empty, o_orderstatus as status, o_orderkey as nested, o_orderkey as quoted,
                   case when o_orderkey % 2 = 0 then o_orderkey::varchar else '{"x":1}' end as mixed, '{}' as none,
                   o_orderkey::varchar as list, o_orderkey + 0.5::double as total
            from orders""",
        "key_discovery": """
            select * from (values ('_source_url', 'string'), ('a', 'array<bigint>'), ('b', 'array<bigint>'),
                ('order.flag', 'string'), ('order.key', 'bigint'), ('part', 'bigint'), ('price', 'double'),
                ('total', 'double'), ('value', 'string')) v(name, type)""",
        # sinks
        "sink_json": EXPORTED, "sink_csv": EXPORTED, "sink_xml": EXPORTED,
        "sink_table": EXPORTED, "sink_two_tables": EXPORTED, "sink_markdown": EXPORTED,
        "empty_sentinel": "select null::bigint as o_orderkey, true as _empty",
        "sentinel_not_needed": "select o_orderkey, null::boolean as _empty from orders",
        # reports
        "run_summary": f"""
            select count(*) filter (where status = 'ok') as pages_scraped,
                   count(*) filter (where status like '%failed') as pages_failed,
                   12.35::double as elapsed_seconds, 'out/data.json' as output_path from ({RUN_LOG})""",
        "summary_file": f"""
            with c as (select count(*) filter (where status = 'ok') as good,
                              count(*) filter (where status like '%failed') as bad from ({RUN_LOG}))
            select 'Pages crawled:  ' || good as value from c union all select 'Pages failed:   ' || bad from c
            union all select 'Time:           12.4s' union all select 'Output:         out/data.json'
            union all select 'Timestamp:      2024-01-02 03:04:05'""",
        "failed_top5": f"""
            select page_id, url, status from ({RUN_LOG}) where status like '%failed' order by page_id limit 5""",
        "preview": """
            select doc_id, substr(text, 1, 50) as text, substr(lang, 1, 50) as lang,
                   substr(source, 1, 50) as source, n_chars::varchar as n_chars
            from documents order by doc_id limit 8""",
        "rows_not_shown": "select greatest(count(*) - 8, 0) as more_rows from documents",
        # streams
        "stream_dedup": f"select distinct {norm('url')} as norm from pages",
        "stream_resume": f"select distinct {norm('url')} as norm from pages",
        "stream_extract": f"select {HEADING} as title, {LINKS} as links, url, 0 as depth from pages",
        "stream_export_json": f"select {HEADING} as title, {LINKS} as links, url, 0 as depth from pages",
        "schedule_seconds": """
            select o_orderkey, (o_orderkey % 97 + case when o_orderkey % 8 < 4 then 0.5 else 0 end)::double
                   * case o_orderkey % 4 when 0 then 86400 when 1 then 3600 when 2 then 60 else 1 end as seconds
            from orders""",
        "stream_dedup_bounded": f"""
            select distinct {norm('url')} as norm, unnest([0, 302]) as minute from pages
            union all select arg_min(url, page_id) || '/later', 300 from pages
            union all select arg_min(url, page_id) || '/last', 301 from pages""",
        "stream_progress": "select count(*) as pages, 0::bigint as without_html, 12::bigint as batches from pages",
    }
