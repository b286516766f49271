"""HTML to text and to markdown, as chains of built-in expressions.

Tags are looked at one by one, so unclosed elements cannot swallow a page.  Raw
blocks (comments, scripts, styles) are cut by one alternation, read left to right, so a
comment inside a script or a script inside a comment is handled by whichever opens first.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

_RAW = (
    r"!--.*?(?:-->|\z)"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z)"
)
RAW_RE = rf"(?is)<(?:{_RAW})"
HEAD_RE = r"(?is)<(?:head(?:\s[^>]*)?>.*?(?:</head\s*>|<body\b[^>]*>)|title\b[^>]*>.*?(?:</title\s*>|\z))"
# Raw blocks and the head in one reading; an end tag inside a raw block of the head is skipped.
UNSEEN_RE = (
    rf"(?is)<(?:{_RAW}|head(?:\s[^>]*)?>(?:<(?:{_RAW})|[^<]++|<(?!/head\s*>|body\b))*+"
    r"(?:</head\s*>|<body\b[^>]*>)|title\b[^>]*>.*?(?:</title\s*>|\z))"
)
# The quoted and unquoted attributes of a tag.
ATTRS = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
# Tags, runs of text and stray angle brackets.
TOKEN_RE = rf"(?s)<[/!?A-Za-z]{ATTRS}>|<[/!?A-Za-z][^>]*>|[^<]++|<"
TAG_NAME_RE = r"^<(/?[A-Za-z][^\s/>\x06-\x08]*)"
# Elements that begin and end a line.
BLOCKS = (
    "p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr blockquote pre hr br article section "
    "header footer nav main aside form body html"
).split()
# White space that is not already one plain blank: single blanks are left where they are.
SPACES_RE = r" \s+|[\t\n\x0B\f\r]\s*"
WIDE_SPACES_RE = r" [ \t\u00a0]+|[\t\u00a0][ \t\u00a0]*"
_ENTITY = r"(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

# Context window of each model provider in tokens, three characters per
# token, at most 300,000 characters sent per page.
CONTEXT_TOKENS = {
    "mistral": 32_000,
    "openai": 128_000,
    "groq": 8_000,
    "gemini": 1_000_000,
    "ollama": 8_000,
}
DEFAULT_CONTEXT_TOKENS = 32_000
CHARS_PER_TOKEN = 3
MAX_CONTEXT_CHARS = 300_000


def strip_raw(html: Column) -> Column:
    """Markup without comments, scripts and styles: what a DOM query would see."""
    return F.regexp_replace(html, RAW_RE, "")


def _entity_table() -> Column:
    """Replacement by entity body: the named ones of HTML 4 and the Windows-1252 range."""
    table = {name: chr(code) for name, code in name2codepoint.items()}
    for code in range(0x80, 0xA0):
        table[f"#{code}"] = bytes([code]).decode("cp1252", errors="replace")
    table.update({"amp": "&amp;", "#38": "&amp;", "#x26": "&amp;", "apos": "'", "nbsp": " ", "#160": " "})
    text = "\u0002".join(f"{name}\u0003{value}" for name, value in table.items())
    # one foldable node; a create_map of literals would weigh down every plan it is in
    return F.str_to_map(F.lit(text), F.lit("\u0002"), F.lit("\u0003"))


def _code_point_text(body: Column) -> Column:
    hexed = F.when(
        F.lower(F.substring(body, 2, 1)) == "x", F.substr(body, F.lit(3))
    ).otherwise(F.conv(F.substr(body, F.lit(2)), 10, 16))
    code = F.conv(hexed, 16, 10).cast("bigint")
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("\ufffd")).otherwise(
        F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
    )


def decode_entities(text: Column) -> Column:
    """Replace character references once; ``&amp;`` goes last so nothing decodes twice."""

    def decode_piece(piece: Column, position: Column) -> Column:
        body = F.regexp_extract(piece, rf"^({_ENTITY[:-1]});", 1)
        value = F.coalesce(
            F.element_at(_entity_table(), body),
            F.when(F.startswith(body, F.lit("#")), _code_point_text(body)),
            F.concat(F.lit("&"), body, F.lit(";")),
        )
        return (
            F.when(position == 0, piece)
            .when(F.startswith(piece, F.lit("amp;")) | (body == ""), F.concat(F.lit("&"), piece))
            .otherwise(F.concat(value, F.substr(piece, F.length(body) + 2)))
        )

    def decode(t: Column) -> Column:
        pieces = F.split(t, "&")
        others = F.contains(F.replace(t, F.lit("&amp;"), F.lit("")), F.lit("&"))
        return F.when(others, F.array_join(F.transform(pieces, decode_piece), "")).otherwise(t)

    return F.replace(let(text, decode), F.lit("&amp;"), F.lit("&"))


def _visible(html: Column) -> Column:
    """Body markup with insignificant white space folded to one blank."""
    return F.regexp_replace(F.regexp_replace(html, UNSEEN_RE, ""), SPACES_RE, " ")


def _with_marks(markup: Column, marks: dict[str, str], numbered: str | None = None) -> Column:
    """Text with every tag replaced by its mark, or by nothing.

    The markup is read once into tokens; a pattern per element would read it once each.  An
    ``ol`` becomes ``numbered``, its first number and a semicolon.
    """
    table = F.str_to_map(
        F.lit("\u001e".join(f"{name}\u001f{mark}" for name, mark in marks.items())),
        F.lit("\u001e"), F.lit("\u001f"),
    )

    def mark(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, TAG_NAME_RE, 1))
        is_text = ~F.startswith(token, F.lit("<")) | (token == "<")
        other = F.coalesce(F.element_at(table, name), F.lit(""))
        if numbered is not None:
            first = F.coalesce(F.nullif(F.regexp_extract(token, START_RE, 1), F.lit("")), F.lit("1"))
            other = F.when(name == "ol", F.concat(F.lit(numbered), first, F.lit(";"))).otherwise(other)
        return F.when(is_text, token).otherwise(other)

    tokens = F.regexp_extract_all(markup, F.lit(TOKEN_RE), 0)
    return F.array_join(F.transform(tokens, mark), "")


def page_text(html: Column) -> Column:
    """Plain text, one block per line, no blank lines."""
    marks = {prefix + name: "\n" for name in BLOCKS for prefix in ("", "/")}
    t = decode_entities(_with_marks(_visible(html), marks))
    t = F.regexp_replace(t, WIDE_SPACES_RE, " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.trim(t, F.lit(" \n"))


# Marks that stand for text until blanks around line ends are gone: what follows loses its
# leading blanks, a forced line end, a list item, a table cell.
_TIGHT, _BREAK, _ITEM, _CELL = "\u0001", "\u0002", "\u0003", "\u0004"


def _markdown_marks() -> dict[str, str]:
    """The markdown of each element."""
    marks = {"hr": "\n\n* * *\n\n", "br": f"{_BREAK}\n", "li": f"\n{_ITEM}{_TIGHT}"}
    for level in range(1, 7):
        marks |= {f"h{level}": f"\n\n{'#' * level} {_TIGHT}", f"/h{level}": "\n\n"}
    for name in ("p", "div", "ul", "ol", "dl", "table", "pre"):
        marks |= {name: "\n\n", f"/{name}": "\n\n"}
    marks |= {"blockquote": f"\n\n> {_TIGHT}", "/blockquote": "\n\n"}
    marks |= {"/tr": "\n", "/dt": "\n", "/dd": "\n", "td": _CELL, "th": _CELL}
    inline = {"**": ("b", "strong"), "_": ("i", "em", "u"), "~~": ("s", "strike", "del"), "`": ("code", "kbd", "tt")}
    for sign, names in inline.items():
        marks |= {prefix + name: sign for name in names for prefix in ("", "/")}
    return marks


_VALUE = r"""\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"']++)"""
OTHER_ATTRIBUTES = rf"""(?:\s+(?!href\s*=)[^\s=>"']++(?:{_VALUE})?+)*+"""
_HREF = r"""\s+href\s*=\s*(?:"([^"#][^"]*)"|'([^'#][^']*)'|([^\s>"'#][^\s>"']*))"""
# link text ends at its own end tag and never runs into another anchor
_LINK_TEXT = r"([^<]*+(?:<(?!/?a\b)[^<]*+)*+)"
LINK_RE = rf"(?i)<a{OTHER_ATTRIBUTES}{_HREF}{ATTRS}>{_LINK_TEXT}</a\s*>"


# An element inside another decides what becomes of its text in these.
STRUCTURED_RE = r"(?i)<(?:ol|pre|blockquote|th)[\s>]|<ul[\s>](?:[^<]++|<(?!/?ul[\s>]))*+<ul[\s>]"
START_RE = r"""(?i)\sstart\s*=\s*["']?(-?[0-9]{1,8})"""
# Begins a mark of structure; its letter follows.
_STRUCTURE = "\u0005"
# White space of preformatted text, which nothing folds: line end, blank, tab.
_LINE, _BLANK, _TAB = "\u0006", "\u0007", "\u0008"
# Begin and end of a quotation, begin of an item's text, sign of code, a line end if there is none.
_QUOTE, _UNQUOTE, _LEAD, _CODE, _SOFT = "\u000e", "\u000f", "\u0010", "\u0011", "\u0012"
_BULLET = -(1 << 31)


def page_markdown(html: Column) -> Column:
    """Markdown of the whole page: links kept, images dropped, lines never wrapped.

    Lists are numbered or bulleted and indented by their depth, every line of a quotation has
    its signs, preformatted text keeps its lines, and a table's first row of ``th`` is ruled.
    """

    def convert(page: Column) -> Column:
        return F.when(page.rlike(STRUCTURED_RE), _structured_markdown(page)).otherwise(_flat_markdown(page))

    return let(html, convert)


def _linked(markup: Column) -> Column:
    return F.regexp_replace(markup, LINK_RE, "[$4]($1$2$3)")


def _flat_markdown(html: Column) -> Column:
    """Markdown of a page whose elements can be looked at one by one."""
    t = decode_entities(_with_marks(_linked(_visible(html)), _markdown_marks()))
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, f" *({_BREAK}?\n)[ {_CELL}]*|{_TIGHT} *", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.replace(F.replace(t, F.lit(_BREAK), F.lit("  ")), F.lit(_ITEM), F.lit("  * "))
    return F.trim(_cells(t), F.lit(" \n"))


def _preformatted(html: Column) -> Column:
    """Markup whose white space inside ``pre`` is written as marks, so that it is not folded."""

    def kept(piece: Column) -> Column:
        inside = F.regexp_extract(piece, r"(?is)^(?:(?!</pre[\s>]).)*+", 0)
        after = F.substr(piece, F.length(inside) + 1)
        plain = F.replace(inside, F.lit("\r\n"), F.lit("\n"))
        marked = F.concat(F.translate(plain, "\n\r \t", _LINE + _LINE + _BLANK + _TAB), after)
        return F.when(piece.rlike(r"(?i)^<pre[\s>]"), marked).otherwise(piece)

    pieces = F.split(html, r"(?i)(?=<pre[\s>])")
    joined = F.array_join(F.transform(pieces, kept), "")
    return F.when(html.rlike(r"(?i)<pre[\s>]"), joined).otherwise(html)


def _structure_marks() -> dict[str, str]:
    """The marks of elements that matter to what is inside them or after them."""
    letters = {
        "ul": "u", "/ul": "U", "/ol": "U", "li": "i", "blockquote": "q", "/blockquote": "Q", "pre": "p", "/pre": "P",
        "table": "t", "th": "h", "/tr": "r",
    }
    code = {prefix + name: _CODE for name in ("code", "kbd", "tt") for prefix in ("", "/")}
    return _markdown_marks() | code | {name: _STRUCTURE + letter for name, letter in letters.items()}


def _read_structure(state: Column, part: Column) -> Column:
    """One mark of structure and the text after it: the open lists and the table's row follow, text is put out.

    ``lists`` holds the last number of every open list, ``_BULLET`` for one without numbers.
    """
    op = F.substring(part, 1, 1)
    number = F.regexp_extract(part, "^o(-?[0-9]+);", 1)
    text = F.when(op == "o", F.substr(part, F.length(number) + 3)).otherwise(F.substr(part, F.lit(2)))
    lists, size = state["lists"], F.size(state["lists"])
    last = F.try_element_at(lists, F.lit(-1))
    outer = F.slice(lists, 1, F.greatest(size - 1, F.lit(0)))
    counted = (op == "i") & (last > _BULLET)
    inside = (
        F.when(op == "u", F.array_append(lists, F.lit(_BULLET)))
        .when(op == "o", F.array_append(lists, number.try_cast("int") - 1))
        .when(op == "U", outer)
        .when(counted, F.array_append(outer, last + 1))
        .otherwise(lists)
    )
    pre = (op == "p") | (state["pre"] & (op != "P"))
    cells = F.length(text) - F.length(F.replace(text, F.lit(_CELL), F.lit(""))) + (op == "h").cast("int")
    ends = (op == "r") | (op == "t")
    heads = state["heads"] + (op == "h").cast("int")
    rule = F.when(
        (op == "r") & (state["heads"] > 0) & ~state["ruled"],
        F.concat(F.substr(F.repeat(F.lit("|---"), state["cells"]), F.lit(2)), F.lit("\n")),
    ).otherwise("")
    sign = F.when(counted, F.concat((last + 1).cast("string"), F.lit("."))).otherwise("*")
    item = F.concat(F.lit("\n"), F.repeat(F.lit(_BLANK), 2 * F.greatest(size, F.lit(1))), sign, F.lit(_BLANK + _LEAD))
    before = (
        F.when(op == "i", item)
        .when(op.isin("u", "o"), F.when(size == 0, "\n\n").otherwise(_SOFT))
        .when(op == "U", F.when(size <= 1, "\n\n").otherwise(_SOFT))
        .when(op == "q", f"\n\n{_QUOTE}")
        .when(op == "Q", F.when(state["quotes"] > 0, f"{_UNQUOTE}\n\n").otherwise("\n\n"))
        .when(op == "p", "\n\n" + 4 * _BLANK).when(op.isin("P", "t"), "\n\n")
        .when(op == "h", _CELL).when(op == "r", F.concat(F.lit("\n"), rule))
        .otherwise("")
    )
    shown = F.when(op == "p", F.regexp_replace(text, f"^{_LINE}", "")).otherwise(text)
    indented = F.replace(F.replace(shown, F.lit(_LINE), F.lit(_LINE + 4 * _BLANK)), F.lit(_CODE), F.lit(""))
    return F.struct(
        inside.alias("lists"), pre.alias("pre"),
        F.when(op == "q", state["quotes"] + 1)
        .when(op == "Q", F.greatest(state["quotes"] - 1, F.lit(0))).otherwise(state["quotes"]).alias("quotes"),
        F.when(ends, F.lit(0)).otherwise(heads).alias("heads"),
        F.when(ends, cells).otherwise(state["cells"] + cells).alias("cells"),
        F.when(op == "t", F.lit(False)).otherwise(state["ruled"] | (op == "r")).alias("ruled"),
        F.array_append(state["out"], F.concat(before, F.when(pre, indented).otherwise(shown))).alias("out"),
    )


def _structured_markdown(html: Column) -> Column:
    """Markdown of a page with numbered, nested, quoted or preformatted parts, or header rows.

    Only marks of structure are folded, one after the other; all other tags are looked at one by
    one as in flat pages.
    """
    text = decode_entities(_with_marks(_linked(_visible(_preformatted(html))), _structure_marks(), f"{_STRUCTURE}o"))
    parts = F.split(F.concat(F.lit("-"), F.replace(text, F.lit("\u00a0"), F.lit(" "))), _STRUCTURE)
    start = F.struct(
        F.array().cast("array<int>").alias("lists"), F.lit(False).alias("pre"), F.lit(0).alias("quotes"),
        F.lit(0).alias("heads"), F.lit(0).alias("cells"), F.lit(False).alias("ruled"), F.array().cast("array<string>").alias("out"),
    )
    t = F.aggregate(parts, start, _read_structure, lambda state: F.array_join(state["out"], ""))
    t = F.regexp_replace(t, f" *({_BREAK}?\n)[ {_CELL}]*|{_TIGHT} *", "$1")
    t = F.regexp_replace(t, f" *{_SOFT}[{_SOFT} ]*\n?", "\n")
    t = F.regexp_replace(t, rf"{_LEAD} *(?:\n++(?!{_BLANK}))?", "")
    t = F.regexp_replace(t, rf"({_QUOTE})\s+|\s+({_UNQUOTE})", "$1$2")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, rf"[{_LINE}{_BLANK}{_TAB} ]+(?=[\n{_UNQUOTE}]|$)", "")
    t = F.regexp_replace(F.trim(t, F.lit(" \n")), rf"^{_BLANK}+(?=\*{_BLANK}|-?[0-9]+\.{_BLANK})", "")
    t = F.replace(F.replace(t, F.lit(_BREAK), F.lit("  ")), F.lit(_CODE), F.lit("`"))
    return _quoted(F.translate(_cells(t), _LINE + _BLANK + _TAB, "\n \t"))


def _quoted(text: Column) -> Column:
    """Every line of a quotation with a sign for each quotation that it is in."""

    def count(line: Column, mark: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))

    def read_line(state: Column, line: Column) -> Column:
        depth = state["depth"] + count(line, _QUOTE)
        bare = F.translate(line, _QUOTE + _UNQUOTE, "")
        shown = F.when(depth > 0, F.concat(F.repeat(F.lit(">"), depth), F.lit(" "), bare)).otherwise(bare)
        return F.struct(
            F.greatest(depth - count(line, _UNQUOTE), F.lit(0)).alias("depth"), F.array_append(state["out"], shown).alias("out")
        )

    def mark(t: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
        lines = F.aggregate(F.split(t, "\n"), start, read_line, lambda state: F.array_join(state["out"], "\n"))
        return F.when(F.contains(t, F.lit(_QUOTE)), lines).otherwise(F.replace(t, F.lit(_UNQUOTE), F.lit("")))

    return let(text, mark)


def _cells(text: Column) -> Column:
    def separated(t: Column) -> Column:
        spaced = F.regexp_replace(t, f" *{_CELL} *", " | ")
        return F.when(F.contains(t, F.lit(_CELL)), spaced).otherwise(t)

    return let(text, separated)


def is_blank(text: Column) -> Column:
    """True for null text and for text that is white space only."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\s\u00a0]")


def is_blank_page(html: Column) -> Column:
    """``is_blank(page_markdown(html))``, converting only pages without plain text."""

    def check(dom: Column) -> Column:
        certain = F.regexp_replace(dom, HEAD_RE, "").rlike(r"(?i)</?(?:p|div|h[1-6]|li|b|a|span)\b[^<>]*>[^<>&]*[^<>&\s\u00a0]")
        # whether there is text does not depend on how it is nested
        return F.when(certain, F.lit(False)).otherwise(is_blank(_flat_markdown(dom)))

    return html.isNull() | let(strip_raw(html), check)


def context_chars(provider: str | None = None, max_chars: int | None = None) -> int:
    if max_chars is not None:
        return max_chars
    tokens = CONTEXT_TOKENS.get(provider or "", DEFAULT_CONTEXT_TOKENS)
    return min(tokens * CHARS_PER_TOKEN, MAX_CONTEXT_CHARS)


def windows(text: Column, size: int | None) -> Column:
    """Consecutive parts of at most ``size`` characters; the whole text without a size."""
    if size is None:
        return F.array(text)
    last = F.greatest(F.ceil(F.length(text) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def within_context(
    text: Column, provider: str | None = None, max_chars: int | None = None
) -> Column:
    """The leading part of ``text`` that fits the provider's context window."""
    return F.substring(text, 1, context_chars(provider, max_chars))
