"""HTML as blocks of inline markup: a tokenizer and a stack of open elements, as expressions.

Tags are scanned with their quoted attribute values, so a ``>`` in quotes ends no tag.  A
page is cut into structural tags and the runs between them; comments, declarations, scripts
and styles are parts of runs, and taken out where a run has some.  A fold over these tokens
keeps the stack of open elements, which says for every run which element it belongs to, how deep its list is nested, and
which runs and tags make up an outermost table.  All patterns are possessive, so long
pages neither backtrack nor use up the thread's stack.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

# Elements that begin and end blocks, those that show nothing, and those
# whose content is no markup.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
STRUCTURE = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", *HEADINGS, "head", "header", "hgroup", "html",
    "legend", "li", "main", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "template", "tfoot", "th", "thead", "tr", "ul",
)
RAW = ("script", "style")
EMPHASIS = ("b", "strong", "em", "i")
#: Tokens folded at a time: what a block gives is appended once.
FOLD = 256

# Everything up to the end of a tag: a quote counts only as the start of a value.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\z)"""
_NAMES = "|".join(STRUCTURE)
_RAW = "|".join(RAW)
_NAME_ENDS = r"(?=[\s/>])"
_IGNORED = "|".join(
    (
        r"<!--(?s:.*?)(?:-->|\z)",
        r"<[!?][^>]*+(?:>|\z)",
        *(rf"<{n}{_NAME_ENDS}{_REST}(?s:.*?)(?:</{n}\s*+>|\z)" for n in RAW),
        rf"</(?:{_RAW}){_NAME_ENDS}{_REST}",
    )
)
_CLEAN = rf"(?i)(?:{_IGNORED})|(</?[a-z]{_REST})"
_STRUCTURAL = rf"</?(?:{_NAMES}){_NAME_ENDS}{_REST}"
_INLINE = rf"<(?!/?(?:{_NAMES}){_NAME_ENDS})(?:/?[a-z]{_REST})?+"
TOKENS = rf"(?i){_STRUCTURAL}|(?:[^<]++|{_IGNORED}|{_INLINE})++"
_HAS_IGNORED = rf"(?i)<(?:[!?]|/?(?:{_RAW}){_NAME_ENDS})"
_NAME = rf"(?i)^<(/?(?:{_NAMES})){_NAME_ENDS}"
_TAG = rf"(?i)</?[a-z]{_REST}"
_ATTRIBUTE = r"""[^\s=/>"'<]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++))?+"""
# An inline element ends where it is closed, or where a cell or block does in a table.
_ENDS = rf"(?=</?(?:{_NAMES})[\s/>])|\z"
_ANCHOR = rf"(?is)<a(?=\s){_REST}.*?(?:</a\s*+>|{_ENDS})"
_EMPHASIS = "(?is)" + "|".join(rf"<{n}(?=[\s>]){_REST}.*?(?:</{n}\s*+>|{_ENDS})" for n in EMPHASIS)
_IMAGE = rf"(?i)<img(?=[\s/>]){_REST}"

#: Names and characters of all references that end in a semicolon, of the HTML standard.
REFERENCES = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _reference_table() -> Column:
    """A literal map, folded before anything runs."""
    pairs = "\u0001".join(f"{name}\u0002{chars}" for name, chars in REFERENCES.items())
    return F.str_to_map(F.lit(pairs), F.lit("\u0001"), F.lit("\u0002"))


def _numbered(digits: Column) -> Column:
    """The character of a decimal or ``x`` hexadecimal number; NULL where there is none."""
    code = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits)
    code = F.try_to_number(code, F.lit("9999999")).cast("int")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def unescape(col: Column, table: Column | None = None) -> Column:
    """Character references as characters, each once; unknown ones stay as they are.

    ``table`` is the map of names, where an expression that needs it often has bound it.
    """
    table = _reference_table() if table is None else table

    def resolved(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        char = F.when(F.startswith(name, F.lit("#")), _numbered(F.substring(name, 2, 9))).when(name != "", F.try_element_at(table, name))
        rest = F.substr(piece, F.length(name) + 3)
        return F.coalesce(F.concat(char, rest), piece)

    decoded = F.array_join(F.transform(F.split(col, "(?=&)"), resolved), "")
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def plain(markup: Column, table: Column | None = None) -> Column:
    """Text of a fragment: tags to spaces, references to characters, white space collapsed."""
    return F.trim(F.regexp_replace(bind(F.regexp_replace(markup, _TAG, " "), lambda x: unescape(x, table)), r"\s+", " "))


def attribute(tag: Column, name: str, table: Column | None = None) -> Column:
    """An attribute's value, whichever way it is quoted; NULL without one."""
    pairs = F.regexp_extract_all(F.regexp_extract(tag, _TAG, 0), F.lit(_ATTRIBUTE), F.lit(0))
    own = F.get(F.filter(pairs, lambda p: p.rlike(rf"(?i)^{name}\s*+=")), F.lit(0))
    value = F.regexp_replace(own, r"""(?s)^[^=]*+=\s*+(?:"(.*)"|'(.*)'|(.*))$""", "$1$2$3")
    return bind(value, lambda v: unescape(v, table))


def _cut(stack: Column, name: Column) -> Column:
    """The stack without the last ``name`` and what is open in it."""
    opened = F.concat(F.lit(">"), name, F.lit(">"))
    inside = F.call_function("substring_index", stack, opened, F.lit(-1))
    rest = F.substr(stack, F.lit(1), F.length(stack) - F.length(inside) - F.length(opened) + 1)
    return F.when(F.contains(stack, opened), rest).otherwise(stack)


def _cut_any(stack: Column, names: str) -> Column:
    """The stack without the last of several elements and what is open in it."""
    return F.regexp_replace(stack, rf"^(.*>)(?:{names})>.*$", "$1")


def _cut_inside(stack: Column, names: str, lists: str) -> Column:
    """As ``_cut_any``, but not beyond the innermost list."""
    return F.regexp_replace(stack, rf"^(.*>)(?:{names})>(?!(?:.*>)?(?:{lists})>).*$", "$1")


def _opened(stack: Column, name: Column) -> Column:
    """The stack after an opening tag: elements that it ends are closed first."""
    # Any of them ends a paragraph, and the head of the page.
    base = _cut_any(stack, "p|head")
    closed = (
        F.when(name == "li", _cut_inside(base, "li", "ul|ol"))
        .when(name.isin("dd", "dt"), _cut_inside(base, "dd|dt", "dl"))
        .when(name.isin("td", "th"), _cut_any(base, "td|th"))
        .when(name == "tr", _cut_any(base, "tr"))
        .when(name.isin(*HEADINGS), _cut_any(base, "h[1-6]"))
        .otherwise(base)
    )
    return F.concat(closed, name, F.lit(">"))


def _closed(stack: Column, name: Column) -> Column:
    """The stack after a closing tag; tags that close nothing change nothing."""
    return (
        F.when(name == "li", _cut_inside(stack, "li", "ul|ol"))
        .when(name.isin(*HEADINGS), _cut_any(stack, "h[1-6]"))
        .otherwise(_cut(stack, name))
    )


_BLOCK = "struct<tag:string,depth:int,first:int,last:int>"


def _fold(tokens: Column) -> Column:
    """The blocks of a page: innermost element, list depth, first and last token."""

    def step(state: Column, token: Column) -> Column:
        name, stack, tables = token["name"], state["stack"], state["tables"]
        closing = F.startswith(name, F.lit("/"))
        free = tables == 0
        bare = F.substr(name, F.lit(2))
        depth = F.when(F.endswith(stack, F.lit(">li>")), F.greatest(F.regexp_count(stack, F.lit("(?<=>)(?:ul|ol)>")) - 1, F.lit(0)))
        run = F.struct(
            F.substring_index(F.substring_index(stack, ">", -2), ">", 1).alias("tag"),
            depth.cast("int").alias("depth"),
            token["at"].alias("first"),
            token["at"].alias("last"),
        ).cast(_BLOCK)
        table = F.struct(F.lit("table").alias("tag"), F.lit(None).cast("int").alias("depth"), state["start"].alias("first"), token["at"].alias("last"))
        hidden = F.contains(stack, F.lit(">head>")) | F.contains(stack, F.lit(">template>"))
        out = state["out"]
        found = (
            F.when((name == "") & free & ~hidden, F.concat(out, F.array(run)))
            .when((name == "/table") & (tables == 1), F.concat(out, F.array(table.cast(_BLOCK))))
            .otherwise(out)
        )
        return F.struct(
            F.when((name == "") | ~free, stack)
            .when(name == "table", _cut_any(stack, "p|head"))
            .when(closing, _closed(stack, bare))
            .otherwise(_opened(stack, name))
            .alias("stack"),
            F.when(name == "table", tables + 1).when(name == "/table", F.greatest(tables - 1, F.lit(0))).otherwise(tables).alias("tables"),
            F.when((name == "table") & free, token["at"]).otherwise(state["start"]).alias("start"),
            found.alias("out"),
        )

    none = F.array().cast(f"array<{_BLOCK}>")

    def start(stack: Column, tables: Column, first: Column, out: Column) -> Column:
        return F.struct(stack.alias("stack"), tables.alias("tables"), first.alias("start"), out.alias("out"))

    def block(state: Column, part: Column) -> Column:
        zero = start(state["stack"], state["tables"], state["start"], none)
        return bind(F.aggregate(part, zero, step), lambda s: start(s["stack"], s["tables"], s["start"], F.concat(state["out"], s["out"])))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(tokens), F.lit(1)) - 1) / FOLD).cast("int")),
        lambda k: F.slice(tokens, k * FOLD + 1, F.lit(FOLD)),
    )
    # A table that is never closed reaches to the end.
    rest = lambda s: F.struct(F.lit("table").alias("tag"), F.lit(None).cast("int").alias("depth"), s["start"].alias("first"), (F.size(tokens) - 1).alias("last")).cast(_BLOCK)
    return F.aggregate(
        parts,
        start(F.lit(">"), F.lit(0), F.lit(0), none),
        block,
        lambda s: F.when(s["tables"] > 0, F.concat(s["out"], F.array(rest(s)))).otherwise(s["out"]),
    )


def _described(tag: Column, depth: Column, markup: Column, table: Column) -> Column:
    """A block with its text, its links, its emphasized words and its pictures."""
    empty = F.array().cast("array<string>")
    anchors = F.when(markup.rlike(r"(?i)<a\s"), F.regexp_extract_all(markup, F.lit(_ANCHOR), F.lit(0))).otherwise(empty)
    links = F.filter(
        F.transform(anchors, lambda a: F.struct(attribute(a, "href", table).alias("url"), plain(a, table).alias("text"))), lambda x: x["url"].isNotNull()
    )
    marked = F.when(markup.rlike(rf"(?i)<(?:{'|'.join(EMPHASIS)})[\s>]"), F.regexp_extract_all(markup, F.lit(_EMPHASIS), F.lit(0))).otherwise(empty)
    strong = F.filter(
        F.transform(marked, lambda m: F.struct(F.lower(F.regexp_extract(m, r"^<(\w+)", 1)).alias("tag"), plain(m).alias("text"))),
        lambda x: x["text"] != "",
    )
    return F.struct(tag.alias("tag"), depth.alias("depth"), plain(markup, table).alias("text"), markup.alias("html"), links.alias("links"), strong.alias("strong"), F.lit(None).cast("string").alias("src"))


_DESCRIBED = (
    "struct<tag:string,depth:int,text:string,html:string,links:array<struct<url:string,text:string>>,"
    "strong:array<struct<tag:string,text:string>>,src:string>"
)


def _picture(tag: Column, table: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit("img").alias("tag"),
        none.cast("int").alias("depth"),
        F.coalesce(F.trim(F.regexp_replace(attribute(tag, "alt", table), r"\s+", " ")), F.lit("")).alias("text"),
        tag.alias("html"),
        F.array().cast("array<struct<url:string,text:string>>").alias("links"),
        F.array().cast("array<struct<tag:string,text:string>>").alias("strong"),
        attribute(tag, "src", table).alias("src"),
    ).cast(_DESCRIBED)


def blocks(html: Column) -> Column:
    """The shown blocks of a page in order, with pictures after the block that holds them.

    An array of (tag, depth, text, html, links, strong, src): the innermost open element,
    the list depth of an ``li`` from 0, the text, the markup, links, emphasized words with
    their tags, and a picture's address.
    """
    name = lambda t: F.when(F.startswith(t, F.lit("<")), F.lower(F.regexp_extract(t, _NAME, 1))).otherwise("")
    tokens = F.transform(
        F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0)),
        lambda t, k: F.struct(name(t).alias("name"), t.alias("raw"), k.alias("at")),
    )
    cleaned = lambda m: F.when(m.rlike(_HAS_IGNORED), F.regexp_replace(m, _CLEAN, "$1")).otherwise(m)

    def described(all_tokens: Column, b: Column, table: Column) -> Column:
        inside = F.slice(all_tokens["raw"], b["first"] + 1, b["last"] - b["first"] + 1)
        block = bind(cleaned(F.array_join(inside, "")), lambda m: _described(b["tag"], b["depth"], m, table)).cast(_DESCRIBED)
        return bind(
            block,
            lambda d: F.concat(
                F.array(d),
                F.when(d["html"].rlike(r"(?i)<img[\s/>]"), F.transform(F.regexp_extract_all(d["html"], F.lit(_IMAGE), F.lit(0)), lambda i: _picture(i, table))).otherwise(
                    F.array().cast(f"array<{_DESCRIBED}>")
                ),
            ),
        )

    found = bind(tokens, lambda t: bind(_reference_table(), lambda table: F.flatten(F.transform(_fold(t), lambda b: described(t, b, table)))))
    return F.filter(found, lambda b: (b["text"] != "") | (b["tag"] == "img"))
