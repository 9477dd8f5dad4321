"""SQL twins of the named queries, for DuckDB on the same tables.

The statements are written from the definitions, with other means than the operators
where there is a choice: recursion for chunk packing, joins for language counts, plain
windows for running values.  Templates and word lists are data and are shared.
"""

from __future__ import annotations

import re

from quire.functions import markup as m
from quire.functions.images import HASH_PREFIX_CHARS
from quire.functions.language import BUCKETS, CODES, SHARE, TOP
from quire.functions.ordered import IMAGE_SEGMENT_ROWS, SEGMENT_ROWS
from quire.functions.text import EMAIL, IPV4, STOP_WORDS, URL, US_PHONE, WHITESPACE, WORD
from quire.operators import rag, render, slides as sl
from quire.operators.chunking import MAX_CHARACTERS as MAX, NEW_AFTER_N_CHARS as SOFT, OVERLAP
from quire.operators.export import BASE64_PREVIEW_CHARS, BASE_FIELDS, OUTPUT_SUFFIXES
from quire.operators.images import IMPORT_INFO, RAG_FORMAT
from quire.plans.derived import FILE_EXTENSIONS
from quire.schema import ELEMENT_COLUMNS
from quire.sources.files import ACCEPTED_TYPES


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


NL, BL = "chr(10)", "chr(10) || chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def fill(template: str, **values: str) -> str:
    """A SQL concatenation of a template; NULL when a value is NULL."""
    parts, rest = [], template
    while True:
        found = sorted((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest)
        if not found:
            break
        at, name = found[0]
        parts += [lit(rest[:at])] if at else []
        parts.append(f"CAST({values[name]} AS VARCHAR)")
        rest = rest[at + len(name) + 2 :]
    parts += [lit(rest)] if rest else []
    return "(" + " || ".join(parts) + ")"


def esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def attr(x: str) -> str:
    return f"replace({esc(x)}, '\"', '&quot;')"


def js(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def obj(**pairs: str) -> str:
    """JSON text of an object; members that are NULL are left out."""
    members = ", ".join(f"'\"{k}\":' || {v}" for k, v in pairs.items())
    return f"('{{' || concat_ws(',', {members}) || '}}')"


def joined(x: str, sep: str = "|") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(array_to_string({x}, {lit(sep)}), '') END"


def b64(x: str, n: int | None = None) -> str:
    return f"to_base64(encode({x if n is None else f'substring({x}, 1, {n})'}))"


IMAGE = "('Image','Figure','Picture','FigureCaption')"

LINES = """lines AS (
  SELECT doc_id, source, lang, CAST(unnest(range(len(a))) AS INTEGER) AS i, unnest(a) AS line
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS a FROM documents))"""

TEXT = f"""{LINES},
e AS (
  SELECT doc_id, source, lang, i AS element_index, doc_id || '-' || i AS element_uid,
    CASE WHEN line = '' THEN 'PageBreak' WHEN i = 0 THEN 'Title'
         WHEN length(line) <= 60 THEN 'ListItem' ELSE 'NarrativeText' END AS element_type,
    line AS text, CAST(i // 5 + 1 AS INTEGER) AS page_number
  FROM lines)"""

SECTIONED = TEXT + """,
s AS (SELECT * REPLACE (CASE WHEN element_index % 9 = 0 THEN 'Title' ELSE element_type END AS element_type),
  CASE WHEN element_index % 9 = 0 AND element_index % 5 <> 3 THEN CAST((doc_id * 3 + element_index // 9) % 4 AS INTEGER) END AS category_depth FROM e)"""

_SITE = "'https://example.org/' || doc_id || '/' || i"
RICH = f"""{TEXT},
z AS (
  SELECT doc_id, source, lang, CAST(element_index + element_index // 10 AS INTEGER) AS i, element_type, text AS line, false AS broken FROM e
  UNION ALL
  SELECT doc_id, source, lang, CAST(element_index + element_index // 10 + 1 AS INTEGER), element_type, '', true FROM e WHERE element_index % 10 = 9),
k AS (
  SELECT doc_id, source, lang, i, doc_id || '-' || i AS element_uid, CAST(i // 5 + 1 AS INTEGER) AS p, line,
    CASE WHEN broken THEN 'PageBreak' WHEN i = 0 THEN 'Title' WHEN i % 10 = 7 THEN 'Table' WHEN i % 10 = 9 THEN 'Image'
         WHEN i % 20 = 8 THEN 'FigureCaption' WHEN i % 20 = 18 THEN 'Picture'
         WHEN i % 10 = 1 AND doc_id % 5 = 0 THEN 'Header' WHEN i % 10 = 2 AND doc_id % 5 = 1 THEN 'Footer'
         ELSE element_type END AS kind
  FROM z),
r AS (
  SELECT doc_id, source, i AS element_index, element_uid, kind AS element_type,
    line AS text,
    CASE WHEN doc_id % 11 <> 0 THEN p END AS page_number,
    CASE WHEN kind = 'Table' AND doc_id % 7 = 0 THEN 'Sheet' || (i // 10 + 1) END AS page_name,
    CASE WHEN kind IN ('Title','ListItem') AND NOT (kind = 'Title' AND doc_id % 13 = 0)
         THEN CAST(doc_id % 3 AS INTEGER) END AS category_depth,
    CASE WHEN i > 0 THEN doc_id || '-0' END AS parent_id,
    CASE WHEN i % 8 <> 6 THEN [lang, 'eng'] END AS languages,
    CASE WHEN i % 4 = 0 THEN [substring(line, 1, 5)] END AS emphasized_text_contents,
    CASE WHEN i % 4 = 0 THEN ['b'] END AS emphasized_text_tags,
    CASE WHEN i % 6 = 0 THEN [{{'url': {_SITE}, 'text': 'site'}}] END AS links,
    CASE WHEN i % 9 = 4 THEN [{_SITE} || '?a=1&b=2', {_SITE} || '#top'] END AS link_urls,
    CASE WHEN i % 9 = 4 THEN ['first <link>'] END AS link_texts,
    CASE WHEN kind IN ('Image','Picture','FigureCaption') AND doc_id % 6 <> 5
         THEN {b64("(repeat('~', CASE WHEN doc_id % 3 = 0 THEN 900 ELSE 0 END) || line)")} END AS image_base64,
    CASE WHEN kind IN {IMAGE} THEN CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg'
         WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END END AS image_mime_type,
    CASE WHEN i % 30 = 9 THEN {_SITE} || '.png' END AS image_url,
    CASE WHEN i % 30 = 19 THEN 'img/' || doc_id || '-' || i END AS image_path,
    CASE WHEN doc_id % 8 = 1 THEN {_SITE} END AS url,
    CASE WHEN kind = 'Table' AND doc_id % 4 <> 3
         THEN '<table><tr><td>' || {esc('line')} || '</td></tr></table>' END AS text_as_html,
    CASE WHEN source = 'src3' AND i = 0 THEN 'a' || doc_id || '@example.org' END AS sent_from,
    CASE WHEN source = 'src3' AND i = 0 THEN 'b@example.org' END AS sent_to,
    CASE WHEN source = 'src3' AND i = 0 THEN substring(line, 1, 20) END AS subject,
    CASE WHEN kind IN ('Header','Footer') THEN 'primary' END AS header_footer_type,
    CASE WHEN doc_id % 9 = 0 THEN 's' || (i // 10) END AS section,
    CAST(i % 10 AS DOUBLE) / 10 AS detection_class_prob,
    CASE WHEN i % 15 = 3 THEN '(' || i || ',' || doc_id || ')' END AS coordinates,
    CASE WHEN doc_id % 4 = 1 THEN 'file_' || doc_id || '.txt' END AS filename,
    CASE WHEN doc_id % 2 = 0 THEN 'text/plain' END AS filetype
  FROM k)"""

RICH_FIELDS = set(re.findall(r"AS (\w+)[,\n]", RICH[RICH.index("r AS (") :])) | {"doc_id", "source", "element_uid"}
S = strip("text")
PREFIX_HASH = f"md5(substring(image_base64, 1, {HASH_PREFIX_CHARS}))"
HASH = "substring(md5(image_base64), 1, 16)"
MIME_PNG = "coalesce(image_mime_type, 'image/png')"
MIME_JPEG = "coalesce(image_mime_type, 'image/jpeg')"
EXT = (
    f"CASE WHEN {MIME_PNG} LIKE '%jpeg%' OR {MIME_PNG} LIKE '%jpg%' THEN 'jpg' WHEN {MIME_PNG} LIKE '%gif%' THEN 'gif' "
    f"WHEN {MIME_PNG} LIKE '%webp%' THEN 'webp' ELSE 'png' END"
)
PAGE_OR_INDEX = "coalesce(page_number, element_index)"
FILE_NAME = f"'page_' || printf('%03d', {PAGE_OR_INDEX}) || '_hash_' || {HASH} || '.' || {EXT}"
PACKED_NAME = f"'images/page_' || printf('%03d', {PAGE_OR_INDEX}) || '_' || {HASH} || '.' || {EXT}"
PAYLOAD = f"element_type IN {IMAGE} AND image_base64 IS NOT NULL"

MANIFEST = f"""{RICH},
mf AS (
  SELECT doc_id, {FILE_NAME} AS filename, {PACKED_NAME} AS packaged, {HASH} AS hash, {PAGE_OR_INDEX} AS page,
    element_index, element_type, {MIME_PNG} AS mime_type, CAST(octet_length(from_base64(image_base64)) AS INTEGER) AS size_bytes
  FROM r WHERE {PAYLOAD})"""

PICTURED = f"({PAYLOAD})"
RAG = f"""{RICH},
g0 AS (
  SELECT doc_id, coalesce(filename, source) AS source, element_index, element_type, page_number AS page,
    filetype AS document_type, parent_id, category_depth AS hierarchy_level, languages[1] AS language,
    CASE WHEN links IS NOT NULL THEN true END AS has_links, CAST(len(links) AS INTEGER) AS link_count,
    CASE WHEN text_as_html IS NOT NULL THEN true END AS is_table, page_name AS sheet_name,
    subject AS email_subject, sent_from AS email_from,
    CASE WHEN {PICTURED} THEN {HASH} END AS image_hash, CASE WHEN {PICTURED} THEN true END AS image_available,
    CASE WHEN {PICTURED} THEN url END AS image_url,
    CASE WHEN element_type IN {IMAGE} THEN false END AS image_described,
    CAST(NULL AS VARCHAR) AS vision_model, CAST(NULL AS DOUBLE) AS vision_cost_estimate, {S} AS content
  FROM r WHERE {S} <> '' AND element_type <> 'PageBreak'),
g AS (
  SELECT * REPLACE (CASE WHEN element_type IN {IMAGE} THEN content || {BL} || {lit(rag.NOTE_NOT_DESCRIBED)}
    ELSE content END AS content) FROM g0)"""

DESCRIBED = f"""{RAG},
ds AS (
  SELECT image_hash, CASE WHEN right(image_hash, 1) = '0' THEN caption ELSE 'Bild ' || substring(image_hash, 1, 6) END AS description,
    CASE WHEN right(image_hash, 1) <= '4' THEN 'm1' ELSE 'm2' END AS model,
    CAST(CASE WHEN right(image_hash, 1) <= '4' THEN 0.003 ELSE 0.01 END AS DOUBLE) AS cost_estimate
  FROM (SELECT {HASH} AS image_hash, min(text) AS caption FROM r WHERE image_base64 IS NOT NULL GROUP BY 1)
  WHERE right(image_hash, 1) BETWEEN '0' AND '9'),
gd AS (
  SELECT g0.* REPLACE (
    CASE WHEN element_type IN {IMAGE} THEN coalesce(description <> content, false) END AS image_described,
    CASE WHEN description <> content THEN model END AS vision_model,
    CASE WHEN description <> content THEN cost_estimate END AS vision_cost_estimate,
    CASE WHEN description <> content THEN content || {BL} || {lit(rag.DESCRIPTION_LABEL)} || description
         WHEN g0.image_hash IS NOT NULL AND description IS NULL THEN content || {BL} || {lit(rag.NOTE_UNAVAILABLE)}
         ELSE content END AS content)
  FROM g0 LEFT JOIN ds ON g0.image_hash = ds.image_hash)"""

_KINDS = {k: js(k) for k in rag.METADATA_KEYS}
RAG_LINE = obj(metadataAttributes=obj(**_KINDS), content=js("content"))

_PRESENT = {
    "page_number", "page_name", "filename", "filetype", "coordinates", "parent_id", "category_depth", "text_as_html",
    "languages", "emphasized_text_contents", "emphasized_text_tags", "detection_class_prob", "url",
}
_BASE = {k: js(k) for k in BASE_FIELDS if k in _PRESENT}
_LINKS = {k: js(k) for k in ("link_urls", "link_texts")}


def _element_json(**metadata: str) -> str:
    return obj(type=js("element_type"), element_id=js("element_uid"), text=js("text"), metadata=obj(**metadata))


ELEMENT_JSON = _element_json(
    **_BASE, links=js("links"), **_LINKS, **{k: js(k) for k in ("image_mime_type", "image_url", "header_footer_type", "section")}
)
SHORT = f"CASE WHEN length(image_base64) > {BASE64_PREVIEW_CHARS} THEN substring(image_base64, 1, {BASE64_PREVIEW_CHARS}) || '...' ELSE image_base64 END"
FULL_JSON = _element_json(
    **_BASE,
    image_path=js("image_path"),
    image_base64=js(SHORT),
    image_mime_type=js("image_mime_type"),
    base64_truncated=js(f"length(image_base64) > {BASE64_PREVIEW_CHARS}"),
    **_LINKS,
)

DEPTH = "coalesce(category_depth, 0)"
LEVEL = f"least({DEPTH} + 2, 6)"
BADGES = (
    "nullif(concat_ws(' | ', "
    + ", ".join(
        (
            fill(m.BADGE_PAGE, page="page_number"),
            fill(m.BADGE_LANGUAGES, languages="array_to_string(languages[1:2], ', ')"),
            fill(m.BADGE_DEPTH, depth="category_depth"),
        )
    )
    + "), '')"
)


def emphasized(template: str, e=lambda x: x) -> str:
    p = "emphasized_text_contents[1]"
    return f"CASE WHEN {p} <> '' THEN replace({e(S)}, {e(p)}, {fill(template, text=e(p))}) ELSE {e(S)} END"


def linked(plain: str | None, default: str, template: str, e=lambda x: x, q=lambda x: x) -> str:
    named = f"array_to_string(list_transform(link_urls, lambda u, n: {fill(template, url=q('u'), text=e(f'coalesce(link_texts[n], {lit(default)})'))}), '')"
    out = f"coalesce({named}, '')"
    if plain:
        out = f"coalesce(array_to_string(list_transform(links, lambda x: {fill(plain, url=q('x.url'), text=lit(default))}), ''), '') || " + out
    return f"({out})"


HTML_EMPHASIS = emphasized(m.HTML_STRONG, esc)
HTML_LINKS = linked(m.HTML_LINK, m.LINK_SIGN, m.HTML_LINK, esc, attr)
MD_EMPHASIS = emphasized(m.MD_STRONG)
MD_URLS = linked(None, m.MD_LINK_DEFAULT, m.MD_LINK)


def html(images: bool, metadata: bool) -> str:
    page = "page_number" if metadata else "NULL"
    body = f"({HTML_EMPHASIS} || {HTML_LINKS})"
    placeholder = f"CASE WHEN {S} <> '' THEN {fill(m.HTML_NO_IMAGE, text=esc(S))} END"
    picture = placeholder
    if images:
        url = f"'data:' || {attr(MIME_JPEG)} || ';base64,' || image_base64"
        alt = f"CASE WHEN {S} <> '' THEN substring({S}, 1, 100) ELSE {lit(m.HTML_ALT_DEFAULT)} END"
        shown = (
            f"concat_ws('', {lit(m.HTML_IMAGE_OPEN)}, {fill(m.HTML_IMAGE_PAGE, page=page)}, {fill(m.HTML_IMAGE, url=url, alt=attr(alt))}, "
            f"CASE WHEN {S} <> '' THEN {fill(m.HTML_CAPTION, text=esc(S))} END, '</div>')"
        )
        picture = f"CASE WHEN image_base64 IS NOT NULL THEN {shown} ELSE {placeholder} END"
    table = f"concat_ws('', {lit(m.HTML_TABLE_OPEN)}, {fill(m.HTML_TABLE_PAGE, page=page)}, coalesce(text_as_html, {fill(m.HTML_TABLE_TEXT, text=esc('text'))}), '</div>')"
    indent = f"{DEPTH} * 20"
    tagged = f"""CASE element_type WHEN 'Title' THEN {fill(m.HTML_TITLE, level=LEVEL, indent=indent, text=body)}
      WHEN 'ListItem' THEN {fill(m.HTML_LIST_ITEM, indent=indent, text=body)} WHEN 'Header' THEN {fill(m.HTML_HEADER, text=body)}
      WHEN 'Footer' THEN {fill(m.HTML_FOOTER, text=body)} WHEN 'NarrativeText' THEN {fill(m.HTML_NARRATIVE, text=body)}
      ELSE {fill(m.HTML_PARAGRAPH, text=body)} END"""
    note = f"{fill(m.HTML_BADGES, badges=BADGES)}, " if metadata else ""
    return f"""CASE WHEN element_type IN {IMAGE} THEN {picture} WHEN element_type = 'Table' THEN {table}
      WHEN element_type = 'PageBreak' THEN {lit(m.HTML_PAGE_BREAK)}
      WHEN {S} <> '' THEN concat_ws('', {lit(m.HTML_ELEMENT_OPEN)}, {note}{tagged}, '</div>') END"""


def markdown(images: bool, metadata: bool) -> str:
    body = f"({MD_EMPHASIS} || {MD_URLS})"
    placeholder = f"CASE WHEN {S} <> '' THEN {fill(m.MD_NO_IMAGE, text=S)} END"
    picture = placeholder
    if images:
        url = f"'data:' || {MIME_JPEG} || ';base64,' || image_base64"
        alt = f"CASE WHEN {S} <> '' THEN substring({S}, 1, 100) ELSE {fill(m.MD_ALT_DEFAULT, type='element_type')} END"
        shown = f"concat_ws({BL}, {fill(m.MD_IMAGE, alt=alt, url=url)}, CASE WHEN {S} <> '' THEN {fill(m.MD_CAPTION, text=S)} END)"
        picture = f"CASE WHEN image_base64 IS NOT NULL THEN {shown} ELSE {placeholder} END"
    page = "page_number" if metadata else "NULL"
    table = f"nullif(concat_ws({BL}, {fill(m.MD_TABLE_PAGE, page=page)}, coalesce(text_as_html, CASE WHEN {S} <> '' THEN {fill(m.MD_TABLE_TEXT, text=S)} END)), '')"
    indent = f"repeat('  ', {DEPTH})"

    def lines(item: str) -> str:
        return f"array_to_string(list_transform(links, lambda x, n: {item}), {BL})"

    plain = lines(fill(m.MD_LINK_LINE, url="x.url"))
    nested = lines(f"{indent} || '  ' || {fill(m.MD_LINK_LINE, url='x.url')}")
    notes = lines(fill(m.MD_FOOTNOTE, number="n", url="x.url"))
    tagged = f"""CASE element_type WHEN 'Title' THEN concat_ws({BL}, repeat('#', {LEVEL}) || ' ' || {body}, {plain})
      WHEN 'ListItem' THEN concat_ws({BL}, {fill(m.MD_LIST_ITEM, indent=indent, text=body)}, {nested})
      WHEN 'Header' THEN {fill(m.MD_HEADER, text=body)} WHEN 'Footer' THEN {fill(m.MD_FOOTER, text=body)}
      WHEN 'NarrativeText' THEN concat_ws({BL}, {body}, {notes}) ELSE concat_ws({BL}, {body}, {plain}) END"""
    note = f"{fill(m.MD_BADGES, badges=BADGES)}, " if metadata else ""
    return f"""CASE WHEN element_type IN {IMAGE} THEN {picture} WHEN element_type = 'Table' THEN {table}
      WHEN element_type = 'PageBreak' THEN {lit(m.MD_PAGE_BREAK)}
      WHEN {S} <> '' THEN concat_ws({BL}, {note}{tagged}) END"""


def agg(part: str, sep: str) -> str:
    return f"string_agg({part}, {sep} ORDER BY element_index)"


#: Positions of a segment in queries whose form does not fix them: documents have several.
ROWS = 32


def seg(rows: int, index: str = "element_index") -> str:
    return f"CAST({index} // {rows} AS INTEGER)"


HTML_IMAGES = f"""h AS (
  SELECT doc_id, {seg(IMAGE_SEGMENT_ROWS)} AS segment, element_index, {html(True, True)} AS part FROM r)"""
# The first segment of a document opens the page or array, the last one closes it.
FIRST_LAST = "segment = 0 AS opens, segment = max(segment) OVER (PARTITION BY doc_id) AS closes"


def paged(html: str) -> str:
    """A piece of a page with the tags that it opens and closes."""
    return f"concat_ws({NL}, CASE WHEN opens THEN {lit(m.HTML_OPEN)} END, {html}, CASE WHEN closes THEN '</div>' END)"


def bracketed(json: str) -> str:
    return f"(CASE WHEN opens THEN '[' ELSE '' END || {json} || CASE WHEN closes THEN ']' ELSE '' END)"


RENDER_HTML = f"""SELECT doc_id, segment, {paged('html')} AS html FROM (
  SELECT doc_id, segment, {agg('part', NL)} AS html, {FIRST_LAST} FROM h GROUP BY 1, 2) WHERE html IS NOT NULL OR opens OR closes"""
RENDER_MD = f"SELECT doc_id, {seg(IMAGE_SEGMENT_ROWS)} AS segment, {agg(markdown(True, True), BL)} AS markdown FROM r GROUP BY 1, 2 HAVING markdown IS NOT NULL"

SLIDES = f"""{LINES},
sh AS (
  SELECT doc_id, CAST(i // 5 + 1 AS INTEGER) AS slide, i % 5 AS k, line,
    CASE WHEN i % 5 = 1 AND doc_id % 10 = 0 THEN '  ' ELSE line END AS t,
    CASE WHEN doc_id % 3 <> 0 THEN 'Shape ' || (i % 5) END AS name,
    CASE WHEN (i // 5 + 1) % 4 <> 1 THEN CASE i % 5 WHEN 1 THEN 4 WHEN 2 THEN 12 WHEN 3 THEN 13 WHEN 4 THEN 4 END END AS ph
  FROM lines),
sd AS (
  SELECT doc_id, slide, 'Layout ' || (slide % 4) AS layout_name,
    CASE WHEN slide % 4 = 2 THEN 'Notiz ' || slide END AS notes,
    arg_max({strip('t')}, k) FILTER (WHERE ph = 4 AND {strip('t')} <> '') AS footer_text,
    arg_max({strip('t')}, k) FILTER (WHERE ph = 13) AS date_text,
    CAST(NULL AS VARCHAR) AS slide_number
  FROM sh GROUP BY ALL)"""

LAYOUTS = """ly AS (
  SELECT doc_id, slide, layout_name, 0 AS ord FROM sd WHERE slide % 3 <> 0
  UNION ALL SELECT doc_id, slide, 'Second', 1 FROM sd WHERE slide % 3 <> 0 AND slide % 5 = 0)"""
LAYOUT_JOIN = """lj AS (
  SELECT sd.doc_id, sd.slide, coalesce(f.layout_name, 'Standard') AS layout_name
  FROM sd LEFT JOIN (SELECT doc_id, slide, arg_min(layout_name, ord) AS layout_name FROM ly GROUP BY 1, 2) f USING (doc_id, slide))"""


def slide_html() -> str:
    """The pieces of each slide: its elements, its opening and its end."""
    text = esc("text")
    url = f"'data:' || {attr(MIME_PNG)} || ';base64,' || image_base64"
    part = f"""CASE WHEN element_type = 'Title' THEN {fill(sl.SLIDE_TITLE, text=text)}
      WHEN element_type IN ('NarrativeText','Text') THEN {fill(sl.SLIDE_TEXT, text=text)}
      WHEN element_type = 'ListItem' THEN {fill(sl.SLIDE_LIST_ITEM, text=text)}
      WHEN element_type = 'Table' THEN {fill(sl.SLIDE_TABLE, html=f'coalesce(text_as_html, {text})')}
      WHEN element_type IN {IMAGE} THEN CASE WHEN image_base64 IS NOT NULL
        THEN {fill(sl.SLIDE_IMAGE, url=url, alt=attr('text'), text=text)} ELSE {fill(sl.SLIDE_NO_IMAGE, text=text)} END END"""
    footer = f"concat_ws(' | ', {fill(sl.FOOTER_TEXT, text=esc('footer_text'))}, {fill(sl.FOOTER_DATE, text=esc('date_text'))})"
    head = f"""concat_ws({NL}, {fill(sl.SLIDE_OPEN, slide='slide')}, {lit(sl.SLIDE_HEADER_OPEN)}, {fill(sl.SLIDE_NUMBER_TEXT, slide='slide')},
      {fill(sl.SLIDE_LAYOUT, layout="coalesce(layout_name, 'Standard')")}, '</div>', {lit(sl.SLIDE_CONTENT_OPEN)})"""
    tail = f"""concat_ws({NL}, '</div>',
      CASE WHEN notes IS NOT NULL THEN concat_ws({NL}, {lit(sl.NOTES_OPEN)}, {lit(sl.NOTES_LABEL)}, {fill(sl.NOTES_TEXT, text=esc('notes'))}, '</div>') END,
      CASE WHEN footer_text IS NOT NULL OR date_text IS NOT NULL THEN concat_ws({NL}, {lit(sl.FOOTER_OPEN)}, '<div>' || {footer} || '</div>', '</div>') END, '</div>')"""
    return f"""WITH {RICH}, {_after_lines(SLIDES)}, {LAYOUTS}, {LAYOUT_JOIN},
b AS (SELECT doc_id, coalesce(page_number, 1) AS slide, element_index, {part} AS part FROM r),
x AS (SELECT doc_id, slide, max(element_index) AS last FROM b GROUP BY 1, 2)
SELECT doc_id, slide, {seg(IMAGE_SEGMENT_ROWS)} AS segment, {agg('part', NL)} AS html FROM b GROUP BY 1, 2, 3 HAVING html IS NOT NULL
UNION ALL
SELECT doc_id, slide, unnest([-1, {seg(IMAGE_SEGMENT_ROWS, 'last')} + 1]), unnest([{head}, {tail}])
FROM x LEFT JOIN lj USING (doc_id, slide) LEFT JOIN (SELECT doc_id, slide, notes, footer_text, date_text FROM sd) USING (doc_id, slide)"""


def _after_lines(ctes: str) -> str:
    return ctes[len(LINES) + 1 :].lstrip(", \n")


# The twin of the HTML partition cuts at a few block tags, which is enough for the given
# pages; what the derived table adds to them is listed row by row.
BLOCK_TAGS = "h[1-6]|p|li|div|header|footer"
HIDDEN_HTML = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def unescape(x: str) -> str:
    for entity, char in ENTITIES:
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def plain(x: str) -> str:
    spaced = unescape(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")
    return rf"trim(regexp_replace({spaced}, '\s+', ' ', 'g'))"


def _added(rows: tuple) -> str:
    """Rows that the derived table puts after a page's own, as a VALUES list."""
    cells = lambda r: ", ".join(x if isinstance(x, str) else "NULL" for x in r)
    return ",\n    ".join(f"({k}, {cells(r)})" for k, r in enumerate(rows))


_NONE = "CAST([] AS VARCHAR[])"
# Text, type, depth, links, link texts, emphasis, picture, table; by page number modulo 3.
ADDED_HTML = {
    0: (
        ("url || ' 2'", "'Table'", None, _NONE, _NONE, _NONE, None, "'<table><tr><td>' || url || '</td><td>2</td></tr></table>'"),
        ("'€ <tail>'", "'Text'", None, _NONE, _NONE, _NONE, None, None),
        ("'A & B'", "'Image'", None, _NONE, _NONE, _NONE, "'i.png?a=1&b=2'", None),
    ),
    1: (
        ("'out one'", "'ListItem'", "0", "['u1']", "['one']", _NONE, None, None),
        ("'in Ünï'", "'ListItem'", "1", _NONE, _NONE, "['Ünï']", None, None),
        ("'again'", "'ListItem'", "0", _NONE, _NONE, _NONE, None, None),
        ("'a ' || url || ' b'", "'Table'", None, "['u 2']", "[url]", _NONE, None,
         "'<table><tr><td>a<table><tr><td><a href=\"u 2\">' || url || '</a></td></tr></table></td><td>b</td></tr></table>'"),
        ("'lead'", "'Text'", None, _NONE, _NONE, _NONE, None, None),
        ("'para'", "'NarrativeText'", None, _NONE, _NONE, "['para']", None, None),
        ("'trail'", "'Text'", None, _NONE, _NONE, _NONE, None, None),
        ("'it''s'", "'Image'", None, _NONE, _NONE, _NONE, "'p.png'", None),
    ),
}
_HREF = '(?i)<a\\b[^>]*href="([^"]*)"'
_ANCHOR = '(?is)<a\\b[^>]*href="[^"]*"[^>]*>(.*?)</a>'
HTML = rf"""p0 AS (
  SELECT page_id AS doc_id, string_split(regexp_replace(regexp_replace(html, {lit(HIDDEN_HTML)}, '', 'g'),
    '(?i)<({BLOCK_TAGS})\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS a FROM pages),
p1 AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS piece FROM p0),
p2 AS (SELECT doc_id, pos, CASE WHEN contains(piece, chr(2)) THEN lower(split_part(piece, chr(2), 1)) ELSE '' END AS tag,
         CASE WHEN contains(piece, chr(2)) THEN split_part(piece, chr(2), 2) ELSE piece END AS html
       FROM p1),
p3 AS (SELECT *, {plain('html')} AS text FROM p2),
h0 AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS element_index, text,
    CASE tag WHEN 'p' THEN 'NarrativeText' WHEN 'li' THEN 'ListItem' WHEN 'header' THEN 'Header' WHEN 'footer' THEN 'Footer'
         ELSE CASE WHEN tag LIKE 'h_' THEN 'Title' ELSE 'Text' END END AS element_type,
    CASE WHEN tag LIKE 'h_' THEN CAST(substring(tag, 2, 1) AS INTEGER) - 1 WHEN tag = 'li' THEN 0 END AS category_depth,
    list_transform(regexp_extract_all(html, {lit(_HREF)}, 1), lambda u: {unescape('u')}) AS link_urls,
    list_transform(regexp_extract_all(html, {lit(_ANCHOR)}, 1), lambda u: {plain('u')}) AS link_texts,
    list_filter(list_transform(regexp_extract_all(html, '(?i)<b>([^<]+)', 1), lambda u: {plain('u')}), lambda u: u <> '') AS strong,
    CAST(NULL AS VARCHAR) AS image_url, CAST(NULL AS VARCHAR) AS text_as_html
  FROM p3 WHERE text <> ''),
pc AS (SELECT page_id, url, coalesce(n, 0) AS n FROM pages LEFT JOIN (SELECT doc_id, count(*) AS n FROM h0 GROUP BY 1) c ON c.doc_id = page_id),
h AS (
  SELECT * FROM h0
  {"".join(f"""UNION ALL BY NAME
  SELECT page_id AS doc_id, CAST(n + k AS INTEGER) AS element_index, text, element_type, category_depth, link_urls, link_texts, strong, image_url, text_as_html
  FROM pc, LATERAL (VALUES {_added(rows)})
    v(k, text, element_type, category_depth, link_urls, link_texts, strong, image_url, text_as_html) WHERE page_id % 3 = {rest}
  """ for rest, rows in ADDED_HTML.items())})"""

MESSY = rf"""{RICH},
ms AS (SELECT * REPLACE (
  regexp_replace(regexp_replace(regexp_replace(text, ' (the|de|der|la) ', chr(160) || ' \1  ', 'g'), ', ', ',' || chr(10), 'g'),
    '\. ', '.' || chr(10) || ' ' || chr(10), 'g') || chr(160) || ' ' AS text) FROM r)"""


def cleaned(x: str) -> str:
    return f"trim(regexp_replace(replace(replace({x}, chr(160), ' '), chr(10), ' '), ' {{2,}}', ' ', 'g'))"


CLEAN = f"CASE WHEN {S} <> '' THEN {cleaned(S)} ELSE text END"
PARAGRAPHS = rf"array_to_string(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: replace(p, chr(10), ' ')), {BL})"
CSV = (
    f"CASE WHEN {S} <> '' THEN array_to_string(list_filter(list_transform(string_split({S}, chr(10)), "
    f"lambda l: coalesce(array_to_string(regexp_extract_all(l, {lit(WORD)}), ','), '')), lambda x: x <> ''), chr(10)) END"
)

CONTACT_PATTERNS = {"email": EMAIL, "phone": US_PHONE, "ip": IPV4, "url": URL}
URLS = "u AS (SELECT page_id AS doc_id, 0 AS element_index, 'NarrativeText' AS element_type, 'See <' || url || '> and http://example.org/a|b.' AS text FROM pages)"


def found(source: str, kinds: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, element_index, element_type, {lit(k)} AS kind, unnest(regexp_extract_all({S}, {lit(CONTACT_PATTERNS[k])})) AS value, "
        f"substring({S}, 1, 100) AS context FROM {source}"
        for k in kinds
    )


def chunks(source: str, ctes: str, by_title: bool) -> str:
    """Packing by recursion over the pieces of each document."""
    step = MAX - OVERLAP
    force = "p.title AND p.piece = 0" if by_title else "false"
    title = "element_type = 'Title'" if by_title else "false"
    new = f"({force} OR c.len >= {SOFT} OR c.len + 2 + p.n > {MAX})"
    return f"""WITH RECURSIVE {ctes},
n0 AS (SELECT doc_id, element_index, {title} AS title, text, length(text) AS len,
       CASE WHEN length(text) > {MAX} THEN CAST(ceil((length(text) - {OVERLAP}) / {float(step)}) AS INTEGER) ELSE 1 END AS pieces
       FROM {source} WHERE {S} <> ''),
n1 AS (SELECT *, unnest(range(pieces)) AS piece FROM n0),
ps AS (SELECT doc_id, element_index, CAST(piece AS INTEGER) AS piece, title,
       CASE WHEN pieces = 1 THEN text ELSE substring(text, piece * {step} + 1, {MAX}) END AS part,
       CASE WHEN pieces = 1 THEN len ELSE length(substring(text, piece * {step} + 1, {MAX})) END AS n,
       row_number() OVER (PARTITION BY doc_id ORDER BY element_index, piece) AS nth FROM n1),
ck AS (
  SELECT doc_id, nth, n AS len, 0 AS chunk_index, CAST(title AS INTEGER) AS section FROM ps WHERE nth = 1
  UNION ALL
  SELECT p.doc_id, p.nth, CASE WHEN {new} THEN p.n ELSE c.len + 2 + p.n END,
    c.chunk_index + CAST({new} AS INTEGER), c.section + CAST({force} AS INTEGER)
  FROM ck c JOIN ps p ON p.doc_id = c.doc_id AND p.nth = c.nth + 1),
ch AS (
  SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(min(section) AS BIGINT) AS section,
    string_agg(part, {BL} ORDER BY nth) AS text,
    string_agg(element_index || ':' || piece || ':' || n, ' ' ORDER BY nth) AS orig
  FROM ck JOIN ps USING (doc_id, nth) GROUP BY 1, 2)"""


FILE_EXT = "lower(split_part(path, '.', 2))"

INLINE = f"""{RICH},
ir AS (
  SELECT doc_id, element_index, element_index + 1 AS element_id, element_type, source AS source_file, page_number AS page,
    CASE WHEN element_type IN {IMAGE} THEN image_base64 IS NOT NULL END AS image_available,
    CASE WHEN {PICTURED} THEN {HASH} END AS image_hash, d."describe", {S} AS t
  FROM r CROSS JOIN (VALUES (false), (true)) d("describe")),
is_ AS (
  SELECT image_hash, true AS "describe", CASE WHEN right(image_hash, 1) = '0' THEN caption ELSE 'Bild ' || substring(image_hash, 1, 6) END AS description,
    CASE WHEN right(image_hash, 1) <= '4' THEN 'm1' ELSE 'm2' END AS model,
    CAST(CASE WHEN right(image_hash, 1) <= '4' THEN 0.003 ELSE 0.01 END AS DOUBLE) AS cost
  FROM (SELECT {HASH} AS image_hash, min(text) AS caption FROM r WHERE image_base64 IS NOT NULL GROUP BY 1)
  WHERE right(image_hash, 1) BETWEEN '0' AND '9'),
iq AS (
  SELECT doc_id, element_index, element_id, element_type, source_file, page, image_available, image_hash,
    CASE WHEN element_type IN {IMAGE} THEN description IS NOT NULL END AS image_described,
    model AS vision_model,
    cost AS vision_cost_estimate,
    CASE WHEN element_type NOT IN {IMAGE} THEN t
         WHEN description IS NOT NULL THEN t || {BL} || {lit(rag.INLINE_DESCRIPTION[0])} || element_type || {lit(rag.INLINE_DESCRIPTION[1])} || description
         WHEN image_available THEN t || {BL} || {lit(rag.INLINE_AVAILABLE[0])} || image_hash || {lit(rag.INLINE_AVAILABLE[1])}
         ELSE t || {BL} || {lit(rag.INLINE_MISSING)} END AS content, "describe"
  FROM ir LEFT JOIN is_ USING (image_hash, "describe"))"""
INLINE_KEYS = ("element_id", "element_type", "source_file", "page", "image_available", "image_hash", "image_described", "vision_model", "vision_cost_estimate")
INLINE_JSON = obj(metadataAttributes=obj(**{k: js(k) for k in INLINE_KEYS}), content=js("content"))

CLASS = (
    "CASE WHEN element_type IN ('Image','FigureCaption','Figure') OR lower(element_type) LIKE '%image%' THEN 'image' "
    "WHEN lower(element_type) LIKE '%table%' THEN 'table' "
    "WHEN element_type IN ('Title','ListItem','Header','Footer','NarrativeText') THEN 'special' END"
)
PRE = f"substring({S}, 1, 100) AS text_preview"
DETAILS = (
    f"doc_id, element_index, element_type, substring({S}, 1, 200) AS text_preview, CAST(length({S}) AS INTEGER) AS text_length, "
    "true AS has_metadata, nullif(detection_class_prob, 0) AS detection_class_prob"
)


def rich(select: str, where: str = "", more: str = "") -> str:
    return f"WITH {RICH} SELECT {select} FROM r {'WHERE ' + where if where else ''} {more}"


def quoted(x: str) -> str:
    return f"""'"' || replace(CAST({x} AS VARCHAR), '"', '""') || '"'"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    exts = "[" + ", ".join(lit(x) for x in FILE_EXTENSIONS) + "]"
    files = f"fs AS (SELECT doc_id, 'doc_' || doc_id || '.' || {exts}[CAST(doc_id % 12 AS INTEGER) + 1] AS path, n_chars AS length FROM documents)"

    # Sources.
    q["file_catalog"] = f"WITH {files} SELECT 'Doc ' || doc_id || ' (' || format('{{:,}}', length) || ' bytes)' AS label, path, length FROM fs WHERE doc_id % 3 = 0"
    q["accepted_files"] = f"WITH {files} SELECT path, length FROM fs WHERE {FILE_EXT} IN ({', '.join(lit(x) for x in ACCEPTED_TYPES)})"
    image = "('jpg','jpeg','png','bmp','tiff','webp')"
    q["route_files"] = f"""WITH {files}, x AS (SELECT path, length, {FILE_EXT} AS ext, length % 17 = 0 AS failed FROM fs)
SELECT path, length,
  CASE WHEN failed THEN 'open_source_local' WHEN ext = 'pdf' THEN 'open_source_pdf_optimized_no_forms'
       WHEN ext IN {image} THEN 'open_source_image_optimized_no_forms' WHEN ext = 'docx' THEN 'open_source_docx_with_images'
       WHEN ext IN ('pptx','ppt') THEN 'open_source_pptx_with_picture_partitioner_True'
       WHEN ext IN ('xlsx','xls') THEN 'open_source_xlsx_no_image_support' ELSE 'open_source_local' END AS method,
  CASE WHEN failed THEN ext IN ('pdf','pptx','ppt') OR ext IN {image}
       WHEN ext IN {image} THEN NULL ELSE ext IN ('pdf','docx','pptx','ppt') END AS image_support,
  CASE WHEN ext IN {image} THEN 'hi_res' ELSE 'auto' END AS strategy FROM x"""
    q["elements_flags"] = rich("doc_id, element_index, element_type, false AS has_html", f"element_type NOT IN {IMAGE}")
    q["partition_text"] = f"WITH {TEXT} SELECT doc_id, element_index, element_uid, element_type, text, page_number FROM e"
    q["stream_partition"] = f"WITH {TEXT} SELECT doc_id, element_index, element_type, text, page_number FROM e"
    q["partition_html"] = f"""WITH {HTML} SELECT doc_id, element_index, element_type, text, category_depth, {joined('link_urls')} AS link_urls,
  {joined('link_texts')} AS link_texts, {joined('strong')} AS emphasized_text_contents, image_url, text_as_html FROM h"""
    q["quarantine"] = """SELECT doc_id, source, reason FROM (
  SELECT doc_id, source, CASE WHEN doc_id % 13 = 5 THEN 'no text' END AS reason FROM documents
  UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 13 = 5 THEN 'no json' WHEN doc_id % 7 = 2 THEN 'not an element with a document number' END FROM documents
  UNION ALL SELECT page_id, url, CASE page_id % 13 WHEN 5 THEN 'no html' WHEN 6 THEN 'nothing visible' END FROM pages)
WHERE reason IS NOT NULL"""
    q["page_numbers"] = rich(
        "doc_id, element_index, CAST(1 + count(*) FILTER (WHERE element_type = 'PageBreak') OVER (PARTITION BY doc_id ORDER BY element_index) AS INTEGER) AS page_number"
    )
    words = ", ".join(f"({lit(c)}, {lit(w)})" for c, ws in STOP_WORDS.items() for w in ws)
    q["element_language"] = f"""WITH {TEXT}, sw(code, w) AS (VALUES {words}),
t AS (SELECT doc_id, element_index, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS w FROM e),
c AS (SELECT doc_id, element_index, code, count(*) AS n FROM t JOIN sw USING (w) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, element_index, code FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, element_index ORDER BY n DESC, code) = 1)
SELECT doc_id, element_index, coalesce(code, 'und') AS language FROM e LEFT JOIN b USING (doc_id, element_index)"""
    q["parent_links"] = f"""WITH {SECTIONED} SELECT e.doc_id, e.element_index, arg_max(t.element_uid, t.element_index) AS parent_id
FROM s e LEFT JOIN s t ON t.doc_id = e.doc_id AND t.element_type = 'Title' AND t.element_index < e.element_index
  AND (e.element_type <> 'Title' OR coalesce(t.category_depth, 0) < coalesce(e.category_depth, 0)) GROUP BY 1, 2"""
    q["picture_elements"] = f"""WITH {TEXT} SELECT doc_id, element_index, 'Image' AS element_type,
  CASE WHEN element_index % 10 <> 9 THEN 'pic' || element_index ELSE 'PowerPoint-Bild' END AS text,
  CASE WHEN element_index % 15 <> 4 THEN page_number ELSE 1 END AS page_number, {b64('text')} AS image_base64,
  CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/gif' ELSE 'image/jpeg' END AS image_mime_type
FROM e WHERE doc_id % 6 <> 5 AND text <> ''"""
    q["hook_pictures"] = q["picture_elements"].replace("AS image_mime_type\n", "AS image_mime_type, CAST(NULL AS VARCHAR) AS hook_error\n")
    q["slide_pictures"] = f"""WITH {SLIDES}
SELECT doc_id, slide, 'Picture' AS type, CAST(k AS INTEGER) AS shape_index, CAST(NULL AS INTEGER) AS child_index, {b64('line')} AS base64,
  'image/jpeg' AS mime_type, coalesce(name, 'Bild auf Slide ' || slide) AS alt_text, CAST(100 AS BIGINT) AS width, CAST(NULL AS BIGINT) AS height
FROM sh WHERE k = 2
UNION ALL
SELECT doc_id, slide, 'Picture (Grouped)', CAST(k AS INTEGER), 0, {b64('line')}, 'image/png',
  CASE WHEN doc_id % 2 = 0 THEN 'child' ELSE 'Gruppiertes Bild auf Slide ' || slide END, 10, 20 FROM sh WHERE k = 3"""
    q["partition_status"] = """SELECT doc_id, CASE WHEN doc_id % 7 = 3 AND doc_id % 21 = 3 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN doc_id % 7 = 3 THEN 'open_source_local' ELSE 'open_source_pdf_optimized_no_forms' END AS method,
  CASE WHEN doc_id % 7 = 3 AND doc_id % 21 = 3 THEN 'no parser could read the document' END AS error,
  CASE WHEN NOT (doc_id % 7 = 3 AND doc_id % 21 = 3) THEN CAST(len(string_split(text, chr(10))) AS INTEGER) END AS element_count FROM documents"""
    sql_types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def flat(name: str, kind: str) -> str:
        if name not in RICH_FIELDS:
            return f"CAST(NULL AS {sql_types.get(kind, 'VARCHAR')}) AS {name}"
        if name == "image_base64":
            return "md5(image_base64) AS image_base64"
        return f"{js(name)} AS {name}" if kind.startswith("array") else name

    q["json_roundtrip"] = rich(", ".join(flat(*x) for x in ELEMENT_COLUMNS.items()))
    again = "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'Neue Fassung' || chr(10) || text ELSE text END"
    q["stream_replace"] = f"""WITH up AS (SELECT doc_id, source, lang, {again} AS text FROM documents),
{TEXT.replace('FROM documents', 'FROM up WHERE text IS NOT NULL')} SELECT doc_id, element_index, element_type, text, page_number FROM e"""

    unknown = obj(**{"it''s": f"CASE WHEN element_index % 3 = 0 THEN {js("['p', left(text, 7)]")} END", "x_flag": "CASE WHEN element_index % 3 = 0 THEN CASE WHEN element_index % 2 = 1 THEN 'true' ELSE 'false' END END",
        "x_nested": f"CASE WHEN element_index % 2 = 0 THEN {obj(a=js('element_type'), b='CAST(element_index AS VARCHAR)')} END", "x_text": "CASE WHEN element_index % 3 = 0 THEN '\"7\"' END"})
    q["json_unknown_members"] = rich(f"doc_id, element_index, element_type, text, nullif({unknown}, '{{}}') AS extra")
    codes = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in CODES.items())
    runs = rf"""list_transform(range(len(p) - 2), lambda i: CAST((p[i + 1] * 1369 + p[i + 2] * 37 + p[i + 3]) % {BUCKETS} AS INTEGER))"""
    points = r"list_transform(string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', ''), lambda c: unicode(c))"
    q["element_languages"] = f"""WITH {TEXT}, iso(two, three) AS (VALUES {codes}),
dp AS (SELECT three AS code, {points} AS p FROM documents JOIN iso ON lang = two),
dc AS (SELECT code, bucket, count(*) AS n FROM (SELECT code, unnest({runs}) AS bucket FROM dp WHERE len(p) > 2) GROUP BY 1, 2),
dr AS (SELECT code, bucket, row_number() OVER (PARTITION BY code ORDER BY n DESC, bucket) AS rank FROM dc),
pf AS (SELECT code, bucket, CAST({TOP} - floor(log2(rank) + 1e-9) AS INTEGER) AS score FROM dr WHERE floor(log2(rank) + 1e-9) < {TOP}),
ep AS (SELECT doc_id, element_index, {points} AS p FROM e),
er AS (SELECT doc_id, element_index, unnest({runs}) AS bucket FROM ep WHERE len(p) > 2),
es AS (SELECT doc_id, element_index, code, sum(score) AS s FROM er JOIN pf USING (bucket) GROUP BY 1, 2, 3),
ea AS (SELECT doc_id, element_index, code, coalesce(s, 0) AS s FROM e CROSS JOIN (SELECT DISTINCT code FROM pf) LEFT JOIN es USING (doc_id, element_index, code)),
eb AS (SELECT *, max(s) OVER w AS best, pow(2.0, s - max(s) OVER w) AS weight FROM ea WINDOW w AS (PARTITION BY doc_id, element_index)),
ew AS (SELECT *, weight / sum(weight) OVER (PARTITION BY doc_id, element_index) AS probability FROM eb),
ek AS (SELECT *, row_number() OVER (PARTITION BY doc_id, element_index ORDER BY probability DESC, code) AS k FROM ew)
SELECT doc_id, element_index, coalesce(first(code ORDER BY k) FILTER (WHERE best > 0), 'und') AS language,
  coalesce(string_agg(code, '|' ORDER BY k) FILTER (WHERE best > 0 AND (k = 1 OR probability >= {SHARE})), '') AS languages,
  round(coalesce(max(probability) FILTER (WHERE best > 0), 0.0), 6) AS probability
FROM ek GROUP BY 1, 2"""
    q["intake_parts"] = f"""WITH {TEXT}, {HTML},
x AS (
  SELECT 'text' AS body, doc_id, element_index, text AS content, true AS good FROM e WHERE doc_id % 13 <> 5
  UNION ALL SELECT 'json', doc_id, NULL, text, true FROM documents WHERE doc_id % 13 <> 5 AND doc_id % 7 <> 2
  UNION ALL SELECT 'html', doc_id, element_index, text, true FROM h0 WHERE doc_id % 13 NOT IN (5, 6)
  UNION ALL SELECT 'text', doc_id, NULL, 'no text', false FROM documents WHERE doc_id % 13 = 5
  UNION ALL SELECT 'json', doc_id, NULL, CASE WHEN doc_id % 13 = 5 THEN 'no json' ELSE 'not an element with a document number' END, false
    FROM documents WHERE doc_id % 13 = 5 OR doc_id % 7 = 2
  UNION ALL SELECT 'html', page_id, NULL, CASE page_id % 13 WHEN 5 THEN 'no html' ELSE 'nothing visible' END, false FROM pages WHERE page_id % 13 IN (5, 6))
SELECT body, doc_id, element_index, content, count(*) OVER (PARTITION BY body, good) AS counted FROM x"""

    # Sinks and serialisation.
    q["rag_jsonl"] = f"WITH {RAG} SELECT doc_id, element_index, {RAG_LINE} AS line FROM g"
    q["rag_json_array"] = f"""WITH {RAG} SELECT doc_id, segment, documents, {bracketed('json')} AS json FROM (
  SELECT doc_id, {seg(ROWS)} AS segment, count(*) AS documents, {agg(RAG_LINE, lit(','))} AS json,
    {seg(ROWS)} = min({seg(ROWS)}) OVER (PARTITION BY doc_id) AS opens, {seg(ROWS)} = max({seg(ROWS)}) OVER (PARTITION BY doc_id) AS closes
  FROM g GROUP BY doc_id, {seg(ROWS)})"""
    q["rag_preview"] = f"""WITH {RAG} SELECT doc_id, element_index, {RAG_LINE} AS line, count(*) OVER (PARTITION BY doc_id) > 5 AS is_preview
FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY element_index) <= 5"""
    q["elements_json"] = rich(f"doc_id, element_index, {ELEMENT_JSON} AS json")
    q["elements_full_json"] = rich(f"doc_id, element_index, {FULL_JSON} AS json")
    for title, decorated in (("all_formats", False), ("all_formats_images", True)):
        q[title] = f"""WITH {RICH}, a AS (
  SELECT doc_id, segment, {agg("t", BL)} AS text, {agg("h", NL)} AS html, {agg("m", BL)} AS markdown, {agg("j", lit(","))} AS json, {FIRST_LAST}
  FROM (SELECT doc_id, element_index, {seg(ROWS)} AS segment, nullif({S}, '') AS t, {html(decorated, decorated)} AS h, {markdown(decorated, decorated)} AS m, {ELEMENT_JSON} AS j FROM r)
  GROUP BY 1, 2)
SELECT doc_id, segment, text, CASE WHEN html IS NOT NULL OR opens OR closes THEN {paged('html')} END AS html, markdown, {bracketed('json')} AS json FROM a"""
    q["image_files"] = rich(
        f"doc_id, element_index, {FILE_NAME} AS filename, CAST(octet_length(from_base64(image_base64)) AS INTEGER) AS size_bytes, md5(from_base64(image_base64)) AS content_md5",
        PAYLOAD,
    )
    q["image_manifest"] = f"""WITH {MANIFEST} SELECT * EXCLUDE (packaged),
  CAST(row_number() OVER (PARTITION BY doc_id, filename ORDER BY element_index) AS INTEGER) AS name_rank FROM mf"""
    summary = f"""SELECT doc_id, CASE WHEN count(*) FILTER (WHERE {PAYLOAD}) > 0 THEN 'success' ELSE 'warning' END AS status,
  arg_min(coalesce(filename, source), element_index) AS source_document, '2025-01-01' AS export_date,
  count(*) FILTER (WHERE {PAYLOAD}) AS total_images, count(*) FILTER (WHERE {PAYLOAD}) AS images_included,
  CAST(coalesce(sum(octet_length(from_base64(image_base64))) FILTER (WHERE {PAYLOAD}), 0) AS BIGINT) AS total_size_bytes FROM r GROUP BY 1"""
    q["manifest_summary"] = f"WITH {RICH} {summary}"
    info = ", ".join(f"{lit(v)} AS {k}" for k, v in IMPORT_INFO.items())
    q["package_summary"] = f"""WITH {RAG}, ms AS ({summary})
SELECT ms.doc_id, source_document, export_date, coalesce(total_elements, 0) AS total_elements, total_images, {lit(RAG_FORMAT)} AS rag_format,
  images_included, {info} FROM ms LEFT JOIN (SELECT doc_id, count(*) AS total_elements FROM g GROUP BY 1) USING (doc_id)"""
    name = lambda f: f"doc_id || {lit(OUTPUT_SUFFIXES[f])} AS out_name"
    cut = seg(IMAGE_SEGMENT_ROWS)
    closes = f"{cut} = max({cut}) OVER (PARTITION BY doc_id) AS closes"
    q["output_files"] = f"""WITH {INLINE}, {HTML_IMAGES}
SELECT doc_id, 'text' AS format, {cut} AS segment, {name('text')}, {agg(f"nullif({S}, '')", BL)} AS body FROM r GROUP BY 1, 3 HAVING body IS NOT NULL
UNION ALL SELECT doc_id, 'html', segment, {name('html')}, html FROM ({RENDER_HTML})
UNION ALL SELECT doc_id, 'markdown', {cut}, {name('markdown')}, {agg(markdown(False, False), BL)} AS body FROM r GROUP BY 1, 3 HAVING body IS NOT NULL
UNION ALL SELECT doc_id, 'json', segment, {name('json')}, {bracketed('json')} FROM (
  SELECT doc_id, {cut} AS segment, {agg(ELEMENT_JSON, lit(','))} AS json, {cut} = 0 AS opens, {closes} FROM r GROUP BY doc_id, {cut})
UNION ALL SELECT doc_id, 'markdown_images', segment, {name('markdown_images')}, markdown FROM ({RENDER_MD})
UNION ALL SELECT doc_id, 'rag_json', segment, {name('rag_json')}, {bracketed('json')} FROM (
  SELECT doc_id, {cut} AS segment, {agg(INLINE_JSON, lit(','))} AS json, {cut} = 0 AS opens, {closes} FROM iq WHERE NOT "describe" GROUP BY doc_id, {cut})"""
    page = f"{lit(m.HTML_OPEN)} || {NL} || coalesce({agg('part', NL)} || {NL}, '') || '</div>'"
    whole = {
        "text": f"SELECT doc_id, {agg(f"nullif({S}, '')", BL)} AS body FROM r GROUP BY 1",
        "html": f"SELECT doc_id, {page} AS body FROM h GROUP BY 1",
        "markdown": f"SELECT doc_id, {agg(markdown(False, False), BL)} AS body FROM r GROUP BY 1",
        "json": f"SELECT doc_id, '[' || {agg(ELEMENT_JSON, lit(','))} || ']' AS body FROM r GROUP BY 1",
        "markdown_images": f"SELECT doc_id, {agg(markdown(True, True), BL)} AS body FROM r GROUP BY 1",
        "rag_json": f"""SELECT doc_id, '[' || {agg(INLINE_JSON, lit(','))} || ']' AS body FROM iq WHERE NOT "describe" GROUP BY 1""",
    }
    files_of = " UNION ALL ".join(
        f"SELECT {name(f)}, CAST(octet_length(encode(body)) AS BIGINT) AS length, sha256(body) AS sha256 FROM ({body}) WHERE body IS NOT NULL" for f, body in whole.items()
    )
    q["written_files"] = f"""WITH {INLINE}, {HTML_IMAGES} {files_of}
UNION ALL SELECT DISTINCT doc_id || '_images/' || {FILE_NAME}, CAST(octet_length(from_base64(image_base64)) AS BIGINT), sha256(from_base64(image_base64)) FROM r WHERE {PAYLOAD}"""
    q["package_readback"] = f"""WITH {RAG} SELECT doc_id, element_index, 'line' AS part, md5({RAG_LINE}) AS digest, CAST(NULL AS VARCHAR) AS filename FROM g
UNION ALL SELECT doc_id, element_index, 'image', md5(from_base64(image_base64)), {PACKED_NAME} FROM r WHERE {PAYLOAD}"""
    q["elements_csv"] = rich(
        f"doc_id, element_index, {quoted('element_type')} || ',' || {quoted('element_uid')} || ',' || {quoted('text')} || ',' || "
        f"coalesce({quoted('page_number')}, '\"\"') AS csv"
    )

    # Projections and filters.
    q["nonempty_elements"] = rich("doc_id, element_index, element_type, text", f"{S} <> ''")
    q["element_details"] = rich(DETAILS)
    q["image_gallery"] = rich(
        f"doc_id, element_index, element_type, image_base64, {MIME_JPEG} AS mime_type, {S} AS caption, page_number", PAYLOAD
    )
    q["analysis_images"] = rich(
        f"doc_id, element_index, element_type, {S} AS text, image_base64 IS NOT NULL AS has_base64, image_base64 AS base64_data, "
        f"CASE WHEN image_base64 IS NOT NULL THEN {MIME_JPEG} END AS mime_type",
        f"{CLASS} = 'image'",
    )
    q["analysis_tables"] = rich(f"doc_id, element_index, {S} AS text, text_as_html, page_name", f"{CLASS} = 'table'")
    q["special_elements"] = rich(DETAILS, f"{CLASS} = 'special'")
    q["hierarchies"] = rich(
        f"doc_id, element_index, element_type, parent_id, category_depth, {PRE}", "parent_id IS NOT NULL OR category_depth IS NOT NULL"
    )
    q["coordinates_rows"] = rich(f"doc_id, element_index, element_type, coordinates, {PRE}", "coordinates IS NOT NULL")
    q["language_rows"] = rich(f"doc_id, element_index, element_type, {joined('languages')} AS languages, {PRE}", "languages IS NOT NULL")
    q["emphasis_rows"] = rich(
        f"doc_id, element_index, element_type, {joined('emphasized_text_contents')} AS contents, {joined('emphasized_text_tags')} AS tags, {PRE}",
        "emphasized_text_contents IS NOT NULL",
    )
    q["link_rows"] = rich(
        f"doc_id, element_index, element_type, 0 AS link_index, links[1].url AS url, substring({S}, 1, 100) AS text, page_number", "links IS NOT NULL"
    )
    q["html_links"] = f"""WITH {HTML} SELECT doc_id, element_index, CAST(unnest(range(len(link_urls))) AS INTEGER) AS link_index, unnest(link_urls) AS url,
  unnest(link_texts) AS link_text, substring(text, 1, 100) AS text FROM h WHERE len(link_urls) > 0"""
    q["image_url_rows"] = rich("doc_id, element_index, image_url AS url", "image_url IS NOT NULL")
    q["email_rows"] = rich(
        """doc_id, element_index, CASE WHEN doc_id % 6 <> 0 THEN sent_from END AS sent_from, CASE WHEN doc_id % 6 <> 0 THEN sent_to END AS sent_to,
  CASE WHEN doc_id % 2 = 0 THEN 'c@example.org' END AS cc_recipient, CASE WHEN doc_id % 3 = 0 THEN 'd@example.org' END AS bcc_recipient, subject,
  '<' || doc_id || '@example.org>' AS email_message_id, CASE WHEN doc_id % 4 = 0 THEN 'Best' END AS signature,
  CASE WHEN doc_id % 7 = 0 THEN 'm' || doc_id || '.eml' END AS attached_to_filename""",
        "sent_from IS NOT NULL",
    )
    q["header_footer_rows"] = rich(f"doc_id, element_index, header_footer_type AS type, substring({S}, 1, 100) AS text", "header_footer_type IS NOT NULL")
    q["section_rows"] = rich(f"doc_id, element_index, section, substring({S}, 1, 100) AS text", "section IS NOT NULL")
    q["embedded_images"] = rich(
        "doc_id, element_index, image_path AS path, image_base64 IS NOT NULL AS has_base64, image_mime_type AS mime_type",
        "image_path IS NOT NULL OR image_base64 IS NOT NULL",
    )

    # Joins and lookups.
    q["slide_layout_join"] = f"WITH {SLIDES}, {LAYOUTS}, {LAYOUT_JOIN} SELECT doc_id, slide, layout_name FROM lj"
    q["slide_footer_join"] = f"WITH {SLIDES} SELECT doc_id, slide, footer_text, slide_number, date_text, notes FROM sd"
    q["rag_image_join"] = f"""WITH {RAG}, {MANIFEST[len(RICH) + 1:].lstrip()},
f AS (SELECT doc_id, hash, arg_min(packaged, element_index) AS filename FROM mf GROUP BY 1, 2)
SELECT g.doc_id, element_index, image_hash, filename FROM g LEFT JOIN f ON g.doc_id = f.doc_id AND g.image_hash = f.hash WHERE image_hash IS NOT NULL"""
    q["rag_image_orphans"] = f"""WITH {INLINE}, {MANIFEST[len(RICH) + 1:].lstrip().replace(f"{HASH} AS hash", f"{PREFIX_HASH} AS hash")}
SELECT doc_id, element_index, image_hash FROM iq WHERE NOT "describe" AND image_hash IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM mf WHERE mf.doc_id = iq.doc_id AND mf.hash = iq.image_hash)"""
    q["vision_enrich"] = f"""WITH {DESCRIBED} SELECT doc_id, element_index, element_type, image_hash, image_described, vision_model,
  vision_cost_estimate, content FROM gd"""

    q["vision_fallback"] = f"""WITH {DESCRIBED},
x AS (SELECT g0.doc_id, g0.element_index, g0.content, {MIME_PNG} AS mime, ds.image_hash IS NULL AS missing, description, model, cost_estimate
  FROM g0 JOIN r USING (doc_id, element_index) LEFT JOIN ds ON g0.image_hash = ds.image_hash WHERE g0.image_hash IS NOT NULL)
SELECT doc_id, element_index, CASE WHEN missing THEN 'Fallback' ELSE model END AS vision_model,
  CASE WHEN missing THEN CAST(0 AS DOUBLE) ELSE cost_estimate END AS vision_cost_estimate,
  content || {BL} || '[Vision-Beschreibung]: ' || coalesce(description, 'Bild-Element (Typ: ' || mime || ')') AS content
FROM x WHERE missing OR description <> content"""

    # Aggregations.
    q["type_counts"] = rich("doc_id, element_type, count(*) AS count", "", "GROUP BY 1, 2")
    q["partition_summary"] = rich(
        f"doc_id, count(*) AS element_count, count(*) FILTER (WHERE element_type IN {IMAGE}) AS image_elements, count(*) FILTER (WHERE {PAYLOAD}) AS image_base64", "", "GROUP BY 1"
    )
    q["text_metrics"] = f"""WITH {RICH}, t AS (SELECT doc_id, nullif({S}, '') AS t FROM r)
SELECT doc_id, count(*) AS total_elements, CAST(coalesce(sum(length(t) + 1), 0) AS BIGINT) AS total_characters,
  CAST(coalesce(sum(len(regexp_extract_all(t, {lit(WORD)}))), 0) AS BIGINT) AS total_words,
  CAST(coalesce(sum(length(t) - length(replace(replace(replace(t, '.', ''), '!', ''), '?', ''))), 0) AS BIGINT) AS total_sentences,
  round(coalesce(avg(length(t)), 0.0), 6) AS average_element_length FROM t GROUP BY 1"""
    q["contact_totals"] = f"WITH {TEXT} SELECT doc_id, " + ", ".join(
        f"CAST(sum(len(regexp_extract_all({S}, {lit(p)}))) AS BIGINT) AS total_{k}s" for k, p in CONTACT_PATTERNS.items()
    ) + " FROM e GROUP BY 1"
    q["analysis_totals"] = rich(
        f"""doc_id, count(*) AS total_elements, count(*) FILTER (WHERE {CLASS} = 'image') AS total_images, count(*) FILTER (WHERE {CLASS} = 'table') AS total_tables,
  count(*) FILTER (WHERE {PAYLOAD}) AS gallery_images, count(*) FILTER (WHERE element_type = 'Table') AS exported_tables, count(DISTINCT page_name) AS total_sheets""",
        "",
        "GROUP BY 1",
    )
    q["rag_pages"] = f"""WITH {RICH} SELECT doc_id, coalesce(page_number, 1) AS page, {seg(SEGMENT_ROWS)} AS segment, min(element_index) AS page_order,
  arg_min(coalesce(filename, source), element_index) AS source, coalesce(arg_min(filetype, element_index), 'unknown') AS document_type,
  count(*) AS element_count, array_to_string(list_sort(list(DISTINCT element_type)), '|') AS element_types,
  first(languages[1] ORDER BY element_index) AS language, {agg(S, BL)} AS content
FROM r WHERE {S} <> '' AND element_type <> 'PageBreak' GROUP BY 1, 2, 3"""
    q["image_stats"] = f"""WITH {DESCRIBED} SELECT doc_id, count(*) FILTER (WHERE element_type IN {IMAGE}) AS total_images, count(*) FILTER (WHERE image_described) AS images_described,
  count(*) FILTER (WHERE element_type IN {IMAGE} AND NOT image_described) AS images_failed, round(coalesce(sum(vision_cost_estimate), 0.0), 6) AS total_cost_estimate
FROM gd GROUP BY 1"""
    q["vision_models"] = f"WITH {DESCRIBED} SELECT doc_id, vision_model AS model, count(*) AS count FROM gd WHERE image_described GROUP BY 1, 2"
    q["inline_rag_stats"] = f"""WITH {INLINE} SELECT doc_id, count(*) AS elements, count(*) FILTER (WHERE image_available) AS images_available,
  count(*) FILTER (WHERE image_available AND image_described) AS images_described FROM iq WHERE "describe" GROUP BY 1"""
    q["clean_counts"] = f"WITH {MESSY} SELECT doc_id, count(*) AS original_count, count(*) AS cleaned_count, count(*) FILTER (WHERE text <> {CLEAN}) AS changed_count FROM ms GROUP BY 1"
    q["details_by_type"] = rich(
        f"doc_id, element_type, {seg(SEGMENT_ROWS)} AS segment, count(*) AS count, {agg('CAST(element_index AS VARCHAR)', lit(','))} AS indexes",
        "",
        "GROUP BY 1, 2, 3",
    )
    q["sheet_names"] = rich("DISTINCT doc_id, page_name", "page_name IS NOT NULL")
    titled = f"k <> 2 AND {strip('t')} <> '' AND k * 400000 < 1000000"
    q["slide_layout"] = f"""WITH {SLIDES} SELECT doc_id, slide, 'Layout ' || (slide % 4) AS layout_name, CAST(count(*) AS INTEGER) AS shape_count,
  bool_or({titled}) AS has_title, bool_or(k = 2) AS has_images, bool_or(k = 1 AND doc_id % 2 = 0) AS has_tables,
  substring(arg_max({strip('t')}, k) FILTER (WHERE {titled}), 1, 100) AS title_text FROM sh GROUP BY 1, 2, 3"""
    q["slide_footers"] = f"WITH {SLIDES} SELECT doc_id, slide, footer_text, slide_number, date_text, notes FROM sd"
    q["slide_footer_summary"] = f"""WITH {SLIDES} SELECT doc_id, bool_or(footer_text IS NOT NULL) AS has_footer, bool_or(slide_number IS NOT NULL) AS has_slide_numbers,
  bool_or(date_text IS NOT NULL) AS has_date, count(footer_text) AS footer_count, count(notes) AS notes_count FROM sd GROUP BY 1"""
    basic, titles = chunks("e", TEXT, False), chunks("s", SECTIONED, True)
    q["chunk_counts"] = f"{basic} SELECT doc_id, count(*) AS chunk_count, 'basic' AS strategy FROM ch GROUP BY 1"

    # Ordered operators.
    q["reindexed_elements"] = rich(
        "doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY element_index) - 1 AS INTEGER) AS element_index, element_uid, element_type",
        f"{S} <> '' AND element_type <> 'PageBreak'",
    )
    q["chunk_basic"] = f"{basic} SELECT * FROM ch"
    q["chunk_by_title"] = f"{titles} SELECT * FROM ch"
    step = MAX - OVERLAP
    q["split_oversized"] = f"""WITH {TEXT}, n AS (SELECT *, CASE WHEN length(text) > {MAX} THEN CAST(ceil((length(text) - {OVERLAP}) / {float(step)}) AS INTEGER) ELSE 1 END AS pieces FROM e),
x AS (SELECT *, unnest(range(pieces)) AS k FROM n)
SELECT doc_id, element_index, element_type, CAST(k AS INTEGER) AS piece,
  CASE WHEN pieces = 1 THEN text ELSE substring(text, k * {step} + 1, {MAX}) END AS piece_text FROM x"""
    q["element_preview"] = f"""WITH {RICH} SELECT doc_id, element_index, element_type,
  CASE WHEN length({S}) > 300 THEN substring({S}, 1, 300) || '...' ELSE {S} END AS preview, remaining
FROM r JOIN (SELECT doc_id, greatest(count(*) - 5, 0) AS remaining FROM r GROUP BY 1) USING (doc_id) WHERE element_index < 5 AND {S} <> ''"""

    # Contacts, text and tables.
    q["contacts"] = f"""WITH {TEXT}, {URLS}, x AS (SELECT doc_id, element_index, element_type, text FROM e
  UNION ALL SELECT -doc_id, element_index, element_type, text FROM u) {found('x', tuple(CONTACT_PATTERNS))}"""
    for key, kind in (("contact_emails", "email"), ("contact_phones", "phone"), ("contact_ips", "ip")):
        q[key] = f"WITH {TEXT} {found('e', (kind,))}"
    q["contact_urls"] = f"WITH {URLS} {found('u', ('url',))}"
    q["clean_text"] = f"WITH {MESSY} SELECT doc_id, element_index, {CLEAN} AS text FROM ms"
    q["group_paragraphs"] = f"WITH {MESSY} SELECT doc_id, element_index, {PARAGRAPHS} AS text FROM ms"
    q["table_csv"] = f"WITH {MESSY} SELECT doc_id, element_index, {S} AS text, text_as_html AS html, {CSV} AS csv FROM ms WHERE element_type = 'Table'"

    # Image functions.
    q["image_hash_prefix"] = rich(f"doc_id, element_index, {PREFIX_HASH} AS image_hash", "image_base64 IS NOT NULL")
    q["image_hash_full"] = rich(f"doc_id, element_index, {HASH} AS image_hash", "image_base64 IS NOT NULL")
    q["image_ext"] = rich(f"doc_id, element_index, {EXT} AS extension, split_part({MIME_PNG}, '/', 2) AS subtype")
    q["image_file_names"] = rich(f"doc_id, element_index, {FILE_NAME} AS filename, {PACKED_NAME} AS packaged", PAYLOAD)
    q["base64_roundtrip"] = f"""WITH {TEXT} SELECT doc_id, element_index, CASE WHEN doc_id % 9 = 0 THEN '@@@' ELSE {b64('text')} END AS payload,
  CASE WHEN doc_id % 9 <> 0 THEN CAST(strlen(text) AS INTEGER) END AS size_bytes, CASE WHEN doc_id % 9 <> 0 THEN true END AS same FROM e"""
    q["inline_image_files"] = rich(
        f"doc_id, element_index, {HASH} AS hash, {MIME_PNG} AS mime_type, {HASH} || '.' || split_part({MIME_PNG}, '/', 2) AS filename, {S} AS element_text",
        PAYLOAD,
    )

    # Markup.
    q["heading_levels"] = rich(f"doc_id, element_index, {LEVEL} AS level, {DEPTH} * 20 AS indent_pixels, repeat('  ', {DEPTH}) AS indent")
    q["emphasis_markup"] = rich(f"doc_id, element_index, {HTML_EMPHASIS} AS html, {MD_EMPHASIS} AS markdown")
    q["link_markup"] = rich(
        f"doc_id, element_index, {HTML_LINKS} AS html, {linked(m.MD_LINK, m.MD_LINK_DEFAULT, m.MD_LINK)} AS markdown"
    )
    q["badges"] = rich(f"doc_id, element_index, {BADGES} AS badges")
    q["redact_data_urls"] = f"""WITH {RICH}, md AS ({RENDER_MD})
SELECT doc_id, segment, regexp_replace(markdown, '!\\[([^\\]]*)\\]\\(data:image/[^)]+\\)', '🖼️ [Bild: \\1]', 'g') AS markdown FROM md"""
    q["render_sizes"] = f"""WITH {RICH}, md AS ({RENDER_MD})
SELECT doc_id, segment, CAST(length(markdown) AS INTEGER) AS chars, round(length(markdown) / 1048576.0, 6) AS size_mb,
  CASE WHEN length(markdown) > 5000 THEN substring(markdown, 1, 5000) || {lit(render.CODE_PREVIEW_NOTICE)} ELSE markdown END AS code_preview FROM md"""

    # Retrieval documents.
    q["rag_metadata"] = f"WITH {RAG} SELECT * EXCLUDE (content) FROM g"
    q["rag_content"] = f"""WITH {DESCRIBED} SELECT doc_id, element_index, false AS "describe", content FROM g
UNION ALL SELECT doc_id, element_index, true, content FROM gd"""
    q["chunk_hint"] = f"""WITH {TEXT}, n AS (SELECT doc_id, count(*) AS elements FROM e GROUP BY 1)
SELECT doc_id, elements, format_type, strategy, chunk_size, 50 AS overlap
FROM n CROSS JOIN (VALUES ('element', 'semantic', 300), ('page', 'fixed_size', 512)) v(format_type, strategy, chunk_size)"""
    q["inline_rag"] = f"WITH {INLINE} SELECT *, {INLINE_JSON} AS json FROM iq"

    # Rendering.
    q["render_text"] = rich(f"doc_id, {seg(ROWS)} AS segment, {agg(S, BL)} AS text", f"{S} <> ''", "GROUP BY 1, 2")
    q["render_html"] = f"WITH {RICH}, {HTML_IMAGES} {RENDER_HTML}"
    q["render_markdown"] = f"WITH {RICH} {RENDER_MD}"
    q["render_slides"] = slide_html()
    return q
