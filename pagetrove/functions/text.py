"""Text and HTML column functions.

The patterns keep to what both Java and RE2 understand (no look-around, explicit whitespace
sets), so a SQL check can use the same text.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrove.functions.bind import bind

# All whitespace a browser's trim removes, as a set of characters and as a pattern.
BLANK_CHARS = "\t\n\v\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK = r"[\x09-\x0D \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
# What browsers show for the references 128 to 159; five of them have no character there.
LOW_REFERENCES = bytes(range(128, 160)).decode("cp1252", "replace")

def _blocks(*tags: str) -> str:
    return "|".join(rf"{tag}\b.*?</{tag}\s*>" for tag in tags)


# Alternatives share their first character, so most positions are ruled out by one comparison.
SCRIPTS = rf"(?is)<(?:!--.*?-->|{_blocks('script', 'style', 'noscript', 'template')})"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
HEAD_AND_DRAWINGS = rf"(?is)<(?:{_blocks('head', 'svg')})"
CONTAINERS = tuple(rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>" for tag in ("article", "main", "body"))
SIDE_BLOCKS = rf"(?is)<(?:{_blocks('nav', 'footer', 'aside', 'form', 'header')})"
FIRST_PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)(?:</?p\b|\z)"
BLOCK_ENDS = r"(?is)<(?:/(?:p|h[1-6]|li|div)\s*>|p\b[^>]*>|br\s*/?>\s*<br\s*/?>)"
ANY_TAG = r"(?s)<[^>]+>"
BLOCK_TAG = (
    r"(?is)</?(?:address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr"
    r"|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|tr|ul)\b[^>]*>"
)
ANCHOR = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
# What a block costs in characters, and what each character of a link's text costs beside itself.
BLOCK_COST, LINK_COST = 40, 2


def _meta(key: str, value: str) -> tuple[str, str]:
    """Patterns of a meta tag's quoted content, for the key before the content and after it."""
    name, content = rf"""\b{key}\s*=\s*["']?{value}["'\s/>]""", r"""\bcontent\s*=\s*("[^"]*"|'[^']*')"""
    return rf"(?is)<meta\b[^>]*{name}[^>]*{content}", rf"(?is)<meta\b[^>]*{content}[^>]*{name}"


META_DESCRIPTION = _meta("name", "description")
META_SITE_NAME = _meta("property", "og:site_name")
BASE_HREF = r"""(?is)<base\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
QUOTES = r"""^["']|["']$"""


def trim_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit of the chunk size."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def decode_entities(text: Column) -> Column:
    """Decode named and numeric character references once, left to right."""
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in ENTITIES.items())
    names = F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))

    def code_point(digits: Column, base: int) -> Column:
        def to_char(code: Column) -> Column:
            valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
            low = F.substring(F.lit(LOW_REFERENCES), (code - 127).cast("int"), F.lit(1))
            return F.when(code.between(128, 159) & (low != "\ufffd"), low).when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

        return bind(F.conv(digits, base, 10).cast("bigint"), to_char)

    def decode_named(piece: Column, name: Column) -> Column:
        char = (
            F.when(name == "", None)
            .when(name.rlike(r"^#[xX]0*[0-9A-Fa-f]{1,6}$"), code_point(F.substring(name, 3, 1 << 30), 16))
            .when(name.rlike(r"^#0*[0-9]{1,7}$"), code_point(F.substring(name, 2, 1 << 30), 10))
            .otherwise(F.element_at(names, name))
        )
        rest = F.substring(piece, F.length(name) + 2, 1 << 30)
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    def decode_piece(piece: Column) -> Column:
        return bind(F.regexp_extract(piece, r"^(#?[A-Za-z0-9]+);", 1), lambda name: decode_named(piece, name))

    def decode(pieces: Column) -> Column:
        decoded = F.array_join(F.transform(F.slice(pieces, 2, 1 << 30), decode_piece), "")
        return F.when(F.size(pieces) > 1, F.concat(F.element_at(pieces, 1), decoded)).otherwise(F.element_at(pieces, 1))

    return bind(F.split(text, "&"), decode)


def drop_scripts(html: Column) -> Column:
    """Remove comments and everything a reader never sees, so tags inside them do not count."""
    return F.regexp_replace(html, SCRIPTS, "")


def page_title(clean_html: Column) -> Column:
    """Text of the title elements; an empty string when there is none."""
    return decode_entities(F.array_join(F.regexp_extract_all(clean_html, F.lit(TITLE), 1), ""))


def article_html(clean_html: Column) -> Column:
    def pick(body: Column) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in CONTAINERS], body)

    return F.regexp_replace(bind(F.regexp_replace(clean_html, HEAD_AND_DRAWINGS, ""), pick), SIDE_BLOCKS, "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, ANY_TAG, "")


def article_text(article: Column, block_breaks: bool = True) -> Column:
    broken = F.regexp_replace(article, BLOCK_ENDS, "\n\n") if block_breaks else article
    return decode_entities(strip_tags(broken))


def dense_text(clean_html: Column) -> Column:
    """Text of the run of neighbouring blocks with the most text beside links.

    For pages that mark no article. Each block between two block-level tags is worth its
    characters, less those of links and a fixed cost; one pass over the blocks keeps the best sum of a run
    that ends at the block and the best run so far. Of equal runs the one that ends first counts, and
    of those the longest. Blocks are joined by an empty line; a page without a run of worth has ''.
    """
    def measured(block: Column) -> Column:
        links = F.array_join(F.transform(F.regexp_extract_all(block, F.lit(ANCHOR), 1), strip_tags), "")
        return bind(trim_blank(strip_tags(block)), lambda t: F.struct(
            t.alias("text"), (F.length(t) - LINK_COST * F.length(links) - BLOCK_COST).alias("worth")))

    def best_run(blocks: Column) -> Column:
        zero = F.lit(0)
        start = F.struct(zero.alias("at"), zero.alias("sum"), zero.alias("begin"), zero.alias("best"), F.lit(1).alias("first"), zero.alias("last"))

        def step(s: Column, block: Column) -> Column:
            at = s["at"] + 1
            begin = F.when(s["sum"] < 0, at).otherwise(F.greatest(s["begin"], F.lit(1)))
            total = F.greatest(s["sum"], zero) + block["worth"]
            return bind(F.struct(total.alias("sum"), begin.alias("begin")), lambda now: F.struct(
                at.alias("at"), now["sum"].alias("sum"), now["begin"].alias("begin"), F.greatest(s["best"], now["sum"]).alias("best"),
                F.when(now["sum"] > s["best"], now["begin"]).otherwise(s["first"]).alias("first"),
                F.when(now["sum"] > s["best"], at).otherwise(s["last"]).alias("last")))

        def texts(run: Column) -> Column:
            return F.array_join(F.transform(F.slice(blocks, run["first"], run["last"] - run["first"] + 1), lambda b: b["text"]), "\n\n")

        return bind(F.aggregate(blocks, start, step), lambda run: F.when(run["last"] == 0, "").otherwise(texts(run)))

    body = F.regexp_replace(F.regexp_replace(clean_html, HEAD_AND_DRAWINGS, ""), BLOCK_TAG, "\x01")
    blocks = F.filter(F.transform(F.split(body, "\x01"), measured), lambda b: b["text"] != "")
    return decode_entities(bind(blocks, best_run))


def article_summary(clean_html: Column, article: Column) -> Column:
    """Meta description, else the text of the first paragraph; NULL when there is neither."""
    picks = [*meta_contents(clean_html, META_DESCRIPTION), strip_tags(F.regexp_extract(article, FIRST_PARAGRAPH, 1))]
    found = F.coalesce(*[F.nullif(trim_blank(p), F.lit("")) for p in picks])
    return F.nullif(trim_blank(decode_entities(found)), F.lit(""))


def article_sitename(clean_html: Column) -> Column:
    found = F.coalesce(*[F.nullif(c, F.lit("")) for c in meta_contents(clean_html, META_SITE_NAME)])
    return F.nullif(decode_entities(found), F.lit(""))


def meta_contents(clean_html: Column, patterns: tuple[str, str]) -> list[Column]:
    return [unquoted(F.regexp_extract(clean_html, p, 1)) for p in patterns]


def unquoted(value: Column) -> Column:
    """An attribute's value without its quotes."""
    return F.regexp_replace(value, QUOTES, "")


def base_href(clean_html: Column) -> Column:
    """The address that a page's links are relative to, as written; an empty string when there is none."""
    return decode_entities(unquoted(F.regexp_extract(clean_html, BASE_HREF, 1)))


def sentence_count(paragraph: Column) -> Column:
    """Sentences of a trimmed paragraph: the places where an end mark, with its closing
    quotes or brackets, is followed by whitespace, plus one."""
    return F.regexp_count(paragraph, F.lit(SENTENCE_BREAK)) + 1


SENTENCE_BREAK = r"""[.!?]["'\x{2019}\x{201D})\]]*""" + BLANK


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]", "")
