"""HTML to text with built-in expressions only.

Raw-text elements and comments go first, by position, so that markup quoted in
a script cannot close anything. Dropped containers are found in one pass over
the tags with the stack of open elements: an end tag closes whatever is open
inside its element, and is passed over if there is no such element; so a
container that is never closed ends with its parent, as in a parser's tree.
What is left of the tags becomes a break between text nodes. A tag ends where
another '<' comes outside quotes, so that no page makes a pattern scan the rest
of it from every tag.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column, functions as F

from winnow import fixed_values as fixed
from winnow.functions import text as t

_BREAK = "\u0001"
_ATTRS = "(?:[^<>=]++|=\\s*+\"[^\"]*+\"|=\\s*+'[^']*+'|=)*+"
_RAW_TEXT_TAGS = {"script", "style"}
# Elements without an end tag.
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Elements that another of their kind ends, where their end tag is left out.
_ENDED_BY_THEIR_LIKE = "p li dt dd tr td th option".split()
# Bytes of the names of open elements; what nests deeper counts as not opened.
_DEEPEST = 8192
# Pieces of a page put together in one step.
_BLOCK = 256

# Named references from the standard library's table. The usual ones are tried
# first; the others lie in groups by checksum, so that few are read for each.
_USUAL = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "ndash;", "mdash;"]
_GROUPS = 512
_WITHOUT_SEMICOLON = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# Browsers read references to the unused range 128 to 159 as that encoding's characters.
_WINDOWS_1252 = {
    str(code): ord(bytes([code]).decode("cp1252")) for code in range(0x80, 0xA0) if bytes([code]).decode("cp1252", "ignore")
}


def _grouped_names() -> str:
    """The table of names as JSON: per group, its names and what they stand for."""
    groups: list[dict[str, list[str]]] = [{"n": [], "c": []} for _ in range(_GROUPS)]
    for name, char in html5.items():
        group = groups[crc32(name.encode()) % _GROUPS]
        group["n"].append(name)
        group["c"].append(char)
    return json.dumps(groups)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Work a value out once for an expression that names it more often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_entities(text: Column) -> Column:
    """One pass over character references, so '&amp;lt;' gives '&lt;' and not '<'."""
    groups = F.from_json(F.lit(_grouped_names()), "array<struct<n:array<string>,c:array<string>>>")
    windows = F.from_json(F.lit(json.dumps(_WINDOWS_1252)), "map<string,bigint>")

    def numeric(digits: Column) -> Column:
        hexed = F.lower(F.left(digits, F.lit(1))) == "x"
        code = F.when(hexed, F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).try_cast("bigint")
        code = F.when(code.between(0x80, 0x9F), F.coalesce(F.element_at(windows, code.cast("string")), code)).otherwise(code)
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, char).otherwise(F.lit("\ufffd"))

    def known(name: Column) -> Column:
        """What a name stands for, or null."""
        group = F.get(groups, (F.crc32(name.cast("binary")) % _GROUPS).cast("int"))
        return _let(group, lambda g: F.get(g["c"], (F.array_position(g["n"], name) - 1).cast("int")))

    def replaced(part: Column, name: Column, char: Column) -> Column:
        return F.concat(char, F.substr(part, F.length(name) + 1))

    def named(part: Column) -> Column:
        name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*;)", 1)
        # Some old names count without the semicolon, also where letters follow.
        bare = F.regexp_extract(part, f"^({_WITHOUT_SEMICOLON})", 1)
        whole = _let(name, lambda n: F.when(n != "", replaced(part, n, known(n))))
        return F.coalesce(whole, _let(bare, lambda n: F.when(n != "", replaced(part, n, known(n)))), F.concat(F.lit("&"), part))

    def piece(part: Column) -> Column:
        digits = F.regexp_extract(part, "^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        out = F.when(
            F.startswith(part, F.lit("#")),
            _let(digits, lambda d: F.when(d != "", F.concat(numeric(d), F.substr(part, F.length(d) + 3))).otherwise(F.concat(F.lit("&"), part))),
        )
        for name in _USUAL:
            out = out.when(F.startswith(part, F.lit(name)), F.concat(F.lit(html5[name]), F.substr(part, F.lit(len(name) + 1))))
        return out.otherwise(named(part))

    parts = F.split(text, "&")
    decoded = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(piece(p)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def drop_elements(html: Column, tags: list[str]) -> Column:
    """Replace comments and the named elements, content included, by a break."""
    raw = [tag for tag in tags if tag in _RAW_TEXT_TAGS]
    containers = [tag for tag in tags if tag not in _RAW_TEXT_TAGS]
    first = "(?is)<!--.*?(?:-->|\\z)"
    if raw:
        first += f"|<({'|'.join(raw)})(?=[\\s/>]){_ATTRS}>.*?(?:</\\1\\s*+>|\\z)"
    out = F.regexp_replace(html, first, _BREAK)
    if not containers:
        return out
    opened = F.lit(f"(?i)<(?:{'|'.join(containers)})(?=[\\s/>])")
    return _let(out, lambda markup: F.when(F.rlike(markup, opened), _without(markup, containers)).otherwise(markup))


def _without(markup: Column, containers: list[str]) -> Column:
    """The markup without the containers: one pass over its tags, which knows the open elements, innermost first."""
    tag = f"</?[A-Za-z]{_ATTRS}>"
    void = F.array(*[F.lit(v) for v in _VOID])
    dropped = F.array(*[F.lit(c) for c in containers])
    ended = F.array(*[F.lit(e) for e in _ENDED_BY_THEIR_LIKE])

    def up_to(open_: Column, name: Column) -> Column:
        """What is still open once the innermost element of that name has ended."""
        place = F.instr(F.concat(F.lit("/"), open_), F.concat(F.lit("/"), name, F.lit("/")))
        return F.when(place > 0, F.substring(open_, place + F.length(name) + 1, F.lit(_DEEPEST * 2))).otherwise(open_)

    def read(text: Column, after: Column) -> Column:
        name = F.lower(F.regexp_extract(text, "^</?([A-Za-z][^\\s/>]*)", 1))
        closes = F.startswith(text, F.lit("</"))
        opens = ~closes & ~F.endswith(text, F.lit("/>")) & ~F.array_contains(void, name)
        return F.struct(name.alias("name"), closes.alias("closes"), opens.alias("opens"), text.alias("text"), after.alias("after"))

    tags = F.regexp_extract_all(markup, F.lit(tag), F.lit(0))
    between = F.split(markup, tag, -1)
    items = F.zip_with(tags, F.slice(between, F.lit(2), F.size(between)), read)
    def moved(at: Column, item: Column) -> Column:
        """The stack, what is dropped and the piece to show after a tag."""
        open_, below = at["open"], at["below"]
        alike = F.array_contains(ended, item["name"]) & F.startswith(open_, F.concat(item["name"], F.lit("/")))
        body = item["opens"] & (item["name"] == "body")
        opened = (
            F.when(body, F.concat(F.lit("body/"), up_to(open_, F.lit("head"))))
            .when(item["opens"] & ~alike & (F.octet_length(open_) < _DEEPEST), F.concat(item["name"], F.lit("/"), open_))
            .when(item["closes"], up_to(open_, item["name"]))
            .otherwise(open_)
        )

        def told(opened: Column) -> Column:
            starts = item["opens"] & F.array_contains(dropped, item["name"]) & (F.octet_length(opened) > F.octet_length(open_))
            # What was open before and still is; a body that starts has ended the head first.
            left = F.octet_length(opened) - F.when(body, len("body/")).otherwise(0)
            still = F.when(below >= 0, F.when(left <= below, -1).otherwise(below)).when(starts, F.octet_length(open_)).otherwise(-1)

            def shown(still: Column) -> Column:
                # The tag that ends a container is its own, or that of an element around it, which stays.
                own = (below >= 0) & (left == below)
                piece = (
                    F.when(still >= 0, F.lit(_BREAK))
                    .when(own, F.concat(F.lit(_BREAK), item["after"]))
                    .otherwise(F.concat(item["text"], item["after"]))
                )
                return F.struct(opened.alias("open"), still.alias("below"), piece.alias("piece"))

            return _let(still, shown)

        return _let(opened, told)

    # A fold copies what it has gathered at every step. So one fold, which gathers
    # no more than where each block of tags starts, comes first, and short ones follow.
    start = F.struct(
        F.lit("").alias("open"),  # names of open elements, each with a '/' behind it
        F.lit(-1).alias("below"),  # bytes of `open` that lie below the container that is being dropped; -1: none is
        F.lit("").alias("piece"),
    )

    def in_order(items: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
        return _let(F.transform(places, lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK))), in_blocks)

    def in_blocks(blocks: Column) -> Column:
        starts = F.aggregate(
            F.slice(blocks, F.lit(1), F.size(blocks) - 1),
            F.array(start),
            lambda starts, block: F.concat(starts, F.array(F.aggregate(block, F.element_at(starts, -1), moved))),
        )
        kept = F.zip_with(
            blocks,
            starts,
            lambda block, at: F.aggregate(
                block,
                F.struct(at.alias("at"), F.array().cast("array<string>").alias("pieces")),
                lambda s, item: _let(
                    moved(s["at"], item), lambda at: F.struct(at.alias("at"), F.concat(s["pieces"], F.array(at["piece"])).alias("pieces"))
                ),
                lambda s: F.array_join(s["pieces"], ""),
            ),
        )
        return F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))

    return _let(items, in_order)


def _text_nodes(markup: Column) -> Column:
    bare = F.regexp_replace(markup, f"(?s)<[!?][^>]*+>|</?[A-Za-z]{_ATTRS}>", _BREAK)
    nodes = F.transform(F.split(bare, _BREAK + "+"), lambda node: t.strip(decode_entities(node)))
    return F.filter(nodes, lambda node: node != "")


def text_of(html: Column, drop_tags: list[str]) -> Column:
    """One stripped text node per line."""
    return F.array_join(_text_nodes(drop_elements(html, drop_tags)), "\n")


def element_text(markup: Column, tag: str) -> Column:
    """Text of the first such element, its nodes stripped and run together; null if there is none."""
    opening = f"(?is)<{tag}(?=[\\s/>]){_ATTRS}>"
    inner = F.regexp_extract(markup, f"{opening}(.*?)(?:</{tag}\\s*+>|\\z)", 1)
    return F.when(F.rlike(markup, F.lit(opening)), F.array_join(_text_nodes(inner), ""))


def web_page(html: Column, max_chars: int | None = None) -> Column:
    """Generic page: struct(title, text), null unless the text is long enough."""
    body = t.compress_markdown(text_of(html, fixed.WEB_DROP_TAGS))
    return _page(F.lit(fixed.WEB_TITLE), body, lambda b: F.length(b) > fixed.WEB_MIN_CHARS, max_chars)


def job_posting(html: Column, max_chars: int | None = None) -> Column:
    """Job-board page: title from the first h2, else h1; null unless the text is long enough."""
    markup = drop_elements(html, fixed.POSTING_DROP_TAGS)
    title = F.coalesce(
        element_text(markup, "h2"), element_text(markup, "h1"), F.lit(fixed.POSTING_TITLE_DEFAULT)
    )
    body = t.compress_markdown(F.array_join(_text_nodes(markup), "\n"))
    return _page(title, body, lambda b: F.length(b) > fixed.POSTING_MIN_CHARS, max_chars)


def body_text(html: Column, max_chars: int | None = None) -> Column:
    """Whole-body text: title from h1, else the page title; null if the body has no text."""
    markup = drop_elements(html, ["script", "style"])
    title = F.coalesce(
        F.nullif(element_text(markup, "h1"), F.lit("")),
        F.nullif(element_text(markup, "title"), F.lit("")),
        F.lit(fixed.BODY_TITLE_DEFAULT),
    )
    raw = text_of(html, fixed.BODY_DROP_TAGS)
    return _page(title, raw, lambda b: b != "", max_chars, t.compress_markdown)


def _page(title: Column, body: Column, usable, max_chars: int | None, finish=lambda b: b) -> Column:
    """struct(title, text), the text cut if a length is given, or null; the array makes Spark work the text out once."""

    def shown(text: Column) -> Column:
        return finish(text) if max_chars is None else t.cap(finish(text), max_chars)

    page = F.array(F.struct(title.alias("title"), body.alias("text")))
    kept = F.transform(
        F.filter(page, lambda p: usable(p["text"])),
        lambda p: F.struct(p["title"].alias("title"), shown(p["text"]).alias("text")),
    )
    return F.get(kept, F.lit(0))
