"""Main text of web pages by templates deduced from the pages of a host.

Tokens are opening tags with their classes and path, and text blocks with their
path. Two tokens of a host share an occurrence vector when they occur equally
often on every one of its pages; a vector is kept as the number of its pages
and the xor of a hash of page and count, so no host is ever gathered in one
task. A tag belongs to a layout when it stands on ``LEAST_PAGES`` pages, a text
when it also stands on ``LEAST_SHARE`` of those that hold the element around it,
so that layouts of other elements do not count against it. Tokens of a layout
with equal vectors form a class. A second pass over the pages keeps the tokens that have one place
in the order of their class, and one place between the tokens of the class
around it (that of the nearest element outside of the class), on all pages.
What stays together there and has ``LEAST_TOKENS`` tokens is a valid class,
nested in that place. Valid classes are the template; each of their tokens ends
one slot and begins the next.

Text that is itself part of the template is left out. Slots below menus,
headers, footers, sidebars, notices, adverts, forms and comments are left out,
as told by the elements and class words around them. Where a page marks its
article (``article``, ``main``), only slots inside it are the text, and its own
blocks stay whatever they share with other pages: articles may have paragraphs in
common. Hosts with fewer pages have no valid class, there a page is one slot.
Every other slot is returned.

NULL and empty pages give an empty text, NULL or odd addresses are a host of
their own, pages of any length are read whole, repeated rows give equal
results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlab.llm.common import BROADCAST_BYTES, store, text_udf, to_batch

LEAST_TOKENS = 3
LEAST_PAGES = 3
LEAST_SHARE = 0.5

SKIPPED = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|select|object|canvas|math|audio|video)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))", re.S | re.I
)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|$)", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Fixed: elements of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav footer aside form menu dialog button head fieldset".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies respond share sharing social related "
    "recommended newsletter subscribe signup popup modal overlay widget login pagination pager toolbar copyright".split()
)
SITE_WORDS = frozenset("header masthead topbar".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select article main section div body blockquote aside nav footer header form".split())


class Element:
    __slots__ = ("tag", "chrome", "main", "path", "heading", "site", "event")

    def __init__(self, tag, chrome, main, path, heading, site, event):
        self.tag, self.chrome, self.main, self.path, self.heading, self.site, self.event = tag, chrome, main, path, heading, site, event


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool, str]:
    """Whether a tag opens something to leave out, a site's header, an article; and its name in a path."""
    words, role, chrome = [], "", tag in CHROME
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name in ("class", "id"):
            words += [w.lower() for w in WORDS.findall(value)]
        elif name == "role":
            role = value.lower()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            chrome = True
    own = set(words)
    if tag not in ("html", "body", "article", "main"):
        chrome = chrome or bool(own & CHROME_WORDS) or role in CHROME_ROLES
    return chrome, tag == "header" or bool(own & SITE_WORDS), tag in ("article", "main") or role == "main", f"{tag}.{'.'.join(w for w in words if not w.isdigit())}"


def _token(path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}") - (1 << 63)


def parse(page: str | None) -> list[tuple[int, int, str, bool, bool]]:
    """Opening tags and blocks ``(token, event around it, text, left out, inside an article)`` in page order.

    Tags have an empty text; -1 stands for the page around the outermost ones.
    """
    page = SKIPPED.sub(" ", page or "")
    root = Element("", False, False, "", False, False, -1)
    stack, events, held = [root], [], []

    def close_block() -> None:
        text = " ".join(unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            top = stack[-1]
            out = top.chrome or (top.site and not (top.main and top.heading))
            events.append((_token(top.path, text), top.event, text, out, top.main))

    def pop_to(index: int) -> None:
        del stack[index:]

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        tag = tag.lower()
        block = tag in BLOCK
        if tag == "br":
            held.append(" ")
            continue
        if block:
            close_block()
        if slash:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if not block and stack[i].tag in BLOCK:
                    break
            continue
        if block:
            for i in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block starts
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in HOLDERS or stack[i].tag in CLOSED_BY:
                    break
            ends = CLOSED_BY.get(tag, "").split()
            for i in range(len(stack) - 1, 0, -1) if ends else ():
                if stack[i].tag in ends:
                    pop_to(i)
                    break
                if stack[i].tag in HOLDERS:
                    break
        chrome, site, main, name = _marks(tag, attributes)
        top = stack[-1]
        path = f"{top.path}>{name}" if block else top.path
        if block:
            events.append((_token(path), top.event, "", False, False))
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(Element(
                tag, top.chrome or chrome, top.main or (main and not (top.chrome or chrome)), path,
                top.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), top.site or site, len(events) - 1 if block else top.event,
            ))
    held.append(page[at:])
    close_block()
    return events


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)", url or "")
    return found.group(1).lower() if found else ""


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and distinct token its count, as a hash, and the element it is measured by; token 0 stands for the page itself."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            hosts, names, around, hashes = [], [], [], []
            for page_id, url, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                events = parse(page)
                counts, within = {0: 1}, {0: 0}
                for token, up, text, *_ in events:
                    counts[token] = counts.get(token, 0) + 1
                    within[token] = token if not text else events[up][0] if up >= 0 else 0
                host, name = host_of(url), f"{page_id}" if page_id is not None else f"?{xxhash.xxh64_hexdigest(page or '')}"
                hosts += [host] * len(counts)
                names += counts
                around += within.values()
                hashes += [xxhash.xxh64_intdigest(f"{name}:{n}") - (1 << 63) for n in counts.values()]
            yield to_batch([hosts, names, around, hashes], "host string,token long,within long,hash long")


def places(events: list[tuple], classes: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """For every event of a class its token, its place in the class's order, and the token of the class around it that came last."""
    sizes: dict[int, set] = {}
    for token, *_ in events:
        if token in classes:
            sizes.setdefault(classes[token], set()).add(token)
    last: dict[int, int] = {}
    seen: dict[int, int] = {}
    for token, up, *_ in events:
        own = classes.get(token)
        if own is None:
            continue
        while up >= 0 and classes.get(events[up][0], own) == own:
            up = events[up][1]
        seen[own] = seen.get(own, -1) + 1
        yield token, seen[own] % len(sizes[own]), last[classes[events[up][0]]] if up >= 0 else 0
        last[own] = token


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token the least and greatest of its places, over some pages."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            found: dict[tuple, list] = {}
            for host, page, tokens, kinds in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                classes = dict(zip(tokens, kinds, strict=True))
                for token, rank, slot in places(parse(page), classes):
                    held = found.setdefault((host, token), [classes[token], rank, rank, slot, slot])
                    held[1:] = min(held[1], rank), max(held[2], rank), min(held[3], slot), max(held[4], slot)
            rows = [(*k, *v) for k, v in found.items()]
            yield to_batch(list(zip(*rows, strict=True)) if rows else [[]] * 7, ORDERS.replace(", ", ","))


ORDERS = "host string, token long, class long, low long, high long, slot long, slot_high long"


def _with_host(pages: DataFrame, per_host: DataFrame, how: str) -> DataFrame:
    """Pages with ``tokens`` and ``classes`` of their host; ``pages`` has ``url``."""
    size = per_host.agg(F.sum(F.size("tokens") * 16 + 64)).first()[0] or 0
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)", 1))
    return pages.withColumn("host", host).join(F.broadcast(per_host) if size <= BROADCAST_BYTES else per_host, "host", how)


def templates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``host``, ``tokens`` of its valid classes in their order, their ``classes`` and the token each class stands behind.

    A row per host that has any; ``slots`` holds 0 where nothing is around a class.
    """
    given = pages.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("page"))
    rows = given.mapInArrow(_occurrences, "host string, token long, within long, hash long")
    vectors = rows.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor("hash").alias("vector"), F.min("within").alias("within"))
    vectors = store(vectors.filter(F.col("pages") >= LEAST_PAGES), "vectors")
    around = vectors.select("host", F.col("token").alias("within"), F.col("pages").alias("all"))
    frequent = vectors.filter(F.col("token") != 0).join(around, ["host", "within"]).filter(F.col("pages") >= LEAST_SHARE * F.col("all"))
    alike = frequent.groupBy("host", F.xxhash64("pages", "vector").alias("class")).agg(F.collect_set("token").alias("tokens"))
    alike = alike.filter(F.size("tokens") >= LEAST_TOKENS).select("host", "class", F.explode("tokens").alias("token"))
    per_host = store(alike.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("_all")).select(
        "host", F.col("_all.token").alias("tokens"), F.col("_all.class").alias("classes")
    ), "classes")
    seen = _with_host(given, per_host, "inner").select("host", "page", "tokens", "classes").mapInArrow(_orders, ORDERS)
    fixed = (
        seen.groupBy("host", "token")
        .agg(F.min("class").alias("class"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("slot").alias("slot"), F.max("slot_high").alias("slot_high"))
        .filter("low = high AND slot = slot_high")
    )
    valid = fixed.groupBy("host", "class", "slot").agg(F.sort_array(F.collect_list(F.struct("low", "token"))).alias("_in")).filter(F.size("_in") >= LEAST_TOKENS)
    flat = F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("class", "slot", "_in"))),
        lambda c: F.transform(c["_in"], lambda t: F.struct(t["token"].alias("token"), F.xxhash64(c["class"], c["slot"]).alias("class"), c["slot"].alias("slot"))),
    ))
    made = valid.groupBy("host").agg(flat.alias("_all"))
    return made.select("host", F.col("_all.token").alias("tokens"), F.col("_all.class").alias("classes"), F.col("_all.slot").alias("slots"))


def slots(events: list[tuple], template: frozenset) -> list[tuple[int, list[tuple[str, bool, bool]]]]:
    """A parsed page cut at the template's tokens: each slot's first token (0 before any) and its blocks ``(text, left out, inside an article)``.

    The blocks of the template's own text are not in any slot, but those inside an article.
    """
    found: list[tuple[int, list]] = [(0, [])]
    for token, _, text, out, main in events:
        if token in template and not (text and main):
            found.append((token, []))
        elif text:
            found[-1][1].append((text, out, main))
    return found


def extract(page: str | None, template: frozenset) -> str:
    events = parse(page)
    marked = any(main for *_, main in events)
    return "\n".join(text for _, blocks in slots(events, template) for text, out, main in blocks if not out and (main or not marked))


def _extractor():
    known: dict[tuple, frozenset] = {}

    def work(rows):
        found = []
        for row in rows:
            tokens = tuple(row["tokens"] or ())
            if tokens not in known:
                if len(known) >= 1_000:
                    known.clear()
                known[tokens] = frozenset(tokens)
            found.append((extract(row["page"], known[tokens]),))
        return found

    return work


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    found = store(templates(pages, key, url, html), "templates").select("host", "tokens")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("page"))
    text = text_udf("struct<text:string>", _extractor)(F.struct("page", "tokens"))["text"]
    return _with_host(rows, found, "left").select("page_id", "url", text.alias("text"))
