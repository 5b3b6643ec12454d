"""Main text of web pages: site templates go by counting element subtrees.

Every block element's subtree is hashed twice: exactly, and as a shape, which is
its block tags with their names and its path from the root, without text, links
and digits. Spark counts per host on how many distinct pages each hash occurs.

* Exact subtrees on at least ``PAGES`` pages and ``SHARE`` of the host's, which
  leaves room for some fifty layouts, are the site's template. Within articles and
  main elements, whose paragraphs repeat by themselves, ``WITHIN`` of the pages
  is asked.
* Shapes on at least ``PAGES`` pages and ``SHAPE`` of the host's go where they stand
  beside an article or main element that holds ``ROOT`` of the page's text: menus,
  adverts and footers whose words change from page to page. They are counted on such
  pages alone, so a page without a marked article loses no paragraph by its shape.

What is left is the text. What counting does not reach, on hosts of few pages
or in an element seen once, goes by fixed names of tags and classes, and of what
is left articles are taken if they hold ``ROOT`` of it, else the main element with
its articles by the same rule, else all of it.

Defined results: a null or empty html gives an empty text; a null url is a host
of its own; equal pages of a host count once and rows repeat the result; an empty table
gives an empty result; time is linear in a page, however long or deep; other columns are never read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import BROADCAST_BYTES, checkpoint, small_batches, worker_cache

PAGES, SHARE, WITHIN, SHAPE, ROOT = 5, 0.02, 0.5, 0.1, 0.25

TOKEN = re.compile(
    # A quote opens a value only after an equals sign, as browsers read it.
    r"<!--.*?(?:-->|\Z)|<(?:![^>]*|\?[^>]*)>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDES = re.compile(r"display\s*:\s*none", re.I)
PART = re.compile(r"[^a-z0-9]+")

#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
DROP = frozenset("head nav footer aside form button select option datalist fieldset template svg canvas object dialog menu".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements that a following block of these kinds ends without an end tag.
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot option".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl html body article main section div nav footer aside form header blockquote td th".split())
#: Class, id or role words that name something other than the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices "
    "newsletter subscribe signup login popup modal overlay share sharing social related recommended comment comments "
    "disqus respond pagination pager widget toolbar search complementary contentinfo".split()
)
KEEP = frozenset("html body article main".split())
#: What holds no text under any name.
SILENT = RAW | {"head"}
#: Of the running polynomials: a Mersenne prime, so four times a hash fits a signed long, and odd bases.
MODULUS = (1 << 61) - 1
BASE, STEP = 0x9E3779B97F4A7C15 % MODULUS, 0xD6E8FEB86659FD93 % MODULUS
DIGITS = re.compile(r"[0-9]+")
REMEMBERED = 50_000
#: Of a template: exact subtrees outside articles, exact ones anywhere, shapes.
OUTSIDE, ANYWHERE, SHAPED = 0, 1, 2


def named(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the name says it is no part of the article. ``inside``: within one, where a header belongs to it."""
    if tag in DROP or tag == "header" and not inside:
        return True
    if tag in KEEP - {"article"} or not attributes or attributes.isspace():
        return False
    found = {m[0].lower(): "".join(m[1:]).lower() for m in ATTRIBUTE.findall(attributes)}
    if found.get("hidden", "until-found") != "until-found" or HIDES.search(found.get("style", "")):
        return True
    # Of an article only a whole name counts: one comment is often an article of its own.
    split = str.split if tag == "article" else PART.split
    return any(WORDS.intersection(split(found.get(name, ""))) for name in ("class", "id", "role"))


def number(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


def shape(tag: str, attributes: str) -> int:
    """The element's part in a shape: its tag, class, id and role, digits left out."""
    found = {m[0].lower(): "".join(m[1:]) for m in ATTRIBUTE.findall(attributes)} if attributes else {}
    return number(DIGITS.sub("", "|".join((tag, *(" ".join(found.get(k, "").split()) for k in ("class", "id", "role"))))))


class Remembered(dict):
    """What a function gives for a tag and its attributes, kept by the worker."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key: tuple):
        found = self.f(*key)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(key[1]) <= 256:
            self[key] = found
        return found


def remembered() -> tuple[Remembered, Remembered, Remembered]:
    """The parts of opening tags in exact hashes, in shapes, and whether their names tell them off."""
    held = worker_cache()
    if "page tags" not in held:
        opens = Remembered(lambda tag, attributes: number(f"<{tag} {' '.join(attributes.split())}"))
        held["page tags"] = opens, Remembered(shape), Remembered(named)
    return held["page tags"]


def events(source: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(kind, start, end, tag, attributes) of the markup; kind: open, close or skip."""
    at = 0
    while m := TOKEN.search(source, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            yield "skip", m.start(), at, "", ""
        elif m[1]:
            yield "close", m.start(), at, tag, ""
        else:
            yield "open", m.start(), at, tag, m[3]
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                yield "close", end.start() if end else len(source), end.end() if end else len(source), tag, ""
                at = end.end() if end else len(source)


def walk(source: str) -> Iterator[tuple]:
    """Text and element events with implied ends: ("text", a, b), ("open", tag, a, attrs), ("close", tag, b), ("break",)."""
    stack: list[str] = []
    at = 0

    def close(upto: int, where: int):
        while len(stack) > upto:
            yield "close", stack.pop(), where

    for kind, a, b, tag, attributes in events(source):
        if a > at:
            yield "text", at, a
        at = b
        if kind == "open":
            if tag in ENDS_P or tag in SAME:
                ends = SAME.get(tag, ()) if tag not in ENDS_P else {"p", *SAME.get(tag, ())}
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] in ends:
                        yield from close(k, a)
                        break
                    if stack[k] in SCOPE:
                        break
            if tag in VOID:
                yield ("break",) if tag in ("br", "hr") else ("space",)
            elif not attributes.endswith("/") or tag in BLOCK:
                stack.append(tag)
                yield "open", tag, a, attributes
        elif kind == "close" and stack and stack[-1] == tag:
            stack.pop()
            yield "close", tag, b
        elif kind == "close" and tag in stack:
            k = len(stack) - 1 - stack[::-1].index(tag)
            yield from close(k + 1, a)
            stack.pop()
            yield "close", tag, b
    if at < len(source):
        yield "text", at, len(source)
    yield from close(0, len(source))


class Page:
    """A page in one pass: its text blocks, and its block elements with their hashes.

    A hash is the difference of two running polynomials over the events, so a
    page takes time linear in its markup, however deep it nests.
    """

    def __init__(self, source: str, texts: bool = True, hashes: bool = True):
        """``texts``, ``hashes``: whether blocks and hashes are asked for."""
        self.blocks: list[tuple[str, bool, str]] = []  # root, dropped by name, text
        self.spans: list[tuple[int, int, int, int, bool]] = []  # first block, end, exact hash, shape, about an article
        sizes = {"body": 0, "main": 0, "article": 0}
        self._read(source, sizes, texts, hashes)
        #: An article or main element that holds a good part of the text.
        self.framed = sizes["main"] + sizes["article"] > 0 and sizes["main"] + sizes["article"] >= ROOT * sum(sizes.values())

    def _read(self, source: str, sizes: dict[str, int], texts: bool, hashes: bool) -> None:
        blocks, spans, parts = self.blocks, self.spans, []
        opens, shapes, names = remembered()
        digest = xxhash.xxh64_intdigest
        # Running polynomials over all events, and over the shapes of blocks, with the powers that take their starts off.
        total, power, outline, powers, path = [0], [1], [0], [1], [0]
        opened: list[tuple] = []
        root, dropped, silent, articles, met = "body", False, False, 0, 0

        def flush() -> None:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((root, dropped, text))

        for event in walk(source):
            what = event[0]
            if what == "text":
                text = source[event[1] : event[2]]
                if not silent:
                    sizes[root] += len(text)
                    if texts:
                        parts.append(text)
                token = hashes and " ".join(text.split())
                if not token:
                    continue
                value = digest(token.encode("utf-8", "surrogatepass"))
            elif what == "open":
                tag, attributes = event[1], event[3]
                block = tag in BLOCK
                if block and parts:
                    flush()
                opened.append((root, dropped, silent, block, len(blocks), len(total) - 1, len(outline) - 1, articles > 0, met))
                inside = root == "article"
                dropped = dropped or names[tag, attributes, inside]
                silent = silent or tag in SILENT
                if tag == "article":
                    root = "article"
                elif not inside and (tag == "main" or "main" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes)):
                    root = "main"
                if tag in ("article", "main"):
                    articles, met = articles + 1, met + 1
                if not hashes:
                    continue
                value = opens[tag, attributes]
                if block:
                    form = shapes[tag, attributes]
                    path.append((path[-1] * STEP + form) % MODULUS)
                    outline.append((outline[-1] * STEP + form) % MODULUS)
                    powers.append(powers[-1] * STEP % MODULUS)
            elif what == "close":
                before, was, quiet, block, first, k, m, within, held = opened.pop()
                if block and parts:
                    flush()
                if event[1] in ("article", "main"):
                    articles -= 1
                if hashes:
                    total.append((total[-1] * BASE + opens["/", event[1]]) % MODULUS)
                    power.append(power[-1] * BASE % MODULUS)
                    if block:
                        outline.append((outline[-1] * STEP + 7) % MODULUS)
                        powers.append(powers[-1] * STEP % MODULUS)
                        seat = path.pop()
                        if event[1] not in KEEP:
                            exact = (total[-1] - total[k] * power[len(total) - 1 - k]) % MODULUS
                            form = (outline[-1] - outline[m] * powers[len(outline) - 1 - m] + seat * BASE) % MODULUS
                            # An element that holds an article counts as a part of it.
                            spans.append((first, len(blocks), exact, form, within or met > held))
                root, dropped, silent = before, was, quiet
                continue
            else:
                if what == "break" and not silent and texts:
                    parts.append(" ")
                if not hashes:
                    continue
                value = 1 if what == "break" else 2
            total.append((total[-1] * BASE + value) % MODULUS)
            power.append(power[-1] * BASE % MODULUS)
        flush()

    def codes(self) -> set[int]:
        """Twice the hash of every exact subtree; twice that of every shape beside an article, and 1 more."""
        found = {2 * exact for _, _, exact, _, _ in self.spans}
        if self.framed:
            found |= {2 * form + 1 for _, _, _, form, about in self.spans if not about}
        return found

    def text(self, template: frozenset[int] | set[int] = frozenset(), names: bool = True) -> str:
        """Blocks joined by an empty line. ``template``: four times a hash, and its kind; ``names``: use those of tags and classes too."""
        steps = [0] * (len(self.blocks) + 1)
        if template:
            for first, end, exact, form, about in self.spans:
                if first < end and (
                    4 * exact + ANYWHERE in template
                    or not about and (4 * exact + OUTSIDE in template or self.framed and 4 * form + SHAPED in template)
                ):
                    steps[first] += 1
                    steps[end] -= 1
        left = [(root, text) for (root, dropped, text), n in zip(self.blocks, accumulate(steps)) if not n and not (names and dropped)]
        size = sum(len(text) for _, text in left)
        for roots in (("article",), ("main", "article")) if names else ():
            found = [text for of, text in left if of in roots]
            if found and sum(map(len, found)) >= ROOT * size:
                return "\n\n".join(found)
        return "\n\n".join(text for _, text in left)


def extract(source: str, template: frozenset[int] | set[int] = frozenset(), names: bool = True) -> str:
    """The main text of one page."""
    return Page(source, hashes=bool(template)).text(template, names)


def host_of(url: str = "url"):
    name = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(name, F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, hashes)``: the subtrees and shapes that recur across a host's pages, four times the hash and its kind."""
    codes = F.arrow_udf(lambda col: pa.array([list(Page(x or "", texts=False).codes()) for x in col.to_pylist()], pa.list_(pa.int64())), T.ArrayType(T.LongType()))
    page = F.xxhash64(F.coalesce("html", F.lit(""))).alias("page")
    seen = pages.select(host_of().alias("host"), page, F.explode(codes("html")).alias("code"))
    total = checkpoint(pages.groupBy(host_of().alias("host")).agg(F.count_distinct(page).alias("pages")))
    often = checkpoint(seen.groupBy("host", "code").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= PAGES))
    shaped, share = F.col("code") % 2 == 1, F.col("n") / F.col("pages")
    kind = F.when(shaped, F.when(share >= SHAPE, SHAPED)).when(share >= WITHIN, ANYWHERE).when(share >= SHARE, OUTSIDE)
    # At most 1 / SHARE times the subtrees of an average page are left for a host.
    return (
        often.join(total, "host")
        .select("host", (F.shiftright("code", 1) * 4 + kind).alias("hash"))
        .filter("hash is not null")
        .groupBy("host")
        .agg(F.collect_list("hash").alias("hashes"))
    )


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    small_batches(pages.sparkSession)
    found = checkpoint(templates(pages))
    size = found.agg(F.sum(F.size("hashes") * 8 + F.length("host") + 32)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("shuffle_merge")

    def run(sources: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array([extract(s or "", set(k or ())) for s, k in zip(sources.to_pylist(), known.to_pylist())], pa.string())

    of = F.arrow_udf(run, T.StringType())
    return (
        pages.select("page_id", "url", "html", host_of().alias("__host"))
        .join(found.withColumnRenamed("host", "__host"), "__host", "left")
        .select("page_id", "url", of("html", "hashes").alias("text"))
    )
