"""Main text of web pages by deducing the templates of their hosts.

Pages become tokens: opening tags and text runs, each told apart by its path of tags. For every host
the number of times a token occurs on each page is its occurrence vector; only a commutative hash of
the vector is kept, so it is summed map-side and a host of any size is one small row per token.
Tokens with equal vectors are an equivalence class. A class is valid if it is large and frequent
enough, holds tags, and these nest in one place of another class or at the top; the valid classes are
the templates of the host's layouts. What a template holds as text on all pages of its layout (notices,
labels, slogans) is boilerplate, and the text between its tokens is in slots. Pages without tags are
not counted, and a layout of a ``LEAST_SHARE`` of the host's pages is enough. A text repeated on some
pages of a layout is in no class with tags, so it stays. ``extract`` returns the text of the slots in page order, but
for those that the page's own marks show to be no article: navigation, page headers, footers, asides,
forms, adverts, cookie notices, comments of readers, scripts and styles. Marks are whole names of a
class, id or role, or a whole label, never parts of them; other names are left to the template. A page
that marks its article is read inside it only, headings and figures included; an article inside a
refused element is read if the page has no other.

Character references are decoded, white space inside a block becomes one space, and blocks are joined
by one space. Broken markup is read as browsers do: unknown ends are passed over, and open paragraphs,
list items and cells end where the next begins.

Defined results: null, empty and text-free pages give an empty text; a null or unreadable url belongs
to a host of its own name ''; hosts of fewer than ``LEAST_PAGES`` pages have no text templates; if a
template would take a page's whole article, the article stays; repeated rows are pages of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.shared import query, stored, table

#: A class needs this many tokens, pages and share of its host's pages with markup.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 3, 8, 0.1
ROWS_AT_ONCE = 512

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(?P<raw>script|style|noscript|template|textarea|iframe|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|"
    r"</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|"
    r"<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
DIGITS = re.compile(r"[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav footer aside form head button select option dialog menu svg math object audio video canvas map frameset".split())
SCOPES = frozenset(("article", "main"))
#: Tags that end an open one of the listed names when they begin.
ENDS = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",), "body": ("head",),
}
ENDS |= {t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: An open tag of these names stops what a beginning tag may end.
FENCES = frozenset("table ul ol dl div article section main aside nav header footer form body html blockquote".split())
#: Whole names that mark no article.
NO_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertisements adsense ad-banner ad-slot ad-container banner-ad sponsor sponsored promo promotion banner "
    "comment cookie cookies cookie-notice cookie-banner cookie-consent cookie-bar consent gdpr popup modal newsletter newsletter-signup subscribe signup login "
    "sidebar comments comment-list commentlist comments-area comments-section disqus disqus-thread social breadcrumb breadcrumbs pagination pager "
    "nav navbar navigation main-nav site-nav menu main-menu topbar toolbar masthead header site-header page-header footer site-footer page-footer "
    "copyright complementary contentinfo".split()
)
#: Those that stay inside an article, and those that refuse as a role only.
HEADERS, ROLES = frozenset("header page-header masthead banner".split()), frozenset(("search", "form"))
READERS = frozenset("comment comments comment-body comment-item reply".split())
ARTICLE_MARKS = frozenset("article articlebody article-body article-content post-content entry-content post-body main-content maincontent role=main role=article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element is: free, an article inside a refused one, refused, or refused with the articles inside.
FREE, DOUBTFUL, REFUSED, HARD = range(4)


class Block:
    """A run of text: its path, its words, whether it is refused, and what share is linked."""

    __slots__ = ("linked", "path", "refused", "scoped", "text")

    def __init__(self, path: int, refused: int, scoped: bool, text: str, linked: int):
        self.path, self.refused, self.scoped, self.text, self.linked = path, refused, scoped, text, linked


def hashed(*parts) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)))


def parse(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks in page order, and (path, parent path) of each opening tag but the inline ones."""
    blocks: list[Block] = []
    tokens: list[tuple[int, int]] = []
    # open tags: name, path, refused, scoped, linked
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, FREE, False, False)]
    runs: list[str] = []
    linked = 0

    def close_block(owner: tuple) -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                blocks.append(Block(owner[1], owner[2], owner[3], text, linked))
            runs.clear()
        linked = 0

    def holder() -> tuple:
        for entry in reversed(stack):
            if entry[0] not in INLINE:
                return entry
        return stack[0]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            runs.append(entities.unescape(raw) if "&" in raw else raw)
            if stack[-1][4]:
                linked += len(raw.strip())

    at = 0
    for found in MARKUP.finditer(page):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = found.group("tag")
        if tag is None:
            end = found.group("end")
            if end is None:
                continue  # comment, declaration or raw element
            end = end.lower()
            if end in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == end:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
                continue
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == end), 0)
            close_block(holder())
            if depth:
                del stack[depth:]
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "br":
                runs.append(" ")
            elif tag == "hr":
                close_block(holder())
            continue
        _, path, refused, scoped, in_link = stack[-1]
        attributes = found.group("attributes")
        if tag in INLINE:
            if attributes and refused < REFUSED and _names(attributes) & NO_ARTICLE:
                close_block(holder())
                refused = REFUSED  # for the blocks inside; its own text is of the block around it
            stack.append((tag, path, refused, scoped, in_link or tag == "a"))
            continue
        close_block(holder())
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name in ENDS[tag]:
                    del stack[k:]
                elif name in FENCES:
                    break
            _, path, refused, scoped, in_link = stack[-1]
        elif stack[-1][0] in INLINE and tag != "a":
            in_link = in_link and any(s[0] == "a" for s in stack)
        own = hashed(path, tag, _marks(attributes) if attributes else "")
        tokens.append((own, path))
        names = _names(attributes) if attributes else NO_NAMES
        opens = tag in SCOPES or bool(names & ARTICLE_MARKS)
        refused = _judged(tag, names, opens, scoped, refused)
        stack.append((tag, own, refused, scoped or opens, in_link))
        if attributes.endswith("/") and tag in ("div", "p", "span"):
            pass  # a slash does not close these
    add(page[at:])
    close_block(holder())
    return blocks, tokens


NO_NAMES: frozenset = frozenset()


def _judged(tag: str, names: frozenset, opens: bool, scoped: bool, outer: int) -> int:
    """What an element is inside an outer one."""
    if tag in DROPPED:
        return max(outer, REFUSED if tag in ("form", "dialog", "aside") else HARD)
    if tag == "article" and names & READERS:
        return HARD
    if opens and outer >= REFUSED:
        return FREE if tag == "main" or "role=main" in names else DOUBTFUL if outer == REFUSED else HARD
    if opens:
        return outer
    if tag == "header" and not scoped:
        return max(outer, REFUSED)
    if tag in ("html", "body") or scoped and tag in HEADINGS:
        return outer
    marked = names & NO_ARTICLE
    if scoped:
        marked -= HEADERS
    return max(outer, HARD if marked & READERS else REFUSED) if marked else outer


def _marks(attributes: str) -> str:
    """Values of the marking attributes without numbers, which differ by page."""
    return DIGITS.sub("", " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)))


def _names(attributes: str) -> frozenset:
    """Whole names in the marking attributes, without numbers at their end; a label is one name."""
    names: list[str] = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value, key = (a or b or c).lower().replace("_", "-"), key.lower()
        found = [value.strip()] if key == "aria-label" else value.split()
        names += [x.rstrip("0123456789").rstrip("-") for x in found]
        if key == "role":
            names += ["role=" + x for x in found]
            if not ROLES.isdisjoint(found):
                names.append("nav")
    return frozenset(names)


def text_token(block: Block) -> int:
    return hashed("text", block.path, block.text)


def signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >> 63 else x


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, parent, pages, vector): partial occurrence vectors, one row per batch and token."""

    def run(batches):
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            columns = [batch.column(c).to_pylist() for c in ("host", "page", "html")]
            for host, page, content in zip(*columns, strict=True):
                blocks, tags = parse(content or "")
                counts: dict[tuple, int] = {}
                for path, parent in tags:
                    counts[path, False, parent] = counts.get((path, False, parent), 0) + 1
                for block in blocks:
                    if block.refused < REFUSED:
                        key = (text_token(block), True, block.path)
                        counts[key] = counts.get(key, 0) + 1
                for key, n in counts.items():
                    own = found.setdefault((host, *key), [0, 0])
                    own[0] += 1
                    own[1] += page * n
            rows = list(found.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([signed(k[1]) for k, _ in rows], pa.int64()),
                 pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([signed(k[3]) for k, _ in rows], pa.int64()),
                 pa.array([v[0] for _, v in rows], pa.int64()), pa.array([signed(v[1]) % 2**62 for _, v in rows], pa.int64())],
                ["host", "token", "is_text", "parent", "pages", "vector"],
            )

    return pages.select("host", "page", "html").mapInArrow(run, "host string, token long, is_text boolean, parent long, pages long, vector long")


def templates(pages: DataFrame) -> DataFrame:
    """(host, boilerplate): the text tokens of each host's template, of (host, page, html) rows.

    A host's frequent tokens number at most the mean of a page's by ``LEAST_SHARE``.
    """
    pages = pages.filter(F.col("html").rlike("<[a-zA-Z]"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).filter(F.col("host_pages") >= LEAST_PAGES)
    whole = F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.lit(2**62).cast("decimal(38,0)"))
    vectors = page_tokens(pages).groupBy("host", "token", "is_text", "parent").agg(F.sum("pages").alias("pages"), whole.alias("vector"))
    frequent = stored(
        vectors.join(sizes, "host").filter(F.col("pages") >= F.ceil(F.col("host_pages") * LEAST_SHARE)).drop("host_pages"), "template-tokens"
    )
    own = frequent.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("tokens")).filter(F.col("tokens") >= LEAST_TOKENS)
    held = frequent.join(own, ["host", "vector"])
    tags = held.filter("NOT is_text")
    above = tags.select("host", F.col("token").alias("parent"), F.col("vector").alias("parent_vector")).distinct()
    nested = tags.join(above, ["host", "parent"], "left")
    # the tags that stand outside their class stand in one place of one other class, or at the top
    outside = F.when(~F.coalesce(F.col("parent_vector") == F.col("vector"), F.lit(False)), F.coalesce(F.col("parent_vector"), F.lit(-1)))
    valid = nested.groupBy("host", "vector").agg(F.coalesce(F.min(outside) == F.max(outside), F.lit(True)).alias("valid")).filter("valid")
    text = held.filter("is_text").join(valid, ["host", "vector"])
    return stored(text.groupBy("host").agg(F.collect_set("token").alias("boilerplate")), "templates")


def main_text(content: str, boilerplate: frozenset) -> str:
    """Text of the slots that belong to the article."""
    blocks = [b for b in parse(content)[0] if b.refused < REFUSED]
    if any(b.scoped and b.refused == FREE for b in blocks):
        blocks = [b for b in blocks if b.scoped and b.refused == FREE]
    else:  # two or more neighbours that are all links are a menu
        links = [False, *(not b.scoped and b.linked * 10 >= len(b.text) * 9 for b in blocks), False]
        blocks = [b for k, b in enumerate(blocks, 1) if not (links[k] and (links[k - 1] or links[k + 1]))]
    if boilerplate:
        slots = [b for b in blocks if signed(text_token(b)) not in boilerplate]
        blocks = slots or blocks
    return " ".join(b.text for b in blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]+)", 1)
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    page = F.pmod(F.xxhash64("id", "url", "html"), F.lit(2**62))
    found = templates(named.select("host", "html", page.alias("page")))
    rows = named.join(found, "host", "left").select("id", "url", "html", "boilerplate")
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                known: dict[tuple, frozenset] = {}
                texts = []
                for content, tokens in zip(part.column("html").to_pylist(), part.column("boilerplate").to_pylist(), strict=True):
                    key = tuple(tokens or ())
                    texts.append(main_text(content, known.setdefault(key, frozenset(key))))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


@query("op10_template_extraction")
def template_extraction(spark, folder):
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
