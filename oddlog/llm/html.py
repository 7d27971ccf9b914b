"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: the start of each structural element with its path (tags, classes and ids from the
root) and each text block with its path. A token's occurrence vector says how often each page of its host has it; it is
kept as a combinable digest, so vectors are compared without gathering a host. Tokens of equal vectors form a class.
Classes on at least half of a host's pages, with two or more tokens, whose elements nest in elements of such classes,
are the host's template. Its slots are the containers of the template, and the slot that holds most of the text is the
main one. Texts in the class of the whole page (once on every different page of the host, of two or more), outside an
article element, belong to the template and are left out, unless they are most of what the page has in its slot: the
slot is what differs. Rows of a host with the same text are one page to the template. Where a host has no template, or
a page does not fit it, the page's own article, main or body element is the slot.

Names of elements only break ties: an element is what the last telling word of a class, id or role says (`share-bar`,
`reader-comments`, but not `with-sidebar`, `comments-open` or `search-results`), and none that holds an article, a main
element, the first-level heading or most of the page's text is furniture for its name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.session import broadcast_if_small, freeze

MAIN_SHARE = 0.6

# Elements of HTML by what they do to the text; fixed by the language.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title noembed noframes xmp audio video".split())
CONTAINERS = frozenset("article main section div td body".split())
FURNITURE = frozenset("head nav header footer aside form select option optgroup menu dialog fieldset button".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
# What an element is by its name: page furniture inside an article or main element too, and outside them only.
INSERTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted promotion comment comments "
    "commentlist respond reply replies disqus newsletter subscribe subscription signup cookie cookies consent gdpr related recommended "
    "recommendations share sharing social popup modal overlay".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
MARKS = INSERTS | frozenset(
    "banner notice notices notification alert login nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars rail widget widgets "
    "trending footer header masthead topbar toolbar discussion pagination pager paging copyright legal disclaimer skip search searchform "
    "contentinfo complementary toc".split()
)
# Words that say nothing of what an element is, and words before one that it only goes with.
GENERAL = frozenset("list bar box wrap wrapper container section area block blocks form panel item items inner outer content posts links link button buttons unit slot text top bottom left right".split())
WITH = frozenset("with has no is not without".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def unseen(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))


def telling(name: str) -> str:
    """The word of a class, id or role that says what the element is."""
    words = _WORD.findall(name.lower())
    while len(words) > 1 and words[-1] in GENERAL:
        words.pop()
    return "" if not words or (len(words) > 1 and words[0] in WITH) else words[-1]


def names_of(attributes: dict[str, str]) -> list[str]:
    return [w for k in ("class", "id", "role") for w in attributes.get(k, "").split()]


class Element:
    __slots__ = ("tag", "path", "parent", "inside", "hard", "marked", "comments", "furniture", "chars", "holds")

    def __init__(self, tag: str, attributes: str, parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.inside = (parent.inside if parent else frozenset()) | ({tag} & {"article", "main"})
        known = attributes_of(attributes) if attributes else {}
        names = names_of(known)
        self.path = (parent.path if parent else "") + "/" + tag + "".join(f".{w}" for n in names if n != known.get("role") for w in _WORD.findall(n.lower())[:3])
        # A header of the article belongs to it.
        self.hard = bool(parent and parent.hard) or (tag in FURNITURE and not (tag == "header" and self.inside)) or unseen(known)
        among = INSERTS if parent and parent.inside else MARKS
        self.marked = tag not in ("html", "body", "main") and any(telling(n) in among for n in names)
        self.comments = self.marked and any(telling(n) in COMMENTS for n in names)
        self.furniture = self.hard
        self.chars, self.holds = 0, False


def _settle(elements: list[Element], texts: list[tuple[Element, str]]) -> None:
    """Decide which marked elements are furniture, from what they hold."""
    total = plain = 0
    for element, text in texts:
        if not element.hard:
            total += len(text)
            at, named = element, False
            while at:
                at.chars += len(text)
                named |= at.marked
                at = at.parent
            plain += 0 if named else len(text)
    for element in elements:
        if element.tag in ("article", "main", "h1") and not element.hard and not element.marked:
            at = element.parent
            while at and not at.holds:
                at.holds = True
                at = at.parent
    for element in elements:  # parents come first
        # Comments may be longer than what they are about, if there is such a thing.
        small = 2 * element.chars <= total or (element.comments and (plain > 0 if element.inside else 10 * plain >= total))
        by_name = element.marked and not element.holds and small
        element.furniture = element.hard or by_name or bool(element.parent and element.parent.furniture)


def blocks(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Structural elements of a page in order, and its text blocks with the element they stand in."""
    stack = [Element("html", "", None)]
    elements, out, text = [], [], []
    silent: list[str] = []  # open inline elements from the first that is not shown
    at, size = 0, len(page)

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                out.append((stack[-1], joined))

    while at < size:
        found = _TAG.search(page, at)
        stop = found.start() if found else size
        if stop > at and not silent:
            text.append(entities.unescape(page[at:stop]))
        if not found:
            break
        at = found.end()
        if found[2] is None and found[5] is None:
            continue
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] is not None else (found[4], found[5], found[6])
        tag = tag.lower()
        if tag in RAW and not closing:
            if not (attributes.endswith("/") and tag in ("svg", "math")):
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
        elif tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCK or tag == "button":
            silent.clear()  # a block ends what an unclosed inline element hides
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            elif tag not in ("html",):
                if stack[-1].tag == "p":
                    stack.pop()
                for _ in range(2):
                    if stack[-1].tag in CLOSED_BY.get(tag, ()) and len(stack) > 1:
                        stack.pop()
                element = Element(tag, attributes, stack[-1])
                stack.append(element)
                elements.append(element)
        elif tag not in _VOID:
            if closing:
                if tag in silent:
                    del silent[len(silent) - 1 - silent[::-1].index(tag) :]
            elif silent:
                silent.append(tag)
            elif attributes and not attributes.endswith("/"):
                known = attributes_of(attributes)
                if unseen(known) or any(telling(n) in INSERTS for n in names_of(known)):
                    silent.append(tag)
    flush()
    _settle(elements, out)
    return elements, out


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute url, else empty."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


TOKENS = "host string, token bigint, path string, container boolean, pages bigint, total bigint, vector bigint, chars bigint"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple, list] = {}
        for host, page in zip(batch.column(0), batch.column(1)):
            host, page = host.as_py(), page.as_py() or ""
            elements, texts = blocks(page)
            own: dict[tuple, list] = {}
            for e in elements:
                own.setdefault((e.path, None), [e.tag in CONTAINERS and not e.furniture, 0, 0])[1] += 1
            for e, text in texts:
                if not e.furniture:
                    own.setdefault((e.path, text), [False, 0, 0])[1] += 1
                    steps = e.path.split("/")
                    for k in range(2, len(steps) + 1):
                        under = own.get(("/".join(steps[:k]), None))
                        if under:
                            under[2] += len(text)
            body = _body(texts)
            own[("", None)] = [False, 1, 0]
            for (path, text), (container, total, chars) in own.items():
                key = (host, _hash(path, "e" if text is None else "t" + text))
                row = seen.setdefault(key, [path if text is None else None, container, 0, 0, 0, 0])
                row[2] += 1
                row[3] += total
                row[4] ^= _hash(body, total)
                row[5] += chars
        if seen:
            columns = [[k[0] for k in seen], [k[1] for k in seen], *zip(*seen.values())]
            types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [c.split()[0] for c in TOKENS.split(", ")])


def _deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main slot of each host from its frequent elements."""
    for batch in batches:
        mains = [_main_slot(e, n) for e, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mains, pa.string())], ["host", "main"])


def _main_slot(elements: list[dict], n_pages: int) -> str | None:
    sizes: dict[tuple, int] = {}
    for e in elements:
        key = (e["vector"], e["pages"], e["total"])
        sizes[key] = sizes.get(key, 0) + 1
    large = {e["path"]: e for e in elements if sizes[(e["vector"], e["pages"], e["total"])] >= 2 or e["pages"] == n_pages}
    valid: dict[str, dict] = {}
    for path in sorted(large, key=lambda p: p.count("/")):
        parent = path.rsplit("/", 1)[0]
        if parent in ("", "/html") or parent in valid:  # nests in the template so far
            valid[path] = large[path]
    text = max([e["chars"] for e in valid.values()], default=0)
    slots = [e for e in valid.values() if e["container"] and e["total"] == e["pages"] and text and e["chars"] >= MAIN_SHARE * text]
    for tag in ("article", "main"):
        named = [e for e in slots if e["path"].rsplit("/", 1)[1].split(".")[0] == tag]
        if named:
            return min(named, key=lambda e: (e["path"].count("/"), e["path"]))["path"]
    return max(slots, key=lambda e: (e["path"].count("/"), e["path"]))["path"] if slots else None


BODIES = "host string, body bigint, row bigint, digest bigint"


def _body(texts: list[tuple[Element, str]]) -> int:
    return _hash(*[t for e, t in texts if not e.furniture])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([_body(blocks(page.as_py() or "")[1]) for page in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2), batch.column(3)], [c.split()[0] for c in BODIES.split(", ")])


def _different(pages: DataFrame) -> DataFrame:
    """(host, html), a row for each host and body text: of rows that repeat one, that of the least digest of its html."""
    html = F.col("html").cast("string")
    rows = pages.select(host_of(F.col("url")).alias("host"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    read = freeze(rows.select("host", "html", "row", F.xxhash64("html").alias("digest")).mapInArrow(_bodies, BODIES))
    repeated = freeze(
        read.groupBy("host", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "row")).alias("least")).filter("n > 1")
        .select("host", "body", F.col("least.row").alias("first"))
    )
    gone = freeze(read.join(broadcast_if_small(repeated, repeated.count()), ["host", "body"]).filter("row <> first").select("row"))
    return rows.join(broadcast_if_small(gone, gone.count()), "row", "left_anti").select("host", "html")


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, constants): main slot and constant texts of each host, from all its different pages.

    What is gathered for a host stands on half of its pages at least, so it is at most twice a mean page's elements.
    """
    found = _different(pages).mapInArrow(_tokens, TOKENS)
    tokens = freeze(
        found.groupBy("host", "token").agg(
            F.max("path").alias("path"), F.bool_and("container").alias("container"), F.sum("pages").alias("pages"),
            F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"),
        ).filter("pages > 1 OR path IS NOT NULL")
    )
    hosts = tokens.filter("path = ''").select("host", F.col("pages").alias("host_pages"))
    frequent = tokens.join(broadcast_if_small(hosts, hosts.count()), "host").filter("2 * pages >= host_pages AND coalesce(path, 'x') <> ''")
    gathered = frequent.groupBy("host").agg(
        F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "container", "pages", "total", "vector", "chars"))).alias("elements"),
        F.max("host_pages").alias("host_pages"),
        F.collect_list(F.when(
            F.col("path").isNull() & (F.col("pages") == F.col("host_pages")) & (F.col("total") == F.col("pages"))
            & (F.col("pages") > 1), F.col("token"))).alias("constants"),
    )
    mains = gathered.select("host", "elements", "host_pages").mapInArrow(_deduce, "host string, main string")
    return gathered.select("host", "constants").join(mains, "host")


def page_text(page: str, main: str | None = None, constants: frozenset[int] = frozenset()) -> str:
    """Main text of one page: its blocks in order, one a line."""
    _, texts = blocks(page)
    texts = [(e, t) for e, t in texts if not e.furniture]
    slot = [(e, t) for e, t in texts if main and (e.path == main or e.path.startswith(main + "/"))]
    for tag in ("article", "main"):
        slot = slot or [(e, t) for e, t in texts if tag in e.inside]
    slot = slot or texts
    if constants:
        own = [(e, t) for e, t in slot if "article" in e.inside or _hash(e.path, "t" + t) not in constants]
        # The slot is what differs: where most of it is on every page, the pages are versions of one text.
        if 2 * sum(len(t) for _, t in own) >= sum(len(t) for _, t in slot):
            slot = own
    return "\n".join(t for _, t in slot)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row given.

    Null html is empty and gives an empty text; null and odd urls share the host "". Rows of a host that repeat a text
    are one page to the template and each gives its row. Rows are numbered, so ``pages`` must come from storage, a
    checkpoint or a local table. Columns beside page_id, url and html are not looked at. An empty table gives an empty
    result.
    """
    known = freeze(templates(pages))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                page_text(h.as_py() or "", m.as_py(), frozenset(c.as_py() or ()))
                for h, m, c in zip(batch.column(2), batch.column(3), batch.column(4))
            ]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    joined = rows.withColumn("host", host_of(F.col("url"))).join(broadcast_if_small(known, known.count()), "host", "left")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "main", "constants").mapInArrow(read, f"page_id {id_type}, url string, text string, n_chars bigint")
