"""Main text of web pages by site template removal.

A page is read tag by tag, and every container element's subtree is hashed in a normal form, so that a
changed link, id, number or "active" class doesn't hide a template. Spark counts in how many pages of
its host each hash occurs, and subtrees that recur are deleted from the host's pages. There are three
kinds, by what a subtree holds:

* running text: whatever lies in an article or main part, or holds a paragraph, a heading or more than
  ``SHORT`` characters between tags. The hash is over tags, class words and text, and must recur in
  ``PAGES`` pages and in ``SHARE`` of the host's: articles quote each other and are copied within a
  site more often than many sites repeat one notice, and those copies are content.
* links, for half of its characters at least: the hash is over tags, class words and where links and
  other text stand, without repeats, and must recur in ``PAGES`` pages and in ``SHARE`` of the host's.
  Two menus with other links are one template. A page that is left empty without them keeps them.
* anything else (notices, adverts, footers, single links of a list): the hash is over tags, class words
  and text without its numbers and case, and must recur in ``PAGES`` pages.

Counts alone miss templates of hosts with few pages, so menus, headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments are also told by element name and by class, id and role. A
form, or a subtree marked by such a class, stays if the page has no paragraph besides. If a page has a main
part, only its text is taken, or that of the articles if they hold at least half of the text of both, or
of the page if it has no main part.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and
joined in page order by one space. Null and empty pages, and pages without text, give the empty
string. A null or odd url is a host of its own. Repeated rows are separate pages and count as such.
Other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwork.llm import common

SHARE = 0.3
PAGES = 5
SHORT = 60
#: Up to so many (host, hash) rows the templates are broadcast, 16 bytes and a host name each; beyond, they are joined by a salted shuffle.
MOST_BROADCAST = 100_000
SALTS = 64

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea math canvas audio video title".split())
#: Reasons to drop a subtree: a form or a mark that may stand around a whole page, or one that never does.
SOFT, HARD = 1, 2
DROPPED = frozenset("nav footer aside button select dialog menu head datalist fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp nobr".split())
HASHED = frozenset("div section ul ol li dl table tr nav footer header aside form article main figure details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "pre", "blockquote", "article", "main"}
#: Words in class, id and role that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist disqus respond reply replies discussion related recommended recommendations widget widgets pagination pager "
    "toolbar skip search searchbox copyright complementary contentinfo hidden".split()
)
#: Marks that hold even where a page has no other paragraph.
FIRM = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr comment comments commentlist disqus respond reply replies discussion hidden".split())
#: Class words that tell a state or a place in a list.
STATES = frozenset("active current selected open closed first last odd even here on off".split())
#: Kinds of subtrees, in the lowest two bits of their hashes: of the shape, of the text, and of the text without numbers and case.
LINKS, RUNNING, OTHER = 0, 1, 2
_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>", re.S)
_attribute = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_digits = re.compile("[0-9]+")
_quoted = re.compile(r"\"[^\"]*\"|'[^']*'")
_hidden = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_undisplayed = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none|display:none)""", re.I)
#: A mark with a name before it (site-footer) or a kind of box after it (comments-list). States of a wrapper (has-comments, with-sidebar) aren't marks.
_ends = "|".join(sorted(MARKS - {"hidden"}))
_compound = re.compile(rf"(?!(?:has|with|without|no|is|show|hide)[-_])[a-z0-9_-]+[-_](?:{_ends})|(?:{_ends})[-_](?:area|list|section|wrapper|container|box|bar|block|slot|left|right|top|bottom|form|links|items?)")
_main = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)


def _unseen(attributes: str) -> bool:
    return bool(_hidden.search(_quoted.sub("''", attributes)) or _undisplayed.search(attributes))


def _mark(attributes: str) -> int:
    """0: none, SOFT or HARD."""
    found = 0
    for _, value in _attribute.findall(attributes):
        for name in value.strip("\"'").lower().split():
            if name in FIRM:
                return HARD
            if name in MARKS:
                found = SOFT
            elif _compound.fullmatch(name):
                found = HARD if FIRM.intersection(re.split("[-_]", name)) else SOFT
                if found == HARD:
                    return HARD
    return HARD if _unseen(attributes) else found


def _classes(attributes: str) -> str:
    """The class words of an element in order, without states and digits."""
    words = [w for kind, value in _attribute.findall(attributes) if kind.lower() == "class" for w in value.strip("\"'").lower().split()]
    return " ".join(sorted({_digits.sub("", w) for w in words} - STATES))


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >= 1 << 63 else digest


class _Open:
    """An element whose end hasn't come yet."""

    __slots__ = ("before", "chars", "dropped", "exact", "first", "links", "loose", "name", "rank", "shape", "tag")

    def __init__(self, name: str, tag: str, dropped: int, rank: int, first: int, before: int):
        self.name, self.tag, self.dropped, self.rank, self.first, self.before = name, tag, dropped, rank, first, before
        self.shape, self.exact, self.loose, self.links, self.chars = [], [], [], 0, 0

    def text(self, text: str, linked: bool) -> None:
        self.exact.append(text)
        self.loose.append(_digits.sub("0", text.lower()))
        if (token := "L" if linked else "T") != self.shape[-1:]:
            self.shape.append(token)
        self.chars += len(text)
        self.links += len(text) * linked

    def digests(self) -> tuple[int, int, int]:
        """Of tags and class words with where text and links stand, with the text, and with the text but for numbers and case."""
        return tuple(xxhash.xxh64_intdigest("\n".join([self.tag, *x])) for x in (self.shape, self.exact, self.loose))


class Page:
    """What one reading of a page gives: text, hashes of its containers, deleted subtrees, and whether paragraphs were kept or dropped for a soft reason."""

    def __init__(self, page: str | None, templates=frozenset(), lenient: bool = False, names: bool = True):
        self.hashes: set[int] = set()
        self.deleted = self.kept_prose = self.soft_prose = 0
        self.text = self._read(page or "", templates, lenient, names)

    def _read(self, page: str, templates, lenient: bool, names: bool) -> str:
        blocks: list[tuple[int, str]] = []  # the rank of the enclosing root (2: article, 1: main, 0: none) and the text
        current: list[str] = []
        top = _Open("", "", 0, 0, 0, 0)
        stack = [top]
        at, end, running, linked = 0, len(page), 0, False

        def flush():
            if current:
                if text := " ".join("".join(current).split()):
                    blocks.append((top.rank, text))
                current.clear()

        def close():
            nonlocal top, linked
            own = stack.pop()
            top, linked = stack[-1], False
            if not own.chars:
                return
            shape, exact, loose = own.digests()
            if own.name in HASHED:
                kind = RUNNING if own.rank or running > own.before else LINKS if 2 * own.links >= own.chars else OTHER
                digest = _signed((shape, exact, loose)[kind] & ~3 | kind)
                self.hashes.add(digest)
                if digest in templates:
                    self.deleted += 1
                    del blocks[own.first :]
            if (token := f"{shape:x}") != (top.shape[-1] if top.shape else ""):
                top.shape.append(token)
            top.exact.append(f"{exact:x}")
            top.loose.append(f"{loose:x}")
            top.chars += own.chars
            top.links += own.links

        def opened(name: str, attributes: str, dropped: int, rank: int):
            nonlocal top
            top = _Open(name, f"{name} {_classes(attributes)}" if attributes else name, dropped, rank, len(blocks), running)
            stack.append(top)

        while at < end:
            match = _token.search(page, at)
            stop = match.start() if match else end
            if stop > at and (text := page[at:stop].strip()):
                running += len(text) > SHORT
                top.text(text, linked)
            if stop > at and not top.dropped:
                current.append(html.unescape(page[at:stop]))
            if not match:
                break
            at = match.end()
            name = match[2]
            if name is None:
                continue
            name = name.lower()
            if match[1]:
                if name == "a":
                    linked = False
                if name not in INLINE or any(x.name == name for x in stack[-4:]):
                    if name not in INLINE:
                        flush()
                    if any(x.name == name for x in reversed(stack)):
                        while top.name != name:
                            close()
                        close()
                continue
            attributes = match[3].strip()
            if name in RAW:
                if not attributes.endswith("/"):
                    closing = re.compile(f"</{name}", re.I).search(page, at)
                    at = page.find(">", closing.start()) + 1 or end if closing else end
                continue
            if name in INLINE:
                linked = linked or name == "a"
                if names and not top.dropped and attributes and (mark := _mark(attributes)) and not (lenient and mark == SOFT):
                    opened(name, attributes, mark, top.rank)
                continue
            flush()
            if name in VOID:
                continue
            if top.name == "p" or name == top.name in ("li", "td", "th", "tr", "dt", "dd", "option"):
                close()  # the end tag was left out
            rank, dropped = top.rank, top.dropped
            if not dropped and names:
                if name == "form":
                    dropped = SOFT
                elif name in DROPPED or name == "header" and not rank:
                    dropped = HARD
                elif attributes and name not in ("html", "body"):
                    # Marks don't apply to an article or a main part.
                    dropped = HARD * _unseen(attributes) if name == "main" or name == "article" and rank < 2 else _mark(attributes)
                if lenient and dropped == SOFT:
                    dropped = 0
            if not dropped and names:
                if name == "article":
                    rank = 2
                elif rank < 2 and (name == "main" or attributes and _main.search(attributes)):
                    rank = 1
            opened(name, attributes, dropped, rank)
            if name in PROSE:
                running += 1
                self.kept_prose += not dropped
                self.soft_prose += dropped == SOFT
        flush()
        while len(stack) > 1:
            close()
        # A teaser in an article element isn't the page's text: articles must hold half of the text around them.
        sizes = [sum(len(text) for rank, text in blocks if rank >= r) for r in range(3)]
        outer = 1 if any(rank == 1 for rank, _ in blocks) else 0
        best = 2 if sizes[2] and 2 * sizes[2] >= sizes[outer] else outer
        return " ".join(text for rank, text in blocks if rank >= best)


def main_text(page: str | None, templates=frozenset()) -> tuple[str, int]:
    """The main text of a page without the subtrees whose hashes are ``templates``; and the number of those."""
    own = Page(page, templates)
    if not own.kept_prose and own.soft_prose:
        own = Page(page, templates, lenient=True)
    if not own.text and own.deleted and any(h & 3 == LINKS for h in own.hashes & templates):
        own = Page(page, frozenset(h for h in templates if h & 3 != LINKS))
    return own.text, own.deleted


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """host and hash of the subtrees that recur."""

    def run(batches):
        for batch in batches:
            rows = [sorted(Page(x.as_py()).hashes) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["host", "hashes"])

    found = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, hashes array<bigint>")
    # The empty list's row counts the page.
    counted = found.select("host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    counted = common.written(counted.where((F.col("n") >= PAGES) | F.col("hash").isNull()), "subtrees")
    all_pages = counted.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    return counted.where("hash IS NOT NULL").join(all_pages, "host").where((F.col("hash").bitwiseAND(F.lit(3)) == OTHER) | (F.col("n") >= SHARE * F.col("pages"))).select("host", "hash")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, and n_templates, how many of its subtrees were deleted as templates."""
    recurring = common.written(templates(pages), "templates")
    # At most 1 / PAGES of the containers of all pages of a host.
    by_host = recurring.groupBy("host").agg(F.collect_list("hash").alias("hashes"))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    if recurring.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(by_host), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        rows = rows.join(by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            pages = [main_text(x.as_py(), frozenset(h.as_py() or ())) for x, h in zip(batch.column(2), batch.column(3))]
            texts = [text for text, _ in pages]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([n for _, n in pages], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_templates"])

    return rows.select("page_id", "url", "html", "hashes").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint, n_templates bigint")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))
