"""Main text of web pages by block rules in two passes.

A page is cut into blocks of text at block-level tags; what a browser doesn't show
(scripts, styles, hidden elements, controls) is no text. The first pass scores
every block: length and stop words speak for main text, links against it, a
content container a little for it, and an element or name that says advert, menu,
comment and the like against it. A name is judged by what its element holds: one
around the main heading or an article (on a page without either, around half of
its text and several blocks) is a wrapper's and says nothing. High scores are main
text, low ones boilerplate, and what lies between, mostly short blocks, stays
undecided. In the second pass an undecided block takes the label of the nearest
decided block of its section; between two labels at the same distance a heading
goes with what follows it, and any other block is main text only if it stands in
a content container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import small_batches, table

#: Function words of the corpus languages (fixed values).
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by for from had has have he her his if in into is it its of on or she that the their them they this to was we were which who will with you "
        "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
        "als am an auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wird zu zum zur "
        "al como con del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también te un una y ya"
    ).split()
)
#: Elements whose content is never shown as text.
DROPPED = frozenset("script style noscript template iframe object svg math canvas head title select option button textarea input label datalist audio video map".split())
#: Elements whose name speaks against their text.
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the second kind ends an open element of the first.
CLOSES = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"])}
#: Words in class, id or role that name boilerplate (fixed values).
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|byline|captcha|comments?|commentlist|consent|cookies?|copyright|credits?|disqus|dropdown|footer|footnav|gdpr|header|hidden|legal|login|masthead|menu|modal|nav|navbar|navigation|navigation|newsletter|notices?|outbrain|overlay|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|shoutbox|sidebar|sidenav|signup|skip|social|sponsor\w*|subscribe|taboola|tags|toolbar|topbar|tracking|widget|complementary|contentinfo|alert|alertdialog)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Content containers.
CONTENT = frozenset(["article", "main"])
#: What a page's own boxes hold, but not its boilerplate.
WRAPPED = frozenset(["article", "main", "h1"])
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([!?/])[^>]*(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=\s|/|$)", re.IGNORECASE)
WORD = re.compile(r"\w+")

#: Score of a block: for its words up to ``WORDS_LONG``, its share of stop words (fully from ``WORDS_SHORT`` words on), its
#: share of characters in links, a content container, and a name that speaks against it.
WORDS_LONG, WORDS_SHORT = 50, 10
FOR_LENGTH, FOR_STOPS, FOR_LINKS, FOR_CONTAINER, FOR_NAME = 2.0, 4.0, -6.0, 0.5, -5.0
#: Share of the text and number of blocks from which on an element is a wrapper, where a page has no main heading or article.
WRAPS, WRAPPED_BLOCKS = 0.5, 3
#: Scores from which on a block is main text, and up to which it is boilerplate.
MAIN, REST = 1.0, 0.0


class Block(NamedTuple):
    text: str
    #: Characters in links.
    linked: int
    heading: bool
    #: In a content container.
    content: bool
    #: A name speaks against it.
    named: bool


def _evidence(attributes: str) -> tuple[bool, bool]:
    """(never shown, a name speaks against it)."""
    named = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, False
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True, False
        elif NAMED.search(value):
            named = True
    return False, named


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    around: list[tuple[int, ...]] = []  # the named elements around each block
    wrappers: set[int] = set()  # those that hold a main heading or an article
    texts: list[str] = []
    linked = 0
    open_elements: list[tuple[str, bool, bool]] = []  # (name, starts what is not shown, starts what a name speaks against)
    opened: Counter[str] = Counter()  # how many of each name are open
    named: list[int] = []
    hidden = links = content = headings = elements = 0
    told = False  # whether a main heading or an article says where the page's text is
    at = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            whole = " ".join(html.unescape("".join(texts)).split())
            if whole:
                out.append(Block(whole, linked, headings > 0, content > 0, False))
                around.append(tuple(named))
            texts.clear()
        linked = 0

    def leave() -> None:
        nonlocal hidden, links, content, headings
        name, unseen, against = open_elements.pop()
        opened[name] -= 1
        if against:
            flush()
        headings -= name in HEADINGS
        hidden -= unseen
        if against:
            named.pop()
        links -= name == "a"
        content -= name in CONTENT

    def say(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            texts.append(text)
            if links:
                linked += len(text)

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        found = TAG.match(page, lt)
        if not found:  # a lone less-than sign
            say(page[at:lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = found.end()
        name = found[3]
        if name is None:  # comments and declarations
            continue
        name = name.lower()
        if found[2]:
            if name in BLOCKS:
                flush()
            if opened[name]:
                while open_elements[-1][0] != name:
                    leave()
                leave()
            continue
        if name in BLOCKS:
            flush()
        while open_elements and name in CLOSES.get(open_elements[-1][0], ()):
            leave()
        if name in BLOCKS and any(x == "p" for x, *_ in open_elements[-4:]) and name != "br":
            # inline elements left open in a paragraph end with it
            k = max(i for i in range(max(0, len(open_elements) - 4), len(open_elements)) if open_elements[i][0] == "p")
            if all(x not in BLOCKS for x, *_ in open_elements[k + 1:]):
                while len(open_elements) > k:
                    leave()
        if name in VOID or found[4].rstrip().endswith("/") and name not in BLOCKS and name not in DROPPED:
            continue
        if name in ("script", "style", "textarea", "title", "iframe", "noscript", "template"):
            # raw text: nothing inside is markup
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        unseen, against = (False, False) if name in ("html", "body", "article", "main") else _evidence(found[4])
        unseen, against = unseen or name in DROPPED, against or name in BOILERPLATE
        if unseen or against:
            flush()
        open_elements.append((name, unseen, against))
        opened[name] += 1
        hidden += unseen
        if name in WRAPPED:
            wrappers.update(named)
            told = True
        if against:
            elements += 1
            named.append(elements)
        links += name == "a"
        headings += name in HEADINGS
        content += name in CONTENT
    flush()
    if not told:
        held: Counter[int] = Counter()
        blocks: Counter[int] = Counter()
        for block, own in zip(out, around, strict=True):
            for element in own:
                held[element] += len(block.text) - min(block.linked, len(block.text))
                blocks[element] += 1
        most = WRAPS * sum(len(b.text) for b in out)
        wrappers.update(e for e in held if held[e] >= most and blocks[e] >= WRAPPED_BLOCKS)
    return [b._replace(named=any(e not in wrappers for e in own)) for b, own in zip(out, around, strict=True)]


def score(block: Block) -> float:
    words = WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return (
        FOR_LENGTH * min(1, len(words) / WORDS_LONG) + FOR_STOPS * stops * min(1, len(words) / WORDS_SHORT)
        + FOR_LINKS * min(1, block.linked / len(block.text)) + FOR_CONTAINER * block.content + FOR_NAME * block.named
    )


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """True: main text, False: boilerplate, None: undecided."""
    return [True if s >= MAIN else False if s <= REST else None for s in map(score, blocks)]


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Labels of all blocks. A block that its name speaks against says nothing of those around it.

    Neighbours lie in the same section, in content containers or outside of
    them. Where nothing in a section is decided, its undecided blocks are main text.
    """
    out = list(labels)
    for content in (False, True):
        own = [i for i, b in enumerate(blocks) if b.content == content]
        before, after = [None] * len(own), [None] * len(own)
        for found, order in ((before, range(len(own))), (after, range(len(own) - 1, -1, -1))):
            last = None
            for k in order:
                if labels[own[k]] is not None and not blocks[own[k]].named:
                    last = k
                found[k] = last
        for k, i in enumerate(own):
            if labels[i] is not None:
                continue
            a, b = before[k], after[k]
            if a is None and b is None:
                out[i] = True
            elif a is None or b is not None and b - k < k - a:
                out[i] = labels[own[b]]
            elif b is None or k - a < b - k:
                out[i] = labels[own[a]]
            elif blocks[i].heading:
                out[i] = labels[own[b]]
            else:
                labelled = labels[own[a]], labels[own[b]]
                out[i] = any(labelled) if content else all(labelled)
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; a page without markup is its own text."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, keep in zip(blocks, second_pass(blocks, first_pass(blocks)), strict=True) if keep)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` without its html column, with the main text of each page.

    Row by row and in batches; nothing is shuffled. A null or empty page gives
    an empty text; repeated rows stay; a column named like ``out`` is replaced.
    """
    from pyspark.sql import types as T

    kept = [c for c in df.columns if c not in (page, out)]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], [*kept, out])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType())])
    return df.select(*kept, F.col(page).cast("string").alias("_page_")).mapInArrow(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
