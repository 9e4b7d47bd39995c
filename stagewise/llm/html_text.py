"""Main text of HTML pages by two-pass block rules.

The page is read into blocks (text between block-level tags) with the share of stop words,
of link text, the length and the place of each. The first pass decides each block alone:
blocks inside menus, headers, footers, sidebars, adverts, forms, notices or comments and
blocks that are mostly links are bad; long blocks with many stop words are good, long ones
with few are bad, blocks of middle length are good with a fair share and bad without any, and short ones and the rest stay open.
How many is many depends on the page: three quarters of the mean share of its prose, or half of it for a fair share, and never more
than `stop_high` and `stop_low`. Stop words say nothing of blocks in another script, nor on a page without any: there length and
links decide. A marked article counts as a bonus to the share of stop words
of the blocks in it, large enough that they need none, and as a bad prior for short blocks outside. The marks hold if
their text is at least as long as the text outside that the stop words call good; else they are teasers: their short
blocks are bad and their long ones are judged without the bonus. The second pass gives open blocks the label of their nearest decided
neighbours (frames like menus don't count): that of both if they agree, else that of the nearer one, and the bad one's
on a tie.

Frames that only a class or id names, and forms, yield to an article inside them if the page has no article outside such a frame.
On a page without any article they yield if they hold most of its text and a long block, but those named as comments, adverts or
menus never do.

Reading takes time in proportion to the page: elements dropped whole (scripts, buttons, pictures) are skipped to their close, and one
that is never closed drops no text but its tag's; only unclosed raw text (script, style) ends with the page or at its body.

Defined cases: null html is empty and gives an empty text, and so do pages without text; text without any tag is one
block; unclosed tags end with their parent; pages of any length are read whole; ties between neighbours go to the bad one; rows with
equal keys and repeated rows stay separate; an empty table stays empty; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common function words of the languages that are expected.
STOP = frozenset(
    """the of and to a in is it that for was on are with as be by this from or an at not have has had but they his her you we which
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    le la les de des un une et est en que qui dans pour pas sur par au du avec ce il sont plus ne se ou mais
    el los las y del que por con una su para es al lo como más pero sus o este sí porque esta entre cuando
    il lo gli di e che è per non una del della con sono si da come più ma al dei nel alla
    o os um uma do da dos das em no na não para com se por mais como mas ao foi
    de het een van en in is op te dat die voor niet met zijn aan er ook als door""".split()
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe head".split())  # their content holds no tags, or none that matter
SKIPPED = frozenset("noscript template svg object select button canvas audio video".split())
FRAME_TAGS = frozenset("nav footer aside menu dialog".split())
FRAME_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb
    breadcrumbs footer masthead comment comments respond disqus replies cookie cookies consent gdpr notice notices alert newsletter subscribe signup login
    share sharing social related recommended recommendations popular trending widget popup modal overlay toolbar pagination pager copyright legal disclaimer search""".split()
)
# Words beside a frame word that leave a name a frame's.
NEUTRAL = frozenset("box bar block button buttons container content wrapper wrap inner outer area section list link links form panel unit slot top bottom left right main page site post article entry global text".split())
FIRM = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond
    disqus replies cookie cookies consent gdpr pagination pager""".split()
)
ASIDE_ARTICLES = frozenset("comment teaser card promo sponsored ad advert related recommended".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th figure figcaption".split())
MAIN_WORDS = frozenset("article-body articlebody post-content entry-content article-content main-content story-body post-body".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+')?)*+)>""")
_SIGNS = ".,;:!?\"'()[]{}<>*#%&$|/\\+-–—…«»“”„‘’"
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Block:
    __slots__ = ("parts", "link", "bad", "inside", "soft", "outer")

    def __init__(self, bad: bool, inside: bool, soft: int, outer: int) -> None:
        self.parts, self.link, self.bad, self.inside, self.soft, self.outer = [], 0, bad, inside, soft, outer


class Page:
    """blocks, and the frames that may yield: the parent of each (-1: none), and whether it is firm."""

    def __init__(self) -> None:
        self.blocks, self.parent, self.firm = [], [], []


def _named(tag: str, name: str, value: str, in_article: bool) -> set[str]:
    """The words by which a class or id says frame. In an article, prose ignores both, and all words of a name must fit."""
    if in_article and (tag in PROSE or tag == "section" and name == "id"):
        return set()
    got: set[str] = set()
    for x in value.split():
        words = set(re.split(r"[^a-z0-9]+", x))
        if not x.startswith(("with-", "has-", "no-")) and (not in_article or words <= FRAME_WORDS | NEUTRAL and (tag != "section" or len(words) == 1)):
            got |= words & FRAME_WORDS
    return got


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """'frame' for what surrounds the text, 'words' or 'firm' if only a class or id says so, 'main' for a marked article, else ''."""
    if tag in FRAME_TAGS or tag == "header" and not in_article:
        return "frame"
    if tag in ("article", "main"):
        names = [x for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() == "class" for x in (m[2] or m[3] or m[4] or "").lower().split()]
        return "frame" if tag == "article" and any(re.split(r"[-_]+", x)[-1] in ASIDE_ARTICLES and not x.startswith(("with-", "has-", "no-")) for x in names) else "main"
    if tag == "form":
        return "words"
    if not attributes or tag in ("html", "body"):
        return ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if MAIN_WORDS.intersection(value.split()):
                return "main"
            words = _named(tag, name, value, in_article)
            if words:
                return "firm" if words & FIRM else "words"
        elif name == "role" and value in FRAME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return "frame"
        elif name == "role" and value in ("main", "article") or name == "itemprop" and value == "articlebody":
            return "main"
    return ""


class _Closes:
    """Where the elements of a page that are dropped whole end."""

    def __init__(self, page: str) -> None:
        self.page, self.next = page, {}

    def find(self, pattern: str, at: int) -> re.Match | None:
        """The next match from at on; a match ahead and the lack of one are remembered, so that each stretch is read once."""
        if pattern not in self.next or self.next[pattern] is not None and self.next[pattern].start() < at:
            self.next[pattern] = re.compile(pattern, re.IGNORECASE).search(self.page, at)
        return self.next[pattern]

    def end(self, tag: str, at: int) -> int:
        """Where the element ends whose start tag ends at `at`."""
        close = self.find(rf"</{tag}(?=[\s/>])[^>]*>", at)
        if tag in RAW:
            body = self.find(r"<body(?=[\s/>])", at) if close is None or tag == "head" else None
            ends = [m for m in (close.end() if close else None, body.start() if body else None) if m is not None]
            return min(ends, default=len(self.page))
        if close is None:
            return at
        again = self.find(rf"<{tag}(?=[\s/>])", at)
        return close.end() if tag == "svg" or again is None or again.start() > close.start() else at


def read(page: str) -> Page:
    out = Page()
    # (tag, frame, soft, outer, inside, link) of the open elements: in a frame; the innermost frame by name or form below the
    # innermost article, and the innermost around it; in an article; in a link
    stack: list[tuple] = [("", False, -1, -1, False, False)]
    opened: dict[str, int] = {}
    places: list[int] = []  # of block-level elements in the stack
    at, last, closes = 0, page.rfind(">"), _Closes(page)
    out.blocks.append(Block(False, False, -1, -1))

    def close(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1
        while places and places[-1] >= k:
            places.pop()

    def text(t: str) -> None:
        if t:
            t = html.unescape(t)
            out.blocks[-1].parts.append(t)
            if stack[-1][5]:
                out.blocks[-1].link += len(t.strip())

    while True:
        start = page.find("<", at)
        if start < 0 or start > last:
            text(page[at:])
            return out
        if page.startswith("<!--", start):
            text(page[at:start])
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            text(page[at:start])
            at = page.find(">", start) + 1
            continue
        if not (m := _TAG.match(page, start) or _PLAIN_TAG.match(page, start)):  # a sign, not a tag
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at, tag = m.end(), m[2].lower()
        if tag == "br":
            out.blocks[-1].parts.append(" ")
            continue
        if m[1]:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
        else:
            whole = m[3].endswith("/")
            if (tag in RAW or tag in SKIPPED) and not (whole and tag not in RAW):
                at = closes.end(tag, at)
                continue
            if tag in BLOCKS and tag != "hr" and places:  # a paragraph ends where the next block begins
                above = stack[places[-1]][0]
                if above == "p" or above == tag == "li":
                    close(places[-1])
            if tag not in VOID and not whole:
                _, frame, soft, outer, inside, link = stack[-1]
                kind = _kind(tag, m[3], inside)
                if kind in ("words", "firm"):
                    out.parent.append(soft)
                    out.firm.append(kind == "firm")
                    soft = len(out.parent) - 1
                elif kind == "main":
                    outer, soft, inside = (soft if soft >= 0 else outer), -1, True
                stack.append((tag, frame or kind == "frame", soft, outer, inside, link or tag == "a"))
                opened[tag] = opened.get(tag, 0) + 1
                if tag in BLOCKS:
                    places.append(len(stack) - 1)
        if tag in BLOCKS:
            _, frame, soft, outer, inside, _ = stack[-1]
            out.blocks.append(Block(frame, inside, soft, outer))


def _framed(page: Page, kept: list, long: int) -> None:
    """Settles which frames by name yield, and marks the blocks of the others."""
    if not page.parent:
        return
    own = any(b.inside and not b.bad and b.soft < 0 and b.outer < 0 for b, _, _ in kept)  # an article outside any of them
    some = own or any(b.inside and not b.bad and b.soft < 0 for b, _, _ in kept)
    held, longest, total = [0] * len(page.parent), [0] * len(page.parent), 0
    for b, _, size in kept:
        if not b.bad:
            total += size
            for f in (b.soft, b.outer):
                if f >= 0:
                    held[f] += size
                    longest[f] = max(longest[f], size)
    for f in range(len(page.parent) - 1, -1, -1):  # a frame's parent has a smaller number
        if page.parent[f] >= 0:
            held[page.parent[f]] += held[f]
            longest[page.parent[f]] = max(longest[page.parent[f]], longest[f])
    stays = [some or page.firm[f] or 2 * held[f] <= total or longest[f] <= long for f in range(len(page.parent))]
    for f, parent in enumerate(page.parent):
        stays[f] = stays[f] or parent >= 0 and stays[parent]
    for b, _, _ in kept:
        b.bad = b.bad or b.soft >= 0 and stays[b.soft] or own and b.outer >= 0


_WIDE, _LETTER, _FAR = re.compile("[⺀-￯]"), re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_\x00-ɏ]")


def _weight(words: list[str]) -> int:
    """Length of the joined words; signs that stand for syllables or words count three times."""
    text = " ".join(words)
    return len(text) + (0 if text.isascii() else 2 * len(_WIDE.findall(text)))


def _other_script(words: list[str]) -> bool:
    text = " ".join(words)
    return not text.isascii() and _FAR.search(text) is not None and 2 * len(_FAR.findall(text)) > len(_LETTER.findall(text))


def main_text(page: str, short: int = 70, long: int = 200, stop_low: float = 0.2, stop_high: float = 0.3, link_high: float = 0.5) -> str:
    tree, kept = read(page), []
    for b in tree.blocks:
        words = "".join(b.parts).split()
        if words:
            kept.append((b, words, _weight(words)))
    _framed(tree, kept, long)
    share = [sum(w.strip(_SIGNS).lower() in STOP for w in words) / len(words) for _, words, _ in kept]
    prose = [(x, size) for (b, _, size), x in zip(kept, share, strict=True) if not b.bad and size >= short and b.link <= link_high * size]
    mean = sum(x * size for x, size in prose) / max(1, sum(size for _, size in prose))
    stop_low, stop_high = min(stop_low, mean / 2), min(stop_high, 0.75 * mean)
    shares = {id(b): (x if mean and not _other_script(words) else None) for (b, words, _), x in zip(kept, share, strict=True)}

    def judge(b: Block, words: list[str], size: int, bonus: float) -> bool | None:
        """The block's own label."""
        if b.link > link_high * size:
            return None if bonus and size < short else False
        if bonus and size < short:
            return True
        if shares[id(b)] is None and not bonus:  # stop words say nothing here
            return True if size > long else None
        stop = (shares[id(b)] or 0) + bonus
        if size <= long:
            return True if size >= short and stop >= stop_low else None if size < short or stop else False
        return stop >= stop_high or (None if stop >= stop_low else False)

    inside = sum(size for b, _, size in kept if b.inside and not b.bad and b.link <= link_high * size)
    outside = sum(size for b, words, size in kept if not b.inside and not b.bad and judge(b, words, size, 0))
    marks = any(b.inside and not b.bad for b, _, _ in kept)
    marked = marks and inside >= outside
    labels: list[bool | None] = []
    for b, words, size in kept:  # first pass
        x = False if b.bad else judge(b, words, size, 1 if marked and b.inside else 0)
        if marked and not b.inside and x is None:
            x = False
        elif marks and not marked and b.inside and not x:  # teasers count as frames
            x, b.bad = False, True
        labels.append(x)
    decided = [i for i, x in enumerate(labels) if x is not None and not kept[i][0].bad]
    final, k = [], 0
    for i, x in enumerate(labels):  # second pass
        while k < len(decided) and decided[k] < i:
            k += 1
        if x is None:
            before, after = (decided[k - 1] if k else None), (decided[k] if k < len(decided) else None)
            near = [j for j in (before, after) if j is not None]
            if not near:  # a page of short blocks only
                x = True
            elif len(near) == 1 or labels[near[0]] == labels[near[1]]:
                x = labels[near[0]]
            else:
                gap = [abs(i - j) for j in near]
                x = False if gap[0] == gap[1] else labels[near[gap.index(min(gap))]]
        final.append(x)
    return " ".join(" ".join(words) for (_, words, _), x in zip(kept, final, strict=True) if x)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without html_col, with the main text as out_col."""
    others = [c for c in pages.columns if c not in (html_col, out_col)]
    places = [f"c{i}" for i in range(len(others))]
    keep = pages.select(*(F.col(c).alias(p) for c, p in zip(others, places, strict=True)), F.col(html_col).alias("page"))

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column(b.num_columns - 1)]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string())], names=[*places, "text"])

    out = keep.mapInArrow(run, keep.select(*places, F.lit("").alias("text")).schema)
    return out.select(*(F.col(p).alias(c) for c, p in zip(others, places, strict=True)), F.col("text").alias(out_col))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
