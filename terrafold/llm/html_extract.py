"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOISE = frozenset("nav footer aside script style noscript template iframe object svg canvas button select textarea dialog menu head audio video map".split())
SEMANTIC = frozenset("article main".split())
CONTAINER = frozenset("article main body section div td center".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that stand inside a line of text, whether or not theirs is read: they do not end a block.
PHRASING = INLINE | frozenset("button select textarea svg script style noscript template object canvas iframe audio video map".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("article main body section div table ul ol dl nav aside footer header form blockquote td th li".split())
# Words that end a class, id or role name of boilerplate. The first ones count for paragraphs and inline
# elements too, the others for containers only.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter notice notices "
    "comment comments commentlist disqus discussion discussions breadcrumb breadcrumbs nav navbar navigation menu pagination pager footer".split()
)
MARKS = STRONG | frozenset(
    "banner header masthead sidebar rail reply replies respond notification alert popup modal overlay subscribe signup login share sharing social "
    "related recommended popular trending skip toolbar widget contentinfo complementary search".split()
)
# Words that are part of other names too: inside an article they count only if all of the name's words are known here.
UNSURE = frozenset("notice notices share sharing search rail reply replies respond alert header banner notification overlay login related popular trending promotion promo discussion discussions menu pagination footer skip widget".split())
PLAIN = frozenset("main top bottom left right center site global page post article news social inline mobile desktop user reader readers email fb twitter mid in sticky fixed floating side outer inner bar full wide small large first second last js".split())
# Words after which a name still means what the word before says, and words with which it means something else.
TAIL = frozenset("now today area bar block body bottom box button buttons container content form group holder inner items left link links list message module outer panel placeholder posts right row section slot stories text thread top unit wrap wrapper".split())
OTHER = frozenset("no not non without with has is open opened closed close enabled disabled enable disable hide hidden show allow allowed free count".split())
# Words that also name the layout around an article: they do not hold for an element that has an article inside.
LAYOUT = frozenset("header masthead sidebar rail widget menu nav navbar banner toolbar".split())
# Words that mark an article element itself as something else.
NOT_THE_ARTICLE = frozenset("comment comments reply replies related recommended sponsored promo ad ads advert".split())
# Headings that open a section of reader comments or of other boilerplate.
HEADS = re.compile(
    r"\W*(\d+\W+)?((reader |user |leserinnen |leser)?(comments?|responses?|replies|discussion|kommentare?|meinungen|opinions?|reactions?|réactions?|commentaires?|comentarios?|opiniones)"
    r"( (der leser|von lesern|of readers|from readers|des lecteurs|de lecteurs|de los lectores|de lectores))?|"
    r"leave a (comment|reply)|join the (discussion|conversation)|what (our )?readers say|leserbriefe|avis des lecteurs|newsletter|advertisement|sponsored|anzeige|publicité|publicidad|"
    r"(weitere |verwandte |ähnliche |more |related )(articles|posts|stories|artikel)|articles? liés|artículos relacionados)(\W+\d+)?\W*",
    re.IGNORECASE,
)
# Headings that open lists of other pages, unless they are an article's own.
LISTS = re.compile(r"\W*(\d+\W+)?(articles|posts|stories|artikel)(\W+\d+)?\W*", re.IGNORECASE)
# What stands at the foot of each reader's comment.
REPLY = re.compile(r"\W*(reply|reply to this|answer|antworten|répondre|responder|rispondi|reageren)(\W+\d+)?\W*", re.IGNORECASE)
UNSEEN = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)

#: Standard deviation, in lines, of the smoothing.
SIGMA = 1.0
#: A container holds the article if so much of the content lines' text is in it.
SHARE = 0.9
#: Attributes and headings that leave less than this of the article's text are not believed.
LEAST = 0.2
#: A list with so many links, and so much of its text in them, is a menu unless it is in an article element.
LINKS, LINKED = 3, 0.9
SPACE = re.compile(r"\s+")
STATES = re.compile(r"<!--(?:-?>)?|-->|</?(?:script|style)", re.IGNORECASE)
CUT = re.compile(r"</?[A-Za-z!?]|<$")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def boilerplate_words(attrs: list, in_article: bool = False) -> set[str]:
    """The words that class, id and role names end with, neutral ones apart; names with a word of OTHER say nothing, and
    in an article a word of UNSURE only counts if the rest of its name is known too."""
    found = set()
    for k, v in attrs:
        for name in v.split() if v and k in ("class", "id", "role") else ():
            words = [w.lower() for w in WORDS.findall(name)]
            while len(words) > 1 and (words[-1] in TAIL or len(words[-1]) == 1):
                words.pop()
            if words and words[-1] in MARKS and OTHER.isdisjoint(words):
                known = words[-1] not in UNSURE or all(w in MARKS or w in TAIL or w in PLAIN for w in words)
                if known or not in_article:
                    found.add(words[-1])
    return found


def unseen(attrs: list) -> bool:
    """Whether an element's attributes keep it from being shown."""
    return any(k == "hidden" and v != "until-found" or k == "style" and v and UNSEEN.search(v) for k, v in attrs)


class Page(HTMLParser):
    """Records a page's events: the tree of its elements, and its blocks of text pieces, each in its element.

    All steps take time in proportion to the page, however deep it nests."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.words, self.unseen = [""], [0], [frozenset()], [False]  # element 0 is the page
        self.open, self.places = [0], {}  # open elements, and where in that list those of each tag stand
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self.pieces: list[tuple[int, str]] = []
        self.tags = 0

    def end_block(self) -> None:
        if self.pieces:
            self.blocks.append((self.tags, self.pieces))
            self.pieces, self.tags = [], 0

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop(self, to: int) -> None:
        for e in reversed(self.open[to:]):
            self.places[self.tag[e]].pop()
        del self.open[to:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in PHRASING:
            self.end_block()
        elif tag == "br":
            self.pieces.append((self.open[-1], " "))
        if tag in VOID:
            return
        if tag in CLOSES:
            floor = self.last(SCOPE - CLOSES[tag])
            at = min((p[bisect_right(p, floor)] for t in CLOSES[tag] if (p := self.places.get(t)) and p[-1] > floor), default=0)
            if at:
                self.pop(at)
        words = boilerplate_words(attrs, self.last(SEMANTIC) > 0) if attrs and tag not in ("body", "html") else set()
        if words:
            if tag in SEMANTIC:
                words &= NOT_THE_ARTICLE
            elif tag in INLINE or tag in HEADING or tag == "p":
                words &= STRONG
            elif self.last(SEMANTIC):
                words -= {"header"}  # an article's own
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(self.open[-2])
        self.words.append(words)
        self.unseen.append(bool(attrs) and tag not in ("body", "html") and unseen(attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in PHRASING:
            self.end_block()
        at = self.last([tag])
        if at and not (tag in INLINE and at < self.last(SCOPE)):
            self.pop(at)

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1], data))


def below(parent: list[int], own: list) -> list:
    """Whether each element or one around it is set."""
    out = list(own)
    for e in range(1, len(out)):
        out[e] = out[e] or out[parent[e]]
    return out


def around(parent: list[int], e: int) -> Iterator[int]:
    """The element and those around it, innermost first."""
    while e:
        yield e
        e = parent[e]


def sums(parent: list[int], own: list[int]) -> list[int]:
    """Total of each element and all inside it."""
    out = list(own)
    for e in range(len(out) - 1, 0, -1):
        out[parent[e]] += out[e]
    return out


def hidden(page: Page) -> list[bool]:
    """Which elements are boilerplate: by their tag, by what their attributes or headings say, as lists of links, or as
    readers' comments, each with its link to reply."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    within = below(parent, [t in SEMANTIC and not w for t, w in zip(tag, page.words, strict=True)])
    # A header is an article's own if it is inside one: its headings count, its other text does not.
    outer = below(parent, [u or t in NOISE or (t == "header" and not within[p]) for t, u, p in zip(tag, page.unseen, parent, strict=True)])
    own_header, heading = below(parent, [t == "header" for t in tag]), below(parent, [t in HEADING for t in tag])
    gone = [o or (h and not k) for o, h, k in zip(outer, own_header, heading, strict=True)]

    size, first, heads, replies = [0] * n, [-1] * n, {}, [0] * n
    for at, (e, text) in enumerate(x for _, pieces in page.blocks for x in pieces):
        text = text.strip()
        if text and len(text) < 40 and tag[e] in ("a", "button", "span") and REPLY.fullmatch(text):
            replies[e] += 1
        if text and not gone[e]:
            size[e] += len(text)
            if heading[e]:
                heads.setdefault(e, []).append(text)
            while e and first[e] < 0:
                first[e] = at
                e = parent[e]
    total = sums(parent, size)
    holds = sums(parent, [int(t in SEMANTIC and not w) for t, w in zip(tag, page.words, strict=True)])
    marked = [bool(w) and not (w <= LAYOUT and h) or t == "form" for w, h, t in zip(page.words, holds, tag, strict=True)]
    for e, parts in heads.items():
        while tag[e] not in HEADING:
            e = parent[e]
        up = parent[e]
        said = " ".join(parts)
        if tag[up] in ("section", "div") and first[up] == first[e] and (HEADS.fullmatch(said) or not within[up] and LISTS.fullmatch(said)):
            marked[up] = True
    replies, holding = sums(parent, replies), {}
    for e in range(1, n):
        if replies[e] and not holds[e]:
            holding.setdefault((parent[e], tag[e]), []).append(e)
    for comments in holding.values():  # like elements side by side, each with a link to reply
        if len(comments) > 1:
            for e in comments:
                marked[e] = True
    in_link = below(parent, [t == "a" for t in tag])
    linked, links = sums(parent, [s if k else 0 for s, k in zip(size, in_link, strict=True)]), sums(parent, [int(t == "a") for t in tag])
    for e in range(1, n):
        if tag[e] in ("ul", "ol", "div", "section", "table") and links[e] >= LINKS and linked[e] >= LINKED * total[e] and not within[e]:
            marked[e] = True

    scope = [s if w else 0 for s, w in zip(size, within, strict=True)]
    scope = scope if any(scope) else size
    whole, inside = sum(scope), sums(parent, scope)
    for _ in range(8):
        out = below(parent, [g or m for g, m in zip(gone, marked, strict=True)])
        if sum(s for s, o in zip(scope, out, strict=True) if not o) >= LEAST * whole:
            return out
        outermost = [e for e in range(1, n) if marked[e] and not out[parent[e]]]
        if not outermost:
            return out
        marked[max(outermost, key=inside.__getitem__)] = False
    return gone


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def complete(html: str) -> str:
    """The page up to a comment or tag that its end cuts off: that is markup, not text."""
    state, since = "", 0
    for m in STATES.finditer(html):
        found = m[0].lower()
        if state in ("script", "style"):
            state = "" if found == f"</{state}" else state
        elif state == "<!--":
            state = "" if found == "-->" else state
        elif found in ("<!--", "<script", "<style"):
            state, since = found.removeprefix("<") if found != "<!--" else found, m.start()
    html = html[:since] if state == "<!--" else html
    cut = CUT.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The article's blocks, joined by blank lines.

    Lines whose smoothed text-to-tag ratio reaches the page's standard deviation are content. The article is the
    smallest article or main element that holds this share of the content's characters, else the only such element that
    the page has, else the smallest container that holds the share; all of its lines outside boilerplate elements are kept, short ones too. What attributes and headings call boilerplate
    is believed only while it leaves a fair part of the article.
    """
    if not html:
        return ""
    page = Page()
    page.feed(complete(html))
    page.close()
    page.end_block()
    out, lines, tags = hidden(page), [], 0
    for n, pieces in page.blocks:
        tags += n
        kept = [(e, text) for e, text in pieces if not out[e]]
        if line := SPACE.sub(" ", "".join(text for _, text in kept)).strip():
            lines.append((line, tags, next(e for e, text in kept if text.strip())))
            tags = 0
    if not lines:
        return ""
    ratios = smoothed(np.array([len(t) / max(1, n) for t, n, _ in lines]), sigma)
    content = ratios >= min(float(ratios.std()), float(ratios.max()))
    held = [0] * len(page.tag)
    for (text, _, e), ok in zip(lines, content, strict=True):
        held[e] += len(text) if ok else 0
    held = sums(page.parent, held)
    region = 0
    for kinds in (SEMANTIC, CONTAINER):
        fit = [e for e, size in enumerate(held) if page.tag[e] in kinds and size >= share * held[0]]
        if fit:
            region = max(fit)  # the innermost: opened last
            break
        if kinds is SEMANTIC:
            alone = [e for e in range(1, len(held)) if page.tag[e] in kinds and not out[e]]
            outermost = [e for e in alone if not any(x != e and x in alone for x in around(page.parent, e))] if len(alone) < 8 else []
            if len(outermost) == 1 and held[outermost[0]]:
                region = outermost[0]  # a page's only article or main says so itself, however short
                break
    inside = below(page.parent, [e == region for e in range(len(page.tag))])
    return "\n\n".join(t for t, _, e in lines if inside[e])


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Add text (the article) and n_chars (its code points) to each row; rows stay in place (no shuffle).

    Whole pages are parsed, a page at a time. Null and empty pages and pages without text give an empty text. Repeated
    rows agree. Input columns text and n_chars are replaced (unless one is the html column); others pass through.
    """

    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    small_batches(df.sparkSession)
    out = df.withColumn("__text", udf(F.col(html)))
    return out.drop("text", "n_chars").withColumnRenamed("__text", "text").withColumn("n_chars", F.length("text").cast("long"))


ship(__name__)
