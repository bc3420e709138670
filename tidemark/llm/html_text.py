"""HTML extraction: blocks classified by stop-word density, length and link density; short ones inherit from their neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import mapped

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What follows a tag's name up to its >, which counts within quotes only if these begin a value and end somewhere. It never goes back.
ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+""")
HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+")
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is text up to their end tag, and none of it shown.
RAW = frozenset("script style noscript template textarea iframe svg math title noframes".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text.
ASIDE = frozenset("nav footer aside form menu dialog search".split())
#: Elements of controls and media, whose content stands in for them or is their own.
CONTROLS = frozenset("object select button audio video canvas datalist".split())
#: Words in a class, an id or a role by which an element says that it holds no main text.
HINTS = frozenset(
    """ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation
    breadcrumb breadcrumbs cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription share sharing
    social related recommended comment comments commentlist disqus reply replies respond footer header masthead topbar toolbar widget login signup
    signin register search pagination pager skip contentinfo complementary""".split()
)
#: Those of HINTS that say what the text is, not where it stands: a page's text isn't looked for in there.
OTHERS = frozenset("comment comments commentlist disqus reply replies respond related recommended ad ads adv advert adverts advertisement adsense sponsor sponsored cookie cookies consent gdpr".split())
#: Frequent words of the languages that pages come in.
STOP = frozenset(
    """the of and to in a is that for it on was with as are be this by at from or an not have but his he they which you had were her all she there
    der die das und in zu den mit von für im ist des auf ein eine dem nicht als auch es an werden aus er hat dass sie nach bei um am sind noch wie
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son mais comme ou si leur elle
    el los y del las por con una su para al lo como más o pero sus ha este sí porque esta son entre cuando muy sin sobre también me hasta hay
    che di il non per una sono con del si della è da come anche ma alla van het een dat op te zijn voor niet met aan ook om
    os do da em um para com não uma na no mais dos como mas foi ao ele das""".split()
)
#: First words of class names that tell of an element's surroundings, not of itself.
ABOUT = frozenset(("has", "with", "without", "no", "is", "not", "hide", "show"))
#: Words of HINTS that tell of an article's own parts where they stand inside of one.
OWN = frozenset(("header", "masthead"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose begin ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Elements that an end tag inside of them doesn't reach past, and those that end no other than themselves.
SCOPE = frozenset("caption table td th".split())
SPECIAL = BLOCKS - frozenset("dialog legend optgroup option".split())
#: Parts of tables, by depth; one ends the open parts of its table that are as deep or deeper.
PARTS = {"caption": 0, "colgroup": 0, "tbody": 0, "thead": 0, "tfoot": 0, "tr": 1, "td": 2, "th": 2}
#: Elements whose end tags take effect across others that are open inside of them.
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MAX_LINK, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.35, 70, 200, 0.15, 0.28
#: Share of stop words of a page's words below which it counts as of a language without any, and length from which its blocks are long.
STOP_NONE, LONG_UNKNOWN = 0.02, 100


def is_hinted(attributes: str, hints: frozenset[str] = HINTS) -> bool:
    if "=" not in attributes:
        return BARE_HIDDEN.search(attributes) is not None
    if re.search(r"(?<![\w-])hidden\b(?!\s*-)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attributes) and not re.search(r"(?:class|id)\s*=\s*[\"'][^\"']*hidden", attributes):
        return True
    for m in re.finditer(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", attributes, re.I):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            if parts[0] not in ABOUT and parts[-1] not in ("free", "less") and not hints.isdisjoint(parts):
                return True
    return False


class Open:
    """The elements that are open at a place of a page. A begin ends what HTML says it ends without an end tag; an end tag ends
    what is open inside of its element, and nothing if there is no such element in reach. Work per tag doesn't grow with depth."""

    GROUPS = {n: [g for g, of in (("*scope", SCOPE), ("*special", SPECIAL), ("*list", SPECIAL - {"address", "div", "p", "li", "dd", "dt"})) if n in of] for n in BLOCKS}

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}  # places in names of each name, and of each group of names
        self.least = 0  # the lowest place that has been closed since this was set

    def last(self, *names: str) -> int:
        return max(p[-1] if (p := self.at.get(n)) else -1 for n in names)

    def push(self, name: str) -> None:
        for key in (name, *self.GROUPS.get(name, ())):
            self.at.setdefault(key, []).append(len(self.names))
        self.names.append(name)

    def cut(self, size: int) -> None:
        self.least = min(self.least, size)
        while len(self.names) > size:
            name = self.names.pop()
            if name:
                for key in (name, *self.GROUPS.get(name, ())):
                    self.at[key].pop()

    def cut_parts(self, depth: int) -> None:
        table = self.last("table")
        places = [i for n, k in PARTS.items() if (k >= depth or n in ("caption", "colgroup")) and (i := self.last(n)) > table]
        if places:
            self.cut(min(places))

    def begin(self, name: str) -> None:
        if name in ENDS_P and (i := self.last("p")) > self.last("*scope"):
            self.cut(i)
        if name == "li" or name in ("dd", "dt"):
            if (i := self.last("li") if name == "li" else self.last("dd", "dt")) > self.last("*list"):
                self.cut(i)
        elif name in PARTS:
            self.cut_parts(PARTS[name])
        elif name in HEADINGS:
            if self.names and self.names[-1] in HEADINGS:
                self.cut(len(self.names) - 1)
        elif name in ("option", "optgroup"):
            places = [i for n in ("option", name) if (i := self.last(n)) > self.last("*special")]
            if places:
                self.cut(min(places))
        if name not in VOID and name not in ("html", "head", "body"):
            self.push(name)

    def end(self, name: str) -> None:
        if name in FORMATS:
            if (i := self.last(name)) > self.last("*scope"):
                self.at[name].pop()
                self.names[i] = ""
            return
        i = self.last(*HEADINGS) if name in HEADINGS else self.last(name)
        if name in PARTS:
            limit = self.last("table")
        elif name == "table":
            limit = -1
        elif name == "li":
            limit = self.last("*scope", "ul", "ol")
        else:
            limit = self.last("*scope" if name in BLOCKS else "*special")
        if i > limit:
            self.cut(i)

    def holds(self, place: int) -> bool:
        """Whether the element that was last when least was set to the number of names is still open."""
        return self.least > place and bool(self.names[place])


class Block:
    __slots__ = ("heading", "in_article", "link_chars", "listed", "parts")

    def __init__(self, in_article: bool, heading: bool, listed: bool):
        self.parts: list[str] = []
        self.link_chars, self.in_article, self.heading, self.listed = 0, in_article, heading, listed


def blocks(page: str, hints: frozenset[str] = HINTS, aside: frozenset[str] = ASIDE, left_out: list[int] | None = None) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, share of characters in links, in an article, heading, not a paragraph) of each block outside of elements that hold no
    main text, by their own names, those of aside, or by hints in their class, id or role. To left_out the number of characters
    in these elements is added. One pass; a tag that never ends ends the page.
    """
    out: list[tuple[str, float, bool, bool, bool]] = []
    now: Block | None = None
    at, link, article, heading, listed = 0, -1, False, False, True  # link: the place of the last link
    tree, skipped = Open(), -1  # the place of the element that is being left out
    size = len(page)

    def close() -> None:
        nonlocal now
        if now is not None:
            text = SPACE.sub(" ", html.unescape("".join(now.parts))).strip()
            if text:
                out.append((text, now.link_chars / max(1, sum(map(len, now.parts))), now.in_article, now.heading, now.listed))
        now = None

    def add(piece: str) -> None:
        nonlocal now
        if skipped >= 0:
            if left_out is not None:
                left_out[0] += len(piece)
        elif piece:
            if now is None:
                if not piece.strip():
                    return
                now = Block(article, heading, listed)
            now.parts.append(piece)
            if 0 <= link < len(tree.names) and tree.names[link] == "a":
                now.link_chars += len(piece)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith(("<!", "<?"), lt):
            comment = page.startswith("<!--", lt) and not page.startswith(("<!-->", "<!--->"), lt)
            end = page.find("-->" if comment else ">", lt + 4 * comment)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        m = NAME.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        close_at = ATTRIBUTES.match(page, m.end()).end()
        if close_at == size:
            break
        name, ends, attributes, at = m[1].lower(), page[lt + 1] == "/", page[m.end() : close_at], close_at + 1
        if name in RAW and not ends:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = size if end is None else end.start()
            continue
        if ends:
            tree.end(name)
        else:
            if name == "a":
                tree.end("a")  # no link is inside of another
            tree.begin(name)
        if skipped >= 0:
            if tree.holds(skipped):
                continue
            skipped = -1
        if name in BLOCKS:
            close()
            article = tree.last("article", "main") >= 0
            heading, listed = name in HEADINGS and not ends, name != "p" or ends
        if name == "a" and not ends:
            link = len(tree.names) - 1 if HREF.search(attributes) else -1
        elif name == "br":
            add(" ")
        elif name in ("article", "main"):
            link = -1
        if ends or name in VOID or name in ("html", "head", "body", "article", "main"):
            continue
        inner = hints - OWN if article else hints
        if name in aside or name in CONTROLS or (name == "header" and not article and "header" in hints) or is_hinted(attributes, frozenset() if name == "h1" else inner):
            tree.least = len(tree.names)
            skipped = tree.least - 1
    close()
    return out


def nearest(decided: list[bool | None], inside: list[bool], reverse: bool = False) -> list[bool | None]:
    """For each block the label of the nearest decided one before it (after it, if reverse) on its side of an article's edge; None if there is none."""
    out: list[bool | None] = [None] * len(decided)
    last: bool | None = None
    order = range(len(decided) - 1, -1, -1) if reverse else range(len(decided))
    step = 1 if reverse else -1
    for i in order:
        if 0 <= i + step < len(decided) and inside[i] != inside[i + step]:
            last = None
        out[i] = last
        last = last if decided[i] is None else decided[i]
    return out


def judged(found: list[tuple[str, float, bool, bool, bool]]) -> list[bool | None]:
    """Whether each block is good.

    Pass 1 decides blocks: many link characters or a copyright sign make one bad; long ones with enough stop words are
    good, with few bad; the rest is undecided. In an article or main element few stop words leave a block undecided (it may
    be in another language), and so does being a link if it is a paragraph between others that aren't.
    Pass 2: an undecided block takes the label of the nearest decided neighbours, which are looked for inside of the
    article or outside of it as the block is. On a page with an article, its edges count as good neighbours inside and as
    bad ones outside. A page with next to no stop word, so in a language that has none here, is judged by length and links. If they differ, a heading takes that of the one below, blocks in an article are good, and others
    are bad unless stop words say good. A paragraph that is a link is good only between blocks decided as good.
    """
    labels: list[bool | None] = []
    linked_text: set[int] = set()
    density: list[float] = []
    all_words = stops = 0
    for text, *_ in found:
        words = WORDS.findall(text.lower())
        hits = sum(w in STOP for w in words)
        all_words, stops = all_words + len(words), stops + hits
        density.append(hits / max(1, len(words)))
    unknown = stops < STOP_NONE * all_words
    for i, (text, linked, inside, _, listed) in enumerate(found):
        if unknown:
            density[i] = STOP_HIGH if len(text) >= LONG_UNKNOWN else STOP_LOW / 2
        if text.startswith(("©", "(c)")):
            labels.append(False)
        elif linked > MAX_LINK:
            alone = inside and not listed and all(found[j][1] <= MAX_LINK for j in (i - 1, i + 1) if 0 <= j < len(found) and found[j][2])
            labels.append(None if alone else False)
            if alone:
                linked_text.add(i)
        elif len(text) < SHORT:
            labels.append(None if inside or not linked else False)
        elif density[i] >= STOP_HIGH or (len(text) >= LONG and density[i] >= STOP_LOW):
            labels.append(True)
        else:
            labels.append(None if inside or density[i] >= STOP_LOW / 2 else False)
    decided = list(labels)
    below = nearest(decided, [b[2] for b in found], reverse=True)
    before = nearest(decided, [b[2] for b in found])
    for i, (_, _, inside, head, _) in enumerate(found):
        if decided[i] is not None:
            continue
        if i in linked_text:
            labels[i] = bool(before[i] and below[i])
            continue
        above, under = (inside if x is None else x for x in (before[i], below[i]))
        if head:
            labels[i] = under
        elif above == under:
            labels[i] = above
        else:
            labels[i] = inside or density[i] >= STOP_HIGH
    return labels


def good_blocks(page: str, hints: frozenset[str] = HINTS, aside: frozenset[str] = ASIDE, left_out: list[int] | None = None) -> list[tuple[str, float, bool, bool, bool]]:
    found = blocks(page, hints, aside, left_out)
    return [b for b, is_good in zip(found, judged(found), strict=True) if is_good]


def main_text(page: str | None) -> str:
    """The main text of a page: its good blocks, joined by one line feed.

    Names may tell of a layout, as of a page that has a sidebar. Where more characters are left out than are good, elements that only
    names of places say hold no main text are looked into, and if that gives several times as much, it is the text. Where there
    is nothing yet, all that only names say so of is looked into, and then forms, which may be around a whole page: these
    blocks are the text if they are in an article, several, or long.
    """
    page, left_out = page or "", [0]
    good = good_blocks(page, left_out=left_out)
    length = lambda found: sum(len(b[0]) for b in found)
    if left_out[0] > (had := length(good)):
        inner = good_blocks(page, OTHERS) if good else []
        if length(inner) > 3 * had and sum(len(b[0]) >= LONG for b in inner) > 1:
            good = inner
        for hints, aside in ((frozenset(), ASIDE), (HINTS, ASIDE - {"form"}), (frozenset(), ASIDE - {"form"})):
            if good:
                break
            found = good_blocks(page, hints, aside)
            if len(found) >= 3 or any(b[2] for b in found) or (aside is not ASIDE and any(len(b[0]) >= LONG for b in found)):
                good = found
    return "\n".join(b[0] for b in good)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text and n_chars for every row of pages, whole pages, no shuffle.

    Null, empty and markup-only pages give the empty text and 0. Repeated rows and null ids are kept as they are.
    Columns of pages that are not named are ignored. An element without an end tag ends where its
    parent does or where HTML implies it, as in browsers; stray end tags end nothing.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*keep, "text", "n_chars"])

    return mapped(pages.select(*(pages[c] for c in keep), pages[html_col].alias("__html")), run, f"{kinds}, text string, n_chars long")
