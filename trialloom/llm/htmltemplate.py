"""Main text of HTML pages by equivalence-class template deduction.

Pages of one host are taken together, in groups of about ``GROUP`` pages, and in each group the pages of one layout. A token
is a tag or a word with the path of elements it stands in; its occurrence vector says how often it occurs in each page.
Tokens with equal vectors form an equivalence class. A class is valid if most pages have its tokens and these follow one
another in the same order: what occurs once in ``SUPPORT`` of the pages gives the frame of the template, and classes that
repeat (menu entries, comment heads) nest in the frame where their repetitions do not cross. What stands between the
template's tokens are its slots.
The slot that holds most text outside links names the main element. The page's text is that of all article and main
elements or, without these, of the lowest element around all slots with text outside links; there, what the template words
and menus of links outside the main element go, as do the elements that are never part of an article.

* White space in a block becomes one space, character references are decoded, blocks are joined by a line feed, in page
  order. Scripts, styles, comments, menus, page headers and footers, forms, adverts, notices and reader comments go.
* Names (class, id, role) only hint: a block with a name such as ``ad`` or ``share-buttons`` goes if several pages of the
  layout have it, or if there is no template; never a heading, paragraph, table or article. A section named by its id alone
  needs signed entries that repeat, as comments have. Headings that pages share stay above text of the page's own.
* A page whose text is all linked keeps its paragraphs. Without a template, menus at the edges and a closing copyright line go.
* Copies of a page count once for the template, pages without text not at all. With fewer than ``LEAST_PAGES`` different
  pages of a layout there is no template; then the page's own elements are taken.
* Wording of the main text is template if it stands in more than ``LEAST_PAGES`` pages that are no near copies of one
  another, and in ``SUPPORT`` of these: near copies keep the text that only they share.
* Null html or html without text gives an empty text; null urls share the host ''. Repeated rows each get their result. An
  empty table gives an empty result. Other columns are not read. No page is left out or cut.
* A host with many pages is split into groups by a hash of the page, so no task gets a whole hot host.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialloom.session import cut

GROUP = 64
LEAST_PAGES = 3
MOST_HOSTS = 300_000
SUPPORT = 0.8  # of the pages of a layout, for a token to be template
SAME_LAYOUT = 0.5  # of the places of two pages' blocks
NEAR_COPY = 0.5  # of the words of two pages
WORDING_SHARE = 0.8  # of a block's words, for the block to be template

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|title|textarea|iframe"  # their content is no markup, up to their end tag
_FOREIGN = frozenset(("svg", "math"))  # inside, a tag that ends in /> is empty
_POINTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())  # HTML may stand in these
_LEAVES_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
                            "nobr ol p pre ruby s section small span strong strike sub sup table tt u ul var article main header footer".split())
_QUIET = frozenset("svg math template noscript canvas".split())  # stand inside a line: do not end a block
_UNSEEN = frozenset("svg template noscript canvas annotation annotation-xml".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                    "sub sup time tt u var wbr img br".split())
_CLOSES_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol "
                      "p pre section table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select body html article div".split())
_NEVER = frozenset("nav aside form button select menu dialog footer head".split())
_CONTROLS = frozenset("fieldset label".split())  # outside an article, parts of forms
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | {"p", "blockquote", "pre"}
_CONTAINER = frozenset("article main section div td body".split())
#: Heuristic: words in class, id and role that hint at what is not the article.
_MARKED = re.compile(
    r"ads?|adv|advert\w*|adsbygoogle|banner\w*|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal|"
    r"newsletter\w*|subscri\w*|share\w*|sharing|social\w*|sidebar\w*|related\w*|recommend\w*|comment\w*|repl(?:y|ies)|disqus\w*|respond|"
    r"breadcrumb\w*|menu\w*|nav\w*|navigation|foot|footer\w*|masthead|toolbar\w*|paginat\w*|pager|copyright|login|signup|search\w*|widget\w*|"
    r"skip|contentinfo|complementary", re.I)
#: Heuristic: words that go with these; a name with any other word (related-work, market-share) hints at nothing.
_BESIDE = re.compile(
    r"|area|articles?|background|bars?|block|body|bottom|box|btn|buttons?|container|contents?|footer|form|head|header|icons?|inner|items?|"
    r"left|links?|list|main|media|module|outer|overlay|page|panel|posts?|primary|right|secondary|section|site|stories|story|text|title|to|top|"
    r"unit|wrap|wrapper|\d+", re.I)
#: Names say nothing about these: text that runs on and its headings.
_UNNAMED = _INLINE | frozenset("body html article main p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tbody tr td th".split())
#: Heuristic: names of what heads a reader's comment, and a line that only says whose the page is.
_SIGNED = re.compile(r"(?:^|[\[=\s_-])(?:author|user\w*|byline|date|datetime|posted|avatar|commenter|meta)(?:$|[\]\s_-])", re.I)
_OWNED = re.compile(r"\W*(?:©|\(c\)|copyright\b)", re.I)
_OWNED_WORDS = 25
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?|([^<]+)|<""", re.S | re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW.split("|")}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_UNSHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)


def marked(names: str) -> bool:
    """Whether a class, id or role is made of words for what is no article."""
    for name in names.split():
        parts = re.split(r"[-_]+", name)
        if any(map(_MARKED.fullmatch, parts)) and all(_MARKED.fullmatch(p) or _BESIDE.fullmatch(p) for p in parts):
            return True
    return False


@dataclass(frozen=True)
class Node:
    """An element's place: its parents, names and whether it may hold article text."""

    path: str
    tag: str
    parent: "Node | None"
    never: bool
    linked: bool
    article: "Node | None"
    outer: "Node | None" = None  # the outermost article or main element
    foreign: bool = False  # in svg or math
    quiet: bool = False
    marks: tuple[tuple[str, bool], ...] = ()  # paths of the elements around it whose names hint at no article; no section's id alone

    def child(self, tag: str, attributes: str) -> "Node":
        named, hidden, by_class, by_id = "", False, False, False
        for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
            key, value = key.lower(), (a or b or c).strip()
            if key in ("class", "id", "role"):
                named += f"[{key}={value}]"
                if tag not in _UNNAMED:
                    by_class |= key != "id" and marked(value)
                    by_id |= key == "id" and marked(value)
            hidden |= (key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true"
                       or key == "style" and bool(_UNSHOWN.search(value)))
        never = self.never or hidden or tag in _NEVER or tag in _UNSEEN or self.article is None and (tag == "header" or tag in _CONTROLS)
        path = f"{self.path}>{tag}{named}"
        marks = (*self.marks, (path, by_class or tag != "section")) if by_class or by_id else self.marks
        node = Node(path, tag, self, never, self.linked or tag == "a", self.article, self.outer,
                    tag in _FOREIGN or (self.foreign and tag not in _POINTS), self.quiet or tag in _QUIET, marks)
        if tag in ("article", "main") and not never:
            object.__setattr__(node, "article", node)
            object.__setattr__(node, "outer", self.outer or node)
        return node

    def dropped(self, repeated: set[str]) -> bool:
        """No article text: by its kind, or by a name if ``repeated`` has the path of the named element."""
        return self.never or bool(self.marks) and any(path in repeated for path, _ in self.marks)


_ROOT = Node("", "", None, False, False, None)


def events(html: str) -> list[tuple[str, Node, str]]:
    """("open" | "close" | "text" | "break", place, text) in page order; missing end tags are filled in."""
    out: list[tuple[str, Node, str]] = []
    stack = [_ROOT]
    known: dict[tuple[str, str, str], Node] = {}

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            out.append(("close", stack.pop(), ""))

    at, unended = 0, set()
    while (m := _TOKEN.match(html, at)) is not None:
        at = m.end()
        text = m[8]
        if text is not None:
            out.append(("text", stack[-1], html_lib.unescape(text) if "&" in text else text))
            continue
        name = m[3] or m[6]
        if not name:
            if m[1]:
                tag = m[1].lower()
                if stack[-1].foreign and m[0].endswith("/>"):
                    continue
                end = None if tag in unended else _RAW_END[tag].search(html, at)
                if end:
                    at = end.end()
                else:  # only code goes on to the end of the page
                    unended.add(tag)
                    if tag in ("script", "style"):
                        break
            elif m[0] == "<":
                out.append(("text", stack[-1], "<"))
            continue
        tag = name.lower()
        if m[2] or m[5]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            continue
        attributes = m[4] if m[3] else m[7]
        if stack[-1].foreign and tag in _LEAVES_FOREIGN:
            close_to(next(d for d in range(len(stack), 0, -1) if not stack[d - 1].foreign))
        if tag in _VOID:
            out.append(("break", stack[-1], tag))
            continue
        if tag in _CLOSES_P or tag in _SIBLING:
            ends = _SIBLING.get(tag, {"p"})
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ends:
                    close_to(depth)
                    break
                if stack[depth].tag in _SCOPE:
                    break
        key = (stack[-1].path, tag, attributes)
        node = known.get(key)
        if node is None:
            node = known[key] = stack[-1].child(tag, attributes)
        stack.append(node)
        out.append(("open", node, ""))
        if attributes.endswith("/") and (stack[-1].foreign or tag not in _INLINE and tag not in _CONTAINER):
            close_to(len(stack) - 1)
    close_to(1)
    return out


Token = tuple[str, str]  # path and "<", ">" or a word


def tokens(page: list[tuple[str, Node, str]]) -> Iterator[Token]:
    for kind, node, text in page:
        if kind == "open":
            yield node.path, "<"
        elif kind == "close":
            yield node.path, ">"
        elif kind == "text":
            path = node.path
            for word in text.split():
                yield path, word


def _ordered(sequences: list[list[Token]]) -> list[Token]:
    """Tokens, each at most once in a sequence, in an order that every sequence follows; as few as possible go."""
    places: dict[Token, list[float]] = defaultdict(list)
    for sequence in sequences:
        for i, token in enumerate(sequence):
            places[token].append((i + 1) / (len(sequence) + 1))
    common = sorted(places, key=lambda t: (sum(places[t]) / len(places[t]), t))
    for other in sequences:
        place = {t: i for i, t in enumerate(other)}
        held = [t for t in common if t in place]
        if held == other:
            continue
        tails: list[int] = []
        tail_at: list[int] = []
        before: list[int] = []
        for i, token in enumerate(held):
            at = bisect_left(tails, place[token])
            before.append(tail_at[at - 1] if at else -1)
            if at == len(tails):
                tails.append(place[token])
                tail_at.append(i)
            else:
                tails[at], tail_at[at] = place[token], i
        kept, i = set(), tail_at[-1] if tail_at else -1
        while i >= 0:
            kept.add(held[i])
            i = before[i]
        common = [t for t in common if t not in place or t in kept]
    return common


@dataclass
class Template:
    frame: list[Token]  # once in every page, in this order
    nested: set[Token]  # of valid classes that repeat
    repeated: set[str]  # paths that stand in several pages

    def wording(self) -> set[Token]:
        return {t for t in [*self.frame, *self.nested] if t[1] not in "<>"}


def layouts(pages: list[list[tuple[str, Node, str]]]) -> list[list[int]]:
    """The numbers of the pages of each layout: pages that share most of the places of their blocks."""
    found = [{n.path for kind, n, _ in page if kind == "open" and n.tag not in _INLINE and not n.quiet} for page in pages]
    times = Counter(path for paths in found for path in paths)
    least = max(2, len(pages) / 10)
    found = [{path for path in paths if times[path] >= least} for paths in found]
    groups: list[tuple[set[str], list[int]]] = []
    for i, paths in enumerate(found):
        like = [(len(paths & first) / max(1, len(paths | first)), -k) for k, (first, _) in enumerate(groups)]
        best, k = max(like, default=(0.0, 0))
        if best >= SAME_LAYOUT:
            groups[-k][1].append(i)
        else:
            groups.append((paths, [i]))
    return [members for _, members in groups]


def deduce(pages: list[list[tuple[str, Node, str]]]) -> Template | None:
    """The template of different pages of one layout: of what at least ``SUPPORT`` of the pages have."""
    pages = [p for p in pages if any(kind == "text" and text.strip() for kind, _, text in p)]
    if len(pages) < LEAST_PAGES:
        return None
    sequences = [list(tokens(page)) for page in pages]
    least = SUPPORT * len(pages)
    support: Counter = Counter()
    for s in sequences:
        support.update(set(s))
    common = {t for t, n in support.items() if n >= least}
    sequences = [[t for t in s if t in common] for s in sequences]
    counts = [Counter(s) for s in sequences]
    classes: dict[tuple[int, ...], list[Token]] = defaultdict(list)
    unit = set()
    for token in common:
        vector = tuple(c[token] for c in counts)
        if vector.count(1) >= least:
            unit.add(token)
        else:
            classes[vector].append(token)
    frame = _ordered([[t for t in s if t in unit and c[t] == 1] for s, c in zip(sequences, counts)]) if unit else []
    if not frame:
        return None
    framed, nested = set(frame), set()
    for members in classes.values():
        if len(members) < 2:
            continue
        chosen = set(members)
        if all(_repeats([t for t in s if t in chosen or t in framed], chosen, len(members)) for s in sequences):
            nested |= chosen
    return Template(frame, nested, {path for (path, what), n in support.items() if what == "<" and n >= LEAST_PAGES})


def different(words: list[set[str]]) -> list[int]:
    """The numbers of the pages that are no near copies of earlier ones."""
    firsts: list[int] = []
    share = NEAR_COPY / (1 + NEAR_COPY)  # of both sizes, what two pages have in common if it is NEAR_COPY of what either has
    for i, here in enumerate(words):
        if here and not any(len(here & words[k]) >= share * (len(here) + len(words[k])) for k in firsts):
            firsts.append(i)
    return firsts


def _repeats(sequence: list[Token], members: set[Token], size: int) -> bool:
    """Whether the members come in one order again and again, and no repetition crosses a token of the frame."""
    turn: list[Token] = []
    at = 0
    for token in sequence:
        if token not in members:
            if at % size:
                return False
        else:
            if len(turn) < size:
                if token in turn:
                    return False
                turn.append(token)
            elif turn[at % size] != token:
                return False
            at += 1
    return at % size == 0


def main_path(template: Template, pages: list[list[tuple[str, Node, str]]]) -> str | None:
    """The path of the element around the slot with most words outside links."""
    place = {t: i for i, t in enumerate(template.frame)}
    mass: Counter = Counter()
    inside: dict[int, Node] = {}
    for page in pages:
        slot = 0
        for kind, node, text in page:
            if kind == "text":
                if not node.dropped(template.repeated) and not node.linked and text.strip():
                    mass[slot] += len(text)
                    inside.setdefault(slot, node)
            elif kind != "break":
                at = place.get((node.path, "<" if kind == "open" else ">"))
                if at is not None:
                    slot = at + 1
    if not mass:
        return None
    node = inside[max(mass, key=lambda s: (mass[s], -s))]
    if node.article is not None:
        return node.article.path
    framed = {t[0] for t in template.frame if t[1] == "<"}
    while node.parent is not None and not (node.tag in _CONTAINER and node.path in framed):
        node = node.parent
    return node.path or None


def own_marks(page: list[tuple[str, Node, str]]) -> set[str]:
    """Without a template: the paths of the named elements that go. A section named by its id alone goes if it is a thread of
    comments: elements of one path follow each other in it, and more than one of them is signed with an author or a date."""
    out: set[str] = set()
    unsure: set[str] = set()
    signed: dict[str, Counter] = defaultdict(Counter)
    for kind, node, _ in page:
        for path, sure in node.marks if kind == "open" else ():
            (out if sure else unsure).add(path)
        if kind == "open" and (node.tag == "time" or _SIGNED.search(node.path.rpartition(">")[2])):
            for path in {p for p, sure in node.marks if not sure}:
                below, up = node, node.parent
                while up is not None and up.path != path:
                    below, up = up, up.parent
                if below is not node:
                    signed[path][below.path] += 1
    return out | {path for path in unsure if any(n > 1 for n in signed[path].values())}


def own_path(page: list[tuple[str, Node, str]], repeated: set[str], links: bool = False) -> str | None:
    """Without a template: the article or main element with most text, else the container with most."""
    articles, containers = Counter(), Counter()
    for kind, node, text in page:
        if kind == "text" and not node.dropped(repeated):
            size = len(text.split())
            if node.article is not None:
                articles[node.article.path] += size
            elif links or not node.linked:
                while node is not None and node.tag not in _CONTAINER:
                    node = node.parent
                containers[node.path if node else ""] += size
    found = articles or containers
    return max(found, key=lambda p: (found[p], p)) if found else None


def within(path: str, root: str) -> bool:
    return path.startswith(root) and (len(path) == len(root) or not root or path[len(root)] == ">")


def whole(page: list[tuple[str, Node, str]], repeated: set[str], wording: set[Token], links: bool = False) -> set[str]:
    """The paths of the elements that hold the whole article: every article and main element, with the page's main heading if they
    have none; without them the lowest element around all text that is neither linked (but with ``links``) nor template."""
    roots: set[str] = set()
    heads: set[str] = set()
    headed = False
    chain: list[str] | None = None  # from the root down
    seen: set[str] = set()
    for kind, node, text in page:
        if kind != "text" or not text.strip() or node.dropped(repeated):
            continue
        up = node
        while up is not None and up.tag != "h1":
            up = up.parent
        if node.outer is not None:
            roots.add(node.outer.path)
            headed |= up is not None
        elif links or not node.linked:
            if up is not None:
                heads.add(up.path)
            if not roots and node.path not in seen and any((node.path, w) not in wording for w in text.split()):
                seen.add(node.path)
                own: list[str] = []
                up = node
                while up is not None:
                    own.append(up.path)
                    up = up.parent
                own.reverse()
                chain = own if chain is None else [a for a, b in zip(chain, own) if a == b]
    if roots:
        return roots if headed else roots | heads
    return {chain[-1]} if chain else set()


@dataclass
class Block:
    text: str
    tokens: list[Token]
    core: bool  # in the main element or an article
    menu: bool  # links in an element without other text
    heading: bool = False
    prose: bool = False  # in a paragraph, quotation or heading


def inside(node: Node | None, tags: frozenset[str]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def blocks(page: list[tuple[str, Node, str]], roots: set[str], core: str, repeated: set[str]) -> list[Block]:
    """The blocks inside the elements at ``roots``, in page order."""
    out: list[Block] = []
    parts: list[tuple[str, Node]] = []
    places: dict[str, tuple[bool, bool]] = {}
    texted: set[str] = set()  # elements that directly hold text outside links
    holders: list[set[str]] = []

    def holder(node: Node) -> str:
        while node.parent is not None and node.tag not in _CONTAINER and node.tag not in ("ul", "ol", "dl"):
            node = node.parent
        return node.path

    def flush() -> None:
        if parts:
            words = "".join(t for t, _ in parts).split()
            if words:
                out.append(Block(" ".join(words), [(n.path, w) for t, n in parts for w in t.split()],
                                 any(places[n.path][1] for t, n in parts if t.strip()), all(n.linked for t, n in parts if t.strip()),
                                 all(inside(n, _HEADINGS) for t, n in parts if t.strip()), all(inside(n, _PROSE) for t, n in parts if t.strip())))
                holders.append({holder(n) for t, n in parts if t.strip()})
                if not out[-1].menu:
                    texted.update(holders[-1])
            parts.clear()

    for kind, node, text in page:
        if kind == "text":
            at = places.get(node.path)
            if at is None:
                at = places[node.path] = (any(within(node.path, r) for r in roots), within(node.path, core) or (
                    node.article is not None and node.article.tag == "article"))
            if at[0] and not node.dropped(repeated):
                parts.append((text, node))
        elif kind == "break":
            if text in _INLINE:
                if text == "br":
                    parts.append((" ", node))
            else:
                flush()
        elif node.tag not in _INLINE and not node.quiet:
            flush()
    flush()
    for block, held in zip(out, holders):
        block.menu &= not held & texted
    return out


def extract_layout(pages: list[list[tuple[str, Node, str]]]) -> list[str]:
    """The main texts of different pages of one layout."""
    template = deduce(pages)
    path = main_path(template, pages) if template else None
    marks = [template.repeated if template else own_marks(page) for page in pages]
    cores, words, outer, inner = [], [], set(), set()
    for page, repeated in zip(pages, marks):
        core, held = path, set()
        if path is not None:
            for kind, node, text in page:
                if kind == "text" and within(node.path, path) and not node.dropped(repeated):
                    held.update(text.split())
        if not held:
            core = own_path(page, repeated)
        cores.append(core)
        words.append(held)
    if template:
        firsts = different(words)
        common = template.wording()
        if LEAST_PAGES <= len(firsts) < len(pages):
            times = Counter(t for i in firsts for t in common.intersection(tokens(pages[i])))
            common = {t for t in common if times[t] >= SUPPORT * len(firsts)}
        outer = common if len(firsts) >= LEAST_PAGES else set()
        inner = common if len(firsts) > LEAST_PAGES else set()
    texts = []
    for page, core, repeated in zip(pages, cores, marks):
        kept = kept_blocks(blocks(page, whole(page, repeated, outer), core, repeated), outer, inner) if core is not None else []
        if not kept and not (template and outer):  # all text is linked: then linked paragraphs are what the page says, but no menus
            core = own_path(page, repeated, True)
            if core is not None:
                found = [b for b in blocks(page, whole(page, repeated, outer, True), core, repeated) if b.prose]
                for block in found:
                    block.menu = False
                kept = kept_blocks(found, outer, inner)
        if not template:
            kept = trimmed(kept, any(kind == "text" and node.article is not None and text.strip() and not node.dropped(repeated)
                                     for kind, node, text in page))
        texts.append("\n".join(block.text for block in kept))
    return texts


def kept_blocks(found: list[Block], outer: set[Token], inner: set[Token]) -> list[Block]:
    """The blocks that are neither menus beside the article nor template wording. A heading that pages share stays while something
    stays below it: only the pages' own text makes it part of an article."""
    kept: list[Block] = []
    waiting: list[Block] = []  # shared headings whose section has no text yet
    for block in found:
        wording = inner if block.core else outer
        shared = sum(t in wording for t in block.tokens) >= WORDING_SHARE * len(block.tokens)
        if block.menu and not block.core or shared and not block.heading:
            continue
        if shared and not block.core:
            continue
        if block.heading and shared:
            waiting = [block]
        elif block.heading:
            waiting = []
            kept.append(block)
        else:
            kept += waiting
            waiting = []
            kept.append(block)
    return kept


def trimmed(kept: list[Block], article: bool) -> list[Block]:
    """Without a template: menus at the edges go, where no article element says what belongs to it, and lines that only say whose
    the page is at its end."""
    first, last = 0, len(kept)
    while last > first and (_OWNED.match(kept[last - 1].text) and len(kept[last - 1].text.split()) <= _OWNED_WORDS
                            or kept[last - 1].menu and not article):
        last -= 1
    while first < last and kept[first].menu and not article:
        first += 1
    return kept[first:last] or kept


def extract_group(htmls: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    parsed = {h: events(h) for h in set(htmls)}
    text_of = {h: "" for h, page in parsed.items() if not any(kind == "text" and text.strip() for kind, _, text in page)}
    named = sorted(parsed.keys() - text_of.keys())
    for members in layouts([parsed[h] for h in named]):
        text_of.update(zip((named[i] for i in members), extract_layout([parsed[named[i]] for i in members])))
    return [text_of[h] for h in htmls]


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    ready = pages.select("page_id", "url", "html", host.alias("host"))
    large = cut(ready.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > group)
                .select("host", F.ceil(F.col("n") / F.lit(group)).cast("int").alias("shards")))
    # a row per host with many pages; broadcast while there are few of them, so that pages move just once
    large = F.broadcast(large) if large.count() <= MOST_HOSTS else large
    shard = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("shards")).cast("int"), F.lit(0))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (ready.join(large, "host", "left").withColumn("shard", shard).drop("shards")
             .repartition(parts, "host", "shard").sortWithinPartitions("host", "shard"))
    page_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def work(held: pa.Table) -> pa.RecordBatch:
        texts = extract_group([h or "" for h in held.column("html").to_pylist()])
        return pa.RecordBatch.from_arrays([
            held.column("page_id").combine_chunks(), held.column("url").combine_chunks(), pa.array(texts, pa.string()),
            pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = list(zip(held.column("host").to_pylist(), held.column("shard").to_pylist()))
            at = 0
            for i in range(1, len(keys)):
                if keys[i] != keys[i - 1]:
                    yield work(held.slice(at, i - at))
                    at = i
            held = held.slice(at)  # the last group may go on in the next batch
        if held is not None:
            yield work(held)

    return dealt.mapInArrow(run, f"page_id {page_type}, url {url_type}, text string, n_chars long")
