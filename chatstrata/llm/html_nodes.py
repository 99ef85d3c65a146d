"""HTML pages as arrays of nodes: block elements and runs of text, in page order, with their features.

Only block elements become nodes; inline ones count towards their block. A text leaf is a maximal run of
inline text within one block. Nodes are in the order of their start tags, so a subtree is a range.
What shows no text (scripts, styles, heads, comments, form controls) is left out.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

# Element names of the HTML standard.
BLOCKS = (
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot"
    " th thead tr ul"
).split()
HIDDEN = "script style head template svg math iframe object canvas select textarea noscript title audio video map datalist".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# A start tag on the left ends an open element on the right, up to the nearest of the elements of its scope.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr main menu nav ol p pre search section summary table ul".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"optgroup"}),
}
BLOCK_SET, HIDDEN_SET, VOID_SET = set(BLOCKS), set(HIDDEN), set(VOID)

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
ATTRIBUTES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Word stems of attribute values, by what they tell; a token counts for the first stem that it begins with.
STEMS = {
    "content": "article content main post entry story body text prose read longform markdown wiki".split(),
    "menu": "nav menu breadcrumb crumb toc pagination pager tabs skip".split(),
    "head": "header masthead banner logo brand topbar hero".split(),
    "foot": "footer foot copyright legal colophon bottom".split(),
    "side": "sidebar aside rail widget related recommend popular trending more teaser".split(),
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promoted promotion dfp commercial outbrain taboola".split(),
    "notice": "cookie consent gdpr notice alert popup modal overlay paywall subscribe newsletter signup disclaimer warning".split(),
    "form": "form login search input contact survey poll".split(),
    "comment": "comment comments reply replies respond disqus discussion thread feedback review reviews".split(),
    "social": "share sharing social follow like tweet rating print".split(),
    "about": "author byline meta date tags tag caption credit bio profile".split(),
}
# Stems that stand for a token only as a whole: many words begin like them.
WHOLE = {"ad", "ads", "adv", "nav", "toc", "foot", "tag", "like", "more", "form", "main", "post", "text", "body", "read", "meta", "date"}
GROUPS = list(STEMS)
_stem_group = {stem: group for group, (_, stems) in enumerate(STEMS.items()) for stem in stems}


def groups_of(value: str) -> int:
    """The groups of an attribute value's tokens, as bits."""
    bits = 0
    for token in TOKENS.findall(value):
        token = token.lower()
        group = _stem_group.get(token)
        if group is None:
            for size in range(len(token) - 1, 3, -1):
                if token[:size] in _stem_group and token[:size] not in WHOLE:
                    group = _stem_group[token[:size]]
                    break
        if group is not None:
            bits |= 1 << group
    return bits


# Tags with a feature of their own, for a node and for its ancestors.
MARKED = "leaf p li ul td div section article main nav header footer aside form h1 h2 h3 blockquote pre figure button dd details dialog".split()
MARKS = {tag: number for number, tag in enumerate(MARKED)} | {"ol": 3, "menu": 3, "th": 4, "h4": 16, "h5": 16, "h6": 16, "fieldset": 13, "dt": 21}


@dataclass
class Page:
    """Parallel lists of the nodes of a page; `end` is the index after a node's subtree."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)


class _Builder:
    def __init__(self) -> None:
        self.page = Page()
        # (tag, node, linked before)
        self.stack: list[tuple[str, int, bool]] = []
        self.run: list[str] = []
        self.run_linked, self.run_inline, self.linked = 0, 0, False
        self._node("div", 0, None)
        self.stack.append(("", 0, False))

    def _node(self, mark: str, groups: int, text: str | None) -> int:
        page, number = self.page, len(self.page.parent)
        page.parent.append(self.stack[-1][1] if self.stack else -1)
        page.depth.append(len(self.stack))
        page.mark.append(MARKS.get(mark, MARKS["div"]))
        page.groups.append(groups)
        page.text.append(text)
        page.end.append(number + 1)
        page.linked.append(0)
        page.inline.append(0)
        return number

    def words(self, raw: str) -> None:
        self.run.append(raw)
        if self.linked:
            self.run_linked += len(raw)

    def flush(self) -> None:
        if self.run:
            text = " ".join(html.unescape("".join(self.run)).split())
            if text:
                number = self._node("leaf", 0, text)
                self.page.linked[number] = min(self.run_linked, len(text))
                self.page.inline[number] = self.run_inline
        self.run, self.run_linked, self.run_inline = [], 0, 0

    def open(self, tag: str, groups: int) -> None:
        self.flush()
        if tag in ENDS_P:
            self._end({"p"}, {"button", "table", "td", "th"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        number = self._node(tag, groups, None)
        self.stack.append((tag, number, self.linked))

    def _end(self, tags: set[str], scope: set[str]) -> None:
        """Ends the outermost open element of `tags` within the scope."""
        found = None
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at][0]
            if tag in tags:
                found = at
                if tags == {"p"}:
                    break
            elif tag in scope or (tag in ENDS_P and tags == {"p"}):
                break
        if found is not None:
            self.pop(found)

    def close(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                self.flush()
                self.pop(at)
                return

    def pop(self, at: int) -> None:
        for _, number, linked in reversed(self.stack[at:]):
            self.page.end[number] = len(self.page.parent)
            self.linked = linked
        del self.stack[at:]

    def finish(self) -> Page:
        self.flush()
        self.pop(0)
        return self.page


def parse(source: str) -> Page:
    """The nodes of a page; broken markup is read the way browsers repair it, as far as blocks are concerned."""
    build, at, size = _Builder(), 0, len(source)
    quotes = True
    missing: set[str] = set()
    while at < size:
        less = source.find("<", at)
        if less < 0:
            build.words(source[at:])
            break
        if less > at:
            build.words(source[at:less])
        found = NAME.match(source, less)
        if found is None:
            if source.startswith("<!--", less):
                end = source.find("-->", less + 4)
                at = size if end < 0 else end + 3
            elif source.startswith(("<!", "<?", "</"), less):
                end = source.find(">", less)
                at = size if end < 0 else end + 1
            else:
                build.words("<")
                at = less + 1
            continue
        closing, tag = found.group(1), found.group(2).lower()
        rest = REST.match(source, found.end()) if quotes else None
        if rest is None:
            # a quote that never ends: from here on tags end at the next bracket
            quotes = False
            end = source.find(">", found.end())
            end = size if end < 0 else end + 1
        else:
            end = rest.end()
        inside, at = source[found.end() : end - 1], end
        if tag in HIDDEN_SET:
            if not closing and not inside.endswith("/") and tag not in missing:
                last = re.compile(rf"</{tag}\s*>|<body[\s>]" if tag == "head" else rf"</{tag}\b[^>]*>", re.I).search(source, at)
                if last is not None:
                    at = last.start() if last.group().lower().startswith("<body") else last.end()
                else:
                    missing.add(tag)
                    if tag in ("script", "style"):
                        at = size
            build.words(" ")
        elif tag in BLOCK_SET:
            if closing:
                build.close(tag)
            else:
                groups = 0
                if inside:
                    for a in ATTRIBUTES.finditer(inside):
                        name, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                        if name == "hidden" or (name == "style" and INVISIBLE.search(value)):
                            groups |= 1 << len(GROUPS)
                        elif name != "style":
                            groups |= groups_of(value)
                build.open(tag, groups)
        elif tag in VOID_SET:
            build.words(" ")
        else:
            build.run_inline += not closing
            if tag == "a":
                build.linked = not closing
    return build.finish()


FEATURES = (
    [f"is_{tag}" for tag in MARKED]
    + [f"in_{tag}" for tag in MARKED]
    + [f"token_{group}" for group in [*GROUPS, "hidden"]]
    + [f"above_{group}" for group in [*GROUPS, "hidden"]]
    + "chars words leaves links inline density link_share mean_leaf share place place_text depth siblings sibling_place sibling_share like_share before after"
    " largest parent_share after_heading like_chars like_links".split()
)


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of the pages, in their order."""
    counts = np.array([len(page.parent) for page in pages], np.int64)
    first = np.cumsum(counts) - counts
    shift = np.repeat(first, counts)

    def joined(name: str, dtype=np.int64) -> np.ndarray:
        return np.fromiter((x for page in pages for x in getattr(page, name)), dtype, int(counts.sum()))

    number = np.arange(int(counts.sum()))
    root = number == shift
    parent = np.where(root, number, joined("parent") + shift)
    end = joined("end") + shift
    mark, groups = joined("mark"), joined("groups")
    chars = np.fromiter((len(t) if t else 0 for page in pages for t in page.text), np.int64, len(number))
    words = np.fromiter((t.count(" ") + 1 if t else 0 for page in pages for t in page.text), np.int64, len(number))
    leaf = (mark == MARKS["leaf"]).astype(np.int64)

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return (sums[end] - sums[number]).astype(np.float64)

    marks, above = 1 << mark, np.zeros(len(number), np.int64)
    above_groups = np.zeros(len(number), np.int64)
    depth = joined("depth")
    # parents come first, one level of all pages at a time
    order = np.argsort(depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        up = parent[level]
        inner = up != level
        above[level] = np.where(inner, above[up] | marks[up], 0)
        above_groups[level] = np.where(inner, above_groups[up] | groups[up], 0)

    tags_ = len(MARKED)
    bits = [(1 << np.arange(tags_)), (1 << np.arange(len(GROUPS) + 1))]
    own_chars, own_words, leaves = below(chars), below(words), below(leaf)
    links, inline = below(joined("linked")), below(joined("inline"))
    nodes = (end - number).astype(np.float64)
    whole = own_chars[shift]
    before_text = np.concatenate([[0], np.cumsum(chars)])[number] - np.concatenate([[0], np.cumsum(chars)])[shift]

    # siblings: nodes in the order of (parent, page order)
    by_parent = np.lexsort((number, np.where(root, -1 - number, parent)))
    family = np.where(root, -1 - number, parent)[by_parent]
    starts = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]]))
    sizes = np.diff(np.append(starts, len(family)))
    group = np.repeat(np.arange(len(starts)), sizes)
    siblings, place = np.empty(len(number)), np.empty(len(number))
    siblings[by_parent] = np.repeat(sizes, sizes)
    place[by_parent] = np.arange(len(number)) - np.repeat(starts, sizes)
    sorted_chars = own_chars[by_parent]
    previous, following = np.zeros(len(number)), np.zeros(len(number))
    same = np.concatenate([family[1:] == family[:-1], [False]])
    following[by_parent] = np.where(same, np.append(sorted_chars[1:], 0), 0)
    previous[by_parent] = np.where(np.concatenate([[False], same[:-1]]), np.concatenate([[0], sorted_chars[:-1]]), 0)
    after_heading = np.zeros(len(number))
    heading = np.isin(mark[by_parent], [MARKS["h1"], MARKS["h2"], MARKS["h3"]])
    after_heading[by_parent] = np.concatenate([[False], heading[:-1]]) & np.concatenate([[False], same[:-1]])
    largest = np.empty(len(number))
    largest[by_parent] = np.repeat(np.maximum.reduceat(sorted_chars, starts), sizes) if len(starts) else 0
    like = group * tags_ + mark[by_parent]
    _, inverse, alike = np.unique(like, return_inverse=True, return_counts=True)
    like_share = np.empty(len(number))
    like_share[by_parent] = alike[inverse] / np.repeat(sizes, sizes)
    like_chars, like_links = np.empty(len(number)), np.empty(len(number))
    like_chars[by_parent] = np.bincount(inverse, sorted_chars, len(alike))[inverse]
    like_links[by_parent] = np.bincount(inverse, links[by_parent], len(alike))[inverse]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    columns = [
        np.log1p(own_chars), np.log1p(own_words), np.log1p(leaves), share(links, own_chars), inline / nodes, share(own_chars, nodes),
        share(links, own_chars), share(own_chars, leaves), share(own_chars, whole), share(number - shift, nodes[shift]),
        share(before_text, whole), depth, np.log1p(siblings), share(place, siblings), share(own_chars, own_chars[parent]), like_share,
        np.log1p(previous), np.log1p(following), share(own_chars, largest), share(own_chars[parent], whole), after_heading,
        share(like_chars, own_chars[parent]), share(like_links, like_chars),
    ]
    flags = [(values[:, None] & weights) != 0 for values, weights in ((marks, bits[0]), (above, bits[0]), (groups, bits[1]), (above_groups, bits[1]))]
    return np.concatenate([*flags, np.stack(columns, axis=1)], axis=1).astype(np.float32)
