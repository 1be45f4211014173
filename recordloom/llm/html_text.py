"""Main text of web pages by wrappers: union-free regular expressions inferred from all pages of a host.

A page becomes a stream of block tags and text slots. Inline markup belongs to the text, closing tags that HTML lets
authors leave out are implied, and repeats are folded into repeated groups, so that pages of one template have short,
similar streams. Alignment takes two expressions and resolves mismatches: a text against a text is a slot, tokens that
only one side has become an optional group, a group that one side repeats becomes a repeated group. A task adds up its
own pages of one shape, which no order changes; a host's shapes are aligned in the order of their text, in buckets of
their hash first, then bucket by bucket. So the wrapper follows from the host's pages alone, whatever files and tasks
they are in, and no task gathers more than a share of a hot host.

A text slot of the expression keeps what the aligned pages have in it: pages, characters, characters in links, and the
text's digest while all have the same. Slots inside navigation, headers, footers, forms and the like are boilerplate.
The rest is the article if there is an article (or main) element. Otherwise it is the deepest container of all slots
that differ between pages and aren't links, without links and without the template's texts: those that are the same
on over half of the host's pages, and stand in a container where no text differs. A heading that all articles have
stands among texts that differ, and stays.

To extract a page's text, the expression is matched against the page's elements, from the inside out; each
text then belongs to the slot that it matched, and stays if that slot is the article's.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialize

#: Elements whose text is never an article's; those whose content isn't markup; inline elements; elements without content.
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "option", "textarea", "label", "iframe", "svg", "canvas", "dialog", "menu", "object", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag of the key ends open elements of the values.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Parts of names in class, id or role that mark boilerplate, and parts that such names may have besides. Names with
#: other parts (has-sidebar, comments-open, article-header, content-sidebar-wrap) say how a page is laid out.
_WORD = r"(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|pagination|disqus|popup|promo\w*|related|reply|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)"
_BESIDES = r"(?:\d+|site|page|top|bottom|left|right|main|global|primary|secondary|mobile|desktop|bar|box|block|list|links?|buttons?|icons?|items?|area|section|form|text|title|inner|posts|articles|stories|slot|unit|signup)"
_AROUND = r"(?:wrap|wrapper|container|thread|holder)"
_OF = r"(?:post|user|users|reader|readers|visitor|article|entry|blog|page|story|wp|block|fb|facebook|all|the)"
_COMMENTS = rf"(?:{_OF}[_-]+)*(?:comments?|disqus|replies)(?:[_-]+(?:{_AROUND}|{_BESIDES}))*"
MARKS = re.compile(rf"(?:^|\s)(?:{_COMMENTS}|(?:{_BESIDES}[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_BESIDES}|{_AROUND}))*)(?:$|\s)", re.I)
#: Elements that are never marked themselves.
UNMARKED = {"html", "body", "article", "main"}
MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|main-?content|post-?(?:body|content)|entry-?content|article-?(?:body|content)|story)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"\s*([^\s\"]+)|'\s*([^\s']+)|([^\s>\"']+))", re.I)
#: Parts of class names that are counted or made up (col2, css-1x9fz): with a digit.
_MADE = re.compile(r"[a-z]*\d[a-z0-9]*")
#: Most items of a repeated group, and of a list before it becomes a group of all orders.
GROUP, MOST_ITEMS = 6, 32
#: Elements that make up a container's text: a text in them stands in the container.
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "details", "summary", "address"}
#: Elements inside each other that have levels of their own; what lies deeper is text of the deepest such element.
DEEP = 64
#: Tasks whose sums of a shape one task adds up in the first round.
FANOUT = 64
#: Buckets of a host's shapes in the rounds of alignment; each number divides the one before.
BUCKETS = (16_384, 128, 1)
#: Items of expressions that a task holds before it passes them on.
HELD = 500_000


def tokens(page: str) -> list[tuple[str, str, str, int]]:
    """(kind, path, text, characters in links): kind is `<x`, `>x` or `#` of a text slot whose path names its open elements.

    Elements are named by tag, a `!` for boilerplate marks or a `*` for marks of the main content, and their first class
    with its parts that have digits as 0. Text keeps its references and white space as they are. Closing tags without an open element are passed over; elements that the
    page leaves open end with it. Elements below DEEP others separate texts but have no tokens, and boilerplate among
    them has no texts. Where all articles of a page are inside marked elements, those aren't boilerplate.
    """
    out, holders, free = _tokens(page, set())
    while holders and not free:
        plain = holders
        out, holders, free = _tokens(page, plain)
        holders = holders | plain if holders - plain else set()
    return out


def _tokens(page: str, plain: set[int]) -> tuple[list[tuple[str, str, str, int]], set[int], bool]:
    """The tokens; where marked elements that hold an article (or main) start; whether one is outside of such elements.

    Elements that start at the places `plain` are not marked.
    """
    holders: set[int] = set()
    free = False
    starts: list[int] = []
    out: list[tuple[str, str, str, int]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    inline: list[tuple[str, str]] = []
    linked = links = 0
    bad: set[int] = set()  # places of boilerplate in the part of the stack that has no tokens
    path = ""

    def flush() -> None:
        nonlocal linked
        whole = "".join(text)
        if whole.strip() and not bad:
            out.append(("#", path, whole, linked))
        text.clear()
        linked = 0

    def pop(n: int) -> None:
        nonlocal path
        flush()
        while len(stack) > n:
            tag, name = stack.pop()
            starts.pop()
            if len(stack) < DEEP:
                out.append((f">{name}", "", "", 0))
            else:
                bad.discard(len(stack))
        path = named()

    def named() -> str:
        return "/".join(name for _, name in stack[:DEEP])

    def said(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) * bool(links)

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            said(page[at:])
            break
        said(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", found.start()):
                said(entities.escape(re.sub(r"\]\]>\Z", "", found[0][9:])))
            continue
        marks = " ".join(a or b or c for a, b, c in _MARK.findall(found[3])) if not found[1] and found[3] else ""
        marked = bool(marks) and tag not in UNMARKED and found.start() not in plain and bool(MARKS.search(marks))
        if tag in INLINE and not marked:
            if tag == "a":
                links = 0 if found[1] else 1
            if found[1] and inline and inline[-1][0] == tag and stack and stack[-1][0] == inline[-1][1]:
                inline.pop()
                pop(len(stack) - 1)
            continue
        if tag == "br" or tag in VOID:
            text.append(" ")
            continue
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        ended = IMPLIED.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        while stack and stack[-1][0] in ended:
            pop(len(stack) - 1)
        kind = _CLASS.search(found[3]) if found[3] else None
        own = _MADE.sub("0", re.sub(r"[^a-z0-9_-]", "", next(filter(None, kind.groups()), "").lower())) if kind else ""
        name = tag + ("!" if marked else "*" if marks and MAIN.search(marks) else "") + (f".{own}" if own else "")
        flush()
        if tag in INLINE:  # an inline element with boilerplate marks stands as a block of its own
            inline.append((tag, tag))
        if tag in {"article", "main"}:
            above = {at for at, (_, n) in zip(starts, stack, strict=True) if "!" in n}
            holders |= above
            free |= not above
        if len(stack) < DEEP:
            out.append((f"<{name}", "", "", 0))
        elif marked or tag in SKIPPED:
            bad.add(len(stack))
        stack.append((tag, name))
        starts.append(found.start())
        path = named()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            raw = page[at : end.start() if end else size]
            if raw.strip() and not bad:
                out.append(("#", path, raw, 0))
            at = end.end() if end else size
            pop(len(stack) - 1)
    pop(0)
    return out, holders, free


#: An item of an expression: sign ("" once, ? + *), name (a tag, # for text, empty for a group), the items inside, and
#: of texts what is in the slot: pages, characters, characters in links, the texts' digest or None if they differ.
Item = tuple[str, str, tuple, tuple | None]


PAGE, APART, MIXED = "page", "apart", "mixed"


def _sign(least: int, many: bool) -> str:
    return "+" if least and many else "*" if many else "" if least else "?"


def _key(item: Item) -> str:
    return item[1] or "(" + " ".join(map(_key, item[2])) + ")"


def _either(x: Item, y: Item, how: str, repeated: bool = False) -> Item:
    """The item that accepts x or y, two items of one key; `repeated`: x followed by y, any number of times.

    `how` says where x and y are from: PAGE (one page, whose texts together are what a slot has), APART (pages of their
    own) or MIXED (pages that both may have).
    """
    bare = (x[0] in ("?", "*"), y[0] in ("?", "*"))
    least = 0 if (all(bare) if repeated else any(bare)) else 1
    many = repeated or x[0] in ("+", "*") or y[0] in ("+", "*")
    m, n = x[3], y[3]
    text = m and (m[3] if m[3] == n[3] else _digest(f"{m[3]} {n[3]}") if how == PAGE and m[3] and n[3] else None)
    slot = m and (m[0] + n[0] if how == APART else max(m[0], n[0]), m[1] + n[1], m[2] + n[2], text)
    return _sign(least, many), x[1], align(x[2], y[2], how), slot


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=6).hexdigest()


def _optional(item: Item) -> Item:
    return _sign(0, item[0] in ("+", "*")), *item[1:]


def _fold(items: tuple[Item, ...], how: str = PAGE) -> tuple[Item, ...]:
    """Adjacent items of one key become a repeated item, adjacent runs of equal keys a repeated group.

    A list that stays longer than MOST_ITEMS becomes one repeated group of optional items, which accepts all orders.
    """
    out: list[Item] = []
    keys: list[str] = []
    for item in items:
        key = _key(item)
        if keys and keys[-1] == key:
            out[-1] = _either(out[-1], item, how, repeated=True)
        else:
            out.append(item)
            keys.append(key)
    if len(set(keys)) == len(keys) <= MOST_ITEMS:
        return tuple(out)
    for n in range(2, GROUP + 1):
        at = 0
        while at + 2 * n <= len(out):
            first, second = out[at : at + n], out[at + n : at + 2 * n]
            if [*map(_key, first)] == [*map(_key, second)]:
                out[at : at + 2 * n] = [("+", "", tuple(_either(x, y, how) for x, y in zip(first, second, strict=True)), None)]
                group = out[at][2]
                while [*map(_key, out[at + 1 : at + 1 + n])] == [*map(_key, group)]:
                    group = tuple(_either(x, y, how) for x, y in zip(group, out[at + 1 : at + 1 + n], strict=True))
                    out[at : at + 1 + n] = [("+", "", group, None)]
            at += 1
    if len(out) > MOST_ITEMS:
        flat: dict[str, Item] = {}
        for item in out:
            for x in _leaves(item):
                flat[_key(x)] = _either(flat[_key(x)], x, how) if _key(x) in flat else x
        out = [("*", "", tuple(_optional(flat[k]) for k in sorted(flat)), None)]
    return tuple(out)


def _leaves(item: Item) -> list[Item]:
    """The named items of an item: itself, or those of a group's items."""
    return [item] if item[1] else [x for i in item[2] for x in _leaves(i)]


def align(a: tuple[Item, ...], b: tuple[Item, ...], how: str = APART) -> tuple[Item, ...]:
    """An expression that accepts both: items of one key align within, the others become optional."""
    if not a and not b:
        return a
    left, right = [*map(_key, a)], [*map(_key, b)]
    if left == right:
        return tuple(_either(x, y, how) for x, y in zip(a, b, strict=True))
    for x, y in ((a, b), (b, a)):  # an expression of all orders takes in new items
        if len(x) == 1 and x[0][:2] == ("*", "") and len(x[0][2]) > 1 and all(i[1] and i[0] in ("?", "*") for i in x[0][2]):
            flat = {_key(i): i for i in x[0][2]}
            for item in y:
                for i in _leaves(item):
                    flat[_key(i)] = _optional(_either(flat[_key(i)], i, how) if _key(i) in flat else i)
            return (("*", "", tuple(flat[k] for k in sorted(flat)), None),)
    out: list[Item] = []
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_either(x, y, how) for x, y in zip(a[a0:a1], b[b0:b1], strict=True)]
        else:
            out += [_optional(x) for x in (*a[a0:a1], *b[b0:b1])]
    return _fold(tuple(out), PAGE if how == PAGE else MIXED)


def expression(stream: list[tuple[str, str, str, int]]) -> tuple[Item, ...]:
    """A page's union-free expression."""
    levels: list[list[Item]] = [[]]
    for kind, _, text, linked in stream:
        if kind == "#":
            levels[-1].append(("", "#", (), (1, len(text), linked, _digest(text))))
        elif kind[0] == "<":
            levels.append([])
        else:
            inner = _fold(tuple(levels.pop()))
            levels[-1].append(("", kind[1:], inner, None))
    return _fold(tuple(levels[0]))


def shape(items: tuple[Item, ...]) -> str:
    """What expressions have in common that differ in nothing but the texts: names and signs."""
    return " ".join(f"{name or '.'}{sign}" + (f"({shape(inner)})" if inner else "") for sign, name, inner, _ in items)


def pattern(items: tuple[Item, ...]) -> str:
    """The expression as a regular expression over tokens, each followed by a line end."""
    out = ""
    for sign, name, inner, _ in items:
        body = "\\#\n" if name == "#" else pattern(inner) if not name else f"<{re.escape(name)}\n{pattern(inner)}>{re.escape(name)}\n"
        out += f"(?:{body}){sign}"
    return out


class _Level:
    """The automaton of an element's items: which named item (by number) may begin, end and follow which."""

    def __init__(self, items: tuple[Item, ...], path: tuple[str, ...], slots: list, levels: dict[str, list[_Level]]):
        self.levels = levels
        self.leaves: list[_Level | int] = []
        self.follow: list[set[int]] = []
        self.by_name: dict[str, list[int]] = {}
        self.first, self.last, self.empty = self._build(items, path, slots)
        levels.setdefault("/".join(path), []).append(self)

    def _build(self, items: tuple[Item, ...], path: tuple[str, ...], slots: list) -> tuple[set[int], set[int], bool]:
        """First and last items of a list, and whether it may be empty."""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for sign, name, inner, slot in items:
            if name:
                number = len(self.leaves)
                self.follow.append(set())
                self.by_name.setdefault(name, []).append(number)
                if name == "#":
                    self.leaves.append(len(slots))
                    slots.append(("/".join(path), slot, sign))
                else:
                    self.leaves.append(_Level(inner, (*path, name), slots, self.levels))
                begin, end, bare = {number}, {number}, False
            else:
                begin, end, bare = self._build(inner, path, slots)
            if sign in ("+", "*"):
                for x in end:
                    self.follow[x] |= begin
            bare |= sign in ("?", "*")
            for x in last:
                self.follow[x] |= begin
            first = first | begin if empty else first
            last = last | end if bare else end
            empty &= bare
        return first, last, empty

    def match(self, choices: list[list[int]]) -> list[int] | None:
        """An item for each of an element's children, out of those that are possible for it; None if there is no way."""
        if not choices:
            return [] if self.empty else None
        states: dict[int, int | None] = {x: None for x in choices[0] if x in self.first}
        steps = [states]
        for own in choices[1:]:
            after: dict[int, int | None] = {}
            for x in own:
                for y in states:
                    if x in self.follow[y]:
                        after[x] = y
                        break
            states = after
            steps.append(states)
        at = next((x for x in states if x in self.last), None)
        if at is None:
            return None
        out = []
        for step in reversed(steps):
            out.append(at)
            at = step[at]
        return out[::-1]


class Wrapper:
    """A host's expression and its number of pages."""

    def __init__(self, items: tuple[Item, ...] | None = None, pages: int = 0):
        self.items, self.pages = items, pages

    def add(self, stream: list[tuple[str, str, str, int]]) -> None:
        self.merge(Wrapper(expression(stream), 1))

    def merge(self, other: Wrapper) -> None:
        if other.items is not None:
            self.items = other.items if self.items is None else align(self.items, other.items)
        self.pages += other.pages

    def dumps(self) -> str:
        return json.dumps([self.items, self.pages])

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        items, pages = json.loads(text)
        tupled = lambda xs: tuple((sign, name, tupled(inner), slot and tuple(slot)) for sign, name, inner, slot in xs)
        return cls(None if items is None else tupled(items), pages)

    def compiled(self) -> Extractor:
        return Extractor(self.items or (), self.pages)


class Extractor:
    """A wrapper's expression as automata, with the decision for each slot."""

    def __init__(self, items: tuple[Item, ...], pages: int = 0):
        self.pages = pages
        self.slots: list[tuple[str, tuple, str]] = []
        self.levels: dict[str, list[_Level]] = {}
        self.top = _Level(items, (), self.slots, self.levels)
        self.keep = self._decide()

    def _decide(self) -> list[bool]:
        """Whether each slot is the article's."""
        usable = [not boilerplate(path) for path, _, _ in self.slots]
        for wanted in (lambda n: _tag(n) == "article", lambda n: _tag(n) == "main", lambda n: "*" in n):
            inside = [u and any(map(wanted, path.split("/"))) for u, (path, _, _) in zip(usable, self.slots, strict=True)]
            if any(inside):
                return inside
        # what differs between pages and isn't links, and the containers that it stands in
        own = [u and not self._linked(slot) for u, (_, slot, _) in zip(usable, self.slots, strict=True)]
        differs = {_container(path) for o, (path, slot, _) in zip(own, self.slots, strict=True) if o and slot[3] is None}
        if differs:
            own = [o and not (self._same(slot) and _container(path) not in differs) for o, (path, slot, _) in zip(own, self.slots, strict=True)]
        if not any(own):
            return usable
        names = [path.split("/") for o, (path, slot, _) in zip(own, self.slots, strict=True) if o and not (differs and self._same(slot))]
        root = [x[0] for x in zip(*names, strict=False)][: next((i for i, x in enumerate(zip(*names, strict=False)) if len(set(x)) > 1), None)]
        while len(root) > 1 and _tag(root[-1]) in FLOW:
            root.pop()
        return [o and path.split("/")[: len(root)] == root for o, (path, _, _) in zip(own, self.slots, strict=True)]

    @staticmethod
    def _linked(slot: tuple) -> bool:
        return 2 * slot[2] >= slot[1]

    def _same(self, slot: tuple) -> bool:
        """Whether a slot has one text on over half of the host's pages, and on more than a single one."""
        return slot[3] is not None and 2 * slot[0] > self.pages > 1

    def slots_of(self, stream: list[tuple[str, str, str, int]]) -> list[int | None]:
        """The slot that each text of a page's stream matches, None for texts in elements that the wrapper lacks."""
        # the paths of elements, and their children: texts by number, elements by place in these lists
        paths, children = [""], [[]]
        open_, texts = [0], 0
        for kind, *_ in stream:
            if kind == "#":
                children[open_[-1]].append(("#", texts))
                texts += 1
            elif kind[0] == "<":
                children[open_[-1]].append((kind[1:], len(paths)))
                above = paths[open_[-1]]
                open_.append(len(paths))
                paths.append(f"{above}/{kind[1:]}" if above else kind[1:])
                children.append([])
            else:
                open_.pop()
        # from the inside out: the expression's elements that accept a page's element, and how
        ways: list[dict[_Level, list[int]]] = [{} for _ in paths]
        for element in range(len(paths) - 1, -1, -1):
            for level in self.levels.get(paths[element], ()):
                choices = [[x for x in level.by_name.get(n, ()) if n == "#" or level.leaves[x] in ways[c]] for n, c in children[element]]
                if all(choices) and (way := level.match(choices)) is not None:
                    ways[element][level] = way
        out: list[int | None] = [None] * texts
        waiting = [(0, self.top)]
        while waiting:
            element, level = waiting.pop()
            # where the expression doesn't accept an element, its children go to the first items of their names
            way = ways[element].get(level) or [level.by_name.get(n, [None])[0] for n, _ in children[element]]
            for (name, number), leaf in zip(children[element], way, strict=True):
                if leaf is not None:
                    if name == "#":
                        out[number] = level.leaves[leaf]
                    else:
                        waiting.append((number, level.leaves[leaf]))
        return out

    def text(self, stream: list[tuple[str, str, str, int]]) -> str:
        """The texts of a page that match the article's slots; all but boilerplate where the page has none of them."""
        texts = [(path, text) for kind, path, text, _ in stream if kind == "#"]
        own = [text for (_, text), slot in zip(texts, self.slots_of(stream), strict=True) if slot is not None and self.keep[slot]]
        return " ".join(filter(None, map(_clean, own or [text for path, text in texts if not boilerplate(path)])))


def _tag(name: str) -> str:
    return re.match(r"[a-z0-9:-]*", name)[0]


def _container(path: str) -> str:
    """The path of the element whose text a slot is part of."""
    names = path.split("/")
    while len(names) > 1 and _tag(names[-1]) in FLOW:
        names.pop()
    return "/".join(names)


@functools.lru_cache(100_000)
def boilerplate(path: str) -> bool:
    """A header inside an article is the article's own heading, all other SKIPPED elements are boilerplate."""
    names = path.split("/")
    inside = False
    for name in names:
        tag = _tag(name)
        if "!" in name or (tag in SKIPPED and not (tag == "header" and inside)):
            return True
        inside |= tag in {"article", "main"}
    return False


def _clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _size(items: tuple[Item, ...]) -> int:
    return sum(1 + _size(inner) for _, _, inner, _ in items)


_SHAPES = "host string, share int, bucket int, shape string, wrapper string"


def _summed(sums: dict[tuple, Wrapper], share: int):
    """Rows of _SHAPES for the wrappers of (host, bucket, shape)."""
    import pyarrow as pa

    hosts, buckets, shapes = zip(*sums, strict=True) if sums else ((), (), ())
    return pa.table({"host": pa.array(hosts, pa.string()), "share": pa.array([share] * len(sums), pa.int32()), "bucket": pa.array(buckets, pa.int32()), "shape": pa.array(shapes, pa.string()), "wrapper": pa.array([w.dumps() for w in sums.values()], pa.string())})


def _infer(batches):
    from pyspark import TaskContext

    share = TaskContext.get().partitionId() // FANOUT
    sums: dict[tuple, Wrapper] = {}
    held = 0
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            items = expression(tokens(page or ""))
            name = shape(items)
            bucket = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest()) % BUCKETS[0]
            if (host, bucket, name) not in sums:
                held += _size(items)
            sums.setdefault((host, bucket, name), Wrapper()).merge(Wrapper(items, 1))
        if held > HELD:  # sums of sums are the same
            yield from _summed(sums, share).to_batches()
            sums, held = {}, 0
    yield from _summed(sums, share).to_batches()


def _sums(table) -> dict[tuple, Wrapper]:
    """A group's wrappers by host, bucket and shape, those of one shape added up."""
    sums: dict[tuple, Wrapper] = {}
    for host, bucket, name, text in zip(*(table.column(c).to_pylist() for c in ("host", "bucket", "shape", "wrapper")), strict=True):
        sums.setdefault((host, bucket, name), Wrapper()).merge(Wrapper.loads(text))
    return sums


def _added(table):
    return _summed(_sums(table), 0)


def _together(table):
    """One wrapper of a group's, aligned in the order of their shapes and what is in them."""
    sums = _sums(table)
    whole = Wrapper()
    for _, wrapper in sorted(sums.items(), key=lambda x: (x[0][2], x[0][1])):
        whole.merge(wrapper)
    host, bucket, _ = next(iter(sums))
    return _summed({(host, bucket, shape(whole.items)): whole}, 0)


def _host(url):
    """A URL's host, lower case; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and wrapper (JSON) for each host of `pages`; pages without a host are one host of their own."""
    rows = pages.select(_host(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    partial = rows.mapInArrow(_infer, _SHAPES)
    partial = partial.groupBy("host", "share", "bucket").applyInArrow(_added, _SHAPES)
    for buckets in BUCKETS:
        partial = partial.withColumn("bucket", F.col("bucket") % buckets).groupBy("host", "bucket").applyInArrow(_together, _SHAPES)
    return partial.select("host", "wrapper")


def _apply(batches):
    import pyarrow as pa

    compiled: dict[str | None, Extractor] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if wrapper not in compiled:
                if len(compiled) >= 1000:  # a memory bound; those that return are compiled again
                    compiled.clear()
                compiled[wrapper] = (Wrapper.loads(wrapper) if wrapper else Wrapper()).compiled()
            texts.append(compiled[wrapper].text(tokens(page or "")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of `pages`.

    A null page counts as empty and has the empty text. Repeated rows are pages of their own, and ties don't arise. An
    empty table gives no rows. Pages of any length and nesting are read whole, malformed ones as far as they go. Only
    the three named columns are read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # a table of known size: Spark sends it along if it is small enough, so that no page moves, and joins by host if not
    wrappers = materialize(infer_wrappers(pages, url_col, html_col), "wrappers")
    joined = rows.withColumn("host", _host(F.col("url"))).join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_apply, "page_id long, url string, text string, n_chars long")
