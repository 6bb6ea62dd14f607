"""Main text of web pages by equivalence-class template deduction.

Pages of one host are taken together; a large host's are dealt out in even lots. Every tag and word of a page is a
token, told apart by where in the page it stands. Tokens that occur equally often on each of the
pages have the same occurrence vector; those that share one are an equivalence class. A class is
valid if its tokens come in the same order on every page and it does not straddle a class around it.
Valid classes, nested, are the template; what stands between their tokens are the slots. The tokens
that every page has once are the outermost class: equal tags in different gaps of it, or in a gap that
has the same number of them on each page, are tokens of their own, which join the class in turn until
none is left to tell apart. So the parts of a page get their places without any name. A page's text
is what the slots of its article hold: of the innermost element whose slots hold most of the host's
text. What elements say of themselves only names slots within it, and decides alone where too few
pages tell.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, grouped_blocks, materialize

#: A host with twice these pages, or more than these bytes, is dealt out in lots of about as many. For
#: its bytes no lot gets fewer than LEAST_LOT pages on average, so that each lot can tell its template.
PAGES_PER_TEMPLATE, BYTES_PER_TEMPLATE, LEAST_LOT = 64, 16_000_000, 24
#: So many times as much is held of a lot at a time.
HELD = 4
#: Distinct pages without which no text counts as template, the share of pages that template text
#: is on, and the share of an article beyond which repeated text means copies, not a template.
LEAST_PAGES, SUPPORT, MOST_TEMPLATE = 5, 0.9, 0.3
#: Of all slot text, what the chosen element must hold where no element is marked as the article.
MOST_TEXT = 0.6
#: A block with this share of its characters in links is a menu, for all that is known without slots.
MOST_LINKED = 0.6

#: Elements that never hold article text, inline elements, and elements whose content
#: is not markup.
CHROME_ELEMENTS = frozenset("nav header footer aside form button select option textarea input label fieldset dialog menu menuitem svg math iframe object canvas audio video noscript template head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style textarea title xmp noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role that mark what is not the article, and what is.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer footers colophon sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay toast newsletter "
    "subscribe subscription signup login signin register search share sharing social related recommended recommendations teaser teasers comment comments commentlist disqus respond replies reply "
    "discussion pager pagination toolbar copyright legal disclaimer skip hidden contentinfo complementary form".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply discussion teaser related recommended ad ads advert promo sponsored".split())
ARTICLE_WORDS = frozenset("article articlebody content post entry story main maincontent bodytext posttext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open element of the same set.
_ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS_IN_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    """A run of text between block-level tags."""

    element: int  # the number of the element that it stands in, 0 for none
    shape: str  # the names of the open elements
    text: str
    linked: int  # characters of it in links
    chrome: bool
    heading: bool
    words: list[str]


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    tokens: list[tuple[str, str]]  # (shape, tag or word), in page order
    tags: list[int]  # which of them are tags
    parents: list[int]  # by number of an element: that around it; number 0 is the page
    names: list[str]  # its name and class
    opened: list[int]  # its token
    containers: dict[int, str]  # number of each element that says it holds the article: its kind


@dataclass(slots=True)
class Open:
    """An element on the stack."""

    name: str
    number: int
    chrome: bool
    shape: str
    in_header: bool  # in the header of an article
    in_article: bool
    in_heading: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _names(attributes: dict[str, str]) -> set[str]:
    joined = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    return {w.lower() for w in _WORDS_IN_NAME.findall(joined)} | set(joined.lower().split())


def _is_chrome(name: str, attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    names = _names(attributes) if attributes else set()
    if name == "article" or name in HEADINGS:
        return bool(names & COMMENT_WORDS)
    return name in CHROME_ELEMENTS or bool(names & CHROME_WORDS)


def _kind(name: str, attributes: dict[str, str]) -> str | None:
    """How an element says that it holds the article."""
    if name == "article" or attributes.get("itemprop") == "articleBody":
        return "article"
    if name == "main" or attributes.get("role") == "main":
        return "main"
    if name in ("div", "section", "td") and attributes and _names(attributes) & ARTICLE_WORDS:
        return "named"
    return None


#: Names of shapes are put together up to this length; deeper ones are told apart by a hash.
LONGEST_SHAPE = 400
_DIGITS = re.compile(r"\d+")
_STOP_ITEM = frozenset("ul ol table dl div section article blockquote body tr".split())
_STOP = frozenset("div section article body td li blockquote".split())


def parse(source: str | None) -> Page:
    """Blocks and tokens of a page, however badly formed or deeply nested, in time and space linear
    in its length; nothing but white space is lost."""
    source = source or ""
    page = Page([], [], [], [0], [""], [-1], {})
    outside = Open("", 0, False, "", False, False, False)
    stack: list[Open] = []
    open_names: Counter = Counter()
    links, text, linked = 0, [], 0
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal text, linked
        if text:
            clean = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if clean:
                top = stack[-1] if stack else outside
                words = clean.split(" ")
                page.blocks.append(Block(top.number, top.shape, clean, min(linked, len(clean)), top.chrome and not (top.in_header and top.in_heading), top.in_heading, words))
                page.tokens.extend([(top.shape, w) for w in words])
            text, linked = [], 0

    def tag(shape: str, what: str) -> None:
        page.tags.append(len(page.tokens))
        page.tokens.append((shape, what))

    def pop_to(names: tuple[str, ...], stop: frozenset[str] = frozenset()) -> None:
        if not any(open_names[name] for name in names):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].name in names:
                for gone in reversed(stack[depth:]):
                    tag(gone.shape, "</>")
                    open_names[gone.name] -= 1
                del stack[depth:]
                return
            if stack[depth].name in stop:
                return

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(piece)

    for m in iter(lambda: _MARKUP.search(source, at), None):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        elif m["close"]:
            name = m["close"].lower()
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                continue
            flush()
            pop_to((name,))
        elif m["open"]:
            name, raw = m["open"].lower(), m["attrs"] or ""
            if name in INLINE:
                if name == "br":
                    add(" ")
                elif name == "a":
                    links += 1
                continue
            flush()
            if name in RAW:
                done = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                tag(stack[-1].shape if stack else "", f"<{name}>")
                at = done.end() if done else end
                continue
            if name in VOID or raw.rstrip().endswith("/") and name in ("svg", "path"):
                continue
            # a new block ends an open paragraph
            pop_to(_ENDS.get(name, ("p",)), _STOP_ITEM if name in _ENDS and name != "p" else _STOP)
            attributes = _attributes(raw) if raw and not raw.isspace() else {}
            above = stack[-1] if stack else outside
            own = _is_chrome(name, attributes)
            in_header = above.in_header or own and not above.chrome and above.in_article and (name == "header" or name != "nav" and "header" in _names(attributes))
            mark = f"{name}.{'.'.join(sorted(_DIGITS.sub('0', attributes['class']).split())[:3])}" if attributes.get("class") else name
            shape = f"{above.shape}/{mark}"
            if len(shape) > LONGEST_SHAPE:
                shape = hashlib.blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            number, chrome = len(page.parents), above.chrome or own
            stack.append(Open(name, number, chrome, shape, in_header, above.in_article or name in ("article", "main"), above.in_heading or name in HEADINGS))
            open_names[name] += 1
            page.parents.append(above.number)
            page.names.append(mark)
            page.opened.append(len(page.tokens))
            tag(shape, "<>")
            kind = _kind(name, attributes)
            if kind and not chrome:
                page.containers[number] = kind
    if at < end:
        add(source[at:])
    flush()
    return page


#: A token of the outermost class: itself, and the number of the one before whose gap it is told apart
#: by, its turn in that gap and how many there are, or the number of the one that it stands around and
#: AROUND (None for tokens that need no telling apart).
Role = tuple[tuple[str, str], tuple[int, int, int] | None]


AROUND = (0, -1)


@dataclass(slots=True)
class Template:
    """The tokens of the valid classes, how many distinct pages they come from, the blocks that stand
    on enough of these word for word, and the outermost class: its roles, numbered in the order of
    their finding, and for each round of finding the numbers in page order."""

    tokens: set[tuple[str, str]]
    pages: int
    classes: list[list[tuple[str, str]]]
    blocks: set[tuple[str, str]]
    roles: list[Role]
    rounds: list[list[int]]


def _longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest rising subsequence."""
    tails, tail_at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            tail_at.append(i)
        else:
            tails[k], tail_at[k] = v, i
    out, i = [], tail_at[-1] if tail_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _in_gaps(page: Page, located: dict[int, int]) -> dict[tuple[tuple[str, str], int], list[int]]:
    """Where the tags are that have no role yet, by token and the role before them (-1 for none)."""
    order = sorted((at, role) for role, at in located.items())
    places, taken = [at for at, _ in order], set(located.values())
    found: dict[tuple[tuple[str, str], int], list[int]] = defaultdict(list)
    for i in page.tags:
        if i not in taken:
            k = bisect_right(places, i)
            found[page.tokens[i], order[k - 1][1] if k else -1].append(i)
    return found


def _around(page: Page, located: dict[int, int]) -> dict[int, int]:
    """For the elements whose tags have roles: the tag of the one around it, if that has no role."""
    taken = set(located.values())
    numbers = {at: number for number, at in enumerate(page.opened) if at in taken}
    found = {}
    for role, at in located.items():
        parent = page.parents[numbers[at]] if numbers.get(at, 0) > 0 else 0
        if parent and page.opened[parent] not in taken:
            found[role] = page.opened[parent]
    return found


def _rising(located: dict[int, int], rank: dict[int, int]) -> list[int]:
    """Of the roles on a page those that keep their order."""
    roles = sorted((r for r in located if r in rank), key=lambda r: located[r])
    return [roles[i] for i in _longest_rising([rank[r] for r in roles])]


def locate(page: Page, template: Template) -> dict[int, int]:
    """Where the roles of the outermost class are on a page; any page, also one with some missing."""
    once: dict[tuple[str, str], int] = {}
    wanted = {token for token, gap in template.roles if gap is None}
    for i, token in enumerate(page.tokens):
        if token in wanted:
            once[token] = -1 if token in once else i
    located: dict[int, int] = {}
    for k, order in enumerate(template.rounds):
        gaps, around = (_in_gaps(page, located), _around(page, located)) if k else ({}, {})
        for role in order:
            if role not in located:
                token, told = template.roles[role]
                if told is None:
                    if once.get(token, -1) >= 0:
                        located[role] = once[token]
                elif told[1:] == AROUND:
                    if page.tokens[around.get(told[0], 0)] == token and told[0] in around:
                        located[role] = around[told[0]]
                else:
                    at = gaps.get((token, told[0]), ())
                    if len(at) == told[2]:
                        located[role] = at[told[1]]
        kept = set(_rising(located, {role: n for n, role in enumerate(order)}))
        located = {role: at for role, at in located.items() if role in kept}
    return located


def _ordered(found: list[dict[int, int]], least: float) -> list[int]:
    """The roles in the order that they have on enough pages."""
    fullest = max(found, key=len)
    order = sorted(fullest, key=fullest.__getitem__)
    rank = {role: n for n, role in enumerate(order)}
    astray: Counter = Counter()
    for located in found:
        kept = set(_rising(located, rank))
        astray.update(role for role in located if role in rank and role not in kept)
    return [role for role in order if astray[role] <= len(found) - least]


def outermost_class(pages: list[Page], once: list[tuple[str, str]], least: float) -> tuple[list[Role], list[list[int]]]:
    """Roles and rounds of a template, from the tokens that enough pages have once and none more
    often. Each round tells equal tags in different gaps apart, until none is left."""
    template = Template(set(), len(pages), [], set(), [(token, None) for token in once], [list(range(len(once)))])
    where = []
    for page in pages:
        at = {token: i for i, token in enumerate(page.tokens)}
        where.append({role: at[token] for role, token in enumerate(once) if token in at})
    while True:
        order = _ordered(where, least)
        template.rounds[-1] = order
        rank = {role: n for n, role in enumerate(order)}
        where = [{role: located[role] for role in _rising(located, rank)} for located in where]
        gaps = [_in_gaps(page, located) for page, located in zip(pages, where)]
        around = [_around(page, located) for page, located in zip(pages, where)]
        numbers: dict[tuple[tuple[str, str], int], Counter] = defaultdict(Counter)
        for found in gaps:
            for key, at in found.items():
                numbers[key][len(at)] += 1
        fresh = []
        for key, spread in numbers.items():
            n, on = max(spread.items(), key=lambda x: (x[1], x[0]))
            if on >= least:
                fresh.append((key, n))
        parents: dict[tuple[tuple[str, str], int], int] = Counter()
        for page, found in zip(pages, around):
            parents.update((page.tokens[at], role) for role, at in found.items())
        parents = {key: n for key, n in parents.items() if n >= least}
        if not fresh and not parents:
            return template.roles, template.rounds
        start = len(template.roles)
        taken = [set(located.values()) for located in where]
        for token, role in sorted(parents):
            number, any_new = len(template.roles), False
            for page, located, found, known in zip(pages, where, around, taken):
                at = found.get(role)
                if at is not None and page.tokens[at] == token and at not in known:
                    located[number] = at
                    known.add(at)
                    any_new = True
            if any_new:
                template.roles.append((token, (role, *AROUND)))
        for (token, gap), n in sorted(fresh):
            first = len(template.roles)
            template.roles.extend((token, (gap, i, n)) for i in range(n))
            for located, found, known in zip(where, gaps, taken):
                at = found.get((token, gap), ())
                if len(at) == n and known.isdisjoint(at):
                    located.update(zip(range(first, first + n), at))
                    known.update(at)
        template.rounds.append([])
        if not any(role >= start for role in _ordered(where, least)):
            template.rounds.pop()
            return template.roles, template.rounds


def deduce(pages: list[Page]) -> Template:
    """The template of pages of one host. Pages with the same tokens count once."""
    distinct = list({tuple(p.tokens): p for p in pages}.values())
    n = len(distinct)
    if n < 2:
        return Template(set(), n, [], set(), [], [])
    counts = [Counter(p.tokens) for p in distinct]
    on = Counter(t for c in counts for t in c)
    least = max(2, SUPPORT * n)
    vectors: dict[tuple[int, ...], list[tuple[str, str]]] = defaultdict(list)
    for token, k in on.items():
        if k >= least:
            vectors[tuple(c.get(token, 0) for c in counts)].append(token)
    wanted = {t for group in vectors.values() for t in group}
    places = []
    for p in distinct:
        found: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, t in enumerate(p.tokens):
            if t in wanted:
                found[t].append(i)
        places.append(found)

    # ordered: once per page, what keeps its order everywhere; more often, the same cycle each time
    valid: list[list[tuple[str, str]]] = []
    for vector, group in vectors.items():
        first = next(i for i, k in enumerate(vector) if k)
        group = sorted(group, key=lambda t: places[first][t])
        if max(vector) == 1:
            for i, k in enumerate(vector):
                if k and i != first:
                    group = [group[j] for j in _longest_rising([places[i][t][0] for t in group])]
        else:
            for i, k in enumerate(vector):
                order = [t for _, t in sorted((x, t) for t in group for x in places[i][t])]
                if order != group * k:
                    group = []
                    break
        if group:
            valid.append(group)

    # nested: each turn of a class lies within one gap of the class of tokens on every page once
    root = next((g for g in valid if all(len(p[t]) == 1 for p in places for t in g[:1])), [])
    marks = [[p[t][0] for t in root] for p in places]
    nested = [root] if root else []
    for group in valid:
        if group is not root and all(
            len({bisect_left(marks[i], x) for x in turn}) <= 1
            for i, p in enumerate(places)
            for turn in zip(*(p[t] for t in group))
            if root
        ):
            nested.append(group)
    repeated = Counter(b for p in distinct for b in {(b.shape, b.text) for b in p.blocks})
    most = Counter()
    for c in counts:
        for t in c.keys() & wanted:
            most[t] = max(most[t], c[t])
    once = sorted(t for t in wanted if most[t] == 1)
    roles, rounds = outermost_class(distinct, once, least) if once else ([], [])
    return Template({t for g in nested for t in g}, n, nested, {b for b, k in repeated.items() if k >= least}, roles, rounds)


def _is_fixed(block: Block, template: Template) -> bool:
    """Whether a block is template as a whole. That each of its words is says nothing: on long pages
    the words that every text has are on all pages too."""
    return (block.shape, block.text) in template.blocks


def _slot_share(block: Block, template: Template) -> float:
    """How much of a block is slot, not template."""
    if _is_fixed(block, template):
        return 0.0
    return sum((block.shape, w) not in template.tokens for w in block.words) / len(block.words)


@dataclass(slots=True)
class Places:
    """Which elements of a host's pages stand in the same place: those whose tag has the same role,
    or that have the same name and class in the same place. A place is a number; ``above`` and
    ``names`` tell what is around it and what its elements are called."""

    numbers: dict[tuple, int]
    above: list[int]
    names: list[str]

    def of(self, page: Page, template: Template) -> list[int]:
        """The place of each element of a page; 0 is the page itself."""
        roles = {at: role for role, at in locate(page, template).items()}
        out = [0]
        for number in range(1, len(page.parents)):
            role = roles.get(page.opened[number])
            around = out[page.parents[number]]
            key = (around, page.names[number]) if role is None else (around, page.names[number], role)
            place = self.numbers.get(key)
            if place is None:
                place = self.numbers[key] = len(self.above)
                self.above.append(around)
                self.names.append(page.names[number])
            out.append(place)
        return out


def _inside(page: Page, chosen: Callable[[int], bool]) -> list[bool]:
    """Of each element, whether it or one around it is chosen."""
    out = [chosen(0)]
    for number in range(1, len(page.parents)):
        out.append(out[page.parents[number]] or chosen(number))
    return out


def _marked(page: Page, blocks: list[Block], template: Template, share: float) -> list[Block]:
    """Those of some blocks that are in elements marked as the article, all elements of the first
    kind that holds a share of the blocks' slot text."""
    if not page.containers:
        return []
    amounts = [len(b.text) * (_slot_share(b, template) if template.pages >= LEAST_PAGES else 1) for b in blocks]
    for kind in ("article", "main", "named"):
        inside = _inside(page, lambda number: page.containers.get(number) == kind)
        held = [inside[b.element] for b in blocks]
        if any(held) and sum(a for a, i in zip(amounts, held) if i) >= share * sum(amounts):
            return [b for b, i in zip(blocks, held) if i]
    return []


def article_blocks(page: Page, template: Template, places: list[int], main: int | None) -> list[Block]:
    """The blocks of a page's article, in page order: those of the slots in the place ``main``. Slots
    in it that are named as something else go, and what is marked as the article narrows the others
    down if it holds most of their text. Marks decide where nothing is deduced or the page has no
    such slots."""
    open_blocks = [b for b in page.blocks if not b.chrome]
    known = template.pages >= LEAST_PAGES
    within = _inside(page, lambda number: places[number] == main)
    slots = [b for b in open_blocks if within[b.element]] if main is not None else []
    chosen = _marked(page, slots, template, MOST_TEXT) if known and slots else _marked(page, open_blocks, template, 0)
    if not chosen and known and slots:
        chosen = slots
    elif not chosen:
        chosen = [b for b in slots or open_blocks if b.heading or b.linked < MOST_LINKED * len(b.text)]
    if known:
        fixed = [b for b in chosen if _is_fixed(b, template) and not b.heading]
        if sum(len(b.text) for b in fixed) <= MOST_TEMPLATE * sum(len(b.text) for b in chosen):
            gone = set(map(id, fixed))
            chosen = [b for b in chosen if id(b) not in gone]
    return chosen


def main_place(pages: list[Page], placed: list[list[int]], places: Places, template: Template) -> int | None:
    """The innermost place that holds most of the slot text of a host's pages, links and slots that
    are named as something else apart, or the nearest around it that is marked as the article."""
    held: Counter = Counter()
    kinds: dict[str, set[int]] = defaultdict(set)
    total = 0.0
    for page, of in zip(pages, placed):
        own = [0.0] * len(page.parents)
        for b in page.blocks:
            if not b.chrome and b.linked < MOST_LINKED * len(b.text):
                own[b.element] += len(b.text) * _slot_share(b, template)
        for number in range(len(own) - 1, 0, -1):
            if own[number]:
                # a place within an equal place counts once
                if of[number] != of[page.parents[number]]:
                    held[of[number]] += own[number]
                own[page.parents[number]] += own[number]
        total += own[0]
        for number, kind in page.containers.items():
            kinds[kind].add(of[number])
    depth = [0] * len(places.above)
    for place in range(1, len(depth)):
        depth[place] = depth[places.above[place]] + 1
    enough = [place for place, amount in held.items() if total and amount >= MOST_TEXT * total]
    deepest = max(enough, key=lambda place: (depth[place], -place), default=0)
    # a paragraph is no container
    while deepest and places.names[deepest].split(".")[0] in ("p", *HEADINGS):
        deepest = places.above[deepest]
    for kind in ("article", "main", "named"):
        place = deepest
        while place and place not in kinds[kind]:
            place = places.above[place]
        if place:
            return place
    return deepest or None


def _extract(sources: list[str | None], before: Template | None = None) -> tuple[list[str], Template]:
    """The main texts of pages of one host, and what was deduced, or ``before`` if that knows more
    pages and these are too few."""
    pages = [parse(s) for s in sources]
    template = deduce(pages)
    if before and template.pages < LEAST_PAGES and template.pages < before.pages:
        template = before
    places = Places({}, [0], [""])
    placed = [places.of(page, template) for page in pages]
    main = main_place(pages, placed, places, template)
    return ["\n".join(b.text for b in article_blocks(page, template, of, main)) for page, of in zip(pages, placed)], template


def extract_texts(sources: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    return _extract(sources)[0]


def extract_main_text(pages: DataFrame, per_template: int = PAGES_PER_TEMPLATE) -> DataFrame:
    """page_id, url, text, n_chars, host: the main text of every page.

    Text blocks are joined by newlines, with character references decoded and white space inside a
    block made one space. A null html is empty; a page without text gives an empty string; pages of any
    length and depth are read whole. Of places that hold as much the inner one is the article. A null
    url has the empty host, copies and repeated page_ids are extracted row by row, extra columns are
    ignored, and an empty table gives an empty one.

    The pages of a host are one lot; those of a large host are dealt by a hash into lots of at least
    ``per_template`` pages on average, as many as its size asks for. Rows are range-partitioned and
    sorted by lot, so that no lot is cut, whatever the partitions and neighbours are, and none is a
    short rest. Of a lot larger than planned (rows of one page_id and url are dealt alike) a part is
    held at a time, and a part of few distinct pages uses the template of the one before.
    """
    schema = "page_id long, url string, text string, n_chars long, host string"
    fields = arrow_schema(schema)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for _, block, table in grouped_blocks(batches, "lot", HELD * per_template, HELD * BYTES_PER_TEMPLATE):
            texts, known = _extract(table.column("html").to_pylist(), known if block else None)
            yield arrow_batch([table.column("page_id").to_pylist(), table.column("url").to_pylist(), texts, list(map(len, texts)), table.column("host").to_pylist()], fields)

    c = F.col
    host = F.regexp_extract(F.lower(F.coalesce(c("url"), F.lit(""))), "^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    rows = pages.select(c("page_id").cast("long").alias("page_id"), c("url").cast("string").alias("url"), c("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host).withColumn("turn", F.xxhash64("page_id", "url"))
    sizes = rows.groupBy(c("host").alias("of_host")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    wanted = F.greatest(F.floor(c("n") / per_template), F.ceil(F.coalesce("bytes", F.lit(0)) / BYTES_PER_TEMPLATE))
    sizes = sizes.select("of_host", F.least(wanted, F.greatest(F.floor(c("n") / per_template), F.floor(c("n") / LEAST_LOT))).cast("long").alias("lots"))
    large = materialize(sizes.where("lots > 1"), "large-hosts")
    rows = rows.join(large, c("host") == c("of_host"), "left")
    lot = F.concat_ws(" ", "host", F.pmod("turn", F.coalesce("lots", F.lit(1))).cast("string"))
    rows = rows.withColumn("lot", lot).select("page_id", "url", "html", "host", "turn", "lot")
    return rows.repartitionByRange("lot").sortWithinPartitions("lot", "turn", "page_id").drop("turn").mapInArrow(extract, schema)
