"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream (tags, text slots) is read into nested groups. Streams of one host are aligned in order, one
after another, with a wrapper that begins as the first of them. Where tokens agree they are merged; a text slot is a
constant as long as all pages agree on its text. A mismatch is resolved, in this order, by

- a repeated group: what is left over is of the kind just read, or begins another round of the last few groups;
- an optional group: the token of one side stands further on in the other, so what is before it is optional;
- a slot for the name: both sides have a group of the same tag, whose names differ;
- two optional groups.

Optional groups of one kind between two others are one, so a wrapper's size is that of a page's structure, however
many pages or names a host has. No depth, number of groups or order is limited or sorted away.

What is main text comes from the wrapper: it is the text of the host's `main` groups, or else its `article` groups, or
else the whole page; less the groups whose whole text is the same wherever they are, on nine in ten of the
host's pages and three at least, while other text differs, in pages without main or article also less groups of mostly linked text; less
what the page itself declares as something else: tags of menus, footers, forms, scripts and the like, and names (class,
id) that say so and don't name content too. Where that would leave a host no group with text at all, the largest group
that only a name excludes is its main text. A page that lacks the host's region is decided by its own groups.

Wrappers are inferred map-side, then meet by host in two steps (salted by task), so what meets is one small wrapper for
each task and host, never a host's pages. They are joined to the pages by host, by a broadcast where their measured
size is below `MAX_BROADCAST` and by a join beyond it, with equal results.

Defined cases: a null or empty html has an empty text; a null url, or one without a host, belongs to the host "";
a page without tags is all main text; unclosed and unopened tags are taken as browsers commonly do; groups may nest to
any depth and pages be of any length; rows that repeat a page are extracted alike, and count as pages of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, vacated
from .common import picked as picked_
from .url_filter import split_url

#: Bytes of all wrappers that may be broadcast.
MAX_BROADCAST = 8 << 20
#: Pages on which a group's text has to be the same to be taken for boilerplate, and their share of the host's.
MIN_PAGES = 3
MIN_SHARE = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_DIGITS = re.compile(r"\d+")
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "title", "object", "canvas", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Opening one of these ends an open group of the second kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NOT_IN_P = _INLINE | {"br", "input", "button", "select", "option", "textarea", "script", "style", "noscript", "iframe", "object", "canvas", "svg", "math", "ruby", "rt", "rp", "audio", "video", "picture", "source", "map", "area", "embed", "link", "meta", "template", "title"}
_OUT_TAGS = {"head", "nav", "aside", "footer", "form", "button", "select", "option", "input", "dialog", "menu"} | _RAW
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note"}
#: Parts of names (between hyphens and the like) of groups that aren't main text, last parts of names of groups that are, and parts that deny the rest of a name.
_OUT_PARTS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail widget widgets footer foot masthead topbar toolbar comment comments disqus reply replies respond responses notice notices cookie cookies consent gdpr alert alerts popup popups modal overlay newsletter subscribe signup login share sharing social related recommended recommendations pagination pager skip search legal copyright".split())
_IN_PARTS = {"article", "post", "entry", "story", "content", "main", "body", "text", "prose"}
_NOT_PARTS = {"with", "without", "has", "no", "non", "free"}
_PARTS = re.compile(r"[^a-z]+")
#: Groups that hold blocks; other groups are blocks of text themselves.
_HOLDERS = {"div", "section", "ul", "ol", "dl", "table", "center", "details", "fieldset", "figure", "header", "hgroup"}


class Node:
    """A group of a page: its kind (tag, or role), names, whether it is declared as something else or as content, and its texts and groups in order."""

    __slots__ = ("tag", "names", "out", "hard", "content", "items", "inline", "item", "hash", "size", "linked")

    def __init__(self, tag: str, names: frozenset = frozenset(), out: bool = False, hard: bool = False, content: bool = False):
        self.tag, self.names, self.out, self.hard, self.content = tag, names, out, hard, content
        self.items: list[Node | str] = []


def named(names: str) -> tuple[bool, bool, bool]:
    """Whether names (class and id) say something else than main text, main text, and a header."""
    out = content = header = False
    for name in names.split():
        parts = [x for x in _PARTS.split(name) if x]
        if not _NOT_PARTS.isdisjoint(parts):
            continue
        if not _OUT_PARTS.isdisjoint(parts):
            out = True
        elif "header" in parts:
            header = header or _IN_PARTS.isdisjoint(parts)
        elif parts and parts[-1] in _IN_PARTS:
            content = True
    return out and not content, content, header and not content


def _node(tag: str, attributes: str, stack: list[Node]) -> Node:
    own = {}
    if attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            own.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4])
    role = own.get("role", "").lower()
    kind = role if role in ("main", "article") else tag
    hard = tag in _OUT_TAGS or role in _OUT_ROLES or own.get("aria-hidden", "") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
    names = " ".join(own[k] for k in ("class", "id") if k in own).lower()
    out, content, header = named(names) if names and tag not in ("html", "body", "main", "article") else (False, False, False)
    if (header or tag == "header") and not content and not any(n.tag in ("main", "article") or n.content for n in stack):
        hard, out = hard or tag == "header", True
    return Node(kind, frozenset(_DIGITS.sub("0", names).split()), out or hard, hard, content)


def parse(page: str) -> Node:
    root = Node("")
    stack, tags, end, raw = [root], [""], 0, None
    opened: Counter[str] = Counter()

    def cut_at(i: int) -> None:
        opened.subtract(tags[i:])
        del stack[i:], tags[i:]

    for m in _TOKEN.finditer(page):
        if raw is not None and not (m[1] and m[2].lower() == raw):
            continue
        if raw is None and m.start() > end:
            stack[-1].items.append(page[end : m.start()])
        end = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            raw = None
            if opened[tag] > 0:
                cut_at(next(i for i in range(len(stack) - 1, 0, -1) if tags[i] == tag))
            continue
        if opened["p"] > 0 and tag not in _NOT_IN_P:
            cut_at(next(i for i in range(len(stack) - 1, 0, -1) if tags[i] == "p"))
        elif tag in _ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if tags[i] in _SCOPE[tag]:
                    break
                if tags[i] in _ENDS[tag]:
                    cut_at(i)
        node = _node(tag, m[3], stack)
        stack[-1].items.append(node)
        if tag in _RAW and not m[0].endswith("/>"):
            raw = tag
        if tag not in _VOID and not m[0].endswith("/>"):
            stack.append(node)
            tags.append(tag)
            opened[tag] += 1
    if raw is None and end < len(page):
        stack[-1].items.append(page[end:])
    return root


SLOT, ROUND = "#", "()"
#: What the wrapper says of a group: not main text, on the way to main text, main text.
DROP, PATH, KEEP = range(3)


class Item:
    """A group or slot of a wrapper. free, linked: its characters of text outside and inside of links, without groups
    declared as something else; same: a hash of all its text, 0 where pages differ. flow: the page's own order, for a
    page's items only."""

    __slots__ = ("tag", "names", "out", "hard", "content", "rep", "opt", "pages", "free", "linked", "same", "items", "mark", "flow")

    def __init__(self, tag, names=frozenset(), out=False, hard=False, content=False, rep=False, opt=False, pages=1, free=0, linked=0, same=0, items=None):
        self.tag, self.names, self.out, self.hard, self.content, self.rep, self.opt = tag, names, out, hard, content, rep, opt
        self.pages, self.free, self.linked, self.same = pages, free, linked, same
        self.items: list[Item] = items if items is not None else []
        self.mark, self.flow = KEEP, None

    @property
    def coarse(self) -> tuple:
        return self.items[0].coarse if self.tag == ROUND else (self.tag, self.out, self.content)

    @property
    def key(self) -> tuple:
        return self.items[0].key if self.tag == ROUND else (self.tag, self.out, self.content, self.names)


def _crc(x) -> int:
    return zlib.crc32(repr(x).encode("utf-8", "surrogatepass")) or 1


def wrap(root: Node) -> Item:
    """The wrapper of one page: its groups and slots as they stand."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [x for x in n.items if not isinstance(x, str)]
    for n in reversed(order):  # groups before those that hold them
        hashes, n.size, n.linked, n.inline = [], 0, 0, n.tag in _INLINE or n.tag == "br"
        item, run = Item(n.tag, n.names, n.out, n.hard, n.content), []
        item.flow = []

        def close(item=item, run=run):
            if not run:
                return
            own = [x.strip() if isinstance(x, str) else x.hash for x in run]
            size = sum(len(x.strip()) if isinstance(x, str) else x.size for x in run)
            linked = sum(x.linked for x in run if not isinstance(x, str))
            slot = Item(SLOT, same=_crc([x for x in own if x]), free=size - linked, linked=linked)
            slot.flow = list(run)
            item.flow.append(slot)
            if size:
                item.items.append(slot)
            run.clear()

        for x in n.items:
            if isinstance(x, str):
                hashes.append(x.strip())
                n.size += len(x.strip())
                run.append(x)
            else:
                hashes.append(x.hash)
                if not x.out:
                    n.size += x.size
                    n.linked += x.linked
                n.inline = n.inline and x.inline
                if x.inline and not x.out:
                    run.append(x)
                else:
                    close()
                    item.flow.append(x.item)
                    item.items.append(x.item)
        close()
        if n.tag == "a":
            n.linked = n.size
        n.hash = _crc([x for x in hashes if x]) if n.size or any(hashes) else 0
        item.same, item.free, item.linked = n.hash or 1, n.size - n.linked, n.linked
        n.item = item
    return root.item


class Aligner:
    """Merges wrappers, or finds for the groups of a page the wrapper's (`learn` false; then wrappers stay as they are)."""

    def __init__(self, learn: bool):
        self.learn = learn
        self.todo: list[tuple] = []

    def join(self, a: Item | None, b: Item, again: bool = False) -> None:
        """a and b stand at one place; again: as a further round of what the same pages have already."""
        self.todo.append((a, b, again))

    def optional(self, out: list[Item], item: Item, again: bool) -> None:
        """An item that the other side lacks. One of its kind among the optional ones just before takes it in."""
        if not self.learn:
            self.join(None, item)
            return
        item.opt = True
        for own in reversed(out):
            if not own.opt:
                break
            if own.tag != ROUND and item.tag != ROUND and own.coarse == item.coarse:
                self.join(own, item, again)
                return
        out.append(item)

    def round(self, group: Item, seq: list[Item], at: int, again: bool) -> int:
        """Takes one round of a repeated sequence from seq, whose item at `at` is of its first kind; the place after it."""
        for own in group.items:
            first = True
            while at < len(seq) and seq[at].tag != ROUND and seq[at].key == own.key and (first or own is not group.items[0]):
                self.join(own, seq[at], again or not first)
                if self.learn and not first:
                    own.rep = True
                at, first = at + 1, False
            if first and self.learn:
                own.opt = True
        return at

    def more(self, out: list[Item], seq: list[Item], at: int) -> int:
        """Takes items that repeat what was read last; the place after them, which is `at` where none does."""
        if not out:
            return at
        last, item = out[-1], seq[at]
        if last.key == item.key:
            if last.tag == ROUND and item.tag != ROUND:
                return self.round(last, seq, at, True)
            if last.tag == item.tag:
                if self.learn:
                    last.rep = True
                self.join(last, item, True)
                return at + 1
        if not self.learn or item.tag == ROUND:
            return at
        begin = next((i for i in range(len(out) - 1, -1, -1) if out[i].key == item.key), None)
        if begin is None or any(x.tag == ROUND for x in out[begin:]):
            return at
        ahead, k = at, begin
        while k < len(out) and ahead < len(seq) and seq[ahead].tag != ROUND and seq[ahead].key == out[k].key:
            kind = out[k].key
            while ahead < len(seq) and seq[ahead].tag != ROUND and seq[ahead].key == kind:
                ahead += 1
            while k < len(out) and out[k].key == kind:
                k += 1
        if k < len(out):
            return at
        parts: list[Item] = []
        for x in out[begin:]:
            if parts and parts[-1].key == x.key:
                parts[-1].rep = True
                self.join(parts[-1], x, True)
            else:
                parts.append(x)
        out[begin:] = [Item(ROUND, rep=True, pages=parts[0].pages, items=parts)]
        return self.round(out[-1], seq, at, True)

    def merged(self, x: list[Item], y: list[Item], again: bool) -> list[Item]:
        """Two sequences as one, in order."""
        places: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        for own, seq in zip(places, (x, y), strict=True):
            for k, item in enumerate(seq):
                own[item.key].append(k)

        def ahead(side: int, key: tuple, at: int) -> int | None:
            own = places[side].get(key, ())
            k = bisect_left(own, at)
            return own[k] - at if k < len(own) else None

        out: list[Item] = []
        i = j = 0
        while i < len(x) and j < len(y):
            a, b = x[i], y[j]
            if a.key == b.key:
                if a.tag == ROUND and b.tag != ROUND:
                    out.append(a)
                    j = self.round(a, y, j, again)
                    i += 1
                elif b.tag == ROUND and a.tag != ROUND:
                    out.append(b if self.learn else a)
                    i = self.round(b, x, i, again) if self.learn else i + 1
                    j += 1
                else:
                    out.append(a)
                    self.join(a, b, again)
                    i, j = i + 1, j + 1
                continue
            if (k := self.more(out, y, j)) > j:
                j = k
                continue
            if self.learn and (k := self.more(out, x, i)) > i:
                i = k
                continue
            in_x, in_y = ahead(0, b.key, i), ahead(1, a.key, j)
            if in_x is not None and (in_y is None or in_x <= in_y):
                if self.learn:
                    a.opt = True
                    out.append(a)
                i += 1
            elif in_y is not None:
                self.optional(out, b, again)
                j += 1
            elif a.coarse == b.coarse and ROUND not in (a.tag, b.tag):
                out.append(a)
                self.join(a, b, again)
                i, j = i + 1, j + 1
            else:
                if self.learn:
                    a.opt = True
                    out.append(a)
                i += 1
                self.optional(out, b, again)
                j += 1
        while i < len(x) and self.learn:
            if (k := self.more(out, x, i)) > i:
                i = k
            else:
                x[i].opt = True
                out.append(x[i])
                i += 1
        while j < len(y):
            if (k := self.more(out, y, j)) > j:
                j = k
            else:
                self.optional(out, y[j], again)
                j += 1
        return out

    def run(self) -> None:
        """Wrappers: merges all that stands at one place."""
        while self.todo:
            a, b, again = self.todo.pop()
            a.free += b.free
            a.linked += b.linked
            a.rep |= b.rep
            a.opt |= b.opt
            a.names &= b.names
            a.same = a.same if a.same == b.same and not again else 0
            if not again:
                a.pages += b.pages
            a.items = self.merged(a.items, b.items, again)


def align(a: Item, b: Item) -> Item:
    """Merges wrapper b into a; b is used up."""
    own = Aligner(True)
    own.join(a, b)
    own.run()
    return a


def expression(w: Item) -> str:
    """The wrapper as a regular expression over tokens: #TEXT for slots, #SAME for texts that all pages have."""
    if w.tag == SLOT:
        own = "#SAME" if w.same else "#TEXT"
    else:
        inner = " ".join(map(expression, w.items))
        own = inner if w.tag in ("", ROUND) else f"<{'.'.join([w.tag, *sorted(w.names)])}>{inner}</>"
    return f"({own})" + ("*" if w.rep and w.opt else "+" if w.rep else "?") if w.rep or w.opt else own


def flat(w: Item) -> str:
    """A wrapper as JSON: its items in order, each with the number of items in it."""
    rows, todo = [], [w]
    while todo:
        x = todo.pop()
        rows.append([x.tag, sorted(x.names), x.out | x.hard << 1 | x.content << 2 | x.rep << 3 | x.opt << 4, x.pages, x.free, x.linked, x.same, len(x.items)])
        todo += reversed(x.items)
    return json.dumps(rows, separators=(",", ":"))


def unflat(text: str) -> Item:
    root, open_ = Item(""), []
    open_ = [(root, 1)]
    for tag, names, bits, pages, free, linked, same, n in json.loads(text):
        own = Item(tag, frozenset(names), *(bool(bits >> i & 1) for i in range(5)), pages, free, linked, same)
        above, left = open_.pop()
        above.items.append(own)
        if left > 1:
            open_.append((above, left - 1))
        if n:
            open_.append((own, n))
    return root.items[0]


def _all(w: Item, into=lambda x: True) -> Iterator[Item]:
    """w and what is below it, as far as `into` holds, in order."""
    todo = [w]
    while todo:
        x = todo.pop()
        yield x
        if into(x):
            todo += reversed(x.items)


def decide(w: Item) -> Item:
    """Marks a wrapper's items."""
    for x in _all(w):
        x.mark = DROP
    inside = lambda x: not x.out
    for kind in ("main", "article"):
        regions = [x for x in _all(w, lambda x: not x.out and x.tag != kind) if x.tag == kind and not x.out]
        if regions:
            break
    explicit = bool(regions)
    regions = [x for x in regions if x.free] or regions or [w]
    varies = any(x.tag == SLOT and not x.same and x.free for r in regions for x in _all(r, inside))

    def boilerplate(x: Item, above: Item) -> bool:
        if x.tag == SLOT:
            return False
        constant = varies and x.same and x.pages >= max(MIN_PAGES, MIN_SHARE * w.pages) and x.free + x.linked
        if x.tag in _HOLDERS:
            return bool(constant or not explicit and 2 * x.linked > x.free + x.linked)
        return bool(constant and not explicit and above.tag in ("", "body"))

    def keep(boiler: bool) -> int:
        todo, free = [(r, r) for r in regions], 0
        while todo:
            x, above = todo.pop()
            x.mark = DROP if x not in regions and (x.out or boiler and boilerplate(x, above)) else KEEP
            if x.mark == KEEP:
                free += (x.free + x.linked) * (x.tag == SLOT)
                todo += [(y, x if x.tag != ROUND else above) for y in x.items]
            else:
                for y in _all(x):
                    y.mark = DROP
        return free

    if not keep(True) and not keep(False) and not explicit:
        soft = [x for x in _all(w, lambda x: not x.hard) if x.out and not x.hard]
        best = max(soft, key=lambda x: sum(y.free for y in _all(x, lambda y: not y.hard) if y.tag == SLOT), default=None)
        if best is not None:
            regions = [best]
            keep(True)
    # What leads to a region is a path, so that pages are followed into it.
    ways, todo = {}, [(w, None)]
    while todo:
        x, above = todo.pop()
        ways[id(x)] = above
        todo += [(y, x) for y in x.items]
    for r in regions:
        x = ways[id(r)]
        while x is not None:
            x.mark = max(x.mark, PATH)
            x = ways[id(x)]
    return w


def _text(page: Item) -> str:
    """The text of a page's items that are kept, its blocks joined by blanks."""
    out: list[str] = []
    todo: list = [page]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(html.unescape(x) if x != " " else x)
        elif isinstance(x, Node):
            space = " " * (x.tag not in _INLINE)
            todo += [space, *reversed(x.items), space]
        elif x.tag == SLOT:
            if x.mark == KEEP:
                todo += reversed(x.flow)
        elif x.mark != DROP:
            space = " " * (x.tag not in _INLINE)
            todo += [space, *reversed(x.flow), space]
    return " ".join("".join(out).split())


def main_text(page: str | None, wrapper: Item | None) -> str:
    """A page's main text; wrapper: its host's, with its marks."""
    if not page:
        return ""
    own = wrap(parse(page))
    if wrapper is None:
        return _text(decide(own))
    for x in _all(own):
        x.mark = DROP
    found = own.mark = wrapper.mark
    finder, todo = Aligner(False), [(wrapper, own)]
    while todo:
        w, y = todo.pop()
        if w is None:
            children = [(None, x) for x in y.items]
        else:
            finder.todo = []
            finder.merged(w.items, y.items, False)
            children = [(a, b) for a, b, _ in finder.todo]
        for a, b in children:
            if a is not None:
                b.mark = a.mark
            elif b.out or y.mark == KEEP or b.tag == SLOT:
                b.mark = DROP if b.out else y.mark
            else:
                b.mark = KEEP if b.tag in ("main", "article") else PATH
            b.mark = DROP if b.mark == PATH and b.tag == SLOT else b.mark
            found = max(found, b.mark)
            if b.mark != DROP:
                todo.append((a, b))
    if found != KEEP:
        decide(own)  # a page that lacks its host's region
    return _text(own)


def _packed(rows: list[tuple[str, Item, int]]) -> pa.RecordBatch:
    h, w, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array([flat(x) for x in w], pa.string()), pa.array(s, pa.int32())], ["host", "wrapper", "salt"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: one for each host, of all its pages (url, html)."""
    schema = "host string, wrapper string, salt int"

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacated()
        found: dict[str, Item] = {}
        salt = TaskContext.get().partitionId() % 64
        for b in batches:
            for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                host, w = split_url(url)[0], wrap(parse(page or ""))
                for x in _all(w):
                    x.flow = None  # the page's texts aren't kept
                found[host] = align(found[host], w) if host in found else w
            if len(found) > 2000:  # many hosts in a task: hand over what there is
                yield _packed([(h, w, salt) for h, w in found.items()])
                found = {}
        yield _packed([(h, w, salt) for h, w in found.items()])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        own = None
        for x in sorted(t.column("wrapper").to_pylist()):
            own = unflat(x) if own is None else align(own, unflat(x))
        return pa.Table.from_batches([_packed([(t.column("host")[0].as_py(), own, 0)])])

    first = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(infer, schema)
    return first.groupBy("host", "salt").applyInArrow(merge, schema).groupBy("host").applyInArrow(merge, schema).select("host", "wrapper")


class _Hosts(dict):
    """Marked wrappers of the hosts seen last, by their JSON."""

    def __missing__(self, text: str | None) -> Item | None:
        if len(self) > 500:
            self.clear()
        self[text] = w = decide(unflat(text)) if text else None
        return w


def extract(pages: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html)."""
    picked = picked_(pages, page_id="bigint", url="string", html="string")
    found = cut(wrappers(picked))
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    host = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacated()
        known = _Hosts()
        for b in batches:
            texts = [main_text(p, known[w]) for p, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    small = F.broadcast(found) if size <= max_broadcast else found
    joined = picked.withColumn("own", lower).join(small, F.col("own") == F.col("host"), "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(rows, "page_id bigint, url string, text string")


def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))
