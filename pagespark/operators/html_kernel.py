"""K1: one HTML string -> flat node records.  Runs inside Spark tasks only.

The kernel does what SQL cannot: it keeps the stack of open elements.  It knows
nothing about selectors, page structure or summaries; those are Column
expressions over its output.  Tree rules (simplified HTML tree construction):
void tags never open; script/style are raw text, title/textarea are text;
``p``, ``li``, ``dt/dd``, table parts and ``option`` close implicitly; an end tag
pops to its nearest open match or is ignored; html/head/body are synthesized.
Every step moves forward through the text, so a hostile page costs linear time.
"""

from __future__ import annotations

import html as _html
import re

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta title script style template noscript noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
P_BARRIER = frozenset("button caption html marquee object table td template th".split())
# start tag -> (tags it closes, tags that stop the search)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
UNRENDERED = frozenset("head script style template noscript".split())
# One bit for each kind of implicit end: set in an element if one of the tags to close is open inside the barrier.
_KINDS = {"p": ({"p"}, P_BARRIER), **CLOSES}
_BIT = {kind: 1 << k for k, kind in enumerate(_KINDS)}


def _bits(tag: str) -> tuple[int, int]:
    closed = sum(_BIT[k] for k, (tags, _) in _KINDS.items() if tag in tags)
    barred = sum(_BIT[k] for k, (_, barrier) in _KINDS.items() if tag in barrier)
    return ~barred, closed


_MASKS = {t: _bits(t) for tags, barrier in _KINDS.values() for t in (*tags, *barrier)}
_NO_MASK = (~0, 0)

# White space as the DOM's trim() knows it.
JS_SPACE = "\t\n\v\f\r " + "".join(
    map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
_NON_SPACE = re.compile(f"[^{JS_SPACE}]")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*([\"'])|\s*=\s*([^\s>]*))?")
_TAG_END = re.compile(r"[\s/]*>")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Node:
    __slots__ = (
        "nid", "parent", "end", "depth", "body_depth", "child_ix", "n_children", "same_tag_ix", "tag", "attrs",
        "text_start", "text_end", "html_start", "html_end", "max_child_ix", "visible", "tag_counts",
        "links", "fields", "arias", "closable",
    )


class Document:
    """The open-element stack and the running offsets of one page."""

    def __init__(self, source: str):
        self.source = source
        self.nodes: list[Node] = []
        self.stack: list[Node] = []
        self.text: list[str] = []
        self.visible_text: list[str] = []
        self.text_lens: list[int] = []
        self.offset = 0
        self.links = self.fields = self.arias = 0
        self.open_tags: dict[str, int] = {}
        self.head = self.body = None
        self.body_end = None
        self._run: list[str] | None = None
        self.open("html", {}, 0)
        self.head = self.open("head", {}, 0)
        self._read()
        self._need_body(len(source))
        self._pop_to(0, len(source))
        self.full_text = "".join(self.text)
        if self.body_end is not None:
            self.body.html_end = self.nodes[0].html_end = self.body_end

    # -- tree -----------------------------------------------------------------
    def open(self, tag: str, attrs: dict, start: int) -> Node:
        if self._run is not None:
            self._end_run()
        n = Node()
        parent = self.stack[-1] if self.stack else None
        n.nid = n.end = len(self.nodes)
        n.tag, n.attrs, n.n_children, n.tag_counts = tag, attrs, 0, None
        n.text_start = n.text_end = self.offset
        n.html_start = n.html_end = start
        n.links, n.fields, n.arias = self.links, self.fields, self.arias
        if parent is None:
            n.parent, n.depth, n.body_depth, n.child_ix, n.max_child_ix, n.same_tag_ix = None, 0, None, 0, 0, 0
            n.visible = True
        else:
            n.parent, n.depth, n.child_ix = parent, parent.depth + 1, parent.n_children
            parent.n_children += 1
            counts = parent.tag_counts
            if counts is None:
                counts = parent.tag_counts = {}
            n.same_tag_ix = counts.get(tag, 0)
            counts[tag] = n.same_tag_ix + 1
            if parent.body_depth is not None:
                n.body_depth = parent.body_depth + 1
                n.max_child_ix = max(parent.max_child_ix, n.child_ix)
            else:
                n.body_depth = 0 if tag == "body" and n.depth == 1 else None
                n.max_child_ix = 0
            n.visible = parent.visible and tag not in UNRENDERED and not (attrs and self._hidden(tag, attrs))
        if tag == "a":
            self.links += 1
        elif tag in ("input", "select", "textarea"):
            self.fields += 1
        keep, add = _MASKS.get(tag, _NO_MASK)
        n.closable = 0 if parent is None else parent.closable & keep | add
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if attrs and "aria-expanded" in attrs:
            self.arias += 1
        self.nodes.append(n)
        self.stack.append(n)
        return n

    @staticmethod
    def _hidden(tag, attrs) -> bool:
        if not attrs:
            return False
        return (
            "hidden" in attrs
            or (tag == "input" and attrs.get("type", "").lower() == "hidden")
            or ("style" in attrs and _HIDING.search(attrs["style"]) is not None)
        )

    def _pop_to(self, depth: int, pos: int) -> None:
        """Close open elements until ``depth`` of them are left."""
        if self._run is not None:
            self._end_run()
        stack, last = self.stack, len(self.nodes) - 1
        while len(stack) > depth:
            n = stack.pop()
            tag = n.tag
            n.end, n.text_end, n.html_end, n.tag_counts = last, self.offset, pos, None
            # counters become counts of strict descendants
            n.links = self.links - n.links - (tag == "a")
            n.fields = self.fields - n.fields - (tag in ("input", "select", "textarea"))
            n.arias = self.arias - n.arias - ("aria-expanded" in n.attrs)
            self.open_tags[tag] -= 1

    def _close_nearest(self, kind: str, pos: int) -> None:
        """Close the nearest of a kind's tags; all that is looked at is closed, so the steps are paid for."""
        if self.stack[-1].closable & _BIT[kind]:
            tags, i = _KINDS[kind][0], len(self.stack) - 1
            while self.stack[i].tag not in tags:
                i -= 1
            self._pop_to(i, pos)

    def _need_body(self, pos: int, attrs: dict | None = None) -> None:
        if self.body is None:
            self._pop_to(1, pos)
            self.body = self.open("body", attrs or {}, pos)

    # -- text -----------------------------------------------------------------
    def _end_run(self) -> None:
        """A text node ends where an element or comment starts or ends."""
        if self._run is not None:
            s = "".join(self._run)
            self._run = None
            if _NON_SPACE.search(s):
                self.text_lens.append(len(s))

    def add_text(self, s: str, pos: int) -> None:
        if not s:
            return
        if self.body is None and len(self.stack) <= 2:  # directly inside html or head
            if not s.strip():
                if len(self.nodes) > 2:
                    self.text.append(s)
                    self.offset += len(s)
                return
            self._need_body(pos)
        self.text.append(s)
        self.offset += len(s)
        if self.body is not None:
            if self._run is None:
                self._run = []
            self._run.append(s)
            if self.stack[-1].visible:
                self.visible_text.append(s)
            if self.body_end is not None and s.strip():
                self.body_end = None

    # -- tokens ---------------------------------------------------------------
    def _read(self) -> None:
        src, i, size = self.source, 0, len(self.source)
        while i < size:
            lt = src.find("<", i)
            if lt < 0:
                lt = size
            if lt > i:
                s = src[i:lt]
                self.add_text(_decoded(s) if "&" in s else s, i)
            if lt >= size:
                return
            nxt = src[lt + 1 : lt + 2]
            if nxt == "/":
                i = self._end_tag(lt)
            elif nxt == "!" or nxt == "?":
                if src.startswith("<!--", lt):
                    k = src.find("-->", lt + 2)
                    i = size if k < 0 else k + 3
                else:
                    k = src.find(">", lt)
                    i = size if k < 0 else k + 1
                self._end_run()
            elif nxt.isascii() and nxt.isalpha():
                i = self._start_tag(lt)
            else:
                self.add_text("<", lt)
                i = lt + 1

    def _end_tag(self, lt: int) -> int:
        src = self.source
        gt = src.find(">", lt)
        if gt < 0:
            return len(src)
        tag = src[lt + 2 : gt]
        if not (tag.isalnum() and tag.isascii() and tag[0].isalpha()):
            m = _NAME.match(tag)
            if m is None:
                self._end_run()  # bogus comment
                return gt + 1
            tag = m.group()
        tag = tag.lower()
        if tag in ("body", "html"):
            if self.body is not None and self.body_end is None:
                self.body_end = lt
        elif tag != "head" and self.open_tags.get(tag):
            for k in range(len(self.stack) - 1, 1, -1):
                if self.stack[k].tag == tag:
                    self._pop_to(k, lt)
                    break
        return gt + 1

    def _attributes(self, pos: int):
        """-> (attrs, position after '>', self-closing), or None when the text ends inside the tag."""
        src, attrs = self.source, {}
        while True:
            m = _TAG_END.match(src, pos)
            if m:
                return attrs, m.end()
            m = _ATTR.match(src, pos)
            if m is None:
                return None
            name, quote, value = m.group(1).lower(), m.group(2), m.group(3)
            pos = m.end()
            if quote:
                k = src.find(quote, pos)
                if k < 0:
                    return None
                value, pos = src[pos:k], k + 1
            if name not in attrs:
                value = value or ""
                attrs[name] = _html.unescape(value) if "&" in value else value

    def _start_tag(self, lt: int) -> int:
        src = self.source
        gt = src.find(">", lt)
        tag = src[lt + 1 : gt] if gt > 0 else ""
        if tag.isalnum():
            tag, attrs, pos = tag.lower(), {}, gt + 1
        else:
            m = _NAME.match(src, lt + 1)
            tag, pos = m.group().lower(), m.end()
            found = self._attributes(pos)
            if found is None:
                return len(src)  # tag cut off by the end of the page
            attrs, pos = found
        if tag in ("html", "head", "body"):
            if tag == "body" and self.body is None:
                self._need_body(pos, attrs)
                return pos
            target = self.nodes[0] if tag == "html" else self.head if tag == "head" else self.body
            if not (tag == "head" and self.body is not None):
                for k, v in attrs.items():
                    target.attrs.setdefault(k, v)
                if self.body is None and target.n_children == (1 if tag == "html" else 0):
                    target.html_start = pos
                    target.visible = target.visible and not self._hidden(tag, attrs)
            return pos
        if self.body is None and len(self.stack) <= 2 and tag not in HEAD_ONLY:
            self._need_body(lt)
        self.body_end = None
        if tag in CLOSES_P:
            self._close_nearest("p", lt)
        if tag in CLOSES:
            self._close_nearest(tag, lt)
        self.open(tag, attrs, pos)
        depth = len(self.stack) - 1
        if tag in VOID:
            self._pop_to(depth, pos)
        elif tag in RAW or tag in RCDATA:
            end = _find_close(src, tag, pos)
            s = src[pos:end]
            self.add_text(_html.unescape(s) if tag in RCDATA and "&" in s else s, pos)
            self._pop_to(depth, end)
            k = src.find(">", end)
            return len(src) if k < 0 else k + 1
        return pos


def _decoded(s: str) -> str:
    """Character references decoded; the commonest one is itself a separator between the others."""
    return "&".join([_html.unescape(part) if "&" in part else part for part in s.split("&amp;")])


_CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | RCDATA}


def _find_close(src: str, tag: str, pos: int) -> int:
    m = _CLOSERS[tag].search(src, pos)
    return m.start() if m else len(src)


def chunked(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def tag_text(doc: Document, tags: frozenset[str]) -> list[str | None]:
    """Whole text of the elements with one of ``tags``."""
    return [doc.full_text[n.text_start : n.text_end] if n.tag in tags else None for n in doc.nodes]


def xpaths(nodes: list[Node]) -> list[str]:
    """id("x") at the nearest element with an id, else BODY, else the path from the root."""
    out: list[str] = []
    for n in nodes:
        element_id = n.attrs.get("id")
        if element_id:
            out.append(f'id("{element_id}")')
        elif n.body_depth == 0 or n.parent is None:
            out.append(n.tag.upper())
        else:
            out.append(f"{out[n.parent.nid]}/{n.tag.upper()}[{n.same_tag_ix + 1}]")
    return out
