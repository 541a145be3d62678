"""Main text of web pages by consensus host paths.

Every page proposes the path of its best container: the innermost one that holds
all text outside links, menus and other side matter (of the article or main
elements if there are any); the document itself counts as one.  Paths are
generalised (digits in class names become ``*``), hosts count the votes in Spark,
and all pages of a host are extracted again at the winning path.  A page on which
that path leaves out text of its own best container uses the latter.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.llm.common import broadcast_checked
from aspectra.llm.url_templates import host_and_path
from aspectra.session import cut_lineage

# FIXED VALUES: element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
SIDE = frozenset("nav header footer aside form script style textarea title noscript iframe template svg button select "
                 "option dialog menu head object canvas audio video label fieldset".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 "
                  "h6 hr li main ol p pre section summary table tbody td tfoot th thead tr ul html".split())
CONTAINER = frozenset("article body div main section td".split())
# FIXED VALUES: parts of class names and ids that mark side matter.
SIDE_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion sidebar menu nav navbar navigation "
                       "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices banner newsletter subscribe subscription "
                       "signup login share sharing social comment comments reply replies respond disqus related recommended "
                       "footer masthead popup modal overlay toolbar widget search pagination pager skip".split())
# FIXED VALUES: words that make a class name or id tell a state, not a role (with-sidebar, menu-open).
STATE_WORDS = frozenset("with without has have no not is open opened close closed active enabled disabled show shown hide layout".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ODD_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")           # a quote that is never closed
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_BREAKS = BLOCK | frozenset("nav header footer aside form dialog menu head".split())      # what ends a block of text
_PEERS = {"li": ("li",), "option": ("option",), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "figcaption"}


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]))
    return found


def _is_side(name: str, attributes: dict[str, str], raw: str, in_article: bool) -> int:
    """0: shown, 1: side matter, 2: side matter unless it turns out to hold the page."""
    if name == "form":
        return 2
    if name in SIDE and not (name == "header" and in_article):
        return 1
    if not raw.strip() or name in ("body", "html", "article", "main"):
        return 0
    if (attributes.get("role", "").lower() in SIDE_ROLES or attributes.get("aria-hidden", "").lower() == "true"
            or re.search(r"display\s*:\s*none", attributes.get("style", "").lower())
            or re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", _QUOTED.sub("''", raw.lower()))):
        return 1
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = re.split(r"[^a-z]+", token)
        if not SIDE_WORDS.isdisjoint(words) and STATE_WORDS.isdisjoint(words):
            return 2
    return 0


class Page:
    """One page: the blocks of text outside side matter, each with the innermost
    container around it.  Containers of one generalised path are one node of a tree.

    Forms that hold a first-level heading are the page itself, not side matter.  Where
    nothing else holds text, so is the form or the element with a side-matter name
    that holds most of it (a page inside one form, a wrapper named after its menu).
    Time and memory grow with the page, however deep it is."""

    def __init__(self, source: str):
        self._read(source, frozenset())
        opened = frozenset(self.titled)
        if opened:
            self._read(source, opened)
        if not self.blocks and self.outer:
            again = opened | {max(self.outer, key=lambda x: (x[1], -x[0]))[0]}
            most = opened | {at for at, chars in self.held_back if 2 * chars > self.withheld}
            self._read(source, again)
            if not self.blocks:
                self._read(source, again | most)

    def _read(self, source: str, opened: frozenset) -> None:
        self.blocks: list[tuple[str, int, int]] = []                    # text, node of the container, characters in links
        self.labels, self.parent = [""], [-1]                           # of each node; 0 is the document
        self.titled: list[int] = []                                     # forms with a heading: places of their tags
        self.outer: list[tuple[int, int]] = []                          # side matter of kind 2 not inside other: place, characters
        self.held_back: list[tuple[int, int]] = []                      # all side matter of kind 2
        self.withheld = 0                                               # characters held back by kind 2 alone
        nodes: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, int, int, int]] = []                # name, kind of side matter, node, place, withheld before
        count: dict[str, int] = {}                                      # open elements by name
        text: list[str] = []
        linked, side, hard, in_link, at = 0, 0, 0, 0, 0

        def close_block():
            nonlocal linked
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                self.blocks.append((words, stack[-1][2] if stack else 0, linked))
            text.clear()
            linked = 0

        def drop(k):
            nonlocal side, hard, in_link
            name, kind, _, place, before = stack.pop(k)
            count[name] -= 1
            side -= kind > 0
            hard -= kind == 1
            in_link -= name == "a"
            if kind == 2:
                self.held_back.append((place, self.withheld - before))
                if not side:
                    self.outer.append(self.held_back[-1])

        def pop():
            if stack[-1][0] in _BREAKS:
                close_block()
            drop(-1)

        def close_to(names, stop):
            """Ends the innermost of these elements unless one of ``stop`` is inside."""
            if any(count.get(n) for n in names):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in names:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in stop:
                        break

        while at < len(source):
            lt = source.find("<", at)
            piece = source[at:] if lt < 0 else source[at:lt]
            if piece and not side:
                text.append(piece)
                linked += len(piece.strip()) if in_link else 0
            elif piece and not hard:
                self.withheld += len(piece.strip())
            if lt < 0:
                break
            m = _TAG.match(source, lt) or _ODD_TAG.match(source, lt)
            if m is None:
                if not side:
                    text.append("<")
                at = lt + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if count.get(name):
                    # an end tag of an inline element does not reach across a block
                    if name not in BLOCK and name not in SIDE:
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] == name:
                                drop(k)
                                break
                            if stack[k][0] in BLOCK:
                                break
                    else:
                        while stack[-1][0] != name:
                            pop()
                        pop()
                continue
            if name == "br" or name == "hr":
                text.append(" ")
                if name == "hr":
                    close_block()
                continue
            if name in VOID:
                continue
            raw = m[3]
            attributes = _attributes(raw) if "=" in raw else {}
            if name in ("article", "main") and side:
                # side matter that was never closed does not swallow the article
                while side:
                    pop()
            if name in _CLOSES_P:
                close_to(("p",), BLOCK)
            if name in _PEERS:
                close_to(_PEERS[name], ("ul", "ol", "dl", "table", "tr", "select", "menu"))
            if name in RAW:
                end = re.compile(rf"</{name}\s*(?:>|/|\Z)", re.I).search(source, at)
                at = len(source) if end is None else source.find(">", end.start()) + 1 or len(source)
                continue
            if raw.endswith("/") and name in ("svg", "path", "use"):
                continue
            kind = 0 if lt in opened else _is_side(name, attributes, raw, bool(count.get("article") or count.get("main")))
            if name == "h1" and count.get("form") and not hard:
                self.titled += [s[3] for s in stack if s[0] == "form" and s[1]]
            if name in _BREAKS:
                close_block()
            node = stack[-1][2] if stack else 0
            if name in CONTAINER and not side and not kind:
                classes = re.sub(r"\d+", "*", attributes.get("class", "")).replace("/", "|").split()
                label = ".".join([name, *sorted(classes)])
                key = node, label
                if key not in nodes:
                    nodes[key] = len(self.labels)
                    self.labels.append(label)
                    self.parent.append(node)
                node = nodes[key]
            stack.append((name, kind, node, lt, self.withheld))
            count[name] = count.get(name, 0) + 1
            side += kind > 0
            hard += kind == 1
            in_link += name == "a"
        while stack:
            pop()
        close_block()

    def _inside(self, chosen) -> list[bool]:
        """For each node whether it is chosen or lies inside a chosen one."""
        out: list[bool] = []
        for n, up in enumerate(self.parent):
            out.append(bool(chosen(n)) or (up >= 0 and out[up]))
        return out

    def _path(self, node: int) -> str:
        labels = []
        while node > 0:
            labels.append(self.labels[node])
            node = self.parent[node]
        return "/".join(labels[::-1])

    def _node(self, path: str) -> int | None:
        below = {(up, label): n for n, (up, label) in enumerate(zip(self.parent, self.labels, strict=True))}
        node: int | None = 0
        for label in path.split("/") if path else ():
            node = below.get((node, label))
            if node is None:
                return None
        return node

    def _own(self) -> int:
        """The innermost node that holds all text outside links (that of the article and
        main elements, if there is any)."""
        named = self._inside(lambda n: self.labels[n].split(".")[0] in ("article", "main"))
        prose = [node for words, node, links in self.blocks if len(words) > 2 * links]
        need = [n for n in prose if named[n]] or prose
        below = [0] * len(self.parent)
        for n in need:
            below[n] += 1
        for n in range(len(below) - 1, 0, -1):
            below[self.parent[n]] += below[n]
        return max(n for n, x in enumerate(below) if x == len(need)) if need else 0

    def best(self) -> tuple[str, int] | None:
        """Path of the page's own best container, and its characters of prose."""
        if not self.blocks:
            return None
        own = self._own()
        inside = self._inside(lambda n: n == own)
        return self._path(own), sum(len(w) - 2 * links for w, n, links in self.blocks if inside[n] and len(w) > 2 * links)

    def extract(self, path: str | None) -> str:
        """Blocks inside the elements at the path, or inside the best container if the
        path leaves out text of it."""
        if not self.blocks:
            return ""
        own, at = self._own(), None if path is None else self._node(path)
        prose = any(len(w) > 2 * links for w, _, links in self.blocks)
        if at is None or (prose and not self._inside(lambda n: n == at)[own]):
            at = own
        inside = self._inside(lambda n: n == at)
        return "\n".join(words for words, node, _ in self.blocks if inside[node])


def _votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): characters behind each proposed path, added up per batch."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            votes: dict = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                own = Page(source or "").best()
                if own and own[1]:
                    votes[host, own[0]] = votes.get((host, own[0]), 0) + own[1]
            if votes:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes]), pa.array([k[1] for k in votes]),
                                                  pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"])

    return (pages.select("host", "html").mapInArrow(run, "host string, path string, votes long")
            .groupBy("host", "path").agg(F.sum("votes").alias("votes")))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, path (the host's).

    A null or empty page has the text ''.  Pages with a null URL share the host
    ''.  Ties between a host's paths go to the smallest path.  Repeated rows
    give equal rows; other columns are ignored; an empty table gives none.  Very
    long or deeply nested pages are read whole, in memory that grows with the page."""
    host, _ = host_and_path("url")
    rows = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
            .withColumn("host", host))
    best = _votes(rows).groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("m")).select("host", "m.path")
    rows = rows.join(broadcast_checked(cut_lineage(best)), "host", "left").drop("host")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = [Page(s or "").extract(p) for s, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64()), b.column("path")],
                                             names=["page_id", "url", "text", "n_chars", "path"])

    schema = (T.StructType([T.StructField("page_id", rows.schema["page_id"].dataType)]).add("url", "string").add("text", "string")
              .add("n_chars", "long").add("path", "string"))
    return rows.select("page_id", "url", "html", "path").mapInArrow(run, schema)
