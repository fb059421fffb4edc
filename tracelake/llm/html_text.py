"""Main text of web pages by composite text density.

Each page becomes a tree. Menus, scripts and other furniture that says what it is leaves the tree. Every node
gets characters and tags of its subtree, all and in links, and from these the link-adjusted characters per tag.
The block with the largest sum of its children's densities is the core; the smallest density on its path to the
body is the threshold. From the body down, every node of at least that density gives the part of its subtree with
the largest sum. An article element that holds the core bounds the result: parts outside it go, and its own sparse
blocks beside the dense ones (bylines, captions, short paragraphs) stay.

Parsing and selection take time in proportion to the page, whatever it nests, leaves open or never closes.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import text_of

# Fixed values of HTML: elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title template iframe svg xmp noframes select annotation annotation-xml".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SCOPES = set("article aside body div footer form header main nav section td th table blockquote html ul ol dl".split())
#: Blocks that hold other blocks: a part that is kept is one of these, not a paragraph or a run of words in it.
HOLDERS = BLOCK - HEADINGS - set("p pre dt li hr summary legend figcaption caption tr address option".split())
#: What may stand in a head; anything else ends it.
HEAD = set("base link meta noscript script style template title".split())
#: A start tag ends an open element of the same set, up to the next scope.
ENDS = {t: {"p"} for t in BLOCK} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}} | {
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}
}
FURNITURE = set("nav footer aside form button dialog menu input label head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie "
    "cookies consent gdpr notice notices notification alert newsletter subscribe subscription paywall popup modal overlay "
    "sidebar aside widget widgets related recommended recommendations share sharing social nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist teaser teasers disqus replies reply respond responses "
    "discussion login signin signup register search toolbar pagination pager copyright disclaimer skip hidden".split()
)
#: Of these, what says inside an article too that a node is none of it, unless it is a section of prose with a heading;
#: reader comments are prose, so their words decide. All other words only make a node suspect there.
SURE = set(
    "ads adsbygoogle adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted cookie cookies consent gdpr "
    "newsletter subscribe paywall popup modal overlay sidebar widget widgets navbar breadcrumb breadcrumbs topbar signin signup "
    "pagination pager".split()
)
COMMENTS = set("comment comments commentlist disqus".split())
#: Whole class or id of a node that is not shown.
HIDDEN = re.compile(r"(?:^|\s)(?:hidden|is-hidden|d-none)(?:\s|$)", re.I)
#: Suspect nodes stay with at most half of their characters in links and so many characters per tag.
PROSE = 9
#: A section with a heading is prose from so many characters on, at most a quarter of them in links.
SECTION = 200
#: What words say of a node; ``LIKELY`` ones, forms among them, are furniture unless they hold most of the page.
CLEAR, SUSPECT, DOUBTED, LIKELY, OUT = range(5)
HEADERS = {"header", "masthead"}
#: A start or end tag with quoted values; possessive, so that a tag that never ends costs one scan.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: What opens or marks an imprint, how many characters it has at most, and the whole of one: marks, years and a name.
RIGHTS, IMPRINT = re.compile(r"^\s*(?:copyright\b|\u00a9)|\ball rights reserved\b", re.I), 300
MARKS = re.compile(r"\bcopyright\b|\u00a9|\(c\)|\ball rights reserved\b|\b\d{4}\b|[\W_]+", re.I)
NAME = re.compile(r"(?:(?:[^\Wa-z]\S*|by|and|of|the|for|de|der|von) ?){0,8}")
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Page:
    """Nodes in page order, a node after its parent; text as (node, piece) with None for a break."""

    def __init__(self, source: str):
        self.tag, self.parent, self.verdict, self.within = ["html"], [-1], [CLEAR], [False]
        self.text: list[tuple[int, str | None]] = []
        #: Where the text of a node begins and ends in ``text``.
        self.begin, self.end = [0], [0]
        self.stack = [0]
        #: Open elements by tag: of each open scope, the scope itself included, and of all.
        self.scopes: list[dict[str, int]] = [{}]
        self.open: dict[str, int] = {}
        self._parse(source)
        while len(self.stack) > 1:
            self._pop()
        self.end[0] = len(self.text)

    def _parse(self, source: str) -> None:
        at, size, patience = 0, len(source), 8 * len(source)
        while at < size:
            lt = source.find("<", at)
            if lt < 0 or lt + 1 == size:
                self._say(source[at:])
                return
            if lt > at:
                self._say(source[at:lt])
            c = source[lt + 1]
            if source.startswith("<!--", lt):
                at = source.find("-->", lt + 4) + 3
                if at < 3:
                    return
                continue
            if c in "!?" or c == "/" and not source[lt + 2 : lt + 3].isalpha():
                at = source.find(">", lt + 2) + 1
                if not at:
                    return
                continue
            if not (c.isascii() and c.isalpha()) and c != "/":  # "<" that starts no tag
                self._say("<")
                at = lt + 1
                continue
            m = TAG.match(source, lt) if patience > 0 else None
            if not m:  # a quote that nothing closes, or a tag that the end of the page cuts
                patience -= size - lt
                m = LOOSE.match(source, lt)
                if not m:
                    return
            at, name, attrs = m.end(), m[1].lower(), m[2]
            if c == "/":
                self._close(name)
                continue
            raw = name in RAW or name == "noscript" and not self.within[self.stack[-1]]
            if raw and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if name in ("html", "body") and name in self.tag[:3] and (name == "html" or "body" in self.tag[:3]):
                continue
            self._start(name, attrs)

    def _say(self, piece: str) -> None:
        self.text.append((self.stack[-1], html.unescape(piece) if "&" in piece else piece))

    def _pop(self) -> str:
        node = self.stack.pop()
        name = self.tag[node]
        self.end[node] = len(self.text)
        self.open[name] -= 1
        if name in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][name] -= 1
        return name

    def _start(self, name: str, attrs: str) -> None:
        if self.tag[self.stack[-1]] == "head" and name not in HEAD:
            self._pop()
        ends, near = ENDS.get(name), self.scopes[-1]
        if ends and any(near.get(t) for t in ends):
            while self._pop() not in ends:
                pass
        node, parent = len(self.tag), self.stack[-1]
        self.tag.append(name)
        self.parent.append(parent)
        self.verdict.append(self._furniture(name, attrs, self.within[parent]))
        self.within.append(self.within[parent] or name in ("article", "main"))
        self.begin.append(len(self.text))
        if name in BLOCK or name == "br":
            self.text.append((node, None))
        self.end.append(len(self.text))
        if name not in VOID and not attrs.endswith("/"):
            self.stack.append(node)
            self.open[name] = self.open.get(name, 0) + 1
            if name in SCOPES:
                self.scopes.append({})
            self.scopes[-1][name] = self.scopes[-1].get(name, 0) + 1

    def _close(self, name: str) -> None:
        """Ends the last open element of the name; only that of a scope is looked for beyond the next scope."""
        if not (self.open if name in SCOPES else self.scopes[-1]).get(name):
            return
        while self.tag[self.stack[-1]] != name:
            self._pop()
        if name in BLOCK:
            self.text.append((self.stack[-1], None))
        self._pop()

    @staticmethod
    def _furniture(name: str, attrs: str, inside: bool) -> int:
        """What tag, class, id and role say of a node; between ``CLEAR`` and ``OUT`` the density decides."""
        if name in FURNITURE and name != "form":
            return OUT
        # An article's own header holds its title.
        if name == "header":
            return CLEAR if inside else OUT
        if not attrs or name in ("body", "html"):
            return LIKELY if name == "form" else CLEAR
        found = LIKELY if name == "form" else CLEAR
        for key, value in ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return OUT
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return OUT
            if key == "role" and value.lower() in ROLES:
                return OUT
            if key in ("class", "id"):
                words = {w.lower() for w in SPLIT.split(value)} & WORDS
                if words & COMMENTS or HIDDEN.search(value):
                    return OUT
                if words & SURE and not inside:
                    return OUT
                if words and not inside:
                    found = max(found, LIKELY)
                elif words & SURE:
                    found = max(found, DOUBTED)
                elif not words <= HEADERS and name not in HEADINGS:
                    found = max(found, SUSPECT)
        return found

    def main_text(self) -> str:
        n, tag, parent = len(self.tag), self.tag, self.parent
        own = [0] * n
        for node, piece in self.text:
            if piece:
                own[node] += len(piece) - sum(map(str.isspace, piece)) if len(piece) < 200 else len("".join(piece.split()))
        # A marked wrapper of the page's heading or article is no furniture.
        out = [v >= LIKELY for v in self.verdict]
        cores = [t in ("article", "main") and v < LIKELY for t, v in zip(tag, self.verdict)]
        cored = any(cores)
        total, holds = own[:], [t in ("main", "h1") or t == "article" and not o for t, o in zip(tag, out)]
        titled = [t in HEADINGS for t in tag]
        in_link, tags, link = [False] * n, [1] * n, [0] * n
        for k in range(1, n):
            in_link[k] = in_link[parent[k]] or tag[k] == "a"
        for k in range(n - 1, 0, -1):
            p = parent[k]
            link[k] += own[k] if in_link[k] else 0
            total[p] += total[k]
            holds[p] |= holds[k] and tag[k] not in FURNITURE
            titled[p] |= titled[k]
            cores[p] |= cores[k]
            link[p] += link[k]
            tags[p] += tags[k]
            if self.verdict[k] in (SUSPECT, DOUBTED):
                thin = tag[k] != "p" and total[k] < PROSE * tags[k]
                section = titled[k] and total[k] >= SECTION and 4 * link[k] <= total[k]
                out[k] = 2 * link[k] > total[k] or thin or self.verdict[k] == DOUBTED and not section
        gone = [False] * n
        for k in range(1, n):
            wrapper = holds[k] and tag[k] not in FURNITURE and 2 * total[k] > total[0]
            # Words alone take no text away that is most of what the page says beside its links.
            wrapper |= self.verdict[k] == LIKELY and 2 * (total[k] - link[k]) > total[0] - link[0] and (cores[k] or not cored)
            gone[k] = gone[parent[k]] or (out[k] and not wrapper)
        chars, tags, link, links = [0] * n, [0] * n, [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            if gone[k]:
                continue
            chars[k] += own[k]
            link[k] += own[k] if in_link[k] else 0
            if k:
                p = parent[k]
                chars[p] += chars[k]
                link[p] += link[k]
                tags[p] += tags[k] + 1
                links[p] += links[k] + (tag[k] == "a")
        if not chars[0]:
            return ""
        density, sums = [0.0] * n, [0.0] * n
        page = link[0] / chars[0]
        for k in range(n - 1, -1, -1):
            if gone[k] or not chars[k]:
                continue
            c, t, lc, lt = chars[k], max(1, tags[k]), max(1, link[k]), max(1, links[k])
            base = math.log(c * lc / max(1, c - link[k]) + page * c + math.e)
            density[k] = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base) if base > 1 else 0.0
            if k:
                sums[parent[k]] += density[k]
        core = max((k for k in range(n) if tag[k] in HOLDERS), key=lambda k: (sums[k], chars[k], -k))
        if not sums[core]:
            core = 0
        path = [core]
        while path[-1] > 0:
            path.append(parent[path[-1]])
        threshold = min(density[k] for k in path)
        self.density, self.sums, self.core, self.threshold = density, sums, core, threshold
        self.dense = keep = self._dense(density, sums, gone, threshold)
        # Sparse lists of links can stand in the parts kept, and outside articles the imprint.
        marks = {node for node, piece in self.text if piece and total[node] < IMPRINT and RIGHTS.search(piece)}
        for k in range(1, n):
            listed = tag[k] in BLOCK and links[k] >= 3 and 10 * link[k] >= 9 * chars[k] and density[k] < threshold
            imprint = k in marks and not self.within[k] and self._imprint(k)
            gone[k] = gone[k] or gone[parent[k]] or listed or imprint
        articles = [k for k in path if tag[k] == "article"] or [k for k in path if tag[k] == "main"]
        if articles:
            keep = {articles[-1]}
        chosen = [False] * n
        for k in range(n):
            chosen[k] = not gone[k] and (k in keep or k > 0 and chosen[parent[k]])
        pieces = [" " if piece is None else piece for node, piece in self.text if piece is None or chosen[node]]
        return " ".join("".join(pieces).split())

    def _imprint(self, k: int) -> bool:
        """Whether a node's text is nothing but an imprint."""
        pieces = [" " if piece is None else piece for _, piece in self.text[self.begin[k] : self.end[k]]]
        return NAME.fullmatch(MARKS.sub(" ", "".join(pieces)).strip()) is not None

    def _dense(self, density, sums, gone, threshold) -> set[int]:
        """Roots of the parts kept: in every dense enough subtree, from the body down, the node of the largest sum."""
        n, parent = len(self.tag), self.parent
        best, worth = list(range(n)), [x if t in HOLDERS else -1.0 for x, t in zip(sums, self.tag)]
        for k in range(n - 1, 0, -1):
            p = parent[k]
            if not gone[k] and worth[best[k]] > worth[best[p]]:
                best[p] = best[k]
        children: dict[int, list[int]] = {}
        for k in range(1, n):
            children.setdefault(parent[k], []).append(k)
        keep, todo = set(), [0]
        while todo:
            k = todo.pop()
            if gone[k] or density[k] < threshold:
                continue
            top = best[k]
            keep.add(top)
            while top != k:  # what stands beside the way to the kept part is looked at by itself
                up = parent[top]
                todo += [c for c in children[up] if c != top]
                keep |= {c for c in children[up] if self.tag[c] in HEADINGS and not gone[c]}  # a heading belongs to what it stands beside
                top = up
        return keep


def main_text(page: str) -> str:
    return Page(page).main_text()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py() or "") for x in b.column(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "main_text"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the markup, plus ``main_text`` (empty if there is none) and ``n_chars`` (code points).

    Null html counts as empty. Pages without a body, with open or crossed tags, cut in a tag or of one element give
    what text they hold. Repeated rows are rows of their own; an empty table gives none. Clashing columns of ``pages``,
    whatever their case, are replaced.
    """
    plain = [c for c in pages.columns if c != html_col and c.lower() not in ("main_text", "n_chars", "__html")]
    rows = pages.select(*plain, text_of(html_col).alias("__html"))
    schema = rows.withColumnRenamed("__html", "main_text").schema
    return rows.mapInArrow(_extract, schema).withColumn("n_chars", F.length("main_text").cast("long"))
