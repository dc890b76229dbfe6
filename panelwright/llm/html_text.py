"""Main text of web pages: page-wise container scores, a vote on paths per host, extraction by path."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import small_side
from panelwright.session import materialise

#: Containers that a page votes for at most; each page's votes add up to 1.
VOTES = 5

#: A host's path gives way to a page's own container that holds more than so many times its words.
OWN_LEAD = 3
#: Share of the words from which something out by a composed name, or a form, with a title in it is the article's frame.
FRAME = 0.75

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_TO_END = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+(?:=\s*+(?:\"([^\"]*+)(?:\"|$)|'([^']*+)(?:'|$)|([^\s\"'>]++)))?")

# Fixed lists: elements without an end, elements that end a line of text, elements that never
# belong to an article, and names of classes, ids and roles that do not.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
_ROOM = frozenset("article body center details div fieldset html main section table tbody td th tr ul ol dl blockquote".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object noembed noframes xmp".split())
_OUT = frozenset("aside button canvas dialog footer header head input label map menu nav optgroup option select".split()) | _RAW
_NEVER_OUT = frozenset("html body article main".split())
_OUT_WORDS = frozenset(
    "ad advert advertisement advertising adsense alert banner breadcrumb comment commentlist complementary consent contentinfo "
    "cookie disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification outbrain pager "
    "pagination popup promo promotion recommended recommendation related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
# Words that say where or how, not what: a name of these and at least one of the former is out too.
_BESIDE_WORDS = frozenset(
    "area article bar block blog body bottom box button center col column container content desktop entry fixed form global group "
    "icon id inner item js left link list main mobile module outer overlay page panel post posts primary region right row secondary "
    "section site slot sticky text title top unit wrap wrapper zone".split()
)
_TITLED = frozenset("article entry post".split())
_READERS = frozenset("comment commentlist disqus replies reply respond".split())
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_GOOD_NAME = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
_SELF_CLOSING = frozenset("li dt dd tr td th option p".split())
_CELLS = frozenset("tr td th".split())
_LIST_OR_TABLE = frozenset("table tbody td th tr ul ol dl blockquote".split())


def _word(part: str, words: frozenset[str]) -> bool:
    return part in words or (part.endswith("s") and part[:-1] in words)


def _out_name(name: str) -> int:
    """2 if the whole name says that an element is no part of an article, 1 if all its parts together do, else 0."""
    if _word(name.lower(), _OUT_WORDS):
        return 2
    parts = [p for p in (p.lower().rstrip("0123456789") for p in _PART.split(name)) if p]
    out = [p for p in parts if _word(p, _OUT_WORDS)]
    if not out or not all(_word(p, _OUT_WORDS) or _word(p, _BESIDE_WORDS) for p in parts):
        return 0
    if out == ["header"] and any(p in _TITLED for p in parts):
        return 0  # it holds the title
    return 2 if parts == out or any(_word(p, _READERS) for p in out) else 1


class Page:
    """Elements of one page and its texts, read in one pass; all work is linear in the page's length.

    Per element: parent, number of its path, room around it, whether it is out for good, and the
    closest element around it that is out by a composed name (0: none). ``texts``: (element, block,
    text, in a link, words).
    """

    def __init__(self, source: str):
        self.parent, self.path, self.room, self.out, self.doubt = [-1], [0], [0], [False], [0]
        self.texts: list[tuple[int, int, str, bool, int]] = []
        # Paths are numbered: (number of the path around, label) to number.
        self.paths: dict[tuple[int, str], int] = {}
        self.labels: list[tuple[int, str]] = [(-1, "")]
        self.titled: set[int] = set()
        self._stack: list[tuple[str, int]] = []
        # Places of open elements in the stack by name, and numbers of those of lines since the last room began.
        self._open: dict[str, list[int]] = {}
        self._open_here: list[dict[str, int]] = [{}]
        self._read(source)
        self._settle()

    def _read(self, source: str):
        at, block, links, end = 0, 0, 0, len(source)
        last, quotes = source.rfind(">"), True
        begun = 0
        while True:
            at = source.find("<", at)
            if at < 0 or at > last:
                comment = source.find("<!--", begun)
                self._text(source[begun : comment if comment >= 0 else end], block, links)
                return
            closing = source.startswith("/", at + 1)
            named = _NAME.match(source, at + 1)
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                stop = end if stop < 0 else stop + 3
            elif named or source[at + 1 : at + 2] in ("!", "?", "/"):
                found = _TO_END.match(source, named.end() if named else at + 1) if quotes else None
                # Quotes that do not end: from here on a tag ends at the next sign.
                quotes = quotes and found is not None
                stop = found.end() if found else source.find(">", at) + 1
            else:
                at += 1
                continue
            self._text(source[begun:at], block, links)
            rest = source[named.end() : stop - 1] if named else ""
            at = begun = stop
            name = named[1].lower() if named else ""
            if not name:
                continue
            block += name in _BLOCK
            if closing:
                links -= self._close(name)
                continue
            if name == "br":
                self._text(" ", block, 0)
            if name in _VOID:
                continue
            if name in _BLOCK:
                links -= self._close("p")
            if name in _SELF_CLOSING and not (name in _CELLS and self._in_new_table(name)):
                links -= self._close(name)
            node = self._element(name, rest)
            if name in _RAW:
                ends = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = begun = ends.end() if ends else end
            elif not rest.endswith("/") or name in _ROOM:
                self._open.setdefault(name, []).append(len(self._stack))
                self._stack.append((name, node))
                if name in _ROOM:
                    self._open_here.append({})
                else:
                    self._open_here[-1][name] = self._open_here[-1].get(name, 0) + 1
                links += name == "a"

    def _text(self, text: str, block: int, links: int):
        if text:
            self.texts.append((self._stack[-1][1] if self._stack else 0, block, text, links > 0, len(text.split())))

    def _in_new_table(self, name: str) -> bool:
        tables, cells = self._open.get("table"), self._open.get(name)
        return bool(tables and cells and tables[-1] > cells[-1])

    def _close(self, name: str) -> int:
        """Close the innermost open element of this name; returns the number of links it ends.

        Elements of lines do not reach beyond the room that they stand in.
        """
        far = name in _ROOM or name in _OUT or name == "form"
        if not (self._open if far else self._open_here[-1]).get(name):
            return 0
        ended = 0
        while True:
            found, _ = self._stack.pop()
            self._open[found].pop()
            if found in _ROOM:
                self._open_here.pop()
            else:
                self._open_here[-1][found] -= 1
            ended += found == "a"
            if found == name:
                return ended

    def _element(self, name: str, attributes: str) -> int:
        parent = self._stack[-1][1] if self._stack else 0
        node = len(self.parent)
        label, names, hidden = name, [], False
        if attributes.strip(" /"):
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "class":
                    names += value.split()
                    first = next(iter(value.split()), "")
                    label = f"{name}.{re.sub('[0-9]+', '#', first.lower())}" if first else name
                elif key in ("id", "role"):
                    names += value.split()
                elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                    hidden = True
                elif key == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
        doubt = max((_out_name(n) for n in names), default=0) if name not in _NEVER_OUT else 0
        key = (self.path[parent], label.replace("/", "|"))
        if key not in self.paths:
            self.paths[key] = len(self.labels)
            self.labels.append(key)
        self.parent.append(parent)
        self.path.append(self.paths[key])
        self.room.append(node if name in _ROOM else self.room[parent])
        self.out.append(self.out[parent] or name in _OUT or hidden or doubt == 2)
        around = 0 if name == "main" else self.doubt[parent]
        self.doubt.append(node if doubt or name == "form" else around)
        if name in ("h1", "article", "main"):
            self.titled.add(self.doubt[parent])
        return node

    def _settle(self):
        """Decide on elements in doubt: out, unless they hold a title and most of the page's words."""
        words, total = {}, 0
        for node, _, _, linked, n in self.texts:
            if not self.out[node] and not linked:
                total += n
                words[self.doubt[node]] = words.get(self.doubt[node], 0) + n
        doubts = sorted({d for d in self.doubt if d})
        for d in reversed(doubts):
            around = self.doubt[self.parent[d]]
            words[around] = words.get(around, 0) + words.get(d, 0)
            if d in self.titled:
                self.titled.add(around)
        out = {0: False}
        for d in doubts:
            frame = d in self.titled and words.get(d, 0) >= FRAME * total > 0
            out[d] = out.get(self.doubt[self.parent[d]], False) or not frame
        self.out = [o or out[d] for o, d in zip(self.out, self.doubt, strict=True)]

    def path_text(self, number: int) -> str:
        labels = []
        while number > 0:
            number, label = self.labels[number]
            labels.append(label)
        return "/" + "/".join(reversed(labels)) if labels else ""

    def number(self, path: str) -> int | None:
        """The number of a path's text; None if the page has no such path."""
        at = 0
        for label in path.split("/")[1:]:
            at = self.paths.get((at, label))
            if at is None:
                return None
        return at

    def _tag(self, number: int) -> str:
        return self.labels[number][1].split(".")[0]

    def scores(self) -> dict[int, float]:
        """Numbers of paths with their score.

        A block of text counts for the room around it in full and for the next one by half, less
        its part inside links; articles and names of content count more. What a path gets goes to
        the closest article around it, else main, else to the first path that is no part of a list or
        table and has neither text nor a title right around it.
        """
        blocks: dict[tuple[int, int], list[float]] = {}
        direct: set[int] = set()
        for node, block, _, linked, size in self.texts:
            room = self.room[node]
            if not self.out[node] and room:
                total = blocks.setdefault((room, block), [0.0, 0.0])
                total[0] += size
                total[1] += size * linked
                if size and not linked:
                    direct.add(self.path[room])
        # Paths with a title in them, and those right around them.
        with_title, beside_title = set(), set()
        for node in range(1, len(self.parent)):
            if self._tag(self.path[node]) == "h1" and not self.out[node] and self.room[node]:
                with_title.add(self.path[self.room[node]])
                beside_title.add(self.path[self.room[self.parent[self.room[node]]]])
        scores: dict[int, float] = {}
        for (room, _), (size, linked) in blocks.items():
            value = size - linked
            for factor in (1.0, 0.5):
                if not room or value <= 0:
                    break
                path = self.path[room]
                tag, _, name = self.labels[path][1].partition(".")
                bonus = (1.5 if tag in ("article", "main") else 1.0) * (1.25 if _GOOD_NAME.search(name) else 1.0)
                scores[path] = scores.get(path, 0.0) + factor * bonus * value
                room = self.room[self.parent[room]]
        article, main, raised = [0], [0], [0]
        for number in range(1, len(self.labels)):
            around, tag = self.labels[number][0], self._tag(number)
            article.append(number if tag == "article" else article[around])
            main.append(number if tag == "main" else main[around])
            top = around == 0 or self._tag(around) in ("html", "body")
            part = tag in _LIST_OR_TABLE or (tag not in ("div", "center") and "." not in self.labels[number][1])
            lead = around in direct or (around in beside_title and number not in with_title)
            raised.append(raised[around] if not top and (part or lead) else number)
        out: dict[int, float] = {}
        for path, score in scores.items():
            to = article[path] or main[path] or raised[path]
            out[to] = out.get(to, 0.0) + score
        return out

    def containers(self) -> list[tuple[str, float]]:
        """Paths with their share of this page's vote, best first."""
        found = sorted(self.scores().items(), key=lambda x: (-x[1], x[0]))[:VOTES]
        total = sum(s for _, s in found)
        return [(self.path_text(p), s / total) for p, s in found]

    def inside(self, path: int | None) -> list[bool]:
        """Per element whether it lies in an element of this path (anywhere, if None)."""
        inside = [path is None]
        for parent, own in zip(self.parent[1:], self.path[1:], strict=True):
            inside.append(inside[parent] or own == path)
        return inside

    def words(self, inside: list[bool]) -> int:
        return sum(n for node, _, _, linked, n in self.texts if inside[node] and not linked and not self.out[node])

    def text(self, inside: list[bool]) -> str:
        """The blocks of these elements, two line ends between them."""
        blocks: dict[int, list[str]] = {}
        for node, block, text, _, _ in self.texts:
            if inside[node] and not self.out[node]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n\n".join(line for line in lines if line)


def page_containers(source: str | None) -> list[tuple[str, float]]:
    return Page(source or "").containers()


def page_text(source: str | None, path: str | None) -> str:
    """The page's text by the host's path; by its own best path where that one holds few of its words; else all."""
    page = Page(source or "")
    number = page.number(path) if path else None
    found = page.inside(number) if number else []
    n = page.words(found) if found else 0
    own = page.scores()
    if own:
        best = page.inside(min(own, key=lambda p: (-own[p], p)))
        if OWN_LEAD * n < page.words(best):
            found = best
    return (page.text(found) if found else "") or page.text(page.inside(None))


def _containers(sources: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64())]))
    rows = ([{"path": p, "score": s} for p, s in page_containers(x.as_py())] for x in sources)
    return pa.array(list(rows), kind)


def _texts(sources: pa.Array, paths: pa.Array) -> pa.Array:
    return pa.array([page_text(x.as_py(), p.as_py()) for x, p in zip(sources, paths, strict=True)], pa.string())


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path): per host the container path with the most votes; ties by path."""
    scored = pages.select(
        host(F.col(url)).alias("host"),
        F.arrow_udf(_containers, "array<struct<path:string,score:double>>")(F.col(source)).alias("found"),
    )
    votes = scored.filter("host is not null").select("host", F.explode("found").alias("f"))
    # Sums of whole thousandths do not depend on the order of rows.
    votes = votes.groupBy("host", "f.path").agg(F.sum(F.round(F.col("f.score") * 1000).cast("long")).alias("votes"))
    best = votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best"))
    return best.select("host", "best.path")


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: ``id``, ``url``, text, n_chars, host, path.

    Every page scores its containers and votes; each host's winning tag-class path is then used
    for all its pages. Pages without a host, or with less than a third of their own best container's
    words at the path, go by their own. A null, empty or unreadable page has an empty text. Repeated rows are each
    reported. Other columns are not read. Nothing of a host is gathered in one task but sums.
    """
    paths = materialise(host_paths(pages, url, source))
    paths = paths.select(F.col("host").alias("of_host"), "path")
    rows = pages.select(
        F.col(id).cast("long").alias(id), F.col(url).alias(url), F.col(source).alias("source"), host(F.col(url)).alias("host")
    )
    rows = rows.join(small_side(paths), F.col("host") == F.col("of_host"), "left")
    rows = rows.withColumn("text", F.arrow_udf(_texts, "string")(F.col("source"), F.col("path")))
    return rows.select(id, url, "text", F.length("text").cast("long").alias("n_chars"), "host", "path")
