"""Main text of web pages by paths that the pages of a host agree on."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches

# HTML's element kinds and the words that name parts of a page.
# A tag that is not closed ends before the next one, a declaration that is not with the page: what follows is read once.
TOKEN = re.compile(r"<(?:!--|([/]?)([a-zA-Z][^\s<>/]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)(?:>|(?=<))|[!?][^>]*(?:>|\Z))")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in "script style textarea title xmp".split()}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rt rp s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of the key's group ends an open element of the value's group, down to a barrier.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
DROPPED_TAGS = frozenset(
    "nav aside footer form script style noscript template button select option textarea input iframe object svg canvas "
    "dialog head title menu".split()
)
#: Words that name what is not the article, wherever they stand in a class or id.
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense advertising promo promoted sponsor sponsored cookie cookies consent gdpr "
    "sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus newsletter "
    "subscribe popup pagination related recommended share sharing social".split()
)
#: Words that do so only as the last word of a class: "site-search", but not "search-results".
WEAK_WORDS = frozenset(
    "notice alert modal overlay banner respond reply replies signup login search pager toolbar widget notification".split()
)
#: A class that starts so tells what else is on the page, not what the element is.
STATE_WORDS = frozenset("has no not with without is hide hides show shows enable disable can".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu".split())
CONTAINERS = frozenset("article body center div main section td".split())
MAIN_WORDS = frozenset("article body content entry main post story text".split())
DECAY, MAIN_BONUS = 0.5, 1.5
#: Share of its parent's text that makes a child the way to the article, and the share of the
#: article above which a part named as something else is taken for the article all the same.
BESIDE, MOST = 0.2, 0.5
#: Parts of a host when pages are dealt out by host.
SALTS = 16


def suspect(names: list[str]) -> bool:
    """Whether classes or ids name an element as something else than the article."""
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        if words and words[0] not in STATE_WORDS and (STRONG_WORDS.intersection(words) or words[-1] in WEAK_WORDS):
            return True
    return False


class Page:
    """A page's elements and its blocks of text, in page order, from one pass over the tags.

    dropped: elements that are no article by their tag, role or style (with all inside them);
    doubtful: those that classes name as something else, which judge() then decides by content.
    Work and memory grow with the page's length, however deep or broken its markup: an element
    holds its own step of its path, and the depths at which a tag is open are kept by tag.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.step, self.dropped, self.doubtful = [-1], ["#"], [""], [False], [False]
        self.main = [False]
        self.all_blocks: list[tuple[int, str]] = []
        self.words: list[set] = [set()]
        self._stack, self._buffer, self._skipped = [0], [], []
        self._depths: dict[str, list[int]] = {}
        self._read(html)
        self.judge()
        self.blocks = [(at, text) for at, text in self.all_blocks if not self.dropped[at]]

    def _flush(self) -> None:
        self._skipped.clear()  # an inline element ends with its block at the latest
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            self._buffer.clear()
            if text:
                self.all_blocks.append((self._stack[-1], text))

    @staticmethod
    def _names(attributes: str) -> dict:
        names: dict[str, str] = {}
        if attributes and not attributes.isspace():
            for m in ATTRIBUTE.finditer(attributes):
                names.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        return names

    @staticmethod
    def _hidden(names: dict) -> bool:
        return names.get("role", "").lower() in DROPPED_ROLES or "hidden" in names or "display:none" in names.get("style", "").replace(" ", "").lower()

    def _open(self, tag: str, attributes: str) -> None:
        at = self._stack[-1]
        names = self._names(attributes)
        given = names.get("class", "").split()
        classes = sorted({re.sub(r"\d+", "0", c.lower()) for c in given})
        words = {w for c in [*classes, names.get("id", "").lower()] for w in re.split(r"[^a-z]+", c) if w}
        within = self.main[at]
        bad = tag in DROPPED_TAGS or self._hidden(names) or tag == "header" and not within
        self.parent.append(at)
        self.tag.append(tag)
        self.words.append(words)
        self.main.append(within or tag in ("article", "main"))
        self.dropped.append(self.dropped[at] or bad)
        named = "header" in words and words.isdisjoint(("article", "post", "entry", "content")) and not within
        self.doubtful.append(tag not in ("html", "body") and (named or suspect([*given, names.get("id", "")])))
        self.step.append(".".join([tag, *classes]).replace(">", " "))
        self._depths.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)

    def _close(self, depth: int) -> None:
        for i in reversed(self._stack[depth:]):
            self._depths[self.tag[i]].pop()
        del self._stack[depth:]

    def _deepest(self, tags) -> int:
        """Depth of the deepest open element of these tags; 0 for none."""
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=0)

    def judge(self) -> None:
        """Drop the doubtful elements that their content does not clear.

        The article's place is the article or main element with most text that is not doubtful,
        or else what one reaches from the top by going to the child with most such text while it
        has BESIDE of its parent's; only where nothing but doubtful children have text, into the
        doubtful one with more than MOST of it. What holds that place is the article, whatever
        its classes say; so is a doubtful part inside it with more than MOST of its text.
        """
        if not any(self.doubtful):
            return
        n = len(self.tag)
        size, sure = [0] * n, [0] * n
        for at, text in self.all_blocks:
            if not self.dropped[at]:
                size[at] += len(text)
        own = list(size)
        for i in range(n - 1, 0, -1):  # children follow their parents
            size[self.parent[i]] += size[i]
        for i in range(n - 1, -1, -1):
            sure[i] += own[i]
            if i and not self.doubtful[i]:
                sure[self.parent[i]] += sure[i]
        inside = [False] * n
        children: dict[int, list[int]] = {}
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.doubtful[i]
            children.setdefault(self.parent[i], []).append(i)
        mains = [i for i in range(1, n) if self.tag[i] in ("article", "main") and not self.dropped[i] and size[i]]
        if mains:
            place = max(mains, key=lambda i: (not self.doubtful[i], sure[i], -i))
        else:
            place = 0
            while True:
                free = [i for i in children.get(place, ()) if not self.doubtful[i] and sure[i]]
                best = max(free, key=lambda i: (sure[i], -i), default=None)
                if best is None and not own[place]:
                    best = max(children.get(place, ()), key=lambda i: (size[i], -i), default=None)
                    if best is not None and size[best] <= MOST * size[place]:
                        best = None
                elif best is not None and sure[best] < BESIDE * size[place]:
                    best = None
                if best is None:
                    break
                place = best
        cleared, i = set(), place
        while i > 0:
            cleared.add(i)
            i = self.parent[i]
        for i in range(1, n):
            if self.dropped[self.parent[i]]:
                self.dropped[i] = True
            elif self.doubtful[i] and i not in cleared:
                # of what holds something cleared, only the place itself is above such a part
                self.dropped[i] = not (self.parent[i] == place and size[i] > MOST * size[place])

    def _close_implied(self, tag: str) -> None:
        if tag in ENDS_P:  # a paragraph is open only at the top: inline elements are not on the stack
            if self.tag[self._stack[-1]] == "p":
                self._close(len(self._stack) - 1)
        elif tag in SIBLINGS:
            ends, stops = SIBLINGS[tag]
            if (depth := self._deepest(ends)) > self._deepest(stops - ends):
                self._close(depth)

    def _read(self, html: str) -> None:
        at = 0
        while m := TOKEN.search(html, at):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = html.find("-->", at)
                at = len(html) if end < 0 else end + 3
                continue
            if not m[2]:
                continue
            tag = m[2].lower()
            inline = tag in INLINE
            if not inline:
                self._flush()
            elif tag == "br":
                self._buffer.append(" ")
            if m[1]:
                if inline:  # inline elements are open only while their text is skipped
                    if self._skipped and self._skipped[-1] == tag:
                        self._skipped.pop()
                elif self._depths.get(tag):
                    self._close(self._depths[tag][-1])
                continue
            if inline and tag not in VOID:
                if self._skipped:
                    if tag == self._skipped[-1]:
                        self._skipped.append(tag)
                elif m[3] and not m[3].isspace():
                    names = self._names(m[3])
                    if self._hidden(names) or suspect([*names.get("class", "").split(), names.get("id", "")]):
                        self._skipped.append(tag)
                        self._buffer.append(" ")
            if tag in RAW:
                found = RAW[tag].search(html, at)
                end = found.start() if found else len(html)
                if tag == "xmp":
                    self._text(html[at:end])
                at = end
                continue
            if inline or tag in VOID:
                continue
            self._close_implied(tag)
            if not m[3].endswith("/") or tag in CONTAINERS:
                self._open(tag, m[3])
        if at < len(html):
            self._text(html[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if not self._skipped:
            self._buffer.append(unescape(raw) if "&" in raw else raw)

    def best_path(self) -> str:
        """Path of the container that scores highest; "" for a page without text.

        A block gives its length to its nearest container, DECAY of it to the next one out, and
        so on; containers named as main parts count half as much again. Ties: the outer one.
        """
        score = [0.0] * len(self.tag)
        for at, text in self.blocks:
            score[at] += len(text)
        for i in range(len(self.tag) - 1, 0, -1):  # children follow their parents
            score[self.parent[i]] += score[i] * (DECAY if self.tag[i] in CONTAINERS else 1)
        named = lambda i: self.tag[i] in ("article", "main") or self.words[i] & MAIN_WORDS
        places = [i for i in range(1, len(self.tag)) if score[i] and self.tag[i] in CONTAINERS]
        best = max(places, key=lambda i: (score[i] * (MAIN_BONUS if named(i) else 1), -i), default=None)
        steps = []
        while best:
            steps.append(self.step[best])
            best = self.parent[best]
        return "".join(f">{x}" for x in reversed(steps))

    def text_at(self, path: str) -> str | None:
        """The blocks inside the elements at a path; None if the page has no such element."""
        steps = path.split(">")[1:]
        inside, along = [False] * len(self.tag), [0] * len(self.tag)  # along: steps of the path that lead here, or -1
        for i in range(1, len(self.tag)):
            done = along[self.parent[i]]
            along[i] = done + 1 if 0 <= done < len(steps) and self.step[i] == steps[done] else -1
            inside[i] = inside[self.parent[i]] or (along[i] == len(steps) and not self.dropped[i])
        if not any(inside):
            return None
        return "\n".join(text for at, text in self.blocks if inside[at])

    def text(self, path: str | None) -> str:
        found = self.text_at(path) if path else None
        if found is None:
            own = self.best_path()
            found = self.text_at(own) if own else None
        return "\n".join(t for _, t in self.blocks) if found is None else found


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    Pass one scores each page's containers and takes its best one's generalised tag-class path
    (digits in classes become 0); Spark counts these votes per host. Pass two extracts the
    elements at the winning path of the host (most votes, then the smallest path); a page that
    has none is extracted at its own best path. Null html is empty text; pages without a host
    vote together; repeated rows are ordinary rows; an empty table gives no rows.
    Votes are counted before they move, so a host of a third of all pages is no hot key. The
    winners (a row for each host) are broadcast only below the planner's size limit; beyond it
    pages and winners meet under the host and one of SALTS numbers.
    """
    text_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"),
    )

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                paths = [Page(h).best_path() for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(paths, pa.string())], ["host", "path"])

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                html, path = part.column(2).to_pylist(), part.column(3).to_pylist()
                texts = [Page(h).text(p) for h, p in zip(html, path, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    votes = base.select("host", "html").mapInArrow(vote, "host string, path string").filter("path <> ''")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    winners = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path"))
    winners = stored(winners, "html-paths").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "path")
    out = joined.mapInArrow(extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
