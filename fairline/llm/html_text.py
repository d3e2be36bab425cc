"""Main text of HTML pages: flat text blocks judged by a decision tree.

A page becomes a flat list of text blocks, broken at block-level tags. Each block is described
by its word count and link density, those of the blocks before and after it, and whether it
stands in the main container, in a boilerplate container or in a heading. A decision tree,
fitted on the small labelled table below, says which blocks are content: a list of links goes even
from the main container, long text among long text stays even outside of it.

Defined cases: null or empty html gives an empty text; pages without markup are one block;
unclosed tags end with their container; repeated rows and ids give a row each; whole pages
are read whatever their length; other columns of the input are ignored.
"""

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.trees import decided, nested
from fairline.llm.words import sliced

#: A tag's name, the marks that matter inside of it, and elements whose content is no text.
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
MARKS = re.compile(r"[<>\"']")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg title textarea select button iframe object canvas".split()}
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags that don't break a block, that hold others, and names of boilerplate containers.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl figure footer form header li main menu nav ol p section table td th tr ul".split())
HARD_TAGS = frozenset("aside dialog footer form menu nav".split())
HARD_NAMES = frozenset("ad ads advert advertisement adverts advertising comment comments cookie cookies consent copyright disqus discussion gdpr legal modal newsletter notice notices pagination pager popup promo promoted promotion recommended related replies reply respond share sharing social sponsor sponsored subscribe teaser teasers".split())
SOFT_NAMES = frozenset("alert alerts banner breadcrumb breadcrumbs footer header login masthead menu nav navbar navigation search sidebar signup toolbar widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "boilerplate", "heading")

#: The labelled table. main: 1 inside article or main, -1 outside where the page has one, 0 if it has none.
#: words links | before | after | main boilerplate heading | content
LABELLED = """
60 0.00 9 0.00 45 0.00 1 0 0 1 | 3 0.00 40 0.00 52 0.00 1 0 0 1 | 1 0.00 1 0.00 1 0.00 1 0 0 1 | 9 0.00 12 1.00 70 0.00 1 0 1 1
12 0.50 60 0.00 44 0.00 1 0 0 1 | 4 1.00 50 0.00 61 0.00 1 0 0 1 | 150 0.02 8 0.00 20 0.00 1 0 0 1 | 7 0.00 80 0.00 9 0.20 1 0 0 1
2 0.00 0 0.00 30 0.00 1 0 1 1 | 25 0.00 0 0.00 0 0.00 1 0 0 1 | 5 0.00 20 0.00 6 0.30 1 0 0 1 | 33 0.10 2 0.00 3 1.00 1 0 0 1
1 0.00 2 0.00 90 0.00 1 0 1 1 | 18 0.90 22 0.00 30 0.00 1 0 0 1 | 300 0.00 0 0.00 0 0.00 1 0 0 1 | 6 0.00 1 1.00 2 0.00 1 0 1 1
4 0.00 30 0.00 9 0.30 1 0 0 1 | 4 0.00 3 0.00 2 0.00 1 0 0 1 | 20 0.95 3 1.00 8 1.00 1 0 0 0 | 3 0.67 4 1.00 60 0.00 1 0 0 0
5 0.00 2 1.00 3 1.00 1 0 0 1 | 6 0.30 60 0.00 0 0.00 1 0 0 1 | 2 1.00 1 1.00 2 1.00 1 0 0 0 | 1 1.00 0 0.00 1 1.00 1 0 0 0
4 0.00 0 0.00 6 0.20 1 0 1 1 | 12 0.00 2 1.00 5 0.60 1 0 0 1 | 50 0.60 20 0.00 3 1.00 1 0 0 1 | 9 0.00 6 0.20 2 1.00 1 0 0 1
4 0.25 50 0.00 7 0.20 1 0 0 1 | 14 0.00 9 0.00 12 0.50 1 0 0 1 | 3 0.00 4 1.00 2 1.00 1 0 1 1 | 8 1.00 70 0.00 8 1.00 1 0 0 0
20 0.00 50 0.00 6 0.20 1 1 0 0 | 8 0.00 30 0.00 44 0.00 1 1 0 0 | 2 1.00 35 0.00 2 1.00 1 1 0 0 | 60 0.00 80 0.00 3 0.00 1 1 0 0
4 1.00 3 1.00 5 1.00 1 0 0 0 | 1 1.00 2 1.00 1 1.00 1 0 0 0 | 2 1.00 60 0.00 3 1.00 1 0 0 0 | 3 1.00 2 1.00 45 0.00 1 0 0 0
6 1.00 5 1.00 0 0.00 1 0 0 0 | 12 1.00 9 1.00 10 1.00 1 0 0 0 | 3 0.75 4 1.00 2 1.00 1 0 0 0 | 5 0.80 6 0.83 4 0.75 1 0 0 0
9 1.00 8 0.90 7 1.00 1 0 0 0 | 2 1.00 1 1.00 0 0.00 1 0 0 0 | 4 1.00 33 0.00 5 1.00 1 0 0 0 | 7 1.00 6 1.00 80 0.00 1 0 0 0
2 1.00 25 0.00 1 1.00 1 0 0 0 | 5 1.00 28 0.00 40 0.00 1 0 0 1 | 9 1.00 90 0.00 33 0.00 1 0 0 1 | 2 1.00 20 0.00 18 0.00 1 0 0 1
11 0.00 40 0.00 2 1.00 1 0 0 1 | 30 0.00 7 1.00 3 1.00 1 0 0 1 | 25 0.20 3 1.00 4 1.00 1 0 0 1 | 6 0.00 12 0.00 3 1.00 1 0 0 1
7 0.00 45 0.10 50 0.00 1 0 0 1 | 5 0.00 2 0.00 1 1.00 1 0 1 1 | 10 0.30 2 1.00 40 0.00 1 0 0 1 | 8 0.00 3 1.00 2 1.00 1 0 0 1
90 0.00 60 0.00 70 0.00 -1 0 0 1 | 120 0.02 45 0.00 80 0.00 -1 0 0 1 | 85 0.00 110 0.00 40 0.00 -1 0 0 1 | 150 0.00 70 0.00 95 0.00 -1 0 0 1
9 0.00 8 0.00 120 0.00 -1 0 0 0 | 30 0.00 2 1.00 150 0.00 -1 0 0 0 | 12 0.00 90 0.00 100 0.00 -1 0 0 0 | 45 0.00 60 0.00 130 0.00 -1 0 0 0
20 0.00 120 0.00 0 0.00 -1 0 0 0 | 35 0.00 0 0.00 200 0.00 -1 0 0 0 | 14 0.00 150 0.00 0 0.00 -1 0 0 0 | 60 0.00 5 0.00 180 0.00 -1 0 0 0
7 0.00 200 0.00 160 0.00 -1 0 1 0 | 50 0.00 110 0.00 90 0.00 -1 0 0 0 | 62 0.05 140 0.00 85 0.00 -1 0 0 0 | 25 0.00 88 0.00 79 0.00 -1 0 0 0
100 0.00 90 0.00 120 0.00 -1 0 0 1 | 250 0.00 130 0.00 60 0.00 -1 0 0 1 | 88 0.03 50 0.00 200 0.00 -1 0 0 1 | 180 0.00 100 0.00 150 0.00 -1 0 0 1
100 0.00 90 0.00 120 0.00 -1 1 0 0 | 250 0.00 130 0.00 60 0.00 -1 1 0 0 | 88 0.00 50 0.00 200 0.00 -1 1 0 0 | 180 0.00 100 0.00 150 0.00 -1 1 0 0
90 0.00 60 0.00 70 0.00 -1 1 0 0 | 120 0.02 45 0.00 80 0.00 -1 1 0 0 | 30 0.00 30 0.00 30 0.00 -1 1 0 0 | 150 0.00 70 0.00 95 0.00 -1 1 0 0
90 0.00 4 1.00 70 0.00 -1 0 0 0 | 85 0.00 60 0.00 3 1.00 -1 0 0 0 | 110 0.00 8 0.00 12 0.00 -1 0 0 0 | 95 0.50 60 0.00 70 0.00 -1 0 0 0
4 0.00 50 0.00 30 0.00 1 1 1 0 | 1 0.00 1 0.00 1 0.00 1 1 0 0 | 120 0.00 9 0.00 40 0.00 1 1 0 0 | 15 0.50 12 0.00 70 0.00 1 1 0 0
2 1.00 0 0.00 1 1.00 -1 1 0 0 | 6 0.20 70 0.00 0 0.00 -1 1 0 0 | 14 0.00 3 1.00 9 0.00 -1 1 0 0 | 80 0.00 2 0.00 90 0.00 -1 1 0 0
5 0.00 0 0.00 11 0.00 -1 0 0 0 | 40 0.00 1 1.00 8 0.00 -1 0 0 0 | 1 1.00 1 1.00 1 1.00 -1 0 0 0 | 9 0.00 60 0.00 0 0.00 -1 0 1 0
130 0.00 50 0.00 0 0.00 -1 0 0 0 | 3 0.00 60 0.00 4 0.50 -1 0 0 0 | 25 0.30 8 0.00 12 1.00 -1 0 0 0 | 7 0.00 0 0.00 5 0.00 -1 0 1 0
40 0.00 2 1.00 60 0.00 -1 0 0 0 | 12 0.00 0 0.00 44 0.00 -1 0 0 0 | 70 0.00 55 0.00 90 0.00 -1 0 0 0 | 3 0.00 9 0.00 33 0.00 -1 0 1 0
28 0.00 60 0.00 25 0.00 -1 0 0 0 | 6 0.00 5 0.00 120 0.00 -1 0 0 0 | 100 0.01 0 0.00 30 0.00 -1 0 0 0 | 17 0.00 80 0.00 50 0.00 -1 0 0 0
55 0.00 8 0.00 60 0.00 0 0 0 1 | 30 0.05 50 0.00 42 0.00 0 0 0 1 | 90 0.00 2 1.00 3 1.00 0 0 0 1 | 16 0.00 70 0.00 22 0.00 0 0 0 1
200 0.01 0 0.00 0 0.00 0 0 0 1 | 12 0.00 40 0.00 35 0.00 0 0 0 1 | 6 0.00 55 0.00 48 0.00 0 0 0 1 | 22 0.20 33 0.00 41 0.00 0 0 0 1
8 0.00 3 1.00 64 0.00 0 0 1 1 | 5 0.00 45 0.00 50 0.00 0 0 1 1 | 11 0.00 2 0.00 38 0.00 0 0 1 1 | 4 0.00 0 0.00 80 0.00 0 0 1 1
40 0.00 8 0.00 3 0.00 0 0 0 1 | 6 0.00 0 0.00 0 0.00 0 0 0 1 | 9 0.00 0 0.00 0 0.00 0 0 0 1 | 25 0.00 40 0.00 0 0.00 0 0 0 1
40 0.00 0 0.00 10 0.00 0 0 0 1 | 14 0.00 30 0.00 12 0.00 0 0 0 1 | 1 0.00 40 0.00 50 0.00 0 0 0 1 | 40 0.10 10 0.00 20 0.00 0 0 0 1
18 0.00 4 0.00 25 0.00 0 0 0 1 | 35 0.00 2 1.00 1 1.00 0 0 0 1 | 2 0.00 0 0.00 0 0.00 0 0 0 1 | 8 0.00 1 1.00 40 0.00 0 0 1 1
2 0.00 6 0.00 40 0.00 0 0 1 1 | 3 1.00 60 0.00 70 0.00 0 0 0 0 | 12 1.00 40 0.00 2 1.00 0 0 0 0 | 1 1.00 2 0.00 40 0.00 0 0 0 0
30 0.80 40 0.00 50 0.00 0 0 0 0 | 4 0.75 0 0.00 20 0.00 0 0 0 0 | 25 0.60 1 1.00 1 1.00 0 0 0 0 | 2 1.00 50 0.00 0 0.00 0 0 0 0
2 1.00 1 1.00 2 1.00 0 0 0 0 | 1 1.00 0 0.00 1 1.00 0 0 0 0 | 3 0.67 4 1.00 60 0.00 0 0 0 0 | 20 0.95 3 1.00 8 1.00 0 0 0 0
5 0.00 2 1.00 3 1.00 0 0 0 0 | 6 0.30 60 0.00 0 0.00 0 0 0 0 | 3 0.00 4 1.00 2 1.00 0 0 1 0 | 4 0.00 3 0.00 2 0.00 0 0 0 0
30 0.00 5 0.00 40 0.00 0 1 0 0 | 9 0.00 60 0.00 2 1.00 0 1 0 0 | 2 1.00 2 1.00 2 1.00 0 1 0 0 | 75 0.00 60 0.00 80 0.00 0 1 0 0
5 0.00 30 0.00 30 0.00 0 1 1 0 | 1 1.00 1 1.00 30 0.00 0 1 0 0 | 18 0.10 0 0.00 20 0.00 0 1 0 0 | 45 0.70 20 0.00 3 1.00 0 0 0 0
"""


def labelled_rows() -> list[tuple]:
    rows = [[float(x) for x in r.split()] for line in LABELLED.strip().splitlines() for r in line.split("|")]
    return [(r[:9], r[9]) for r in rows]


def content_tree(spark: SparkSession) -> tuple:
    """The decision tree, fitted on the labelled table."""
    train = spark.createDataFrame(labelled_rows(), "f array<double>, label double").select(array_to_vector("f").alias("features"), "label").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=1, maxBins=64, seed=7).fit(train)
    return nested(model._call_java("rootNode"))


def tag_end(page: str, at: int, find: Callable[[str, int], int]) -> int:
    """Where the tag ends whose attributes begin at a place, with regard to quoted values of any length; -1 if another tag begins before, or a quote has no end.

    A quote opens a value only after an equals sign. Every quote passed over is looked for once.
    """
    while mark := MARKS.search(page, at):
        at = mark.start()
        if mark[0] in "<>":
            return at if mark[0] == ">" else -1
        before = at - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=" and (at := find(mark[0], at + 1)) < 0:
            return -1
        at += 1
    return -1


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text), (tag, attributes, "") and ("/tag", "", "") in order; what is dropped inside a line gives a space.

    One pass: what is looked for to the end of the page and not found is not looked for again. A
    "<" that begins no tag is text.
    """
    n, at = len(page), 0
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while at < n:
        start = find("<", at)
        if start < 0:
            yield "", "", page[at:]
            return
        if start > at:
            yield "", "", page[at:start]
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            at = end + 3 if end >= 0 else n
        elif page.startswith("<![CDATA[", start) and (end := find("]]>", start)) >= 0:
            at = end + 3
        elif name := NAME.match(page, start + 1):
            tag, ends = name[1].lower(), page[start + 1] == "/"
            if (end := tag_end(page, name.end(), find)) < 0 and (end := find(">", name.end())) < 0:
                yield "", "", "<"
                at = start + 1
                continue
            at = end + 1
            if not ends and tag in RAW:
                close = None if "/" + tag in missing else RAW[tag].search(page, at)
                if close is None:
                    missing.add("/" + tag)
                at = close.end() if close else n
                yield "", "", " "
            else:
                yield ("/" + tag, "", "") if ends else (tag, page[name.end() : end], "")
        elif page[start + 1 : start + 2] in ("!", "?", "/") and (end := find(">", start)) >= 0:
            at = end + 1
        else:
            yield "", "", "<"
            at = start + 1


def names_of(attributes: str) -> frozenset[str]:
    """The parts of the class, id and role names."""
    return frozenset(x for m in ATTRIBUTE.finditer(attributes) for x in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower()) if x)


def blocks_of(page: str) -> list[list]:
    """[text, words, linked words, in main, boilerplate, heading] for each block with text."""
    blocks: list[list] = []
    holders: list[tuple[int, str, frozenset[str]]] = [(-1, "", frozenset())]  # every container: the one around it, tag and names
    stack, opened = [0], Counter()
    in_link = heading = 0
    text: list[str] = []
    link_text: list[str] = []

    def close() -> None:
        words = "".join(text).split()
        if words:
            blocks.append([" ".join(words), len(words), len("".join(link_text).split()), stack[-1], 0, heading])
        text.clear()
        link_text.clear()

    for tag, attributes, piece in pieces(page):
        if not tag:
            piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                link_text.append(piece)
            continue
        ends, tag = tag[0] == "/", tag.lstrip("/")
        if tag == "a":
            in_link = not ends
            link_text.append(" ")
        elif tag == "br":
            text.append(" ")
        if tag in INLINE:
            continue
        close()
        if tag in HEADINGS:
            heading = int(not ends)
        elif tag in CONTAINERS:
            if not ends:
                if tag in ("p", "li") and holders[stack[-1]][1] == tag:
                    opened[tag] -= 1
                    stack.pop()
                holders.append((stack[-1], tag, names_of(attributes) if attributes and tag != "body" else frozenset()))
                stack.append(len(holders) - 1)
                opened[tag] += 1
            elif opened[tag]:
                while (last := holders[stack.pop()][1]) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
            heading = 0
    close()
    main, boilerplate = judged_holders(holders)
    for b in blocks:
        b[3], b[4] = main[b[3]], boilerplate[b[3]]
    return blocks


def judged_holders(holders: list[tuple[int, str, frozenset[str]]]) -> tuple[list[bool], list[bool]]:
    """Whether each container is within main text, and whether it is within boilerplate.

    The page's first main element, else its first article outside of boilerplate tags, is its main
    container whatever its names, and what is around it is no boilerplate. Without one, a form
    around half of the page's containers is none either.
    """
    sealed = [False] * len(holders)  # within a tag that holds no main text
    for i, (around, tag, _) in enumerate(holders[1:], 1):
        sealed[i] = sealed[around] or tag in HARD_TAGS and tag != "form"
    first = next((i for i, h in enumerate(holders) if h[1] == "main"), None) or next((i for i, h in enumerate(holders) if h[1] == "article" and not sealed[i]), None)
    wraps = {0}
    if first:
        i = first
        while i > 0:
            wraps.add(i)
            i = holders[i][0]
    else:
        held = [1] * len(holders)
        for i in range(len(holders) - 1, 0, -1):
            held[holders[i][0]] += held[i]
        wraps |= {i for i, h in enumerate(holders) if h[1] == "form" and 2 * held[i] >= len(holders)}
    main, hard, soft = ([False] * len(holders) for _ in range(3))
    for i, (around, tag, names) in enumerate(holders[1:], 1):
        main[i], hard[i], soft[i] = main[around], hard[around], soft[around]
        if i == first:
            main[i], hard[i], soft[i] = True, False, False
        elif i in wraps:
            hard[i] = soft[i] = False
        elif tag in HARD_TAGS or names & HARD_NAMES:
            hard[i] = True
        elif tag in ("article", "main"):
            main[i], soft[i] = True, False
        elif tag != "header" and names & SOFT_NAMES or tag == "header" and not main[i]:
            soft[i] = True
    return main, [h or s for h, s in zip(hard, soft, strict=True)]


def features_of(blocks: list[list]) -> list[tuple[float, ...]]:
    """FEATURES of each block."""
    has_main = any(b[3] for b in blocks)
    shape = [(0.0, 0.0), *((float(b[1]), b[2] / b[1]) for b in blocks), (0.0, 0.0)]
    return [(*shape[i + 1], *shape[i], *shape[i + 2], 1.0 if b[3] else -1.0 if has_main else 0.0, float(b[4]), float(b[5])) for i, b in enumerate(blocks)]


def main_text(page: str | None, tree: tuple) -> str:
    """The content blocks in page order, joined by an empty line."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b[0] for b, f in zip(blocks, features_of(blocks), strict=True) if decided(tree, f) > 0.5)


def page_texts(pages: DataFrame, *, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars of every page."""
    tree = content_tree(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in sliced(batch, "html")):
            texts = [main_text(x.as_py(), tree) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column(key), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    return pages.select(key, "url", "html").mapInArrow(extract, f"{key} long, url string, text string, n_chars long")
