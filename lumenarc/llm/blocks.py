"""Main text of HTML pages from flat text blocks.

A page is cut into blocks at block-level tags. A block has its words and its link density, those of its neighbours (two
on either side by words, one by density), whether it is a heading, and one mark of where it stands: 1 in running text
that stands apart (footers, forms, comments, notices), -1 inside the page's article, else 0. A decision tree, grown on
the small labelled table below and on variants of its pages, keeps or drops each block. Words and density, of the block
and its neighbours, open the tree; the mark breaks ties in those leaves alone that both classes reach, and words and
density decide what is left of them.

Nulls: a null page is empty and has no text. Pages without kept blocks give an empty text. Repeated rows give repeated
results; long pages are read whole; tags that never close or are cut off end with the page; an empty table gives no
rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Numbers of a block, and the one that breaks ties.
WORDS_AND_DENSITY, MARK = tuple(range(9)), (9,)
#: How the tree grows: the numbers that split, splits above a leaf, blocks in a leaf. The mark is asked where the first step ends in both classes.
PLAN = ((WORDS_AND_DENSITY, 5, 20), (MARK, 2, 1), (WORDS_AND_DENSITY, 6, 3))
#: Variants of a labelled page that names its article, and how many times its text such a variant has.
VARIANTS = 10
LENGTHS = (0.1, 0.3, 0.6, 1, 1.5, 2.5)

#: Labelled pages, a line each, block by block: + main text or - not, words, @ link density, h heading, ! apart, = article, * how many alike.
LABELLED = """
-1@1*6 -8 +9h= +70= +40= +2= +25= -12!
-1@1*6 -13 +11h= +55= +1= +1= +30= +160= -16!
-1@1 -2@1 -1@1 -4 +1h= +2= +1= +3= +2= -7!
-1@1*6 -6 +20h= +12= +90= +9= -9!
-1@1*6 -9 +8h= +7= +11= +12= +1= +48= +17= +8= -13!
-1@1*6 -10 +5h= +33= +15@.2= +3@.34= +60= +5= -11!
-2@1*5 +12h= +44= +9@.6= +70= -3@1= -3@1= -4@1= -8!
-1@1 -3@1 -5 +10h= +2@.5= +65= +22@.8= +40= +1@1= +38= -15!
-1@1*6 -12 +3h= +1@1= +50= +4= -6!
-3@1 -3@1 +7h +80 +50@.05 +30 -4@1 -5@1
-2@1*5 +10h +60 +45 +18 +75 -3h -6@1 -7@1 -5@1 -10!
-15 -2@1 -2@1 -3@1 +8h +65 +40@.1 +55 -9
-2@1 -1@1 -18@.1 +9h +120 +80 +60 -2 -14 -2 -22 -2 -9 -6@1 -11
-1@1 -2@1 -24 +11h +66 +70 -3 -30 -3 -17 -3 -26 -2@1 -2@1
-4@1 -5@1 +6h -5@.2 +95 +9 +85 +40 -12 -14
-3 -2 -2 +12h +58 +33 +47@.04 -11 -8 -3
-2@1*5 -7@.9 -12@.8 +9h +100 +24@.3 +110 -10@.5 -6@1 -6@1
+7h +35 +60 +28
+150 +90 +40
+5h +45 +5h +70 +4h +55 -9
-1@1*6 +4h +38 +3 +42 +12 +61 +26 -5 -2@1 -13
-2@1 -3@1 -9@.1 -11 +13h +72 +30 -16 -2@1 -2@1
-2@1*5 +10h +25 +21 +32 -4@1 -4@1 -14
-1@1*6 -20 +6h +27 +50 +19 +44 -3h -15 -3h -21 -6@1
-6! -30! +8h= +40= +60= -3h! -50! -2! -80! -2! -35! -12!
-1@1 -3! +9h= +66= +20@.1= -25! +70= -8@1! -8@1! -90! -10!
-2@1 -5! -40! +7h +77 +58 -2h! -45! -120! -28! -9!
-1@1*6 +9h= +150= -60! -200! -33! -15! -5@.5!
-4h! -22! -3h! -18! +55 +70 +48 -10!
-5@1 -5@1 -5@1 -5@1 -8@1 -7@.9 -4@1
-2@1 -3@.67 -2@.5 +14h= +31= +6= +29= +2h= +51= -17@.2!
-1@1*6 -14 +16h= +21= +1= +2= +1= +3= -16!
-2@1*5 -7 +24h= +5= +18= -12!
-1@1*6 -11 +8h= +150= +20= -9!
-1@1*6 -5 +12h= +102= +61= -14!
-1@1*6 -9 +10h= +120= +2= +95= -10!
-1@1*6 -12 +6h= +130= +7= -7!
-12@1 -26@.9 -14@1 -31@1 -28@1 -45@.9 -16@1
-2@1 +9h +48 +1 +52 +2 +1 +61 -24@1 -27@1 -30@1 -25@1
+8h +70 +2 +44 -13@1 -35@1 -26@.8 -9
-1@1*6 +7h +26 +2 +30 +3 +1 +41 +55 -40@.9 -38@1 -1@1
+6h +31 +1 +2 +1 +27 +2 +60
-1@1*6 -8 +5h= +48= +33= -8!
-1@1*6 -12 +4h= +160= -12!
-1@1*6 -5 +3h= +70= +1= -14!
-11 -1@1 -2@1 +5h +37 +1 +74 +41 -1 -8 -2 -12 -9@1 -4@1 -9
-2@1 -1@1 +8h +61 +40 -1 -11 -1 -7 -2 -14 -13
-1@1*6 -7 +9h= +36= +31= -13!
-1@1*6 -9 +9h= +2= +29= -7!
-1@1*6 -10 +6h= +39= +60= +14= -10!
-1@1*6 -9 +8h= +48= +33= +11=
+6h= +20= +4= +12= +11= +11=
+11= +11= +11= +11= +11= +11=
-1@1*6 -6 +12h= +90= +36= -15!
"""

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_FRAME = frozenset("article aside details dialog div footer form header main menu nav ol section select table ul fieldset figure dl blockquote span button td".split())
_APART_TAG = frozenset("footer aside form dialog select button fieldset".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class, id and role names of running text that stands apart, wherever it is.
_APART_NAME = re.compile(
    r"(?:^|[\s_-])(?:banner|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|gdpr|login|masthead|modal|newsletter|notices?|notification|popup|repl(?:y|ies)|responses?|sidebar|signup|subscribe|widgets?)(?=$|[\s_-]|\d)",
    re.IGNORECASE,
)
#: Names of lists and adverts, which are told by words and density but for those set into an article.
_INSET_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|breadcrumbs?|menu|nav\w*|pagination|promo\w*|recommended|related|share|sharing|skip|social|sponsor\w*|tags?|toolbar)(?=$|[\s_-]|\d)",
    re.IGNORECASE,
)
#: Names, from their start, of articles that are no main text: "tag-news" and "has-sidebar" are on main articles as well.
_ASIDE_NAME = re.compile(r"(?:^|\s)(?:comments?|commentlist|disqus|repl(?:y|ies)|responses?|related|recommended|teasers?|promo\w*|ads?|advert\w*|widgets?)(?=$|[\s_-]|\d)", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template|textarea|svg|iframe|object)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)


class _Block:
    __slots__ = ("parts", "link_parts", "mark", "heading", "text", "n", "density")

    def __init__(self, mark: int, heading: bool):
        self.parts: list[str] = []
        self.link_parts: list[str] = []
        self.mark, self.heading = mark, heading


def _names(attributes: str | None, pattern: re.Pattern) -> bool:
    return bool(attributes) and any(pattern.search(next(filter(None, a), "")) for a in _ATTRIBUTE.findall(attributes))


def blocks(html: str | None) -> list[_Block]:
    """The page's blocks that have text, in order."""
    out: list[_Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, stands apart, in the article
    own = heading = begun = False  # own: of this tag only; begun: the main element or first article has been met
    link = 0
    block = _Block(0, False)

    for m in _TOKEN.finditer(html or ""):
        _, closing, tag, attributes, text = m.groups()
        if text is not None:
            block.parts.append(text)
            if link:
                block.link_parts.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            block.parts.append(" ")
        if tag not in _BLOCK and tag not in _FRAME:
            continue
        if closing:
            if tag in _FRAME and any(t == tag for t, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            own = heading = False
        else:
            apart, inside = stack[-1][1:] if stack else (False, False)
            hidden = bool(attributes) and bool(_HIDDEN.search(attributes))
            heading = tag in _HEADING
            if tag in ("article", "main"):
                own = hidden or tag == "article" and _names(attributes, _ASIDE_NAME)
                if not begun and not own and not apart:
                    stack.clear()
                    begun = True
                inside, link = True, 0
            else:
                own = hidden or tag in _APART_TAG or tag == "header" and not inside or _names(attributes, _APART_NAME) or inside and (tag in ("nav", "menu") or _names(attributes, _INSET_NAME))
            if tag in _FRAME:
                stack.append((tag, apart or own, inside))
                own = False
            elif tag in ("body", "html"):
                own = False
        if tag in _BLOCK:
            if tag != "p" and tag not in _HEADING:
                link = 0 if tag != "li" else link
            if block.parts:
                out.append(block)
            apart, inside = stack[-1][1:] if stack else (False, False)
            block = _Block(1 if apart or own else -1 if inside else 0, heading)
    out.append(block)
    kept = []
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
        if b.text:
            b.n = b.text.count(" ") + 1
            b.density = len(" ".join(b.link_parts).split()) / b.n
            kept.append(b)
    return kept


def features(found: list[tuple[int, float, bool, int]]) -> list[tuple[float, ...]]:
    """found: words, link density, heading and mark of a page's blocks; a row of numbers for each block."""
    n = [0, 0, *(f[0] for f in found), 0, 0]
    d = [0.0, *(f[1] for f in found), 0.0]
    return [(n[i + 2], d[i + 1], n[i + 1], d[i], n[i + 3], d[i + 2], n[i], n[i + 4], h, mark) for i, (_, _, h, mark) in enumerate(found)]


def rows(found: list[_Block]) -> list[tuple[float, ...]]:
    return features([(b.n, b.density, b.heading, b.mark) for b in found])


def grown(table: list[tuple[tuple[float, ...], int]], plan: tuple[tuple[tuple[int, ...], int, int], ...] = PLAN):
    """A decision tree by Gini impurity: a class, or (feature, threshold, at most, above).

    plan: numbers that may split, splits above a leaf and blocks in a leaf, from the root on. A leaf of one step that
    still holds both classes is opened by the next.
    """
    y = [label for _, label in table]
    (of, depth, least), further = plan[0], plan[1:]

    def leaf():
        return int(2 * sum(y) >= len(y)) if not further or len(set(y)) == 1 else grown(table, further)

    if depth == 0 or len(set(y)) == 1 or len(y) < 2 * least:
        return leaf()

    def impurity(n: int, kept: int) -> float:
        return 2 * kept * (n - kept) / n

    best = None
    for f in of:
        ordered, before = sorted((x[f], label) for x, label in table), 0
        for i, ((lo, label), (hi, _)) in enumerate(zip(ordered, ordered[1:], strict=False), 1):
            before += label
            if lo != hi and min(i, len(y) - i) >= least:
                value = impurity(i, before) + impurity(len(y) - i, sum(y) - before)
                if best is None or value < best[0] - 1e-12:
                    best = (value, f, (lo + hi) / 2)
    if best is None:
        return leaf()
    _, f, t = best
    low, high = (grown([r for r in table if (r[0][f] > t) == above], ((of, depth - 1, least), *further)) for above in (False, True))
    return low if isinstance(low, int) and low == high else (f, t, low, high)


def labelled(variants: int = VARIANTS) -> list[tuple[tuple[float, ...], int]]:
    """Features and label of each block of the labelled pages, and of variants of them whose running text is longer or shorter."""
    r, out = random.Random(5), []
    for page in LABELLED.strip().splitlines():
        cells = [re.fullmatch(r"([+-])(\d+)(?:@([\d.]+))?(h?)([!=]?)(?:\*(\d+))?", c).groups() for c in page.split()]
        cells = [(label, int(n), float(d or 0), h == "h", {"!": 1, "=": -1, "": 0}[mark]) for label, n, d, h, mark, many in cells for _ in range(int(many or 1))]
        for k in range(1 + variants):
            found = [(n if d or not k or not any(c[4] < 0 for c in cells) else max(1, round(n * r.choice(LENGTHS))), d, h, mark) for _, n, d, h, mark in cells]
            out += zip(features(found), [int(c[0] == "+") for c in cells], strict=True)
    return out


@cache
def trained():
    """The tree of the labelled table."""
    return grown(labelled())


def is_main(tree, x: tuple[float, ...]) -> bool:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if x[f] <= t else high
    return bool(tree)


def main_text(html: str | None, tree=None) -> str:
    found = blocks(html)
    tree = trained() if tree is None else tree
    return "\n\n".join(b.text for b, x in zip(found, rows(found), strict=True) if is_main(tree, x))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
