"""Main text of web pages by two-pass block rules.

Pass one splits a page into blocks and classifies each by its stop-word density, length and
link density. Where the page as a whole has few stop words it is in a language that STOP does
not hold, and length and link density decide alone. Pass two gives each undecided block, a
short one or one of few stop words, the label of its nearest decided neighbours. The element a
block stands in is a feature: blocks of navigation, forms and the like are left out before,
and blocks of an article have only each other as neighbours.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stop words of the languages served, lower case.
STOP = frozenset(
    "the of and to in is that it for as with was on be by this are or from at an not but have his they you which had we were "
    "le la les de des du un une et est que qui dans pour pas sur au en par il elle avec ce se ne plus "
    "der die das und ist nicht ein eine zu den von mit sich auf für dem im des auch als es an "
    "el los las una y por con no su para al lo como más del se o pero sus".split()
)
#: Elements whose content is never text of the page.
DROPPED = frozenset("head title script style noscript template textarea select option button svg iframe object embed canvas audio video map datalist".split())
#: Elements that hold a page's surroundings.
AROUND = frozenset("nav footer aside form menu dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark surroundings, and those that mark reader comments.
MARKS = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent copyright disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related recommended search share sharing sidebar sitemap skip social sponsor sponsored subscribe subscription signup login toolbar topbar widget alert complementary contentinfo".split())
REPLIES = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
#: Thresholds of pass one: words in a short and in a long block, stop-word shares, link share.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 12, 25, 0.10, 0.20, 0.4

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STEP, _VALUE = re.compile(r"[>=]"), re.compile(r"\s*([\"']?)")
_AFTER = re.compile(r"[\s>]")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that hold text themselves, on which only the words of NOTES mark surroundings.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption span b i em strong code q cite mark small sub sup".split())
NOTES = frozenset("ad ads adbox advert adverts advertisement advertising cookie cookies consent copyright disclaimer gdpr newsletter notice notices promo promoted sponsor sponsored".split())
#: Of MARKS those that prose may carry too: in an article such blocks are left to the rules.
DOUBTFUL = frozenset("promotion recommended related search share sharing skip social widget".split())
_PIECE = re.compile(r"[A-Za-z]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORDS = re.compile(r"[^\W\d_]+")
#: Letters of scripts that put no spaces between words (Thai to Khmer, kana, Han); two count as a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title")}

DOUBT, NEUTRAL, ARTICLE, SURROUND, REPLY = -1, 0, 1, 2, 3


def _tag_end(page: str, pos: int) -> int:
    """Where the '>' of a tag is, read from behind its name on; the page's length if it has none. Only values are quoted."""
    while (m := _STEP.search(page, pos)) is not None:
        if m[0] == ">":
            return m.start()
        quote = _VALUE.match(page, m.end())
        if quote[1]:
            pos = page.find(quote[1], quote.end()) + 1
            if not pos:
                break
        else:
            after = _AFTER.search(page, quote.end())
            pos = after.start() if after else len(page)
    return len(page)


def _kind(tag: str, attrs: str, now: int) -> int:
    """What the content of an element is, given what its parent's is."""
    if now == REPLY:
        return REPLY
    marks: set[str] = set()
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            for x in re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").split():
                marks.update(_PIECE.findall(x.lower()))
    if tag != "body" and tag != "html":
        if tag in TEXTUAL:
            marks &= NOTES
        if marks & REPLIES:
            return REPLY
        if tag in ("article", "main"):
            return SURROUND if now == SURROUND and marks & MARKS else ARTICLE
        if tag in AROUND or marks & MARKS - DOUBTFUL:
            return SURROUND
        if marks & DOUBTFUL:
            return DOUBT if now in (ARTICLE, DOUBT) else SURROUND
        if tag == "header" and now not in (ARTICLE, DOUBT):
            return SURROUND
    return now


def blocks(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, kind, characters inside links, whether it is a heading) of each block in page order; white space made one space."""
    out: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # elements on the stack by tag
    inline: list[Counter[str]] = [Counter()]  # inline ones above each open block
    within: list[str] = []  # open blocks
    endless: set[str] = set()  # elements without another end tag from here on
    kind, links, buf, linked = NEUTRAL, 0, [], 0

    def flush() -> None:
        nonlocal buf, linked
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            if text:
                out.append((text, kind, linked, any(opened[h] for h in HEADINGS)))
            buf, linked = [], 0

    def push(tag: str, inner: int) -> None:
        nonlocal kind, links
        stack.append((tag, inner))
        opened[tag] += 1
        if tag in BLOCK:
            inline.append(Counter())
            within.append(tag)
        else:
            inline[-1][tag] += 1
        kind, links = inner, links + (tag == "a")

    def close(tag: str) -> None:
        """Take elements off the stack until one of this tag has gone."""
        nonlocal kind, links
        gone = ""
        while gone != tag:
            gone, _ = stack.pop()
            opened[gone] -= 1
            if gone in BLOCK:
                inline.pop()
                within.pop()
            else:
                inline[-1][gone] -= 1
            links -= gone == "a"
        kind = stack[-1][1] if stack else NEUTRAL

    pos, n = 0, len(page)
    while pos < n:
        opening = page.find("<", pos)
        m = _NAME.match(page, opening) if opening >= 0 else None
        if opening != pos or (m is None and page[pos + 1 : pos + 2] not in ("!", "?")):
            to = n if opening < 0 else opening if opening > pos else pos + 1
            buf.append(page[pos:to])
            linked += len(buf[-1].strip()) if links else 0
            pos = to
            continue
        if m is None:
            end = page.find("-->", pos + 4) + 3 if page.startswith("<!--", pos) else page.find(">", pos) + 1
            pos = end if end > pos else n
            continue
        end = _tag_end(page, m.end())
        if end == n:
            break  # the page ends inside a tag
        pos, tag, attrs = end + 1, m[2].lower(), page[m.end() : end]
        if tag == "br":
            buf.append(" ")
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            # an inline end tag does not close a block
            if (opened if tag in BLOCK else inline[-1])[tag]:
                close(tag)
            continue
        if tag in DROPPED:
            if tag in BLOCK or tag == "title":
                flush()
            if attrs.endswith("/") or tag in VOID or tag in endless:
                continue
            end = (_END.get(tag) or re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)).search(page, pos)
            if end is None and tag not in _END:
                endless.add(tag)
                continue  # never closed: what follows still counts
            if end is None:
                break
            after = page.find(">", end.end())
            pos = n if after < 0 else after + 1
            buf.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if within and within[-1] in ("p", *_CLOSES.get(tag, ())):
                close(within[-1])
        if tag in VOID or attrs.endswith("/"):
            continue
        inner = _kind(tag, attrs, kind)
        if inner != kind and tag not in BLOCK:
            flush()
        push(tag, inner)
    flush()
    return out


def size(text: str) -> int:
    """Number of words; in scripts without spaces half the letters."""
    unspaced = len(_UNSPACED.findall(text))
    return len(_WORDS.findall(_UNSPACED.sub(" ", text) if unspaced else text)) + unspaced // 2


def served(page: list[tuple[str, int, int, bool]]) -> bool:
    """Whether the blocks that are not surroundings or links have the stop words of a language in STOP."""
    words = [w for text, kind, linked, _ in page if kind < SURROUND and linked <= LINKS * len(text) for w in _WORDS.findall(text.lower())]
    return sum(w in STOP for w in words) >= STOP_LOW * len(words)


def classify(text: str, kind: int, linked: int, known: bool = True) -> int:
    """Pass one: 1 text, -1 surroundings, 0 undecided; known: the page's language is served."""
    density = min(1.0, linked / len(text))
    words = _WORDS.findall(text.lower())
    n = (len(words) if known else size(text)) or 1
    if density > LINKS:
        return 0 if kind == ARTICLE and n < LONG else -1
    if n < SHORT:
        return 0
    stop = sum(w in STOP for w in words) / (len(words) or 1)
    return int(stop >= STOP_HIGH or (n >= LONG and (stop >= STOP_LOW or not known)))


def inherit(first: list[int], default: int, leads: list[bool] | None = None) -> list[int]:
    """Pass two: an undecided label becomes that of the nearest decided one; default where none is decided.

    On a tie that of the one before, or after for a block that leads what follows.
    """
    n, near = len(first), []
    for seq in (range(n), range(n - 1, -1, -1)):
        side: list[tuple[int, int]] = [(n, 0)] * n  # distance and label
        at = None
        for i in seq:
            at = i if first[i] else at
            side[i] = side[i] if at is None else (abs(i - at), first[at])
        near.append(side)
    leads = leads or [False] * n
    return [label or (z if after < before + lead and z else a or z) or default for label, (before, a), (after, z), lead in zip(first, *near, leads, strict=True)]


def main_text(page: str | None) -> str:
    """Blocks labelled text, joined by one space in page order; empty for null or empty pages.

    Blocks of surroundings are no neighbours of others; those in an article element, those
    outside and those in an article's elements marked as doubtful are three sequences. In an
    article without a decided block all count as text. On a
    page without a block of text the undecided ones do, if no block is decided, or if they
    have SHORT words or more in a language that is not served.
    """
    b = [x for x in blocks(page) if x[1] < SURROUND] if page else []
    known = served(b)
    first = [classify(*x[:3], known) for x in b]
    label = list(first)
    for kind, default in ((ARTICLE, 1), (NEUTRAL, -1), (DOUBT, -1)):
        at = [i for i, x in enumerate(b) if x[1] == kind]
        for i, x in zip(at, inherit([first[i] for i in at], default, [b[i][3] for i in at]), strict=True):
            label[i] = x
    if not any(x > 0 for x in label):
        left_open = [x[0] for x, decided in zip(b, first, strict=True) if not decided]
        return " ".join(left_open) if not any(first) or not known and sum(map(size, left_open)) >= SHORT else ""
    return " ".join(x[0] for x, keep in zip(b, label, strict=True) if keep > 0)


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A map over partitions: no shuffle, one page in memory beyond its batch. Null or empty
    html gives empty text and 0; null ids and urls pass through; repeated rows are repeated;
    other columns are not read.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_extract, SCHEMA)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
