"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Each word scores by where it stands (in a link, in running text, in a container
that is left out, inside or outside a marked article), each tag by its name and place; the scores are logarithms of how much more often such a token is inside the
content of labelled pages than outside. Content words come out positive, tags and words of menus negative, and one linear
scan finds the contiguous region with the largest sum. Containers that are never part of an article (menus, headers,
footers, sidebars, notices, adverts, forms, comments of readers) are left out of the region's text.

Labelled pages are those that mark their content themselves, with an article or main element. Other pages are scored by
what is learned from the same labelled pages with the mark hidden: how likely a word is content in a block of such a
length, that ends a sentence or doesn't, is a heading or mostly links, in a container that holds much or little of the
page's sentences. A short line far from the sentences is a notice, the same line among them a paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.columns import id_back, id_text
from rillflow.llm.tokens import batches

#: Pages that weights are learned from, about; all of a smaller table.
SAMPLE = 20_000
#: Features that get a weight, the most frequent ones; others are names of tags that nearly no page has.
FEATURES = 500

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|textarea|select|title)\b(?:[^"'>]|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head nav header footer aside form button menu dialog".split())
CONTENT = frozenset("article main".split())
WHOLE = frozenset("html body main article".split())
_NAME = (
    r"(?:ads?|advert[^\W_]*|banner|sponsor[^\W_]*|promo[^\W_]*|sidebar|side|menu|nav[^\W_]*|breadcrumbs?|header|footer|foot|"
    r"comments?|disqus|replies|responses|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|login|share|"
    r"sharing|social|related|recommended|widget|copyright|toolbar|pagination|pager|skip|legal|disclaimer|imprint|topbar|"
    r"bottombar|navbar|masthead)"
)
#: A whole name of a class, id or role: one word, or words that say which part of the page it is, as in site-footer or
#: comments-list. Names that say how a page is laid out (no-sidebar, has-header, comments-open) are others.
SKIPPED_NAME = re.compile(
    rf"(?<!\S)(?:(?:site|page|main|global|top|bottom|primary|secondary)[_-]+)?{_NAME}"
    rf"(?:[_-]+(?:{_NAME}|\d+(?:x\d+)?|area|bar|block|box|buttons?|container|content|form|icons?|inner|items?|links?|list|posts?|reply|respond|section|slot|unit|wrap|wrapper))*(?!\S)",
    re.IGNORECASE,
)
#: What a tag takes off that nothing is known of, the most that one takes off of a page without a mark, and the difference
#: below which scores are equal.
LEAST_TAG, MOST_TAG, TIE = -0.05, 0.3, 1e-9
#: Elements that blocks lie next to each other in; those between them and a block, as lists and tables, are looked through.
TRANSPARENT = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote figure figcaption pre".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SENTENCE = re.compile(r"""[.!?…。！？:;]["'”’»)\]]*\s*\Z""")
#: Words of a short and of a long block; shares of the page's sentences that a container of some and of most of it holds.
#: Fewer words of sentences on a page than FEW say nothing about its containers.
SHORT, LONG, SOME, MOST, FEW = 8, 25, 0.05, 0.3, 12
# Fixed values, before anything is learned: words that blocks of a kind have in content and outside it, by the container.
PRIOR = {
    "heading": {"any": (40, 5), "most": (40, 5), "some": (10, 15), "little": (5, 30)},
    "long sentence": {"any": (200, 5), "most": (200, 5), "some": (100, 10), "little": (60, 20)},
    "middle sentence": {"any": (100, 5), "most": (100, 5), "some": (40, 20), "little": (8, 30)},
    "short sentence": {"any": (60, 10), "most": (60, 10), "some": (15, 20), "little": (4, 40)},
    "long line": {"any": (100, 10), "most": (100, 10), "some": (30, 20), "little": (15, 30)},
    "middle line": {"any": (40, 15), "most": (40, 15), "some": (10, 30), "little": (4, 50)},
    "short line": {"any": (30, 15), "most": (30, 15), "some": (6, 30), "little": (3, 60)},
    "links": {"any": (10, 40), "most": (10, 40), "some": (4, 60), "little": (2, 80)},
    "skipped": {"any": (1, 60), "most": (1, 60), "some": (1, 60), "little": (1, 60)},
}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


Token = tuple[str, str, str, bool, bool, int]


def tokens(html: str) -> list[Token]:
    """(kind, value, feature, skipped, content, container) in page order: kind is ``text``, ``tag`` or ``break``.

    ``container`` is where the element starts whose blocks the token is among, below 0 in a heading. An element that
    holds text but no other element than inline ones is a block itself, of the element around it.

    An element that is left open ends with the element around it, at an end tag of an outer element or with the page.
    Names say nothing about html, body, main and article elements, but for an article within an article (a reader's
    comment), nor about elements that hold all the main and article elements of a page. Where others stand elsewhere, an
    element of such a name that holds articles is a list of teasers or comments and left out.
    """
    out, holders, elsewhere = _tokens(html)
    return _placed(_tokens(html, holders)[0] if holders and not elsewhere else out)


def _placed(found: list[Token]) -> list[Token]:
    """The tokens, with those of elements that are blocks themselves placed in the element around."""
    out = list(found)
    around: dict[int, int] = {}  # of a container the one that it stands in
    blocks: Counter[int] = Counter()
    last = 0
    texts: list[int] = []

    def container(t: Token) -> int:
        return -1 - t[5] if t[5] < 0 else t[5]

    for i, t in enumerate(found):
        here = container(t)
        if here != last and here > last:
            around.setdefault(here, last)
        last = here
        if t[0] == "break":
            if texts:
                blocks[container(found[texts[0]])] += 1
            texts = []
        elif t[0] == "text" and t[2]:
            texts.append(i)
    if texts:
        blocks[container(found[texts[0]])] += 1
    inner = set(around.values())
    for i, t in enumerate(found):
        here = container(t)
        if here in around and blocks[here] == 1 and here not in inner:
            out[i] = (*t[:5], -1 - around[here] if t[5] < 0 else around[here])
    return out


def _tokens(html: str, spared: frozenset[int] | set[int] = frozenset()) -> tuple[list[Token], set[int], bool]:
    """The tokens; where elements start that are left out by name and hold main or article elements; whether there are
    such elements that are not left out. The names of elements that start at ``spared`` are not looked at.
    """
    holders: set[int] = set()
    elsewhere = False
    out: list[Token] = []
    # name, skipped, content, link, start if left out by name, start of the container, in a heading
    open_: list[tuple[str, bool, bool, bool, int | None, int, bool]] = []
    at = 0

    def state() -> tuple[bool, bool, bool]:
        return (open_[-1][1], open_[-1][2], open_[-1][3]) if open_ else (False, False, False)

    def around() -> int:
        container, heading = (open_[-1][5], open_[-1][6]) if open_ else (0, False)
        return -1 - container if heading else container

    def text(raw: str) -> None:
        if raw.strip():
            skipped, content, link = state()
            where = "skipped" if skipped else "link" if link else "plain"
            out.append(("text", raw, where + " inside" * content, skipped, content, around()))
        elif raw:
            out.append(("text", raw, "", *state()[:2], around()))

    for m in TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        skipped, content, link = state()
        inline = name in INLINE
        if name == "br":
            out.append(("text", " ", "", skipped, content, around()))
        elif m[2]:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            out.append(("tag" if inline else "break", name, "/" + name + " inside" * content, skipped, content, around()))
            if depth is not None and not (inline and any(o[0] not in INLINE for o in open_[depth + 1 :])):
                del open_[depth:]
        else:
            names = " ".join(filter(None, (x for g in NAMED.findall(m[4]) for x in g))) if m[4] else ""
            whole = name in WHOLE and not (name == "article" and any(o[0] == name for o in open_))
            named = bool(names and not whole and m.start() not in spared and SKIPPED_NAME.search(names))
            skips = skipped or name in SKIPPED or named
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                like = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, (name,))
                depth = len(open_) - 1
                while depth >= 0 and (open_[depth][0] in INLINE or open_[depth][0] == "p") and open_[depth][0] not in like:
                    depth -= 1
                if depth >= 0 and open_[depth][0] in like:
                    del open_[depth:]
                    skips = state()[0] or named
            if name in CONTENT and not content:
                if not skipped:
                    elsewhere = True
                elif not any(o[0] in SKIPPED for o in open_):
                    holders.update(o[4] for o in open_ if o[4] is not None)
            inside = content or name in CONTENT
            out.append(("tag" if inline else "break", name, name + " inside" * inside, skips, inside, around()))
            if name not in VOID and not m[4].endswith("/"):
                within, heading = (open_[-1][5], open_[-1][6]) if open_ else (0, False)
                container = within if name in TRANSPARENT else m.start()
                open_.append((name, skips, inside, link or name == "a", m.start() if named else None, container, heading or name in HEADING))
    text(html[at:])
    return out, holders, elsewhere


def block_kinds(found: list[Token], named: bool = True) -> list[str]:
    """For each token the kind of its block and of the block's container, empty between blocks.

    Blocks that are left out for the name of an element are a kind of their own, unless names are to be looked away from.
    """
    edges = [0, *(i + 1 for i, t in enumerate(found) if t[0] == "break"), len(found) + 1]
    blocks: list[tuple[int, int, str, int, int]] = []  # tokens from, to, kind, container, words
    sentences: Counter[int] = Counter()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        texts = [t for t in found[a : b - 1] if t[0] == "text" and t[2]]
        if not texts:
            continue
        words = sum(len(t[1].split()) for t in texts)
        links = sum(len(t[1].split()) for t in texts if t[2].startswith("link"))
        skipped = sum(len(t[1].split()) for t in texts if t[2].startswith("skipped"))
        container = texts[0][5]
        if named and 2 * skipped > words:
            kind = "skipped"
        elif 2 * links > words:
            kind = "links"
        elif container < 0:
            kind = "heading"
        else:
            size = "short" if words < SHORT else "middle" if words < LONG else "long"
            ended = SENTENCE.search(unescape(texts[-1][1])) is not None
            kind = f"{size} {'sentence' if ended else 'line'}"
            if ended or words >= LONG:
                sentences[container] += words
        blocks.append((a, b - 1, kind, -1 - container if container < 0 else container, words))
    total = sum(sentences.values())
    out = [""] * len(found)
    for a, b, kind, container, _ in blocks:
        share = sentences[container] / max(total, 1)
        where = "any" if total < FEW else "most" if share >= MOST else "some" if share >= SOME else "little"
        for i in range(a, b):
            out[i] = f"{kind} {where}"
    return out


def count_features(pages: list[str | None]) -> tuple[Counter, Counter]:
    """How often each feature is in content and outside it, over pages that mark their content.

    Words count by their blocks too, but on pages with few sentences, whose containers say nothing.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        found = tokens(page or "")
        if any(t[4] for t in found):
            for (kind, value, feature, skipped, content, _), block, bare in zip(found, block_kinds(found), block_kinds(found, named=False), strict=True):
                if feature:
                    count, side = len(value.split()) if kind == "text" else 1, inside if content and not skipped else outside
                    side[("word " if kind == "text" else "tag ") + feature] += count
                    for name in {block, bare} if kind == "text" else ():  # bare: what it is on a page without names
                        if name and not name.endswith(" any"):
                            side["block " + name] += count
    return inside, outside


def _bare_score(kind: str, count: int, feature: str, block: str, weights: dict[str, float]) -> float:
    """The score of a token of a page without a mark: the odds of its block for a word, a small loss for a tag."""
    if kind != "text":
        return weights.get("bare tag " + feature, LEAST_TAG)
    if not block or not feature:
        return 0.0
    size, _, where = block.rpartition(" ")
    return count * weights.get("block " + block, _odds(0, 0, PRIOR[size][where]))


def _odds(inside: int, outside: int, prior: tuple[int, int] = (1, 1)) -> float:
    return float(np.log(inside + prior[0]) - np.log(outside + prior[1]))


def _score(kind: str, count: int, feature: str, weights: dict[str, float]) -> float:
    """The score of a token of a page that marks its content.

    Words: what was learned, positive in running text, nothing where an article holds something to leave out. Tags: negative.
    """
    if not feature:
        return 0.0
    if kind != "text":
        return min(max(weights.get("tag " + feature, LEAST_TAG if feature.endswith(" inside") else -0.5), -1.0), -0.05)
    where, _, inside = feature.partition(" ")
    if where == "skipped":
        return 0.0 if inside else count * min(weights.get("word " + feature, -1.0), -0.5)
    learned = weights.get("word " + feature, 1.0 if where == "plain" else 0.2)
    return count * (max(learned, 0.5) if where == "plain" or inside else learned)


def scores(found: list[Token], weights: dict[str, float]) -> np.ndarray:
    """The score of each token."""
    counts = [len(t[1].split()) if t[0] == "text" else 1 for t in found]
    if any(t[4] for t in found):
        return np.array([_score(t[0], n, t[2], weights) for t, n in zip(found, counts, strict=True)])
    return np.array([_bare_score(t[0], n, t[2], b, weights) for t, n, b in zip(found, counts, block_kinds(found), strict=True)])


def best_region(values: np.ndarray) -> tuple[int, int] | None:
    """(start, end) of the contiguous region with the largest sum, of equal ones the longest that ends last; one scan."""
    if not len(values):
        return None
    sums = np.concatenate([[0.0], np.cumsum(values)])
    least = np.minimum.accumulate(sums[:-1])
    gains = sums[1:] - least
    if gains.max() <= 0:
        return None
    end = int(np.flatnonzero(gains >= gains.max() - TIE)[-1]) + 1
    return int(np.flatnonzero(sums[:end] <= least[end - 1] + TIE)[0]), end


def extract(html: str | None, weights: dict[str, float]) -> str:
    """The text of the best region of a page: its blocks in order, one a line."""
    found = tokens(html or "")
    region = best_region(scores(found, weights))
    if region is None:
        return ""
    start, end = region
    while start > 0 and found[start - 1][0] != "break":  # a block is taken whole
        start -= 1
    while end < len(found) and found[end][0] != "break":
        end += 1
    blocks, block = [], []
    for kind, value, _, skipped, *_ in found[start:end]:
        if kind == "break":
            blocks.append("".join(block))
            block = []
        elif kind == "text" and not skipped:
            block.append(value)
    blocks.append("".join(block))
    lines = (" ".join(unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def fit_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Scores of words and tags, from about ``sample`` pages chosen by the hash of their id; at most some hundred."""
    total = pages.count()
    share = min(1.0, sample / max(total, 1))
    chosen = pages.where(F.pmod(F.xxhash64(F.coalesce(F.col("page_id").cast("long"), F.lit(0))), F.lit(1_000_000)) < int(share * 1_000_000))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside = Counter(), Counter()
        for frame in frames:
            more = count_features(frame["html"].tolist())
            inside += more[0]
            outside += more[1]
        keys = sorted({*inside, *outside})
        yield pd.DataFrame({"feature": keys, "inside": [inside[k] for k in keys], "outside": [outside[k] for k in keys]}).astype({"feature": str, "inside": "int64", "outside": "int64"})

    counts = chosen.select("html").mapInPandas(work, "feature string, inside long, outside long")
    counts = counts.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(F.desc(F.col("inside") + F.col("outside")), "feature").limit(FEATURES).collect()
    return log_odds([tuple(r) for r in counts])


def log_odds(counts: list[tuple[str, int, int]]) -> dict[str, float]:
    """Scores of features counted (feature, inside, outside): words and tags of marked pages, blocks and ``bare`` tags of others."""
    words = [n for feature, *n in counts if feature.startswith("word ")]
    inside, outside = (sum(n[i] for n in words) + 1 for i in (0, 1))
    weights, bare = {}, {}
    for feature, *n in counts:
        if feature.startswith("block "):
            kind, _, where = feature.removeprefix("block ").rpartition(" ")
            weights[feature] = _odds(*n, PRIOR[kind][where])
            continue
        odds = float(np.log((n[0] + 0.5) / inside) - np.log((n[1] + 0.5) / outside))
        weights[feature] = max(-3.0, min(3.0, odds))
        if feature.startswith("tag "):
            both = bare.setdefault("bare " + feature.removesuffix(" inside"), [0, 0])
            both[:] = [both[0] + n[0], both[1] + n[1]]
    # a tag takes off more, the more often it stands outside
    return weights | {feature: -MOST_TAG * (n[1] + 1) / (sum(n) + 2) for feature, n in bare.items()}


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text and its length in code points.

    A null or empty html has the text ``""``, as has a page without content; null ids and urls are passed on, rows that
    repeat are extracted each, other columns are not read. A page is looked at in the task that reads it, in time that
    is linear in its length; nothing is shuffled.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "html"):
            text = [extract(h, weights) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    found = pages.select(id_text("page_id"), "url", "html").mapInPandas(work, "page_id string, url string, text string, n_chars long")
    return id_back(found, "page_id")
