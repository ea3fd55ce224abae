"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a list of text blocks. Each has its number of words and its link density,
those of the blocks before and after it, and what the containers around it are called.
A decision tree, trained when the job starts on a small labelled table of such
blocks, tells text from menus, adverts, notices, forms and comments.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evenhand.llm.common import Batches

#: Elements that are raw text up to their end tag, elements whose content is no text of the page but
#: that end with their parent, elements that end a block, and page furniture.
RAW = "script|style|noscript|iframe|textarea|title"
SILENT = frozenset("svg template object video audio canvas select button".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody"
    " td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
CONTAINERS = frozenset(
    "article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section"
    " table ul".split()
)
#: Words that name furniture, alone or as part of a class, id or role, see :func:`furniture_name`.
NAMES = re.compile(
    r"(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|cookies?|consent|gdpr|notices?|alert|newsletter"
    r"|subscribe|comments?|comment-?list|respond|repl(?:y|ies)|disqus|discussion|sidebar|side-?bar|widget|menu|nav"
    r"|navbar|navigation|breadcrumbs?|footer|masthead|header|share|social|related|recommend[a-z]*|popup|modal"
    r"|overlay|toolbar|login|signup|search|pagination|pager|copyright)"
)
#: Words before or after a furniture word with which the name speaks of the layout or the article instead.
STATES = frozenset(
    "has have had no not with without is are can show hide shows hides enabled disabled open closed layout theme style"
    " page body single template work works research reading".split()
)
#: Words that name the article, whose header is part of it.
ARTICLE_WORDS = frozenset("article main content post entry story page section".split())
MAIN_NAMES = re.compile(r"(?<![a-z])(?:article|main|content|post|entry|story)(?:[_-]?(?:body|text|content))?(?![a-z])")
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-z][^<>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def furniture_name(names: str, in_main: bool) -> bool:
    """Whether a class, id or role among ``names`` says that the container is page furniture.

    Each name counts as a whole: ``sidebar`` and ``right-sidebar`` do, ``has-sidebar`` and ``no-comments`` speak of the page's
    layout, and ``related-work`` is a section of an article. Of headers, those of an article belong to it.
    """
    for name in names.split():
        words = [word for word in re.split(r"[-_0-9]+", name) if word]
        if not words or STATES.intersection(words):
            continue
        if words[-1] == "header" and "site" not in words and (in_main or ARTICLE_WORDS.intersection(words)):
            continue
        if any(map(NAMES.fullmatch, [name, *words])):
            return True
    return False


class Held(NamedTuple):
    """An open silent element: blocks found before it (None up to the first break), and what was open by then."""

    name: str
    found: int | None
    containers: int
    within: int


class Block(NamedTuple):
    text: str
    words: int
    density: float
    in_main: bool
    furniture: bool
    named: bool
    heading: bool


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order. Elements that are never closed end with the page."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    # Open containers: name, in the main part, in furniture, in a container with a telling name.
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    # Open silent elements, and the blocks that were opened since the first of them.
    held: list[Held] = []
    within: list[str] = []
    links, heading, at = 0, False, 0

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            words = len(text.split(" "))
            share = min(1.0, len(unescape(" ".join(linked)).split()) / words)
            found.append(Block(text, words, share, *stack[-1][1:], heading))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if held and held[-1].found is None:
            return
        parts.append(text)
        if links:
            linked.append(text)

    def drop(name: str) -> bool:
        """End a silent element: blocks that were found in it go. Whether there were any."""
        at = next((k for k in range(len(held) - 1, -1, -1) if held[k].name == name), None)
        if at is None:
            return False
        first = held[at]
        del held[at:], within[first.within :]
        if first.found is None:
            return False
        parts.clear()
        linked.clear()
        del found[first.found :], stack[first.containers :]
        return True

    for token in TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if name == "a":
            links = 0 if token["end"] else 1
        elif name == "br" or token["raw"]:
            add(" ")
        elif name in SILENT:
            add(" ")
            # A second button or list ends the first.
            if (token["end"] or name in ("button", "select")) and drop(name):
                links, heading = 0, False
            if not token["end"] and not token["rest"].endswith("/"):
                held.append(Held(name, None, len(stack), len(within)))
        if name not in BREAKS:
            continue
        close()
        for k in range(len(held) - 1, -1, -1):
            if held[k].found is not None:
                break
            # Only an end tag within the parent takes away what follows this break.
            held[k] = held[k]._replace(found=len(found))
        if held and token["end"]:
            opened = next((k for k in range(len(within) - 1, -1, -1) if within[k] == name), -1)
            del within[max(opened, 0) :]
            while held and held[-1].within > opened:
                held.pop()
        elif held and name != "hr" and (name in CONTAINERS or within[-1:] != [name]):
            within.append(name)
        links, heading = 0, name in HEADINGS and not token["end"]
        if name not in CONTAINERS:
            continue
        if not token["end"]:
            _, main, furniture, named = stack[-1]
            names = " ".join("".join(x) for x in NAMED.findall(token["rest"])).lower()
            is_main = name in ("article", "main") or bool(MAIN_NAMES.search(names))
            # The heading part of an article belongs to it, other parts of that kind do not.
            apart = name in FURNITURE and not (name == "header" and main)
            bad_name = name not in ("article", "main", "body") and furniture_name(names, main)
            stack.append((name, main or is_main, furniture or apart, named or bad_name))
        else:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
    add(page[at:])
    close()
    return found


#: Small labelled table: words and link density of a block, of the one before and of the one after,
#: whether it is in the main part, in furniture, in a container with a telling name, a heading; is it main text.
LABELLED = (
    # paragraphs and headings of articles, long and short, some of them linked
    (80, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 0, 1),
    (45, 0.1, 9, 0.0, 30, 0.0, 1, 0, 0, 0, 1),
    (9, 0.0, 8, 0.0, 60, 0.0, 1, 0, 0, 1, 1),
    (3, 0.0, 1, 1.0, 50, 0.0, 1, 0, 0, 1, 1),
    (1, 0.0, 50, 0.0, 40, 0.0, 1, 0, 0, 0, 1),
    (2, 0.0, 3, 0.0, 2, 0.0, 1, 0, 0, 0, 1),
    (12, 0.3, 30, 0.0, 12, 0.0, 1, 0, 0, 0, 1),
    (5, 0.0, 20, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (8, 1.0, 30, 0.0, 30, 0.0, 1, 0, 0, 1, 1),
    (150, 0.05, 12, 0.6, 8, 0.0, 1, 0, 0, 0, 1),
    (6, 0.5, 40, 0.0, 35, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (60, 0.0, 40, 0.0, 3, 1.0, 1, 0, 0, 0, 1),
    (5, 0.0, 40, 0.0, 2, 1.0, 1, 0, 0, 0, 1),
    (30, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 1),
    (2, 0.0, 4, 1.0, 1, 1.0, 1, 0, 0, 0, 1),
    (16, 0.4, 30, 0.0, 25, 0.9, 1, 0, 0, 0, 1),
    # lists of links inside the main part
    (2, 1.0, 40, 0.0, 2, 1.0, 1, 0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0, 0),
    (6, 1.0, 5, 1.0, 7, 1.0, 1, 0, 0, 0, 0),
    (9, 0.9, 4, 1.0, 3, 1.0, 1, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 40, 0.0, 1, 0, 0, 0, 0),
    (3, 1.0, 3, 1.0, 10, 0.0, 1, 0, 0, 0, 0),
    (7, 1.0, 30, 0.0, 2, 1.0, 1, 0, 0, 0, 0),
    (15, 1.0, 30, 0.0, 14, 1.0, 1, 0, 0, 0, 0),
    # menus, headers, footers, sidebars, forms
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 0, 0),
    (10, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (40, 0.0, 60, 0.0, 5, 0.0, 0, 1, 0, 0, 0),
    (25, 0.0, 40, 0.0, 60, 0.0, 1, 1, 0, 0, 0),
    (70, 0.0, 40, 0.0, 60, 0.0, 1, 1, 0, 0, 0),
    (4, 0.0, 2, 1.0, 30, 0.0, 0, 1, 0, 1, 0),
    (3, 0.0, 60, 0.0, 4, 0.0, 1, 1, 0, 1, 0),
    (2, 1.0, 2, 1.0, 40, 0.0, 0, 1, 0, 0, 0),
    (1, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0, 0),
    (30, 0.0, 1, 1.0, 3, 1.0, 0, 1, 0, 0, 0),
    # adverts, notices, comments by the names of their containers
    (8, 0.0, 2, 1.0, 9, 0.0, 0, 0, 1, 0, 0),
    (50, 0.0, 60, 0.0, 45, 0.0, 0, 0, 1, 0, 0),
    (45, 0.0, 50, 0.0, 40, 0.0, 1, 0, 1, 0, 0),
    (14, 0.1, 30, 0.0, 30, 0.0, 1, 0, 1, 0, 0),
    (2, 0.0, 80, 0.0, 30, 0.0, 1, 0, 1, 1, 0),
    (90, 0.0, 20, 0.0, 5, 0.0, 1, 0, 1, 0, 0),
    (20, 0.0, 3, 1.0, 30, 0.0, 0, 1, 1, 0, 0),
    (60, 0.0, 3, 1.0, 3, 1.0, 1, 0, 1, 0, 0),
    (7, 0.0, 3, 1.0, 3, 1.0, 0, 0, 1, 0, 0),
    # pages without a marked main part
    (60, 0.0, 5, 0.0, 50, 0.0, 0, 0, 0, 0, 1),
    (30, 0.1, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (18, 0.0, 40, 0.0, 4, 0.5, 0, 0, 0, 0, 1),
    (22, 0.2, 2, 1.0, 20, 0.0, 0, 0, 0, 0, 1),
    (7, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1, 1),
    (8, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1, 1),
    (5, 0.0, 40, 0.0, 30, 0.1, 0, 0, 0, 0, 1),
    (50, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (35, 0.1, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 50, 0.0, 0, 0, 0, 0, 0),
    (4, 1.0, 60, 0.0, 5, 1.0, 0, 0, 0, 0, 0),
    (30, 0.8, 10, 0.9, 8, 0.5, 0, 0, 0, 0, 0),
    (20, 0.9, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (4, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 0),
    (6, 0.3, 4, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (3, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 1, 0),
    (8, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
)


class Tree(NamedTuple):
    """A leaf has a label; other nodes send rows with ``feature <= threshold`` to the left."""

    label: bool
    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Decision tree by Gini impurity; ties go to the first feature and the lowest threshold."""
    label = bool(2 * y.sum() >= len(y))
    if depth == 0 or y.all() or not y.any():
        return Tree(label)
    best = (2 * len(y), -1, 0.0)
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            sides = [y[x[:, feature] <= threshold], y[x[:, feature] > threshold]]
            impurity = sum(2 * s.sum() * (len(s) - s.sum()) / len(s) for s in sides)
            if impurity < best[0] - 1e-12:
                best = (impurity, feature, float(threshold))
    _, feature, threshold = best
    if feature < 0:
        return Tree(label)
    low = x[:, feature] <= threshold
    return Tree(label, feature, threshold, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def is_text(tree: Tree, row: tuple) -> bool:
    while tree.left is not None:
        tree = tree.left if row[tree.feature] <= tree.threshold else tree.right
    return tree.label


def trained(table: tuple = LABELLED) -> Tree:
    rows = np.array(table, float)
    return grow(rows[:, :-1], rows[:, -1].astype(bool))


def main_text(page: str, tree: Tree) -> tuple[list[str], int]:
    """Texts of the blocks that the tree takes for main text, and the number of all blocks."""
    found = blocks(page)
    none = Block("", 0, 0.0, False, False, False, False)
    kept = []
    for before, block, after in zip([none, *found], found, [*found[1:], none]):
        row = (block.words, block.density, before.words, before.density, after.words, after.density, *block[3:])
        if is_text(tree, row):
            kept.append(block.text)
    return kept, len(found)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks, n_kept)`` for every row of ``pages(page_id, url, html)``.

    A null or empty page has an empty text; null ids and addresses stay null, repeated rows
    are extracted each, an empty table gives no rows, unclosed and cut-off markup ends with the page, and no other
    column is read. A page is read whole, however long. Nothing is dropped from the blocks of the main text, and no text is cut.
    """
    tree = pages.sparkSession.sparkContext.broadcast(trained())

    def extracted(batches: Batches) -> Batches:
        for batch in batches:
            found = [main_text(page or "", tree.value) for page in batch.column("html").to_pylist()]
            whole = ["\n".join(kept) for kept, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(whole, pa.string()),
                    pa.array([len(text) for text in whole], pa.int64()),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([len(kept) for kept, _ in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    kinds = [pages.schema[name].dataType.simpleString() for name in ("page_id", "url")]
    schema = f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint, n_blocks bigint, n_kept bigint"
    return pages.select("page_id", "url", "html").mapInArrow(extracted, schema)
