"""Main text of web pages: a linear-chain conditional random field over the leaf blocks.

A leaf block is a run of text between block-level tags.  Its features are its ancestors' tags and
the words of their class, id and role attributes, and properties of its text and links.  Weights
are learnt from labelled pages by maximum likelihood; the best labelling of a whole page is found
by the Viterbi algorithm.

Defined results: null or empty html gives an empty text; a page cut anywhere gives the blocks so
far; null and repeated ids are carried through; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.llm.labelled_pages import labelled_pages

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("iframe noscript object script select style svg template textarea title video audio canvas".split())
RAW_TAGS = frozenset("script style textarea title".split())
# a tag that starts ends an open one of these, up to the nearest container
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
} | {tag: {"p"} for tag in BLOCK_TAGS - {"body", "html", "p", "li", "dt", "dd", "tr", "td", "th", "button", "label"}}
BARRIERS = frozenset("article aside blockquote body div footer form header main nav ol section table ul dl".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


@lru_cache(maxsize=4096)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of an ancestor: its tag and the words of its class, id and role."""
    found = [f"<{tag}"]
    for groups in _ATTRIBUTE.findall(attributes):
        found += [f".{part}" for part in _PART.findall("".join(groups).lower())]
    return tuple(found)


class Block:
    __slots__ = ("linked", "parent", "path", "text")

    def __init__(self, text: str, path: tuple, parent: str, linked: float):
        self.text, self.path, self.parent, self.linked = text, path, parent, linked


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order: references decoded, white space made single, trimmed."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    inside_link = 0
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                names = dict.fromkeys(n for _, found in stack for n in found)
                blocks.append(Block(text, tuple(names), next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), ""), min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(text):
        nonlocal linked
        if text:
            parts.append(text)
            if inside_link:
                linked += len(text)

    at = 0
    while found := _TAG.search(page, at):
        say(page[at:found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if found[1]:
            where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            # an inline tag does not close the block around it
            if where is not None and (block or not any(t in BLOCK_TAGS for t, _ in stack[where + 1:])):
                inside_link -= sum(t == "a" for t, _ in stack[where:])
                del stack[where:]
        elif tag in SILENT_TAGS:
            if not found[3].endswith("/"):
                closing = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                # an element that holds markup and is never closed silences nothing; one that holds raw text, the rest
                at = closing.end() if closing else len(page) if tag in RAW_TAGS else at
        elif tag in VOID_TAGS:
            if tag == "br":
                say(" ")
        else:
            if tag in ENDS:
                for k in range(len(stack) - 1, -1, -1):
                    name = stack[k][0]
                    if name in ENDS[tag]:
                        inside_link -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if name in BARRIERS:
                        break
            stack.append((tag, _names(tag, found[3])))
            inside_link += tag == "a"
    say(page[at:])
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features each block has."""
    out = []
    n = len(blocks)
    for k, b in enumerate(blocks):
        text = b.text
        words = text.count(" ") + 1
        found = list(b.path)
        found.append(f"parent {b.parent}")
        found.append(f"words {min(6, int(math.log2(words + 1)))}")
        found.append("linked" if b.linked > 0.5 else "unlinked")
        if text[-1] in ".!?。":
            found.append("sentence")
        if "©" in text or "(c)" in text:
            found.append("copyright")
        if k == 0:
            found.append("first")
        if k == n - 1:
            found.append("last")
        out.append(found)
    return out


class Chain:
    """Linear-chain conditional random field with two labels: 1 is main text."""

    def __init__(self):
        self.weights: dict[str, tuple[float, float]] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]
        self.starts = [0.0, 0.0]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 0.002) -> Chain:
        """Maximum likelihood with a quadratic penalty, by gradient steps of adaptive size."""
        names = {f: k for k, f in enumerate(sorted({f for blocks, _ in pages for b in blocks for f in b}))}
        coded = [([np.array([names[f] for f in b]) for b in blocks], np.array(labels)) for blocks, labels in pages if blocks]
        theta = np.zeros(len(names) * 2 + 6)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        total = sum(len(labels) for _, labels in coded)
        for step in range(1, steps + 1):
            emit, move, start = theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
            grad = np.zeros_like(theta)
            g_emit, g_move, g_start = grad[:-6].reshape(-1, 2), grad[-6:-2].reshape(2, 2), grad[-2:]
            for blocks, labels in coded:
                score = np.array([emit[b].sum(axis=0) for b in blocks])
                n = len(score)
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = start + score[0]
                for k in range(1, n):
                    forward[k] = np.logaddexp(forward[k - 1, 0] + move[0], forward[k - 1, 1] + move[1]) + score[k]
                for k in range(n - 2, -1, -1):
                    after = score[k + 1] + backward[k + 1]
                    backward[k] = np.logaddexp(move[:, 0] + after[0], move[:, 1] + after[1])
                norm = np.logaddexp(forward[-1, 0], forward[-1, 1])
                marginal = np.exp(forward + backward - norm)
                marginal[np.arange(n), labels] -= 1
                for b, m in zip(blocks, marginal, strict=True):
                    g_emit[b] += m
                g_start += marginal[0]
                if n > 1:
                    pair = np.exp(forward[:-1, :, None] + move + (score + backward)[1:, None, :] - norm)
                    g_move += pair.sum(axis=0)
                    np.add.at(g_move, (labels[:-1], labels[1:]), -1)
            grad = grad / total + decay * theta
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad * grad
            theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        self.weights = {f: (float(theta[2 * k]), float(theta[2 * k + 1])) for f, k in names.items()}
        self.moves = theta[-6:-2].reshape(2, 2).tolist()
        self.starts = theta[-2:].tolist()
        return self

    def best(self, blocks: list[list[str]]) -> list[int]:
        """The labelling with the highest score (Viterbi); ties go to 0."""
        if not blocks:
            return []
        get, (m0, m1), none = self.weights.get, self.moves, (0.0, 0.0)
        a, b, back = self.starts[0], self.starts[1], []
        for k, found in enumerate(blocks):
            s0 = s1 = 0.0
            for f in found:
                w = get(f, none)
                s0 += w[0]
                s1 += w[1]
            if k:
                from0, from1 = b + m1[0] > a + m0[0], b + m1[1] > a + m0[1]
                back.append((int(from0), int(from1)))
                a, b = (b + m1[0] if from0 else a + m0[0]) + s0, (b + m1[1] if from1 else a + m0[1]) + s1
            else:
                a, b = a + s0, b + s1
        labels = [int(b > a)]
        for pointers in reversed(back):
            labels.append(pointers[labels[-1]])
        return labels[::-1]

    def extract(self, page: str) -> str:
        blocks = blocks_of(page)
        return " ".join(b.text for b, keep in zip(blocks, self.best(features(blocks)), strict=True) if keep)


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The field learnt from the labelled pages; they are few and fixed, so this is done on the driver."""
    pages = []
    for page, labels in labelled_pages():
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        pages.append((features(blocks), [int(x) for x in labels]))
    return Chain().fit(pages)


def main_text(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for every row."""
    chain = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [chain.extract(page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def labelled_blocks(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, n (place of the block), text, parent and is_main for every leaf block."""
    chain = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = blocks_of(batch.column(1)[k].as_py() or "")
                labels = chain.best(features(found))
                ids = pa.array([batch.column(0)[k].as_py()] * len(found), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(range(len(found)), pa.int64()), pa.array([b.text for b in found], pa.string()), pa.array([b.parent for b in found], pa.string()), pa.array([x == 1 for x in labels], pa.bool_())],
                    names=["page_id", "n", "text", "parent", "is_main"],
                )

    source = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, n long, text string, parent string, is_main boolean")
