"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between tags that break a block.
Each block has features of its ancestors' tags, classes, ids and roles and of
its text.  The field has two labels, article and other; it is trained by
gradient ascent on the labelled pages of :mod:`training_pages` and decoded by
the Viterbi algorithm.  The text of a page is that of its article blocks.

In a block, tags are dropped, character references decoded, white space (a line
break tag too) made one space, and ends trimmed.  Blocks without text are none.

Defined results
    null or empty html   the empty text
    an open head         ends at the first tag or text that may not stand in it
    no tags at all       one block, decoded like any other
    cut-off pages        read as far as they go; an unfinished tag is dropped
    repeated rows        every row keeps its own result row
    empty table          an empty result
    further columns      ignored, whatever their names
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

# HTML's element classes.
MATH = frozenset(
    "math maction annotation annotation-xml menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
INLINE = MATH | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
SILENT = frozenset("script style noscript template title iframe object canvas audio video textarea select".split())
#: What may stand in the head; any other tag, and text that is not blank, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements whose content is read raw up to their end tag.
RAW = frozenset("script style title textarea iframe noscript".split())
#: An opening tag of the key ends an open element of the values.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: ... but not beyond these.
SCOPE = frozenset("html body ul ol dl table tbody thead article section div main aside nav footer header form".split())

# Every repetition is possessive, so a malformed tag is given up after one pass.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attributes>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/<>]*+)[^<>]*+>|<[/a-zA-Z!?][^<>]*+\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Block:
    text: str
    ancestors: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int  # code points within links


def names(attributes: str) -> tuple[str, ...]:
    """The words of a tag's class, id and role."""
    if "=" not in attributes:
        return ()
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        found += [w.lower() for w in _PART.findall(html.unescape(m[2] or m[3] or m[4] or "")) if not w.isdigit()]
    return tuple(dict.fromkeys(found))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pending: list[str] = []
    linked = silent = in_link = in_head = foreign = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pending).split())
        if text:
            found.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), linked))
        pending.clear()
        linked = 0

    def pop() -> None:
        nonlocal silent, in_link, in_head, foreign
        tag = stack.pop()[0]
        silent -= tag in SILENT
        in_link -= tag == "a"
        in_head -= tag == "head"
        foreign -= tag in ("svg", "math")

    def end_head() -> None:
        while in_head and not silent:
            pop()

    def say(text: str) -> None:
        nonlocal linked
        if text and not silent:
            if in_head and not text.isspace():
                end_head()
            text = html.unescape(text)
            pending.append(text)
            if in_link:
                linked += len(text)

    at = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        attributes = m["attributes"] or ""
        if in_head and tag not in HEAD and not (m["end"] or m["end2"]):
            end_head()
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"] or m["end2"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None and not (tag in INLINE and any(x[0] in SCOPE for x in stack[depth:])):
                while len(stack) > depth:
                    pop()
            continue
        if tag not in INLINE:  # a block ends an open paragraph, with what stands open in it
            closed = CLOSES.get(tag, ()) + ("p",)
            while True:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in closed or stack[k][0] in SCOPE), None)
                if depth is None or stack[depth][0] not in closed:
                    break
                while len(stack) > depth:
                    pop()
            if tag == "body":
                while stack and stack[-1][0] != "html":
                    pop()
        if tag in VOID or attributes.endswith("/") and (foreign or tag in SILENT or tag in ("svg", "math")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            at = len(page) if end is None else end.start()
        stack.append((tag, names(attributes)))
        silent += tag in SILENT
        in_link += tag == "a"
        in_head += tag == "head"
        foreign += tag in ("svg", "math")
    say(page[at:])
    flush()
    return found


@functools.lru_cache(maxsize=20_000)
def ancestor_features(ancestors: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    tags = [tag for tag, _ in ancestors if tag not in ("html", "body")]
    out = {f"tag:{t}" for t in tags}
    out |= {f"parent:{tags[-1]}"} if tags else {"parent:none"}
    for tag, words in ancestors:
        if tag not in ("html", "body"):
            out |= {f"name:{w.rstrip('s')}" for w in words}
    return tuple(sorted(out))


def text_features(block: Block) -> list[str]:
    n, words = len(block.text), block.text.count(" ") + 1
    share = block.linked / n
    return [
        f"length:{min(6, n.bit_length() // 2)}", f"words:{min(5, words.bit_length() // 2)}",
        "links:" + ("none" if not share else "some" if share < 0.5 else "most"),
        "ends:" + ("stop" if block.text[-1] in ".!?…。" else "other"),
        "commas:" + ("yes" if "," in block.text else "no"),
        "sign:" + ("yes" if block.text[0] in "©®™" else "no"), "bias",
    ]


def features(block: Block) -> list[str]:
    return [*ancestor_features(block.ancestors), *text_features(block)]


class ConditionalRandomField:
    """Two labels, 0 other and 1 article, over the blocks of a page."""

    def __init__(self, index: dict[str, int], emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.index, self.emission, self.transition, self.start = index, emission, transition, start
        #: what each feature adds to label 1 over label 0
        self._gain = {f: float(emission[k, 1] - emission[k, 0]) for f, k in index.items()}

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], steps: int = 140, rate: float = 0.15, ridge: float = 0.004) -> ConditionalRandomField:
        """Maximizes the log-likelihood of the labels, less a ridge, by Adam.

        All pages run through forward and backward together, padded to one length.
        """
        index: dict[str, int] = {}
        for rows, _ in pages:
            for row in rows:
                for f in row:
                    index.setdefault(f, len(index))
        count, longest, width = len(pages), max(len(r) for r, _ in pages), len(index)
        # the features of each block as indices, filled up with one that has no weight
        most = max(len(row) for rows, _ in pages for row in rows)
        x = np.full((count, longest, most), width)
        y, mask = np.zeros((count, longest), int), np.zeros((count, longest), bool)
        for k, (rows, labels) in enumerate(pages):
            for t, row in enumerate(rows):
                x[k, t, : len(row)] = [index[f] for f in row]
            y[k, : len(labels)], mask[k, : len(labels)] = labels, True
        flat = x.reshape(-1, most)
        who = flat.reshape(-1)
        gold = np.eye(2)[y] * mask[..., None]
        pairs = mask[:, 1:, None, None] * np.einsum("kta,ktb->ktab", gold[:, :-1], gold[:, 1:])
        parameters = [np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        for step in range(1, steps + 1):
            emission, transition, start = parameters
            padded = np.concatenate([emission, np.zeros((1, 2))])
            e = padded[flat].sum(axis=1).reshape(count, longest, 2)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = start + e[:, 0]
            for t in range(1, longest):
                new = np.logaddexp(a[:, t - 1, :1] + transition[0], a[:, t - 1, 1:] + transition[1]) + e[:, t]
                a[:, t] = np.where(mask[:, t, None], new, a[:, t - 1])
            for t in range(longest - 2, -1, -1):
                ahead = e[:, t + 1] + b[:, t + 1]
                new = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
                b[:, t] = np.where(mask[:, t + 1, None], new, b[:, t + 1])
            log_z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])[:, None, None]
            single = np.exp(a + b - log_z) * mask[..., None]
            double = np.exp(a[:, :-1, :, None] + transition + (e[:, 1:] + b[:, 1:])[:, :, None, :] - log_z[..., None]) * mask[:, 1:, None, None]
            wrong = (gold - single).reshape(-1, 2)
            own = np.stack([np.bincount(who, np.repeat(wrong[:, c], most), width + 1)[:width] for c in (0, 1)], axis=1)
            gradients = [own / count - ridge * emission / 10, (pairs - double).sum((0, 1)) / count - ridge * transition, (gold[:, 0] - single[:, 0]).sum(0) / count - ridge * start]
            for p, g, (m, v) in zip(parameters, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(index, *parameters)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels of a page's blocks; ties fall to 0."""
        if not rows:
            return []
        gain = self._gain
        (t00, t01), (t10, t11) = self.transition.tolist()
        back: list[tuple[int, int]] = []
        s0, s1 = self.start.tolist()
        for k, row in enumerate(rows):
            g = sum([gain.get(f, 0.0) for f in row])
            if k:
                from0, from1 = (s1 + t10 > s0 + t00), (s1 + t11 > s0 + t01)
                back.append((int(from0), int(from1)))
                s0, s1 = (s1 + t10 if from0 else s0 + t00), (s1 + t11 if from1 else s0 + t01)
            s1 += g
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


@functools.lru_cache(maxsize=1)
def trained() -> ConditionalRandomField:
    """The field trained on the labelled pages; the same in every run."""
    from .training_pages import labelled_pages

    return ConditionalRandomField.train([([features(b) for b in found], labels) for found, labels in labelled_pages()])


def main_text(page: str, field: ConditionalRandomField) -> str:
    """The article text of a page."""
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, field.decode([features(b) for b in found])) if label)


def extract(pages: DataFrame, field: ConditionalRandomField | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a map, without a shuffle."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(t, field) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
