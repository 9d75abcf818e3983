"""Main text of web pages by boosted trees over the nodes of the page."""

from __future__ import annotations

import random
import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.boosting import Trees, train

#: Pages to learn from, about.
SAMPLE = 1_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("head script style noscript template svg iframe object canvas audio video select textarea button math".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
#: Words in tags, classes and ids of main text, and of what surrounds it.
MAIN = frozenset("article main content post entry story body text articlebody".split())
AROUND = frozenset(
    "nav menu navigation navbar header masthead footer aside sidebar ad ads advert advertisement adverts banner sponsor sponsored promo "
    "cookie cookies consent notice notices alert popup modal overlay comment comments disqus reply replies form login search newsletter "
    "subscribe signup share sharing social related recommended widget toolbar breadcrumb breadcrumbs pagination copyright legal".split()
)
FEATURES = (
    "main around above_main above_around depth paragraph heading list box chars links density nodes children siblings place "
    "before words stops"
).split()
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Page:
    """Block elements as nodes, in page order, and the texts right below them."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.words, self.depth = [-1], ["root"], [frozenset()], [0]
        self.blocks: list[list] = []  # node, pieces of text, characters in links
        self._read(html or "")

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("root", 0)]
        fresh, links, at = True, 0, 0
        while at <= len(html):
            tag = _TAG.search(html, at)
            text = html[at : tag.start() if tag else len(html)]
            if text and not text.isspace():
                if fresh or self.blocks[-1][0] != stack[-1][1]:
                    self.blocks.append([stack[-1][1], [], 0])
                    fresh = False
                self.blocks[-1][1].append(text)
                self.blocks[-1][2] += len(text) if links else 0
            elif text and self.blocks and not fresh:
                self.blocks[-1][1].append(" ")
            if tag is None:
                break
            at = tag.end()
            if not tag[2]:
                continue
            name, closing = tag[2].lower(), bool(tag[1])
            if name == "br":
                if self.blocks and not fresh:
                    self.blocks[-1][1].append(" ")
            elif name in VOID:
                fresh |= name == "hr"
            elif name in SILENT and not closing:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif name != "head":
                    at = len(html)
                fresh |= name not in ("button",)
            elif closing:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if k:
                    fresh |= any(t not in INLINE for t, _ in stack[k:])
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
            elif name in INLINE:
                links += name == "a"
                stack.append((name, stack[-1][1]))
            else:
                shut = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ("p",))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shut:
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE and stack[k][0] != "p":
                        break
                self.parent.append(stack[-1][1])
                self.depth.append(self.depth[stack[-1][1]] + 1)
                self.tag.append(name)
                names = " ".join("".join(m) for m in _NAME.findall(tag[3])).lower() if "=" in tag[3] else ""
                self.words.append(frozenset([name, *re.split(r"[^a-z]+", names)]))
                if not tag[3].endswith("/"):
                    stack.append((name, len(self.parent) - 1))
                fresh = True
        self.texts = [" ".join(unescape("".join(p)).split()) for _, p, _ in self.blocks]

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent = np.array(self.parent)
        chars, links, nodes, words, stops = (np.zeros(n) for _ in range(5))
        before = np.full(n, -1.0)
        total = 0
        for (node, _, linked), text in zip(self.blocks, self.texts):
            before[node] = total if before[node] < 0 else before[node]
            total += len(text)
            chars[node] += len(text)
            links[node] += linked
            words[node] += text.count(" ") + 1
            stops[node] += text.count(". ") + text.endswith((".", "!", "?"))
        children = np.bincount(parent[1:], minlength=n).astype(float)
        place, seen = np.zeros(n), {}
        for i in range(1, n):
            place[i] = seen[parent[i]] = seen.get(parent[i], -1) + 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in (chars, links, words, stops):
                x[p] += x[i]
            nodes[p] += nodes[i] + 1
            if before[i] >= 0 and (before[p] < 0 or before[i] < before[p]):
                before[p] = before[i]
        main = np.array([bool(w & MAIN) and t != "body" for w, t in zip(self.words, self.tag)], float)
        around = np.array([bool(w & AROUND) for w in self.words], float)
        above = np.zeros((n, 2))
        for i in range(1, n):
            p = parent[i]
            above[i] = (max(above[p, 0], main[p]), max(above[p, 1], around[p]))
        tag = self.tag
        return np.column_stack(
            [
                main,
                around,
                above[:, 0],
                above[:, 1],
                np.array(self.depth, float),
                [t in ("p", "blockquote", "pre") for t in tag],
                [len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in tag],
                [t in ("ul", "ol", "li", "dl", "dt", "dd") for t in tag],
                [t in ("div", "section", "table", "td", "body", "root", "html") for t in tag],
                np.log1p(chars),
                links / np.maximum(chars, 1),
                chars / (nodes + 1),
                nodes,
                children,
                np.r_[0, children[parent[1:]]] if n > 1 else np.zeros(1),
                place,
                np.maximum(before, 0) / max(total, 1),
                chars / np.maximum(words, 1),
                stops / np.maximum(words, 1),
            ]
        ).astype(float)

    def labels(self) -> np.ndarray | None:
        """1 where a node holds main text by the words of its and its ancestors' tags; None without such words."""
        state = np.zeros(len(self.parent), int)
        for i in range(1, len(state)):
            above = state[self.parent[i]]
            if self.words[i] & AROUND and not (self.tag[i] == "header" and above == 1):
                state[i] = -1
            else:
                state[i] = above if above else int(bool(self.words[i] & MAIN) and self.tag[i] != "body")
        if not (state == 1).any():
            return None
        holds = state == 1
        for i in range(len(state) - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        return holds.astype(float)

    def decode(self, p: np.ndarray) -> str:
        """Text of the likeliest set of nodes in which a node with main text has only such ancestors."""
        log1, log0 = np.log(np.maximum(p, 1e-9)), np.log(np.maximum(1 - p, 1e-9))
        best1, best0 = log1.copy(), log0.copy()
        for i in range(len(p) - 1, 0, -1):
            best1[self.parent[i]] += max(best1[i], best0[i])
            best0[self.parent[i]] += best0[i]
        on = np.zeros(len(p), bool)
        on[0] = best1[0] >= best0[0]
        for i in range(1, len(p)):
            on[i] = on[self.parent[i]] and best1[i] >= best0[i]
        return "\n".join(t for (node, *_), t in zip(self.blocks, self.texts) if t and on[node])


def varied(html: str) -> str:
    """The page with more of what surrounds main texts, and the main text in another element."""
    rng = random.Random(zlib.crc32(html.encode("utf-8", "replace")))
    texts = re.findall(r"<p>([^<]{20,})", html) or ["Some words."]

    def around() -> str:
        word = rng.choice(sorted(AROUND))
        tag = word if word in ("nav", "header", "footer", "aside", "form") else rng.choice(("div", "section", "ul", "div"))
        inner = "li" if tag == "ul" else rng.choice(("p", "div", "span"))
        parts = "".join(f"<{inner}>{rng.choice(texts)[: rng.choice((30, 80, 400))]}</{inner}>" for _ in range(rng.randint(1, 4)))
        name = "" if word == tag else f' {rng.choice(("class", "id"))}="{word}{rng.choice(("", "-box", " x1"))}"'
        return f"<{tag}{name}>{parts}</{tag}>"

    element, name = rng.choice((("main", ""), ("article", ""), ("div", ' class="content"'), ("div", ' id="post-body"'), ("section", ' class="entry"')))
    html = re.sub(r"<article\b[^>]*>", lambda _: around() * rng.randint(0, 1) + f"<{element}{name}>", html)
    html = html.replace("</article>", around() * rng.randint(0, 1) + f"</{element}>" + around())
    return html.replace("</p><p>", f"</p>{around()}<p>", 1) if rng.random() < 0.5 else html


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Trees:
    """Trees from about `sample` pages, chosen by a hash, each as it is and varied.

    The labels come from words in tags, classes and ids; pages without a word of main texts
    are left out. Without any such page, all nodes count as main text.
    """
    pages = pages.where(F.col(html).isNotNull())
    n = pages.count()
    chosen = F.pmod(F.xxhash64(html, F.lit(9)), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30)) + (n <= sample)

    def run(batches):
        for batch in batches:
            for text in batch["html"].to_pylist():
                for version in (text, varied(text)):
                    page = Page(version)
                    labels = page.labels()
                    if labels is not None:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, page.features().T), pa.array(labels)], [*FEATURES, "label"])

    schema = ", ".join(f"{c} double" for c in [*FEATURES, "label"])
    nodes = pages.where(chosen).select(F.col(html).alias("html")).mapInArrow(run, schema)
    trees = train(nodes, FEATURES, "label", trees=12, depth=5)
    return trees if trees.trees or trees.prior else Trees(trees.features, (), 1.0)


def extract(pages: DataFrame, trees: Trees, html: str = "html") -> DataFrame:
    """Adds `text`, the main text, and `n_chars`, its code points, to every row.

    Blocks end at block elements; character references are decoded, white space in a block is
    one space, blocks are joined by \\n in page order. Null or empty pages, and those without
    main text, have an empty text. Broken markup is read as far as it goes; repeated rows stay,
    an empty table gives no rows, own columns of those names are replaced.
    """
    own = [c for c in pages.columns if c not in ("text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            for i in range(0, len(batch), 256):
                read = [Page(h) for h in batch[html].slice(i, 256).to_pylist()]
                features = [p.features() for p in read]
                score = trees.score(np.concatenate(features))
                cuts = np.cumsum([len(f) for f in features])[:-1]
                texts += [p.decode(s) for p, s in zip(read, np.split(score, cuts))]
            arrays = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "text", "n_chars"])

    schema = pages.select(*own).schema
    schema = type(schema)(list(schema.fields)).add("text", "string").add("n_chars", "long")
    return pages.select(*own).mapInArrow(run, schema)


def op8_html(spark: SparkSession, sf: str) -> DataFrame:
    """Main texts of all pages."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
