"""HTML main-text extraction: boosted trees over DOM nodes, decoded so that a dropped node has no kept descendant.

Every element and every stretch of text of a page is a node. The trees give each node the odds that its subtree holds
main text, from its subtree's density, its and its ancestors' attribute tokens, its depth, and its siblings. A node that is
dropped drops its subtree: of all labellings of the tree that respect this, the most likely one is found exactly, from
the leaves up. The model is trained on generated pages by html_train.py and lies beside this file.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillet.llm.boosting import logits
from quillet.llm.common import keyed

MODEL = Path(__file__).with_name("html_model.json")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg math object canvas head title textarea select button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes if it is open, up to the nearest of the second set.
CLOSES = {t: (frozenset({"p"}), frozenset("button td th table".split())) for t in BLOCK - {"li", "dd", "dt", "tr", "td", "th", "option", "body", "html", "tbody", "thead", "tfoot"}}
CLOSES |= {"li": (frozenset({"li", "p"}), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd p".split()), frozenset({"dl"})), "dd": (frozenset("dt dd p".split()), frozenset({"dl"})), "option": (frozenset({"option"}), frozenset({"select"}))}
CLOSES |= {t: (frozenset("td th p".split()), frozenset({"tr", "table"})) for t in ("td", "th")} | {"tr": (frozenset("tr td th p".split()), frozenset({"table"}))}
CLOSES |= {t: (frozenset("tr td th p tbody thead tfoot".split()), frozenset({"table"})) for t in ("tbody", "thead", "tfoot")}
#: Kinds of tags, a feature each.
KINDS = [frozenset(x.split()) for x in ("#text", "p", "h1 h2 h3 h4 h5 h6", "li ul ol dl dd dt", "a", "article main", "section div", "nav menu", "header", "footer", "aside", "form input label fieldset", "table tbody tr td th", "blockquote pre code figure figcaption", "b i em strong span u small sup sub font mark", "body html")]
#: Tokens of class, id and role are hashed to so many buckets, whose odds of main text are learnt.
BUCKETS = 1024
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?])")
#: The rest of a tag. Quotes count after = only; possessive, so nothing is tried twice.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.,;:!?…。，！？]")


class Page:
    """The nodes of a page in document order; text of a node that isn't "#text" is ""."""

    def __init__(self, source: str, odds: list[float]):
        """odds: what each bucket of attribute tokens says for main text (or, below 0, against it)."""
        self.odds, self.tag, self.parent, self.text, self.good, self.bad, self.tokens = odds, ["#root"], [-1], [""], [0.0], [0.0], [()]
        self.open: dict[str, int] = {}
        stack, at, end = [0], 0, len(source)
        quotes = max(source.rfind('"'), source.rfind("'"))
        while at < end:
            m = _OPEN.search(source, at)
            self.add_text(source[at : m.start() if m else end], stack[-1])
            if not m:
                break
            if m[2] is None:
                stop = source.find("-->", m.start() + 4) + 2 if source.startswith("<!--", m.start()) else source.find(">", m.end())
                at = stop + 1 if stop > 1 else end
                continue
            rest = self.rest(source, m.end(), quotes)
            if rest < 0:  # the page ends within the tag
                break
            attrs, at, tag = source[m.end() : rest], rest + 1, m[2].lower()
            if m[1]:
                if tag == "br":
                    self.add_text(" ", stack[-1])
                elif self.open.get(tag):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != tag:
                        k -= 1
                    self.cut(stack, k)
                continue
            if tag in CLOSES:
                self.close(*CLOSES[tag], stack)
            node = self.add(tag, stack[-1], attrs)
            if tag in RAW:
                stop = RAW_END[tag].search(source, at)
                at = stop.end() if stop else end
            elif tag not in VOID and not attrs.endswith("/"):
                stack.append(node)
                self.open[tag] = self.open.get(tag, 0) + 1

    def rest(self, source: str, at: int, quotes: int) -> int:
        """Where the tag ends whose name ends at at; -1 if nowhere. quotes: where the last quote stands."""
        if (stop := source.find(">", at)) < 0:
            return -1
        if "=" not in source[at:stop]:
            return stop
        m = _REST.match(source, at)
        if m is None and quotes >= at:  # a quote that isn't closed: it is no quote
            return stop
        return m.end() - 1 if m else -1

    def cut(self, stack: list[int], k: int) -> None:
        """Close the open elements from place k on."""
        for i in stack[k:]:
            self.open[self.tag[i]] -= 1
        del stack[k:]

    def close(self, tags: frozenset, fence: frozenset, stack: list[int]) -> None:
        """Close the open elements of tags above the nearest of fence or of another block, with what they hold."""
        while any(self.open.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag in tags and tag not in fence:
                    self.cut(stack, k)
                    break
                if tag in fence or tag in BLOCK:
                    return
            else:
                return

    def add(self, tag: str, parent: int, attrs: str = "") -> int:
        good, bad, buckets = 0.0, 0.0, ()
        if attrs and "=" in attrs:
            words = {w for m in _ATTR.finditer(attrs) for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()) if w}
            buckets = sorted(zlib.crc32(w.encode()) % BUCKETS for w in words)
            found = [self.odds[i] for i in buckets]
            good, bad = sum(x for x in found if x > 0), -sum(x for x in found if x < 0)
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append("")
        self.good.append(good)
        self.bad.append(bad)
        self.tokens.append(buckets)
        return len(self.tag) - 1

    def add_text(self, text: str, parent: int) -> None:
        if text:
            self.text[self.add("#text", parent)] = html.unescape(text)

    def features(self) -> np.ndarray:
        """A row for each node."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        chars, links, tags, stops, words = ([0.0] * n for _ in range(5))
        depth, hidden, inlink, kids = [0] * n, [False] * n, [False] * n, [0] * n
        good, bad, place = list(self.good), list(self.bad), [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            hidden[i] = hidden[p] or tag[i] in HIDDEN
            inlink[i] = inlink[p] or tag[i] == "a"
            good[i] += good[p]
            bad[i] += bad[p]
            if tag[i] == "#text":
                if not hidden[i]:
                    t = self.text[i]
                    chars[i] = float(len(t.strip()))
                    links[i] = chars[i] if inlink[i] else 0.0
                    stops[i] = float(len(_STOP.findall(t)))
                    words[i] = float(t.count(" "))
            else:
                tags[i] = 1.0
                place[i] = kids[p]
                kids[p] += 1
        self.hidden, before, seen = hidden, [0.0] * n, 0.0
        for i in range(n):
            before[i] = seen
            seen += chars[i]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            stops[p] += stops[i]
            words[p] += words[i]
        par = np.array(parent)
        par[0] = 0
        c, li, tg, st, wd = (np.array(x) for x in (chars, links, tags, stops, words))
        d, g, b, k, pl = (np.array(x, float) for x in (depth, good, bad, kids, place))
        own_g, own_b = np.array(self.good, float), np.array(self.bad, float)
        code = np.unique(np.array(tag), return_inverse=True)[1]
        same = np.unique(par * n + code, return_inverse=True, return_counts=True)
        total = max(1.0, chars[0])
        cols = [d, np.log1p(c), np.log1p(c[par]), li / np.maximum(c, 1), li[par] / np.maximum(c[par], 1), c / (tg + 1), st / np.maximum(wd, 1), c / total, np.array(before) / total, k, pl / np.maximum(k[par], 1), k[par], same[2][same[1]] / np.maximum(1, np.bincount(par, minlength=n)[par]), (c[par] - c) / np.maximum(1, np.bincount(par, minlength=n)[par] - 1) / 100, own_g, own_b, np.minimum(g, 12), np.minimum(b, 12), own_g[par], own_b[par]]
        kind = np.array([next((j for j, x in enumerate(KINDS) if t in x), len(KINDS)) for t in tag])
        for j in range(len(KINDS)):
            cols += [kind == j, kind[par] == j]
        above = np.zeros((n, 3), bool)  # nav, header, footer, aside or form; article or main; list, among the ancestors
        flags = np.array([[t in ("nav", "header", "footer", "aside", "form", "menu"), t in ("article", "main"), t in ("ul", "ol", "dl")] for t in tag])
        for i in range(1, n):
            above[i] = above[parent[i]] | flags[i]
        return np.stack([*cols, *above.T], 1).astype(float)

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The most likely labels such that no kept node has a dropped ancestor; odds: log odds of each node."""
        n = len(self.tag)
        keep = -np.logaddexp(0, -odds)
        drop = -np.logaddexp(0, odds)
        best1, best0 = keep.tolist(), drop.tolist()
        for i in range(n - 1, 0, -1):
            if self.hidden[i]:
                best1[i] = -1e9
            p = self.parent[i]
            best1[p] += max(best1[i], best0[i])
            best0[p] += best0[i]
        kept = np.zeros(n, bool)
        kept[0] = True
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and best1[i] > best0[i]
        return kept

    def blocks(self, kept: np.ndarray) -> list[str]:
        """The kept text, one string for each block that has any, white space within made one space."""
        out: list[list[str]] = [[]]
        owner = [0] * len(self.tag)  # the block that a node's text goes to
        last = 0
        for i in range(1, len(self.tag)):
            owner[i] = i if self.tag[i] in BLOCK else owner[self.parent[i]]
            if self.tag[i] == "#text" or self.tag[i] == "br":
                if owner[i] != last:
                    out.append([])
                    last = owner[i]
                if kept[i] if self.tag[i] == "#text" else kept[self.parent[i]]:
                    out[-1].append(self.text[i] if self.tag[i] == "#text" else " ")
            elif self.tag[i] in BLOCK:
                last = -1  # what follows in the outer block begins anew
        joined = (_SPACE.sub(" ", "".join(x)).strip() for x in out)
        return [x for x in joined if x]


def extract(sources: list[str], model: dict) -> list[str]:
    """Main texts of pages, judged in one call of the model."""
    pages = [Page(s, model["tokens"]) for s in sources]
    rows = [p.features() for p in pages]
    odds = logits(model, np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p, x in zip(pages, rows, strict=True):
        out.append("\n".join(p.blocks(p.decode(odds[at : at + len(x)]))))
        at += len(x)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: dict | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    text: the main text's blocks in page order, joined by \\n; empty for null and empty pages and those without any.
    Whole pages are read, whatever their length; nothing is cut. Equal rows give equal rows; other columns are not read.
    """
    rows = keyed(pages, page_id=id_col, url=url_col, html=html_col).selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    model = model or json.loads(MODEL.read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                texts = extract([x or "" for x in batch.column("html").to_pylist()], model)
                yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
