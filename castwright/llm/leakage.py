"""Evaluation items that stand in the training corpus.

Both sides are cut into tokens (words; single characters of scripts without spaces), winnowed (of the hashes of every
window of consecutive k-grams the least is kept), and joined on the fingerprints. Hits are extended by a gapped
alignment of each statement around them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, W = 3, 3
K_CHARS, W_CHARS = 4, 2
#: Share of a statement's tokens that must be found in order, and of half an item.
SHARE = 0.8
# Hesitation sounds, which may stand between.
FILLERS = frozenset("um uh er erm em eh hm hmm mm mmm mhm huh äh ähm este".split())
_CJK_FILLERS = re.compile(r"(?:嗯+|呃+|额(?=[，,…])|唔+|啊这|那个(?=[，,])|えっと|えーと|あのー|うーん)[，,、…]*")
# What may stand between, in lower case: each branch starts with a literal, which lets the search skip to it.
_BETWEEN = re.compile(
    r"<[^<>\n]{0,60}>|〈[^〈〉\n]{0,40}〉|\[[^\[\]\n]{0,60}\]|【[^【】\n]{0,60}】|\(\(?[^()\n]{0,24}\)\)?|\*[^*\s][^*\n]{0,24}\*|♪|♫"
    r"|speaker[\s_-]*\d{1,3}\s*[:：]?|spk[\s_-]*\d{1,3}\s*[:：]?|说话人[\s_-]*\d{1,3}\s*[:：]?"
)
_TIME = re.compile(r"\d(?<![\d:].)\d{0,2}:\d{2}(?::\d{2})?(?:[.,]\d{3})?(?![\d:])")
_CJK = "぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+", re.U)
_IGNORED = re.compile("[­؜᠎​-‏‪-‮⁠-⁯﻿￹-￻]")


def read_tokens(text: str) -> list[str]:
    """The tokens of a text, without labels, times, sound annotations and hesitations."""
    if text.isascii():
        text = text.lower()
    else:
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _CJK_FILLERS.sub("", _BETWEEN.sub(" ", _IGNORED.sub("", text).lower()))
        return [t for t in _TOKEN.findall(_TIME.sub(" ", text) if ":" in text else text) if t not in FILLERS]
    text = _BETWEEN.sub(" ", text)
    return [t for t in _TOKEN.findall(_TIME.sub(" ", text) if ":" in text else text) if t not in FILLERS]


class Fingerprints:
    """Winnowed fingerprints of texts; many texts are winnowed at once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __reduce__(self):
        return Fingerprints, ()

    def _code(self, token: str) -> int:
        """A hash that is odd for words and even for characters of scripts without spaces; 0 is no token."""
        char = len(token) == 1 and token >= "\u3040"
        code = self.known[token] = (xxhash.xxh3_64_intdigest(token) | 1) ^ char or 2
        return code

    def of_many(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text number, token position) of the kept k-grams; characters and words are winnowed apart, each with its own k."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        codes = np.zeros(int(sizes.sum()) + K_CHARS + W_CHARS, dtype=np.uint64)  # a 0 behind each text
        at = 0
        for t, n in zip(texts, sizes.tolist()):
            codes[at : at + n - 1] = [known.get(x) or self._code(x) for x in t]
            at += n
        starts = np.cumsum(sizes) - sizes
        found_h, found_p = [], []
        even = (codes & np.uint64(1)) == 0
        for k, w, pick in ((K, W, ~even), (K_CHARS, W_CHARS, even & (codes != 0))):
            n = len(codes) - k + 1
            h, valid = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
            for i in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
                valid &= pick[i : i + n]
            h ^= h >> np.uint64(29)
            h = np.where(valid, h, np.uint64(0xFFFFFFFFFFFFFFFF))
            # Windows of w k-grams of one run, and one for the start of each run, which may be shorter.
            begins = valid & ~np.append([False], valid[:-1])
            full = np.ones(n - w + 1, dtype=bool)
            for i in range(w):
                full &= valid[i : i + n - w + 1]
            first = np.flatnonzero(full | begins[: n - w + 1])
            kept, least = first.copy(), h[first]
            for i in range(1, w):
                near = h[first + i]
                kept = np.where(near < least, first + i, kept)
                least = np.minimum(near, least)
            kept = kept[np.append([True], kept[1:] != kept[:-1])] if len(kept) else kept  # the places of the least never go back
            found_h.append(h[kept])
            found_p.append(kept)
        h, p = np.concatenate(found_h), np.concatenate(found_p)
        which = np.searchsorted(starts, p, side="right") - 1
        return h.view(np.int64), which, (p - starts[which]).astype(np.int32) if len(p) else p.astype(np.int32)

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h, _, p = self.of_many([tokens])
        return h, p


def places(a: list[str]) -> dict[str, int]:
    """The places of each token as bits."""
    masks: dict[str, int] = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | 1 << i
    return masks


def common_length(a: list[str], b: list[str], masks: dict[str, int] | None = None, least: float = 0) -> int:
    """Length of the longest common subsequence, bit-parallel in the length of ``a``; 0 if it can't reach ``least``."""
    masks = places(a) if masks is None else masks
    if sum(map(masks.__contains__, b)) < least:
        return 0
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        if m := masks.get(t):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Item:
    """Tokens of an item, its statements as token ranges, and the places of tokens in each; a closing question is no statement."""

    def __init__(self, tokens: list[str], spans: list[tuple[int, int]]) -> None:
        self.tokens, self.spans, self.masks = tokens, spans, places(tokens)
        self.span_masks = [places(tokens[a:b]) for a, b in spans]


def item_parts(text: str) -> Item:
    tokens, spans = [], []
    for sentence in re.split(r"(?<=[.!?。！？])(?=\s|[^\x00-\x7f]|$)", text):
        own = read_tokens(sentence)
        if own:
            if sentence.rstrip()[-1:] not in "?？":
                spans.append((len(tokens), len(tokens) + len(own)))
            tokens += own
    return Item(tokens, spans)


def _found_near(want: list[str], masks: dict[str, int], doc: list[str], starts: list[int], share: float, edges: bool = True) -> bool:
    n, last = len(want), None
    for start in sorted(starts):
        if last is not None and start - last < max(3, n // 8):
            continue
        last = start
        near = doc[max(0, start - 4 - n // 6) : max(0, start + n + 6 + n // 3)]
        # Words may be replaced, but a passage that is cut off at an edge isn't complete.
        if common_length(want, near, masks, share * n) >= share * n and (not edges or common_length(want[:4], near) > 1 and common_length(want[-4:], near) > 1):
            return True
    return False


def contains_item(item: Item, doc: list[str], hits: list[tuple[int, int]], share: float = SHARE) -> bool:
    """Whether a document holds a statement of the item, or half of the item in one stretch; hits: (item, document) positions."""
    tokens, n = item.tokens, len(item.tokens)
    for (a, b), masks in zip(item.spans, item.span_masks):
        if starts := [d - (i - a) for i, d in hits if a <= i < b]:
            if _found_near(tokens[a:b], masks, doc, starts, share):
                return True
    half = (n + 1) // 2
    groups: list[list[tuple[int, int]]] = []  # hits on neighbouring diagonals
    for i, d in sorted(hits, key=lambda h: h[1] - h[0]):
        if groups and d - i - (groups[-1][-1][1] - groups[-1][-1][0]) <= max(3, half // 8):
            groups[-1].append((i, d))
        else:
            groups.append([(i, d)])
    least = (share + 0.05) * half
    for own in groups:
        lo, hi = own[0][1] - own[0][0], own[-1][1] - own[-1][0]
        # No half can have more in common with a part of this than the whole item with all of it.
        if common_length(tokens, doc[max(0, lo - 4 - half // 6) : max(0, hi + n + 6 + half // 3)], item.masks, least) < least:
            continue
        for a in range(n - half + 1):
            starts = [d - (i - a) for i, d in own if a <= i < a + half]
            want = tokens[a : a + half]
            if starts and _found_near(want, places(want), doc, starts, share + 0.05, edges=False):
                return True
    return False


class Items:
    """A block of items: their parts, and their fingerprints sorted by hash."""

    def __init__(self, texts: list[tuple[int, str]]) -> None:
        self.texts = texts
        self.made = Fingerprints()
        self.parts = [item_parts(t) for _, t in texts]
        h, which, pos = self.made.of_many([p.tokens for p in self.parts])
        order = np.argsort(h, kind="stable")
        self.hash, self.which, self.pos = h[order], which[order], pos[order]
        self.mask = (1 << max(16, (len(h) * 32).bit_length())) - 1
        self.maybe = np.zeros(self.mask + 1, dtype=bool)
        self.maybe[self.hash & self.mask] = True

    def __reduce__(self):
        return Items, (self.texts,)

    def hits(self, docs: list[list[str]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(document, item) -> (item, document) positions of common fingerprints."""
        h, doc, at = self.made.of_many(docs)
        near = np.flatnonzero(self.maybe[h & self.mask])
        low, high = np.searchsorted(self.hash, h[near]), np.searchsorted(self.hash, h[near], side="right")
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i in np.flatnonzero(high > low).tolist():
            d, p = int(doc[near[i]]), int(at[near[i]])
            for j in range(low[i], high[i]):
                out.setdefault((d, int(self.which[j])), []).append((int(self.pos[j]), p))
        return out

    def found(self, texts: list[str], share: float) -> list[tuple[int, int]]:
        """(place of the text, item id) of each leak."""
        docs = [read_tokens(t) for t in texts]
        return [(d, self.texts[i][0]) for (d, i), own in self.hits(docs).items() if contains_item(self.parts[i], docs[d], own, share)]


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE, block_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, item_id``: documents with a complete statement of an item, or half of it in one stretch.

    Every shared span of k + w - 1 tokens (5 words, 5 characters) has a common fingerprint; a pair with one hit is
    aligned. The items are the stated query set: their texts and fingerprints travel to the documents, in blocks of
    about ``block_chars`` characters (counted first), each block in a pass of its own; each document is read once a
    pass, joined, extended and decided where it lies, so nothing of the corpus is shuffled and no key can be hot. Null
    and empty texts hold nothing and are held by nothing; rows without an id are left out; repeated rows of one id
    change nothing unless their texts differ, when each text counts.
    """
    asked = items.where("item_id is not null and text is not null and text <> ''").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    blocks = -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    passes = []
    for n in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()  # one block
        sent = documents.sparkSession.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in own]))
        passes.append(texts.mapInPandas(_search(sent, share), "doc_id bigint, item_id bigint"))
    whole = passes[0] if passes else texts.where("false").select("doc_id", F.col("doc_id").alias("item_id"))
    for more in passes[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


def _search(sent, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            a, rows = 0, []
            while a < len(texts):  # a bounded number of characters in one go
                b, n = a, 0
                while b < len(texts) and (b == a or n < 500_000):
                    n, b = n + len(texts[b]), b + 1
                rows += [(ids[a + d], item) for d, item in sent.value.found(texts[a:b], share)]
                a = b
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"], dtype="int64")

    return run
