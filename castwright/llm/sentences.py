"""Sentence boundaries across languages and scripts.

Every character is tagged as boundary or inside by a linear-chain model with Viterbi decoding. Behind a sentence mark
and before white space the emission is a weighted sum of features; between two characters of a script without spaces
it is the log-odds of what stands before and behind, learned on text without punctuation. A place whose emission can't
win is inside, so that the chain is decoded over the others. Emissions and transitions are fitted together (averaged
perceptron on whole sequences, started from a logistic regression) on texts made of whole known sentences; copies
without punctuation are added for Thai, Chinese and Japanese. Quotations, titles and brackets are kept whole, a blank
line always ends a sentence.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = {c: c - 0xFEE0 for c in range(0xFF10, 0xFF1A)} | {c: c - 0xFEE0 for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))} | {0x3000: 0x20, 0xA0: 0x20, 0x2009: 0x20, 0x2005: 0x20, 0x202F: 0x20}
MARKS = ".!?。！？｡．…।॥؟~～"
CLOSERS = "\"”’」』）)\\]】»›“‘'《》〉"
_CANDIDATE = re.compile(rf"(?P<mark>[{MARKS}]+)(?P<close>[\"”’」』）)\]»›“]*)(?P<gap>\s*)|(?P<close2>(?<=\S)[\"”」』»])(?P<gap2>\s*)|(?P<gap3>(?<=\S)\s+(?![a-z0-9\s]))")
# Spans that no boundary may cut, of any length within a paragraph.
_WHOLE = re.compile(
    r"「[^「」]*」|『[^『』]*』|《[^《》]*》|“[^“”„]*”|„[^„“”]*[“”]|«[^«»]*»|（[^（）]*）|\([^()]*\)"
    r"|\[[^\[\]]*\]|【[^【】]*】|(?<![\w\"])\"(?=[^\s\"])[^\"\n]+(?:\n[^\"\n]+)?\"(?!\w)"
)
_JOINED = re.compile("[。！？，、：；「」『』“”…《》（）～]")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")


def kind(c: str) -> str:
    """The class of a character."""
    if not c:
        return "end"
    o = ord(c)
    if 0x4E00 <= o <= 0x9FFF:
        return "han"
    if o < 128:
        return "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
    if 0x3040 <= o <= 0x30FF:
        return "kana"
    if 0xE00 <= o <= 0xE7F:
        return "thai"
    if 0x900 <= o <= 0x963 or 0x966 <= o <= 0x97F:
        return "deva"
    return ("A" if c.isupper() else "a") if c.isalpha() else c


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """(end, next start, mark, close, gap) of each place where a sentence may end; ``text`` is one paragraph."""
    whole = [m.span() for m in _WHOLE.finditer(text)]
    out, w = [], 0
    for m in _CANDIDATE.finditer(text):
        mark, close, gap = m["mark"] or "", m["close"] or m["close2"] or "", m["gap"] or m["gap2"] or m["gap3"] or ""
        end, nxt = m.end() - len(gap), m.end()
        if not mark and not close:
            c = text[nxt : nxt + 1]
            if c.islower() and ord(c) < 0x250 or c.isdigit() or not c:
                continue  # no sentence starts so without a mark before it
        while w < len(whole) and whole[w][1] < end:
            w += 1
        if w < len(whole) and whole[w][0] < end < whole[w][1]:
            # The mark's closers may run past an inner close; else the place is inside a whole span.
            continue
        out.append((end, nxt, mark, close, gap))
    return out


Parts = tuple[tuple, tuple, tuple | None, tuple | None]


def parts(text: str, cand: tuple[int, int, str, str, str]) -> Parts:
    """What is seen around a candidate, in four groups that each repeat often."""
    end, nxt, mark, close, gap = cand
    body = end - len(mark) - len(close)
    left, right = text[max(0, body - 16) : body], text[nxt : nxt + 12]
    lk, rk = kind(left[-1:]), kind(right[:1])
    word = "" if lk in _WIDE_KINDS or not left.strip() else left.split()[-1].lower().lstrip("([{\"'“„«¿¡")
    if word and not word.isascii():
        word = _JOINED.split(word)[-1]
    first = "" if rk in _WIDE_KINDS or not right.strip() else right.split(None, 1)[0]
    sep = "n" if "\n" in gap else "s" if gap else ""
    sign = mark[:1] + (mark[-1:] if len(mark) > 1 else "") + "|" + close[-1:]
    wide = lk in _WIDE_KINDS or rk in _WIDE_KINDS
    quote = None
    if close:
        # A quotation behind a colon ends its sentence, one at the start of it usually does not.
        at = text.rfind(_OPENERS.get(close[-1], '"'), 0, end - 1)
        quote = (close[-1], kind(text[:at].rstrip()[-1:]) if at >= 0 else "-", rk, bool(mark), right[:1])
    return (sign, sep, lk, rk, word[-10:]), (sign, bool(mark), first[:8]), (left[-4:], right[:3], lk, rk, sign) if wide else None, quote


_WIDE_KINDS = ("thai", "han", "kana", "deva")
_OPENERS = {"”": "“", "」": "「", "』": "『", "»": "«", ")": "(", "）": "（", "“": "„"}


def names(group: int, part: tuple) -> list[str]:
    """The features of one group."""
    if group == 0:
        sign, sep, lk, rk, word = part
        word, marked = re.sub(r"\d", "9", word), sign[0] != "|"
        return [f"s{sign}", f"k{sign}{lk}{rk}{sep}", f"w{sign}{word}", f"g{sign}{sep}", f"c{marked}{rk}{sep}", f"l{min(len(word), 4)}{sign}{rk}", f"y{sign}{word}{rk}"]
    if group == 1:
        sign, marked, first = part
        return [f"v{marked}{first}", f"x{sign}{first.lower()}"]
    if group == 2:
        left, right, lk, rk, sign = part
        marked, out = sign[0] != "|", []
        if lk in _WIDE_KINDS:
            out += [f"2{left[-2:]}{sign}", f"4{left}{marked}", f"6{left[-2:]}{right[:2]}"]
        if rk in _WIDE_KINDS:
            out += [f"r{right[:2]}{marked}", f"R{right}{marked}"]
        return out
    close, before, rk, marked, nxt = part
    return [f"q{close}{before}", f"Q{close}{before}{rk}{marked}", f"z{close}{nxt}"]


def features(text: str, cand: tuple[int, int, str, str, str]) -> list[str]:
    return [f for i, part in enumerate(parts(text, cand)) if part is not None for f in names(i, part)]


class Chain:
    """Weights of the boundary tag by feature, weights of tag after tag, and what unmarked ends look like."""

    def __init__(self, weights: dict[str, float], bias: float, step: dict[tuple[bool, bool], float], bare: "Bare | None" = None) -> None:
        self.weights, self.bias, self.step, self.bare = weights, bias, step, bare
        self.sums: list[dict[tuple, float]] = [{}, {}, {}, {}]

    def emission(self, text: str, cand: tuple[int, int, str, str, str]) -> float:
        """The weight of a boundary here; sums of feature groups seen before are kept, a bounded number of them."""
        total = self.bias
        for i, part in enumerate(parts(text, cand)):
            if part is not None:
                known = self.sums[i]
                if (value := known.get(part)) is None:
                    if len(known) > 100_000:
                        known.clear()
                    value = known[part] = sum(self.weights.get(f, 0.0) for f in names(i, part))
                total += value
        return total

    def cut(self, text: str) -> list[tuple[int, int]]:
        """(end, next start) of the sentences of one paragraph, by Viterbi decoding."""
        cands = [(cand, self.emission(text, cand)) for cand in candidates(text)]
        if self.bare is not None and (more := self.bare.places(text)):
            whole = [m.span() for m in _WHOLE.finditer(text)]
            free = [(at, e) for at, e in more if not any(a < at < b for a, b in whole)]
            cands = sorted([*cands, *(((at, at, "", "", ""), e) for at, e in free)], key=lambda c: c[0][0])
        step = self.step
        inside, bound, back = 0.0, -1e9, []
        for cand, e in cands:
            a, b = inside + step[False, False], bound + step[True, False]
            c, d = inside + step[False, True] + e, bound + step[True, True] + e
            back.append((b > a, d > c))
            inside, bound = max(a, b), max(c, d)
        tag, out = bound > inside, []
        for (cand, _), (from_bound_i, from_bound_b) in zip(reversed(cands), reversed(back)):
            if tag:
                out.append((cand[0], cand[1]))
            tag = from_bound_b if tag else from_bound_i
        out.reverse()
        end = len(text.rstrip())
        if end and (not out or out[-1][0] < end):
            out.append((end, len(text)))
        return out


class Bare:
    """Ends without mark or white space, in scripts without spaces: log-odds of the characters before and behind a place."""

    def __init__(self, before: dict[str, float], behind: dict[str, float], least: float) -> None:
        self.before, self.behind, self.least = before, behind, least
        self.any = re.compile(f"[{_UNSPACED}]{{4}}")

    @staticmethod
    def width(c: str) -> int:
        """Characters that are looked at: a Thai word has more of them."""
        return 6 if "\u0e00" <= c <= "\u0e7f" else 2

    def places(self, text: str) -> list[tuple[int, float]]:
        """(place, emission) of each character that may end a sentence so."""
        if not self.before or not self.any.search(text):
            return []
        out = []
        for m in re.finditer(f"[{_UNSPACED}]+", text):
            n = self.width(m[0][0])
            for at in range(m.start() + n, m.end() - n + 1):
                if (e := self.behind.get(text[at : at + n])) is not None and (f := self.before.get(text[at - n : at])) is not None and e + f > self.least:
                    out.append((at, e + f - self.least))
        return out


_UNSPACED = "\u0e01-\u0e4e\u3041-\u30fc\u4e00-\u9fff"


def fit_bare(sentences: list[str], least: float = 8.0) -> Bare:
    """Log-odds of the last and the first characters of sentences against the same characters inside; ``least`` is the prior odds of an unmarked end.

    Only what ends or begins several different sentences tells; a character pair that stands inside often has low odds.
    """
    bare = [p for s in sentences if (p := s.strip().rstrip(MARKS + CLOSERS).lstrip("-·• "))]
    ends, starts, inside = Counter(), Counter(), Counter()
    for s in bare:
        for m in re.finditer(f"[{_UNSPACED}]+", s):
            n, run = Bare.width(m[0][0]), m[0]
            if len(run) >= n:
                if m.end() == len(s):
                    ends[run[-n:]] += 1
                if m.start() == 0:
                    starts[run[:n]] += 1
                inside.update(run[i : i + n] for i in range(1, len(run) - n))
    n_in, n_end = max(1, sum(inside.values())), max(1, sum(ends.values()))
    n_start = max(1, sum(starts.values()))
    odds = lambda some, total: {k: math.log((c / total) / ((inside[k] + 0.3) / n_in)) for k, c in some.items() if c >= 3}
    return Bare(odds(ends, n_end), odds(starts, n_start), least)


def fit(sentences: list[str], seed: int = 7, epochs: int = 6) -> Chain:
    """Fit the model on whole sentences, put together to paragraphs in several ways."""
    rnd = random.Random(seed)
    known = sorted({s.strip() for s in sentences if 2 < len(s.strip()) < 300})
    sequences: list[list[tuple[list[str], bool]]] = []
    steps = {(a, b): 1.0 for a in (False, True) for b in (False, True)}

    def learn(group: list[str], bare: bool) -> None:
        text, ends = "", set()
        for s in group:
            if bare:
                s = s.rstrip(MARKS)
            # Lines of running text are wrapped anywhere, so a line break alone must not mean an end.
            text += re.sub(r" ", lambda m: "\n" if rnd.random() < 0.25 else " ", s) if rnd.random() < 0.15 else s
            ends.add(len(text))
            wide = kind(s[-1:]) in ("han", "kana") or s[-1:] in "。！？」』”～…"
            marked = s[-1:] in MARKS + CLOSERS
            text += "" if wide and marked and rnd.random() < 0.85 else "\n" if rnd.random() < 0.06 else "" if marked and rnd.random() < 0.03 else " "
        before, own = False, []
        for cand in candidates(text):
            if cand[0] >= len(text.rstrip()):
                continue
            tag = cand[0] in ends
            own.append((features(text, cand), tag))
            steps[before, tag] += 1
            before = tag
        sequences.append(own)

    for _ in range(2):
        rnd.shuffle(known)
        for i in range(0, len(known), 12):
            learn(known[i : i + 12], False)
    # Unpunctuated scripts: the same without closing marks.
    spaced = [s for s in known if kind(s.rstrip(MARKS)[-1:]) in ("thai", "han", "kana")]
    thai = [s for s in spaced if kind(s.rstrip(MARKS)[-1:]) == "thai"]
    for i in range(0, len(thai), 10):
        learn(thai[i : i + 10], True)
    rnd.shuffle(spaced)
    for i in range(0, len(spaced) // 4, 10):
        learn(spaced[i : i + 10], True)

    rows = [row for own in sequences for row in own]
    weights: dict[str, float] = {}
    bias, squares = 0.0, {}
    order = list(range(len(rows)))
    for _ in range(epochs):
        rnd.shuffle(order)
        for i in order:
            fs, tag = rows[i]
            p = 1 / (1 + math.exp(-max(-30, min(30, bias + sum(weights.get(f, 0.0) for f in fs)))))
            g = p - tag
            if abs(g) < 1e-3:
                continue
            bias -= 0.02 * g
            for f in fs:  # AdaGrad with a little decay
                d = g + 1e-4 * weights.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + d * d
                weights[f] = weights.get(f, 0.0) - 0.3 * d / (1e-3 + math.sqrt(squares[f]))
    weights, step = fit_sequences(sequences, weights, bias, rnd)
    return Chain({f: w for f, w in weights.items() if abs(w) > 1e-3}, bias, step, fit_bare(known))


def fit_sequences(sequences: list[list[tuple[list[str], bool]]], weights: dict[str, float], bias: float, rnd: random.Random, epochs: int = 2, rate: float = 0.2) -> tuple[dict[str, float], dict[tuple[bool, bool], float]]:
    """Weights of features and of tag after tag, fitted together: each sequence is decoded, and what differs from the truth is moved; averaged over all steps."""
    step = {(a, b): 0.0 for a in (False, True) for b in (False, True)}
    moved, moved_step, n = {}, dict.fromkeys(step, 0.0), 1
    for _ in range(epochs):
        rnd.shuffle(sequences)
        for own in sequences:
            inside, bound, back = 0.0, -1e9, []
            for fs, _ in own:
                e = bias + sum(weights.get(f, 0.0) for f in fs)
                a, b = inside + step[False, False], bound + step[True, False]
                c, d = inside + step[False, True] + e, bound + step[True, True] + e
                back.append((b > a, d > c))
                inside, bound = max(a, b), max(c, d)
            tags, tag = [], bound > inside
            for from_i, from_b in reversed(back):
                tags.append(tag)
                tag = from_b if tag else from_i
            before, guessed = False, False
            for (fs, want), got in zip(own, reversed(tags)):
                if (before, want) != (guessed, got):
                    for key, sign in (((before, want), rate), ((guessed, got), -rate)):
                        step[key] += sign / 4
                        moved_step[key] += n * sign / 4
                if want != got:
                    sign = rate if want else -rate
                    for f in fs:
                        weights[f] = weights.get(f, 0.0) + sign / len(fs)
                        moved[f] = moved.get(f, 0.0) + n * sign / len(fs)
                before, guessed = want, got
            n += 1
    return {f: w - moved.get(f, 0.0) / n for f, w in weights.items()}, {k: w - moved_step[k] / n for k, w in step.items()}


def sentence_ends(text: str | None, chain: Chain) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text, in code points of the stored text."""
    if not text or not text.strip():
        return []
    flat = text.translate(_WIDE)
    out, at = [], 0
    for m in [*_BLANK.finditer(flat), None]:
        a, b = at, m.start() if m else len(flat)
        part = flat[a:b]
        lead = len(part) - len(part.lstrip())
        if part.strip():
            begin = a + lead
            for end, nxt in chain.cut(part[lead:]):
                out.append((begin, a + lead + end))
                begin = a + lead + nxt
        at = m.end() if m else b
    return out


def known_sentences(documents: DataFrame, bound: int) -> list[str]:
    """At most ``bound`` lines of listener comments, which hold one sentence each; those with the least hash.

    The lines are counted first, and only those below a threshold of the hash that leaves about twice the bound are
    made distinct, so that what is sent doesn't grow with the corpus.
    """
    lines = documents.where("doc_kind = 'comments' and text is not null").select(F.explode(F.split("text", "\n")).alias("s")).where("length(s) between 3 and 300")
    n = lines.agg(F.approx_count_distinct("s")).first()[0]
    share = min(1.0, 2 * bound / max(1, n))
    some = lines.where(F.pmod(F.xxhash64("s", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).distinct()
    return [r["s"] for r in some.orderBy(F.xxhash64("s"), "s").limit(bound).collect()]


def split_sentences(df: DataFrame, key: list[str], text: str | Column, chain: Chain) -> DataFrame:
    """One row for each sentence: the key columns, ``start_pos, end_pos, sentence``.

    Every text is read whole. A null or blank text has no sentences; repeated rows are repeated in the result. A text
    without any mark is one sentence for each paragraph. Columns of other names are not read.
    """
    text = F.col(text) if isinstance(text, str) else text
    src = df.select(*key, text.alias("__text")).where("__text is not null")
    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [batch[k].to_list() for k in key]
            which, start, end, words = [], [], [], []
            for i, t in enumerate(batch["__text"]):
                for a, b in sentence_ends(t, chain):
                    which.append(i)
                    start.append(a)
                    end.append(b)
                    words.append(t[a:b])
                if words and (len(words) > 20_000 or i == len(batch) - 1):
                    yield pd.DataFrame({**{k: [v[j] for j in which] for k, v in zip(key, keys)}, "start_pos": start, "end_pos": end, "sentence": words})
                    which, start, end, words = [], [], [], []

    return src.mapInPandas(run, f"{schema}, start_pos int, end_pos int, sentence string")


def all_sentences(transcripts: DataFrame, output_docs: DataFrame, documents: DataFrame, train_sentences: int = 12_000) -> DataFrame:
    """Sentences of the talk: ``episode_id, text_field, start_pos, end_pos, sentence``.

    Exact duplicates of a row count once. ``train_sentences`` bounds the known sentences that the model is fitted on.
    """
    chain = fit(known_sentences(documents, train_sentences))
    talk = (
        transcripts.where("layout = 'prose'").select("episode_id", F.lit("raw_text").alias("text_field"), F.col("raw_text").alias("text"))
        .unionByName(output_docs.select("episode_id", F.lit("full_text").alias("text_field"), F.col("full_text").alias("text")))
        .where("text is not null").groupBy("episode_id", "text_field", F.sha2("text", 256).alias("h")).agg(F.any_value("text").alias("text"))
    )
    return split_sentences(talk, ["episode_id", "text_field"], "text", chain)
