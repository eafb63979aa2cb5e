"""Scores for abusive, hateful or sexual content.

Log-odds with an informative Dirichlet prior of tokens and token pairs are estimated from reviewers' verdicts: abusive
documents against the counts of the whole corpus, and against the documents that reviewers found clean. In every
document a linear-time scan finds all maximal-scoring segments; their scores are calibrated by the extreme-value
distribution of the best segment in a text of that length, fitted on all documents, and aggregated to a document's score.

Texts are tokenised once: the numbers (hashes) of their tokens are written to the checkpoint folder, and every later
pass is arithmetic on arrays.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.llm.lookalike import SHAPES_FROM, SHAPES_TO
from castwright.session import cut

_LEET = str.maketrans("013457@$", "oieastas")
_SHAPES = str.maketrans(SHAPES_FROM, SHAPES_TO)
_ANY_SHAPE = re.compile(f"[{SHAPES_FROM}]")
_WIDE = "぀-ヿ㐀-鿿"
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿︀-️]")
_SPLIT_WIDE = re.compile(rf"[ 　*＊·.•_\-](?<=[{_WIDE}].)[ 　*＊·.•_\-]{{0,2}}(?=[{_WIDE}])")
# Signs that stand above, below or beside a letter of their script and are no letters themselves.
_MARKS = "\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0903\u093a-\u093c\u093e-\u094f\u0951-\u0957\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_LETTER = r"[^\W\d_]"
_THAI_LETTER = r"[\u0e01-\u0e46][\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]*"
# Four letters at least, each parted from the next by one character; letters with signs, which may be words, not by a space, except in Thai.
_SPACED = re.compile(rf"(?<![{_MARKS}])(?<!{_LETTER})(?:(?:{_LETTER}[ .\-*_·]){{3,}}{_LETTER}|(?:{_LETTER}[{_MARKS}]*[.\-*_·]){{3,}}{_LETTER}[{_MARKS}]*|(?:{_THAI_LETTER}[ .\-*_·]){{3,}}{_THAI_LETTER})(?![{_MARKS}]|{_LETTER})")
_PARTING = re.compile(r"[ .\-*_·]")
_ANY_SIGN = re.compile(f"[{_MARKS}\u0e00-\u0e7f]")
# What every match of _SPACED holds, but for bare letters parted by none of '*' and '_', which read_tokens joins as tokens.
_MAY_BE_SPACED = re.compile(
    rf"[*_](?:{_LETTER}[{_MARKS}]*[ .\-*_·]|(?<= {_LETTER}[*_]))|[.\-·]{_LETTER}(?:[{_MARKS}]*[*_]|[{_MARKS}]*[.\-·]{_LETTER}[{_MARKS}]|[{_MARKS}]+[.\-·])|[{_MARKS}][.\-·]{_LETTER}[{_MARKS}]*[.\-·]|[ก-๎][ .\-*_·]{_THAI_LETTER}[ .\-*_·]"
)
_LONG = re.compile(rf"([^\W\d_]|[{_MARKS}])\1{{2,}}")
_NUMBERED = re.compile(r"([a-z]+)\d+[a-z]?")
_LABEL = re.compile(r"\[[^\[\]\n]{0,40}\]|【[^【】\n]{0,40}】|<\|[^<>]{0,20}\|>")
_IN = rf"(?:(?![{_WIDE}฀-๿])[\w*'@$ऀ-ॣ०-ॿ])"
_TOKEN = re.compile(rf"[a-z0-9][a-z0-9*'@$\u00c0-\u024f\u0370-\u04ff]*|[{_WIDE}]|[฀-๿]+|(?![_{_WIDE}฀-๿])\w{_IN}*", re.U)


def read_tokens(text: str) -> list[str]:
    """Tokens of a text with the usual disguises undone: look-alikes, hidden characters, digits for letters, letters (four at least) parted by inserted characters, letters of any script stretched to three or more."""
    if text.isascii():
        text = _LABEL.sub(" ", text.lower())
    else:
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _HIDDEN.sub("", text)
        if _ANY_SHAPE.search(text):
            text = text.translate(_SHAPES)
        text = text.lower()
        text = _SPLIT_WIDE.sub("", _LABEL.sub(" ", text))
    if ("*" in text or "_" in text or _ANY_SIGN.search(text)) and _MAY_BE_SPACED.search(text):
        text = _SPACED.sub(lambda m: _PARTING.sub("", m[0]), text)
    if _has_triple(text):
        text = _LONG.sub(r"\1", text)
    out: list[str] = []
    letters = 0  # single letters in a row, which may spell a word
    for t in _TOKEN.findall(text):
        if len(t) == 1:
            if "\u3040" <= t <= "\u9fff":
                if letters:
                    letters = _join(out, letters)
                out.append(t)
                continue
            if t.isalpha() and not "\u0e00" <= t <= "\u0e7f":
                letters += 1
            elif letters:
                letters = _join(out, letters)
            if t.isdigit():
                t = "0"
            out.append(t)
            continue
        if letters:
            letters = _join(out, letters)
        if t.isalpha():
            if "\u0e00" <= t[0] <= "\u0e7f":
                out += _pieces(t)
            else:
                out.append(t)
        elif "\u0e00" <= t[0] <= "\u0e7f":
            out += _pieces(t)
        elif t.isdigit():
            out.append("0")
        elif t.isascii():
            t = re.sub(r"\*+", "*", t)
            if m := _NUMBERED.fullmatch(t):
                t = m[1]
            elif sum(map(str.isalpha, t)) > 1:
                t = t.translate(_LEET)
            out.append(t)
        else:
            out.append(t)
    if letters:
        _join(out, letters)
    return out


def _has_triple(text: str) -> bool:
    """Whether any letter or sign stands three times in a row."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    same = c[1:] == c[:-1]
    return any(x > 0x7F or chr(x).isalpha() for x in c[2:][same[1:] & same[:-1]].tolist())


def _pieces(t: str) -> list[str]:
    """Overlapping pieces of a script without word boundaries, one from each place, so that a word's pieces don't depend on where it stands."""
    return [t[i : i + 4] for i in range(max(1, len(t) - 3))]


def _join(out: list[str], letters: int) -> int:
    """Join the last tokens, single letters, to a word if there are four at least."""
    if letters > 3:
        out[-letters:] = [_LONG.sub(r"\1", "".join(out[-letters:]))]
    return 0


# --- Tokens as numbers -------------------------------------------------------------------------------------------

START = 1
_SLICE = 1_000_000  # tokens looked at in one go


class Numbers:
    """The number of a token: 31 bits of a hash, so that no dictionary of the corpus is needed."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __reduce__(self):
        return Numbers, ()

    def of(self, tokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        return [known.get(t) or known.setdefault(t, xxhash.xxh32_intdigest(t) & 0x7FFFFFFF | 2) for t in tokens]


def pair_numbers(tokens: np.ndarray) -> np.ndarray:
    """For each place the number of the pair of the token before it and the token there."""
    before = np.append([0], tokens[:-1]).astype(np.uint64)
    x = (before * np.uint64(0x9E3779B97F4A7C15) + tokens.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
    return ((x ^ x >> np.uint64(29)) >> np.uint64(1)).view(np.int64)


def token_table(documents: DataFrame) -> DataFrame:
    """``doc_id, source, lang, tokens``: the numbers of the tokens of each whole text, cut from its lineage."""
    numbers = Numbers()
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [numbers.of(read_tokens(t)) if t else [] for t in batch.column(3).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter((x for one in lists for x in one), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return cut(picked.mapInArrow(run, "doc_id bigint, source string, lang string, tokens array<int>"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, starts, tokens) of a batch, a bounded number of tokens at a time; each text has START before it, at its start."""
    column = batch.column(batch.schema.get_field_index("tokens"))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + _SLICE, side="right")))
        own = sizes[a:b]
        starts = np.cumsum(own + 1) - own - 1
        tokens = np.full(int(own.sum()) + b - a, START, dtype=np.int64)
        place = np.ones(len(tokens), dtype=bool)
        place[starts] = False
        tokens[place] = flat[done : ends[b - 1]]
        yield slice(a, b), starts, tokens
        a = b


class Table:
    """Values of numbers; most numbers that are asked for aren't in it, which one look at a bitmap tells."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = np.asarray(keys, dtype=np.int64)[order], np.asarray(values, dtype=np.float64)[order]
        self.mask = (1 << max(12, int(len(keys) * 16).bit_length())) - 1
        self.maybe = np.zeros(self.mask + 1, dtype=bool)
        self.maybe[self.keys & self.mask] = True

    def __reduce__(self):
        return Table, (self.keys, self.values)

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the numbers that are in the table, their places in it)."""
        at = np.flatnonzero(self.maybe[numbers & self.mask])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.keys, numbers[at]), len(self.keys) - 1)
        same = self.keys[found] == numbers[at]
        return at[same], found[same]


# --- The model ---------------------------------------------------------------------------------------------------


def _labelled_counts(tokens: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``pair, key, own, y1, y0``: counts of tokens and pairs in the abusive and in the clean documents of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = np.asarray(batch.column(1).to_pylist(), dtype=np.int64)
            for rows, starts, flat in _texts(batch):
                sizes = np.diff(np.append(starts, len(flat)))
                bad = np.repeat(verdict[rows], sizes)
                inside = np.ones(len(flat), dtype=bool)
                inside[starts] = False
                for pair, numbers in ((False, flat), (True, pair_numbers(flat))):
                    keys, first, back = np.unique(numbers[inside], return_index=True, return_inverse=True)
                    y1 = np.bincount(back, weights=bad[inside], minlength=len(keys)).astype(np.int64)
                    every = np.bincount(back, minlength=len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), pair)), pa.array(keys), pa.array(flat[inside][first]), pa.array(y1), pa.array(every - y1)], names=["pair", "key", "own", "y1", "y0"])

    chosen = tokens.join(F.broadcast(verdicts), "doc_id").select("tokens", F.col("bad").cast("int").alias("bad"))
    counted = chosen.mapInArrow(run, "pair boolean, key bigint, own bigint, y1 bigint, y0 bigint")
    return counted.groupBy("pair", "key").agg(F.min("own").alias("own"), F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def _corpus_counts(tokens: DataFrame, single: np.ndarray, pairs: np.ndarray, rate: dict[str, float]) -> DataFrame:
    """``pair, key, n, e``: count of each wanted key in all documents, and the count expected in abusive ones at its languages' ``rate``.

    Every task adds up its own counts and sends each key once.
    """
    usual = rate[""]
    tables = [Table(single, single), Table(pairs, pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(len(t.keys)), np.zeros(len(t.keys))) for t in tables]
        for batch in batches:
            rates = np.array([rate.get(x or "", usual) for x in batch.column(0).to_pylist()])
            for rows, starts, flat in _texts(batch):
                weight = np.repeat(rates[rows], np.diff(np.append(starts, len(flat))))
                for table, numbers, (n, e) in zip(tables, (flat, pair_numbers(flat)), sums):
                    at, place = table.places(numbers)
                    n += np.bincount(place, minlength=len(n))
                    e += np.bincount(place, weights=weight[at], minlength=len(n))
        for pair, (table, (n, e)) in enumerate(zip(tables, sums)):
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), bool(pair))), pa.array(table.keys[has]), pa.array(n[has].astype(np.int64)), pa.array(e[has])], names=["pair", "key", "n", "e"])

    return tokens.select("lang", "tokens").mapInArrow(run, "pair boolean, key bigint, n bigint, e double").groupBy("pair", "key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def log_odds(y1: np.ndarray, y0: np.ndarray, n: np.ndarray, e: np.ndarray, n1: float, n0: float, prior: float, least_z: float, other: float) -> np.ndarray:
    """The score of each key: its log-odds in abusive documents.

    ``y1, y0``: counts in the abusive and the clean documents of the sample, ``n1, n0`` of all their tokens; ``n`` is
    the count in the corpus, ``e`` the count that it lets expect. The Dirichlet prior is ``prior`` times the expected
    count. Where the clean documents hold the key too, the smaller of the two log-odds counts, so that harmless use of
    a word tells. A key counts for abuse only if it is twice as common as expected and ``least_z`` standard deviations
    from it, else it has half the score ``other`` of a key that was never seen in an abusive document.
    """
    a, b = y1 + prior * e + 0.05, e + prior * e + 0.05
    delta = np.log(a / b)
    z = delta / np.sqrt(1 / a + 1 / (np.maximum(0, n - y1) + 1))
    apart = np.log((y1 + 0.5) / max(n1, 1.0)) - np.log((y0 + 0.5) / max(n0, 1.0))
    lower = (y0 > 0) & (apart < delta)
    delta = np.where(lower, apart, delta)
    z = np.where(lower, np.minimum(z, apart / np.sqrt(1 / (y1 + 0.5) + 1 / (y0 + 0.5))), z)
    return np.where(delta > 0, np.where((z >= least_z) & (delta > 0.7), np.minimum(delta, 4.0), other / 2), np.clip(delta, -3.0, other))


class Model:
    """Scores of tokens and of pairs; a pair that is known goes before the token itself."""

    def __init__(self, single: Table, pairs: Table, other: float) -> None:
        self.single, self.pairs, self.other = single, pairs, other

    def __reduce__(self):
        return Model, (self.single, self.pairs, self.other)

    def scores(self, flat: np.ndarray) -> np.ndarray:
        out = np.full(len(flat), self.other)
        for table, numbers in ((self.single, flat), (self.pairs, pair_numbers(flat))):
            at, place = table.places(numbers)
            out[at] = table.values[place]
        out[flat == START] = self.other
        return out


def train(tokens: DataFrame, labels: DataFrame, train_docs: int = 6000, prior: float = 0.3, least_z: float = 1.9, other: float = -0.6) -> Model:
    """The model of a ``token_table`` and reviewers' verdicts.

    ``train_docs`` bounds the labelled documents (those with the least hash of the id); undecided and contradictory
    verdicts are left out. The corpus counts cover all documents, language by language (the 1,000 largest; others
    share one rate). What is collected are counts of keys of the bounded sample.
    """
    decided = labels.where("abusive is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("abusive").alias("lo"), F.max("abusive").alias("hi"))
    verdicts = decided.where("lo = hi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("doc_id", (F.col("hi") == 1).alias("bad"))
    counted = cut(_labelled_counts(tokens, verdicts))
    totals = {r["bad"]: float(r["n"] or 0) for r in tokens.join(F.broadcast(verdicts), "doc_id").groupBy("bad").agg(F.sum(F.size("tokens")).alias("n")).collect()}
    n1, n0 = totals.get(True, 0.0), totals.get(False, 0.0)
    size = tokens.select(F.coalesce("lang", F.lit("")).alias("lang"), F.size("tokens").alias("size"), "doc_id")
    theirs = size.join(F.broadcast(verdicts.where("bad")), "doc_id").groupBy("lang").agg(F.sum("size").alias("m"))
    whole = size.groupBy("lang").agg(F.sum("size").alias("n")).join(F.broadcast(theirs), "lang", "left").orderBy(F.desc("n"), "lang").limit(1000).collect()  # one row for each language
    usual = (n1 + 1) / (sum(r["n"] for r in whole) + 1)
    rate = {r["lang"]: (float(r["m"] or 0) + 2000 * usual) / (r["n"] + 2000) for r in whole if r["lang"]} | {"": usual}
    wanted = counted.where("y1 >= 2").select("pair", "key", "own", "y1", "y0").collect()  # of the bounded sample
    parts = [np.array([tuple(map(int, (r["key"], r["own"], r["y1"], r["y0"]))) for r in wanted if r["pair"] == p], dtype=np.int64).reshape(-1, 4) for p in (False, True)]
    found = {(r["pair"], r["key"]): (r["n"], r["e"]) for r in _corpus_counts(tokens, parts[0][:, 0], parts[1][:, 0], rate).collect()} if wanted else {}
    values = []
    for pair, part in enumerate(parts):
        ne = np.array([found.get((bool(pair), k), (0, 0.0)) for k in part[:, 0].tolist()], dtype=np.float64).reshape(-1, 2)
        values.append(log_odds(part[:, 2].astype(float), part[:, 3].astype(float), ne[:, 0], ne[:, 1], n1, n0, prior, least_z, other))
    # Pairs of a word that counts for abuse which only clean documents hold: harmless uses of it.
    bad_words = parts[0][values[0] > 0, 0].tolist()
    clean = [r["key"] for r in counted.where("pair and y1 < 2 and y0 >= 2").where(F.col("own").isin(bad_words)).select("key").collect()] if bad_words else []
    return Model(Table(parts[0][:, 0], values[0]), Table(np.append(parts[1][:, 0], np.array(clean, dtype=np.int64)), np.append(values[1], np.full(len(clean), other))), other)


# --- Segments and their calibration ------------------------------------------------------------------------------


def best_segments(scores: list[float] | np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, from, to), in linear time; only tokens that count for abuse are walked."""
    s = np.asarray(scores, dtype=np.float64)
    through = np.cumsum(s)
    stack: list[tuple[float, float, int, int]] = []  # (sum before, sum through, from, to)
    for i in np.flatnonzero(s > 0).tolist():
        left, right, start = float(through[i - 1]) if i else 0.0, float(through[i]), i
        while stack:
            # The nearest earlier segment whose left sum is smaller.
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, right, start, i + 1))
    return [(r - l, a, b) for l, r, a, b in stack]




def segments(tokens: DataFrame, model: Model) -> DataFrame:
    """``doc_id, source, n, segments``: all maximal-scoring segments of each document (score, first token, token behind the last)."""
    schema = "doc_id bigint, source string, n int, segments array<struct<score:double,first:int,last:int>>"
    kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for rows, starts, flat in _texts(batch):
                values, edges = model.scores(flat), np.append(starts, len(flat)).tolist()
                positive = np.add.reduceat(values > 0, starts) if len(starts) else []
                for i in range(rows.stop - rows.start):
                    a, b = edges[i] + 1, edges[i + 1]
                    sizes.append(b - a)
                    found.append([{"score": s, "first": f, "last": t} for s, f, t in best_segments(values[a:b])] if positive[i] else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(found, kind)], names=["doc_id", "source", "n", "segments"])

    return tokens.select("doc_id", "source", "tokens").mapInArrow(run, schema)


def fit_extremes(best: np.ndarray, length: np.ndarray, weight: np.ndarray, share: float = 0.85) -> tuple[float, float]:
    """(lambda, K) of P(best score in n tokens <= x) = exp(-K n exp(-lambda x)), by maximum likelihood.

    The best scores above the ``share`` quantile, where abusive documents lie (fewer than one in seven is taken to be
    abusive), are censored: only that they are above it counts. A document without any segment has the best score 0;
    if there is nothing else below the quantile, lambda is 1 and K lets expect one segment in all those documents.
    """
    order = np.argsort(best)
    best, length, weight = best[order], length[order], weight[order]
    at = best[min(int(np.searchsorted(np.cumsum(weight) / weight.sum(), share)), len(best) - 1)] if len(best) else 0.0
    none, seen, above = best <= 0, (best > 0) & (best <= at), best > at
    if not seen.any():
        return 1.0, 1 / max(1.0, float((length * weight)[none].sum()))
    top = (-math.inf, 1.0, 1e-3)
    for lam in np.arange(0.05, 3.0, 0.02):
        e = length * np.exp(-lam * best)
        spent = (weight * e)[seen].sum() + (weight * length)[none].sum()
        k = weight[seen].sum() / max(spent, 1e-9)
        beyond = -np.expm1(-k * length[above] * math.exp(-lam * at))
        ll = (weight[seen] * np.log(lam * k * e[seen])).sum() - k * spent + (weight[above] * np.log(np.maximum(beyond, 1e-300))).sum()
        top = max(top, (float(ll), float(lam), float(k)))
    return top[1], top[2]


def calibrate(found: DataFrame) -> tuple[float, float]:
    """(lambda, K), fitted on the best scores of all documents, counted in classes of score and length."""
    best = F.least(F.round(F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0)), 1), F.lit(60.0))
    cells = found.where("n > 0").groupBy(best.alias("best"), F.round(F.log("n") * 4).alias("size")).agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("n")).collect()  # a bounded number of classes
    return fit_extremes(*[np.array([float(r[c]) for r in cells]) for c in ("best", "n", "k")])


def surprise(score: Column, n: Column, lam: float, k: float) -> Column:
    """-log10 of the probability that a clean text of n tokens has a segment of this score."""
    e = F.log(F.lit(k) * F.greatest(n, F.lit(1))) - F.lit(lam) * score  # log of the expected number
    return F.when(e < -20, -e / math.log(10)).otherwise(-F.log10(F.greatest(F.lit(1e-12), -F.expm1(-F.exp(F.least(e, F.lit(50.0)))))))


def score_documents(documents: DataFrame, labels: DataFrame, least: float = 4.0, report: float = 2.0, train_docs: int = 6000) -> DataFrame:
    """``doc_id, source, score, abusive, n_segments, first_token, last_token`` for every document.

    ``score``: -log10 of the probability of the best segment, plus those of further segments above ``report`` each.
    ``abusive``: the best segment alone reaches ``least``, which one clean text in 10 ** ``least`` does. The tokens are
    those of the best passage (null if none reaches ``report``); ``passage`` cuts them out. Null and empty texts score
    0; a repeated row is scored again; other columns are not read. Without any abusive verdict nothing is abusive.
    """
    tokens = token_table(documents)
    found = cut(segments(tokens, train(tokens, labels, train_docs)))
    lam, k = calibrate(found)
    valued = found.select("doc_id", "source", F.array_sort(F.transform("segments", lambda s: F.struct((-surprise(s["score"], F.col("n"), lam, k)).alias("v"), s["first"].alias("first"), s["last"].alias("last")))).alias("all"))
    strong = F.filter("all", lambda s: s["v"] <= -report)
    best = F.coalesce(-F.get("all", F.lit(0))["v"], F.lit(0.0))
    score = F.when(F.size(strong) > 0, F.aggregate(strong, F.lit(0.0), lambda a, s: a - s["v"])).otherwise(best)
    top = F.get(strong, F.lit(0))
    return valued.select("doc_id", "source", score.alias("score"), (best >= least).alias("abusive"), F.size(strong).alias("n_segments"), top["first"].alias("first_token"), (top["last"] - 1).alias("last_token"))


def passage(text: str | None, first: int | None, last: int | None) -> str | None:
    """The tokens of a passage, as they were read."""
    return None if text is None or first is None or last is None else " ".join(read_tokens(text)[first : last + 1])


def source_rates(scored: DataFrame) -> DataFrame:
    """``source, n_docs, n_abusive, rate``; a null source is a source of its own."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"))
