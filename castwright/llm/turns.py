"""Speech transcripts into clean, ordered speaker turns.

Each unit (a segment or a line) is cut into tokens, and a hidden Markov model tags each token as speaker, timestamp,
annotation, filler or speech (Viterbi). The model is estimated from weakly labelled units: tokens whose form admits
one tag teach the transitions, and the transitions then decide the ambiguous forms. Units without speech are passed
over; turns are maximal sequences of one speaker, assembled by a carried scan over the global order, so that an
episode of any size spreads over many tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.operators.ordered import PART, carried_scan, range_sorted
from castwright.session import cut

UNKNOWN = "UNKNOWN"
TAGS = ("speaker", "time", "note", "filler", "speech")

# Hesitation sounds, role words, speaker words.
FILLERS = (
    "嗯+", "呃+", "额+", "唔+", "啊这", "えっと", "えーと", "ええと", "あのー+", "うーん", "อืม+", "เอ่อ+", "हम्म+", "उम्म+",
    "u+h-?huh", "m+-?hm+", "u+h+", "u+m+", "e+r+m*", "e+m+", "e+h+", "h+m+", "m+", "ä+h+m*",
)
ROLES = "主播|嘉宾|主持人|主持|主理人|主理|客座|机构|host|guest"
SPEAKER_WORDS = "speaker|spkr|spk|说话人|說話人|发言人|話者|讲者"

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_TIME = r"\d{1,4}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_NUMBERED = re.compile(rf"(?:{SPEAKER_WORDS})?[\s_-]*(\d{{1,4}})", re.I)
_LETTER = r"[^\W\d_]"
_FILLER = rf"(?<![\w\u0300-\u036f])(?:{'|'.join(FILLERS)})(?![\w\u0900-\u0963\u0e30-\u0e4e])"
# A CJK filler may stand inside a word, marked off by the comma behind it.
_SPECIAL = re.compile(
    rf"(?P<tag><[^<>]{{0,80}}>|〈[^〈〉]{{0,80}}〉)"
    rf"|(?P<box>\(\([^()]{{0,80}}\)\)|\[[^\[\]]{{0,80}}\]|【[^【】]{{0,80}}】|\([^()]{{0,80}}\)|（[^（）]{{0,80}}）)"
    rf"|(?P<note>\*[^*\s][^*]{{0,40}}\*|[♪♫♬]+)"
    rf"|(?P<time>(?<![\d.,:]){_TIME}(?![\d:])|-->)"
    rf"|(?P<label>(?:^|(?<=[\s\]\)>]))(?:{SPEAKER_WORDS})[\s_-]*\d{{1,4}}(?=\s*[:：(（\[]|\s*$))"
    rf"|(?P<filler>{_FILLER}|(?:嗯+|呃+|额+|唔+|啊这)(?=[，,。.…]))",
    re.I,
)
_NAME_START = re.compile(r"\s*([^:：，,。？！?!「」“”\"…\[\]【】()（）<>]{1,60}?)\s*[:：](?!\d)")
_SPEAKS = re.compile(r"[\w]")
_DIGITS = re.compile(r"\s*\d+\s*$")


def narrow(text: str) -> str:
    """Full-width forms as ASCII; the length stays."""
    return text.translate(_WIDE)


def clean_name(name: str) -> str:
    """A name without role word and brackets."""
    name = name.strip().strip("【】[]").strip()
    name = re.sub(rf"\s*[（(](?:{ROLES})[)）]\s*$", "", name, flags=re.I)
    name = re.sub(rf"^(?:(?:{ROLES})[:：]\s*|(?:主播|嘉宾|主持人|主持|主理人|客座)\s*)", "", name)
    return name.strip()


def read_label(label: str | None) -> tuple[str, bool]:
    """(value, is_name): 'SPEAKER_07', 'UNKNOWN', or a name."""
    bare = narrow(label or "").strip().strip("【】[]():： ").strip()
    if found := _NUMBERED.fullmatch(bare):
        return f"SPEAKER_{int(found[1]):02d}", False
    if bare.lower() in ("", "unknown", "none", "null"):
        return UNKNOWN, False
    return clean_name((label or "").strip().rstrip(":：").strip()), True


def _box_form(inner: str, square: bool) -> str:
    inner = inner.strip("()（）[]【】 ")
    if inner.lower() in NOTES:
        return "note"
    if re.fullmatch(_TIME, inner):
        return "box-time"
    if _NUMBERED.fullmatch(inner) and not inner.isdigit() or inner.lower() == "unknown":
        return "box-number"
    if re.search(r"[\d.!?。！？,，]", inner) or len(inner.split()) > 3 or len(inner) > 24:
        return "box-long"
    return "box-name" if square else "box-short"


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(form, start, end) over the narrow text; neighbouring words are one token."""
    out: list[tuple[str, int, int]] = []

    def gap(a: int, b: int) -> None:
        piece = text[a:b]
        if _SPEAKS.search(piece):
            out.append(("number" if _DIGITS.fullmatch(piece) else "words", a, b))
        elif piece.strip():
            out.append(("marks", a, b))

    at = 0
    for m in _SPECIAL.finditer(text):
        gap(at, m.start())
        form, s = m.lastgroup, m[0]
        if form == "box":
            # 【…】 with few characters is a name only at the start, where speakers stand.
            start = not text[: m.start()].strip() or bool(out) and out[-1][0] in ("time", "box-time", "marks") and len(out) < 3
            form = _box_form(s, s[0] == "【" and start)
        out.append((form, m.start(), m.end()))
        at = m.end()
    gap(at, len(text))
    return out


#: Tags that the form of a token admits; the first is the commoner one. Forms with one tag label the training units.
ADMITS = {
    "tag": ("note",), "box-time": ("time",), "box-number": ("speaker",), "box-short": ("note", "speech"), "box-long": ("speech", "note"),
    "box-name": ("speaker", "note"), "note": ("note",), "time": ("time", "speech"), "label": ("speaker",), "filler": ("filler",),
    "number": ("speech", "time"), "words": ("speech",), "marks": TAGS,
}
# Words of sound annotations.
NOTES = {"music", "applause", "laughs", "laughter", "laugh", "noise", "crosstalk", "inaudible", "silence", "coughs", "音乐", "掌声", "笑", "笑声", "鼓掌", "背景音乐", "背景音乐渐弱", "噪音", "静音", "咳嗽"}


class Tagger:
    """Log probabilities of tag after tag, and of form given tag."""

    def __init__(self, step: dict, emit: dict) -> None:
        self.step, self.emit = step, emit
        self.decode = lru_cache(maxsize=50_000)(self._decode)

    def __reduce__(self):
        return Tagger, (self.step, self.emit)

    def _decode(self, forms: tuple[str, ...]) -> tuple[str, ...]:
        best = {"^": (0.0, ())}
        for form in forms:
            now = {}
            for tag in TAGS:
                e = self.emit[tag, form]
                now[tag] = max((score + self.step[before, tag] + e, path) for before, (score, path) in best.items())
            best = {tag: (score, (*path, tag)) for tag, (score, path) in now.items()}
        return max((score + self.step[tag, "$"], path) for tag, (score, path) in best.items())[1]


#: What a form that a tag doesn't admit may still count for it, so that the chain can overrule the form.
FAINT = 1e-4


def train(units: list[str], alpha: float = 0.1, rounds: int = 3) -> Tagger:
    """Estimate the model on units without tags.

    It starts from weak labels: a form that admits one tag has that tag; a lone number is a line number (time), a
    number among words speech; other forms count by halves for each tag that they admit. Then the units are decoded and
    the model is estimated again from their tags (and the weak ones, with little weight), ``rounds`` times, so that the
    tags of ambiguous forms follow from what stands around them in these texts.
    """
    known = [forms for text in [*units, "1", "[00:01] SPEAKER_00: (laughs) um, yes", "<|en|>um", "【甲】好的 3 个（笑）"] if (forms := tuple(f for f, _, _ in tokens(narrow(text))))]
    step, emit = {}, {}
    for forms in known:
        before = "^"
        for form in forms:
            admits = ADMITS[form]
            if form == "box-short":
                admits = ("note", "note", "note", "speech")
            if form == "number":
                admits = ("time",) if len(forms) == 1 else ("speech",)
            if form == "marks":
                admits = (before,) if before != "^" else ("speech",)
            for tag in admits:
                emit[tag, form] = emit.get((tag, form), 0) + 1 / len(admits)
            step[before, admits[0]] = step.get((before, admits[0]), 0) + 1
            before = admits[0]
        step[before, "$"] = step.get((before, "$"), 0) + 1
    tagger = _estimate(step, emit, alpha)
    for _ in range(rounds):
        more_step, more_emit = {k: 0.3 * n for k, n in step.items()}, {k: 0.3 * n for k, n in emit.items()}
        for forms in known:
            before = "^"
            for form, tag in zip(forms, tagger.decode(forms)):
                more_emit[tag, form] = more_emit.get((tag, form), 0) + 1
                more_step[before, tag] = more_step.get((before, tag), 0) + 1
                before = tag
            more_step[before, "$"] = more_step.get((before, "$"), 0) + 1
        tagger = _estimate(more_step, more_emit, alpha)
    return tagger


def _estimate(step: dict, emit: dict, alpha: float) -> Tagger:
    log_step, log_emit = {}, {}
    for a in ("^", *TAGS):
        total = sum(step.get((a, b), 0) + alpha for b in (*TAGS, "$"))
        log_step |= {(a, b): math.log((step.get((a, b), 0) + alpha) / total) for b in (*TAGS, "$")}
    for tag in TAGS:
        total = sum(emit.get((tag, f), 0) + alpha for f in ADMITS)
        log_emit |= {(tag, f): math.log((emit.get((tag, f), 0) + (alpha if tag in admits else FAINT)) / total) for f, admits in ADMITS.items()}
    return Tagger(log_step, log_emit)


def read_unit(text: str | None, tagger: Tagger, with_text: bool) -> tuple[str | None, bool, bool, bool, str | None]:
    """(label, bare, says, says_if_bare_is_no_label, clean text) of one unit.

    ``label`` is the raw label at the start of the text. ``bare``: it is a name before a colon, which is a label only
    if the episode's mapping has that name.
    """
    if not text:
        return None, False, False, False, ""
    flat = narrow(text)
    toks = tokens(flat)
    tags = tagger.decode(tuple(f for f, _, _ in toks))
    label, bare, says, first_words = None, False, False, True
    for (form, a, b), tag in zip(toks, tags):
        if tag == "speaker" and label is None and form != "marks" and first_words:
            label = text[a:b].strip("【】[]() ")
        elif tag == "speech" and form not in ("marks",):
            if first_words and label is None and form == "words" and (m := _NAME_START.match(text, a)) and m.end() <= b:
                label, bare = m[1], True
                if _SPEAKS.search(text[m.end() : b]):
                    says = True
            else:
                says = True
            first_words = False
    clean = None
    if with_text:
        clean = "".join(text[a:b] for (form, a, b), tag in zip(toks, tags) if tag == "speech" or form == "marks" and tag != "speaker")
        clean = re.sub(r"\s+", " ", clean).strip(" :：，,")
    return label, bare, says, says or bare, clean


_UNITS = "episode_id string, unit int, own string, name string, bare boolean, says boolean, says_bare boolean, lines boolean, text string"


def tag_units(df: DataFrame, tagger: Tagger, with_text: bool) -> DataFrame:
    """One row for each unit (``episode_id, unit, text, speaker, lines``): its label as it stands, and whether it says anything.

    The label stands in the column, or else at the start of the text. ``own`` is the speaker, ``name`` a name that the
    mapping must know; both are null for a line without label. Units that neither say anything nor hold a label are
    left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, tuple[str, bool]] = {}
        for batch in batches:
            rows = []
            for episode, unit, text, speaker, lines in zip(batch["episode_id"], batch["unit"], batch["text"], batch["speaker"], batch["lines"]):
                label, bare, says, says_bare, clean = read_unit(text, tagger, with_text)
                value, is_name = known.get(speaker) or known.setdefault(speaker, read_label(speaker))
                column = value != UNKNOWN or is_name
                if not column and label is not None:
                    value, is_name = (clean_name(label), True) if bare else read_label(label)
                nothing = lines and not column and label is None
                bare = bare and not column
                if says or bare and says_bare or lines and not nothing:
                    rows.append((episode, unit, None if is_name or nothing else value, value if is_name else None, bare, says, says_bare and bare or says, lines, clean))
            yield pd.DataFrame(rows, columns=["episode_id", "unit", "own", "name", "bare", "says", "says_bare", "lines", "text"])

    return df.select("episode_id", "unit", "text", "speaker", "lines").mapInPandas(run, _UNITS)


def clean_names(name: Column) -> Column:
    """``clean_name`` as an expression."""
    name = F.trim(F.regexp_replace(F.trim(name), r"^[【】\[\]]+|[【】\[\]]+$", ""))
    name = F.regexp_replace(name, rf"(?i)\s*[（(](?:{ROLES})[)）]\s*$", "")
    return F.trim(F.regexp_replace(name, rf"^(?:(?:{ROLES})[:：]\s*|(?:主播|嘉宾|主持人|主持|主理人|客座)\s*)", ""))


# --- The label of the last labelled line, carried over the global order -----------------------------------------


def _last_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, first, episode, last = None, None, None, None
    for batch in batches:
        if not len(batch):
            continue
        if part is None:
            part, first = int(batch[PART].iloc[0]), batch["episode_id"].iloc[0]
        end = batch["episode_id"].iloc[-1]
        given = batch.loc[(batch["episode_id"] == end) & batch["speaker"].notna(), "speaker"]
        last = given.iloc[-1] if len(given) else last if end == episode else None
        episode = end
    if part is not None:
        yield pd.DataFrame({PART: [part], "first": [first], "episode": [episode], "last": [last]})


def _carry(state: tuple, row: dict) -> tuple:
    episode, last = state
    goes_on = row["last"] is None and row["first"] == row["episode"] == episode
    return row["episode"], last if goes_on else row["last"]


def _fill(batches: Iterator[pd.DataFrame], state: tuple) -> Iterator[pd.DataFrame]:
    episode, last = state
    for batch in batches:
        at, given = np.arange(len(batch)), batch["speaker"].notna().to_numpy()
        new = np.append([batch["episode_id"].iloc[0] != episode], (batch["episode_id"].to_numpy()[1:] != batch["episode_id"].to_numpy()[:-1]))
        source = np.maximum.accumulate(np.where(given | new, at, -1))  # the last label, or the start of the episode
        labels = batch["speaker"].to_numpy(dtype=object)
        filled = np.where(source < 0, last, labels[np.maximum(source, 0)])
        speaker = pd.Series(filled, dtype=object)
        speaker = speaker.where(speaker.notna(), UNKNOWN)
        says = batch["says"].to_numpy(dtype=bool)
        out = batch[[PART, "episode_id", "unit", "text"]].assign(speaker=speaker.to_numpy())
        yield out[says][[PART, "episode_id", "unit", "speaker", "text"]]
        episode, last = batch["episode_id"].iloc[-1], speaker.iloc[-1]


def _key(batch: pd.DataFrame) -> np.ndarray:
    return (batch["episode_id"] + "\x00" + batch["speaker"]).to_numpy()


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, first, last, tail, whole = None, None, None, None, True
    for batch in batches:
        if not len(batch):
            continue
        key = _key(batch)
        if part is None:
            part, first, last, tail = int(batch[PART].iloc[0]), key[0], key[0], int(batch["unit"].iloc[0])
        new = np.flatnonzero(np.append(key[:1] != last, key[1:] != key[:-1]))
        if len(new):
            whole, tail = False, int(batch["unit"].iloc[new[-1]])
        last = key[-1]
    if part is not None:
        yield pd.DataFrame({PART: [part], "last": [last], "tail": [tail], "whole": [whole]})


def _combine(state: tuple, row: dict) -> tuple:
    last, tail = state
    return (last, tail) if row["whole"] and row["last"] == last else (row["last"], row["tail"])


def _scan(batches: Iterator[pd.DataFrame], state: tuple) -> Iterator[pd.DataFrame]:
    last, tail = state
    for batch in batches:
        key, unit = _key(batch), batch["unit"].to_numpy()
        new = np.append(key[:1] != last, key[1:] != key[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at >= 0, unit[np.maximum(at, 0)], -1 if tail is None else tail)
        yield pd.DataFrame({"episode_id": batch["episode_id"], "speaker": batch["speaker"], "first_unit": first, "unit": unit, "text": batch["text"]})
        last, tail = key[-1], int(first[-1])


def _sample(texts: DataFrame, bound: int) -> list[str]:
    """About ``bound`` texts (all if there are no more), those below a threshold of the hash; they are counted first."""
    n = texts.where("text is not null").count()
    some = texts.where("text is not null").where(F.pmod(F.xxhash64("text", F.lit(2)), F.lit(1_000_000)) < int(min(1.0, 2 * bound / max(1, n)) * 1_000_000) + 1)
    return [r["text"] for r in some.orderBy(F.xxhash64("text"), "text").limit(bound).collect()]


def speaker_turns(segments: DataFrame, transcripts: DataFrame, struct_out: DataFrame, with_text: bool = True, train_units: int = 4000) -> DataFrame:
    """Turns: ``episode_id, first_unit, last_unit, speaker, n_units, text``.

    ``train_units`` bounds the units that the tagger is estimated on (those with the least text hash); every unit is
    tagged. Each (episode_id, seg_no) and each text of an episode counts once, of different rows the least. Null texts
    say nothing; rows without episode_id or seg_no have no place in the order and are left out. A null or blank label
    is no label. A name that the mapping of its episode lacks gives UNKNOWN. Empty tables give no rows; other columns
    are not read. ``with_text=False`` leaves the text null.

    Segments and lines are units of one table; a text of any length spreads over many tasks, and the label of its last
    labelled line comes by a carried scan.
    """
    seg = (
        segments.where("episode_id is not null and seg_no is not null")
        .groupBy("episode_id", F.col("seg_no").cast("int").alias("unit"))
        .agg(F.min(F.struct("text", "speaker")).alias("x"))
        .select("episode_id", "unit", "x.text", "x.speaker", F.lit(False).alias("lines"))
    )
    own = transcripts.where("layout = 'lines' and episode_id is not null").groupBy("episode_id").agg(F.min("raw_text").alias("raw_text"))
    line = own.select("episode_id", F.posexplode(F.split("raw_text", "\n")).alias("unit", "text")).select("episode_id", "unit", "text", F.lit(None).cast("string").alias("speaker"), F.lit(True).alias("lines"))
    tagger = train(_sample(segments.select("text"), train_units // 2) + _sample(transcripts.where("layout = 'lines'").select(F.explode(F.split("raw_text", "\n")).alias("text")), train_units // 2))

    names = (
        struct_out.where("episode_id is not null and speaker_mapping is not null")
        .select("episode_id", F.explode("speaker_mapping").alias("label", "typed"))
        .where("typed is not null")
        .distinct()
        .select("episode_id", clean_names(F.col("typed")).alias("name"), F.regexp_extract("label", r"(\d+)", 1).try_cast("int").alias("n"))
        .where("n is not null and name != ''")
        .groupBy("episode_id", "name")
        .agg(F.format_string("SPEAKER_%02d", F.min("n")).alias("named"))
    )
    # Written once: the two branches below and the sampling for the range sort would each tag every unit again.
    tagged = cut(tag_units(seg.unionByName(line.repartition("episode_id", "unit")), tagger, with_text))
    # The few units with a name are looked up apart, so that no null key meets in one task. A bare name that isn't in
    # the mapping is speech, and its line goes on with the last label.
    stranger = F.col("named").isNull() & F.col("bare")
    called = tagged.where("name is not null").join(names, ["episode_id", "name"], "left").select(
        "episode_id", "unit", F.when(~(stranger & F.col("lines")), F.coalesce("named", F.lit(UNKNOWN))).alias("speaker"), F.when(stranger, F.col("says_bare")).otherwise(F.col("says")).alias("says"), "text"
    )
    units = tagged.where("name is null").select("episode_id", "unit", F.col("own").alias("speaker"), "says", "text").unionByName(called)
    filled = cut(
        carried_scan(
            range_sorted(units, ["episode_id", "unit"]), "first string, episode string, last string", _last_labels, _carry, (None, None),
            f"{PART} int, episode_id string, unit int, speaker string, text string", _fill,
        )
    )
    pieces = carried_scan(
        filled, "last string, tail int, whole boolean", _summaries, _combine, (None, None),
        "episode_id string, speaker string, first_unit int, unit int, text string", _scan,
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda x: x["text"]), " ") if with_text else F.lit(None).cast("string")
    return pieces.groupBy("episode_id", "first_unit", "speaker").agg(F.max("unit").alias("last_unit"), F.count(F.lit(1)).alias("n_units"), text.alias("text")).select("episode_id", "first_unit", "last_unit", "speaker", "n_units", "text")
