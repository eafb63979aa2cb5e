"""One form for visually identical text.

The corpus's distinct units (a character with its combining marks) are mapped to look-alikes, grouped in SQL under the
accent- and case-sensitive Unicode collation, and each class gets one canonical member, which is joined back into every
text. The units are few however large the corpus is, since every task sends each of its distinct units once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.session import cut

# Letters of equal shape in Cyrillic, Greek and Armenian, and the Latin letters that they look like.
SHAPES_FROM = "АВЕЅІЈКМНОРСТХҮԌԚԜаеіјорсухѕԁԛԝһҽ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορυ" "ՕՏՍհոսցօ" "ıɑɡℓ"
SHAPES_TO = "ABESIJKMHOPCTXYGQWaeijopcyxsdqwhe" "ABEZHIKMNOPTYXvopu" "OSUhnugo" "ıagl"
# Signs of equal shape.
SIGNS_FROM = "‐‑꞉∶․ʼꓸ‚ǃ"
SIGNS_TO = "--::.’.,!"
# CJK radicals without a decomposition, and the characters that they look like.
RADICALS_FROM = "⺁⺅⺉⺋⺎⺐⺓⺘⺠⺡⺢⺣⺤⺨⺩⺪⺫⺭⺮⺯⺰⺱⺲⺶⺷⺸⺹⺼⺽⻀⻂⻃⻄⻅⻆⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻱"
RADICALS_TO = "厂亻刂㔾兀尣幺扌民氵氺灬爫犭王疋目礻竹糸纟网罒羊羊羊耂肉臼艹衤覀西见角讠贝足车辶辶辶阝钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄齐齿龙龟"
_UNIT = r"[^\p{M}\p{Cf}](?:\p{Cf}*\p{M})*|\p{Cf}|\p{M}+"


def _folds(c: str) -> bool:
    """Whether the compatibility form of a character looks the same: width of letters and digits, ligatures, radicals."""
    kind = unicodedata.decomposition(c).split(" ", 1)[0]
    o = ord(c)
    if kind == "<wide>":
        return 0xFF10 <= o <= 0xFF19 or 0xFF21 <= o <= 0xFF3A or 0xFF41 <= o <= 0xFF5A
    if kind == "<narrow>":
        return 0xFF66 <= o <= 0xFF9D or 0xFFA0 <= o <= 0xFFDC
    return kind == "<compat>" and (0x2F00 <= o <= 0x2FD5 or 0x2E80 <= o <= 0x2EFF or 0xFB00 <= o <= 0xFB06 or 0x2160 <= o <= 0x217F)


@cache
def shape(unit: str) -> str:
    """The look-alike of a unit: '' if it is invisible."""
    out = []
    table = dict(zip(SHAPES_FROM + SIGNS_FROM + RADICALS_FROM, SHAPES_TO + SIGNS_TO + RADICALS_TO))
    for c in unicodedata.normalize("NFD", unit):
        kind = unicodedata.category(c)
        if kind == "Zs" or c == "\t":
            c = " "
        elif kind == "Cf" or c in "͏ᅟᅠㅤﾠ" or "︀" <= c <= "️":
            c = ""
        elif _folds(c):
            c = unicodedata.normalize("NFKC", c)
        out.append("".join(table.get(x, x) for x in c))
    return unicodedata.normalize("NFC", "".join(out))


def unit_classes(texts: DataFrame, column: str) -> DataFrame:
    """``unit, canonical`` for each unit of the corpus that isn't its own canonical member.

    The canonical member of a class is the one that is its own look-alike with the least code points, or else the
    look-alike itself; it is the same whatever else the corpus holds.
    """

    def distinct_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            new: set[str] = set()
            for text in batch["text"]:
                new.update(text)
                if not text.isascii() and (marked := marked_unit(text)):
                    new.update(marked.findall(text))
            new = {u for u in new if len(u) > 1 or ord(u) > 127} - seen
            seen |= new
            if new:
                yield pd.DataFrame({"unit": sorted(new)})

    units = texts.select(F.col(column).alias("text")).where("text is not null").mapInPandas(distinct_units, "unit string").distinct()

    @F.pandas_udf("string")
    def shaped(u: pd.Series) -> pd.Series:
        return u.map(shape)

    members = units.select("unit", shaped("unit").alias("mapped"))
    # The look-alike is a member too, whether or not the corpus has it.
    both = members.unionByName(members.select(F.col("mapped").alias("unit"), "mapped")).distinct()
    return both.sparkSession.sql(
        """
        with classes as (
            select min(struct(unit <> mapped as other, length(unit) as size, unit)).unit as canonical, collect_set(unit) as units
            from {both} group by collate(mapped, 'UNICODE')
        )
        select u as unit, canonical from classes lateral view explode(units) as u where u <> canonical
        """,
        both=both,
    )


@lru_cache(maxsize=4096)
def _pattern(marks: str, hidden: str) -> re.Pattern:
    m, cf = re.escape(marks), re.escape(hidden)
    between = f"[{cf}]*" if cf else ""
    return re.compile(f"[^{m}{cf}](?:{between}[{m}])+|[{m}]+")


def marked_unit(text: str) -> re.Pattern | None:
    """Matches a character with combining marks, whatever invisible characters stand between, and lone marks, of all planes; null if the text has no mark."""
    kinds = {c: unicodedata.category(c) for c in set(text) if ord(c) > 127}
    marks = "".join(sorted(c for c, k in kinds.items() if k[0] == "M"))
    return _pattern(marks, "".join(sorted(c for c, k in kinds.items() if k == "Cf"))) if marks else None


class Replacer:
    """Replaces whole units in a text; its tables are made once where it arrives."""

    def __init__(self, pairs: dict[str, str]) -> None:
        self.pairs = pairs
        self.single = {ord(u): c for u, c in pairs.items() if len(u) == 1}
        self.marked = {u: c for u, c in pairs.items() if len(u) > 1}
        self.any = re.compile("|".join(map(re.escape, sorted({u[-1] for u in self.marked})))) if self.marked else None

    def __reduce__(self):
        return Replacer, (self.pairs,)

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if self.any is not None and self.any.search(text) and (found := marked_unit(text)):
            text = found.sub(lambda m: self.marked.get(m[0], m[0]), text)
        return text.translate(self.single)


def canonical_column(df: DataFrame, column: str, classes: DataFrame, result: str, broadcast_units: int = 50_000) -> DataFrame:
    """``df`` with ``result``: the text of ``column`` in its canonical form; null stays null, '' stays ''.

    The classes travel to the executors while they are at most ``broadcast_units`` (about 1 MB), which is counted
    first. Beyond that they are joined to the exploded units of the distinct texts. Other columns are kept.
    """
    pairs = classes.limit(broadcast_units + 1).collect()
    if len(pairs) <= broadcast_units:
        known = {r["unit"]: r["canonical"] for r in pairs}
        replace = Replacer(known)

        @F.pandas_udf("string")
        def canonical(texts: pd.Series) -> pd.Series:
            return texts.map(replace)

        return df.withColumn(result, canonical(F.col(column)))
    key = F.sha2(F.col(column), 256)
    exploded = df.where(F.col(column).isNotNull()).select(key.alias("__key"), F.col(column).alias("__text")).dropDuplicates(["__key"]).select("__key", F.posexplode(F.regexp_extract_all("__text", F.lit(_UNIT), F.lit(0))).alias("__pos", "unit"))
    back = exploded.join(classes, "unit", "left").groupBy("__key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", F.coalesce("canonical", "unit").alias("c")))), lambda x: x["c"]), "").alias(result))
    joined = df.withColumn("__key", key).join(back, "__key", "left").drop("__key")
    return joined.withColumn(result, F.when(F.col(column) == "", F.lit("")).otherwise(F.col(result)))


def _classes_of(docs: DataFrame) -> DataFrame:
    """The classes of all full texts and quotes; written once, since they are read for each column."""
    return cut(unit_classes(docs.select("full_text").unionByName(docs.select(F.explode("quotes").alias("full_text"))), "full_text"))


def canonical_documents(output_docs: DataFrame) -> DataFrame:
    """``episode_id, kp_no, text``: the canonical form of every full text (kp_no 0) and quote; null stays null, repeated rows are repeated."""
    docs = output_docs.select("episode_id", "full_text", F.transform(F.coalesce("key_points", F.array()), lambda k: k["quote"]).alias("quotes"))
    texts = docs.select("episode_id", F.lit(0).alias("kp_no"), F.col("full_text").alias("typed")).unionByName(
        docs.select("episode_id", F.posexplode("quotes").alias("at", "typed")).select("episode_id", (F.col("at") + 1).alias("kp_no"), "typed")
    )
    return canonical_column(texts, "typed", _classes_of(docs), "text").select("episode_id", "kp_no", "text")


def equal_looking_quotes(output_docs: DataFrame) -> DataFrame:
    """``episode_id, kp_no, quote, canonical_quote``: quotes that look like a passage of the full text but aren't contained in it.

    Null and empty quotes and those without any visible character are no case. Exact duplicates of a row count once.
    """
    docs = output_docs.where("full_text is not null and key_points is not null").select("episode_id", "full_text", F.transform("key_points", lambda k: k["quote"]).alias("quotes"))
    quoted = docs.select("episode_id", "full_text", F.posexplode("quotes").alias("at", "quote")).where("quote is not null and quote <> ''").where(~F.contains("full_text", "quote"))
    # Only texts with a quote that isn't found as it stands need the canonical form; the classes come from all texts.
    classes = _classes_of(docs)
    doubtful = quoted.groupBy("episode_id", "full_text").agg(F.collect_set(F.struct("at", "quote")).alias("quotes"))
    whole = canonical_column(doubtful, "full_text", classes, "canonical_text").select("episode_id", "canonical_text", F.explode("quotes").alias("q")).select("episode_id", "canonical_text", "q.*")
    both = canonical_column(whole, "quote", classes, "canonical_quote")
    return both.where("trim(canonical_quote) <> ''").where(F.contains("canonical_text", "canonical_quote")).select("episode_id", (F.col("at") + 1).alias("kp_no"), "quote", "canonical_quote").distinct()
