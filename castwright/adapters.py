"""Models outside of the engine, as functions over batches of rows.

A model is made once for each worker by ``load`` and called with batches; the engine only knows the columns that go in
and out. The deterministic models below stand in for real ones in tests.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.operators.chunks import pack_lines
from castwright.plans.continuation import accepted_chunk


class Model(Protocol):
    """Anything that turns a batch of rows into a batch of rows."""

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class ModelError(RuntimeError):
    """A model that can't answer a row; it fails the row's task, which is tried again elsewhere."""


def apply_model(df: DataFrame, load: Callable[[], Model], schema: str, batch_rows: int | None = None) -> DataFrame:
    """Rows of ``schema``: the model's answers to ``df``; the model is loaded once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            step = batch_rows or max(1, len(batch))
            for i in range(0, len(batch), step):
                yield model(batch.iloc[i : i + step].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def transcribe(audio: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Raw payloads of chunks of recordings (episode_id, chunk_idx, content)."""
    from castwright.sources.recognised import RAW

    return apply_model(audio, load, RAW, 1)


def diarize(audio: DataFrame, load: Callable[[], Model]) -> DataFrame:
    return apply_model(audio, load, "episode_id string, dseg_no int, start_ms bigint, end_ms bigint, speaker string", 1)


def embed(clips: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """``episode_id, speaker, embedding`` of clips; a clip without a vector is an error, since its speaker would be lost."""

    def strict() -> Model:
        model = load()

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            out = model(batch)
            if out["embedding"].isna().any():
                raise ModelError("a clip has no embedding")
            return out

        return run

    return apply_model(clips, strict, "episode_id string, speaker string, embedding array<double>", 64)


def punctuate(texts: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """``episode_id, seg_no, text``: a batch that fails is tried row by row; a row that fails keeps its text."""

    def careful() -> Model:
        model = load()

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            try:
                return model(batch)
            except ModelError:
                if len(batch) == 1:
                    return batch[["episode_id", "seg_no", "text"]]
            return pd.concat([run(batch.iloc[i : i + 1].reset_index(drop=True)) for i in range(len(batch))])

        return run

    return apply_model(texts.select("episode_id", "seg_no", "text"), careful, "episode_id string, seg_no int, text string", 32)


def clean_transcripts(transcripts: DataFrame, load: Callable[[], Model], limit: int = 8000) -> DataFrame:
    """``episode_id, text, n_chunks, n_failed``: transcripts cut into chunks of whole lines, cleaned by a model, put together in order.

    A chunk whose answer isn't of the same chunk, is blank or has lost or gained too much keeps its source.
    ``transcripts``: episode_id, raw_text. The model gets and gives episode_id, chunk_no, text.
    """
    chunks = transcripts.select("episode_id", F.posexplode(pack_lines(F.col("raw_text"), limit)).alias("chunk_no", "text"))
    answers = apply_model(chunks, load, "episode_id string, chunk_no int, text string").withColumnRenamed("text", "cleaned").withColumn("returned", F.col("chunk_no"))
    both = chunks.join(answers.dropDuplicates(["episode_id", "chunk_no"]), ["episode_id", "chunk_no"], "left")
    kept = accepted_chunk(F.col("chunk_no"), F.coalesce("returned", F.lit(-1)), F.col("text"), F.col("cleaned"))
    rows = both.select("episode_id", "chunk_no", kept.alias("kept"), (F.col("cleaned").isNull() | (kept != F.col("cleaned"))).alias("failed"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "kept"))), lambda x: x["kept"]), "\n\n")
    return rows.groupBy("episode_id").agg(whole.alias("text"), F.count(F.lit(1)).alias("n_chunks"), F.count_if("failed").alias("n_failed"))


def is_missing_model(message: str) -> bool:
    """Whether an error says that there is no such model."""
    return bool(re.search(r"model[ _]not[ _]found|model_not_exist|does not exist|unknown model|invalid model", message.lower()))


def is_rate_limit(message: str) -> bool:
    """Whether an error says to come back later."""
    return bool(re.search(r"rate[ _]?limit|too many requests|429|overloaded|temporarily|503|502|timeout", message.lower()))


def first_model(wanted: list[str], offered: Callable[[], list[str]] | None, works: Callable[[str], bool]) -> str | None:
    """The first wanted model that is offered, or else that answers a probe; the first wanted one if nothing can be learned for now."""
    try:
        listed = offered() if offered else None
    except ConnectionError:
        return wanted[0] if wanted else None
    pool = [m for m in wanted if listed is None or m in listed]
    return next((m for m in pool if works(m)), None)


# --- Stand-ins ---------------------------------------------------------------------------------------------------


def fake_cleaner(replace: dict[str, str], drop: tuple[int, ...] = ()) -> Callable[[], Model]:
    """Replaces words, and loses the chunks of some numbers."""

    def load() -> Model:
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            text: Any = batch["text"]
            for a, b in replace.items():
                text = text.str.replace(a, b, regex=False)
            return batch.assign(text=text.where(~batch["chunk_no"].isin(drop), ""))[["episode_id", "chunk_no", "text"]]

        return run

    return load
