"""Filling training sequences of one length with documents.

Documents are measured in tokens of a public tokenizer and packed partition by partition by best-fit decreasing.
Dual-feasible functions give a lower bound of each partition's sequences; a partition that reaches its bound is
certified optimal. The others release their least filled sequences, exchange those documents and pack again.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.session import cut

TOKENIZER = os.environ.get("CASTWRIGHT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
VOCABULARY_BYTES = 64_000_000
# Fixed value: the pattern that the public byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts; a null text has none."""

    with open(path, "rb") as file:
        vocabulary = file.read()
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)  # of proven size; executors need no copy of the file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in sent.value.splitlines() if line.strip())}
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").mapInPandas(run, "doc_id bigint, n_tokens bigint")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound that the dual-feasible functions U(alpha) and u(k) give for the number of bins."""
    return bound_of_counts(np.bincount(np.asarray(sizes, dtype=np.int64), minlength=capacity + 1), capacity) if len(sizes) else 0


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same of the number of items of each size, from 0 to the capacity."""
    count = count[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    total = count * size
    best = -(-int(total.sum()) // capacity)
    c_upto, t_upto = np.cumsum(count), np.cumsum(total)
    # U(alpha): sizes above capacity - alpha fill a bin, those below alpha count nothing, the rest count as they are.
    alpha = np.arange(1, capacity // 2 + 1)
    full = c_upto[-1] - c_upto[capacity - alpha]
    rest = t_upto[capacity - alpha] - t_upto[alpha - 1]
    best = max(best, int((full + -(-rest // capacity)).max(initial=0)))
    for k in range(1, 21):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # in units of capacity * k
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; items come largest first, equal ones in their given order, each into the fullest bin with room."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins = [0] * len(sizes)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in order:
        s = sizes[i]
        fitting = mask >> s
        if fitting:
            left = s + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            b, left = made, capacity
            made += 1
        bins[i] = b
        room[left - s].append(b)
        mask |= 1 << (left - s)
    return bins


def _pack(capacity: int, several: bool):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece_no"], kind="stable")
        sizes = group["n_tokens"].to_numpy()
        bins = np.array(best_fit_decreasing(sizes.tolist(), capacity))
        made, bound = int(bins.max()) + 1, lower_bound(sizes, capacity)
        fill = np.bincount(bins, weights=sizes)
        # A gap is what a partition has above its bound: its least filled sequences, eight for each of the gap, are
        # released. Of several partitions each also gives its least one, since together they may need fewer.
        rank = np.empty(made, dtype=np.int64)
        rank[np.lexsort((np.arange(made), fill))] = np.arange(made)
        free = (rank < 8 * (made - bound)) | ((rank == 0) & (fill < 0.9 * capacity) if several else False)
        return group[["doc_id", "piece_no", "n_tokens", "part"]].assign(bin=bins, released=free[bins], made=made, bound=bound)

    return pack


_PACKED = "doc_id bigint, piece_no int, n_tokens bigint, part bigint, bin bigint, released boolean, made bigint, bound bigint"


def _packed(documents: DataFrame, capacity: int, group_docs: int, rounds: int, path: str) -> DataFrame:
    """Rows of ``pack_documents``, with the round and partition that packed them, its number of sequences and its bound (null for full sequences of one document)."""
    sizes = token_counts(documents, path).groupBy("doc_id").agg(F.max("n_tokens").alias("n")).where("n > 0")
    pieces = sizes.select("doc_id", "n", F.explode(F.expr(f"sequence(0, cast((n - 1) div {capacity} as int))")).alias("piece_no")).select(
        "doc_id", "piece_no", F.least(F.lit(capacity), F.col("n") - F.col("piece_no").cast("bigint") * capacity).alias("n_tokens")
    )
    pieces = cut(pieces)
    none = F.lit(None).cast("bigint")
    done = pieces.where(f"n_tokens = {capacity}").select(
        "doc_id", "piece_no", "n_tokens", F.concat(F.lit("w-"), "doc_id", F.lit("-"), "piece_no").alias("seq_id"), F.lit(None).cast("int").alias("step"), none.alias("part"), none.alias("made"), none.alias("bound")
    )
    loose = pieces.where(f"n_tokens < {capacity}")
    groups = max(1, math.ceil(loose.count() / group_docs))
    todo = loose.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)))
    for step in range(rounds + 1):
        packed = cut(todo.groupBy("part").applyInPandas(_pack(capacity, groups > 1), _PACKED))
        last = step == rounds or groups == 1 and step > 0 or not packed.where("released").limit(1).count()
        kept = packed if last else packed.where("not released")
        done = done.unionByName(kept.select("doc_id", "piece_no", "n_tokens", F.concat(F.lit(f"{step}-"), "part", F.lit("-"), "bin").alias("seq_id"), F.lit(step).alias("step"), "part", "made", "bound"))
        if last:
            break
        groups = max(1, groups // 2)
        todo = packed.where("released").select("doc_id", "piece_no", "n_tokens", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(step)), F.lit(groups)).alias("part"))
    return done


def pack_documents(documents: DataFrame, capacity: int = 2048, group_docs: int = 20_000, rounds: int = 4, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece_no, start_token, n_tokens, seq_id``: each document whole in one sequence, in pieces only if longer than one.

    ``group_docs`` is the mean number of pieces that one task packs. A document above the capacity gives full
    sequences and a last piece. Texts without tokens take no room and have no row; of rows with one doc_id the longest
    counts. ``rounds`` bounds the exchanges; a round without gaps ends them.
    """
    packed = _packed(documents, capacity, group_docs, rounds, path)
    return packed.select("doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start_token"), "n_tokens", "seq_id")


def packing_report(documents: DataFrame, capacity: int = 2048, group_docs: int = 20_000, rounds: int = 4, path: str = TOKENIZER) -> DataFrame:
    """One row: what was packed, and its certificate.

    ``least_sequences`` is the bound that dual-feasible functions give for all documents together, ``gap`` what was
    made above it, ``n_certified`` of ``n_partitions`` the packings that reached their own bound and are thus optimal,
    ``unused`` the share of room left over, ``fullest`` the tokens of the fullest sequence.
    """
    rows = cut(_packed(documents, capacity, group_docs, rounds, path))
    by_size = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row for each size up to the capacity
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_size:
        count[r["n_tokens"]] = r["n"]
    least = bound_of_counts(count, capacity)
    bins = rows.groupBy("seq_id").agg(F.sum("n_tokens").alias("fill")).agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"), F.max("fill").alias("fullest"))
    parts = rows.where("part is not null").select("step", "part", "made", "bound").distinct().agg(F.count(F.lit(1)).alias("n_partitions"), F.count_if(F.col("made") == F.col("bound")).alias("n_certified"))
    one = bins.withColumn("one", F.lit(1)).join(parts.withColumn("one", F.lit(1)), "one")  # one row each
    unused = F.when(F.col("n_sequences") > 0, F.lit(1.0) - F.col("n_tokens") / (F.col("n_sequences") * capacity)).otherwise(0.0)
    return one.select("n_sequences", "n_tokens", F.lit(least).cast("bigint").alias("least_sequences"), (F.col("n_sequences") - least).alias("gap"), "n_partitions", "n_certified", unused.alias("unused"), "fullest")
