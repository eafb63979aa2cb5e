"""Held-out precision and recall of the abuse scores: ``python -m castwright.llm.heldout DIR``.

The agreed verdicts are cut into two halves by a hash of the document; a model of either is held against the other. A
verdict of one reviewer is wrong now and then, so documents on which two reviewers agree are reported beside all.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.llm.abuse import score_documents
from castwright.session import local_session, table


def held_out(documents: DataFrame, labels: DataFrame) -> list[dict]:
    """For either half ``half, verdicts, n, precision, recall``."""
    agreed = labels.where("abusive is not null").groupBy("doc_id").agg(F.min("abusive").alias("lo"), F.max("abusive").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo = hi")
    halves = agreed.select("doc_id", (F.col("lo") == 1).alias("bad"), "k", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"))
    out = []
    for half in (0, 1):
        own = halves.where(F.col("half") == half).select("doc_id", F.col("bad").cast("int").alias("abusive"))
        flagged = score_documents(documents, own).select("doc_id", "abusive")
        held = halves.where(F.col("half") != half).join(flagged, "doc_id").groupBy("k").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad") & F.col("abusive")).alias("both"), F.count_if("abusive").alias("found"), F.count_if("bad").alias("true")
        ).collect()
        for name, least in (("all", 1), ("of two reviewers", 2)):
            n, both, found, true = (sum(r[c] for r in held if r["k"] >= least) for c in ("n", "both", "found", "true"))
            out.append({"half": half, "verdicts": name, "n": n, "precision": round(both / max(found, 1), 3), "recall": round(both / max(true, 1), 3)})
    return out


if __name__ == "__main__":
    session = local_session("8", 8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    for row in held_out(table(session, sys.argv[1], "documents"), table(session, sys.argv[1], "doc_labels")):
        print(row)
