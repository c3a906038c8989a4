"""Citation verification: quotes against bodies, claims against sources, abstention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions import text as T


def quotes_found(bodies: DataFrame, quotes: DataFrame, body_id: str, body: str, quote_id: str, quote: str, block: int = 5_000) -> DataFrame:
    """(quote id, body id) wherever a normalised quote stands in a normalised body.

    Quotes are a stated set: they are read block by block, so what is sent is bounded, and each block passes over the
    bodies once with one automaton for all its quotes.
    """
    stated = quotes.select(F.col(quote_id).alias("q"), T.normalise(F.col(quote)).alias("needle")).filter("needle <> ''")
    hay = bodies.select(F.col(body_id).alias("b"), T.normalise(F.col(body)).alias("hay"))
    q_type, b_type = stated.schema["q"].dataType.simpleString(), hay.schema["b"].dataType.simpleString()
    out, batch = None, []

    def flush(some: list) -> DataFrame:
        sent = bodies.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            owners: dict[str, list] = {}
            for q, needle in sent.value:
                owners.setdefault(needle, []).append(q)
            for needle in owners:
                machine.add_word(needle, needle)
            if owners:
                machine.make_automaton()
            for rb in batches:
                qs, bs = [], []
                for b, hay_text in zip(rb.column("b").to_pylist(), rb.column("hay").to_pylist(), strict=True):
                    met = {needle for _, needle in machine.iter(hay_text)} if owners and hay_text else ()
                    for needle in met:
                        qs += owners[needle]
                        bs += [b] * len(owners[needle])
                yield pa.RecordBatch.from_arrays([pa.array(qs, q_arrow), pa.array(bs, rb.column("b").type)], names=[quote_id, body_id])

        from pyspark.sql.pandas.types import to_arrow_type

        q_arrow = to_arrow_type(stated.schema["q"].dataType)
        return hay.mapInArrow(run, f"`{quote_id}` {q_type}, `{body_id}` {b_type}")

    for r in stated.toLocalIterator():
        batch.append((r["q"], r["needle"]))
        if len(batch) == block:
            out, batch = flush(batch) if out is None else out.unionByName(flush(batch)), []
    if batch or out is None:
        out = flush(batch) if out is None else out.unionByName(flush(batch))
    return out


def check_claims(claims: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims (answer_id, source_id, quote) with the chunk they resolve to and whether the quote stands in it.

    ``sources``: answer_id, source_id, chunk_id; ``chunks``: chunk_id, body. Claims that resolve to nothing stay.
    """
    found = claims.join(sources, ["answer_id", "source_id"], "left").join(chunks.select("chunk_id", "body"), "chunk_id", "left")
    resolved = F.col("body").isNotNull()
    return found.withColumn("resolved", resolved).withColumn("valid", F.when(resolved, T.quote_in(F.col("quote"), F.col("body"))).otherwise(False))


def verify_answers(answers: DataFrame, checked: DataFrame, least_precision: float = 0.6) -> DataFrame:
    """Per answer: n_valid, n_invalid, precision, uncited, ungrounded, abstain, reason.

    Each answer's cited bodies are gathered once per chunk; an answer cites a handful of chunks.
    """
    cited = (
        checked.filter("valid").groupBy("answer_id", "chunk_id").agg(F.min("source_id").alias("at"), F.first("body").alias("body")).groupBy("answer_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "body"))), lambda x: x["body"]), " ").alias("cited"))
    )
    counts = checked.groupBy("answer_id").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))
    rows = answers.join(counts, "answer_id", "left").join(cited, "answer_id", "left").fillna(0, ["n_valid", "n_invalid"]).fillna("", ["cited"])
    total = F.col("n_valid") + F.col("n_invalid")
    rows = rows.withColumn("precision", F.when(total > 0, F.col("n_valid") / total).otherwise(0.0)).withColumn("uncited", T.uncited_claims(F.col("answer"))).withColumn("ungrounded", T.ungrounded_numbers(F.col("answer"), F.col("cited")))
    reason: Column = (
        F.when(F.col("answer").rlike(T.OBLIGATION) & (F.col("n_valid") == 0), "no verified citation")
        .when((total > 0) & (F.col("precision") < least_precision), "citations fail")
        .when(F.size("ungrounded") > 0, "ungrounded numbers")
    )
    return rows.withColumn("reason", reason).withColumn("abstain", reason.isNotNull()).drop("cited")
