"""Question answering over stored vectors, in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import vectors as V
from quillspark.sources.store import scratch

#: What an answer says where the model failed.
FAILED = "The model gave no answer."


def prompt(passages: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer from these passages only.\n\nPassages:\n"), passages, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def redaction_prompt(text: Column, keep: list[str] | None = None, placeholder: str = "[REDACTED]") -> Column:
    """What a model is asked for a text without names of companies and customers, but for those in ``keep``."""
    allowed = f" Leave these names as they are: {', '.join(sorted(set(keep)))}." if keep else ""
    return F.concat(F.lit(f"Replace every company and customer name by {placeholder} and change nothing else.{allowed}\n\nText:\n"), text, F.lit("\n\nRewritten text:"))


def redact_by_model(docs: DataFrame, model: Callable[[], Callable[[str], str]], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the text that a model makes of the redaction prompt, or with its error and no text.

    ``model`` builds the client once a task. Rows that have an error already, and null texts, are not sent.
    """

    @F.pandas_udf("struct<text:string,error:string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = model()
        for prompts in batches:
            out: list[tuple[str | None, str | None]] = []
            for p in prompts:
                try:
                    out.append((None if p is None else client(p), None))
                except Exception as e:  # noqa: BLE001  one text that fails is one row with an error
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["text", "error"])

    had = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    sent = docs.withColumn("__had", had).withColumn("__r", call.asNondeterministic()(F.when(F.col("__had").isNull(), redaction_prompt(F.col(text), keep))))
    made = sent.withColumns({text: F.when(F.col("__had").isNull(), F.col("__r.text")), "error": F.coalesce("__had", "__r.error")})
    return made.drop("__had", "__r")


def ask(questions: DataFrame, store: DataFrame, k: int = 5, make: Callable[[], Callable[[str], list[float]]] = V.HashedWords, answer: Callable[[str], str] | None = None, places: Callable[[Column], Column] | None = None) -> DataFrame:
    """Answers of ``questions`` (query_id, query) from ``store`` (vec_id, chunk, embedding, metadata).

    Returns query_id, answer, chunks (chunk, metadata, distance and rank, in order) and error. The
    default answer is the nearest passage; ``answer`` may call a model with the prompt, and its
    failure becomes a fixed sentence. A question without words gets no hits and an error.

    Questions are embedded once and written. The texts of the hits are fetched from the store by
    their ids, which are few: it had better be a written table too.

    With ``places`` (:func:`vectors.places`) the store has a column of that name and ranks are those of
    :func:`vectors.search_batch` with it; the default answer is null where nothing matches.
    """
    path = scratch(questions.sparkSession, "questions")
    more = [places(F.col("query")).alias("places")] if places else []
    V.embed(questions, "query", make).select("query_id", "query", "embedding", *more).write.parquet(path)
    asked = questions.sparkSession.read.parquet(path)
    found = V.search_batch(store, asked.drop("query"), k, places="places" if places else None)
    hits = found.join(store.select("vec_id", "chunk", "metadata"), "vec_id")
    near = F.array_sort(F.collect_list(F.struct("rank", "chunk", "metadata", "distance")))
    # The context comes from the collected hits, so that the store is searched once.
    passages = F.array_join(F.transform("chunks", lambda x: x["chunk"]), "\n\n")
    matched = F.min_by("matched", "rank") if places else F.lit(True)
    per = hits.groupBy("query_id").agg(near.alias("chunks"), matched.alias("matched")).withColumn("context", passages)
    rows = asked.select("query_id", "query", "embedding").join(per, "query_id", "left")
    text = F.when(F.col("matched"), F.element_at("chunks", 1)["chunk"])
    if answer is not None:

        @F.pandas_udf("string")
        def call(prompts: pd.Series) -> pd.Series:
            def one(p: str | None) -> str | None:
                try:
                    return None if p is None else answer(p).strip()
                except Exception:  # noqa: BLE001  the caller gets the sentence
                    return FAILED

            return prompts.map(one)

        text = call(prompt(F.col("context"), F.col("query")))
    none = F.array().cast("array<struct<rank:int,chunk:string,metadata:string,distance:double>>")
    return rows.select("query_id", text.alias("answer"), F.coalesce("chunks", none).alias("chunks"), F.when(F.size("embedding") == 0, F.lit("no vector for the question")).alias("error"))
