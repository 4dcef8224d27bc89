"""Evidence for a prompt, assembled in order within each question (a few rows each, cut by rank before)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.common import written
from strandlake.operators.retrieval import answer_intent

#: What an intent asks of the answer, in our own words.
INSTRUCTIONS = {
    "exhaustive": "Name every distinct thing that the evidence supports, twelve at most; say so if it can't show that the list is complete.",
    "ranked": "Name the three to five most relevant things, and for each what in the evidence puts it there.",
    "fact": "Answer this question only, from the evidence given.",
}


def contexts(rows: DataFrame, most: int = 12) -> DataFrame:
    """One text for each question: its first ``most`` rows by place as numbered sources (with their category, where there is one), joined by empty lines."""
    cut = rows.filter(F.col("place") <= most)
    category = F.when(F.length("category") > 0, F.concat(F.lit(" | category: "), "category")).otherwise("") if "category" in rows.columns else F.lit("")
    piece = F.concat(F.lit("[Source "), F.col("place").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), category, F.lit("]\n"), F.coalesce("body", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("place", piece.alias("piece"))))
    return cut.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["piece"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("sources"))


def recent_turns(asked: DataFrame, history: DataFrame, turns: int = 12) -> DataFrame:
    """query_id and the last messages of its session up to its own time, oldest first, deliveries counted once.

    The messages of each session are numbered by hours, so that a long session is no single task, and each question
    takes the ``turns`` numbers before its own.
    """
    once = history.groupBy("message_id").agg(F.min("session_id").alias("session_id"), F.min("msg_role").alias("msg_role"), F.min("content").alias("content"), F.min("sent_at").alias("sent_at"))
    timed = once.dropna(subset=["session_id", "sent_at"]).withColumn("hour", F.date_trunc("hour", "sent_at"))
    before = F.sum("n").over(W.partitionBy("session_id").orderBy("hour").rowsBetween(W.unboundedPreceding, -1))
    hours = timed.groupBy("session_id", "hour").agg(F.count(F.lit(1)).alias("n")).select("session_id", "hour", F.coalesce(before, F.lit(0)).alias("earlier"))
    within = F.row_number().over(W.partitionBy("session_id", "hour").orderBy("sent_at", "message_id"))
    numbered = written(timed.withColumn("within", within).join(hours, ["session_id", "hour"]).select("message_id", "session_id", "msg_role", "content", (F.col("earlier") + F.col("within")).alias("at")))
    own = asked.select("query_id").join(numbered.select(F.col("message_id").alias("query_id"), "session_id", F.col("at").alias("own")), "query_id")
    wanted = own.withColumn("from_end", F.explode(F.sequence(F.lit(1), F.lit(turns)))).withColumn("at", F.col("own") - F.col("from_end"))
    return wanted.join(numbered, ["session_id", "at"]).select("query_id", "from_end", "msg_role", "content")


def chat_prompts(asked: DataFrame, sources: DataFrame, turns: DataFrame) -> DataFrame:
    """The prompt of each question: instruction by intent, recent messages, numbered evidence, the question; empty parts are left out."""
    piece = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    evidence = sources.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("p")))), lambda s: s["p"]), "\n\n").alias("evidence"), F.count(F.lit(1)).alias("sources"))
    line = F.concat(F.coalesce("msg_role", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
    recent = turns.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("from_end")).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n").alias("recent"), F.count(F.lit(1)).alias("turns"))
    made = asked.join(evidence, "query_id", "left").join(recent, "query_id", "left")
    intent = answer_intent(F.col("question"))
    instruction = F.when(intent == "exhaustive", INSTRUCTIONS["exhaustive"]).when(intent == "ranked", INSTRUCTIONS["ranked"]).otherwise(INSTRUCTIONS["fact"])
    part = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c))
    whole = F.concat_ws("\n\n", instruction, part("Recent conversation:\n", F.col("recent")), part("Retrieved evidence:\n", F.col("evidence")), part("Question: ", F.col("question")))
    return made.select("query_id", whole.alias("prompt"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("turns", F.lit(0)).alias("turns"))
