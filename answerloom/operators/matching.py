"""Answers from the knowledge base: match, route, propagate, pre-fill, record.

Questions are (doc_id, question_index, question_text, ...).  Repeated wordings
are embedded and compared once and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions import text as X
from answerloom.functions.vectors import hashed_embedding
from answerloom.operators.audit import timestamp
from answerloom.operators.ranking import first_per_group
from answerloom.operators.similarity import top_matches
from answerloom.operators.skew import lookup
from answerloom.session import durable


def live(kb: DataFrame, with_embedding: bool = False) -> DataFrame:
    """Entries that are not soft-deleted; matching also needs a vector."""
    rows = kb.filter(F.col("deleted_at").isNull())
    return rows.filter(F.col("embedding").isNotNull()) if with_embedding else rows


def top_by_wording(questions: DataFrame, kb: DataFrame, k: int, cutoff: float, embed=hashed_embedding, digests: bool = False) -> DataFrame:
    """(question_text, kb_id, similarity, rank) for each distinct wording, or its digest ``wording`` instead of the text.

    Wordings are stored with their ids before use, so an id stays with its
    wording when a task is repeated.
    """
    number = lambda df: durable(df.withColumn("id", F.monotonically_increasing_id()))
    if "embedding" in questions.columns:
        wordings = number(questions.groupBy("question_text").agg(F.first("embedding").alias("embedding")))
    else:
        texts = number(questions.select("question_text").filter(F.col("question_text").isNotNull()).distinct())
        wordings = texts.withColumn("embedding", embed("question_text"))
    found = top_matches(wordings.select("id", "embedding"), live(kb).select("id", "embedding"), k, cutoff)
    wording = X.digest(F.col("question_text")).alias("wording") if digests else F.col("question_text")
    return found.join(wordings.select(F.col("id").alias("a"), wording), "a").select(
        "wording" if digests else "question_text", F.col("b").alias("kb_id"), "similarity", "rank"
    )


def best_match(questions: DataFrame, kb: DataFrame, embed=hashed_embedding) -> DataFrame:
    """Each question with its most similar live entry (lowest id on a tie).

    Adds kb_id, similarity, kb_question, kb_answer; with an empty knowledge
    base the similarity is 0 and the rest null.
    """
    found = top_by_wording(questions, kb, 1, -1.0, embed, digests=True).drop("rank")
    entries = live(kb).select(F.col("id").alias("kb_id"), F.col("question").alias("kb_question"), F.col("answer").alias("kb_answer"))
    return (
        lookup(questions.withColumn("wording", X.digest(F.col("question_text"))), found.join(entries, "kb_id"), ["wording"])
        .drop("wording")
        .withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    )


def at_least(similarity: Column, threshold: float) -> Column:
    return F.round(similarity, K.SIMILARITY_DIGITS) >= threshold


def match(questions: DataFrame, kb: DataFrame, threshold: float = K.MATCH_THRESHOLD, embed=hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(matched, flagged) by best similarity."""
    return split_matches(best_match(questions, kb, embed), threshold)


def split_matches(best: DataFrame, threshold: float = K.MATCH_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    hit = F.col("kb_id").isNotNull() & at_least(F.col("similarity"), threshold)
    matched = best.filter(hit).select(
        "doc_id", "question_index", "question_text", F.col("kb_answer").alias("answer_text"),
        F.col("similarity").alias("confidence"), F.col("kb_id").alias("matched_qa_id"), F.lit("kb_match").alias("matched_source"),
    )
    flagged = best.filter(~hit).select(
        "doc_id", "question_index", F.col("question_text").alias("extracted_question"),
        F.col("similarity").alias("similarity_score"), F.col("kb_question").alias("best_match_question"),
    )
    return matched, flagged


def resolved_answers(flags: DataFrame) -> DataFrame:
    """(question_key, resolved_answer): the latest resolution of each question.

    A missing time never beats a known one; ties go to the lowest id.
    """
    return _resolved(flags, lambda key: key)


def _resolved(flags: DataFrame, shape) -> DataFrame:
    """Resolutions by what ``shape`` makes of the question's key."""
    usable = flags.filter(
        F.col("resolved") & F.col("resolved_answer").isNotNull() & (F.col("resolved_answer") != K.DISMISSED)
    )
    keyed = usable.select(
        shape(X.question_key(F.col("extracted_question"))).alias("question_key"), "resolved_answer", "resolved_at", "id"
    )
    latest = F.struct(
        F.col("resolved_at").isNotNull().alias("known"), F.col("resolved_at"), (-F.col("id")).alias("first")
    )
    return keyed.groupBy("question_key").agg(F.max_by("resolved_answer", latest).alias("resolved_answer"))


def match_cascade(
    questions: DataFrame, kb: DataFrame, flags: DataFrame, threshold: float = K.MATCH_THRESHOLD, embed=hashed_embedding
) -> DataFrame:
    """Every question once: from the knowledge base, else from an earlier
    resolution of the same key, else left for a flag (answer_text null).

    An empty resolved answer still counts as a match.
    """
    asked = questions.withColumn("question_key", X.digest(X.question_key(F.col("question_text"))))
    joined = lookup(best_match(asked, kb, embed), _resolved(flags, X.digest), ["question_key"], counted=asked)
    hit = F.col("kb_id").isNotNull() & at_least(F.col("similarity"), threshold)
    reused = ~hit & F.col("resolved_answer").isNotNull()
    kept = [c for c in questions.columns if c not in ("answer_text", "confidence", "matched_qa_id", "matched_source", "embedding")]
    prior = lambda name, kind: F.col(name) if name in questions.columns else F.lit(None).cast(kind)
    return joined.select(
        *kept,
        F.when(hit, F.col("kb_answer")).when(reused, F.col("resolved_answer")).otherwise(prior("answer_text", "string")).alias("answer_text"),
        F.when(hit, F.col("similarity")).when(reused, K.RESOLVED_CONFIDENCE).otherwise(prior("confidence", "double")).alias("confidence"),
        F.when(hit, F.col("kb_id")).otherwise(prior("matched_qa_id", "long")).alias("matched_qa_id"),
        F.when(hit, "kb_match").when(reused, "resolved_flagged").otherwise(prior("matched_source", "string")).alias("matched_source"),
        F.when(~hit & ~reused, F.col("similarity")).alias("similarity_score"),
        F.when(~hit & ~reused, F.col("kb_question")).alias("best_match_question"),
    )


def candidates(
    questions: DataFrame, kb: DataFrame, k: int = K.CANDIDATE_COUNT, cutoff: float = K.CANDIDATE_CUTOFF, embed=hashed_embedding
) -> DataFrame:
    """Up to ``k`` entries per question at or above the cutoff, best first."""
    found = top_by_wording(questions, kb, k, cutoff, embed, digests=True)
    entries = live(kb).select(
        F.col("id").alias("kb_id"), "category", F.col("question").alias("kb_question"), F.col("answer").alias("kb_answer")
    )
    return (
        questions.drop("embedding")
        .withColumn("wording", X.digest(F.col("question_text")))
        .join(found.join(entries, "kb_id"), "wording")
        .drop("wording")
        .withColumn("similarity", F.round("similarity", K.REPORT_DIGITS))
    )


def direct_decisions(routed: DataFrame) -> DataFrame:
    """Decisions of directly routed questions, in the shape and before those of a model."""
    score = F.round("confidence", 3)
    return routed.select(
        "doc_id", "question_index", F.lit(-1).alias("chunk_no"), F.col("question_index").cast("int").alias("at"),
        F.concat(F.lit("q_"), F.col("question_index").cast("string")).alias("id"), F.lit("answer").alias("action"), F.col("answer_text").alias("answer"),
        score.alias("confidence"), F.concat(F.lit("Direct KB match (similarity "), F.format_string("%.2f", "confidence"), F.lit(")")).alias("reason"),
        F.array().cast("array<string>").alias("issues"), F.col("question_text").alias("question"),
    )


def route(questions: DataFrame, found: DataFrame, threshold: float = K.DIRECT_ROUTE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(routed, remaining): a top candidate whose rounded similarity reaches
    the threshold answers directly, the rest is left for a model."""
    strong = found.filter((F.col("rank") == 1) & (F.col("similarity") >= threshold))
    routed = strong.select(
        "doc_id", "question_index", "question_text", F.col("kb_answer").alias("answer_text"),
        F.col("similarity").alias("confidence"), F.col("kb_id").alias("matched_qa_id"), F.lit("kb_direct").alias("matched_source"),
    )
    remaining = questions.join(strong.select("doc_id", "question_index"), ["doc_id", "question_index"], "left_anti")
    return routed, remaining


# --- repeats within a document ---------------------------------------------


def canonical_questions(items: DataFrame) -> DataFrame:
    """Add ``canonical_index``: the first position of the same wording in the document."""
    keyed = items.withColumn("_key", X.exact_key(F.col("question_text")))
    first = keyed.groupBy("doc_id", "_key").agg(F.min("question_index").alias("canonical_index"))
    return keyed.join(first, ["doc_id", "_key"]).drop("_key")


def propagate(items: DataFrame) -> DataFrame:
    """Copy the answer text of the canonical question to its repeats.

    Only the text moves, not its source or confidence.  Repeats are filled
    also when every canonical question was routed directly.
    """
    marked = canonical_questions(items) if "canonical_index" not in items.columns else items
    owners = marked.filter("question_index = canonical_index").select(
        "doc_id", "canonical_index", F.col("answer_text").alias("_answer")
    )
    return marked.join(owners, ["doc_id", "canonical_index"]).withColumn("answer_text", F.col("_answer")).drop("_answer")


# --- templates, flags, results ---------------------------------------------


def prefill(items: DataFrame, template_answers: DataFrame, template: int | DataFrame) -> DataFrame:
    """Answer open items whose key a template has; the later template row wins.

    ``template`` is one id for all items, or a table (doc_id, template_id) with
    one row per document; documents without a template stay as they are.
    """
    answers = template_answers.groupBy("template_id", X.question_key(F.col("question_text")).alias("_key")).agg(F.max_by("answer_text", "id").alias("_answer"))
    keyed = items.withColumn("_key", X.question_key(F.col("question_text")))
    if isinstance(template, DataFrame):
        keyed = lookup(keyed, template.select("doc_id", "template_id"), ["doc_id"])
    else:
        keyed = keyed.withColumn("template_id", F.lit(template))
    open_ = F.col("answer_text").isNull() & F.col("_answer").isNotNull()
    return (
        lookup(keyed, answers, ["template_id", "_key"])
        .withColumns(
            {
                "answer_text": F.when(open_, F.col("_answer")).otherwise(F.col("answer_text")),
                "matched_source": F.when(open_, "template").otherwise(F.col("matched_source")),
                "confidence": F.when(open_, K.TEMPLATE_CONFIDENCE).otherwise(F.col("confidence")),
            }
        )
        .select(*items.columns)
    )


def touch_templates(templates: DataFrame, used: DataFrame, now) -> DataFrame:
    """Templates after their use by the documents of (doc_id, template_id)."""
    times = used.groupBy(F.col("template_id").alias("id")).agg(F.count(F.lit(1)).alias("_times"))
    return templates.join(times, "id", "left").withColumns(
        {
            "times_used": F.coalesce("times_used", F.lit(0)) + F.coalesce("_times", F.lit(0)),
            "last_used_at": F.when(F.col("_times") > 0, timestamp(now)).otherwise(F.col("last_used_at")),
        }
    ).select(*templates.columns)


def rebuild_flags(items: DataFrame, prior_flags: DataFrame) -> DataFrame:
    """Flags of the unanswered items, with the score, context and best match of
    the highest-scoring earlier flag of the same key and document."""
    rank = F.struct(
        F.coalesce(F.nullif("similarity_score", F.lit(0.0)), F.lit(-1.0)).alias("score"), (-F.col("question_index")).alias("first")
    )
    prior = (
        prior_flags.withColumn("_key", X.question_key(F.col("extracted_question")))
        .groupBy("doc_id", "_key")
        .agg(F.max_by(F.struct("context", "similarity_score", "best_match_question"), rank).alias("_prior"))
    )
    open_ = items.filter(F.col("answer_text").isNull()).withColumn("_key", X.question_key(F.col("question_text")))
    return (
        lookup(open_, prior, ["doc_id", "_key"])
        .select(
            F.col("doc_id").alias("job_id"), "question_index", F.col("question_text").alias("extracted_question"),
            "_prior.context", "_prior.similarity_score", "_prior.best_match_question", F.lit(False).alias("resolved"),
        )
    )


def question_results(items: DataFrame, decisions: DataFrame | None = None, agent_mode: bool = False) -> DataFrame:
    """One result row per item.

    An unmatched row keeps the confidence of its extraction.  Decisions are
    (doc_id, id 'q_<index>', reason, issues).
    """
    source = (
        F.when(F.col("answer_text").isNull(), "unmatched")
        .when(F.coalesce(F.col("matched_source"), F.lit("")) != "", F.col("matched_source"))
        .otherwise("agent" if agent_mode else "kb_match")
    )
    rows = items.withColumn("_id", F.concat(F.lit("q_"), F.col("question_index").cast("string")))
    if decisions is not None:
        notes = decisions.select("doc_id", F.col("id").alias("_id"), F.col("reason").alias("agent_reason"), F.col("issues").alias("agent_issues"))
        rows = rows.join(notes, ["doc_id", "_id"], "left")
    else:
        rows = rows.withColumns(
            {"agent_reason": F.lit(None).cast("string"), "agent_issues": F.lit(None).cast("array<string>")}
        )
    return rows.select(
        F.col("doc_id").alias("job_id"), "question_index", "question_text", "answer_text",
        F.col("confidence").alias("confidence_score"), source.alias("source"), F.col("matched_qa_id").alias("kb_pair_id"),
        F.lit(False).alias("reviewed"), "agent_reason", "agent_issues",
    )


def finished_jobs(documents: DataFrame, items: DataFrame, parses: DataFrame, errors: DataFrame) -> DataFrame:
    """One job per document (doc_id) after filling, also without questions or unreadable.

    ``parses`` has (doc_id, confidence, fallback_recommended, fallback_reason,
    table_rows_scanned) of the profile that was used, in ``profile_name`` if there
    is one; ``errors`` are (doc_id, error).  A document without questions is done
    with zero of each; a document that could not be read is an error.
    """
    counts = job_rollup(items)
    named = "profile_name" if "profile_name" in parses.columns else F.lit(K.DEFAULT_PROFILE)
    parsed = parses.select(
        F.col("doc_id").alias("job_id"), (F.col(named) if isinstance(named, str) else named).alias("parser_profile_name"), F.col("confidence").alias("parse_confidence"),
        "fallback_recommended", "fallback_reason", "table_rows_scanned",
    )
    failed = errors.groupBy(F.col("doc_id").alias("job_id")).agg(F.min("error").alias("error_message"))
    none = F.lit(0).cast("long")
    broken = F.col("error_message").isNotNull()
    number = lambda name: F.when(~broken, F.coalesce(name, none)).alias(name)
    return (
        documents.select(F.col("doc_id").alias("job_id")).distinct().join(counts.drop("status", "review_status"), "job_id", "left").join(parsed, "job_id", "left").join(failed, "job_id", "left")
    ).select(
        "job_id", number("total_questions"), number("matched_questions"), number("flagged_questions_count"),
        F.when(broken, "error").otherwise("done").alias("status"), F.lit("pending").alias("review_status"), "error_message",
        F.when(~broken, F.coalesce("parser_profile_name", F.lit(K.DEFAULT_PROFILE))).alias("parser_profile_name"),
        F.when(~broken, F.coalesce("parse_confidence", F.lit(0.0))).alias("parse_confidence"),
        F.when(~broken, F.coalesce("fallback_recommended", F.lit(True))).alias("fallback_recommended"),
        F.when(~broken & F.coalesce("fallback_recommended", F.lit(True)), F.coalesce("fallback_reason", F.lit("no_questions_found"))).alias("fallback_reason"),
        F.when(~broken, F.coalesce("table_rows_scanned", none)).alias("table_rows_scanned"),
    )


def job_rollup(items: DataFrame) -> DataFrame:
    """Question counts per job that has questions, after filling."""
    answered = F.col("answer_text").isNotNull()
    return items.groupBy(F.col("doc_id").alias("job_id")).agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(answered).alias("matched_questions"),
        F.count_if(~answered).alias("flagged_questions_count"),
        F.lit("done").alias("status"),
        F.lit("pending").alias("review_status"),
    )
