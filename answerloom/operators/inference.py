"""Tables before and after a model call; the call itself is someone else's job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions import text as X
from answerloom.functions.responses import extract_json_object
from answerloom.operators.ranking import first_per_group, running_total, with_positions
from answerloom.session import durable


def fill_requests(
    remaining: DataFrame, found: DataFrame, context: DataFrame | None = None, routed: DataFrame | None = None,
    instructions: str = "", size: int = K.QUESTIONS_PER_REQUEST, prior_limit: int = K.PRIOR_ANSWERS,
) -> DataFrame:
    """(doc_id, chunk_no, n_questions, payload JSON): open questions in chunks.

    Each question carries its candidates; a request also has the document
    context and the last directly routed answers.
    """
    options = (
        found.groupBy("doc_id", "question_index")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("kb_id").alias("id"), "category", F.col("kb_question").alias("question"), F.col("kb_answer").alias("answer"), "similarity"))).alias("_c"))
        .select("doc_id", "question_index", F.transform("_c", lambda c: c.dropFields("rank")).alias("kb_candidates"))
    )
    numbered = with_positions(remaining, ["doc_id"], "question_index").withColumn(
        "chunk_no", F.ceil(F.col("position") / size).cast("long")
    )
    current = F.col("answer_text") if "answer_text" in remaining.columns else F.lit(None).cast("string")
    question = F.struct(
        "question_index", F.concat(F.lit("q_"), F.col("question_index").cast("string")).alias("id"),
        F.col("question_text").alias("question"), current.alias("current_answer"), "kb_candidates",
    )
    chunks = (
        numbered.join(options, ["doc_id", "question_index"], "left")
        .withColumn("kb_candidates", F.coalesce("kb_candidates", F.array()))
        .groupBy("doc_id", "chunk_no")
        .agg(F.sort_array(F.collect_list(question)).alias("_q"))
        .withColumn("questions", F.transform("_q", lambda q: q.dropFields("question_index")))
    )
    if context is not None:
        chunks = chunks.join(context.select("doc_id", F.col("context").alias("document_context")), "doc_id", "left")
    else:
        chunks = chunks.withColumn("document_context", F.lit(""))
    if routed is not None:
        last = first_per_group(routed, ["doc_id"], [F.col("question_index").desc()], prior_limit)
        prior = last.groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("question_index", F.col("question_text").alias("question"), F.col("answer_text").alias("answer")))).alias("_p")
        ).select("doc_id", F.transform("_p", lambda p: p.dropFields("question_index")).alias("prior_answers"))
        chunks = chunks.join(prior, "doc_id", "left")
    else:
        chunks = chunks.withColumn("prior_answers", F.lit(None).cast("array<struct<question:string,answer:string>>"))
    payload = F.to_json(
        F.struct(F.coalesce("document_context", F.lit("")).alias("document_context"), F.lit(instructions).alias("instructions"), "questions", "prior_answers")
    )
    return chunks.select("doc_id", "chunk_no", F.size("questions").alias("n_questions"), payload.alias("payload"))


def number_pairs(pairs: DataFrame, size: int = K.PAIRS_PER_REQUEST) -> DataFrame:
    """Pairs with batch_no and pair_index (0-based within the batch), ordered by ids.

    Pairs are numbered by first entry: counts per first entry are summed up over
    ranges, and a pair's place among its first entry's pairs is added.
    """
    inner = with_positions(pairs, ["entry_a_id"], "entry_b_id", "_inner")
    sizes = pairs.groupBy("entry_a_id").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_total(sizes, "entry_a_id", F.col("_n"), "_before").drop("_n")
    at = F.col("_before") + F.col("_inner") - 1
    return inner.join(offsets, "entry_a_id").select(
        *pairs.columns, F.floor(at / size).cast("long").alias("batch_no"), (at % size).cast("int").alias("pair_index")
    )


def request_entries(kb: DataFrame) -> DataFrame:
    """(id, entries): what a request tells of an entry; an id that repeats has several."""
    entry = F.struct("id", "question", F.substring("answer", 1, K.CLASSIFY_ANSWER_CHARS).alias("answer"))
    return kb.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def classify_requests(pairs: DataFrame, kb: DataFrame | None = None, size: int = K.PAIRS_PER_REQUEST) -> DataFrame:
    """(batch_no, n_pairs, payload JSON): pairs (entry_a_id, entry_b_id, similarity) in tens.

    Without ``kb`` pairs are batches (batch_no, pairs) that bring the entries of both
    sides, as ``batches_to_classify`` makes them, and no pair is shuffled.
    """
    if kb is None:
        both = lambda p: F.transform(p["entries_a"], lambda a: F.transform(p["entries_b"], lambda b: F.struct(
            p["pair_index"].alias("pair_index"), p["similarity"].alias("similarity"), a.alias("entry_a"), b.alias("entry_b")
        )))
        told = F.filter("pairs", lambda p: p["entries_a"].isNotNull() & p["entries_b"].isNotNull())
        grouped = pairs.select("batch_no", F.sort_array(F.flatten(F.flatten(F.transform(told, both)))).alias("pairs")).filter(F.size("pairs") > 0)
    else:
        entry = lambda s: kb.select(
            F.col("id").alias(f"entry_{s}_id"),
            F.struct("id", "question", F.substring("answer", 1, K.CLASSIFY_ANSWER_CHARS).alias("answer")).alias(f"entry_{s}"),
        )
        numbered = number_pairs(pairs.select("entry_a_id", "entry_b_id", "similarity"), size)
        full = numbered.join(entry("a"), "entry_a_id").join(entry("b"), "entry_b_id")
        grouped = full.groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("pair_index", "similarity", "entry_a", "entry_b"))).alias("pairs"))
    return grouped.select("batch_no", F.size("pairs").alias("n_pairs"), F.to_json(F.struct("pairs")).alias("payload"))


DECISIONS = "struct<decisions:array<string>>"
DECISION = "struct<id:string,action:string,answer:string,confidence:string,reason:string,issues:string>"


def _decision_index(decision_id: Column) -> Column:
    """Index in an id "q_<number>", or null."""
    return F.regexp_extract(decision_id, r"\Aq_\s*([+-]?\d+)\s*\z", 1).try_cast("int")


def normalize_decisions(responses: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, failed chunks per document) from (doc_id, chunk_no, content JSON).

    An unknown action or an empty answer becomes a flag; ids must name an item
    of the document; confidence is clamped; issues must be an array.  Items are
    (doc_id, question_index, question_text).

    Every response is parsed once: the shaped decisions are stored, and a response
    without decisions leaves one row of nulls, which counts as failed.
    """
    parsed = responses.select("doc_id", "chunk_no", F.from_json(extract_json_object(F.col("content")), DECISIONS)["decisions"].alias("_d"))
    # the inner explode would parse each response again in a filter on the array's size
    rows = parsed.select("doc_id", "chunk_no", F.posexplode_outer("_d").alias("at", "_raw"))
    # one parse; nested values come as their JSON text, other elements as nulls
    fields = rows.select("doc_id", "chunk_no", "at", F.from_json("_raw", DECISION).alias("f")).select("doc_id", "chunk_no", "at", "f.*")
    wanted = F.lower(X.strip(F.coalesce("action", F.lit("flag"))))
    answer = X.strip(F.coalesce("answer", F.lit("")))
    acts = F.when((wanted == "answer") & (answer != ""), "answer").otherwise("flag")
    shaped = durable(fields.select(
        "doc_id", "chunk_no", "at", "id", _decision_index(F.col("id")).alias("question_index"),
        acts.alias("action"), F.when(acts == "answer", answer).alias("answer"), X.coerce_confidence(F.col("confidence")).alias("confidence"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce(F.from_json("issues", "array<string>"), F.array().cast("array<string>")).alias("issues"),
    ))
    failed = shaped.groupBy("doc_id").agg(F.count_if(F.col("at").isNull()).alias("failed_chunks"))
    decisions = shaped.join(items.select("doc_id", "question_index", F.col("question_text").alias("question")), ["doc_id", "question_index"])
    return decisions, failed


def verification_set(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers to verify, flagged for context) per document.

    Nothing is verified when more than three answers have a high mean
    confidence; beyond forty answers those of lowest confidence are taken.
    """
    answered = decisions.filter(F.col("action") == "answer")
    means = answered.filter(F.col("confidence").isNotNull()).groupBy("doc_id").agg(
        F.avg("confidence").alias("mean"), F.count(F.lit(1)).alias("n")
    )
    skip = means.filter((F.col("mean") >= K.SKIP_VERIFY_THRESHOLD) & (F.col("n") > K.SKIP_VERIFY_MIN_ANSWERS)).select("doc_id")
    pool = answered.join(skip, "doc_id", "left_anti").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    chosen = first_per_group(pool, ["doc_id"], [F.col("confidence"), F.col("chunk_no"), F.col("at")], K.VERIFY_MAX_ANSWERS)
    flagged = decisions.filter(F.col("action") == "flag").join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    context = first_per_group(flagged, ["doc_id"], [F.col("chunk_no"), F.col("at")], K.VERIFY_MAX_FLAGGED)
    return chosen, context


def apply_corrections(items: DataFrame, decisions: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, decisions) after (doc_id, seq, id, action, revised_answer, revised_confidence, reason).

    The last usable correction of an item decides its text.  A decision changes by
    corrections of exactly its id; of several decisions with one id only the first
    does.  The notes of all its corrections are appended to it in order.
    """
    action = F.lower(X.strip(F.coalesce("action", F.lit(""))))
    revised = X.strip(F.coalesce("revised_answer", F.lit("")))
    usable = corrections.select(
        "doc_id", "seq", _decision_index(F.col("id")).alias("question_index"), "id", action.alias("what"), revised.alias("revised"),
        X.coerce_confidence(F.col("revised_confidence")).alias("new_confidence"), F.coalesce("reason", F.lit("")).alias("why"),
        F.col("revised_confidence").isNotNull().alias("scored"),
    ).filter(F.col("question_index").isNotNull() & (((F.col("what") == "revise") & (F.col("revised") != "")) | (F.col("what") == "flag")))
    is_flag = F.col("what") == "flag"
    note = F.concat(
        F.when(is_flag, F.lit("[Flagged by verification: ")).otherwise(F.lit("[Revised by verification: ")), F.col("why"), F.lit("]")
    )
    text = F.max_by(F.when(~is_flag, F.col("revised")), "seq").alias("_text")
    by_item = usable.groupBy("doc_id", "question_index").agg(text, F.lit(True).alias("_hit"))
    by_id = usable.groupBy("doc_id", "id").agg(
        text, F.lit(True).alias("_hit"),
        F.max_by("new_confidence", F.when(F.col("scored") & ~is_flag, F.col("seq"))).alias("_confidence"),
        F.bool_or(F.col("scored") & ~is_flag).alias("_scored"), F.bool_or(is_flag).alias("_flagged"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", note.alias("note")))), lambda n: n["note"]), " ").alias("_notes"),
    )
    place = F.min(F.struct("chunk_no", "at")).alias("_first")
    firsts = decisions.groupBy("doc_id", "id").agg(place).select("doc_id", "id", "_first.*")
    noted = by_id.join(firsts, ["doc_id", "id"])
    hit = F.col("_hit").isNotNull()
    new_items = items.join(by_item, ["doc_id", "question_index"], "left").withColumn(
        "answer_text", F.when(hit, F.col("_text")).otherwise(F.col("answer_text"))
    ).select(*items.columns)
    new_decisions = decisions.join(noted, ["doc_id", "id", "chunk_no", "at"], "left").withColumns(
        {
            "answer": F.when(hit, F.col("_text")).otherwise(F.col("answer")),
            "action": F.when(hit & F.col("_flagged"), "flag").otherwise(F.col("action")),
            "confidence": F.when(hit & F.col("_scored"), F.col("_confidence")).otherwise(F.col("confidence")),
            "reason": F.when(hit, X.strip(F.concat_ws(" ", "reason", "_notes"))).otherwise(F.col("reason")),
        }
    ).select(*decisions.columns)
    return new_items, new_decisions


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Item answers after the decisions; a flag clears the answer, the last decision counts."""
    last = decisions.groupBy("doc_id", "question_index").agg(
        F.max_by("answer", F.struct("chunk_no", "at")).alias("_answer"), F.lit(True).alias("_hit")
    )
    return items.join(last, ["doc_id", "question_index"], "left").withColumn(
        "answer_text", F.when(F.col("_hit"), F.col("_answer")).otherwise(F.col("answer_text"))
    ).select(*items.columns)


def outcome_stats(before: DataFrame, after: DataFrame, failed: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Per document: what the run changed, chunks failed and tokens used.

    ``before`` and ``after`` are (doc_id, question_index, question_text,
    answer_text[, matched_source]); calls are (doc_id, request, response) texts.
    """
    joined = before.select("doc_id", "question_index", F.col("answer_text").alias("b")).join(
        after.select(
            "doc_id", "question_index", F.col("answer_text").alias("a"), X.exact_key(F.col("question_text")).alias("key"),
            (F.col("matched_source") if "matched_source" in after.columns else F.lit(None).cast("string")).alias("s"),
        ),
        ["doc_id", "question_index"],
    )
    had, has = F.col("b").isNotNull(), F.col("a").isNotNull()
    # distinct wordings in two steps, so one big document spreads by wording
    keyed = joined.groupBy("doc_id", "key").agg(
        F.count_if(~had & has).alias("generated"), F.count_if(had & ~has).alias("flags"),
        F.count_if(had & has & (X.strip(F.col("b")) != X.strip(F.col("a")))).alias("overrides"),
        F.count_if(~has).alias("unresolved"), F.max(F.when(F.col("s") == "kb_direct", 1).otherwise(0)).alias("routed"),
    )
    stats = keyed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("questions_considered"), F.sum("generated").alias("answers_generated"),
        F.sum("unresolved").alias("unresolved_questions"), F.sum("flags").alias("flags_recommended"),
        F.sum("overrides").alias("overrides"), F.sum("routed").alias("kb_routed"),
    )
    if failed is not None:
        stats = stats.join(failed.select("doc_id", "failed_chunks"), "doc_id", "left")
    else:
        stats = stats.withColumn("failed_chunks", F.lit(0))
    if calls is not None:
        used = calls.groupBy("doc_id").agg(
            F.sum(X.estimate_tokens(F.col("request"))).alias("input_tokens"),
            F.sum(F.when(F.col("response").isNotNull(), X.estimate_tokens(F.col("response"))).otherwise(0)).alias("output_tokens"),
            F.count(F.lit(1)).alias("llm_calls"),
        )
        stats = stats.join(used, "doc_id", "left")
    chunks = F.coalesce("failed_chunks", F.lit(0))
    return stats.withColumn("failed_chunks", chunks).withColumn(
        "status", F.when(chunks == 0, "completed").otherwise("completed_with_warnings")
    )
