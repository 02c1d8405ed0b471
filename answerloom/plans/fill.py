"""Filling questionnaires end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions.vectors import hashed_embedding
from answerloom.operators import inference, matching
from answerloom.operators.ranking import with_positions
from answerloom.session import durable

ITEM_FIELDS = {
    "answer_text": "string", "confidence": "double", "matched_qa_id": "long", "matched_source": "string",
}


@dataclass
class Filled:
    """Tables a fill produces."""

    items: DataFrame
    flags: DataFrame
    results: DataFrame
    jobs: DataFrame
    #: Agent mode only: decisions, answers to verify with flags for context, and what the run changed.
    decisions: DataFrame | None = None
    to_verify: DataFrame | None = None
    verify_context: DataFrame | None = None
    stats: DataFrame | None = None


def number_items(items: DataFrame, order: str = "question_row_idx") -> DataFrame:
    """Extracted items with a 0-based ``question_index`` per document and open answers."""
    # extraction is the costly part and numbering reads it twice
    numbered = with_positions(durable(items), ["doc_id"], order).withColumn("question_index", F.col("position") - 1).drop("position")
    missing = {n: F.lit(None).cast(t) for n, t in ITEM_FIELDS.items() if n not in numbered.columns}
    return numbered.withColumns(missing)


def fill_pipeline(
    items: DataFrame, kb: DataFrame, flags: DataFrame, agent_mode: bool = False, responses: DataFrame | None = None,
    template_answers: DataFrame | None = None, template_id: int | None = None, threshold: float = K.MATCH_THRESHOLD,
    route_threshold: float = K.DIRECT_ROUTE_THRESHOLD, embed=hashed_embedding, corrections: DataFrame | None = None, templates: DataFrame | None = None,
) -> Filled:
    """Answers, flags, results and job counts of numbered items.

    Off mode matches every item against the knowledge base and earlier
    resolutions; a match replaces a template answer.  Agent mode answers only
    by direct routing and model decisions (doc_id, chunk_no, content JSON);
    what they leave open is flagged, there is no semantic fallback.  Corrections
    (doc_id, seq, id, action, ...) count for documents whose answers were to be
    verified.  ``templates`` names the template of each document (doc_id,
    template_id), ``template_id`` one for all.
    """
    template = template_id if templates is None else templates
    if template_answers is not None and template is not None:
        items = matching.prefill(items, template_answers, template)
    decisions, agent = None, {}
    if not agent_mode:
        # all four tables come from the match, so it is computed once
        matched = durable(matching.match_cascade(items, kb, flags, threshold, embed))
        scored = matched.filter(F.col("similarity_score").isNotNull()).select(
            "doc_id", "question_index", F.col("question_text").alias("extracted_question"), F.lit(None).cast("string").alias("context"),
            "similarity_score", "best_match_question",
        )
        filled = matched.drop("similarity_score", "best_match_question")
        new_flags = matching.rebuild_flags(filled, scored)
    else:
        filled, decisions, agent = _agent(items, kb, responses, corrections, route_threshold, embed)
        nothing = filled.limit(0).select(
            "doc_id", "question_index", F.col("question_text").alias("extracted_question"), F.lit(None).cast("string").alias("context"),
            F.lit(None).cast("double").alias("similarity_score"), F.lit(None).cast("string").alias("best_match_question"),
        )
        new_flags = matching.rebuild_flags(filled, nothing)
    notes = None
    if decisions is not None:
        notes = decisions.groupBy("doc_id", F.concat(F.lit("q_"), F.col("question_index").cast("string")).alias("id")).agg(
            F.max_by(F.struct("reason", "issues"), F.struct("chunk_no", "at")).alias("n")
        ).select("doc_id", "id", "n.reason", "n.issues")
    return Filled(filled, new_flags, matching.question_results(filled, notes, agent_mode), matching.job_rollup(filled), decisions, **agent)


def _agent(
    items: DataFrame, kb: DataFrame, responses: DataFrame | None, corrections: DataFrame | None, route_threshold: float, embed
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(items, decisions, further tables) of agent mode.

    Directly routed questions give decisions, too, before those of the model, and
    count for the mean that may skip verification.  A document whose questions
    were all routed needs no model, so nothing is verified there.
    """
    marked = durable(matching.canonical_questions(items))
    firsts = marked.filter("question_index = canonical_index")
    routed, remaining = matching.route(firsts, matching.candidates(firsts, kb, embed=embed), route_threshold)
    routed = durable(routed)
    direct = routed.select(
        "doc_id", "question_index", F.col("answer_text").alias("_a"), F.col("confidence").alias("_c"),
        F.col("matched_qa_id").alias("_q"), F.col("matched_source").alias("_s"),
    )
    filled = marked.join(direct, ["doc_id", "question_index"], "left").withColumns(
        {
            "answer_text": F.coalesce("_a", "answer_text"), "confidence": F.coalesce("_c", "confidence"),
            "matched_qa_id": F.coalesce("_q", "matched_qa_id"), "matched_source": F.coalesce("_s", "matched_source"),
        }
    ).drop("_a", "_c", "_q", "_s")
    decisions, failed = matching.direct_decisions(routed), None
    if responses is not None:
        own, failed = inference.normalize_decisions(responses, filled)
        filled = inference.apply_decisions(filled, own)
        decisions = decisions.unionByName(own)
    decisions = durable(decisions)
    asked = firsts.join(routed.select("doc_id", "question_index"), ["doc_id", "question_index"], "left_anti").select("doc_id").distinct()
    to_verify, context = inference.verification_set(decisions.join(asked, "doc_id", "left_semi"))
    to_verify = durable(to_verify)
    if corrections is not None:
        heard = corrections.join(to_verify.select("doc_id").distinct(), "doc_id", "left_semi")
        filled, decisions = inference.apply_corrections(filled, decisions, heard)
    filled = durable(matching.propagate(filled).drop("canonical_index"))
    stats = inference.outcome_stats(items, filled, failed)
    return filled, durable(decisions), {"to_verify": to_verify, "verify_context": context, "stats": stats}
