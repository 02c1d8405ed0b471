"""Near-duplicate entries: clusters, reviews, classification."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions.responses import extract_json_object
from answerloom.functions.vectors import dot
from answerloom.operators.audit import audit_rows, timestamp
from answerloom.operators.components import connected_components
from answerloom.operators.matching import live
from answerloom.operators.pair_tiles import Tiles, pair_tiles
from answerloom.operators.ranking import page as _page, with_positions
from answerloom.operators.similarity import cluster_edges, pairs_between
from answerloom.operators.skew import hot_keys, lookup
from answerloom.session import durable

REVIEW_COLUMNS = [
    "id", "entry_a_id", "entry_b_id", "similarity_score", "classification", "contradicts", "reason",
    "recommended_keep_id", "status", "reviewed_action", "source", "created_at", "reviewed_at",
]


def clusters(kb: DataFrame, threshold: float = K.DEDUP_THRESHOLD, category: str | None = None) -> DataFrame:
    """(id, root) of live entries in a duplicate cluster; the root is the lowest id."""
    rows = live(kb)
    if category:
        rows = rows.filter(F.col("category") == category)
    return connected_components(cluster_edges(rows, threshold))


def cluster_report(
    kb: DataFrame, threshold: float = K.DEDUP_THRESHOLD, category: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(clusters, summary): the largest clusters with their canonical entry.

    Similarity is the mean over all pairs of members, also those under the
    threshold.  It follows from the sum of the member vectors, so no pair is
    formed: sum over pairs = (|sum of v|^2 - sum of |v|^2) / 2.
    """
    rows = live(kb, with_embedding=True)
    if category:
        rows = rows.filter(F.col("category") == category)
    grouped = durable(clusters(kb, threshold, category))
    members = grouped.join(rows.select("id", "embedding", "created_at", "updated_at"), "id")
    newest = F.struct(F.coalesce("updated_at", "created_at").alias("at"), (-F.col("id")).alias("first"))
    sums = members.groupBy("root").agg(
        F.count(F.lit(1)).alias("size"),
        Summarizer.sum(array_to_vector("embedding")).alias("total"),
        F.sum(dot(F.col("embedding"), F.col("embedding"))).alias("squares"),
        F.max_by("id", newest).alias("canonical_id"),
    )
    whole = vector_to_array("total")
    pairs = F.col("size") * (F.col("size") - 1)
    report = sums.select(
        "root", "canonical_id", "size",
        F.round((dot(whole, whole) - F.col("squares")) / pairs, K.REPORT_DIGITS).alias("similarity"),
    ).orderBy(F.col("size").desc(), "root").limit(K.CLUSTER_LIMIT)
    summary = grouped.agg(
        F.count(F.lit(1)).alias("total_duplicates"), F.count_distinct("root").alias("total_clusters")
    ).withColumn("total_entries_scanned", rows.agg(F.count(F.lit(1))).scalar())
    return report, summary


def cluster_members(grouped: DataFrame, report: DataFrame, kb: DataFrame) -> DataFrame:
    """Entries of the reported clusters."""
    kept = grouped.join(F.broadcast(report.select("root", "canonical_id")), "root")
    return kept.join(kb.drop("embedding"), "id")


def flag_new_duplicates(
    kb: DataFrame, new_ids: DataFrame, reviews: DataFrame, threshold: float = K.DEDUP_THRESHOLD, now: str | Column | None = None
) -> DataFrame:
    """Review rows for new entries close to other live ones.

    Pairs that already have a review are left out; new entries are not
    compared with each other.
    """
    rows = durable(live(kb).select("id", "embedding")).filter(F.col("embedding").isNotNull())
    fresh = rows.join(new_ids.select("id").distinct(), "id", "left_semi")
    known = rows.join(new_ids.select("id").distinct(), "id", "left_anti")
    reviewed = reviews.select(F.col("entry_a_id").alias("low"), F.col("entry_b_id").alias("high"))
    found = pairs_between(fresh, known, threshold, reviewed).select(
        F.least("a", "b").alias("entry_a_id"), F.greatest("a", "b").alias("entry_b_id"),
        F.round("similarity", K.REPORT_DIGITS).alias("similarity_score"),
    )
    return found.withColumns(
        {
            "status": F.lit("pending"), "source": F.lit("auto_flag"),
            "created_at": F.lit(None).cast("timestamp_ntz") if now is None else timestamp(now),
        }
    )


def _inside_clusters(
    kb: DataFrame, reviews: DataFrame, threshold: float, category: str | None, numbered: bool = False, entries: DataFrame | None = None,
    every_copy: bool = False,
) -> Tiles:
    """The pairs inside each cluster, with the reviews that are known."""
    rows = live(kb, with_embedding=True)
    grouped = durable(
        clusters(kb, threshold, category).join(rows.select("id", "question", "answer", "embedding"), "id")
    )
    if every_copy:
        marked = grouped.select("root", "id", F.col("id").alias("rep"), "embedding")
    else:
        lowest = grouped.groupBy("root", F.col("question").alias("_q"), F.col("answer").alias("_a")).agg(F.min("id").alias("rep"))
        alike = F.col("question").eqNullSafe(F.col("_q")) & F.col("answer").eqNullSafe(F.col("_a"))
        marked = durable(grouped.join(lowest.withColumnRenamed("root", "_r"), (F.col("root") == F.col("_r")) & alike).select("root", "id", "rep", "embedding"))
    known = reviews.groupBy("entry_a_id", "entry_b_id").agg(
        F.min("id").alias("review_id"), F.min_by("classification", F.when(F.col("classification").isNotNull(), F.col("id"))).alias("classification")
    )
    return pair_tiles(marked, known, numbered, entries)


def pairs_to_classify(
    kb: DataFrame, reviews: DataFrame, threshold: float = K.CLASSIFY_THRESHOLD, category: str | None = None, every_copy: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified, to_classify, new_reviews) over the pairs inside each cluster.

    Pairs are formed in tiles whenever they are read and are neither shuffled nor
    stored, so a big cluster spreads over many tasks.  With ``every_copy`` these are
    all pairs of members; without, entries with the same question and answer are
    paired among themselves only through the one with the lowest id, which stands
    for them in all other pairs.
    """
    tiles = _inside_clusters(kb, reviews, threshold, category, every_copy=every_copy)
    pair = ["entry_a_id", "entry_b_id", "root", "similarity", "review_id"]
    open_ = tiles.open().select(*pair)
    new_reviews = open_.filter(F.col("review_id").isNull()).select(
        "entry_a_id", "entry_b_id", F.col("similarity").alias("similarity_score"), F.lit("manual_scan").alias("source"), F.lit("pending").alias("status")
    )
    return tiles.classified().select(*pair, "classification"), open_, new_reviews


def batches_to_classify(
    kb: DataFrame, reviews: DataFrame, threshold: float = K.CLASSIFY_THRESHOLD, category: str | None = None,
    size: int = K.PAIRS_PER_REQUEST, entries: DataFrame | None = None, every_copy: bool = False,
) -> DataFrame:
    """(batch_no, pairs): the pairs to classify, numbered by their ids and cut into batches.

    The same pairs, batches and places as those of ``number_pairs``, but one row for
    each batch, so that requests and verdicts need no shuffle of pairs.  ``entries``
    (id, entries) adds the entries of both sides to each pair.
    """
    return _inside_clusters(kb, reviews, threshold, category, True, entries, every_copy).batches(size)


CLASSIFICATION = (
    "struct<pairs:array<struct<pair_index:int,classification:string,reason:string,"
    "recommended_keep_id:long,contradicts:boolean>>>"
)


def apply_classifications(pairs: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Pairs (batch_no, pair_index 0-9, ...) with the model's verdicts.

    Responses are (batch_no, content JSON text or null).  A batch without a
    readable response marks its pairs probably_same; unknown indexes are
    ignored and an index without an entry stays unclassified.  Without responses
    ``pairs`` are batches (batch_no, pairs, content), each with its response, and
    no pair is shuffled.
    """
    if responses is None:
        content = extract_json_object(F.col("content"))
        read = pairs.select("batch_no", "pairs", F.from_json(content, CLASSIFICATION).alias("body"), content.isNull().alias("_failed"))
        each = read.select("batch_no", F.explode("pairs").alias("p"), "body", "_failed")
        named = F.filter(F.col("body.pairs"), lambda v: v["pair_index"] == F.col("p.pair_index"))
        columns = ["batch_no", *pairs.schema["pairs"].dataType.elementType.names]
        joined = each.select("batch_no", "p.*", F.get(named, F.size(named) - 1).alias("v"), "_failed")
        return _with_verdicts(joined, columns)
    content = extract_json_object(F.col("content"))
    read = responses.select(
        "batch_no", F.from_json(content, CLASSIFICATION).alias("body"), content.isNull().alias("_failed")
    )
    verdicts = (
        read.filter(~F.col("_failed"))
        .select("batch_no", F.posexplode("body.pairs").alias("_at", "v"))
        .groupBy("batch_no", F.col("v.pair_index").alias("pair_index"))
        .agg(F.max_by("v", "_at").alias("v"))
    )
    joined = pairs.join(verdicts, ["batch_no", "pair_index"], "left").join(
        read.select("batch_no", "_failed"), "batch_no", "left"
    )
    return _with_verdicts(joined, pairs.columns)


def _with_verdicts(joined: DataFrame, columns: list[str]) -> DataFrame:
    failed = F.coalesce(F.col("_failed"), F.lit(True))
    given = F.col("v").isNotNull()
    return joined.select(
        *columns,
        F.when(failed, "probably_same").when(given, F.coalesce("v.classification", F.lit("probably_same"))).alias("classification"),
        F.when(failed, K.CLASSIFY_FAILED_REASON).when(given, F.coalesce("v.reason", F.lit(""))).alias("reason"),
        F.when(~failed, F.col("v.recommended_keep_id")).alias("recommended_keep_id"),
        F.when(failed, False).when(given, F.coalesce("v.contradicts", F.lit(False))).alias("contradicts"),
    )


def record_classifications(reviews: DataFrame, classified: DataFrame, now) -> DataFrame:
    """Reviews after the verdicts on open pairs (batch_no, pair_index, entry_a_id, entry_b_id, similarity, review_id, verdict columns).

    A pair without a review gets one, numbered after the highest id in the order
    of the batches, also where the model gave no verdict; a known review takes the
    verdict, if there is one.  Pairs that bring their ``fresh_no`` among the pairs
    without a review are neither sorted nor stored.
    """
    verdict = ["classification", "reason", "recommended_keep_id", "contradicts"]
    placed = "fresh_no" in classified.columns
    given = classified if placed else durable(classified)
    news = given.filter(F.col("review_id").isNotNull() & F.col("classification").isNotNull()).select(
        F.col("review_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in verdict], F.lit(True).alias("_hit")
    )
    known = reviews.join(news, "id", "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in verdict}).select(*REVIEW_COLUMNS)
    fresh = given.filter(F.col("review_id").isNull())
    if placed:
        fresh = fresh.withColumn("_position", F.col("fresh_no") + 1)
    else:
        fresh = with_positions(fresh.withColumn("_at", F.col("batch_no") * K.PAIRS_PER_REQUEST + F.col("pair_index")), [], "_at", "_position")
    top = reviews.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    none = lambda kind: F.lit(None).cast(kind)
    added = fresh.select(
        (top + F.col("_position")).alias("id"), "entry_a_id", "entry_b_id", F.col("similarity").alias("similarity_score"), *verdict,
        F.lit("pending").alias("status"), none("string").alias("reviewed_action"), F.lit("manual_scan").alias("source"),
        timestamp(now).alias("created_at"), none("timestamp_ntz").alias("reviewed_at"),
    )
    return known.unionByName(added.select(*REVIEW_COLUMNS))


def _live_reviews(reviews: DataFrame, kb: DataFrame) -> DataFrame:
    ids = live(kb).select("id")
    return reviews.join(ids.withColumnRenamed("id", "entry_a_id"), "entry_a_id", "left_semi").join(
        ids.withColumnRenamed("id", "entry_b_id"), "entry_b_id", "left_semi"
    )


def list_reviews(
    reviews: DataFrame, kb: DataFrame, status: str = "all", page: int = 1, size: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(one page newest first, counts) of reviews whose entries are both live."""
    active = _live_reviews(reviews, kb)
    wanted = active if status == "all" else active.filter(F.col("status") == status)
    counts = active.agg(
        F.count_if(F.lit(True) if status == "all" else F.col("status") == status).alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending_count"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed_count"),
    )
    return _page(wanted, [F.col("created_at").desc(), F.col("id").desc()], page, size), counts


def contradiction_count(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("contradicts") & (F.col("status") != "dismissed")).agg(F.count(F.lit(1)).alias("count"))


def recommended_actions(reviews: DataFrame) -> DataFrame:
    """(review_id, action) that accepts the model's advice on pending reviews."""
    judged = reviews.filter((F.col("status") == "pending") & F.col("classification").isNotNull())
    action = (
        F.when(F.col("classification") == "different", "keep_both")
        .when(F.col("recommended_keep_id") == F.col("entry_a_id"), "keep_left")
        .otherwise("keep_right")
    )
    return judged.select(F.col("id").alias("review_id"), action.alias("action"))


def _first_two(rows: DataFrame, key: str, tag: str, hot: list[int]) -> DataFrame:
    """Per key the two smallest ``seq`` and the smallest that is certain."""
    first = rows.groupBy(key).agg(F.min("seq").alias(f"lo_{tag}"), F.min(F.when(F.col("ok"), F.col("seq"))).alias(f"hi_{tag}"))
    later = lookup(rows, first, [key], "inner", hot=hot).filter(F.col("seq") > F.col(f"lo_{tag}")).groupBy(key).agg(F.min("seq").alias(f"next_{tag}"))
    return first.join(later, key, "left")


def _settle(state: DataFrame, hot: dict[str, list[int]]) -> DataFrame:
    """Actions whose earlier rivals decide them; one with a single open rival points at it."""
    open_ = state.filter(F.col("ok").isNull() | F.col("ok"))
    deleting = durable(_first_two(open_.filter(F.col("doomed").isNotNull()).select(F.col("doomed").alias("entry"), "seq", "ok"), "entry", "e", hot["doomed"]))
    turns = _first_two(open_.select("review_id", "seq", "ok"), "review_id", "r", hot["review_id"])
    looked = state
    for s in ("a", "b"):
        side = deleting.select(F.col("entry").alias(f"entry_{s}_id"), *[F.col(f"{n}_e").alias(f"{n}_{s}") for n in ("lo", "next", "hi")])
        looked = lookup(looked, side, [f"entry_{s}_id"], hot=hot[f"entry_{s}_id"])
    looked = lookup(looked, turns, ["review_id"], hot=hot["review_id"])
    every = lambda *names: F.array(*[F.col(f"{n}_{s}") for n in names for s in ("a", "b", "r")])
    earlier = lambda places: F.array_distinct(F.filter(places, lambda x: x < F.col("seq")))
    rivals = earlier(every("lo", "next"))
    verdict = F.when(F.col("ok").isNotNull(), F.col("ok")).when(F.size(earlier(every("hi"))) > 0, False).when(F.size(rivals) == 0, True)
    single = F.col("ptr").isNull() & (F.size(rivals) == 1)
    return looked.select(
        *[c for c in state.columns if c not in ("ok", "ptr", "flip")], verdict.alias("ok"),
        F.when(single, F.get(rivals, F.lit(0))).otherwise(F.col("ptr")).alias("ptr"), (F.col("flip") | single).alias("flip"),
    )


def _jump(state: DataFrame) -> DataFrame:
    """Actions that point at a settled one are settled, others point where their target points."""
    target = state.select(F.col("seq").alias("ptr"), F.col("ok").alias("_ok"), F.col("ptr").alias("_ptr"), F.col("flip").alias("_flip"))
    past = F.col("_ok").isNull() & F.col("_ptr").isNotNull()
    return durable(
        lookup(state, target, ["ptr"]).select(
            *[c for c in state.columns if c not in ("ok", "ptr", "flip")],
            F.coalesce("ok", F.when(F.col("_ok").isNotNull(), F.col("flip") != F.col("_ok"))).alias("ok"),
            F.when(past, F.col("_ptr")).otherwise(F.col("ptr")).alias("ptr"),
            F.when(past, F.col("flip") != F.col("_flip")).otherwise(F.col("flip")).alias("flip"),
        )
    )


def apply_review_actions(
    reviews: DataFrame, kb: DataFrame, actions: DataFrame, now
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(reviews, kb, summary, errors, audit) after (seq, review_id, action) in order.

    An action succeeds when its review is pending and both entries are live at
    its turn, that is, when no earlier successful action deleted one of them or
    closed the review.  Rounds settle every action whose earlier rivals are
    settled: per entry only the first certain and the first two possible deletions
    matter, so each round is a few minimum aggregations.  An action with one open
    rival succeeds exactly if that one fails; such chains are halved in every round
    by pointing each action past its rival, so a chain of n actions takes about
    log2(n) rounds.  ``merge`` keeps the recommended left entry, otherwise the
    right one.
    """
    alive = live(kb).select("id", F.lit(True).alias("_live"))
    base = (
        actions.join(reviews.select(F.col("id").alias("review_id"), "entry_a_id", "entry_b_id", "recommended_keep_id", "status"), "review_id", "left")
        .join(alive.withColumnRenamed("id", "entry_a_id").withColumnRenamed("_live", "_live_a"), "entry_a_id", "left")
        .join(alive.withColumnRenamed("id", "entry_b_id").withColumnRenamed("_live", "_live_b"), "entry_b_id", "left")
    )
    keeps_left = (F.col("action") == "keep_left") | (
        (F.col("action") == "merge") & F.coalesce(F.col("recommended_keep_id") == F.col("entry_a_id"), F.lit(False))
    )
    doomed = F.when(F.col("action") == "keep_both", None).when(keeps_left, F.col("entry_b_id")).otherwise(F.col("entry_a_id"))
    able = F.coalesce(F.col("status") == "pending", F.lit(False)) & F.coalesce("_live_a", F.lit(False)) & F.coalesce("_live_b", F.lit(False))
    start = base.withColumns({"doomed": doomed, "ok": F.when(~able, False), "ptr": F.lit(None).cast("long"), "flip": F.lit(False)})
    state = durable(start.withColumn("seq", F.col("seq").cast("long")))
    hot = {key: hot_keys(state, [key]) for key in ("entry_a_id", "entry_b_id", "review_id", "doomed")}
    while True:
        state = _jump(durable(_settle(state, hot)))
        if not state.filter(F.col("ok").isNull()).limit(1).count():
            break
    won = state.filter("ok")
    deleted = won.filter(F.col("doomed").isNotNull()).groupBy(F.col("doomed").alias("entry")).agg(F.min("seq").alias("gone"))
    kb_after = kb.join(deleted.select(F.col("entry").alias("id"), F.lit(True).alias("_hit")), "id", "left").withColumn(
        "deleted_at", F.when(F.col("_hit"), timestamp(now)).otherwise(F.col("deleted_at"))
    ).drop("_hit")
    label = F.when(F.col("action") == "merge", "merged").otherwise(F.col("action"))
    decided = won.select(
        F.col("review_id").alias("id"), F.when(F.col("action") == "keep_both", "dismissed").otherwise("reviewed").alias("_status"),
        label.alias("_action"),
    )
    gone = lambda s: deleted.select(F.col("entry").alias(f"entry_{s}_id"), F.lit(True).alias(f"_gone_{s}"))
    touched = reviews.join(decided, "id", "left").join(gone("a"), "entry_a_id", "left").join(gone("b"), "entry_b_id", "left")
    swept = F.col("_status").isNull() & (F.col("status") == "pending") & (F.col("_gone_a").isNotNull() | F.col("_gone_b").isNotNull())
    reviews_after = touched.withColumns(
        {
            "status": F.coalesce("_status", F.when(swept, "dismissed"), "status"),
            "reviewed_action": F.coalesce("_action", F.when(swept, "auto_dismissed"), "reviewed_action"),
            "reviewed_at": F.when(swept | F.col("_status").isNotNull(), timestamp(now)).otherwise(F.col("reviewed_at")),
        }
    ).select(*reviews.columns)
    # why an action failed: what its review looked like at its turn
    closed = won.select(F.col("review_id"), F.col("seq").alias("_closed"), F.when(F.col("action") == "keep_both", "dismissed").otherwise("reviewed").alias("_as"))
    first_gone = lambda s: deleted.select(F.col("entry").alias(f"entry_{s}_id"), F.col("gone").alias(f"_gone_{s}"))
    failed = (
        state.filter(~F.col("ok"))
        .join(closed, "review_id", "left")
        .join(first_gone("a"), "entry_a_id", "left")
        .join(first_gone("b"), "entry_b_id", "left")
    )
    earlier = lambda name: F.coalesce(F.col(name) < F.col("seq"), F.lit(False))
    status_then = (
        F.when(F.col("status") != "pending", F.col("status"))
        .when(earlier("_closed"), F.col("_as"))
        .when(earlier("_gone_a") | earlier("_gone_b"), "dismissed")
    )
    number = F.col("review_id").cast("string")
    message = (
        F.when(F.col("status").isNull(), F.concat(F.lit("Review "), number, F.lit(" not found")))
        .when(status_then.isNotNull(), F.concat(F.lit("Review "), number, F.lit(" already "), status_then))
        .otherwise(F.concat(F.lit("Review "), number, F.lit(": One or both entries have already been deleted")))
    )
    errors = failed.select("seq", "review_id", message.alias("error"))
    summary = state.agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))
    kept = F.when(F.col("doomed").isNotNull(), F.when(F.col("doomed") == F.col("entry_a_id"), F.col("entry_b_id")).otherwise(F.col("entry_a_id")))
    audit = audit_rows(
        won, now, "kb_duplicate_review", "duplicate_review", F.col("review_id"),
        details=F.to_json(F.struct("action", "entry_a_id", "entry_b_id", kept.alias("kept_id"), F.col("doomed").alias("deleted_id"))),
    )
    return reviews_after, kb_after, summary, errors, audit
