"""Matching rows to knowledge-bank entries.

An entry scores through three signals: equal intent, a shared topic (or category), and shared
keywords. Entries without any signal can never win, so candidates come from equi-joins on the
signal values: no row is paired with every entry. The bank is written by hand and small; its
lookup tables are broadcast after its size was checked, and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgespark.functions.numeric import with_fixed, with_rounded
from judgespark.functions.text import ascii_json, keywords, normal_form, reasons, strip
from judgespark.operators.ordinal import dense_ordinal, tree_digest
from judgespark.operators.skew import skew_join
from judgespark.schema import (
    CATEGORY_WEIGHT,
    INTENT_WEIGHT,
    KB_ENTRY,
    KB_ID_PATTERN,
    KEYWORD_WEIGHT,
    MATCH_THRESHOLD,
    PRIORITY_LEVELS,
    TOPIC_WEIGHT,
)

# Broadcast limits: entries, and keyword postings (keyword, entry) of the whole bank.
MAX_BROADCAST_ENTRIES = 20_000
# A row can share words with all entries of a bank that small.
SMALL_BANK_ENTRIES = 1_000
MAX_BROADCAST_POSTINGS = 1_000_000

SIGNALS = ("intent", "row_topic", "row_category", "keyword_overlap")


# --- the bank itself --------------------------------------------------------------


def kb_issues(kb: DataFrame) -> DataFrame:
    """``(kb_id, issue)`` for every broken entry rule, duplicate ids included."""
    topics = F.transform("topic_list", lambda t: F.lower(strip(t)))

    def norm(name: str) -> Column:
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), normal_form)

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name) == "", F.lit(True))

    checks = {
        "invalid_id": ~F.coalesce(F.col("kb_id").rlike(KB_ID_PATTERN), F.lit(False)),
        "missing_pattern": blank("question_or_utterance_pattern"),
        "missing_intent": blank("intent"),
        "missing_example": blank("example_agent_response"),
        "missing_notes": blank("completeness_notes"),
        "no_topics": F.coalesce(F.size("topic_list"), F.lit(0)) == 0,
        "blank_topic": F.exists("topic_list", lambda t: strip(t) == ""),
        "duplicate_topic": F.size(F.array_distinct(topics)) < F.size(topics),
        "invalid_priority": F.col("priority_level").isNotNull() & ~F.col("priority_level").isin(*PRIORITY_LEVELS),
        "required_and_forbidden": F.arrays_overlap(norm("required_elements"), norm("forbidden_elements")),
        "required_and_optional": F.arrays_overlap(norm("required_elements"), norm("optional_elements")),
    }
    per_entry = kb.select("kb_id", F.explode(reasons(checks)).alias("issue"))
    repeated = kb.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_entry.unionByName(repeated.select("kb_id", F.lit("duplicate_id").alias("issue")))


def kb_entry(kb: DataFrame, kb_id: str) -> DataFrame:
    return kb.where(F.col("kb_id") == kb_id)


def _entry_texts(kb: DataFrame) -> DataFrame:
    """``(kb_id, text)``: each entry as one JSON object with sorted keys."""
    fields = sorted(f.name for f in KB_ENTRY.fields)
    lists = {f.name for f in KB_ENTRY.fields if f.dataType.typeName() == "array"}
    columns = [
        F.coalesce(F.col(f), F.array().cast("array<string>")).alias(f) if f in lists else F.col(f) for f in fields
    ]
    text = ascii_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return kb.select("kb_id", text.alias("text"))


def kb_fingerprint(kb: DataFrame, version: str) -> DataFrame:
    """``<version>:sha256:<12 hex>`` over the entries; independent of their order, for banks of any size.

    The entries' digests, in their own order, are the lines of a digest tree.
    """
    digests, n = _entry_texts(kb).select(F.sha2("text", 256).alias("digest")), kb.count()
    root = tree_digest(dense_ordinal(digests, ["digest"], "position", n), "position", "digest", rows=n)
    return root.select(
        F.concat(F.lit(f"{version}:sha256:"), F.substring("digest", 1, 12)).alias("kb_fingerprint")
    )


def small_kb_fingerprint(kb: DataFrame, version: str) -> DataFrame:
    """``<version>:sha256:<12 hex>`` over one JSON array of all entries by ``kb_id``.

    The array is gathered in one task, so a bank beyond the broadcast limit is refused; see
    :func:`kb_fingerprint` for those.
    """
    bank = _entry_texts(kb)
    require_small(bank)
    entries = F.array_sort(F.collect_list(F.struct("kb_id", "text")))
    blob = F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: e["text"]), ","), F.lit("]"))
    return bank.agg(
        F.concat(F.lit(f"{version}:sha256:"), F.substring(F.sha2(blob, 256), 1, 12)).alias("kb_fingerprint")
    )


def _fits(df: DataFrame, limit: int) -> bool:
    return df.limit(limit + 1).count() <= limit


def require_small(kb: DataFrame) -> None:
    """Raise unless the bank is small enough to gather in one task."""
    if not _fits(kb, MAX_BROADCAST_ENTRIES):
        raise ValueError(f"the knowledge bank has more than {MAX_BROADCAST_ENTRIES} entries")


# --- matching -----------------------------------------------------------------------


def _postings(kb: DataFrame) -> DataFrame:
    """``(signal, value, entry_index, pattern_size)``: every value an entry can be found by."""
    words = keywords(F.col("question_or_utterance_pattern"))
    entry = kb.select(
        "entry_index",
        F.array(normal_form(F.col("intent"))).alias("intent"),
        F.array_distinct(F.transform("topic_list", normal_form)).alias("topic"),
        words.alias("keyword"),
    )
    lists = F.array(
        *[F.struct(F.lit(s).alias("signal"), F.col(s).alias("values")) for s in ("intent", "topic", "keyword")]
    )
    return entry.select("entry_index", F.size("keyword").alias("pattern_size"), F.inline(lists)).select(
        "signal", F.explode("values").alias("value"), "entry_index", "pattern_size"
    )


def _row_values(rows: DataFrame, row_key: str) -> DataFrame:
    """``(row_key, signal, kind, value)``: the values a row can find entries by."""

    def one(name: str) -> Column:
        filled = F.coalesce(F.col(name) != "", F.lit(False)) if name in rows.columns else F.lit(False)
        none = F.array().cast("array<string>")
        return F.when(filled, F.array(normal_form(F.col(name)))).otherwise(none) if name in rows.columns else none

    words = keywords(F.col("user_input"))
    groups = F.array(
        F.struct(F.lit("intent").alias("signal"), F.lit("intent").alias("kind"), one("intent").alias("values")),
        F.struct(F.lit("topic").alias("signal"), F.lit("row_topic").alias("kind"), one("topic").alias("values")),
        F.struct(F.lit("topic").alias("signal"), F.lit("row_category").alias("kind"), one("category").alias("values")),
        F.struct(F.lit("keyword").alias("signal"), F.lit("keyword_overlap").alias("kind"), words.alias("values")),
    )
    return rows.select(row_key, F.inline(groups)).select(
        row_key, "signal", "kind", F.explode("values").alias("value")
    )


def _meet(values: DataFrame, postings: DataFrame, row_key: str, small: bool) -> DataFrame:
    """Rows and entries that share a value; frequent values of a large bank are spread over tasks."""
    keys = ["signal", "value"]
    return values.join(F.broadcast(postings), keys) if small else skew_join(values, postings, keys, F.col(row_key))


def _hits(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind).alias(f"_{kind}")


def _signals(grouped: DataFrame, row_key: str) -> DataFrame:
    """Signal scores from the hits per (row, entry) and the size of the entry's pattern."""
    # A pattern without keywords has size 0 and no overlap.
    share = F.least(F.try_divide(F.col("_keyword_overlap"), F.col("pattern_size")), F.lit(1.0)) * KEYWORD_WEIGHT
    topic = F.col("_row_topic") > 0
    shared = with_rounded(grouped.withColumn("_share", share), {"_overlap": ("_share", 4)})
    return shared.select(
        row_key,
        "entry_index",
        F.when(F.col("_intent") > 0, INTENT_WEIGHT).alias("intent"),
        F.when(topic, TOPIC_WEIGHT).alias("row_topic"),
        F.when(~topic & (F.col("_row_category") > 0), CATEGORY_WEIGHT).alias("row_category"),
        F.when(F.col("_keyword_overlap") > 0, F.col("_overlap")).alias("keyword_overlap"),
    )


def candidate_signals(
    rows: DataFrame,
    kb: DataFrame,
    row_key: str = "row_index",
    max_broadcast: int = MAX_BROADCAST_POSTINGS,
) -> DataFrame:
    """``(row_key, entry_index, intent, row_topic, row_category, keyword_overlap)`` per candidate.

    These are all pairs of a row and an entry that share anything, as many as frequent words make;
    matching needs only :func:`leading_signals`. Against a broadcast bank a row's values stay in one
    task, so the counts per (row, entry) are combined before the shuffle.
    """
    postings = _postings(kb)
    found = _meet(_row_values(rows, row_key), postings, row_key, _fits(postings, max_broadcast))
    grouped = found.groupBy(row_key, "entry_index").agg(
        F.max("pattern_size").alias("pattern_size"), *[_hits(k) for k in SIGNALS]
    )
    return _signals(grouped, row_key)


def leading_signals(
    rows: DataFrame,
    kb: DataFrame,
    row_key: str = "row_index",
    max_broadcast: int = MAX_BROADCAST_POSTINGS,
) -> DataFrame:
    """The candidates of :func:`candidate_signals` among which each row's best entry is.

    Keywords alone score less than any other signal. So rows meet entries by intent, topic and
    category first, keywords are counted only for those pairs, and only rows without such a pair
    look for entries by keyword, with the words that some entry has.
    """
    postings, values = _postings(kb), _row_values(rows, row_key)
    small = _fits(postings, max_broadcast)
    words = F.col("signal") == "keyword"
    strong = _meet(values.where(~words), postings.where(~words), row_key, small).groupBy(row_key, "entry_index").agg(
        F.max("pattern_size").alias("pattern_size"), *[_hits(k) for k in SIGNALS if k != "keyword_overlap"]
    )
    row_words = rows.select(row_key, keywords(F.col("user_input")).alias("_words"))
    patterns = kb.select("entry_index", keywords(F.col("question_or_utterance_pattern")).alias("_pattern"))
    with_words = strong.join(F.broadcast(patterns) if small else patterns, "entry_index").join(row_words, row_key)
    overlap = F.size(F.array_intersect("_words", "_pattern")).cast("long").alias("_keyword_overlap")
    with_words = with_words.select(*strong.columns, overlap)

    known = postings.where(words).select("value").distinct()
    weak = values.where(words).join(F.broadcast(known) if small else known, "value", "left_semi")
    weak = weak.join(strong.select(row_key).distinct(), row_key, "left_anti")
    by_word = _meet(weak, postings.where(words), row_key, small).groupBy(row_key, "entry_index").agg(
        F.max("pattern_size").alias("pattern_size"), *[_hits(k) for k in SIGNALS]
    )
    return _signals(with_words.unionByName(by_word), row_key)


def _score() -> Column:
    """Sum of the signals, added as decimals so that a sum on the threshold is exact."""
    parts = [F.coalesce(F.col(s).cast("decimal(6,4)"), F.lit(0).cast("decimal(6,4)")) for s in SIGNALS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(total, F.lit(1).cast("decimal(6,4)")).cast("double")


def best_candidates(candidates: DataFrame, row_key: str = "row_index") -> DataFrame:
    """The best entry per row; the first entry in bank order wins a tie."""
    scored = candidates.withColumn("score", _score())
    best = F.max_by(
        F.struct("entry_index", "score", *SIGNALS), F.struct(F.col("score"), -F.col("entry_index"))
    )
    return scored.where("score > 0").groupBy(row_key).agg(best.alias("_best")).select(row_key, "_best.*")


def match_reason() -> Column:
    """Signals by descending score, e.g. ``intent=0.70+keyword_overlap=0.10``.

    Needs ``_overlap_text``, the keyword signal with two decimals; the other signals are constants.
    """
    parts = F.array_sort(
        F.array_compact(
            F.array(
                *[
                    F.when(F.col(s).isNotNull(), F.struct((-F.col(s)).alias("rank"), F.lit(i).alias("i"), F.lit(s).alias("name")))
                    for i, s in enumerate(SIGNALS)
                ]
            )
        )
    )
    fixed_texts = {"intent": INTENT_WEIGHT, "row_topic": TOPIC_WEIGHT, "row_category": CATEGORY_WEIGHT}
    texts = [
        F.lit(f"{s}={fixed_texts[s]:.2f}") if s in fixed_texts else F.concat(F.lit(f"{s}="), F.col("_overlap_text"))
        for s in SIGNALS
    ]
    shown = F.map_from_arrays(F.array(*[F.lit(s) for s in SIGNALS]), F.array(*texts))
    return F.array_join(F.transform(parts, lambda p: shown[p["name"]]), "+")


def match_rows(
    rows: DataFrame,
    kb: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    row_key: str = "row_index",
    max_broadcast: int = MAX_BROADCAST_POSTINGS,
) -> DataFrame:
    """One row per input row: ``kb_id`` (NULL on a miss), confidence, reason and signals.

    The confidence is the best score, on a miss too.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must lie in [0, 1], got {threshold}")
    names = kb.select("entry_index", "kb_id")
    lookup = F.broadcast(names) if _fits(names, MAX_BROADCAST_ENTRIES) else names
    # All candidates in one pass over the rows, as long as a row cannot have too many.
    signals = candidate_signals if _fits(names, SMALL_BANK_ENTRIES) else leading_signals
    best = best_candidates(signals(rows, kb, row_key, max_broadcast), row_key).join(lookup, "entry_index", "left")
    joined = rows.select(row_key).join(best, row_key, "left")
    # An empty bank is a fact about the bank, not about a row.
    bank_empty = kb.agg((F.count(F.lit(1)) == 0).alias("e")).scalar()
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    shown = with_fixed(joined.withColumn("_bank_empty", bank_empty), {"_overlap_text": ("keyword_overlap", 2)})
    # Scores are sums of four-digit decimals, so the rounding of a hit to four digits is done.
    return shown.select(
        row_key,
        F.when(hit, F.col("entry_index")).alias("entry_index"),
        F.when(hit, F.col("kb_id")).alias("kb_id"),
        F.coalesce("score", F.lit(0.0)).alias("match_confidence"),
        F.when(F.col("_bank_empty"), "kb_empty")
        .when(F.col("score").isNull(), "no_candidate_scored")
        .when(~hit, "no_candidate_cleared_threshold")
        .otherwise(match_reason())
        .alias("match_reason"),
        *SIGNALS,
    )


def task_profiles(matches: DataFrame, kb: DataFrame, row_key: str = "row_index") -> DataFrame:
    """The guidance of the matched entry per hit row; rows without a hit have no profile."""
    guidance = kb.select(
        "kb_id",
        "required_elements",
        "optional_elements",
        "forbidden_elements",
        "completeness_notes",
        "policy_refs",
        "priority_level",
        "domain",
    )
    lookup = F.broadcast(guidance) if _fits(guidance, MAX_BROADCAST_ENTRIES) else guidance
    hits = matches.where(F.col("kb_id").isNotNull())
    return hits.select(row_key, "kb_id", "match_confidence", "match_reason", *SIGNALS).join(lookup, "kb_id")


def match_extras() -> Column:
    """Completeness mode and match facts of a matched row as a map."""
    hit = F.col("kb_id").isNotNull()
    base = F.create_map(
        F.lit("completeness_mode"),
        F.when(hit, "kb_informed").otherwise("generic_fallback"),
        F.lit("kb_match"),
        F.when(hit, "hit").otherwise("none"),
        F.lit("kb_match_confidence"),
        F.format_string("%.4f", F.col("match_confidence")),
    )
    detail = F.create_map(F.lit("kb_id"), F.col("kb_id"), F.lit("kb_match_reason"), F.col("match_reason"))
    return F.when(hit, F.map_concat(base, detail)).otherwise(base)
