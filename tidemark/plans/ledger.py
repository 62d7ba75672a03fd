"""Queries over the ledger of changes, the runs that bind them and the registry's rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import health, history, ledger, registry
from tidemark.plans.ordered import positions
from tidemark.plans.reference import _DEDUP, _HOLD, _STREAK, _attempts, _held, _streaked
from tidemark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
# The closed vocabularies of the ledger.
VOCABULARY = {
    "kind": ["content_drift", "possibly_removed"],
    "significance": ["unclassified", "editorial", "substantive"],
    "review_status": ["unreviewed", "confirmed", "dismissed"],
    "publication_status": ["active", "corrected", "withdrawn"],
}
CONTRACTS = ["text-v2/none-v1"]  # contracts taken to be registered


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- changes and their decisions ---------------------------------------------

_EVENTS = """WITH o AS (SELECT DISTINCT change_id, kind FROM changes), f AS (SELECT DISTINCT change_id, significance, reviewer, reviewed_at FROM changes WHERE reviewed_at IS NOT NULL),
i AS (SELECT DISTINCT change_id, independent_review_status, independent_reviewer, independent_reviewed_at FROM changes WHERE independent_reviewed_at IS NOT NULL),
l AS (SELECT DISTINCT change_id, publication_status, superseded_by, lifecycle_at FROM changes WHERE lifecycle_at IS NOT NULL)
"""


@query(_EVENTS + """SELECT o.change_id, kind, coalesce(significance, 'unclassified') AS significance, reviewer, coalesce(independent_review_status, 'none') AS second_status, independent_reviewer AS second_reviewer,
coalesce(publication_status, 'active') AS publication_status, superseded_by FROM o LEFT JOIN f USING (change_id) LEFT JOIN i USING (change_id) LEFT JOIN l USING (change_id)""")
def change_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of every change from its events: observation, first and second decision, lifecycle."""
    c = table(spark, d, "changes", "change_id", "kind", "significance", "reviewer", "reviewed_at", "independent_review_status", "independent_reviewer", "independent_reviewed_at", "publication_status", "superseded_by", "lifecycle_at")
    return ledger.change_state(*ledger.events(c))


@query("""SELECT stage, count(*) AS n_decisions, count(DISTINCT change_id) AS n_changes, count(*) - count(DISTINCT change_id) AS n_repeated, count(*) FILTER (actor IS NULL OR trim(actor) = '') AS n_unsigned FROM (
SELECT DISTINCT 'first' AS stage, change_id, reviewer AS actor, reviewed_at AS ts FROM changes WHERE reviewed_at IS NOT NULL UNION ALL SELECT DISTINCT 'second', change_id, independent_reviewer, independent_reviewed_at FROM changes WHERE independent_reviewed_at IS NOT NULL
UNION ALL SELECT DISTINCT 'lifecycle', change_id, lifecycle_actor, lifecycle_at FROM changes WHERE lifecycle_at IS NOT NULL) GROUP BY 1""")
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by stage, and those that repeat their change's or name no one."""
    c = table(spark, d, "changes", "change_id", "reviewer", "reviewed_at", "independent_reviewer", "independent_reviewed_at", "lifecycle_actor", "lifecycle_at")
    return ledger.decision_counts(c)


@query(_HOLD + """, v AS (SELECT source_id, max(verification.status) AS status FROM h GROUP BY 1) SELECT DISTINCT c.change_id, coalesce(v.status, 'withdrawn') AS verification FROM changes c LEFT JOIN v ON v.source_id = c.source_id""")
def change_verification(spark: SparkSession, d: str) -> DataFrame:
    """Each change with its source's verification; sources no longer held are 'withdrawn'."""
    status = _held(spark, d, "source_id", "verification").groupBy("source_id").agg(F.max("verification.status").alias("status"))
    c = table(spark, d, "changes", "change_id", "source_id").distinct()
    return c.join(status, "source_id", "left").select("change_id", F.coalesce("status", F.lit("withdrawn")).alias("verification")).distinct()


@query("""WITH c AS (SELECT DISTINCT change_id, source_id, jurisdiction, document_class, url, superseded_by, observed_at, coalesce(independent_reviewed_at, reviewed_at) AS ready_at FROM changes)
SELECT o.change_id, o.superseded_by, r.change_id IS NOT NULL AS present, coalesce(o.source_id IS NOT DISTINCT FROM r.source_id AND o.jurisdiction IS NOT DISTINCT FROM r.jurisdiction AND o.document_class IS NOT DISTINCT FROM r.document_class AND o.url IS NOT DISTINCT FROM r.url AND r.change_id IS NOT NULL, false) AS same_subject,
coalesce(r.observed_at >= o.ready_at, false) AS in_time FROM c o LEFT JOIN c r ON r.change_id = o.superseded_by WHERE coalesce(o.superseded_by, '') <> ''""")
def replacement_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each correction against what replaces it: present, about the same page, and not before the correction was due."""
    return ledger.replacement_checks(table(spark, d, "changes", "change_id", "source_id", "jurisdiction", "document_class", "url", "superseded_by", "observed_at", "reviewed_at", "independent_reviewed_at"))


@query("".join(["SELECT * FROM (", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, coalesce({c} IN ({', '.join(repr(v) for v in vs)}), false) AS known FROM (SELECT DISTINCT change_id, {c} FROM changes) GROUP BY {c}" for c, vs in VOCABULARY.items()), ")"]))
def vocabulary_counts(spark: SparkSession, d: str) -> DataFrame:
    """Values of the closed columns with their number and whether the vocabulary has them."""
    return ledger.vocabulary_counts(table(spark, d, "changes", "change_id", *VOCABULARY).distinct(), VOCABULARY, "change_id")


@query(r"""SELECT DISTINCT change_id, CASE WHEN coalesce(diff_excerpt, '') = '' THEN 'empty' WHEN regexp_matches(diff_excerpt, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]') THEN 'control' WHEN octet_length(encode(diff_excerpt)) > 16000 THEN 'long' ELSE 'safe' END AS verdict FROM changes""")
def excerpt_safety(spark: SparkSession, d: str) -> DataFrame:
    """Whether a diff may be published: no control or format characters but line ends and tabs, at most 16,000 bytes."""
    return table(spark, d, "changes", "change_id", "diff_excerpt").select("change_id", T.public_text_verdict(F.col("diff_excerpt")).alias("verdict")).distinct()


@query("SELECT change_id, row_number() OVER (ORDER BY observed_at DESC, change_id) AS place FROM (SELECT change_id, min(observed_at) AS observed_at FROM changes GROUP BY 1)")
def change_list(spark: SparkSession, d: str) -> DataFrame:
    """Changes from the newest observation on; ties by id, rising."""
    c = table(spark, d, "changes", "change_id", "observed_at").groupBy("change_id").agg(F.min("observed_at").alias("observed_at"))
    return positions(c, [F.col("observed_at").desc(), F.col("change_id").asc()], "place").select("change_id", "place")


@query(_EVENTS + "SELECT change_id FROM o LEFT JOIN f USING (change_id) WHERE f.change_id IS NULL AND change_id IN (SELECT change_id FROM changes WHERE jurisdiction = 'US')")
def undecided_changes(spark: SparkSession, d: str) -> DataFrame:
    """Federal changes without a first decision: the place is filtered at the scan, the state after the projection."""
    c = table(spark, d, "changes", "change_id", "jurisdiction", "reviewed_at").filter(F.col("jurisdiction") == "US")
    return c.groupBy("change_id").agg(F.max("reviewed_at").alias("at")).filter(F.col("at").isNull()).select("change_id")


# --- runs --------------------------------------------------------------------


@query(f"""WITH {_DEDUP}, c AS (SELECT DISTINCT change_id, source_id, observed_at FROM changes WHERE source_id IS NOT NULL), j AS (SELECT c.*, a.run_id FROM c ASOF JOIN a ON a.source_id = c.source_id AND a.att < c.observed_at)
SELECT run_id, count(*) AS n_observations FROM j GROUP BY 1""")
def observations_per_run(spark: SparkSession, d: str) -> DataFrame:
    """Changes by the run whose attempt of the source was the last before they were observed."""
    a = _attempts(spark, d).select("run_id", "source_id", "at")
    c = table(spark, d, "changes", "change_id", "source_id", "observed_at").filter(F.col("source_id").isNotNull()).distinct()
    bound = history.as_of(c, a, "source_id", "observed_at", "at", ["at", "run_id"], ["run_id"], F.to_date("__tm_at"))
    return bound.filter(F.col("found").isNotNull()).groupBy(F.col("found.run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n_observations"))


@query(f"WITH {_DEDUP} SELECT run_id, string_agg(source_id, ',' ORDER BY source_id) AS attempted, string_agg(source_id, ',' ORDER BY source_id) FILTER (ok) AS successful, string_agg(source_id, ',' ORDER BY source_id) FILTER (ok AND extraction_outcome = 'no-text') AS unmeasured, string_agg(source_id, ',' ORDER BY source_id) FILTER (ok AND extraction_outcome IS DISTINCT FROM 'no-text') AS observed FROM a WHERE source_id IS NOT NULL GROUP BY 1")
def run_source_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sets of sources of each run, in order; a set is at most the registry."""
    return ledger.run_source_sets(_attempts(spark, d))


@query("""SELECT r.run_id, count(a.run_id) AS n_attempts, count(*) FILTER (a.attempted_at < r.started_at) AS n_early, count(*) FILTER (a.attempted_at > r.completed_at) AS n_late, count(*) FILTER (a.run_id IS NOT NULL AND r.completed_at IS NULL) AS n_running
FROM watch_runs r LEFT JOIN (SELECT DISTINCT run_id, source_id, attempted_at FROM fetch_attempts) a ON a.run_id = r.run_id GROUP BY 1""")
def attempts_in_runs(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of each run, and those before its start, after its end or while it runs still."""
    r = table(spark, d, "watch_runs", "run_id", "started_at", "completed_at")
    a = table(spark, d, "fetch_attempts", "run_id", "source_id", "attempted_at").distinct()
    return ledger.attempts_in_runs(r, a)


@query("SELECT run_id, source_id, count(*) AS n FROM fetch_attempts GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Sources that stand in one run more than once."""
    return registry.duplicates(table(spark, d, "fetch_attempts", "run_id", "source_id"), ["run_id", "source_id"])


@query(f"""WITH {_DEDUP}, g AS (SELECT run_id, count(*) AS attempted, count(*) FILTER (ok) AS successful, count(*) FILTER (ok AND extraction_outcome = 'no-text') AS unmeasured FROM a GROUP BY 1),
j AS (SELECT w.*, coalesce(attempted, 0) AS a, coalesce(successful, 0) AS s, coalesce(unmeasured, 0) AS u FROM (SELECT DISTINCT run_id, state, attempted_count, successful_count, unmeasured_count FROM watch_runs) w LEFT JOIN g ON g.run_id = w.run_id)
SELECT state, count(*) AS n_runs, count(*) FILTER (attempted_count = a) AS attempted_same, count(*) FILTER (successful_count = s) AS successful_same, count(*) FILTER (unmeasured_count = u) AS unmeasured_same FROM j GROUP BY 1""")
def receipt_agreement(spark: SparkSession, d: str) -> DataFrame:
    """By state, the runs whose counters are those of their attempts."""
    w = table(spark, d, "watch_runs", "run_id", "state", "attempted_count", "successful_count", "unmeasured_count").distinct()
    return ledger.receipt_agreement(w, _attempts(spark, d))


_WORDS = "CASE WHEN silence_seconds >= 172800 THEN concat(silence_seconds // 86400, ' days') WHEN silence_seconds >= 86400 THEN '1 day' WHEN silence_seconds >= 7200 THEN concat(silence_seconds // 3600, ' hours') WHEN silence_seconds >= 120 THEN concat(silence_seconds // 60, ' minutes') ELSE concat(silence_seconds, ' seconds') END"


@query(_STREAK + f"SELECT source_id, seq, concat(streak, ' failures in ', {_WORDS}) AS excerpt FROM r WHERE streak >= 2 AND silence_seconds >= 3 * 86400 AND had_success AND outcome = 'not-retrieved'")
def long_silences(spark: SparkSession, d: str) -> DataFrame:
    """Failures that would escalate at two failures and three days, with the words of their record."""
    e = health.escalations(_streaked(spark, d), 2, 3)
    return e.select("source_id", "seq", F.concat(F.col("streak").cast("string"), F.lit(" failures in "), F.col("silence_words")).alias("excerpt"))


# --- registry ----------------------------------------------------------------

_GAPS = _HOLD + """, g AS (SELECT jurisdiction, document_class, min(CASE WHEN fetch_policy.outcome = 'deny' THEN 'denied' WHEN retired_at IS NOT NULL THEN 'retired' END) AS reason FROM sources WHERE jurisdiction IS NOT NULL AND document_class IS NOT NULL GROUP BY 1, 2 HAVING reason IS NOT NULL),
m AS (SELECT j.jurisdiction, c.document_class FROM (SELECT DISTINCT jurisdiction FROM sources WHERE jurisdiction IS NOT NULL) j, (SELECT DISTINCT document_class FROM sources WHERE document_class IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.jurisdiction = j.jurisdiction AND h.document_class = c.document_class))
"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps the registry's own rows name: pairs with a retired or denied entry."""
    s = table(spark, d, "sources", "jurisdiction", "document_class", "fetch_policy", "retired_at").filter(F.col("jurisdiction").isNotNull() & F.col("document_class").isNotNull())
    reason = F.when(F.col("fetch_policy.outcome") == "deny", "denied").when(F.col("retired_at").isNotNull(), "retired")
    return s.groupBy("jurisdiction", "document_class").agg(F.min(reason).alias("reason")).filter(F.col("reason").isNotNull())


@query(_GAPS + """SELECT m.jurisdiction, m.document_class, 'silent' AS fault FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.jurisdiction = m.jurisdiction AND g.document_class = m.document_class)
UNION ALL SELECT g.jurisdiction, g.document_class, 'stale' FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE g.jurisdiction = m.jurisdiction AND g.document_class = m.document_class)""")
def coverage_faults(spark: SparkSession, d: str) -> DataFrame:
    """Pairs missing and not named as gaps, and pairs named as gaps and not missing."""
    return registry.completeness_faults(_held(spark, d, "jurisdiction", "document_class"), table(spark, d, "sources", "jurisdiction", "document_class"), _gaps(spark, d))


@query(_GAPS + "SELECT reason, count(*) AS n FROM g GROUP BY 1")
def gap_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_id, registered_at FROM sources WHERE upper(jurisdiction) = 'US'")
def sources_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """A scope's sources, its code in any letter case; an unknown scope raises."""
    return registry.in_scope(table(spark, d, "sources", "source_id", "jurisdiction", "registered_at"), "us").select("source_id", "registered_at")


@query(_HOLD + "SELECT source_id, row_number() OVER (ORDER BY jurisdiction, source_id, registered_at) AS place FROM h")
def inventory_order(spark: SparkSession, d: str) -> DataFrame:
    h = _held(spark, d, "source_id", "jurisdiction")
    return positions(h, [F.col("jurisdiction").asc_nulls_last(), F.col("source_id").asc(), F.col("registered_at").asc()], "place").select("source_id", "place")


@query(f"WITH {_DEDUP} SELECT run_id, source_id, row_number() OVER (ORDER BY run_id, source_id) AS place FROM a WHERE source_id IS NOT NULL")
def attempt_order(spark: SparkSession, d: str) -> DataFrame:
    """Attempts by run and source."""
    a = _attempts(spark, d).select("run_id", "source_id").filter(F.col("source_id").isNotNull())
    return positions(a, [F.col("run_id").asc(), F.col("source_id").asc()], "place").select("run_id", "source_id", "place")


@query("SELECT jurisdiction, document_class, url, count(*) AS n FROM (SELECT DISTINCT source_id, jurisdiction, document_class, url FROM sources) GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one place and class registered under several ids."""
    return registry.duplicates(table(spark, d, "sources", "source_id", "jurisdiction", "document_class", "url").distinct(), ["jurisdiction", "document_class", "url"])


@query(f"SELECT contract, count(*) AS n FROM (SELECT concat(normalizer_version, '/', coalesce(extractor_version, '')) AS contract FROM snapshots) WHERE contract NOT IN ({', '.join(map(repr, CONTRACTS))}) GROUP BY 1")
def unregistered_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots recorded under a contract that is not registered."""
    contract = F.concat_ws("/", "normalizer_version", F.coalesce("extractor_version", F.lit("")))
    known = spark.createDataFrame([(c,) for c in CONTRACTS], "contract string")
    return table(spark, d, "snapshots", "normalizer_version", "extractor_version").select(contract.alias("contract")).join(F.broadcast(known), "contract", "left_anti").groupBy("contract").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_id, substr(coalesce(verification.evidence, ''), 1, 12) AS evidence_label, try_cast(nullif(verification.expires_at, '') AS DATE) IS NOT NULL AS has_expiry, try_cast(nullif(checked.at, '') AS DATE) IS NOT NULL AS has_check FROM sources")
def entry_labels(spark: SparkSession, d: str) -> DataFrame:
    """Shortened evidence and whether the dates written as text are dates."""
    s = table(spark, d, "sources", "source_id", "verification", "checked")
    dated = lambda c: F.try_to_date(F.nullif(F.col(c), F.lit("")), "yyyy-MM-dd").isNotNull()
    return s.select("source_id", F.substring(F.coalesce("verification.evidence", F.lit("")), 1, 12).alias("evidence_label"), dated("verification.expires_at").alias("has_expiry"), dated("checked.at").alias("has_check"))


