"""Queries over the watch's own tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chains, diffs, health, history, pages, registry, runs
from tidemark.plans.ordered import positions, previous_in_order, previous_row
from tidemark.session import shared_folder
from tidemark.sources import sinks
from tidemark.sources.tables import table
from tidemark.streaming import streaks as streaming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2026-02-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- text and hashes ---------------------------------------------------------

_NORM = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(normalized_text, '\r\n?', chr(10), 'g'), '[\t\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g'))"


@query(f"SELECT snapshot_id, sha256({_NORM}) AS text_sha256 FROM snapshots")
def snapshot_text_hash(spark: SparkSession, d: str) -> DataFrame:
    """Normalized text's digest."""
    return table(spark, d, "snapshots", "snapshot_id", "normalized_text").select("snapshot_id", T.sha256(T.normalized_text(F.col("normalized_text"))).alias("text_sha256"))


@query("""SELECT snapshot_id, CASE WHEN content_sha256 IS NULL THEN 'absent' WHEN content_sha256 = sha256(normalized_text) THEN 'same' WHEN lower(content_sha256) = sha256(normalized_text) THEN 'capitals'
WHEN length(content_sha256) < 64 AND starts_with(sha256(normalized_text), lower(content_sha256)) THEN 'cut' ELSE 'differs' END AS verdict FROM snapshots""")
def snapshot_hash_check(spark: SparkSession, d: str) -> DataFrame:
    """The recorded digest held against the text."""
    own, got = T.sha256(F.col("normalized_text")), F.col("content_sha256")
    verdict = F.when(got.isNull(), "absent").when(got == own, "same").when(F.lower(got) == own, "capitals").when((F.length(got) < 64) & F.startswith(own, F.lower(got)), "cut").otherwise("differs")
    return table(spark, d, "snapshots", "snapshot_id", "content_sha256", "normalized_text").select("snapshot_id", verdict.alias("verdict"))


@query("SELECT snapshot_id, CAST(len(list_filter(string_split(normalized_text, chr(10)), lambda x: x <> '')) AS BIGINT) AS n_passages FROM snapshots")
def snapshot_passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snapshots", "snapshot_id", "normalized_text").select("snapshot_id", F.size(T.passages(F.col("normalized_text"))).cast("bigint").alias("n_passages"))


@query()
def snapshot_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """The first passages within the budget; tested against a plain loop."""
    return table(spark, d, "snapshots", "snapshot_id", "normalized_text").select("snapshot_id", T.excerpt(F.col("normalized_text")).alias("excerpt"))


@query()
def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Retained bytes, normalized again; tested against a plain restatement (bytes may be invalid UTF-8)."""
    s = table(spark, d, "snapshots", "snapshot_id", "raw_bytes").filter(F.col("raw_bytes").isNotNull())
    return pages.with_title(pages.normalized_pages(s), "raw_bytes", "title").select("snapshot_id", "raw_sha256", "normalized_sha256", "detection_sha256", "title")


@query("""SELECT CASE WHEN contains(lower(coalesce(content_type, '')), 'html') OR contains(lower(coalesce(content_type, '')), 'xml') THEN 'html'
WHEN starts_with(lower(coalesce(content_type, '')), 'text/') OR contains(lower(coalesce(content_type, '')), 'json') THEN 'text' ELSE 'binary' END AS kind, count(*) AS n FROM fetch_attempts GROUP BY 1""")
def content_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_attempts", "content_type").groupBy(T.content_kind(F.col("content_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT snapshot_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS netloc, regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '') AS host,
concat_ws(',', CASE WHEN NOT starts_with(lower(url), 'https://') THEN 'not-https' END, CASE WHEN regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) = '' THEN 'no-host' END,
CASE WHEN contains(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '@') THEN 'credentials' END, CASE WHEN contains(url, '#') THEN 'fragment' END) AS faults FROM snapshots""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "snapshots", "snapshot_id", "url").select("snapshot_id", T.netloc(u).alias("netloc"), T.host(u).alias("host"), F.array_join(T.url_faults(u), ",").alias("faults"))


# --- history -----------------------------------------------------------------


@query("SELECT source_id, snapshot_id, fetched_at, content_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY snapshot_id DESC) AS rn FROM snapshots) WHERE rn = 1")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshots", "source_id", "snapshot_id", "fetched_at", "content_sha256")
    return history.latest(s, "source_id", ["snapshot_id"], ["snapshot_id", "fetched_at", "content_sha256"])


@query("SELECT source_id, snapshot_id, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY snapshot_id DESC) AS rank_no FROM snapshots) WHERE rank_no <= 5")
def snapshot_retention(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshots", "source_id", "snapshot_id")
    return history.newest_n(s, "source_id", ["snapshot_id"], 5, F.floor(F.col("snapshot_id") / 10_000)).select("source_id", "snapshot_id", "rank_no")


_TRANS = """WITH h AS (SELECT source_id, snapshot_id, sha256(normalized_text) AS h FROM snapshots), t AS (SELECT *, lag(h) OVER (PARTITION BY source_id ORDER BY snapshot_id) AS p FROM h),
m AS (SELECT source_id, snapshot_id, p AS previous_hash, h AS new_hash, substr(sha256(concat(source_id, chr(10), p, chr(10), h)), 1, 16) AS change_id FROM t WHERE p IS NOT NULL AND p <> h)
"""


@query(_TRANS + "SELECT * FROM m")
def snapshot_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Every move from one text to the next; a page that flaps repeats its change_ids."""
    s = table(spark, d, "snapshots", "source_id", "snapshot_id", "normalized_text").withColumn("h", T.sha256(F.col("normalized_text"))).drop("normalized_text")
    return history.transitions(s, "source_id", ["snapshot_id"], F.floor(F.col("snapshot_id") / 10_000), "h").select("source_id", "snapshot_id", "previous_hash", "new_hash", "change_id")


@query(_TRANS + "SELECT change_id, min(snapshot_id) AS first_snapshot_id, count(*) AS n_seen FROM m GROUP BY 1")
def distinct_transitions(spark: SparkSession, d: str) -> DataFrame:
    """First write wins; how often each was seen."""
    return snapshot_transitions(spark, d).groupBy("change_id").agg(F.min("snapshot_id").alias("first_snapshot_id"), F.count(F.lit(1)).alias("n_seen"))


_DEDUP = "a AS (SELECT run_id, source_id, min(attempted_at) AS att, bool_or(ok) AS ok, max(extraction_outcome) AS extraction_outcome, max(url) AS url, max(normalized_sha256) AS normalized_sha256 FROM fetch_attempts GROUP BY 1, 2)"


def _attempts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Attempts without their duplicates: one row per run and source."""
    a = table(spark, d, "fetch_attempts", "run_id", "source_id", "attempted_at", "ok", "extraction_outcome", "url", "normalized_sha256")
    return a.groupBy("run_id", "source_id").agg(
        F.min("attempted_at").alias("at"), F.bool_or("ok").alias("ok"), F.max("extraction_outcome").alias("extraction_outcome"), F.max("url").alias("url"), F.max("normalized_sha256").alias("normalized_sha256"))


_ASOF = f"""WITH {_DEDUP}, s AS (SELECT source_id, fetched_at, max(snapshot_id) AS snapshot_id FROM snapshots GROUP BY 1, 2),
p AS (SELECT s.*, n.url AS p_url, sha256(n.normalized_text) AS p_hash, concat(n.normalizer_version, '/', coalesce(n.extractor_version, '')) AS p_contract, n.raw_bytes IS NOT NULL AS p_kept FROM s JOIN snapshots n USING (snapshot_id)),
j AS (SELECT a.*, p.snapshot_id, p_url, p_hash, p_contract, p_kept, p.snapshot_id IS NOT NULL AS has FROM a ASOF LEFT JOIN p ON a.source_id = p.source_id AND a.att > p.fetched_at),
c AS (SELECT run_id, source_id, snapshot_id AS previous_snapshot_id, CASE WHEN NOT coalesce(ok, false) THEN 'unreachable' WHEN extraction_outcome = 'no-text' THEN 'no_text' WHEN NOT has THEN 'new' WHEN p_url <> url THEN 'rebaselined'
  WHEN p_contract <> (SELECT max(concat(normalizer_version, '/', coalesce(extractor_version, ''))) FROM snapshots) AND NOT p_kept THEN 'unrenormalizable'
  WHEN coalesce(normalized_sha256, '') = p_hash AND p_contract = (SELECT max(concat(normalizer_version, '/', coalesce(extractor_version, ''))) FROM snapshots) THEN 'unchanged' WHEN coalesce(normalized_sha256, '') = p_hash THEN 'renormalized' ELSE 'changed' END AS bucket FROM j)
"""


@query(_ASOF + "SELECT * FROM c")
def watch_classify(spark: SparkSession, d: str) -> DataFrame:
    """Each attempt against the last snapshot before it."""
    contract = F.concat_ws("/", "normalizer_version", F.coalesce("extractor_version", F.lit("")))
    s = table(spark, d, "snapshots", "source_id", "snapshot_id", "fetched_at", "url", "normalized_text", "normalizer_version", "extractor_version", "raw_bytes").select(
        "source_id", "fetched_at", "snapshot_id", F.col("url").alias("p_url"), T.sha256(F.col("normalized_text")).alias("p_hash"), contract.alias("p_contract"), F.col("raw_bytes").isNotNull().alias("p_kept"))
    now = s.agg(F.max("p_contract").alias("now"))
    j = history.as_of(_attempts(spark, d), s, "source_id", "at", "fetched_at", ["fetched_at", "snapshot_id"], ["snapshot_id", "p_url", "p_hash", "p_contract", "p_kept"], F.to_date("__tm_at"))
    j = j.join(F.broadcast(now))
    p = F.col("found")
    bucket = history.watch_bucket(F.col("ok"), F.coalesce("extraction_outcome", F.lit("")), p.isNotNull(), p["p_url"] == F.col("url"), p["p_contract"] == F.col("now"), p["p_kept"], F.coalesce("normalized_sha256", F.lit("")) == p["p_hash"])
    return j.select("run_id", "source_id", p["snapshot_id"].alias("previous_snapshot_id"), bucket.alias("bucket"))


@query(_ASOF + "SELECT run_id, bucket, count(*) AS n FROM c GROUP BY ALL")
def watch_buckets(spark: SparkSession, d: str) -> DataFrame:
    return watch_classify(spark, d).groupBy("run_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT source_id, snapshot_id, normalized_text AS x, concat(normalizer_version, '/', coalesce(extractor_version, '')) AS now_contract FROM snapshots),
l AS (SELECT *, lag(x) OVER w AS px, lag(now_contract) OVER w AS was_contract FROM t WINDOW w AS (PARTITION BY source_id ORDER BY snapshot_id)),
g AS (SELECT DISTINCT was_contract, now_contract, source_id FROM l WHERE px = x AND was_contract <> now_contract)
SELECT was_contract, now_contract, count(*) AS n_sources, array_to_string(list_sort(list(source_id))[1:8], ',') AS first_sources FROM g GROUP BY 1, 2""")
def renormalized_groups(spark: SparkSession, d: str) -> DataFrame:
    """Same text under another contract, by the pair of contracts; the first eight sources."""
    contract = F.concat_ws("/", "normalizer_version", F.coalesce("extractor_version", F.lit("")))
    s = table(spark, d, "snapshots", "source_id", "snapshot_id", "normalized_text", "normalizer_version", "extractor_version").select("source_id", "snapshot_id", T.sha256(F.col("normalized_text")).alias("h"), contract.alias("now_contract"))
    near = previous_row(s, ["source_id"], ["snapshot_id"], F.floor(F.col("snapshot_id") / 10_000), ["h", "now_contract"])
    g = near.filter((F.col("prev.h") == F.col("h")) & (F.col("prev.now_contract") != F.col("now_contract"))).select(F.col("prev.now_contract").alias("was_contract"), "now_contract", "source_id").distinct()
    # the first eight per group without gathering a group: each task keeps its own eight
    eight = g.groupBy("was_contract", "now_contract", F.pmod(F.xxhash64("source_id"), F.lit(64)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("source_id")), 1, 8).alias("ids"))
    return eight.groupBy("was_contract", "now_contract").agg(F.sum("n").alias("n_sources"), F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 8), ",").alias("first_sources"))


@query("""WITH s AS (SELECT source_id, CAST(date_trunc('week', fetched_at) AS DATE) AS wk, sha256(normalized_text) AS h FROM snapshots)
SELECT source_id, strftime(wk, '%Y-%m-%d') AS week_start, count(*) AS n_fetches, CASE WHEN count(DISTINCT h) = 1 THEN 'stable' ELSE 'unstable' END AS bucket FROM s GROUP BY source_id, wk HAVING count(*) > 1""")
def stability_check(spark: SparkSession, d: str) -> DataFrame:
    """Sources fetched more than once in a week: the same text each time or not."""
    s = table(spark, d, "snapshots", "source_id", "fetched_at", "normalized_text").select("source_id", F.date_format(F.date_trunc("week", F.col("fetched_at").cast("timestamp")), "yyyy-MM-dd").alias("week_start"), T.sha256(F.col("normalized_text")).alias("h"))
    g = s.groupBy("source_id", "week_start").agg(F.count(F.lit(1)).alias("n_fetches"), F.min("h").alias("lo"), F.max("h").alias("hi")).filter(F.col("n_fetches") > 1)
    return g.select("source_id", "week_start", "n_fetches", F.when(F.col("lo") == F.col("hi"), "stable").otherwise("unstable").alias("bucket"))


_BASE = f"""WITH {_DEDUP}, b AS (SELECT source_id, url AS b_url, sha256(normalized_text) AS b_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY snapshot_id DESC) AS rn FROM snapshots WHERE fetched_at < TIMESTAMP '{AS_OF}') WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY att DESC, run_id DESC) AS rn FROM a) WHERE rn = 1)
"""


@query(_BASE + "SELECT n.source_id, CASE WHEN NOT coalesce(ok, false) THEN 'unreachable' WHEN extraction_outcome = 'no-text' THEN 'no_text' WHEN b_hash IS NULL THEN 'unbaselined' WHEN b_url <> '' AND b_url <> url THEN 'url_changed' WHEN normalized_sha256 = b_hash THEN 'matched' ELSE 'moved' END AS bucket FROM n LEFT JOIN b ON b.source_id = n.source_id")
def baseline_check(spark: SparkSession, d: str) -> DataFrame:
    """The last attempt of each source against a baseline taken at a date."""
    s = table(spark, d, "snapshots", "source_id", "snapshot_id", "fetched_at", "url", "normalized_text").filter(F.col("fetched_at") < F.lit(AS_OF).cast("timestamp_ntz"))
    s = s.select("source_id", "snapshot_id", F.col("url").alias("b_url"), T.sha256(F.col("normalized_text")).alias("b_hash"))
    base = history.latest(s, "source_id", ["snapshot_id"], ["b_url", "b_hash"])
    now = history.latest(_attempts(spark, d), "source_id", ["at", "run_id"], ["ok", "extraction_outcome", "url", "normalized_sha256"])
    j = now.join(base, "source_id", "left")
    bucket = (
        F.when(~F.coalesce("ok", F.lit(False)), "unreachable").when(F.col("extraction_outcome") == "no-text", "no_text").when(F.col("b_hash").isNull(), "unbaselined")
        .when((F.col("b_url") != "") & (F.col("b_url") != F.col("url")), "url_changed").when(F.col("normalized_sha256") == F.col("b_hash"), "matched").otherwise("moved"))
    return j.select("source_id", bucket.alias("bucket"))


# --- diffs -------------------------------------------------------------------


def _changed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Changed neighbours with both texts: ids are found first, texts are fetched for them only."""
    s = table(spark, d, "snapshots", "source_id", "snapshot_id", "url", "normalized_text")
    moved = previous_row(s.select("source_id", "snapshot_id", T.sha256(F.col("normalized_text")).alias("h")), ["source_id"], ["snapshot_id"], F.floor(F.col("snapshot_id") / 10_000), ["snapshot_id", "h"])
    ids = moved.filter(F.col("prev.h") != F.col("h")).select("snapshot_id", F.col("prev.snapshot_id").alias("previous_id"))
    texts = s.select("snapshot_id", "normalized_text")
    return ids.join(s.select("snapshot_id", "url", F.col("normalized_text").alias("new_text")), "snapshot_id").join(texts.select(F.col("snapshot_id").alias("previous_id"), F.col("normalized_text").alias("old_text")), "previous_id")


@query()
def changed_unified_diff(spark: SparkSession, d: str) -> DataFrame:
    """Unified diffs of changed neighbours; tested against the standard library on a fixture."""
    return diffs.unified_diffs(_changed_pairs(spark, d), "old_text", "new_text", "diff", "url").select("snapshot_id", "previous_id", "diff")


@query("""WITH t AS (SELECT source_id, snapshot_id, normalized_text AS x, lag(normalized_text) OVER (PARTITION BY source_id ORDER BY snapshot_id) AS p FROM snapshots), c AS (SELECT * FROM t WHERE p <> x),
u AS (SELECT snapshot_id, unnest(string_split(p, chr(10))) AS passage, -1 AS n FROM c UNION ALL SELECT snapshot_id, unnest(string_split(x, chr(10))), 1 FROM c)
SELECT snapshot_id, passage, CAST(greatest(-sum(n), 0) AS BIGINT) AS n_removed, CAST(greatest(sum(n), 0) AS BIGINT) AS n_added FROM u WHERE passage <> '' GROUP BY 1, 2 HAVING sum(n) <> 0""")
def changed_passage_rows(spark: SparkSession, d: str) -> DataFrame:
    return diffs.passage_rows(_changed_pairs(spark, d), ["snapshot_id"], "old_text", "new_text")


# --- health ------------------------------------------------------------------

_STREAK = f"""WITH {_DEDUP}, o AS (SELECT source_id, att, run_id AS seq, CASE WHEN NOT coalesce(ok, false) THEN 'not-retrieved' WHEN extraction_outcome = 'no-text' THEN 'no-text' ELSE 'measured' END AS outcome FROM a),
g AS (SELECT *, sum(CASE WHEN outcome = 'measured' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY att, seq ROWS UNBOUNDED PRECEDING) AS island FROM o WHERE outcome <> 'no-text'),
k AS (SELECT source_id, att, seq, outcome, island > 0 AS had_success, CAST(sum(CASE WHEN outcome = 'not-retrieved' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS streak, min(CASE WHEN outcome = 'not-retrieved' THEN att END) OVER w AS streak_started_at
  FROM g WINDOW w AS (PARTITION BY source_id, island ORDER BY att, seq ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CASE WHEN streak > 0 THEN CAST(greatest(0, epoch_us(att) // 1000000 - epoch_us(streak_started_at) // 1000000) AS BIGINT) END AS silence_seconds FROM k)
"""


def _streaked(spark: SparkSession, d: str) -> DataFrame:
    return health.streaks(_outcomes(spark, d))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(~F.coalesce("ok", F.lit(False)), "not-retrieved").when(F.col("extraction_outcome") == "no-text", "no-text").otherwise("measured")
    return _attempts(spark, d).select("source_id", "at", F.col("run_id").alias("seq"), outcome.alias("outcome"))


@query(_STREAK + "SELECT source_id, att AS \"at\", seq, outcome, streak FROM r")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return _streaked(spark, d).select("source_id", "at", "seq", "outcome", "streak")


@query(_STREAK + "SELECT source_id, seq, streak_started_at, silence_seconds FROM r WHERE streak > 0")
def silence_windows(spark: SparkSession, d: str) -> DataFrame:
    return _streaked(spark, d).filter(F.col("streak") > 0).select("source_id", "seq", "streak_started_at", "silence_seconds")


@query(_STREAK + "SELECT source_id, seq, streak, silence_seconds, substr(sha256(concat(source_id, chr(10), seq, chr(10))), 1, 16) AS removal_id FROM r WHERE streak >= 3 AND silence_seconds >= 14 * 86400 AND had_success AND outcome = 'not-retrieved'")
def possibly_removed(spark: SparkSession, d: str) -> DataFrame:
    e = health.escalations(_streaked(spark, d))
    return e.select("source_id", "seq", "streak", "silence_seconds", T.change_id(F.col("source_id"), F.col("seq"), F.lit("")).alias("removal_id"))


_NOW = _STREAK + "SELECT l.source_id, streak, CASE WHEN streak > 0 THEN streak_started_at END AS streak_started_at"


@query(_NOW + """, silence_seconds, last_success_at, last_failure_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY att DESC, seq DESC) AS rn FROM r) l
JOIN (SELECT source_id, max(CASE WHEN outcome = 'measured' THEN att END) AS last_success_at, max(CASE WHEN outcome = 'not-retrieved' THEN att END) AS last_failure_at FROM r GROUP BY 1) m ON m.source_id = l.source_id WHERE rn = 1""")
def source_health_now(spark: SparkSession, d: str) -> DataFrame:
    return health.health_now(_streaked(spark, d))


@query(_STREAK + """SELECT f.source_id, streak_started_at, max(streak) AS n_failures, max(att) AS last_failure_at FROM r f JOIN (SELECT source_id, max(att) AS ok_at FROM r WHERE outcome = 'measured' GROUP BY 1) s ON s.source_id = f.source_id
WHERE outcome = 'not-retrieved' GROUP BY f.source_id, streak_started_at HAVING max(att) < max(ok_at)""")
def outage_lengths(spark: SparkSession, d: str) -> DataFrame:
    return health.outages(_streaked(spark, d))


@query(_NOW + " FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY att DESC, seq DESC) AS rn FROM r) l WHERE rn = 1")
def streaming_streaks(spark: SparkSession, d: str) -> DataFrame:
    """The streaks by stream: the attempts are replayed as files, state is kept per source."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _outcomes(spark, d).filter(F.col("outcome") != "no-text").withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{root}/in")
    source = spark.readStream.schema("source_id string, at timestamp, seq string, outcome string").parquet(f"{root}/in")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(f"{root}/out")

    run = streaming.streak_stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return streaming.latest_states(spark.read.parquet(f"{root}/out")).withColumn("streak_started_at", F.col("streak_started_at").cast("timestamp_ntz"))


# --- runs --------------------------------------------------------------------

_RUNS = f"WITH {_DEDUP}, g AS (SELECT run_id, count(*) AS attempted, count(*) FILTER (ok) AS successful, count(*) FILTER (ok AND extraction_outcome = 'no-text') AS unmeasured FROM a GROUP BY 1) "


@query(_RUNS + "SELECT run_id, attempted, successful, unmeasured, successful - unmeasured AS observed FROM g")
def run_receipts(spark: SparkSession, d: str) -> DataFrame:
    return runs.receipts(_attempts(spark, d))


@query(_RUNS + """, w AS (SELECT DISTINCT run_id, state, attempted_count, successful_count, unmeasured_count FROM watch_runs WHERE state <> 'running'),
j AS (SELECT w.*, coalesce(attempted, 0) AS a, coalesce(successful, 0) AS s, coalesce(unmeasured, 0) AS u FROM w LEFT JOIN g ON g.run_id = w.run_id),
p AS (SELECT run_id, 'attempted_count' AS counter, CAST(attempted_count AS BIGINT) AS recorded, a AS counted FROM j UNION ALL SELECT run_id, 'successful_count', CAST(successful_count AS BIGINT), s FROM j UNION ALL SELECT run_id, 'unmeasured_count', CAST(unmeasured_count AS BIGINT), u FROM j)
SELECT * FROM p WHERE recorded IS DISTINCT FROM counted""")
def run_receipt_faults(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "watch_runs", "run_id", "state", "attempted_count", "successful_count", "unmeasured_count").distinct()
    return runs.receipt_faults(w, runs.receipts(_attempts(spark, d)))


@query("""SELECT run_id, state, CASE WHEN eligible_count = 0 THEN 'failed' WHEN (attempted_count - successful_count) + unmeasured_count > 0 THEN 'partial' WHEN observation_count > 0 THEN 'complete' ELSE 'quiet' END AS derived
FROM (SELECT DISTINCT run_id, state, eligible_count, attempted_count, successful_count, observation_count, unmeasured_count FROM watch_runs) WHERE state <> 'running'""")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "watch_runs", "run_id", "state", "eligible_count", "attempted_count", "successful_count", "observation_count", "unmeasured_count").distinct().filter(F.col("state") != "running")
    return w.select("run_id", "state", runs.derived_state(F.col("eligible_count"), F.col("attempted_count") - F.col("successful_count"), F.col("unmeasured_count"), F.col("observation_count")).alias("derived"))


@query("""SELECT run_id, started_at, state, TIMESTAMP '2026-03-02 00:00:00' - coalesce(completed_at, started_at) > INTERVAL 8 DAY AS stale FROM watch_runs WHERE state IN ('quiet', 'complete') AND jurisdiction IS NULL ORDER BY started_at DESC, run_id DESC LIMIT 1""")
def public_status(spark: SparkSession, d: str) -> DataFrame:
    """The last successful overall run and whether it is stale; a top-1 report."""
    w = table(spark, d, "watch_runs", "run_id", "started_at", "completed_at", "state", "jurisdiction")
    stale = F.lit("2026-03-02 00:00:00").cast("timestamp_ntz") - F.coalesce("completed_at", "started_at") > F.expr("INTERVAL 8 DAYS")
    return runs.latest_run(w).select("run_id", "started_at", "state", stale.alias("stale"))


@query(r"""WITH s AS (SELECT DISTINCT run_id, source_id, attempted_at, regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '') AS host FROM fetch_attempts)
SELECT host, run_id, source_id, attempted_at, CAST(epoch_us(attempted_at) - epoch_us(lag(attempted_at) OVER (PARTITION BY host ORDER BY attempted_at, run_id, source_id)) AS BIGINT) AS gap_us FROM s""")
def attempt_gaps_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds since the host's attempt before."""
    a = table(spark, d, "fetch_attempts", "run_id", "source_id", "attempted_at", "url").withColumn("host", T.host(F.col("url"))).drop("url").distinct()
    near = previous_in_order(a, ["host"], ["attempted_at", "run_id", "source_id"], ["attempted_at"])
    gap = F.unix_micros(F.col("attempted_at").cast("timestamp")) - F.unix_micros(F.col("prev.attempted_at").cast("timestamp"))
    return near.select("host", "run_id", "source_id", "attempted_at", gap.alias("gap_us"))


# --- registry ----------------------------------------------------------------

_HOLD = f"WITH h AS (SELECT * FROM sources WHERE registered_at <= TIMESTAMP '{AS_OF}' AND (retired_at IS NULL OR retired_at > TIMESTAMP '{AS_OF}')) "


def _held(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    s = table(spark, d, "sources", *{*columns, "registered_at", "retired_at"})
    return registry.holding_at(s, F.lit(AS_OF).cast("timestamp_ntz"))


@query(_HOLD + "SELECT jurisdiction, count(*) AS total, count(*) FILTER (verification.status = 'verified') AS verified, count(*) FILTER (verification.status = 'unverified') AS unverified, count(*) FILTER (verification.status = 'rejected') AS rejected FROM h GROUP BY GROUPING SETS ((jurisdiction), ())")
def verification_summary(spark: SparkSession, d: str) -> DataFrame:
    return registry.verification_summary(_held(spark, d, "jurisdiction", "verification"))


@query("SELECT source_id, count(*) AS n FROM sources GROUP BY 1 HAVING count(*) > 1")
def registry_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return registry.duplicates(table(spark, d, "sources", "source_id"), ["source_id"])


@query(_HOLD + "SELECT count(*) AS n_sources, count(DISTINCT jurisdiction) AS n_jurisdictions, count(DISTINCT document_class) AS n_classes, count(*) FILTER (verified) AS n_verified, count(*) FILTER (active) AS n_active, count(*) FILTER (NOT coalesce(checked.reachable, true)) AS n_unreachable FROM h")
def coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    h = _held(spark, d, "jurisdiction", "document_class", "verified", "active", "checked")
    return h.agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_distinct("jurisdiction").alias("n_jurisdictions"), F.count_distinct("document_class").alias("n_classes"),
        F.count_if("verified").alias("n_verified"), F.count_if("active").alias("n_active"), F.count_if(~F.coalesce(F.col("checked.reachable"), F.lit(True))).alias("n_unreachable"))


@query(_HOLD + "SELECT document_class, count(*) AS n FROM h GROUP BY 1")
def coverage_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d, "document_class").groupBy("document_class").agg(F.count(F.lit(1)).alias("n"))


@query(_HOLD + "SELECT j.jurisdiction, c.document_class FROM (SELECT DISTINCT jurisdiction FROM h WHERE jurisdiction IS NOT NULL) j, (SELECT DISTINCT document_class FROM h WHERE document_class IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.jurisdiction = j.jurisdiction AND h.document_class = c.document_class)")
def coverage_missing_pairs(spark: SparkSession, d: str) -> DataFrame:
    return registry.missing_pairs(_held(spark, d, "jurisdiction", "document_class"), "jurisdiction", "document_class")


_DAY = r"regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}')"
_STRICT = "CASE WHEN " + _DAY + " THEN try_cast({0} AS DATE) END"
_V, _AT, _EX = "verification.", _STRICT.format("verification.at"), _STRICT.format("verification.expires_at")


@query(f"""WITH f AS (SELECT unnest([CASE WHEN NOT coalesce(regexp_full_match(source_id, '[a-z0-9]+(-[a-z0-9]+)*'), false) THEN 'id-shape' END, CASE WHEN trim(coalesce(authority, '')) = '' THEN 'no-authority' END, CASE WHEN verified <> (verification.status = 'verified') THEN 'verified-differs' END,
CASE WHEN verification.status <> 'unverified' AND (trim(verification.verifier) = '' OR ({_AT}) IS NULL) THEN 'verification-unsigned' END, CASE WHEN verification.expires_at <> '' AND ({_EX}) IS NULL THEN 'expiry-shape' END, CASE WHEN ({_EX}) < ({_AT}) THEN 'expiry-before-decision' END,
CASE WHEN fetch_policy.outcome IN ('allow', 'deny') AND trim(coalesce(fetch_policy.reviewer, '')) = '' THEN 'policy-unsigned' END, CASE WHEN NOT starts_with(lower(url), 'https://') THEN 'not-https' END, CASE WHEN contains(url, '#') THEN 'fragment' END]) AS fault FROM sources)
SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1""")
def registry_fault_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries per broken rule; one entry counts for each rule it breaks."""
    s = table(spark, d, "sources", "source_id", "authority", "verified", "verification", "fetch_policy", "url")
    return registry.fault_counts(s.select(registry.entry_faults().alias("faults")), "faults")


# --- changes -----------------------------------------------------------------


@query("SELECT change_id, min(observed_at) AS observed_at, count(*) AS n_rows FROM changes GROUP BY 1")
def change_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First write wins over repeated rows."""
    return table(spark, d, "changes", "change_id", "observed_at").groupBy("change_id").agg(F.min("observed_at").alias("observed_at"), F.count(F.lit(1)).alias("n_rows"))


@query("""WITH RECURSIVE e AS (SELECT change_id AS id, min(superseded_by) AS next_id FROM changes WHERE coalesce(superseded_by, '') <> '' GROUP BY 1),
w AS (SELECT id, next_id AS cur, 1 AS steps FROM e UNION ALL SELECT w.id, e.next_id, steps + 1 FROM w JOIN e ON e.id = w.cur WHERE steps < 100)
SELECT id, cur AS end_id, CAST(steps AS BIGINT) AS steps, false AS cyclic FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY steps DESC) AS rn FROM w) WHERE rn = 1""")
def correction_chains(spark: SparkSession, d: str) -> DataFrame:
    """Where each chain of corrections ends."""
    c = table(spark, d, "changes", "change_id", "superseded_by").filter(F.coalesce("superseded_by", F.lit("")) != "")
    return chains.chain_ends(c.select(F.col("change_id").alias("id"), F.col("superseded_by").alias("next_id")))


@query("""WITH c AS (SELECT DISTINCT change_id, superseded_by FROM changes WHERE coalesce(superseded_by, '') <> '') SELECT change_id, superseded_by FROM c WHERE NOT EXISTS (SELECT 1 FROM changes x WHERE x.change_id = c.superseded_by)""")
def missing_replacements(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "changes", "change_id", "superseded_by")
    refs = c.filter(F.coalesce("superseded_by", F.lit("")) != "").distinct()
    return refs.join(c.select(F.col("change_id").alias("superseded_by")).distinct(), "superseded_by", "left_anti").select("change_id", "superseded_by")


_F = r"""SELECT fault, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT coalesce(regexp_full_match(change_id, '[0-9a-f]{16}'), false) THEN 'id-shape' END, CASE WHEN NOT coalesce(regexp_full_match(previous_hash, '[0-9a-f]{64}'), false) THEN 'previous-shape' END,
CASE WHEN kind = 'possibly_removed' AND coalesce(new_hash, '') <> '' THEN 'removal-with-hash' END, CASE WHEN kind = 'content_drift' AND NOT coalesce(regexp_full_match(new_hash, '[0-9a-f]{64}'), false) THEN 'drift-without-hash' END, CASE WHEN reviewed_at < observed_at THEN 'reviewed-early' END,
CASE WHEN independent_reviewed_at < reviewed_at THEN 'second-review-early' END, CASE WHEN lower(trim(independent_reviewer)) = lower(trim(reviewer)) THEN 'same-reviewer' END, CASE WHEN significance <> 'unclassified' AND coalesce(trim(reviewer), '') = '' THEN 'unsigned' END]) AS fault FROM changes) WHERE fault IS NOT NULL GROUP BY 1"""


@query(_F)
def change_fault_counts(spark: SparkSession, d: str) -> DataFrame:
    """Shape and order faults of change rows."""
    c = table(spark, d, "changes", "change_id", "previous_hash", "new_hash", "kind", "observed_at", "reviewed_at", "independent_reviewed_at", "reviewer", "independent_reviewer", "significance")
    sha = r"^[0-9a-f]{64}$"
    no = lambda column, pattern: ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    faults = F.array_compact(F.array(
        F.when(no("change_id", r"^[0-9a-f]{16}$"), "id-shape"), F.when(no("previous_hash", sha), "previous-shape"),
        F.when((F.col("kind") == "possibly_removed") & (F.coalesce("new_hash", F.lit("")) != ""), "removal-with-hash"), F.when((F.col("kind") == "content_drift") & no("new_hash", sha), "drift-without-hash"),
        F.when(F.col("reviewed_at") < F.col("observed_at"), "reviewed-early"), F.when(F.col("independent_reviewed_at") < F.col("reviewed_at"), "second-review-early"),
        F.when(F.lower(F.trim("independent_reviewer")) == F.lower(F.trim("reviewer")), "same-reviewer"), F.when((F.col("significance") != "unclassified") & (F.coalesce(F.trim("reviewer"), F.lit("")) == ""), "unsigned")))
    return registry.fault_counts(c.select(faults.alias("faults")), "faults")


@query("""SELECT DISTINCT change_id, jurisdiction, strftime(coalesce(lifecycle_at, observed_at), '%Y-%m-%dT%H:%M:%S') AS published_at,
CASE WHEN publication_status = 'active' THEN change_id ELSE concat_ws('-', change_id, 'lifecycle', substr(sha256(concat_ws(chr(10), coalesce(change_id, ''), coalesce(publication_status, ''), coalesce(superseded_by, ''), coalesce(lifecycle_reason, ''), coalesce(lifecycle_actor, ''), coalesce(replace(strftime(lifecycle_at, '%Y-%m-%dT%H:%M:%S.%f+00:00'), '.000000', ''), ''))), 1, 16)) END AS guid,
replace(replace(replace(replace(replace(coalesce(url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS link FROM changes""")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "changes", "change_id", "jurisdiction", "document_class", "kind", "url", "observed_at", "lifecycle_at", "publication_status", "superseded_by", "lifecycle_reason", "lifecycle_actor")
    return sinks.feed_items(c).select("change_id", "jurisdiction", "published_at", "guid", "link").distinct()


@query("SELECT s.jurisdiction, count(DISTINCT c.change_id) AS n_changes FROM (SELECT DISTINCT jurisdiction FROM sources) s LEFT JOIN changes c ON c.jurisdiction = s.jurisdiction GROUP BY 1")
def jurisdiction_feed_counts(spark: SparkSession, d: str) -> DataFrame:
    """A feed for every registered jurisdiction, even an empty one."""
    n = table(spark, d, "changes", "jurisdiction", "change_id").distinct().groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "sources", "jurisdiction").distinct().join(n, "jurisdiction", "left").select("jurisdiction", F.coalesce("n", F.lit(0)).alias("n_changes"))


@query("SELECT change_id, sha256(concat_ws(chr(10), coalesce(change_id, ''), coalesce(kind, ''), coalesce(strftime(observed_at, '%Y-%m-%d %H:%M:%S'), ''))) AS event_id FROM changes")
def stable_event_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "changes", "change_id", "kind", "observed_at")
    return c.select("change_id", T.event_id(F.col("change_id"), F.col("kind"), F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss")).alias("event_id"))


@query()
def actor_identities(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers by canonical identity; distinct names only pass through Python."""
    names = table(spark, d, "changes", "reviewer").filter(F.col("reviewer").isNotNull()).distinct()
    return names.select("reviewer", T.actor_identity(F.col("reviewer")).alias("identity"))


@query("SELECT source_id, run_id, len(redirect_chain) AS n_hops, len(list_filter(redirect_chain, lambda h: NOT starts_with(h.url, 'https://'))) > 0 AS unsafe FROM (SELECT DISTINCT source_id, run_id, redirect_chain FROM fetch_attempts) WHERE len(redirect_chain) > 0")
def redirect_guards(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "fetch_attempts", "source_id", "run_id", "redirect_chain").filter(F.size("redirect_chain") > 0).distinct()
    return a.select("source_id", "run_id", F.size("redirect_chain").cast("bigint").alias("n_hops"), F.exists("redirect_chain", lambda h: ~h["url"].startswith("https://")).alias("unsafe"))


@query("""SELECT fault, count(*) AS n FROM (SELECT unnest([CASE WHEN ok AND (raw_sha256 IS NULL OR raw_sha256 = '') THEN 'success-without-hash' END, CASE WHEN NOT ok AND coalesce(normalized_sha256, '') <> '' THEN 'failure-with-hash' END,
CASE WHEN truncated AND error_class <> 'body-too-large' THEN 'truncated-otherwise' END, CASE WHEN bytes_received > byte_limit AND ok THEN 'over-limit' END, CASE WHEN NOT ok AND coalesce(error_class, '') = '' THEN 'unclassed' END, CASE WHEN completed_at < attempted_at THEN 'ended-early' END]) AS fault FROM fetch_attempts) WHERE fault IS NOT NULL GROUP BY 1""")
def attempt_fault_counts(spark: SparkSession, d: str) -> DataFrame:
    """Evidence faults of attempts."""
    a = table(spark, d, "fetch_attempts", "ok", "raw_sha256", "normalized_sha256", "truncated", "error_class", "bytes_received", "byte_limit", "completed_at", "attempted_at")
    faults = F.array_compact(F.array(
        F.when(F.col("ok") & (F.coalesce("raw_sha256", F.lit("")) == ""), "success-without-hash"), F.when(~F.col("ok") & (F.coalesce("normalized_sha256", F.lit("")) != ""), "failure-with-hash"),
        F.when(F.col("truncated") & (F.col("error_class") != "body-too-large"), "truncated-otherwise"), F.when((F.col("bytes_received") > F.col("byte_limit")) & F.col("ok"), "over-limit"),
        F.when(~F.col("ok") & (F.coalesce("error_class", F.lit("")) == ""), "unclassed"), F.when(F.col("completed_at") < F.col("attempted_at"), "ended-early")))
    return registry.fault_counts(a.select(faults.alias("faults")), "faults")


@query("SELECT DISTINCT r.run_id, r.jurisdiction, a.source_id FROM watch_runs r JOIN fetch_attempts a ON a.run_id = r.run_id WHERE r.jurisdiction IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = a.source_id AND s.jurisdiction = r.jurisdiction)")
def attempts_outside_scope(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of a scoped run whose source is not in its jurisdiction."""
    r = table(spark, d, "watch_runs", "run_id", "jurisdiction").filter(F.col("jurisdiction").isNotNull()).distinct()
    a = table(spark, d, "fetch_attempts", "run_id", "source_id").distinct()
    return a.join(r, "run_id").join(table(spark, d, "sources", "source_id", "jurisdiction"), ["source_id", "jurisdiction"], "left_anti").select("run_id", "jurisdiction", "source_id")


# --- queues and orders -------------------------------------------------------


@query(_HOLD + """SELECT source_id, jurisdiction, document_class, row_number() OVER (ORDER BY CASE WHEN jurisdiction = 'US' THEN 0 ELSE 1 END, jurisdiction, document_class, source_id, registered_at) AS place, count(*) OVER () AS of_all
FROM h WHERE verification.status NOT IN ('verified', 'rejected')""")
def verification_queue(spark: SparkSession, d: str) -> DataFrame:
    """Entries still to be verified, federal ones first, with their place in the whole queue."""
    h = _held(spark, d, "source_id", "jurisdiction", "document_class", "verification").filter(~F.col("verification.status").isin("verified", "rejected"))
    order = [F.when(F.col("jurisdiction") == "US", 0).otherwise(1).asc(), F.col("jurisdiction").asc_nulls_last(), F.col("document_class").asc_nulls_last(), F.col("source_id").asc(), F.col("registered_at").asc()]
    queue = positions(h, order, "place")
    return queue.join(F.broadcast(queue.agg(F.count(F.lit(1)).alias("of_all")))).select("source_id", "jurisdiction", "document_class", "place", "of_all")


@query("SELECT change_id, row_number() OVER (ORDER BY at DESC, change_id DESC) AS place FROM (SELECT change_id, max(coalesce(lifecycle_at, observed_at)) AS \"at\" FROM changes GROUP BY 1)".replace("ORDER BY at", 'ORDER BY "at"'))
def publication_order(spark: SparkSession, d: str) -> DataFrame:
    """Changes from the newest on; ties by id, falling."""
    c = table(spark, d, "changes", "change_id", "lifecycle_at", "observed_at").groupBy("change_id").agg(F.max(F.coalesce("lifecycle_at", "observed_at")).alias("at"))
    return positions(c, [F.col("at").desc(), F.col("change_id").desc()], "place").select("change_id", "place")


@query(_RUNS + """SELECT w.run_id, CASE WHEN eligible_count > 0 THEN CAST(coalesce(attempted, 0) AS DOUBLE) / eligible_count END AS completeness FROM (SELECT DISTINCT run_id, eligible_count FROM watch_runs) w LEFT JOIN g ON g.run_id = w.run_id""")
def run_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Attempted of eligible sources per run; null where nothing was eligible."""
    w = table(spark, d, "watch_runs", "run_id", "eligible_count").distinct()
    j = w.join(runs.receipts(_attempts(spark, d)), "run_id", "left")
    return j.select("run_id", F.try_divide(F.coalesce("attempted", F.lit(0)).cast("double"), F.col("eligible_count")).alias("completeness"))


@query(f"WITH {_DEDUP} SELECT run_id, CASE WHEN NOT coalesce(ok, false) THEN 'not-retrieved' WHEN extraction_outcome = 'no-text' THEN 'no-text' ELSE 'measured' END AS outcome, count(*) AS n, min(source_id) AS first_source, max(source_id) AS last_source FROM a GROUP BY ALL")
def run_outcome_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sets of sources by outcome of each run: their sizes and ends; the sets themselves stay rows."""
    outcome = F.when(~F.coalesce("ok", F.lit(False)), "not-retrieved").when(F.col("extraction_outcome") == "no-text", "no-text").otherwise("measured")
    return _attempts(spark, d).groupBy("run_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first_source"), F.max("source_id").alias("last_source"))


@query("SELECT run_id, source_id, attempted_at FROM (SELECT DISTINCT run_id, source_id, attempted_at, completed_at FROM fetch_attempts) WHERE completed_at IS NULL")
def open_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts begun and never completed."""
    return table(spark, d, "fetch_attempts", "run_id", "source_id", "attempted_at", "completed_at").distinct().filter(F.col("completed_at").isNull()).drop("completed_at")


@query("SELECT source_id, strftime(try_cast(checked.at AS DATE) + 180, '%Y-%m-%d') AS recheck_on FROM sources WHERE checked.at IS NOT NULL")
def recheck_dates(spark: SparkSession, d: str) -> DataFrame:
    """180 days after the decision, not after today."""
    s = table(spark, d, "sources", "source_id", "checked").filter(F.col("checked.at").isNotNull())
    return s.select("source_id", F.date_format(F.date_add(T.strict_date(F.col("checked.at")), 180), "yyyy-MM-dd").alias("recheck_on"))


@query("SELECT strftime(date_trunc('week', attempted_at), '%Y-%m-%d') AS week_start, jurisdiction, count(*) AS n_attempts, count(*) FILTER (ok) AS n_ok FROM (SELECT DISTINCT run_id, source_id, attempted_at, ok FROM fetch_attempts) a JOIN (SELECT DISTINCT source_id, jurisdiction FROM sources) s USING (source_id) GROUP BY GROUPING SETS ((strftime(date_trunc('week', attempted_at), '%Y-%m-%d'), jurisdiction), (strftime(date_trunc('week', attempted_at), '%Y-%m-%d')))")
def weekly_availability(spark: SparkSession, d: str) -> DataFrame:
    """Attempts and successes per week, by jurisdiction and over all (null)."""
    a = table(spark, d, "fetch_attempts", "run_id", "source_id", "attempted_at", "ok").distinct().join(table(spark, d, "sources", "source_id", "jurisdiction").distinct(), "source_id")
    a = a.withColumn("week_start", F.date_format(F.date_trunc("week", F.col("attempted_at").cast("timestamp")), "yyyy-MM-dd"))
    return a.groupingSets([["week_start", "jurisdiction"], ["week_start"]], "week_start", "jurisdiction").agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if("ok").alias("n_ok"))
