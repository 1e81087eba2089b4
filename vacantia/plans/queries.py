"""Queries over the driver's tables, and DuckDB SQL for the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import policy as P
from vacantia.functions import text as X
from vacantia.functions import vocabulary as V
from vacantia.functions.simhash import fnv1a64, hamming, simhash
from vacantia.operators import dedupe, feed, identity, ingest, profiles, queue, search, stats, textindex
from vacantia.plans.mapping import NOW, TODAY, VIEWS, ctes, pick, table, view
from vacantia.sources import boards
from vacantia.sources.scratch import cut, folder
from vacantia.sources.store import TableStore
from vacantia.streaming import keyed, polls, stages

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def now():
    return F.expr(NOW)


def _stamps(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _s(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name.split('.')[-1]}"


# ---- serving

_FEED = """SELECT o.id, o.company_id, c.display_name AS company_name, o.role_family, o.work_mode, {seen}, coalesce(n.k, 0) AS source_count, n.apply_url
FROM opportunity o JOIN company c ON c.id = o.company_id
LEFT JOIN (SELECT opportunity_id, count(*) AS k, arg_min(apply_url, (created_at, source_row_id, apply_url)) FILTER (WHERE apply_url IS NOT NULL) AS apply_url FROM opportunity_source GROUP BY 1) n ON n.opportunity_id = o.id
WHERE o.pipeline_state = 'ready' AND o.closed_at IS NULL AND o.merged_into IS NULL {more}
ORDER BY o.first_seen_at DESC, o.id DESC LIMIT {n}"""
_BASE = ctes("opportunity", "company", "opportunity_source")


def _feed_sql(n: int = 25, more: str = "") -> str:
    return f"{_BASE} {_FEED.format(seen=_s('o.first_seen_at'), more=more, n=n)}"


def _corpus(spark, d):
    return view(spark, d, "opportunity"), view(spark, d, "company"), view(spark, d, "opportunity_source")


def _feed_columns(df):
    return _stamps(df, "first_seen_at").select("id", "company_id", "company_name", "role_family", "work_mode", "first_seen_at", "source_count", "apply_url")


@query(_feed_sql())
def feed_page(spark, d):
    return _feed_columns(feed.page(*_corpus(spark, d)))


@query(_feed_sql(40, "AND (o.first_seen_at, o.id) < (TIMESTAMP '2000-06-01 00:00:00', 5000)"))
def feed_page_after(spark, d):
    return _feed_columns(feed.page(*_corpus(spark, d), {"page_size": 40}, after=feed_after))


feed_after = (__import__("datetime").datetime(2000, 6, 1), 5000)


@query(_feed_sql(100, "AND o.work_mode = 'remote' AND o.role_family = '1-URGENT' AND (o.location_country = 'NATION_1' OR o.remote_geo_scope LIKE '%NATION_1%')"))
def feed_filtered(spark, d):
    return _feed_columns(feed.page(*_corpus(spark, d), {"work_mode": "remote", "role_family": "1-URGENT", "country": "NATION_1", "page_size": 500}))


_MEDIAN = "SELECT company_id, CAST(round_even(quantile_cont(epoch_us(closed_at) / 8.64e10 - epoch_us(first_seen_at) / 8.64e10, 0.5), 0) AS INT) AS median_days FROM opportunity WHERE closed_at IS NOT NULL AND merged_into IS NULL GROUP BY 1"
_SIMILAR = "SELECT company_id, role_family, count(*) AS open_similar FROM opportunity WHERE pipeline_state = 'ready' AND closed_at IS NULL AND merged_into IS NULL GROUP BY 1, 2"


@query(f"{ctes('opportunity')} {_MEDIAN}")
def company_median_close(spark, d):
    return feed.median_days_to_close(view(spark, d, "opportunity"))


@query(f"{ctes('opportunity')} {_SIMILAR}")
def open_similar_roles(spark, d):
    return feed.open_similar_roles(view(spark, d, "opportunity"))


@query(f"""{_BASE} SELECT o.id, c.display_name AS company_name, {_s('o.first_seen_at')}, coalesce(n.k, 0) AS source_count, n.apply_url,
  coalesce(m.median_days, 0) AS median_days, coalesce(s.open_similar, 0) AS open_similar,
  CASE WHEN salary_min_minor IS NULL AND salary_max_minor IS NULL THEN NULL ELSE coalesce(salary_min_minor, 0) END AS salary_min, salary_max_minor AS salary_max
FROM opportunity o JOIN company c ON c.id = o.company_id
LEFT JOIN (SELECT opportunity_id, count(*) AS k, arg_min(apply_url, (created_at, source_row_id, apply_url)) FILTER (WHERE apply_url IS NOT NULL) AS apply_url FROM opportunity_source GROUP BY 1) n ON n.opportunity_id = o.id
LEFT JOIN ({_MEDIAN}) m ON m.company_id = o.company_id LEFT JOIN ({_SIMILAR}) s ON s.company_id = o.company_id AND s.role_family = o.role_family
WHERE o.merged_into IS NULL""")
def opportunity_detail(spark, d):
    found = _stamps(feed.detail(*_corpus(spark, d)), "first_seen_at")
    pay = feed.salary()
    return found.select("id", "company_name", "first_seen_at", "source_count", "apply_url", "median_days", "open_similar", pay["min_minor"].alias("salary_min"), pay["max_minor"].alias("salary_max"))


@query(f"""{_BASE} SELECT o.id, CAST(to_json({{'id': o.id, 'company': {{'id': o.company_id, 'name': c.display_name}}, 'location': {{'country': o.location_country, 'geo_scope': CASE WHEN remote_geo_scope IS NULL THEN [] ELSE string_split(remote_geo_scope, ',') END}},
  'salary': CASE WHEN salary_min_minor IS NULL AND salary_max_minor IS NULL THEN NULL ELSE {{'min_minor': coalesce(salary_min_minor, 0), 'max_minor': salary_max_minor, 'currency': salary_currency}} END}}) AS VARCHAR) AS json
FROM opportunity o JOIN company c ON c.id = o.company_id""")
def opportunity_json(spark, d):
    o, c = view(spark, d, "opportunity"), view(spark, d, "company")
    return feed.as_json(o.join(c.select(F.col("id").alias("company_id"), F.col("display_name").alias("company_name")), "company_id"))


_RISK = f"""SELECT id, days_open, CASE WHEN score >= 3 THEN 'high' WHEN score >= 1 THEN 'elevated' ELSE 'normal' END AS band, CAST(score AS INT) AS score, reasons FROM (
SELECT o.id, d AS days_open,
  (CASE WHEN repost_count >= 4 THEN 3 WHEN repost_count >= 2 THEN 1 ELSE 0 END)
  + (CASE WHEN md > 0 AND d >= 6 * md THEN 2 WHEN md > 0 AND d >= 3 * md THEN 1 WHEN md <= 0 AND d >= 120 THEN 2 WHEN md <= 0 AND d >= 60 THEN 1 ELSE 0 END)
  + (CASE WHEN salary_min_minor IS NULL THEN 1 ELSE 0 END) AS score,
  array_to_string(list_filter([
    CASE WHEN repost_count >= 4 THEN 'repeated_refresh' WHEN repost_count >= 2 THEN 'refreshed' END,
    CASE WHEN md > 0 AND d >= 6 * md THEN 'open_far_longer_than_usual' WHEN md > 0 AND d >= 3 * md THEN 'open_longer_than_usual' WHEN md <= 0 AND d >= 120 THEN 'open_a_long_time' WHEN md <= 0 AND d >= 60 THEN 'open_a_while' END,
    CASE WHEN salary_min_minor IS NULL THEN 'no_apply_route' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT opportunity.*, coalesce(m.median_days, 0) AS md, CAST(greatest(0, floor(epoch({NOW} - first_seen_at) / 86400)) AS INT) AS d FROM opportunity LEFT JOIN ({_MEDIAN}) m USING (company_id)) o)"""


def _risk(spark, d):
    o = view(spark, d, "opportunity")
    days = P.days_open(F.col("first_seen_at"), now())
    rows = o.join(feed.median_days_to_close(o), "company_id", "left")
    return rows.withColumn("days_open", days).withColumn("risk", P.ghost_risk(F.col("days_open"), F.col("repost_count"), F.col("salary_min_minor").isNotNull(), F.col("median_days")))


@query(f"{ctes('opportunity')}, r AS ({_RISK}) SELECT band, count(*) AS n, sum(score)::BIGINT AS score FROM r GROUP BY band")
def ghost_risk_bands(spark, d):
    return _risk(spark, d).groupBy("risk.band").agg(F.count(F.lit(1)).alias("n"), F.sum("risk.score").alias("score"))


@query(f"{ctes('opportunity')} {_RISK}")
def ghost_risk_reasons(spark, d):
    codes = F.array_join(F.transform("risk.reasons", lambda r: r["code"]), ",")
    return _risk(spark, d).select("id", "days_open", "risk.band", "risk.score", codes.alias("reasons"))


# ---- dashboards


@query(f"{ctes('opportunity')} SELECT pipeline_state, count(*) AS n, strftime(min(state_entered_at), '%Y-%m-%d %H:%M:%S') AS oldest FROM opportunity WHERE merged_into IS NULL GROUP BY 1")
def pipeline_stats(spark, d):
    return _stamps(stats.pipeline_stats(view(spark, d, "opportunity")), "oldest")


@query(f"{ctes('opportunity')} SELECT normalization_version, count(*) AS total, count(role_family) AS with_family, count(seniority_ordinal) AS with_seniority, count(location_country) AS with_country, count(*) FILTER (WHERE is_management) AS management FROM opportunity WHERE merged_into IS NULL GROUP BY 1")
def normalization_stats(spark, d):
    return stats.normalization_stats(view(spark, d, "opportunity"))


@query(f"{ctes('opportunity')} SELECT block_key, count(*) AS members FROM opportunity WHERE block_key IS NOT NULL AND merged_into IS NULL AND closed_at IS NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 200")
def multi_member_blocks(spark, d):
    return stats.multi_member_blocks(view(spark, d, "opportunity"))


@query(f"{ctes('opportunity', 'opportunity_source')} SELECT source_id, count(DISTINCT opportunity_id) AS live FROM opportunity_source JOIN opportunity ON id = opportunity_id WHERE closed_at IS NULL GROUP BY 1")
def live_for_source(spark, d):
    return stats.live_per_source(view(spark, d, "opportunity"), view(spark, d, "opportunity_source"))


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in stats.COUNTERS)
_DAILY = f"daily AS (SELECT source_id, day, {_SUMS} FROM poll GROUP BY 1, 2)"
_BASELINE = f"SELECT source_id, {_SUMS} FROM daily WHERE day >= {TODAY} - 7 AND day < {TODAY} GROUP BY 1"


def _daily(spark, d):
    return stats.daily_health(view(spark, d, "poll"))


def _today():
    return F.expr(TODAY)


@query(f"{ctes('poll')}, {_DAILY} SELECT source_id, strftime(day, '%Y-%m-%d') AS day, {', '.join(stats.COUNTERS)} FROM daily")
def daily_source_health(spark, d):
    return _daily(spark, d).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"{ctes('poll')} SELECT source_id, strftime(day, '%Y-%m-%d') AS day, {_SUMS} FROM poll GROUP BY source_id, day")
def daily_health_upsert(spark, d):
    polls = view(spark, d, "poll")
    stored = stats.daily_health(polls.filter("evaluation_id % 2 = 0"))
    return stats.add_daily_health(stored, polls.filter("evaluation_id % 2 = 1")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"{ctes('poll')}, {_DAILY} {_BASELINE}")
def health_baseline_7d(spark, d):
    return stats.baseline(_daily(spark, d), _today())


@query(f"""{ctes('poll')}, {_DAILY} SELECT source_id, strftime(day, '%Y-%m-%d') AS day, usable,
  CAST(coalesce(sum(postings) OVER w, 0) AS BIGINT) AS base_postings, CAST(coalesce(sum(usable) OVER w, 0) AS BIGINT) AS base_usable
FROM daily WINDOW w AS (PARTITION BY source_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def health_trailing_baseline(spark, d):
    return stats.trailing_baseline(_daily(spark, d)).select("source_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "usable", "base_postings", "base_usable")


_REPORT = f"""SELECT s_suppkey AS source_id, s_name AS name, {', '.join(f'coalesce(t.{c}, 0) AS today_{c}, coalesce(b.{c}, 0) AS base_{c}' for c in stats.COUNTERS)}
FROM supplier LEFT JOIN (SELECT * FROM daily WHERE day = {TODAY}) t ON t.source_id = s_suppkey LEFT JOIN ({_BASELINE}) b ON b.source_id = s_suppkey"""


def _report(spark, d):
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return stats.health_report(sources, _daily(spark, d), _today())


@query(f"{ctes('poll')}, {_DAILY} {_REPORT}")
def health_report(spark, d):
    return _report(spark, d)


def _verdict_sql() -> str:
    def r(side: str, c: str) -> str:
        return f"(CASE WHEN {side}_postings = 0 THEN 0.0::DOUBLE ELSE {side}_{c}::DOUBLE / {side}_postings::DOUBLE END)"

    reasons = [f"CASE WHEN {r('base', 'usable')} > 0 AND ({r('base', 'usable')} - {r('today', 'usable')}) / {r('base', 'usable')} >= 0.10::DOUBLE THEN 'yield_drop' END"]
    for c in V.ALERTING_FIELDS:
        reasons.append(f"CASE WHEN {r('base', c)} >= 0.30::DOUBLE AND ({r('base', c)} - {r('today', c)}) / nullif({r('base', c)}, 0) >= 0.20::DOUBLE THEN 'field_fill_drop:{c}' END")
    return f"""{ctes('poll')}, {_DAILY}, r AS ({_REPORT}), v AS (
SELECT source_id, today_postings < 20 OR base_postings < 20 AS few, array_to_string(list_filter([{', '.join(reasons)}], lambda x: x IS NOT NULL), ',') AS found FROM r)
SELECT source_id, CASE WHEN few THEN 'unknown' WHEN found = '' THEN 'healthy' ELSE 'degraded' END AS status, CASE WHEN few THEN 'insufficient_sample' ELSE found END AS reasons FROM v"""


@query(_verdict_sql())
def health_verdict(spark, d):
    v = P.health_verdict(lambda c: F.col(f"today_{c}"), lambda c: F.col(f"base_{c}"))
    code = F.array_join(F.transform("v.reasons", lambda r: F.concat_ws(":", r["code"], F.nullif(r["field"], F.lit("")))), ",")
    return _report(spark, d).withColumn("v", v).select("source_id", "v.status", code.alias("reasons"))


@query(f"""{ctes('poll')}, g AS (SELECT *, sum(CASE WHEN status = 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY polled_at, evaluation_id) AS run FROM poll)
SELECT source_id, evaluation_id, status, CAST(sum(CASE WHEN status = 'degraded' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, run ORDER BY polled_at, evaluation_id) AS BIGINT) AS consecutive FROM g""")
def consecutive_degraded(spark, d):
    return stats.runs_of_degraded(view(spark, d, "poll")).select("source_id", "evaluation_id", "status", "consecutive")


# ---- ingest

_SEEN = "seen AS (SELECT DISTINCT source_id, source_job_id FROM opportunity_source WHERE source_row_id % 5 <> 0)"


@query(f"""{ctes('opportunity', 'opportunity_source')}, {_SEEN}
SELECT DISTINCT o.id FROM opportunity o JOIN opportunity_source s ON s.opportunity_id = o.id WHERE o.closed_at IS NULL AND s.source_id IN (SELECT source_id FROM seen)
AND NOT EXISTS (SELECT 1 FROM opportunity_source x JOIN seen USING (source_id, source_job_id) WHERE x.opportunity_id = o.id AND x.source_id = s.source_id)""")
def absent_postings(spark, d):
    sources = view(spark, d, "opportunity_source")
    return ingest.absent(view(spark, d, "opportunity"), sources, sources.filter("source_row_id % 5 <> 0"))


def _classified(spark, d):
    sources = view(spark, d, "opportunity_source")
    known = sources.filter("source_row_id % 4 <> 0")
    polled = sources.withColumn("content_hash", F.when(F.col("source_row_id") % 6 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return ingest.classify(polled.select("source_id", "source_job_id", "content_hash"), known)


@query(f"""{ctes('opportunity_source')} SELECT DISTINCT source_id, source_job_id, CASE WHEN source_row_id % 4 = 0 THEN 'created' WHEN source_row_id % 6 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM opportunity_source""")
def poll_classify(spark, d):
    return _classified(spark, d).select("source_id", "source_job_id", "outcome")


@query(f"""{ctes('opportunity_source')}, c AS (SELECT DISTINCT source_id, source_job_id, CASE WHEN source_row_id % 4 = 0 THEN 'created' WHEN source_row_id % 6 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM opportunity_source)
SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged FROM c GROUP BY 1""")
def poll_fold(spark, d):
    known = _classified(spark, d).withColumns({c: F.lit("x") for c in ("company", "location", "apply_url", "language")})
    return stats.fold_poll(known).select("source_id", "fetched", "created", "updated", "unchanged")


@query(f"""{ctes('opportunity_source')}, s AS (SELECT DISTINCT source_id, source_job_id, source_row_id, opportunity_id FROM opportunity_source),
k AS (SELECT DISTINCT opportunity_id AS o FROM s WHERE source_row_id % 4 <> 0),
n AS (SELECT *, opportunity_id IN (SELECT o FROM k) AS known, row_number() OVER (PARTITION BY opportunity_id ORDER BY source_id, source_job_id) AS i FROM s WHERE source_row_id % 4 = 0)
SELECT source_id, source_job_id, CASE WHEN source_row_id % 6 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome, opportunity_id FROM s WHERE source_row_id % 4 <> 0
UNION ALL SELECT source_id, source_job_id, CASE WHEN known OR i > 1 THEN 'linked' ELSE 'created' END, CASE WHEN known THEN opportunity_id END FROM n""")
def poll_link(spark, d):
    """Jobs that are new to their source but known by the board's own identity."""
    board = view(spark, d, "opportunity_source").withColumns({"ats_type": F.lit("board"), "ats_job_id": F.col("opportunity_id").cast("string")})
    known = board.filter("source_row_id % 4 <> 0")
    polled = board.withColumn("content_hash", F.when(F.col("source_row_id") % 6 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return ingest.classify(polled.select("source_id", "source_job_id", "content_hash", "ats_type", "ats_job_id"), known).select("source_id", "source_job_id", "outcome", "opportunity_id")


# two polls of the same jobs: in the first one of three rows of a job is new to its source and linked by the board's identity
_LINE = "SELECT l_orderkey AS o, l_suppkey AS source_id, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS job, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2, 3"
_POLLED = "o % 9 <> 0"
_TWICE = f"""{ctes('opportunity')}, line AS ({_LINE}),
first AS (SELECT o, bool_or(k % 3 <> 0 AND o % 5 = 0 AND k = 1) AS changed, count(*) FILTER (WHERE k % 3 <> 0 AND NOT (o % 5 = 0 AND k = 1)) AS same, bool_or(k % 3 <> 0) AS seen FROM line WHERE {_POLLED} GROUP BY 1),
second AS (SELECT o, bool_or(o % 7 = 0 AND k % 2 = 1) AS changed, count(*) FILTER (WHERE NOT (o % 7 = 0 AND k % 2 = 1)) AS same, bool_or(o % 7 = 0 AND k = 1) AS first_line FROM line WHERE {_POLLED} GROUP BY 1),
line_sources AS (SELECT DISTINCT source_id FROM line WHERE {_POLLED}),
away AS (SELECT DISTINCT o FROM line WHERE NOT ({_POLLED}) AND source_id IN (SELECT source_id FROM line_sources) AND k % 3 <> 0),
e AS (SELECT opportunity.*, coalesce(f.changed, false) AS c1, coalesce(f.same, 0) AS s1, coalesce(f.seen, false) AS n1, coalesce(s.changed, false) AS c2, coalesce(s.same, 0) AS s2, s.o IS NOT NULL AS n2, a.o IS NOT NULL AS gone
  FROM opportunity LEFT JOIN first f ON f.o = id LEFT JOIN second s ON s.o = id AND f.seen LEFT JOIN away a ON a.o = id),
t AS (SELECT *, {NOW} + INTERVAL 1 DAY AS t1, {NOW} + INTERVAL 2 DAY AS t2 FROM e),
made AS (SELECT o, arg_min(sha256(concat(source_id, chr(0), job)), (source_id, job)) AS id FROM line WHERE {_POLLED} AND o NOT IN (SELECT o FROM first WHERE seen) GROUP BY 1)
SELECT CAST(id AS VARCHAR) AS id, company_id, role_family, work_mode, CAST(merged_into AS VARCHAR) AS merged_into,
  CASE WHEN c2 THEN 'title 2' WHEN c1 THEN 'title 1' ELSE title_raw END AS title_raw,
  version + CAST(c1 AS INT) + CAST(c2 AS INT) AS version,
  CASE WHEN c1 OR c2 THEN 'parsed' ELSE pipeline_state END AS pipeline_state,
  CASE WHEN c1 OR c2 THEN 0 ELSE attempts END AS attempts,
  {{next}} AS next_attempt_at, {{entered}} AS state_entered_at, {{seen}} AS last_seen_at, {{closed}} AS closed_at,
  CASE WHEN n1 OR n2 THEN NULL WHEN gone AND closed_at IS NULL THEN 'absent' ELSE NULL END AS close_reason,
  CASE WHEN n1 OR n2 THEN 0 WHEN gone AND closed_at IS NULL THEN 2 ELSE 0 END AS consecutive_misses,
  repost_count + CASE WHEN c1 THEN 0 ELSE s1 END + CASE WHEN c2 THEN 0 ELSE s2 END AS repost_count
FROM t
UNION ALL SELECT made.id, 0, NULL, NULL, NULL, CASE WHEN changed THEN 'title 2' ELSE 'title 1' END, 1 + CAST(changed AS INT), 'parsed', 0,
  CASE WHEN changed THEN '2001-09-03 00:00:00' ELSE '2001-09-02 00:00:00' END, '2001-09-02 00:00:00', '2001-09-03 00:00:00', NULL, NULL, 0, CASE WHEN changed THEN 0 ELSE same END FROM made JOIN second USING (o)"""


def _when(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


@query(_TWICE.format(
    next=_when("CASE WHEN c2 THEN t2 WHEN c1 THEN t1 ELSE next_attempt_at END"),
    entered=_when("CASE WHEN c1 AND pipeline_state <> 'parsed' THEN t1 WHEN c2 AND NOT c1 AND pipeline_state <> 'parsed' THEN t2 ELSE state_entered_at END"),
    seen=_when("CASE WHEN n2 THEN t2 WHEN n1 THEN t1 ELSE first_seen_at END"),
    closed=_when("CASE WHEN n1 OR n2 THEN NULL WHEN gone AND closed_at IS NULL THEN t2 ELSE closed_at END"),
))
def poll_reconcile(spark, d):
    """Two polls in a row over linked sources; one job of nine has gone from its boards."""
    first, second = (F.expr(f"{NOW} + INTERVAL {k} DAY") for k in (1, 2))
    opps = view(spark, d, "opportunity").withColumns({
        "id": F.col("id").cast("string"), "merged_into": F.col("merged_into").cast("string"), "last_seen_at": F.col("first_seen_at"), "consecutive_misses": F.lit(0), "close_reason": F.lit(None).cast("string"), "source_reported_posted_at": now(),
        "source_posted_at_at_last_change": now(), "title_normalized": F.lit(""), "liveness_checked_at": now(),
    })
    # a job that occurs twice is the same one to a poll
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("source_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("source_job_id"), F.col("l_linenumber").alias("k"))
    line = line.withColumns({"ats_type": F.lit("board"), "ats_job_id": F.col("o").cast("string"), "content_hash": F.lit("h"), "company_id": F.lit(0).cast("long")})
    known = line.filter("k % 3 <> 0").withColumns({"opportunity_id": F.col("o").cast("string"), "source_row_id": F.col("source_job_id"), "last_seen_at": now(), "created_at": now()}).drop("o", "k")

    def polled(turn: int, changed: str, at) -> DataFrame:
        hit, before = F.expr(changed), F.when(F.expr("o % 5 = 0 AND k = 1"), "h1").otherwise("h") if turn == 2 else F.lit("h")
        return line.filter(_POLLED).withColumns({"title_raw": F.lit(f"title {turn}"), "content_hash": F.when(hit, f"h{turn}").otherwise(before), "source_reported_posted_at": at}).drop("o", "k")

    sources = cut(line.filter(_POLLED).select("source_id").distinct().withColumn("status", F.lit("ok")), "polled")
    for turn, changed, at in ((1, "o % 5 = 0 AND k = 1 AND k % 3 <> 0", first), (2, "o % 7 = 0 AND k % 2 = 1", second)):
        out = ingest.poll(opps, known, polled(turn, changed, at), sources, at)
        opps = cut(out["opportunity"], "opportunity", "zstd") if turn == 1 else out["opportunity"]
        # what the second poll reads
        known = out["opportunity_source"].select("source_id", "source_job_id", "opportunity_id", "content_hash", *ingest.BOARD)
    shown = opps.select("id", "company_id", "role_family", "work_mode", "merged_into", "title_raw", "version", "pipeline_state", "attempts", "next_attempt_at", "state_entered_at", "last_seen_at", "closed_at", "close_reason", "consecutive_misses", "repost_count")
    return _stamps(shown, "next_attempt_at", "state_entered_at", "last_seen_at", "closed_at")


@query("""WITH raw AS (SELECT l_suppkey AS s, date_trunc('month', l_shipdate) AS m, l_partkey % 25 AS j, l_returnflag AS h, CASE WHEN l_quantity > 25 THEN l_shipdate END AS c FROM lineitem),
poll AS (SELECT s, m, row_number() OVER (PARTITION BY s ORDER BY m) AS k FROM (SELECT DISTINCT s, m FROM raw)),
top AS (SELECT s, m, j, max(h) AS h FROM raw GROUP BY 1, 2, 3),
seen AS (SELECT s, j, m, k, h, max(c) AS c FROM top JOIN raw USING (s, m, j, h) JOIN poll USING (s, m) GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT *, lag(k) OVER w AS pk, lag(h) OVER w AS ph FROM seen WINDOW w AS (PARTITION BY s, j ORDER BY k)),
r AS (SELECT *, sum(CASE WHEN ph IS NULL OR ph <> h THEN 1 ELSE 0 END) OVER (PARTITION BY s, j ORDER BY k) AS v FROM g),
b AS (SELECT *, first_value(c) OVER (PARTITION BY s, j, v ORDER BY k) AS base FROM r),
o AS (SELECT s, j, arg_max(h, k) AS content_hash, max(v) AS version, count(*) FILTER (WHERE c > base) AS refreshes, max(k) AS k, min(m) AS first_seen, max(m) AS last_seen, count(*) FILTER (WHERE k - pk > 2) AS reopened FROM b GROUP BY 1, 2),
n AS (SELECT s, max(k) AS n FROM poll GROUP BY 1)
SELECT CAST(o.s AS VARCHAR) AS source_id, CAST(j AS VARCHAR) AS source_job_id, content_hash, CAST(version AS INT) AS version, refreshes, least(n - o.k, 2) AS misses,
  reopened + CASE WHEN n - o.k >= 2 THEN 1 ELSE 0 END AS closures, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen_at, strftime(p.m, '%Y-%m-%d %H:%M:%S') AS closed_at
FROM o JOIN n USING (s) LEFT JOIN poll p ON p.s = o.s AND p.k = o.k + 2""")
def job_lifecycle_stream(spark, d):
    """Suppliers polled each month they ship in, as a stream with one state entry for each job."""
    line = _stream(spark, d, "lineitem").withColumn("polled_at", F.date_trunc("month", "l_shipdate"))
    source = F.col("l_suppkey").alias("source_id")
    shown = line.select(source, "polled_at", (F.col("l_partkey") % 25).cast("string").alias("source_job_id"), F.col("l_returnflag").alias("content_hash"), F.when(F.col("l_quantity") > 25, F.col("l_shipdate")).alias("claim"))
    changes = _worked_off(spark, keyed.job_lifecycles(line.select(source, "polled_at"), shown, 4), "update")
    found = keyed.present(changes).select("source_id", "source_job_id", "content_hash", "version", "refreshes", "misses", "closures", "first_seen_at", "last_seen_at", "closed_at")
    return _stamps(found, "first_seen_at", "last_seen_at", "closed_at")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, CASE WHEN event_type IN ('signup', 'view') THEN 'enter' WHEN event_type = 'error' THEN 'done' ELSE 'claim' END AS event,
  CASE event_type WHEN 'signup' THEN 'parsed' WHEN 'view' THEN 'deduped' WHEN 'error' THEN 'ready' END AS state FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event, state NULLS LAST) AS n FROM e),
c AS (SELECT *, lead(ts) OVER w AS next_ts, count(*) FILTER (WHERE event <> 'claim') OVER w AS stay, date_trunc('millisecond', max(ts) OVER ()) AS clock FROM o WINDOW w AS (PARTITION BY id ORDER BY n)),
stays AS (SELECT id, stay, ts, event, state, clock, lead(ts) OVER (PARTITION BY id ORDER BY n) AS until FROM c WHERE event <> 'claim'),
leases AS (SELECT c.id, c.stay, c.ts, c.ts + INTERVAL 2 DAY AS due, c.next_ts, s.state, c.clock FROM c JOIN stays s ON s.id = c.id AND s.stay = c.stay AND s.event = 'enter' WHERE c.event = 'claim'),
sweeps AS (SELECT id, stay, state, unnest(generate_series(ts + INTERVAL 1 DAY, least(coalesce(until - INTERVAL 1 MICROSECOND, clock), clock), INTERVAL 3 DAY)) AS due_at FROM stays WHERE event = 'enter'),
due AS (SELECT id, due AS due_at, 'lease_expired' AS what, state FROM leases WHERE due < coalesce(next_ts, clock + INTERVAL 1 MICROSECOND) AND due <= clock
  UNION ALL SELECT id, due_at, 'swept', state FROM sweeps s WHERE NOT EXISTS (SELECT 1 FROM leases l WHERE l.id = s.id AND l.stay = s.stay AND l.ts <= s.due_at AND l.due > s.due_at))
SELECT id, what, state, strftime(due_at, '%Y-%m-%d %H:%M:%S.%f') AS due_at FROM due""")
def queue_deadlines_stream(spark, d):
    """Expired leases and stranded rows of a stream of queue events, by timers; the clock is the stream's own."""
    kind = F.col("event_type")
    event = F.when(kind.isin("signup", "view"), "enter").when(kind == "error", "done").otherwise("claim")
    state = F.when(kind == "signup", "parsed").when(kind == "view", "deduped").when(kind == "error", "ready")
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("id"), "ts", event.alias("event"), state.alias("state"))
    found = _worked_off(spark, keyed.deadlines(rows, 2 * 86400, 86400, 3 * 86400), "append")
    return found.select("id", "what", "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("due_at"))


def _stream(spark, d: str, name: str) -> DataFrame:
    """A table as a stream; a path with a pattern may be a single file."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _worked_off(spark, stream: DataFrame, mode: str) -> DataFrame:
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    return keyed.run_to_table(stream, f"{at}/out", f"{at}/checkpoint", mode)


@query(f"""SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey ELSE 'old' END AS cursor, {_s("CASE WHEN s_suppkey % 3 = 0 THEN " + NOW + " + to_seconds(600 + s_suppkey) ELSE " + NOW + " END").rsplit(" AS ", 1)[0]} AS next_run_at, s_suppkey % 3 <> 0 AS leased FROM supplier""")
def save_cursors(spark, d):
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") + 600).alias("poll_interval_s"))
    schedules = sources.select("source_id", F.lit("old").alias("cursor"), now().alias("last_run_at"), now().alias("lease_until"), now().alias("next_run_at"))
    polled = sources.filter("source_id % 3 = 0").select("source_id", F.concat(F.lit("c"), "source_id").alias("cursor"))
    done = ingest.save_cursors(schedules, sources, polled, now())
    return _stamps(done, "next_run_at").select("source_id", "cursor", "next_run_at", F.col("lease_until").isNotNull().alias("leased"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 5 AS c, CASE WHEN s_suppkey % 7 = 0 THEN 'paused' ELSE 'active' END AS st, ['degraded', 'healthy', 'unknown'][s_suppkey % 3 + 1] AS v FROM supplier)
SELECT id AS source_id, CASE v WHEN 'degraded' THEN c + 1 WHEN 'healthy' THEN 0 ELSE c END AS consecutive_degraded,
CASE WHEN v = 'degraded' AND c + 1 >= 3 AND st = 'active' THEN 'quarantined' ELSE st END AS status,
CASE WHEN v = 'degraded' THEN 'low' WHEN v = 'healthy' AND c <> 0 THEN NULL ELSE 'before' END AS last_health_note FROM s""")
def mark_health(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("source_id"), (k % 5).alias("consecutive_degraded"), F.when(k % 7 == 0, "paused").otherwise("active").alias("status"), F.lit("before").alias("last_health_note"))
    verdicts = rows.select("source_id", F.when(F.col("source_id") % 3 == 0, "degraded").when(F.col("source_id") % 3 == 1, "healthy").otherwise("unknown").alias("status"), F.lit("low").alias("note"))
    return ingest.mark_health(rows, verdicts).select("source_id", "consecutive_degraded", "status", "last_health_note")


@query("""SELECT lower(c_name) AS canonical_domain, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS display_name FROM customer""")
def company_upsert(spark, d):
    c = table(spark, d, "customer")
    stored = c.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("canonical_domain"), F.col("c_name").alias("display_name"))
    new = c.filter("c_custkey % 3 < 2").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_domain"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).otherwise("").alias("display_name"))
    return ingest.upsert_companies(stored, new).select("canonical_domain", "display_name")


# ---- queue


@query(f"{ctes('opportunity')} SELECT id FROM opportunity WHERE pipeline_state = 'parsed' AND merged_into IS NULL AND next_attempt_at <= {NOW} AND (lease_until IS NULL OR lease_until < {NOW}) ORDER BY next_attempt_at, id LIMIT 50")
def claim_batch(spark, d):
    return queue.claimable(view(spark, d, "opportunity"), "parsed", 50, now())


@query(f"{ctes('opportunity')} SELECT id, pipeline_state, attempts, {_s('state_entered_at')} FROM opportunity WHERE pipeline_state NOT IN ('ready', 'failed_permanent') AND merged_into IS NULL AND (lease_until IS NULL OR lease_until < {NOW}) AND state_entered_at < {NOW} - INTERVAL 30 MINUTE ORDER BY swept_at NULLS FIRST, opportunity.state_entered_at, id LIMIT 100")
def sweep_stranded(spark, d):
    return _stamps(queue.stranded(view(spark, d, "opportunity"), 100, now()), "state_entered_at")


@query(f"""{ctes('opportunity')} SELECT id, CASE WHEN attempts >= 5 AND pipeline_state = 'enriched' THEN 'embedded' WHEN attempts >= 5 THEN 'failed_permanent' ELSE pipeline_state END AS pipeline_state,
CASE WHEN attempts >= 5 AND pipeline_state = 'enriched' THEN 0 ELSE attempts END AS attempts,
CASE WHEN attempts >= 5 AND pipeline_state = 'enriched' THEN 0 ELSE CAST(least(30 * pow(2, greatest(attempts, 1) - 1), 3600) AS BIGINT) END AS wait
FROM opportunity WHERE id % 3 = 0 AND pipeline_state <> 'ready'
UNION ALL SELECT id, pipeline_state, attempts, NULL FROM opportunity WHERE id % 3 <> 0 AND pipeline_state <> 'ready'""")
def fail_attempt(spark, d):
    rows = view(spark, d, "opportunity").filter("pipeline_state <> 'ready'")
    hit = rows.filter("id % 3 = 0").select("id", F.lit("boom").alias("error"))
    # every row: those that no attempt failed for stay as they are
    wait = F.when(F.col("id") % 3 == 0, ((F.unix_micros("next_attempt_at") - F.unix_micros(now())) / 1000000).cast("long"))
    return queue.fail(rows, hit, now()).select("id", "pipeline_state", "attempts", wait.alias("wait"))


@query(f"""{ctes('opportunity')} SELECT id, CASE WHEN id % 2 = 0 THEN CASE pipeline_state WHEN 'parsed' THEN 'normalized' WHEN 'enriched' THEN 'embedded' END ELSE pipeline_state END AS pipeline_state,
CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS version FROM opportunity WHERE pipeline_state <> 'ready'""")
def advance_state(spark, d):
    rows = view(spark, d, "opportunity").filter("pipeline_state <> 'ready'")
    done = rows.select("id", (F.col("version") + F.col("id") % 2).cast("int").alias("version"), F.col("pipeline_state").alias("state"))
    return queue.advance(rows, done, now())[0].select("id", "pipeline_state", "version")


# ---- text


def _rule_sql(p: str, rules: list, quote: bool = False) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({p}, {chr(39)}{n}{chr(39)})' for n in needles)} THEN {repr(v) if quote else v}" for v, needles in rules)
    return f"CASE {cases} END"


def _norm_sql(c: str) -> str:
    return f"trim(regexp_replace(translate({c}, chr(160) || chr(9) || chr(10) || chr(13) || '—–', '    --'), '\\s+', ' ', 'g'))"


_TITLED = f"t AS (SELECT p_partkey AS id, concat({pick(['Senior Backend Engineer', 'Staff  Data Engineer', 'Tech Lead, Payments', 'Contractor', 'VP Sales', 'Machine Learning Intern', 'ML engineer / SRE', 'Graduate QA tester', ''], 'p_partkey')}, ' — ', p_name) AS title FROM part)"


@query(f"""WITH {_TITLED}, n AS (SELECT id, {_norm_sql('lower(title)')} AS normalized FROM t), p AS (SELECT *, ' ' || normalized || ' ' AS p FROM n)
SELECT id, normalized, {_rule_sql('p', V.ROLE_FAMILY_RULES, True)} AS role_family, CAST({_rule_sql('p', V.SENIORITY_RULES)} AS SMALLINT) AS seniority, {' OR '.join(f"contains(p, '{n}')" for n in V.MANAGEMENT_NEEDLES)} AS is_management FROM p""")
def title_parse(spark, d):
    case, _, rest = _TITLED.removeprefix("t AS (SELECT p_partkey AS id, ").rpartition(" AS title FROM ")
    titles = table(spark, d, "part").selectExpr("p_partkey AS id", f"{case} AS title")
    return titles.withColumn("t", X.parse_title(F.col("title"))).select("id", "t.*")


def _location_sql() -> str:
    names = [(n, code) for code, ns in V.COUNTRIES.items() for n in ns]
    prefix = f"'^(?:{'|'.join(V.MODE_PREFIXES)})'"
    strip = f"trim(trim(CASE WHEN regexp_matches(trim(x), {prefix}) THEN trim(trim(trim(regexp_replace(trim(x), {prefix}, '')), '-–—:()/,')) ELSE trim(x) END, '-–—()'))"
    listed = ", ".join(f"'{n}'" for n, _ in names)
    codes = ", ".join(f"'{c}'" for _, c in names)
    return f"""{ctes('company')}, s AS (SELECT id, {_norm_sql('lower(location)')} AS s FROM company),
f AS (SELECT id, s, list_filter(list_transform(regexp_split_to_array(s, '[,;|/]'), lambda x: {strip}), lambda x: x <> '') AS f FROM s),
g AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(f, lambda x: list_contains([{listed}], x)), lambda x: [{codes}][list_position([{listed}], x)]))) AS scope, list_filter(f, lambda x: NOT list_contains([{listed}], x))[1] AS place FROM f),
h AS (SELECT *, CASE WHEN len(scope) = 1 THEN scope[1] END AS country,
  CASE WHEN place NOT IN ({', '.join(f"'{n}'" for n in V.NOT_PLACES)}) AND strlen(place) >= 2 THEN array_to_string(list_transform(string_split(place, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS city,
  CASE WHEN contains(s, 'hybrid') THEN 'hybrid' WHEN {' OR '.join(f"contains(s, '{n}')" for n in V.REMOTE_HINTS)} THEN 'remote' END AS said FROM g),
m AS (SELECT *, coalesce(said, CASE WHEN country IS NOT NULL OR city IS NOT NULL THEN 'onsite' END) AS work_mode FROM h)
SELECT id, work_mode, country, city, CASE WHEN work_mode IS NULL THEN NULL ELSE nullif(array_to_string(scope, ','), '') END AS geo_scope FROM m"""


@query(_location_sql())
def location_parse(spark, d):
    rows = view(spark, d, "company").withColumn("l", X.parse_location(F.col("location")))
    return rows.select("id", "l.work_mode", "l.country", "l.city", X.join_scope(F.col("l.geo_scope")).alias("geo_scope"))


def _strip_sql(c: str) -> str:
    """A walk over the pieces between brackets, with the depth."""
    pieces = f"list_transform(regexp_extract_all({c}, '[<>]|[^<>]+'), lambda p: {{'d': 0, 'o': p}})"
    depth = "CASE b.o WHEN '<' THEN a.d + 1 WHEN '>' THEN greatest(a.d - 1, 0) ELSE a.d END"
    out = "CASE WHEN b.o = '>' AND a.d > 0 THEN a.o || ' ' WHEN b.o NOT IN ('<', '>') AND a.d = 0 THEN a.o || b.o ELSE a.o END"
    return f"list_reduce(list_prepend({{'d': 0, 'o': ''}}, {pieces}), lambda a, b: {{'d': {depth}, 'o': {out}}}).o"


def _tokens_sql(c: str) -> str:
    return f"regexp_extract_all({_strip_sql(f'lower({c})')}, '[a-z0-9+#]+')"


@query(f"SELECT page_id, sha256({_strip_sql('html')}) AS stripped, CAST(length({_strip_sql('html')}) AS INT) AS n_chars FROM pages")
def strip_tags_pages(spark, d):
    s = X.strip_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(s, 256).alias("stripped"), F.length(s).alias("n_chars"))


@query(f"SELECT doc_id, CAST(len({_tokens_sql('text')}) AS INT) AS n, sha256(array_to_string({_tokens_sql('text')}, ' ')) AS tokens FROM documents")
def tokenize(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


_GRAMS = """CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END"""


@query(f"WITH t AS (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents) SELECT doc_id, CAST(len({_GRAMS}) AS INT) AS n, sha256(array_to_string({_GRAMS}, '|')) AS grams FROM t")
def shingles(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.shingles(F.col("text")).alias("g"))
    return t.select("doc_id", F.size("g").alias("n"), F.sha2(F.array_join("g", "|"), 256).alias("grams"))


_FNV = "list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END AS BIGINT)"


@query(f"WITH w AS (SELECT c_custkey, {_FNV.format('c_name')} AS h FROM customer) SELECT c_custkey, {_SIGNED.format('h')} AS fnv FROM w")
def fnv1a(spark, d):
    return table(spark, d, "customer").select("c_custkey", fnv1a64(F.col("c_name")).alias("fnv"))


def _simhash_sql(rows: str) -> str:
    """CTEs that end in sig(id, simhash); ``rows`` has id and body."""
    return f"""t AS (SELECT id, {_tokens_sql('body')} AS t FROM ({rows})), g AS (SELECT id, unnest({_GRAMS}) AS s FROM t),
hs AS (SELECT s, {_FNV.format('s')} AS h FROM (SELECT DISTINCT s FROM g)),
v AS (SELECT id, b, count(*) AS n, sum(CAST((h >> b) & 1 AS BIGINT)) AS ones FROM g JOIN hs USING (s), range(64) AS r(b) GROUP BY 1, 2),
u AS (SELECT id, sum(CASE WHEN 2 * ones > n THEN (1::HUGEINT << CAST(b AS INT)) ELSE 0::HUGEINT END)::HUGEINT AS h FROM v GROUP BY 1),
sig AS (SELECT t.id, coalesce({_SIGNED.format('h')}, 0) AS simhash FROM t LEFT JOIN u USING (id))"""


@query(f"WITH {_simhash_sql('SELECT doc_id AS id, text AS body FROM documents')} SELECT id AS doc_id, simhash FROM sig")
def simhash64(spark, d):
    return table(spark, d, "documents").select("doc_id", simhash(X.tokenize(F.col("text"))).alias("simhash"))


_STOPS = ", ".join(f"'{w}'" for w in V.STOP_WORDS)


def _kept_sql(t: str) -> str:
    kept = f"list_filter({t}, lambda x: x NOT IN ({_STOPS}) AND length(x) > 1)"
    return f"CASE WHEN len({kept}) = 0 THEN {t} ELSE {kept} END"


_BLOCKED = f"b AS (SELECT *, {_kept_sql(_tokens_sql('title'))} AS tt FROM posting), k AS (SELECT *, company_id || '|' || array_to_string(list_sort(tt)[1:3], '-') || '|' || upper(coalesce(country, '')) AS block_key FROM b)"


@query(f"{ctes('posting')}, {_BLOCKED} SELECT id, block_key FROM k")
def block_keys(spark, d):
    return view(spark, d, "posting").select("id", X.block_key(F.col("company_id"), F.col("title"), F.col("country")).alias("block_key"))


def _members(spark, d):
    return dedupe.block_members(dedupe.candidates_from(view(spark, d, "posting")))


_CANDIDATES = f"{ctes('posting')}, {_simhash_sql('''SELECT id, concat_ws(' ', title, body) AS body FROM posting''')}, {_BLOCKED}, c AS (SELECT k.*, simhash, sha256(coalesce(body, '')) AS h, length(coalesce(body, '')) AS n FROM k JOIN sig USING (id))"
_PAIRED = f"""{_CANDIDATES}, pr AS (SELECT a.id AS a_id, b.id AS b_id, bit_count(xor(a.simhash, b.simhash)) AS distance, a.h = b.h AS equal, a.simhash <> 0 AND b.simhash <> 0 AS signed,
  len(a.tt) >= 3 AND len(b.tt) >= 3 AND CASE WHEN len(b.tt) < len(a.tt) THEN list_has_all(a.tt, b.tt) ELSE list_has_all(b.tt, a.tt) END AS titles, a.n >= 400 AND b.n >= 400 AS long
  FROM c a JOIN c b ON a.block_key = b.block_key AND (a.first_seen_at, a.id) < (b.first_seen_at, b.id)),
dec AS (SELECT *, CASE WHEN equal THEN 'content_hash' WHEN signed AND titles AND (distance = 0 OR (distance <= 9 AND long)) THEN 'simhash' ELSE '' END AS reason FROM pr)"""


@query(f"{_PAIRED} SELECT a_id, b_id, CAST(distance AS INT) AS distance FROM dec")
def hamming_pairs(spark, d):
    p = dedupe.pairs(_members(spark, d))
    return p.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), hamming(F.col("a.simhash"), F.col("b.simhash")).cast("int").alias("distance"))


@query(f"{_PAIRED} SELECT a_id, b_id, reason, round(CASE reason WHEN 'content_hash' THEN 0.99 WHEN 'simhash' THEN 0.90 - distance * 0.05 ELSE 0.0 END, 4)::DOUBLE AS confidence, reason = 'content_hash' OR (reason = 'simhash' AND distance <= 3) AS auto FROM dec")
def dedupe_decide(spark, d):
    v = F.col("verdict")
    found = dedupe.pairs(_members(spark, d)).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "verdict")  # no other column of a pair is made
    confidence = F.when(v["same"], F.round(v["confidence"].cast("double"), 4)).otherwise(0.0)  # rounding costs more than all else
    return found.select("a_id", "b_id", v["reason"].alias("reason"), confidence.alias("confidence"), P.auto_apply(v).alias("auto"))


@query(f"{_PAIRED} SELECT b_id AS left_id, a_id AS right_id, reason, printf('confidence %.2f below auto-merge floor 0.75', 0.90 - distance * 0.05) AS withheld_because FROM dec WHERE reason = 'simhash' AND distance > 3")
def review_queue(spark, d):
    return dedupe.review_queue(dedupe.similar_pairs(_members(spark, d))).drop("confidence")


#: The walk along each block, oldest first: a member leads unless an earlier leader takes it in. ``edge`` holds the sure pairs, ``mem`` the members.
_WALKED = """nb AS (SELECT mem.block_key, mem.ord, list(e.a_ord) FILTER (WHERE e.a_ord IS NOT NULL) AS earlier FROM mem LEFT JOIN edge e ON e.b_id = mem.id GROUP BY 1, 2),
walk AS (SELECT block_key, 0::BIGINT AS ord, []::BIGINT[] AS lead FROM mem WHERE ord = 1
  UNION ALL SELECT nb.block_key, nb.ord, CASE WHEN list_has_any(walk.lead, coalesce(nb.earlier, [])) THEN walk.lead ELSE list_append(walk.lead, nb.ord) END FROM walk JOIN nb ON nb.block_key = walk.block_key AND nb.ord = walk.ord + 1),
done AS (SELECT block_key, arg_max(lead, ord) AS lead FROM walk GROUP BY 1),
gone AS (SELECT done.block_key, b_id, arg_min(a_id, a_ord) AS a_id, arg_min(reason, a_ord) AS reason, arg_min(confidence, a_ord) AS confidence FROM edge JOIN done USING (block_key)
  WHERE list_contains(lead, a_ord) AND NOT list_contains(lead, b_ord) GROUP BY 1, 2)"""
_SURE = """mem AS (SELECT id, block_key, row_number() OVER (PARTITION BY block_key ORDER BY first_seen_at, id) AS ord FROM c),
edge AS (SELECT a.block_key, a_id, b_id, a.ord AS a_ord, b.ord AS b_ord, reason, CASE reason WHEN 'content_hash' THEN 0.99 ELSE 0.90 - distance * 0.05 END AS confidence FROM dec JOIN mem a ON a.id = a_id JOIN mem b ON b.id = b_id WHERE reason = 'content_hash' OR (reason = 'simhash' AND distance <= 3))"""


def _walked(paired: str) -> str:
    return f"WITH RECURSIVE {paired.removeprefix('WITH ')}, {_SURE}, {_WALKED}"


@query(f"{_walked(_PAIRED)} SELECT block_key, b_id AS from_id, a_id AS into_id, reason, round(confidence, 4)::DOUBLE AS confidence FROM gone")
def leader_clusters(spark, d):
    return dedupe.clusters(_members(spark, d)).withColumn("confidence", F.round(F.col("confidence").cast("double"), 4))


_LIVES = "CASE lang WHEN 'de' THEN 'Berlin, Germany' WHEN 'fr' THEN 'Paris, France' ELSE 'Remote, Canada' END"
_IN = "CASE country WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' ELSE 'CA' END"
_STAGED = _walked(_PAIRED.replace(_BLOCKED, _BLOCKED.replace("FROM posting)", "FROM posting WHERE id % 7 <> 0)").replace("upper(coalesce(country, ''))", _IN)))


@query(f"""{_STAGED} SELECT p.id, CASE WHEN p.id % 7 = 0 THEN 'parsed' WHEN g.b_id IS NULL THEN 'deduped' ELSE 'normalized' END AS pipeline_state, CASE WHEN p.id % 7 = 0 THEN 1 ELSE 3 END AS version, g.a_id AS merged_into, g.reason AS merge_reason,
  CASE WHEN g.b_id IS NOT NULL THEN 0 ELSE 1 + p.id % 2 + coalesce(t.n, 0) END AS n_sources, k.block_key
FROM posting p LEFT JOIN k ON k.id = p.id LEFT JOIN gone g ON g.b_id = p.id LEFT JOIN (SELECT a_id, sum(1 + b_id % 2) AS n FROM gone GROUP BY 1) t ON t.a_id = p.id""")
def stored_stages(spark, d):
    """Stored postings through normalisation, block by block search and sweep; one of seven isn't due yet."""
    store = TableStore(spark, f"{folder(spark)}/stages-{uuid.uuid4().hex}")
    store.commit(_stage_tables(spark, d))
    for step in (stages.normalize_due, stages.dedupe_due, stages.sweep_blocks):
        step(store, now())
    count = store.read("opportunity_source").groupBy(F.col("opportunity_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    why = store.read("opportunity_merge").select(F.col("from_id").alias("id"), F.col("reason").alias("merge_reason"))
    found = store.read("opportunity").join(count, "id", "left").join(why, "id", "left")
    return found.select("id", "pipeline_state", "version", "merged_into", "merge_reason", F.coalesce("n", F.lit(0)).alias("n_sources"), "block_key")


def _stage_tables(spark, d) -> dict[str, DataFrame]:
    """The documents as parsed postings with their texts apart, those of odd number seen through two sources."""
    none = {"remote_geo_scope": "string", "location_country": "string", "location_city": "string", "work_mode": "string", "role_family": "string", "seniority_ordinal": "int", "is_management": "boolean", "title_normalized": "string",
            "simhash": "long", "text_len": "int", "block_key": "string", "normalization_version": "int", "closed_at": "timestamp", "merged_into": "long", "lease_until": "timestamp", "last_error": "string"}
    posting = view(spark, d, "posting").withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {
        "title_raw": F.col("title"), "location_region": F.expr(_LIVES.replace("lang", "country")), "pipeline_state": F.lit("parsed"), "state_entered_at": now(),
        "next_attempt_at": F.when(F.col("id") % 7 == 0, F.expr(f"{NOW} + INTERVAL 1 DAY")).otherwise(now()), "attempts": F.lit(0), "version": F.lit(1),
    }).drop("title", "body", "country")
    seen = posting.select(F.col("id").alias("opportunity_id"), F.explode(F.expr("sequence(0, CAST(id % 2 AS INT))")).alias("k"))
    seen = seen.select("opportunity_id", F.concat_ws("-", "opportunity_id", "k").alias("source_row_id"), F.lit(None).cast("string").alias("apply_url"), F.lit(None).cast("string").alias("ats_type"), F.lit(None).cast("string").alias("ats_job_id"), now().alias("created_at"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description_text"))
    return {"opportunity": posting, "opportunity_source": seen, "opportunity_text": texts}


@query(f"""{_PAIRED}, j AS (SELECT reason <> '' AS p, equal AS t FROM dec) SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn,
CASE WHEN count(*) FILTER (WHERE p) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE p AND t) / count(*) FILTER (WHERE p) END::DOUBLE AS precision, CASE WHEN count(*) FILTER (WHERE t) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE p AND t) / count(*) FILTER (WHERE t) END::DOUBLE AS recall FROM j""")
def dedupe_eval(spark, d):
    judged = dedupe.pairs(_members(spark, d)).select(F.col("verdict.same").alias("predicted"), (F.col("a.content_hash") == F.col("b.content_hash")).alias("truth"))
    return stats.precision_recall(judged)


@query("SELECT doc_id, sha256(encode(coalesce(source, '')) || '\\x00'::BLOB || encode(coalesce(text, '')) || '\\x00'::BLOB || encode(coalesce(lang, '')) || '\\x00'::BLOB) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("source"), F.col("text"), F.col("lang")).alias("content_hash"))


@query(r"SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '[\n\r\t ]+', ' ', 'g'))) AS cleaned FROM conversations")
def clean_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.clean_text(F.col("text")), 256).alias("cleaned"))


@query("""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(url)), '^https://', ''), '^http://', ''), '(?s)[?#].*$', ''), '/$', '') AS u FROM pages) SELECT page_id, CASE WHEN contains(u, '/') THEN u END AS url FROM u""")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.element_at(X.json_map(F.col("props")), "k").cast("int").alias("k"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_custkey::VARCHAR, '.fam.ats.invalid') ELSE lower(c_name) || '.example' END AS domain FROM customer""")
def company_domains(spark, d):
    from vacantia.sources.boards import company_domain

    c = table(spark, d, "customer")
    given = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" "), "c_name", F.lit(".example")))
    return c.select("c_custkey", company_domain(given, F.concat(F.lit("fam:"), F.col("c_custkey").cast("string"))).alias("domain"))


# ---- identity and profiles

_SESSIONS = "s AS (SELECT event_id AS id, user_id, sha256(event_id::VARCHAR) AS token_hash, CASE WHEN event_id % 7 = 0 THEN ts END AS revoked_at, ts + INTERVAL 10 DAY AS expires_at FROM events)"


def _sessions(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"), F.expr("CASE WHEN event_id % 7 = 0 THEN CAST(ts AS TIMESTAMP) END").alias("revoked_at"), F.expr("CAST(ts AS TIMESTAMP) + INTERVAL 10 DAY").alias("expires_at"))


@query(f"WITH {_SESSIONS} SELECT user_id, count(*) AS live FROM s WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def live_sessions(spark, d):
    return identity.live_sessions(_sessions(spark, d), F.expr("TIMESTAMP '2024-01-20 00:00:00'")).groupBy("user_id").agg(F.count(F.lit(1)).alias("live"))


@query("""SELECT o_orderkey AS token, CASE WHEN o_orderkey % 5 = 0 THEN 'replayed' WHEN o_orderkey % 7 = 0 OR o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' THEN 'invalid' ELSE 'ok' END AS kind FROM orders""")
def refresh_replay(spark, d):
    o = table(spark, d, "orders")
    t = o.select(F.col("o_orderkey").cast("string").alias("token_hash"), F.col("o_custkey").alias("family_id"), F.col("o_custkey").alias("user_id"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END").alias("used_at"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END").alias("revoked_at"), F.expr("CAST(o_orderdate AS TIMESTAMP)").alias("expires_at"))
    found = identity.classify_refresh(t.select("token_hash"), t, F.expr("TIMESTAMP '1998-01-01 00:00:00'"))
    return found.select(F.col("token_hash").cast("long").alias("token"), "kind")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 12 + 1 AS INT) ELSE CAST(c_custkey % 12 AS INT) END AS failed_logins, c_custkey % 3 = 1 AND c_custkey % 12 + 1 >= 10 AS locked FROM customer""")
def login_lockout(spark, d):
    none = F.lit(None).cast("timestamp")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 12).cast("int").alias("failed_logins"), none.alias("locked_until"), none.alias("last_login_at"))
    attempts = users.filter("id % 3 < 2").select("id", (F.col("id") % 3 == 0).alias("ok"))
    return identity.login_results(users, attempts, now()).select("id", "failed_logins", F.col("locked_until").isNotNull().alias("locked"))


@query("""WITH k AS (SELECT c_custkey AS id, lower(c_name) || '@x.example' AS email FROM customer WHERE c_custkey % 3 = 0),
a AS (SELECT o_orderkey AS o, trim(CASE WHEN o_orderkey % 50 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN ' ' || upper(c_name) || '@X.example' ELSE c_name || '@x.example ' END) AS email FROM orders JOIN customer ON c_custkey = o_custkey),
j AS (SELECT lower(email) AS key, min(email) AS email, arg_min(o, (email, o)) AS o, count(*) AS n, lower(email) = '' OR lower(email) IN (SELECT email FROM k) AS taken FROM a GROUP BY 1, 5)
SELECT email, CASE WHEN taken THEN NULL ELSE 'individual' END AS kind, CASE WHEN taken THEN NULL ELSE o END AS first, n - CAST(NOT taken AS BIGINT) AS refused FROM j""")
def register_accounts(spark, d):
    """Requests for accounts, many of them for the same address or a known one."""
    c = table(spark, d, "customer")
    users = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit("t").alias("tenant_id"), F.concat(F.lower("c_name"), F.lit("@x.example")).alias("email"), F.lit("").alias("password_hash"))
    tenants = users.select(F.col("tenant_id").alias("id"), F.lit("organisation").alias("kind"), F.lit("").alias("display_name"), F.col("id").alias("owner_id")).limit(0)
    mail = F.expr("CASE WHEN o_orderkey % 50 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN concat(' ', upper(c_name), '@X.example') ELSE concat(c_name, '@x.example ') END")
    asked = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(mail.alias("email"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("password_hash"))
    got = identity.register(users, tenants, asked, now())
    made = got["app_user"].filter("tenant_id <> 't'").select("email", "id", F.col("password_hash").try_cast("long").alias("first"))
    made = made.join(got["tenant"].select(F.col("owner_id").alias("id"), "kind"), "id").drop("id")
    both = made.join(got["refused"].select("email", F.col("n").alias("refused")), "email", "full")
    return both.select("email", "kind", "first", F.coalesce("refused", F.lit(0)).alias("refused"))


@query(f"""WITH {_SESSIONS} SELECT id, CASE WHEN id % 3 = 0 AND revoked_at IS NULL AND expires_at > TIMESTAMP '2024-01-20 00:00:00' THEN '2024-01-20 00:00:00' END AS last_seen_at,
  strftime(CASE WHEN revoked_at IS NULL AND user_id % 10 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE revoked_at END, '%Y-%m-%d %H:%M:%S') AS revoked_at FROM s""")
def session_activity(spark, d):
    """A third of the sessions' tokens is presented, then every session of a tenth of the users is revoked."""
    at = F.expr("TIMESTAMP '2024-01-20 00:00:00'")
    sessions = _sessions(spark, d).withColumn("last_seen_at", F.lit(None).cast("timestamp"))
    presented = sessions.filter("id % 3 = 0").select(F.col("id").cast("string").alias("token"))
    touched = identity.touch_sessions(sessions, identity.authenticate(presented, sessions, at), at)
    ended = identity.revoke_all_sessions(touched, touched.filter("user_id % 10 = 0").select("user_id"), at)
    return _stamps(ended, "last_seen_at", "revoked_at").select("id", "last_seen_at", "revoked_at")


@query("""SELECT o_custkey AS user_id, count(*) FILTER (WHERE o_orderkey % 3 > 0) + CAST(count(*) FILTER (WHERE o_orderkey % 3 = 1) = 0 AS INT) AS requests, count(*) FILTER (WHERE o_orderkey % 3 = 2 AND o_custkey % 4 <> 0) AS completed,
  CAST(count(*) FILTER (WHERE o_orderkey % 3 = 2) AS INT) AS steps, count(*) FILTER (WHERE o_orderkey % 3 = 2 AND o_custkey % 4 = 0) AS failed FROM orders GROUP BY 1""")
def erasure_progress(spark, d):
    """Users that ask for erasure again and again: an open request is enough; of a repeated step the last word counts."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_custkey").alias("user_id"), "o_orderkey")
    at, none = F.expr("TIMESTAMP '2024-01-20 00:00:00'"), F.lit(None).cast("timestamp")
    old = o.filter("o_orderkey % 3 > 0").select("request_id", "user_id", now().alias("requested_at"), F.when(F.col("o_orderkey") % 3 == 2, now()).alias("completed_at"))
    step = o.filter("o_orderkey % 3 = 2").select("request_id", F.lit("profile").alias("location"), F.lit("failed").alias("status"), F.lit(1).alias("items"), F.lit(None).cast("string").alias("detail"))
    again = step.join(o.filter("user_id % 4 <> 0").select("request_id"), "request_id", "left_semi").withColumns({"status": F.lit("done"), "items": F.lit(2)})
    steps = profiles.record_steps(step.withColumn("completed_at", now()), again, at)
    requests = profiles.request_erasures(old, o.select("user_id"), at)
    closed = profiles.complete_requests(requests.join(steps.select("request_id").distinct(), "request_id", "left_semi").withColumn("completed_at", none), steps, at)
    of_user = closed.select("request_id", "user_id", F.col("completed_at").alias("done_at")).join(steps.select("request_id", "status"), "request_id")
    told = of_user.groupBy("user_id").agg(F.count("done_at").alias("completed"), F.count(F.lit(1)).cast("int").alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"))
    count = requests.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return count.join(told, "user_id", "left").select("user_id", "requests", zero("completed"), zero("steps"), zero("failed"))


def _entries(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("id"), F.col("role").alias("action"), F.lit("s").alias("subject"), F.coalesce("text", F.lit("")).alias("metadata"))


def _audit(spark, d):
    return identity.link_chain(_entries(spark, d))


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
  unhex(lpad(hex(strlen(role)), 16, '0')) || encode(role) || unhex(lpad(hex(1), 16, '0')) || encode('s') || unhex(lpad(hex(strlen(coalesce(text, ''))), 16, '0')) || encode(coalesce(text, '')) AS framed FROM conversations),
c AS (SELECT conv_id, k, turn, '' AS prev_hash, sha256(framed) AS entry_hash FROM e WHERE k = 1
  UNION ALL SELECT e.conv_id, e.k, e.turn, c.entry_hash, sha256(unhex(c.entry_hash) || e.framed) FROM c JOIN e ON e.conv_id = c.conv_id AND e.k = c.k + 1)
SELECT conv_id AS chain_id, turn AS id, prev_hash, entry_hash FROM c""")
def audit_chain(spark, d):
    return _audit(spark, d).select("chain_id", "id", "prev_hash", "entry_hash")


@query("SELECT DISTINCT conv_id AS chain_id, CASE WHEN conv_id % 5 = 0 THEN coalesce((SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn >= 1), 0) ELSE 0 END AS first_bad FROM conversations c")
def audit_verify(spark, d):
    chain = _audit(spark, d)
    forged = chain.withColumn("metadata", F.when((F.col("chain_id") % 5 == 0) & (F.col("id") >= 1), F.lit("forged")).otherwise(F.col("metadata")))
    return identity.verify_chain(forged)


def _user_tables(spark, d):
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    return {
        "app_user": table(spark, d, "customer").select(F.col("c_custkey").alias("id")),
        "profile": o.select(F.col("o_custkey").alias("user_id")),
        "user_session": e.select("user_id"),
    }


@query("""WITH u AS (SELECT c_custkey AS user_id FROM customer)
SELECT user_id, 1 + (SELECT count(*) FROM orders WHERE o_custkey = user_id) + (SELECT count(*) FROM events e WHERE e.user_id = u.user_id) AS traces FROM u""")
def user_traces(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return profiles.user_traces(_user_tables(spark, d), users)


@query("""WITH u AS (SELECT c_custkey AS user_id FROM customer)
SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 0 ELSE 1 + (SELECT count(*) FROM orders WHERE o_custkey = user_id) + (SELECT count(*) FROM events e WHERE e.user_id = u.user_id) END AS traces FROM u""")
def user_traces_after_erasure(spark, d):
    """All users after a tenth of them has been erased: nothing is left of these, the others keep everything."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return profiles.user_traces(profiles.erase(_user_tables(spark, d), users.filter("user_id % 10 = 0")), users)


@query("""SELECT o_orderkey AS request_id, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS complete FROM orders""")
def erasure_incomplete(spark, d):
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit(None).cast("timestamp").alias("completed_at"))
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("status"))
    return profiles.complete_requests(requests, steps, now()).select("request_id", F.col("completed_at").isNotNull().alias("complete"))


@query("""WITH p AS (SELECT o_custkey AS user_id, l_partkey AS skill_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT user_id, skill_id, CASE WHEN skill_id % 2 = 0 AND skill_id % 3 <> 0 AND user_id % 2 = 0 THEN 'parsed' WHEN skill_id % 3 = 0 OR user_id % 2 = 1 THEN 'manual' ELSE 'parsed' END AS origin,
CASE WHEN user_id % 2 = 1 THEN 2 WHEN skill_id % 2 = 0 THEN 1 END AS proficiency FROM p""")
def skill_upsert(spark, d):
    """Stored: even skills, every third manual. New: users with odd numbers claim by hand with a figure, the others are parsed without one."""
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("skill_id")).distinct()
    pairs = cut(pairs, "pairs")  # else the task that joins holds the distinct pairs of both sides besides
    manual = F.when(F.col("skill_id") % 3 == 0, "manual").otherwise("parsed")
    stored = pairs.filter("skill_id % 2 = 0").select("*", manual.alias("origin"), F.lit(1).alias("proficiency"), F.lit(1.0).alias("years"))
    odd = F.col("user_id") % 2 == 1
    new = pairs.select("*", F.when(odd, "manual").otherwise(F.when(F.col("skill_id") % 2 == 0, "parsed").otherwise(manual)).alias("origin"), F.when(odd, 2).alias("proficiency"), F.lit(None).cast("double").alias("years"))
    return profiles.put_skills(stored, new).select("user_id", "skill_id", "origin", "proficiency")


_REFRESHED = """WITH t AS (SELECT o_orderkey AS id, o_custkey AS family, CASE WHEN o_orderkey % 40 = 0 THEN 'replayed' WHEN o_orderkey % 7 = 0 THEN 'invalid' WHEN o_custkey % 13 = 0 THEN 'suspended' ELSE 'ok' END AS kind FROM orders),
p AS (SELECT *, id AS request_id FROM t UNION ALL SELECT *, id + 1000000000 FROM t WHERE id % 33 = 0),
r AS (SELECT family, min(request_id) FILTER (WHERE kind = 'replayed' OR (kind = 'ok' AND request_id > id)) AS first_replay FROM p GROUP BY 1),
j AS (SELECT p.family, id, request_id, CASE WHEN kind = 'ok' AND id > first_replay THEN 'invalid' WHEN kind = 'suspended' AND request_id > first_replay THEN 'invalid' WHEN kind = 'ok' AND request_id > id THEN 'replayed' ELSE kind END AS kind, p.kind AS stored, first_replay FROM p JOIN r ON p.family = r.family)"""


def _refreshed(spark, d):
    """Each order is a token of its customer's family, and all are presented at once, some twice; customers divisible by 13 are suspended."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    none, later, key = F.lit(None).cast("timestamp"), now() + F.expr("INTERVAL 1 DAY"), F.col("k").cast("string")
    secret = F.sha2(key, 256).alias("token_hash")
    tokens = o.select(
        key.alias("id"), F.col("c").cast("string").alias("family_id"), F.col("c").alias("user_id"), key.alias("session_id"), secret, F.when(F.col("k") % 40 == 0, now()).alias("used_at"),
        F.when(F.col("k") % 7 == 0, now()).alias("revoked_at"), F.lit(None).cast("string").alias("replaced_by"), later.alias("expires_at"),
    )
    sessions = o.select(key.alias("id"), F.col("c").alias("user_id"), secret, F.lit("agent").alias("user_agent"), none.alias("revoked_at"), later.alias("expires_at"))
    asked = o.select("k", F.col("k").alias("request_id")).unionByName(o.filter("k % 33 = 0").select("k", (F.col("k") + 1000000000).alias("request_id")))
    new = [F.sha2(F.concat(F.lit(kind), F.col("request_id").cast("string")), 256).alias(name) for kind, name in (("s", "session_hash"), ("r", "refresh_hash"))]
    presented = asked.select("request_id", secret, F.lit("agent").alias("user_agent"), *new)
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 13 == 0, "suspended").otherwise("active").alias("status"))
    return identity.rotate(sessions, tokens, presented, users, now())


@query(f"{_REFRESHED} SELECT request_id, kind FROM j")
def refresh_requests(spark, d):
    return _refreshed(spark, d)["judged"].select("request_id", "kind")


@query(f"""{_REFRESHED} SELECT family AS user_id, CAST(CASE WHEN first_replay IS NULL THEN count(*) FILTER (WHERE stored IN ('ok', 'suspended')) ELSE 0 END AS BIGINT) AS live_tokens,
CAST(CASE WHEN first_replay IS NULL THEN count(*) ELSE 0 END AS BIGINT) AS live_sessions, CAST(count(*) FILTER (WHERE kind = 'ok') AS BIGINT) AS rotated FROM j WHERE request_id = id GROUP BY family, first_replay""")
def refresh_rotation(spark, d):
    """What a user holds afterwards: a rotated token and its session are replaced, a replay leaves the family nothing."""
    found = _refreshed(spark, d)
    live = F.col("revoked_at").isNull() & (F.col("expires_at") > now())
    tokens = found["refresh_token"].groupBy("user_id").agg(F.count_if(live & F.col("used_at").isNull()).alias("live_tokens"), F.count("replaced_by").alias("rotated"))
    sessions = found["user_session"].groupBy("user_id").agg(F.count_if(live).alias("live_sessions"))
    return tokens.join(sessions, "user_id").select("user_id", "live_tokens", "live_sessions", "rotated")


@query("""WITH d AS (SELECT doc_id AS id, text, CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'Text/Markdown; charset=utf-8' WHEN 2 THEN 'application/pdf' ELSE 'image/png' END AS kind FROM documents WHERE coalesce(text, '') <> '')
SELECT id, 'users/' || id % 100 || '/resumes/' || id || CASE id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' ELSE '.pdf' END AS object_key, strlen(text) AS size_bytes, sha256(text) AS sha256,
CASE WHEN id % 4 < 2 THEN 'text_extracted' ELSE 'failed' END AS parse_state, id % 3 = 0 AND id % 5 <> 0 AS deleted FROM d WHERE id % 4 < 3 AND strlen(text) <= 10485760""")
def resume_lifecycle(spark, d):
    """Documents are uploaded as resumes of a hundred users; a third is then deleted, but requests by others than the owner do nothing."""
    docs = table(spark, d, "documents").filter("coalesce(text, '') <> ''")
    kind = F.when(F.col("doc_id") % 4 == 0, "text/plain").when(F.col("doc_id") % 4 == 1, "Text/Markdown; charset=utf-8").when(F.col("doc_id") % 4 == 2, "application/pdf").otherwise("image/png")
    uploads = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("user_id"), F.lit("cv").alias("filename"), kind.alias("content_type"), F.col("text").cast("binary").alias("body"))
    shape = "id long, user_id long, object_key string, text_object_key string, filename string, content_type string, size_bytes long, sha256 string, text_chars int, parse_state string, parse_error string, uploaded_at timestamp, deleted_at timestamp"
    kept = profiles.add_resumes(spark.createDataFrame([], shape), uploads, now())
    asked = uploads.filter("id % 3 = 0").select("id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("user_id")).alias("user_id"))
    return profiles.delete_resumes(kept, asked, now()).select("id", "object_key", "size_bytes", "sha256", "parse_state", F.col("deleted_at").isNotNull().alias("deleted"))


# ---- search


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, vec_id, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10""")
def knn_cosine(spark, d):
    """The ten nearest of every vector whose id is divisible by 50, among all others."""
    vectors = table(spark, d, "embeddings")
    return search.nearest_to_each(vectors, vectors.filter("vec_id % 50 = 0"), 10)


def _index(spark, d):
    vectors = table(spark, d, "embeddings")
    return search.VectorIndex.build(vectors, 16), vectors.filter("vec_id % 50 = 0")


@query()
def knn_ivf(spark, d):
    """The same search through an inverted file, thirteen of sixteen lists a query (the vectors hardly cluster); ``ivf_recall`` says what it finds."""
    index, asked = _index(spark, d)
    return index.nearest_to_each(asked, 10, 13)


@query("SELECT count(*) AS queries, true AS enough, true AS exact_with_all_lists FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark, d):
    """Whether the inverted file finds nine tenths of the ten nearest, and all of them when all lists are read."""
    index, asked = _index(spark, d)
    exact = cut(search.nearest_to_each(table(spark, d, "embeddings"), asked, 10), "exact")
    some = search.recall(index.nearest_to_each(asked, 10, 13), exact).select((F.col("recall") >= 0.9).alias("enough"))
    every = search.recall(index.nearest_to_each(asked, 10, 16), exact).select((F.col("recall") == 1).alias("exact_with_all_lists"))
    return exact.select("query_id").distinct().agg(F.count(F.lit(1)).alias("queries")).join(some, F.lit(True)).join(every, F.lit(True))


@query("""SELECT conv_id AS chain_id, count(*) AS entries, true AS sound FROM conversations GROUP BY 1""")
def audit_append(spark, d):
    """Chains that are appended to in three batches verify as one, and equal those linked at once."""
    entries = _entries(spark, d)
    stored = None
    for turn in range(3):
        some = entries.filter(F.col("id") == turn if turn < 2 else F.col("id") >= 2)
        new = cut(identity.link_chain(some, stored), "audit")
        stored = new if stored is None else stored.unionByName(new)
    whole = identity.link_chain(entries).select("chain_id", "id", F.col("entry_hash").alias("want"))
    sound = identity.verify_chain(stored).select("chain_id", (F.col("first_bad") == 0).alias("verified"))
    same = stored.join(whole, ["chain_id", "id"], "full").groupBy("chain_id").agg(F.count("entry_hash").alias("entries"), F.bool_and(F.col("entry_hash").eqNullSafe(F.col("want"))).alias("same"))
    return same.join(sound, "chain_id").select("chain_id", "entries", (F.col("same") & F.col("verified")).alias("sound"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct({_tokens_sql('text')}) AS t FROM documents) SELECT doc_id, CAST(list_contains(t, 'the')::INT + list_contains(t, 'of')::INT + list_contains(t, 'that')::INT AS INT) AS hits FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'of')""")
def keyword_search(spark, d):
    return search.keywords(table(spark, d, "documents").select("doc_id", "text"), must=["the", "of"], may=["that"]).select("doc_id", "hits")


_WRONG = {
    "state": ("id % 5 = 1", "pipeline_state", "'discoverd'"),
    "salary_currency": ("id % 5 = 2", "salary_currency", "CAST(NULL AS STRING)"),
    "close_reason": ("id % 5 = 3", "close_reason", "'absent'"),
    "merge_self": ("id % 5 = 4", "merged_into", "id"),
}


@query(f"""{ctes('opportunity')} SELECT 'state' AS rule, count(*) AS n FROM opportunity WHERE id % 5 = 1 HAVING n > 0
UNION ALL SELECT 'salary_range', count(*) AS n FROM opportunity WHERE salary_min_minor > salary_max_minor HAVING n > 0
UNION ALL SELECT 'salary_currency', count(*) AS n FROM opportunity WHERE id % 5 = 2 AND (salary_min_minor IS NOT NULL OR salary_max_minor IS NOT NULL) HAVING n > 0
UNION ALL SELECT 'close_reason', count(*) AS n FROM opportunity WHERE (id % 5 = 3 AND closed_at IS NULL) OR (id % 5 <> 3 AND id % 2 = 0 AND closed_at IS NOT NULL) HAVING n > 0
UNION ALL SELECT 'merge_self', count(*) AS n FROM opportunity WHERE id % 5 = 4 HAVING n > 0""")
def constraint_violations(spark, d):
    """Rows made wrong in different ways, each of which one rule must find and no other."""
    from vacantia.functions.constraints import violations

    rows = view(spark, d, "opportunity").withColumn("close_reason", F.when(F.col("closed_at").isNotNull() & (F.col("id") % 2 == 1), "absent"))
    for where, column, value in _WRONG.values():
        rows = rows.withColumn(column, F.when(F.expr(where), F.expr(value)).otherwise(F.col(column)))
    return violations(rows, "opportunity").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_NORMAL = "CASE WHEN id % 2 = 0 AND pipeline_state = 'parsed'"


@query(f"""{ctes('opportunity')} SELECT id, {_NORMAL} THEN 'normalized' ELSE pipeline_state END AS pipeline_state, {_NORMAL} THEN 2 ELSE 1 END AS version, {_NORMAL} THEN upper(title_raw) END AS title_normalized FROM opportunity""")
def apply_normalization(spark, d):
    """Half of the entries come too late: they hold an old version."""
    rows = view(spark, d, "opportunity").withColumn("title_normalized", F.lit(None).cast("string"))
    done = rows.filter("pipeline_state = 'parsed'").select("id", (F.col("version") + F.col("id") % 2).alias("version"), F.col("pipeline_state").alias("state"), F.upper("title_raw").alias("title_normalized"))
    return queue.apply_normalization(rows, done, now()).select("id", "pipeline_state", "version", "title_normalized")


# ---- full-text search by stems


def _among(words: str) -> str:
    return f"word IN ({', '.join(repr(x) for x in words.split())})"


def _stems_sql(words: str) -> str:
    """Places of each document at which a word of the list stands; the lists are the stems worked out beforehand."""
    return f"SELECT doc_id, count(*) AS n FROM w WHERE {_among(words)} GROUP BY 1"


#: Words of the documents with one stem each, worked out beforehand.
_ING, _RE, _ENE, _EST = "ere ered eredly eres ering eringly", "reed reeded reededly reedes reeding reedingly reedly reedlyed", "ened enedly enes ening eningly", "estion estioned estioner estiones estioning estionly"
_WORDS = f"t AS (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents), w AS (SELECT doc_id, unnest(t) AS word, unnest(generate_series(1, len(t))) AS place FROM t)"


@query(f"""WITH {_WORDS}, a AS ({_stems_sql(_ING)}), b AS ({_stems_sql(_RE)}), s AS (SELECT count(*) AS n, avg(len(t)) AS l FROM t WHERE len(t) > 0),
r AS (SELECT doc_id, n AS tf, (SELECT count(*) FROM a) AS df FROM a UNION ALL SELECT doc_id, n, (SELECT count(*) FROM b) FROM b),
p AS (SELECT doc_id, tf, ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / s.l)) AS part FROM r JOIN t USING (doc_id) CROSS JOIN s)
SELECT doc_id, CAST(sum(tf) AS BIGINT) AS hits, round(sum(part), 6) AS score FROM p WHERE doc_id IN (SELECT doc_id FROM a) GROUP BY 1""")
def text_search(spark, d):
    """Documents with a word of the stem of 'ering', ranked by it and by the stem of 'reed', from an index of all documents."""
    return _texts(spark, d).search(must=["Ering"], may=["reed", "the"]).withColumnRenamed("id", "doc_id")


@query(f"""WITH {_WORDS}, a AS (SELECT doc_id, place FROM w WHERE {_among(_ENE)}), b AS (SELECT doc_id, place FROM w WHERE {_among(_EST)})
SELECT doc_id, CAST(count(*) AS INT) AS n FROM a JOIN b USING (doc_id) WHERE b.place = a.place + 2 GROUP BY 1""")
def text_phrase(spark, d):
    """Documents in which a word of the stem of 'estion' stands two words after one of 'ened'."""
    return _texts(spark, d).phrase(["ened", "the", "estion"]).withColumnRenamed("id", "doc_id")


def _texts(spark, d):
    return textindex.TextIndex.build(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


# ---- lists, labels, files


@query(f"{ctes('opportunity', 'opportunity_source')} SELECT id, company_id, apply_url, ats_job_id FROM opportunity LEFT JOIN (SELECT opportunity_id, apply_url, source_job_id AS ats_job_id FROM opportunity_source QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY created_at, source_job_id) = 1) ON opportunity_id = id WHERE merged_into IS NULL AND closed_at IS NULL")
def candidate_sources(spark, d):
    """Open candidates with their oldest provenance row alone."""
    sources = view(spark, d, "opportunity_source").withColumns({"ats_type": F.lit("board"), "ats_job_id": F.col("source_job_id"), "source_row_id": F.col("source_job_id")})
    return dedupe.one_row_each(view(spark, d, "opportunity"), sources).select("id", "company_id", "apply_url", "ats_job_id")


@query(f"{ctes('opportunity')} SELECT block_key, count(*) AS members FROM opportunity WHERE block_key IS NOT NULL AND closed_at IS NULL GROUP BY 1 HAVING count(*) > 20")
def saturated_blocks(spark, d):
    return dedupe.saturated(view(spark, d, "opportunity").filter("block_key IS NOT NULL AND closed_at IS NULL"), 20)


@query(f"{ctes('opportunity')} SELECT id, lower(trim(regexp_replace(title_raw, '\\s+', ' ', 'g'))) AS title FROM opportunity")
def collapse_titles(spark, d):
    return view(spark, d, "opportunity").select("id", X.collapse_lower(F.col("title_raw")).alias("title"))


@query(f"{ctes('opportunity')} SELECT id, ['intern', 'junior', 'mid', 'senior', 'staff', 'principal'][seniority_ordinal] AS label, seniority_ordinal AS back FROM opportunity")
def seniority_labels(spark, d):
    label = X.seniority_label(F.col("seniority_ordinal"))
    return view(spark, d, "opportunity").select("id", label.alias("label"), X.seniority_level(label).alias("back"))


@query("SELECT user_id AS source_id, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'error') AS skipped, count(*) FILTER (WHERE event_id % 3 > 0) AS filled_company, (count(*) - count(*) FILTER (WHERE event_type = 'error')) / count(*) AS parse_yield FROM events GROUP BY 1")
def poll_yield(spark, d):
    """Parse yield and filled fields of polls whose postings are the events of a user."""
    filled = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "x").otherwise("y")
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.when(F.col("event_type") == "error", "skipped").otherwise("created").alias("outcome"), filled.alias("company"), *[F.lit("x").alias(c) for c in ("location", "apply_url", "language")])
    return stats.fold_poll(rows).select("source_id", "fetched", "skipped", "filled_company", "parse_yield")


@query(f"""SELECT c_custkey AS source_id, 'c' || c_custkey AS cursor FROM customer WHERE c_custkey % 4 > 0 AND {NOW} + to_hours(c_custkey % 9 - 4) <= {NOW} AND (c_custkey % 3 > 0 OR c_custkey % 2 = 0)
ORDER BY c_custkey % 9, c_custkey LIMIT 300""")
def due_sources(spark, d):
    """The next batch of active sources that are due and not leased."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    lease = F.when((k % 3 == 0) & (k % 2 == 0), F.expr(f"{NOW} - INTERVAL 1 HOUR")).when(k % 3 == 0, F.expr(f"{NOW} + INTERVAL 1 HOUR"))
    schedules = c.select(k.alias("source_id"), F.concat(F.lit("c"), k).alias("cursor"), (now() + F.make_dt_interval(hours=(k % 9 - 4).cast("int"))).alias("next_run_at"), lease.alias("lease_until"))
    sources = c.select(k.alias("source_id"), F.when(k % 4 == 0, "paused").otherwise("active").alias("status"))
    return queue.due_sources(schedules, sources, 300, now())


@query("SELECT DISTINCT l_suppkey AS user_id, l_partkey AS skill_id, p_name AS display_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def skills_of_users(spark, d):
    claims = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("skill_id")).distinct()
    return profiles.skills_of(claims, table(spark, d, "part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("display_name"))).select("user_id", "skill_id", "display_name")


@query(f"SELECT o_orderkey AS id, o_custkey AS user_id, {_s('o_orderdate').rsplit(' AS ', 1)[0]} AS uploaded_at FROM orders WHERE o_orderstatus <> 'F'")
def active_resumes(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("uploaded_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return _stamps(profiles.active_resumes(rows).select("id", "user_id", "uploaded_at"), "uploaded_at")


@query(f"{ctes('poll')}, {_DAILY} SELECT * FROM daily")
def daily_counters_stream(spark, d):
    """Daily counters of an event-time stream of polls; a day's counters only grow, so its largest are the newest."""
    named = {c: F.expr(e) for c, e in VIEWS["poll"][1].items() if c in ("source_id", "polled_at", *stats.COUNTERS)}
    rows = _stream(spark, d, "events").select(*[e.alias(c) for c, e in named.items()]).withColumn("polled_at", F.col("polled_at").cast("timestamp"))
    told = _worked_off(spark, polls.daily_counters(rows), "update")
    return told.groupBy("source_id", "day").agg(*[F.max(c).alias(c) for c in stats.COUNTERS])


@query("SELECT DISTINCT CASE WHEN s_suppkey % 4 = 3 THEN 's' || s_suppkey ELSE 'board' || s_suppkey % 3 || ':' || 's' || s_suppkey END AS name, CASE WHEN s_suppkey % 4 = 3 THEN 's' || s_suppkey ELSE 'board' || s_suppkey % 3 END AS family, CASE WHEN s_suppkey % 4 < 3 THEN 's' || s_suppkey END AS config, s_suppkey % 4 < 3 AS valid FROM supplier")
def source_list_file(spark, d):
    """A list file written of all suppliers, with comments, blank lines and repetitions, and read."""
    k, at = F.col("s_suppkey"), f"{folder(spark)}/source-list-{uuid.uuid4().hex}"
    own = F.concat(F.lit("s"), k)
    name = F.when(k % 4 == 3, own).otherwise(F.concat(F.lit("board"), k % 3, F.lit(":"), own))
    lines = F.explode(F.array(F.concat(F.lit("  "), name, F.lit("  # a note")), name, F.lit("# none"), F.lit("")))
    table(spark, d, "supplier").select(lines.alias("value")).write.text(at)
    return boards.source_names(spark, at)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'e' || event_id END AS etag, CASE event_id % 3 WHEN 0 THEN event_type END AS last_modified, CASE event_id % 3 WHEN 0 THEN '{\"etag\":\"e' || event_id || '\",\"last_modified\":\"' || event_type || '\"}' ELSE '{}' END AS encoded FROM events")
def cursor_decode(spark, d):
    """Good, cut off and missing cursors; the last two mean a full fetch."""
    good = F.format_string('{"etag": "e%d", "last_modified": "%s"}', F.col("event_id"), F.col("event_type"))
    text = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.substring(good, 1, 9))
    found = table(spark, d, "events").select("event_id", boards.decode_cursor(text).alias("c"))
    return found.select("event_id", "c.etag", "c.last_modified", boards.encode_cursor(F.col("c")).alias("encoded"))


@query(f"""{ctes('poll')}, {_DAILY}, r AS ({_REPORT}) SELECT printf('%-32s %-12s %8d %6.1f%%', left(name, 32), CASE WHEN source_id % 2 = 0 THEN 'active' ELSE 'paused' END, CAST(today_postings AS BIGINT), CASE WHEN today_postings = 0 THEN 100.0::DOUBLE ELSE today_usable * 100.0::DOUBLE / today_postings END) AS line FROM r""")
def health_report_lines(spark, d):
    """The health report as lines of fixed width."""
    r = _report(spark, d)
    shown = r.select("name", F.when(F.col("source_id") % 2 == 0, "active").otherwise("paused").alias("status"), F.col("today_postings").alias("postings"), F.when(F.col("today_postings") == 0, 100.0).otherwise(F.col("today_usable") * 100.0 / F.col("today_postings")).alias("share"))
    return boards.report_lines(shown)


@query(f"SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS type, 'paused' AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'r' || s_suppkey END AS reviewed_by, CASE WHEN s_suppkey % 3 = 0 THEN {_s(NOW).rsplit(' AS ', 1)[0]} END AS terms_reviewed_at FROM supplier UNION ALL SELECT 'new ' || c_name, 'new', 'active', NULL, NULL FROM customer")
def source_records(spark, d):
    """Sources are upserted by name, which changes the type of known ones alone, and then reviewed."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    shape = [none.alias("reviewed_by"), none.alias("platform_review_ref"), F.lit(None).cast("timestamp").alias("terms_reviewed_at")]
    stored = table(spark, d, "supplier").select(k.alias("source_id"), F.col("s_name").alias("name"), F.lit("old").alias("type"), F.lit("paused").alias("status"), *shape)
    known = stored.filter("source_id % 2 = 0").withColumns({"type": F.lit("new"), "status": F.lit("active")})
    fresh = table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("source_id"), F.concat(F.lit("new "), "c_name").alias("name"), F.lit("new").alias("type"), F.lit("active").alias("status"), *shape)
    rows = ingest.upsert_sources(stored, known.unionByName(fresh))
    reviews = stored.filter("source_id % 3 = 0").select("source_id", F.concat(F.lit("r"), "source_id").alias("reviewed_by"), F.lit("ref").alias("platform_review_ref"))
    return _stamps(ingest.review_sources(rows, reviews, now()).select("name", "type", "status", "reviewed_by", "terms_reviewed_at"), "terms_reviewed_at")
