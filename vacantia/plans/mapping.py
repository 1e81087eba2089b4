"""The driver's tables seen as an opportunity corpus.

Each view is a list of expressions over the driver's columns that Spark SQL and DuckDB both accept, so
that queries and their oracles start from the same rows and part ways at the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '2001-09-01 00:00:00'"
TODAY = "DATE '2024-01-20'"

TITLES = [
    "Senior Backend Engineer - Monitoring", "Staff Frontend Engineer", "Principal Engineer, Data Platform", "Site Reliability Engineer", "Machine Learning Engineer",
    "Engineering Manager, Growth", "Director of Engineering", "Strategic Account Executive", "Customer Success Architect", "Backend Engineering Intern",
    "Sr. iOS Developer", "Jr. QA  Analyst — Payments", "Product Designer", "Recruiter", "Head of Marketing", "Office Coordinator", "",
]
PLACES = [
    "Remote, United States", "Bangalore, India", "Remote, Canada; Remote, United States", "Remote", "Hybrid - Berlin", "Remote, Bangalore",
    "London, UK | Paris, France", "Anywhere", "onsite - Kyiv, Ukraine", "Canada; US", "", "New York / Hybrid",
]


def pick(values: list[str], number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


#: view -> (FROM clause, column -> expression)
VIEWS = {
    "opportunity": (
        "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        {
            "id": "o_orderkey",
            "company_id": "o_custkey",
            "title_raw": pick(TITLES, "o_orderkey"),
            "first_seen_at": "CAST(o_orderdate AS TIMESTAMP)",
            "pipeline_state": "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'enriched' WHEN o_orderstatus = 'P' THEN 'parsed' ELSE 'ready' END",
            "closed_at": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 45 DAY WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 20 DAY END",
            "merged_into": "CASE WHEN o_orderkey % 37 = 36 THEN o_orderkey - 1 END",
            "role_family": "o_orderpriority",
            "seniority_ordinal": "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 6 + 1 AS INT) END",
            "is_management": "o_orderkey % 5 = 0",
            "work_mode": pick(["remote", "hybrid", "onsite"], "o_orderkey"),
            "location_country": "CASE WHEN n_nationkey % 3 > 0 THEN n_name END",
            "remote_geo_scope": "CASE WHEN o_orderkey % 7 = 0 THEN concat('NATION_1,', n_name) END",
            "normalization_version": "CAST(o_orderkey % 2 AS INT)",
            "state_entered_at": "CAST(o_orderdate AS TIMESTAMP)",
            "repost_count": "CAST(o_orderkey % 6 AS INT)",
            "block_key": "CASE WHEN o_orderkey % 3 > 0 THEN concat(c_mktsegment, '|', n_name) END",
            "salary_min_minor": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END",
            "salary_max_minor": "CASE WHEN o_orderkey % 4 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 2 END",
            "salary_currency": "'EUR'",
            "attempts": "CAST(o_orderkey % 7 AS INT)",
            "version": "1",
            "lease_until": "CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '2001-08-31 23:00:00' WHEN o_orderkey % 11 = 1 THEN TIMESTAMP '2001-09-01 01:00:00' END",
            "next_attempt_at": "CAST(o_orderdate AS TIMESTAMP)",
            "swept_at": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY END",
            "last_error": "CAST(NULL AS STRING)",
        },
    ),
    "company": ("customer", {"id": "c_custkey", "display_name": "c_name", "canonical_domain": "lower(concat(c_name, '.example'))", "location": pick(PLACES, "c_custkey")}),
    "opportunity_source": (
        "lineitem",
        {
            "source_row_id": "l_orderkey * 10 + l_linenumber",
            "opportunity_id": "l_orderkey",
            "source_id": "l_suppkey",
            "source_job_id": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING))",
            "apply_url": "CASE WHEN l_linenumber % 3 <> 0 THEN concat('https://jobs.example/', CAST(l_partkey AS STRING)) END",
            "created_at": "CAST(l_shipdate AS TIMESTAMP)",
            "content_hash": "CAST(l_partkey AS STRING)",
        },
    ),
    "poll": (
        "events",
        {
            "source_id": "user_id",
            "evaluation_id": "event_id",
            "polled_at": "ts",
            "day": "CAST(ts AS DATE)",
            "postings": "10 + event_id % 30",
            "usable": "CASE WHEN event_type = 'error' THEN 1 ELSE 10 + event_id % 30 END",
            "company": "10 + event_id % 30",
            "location": "CASE WHEN event_type = 'view' THEN 2 ELSE 8 + event_id % 30 END",
            "apply_url": "10 + event_id % 30",
            "language": "event_id % 9",
            "salary": "event_id % 2",
            "status": "CASE WHEN event_type IN ('error', 'purchase') THEN 'degraded' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'healthy' WHEN event_type = 'click' THEN 'unknown' ELSE 'degraded' END",
        },
    ),
    "posting": (
        "documents",
        {
            "id": "doc_id",
            "company_id": "concat('c', CAST(n_chars % 23 AS STRING))",
            "title": pick(TITLES[:5], "n_chars"),
            "country": "lang",
            "body": "text",
            "first_seen_at": "doc_id",
            "content_hash": "md5(text)",
        },
    ),
}


def view_sql(name: str, oracle: bool = False) -> str:
    source, columns = VIEWS[name]
    body = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"
    return body.replace("AS STRING", "AS VARCHAR") if oracle else body


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n, True)})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; joins are declared so that Spark picks their kind by size."""
    source, columns = VIEWS[name]
    parts = source.split(" JOIN ")
    frame = table(spark, sf_dir, parts[0])
    for part in parts[1:]:
        other, _, on = part.partition(" ON ")
        left, right = on.split(" = ")
        o = table(spark, sf_dir, other)
        frame = frame.join(o, frame[left] == o[right])
    return frame.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
