"""Integrity rules: Spark doesn't enforce them, so writers check for violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V

_STATES = ", ".join(f"'{s}'" for s in [*V.STATES, V.FAILED])

#: table -> rule -> condition that good rows meet (a null counts as met)
RULES = {
    "opportunity": {
        "state": f"pipeline_state IN ({_STATES})",
        "salary_range": "salary_min_minor <= salary_max_minor",
        "salary_currency": "(salary_min_minor IS NULL AND salary_max_minor IS NULL) OR salary_currency IS NOT NULL",
        "close_reason": "(closed_at IS NULL) = (close_reason IS NULL)",
        "merge_self": "merged_into <> id",
    },
    "source": {"tier": "tier IN ('a', 'b')", "tier_b_review": "tier <> 'b' OR (terms_reviewed_at IS NOT NULL AND reviewed_by IS NOT NULL)"},
    "opportunity_merge": {"merge_self": "from_id <> into_id"},
    "merge_candidate": {"pair_self": "left_id <> right_id"},
    "company_merge": {"merge_self": "from_id <> into_id"},
    "profile": {"years": "years_experience BETWEEN 0 AND 80", "seniority": "seniority_ordinal BETWEEN 1 AND 6", "currency": "min_salary_minor IS NULL OR salary_currency IS NOT NULL"},
}
KEYS = {
    "opportunity": ["id"], "company": ["canonical_domain"], "source": ["name"], "opportunity_source": ["source_id", "source_job_id"],
    "merge_candidate": ["left_id", "right_id"], "profile": ["user_id"], "profile_skill": ["user_id", "skill_id"], "source_health_daily": ["source_id", "day"],
}


def violations(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` that break a rule of ``table``, once for each rule, which is added as ``rule``."""
    parts = [rows.filter(~F.coalesce(F.expr(cond), F.lit(True))).withColumn("rule", F.lit(name)) for name, cond in RULES[table].items()]
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(rows: DataFrame, table: str) -> DataFrame:
    return rows.groupBy(*KEYS[table]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference names no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")
