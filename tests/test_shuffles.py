"""Plans that carry no row more often than they must."""

from vacantia.plans.queries import queries

DIR = "/root/testdata/sf0.001"


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_refreshes_are_judged_once(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        assert exchanges(queries()["refresh_rotation"](spark, DIR)) <= 18
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_skills_are_merged_without_aggregates_in_the_joining_task(spark):
    df = queries()["skill_upsert"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan
