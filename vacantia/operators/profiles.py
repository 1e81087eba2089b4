"""Profiles, skills, resumes and verified erasure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text as X
from vacantia.operators.ingest import upsert

#: Where a user's data can be, in the order of erasure, and the tables there. The tenant is erased too: its name is the user's address.
LOCATIONS = {
    "object_storage": None, "profile_embedding": None, "search_index": None, "redis_cache": None, "analytics_copies": None,
    "resume_rows": "resume", "profile_skills": "profile_skill", "profile": "profile", "refresh_tokens": "refresh_token",
    "sessions": "user_session", "user_tokens": "user_token", "user_row": "app_user", "tenant": "tenant",
}
#: Fixed value: the largest resume that is taken in, in bytes.
MOST_RESUME_BYTES = 10 << 20
UNUSED = ("profile_embedding", "search_index", "redis_cache", "analytics_copies")


def _owner(table: str) -> str:
    return {"app_user": "id", "tenant": "owner_id"}.get(table, "user_id")


def put_profiles(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Replace every field of a profile; its version goes up by one."""
    return upsert(stored, new.withColumn("profile_version", F.lit(1)), ["user_id"], {"profile_version": F.col("old.profile_version") + 1})


def put_skills(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A manual claim outranks a parsed one; missing figures keep the old ones."""
    merge = {"origin": F.when(F.col("new.origin") == "manual", "manual").otherwise(F.col("old.origin")), **{c: F.coalesce(f"new.{c}", f"old.{c}") for c in ("proficiency", "years")}}
    return upsert(stored, new, ["user_id", "skill_id"], merge)


def drop_skills(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """``stored`` without the claims in ``gone`` (user_id, skill_id)."""
    return stored.join(gone.select("user_id", "skill_id"), ["user_id", "skill_id"], "left_anti").select(*stored.columns)


def touch_profiles(profiles: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Profiles whose skills were edited: a new version, since what was scored on the old one no longer holds."""
    found = profiles.join(users.select("user_id", F.lit(1).alias("hit")).distinct(), "user_id", "left")
    return found.withColumns({"profile_version": F.col("profile_version") + F.coalesce("hit", F.lit(0)), "updated_at": F.when(F.col("hit") == 1, now).otherwise(F.col("updated_at"))}).select(*profiles.columns)


def skills_of(profile_skills: DataFrame, skills: DataFrame) -> DataFrame:
    return profile_skills.join(skills, "skill_id").orderBy("user_id", "display_name")


def resume_keys(resumes: DataFrame) -> DataFrame:
    key = F.format_string("users/%s/resumes/%s%s", F.col("user_id"), F.col("id"), X.media_extension(F.col("content_type")))
    return resumes.withColumn("object_key", key).withColumn("text_object_key", F.format_string("users/%s/resumes/%s.extracted.txt", F.col("user_id"), F.col("id")))


def extract_resumes(resumes: DataFrame) -> DataFrame:
    """Text of plain and markdown bodies; other formats fail with a reason from a fixed list."""
    kind = X.media_type(F.col("content_type"))
    text = F.when(kind.isin("text/plain", "text/markdown"), X.clean_text(F.col("body").cast("string")))
    state = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, "text_extracted").otherwise("failed")
    error = F.when(kind == "application/pdf", "unsupported here: pdf").when(text.isNull(), "unsupported content type").when(F.length(text) == 0, "no text found")
    return resumes.withColumns({"extracted": text, "text_chars": F.length(text), "parse_state": state, "parse_error": error})


def refused_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (``content_type``, ``body``) with ``refused``: why they are not taken in, null for good ones."""
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    why = F.when(size == 0, "empty upload").when(size > MOST_RESUME_BYTES, "too large").when(X.media_extension(F.col("content_type")).isNull(), "unsupported content type")
    return uploads.withColumn("refused", why)


def add_resumes(stored: DataFrame, uploads: DataFrame, now: Column) -> DataFrame:
    """``stored`` with the good ``uploads`` (id, user_id, filename, content_type, body), their texts read.

    A resume whose text can't be read is kept as failed, so that a better reader can try again. Text
    and body belong in the object store, under the keys of the row.
    """
    good = refused_uploads(uploads).filter("refused IS NULL").drop("refused")
    found = resume_keys(extract_resumes(good)).withColumns({
        "size_bytes": F.octet_length("body").cast("long"), "sha256": F.sha2("body", 256), "uploaded_at": now, "deleted_at": F.lit(None).cast("timestamp"),
        "text_object_key": F.when(F.col("parse_state") == "text_extracted", F.col("text_object_key")), "text_chars": F.when(F.col("parse_state") == "text_extracted", F.col("text_chars")),
    })
    return stored.unionByName(found.select(*stored.columns))


def delete_resumes(resumes: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Stamp resumes as deleted if ``asked`` (id, user_id) names their owner; rows and objects stay for the erasure to find."""
    found = resumes.join(asked.select("id", "user_id", F.lit(True).alias("hit")).distinct(), ["id", "user_id"], "left")
    return found.withColumn("deleted_at", F.when(F.col("hit"), now).otherwise(F.col("deleted_at"))).select(*resumes.columns)


def active_resumes(resumes: DataFrame) -> DataFrame:
    return resumes.filter("deleted_at IS NULL").orderBy("user_id", F.desc("uploaded_at"))


def erase(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the rows of ``users`` (user_id)."""
    gone = users.select("user_id").distinct()
    return {name: t.join(gone.withColumnRenamed("user_id", _owner(name)), _owner(name), "left_anti") if name in LOCATIONS.values() else t for name, t in tables.items()}


def user_traces(tables: dict[str, DataFrame], users: DataFrame) -> DataFrame:
    """How many rows of each user are left, over all tables; 0 for none."""
    gone = users.select("user_id").distinct()
    rows = [t.select(F.col(_owner(n)).alias("user_id")).join(gone, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")) for n, t in tables.items() if n in LOCATIONS.values()]
    found = reduce(DataFrame.unionByName, rows).groupBy("user_id").agg(F.sum("n").alias("n"))
    return gone.join(found, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("traces"))


def erasure_steps(tables: dict[str, DataFrame], users: DataFrame, objects: DataFrame) -> DataFrame:
    """A row for each user and location with what was found there; ``objects``: user_id, n of stored objects."""
    gone = users.select("user_id").distinct()
    parts = []
    for location, table in LOCATIONS.items():
        if table is None:
            n = objects.select("user_id", "n") if location == "object_storage" else None
        elif table in tables:
            n = tables[table].groupBy(F.col(_owner(table)).alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
        else:
            n = None
        unused = location in UNUSED
        rows = gone.withColumn("n", F.lit(0).cast("long")) if n is None else gone.join(n, "user_id", "left")
        parts.append(rows.select("user_id", F.lit(location).alias("location"), F.lit("not_applicable" if unused else "done").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("items"), F.lit("store not yet in use" if unused else None).cast("string").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def request_erasures(requests: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """``requests`` and an open one for each of ``users`` (user_id) that has no open one; their ids follow from user and time."""
    still = requests.filter("completed_at IS NULL").select("user_id")
    new = users.select("user_id").filter("user_id IS NOT NULL").distinct().join(still, "user_id", "left_anti")
    made = {"request_id": F.sha2(F.concat_ws("\u0000", F.lit("erasure"), F.col("user_id").cast("string"), F.unix_micros(now).cast("string")), 256), "requested_at": now}
    rows = new.withColumns(made).select(*[c for c in ("request_id", "user_id", "requested_at") if c in requests.columns])
    return requests.unionByName(rows, allowMissingColumns=True)


def record_steps(stored: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """Steps by request and location; a repeated step replaces what the earlier one said."""
    return upsert(stored, steps.withColumn("completed_at", now), ["request_id", "location"])


def complete_requests(requests: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """Stamp requests that have no step which is neither done nor not applicable."""
    bad = steps.filter(~F.col("status").isin("done", "not_applicable")).select("request_id").distinct()
    good = requests.join(bad, "request_id", "left_anti").select("request_id", F.lit(True).alias("good"))
    return requests.join(good, "request_id", "left").withColumn("completed_at", F.coalesce("completed_at", F.when(F.col("good"), now))).select(*requests.columns)
