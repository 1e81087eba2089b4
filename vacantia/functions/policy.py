"""Decision policies: duplicates, stale listings, source health, retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V
from vacantia.functions.simhash import hamming
from vacantia.functions.text import normalize_url, title_tokens


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def geo_conflict(a: Column, b: Column) -> Column:
    return _given(a) & _given(b) & (a != b)


def titles_agree(a: Column, b: Column) -> Column:
    """All tokens of the shorter title are in the longer one; equal lengths compare the first with the second."""
    return tokens_agree(title_tokens(a), title_tokens(b))


def tokens_agree(x: Column, y: Column) -> Column:
    short = F.when(F.size(y) < F.size(x), y).otherwise(x)
    long = F.when(F.size(y) < F.size(x), x).otherwise(y)
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_except(short, long)) == 0)


def title_is_specific(c: Column) -> Column:
    return F.size(title_tokens(c)) >= V.MIN_TITLE_TOKENS


#: What two candidates can be the same by, from conclusive to weak; the first is nothing.
REASONS = ("", "exact_ats", "content_hash", "apply_url", "simhash")


def decide(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """``struct(same, reason, confidence)`` of two candidates; ``a`` and ``b`` give a candidate's columns by name.

    The cascade goes from conclusive to weak evidence: the board's own identity, equal content, equal
    apply address, near-equal text. A missing value never matches.
    """
    distance = hamming(a("simhash"), b("simhash"))
    both = lambda c: _given(a(c)) & (a(c) == b(c))
    sure = [(side("simhash") != 0) & title_is_specific(side("title")) for side in (a, b)]
    text = near_text(distance, (a("text_len") >= V.MIN_TEXT) & (b("text_len") >= V.MIN_TEXT), sure[0] & sure[1], titles_agree(a("title"), b("title")))
    url = normalize_url(a("apply_url")) == normalize_url(b("apply_url"))
    return verdict(cascade(both("company_id"), both("ats_type") & both("ats_job_id"), geo_conflict(a("geo_scope"), b("geo_scope")), both("content_hash"), url, text), distance)


def near_text(distance: Column, long: Column, sure: Column, titles: Column) -> Column:
    """Texts are near-equal: of equal signatures, or of near ones if both texts are ``long``. ``sure`` tells that both have signatures and titles of enough words."""
    return ((distance == 0) | ((distance <= V.MAX_HAMMING) & long)) & sure & titles


def cascade(company: Column, board: Column, apart: Column, content: Column, url: Column, text: Column, names=REASONS) -> Column:
    """The first evidence that holds, told by ``names``; there is none between companies, nor without the same board identity between places."""
    none, *found = map(F.lit, names)
    company = F.coalesce(company, F.lit(False))
    return F.when(~company, none).when(board, found[0]).when(apart, none).when(content, found[1]).when(url, found[2]).when(text, found[3]).otherwise(none)


def verdict(found: Column, distance: Column, names=REASONS) -> Column:
    """The verdict on what ``cascade`` found, told by the same ``names``."""
    none, board, content, url, _ = (found == F.lit(n) for n in names)
    faded = F.lit(0.90).cast("float") - distance.cast("float") * F.lit(0.05).cast("float")
    sure = {c: F.lit(x).cast("float") for c, x in (("none", 0.0), ("board", 1.0), ("content", 0.99), ("url", 0.97))}
    confidence = F.when(none, sure["none"]).when(board, sure["board"]).when(content, sure["content"]).when(url, sure["url"]).otherwise(faded)
    reason = found if names is REASONS else F.when(none, REASONS[0]).when(board, REASONS[1]).when(content, REASONS[2]).when(url, REASONS[3]).otherwise(REASONS[4])
    return F.struct((~none).alias("same"), reason.alias("reason"), confidence.alias("confidence"))


def auto_apply(verdict: Column) -> Column:
    return verdict["same"] & (verdict["confidence"] >= F.lit(V.AUTO_MERGE).cast("float"))


def withheld_because(confidence: Column) -> Column:
    return F.format_string("confidence %.2f below auto-merge floor %.2f", confidence.cast("double"), F.lit(V.AUTO_MERGE))


def days_open(first_seen: Column, now: Column) -> Column:
    seconds = (F.unix_micros(now) - F.unix_micros(first_seen)) / 1e6
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int")


def _signal(weight: int, code: str, detail: Column) -> Column:
    return F.struct(F.lit(weight).alias("w"), F.struct(F.lit(code).alias("code"), detail.alias("detail")).alias("r"))


def ghost_risk(days: Column, reposts: Column, has_apply: Column, median_days: Column) -> Column:
    """``struct(score, band, reasons)``: how far a listing shows signs of not being open.

    Fixed values: limits, weights, codes and wording.
    """
    median = F.coalesce(median_days, F.lit(0))
    refreshed = F.format_string("the source has refreshed this listing's date %d time%s without the content changing", reposts, F.when(reposts != 1, "s").otherwise(""))
    usual = F.format_string("open %d days; this company usually fills a role in about %d", days, median)
    signals = [
        F.when(reposts >= 4, _signal(3, "repeated_refresh", refreshed)).when(reposts >= 2, _signal(1, "refreshed", refreshed)),
        F.when((median > 0) & (days >= 6 * median), _signal(2, "open_far_longer_than_usual", usual))
        .when((median > 0) & (days >= 3 * median), _signal(1, "open_longer_than_usual", usual))
        .when((median <= 0) & (days >= 120), _signal(2, "open_a_long_time", F.format_string("open %d days, and we have no hiring-pace history for this company", days)))
        .when((median <= 0) & (days >= 60), _signal(1, "open_a_while", F.format_string("open %d days", days))),
        F.when(~has_apply, _signal(1, "no_apply_route", F.lit("we could not resolve anywhere to actually apply"))),
    ]
    found = F.filter(F.array(*signals), lambda s: s.isNotNull())
    score = F.aggregate(found, F.lit(0), lambda t, s: t + s["w"])
    band = F.when(score >= 3, "high").when(score >= 1, "elevated").otherwise("normal")
    return F.struct(score.alias("score"), band.alias("band"), F.transform(found, lambda s: s["r"]).alias("reasons"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part.cast("double") / whole.cast("double"))


def health_verdict(now: Callable[[str], Column], before: Callable[[str], Column]) -> Column:
    """``struct(status, reasons)`` of a source; both sides give postings, usable and a count for each field."""
    enough = (now("postings") >= V.MIN_SAMPLE) & (before("postings") >= V.MIN_SAMPLE)
    too_few = F.format_string(f"need {V.MIN_SAMPLE} postings on both sides, have current=%d baseline=%d", now("postings"), before("postings"))

    def reason(code: str, field: str, detail: Column, was: Column, is_now: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), detail.alias("detail"), was.alias("before"), is_now.alias("after"))

    was, is_now = rate(before("usable"), before("postings")), rate(now("usable"), now("postings"))
    drop = (was - is_now) / was
    found = [F.when((was > 0) & (drop >= V.YIELD_DROP), reason("yield_drop", "", F.format_string("usable-record rate fell %.0f%% relative to baseline", drop * 100), was, is_now))]
    for field in V.ALERTING_FIELDS:
        was, is_now = rate(before(field), before("postings")), rate(now(field), now("postings"))
        detail = F.format_string(f"{field} populated on %.0f%% of postings, down from %.0f%%", is_now * 100, was * 100)
        found.append(F.when((was >= V.FILL_FLOOR) & ((was - is_now) / was >= V.FILL_DROP), reason("field_fill_drop", field, detail, was, is_now)))
    zero = F.lit(0.0)
    reasons = F.when(enough, F.filter(F.array(*found), lambda r: r.isNotNull())).otherwise(F.array(reason("insufficient_sample", "", too_few, zero, zero)))
    status = F.when(~enough, "unknown").when(F.size(reasons) == 0, "healthy").otherwise("degraded")
    return F.struct(status.alias("status"), reasons.alias("reasons"))


def health_note(reasons: Column) -> Column:
    text = F.substring(F.array_join(F.transform(reasons, lambda r: r["detail"]), "; "), 1, 500)
    return F.when(text == "", "degraded").otherwise(text)


def backoff_seconds(attempts: Column, base: int = 30, most: int = 3600) -> Column:
    """``base`` doubled for each attempt after the first, at most ``most``."""
    n = F.greatest(attempts, F.lit(1)) - 1
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(n, F.lit(40))), F.lit(float(most))).cast("long")


def next_state(state: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in zip(V.STATES, V.STATES[1:], strict=False) for x in pair])
    return F.element_at(table, state)


def is_terminal(state: Column) -> Column:
    return state.isin("ready", V.FAILED)
