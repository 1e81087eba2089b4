"""Duplicate postings: blocking, pair decisions, merges and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import policy as P
from vacantia.functions import text as X
from vacantia.functions.simhash import simhash
from vacantia.sources.scratch import cut

#: What a candidate carries into a pair.
FIELDS = ("company_id", "ats_type", "ats_job_id", "apply_url", "geo_scope", "title", "content_hash", "simhash", "text_len")
MOST_CANDIDATES = 50


def normalize(opps: DataFrame, version: int = 1) -> DataFrame:
    """Derived columns of titles, locations, signatures and block keys."""
    t, loc = X.parse_title(F.col("title_raw")), X.parse_location(F.col("location_region"))
    found = opps.withColumns({"_t": t, "_l": loc})
    body = F.concat_ws(" ", "title_raw", "description_text")
    return (
        found.withColumns({
            "title_normalized": F.col("_t.normalized"),
            "role_family": F.col("_t.role_family"),
            "seniority_ordinal": F.col("_t.seniority"),
            "is_management": F.col("_t.is_management"),
            "work_mode": F.col("_l.work_mode"),
            "location_country": F.col("_l.country"),
            "location_city": F.col("_l.city"),
            "remote_geo_scope": X.join_scope(F.col("_l.geo_scope")),
            "simhash": simhash(X.tokenize(body)),
            "text_len": F.length(F.coalesce("description_text", F.lit(""))),
            "block_key": X.block_key(F.col("company_id"), F.col("title_raw"), F.col("_l.country")),
            "normalization_version": F.lit(version),
        })
        .drop("_t", "_l")
    )


def block_members(candidates: DataFrame) -> DataFrame:
    """Open candidates with ``ord``, oldest first in their block."""
    order = Window.partitionBy("block_key").orderBy("first_seen_at", "id")
    return candidates.filter("block_key IS NOT NULL").withColumn("ord", F.row_number().over(order))


#: Members of a block that meet at once; two chunks of a block are one piece of work, whatever the block's size.
CHUNK = 2048
#: Pairs that a task makes, about, until there are so many tasks; from then on tasks make more.
PAIRS_A_TASK, MOST_TASKS = 1 << 24, 1 << 14


def _coded(members: DataFrame) -> DataFrame:
    """``members`` with numbers for all that decides: two members of a block have the same number, the first place with that value, if the values are equal, and none if there is no value."""
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    board = F.when(given("ats_type").isNotNull() & given("ats_job_id").isNotNull(), F.struct("ats_type", "ats_job_id"))
    specific = F.size("tokens") >= P.V.MIN_TITLE_TOKENS
    values = {"company": given("company_id"), "board": board, "geo": given("geo_scope"), "content": given("content_hash"), "url": X.normalize_url(F.col("apply_url")), "words": F.when(specific, F.col("tokens"))}
    found = members.select("block_key", "ord", "id", *FIELDS, P.title_tokens(F.col("title")).alias("tokens"))
    found = found.withColumns({
        "chunk": ((F.col("ord") - 1) / CHUNK).cast("int"), "last": ((F.max("ord").over(Window.partitionBy("block_key")) - 1) / CHUNK).cast("int"),
        "sure": (F.col("simhash") != 0) & specific, "long": F.col("text_len") >= P.V.MIN_TEXT,
    })
    for name, value in values.items():
        first = F.min("ord").over(Window.partitionBy("block_key", "value"))
        found = found.withColumn("value", value).withColumn(f"{name}_no", F.when(F.col("value").isNotNull(), first)).drop("value")
    return found


def _tasks(coded: DataFrame) -> int:
    """Tasks for the pairs of all blocks: enough that none makes many, and that small tables are dealt too."""
    blocks = coded.groupBy("block_key").agg(F.count(F.lit(1)).cast("double").alias("n"), (F.max("last") + 1).cast("long").alias("c"))
    found = blocks.agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs"), F.sum(F.expr("c * (c + 1) div 2")).alias("units")).first()
    return max(1, min(int((found["pairs"] or 0) // PAIRS_A_TASK), MOST_TASKS), min(found["units"] or 0, 4 * coded.sparkSession.sparkContext.defaultParallelism))


def pairs(members: DataFrame) -> DataFrame:
    """Each pair of a block once, as structs ``a`` (older) and ``b`` with the verdict on it.

    A block's members are dealt in chunks, and every two chunks meet in a task, so that neither memory
    nor time of a task that makes pairs grows with a block; the numbering sorts a block in one task. The verdict is computed where the pair is made, so only
    decided pairs go on. All that decides is made ready once a member, in a table, as numbers: a pair
    costs a few comparisons of numbers, and title tokens are compared only of near texts.
    """
    coded = cut(_coded(members), "members")
    unit, numbers, n = ["block_key", "i", "j"], [c for c in coded.columns if c.endswith("_no")], _tasks(coded)
    older = coded.withColumns({"i": F.col("chunk"), "j": F.explode(F.sequence("chunk", "last"))})
    newer = coded.withColumns({"i": F.explode(F.sequence(F.lit(0), "chunk")), "j": F.col("chunk")})

    def side(rows: DataFrame, s: str, none: int) -> DataFrame:
        """Without nulls in what decides; ``none`` stands for a missing number, so that two missing ones differ."""
        told = {c: F.coalesce(F.col(c), F.lit(none)) for c in numbers} | {c: F.coalesce(F.col(c), F.lit(False)) for c in ("sure", "long")} | {"bits": F.coalesce("simhash", F.lit(0))}
        return rows.repartition(n, *unit).select(*unit, *[F.col(c).alias(f"{s}_{c}") for c in ("ord", "id", *FIELDS, "tokens")], *[v.alias(f"{s}_{c}") for c, v in told.items()])

    both = side(older, "a", 0).join(side(newer, "b", -1), unit).filter("a_ord < b_ord")
    x, y = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    same = lambda c: x(f"{c}_no") == y(f"{c}_no")
    apart = (x("geo_no") > 0) & (y("geo_no") > 0) & ~same("geo")
    text = P.near_text(F.col("distance"), x("long") & y("long"), x("sure") & y("sure"), same("words") | P.tokens_agree(x("tokens"), y("tokens")))
    # a column each, so that Spark computes the distance and the reason once
    judged = both.withColumn("distance", P.hamming(x("bits"), y("bits")))
    judged = judged.withColumn("found", P.cascade(same("company"), same("board"), apart, same("content"), same("url"), text, range(5)))
    sides = [F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("id", *FIELDS)]).alias(s) for s in "ab"]
    return judged.select("block_key", "a_ord", sides[0], "b_ord", sides[1], P.verdict(F.col("found"), F.col("distance"), range(5)).alias("verdict"))


def saturated(members: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Blocks with more members than a probe of the reference size would see; here all pairs are judged."""
    return members.groupBy("block_key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > most)


#: Widths of the ten bands of a signature. Of ten bands one at least is equal at a distance of nine.
BANDS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
_MASKS = [((1 << w) - 1) << sum(BANDS[:k]) for k, w in enumerate(BANDS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_index(members: DataFrame) -> DataFrame:
    """A row for each key under which a member can be found the same: board identity, content, address, and bands of its signature.

    ``kind`` numbers the keys from the most telling on, ``m`` is the member. Members with none of them are the same as no other.
    """
    fields = F.struct("id", *FIELDS)
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    url = X.normalize_url(F.col("apply_url"))
    text = (F.col("simhash") != 0) & P.title_is_specific(F.col("title"))
    bands = [F.when(text, F.col("simhash").bitwiseAND(F.lit(_signed(m))).cast("string")) for m in _MASKS]
    board = F.when(given("ats_type") & given("ats_job_id"), F.concat_ws("\u0000", "ats_type", "ats_job_id"))
    values = [board, F.when(given("content_hash"), F.col("content_hash").cast("string")), url, *bands]
    keys = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in enumerate(values)]), lambda e: e["value"].isNotNull())
    found = members.filter(F.coalesce("company_id", F.lit("")) != "").select("block_key", "ord", fields.alias("m"), url.alias("url"), F.explode(keys).alias("e"))
    return found.select("block_key", "ord", "m", "url", "e.kind", "e.value")


def _first_kind() -> Column:
    """The first key that the two sides of a pair share, so that each pair is made once."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = lambda c: F.coalesce((a(c) == b(c)) & (a(c).cast("string") != ""), F.lit(False))
    kind = F.when(same("ats_type") & same("ats_job_id"), 0).when(same("content_hash"), 1).when(F.coalesce(F.col("a_url") == F.col("b_url"), F.lit(False)), 2)
    differ = a("simhash").bitwiseXOR(b("simhash"))
    for k, m in enumerate(_MASKS):
        kind = kind.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, 3 + k)
    return kind


def _joined(older: DataFrame, newer: DataFrame) -> DataFrame:
    a = older.select("block_key", "kind", "value", F.col("ord").alias("a_ord"), F.col("m").alias("a"), F.col("url").alias("a_url"))
    b = newer.select("block_key", "kind", "value", F.col("ord").alias("b_ord"), F.col("m").alias("b"), F.col("url").alias("b_url"))
    both = a.join(b, ["block_key", "kind", "value"]).filter((F.col("a_ord") < F.col("b_ord")) & (_first_kind() == F.col("kind")))
    near = (F.col("kind") < 3) | (P.hamming(F.col("a.simhash"), F.col("b.simhash")) <= P.V.MAX_HAMMING)
    judged = both.filter(near).withColumn("verdict", P.decide(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")))
    return judged.filter("verdict.same").select("block_key", "a_ord", "a", "b_ord", "b", "verdict")


def similar_pairs(members: DataFrame) -> DataFrame:
    """The pairs of ``pairs`` that are the same, without making the others: members meet only where they share a key."""
    index = block_index(members)
    return _joined(index, index)


def _alike(members: DataFrame) -> DataFrame:
    """``members`` with ``like``, equal for members that agree in all that decides and therefore surely merge."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sure = (text("company_id") != "") & ((text("content_hash") != "") | ((text("ats_type") != "") & (text("ats_job_id") != "")))
    whole = F.sha2(F.to_json(F.struct(*FIELDS)), 256)
    return members.withColumn("like", F.when(sure, whole).otherwise(F.concat(F.lit("id "), F.col("id").cast("string"))))


def _edges(decided: DataFrame) -> DataFrame:
    auto = decided.filter(P.auto_apply(F.col("verdict")))
    return auto.select("block_key", "a_ord", "b_ord", F.col("b.id").alias("from_id"), F.col("a.id").alias("into_id"), F.col("verdict.reason").alias("reason"), F.col("verdict.confidence").alias("confidence"))


def leaders(decided: DataFrame, survivors: DataFrame | None = None) -> DataFrame:
    """Greedy clusters, oldest first: a surviving member takes in every later survivor that merges with it.

    In rounds: a member without an earlier undecided neighbour, and with no leader among the earlier
    ones, leads; the later neighbours of a leader go. Once all are decided, each one that went belongs
    to its oldest leader. A round is a few joins on members, so a block may be of any size; merges are
    not closed transitively. Members of ``survivors`` (block_key, ord) lead from the start.
    """
    edges = cut(_edges(decided), "edges")
    lead = None if survivors is None else cut(survivors.select("block_key", "ord").distinct(), "leaders")
    left = edges.select("block_key", F.col("a_ord").alias("ord")).union(edges.select("block_key", F.col("b_ord").alias("ord"))).distinct()
    on_a, on_b = [F.col(f"e.{c}") == F.col(f"n.{d}") for c, d in (("block_key", "block_key"), ("a_ord", "ord"))], [F.col(f"e.{c}") == F.col(f"n.{d}") for c, d in (("block_key", "block_key"), ("b_ord", "ord"))]
    if lead is not None:
        left = left.join(lead, ["block_key", "ord"], "left_anti")
    open_edges, left = edges, cut(left, "undecided")
    while not left.isEmpty():
        if lead is not None:  # the later neighbours of leaders go
            gone = open_edges.alias("e").join(lead.alias("n"), on_a, "left_semi").select("block_key", F.col("b_ord").alias("ord")).distinct()
            left = cut(left.join(gone, ["block_key", "ord"], "left_anti"), "undecided")
        open_edges = cut(open_edges.alias("e").join(left.alias("n"), on_a, "left_semi").alias("e").join(left.alias("n"), on_b, "left_semi"), "open")
        waits = open_edges.select("block_key", F.col("b_ord").alias("ord")).distinct()
        new = cut(left.join(waits, ["block_key", "ord"], "left_anti"), "leaders")
        left = left.join(new, ["block_key", "ord"], "left_anti")
        gone = open_edges.alias("e").join(new.alias("n"), on_a, "left_semi").select("block_key", F.col("b_ord").alias("ord")).distinct()
        left = cut(left.join(gone, ["block_key", "ord"], "left_anti"), "undecided")
        lead = new if lead is None else lead.unionByName(new)
    if lead is None:
        return edges.drop("a_ord", "b_ord")
    by = edges.alias("e").join(lead.alias("n"), on_a, "left_semi").alias("e").join(lead.alias("n"), on_b, "left_anti")
    first = by.groupBy("block_key", "from_id").agg(F.min_by(F.struct("into_id", "reason", "confidence"), "a_ord").alias("f"))
    return first.select("block_key", "from_id", "f.*")


def sweep(members: DataFrame) -> dict[str, DataFrame]:
    """All blocks at once: ``merges`` are those of ``leaders(pairs(members))`` without all pairs of a
    block, ``review`` holds the weak pairs of members that still stand after them.

    Members that agree in all that decides are one node, its oldest, whose copies go wherever it goes:
    into the node itself if that leads, else into the node's leader. So a group of copies costs a row each.
    """
    alike = cut(_alike(members), "members")
    first = alike.groupBy("block_key", "like").agg(F.min_by("id", "ord").alias("first_id"), F.min("ord").alias("ord"))
    nodes = cut(alike.join(first.select("block_key", "like", "ord"), ["block_key", "like", "ord"], "left_semi"), "nodes")
    decided = cut(similar_pairs(nodes), "decided")
    merged = cut(leaders(decided), "merged")
    copies = alike.join(first.drop("ord"), ["block_key", "like"]).filter(F.col("id") != F.col("first_id"))
    of_node = merged.select("block_key", F.col("from_id").alias("first_id"), F.struct("into_id", "reason", "confidence").alias("m"))
    board = (F.coalesce("ats_type", F.lit("")) != "") & (F.coalesce("ats_job_id", F.lit("")) != "")
    own = F.struct(F.col("first_id").alias("into_id"), F.when(board, "exact_ats").otherwise("content_hash").alias("reason"), F.when(board, 1.0).otherwise(0.99).cast("float").alias("confidence"))
    gone = copies.join(of_node, ["block_key", "first_id"], "left").select("block_key", F.col("id").alias("from_id"), F.coalesce("m", own).alias("m"))
    weak = review_queue(decided)
    for side in ("left_id", "right_id"):  # only nodes are in these pairs
        weak = weak.join(merged.select(F.col("from_id").alias(side)), side, "left_anti")
    return {"merges": merged.unionByName(gone.select("block_key", "from_id", "m.*")), "review": weak}


def clusters(members: DataFrame) -> DataFrame:
    """The merges of a sweep."""
    return sweep(members)["merges"]


def probe(changed: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    """``changed`` members (with ``block_key`` and ``ord``) against a stored ``block_index`` of their blocks alone.

    A changed member is held against the older open members of its block, oldest first: pairs that are
    the same but not surely enough are queued until the first sure one takes it in. Older members that
    are merged by the same batch take in none. Without a limit on candidates; the index must hold the
    changed members too, as they are now. Gives ``merges`` and ``review``.
    """
    ids = changed.select(F.col("id").alias("m_id"))
    new = index.join(ids, F.col("m.id") == F.col("m_id"), "left_semi")
    blocks = changed.select("block_key").distinct()
    decided = cut(_joined(index.join(blocks, "block_key", "left_semi"), new), "probed")
    old = decided.select("block_key", F.col("a_ord").alias("ord"), F.col("a.id").alias("m_id")).join(ids, "m_id", "left_anti")
    merges = cut(leaders(decided, old), "merges")
    taken = merges.select("block_key", F.col("from_id").alias("b_id"), F.col("into_id").alias("taken_by"))
    ahead = decided.select("block_key", "a_ord", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).join(taken, ["block_key", "b_id"]).filter("a_id = taken_by").select("block_key", "b_id", F.col("a_ord").alias("upto"))
    gone = merges.select(F.col("from_id").alias("a_id"))
    seen = decided.withColumns({"a_id": F.col("a.id"), "b_id": F.col("b.id")}).join(ahead, ["block_key", "b_id"], "left").filter("upto IS NULL OR a_ord < upto").join(gone, "a_id", "left_anti")
    return {"merges": merges, "review": review_queue(seen)}


def review_queue(decided: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """Pairs that are the same but not surely enough; left is the newer one. Queued pairs aren't queued again."""
    weak = decided.filter(F.col("verdict.same") & ~P.auto_apply(F.col("verdict")))
    rows = weak.select(F.col("b.id").alias("left_id"), F.col("a.id").alias("right_id"), F.col("verdict.reason").alias("reason"), F.col("verdict.confidence").alias("confidence"), P.withheld_because(F.col("verdict.confidence")).alias("withheld_because"))
    return rows if queued is None else rows.join(queued, ["left_id", "right_id"], "left_anti")


def apply_merges(opps: DataFrame, sources: DataFrame, merges: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Losers are marked, their provenance moves to the survivor, and each merge is logged with the rows it moved."""
    m = merges.select(F.col("from_id").alias("id"), "into_id")
    marked = opps.join(m, "id", "left").withColumn("version", F.col("version") + F.when(F.col("into_id").isNotNull(), 1).otherwise(0))
    marked = marked.withColumn("merged_into", F.coalesce("merged_into", "into_id")).drop("into_id").select(*opps.columns)
    how = merges.select(F.col("from_id").alias("opportunity_id"), F.struct("into_id", "reason", "confidence").alias("how"))
    found = sources.join(how, "opportunity_id", "left")
    told = {"merge_reason": ("reason", "string"), "merge_confidence": ("confidence", "float")}
    told = {c: F.coalesce(F.col(f"how.{name}").cast(kind), *([F.col(c)] if c in sources.columns else [])) for c, (name, kind) in told.items()}
    if "merged_by" in sources.columns:
        told["merged_by"] = F.when(F.col("how").isNotNull(), "dedupe").otherwise(F.col("merged_by"))
    moved = found.withColumns(told | {"opportunity_id": F.coalesce("how.into_id", "opportunity_id")}).drop("how")
    count = sources.join(merges.select(F.col("from_id").alias("opportunity_id")), "opportunity_id", "left_semi").groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("rows_moved"), F.collect_list("source_row_id").alias("moved_rows"))
    log = merges.join(count, merges["from_id"] == count["opportunity_id"], "left").select("from_id", "into_id", "reason", "confidence", F.coalesce("rows_moved", F.lit(0)).alias("rows_moved"), "moved_rows", now.alias("merged_at"), F.lit(None).cast("timestamp").alias("undone_at"))
    return {"opportunity": marked, "opportunity_source": moved, "opportunity_merge": log}


def undo_merge(opps: DataFrame, sources: DataFrame, log: DataFrame, from_id, now: Column) -> dict[str, DataFrame]:
    """Stamp a merge as undone and give the loser and its provenance rows back; the log knows which they were."""
    one = log.filter((F.col("from_id") == from_id) & F.col("undone_at").isNull())
    rows = one.select(F.explode("moved_rows").alias("source_row_id"), F.col("from_id").alias("back"))
    restored = sources.join(rows, "source_row_id", "left").withColumn("opportunity_id", F.coalesce("back", "opportunity_id")).select(*sources.columns)
    hit = one.select(F.col("from_id").alias("id"), F.lit(True).alias("undone"))
    freed = opps.join(hit, "id", "left").withColumn("merged_into", F.when(F.col("undone").isNull(), F.col("merged_into"))).select(*opps.columns)
    stamped = log.withColumn("undone_at", F.when((F.col("from_id") == from_id) & F.col("undone_at").isNull(), now).otherwise(F.col("undone_at")))
    return {"opportunity": freed, "opportunity_source": restored, "opportunity_merge": stamped}


def survivors(opps: DataFrame) -> DataFrame:
    """``id``, ``survivor`` (where its merges end; null in a cycle) and ``cycle`` of every merged row, by pointer jumping.

    Each round doubles the steps that a pointer spans, so chains of any length end after a few; what
    still points on after more rounds than rows could need goes round in a cycle. A pointer to a row
    that isn't there ends at it.
    """
    now = cut(opps.filter("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("at")), "pointers")
    span, rows = 1, now.count()
    while span <= rows:
        ahead = now.select(F.col("id").alias("at"), F.col("at").alias("far"))
        if now.join(ahead, "at", "left_semi").isEmpty():
            break
        now = cut(now.join(ahead, "at", "left").select("id", F.coalesce("far", "at").alias("at")), "pointers")
        span *= 2
    merged = opps.filter("merged_into IS NOT NULL").select(F.col("id").alias("at"), F.lit(True).alias("on"))
    found = now.join(merged, "at", "left")
    cycle = F.col("on").isNotNull()
    return found.select("id", F.when(~cycle, F.col("at")).alias("survivor"), cycle.alias("cycle"))


def merge_cycles(opps: DataFrame) -> DataFrame:
    """Rows whose merges go round, in cycles of any length or leading into one; there should be none."""
    return opps.select("id", "merged_into").join(survivors(opps).filter("cycle").select("id"), "id", "left_semi")


def one_row_each(opps: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates with one source row each, the oldest, so that several provenance rows don't make a posting its own duplicate."""
    key = F.struct("created_at", "source_row_id")
    oldest = sources.groupBy("opportunity_id").agg(F.min_by(F.struct("apply_url", "ats_type", "ats_job_id"), key).alias("s"))
    found = opps.filter("merged_into IS NULL AND closed_at IS NULL").join(oldest, opps["id"] == oldest["opportunity_id"], "left")
    return found.select(*opps.columns, "s.apply_url", "s.ats_type", "s.ats_job_id")


def stored_candidates(opps: DataFrame, sources: DataFrame) -> DataFrame:
    """Open candidates of the stored tables, as ``block_members`` takes them, with their oldest provenance row alone.

    Rows without texts know their lengths (``text_len``) from normalisation.
    """
    found = one_row_each(opps, sources).withColumns({"company_id": F.col("company_id").cast("string"), "title": F.col("title_normalized"), "geo_scope": F.col("remote_geo_scope")})
    if "description_text" in opps.columns:
        found = found.withColumn("text_len", F.length(F.coalesce("description_text", F.lit(""))))
    return found.select("id", "block_key", "first_seen_at", *FIELDS)


def candidates_from(documents: DataFrame) -> DataFrame:
    """Candidates of texts: ``id``, ``company_id``, ``title``, ``body``, ``country``, ``first_seen_at``; no board identity."""
    body = F.concat_ws(" ", "title", "body")
    none = F.lit(None).cast("string")
    return documents.select(
        "id", "company_id", none.alias("ats_type"), none.alias("ats_job_id"), none.alias("apply_url"), none.alias("geo_scope"), "title", "first_seen_at",
        F.sha2(F.coalesce("body", F.lit("")), 256).alias("content_hash"), simhash(X.tokenize(body)).alias("simhash"), F.length(F.coalesce("body", F.lit(""))).alias("text_len"),
        X.block_key(F.col("company_id"), F.col("title"), F.col("country")).alias("block_key"),
    )
