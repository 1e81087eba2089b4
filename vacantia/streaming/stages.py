"""The stages behind the polls, over the stored tables: due rows are normalised, held against their blocks and advanced.

Each stage reads one version of the store and commits the next as a unit, with all that follows from
it: states, merges and the provenance that they move, the merge log, the review queue. A commit that
another writer overtook fails and may be run again; one that was lost midway has changed nothing, so
no lease is needed. ``batch`` limits a run to the rows that are due longest; without it all due rows go.

A store may keep the texts apart (``opportunity_text``: id, description_text; the rows then have
``text_len`` instead), so that only normalisation reads them and no stage writes them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators import dedupe, queue
from vacantia.sources.scratch import cut
from vacantia.sources.store import TableStore


def normalize_due(store: TableStore, now: Column, batch: int | None = None) -> int:
    """Parsed rows get their derived columns and become normalised; returns the committed version."""
    base, rows = store.manifest()["version"], store.read("opportunity")
    taken = rows.join(queue.claimable(rows, "parsed", batch, now), "id", "left_semi")
    if "description_text" not in rows.columns:
        taken = taken.join(store.read("opportunity_text"), "id", "left")
    done = dedupe.normalize(taken).withColumn("state", F.col("pipeline_state"))
    kinds = {c: F.col(c).cast(rows.schema[c].dataType) for c in queue.DERIVED if c in rows.columns}
    return store.commit({"opportunity": queue.apply_normalization(rows, done.withColumns(kinds), now)}, expected=base)


def _joined(store: TableStore, name: str, new: DataFrame) -> DataFrame:
    return store.read(name).unionByName(new, allowMissingColumns=True) if name in store.tables() else new


def _settled(store: TableStore, rows: DataFrame, sources: DataFrame, found: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """The tables after the merges of ``found``, and its weak pairs queued once each."""
    merges = cut(found["merges"], "merges")
    out = dedupe.apply_merges(rows, sources, merges, now)
    weak = found["review"].withColumn("queued_at", now)
    if "dedupe_review" in store.tables():
        weak = weak.join(store.read("dedupe_review"), ["left_id", "right_id"], "left_anti")
    return out | {"opportunity_merge": _joined(store, "opportunity_merge", out["opportunity_merge"]), "dedupe_review": _joined(store, "dedupe_review", weak)}


def dedupe_due(store: TableStore, now: Column, batch: int | None = None) -> int:
    """Normalised rows meet the older open members of their blocks; those that stay are deduped, merged ones go no further.

    Only the blocks of the due rows are read into an index. Rows without a block key pass unmerged.
    """
    base, rows, sources = store.manifest()["version"], store.read("opportunity"), store.read("opportunity_source")
    due = cut(rows.join(queue.claimable(rows, "normalized", batch, now), "id", "left_semi").select("id", "version", F.col("pipeline_state").alias("state")), "due")
    candidates = dedupe.stored_candidates(rows, sources)
    blocks = candidates.join(due, "id", "left_semi").select("block_key").distinct()
    members = cut(dedupe.block_members(candidates.join(blocks, "block_key", "left_semi")), "members")
    found = dedupe.probe(members.join(due, "id", "left_semi"), cut(dedupe.block_index(members), "index"))
    out = _settled(store, rows, sources, found, now)
    # a merge raises the version, so only the rows that stay match what was due
    out["opportunity"] = queue.advance(out["opportunity"], due, now)[0]
    return store.commit(out, expected=base)


def sweep_blocks(store: TableStore, now: Column) -> int:
    """All blocks with several open members once more, as arrival order hides pairs from ``dedupe_due``.

    Commits nothing if nothing is found; returns the version in force.
    """
    base, rows, sources = store.manifest()["version"], store.read("opportunity"), store.read("opportunity_source")
    members = cut(dedupe.block_members(dedupe.stored_candidates(rows, sources)), "members")
    several = members.join(members.filter("ord = 2").select("block_key"), "block_key", "left_semi")
    found = {name: cut(rows_found, name) for name, rows_found in dedupe.sweep(several).items()}
    if found["merges"].isEmpty():
        known = store.read("dedupe_review") if "dedupe_review" in store.tables() else None
        new = found["review"] if known is None else found["review"].join(known, ["left_id", "right_id"], "left_anti")
        if new.isEmpty():
            return base
    return store.commit(_settled(store, rows, sources, found, now), expected=base)
