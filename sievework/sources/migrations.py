"""Steps that lay down a store's tables and take them away again, with a record of those applied.

A step is applied once its record is there. Going up, tables come before the record, and a table that is there stays;
going down, the record goes first. So an attempt that was lost halfway is finished by the next one, and two at once end alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from sievework import schemas as S
from sievework.sources.documents import SourceError
from sievework.sources.tables import IdentityConflict, Store, _delete, _there, claim

BASE = "base"


@dataclass(frozen=True)
class Step:
    revision: str
    tables: tuple[str, ...]


#: From the first to the last; each needs those before it.
STEPS = (
    Step("0001", ("raw.ingestion_batches", "raw.complaints")),
    Step("0002", ("staging.transformation_batches", "staging.complaint_outcomes")),
    Step("0003", ("analytical.population_runs", "analytical.population_outcomes")),
    Step("0004", ("analytical.split_runs", "analytical.split_outcomes")),
)


def _mark(store: Store, step: Step) -> str:
    return f"{store.root}/_revisions/{step.revision}"


def current(store: Store) -> str:
    """The last applied revision, or ``base``; an error where one is applied without those before it."""
    applied = [_there(store.spark, _mark(store, s)) for s in STEPS]
    n = sum(applied)
    if not all(applied[:n]):
        raise SourceError("migration_gap", applied=",".join(s.revision for s, a in zip(STEPS, applied, strict=True) if a))
    return STEPS[n - 1].revision if n else BASE


def _place(revision: str) -> int:
    names = [BASE, *[s.revision for s in STEPS]]
    if revision not in names:
        raise SourceError("migration_unknown", revision=revision)
    return names.index(revision)


def planned(at: str, to: str) -> list[tuple[str, Step]]:
    """(up or down, step), in order, between two revisions."""
    a, b = _place(at), _place(to)
    return [("up", s) for s in STEPS[a:b]] if a <= b else [("down", s) for s in reversed(STEPS[b:a])]


def statements(at: str, to: str, root: str) -> list[str]:
    """The same as Spark SQL, for a reader or a catalog; nothing is run and no store is read."""
    out = []
    for way, step in planned(at, to):
        for table in step.tables if way == "up" else reversed(step.tables):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.TABLES[table].fields)
            out.append(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet LOCATION '{root.rstrip('/')}/{table.replace('.', '/')}'" if way == "up" else f"DROP TABLE IF EXISTS {table}")
    return out


def upgrade(store: Store, to: str = STEPS[-1].revision) -> list[str]:
    """Apply the steps up to a revision; returns those that were new."""
    steps = planned(current(store), to)
    if any(way == "down" for way, _ in steps):
        raise SourceError("migration_direction", current=current(store), wanted=to)
    for _, step in steps:
        for table in step.tables:
            store.spark.createDataFrame([], S.TABLES[table]).write.mode("ignore").parquet(store.path(table, "none"))
        claim(store.spark, _mark(store, step), step.revision)
    return [s.revision for _, s in steps]


def downgrade(store: Store, to: str) -> list[str]:
    """Take back the steps after a revision; an error, before anything goes, where one of their tables has a version.

    Only what ``upgrade`` laid down is removed, so a batch that is committed meanwhile keeps its rows.
    """
    steps = planned(current(store), to)
    if any(way == "up" for way, _ in steps):
        raise SourceError("migration_direction", current=current(store), wanted=to)
    for _, step in steps:
        for table in step.tables:
            if store.versions(table):
                raise IdentityConflict(table)
    for _, step in steps:
        _delete(store.spark, _mark(store, step))
        for table in reversed(step.tables):
            _delete(store.spark, store.path(table, "none"))
    return [s.revision for _, s in steps]
