"""Acquiring raw batches on the driver: streamed artifacts, run manifests, lineage, retention, cleanup."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.sources.documents import SourceError, trusted
from sievework.sources.tables import canonical

#: Bytes of one shard at most; fixed value.
SHARD_BYTES = 1 << 30
CHUNK_BYTES = 64 << 10


@dataclass(frozen=True)
class Artifact:
    relative_path: str
    sha256: str
    byte_count: int
    created: bool


def stream_artifact(chunks: Iterable[bytes], root: str, *, folder: str = "data/raw/sha256", limit: int = SHARD_BYTES) -> Artifact:
    """Write chunks under the name of their own hash, by way of a temporary file that any error removes.

    Bytes are hashed as they come and never held; an equal artifact that is there already stays.
    """
    base = Path(root).resolve()
    partial = base / folder / ".partial" / uuid.uuid4().hex
    partial.parent.mkdir(parents=True, exist_ok=True)
    digest, size = hashlib.sha256(), 0
    try:
        with partial.open("xb") as out:
            for chunk in chunks:
                if not isinstance(chunk, bytes):
                    raise SourceError("chunk_invalid")
                size += len(chunk)
                if size > limit:
                    raise SourceError("artifact_too_large", limit=limit)
                digest.update(chunk)
                out.write(chunk)
            out.flush()
            os.fsync(out.fileno())
        if not size:
            raise SourceError("artifact_empty")
        name = digest.hexdigest()
        relative = f"{folder}/{name[:2]}/{name}.json"
        place = base / relative
        place.parent.mkdir(parents=True, exist_ok=True)
        if place.exists():
            if file_sha256(place) != name:
                raise SourceError("artifact_conflict", sha256=name)
            return Artifact(relative, name, size, False)
        os.replace(partial, place)
        return Artifact(relative, name, size, True)
    finally:
        partial.unlink(missing_ok=True)


def file_chunks(path: str | Path) -> Iterable[bytes]:
    with Path(path).open("rb") as file:
        while chunk := file.read(CHUNK_BYTES):
            yield chunk


def file_sha256(path: str | Path) -> str:
    """Of a file, a chunk at a time."""
    digest = hashlib.sha256()
    for chunk in file_chunks(path):
        digest.update(chunk)
    return digest.hexdigest()


def publish_document(root: str, path: str, document: Mapping[str, object]) -> bool:
    """Write canonical JSON once: True after a write, False where equal bytes are there, else an error."""
    place = trusted(path, root)
    raw = (canonical(dict(document)) + "\n").encode()
    if place.exists():
        if place.read_bytes() != raw:
            raise SourceError("document_conflict", path=path)
        return False
    place.parent.mkdir(parents=True, exist_ok=True)
    partial = place.with_name(f".{place.name}.{uuid.uuid4().hex}")
    try:
        with partial.open("xb") as out:
            out.write(raw)
            out.flush()
            os.fsync(out.fileno())
        os.link(partial, place)  # fails where another writer came first
    except FileExistsError as error:
        raise SourceError("document_conflict", path=path) from error
    finally:
        partial.unlink(missing_ok=True)
    return True


def publish_run(root: str, path: str, run_id: str, shards: Sequence[Mapping[str, object]], months: Sequence[str]) -> bool:
    """Publish a run's manifest, if its shards are the months in order, with unique batches and artifacts,
    and each returned what was counted before."""
    if [s["month"] for s in shards] != list(months):
        raise SourceError("run_months_differ", expected=len(months), found=len(shards))
    for field in ("batch_id", "artifact_sha256"):
        if len({s[field] for s in shards}) != len(shards):
            raise SourceError("run_not_unique", field=field)
    for s in shards:
        if s["preflight_count"] != s["returned_record_count"]:
            raise SourceError("run_count_differs", month=str(s["month"]))
    total = sum(int(s["returned_record_count"]) for s in shards)  # type: ignore[call-overload]
    return publish_document(root, path, {"run_id": run_id, "shards": [dict(s) for s in shards], "returned_record_count": total})


def acquire_run(
    months: Sequence[str], counts: Mapping[str, int], fetch: Callable[[str], Iterable[bytes]], root: str, *, limit: int = 100_000, pause: float = 35.0, free_bytes: int = 20 << 30, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic
) -> list[dict[str, object]]:
    """Stream the export of every month to an artifact: requests at least ``pause`` seconds apart, on a disk with
    room, for months whose counts are sound. After a failure nothing that this run created is left."""
    if bad := [m for m in months if not 1 <= counts.get(m, 0) < limit]:
        raise SourceError("preflight_failed", months=",".join(bad))
    if shutil.disk_usage(Path(root)).free < free_bytes:
        raise SourceError("disk_too_full", needed=free_bytes)
    out: list[dict[str, object]] = []
    made: list[str] = []
    last: float | None = None
    try:
        for month in months:
            if last is not None and (wait := last + pause - clock()) > 0:
                sleep(wait)
            last = clock()
            artifact = stream_artifact(fetch(month), root)
            if artifact.created:
                made.append(artifact.relative_path)
            out.append({"month": month, "preflight_count": counts[month], "artifact_sha256": artifact.sha256, "artifact_relative_path": artifact.relative_path, "artifact_byte_count": artifact.byte_count, "created": artifact.created})
    except BaseException:
        discard(root, made)
        raise
    return out


def discard(root: str, paths: Sequence[str]) -> None:
    """Remove artifacts that an unfinished run made."""
    for path in paths:
        trusted(path, root).unlink(missing_ok=True)


def git_lineage(root: str) -> tuple[str, bool]:
    """The commit that is checked out, and whether the working tree is clean."""

    def ask(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, timeout=60).stdout.strip()
        except (OSError, subprocess.SubprocessError) as error:
            raise SourceError("lineage_unavailable") from error

    sha = ask("rev-parse", "HEAD")
    if not re.fullmatch(r"[0-9a-f]{40}", sha):
        raise SourceError("lineage_unavailable")
    return sha, not ask("status", "--porcelain")


def retention_problem(manifest: Mapping[str, Column], *, policies: tuple[str, str], deadline: Column, now: Column, window: tuple[str, str]) -> Column:
    """The first retention rule that a batch manifest breaks, or null.

    manifest: columns is_synthetic, version, policy, expires, retrieved, clean, date_min, date_max. policies:
    those of synthetic and of real batches.
    """
    m = manifest
    no = F.lit(False)
    real = (
        F.when(m["version"] != "2.0.0", "real_version_unsupported")
        .when(m["policy"] != policies[1], "real_policy_invalid")
        .when(m["expires"].isNull(), "real_expiry_missing")
        .when(m["expires"] > deadline, "real_expiry_beyond_policy")
        .when((m["expires"] <= m["retrieved"]) | (now >= m["expires"]), "real_batch_expired")
        .when(~F.coalesce(m["clean"], no), "real_commit_not_clean")
        .when((m["date_min"] < window[0]) | (m["date_max"] > window[1]) | (m["date_min"] >= m["date_max"]), "real_request_outside_window")
    )
    synthetic = F.when(m["version"] != "1.0.0", "synthetic_version_unsupported").when(m["policy"] != policies[0], "synthetic_policy_invalid").when(m["expires"].isNotNull(), "synthetic_expiry_forbidden")
    return F.when(F.coalesce(m["is_synthetic"], no), synthetic).otherwise(real)


def cleanup(root: str, run_id: str, artifacts: Sequence[Mapping[str, object]], *, execute: bool = False, confirmation: str | None = None) -> list[dict[str, object]]:
    """What a run's artifacts are, and, executed with the run's id as confirmation, their removal.

    Only files whose bytes have the stated hash are removed; anything else stops the cleanup first.
    """
    if execute and confirmation != run_id:
        raise SourceError("cleanup_not_confirmed")
    plan = []
    for a in artifacts:
        place = trusted(str(a["relative_path"]), root)
        action = "absent" if not place.exists() else "delete" if file_sha256(place) == a["sha256"] else "differs"
        plan.append({"relative_path": a["relative_path"], "action": action})
    if execute:
        if any(p["action"] == "differs" for p in plan):
            raise SourceError("cleanup_artifact_differs")
        for p in plan:
            trusted(str(p["relative_path"]), root).unlink(missing_ok=True)
    return plan
