"""Decisions over file manifests, releases and announcements."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import full_version, version_in_range

REMOTE = "corpus_version string, schema_version int, min_app_version string, built_at string, files array<struct<name:string,hash:string,size:bigint>>"
LOCAL = "corpus_version string, schema_version int, downloaded_at string, files map<string,struct<hash:string,size:bigint,complete:boolean>>"
RELEASES = "latest_version string, min_supported_version string, releases array<struct<version:string,released_at:string,required:boolean,notes:string,downloads:struct<windows:string,macos:string,linux:string>>>"
ANNOUNCEMENT = "id string, title string, body string, body_format string, type string, target string, min_app_version string, max_app_version string, starts_at string, expires_at string, priority string, dismissible boolean, show_once boolean, action struct<label:string,url:string>"


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """None where the file is missing or isn't such a manifest."""
    try:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
        return rows if rows.limit(1).count() else None
    except Exception:  # noqa: BLE001 - Spark raises many kinds for a missing or broken file
        return None


def remote_files(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.inline("files"))


def local_files(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("files").alias("name", "f")).select("name", "f.*")


def missing_files(remote: DataFrame, local: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """Remote files (name, hash, size) that aren't here whole: absent, unfinished, of another hash, or gone from disk (name)."""
    have = local.where(F.col("complete")).select("name", F.col("hash").alias("have"))
    if on_disk is not None:
        have = have.join(on_disk.select("name").distinct(), "name", "left_semi")
    return remote.join(have, "name", "left").where(F.col("have").isNull() | (F.col("have") != F.col("hash"))).select("name", "hash", "size")


def orphans(remote: DataFrame, local: DataFrame) -> DataFrame:
    return local.join(remote, "name", "left_anti")


def download_size(missing: DataFrame) -> DataFrame:
    return missing.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.array_sort(F.collect_list("name")).alias("names"))


@dataclass(frozen=True)
class CorpusStatus:
    ready: bool
    local_version: str | None = None
    remote_version: str | None = None
    update_available: bool = False
    update_required: bool = False
    missing_files: list[str] = field(default_factory=list)
    total_download_size: int = 0
    error: str | None = None


def _parsed(version: str) -> tuple[int, ...] | None:
    parts = version.split("-")[0].split(".")[:3]
    numbers = [int(x) for x in parts if re.fullmatch(r"\+?[0-9]+", x) and int(x) < 1 << 32]
    return tuple(numbers) if len(numbers) == 3 else None


def is_complete(local: DataFrame, on_disk: DataFrame) -> bool:
    """Whether every local file is finished and there."""
    return local.join(on_disk.select("name", F.lit(True).alias("here")).distinct(), "name", "left").where(~F.col("complete") | F.col("here").isNull()).isEmpty()


def corpus_status(remote: dict | None, local: dict | None, app_version: str, missing: tuple[int, list[str]] = (0, []), complete: bool = False, essential: bool = False, problem: str = "offline") -> CorpusStatus:
    """What the manifests and the disk say.

    ``missing`` is the size and the names of ``download_size``; ``complete`` that
    all local files are whole (``is_complete``); ``essential`` that a corpus lies
    on disk, with or without a manifest. Without a remote manifest ``problem`` is
    why there is none.
    """
    have = local["corpus_version"] if local else None
    if remote is None:
        if local and complete or essential:
            return CorpusStatus(True, have if local and complete else None, error=f"Could not check for updates: {problem}")
        return CorpusStatus(False, have, missing_files=["Unable to determine (offline)"], error=f"Could not fetch manifest: {problem}")
    app, least = _parsed(app_version), _parsed(remote["min_app_version"])
    if app and least and app < least:
        return CorpusStatus(False, have, remote["corpus_version"], update_required=True, error=f"App version {app_version} is too old. Please update to at least {remote['min_app_version']}")
    size, names = missing
    schema = bool(local) and local["schema_version"] != remote["schema_version"]
    newer = bool(local) and not schema and have != remote["corpus_version"]
    ready = not names and not schema if local else essential
    by_hand = ready and not local
    return CorpusStatus(ready, have, remote["corpus_version"], newer, schema, [] if by_hand else list(names), 0 if by_hand else size)


def update_status(releases: DataFrame, app_version: str, platform: str = "linux") -> DataFrame:
    """Whether a newer release exists, and whether it must be taken: below the least supported, or one since is required; notes and address are of the release listed first."""
    app, no = F.lit(app_version), F.lit(False)
    newer = lambda v: F.coalesce(full_version(v) > full_version(app), no)
    first = F.get("releases", F.lit(0))
    return releases.select(
        app.alias("current_version"), "latest_version", "min_supported_version",
        (newer(F.col("min_supported_version")) | F.coalesce(F.exists("releases", lambda r: newer(r["version"]) & r["required"]), no)).alias("update_required"),
        newer(F.col("latest_version")).alias("update_available"), first["notes"].alias("release_notes"), first["downloads"][platform].alias("download_url"),
    )


def eligible_announcements(table: DataFrame, dismissed: DataFrame, now: datetime.datetime, app_version: str, web: bool = False, skip_normal: bool = False) -> DataFrame:
    """Those to show now, by priority, then newest first."""
    at, when = F.lit(now).cast("timestamp"), lambda c: F.try_to_timestamp(c)
    rows = table.where(F.col("target").isin("all", "web" if web else "desktop"))
    rows = rows.where((when(F.col("starts_at")) <= at) & (F.col("expires_at").isNull() | (F.col("expires_at") == "") | (when(F.col("expires_at")) >= at)))
    if not web:
        rows = rows.where(version_in_range(F.lit(app_version), F.col("min_app_version"), F.col("max_app_version")))
    forced, important = F.col("priority") == "forced", F.col("priority") == "important"
    rows = rows.join(dismissed.select("id", F.lit(True).alias("gone")).distinct(), "id", "left")
    seen = F.coalesce("show_once", F.lit(False)) & F.col("gone").isNotNull()
    rows = rows.where(forced | (~seen & (important | F.lit(not skip_normal)))).drop("gone")
    rank = F.when(forced, 0).when(important, 1).when(F.col("priority") == "normal", 2).otherwise(3)
    return rows.orderBy(rank, when(F.col("starts_at")).desc(), "id")
