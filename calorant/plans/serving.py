"""Versioned publication: copies by version, a manifest whose marker comes last, retention.

A version is a folder of Parquet; readers find it through the manifest alone, so a version is either
wholly visible or not at all. A marker is taken back by a later row of status retired; the manifest
is only ever appended to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from calorant.operators import relations
from calorant.plans.folders import settled

MANIFEST = "version_id string, status string, published_at timestamp_ntz, row_count long, key_count long, content_sum string, base_version string"


def latest_ready(published: DataFrame, markers: DataFrame) -> DataFrame:
    """The newest version with a ready marker; repeated markers count once."""
    ready = markers.where("status = 'ready'").select("version_id").distinct()
    return published.join(ready, "version_id").orderBy(F.desc("published_at"), F.desc("version_id")).limit(1)


def retention_plan(versions: DataFrame, keep: int, protected: list = ()) -> DataFrame:
    """version_id, published_at and action: keep for the newest, two at least, protected, or delete.

    Versions are few (a manifest), so ranking them in one partition is bounded by their number.
    """
    rank = F.row_number().over(Window.orderBy(F.desc("published_at"), F.desc("version_id")))
    ranked = versions.withColumn("_rank", rank)
    action = F.when(F.col("_rank") <= max(2, keep), "keep").when(F.col("version_id").isin(*protected) if len(protected) else F.lit(False), "protected").otherwise("delete")
    return ranked.select("version_id", "published_at", action.alias("action"))


class Snapshots:
    """Snapshots of one table under a root folder."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], date: str):
        self.spark, self.root, self.keys, self.date = spark, root, keys, date

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def ready(self) -> DataFrame:
        """Markers that stand."""
        m = self.manifest()
        return m.where("status = 'ready'").join(m.where("status = 'retired'").select("version_id").distinct(), "version_id", "left_anti").select(*m.columns)

    def _mark(self, rows: list[tuple]) -> None:
        text = MANIFEST.replace("published_at timestamp_ntz", "published_at string")
        self.spark.createDataFrame(rows, text).withColumn("published_at", F.col("published_at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _folders(self) -> dict[str, object]:
        """Version folders that exist, marked or not, as Hadoop paths; few, like the manifest."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        fs = path.getFileSystem(conf)
        return {f.getPath().getName(): f.getPath() for f in fs.listStatus(path)} if fs.exists(path) else {}

    def readiness(self) -> dict:
        """Whether the newest version's rows are as many as its marker says, with both counts and its time of publication."""
        found = self.ready().orderBy(F.desc("published_at"), F.desc("version_id")).limit(1).collect()
        if not found:
            return {"ready": False, "reason": "no_ready_version"}
        try:
            actual = self.spark.read.parquet(f"{self.root}/versions/{found[0].version_id}").count()
        except AnalysisException:
            return {"ready": False, "reason": "version_unavailable", "version_id": found[0].version_id}
        same = actual == found[0].row_count
        return {"ready": same, "reason": "ready" if same else "row_count_mismatch", "version_id": found[0].version_id, "published_at": found[0].published_at, "expected_rows": found[0].row_count, "actual_rows": actual}

    def cleanup(self, keep: int = 2, apply: bool = False, locked: bool = False, protected: tuple[str, ...] = ()) -> dict:
        """What goes: ready versions beyond the newest `keep` (two at least) and folders without a marker. Done only if asked to apply.

        Markers are taken back before any folder goes, so a run that breaks off leaves invisible
        folders that the next one finds. Refuses if a protected version isn't among those kept, or if
        it is to apply without the writers' lock (`locked`).
        """
        if keep < 2:
            raise ValueError("two ready versions at least are kept")
        if apply and not locked:
            raise ValueError("the writers' lock must be held to apply a cleanup")
        ready = [r.version_id for r in self.ready().orderBy(F.desc("published_at"), F.desc("version_id")).select("version_id").collect()]
        kept, retired = ready[:keep], ready[keep:]
        if missing := set(protected) - set(kept):
            raise ValueError(f"protected versions are missing or would go: {', '.join(sorted(missing))}")
        folders = self._folders()
        invisible = sorted(set(folders) - set(ready))
        plan = {"kept": kept, "retired": retired, "invisible": invisible}
        if not apply:
            return plan | {"disposition": "planned"}
        if not retired and not invisible:
            return plan | {"disposition": "nothing_to_remove"}
        if retired:
            self._mark([(v, "retired", None, None, None, None, None) for v in retired])
        if {r.version_id for r in self.ready().select("version_id").collect()} != set(kept):
            raise RuntimeError("markers changed during the cleanup; no folder was removed")
        for v in [*retired, *invisible]:
            if v in folders:
                folders[v].getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folders[v], True)
        if left := set(self._folders()) & {*retired, *invisible}:
            raise RuntimeError(f"folders are left, run again: {', '.join(sorted(left))}")
        return plan | {"disposition": "removed"}

    def read(self, version: str | None = None) -> DataFrame | None:
        """A published version, the newest by default; None if there is none."""
        m = self.ready()
        found = (m if version is None else m.where(F.col("version_id") == version)).orderBy(F.desc("published_at"), F.desc("version_id")).limit(1).collect()
        return self.spark.read.parquet(f"{self.root}/versions/{found[0].version_id}") if found else None

    def publish(self, version: str, df: DataFrame, published_at: str) -> dict:
        """Publish df as a version: changes against the newest one are applied to its copy and verified.

        Gives the counts of changes, and reused=True if nothing changed: then nothing is written. Rows
        are compared by key, column by column. A version id that was ever marked is refused.
        """
        if version in {r.version_id for r in self.manifest().select("version_id").distinct().collect()}:
            raise ValueError(f"version {version} has been published; its folder isn't written again")
        newest = self.ready().orderBy(F.desc("published_at"), F.desc("version_id")).limit(1).collect()
        base, counts = self.read(), {}
        path = f"{self.root}/versions/{version}"
        if base is None:
            df.write.mode("overwrite").parquet(path)
        else:
            changes = settled(relations.compared(base, df, self.keys), "changes")
            counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
            if set(counts) <= {"unchanged"}:
                return {"reused": True, "version_id": newest[0].version_id}
            relations.applied(base, df, changes, self.keys).write.mode("overwrite").parquet(path)
        stored = self.spark.read.parquet(path)
        if relations.compared(stored, df, self.keys).where("change <> 'unchanged'").limit(1).count():
            raise RuntimeError(f"version {version} doesn't hold what was to be published")
        got = relations.profile(stored, self.keys, self.date).first()
        self._mark([(version, "ready", published_at, got.row_count, got.key_count, got.content_sum, newest[0].version_id if newest else None)])
        return {"reused": False, "version_id": version, "counts": counts}
