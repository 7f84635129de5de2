"""Parquet tables that only show complete batches.

Every attempt at a batch writes partitions of its own and is published last, by one small
row in the commit table that names the attempt. Readers keep committed attempts only, so a
job lost half-way leaves nothing visible, a second attempt touches nothing of the first,
and a published batch never changes.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas

LOGS = {
    "transactions": {**schemas.TRANSACTION_FIELDS, "batch_id": "string", "transaction_month": "string"},
    "pending_transactions": {
        "id": "string",
        "import_id": "string",
        "status": "string",
        "issues": f"array<{schemas.ISSUE}>",
        "candidate": schemas.CANDIDATE,
        "created_at": "timestamp",
        "resolved_at": "timestamp",
        "batch_id": "string",
    },
    "duplicate_candidates": {
        "import_id": "string",
        "existing_transaction_id": "string",
        "candidate_transaction_id": "string",
        "detection_strategy": "string",
        "status": "string",
        "fingerprint": "string",
        "candidate": "struct<" + ",".join(f"{k}:{v}" for k, v in schemas.TRANSACTION_FIELDS.items()) + ">",
        "created_at": "timestamp",
        "batch_id": "string",
    },
    "import_runs": {**schemas.IMPORT_RUN_FIELDS, "batch_id": "string"},
    "quarantine": {**schemas.QUARANTINE_FIELDS, "batch_id": "string"},
    "file_manifest": {**schemas.MANIFEST_FIELDS, "batch_id": "string"},
    "classification_decisions": {**schemas.DECISION_FIELDS, "batch_id": "string"},
    "review_events": {**schemas.REVIEW_EVENT_FIELDS, "batch_id": "string"},
    "classification_corrections": {**schemas.CORRECTION_FIELDS, "batch_id": "string"},
}

SNAPSHOTS = {
    "format_specs": schemas.SPEC_FIELDS,
    "categories": schemas.CATEGORY_FIELDS,
    "classification_rules": schemas.RULE_FIELDS,
}

COMMIT_FIELDS = {
    "batch_id": "string",
    "attempt": "string",
    "commit_seq": "bigint",
    "tables": "array<string>",
    "content": "string",
}


_BATCH_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,199}")


def check_batch_id(batch_id: str) -> str:
    """The id, which names folders: ValueError unless it is letters, digits and ``. _ -`` alone."""
    if not _BATCH_ID.fullmatch(batch_id or ""):
        raise ValueError(f"batch id {batch_id!r} may hold letters, digits and . _ - only, and starts with one of the first two")
    return batch_id


class BatchConflict(ValueError):
    """A batch id was published before with other content."""


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints.

    Without one, a private folder will do in local mode only: executors elsewhere would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="ledgerloom-")


def stage_shared(frame: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, survives lost executors."""
    path = f"{shared_folder(frame.sparkSession)}/scratch/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._attempts: dict[str, str] = {}

    @classmethod
    def scratch(cls, spark: SparkSession) -> "Store":
        """A store of its own in the shared folder, for one run."""
        return cls(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(target)

    def _empty(self, fields: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame([], schemas.ddl(fields))

    def commits(self) -> DataFrame:
        path = f"{self.root}/_commits"
        if not self._exists(path):
            return self._empty(COMMIT_FIELDS)
        return self.spark.read.schema(schemas.ddl(COMMIT_FIELDS)).parquet(path)

    def committed(self, batch_id: str, content: str | None = None) -> bool:
        """Whether the batch is published; BatchConflict if that was with other content."""
        check_batch_id(batch_id)
        known = self.commits().where(F.col("batch_id") == batch_id).select("content").first()
        if known is not None and content is not None and known.content != content:
            raise BatchConflict(f"batch {batch_id!r} was published with other content")
        return known is not None

    def attempt(self, batch_id: str) -> str:
        """The name of this object's attempt at a batch."""
        check_batch_id(batch_id)
        return self._attempts.setdefault(batch_id, uuid.uuid4().hex[:12])

    def read(self, table: str) -> DataFrame:
        """Committed rows; the batch filter prunes partitions."""
        fields = LOGS[table]
        path = f"{self.root}/{table}"
        if not self._exists(path):
            return self._empty(fields)
        rows = self.spark.read.schema(schemas.ddl({**fields, "attempt": "string"})).parquet(path)
        published = self.commits().where(F.array_contains("tables", table)).select("batch_id", "attempt")
        return rows.join(published, ["batch_id", "attempt"], "left_semi").select(*fields)

    def snapshot(self, table: str) -> DataFrame:
        """The version of a dimension written by the latest commit that holds it."""
        latest = (
            self.commits()
            .where(F.array_contains("tables", table))
            .agg(F.max_by(F.struct("batch_id", "attempt"), "commit_seq").alias("at"))
            .first()
        )
        if latest is None or latest["at"] is None:
            return self._empty(SNAPSHOTS[table])
        path = f"{self.root}/{table}/batch_id={latest['at'].batch_id}/attempt={latest['at'].attempt}"
        return self.spark.read.schema(schemas.ddl(SNAPSHOTS[table])).parquet(path)

    def stage(self, frame: DataFrame, batch_id: str, name: str) -> DataFrame:
        """Write and read back: cuts lineage, survives lost executors. Gone after the commit."""
        path = f"{self._staging(batch_id)}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def keep(self, frame: DataFrame, batch_id: str, name: str) -> None:
        """Keep a job's own result (refusals, a summary) with the batch."""
        frame.write.parquet(f"{self.root}/_results/{batch_id}/{self.attempt(batch_id)}/{name}")

    def kept(self, batch_id: str, name: str) -> DataFrame:
        """What keep() stored for the published attempt."""
        at = self.commits().where(F.col("batch_id") == batch_id).select("attempt").first().attempt
        return self.spark.read.parquet(f"{self.root}/_results/{batch_id}/{at}/{name}")

    def _staging(self, batch_id: str) -> str:
        return f"{self.root}/_staging/{batch_id}/{self.attempt(batch_id)}"

    def write(self, table: str, frame: DataFrame, batch_id: str) -> None:
        path = f"{self.root}/{table}/batch_id={batch_id}/attempt={self.attempt(batch_id)}"
        fields = LOGS.get(table) or SNAPSHOTS[table]
        columns = [c for c in fields if c not in ("batch_id", "transaction_month")]
        rows = frame.select(*[F.col(c).cast(fields[c]).alias(c) for c in columns])
        if "transaction_month" not in fields:
            rows.write.parquet(path)
            return
        # Rebalancing gathers a month's rows into few files and still splits a large month.
        months = rows.withColumn("transaction_month", F.date_format("transaction_date", "yyyy-MM"))
        months.hint("rebalance", "transaction_month").write.partitionBy("transaction_month").parquet(path)

    def clock(self) -> int:
        """The number the next commit gets."""
        return self.commits().agg(F.coalesce(F.max("commit_seq"), F.lit(0)).alias("n")).first().n + 1

    def commit(self, batch_id: str, tables: list[str], content: str = "") -> None:
        """Publish this attempt, once and for all. One writer at a time."""
        row = [(self.attempt(batch_id), self.clock(), tables, content)]
        self.spark.createDataFrame(row, "attempt string, commit_seq bigint, tables array<string>, content string").coalesce(
            1
        ).write.mode("error").parquet(f"{self.root}/_commits/batch_id={batch_id}")
        self.clear(batch_id)

    def clear(self, batch_id: str) -> None:
        """Drop the attempt's intermediate results and forget it."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self._staging(batch_id))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self._attempts.pop(batch_id, None)
