"""The result table: an append-only log of deliveries and snapshots made from it.

Plain parquet cannot update rows in place. Deliveries are therefore appended, one folder
per source and micro-batch, and a snapshot holds the upserted rows of everything up to
some batch of every source. A batch that is run again overwrites its own folder, and an
upsert of the same delivery twice changes nothing, so redelivery at any point is safe.

    <root>/deliveries/source=<queue>/batch_id=<n>/outcome=accepted|rejected/
    <root>/refused/...                        rejected rows of batches that were retired
    <root>/snapshots/version=<k>/covered/     (source, upto)
    <root>/snapshots/version=<k>/rows/        result rows + places of first and last delivery; written last
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaymill.functions.interleave import boundaries, interleaved, part_of
from relaymill.operators import persist
from relaymill.schema import KEPT, OVERWRITTEN, PROCESSED
from relaymill.sources import files
from relaymill.sources.queues import ACCEPTED, REJECTED, with_outcome

_DELIVERED = [f for f in PROCESSED.fields if f.name != "id"]
DELIVERY = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        *[T.StructField(f.name, f.dataType) for f in _DELIVERED],
        T.StructField("reject_stage", T.IntegerType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("outcome", T.StringType()),
    ]
)
_PLACE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("seq", "position", "batch_id", "content")]
)
_SNAPSHOT = T.StructType(
    [*PROCESSED.fields, T.StructField("first_at", _PLACE), T.StructField("last_at", _PLACE)]
)


# How finely snapshots are laid out by these columns, in bits: enough for some thousand files.
_LAYOUT = {"flow_id": 1, "item_id": 6, "created_at": 6}


def declared_columns() -> str:
    """The columns of the result table as a declaration."""
    return ", ".join(
        f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
        for f in PROCESSED.fields
    )


def create_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Declare the result table in the catalog unless it is there.

    Spark's own catalog takes NOT NULL for tables of files but does not keep it; catalogs of
    other table formats do. The rule itself is checked before the upsert.
    """
    database = name.rpartition(".")[0]
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({declared_columns()}) USING parquet{place}")


def merge_statement(table: str, source: str, collation: str | None = None) -> str:
    """MERGE of a batch of table rows; under a collation ids match by their normal keys."""
    rules = set((collation or "").upper().split("_"))

    def key(side: str) -> str:
        found = f"{side}.message_id"
        found = f"rtrim({found})" if "RTRIM" in rules else found
        return f"lower(upper({found}))" if rules & {"CI", "LCASE"} else found

    update = ", ".join(f"{c} = s.{c}" for c in OVERWRITTEN)
    columns = ", ".join(PROCESSED.names)
    values = ", ".join(f"s.{c}" for c in PROCESSED.names)
    return (
        f"MERGE INTO {table} t USING {source} s ON {key('t')} = {key('s')} "
        f"WHEN MATCHED THEN UPDATE SET {update} "
        f"WHEN NOT MATCHED THEN INSERT ({columns}) VALUES ({values})"
    )


def merge_into(spark: SparkSession, rows: DataFrame, table: str, collation: str | None = None) -> None:
    """Upsert one batch into a table whose format supports MERGE (Delta, Iceberg, ...).

    The batch is reduced to one row per id first; across batches, arrival order is the
    order in which they are merged. Not run here: no such format is installed.
    """
    persist.upsert(rows, collation).createOrReplaceTempView("_relaymill_batch")
    spark.sql(merge_statement(table, "_relaymill_batch", collation))


class ProcessedTable:
    """Result table under a folder on the shared file system.

    ``collation`` compares message ids under that collation, as a database may; all uses of
    a table must name the same one.
    """

    def __init__(self, spark: SparkSession, root: str, collation: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.collation = collation

    # --- writing -------------------------------------------------------------------

    def deliver(self, rows: DataFrame, source: str, batch_id: int) -> None:
        """Store one micro-batch of ``to_rows`` output, refused rows apart."""
        if "body" not in rows.columns:
            rows = rows.withColumn("body", F.lit(None).cast("string"))
        if "position" not in rows.columns:
            rows = rows.withColumn("position", F.lit(0).cast("bigint"))
        own = [n for n in DELIVERY.names if n not in ("source", "batch_id")]
        (
            with_outcome(rows)
            .select(*own)
            .write.mode("overwrite")
            .partitionBy("outcome")
            .parquet(f"{self._log()}/source={source}/batch_id={batch_id}")
        )

    def compact(self) -> int:
        """Write a new snapshot of every complete batch; returns its version.

        Rows are ranged by the interleaved places of flow, item and time, so filters on any
        of them skip most files by their min/max, and lookups by message_id use the bloom
        filters. ``id`` is unique, so equal places cannot pile up in one range.
        """
        covered = self._covered() | self._complete_batches()
        version = self.version() + 1
        target = self._snapshot_path(version)
        self.spark.createDataFrame(
            list(covered.items()), "source string, upto bigint"
        ).coalesce(1).write.mode("overwrite").parquet(f"{target}/covered")
        place = self._place()
        rows = persist.table_rows(persist.merge_states(self._states()), with_places=True)
        order = ("_place", "created_at", "id", "position")
        (
            rows.withColumn("_place", place)
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .drop("_place")
            .write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#message_id", "true")
            .option("parquet.bloom.filter.enabled#item_id", "true")
            .parquet(f"{target}/rows")
        )
        return version

    def compact_if_due(self, share: float = 0.25) -> bool:
        """Make a snapshot once the new deliveries are that share of the last one. A snapshot
        costs what the whole table does; this way that stays in proportion to the deliveries,
        and ``current`` merges the few that wait."""
        new = self._new_deliveries().count()
        due = new > share * (self._snapshot().count() if self.version() else 0)
        if due:
            self.compact()
        return due

    def _place(self) -> Column:
        """Where a row lies in the layout. The bounds come from plain scans of two columns."""
        stored = self._new_deliveries().select(*_LAYOUT)
        if self.version():
            stored = stored.unionByName(self._snapshot().select(*_LAYOUT))
        bounds = boundaries(stored, _LAYOUT)
        return interleaved(
            [(part_of(F.col(c).cast("bigint"), bounds[c]), bits) for c, bits in _LAYOUT.items()]
        )

    def retire(self, versions: int = 2) -> None:
        """Remove snapshots but for the newest ``versions``, and the batches that the oldest of
        these covers; what they rejected is kept apart. Run it while nobody reads old
        versions."""
        newest = self.version()
        oldest = max(1, newest - versions + 1)
        for name in files.partition_values(self.spark, f"{self.root}/snapshots", "version"):
            if int(name) < oldest:
                files.remove(self.spark, self._snapshot_path(int(name)))
        if newest:
            for source, upto in self._covered(oldest).items():
                folder = f"{self._log()}/source={source}"
                for batch in files.partition_values(self.spark, folder, "batch_id"):
                    if int(batch) <= upto:
                        place = f"source={source}/batch_id={batch}"
                        refused = f"{place}/outcome={REJECTED}"
                        if files.exists(self.spark, f"{self._log()}/{refused}"):
                            files.move(self.spark, f"{self._log()}/{refused}", f"{self.root}/refused/{refused}")
                        files.remove(self.spark, f"{self._log()}/{place}")

    def publish_as(self, name: str) -> None:
        """Let a catalog name stand for the newest snapshot, as declared by ``create_table``."""
        location = f"{self._snapshot_path(self.version())}/rows"
        create_table(self.spark, name, location)
        # a table that was there shows the new files from one statement to the next
        self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")

    # --- reading -------------------------------------------------------------------

    def version(self) -> int:
        """Newest complete snapshot, 0 before the first."""
        found = files.partition_values(self.spark, f"{self.root}/snapshots", "version")
        done = [
            int(v)
            for v in found
            if files.is_complete(self.spark, f"{self._snapshot_path(int(v))}/rows")
        ]
        return max(done, default=0)

    def scan(self) -> DataFrame:
        """Rows as of the newest snapshot: a plain scan with pruning and pushdown."""
        return self._snapshot().select(*PROCESSED.names)

    def current(self) -> DataFrame:
        """Rows including deliveries since the newest snapshot.

        Only ids touched since then are merged. Spark broadcasts the new ids where their
        measured size allows it, and then the snapshot is not shuffled.
        """
        fresh = persist.upsert_state(self._new_deliveries(), self.collation)
        if self.version() == 0:
            return persist.table_rows(fresh)
        old = persist.states_of(self._snapshot(), self.collation)
        touched_ids = fresh.select("_key")
        untouched = old.join(touched_ids, "_key", "left_anti")
        touched = old.join(touched_ids, "_key", "left_semi")
        merged = persist.merge_states(touched.unionByName(fresh))
        return persist.table_rows(untouched).unionByName(persist.table_rows(merged))

    def deliveries(self) -> DataFrame:
        """Accepted deliveries, all of them, in the form ``upsert`` takes."""
        return self._read_log().where(F.col("outcome") == ACCEPTED)

    def rejected(self) -> DataFrame:
        """Deliveries the last stage refused."""
        found = self._read_log()
        if files.exists(self.spark, f"{self.root}/refused"):
            found = found.unionByName(self.spark.read.schema(DELIVERY).parquet(f"{self.root}/refused"))
        return found.where(F.col("outcome") == REJECTED).select(
            "seq", F.col("reject_stage").alias("stage"), F.col("reject_reason").alias("reason"), "body"
        )

    # --- layout --------------------------------------------------------------------

    def _log(self) -> str:
        return f"{self.root}/deliveries"

    def _snapshot_path(self, version: int) -> str:
        return f"{self.root}/snapshots/version={version}"

    def _complete_batches(self) -> dict[str, int]:
        """Per source the last batch such that it and all before it are complete. A
        streaming query writes its batches one after the other, so this is a prefix.

        One listing finds what is complete; batches that the newest snapshot covers are not
        looked at again.
        """
        covered = self._covered()
        done: dict[str, set[int]] = {}
        for path in files.complete(self.spark, f"{self._log()}/source=*/batch_id=*"):
            source, batch = path.rstrip("/").split("/")[-2:]
            done.setdefault(source.partition("=")[2], set()).add(int(batch.partition("=")[2]))
        upto: dict[str, int] = {}
        for source in files.partition_values(self.spark, self._log(), "source"):
            folder = f"{self._log()}/source={source}"
            found = sorted(int(b) for b in files.partition_values(self.spark, folder, "batch_id"))
            new = [b for b in found if b > covered.get(source, -1)]
            complete = done.get(source, set())
            if new and not complete:
                raise ValueError(f"no batch of {source} bears a mark of completion (_SUCCESS)")
            gap = next((b for b in new if b not in complete), None)
            before = [b for b in new if gap is None or b < gap]
            if before:
                upto[source] = before[-1]
        return upto

    def _covered(self, version: int | None = None) -> dict[str, int]:
        version = self.version() if version is None else version
        if version == 0:
            return {}
        # one row per source queue
        rows = self.spark.read.parquet(f"{self._snapshot_path(version)}/covered").collect()
        return {r["source"]: r["upto"] for r in rows}

    def _read_log(self) -> DataFrame:
        return self.spark.read.schema(DELIVERY).parquet(self._log())

    def _new_deliveries(self) -> DataFrame:
        """Accepted deliveries of complete batches after the newest snapshot; the filter
        is on folder names and prunes the rest."""
        covered, complete = self._covered(), self._complete_batches()
        wanted = F.lit(False)
        for source, upto in complete.items():
            wanted = wanted | (
                (F.col("source") == source)
                & (F.col("batch_id") > covered.get(source, -1))
                & (F.col("batch_id") <= upto)
            )
        return self.deliveries().where(wanted)

    def _snapshot(self) -> DataFrame:
        path = f"{self._snapshot_path(self.version())}/rows"
        return self.spark.read.schema(_SNAPSHOT).parquet(path)

    def _states(self) -> DataFrame:
        fresh = persist.upsert_state(self._new_deliveries(), self.collation)
        if self.version() == 0:
            return fresh
        return persist.states_of(self._snapshot(), self.collation).unionByName(fresh)
