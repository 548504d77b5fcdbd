"""A background pass that generates in batches, each committed as it ends: it pauses between batches, in any session, and resumes after any of them."""

from __future__ import annotations

import threading
from contextlib import nullcontext
from typing import TYPE_CHECKING

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import cache as C
from graphloom.operators import passes
from graphloom.storage import cut, delete_path, discard

if TYPE_CHECKING:
    from graphloom.sources.tables import CacheTable
    from graphloom.streaming.state import Priority

#: Targets of a batch: what a lost driver can lose of a pass, and what a pause waits for.
BATCH_ROWS = 256
PAUSED = "the pass is paused"
MADE = "cache_key string, fn_id string, explanation_json string, fn_hash string, context_hash string, model_id string, embedding_model_id string, prompt_version string, context_tier string, generated_at string, error string, outcome string, finished_at timestamp"


class BackgroundPass:
    """Targets in order of importance, generated batch by batch by a stream over a queue of batches, whose checkpoint knows those that ended.

    The folder holds the planned targets, the queue, the checkpoint, and what each batch made. A batch is written there
    before it goes to the cache: a driver that is lost between the two asks no model again. Targets that the cache
    holds when their batch comes are skipped, those without a source are unresolved, failures are recorded and left.
    """

    def __init__(self, spark: SparkSession, folder: str, table: CacheTable, priority: Priority | None = None, **options: object) -> None:
        """priority: batches wait for interactive work. options: of passes.generate_rows (model, reason, timeout)."""
        self.spark, self.folder, self.table, self.priority, self.options = spark, folder.rstrip("/"), table, priority, options
        self.query: StreamingQuery | None = None
        self._limit: int | None = None
        self._lock = threading.Lock()

    def _at(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        p, fs = self._at(name)
        return bool(fs.exists(p))

    def _touch(self, name: str, text: str = "") -> None:
        p, fs = self._at(name)
        out = fs.create(p, True)
        out.write(text.encode())
        out.close()

    # -- plan

    def plan(self, targets: DataFrame, order: list[str], batch_rows: int = BATCH_ROWS) -> int:
        """Write targets(passes.wanted(), with_context(), order columns) and their queue; returns the number of batches. A folder that has a plan keeps it."""
        if not self._exists("queue/_PLANNED"):
            rows = C.numbered(targets, 0, order).withColumn("batch", F.floor((F.col("seq") - 1) / batch_rows).cast("long"))
            rows.repartition("batch").sortWithinPartitions("batch", "seq").write.mode("overwrite").partitionBy("batch").option("compression", "zstd").parquet(f"{self.folder}/targets")
            n = -(-self.targets().count() // batch_rows)
            for b in range(n):  # one small file a batch, in order: the stream takes the oldest first
                self._touch(f"queue/{b:09d}.json", f'{{"batch": {b}}}\n')
            self._touch("queue/_PLANNED", str(n))
        return self.batches()

    def batches(self) -> int:
        return int(self.spark.read.text(f"{self.folder}/queue/[0-9]*.json").count()) if self._exists("queue/000000000.json") else 0

    def targets(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/targets")

    # -- run

    def start(self, batches: int | None = None) -> StreamingQuery:
        """Run what is left, or so many batches of it and then pause. A pause of before ends."""
        self.resume()
        self._limit = batches
        queue = self.spark.readStream.schema("batch long").option("maxFilesPerTrigger", 1).json(f"{self.folder}/queue/[0-9]*.json")
        self.query = queue.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        return self.query

    def run(self, batches: int | None = None) -> bool:
        """start() and wait; returns whether the pass came to its end."""
        self.start(batches)
        return self.wait()

    def wait(self) -> bool:
        """Wait for the end of the pass (true) or a pause of it (false); a fault of the program is raised."""
        try:
            self.query.awaitTermination()
        except PySparkException as e:
            if PAUSED not in str(e):
                raise
            return False
        return True

    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def pause(self) -> None:
        """No further batch begins, in whichever session the pass runs; the current one ends and is kept."""
        self._touch("PAUSED")

    def resume(self) -> None:
        delete_path(self.spark, f"{self.folder}/PAUSED")

    def _step(self, queue: DataFrame, _: int) -> None:
        for b in sorted(r.batch for r in queue.collect()):  # one file of one row
            with self.priority.background() if self.priority else nullcontext(), self._lock:
                if self._limit is not None:
                    self._limit -= 1
                if self._exists("PAUSED") or self._limit is not None and self._limit < 0:
                    raise RuntimeError(PAUSED)
                self.generate(b)

    def generate(self, batch: int) -> None:
        """Make a batch, unless it is there already, and put it into the cache."""
        where = f"made/batch={batch}"
        if not self._exists(f"{where}/_SUCCESS"):
            own = cut(self.targets().filter(F.col("batch") == batch).drop("batch", "seq"), "batch")
            known, held = own.filter("fn_source IS NOT NULL"), self.table.read()
            made = passes.generate_rows(C.uncached(known, held), **self.options)
            made = made.withColumn("outcome", F.when(F.col("error").isNull(), "generated").otherwise("failed"))
            left = [C.cached(known, held).withColumn("outcome", F.lit("skipped")), own.filter("fn_source IS NULL").withColumn("outcome", F.lit("unresolved"))]
            for rows in left:
                made = made.unionByName(rows.select("fn_id", "fn_hash", "context_hash", "context_tier", *C.VERSION, "outcome"), allowMissingColumns=True)
            names = [c.split()[0] for c in MADE.split(", ")]
            made.withColumn("finished_at", F.current_timestamp()).select(*names).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{where}")
            discard(own)
        made = self.spark.read.schema(MADE).parquet(f"{self.folder}/{where}").filter("outcome = 'generated'")
        if made.head(1):
            self.table.write(made.drop("error", "outcome", "finished_at"))

    # -- what came of it

    def outcomes(self) -> DataFrame:
        """(batch, MADE) of the targets whose batch was made."""
        if not self._exists("made"):
            return self.spark.createDataFrame([], f"batch long, {MADE}")
        return self.spark.read.schema(f"{MADE}, batch long").parquet(f"{self.folder}/made")

    def counters(self) -> DataFrame:
        """One row: total, generated, skipped, unresolved, failed, percent (done of all)."""
        rest = self.targets().groupBy("batch").count().join(self.outcomes().select("batch").distinct(), "batch", "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rest"))
        done = passes.progress(self.outcomes().withColumn("pass", F.lit(1)), ["pass"]).drop("pass", "percent")
        out = done.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in done.columns]).withColumn("one", F.lit(1)).join(rest.withColumn("one", F.lit(1)), "one")  # one row each
        total = F.col("total") + F.col("rest")
        return out.select(total.alias("total"), "generated", "skipped", "unresolved", "failed", F.coalesce(F.floor(100.0 * F.col("total") / F.nullif(total, F.lit(0)) + 0.5), F.lit(100)).alias("percent"))

    def rate(self) -> DataFrame:
        """(batch, finished_at, rest, eta_ms): the targets that were left after each batch, and the time for as many batches at the rate of the five before."""
        done = self.outcomes().groupBy("batch").agg(F.count("*").alias("n"), F.max("finished_at").alias("finished_at")).withColumn("pass", F.lit(1))
        rows = done.join(self.targets().agg(F.count("*").alias("total")).withColumn("pass", F.lit(1)), "pass")  # a row a batch
        rows = rows.withColumn("rest", F.col("total") - F.sum("n").over(Window.partitionBy("pass").orderBy("batch")))
        return passes.rolling_eta(rows, "pass", ["batch"], F.unix_micros("finished_at"), F.col("rest")).select("batch", "finished_at", "rest", "eta_ms")
