"""References to records that do not exist, kept up to date as rows arrive.

State of the ledger, all of it written tables in the shared folder:

* the parent index: what arrived in each period, versions of targets with their key, loaded_at and deleted_at. It is only
  appended to; when there are ``fanout`` tables they are put together into one. A deletion is one more entry of its version;
* the references that wait for a target; the only table that is rewritten each step;
* the references that came in each period, with the time of the latest. They are read again only for a deletion that is
  not later than that.

A step takes the rows of one period. New references probe the parent index; arriving parents are matched with the
references that wait for their keys; a deletion that becomes known looks at the references of its key and puts those that
lost their last target among the waiting ones. References whose key was not touched in the period are not probed.  All of
these are probed together, by one anti join whose two sides adaptive execution may split, so a key with very many references
makes no long task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import WHITE_SPACE
from ..plans.workspace import Workspace

PARENT_SCHEMA = "field string, version long, key string, loaded_at timestamp, deleted_at timestamp"
REFERENCE_SCHEMA = "table_name string, field string, row_id long, key string, loaded_at timestamp"


def reference_key(c: Column | str) -> Column:
    """A key without surrounding white space and in lower case; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    # trim() with a set of characters works from both ends and leaves inner white space alone
    s = F.lower(F.trim(c, F.lit(WHITE_SPACE)))
    return F.when(s != "", s)


class OrphanLedger:
    """Orphan references per table and field.

    A parent version counts for a reference loaded at L if it was loaded at most ``grace_days`` after L and is
    not deleted, or deleted later than L. Entries of one version add up: the earliest deletion holds. References with a null
    key or loaded_at are no case, and parents with a null key or loaded_at never count. The same reference delivered twice in
    a period is one reference.

    ``path``: folder to keep the ledger in; one that lies there is opened. A step writes new tables, then a note that names
    them, and only then removes those replaced, so a step that fails leaves the ledger as it was, and a period that was taken is
    not taken again.
    """

    def __init__(self, spark: SparkSession, grace_days: int = 7, fanout: int = 8, path: str | None = None):
        self.spark = spark
        self.ws = Workspace(spark, "orphans", path)
        self.state = self.ws.noted() or {"grace_days": int(grace_days), "fanout": fanout, "parents": [], "references": [], "waiting": None, "periods": [], "snapshots": []}

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*map(self.ws.where, names)) if names else self.spark.createDataFrame([], schema)

    def _orphans_of(self, refs: DataFrame, entries: DataFrame) -> DataFrame:
        """The references without a parent that counts; never multiplies rows."""
        closed = entries.where("deleted_at is not null").groupBy(F.col("field").alias("__cf"), F.col("version").alias("__cv")).agg(F.min("deleted_at").alias("__to"))
        parents = entries.selectExpr("field as __f", "version as __v", "key as __k", "loaded_at as __from").join(closed, (F.col("__f") == F.col("__cf")) & (F.col("__v") == F.col("__cv")), "left")
        counts = (
            (F.col("field") == F.col("__f"))
            & (F.col("key") == F.col("__k"))
            & (F.col("__from") <= F.col("loaded_at") + F.expr(f"interval {self.state['grace_days']} days"))
            & (F.col("__to").isNull() | (F.col("__to") > F.col("loaded_at")))
        )
        return refs.join(parents, counts, "left_anti")

    def advance(self, period: str, references: DataFrame, parents: DataFrame) -> None:
        """Take what arrived in a period.

        ``references``: REFERENCE_SCHEMA. ``parents``: PARENT_SCHEMA; a deletion becomes known by one more entry of the version
        with its deleted_at.
        """
        if period in self.state["periods"]:
            return
        tag, usable = uuid.uuid4().hex[:12], "key is not null and loaded_at is not null"
        # what is new in a step is read several times
        fresh = self.ws.write(references.select("table_name", "field", "row_id", "key", "loaded_at").where(usable).distinct(), f"fresh-{tag}")
        arrived = parents.where(usable).groupBy("field", "version", "key").agg(F.min("loaded_at").alias("loaded_at"), F.min("deleted_at").alias("deleted_at"))
        arrived = self.ws.write(arrived, f"arrived-{tag}")
        facts = fresh.select(F.col("loaded_at").alias("l"), F.lit(None).cast("timestamp").alias("d")).unionByName(arrived.select(F.lit(None).cast("timestamp").alias("l"), F.col("deleted_at").alias("d")))
        facts = facts.agg(F.max(F.unix_micros(F.col("l").cast("timestamp"))).alias("latest"), F.min(F.unix_micros(F.col("d").cast("timestamp"))).alias("deleted"), F.count(F.lit(1)).alias("n")).first()

        state = {**self.state, "periods": [*self.state["periods"], period], "parents": [*self.state["parents"], f"arrived-{tag}"]}
        gone = []
        if len(state["parents"]) > state["fanout"]:
            self.ws.write(self._read(state["parents"], PARENT_SCHEMA), f"index-{tag}")
            gone, state["parents"] = state["parents"], [f"index-{tag}"]
        looked, untouched, waiting = fresh, None, self.state["waiting"]
        if waiting is not None:
            before, keys = self._read([waiting], REFERENCE_SCHEMA), arrived.select("field", "key").distinct()
            looked = looked.unionByName(before.join(keys, ["field", "key"], "left_semi").select(*fresh.columns))
            untouched = before.join(keys, ["field", "key"], "left_anti").select(*fresh.columns)
        if facts.deleted is not None:
            # only references that came no earlier than the deletion can lose their target by it
            lost = [n for n, latest in self.state["references"] if latest is not None and latest >= facts.deleted]
            if lost:
                removed = arrived.where("deleted_at is not null").select("field", "key").distinct()
                looked = looked.unionByName(self._read(lost, REFERENCE_SCHEMA).join(removed, ["field", "key"], "left_semi").select(*fresh.columns))
        if facts.n or waiting is None:
            still = self._orphans_of(looked, self._read(state["parents"], PARENT_SCHEMA))
            still = self.ws.write((still if untouched is None else still.unionByName(untouched)).distinct(), f"waiting-{tag}")
            state["waiting"], gone = f"waiting-{tag}", [*gone, *([waiting] if waiting else [])]
            counts = still.groupBy("table_name", "field").count().collect()  # one row per table and field
            state["open"] = [(r["table_name"], r["field"], r["count"]) for r in counts]
        state["references"] = [*self.state["references"], (f"fresh-{tag}", facts.latest)]
        state["snapshots"] = [*self.state["snapshots"], *((period, *c) for c in state["open"])]
        self.ws.note(state)
        self.state = state
        for n in gone:
            self.ws.drop(n)

    def orphans(self) -> DataFrame:
        """References without a target as of the last step: table_name, field, row_id, month_key of their loaded_at."""
        waiting = self.state["waiting"]
        found = self._read([waiting] if waiting else [], REFERENCE_SCHEMA)
        return found.select("table_name", "field", "row_id", F.date_format("loaded_at", "yyyy-MM").alias("month_key")).distinct()

    def history(self) -> DataFrame:
        """Number of open references after each step."""
        return self.spark.createDataFrame([tuple(s) for s in self.state["snapshots"]], "period string, table_name string, field string, n_open long")


def replay(ledger: OrphanLedger, references: DataFrame, parents: DataFrame) -> OrphanLedger:
    """Run whole tables through a ledger month by month, in order of loaded_at; deletions in the month of deleted_at.

    A parent enters the index without its deleted_at if that falls in a later month. Months, not rows, are
    brought to the driver.
    """
    ws, month = ledger.ws, lambda c: F.date_format(c, "yyyy-MM")
    p = parents.where("loaded_at is not null")
    later = month("deleted_at") > month("loaded_at")
    p = p.withColumn("month", month("loaded_at")).withColumn("deleted_at", F.when(~F.coalesce(later, F.lit(False)), F.col("deleted_at"))).unionByName(
        p.where(later).withColumn("month", month("deleted_at"))
    )
    r = references.where("loaded_at is not null").withColumn("month", month("loaded_at"))
    # few files a month, however many the input has; a month too large for one task is split
    p, r = ws.write(p.hint("rebalance", "month"), "all-parents", ["month"]), ws.write(r.hint("rebalance", "month"), "all-references", ["month"])
    months = sorted({x.month for t in (p, r) for x in t.select("month").distinct().collect()})
    for m in months:
        ledger.advance(m, r.where(F.col("month") == m).drop("month"), p.where(F.col("month") == m).drop("month"))
    return ledger
