"""Tables that change together: each commit writes new data, then one manifest that names it all."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folders of a table by parts.
PART = "stored_part"


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


@dataclass(frozen=True)
class Parts:
    """What a commit makes of a table by parts: the parts replaced get those of rows whose column says so (a part without rows is gone), others stay as they lie."""

    rows: DataFrame
    column: str
    replaced: list[int]
    #: how many parts the table is dealt to; kept for those who add to it later
    of: int | None = None


@dataclass(frozen=True)
class Store:
    """A folder of table versions. What is read is the state of the last manifest: a run that ends before it has written its manifest changes nothing, however much data it has written.

    A source's batches have rising numbers, and the manifest keeps the last one of each source: a batch that comes again changes nothing.
    Two writers at once are not for this: the second one's manifest is refused, as that version exists.
    """

    spark: SparkSession
    path: str

    def manifest(self) -> dict:
        """version, tables (name: folder and schema), batches (source: number)."""
        try:
            rows = self.spark.read.schema("version long, content string").json(f"{self.path}/manifests/*").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException:
            rows = []
        return json.loads(rows[0].content) if rows else {"version": 0, "tables": {}, "batches": {}}

    def read(self, name: str, schema: str | None = None, parts: list[int] | None = None) -> DataFrame:
        """A table of the last version; where it has none, an empty one of the given schema. parts: of a table by parts, these alone (folders of others are not listed)."""
        held = self.manifest()["tables"].get(name)
        if held is None:
            if schema is None:
                raise KeyError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        if "parts" not in held:
            return self.spark.read.schema(held["schema"]).parquet(held["folder"])
        wanted = held["parts"] if parts is None else [str(p) for p in parts if str(p) in held["parts"]]
        paths = [f"{held['folders'][held['parts'][p]]}/{PART}={p}" for p in wanted]
        return self.spark.read.schema(held["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], held["schema"])

    def parts_of(self, name: str) -> int | None:
        return self.manifest()["tables"].get(name, {}).get("of")

    def seen(self, source: str, batch: int) -> bool:
        return self.manifest()["batches"].get(source, -1) >= batch

    def _with_parts(self, held: dict | None, change: Parts, folder: str) -> dict:
        """A table's entry after its replaced parts were written to folder; which of them have rows passes through the driver, at most as many as there are parts."""
        rows = change.rows.where(F.col(change.column).isin(change.replaced)).withColumn(PART, F.col(change.column))
        # large parts are written by several tasks, small ones together
        rows.hint("rebalance", PART).write.partitionBy(PART).parquet(folder)
        schema = _ddl(change.rows)
        filled = [r[0] for r in self.spark.read.schema(f"{schema}, {PART} long").parquet(folder).select(PART).distinct().collect()]
        before = held or {"parts": {}, "folders": [], "of": change.of}
        at = {p: before["folders"][k] for p, k in before["parts"].items() if int(p) not in set(change.replaced)} | {str(p): folder for p in filled}
        folders = sorted(set(at.values()))
        number = {f: k for k, f in enumerate(folders)}
        return {"schema": schema, "folders": folders, "parts": {p: number[f] for p, f in at.items()}, "of": before["of"]}

    def commit(self, tables: dict[str, DataFrame], source: str | None = None, batch: int | None = None, parts: dict[str, Parts] | None = None) -> bool:
        """Replace the named tables, and parts of tables by parts, at once; others stay. False if the source's batch was committed before."""
        before = self.manifest()
        if source is not None and batch is not None and before["batches"].get(source, -1) >= batch:
            return False
        after = {"version": before["version"] + 1, "tables": dict(before["tables"]), "batches": dict(before["batches"])}
        for name, df in tables.items():
            folder = f"{self.path}/data/{name}-{after['version']}-{uuid.uuid4().hex}"
            df.write.parquet(folder)
            after["tables"][name] = {"folder": folder, "schema": _ddl(df)}
        for name, change in (parts or {}).items():
            after["tables"][name] = self._with_parts(before["tables"].get(name), change, f"{self.path}/data/{name}-{after['version']}-{uuid.uuid4().hex}")
        if source is not None and batch is not None:
            after["batches"][source] = batch
        row = self.spark.createDataFrame([(after["version"], json.dumps(after))], "version long, content string")
        row.coalesce(1).write.mode("error").json(f"{self.path}/manifests/{after['version']:012d}")
        return True

    def vacuum(self) -> int:
        """Delete data that the last manifest does not name, and earlier manifests; returns how many folders went. Not while someone reads an earlier version."""
        held = self.manifest()
        named = [f for t in held["tables"].values() for f in (t["folders"] if "parts" in t else [t["folder"]])]
        keep = {f.rstrip("/").rsplit("/", 1)[-1] for f in named} | {f"{held['version']:012d}"}
        jvm, conf, gone = self.spark.sparkContext._jvm, self.spark._jsparkSession.sessionState().newHadoopConf(), 0
        for part in ("data", "manifests"):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            system = folder.getFileSystem(conf)
            for status in system.listStatus(folder) if system.exists(folder) else []:
                if status.getPath().getName() not in keep:
                    gone += bool(system.delete(status.getPath(), True))
        return gone
