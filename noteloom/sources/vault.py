"""Files of a vault as a data source: read by partitions, and written, replaced and deleted in one commit."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.columns import note_path

#: Folders within the vault: what tasks have written, and what a commit is bringing to its place.
PENDING, READY = ".pending", ".ready"
#: Files that a task reads.
FILES = 1000


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    folder: str


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.vault, self.pattern, self.files = Path(options["path"]), options.get("pattern", "**/*"), int(options.get("files", FILES))

    def partitions(self) -> list[Files]:
        """Only names pass through the driver."""
        found = sorted(str(p.relative_to(self.vault)) for p in self.vault.glob(self.pattern) if p.is_file() and p.relative_to(self.vault).parts[0] not in (PENDING, READY))
        return [Files(found[at : at + self.files]) for at in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, bytes, bool]]:
        for path in partition.paths:
            yield path, (self.vault / path).read_bytes(), False


class Writer(DataSourceWriter):
    """A task writes into a folder of its own. A commit first gives the whole run its final name, in one step, then brings all files to their places; what ends
    before that step leaves nothing, and what ends after it is brought to an end by recover()."""

    def __init__(self, options: dict[str, str]):
        self.vault, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = uuid.uuid4().hex
        own = Path(self.vault) / PENDING / self.run / folder
        own.mkdir(parents=True)
        with open(own / "deleted", "w", encoding="utf-8") as deleted:
            for row in iterator:
                path = PurePosixPath(row.path)
                if path.is_absolute() or not path.parts or ".." in path.parts or path.parts[0] in (PENDING, READY) or "\n" in row.path:
                    raise ValueError(f"no path within the vault: {row.path!r}")
                if row.content is None:
                    deleted.write(f"{path}\n")
                    continue
                file = own / ("new" if row.keep else "any") / path
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_bytes(row.content)
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        run, done = Path(self.vault) / PENDING / self.run, {m.folder for m in messages if m}
        if not run.exists():
            return
        for other in run.iterdir():  # of attempts that were given up
            if other.name not in done:
                shutil.rmtree(other)
        (Path(self.vault) / READY).mkdir(exist_ok=True)
        ready = Path(self.vault) / READY / self.run
        os.replace(run, ready)
        bring(self.vault, ready)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(Path(self.vault) / PENDING / self.run, ignore_errors=True)


def bring(vault: str, ready: Path) -> None:
    """Deletions, then files to their places. Each step may be done again."""
    for task in ready.iterdir():
        gone = task / "deleted"
        for path in gone.read_text(encoding="utf-8").split("\n")[:-1] if gone.exists() else ():
            (Path(vault) / path).unlink(missing_ok=True)
    for task in ready.iterdir():
        for kind in ("new", "any"):
            for file in sorted((task / kind).rglob("*")):
                if file.is_file():
                    place = Path(vault) / file.relative_to(task / kind)
                    place.parent.mkdir(parents=True, exist_ok=True)
                    if kind == "any" or not place.exists():
                        os.replace(file, place)
    shutil.rmtree(ready)


def recover(vault: str) -> int:
    """Bring commits to an end that were broken off, and delete what runs without a commit have left; returns how many commits. Not while someone writes."""
    left = sorted((Path(vault) / READY).glob("*"))
    for run in left:
        bring(vault, run)
    shutil.rmtree(Path(vault) / PENDING, ignore_errors=True)
    return len(left)


class VaultFiles(DataSource):
    """path (within the vault), content (null: to be deleted), keep (whether a file that is there stays). The vault is a folder that the driver and all tasks see."""

    @classmethod
    def name(cls) -> str:
        return "vault_files"

    def schema(self) -> str:
        return "path string, content binary, keep boolean"

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def read_vault(spark: SparkSession, vault: str, pattern: str = "**/*", files: int = FILES) -> DataFrame:
    """path, content of the files that match; names may hold any sign."""
    spark.dataSource.register(VaultFiles)
    return spark.read.format("vault_files").option("pattern", pattern).option("files", str(files)).load(vault).select("path", "content")


def write_vault(files: DataFrame, vault: str) -> None:
    """files (path, content, keep, seq): all of them or none. A null content deletes the file, keep leaves one that is there.

    Of rows with one path the last by seq counts, of rows that keep the first; a path that is deleted and written in one go is written, whatever was there.
    """
    files.sparkSession.dataSource.register(VaultFiles)
    there = F.col("content").isNotNull()
    rank = F.struct(F.when(F.col("keep"), -F.col("seq")).otherwise(F.col("seq")).alias("seq"), "content")
    one = files.groupBy("path").agg(F.max_by("content", F.when(there, rank)).alias("content"), (F.min("keep") & F.min(there)).alias("keep"))
    one.select("path", "content", F.coalesce("keep", F.lit(False)).alias("keep")).write.format("vault_files").mode("append").save(vault)


def note_files(notes: DataFrame, directory: str, kind: str, name: str, body: str, meta: list[str], keep: bool, seq: str | None = None) -> DataFrame:
    """Notes as Markdown files with front matter of the named columns (nulls left out): what write_vault takes."""

    @F.pandas_udf("string")
    def front(meta: pd.Series) -> pd.Series:
        import json

        import yaml

        return meta.map(lambda m: yaml.safe_dump(json.loads(m), allow_unicode=True))

    text = F.concat(F.lit("---\n"), front(F.to_json(F.struct(*meta))), F.lit("---\n\n"), F.coalesce(F.col(body), F.lit("")))
    order = F.lit(0) if seq is None else F.col(seq)
    return notes.select(note_path(F.col(name), F.col(kind), directory).alias("path"), F.encode(text, "UTF-8").alias("content"), F.lit(keep).alias("keep"), order.cast("long").alias("seq"))


def deleted_notes(notes: DataFrame, directory: str, kind: str, name: str) -> DataFrame:
    return notes.select(note_path(F.col(name), F.col(kind), directory).alias("path"), F.lit(None).cast("binary").alias("content"), F.lit(False).alias("keep"), F.lit(0).cast("long").alias("seq"))


def save_batch(vault: str, topics: DataFrame, contents: DataFrame, merged: DataFrame, failed: DataFrame | None = None, failures: str = "failed") -> None:
    """What a batch leaves, in one commit: new topic notes (type, name, date, description), which leave those that are there; content notes (content_type, title, ...),
    which replace them; merged topics (type, name), which go; failures (seq, link, reason) as lines of JSON in that folder, a file for each thousand requests that has some."""
    notes = contents.withColumn("type", F.lit("Content"))
    meta = [c for c in ("link", "upload_date", "already_read", "read_priority", "source", "tags", "type") if c in notes.columns]
    files = note_files(topics, "topics", "type", "name", "description", ["date", "type"], True).unionByName(note_files(notes, "contents", "content_type", "title", "body", meta, False)).unionByName(deleted_notes(merged, "topics", "type", "name"))
    if failed is not None:
        line = F.struct("seq", F.to_json(F.struct("link", "reason")).alias("line"))
        lists = failed.groupBy(F.expr("seq div 1000").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))
        place = F.concat(F.lit(f"{failures}/"), F.lpad(F.col("n").cast("string"), 9, "0"), F.lit(".json"))
        files = files.unionByName(lists.select(place.alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit(False).alias("keep"), F.lit(0).cast("long").alias("seq")))
    write_vault(files, vault)
