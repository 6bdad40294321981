"""Writers: JSON lists, Markdown notes, artefacts, status, reset."""

from __future__ import annotations

import datetime
import shutil
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import note_path


def write_failures(failed: DataFrame, path: str) -> bool:
    """JSON, only if there is a failure."""
    if failed.isEmpty():
        return False
    failed.write.mode("overwrite").json(path)
    return True


def with_type(notes: DataFrame) -> DataFrame:
    """Front matter of content notes names their type."""
    return notes.withColumn("type", F.lit("Content"))


def snapshot(content_notes: DataFrame) -> DataFrame:
    """Front matter of content notes without type, tags and body: what a batch can read again."""
    return content_notes.drop("type", "content_type", "title", "tags", "body")


def write_snapshot(content_notes: DataFrame, path: str) -> None:
    snapshot(content_notes).write.mode("overwrite").json(path)


def export_notes(notes: DataFrame, vault: str, directory: str, kind: str, name: str, body: str, meta: list[str]) -> int:
    """A Markdown file with front matter for each note, under a vault that all tasks can write to; returns how many. Nulls are left out."""
    rows = notes.select(note_path(F.col(name), F.col(kind), directory).alias("path"), F.col(body).alias("body"), F.to_json(F.struct(*meta)).alias("meta"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for frame in frames:
            for r in frame.itertuples(index=False):
                file = Path(vault) / r.path
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(f"---\n{yaml.safe_dump(json.loads(r.meta), allow_unicode=True)}---\n\n{r.body}", encoding="utf-8")
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def sound_names(name: Column) -> Column:
    """Whether a name's last part names a file."""
    last = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.coalesce(~last.isin("", ".", ".."), F.lit(False))


def write_artefacts(files: DataFrame, vault: str, directory: str = "artefacts") -> int:
    """files (name, content binary) as files of that folder; of a name that is a path only the last part counts, and what names no file is refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                name = r.name.replace("\\", "/").rsplit("/", 1)[-1]
                if name in {"", ".", ".."}:
                    raise ValueError(f"no file name: {r.name!r}")
                file = Path(vault) / directory / name
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_bytes(r.content)
            yield pd.DataFrame({"n": [len(frame)]})

    return files.select("name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """A line for each row."""
    rows.select(column).write.mode("overwrite").text(path)


def synced(vault: str, work: Callable[[], object], git: Callable[[list[str]], object] | None = None) -> object:
    """work between a pull and an add, commit and push of the vault's repository, and the time of the update; what git answers is not looked at."""
    run = git or (lambda arguments: subprocess.run(["git", "-C", vault, *arguments], check=False))
    run(["pull"])
    result = work()
    write_status(vault)
    for arguments in (["add", "."], ["commit", "-m", "Update of the vault"], ["push"]):
        run(arguments)
    return result


def write_status(vault: str) -> None:
    (Path(vault) / "status.md").write_text(f"Last update on : {datetime.datetime.now().isoformat()}")


def reset(vault: str, confirmed: bool = False, directories: tuple[str, ...] = ("topics", "contents", "artefacts")) -> None:
    """Empty the vault's folders; nothing happens without confirmation."""
    if not confirmed:
        raise PermissionError("a reset must be confirmed")
    for d in directories:
        shutil.rmtree(Path(vault) / d, ignore_errors=True)
        (Path(vault) / d).mkdir(parents=True)
