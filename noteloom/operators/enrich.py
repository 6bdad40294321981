"""Language-model steps behind a client interface, with a deterministic stub."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.columns import keep_valid
from ..schemas import CONTENT_TYPES, TAGS, TOPIC_CATEGORIES, Extraction
from ..sources.readers import load_prompt
from .answers import Answers, key_of
from .staging import stored


class Client(Protocol):
    def summary(self, content: str) -> str: ...
    def description(self, content: str) -> dict: ...
    def topics(self, content: str) -> list[dict]: ...
    def links(self, url: str, content: str, links: str) -> str: ...


class Stub:
    """First words for a summary, first line for a title, vocabulary terms that occur for tags and topics."""

    def summary(self, content: str) -> str:
        return " ".join(content.split()[:30])

    def description(self, content: str) -> dict:
        return {"title": (content.strip().split("\n")[0] or "untitled")[:50], "content_type": "Blog post", "tags": [{"name": t} for t in [*TAGS, "not a tag"] if t.lower() in content.lower() or t == "not a tag"]}

    def topics(self, content: str) -> list[dict]:
        words = sorted({w for w in content.split() if w[:1].isupper() and w.isalpha()}, key=lambda w: (-len(w), w))[:3]
        return [{"type": k, "name": w, "description": f"about {w}"} for k, w in zip(["Library", "Concept", "Rumour"], words, strict=False)]

    def links(self, url: str, content: str, links: str) -> str:
        return "\n".join(f"- {x}" for x in links.split("\n")[:5]) if links else "no links"


def filled(prompt: str, values: dict[str, str]) -> str:
    """Each {name} of the prompt that has a value gives way to it, once: what a value contains is not looked at again."""
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), prompt)


class Prompted:
    """A client that renders the prompts and hands them to complete(prompt), which gives a model's answer; structured answers are JSON."""

    def __init__(self, complete: Callable[[str], str], directory: str | None = None, settings: Extraction | None = None):
        settings = settings or Extraction()
        self.complete = complete
        self.prompts = {name: load_prompt(f"{name}.txt", directory) for name in ("summary", "description", "topics", "links", "resolution")}
        self.values = {"tags": ", ".join(settings.tags), "content_types": ", ".join(settings.content_types), "topic_categories": ", ".join(settings.topic_categories)}

    def ask(self, name: str, **values: str) -> str:
        return self.complete(filled(self.prompts[name], self.values | values))

    def summary(self, content: str) -> str:
        return self.ask("summary", content=content)

    def description(self, content: str) -> dict:
        return json.loads(self.ask("description", content=content))

    def topics(self, content: str) -> list[dict]:
        return json.loads(self.ask("topics", content=content))

    def links(self, url: str, content: str, links: str) -> str:
        return self.ask("links", url=url, content=content, links=links)

    def judge(self, new: dict, stored: dict) -> dict | None:
        """The merged topic, or None: merge without a topic counts as no merge."""
        pairs = {f"{k}_{i}": t.get(k) or "" for i, t in ((1, new), (2, stored)) for k in ("type", "name", "description")}
        answer = json.loads(self.ask("resolution", **pairs))
        return answer.get("topic") if answer.get("merge_topic") else None


DESCRIPTION = "struct<title:string,content_type:string,tags:array<struct<name:string>>>"
TOPICS = "array<struct<type:string,name:string,description:string>>"
#: What is asked of a model, in this order.
STEPS = ("summary", "description", "topics", "links")


def enrich(
    contents: DataFrame, client: Callable[[], Client] = Stub, tags: list[str] = TAGS, categories: list[str] = TOPIC_CATEGORIES, most_topics: int | None = None,
    answers: Answers | None = None, content_types: list[str] = CONTENT_TYPES,
) -> DataFrame:
    """contents (link, loader, content, content_links, ...) with summary, description, topics, links, n_bad_tags, n_bad_topics, bad_content_type, and error.

    One client a task. most_topics keeps the first so many valid topics; by default all, as the prompt alone asks for five. Links are asked for web pages only. What a client raises for a
    content, and an answer of another form than asked for, is that content's error (the step and the exception), and its later steps are not asked.
    With answers, what was answered before is not asked again, and what is answered now is kept, also that of a content that fails later; the
    result is then written already. Without, write it before it is used twice, as each use asks anew. An unknown content type is kept, and told by bad_content_type.
    """
    spark = contents.sparkSession
    keyed = contents.withColumn("_key", key_of("link", "loader", "content", "content_links"))
    if answers:
        keyed = keyed.join(answers.known(spark, *STEPS).withColumnsRenamed({"key": "_key", "known": "_known"}), "_key", "left")
    else:
        keyed = keyed.withColumn("_known", F.lit(None).cast("map<string,string>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.drop("_known").schema) + ", _answers map<string,string>, _new array<string>, error string"
    kept = keyed.drop("_known").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for part in (part for batch in batches for part in slices(batch)):
            answered, added, errors = [], [], []
            for link, loader, content, content_links, known in zip(*(part.column(c).to_pylist() for c in ("link", "loader", "content", "content_links", "_known")), strict=True):
                found, new, error = dict(known) if known is not None else {}, [], None
                for step in STEPS if loader == "url" else STEPS[:-1]:
                    if step in found:
                        continue
                    try:
                        ask = ask or client()
                        answer = ask.links(link, content or "", "\n".join(content_links if content_links is not None else [])) if step == "links" else getattr(ask, step)(content or "")
                        found[step] = json.dumps(_sound(step, answer))
                        new.append(step)
                    except Exception as e:  # the content's failure, not the batch's
                        error = f"{step}: {type(e).__name__}: {e}"
                        break
                answered.append(list(found.items()))
                added.append(new)
                errors.append(error)
            told = [pa.array(answered, pa.map_(pa.string(), pa.string())), pa.array(added, pa.list_(pa.string())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *told], names=[*kept, "_answers", "_new", "error"])

    asked = keyed.mapInArrow(run, schema)
    if answers:
        asked = stored(asked, "asked")
        told = asked.select(F.col("_key").alias("key"), F.explode("_new").alias("step"), "_answers").select("key", "step", F.element_at("_answers", F.col("step")).alias("answer"))
        answers.add(told.dropDuplicates(["key", "step"]))
    of = lambda step, kind: F.from_json(F.concat(F.lit('{"x":'), F.try_element_at("_answers", F.lit(step)), F.lit("}")), f"struct<x:{kind}>")["x"]
    known = asked.withColumns({"summary": of("summary", "string"), "description": of("description", DESCRIPTION), "topics": of("topics", TOPICS), "links": of("links", "string")}).drop("_key", "_answers", "_new")
    good_tags, bad_tags = keep_valid(F.col("description.tags"), tags)
    good_topics, bad_topics = keep_valid(F.col("topics"), categories, "type")
    if most_topics is not None:
        good_topics = F.slice(good_topics, 1, most_topics)
    bad_type = ~F.coalesce(F.col("description.content_type").isin(content_types), F.lit(False))
    return known.withColumns({"n_bad_tags": bad_tags, "n_bad_topics": bad_topics, "bad_content_type": bad_type, "description": F.col("description").withField("tags", good_tags), "topics": good_topics})


def _sound(step: str, answer: object) -> object:
    """The answer in the form asked for, or an error: a text, or the fields of a description or of topics."""
    if step in ("summary", "links"):
        if not isinstance(answer, str):
            raise TypeError(f"a text was asked for, not {type(answer).__name__}")
        return answer
    if step == "description":
        return {"title": _text(answer["title"]), "content_type": _text(answer["content_type"]), "tags": [{"name": _text(t["name"])} for t in answer["tags"]]}
    return [{k: _text(t[k]) for k in ("type", "name", "description")} for t in answer]


def _text(value: object) -> str | None:
    if value is not None and not isinstance(value, str):
        raise TypeError(f"a text was asked for, not {type(value).__name__}")
    return value
