"""From requests to notes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hyperlink, last_segment, loader, normalise_tags, note_body, note_name
from ..operators.answers import Answers
from ..operators.enrich import Client, Stub, enrich
from ..operators.links import KEY, PARTS, link_index, linked_notes, moved_targets, part_of
from ..operators.requests import split_valid, validate
from ..operators.resolve import Judge, drop_merged, followed, resolve_asking, rewrite_links, similar_names, topic_rows
from ..operators.sinks import sound_names, write_artefacts
from ..operators.staging import stored
from ..operators.store import Parts, Store
from ..operators.windows import first_writes, last_writes
from ..schemas import Model
from ..sources.fetching import Manners, fetch_by_host
from ..sources.readers import load_contents, split_fetched
from ..streaming.landing import CONTENT_ROWS, TOPIC_ROWS

NOTE = ("content_type", "title", "link", "upload_date", "already_read", "read_priority", "source", "tags", "body")
LINK_ROWS = "target string, part int, content_type string, title string, shelf int"


def _enriched(raw: DataFrame, get: Callable, client: Callable[[], Client], extract: Callable | None, vault: str | None, token_limit: int, answers: Answers | None, manners: Manners) -> tuple[DataFrame, DataFrame]:
    """Contents with what a model says of them (content_seq, ...), and failures (seq, link, reason)."""
    valid, invalid = split_valid(validate(raw))
    fetched = fetch_by_host(valid.withColumn("loader", loader(F.col("link"))), get, manners).drop("tries")
    loaded, unloaded = split_fetched(fetched)
    named = F.lit(True)
    if vault is not None:
        name = last_segment(F.col("link"))
        named = (F.col("loader") != "pdf") | sound_names(name)
        files = loaded.where(named & (F.col("loader") == "pdf")).select(name.alias("name"), F.col("body").alias("content"), "seq")
        write_artefacts(last_writes(files, ["name"], ["seq"]), vault)  # of equal names the last request's
    contents, unread = load_contents(loaded.where(named), extract, token_limit / 2)
    asked = stored(enrich(contents.drop("body", "status", "error"), client, answers=answers).withColumn("content_seq", F.col("seq").cast("long")), "enriched")
    failed = [
        invalid.select("seq", "link", "reason"), unloaded.select("seq", "link", F.coalesce("error", F.concat(F.lit("status "), F.col("status"))).alias("reason")),
        loaded.where(~named).select("seq", "link", F.lit("no file name").alias("reason")), unread.select("seq", "link", F.col("error").alias("reason")), asked.where("error is not null").select("seq", "link", F.col("error").alias("reason")),
    ]
    return asked.where("error is null").drop("error"), reduce(DataFrame.unionByName, failed)


def _topics(done: DataFrame) -> DataFrame:
    return done.select("content_seq", F.posexplode("topics").alias("topic_idx", "t")).select("content_seq", "topic_idx", "t.type", "t.name", "t.description")


def _new_notes(done: DataFrame, judged: DataFrame, base: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges of the contents that no judge failed, their notes (with content_seq), and failures."""
    failed = judged.where("error is not null").groupBy("content_seq").agg(F.min("error").alias("reason"))
    resolved = judged.where("error is null").drop("error")
    sound = done.join(failed, "content_seq", "left_anti")
    by_content = resolved.groupBy("content_seq").agg(F.array_sort(F.collect_list(F.struct("topic_idx", "type", "name"))).alias("resolved"))
    body = note_body(hyperlink(F.col("link"), base=base), F.col("summary"), F.col("links"), F.coalesce("resolved", F.array().cast("array<struct<topic_idx:int,type:string,name:string>>")))
    notes = sound.join(by_content, "content_seq", "left").select(
        "content_seq", F.col("description.content_type").alias("content_type"), note_name(F.col("description.title")).alias("title"), "link", F.date_format("upload_date", "yyyy-MM-dd").alias("upload_date"),
        "already_read", "read_priority", "source", normalise_tags(F.col("description.tags.name")).alias("tags"), body.alias("body"),
    )
    return resolved, last_writes(notes, ["content_type", "title"], ["content_seq"]), done.join(failed, "content_seq").select("seq", "link", "reason")


def _written(done: DataFrame, judged: DataFrame, content_notes: DataFrame, base: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As _new_notes, with all content notes after the batch (content_seq is -1 for earlier ones)."""
    resolved, new, refused = _new_notes(done, judged, base)
    kept = content_notes.select(*NOTE).join(new.select("content_type", "title"), ["content_type", "title"], "left_anti").withColumn("content_seq", F.lit(-1).cast("long"))
    return resolved, kept.unionByName(new), refused


def ingest_batch(
    raw: DataFrame, topic_notes: DataFrame, content_notes: DataFrame, get: Callable, judge: Judge, client: Callable[[], Client] = Stub,
    extract: Callable[[bytes], list[str]] | None = None, vault: str | None = None, token_limit: int = Model.token_limit, base: str | None = None, answers: Answers | None = None, manners: Manners = Manners(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """raw requests (seq, ...): all topic notes, all content notes, and failures (seq, link, reason).

    All contents of the batch meet the notes as they were before it; see ingest_in_order for the other way. Paths of
    texts are shown from base, the driver's folder if not given.
    Web pages are parsed, texts taken whole, and of PDFs, whose pages extract gives, the first of at most token_limit / 2
    words in all; without extract they are failures. With a vault the PDFs are saved there, of equal names the last one; a link without a file's name is a failure then.
    Each page is fetched once a batch, as manners has it, each
    model and judge asked once: what they answer is written, and all that follows reads it there; with answers it is kept for later batches too. What a page, model or
    judge raises is the failure of its content, which writes nothing.
    """
    done, failed = _enriched(raw, get, client, extract, vault, token_limit, answers, manners)
    judged = stored(resolve_asking(_topics(done), topic_notes, judge, answers), "resolved")
    resolved, notes, refused = _written(done, judged, content_notes, base)
    old = content_notes.select(*NOTE).join(notes.where("content_seq >= 0").select("content_type", "title"), ["content_type", "title"], "left_anti")
    contents = rewrite_links(old, resolved).unionByName(notes.where("content_seq >= 0").drop("content_seq"))
    left = drop_merged(topic_notes, resolved)
    new_topics = first_writes(topic_rows(resolved, done.select("content_seq", "upload_date")), ["type", "name"], ["content_seq", "topic_idx"], left).select("type", "name", "date", "description")
    return left.unionByName(new_topics), contents, failed.unionByName(refused)


def _numbers(df: DataFrame, column: str) -> list[int]:
    """Numbers of parts, at most as many as there are parts."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def ingest_kept(
    store: Store, raw: DataFrame, get: Callable, judge: Judge, client: Callable[[], Client] = Stub, extract: Callable[[bytes], list[str]] | None = None, vault: str | None = None, token_limit: int = Model.token_limit,
    base: str | None = None, answers: Answers | None = None, manners: Manners = Manners(), source: str | None = None, batch: int | None = None, parts: int = PARTS,
) -> bool:
    """The same notes as ingest_batch leaves, in a store that keeps them by parts, with an index of links: a batch reads and writes anew only parts with notes that it concerns.

    Tables of the store: topics, contents, links (target, part, content_type, title: each link of each note once, on the shelf of its target) and
    failures (of each version apart). Of contents those parts are read that get a new note or have one with a link to a merged topic, as the index says; of
    links the shelves of merged topics and of what written notes linked to and link to now. Of topics all are read, as any may be similar. All
    changes are one commit. False if the source's batch was committed before. parts: for a new store; later batches keep to it.
    """
    if source is not None and batch is not None and store.seen(source, batch):
        return False
    parts = store.parts_of("contents") or parts
    of_part, of_topic, shelf = part_of(parts), F.pmod(F.xxhash64("type", "name"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("target"), F.lit(parts)).cast("int")
    topics = store.read("topics", f"{TOPIC_ROWS}, part int")
    done, failed = _enriched(raw, get, client, extract, vault, token_limit, answers, manners)
    judged = stored(resolve_asking(_topics(done), topics.drop("part"), judge, answers), "resolved")
    resolved, new, refused = _new_notes(done, judged, base)
    new = stored(new.drop("content_seq").withColumn("part", of_part), "new-notes")

    ways = stored(followed(resolved), "ways")
    index = store.read("links", LINK_ROWS, _numbers(moved_targets(ways).select(shelf.alias("shelf")), "shelf"))
    found = stored(linked_notes(index, ways), "linked")
    concerned = stored(found.unionByName(new.select("part", *KEY)).distinct(), "concerned")
    touched = _numbers(concerned, "part")
    old = store.read("contents", f"{CONTENT_ROWS}, part int", touched)
    at = ["part", *KEY]
    changed = stored(rewrite_links(old.join(found, at, "left_semi").join(new, at, "left_anti"), resolved, ways).unionByName(new), "changed-notes")
    contents = old.join(concerned, at, "left_anti").unionByName(changed)

    after = stored(link_index(changed).withColumn("shelf", shelf), "links-after")
    before = link_index(old.join(concerned, at, "left_semi")).select(shelf.alias("shelf"))
    shelves = _numbers(before.union(after.select("shelf")), "shelf")
    links = store.read("links", LINK_ROWS, shelves).join(concerned, at, "left_anti").unionByName(after)

    left = drop_merged(topics, resolved)
    fresh = topic_rows(resolved, done.select("content_seq", "upload_date"))
    first = stored(first_writes(fresh, ["type", "name"], ["content_seq", "topic_idx"], left).select("type", "name", "date", "description").withColumn("part", of_topic), "new-topics")
    gone = resolved.where("merged_name is not null").select(F.col("merged_type").alias("type"), F.col("merged_name").alias("name"))
    concerned_topics = _numbers(first.select("part").union(gone.select(of_topic.alias("part"))), "part")

    version = store.manifest()["version"] + 1
    reasons = failed.unionByName(refused).select(F.lit(version).alias("version"), F.col("seq").cast("long").alias("seq"), "link", "reason")
    changes = {
        "topics": Parts(left.unionByName(first), "part", concerned_topics, parts), "contents": Parts(contents, "part", touched, parts),
        "links": Parts(links, "shelf", shelves, parts), "failures": Parts(reasons, "version", [version]),
    }
    return store.commit({}, source, batch, changes)


def ingest_in_order(
    raw: DataFrame, topic_notes: DataFrame, content_notes: DataFrame, get: Callable, judge: Judge, client: Callable[[], Client] = Stub,
    extract: Callable[[bytes], list[str]] | None = None, vault: str | None = None, token_limit: int = Model.token_limit, base: str | None = None, answers: Answers | None = None, manners: Manners = Manners(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ingest_batch, but each content meets the notes that those before it (by seq) have left: the same as one batch for each content.

    Only contents that may meet wait for each other: see resolve_in_order. Links are rewritten once, at the end, by all merges in their order.
    """
    done, failed = _enriched(raw, get, client, extract, vault, token_limit, answers, manners)
    topics = stored(_topics(done), "topics")
    judged, notes, _ = resolve_in_order(topics, done.select("content_seq", "upload_date"), topic_notes, judge, answers)
    resolved, contents, refused = _written(done, judged, content_notes, base)
    return notes, rewrite_links(contents, resolved).drop("content_seq"), failed.unionByName(refused)


def resolve_in_order(topics: DataFrame, dates: DataFrame, topic_notes: DataFrame, judge: Judge, answers: Answers | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Topics resolved as if one content came after the other: judged topics, all topic notes after them, and in how many levels.

    For each name that is stored or may be written, the contents with a topic similar to it form a group; what one of them writes another may meet, so
    that those of a group go by content_seq. A content is ready when it is the first that remains in all its groups; all that are ready form a level and
    are resolved together. Names that a judge invents can't be known before: where one would have been met by a content that has had its
    turn too early or has still to come, its writer joins the group of that name, and all levels start anew. What judges answered is asked again then, unless answers are kept.
    """
    names = topics.where("name is not null").select("name").distinct()
    wrote = topics.sparkSession.createDataFrame([], "other string, content_seq long")
    levels = 0
    while True:
        judged, notes, found, n = _levels(topics, names, dates, topic_notes.select("type", "name", "date", "description"), judge, answers, wrote)
        levels += n
        if found is None:
            return judged, notes, levels
        wrote = stored(wrote.unionByName(found).distinct(), "writers")


def _levels(topics: DataFrame, names: DataFrame, dates: DataFrame, notes: DataFrame, judge: Judge, answers: Answers | None, wrote: DataFrame) -> tuple[DataFrame | None, DataFrame, DataFrame | None, int]:
    """One go through all levels; wrote: writers of names that they have no topic like. If some are missing they are the third result, and the first is None."""
    universe = stored(names.union(names.select(note_name(F.col("name")))).union(notes.select("name")).union(wrote.select("other")).distinct().toDF("other"), "universe")
    similar = stored(similar_names(names, universe, "name", "other"), "similar")
    members = stored(topics.join(similar, "name").select("other", "content_seq").union(wrote).distinct(), "members")
    waiting, parts, n = stored(topics.select("content_seq").distinct(), "waiting"), [], 0
    while not waiting.isEmpty():
        n += 1
        open_ = members.join(waiting, "content_seq")
        first = open_.groupBy("other").agg(F.min("content_seq").alias("first"))
        behind = open_.join(first, "other").where("content_seq > first").select("content_seq").distinct()
        ready = stored(waiting.join(behind, "content_seq", "left_anti"), "ready")
        waiting = stored(waiting.join(ready, "content_seq", "left_anti"), "waiting")
        judged = stored(resolve_asking(topics.join(ready, "content_seq", "left_semi"), notes, judge, answers, similar), "resolved")
        parts.append(judged)
        resolved = judged.where("error is null").drop("error")
        left = drop_merged(notes, resolved)
        new = first_writes(topic_rows(resolved, dates), ["type", "name"], ["content_seq", "topic_idx"], left)
        notes = stored(left.unionByName(new.select("type", "name", "date", "description")), "topic-notes")
        strange = stored(resolved.select(note_name(F.col("name")).alias("other"), "content_seq").distinct().join(members, ["other", "content_seq"], "left_anti"), "strange")
        if strange.isEmpty():
            continue
        unknown = strange.select("other").distinct().join(universe, "other", "left_anti")
        more = stored(similar_names(names, unknown, "name", "other"), "similar")
        grown = stored(members.union(topics.join(more, "name").select("other", "content_seq")).union(strange).distinct(), "members")
        others = grown.select("other", F.col("content_seq").alias("member")).join(waiting.select(F.col("content_seq").alias("member"), F.lit(True).alias("waits")), "member", "left")
        wrong = strange.join(others, "other").where("member > content_seq and waits is null or member < content_seq and waits")
        if not wrong.isEmpty():
            return None, notes, strange, n
        members, similar, universe = grown, stored(similar.unionByName(more), "similar"), stored(universe.union(unknown), "universe")
    none = topics.limit(0).selectExpr("content_seq", "topic_idx", "type", "name", "description", "type as merged_type", "name as merged_name", "type as error")
    return reduce(DataFrame.unionByName, parts, none), notes, None, n
