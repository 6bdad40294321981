"""Column expressions: links, routing, names, note bodies. All stay in the JVM."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose pages are read through a mirror, and the mirror.
MIRRORED_HOSTS = ["medium.com", "towardsdatascience.com"]
MIRROR = "https://readmedium.com/"
WEB = r"(?i)^https?://([^/?#]*)([^?#]*)"


def is_web(link: Column) -> Column:
    """Only http and https are web links; ftp and relative links are paths."""
    return F.coalesce(link.rlike(r"(?i)^https?://[^/?#]"), F.lit(False))


def host(link: Column) -> Column:
    """Lower-case host without user and port; '' for paths."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(link, WEB, 1)), "^.*@", ""), r":\d+$", "")


def path(link: Column) -> Column:
    """Path of a web link ('/' if it has none), without query and fragment."""
    found = F.regexp_extract(link, WEB, 2)
    return F.when(is_web(link) & (found == ""), "/").otherwise(found)


def normalise_link(link: Column) -> Column:
    """Scheme and host in lower case, default port dropped, an empty path made '/', blanks encoded; a path stays as it is."""
    parts = lambda k: F.regexp_extract(link, r"(?is)^(https?)://([^/?#]*)([^?#]*)(.*)$", k)
    scheme = F.lower(parts(1))
    name = F.lower(parts(2))
    name = F.when(scheme == "http", F.regexp_replace(name, ":80$", "")).otherwise(F.regexp_replace(name, ":443$", ""))
    slash = F.when(parts(3) == "", "/").otherwise(parts(3))
    return F.when(is_web(link), F.replace(F.concat(scheme, F.lit("://"), name, slash, parts(4)), F.lit(" "), F.lit("%20"))).otherwise(link)


def redirect_mirrored(link: Column) -> Column:
    """Links to a mirrored host (itself, no subdomain) go to the mirror; others stay."""
    return F.when(is_web(link) & host(link).isin(MIRRORED_HOSTS), F.concat(F.lit(MIRROR), link)).otherwise(link)


def loader(link: Column) -> Column:
    """text for paths, pdf for paths ending in .pdf and arxiv.org/pdf/, else url."""
    p = path(link)
    return F.when(~is_web(link), "text").when(p.endswith(".pdf") | ((host(link) == "arxiv.org") & p.startswith("/pdf/")), "pdf").otherwise("url")


def last_segment(link: Column) -> Column:
    return F.element_at(F.split(path(link), "/"), -1)


def absolute(path: Column, base: str | None = None) -> Column:
    """A path from the root: relative ones start at base (the driver's folder); empty and `.` parts go, `..` stays."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit((base or os.getcwd()).rstrip("/") + "/"), path))
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(full, "/"), lambda part: ~part.isin("", ".")), "/"))


def hyperlink(link: Column, artefacts: str = "artefacts", base: str | None = None) -> Column:
    """What a note shows for its content: the saved PDF, the page's link, or the text's absolute path."""
    kind = loader(link)
    return F.when(kind == "pdf", F.concat(F.lit(f"![]({artefacts}/"), last_segment(link), F.lit(")"))).when(kind == "text", absolute(link, base)).otherwise(link)


def note_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit(" "))


def topic_link(name: Column, kind: Column, directory: str = "topics") -> Column:
    return F.concat(F.lit(f"[[{directory}/"), kind, F.lit("/"), note_name(name), F.lit("]]"))


def note_path(name: Column, kind: Column, directory: str) -> Column:
    return F.concat(F.lit(f"{directory}/"), kind, F.lit("/"), note_name(name), F.lit(".md"))


def normalise_tags(names: Column) -> Column:
    """Blanks become _, nulls go; null if none is left."""
    kept = F.transform(F.filter(names, lambda t: t.isNotNull()), lambda t: F.replace(t, F.lit(" "), F.lit("_")))
    return F.when(F.size(kept) > 0, kept)


def note_body(link: Column, summary: Column, links: Column, topics: Column) -> Column:
    """Body of a content note; topics: array of struct(type, name, ...), in order. A null links leaves its section out."""
    bullets = F.array_join(F.transform(topics, lambda t: F.concat(F.lit("- "), topic_link(t["name"], t["type"]), F.lit("\n"))), "")
    section = F.coalesce(F.concat(F.lit("\n## Links\n\n"), links), F.lit(""))
    return F.concat(link, F.lit("\n## Summary\n\n"), summary, section, F.lit("\n## Topics\n\n"), bullets)


def keep_valid(items: Column, allowed: list[str], key: str | None = "name") -> tuple[Column, Column]:
    """Items whose key is allowed, and how many others there were."""
    kept = F.filter(items, lambda x: F.coalesce((x[key] if key else x).isin(allowed), F.lit(False)))
    return kept, F.size(items) - F.size(kept)


def word_count(text: Column) -> Column:
    """Pieces between single blanks; an empty text has one."""
    return F.size(F.split(text, " "))


def has_link_word(text: Column) -> Column:
    return F.exists(F.split(text, " "), lambda w: w.startswith("http"))


def iso_date(day_first: Column) -> Column:
    """dd/mm/yyyy to yyyy-mm-dd."""
    return F.array_join(F.reverse(F.split(day_first, "/")), "-")


def render(template: str, **values: Column) -> Column:
    """A prompt: each {name} in the template gives way to its value."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out
