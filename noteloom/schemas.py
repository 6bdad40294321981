"""Schemas and vocabularies of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_s, _b, _i, _d = T.StringType(), T.BooleanType(), T.IntegerType(), T.DateType()


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


#: As it arrives: everything text, so that wrong values are seen and not silently turned to null.
RAW_REQUEST = struct(link=_s, upload_date=_s, already_read=_s, read_priority=_s, source=_s)
REQUEST = struct(link=_s, link_kind=_s, upload_date=_d, already_read=_b, read_priority=_i, source=_s)
DOCUMENT = struct(link=_s, content=_s, content_links=T.ArrayType(_s), hyperlink=_s)
TAG = struct(name=_s)
TOPIC = struct(type=_s, name=_s, description=_s)
DESCRIPTION = struct(title=_s, content_type=_s, tags=T.ArrayType(TAG))
RESOLUTION = struct(merge_topic=_b, topic=TOPIC)
TOPIC_NOTE = struct(type=_s, name=_s, date=_s, description=_s)
CONTENT_NOTE = struct(content_type=_s, title=_s, link=_s, upload_date=_s, already_read=_b, read_priority=_i, source=_s, tags=T.ArrayType(_s), body=_s)
EDGE = struct(content_type=_s, title=_s, dst_type=_s, dst_name=_s)
ARTEFACT = struct(path=_s, content=T.BinaryType())

#: What extracted tags, content types and topic types may be.
TAGS = [
    "Deep Learning", "Cloud Computing", "Statistics", "Mathematics", "MlOps", "Data Engineering", "Feature Engineering", "Data Visualization", "DevOps", "Python", "Large Language Model",
    "Natural Language Processing", "Generative AI", "Time Series", "Graph", "Computer Vision", "Supervised Learning", "Unsupervised Learning", "Semi-supervised Learning",
    "Dimensionality reduction", "Active Learning", "AI regulation", "Data Quality", "Model evaluation", "Development tool",
]
CONTENT_TYPES = ["Course", "Repository", "Documentation", "Blog post", "Product main page", "Scientific article"]
TOPIC_CATEGORIES = ["Library", "Model", "Platform", "Concept"]


@dataclass
class Model:
    name: str = "stub"
    token_limit: int = 128_000


@dataclass
class Extraction:
    tags: list[str] = field(default_factory=lambda: list(TAGS))
    content_types: list[str] = field(default_factory=lambda: list(CONTENT_TYPES))
    topic_categories: list[str] = field(default_factory=lambda: list(TOPIC_CATEGORIES))


@dataclass
class Vault:
    vault_path: str | None = None
    content_directory: str = "contents"
    topic_directory: str = "topics"
    artefact_directory: str = "artefacts"
