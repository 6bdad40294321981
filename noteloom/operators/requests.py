"""Validation of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_web, normalise_link, redirect_mirrored

#: Texts that count as true and false.
TRUE, FALSE = ["true", "1", "yes", "y", "on", "t"], ["false", "0", "no", "n", "off", "f"]


def validate(raw: DataFrame) -> DataFrame:
    """raw requests (all text): typed columns, link_kind and reason (null if sound). Missing values get their defaults."""
    c = F.col
    flag = F.lower(c("already_read"))
    date = F.when(c("upload_date").rlike(r"^\d{4}-\d{2}-\d{2}(T00:00:00(Z|\+00:00)?)?$"), F.try_to_date(F.substring("upload_date", 1, 10))).when(c("upload_date").rlike(r"^\d{1,12}$"), F.to_date(F.timestamp_seconds(F.expr("try_cast(upload_date as bigint)"))))
    priority = F.coalesce(F.expr("try_cast(read_priority as int)"), F.when(c("read_priority").isNull(), 1))
    read = F.when(c("already_read").isNull(), False).when(flag.isin(TRUE), True).when(flag.isin(FALSE), False)
    typed = raw.withColumns({
        "link": redirect_mirrored(normalise_link(c("link"))), "link_kind": F.when(is_web(c("link")), "url").otherwise("path"),
        "upload_date": date, "already_read": read, "read_priority": priority,
    })
    reason = F.when(c("link").isNull() | (c("link") == ""), "link").when(c("upload_date").isNull(), "upload_date").when(c("already_read").isNull(), "already_read").when(~F.coalesce(c("read_priority").between(0, 5), F.lit(False)), "read_priority")
    return typed.withColumn("reason", reason)


def from_offset(requests: DataFrame, start: int, seq: str = "seq") -> DataFrame:
    """Requests from a place in the list on: by their number, as a DataFrame has no order."""
    return requests.where(F.col(seq) >= start)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where("reason is null").drop("reason"), validated.where("reason is not null")


def as_json(requests: DataFrame) -> DataFrame:
    """Each request as JSON text; a null source is left out, dates are ISO."""
    return requests.select(F.to_json(F.struct("link", "upload_date", "already_read", "read_priority", "source")).alias("value"))
