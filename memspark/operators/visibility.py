"""Which facts a reader sees: scope, status, validity, expiry and project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(user: str | None, column: str = "user_scope") -> Column:
    """A null scope is everybody's; any other must be the user's."""
    c = F.col(column)
    return c.isNull() if user is None else c.isNull() | (c == user)


def not_expired(at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.col("expires_at").isNull() | (F.col("expires_at") > at)


def in_project(project: str | None) -> Column:
    """Without a project there is no filter at all."""
    return F.lit(True) if project is None else F.col("project_id").isNull() | (F.col("project_id") == project)


def valid_at(at: int | Column) -> Column:
    """Half-open: valid_from <= at < valid_to."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def visible(facts: DataFrame, user: str | None, now: int, project: str | None = None, category: str | None = None, include_expired: bool = False) -> DataFrame:
    out = facts.filter((F.col("status") == "active") & F.col("valid_to").isNull() & in_scope(user) & in_project(project))
    if category is not None:
        out = out.filter(F.col("category") == category)
    return out if include_expired else out.filter(not_expired(now))


def as_of(facts: DataFrame, user: str | None, at: int) -> DataFrame:
    return facts.filter((F.col("status") == "active") & in_scope(user) & valid_at(at) & not_expired(at))


def fetch(facts: DataFrame, ids: DataFrame, now: int, quarantined: bool = False) -> DataFrame:
    """Facts in the order of ``ids`` (memory_id, pos); expired ones never."""
    found = facts.filter(not_expired(now))
    if not quarantined:
        found = found.filter("status = 'active'")
    return found.join(ids, "memory_id").orderBy("pos")


def assign_expiry(rows: DataFrame, ttl_days: dict[str, int], fallback: int = 90) -> DataFrame:
    """``new_expiry``: an explicit value wins, an explicit null never expires, else temporary rows get their category's days.

    Needs columns explicit (boolean), given (seconds or null), durability, category, created_at.
    """
    days = F.coalesce(*(F.when(F.col("category") == c, F.lit(d)) for c, d in ttl_days.items()), F.lit(fallback))
    own = F.when(F.col("durability") == "temporary", F.col("created_at") + days * 86400)
    return rows.withColumn("new_expiry", F.when(F.col("explicit"), F.col("given")).otherwise(own))
