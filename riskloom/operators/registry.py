"""Calendars seen from several accounts: unification, access and name resolution.

Access rows are (account_id, calendar_id, access_role, primary, summary,
summary_override, ord); ``ord`` is the listing order over all accounts. Lists
per calendar stay in long form, so a calendar shared by very many accounts
never becomes one huge array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Permission ranks.
ROLE_RANK = {"owner": 4, "writer": 3, "reader": 2, "freeBusyReader": 1}
WRITE_ROLES = ("owner", "writer")


def _filled(col: Column) -> Column:
    return F.when(col != "", col)


def normalized_access(access: DataFrame) -> DataFrame:
    """Defaults applied: role ``reader``, summary the calendar id; rows without a calendar dropped."""
    role = F.coalesce(_filled(F.col("access_role")), F.lit("reader"))
    rank = F
    for name, value in ROLE_RANK.items():
        rank = rank.when(role == name, value)
    return access.where(F.coalesce("calendar_id", F.lit("")) != "").select(
        "account_id", "calendar_id", role.alias("access_role"), F.coalesce("primary", F.lit(False)).alias("primary"),
        F.coalesce(_filled(F.col("summary")), F.col("calendar_id")).alias("summary"), "summary_override", "ord",
        rank.otherwise(0).alias("rank"),
    )


def unified_calendars(access: DataFrame) -> DataFrame:
    """One row per calendar: preferred account (best role, first listed wins ties) and display name."""
    rows = normalized_access(access)
    best = F.min_by(F.struct("account_id", "access_role", "summary", "summary_override"), F.struct(-F.col("rank"), F.col("ord")))
    first_primary = F.min_by(F.struct("summary_override"), F.when(F.col("primary"), F.col("ord")))
    grouped = rows.groupBy("calendar_id").agg(
        F.count(F.lit(1)).alias("n_accounts"), F.min("ord").alias("first_ord"), best.alias("p"),
        first_primary.alias("own"),
    )
    return grouped.select(
        "calendar_id", "n_accounts", "first_ord", F.col("p.account_id").alias("preferred_account"),
        F.col("p.access_role").alias("preferred_role"),
        F.coalesce(
            _filled(F.col("own.summary_override")), _filled(F.col("p.summary_override")), F.col("p.summary")
        ).alias("display_name"),
    )


def account_for(unified: DataFrame, operation: str = "read") -> DataFrame:
    """Account to use per calendar; writing needs an owner or writer as the preferred account."""
    rows = unified.select("calendar_id", F.col("preferred_account").alias("account_id"),
                          F.col("preferred_role").alias("access_role"))
    return rows.where(F.col("access_role").isin(*WRITE_ROLES)) if operation == "write" else rows


def accounts_with_access(access: DataFrame, calendars: DataFrame) -> DataFrame:
    return normalized_access(access).join(
        calendars.select("calendar_id").distinct(), "calendar_id", "left_semi"
    ).drop("rank")


def calendar_listing(access: DataFrame) -> DataFrame:
    """Every access row next to its unified calendar."""
    rows = normalized_access(access).drop("rank")
    return rows.join(unified_calendars(access), "calendar_id")


def _name_index(access: DataFrame, unified: DataFrame | None) -> DataFrame:
    """First calendar per (priority, name): at most one row per key, so lookups cannot explode."""
    rows = normalized_access(access)

    def entries(source: DataFrame, order: str, keys: list[tuple[int, Column]]) -> DataFrame:
        packed = F.array(*(F.struct(F.lit(p).alias("priority"), key.alias("name_key")) for p, key in keys))
        return source.select("calendar_id", F.col(order).alias("first_ord"), F.explode(packed).alias("k")).select(
            "calendar_id", "first_ord", "k.priority", "k.name_key"
        ).where("name_key is not null")

    override, summary = F.col("summary_override"), F.col("summary")
    if unified is None:
        index = entries(rows, "ord", [(1, override), (2, F.lower(override)), (5, summary), (6, F.lower(summary))])
    else:
        first = rows.join(unified.select("calendar_id", "first_ord"), "calendar_id")
        shown = F.col("display_name")
        index = entries(
            first, "first_ord", [(1, override), (2, F.lower(override)), (5, summary), (6, F.lower(summary))]
        ).unionByName(entries(unified, "first_ord", [(3, shown), (4, F.lower(shown))]))
    return index.groupBy("priority", "name_key").agg(
        F.min_by("calendar_id", F.struct("first_ord", "calendar_id")).alias("calendar_id")
    )


def _best_match(names: DataFrame, index: DataFrame) -> DataFrame:
    """Calendar of the best priority per name; priorities 1, 3, 5 compare exactly."""
    asked = names.select("name", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("priority")).withColumn(
        "name_key", F.when(F.col("priority") % 2 == 1, F.col("name")).otherwise(F.lower("name"))
    )
    return asked.join(index, ["priority", "name_key"]).groupBy("name").agg(
        F.min_by("calendar_id", "priority").alias("calendar_id")
    )


def resolve_names(
    names: DataFrame, access: DataFrame, accounts: list[str], operation: str = "read"
) -> DataFrame:
    """Resolve column ``name`` to (calendar_id, account_id, access_role); nulls where nothing fits.

    ``accounts`` is the ordered list of connected accounts. ``primary`` and ids
    (with ``@``) are taken as they are; other names go through six priorities.
    """
    access = access.where(F.col("account_id").isin(accounts))
    names = names.select("name").distinct()
    unified = unified_calendars(access)
    literal = (F.col("name") == "primary") | F.contains("name", F.lit("@"))
    by_name = _best_match(names.where(~literal), _name_index(access, unified))
    wanted = names.where(literal).withColumn("calendar_id", F.col("name")).unionByName(by_name)
    found = wanted.join(account_for(unified, operation), "calendar_id", "left")
    resolved = names.join(found, "name", "left")
    if accounts:
        fallback = (F.col("name") == "primary") & (F.lit(len(accounts) == 1) | F.col("account_id").isNull())
        resolved = resolved.select(
            "name", F.when(fallback, "primary").otherwise(F.col("calendar_id")).alias("calendar_id"),
            F.when(fallback, accounts[0]).otherwise(F.col("account_id")).alias("account_id"),
            F.when(fallback, "owner").otherwise(F.col("access_role")).alias("access_role"),
        )
    unresolved = F.col("account_id").isNull()
    return resolved.withColumn("calendar_id", F.when(~unresolved, F.col("calendar_id")))


def resolve_in_account(names: DataFrame, access: DataFrame) -> DataFrame:
    """Single-account variant: override exact / any case, then summary exact / any case."""
    names = names.select("name").distinct()
    literal = (F.col("name") == "primary") | F.contains("name", F.lit("@"))
    by_name = _best_match(names.where(~literal), _name_index(access, None))
    return names.join(
        names.where(literal).withColumn("calendar_id", F.col("name")).unionByName(by_name), "name", "left"
    )


def route(names: DataFrame, access: DataFrame, accounts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(account_id, calendar_id) rows to query, and one warning row per name not found."""
    resolved = resolve_names(names, access, accounts)
    routes = resolved.where("account_id is not null").select("account_id", "calendar_id").distinct()
    warnings = resolved.where("account_id is null").select(
        "name", F.concat(F.lit('Calendar "'), F.col("name"), F.lit('" not found on any account')).alias("warning")
    )
    return routes, warnings
