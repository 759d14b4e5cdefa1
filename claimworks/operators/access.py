"""Roles, row policies and the two account procedures, as filters, semi joins and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_role(roles: DataFrame, user, role: str) -> DataFrame:
    """One row with user_id if roles(user_id, role) gives the user the role, else none."""
    return roles.filter((F.col("user_id") == F.lit(user)) & (F.col("role") == role)).select("user_id").limit(1)


def if_admin(rows: DataFrame, roles: DataFrame, user) -> DataFrame:
    """All rows for an administrator, none for others."""
    return rows.join(F.broadcast(has_role(roles, user, "ADMIN").select(F.lit(1))), F.lit(True), "left_semi")  # one row at most


def own_or_admin(rows: DataFrame, key: str, roles: DataFrame, user) -> DataFrame:
    """The rows whose key is the user, or all of them for an administrator."""
    mine = F.coalesce(F.col(key) == F.lit(user), F.lit(False))
    return rows.filter(mine).unionByName(if_admin(rows.filter(~mine), roles, user))


def bootstrap_user(profiles: DataFrame, roles: DataFrame, user, name: str | None, email: str, admin_email: str) -> tuple[DataFrame, DataFrame]:
    """profiles(id, name, email, is_active) and roles(user_id, role) with the user added where missing.
    A blank name becomes the part of the address before the @."""
    one = profiles.sparkSession.range(1)
    row = one.select(F.lit(user).alias("id"), F.lit((name or "").strip() or email.split("@")[0]).alias("name"), F.lit(email).alias("email"), F.lit(True).alias("is_active"))
    role = one.select(F.lit(user).alias("user_id"), F.lit("ADMIN" if email.lower() == admin_email else "USER").alias("role"))
    known = profiles.filter(F.col("id") == F.lit(user)).select("id")
    held = roles.join(role, ["user_id", "role"], "left_semi")
    return profiles.unionByName(row.join(known, "id", "left_anti")), roles.unionByName(role.join(held, ["user_id", "role"], "left_anti"))


def set_user_status(profiles: DataFrame, roles: DataFrame, admin, target, active: bool) -> tuple[DataFrame, DataFrame]:
    """profiles with the target's is_active set, and the audit row (admin_id, action, target_user_id).
    Without the administrator's role nothing changes and the audit is empty; callers raise if it is."""
    allowed = has_role(roles, admin, "ADMIN")
    change = if_admin(profiles.sparkSession.range(1).select(F.lit(target).alias("id"), F.lit(active).alias("__active")), roles, admin)
    updated = profiles.join(F.broadcast(change), "id", "left").withColumn("is_active", F.coalesce("__active", "is_active")).select(*profiles.columns)
    audit = allowed.select(F.col("user_id").alias("admin_id"), F.lit("ACTIVATE_USER" if active else "DEACTIVATE_USER").alias("action"), F.lit(target).alias("target_user_id"))
    return updated, audit
