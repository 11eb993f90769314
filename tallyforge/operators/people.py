"""Members of an organisation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_invitations(invitations: DataFrame, now: dt.date) -> DataFrame:
    return invitations.where(~F.col("accepted") & ~F.col("revoked") & (F.col("expires_at") > F.lit(now)))


def members(users: DataFrame, invitations: DataFrame, organisation_id: str, now: dt.date) -> DataFrame:
    """Users, then pending invitations, each by age."""
    a = users.where(F.col("organisation_id") == organisation_id).select(F.lit(0).alias("rank"), "id", "email", "role", "created_at")
    b = pending_invitations(invitations, now).where(F.col("organisation_id") == organisation_id).select(F.lit(1).alias("rank"), "id", "email", "role", "created_at")
    return a.unionByName(b).orderBy("rank", "created_at", "id")


def admin_count(users: DataFrame) -> DataFrame:
    return users.where("is_active and role = 'admin'").groupBy("organisation_id").agg(F.count("*").alias("admins"))
