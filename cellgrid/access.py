"""Who may see what: datasets and annotations by role, visibility and shares; annotation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import clean_text

#: Permissions of each role.
PERMISSIONS = {
    "admin": (
        "create_dataset", "edit_any_dataset", "delete_any_dataset", "create_user", "edit_user", "delete_user",
        "manage_system", "view_any_dataset", "run_any_operation", "delete_any_operation",
    ),
    "editor": ("create_dataset", "edit_own_dataset", "delete_own_dataset", "view_any_dataset", "run_any_operation"),
    "viewer": ("view_own_dataset", "view_any_dataset"),
}


def may(role: str, permission: str) -> bool:
    """Whether a role has a permission; an unknown role has none."""
    return permission in PERMISSIONS.get(role, ())


def role_permissions(spark: SparkSession) -> DataFrame:
    """(role, permission) of every role."""
    rows = [(r, p) for r, all_of in PERMISSIONS.items() for p in all_of]
    return spark.createDataFrame(rows, "role string, permission string")


def may_change(user: str | None, role: str) -> Column:
    """The datasets that a user may edit or delete: all for an admin, own ones for an editor."""
    if role == "admin":
        return F.lit(True)
    return F.coalesce(F.col("created_by") == user, F.lit(False)) if role == "editor" and user else F.lit(False)


def visible_datasets(user: str | None, role: str) -> Column:
    """The rows of the catalogue that a user may read: all for an admin; public ones, own ones, and shared ones with the user among them."""
    if role == "admin":
        return F.lit(True)
    mine = F.coalesce(F.col("created_by") == user, F.lit(False)) if user else F.lit(False)
    shared = (F.col("visibility") == "shared") & F.coalesce(F.array_contains("shared_with", user), F.lit(False)) if user else F.lit(False)
    return (F.col("visibility") == "public") | mine | shared


def visible_annotations(annotations: DataFrame, shares: DataFrame, user: str) -> DataFrame:
    """Annotations that a user may read: public ones, own ones, and shared ones with a share (annotation_id, user_id) for the user."""
    granted = shares.where(F.col("user_id") == user).select(F.col("annotation_id").alias("id")).distinct().withColumn("granted", F.lit(True))
    x = annotations.join(granted, "id", "left")
    return x.where((F.col("visibility") == "public") | (F.col("created_by") == user) | ((F.col("visibility") == "shared") & F.coalesce("granted", F.lit(False)))).drop("granted")


def list_annotations(annotations: DataFrame, visibility: str | None = None, types: list[str] | None = None, creator: str | None = None, limit: int | None = None) -> DataFrame:
    """Annotations by visibility, types and creator, newest first."""
    x = annotations
    if visibility:
        x = x.where(F.col("visibility") == visibility)
    if types:
        x = x.where(F.col("type").isin(types))
    if creator:
        x = x.where(F.col("created_by") == creator)
    return x if limit is None else x.orderBy(F.desc("created_at"), "id").limit(limit)


def search_annotations(annotations: DataFrame, text: str) -> DataFrame:
    """Annotations whose content holds the text in any case; % and _ in it are wildcards."""
    return annotations.where(F.col("content").ilike(f"%{text}%"))


def cleaned_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations as they are stored: without scripts and control characters, empty ones gone."""
    return annotations.withColumn("content", clean_text(F.col("content"))).where("content != ''")
