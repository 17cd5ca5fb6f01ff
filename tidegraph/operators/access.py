"""Row access by role and data class.

Tables: users (user_id, status), roles (role_id, level), has_role (user_id,
role_id), can_access (role_id, class_id), classes (class_id, level).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNRESTRICTED = 5


def grants(has_role: DataFrame, can_access: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (user_id, class_id, level) that some role of the user grants."""
    return has_role.join(can_access, "role_id").join(classes, "class_id").select("user_id", "class_id", "level").distinct()


def highest(granted: DataFrame) -> DataFrame:
    """(user_id, max_level)."""
    return granted.groupBy("user_id").agg(F.max("level").alias("max_level"))


def decide(asked: DataFrame, users: DataFrame, classes: DataFrame, granted: DataFrame) -> DataFrame:
    """``asked`` (user_id, class_id) with ``allowed`` and the first reason that applies."""
    u = users.select("user_id", "status").dropDuplicates(["user_id"])
    c = classes.select("class_id", F.lit(True).alias("_class")).distinct()
    g = granted.select("user_id", "class_id", F.lit(True).alias("_granted")).distinct()
    reason = (
        F.when(F.col("status").isNull(), "user not found")
        .when(F.col("status") != "ACTIVE", "user not active")
        .when(F.col("_class").isNull(), "class not found")
        .when(F.col("_granted").isNull(), "not granted")
        .otherwise("granted")
    )
    out = asked.join(u, "user_id", "left").join(c, "class_id", "left").join(g, ["user_id", "class_id"], "left")
    return out.select("user_id", "class_id", (reason == "granted").alias("allowed"), reason.alias("reason"))


def visible(level: str, max_level: int | None) -> Column:
    """Rows a reader may see: unclassified ones and those up to the reader's level; none without a level."""
    if max_level is None:
        return F.lit(False)
    if max_level >= UNRESTRICTED:
        return F.lit(True)
    return F.col(level).isNull() | (F.col(level) <= max_level)


def visible_to(rows: DataFrame, level: str, reader: str, max_levels: DataFrame) -> DataFrame:
    """``rows`` of many readers, each filtered by the reader's own level (max_levels: user_id, max_level)."""
    m = max_levels.select(F.col("user_id").alias(reader), "max_level")
    return rows.join(m, reader).where(F.col(level).isNull() | (F.col("max_level") >= UNRESTRICTED) | (F.col(level) <= F.col("max_level"))).drop("max_level")


def assign(has_role: DataFrame, new: DataFrame) -> DataFrame:
    return has_role.unionByName(new.select(*has_role.columns)).distinct()


def revoke(has_role: DataFrame, old: DataFrame) -> DataFrame:
    return has_role.join(old.select("user_id", "role_id").distinct(), ["user_id", "role_id"], "left_anti")


def role_matrix(has_role: DataFrame, granted: DataFrame) -> DataFrame:
    """(role_id, classes, max_level) over ``granted`` of roles (role_id, class_id, level)."""
    return granted.groupBy("role_id").agg(F.array_sort(F.collect_set("class_id")).alias("classes"), F.max("level").alias("max_level"))
