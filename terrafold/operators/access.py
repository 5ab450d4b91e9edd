"""Roles, permissions and project membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roles in order of rank, and their permissions.
ROLES = ("ADMIN", "OFFICER", "REVIEWER", "SURVEYOR", "VIEWER")
PERMISSIONS = (
    "project:read", "project:create", "project:update", "project:member_manage", "document:upload", "document:read", "document:process", "document:reprocess", "field:read", "field:correct",
    "record:read", "record:publish", "validation:run", "validation:resolve", "review:read", "review:act", "imagery:upload", "geoai:process", "geo:read", "geo:edit_draft", "geo:approve",
    "export:read", "dashboard:read", "audit:read", "user:manage", "role:read", "role:manage", "system:admin",
)
ROLE_PERMISSIONS = {
    "ADMIN": PERMISSIONS,
    "OFFICER": (
        "project:read", "project:create", "project:update", "document:upload", "document:read", "document:process", "document:reprocess", "field:read", "field:correct", "record:read",
        "validation:run", "validation:resolve", "review:read", "dashboard:read", "audit:read", "export:read", "geo:read", "imagery:upload",
    ),
    "REVIEWER": (
        "project:read", "document:read", "field:read", "field:correct", "record:read", "validation:run", "validation:resolve", "review:read", "review:act", "geo:read", "geo:approve",
        "dashboard:read", "export:read",
    ),
    "SURVEYOR": ("project:read", "document:read", "record:read", "imagery:upload", "geoai:process", "geo:read", "geo:edit_draft", "dashboard:read", "export:read"),
    "VIEWER": ("project:read", "document:read", "record:read", "geo:read", "dashboard:read", "export:read"),
}


def permission_matrix(spark: SparkSession) -> DataFrame:
    """(role, permission): a fixed table of under 100 rows."""
    return spark.createDataFrame([(r, p) for r, ps in ROLE_PERMISSIONS.items() for p in ps], "role string, permission string")


def user_permissions(user_roles: DataFrame, roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, code), distinct. Spark broadcasts the grants if they are as small as roles usually are."""
    grants = role_permissions.join(permissions.select(F.col("id").alias("permission_id"), "code"), "permission_id").join(roles.select(F.col("id").alias("role_id")), "role_id")
    return user_roles.join(grants.select("role_id", "code"), "role_id").select("user_id", "code").distinct()


def visible(rows: DataFrame, members: DataFrame, granted: DataFrame, user_id: str, permission: str) -> DataFrame:
    """Rows of the projects that a user belongs to, if the user holds the permission; no role passes without membership."""
    allowed = granted.filter((F.col("user_id") == user_id) & (F.col("code") == permission)).select("user_id")
    projects = members.filter(F.col("user_id") == user_id).join(allowed, "user_id", "left_semi").select("project_id")
    return rows.join(projects, "project_id", "left_semi")


def role_rank(column: str = "role"):
    rank = F.lit(len(ROLES))
    for k, role in enumerate(ROLES):
        rank = F.when(F.col(column) == role, k).otherwise(rank)
    return rank


def effective_role(user_roles: DataFrame) -> DataFrame:
    """(user_id, role): the first of the fixed order that a user holds."""
    return user_roles.groupBy("user_id").agg(F.min_by("role", role_rank()).alias("role"))


def live_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that are neither revoked nor expired."""
    return sessions.filter("revoked_at IS NULL AND expires_at > current_timestamp()")


def directory(users: DataFrame, user_roles: DataFrame, text: str | None = None) -> DataFrame:
    """Active users whose login id, e-mail or name holds the text, each with the sorted list of roles."""
    from .paging import contains_any

    found = users.filter("is_active")
    if text:
        found = found.filter(contains_any(text, "login_id", "email", "full_name", fold="lower"))
    roles = user_roles.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return found.join(roles, found.id == roles.user_id, "left").select("id", "login_id", "email", "full_name", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def sign_in_user(users: DataFrame, identifier: str) -> DataFrame:
    """Users whose login id is the identifier in upper case or whose e-mail is it whatever the case; ends are trimmed first."""
    from ..functions.text import trimmed

    said = trimmed(F.lit(identifier))
    return users.filter((F.col("login_id") == F.upper(said)) | (F.lower("email") == F.lower(said)))


def project_members(members: DataFrame, users: DataFrame, project_id, active: bool | None = None) -> DataFrame:
    """Members of a project with their accounts, in order of joining. `active` keeps active or closed accounts only."""
    accounts = users.select(F.col("id").alias("user_id"), "login_id", "full_name", "is_active")
    found = members.filter(F.col("project_id") == project_id).join(accounts, "user_id")
    if active is not None:
        found = found.filter(F.col("is_active") == active)
    return found.select("user_id", "role", "created_at", "login_id", "full_name", "is_active").orderBy("created_at", "user_id")


def can_be_assigned(users: DataFrame, members: DataFrame, granted: DataFrame, project_id: str) -> DataFrame:
    """Users who can be given a review task of a project: active, members, and allowed to act on reviews."""
    eligible = users.filter("is_active").join(members.filter(F.col("project_id") == project_id).select(F.col("user_id").alias("id")), "id", "left_semi")
    return eligible.join(granted.filter("code = 'review:act'").select(F.col("user_id").alias("id")), "id", "left_semi")
