"""Group membership: who may see a chunk, and what a principal's claims mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusward import schemas
from corpusward.functions.text import WS, WS_CHARS

PUBLIC = "Public"
ADMIN = "admin"

# File names that mark a restricted table, and who may read it.
RESTRICTED_NAMES = ("salary", "payroll", "financial")
RESTRICTED_GROUPS = ("HR", "Management", "Finance")

# Folder and file extension to source type.
FOLDER_SOURCES = {"confluence": "confluence", "slack": "slack", "excel": "excel", "pdfs": "pdf"}
EXTENSION_SOURCES = {
    ".md": "confluence",
    ".json": "slack",
    ".csv": "excel",
    ".xlsx": "excel",
    ".pdf": "pdf",
}


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value for ``key`` in a small fixed table, null if absent."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def section_groups(section: Column) -> Column:
    """Groups named by the section's own ``Allowed Groups`` line, else Public."""
    line = F.regexp_extract(section, rf"(?i)>{WS}*\*\*Allowed Groups:\*\*{WS}*([^\n]+)", 1)
    named = F.transform(F.split(line, ","), lambda g: F.btrim(g, F.lit(WS_CHARS)))
    return F.when(line == "", strings(PUBLIC)).otherwise(F.filter(named, lambda g: g != ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def filename_groups(path: Column) -> Column:
    """Restricted groups when the base name says so, else Public."""
    hit = F.lower(basename(path)).rlike("|".join(RESTRICTED_NAMES))
    return F.when(hit, strings(*RESTRICTED_GROUPS)).otherwise(strings(PUBLIC))


def extension_source(path: Column) -> Column:
    """Source type by lower-cased extension; null means unsupported.

    The extension starts at the last dot that has something other than dots before it.
    """
    name = F.regexp_replace(basename(path), r"\A\.+", "")
    return lookup(F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1)), EXTENSION_SOURCES)


def effective_groups(groups: Column) -> Column:
    return F.array_union(F.coalesce(groups, strings()), strings(PUBLIC))


def may_see(allowed: Column, groups: Column) -> Column:
    """The access rule for chunks: any shared group, Public counted for everyone."""
    return F.coalesce(F.arrays_overlap(allowed, effective_groups(groups)), F.lit(False))


def may_reuse(allowed: Column, groups: Column) -> Column:
    """The access rule for cached answers: unmarked entries are open to all."""
    return (F.size(allowed) == 0) | may_see(allowed, groups)


def may_reuse_all(chunk_groups: Column, groups: Column) -> Column:
    """Stricter rule: every chunk behind the answer must be visible."""
    return F.forall(chunk_groups, lambda allowed: may_see(allowed, groups))


def is_admin(groups: Column) -> Column:
    return F.coalesce(F.array_contains(groups, ADMIN), F.lit(False))


def _present(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def principal(claims_json: Column) -> Column:
    """User name and groups from an identity token's claims."""
    c = F.from_json(claims_json, schemas.CLAIMS)
    none = strings()
    named = F.array_union(
        F.array_union(
            F.coalesce(c["groups"], none), F.coalesce(c["realm_access"]["roles"], none)
        ),
        F.coalesce(c["roles"], none),
    )
    user = F.coalesce(
        _present(c["preferred_username"]), _present(c["email"]), _present(c["sub"]),
        F.lit("oidc_user"),
    )
    return F.struct(
        user.alias("username"), effective_groups(named).alias("groups"), c["email"].alias("email")
    )


def object_uri(uri: Column) -> Column:
    """``minio://bucket/object`` as the ``s3a`` path Spark readers take."""
    return F.regexp_replace(uri, r"\Aminio://", "s3a://")


def object_bucket(uri: Column) -> Column:
    return F.regexp_extract(uri, r"\A[a-z0-9]+://([^/]*)", 1)


def object_name(uri: Column) -> Column:
    """Everything after the bucket; object names may hold slashes."""
    return F.regexp_extract(uri, r"\A[a-z0-9]+://[^/]*/(?s:(.*))\z", 1)
