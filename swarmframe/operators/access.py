"""User, token-revocation and request-log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmframe.plans.lookup import latest
from swarmframe.plans.scan import running

# Limits and default of a sign-up row.
MIN_PASSWORD = 8
MIN_NAME = 2
DEFAULT_ROLE = "user"
EMAIL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?$"

# Routes that only an administrator may call, and routes whose target must exist.
ADMIN_ROUTES = ("add_user", "view_by_email", "delete_user")
TARGET_ROUTES = ("view_by_id", "view_by_email", "delete_user")

PUBLIC = ["id", "email", "full_name", "role", "created_at"]
CHUNK = 65536


def public_user(users: DataFrame) -> DataFrame:
    """User columns that may leave the system (never the password hash)."""
    return users.select(*PUBLIC)


def normal_email(email: Column | str) -> Column:
    """The address with its domain in lower case."""
    email = F.col(email) if isinstance(email, str) else email
    return F.concat_ws("@", F.substring_index(email, "@", 1), F.lower(F.substring_index(email, "@", -1)))


def validate_users(batch: DataFrame) -> DataFrame:
    """Add ``error_kind`` (first failing rule) to sign-up rows, fill the default role and normalise the address."""
    known = F.coalesce(F.col("email"), F.lit(""))
    kind = (F.when(~known.rlike(EMAIL), "bad_email")
            .when(F.coalesce(F.length("password"), F.lit(0)) < MIN_PASSWORD, "short_password")
            .when(F.coalesce(F.length("full_name"), F.lit(0)) < MIN_NAME, "short_name"))
    checked = batch.withColumn("error_kind", kind).withColumn("role", F.coalesce("role", F.lit(DEFAULT_ROLE)))
    return checked.withColumn("email", F.when(F.col("error_kind").isNull(), normal_email("email"))
                              .otherwise(F.col("email")))


def lookup_users(users: DataFrame, keys: DataFrame) -> DataFrame:
    """Public user and ``found`` for a batch of keys; ``keys`` has ``id``, ``email`` or both (id is tried first)."""
    marked = public_user(users).withColumn("_known", F.lit(True))
    if "id" in keys.columns and "email" in keys.columns:
        by_id = keys.filter(F.col("id").isNotNull())
        by_email = keys.filter(F.col("id").isNull())
        left = by_id.withColumnRenamed("email", "_email").join(marked, "id", "left").drop("_email")
        right = by_email.drop("id").join(marked, "email", "left")
        both = left.unionByName(right)
    else:
        both = keys.join(marked, "id" if "id" in keys.columns else "email", "left")
    return both.withColumn("found", F.coalesce("_known", F.lit(False))).drop("_known")


def add_users(users: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Old users and a sign-up batch -> (new users, results).

    ``batch``: seq (unique, the order of the requests), email, password, password_hash, full_name, role.
    ``results``: seq, code (201 created, 400 address taken, 422 invalid) and the new id.
    """
    checked = validate_users(batch)
    valid = checked.filter(F.col("error_kind").isNull())
    # the first valid row of each address wins; partial minima first, so a repeated address is no hot group
    firsts = valid.groupBy("email").agg(F.min("seq").alias("seq"))
    accepted = firsts.join(users.select("email"), "email", "left_anti").select("seq", F.lit(1).alias("_one"))
    # ids follow the order of the batch; counted in chunks of as many rows each, never in one task
    numbered = running(accepted, [], "seq", {"_one": "_place"}).drop("_one")
    top = users.select(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    numbered = numbered.select("seq", (F.col("_place") + top).cast("bigint").alias("id"))
    fresh = valid.join(numbered, "seq").select(
        "id", "email", "password_hash", "full_name", "role", now.alias("created_at"), now.alias("updated_at"))
    code = (F.when(F.col("error_kind").isNotNull(), 422).when(F.col("id").isNull(), 400).otherwise(201))
    results = checked.select("seq", "error_kind").join(numbered, "seq", "left").select("seq", code.alias("code"), "id")
    return users.unionByName(fresh.select(*users.columns)), results


def delete_users(users: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users without the requested ids, and per request (seq, id) code 204, or 404 where there is nothing to delete.

    A second request for the same id finds nothing.
    """
    firsts = ids.groupBy("id").agg(F.min("seq").alias("seq"))
    done = firsts.join(users.select("id"), "id", "left_semi").select("seq", F.lit(True).alias("_done"))
    results = ids.join(done, "seq", "left").select("seq", "id", F.when(F.col("_done"), 204).otherwise(404).alias("code"))
    return users.join(firsts.select("id"), "id", "left_anti").select(*users.columns), results


def touch_updated_at(users: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Apply changes (one row per id; null keeps a value); rows that really change get a new ``updated_at``."""
    columns = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = users.join(new, "id", "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)))
    value = {c: F.coalesce(f"_{c}", c) for c in columns}
    value["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    return joined.select(*[value.get(c, F.col(c)).alias(c) for c in users.columns])


def active_revocations(revocations: DataFrame, now: Column) -> DataFrame:
    """Revocations still in force."""
    return revocations.filter(F.col("expires_at") > now)


def revoked_requests(requests: DataFrame, revocations: DataFrame) -> DataFrame:
    """Requests whose token is revoked at the time of the request."""
    return _with_revocation(requests, revocations).filter("_revoked").drop("_revoked")


def open_requests(requests: DataFrame, revocations: DataFrame) -> DataFrame:
    """Requests whose token is not revoked at the time of the request."""
    return _with_revocation(requests, revocations).filter(~F.col("_revoked")).drop("_revoked")


def _with_revocation(requests: DataFrame, revocations: DataFrame) -> DataFrame:
    # the revocation table has one row per token, so a token used by many requests is split on their side
    until = revocations.select("token", F.col("expires_at").alias("_until"))
    return (requests.join(until, "token", "left")
            .withColumn("_revoked", F.coalesce(F.col("_until") > F.col("at"), F.lit(False))).drop("_until"))


def access_decisions(requests: DataFrame, revocations: DataFrame | None, users: DataFrame) -> DataFrame:
    """Status code and reason per request.

    ``requests``: request_id, token, token_valid, exp, user_id, email, role (token claims), route, target_id,
    target_email, at. The role is the token's, not the one in the users table. ``revocations=None`` means the
    revocation table cannot be read: every request is refused.
    """
    if revocations is None:
        return requests.select("request_id", F.lit(503).alias("code"), F.lit("revocations_unavailable").alias("reason"))
    checked = _with_revocation(requests, revocations)
    # one lookup for both kinds of target; requests without one get a key of their own, not a shared null
    wanted = F.when(F.col("route").isin("view_by_id", "delete_user"), F.concat(F.lit("i"), F.col("target_id"))).when(
        F.col("route") == "view_by_email", F.concat(F.lit("e"), F.col("target_email")))
    checked = checked.withColumn("_target", F.coalesce(wanted, F.concat(F.lit("-"), F.col("request_id"))))
    targets = users.select(F.explode(F.array(F.concat(F.lit("i"), F.col("id")), F.concat(F.lit("e"), F.col("email"))))
                           .alias("_target"), F.lit(True).alias("_exists"))
    joined = checked.join(targets, "_target", "left")
    admin = F.coalesce(F.col("role") == "admin", F.lit(False))
    own = F.coalesce(F.col("user_id") == F.col("target_id"), F.lit(False))
    rules = [
        (F.col("_revoked"), 401, "revoked"),
        (~F.coalesce(F.col("token_valid"), F.lit(False)) | F.coalesce(F.col("exp") < F.col("at"), F.lit(False)),
         401, "invalid_token"),
        (F.col("user_id").isNull() | F.col("email").isNull(), 401, "missing_claims"),
        (F.col("route").isin(*ADMIN_ROUTES) & ~admin, 403, "admin_only"),
        ((F.col("route") == "view_by_id") & ~own & ~admin, 403, "own_profile_only"),
        (F.col("route").isin(*TARGET_ROUTES) & F.col("_exists").isNull(), 404, "no_such_user"),
    ]
    code, reason = F, F
    for condition, number, name in rules:
        code, reason = code.when(condition, number), reason.when(condition, name)
    done = F.when(F.col("route") == "add_user", 201).when(F.col("route") == "delete_user", 204).otherwise(200)
    return joined.select("request_id", code.otherwise(done).alias("code"), reason.otherwise("ok").alias("reason"))


def purge_expired(revocations: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Revocations still in force, and one row with the number removed."""
    removed = revocations.agg(F.count_if(F.col("expires_at") <= now).alias("removed"))
    return active_revocations(revocations, now), removed


def revoke_tokens(revocations: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Add tokens that have not expired yet, replacing earlier entries of the same token, then purge.

    ``batch``: seq, token, expires_at; the last entry of a token counts.
    """
    rows = (batch.filter(F.col("expires_at") > now)
            .select("token", now.alias("blacklisted_at"), "expires_at", F.col("seq").alias("_seq")))
    old = revocations.select("token", "blacklisted_at", "expires_at", F.lit(None).cast("bigint").alias("_seq"))
    # nulls sort first, so any batch row beats the old entry
    merged = latest(old.unionByName(rows), ["token"], ["_seq"]).drop("_seq")
    return active_revocations(merged, now).select(*revocations.columns)


def revocation_stats(revocations: DataFrame, now: Column) -> DataFrame:
    """Active, total and expired entries."""
    stats = revocations.agg(F.count_if(F.col("expires_at") > now).alias("active"), F.count("*").alias("total"))
    return stats.select("active", "total", (F.col("total") - F.col("active")).alias("expired"))
