"""User, token and request-log queries over the customer and orders views."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmframe.operators import access as A
from swarmframe.queries.views import ACCESS, logouts, removals, requests, revocations, sign_ups, table, ts, users

NOW = "1998-03-05 00:30:00"
LATER = "2024-02-01 00:00:00"


def _plain(df, *columns):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c)
                       for c, t in df.dtypes if not columns or c in columns])


def public(spark, sf):
    return _plain(A.public_user(users(spark, sf)))


def looked_up(spark, sf):
    keys = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") * 2).alias("id"),
        F.concat(F.lit("customer."), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"), F.lit("@example.com"))
        .alias("email"))
    return A.lookup_users(users(spark, sf), keys).select("seq", "full_name", "role", "found")


def validated(spark, sf):
    return A.validate_users(sign_ups(spark, sf)).select("seq", "email", "role", "error_kind")


def added(spark, sf):
    return _plain(A.add_users(users(spark, sf), sign_ups(spark, sf), ts(LATER))[0])


def add_results(spark, sf):
    return A.add_users(users(spark, sf), sign_ups(spark, sf), ts(LATER))[1]


def touched(spark, sf):
    u = users(spark, sf)
    changes = u.filter(F.col("id") % 3 == 0).select(
        "id", F.when(F.col("id") % 2 == 0, "admin").alias("role"), F.lit(None).cast("string").alias("full_name"))
    return _plain(A.touch_updated_at(u, changes, ts(LATER)), "id", "role", "full_name", "updated_at")


def purge_count(spark, sf):
    return A.purge_expired(revocations(spark, sf), ts(NOW))[1]


_ADDED = ACCESS + """,
checked AS (
  SELECT *, CASE WHEN email = 'nobody' THEN 'bad_email' WHEN password_size < 8 THEN 'short_password'
                 WHEN length(full_name) < 2 THEN 'short_name' END AS error_kind FROM sign_ups),
accepted AS (
  SELECT min(seq) AS seq FROM checked WHERE error_kind IS NULL AND email NOT IN (SELECT email FROM users)
  GROUP BY email),
numbered AS (
  SELECT seq, row_number() OVER (ORDER BY seq) + (SELECT max(id) FROM users) AS id FROM accepted)"""

QUERIES = {
    "public_user": (public, f"WITH {ACCESS} SELECT id, email, full_name, role, created_at FROM users"),
    "lookup_users": (looked_up, f"""WITH {ACCESS}
SELECT o_orderkey AS seq, full_name, role, u.id IS NOT NULL AS found
FROM orders o LEFT JOIN users u ON u.id = o.o_custkey * 2"""),
    "validate_users": (validated, f"WITH {_ADDED} SELECT seq, email, role, error_kind FROM checked"),
    "add_users": (added, f"""WITH {_ADDED}
SELECT * FROM users UNION ALL
SELECT id, email, password_hash, full_name, role, TIMESTAMP '{LATER}', TIMESTAMP '{LATER}'
FROM checked JOIN numbered USING (seq)"""),
    "add_users_results": (add_results, f"""WITH {_ADDED}
SELECT seq, CASE WHEN error_kind IS NOT NULL THEN 422 WHEN id IS NULL THEN 400 ELSE 201 END AS code, id
FROM checked LEFT JOIN numbered USING (seq)"""),
    "delete_users": (lambda s, d: A.delete_users(users(s, d), removals(s, d))[0].select("id", "email"), f"""WITH {ACCESS}
SELECT id, email FROM users WHERE id NOT IN (SELECT id FROM removals)"""),
    "delete_users_results": (lambda s, d: A.delete_users(users(s, d), removals(s, d))[1], f"""WITH {ACCESS}
SELECT seq, id, CASE WHEN id IN (SELECT id FROM users)
                      AND row_number() OVER (PARTITION BY id ORDER BY seq) = 1 THEN 204 ELSE 404 END AS code
FROM removals"""),
    "touch_updated_at": (touched, f"""WITH {ACCESS}
SELECT id, full_name, CASE WHEN id % 6 = 0 THEN 'admin' ELSE role END AS role,
       CASE WHEN id % 6 = 0 AND role <> 'admin' THEN TIMESTAMP '{LATER}' ELSE updated_at END AS updated_at FROM users"""),
    "access_decisions": (
        lambda s, d: A.access_decisions(requests(s, d), revocations(s, d), users(s, d)), f"""WITH {ACCESS},
judged AS (
  SELECT request_id, route, CASE
    WHEN token IN (SELECT v.token FROM revoked v WHERE v.expires_at > asked_at) THEN '401 revoked'
    WHEN NOT token_valid OR exp < asked_at THEN '401 invalid_token'
    WHEN user_id IS NULL OR email IS NULL THEN '401 missing_claims'
    WHEN route <> 'view_by_id' AND role <> 'admin' THEN '403 admin_only'
    WHEN route = 'view_by_id' AND user_id <> target_id AND role <> 'admin' THEN '403 own_profile_only'
    WHEN route <> 'add_user' AND target_id NOT IN (SELECT id FROM users) THEN '404 no_such_user'
    WHEN route = 'add_user' THEN '201 ok' WHEN route = 'delete_user' THEN '204 ok' ELSE '200 ok' END AS verdict
  FROM requests)
SELECT request_id, CAST(split_part(verdict, ' ', 1) AS INTEGER) AS code, split_part(verdict, ' ', 2) AS reason
FROM judged"""),
    "revoked_requests": (
        lambda s, d: A.revoked_requests(requests(s, d), revocations(s, d)).select("request_id", "route"),
        f"""WITH {ACCESS}
SELECT request_id, route FROM requests SEMI JOIN revoked v ON v.token = requests.token AND v.expires_at > requests.asked_at"""),
    "open_requests": (
        lambda s, d: A.open_requests(requests(s, d), revocations(s, d)).select("request_id", "route"),
        f"""WITH {ACCESS}
SELECT request_id, route FROM requests ANTI JOIN revoked v ON v.token = requests.token AND v.expires_at > requests.asked_at"""),
    "active_revocations": (
        lambda s, d: _plain(A.active_revocations(revocations(s, d), ts(NOW))),
        f"WITH {ACCESS} SELECT * FROM revoked WHERE expires_at > TIMESTAMP '{NOW}'"),
    "revoke_tokens": (
        lambda s, d: _plain(A.revoke_tokens(revocations(s, d), logouts(s, d), ts(NOW))), f"""WITH {ACCESS},
fresh AS (
  SELECT token, TIMESTAMP '{NOW}' AS blacklisted_at, arg_max(expires_at, seq) AS expires_at
  FROM logouts WHERE expires_at > TIMESTAMP '{NOW}' GROUP BY token)
SELECT * FROM fresh UNION ALL
SELECT * FROM revoked WHERE token NOT IN (SELECT token FROM fresh) AND expires_at > TIMESTAMP '{NOW}'"""),
    "purge_expired": (
        lambda s, d: _plain(A.purge_expired(revocations(s, d), ts(NOW))[0], "token", "expires_at"),
        f"WITH {ACCESS} SELECT token, expires_at FROM revoked WHERE expires_at > TIMESTAMP '{NOW}'"),
    "purge_expired_count": (
        purge_count, f"WITH {ACCESS} SELECT count(*) AS removed FROM revoked WHERE expires_at <= TIMESTAMP '{NOW}'"),
    "revocation_stats": (
        lambda s, d: A.revocation_stats(revocations(s, d), ts(NOW)), f"""WITH {ACCESS}
SELECT count(*) FILTER (WHERE expires_at > TIMESTAMP '{NOW}') AS active, count(*) AS total,
       count(*) FILTER (WHERE expires_at <= TIMESTAMP '{NOW}') AS expired FROM revoked"""),
}
