import datetime as dt

from pyspark.sql import functions as F

from swarmframe.operators import access as A
from swarmframe.schemas import REVOCATIONS, USERS

T = dt.datetime(2024, 1, 1, 12)


def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


BATCH = "seq bigint, email string, password string, password_hash string, full_name string, role string"


def users(spark):
    return spark.createDataFrame([(1, "root@x.org", "h", "Root", "admin", T, T), (2, "ann@x.org", "h", "Ann", "user", T, T),
                                  (7, "bob@x.org", "h", "Bob", "user", T, T)], USERS)


def hours(n):
    return T + dt.timedelta(hours=n)


def test_add_users(spark):
    rows = [(10, "new@X.org", "longenough", "h", "New", None), (11, "new@x.org", "longenough", "h", "Again", "admin"),
            (12, "ann@x.org", "longenough", "h", "Ann", None), (13, "bad", "longenough", "h", "Bad", None),
            (14, "c@x.org", "short", "h", "Carl", None), (15, "c@x.org", "longenough", "h", "C", None),
            (16, "c@x.org", "longenough", "h", "Carl", "admin"), (200000, "d@x.org", "longenough", "h", "Dora", None)]
    table, results = A.add_users(users(spark), spark.createDataFrame(rows, BATCH), now())
    got = {r.seq: (r.code, r.id) for r in results.collect()}
    assert got == {10: (201, 8), 11: (400, None), 12: (400, None), 13: (422, None), 14: (422, None), 15: (422, None),
                   16: (201, 9), 200000: (201, 10)}
    new = {r.id: r for r in table.collect()}
    assert len(new) == 6 and new[8].role == "user" and new[8].email == "new@x.org" and new[9].role == "admin"
    kinds = {r.seq: r.error_kind for r in A.validate_users(spark.createDataFrame(rows, BATCH)).collect()}
    assert (kinds[13], kinds[14], kinds[15], kinds[16]) == ("bad_email", "short_password", "short_name", None)
    empty = spark.createDataFrame([], USERS)
    assert sorted(r.id for r in A.add_users(empty, spark.createDataFrame(rows[:1], BATCH), now())[0].collect()) == [1]


def test_delete_lookup_touch(spark):
    ids = spark.createDataFrame([(1, 2), (2, 2), (3, 99)], "seq bigint, id bigint")
    table, results = A.delete_users(users(spark), ids)
    assert sorted(r.id for r in table.collect()) == [1, 7]
    assert {r.seq: r.code for r in results.collect()} == {1: 204, 2: 404, 3: 404}
    keys = spark.createDataFrame([(1, 7, None), (2, None, "ann@x.org"), (3, 50, None)], "seq int, id bigint, email string")
    found = {r.seq: (r.found, r.full_name) for r in A.lookup_users(users(spark), keys).collect()}
    assert found == {1: (True, "Bob"), 2: (True, "Ann"), 3: (False, None)}
    assert "password_hash" not in A.public_user(users(spark)).columns
    changes = spark.createDataFrame([(1, None, "Root"), (2, "admin", None)], "id bigint, role string, full_name string")
    later = F.lit("2024-02-01 00:00:00").cast("timestamp")
    got = {r.id: (r.role, r.updated_at) for r in A.touch_updated_at(users(spark), changes, later).collect()}
    assert got == {1: ("admin", T), 2: ("admin", dt.datetime(2024, 2, 1)), 7: ("user", T)}


def test_decision_order(spark):
    revoked = spark.createDataFrame([("r", T, hours(1)), ("old", T, hours(-1))], REVOCATIONS)
    ok = dict(token="t", valid=True, exp=hours(1), uid=2, email="ann@x.org", role="user", route="view_by_id", target=2, mail=None)
    cases = [
        (dict(), 200, "ok"), (dict(token="r", valid=False), 401, "revoked"), (dict(token="old"), 200, "ok"),
        (dict(valid=False, uid=None), 401, "invalid_token"), (dict(exp=hours(-1)), 401, "invalid_token"),
        (dict(uid=None, route="add_user"), 401, "missing_claims"), (dict(email=None), 401, "missing_claims"),
        (dict(route="add_user"), 403, "admin_only"), (dict(route="delete_user", target=99), 403, "admin_only"),
        (dict(route="view_by_email", mail="bob@x.org", role=None), 403, "admin_only"),
        (dict(target=7), 403, "own_profile_only"), (dict(target=99), 403, "own_profile_only"),
        (dict(target=7, role="admin"), 200, "ok"), (dict(target=99, role="admin"), 404, "no_such_user"),
        (dict(uid=99, target=99), 404, "no_such_user"), (dict(route="add_user", role="admin", target=None), 201, "ok"),
        (dict(route="delete_user", role="admin", target=7), 204, "ok"),
        (dict(route="delete_user", role="admin", target=99), 404, "no_such_user"),
        (dict(route="view_by_email", role="admin", target=None, mail="bob@x.org"), 200, "ok"),
        (dict(route="view_by_email", role="admin", target=None, mail="no@x.org"), 404, "no_such_user"),
        (dict(route="view_by_email", role="admin", target=None, mail="2"), 404, "no_such_user"),
    ]
    rows = []
    for i, (change, _, _) in enumerate(cases):
        c = {**ok, **change}
        rows.append((i, c["token"], c["valid"], c["exp"], c["uid"], c["email"], c["role"], c["route"], c["target"], c["mail"], T))
    requests = spark.createDataFrame(rows, "request_id bigint, token string, token_valid boolean, exp timestamp, user_id bigint, "
                                           "email string, role string, route string, target_id bigint, target_email string, at timestamp")
    got = A.access_decisions(requests, revoked, users(spark)).orderBy("request_id").collect()
    assert [(r.code, r.reason) for r in got] == [(code, reason) for _, code, reason in cases]
    assert {r.code for r in A.access_decisions(requests, None, users(spark)).collect()} == {503}
    assert A.revoked_requests(requests, revoked).count() == 1
    assert A.open_requests(requests, revoked).count() == len(cases) - 1


def test_revocation_table(spark):
    tab = spark.createDataFrame([("a", hours(-3), hours(2)), ("b", hours(-3), hours(-1)), ("c", hours(-3), hours(0))], REVOCATIONS)
    row = A.revocation_stats(tab, now()).first()
    assert (row.active, row.total, row.expired) == (1, 3, 2)
    kept, removed = A.purge_expired(tab, now())
    assert [r.token for r in kept.collect()] == ["a"] and removed.first().removed == 2
    batch = spark.createDataFrame([(1, "a", hours(5)), (2, "d", hours(1)), (3, "d", hours(3)), (4, "e", hours(-1)), (5, "b", hours(1))],
                                  "seq bigint, token string, expires_at timestamp")
    got = {r.token: (r.blacklisted_at, r.expires_at) for r in A.revoke_tokens(tab, batch, now()).collect()}
    assert got == {"a": (T, hours(5)), "b": (T, hours(1)), "d": (T, hours(3))}


def test_sign_ups_with_sparse_request_numbers(spark):
    """Requests numbered by microseconds: ids still follow their order, and no task gets all of them."""
    users = spark.createDataFrame([(7, "a@b.c", "h", "Name", "user", None, None)],
                                  "id bigint, email string, password_hash string, full_name string, role string, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([(i * 1_000_003, f"u{i}@b.c", "secret12", "h", "Some Name", None) for i in range(500)],
                                  "seq bigint, email string, password string, password_hash string, full_name string, role string")
    _, results = A.add_users(users, batch, F.lit("2024-01-01").cast("timestamp"))
    assert [r.id for r in results.orderBy("seq").collect()] == list(range(8, 508))
    found = A.lookup_users(users, spark.createDataFrame([(7,), (8,)], "id bigint")).orderBy("id").collect()
    assert [r.found for r in found] == [True, False]
