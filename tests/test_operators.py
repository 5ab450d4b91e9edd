import json
import random

import pytest
from pyspark.sql import functions as F

from terrafold import schemas
from terrafold.operators import access, dashboard, jobs, linking, paging, versions


def test_state_fold_equals_python(spark):
    rng = random.Random(1)
    names = list(jobs.TRANSITIONS)
    events = [(k, t, rng.choice(names)) for k in range(30) for t in range(rng.randint(1, 20))]
    got = {r["job_id"]: (r["status"], r["retry_count"], r["illegal"]) for r in jobs.fold_states(spark.createDataFrame(events, "job_id int, at int, event string"), "job_id", ["at"], "event").collect()}
    for k in got:
        status, retries, illegal = "QUEUED", 0, 0
        for _, _, e in sorted(x for x in events if x[0] == k):
            needs, leads = jobs.TRANSITIONS[e]
            if status == needs:
                status, retries = leads, retries + (e in ("retry", "recover"))
            else:
                illegal += 1
        assert got[k] == (status, retries, illegal)


def test_state_fold_of_a_hot_key_holds_no_long_array(spark):
    rng = random.Random(5)
    names = list(jobs.TRANSITIONS)
    events = [(1, t, rng.choice(names)) for t in range(3000)] + [(k, t, rng.choice(names)) for k in (0, 2, None) for t in range(40)]
    rng.shuffle(events)
    rows = spark.createDataFrame(events, "job_id int, at int, event string")
    got = {r["job_id"]: (r["status"], r["retry_count"], r["illegal"]) for r in jobs.fold_states(rows, "job_id", ["at"], "event", run_bits=3).collect()}
    assert set(got) == {0, 1, 2, None}
    for k in got:
        status, retries, illegal = "QUEUED", 0, 0
        for _, _, e in sorted((x for x in events if x[0] == k), key=lambda x: x[1]):
            needs, leads = jobs.TRANSITIONS[e]
            if status == needs:
                status, retries = leads, retries + (e in ("retry", "recover"))
            else:
                illegal += 1
        assert got[k] == (status, retries, illegal)


def test_create_or_get_is_idempotent(spark):
    have = spark.createDataFrame([("p", "a")], "project string, key string")
    asked = spark.createDataFrame([("p", "a", 1), ("p", "b", 3), ("p", "b", 2), ("q", "a", 4)], "project string, key string, at int")
    assert sorted(tuple(r) for r in jobs.create_or_get(have, asked, ["project", "key"], "at").collect()) == [("p", "b", 2), ("q", "a", 4)]


def test_optimistic_lock(spark):
    current = spark.createDataFrame([("p", 3)], "parcel_id string, version int")
    edits = spark.createDataFrame([(1, "p", 3, "g1"), (2, "p", 3, "g2"), (3, "p", 2, "g3"), (4, "x", 1, "g4")], "edit_id int, parcel_id string, expected_version int, geometry string")
    new, refused = versions.append_version(current, edits)
    assert [tuple(r) for r in new.collect()] == [("p", 4, "g1")]
    assert sorted((r["edit_id"], r["reason"]) for r in refused.collect()) == [(2, "VERSION_CONFLICT"), (3, "VERSION_CONFLICT"), (4, "NOT_FOUND")]


def test_match_statuses(spark):
    parcels = spark.createDataFrame([("p1", "x", "12/3", {"village": "a", "taluk": "t"}, 100.0), ("p2", "x", "9", {"village": "b"}, 50.0), ("p3", "x", "9", {}, None)], "parcel_id string, project_id string, identifier string, admin map<string,string>, area_m2 double")
    ids = spark.createDataFrame([("r1", "x", "12/3"), ("r1", "x", "12/3"), ("r2", "x", "9"), ("r3", "y", "12/3")], "record_id string, project_id string, identifier string")
    admin = spark.createDataFrame([("r1", "village", "a"), ("r1", "tehsil", "t"), ("r2", "village", "z")], "record_id string, field string, value string")
    areas = spark.createDataFrame([("r1", 103.0), ("r2", 50.0)], "record_id string, area_m2 double")
    got = {(r["record_id"], r["parcel_id"]): r for r in linking.match_records(ids, parcels, admin, areas).collect()}
    assert set(got) == {("r1", "p1"), ("r2", "p2"), ("r2", "p3")}
    assert got["r1", "p1"]["link_status"] == "CONFIRMED" and got["r1", "p1"]["confidence"] == pytest.approx(0.99)
    assert got["r2", "p2"]["admin_conflicts"] == 1 and got["r2", "p2"]["link_status"] == "REVIEW_REQUIRED" and got["r2", "p3"]["rank"] == 1


def test_duplicates_ignore_the_field(spark):
    rows = spark.createDataFrame([("d1", "survey_number", "12/3"), ("d2", "khata_number", "12/3"), ("d2", "khata_number", "12/3"), ("d3", "survey_number", ""), ("d4", "village", "12/3")], "document_id string, field_name string, identifier string")
    assert [tuple(r) for r in linking.duplicate_records(rows).collect()] == [("12/3", 2, "d1")]
    assert [tuple(r) for r in linking.duplicate_members(rows).collect()] == [("12/3", "d1"), ("12/3", "d2")]


def test_mismatch_boundaries(spark):
    rows = spark.createDataFrame([("a", 95.0, 100.0), ("b", 94.0, 100.0), ("c", 80.0, 100.0), ("d", 0.0, 100.0)], "link_id string, document_area_m2 double, parcel_area_m2 double")
    assert sorted((r["link_id"], r["severity"]) for r in linking.area_mismatches(rows).collect()) == [("b", "MEDIUM"), ("c", "HIGH")]
    with pytest.raises(ValueError):
        linking.area_mismatches(rows, -0.1)


def test_link_decisions(spark):
    links = spark.createDataFrame([("l1", "r", "SUGGESTED"), ("l2", "r", "REVIEW_REQUIRED"), ("l3", "s", "CONFIRMED"), ("l4", "s", "SUGGESTED")], "link_id string, record_id string, link_status string")
    decisions = spark.createDataFrame([("l1", "CONFIRMED"), ("l2", "CONFIRMED"), ("l4", "CONFIRMED"), ("l3", "REJECTED")], "link_id string, decision string")
    got = {r["link_id"]: (r["link_status"], r["refused"]) for r in linking.resolve_links(links, decisions).collect()}
    assert got == {"l1": ("CONFIRMED", False), "l2": ("REVIEW_REQUIRED", True), "l3": ("CONFIRMED", True), "l4": ("SUGGESTED", True)}


def test_membership_and_permission_are_both_needed(spark):
    rows = spark.createDataFrame([("p1", 1), ("p2", 2)], "project_id string, n int")
    members = spark.createDataFrame([("p1", "u"), ("p2", "admin")], "project_id string, user_id string")
    granted = spark.createDataFrame([("u", "record:read")], "user_id string, code string")
    assert [r["n"] for r in access.visible(rows, members, granted, "u", "record:read").collect()] == [1]
    assert access.visible(rows, members, granted, "u", "record:publish").count() == 0
    assert access.visible(rows, members, granted, "admin", "record:read").count() == 0
    held = spark.createDataFrame([("u", "VIEWER"), ("u", "REVIEWER")], "user_id string, role string")
    assert access.effective_role(held).first()["role"] == "REVIEWER"


def test_search_limits_before_it_deduplicates(spark):
    a = spark.createDataFrame([("x", 1, "same"), ("x", 2, "same"), ("x", 3, "other")], "kind string, id long, label string")
    got = paging.ranked_search([a.filter("id < 3"), a.filter("id = 3")], 2, ["kind", "label"]).collect()
    assert [(r["id"], r["label"]) for r in got] == [(1, "same")]


def test_pairs_and_pages(spark):
    a, b = spark.createDataFrame([("s1",), ("s2",)], "stem string"), spark.createDataFrame([("s2",), ("s3",)], "stem string")
    assert sorted(tuple(r) for r in paging.paired(a, b, "stem").collect()) == [("s1", True, False), ("s2", True, True), ("s3", False, True)]
    with pytest.raises(ValueError):
        paging.page(a, "stem", limit=500)


def test_quality_rules(spark):
    rows = spark.createDataFrame([("l1", "v1", "p1", "CONFIRMED"), ("l2", "v1", "p2", "CONFIRMED"), ("l3", "v1", "p1", "REJECTED"), ("l4", "v2", "p1", "WRONG")], "id string, validation_result_id string, parcel_id string, link_status string")
    got = {r["rule"]: r["broken"] for r in schemas.violations("record_parcel_links", rows).collect()}
    assert got == {"link_status_values": 1, "unique_validation_result_id_parcel_id": 0, "unique_validation_result_id": 1}
    assert len(schemas.TABLES) == 27
    for columns in schemas.TABLES.values():
        spark.createDataFrame([], columns)


def test_upsert_outcomes(spark):
    old = spark.createDataFrame([("a", "LOW", "s", "OPEN"), ("b", "LOW", "s", "RESOLVED"), ("c", "LOW", "s", "OPEN")], "issue_key string, severity string, summary string, status string")
    new = spark.createDataFrame([("a", "HIGH", "t"), ("b", "HIGH", "t"), ("d", "HIGH", "t")], "issue_key string, severity string, summary string")
    got = {r["issue_key"]: (r["severity"], r["status"], r["outcome"]) for r in linking.upsert_issues(old, new).collect()}
    assert got == {"a": ("HIGH", "OPEN", "refreshed"), "b": ("LOW", "RESOLVED", "left"), "c": ("LOW", "OPEN", "kept"), "d": ("HIGH", "OPEN", "created")}


def test_dashboard_and_directory(spark):
    rows = spark.createDataFrame([("A",), ("A",), ("B",)], "status string")
    assert tuple(dashboard.pivoted(rows, "status", ["A", "B", "C"]).first()) == (2, 1, 0)
    users = spark.createDataFrame([("u1", "ADM-TN-000001", "a@x", "Ann", True), ("u2", "VWR-TN-000002", "b@x", "Bob", False)], "id string, login_id string, email string, full_name string, is_active boolean")
    roles = spark.createDataFrame([("u1", "VIEWER"), ("u1", "ADMIN")], "user_id string, role string")
    assert [(r["id"], r["roles"]) for r in access.directory(users, roles, "an").collect()] == [("u1", ["ADMIN", "VIEWER"])]
    assert access.permission_matrix(spark).filter(F.col("role") == "ADMIN").count() == len(access.PERMISSIONS)


def test_rejections_need_a_reason(spark):
    links = spark.createDataFrame([("l1", "r", "SUGGESTED", None), ("l2", "r", "SUGGESTED", "old")], "link_id string, record_id string, link_status string, reason string")
    decisions = spark.createDataFrame([("l1", "REJECTED", " "), ("l2", "REJECTED", "wrong parcel")], "link_id string, decision string, reason string")
    got = {r["link_id"]: (r["link_status"], r["refused"]) for r in linking.resolve_links(links, decisions).collect()}
    assert got == {"l1": ("SUGGESTED", True), "l2": ("REJECTED", False)}


def test_suggestions_say_what_they_rest_on(spark):
    parcels = spark.createDataFrame([("p1", "x", "12/3", {"village": "a", "taluk": "t"}, 100.0), ("p2", "x", "9", {"village": "b"}, None)], "parcel_id string, project_id string, identifier string, admin map<string,string>, area_m2 double")
    ids = spark.createDataFrame([("r1", "x", "12/3"), ("r2", "x", "9"), ("r3", "x", "9"), ("r4", "x", "9")], "record_id string, project_id string, identifier string")
    admin = spark.createDataFrame([("r1", "village", "a"), ("r1", "tehsil", "t"), ("r2", "village", "z")], "record_id string, field string, value string")
    matches = linking.match_records(ids, parcels, admin, spark.createDataFrame([("r1", 103.0)], "record_id string, area_m2 double"))
    said = {r["record_id"]: json.loads(r["rationale"]) for r in linking.with_rationale(matches).collect()}
    assert said["r1"]["match_factors"] == {"exact_identifier": True, "matching_admin_fields": ["village", "tehsil"], "conflicting_admin_fields": [], "area_compatible": True}
    assert said["r1"]["area_comparison"]["tolerance"] == 0.05 and said["r2"]["area_comparison"] is None and said["r2"]["match_factors"]["conflicting_admin_fields"] == ["village"]
    evidence = spark.createDataFrame(
        [("r1", 1, "survey_number", "12/3", 5, 2), ("r1", 1, "survey_number", "12/3", 5, 2), ("r1", 2, "tahsil", "t", 5, 3), ("r1", 3, "village", "z", 5, 4), ("r1", 4, "owner_name", "12/3", 5, 5), ("r2", 5, "khata_number", "9", 6, 1), ("r2", 6, "village", "b", 6, 2), ("r2", 7, None, None, None, None)],
        "record_id string, field_id int, field_name string, value string, source_id int, page_number int",
    )
    fields = linking.contributing_fields(matches, parcels, evidence)
    assert sorted(r["field_id"] for r in fields.collect()) == [1, 2, 5]  # r2's village agrees with the parcel here, but not where the match was made
    records = spark.createDataFrame([(f"r{k}", "VALIDATED", "VALID" if k < 4 else "INVALID") for k in (1, 2, 3, 4)], "record_id string, document_status string, validation_status string")
    links = spark.createDataFrame([("r2", "p2", "REJECTED"), ("r3", "p2", "SUGGESTED")], "record_id string, parcel_id string, link_status string")
    added, tasks, audit = linking.suggest(matches, records, links, fields)
    assert sorted((r["link_id"], r["link_status"]) for r in added.collect()) == [("r1:p1:1", "CONFIRMED"), ("r2:p2:2", "REVIEW_REQUIRED")]
    assert [(r["target_id"], r["source_refs"]) for r in tasks.collect()] == [("r2:p2:2", ["document:6:page:1", "parcel:p2"])]
    assert sorted(r["action"] for r in audit.collect()) == ["record_parcel_link.auto_confirmed", "record_parcel_link.suggested"]
    none, no_tasks, _ = linking.suggest(matches.limit(0), records.limit(0), links.limit(0), fields.limit(0))
    assert none.count() == 0 and no_tasks.count() == 0


def test_documents_queue_once(spark):
    requests = spark.createDataFrame([(1, "a", None), (2, "a", True), (3, "b", False), (4, "b", True), (5, "c", True), (6, "z", False), (7, "e", True)], "request_id int, document_id string, reprocess boolean")
    documents = spark.createDataFrame([("a", "FAILED"), ("b", "VALIDATED"), ("c", "UPLOADED"), ("e", "VALIDATED")], "document_id string, status string")
    results = spark.createDataFrame([("a", 2), ("b", 1), ("e", 1)], "document_id string, version int")
    details = spark.createDataFrame([("j1", "b", 1), ("j2", "b", 2), ("j3", "a", 1)], "job_id string, document_id string, created_at int")
    known = spark.createDataFrame([("j1", "QUEUED", "k1"), ("j2", "PROCESSING", "k2"), ("j3", "COMPLETED", "k3"), ("j4", "COMPLETED", "document:e:ocr:2")], "job_id string, status string, idempotency_key string")
    got = {r["request_id"]: (r["outcome"], r["job_id"], r["key"]) for r in jobs.queue_documents(requests, documents, results, details, known).collect()}
    assert got[1] == ("QUEUED", None, "document:a:ocr:3") and got[2] == ("ACTIVE", None, None)
    assert got[3] == got[4] == ("ACTIVE", "j2", None) and got[7] == ("EXISTING", "j4", "document:e:ocr:2")
    assert got[5][0] == "NO_EARLIER_RESULT" and got[6][0] == "DOCUMENT_NOT_FOUND"


def test_sign_in_folds_each_column_its_way(spark):
    users = spark.createDataFrame([(1, "ADM-TN-000001", "A@x.org"), (2, "adm-tn-000001", "b@x.org"), (3, None, None)], "id int, login_id string, email string")
    assert [r["id"] for r in access.sign_in_user(users, " adm-tn-000001\u00a0").collect()] == [1]
    assert [r["id"] for r in access.sign_in_user(users, "a@X.ORG").collect()] == [1]


def test_exact_percentiles_by_ranges(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from terrafold.functions import raster

    rng = random.Random(6)
    rows = [(b, rng.choice([rng.uniform(-5, 5), 3.0, 1e6]) if b else 7.0) for b in range(4) for _ in range(200 + b)] + [(9, 1.5), (10, None), (11, 1.0), (11, 2.0)]
    df = spark.createDataFrame(rows, "b int, v double").repartition(3)
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    want = {r["b"]: r["p"] for r in df.filter("v IS NOT NULL").groupBy("b").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    for ranges in (4096, 2):
        monkeypatch.setattr(raster, "RANGES", ranges)
        got = {r["b"]: r["_p"] for r in raster.percentiles(df, "b", "v", shares).collect()}
        assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b], rel=1e-12) for b in want)


def test_pages_follow_each_other(spark):
    from terrafold.operators import paging

    rows = spark.createDataFrame([(k % 3, k) for k in range(20)], "a int, b int")
    keys, last, seen = {"a": "desc", "b": "asc"}, None, []
    while page := paging.page_after(rows, keys, last, 7).collect():
        seen += [tuple(r) for r in page]
        last = page[-1].asDict()
    assert seen == sorted(((k % 3, k) for k in range(20)), key=lambda r: (-r[0], r[1]))
    with pytest.raises(ValueError):
        paging.page_after(rows, keys, None, 0)


def test_benchmark_rates_equal_plain_loops(spark, tables):
    from terrafold.plans import catalog

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    def rate(a, b):
        return distance(a, b) / len(a) if a else float(bool(b))

    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{tables[0]}/benchmark.parquet").collect()}
    pairs = [(texts[k], texts[k + 1]) for k in texts if k + 1 in texts]
    got = catalog.benchmark_rollup(spark, tables[0]).first()
    assert (got["completed"], got["failed"]) == (len(pairs), len(texts) - len(pairs))
    assert got["mean_cer"] == pytest.approx(sum(rate(a, b) for a, b in pairs) / len(pairs)) and got["mean_wer"] == pytest.approx(sum(rate(a.split(), b.split()) for a, b in pairs) / len(pairs))
