"""Operators against small worked cases."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions.ids import uuid_of
from tidewatch.operators import access, audit, frontier, match, pages, rules, search, views
from tidewatch.plans import alerting

SPACE = ("test-embedding-model", "v1", 2, "unit_length")
RULE = "tenant_id string, source_filters array<string>, model string, model_version string, dimensions int, normalization string, alert_rule_id string, alert_rule_revision_id string, alert_embedding_id string, similarity_threshold float, rule_vector array<float>"
PAGE = "page_key string, tenant_id string, source_id string, model string, model_version string, dimensions int, normalization string, page_vector array<float>, max_candidates int"


def rule(name, vector, threshold=0.8, tenant="A", filters=(), version="v1"):
    return (tenant, list(filters), SPACE[0], version, *SPACE[2:], name, f"{name}-1", f"{name}-e", threshold, vector)


def page(key="p", tenant="A", source="s", vector=(1.0, 0.0), limit=100, version="v1"):
    return (key, tenant, source, SPACE[0], version, *SPACE[2:], list(vector), limit)


def matches(spark, page_rows, rule_rows, how=match.reverse_match):
    found = how(spark.createDataFrame(page_rows, PAGE), spark.createDataFrame(rule_rows, RULE))
    return sorted((r.page_key, r.alert_rule_id, r["rank"]) for r in found.collect())


def test_threshold_before_top_k(spark):
    rule_rows = [rule("A", [0.95, 0.3122499], 0.99), rule("B", [0.90, 0.4358899], 0.85)]
    for how in (match.reverse_match, match.reverse_match_join):
        assert matches(spark, [page(limit=1)], rule_rows, how) == [("p", "B", 1)]


def test_isolation(spark):
    nan = float("nan")
    rule_rows = [
        rule("ok", [1.0, 0.0]), rule("tenant", [1.0, 0.0], tenant="B"), rule("source", [1.0, 0.0], filters=["source:x"]),
        rule("version", [1.0, 0.0], version="v2"), rule("mine", [1.0, 0.0], filters=["source:s"]), rule("nan", [nan, 0.0]), rule("zero", [0.0, 0.0]),
    ]
    want = [("p", "mine", 1), ("p", "ok", 2)]
    for how in (match.reverse_match, match.reverse_match_join):
        assert matches(spark, [page()], rule_rows, how) == want
    assert matches(spark, [page()], []) == []


def test_small_blocks_equal_one(spark, sf):
    p = alerting.derived.page_vectors(spark, sf, 5)
    r = alerting._rule_vectors(spark, sf)
    show = lambda df: sorted((x.page_key, x.alert_embedding_id, x["rank"]) for x in df.collect())
    assert show(match.reverse_match(p, r)) == show(match.reverse_match_join(p, r))


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def fetch_rows(spark, contents, page="u"):
    rows = [(i, "A", "s", f"https://e.com/{page}", f"https://e.com/{page}", "", c, "text/html", 200, None, at(i)) for i, c in enumerate(contents)]
    return spark.createDataFrame(
        rows,
        "seq bigint, tenant_id string, source_id string, original_canonical_url string, canonical_url string, title string, content_text string, content_type string, http_status smallint, published_at timestamp, fetched_at timestamp",
    )


def simulate(contents, known=(), pointer=None):
    seen, out = set(known), []
    for c in contents:
        out.append((c not in seen, pointer))
        seen.add(c)
        pointer = c
    return out


def test_revision_chain_with_reverts(spark):
    contents = ["a", "b", "a", " a ", "c", "b"]
    arrived = pages.arrivals(fetch_rows(spark, contents))
    chain = pages.revision_chain(arrived).orderBy("seq").collect()
    name = {r.revision_id: r.content_text.strip() for r in chain}
    got = [(r.changed, name.get(r.pointer_before)) for r in chain]
    assert got == simulate([c.strip() for c in contents])
    now = pages.current_pages(arrived).first()
    assert name[now.latest_revision_id] == "b" and now.first_seen_at == at(0) and now.last_seen_at == at(5)


def test_chain_goes_on_from_stored_state(spark):
    contents = ["a", "b", "a", "c", "b", "d"]
    arrived = pages.arrivals(fetch_rows(spark, contents))
    first, second = arrived.where("seq < 3"), arrived.where("seq >= 3")
    latest = F.col("content_text") == "a"
    known = pages.revision_chain(first).where("changed").select("revision_id", "page_id", latest.alias("is_latest"))
    chain = pages.revision_chain(second, known=known).orderBy("seq").collect()
    name = {r.revision_id: r.content_text for r in arrived.collect()}
    assert [(r.changed, name.get(r.pointer_before)) for r in chain] == simulate(contents)[3:]


def test_candidates_are_idempotent(spark, sf):
    new = alerting._candidates(spark, sf).cache()
    inserted, existing, conflicts = match.merge_candidates(new, new, match.REVERSE_EVIDENCE)
    assert (inserted.count(), existing.count(), conflicts.count()) == (0, new.count(), 0)
    other = new.withColumn("page_embedding_sha256", F.lit("x"))
    inserted, existing, conflicts = match.merge_candidates(new, other, match.REVERSE_EVIDENCE)
    assert (inserted.count(), existing.count(), conflicts.count()) == (0, 0, new.count())
    assert match.without_conflicted_pages(new, conflicts).count() == 0
    assert new.where(F.size(audit.errors_of("match_candidates")) > 0).count() == 0


SUBMISSION = "seq bigint, tenant_id string, owner_subject string, rule_ref string, name string, query_text string, embedding_model string, similarity_threshold double, source_filters array<string>, delivery_channels array<string>, enabled boolean"


def test_rule_submissions(spark):
    u = "00000000-0000-0000-0000-000000000001"
    rows = [
        (1, "A", "me", "r1", "  name ", " watch   this ", " m ", 0.8, [u, f"source:{u}"], ["mail", "in_app", "mail "], None),
        (2, "A", "me", "r1", "name", "watch this too", "m", 0.8, [], [], True), (3, "A", "me", "bad", "é" * 129, "ab", "m", 1.5, ["x"], [""] * 1, True),
        (4, "A", "me", "nan", "n", "abc", "m", float("nan"), None, None, True),
    ]
    made, revisions, rejected = rules.create_rules(spark.createDataFrame(rows, SUBMISSION), F.lit(at(0)))
    first = revisions.where("revision_number = 1").first()
    assert (first.name, first.query_text, first.embedding_model, first.source_filters) == ("name", "watch this", "m", [f"source:{u}"])
    assert first.delivery_channels == ["in_app", "mail"] and first.enabled
    assert revisions.count() == 2 and made.count() == 1
    bad = {r.seq: r.errors for r in rejected.collect()}
    assert bad == {3: ["name", "query_text", "similarity_threshold", "delivery_channels", "invalid_rule_filter"], 4: ["similarity_threshold"]}


def test_active_limit(spark):
    log = [("A", "me", f"r{i:02d}", i, True) for i in range(11)]
    df = spark.createDataFrame(log, "tenant_id string, owner_subject string, alert_rule_id string, seq bigint, enable boolean")
    refused = lambda d: sorted(r.alert_rule_id for r in d.where("NOT admitted").collect())
    assert refused(rules.admit_activations(df)) == refused(rules.admit_activation_log(df)) == ["r10"]
    again = spark.createDataFrame([*log[:10], ("A", "me", "r03", 10, False), ("A", "me", "r10", 11, True), ("A", "me", "r11", 12, True)], df.schema)
    assert refused(rules.admit_activation_log(again)) == ["r11"]


def test_fold_equals_window_without_disables(spark, sf):
    log = alerting.derived.activations(spark, sf).where("enable")
    window = rules.admit_activations(log.withColumn("seq", F.struct("ts", "event_id")))
    fold = rules.admit_activation_log(log).groupBy("tenant_id", "owner_subject", "alert_rule_id").agg(F.max("admitted").alias("a"))
    assert sorted((r.owner_subject, r.alert_rule_id) for r in window.where("admitted").collect()) == sorted(
        (r.owner_subject, r.alert_rule_id) for r in fold.where("a").collect()
    )


def test_visibility(spark):
    events = spark.createDataFrame(
        [("A", "owner_or_admins", "u1", "own"), ("A", "admins", "u1", "adm"), ("B", "owner_or_admins", "u1", "other")],
        "tenant_id string, audience string, owner_subject string, event_type string",
    )
    people = spark.createDataFrame([("A", "u1", False), ("A", "u2", False), ("A", "boss", True), ("B", "u2", None)], "tenant_id string, subject string, is_tenant_admin boolean")
    assert sorted((r.subject, r.event_type) for r in access.event_audience(events, people).collect()) == [("boss", "adm"), ("boss", "own"), ("u1", "own")]
    assert access.in_tenant(events, None).count() == 0 and access.in_tenant(events, "A").count() == 2


def test_claims(spark):
    claims = ['{"sub":"a","tenant_id":"T","roles":" Admin ,x"}', '{"sub":"b","tenant_id":"T","roles":["Viewer"]}', '{"sub":"c","roles":"x"}', "nonsense", None]
    df = spark.createDataFrame([(c,) for c in claims], "claims string")
    got = {r.subject: (r.roles, r.is_tenant_admin) for r in access.principals_from_claims(df).collect()}
    assert got == {"a": (["admin", "x"], True), "b": (["viewer"], False)}
    assert [r.subject for r in access.principals_from_claims(df, allowed=("viewer",)).collect()] == ["b"]


def test_sources_are_created_once(spark):
    columns = "seq bigint, tenant_id string, name string, root_url string, allowed_hosts array<string>, allowed_path_prefixes array<string>, include_subdomains boolean, discovery_modes array<string>, obey_robots boolean, crawl_interval_seconds int, max_depth int, max_pages_per_run int"
    rest = (["example.com"], ["/"], False, ["manual"], True, 900, 3, 100)
    rows = [(1, "A", "x", "https://example.com", *rest), (2, "A", "y", "https://EXAMPLE.com/#a", *rest), (3, "A", "z", "https://10.0.0.1/", *rest), (4, "A", "", "https://example.com/q", *rest), (5, "B", "x", "https://example.com/", *rest)]
    stored = spark.createDataFrame([("B", "https://example.com/")], "tenant_id string, root_url string")
    got = {r.seq: (r.outcome, r.reason) for r in rules.create_sources(spark.createDataFrame(rows, columns), stored, F.lit(at(0))).collect()}
    assert got == {1: ("created", None), 2: ("conflict", None), 3: ("rejected", "ip_literal"), 4: ("rejected", "name"), 5: ("conflict", None)}


def test_provider_output(spark):
    inputs = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0), ("u", 0)], "set_id string, ordinal int")
    out = spark.createDataFrame(
        [("s", 0, "m", [1.0, 0.0]), ("t", 0, "other", [1.0, 0.0]), ("t", 1, "m", [0.0, 0.0]), ("u", 0, "m", [1.0, 0.0])],
        "set_id string, ordinal int, model string, embedding array<float>",
    )
    got = {r.set_id: r.errors for r in views.output_errors(inputs, out, 2, "m").collect()}
    assert got == {"s": ["missing"], "t": ["invalid_vector", "other_model", "unasked"]}


def test_page_views_of_markup(spark):
    html = "<html><head><title>A &amp; B</title><script>x='<h1>no</h1>'</script></head><body><h1>Head</h1><h2>Sub</h2><p>First one. Acme Labs grows!</p></body></html>"
    got = views.with_page_inputs(spark.range(1), "x", F.lit(html), F.lit("https://e.com/news/42/acme-labs")).select(F.inline("x")).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.kind, []).append(r.text)
    assert kinds["title"] == ["A & B"] and kinds["heading"] == ["Head", "Sub"] and kinds["summary"] == ["First one."]
    assert kinds["sentence"] == ["First one.", "Acme Labs grows!"] and kinds["url_signal"] == ["news", "acme", "labs"]
    bare = views.with_page_inputs(spark.range(1), "x", F.lit(""), F.lit("https://e.com/"), F.lit("  ")).first().x
    assert bare == []


def test_frontier_keeps_one_row_a_url(spark):
    cols = "tenant_id string, source_id string, canonical_url string, discovered_by string, depth int, status string, priority int, next_attempt_at timestamp, created_at timestamp"
    rows = [("A", "s", "u", "link", 3, "pending", 1, at(0), at(0)), ("A", "s", "u", "manual", 1, "failed", 1, at(0), at(1)), ("A", "s", "v", "link", 0, "fetched", 1, at(0), at(0)), ("A", "s", "w", "link", 0, "pending", 0, at(9), at(0))]
    one = frontier.merged(spark.createDataFrame(rows, cols))
    assert one.count() == 3
    source = spark.createDataFrame([("A", "s", True, 5, 2)], "tenant_id string, source_id string, enabled boolean, max_pages_per_run int, max_depth int")
    assert [r.canonical_url for r in frontier.due(one, source, F.lit(at(5))).collect()] == ["u"]


def test_cursor_walk_sees_every_hit_once(spark, sf):
    items, queries = alerting._items(spark, sf), alerting._queries(spark, sf).limit(2).cache()
    everything = {(r.query_id, r.embedding_id) for r in search.scored(items, queries).collect()}
    seen, asked = [], queries
    for _ in range(60):
        hits = search.search_many(items, asked, 20).cache()
        seen += [(r.query_id, r.embedding_id) for r in hits.collect()]
        if hits.where("has_more").count() == 0:
            break
        cursors = spark.createDataFrame(search.next_cursors(hits).collect(), "query_id string, cursor_distance double, cursor_id string")
        asked = queries.join(cursors, "query_id")
    assert len(seen) == len(set(seen)) and set(seen) == everything


def test_audits_find_planted_rows(spark):
    base = spark.createDataFrame([(f"id{i}", "A", "pending", i) for i in range(4)], "candidate_id string, tenant_id string, status string, similarity int")
    later = base.where("similarity <> 0").withColumn("status", F.lit("approved")).withColumn("similarity", F.when(F.col("similarity") == 2, 9).otherwise(F.col("similarity")))
    got = sorted((r.id, r.change, tuple(r.columns)) for r in audit.immutability(base, later, "match_candidates").collect())
    assert got == [("id0", "deleted", ()), ("id2", "mutated", ("similarity",))]
    assert uuid_of(1, F.lit(1)) is not None
