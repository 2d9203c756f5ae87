"""Registered queries of the engine over the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as V
from .operators import accounting, evidence, keyed, ledger_views, rates, tree
from .plans import report
from .sources import readers
from .sources.scratch import Scratch, shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None):
    """Registers a query under a name, with its SQL for comparison."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


MS = "CAST(epoch_us(ts) // 1000 AS BIGINT)"


def ms(column: str = "ts"):
    return F.unix_millis(F.col(column).cast("timestamp"))


def journal_of(t: Tables) -> DataFrame:
    """The journal of events: a key for each user, revisions in event order."""
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), F.col("event_id").alias("sequence"), F.col("event_type").alias("content"))


def results_of(t: Tables) -> DataFrame:
    """Orders as results: the customer is the subject, the order key the publication."""
    return t.orders.select(
        F.col("o_orderkey").alias("result_id"), F.col("o_orderpriority").alias("environment"), F.col("o_custkey").alias("subject"),
        F.col("o_orderkey").alias("publication"), F.col("o_totalprice").alias("payload"),
    )


def promotions_of(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("result_id")).distinct()


def members_of(t: Tables, least: int = 9) -> DataFrame:
    """Customers as members with gate and status: an order with a high total fails one, an open one leaves it pending."""
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = t.customer.join(n, "c_custkey", "left")
    status = F.when(~(F.col("n") >= least), "skipped").when(F.col("n").isNull(), "failed").otherwise("succeeded")
    return rows.select(F.col("c_custkey").alias("key"), "c_nationkey", "n", "total", status.alias("status"))


# -- keyed dataflow ---------------------------------------------------------------------------
FOLD_SQL = """
WITH n AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey)
SELECT c_nationkey, count(*) AS members, sum(n)::BIGINT AS orders, round(sum(total), 2) AS total, max(largest) AS largest
FROM customer JOIN n ON o_custkey = c_custkey WHERE n >= 5 GROUP BY c_nationkey"""


@query("fold_strict_nation", FOLD_SQL)
def fold_strict_nation(t: Tables) -> DataFrame:
    counted = report.with_counts(t.customer, t.orders)
    members = keyed.keyed(counted, F.col("c_custkey")).withColumn("_gate", keyed.gate_status(F.col("authored") >= report.LEAST_ORDERS))
    work = t.orders.select(F.col("o_custkey").cast("string").alias("key"), "o_totalprice")
    done = report.summarise(members.filter("_gate = 'required'").select("key", "c_nationkey"), work).withColumn("status", F.lit("succeeded"))
    state, out = keyed.strict_fold(done, report.per_nation)
    if out is None:
        raise RuntimeError(f"the fold is {state.state}")
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contribution report through the engine: retained, keyed, gated, folded."""
    from .plans.workspace import Workspace

    base = shared_dir(spark)
    fold = report.contribution(report.read(spark, sf_dir, "customer"), report.read(spark, sf_dir, "orders"))
    work = Workspace(spark, f"{base}/flagship-{sf_dir.strip('/').replace('/', '_')}", "contribution", fold)
    with work.run() as run:
        return run.resolve(fold).data


QUERIES["flagship_report"] = flagship
ORACLE_SQL["flagship_report"] = FOLD_SQL


@query("gate_status_members", """
SELECT c_custkey AS key, CASE WHEN g THEN 'required' WHEN NOT g THEN 'skipped' ELSE 'failed' END AS gate FROM (
  SELECT c_custkey, n >= 9 AS g FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)""")  # fmt: skip
def gate_status_members(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(n, "c_custkey", "left").select(F.col("c_custkey").alias("key"), keyed.gate_status(F.col("n") >= 9).alias("gate"))


MEMBERS_SQL = """
members AS (SELECT c_custkey AS key, c_nationkey, n, total, CASE WHEN NOT (n >= 9) THEN 'skipped' WHEN n IS NULL THEN 'failed' ELSE 'succeeded' END AS status
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query("outcome_fold_status", f"WITH {MEMBERS_SQL} SELECT status, count(*) AS n, round(coalesce(sum(CASE WHEN status = 'succeeded' THEN total END), 0), 2) AS total FROM members GROUP BY status")
def outcome_fold_status(t):
    body = lambda m: m.groupBy("status").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("total"))
    return keyed.outcome_fold(members_of(t), body)[1]


@query("status_lists", f"WITH {MEMBERS_SQL} SELECT status, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM members GROUP BY status")
def status_lists(t):
    return keyed.status_lists(members_of(t))


@query("keying_duplicates", "SELECT 'duplicate-key' AS reason, user_id::VARCHAR AS key, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def keying_duplicates(t):
    return keyed.key_failures(t.events, F.col("user_id"))


BAD_KEYS = "CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 50 = 1 THEN '' WHEN p_partkey % 50 = 2 THEN 'twice' ELSE p_partkey::VARCHAR END"


@query("keying_first_failure", f"""
WITH k AS (SELECT {BAD_KEYS} AS key FROM part), g AS (SELECT key, count(*) AS n FROM k GROUP BY key)
SELECT CASE WHEN key IS NULL THEN 'missing-key' WHEN key = '' THEN 'empty-key' ELSE 'duplicate-key' END AS reason, key, n
FROM g WHERE key IS NULL OR key = '' OR n > 1 ORDER BY CASE WHEN key IS NULL THEN 3 WHEN key = '' THEN 5 ELSE 6 END, key LIMIT 1""")  # fmt: skip
def keying_first_failure(t):
    k = F.col("p_partkey") % 50
    key = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").when(k == 2, "twice").otherwise(F.col("p_partkey").cast("string"))
    return keyed.first_failure(keyed.key_failures(t.part, key))


# -- ledger reads -----------------------------------------------------------------------------
@query("candidates_union", """
SELECT result_id, environment, subject, publication FROM (
  SELECT o_orderkey AS result_id, o_orderpriority AS environment, o_custkey AS subject, o_orderkey AS publication FROM orders)
WHERE environment = '1-URGENT' OR result_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")  # fmt: skip
def candidates_union(t):
    return ledger_views.candidates(ledger_views.envelope(results_of(t)), promotions_of(t), F.col("environment") == "1-URGENT", F.col("subject").isNotNull())


@query("current_pointer", "SELECT environment, subject, arg_max(result_id, publication) AS result_id, max(publication) AS publication FROM (SELECT o_orderkey AS result_id, o_orderpriority AS environment, o_custkey AS subject, o_orderkey AS publication FROM orders) GROUP BY 1, 2")
def current_pointer(t):
    return ledger_views.current(results_of(t), ["environment", "subject"])


@query("dependencies_dangling", """
SELECT l_orderkey AS attempt_id, l_linenumber AS position, l_partkey AS dependency_id, p_partkey IS NOT NULL AS present, (l_linenumber - 1 = row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) AS contiguous
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey WHERE l_returnflag = 'A'""")  # fmt: skip
def dependencies_dangling(t):
    deps = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("attempt_id"), (F.col("l_linenumber") - 1).alias("position"), F.col("l_partkey").alias("dependency_id"))
    out = ledger_views.dependencies(deps, t.part.filter("p_size > 10").select(F.col("p_partkey").alias("result_id")))
    return out.withColumn("position", F.col("position") + 1)


@query("promotion_visibility", "SELECT o_orderkey AS result_id, o_custkey AS subject FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def promotion_visibility(t):
    return ledger_views.promoted(results_of(t), promotions_of(t)).select("result_id", "subject")


@query("promotion_presence", "SELECT DISTINCT l_orderkey AS result_id, o_orderkey IS NOT NULL AS present FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def promotion_presence(t):
    return ledger_views.promotion_presence(promotions_of(t), t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("result_id")))


@query("journal_latest", "SELECT user_id AS key, max(event_id) AS revision, arg_max(event_type, event_id) AS content FROM events GROUP BY user_id")
def journal_latest(t):
    return ledger_views.journal_latest(journal_of(t)).select("key", "revision", "content")


@query("journal_first_order", """
SELECT j.user_id AS key, j.event_id AS revision, j.event_type AS content, f.first_sequence, row_number() OVER (ORDER BY f.first_sequence) AS place
FROM events j JOIN (SELECT user_id, min(event_id) AS first_sequence, max(event_id) AS last FROM events GROUP BY user_id) f ON f.user_id = j.user_id AND f.last = j.event_id""")  # fmt: skip
def journal_first_order(t):
    return keyed.places(ledger_views.journal_list(journal_of(t)).select("key", "revision", "content", "first_sequence"), F.col("first_sequence"))


TREE = """
SELECT r_regionkey::BIGINT + 1000000 AS child, 0::BIGINT AS parent, 'edge' AS kind, r_regionkey AS position FROM region
UNION ALL SELECT n_nationkey::BIGINT + 2000000, n_regionkey::BIGINT + 1000000, 'edge', n_nationkey FROM nation
UNION ALL SELECT c_custkey + 3000000, c_nationkey::BIGINT + 2000000, CASE WHEN c_custkey % 7 = 0 THEN 'prototype' ELSE 'edge' END, c_custkey FROM customer"""


def tree_of(t: Tables) -> DataFrame:
    a = t.region.select((F.col("r_regionkey").cast("long") + 1000000).alias("child"), F.lit(0).cast("long").alias("parent"), F.lit("edge").alias("kind"), F.col("r_regionkey").cast("long").alias("position"))
    b = t.nation.select((F.col("n_nationkey").cast("long") + 2000000).alias("child"), (F.col("n_regionkey").cast("long") + 1000000).alias("parent"), F.lit("edge").alias("kind"), F.col("n_nationkey").cast("long").alias("position"))
    kind = F.when(F.col("c_custkey") % 7 == 0, "prototype").otherwise("edge")
    c = t.customer.select((F.col("c_custkey") + 3000000).alias("child"), (F.col("c_nationkey").cast("long") + 2000000).alias("parent"), kind.alias("kind"), F.col("c_custkey").alias("position"))
    return a.union(b).union(c)


@query("subtree_recursive", f"WITH RECURSIVE edges AS ({TREE}), below(node, depth) AS (SELECT 1000001::BIGINT, 0 UNION ALL SELECT child, depth + 1 FROM below JOIN edges ON parent = node) SELECT node, depth FROM below")
def subtree_recursive(t):
    return ledger_views.subtree(tree_of(t), 1000001)


@query("subtree_edges_ordered", f"WITH edges AS ({TREE}) SELECT parent, string_agg(child::VARCHAR, ',' ORDER BY position, child) AS children FROM edges GROUP BY parent")
def subtree_edges_ordered(t):
    return ledger_views.ordered_children(tree_of(t))


@query("prefix_metadata", """
WITH asked AS (SELECT DISTINCT event_type || '/' || user_id AS a, event_type AS b FROM events), indexed AS (SELECT DISTINCT event_type AS address FROM events WHERE user_id % 2 = 0 UNION SELECT event_type || '/' || user_id FROM events WHERE user_id % 3 = 0)
SELECT a AS id, arg_max(address, length(address)) AS address FROM asked JOIN indexed ON address IN (a, b) GROUP BY a""")  # fmt: skip
def prefix_metadata(t):
    e = t.events.select("event_type", "user_id").distinct()
    full = F.concat_ws("/", "event_type", "user_id")
    index = e.filter("user_id % 2 = 0").select(F.col("event_type").alias("address")).union(e.filter("user_id % 3 = 0").select(full)).distinct()
    return ledger_views.longest_prefix(index, e.select(full.alias("id"), F.array("event_type", full).alias("prefixes")))


# -- values and evidence ----------------------------------------------------------------------
@query("fingerprint_documents", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def fingerprint_documents(t):
    return t.documents.select("doc_id", V.fingerprint(F.col("text")).alias("fingerprint"))


@query("projection_digest_conversations", "SELECT conv_id, sha256(string_agg(turn::VARCHAR || '=' || role, chr(10) ORDER BY turn, role)) AS digest FROM conversations GROUP BY conv_id")
def projection_digest_conversations(t):
    return evidence.projection_digest(t.conversations, ["conv_id"], F.col("turn"), F.col("role"))


@query("member_order_digest", "SELECT user_id, sha256(string_agg(event_type, chr(10) ORDER BY event_id)) AS order_digest FROM events GROUP BY user_id")
def member_order_digest(t):
    return keyed.member_order_digest(t.events, ["user_id"], "event_id", F.col("event_type"))


CHANGED = "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"


def changed_orders(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return t.orders.filter("o_orderkey % 101 <> 5").withColumn("o_totalprice", price)


@query("evidence_changed_rows", f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'unavailable' WHEN a.p = b.p THEN 'equal' ELSE 'changed' END AS state
FROM (SELECT o_orderkey, o_totalprice AS p FROM orders) a FULL JOIN (SELECT o_orderkey, {CHANGED} AS p FROM orders WHERE o_orderkey % 101 <> 5) b ON a.o_orderkey = b.o_orderkey""")  # fmt: skip
def evidence_changed_rows(t):
    return evidence.compare_facts(t.orders, changed_orders(t), ["o_orderkey"], "o_totalprice")


@query("early_cutoff_parents", f"""
WITH was AS (SELECT o_custkey, count(*) AS n, sum(floor(o_totalprice / 1000)::BIGINT) AS v FROM orders GROUP BY 1),
now AS (SELECT o_custkey, count(*) AS n, sum(floor(({CHANGED}) / 1000)::BIGINT) AS v FROM orders WHERE o_orderkey % 101 <> 5 GROUP BY 1)
SELECT w.o_custkey AS key FROM was w LEFT JOIN now x USING (o_custkey) WHERE x.n IS DISTINCT FROM w.n OR x.v IS DISTINCT FROM w.v""")  # fmt: skip
def early_cutoff_parents(t):
    """Parents whose children's consumed output, thousands of the price, really changed."""
    cut = lambda df: df.select("o_custkey", F.floor(F.col("o_totalprice") / 1000).alias("k"))
    child = lambda df: cut(df).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("k").alias("v"))
    facts = lambda df: evidence.key_evidence(child(df), "o_custkey", ["n", "v"])
    return evidence.compare_facts(facts(t.orders), facts(changed_orders(t)), ["key"], "evidence").filter("state <> 'equal'").select(F.col("key").cast("long").alias("key"))


@query("membership_change", "SELECT 'removed' AS change, c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 <> 0 UNION ALL SELECT 'added', c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0")
def membership_change(t):
    return evidence.membership_change(t.customer.filter("c_custkey % 5 = 0"), t.customer.filter("c_custkey % 3 = 0"), "c_custkey")


@query("page_merge_conflicts", """
WITH p AS (SELECT page_id % 40 AS id, url FROM pages) SELECT id, count(*) AS copies, count(DISTINCT url) > 1 AS conflict FROM p GROUP BY id""")  # fmt: skip
def page_merge_conflicts(t):
    return evidence.merge_pages(t.pages.select((F.col("page_id") % 40).alias("id"), "url"), "id", ["url"])


@query("index_verified", "SELECT true AS whole, false AS cut")
def index_verified(t):
    df = payloads(t)
    index = tree.shred(df, "o_orderkey")
    return t.spark.createDataFrame([(tree.verified(df, "o_orderkey", index), tree.verified(df, "o_orderkey", index.filter("kind <> 'array'")))], "whole boolean, cut boolean")


@query("selected_fact", "SELECT o_orderkey AS key, o_custkey::VARCHAR AS value FROM orders WHERE o_orderstatus = 'F'")
def selected_fact(t):
    asked = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return tree.selection(tree.shred(payloads(t), "o_orderkey"), asked, '["head","o_custkey"]')


@query("json_own_keys", "SELECT event_id, list_contains(json_keys(props), 'k') AS own, len(json_keys(props))::INTEGER AS n FROM events")
def json_own_keys(t):
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.array_contains(keys, "k").alias("own"), F.size(keys).alias("n"))


# -- usage ------------------------------------------------------------------------------------
def usage_of(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    attempts = t.orders.select(F.col("o_orderkey").alias("attempt"), F.col("o_orderpriority").alias("environment"))
    reports = t.lineitem.select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("report"))
    units = F.explode(F.array(F.struct(F.lit("quantity").alias("unit"), F.col("l_quantity").cast("long").alias("amount")), F.struct(F.lit("cents").alias("unit"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"))))
    quantities = t.lineitem.select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("report"), units.alias("u")).select("attempt", "report", "u.*")
    return attempts, reports, quantities


@query("usage_summary_units", "SELECT 'quantity' AS unit, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem UNION ALL SELECT 'cents', sum(round(l_extendedprice * 100)::BIGINT)::BIGINT FROM lineitem")
def usage_summary_units(t):
    return accounting.usage_by_unit(usage_of(t)[2])


@query("usage_summary_counts", """
SELECT count(*) AS attempts, sum(n)::BIGINT AS reports, count(*) FILTER (n IS NULL) AS unknown, CASE WHEN count(*) FILTER (n IS NULL) = 0 THEN 'complete' ELSE 'incomplete' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")  # fmt: skip
def usage_summary_counts(t):
    return accounting.usage_summary(*usage_of(t), "attempt")


@query("usage_unknown_attempts", "SELECT o_orderkey AS attempt FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def usage_unknown_attempts(t):
    a, r, _ = usage_of(t)
    return accounting.unknown_attempts(a, r, "attempt").select("attempt")


@query("usage_scoped_rows", """
SELECT o_orderkey AS attempt, l_linenumber AS report, unit, amount FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS l, 'quantity' AS unit, l_quantity::BIGINT AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'cents', round(l_extendedprice * 100)::BIGINT FROM lineitem) ON k = o_orderkey AND l = l_linenumber
WHERE o_orderpriority = '2-HIGH'""")  # fmt: skip
def usage_scoped_rows(t):
    a, r, q = usage_of(t)
    return accounting.scoped_usage(ledger_views.scoped(a, environment="2-HIGH", attempt=None), r, q, "attempt").select("attempt", "report", "unit", "amount")


@query("usage_estimates", "SELECT o_orderkey AS attempt, q.quantities FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_quantity::BIGINT, ',' ORDER BY l_linenumber, l_quantity) AS quantities FROM lineitem GROUP BY 1) q ON l_orderkey = o_orderkey")
def usage_estimates(t):
    q = t.lineitem.select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("unit"), F.col("l_quantity").cast("long").alias("amount"))
    out = accounting.estimates(t.orders.select(F.col("o_orderkey").alias("attempt")), q, "attempt")
    return out.select("attempt", F.array_join(F.transform("quantities", lambda x: F.concat_ws(":", x["unit"], x["amount"])), ",").alias("quantities"))


@query("usage_acknowledged", """
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'unattributable' WHEN l_linenumber > 2 THEN 'acknowledged' WHEN l_quantity > 10 THEN 'conflict' ELSE 'duplicate' END AS outcome
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0) ON o_orderkey = l_orderkey) GROUP BY outcome""")  # fmt: skip
def usage_acknowledged(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("report"), F.col("l_quantity").alias("content"))
    rows = rows.groupBy("attempt", "report").agg(F.max("content").alias("content"))
    had = rows.filter("report <= 2").withColumn("content", F.least("content", F.lit(10.0)))
    intents = t.orders.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("attempt"))
    return accounting.acknowledge(had, rows, intents, ["attempt", "report"], "attempt", "content").groupBy("outcome").agg(F.count("*").alias("n"))


NOW = 1_705_276_800_000
EXPIRES = f"CASE WHEN event_id % 4 = 0 THEN {MS} + 86400000 ELSE {MS} + 3600000 END"


def resource_reports(t: Tables) -> DataFrame:
    at = ms()
    until = F.when(F.col("event_id") % 4 == 0, at + 86400000)
    return t.events.select(F.col("event_id").alias("report"), at.alias("observed_at"), accounting.expires_at(at, until).alias("expires_at"))


@query("resource_reports_live", f"SELECT event_id AS report, {MS} AS observed_at, {EXPIRES} AS expires_at FROM events WHERE {EXPIRES} > {NOW}")
def resource_reports_live(t):
    return accounting.live_reports(resource_reports(t), NOW)


@query("resource_next_expiry", f"SELECT min({EXPIRES}) AS next_expiry FROM events WHERE {EXPIRES} > {NOW}")
def resource_next_expiry(t):
    return accounting.next_expiry(resource_reports(t), NOW)


# -- rates and retries ------------------------------------------------------------------------
@query("rate_rolling_window", f"SELECT event_id, sum(1) OVER (PARTITION BY user_id ORDER BY {MS} RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW)::BIGINT AS spent FROM events")
def rate_rolling_window(t):
    debits = t.events.select("event_id", "user_id", ms().alias("at"), F.lit(1).alias("cost"))
    return rates.rolling_spent(debits, "user_id", "at", "cost", 3_600_000).select("event_id", "spent")


@query("rate_next_admission", f"""
WITH d AS (SELECT user_id, {MS} AS t, count(*) AS cost FROM events WHERE {MS} > {NOW} - 864000000 AND {MS} <= {NOW} GROUP BY 1, 2),
s AS (SELECT user_id, t, sum(cost) OVER (PARTITION BY user_id) AS total, sum(cost) OVER (PARTITION BY user_id) - sum(cost) OVER (PARTITION BY user_id ORDER BY t) AS rest FROM d)
SELECT user_id, CASE WHEN max(total) + 2 <= 12 THEN {NOW} ELSE min(CASE WHEN rest + 2 <= 12 THEN t + 864000000 END) END::BIGINT AS admit_at FROM s GROUP BY user_id""")  # fmt: skip
def rate_next_admission(t):
    debits = t.events.select("user_id", ms().alias("at"), F.lit(1).alias("cost"))
    return rates.next_admission(debits, "user_id", "at", "cost", 864_000_000, 12, 2, NOW)


@query("retry_history_last8", """
SELECT user_id, event_id, omitted FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, greatest(0, count(*) OVER (PARTITION BY user_id) - 8) AS omitted FROM events WHERE event_type = 'error') WHERE r <= 8""")  # fmt: skip
def retry_history_last8(t):
    return rates.recent_history(t.events.filter("event_type = 'error'").select("user_id", "event_id"), "user_id", "event_id")


@query("attempts_spent", "SELECT user_id, event_type, count(*) AS spent, count(*) FILTER (value > 50) AS rate_limited FROM events GROUP BY 1, 2")
def attempts_spent(t):
    return rates.spent_attempts(t.events, ["user_id", "event_type"], F.col("value") > 50)


@query("event_counts_saturating", "SELECT event_type, least(300, count(*)) AS n FROM events GROUP BY event_type")
def event_counts_saturating(t):
    return rates.saturating_counts(t.events, "event_type", 300)


# -- predicates, orders, scalars --------------------------------------------------------------
@query("window_attribution", "SELECT c_nationkey, count(o_orderkey) AS authored, count(*) FILTER (o_orderstatus = 'F') AS merged FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01' GROUP BY c_nationkey")
def window_attribution(t):
    quarter = t.orders.filter(V.in_window(F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp"), F.lit("1995-04-01").cast("timestamp")))
    return t.customer.join(quarter, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.count("o_orderkey").alias("authored"), F.count_if(F.col("o_orderstatus") == "F").alias("merged"))


@query("canonical_key_order", "SELECT p_name AS key, row_number() OVER (ORDER BY p_name) AS place FROM (SELECT DISTINCT p_name FROM part)")
def canonical_key_order(t):
    return keyed.places(t.part.select(F.col("p_name").alias("key")).distinct(), V.canonical_order(F.col("key")))


@query("expired_claims_topn", "SELECT c_custkey AS subject, c_acctbal AS lease FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 20")
def expired_claims_topn(t):
    return readers.expired_claims(t.customer, "c_custkey", "c_acctbal", 0, 20)


@query("retry_delays", "SELECT l_orderkey, l_linenumber, least(60000, 2000 * pow(2, l_linenumber - 1))::BIGINT AS delay FROM lineitem")
def retry_delays(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", V.retry_delay(F.col("l_linenumber")).alias("delay"))


@query("count_sentences", "SELECT c_custkey, n || ' pull request' || CASE WHEN n = 1 THEN '' ELSE 's' END AS sentence FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def count_sentences(t):
    n = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", V.count_noun(F.col("n"), "pull request").alias("sentence"))


@query("reference_round_trip", "SELECT o_orderkey, json_array('store', 'contribution', o_orderpriority, o_orderkey::VARCHAR)::VARCHAR AS reference, o_orderkey::VARCHAR AS result_id FROM orders")
def reference_round_trip(t):
    ref = V.reference_for(F.lit("store"), F.lit("contribution"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", ref.alias("reference")).withColumn("result_id", V.parse_reference(F.col("reference"))["result_id"])


@query("encoded_addresses", "SELECT event_id, '[\"' || event_type || '\",' || user_id || ',\"0\"]' AS address FROM events")
def encoded_addresses(t):
    return t.events.select("event_id", V.encode_address(V.property_segment(F.col("event_type")), V.index_segment(F.col("user_id")), V.property_segment(F.lit("0"))).alias("address"))


@query("json_each_elements", "SELECT event_id, unnest([event_type, user_id::VARCHAR]) AS element FROM events")
def json_each_elements(t):
    text = F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    return t.events.select("event_id", V.json_each(text).alias("element"))


@query("normalised_spaces", "SELECT page_id, trim(regexp_replace(url, '[/.:]+', ' ', 'g')) AS words FROM pages")
def normalised_spaces(t):
    return t.pages.select("page_id", V.one_space(F.regexp_replace("url", r"[/.:]+", "  ")).alias("words"))


@query("identifier_predicate", "SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z][A-Za-z0-9._-]{0,127}') AS brand_fits, regexp_full_match(p_name, '[A-Za-z][A-Za-z0-9._-]{0,127}') AS name_fits FROM part")
def identifier_predicate(t):
    return t.part.select("p_partkey", V.is_identifier(F.col("p_brand")).alias("brand_fits"), V.is_identifier(F.col("p_name")).alias("name_fits"))


@query("safe_integer_sums", "SELECT l_returnflag, sum(l_orderkey + l_partkey)::BIGINT AS total FROM lineitem GROUP BY 1")
def safe_integer_sums(t):
    return t.lineitem.groupBy("l_returnflag").agg(V.safe_sum(F.sum(V.safe_add(F.col("l_orderkey"), F.col("l_partkey")))).alias("total"))


@query("quiet_final", f"SELECT event_id, coalesce(event_type <> 'error' AND {MS} + 86400000 <= {NOW}, false) AS final FROM events")
def quiet_final(t):
    return t.events.select("event_id", V.quiet_final(ms(), ms(), F.col("event_type") != "error", NOW, 86400).alias("final"))


# -- payload trees and point reads ------------------------------------------------------------
def payloads(t: Tables) -> DataFrame:
    """Orders as payloads of a record with a nested record and an array."""
    return t.orders.select("o_orderkey", F.struct("o_custkey", "o_orderstatus").alias("head"), F.array("o_orderpriority", "o_orderstatus").alias("tags"))


TREE_ROWS = """
SELECT o_orderkey AS key, '[]' AS address, 'record' AS kind, NULL AS scalar, 2 AS size FROM orders
UNION ALL SELECT o_orderkey, '["head"]', 'record', NULL, 2 FROM orders
UNION ALL SELECT o_orderkey, '["head","o_custkey"]', 'scalar', o_custkey::VARCHAR, NULL FROM orders
UNION ALL SELECT o_orderkey, '["head","o_orderstatus"]', 'scalar', o_orderstatus, NULL FROM orders
UNION ALL SELECT o_orderkey, '["tags"]', 'array', NULL, 2 FROM orders
UNION ALL SELECT o_orderkey, '["tags",0]', 'scalar', o_orderpriority, NULL FROM orders
UNION ALL SELECT o_orderkey, '["tags",1]', 'scalar', o_orderstatus, NULL FROM orders"""


@query("payload_index", TREE_ROWS)
def payload_index(t):
    return tree.shred(payloads(t), "o_orderkey").drop("fingerprint")


@query("payload_selected", f"SELECT address, scalar FROM ({TREE_ROWS}) WHERE key = 5 AND address IN ('[\"head\",\"o_custkey\"]', '[\"tags\",1]', '[\"gone\"]')")
def payload_selected(t):
    return tree.read_selected(tree.shred(payloads(t), "o_orderkey"), 5, ['["head","o_custkey"]', '["tags",1]', '["gone"]']).select("address", "scalar")


@query("payload_own_property", "SELECT o_orderkey AS key, true AS own FROM orders")
def payload_own_property(t):
    return tree.has_own(tree.shred(payloads(t), "o_orderkey"), '["head"]', "o_custkey")


@query("payload_child_keys", "SELECT o_orderkey AS key, '\"o_custkey\"|\"o_orderstatus\"' AS names FROM orders")
def payload_child_keys(t):
    return tree.keys_below(tree.shred(payloads(t), "o_orderkey"), '["head"]').select("key", F.array_join("names", "|").alias("names"))


@query("attempt_by_key", "SELECT o_orderkey AS attempt_id, o_orderstatus AS state FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey = 7")
def attempt_by_key(t):
    return ledger_views.scoped(t.orders, o_orderpriority="1-URGENT", o_custkey=7).select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderstatus").alias("state"))


@query("acceptances_in_order", "SELECT l_orderkey AS result_id, l_linenumber AS acceptance, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS place FROM lineitem")
def acceptances_in_order(t):
    return ledger_views.acceptances_of(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]).select(F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").alias("acceptance"), "place")


@query("usage_estimates_by_scope", "SELECT o_orderpriority AS scope, o_orderstatus AS basis, count(*) AS n, sum(floor(o_totalprice)::BIGINT)::BIGINT AS amount FROM orders GROUP BY 1, 2")
def usage_estimates_by_scope(t):
    return accounting.estimates_by_scope(t.orders.withColumn("amount", F.floor("o_totalprice")), "o_orderpriority", "o_orderstatus", "amount")


@query("resource_reports_kept", f"SELECT event_id AS report, {EXPIRES} AS expires_at FROM events WHERE NOT ({EXPIRES} <= {NOW})")
def resource_reports_kept(t):
    return accounting.evicted(resource_reports(t), NOW).select("report", "expires_at")


@query("unique_references", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS place, event_type FROM events GROUP BY user_id, event_type")
def unique_references(t):
    return ledger_views.unique_references(t.events, "user_id", "event_id", "event_type")


@query("daily_coverage", "SELECT CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def daily_coverage(t):
    return t.orders.groupBy(V.day_of(ms("o_orderdate")).alias("day")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("closed_days", f"""
SELECT event_id, CAST(ceil({MS} / 86400000.0) AS BIGINT) AS first, greatest(CAST(floor(least({MS} + 259200000, {NOW}) / 86400000.0) AS BIGINT) - CAST(ceil({MS} / 86400000.0) AS BIGINT), 0) AS n FROM events""")  # fmt: skip
def closed_days(t):
    return t.events.select("event_id", V.closed_days(ms(), ms() + 259_200_000, NOW).alias("d")).select("event_id", "d.*")


@query("people_selected", "SELECT c_custkey::VARCHAR AS employee_id, c_name AS name FROM customer WHERE c_custkey IN (3, 5, 8)")
def people_selected(t):
    roster = t.customer.select(F.col("c_custkey").cast("string").alias("employee_id"), F.col("c_name").alias("name"), F.lit(True).alias("active"))
    return readers.select_people(roster, ["3", "5", "8"]).select("employee_id", "name")


@query("status_keys", f"WITH {MEMBERS_SQL} SELECT status, row_number() OVER (PARTITION BY status ORDER BY key::VARCHAR) AS place, key FROM members")
def status_keys(t):
    return keyed.status_keys(members_of(t))


@query("entry_data", f"WITH {MEMBERS_SQL} SELECT key::VARCHAR AS key, status, CASE WHEN status = 'succeeded' THEN total END AS total FROM members")
def entry_data(t):
    rows = keyed.entries(members_of(t).withColumn("key", F.col("key").cast("string")), ["total"])
    good = rows.filter("status = 'succeeded'")
    read = good.select("key", "status", keyed.entry_data(good, "total").alias("total"))
    return read.unionByName(rows.filter("status <> 'succeeded'").select("key", "status", F.col("data.total").alias("total")))


def _largest(key, rows):
    if key.endswith("7"):
        raise ValueError("seven")
    return {"largest": float(rows.o_totalprice.max())}


@query("member_failures", "SELECT o_custkey::VARCHAR AS key, CASE WHEN o_custkey % 10 <> 7 THEN max(o_totalprice) END AS largest, CASE WHEN o_custkey % 10 = 7 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN o_custkey % 10 = 7 THEN 'ValueError: seven' END AS error FROM orders GROUP BY o_custkey")
def member_failures(t):
    return keyed.per_member(t.orders.select(F.col("o_custkey").cast("string").alias("key"), "o_totalprice"), _largest, "largest double")


def promotions_table(t: Tables) -> DataFrame:
    """Line items as promotions: the order is the result, the line the position, the return flag the target."""
    return t.lineitem.select(F.col("l_partkey").alias("promotion_id"), F.col("l_returnflag").alias("environment"), F.col("l_linenumber").alias("position"), F.col("l_orderkey").alias("result_id"))


@query("promotions_of_target", "SELECT l_partkey AS promotion_id, l_linenumber AS position, l_orderkey AS result_id FROM lineitem WHERE l_returnflag = 'R'")
def promotions_of_target(t):
    return ledger_views.promotions_of_target(promotions_table(t), "R")


@query("promotions_naming", "SELECT l_partkey AS promotion_id, l_returnflag AS environment, l_linenumber AS position, l_orderkey AS result_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def promotions_naming(t):
    return ledger_views.promotions_naming(promotions_table(t), t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("result_id")))


@query("attempt_envelope", "SELECT 7 AS attempt_id, o_orderstatus AS state, l_linenumber AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7")
def attempt_envelope(t):
    attempts = t.orders.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderstatus").alias("state"))
    return ledger_views.envelope_of(attempts, t.lineitem.select(F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").alias("line")), 7).select(F.col("attempt_id").cast("int").alias("attempt_id"), "state", "line")


@query("prototype_keys", """
WITH RECURSIVE above(node, depth) AS (SELECT 57::BIGINT, 0 UNION ALL SELECT node // 2, depth + 1 FROM above WHERE node > 1)
SELECT depth, o_orderkey AS key FROM above JOIN orders ON o_custkey = node""")  # fmt: skip
def prototype_keys(t):
    up = t.customer.filter("c_custkey > 1").select(F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") / 2).alias("prototype"))
    return ledger_views.prototype_chain(up, t.orders.select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("key")), 57)


@query("payload_membership", "SELECT o_orderkey AS key, true AS member FROM orders")
def payload_membership(t):
    return tree.membership(tree.shred(payloads(t), "o_orderkey"), '["head"]', "toString", {"toString"})


@query("payload_nodes", "SELECT o_orderkey AS key, 'array' AS kind, NULL::VARCHAR AS scalar, 2 AS size FROM orders")
def payload_nodes(t):
    return tree.node_at(tree.shred(payloads(t), "o_orderkey"), '["tags"]')


@query("observed_facts", """
SELECT 'value' AS operation, o_orderkey AS key, o_custkey::VARCHAR AS fact FROM orders UNION ALL SELECT 'length', o_orderkey, '2' FROM orders
UNION ALL SELECT 'container-kind', o_orderkey, 'record' FROM orders UNION ALL SELECT 'keys', o_orderkey, '"o_custkey","o_orderstatus"' FROM orders UNION ALL SELECT 'own', o_orderkey, 'false' FROM orders""")  # fmt: skip
def observed_facts(t):
    index = tree.shred(payloads(t), "o_orderkey").withColumn("fingerprint", F.when(F.col("kind") != "scalar", F.col("fingerprint")))
    seen = {"value": ('["head","o_custkey"]', None), "length": ('["tags"]', None), "container-kind": ('["head"]', None), "keys": ('["head"]', None), "own": ('["head"]', "gone")}
    parts = [evidence.observe(index, a, op, name).select(F.lit(op).alias("operation"), "key", "fact") for op, (a, name) in seen.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("first_difference", f"SELECT o_orderkey, 'changed' AS state FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 101 <> 5 OR o_orderkey % 101 = 5 ORDER BY o_orderkey LIMIT 1".replace("'changed'", "CASE WHEN o_orderkey % 101 = 5 THEN 'unavailable' ELSE 'changed' END"))
def first_difference(t):
    return evidence.first_difference(t.orders.withColumn("place", F.col("o_orderkey")), changed_orders(t), ["o_orderkey"], "place", "o_totalprice").select("o_orderkey", "state")


@query("canonical_values", "SELECT event_id, json(props)::VARCHAR AS value, true AS fits FROM events")
def canonical_values(t):
    value = V.encode_value(F.col("props"))
    return t.events.select("event_id", value.alias("value"), V.decode_value(value).isNotNull().alias("fits"))


@query("records_from_entries", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def records_from_entries(t):
    entries = F.array(F.struct(F.lit("status").alias("key"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("key"), F.col("o_orderpriority").alias("value")))
    return t.orders.select("o_orderkey", V.record_from_entries(entries).alias("r")).select("o_orderkey", F.col("r.status").alias("status"), F.col("r.priority").alias("priority"))


# -- the engine's own tables ------------------------------------------------------------------
def two_runs(t: Tables):
    """A ledger after a cold run of the contribution report and one over changed orders."""
    from .plans.workspace import Workspace

    now = {"orders": t.orders}
    fold = report.contribution(lambda previous: t.customer, lambda previous: now["orders"])
    work = Workspace(t.spark, Scratch(t.spark, "ledger").root, "contribution", fold)
    outcomes = []
    for orders in (t.orders, changed_orders(t)):
        now["orders"] = orders
        with work.run(wait=60_000) as run:
            outcomes.append((run.resolve(fold), dict(run.bodies)))
    return work, fold, outcomes


COUNTED = f"""
was AS (SELECT o_custkey AS k, count(*) AS n, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1 HAVING count(*) >= 5),
now AS (SELECT o_custkey AS k, count(*) AS n, list_sort(list({CHANGED})) AS v FROM orders WHERE o_orderkey % 101 <> 5 GROUP BY 1 HAVING count(*) >= 5),
stale AS (SELECT count(*) AS n FROM now LEFT JOIN was USING (k) WHERE was.v IS NULL OR was.v <> now.v)"""


@query("miss_taxonomy", f"""
WITH {COUNTED}
SELECT 'contributors' AS subject, 'cold' AS reason, 1::BIGINT AS n UNION ALL SELECT 'summary', 'cold', count(*) FROM was UNION ALL SELECT 'report', 'cold', 1
UNION ALL SELECT 'contributors', 'changed', 1 UNION ALL SELECT 'summary', 'changed', n FROM stale 
UNION ALL SELECT 'report', CASE WHEN EXISTS (SELECT 1 FROM was FULL JOIN now USING (k) WHERE was.n IS NULL OR now.n IS NULL) THEN 'changed-membership' ELSE 'changed-member-output' END, 1""")  # fmt: skip
def miss_taxonomy(t):
    """Why steps ran, from the ledger: the order's owner is consumed by the memo, its price by the members alone."""
    work, _, _ = two_runs(t)
    return work.ledger.table("misses").select("subject", "reason", "n")


@query("reuse_bodies", f"WITH {COUNTED} SELECT 'cold' AS run, count(*) AS members, 1::BIGINT AS folds FROM was UNION ALL SELECT 'changed', n, 1 FROM stale")
def reuse_bodies(t):
    _, _, outcomes = two_runs(t)
    return t.spark.createDataFrame([(name, o[1].get("summary", 0), o[1].get("report", 0)) for name, o in zip(("cold", "changed"), outcomes, strict=True)], "run string, members long, folds long")


@query("report_after_change", FOLD_SQL.replace("FROM orders GROUP BY", f"FROM (SELECT o_custkey, {CHANGED} AS o_totalprice FROM orders WHERE o_orderkey % 101 <> 5) GROUP BY"))
def report_after_change(t):
    return two_runs(t)[2][1][0].data


@query("attempt_states", "SELECT subject, state, count(*) AS n FROM (VALUES ('customers', 'claimed'), ('customers', 'completed'), ('orders', 'claimed'), ('orders', 'completed'), ('orders', 'claimed'), ('orders', 'completed'), ('contributors', 'claimed'), ('contributors', 'completed'), ('contributors', 'claimed'), ('contributors', 'completed'), ('summary', 'claimed'), ('summary', 'completed'), ('summary', 'claimed'), ('summary', 'completed'), ('report', 'claimed'), ('report', 'completed'), ('report', 'claimed'), ('report', 'completed')) AS a(subject, state) GROUP BY ALL")
def attempt_states(t):
    return two_runs(t)[0].ledger.table("attempts").groupBy("subject", "state").agg(F.count("*").alias("n"))


@query("engine_dependencies", "SELECT * FROM (VALUES ('contributors', 'customers'), ('contributors', 'orders'), ('report', 'summary'), ('summary', 'contributors'), ('summary', 'orders')) AS d(subject, used)")
def engine_dependencies(t):
    """Which step's results each step used, over the ledger's dependency rows: views of a population count as their template's."""
    ledger = two_runs(t)[0].ledger
    names = ledger.table("results").select(F.col("result_id").alias("dependency_id"), F.col("subject").alias("used")).union(ledger.table("views").select("view_id", "subject"))
    own = ledger.table("results").select(F.col("result_id").alias("attempt_id"), "subject")
    return ledger.table("dependencies").join(own, "attempt_id").join(names, "dependency_id").select("subject", "used").distinct()


@query("engine_usage", "SELECT 4::BIGINT AS attempts, 3::BIGINT AS reports, 1::BIGINT AS unknown, 'incomplete' AS status, 'recorded,duplicate,conflict' AS intents, 'acknowledged,duplicate,conflict,unattributable' AS reported, 60::BIGINT AS tokens")
def engine_usage(t):
    """Usage that a run records: four intents, three reports, one attempt unknown."""
    from .plans.workspace import Workspace

    work = Workspace(t.spark, Scratch(t.spark, "ledger").root, "usage", report.Source("none", lambda previous: None))
    with work.run() as run:
        u = run.usage()
        intents = [u.record_intent("a", "1"), u.record_intent("a", "1"), u.record_intent("a", "2")]
        for op in "bcd":
            u.record_intent(op, "1")
        reported = [u.acknowledge("a", "r", {"tokens": 10}), u.acknowledge("a", "r", {"tokens": 10}), u.acknowledge("a", "r", {"tokens": 11}), u.acknowledge("z", "r", {"tokens": 1})]
        u.acknowledge("b", "r", {"tokens": 50})
        u.acknowledge("c", "r", {})
        total = u.by_unit().filter("unit = 'tokens'").first()["total"]
        return u.summary().select("*", F.lit(",".join(intents)).alias("intents"), F.lit(",".join(reported)).alias("reported"), F.lit(total).cast("long").alias("tokens"))


@query("child_calls", "SELECT o_orderkey, o_orderstatus || '/' || (o_custkey % 7) AS said, 'succeeded' AS status FROM orders")
def child_calls(t):
    """One body for each distinct pair of arguments, joined back to every order that calls with it."""
    from .plans.calls import Derived, Forwarded, call
    from .plans.workspace import Workspace

    orders = report.Source("orders", lambda previous: t.orders)
    step = call("say", orders, ["o_orderkey"], {"state": Forwarded("o_orderstatus"), "rest": Derived("o_custkey % 7", ("o_custkey",))}, say, ["said"])
    work = Workspace(t.spark, Scratch(t.spark, "ledger").root, "calls", step)
    with work.run() as run:
        return run.resolve(step).data


def say(_members: DataFrame) -> DataFrame:
    return _members.select("key", F.concat_ws("/", "state", F.col("rest").cast("string")).alias("said"))


@query("frontier_members", "SELECT page_id, url FROM pages")
def frontier_members(t):
    """Pages loaded ten portions at a time by a traversal that is cut off once and goes on."""
    from .streaming.traversal import Traversal

    folder = Scratch(t.spark, "frontier").root
    parts = 4
    load = lambda cursor: (t.pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(parts)) == int(cursor or 0)).select("page_id", "url"), str(int(cursor or 0) + 1) if int(cursor or 0) + 1 < parts else None)
    Traversal(t.spark, folder, "page_id", ["url"]).walk(load, most=2)
    again = Traversal(t.spark, folder, "page_id", ["url"])
    again.walk(load)
    return again.members()[1]


@query("request_recovery", "SELECT * FROM (VALUES ('absent', 'absent'), ('done', 'recovered'), ('broken', 'unsuccessful'), ('open', 'incomplete'), ('other intent', 'refused')) AS r(request, state)")
def request_recovery(t):
    from .plans.workspace import Workspace, WrongIntent

    bad = report.Memo("broken", {"x": (x := report.Source("x", lambda previous: t.nation))}, {"x": ["n_name"]}, lambda x: x.select("gone"))
    good = report.Memo("good", {"x": x}, {"x": ["n_name"]}, lambda x: x.select("n_name"))
    work = Workspace(t.spark, Scratch(t.spark, "ledger").root, "requests", bad, good)
    with work.run() as run:
        run.resolve(good, "k")
        run.resolve(bad, "k")
        run._claim(good, "left open", "o")
        states = [("absent", run.recover(good, "none")), ("done", run.recover(good, "k")), ("broken", run.recover(bad, "k")), ("open", run.recover(good, "o"))]
        try:
            run._claim(good, "another", "k")
        except WrongIntent:
            states.append(("other intent", "refused"))
    return t.spark.createDataFrame(states, "request string, state string")
