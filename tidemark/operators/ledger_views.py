"""The ledger's read statements as DataFrame functions over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import latest


def candidates(results: DataFrame, promotions: DataFrame, scope: Column, subject: Column) -> DataFrame:
    """Results published in the scope or promoted into it, distinct, newest publication first."""
    own = results.filter(scope & subject)
    shared = results.filter(subject).join(promotions.select("result_id"), "result_id", "left_semi")
    return own.unionByName(shared).distinct().orderBy(F.desc("publication"))


def envelope(results: DataFrame) -> DataFrame:
    """Without the payload: the scan never reads it."""
    return results.drop("payload")


def dependencies(deps: DataFrame, results: DataFrame) -> DataFrame:
    """Dependencies in order with whether the result exists and whether positions are contiguous."""
    have = results.select(F.col("result_id").alias("dependency_id"), F.lit(True).alias("present"))
    place = F.row_number().over(Window.partitionBy("attempt_id").orderBy("position", "dependency_id"))
    return deps.join(have, "dependency_id", "left").select("attempt_id", "position", "dependency_id", F.coalesce("present", F.lit(False)).alias("present"), (F.col("position") == place - 1).alias("contiguous"))


def current(results: DataFrame, by: list[str]) -> DataFrame:
    """The newest publication of each subject in its own environment; reuse never moves it."""
    return results.groupBy(*by).agg(F.max_by("result_id", "publication").alias("result_id"), F.max("publication").alias("publication"))


def promoted(results: DataFrame, promotions: DataFrame) -> DataFrame:
    """Results that some promotion names."""
    return results.join(promotions, "result_id", "left_semi")


def promotion_presence(promoted_ids: DataFrame, results: DataFrame) -> DataFrame:
    have = results.select("result_id", F.lit(True).alias("present"))
    return promoted_ids.join(have, "result_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def journal_latest(journal: DataFrame, key: str = "key", revision: str = "revision") -> DataFrame:
    return latest(journal, [key], [F.desc(revision)])


def journal_list(journal: DataFrame, key: str = "key", revision: str = "revision", sequence: str = "sequence") -> DataFrame:
    """Latest revision of each key, ranked by the key's first sequence; one shuffle."""
    by = Window.partitionBy(key)
    rows = journal.withColumn("first_sequence", F.min(sequence).over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc(revision))))
    return rows.filter("_r = 1").drop("_r")


def longest_prefix(addresses: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked address (id, prefixes array) the longest indexed prefix."""
    each = asked.select("id", F.explode("prefixes").alias("address"))
    return each.join(addresses, "address").groupBy("id").agg(F.max_by("address", F.length("address")).alias("address"))


def subtree(edges: DataFrame, root: int, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(node, depth) below a root over edges (parent, child, kind), each node once at its least depth, cycles included.

    One join a level, each level a table of its own in the shared folder; nodes met before go, so that it ends."""
    from ..sources.scratch import Scratch

    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "subtree")
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    edges = edges.select("parent", F.col("child").alias("node"))
    seen = last = scratch.table(spark.createDataFrame([(root, 0)], "node long, depth int"), "level-0")
    depth = 0
    while True:
        depth += 1
        found = edges.join(last.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").distinct()
        last = scratch.table(found.join(seen, "node", "left_anti").select(F.col("node").cast("long"), F.lit(depth).alias("depth")), f"level-{depth}")
        if last.isEmpty():
            return scratch.only(seen, "nodes")
        seen = seen.union(last)


def prototype_chain(prototypes: DataFrame, keys: DataFrame, node: int) -> DataFrame:
    """(depth, key): own keys of a node (depth 0), then of each prototype above it; ``prototypes``: (node, prototype), ``keys``: (node, key).

    A chain is short: one point read a step. A node that comes again ends it."""
    at, met = node, []
    while at is not None and at not in met:
        met.append(at)
        row = prototypes.filter(F.col("node") == at).select("prototype").first()
        at = row["prototype"] if row else None
    chain = keys.sparkSession.createDataFrame([(n, d) for d, n in enumerate(met)], "node long, depth int")
    return F.broadcast(chain).join(keys, "node").select("depth", "key")


def has_key(prototypes: DataFrame, keys: DataFrame, node: int, key: str) -> tuple[bool, bool]:
    """(own, member): whether the node itself, or it or a prototype above it, has the key."""
    found = [r["depth"] for r in prototype_chain(prototypes, keys, node).filter(F.col("key") == key).collect()]
    return 0 in found, bool(found)


def promotions_of_target(promotions: DataFrame, environment: str) -> DataFrame:
    """Promotions into an environment, in order within each."""
    return promotions.filter(F.col("environment") == environment).select("promotion_id", "position", "result_id").orderBy("promotion_id", "position")


def promotions_naming(promotions: DataFrame, result_ids: DataFrame) -> DataFrame:
    """Promotions that name one of some results."""
    return promotions.join(result_ids.select("result_id"), "result_id", "left_semi").select("promotion_id", "environment", "position", "result_id")


def acceptances_of(acceptances: DataFrame, on: str, order: list[str]) -> DataFrame:
    """The acceptances of each result with their place, in order."""
    return acceptances.withColumn("place", F.row_number().over(Window.partitionBy(on).orderBy(*order)))


def envelope_of(attempts: DataFrame, results: DataFrame, attempt_id) -> DataFrame:
    """One attempt with the result that it published, if any."""
    return attempts.filter(F.col("attempt_id") == attempt_id).join(results.withColumnRenamed("result_id", "attempt_id"), "attempt_id", "left")


def unique_references(rows: DataFrame, group: str, order: str, reference: str) -> DataFrame:
    """(group, place, reference): the references of each group, each once, where it first occurs; places count from 1."""
    first = rows.groupBy(group, reference).agg(F.min(order).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_first"))).select(group, "place", reference)


def ordered_children(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "child"))), lambda x: x["child"].cast("string")), ",").alias("children"))


def scoped(df: DataFrame, **want) -> DataFrame:
    """Equality filters for the arguments that aren't None."""
    for name, value in want.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


#: Functions that a read may call: arithmetic, texts, dates, arrays, conditionals and aggregates; none that reaches files, classes or settings.
READ_FUNCTIONS = frozenset(
    """abs array array_contains array_distinct array_join array_sort avg between bool_and bool_or cast ceil ceiling char_length coalesce collect_list
    collect_set concat concat_ws contains count count_if date date_add date_diff day dense_rank element_at endswith exists explode filter first floor
    flatten from_json get_json_object greatest if ifnull in instr isnan isnotnull isnull json_array_length json_object_keys lag last lead least left
    length like lower lpad ltrim map_keys max max_by md5 min min_by mod month named_struct nullif nvl posexplode pow power rank regexp_extract
    regexp_like regexp_replace replace reverse right round row_number rpad rtrim sha2 sign size slice sort_array split sqrt startswith str_to_map
    struct substr substring sum timestamp to_date to_json to_timestamp transform translate trim try_add try_cast try_divide try_subtract unix_millis
    upper when xxhash64 year""".split()
)
_PLANS = frozenset(
    """Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases
    UnresolvedWith UnresolvedRelation OneRowRelation LocalRelation UnresolvedInlineTable UnresolvedHaving WithWindowDefinition Generate Window CTERelationRef WithCTE""".split()
)


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _inspect(plan, names: frozenset, found: set) -> None:
    """Collects the relations that a parsed plan reads; raises on any node or function that is not allowed. ``names``: CTEs in scope."""
    kind = plan.getClass().getSimpleName()
    if kind not in _PLANS:
        raise PermissionError(f"{kind} is not allowed in a read")
    if kind == "UnresolvedRelation":
        parts = [str(x).lower() for x in _seq(plan.multipartIdentifier())]
        if len(parts) > 1 or parts[0] not in names:
            found.add(".".join(parts))
        if plan.options().size():
            raise PermissionError("a read takes no options")
    if kind == "UnresolvedWith":
        own = set()
        recursive = plan.allowRecursion()
        for pair in _seq(plan.cteRelations()):
            alias = str(pair.productElement(0)).lower()
            _inspect(pair.productElement(1), names | own | ({alias} if recursive else set()), found)
            own.add(alias)
        _inspect(plan.child(), names | own, found)
        return
    for e in _seq(plan.expressions()):
        _inspect_expression(e, names, found)
    for c in _seq(plan.children()):
        _inspect(c, names, found)


def _inspect_expression(e, names: frozenset, found: set) -> None:
    kind = e.getClass().getSimpleName()
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        parts = [str(x).lower() for x in _seq(e.nameParts() if kind == "UnresolvedFunction" else e.name().nameParts())]
        if len(parts) > 1 or parts[0] not in READ_FUNCTIONS:
            raise PermissionError(f"{'.'.join(parts)} is not allowed in a read")
    if any(w in kind for w in ("Python", "Udf", "UDF", "Reflect", "Invoke", "Variable")):
        raise PermissionError(f"{kind} is not allowed in a read")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _inspect(e.plan(), names, found)
    for c in _seq(e.children()):
        _inspect_expression(c, names, found)


def read_query(spark, sql: str, allowed: set[str]) -> DataFrame:
    """Runs a query that only reads named views, with functions of a fixed list; anything else is refused before it runs."""
    found: set = set()
    _inspect(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(), found)
    if bad := found - {a.lower() for a in allowed}:
        raise PermissionError(f"unknown relations: {sorted(bad)}")
    return spark.sql(sql)
