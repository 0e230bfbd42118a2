"""Queries over the driver's tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions import identity as I
from srcloom.operators import aggregate, checks, dedup, graph, resolve, upsert
from srcloom.operators.enclosing import enclosing
from srcloom.plans import projection as P
from srcloom.plans.projection import table
from srcloom.schema import IGNORES, PARSERS
from srcloom.sources.files import glob_regex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def eid(kind: str, name: str) -> str:
    """SQL of an entity id."""
    return rf"'{kind.lower()}:' || regexp_replace(lower(replace({name}, '\', '/')), '[^a-z0-9_.:/-]', '_', 'g')"


def rid(kind: str, a: str, b: str) -> str:
    return rf"'{kind.lower()}:' || regexp_replace(lower({a} || ':' || {b}), '[^a-z0-9_.:/-]', '_', 'g')"


RAW = " UNION ALL ".join(f"SELECT {eid(k, f'CAST({c} AS VARCHAR)')} AS entityId, '{k}' AS kind, CAST({c} AS VARCHAR) AS name, CAST({o} AS BIGINT) AS ord FROM {t}" for k, t, c, o in P.KINDS)
NODES = f"raw AS ({RAW}), nodes AS (SELECT entityId, arg_max(kind, ord) AS kind, arg_max(name, ord) AS name, max(ord) AS ord FROM raw GROUP BY entityId)"
_PAIRS = (
    ("CONTAINS", eid("Region", "r_name"), eid("Nation", "n_name"), 1, "nation JOIN region ON n_regionkey = r_regionkey"),
    ("HAS_CUSTOMER", eid("Nation", "n_name"), eid("Customer", "c_name"), 5, "customer JOIN nation ON c_nationkey = n_nationkey"),
    ("HAS_SUPPLIER", eid("Nation", "n_name"), eid("Supplier", "s_name"), 5, "supplier JOIN nation ON s_nationkey = n_nationkey"),
    ("PLACED", eid("Customer", "c_name"), eid("Order", "CAST(o_orderkey AS VARCHAR)"), 9, "orders JOIN customer ON o_custkey = c_custkey"),
    ("INCLUDES_PART", eid("Order", "CAST(l_orderkey AS VARCHAR)"), eid("Part", "p_name"), 7, "(SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"),
    ("SUPPLIES", eid("Supplier", "s_name"), eid("Part", "p_name"), 6, "(SELECT DISTINCT s_name, p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"),
)
RELS = "rels AS (" + " UNION ALL ".join(f"SELECT {rid(k, f'({a})', f'({b})')} AS entityId, '{k}' AS type, {a} AS sourceId, {b} AS targetId, {w} AS weight FROM {t}" for k, a, b, w, t in _PAIRS) + ")"


@query(f"SELECT c_custkey AS key, {eid('Customer', 'c_name')} AS id, {eid('File', chr(39) + 'C:' + chr(92) + 'src' + chr(92) + chr(39) + ' || c_name || ' + chr(39) + ' (' + chr(39) + ' || c_mktsegment || ' + chr(39) + ').ts' + chr(39))} AS file_id FROM customer UNION ALL SELECT s_suppkey, {eid('Supplier', 's_name')}, {eid('File', 's_name')} FROM supplier")
def entity_id(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), I.entity_id("Customer", F.col("c_name")).alias("id"), I.entity_id("File", F.concat(F.lit("C:\\src\\"), "c_name", F.lit(" ("), "c_mktsegment", F.lit(").ts"))).alias("file_id"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), I.entity_id("Supplier", F.col("s_name")).alias("id"), I.entity_id("File", F.col("s_name")).alias("file_id")))


@query(f"WITH {NODES} SELECT kind, count(*) AS rows FROM nodes GROUP BY kind")
def nodes_by_kind(spark, sf):
    return aggregate.counts_by(P.nodes(spark, sf), "kind")


@query("SELECT kind, count(*) AS rows, count(DISTINCT entityId) AS keys, count(*) - count(DISTINCT entityId) AS surplus FROM (" + RAW + ") GROUP BY kind")
def duplicate_report(spark, sf):
    return dedup.duplicate_report(P.raw_nodes(spark, sf), ["kind"], "entityId")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def node_dedup_last_wins(spark, sf):
    return dedup.last_wins(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "props"), ["user_id", "event_type"], ["event_id"])


@query(f"SELECT {eid('Part', 'p_name')} AS id, arg_max(p_brand, p_partkey) AS p_brand, max(p_partkey) AS p_partkey FROM part GROUP BY 1")
def part_dedup_last_wins(spark, sf):
    return dedup.last_wins(table(spark, sf, "part").select(I.entity_id("Part", F.col("p_name")).alias("id"), "p_brand", "p_partkey"), ["id"], ["p_partkey"])


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def rel_dedup_first_wins(spark, sf):
    return dedup.first_wins(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 9 ELSE 5 END AS weight, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS pass FROM orders")
def pass_combine(spark, sf):
    orders = table(spark, sf, "orders")
    one = orders.select("o_orderkey", F.lit(5).alias("weight"))
    return dedup.combine_passes([one, orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(9).alias("weight"))], ["o_orderkey"], ["weight"])


@query(f"WITH {RELS} SELECT type, count(*) AS rows FROM rels GROUP BY type")
def rels_by_type(spark, sf):
    return aggregate.counts_by(P.rels(spark, sf), "type")


@query("SELECT type, sum(coalesce(weight, 0)) AS weight, count(*) AS rows FROM (SELECT 'PLACED' AS type, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 9 END AS weight FROM orders) GROUP BY type")
def rel_projection(spark, sf):
    rels = P.rels(spark, sf).where("type = 'PLACED'").select("entityId", "sourceId", "targetId", "type")
    orders = table(spark, sf, "orders").select(I.entity_id("Order", F.col("o_orderkey").cast("string")).alias("targetId"), F.when(F.col("o_orderstatus") != "F", 9).alias("weight"))
    return upsert.stored_rels(rels.join(orders, "targetId")).groupBy("type").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"))


@query("SELECT d.doc_id, d.source, l.doc_id IS NULL AS isPlaceholder FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def resolve_left_placeholder(spark, sf):
    return resolve.resolve_left(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id", "doc_id")


@query("SELECT d.doc_id AS ref, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def resolve_inner(spark, sf):
    return resolve.resolve_inner(table(spark, sf, "documents").select(F.col("doc_id").alias("ref"), "source"), table(spark, sf, "labels").select("doc_id", "quality"), "ref", "doc_id").select("ref", "source", "quality")


@query("SELECT event_id, coalesce(c.c_name, s.s_name, p.p_name) AS resolved, CASE WHEN c.c_name IS NOT NULL THEN 'customer' WHEN s.s_name IS NOT NULL THEN 'supplier' WHEN p.p_name IS NOT NULL THEN 'part' END AS via FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON user_id = c_custkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 2000) s ON user_id = s_suppkey LEFT JOIN part p ON user_id = p_partkey")
def resolve_priority(spark, sf):
    lookups = [("customer", table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))), ("supplier", table(spark, sf, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))), ("part", table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")))]
    return resolve.resolve_priority(table(spark, sf, "events").select("event_id", "user_id"), lookups, "user_id").select("event_id", "resolved", "via")


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def first_match_lookup(spark, sf):
    return resolve.first_match(table(spark, sf, "part"), "p_name", "p_partkey", "p_partkey")


@query("SELECT 'supplies:' || l_suppkey || ':' || l_partkey AS entityId, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, count(*) AS occurrences FROM lineitem GROUP BY l_suppkey, l_partkey")
def rel_collapse(spark, sf):
    li = table(spark, sf, "lineitem").select(I.relationship_id("SUPPLIES", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("entityId"), "l_suppkey", "l_partkey")
    return dedup.collapse(li)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_target_files(spark, sf):
    keep = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return resolve.semi(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), keep, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_seen(spark, sf):
    seen = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.anti(table(spark, sf, "customer").select("c_custkey", "c_name"), seen, ["c_custkey"])


@query("SELECT DISTINCT 'part:' || l_partkey AS entityId FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def placeholder_nodes(spark, sf):
    part = lambda c: F.concat(F.lit("part:"), c)
    rels = table(spark, sf, "lineitem").select(part(F.col("l_partkey")).alias("sourceId"), part(F.col("l_partkey")).alias("targetId"))
    return resolve.placeholders(rels, table(spark, sf, "part").where("p_size < 25").select(part(F.col("p_partkey")).alias("entityId")))


@query("SELECT c_custkey AS entityId, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def node_upsert_replace(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("entityId"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = old.where("segment = 'BUILDING'").select("entityId", F.upper("name").alias("name"))
    return upsert.replace_nodes(old, new)


@query("SELECT o_orderkey AS entityId, CASE WHEN o_orderpriority = '1-URGENT' THEN 'NEW' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus <> 'F'")
def rel_upsert_merge(spark, sf):
    orders = table(spark, sf, "orders")
    shape = lambda rows: rows.select(F.col("o_orderkey").alias("entityId"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"))
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    # what is new lacks the priority where the old row has it
    new = shape(urgent).withColumns({"status": F.lit("NEW"), "priority": F.when(F.col("status") == "F", F.col("priority"))})
    return upsert.merge_rels(shape(orders.where("o_orderstatus <> 'F'")), new)


@query("SELECT p_partkey AS key, CAST(p_partkey + 1000000 AS VARCHAR) AS name, p_brand AS brand FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, p_name, p_brand FROM part WHERE p_size % 2 <> 0")
def property_flatten(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.lit("Part").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("name"), (F.col("p_partkey") + 1000000).cast("string"))).alias("properties"))
    return upsert.flatten(rows, ["key", "kind", "name", "brand"]).withColumn("key", F.col("key").cast("long"))


@query(f"WITH raw AS ({RAW}) SELECT kind, entityId, count(*) AS rows FROM raw GROUP BY kind, entityId HAVING count(*) > 1")
def unique_violations(spark, sf):
    return checks.unique_violations(P.raw_nodes(spark, sf))


@query(f"WITH {NODES}, {RELS} SELECT entityId, 'target' AS side, targetId AS \"end\" FROM rels WHERE type IN ('HAS_CUSTOMER', 'PLACED') AND targetId NOT IN (SELECT entityId FROM nodes WHERE kind <> 'Order') UNION ALL SELECT entityId, 'source', sourceId FROM rels WHERE type IN ('HAS_CUSTOMER', 'PLACED') AND sourceId NOT IN (SELECT entityId FROM nodes WHERE kind <> 'Order')")
def dangling_ends(spark, sf):
    return checks.dangling_ends(P.rels(spark, sf).where("type IN ('HAS_CUSTOMER', 'PLACED')"), P.nodes(spark, sf).where("kind <> 'Order'"))


@query(f"WITH {NODES} SELECT kind, count(*) AS rows FROM nodes GROUP BY kind")
def unknown_labels(spark, sf):
    return checks.unknown_labels(P.nodes(spark, sf))


@query(f"WITH {RELS} SELECT type, count(*) AS rows FROM rels WHERE type <> 'CONTAINS' GROUP BY type")
def unknown_types(spark, sf):
    return checks.unknown_types(P.rels(spark, sf))


@query("SELECT l_orderkey, l_linenumber, l_partkey, c_nationkey IS DISTINCT FROM s_nationkey AS isCrossFile, CASE WHEN c_nationkey IS DISTINCT FROM s_nationkey THEN 6 ELSE 7 END AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey")
def cross_file_weight(spark, sf):
    li, orders, customer, supplier = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    who = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(who, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return resolve.weigh(rows, F.col("c_nationkey"), F.col("s_nationkey")).select("l_orderkey", "l_linenumber", "l_partkey", "isCrossFile", "weight")


@query('WITH i AS (SELECT event_id AS id, user_id, event_id % 97 AS s, event_id % 97 + 1 + event_id % 13 AS e FROM events), j AS (SELECT a.id, b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY b.s DESC, b.e, b.id) AS k FROM i a JOIN i b ON a.user_id = b.user_id AND b.s <= a.s AND b.e >= a.e AND a.id <> b.id) SELECT i.id, i.user_id, i.s AS "start", i.e AS "end", j.o AS "outerId" FROM i LEFT JOIN j ON i.id = j.id AND j.k = 1')
def enclosing_interval(spark, sf):
    i = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 97).alias("start"), (F.col("event_id") % 97 + 1 + F.col("event_id") % 13).alias("end"))
    return enclosing(i, i, "user_id")


@query("SELECT 'tailwindclass:' || regexp_replace(lower(t), '[^a-z0-9_.:/-]', '_', 'g') AS entityId, t AS name, count(*) AS uses FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part) WHERE t <> '' GROUP BY t")
def class_token_explode(spark, sf):
    rows = table(spark, sf, "part").select(F.explode(I.tokens(F.col("p_name"))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("uses")).select(I.entity_id("TailwindClass", F.col("name")).alias("entityId"), "name", "uses")


@query(r"SELECT page_id, tag, count(*) AS rows FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) GROUP BY page_id, tag")
def html_elements(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return rows.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("rows"))


@query(r"""SELECT 'jsxattribute:' || regexp_replace(lower('href:' || v), '[^a-z0-9_.:/-]', '_', 'g') AS entityId, v AS value, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(html, '\shref="([^"]*)"', 1)) AS v FROM pages) GROUP BY v""")
def html_attributes(spark, sf):
    rows = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'\shref="([^"]*)"'), F.lit(1))).alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("uses")).select(I.entity_id("JSXAttribute", F.concat(F.lit("href:"), "value")).alias("entityId"), "value", "uses")


_EXTS = (".ts", ".tsx", ".py", ".java", ".go", ".cs", ".hpp", ".sql", ".md", ".spec.ts", "")
_PATH_SQL = "'/src/' || p_brand || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || [" + ", ".join(f"'{e}'" for e in _EXTS) + f"][CAST(p_partkey % {len(_EXTS)} AS INTEGER) + 1]"


def _paths(spark, sf):
    ext = F.element_at(F.array(*(F.lit(e) for e in _EXTS)), (F.col("p_partkey") % len(_EXTS) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/src/"), "p_brand", F.lit("/"), F.translate("p_name", " ", "_"), F.lit("_"), "p_partkey", ext).alias("path"))


@query(f"SELECT p_partkey, path, CASE ext {' '.join(f'WHEN {chr(39)}{e}{chr(39)} THEN {chr(39)}{p}{chr(39)}' for e, p in PARSERS.items())} END AS parser FROM (SELECT p_partkey, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM (SELECT p_partkey, {_PATH_SQL} AS path FROM part))")
def ext_dispatch(spark, sf):
    from srcloom.sources.files import parser_of

    return _paths(spark, sf).withColumn("parser", parser_of(F.col("path")))


@query(f"SELECT p_partkey, path FROM (SELECT p_partkey, {_PATH_SQL} AS path FROM part) WHERE NOT (path LIKE '%.spec.ts')")
def ignore_globs(spark, sf):
    return _paths(spark, sf).where(~F.col("path").rlike(glob_regex(IGNORES)))


@query(f"WITH f AS (SELECT p_partkey, '/src/' || p_brand || '/' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '.ts' WHEN p_partkey % 3 = 1 THEN '/index.ts' ELSE '.tsx' END AS path FROM part), i AS (SELECT DISTINCT '/src/' || p_brand || '/main.ts' AS importer, './' || replace(p_name, ' ', '_') AS specifier, '/src/' || p_brand || '/' || replace(p_name, ' ', '_') AS base FROM part WHERE p_size > 25), c AS (SELECT importer, specifier, base, CASE WHEN EXISTS (SELECT 1 FROM f WHERE path = base || '.ts') THEN base || '.ts' WHEN EXISTS (SELECT 1 FROM f WHERE path = base || '.tsx') THEN base || '.tsx' WHEN EXISTS (SELECT 1 FROM f WHERE path = base || '/index.ts') THEN base || '/index.ts' END AS found FROM i) SELECT importer, specifier, coalesce(found, base) AS resolved, found IS NULL AS isPlaceholder FROM c")
def import_candidates(spark, sf):
    base = F.concat(F.lit("/src/"), "p_brand", F.lit("/"), F.translate("p_name", " ", "_"))
    part = table(spark, sf, "part")
    files = part.select(F.concat(base, F.when(F.col("p_partkey") % 3 == 0, ".ts").when(F.col("p_partkey") % 3 == 1, "/index.ts").otherwise(".tsx")).alias("path")).distinct()
    imports = part.where("p_size > 25").select(F.concat(F.lit("/src/"), "p_brand", F.lit("/main.ts")).alias("importer"), F.concat(F.lit("./"), F.translate("p_name", " ", "_")).alias("specifier")).distinct()
    return resolve.import_candidates(imports, files, [".ts", ".tsx"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN split_part(q, '.', 1) END AS schema_name, CASE WHEN p_partkey % 3 > 0 THEN split_part(q, '.', 2) ELSE q END AS table_name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '.') ELSE replace(p_name, ' ', '.') || '.x' END AS q FROM part)")
def split_qualified(spark, sf):
    q = F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", " ", "_")).when(F.col("p_partkey") % 3 == 1, F.translate("p_name", " ", ".")).otherwise(F.concat(F.translate("p_name", " ", "."), F.lit(".x")))
    schema, name = I.schema_and_name(F.col("q"))
    return table(spark, sf, "part").select("p_partkey", q.alias("q")).select("p_partkey", schema.alias("schema_name"), name.alias("table_name"))


@query("SELECT p_partkey, substr(regexp_replace(p_type || '.' || p_name || '()', '[^a-zA-Z0-9_]', '_', 'g'), 1, 30) AS slug FROM part")
def callee_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", I.callee_slug(F.concat("p_type", F.lit("."), "p_name", F.lit("()"))).alias("slug"))


@query("SELECT page_id, sha256(replace(url, '\\', '/')) AS hash FROM pages")
def path_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.path_hash(F.col("url")).alias("hash"))


@query(r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS ext FROM pages")
def path_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", I.basename(url).alias("base"), I.dirname(url).alias("dir"), I.extension(url).alias("ext"))


@query("SELECT p_partkey, regexp_replace('/a/' || p_name || CASE p_partkey % 4 WHEN 0 THEN '.js' WHEN 1 THEN '.JSX' WHEN 2 THEN '.ts' ELSE '' END, '\\.jsx?$', '', 'i') AS path FROM part")
def strip_extension(spark, sf):
    ext = F.when(F.col("p_partkey") % 4 == 0, ".js").when(F.col("p_partkey") % 4 == 1, ".JSX").when(F.col("p_partkey") % 4 == 2, ".ts").otherwise("")
    return table(spark, sf, "part").select("p_partkey", I.strip_script_extension(F.concat(F.lit("/a/"), "p_name", ext)).alias("path"))


@query("SELECT user_id, 1 + count(*) FILTER (event_type IN ('click', 'purchase')) AS complexity FROM events GROUP BY user_id")
def complexity_sum(spark, sf):
    return aggregate.complexity(table(spark, sf, "events"), ["user_id"], "event_type", ("click", "purchase"))


@query("SELECT user_id, bool_or(coalesce(event_type = 'error', false)) AS isConditional FROM events GROUP BY user_id")
def conditional_any(spark, sf):
    return aggregate.any_true(table(spark, sf, "events"), ["user_id"], F.col("event_type") == "error", "isConditional")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def collected_names(spark, sf):
    return aggregate.ordered_list(table(spark, sf, "nation"), ["n_regionkey"], "n_name", "n_nationkey")


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 10) AS BIGINT) AS batch FROM orders")
def batch_ids(spark, sf):
    return aggregate.batches(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], 10).select("o_orderkey", "batch")


@query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ordinal FROM orders")
def running_ordinal(spark, sf):
    return aggregate.ordinals(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])


@query(r"SELECT s_suppkey, 'supplier:' || regexp_replace(s_name, '[^a-zA-Z0-9_.:/-]', '_', 'g') || ':L' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ':C' || s_suppkey ELSE '' END || ':' || s_suppkey AS id FROM supplier")
def instance_id(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", I.instance_id("Supplier", F.col("s_name"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")), F.col("s_suppkey")).alias("id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS json FROM events")
def json_roundtrip(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return rows.select("event_id", "k", F.to_json(F.struct("k", F.col("event_type").alias("t"))).alias("json"))


@query("SELECT p_name AS name FROM part WHERE p_size < 10 UNION SELECT p_name FROM part WHERE p_size > 40 EXCEPT SELECT p_name FROM part WHERE p_brand = 'Brand#11'")
def set_operations(spark, sf):
    names = lambda where: table(spark, sf, "part").where(where).select(F.col("p_name").alias("name"))
    return names("p_size < 10").union(names("p_size > 40")).distinct().subtract(names("p_brand = 'Brand#11'"))


@query(f"WITH {NODES}, {RELS} SELECT r.sourceId AS fromId, n.entityId, n.name FROM rels r JOIN nodes n ON r.targetId = n.entityId WHERE r.type = 'HAS_SUPPLIER'")
def neighbors(spark, sf):
    return graph.neighbors(P.rels(spark, sf), P.nodes(spark, sf), "HAS_SUPPLIER")


@query(f"WITH {RELS} SELECT DISTINCT a.sourceId AS startId, a.targetId AS midId, b.targetId AS endId FROM rels a JOIN rels b ON a.targetId = b.sourceId WHERE a.type = 'CONTAINS' AND b.type = 'HAS_CUSTOMER'")
def two_hop(spark, sf):
    return graph.two_hop(P.rels(spark, sf), "CONTAINS", "HAS_CUSTOMER")


@query(f"WITH RECURSIVE {RELS}, r AS (SELECT {eid('Region', 'r_name')} AS entityId, 0 AS depth FROM region WHERE r_regionkey = 1 UNION SELECT rels.targetId, r.depth + 1 FROM r JOIN rels ON r.entityId = rels.sourceId WHERE r.depth < 3) SELECT entityId, min(depth) AS depth FROM r GROUP BY entityId")
def reach_k(spark, sf):
    start = table(spark, sf, "region").where("r_regionkey = 1").select(I.entity_id("Region", F.col("r_name")).alias("entityId"))
    return graph.reach(P.rels(spark, sf), start, 3)


@query(f"WITH {NODES}, {RELS}, d AS (SELECT id AS entityId, count(*) AS degree FROM (SELECT sourceId AS id FROM rels UNION ALL SELECT targetId FROM rels) GROUP BY id), k AS (SELECT n.kind, d.entityId, d.degree, CAST(row_number() OVER (PARTITION BY n.kind ORDER BY d.degree DESC, d.entityId) AS INTEGER) AS place FROM d JOIN nodes n ON d.entityId = n.entityId) SELECT * FROM k WHERE place <= 5")
def degree_topk(spark, sf):
    return graph.top_degrees(P.rels(spark, sf), P.nodes(spark, sf), 5)


@query("WITH e AS (SELECT DISTINCT 'n' || a AS s, 'n' || b AS t FROM (SELECT user_id AS a, CAST(floor(value) AS BIGINT) AS b FROM events) WHERE a <> b) SELECT x.s AS n0, y.s AS n1, z.s AS n2 FROM e x JOIN e y ON x.t = y.s JOIN e z ON y.t = z.s AND z.t = x.s WHERE x.s < y.s AND x.s < z.s AND y.s <> z.s")
def import_cycles(spark, sf):
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    e = table(spark, sf, "events").select(n(F.col("user_id")).alias("sourceId"), n(F.floor("value")).alias("targetId"))
    return graph.cycles(e, 3)


@query(f"WITH {NODES}, {RELS} SELECT 'node' AS part, kind AS name, count(*) AS rows FROM nodes GROUP BY kind UNION ALL SELECT 'relationship', type, count(*) FROM rels GROUP BY type")
def schema_summary(spark, sf):
    return graph.summary(P.nodes(spark, sf), P.rels(spark, sf))


# Queries on source code stand beside the extractors.
from srcloom.plans import module_queries, source_queries, store_queries  # noqa: E402

for own in (source_queries, module_queries, store_queries):
    QUERIES |= own.QUERIES
    ORACLES |= own.ORACLES
