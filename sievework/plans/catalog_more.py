"""More queries of the catalog: sources, artifacts, manifests, aggregate responses and evidence."""

from __future__ import annotations

import tempfile
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import evidence, similar, staging
from sievework.plans import workflows
from sievework.plans.catalog import query, table
from sievework.sources import acquisition, arrays, documents, trends
from sievework.sources.tables import Store
from sievework.streaming import stateful


def scratch_store(spark: SparkSession) -> Store:
    """A new store in the folder that all executors share; in a temporary one only where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return Store(spark, f"{found.rstrip('/')}/store-{uuid.uuid4().hex}" if found else f"file://{tempfile.mkdtemp(prefix='sievework-store-')}")


#: Documents as raw rows of one batch: narratives and labels that repeat, dates of the whole window.
_RAW = """to_json(named_struct('complaint_id', cast(doc_id AS string), 'date_received', date_format(date_add(DATE'2023-09-05', cast(doc_id % 480 AS int)), 'yyyy-MM-dd'),
 'complaint_what_happened', CASE WHEN doc_id % 41 = 0 THEN ' ' ELSE concat(lang, ' ', doc_id % 150, ' Told') END, 'product', CASE WHEN doc_id % 50 = 7 THEN 'Student loan' ELSE 'Mortgage' END, 'has_narrative', true))"""
_RAW_SQL = """
b AS (SELECT doc_id, DATE '2023-09-05' + CAST(doc_id % 480 AS INTEGER) AS day, CASE WHEN doc_id % 41 <> 0 THEN concat(lang, ' ', doc_id % 150, ' Told') END AS narrative, CASE WHEN doc_id % 50 = 7 THEN 'Student loan' ELSE 'Mortgage' END AS label FROM documents),
g AS (SELECT *, min(label) OVER (PARTITION BY narrative) <> max(label) OVER (PARTITION BY narrative) AS conflict, row_number() OVER (PARTITION BY narrative ORDER BY day, CAST(doc_id AS VARCHAR)) AS rn FROM b WHERE narrative IS NOT NULL),
s AS (SELECT *, CASE WHEN conflict THEN 'duplicate_label_conflict' WHEN rn > 1 THEN 'duplicate_same_label' ELSE 'included' END AS disposition FROM g),
a AS (SELECT *, CASE WHEN disposition = 'included' THEN CASE WHEN day < DATE '2024-09-01' THEN 'train' WHEN day < DATE '2024-11-01' THEN 'validation' ELSE 'test' END END AS split_assignment FROM s)"""


def stored_documents(spark: SparkSession, sf_dir: str) -> Store:
    """A store that holds the documents as a raw batch."""
    store = scratch_store(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("source_row_ordinal"), F.col("doc_id").cast("string").alias("complaint_id"), F.expr(_RAW).alias("payload"))
    rows = rows.select(F.lit("b-1").alias("batch_id"), "*", X.canonical_json_sha256(F.col("payload")).alias("source_record_sha256"))
    header = spark.createDataFrame([("b-1", "2.0.0", '{"request": {"parameters": {"format": "json"}}}')], "batch_id string, manifest_version string, manifest string")
    store.append("raw.complaints", rows, "raw.ingestion_batches", header, "b-1")
    return store


@query("SELECT 'b-1' AS batch_id, CAST(doc_id AS INTEGER) AS source_row_ordinal, CAST(doc_id AS VARCHAR) AS complaint_id FROM documents")
def e009_stored_rows(spark, d):
    return stored_documents(spark, d).read("raw.complaints", "b-1").select("batch_id", "source_row_ordinal", "complaint_id")


@query("SELECT CASE WHEN doc_id % 41 = 0 THEN 'quarantined' ELSE 'accepted' END AS outcome_status, count(*) AS n, CASE WHEN doc_id % 41 = 0 THEN 'narrative_missing_or_invalid' ELSE '' END AS reasons FROM documents GROUP BY 1, 3")
def e017_stored_outcomes(spark, d):
    store = stored_documents(spark, d)
    workflows.stage_batch(store, "b-1")
    return store.read("staging.complaint_outcomes", "b-1").groupBy("outcome_status", F.array_join("quarantine_reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query(f"WITH {_RAW_SQL} SELECT CAST(doc_id AS INTEGER) AS source_row_ordinal, disposition, split_assignment, CASE WHEN disposition <> 'included' THEN disposition END AS exclusion_reason, sha256(lower(narrative)) AS narrative_fingerprint_sha256 FROM a")
def e019_stored_split(spark, d):
    store = stored_documents(spark, d)
    workflows.stage_batch(store, "b-1")
    workflows.report_population(store, "b-1", lambda text: F.when(text.isNotNull(), "en"), "fixed")
    workflows.build_split(store, "run-1", "0" * 40, "0" * 64)
    return store.read("analytical.split_outcomes", "run-1").select("source_row_ordinal", "disposition", "split_assignment", "exclusion_reason", "narrative_fingerprint_sha256")


def page_artifacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as artifacts named by their content, some under a wrong name, and a manifest with some faults."""
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").withColumn("sha", F.sha2("html", 256))
    one = pages.groupBy("sha").agg(F.min(F.struct("page_id", "html")).alias("p")).select("sha", "p.*")
    faulty = F.col("page_id") % 5
    name = F.concat(F.when(faulty == 1, F.concat(F.lit("x"), "sha")).otherwise(F.col("sha")), F.lit(".json"))
    files = one.where(faulty != 2).select(F.concat(F.lit("file:/data/"), name).alias("path"), F.col("html").cast("binary").alias("content"))
    size = F.octet_length("html") + F.when(faulty == 3, 1).otherwise(0)
    stated = F.when(faulty == 4, F.sha2("sha", 256)).otherwise(F.col("sha"))
    return files, one.select(F.concat(F.lit("raw/"), name).alias("relative_path"), size.alias("byte_count"), stated.alias("sha256"))


@query("""WITH o AS (SELECT sha256(html) AS sha, min(page_id) AS page_id, octet_length(encode(any_value(html))) AS size FROM pages WHERE html IS NOT NULL GROUP BY 1)
SELECT concat('raw/', CASE WHEN page_id % 5 = 1 THEN 'x' ELSE '' END, sha, '.json') AS relative_path, page_id % 5 <> 2 AS exists, page_id % 5 <> 2 AND page_id % 5 <> 3 AS bytes_agree, page_id % 5 NOT IN (2, 4) AS hash_agrees, page_id % 5 NOT IN (1, 4) AS named_by_content FROM o""")
def e002_verified_artifacts(spark, d):
    return documents.verified(*page_artifacts(spark, d))


def conversation_documents(spark: SparkSession, sf_dir: str, envelope: bool) -> DataFrame:
    """Conversations as JSON documents, a turn an item."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(F.struct("role", "text").alias("_source")).alias("s"))
    lists = turns.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct("turn", F.col("s._source").alias("_source")))).alias("t"))
    items = F.transform("t", lambda x: F.struct(x["_source"].alias("_source")))
    return lists.select("path", F.to_json(F.struct(F.struct(items.alias("hits")).alias("hits")) if envelope else items).alias("document"))


_ITEMS = """SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS source_row_ordinal, role, text FROM conversations"""


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.col("source_row_ordinal").cast("int").alias("source_row_ordinal"), X.string_field(F.col("payload"), "role").alias("role"), X.string_field(F.col("payload"), "text").alias("text"))


@query(_ITEMS)
def e003_envelopes(spark, d):
    return _fields(documents.envelope_rows(conversation_documents(spark, d, True)))


@query(_ITEMS)
def e004_exports(spark, d):
    return _fields(documents.export_rows(conversation_documents(spark, d, False)))


@query(_ITEMS)
def e004_split_exports(spark, d):
    """The same read in pieces, as if a split held five closing braces."""
    return _fields(arrays.source_rows(arrays.elements(arrays.fragments_of(conversation_documents(spark, d, False), 5))))


@query("""SELECT count(*) AS record_count, count(DISTINCT o_custkey) AS unique_ids, count(*) - count(DISTINCT o_custkey) AS duplicate_ids, CAST(0 AS BIGINT) AS missing_ids, count(*) FILTER (WHERE o_orderstatus <> 'P') AS narratives, count(*) FILTER (WHERE trim(o_orderpriority) <> '') AS labelled,
min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count(*) FILTER (WHERE NOT (o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1997-01-01')) AS outside_bounds FROM orders""")
def e005_export_inspection(spark, d):
    fields = F.struct(F.col("o_custkey").alias("complaint_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_received"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("complaint_what_happened"), F.col("o_orderpriority").alias("product"))
    return documents.inspection(table(spark, d, "orders").select(F.to_json(fields).alias("payload")), "1993-01-01", "1997-01-01")


def order_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate response over orders: their priorities as labels, by month."""
    month = F.date_format(F.trunc(F.col("o_orderdate").cast("date"), "month"), "yyyy-MM-dd'T'00:00:00.000'Z'")
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), month.alias("key_as_string")).agg(F.count("*").alias("doc_count"))
    labels = counted.groupBy("key").agg(F.sum("doc_count").alias("doc_count"), F.struct(F.sort_array(F.collect_list(F.struct("key_as_string", "doc_count"))).alias("buckets")).alias("trend_period"))
    inner = F.struct(F.lit(0).alias("sum_other_doc_count"), F.sort_array(F.collect_list(F.struct("key", "doc_count", "trend_period"))).alias("buckets"))
    whole = labels.agg(F.struct(F.sum("doc_count").alias("doc_count"), inner.alias("product")).alias("product"))
    return whole.select(F.to_json(F.struct(F.struct("product").alias("aggregations"))).alias("document"))


@query("SELECT o_orderpriority AS label, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS label_count, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 3")
def e007_trend_months(spark, d):
    return trends.trend_months(order_trends(spark, d))


@query("""WITH m AS (SELECT o_orderpriority AS label, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')
SELECT true AS complete_labels, (SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)) = (SELECT count(*) FROM orders) AS counts_reconcile, true AS label_months_reconcile, count(DISTINCT month) = 48 AS months_complete, count(*) FILTER (WHERE label = '5-LOW') = 0 AS no_legacy_labels,
count(*) FILTER (WHERE label NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) = 0 AS no_unknown_labels, count(DISTINCT CASE WHEN label IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN label END) = 3 AS all_labels_observed FROM m""")
def e007_trend_checks(spark, d):
    response = order_trends(spark, d)
    return trends.trend_checks(trends.trend_months(response), trends.trend_totals(response), "1995-01", "1999-01", ("1-URGENT", "2-HIGH", "3-MEDIUM"), ("5-LOW",))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events")
def e148_shape_guards(spark, d):
    parsed = F.parse_json("props")
    return table(spark, d, "events").select("event_id", trends.required_count(F.try_variant_get(trends.required(parsed, "object", "props"), "$.k", "variant"), "k").alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '1.0' AS version FROM events")
def e012_report_rows(spark, d):
    reports = table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.regexp_replace("props", r"^\{", '{"version":"1.0",').alias("document"))
    return documents.report_rows(reports, "version string, k bigint", {"version": "1.0"})


@query("SELECT doc_id, nullif(trim(CASE doc_id % 3 WHEN 0 THEN concat('  ', lang, ' ') WHEN 1 THEN '   ' END), '') AS text FROM documents")
def e023_optional_text(spark, d):
    value = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('  ', lang, ' ') WHEN 1 THEN '   ' END")
    return table(spark, d, "documents").select("doc_id", X.optional_text(value).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(ts AS DATE) END AS day FROM events")
def e025_source_dates(spark, d):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 2 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\") ELSE date_format(ts, 'dd/MM/yyyy') END")
    return table(spark, d, "events").select("event_id", X.source_date(text).alias("day"))


@query("SELECT event_type AS batch_id, event_type IN ('click', 'view') AS guaranteed FROM events GROUP BY 1")
def e026_guaranteed_batches(spark, d):
    fine = F.col("event_type").isin("click", "view")
    parameters = F.struct(F.when(fine, "json").otherwise("csv").alias("format"), F.lit("true").alias("has_narrative"))
    batches = table(spark, d, "events").select(F.col("event_type").alias("batch_id"), F.to_json(F.struct(F.struct(parameters.alias("parameters")).alias("request"))).alias("manifest")).distinct()
    return staging.guaranteed_batches(batches)


_RETENTION = """CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'synthetic_version_unsupported' WHEN o_orderkey % 4 = 0 THEN 'synthetic_policy_invalid' WHEN o_orderkey % 7 <> 0 THEN 'synthetic_expiry_forbidden' END
WHEN o_orderkey % 3 = 1 THEN 'real_version_unsupported' WHEN o_orderkey % 4 = 1 THEN 'real_policy_invalid' WHEN o_orderkey % 7 = 0 THEN 'real_expiry_missing' WHEN day + 90 > DATE '1998-01-01' THEN 'real_expiry_beyond_policy' WHEN DATE '1997-06-01' >= day + 90 THEN 'real_batch_expired'
WHEN o_orderkey % 11 = 0 THEN 'real_commit_not_clean' WHEN strftime(day, '%Y-%m-%d') < '1997-04-01' OR strftime(day + 30, '%Y-%m-%d') > '1997-10-01' THEN 'real_request_outside_window' END"""


@query(f"SELECT o_orderkey, {_RETENTION} AS problem FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)")
def e035_retention_boundary(spark, d):
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    text = lambda x: F.date_format(x, "yyyy-MM-dd")
    synthetic = key % 10 == 0
    manifest = {
        "is_synthetic": synthetic, "version": F.when(synthetic, F.when(key % 3 == 0, "9").otherwise("1.0.0")).otherwise(F.when(key % 3 == 1, "9").otherwise("2.0.0")),
        "policy": F.when(synthetic, F.when(key % 4 == 0, "z").otherwise("s")).otherwise(F.when(key % 4 == 1, "z").otherwise("r")),
        "expires": F.when(key % 7 != 0, F.date_add(day, 90)), "retrieved": day, "clean": key % 11 != 0, "date_min": text(day), "date_max": text(F.date_add(day, 30)),
    }
    at = lambda x: F.lit(x).cast("date")
    problem = acquisition.retention_problem(manifest, policies=("s", "r"), deadline=at("1998-01-01"), now=at("1997-06-01"), window=("1997-04-01", "1997-10-01"))
    return table(spark, d, "orders").select("o_orderkey", problem.alias("problem"))


@query("WITH s AS (SELECT event_id, epoch(ts) - epoch(TIMESTAMP '2024-01-15 06:00:00') AS secs FROM events) SELECT event_id, CASE WHEN secs < 0 THEN 'overdue' WHEN ceil(secs / 86400) <= 30 THEN 'due_soon' ELSE 'scheduled' END AS status, CAST(greatest(0, ceil(secs / 86400)) AS BIGINT) AS days_left FROM s")
def e036_retention_status(spark, d):
    out = documents.retention(F.col("ts").cast("timestamp"), F.lit("2024-01-15 06:00:00").cast("timestamp"))
    return table(spark, d, "events").select("event_id", out.alias("r")).select("event_id", "r.status", F.col("r.days_left").cast("long").alias("days_left"))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 <> 0 AS synthetic FROM documents")
def e037_synthetic_marks(spark, d):
    key = F.col("doc_id")
    payload = F.to_json(F.struct(F.concat(F.when(key % 2 == 0, "SYN-").otherwise("R-"), key.cast("string")).alias("complaint_id"), F.concat(F.when(key % 3 == 0, "SYNTHETIC ").otherwise("a "), "lang").alias("complaint_what_happened")))
    index = F.when(key % 5 != 0, "Complaints-Synthetic-1").otherwise("complaints")
    return table(spark, d, "documents").select("doc_id", documents.synthetic(payload, index).alias("synthetic"))


@query("SELECT CAST(a.n_nationkey AS VARCHAR) AS document, CAST((a.n_nationkey + 1) % 30 AS VARCHAR) AS cites, (a.n_nationkey + 1) % 30 < 25 AS present, (a.n_nationkey + 1) % 30 < 25 AND a.n_nationkey % 4 <> 0 AS unbroken FROM nation a")
def e048_custody(spark, d):
    nations = table(spark, d, "nation")
    own = nations.select(F.col("n_nationkey").cast("string").alias("document"), F.sha2("n_name", 256).alias("sha256"))
    cited = (F.col("n_nationkey") + 1) % 30
    known = own.select(F.col("document").alias("cites"), F.col("sha256").alias("right"))
    links = nations.select(F.col("n_nationkey").cast("string").alias("document"), cited.cast("string").alias("cites"), (F.col("n_nationkey") % 4 == 0).alias("stale")).join(known, "cites", "left")
    return evidence.custody(own, links.select("document", "cites", F.when(F.col("stale"), F.sha2("right", 256)).otherwise(F.col("right")).alias("cited_sha256")))


@query("SELECT doc_id, sha256(text) AS exact, sha256(replace(text, chr(10), chr(13) || chr(10))) AS other_ends, sha256(text) AS any_ends FROM documents")
def e110_line_end_hashes(spark, d):
    windows = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    sha = X.content_sha256
    return table(spark, d, "documents").select("doc_id", sha(F.col("text").cast("binary")).alias("exact"), sha(windows.cast("binary")).alias("other_ends"), sha(windows.cast("binary"), any_line_ends=True).alias("any_ends"))


_PLACE = "CASE page_id % 6 WHEN 0 THEN concat('data/raw/', page_id) WHEN 1 THEN concat('/data/raw/', page_id) WHEN 2 THEN concat('data/raw/../', page_id) WHEN 3 THEN concat('data//raw/', page_id) WHEN 4 THEN concat('data/rawest/', page_id) ELSE concat('data/raw/a..b/', page_id) END"


@query("SELECT page_id, page_id % 6 IN (0, 5) AS confined FROM pages")
def e125_confined_paths(spark, d):
    return table(spark, d, "pages").select("page_id", X.confined(F.expr(_PLACE), "data/raw").alias("confined"))


@query("SELECT p_partkey AS candidate, round(CAST(p_retailprice AS DOUBLE), 6) AS score, true AS converged FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part)")
def e154_unique_selection(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("candidate"), F.round(F.col("p_retailprice").cast("double"), 6).alias("score"), F.lit(True).alias("converged"))
    last = parts.agg(F.max("candidate").alias("_last"))  # one row
    return evidence.the_selected(parts.join(last), "candidate", F.col("_last")).drop("_last")


@query("WITH c AS (SELECT event_type AS part, round(avg(value), 2) AS t, count(*) AS n FROM events GROUP BY 1) SELECT (SELECT count(*) FROM c WHERE part = 'click') = 1 AS one_of_each, abs((SELECT t FROM c WHERE part = 'click') - (SELECT t FROM c WHERE part = 'view')) <= 0.5 AS temperature_agrees, (SELECT n FROM c WHERE part = 'click') = (SELECT n FROM c WHERE part = 'view') AS classes_agree, true AS model_agrees")
def e155_same_calibrator(spark, d):
    own = table(spark, d, "events").groupBy(F.col("event_type").alias("part")).agg(F.round(F.avg("value"), 2).alias("temperature"), F.count("*").alias("classes"))
    one = lambda name: own.where(F.col("part") == name).select("temperature", "classes", F.lit("m").alias("model_sha256"))
    return evidence.same_calibrator(one("click"), one("view"), 0.5)


@query("WITH b AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1) SELECT true AS comparable, round((SELECT n FROM b WHERE event_type = 'view') / (SELECT n FROM b WHERE event_type = 'click'), 6) AS n_ratio, round((SELECT mean FROM b WHERE event_type = 'view') / (SELECT mean FROM b WHERE event_type = 'click'), 6) AS mean_ratio")
def e158_benchmark_pairs(spark, d):
    own = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    one = lambda name: own.where(F.col("event_type") == name).select(F.lit("h").alias("host"), "n", "mean")
    return evidence.benchmark_pairs(one("click"), one("view"), ["host"], ["n", "mean"])


@query("""WITH b AS (SELECT concat(user_id, '-', event_type) AS key, event_id AS id, epoch_us(ts) AS "at", lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT key, id, "at", CASE WHEN before IS NULL OR "at" - before >= 43200000000 THEN 'first' ELSE 'repeat' END AS status FROM b""")
def e210_expiring_first_seen(spark, d):
    events = table(spark, d, "events").withColumn("key", F.concat_ws("-", "user_id", "event_type"))
    return stateful.expiring_first_seen(events, "key", "ts", "event_id", timedelta(hours=12))


@query("""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END)) AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM s WHERE s IS NOT NULL),
k AS MATERIALIZED (SELECT class_id, any_value(n) AS n, unnest(any_value(s)) AS x FROM c GROUP BY class_id),
l AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b FROM k a JOIN k b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT DISTINCT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
g AS (SELECT a AS class_id, min(b) AS group_id FROM r GROUP BY 1)
SELECT s.doc_id AS id, coalesce(n, 0) AS n_shingles, coalesce(c.class_id, s.doc_id) AS class_id, coalesce(group_id, s.doc_id) AS group_id FROM s LEFT JOIN c ON c.doc_id = s.doc_id LEFT JOIN g ON g.class_id = c.class_id""")
def e219_similar_narratives(spark, d):
    """The SQL compares all pairs; the exact join finds every link without them."""
    return similar.similar_narratives(table(spark, d, "documents"), "doc_id", "text")


#: What a document's record must be like: a closed object of an id, a language, a source and sizes.
RECORD = {
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "lang", "sizes"],
    "properties": {
        "id": {"type": "string", "pattern": "^[0-9]+$"},
        "lang": {"enum": ["en", "de", "es", "fr"]},
        "source": {"$ref": "#/$defs/name"},
        "sizes": {"type": "array", "minItems": 1, "items": {"type": "integer", "minimum": 1, "maximum": 20000}},
    },
    "$defs": {"name": {"type": ["string", "null"], "minLength": 3}},
}


@query("""WITH d AS (SELECT doc_id, doc_id % 7 AS fault, n_chars, lang, source FROM documents),
p AS (SELECT doc_id, concat_ws(',',
 CASE WHEN fault = 3 THEN '$.lang: required' END,
 CASE WHEN fault = 4 THEN '$.more: additionalProperties' END,
 CASE WHEN fault = 1 THEN '$.id: type' END,
 CASE WHEN fault <> 3 AND (lang IS NULL OR lang NOT IN ('en', 'de', 'es', 'fr')) THEN '$.lang: enum' END,
 CASE WHEN source IS NOT NULL AND length(source) < 3 THEN '$.source: minLength' END,
 CASE WHEN fault = 5 THEN '$.sizes: minItems' END,
 CASE WHEN fault = 6 THEN '$.sizes[0]: type' END,
 CASE WHEN fault NOT IN (5, 6) AND n_chars < 1 THEN '$.sizes[0]: minimum' END,
 CASE WHEN fault NOT IN (5, 6) AND n_chars > 20000 THEN '$.sizes[0]: maximum' END) AS problems FROM d WHERE fault <> 2
 UNION ALL SELECT doc_id, '$: json' FROM d WHERE fault = 2)
SELECT doc_id, problems, nullif(split_part(problems, ',', 1), '') AS first_problem FROM p""")
def e001_contract_problems(spark, d):
    fault = F.col("doc_id") % 7
    size = F.when(fault == 6, F.concat(F.lit('"'), F.col("n_chars").cast("string"), F.lit('"'))).when(fault == 5, F.lit("")).otherwise(F.col("n_chars").cast("string"))
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    parts = [
        F.concat(F.lit('"id":'), F.when(fault == 1, F.col("doc_id").cast("string")).otherwise(quoted(F.col("doc_id").cast("string")))),
        F.when(fault != 3, F.concat(F.lit('"lang":'), quoted(F.col("lang")))),
        F.concat(F.lit('"source":'), quoted(F.col("source"))),
        F.concat(F.lit('"sizes":['), size, F.lit("]")),
        F.when(fault == 4, F.lit('"more":1')),
        F.when(fault == 2, F.lit('"id":NaN')),
    ]
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("document"))
    return documents.contract_problems(rows, RECORD).select("doc_id", F.array_join("problems", ",").alias("problems"), "first_problem")
