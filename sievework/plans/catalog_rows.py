"""More queries of the catalog: row-level functions, selections, gates and report projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions import stats
from sievework.functions import text as X
from sievework.operators import abstention, asof, calibration, evidence, features, language, metrics, profile, rules, split, staging, wordpiece
from sievework.plans.catalog import _BINS_SQL, _CONF_SQL, _FLAGS, _FP, _GROUPS_SQL, _SCORES_SQL, _SWEEP_SQL, flagged, query, r, rounded, scored_embeddings, spread_sql, table
from sievework.sources import documents as sources


@query("SELECT event_id, trim(json_extract_string(props, '$.k')) AS id FROM events")
def e021_identifiers(spark, d):
    return table(spark, d, "events").select("event_id", X.identifier_field(F.col("props"), "k").alias("id"))


@query("SELECT conv_id, turn, nullif(trim(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g'))), '') AS text FROM conversations")
def e022_required_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.required_text(F.col("text")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def e024_strict_dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T23:30:00-05:00"))).otherwise(day)
    return table(spark, d, "orders").select("o_orderkey", X.strict_date(text).alias("day"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def e029_half_open_window(spark, d):
    return table(spark, d, "orders").where(stats.half_open(F.col("o_orderdate"), "1995-01-01", "1996-01-01")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN lang IN ('en', 'fr') THEN 'eligible' ELSE 'excluded' END AS eligibility_status, source, count(*) AS n FROM documents GROUP BY 1, 2")
def e030_set_membership(spark, d):
    staged = table(spark, d, "documents").select(
        F.col("source").alias("raw_batch_id"), F.col("doc_id").cast("int").alias("source_row_ordinal"), F.lit("1.1.0").alias("transformation_version"), F.lit("accepted").alias("outcome_status"),
        F.lit("2024-01-15").cast("date").alias("date_received"), F.col("text").alias("narrative"), F.col("lang").alias("product_raw"),
    )
    judged = staging.assess(staged, lambda text: F.lit("en"), labels=("en", "fr"))
    return profile.group_counts(judged.select("eligibility_status", F.col("raw_batch_id").alias("source")), "eligibility_status", "source")


@query("SELECT CASE WHEN strftime(o_orderdate, '%Y-%m') = '1996-09' THEN 'fit' WHEN strftime(o_orderdate, '%Y-%m') = '1996-10' THEN 'evaluation' END AS part, count(*) AS n FROM orders GROUP BY 1")
def e032_calibration_partition(spark, d):
    part = stats.calibration_part(F.col("o_orderdate"), "1996-09", "1996-10")
    return profile.group_counts(table(spark, d, "orders").select(part.alias("part")), "part")


@query("SELECT source, count(*) / (SELECT count(*) FROM documents) < 0.05 AS rare FROM documents GROUP BY 1")
def e034_rarity_class(spark, d):
    return rules.share_of_total(table(spark, d, "documents"), "source").select("source", (F.col("share") < 0.05).alias("rare"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, n_name FROM (SELECT DISTINCT c_nationkey FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey")
def e039_label_lookup(spark, d):
    names = F.broadcast(table(spark, d, "nation"))  # a row for each nation
    keys = table(spark, d, "customer").select("c_nationkey").distinct()
    return keys.join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_nationkey").cast("long").alias("nation"), "n_name")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0)")
def e049_missing_keys(spark, d):
    suppliers = table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return rules.absent(table(spark, d, "nation"), suppliers, ["n_nationkey"]).select("n_nationkey")


#: Documents as payloads with an id that repeats, a date, and fields that are blank in some rows.
_PAYLOAD = """to_json(named_struct('complaint_id', CASE WHEN doc_id % 9 = 0 THEN NULL ELSE cast(doc_id % 40 AS string) END, 'date_received', CASE WHEN doc_id % 8 = 0 THEN 'soon' ELSE date_format(date_add(DATE'2024-01-01', cast(doc_id % 60 AS int)), 'yyyy-MM-dd') END,
 'complaint_what_happened', CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE lang END, 'product', CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END))"""


@query("""WITH p AS (SELECT CASE WHEN doc_id % 9 <> 0 THEN doc_id % 40 END AS id, CASE WHEN doc_id % 8 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) END AS day, doc_id % 7 <> 0 AS narrated, doc_id % 5 <> 0 AS labelled FROM documents)
SELECT count(*) AS record_count, count(DISTINCT id) AS unique_ids, count(id) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (WHERE id IS NULL) AS missing_ids, count(*) FILTER (WHERE narrated) AS narratives, count(*) FILTER (WHERE labelled) AS labelled,
min(day) AS first_date, max(day) AS last_date, count(*) FILTER (WHERE NOT coalesce(day >= DATE '2024-01-10' AND day < DATE '2024-02-01', false)) AS outside_bounds FROM p""")
def e060_record_reconciliation(spark, d):
    return sources.inspection(table(spark, d, "documents").select(F.expr(_PAYLOAD).alias("payload")), "2024-01-10", "2024-02-01")


@query("SELECT label, n, expected FROM (SELECT CASE WHEN grouping(lang) = 0 THEN lang END AS label, count(*) AS n FROM documents GROUP BY GROUPING SETS ((), (lang))) FULL JOIN (SELECT CASE WHEN grouping(lang) = 0 THEN lang END AS other, count(*) FILTER (WHERE doc_id % 100 <> 1 OR lang <> 'en') AS expected FROM documents GROUP BY GROUPING SETS ((), (lang))) ON label IS NOT DISTINCT FROM other WHERE n IS DISTINCT FROM expected")
def e066_expected_counts(spark, d):
    docs = table(spark, d, "documents")
    fewer = docs.where("doc_id % 100 <> 1 OR lang <> 'en'")
    expected = profile.histogram(fewer, "n_chars", "lang").groupBy("label").agg(F.sum("n").alias("expected"))
    return profile.counts_differ(profile.histogram(docs, "n_chars", "lang"), expected)


@query(f"WITH {_SCORES_SQL} SELECT vec_id, " + r("nll AS nll") + " FROM v")
def e075_log_loss(spark, d):
    return rounded(scored_embeddings(spark, d).select("vec_id", "nll"), "nll")


@query(f"WITH {_SCORES_SQL} SELECT vec_id, CAST(i AS INTEGER) AS label_id, " + r("p AS p") + " FROM q")
def e117_softmax(spark, d):
    return rounded(scored_embeddings(spark, d).select("vec_id", F.posexplode("probabilities").alias("label_id", "p")), "p")


@query(f"WITH {_SCORES_SQL} SELECT vec_id, CASE WHEN confidence >= 0.2 THEN 'suggest' ELSE 'abstain' END AS decision FROM v")
def e213_decisions(spark, d):
    return abstention.decisions(scored_embeddings(spark, d), 0.2).select("vec_id", "decision")


@query(f"WITH {_SWEEP_SQL} SELECT threshold, CASE WHEN threshold >= 0.7 THEN 0.00002 ELSE 0.000005 END <= 0.00001 AS agrees FROM w")
def e086_reproduction(spark, d):
    rows = scored_embeddings(spark, d).select(F.col("_label").alias("actual"), "predicted", "confidence")
    swept = abstention.sweep(rows, list(range(10))).select("threshold", "coverage", "false_suggestion_rate")
    stored = swept.withColumn("coverage", F.col("coverage") + F.when(F.col("threshold") >= 0.7, 2e-5).otherwise(5e-6))
    return abstention.reproduced(stored, swept, "threshold", ["coverage", "false_suggestion_rate"]).select("threshold", "agrees")


#: Line items as predictions that are mostly right, the surer the more.
_GUESS = "CASE WHEN l_orderkey % 20 = 0 AND l_quantity < 40 THEN 'N' ELSE l_returnflag END"
_SURE = "CASE WHEN l_orderkey % 20 = 0 AND l_quantity < 40 THEN 0.5 + l_quantity / 200 WHEN l_returnflag = 'A' THEN 0.55 + l_discount * 4 ELSE 0.6 + l_discount * 4 END"


@query(f"""WITH v AS (SELECT l_returnflag AS label, {_GUESS} AS predicted, {_SURE} AS confidence FROM lineitem), g AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {", ".join(f"({t})" for t in abstention.THRESHOLDS)}) AS x(t)),
a AS (SELECT threshold, label, count(*) AS n, count(*) FILTER (WHERE confidence >= threshold) AS s FROM v CROSS JOIN g GROUP BY 1, 2),
b AS (SELECT threshold, l.label, count(v.predicted) FILTER (WHERE confidence >= threshold) AS s, count(v.predicted) FILTER (WHERE confidence >= threshold AND v.label = predicted) AS c FROM g CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS l(label) LEFT JOIN v ON predicted = l.label GROUP BY 1, 2),
w AS (SELECT threshold, (SELECT sum(s) FROM a WHERE a.threshold = g.threshold) AS s, (SELECT sum(n) FROM a WHERE a.threshold = g.threshold) AS n, (SELECT sum(c) FROM b WHERE b.threshold = g.threshold) AS c, (SELECT min(s / n) FROM a WHERE a.threshold = g.threshold) AS worst,
 (SELECT min(s) FROM b WHERE b.threshold = g.threshold) AS least, (SELECT min(c / nullif(s, 0)) FROM b WHERE b.threshold = g.threshold) AS precise FROM g),
e AS (SELECT * FROM w WHERE threshold > 0 AND c / nullif(s, 0) >= 0.93 AND s / n >= 0.6 AND (s - c) / n <= 0.05 AND worst >= 0.1 AND least >= 20 AND precise >= 0.5)
SELECT CASE WHEN count(*) = 0 THEN 'manual_review_only' ELSE 'threshold_proposed' END AS status, (SELECT threshold FROM e ORDER BY s / n DESC, c / s DESC, (s - c) / n, threshold LIMIT 1) AS proposed_threshold, count(*) AS eligible_candidates FROM e""")
def e101_threshold_selection(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("actual"), F.expr(_GUESS).alias("predicted"), F.expr(_SURE).alias("confidence"))
    return abstention.select_threshold(abstention.sweep(rows, _FLAGS, kind="string"))


@query(f"WITH {_SWEEP_SQL} SELECT threshold, suggested / total < 0.6 AS blocked FROM w WHERE threshold > 0")
def e164_blocking_gates(spark, d):
    rows = scored_embeddings(spark, d).select(F.col("_label").alias("actual"), "predicted", "confidence")
    return abstention.blocking(abstention.sweep(rows, list(range(10)))).select("threshold", F.col("blocking").contains("coverage_at_least_0p60").alias("blocked"))


@query(f"WITH {_BINS_SQL} SELECT bin, round(mc, 6) AS mean_confidence FROM b")
def e161_reliability_points(spark, d):
    return rounded(calibration.equal_width(scored_embeddings(spark, d)).where("n > 0").select("bin", "mean_confidence"), "mean_confidence")


@query("""WITH z AS (SELECT vec_id, label, t, CAST(unnest(embedding[1:10]) AS DOUBLE) / t AS z, generate_subscripts(embedding[1:10], 1) - 1 AS i FROM embeddings CROSS JOIN (VALUES (CAST(1.0 AS DOUBLE)), (CAST(0.4 AS DOUBLE))) AS x(t)),
e AS (SELECT *, max(z) OVER (PARTITION BY vec_id, t) AS top, exp(z - max(z) OVER (PARTITION BY vec_id, t)) AS ez FROM z),
v AS (SELECT vec_id, t, label, 1 / sum(ez) AS confidence, min(i) FILTER (WHERE z = top) AS predicted FROM e GROUP BY ALL),
b AS (SELECT t, CAST(least(floor(confidence * 15), 14) AS INTEGER) AS bin, avg(confidence) AS c, avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) AS a FROM v GROUP BY 1, 2)
SELECT CASE WHEN t = 1 THEN 'before' ELSE 'after' END AS series, bin, round(70 + c * 570, 4) AS x, round(400 - a * 350, 4) AS y FROM b""")
def e161_reliability_curves(spark, d):
    """The points of the reliability figure, before and after a temperature."""
    from sievework.sources import figures

    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    bins = {name: calibration.equal_width(calibration.scored(rows, F.slice("embedding", 1, 10), F.col("label"), heat)) for name, heat in (("before", 1.0), ("after", 0.4))}
    return rounded(figures.reliability_points(bins), "x", "y", digits=4)


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS events_of_user FROM events")
def e092_partition_count(spark, d):
    return staging.with_copies(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "events_of_user")


#: Brands as candidates, with few values of each metric, so that ties are many.
_BRANDS = "SELECT p_brand AS id, CAST(count(*) % 3 AS DOUBLE) AS macro_f1, CAST(CAST(sum(p_size) AS BIGINT) % 2 AS DOUBLE) AS worst_recall, CAST(CAST(sum(p_size) AS BIGINT) % 3 AS DOUBLE) AS weighted_f1, CAST(max(p_size) % 2 AS DOUBLE) AS c, CAST(sum(p_size) AS BIGINT) % 4 <> 0 AS converged FROM part GROUP BY 1"


@query(f"SELECT id AS candidate_id, macro_f1, worst_recall, weighted_f1, c FROM ({_BRANDS}) WHERE converged ORDER BY macro_f1 DESC, worst_recall DESC, weighted_f1 DESC, c, id LIMIT 1")
def e099_candidate_selection(spark, d):
    part = table(spark, d, "part").groupBy(F.col("p_brand").alias("candidate_id")).agg(F.count("*").alias("n"), F.sum("p_size").alias("s"), F.max("p_size").alias("m"))
    rows = part.selectExpr("candidate_id", "cast(n % 3 AS double) AS macro_f1", "cast(s % 2 AS double) AS worst_recall", "cast(s % 3 AS double) AS weighted_f1", "cast(m % 2 AS double) AS c", "s % 4 <> 0 AS converged")
    return metrics.select_candidate(rows).drop("converged")


@query("SELECT CAST(epoch AS INTEGER) AS epoch, macro_f1, worst_recall, weighted_f1 FROM (SELECT date_part('day', o_orderdate) AS epoch, CAST(count(*) % 2 AS DOUBLE) AS macro_f1, CAST(CAST(sum(o_custkey) AS BIGINT) % 2 AS DOUBLE) AS worst_recall, CAST(CAST(sum(o_custkey) AS BIGINT) % 3 AS DOUBLE) AS weighted_f1 FROM orders GROUP BY 1) ORDER BY macro_f1 DESC, worst_recall DESC, weighted_f1 DESC, epoch LIMIT 1")
def e100_epoch_selection(spark, d):
    days = table(spark, d, "orders").groupBy(F.dayofmonth("o_orderdate").alias("epoch")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))
    return metrics.select_epoch(days.selectExpr("epoch", "cast(n % 2 AS double) AS macro_f1", "cast(s % 2 AS double) AS worst_recall", "cast(s % 3 AS double) AS weighted_f1"))


@query("SELECT string_agg(concat(lang, '=', n), ',' ORDER BY lang) AS counts FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def e103_ordered_map(spark, d):
    counted = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counted.agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("m")).select(F.array_join(F.transform("m", lambda x: F.concat(x["lang"], F.lit("="), x["n"])), ",").alias("counts"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, CAST(l_discount AS DOUBLE) AS x FROM lineitem),
f AS (SELECT k, i, x AS best, 0 AS flat, false AS stop FROM l WHERE i = 1 UNION ALL
SELECT f.k, f.i + 1, CASE WHEN NOT stop AND x >= best + 0.001 THEN x ELSE best END, CASE WHEN stop THEN flat WHEN x >= best + 0.001 THEN 0 ELSE flat + 1 END, stop OR (x < best + 0.001 AND flat + 1 > 1) FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1)
SELECT k AS l_orderkey, best, CAST(flat AS INTEGER) AS flat, stop FROM f QUALIFY i = max(i) OVER (PARTITION BY k)""")
def e104_early_stopping(spark, d):
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").cast("double").alias("x"))
    runs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return runs.select("l_orderkey", metrics.early_stopping(F.col("e.x")).alias("s")).select("l_orderkey", "s.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 7 / 3 BETWEEN 0 AND 1 THEN round(CAST(l_discount AS DOUBLE) * 7 / 3, 6) END AS score, NOT coalesce(l_discount * 7 / 3 BETWEEN 0 AND 1, false) AS refused FROM lineitem")
def e118_metric_rounding(spark, d):
    """Every row: a value outside [0, 1] is refused, not dropped."""
    value = F.col("l_discount").cast("double") * 7 / 3
    sound = F.coalesce(value.between(0, 1), F.lit(False))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(sound, stats.metric(value)).alias("score"), (~sound).alias("refused"))


@query("SELECT p_partkey, round(CAST(p_retailprice AS DOUBLE) / CAST(nullif(p_size % 5, 0) AS DOUBLE), 6) AS ratio FROM part")
def e120_ratios(spark, d):
    return table(spark, d, "part").select("p_partkey", stats.ratio(F.col("p_retailprice"), F.col("p_size") % 5).alias("ratio"))


@query("SELECT event_type, count(*) >= 10 AND avg(value) > 0 AS passed FROM events GROUP BY 1")
def e121_gates(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rules.gates(rows, {"enough": "n >= 10", "positive": "mean > 0"}).select("event_type", "passed")


@query("SELECT doc_id, CAST(ceil(least(n_chars, 384) / 8.0) * 8 AS BIGINT) AS padded FROM documents")
def e122_padded_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", profile.padded(F.least("n_chars", F.lit(384))).alias("padded"))


@query("SELECT doc_id, CAST(least(len(string_split(text, ' ')), 384) AS INTEGER) AS kept FROM documents")
def e123_truncation(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return features.tokenized(docs, "text", lambda batch: [[len(w) for w in t.split(" ")] for t in batch]).select("doc_id", F.size("input_ids").alias("kept"))


@query("SELECT doc_id, CAST(nullif(list_position(['de', 'en', 'fr'], lang), 0) - 1 AS INTEGER) AS label_id FROM documents")
def e124_label_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", features.label_ids(F.col("lang"), ["de", "en", "fr"]).alias("label_id"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped, format('{:+.6f}', n_chars / 3.0) AS signed FROM documents")
def e128_formatting(spark, d):
    return table(spark, d, "documents").select("doc_id", X.html_escaped(F.col("source")).alias("escaped"), F.format_string("%+.6f", F.col("n_chars") / 3.0).alias("signed"))


@query("SELECT event_id % 4 AS kind, count(*) FILTER (WHERE event_id % 4 = 0) AS valid, count(*) FILTER (WHERE event_id % 4 <> 0) AS invalid FROM events GROUP BY 1")
def e129_json_validity(spark, d):
    value = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{\"k\": NaN}' WHEN 2 THEN '{\"k\": -Infinity}' ELSE '{\"k\": 1' END")
    judged = table(spark, d, "events").select((F.col("event_id") % 4).alias("kind"), X.json_valid(value).alias("ok"))
    return judged.groupBy("kind").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


#: Pieces: the words of the benchmark's texts, and every character of the documents at a word's beginning and inside.
_PIECES_SQL = r"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{P}\p{S}]|[^\s\p{P}\p{S}]+')) AS word FROM documents),
chars AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM words), common AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{P}\p{S}]|[^\s\p{P}\p{S}]+')) AS c FROM benchmark),
vocabulary AS (SELECT piece, row_number() OVER (ORDER BY encode(piece)) - 1 AS id FROM (SELECT c AS piece FROM chars UNION SELECT concat('##', c) FROM chars WHERE c < 'm' UNION SELECT c FROM common UNION SELECT concat('##', c) FROM common UNION SELECT unnest(['[CLS]', '[SEP]', '[UNK]'])))"""


@query(f"""WITH RECURSIVE {_PIECES_SQL}, kinds AS (SELECT DISTINCT word FROM words),
sizes AS (SELECT DISTINCT starts_with(piece, '##') AND length(piece) > 2 AS inside, length(piece) - CASE WHEN starts_with(piece, '##') AND length(piece) > 2 THEN 2 ELSE 0 END AS m FROM vocabulary),
steps AS (SELECT word, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, length(word) > 100 AS lost FROM kinds UNION ALL
SELECT word, pos + coalesce(best.m, 0), n + 1, total + coalesce(best.id, 0), best.m IS NULL FROM (
 SELECT s.word, s.pos, s.n, s.total, max(CASE WHEN v.id IS NOT NULL THEN struct_pack(m := z.m, id := v.id) END) AS best FROM steps s LEFT JOIN sizes z ON z.inside = (pos > 0) AND z.m <= length(word) - pos
 LEFT JOIN vocabulary v ON v.piece = CASE WHEN pos > 0 THEN '##' ELSE '' END || substr(word, pos + 1, z.m) WHERE pos < length(word) AND NOT lost GROUP BY 1, 2, 3, 4)),
done AS (SELECT word, CASE WHEN bool_or(lost) THEN 1 ELSE max(n) END AS n, CASE WHEN bool_or(lost) THEN (SELECT id FROM vocabulary WHERE piece = '[UNK]') ELSE max(total) END AS total FROM steps GROUP BY 1),
sums AS (SELECT doc_id, sum(n) AS n, sum(total) AS total FROM words JOIN done USING (word) GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) + 2 AS INTEGER) AS tokens, CAST(coalesce(total, 0) + (SELECT sum(id) FROM vocabulary WHERE piece IN ('[CLS]', '[SEP]')) AS BIGINT) AS id_sum FROM documents LEFT JOIN sums USING (doc_id)""")
def e136_token_lengths(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    of = lambda name: table(spark, d, name).select(F.explode(wordpiece.words(F.col("text"))).alias("c")).distinct()
    chars = of("documents").select(F.explode(F.split("c", "")).alias("c")).distinct()
    common = of("benchmark")
    special = spark.createDataFrame([(x,) for x in (wordpiece.CLS, wordpiece.SEP, wordpiece.UNKNOWN)], "piece string")
    inner = lambda df: df.select(F.concat(F.lit("##"), "c").alias("piece"))
    pieces = chars.select(F.col("c").alias("piece")).union(inner(chars.where("c < 'm'"))).union(common).union(inner(common)).union(special).distinct()
    vocabulary = pieces.select("piece", (F.row_number().over(Window.orderBy("piece")) - 1).alias("id"))  # as many rows as pieces
    ids = wordpiece.encode(docs, "doc_id", "text", vocabulary, limit=1 << 30)
    return ids.select("doc_id", F.size("input_ids").alias("tokens"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


#: Trigrams of every second document teach; all are named.
@query(r"""WITH p AS (SELECT doc_id, lang, concat(' ', trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')), ' ') AS s FROM documents),
g AS (SELECT doc_id, lang, substr(s, i, 3) AS gram FROM (SELECT doc_id, lang, s, unnest(range(1, CAST(length(s) AS BIGINT) - 1)) AS i FROM p)),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY 1, 2), t AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM c GROUP BY 1),
k AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(gram)) AS r FROM c) WHERE r <= 2000),
m AS (SELECT k.gram, t.lang, ln((coalesce(n, 0) + 1) / (total + kinds)) AS loglik FROM k CROSS JOIN t LEFT JOIN c ON c.lang = t.lang AND c.gram = k.gram),
s AS (SELECT doc_id, m.lang, avg(loglik) AS score, count(*) AS n FROM g JOIN m USING (gram) GROUP BY 1, 2),
b AS (SELECT doc_id, arg_max(lang, score) AS best, max(n) AS n, max(score) - list_sort(list(score), 'DESC')[2] AS lead FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN n >= 5 AND lead >= 0.05 THEN best END AS language FROM documents LEFT JOIN b USING (doc_id)""")
def e135_languages(spark, d):
    docs = table(spark, d, "documents")
    return language.scored(docs, "doc_id", "text", language.train(docs.where("doc_id % 2 = 0"), "text", "lang"))


@query("""WITH p AS (SELECT user_id, ts, max(event_type) AS predicted FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2), v AS (SELECT * FROM events WHERE event_id % 3 = 0)
SELECT v.event_type, count(*) AS reviews, count(predicted) AS judged, count(*) FILTER (WHERE predicted <> v.event_type) AS corrected, round(count(*) FILTER (WHERE predicted <> v.event_type) / nullif(count(predicted), 0), 6) AS correction_rate
FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts GROUP BY 1""")
def e218_correction_rates(spark, d):
    """Reviews (every third event) against the prediction valid at their time, of the same user."""
    events = table(spark, d, "events")
    predicted = events.where("event_id % 3 <> 0").select("user_id", "ts", F.col("event_type").alias("predicted"))
    found = asof.as_of(events.where("event_id % 3 = 0").select("user_id", "ts", "event_type"), predicted, "user_id", "ts")
    return rounded(asof.correction_rates(found, F.col("matched.predicted"), F.col("event_type"), ["event_type"]), "correction_rate")


@query("SELECT label, label <> 3 AS whole, NOT bool_or(vec_id % 50 = 7) AS finite, label < 9 AS labels_in_range, count(*) AS n FROM embeddings GROUP BY label")
def e149_array_checks(spark, d):
    # Some arrays are cut short, some hold NaN, and one label is out of range.
    e = F.expr("CASE WHEN label = 3 THEN slice(embedding, 1, 63) WHEN vec_id % 50 = 7 THEN transform(embedding, x -> cast('NaN' AS double)) ELSE embedding END")
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.when((F.col("label") == 3) & (F.col("vec_id") % 50 == 7), F.transform(e, lambda x: F.lit(float("nan")))).otherwise(e).alias("e"))
    return rules.array_checks(rows, "e", 64, "label", 9, ["label"])


@query(f"WITH {_CONF_SQL} SELECT * FROM (SELECT 'precision' AS metric, label, round(\"precision\", 6) AS value FROM c UNION ALL SELECT 'recall', label, round(recall, 6) FROM c UNION ALL SELECT 'f1', label, round(f1, 6) FROM c)")
def e165_metric_table(spark, d):
    classes = metrics.per_class(metrics.confusion(flagged(spark, d), "actual", "predicted", _FLAGS))
    return rounded(metrics.long_table(classes, ["label"], ["precision", "recall", "f1"]), "value")


@query(f"WITH {_SCORES_SQL}, m AS (SELECT avg(nll) AS nll, avg(brier) AS brier, avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM v) SELECT metric, round(value, 6) AS value FROM (SELECT 'nll' AS metric, nll AS value FROM m UNION ALL SELECT 'brier', brier FROM m UNION ALL SELECT 'accuracy', accuracy FROM m)")
def e165_calibration_table(spark, d):
    return rounded(metrics.long_table(calibration.metrics(scored_embeddings(spark, d)), [], ["nll", "brier", "accuracy"]), "value")


@query(f"WITH {_SWEEP_SQL} SELECT threshold, metric, round(value, 6) AS value FROM (SELECT threshold, 'coverage' AS metric, suggested / total AS value FROM w UNION ALL SELECT threshold, 'false_suggestion_rate', (suggested - correct) / total FROM w)")
def e165_abstention_table(spark, d):
    rows = scored_embeddings(spark, d).select(F.col("_label").alias("actual"), "predicted", "confidence")
    return rounded(metrics.long_table(abstention.sweep(rows, list(range(10))), ["threshold"], ["coverage", "false_suggestion_rate"]), "value")


@query(f"WITH {_SWEEP_SQL}, axes AS (SELECT threshold, suggested / total AS x, 1 - correct / nullif(suggested, 0) AS y FROM w) SELECT threshold, round(40 + coalesce((x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0), 0) * 560, 4) AS x, round(360 - coalesce((y - 0) / 1, 0) * 340, 4) AS y FROM axes")
def e161_risk_coverage(spark, d):
    rows = scored_embeddings(spark, d).select(F.col("_label").alias("actual"), "predicted", "confidence")
    all_ = Window.partitionBy()
    out = abstention.sweep(rows, list(range(10))).select("threshold", F.col("coverage").alias("c"), F.col("selective_risk").alias("r"))
    out = out.withColumns({"lo": F.min("c").over(all_), "hi": F.max("c").over(all_)})
    return rounded(out.select("threshold", profile.pixels(F.col("c"), F.col("lo"), F.col("hi"), 40, 600).alias("x"), profile.pixels(F.col("r"), F.lit(0.0), F.lit(1.0), 360, 20).alias("y")), "x", "y", digits=4)


@query("SELECT * FROM (SELECT CAST(0 AS INTEGER) AS step, 'staged_records' AS stage, count(*) AS n FROM documents UNION ALL SELECT 1, 'eligible', count(*) FROM documents WHERE n_chars >= 100 UNION ALL SELECT 2, 'included_record_count', count(*) FROM documents WHERE n_chars >= 100 AND lang = 'en' UNION ALL SELECT 3, 'train_record_count', count(*) FROM documents WHERE n_chars >= 100 AND lang = 'en' AND doc_id % 3 = 0 UNION ALL SELECT 4, 'validation_record_count', count(*) FROM documents WHERE n_chars >= 100 AND lang = 'en' AND doc_id % 3 = 1 UNION ALL SELECT 5, 'test_record_count', count(*) FROM documents WHERE n_chars >= 100 AND lang = 'en' AND doc_id % 3 = 2)")
def e163_funnel(spark, d):
    docs = table(spark, d, "documents")
    long, english = F.col("n_chars") >= 100, F.col("lang") == "en"
    report = docs.agg(F.count("*").alias("staged_records"), F.count_if(long).alias("eligible"))
    part = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    kept = docs.where(long).select(F.when(english, "included").otherwise("duplicate_same_label").alias("disposition"), F.when(english, part).alias("split_assignment"))
    return rules.funnel(report, split.split_counts(kept))


@query("SELECT category, count(*) AS n FROM (SELECT unnest([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END]) AS category FROM documents) WHERE category IS NOT NULL GROUP BY 1")
def e162_finding_counts(spark, d):
    found = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "short"), F.when(F.col("lang") != "en", "foreign")))
    rows = table(spark, d, "documents").select(found.alias("categories"), F.lit(True).alias("resolved"))
    return evidence.findings(rows, "categories", F.col("resolved"))


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN pr <= 0.7 THEN 'train' WHEN pr <= 0.85 THEN 'validation' ELSE 'test' END AS part FROM (SELECT cume_dist() OVER (ORDER BY CAST(o_orderdate AS DATE)) AS pr FROM orders)) GROUP BY 1")
def e211_fractional_split(spark, d):
    # Shares by day, so the running sum is over days, not rows.
    days = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("day")) / F.sum("n").over(Window.partitionBy())
    part = F.when(share <= 0.7, "train").when(share <= 0.85, "validation").otherwise("test")
    return days.select(part.alias("part"), "n").groupBy("part").agg(F.sum("n").alias("n"))


@query("SELECT toxic, regexp_matches(lower(text), 'idiot|moron|stupid|trash') AS flagged, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def e212_keyword_baseline(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return both.groupBy("toxic", F.lower("text").rlike("idiot|moron|stupid|trash").alias("flagged")).agg(F.count("*").alias("n"))


@query("SELECT gram, count(*) AS n FROM (SELECT unnest([substr(source, i, 3) FOR i IN range(1, length(source) - 1)]) AS gram FROM documents) GROUP BY 1")
def e215_character_grams(spark, d):
    grams = F.transform(F.sequence(F.lit(1), F.length("source") - 2), lambda i: F.substr(F.col("source"), i, F.lit(3)))
    return table(spark, d, "documents").where("length(source) >= 3").select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS missing, " + r("avg(length(props)) AS mean_length") + " FROM events GROUP BY 1")
def e216_volume_trend(spark, d):
    return rounded(table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg(F.length("props")).alias("mean_length")), "mean_length")


@query(f"SELECT count(DISTINCT {_FP}) AS fingerprints, count(*) AS n FROM documents")
def e051_distinct_counts(spark, d):
    return table(spark, d, "documents").groupBy(X.plain_fingerprint(F.col("text")).alias("fp")).agg(F.count("*").alias("n")).agg(F.count("*").alias("fingerprints"), F.sum("n").alias("n"))


@query("SELECT page_id, url, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages")
def e126_url_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("SELECT strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, count(*) AS n, " + r("sum(o_totalprice) AS total") + " FROM orders GROUP BY 1")
def e217_quarter_slices(spark, d):
    quarter = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-Q"), F.quarter("o_orderdate"))
    return rounded(table(spark, d, "orders").groupBy(quarter.alias("quarter")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total")


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap IS NULL OR gap >= INTERVAL 30 MINUTE GROUP BY 1")
def e134_sessions(spark, d):
    from sievework.streaming import events as streams

    return streams.sessions(table(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT label, " + r("sqrt(sum(n) OVER () / (count(*) OVER () * n)) AS weight") + " FROM (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1)")
def e087_language_weights(spark, d):
    return rounded(rules.class_weights(table(spark, d, "documents"), "lang").select("label", "weight"), "weight")


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(n_chars AS BIGINT) = length(text) AS agrees FROM documents")
def e112_char_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"), (F.col("n_chars") == F.length("text")).alias("agrees"))


@query(f"WITH {_GROUPS_SQL}, b AS (SELECT pool_id, batch_id, max(length) AS longest, count(*) AS rows, sum(length) AS total FROM (SELECT pool_id, batch_id, least(length, 384) AS length FROM groups) GROUP BY 1, 2) SELECT pool_id, batch_id, CAST(rows AS INTEGER) AS rows, CAST(ceil(longest / 8.0) * 8 AS INTEGER) AS width, CAST(total AS BIGINT) AS real FROM b")
def e133_collated_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w) + 1).alias("ids"))
    groups = profile.length_groups(docs.withColumn("length", F.size("ids")), "doc_id", "length")
    real = F.aggregate(F.transform("attention_mask", lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return profile.collated(groups, "ids").select("pool_id", "batch_id", F.size("input_ids").alias("rows"), F.size(F.element_at("input_ids", 1)).alias("width"), real.alias("real"))


@query("SELECT doc_id, e AS epoch, row_number() OVER (PARTITION BY e ORDER BY " + spread_sql("concat(doc_id, '/', e)", 42) + ", doc_id) - 1 AS position FROM documents CROSS JOIN (VALUES (0), (1)) AS x(e)")
def e130_reproducible_shuffle(spark, d):
    """Dense positions of two epochs, in cells of 100 rows."""
    docs = table(spark, d, "documents").select("doc_id")
    return profile.epoch_order(docs, "doc_id", 42, 0, 100).withColumn("epoch", F.lit(0)).union(profile.epoch_order(docs, "doc_id", 42, 1, 100).withColumn("epoch", F.lit(1))).select("doc_id", "epoch", "position")


@query("""WITH s AS (SELECT o_orderpriority AS model, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS b FROM orders GROUP BY 1),
f AS (SELECT model, list_filter([CASE WHEN a < b THEN 'quality_macro_f1' END, CASE WHEN a < 0.485 THEN 'quality_worst_recall' END, CASE WHEN b > 0.49 THEN 'calibration_ece' END, CASE WHEN a > b THEN 'calibration_nll' END], lambda x: x IS NOT NULL) AS failed FROM s)
SELECT model, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed FROM f""")
def e158_evidence(spark, d):
    share = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, 1.0).otherwise(0.0))
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(share("O").alias("a"), share("F").alias("b"))
    rows = rows.selectExpr("model", "a AS candidate_macro_f1", "b AS baseline_macro_f1", "a AS candidate_worst_recall", "0.485 AS baseline_worst_recall", "b AS calibrated_ece", "0.49 AS uncalibrated_ece", "a AS calibrated_nll", "b AS uncalibrated_nll")
    return evidence.evaluated(rows).select("model", F.array_join("failed_gates", ",").alias("failed"), "passed")


@query("SELECT lang, count(*) AS n, CAST(ceil(ceil(count(*) / 16.0) / 2.0) AS BIGINT) AS steps FROM documents GROUP BY 1")
def e127_optimizer_steps(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("steps", stats.optimizer_steps(F.col("n")))


@query("SELECT CASE WHEN n_chars < 500 THEN 'chars-1-499' WHEN n_chars < 1000 THEN 'chars-500-999' WHEN n_chars < 2000 THEN 'chars-1000-1999' WHEN n_chars < 4000 THEN 'chars-2000-3999' ELSE 'chars-4000-plus' END AS band, count(*) AS record_count, " + r("avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS accuracy") + " FROM documents GROUP BY 1")
def e072_length_slices(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("actual"), F.lit("en").alias("predicted"), stats.length_band(F.col("n_chars")).alias("band"))
    classes = metrics.per_class(metrics.confusion(rows, "actual", "predicted", ["de", "en", "es", "fr"], by=["band"]), ["band"])
    whole = metrics.complete(metrics.summary(classes, ["band"]), "band", [name for name, _ in stats.BANDS])
    return rounded(whole.select("band", "record_count", "accuracy"), "accuracy")
