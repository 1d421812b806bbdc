"""Queries of the core operators over the test tables: name -> f(spark, folder), and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.functions import arith, parse, schema, text
from opinara.operators import augment, baselines, experiments, features, metrics, profile, retrieval
from opinara.plans.runtime import cut, global_rank

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- scoring ---------------------------------------------------------------------------------------------------------

_FX_GOLD = "SELECT l_orderkey example_id, l_partkey % 11 aspect, l_suppkey % 4 polarity, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 11 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) rn FROM lineitem WHERE (l_orderkey * 3 + l_linenumber) % 10 < 8"
_FX_PRED = "SELECT l_orderkey example_id, l_partkey % 11 aspect, CASE WHEN l_partkey % 5 = 0 THEN (l_suppkey + 1) % 4 ELSE l_suppkey % 4 END polarity, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 11 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) rn FROM lineitem WHERE (l_orderkey * 7 + l_linenumber * 3) % 10 < 8"
_FX_COUNTS = f"""WITH g AS (SELECT * FROM ({_FX_GOLD}) WHERE rn = 1), p AS (SELECT * FROM ({_FX_PRED}) WHERE rn = 1),
n AS (SELECT o_orderkey example_id, CASE WHEN o_custkey % 40 < 27 THEN 'es' ELSE 'en' END AS "language",
  coalesce(np, 0) n_pred, coalesce(ng, 0) n_gold, coalesce(nk, 0) n_ok FROM orders
  LEFT JOIN (SELECT example_id, count(*) ng FROM g GROUP BY 1) a ON a.example_id = o_orderkey
  LEFT JOIN (SELECT p.example_id, count(*) np, count(g.aspect) nk FROM p LEFT JOIN g USING (example_id, aspect, polarity) GROUP BY 1) b ON b.example_id = o_orderkey)"""
_PRF = "CASE WHEN {p} > 0 THEN 100.0::DOUBLE * {k} / {p} ELSE 0 END", "CASE WHEN {g} > 0 THEN 100.0::DOUBLE * {k} / {g} ELSE 0 END", "CASE WHEN {k} > 0 THEN 200.0::DOUBLE * {k} / ({p} + {g}) ELSE 0 END"


def _prf_sql(p: str, g: str, k: str) -> list[str]:
    return [x.format(p=p, g=g, k=k) for x in _PRF]


def _scores_sql(by: str = "") -> str:
    m, u = _prf_sql("n_pred", "n_gold", "n_ok"), _prf_sql("sum(n_pred)", "sum(n_gold)", "sum(n_ok)")
    cols = [f"round(avg({x}), 4) {n}" for x, n in zip(m, ("p_macro", "r_macro", "f1_macro"))] + [f"round({x}, 4) {n}" for x, n in zip(u, ("p_micro", "r_micro", "f1_micro"))]
    return f"SELECT {by + ', ' if by else ''}count(*) examples, sum(n_pred)::BIGINT n_pred, sum(n_gold)::BIGINT n_gold, sum(n_ok)::BIGINT n_ok, {', '.join(cols)} FROM n" + (f" GROUP BY {by}" if by else "")


def _fx(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem")

    def last(rows: DataFrame, polarity) -> DataFrame:
        # the last line of an (order, aspect), as one aggregate
        key = F.struct("l_linenumber", "l_partkey", "l_suppkey")
        return rows.groupBy(F.col("l_orderkey").alias("example_id"), (F.col("l_partkey") % 11).alias("aspect")).agg(F.max_by(polarity, key).alias("polarity"))

    gold = last(line.where("(l_orderkey * 3 + l_linenumber) % 10 < 8"), F.col("l_suppkey") % 4)
    pred = last(line.where("(l_orderkey * 7 + l_linenumber * 3) % 10 < 8"), F.when(F.col("l_partkey") % 5 == 0, (F.col("l_suppkey") + 1) % 4).otherwise(F.col("l_suppkey") % 4))
    examples = _t(spark, d, "orders").select(F.col("o_orderkey").alias("example_id"), F.when(F.col("o_custkey") % 40 < 27, "es").otherwise("en").alias("language"))
    return metrics.counts(examples, pred, gold, "example_id", ("language",))


@query(f"{_FX_COUNTS} {_scores_sql()}")
def q_metrics_overall(spark, d):
    return metrics.scores(_fx(spark, d))


@query(f"{_FX_COUNTS} {_scores_sql(chr(34) + 'language' + chr(34))}")
def q_metrics_by_language(spark, d):
    return metrics.scores(_fx(spark, d), "language")


@query(f"{_FX_COUNTS} SELECT * FROM n")
def q_counts_per_example(spark, d):
    return _fx(spark, d)


_TS = """WITH t AS (SELECT gen_id, text, "language", coalesce(map_entries(gold), []) g, coalesce(map_entries(prediction), []) p, prediction IS NOT NULL has FROM thinking_sanity),
n AS (SELECT gen_id, "language", len(p) n_pred, len(g) n_gold, len(list_intersect(p, g)) n_ok, has, list_sort(p) = list_sort(g) same FROM t),
names AS (SELECT DISTINCT gen_id, "language", unnest(list_concat(list_transform(g, lambda x: x.key), list_transform(p, lambda x: x.key))) aspect FROM t),
ge AS (SELECT gen_id, e.key aspect, e.value gold FROM (SELECT gen_id, unnest(g) e FROM t)),
pe AS (SELECT gen_id, e.key aspect, e.value pred FROM (SELECT gen_id, unnest(p) e FROM t)),
al AS (SELECT names.*, gold, pred FROM names LEFT JOIN ge USING (gen_id, aspect) LEFT JOIN pe USING (gen_id, aspect))"""


def _ts_counts(spark, d):
    p, g, k = metrics.counts_in_row(F.col("prediction"), F.col("gold"))
    return _t(spark, d, "thinking_sanity").select("gen_id", "language", p.alias("n_pred"), g.alias("n_gold"), k.alias("n_ok"))


def _aligned(spark, d):
    return metrics.aligned(_t(spark, d, "thinking_sanity"), "gen_id", "prediction", "gold", "language")


@query(f"{_TS} {_scores_sql()}")
def q_metrics_maps(spark, d):
    return metrics.scores(_ts_counts(spark, d))


@query(f"{_TS} {_scores_sql(chr(34) + 'language' + chr(34))}")
def q_metrics_maps_by_label_language(spark, d):
    return metrics.scores(_ts_counts(spark, d), "language")


def _label_sql(by: str) -> str:
    p, r, f = _prf_sql("sum(p)", "sum(g)", "sum(k)")
    return f"SELECT {by}, sum(p)::BIGINT n_pred, sum(g)::BIGINT n_gold, sum(k)::BIGINT n_ok, round({p}, 4) p, round({r}, 4) r, round({f}, 4) f1"


@query(f"{_TS} {_label_sql('aspect')} FROM (SELECT aspect, (pred IS NOT NULL)::INT p, (gold IS NOT NULL)::INT g, coalesce(gold = pred, false)::INT k FROM al) GROUP BY aspect")
def q_per_aspect(spark, d):
    return metrics.by_label(_aligned(spark, d), "aspect")


@query(f"{_TS} {_label_sql('polarity')} FROM (SELECT pred polarity, 1 p, 0 g, coalesce(gold = pred, false)::INT k FROM al WHERE pred IS NOT NULL UNION ALL SELECT gold, 0, 1, 0 FROM al WHERE gold IS NOT NULL) GROUP BY polarity")
def q_per_polarity(spark, d):
    return metrics.by_label(_aligned(spark, d), "polarity")


@query(f"{_TS} SELECT \"language\", aspect, gold, count(*) n, count_if(coalesce(gold = pred, false)) ok FROM al WHERE gold IS NOT NULL GROUP BY GROUPING SETS ((\"language\"), (aspect), (gold), (aspect, gold))")
def q_breakdown(spark, d):
    sets = [["language"], ["aspect"], ["gold"], ["aspect", "gold"]]
    rows = _aligned(spark, d).where("gold is not null")
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "language", "aspect", "gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))).alias("ok"))


@query(f"{_TS} SELECT aspect, count_if(coalesce(gold = pred, false)) tp, count_if(pred IS NOT NULL AND NOT coalesce(gold = pred, false)) fp, count_if(gold IS NOT NULL AND NOT coalesce(gold = pred, false)) fn FROM al GROUP BY aspect")
def q_confusion(spark, d):
    return metrics.confusion(_aligned(spark, d))


@query(f"{_TS} SELECT CASE WHEN pred IS NULL THEN 'missing' WHEN gold IS NULL THEN 'extra' ELSE 'wrong' END kind, aspect, gold gold_polarity, pred pred_polarity, count(*) n FROM al WHERE gold IS DISTINCT FROM pred GROUP BY ALL")
def q_error_profile(spark, d):
    return metrics.error_profile(_aligned(spark, d))


@query(f"{_TS} SELECT count(*) examples, count_if(n_pred = 0 AND n_gold > 0) empty_pred_with_gold, count_if(n_pred > 0 AND n_gold = 0) pred_with_empty_gold, (SELECT count(DISTINCT gen_id) FROM al WHERE gold <> pred) wrong_polarity, count_if(same AND has) exact, count_if(has) with_prediction, round(100.0::DOUBLE * count_if(same AND has) / count_if(has), 4) exact_pct FROM n")
def q_error_counters(spark, d):
    return metrics.error_counters(_t(spark, d, "thinking_sanity"), "prediction", "gold")


_M, _U = _prf_sql("n_pred", "n_gold", "n_ok"), _prf_sql("sum(n_pred)", "sum(n_gold)", "sum(n_ok)")


@query(f"""{_TS} SELECT count(*) examples, {', '.join(f"coalesce(sum(thinking_metadata.{c}), 0)::BIGINT {c}" for c in ("prompt_tokens", "output_tokens", "thinking_tokens", "final_tokens"))},
{', '.join(f"count_if(thinking_metadata.{c}) {c}" for c in ("closed_thinking", "hit_token_limit", "unfinished_at_limit", "ended_with_eos"))}, round(coalesce(sum(thinking_metadata.elapsed_sec), 0), 2) elapsed_sec,
{', '.join(f"round(avg({x}), 4) {n}" for x, n in zip(_M, ("p_macro", "r_macro", "f1_macro")))}, {', '.join(f"round({x}, 4) {n}" for x, n in zip(_U, ("p_micro", "r_micro", "f1_micro")))} FROM n JOIN thinking_sanity USING (gen_id)""")
def q_thinking_rollup(spark, d):
    return metrics.thinking_rollup(_t(spark, d, "thinking_sanity"), "thinking_metadata", "prediction", "gold")


@query("""WITH g AS (SELECT l_orderkey id, l_returnflag t, l_partkey % 5 v FROM lineitem WHERE l_linenumber % 2 = 0), p AS (SELECT l_orderkey id, l_returnflag t, l_partkey % 5 v FROM lineitem WHERE l_linenumber % 2 = 1),
n AS (SELECT o_orderkey, coalesce(a.c, 0) n_pred, coalesce(b.c, 0) n_gold, coalesce(k, 0) n_ok FROM orders LEFT JOIN (SELECT id, count(*) c, count_if((id, t, v) IN (SELECT (id, t, v) FROM g)) k FROM p GROUP BY 1) a ON a.id = o_orderkey LEFT JOIN (SELECT id, count(*) c FROM g GROUP BY 1) b ON b.id = o_orderkey) """ + _scores_sql())
def q_bag_scoring(spark, d):
    line = _t(spark, d, "lineitem")
    side = lambda r: line.where(F.col("l_linenumber") % 2 == r).select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("aspect"), (F.col("l_partkey") % 5).alias("polarity"))
    return metrics.scores(metrics.counts(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), side(1), side(0), "id"))


# --- profiles --------------------------------------------------------------------------------------------------------

_DS = "WITH e AS (SELECT row_no, split, \"language\", x.key aspect, x.value polarity FROM (SELECT row_no, split, \"language\", unnest(map_entries(gold)) x FROM dataset))"


def _pairs(spark, d):
    return metrics.label_pairs(_t(spark, d, "dataset"), "row_no", "gold", "split", "language")


@query(f"{_DS} SELECT aspect, count(*) n FROM e GROUP BY 1")
def q_aspect_freq(spark, d):
    return profile.frequencies(_pairs(spark, d), "aspect")


@query(f"{_DS} SELECT polarity, count(*) n FROM e GROUP BY 1")
def q_polarity_freq(spark, d):
    return profile.frequencies(_pairs(spark, d), "polarity")


@query(f"{_DS} SELECT aspect, polarity, count(*) n, min(row_no) first_seen FROM e GROUP BY 1, 2")
def q_pair_freq(spark, d):
    return profile.frequencies(_pairs(spark, d), "aspect", "polarity", order="row_no")


@query(f"{_DS} SELECT aspect, polarity, n FROM (SELECT aspect, polarity, count(*) n, row_number() OVER (PARTITION BY aspect ORDER BY count(*) DESC, min(row_no)) r FROM e GROUP BY 1, 2) WHERE r = 1")
def q_majority_polarity(spark, d):
    return profile.majority_polarity(_pairs(spark, d), "row_no")


@query(f"{_DS} SELECT \"rank\", aspect, n FROM (SELECT aspect, count(*) n, row_number() OVER (ORDER BY count(*) DESC, min(row_no), aspect) AS \"rank\" FROM e GROUP BY 1) WHERE \"rank\" <= 5")
def q_top_aspects(spark, d):
    return profile.top_aspects(_pairs(spark, d), "row_no", 5)


@query("SELECT split, \"language\", count(*) examples, round(avg(n), 4) mean_labels, quantile_cont(n::DOUBLE, 0.5) median_labels, max(n) max_labels, count_if(n = 0) empty_gold FROM (SELECT split, \"language\", coalesce(cardinality(gold), 0)::INT n FROM dataset) GROUP BY GROUPING SETS ((split, \"language\"), (split), ())")
def q_dataset_shape(spark, d):
    return profile.dataset_shape(_t(spark, d, "dataset"), "gold", [["split", "language"], ["split"], []]).select("split", "language", "examples", "mean_labels", "median_labels", "max_labels", "empty_gold")


@query("SELECT split, labels, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 4) pct FROM (SELECT split, coalesce(cardinality(gold), 0)::INT labels FROM dataset) GROUP BY 1, 2")
def q_label_count_dist(spark, d):
    rows = _t(spark, d, "dataset").select("split", F.greatest(F.coalesce(F.size("gold"), F.lit(0)), F.lit(0)).alias("labels"))
    return profile.shares(rows, ["split"], ["labels"])


@query(f"{_DS} SELECT split, aspect, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 4) pct FROM e GROUP BY 1, 2")
def q_aspect_share(spark, d):
    return profile.shares(_pairs(spark, d), ["split"], ["aspect"])


@query(f"{_DS} SELECT \"language\", polarity, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY \"language\"), 4) pct FROM e GROUP BY 1, 2")
def q_polarity_share(spark, d):
    return profile.shares(_pairs(spark, d), ["language"], ["polarity"])


@query(f"{_DS} SELECT aspect, {', '.join(f'count_if(polarity = {chr(39)}{p}{chr(39)}) {p}' for p in schema.POLARITIES)} FROM e GROUP BY 1")
def q_pivot_matrix(spark, d):
    return profile.matrix(_pairs(spark, d), "aspect", "polarity", schema.POLARITIES)


@query(f"{_DS} SELECT a.aspect aspect_a, b.aspect aspect_b, count(*) n FROM e a JOIN e b USING (row_no) GROUP BY 1, 2")
def q_cooccurrence(spark, d):
    return profile.cooccurrence(_t(spark, d, "dataset"), "gold")


@query(f"{_DS} SELECT aspect, polarity, n FROM (SELECT aspect, polarity, count(*) n, min(row_no) f FROM e GROUP BY 1, 2) ORDER BY n, f, aspect, polarity LIMIT 12")
def q_rare_pairs(spark, d):
    return profile.rarest(_pairs(spark, d), "row_no", 12)


_EDGES = [0, 10, 25, 50, 75, 100, 150, 200, 400]


@query("SELECT b bin_from, t bin_to, count(n) n FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in zip(_EDGES, _EDGES[1:])) + ") v(b, t) LEFT JOIN (SELECT len(list_filter(regexp_split_to_array(text, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+'), lambda x: x <> '')) n FROM dataset WHERE text IS NOT NULL) ON n >= b AND (n < t OR (t = 400 AND n = 400)) GROUP BY 1, 2")
def q_length_hist(spark, d):
    rows = _t(spark, d, "dataset").where("text is not null").select(F.size(F.filter(F.split("text", r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"), lambda x: x != "")).alias("n"))
    return profile.histogram(rows, "n", _EDGES)


@query("SELECT (n_chars // 100 * 100)::BIGINT bin_from, count(*) examples, round(avg(len(genre)), 4) mean FROM documents GROUP BY 1")
def q_length_bins(spark, d):
    return profile.mean_by_bin(_t(spark, d, "documents"), F.col("n_chars"), F.length("genre"), 100)


@query("SELECT lang, round(quantile_cont(n_chars::DOUBLE, 0.5), 4) p50, round(quantile_cont(n_chars::DOUBLE, 0.95), 4) p95, round(quantile_cont(n_chars::DOUBLE, 0.99), 4) p99, max(n_chars)::DOUBLE longest, round(avg(n_chars), 4) mean FROM documents GROUP BY 1")
def q_percentiles(spark, d):
    return profile.percentiles(_t(spark, d, "documents"), "n_chars", [0.5, 0.95, 0.99], "lang")


_LIMITS = [128, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096]


@query("SELECT genre, v.l AS \"limit\", round(100.0 * count_if(n_chars <= v.l) / count(*), 4) pct_at_most, round(100.0 * count_if(n_chars < v.l) / count(*), 4) pct_below, count_if(n_chars > v.l) AS \"over\" FROM documents, (VALUES " + ", ".join(f"({n})" for n in _LIMITS) + ") v(l) GROUP BY 1, 2")
def q_fit_table(spark, d):
    return profile.fit_table(_t(spark, d, "documents"), "n_chars", _LIMITS, "genre")


@query("SELECT greatest(128, ceil(quantile_cont(n_chars::DOUBLE, 0.99) + 64))::BIGINT from_p99, greatest(256, ceil(max(n_chars) + 96))::BIGINT from_max FROM documents")
def q_token_budget(spark, d):
    rows = _t(spark, d, "documents").agg(F.percentile(F.col("n_chars").cast("double"), F.lit(0.99)).alias("p"), F.max("n_chars").alias("m"))
    a, b = arith.token_budget(F.col("p"), F.col("m"))
    return rows.select(a.cast("long").alias("from_p99"), b.cast("long").alias("from_max"))


_BASE = ["empty", "oracle_aspects_majority_polarity", "top1_positive", "top1_majority", "top3_positive", "top3_majority", "top5_positive", "top5_majority"]


@query(f"""{_DS}, tr AS (SELECT * FROM e WHERE split = 'train'), maj AS (SELECT aspect, polarity FROM (SELECT aspect, polarity, row_number() OVER (PARTITION BY aspect ORDER BY count(*) DESC, min(row_no)) r FROM tr GROUP BY 1, 2) WHERE r = 1),
top AS (SELECT aspect, row_number() OVER (ORDER BY count(*) DESC, min(row_no), aspect) r FROM tr GROUP BY 1), test AS (SELECT row_no FROM dataset WHERE split = 'devel'), g AS (SELECT row_no, aspect, polarity FROM e WHERE split = 'devel'),
pred AS (SELECT 'oracle_aspects_majority_polarity' b, row_no, aspect, coalesce(maj.polarity, 'positive') polarity FROM g LEFT JOIN maj USING (aspect)
UNION ALL SELECT 'top' || k || '_positive', row_no, aspect, 'positive' FROM test, top, (VALUES (1), (3), (5)) v(k) WHERE r <= k UNION ALL SELECT 'top' || k || '_majority', row_no, aspect, polarity FROM test, top JOIN maj USING (aspect), (VALUES (1), (3), (5)) v(k) WHERE r <= k),
names AS (SELECT unnest({_BASE}) baseline), n AS (SELECT baseline, row_no, (SELECT 1) one, coalesce(np, 0) n_pred, coalesce(ng, 0) n_gold, coalesce(nk, 0) n_ok FROM names CROSS JOIN test LEFT JOIN (SELECT row_no, count(*) ng FROM g GROUP BY 1) USING (row_no) LEFT JOIN (SELECT b baseline, pred.row_no, count(*) np, count(g.aspect) nk FROM pred LEFT JOIN g ON g.row_no = pred.row_no AND g.aspect = pred.aspect AND g.polarity = pred.polarity GROUP BY 1, 2) USING (baseline, row_no)),
s AS (SELECT baseline, count(*) examples, sum(n_pred)::BIGINT n_pred, sum(n_gold)::BIGINT n_gold, sum(n_ok)::BIGINT n_ok, round(avg({_M[2]}), 4) f1_macro, round({_U[2]}, 4) f1_micro FROM n GROUP BY 1) SELECT *, row_number() OVER (ORDER BY f1_macro DESC, baseline) AS \"rank\" FROM s""")
def q_baselines(spark, d):
    rows = _t(spark, d, "dataset")
    return baselines.ranked(rows.where("split = 'train'"), rows.where("split = 'devel'"), "gold", "row_no")


# --- text ------------------------------------------------------------------------------------------------------------

_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_NORM = f"lower(regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g'))"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_WORD}'))::INT words FROM documents")
def q_word_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(f"SELECT md5({_NORM}) norm, count(*) n, min(doc_id) first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q_normalize_dedup(spark, d):
    rows = _t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("norm"))
    return rows.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_UNTIDY = "SELECT id, accepted_at, text FROM synthetic_v1 UNION ALL SELECT 'copy-' || row_no, received_at, '  ' || replace(text, ' ', '   ') || chr(10) FROM dataset WHERE split <> 'train'"


@query(f"SELECT id, accepted_at FROM ({_UNTIDY}) WHERE {_NORM} IN (SELECT {_NORM} FROM dataset WHERE text IS NOT NULL AND split = 'train')")
def q_exact_duplicates(spark, d):
    rows = _t(spark, d, "dataset")
    spaced = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("   ")), F.lit("\n"))
    copies = rows.where("split <> 'train'").select(F.concat(F.lit("copy-"), F.col("row_no").cast("string")).alias("id"), F.col("received_at").alias("accepted_at"), spaced.alias("text"))
    candidates = _t(spark, d, "synthetic_v1").select("id", "accepted_at", "text").unionByName(copies)
    return augment.duplicate_of(candidates, rows.where("split = 'train'"), "text").select("id", "accepted_at")


def _grams(df, key):
    return df.select(key, text.ngrams(F.col("text")).alias("grams"))


_G5 = f"SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) i FROM (SELECT KEY id, regexp_extract_all({_NORM}, '{_WORD}') w FROM TABLE_))"


@query(f"""WITH c AS ({_G5.replace('KEY', 'plan_key').replace('TABLE_', '(SELECT row_number() OVER (ORDER BY id, accepted_at) plan_key, text FROM synthetic_v1)')}), r AS ({_G5.replace('KEY', 'doc_id').replace('TABLE_', 'documents')}),
cn AS (SELECT id, count(*) n FROM c GROUP BY 1), rn AS (SELECT id, count(*) n FROM r GROUP BY 1),
s AS (SELECT c.id, max(both_ / (cn.n + rn.n - both_)) m FROM (SELECT c.id, r.id rid, count(*)::DOUBLE both_ FROM c JOIN r USING (g) GROUP BY 1, 2) c JOIN cn ON cn.id = c.id JOIN rn ON rn.id = c.rid GROUP BY 1)
SELECT plan_key, round(coalesce(m, 0), 4) max_sim FROM (SELECT row_number() OVER (ORDER BY id, accepted_at) plan_key FROM synthetic_v1) LEFT JOIN s ON s.id = plan_key""")
def q_ngram_max_similarity(spark, d):
    rows = global_rank(_t(spark, d, "synthetic_v1").select("id", "accepted_at", "text"), ["id", "accepted_at"], "plan_key")
    found = augment.max_similarity(rows, _t(spark, d, "documents"), "plan_key", "text")
    return found.select("plan_key", F.round("max_sim", 4).alias("max_sim"))


@query()
def q_reference_similarity(spark, d):
    """The reference's comparison, with the train and devel reviews; q_ngram_max_similarity and its SQL take documents."""
    rows = global_rank(_t(spark, d, "synthetic_v1").select("id", "accepted_at", "text"), ["id", "accepted_at"], "plan_key")
    found = augment.max_similarity(rows, _t(spark, d, "dataset").where("split in ('train', 'devel')"), "plan_key", "text")
    return found.select("plan_key", F.round("max_sim", 4).alias("max_sim"))


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{m}')" for m in schema.TASK_MARKERS) + " AS leaked, " + " OR ".join("contains(text, {})".format("'" + m.replace("\n", "' || chr(10) || '") + "'") for m in schema.MARKUP) + " AS markup FROM documents")
def q_markers(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.contains_any(F.lower("text"), schema.TASK_MARKERS).alias("leaked"), text.contains_any(F.col("text"), schema.MARKUP).alias("markup"))


@query(f"""WITH t AS (SELECT gen_id, {_NORM} n, regexp_extract_all(lower(raw_generation), '«([^»]*)»', 1)[1] q FROM thinking_sanity),
u AS (SELECT *, list_filter(regexp_extract_all({_NORM.replace('(text,', '(q,')}, '{_WORD}'), lambda w: length(w) > 2) l, {_NORM.replace('(text,', '(q,')} s FROM t)
SELECT gen_id, CASE WHEN coalesce(s, '') = '' THEN false ELSE contains(n, s) OR (len(l) > 0 AND len(list_filter(l, lambda w: contains(n, w))) >= 0.8 * len(l)) END supported FROM u WHERE n IS NOT NULL""")
def q_span_support(spark, d):
    span = F.try_element_at(F.regexp_extract_all(F.lower("raw_generation"), F.lit("«([^»]*)»"), 1), F.lit(1))
    return _t(spark, d, "thinking_sanity").where("text is not null").select("gen_id", text.span_supported(span, F.col("text")).alias("supported"))


@query(f"SELECT doc_id, substr(regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g'), 1, 120) preview FROM documents")
def q_preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 120).alias("preview"))


_CUES = {"food_quality": ["sopa", "pan", "fresh"], "service": ["camarero", "waiter", "pan"], "location": ["calle", "bridge"]}


@query("WITH c(aspect, cue) AS (VALUES " + ", ".join(f"('{a}', '{c}')" for a, cs in _CUES.items() for c in cs) + ") SELECT aspect, cue, count(*) n FROM documents JOIN c ON contains(lower(text), cue) GROUP BY 1, 2")
def q_cue_hits(spark, d):
    cues = spark.createDataFrame([(a, c) for a, cs in _CUES.items() for c in cs], "aspect string, cue string")
    # a lexicon is a small parameter: each text is matched against it where it is read
    rows = [tuple(r) for r in cues.collect()]
    hits = F.filter(F.array(*(F.struct(F.lit(a).alias("aspect"), F.lit(c).alias("cue")) for a, c in rows)), lambda x: F.contains(F.lower("text"), x["cue"]))
    return _t(spark, d, "documents").select(F.explode(hits).alias("x")).groupBy("x.aspect", "x.cue").agg(F.count(F.lit(1)).alias("n"))


_PLAIN = f"regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g')"
_REASON = f"""WITH pl AS (SELECT plan_id, arg_min(struct_pack(l := "language", a := min_words, b := max_words, t := target_gold), planned_at) p FROM generation_plan GROUP BY 1),
c AS (SELECT id, accepted_at, bucket, text, "language", gold, {_PLAIN} x, p FROM synthetic_v1 JOIN pl USING (plan_id)),
r AS (SELECT id, accepted_at, bucket, CASE WHEN NOT coalesce("language" = p.l, false) THEN 'language mismatch' WHEN coalesce(x, '') = '' THEN 'empty text'
WHEN {" OR ".join(f"contains(lower(x), '{m}')" for m in schema.TASK_MARKERS)} THEN 'annotation language leaked'
WHEN contains(x, '```') OR contains(x, '{{') OR contains(x, '}}') THEN 'markup leaked'
WHEN len(regexp_extract_all(x, '{_WORD}')) NOT BETWEEN p.a AND p.b THEN 'word count outside range'
WHEN list_sort(coalesce(map_entries(gold), [])) <> list_sort(coalesce(map_entries(p.t), [])) THEN 'gold mismatch' END reason FROM c)"""


def _reasons(spark, d):
    plans = _t(spark, d, "generation_plan").groupBy("plan_id").agg(F.min_by(F.struct(F.col("language").alias("l"), F.col("min_words").alias("a"), F.col("max_words").alias("b"), F.col("target_gold").alias("t")), "planned_at").alias("p"))
    rows = _t(spark, d, "synthetic_v1").join(plans, "plan_id")
    return rows.select("id", "accepted_at", "bucket", augment.reject_reason(F.col("text"), F.col("language"), F.col("p.l"), F.col("p.a"), F.col("p.b"), F.col("gold"), F.col("p.t")).alias("reason"))


@query(f"{_REASON} SELECT id, accepted_at, reason FROM r")
def q_validate_reasons(spark, d):
    return _reasons(spark, d).select("id", "accepted_at", "reason")


@query(f"{_REASON} SELECT reason, count(*) n FROM r WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 30")
def q_reject_report(spark, d):
    return _reasons(spark, d).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(30)


def _hashed(t):
    """The n-grams as 64-bit hashes, a quarter of their size."""
    return F.transform(text.ngrams(t), lambda g: F.xxhash64(g))


def _whole_reasons(spark, d):
    """A candidate is an id; rows delivered again have the reason of the first. Candidates follow each other by time and id."""
    rows = _t(spark, d, "synthetic_v1").select("id", "accepted_at", "text")
    firsts = _reasons(spark, d).groupBy("id").agg(F.min_by(F.struct("accepted_at", "bucket", "reason"), "accepted_at").alias("f")).select("id", "f.*")
    texts = rows.groupBy("id").agg(F.min_by("text", "accepted_at").alias("text"))
    ordered = global_rank(firsts.join(texts, "id"), ["accepted_at", "id"], "place").withColumn("grams", _hashed(F.col("text")))
    reference = _t(spark, d, "dataset").where("split in ('train', 'devel')").select("row_no", "text", _hashed(F.col("text")).alias("grams"))
    ordered = cut(ordered)
    told = augment.reject_reason_in_order(ordered, reference, "place", "row_no", "reason", "text", "grams")
    return _reasons(spark, d).select("id", "accepted_at").join(ordered.select("id", "place"), "id").join(told, "place").select("id", "accepted_at", "reason")


@query()
def q_candidate_reasons(spark, d):
    """All rules of the reference in order but that of the support spans, which synthetic_v1 doesn't have."""
    return _whole_reasons(spark, d)


@query()
def q_candidate_report(spark, d):
    return _whole_reasons(spark, d).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(30)


# --- difficulty, plans, samples --------------------------------------------------------------------------------------

_PRIO = "CASE aspect " + " ".join(f"WHEN '{a}' THEN {w}" for a, w in schema.PRIORITY_WEIGHTS.items()) + " ELSE 0 END"
_DIFF = f"""{_TS}, pc AS (SELECT aspect, gold, count(*) c FROM ge GROUP BY 1, 2), bonus AS (SELECT gen_id, sum(greatest(0, 2.0 - ln(1 + c)) + 0.3 * {_PRIO}) b FROM ge JOIN pc USING (aspect, gold) GROUP BY 1),
er AS (SELECT gen_id, count_if(pred IS NULL) missing, count_if(gold <> pred) wrong, count_if(gold IS NULL) extra FROM al GROUP BY 1),
df AS (SELECT t.gen_id, coalesce(missing, 0)::INT missing, coalesce(wrong, 0)::INT wrong, coalesce(extra, 0)::INT extra, round(2.0 * coalesce(missing, 0) + 1.5 * coalesce(wrong, 0) + coalesce(extra, 0) + coalesce(b, 0)::DOUBLE, 4)::DOUBLE score FROM t LEFT JOIN er USING (gen_id) LEFT JOIN bonus USING (gen_id))"""


@query(f"{_DIFF} SELECT * FROM df")
def q_difficulty(spark, d):
    return augment.difficulty(_t(spark, d, "thinking_sanity"), "gen_id", "prediction", "gold")


@query(f"{_DS}, pc AS (SELECT aspect, polarity, count(*) c FROM e GROUP BY 1, 2), s AS (SELECT row_no, sum(greatest(0, 2.5 - ln(1 + c)) + {_PRIO} + (polarity IN ('neutral', 'conflict'))::INT) b FROM e JOIN pc USING (aspect, polarity) GROUP BY 1) SELECT row_no, round(coalesce(b, 0)::DOUBLE, 4) score FROM dataset LEFT JOIN s USING (row_no)")
def q_difficulty_fallback(spark, d):
    return augment.difficulty_without_predictions(_t(spark, d, "dataset"), "row_no", "gold")


@query(f"{_DIFF} SELECT df.*, missing + wrong + extra errors, len(g)::INT labels FROM df JOIN t USING (gen_id) WHERE missing + wrong + extra > 0 ORDER BY errors DESC, score DESC, labels DESC, gen_id LIMIT 30")
def q_hardest(spark, d):
    rows = _t(spark, d, "thinking_sanity")
    scored = augment.difficulty(rows, "gen_id", "prediction", "gold").join(rows.select("gen_id", F.greatest(F.coalesce(F.size("gold"), F.lit(0)), F.lit(0)).alias("_l")), "gen_id")
    return augment.hardest(scored, F.col("_l")).drop("_l")


@query("SELECT bucket, id, accepted_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY accepted_at, id)::INT seq FROM synthetic_v1) WHERE seq <= CASE bucket " + " ".join(f"WHEN '{b}' THEN {q}" for b, q in schema.BUCKET_QUOTAS.items()) + " END")
def q_quota_trim(spark, d):
    return augment.within_quota(_t(spark, d, "synthetic_v1"), "bucket", ["accepted_at", "id"]).select("bucket", "id", "accepted_at", "seq")


@query("WITH q(bucket, quota) AS (VALUES " + ", ".join(f"('{b}', {q})" for b, q in schema.BUCKET_QUOTAS.items()) + ") SELECT bucket, quota::INT quota, coalesce(have, 0)::BIGINT have, greatest(quota - coalesce(have, 0), 0)::BIGINT missing, ceil(greatest(quota - coalesce(have, 0), 0) * 1.5)::BIGINT plans FROM q LEFT JOIN (SELECT bucket, count(*) have FROM synthetic_v1 GROUP BY 1) USING (bucket)")
def q_plan_shortfall(spark, d):
    return augment.shortfall(_t(spark, d, "synthetic_v1"), "bucket").withColumn("plans", F.col("plans").cast("long"))


@query("SELECT bucket, \"language\", coalesce(cardinality(target_gold), 0)::INT labels, count(*) n FROM generation_plan GROUP BY GROUPING SETS ((1), (2), (3))")
def q_plan_report(spark, d):
    rows = _t(spark, d, "generation_plan").select("bucket", "language", F.greatest(F.coalesce(F.size("target_gold"), F.lit(0)), F.lit(0)).alias("labels"))
    return rows.groupingSets([[F.col("bucket")], [F.col("language")], [F.col("labels")]], "bucket", "language", "labels").agg(F.count(F.lit(1)).alias("n"))


def _u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


@query(f"SELECT doc_id FROM documents ORDER BY -ln(greatest({_u(chr(39) + '7' + chr(39), 'doc_id::VARCHAR')}, 1e-12)) / greatest(n_chars, 0.001), doc_id LIMIT 50")
def q_weighted_sample(spark, d):
    return augment.weighted_sample(_t(spark, d, "documents"), "doc_id", F.col("n_chars"), 50, 7).select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id::VARCHAR)), doc_id)::INT AS \"position\" FROM documents")
def q_shuffle(spark, d):
    return augment.shuffled(_t(spark, d, "documents"), "doc_id", 42).select("doc_id", F.col("position").cast("int").alias("position"))


@query("SELECT round_even(count(*) * 0.675, 0)::BIGINT first_language, (count(*) - round_even(count(*) * 0.675, 0))::BIGINT second_language FROM synthetic_v1")
def q_language_sequence(spark, d):
    n = F.count(F.lit(1))
    first = F.bround(n * 0.675, 0).cast("long")
    return _t(spark, d, "synthetic_v1").agg(first.alias("first_language"), (n - first).alias("second_language"))


@query("SELECT id, accepted_at, 'synth_v1_' || lpad(row_number() OVER (ORDER BY accepted_at, id)::VARCHAR, greatest(4, length(row_number() OVER (ORDER BY accepted_at, id)::VARCHAR))::INT, '0') new_id FROM synthetic_v1")
def q_synth_ids(spark, d):
    return augment.numbered(_t(spark, d, "synthetic_v1"), ["accepted_at", "id"]).select("id", "accepted_at", "new_id")


@query("SELECT l_orderkey * 1 id, 1 side FROM lineitem WHERE false UNION ALL SELECT row_number() OVER (ORDER BY side, k) - 1 id, side FROM (SELECT 0 side, row_no k FROM dataset WHERE split = 'train' UNION ALL SELECT 1, row_number() OVER (ORDER BY id, accepted_at) FROM synthetic_v1)")
def q_concatenate(spark, d):
    first = _t(spark, d, "dataset").where("split = 'train'").select(F.lit(0).alias("side"), F.col("row_no").cast("long").alias("k"))
    second = global_rank(_t(spark, d, "synthetic_v1").select("id", "accepted_at"), ["id", "accepted_at"], "k").select(F.lit(1).alias("side"), "k")
    return global_rank(first.unionByName(second), ["side", "k"], "place").select((F.col("place") - 1).alias("id"), "side")


@query()
def q_greedy_acceptance(spark, d):
    rows = _t(spark, d, "synthetic_v1").dropDuplicates(["id"])
    return augment.accept_greedily(rows.select("id", _hashed(F.col("text")).alias("grams")), "id", "grams")


@query()
def q_style_seeds(spark, d):
    plans = _t(spark, d, "generation_plan").groupBy("plan_id").agg(F.min_by(F.struct(F.col("language").alias("l"), F.col("target_gold").alias("t")), "planned_at").alias("p")).select("plan_id", F.col("p.l").alias("language"), F.coalesce("p.t", F.create_map().cast("map<string,string>")).alias("target"))
    pool = _t(spark, d, "dataset").where("split = 'train'").select(F.col("row_no").cast("string").alias("key"), "language", F.coalesce("gold", F.create_map().cast("map<string,string>")).alias("gold"), F.greatest(F.coalesce(F.size("gold"), F.lit(0)), F.lit(0)).cast("double").alias("score"))
    return augment.style_seeds(plans, pool, "plan_id", "key", fallback=True)


# --- retrieval -------------------------------------------------------------------------------------------------------

_DOT = "list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))"
_NEAR = f"""SELECT a.vec_id query_id, b.vec_id vec_id, round({_DOT}, 6) sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id)::INT AS "rank" FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"""


def _near(spark, d, k):
    e = _t(spark, d, "embeddings")
    return retrieval.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", k)


@query(f'SELECT * FROM ({_NEAR}) WHERE "rank" <= 8')
def q_dense_topk(spark, d):
    return _near(spark, d, 8)


@query(f"""SELECT vec_id, row_number() OVER (ORDER BY turn, label, u)::INT AS "rank" FROM (SELECT vec_id, label, {_u("'42'", 'vec_id::VARCHAR')} u, row_number() OVER (PARTITION BY label ORDER BY {_u("'42'", 'vec_id::VARCHAR')}, vec_id) turn FROM embeddings) WHERE turn <= 12 ORDER BY 2 LIMIT 12""")
def q_random_fixed(spark, d):
    return retrieval.random_fixed(_t(spark, d, "embeddings"), "vec_id", 12, 42, "label")


@query(f"""WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY {_u("'42'", 'vec_id::VARCHAR')}, vec_id) i FROM embeddings), c AS (SELECT count(*) c FROM embeddings), w AS (SELECT vec_id q, j, (floor({_u("'42q'", 'vec_id::VARCHAR')} * c)::BIGINT + j) % c + 1 i FROM embeddings, c, range(0, 6) t(j) WHERE vec_id % 20 = 0),
r AS (SELECT q query_id, n.vec_id, row_number() OVER (PARTITION BY q ORDER BY j)::INT AS "rank" FROM w JOIN n USING (i) WHERE q <> n.vec_id) SELECT * FROM r WHERE "rank" <= 5""")
def q_random_dynamic(spark, d):
    e = _t(spark, d, "embeddings")
    return retrieval.random_dynamic(e.where("vec_id % 20 = 0"), e, "vec_id", 5, 42)


_BANK = "SELECT vec_id, row_number() OVER (ORDER BY label, vec_id)::INT AS \"rank\" FROM (SELECT label, min(vec_id) vec_id FROM embeddings GROUP BY 1)"


def _bank(spark, d):
    firsts = _t(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return firsts.select("vec_id", F.row_number().over(Window.orderBy("label", "vec_id")).alias("rank"))


@query(f'SELECT * FROM ({_BANK}) WHERE "rank" <= 4')
def q_hard_bank(spark, d):
    return retrieval.bank(_bank(spark, d), 4)


def _candidates(spark, d, prefilter):
    """Nearest rows with what the base score needs; the text, language and labels of a vector are those of the document of its number."""
    e = _t(spark, d, "embeddings").select("vec_id", "embedding", "label")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "text", F.coalesce("n_chars", F.lit(0)).alias("n"))
    full = e.join(docs, "vec_id", "left")
    near = _near(spark, d, prefilter).withColumnRenamed("vec_id", "cand")
    c = full.select(F.col("vec_id").alias("cand"), F.col("lang").alias("cl"), F.col("text").alias("ct"), F.coalesce("n", F.lit(0)).alias("cn"), F.col("label").alias("clabel"), F.col("embedding").alias("vec"))
    q = full.select(F.col("vec_id").alias("query_id"), F.col("lang").alias("ql"), F.coalesce("n", F.lit(0)).alias("qn"), F.col("label").alias("qlabel"))
    cues = F.array(*(F.lit(x) for cs in _CUES.values() for x in cs))
    return near.join(c, "cand").join(q, "query_id").select(
        "query_id", "cand", "sim", F.coalesce(F.col("cl") == F.col("ql"), F.lit(False)).alias("same_language"), F.coalesce(retrieval.cue_coverage(F.col("ct"), cues), F.lit(0.0)).alias("cues"),
        (F.col("clabel") % 2).cast("double").alias("hard"), arith.shape_fit(F.col("qn"), F.col("cn"), F.col("qlabel"), F.col("clabel")).alias("fit"), "vec",
    )


@query()
def q_mmr_code(spark, d):
    return retrieval.mmr(_candidates(spark, d, 200), 8)


@query()
def q_mmr_doc(spark, d):
    return retrieval.mmr(_candidates(spark, d, 50), 8, normalise=True)


@query()
def q_hard_mix(spark, d):
    e = _t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    # a bank is a list of a few examples
    own = e.join(F.broadcast(retrieval.bank(_bank(spark, d), 4).select(F.col("vec_id").alias("cand"), "rank"))).where("query_id <> cand")
    return retrieval.hard_mix(own, retrieval.mmr(_candidates(spark, d, 200), 8), 8)


@query(f'SELECT vec_id cand, count(*) uses, round(avg(sim), 4) mean_sim FROM ({_NEAR}) WHERE "rank" <= 8 GROUP BY 1 ORDER BY uses DESC, cand LIMIT 10')
def q_selection_stats(spark, d):
    return retrieval.selection_stats(_near(spark, d, 8).withColumnRenamed("vec_id", "cand"))


# --- parsing ---------------------------------------------------------------------------------------------------------


@query()
def q_parse_generation(spark, d):
    return _t(spark, d, "thinking_sanity").select("gen_id", parse.extract_labels("raw_generation").alias("m")).select("gen_id", F.explode("m").alias("aspect", "polarity"))


@query("SELECT gen_id, e.key aspect, e.value polarity FROM (SELECT gen_id, unnest(map_entries(prediction)) e FROM thinking_sanity)")
def q_parse_roundtrip(spark, d):
    made = _t(spark, d, "thinking_sanity").select("gen_id", F.concat(F.lit("<think>a {b</think>So: ```json\n"), text.canonical_json(F.col("prediction")), F.lit("\n```")).alias("t"))
    return made.select("gen_id", F.explode(parse.extract_labels("t")).alias("aspect", "polarity"))


@query()
def q_parse_success(spark, d):
    rows = _t(spark, d, "thinking_sanity").select(parse.extract_labels("raw_generation").alias("m"), "prediction")
    return rows.agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.size("m") > 0).alias("with_labels"), F.count_if(metrics.same_map(F.col("m"), F.col("prediction"))).alias("as_recorded"))


@query("SELECT gen_id, '.' || e.key || ':' || e.value leaf FROM (SELECT gen_id, unnest(map_entries(gold)) e FROM thinking_sanity)")
def q_flatten_map(spark, d):
    return _t(spark, d, "thinking_sanity").select("gen_id", F.explode(parse.flatten_map(F.col("gold"))).alias("leaf"))


@query("SELECT event_id, '.k:' || (props->>'k') leaf FROM events WHERE props->>'k' IS NOT NULL")
def q_flatten_json(spark, d):
    return _t(spark, d, "events").select("event_id", F.explode(parse.flatten_json("props")).alias("leaf"))


@query("SELECT gen_id, '{' || coalesce(list_aggregate(list_transform(list_sort(map_entries(gold)), lambda e: '\"' || e.key || '\":\"' || e.value || '\"'), 'string_agg', ','), '') || '}' canonical FROM thinking_sanity WHERE gold IS NOT NULL")
def q_canonical_json(spark, d):
    return _t(spark, d, "thinking_sanity").where("gold is not null").select("gen_id", text.canonical_json(F.col("gold")).alias("canonical"))


@query("SELECT gen_id, e.key aspect, e.value polarity FROM (SELECT gen_id, unnest(map_entries(gold)) e FROM thinking_sanity)")
def q_normalize_labels(spark, d):
    untidy = F.transform_keys("gold", lambda k, v: F.concat(F.lit(" "), F.upper(F.replace(k, F.lit("_"), F.lit("-")))))
    rows = _t(spark, d, "thinking_sanity").select("gen_id", F.transform_values(untidy, lambda k, v: F.concat(F.initcap(v), F.lit(" "))).alias("m"))
    return rows.select("gen_id", F.explode(parse.normalize_labels(F.col("m"))).alias("aspect", "polarity"))


@query("SELECT l_orderkey, max(r) reason FROM (SELECT l_orderkey, CASE WHEN count(DISTINCT l_partkey % 12) < count(*) THEN 'duplicate aspect' END r, bool_or(l_partkey % 12 = 11) bad FROM lineitem GROUP BY 1) WHERE NOT bad GROUP BY 1 UNION ALL SELECT l_orderkey, 'invalid aspect' FROM lineitem GROUP BY 1 HAVING bool_or(l_partkey % 12 = 11)")
def q_strict_items(spark, d):
    names = F.array(*map(F.lit, [*schema.ASPECTS, "weather"]))
    item = F.struct(names[(F.col("l_partkey") % 12).cast("int")].alias("aspect"), F.lit("positive").alias("polarity"))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items")).select("l_orderkey", parse.gold_items_reason(F.col("items")).alias("reason"))


@query("SELECT gen_id, string_split(raw_generation, '</think>')[-1] final, contains(raw_generation, '</think>') closed FROM thinking_sanity")
def q_thinking_split(spark, d):
    return _t(spark, d, "thinking_sanity").select("gen_id", text.strip_thinking(F.col("raw_generation")).alias("final"), F.contains("raw_generation", F.lit("</think>")).alias("closed"))


@query()
def q_first_object(spark, d):
    return _t(spark, d, "thinking_sanity").select("gen_id", F.explode(parse.extract_entities("raw_generation")).alias("type", "names"))


# --- experiments -----------------------------------------------------------------------------------------------------


@query("SELECT t temperature, p top_p, k top_k FROM (VALUES (0.5::DOUBLE), (0.65), (0.8), (0.85), (1.0), (1.15)) a(t), (VALUES (0.75::DOUBLE), (1.0)) b(p), (VALUES (20.0::DOUBLE), (40.0)) c(k)")
def q_grid(spark, d):
    return experiments.grid(spark, {"temperature": [0.65, 1.0], "top_p": [0.75, 1.0], "top_k": [20, 40]}, {"temperature": 0.15})


@query("SELECT label, s seed FROM (SELECT DISTINCT label FROM embeddings), (VALUES (1::BIGINT), (2), (3), (4)) v(s)")
def q_config_seed_matrix(spark, d):
    return experiments.matrix(_t(spark, d, "embeddings").select("label").distinct(), spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "seed long"))


_RUNS = "WITH runs AS (SELECT user_id name, round(avg(value), 4) f1_micro, round(min(value), 4) f1_macro, round(max(value), 4) AS \"precision\", count(*) k FROM events GROUP BY 1)"


def _runs(spark, d):
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.round(F.avg("value"), 4).alias("f1_micro"), F.round(F.min("value"), 4).alias("f1_macro"), F.round(F.max("value"), 4).alias("precision"), F.count(F.lit(1)).alias("k"))


@query(f"{_RUNS} SELECT *, row_number() OVER (ORDER BY round_even(f1_micro, 2) DESC, name)::INT AS \"rank\" FROM runs")
def q_sweep_rank(spark, d):
    return experiments.ranked(_runs(spark, d), [(F.col("f1_micro"), True)], "name", 2)


@query(f"{_RUNS} SELECT *, row_number() OVER (ORDER BY f1_micro DESC, f1_macro DESC, \"precision\" DESC, name)::INT AS \"rank\" FROM runs")
def q_run_rank(spark, d):
    return experiments.ranked(_runs(spark, d), [(F.col(c), True) for c in ("f1_micro", "f1_macro", "precision")], "name")


@query(f"{_RUNS}, s AS (SELECT *, round(0.75 * f1_micro + 0.25 * f1_macro, 6) score FROM runs) SELECT *, row_number() OVER (ORDER BY score DESC, name)::INT AS \"rank\" FROM s")
def q_trial_rank(spark, d):
    return experiments.trial_ranking(_runs(spark, d), "name")


@query(f"{_RUNS}, b AS (SELECT name, f1_micro FROM runs ORDER BY f1_micro DESC, name DESC LIMIT 1), z AS (SELECT name, f1_micro FROM runs WHERE name = 1) SELECT CASE WHEN b.f1_micro < z.f1_micro + 1000 THEN z.name ELSE b.name END name, CASE WHEN b.f1_micro < z.f1_micro + 1000 THEN z.f1_micro ELSE b.f1_micro END f1_micro, b.f1_micro < z.f1_micro + 1000 OR b.name = 1 is_base FROM b, z")
def q_conservative_choice(spark, d):
    return experiments.conservative_choice(_runs(spark, d).withColumn("name", F.col("name")), "name", "f1_micro", 1, 1000.0)


@query("SELECT event_type config, count(*) n, " + ", ".join(f"round({f}(value), 4) value_{n}" for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))) + " FROM events WHERE user_id <> 0 GROUP BY 1")
def q_seed_stability(spark, d):
    return experiments.seed_stability(_t(spark, d, "events").withColumnRenamed("event_type", "config"), "config", ["value"], F.col("user_id") == 0)


@query(f"{_RUNS} SELECT * FROM runs WHERE f1_micro >= (SELECT max(f1_micro) FROM runs) - 0.5 ORDER BY f1_macro DESC, \"precision\" DESC, k, name LIMIT 1")
def q_decision_rule(spark, d):
    return experiments.decide(_runs(spark, d), "name")


@query("""SELECT event_type, event_id, "value", length(props) AS "second", max("value") OVER w best_first, first_value(event_id) OVER (PARTITION BY event_type, g ORDER BY event_id) best_step, event_id = first_value(event_id) OVER (PARTITION BY event_type, g ORDER BY event_id) improved
FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY event_id) g FROM (SELECT *, CASE WHEN (round("value" / 1e-9), round(length(props) / 1e-9)) > coalesce(lag(m) OVER (PARTITION BY event_type ORDER BY event_id), (-1e300, -1e300)) THEN 1 ELSE 0 END new FROM (SELECT *, max((round("value" / 1e-9), round(length(props) / 1e-9))) OVER (PARTITION BY event_type ORDER BY event_id) m FROM events)))
WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def q_running_best(spark, d):
    rows = _t(spark, d, "events").select("event_type", "event_id", "value", F.length("props").alias("second"))
    return experiments.running_best(rows, "event_type", "event_id", "value", "second")


@query("SELECT user_id * 100 + event_id % 50 name FROM events GROUP BY 1 HAVING count_if(event_type = 'purchase') = 0")
def q_resume(spark, d):
    e = _t(spark, d, "events").withColumn("name", F.col("user_id") * 100 + F.col("event_id") % 50)
    return experiments.to_do(e.select("name").distinct(), e.where("event_type = 'purchase'").select("name").distinct(), "name")


@query("WITH r AS (SELECT event_type, user_id, round(avg(value), 4) score FROM events GROUP BY 1, 2) SELECT r.*, b.score baseline, r.score - b.score delta, b.score IS NULL missing FROM r LEFT JOIN (SELECT * FROM r WHERE user_id = 0 AND event_type <> 'view') b USING (event_type)")
def q_baseline_lookup(spark, d):
    runs = _t(spark, d, "events").groupBy("event_type", "user_id").agg(arith.rounded(F.avg("value"), 4).alias("score"))
    return experiments.beside_baseline(runs, runs.where("user_id = 0 and event_type <> 'view'"), ["event_type"], "score")


@query("SELECT position, row_no, doc_id FROM (SELECT row_no, row_number() OVER (ORDER BY row_no) - 1 position FROM dataset) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 position FROM documents) USING (position)")
def q_zip_join(spark, d):
    return experiments.zipped(_t(spark, d, "dataset").select("row_no"), "row_no", _t(spark, d, "documents").select("doc_id"), "doc_id")


@query('SELECT "language", count(*) examples, round(sum(coalesce(thinking_metadata.elapsed_sec, 0)) / count(*), 4) per_example FROM thinking_sanity GROUP BY 1')
def q_seconds_per_example(spark, d):
    return experiments.seconds_per_example(_t(spark, d, "thinking_sanity"), F.col("thinking_metadata.elapsed_sec"), "language")


@query(f'{_RUNS} SELECT *, row_number() OVER (ORDER BY k, f1_micro, name)::INT AS "rank" FROM runs')
def q_grouped_rank(spark, d):
    return experiments.ranked(_runs(spark, d), [(F.col("k"), False), (F.col("f1_micro"), False)], "name")


@query("SELECT gen_id, e.key aspect, e.value polarity FROM (SELECT gen_id, unnest(map_entries(coalesce(CASE WHEN thinking_metadata.closed_thinking THEN prediction END, gold))) e FROM thinking_sanity)")
def q_resolved_predictions(spark, d):
    normalized = F.when(F.col("thinking_metadata.closed_thinking"), F.col("prediction"))
    return _t(spark, d, "thinking_sanity").select("gen_id", F.explode(parse.resolved(normalized, F.col("gold"))).alias("aspect", "polarity"))


_LIST = "[" + ", ".join(f"'{a}'" for a in schema.ASPECTS) + "]"


@query(f"SELECT row_no, array_to_string(list_filter({_LIST}, lambda a: NOT coalesce(list_contains(map_keys(gold), a), false)), ',') others FROM dataset")
def q_other_aspects(spark, d):
    return _t(spark, d, "dataset").select("row_no", F.array_join(parse.other_aspects(F.col("gold")), ",").alias("others"))


@query("SELECT row_no, round(CASE WHEN cardinality(gold) > 0 THEN len(list_filter(map_keys(gold), lambda a: a IN (" + ", ".join(f"'{a}'" for a in schema.HARD_ASPECTS) + ")))::DOUBLE / len(map_keys(gold)) ELSE 0 END, 6) hard FROM dataset")
def q_hard_bonus(spark, d):
    return _t(spark, d, "dataset").select("row_no", F.round(arith.share_in(F.map_keys("gold"), schema.HARD_ASPECTS), 6).alias("hard"))


@query("SELECT doc_id, 'Name the places.' || chr(10) || 'TEXT: ' || text AS \"user\" FROM documents")
def q_entity_prompt(spark, d):
    return _t(spark, d, "documents").select("doc_id", features.entity_prompt(F.lit("Name the places."), F.col("text")).alias("user"))


@query("WITH n AS (SELECT count(*) n FROM documents), p AS (SELECT DISTINCT round_even(i * (n - 1) / 36.0, 0)::BIGINT p FROM n, range(0, 37) t(i)) SELECT doc_id, p::INT AS \"position\" FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 p FROM documents) JOIN p USING (p)")
def q_spaced_sample(spark, d):
    return experiments.spaced(_t(spark, d, "documents"), "doc_id", 0, 37).select("doc_id", F.col("position").cast("int").alias("position"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS \"position\" FROM documents ORDER BY doc_id LIMIT 25 OFFSET 100")
def q_slice(spark, d):
    return experiments.window_of(_t(spark, d, "documents"), "doc_id", 100, 25).select("doc_id", F.col("position").cast("int").alias("position"))


@query("(SELECT 'middle' which, doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM documents)) UNION ALL (SELECT 'longest', doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1)")
def q_middle_and_longest(spark, d):
    return experiments.middle_and_longest(_t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query(f"{_TS} SELECT gen_id, substr({_PLAIN}, 1, 120) preview FROM n JOIN t USING (gen_id) WHERE NOT same AND n.has ORDER BY gen_id LIMIT 3")
def q_first_mismatches(spark, d):
    rows = _t(spark, d, "thinking_sanity").where(F.col("prediction").isNotNull() & ~metrics.same_map(F.col("prediction"), F.col("gold")))
    return rows.select("gen_id", text.preview(F.col("text"), 120).alias("preview")).orderBy("gen_id").limit(3)


# --- features --------------------------------------------------------------------------------------------------------

_SYS, _USR = "Find opinions on {aspects}.", "[{language}] {text}"


@query(f"SELECT doc_id, 'Find opinions on {', '.join(schema.ASPECTS)}.' system, replace(replace('{_USR}', '{{text}}', text), '{{language}}', coalesce(lang, 'unknown')) AS \"user\" FROM documents")
def q_messages(spark, d):
    m = features.messages(_SYS, _USR, F.col("text"), F.col("lang"))
    return _t(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"))


@query("SELECT gen_id, 4::INT n, text q, CASE WHEN gold IS NULL THEN NULL ELSE '{' || coalesce(list_aggregate(list_transform(list_sort(map_entries(gold)), lambda e: '\"' || e.key || '\":\"' || e.value || '\"'), 'string_agg', ','), '') || '}' END a FROM thinking_sanity")
def q_fewshot_messages(spark, d):
    m = features.fewshot_messages(F.lit("s"), F.array(F.struct("text", "gold")), F.col("text"))
    return _t(spark, d, "thinking_sanity").select("gen_id", m.alias("m")).select("gen_id", F.size("m").alias("n"), F.col("m")[1]["content"].alias("q"), F.col("m")[2]["content"].alias("a"))


def _ids(spark, d):
    n = F.greatest(F.floor(F.size("ids") / 2).cast("int"), F.lit(0))
    return _t(spark, d, "documents").where("text is not null").select("doc_id", features.word_ids(F.col("text")).alias("ids")).select("doc_id", "ids", F.slice("ids", 1, n).alias("prompt"))


_IDS = f"WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')) n FROM documents WHERE text IS NOT NULL)"


@query(f"{_IDS} SELECT doc_id, n::INT full_length, least(n, 100)::INT kept, least(n - n // 2, least(n, 100))::INT trainable_tokens, n > 100 truncated FROM t")
def q_sft_mask(spark, d):
    f = _ids(spark, d).select("doc_id", features.sft_feature(F.col("prompt"), F.col("ids"), 100).alias("f"))
    return f.select("doc_id", "f.full_length", F.size("f.input_ids").alias("kept"), "f.trainable_tokens", "f.truncated")


@query(f"{_IDS} SELECT doc_id, 64 length, least(n, 64)::INT attended FROM t")
def q_padded_feature(spark, d):
    f = _ids(spark, d).select("doc_id", features.padded_feature(F.col("ids"), 64, 0).alias("f"))
    return f.select("doc_id", F.size("f.labels").alias("length"), F.aggregate("f.attention_mask", F.lit(0), lambda s, x: s + x).alias("attended"))


@query(f"{_IDS} SELECT doc_id, (n // 2)::INT shared FROM t")
def q_common_prefix(spark, d):
    rows = _ids(spark, d).withColumn("other", F.concat("prompt", F.array(F.lit(-1))))
    return features.common_prefix(rows, "ids", "other").select("doc_id", "shared")
