"""The building blocks one by one: S (sources), P (projections), J (joins), A (aggregates), W (windows),
O (orderings), U (sets), F (functions). Each name starts with the inventory id it shows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands, finance
from ledgerscope.functions.numeric import clip, half_even, mean, rate, ratio, total, value_map
from ledgerscope.operators import economics, gates, panel, ranks, relational as R, warning
from ledgerscope.plans import gate_queries, lever_queries  # noqa: F401  (views)
from ledgerscope.plans import sql as S
from ledgerscope.plans.registry import register
from ledgerscope.sources import scratch, tables
from ledgerscope.sources.views import OUTCOME_DELTA


def one():
    return F.count(F.lit(1))


# ---------------------------------------------------------------- sources and sinks


def _folder(b, name):
    return f"{scratch.folder(b.spark)}/{name}-{uuid.uuid4().hex}"


def _loan_table(b):
    """The loans in their delivered schema (whole amounts, ISO dates, text keys)."""
    whole = lambda c: half_even(c, 0).cast("long").alias(c)
    return b.loans.select(
        F.col("loan_id").cast("string").alias("loan_id"), F.col("customer_id").cast("string").alias("customer_id"),
        F.col("loan_sequence").cast("byte").alias("loan_sequence"), "product_type", whole("ticket_size"), "tenure_mo",
        "interest_rate_apr", "origination_risk_grade", "origination_date", "origination_cohort", "approval_tat_hrs",
        "months_on_book", "loan_status", F.col("default_flag").cast("byte").alias("default_flag"), whole("value_proxy"),
    )


def _csv_loans(b):
    path = _folder(b, "loans_csv")
    tables.write_csv(_loan_table(b), f"{path}/loans.csv")
    return tables.read_table(b.spark, path, "loans", "csv")


def _parquet_loans(b):
    path = _folder(b, "loans_parquet")
    tables.write_parquet(_loan_table(b), f"{path}/loans.parquet")
    return tables.load_tables(b.spark, path, ["loans"])["loans"]


def _loan_summary(df):
    return df.groupBy("product_type", "loan_status").agg(
        one().alias("n"), F.sum("ticket_size").alias("tickets"), F.sum("value_proxy").alias("value"),
        F.sum(F.col("loan_sequence").cast("long")).alias("seq"), F.min("origination_date").cast("string").alias("first_date"),
        F.max("origination_cohort").alias("last_cohort"))


_w = lambda c: f"CAST(round_even(CAST({c} AS DOUBLE), 0) AS BIGINT)"
_summary_sql = f"""SELECT product_type, loan_status, count(*) AS n, CAST(sum({_w('ticket_size')}) AS BIGINT) AS tickets, CAST(sum({_w('value_proxy')}) AS BIGINT) AS value,
  CAST(sum(loan_sequence) AS BIGINT) AS seq, CAST(min(origination_date) AS VARCHAR) AS first_date, max(origination_cohort) AS last_cohort FROM loans GROUP BY 1, 2"""
register(
    "s01_s03_pruned_parquet_scan", lambda b: tables.read_parquet(b.spark, f"{b.folder}/lineitem.parquet", ["l_orderkey", "l_returnflag"])
    .filter(F.col("l_returnflag") == "R").groupBy((F.col("l_orderkey") % 17).alias("part")).agg(one().alias("n")),
    "", "SELECT l_orderkey % 17 AS part, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
)
register("s02_s06_csv_round_trip", lambda b: _loan_summary(_csv_loans(b)), "loans", _summary_sql)
register("s04_s05_parquet_round_trip", lambda b: _loan_summary(_parquet_loans(b)), "loans", _summary_sql)
register("s07_sample_rows", lambda b: tables.sample_rows(b.spine, ["loan_id", "months_on_book"], 200), "spine",
         "SELECT * FROM spine ORDER BY loan_id, months_on_book LIMIT 200")
register(
    "s08_trim_and_quarantine",
    lambda b: (lambda parts: parts[0].agg(one().alias("n"), F.lit(len(parts[0].columns)).alias("n_columns")).withColumn(
        "n_hidden_columns", F.lit(len(parts[1].columns))))(
        tables.trim(b.customers.join(b.latent_risk, "customer_id"), ["customer_id", "region_type", "cac"])),
    "customers", "SELECT count(*) AS n, 3 AS n_columns, 2 AS n_hidden_columns FROM customers",
)
register(
    "s09_run_manifest",
    lambda b: tables.run_manifest(
        {"customers": b.customers, "loans": b.originations, "repayments": b.outcomes, "behaviour": b.behaviour},
        gates.verdict(gates.results(gates.value_checks(b.loans)))),
    "customers loans repayments behaviour",
    f"""SELECT (SELECT count(*) FROM customers) AS n_customers, (SELECT count(*) FROM loans) AS n_loans, (SELECT count(*) FROM repayments) AS n_repayments,
  (SELECT count(*) FROM behaviour) AS n_behaviour, {S.n_if('must AND passed')} AS must_pass, {S.n_if('must')} AS must_total, {S.n_if('NOT must AND passed')} AS should_pass,
  {S.n_if('NOT must')} AS should_total, CASE WHEN bool_and(passed OR NOT must) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({gate_queries.rows_sql(gate_queries.VALUE)})""",
)


def _quarantine(b):
    """Delivered and quarantined columns, written apart, read back and joined for the comparison."""
    people = b.customers.join(b.latent_risk, "customer_id")
    kept, hidden = tables.trim(people, ["customer_id", "region_type", "cac"])
    path = _folder(b, "quarantine")
    tables.write_parquet(kept, f"{path}/delivered")
    tables.write_parquet(hidden, f"{path}/hidden")
    both = b.spark.read.parquet(f"{path}/delivered").join(b.spark.read.parquet(f"{path}/hidden"), "customer_id")
    return both.withColumn("true_latent_risk", half_even("true_latent_risk", 6))


register("s08_quarantine_written", _quarantine, "customers latent_risk",
         f"SELECT customer_id, region_type, cac, {S.he('true_latent_risk', 6)} AS true_latent_risk FROM customers JOIN latent_risk USING (customer_id)")


def _manifest_file(b):
    counted = {"customers": b.customers, "loans": b.originations}
    one_row = tables.run_manifest(counted, parameters={"seasoned_mob": P.SEASONED_MOB, "default_dpd": P.DEFAULT_DPD})
    path = _folder(b, "manifest_json")
    tables.write_json(one_row, path)
    return b.spark.read.schema(one_row.schema).json(path)


register("s09_manifest_json", _manifest_file, "customers loans",
         f"""SELECT (SELECT count(*) FROM customers) AS n_customers, (SELECT count(*) FROM loans) AS n_loans,
  CAST({P.SEASONED_MOB} AS INT) AS seasoned_mob, CAST({P.DEFAULT_DPD} AS INT) AS default_dpd""")

# ---------------------------------------------------------------- projections and predicates
register(
    "p01_p02_p03_projection",
    lambda b: b.loans.select(
        F.col("loan_id").alias("id"), half_even(economics.margin_before_cac(), 2).alias("margin_before_cac"),
        half_even("value_proxy", 0).cast("long").alias("value_whole"), F.col("default_flag").cast("int").alias("flag")),
    "loans", f"SELECT loan_id AS id, {S.he(S.MARGIN, 2)} AS margin_before_cac, {_w('value_proxy')} AS value_whole, default_flag AS flag FROM loans",
)
register(
    "p04_row_filter",
    lambda b: b.originations.filter(
        (F.col("product_type").isin("Personal", "SME") & F.col("tenure_mo").between(12, 24)) | ~F.col("origination_risk_grade").isin("A", "B", "C"))
    .select("loan_id", "product_type", "tenure_mo", "origination_risk_grade"),
    "originations",
    "SELECT loan_id, product_type, tenure_mo, origination_risk_grade FROM originations WHERE (product_type IN ('Personal','SME') AND tenure_mo BETWEEN 12 AND 24) OR origination_risk_grade NOT IN ('A','B','C')",
)
register("p05_dpd_bucket", lambda b: b.repayments.groupBy("dpd", bands.dpd_bucket("dpd").alias("bucket")).agg(one().alias("n")), "repayments",
         f"SELECT dpd, {S.bucket('dpd')} AS bucket, count(*) AS n FROM repayments GROUP BY 1, 2")
register("p06_tenure_band", lambda b: b.originations.groupBy("product_type", "tenure_mo", bands.tenure_band().alias("band")).agg(one().alias("n")), "originations",
         f"SELECT product_type, tenure_mo, {S.per_product('tenure_mo', P.TENURE_BANDS)} AS band, count(*) AS n FROM originations GROUP BY 1, 2, 3")
register("p07_ticket_band", lambda b: b.originations.select("loan_id", bands.ticket_band().alias("band")), "originations",
         f"SELECT loan_id, {S.per_product('ticket_size', P.TICKET_BANDS)} AS band FROM originations")
register(
    "p07_cashflow_band", lambda b: b.behaviour.groupBy(bands.cashflow_band("cashflow_consistency").alias("band")).agg(one().alias("n")), "behaviour",
    """SELECT CASE WHEN c <= 0 THEN NULL WHEN c <= 0.3 THEN '<0.3' WHEN c <= 0.4 THEN '0.3-0.4' WHEN c <= 0.5 THEN '0.4-0.5' WHEN c <= 0.6 THEN '0.5-0.6'
  WHEN c <= 0.7 THEN '0.6-0.7' WHEN c <= 1 THEN '0.7+' END AS band, count(*) AS n FROM (SELECT cashflow_consistency AS c FROM behaviour) GROUP BY 1""",
)
register("p08_ticket_band_fallback", lambda b: economics.ticket_bands_with_fallback(b.originations).groupBy("product_type", "ticket_band").agg(one().alias("n")),
         "banded", "SELECT product_type, ticket_band, count(*) AS n FROM banded GROUP BY 1, 2")
register("p09_grade_cuts", lambda b: b.customers.groupBy("credit_quality_indicator").agg(one().alias("n")), "customers",
         "SELECT credit_quality_indicator, count(*) AS n FROM customers GROUP BY 1")
register(
    "p10_behavioural_distress", lambda b: warning.behaviour_features(b.behaviour).select("customer_id", "month", bands.behavioural_distress().cast("int").alias("distress")),
    "bfeat", "SELECT customer_id, obs_month AS month, CAST(bounce_streak >= 2 OR bounce_count_3m >= 3 OR (utilisation_level >= 70 AND spending_shock_rate_3m > 0) AS INT) AS distress FROM bfeat",
)
register(
    "p11_trigger_counts",
    lambda b: warning.trigger_flags(b.matrix).groupBy("segment").agg(*[F.sum(n).cast("long").alias(n) for n in warning.triggers()], F.sum(F.size("fired")).cast("long").alias("n_fired")),
    "matrix",
    """SELECT segment, CAST(sum(a) AS BIGINT) AS two_partials_plus_bounce, CAST(sum(b) AS BIGINT) AS bounce_streak_2, CAST(sum(c) AS BIGINT) AS shock_plus_util_creep,
  CAST(sum(d) AS BIGINT) AS already_delinquent_30dpd, CAST(sum(a + b + c + d) AS BIGINT) AS n_fired FROM (SELECT segment, CAST(partial_run >= 2 AND coalesce(nach_bounce_count,0) >= 1 AS INT) AS a,
  CAST(bounce_streak >= 2 AS INT) AS b, CAST(coalesce(spending_shock_flag,0) = 1 AND utilisation_creep_3m >= 10 AS INT) AS c, CAST(dpd_current >= 30 AS INT) AS d FROM matrix) GROUP BY 1""",
)
register(
    "p12_canonical_text",
    lambda b: b.table("orders").select(F.concat(F.lit("  "), F.upper(value_map(F.substring("o_orderpriority", 1, 1), {"1": "bnpl card", "2": "Bnpl", "3": "personal", "4": "Personal loan", "5": "sme term"})), F.lit(" ")).alias("raw"))
    .groupBy(bands.canonical_product("raw").alias("product")).agg(one().alias("n")),
    "originations", "SELECT product_type AS product, count(*) AS n FROM originations GROUP BY 1",
)
register(
    "p13_value_maps",
    lambda b: b.originations.groupBy("product_type", "origination_risk_grade").agg(one().alias("n")).select(
        "*", value_map("product_type", P.LGD).alias("lgd"), value_map("product_type", P.FEE_RATE).alias("fee_rate"), bands.grade_rank("origination_risk_grade").alias("rank")),
    "originations",
    f"SELECT *, {S.case('product_type', P.LGD)} AS lgd, {S.case('product_type', P.FEE_RATE)} AS fee_rate, {S.case('origination_risk_grade', {g: i + 1 for i, g in enumerate(P.GRADES)})} AS rank "
    "FROM (SELECT product_type, origination_risk_grade, count(*) AS n FROM originations GROUP BY 1, 2)",
)
register(
    "p14_null_fill", lambda b: b.matrix.agg(*[half_even(F.sum(F.col(f).cast("decimal(18,6)")).cast("double"), 4).alias(f) for f in P.FEATURES], *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in P.LEVEL_FEATURES]),
    "matrix", "SELECT " + ", ".join(S.he(S.total(f, 6), 4) + f" AS {f}" for f in P.FEATURES) + ", " + ", ".join(f"{S.n_if(f + ' IS NULL')} AS null_{f}" for f in P.LEVEL_FEATURES) + " FROM matrix",
)
register("p15_drop_missing", lambda b: b.lever_frame.select("loan_id", half_even("cashflow_consistency_mean", 6).alias("cf")).dropna(), "lever_frame",
         f"SELECT loan_id, {S.he('cashflow_consistency_mean', 6)} AS cf FROM lever_frame WHERE cashflow_consistency_mean IS NOT NULL")
register(
    "p16_p17_clip_and_guard",
    lambda b: b.loans.select(
        "loan_id", half_even(clip(economics.margin_before_cac().cast("double") / clip(F.col("months_on_book").cast("double"), low=1.0), low=1.0), 6).alias("monthly"),
        half_even(ratio(F.col("value_proxy"), F.col("cac_charged")), 6).alias("value_to_cac")),
    "loans",
    f"SELECT loan_id, {S.he(f'greatest(CAST({S.MARGIN} AS DOUBLE)/greatest(CAST(months_on_book AS DOUBLE), 1e0), 1e0)', 6)} AS monthly, {S.he(S.ratio('value_proxy', 'cac_charged'), 6)} AS value_to_cac FROM loans",
)
register("p18_tri_state_label", lambda b: b.outcome_spine.groupBy("label", "product_type").agg(one().alias("n")), "outcome_spine",
         "SELECT label, product_type, count(*) AS n FROM outcome_spine GROUP BY 1, 2")
register(
    "p19_band_assignment", lambda b: b.test_rows.select("loan_id", "months_on_book", bands.warning_band("dpd_current", "score", F.lit(0.6), F.lit(0.4)).alias("band")),
    "test_rows", "SELECT loan_id, months_on_book, CASE WHEN dpd_current >= 30 THEN 'ESCALATION' WHEN score >= 0.6e0 THEN 'RED' WHEN score >= 0.4e0 THEN 'AMBER' ELSE 'GREEN' END AS band FROM test_rows",
)
register(
    "p20_posture_quadrant",
    lambda b: economics.slice_metrics(b.loans, ["origination_cohort"]).select(
        "origination_cohort", bands.posture(100 * F.col("default_rate"), "mean_value", (17.0, 0.0, 9600.0)).alias("posture")),
    "loans", f"""SELECT origination_cohort, {S.posture('100*d', 'm', (17.0, 0.0, 9600.0))} AS posture FROM (
  SELECT origination_cohort, {S.he(S.rate('default_flag = 1'), 6)} AS d, {S.he(S.mean('value_proxy'), 4)} AS m FROM loans GROUP BY 1)""",
)
register(
    "p21_text_search",
    lambda b: b.originations.withColumn("segment", bands.heuristic_segment()).filter(F.col("segment").contains("SME")).groupBy(bands.after_last_dot("segment").alias("name")).agg(one().alias("n")),
    "originations", f"SELECT split_part(segment, '. ', -1) AS name, count(*) AS n FROM (SELECT {S.segment(P.HEURISTIC_SEGMENTS)} AS segment FROM originations) WHERE contains(segment, 'SME') GROUP BY 1",
)

# ---------------------------------------------------------------- joins
register(
    "j01_j15_guarded_one_to_one",
    lambda b: b.loans.select("loan_id", "value_proxy").join(R.assert_unique(b.components, ["loan_id"]), "loan_id").agg(
        one().alias("n"), total("value_proxy").alias("value"), half_even(F.sum("nii").cast("double"), 4).alias("nii")),
    "loans", f"SELECT count(*) AS n, {S.total('value_proxy')} AS value, {S.he('CAST(sum(nii) AS DOUBLE)', 4)} AS nii FROM loans",
)
register(
    "j02_j03_left_joins",
    lambda b: R.left_many_to_one(b.originations, b.customers.select("customer_id", "region_type", "acquisition_channel"), ["customer_id"])
    .join(b.repayments.groupBy("loan_id").agg(F.max("dpd").alias("worst")), "loan_id", "left").select("loan_id", "region_type", "acquisition_channel", "worst"),
    "originations customers repayments",
    "SELECT loan_id, region_type, acquisition_channel, worst FROM originations LEFT JOIN customers USING (customer_id) LEFT JOIN (SELECT loan_id, max(dpd) AS worst FROM repayments GROUP BY 1) USING (loan_id)",
)
register(
    "j04_j05_lookup_of_preaggregate",
    lambda b: b.originations.join(economics.first_hit(b.repayments, 90, "mob90"), "loan_id", "left").groupBy("product_type", "mob90").agg(one().alias("n")),
    "originations loan_events", "SELECT product_type, d AS mob90, count(*) AS n FROM originations LEFT JOIN loan_events USING (loan_id) GROUP BY 1, 2",
)
register(
    "j06_j07_two_hop_composite",
    lambda b: b.repayments.join(b.originations.select("loan_id", "customer_id"), "loan_id").join(
        b.behaviour.select("customer_id", F.col("month").alias("obs_month"), "nach_bounce_count"), ["customer_id", "obs_month"], "left")
    .groupBy("obs_month").agg(one().alias("n"), F.count("nach_bounce_count").alias("n_matched"), F.sum("nach_bounce_count").alias("bounces")),
    "repayments originations behaviour",
    """SELECT obs_month, count(*) AS n, count(nach_bounce_count) AS n_matched, CAST(sum(nach_bounce_count) AS BIGINT) AS bounces
FROM repayments JOIN (SELECT loan_id, customer_id FROM originations) o USING (loan_id) LEFT JOIN behaviour b ON b.customer_id = o.customer_id AND b.month = obs_month GROUP BY 1""",
)
register(
    "j08_look_back_interval",
    lambda b: warning.deterioration_lead(b.repayments, b.originations, b.behaviour, 0.5, 6).groupBy("onset").agg(one().alias("n")),
    "loan_events originations behaviour",
    """SELECT onset, count(*) AS n FROM (SELECT e.loan_id, max(default_month - b.month) AS onset FROM loan_events e JOIN originations o ON e.loan_id = o.loan_id
  LEFT JOIN behaviour b ON b.customer_id = o.customer_id AND default_month - b.month BETWEEN 1 AND 6 AND cashflow_consistency < 0.5
  WHERE default_month IS NOT NULL GROUP BY 1) GROUP BY 1""",
)
register(
    "j09_semi_join", lambda b: b.originations.join(b.repayments.filter(F.col("dpd") >= 90).select("loan_id"), "loan_id", "left_semi").groupBy("product_type").agg(one().alias("n")),
    "originations repayments", "SELECT product_type, count(*) AS n FROM originations WHERE loan_id IN (SELECT loan_id FROM repayments WHERE dpd >= 90) GROUP BY 1",
)
register(
    "j10_anti_join", lambda b: b.originations.join(b.outcomes.select("loan_id"), "loan_id", "left_anti").select("loan_id", "customer_id"),
    "originations outcomes", "SELECT loan_id, customer_id FROM originations WHERE loan_id NOT IN (SELECT loan_id FROM outcomes)",
)
register(
    "j11_multi_way_assignments",
    lambda b: b.originations.select("loan_id", bands.heuristic_segment().alias("a")).join(b.originations.select("loan_id", bands.frozen_segment().alias("b")), "loan_id")
    .join(b.originations.select("loan_id", bands.hybrid_segment().alias("c")), "loan_id").groupBy("a", "b", "c").agg(one().alias("n")),
    "originations", f"SELECT {S.segment(P.HEURISTIC_SEGMENTS)} AS a, {S.segment(P.FROZEN_SEGMENTS)} AS b, {S.HYBRID} AS c, count(*) AS n FROM originations GROUP BY 1, 2, 3",
)
register(
    "j14_old_new_reconciliation",
    lambda b: gates.max_difference(b.loans.select("loan_id", "value_proxy"), b.loans.select("loan_id", (F.col("value_proxy") + F.col("loan_id") % 3).alias("value_proxy")), "loan_id", ["value_proxy"]),
    "loans", "SELECT CAST(0 AS BIGINT) AS n_unmatched, CAST(max(loan_id % 3) AS DOUBLE) AS diff_value_proxy FROM loans",
)

# ---------------------------------------------------------------- aggregates
register(
    "a01_a02_group_and_rate",
    lambda b: b.repayments.groupBy("outcome").agg(
        one().alias("n"), total("amount_paid").alias("paid"), half_even(mean("amount_paid"), 4).alias("mean_paid"), F.min("dpd").alias("lo"), F.max("dpd").alias("hi"),
        half_even(rate(F.col("dpd") >= 30), 6).alias("late_rate")),
    "repayments", f"SELECT outcome, count(*) AS n, {S.total('amount_paid')} AS paid, {S.he(S.mean('amount_paid'), 4)} AS mean_paid, min(dpd) AS lo, max(dpd) AS hi, {S.he(S.rate('dpd >= 30'), 6)} AS late_rate FROM repayments GROUP BY 1",
)
register(
    "a03_exact_quantiles", lambda b: ranks.quantiles(b.originations, F.col("ticket_size").cast("double"), [0.25, 0.5, 0.9], ["product_type"]).select(
        "product_type", *[half_even(f"q{i}", 4).alias(f"q{i}") for i in range(3)]),
    "originations", f"SELECT product_type, {', '.join(S.he(f'quantile_cont(CAST(ticket_size AS DOUBLE), {p})', 4) + f' AS q{i}' for i, p in enumerate((0.25, 0.5, 0.9)))} FROM originations GROUP BY 1",
)
register(
    "a03_median_ungrouped", lambda b: ranks.quantiles(b.repayments, F.col("amount_paid").cast("double"), [0.5]).select(half_even("q0", 4).alias("median_paid")),
    "repayments", f"SELECT {S.he(S.median('amount_paid'), 4)} AS median_paid FROM repayments",
)
register(
    "a04_distinct_count", lambda b: b.originations.groupBy("product_type", "customer_id").agg(F.lit(1).alias("_")).groupBy("product_type").agg(one().alias("n_customers")),
    "originations", "SELECT product_type, count(DISTINCT customer_id) AS n_customers FROM originations GROUP BY 1",
)
register(
    "a05_weighted_average", lambda b: b.originations.groupBy("product_type").agg(half_even(economics.weighted_mean("interest_rate_apr", F.col("ticket_size")), 6).alias("wa_apr")),
    "originations", f"SELECT product_type, {S.he(S.ratio('sum(ticket_size*' + S.dec('interest_rate_apr') + ')', 'sum(ticket_size)'), 6)} AS wa_apr FROM originations GROUP BY 1",
)
register(
    "a06_correlation", lambda b: b.loans.groupBy("product_type").agg(half_even(F.corr("interest_rate_apr", F.col("value_proxy").cast("double")), 6).alias("corr")),
    "loans", f"SELECT product_type, {S.he('corr(interest_rate_apr, CAST(value_proxy AS DOUBLE))', 6)} AS corr FROM loans GROUP BY 1",
)
register(
    "a07_pivot_row_percent", lambda b: R.row_percent_pivot(b.repayments, "outcome", "delinquency_bucket", P.BUCKETS), "repayments",
    f"SELECT outcome, {', '.join(S.he('100*' + S.rate(f'delinquency_bucket = {S.lit(v)}'), 4) + f' AS p{i}' for i, v in enumerate(P.BUCKETS))} FROM repayments GROUP BY 1",
)
register(
    "a08_w03_first_row", lambda b: R.first_row(b.originations, "customer_id", "loan_sequence", ["tenure_mo", "ticket_size"]).select(
        "customer_id", "loan_sequence", "tenure_mo", F.col("ticket_size").cast("double").alias("ticket_size")),
    "originations", "SELECT customer_id, loan_sequence, tenure_mo, CAST(ticket_size AS DOUBLE) AS ticket_size FROM originations WHERE loan_sequence = 1",
)
register("a09_mode", lambda b: R.mode(b.originations, "origination_risk_grade", "product_type"), "originations", f"""
SELECT origination_risk_grade, product_type AS mode, {S.he('n/CAST(tot AS DOUBLE)', 6)} AS share FROM (
  SELECT origination_risk_grade, product_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY origination_risk_grade) AS tot,
    row_number() OVER (PARTITION BY origination_risk_grade ORDER BY count(*) DESC, product_type) AS r FROM originations GROUP BY 1, 2) WHERE r = 1""")
register("a10_category_mix", lambda b: R.shares(b.customers, ["acquisition_channel"]), "customers",
         f"SELECT acquisition_channel, count(*) AS n, {S.he(S.ratio('count(*)', 'sum(count(*)) OVER ()'), 6)} AS share FROM customers GROUP BY 1")
register("a11_share_of_parent", lambda b: R.shares(b.originations, ["product_type", "loan_status"], ["product_type"]), "originations",
         f"SELECT product_type, loan_status, count(*) AS n, {S.he(S.ratio('count(*)', 'sum(count(*)) OVER (PARTITION BY product_type)'), 6)} AS share FROM originations GROUP BY 1, 2")
register(
    "a12_subtotals", lambda b: b.loans.rollup("product_type", "loan_status").agg(one().alias("n"), total("value_proxy").alias("value")).select(
        F.coalesce("product_type", F.lit("TOTAL")).alias("product"), F.coalesce("loan_status", F.lit("ALL")).alias("status"), "n", "value"),
    "loans", f"SELECT coalesce(product_type, 'TOTAL') AS product, coalesce(loan_status, 'ALL') AS status, count(*) AS n, {S.total('value_proxy')} AS value FROM loans GROUP BY ROLLUP (product_type, loan_status)",
)
register(
    "a13_a14_conditional", lambda b: b.loans.groupBy("origination_risk_grade").agg(
        half_even(mean(F.when(F.col("months_on_book") >= P.SEASONED_MOB, F.col("value_proxy"))), 4).alias("seasoned_value"), half_even(mean("value_proxy"), 4).alias("all_value"),
        F.count_if(F.col("loan_status") == "Written-off").alias("n_writeoffs")),
    "loans", f"SELECT origination_risk_grade, {S.he(S.mean('CASE WHEN months_on_book >= 3 THEN value_proxy END'), 4)} AS seasoned_value, {S.he(S.mean('value_proxy'), 4)} AS all_value, {S.n_if(chr(39).join(['loan_status = ', 'Written-off', '']))} AS n_writeoffs FROM loans GROUP BY 1",
)
register(
    "a15_arg_extremes",
    lambda b: b.loans.groupBy("origination_cohort").agg(half_even(mean("value_proxy"), 4).alias("m")).agg(
        F.min(F.struct("m", "origination_cohort")).getField("origination_cohort").alias("worst"), F.max(F.struct("m", "origination_cohort")).getField("origination_cohort").alias("best")),
    "loans", f"SELECT arg_min(c, (m, c)) AS worst, arg_max(c, (m, c)) AS best FROM (SELECT origination_cohort AS c, {S.he(S.mean('value_proxy'), 4)} AS m FROM loans GROUP BY 1)",
)


def _skew(b):
    base = b.loans.groupBy("product_type").agg(half_even(mean("value_proxy"), 4).alias("mean"), half_even(R.coefficient_of_variation(F.col("ticket_size").cast("double")), 6).alias("cv"))
    med = ranks.quantiles(b.loans, F.col("value_proxy").cast("double"), [0.5], ["product_type"]).select("product_type", half_even("q0", 4).alias("median"))
    return base.join(med, "product_type").withColumn("skew_pct", half_even(100 * ratio(F.col("mean") - F.col("median"), F.col("median")), 4))


register(
    "a16_a17_skew_and_variation", _skew, "loans",
    f"""SELECT *, {S.he('100*' + S.ratio('("mean" - "median")', '"median"'), 4)} AS skew_pct FROM (SELECT product_type, {S.he(S.mean('value_proxy'), 4)} AS "mean", {S.he(S.median('value_proxy'), 4)} AS "median",
  {S.he('stddev_pop(CAST(ticket_size AS DOUBLE))/avg(CAST(ticket_size AS DOUBLE))', 6)} AS cv FROM loans GROUP BY 1)""",
)
register("a18_u03_outside_domain", lambda b: R.outside_domain(b.originations, "product_type", ["BNPL", "SME"]), "originations",
         "SELECT DISTINCT product_type FROM originations WHERE product_type NOT IN ('BNPL','SME')")
register(
    "a20_range_spread", lambda b: economics.slice_metrics(b.loans, ["origination_cohort"]).agg(
        half_even(F.max("default_rate") - F.min("default_rate"), 6).alias("risk_spread"), half_even(F.max("mean_value") - F.min("mean_value"), 4).alias("value_spread")),
    "loans", f"SELECT {S.he('max(d) - min(d)', 6)} AS risk_spread, {S.he('max(m) - min(m)', 4)} AS value_spread FROM (SELECT {S.he(S.rate('default_flag = 1'), 6)} AS d, {S.he(S.mean('value_proxy'), 4)} AS m FROM loans GROUP BY origination_cohort)",
)

# ---------------------------------------------------------------- windows and panels
register("w01_sequence_number", lambda b: b.originations.select("loan_id", "customer_id", "loan_sequence"), "originations",
         "SELECT loan_id, customer_id, loan_sequence FROM originations")
register(
    "w02_last_row", lambda b: R.last_row(b.repayments, "loan_id", "period_index", ["dpd", "outstanding_balance"]).select(
        "loan_id", "period_index", "dpd", F.col("outstanding_balance").cast("double").alias("outstanding_balance")),
    "repayments", "SELECT loan_id, max(period_index) AS period_index, max_by(dpd, period_index) AS dpd, CAST(max_by(outstanding_balance, period_index) AS DOUBLE) AS outstanding_balance FROM repayments GROUP BY 1",
)
register(
    "w04_first_hits", lambda b: b.repayments.groupBy("loan_id").agg(*[F.min(F.when(F.col("dpd") >= k, F.col("period_index"))).alias(f"hit{k}") for k in (1, 30, 90)]),
    "repayments", "SELECT loan_id, " + ", ".join(f"min(period_index) FILTER (WHERE dpd >= {k}) AS hit{k}" for k in (1, 30, 90)) + " FROM repayments GROUP BY 1",
)
_P = "OVER (PARTITION BY loan_id ORDER BY period_index)"
register("w05_lead", lambda b: panel.neighbour(b.repayments, "loan_id", "period_index", "delinquency_bucket", "next_bucket").select("loan_id", "period_index", "next_bucket"),
         "repayments", f"SELECT loan_id, period_index, lead(delinquency_bucket) {_P} AS next_bucket FROM repayments")
register(
    "w06_w07_w08_deltas_slopes_rolls",
    lambda b: warning.behaviour_features(b.behaviour).select("customer_id", "month", "utilisation_creep_3m", "cashflow_consistency_slope", "spending_shock_rate_3m", "bounce_count_3m"),
    "bfeat", "SELECT customer_id, obs_month AS month, utilisation_creep_3m, cashflow_consistency_slope, spending_shock_rate_3m, CAST(bounce_count_3m AS BIGINT) AS bounce_count_3m FROM bfeat",
)
register("w09_run_length", lambda b: panel.run_length(b.repayments, "loan_id", "period_index", {"late_run": "dpd"}).select("loan_id", "period_index", "late_run"),
         "repayments", """SELECT loan_id, period_index, count(*) FILTER (WHERE dpd > 0) OVER (PARTITION BY loan_id, island ORDER BY period_index) AS late_run
FROM (SELECT *, count(*) FILTER (WHERE dpd <= 0) OVER (PARTITION BY loan_id ORDER BY period_index) AS island FROM repayments)""")
register(
    "w10_rows_since_flag", lambda b: panel.rows_since(b.repayments, "loan_id", "period_index", F.col("outcome") == "miss", "since_miss", 24).select("loan_id", "period_index", "since_miss"),
    "repayments", f"SELECT loan_id, period_index, least(coalesce(period_index - max(CASE WHEN outcome = 'miss' THEN period_index END) {_P}, 24), 24) AS since_miss FROM repayments",
)
register(
    "w11_first_occurrence", lambda b: panel.first_occurrence(b.repayments, "loan_id", "period_index", F.col("outcome") == "partial", "first_partial").select("loan_id", "period_index", "first_partial"),
    "repayments", f"SELECT loan_id, period_index, CAST(outcome = 'partial' AND count(*) FILTER (WHERE outcome = 'partial') {_P} = 1 AS INT) AS first_partial FROM repayments",
)
register(
    "w12_decile_by_rank", lambda b: ranks.deciles(b.loans.select("loan_id", F.col("value_proxy").cast("double").alias("v")), "v", ["loan_id"]).select("loan_id", "decile"),
    "loans", "SELECT loan_id, CAST(greatest(ceil((r - 1)*10/(n - 1e0)) - 1, 0) AS INT) AS decile FROM (SELECT loan_id, row_number() OVER (ORDER BY value_proxy, loan_id) AS r, count(*) OVER () AS n FROM loans)",
)
register(
    "w13_average_rank", lambda b: ranks.average_rank(b.originations, F.col("tenure_mo")), "originations",
    "SELECT CAST(tenure_mo AS DOUBLE) AS value, count(*) AS n, avg(r) AS avg_rank FROM (SELECT tenure_mo, row_number() OVER (ORDER BY tenure_mo) AS r FROM originations) GROUP BY 1",
)
register("w14_cured_loans", lambda b: gates.cured_loans(b.repayments), "repayments",
         f"SELECT loan_id, max(CAST(coalesce(p > 0 AND dpd = 0, false) AS INT)) AS cured FROM (SELECT loan_id, dpd, lag(dpd) {_P} AS p FROM repayments) GROUP BY 1")
register("w15_contiguity", lambda b: gates.contiguity(b.repayments), "repayments", """
SELECT loan_id, min(period_index) AS lo, max(period_index) AS hi, count(DISTINCT period_index) AS n_distinct, count(*) AS n_rows,
  min(period_index) = 1 AND max(period_index) = count(DISTINCT period_index) AND count(*) = count(DISTINCT period_index) AS contiguous FROM repayments GROUP BY 1""")
register(
    "w17_increasing_along_grades",
    lambda b: R.increasing_along(b.loans.groupBy(bands.grade_rank("origination_risk_grade").alias("g")).agg(half_even(mean("ticket_size"), 4).alias("m")), "m", "g"),
    "loans", f"SELECT bool_and(coalesce(m > p, true)) AS increasing FROM (SELECT m, lag(m) OVER (ORDER BY g) AS p FROM (SELECT origination_risk_grade AS g, {S.he(S.mean('ticket_size'), 4)} AS m FROM loans GROUP BY 1))",
)
register("w18_missed_count", lambda b: b.repayments.select("loan_id", "period_index", "missed_payments_cum"), "outcomes",
         f"SELECT loan_id, period_index, count(*) FILTER (WHERE outcome <> 'full') {_P} AS missed_payments_cum FROM outcomes")
S.view("steps", "outcomes", f"SELECT loan_id, period_index, CAST({S.case('outcome', OUTCOME_DELTA)} AS INT) AS d FROM outcomes")
register("w19_dpd_walk", lambda b: panel.dpd_walk(b.outcomes, "loan_id", "period_index", value_map("outcome", OUTCOME_DELTA)).select("loan_id", "period_index", "dpd"), "steps", """
SELECT loan_id, period_index, dpd FROM (WITH RECURSIVE walk(loan_id, period_index, dpd) AS (
  SELECT loan_id, period_index, greatest(d, 0) FROM steps WHERE period_index = 1 UNION ALL
  SELECT s.loan_id, s.period_index, greatest(w.dpd + s.d, 0) FROM walk w JOIN steps s ON s.loan_id = w.loan_id AND s.period_index = w.period_index + 1)
SELECT * FROM walk)""")
register(
    "w20_sticky_default_and_stop",
    lambda b: panel.running(
        panel.until_first(b.repayments, "loan_id", "period_index", F.col("dpd") >= P.WRITE_OFF_DPD), "loan_id", "period_index",
        {"defaulted": ("max", (F.col("dpd") >= P.DEFAULT_DPD).cast("int"))}).select("loan_id", "period_index", "dpd", "defaulted"),
    "repayments", f"""SELECT loan_id, period_index, dpd, defaulted FROM (SELECT loan_id, period_index, dpd, max(CAST(dpd >= 90 AS INT)) {_P} AS defaulted,
  coalesce(count(*) FILTER (WHERE dpd >= 180) OVER (PARTITION BY loan_id ORDER BY period_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM repayments) WHERE stops = 0""",
)
register("w21_cohort_shift", lambda b: gates.early_delinquency_shift(b.repayments, b.originations), "repayments originations", f"""
SELECT {S.he('avg(r) FILTER (WHERE d <= 6) - avg(r) FILTER (WHERE u <= 6)', 6)} AS shift FROM (SELECT r, row_number() OVER (ORDER BY c) AS u, row_number() OVER (ORDER BY c DESC) AS d FROM (
  SELECT origination_cohort AS c, {S.rate('dpd > 0')} AS r FROM repayments JOIN originations USING (loan_id) WHERE period_index <= 3 GROUP BY 1))""")

# ---------------------------------------------------------------- orderings and sets
register("o01_o05_sorted_head", lambda b: b.spine.orderBy("loan_id", "months_on_book").limit(500), "spine", "SELECT * FROM spine ORDER BY loan_id, months_on_book LIMIT 500")
register(
    "o04_top_fraction", lambda b: ranks.top_fraction(b.loans.select("loan_id", F.col("value_proxy").cast("double").alias("v")), "v", ["loan_id"], 0.01),
    "loans", "SELECT loan_id, v FROM (SELECT loan_id, CAST(value_proxy AS DOUBLE) AS v, row_number() OVER (ORDER BY value_proxy DESC, loan_id) AS r, count(*) OVER () AS n FROM loans) WHERE r <= greatest(n//100, 1)",
)
register(
    "o06_canonical_order", lambda b: R.canonical_order(b.loans.filter(F.col("default_flag") == 1).groupBy("loan_status").agg(one().alias("n")), "loan_status", [*P.STATUSES, "Frozen"], {"n": 0}),
    "loans", f"SELECT s.loan_status, position, coalesce(n, 0) AS n FROM (VALUES ('Active', 0), ('Closed', 1), ('Written-off', 2), ('Frozen', 3)) s(loan_status, position) LEFT JOIN (SELECT loan_status, count(*) AS n FROM loans WHERE default_flag = 1 GROUP BY 1) USING (loan_status)",
)


def _relabelled(b):
    from ledgerscope.operators import segments

    tagged = b.loans.withColumn("segment", bands.heuristic_segment())
    return segments.relabel_by_risk(tagged, "segment", "T").groupBy("segment", "label").agg(one().alias("n"))


register("o07_relabel_by_risk", _relabelled, "loans", f"""
SELECT segment, 'T' || row_number() OVER (ORDER BY r, segment) AS label, n FROM (SELECT {S.segment(P.HEURISTIC_SEGMENTS)} AS segment, count(*) AS n,
  {S.ratio(S.n_if('months_on_book >= 3 AND default_flag = 1'), S.n_if('months_on_book >= 3'))} AS r FROM loans GROUP BY 1)""")
register(
    "u01_union_of_methods", lambda b: b.originations.select(F.lit("heuristic").alias("method"), bands.heuristic_segment().alias("segment")).unionByName(
        b.originations.select(bands.frozen_segment().alias("segment"), F.lit("frozen").alias("method"))).groupBy("method", "segment").agg(one().alias("n")),
    "originations", f"SELECT method, segment, count(*) AS n FROM (SELECT 'heuristic' AS method, {S.segment(P.HEURISTIC_SEGMENTS)} AS segment FROM originations UNION ALL SELECT 'frozen', {S.segment(P.FROZEN_SEGMENTS)} FROM originations) GROUP BY 1, 2",
)
register(
    "u02_overlap", lambda b: R.overlap(b.repayments.filter(F.col("dpd") >= 90), b.repayments.filter(F.col("outcome") == "full"), "loan_id"),
    "repayments", "SELECT count(*) AS n_shared FROM (SELECT loan_id FROM repayments WHERE dpd >= 90 INTERSECT SELECT loan_id FROM repayments WHERE outcome = 'full')",
)
register("u04_duplicate_keys", lambda b: gates.duplicate_keys(b.table("lineitem"), ["l_orderkey", "l_linenumber"]), "",
         "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")

# ---------------------------------------------------------------- functions
register(
    "f01_f02_text", lambda b: b.originations.select("loan_id", F.concat_ws("|", bands.heuristic_segment(), "loan_status").alias("stratum"),
                                                    F.concat(F.lit("<"), F.format_number(half_even("ticket_size", 0), 0)).alias("label")),
    "originations", f"SELECT loan_id, concat_ws('|', {S.segment(P.HEURISTIC_SEGMENTS)}, loan_status) AS stratum, '<' || format('{{:,}}', {_w('ticket_size')}) AS label FROM originations",
)
register(
    "f03_f04_months", lambda b: b.originations.select("loan_id", finance.month_text("origination_date").alias("month"), finance.month_index("origination_date").alias("month_index"),
                                                      (finance.month_index("origination_date") - finance.month_index_of_text("origination_cohort")).alias("gap")),
    "originations", "SELECT loan_id, strftime(origination_date, '%Y-%m') AS month, CAST(year(origination_date)*12 + month(origination_date) AS INT) AS month_index, 0 AS gap FROM originations",
)
register(
    "f05_anchored_dates",
    lambda b: b.repayments.join(b.originations.select("loan_id", "origination_date"), "loan_id").select(
        "loan_id", "period_index", finance.anchored_period_date("origination_date", "period_index").cast("string").alias("period_date")),
    "repayments originations", "SELECT loan_id, period_index, CAST(CAST(origination_date + to_months(CAST(period_index - 1 AS INT)) AS DATE) AS VARCHAR) AS period_date FROM repayments JOIN originations USING (loan_id)",
)
register(
    "f06_months_to_days", lambda b: warning.deterioration_lead(b.repayments, b.originations, b.behaviour).filter(F.col("onset").isNotNull()).groupBy("onset").agg(
        one().alias("n"), F.max("lead_days").alias("days_30"), half_even(F.max(F.col("onset") * P.DAYS_PER_MONTH), 2).alias("days_30_44")),
    "loan_events originations behaviour",
    f"""SELECT onset, count(*) AS n, max(onset)*30 AS days_30, {S.he('max(onset)*30.44e0', 2)} AS days_30_44 FROM (SELECT e.loan_id, max(default_month - b.month) AS onset FROM loan_events e JOIN originations o ON e.loan_id = o.loan_id
  JOIN behaviour b ON b.customer_id = o.customer_id AND default_month - b.month BETWEEN 1 AND 6 AND cashflow_consistency < 0.6 WHERE default_month IS NOT NULL GROUP BY 1) GROUP BY 1""",
)
register(
    "f07_math", lambda b: b.originations.select("loan_id", half_even(F.ln(F.col("ticket_size").cast("double")), 6).alias("ln_ticket"), half_even(F.exp(-F.col("interest_rate_apr") / 100), 6).alias("discount"),
                                                F.signum(F.col("ticket_size").cast("double") - 100000).alias("side"), half_even(F.abs(F.col("ticket_size").cast("double") - 100000), 2).alias("distance")),
    "originations", f"SELECT loan_id, {S.he('ln(CAST(ticket_size AS DOUBLE))', 6)} AS ln_ticket, {S.he('exp(-interest_rate_apr/100)', 6)} AS discount, CAST(sign(CAST(ticket_size AS DOUBLE) - 100000) AS DOUBLE) AS side, {S.he('abs(CAST(ticket_size AS DOUBLE) - 100000)', 2)} AS distance FROM originations",
)
_r, _n = "interest_rate_apr/100e0/12e0", "CAST(tenure_mo AS DOUBLE)"
_emi = f"(CAST(ticket_size AS DOUBLE)*({_r})/(1e0 - pow(1e0 + {_r}, -{_n})))"
register(
    "f08_instalment", lambda b: b.originations.select("loan_id", half_even(finance.instalment(F.col("ticket_size").cast("double"), finance.monthly_rate("interest_rate_apr"), F.col("tenure_mo").cast("double")), 4).alias("emi")),
    "originations", f"SELECT loan_id, {S.he(_emi, 4)} AS emi FROM originations",
)
_bal = lambda j: f"(p*pow(1e0 + r, {j}) - emi*(pow(1e0 + r, {j}) - 1)/r)"
register(
    "f09_amortisation", lambda b: finance.amortisation_schedule(b.originations).groupBy("loan_id").agg(
        one().alias("n_periods"), half_even(F.sum(half_even("interest", 4).cast("decimal(18,4)")).cast("double"), 1).alias("interest"),
        half_even(F.sum(half_even("principal", 4).cast("decimal(18,4)")).cast("double"), 1).alias("principal"), half_even(F.abs(F.min("closing_balance")), 2).alias("residue")),
    "originations",
    f"""SELECT loan_id, count(*) AS n_periods, {S.he('CAST(sum(CAST(' + S.he('b0*r', 4) + ' AS DECIMAL(18,4))) AS DOUBLE)', 1)} AS interest,
  {S.he('CAST(sum(CAST(' + S.he('emi - b0*r', 4) + ' AS DECIMAL(18,4))) AS DOUBLE)', 1)} AS principal, {S.he('abs(min(b1))', 2)} AS residue FROM (
  SELECT loan_id, r, emi, {_bal('(k - 1)')} AS b0, {_bal('k')} AS b1 FROM (SELECT loan_id, CAST(ticket_size AS DOUBLE) AS p, {_r} AS r, {_emi} AS emi, CAST(unnest(range(1, tenure_mo + 1)) AS DOUBLE) AS k FROM originations)) GROUP BY 1""",
)
