"""Synthetic business data and naming rules (the reference's seeding scripts).

Rows come from ``spark.range`` and column arithmetic on the row counter - no
``rand()`` - so the same (rows, seed) gives the same table on any cluster and
any partitioning, and the generator is a pure map with no shuffle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.functions.text import dataset_id_for, table_name, ntz_lit
from cataloom.sources.schemas import BUSINESS_DDL

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's seeding rules.
COUNTRIES = ("US", "CA", "GB", "DE", "FR", "JP")
PAYMENT_TERMS = ("NET30", "NET45", "DUE_ON_RECEIPT")
TIMEZONES = ("UTC", "America/Denver", "America/New_York", "Europe/Berlin")
CURRENCIES = ("USD", "EUR", "JPY", "GBP")
TIERS = ("gold", "silver", "bronze")
THEMES = ("light", "dark")
SEGMENTS = ("A", "B", "C")
STATUSES = ("trial", "active", "churned")
POSTED_BASE = _dt.date(2024, 1, 1)
NOTE_TEXT = "manual review"
# Candidate (logical name, source) pairs planned round-robin into entities.
ENTITY_CANDIDATES = (
    ("Salesforce_Accounts", "Salesforce"),
    ("Salesforce_Opportunities", "Salesforce"),
    ("Zendesk_Tickets", "Zendesk"),
    ("Zendesk_Users", "Zendesk"),
    ("ServiceNow_Incidents", "ServiceNow"),
    ("ServiceNow_Changes", "ServiceNow"),
    ("OracleEBS_GLJournals", "Oracle EBS"),
    ("OracleEBS_ARReceipts", "Oracle EBS"),
    ("SAPECC_SalesOrders", "SAP ECC"),
    ("SAPECC_MaterialMaster", "SAP ECC"),
    ("Workday_Compensation", "Workday HCM"),
    ("Workday_Positions", "Workday HCM"),
    ("Shopify_Orders", "Shopify"),
    ("Shopify_Customers", "Shopify"),
    ("NetSuite_Transactions", "NetSuite"),
    ("NetSuite_Vendors", "NetSuite"),
    ("GitHub_Issues", "GitHub"),
    ("GitHub_Releases", "GitHub"),
    ("GoogleAnalytics_Events", "Google Analytics"),
    ("GoogleAnalytics_Sessions", "Google Analytics"),
    ("Postgres_Customers", "PostgreSQL"),
    ("Postgres_Invoices", "PostgreSQL"),
    ("SQLServer_Clickstream", "SQL Server"),
    ("Anaplan_Forecasts", "Anaplan"),
    ("Anaplan_ModelExports", "Anaplan"),
    ("Jira_Issues", "Jira Cloud"),
    ("Jira_Users", "Jira Cloud"),
)
# Source rotation of the demo catalog and the base names offered per source.
DEMO_SOURCES = ("SAP ECC", "Oracle EBS", "SQL Server", "PostgreSQL", "Anaplan", "Shopify",
                "Salesforce", "Workday HCM", "NetSuite", "Zendesk", "Jira Cloud", "GitHub",
                "ServiceNow", "Google Analytics")
SOURCE_NAME_OPTIONS = {
    "SAP ECC": ("sap_sales_orders", "sap_gl_transactions", "sap_material_master", "sap_customer_master"),
    "Oracle EBS": ("ebs_ap_invoices", "ebs_ar_receipts", "ebs_po_lines", "ebs_gl_journals"),
    "SQL Server": ("sqlsrv_web_orders", "sqlsrv_page_views", "sqlsrv_clickstream", "sqlsrv_erp_orders"),
    "PostgreSQL": ("pg_orders", "pg_invoices", "pg_user_events", "pg_customers"),
    "Anaplan": ("anaplan_model_exports", "anaplan_scenarios", "anaplan_forecasts", "anaplan_cost_centers"),
    "Shopify": ("shopify_orders", "shopify_customers", "shopify_products", "shopify_transactions"),
    "Salesforce": ("sf_accounts", "sf_opportunities", "sf_contacts", "sf_cases"),
    "Workday HCM": ("workday_workers", "workday_compensation", "workday_time_off", "workday_positions"),
    "NetSuite": ("netsuite_transactions", "netsuite_items", "netsuite_vendors", "netsuite_customers"),
    "Zendesk": ("zendesk_tickets", "zendesk_users", "zendesk_comments", "zendesk_satisfaction"),
    "Jira Cloud": ("jira_issues", "jira_projects", "jira_users", "jira_boards"),
    "GitHub": ("github_commits", "github_issues", "github_prs", "github_releases"),
    "ServiceNow": ("servicenow_incidents", "servicenow_requests", "servicenow_changes", "servicenow_problems"),
    "Google Analytics": ("ga_sessions", "ga_events", "ga_pages", "ga_traffic"),
}
# ---------------------------------------------------------------------------


def split_ddl(ddl: str) -> list[str]:
    """'a int, b decimal(12,2), c map<string,string>' -> one entry per column."""
    import re
    return re.split(r",\s(?![^()<>]*[)>])", ddl)


def gen_sequence(spark: SparkSession, n: int) -> DataFrame:
    """``UNNEST(sequence(1, n))``: rows 1..n, generated in parallel."""
    return spark.range(1, int(n) + 1).select(F.col("id").alias("seq"))


def unit(seq: Column, seed: int, salt: int) -> Column:
    """Repeatable pseudo-random value in [0, 1) from (row, seed, salt)."""
    h = F.xxhash64(seq.cast("bigint"), F.lit(seed), F.lit(salt))
    return F.pmod(h, F.lit(1_000_003)).cast("double") / F.lit(1_000_003.0)


def pick(options, u: Column, extra_null: bool = True) -> Column:
    """``ELEMENT_AT(arr, 1 + CAST(u * n AS INTEGER))`` with the cast rounding
    (as the reference's engine does): the index runs 1..n+1 and n+1 gives
    NULL through try_element_at.  ``extra_null=False`` keeps it in 1..n."""
    n = len(options)
    idx = F.lit(1) + F.round(u * F.lit(float(n))).cast("int")
    if not extra_null:
        idx = F.least(idx, F.lit(n))
    return F.try_element_at(F.array(*[F.lit(o) for o in options]), idx)


def seed_entity(spark: SparkSession, rows: int = 1000, seed: int = 0,
                now: _dt.datetime = _dt.datetime(2024, 1, 1)) -> DataFrame:
    """The 25-column seeded entity table."""
    seq = F.col("seq")
    u = lambda salt: unit(seq, seed, salt)
    nowc = ntz_lit(now)
    return gen_sequence(spark, rows).select(
        seq.cast("bigint").alias("id"),
        F.concat(F.lit("user_"), seq.cast("string")).alias("username"),
        F.concat(F.lit("User "), seq.cast("string")).alias("full_name"),
        F.concat(F.lit("user"), seq.cast("string"), F.lit("@example.com")).alias("email"),
        F.round(u(1) * 10000 + 10, 2).cast("decimal(12,2)").alias("amount"),
        (F.lit(300) + (u(2) * 550).cast("int")).alias("credit_score"),
        F.round(u(3), 6).alias("risk_factor"),
        (u(4) > 0.2).alias("is_active"),
        pick(COUNTRIES, u(5)).alias("country"),
        pick(PAYMENT_TERMS, u(6)).alias("payment_terms"),
        F.date_add(F.lit(POSTED_BASE), (u(7) * 600).cast("int")).alias("posted_date"),
        nowc.alias("created_at"),
        (nowc - F.make_dt_interval(days=(u(8) * 30).cast("int"))).alias("last_login"),
        nowc.alias("updated_at"),
        F.when(u(9) < 0.1, F.lit(NOTE_TEXT)).alias("notes"),
        pick(TIMEZONES, u(10)).alias("timezone"),
        pick(CURRENCIES, u(11)).alias("currency"),
        F.array(F.lit("tier-"), pick(TIERS, u(12))).alias("tags"),
        F.map_from_arrays(F.array(F.lit("lang"), F.lit("theme")),
                          F.array(F.lit("en"), pick(THEMES, u(13)))).alias("prefs"),
        (u(14) * 200).cast("int").alias("login_count"),
        F.round(u(15) * 100, 2).cast("double").alias("discount_pct"),
        F.round(u(16) * 100000, 3).cast("double").alias("lifetime_value"),
        pick(SEGMENTS, u(17)).alias("segment"),
        pick(STATUSES, u(18)).alias("status"),
        F.round(u(19), 6).cast("double").alias("churn_prob"))


def _value_for(name: str, dt: T.DataType, seq: Column, seed: int, salt: int) -> Column:
    """A column value chosen by type, from the row counter."""
    u = unit(seq, seed, salt)
    if isinstance(dt, T.LongType):
        return seq.cast("bigint") if name.endswith("id") else (u * 1_000_000).cast("bigint")
    if isinstance(dt, T.IntegerType):
        return (u * 1000).cast("int")
    if isinstance(dt, T.DecimalType):
        return F.round(u * 10000, dt.scale).cast(dt)
    if isinstance(dt, T.DoubleType):
        return F.round(u, 6)
    if isinstance(dt, T.BooleanType):
        return u > 0.5
    if isinstance(dt, T.DateType):
        return F.date_add(F.lit(POSTED_BASE), (u * 600).cast("int"))
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return (ntz_lit(_dt.datetime(2024, 1, 1))
                + F.make_dt_interval(secs=(u * 86400 * 600).cast("int")))
    if isinstance(dt, T.ArrayType):
        return F.array(F.concat(F.lit(f"{name}_"), seq.cast("string")))
    if isinstance(dt, T.MapType):
        return F.create_map(F.lit("k"), seq.cast("string"))
    return F.concat(F.lit(f"{name}_"), seq.cast("string"))


def seed_table(spark: SparkSession, ddl: str, rows: int, seed: int = 0) -> DataFrame:
    """Rows for any schema, one expression per column chosen by its type."""
    schema = spark.createDataFrame([], ddl).schema
    if rows <= 0:
        return spark.createDataFrame([], schema)
    seq = F.col("seq")
    cols = [_value_for(f.name, f.dataType, seq, seed, i).cast(f.dataType).alias(f.name)
            for i, f in enumerate(schema.fields)]
    return gen_sequence(spark, rows).select(*cols)


def business_tables(spark: SparkSession, rows: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    """name -> DataFrame for the 31 business schemas (entity table included)."""
    out = {}
    for name, ddl in BUSINESS_DDL.items():
        if name.startswith("entity_") and rows > 0:
            out[name] = seed_entity(spark, rows, seed)
        else:
            out[name] = seed_table(spark, ddl, rows, seed)
    return out


def seed_business_schemas(spark: SparkSession, rows: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    return business_tables(spark, rows, seed)


# --- naming and planning rules -------------------------------------------------------

def candidates_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(ENTITY_CANDIDATES)],
                                 "cand_idx int, logical string, source string")


def plan_entities(spark: SparkSession, n: int, candidates: DataFrame | None = None) -> DataFrame:
    """n entities round-robin over the candidates; the r-th repeat of a name
    gets the suffix ``_r`` (r = i / n_candidates + 1).  A range joined with a
    broadcast of the (fixed, small) candidate list."""
    cands = candidates if candidates is not None else candidates_frame(spark)
    nc = cands.count()
    plan = spark.range(int(n)).select(F.col("id").alias("i"),
                                      (F.col("id") % nc).cast("int").alias("cand_idx"),
                                      (F.floor(F.col("id") / nc) + 1).alias("rep"))
    j = plan.join(F.broadcast(cands), "cand_idx")
    logical = F.when(F.col("rep") > 1, F.concat("logical", F.lit("_"), F.col("rep").cast("string"))) \
               .otherwise(F.col("logical"))
    return j.select("i", logical.alias("logical"), "source",
                    table_name(logical).alias("table_name"),
                    dataset_id_for(logical).alias("dataset_id"))


def rotate_source(df: DataFrame, idx_col: str = "i", sources=DEMO_SOURCES,
                  options=SOURCE_NAME_OPTIONS, width: int | None = None) -> DataFrame:
    """source = sources[(i - 1) % n]; name = options[source][(i - 1) % 4] + '_' + zero-padded i.

    Numbers are padded to ``width`` digits, by default those of the largest
    (one number is read); a longer number is never cut."""
    i = F.col(idx_col)
    if width is None:
        width = df.agg(F.max(F.length(i.cast("string")))).first()[0] or 1
    digits = i.cast("string")
    src_arr = F.array(*[F.lit(s) for s in sources])
    source = F.element_at(src_arr, (F.pmod(i - 1, F.lit(len(sources))) + 1).cast("int"))
    opt_map = F.create_map(*[x for s in sources for x in
                             (F.lit(s), F.array(*[F.lit(o) for o in options[s]]))])
    opts = opt_map[source]
    base = F.element_at(opts, (F.pmod(i - 1, F.size(opts)) + 1).cast("int"))
    return df.withColumn("source", source).withColumn(
        "name", F.concat(base, F.lit("_"), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))))
