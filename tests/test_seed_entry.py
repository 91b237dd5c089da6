"""Seeding and naming rules; the driver entry points."""

from pyspark.sql import functions as F

from cataloom.functions.text import id_to_entity, table_name
from cataloom.sources import seed
from tests.conftest import SF_SMALL


def test_seed_entity_repeatable(spark):
    a = seed.seed_entity(spark, rows=300, seed=3)
    b = seed.seed_entity(spark, rows=300, seed=3)
    assert len(a.columns) == 25
    assert sorted(map(tuple, a.drop("prefs").collect())) == sorted(map(tuple, b.drop("prefs").collect()))
    r = a.agg(F.min("credit_score"), F.max("credit_score"), F.count("notes"),
              F.count("payment_terms")).first()
    assert 300 <= r[0] and r[1] <= 850 and 0 < r[2] < 90 and r[3] < 300   # some NULL picks


def test_business_tables_rows(spark):
    t = seed.business_tables(spark, rows=5)
    assert len(t) == 31 and all(df.count() == 5 for df in list(t.values())[:3])


def test_plan_entities_suffix(spark):
    p = {r.i: r for r in seed.plan_entities(spark, 30).collect()}
    assert p[0].logical == "Salesforce_Accounts" and p[0].dataset_id == "ds_salesforce_accounts"
    assert p[27].logical == "Salesforce_Accounts_2" and p[27].table_name == "salesforce_accounts_2"


def test_rotate_source_and_names(spark):
    df = spark.createDataFrame([(1,), (2,), (15,)], "i int")
    got = [(r.source, r.name) for r in seed.rotate_source(df).orderBy("i").collect()]
    assert got == [("SAP ECC", "sap_sales_orders_01"), ("Oracle EBS", "ebs_ar_receipts_02"),
                   ("SAP ECC", "sap_material_master_15")]
    n = spark.createDataFrame([("Jira Cloud: Issues!",), ("ds_entity_007",), ("ds_entity_07",)], "s string")
    r = n.select(table_name("s"), id_to_entity("s")).collect()
    assert r[0][0] == "jira_cloud_issues_" and r[1][1] == "entity_007" and r[2][1] is None


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "qid" in df.columns
    from cataloom.queries import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())
    assert len(QUERIES) >= 67


def test_names_of_many_numbers_stay_distinct(spark):
    got = seed.rotate_source(spark.range(1, 1501).withColumnRenamed("id", "i")).select("name")
    assert got.distinct().count() == 1500
