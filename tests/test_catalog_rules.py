"""Column classification rules and the golden counts derived from the
business DDL (31 tables, 518 columns)."""

from pyspark.sql import functions as F

from cataloom.functions import rules
from cataloom.operators import catalog as cat
from cataloom.operators.chunk import kept_columns
from cataloom.sources.seed import business_tables
from cataloom.sources.tables import list_columns, type_name


def _business_columns(spark):
    return list_columns(spark, business_tables(spark, rows=0))


def test_business_schema_size(spark):
    cols = _business_columns(spark)
    assert cols.select("dataset_id").distinct().count() == 31
    assert cols.count() == 518


def test_golden_pii_and_indexed_counts(spark):
    cols = _business_columns(spark)
    assert cat.flag_pii(cols).where("pii_flag").count() == 20
    assert cat.flag_indexed(cols).where("indexed").count() == 136
    tables = business_tables(spark, rows=0)
    dropped = sum(len(df.columns) - len(kept_columns(df.columns)) for df in tables.values())
    assert dropped == 28


def test_publish_guard_examples():
    names = ["destination_type_code", "tax_amount", "addr_line1", "full_name", "national_id",
             "birth_date", "Email_Primary", "l_tax"]
    assert kept_columns(names) == ["addr_line1", "full_name", "national_id"]
    assert kept_columns(["A", "b", "c"], include=["a", "B"], exclude=["b"]) == ["A"]


def test_indexed_like_wildcard(spark):
    df = spark.createDataFrame([(n,) for n in ["accountid", "user_guid", "paid", "id", "number",
                                               "created", "tran_timestamp", "name", "ident"]],
                               "column_name string")
    got = {r[0]: r[1] for r in df.select("column_name", rules.indexed("column_name")).collect()}
    assert got == {"accountid": True, "user_guid": True, "paid": True, "id": True, "number": True,
                   "created": True, "tran_timestamp": True, "name": False, "ident": False}


MAP_CASES = [
    (None, "i don't know"), ("—", "i don't know"),
    ("TIMESTAMP WITH TIME ZONE", "timestamptz"), ("timestamp(6)   with time zone", "timestamp"),
    ("timestamp(6)", "timestamp"), ("DATE", "date"), ("ansidate", "date"), ("time2(7)", "i don't know"),
    ("smallint", "integer"), ("INTEGER", "integer"), ("bigint", "long"), ("decimal", "double"),
    ("DECIMAL(18,2)", "decimal(38,10)"), ("decfloat(34)", "i don't know"), ("real", "float"),
    ("double", "double"), ("varchar(20)", "string"), ("CHAR(1)", "string"), ("xml", "string"),
    ("blob", "binary"), ("varbinary", "binary"), ("boolean", "i don't know"),
    ("array(varchar)", "i don't know"), ("map(varchar, varchar)", "i don't know"),
    ("time(6)", "i don't know"), ("numeric", "i don't know"),
]


def test_map_type_rule_table(spark):
    df = spark.createDataFrame(MAP_CASES, "data_type string, want string")
    out = cat.map_type(df).collect()
    for r in out:
        assert r["target_type"] == r["want"], r


def test_map_type_extended(spark):
    df = spark.createDataFrame([("boolean",), ("array(varchar)",)], "data_type string")
    got = [r[0] for r in cat.map_type(df, extended=True).select("target_type").collect()]
    assert got == ["boolean", "array"]


def test_type_name_renderer(spark):
    st = spark.createDataFrame([], "a bigint, b decimal(12,2), c timestamp_ntz, d array<string>, "
                                   "e map<string,string>, f struct<x:int>").schema
    assert [type_name(f.dataType) for f in st.fields] == [
        "bigint", "decimal(12,2)", "timestamp(6)", "array(varchar)", "map(varchar, varchar)",
        "row(x integer)"]


def test_schema_infer_by_name(spark):
    ds = spark.createDataFrame([("d1", "sap_orders"), ("d2", "salesforce_accounts"),
                                ("d3", "workday_salaries"), ("d4", "jira_issues"), ("d5", "ga")],
                               "dataset_id string, name string")
    out = cat.schema_infer_by_name(spark, ds)
    first = {r["dataset_id"]: r["column_name"] for r in out.where("ordinal = 1").collect()}
    assert first == {"d1": "order_id", "d2": "customer_id", "d3": "txn_id", "d4": "ticket_id", "d5": "id"}
