import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from veilspark import MaskingPolicy, RoleBook, SourceCatalog, TokenKeys  # noqa: E402

SECRET = "veilspark example key, for tests and registered queries only"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def keys(spark):
    return TokenKeys(spark, SECRET)


# What the tests need: names that become tokens (one namespace under names in two languages, others beside it),
# numbers and addresses that are masked in part, two columns nobody sees, and facts that pass.
_TOKENS = {
    ("customer", "CUST"): ["customer_name", "client_name", "客户姓名"],
    ("employee", "EMP"): ["employee_name"],
    ("supplier", "SUP"): ["supplier_name"],
    ("bill", "BILL"): ["bill_no"],
}
POLICY_DOC = {
    "defaults": {"unknown_column": "deny", "tokenizer_placeholders": ["", "N/A", "null"]},
    "table_overrides": {},
    "rules": [
        {"columns": ["id", "status", "type", "code", "org_name", "level_1", "n_year", "n_period", "amount", "total"], "action": "passthrough"},
        {"columns": ["id_card", "remark"], "action": "deny"},
        {"columns": ["phone", "手机号"], "action": "mask_phone"},
        {"columns": ["email"], "action": "mask_email"},
        *[{"columns": c, "action": "tokenize", "namespace": n, "prefix": p} for (n, p), c in _TOKENS.items()],
    ],
}

ROLES_DOC = {
    "roles": {
        "viewer": {"allowed_tables": ["v_view"], "max_rows": 1000, "timeout_seconds": 10,
                   "max_concurrent": 2},
        "developer": {
            "allowed_tables": ["Summary", "detail", "dimension", "v_view"],
            "max_rows": 5000, "timeout_seconds": 30, "max_concurrent": 5, "allow_explain": True,
            "allow_union": True, "max_union_depth": 2, "allow_generic_query": True,
            "allow_audit_log": True,
        },
    },
    "large_tables": ["detail"],
}

SOURCES_DOC = {
    "datasources": [
        {"name": "default", "type": "mysql", "database": "shop"},
        {"name": "ss", "type": "sqlserver", "database": "testdb"},
    ],
    "table_routing": [{"pattern": "ss_*", "datasource": "ss"}, {"pattern": "*", "datasource": "default"}],
}


@pytest.fixture(scope="session")
def policy():
    return MaskingPolicy.from_document(POLICY_DOC)


@pytest.fixture(scope="session")
def book():
    return RoleBook.from_document(ROLES_DOC)


@pytest.fixture(scope="session")
def sources():
    return SourceCatalog.from_document(SOURCES_DOC)
