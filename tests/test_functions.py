import contextlib
import hashlib
import hmac
import io
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tests.conftest import SECRET
from veilspark.frames import local_frame
from veilspark.functions import sqltext
from veilspark.functions import (
    TokenKeys,
    audit_local_time,
    hash_id,
    mask_email,
    mask_phone,
    normalize_text,
    redact_literals,
    residual_scan,
    sql_fingerprint,
    tokenize,
)
from veilspark.functions.masking import residual_hit


def strings(spark, values):
    return local_frame(spark, [(i, v) for i, v in enumerate(values)], "i int, s string")


def apply(spark, values, expr):
    rows = strings(spark, values).select("i", expr.alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


# value, namespace, prefix, token
GOLDEN = [
    ("北岸灯塔贸易行", "customer", "CUST", "CUST_V1_F4E6403F8727C501"),
    ("陈一鸣", "customer", "CUST", "CUST_V1_1A291822DC53DA5C"),
    ("陈一鸣", "employee", "EMP", "EMP_V1_3A94387A4BD96135"),
    ("北岸  灯塔  贸易行", "customer", "CUST", "CUST_V1_15F75D47F1DF383C"),
    ("北岸 灯塔 贸易行", "customer", "CUST", "CUST_V1_15F75D47F1DF383C"),
    ("  甲方Q  ", "customer", "CUST", "CUST_V1_DAA0652EAD3452ED"),
    ("甲方Q", "customer", "CUST", "CUST_V1_DAA0652EAD3452ED"),
    ("ＱＲＳ", "customer", "CUST", "CUST_V1_27A69F859FC5C3C9"),
    ("QRS", "customer", "CUST", "CUST_V1_27A69F859FC5C3C9"),
    ("BL-77-0041", "bill", "BILL", "BILL_V1_22103C5427099A47"),
    ("Customer#000000000", "customer", "CUST", "CUST_V1_D7818C1825C2F944"),
    ("Supplier#000000000", "supplier", "SUP", "SUP_V1_1BAE49F48B8A3947"),
    ("x", "", "", "_V1_6CF6D53B6E7E2096"),
]


@pytest.mark.parametrize("engine", ["jvm", "python"])
def test_golden_tokens(spark, keys, engine):
    for value, ns, prefix, token in GOLDEN:
        assert apply(spark, [value], tokenize(F.col("s"), ns, prefix, keys, engine=engine)) == [token]


def test_placeholders_and_blanks_stay(spark, keys):
    values = ["", "N/A", "null", "   ", "\t\u3000\x1c", None, " N/A"]
    got = apply(spark, values, tokenize(F.col("s"), "c", "C", keys, ["", "N/A", "null"]))
    assert got[:6] == values[:6]
    assert got[6].startswith("C_V1_")  # placeholders are compared raw


def python_normal(s):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s).strip())


def every_code_point():
    return [
        f"{chr(c)}a {chr(c)}{chr(c)}\u0301b{chr(c)}"
        for c in range(1, 0x30000)
        if not 0xD800 <= c <= 0xDFFF
        # Assigned after the interpreter's Unicode tables were made.
        and unicodedata.category(chr(c)) != "Cn"
    ]


@pytest.mark.parametrize("engine", ["jvm", "python"])
def test_normalising_agrees_with_python_for_every_character(spark, engine):
    values = every_code_point()
    df = strings(spark, values).repartition(8, "i")
    rows = df.select("i", normalize_text(F.col("s"), engine).alias("r")).collect()
    wrong = [hex(ord(values[r.i][0])) for r in rows if r.r != python_normal(values[r.i])]
    assert wrong == []


def test_normalising_blanks(spark):
    values = ["a b", " a", "a ", "a  b", " ", "", "a b c d", "a\tb", "  a  b  ", "\x00a", "a\x7f", "a b\n", None]
    got = apply(spark, values, normalize_text(F.col("s")))
    assert got == [None if v is None else python_normal(v) for v in values]


def test_blank_means_the_same_as_in_python(spark, keys):
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    values = [c + c for c in chars if unicodedata.category(c) != "Cn"]
    kept = tokenize(F.col("s"), "n", "P", keys, []) == F.col("s")
    rows = strings(spark, values).select("i", kept.alias("kept")).collect()
    assert all(r.kept == (python_normal(values[r.i]) == "") for r in rows)


def test_token_is_plain_hmac(spark):
    rng = random.Random(5)
    values = ["".join(rng.choices("abcXYZ 09é中Ⅷ", k=rng.randint(1, 30))) + "z" for _ in range(300)]
    for secret in ("k", "x" * 64, "y" * 200, SECRET):
        got = apply(spark, values, tokenize(F.col("s"), "ns", "P", TokenKeys(spark, secret)))
        want = [
            "P_V1_"
            + hmac.new(secret.encode(), f"ns:{python_normal(v)}".encode(), hashlib.sha256)
            .hexdigest()[:16].upper()
            for v in values
        ]
        assert got == want


def test_secret_never_shows(spark, keys, capsys):
    df = strings(spark, ["a", "b"]).select(tokenize(F.col("s"), "c", "C", keys).alias("t"))
    df.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        for mode in ("extended", "codegen", "cost", "formatted"):
            df.explain(mode)
    text = out.getvalue().lower() + str(df._jdf.queryExecution().toString()).lower()
    inner = bytes(b ^ 0x36 for b in SECRET.encode()).hex()
    outer = bytes(b ^ 0x5C for b in SECRET.encode()).hex()
    for needle in (SECRET.lower(), inner[:16], outer[:16], SECRET.encode().hex()[:16]):
        assert needle not in text


def test_missing_secret_raises(spark, monkeypatch):
    monkeypatch.delenv("HMAC_SECRET", raising=False)
    with pytest.raises(RuntimeError):
        TokenKeys.from_env(spark)
    with pytest.raises(RuntimeError):
        TokenKeys(spark, "")


def test_mask_phone(spark):
    values = ["13812345678", "123", "1234567", "", None, "123456", "电话一二三四五六七", "+86 138 1234 5678"]
    assert apply(spark, values, mask_phone(F.col("s"))) == [
        "138****5678", "***", "123****4567", "", None, "***", "电话一****四五六七", "+86****5678",
    ]


def test_mask_email(spark):
    values = ["zhangsan@example.com", "a@test.com", "notanemail", "@x.com", "a@b@c.d", "", None, "ab@", "@", "名字@a"]
    assert apply(spark, values, mask_email(F.col("s"))) == [
        "z***@example.com", "*@test.com", "***", "*@x.com", "a***@c.d", "", None, "a***@", "*@", "名***@a",
    ]


def python_scan(s):
    if re.search(r"(?<!\d)\d{17}[\dXx](?!\d)", s):
        return "[已遮掩:疑似证件号]"
    if re.search(r"(?<!\d)\d{16,19}(?!\d)", s):
        return "[已遮掩:疑似银行卡号]"
    if re.search(r"(?<!\d)1[3-9]\d{9}(?!\d)", s):
        return "[已遮掩:疑似手机号]"
    return s


def test_residual_scan(spark):
    fixed = [
        "报销联系电话13812345678", "身份证号110101199001011234", "银行卡号6222021234567890123",
        "12345678901234567X", "12345678901234567x9", "12345678901234567890", "12812345678", "138123456789",
        "１３８１２３４５６７８", "13812345678,6222021234567890123", "abc", "", None,
    ]
    rng = random.Random(1)
    runs = [
        "".join(
            rng.choice(["a", " ", "X", "x", "-", "1", "13", "1399", "٣"])
            + "".join(rng.choices("0123456789", k=rng.choice([0, 3, 9, 10, 11, 14, 15, 16, 17, 18, 19, 20])))
            for _ in range(rng.randint(1, 3))
        )
        for _ in range(2000)
    ]
    values = fixed + runs
    got = apply(spark, values, residual_scan(F.col("s")))
    assert got == [None if v is None else python_scan(v) for v in values]
    hits = apply(spark, values, residual_hit(F.col("s")))
    assert hits == [v is not None and python_scan(v) != v for v in values]


def test_hash_id(spark):
    got = apply(spark, ["abc", "中"], hash_id(F.col("s")))
    assert got == ["sha256:" + hashlib.sha256(v.encode()).hexdigest() for v in ("abc", "中")]


def test_fingerprint(spark):
    text = "SELECT amount FROM t WHERE n_year = ?"
    assert apply(spark, [text], sql_fingerprint(F.col("s"))) == ["sha256:68ea710efd1e50d4"]


REDACTED = [
    ("SELECT a FROM t WHERE n_year = 2026 AND p = 6", "SELECT a FROM t WHERE n_year = ? AND p = ?"),
    ("SELECT a1, t2.b3 FROM t2 WHERE x IN ('a', 'b', 1.5e-3)", "SELECT a1, t2.b3 FROM t2 WHERE x IN (?, ?, ?)"),
    ("WHERE n = 'it''s 13812345678' AND m='x\\'y'", "WHERE n = ? AND m=?"),
    ("WHERE n = N'abc'  AND\n\t h = 0xFF", "WHERE n = ? AND h = ?"),
    ("SELECT 1 -- secret 42 don't\n, 2 /* 'x */ FROM t # it's 5", "SELECT ? , ? FROM t"),
    ("WHERE n = '--no comment' AND k = 1", "WHERE n = ? AND k = ?"),
    ("WHERE n = 'open AND k = 1", "<unparseable>"),
    ('WHERE n = "13812345678" AND k = \'a"b\'', "WHERE n = ? AND k = ?"),
    ('WHERE n = "open', "<unparseable>"),
    ("", ""),
]


def test_redaction(spark):
    got = apply(spark, [t for t, _ in REDACTED], redact_literals(F.col("s")))
    assert got == [r for _, r in REDACTED]


def test_redaction_by_dialect(spark):
    got = apply(spark, ["WHERE \"col name\" = 'C:\\' AND x = 1"], redact_literals(F.col("s"), F.lit("tsql")))
    assert got == ['WHERE "col name" = ? AND x = ?']


def test_redaction_of_very_long_literals(spark):
    long = "WHERE a = '" + "x''y\\\\" * 20_000 + "' AND b = 5 /*" + "q" * 50_000 + "*/"
    assert apply(spark, [long], redact_literals(F.col("s"))) == ["WHERE a = ? AND b = ?"]


@pytest.mark.parametrize(
    "zone, text",
    [
        ("Asia/Shanghai", "2024-01-01T08:00:00.000005+08:00"),
        ("Asia/Tokyo", "2024-01-01T09:00:00.000005+09:00"),
        ("UTC", "2024-01-01T00:00:00.000005+00:00"),
        ("America/Los_Angeles", "2023-12-31T16:00:00.000005-08:00"),
        ("America/New_York", "2023-12-31T19:00:00.000005-05:00"),
        ("Europe/London", "2024-01-01T00:00:00.000005+00:00"),
        ("Nowhere", "2024-01-01T08:00:00.000005+08:00"),
    ],
)
def test_local_time(spark, zone, text):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00.000005' AS ts")
    assert df.select(audit_local_time(F.col("ts"), zone).alias("t")).first().t == text


def test_local_time_without_fraction(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-07-01 00:00:00' AS ts")
    assert df.select(audit_local_time(F.col("ts")).alias("t")).first().t == "2024-07-01T08:00:00+08:00"


@pytest.mark.parametrize(
    "sql, dialect, want",
    [
        ("SELECT `it's` FROM t WHERE x = 'secret' AND `p's` = 1", "mysql", "SELECT `it's` FROM t WHERE x = ? AND `p's` = ?"),
        ("SELECT [it's] FROM t WHERE x = 'secret' AND [p's] = 1", "tsql", "SELECT [it's] FROM t WHERE x = ? AND [p's] = ?"),
        ("SELECT $tag$secret$tag$, $$x$$", "postgres", "SELECT ?, ?"),
        ("SELECT a FROM t WHERE b > .75", "mysql", "SELECT a FROM t WHERE b > ?"),
        ("SELECT a FROM `t 2`", "mysql", "SELECT a FROM `t 2`"),
        ("SELECT 'open", "mysql", "<unparseable>"),
    ],
)
def test_names_and_odd_values_are_told_apart(spark, sql, dialect, want):
    df = spark.createDataFrame([(sql, dialect)], "q string, d string")
    assert df.select(sqltext.redact_literals(F.col("q"), F.col("d")).alias("r")).first().r == want


@pytest.mark.parametrize(
    "sql, dialect, banned, locks",
    [
        ("SELECT `sleep`(5)", "mysql", "sleep", False),
        ("EXEC [xp_cmdshell]('x')", "tsql", "xp_cmdshell", False),
        ("SELECT a into/**/outfile 'f'", "mysql", "INTO OUTFILE/DUMPFILE", False),
        ("SELECT a FROM t for/**/update", "mysql", None, True),
        ("SELECT a FROM t with/**/(nolock)", "tsql", None, True),
        ("SELECT 'sleep(1)'", "mysql", None, False),
    ],
)
def test_quotes_and_comments_hide_nothing(spark, sql, dialect, banned, locks):
    df = spark.createDataFrame([(sql, dialect)], "q string, d string")
    q, d = F.col("q"), F.col("d")
    row = df.select(sqltext.banned_function(q, d).alias("b"), sqltext.has_lock(q, d).alias("l")).first()
    assert (row.b, row.l) == (banned, locks)
