"""Lexical facts about SQL text kept in a query log.

No statement is parsed here. A text is cut into tokens once, by one pattern of its
dialect; whatever is asked of it afterwards reads the array. Structure (tables,
columns, shape) arrives as fact tables instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UNPARSEABLE = "<unparseable>"

# Banned routines per dialect, system schemas, lock hints, and the
# shape of a user variable.
BANNED_FUNCTIONS = {
    "mysql": (
        "load_file", "sleep", "benchmark",
        "get_lock", "release_lock", "is_free_lock", "is_used_lock",
        "sys_exec", "sys_eval", "sys_get",
        "into_outfile", "into_dumpfile",
    ),
    "tsql": (
        "xp_cmdshell", "xp_regread", "xp_regwrite", "xp_regdeletevalue",
        "xp_servicecontrol", "xp_terminate_process",
        "sp_oacreate", "sp_oamethod", "sp_oagetproperty", "sp_oasetproperty",
        "openrowset", "opendatasource",
        "bulk_insert",
        "sp_configure", "sp_executesql",
    ),
}
SYSTEM_SCHEMAS = {
    "mysql": ("mysql", "sys", "performance_schema", "information_schema"),
    "tsql": ("master", "tempdb", "model", "msdb", "information_schema"),
}
LOCK_HINTS = (
    "NOLOCK", "UPDLOCK", "XLOCK", "ROWLOCK", "TABLOCK", "PAGLOCK", "HOLDLOCK", "SERIALIZABLE",
)

USER_VARIABLE = r"(?<!@)@[a-zA-Z_]"

# Quoted text by dialect: only MySQL has backslash escapes and treats double
# quotes as strings. Elsewhere a double-quoted word is a name and stays.
# Possessive loops keep the matcher linear and off the stack on long literals.
_MYSQL_STRING = (
    r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'" + "|" + r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"'
)
_PLAIN_STRING = r"'[^']*+(?:''[^']*+)*+'"
_DOLLAR_STRING = r"(?<![\w$])\$(?<tag>\w*+)\$.*?\$\k<tag>\$"
_MYSQL_NAME = r"`[^`]*+(?:``[^`]*+)*+`"
_NAME = r'"[^"]*+(?:""[^"]*+)*+"'
_TSQL_NAME = rf"{_NAME}|\[[^\]]*+(?:\]\][^\]]*+)*+\]"
_MYSQL_COMMENT = r"--[^\n]*|#[^\n]*|/\*.*?\*/"
_PLAIN_COMMENT = r"--[^\n]*|/\*.*?\*/"
_NUMBER = r"(?:(?=\d)(?<![\w.])(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)(?!\w)|(?<![\w.)\]])\.\d+(?:[eE][+-]?\d+)?(?!\w))"
_BLANKS = r" \s+|[\t\n\x0b\f\r]\s*"
#: A word runs on over dots, so that the parts of a dotted name are never taken for numbers.
_WORD = r"[)\]]\.\d\w*+|\w++(?:\.\w++)*+"
_OTHER = r"\s++|[^\w\s'\"`\[\]$#/.)-]++|."


def _lexer(comments: str, strings: str, names: str) -> str:
    return rf"(?s){comments}|(?<!\w)[nN]?(?:{strings})|{names}|{_NUMBER}|{_WORD}|{_OTHER}"


_LEXERS = {
    "mysql": _lexer(_MYSQL_COMMENT, _MYSQL_STRING, _MYSQL_NAME),
    "tsql": _lexer(_PLAIN_COMMENT, _PLAIN_STRING, _TSQL_NAME),
    "postgres": _lexer(_PLAIN_COMMENT, f"{_PLAIN_STRING}|{_DOLLAR_STRING}", _NAME),
}
_WHOLE_NUMBER = r"^(?:0[xX][0-9a-fA-F]+|\d*\.?\d*(?:[eE][+-]?\d+)?)$"

#: Kinds of tokens.
STRING, NUMBER, NAME, COMMENT, OPEN, CODE = "string", "number", "name", "comment", "open", "code"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _by_dialect(dialect: Column, mysql: Column, tsql: Column, postgres: Column) -> Column:
    return F.when(dialect == "mysql", mysql).when(dialect == "tsql", tsql).otherwise(postgres)


def _dialect(dialect: Column | None) -> Column:
    return F.lit("mysql") if dialect is None else F.coalesce(dialect, F.lit("mysql"))


#: How tokens begin that may be anything but code.
_SPECIAL = tuple("'\"`[$-/#.nN0123456789")


def _kind(token: Column, dialect: Column) -> Column:
    first, longer = F.substring(token, 1, 1), F.length(token) > 1
    double = F.when(dialect == "mysql", STRING).otherwise(NAME)
    bracket = (dialect == "tsql") & longer
    return (
        F.when(~first.isin(*_SPECIAL), CODE)
        .when(first.isin("'", '"', "`") & ~longer, F.when((first != "`") | (dialect == "mysql"), OPEN).otherwise(CODE))
        .when(first == "'", STRING)
        .when(first == '"', double)
        .when(first == "`", NAME)
        .when(first == "[", F.when(bracket, NAME).otherwise(CODE))
        .when(first == "$", F.when(longer, STRING).otherwise(CODE))
        .when(token.startswith("--") | token.startswith("/*") | ((first == "#") & (dialect == "mysql")), COMMENT)
        .when(first.rlike("[0-9.]"), F.when(longer | (first != "."), F.when(token.rlike(_WHOLE_NUMBER), NUMBER).otherwise(CODE)).otherwise(CODE))
        .when(first.isin("n", "N") & F.substring(token, 2, 1).isin("'", '"'), STRING)
        .otherwise(CODE)
    )


def sql_tokens(sql: Column, dialect: Column | None = None) -> Column:
    """``array<struct<kind, token>>`` of a text: the tokens put together give the text again.

    A quote that nothing closes is a token of its own, of kind ``open``.
    """
    dialect = _dialect(dialect)
    texts = _by_dialect(dialect, *[F.regexp_extract_all(sql, F.lit(_LEXERS[d]), F.lit(0)) for d in ("mysql", "tsql", "postgres")])
    return F.transform(texts, lambda t: F.struct(_kind(t, dialect).alias("kind"), t.alias("token")))


def _joined(tokens: Column, strings: str | None, numbers: str | None, bare_names: bool) -> Column:
    """The text of the tokens, comments as blanks; strings and numbers as given, null as they are."""

    def text(t: Column) -> Column:
        out = F.when(t.kind == COMMENT, F.lit(" "))
        if strings is not None:
            out = out.when(t.kind == STRING, F.lit(strings))
        if numbers is not None:
            out = out.when(t.kind == NUMBER, F.lit(numbers))
        if bare_names:
            out = out.when(t.kind == NAME, F.regexp_replace(t.token, r"[`\"\[\]]", ""))
        return out.otherwise(t.token)

    return F.array_join(F.transform(tokens, text), "")


def _redacted(tokens: Column) -> Column:
    text = F.trim(F.regexp_replace(_joined(tokens, "?", "?", False), _BLANKS, " "))
    return F.when(F.exists(tokens, lambda t: t.kind == OPEN), F.lit(UNPARSEABLE)).otherwise(text)


def redact_literals(sql: Column, dialect: Column | None = None) -> Column:
    """Replace every string and number by ``?`` and drop comments.

    An unbalanced quote cannot be redacted with confidence; it gives a mark.
    """
    return _let(sql_tokens(sql, dialect), _redacted)


def capped_text(redacted: Column, dialect: Column) -> Column:
    """The redacted text of a SELECT that had no row limit, with the one it was run with.

    T-SQL has it behind SELECT; a statement that starts otherwise (WITH) stays as it is.
    """
    top = F.regexp_replace(redacted, r"(?i)^(select(?:\s+(?:distinct|all))?)\b", "$1 TOP ?")
    limited = F.concat(F.regexp_replace(redacted, r"[;\s]+$", ""), F.lit(" LIMIT ?"))
    return F.when(redacted == UNPARSEABLE, redacted).when(dialect == "tsql", top).otherwise(limited)


def sql_fingerprint(normalized: Column) -> Column:
    digest = F.sha2(normalized.cast("binary"), 256)
    return F.concat(F.lit("sha256:"), F.substring(digest, 1, 16))


def has_user_variable(sql: Column) -> Column:
    return sql.contains("@") & sql.rlike(USER_VARIABLE)


#: Words without which a text neither locks nor calls anything banned; most texts have none and are not cut up.
_SUSPECT = r"(?i)update|share|outfile|dumpfile|bulk|with|" + "|".join(sorted({n for names in BANNED_FUNCTIONS.values() for n in names}))


def _locks(tokens: Column, dialect: Column) -> Column:
    """Locking reads in any dialect, table hints in T-SQL only. Quotes and comments hide nothing."""

    def found(code: Column) -> Column:
        share = _joined(tokens, "?", None, True).rlike(r"(?i)\bfor\s+share\b")
        hints = rf"(?i)with\s*\(\s*({'|'.join(LOCK_HINTS)})"
        return code.rlike(r"(?i)for\s+update|lock\s+in\s+share\s+mode") | ((dialect == "tsql") & code.rlike(hints)) | share

    return _let(_joined(tokens, None, None, True), found)


def _banned(tokens: Column, dialect: Column) -> Column:
    """A name inside a string is no call; a clause is looked for everywhere."""

    def called(text: Column, kind: str) -> Column:
        names = "|".join(BANNED_FUNCTIONS[kind])
        return F.nullif(F.regexp_extract(text, rf"(?i)(?<![\w@])({names})\s*\(", 1), F.lit(""))

    def clause(pattern: str, name: str) -> Column:
        return F.when(_joined(tokens, None, None, True).rlike(pattern), F.lit(name))

    def found(text: Column) -> Column:
        mysql = F.coalesce(called(text, "mysql"), clause(r"(?i)into\s+(outfile|dumpfile)", "INTO OUTFILE/DUMPFILE"))
        tsql = F.coalesce(called(text, "tsql"), clause(r"(?i)bulk\s+insert", "BULK INSERT"))
        return _by_dialect(dialect, mysql, tsql, called(text, "mysql"))

    return _let(_joined(tokens, "?", "?", True), found)


def text_flags(sql: Column, dialect: Column | None = None) -> Column:
    """``struct<locks: boolean, banned: string>``: what ``has_lock`` and ``banned_function`` say, from one cutting."""
    dialect = _dialect(dialect)

    def flags(tokens: Column) -> Column:
        return F.struct(_locks(tokens, dialect).alias("locks"), _banned(tokens, dialect).alias("banned"))

    none = F.struct(F.lit(False).alias("locks"), F.lit(None).cast("string").alias("banned"))
    return F.when(sql.rlike(_SUSPECT), _let(sql_tokens(sql, dialect), flags)).otherwise(none)


def has_lock(sql: Column, dialect: Column) -> Column:
    """Whether a text takes locks: locking reads in any dialect, table hints in T-SQL only."""
    return text_flags(sql, dialect)["locks"]


def banned_function(sql: Column, dialect: Column) -> Column:
    """Name of the first banned routine or clause in the text, else null."""
    return text_flags(sql, dialect)["banned"]


def system_schema(name: Column, dialect: Column) -> Column:
    lowered = F.lower(name)
    return F.when(dialect == "tsql", lowered.isin(*SYSTEM_SCHEMAS["tsql"])).otherwise(
        lowered.isin(*SYSTEM_SCHEMAS["mysql"])
    )
