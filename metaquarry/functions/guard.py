"""Column expressions that decide whether a SQL text is one read-only statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaquarry.functions.text import strip

# Statement starts that may pass and keywords that never may.
READ_STARTS = ("SELECT", "WITH")
DENIED = (
    "INSERT",
    "UPDATE",
    "DELETE",
    "DROP",
    "ALTER",
    "TRUNCATE",
    "CREATE",
    "GRANT",
    "REVOKE",
    "CALL",
    "MERGE",
)
COMMENT_PATTERN = r"(?s)(--[^\n]*\n)|(/\*.*?\*/)"
WORD_EDGE_LEFT, WORD_EDGE_RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def strip_comments(sql: Column) -> Column:
    """Comments become one blank. A ``--`` comment needs its newline to count as one."""
    return F.regexp_replace(sql, COMMENT_PATTERN, " ")


def statements(cleaned: Column) -> Column:
    return F.filter(F.transform(F.split(cleaned, ";"), strip), lambda s: s != "")


def single_statement(cleaned: Column) -> Column:
    return F.coalesce(F.size(statements(cleaned)) == 1, F.lit(False))


def first_statement(cleaned: Column) -> Column:
    return F.upper(F.coalesce(F.get(statements(cleaned), F.lit(0)), F.lit("")))


def is_read_only_prefix(statement: Column) -> Column:
    return F.upper(statement).rlike("^(" + "|".join(READ_STARTS) + ")")


def _has_word(statement: Column, words: str) -> Column:
    return F.upper(statement).rlike(f"{WORD_EDGE_LEFT}({words}){WORD_EDGE_RIGHT}")


def has_denied_keyword(statement: Column) -> Column:
    return _has_word(statement, "|".join(DENIED))


def denied_keywords(statement: Column) -> Column:
    """The denied keywords found, in list order."""
    pattern = f"{WORD_EDGE_LEFT}({'|'.join(DENIED)})(?={WORD_EDGE_RIGHT})"
    found = F.regexp_extract_all(F.upper(statement), F.lit(pattern), F.lit(2))
    return F.array_intersect(F.array(*[F.lit(w) for w in DENIED]), found)


def is_safe_sql(sql: Column) -> Column:
    cleaned = strip_comments(sql)
    first = first_statement(cleaned)
    return F.coalesce(
        single_statement(cleaned) & is_read_only_prefix(first) & ~has_denied_keyword(first),
        F.lit(False),
    )


#: The strict lexer's tokens: what opens or closes something, and runs of anything else.
_TOKEN = r"""(?s)--|/\*|\*/|''|""|``|['"`\n]|[^-/*'"`\n]+|."""
#: Mode that an opening token starts, and what ends it and stands for it afterwards. A quote
#: written twice inside is one of its characters.
_OPENS = {"--": "line", "/*": "block", "'": "text", '"': "name", "`": "tick"}
_CLOSES = {"line": ("\n", " "), "block": ("*/", " "), "text": ("'", "''"), "name": ('"', " x "), "tick": ("`", " x ")}


def lexed(sql: Column) -> Column:
    """struct(code, open): the text with comments as blanks, literals as ``''`` and quoted names
    as a word, and what is still open at its end: empty, or the mode of an unclosed token.

    A finite automaton folded over the tokens; its counter makes block comments nest.
    """

    def step(state: Column, token: Column) -> Column:
        mode = state["mode"]
        next_mode, added = F.lit("code"), token
        for opening, name in _OPENS.items():
            next_mode = F.when(token == opening, name).otherwise(next_mode)
            added = F.when(token == opening, "").otherwise(added)
        for name, (closing, stands) in _CLOSES.items():
            ends = token == closing
            if name == "block":
                ends = ends & (state["depth"] == 1)
            next_mode = F.when(mode == name, F.when(ends, "code").otherwise(name)).otherwise(next_mode)
            added = F.when(mode == name, F.when(ends, stands).otherwise("")).otherwise(added)
        change = F.when(token == "/*", 1).when((mode == "block") & (token == "*/"), -1).otherwise(0)
        depth = F.when(next_mode == "block", state["depth"] + change).otherwise(0)
        kept = F.when(added == "", state["kept"]).otherwise(F.array_append(state["kept"], added))
        return F.struct(next_mode.alias("mode"), depth.cast("int").alias("depth"), kept.alias("kept"))

    start = F.struct(
        F.lit("code").alias("mode"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept")
    )
    # a line comment ends with the text at the latest
    unclosed = lambda mode: F.when(mode.isin("code", "line"), "").otherwise(mode)
    return F.aggregate(
        F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0)),
        start,
        step,
        lambda s: F.struct(F.array_join(s["kept"], "").alias("code"), unclosed(s["mode"]).alias("open")),
    )


def is_safe_code(code: Column) -> Column:
    """One statement that starts with a whole word of READ_STARTS, without denied keywords."""
    first = first_statement(code)
    starts = first.rlike("^(" + "|".join(READ_STARTS) + ")" + WORD_EDGE_RIGHT)
    return single_statement(code) & starts & ~has_denied_keyword(first)


def is_safe_sql_strict(sql: Column) -> Column:
    """Like ``is_safe_sql``, but semicolons and keywords inside literals, quoted names and
    comments do not count, block comments nest, and nothing may be left open. Null is unsafe."""
    whole = F.transform(F.array(lexed(sql)), lambda s: (s["open"] == "") & is_safe_code(s["code"]))
    return F.coalesce(F.element_at(whole, 1), F.lit(False))


def block_reasons(model_flag: Column, count: Column, statement: Column, keywords: Column) -> Column:
    """Why a statement is blocked, as an array of reason names; empty when it may pass.

    ``count`` is the number of statements found, ``statement`` the first of them.
    """
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(model_flag, F.lit(False)), "model_flag"),
            F.when(count == 0, "empty"),
            F.when(count > 1, "multiple_statements"),
            F.when((count == 1) & ~is_read_only_prefix(statement), "not_read_only"),
            F.when((count == 1) & (F.size(keywords) > 0), "denied_keyword"),
        )
    )


# The reply texts.
BLOCKED_PREFIX = "检测到生成的 SQL 包含非安全操作，已被拦截。\n解释: "
PASSED_OPEN, PASSED_CLOSE = "```sql\n", "\n```\n\n**解释**: "


def gate_message(passes: Column, sql: Column, explanation: Column) -> Column:
    why = F.coalesce(explanation, F.lit(""))
    return F.when(
        passes, F.concat(F.lit(PASSED_OPEN), sql, F.lit(PASSED_CLOSE), why)
    ).otherwise(F.concat(F.lit(BLOCKED_PREFIX), why))
