"""Bulk screening of logged SQL text: is each statement a read-only SELECT
over the allowed tables?

This screens text in a DataFrame column (query logs, generated statements);
the engine never executes untrusted SQL. Two rule sets:

``compat``: the original rules. Strip whitespace and trailing ';', lower-case;
must start with "select"; must not contain any forbidden word or ';' as a
substring; every identifier right after "from"/"join" must be allowed.

``strict``: reads the statement's shape with a lexer: one regex cuts the text into
the few tokens that matter, and one fold over them keeps a state: inside a string
literal or not, whether a FROM list is open on the current level of parentheses, and
the levels around it as a packed stack. It rejects comments, identifier quotes,
unterminated literals, backslashes outside of literals, INTO, TABLE and the forbidden
words (whole words, outside of literals); every name after FROM or JOIN has to be
exactly an allowed table (no qualified names); a parenthesis after FROM or JOIN opens
a SELECT; no comma separates tables in any FROM clause, at any depth; parentheses are
balanced. The FROM inside EXTRACT / TRIM / SUBSTRING / OVERLAY(...) is an argument.
On what is left the name rule of ``compat`` holds too, so a statement that reads
another table passes ``strict`` only if it passes that rule; what ``strict`` accepts
and ``compat`` does not are forbidden words in literals or as parts of longer names,
and the FROM of the functions named above. Both take statements of any length and
depth: the time grows with the length, and no regex repeats a group, which is what
Java's engine does by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.parsing import PY_SPACE, py_strip

# Forbidden words and the allowed table set.
FORBIDDEN = ["insert", "update", "delete", "drop", "alter", "create",
             "truncate", "grant", "attach", "pragma"]
ALLOWED_TABLES = ["flights"]

_NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"


def _prepare(sql: Column) -> Column:
    # str.strip(), then drop trailing ';' characters, then lower-case
    return F.lower(F.rtrim(py_strip(sql), F.lit(";")))


def _names_allowed(names: Column, allowed: list[str]) -> Column:
    """Every extracted name is an allowed table (true for no names)."""
    if len(allowed) == 1:
        # one allowed name: all equal it iff min and max equal it; no array
        # is allocated, unlike array_except (empty array -> NULL -> true)
        only = F.lit(allowed[0])
        return F.coalesce((F.array_min(names) == only) & (F.array_max(names) == only), F.lit(True))
    allowed_arr = F.array(*[F.lit(t) for t in allowed])
    return F.size(F.array_except(names, allowed_arr)) == 0


def _names_ok(s: Column, allowed: list[str]) -> Column:
    """Every identifier right behind "from" or "join" is an allowed table."""
    from_names = F.regexp_extract_all(s, F.lit(rf"from{PY_SPACE}+({_NAME})"), F.lit(1))
    join_names = F.regexp_extract_all(s, F.lit(rf"join{PY_SPACE}+({_NAME})"), F.lit(1))
    return _names_allowed(from_names, allowed) & (~s.contains("join") | _names_allowed(join_names, allowed))


def _compat_rules(s: Column, allowed: list[str]) -> Column:
    """Compat verdict on prepared text ``s``."""
    no_forbidden = ~F.lit(False)
    for word in FORBIDDEN + [";"]:
        no_forbidden = no_forbidden & ~s.contains(F.lit(word))
    return F.coalesce(s.startswith("select") & no_forbidden & _names_ok(s, allowed), F.lit(False))


def _is_word_char(c: Column) -> Column:
    # [a-z0-9_] on one (lower-cased) character, without a regex
    return ((c >= "a") & (c <= "z")) | ((c >= "0") & (c <= "9")) | (c == "_")


# What ends a FROM clause on its own level, and the functions whose
# arguments may be separated by FROM.
AFTER_FROM = ["where", "group", "having", "order", "limit", "union", "intersect", "except", "window", "offset", "fetch"]
FROM_FUNCTIONS = ["extract", "trim", "substring", "overlay"]

_SPACES = PY_SPACE[1:-1]


_WORD = "[a-z0-9_]"


# The tokens. All runs are possessive and none is a repeated group; no token holds
# a quote or a backslash, but for these two themselves, so that a literal's end
# is always a token.
_AT_WORD = "|".join([
    # FROM or JOIN with the name behind it, and a dot behind that
    rf"(?:from|join)(?!{_WORD}){PY_SPACE}*+[^{_SPACES}(),;'\"`#\\]*+(?:{PY_SPACE}*+\.)?+",
    rf"(?:{'|'.join(FROM_FUNCTIONS)}){PY_SPACE}*+\({PY_SPACE}*+(?:select(?!{_WORD}))?+",
    rf"(?:{'|'.join(AFTER_FROM + FORBIDDEN + ['into', 'table'])})(?!{_WORD})",
])
_TOKEN = "|".join([
    rf"(?<!{_WORD})(?=[a-z])(?:{_AT_WORD})",
    # the letters of FROM or JOIN at the end of a longer word: the name rule of compat
    rf"{_WORD}(?:from|join)(?:{PY_SPACE}++{_NAME}|(?={PY_SPACE}*+\())",
    rf"\({PY_SPACE}*+(?:select(?!{_WORD}))?+", r"[),;#`\"']", r"\\(?s:.)?+", r"--", r"/\*", r"\*/",
])

# Modes of the lexer; FROM_OPEN and ARGUMENTS are bits of a level.
_PLAIN, _LITERAL, _TABLE, _BAD = range(4)
_FROM_OPEN, _ARGUMENTS = 1, 2
_LEVELS = 31   # of two bits each in a long


def _lexer_step(allowed: list[str]):
    def step(s: Column, t: Column) -> Column:
        def to(mode=None, level=None, top=None, n=None, rest=None) -> Column:
            new = {"mode": mode, "level": level, "top": top, "n": n, "rest": rest}
            return F.struct(*[(s[k] if v is None else F.lit(v) if isinstance(v, int) else v).alias(k) for k, v in new.items()])
        bad = to(mode=_BAD)
        packed = F.shiftleft(s["top"], 2).bitwiseOR(s["level"].cast("long"))
        function = ~t.startswith("(") & ~t.endswith("select")
        inside = F.when(function, _ARGUMENTS).otherwise(0)
        push = (F.when(s["n"] < _LEVELS, to(_PLAIN, inside, packed, s["n"] + 1))
                .otherwise(to(_PLAIN, inside, s["level"].cast("long"), 1, F.concat(s["rest"], F.array(s["top"])))))
        top = F.element_at(s["rest"], -1)
        pop = (F.when(s["n"] > 0, to(level=s["top"].bitwiseAND(3).cast("int"), top=F.shiftrightunsigned(s["top"], 2), n=s["n"] - 1))
               .when(F.size(s["rest"]) > 0, to(level=top.bitwiseAND(3).cast("int"), top=F.shiftrightunsigned(top, 2),
                                               n=_LEVELS - 1, rest=F.slice(s["rest"], 1, F.size(s["rest"]) - 1)))
               .otherwise(bad))
        keyword = t.startswith("from") | t.startswith("join")
        open_ = F.when(t.startswith("from"), s["level"].bitwiseOR(_FROM_OPEN)).otherwise(s["level"])
        name = py_strip(F.substr(t, F.lit(5)))
        table = (F.when(t.startswith("from") & (s["level"].bitwiseAND(_ARGUMENTS) != 0), s)
                 .when(name == "", to(_TABLE, open_)).when(name.isin(allowed), to(_PLAIN, open_)).otherwise(bad))
        longer = F.substring(t, 2, 4)
        other_name = py_strip(F.substr(t, F.lit(6)))
        return (F.when(s["mode"] == _BAD, s)
                .when(s["mode"] == _LITERAL, F.when(t == "'", to(_PLAIN)).otherwise(s))
                .when((s["mode"] == _TABLE) & ~(t.startswith("(") & t.endswith("select")), bad)
                .when(t == "'", to(_LITERAL))
                .when(keyword, table)
                .when(t == ",", F.when(s["level"].bitwiseAND(_FROM_OPEN) != 0, bad).otherwise(s))
                .when(t.startswith("\\"), bad)
                .when(t.contains("("), push)
                .when(t == ")", pop)
                .when(t.isin(AFTER_FROM), to(level=s["level"].bitwiseAND(_ARGUMENTS)))
                .when(longer.isin("from", "join"), F.when(other_name == "", to(_TABLE)).when(other_name.isin(allowed), s).otherwise(bad))
                .otherwise(bad))
    return step


def _strict_rules(s: Column, allowed: list[str]) -> Column:
    """Strict verdict on prepared text ``s``."""
    start = F.struct(F.lit(_PLAIN).alias("mode"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("top"),
                     F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("rest"))
    shape_ok = F.aggregate(
        F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0)), start, _lexer_step(allowed),
        lambda end: end["mode"].isin(_PLAIN, _TABLE) & (end["n"] == 0) & (F.size(end["rest"]) == 0))
    selects = s.startswith("select") & ~_is_word_char(F.substring(s, 7, 1))
    return F.coalesce(F.when(selects, shape_ok), F.lit(False))


def screen_compat(sql: Column, allowed: list[str] = ALLOWED_TABLES) -> Column:
    return _compat_rules(_prepare(sql), allowed)


def screen_strict(sql: Column, allowed: list[str] = ALLOWED_TABLES) -> Column:
    return _strict_rules(_prepare(sql), allowed)


def screen(sql: Column | str, mode: str = "compat", allowed: list[str] = ALLOWED_TABLES) -> Column:
    """Boolean column: True when the statement passes the screen.

    A single expression; over a DataFrame prefer :func:`screen_log`, which
    computes the shared intermediate texts once per row."""
    sql = F.col(sql) if isinstance(sql, str) else sql
    if mode == "compat":
        return screen_compat(sql, allowed)
    if mode == "strict":
        return screen_strict(sql, allowed)
    raise ValueError(mode)


def screen_log(df: DataFrame, col: str = "sql_text", allowed: list[str] = ALLOWED_TABLES) -> DataFrame:
    """Add ``safe_compat`` and ``safe_strict`` to a log of statements.

    The prepared text gets its own projection, so it is made once per row.
    """
    keep = [F.col(c) for c in df.columns]
    staged = df.select(*keep, _prepare(F.col(col)).alias("_s"))
    return staged.select(
        *keep,
        _compat_rules(F.col("_s"), allowed).alias("safe_compat"),
        _strict_rules(F.col("_s"), allowed).alias("safe_strict"),
    )
