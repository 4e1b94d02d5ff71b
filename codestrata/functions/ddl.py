"""Column expressions over single DDL statements, after the public grammars of the common databases.

One statement becomes an array of facts.  ``op`` is one of ADD (column defined),
DROPCOL, SETCOL (column changed), PK, UNIQUE, FK, RENTBL (``ref_tbl`` is the new name of
the table) and RENCOL (``ref_cols`` holds the new name); ``cols`` names the columns the
fact is about.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codestrata.functions import fixed
from codestrata.functions.text import col, strip

FACT = ("struct<def_no:int,op:string,cols:array<string>,type:string,nullable:boolean,"
        "sets_default:boolean,default:string,ref_tbl:string,ref_cols:array<string>>")
# A name: words or quoted parts, joined by dots.
_PART = r'(?:"[^"]*"|\[[^\]]*\]|`[^`]*`|[^\s(),;."\[\]`]+)'
_NAME = rf"{_PART}(?:\.{_PART})*"
_LITERAL = r"'(?:[^']|'')*'"
_OBJECTS = "TABLE|INDEX|TYPE|VIEW"

# Words that change nothing about what a statement does to the schema.
_FLAVOURS = r"(?:(?:OR\s+REPLACE|TEMP|TEMPORARY|UNLOGGED|GLOBAL|LOCAL|MATERIALIZED)\s+)+"
_GUARDS = r"(?:(?:CONCURRENTLY|IF\s+NOT\s+EXISTS|IF\s+EXISTS|ONLY)\s+)+"

_VERB = rf"(?is)^(CREATE|DROP|ALTER)\s+(?:UNIQUE\s+)?({_OBJECTS})\b"
_HEAD = rf"(?is)^\w+\s+(?:UNIQUE\s+)?(?:{_OBJECTS})\s+({_NAME})\s*(.*)$"
_INDEX = rf"(?is)^CREATE\s+(UNIQUE\s+)?INDEX\s+(?:({_NAME})\s+)?ON\s+(?:ONLY\s+)?({_NAME})(?:\s+USING\s+\w+)?\s*\(((?:[^()]++|\([^()]*+\))*+)\)"
_ENUM = r"(?is)^AS\s+ENUM\s*\((.*)\)"
# A key over listed columns, and what a foreign key refers to.
_KEY = r"(?is)\b(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE)\b[^()]*\(([^()]*)\)"
_TARGET = rf"(?is)\bREFERENCES\s+({_NAME})\s*\(([^()]*)\)"
_DEFAULT = rf"(?is)\bDEFAULT\s+({_LITERAL}|\([^()]*\)|[^\s,]+)"
_DATA_TYPE = (r"(?i)^(?:DOUBLE\s+PRECISION|(?:CHARACTER|BIT)\s+VARYING|NATIONAL\s+CHARACTER(?:\s+VARYING)?|[^\s(\[]+)(?:\s*\([^()]*\))?"
              r"(?:\s+WITH(?:OUT)?\s+TIME\s+ZONE)?(?:\s*\[\d*\])*")
# Actions of ALTER TABLE.
_ADDS_KEY = r"(?is)^ADD\s+(?:CONSTRAINT\b|PRIMARY\s+KEY\b|FOREIGN\s+KEY\b|UNIQUE\b)"
_ADDS = r"(?is)^ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(\S.*)$"
_DROPS = rf"(?is)^DROP\s+COLUMN\s+(?:IF\s+EXISTS\s+)?({_NAME})"
_CHANGES = rf"(?is)^(?:ALTER|MODIFY)\s+(?:COLUMN\s+)?({_NAME})\s+(\S.*)$"
_RENAMES_TABLE = rf"(?is)^RENAME\s+(?:TO|AS)\s+({_NAME})\s*$"
_RENAMES_COLUMN = rf"(?is)^RENAME\s+(?:COLUMN\s+)?({_NAME})\s+TO\s+({_NAME})\s*$"
_NO_EFFECT = r"(?is)^(?:DROP\s+CONSTRAINT|RENAME\s+CONSTRAINT|OWNER|ENABLE|DISABLE|VALIDATE|SET|RESET|COMMENT)\b"

# Pieces of a script: what is quoted or a comment is one piece, whatever it holds. Comments may be nested,
# _DEPTH deep; one that does not end goes on to the end of the text, any other quote that does not end is a character like others.
_DEPTH = 6
_COMMENT = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/"
for _ in range(_DEPTH - 1):
    _COMMENT = rf"/\*(?:[^*/]++|\*(?!/)|{_COMMENT}|/(?!\*))*+\*/"
_QUOTED = r"""'(?:[^']++|'')*+'|"(?:[^"]++|"")*+"|`[^`]*+`|(\$(?:[A-Za-z_]\w*+)?+\$).*?\1"""
_REMARK = rf"--[^\n]*+|{_COMMENT}|/\*.*+"
_PIECES = rf"(?s)(?:{_QUOTED}|{_REMARK}|[^'\"`$/\-]++|.)"
_IS_QUOTED, _IS_REMARK = r"(?s)^(?:'.*'|\".*\"|`.*`|\$.*\$)$", r"^(?:--|/\*)"

# What separates statements, definitions and lines is stood in for, where it is quoted, by characters that no script holds.
_INSIDE, _STAND_INS = ";,()\n\r\t -", "\ue000\ue001\ue002\ue003\ue004\ue005\ue006\ue007\ue008"


def unquoted(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r'["`\[\]]', ""))


def _names(listed: Column) -> Column:
    """Column list of a key definition."""
    return F.transform(F.split(listed, ","), lambda c: unquoted(strip(c)))


def pieces(script: Column | str) -> Column:
    """A script cut into quoted parts, comments and what is between them."""
    return F.regexp_extract_all(col(script), F.lit(_PIECES), F.lit(0))


def guarded(script: Column | str) -> Column:
    """The script without comments, with stand-ins for separators inside quotes."""
    def piece(p: Column) -> Column:
        quoted = (F.length(p) > 1) & p.rlike(_IS_QUOTED)
        return F.when(quoted, F.translate(p, _INSIDE, _STAND_INS)).when(p.rlike(_IS_REMARK), F.lit(" ")).otherwise(p)

    return F.array_join(F.transform(pieces(script), piece), "")


def unguarded(text: Column) -> Column:
    return F.translate(text, _STAND_INS, _INSIDE)


def raw_statements(script: Column | str) -> Column:
    """The statements of a script, guarded: cut at semicolons that are neither quoted nor in a comment."""
    return F.split(guarded(script), ";")


def clean_statement(raw: Column | str) -> Column:
    """A guarded statement without blank lines; its lines joined with spaces, quoted parts as they were."""
    lines = F.transform(F.split(col(raw), "\n"), lambda line: strip(line))
    return unguarded(F.array_join(F.filter(lines, lambda line: line != ""), " "))


def plain(stmt: Column | str) -> Column:
    """The statement without words that do not matter to the schema: ``CREATE OR REPLACE``, ``IF EXISTS`` and the like."""
    flat = F.regexp_replace(col(stmt), rf"(?i)^CREATE\s+{_FLAVOURS}", "CREATE ")
    return F.regexp_replace(flat, rf"(?i)^((?:CREATE|DROP|ALTER)\s+(?:UNIQUE\s+)?(?:{_OBJECTS}))\s+{_GUARDS}", "$1 ")


def statement_type(stmt: Column | str) -> Column:
    """Kind of a DDL statement, null for anything else."""
    s = plain(stmt)
    kind = F.upper(F.concat_ws("_", F.regexp_extract(s, _VERB, 1), F.regexp_extract(s, _VERB, 2)))
    return F.when(kind.isin(sorted({k for _, k in fixed.STATEMENT_PREFIXES})), kind)


def object_name(stmt: Column | str) -> Column:
    """Lower-cased name of what a statement is about; empty if it names nothing."""
    return unquoted(F.regexp_extract(plain(stmt), _HEAD, 1))


def statement_table(stmt: Column | str, kind: Column | str) -> Column:
    """Lower-cased table name; empty when the kind has none."""
    k = col(kind)
    return (F.when(k.isin("CREATE_TABLE", "DROP_TABLE", "ALTER_TABLE"), object_name(stmt))
            .when(k == "CREATE_INDEX", unquoted(F.regexp_extract(plain(stmt), _INDEX, 3))).otherwise(""))


def _without_literals(text: Column) -> Column:
    return F.regexp_replace(text, _LITERAL, "''")


def listed(text: Column) -> Column:
    """Split at commas outside parentheses and quotes.

    Pieces between commas are folded together while parentheses are open, so
    any nesting depth works and no regular expression can backtrack.
    """
    parts = F.split(guarded(text), ",")

    def depth(piece: Column) -> Column:
        opens = F.length(F.replace(piece, F.lit(")"), F.lit("")))
        closes = F.length(F.replace(piece, F.lit("("), F.lit("")))
        return opens - closes

    def step(s: Column, piece: Column) -> Column:
        grown = F.when(s["open"].isNull(), piece).otherwise(F.concat(s["open"], F.lit(","), piece))
        level = s["depth"] + depth(piece)
        return F.struct(
            F.when(level == 0, F.array_append(s["done"], grown)).otherwise(s["done"]).alias("done"),
            F.when(level != 0, grown).alias("open"), level.alias("depth"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))
    whole = F.aggregate(parts, start, step, lambda s: F.when(
        s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return F.filter(F.transform(whole, lambda d: unguarded(strip(d))), lambda d: d != "")


def _table_body(stmt: Column | str) -> Column:
    """What stands between the first and the last parenthesis of a CREATE TABLE, null without both."""
    rest = F.regexp_extract(plain(stmt), _HEAD, 2)
    return F.when(rest.startswith("(") & rest.contains(")"), F.regexp_extract(rest, r"(?s)^\((.*)\)", 1))


def column_defs(stmt: Column | str) -> Column:
    """Definitions of a CREATE TABLE body."""
    return listed(F.coalesce(_table_body(stmt), F.lit("")))


def _fact(no: Column, op: str, cols: Column, *, type_=None, nullable=None, sets_default=None,
          default=None, ref_tbl=None, ref_cols=None) -> Column:
    return F.struct(
        no.alias("def_no"), F.lit(op).alias("op"), cols.alias("cols"),
        (type_ if type_ is not None else F.lit(None).cast("string")).alias("type"),
        (nullable if nullable is not None else F.lit(None).cast("boolean")).alias("nullable"),
        (sets_default if sets_default is not None else F.lit(False)).alias("sets_default"),
        (default if default is not None else F.lit(None).cast("string")).alias("default"),
        (ref_tbl if ref_tbl is not None else F.lit(None).cast("string")).alias("ref_tbl"),
        (ref_cols if ref_cols is not None else F.lit(None).cast("array<string>")).alias("ref_cols")).cast(FACT)


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def type_of(text: Column) -> Column:
    """The type at the start of a text, with its parameters, in lower case and without blanks that do not matter."""
    found = F.lower(F.regexp_replace(F.regexp_extract(text, _DATA_TYPE, 0), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(found, r" ?([(\[,]) ?", "$1"), r" ([)\]])", "$1")


def _column_facts(definition: Column, no: Column) -> Column:
    """Facts of one column definition; null when it has fewer than two words."""
    words = F.split(strip(definition), r"\s+")
    bare = _without_literals(definition)
    first = F.regexp_extract(strip(definition), rf"(?s)^({_NAME})\s+(.*)$", 1)
    name = unquoted(F.when(first != "", first).otherwise(F.get(words, F.lit(0))))
    rest = F.regexp_extract(strip(definition), rf"(?s)^(?:{_NAME})\s+(.*)$", 1)
    key = bare.rlike(r"(?i)\bPRIMARY\s+KEY\b")
    ref = F.regexp_extract(bare, _TARGET, 1)
    return F.when(F.size(words) >= 2, F.array_compact(F.array(
        _fact(no, "ADD", F.array(name), type_=type_of(F.when(rest != "", rest).otherwise(F.get(words, F.lit(1)))),
              nullable=~(bare.rlike(r"(?i)\bNOT\s+NULL\b") | key), sets_default=F.lit(True),
              default=_present(F.regexp_extract(definition, _DEFAULT, 1))),
        F.when(key, _fact(no, "PK", F.array(name))),
        F.when(bare.rlike(r"(?i)\bUNIQUE\b"), _fact(no, "UNIQUE", F.array(name))),
        F.when(ref != "", _fact(no, "FK", F.array(name), ref_tbl=unquoted(ref),
                                ref_cols=_names(F.regexp_extract(bare, _TARGET, 2)))))))


def _key_fact(definition: Column, no: Column) -> Column:
    """A key over listed columns, null when the definition is none."""
    bare = _without_literals(definition)
    kind = F.upper(F.regexp_extract(bare, _KEY, 1))
    cols, target = _names(F.regexp_extract(bare, _KEY, 2)), F.regexp_extract(bare, _TARGET, 1)
    return (F.when(kind.startswith("PRIMARY"), _fact(no, "PK", cols))
            .when(kind == "UNIQUE", _fact(no, "UNIQUE", cols))
            .when(kind.startswith("FOREIGN") & (target != ""), _fact(
                no, "FK", cols, ref_tbl=unquoted(target), ref_cols=_names(F.regexp_extract(bare, _TARGET, 2)))))


def _is_column(definition: Column) -> Column:
    return ~definition.rlike(r"(?i)^(?:(?:PRIMARY|FOREIGN)\s+KEY\b|CONSTRAINT\b|UNIQUE\b|CHECK\b|EXCLUDE\b)")


def create_is_valid(stmt: Column | str) -> Column:
    """A CREATE TABLE counts only when it has a body and all column definitions parse."""
    return _table_body(stmt).isNotNull() & F.forall(
        column_defs(stmt), lambda d: ~_is_column(d) | (F.size(F.split(strip(d), r"\s+")) >= 2))


def _one(fact: Column) -> Column:
    return F.when(fact.isNotNull(), F.array(fact)).otherwise(F.array().cast(f"array<{FACT}>"))


def create_facts(stmt: Column | str) -> Column:
    empty = F.array().cast(f"array<{FACT}>")
    return F.flatten(F.transform(column_defs(stmt), lambda d, i: F.when(
        _is_column(d), F.coalesce(_column_facts(d, i.cast("int")), empty)).otherwise(_one(_key_fact(d, i.cast("int"))))))


def alter_actions(stmt: Column | str) -> Column:
    """The actions of an ALTER TABLE."""
    return listed(F.regexp_extract(plain(stmt), _HEAD, 2))


def _changed(action: Column, no: Column) -> Column:
    name, rest = unquoted(F.regexp_extract(action, _CHANGES, 1)), F.regexp_extract(action, _CHANGES, 2)
    new_type = type_of(F.regexp_extract(rest, r"(?is)^(?:SET\s+DATA\s+)?TYPE\s+(\S.*)$", 1))
    change = F.upper(F.regexp_replace(F.regexp_extract(rest, r"(?i)^(?:SET|DROP)\s+(?:NOT\s+NULL|DEFAULT)\b", 0), r"\s+", " "))
    whole = (new_type == "") & (change == "")
    return F.when(rest != "", _fact(
        no, "SETCOL", F.array(name),
        type_=F.when(new_type != "", new_type).when(whole, type_of(rest)),
        nullable=F.when(change == "SET NOT NULL", False).when(change == "DROP NOT NULL", True)
        .when(whole, ~_without_literals(rest).rlike(r"(?i)\bNOT\s+NULL\b")),
        sets_default=whole | change.isin("SET DEFAULT", "DROP DEFAULT"),
        default=F.when(change != "DROP DEFAULT", _present(F.regexp_extract(rest, _DEFAULT, 1)))))


def alter_facts(stmt: Column | str) -> Column:
    """Facts of all actions of an ALTER TABLE; DROP CONSTRAINT and unknown actions have none."""
    empty = F.array().cast(f"array<{FACT}>")
    # a new name without a schema stays in the schema of the old one
    schema = F.regexp_extract(object_name(stmt), r"^(.*\.)[^.]*$", 1)

    def facts(a: Column, i: Column) -> Column:
        no, dropped = i.cast("int"), F.regexp_extract(a, _DROPS, 1)
        table, column = unquoted(F.regexp_extract(a, _RENAMES_TABLE, 1)), unquoted(F.regexp_extract(a, _RENAMES_COLUMN, 1))
        return (F.when(a.rlike(_ADDS_KEY), _one(_key_fact(a, no)))
                .when(table != "", F.array(_fact(no, "RENTBL", F.array().cast("array<string>"), ref_tbl=F.when(
                    table.contains("."), table).otherwise(F.concat(schema, table)))))
                .when(column != "", F.array(_fact(no, "RENCOL", F.array(column), ref_cols=F.array(unquoted(F.regexp_extract(a, _RENAMES_COLUMN, 2))))))
                .when(a.rlike(_ADDS), F.coalesce(_column_facts(F.regexp_extract(a, _ADDS, 1), no), empty))
                .when(dropped != "", F.array(_fact(no, "DROPCOL", F.array(unquoted(dropped)))))
                .when(a.rlike(_CHANGES), _one(_changed(a, no)))
                .otherwise(empty))

    return F.flatten(F.transform(alter_actions(stmt), facts))


def alter_is_valid(stmt: Column | str) -> Column:
    """Every action has an effect, or is known to have none on the schema kept here."""
    known = F.exists(alter_actions(stmt), lambda a: a.rlike(_NO_EFFECT))
    return known | (F.size(alter_facts(stmt)) > 0)


def index_parts(stmt: Column | str) -> Column:
    """Name, table, uniqueness and columns of a CREATE INDEX; null when it does not parse."""
    s = plain(stmt)
    part = lambda g: F.regexp_extract(s, _INDEX, g)
    return F.when(s.rlike(_INDEX), F.struct(
        unquoted(part(2)).alias("name"), unquoted(part(3)).alias("tbl"), (part(1) != "").alias("is_unique"),
        F.transform(listed(part(4)), lambda c: unquoted(strip(c))).alias("cols")))


def enum_values(stmt: Column | str) -> Column:
    """Values of a CREATE TYPE AS ENUM, null for other types."""
    rest = F.regexp_extract(plain(stmt), _HEAD, 2)
    literals = F.regexp_extract_all(F.regexp_extract(rest, _ENUM, 1), F.lit(_LITERAL), F.lit(0))
    values = F.transform(literals, lambda v: F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'")))
    return F.when(rest.rlike(_ENUM), values)


def migration_version(path: Column | str) -> Column:
    """Leading digits of the file name, else the name itself."""
    base = F.substring_index(col(path), "/", -1)
    digits = F.regexp_extract(base, r"^(\d+)", 1)
    return F.when(digits != "", digits).otherwise(base)
