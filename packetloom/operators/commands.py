"""Commands of an attacker in decoded payloads: calls, files, queries and shell lines, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..rules.webshell import SHELL_LINES

#: Kind, description, pattern, the group that holds the command, and how much of it is shown.
QUOTED = r"""\s*\(\s*["'](.+?)["']\s*"""
CALLS = [
    *[("System Command", f"via {f}()", f + QUOTED + r"\)", 1, None) for f in ("system", "exec", "shell_exec", "passthru", "popen", "proc_open")],
    ("File Read", "reads a file", "file_get_contents" + QUOTED + r"\)", 1, None),
    ("File Write", "writes a file", "file_put_contents" + QUOTED + ",", 1, None),
    *[("File System", what, f + QUOTED, 1, None) for f, what in (("scandir", "lists a folder"), ("opendir", "opens a folder"), ("readdir", "reads a folder"), ("mkdir", "makes a folder"), ("rmdir", "removes a folder"), ("unlink", "removes a file"), ("rename", "renames a file"), ("copy", "copies a file"))],
    ("DB Connect", "connects to a database", "mysql_connect" + QUOTED + ",", 1, None),
    ("SQL Query", "queries a database", "mysql_query" + QUOTED + r"\)", 1, 200),
    ("SQL Query", "queries a database", r"mysqli_query\s*\(.+?,\s*[\"'](.+?)[\"']\s*\)", 1, 200),
]
CODE = ["eval", "assert", "preg_replace"]
#: What single parameters of the z tools hold, the first that fits.
SHELL_WORDS = ["whoami", "id", "uname", "ifconfig", "ipconfig", "netstat", "cat ", "type ", "dir ", "ls ", "pwd", "cd ", "echo ", "wget ", "curl ", "chmod ", "net ", "ping ", "nslookup", "powershell", "cmd ", "cmd.exe", "/c ", "bash ", "sh "]
FILE_WORDS = ["/etc/passwd", "/etc/shadow", "flag", ".conf", ".ini", ".php", ".asp"]
SQL_WORDS = ["select ", "insert ", "update ", "delete ", "drop ", "union "]
CODE_WORDS = ["<?php", "<?=", "<script", "eval(", "base64_decode"]

ROW = "array<struct<type:string,command:string,description:string>>"


def row(kind: str, command: Column, description: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("type"), command.alias("command"), (F.lit(description) if isinstance(description, str) else description).alias("description"))


def shown_as(kind: str, what: str, most: int | None):
    return lambda c: row(kind, F.substring(c, 1, most) if most else c, what)


def found(text: Column) -> Column:
    """Array of (type, command, description) of a text, each type and command once."""
    parts = []
    for kind, what, pattern, group, most in CALLS:
        parts.append(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(group)), shown_as(kind, what, most)))
    through = F.regexp_extract_all(text, F.lit(r"(?i)(?:system|exec|shell_exec|passthru|popen)\s*\(\s*\$(\w+)\s*\)"), F.lit(1))
    names, texts = (F.regexp_extract_all(text, F.lit(r"""\$(\w+)\s*=\s*["'](.+?)["']"""), F.lit(g)) for g in (1, 2))
    assigned = F.transform(F.filter(through, lambda v: F.array_position(names, v) > 0), lambda v: row("System Command", F.element_at(texts, F.array_position(names, v).cast("int")), F.concat(F.lit("via $"), v)))
    opened = [F.regexp_extract_all(text, F.lit(r"""(?i)fopen\s*\(\s*["'](.+?)["']\s*,\s*["']([rwab+]+)["']\s*\)"""), F.lit(g)) for g in (1, 2)]
    files = F.zip_with(*opened, lambda p, m: row("File Operation", F.concat(p, F.lit(" (mode: "), m, F.lit(")")), F.when(F.contains(m, F.lit("r")), "reads a file").otherwise("writes a file")))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("t"), F.lower(x).alias("l")))
    low = F.lower(text)

    def line_of(word: str) -> Column:
        first = F.get(F.filter(lines, lambda x: F.contains(x["l"], F.lit(word.strip()))), F.lit(0))["t"]
        return F.when(F.contains(low, F.lit(word)), bind(first, lambda t: F.when((F.length(t) > 0) & (F.length(t) < 300), row("Shell Command", t, ""))))

    shell = F.filter(F.array(*map(line_of, SHELL_LINES)), lambda x: x.isNotNull())
    coded = []
    for f in CODE:
        inner = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){f}\s*\(\s*(.{{10,100}}?)\s*\)"), F.lit(1)), lambda c: F.regexp_replace(c, "^['\"]+|['\"]+$", ""))
        coded.append(F.transform(F.filter(inner, lambda c: F.length(c) > 5), shown_as("Code Execution", f"via {f}()", 150)))
    every = F.concat(*[p.cast(ROW) for p in [*parts[:6], assigned, *parts[6:8], files, *parts[8:], shell, *coded]])
    empty = F.array().cast(ROW)
    return F.aggregate(every, empty, lambda acc, x: F.when(F.exists(acc, lambda y: (y["type"] == x["type"]) & (y["command"] == x["command"])), acc).otherwise(F.concat(acc, F.array(x))))


def of_parameter(name: Column, text: Column) -> Column:
    """(type, command, description) of what a z parameter of the simple tools holds."""
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    shown = F.substring(text, 1, 300)
    folder = text.rlike(r"[/\\]$")
    long_ = F.when(F.length(text) > 150, F.concat(F.substring(text, 1, 150), F.lit("..."))).otherwise(text)
    return F.when(F.length(text) == 0, row("empty", F.lit(""), "")).when(has(SHELL_WORDS), row("shell command", shown, name)).when(has(FILE_WORDS), row("file read", shown, name)).when(folder, row("folder list", shown, name)).when(has(SQL_WORDS), row("SQL", shown, name)).when(has(CODE_WORDS), row("code", long_, name)).otherwise(row("parameter", shown, name))


#: What a text must hold for any rule to find something; a cheap filter before the rest.
GATE = r"(?i)(system|exec|passthru|popen|proc_open|file_get|file_put|fopen|scandir|opendir|readdir|mkdir|rmdir|unlink|rename|copy|mysql|eval|assert|preg_replace|whoami|id|uname|config|netstat|cat |ls |dir |pwd|cd |wget |curl |chmod |chown |find |grep |ps |kill |net |ping |nslookup|type |echo |certutil|powershell|cmd)"


def commands(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, type, command, description) of the commands in a column of decoded texts."""
    rows = df.where(F.col(text).rlike(GATE)).select(key, found(F.col(text)).alias("c"))
    return rows.select(key, F.explode("c").alias("x")).select(key, "x.*")
