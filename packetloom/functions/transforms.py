"""The transform library: named operations over text and numbers as Columns, and recipes that chain them.

An operation is a SQL expression over `x`, so it stays in code generation and composes in SELECT lists and in recipes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rotated(n: int) -> tuple[str, str]:
    """The alphabets and their rotation by n letters."""
    return _LOW + _UP, _LOW[n:] + _LOW[:n] + _UP[n:] + _UP[:n]


_ROT13 = rotated(13)
_ATBASH = (_LOW + _UP, _LOW[::-1] + _UP[::-1])
#: Operation -> Spark SQL over x (text).
TEXT = {
    "to_base64": "replace(base64(cast(x as binary)), '\r\n', '')",
    "from_base64": "case when length(x) % 4 = 0 and x rlike '^[A-Za-z0-9+/]*={0,2}$' then cast(unbase64(x) as string) end",
    "from_hex": "case when length(x) % 2 = 0 and x rlike '^[0-9A-Fa-f]*$' then cast(unhex(x) as string) end",
    "url_decode": "try_url_decode(replace(regexp_replace(x, '%(?![0-9A-Fa-f]{2})', '%25'), '+', '%2B'))",
    "levenshtein_first_last_line": "cast(if(substring_index(x, '\n', 1) = substring_index(x, '\n', -1), 0, levenshtein(substring_index(x, '\n', 1), substring_index(x, '\n', -1))) as string)",
    "to_base64_url": "translate(rtrim('=', replace(base64(cast(x as binary)), '\r\n', '')), '+/', '-_')",
    "to_hex": "lower(hex(cast(x as binary)))",
    "url_encode": "url_encode(x)",
    "to_upper": "upper(x)",
    "to_lower": "lower(x)",
    "reverse": "reverse(x)",
    "rot13": f"translate(x, '{_ROT13[0]}', '{_ROT13[1]}')",
    "atbash": f"translate(x, '{_ATBASH[0]}', '{_ATBASH[1]}')",
    "rot47": "translate(x, '" + "".join(map(chr, range(33, 127))).replace("\\", "\\\\").replace("'", "\\'") + "', '" + ("".join(chr(33 + (i + 47) % 94) for i in range(94))).replace("\\", "\\\\").replace("'", "\\'") + "')",
    "swap_case": f"translate(x, '{_LOW + _UP}', '{_UP + _LOW}')",
    "remove_whitespace": "regexp_replace(x, '[ \\\\t\\\\n\\\\r\\\\f]', '')",
    "md5": "md5(cast(x as binary))",
    "sha1": "sha1(cast(x as binary))",
    "sha256": "sha2(cast(x as binary), 256)",
    "count_lines": "cast(size(split(x, '\\n')) as string)",
    "count_words": "cast(size(regexp_extract_all(x, '[^ \\\\t\\\\n\\\\r\\\\f]+', 0)) as string)",
    "head_3_lines": "array_join(slice(split(x, '\\n'), 1, 3), '\\n')",
    "tail_2_lines": "array_join(slice(split(x, '\\n'), greatest(1, size(split(x, '\\n')) - 1), 2), '\\n')",
    "sort_lines": "array_join(array_sort(split(x, '\\n')), '\\n')",
    "reverse_lines": "array_join(reverse(split(x, '\\n')), '\\n')",
    "unique_lines": "array_join(array_sort(array_distinct(split(x, '\\n'))), '\\n')",
    "filter_lines": "array_join(filter(split(x, '\\n'), l -> l like '%the%'), '\\n')",
    "find_replace": "replace(x, 'the', '<T>')",
    "pad_left": "lpad(cast(length(x) as string), 12, '0')",
    "extract_emails": "array_join(regexp_extract_all(x, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\\\\.[a-z]+', 0), ',')",
    "extract_ips": "array_join(regexp_extract_all(x, '[0-9]{1,3}\\\\.[0-9]{1,3}\\\\.[0-9]{1,3}\\\\.[0-9]{1,3}', 0), ',')",
    "extract_urls": "array_join(regexp_extract_all(x, 'https?://[A-Za-z0-9./?=&_%-]+', 0), ',')",
    "extract_hashes": "array_join(regexp_extract_all(x, '[0-9a-f]{32,64}', 0), ',')",
    "flag_lines": "array_join(filter(split(x, '\\n'), l -> lower(l) like '%flag{%' or lower(l) like '%ctf%'), '\\n')",
    "defang_url": "replace(replace(x, '.', '[.]'), '://', '[://]')",
    "escape_html": "replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\\"', '&quot;')",
    "strip_html_tags": "regexp_replace(x, '<[^>]*>', '')",
    "snake_case": "lower(regexp_replace(x, '[^A-Za-z0-9]+', '_'))",
    "crc32": "cast(crc32(cast(x as binary)) as string)",
}
#: Operation -> Spark SQL over a and b (long).
NUMBERS = {
    "xor": "a ^ b",
    "and": "a & b",
    "or": "a | b",
    "not": "~a",
    "shift_left": "shiftleft(a, 3)",
    "shift_right": "shiftright(a, 2)",
    "add": "a + b",
    "subtract": "a - b",
    "multiply": "a * b",
    "modulo": "a % nullif(b, 0)",
    "to_hex_number": "lower(hex(a))",
    "bit_count": "bit_count(a)",
    "to_base36": "lower(conv(cast(a as string), 10, 36))",
    "unix_to_text": "date_format(timestamp_seconds(a), 'yyyy-MM-dd HH:mm:ss')",
    "ip_from_number": "concat_ws('.', shiftright(a, 24) & 255, shiftright(a, 16) & 255, shiftright(a, 8) & 255, a & 255)",
    "power_of_two": "a > 0 and (a & (a - 1)) = 0",
}


def recipe(df: DataFrame, column: str, ops: list[str], out: str = "result") -> DataFrame:
    """df with the operations applied to the column, left to right."""
    given = df.columns
    cur = df.withColumn("x", F.col(column).cast("string"))
    for op in ops:
        cur = cur.withColumn("x", F.expr(TEXT[op]).cast("string"))
    return cur.select(*[c for c in given if c not in ("x", out)], F.col("x").alias(out))
