"""Queries of the transform library, one per operation, over whole document texts and order numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import operations as O
from ..functions import transforms as X
from ..registry import register, table

#: Operation -> DuckDB SQL over x; operations left out have no twin and are tested on fixtures.
SQL = {
    "to_base64": "to_base64(encode(x))",
    "from_base64": "d",
    "from_hex": "d",
    "url_decode": "d",
    "to_base64_url": "translate(rtrim(to_base64(encode(x)), '='), '+/', '-_')",
    "to_hex": "lower(hex(encode(x)))",
    "to_upper": "upper(replace(x, 'ß', '')) || (length(x) - length(replace(x, 'ß', '')))",
    "to_lower": "lower(x)",
    "reverse": "reverse(x)",
    "rot13": f"translate(x, '{X.rotated(13)[0]}', '{X.rotated(13)[1]}')",
    "atbash": f"translate(x, '{X._ATBASH[0]}', '{X._ATBASH[1]}')",
    "rot47": "translate(x, '" + "".join(map(chr, range(33, 127))).replace("'", "''") + "', '" + "".join(chr(33 + (i + 47) % 94) for i in range(94)).replace("'", "''") + "')",
    "swap_case": f"translate(x, '{X._LOW + X._UP}', '{X._UP + X._LOW}')",
    "remove_whitespace": "regexp_replace(x, '[ \\t\\n\\r\\f]', '', 'g')",
    "md5": "md5(x)",
    "sha1": "sha1(x)",
    "sha256": "sha256(x)",
    "count_lines": "len(string_split(x, chr(10)))::VARCHAR",
    "count_words": "len(regexp_extract_all(x, '[^ \\t\\n\\r\\f]+'))::VARCHAR",
    "head_3_lines": "array_to_string(string_split(x, chr(10))[1:3], chr(10))",
    "tail_2_lines": "array_to_string(string_split(x, chr(10))[greatest(1, len(string_split(x, chr(10))) - 1):], chr(10))",
    "reverse_lines": "array_to_string(list_reverse(string_split(x, chr(10))), chr(10))",
    "sort_lines": "array_to_string(list_sort(string_split(x, chr(10))), chr(10))",
    "unique_lines": "array_to_string(list_sort(list_distinct(string_split(x, chr(10)))), chr(10))",
    "filter_lines": "array_to_string(list_filter(string_split(x, chr(10)), lambda l: contains(l, 'the')), chr(10))",
    "find_replace": "replace(x, 'the', '<T>')",
    "pad_left": "lpad(length(x)::VARCHAR, 12, '0')",
    "extract_emails": "array_to_string(regexp_extract_all(x, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\\.[a-z]+'), ',')",
    "extract_ips": "array_to_string(regexp_extract_all(x, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}'), ',')",
    "extract_urls": "array_to_string(regexp_extract_all(x, 'https?://[A-Za-z0-9./?=&_%-]+'), ',')",
    "extract_hashes": "array_to_string(regexp_extract_all(x, '[0-9a-f]{32,64}'), ',')",
    "flag_lines": "array_to_string(list_filter(string_split(x, chr(10)), lambda l: contains(lower(l), 'flag{') OR contains(lower(l), 'ctf')), chr(10))",
    "defang_url": "replace(replace(x, '.', '[.]'), '://', '[://]')",
    "escape_html": "replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
    "strip_html_tags": "regexp_replace(x, '<[^>]*>', '', 'g')",
    "snake_case": "lower(regexp_replace(x, '[^A-Za-z0-9]+', '_', 'g'))",
}
NUMBER_SQL = {
    "xor": "xor(a, b)", "and": "a & b", "or": "a | b", "not": "~a", "shift_left": "a << 3", "shift_right": "a >> 2", "add": "a + b", "subtract": "a - b", "multiply": "a * b",
    "modulo": "a % nullif(b, 0)", "to_hex_number": "lower(hex(a))", "bit_count": "bit_count(a)", "unix_to_text": "strftime(to_timestamp(a) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')",
    "ip_from_number": "(a >> 24 & 255) || '.' || (a >> 16 & 255) || '.' || (a >> 8 & 255) || '.' || (a & 255)", "power_of_two": "a > 0 AND a & (a - 1) = 0",
}

#: Operations that read an encoding: what each is given, in both dialects. Every third text is left plain, which is no encoding.
_ENCODED = {
    "from_base64": ("if(id % 3 = 0, concat(x, ' '), replace(base64(cast(x as binary)), '\r\n', ''))", "CASE WHEN id % 3 = 0 THEN NULL ELSE x END"),
    "from_hex": ("if(id % 3 = 0, concat(x, ' z'), hex(cast(x as binary)))", "CASE WHEN id % 3 = 0 THEN NULL ELSE x END"),
    "url_decode": ("if(id % 3 = 0, replace(x, '%', ''), regexp_replace(hex(cast(x as binary)), '(..)', '%$1'))", "CASE WHEN id % 3 = 0 THEN replace(x, '%', '') ELSE x END"),
}

for _op in X.TEXT:
    if _op in _ENCODED:
        continue
    _pages = _op in ("extract_urls", "defang_url", "escape_html", "strip_html_tags", "find_replace")
    _from = "(SELECT page_id AS id, html AS x FROM pages)" if _pages else "(SELECT doc_id AS id, text AS x FROM documents)"

    @register(f"toolkit_{_op}", f"SELECT id, md5(({SQL[_op]})::VARCHAR) AS digest FROM {_from}" if _op in SQL else None)
    def _text(spark, sf_dir, op=_op, pages=_pages):
        """One operation over whole texts, as a digest of each result."""
        df = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("x")) if pages else table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x"))
        out = F.expr(X.TEXT[op]) if op != "to_upper" else F.expr("upper(replace(x, 'ß', '')) || (length(x) - length(replace(x, 'ß', '')))")
        return df.select("id", F.md5(out.cast("string").cast("binary")).alias("digest"))


for _op, (_given, _plain) in _ENCODED.items():

    @register(f"toolkit_{_op}", f"SELECT id, md5(({_plain})::VARCHAR) AS digest FROM (SELECT doc_id AS id, text AS x FROM documents)")
    def _decoded(spark, sf_dir, op=_op, given=_given):
        """Texts in an encoding read back by its operation; texts that are not in it give null."""
        d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x")).select("id", F.expr(given).alias("x"))
        return d.select("id", F.md5(F.expr(X.TEXT[op]).cast("binary")).alias("digest"))


for _op in X.NUMBERS:

    @register(f"toolkit_number_{_op}", f"SELECT a, b, {NUMBER_SQL[_op]} AS result FROM (SELECT o_orderkey AS a, o_custkey AS b FROM orders)" if _op in NUMBER_SQL else None)
    def _number(spark, sf_dir, op=_op):
        return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")).select("a", "b", F.expr(X.NUMBERS[op]).alias("result"))


@register("toolkit_recipe", "SELECT doc_id, md5(to_base64(encode(reverse(upper(replace(text, 'ß', '')))))) AS digest FROM documents")
def toolkit_recipe(spark, sf_dir):
    """A chain of operations, left to right."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("ß"), F.lit("")).alias("text"))
    return X.recipe(d, "text", ["to_upper", "reverse", "to_base64"]).select("doc_id", F.md5(F.col("result").cast("binary")).alias("digest"))


_GROUPS = [list(O.OPERATIONS)[i : i + 12] for i in range(0, len(O.OPERATIONS), 12)]
_TEXTS = "(SELECT 'b' || item_id AS id, text AS x FROM benchmark UNION ALL SELECT 'p' || page_id, url FROM pages)"


def _group(number: int, ops: list[str]):
    @register(f"toolkit_operations_{number}", "SELECT id, " + ", ".join(f"md5(({O.OPERATIONS[op][1]})::VARCHAR) AS {op}" for op in ops) + f" FROM {_TEXTS}")
    def run(spark, sf_dir):
        """A dozen operations over whole texts, a digest of each result."""
        b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias("x"))
        p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("x"))
        return b.unionByName(p).select("id", *[F.md5(F.expr(O.OPERATIONS[op][0]).cast("string").cast("binary")).alias(op) for op in ops])


for _i, _ops in enumerate(_GROUPS, 1):
    _group(_i, _ops)


@register("toolkit_units", "SELECT o_orderkey, " + ", ".join(f"round(o_totalprice * {f!r}, 4) AS {op}" for op, f in O.UNITS.items()) + " FROM orders")
def toolkit_units(spark, sf_dir):
    """Amounts in other units."""
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.round(F.col("o_totalprice") * F.lit(float(f)), 4).alias(op) for op, f in O.UNITS.items()])
