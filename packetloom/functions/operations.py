"""More operations of the transform library: bytes, checksums, ciphers, lines, alphabets and extractors.

An operation is a pair of SQL expressions over `x`, for this engine and for its twin. Bytes are lists of numbers, made of the
text's UTF-8 form; results are texts, bytes as hexadecimal digits. Keys and widths are parameters of the functions that make
the families; the registered ones have fixed ones.
"""

from __future__ import annotations

#: Words and signs of letters and digits.
NATO = ["Alfa", "Bravo", "Charlie", "Delta", "Echo", "Foxtrot", "Golf", "Hotel", "India", "Juliett", "Kilo", "Lima", "Mike", "November", "Oscar", "Papa", "Quebec", "Romeo", "Sierra", "Tango", "Uniform", "Victor", "Whiskey", "X-ray", "Yankee", "Zulu"]
LEET = ("abegilorstz", "48369102572")
MODHEX = ("0123456789abcdef", "cbdefghijklnrtuv")
BRAILLE = (" abcdefghijklmnopqrstuvwxyz", "⠀⠁⠃⠉⠙⠑⠋⠛⠓⠊⠚⠅⠇⠍⠝⠕⠏⠟⠗⠎⠞⠥⠧⠺⠭⠽⠵")
DIACRITICS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
LOW, UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

B = "transform(regexp_extract_all(hex(cast(x as binary)), '..', 0), b -> cast(conv(b, 16, 10) as int))"
B2 = "list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: ('0x' || b)::INT)"


def hexed(spark: str, duck: str) -> tuple[str, str]:
    return f"array_join(transform({spark}, v -> lpad(lower(hex(v)), 2, '0')), '')", f"array_to_string(list_transform({duck}, lambda v: lpad(lower(to_hex(v)), 2, '0')), '')"


def keyed(op: str, key: list[int]) -> tuple[str, str]:
    """Bytes with those of a key that is repeated; op over b and k."""
    n, ks = len(key), ", ".join(map(str, key))
    spark_key, duck_key = f"element_at(array({ks}), i % {n} + 1)", f"[{ks}][(i - 1) % {n} + 1]"
    duck = f"xor(b, {duck_key})" if "^" in op else op.replace("k", duck_key)
    return hexed(f"transform({B}, (b, i) -> {op.replace('k', spark_key)})", f"list_transform({B2}, lambda b, i: {duck})")


def mapped(op: str) -> tuple[str, str]:
    """Bytes by an expression over b."""
    return hexed(f"transform({B}, b -> {op})", f"list_transform({B2}, lambda b: {op.replace(' div ', ' // ')})")


def table(source: str, target: str) -> tuple[str, str]:
    """Characters replaced by those at the same place."""
    q = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    return f"translate(x, '{q(source)}', '{q(target)}')", f"translate(x, '{source.replace(chr(39), chr(39) * 2)}', '{target.replace(chr(39), chr(39) * 2)}')"


def shifted(key: str, back: bool = False) -> tuple[str, str]:
    """Letters moved by those of a word, letter by letter of ASCII texts; other characters stay but use up the word's letters."""
    moves = [(26 - (ord(c) - 97)) % 26 if back else ord(c) - 97 for c in key]
    ks = ", ".join(map(str, moves))
    n = len(moves)
    spark = f"array_join(transform(split(x, ''), (c, i) -> case when c rlike '^[a-z]$' then char(97 + (ascii(c) - 97 + element_at(array({ks}), i % {n} + 1)) % 26) when c rlike '^[A-Z]$' then char(65 + (ascii(c) - 65 + element_at(array({ks}), i % {n} + 1)) % 26) else c end), '')"
    duck = f"array_to_string(list_transform(string_split(x, ''), lambda c, i: CASE WHEN regexp_matches(c, '^[a-z]$') THEN chr((97 + (ascii(c) - 97 + [{ks}][(i - 1) % {n} + 1]) % 26)::INT) WHEN regexp_matches(c, '^[A-Z]$') THEN chr((65 + (ascii(c) - 65 + [{ks}][(i - 1) % {n} + 1]) % 26)::INT) ELSE c END), '')"
    return spark, duck


def affine(a: int, b: int) -> tuple[str, str]:
    low = "".join(LOW[(a * i + b) % 26] for i in range(26))
    return table(LOW + UP, low + low.upper())


def lines(spark: str, duck: str) -> tuple[str, str]:
    """Lines put together again after an expression over the list l of them."""
    return f"array_join({spark.replace('{l}', chr(115) + 'plit(x, ' + chr(39) + chr(92) + 'n' + chr(39) + ')')}, '\\n')", f"array_to_string({duck.replace('{l}', 'string_split(x, chr(10))')}, chr(10))"


def found(pattern: str, group: int = 0) -> tuple[str, str]:
    """Matches of a pattern, comma-joined."""
    return f"array_join(regexp_extract_all(x, '{pattern.replace(chr(92), chr(92) * 2)}', {group}), ',')", f"array_to_string(regexp_extract_all(x, '{pattern}', {group}), ',')"


def fold(start: str, step: str, end: str, duck: str) -> tuple[str, str]:
    return f"cast(aggregate({B}, {start}, (a, b) -> {step}, a -> {end}) as string)", f"({duck})::VARCHAR"


_NATO = "array(" + ", ".join(f"'{w}'" for w in NATO) + ")"
_NATO2 = "[" + ", ".join(f"'{w}'" for w in NATO) + "]"
_SUM = f"coalesce(list_sum({B2}), 0)"
_WEIGHTED = f"coalesce(list_sum(list_transform({B2}, lambda b, i: b * (len({B2}) - i + 1))), 0)"

OPERATIONS: dict[str, tuple[str, str]] = {
    # Bytes.
    "add": keyed("(b + k) % 256", [1, 2, 3]),
    "sub": keyed("(b - k + 256) % 256", [1, 2, 3]),
    "xor_key": keyed("b ^ k", [90, 165]),
    "and_key": keyed("b & k", [15, 240]),
    "or_key": keyed("b | k", [1, 128]),
    "not_bytes": mapped("255 - b"),
    "bit_shift_left": mapped("(b * 2) % 256"),
    "bit_shift_right": mapped("b div 2"),
    "rotate_left": mapped("(b * 8) % 256 + b div 32"),
    "rotate_right": mapped("(b * 32) % 256 + b div 8"),
    "take_bytes": hexed(f"slice({B}, 3, 7)", f"{B2}[3:9]"),
    "drop_bytes": hexed(f"concat(slice({B}, 1, 2), slice({B}, 10, 1000000000))", f"list_concat({B2}[1:2], {B2}[10:])"),
    "take_nth_bytes": hexed(f"filter({B}, (b, i) -> i % 4 = 0)", f"list_filter({B2}, lambda b, i: (i - 1) % 4 = 0)"),
    "drop_nth_bytes": hexed(f"filter({B}, (b, i) -> i % 4 <> 0)", f"list_filter({B2}, lambda b, i: (i - 1) % 4 <> 0)"),
    "reverse_bytes": hexed(f"reverse({B})", f"list_reverse({B2})"),
    "swap_endianness": hexed("filter(flatten(transform(sequence(0, greatest(0, (octet_length(x) + 3) div 4 - 1)), w -> transform(array(3, 2, 1, 0), j -> cast(conv(nullif(substr(hex(cast(x as binary)), 2 * (w * 4 + j) + 1, 2), ''), 16, 10) as int)))), v -> v is not null)", f"list_filter(flatten(list_transform(range(0, greatest(1, (len({B2}) + 3) // 4)), lambda w: list_transform([3, 2, 1, 0], lambda j: {B2}[w * 4 + j + 1]))), lambda v: v IS NOT NULL)"),
    "to_decimal": (f"array_join({B}, ' ')", f"array_to_string({B2}, ' ')"),
    "to_octal": (f"array_join(transform({B}, b -> conv(b, 10, 8)), ' ')", f"array_to_string(list_transform({B2}, lambda b: CASE WHEN b >= 64 THEN (b // 64) || '' || (b // 8 % 8) || '' || (b % 8) WHEN b >= 8 THEN (b // 8) || '' || (b % 8) ELSE b::VARCHAR END), ' ')"),
    "to_binary": (f"array_join(transform({B}, b -> lpad(bin(b), 8, '0')), ' ')", f"array_to_string(list_transform({B2}, lambda b: lpad(bin(b), 8, '0')), ' ')"),
    "to_hex_colon": ("regexp_replace(lower(hex(cast(x as binary))), '(..)(?=.)', '$1:')", "array_to_string(regexp_extract_all(lower(hex(encode(x))), '..'), ':')"),
    "to_modhex": (f"translate(lower(hex(cast(x as binary))), '{MODHEX[0]}', '{MODHEX[1]}')", f"translate(lower(hex(encode(x))), '{MODHEX[0]}', '{MODHEX[1]}')"),
    "from_hex_words": ("cast(unhex(regexp_replace(regexp_replace(hex(cast(x as binary)), '(..)', '$1 '), ' ', '')) as string)", "x"),
    "byte_length": ("cast(octet_length(x) as string)", "octet_length(encode(x))::VARCHAR"),
    # Checksums and measures.
    "xor_checksum": (f"lower(hex(aggregate({B}, 0, (a, b) -> a ^ b)))", f"lower(to_hex(list_reduce(list_prepend(0, {B2}), lambda a, b: xor(a, b))))"),
    "fletcher_8": fold("named_struct('a', 0, 'b', 0)", "named_struct('a', (a.a + b) % 15, 'b', (a.b + a.a + b) % 15)", "a.b * 16 + a.a", f"(({_WEIGHTED}) % 15) * 16 + ({_SUM}) % 15"),
    "fletcher_16": fold("named_struct('a', 0, 'b', 0)", "named_struct('a', (a.a + b) % 255, 'b', (a.b + a.a + b) % 255)", "a.b * 256 + a.a", f"(({_WEIGHTED}) % 255) * 256 + ({_SUM}) % 255"),
    "adler_32": fold("named_struct('a', 1L, 'b', 0L)", "named_struct('a', (a.a + b) % 65521, 'b', (a.b + a.a + b) % 65521)", "a.b * 65536 + a.a", f"((({_WEIGHTED}) + len({B2})) % 65521) * 65536 + (1 + {_SUM}) % 65521"),
    "byte_sum": fold("0L", "a + b", "a", _SUM),
    "index_of_coincidence": ("cast(round(aggregate(transform(sequence(0, 25), i -> length(regexp_replace(lower(x), concat('[^', char(97 + i), ']'), ''))), 0D, (a, n) -> a + n * (n - 1)) / nullif(greatest(1, length(regexp_replace(lower(x), '[^a-z]', '')) * (length(regexp_replace(lower(x), '[^a-z]', '')) - 1)), 0), 6) as string)", "round(list_sum(list_transform(range(0, 26), lambda i: (length(lower(x)) - length(replace(lower(x), chr((97 + i)::INT), ''))) * (length(lower(x)) - length(replace(lower(x), chr((97 + i)::INT), '')) - 1)))::DOUBLE / greatest(1, length(regexp_replace(lower(x), '[^a-z]', '', 'g')) * (length(regexp_replace(lower(x), '[^a-z]', '', 'g')) - 1)), 6)::VARCHAR"),
    "count_occurrences": ("cast(regexp_count(x, 'th') as string)", "len(regexp_extract_all(x, 'th'))::VARCHAR"),
    "hamming_to_reverse": (f"cast(aggregate(zip_with({B}, reverse({B}), (a, b) -> bit_count(a ^ b)), 0, (a, n) -> a + n) as string)", f"coalesce(list_sum(list_transform(list_zip({B2}, list_reverse({B2})), lambda p: bit_count(xor(p[1], p[2])))), 0)::VARCHAR"),
    "luhn_checksum": ("cast(aggregate(transform(reverse(split(regexp_replace(x, '[^0-9]', ''), '')), (d, i) -> case when i % 2 = 0 then cast(nullif(d, '') as int) * 2 - if(cast(nullif(d, '') as int) > 4, 9, 0) else cast(nullif(d, '') as int) end), 0, (a, n) -> a + coalesce(n, 0)) * 9 % 10 as string)", "(coalesce(list_sum(list_transform(list_reverse(string_split(regexp_replace(x, '[^0-9]', '', 'g'), '')), lambda d, i: CASE WHEN i % 2 = 1 THEN coalesce(TRY_CAST(d AS INT), 0) * 2 - CASE WHEN TRY_CAST(d AS INT) > 4 THEN 9 ELSE 0 END ELSE coalesce(TRY_CAST(d AS INT), 0) END)), 0) * 9 % 10)::INT::VARCHAR"),
    # Ciphers and alphabets.
    "affine_cipher": affine(5, 8),
    "affine_decode": affine(21, (-21 * 8) % 26),
    "caesar_3": table(LOW + UP, LOW[3:] + LOW[:3] + UP[3:] + UP[:3]),
    "vigenere_encode": shifted("key"),
    "vigenere_decode": shifted("key", True),
    "rot5": table("0123456789", "5678901234"),
    "substitute": table("aeiou", "uoiea"),
    "leet": table(*LEET),
    "braille": ("translate(lower(x), '{}', '{}')".format(*BRAILLE), "translate(lower(x), '{}', '{}')".format(*BRAILLE)),
    "remove_diacritics": table(*DIACRITICS),
    "a1z26_encode": ("array_join(transform(regexp_extract_all(lower(x), '[a-z]', 0), c -> ascii(c) - 96), ' ')", "array_to_string(list_transform(regexp_extract_all(lower(x), '[a-z]'), lambda c: ascii(c) - 96), ' ')"),
    "nato_alphabet": (f"array_join(transform(regexp_extract_all(lower(x), '[a-z]', 0), c -> element_at({_NATO}, ascii(c) - 96)), ' ')", f"array_to_string(list_transform(regexp_extract_all(lower(x), '[a-z]'), lambda c: {_NATO2}[ascii(c) - 96]), ' ')"),
    "alternating_caps": ("array_join(transform(split(x, ''), (c, i) -> if(i % 2 = 0, lower(c), upper(c))), '')", "array_to_string(list_transform(string_split(x, ''), lambda c, i: CASE WHEN i % 2 = 1 THEN lower(c) WHEN c = 'ß' THEN 'SS' ELSE upper(c) END), '')"),
    "case_insensitive_regex": ("regexp_replace(regexp_replace(x, '([a-z])', '[$1]'), '([A-Z])', '[$1]')", "regexp_replace(regexp_replace(x, '([a-z])', '[\\1]', 'g'), '([A-Z])', '[\\1]', 'g')"),
    # Lines.
    "add_line_numbers": lines("transform({l}, (s, i) -> concat(cast(i + 1 as string), ' ', s))", "list_transform({l}, lambda s, i: i || ' ' || s)"),
    "remove_line_numbers": lines("transform({l}, s -> regexp_replace(s, '^[ ]*[0-9]+[ :.]*', ''))", "list_transform({l}, lambda s: regexp_replace(s, '^[ ]*[0-9]+[ :.]*', ''))"),
    "pad_lines": lines("transform({l}, s -> concat('  ', s))", "list_transform({l}, lambda s: '  ' || s)"),
    "sort_lines_reverse": lines("reverse(array_sort({l}))", "list_reverse_sort({l})"),
    "sort_lines_length": lines("transform(array_sort(transform({l}, s -> named_struct('n', length(s), 's', s))), z -> z.s)", "list_transform(list_sort(list_transform({l}, lambda s: {'n': length(s), 's': s})), lambda z: z.s)"),
    "sort_lines_ignore_case": lines("transform(array_sort(transform({l}, s -> named_struct('k', lower(s), 's', s))), z -> z.s)", "list_transform(list_sort(list_transform({l}, lambda s: {'k': lower(s), 's': s})), lambda z: z.s)"),
    "sort_lines_numeric": lines("transform(array_sort(transform({l}, s -> named_struct('k', coalesce(cast(nullif(regexp_extract(s, '([0-9]{1,9})', 1), '') as bigint), -1L), 's', s))), z -> z.s)", "list_transform(list_sort(list_transform({l}, lambda s: {'k': coalesce(TRY_CAST(regexp_extract(s, '([0-9]{1,9})', 1) AS BIGINT), -1), 's': s})), lambda z: z.s)"),
    "tail_after_first": lines("slice({l}, 2, 1000000000)", "{l}[2:]"),
    "split_commas": ("array_join(split(x, ','), '\\n')", "array_to_string(string_split(x, ','), chr(10))"),
    "count_unique_lines": ("cast(size(array_distinct(split(x, '\\n'))) as string)", "len(list_distinct(string_split(x, chr(10))))::VARCHAR"),
    # Names and escapes.
    "kebab_case": ("lower(regexp_replace(x, '[^A-Za-z0-9]+', '-'))", "lower(regexp_replace(x, '[^A-Za-z0-9]+', '-', 'g'))"),
    "camel_case": ("array_join(transform(regexp_extract_all(x, '[A-Za-z0-9]+', 0), (w, i) -> if(i = 0, lower(w), concat(upper(substr(w, 1, 1)), lower(substr(w, 2))))), '')", "array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z0-9]+'), lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), '')"),
    "defang_ip": ("regexp_replace(x, '([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})', '$1[.]$2[.]$3[.]$4')", "regexp_replace(x, '([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})', '\\1[.]\\2[.]\\3[.]\\4', 'g')"),
    "fang_url": ("replace(replace(replace(x, '[.]', '.'), '[://]', '://'), 'hxxp', 'http')", "replace(replace(replace(x, '[.]', '.'), '[://]', '://'), 'hxxp', 'http')"),
    "escape_quotes": ("replace(replace(x, '\\\\', '\\\\\\\\'), '\\'', '\\\\\\'')", "replace(replace(x, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39))"),
    "url_encode_all": ("regexp_replace(hex(cast(x as binary)), '(..)', '%$1')", "regexp_replace(hex(encode(x)), '(..)', '%\\1', 'g')"),
    "strip_http_headers": ("if(locate('\\r\\n\\r\\n', x) > 0, substr(x, locate('\\r\\n\\r\\n', x) + 4), x)", "CASE WHEN strpos(x, chr(13) || chr(10) || chr(13) || chr(10)) > 0 THEN substr(x, strpos(x, chr(13) || chr(10) || chr(13) || chr(10)) + 4) ELSE x END"),
    "remove_null_bytes": ("replace(x, char(0), '')", "replace(x, chr(0), '')"),
    "html_entities_numeric": ("array_join(transform(split(x, ''), c -> if(c rlike '^[A-Za-z0-9 ]?$' and c <> '\\n', c, concat('&#', hex(cast(c as binary)), ';'))), '')", "array_to_string(list_transform(string_split(x, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9 ]$') OR c = '' THEN c ELSE '&#' || hex(encode(c)) || ';' END), '')"),
    # Extractors.
    "extract_domains": found("[a-z0-9-]+(?:[.][a-z0-9-]+)*[.](?:com|org|net|example)"),
    "extract_mac": found("[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}"),
    "extract_dates": found("[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    "extract_paths": found("/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+"),
    "extract_numbers": found("[0-9]+(?:[.][0-9]+)?"),
    "extract_strings": found("[A-Za-z]{8,}"),
    "extract_hashes_md5": found("[0-9a-f]{32}"),
    "url_scheme": ("regexp_extract(x, '^([a-z]+)://', 1)", "regexp_extract(x, '^([a-z]+)://', 1)"),
    "url_host": ("regexp_extract(x, '^[a-z]+://([^/:?#]+)', 1)", "regexp_extract(x, '^[a-z]+://([^/:?#]+)', 1)"),
    "url_query": ("regexp_extract(x, '[?]([^#]*)', 1)", "regexp_extract(x, '[?]([^#]*)', 1)"),
}

#: Conversions of numbers: operation -> the factor of a, in both dialects.
UNITS = {"miles_to_km": 1.609344, "km_to_miles": 1 / 1.609344, "feet_to_metres": 0.3048, "pounds_to_kg": 0.45359237, "acres_to_m2": 4046.8564224, "knots_to_mps": 1852 / 3600, "bytes_to_bits": 8, "kib_to_bytes": 1024}
