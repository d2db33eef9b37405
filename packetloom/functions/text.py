"""Scalar functions over text as Columns: entropy, ratios, decoding, traversal depth.

What needs a count per character (entropy, chi-square) counts once, in numpy over the buffers of Arrow batches, without a
Python string per row; all else stays in code generation. Repeated decoding names its input once per round, so an expression grows with the rounds and not with their
power.
"""

from __future__ import annotations

from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English letter frequencies, a to z.
ENGLISH = [0.0817, 0.0149, 0.0278, 0.0425, 0.1270, 0.0223, 0.0202, 0.0609, 0.0697, 0.0015, 0.0077, 0.0403, 0.0241, 0.0675, 0.0751, 0.0193, 0.0010, 0.0599, 0.0633, 0.0906, 0.0276, 0.0098, 0.0236, 0.0015, 0.0197, 0.0007]
#: Fixed value: characters that count as special.
SPECIAL = r"""^$(){}[]@!~`|\<>%&*+=;:'\""""
#: Lower bounds of the classes of entropy.
CLASSES = [(7.5, "random"), (7.0, "compressed"), (5.5, "encoded"), (4.5, "text"), (3.0, "structured")]


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def held(value: Column) -> Column:
    """A whole number's Column that filters above its projection do not repeat: the optimizer moves none below it."""
    return value + F.monotonically_increasing_id() * 0


def rounded(value: Column, digits: int) -> Column:
    """A double to some digits as SQL rounds it: scaled, to the nearest whole number, halves away from zero, and back."""
    return F.round(value * float(10**digits), 0) / float(10**digits)


def count_of(text: Column, what: Column | str) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return F.length(text) - F.length(F.replace(text, what, F.lit("")))


def bits(counts) -> float:
    """Shannon's entropy of counts, summed from the smallest share up."""
    import numpy as np

    p = np.sort(counts[counts > 0] / counts.sum()) if counts.sum() else np.empty(0)
    return float(-(p * np.log2(p)).cumsum()[-1]) if len(p) else 0.0


#: What measures() gives of a text: bits per character, and how many characters it has of each kind.
MEASURES = T.StructType([T.StructField("entropy", T.DoubleType()), *[T.StructField(n, T.LongType()) for n in ("chars", "special", "strange", "named", "blank", "coded", "pads")]])
_KINDS = {"special": SPECIAL, "blank": " \t\n\x0b\f\r", "coded": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", "pads": "="}


@cache
def kinds():
    """Which ASCII characters are of each kind, as rows of ones and zeros."""
    import numpy as np

    plain = {chr(c) for c in range(0x20, 0x7F)} | set("\t\n\r")
    rows = {**_KINDS, "strange": {chr(c) for c in range(128)} - plain, "named": {chr(c) for c in range(128) if chr(c).isalnum()}}
    return {k: np.array([chr(c) in v for c in range(128)], np.int64) for k, v in rows.items()}


@cache
def general(kind: str):
    """By code point: whether its general category is of a kind. No letter or number stands above the last."""
    import unicodedata

    import numpy as np

    return np.array([unicodedata.category(chr(c))[0] in kind for c in range(0x32400)] + [False])


def pieces(x):
    """The bytes of each row of an Arrow array, as views of its buffer; None for null."""
    import numpy as np
    import pyarrow as pa

    if not len(x):
        return
    wide = pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type)
    _, at, data = x.buffers()
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1].tolist()
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    for known, a, b in zip(x.is_valid().to_pylist(), ends, ends[1:], strict=False):
        yield data[a:b] if known else None


def counts(b):
    """Counts of the ASCII characters of UTF-8 bytes, and the code points of all others."""
    import numpy as np

    n = np.bincount(b, minlength=256)
    rest = b[b > 127].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace") if n[128:].any() else b""
    return n[:128], np.frombuffer(rest, "<u4")


@F.arrow_udf(T.DoubleType())
def _entropy(x: pa.Array) -> pa.Array:
    import numpy as np

    def of(b):
        ascii_, rest = counts(b)
        return bits(np.concatenate([ascii_, np.unique(rest, return_counts=True)[1]]))

    return pa.array([None if b is None else of(b) for b in pieces(x)], pa.float64())


@F.arrow_udf(MEASURES)
def _measures(x: pa.Array) -> pa.Array:
    import numpy as np

    kind, named, out = kinds(), general("LN"), []
    for b in pieces(x):
        if b is None:
            out.append(None)
            continue
        ascii_, rest = counts(b)
        n = {k: int(ascii_ @ v) for k, v in kind.items()}
        n["named"] += int(named[np.minimum(rest, len(named) - 1)].sum())
        n["strange"] += len(rest)
        out.append({"entropy": bits(np.concatenate([ascii_, np.unique(rest, return_counts=True)[1]])), "chars": int(ascii_.sum()) + len(rest), **n})
    return pa.array(out, pa.struct([("entropy", pa.float64()), *[(f.name, pa.int64()) for f in MEASURES.fields[1:]]]))


@F.arrow_udf(T.BinaryType())
def _byte_counts(x: pa.Array) -> pa.Array:
    import numpy as np

    def of(b):
        n = np.bincount(b, minlength=256)
        some = n.nonzero()[0]
        return np.concatenate([some, n[some]]).astype("<i8").tobytes()

    return pa.array([None if b is None else of(b) for b in pieces(x)], pa.binary())


@F.arrow_udf(T.DoubleType())
def _counted_entropy(x: pa.Array) -> pa.Array:
    import numpy as np

    def of(some):
        n = np.zeros(256, np.int64)
        for c in some:
            at, times = np.frombuffer(c, "<i8").reshape(2, -1)
            n[at] += times
        return bits(n)

    return pa.array([of(row.as_py()) for row in x], pa.float64())


@F.arrow_udf(T.DoubleType())
def _byte_entropy(x: pa.Array) -> pa.Array:
    import numpy as np

    return pa.array([None if b is None else bits(np.bincount(b, minlength=256)) for b in pieces(x)], pa.float64())


@F.arrow_udf(T.DoubleType())
def _chi_square(x: pa.Array) -> pa.Array:
    import numpy as np

    want, letter = np.array(ENGLISH), general("L")

    def of(b):
        ascii_, rest = counts(b)
        low = ascii_[65:91] + ascii_[97:123]
        n = int(low.sum()) + int(letter[np.minimum(rest, len(letter) - 1)].sum())
        if n < 10:
            return float("inf")
        low[8] += (rest == 0x130).sum()
        low[10] += (rest == 0x212A).sum()
        off = low - want * n
        return float((off * off / (want * n)).cumsum()[-1])

    return pa.array([float("inf") if b is None else of(b) for b in pieces(x)], pa.float64())


def entropy(text: Column) -> Column:
    """Bits per character of the characters' distribution; 0 for no text, null for null."""
    return _entropy(text)


def measures(text: Column) -> Column:
    """Entropy and counts of characters by kind (MEASURES), all from one pass; null for null."""
    return _measures(text)


def byte_counts(data: Column) -> Column:
    """The bytes that occur and how often, packed; counted_entropy() takes many of them together."""
    return _byte_counts(data)


def counted_entropy(some: Column) -> Column:
    """byte_entropy() of all the data whose byte_counts() an array holds."""
    return _counted_entropy(some)


def byte_entropy(data: Column) -> Column:
    """Bits per byte of the bytes' distribution; 0 for none, null for null."""
    return _byte_entropy(data)


def entropy_class(h: Column) -> Column:
    return reduce(lambda out, x: F.when(h >= x[0], x[1]).otherwise(out), reversed(CLASSES), F.lit("empty"))


def meaningful_entropy(h: Column) -> Column:
    """Whether an entropy lies between structured and compressed data."""
    return (h >= 3.0) & (h <= 7.0)


def ratio(text: Column, pattern: str) -> Column:
    """Share of characters that the pattern matches; 0 for no text."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def printable_ratio(data: Column) -> Column:
    """Share of bytes that are printable ASCII."""
    return ratio(F.decode(data, "ISO-8859-1"), r"[\x20-\x7E]")


def chi_square_english(text: Column) -> Column:
    """Chi-square of the letters against English; infinite under ten letters."""
    return _chi_square(text)


def url_decoded(text: Column, rounds: int) -> Column:
    """Percent-decoding, repeated while there are escapes; plus signs and malformed escapes stay."""

    def once(t: Column) -> Column:
        plain = F.try_url_decode(F.replace(F.regexp_replace(t, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
        return F.when(F.contains(t, F.lit("%")), F.coalesce(plain, t)).otherwise(t)

    for _ in range(rounds):
        text = bind(text, once)
    return text


def traversal_depth(path: Column) -> Column:
    """The deepest run of parent steps, a named step taking one back."""
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("top"))

    def step(acc: Column, c: Column) -> Column:
        cur = F.when(c == "..", acc["cur"] + 1).when((c != "") & (c != "."), F.greatest(F.lit(0), acc["cur"] - 1)).otherwise(acc["cur"])
        return F.struct(cur.alias("cur"), F.greatest(acc["top"], cur).alias("top"))

    def of(p: Column) -> Column:
        steps = F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/")
        return F.when(F.contains(p, F.lit("..")), F.aggregate(steps, start, step, lambda a: a["top"])).otherwise(0)

    return bind(path, of)


def shown(text: Column, pattern: str = r"[\x20-\x7E\t\n\r]") -> Column:
    """Share of characters that the pattern (printable ASCII by default) matches."""
    return ratio(text, pattern)


def without_bad_utf8(data: Column) -> Column:
    """Bytes as text; what is not UTF-8 goes (and so do replacement characters)."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))


def detect_base64(text: Column) -> Column:
    """Confidence that a text is base64: 1.0 if it is, else null."""

    def of(t: Column) -> Column:
        alphabet, pads = ratio(t, "[A-Za-z0-9+/=]"), count_of(t, "=")
        return F.when((F.length(t) >= 1) & (alphabet >= 0.95) & (F.length(t) % 4 == 0) & (pads <= 2) & F.endswith(t, F.repeat(F.lit("="), pads)), F.lit(1.0))

    return F.when(F.length(text) >= 4, bind(F.regexp_replace(text, r"^\s+|\s+$", ""), of))


def detect_hex(text: Column) -> Column:
    """Confidence that a text is hexadecimal, its prefixes aside, else null."""

    def of(t: Column) -> Column:
        share = ratio(t, "[0-9A-Fa-f]")
        return F.when((F.length(t) > 0) & (share >= 0.95) & (F.length(t) % 2 == 0), 0.85 + 0.15 * share)

    plain = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^0[xX]", "")
    plain = F.when(F.startswith(plain, F.lit("\\x")), F.replace(plain, F.lit("\\x"), F.lit(""))).otherwise(plain)
    return F.when(F.length(text) >= 2, bind(plain, of))


def detect_url(text: Column) -> Column:
    """Confidence that a text is percent-encoded, else null."""
    found, signs = F.regexp_count(text, F.lit("%[0-9A-Fa-f]{2}")), count_of(text, "%")
    share = 3 * found / F.length(text)
    return F.when((found > 0) & (share > 0.1) & (found == signs), F.least(F.lit(0.95), 0.5 + share))


def best_encoding(text: Column) -> Column:
    """(name, confidence) of the likeliest encoding; base64 before hex before url on ties, null where none fits."""
    tried = F.array(*[F.struct((-of(text)).alias("c"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, of) in enumerate((("base64", detect_base64), ("hex", detect_hex), ("url", detect_url)))])
    return bind(F.array_min(F.filter(tried, lambda z: z["c"].isNotNull())), lambda z: F.when(z.isNotNull(), F.struct(z["n"].alias("name"), (-z["c"]).alias("confidence"))))


def composite_confidence(h: Column, printable: Column, english: Column, meaningful: Column) -> Column:
    """How much a text looks like plain language, 0 to 1, from its entropy, printable share, chi-square and class."""
    return F.least(F.lit(1.0), F.when(h.between(3.5, 6.5), 0.3).otherwise(0.0) + 0.3 * printable + F.when(english, 0.2).otherwise(0.0) + F.when(meaningful, 0.2).otherwise(0.0))


def likely_base64(text: Column) -> Column:
    """Whether 20 characters or more are base64 but for white space and a few strays, and decode."""

    def of(clean: Column) -> Column:
        share = ratio(clean, "[A-Za-z0-9+/=]")
        return (share >= 0.95) & (count_of(clean, "=") <= 2) & (F.length(F.regexp_replace(clean, "[^A-Za-z0-9+/=]", "")) % 4 == 0)

    return (F.length(text) >= 20) & bind(F.regexp_replace(text, r"\s", ""), of)


def file_size(n: Column) -> Column:
    """A size in bytes for people."""
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))


def ssrc(value: Column) -> Column:
    """A stream source as 0x and lower-case hexadecimal digits without leading zeros; what is no number, in lower case."""

    def of(t: Column) -> Column:
        digits = F.when(F.lower(t).rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 64), 16, 16)).when(t.rlike("^[0-9]+$"), F.conv(t, 10, 16))
        return F.coalesce(F.concat(F.lit("0x"), F.lower(digits)), F.lower(t))

    return bind(F.regexp_replace(value, r"^\s+|\s+$", ""), of)
