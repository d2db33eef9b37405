"""File identification: magic numbers, embedded files and carving, disguise, malicious content, and what is worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..rules import webshell as W


def embedded(df: DataFrame, key: str, data: str, signatures: list[tuple]) -> DataFrame:
    """(key, place, extension) for every place in the bytes where a signature stands, at its offset.

    Bytes are searched as hexadecimal text split at each magic; pieces of even running length are true byte places.
    """
    found = []
    for magic, offset, ext, *_ in signatures:
        pieces = F.split(F.hex(F.col(data)), magic.upper(), -1)
        n = len(magic)
        ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + n, F.lit(0)) + F.length(p))))  # noqa: B023
        places = F.filter(ends, lambda e: (e % 2 == 0) & (e >= 2 * offset))  # noqa: B023
        found.append(F.transform(places, lambda e: F.struct((e / 2 - offset).cast("int").alias("place"), F.lit(ext).alias("extension"))))  # noqa: B023
    return df.select(key, F.explode(F.concat(*found)).alias("x")).select(key, "x.place", "x.extension").distinct()


def carved(found: DataFrame, key: str, size: DataFrame) -> DataFrame:
    """(key, place, extension, length): each embedded file reaches to the next one or to the end."""
    w = Window.partitionBy(key).orderBy("place", "extension")
    return found.withColumn("next", F.lead("place").over(w)).join(size, key).select(key, "place", "extension", (F.coalesce("next", "size") - F.col("place")).alias("length"))


def text_of(content: Column, most: int) -> Column:
    """The first bytes as text, one character a byte."""
    return F.decode(F.substring(content, 1, most), "ISO-8859-1")


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def extension(name: Column) -> Column:
    """What follows a name's last dot, in lower case; nothing without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def stem(name: Column) -> Column:
    """A name without its extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def disguised(ext: Column, real: Column) -> Column:
    """Whether an extension hides a program, script or archive."""
    page = ext.isin(W.IMAGES + W.DOCUMENTS)
    hidden = (real.isin(W.EXECUTABLES) & page) | (real.isin(W.SCRIPTS) & page) | (real.isin(W.ARCHIVES) & ext.isin(W.IMAGES))
    return F.when((ext == "") | (real == "") | (ext == real), False).otherwise(hidden)


def random_name(name: Column) -> Column:
    """Whether a name is a string of 16 hexadecimal digits or more, or of more than 24 base64 characters."""
    s = stem(name)
    return (F.length(s) >= 16) & (s.rlike("^[0-9a-fA-F]+$") | (s.rlike("^[A-Za-z0-9+/=]+$") & (F.length(s) > 24)))


def binary(content: Column) -> Column:
    """Whether over three tenths of the first 1024 bytes are not printable ASCII."""
    return X.ratio(text_of(content, 1024), r"[^\x20-\x7E]") > 0.3


def is_archive(ext: Column) -> Column:
    return F.lower(ext).isin(W.ARCHIVES)


def is_executable(ext: Column) -> Column:
    return F.lower(ext).isin(W.EXECUTABLES)


def service_kind(content: Column) -> Column:
    """(extension, mime, category, description) by the first bytes, the longest signature first; null for none."""
    head = F.hex(F.substring(content, 1, 32))
    out = F.lit(None).cast("struct<extension:string,mime:string,category:string,description:string>")
    for magic, *info in sorted(W.SERVICE_MAGIC, key=lambda m: len(m[0])):
        row = F.struct(*[F.lit(v).alias(n) for n, v in zip(("extension", "mime", "category", "description"), info, strict=True)])
        out = F.when(F.startswith(head, F.lit(magic)), row).otherwise(out)
    return out


def malicious(df: DataFrame, content: str) -> DataFrame:
    """df with `malicious` (reason, extension, category) by the first pair of markers in the first 50 KiB; null for none."""
    df = df.withColumns({"_h": X.byte_entropy(F.substring(F.col(content), 1, 4096)), "_raw": text_of(F.col(content), 50 * 1024)})
    low = F.lower(F.col("_raw"))
    row = lambda why, ext, kind: F.struct((why if isinstance(why, Column) else F.lit(why)).alias("reason"), F.lit(ext).alias("extension"), F.lit(kind).alias("category"))
    out = F.lit(None).cast("struct<reason:string,extension:string,category:string>")

    def pairs(rules, out: Column) -> Column:
        for a, b, why, ext, kind in reversed(rules):
            both = F.contains(low, F.lit(a)) & (F.contains(low, F.lit(b)) if b else F.lit(True))
            out = F.when(both, row(why, ext, kind)).otherwise(out)
        return out

    out = pairs(W.MALICIOUS_JS, out)
    packed = F.hex(F.substring(F.col(content), 1, 4)).rlike("^(504B|52617221|1F8B|377A)")
    out = F.when((F.col("_h") > 7.5) & ~packed, row(F.concat(F.lit("High entropy ("), F.format_number("_h", 2), F.lit(") - possibly encrypted")), "bin", "encrypted")).otherwise(out)
    out = pairs(W.MALICIOUS_BATCH, out)
    for d in reversed(W.SHELL_DANGERS):
        out = F.when(F.startswith("_raw", F.lit("#!/")) & F.contains(low, F.lit(d)), row(f"Shell script with {d}", "sh", "script")).otherwise(out)
    return df.withColumn("malicious", pairs(W.MALICIOUS, out)).drop("_h", "_raw")


def unknown_kind(content: Column, size: Column) -> Column:
    """(reason, extension, category) of a file without a known extension, from its first 8192 bytes; null for none."""
    t, raw = text_of(content, 8192), binary(content)
    row = lambda why, ext, kind: F.struct(F.lit(why).alias("reason"), F.lit(ext).alias("extension"), F.lit(kind).alias("category"))
    out = F.lit(None).cast("struct<reason:string,extension:string,category:string>")
    for marker, why in reversed(W.SCRIPT_MARKERS):
        out = F.when(F.contains(F.substring(t, 1, 500), F.lit(marker)), row(why, "txt", "script")).otherwise(out)
    out = F.when(raw & (size > 10 * 1024), row("Large binary file", "bin", "binary")).otherwise(out)
    out = F.when(raw & (size > 1024) & F.contains(F.substring(t, 1, 100), F.lit("\x7fELF")), row("ELF executable", "elf", "executable")).otherwise(out)
    return F.when(raw & (size > 1024) & (F.contains(t, F.lit("This program")) | F.contains(t, F.lit("PE\x00\x00"))), row("Possible PE executable", "exe", "executable")).otherwise(out)


def kept_files(df: DataFrame, name: str, content: str) -> DataFrame:
    """df with `verdict` (keep, extension, category, reason): what an extracted file is kept as, or not.

    In this order: known archives, programs, documents and scripts by their first bytes; malicious content; unknown
    extensions by their content; not kept: API answers, short random names, pages, errors and small JSON; then extensions
    worth keeping unless tiny, and large binaries.
    """
    df = malicious(df, content).withColumns({"_kind": service_kind(F.col(content)), "_size": F.octet_length(content), "_ext": extension(F.col(name)), "_low": F.lower(name)})
    df = df.withColumns({"_unknown": unknown_kind(F.col(content), F.col("_size")), "_head": text_of(F.col(content), 512)})
    size, ext, head = F.col("_size"), F.concat(F.lit("."), F.col("_ext")), F.lower("_head")
    row = lambda keep, e, kind, why: F.struct(F.lit(keep).alias("keep"), e.cast("string").alias("extension"), kind.cast("string").alias("category"), why.cast("string").alias("reason"))
    drop = lambda why: row(False, F.lit(None), F.lit(None), F.lit(why))
    kind = F.col("_kind")
    real = F.coalesce(kind["extension"], F.lit(""))
    hidden = F.when(disguised(F.col("_ext"), real), F.concat(kind["description"], F.lit(" under another extension"))).otherwise(kind["description"])
    by_kind = row(True, F.coalesce(kind["extension"], F.col("_ext")), F.coalesce(kind["category"], F.lit("file")), F.coalesce(hidden, F.lit("extension")))
    api = any_of(F.col("_low"), W.API_NAMES) & ~F.exists(F.array(*map(F.lit, W.API_NAMES_KEEP)), lambda e: F.endswith("_low", e))
    small = (ext.isin(W.SMALL_IMAGES) & (size < 1024)) | (ext.isin(W.SMALL_TEXTS) & (size < 500))
    verdict = (
        F.when(kind.isNotNull() & (real.isin("zip", "rar", "7z", "gz", "exe", "elf", "pdf", "dll", "class") | kind["category"].isin("script", "executable") | ((real == "cab") & (size > 50 * 1024))), by_kind)
        .when(F.col("malicious").isNotNull(), row(True, F.col("malicious.extension"), F.lit("suspicious"), F.col("malicious.reason")))
        .when(~ext.isin(W.KNOWN) & F.col("_unknown").isNotNull(), row(True, F.col("_unknown.extension"), F.col("_unknown.category"), F.col("_unknown.reason")))
        .when(api, drop("API answer"))
        .when(random_name(F.col(name)) & (size < 10 * 1024) & ~binary(F.col(content)), drop("random name"))
        .when(any_of(F.substring(head, 1, 200), W.HTML_MARKERS) | any_of(head, W.ERROR_MARKERS), drop("page or error"))
        .when(any_of(F.col("_head"), W.JSON_MARKERS) & (size < 10 * 1024), drop("JSON answer"))
        .when(ext.isin(W.VALUABLE), F.when(small, drop("too small")).otherwise(by_kind))
        .when((size > 50 * 1024) & binary(F.col(content)), by_kind)
        .otherwise(drop("not worth keeping"))
    )
    return df.withColumn("verdict", verdict).drop("_kind", "_size", "_ext", "_low", "_unknown", "_head", "malicious")


def real_download() -> Column:
    """Whether a response (content_type, disposition, uri, code, size) is a file that was downloaded."""
    kind, uri = F.lower("content_type"), F.lower("uri")
    small = F.contains(kind, F.lit("octet-stream")) & (F.col("size") < 1024)
    plain = ~any_of(uri, W.API_PATHS) & ~small
    fits = F.contains(F.lower("disposition"), F.lit("attachment")) | (any_of(kind, W.DOWNLOAD_TYPES) & plain) | ((F.col("size") > 50 * 1024) & ~any_of(kind, W.DOWNLOAD_TYPES_NOT) & plain)
    return ~F.col("code").rlike("^[45]") & (F.col("size") >= 500) & fits


def restored(df: DataFrame, key: str, content: str, signatures: list[tuple]) -> DataFrame:
    """df's key with (extension, mime, category, description, offset) of what the content is by the longest signature, and the
    content from the signature's file on; unknown content stays whole."""
    data = F.hex(F.substring(F.col(content), 1, 512))
    rows = F.array(*[F.struct(F.lit(len(m)).alias("n"), F.lit(-i).alias("first"), F.lit(m.upper()).alias("magic"), F.lit(o).alias("offset"), F.lit(e).alias("extension"), F.lit(d).alias("description"), F.lit(t).alias("mime"), F.lit(c).alias("category")) for i, (m, o, e, d, t, c) in enumerate(signatures)])
    best = F.array_max(F.filter(rows, lambda s: F.substring(data, s["offset"] * 2 + 1, s["n"]) == s["magic"]))
    return df.select(key, content, best.alias("s")).select(key, F.coalesce("s.extension", F.lit("bin")).alias("extension"), F.coalesce("s.mime", F.lit("application/octet-stream")).alias("mime"), F.coalesce("s.category", F.lit("unknown")).alias("category"), F.coalesce("s.description", F.lit("Unknown")).alias("description"), content)


def base64_images(df: DataFrame, key: str, text: str, least: int = 100) -> DataFrame:
    """(key, number, extension, content) of images that blocks of base64 of at least some characters hold, in order."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z0-9+/=\s]{%d,}" % least), F.lit(0))
    data = F.transform(blocks, lambda b: F.try_to_binary(F.regexp_replace(b, r"[\n\r ]", ""), F.lit("base64")))
    kinds = F.transform(data, lambda b: F.struct(F.when(F.startswith(F.hex(b), F.lit("FFD8FF")), "jpg").when(F.startswith(F.hex(b), F.lit("89504E470D0A1A0A")), "png").when(F.startswith(F.hex(b), F.lit("47494638")), "gif").alias("extension"), b.alias("content")))
    rows = df.select(key, F.posexplode(F.filter(kinds, lambda k: k["extension"].isNotNull())).alias("number", "x"))
    return rows.select(key, (F.col("number") + 1).alias("number"), "x.extension", "x.content")


def http_objects(packets: DataFrame, least: int = 1) -> DataFrame:
    """(frame_number, uri, code, content_type, disposition, content): bodies of HTTP answers, joined from the segments that
    follow an answer's first one on its side of the stream, with the address last asked for; equal contents once, the first."""
    from .protocols import end_of, streams

    rows = streams(packets).where(F.octet_length("payload") > 0).withColumn("side", end_of("src"))
    order = Window.partitionBy("stream").orderBy("frame_number")
    rows = rows.withColumn("asked", F.last("http_uri", ignorenulls=True).over(order))
    starts = F.col("http_response_code").isNotNull().cast("int")
    rows = rows.withColumn("n", F.sum(starts).over(Window.partitionBy("stream", "side").orderBy("frame_number"))).where("n > 0 and http_method is null")
    parts = F.array_sort(F.collect_list(F.struct("frame_number", F.hex("payload").alias("h"))))
    first = lambda c: F.min_by(c, "frame_number").alias(c)
    whole = F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), ""))
    g = rows.groupBy("stream", "side", "n").agg(whole.alias("raw"), F.min("frame_number").alias("frame_number"), first("asked"), first("http_response_code"))
    text = F.decode("raw", "ISO-8859-1")
    at = F.instr(text, "\r\n\r\n")
    head = F.substring(text, F.lit(1), at + 1)
    field = lambda n: F.lower(F.trim(F.regexp_extract(head, rf"(?i)\r\n{n}:([^\r\n]*)", 1)))
    size = F.coalesce(field("content-length").try_cast("int"), F.octet_length("raw"))
    g = g.where(at > 0).select("frame_number", F.col("asked").alias("uri"), F.col("http_response_code").alias("code"), field("content-type").alias("content_type"), field("content-disposition").alias("disposition"), F.substring("raw", at + 4, size).alias("content"))
    firsts = g.where(F.octet_length("content") >= least).withColumn("r", F.row_number().over(Window.partitionBy(F.md5("content")).orderBy("frame_number")))
    return firsts.where("r = 1").drop("r")
