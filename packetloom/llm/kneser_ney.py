"""Quality classifier (op 10): perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are words (runs of letters, digits and non-ASCII characters as they stand, other characters one by one)
and the text's edge, its order is 3; words are hashed to 40 bits, n-grams to 48. There are two models, each of half of the
trusted documents, dealt by a hash of the id, and each scores the other half of all documents: none is scored by a model that
counted it. Documents are dealt by a hash of their id into blocks of about `block_bytes`, compressed, together with the
labels, so that a block knows its trusted documents. Counts of trusted n-grams meet by context, each order in a table packed
by hash range; continuation counts, context totals and discounts of all orders are made there. A block asks for the n-grams it
holds, packed by hash range too, gets back what the models know of them and scores its documents. So what is gathered grows
with the input, by block and range, and nothing is broadcast or collected but the counts of counts. A language's threshold is
a quantile of its trusted documents' perplexities, times a margin that spares unseen clean texts.

perplexities() is the same over 63 classes of bytes at order 4, by one model, in a fixed table; no query uses it.

Nulls: a null or empty text has a null perplexity and is not kept; a null language is one of its own; labels with a null
id are left out; rows with a null id are dealt by a hash of their text. Languages without trusted documents use the
quantile of all trusted ones; without any, all texts are kept. Without trusted documents on the other half each symbol has
probability 1. Repeated rows are scored one by one. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import arrow_schema, discard, materialize, partitions_for, text_map
from .suffixes import packed, unpacked

ORDER, BITS = 4, 6


def symbols() -> np.ndarray:
    """Each byte's symbol, 1 to 63; 0 is the edge of a text."""
    out = np.full(256, 38, np.uint8)
    out[0x61:0x7B] = np.arange(1, 27)
    out[0x30:0x3A] = 27
    for n, group in enumerate([b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"\"'", b"-", b":;", b"()[]{}", b"#*$%&|<>"]):
        out[list(group)] = 28 + n
    out[0x41:0x5B] = 39
    out[0x80:0xC0] = 40 + (np.arange(64) & 15)
    out[0xC0:] = 56 + (np.arange(64) & 7)
    return out


SYMBOL = symbols()


def codes(x: np.ndarray) -> np.ndarray:
    """The ORDER-gram ending at each symbol of a text and at its end, edges before its start."""
    y = np.concatenate([np.zeros(ORDER - 1, np.uint32), x.astype(np.uint32), np.zeros(1, np.uint32)])
    n = len(x) + 1
    out = y[:n].copy()
    for k in range(1, ORDER):
        out = out << np.uint32(BITS) | y[k : k + n]
    return out


def blocks(docs: DataFrame, labels: DataFrame, count: int, symbols_of=lambda t: SYMBOL[K.raw(t)].tobytes()) -> DataFrame:
    """(block, doc_id, lang, kind, body): compressed symbols of documents (kind 1) after the labels that trust them (0)."""

    def run(texts):
        import zstandard

        z = zstandard.ZstdCompressor(level=5)
        return [[z.compress(symbols_of(t)) for t in texts]]

    block = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("body"))), F.lit(count)).cast("int")
    body = text_map(docs, run, [("body", "binary")], ["doc_id", "lang"]).select(block.alias("block"), "doc_id", "lang", F.lit(1).alias("kind"), "body")
    trust = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long")).distinct()
    trust = trust.withColumn("body", F.lit(None).cast("binary")).select(block.alias("block"), "doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0).alias("kind"), "body")
    return trust.unionByName(body).repartition(count, "block").sortWithinPartitions("block", "doc_id", "kind")


def read_block(rows):
    """(doc_id, lang, trusted, symbols) of a block's rows, given as lists of doc_id, lang, kind and body."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    sure = None
    for d, lang, kind, body in zip(*rows, strict=True):
        if kind == 0:
            sure = d
        else:
            yield d, lang, d is not None and d == sure, np.frombuffer(z.decompress(body), np.uint8)


def counted(dealt: DataFrame) -> DataFrame:
    """(block, code, n): a block's distinct n-grams, with their counts in its trusted documents."""
    ddl = "block int, code int, n long"
    schema = arrow_schema(ddl)

    def emit(block, all_, trusted):
        import pyarrow as pa

        seen = np.flatnonzero(all_)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), block, np.int32)), pa.array(seen.astype(np.int32)), pa.array(trusted[seen].astype(np.int64))], schema=schema)

    def run(batches):
        size = 1 << BITS * ORDER
        held, all_, trusted, sure = None, None, None, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for i, block in enumerate(cols[0]):
                if block != held:
                    if held is not None and all_.any():
                        yield emit(held, all_, trusted)
                    held, all_, trusted, sure = block, np.zeros(size, bool), np.zeros(size, np.uint32), None
                if cols[3][i] == 0:
                    sure = cols[1][i]
                    continue
                c = codes(next(read_block([[x[i]] for x in cols[1:]]))[3])
                all_[c] = True
                if cols[1][i] is not None and cols[1][i] == sure:
                    u, n = np.unique(c, return_counts=True)
                    trusted[u] += n.astype(np.uint32)
        if held is not None and all_.any():
            yield emit(held, all_, trusted)

    return dealt.mapInArrow(run, ddl)


def discount(counts: DataFrame):
    """Modified Kneser-Ney's discounts of counts 1, 2 and 3 or more, one row; counts of counts of 0 are taken as 1."""
    c = counts.agg(*[F.greatest(F.lit(1), F.count_if(F.col("n") == k)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = [F.least(F.lit(float(k)), F.greatest(F.lit(0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))) for k in (1, 2, 3)]
    return c.select(*[x.alias(f"d{k}") for k, x in enumerate(cut, 1)])


def probabilities(asked: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(code, p) of distinct n-grams of this order. counts: (code, n), true counts at the top and continuation counts,
    the number of distinct symbols before, below."""
    if order == 0:
        return asked.select("code", F.lit(1.0 / (1 << BITS)).alias("p"))
    cut = discount(counts).first()
    d = F.when(F.col("n") == 1, cut["d1"]).when(F.col("n") == 2, cut["d2"]).otherwise(cut["d3"])
    contexts = counts.groupBy(F.shiftright("code", BITS).alias("context")).agg(F.sum("n").alias("total"), F.sum(d).alias("left"))
    lower_mask = (1 << BITS * (order - 1)) - 1
    suffix = F.col("code").bitwiseAND(F.lit(lower_mask))
    lower_counts = counts.groupBy(suffix.alias("code")).agg(F.count("*").alias("n"))
    lower = probabilities(asked.select(suffix.alias("code")).distinct(), lower_counts, order - 1).select(F.col("code").alias("suffix"), F.col("p").alias("lower"))
    q = asked.join(counts, "code", "left").withColumn("context", F.shiftright("code", BITS)).withColumn("suffix", suffix)
    q = q.join(contexts, "context", "left").join(lower, "suffix")
    own = F.coalesce(F.greatest(F.lit(0.0), F.col("n") - d), F.lit(0.0))
    return q.select("code", F.when(F.col("total").isNull(), F.col("lower")).otherwise((own + F.col("left") * F.col("lower")) / F.col("total")).alias("p"))


def scored(dealt: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, n, perplexity) of every document, block by block."""
    ddl = "doc_id long, lang string, trusted boolean, n long, perplexity double"
    schema = arrow_schema(ddl)

    def run(key, left, right):
        import pyarrow as pa

        table = np.zeros(1 << BITS * ORDER, np.float32)
        table[right.column("code").to_numpy()] = right.column("logp").to_numpy()
        order = sorted(range(left.num_rows), key=lambda i, d=left.column("doc_id").to_pylist(), k=left.column("kind").to_pylist(): (d[i] is not None, d[i] or 0, k[i]))
        rows = left.take(pa.array(order, pa.int64()))
        out = []
        for d, lang, sure, x in read_block([rows.column(c).to_pylist() for c in ("doc_id", "lang", "kind", "body")]):
            out.append((d, lang, sure, len(x), float(np.exp(-table[codes(x)].mean(dtype=np.float64))) if len(x) else None))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ddl)


def perplexities(docs: DataFrame, labels: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    count = partitions_for(docs, F.octet_length(F.coalesce("text", F.lit(""))), block_bytes)
    dealt = blocks(docs, labels, count)
    grams = materialize(counted(dealt), "grams")
    counts = grams.groupBy("code").agg(F.sum("n").alias("n")).where("n > 0")
    p = probabilities(grams.select("code").distinct(), counts, ORDER)
    return scored(dealt, grams.select("block", "code").join(p, "code").select("block", "code", F.log("p").cast("float").alias("logp")))


#: Classes of bytes: 0 white space, 1 in words, 2 words of their own.
CLASS = np.where(K.SPACE, 0, np.where(K.ALNUM[K.LOWER], 1, 2)).astype(np.uint8)
#: Words' order, the bit of a word that tells its model, and the columns of a blob of counts of each order, of asked and of known n-grams.
WORDS, MODEL = 3, np.uint64(1 << 40)
COUNTS, KEYS, KNOWN = {k: "<u8 " * k + "<u4" for k in (1, 2, 3)}, "<u8", "<u8 <f4 <f4"


def words(t, model: int) -> np.ndarray:
    """A text's words between edges: two before and one after it."""
    b, edge = K.raw(t), MODEL * np.uint64(model)
    c = CLASS[b]
    cut = np.flatnonzero((c[1:] != c[:-1]) | (c[1:] == 2)) + 1
    starts, ends = np.concatenate([np.zeros(min(1, len(b)), np.int64), cut]), np.concatenate([cut, [len(b)] * min(1, len(b))]).astype(np.int64)
    keep = c[starts] != 0
    h = K.span_hash(K.prefix_hash(b), starts[keep], ends[keep]) >> np.uint64(24)
    return np.concatenate([[edge] * (WORDS - 1), h | edge, [edge]]).astype(np.uint64)


def gram_key(cols: list[np.ndarray]) -> np.ndarray:
    """A 48-bit hash of n-grams given by their words' columns."""
    out = K.mix(cols[0])
    for c in cols[1:]:
        out = K.mix(out * np.uint64(0x9FB21C651E98DF25) + c)
    return out >> np.uint64(16)


def context_key(cols: list[np.ndarray]) -> np.ndarray:
    """That of n-grams' contexts; single words have their model as context."""
    return gram_key(cols[:-1]) if len(cols) > 1 else cols[-1] >> np.uint64(40)


def range_at(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def spread(key: np.ndarray, cols: list[np.ndarray], kinds: str, parts: int) -> tuple[list, list]:
    """(part, blob) of rows by the range of their key."""
    order = np.argsort(key)
    return packed(range_at(key[order], parts), [c[order] for c in cols], kinds)


def summed(cols: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams, by context and key, with the sums of n."""
    key = gram_key(cols)
    order = np.lexsort((key, context_key(cols)))
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return [c[order][first] for c in cols], np.add.reduceat(n[order].astype(np.int64), first) if len(key) else n


def fold(doc_id) -> int:
    """The model that scores a document; the other one counts it, if it is trusted."""
    return 0 if doc_id is None else int(K.mix(np.array([doc_id], np.int64).view(np.uint64))[0] & np.uint64(1))


ROWS = "kind int, part int, block int, blob binary"


def batch_of(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "part", "block", "blob"])


def grams(dealt: DataFrame, parts: int) -> DataFrame:
    """ROWS of each block: the counts of its trusted trigrams by the range of their context (kind 0), and the distinct n-grams of
    order `kind` that it asks for, by their own."""

    def run(batches):
        held, texts, sure = None, [], None

        def emit():
            asks, counts = [], []
            for d, trusted, t in texts:
                y = words(t, fold(d))
                asks.append(y)
                if trusted:
                    y = y ^ MODEL
                    counts.append([y[k : len(y) - WORDS + 1 + k] for k in range(WORDS)])
            out = []
            for k in range(1, WORDS + 1):
                from_ = max(0, WORDS - 1 - k)  # contexts are asked for too
                key = np.unique(np.concatenate([gram_key([y[from_ + i : len(y) - k + 1 + i] for i in range(k)]) for y in asks]))
                part, step = range_at(key, parts), np.diff(key, prepend=np.uint64(0))
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                step[first] = key[first]
                out += [(k, a, held, b) for a, b in zip(*packed(part, [step], KEYS), strict=True)]
            if counts:
                cols = [np.concatenate(x) for x in zip(*counts, strict=True)]
                cols, n = summed(cols, np.ones(len(cols[0]), np.int64))
                out += [(0, a, held, b) for a, b in zip(*spread(context_key(cols), [*cols, n], COUNTS[WORDS], parts), strict=True)]
            return batch_of(out)

        for batch in batches:
            for block, d, _, kind, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if block != held:
                    if texts:
                        yield emit()
                    held, texts, sure = block, [], None
                if kind == 0:
                    sure = d
                else:
                    t = next(read_block([[d], [None], [1], [body]]))[3]
                    if len(t):
                        texts.append((d, d is not None and d == sure, t))
        if texts:
            yield emit()

    return dealt.mapInArrow(run, ROWS)


def by_range(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "block")


def parts_of(batches):
    """Lists of (kind, block, blob) of one part."""
    held, rows = None, []
    for batch in batches:
        for kind, part, block, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != held and rows:
                yield held, rows
                rows = []
            held = part
            rows.append((kind, block, blob))
    if rows:
        yield held, rows


def merged(rows: list, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    *cols, n = (np.concatenate(x) for x in zip(*(unpacked(b, COUNTS[order]) for _, _, b in rows), strict=True))
    return summed(cols, n)


def lowered(counts: DataFrame, order: int, parts: int) -> DataFrame:
    """ROWS of the continuation counts of the order below (kind 0), and of each range's counts of counts (kind 1)."""

    def run(batches):
        for part, rows in parts_of(batches):
            cols, n = merged(rows, order)
            out = []
            for model in (0, 1):
                own = n[cols[-1] >> np.uint64(40) == model]
                out.append((1, part, model, np.array([*((own == k).sum() for k in (1, 2, 3, 4)), own.sum(), len(own)], "<i8").tobytes()))
            if order > 1:
                low, m = summed(cols[1:], np.ones(len(n), np.int64))
                key = context_key(low) if order > 2 else gram_key(low)
                out += [(0, a, -1, b) for a, b in zip(*spread(key, [*low, m], COUNTS[order - 1], parts), strict=True)]
            yield batch_of(out)

    return by_range(counts, parts).mapInArrow(run, ROWS)


def discounts(found: DataFrame) -> list[dict]:
    """Of each model: the discounts of counts 1, 2 and 3 or more, the sum of counts, the number of n-grams and what is cut off in all."""
    out = []
    for model in (0, 1):
        rows = [np.frombuffer(r["blob"], "<i8") for r in found.where(f"kind = 1 and block = {model}").select("blob").toLocalIterator()]
        *n, total, seen = (int(x) for x in sum(rows, np.zeros(6, np.int64)))
        c = [max(1, x) for x in n]
        y = c[0] / (c[0] + 2 * c[1])
        d = [min(float(k), max(0.05, k - (k + 1) * y * c[k] / c[k - 1])) for k in (1, 2, 3)]
        out.append({"d": d, "total": total, "seen": seen, "left": d[0] * n[0] + d[1] * n[1] + d[2] * (seen - n[0] - n[1])})
    return out


def known(counts: DataFrame, order: int, told: list[dict], parts: int) -> DataFrame:
    """ROWS of what an order's counts say, by the key's range: kind -2, of an n-gram its own share; kind -1, of a context the weight of
    the order below. Parts of orders follow each other."""

    def run(batches):
        for _, rows in parts_of(batches):
            cols, n = merged(rows, order)
            d = np.array([x["d"] for x in told])[(cols[-1] >> np.uint64(40)).astype(int), np.minimum(n, 3) - 1]
            if order == 1:
                total, out = np.array([x["total"] for x in told], float)[(cols[-1] >> np.uint64(40)).astype(int)], []
            else:
                context = context_key(cols)
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                sums, left = np.add.reduceat(n, first), np.add.reduceat(d, first)
                total = np.repeat(sums, np.diff(np.append(first, len(n))))
                a, b = spread(context[first], [context[first], left / sums], "<u8 <f4", parts)
                out = [(-1, (order - 2) * parts + x, -1, y) for x, y in zip(a, b, strict=True)]
            key = gram_key(cols)
            a, b = spread(key, [key, np.maximum(0, n - d) / total], "<u8 <f4", parts)
            yield batch_of(out + [(-2, (order - 1) * parts + x, -1, y) for x, y in zip(a, b, strict=True)])

    return by_range(counts, parts).mapInArrow(run, ROWS)


def told(asked: DataFrame, tables: DataFrame, parts: int) -> DataFrame:
    """ROWS of answers, kind the order: of the n-grams asked for and known, the key, their own share and their weight as contexts."""

    def run(batches):
        for part, rows in parts_of(batches):
            table = {-2: (np.empty(0, np.uint64), np.empty(0, np.float32)), -1: (np.empty(0, np.uint64), np.empty(0, np.float32))}
            for kind in table:
                own = [unpacked(b, "<u8 <f4") for k, _, b in rows if k == kind]
                if own:
                    key, x = (np.concatenate(c) for c in zip(*own, strict=True))
                    order = np.argsort(key)
                    table[kind] = key[order], x[order]
            for kind, block, blob in rows:
                if kind > 0:
                    key, hit, cols = np.cumsum(unpacked(blob, KEYS)[0], dtype=np.uint64), False, []
                    for of, none in ((-2, 0.0), (-1, 1.0)):
                        held, x = table[of]
                        at = np.searchsorted(held, key)
                        met = np.flatnonzero(at < len(held))
                        met = met[held[at[met]] == key[met]]
                        col = np.full(len(key), none, np.float32)
                        col[met] = x[at[met]]
                        seen = np.zeros(len(key), bool)
                        seen[met] = True
                        hit = hit | seen
                        cols.append(col)
                    if hit.any():
                        yield batch_of([(kind, part, block, packed(np.zeros(int(hit.sum()), np.int64), [key[hit], *(c[hit] for c in cols)], KNOWN)[1][0])])

    rows = asked.where("kind > 0").withColumn("part", F.col("part") + (F.col("kind") - 1) * parts)
    return rows.union(tables).repartition(parts, "part").sortWithinPartitions("part", "kind", "block").mapInArrow(run, ROWS)


def word_scores(dealt: DataFrame, answers: DataFrame, unigrams: list[dict]) -> DataFrame:
    """(doc_id, lang, trusted, n, perplexity) of every document, block by block."""
    ddl = "doc_id long, lang string, trusted boolean, n long, perplexity double"
    schema = arrow_schema(ddl)

    def run(key, left, right):
        import pyarrow as pa

        tables = {}
        for k in range(1, WORDS + 1):
            own = [unpacked(b, KNOWN) for kind, b in zip(right.column("kind").to_pylist(), right.column("blob").to_pylist(), strict=True) if kind == k]
            keys, share, weight = (np.concatenate(c) for c in zip(*own, strict=True)) if own else (np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.float32))
            order = np.argsort(keys)
            tables[k] = keys[order], np.append(share[order], 0).astype(float), np.append(weight[order], 1).astype(float)

        def look(cols):
            keys, share, weight = tables[len(cols)]
            k = gram_key(cols)
            at = np.searchsorted(keys, k)
            at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == k[at < len(keys)], at[at < len(keys)], len(keys))
            return share[at], weight[at]

        order = sorted(range(left.num_rows), key=lambda i, d=left.column("doc_id").to_pylist(), k=left.column("kind").to_pylist(): (d[i] is not None, d[i] or 0, k[i]))
        rows = left.take(pa.array(order, pa.int64()))
        out = []
        for d, lang, sure, t in read_block([rows.column(c).to_pylist() for c in ("doc_id", "lang", "kind", "body")]):
            perplexity = None
            if len(t):
                one = unigrams[fold(d)]
                y = words(t, fold(d))
                a, b, c = (y[k : len(y) - WORDS + 1 + k] for k in range(WORDS))
                p = look([c])[0] + (one["left"] / one["total"] if one["total"] else 1.0) / (one["seen"] + 1)
                p = look([b, c])[0] + look([b])[1] * p
                p = look([a, b, c])[0] + look([a, b])[1] * p
                perplexity = float(np.exp(-np.log(p).mean()))
            out.append((d, lang, sure, len(t), perplexity))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ddl)


def word_perplexities(docs: DataFrame, labels: DataFrame, block_bytes: int = 8 << 20, temp: list[str] | None = None) -> DataFrame:
    """(doc_id, lang, trusted, n, perplexity) of every row: n bytes, and the perplexity a word. temp gets tables to discard() when
    the result has been written."""
    temp = [] if temp is None else temp
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    count = partitions_for(docs, F.octet_length(F.coalesce("text", F.lit(""))), block_bytes, 1)
    dealt = blocks(docs, labels, count, bytes)
    asked = materialize(grams(dealt, count), "grams", temp)
    counts, levels, marks = asked.where("kind = 0"), {}, {}
    for k in range(WORDS, 0, -1):
        low = materialize(lowered(counts, k, count), "counts", temp)
        marks[k], levels[k], counts = discounts(low), counts, low.where("kind = 0")
    tables = [known(levels[k], k, marks[k], count) for k in levels]
    answers = materialize(told(asked, tables[0].union(tables[1]).union(tables[2]), count), "answers", temp)
    return word_scores(dealt, answers.select("block", "kind", "blob"), marks[1])


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.5) -> DataFrame:
    """Per row of docs: doc_id, lang, n_bytes, perplexity, threshold (margin times its language's quantile) and kept."""
    temp: list[str] = []
    rows = materialize(word_perplexities(docs, labels, temp=temp), "perplexity")
    discard(docs.sparkSession, temp)
    sure = rows.where("trusted and perplexity is not null")
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    language = F.coalesce("lang", F.lit(""))
    by_lang = materialize(sure.groupBy(language.alias("l")).agg(limit.alias("own")), "limits")
    any_ = sure.agg(limit.alias("any")).first()["any"]
    few = by_lang.count() <= 10_000  # languages are few; a table with more is joined by shuffles, which Spark splits
    joined = rows.join(F.broadcast(by_lang) if few else by_lang, language == F.col("l"), "left")
    threshold = margin * F.coalesce("own", F.lit(any_).cast("double"), F.lit(float("inf")))
    return joined.select("doc_id", "lang", F.col("n").alias("n_bytes"), "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
