"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules, train

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .credentials import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    from .credentials import oracle

    return oracle()


ORACLES["op2_secrets"] = _op2_sql()


@query
def op4_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


@query
def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


@query
def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import sampled_digest

    return sampled_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import find_licenses

    return find_licenses(table(spark, sf_dir, "documents"))


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
