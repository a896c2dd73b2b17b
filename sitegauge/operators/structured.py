"""Nodes and strings of JSON-LD blocks as tables, by walking VARIANT values level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.operators.page_checks import SCHEMA_REQUIRED
from sitegauge.sources.staging import staged

#: Levels of a block that are walked at most; JSON that nests deeper is no structured data.
MOST_LEVELS = 64
TYPE, PREFIX = "$['@type']", r"^.*schema\.org/"


@dataclass(frozen=True)
class Blocks:
    """``values``: every value of every block with its block, level and key. ``broken``: the blocks that are no JSON."""

    values: DataFrame
    broken: DataFrame


def walk(blocks: DataFrame, block: str, text: str) -> Blocks:
    """All values of the blocks: (block, level, key, value, kind), kind as Spark names it (OBJECT<..>, ARRAY<..>, STRING, ...).

    Blocks are parsed once, as VARIANT. Each level is exploded from the one above and written, until a level is empty, so that a level is
    a plain pass over the values above it and a large block spreads over tasks like any rows. VARIANT sorts the fields of an object: what depends on
    the order of keys in the text isn't to be had from this. A null text is no block.
    """
    spark = blocks.sparkSession
    parsed = staged(blocks.where(F.col(text).isNotNull()).select(F.col(block).alias("block"), F.try_parse_json(text).alias("value")))
    level = parsed.where("value is not null").select("block", F.lit(0).alias("level"), F.lit(None).cast("string").alias("key"), "value")
    out = level
    for depth in range(1, MOST_LEVELS):
        level = staged(spark.sql("SELECT t.block, {d} AS level, e.key, e.value FROM {t} t, LATERAL variant_explode(t.value) e", t=level, d=depth))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return Blocks(out.withColumn("kind", F.schema_of_variant("value")), parsed.where("value is null").select("block"))


def nodes(values: DataFrame) -> DataFrame:
    """(block, level, types, value) of the objects that have a type, at any depth; types without the vocabulary's address."""
    typed = values.where(F.startswith("kind", F.lit("OBJECT"))).withColumn("type", F.try_variant_get("value", TYPE, "variant")).where("type is not null and not is_variant_null(type)")
    one, several = F.try_variant_get("type", "$", "string"), F.try_variant_get("type", "$", "array<string>")
    bare = F.transform(F.coalesce(several, F.array(one)), lambda t: F.regexp_replace(t, PREFIX, ""))
    return typed.select("block", "level", bare.alias("types"), "value")


def strings(values: DataFrame) -> DataFrame:
    """(block, level, key, text) of the strings."""
    return values.where("kind = 'STRING'").select("block", "level", "key", F.variant_get("value", "$", "string").alias("text"))


def missing_fields(found: DataFrame, required: dict[str, tuple[str, ...]] = SCHEMA_REQUIRED) -> DataFrame:
    """(block, level, type, field) of the required fields that nodes lack, or have null or as an empty text.

    The fields of each type are a small fixed table, which every task gets; a node meets those of all its types.
    """
    rows = [(t, f) for t, fields in required.items() for f in fields]
    wanted = found.sparkSession.createDataFrame(rows, "type string, field string")
    own = found.select("block", "level", F.explode("types").alias("type"), F.variant_get("value", "$", "map<string,variant>").alias("fields"))
    met = own.join(F.broadcast(wanted), "type")  # a few dozen rows
    there = F.try_element_at("fields", F.col("field"))
    empty = there.isNull() | F.expr("is_variant_null(try_element_at(fields, field))") | F.coalesce(F.try_variant_get(there, "$", "string") == "", F.lit(False))
    return met.where(empty).select("block", "level", "type", "field")
