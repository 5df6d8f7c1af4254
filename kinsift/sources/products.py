"""Product tables: from JSON files of grouped listings, and the offers derived from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "struct<title:string,shop:string,modelID:string,featuresMap:map<string,string>>"
PRODUCT_SCHEMA = "product_idx long, model_id string, shop string, title string, features map<string,string>"


def flatten_groups(groups: DataFrame, file_order: str | None = None) -> DataFrame:
    """Products of {group: [item, ...]} maps (column `groups`), numbered by group, then item.

    A table of one row per file needs an ordinal column file_order (without it there is one row). An item's number is its
    place in its file's map, flattened, plus the items of the files before: only counts of files meet in one task."""
    items = F.flatten(F.transform(F.map_entries("groups"), lambda g: F.transform(F.coalesce(g["value"], F.array()), lambda x: F.struct(g["key"].alias("group_key"), x.alias("item")))))
    own = groups.select(*([file_order] if file_order else []), items.alias("items"))
    if file_order:
        sizes = own.select(file_order, F.size("items").alias("n")).where("n > 0")
        before = sizes.select(F.col(file_order).alias("_f"), (F.sum("n").over(Window.orderBy(file_order)) - F.col("n")).alias("_before"))
        own = own.join(before, F.col(file_order).eqNullSafe(F.col("_f"))).select("items", "_before")
    else:
        own = own.withColumn("_before", F.lit(0))
    each = own.select("_before", F.posexplode("items").alias("pos", "x"))
    return each.select((F.col("_before") + F.col("pos")).cast("long").alias("product_idx"), "x.group_key", F.col("x.item.modelID").alias("model_id"), F.col("x.item.shop").alias("shop"), F.col("x.item.title").alias("title"), F.col("x.item.featuresMap").alias("features"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of one object from group to list of items; the schema is given, not inferred."""
    text = spark.read.text(path, wholetext=True)
    return flatten_groups(text.select(F.from_json("value", f"map<string,array<{ITEM}>>").alias("groups"))).select("product_idx", "model_id", "shop", "title", "features")


def _shop_title(shop: Column) -> Column:
    size, key, hz = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), (60 + 60 * (F.col("p_partkey") % 3)).cast("string")
    c = F.concat
    s = F.lit
    return (
        F.when(shop == 0, c("p_brand", s(" "), "p_name", s(" "), size, s('" '), "p_type", s(" P"), key, s("X")))
        .when(shop == 1, c("p_name", s(" "), size, s(" inch "), "p_type", s(" ("), "p_brand", s(") P"), key, s("X")))
        .when(shop == 2, c("p_brand", s(" "), size, s("-Inch "), "p_name", s(" - "), "p_type", s(" P"), key, s("-X")))
        .otherwise(c("p_type", s(" "), "p_name", s(" "), size, s(" inches/"), hz, s(" Hertz P"), key, s("X")))
    )


def offers(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    """Each part as listed by up to four shops, each with its spelling: offers of a part are true
    duplicates. below restricts to part keys under it.

    product_idx is 4 * part key + shop: unique and in order of both, without a global window."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", (F.col("l_suppkey") % 4).cast("int").alias("shop_no"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    if below is not None:
        lines, parts = lines.where(F.col("l_partkey") < below), parts.where(F.col("p_partkey") < below)
    listed = lines.distinct().join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    return listed.select(
        (F.col("p_partkey") * 4 + F.col("shop_no")).cast("long").alias("product_idx"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("model_id"), F.concat(F.lit("shop"), F.col("shop_no").cast("string")).alias("shop"),
        _shop_title(F.col("shop_no")).alias("title"), F.col("p_partkey").cast("long").alias("p_partkey"), "shop_no", "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"),
    )


def offer_features(offered: DataFrame) -> DataFrame:
    """product_idx, key_pos, key, value: one pass over the offers, an array exploded."""
    shop, size, hz = F.col("shop_no"), F.col("p_size").cast("string"), (60 + 60 * (F.col("p_partkey") % 3)).cast("string")

    def entry(pos: int, key: Column, value: Column, where: Column | None = None) -> Column:
        x = F.struct(F.lit(pos).alias("key_pos"), key.alias("key"), value.alias("value"))
        return x if where is None else F.when(where, x)

    entries = F.array(
        entry(0, F.lit("Brand"), F.col("p_brand")),
        entry(1, F.when(shop == 1, "Screen Size Class").otherwise("Screen Size"), F.concat(size, F.when(shop == 2, '"').otherwise(" inches"))),
        entry(2, F.when(shop == 3, "Refresh Rate:").otherwise("Refresh Rate"), F.concat(hz, F.when(shop == 0, "Hz").otherwise(" hertz"))),
        entry(3, F.lit("Type"), F.col("p_type"), shop != 3),
        entry(4, F.lit("Estimated Operation Cost"), F.concat(F.lit("USD "), (F.col("p_partkey") % 17).cast("string"), F.lit(".5")), (shop == 0) & (F.col("p_partkey") % 5 == 0)),
    )
    return offered.select("product_idx", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("product_idx", "e.*")


def products(offered: DataFrame) -> DataFrame:
    """The product table with its feature map."""
    maps = offer_features(offered).groupBy("product_idx").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("key_pos", "key", "value"))), lambda e: F.struct(e["key"], e["value"]))).alias("features"))
    return offered.join(maps, "product_idx", "left").select("product_idx", "model_id", "shop", "title", "features")


def feature_rows(products: DataFrame) -> DataFrame:
    """The long form of the feature maps: product_idx, key, value."""
    return products.select("product_idx", F.explode("features").alias("key", "value"))
