"""Brand lookup and pruning of candidate pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Brands of televisions, in order of preference for the substring lookup.
BRANDS = (
    "acer", "admiral", "aiwa", "akai", "alba", "amstrad", "andrea smith electronics", "apex digital", "apple", "arcam", "arise india", "aga", "audiovox", "awa", "baird",
    "bang & olufsen", "beko", "benq", "binatone", "blaupunkt", "bpl", "brionvega", "bush", "canadian general electric", "changhong", "chimei", "compal electronics",
    "conar instruments", "continental edison", "cossor", "craig", "crosley", "curtis mathes", "daewoo", "dell", "delmonico", "dumont", "durabrand", "dynatron",
    "english electric", "ekco", "electrohome", "element electronics", "emerson", "emi", "farnsworth", "ferguson", "ferranti", "finlux", "fisher", "fujitsu", "funai",
    "geloso", "general electric", "goodmans", "google", "gradiente", "graetz", "grundig", "haier", "hallicrafters", "hannspree", "heath", "hinari", "hisense", "hitachi",
    "hoffman", "itel", "jensen", "jvc", "kenmore", "kent", "kloss", "kogan", "kolster-brandes", "konka", "lanix", "le.com", "lg", "loewe", "luxor", "magnavox", "marantz",
    "marconiphone", "matsui", "memorex", "micromax", "metz", "mitsubishi", "mivar", "motorola", "muntz", "murphy", "nec", "nokia", "nordmende", "onida", "orion",
    "packard bell", "panasonic", "pensonic", "philco", "philips", "pioneer", "planar", "polaroid", "proline", "proscan", "pye", "pyle", "quasar", "radioshack",
    "rauland-borg", "rca", "realistic", "rediffusion", "saba", "salora", "samsung", "sansui", "sanyo", "schneider", "seiki", "seleco", "setchell carlson", "sharp",
    "siemens", "skyworth", "sony", "soyo", "stromberg-carlson", "supersonic", "sylvania", "symphonic", "tandy", "tatung", "tcl", "teleavia", "telefunken", "teletronics",
    "thomson", "thorn", "toshiba", "tpv technology", "tp vision", "ultra", "united states television", "vestel", "videocon", "videoton", "vizio", "vu", "walton",
    "westinghouse", "white-westinghouse", "xiaomi", "zanussi", "zenith", "zonda",
)


def with_features(products: DataFrame, features: DataFrame) -> DataFrame:
    """products with own: their features (key, value), sorted; null without any."""
    own = features.groupBy("product_idx").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("own"))
    return products.join(own.hint("merge"), "product_idx", "left")


def text() -> Column:
    """The title and all values, of `with_features`."""
    values = F.array_join(F.transform("own", lambda x: x["value"]), " ")
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce(values, F.lit("")))


def product_text(products: DataFrame, features: DataFrame) -> DataFrame:
    """product_idx, text: the title and all values."""
    return with_features(products, features).select("product_idx", text().alias("text"))


def brand_substring(text: Column, lexicon: tuple[str, ...] = BRANDS) -> Column:
    """The first of the lexicon that the text contains; null without one."""
    return F.get(F.filter(F.array(*map(F.lit, lexicon)), lambda b: F.contains(text, b)), F.lit(0))


def brand_whole_word(text: Column, lexicon: tuple[str, ...] = BRANDS) -> Column:
    """The alphabetically first of the lexicon that is a whole word of the lower-cased text."""
    out = None
    lower = F.lower(text)
    for b in sorted(set(lexicon)):
        hit = lower.rlike(rf"\b{re.escape(b)}\b")
        out = F.when(hit, F.lit(b)) if out is None else out.when(hit, F.lit(b))
    return F.lit(None).cast("string") if out is None else out


def prune_same_shop(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs of products of different shops."""
    return _different(pairs, products.select("product_idx", F.col("shop").alias("x")), lambda a, b: a != b)


def prune_brand(pairs: DataFrame, branded: DataFrame) -> DataFrame:
    """Pairs but those whose brands are both known and different. branded: product_idx, brand."""
    return _different(pairs, branded.select("product_idx", F.col("brand").alias("x")), lambda a, b: a.isNull() | b.isNull() | (a == b))


def _different(pairs: DataFrame, known: DataFrame, keep) -> DataFrame:
    a, b = known.select(F.col("product_idx").alias("i"), F.col("x").alias("xi")), known.select(F.col("product_idx").alias("j"), F.col("x").alias("xj"))
    return pairs.join(a.hint("merge"), "i").join(b.hint("merge"), "j").where(keep(F.col("xi"), F.col("xj"))).select("i", "j")
