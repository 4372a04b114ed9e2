"""Quantities in common units, in SQL terms only: extract number and unit, normalise the unit by a join with the alias
table, fall back to the listing's text (and to a source's default, if given), apply factor and offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of units, in lower case; white space inside is one blank.
UNIT_ALIASES = {
    "USD": ["$", "us$", "usd", "us dollars", "us dollar", "u.s. dollars", "dollars", "dollar"],
    "EUR": ["€", "eur", "euro", "euros"],
    "GBP": ["£", "gbp", "pounds sterling", "pound sterling", "pounds"],
    "CAD": ["c$", "ca$", "cad", "canadian dollars", "canadian dollar"],
    "AUD": ["a$", "au$", "aud", "australian dollars", "australian dollar"],
    "CHF": ["chf", "swiss francs", "swiss franc", "sfr", "franken"],
    "BTC": ["₿", "btc", "bitcoin", "bitcoins"],
    "mBTC": ["mbtc", "milli-btc", "millibitcoin"],
    "sat": ["sat", "sats", "satoshi", "satoshis"],
    "XMR": ["xmr", "monero"],
    "cent": ["¢", "cent", "cents", "us cents", "us cent", "cents (us)"],
    "ng": ["ng", "nanogram", "nanograms", "nanogramm"],
    "ug": ["ug", "µg", "μg", "mcg", "mikrogramm", "microgram", "micrograms", "microgramme", "microgrammes", "microgramos", "мкг"],
    "mg": ["mg", "мг", "milligram", "milligrams", "milligramm", "milligramme", "miligramos"],
    "g": ["g", "gr", "gr.", "gram", "grams", "gramm", "gramme", "grammes", "gramos", "г"],
    "kg": ["kg", "kilogram", "kilograms", "кг"],
    "ml": ["ml", "мл", "cc", "millilitre", "millilitres", "milliliter", "milliliters"],
    "cl": ["cl", "centilitre", "centilitres", "centiliter", "centiliters"],
    "l": ["l", "л", "litre", "litres", "liter", "liters"],
    "fl_oz": ["fl oz", "fl. oz.", "fl. oz", "fl oz.", "fluid ounce", "fluid ounces"],
}
# Units that are known not to be convertible; an amount that has one lacks no unit.
FOREIGN_UNITS = ["iu", "i.u.", "ie", "ме", "%", "meq", "mmol"]
PRICE_UNITS = ["USD", "EUR", "GBP", "CAD", "AUD", "CHF", "BTC", "mBTC", "sat", "XMR", "cent"]
DOSE_UNITS = ["ng", "ug", "mg", "g", "kg", "ml", "cl", "l", "fl_oz"]

_NUMBER = r"\d{1,3}(?:[ \x{00A0}\x{202F}']\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*"


def _esc(s: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else r"\s*" if c == " " else c for c in s)


def _any(units: list[str], extra: list[str] = ()) -> str:
    """Alternation of all spellings, longest first, with a letter boundary after those that end in a letter."""
    names = sorted({a for u in units for a in UNIT_ALIASES[u]} | set(extra), key=lambda a: (-len(a), a))
    return "|".join(_esc(a) + (r"(?!\p{L})" if a[-1].isalpha() else "") for a in names)


def alias_table(spark) -> DataFrame:
    """(alias, unit), about 100 fixed rows."""
    return spark.createDataFrame([(a, u) for u, names in UNIT_ALIASES.items() for a in names], "alias string, unit string")


def spelling(raw: Column) -> Column:
    """The form in which a unit's spelling is looked up; null for ''."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(raw)), r"[\s\x{00A0}]+", " "), F.lit(""))


def decimal_number(text: Column) -> Column:
    """A written number as DECIMAL(20,8), null if it doesn't fit.

    With both signs the last is decimal. A single point is decimal. A single comma is a thousands sign only before exactly
    three digits and after one to three digits that aren't 0; several equal signs are thousands signs; blanks always are.
    """
    t = F.regexp_replace(text, r"[\s\x{00A0}\x{202F}']", "")
    plain = (
        F.when(t.rlike(r"^\d+(\.\d+)?$"), t)
        .when(t.rlike(r"^\d{1,3}(,\d{3})+\.\d+$"), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(t.rlike(r"^[1-9]\d{0,2}(,\d{3})+$"), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^\d+,\d+$"), F.replace(t, F.lit(","), F.lit(".")))
        .when(t.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), F.replace(t, F.lit("."), F.lit("")))
    )
    return plain.try_cast("decimal(20,8)")


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _blanks(c: Column) -> Column:
    """The text with no-break, thin and figure blanks as plain ones; null as ''."""
    return F.translate(F.coalesce(c, F.lit("")), "\u00a0\u202f\u2009\u2007", "    ")


def price_found(price: Column, text: Column) -> Column:
    """array<struct<number, alias>>: each amount of a price with its own unit, that of its range, or that of the text; null for none.

    In a range the unit may stand once. The text's unit is the currency named by a sentence on prices, else the first
    currency that the title or the description names or attaches to an amount.
    """
    unit = _any(PRICE_UNITS)
    amount = rf"(?iu)({unit})?\s*({_NUMBER})\s*({unit})?"
    found = F.transform(
        F.regexp_extract_all(_blanks(price), F.lit(amount), F.lit(0)),
        lambda m: F.struct(decimal_number(F.regexp_extract(m, amount, 2)).alias("number"), F.coalesce(spelling(F.regexp_extract(m, amount, 1)), spelling(F.regexp_extract(m, amount, 3))).alias("alias")),
    )
    said = rf"(?iu)(?:pric|quot|bill|amounts?|charg|preis|prix|precio|preço|цен)[^.\n]*?(?<![\p{{L}}])({unit})"
    named = rf"(?iu)(?<![\p{{L}}\p{{N}}])({unit})"
    # The texts are searched only if the whole field names no unit.
    other = F.coalesce(F.get(F.filter(found, lambda x: x["alias"].isNotNull()), F.lit(0))["alias"], spelling(_first(text, said, 1)), spelling(_first(text, named, 1)))
    return F.when(F.exists(found, lambda x: x["alias"].isNull()), F.transform(found, lambda x: F.struct(x["number"].alias("number"), F.coalesce(x["alias"], other).alias("alias")))).otherwise(found)


def dose_found(dosage: Column, text: Column) -> Column:
    """array<struct<number, alias>>: each amount of a dosage with its own unit, or that which the text gives for it; null for none.

    A bare number takes the unit that the title, else the description, attaches to an equal number, else the first mass
    unit stated there. Amounts in units that can't be converted lack no unit and give none.
    """
    unit = _any(DOSE_UNITS, FOREIGN_UNITS)
    amount = rf"(?iu)({_NUMBER})\s*({unit})?"
    found = F.transform(F.regexp_extract_all(_blanks(dosage), F.lit(amount), F.lit(0)), lambda m: F.struct(decimal_number(F.regexp_extract(m, amount, 1)).alias("number"), spelling(F.regexp_extract(m, amount, 2)).alias("alias")))
    mass = _any(["ng", "ug", "mg", "g", "kg"])
    stated = rf"(?iu)(?<![\p{{L}}\p{{N}}.,])({_NUMBER})\s*({mass})"
    pairs = F.transform(F.regexp_extract_all(text, F.lit(stated), F.lit(0)), lambda m: F.struct(decimal_number(F.regexp_extract(m, stated, 1)).alias("number"), spelling(F.regexp_extract(m, stated, 2)).alias("alias")))
    # The pairs are bound once, and only where an amount lacks its unit.
    bound = F.when(F.exists(found, lambda x: x["alias"].isNull()), F.array(pairs))
    told = lambda x: F.get(F.transform(bound, lambda t: F.coalesce(F.get(F.filter(t, lambda y: y["number"] == x["number"]), F.lit(0))["alias"], F.get(t, F.lit(0))["alias"])), F.lit(0))
    return F.when(bound.isNull(), found).otherwise(F.transform(found, lambda x: F.struct(x["number"].alias("number"), F.coalesce(x["alias"], told(x)).alias("alias"))))


def amounts(df: DataFrame) -> DataFrame:
    """(listing_id, kind, number, alias): the amounts of price and dosage (kind 'price' and 'dose') of each listing, in one pass."""
    text = _blanks(F.concat_ws(" \n ", "listing_title", "description"))
    kinds = [_of_kind(a, k) for k, a in (("price", price_found(F.col("price"), text)), ("dose", dose_found(F.col("dosage"), text)))]
    return df.select("listing_id", F.explode(F.concat(*[F.coalesce(k, F.array().cast(_AMOUNTS)) for k in kinds])).alias("_x")).select("listing_id", "_x.kind", "_x.number", "_x.alias")


_AMOUNTS = "array<struct<kind:string,number:decimal(20,8),alias:string>>"


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["number"].alias("number"), x["alias"].alias("alias"))).cast(_AMOUNTS)


def common_units(amounts: DataFrame, factors: DataFrame, ids: list[str], default: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
    """(ids, quantity, low_value, high_value): lowest and highest amount of each quantity, in common units, rounded half up.

    ``factors`` has unit, quantity, factor and, where scales don't start at zero, offset: value = number * factor + offset.
    Amounts whose unit is unknown, or not in ``factors``, give no row. ``default``, if given, holds ids and a unit spelling
    for a source that states none; ``also`` names columns in which an amount and its factor must agree. Both dimension tables are small and joined by whatever their size suggests to Catalyst.
    """
    spark = amounts.sparkSession
    if default is not None:
        amounts = amounts.join(default.withColumnRenamed("alias", "_default"), ids, "left").withColumn("alias", F.coalesce("alias", "_default"))
    offset = F.coalesce(F.col("offset"), F.lit(0)).cast("decimal(20,6)") if "offset" in factors.columns else F.lit(0).cast("decimal(20,6)")
    t = amounts.join(alias_table(spark), "alias").join(factors.select("unit", "quantity", *also, F.col("factor").cast("decimal(20,6)").alias("factor"), offset.alias("_offset")).distinct(), ["unit", *also])
    value = F.round(F.col("number") * F.col("factor") + F.col("_offset"), 0).try_cast("bigint")
    t = t.withColumn("_v", value).filter("_v is not null")
    return t.groupBy(*ids, "quantity").agg(F.min("_v").alias("low_value"), F.max("_v").alias("high_value"))


def listing_quantities(listings: DataFrame, factors: DataFrame) -> DataFrame:
    """Price, mass and volume of each listing in common units. Rows with equal listing_id are one listing; null fields state nothing."""
    priced = factors.withColumn("kind", F.when(F.col("quantity") == "price", "price").otherwise("dose"))
    return common_units(amounts(listings), priced, ["listing_id"], also=["kind"])
