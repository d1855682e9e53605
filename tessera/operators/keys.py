"""Blocking keys: exact, token, phonetic and MinHash families with weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalize import acronym, tokens

TOKEN_DF_LIMIT = 5_000
KEY_LIMIT = 2_000  # rows a side may have of a key before it counts as hot

# The 32 affine permutations of MinHash over the prime below, in 16 bands of 2.
PRIME = 4294967291
FACTORS = [
    2746317214, 478163328, 107420370, 3184935164, 1181241944, 1051802513, 958682847, 599310826, 3163119786, 440213416, 2906402158,
    3181143732, 3831882065, 2342331445, 373399427, 2536146026, 1812140442, 136505588, 127978095, 402418011, 939042956, 999270937,
    2170484434, 2585650757, 113971124, 2410529191, 854001194, 3075280818, 2791232394, 3012167821, 2340505847, 1801823909,
]
SHIFTS = [
    946785248, 1929338154, 2530876844, 1194819984, 3476477323, 3733616459, 27911967, 3259052811, 3460967357, 685731524, 2998485882,
    1815115025, 1461364854, 1193448329, 667779376, 924765563, 4111198819, 3279182318, 1445662585, 438989805, 398340369, 1631775357,
    415393687, 1541804686, 3639960595, 1477278577, 2592983555, 1136108454, 3466589567, 186618211, 3134174160, 1973214822,
]
BANDS, BAND_ROWS = 16, 2

#: Families that count as evidence of a name, an address, a structural part, and an exact field.
NAME = ("full", "core", "sorted", "acronym", "prefix", "lsh")
ADDRESS = ("address", "full_composite", "addr_lsh")
STRUCTURAL = ("number", "token", "phonetic")
EXACT = ("full_composite", "full", "core", "sorted", "address")


def token_frequency(entities: DataFrame) -> DataFrame:
    """token, frequency: entities whose core has the token."""
    return entities.select(F.explode(tokens("core")).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))


def rare_tokens(entities: DataFrame, frequency: DataFrame, limit: int = TOKEN_DF_LIMIT) -> DataFrame:
    """entity_id, token: words of three letters or more that aren't common; ones that ``frequency`` lacks are rare.

    Common tokens are at most (all tokens of the source) / limit, so few that Spark broadcasts them where they fit.
    """
    words = entities.select("entity_id", F.explode(tokens("core")).alias("token")).where(F.length("token") >= 3)
    return words.join(frequency.where(F.col("frequency") > limit).select("token"), "token", "left_anti")


def grams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda k: F.substr(padded, k, F.lit(3))))


def minhash_bands(text: Column, bands: int = BANDS, rows: int = BAND_ROWS) -> Column:
    """Band keys, each of ``rows`` minima over affine permutations of the grams' CRC-32; none for fewer than three grams.
    There are 32 permutations for bands times rows.

    Products are taken modulo the prime in halves of 16 bits, since they pass 64 bits otherwise.
    """

    if bands * rows > len(FACTORS):
        raise ValueError(f"{bands} bands of {rows} rows need more than {len(FACTORS)} permutations")
    hashes = F.transform(grams(text), lambda g: F.crc32(g))
    least = [F.array_min(permuted(hashes, a, b)) for a, b in zip(FACTORS[: bands * rows], SHIFTS)]
    found = F.array(*[F.concat_ws(":", F.lit(k), *[m.cast("string") for m in least[k * rows : (k + 1) * rows]]) for k in range(bands)])
    return F.when(F.size(grams(text)) >= 3, found).otherwise(F.array().cast("array<string>"))


def permuted(hashes: Column, a: int, b: int) -> Column:
    return F.transform(hashes, lambda h: ((F.shiftright(h, 16) * F.lit(a).cast("long")) % PRIME * 65536 + h.bitwiseAND(65535) * F.lit(a).cast("long") + F.lit(b).cast("long")) % PRIME)


def phonetic(token: Column) -> Column:
    """Soundex of words that begin with a-z, '' otherwise."""
    return F.when(token.rlike("^[a-z]"), F.soundex(F.regexp_replace(token, "[^a-z]", ""))).otherwise(F.lit(""))


def key_rows(entities: DataFrame, rare: DataFrame | None = None, lsh: bool = True) -> DataFrame:
    """entity_id, family, key, weight: every blocking key of every entity, repeats included.

    ``rare`` (entity_id, token) adds token and phonetic keys. Entities are explored in one pass; token keys join nothing.
    """

    def key(family: str, value: Column, weight: float, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(family).alias("family"), value.alias("key"), F.lit(weight).alias("weight")))

    name, core, address = F.col("name"), F.col("core"), F.col("address")
    initials, prefix = acronym("core"), F.substring("core", 1, 5)
    single = F.array_compact(
        F.array(
            key("full", name, 15.0, name != ""),
            key("core", core, 12.0, core != ""),
            key("sorted", F.col("sorted_core"), 10.0, F.col("sorted_core") != ""),
            key("acronym", initials, 8.0, F.length(initials) >= 2),
            key("address", address, 7.0, address != ""),
            key("full_composite", F.concat_ws("|", name, address), 25.0, (name != "") & (address != "")),
            key("prefix", prefix, 2.0, F.length(prefix) == 5),
        )
    )
    numbers = F.transform(tokens("numbers"), lambda n: F.struct(F.lit("number").alias("family"), n.alias("key"), F.when(F.length(n) >= 5, 4.0).otherwise(0.5).alias("weight")))
    lists = [single, numbers]
    if lsh:
        for family, text, weight in (("lsh", core, 2.0), ("addr_lsh", address, 1.0)):
            lists.append(F.transform(minhash_bands(text), _banded(family, weight)))
    rows = entities.select("entity_id", F.explode(F.concat(*lists)).alias("k")).select("entity_id", "k.family", "k.key", "k.weight")
    if rare is not None:
        rows = rows.unionByName(rare.select("entity_id", F.lit("token").alias("family"), F.col("token").alias("key"), F.lit(6.0).alias("weight")))
        sounds = rare.select("entity_id", F.lit("phonetic").alias("family"), phonetic(F.col("token")).alias("key"), F.lit(2.5).alias("weight"))
        rows = rows.unionByName(sounds.where("key <> ''"))
    return rows


def _banded(family: str, weight: float):
    return lambda k: F.struct(F.lit(family).alias("family"), k.alias("key"), F.lit(weight).alias("weight"))
