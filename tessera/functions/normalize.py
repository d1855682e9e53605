"""Names and addresses in canonical form, by built-in expressions that stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical legal forms by the terms that mean them, in normalised spelling.
LEGAL_FORMS = {
    "corporation": "corp", "corp": "corp", "c o r p": "corp",
    "incorporated": "inc", "inc": "inc", "i n c": "inc",
    "limited": "ltd", "ltd": "ltd", "l t d": "ltd",
    "private": "pvt", "pvt": "pvt", "p v t": "pvt",
    "limited liability company": "llc", "llc": "llc", "l l c": "llc",
    "societe anonyme": "sa", "s a": "sa", "sa": "sa",
    "s a r l": "sarl", "sarl": "sarl",
    "s a s": "sas", "sas": "sas",
    "s a s u": "sasu", "sasu": "sasu",
    "entreprise unipersonnelle a responsabilite limitee": "eurl", "e u r l": "eurl", "eurl": "eurl",
    "s c i": "sci", "sci": "sci",
    "s n c": "snc", "snc": "snc",
    "e i": "ei", "ei": "ei",
    "e i r l": "eirl", "eirl": "eirl",
    "gesellschaft mit beschrankter haftung": "gmbh", "g m b h": "gmbh", "gmbh": "gmbh",
}
# Street words and city names by their canonical form, and words that only place an address near another.
STREET_WORDS = {
    "street": "st", "st": "st", "road": "rd", "rd": "rd", "avenue": "av", "ave": "av", "av": "av",
    "boulevard": "bd", "blvd": "bd", "bd": "bd", "place": "pl", "pl": "pl", "chemin": "che", "che": "che",
    "residence": "res", "res": "res", "impasse": "imp", "imp": "imp", "rue": "rue", "strasse": "str",
}
CITY_NAMES = {"bombay": "mumbai", "bangalore": "bengaluru", "calcutta": "kolkata", "madras": "chennai", "pondicherry": "puducherry", "trivandrum": "thiruvananthapuram"}
NEARBY = ("near", "opposite", "opp", "beside", "behind", "next to", "in front of", "close to")
ACRONYM_SKIPS = ("and", "of", "the", "&", "de", "la", "et")

LEGAL_TERMS = "|".join(sorted(LEGAL_FORMS, key=lambda t: (-len(t), t)))
LEGAL_TAIL = rf"(?: (?:{'|'.join(sorted(set(LEGAL_FORMS.values()), key=lambda t: (-len(t), t)))}))+$"
WORD, NO_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]+"


def accents() -> tuple[str, str]:
    """Lower-case letters that decompose to a letter a-z with marks, and those letters."""
    pairs = []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        whole = unicodedata.normalize("NFKD", chr(code))
        if chr(code).islower() and len(whole) > 1 and "a" <= whole[0] <= "z" and all(map(unicodedata.combining, whole[1:])):
            pairs.append((chr(code), whole[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = accents()


def compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters of the basic plane that are another form (wide, raised, circled, ...) of one lower-case letter or digit, and
    those; and the Latin ligatures with their letters."""
    one, ligatures = [], []
    for code in [*range(0x00A0, 0xD800), *range(0xF900, 0xFFFE)]:
        c = chr(code)
        whole = unicodedata.normalize("NFKD", c)
        if whole != c and unicodedata.decomposition(c).startswith("<"):
            if len(whole) == 1 and whole.isalnum():
                one.append((c, whole.lower()))
            elif len(whole) > 1 and whole.isascii() and whole.isalpha() and unicodedata.category(c)[0] in "LN":
                ligatures.append((c, whole.lower()))
    return "".join(a for a, _ in one), "".join(b for _, b in one), ligatures


FORMS, FORM_OF, LIGATURES = compatible()


def literal_map(table: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(repr(x) for pair in table.items() for x in pair)})")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for a key, or the key itself."""
    return F.coalesce(F.element_at(literal_map(table), key), key)


def base_text(text: Column | str) -> Column:
    """Lower case without Latin accents; what isn't letter, number or underscore becomes one space. Null gives ''."""
    c = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    for a, b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("&", " and ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, ACCENTED + FORMS, PLAIN + FORM_OF)
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"(?<=[a-z])\p{M}+", "")
    return F.trim(F.regexp_replace(c, NO_WORD, " "))


def normalize_name(text: Column | str) -> Column:
    """Base text with legal terms in canonical form, found in one pass from the left, the longest first.

    A term ends with the space after it, so a term right behind another stays as it is.
    """
    marked = F.regexp_replace(F.concat(F.lit(" "), base_text(text), F.lit(" ")), rf"(?:^| )({LEGAL_TERMS})(?: |$)", " \u0001$1\u0001 ")
    parts = F.transform(F.split(marked, "\u0001"), lambda part, k: F.when(k % 2 == 1, lookup(LEGAL_FORMS, part)).otherwise(part))
    return F.trim(F.regexp_replace(F.array_join(parts, ""), " +", " "))


def core_name(name: Column | str) -> Column:
    """A normalised name without the legal forms at its end."""
    return F.trim(F.regexp_replace(F.col(name) if isinstance(name, str) else name, LEGAL_TAIL, ""))


def composite_text(name: Column | str, address: Column | str) -> Column:
    """Name and address in one line; null counts as ''."""
    return F.trim(F.concat_ws(" ", *[F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) for c in (name, address)]))


def normalize_address(text: Column | str) -> Column:
    return address_of_base(base_text(text))


def address_of_base(base: Column) -> Column:
    near = "|".join(t.replace(" ", " +") for t in NEARBY)
    bare = F.regexp_replace(base, rf"(?<!{WORD})(?:{near})(?!{WORD})", " ")
    words = F.filter(F.split(bare, " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(*[F.element_at(literal_map(t), w) for t in (CITY_NAMES, STREET_WORDS)], w)), " ")


def address_numbers(text: Column | str) -> Column:
    """Numbers, with a letter at most after them, that stand alone: array."""
    return F.regexp_extract_all(base_text(text), F.lit(rf"(?<!{WORD})\d+[A-Za-z]?(?!{WORD})"), F.lit(0))


def postal_code(text: Column | str) -> Column:
    """First run of five or six digits, or ''."""
    return F.regexp_extract(base_text(text), r"(?<!\d)\d{5,6}(?!\d)", 0)


def tokens(text: Column | str) -> Column:
    """Distinct words."""
    return F.array_distinct(F.filter(F.split(F.col(text) if isinstance(text, str) else text, " "), lambda w: w != ""))


def sorted_words(text: Column | str) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.col(text) if isinstance(text, str) else text, " "), lambda w: w != "")), " ")


def acronym(text: Column | str) -> Column:
    """Initials of the words that count, if there are two or more."""
    words = F.filter(F.split(F.col(text) if isinstance(text, str) else text, " "), lambda w: (w != "") & ~w.isin(*ACRONYM_SKIPS))
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).otherwise(F.lit(""))


def without_word(text: Column, word: Column) -> Column:
    """Removes a word wherever it stands alone."""
    kept = F.filter(F.split(text, " "), lambda w: (w != "") & (w != word))
    return F.array_join(kept, " ")


def address_components(text: Column | str) -> Column:
    """Struct of normalized, street_number, street, city and postal.

    The city is the last of the parts between , ; and |, where there are several, or the one before if it equals the street.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    normal = normalize_address(c)
    postal = postal_code(normal)
    number = F.coalesce(F.get(F.filter(address_numbers(c), lambda n: n != postal), F.lit(0)), F.lit(""))
    parts = F.filter(F.transform(F.split(c, r"[,;|]+"), normalize_address), lambda p: p != "")

    def bare(part: Column) -> Column:
        return without_word(without_word(part, number), postal)

    street = F.coalesce(bare(F.get(parts, F.lit(0))), F.lit(""))
    last = bare(F.element_at(parts, -1))
    city = F.when(F.size(parts) >= 2, F.when((last == street) & (F.size(parts) > 2), bare(F.try_element_at(parts, F.lit(-2)))).otherwise(last)).otherwise(F.lit(""))
    return F.struct(normal.alias("normalized"), number.alias("street_number"), street.alias("street"), city.alias("city"), postal.alias("postal"))


def with_components(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds what ``address_components`` gives as columns ``out`` + _normalized, _number, _street, _city, _postal, and the list _numbers.

    Each step is a column of its own: as one expression the optimizer would copy the text's normal form into every use.
    """
    c = lambda name: F.col(f"{out}_{name}")
    rows = rows.withColumns({f"{out}_text": F.coalesce(F.col(text), F.lit("")), f"{out}_base": base_text(text)})
    rows = rows.withColumns({f"{out}_normalized": address_of_base(c("base")), f"{out}_raw": F.split(c("text"), r"[,;|]+"), f"{out}_all": F.regexp_extract_all(c("base"), F.lit(rf"(?<!{WORD})\d+[A-Za-z]?(?!{WORD})"), F.lit(0))})
    parts = F.when(F.size(c("raw")) > 1, F.transform(c("raw"), normalize_address)).otherwise(F.array(c("normalized")))
    rows = rows.withColumns({f"{out}_parts": F.filter(parts, lambda p: p != ""), f"{out}_postal": F.regexp_extract(c("normalized"), r"(?<!\d)\d{5,6}(?!\d)", 0)})
    rows = rows.withColumns({f"{out}_number": F.coalesce(F.get(F.filter(c("all"), lambda n: n != c("postal")), F.lit(0)), F.lit(""))})
    rows = rows.withColumns({f"{out}_bare": F.transform(c("parts"), lambda p: F.array_join(F.filter(F.split(p, " "), lambda w: (w != "") & (w != c("number")) & (w != c("postal"))), " "))})
    street, last = F.coalesce(F.get(c("bare"), F.lit(0)), F.lit("")), F.element_at(c("bare"), -1)
    city = F.when(F.size(c("bare")) >= 2, F.when((last == street) & (F.size(c("bare")) > 2), F.try_element_at(c("bare"), F.lit(-2))).otherwise(last)).otherwise(F.lit(""))
    rows = rows.withColumns({f"{out}_street": street, f"{out}_city": city, f"{out}_numbers": c("all")})
    return rows.drop(*[f"{out}_{x}" for x in ("text", "base", "raw", "all", "parts", "bare")])


def entity_text(name: str, address: str, country: str) -> Column:
    """One line that describes an entity, for encoders; empty fields are left out."""
    labelled = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.concat(F.lit(f"{label}: "), F.trim(F.col(c)))) for label, c in (("business name", name), ("business address", address), ("country", country))]
    return F.concat_ws("; ", *labelled)


def preprocess(entities: DataFrame) -> DataFrame:
    """Adds the eight normalised columns to entity rows; null fields count as ''."""
    rows = with_components(entities, "business_address", "business_address")
    return (
        rows.withColumn("business_name_normalized", normalize_name("business_name"))
        .withColumn("business_name_core", core_name("business_name_normalized"))
        .withColumn("business_address_numbers", F.array_join("business_address_numbers", " "))
        .withColumnRenamed("business_address_number", "business_address_street_number")
        .select(
            *entities.columns, "business_name_normalized", "business_name_core", "business_address_normalized", "business_address_numbers",
            "business_address_street_number", "business_address_street", "business_address_city", "business_address_postal",
        )
    )


def derived(entities: DataFrame) -> DataFrame:
    """The linkage form of entity rows: entity_id, country, name, core, sorted_core, address, numbers, street_number,
    street, city, postal, split (0 to 4, stable by id). Rows without an id are left out."""
    known = entities.where(F.trim(F.coalesce("entity_id", F.lit(""))) != "")
    rows = known.select(
        F.trim("entity_id").alias("entity_id"),
        F.lower(F.trim(F.coalesce("country", F.lit("")))).alias("country"),
        normalize_name("business_name").alias("name"),
        "business_address",
        F.pmod(F.crc32(F.trim("entity_id")), F.lit(5)).cast("int").alias("split"),
    )
    rows = with_components(rows, "business_address", "a").withColumn("core", core_name("name"))
    numbers = F.regexp_extract_all("a_normalized", F.lit(rf"(?<!{WORD})\d+[A-Za-z]?(?!{WORD})"), F.lit(0))
    return rows.select(
        "entity_id", "country", "name", "core", sorted_words("core").alias("sorted_core"), F.col("a_normalized").alias("address"),
        F.array_join(numbers, " ").alias("numbers"), F.col("a_number").alias("street_number"), F.col("a_street").alias("street"), F.col("a_city").alias("city"), F.col("a_postal").alias("postal"), "split",
    )
