"""Personal data by patterns, and by contexts that known finds teach; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, spread

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, with possessive repeats and a test of what stands before where these change no match: a long run
#: of digits or letters then costs one pass and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What any match holds; a text without it is not searched.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What may be an identifier: words around an @ or a spelt-out one, long words of letters and digits, groups between colons, and
#: runs of words of digits and their punctuation. What stands beside a word is no part of it unless it is a letter or digit.
CANDIDATE = (
    r"(?<![\p{L}\p{N}])(?=\S)(?:"  # nothing starts within a word
    r"(?=[^\x20\x09-\x0D@\[({]*+[@\[({])(?<![^\x20\x09-\x0D\"'<>(\[{])[^\x20\x09-\x0D@\"'<>(){}\[\]]++(?:@|\[at\]|\(at\)|\{at\})[^\x20\x09-\x0D@\"'<>(){}\[\]]+"
    r"|(?=[A-Za-z_+/=-]*+[0-9])(?<![_+/=-])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{12,}+(?![\p{L}\p{N}])"
    r"|(?=[0-9A-Fa-f]{0,4}+:)(?<!:)[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![\p{L}\p{N}:])"
    r"|(?<![@_.+-])[(]?[0-9][0-9()./-]*+(?![\p{L}\p{N}@_])(?:\x20[(]?[0-9][0-9()./-]*+(?![\p{L}\p{N}@_]))*+)"
)
SECRET = len(KINDS)  # a kind without base matches: its seeds are long words that look random
#: Forms that an identifier of a kind may have where its context says what it is.
LOOSE = {
    "email": r"^[^@\x20]+(?:@|[\[({]at[\])}])[^@\x20]+$",
    "ip": r"^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$",
    "card": r"^(?=(?:[^0-9]*[0-9]){12,19}[^0-9]*$)[0-9][0-9\x20.-]*$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[(]?[0-9][0-9()\x20./-]*$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{12,}$",
}
SECRET_SEED = r"^(?:(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/=-]{20,})$"
MOST_WORDS = 19  # of digits that make an identifier: no form has more digits
EDGES = "\"'`,;:!?()[]{}<>."
SPACE = r"\x20\x09-\x0D"
STRETCH = 256  # code points
NEAR = 64  # code points beside a find that usually hold its neighbouring words; where they don't, the whole text between is read
LEAST_CONFIDENCE, LEAST_SEEDS, ROUNDS = 0.9, 3, 3
DOUBT = 0.25  # contrary instances that any pattern is taken to have: LEAST_SEEDS reach LEAST_CONFIDENCE, fewer don't


def searched(text: Column, pattern: str, needs: str | None = None) -> tuple[Column, Column]:
    """Matches, and the texts between them: one more than matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if needs:
        has = F.contains(text, F.lit(needs))
        hits, gaps = F.when(has, hits).otherwise(F.array().cast("array<string>")), F.when(has, gaps).otherwise(F.array(F.lit("")))
    return hits, gaps


def beside(gaps: Column) -> Column:
    """For each text between finds the words at its ends, without quotes and brackets: l1 the last, l2 the last two, r1 the first."""
    left, right = " \t\n\x0b\x0c\r\"'([{<", " \t\n\x0b\x0c\r\"')]}>"
    last_two, last, first = rf"(?<![^{SPACE}])[^{SPACE}]++[{SPACE}]++[^{SPACE}]++\z", rf"(?<![^{SPACE}])[^{SPACE}]++\z", rf"^[^{SPACE}]++"

    def ends(g: Column) -> Column:
        before, after = F.rtrim(F.right(g, F.lit(NEAR)), F.lit(left)), F.ltrim(F.left(g, F.lit(NEAR)), F.lit(right))
        short = F.length(g) <= NEAR
        two, one = F.regexp_extract(before, last_two, 0), F.regexp_extract(after, first, 0)
        before = F.when(short | (F.length(two) > 0) & (F.length(two) < F.length(before)), before).otherwise(F.rtrim(g, F.lit(left)))
        r1 = F.when(short | (F.length(one) > 0) & (F.length(one) < F.length(after)), one).otherwise(F.regexp_extract(F.ltrim(g, F.lit(right)), first, 0))
        return F.struct(F.lower(F.regexp_extract(before, last, 0)).alias("l1"), F.lower(F.regexp_extract(before, last_two, 0)).alias("l2"), F.lower(F.rtrim(r1, F.lit(EDGES))).alias("r1"))

    return F.transform(gaps, ends)


def pieces_of(hits: Column, gaps: Column) -> Column:
    """Matches as array of (g, h, v, l1, l2, r1): code points of the text before and of the match, the match, the words beside."""
    near = beside(gaps)
    parts = F.zip_with(
        F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), h.alias("v"))),
        F.zip_with(F.slice(near, 1, F.size(hits)), F.slice(near, 2, F.size(hits)), lambda a, b: F.struct(a["l1"].alias("l1"), a["l2"].alias("l2"), b["r1"].alias("r1"))),
        lambda w, c: F.struct(w["g"].alias("g"), w["h"].alias("h"), w["v"].alias("v"), c["l1"].alias("l1"), c["l2"].alias("l2"), c["r1"].alias("r1")),
    )
    return F.when(F.size(hits) > 0, parts).otherwise(F.array().cast("array<struct<g:int,h:int,v:string,l1:string,l2:string,r1:string>>"))


def placed(parts: Column) -> Column:
    """Matches with their places, from ``pieces_of``, as array of (s, e, v, l1, l2, r1): code points, end exclusive.

    Places are sums over what stands before; they are built in parts of about the root of the number of matches, since an array
    that grows by one is copied each time.
    """
    none = F.array().cast("array<struct<s:int,e:int,v:string,l1:string,l2:string,r1:string>>")
    size = F.ceil(F.sqrt(F.size(parts).cast("double"))).cast("int")

    def part(c: Column) -> Column:
        at = F.aggregate(F.slice(parts, F.lit(1), c * size), F.lit(0), lambda acc, x: acc + x["g"] + x["h"])
        grow = lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["h"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["h"]).alias("e"), x["v"].alias("v"), x["l1"].alias("l1"), x["l2"].alias("l2"), x["r1"].alias("r1")))).alias("out"),
        )
        return F.aggregate(F.slice(parts, c * size + 1, size), F.struct(at.alias("at"), none.alias("out")), grow, lambda acc: acc["out"])

    return F.when(F.size(parts) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(parts) / size).cast("int") - 1), part))).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether 1 to 19 digits pass the check-digit test."""
    turned = F.reverse(digits)

    def part(k: Column) -> Column:
        d = F.substr(turned, k + 1, F.lit(1)).cast("int") * (1 + k % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, k: acc + part(k)) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(bare, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


def listed(spans: Column) -> Column:
    """kind:start:end by start, then in the order of KINDS."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, base (valid matches of the patterns) and runs (other candidates), places in code points."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    # each search is a column of its own, which the optimizer doesn't copy into the several places that use it
    searches = {k: searched(F.col("t"), PATTERNS[k], NEEDS[k]) for k in KINDS} | {"runs": searched(F.col("t"), CANDIDATE)}
    pieces = texts.select("doc_id", "key", *[c.alias(f"{k}_{n}") for k, pair in searches.items() for n, c in zip(("hits", "gaps"), pair)])
    pieces = pieces.select("doc_id", "key", *[pieces_of(F.col(f"{k}_hits"), F.col(f"{k}_gaps")).alias(k) for k in searches])
    raw = pieces.select("doc_id", "key", *[placed(F.col(k)).alias(k) for k in searches])

    def named(kind: str) -> Column:
        o = KINDS.index(kind)
        return F.transform(F.filter(F.col(kind), lambda x: valid(kind, x["v"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(o).alias("o"), x["v"].alias("v"), x["l1"].alias("l1"), x["l2"].alias("l2"), x["r1"].alias("r1")))

    return raw.select("doc_id", "key", "runs", F.concat(*[named(k) for k in KINDS]).alias("base"))


def free_parts(run: Column, base: Column) -> Column:
    """What of a run may be an identifier, as array of (s, e, v, pre, suf): its first and its last words, as many as can be one,
    that no base match touches. pre, suf: whether the run's left, right neighbour is the part's."""
    words = F.split(run["v"], " ")
    n = F.size(words)

    def part(k: Column, pre: bool) -> Column:
        bare = F.rtrim(F.array_join(F.slice(words, F.lit(1) if pre else n - k + 1, k), " "), F.lit(".-/("))
        whole = F.array_join(F.slice(words, F.lit(1) if pre else n - k + 1, k), " ")
        s = run["s"] if pre else run["e"] - F.length(whole)
        return F.struct(s.alias("s"), (s + F.length(bare)).alias("e"), bare.alias("v"), (F.lit(pre) | (k == n)).alias("pre"), (F.lit(not pre) | (k == n)).alias("suf"))

    firsts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(MOST_WORDS))), lambda k: part(k, True))
    lasts = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.least(n - 1, F.lit(MOST_WORDS))), lambda k: part(k, False))).otherwise(F.array().cast("array<struct<s:int,e:int,v:string,pre:boolean,suf:boolean>>"))
    return F.filter(F.concat(firsts, lasts), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))


def state(kind: str, v: Column) -> Column:
    """1 for a seed, 0 for a value that may be one of the kind, -0.5 for a card number whose check digit is wrong."""
    if kind == "secret":
        return F.when(v.rlike(SECRET_SEED), 1.0).otherwise(0.0)
    if kind == "card":  # as long as a card's, but the check digit isn't right
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        return F.when(v.rlike(f"^{PATTERNS['card']}$") & digits.between(14, 19) & ~valid("card", v), -0.5).otherwise(0.0)
    return F.lit(0.0)


def touched(found: DataFrame) -> DataFrame:
    """key, s, e, cut: runs that base matches touch, and these. Both meet by stretches of the text, so a text may hold many."""
    at = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / STRETCH), F.floor((F.col(e) - 1) / STRETCH)))
    runs = found.select("key", F.explode("runs").alias("x")).select("key", "x.s", "x.e").withColumn("stretch", at("s", "e"))
    base = found.select("key", F.explode("base").alias("x")).select("key", F.col("x.s").alias("b"), F.col("x.e").alias("d")).withColumn("stretch", at("b", "d"))
    both = runs.join(base, ["key", "stretch"]).where("b < e and s < d")
    return both.groupBy("key", "s", "e").agg(F.collect_set(F.struct(F.col("b").alias("s"), F.col("d").alias("e"))).alias("cut"))


def learnt_spans(found: DataFrame) -> DataFrame:
    """key, more: spans that contexts of known finds disclose.

    A graph joins lexical patterns (a kind and the word before, the two words before, the word after, or the words around) to
    instances, the values found there. Seeds of weight 1 are valid base matches and, for secrets, long words that look
    random; other values of a kind's loose form start at 0. Contrary are values known to be something
    else: seeds of other kinds, values that have no form of the kind, and card numbers whose check digit is wrong
    (which are given out all the same where their context is a card's).
    In each round a pattern's confidence is the weight of its instances over that weight, its contrary ones and DOUBT, if
    LEAST_SEEDS seeds support it: loose forms that nothing is known of don't count. An instance takes the confidence of
    its best pattern that reaches LEAST_CONFIDENCE. The rounds end with the patterns whose instances are given out; of parts of one run that
    overlap, the one of the best pattern, then the longest.
    """
    kinds = (*KINDS, "secret")
    places = ("key", "run", "s", "e", "v", "l1", "l2", "r1", "pre", "suf")
    own = F.array(*[F.struct(F.lit(o).alias("o"), F.when(F.col("x.o") == o, 1.0).otherwise(-1.0).alias("seed")) for o in range(len(kinds))])
    known = found.select("key", F.explode("base").alias("x")).select("key", F.col("x.s").alias("run"), "x.s", "x.e", "x.v", "x.l1", "x.l2", "x.r1", F.lit(True).alias("pre"), F.lit(True).alias("suf"), F.explode(own).alias("k")).select(*places, "k.*")
    runs = found.select("key", F.explode("runs").alias("x")).select("key", "x", "x.s", "x.e").join(touched(found), ["key", "s", "e"], "left")
    runs = runs.select("key", "x", free_parts(F.col("x"), F.coalesce("cut", F.array().cast("array<struct<s:int,e:int>>"))).alias("parts"))

    def instances(o: int, kind: str) -> Column:
        fits = F.filter("parts", lambda p: p["v"].rlike(LOOSE[kind]))
        item = lambda p, pre, suf, seed: F.struct(p["s"].alias("s"), p["e"].alias("e"), p["v"].alias("v"), pre.alias("pre"), suf.alias("suf"), F.lit(o).alias("o"), seed.alias("seed"))
        wrong = F.filter("parts", lambda p: p["pre"] & p["suf"])
        lone = F.transform(wrong, lambda p: item(p, ~F.exists(fits, lambda q: q["pre"]), ~F.exists(fits, lambda q: q["suf"]), F.lit(-1.0)))
        return F.concat(F.transform(fits, lambda p: item(p, p["pre"], p["suf"], state(kind, p["v"]))), F.filter(lone, lambda p: p["pre"] | p["suf"]))

    loose = runs.select("key", F.col("x.s").alias("run"), "x.l1", "x.l2", "x.r1", F.explode(F.concat(*[instances(o, k) for o, k in enumerate(kinds)])).alias("i")).select("key", "run", "l1", "l2", "r1", "i.*").select(*places, "o", "seed")
    lexical = lambda c: c.rlike(r"[\p{L}=:#]") & ~c.rlike("[0-9@]")
    side = lambda name, ok, word: F.struct(F.lit(name).alias("side"), F.when(ok & lexical(word), word).otherwise("").alias("word"))
    l1, l2, r1, pre, suf = (F.col(c) for c in ("l1", "l2", "r1", "pre", "suf"))
    around = F.when(lexical(l1) & lexical(r1), F.concat(l1, F.lit(" _ "), r1)).otherwise("")
    sides = F.array(side("before", pre, l1), side("before two", pre, l2), side("after", suf, r1), side("around", pre & suf, around))
    rows = known.unionByName(loose).withColumn("p", F.explode(F.filter(sides, lambda p: p["word"] != "")))
    uses = materialise(rows.select("key", "run", "s", "e", "pre", "o", F.lower("v").alias("v"), "p.side", "p.word", "seed"), "contexts")
    by = ["o", "side", "word"]
    edges = uses.groupBy(*by, "v").agg(F.max("seed").alias("seed"))
    weights = edges.withColumn("w", F.greatest("seed", F.lit(0.0)))
    for turn in range(ROUNDS):
        scored = weights.groupBy(*by).agg((F.sum("w") / (F.sum("w") + F.count_if(F.col("seed") < 0) + DOUBT)).alias("c"), F.count_if(F.col("seed") > 0).alias("n"))
        good = scored.where((F.col("c") >= LEAST_CONFIDENCE) & (F.col("n") >= LEAST_SEEDS)).select(*by, "c")
        if turn == ROUNDS - 1:
            break
        best = edges.where("seed >= 0").join(good, by).groupBy("o", "v").agg(F.max("c").alias("c"))
        weights = edges.join(best, ["o", "v"], "left").withColumn("w", F.when(F.col("seed") < 0, 0.0).otherwise(F.greatest("seed", F.coalesce("c", F.lit(0.0))))).drop("c")
    new = uses.where((F.col("seed") > -1) & ((F.col("seed") < 1) | (F.col("o") == SECRET))).join(good, by)
    rank = F.struct("c", (F.col("e") - F.col("s")).alias("n"), (-F.col("o")).alias("o"), "s", "e")
    tops = new.groupBy("key", "run").agg(F.max(F.when(F.col("pre"), rank)).alias("a"), F.max(F.when(~F.col("pre"), rank)).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.e") <= F.col("b.s"))
    kept = F.explode(F.when(both, F.array("a", "b")).otherwise(F.array(F.greatest("a", "b"))))
    return tops.select("key", kept.alias("x")).groupBy("key").agg(F.collect_set(F.struct(F.col("x.s").alias("s"), F.col("x.e").alias("e"), (-F.col("x.o")).alias("o"))).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of its base matches, all spans of these kinds,
    secrets (start:end, such as tokens and keys that contexts disclose) and n_spans, how many there are in all.

    base and more give them as arrays of structs (s, e, o: start, end in code points, place in KINDS, SECRET for secrets). See ``placed``,
    ``valid`` and ``learnt_spans``. Null text is empty: no spans. A null doc_id stays. Repeated rows have the same spans
    each. Empty in, empty out; other columns aren't looked at.
    """
    found = materialise(base_spans(spread(docs.select("doc_id", "text"))), "spans")
    more = learnt_spans(found)
    all_rows = found.join(more, "key", "left")
    none = F.array().cast("array<struct<s:int,e:int,o:int>>")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["o"].alias("o")))
    extra = F.coalesce(F.transform("more", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["o"].alias("o"))), none)

    def count(o: int) -> Column:
        return F.size(F.filter("base", lambda x: x["o"] == o)).cast("long").alias(f"n_{KINDS[o]}")

    counts = [count(o) for o in range(len(KINDS))]
    secrets = F.array_join(F.transform(F.array_sort(F.filter(extra, lambda x: x["o"] == SECRET)), lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return all_rows.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, F.filter(extra, lambda x: x["o"] < SECRET))).alias("spans"),
        secrets.alias("secrets"), (F.size(base) + F.size(extra)).cast("long").alias("n_spans"), base.alias("base"), extra.alias("more"),
    )
