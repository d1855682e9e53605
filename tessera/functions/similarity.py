"""Pair similarities: built-in expressions over word and gram sets, Arrow batches for edit ratios."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import acronym, tokens


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for k, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for ch in b:
        match = row & places.get(ch, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """2 LCS / (lengths), 1 for two empty texts."""
    total = len(a) + len(b)
    return 1.0 if not total else 2 * lcs(a, b) / total


class Texts:
    """Texts of which ``ratios`` gives the edit ratios with another, as ``ratio`` does pair by pair: the rows of ``lcs`` for all at once."""

    LIMB = 63  # bits of a row that a word holds, its last bit being the carry

    def __init__(self, texts: list[str]) -> None:
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.zeros((int(self.size.max(initial=0)), len(texts)), dtype=np.uint32)
        for k, t in enumerate(texts):
            codes[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + 1
        letters, place = np.unique(np.append(np.uint32(0), codes.ravel()), return_inverse=True)
        self.place = place[1:].reshape(codes.shape)
        self.letters = {int(c) - 1: k for k, c in enumerate(letters) if c}

    def ratios(self, text: str) -> np.ndarray:
        limbs = -(-len(text) // self.LIMB)
        match = np.zeros((limbs, len(self.letters) + 1), dtype=np.uint64)
        full = np.zeros(limbs, dtype=np.uint64)
        for k, ch in enumerate(text):
            bit = np.uint64(1 << k % self.LIMB)
            full[k // self.LIMB] |= bit
            if ord(ch) in self.letters:
                match[k // self.LIMB, self.letters[ord(ch)]] |= bit
        rows = [np.full(len(self.size), f) for f in full]
        low, shift = np.uint64((1 << self.LIMB) - 1), np.uint64(self.LIMB)
        for at in self.place:
            carry = np.uint64(0)
            for k in range(limbs):
                both = rows[k] & match[k][at]
                total = rows[k] + both + carry
                carry = total >> shift
                rows[k] = (total & low) | (rows[k] - both)
        common = len(text) - sum((np.bitwise_count(r & f).astype(np.int64) for r, f in zip(rows, full)), np.zeros(len(self.size), np.int64))
        total = self.size + len(text)
        return np.rint(100 * np.where(total == 0, 1.0, 2 * common / np.maximum(total, 1))) / 100


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best ratio of shared words, and shared words with each side's rest; 0 if a side has none, 1 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel(one, two)
    if both:
        best = max(best, indel(both, one), indel(both, two))
    return best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one of its length, or shorter at the ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n, best = len(a), 0.0
    chars = set(a)
    for k in range(1 - n, len(b)):
        window = b[max(k, 0) : k + n]
        if window[-1] in chars or window[0] in chars:
            best = max(best, indel(a, window))
            if best == 1.0:
                break
    return best


def shares(function, left: pd.Series, right: pd.Series) -> pd.Series:
    """A batch's scores as whole percentages; null counts as '', and equal pairs are scored once."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(left.fillna(""), right.fillna("")):
        if pair not in seen:
            seen[pair] = round(100 * function(*pair)) / 100
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def scored(function, a: str, b: str) -> Column:
    return F.pandas_udf(lambda left, right: shares(function, left, right), "double")(F.col(a), F.col(b))


def ratio(a: str, b: str) -> Column:
    return scored(indel, a, b)


def token_sort_ratio(a: str, b: str) -> Column:
    return scored(token_sort, a, b)


def token_set_ratio(a: str, b: str) -> Column:
    return scored(token_set, a, b)


def partial_ratio(a: str, b: str) -> Column:
    return scored(partial, a, b)


def word_overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(tokens(a), tokens(b))).cast("double")


def word_jaccard(a: str, b: str) -> Column:
    union = F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(word_overlap(a, b) / union)


def word_containment(a: str, b: str) -> Column:
    least = F.least(F.size(tokens(a)), F.size(tokens(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(word_overlap(a, b) / least)


def acronym_match(a: str, b: str) -> Column:
    x, y = acronym(a), acronym(b)
    return (((x != "") & ((x == F.col(b)) | (x == y))) | ((y != "") & (y == F.col(a)))).cast("double")


def number_jaccard(a: str, b: str) -> Column:
    """0.5 where a side has no number."""
    return F.when((F.trim(F.col(a)) == "") | (F.trim(F.col(b)) == ""), F.lit(0.5)).otherwise(word_jaccard(a, b))


def first_number_match(a: str, b: str) -> Column:
    one, two = (F.get(F.filter(F.split(F.col(c), " "), lambda w: w != ""), F.lit(0)) for c in (a, b))
    return F.when(one.isNull() | two.isNull(), F.lit(0.5)).otherwise((one == two).cast("double"))


def gram_cosine(a: str, b: str) -> float:
    """Cosine of the counts of character trigrams within words, each word with a space at both ends; 0 where a side has none."""
    x, y = (Counter(w[k : k + 3] for w in (f" {t} " for t in text.split()) for k in range(max(1, len(w) - 2))) for text in (a, b))
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[g] for g, v in x.items()) / norm if norm else 0.0


def trigram_cosine(a: str, b: str) -> Column:
    """In Arrow batches: an expression over arrays of grams compares every gram with every other."""
    return F.pandas_udf(lambda left, right: pd.Series([gram_cosine(*p) for p in zip(left.fillna(""), right.fillna(""))], dtype="float64"), "double")(F.col(a), F.col(b))


def length_ratio(a: str, b: str) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def legal_suffix(name: str, core: str) -> Column:
    """What a normalised name has besides its core."""
    n, c = F.col(name), F.col(core)
    after = F.trim(F.substr(n, F.length(c) + 1))
    at = F.expr(f"locate({core}, {name})")
    cut = F.trim(F.concat(F.substr(n, F.lit(1), at - 1), F.substr(n, at + F.length(c))))
    return F.when(c == "", F.lit("")).when(n.startswith(c), after).when(at > 0, cut).otherwise(F.trim(n))


def l2(vector: str) -> Column:
    """A vector of length 1; one of length 0 stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def score_to_probability(score: Column, any_outside: Column) -> Column:
    """Logistic where a batch has scores outside [0, 1], then clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(any_outside, 1 / (1 + F.exp(-score))).otherwise(score)))
