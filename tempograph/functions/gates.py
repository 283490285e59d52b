"""Decisions about names, types and proposals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import RESERVED_PREDICATES, char_shingles, entropy_gate, normalize_name

# Thresholds that decisions depend on.
VERDICT_FLOOR = 0.7
DESCRIPTION_COSINE, DESCRIPTION_BAND = 0.85, 0.70
RETYPE_COSINE = 0.75
CORROBORATED = 524_288

PRIME = 2**31 - 1


def novelty_is_redundant(is_same: Column, confidence: Column) -> Column:
    """A proposed type is an old one: the verdict says so and is sure; no verdict says nothing."""
    return F.coalesce(is_same & (confidence >= VERDICT_FLOOR), F.lit(False))


def reserved(predicate: Column) -> Column:
    return predicate.isin(*RESERVED_PREDICATES)


def prefilter(cosine: Column, tau: float) -> Column:
    return cosine < tau


def redundancy(exact: Column, cosine: Column, lemma: Column) -> Column:
    """What becomes of a proposed type, by its best match among the known ones."""
    return (
        F.when(exact, "Redundant")
        .when(cosine >= DESCRIPTION_COSINE, F.when(lemma, "Redundant").otherwise("NeedsLlmVerify"))
        .when(cosine >= DESCRIPTION_BAND, "NeedsLlmVerify")
        .otherwise("Pass")
    )


def minhash(text: Column, permutations: int = 32, size: int = 3) -> Column:
    """The least value of a text's shingles under each of so many affine permutations of the first 28 bits of their MD5."""
    hashes = F.transform(char_shingles(text, size), lambda s: F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("bigint"))

    def least(held: Column) -> Column:
        slope = lambda i: (16_807 * (i + 1) * (i + 1) + 48_271) % PRIME
        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(permutations - 1).cast("bigint")), lambda i: F.array_min(F.transform(held, lambda h: (slope(i) * h + 69_621 * (i + 1)) % PRIME)))

    # a variable of a lambda, so that the hashes are made once
    return F.transform(F.array(hashes), least)[0]


def minhash_likeness(a: Column, b: Column) -> Column:
    """The share of permutations under which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def surely_same(a: Column, b: Column, likeness: float = 0.9) -> Column:
    """Same by normalised name, or by MinHash where the name says enough; null where a model has to tell."""
    alike = entropy_gate(a) & entropy_gate(b) & (minhash_likeness(minhash(normalize_name(a)), minhash(normalize_name(b))) >= likeness)
    return F.when((normalize_name(a) == normalize_name(b)) | alike, True)


def time_ordered(older: Column, newer: Column) -> Column:
    return F.coalesce(newer > older, F.lit(False))


def intent_weight(intent: Column, base: Column) -> Column:
    """A base weight under an intent's multiplier; all are one."""
    factors = {"Relational": 1.0, "Broad": 1.0, "Factual": 1.0}
    return base * F.coalesce(*[F.when(intent == k, v) for k, v in factors.items()], F.lit(1.0))


def verdict_action(verdict: Column, new_type: Column, confidence: Column, known: Column) -> Column:
    """What a type verdict does: a correction needs confidence and a registered type; no verdict demotes."""
    sure = (verdict == "correct") & (confidence >= VERDICT_FLOOR) & known & (new_type > 0)
    return F.when(verdict == "confirm", "Confirm").when(F.coalesce(sure, F.lit(False)), "Correct").otherwise("Demote")


def contradiction_label(id_: Column, pool: Column, contradicted: Column, duplicates: Column) -> Column:
    """What a fact of a pool is to a new one, and which pool it came from."""
    outcome = F.when(F.array_contains(duplicates, id_), "duplicate").when(F.array_contains(contradicted, id_), "contradicted").otherwise("kept")
    return F.concat_ws(":", outcome, pool)


def fetch_size(k: Column, total: Column, within: Column) -> Column:
    """How many an index must bring so that about k of a namespace are among them."""
    return F.greatest(k, F.least(total, F.ceil(k * total / F.greatest(within, F.lit(1))))).cast("bigint")
