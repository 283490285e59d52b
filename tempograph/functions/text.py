"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decisions depend on.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
INITIALISM_STOP = ("of", "and", "the", "for")
RESERVED_PREDICATES = ("potential_alias",)
RELATIONAL_CUES = (
    "relationship between", "connection between", "related to", "relate to", "how does it relate", "how do they relate",
    "connected to", "link between", "links between", "association between", "how are they connected",
)
BROAD_CUES = (
    "what do we know", "what do you know", "tell me about", "tell me everything", "everything about", "everything we know",
    "give me an overview", "overview of", "summarise", "summarize", "summary of",
)
FACTUAL_CUES = (
    "what is", "what are", "what was", "what were", "what's", "who is", "who are", "who was", "who were", "who's",
    "when is", "when was", "when did", "where is", "where was", "where did", "which ", "how many", "how much", "how old",
)
INJECTIONS = (
    r"(?i)ignore\s+(?:previous|all|the\s+(?:above|following|prior))\s+instructions?",
    r"(?i)disregard\s+(?:the\s+)?(?:above|previous|prior|following)",
    r"(?i)forget\s+(?:your\s+)?(?:instructions?|context|rules?|system\s+prompt)",
    r"(?i)(?:new|updated?)\s+(?:instruction|directive|system\s+prompt|objective)\s*:",
    r"(?im)^\s*(?:you\s+are\s+now|act\s+as|pretend\s+(?:you\s+are|to\s+be))\s+(?:a\s+)?(?:different|new\s+)?\w+",
    r"(?im)^\s*system\s*:",
    r"(?im)^\s*user\s*:",
    r"(?im)^\s*assistant\s*:",
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"<\|system\|>",
    r"<\|user\|>",
    r"<\|assistant\|>",
    r"```",
    r"---END---",
    r"(?i)</\s*(?:prompt|system|instruction|context)\s*>",
    r"(?i)<\s*(?:prompt|system|instruction|context)\s*>",
)
SECRETS = (r"AKIA[0-9A-Z]{16}", r"(?i)(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S+", r"-----BEGIN [A-Z ]*PRIVATE KEY-----")


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    # what is no part of a word goes from the whole text at once, which is one pass and no function call per word
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")
    return F.filter(F.split(kept, r"\s+"), lambda w: w != "")


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def normalize_label(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def shannon_entropy(text: Column) -> Column:
    """Entropy of the characters, with the number of bytes as the denominator."""
    size = F.octet_length(text).cast("double")
    characters = F.split(text, "")
    share = lambda c: F.size(F.filter(characters, lambda x: x == c)) / size
    return F.when(size == 0, 0.0).otherwise(
        F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    )


def char_shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; a shorter text is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array(text))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def discriminators(text: Column) -> Column:
    """Numbers without leading zeros, and names of months, sorted."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+"), 0), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    months = F.filter(tokens(text), lambda w: w.isin(*MONTHS))
    return F.array_sort(F.array_distinct(F.concat(numbers, months)))


def long_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= 2))


def lexically_compatible(a: Column, b: Column, overlap: float = 0.5) -> Column:
    """Equal when normalised, or of equal numbers and months with enough words in common."""
    alike = (discriminators(a) == discriminators(b)) & (jaccard(long_tokens(a), long_tokens(b)) >= overlap)
    return (normalize_name(a) == normalize_name(b)) | alike


def initialism(short: Column, long: Column) -> Column:
    """Whether the short form's letters begin the first significant words of the long form."""
    letters = F.regexp_replace(F.lower(short), r"[^\p{L}]", "")
    words = F.filter(tokens(long), lambda w: ~w.isin(*INITIALISM_STOP))
    initials = F.array_join(F.transform(F.slice(words, 1, F.greatest(F.length(letters), F.lit(1))), lambda w: F.substring(w, 1, 1)), "")
    return (F.length(letters) >= 2) & (initials == letters)


def lemma_equal(a: Column, b: Column) -> Column:
    stem = lambda c: F.regexp_replace(normalize_name(c), "s$", "")
    return (normalize_name(a) == normalize_name(b)) | (stem(a) == stem(b))


def intent(query: Column) -> Column:
    """By the first cue found, in the order Relational, Broad, Factual; Broad without any."""
    lowered = F.lower(query)

    def has(cues: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for cue in cues:
            found = found | F.contains(lowered, F.lit(cue))
        return found

    return F.when(has(RELATIONAL_CUES), "Relational").when(has(BROAD_CUES), "Broad").when(has(FACTUAL_CUES), "Factual").otherwise("Broad")


def name_rejection(name: Column) -> Column:
    """Why a proposed name is refused, in the order of the rules; null if it is not."""
    trimmed = F.trim(name)
    return (
        F.when(trimmed == "", "empty")
        .when(name.rlike(r"[\x00-\x1f]"), "control")
        .when(name.rlike(r"[{}\[\]\"]"), "json")
        .when(F.length(trimmed) < 3, "short")
        .when(F.length(trimmed) > 50, "long")
        .when(trimmed.rlike(r"^[0-9]+$"), "numeric")
        .when(trimmed.contains("..."), "ellipsis")
        .when(trimmed.rlike(r"^[^\p{L}\p{N}]+$"), "punctuation")
        .when(F.size(F.array_distinct(F.split(F.lower(trimmed), ""))) < 2, "low information")
    )


def redacted(text: Column, patterns: tuple[str, ...] = INJECTIONS) -> Column:
    """Every match of every pattern, in their order; a line begins after a line feed only."""
    for p in patterns:
        text = F.regexp_replace(text, p.replace("(?im)", "(?imd)"), "[REDACTED]")
    return text


def holds_secret(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in SECRETS))


def entropy_gate(name: Column, floor: float = 1.5, length: int = 6, words: int = 2) -> Column:
    normal = normalize_name(name)
    return (F.length(normal) >= length) & (F.size(tokens(normal)) >= words) & (shannon_entropy(normal) >= floor)


def snippet(text: Column, name: Column, half: int) -> Column:
    """The text around the first mention, the head of the text if there is none."""
    at = F.instr(F.lower(text), F.lower(name))
    begin = F.greatest(at - half, F.lit(1))
    around = F.substring(text, begin, at + F.length(name) + half - begin)
    return F.when(at > 0, around).otherwise(F.substring(text, F.lit(1), F.lit(2 * half)))


def word_windows(text: Column, size: int = 300, overlap: int = 50) -> Column:
    """Windows of words, each beginning ``overlap`` words before the last one's end."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size(words) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))


def grounded(name: Column, source_tokens: Column) -> Column:
    """At least one word of the name, and its last, are in the source."""
    words = tokens(name)
    return (F.size(words) > 0) & F.array_contains(source_tokens, F.element_at(words, -1))


def metadata_matches(metadata: Column, equal: dict[str, str], any_of: dict[str, list[str]] | None = None) -> Column:
    """All keys must match; a list matches by any of its values; absent metadata does not."""
    ok = metadata.isNotNull()
    for key, value in equal.items():
        ok = ok & F.coalesce(F.get_json_object(metadata, f"$.{key}") == value, F.lit(False))
    for key, values in (any_of or {}).items():
        ok = ok & F.coalesce(F.get_json_object(metadata, f"$.{key}").isin(*values), F.lit(False))
    return ok


def in_namespaces(groups: list[str], column: str = "group_id") -> Column:
    """Rows of the namespaces and rows of none; no namespace asked for is no filter."""
    return F.lit(True) if not groups else F.col(column).isin(*groups) | F.col(column).isNull()


def group_key(namespace: Column, thread: Column) -> Column:
    return F.concat_ws(":", namespace, thread)


def fact_hash(subject: Column, predicate: Column, object_: Column) -> Column:
    """The hash of a triple; a missing part counts as empty, so no hash is null."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat(part(subject), F.lit("\0"), part(predicate), F.lit("\0"), part(object_)), 256)


def canonical_type(name: Column) -> Column:
    """Title case without white space around or doubled."""
    return F.initcap(normalize_label(F.regexp_replace(name, "[_-]", " ")))

