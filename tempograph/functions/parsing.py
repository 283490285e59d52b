"""Readers of small formats, labels, keys, and answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_name, tokens

# Names that results are compared with.
CATEGORIES = {"multi-session": "MultiSession", "knowledge-update": "KnowledgeUpdate", "temporal-reasoning": "TemporalReasoning"}
RATES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.0), "*": (1.0, 2.0)}


def structural_label(label: Column) -> Column:
    """2 to 64 bytes, begins with a letter or underscore, then letters, digits, underscores and blanks; holds a letter."""
    size = F.octet_length(label)
    return (size >= 2) & (size <= 64) & label.rlike("^[A-Za-z_][A-Za-z0-9_ ]*$") & label.rlike("[A-Za-z]")


def canonical_label(label: Column) -> Column:
    return structural_label(label) & ~F.lower(label).isin("entity", "unknown")


def index_list(text: Column) -> Column:
    """The first JSON list of integers in a text, else none."""
    found = F.regexp_extract(text, r"\[\s*(-?\d+(?:\s*,\s*-?\d+)*)\s*\]", 1)
    return F.when(found == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(found, r"\s*,\s*"), lambda x: x.cast("bigint")))


def first_object(text: Column) -> Column:
    """A JSON object without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def session_date(text: Column) -> Column:
    """``1:56 pm on 8 May, 2023`` as a timestamp, else null."""
    pattern = r"(?i)^\s*(\d{1,2}:\d{2})\s*(am|pm)\s+on\s+(\d{1,2})\s+([a-z]+),?\s+(\d{4})\s*$"
    part = [F.regexp_extract(text, pattern, i) for i in range(1, 6)]
    joined = F.concat_ws(" ", F.lpad(part[0], 5, "0"), F.upper(part[1]), F.lpad(part[2], 2, "0"), F.initcap(F.lower(part[3])), part[4])
    return F.try_to_timestamp(joined, F.lit("hh:mm a dd MMMM yyyy")).cast("timestamp_ntz")


def exact_match(expected: Column, given: Column, fold: bool = True) -> Column:
    a, b = F.trim(expected), F.trim(given)
    return F.lower(a) == F.lower(b) if fold else a == b


def category(question_type: Column, question_id: Column) -> Column:
    """Abstention first, then by type; every other type, the single-session ones too, is extraction."""
    out = F.when(question_id.endswith("_abs"), "Abstention")
    for kind, name in CATEGORIES.items():
        out = out.when(question_type == kind, name)
    return out.otherwise("InformationExtraction")


def rate(model: Column, which: int) -> Column:
    """Exact name, else the longest name that it begins with, else the default."""
    known = sorted((k for k in RATES if k != "*"), key=len, reverse=True)
    out = None
    for k in known:
        cond = model.startswith(k)
        out = F.when(cond, RATES[k][which]) if out is None else out.when(cond, RATES[k][which])
    return out.otherwise(RATES["*"][which])


def idempotency_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("␟", *parts), 256)


def pair_key(a: Column, b: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256)


def token_f1(hypothesis: Column, reference: Column) -> Column:
    """F1 of bags of words."""

    def scored(bags: Column) -> Column:
        a, b = bags.a, bags.b
        count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
        common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, w: acc + F.least(count(a, w), count(b, w)))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))

    # the bags are variables of a lambda, so that each is made once
    bags = F.array(F.struct(tokens(hypothesis).alias("a"), tokens(reference).alias("b")))
    return F.transform(bags, scored)[0]


def quick_score(hypothesis: Column, reference: Column) -> Column:
    """1 for equal, 1 for contained, else F1 of words; an empty answer is refused."""
    h, r = normalize_name(hypothesis), normalize_name(reference)
    return F.when(h == "", 0.0).when(h == r, 1.0).when(F.contains(h, r) & (r != ""), 1.0).otherwise(token_f1(hypothesis, reference))


def verdict_value(verdict: Column) -> Column:
    return F.when(verdict == "correct", 1.0).when(verdict == "partial", 0.5).otherwise(0.0)


def item_credit(items: Column, answer: Column) -> Column:
    """Share of listed items found in the answer, as a part of it or by half of their words."""
    have = tokens(answer)
    found = F.filter(items, lambda i: F.contains(F.lower(answer), F.lower(i)) | (F.size(F.array_intersect(tokens(i), have)) >= 0.5 * F.size(F.array_distinct(tokens(i)))))
    return F.when(F.size(items) > 0, F.size(found) / F.size(items)).otherwise(0.0)


def effective_k(k: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(k, n))


def recall_limit(kind: Column) -> Column:
    return F.when(kind == "temporal", 30).when(kind == "multi-hop", 40).otherwise(20)


def shouted(text: Column) -> Column:
    """Words in capitals of two letters or more in title case."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w.rlike(r"^\p{Lu}{2,}[^\p{L}]*$"), F.initcap(F.lower(w))).otherwise(w)), " ")


def prefixed(text: Column, query: bool) -> Column:
    return F.concat(F.lit("search_query: " if query else "search_document: "), text)


def may_follow(old: Column, new: Column) -> Column:
    """Whether a state may come after another in ingestion."""
    order = {"pending": 0, "phase1": 1, "verified": 2, "facts": 3, "done": 4}
    rank = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in order.items()])
    return F.when(new.isin("failed", "cancelled"), ~old.isin("done", "failed", "cancelled")).otherwise(F.coalesce(rank(new) == rank(old) + 1, F.lit(False)))


# Marks of the line format and of untrusted text.
FIELD, SENTINEL, UNTRUSTED = "<|#|>", "<|COMPLETE|>", "untrusted_source"


def delimited_tuples(text: Column, marker: str = "entity") -> Column:
    """(name, entity_type_id, description) of each well-formed line up to the end mark."""
    lines = F.transform(F.split(text, "\\n"), lambda x: F.trim(F.regexp_replace(x, "\\r", "")))
    end = F.array_position(lines, SENTINEL)
    live = F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
    fields = F.transform(live, lambda x: F.transform(F.split(x, r"<\|#\|>"), lambda f: F.trim(f)))
    well = F.filter(fields, lambda f: (F.size(f) == 4) & (f[0] == marker) & f[2].rlike("^[0-9]{1,10}$") & (f[2].cast("bigint") < 2**32))
    return F.transform(well, lambda f: F.struct(f[1].alias("name"), f[2].cast("bigint").alias("entity_type_id"), f[3].alias("description")))


def parsed_entities(answer: Column, types: int) -> Column:
    """Entities of a model's JSON; unknown type numbers become 0, names that are pieces of JSON go."""
    whole = F.from_json(answer, "struct<entities: array<struct<name: string, entity_type_id: bigint>>>").entities
    named = F.filter(whole, lambda e: e["name"].isNotNull() & (F.trim(e["name"]) != "") & ~e["name"].rlike(r'[{}\[\]"]'))
    known = lambda t: F.when((t >= 0) & (t < types), t).otherwise(0)
    return F.coalesce(F.transform(named, lambda e: F.struct(F.trim(e["name"]).alias("name"), known(e["entity_type_id"]).alias("entity_type_id"))), F.array().cast("array<struct<name:string,entity_type_id:bigint>>"))


def template_entities(answer: Column) -> Column:
    """(name, label) of an answer that lists names by label."""
    lists = F.map_entries(F.from_json(answer, "map<string, array<string>>"))
    return F.flatten(F.transform(lists, lambda e: F.transform(F.coalesce(e.value, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), e.key.alias("label")))))


def schema_violation(document: Column, required: dict[str, str], allowed: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The first thing that a JSON object lacks of its schema, as a message for a second try; null if it fits."""
    patterns = {"integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "boolean": "^(true|false)$"}
    out = F.when(F.try_parse_json(document).isNull(), "not JSON")
    for key, kind in required.items():
        value = F.get_json_object(document, f"$.{key}")
        out = out.when(value.isNull(), f"missing field {key}")
        if kind in patterns:
            out = out.when(~value.rlike(patterns[kind]), f"field {key} is no {kind}")
    for key, values in (allowed or {}).items():
        out = out.when(~F.get_json_object(document, f"$.{key}").isin(*values), f"field {key} is none of {', '.join(values)}")
    return out


def utf8_head(text: Column, most: int) -> Column:
    """The longest beginning of whole characters in so many bytes."""
    raw = F.encode(text, "UTF-8")
    head = F.hex(F.substring(raw, F.lit(1), F.lit(most)))
    following = F.hex(F.substring(raw, F.lit(most + 1), F.lit(1)))
    # the cut is inside a character if the next byte continues one; then its first bytes go
    whole = F.when(following.rlike("^[89AB]"), F.regexp_replace(head, "^((?:..)*)[C-F].(?:[89AB].)*$", "$1")).otherwise(head)
    return F.decode(F.unhex(whole), "UTF-8")


def untrusted(text: Column) -> Column:
    """A text between tags that stamp its hash, with what could pass for the tags or a control token taken apart."""
    safe = F.regexp_replace(text, f"(?i)<(/?\\s*{UNTRUSTED})", "&lt;$1")
    safe = F.regexp_replace(safe, r"<\|([a-zA-Z_]+)\|>", "&lt;|$1|&gt;")
    return F.concat(F.lit(f'<{UNTRUSTED} sha256="'), F.sha2(text, 256), F.lit('">\n'), safe, F.lit(f"\n</{UNTRUSTED}>"))


def search_expression(query: Column) -> Column:
    """A full-text expression in which every word is quoted and all must occur."""
    return F.array_join(F.transform(tokens(query), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " AND ")


def word_spans(text: Column, widest: int) -> Column:
    """(first, last) of all runs of up to so many words."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    firsts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(firsts, lambda i: F.transform(F.sequence(i, F.least(i + (widest - 1), n - 1)), lambda j: F.struct(i.alias("first"), j.alias("last")))))


def spans_apart(scored: Column) -> Column:
    """Of scored spans (score, first, last), the best one, then the best that meets none taken before, and so on."""
    best = F.array_sort(scored, lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.first < b.first, -1).when(a.first > b.first, 1).otherwise(a.last - b.last))
    nothing = F.filter(scored, lambda s: F.lit(False))
    meets = lambda s, t: (s.first <= t.last) & (t.first <= s.last)
    return F.aggregate(best, nothing, lambda taken, s: F.when(F.exists(taken, lambda t: meets(s, t)), taken).otherwise(F.concat(taken, F.array(s))))
