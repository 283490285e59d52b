"""What callers plug in: embedders, extractors, rerankers, and chunking, all in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[str, list[str]], list[float]]


def hash_embedder(dim: int = 64) -> Embedder:
    """Deterministic vectors for tests: each word adds one to a cell of its hash."""
    import xxhash

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()

    return embed


def embedding_column(embed: Embedder, prefix: str = ""):
    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed([prefix + (t or "") for t in texts]))

    return run


def backfill(df: DataFrame, embed: Embedder, text: str = "content") -> DataFrame:
    """Vectors where there are none; others stay."""
    made = embedding_column(embed)(F.col(text))
    return df.withColumn("embedding", F.when(F.col("embedding").isNull(), made).otherwise(F.col("embedding")))


def rerank_column(score: Scorer, query: str):
    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score(query, [t or "" for t in texts]), dtype="float64")

    return run


def extract(df: DataFrame, extractor: Callable[[str], list[dict]], schema: str, text: str = "content", key: str = "id") -> DataFrame:
    """Rows that a caller's function finds in each text, with the text's key."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [{"source_key": k} | found for k, t in zip(rows[key], rows[text], strict=True) for found in extractor(t or "")]
            if out:
                yield pd.DataFrame(out)

    return df.select(key, text).mapInPandas(run, f"source_key {kind}, {schema}")


_BREAKS = (re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s"), re.compile(r"\s"))


def split_text(text: str, most: int) -> list[str]:
    """Pieces of at most so many characters, cut at a paragraph, a sentence or a blank where there is one."""
    out = []
    while len(text) > most:
        cut = most
        for pattern in _BREAKS:
            ends = [m.end() for m in pattern.finditer(text, 0, most)]
            if ends and ends[-1] > most // 3:
                cut = ends[-1]
                break
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text or not out else out


def chunked(df: DataFrame, most: int, text: str = "content", key: str = "id") -> DataFrame:
    """(key, chunk, body) of every text; the bodies add up to it."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, i, p) for k, t in zip(rows[key], rows[text], strict=True) for i, p in enumerate(split_text(t or "", most))]
            yield pd.DataFrame(out, columns=[key, "chunk", "body"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk int, body string")


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+")
# The suffixes of Porter's algorithm (1980), longest first within a step.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def porter(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) < 3:
        return word
    # plurals and participles
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            stem = word.removesuffix(suffix)
            if stem != word and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _shape(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # longer suffixes, while enough is left before them
    for step in (_STEP2, _STEP3):
        found = max((pair for pair in step if word.endswith(pair[0])), key=lambda pair: len(pair[0]), default=None)
        if found and _measure(word[: -len(found[0])]) > 0:
            word = word[: -len(found[0])] + found[1]
    last = max((s for s in _STEP4 if word.endswith(s)), key=len, default=None)
    if last and _measure(word[: -len(last)]) > 1 and (last != "ion" or word[: -len(last)].endswith(("s", "t"))):
        word = word[: -len(last)]
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or (size == 1 and not _ends_short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _ends_short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _stemmed(texts: pd.Series) -> pd.Series:
    import unicodedata

    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return pd.Series([[porter(w) for w in _WORD.findall(fold(t or ""))] for t in texts])


def stemmed_tokens(text: Column) -> Column:
    """Folded and stemmed words, for searches that want them."""
    return pandas_udf(_stemmed, "array<string>")(text)


def first_json(text: str) -> str | None:
    """The first JSON object in a text, whatever stands around it; strings and brackets left open at the end are closed."""
    begin = text.find("{")
    if begin < 0:
        return None
    held: list[str] = []
    quoted = escaped = False
    for i in range(begin, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            held.append("}" if c == "{" else "]")
        elif c in "}]" and held and held[-1] == c:
            held.pop()
            if not held:
                return text[begin : i + 1]
    body = text[begin:].rstrip().removesuffix("```").rstrip()
    return body + '"' * quoted + "".join(reversed(held))


def _first_json(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else first_json(t) for t in texts], dtype=object)


def first_json_column(text: Column) -> Column:
    return pandas_udf(_first_json, "string")(text)


# Words that begin no name.
STOP_WORDS = frozenset("a about after all also an and any are as at be because been before but by can could did do does for from had has have he her here him his how i if in into is it its just me my no nor not now of on once only or our out over she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who why will with would yes you your".split())
_EDGES = "\"'`.,;:!?()[]{}<>*_-/\\|\u201c\u201d\u2018\u2019\u2026"


def proper_nouns(text: str, known: frozenset[str] = frozenset()) -> list[str]:
    """Runs of up to four words in title case that are no stop words, the longest beginning that has a word of four letters; none that are known.

    A single word at the beginning of a sentence says nothing.
    """
    words = [(raw.strip(_EDGES), raw) for raw in text.split()]
    title = [bool(w) and w[0].isupper() and any(c.islower() for c in w[1:]) and w.lower() not in STOP_WORDS for w, _ in words]
    out: dict[str, str] = {}
    i = 0
    while i < len(words):
        if not title[i]:
            i += 1
            continue
        end = i + 1
        while end < min(len(words), i + 4) and title[end]:
            end += 1
        first = i == 0 or words[i - 1][1][-1:] in ".?!"
        for stop in range(end, i, -1):
            run = [w for w, _ in words[i:stop]]
            name = " ".join(run)
            plain = " ".join("".join(c for c in name.lower() if c.isalnum() or c.isspace()).split())
            if any(sum(map(str.isalpha, w)) >= 4 for w in run) and not (stop == i + 1 and first) and plain not in known:
                out.setdefault(plain, name)
                i = end
                break
        else:
            i += 1
    return list(out.values())


def proper_noun_column(text: Column) -> Column:
    @pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([proper_nouns(t or "") for t in texts])

    return run(text)


def resolve_column(same: Callable[[list[tuple[str, str]]], list[str]], most: int = 32):
    """A caller's judge of name pairs, asked in windows of at most so many."""

    @pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        return pd.Series([v for at in range(0, len(pairs), most) for v in same(pairs[at : at + most])], dtype=object)

    return run


def structured_call(ask: Callable[[str, str], str], text: str, tries: int = 2) -> tuple[str, str | None]:
    """(way, JSON) of the first way of asking that gives an object: by schema, as JSON, by prompt alone, as delimited lines."""
    import json

    for way in ("schema", "json", "prompt", "tuples"):
        for _ in range(tries):
            try:
                answer = ask(way, text)
            except Exception:  # a provider that fails is asked in the next way
                break
            if way == "tuples":
                rows = [x.split("<|#|>") for x in answer.split("<|COMPLETE|>")[0].splitlines()]
                return way, json.dumps({"entities": [{"name": r[1].strip(), "entity_type_id": int(r[2])} for r in rows if len(r) == 4 and r[2].strip().isdigit()]})
            found = first_json(answer)
            try:
                if found and isinstance(json.loads(found), dict):
                    return way, found
            except ValueError:
                continue
    return "none", None


def replayed(requests: DataFrame, cassette: DataFrame) -> DataFrame:
    """Requests (key, call) with the answers recorded for the hash of each and its place among equal ones; null where none is."""
    return requests.join(cassette, ["request_hash", "call_index"], "left")
