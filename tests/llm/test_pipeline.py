"""The pipeline's stages on a small fixture against plain Python."""

import random

import pytest

import corpus_pipeline
from tempograph.llm.decontamination import budget, normalised
from tempograph.llm.suffix_dedup import brute_force
from tempograph.llm.toxicity import Lexicon, fold, learn, sigmoid


def fixture():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(900)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [" ".join(words(30)) for _ in range(3)]
    docs, labels = [], []
    for i in range(90):
        w = words(r.randint(20, 160))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(5):
                w[r.randrange(len(w))] = r.choice(["idiot", "moron", "scum"])
        docs.append([i, " ".join(w), "en", "s", 0])
        labels.append((i, 1, int(toxic)))
    for k in range(8):  # near copies
        w = docs[20 + k][1].split()
        if k % 2:
            w[0] = "changed"
        docs.append([100 + k, " ".join(w), "en", "s", 0])
    passage = " ".join(words(60))
    for i in (31, 32, 33):
        docs[i][1] += " " + passage
    docs[40][1] += " " + items[0].upper().replace(" ", ", ")
    docs[41][1] += " " + items[1][:50] + "x" + items[1][51:]
    docs += [[200, None, None, None, None], [201, "", "en", "s", 0], [202, "", "en", "s", 0]]
    for d in docs:
        d[4] = len(d[1] or "")
    return [tuple(d) for d in docs], labels, items


def distance_inside(item: bytes, text: bytes) -> int:
    """Edits between an item and the nearest part of a text, the plain way."""
    row = [0] * (len(text) + 1)
    for j, a in enumerate(item, 1):
        before, row = row, [j]
        for k, b in enumerate(text, 1):
            row.append(min(before[k - 1] + (a != b), before[k] + 1, row[-1] + 1))
    return min(row)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels, items = fixture()
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def clean_by_hand(rows: dict, lexicon: Lexicon) -> dict:
    import math

    out = {}
    for i, text in rows.items():
        words = fold(text).split()
        total = sum(max([w for t, w in lexicon.terms.items() if f" {x} ".startswith(t)], default=0.0) for x in words)
        n = len(words) + 1 if words else 2
        x = (1.0, math.log1p(max(0.0, total)), total / math.sqrt(n), math.log(n) * (total > 0))
        if float(sigmoid(sum(a * b for a, b in zip(x, lexicon.curve, strict=True)))) < 0.5:
            out[i] = text
    return out


def one_of_each(rows: dict) -> dict:
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    ids = sorted(rows)
    sets, parent = {i: shingles(rows[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: rows[i] for i in ids if find(i) == i}


def test_stages_against_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    benchmark = [(r.item_id, normalised(r.text)) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    lexicon = learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, tables)
        if name == "toxicity":
            rows = clean_by_hand(rows, lexicon)
            assert not any(i < 90 and i % 6 == 0 for i in rows) and len(rows) > 70
        elif name == "simhash_near_dedup":
            rows = one_of_each(rows)
        elif name == "suffix_array_dedup":
            gone = brute_force([(i, t.encode()) for i, t in rows.items()])
            rows = {i: t for i, t in rows.items() if gone[i][0] < len(t.encode()) or not t}
        elif name == "benchmark_decontamination":
            held = {i for i, t in now.items() for _, b in benchmark if distance_inside(b, normalised(t)) <= budget(len(b), 0.1)}
            assert {40, 41} <= held
            rows = {i: t for i, t in rows.items() if i not in held}
        if name == "sentencepiece":
            got = result.collect()
            assert {r.doc_id for r in got} == set(rows)
            assert all(len({bytes(r.ids) for r in got if r.doc_id == i}) == (2 if now[i] else 1) for i in rows if now[i] != "")
            break
        folder = f"{tables}/{name}"
        result.write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns == columns
        now = {r.doc_id: r.text or "" for r in docs.collect()}
        assert set(now) == set(rows), name
        if name == "suffix_array_dedup":
            import hashlib

            assert all(hashlib.sha256(now[i].encode()).hexdigest() == gone[i][2] for i in rows)


def test_whole_run(spark, tables):
    result = corpus_pipeline.run(spark, tables)
    assert result.count() > 100 and "ids" in result.columns
