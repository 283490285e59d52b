"""Training-data operators on small tables: brute force, round trips, and odd rows."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string, `group` int"


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one long text, clashing extra columns."""
    long_text = " ".join(f"word{i % 700}" for i in range(9000))
    rows = [
        (1, "The cat sat on the mat and looked at the dog.", "x", 1), (2, None, None, None), (3, "", "y", 2), (4, "   \n\t ", "z", 3),
        (5, "The cat sat on the mat and looked at the dog.", "x", 1), (5, "The cat sat on the mat and looked at the dog.", "x", 1),
        (None, "no id here", "q", 4), (7, "a", "s", 5), (8, long_text, "l", 6), (9, "ÄÖ é 日本 \U0001f600 <|endoftext|>", "u", 7),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


# 1


def test_lm_base_matches_brute_force_and_model_is_better(docs):
    from tempograph.llm.lm_scoring import score

    got = score(docs, core=200, classes=16).collect()
    words = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    counts = {}
    for i, tokens in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    held_base = held = 0.0
    for r in got:
        base = sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in words[r.doc_id])
        assert abs(base - r.base_score) < 1e-6
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words[r.doc_id]), n, sum(t in counts for t in words[r.doc_id]))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        if r.held_out:
            held_base, held = held_base + base, held + r.score
    assert held > held_base


def test_lm_probabilities_sum_to_one():
    import numpy as np

    from tempograph.llm.lm_scoring import Model

    bigrams = np.array([[3, 1, 2], [1, 0, 4], [2, 4, 0]])
    m = Model(bigrams, np.array([6, 5]), np.array([3, 2]), np.array([1, 0]), np.array([1, 1]), 6)
    for before in range(3):
        known = sum(10 ** m.step[before, c] * (m.of_class[c] - m.discount[c] * k) / m.of_class[c] for c, k in ((0, 3), (1, 2)))
        assert abs(known + 10 ** m.step[before, 2] + 10 ** m.strange[before] - 1) < 1e-9


def test_exchange_finds_two_classes():
    import numpy as np

    from tempograph.llm.lm_scoring import exchange

    # words 0-3 and 4-7 follow each other crosswise
    pairs = np.zeros((10, 10), np.int64)
    pairs[:4, 4:8] = 5
    pairs[4:8, :4] = 5
    where = exchange(pairs, 2, 2, 20)
    assert len(set(where[:4])) == 1 and len(set(where[4:8])) == 1 and where[0] != where[4]


def test_gains_are_differences_of_likelihood():
    import numpy as np

    from tempograph.llm.lm_scoring import gains, likelihood, moves

    r = np.random.default_rng(5)
    words, classes = 40, 6
    pairs = r.poisson(r.gamma(0.3, 2.0, (words + 1, words + 1)))  # the last one: the end

    def table_of(where):
        table = np.zeros((classes + 2, classes + 2))
        np.add.at(table, (where[:, None], where[None, :]), pairs)
        return table

    def beside(chosen, where):
        after, before = np.zeros((len(chosen), classes + 2)), np.zeros((len(chosen), classes + 2))
        for i, w in enumerate(chosen):
            for v in range(words + 1):
                if v != w:
                    after[i, where[v]] += pairs[w, v]
                    before[i, where[v]] += pairs[v, w]
        return after, before, np.array([pairs[w, w] for w in chosen], float)

    # some words outside all classes, one class with a single word
    where = np.append(r.integers(0, classes - 1, words), classes)
    where[3], where[:3] = classes - 1, classes + 1
    chosen = np.arange(words)
    got = gains(table_of(where), *beside(chosen, where), where[:words], classes)
    for w in chosen:
        made = []
        for c in range(classes):
            moved = where.copy()
            moved[w] = c
            made.append(likelihood(table_of(moved)))
        for c in range(classes):
            assert abs((got[w, c] - got[w, 0]) - (made[c] - made[0])) < 1e-6, (w, c)
    # one word at a time never lowers the likelihood
    before = likelihood(table_of(where))
    for w in range(3, words):
        after, left, own = beside([w], where)
        counts = np.concatenate([after, left, own[:, None]], axis=1)
        counts[0, where[w]] += own[0]
        counts[0, classes + 2 + where[w]] += own[0]
        where[w] = moves(table_of(where), lambda a, z, counts=counts: counts[a:z], where[w : w + 1], classes)[0]
        now = likelihood(table_of(where))
        assert now >= before - 1e-9
        before = now


def test_lm_score_matches_plain_python(spark, docs):
    """The classes of all training words are read back; counts, transitions, discounts and scores are made again from the texts."""
    from tempograph.llm.lm_scoring import Chunk, _known, fit, likelihood, score

    chosen = docs.filter("doc_id < 60").select("doc_id", "text")
    size = dict(classes=6, core=50, sweeps=2)
    marked, model = fit(chosen, **size)
    of = {}
    for row in marked.collect():
        c = Chunk(row.asDict(recursive=True))
        of |= {w: int(k) for w, k in zip(c.words, _known(c)[1], strict=True) if k >= 0}
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in chosen.collect()}
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10}
    count, pair, end = {}, {}, 6
    for t in train.values():
        for w in t:
            count[w] = count.get(w, 0) + 1
        line = [end] + [of[w] for w in t] + [end]
        for a, b in zip(line, line[1:], strict=False):
            pair[a, b] = pair.get((a, b), 0) + 1
    assert set(count) == set(of)  # every training word has a class
    tokens, kinds, once, twice = ([sum(f(n) for w, n in count.items() if of[w] == c) for c in range(6)] for f in (lambda n: n, lambda n: 1, lambda n: n == 1, lambda n: n == 2))
    discount = [min(0.9, max(0.1, o / max(o + 2 * t, 1))) for o, t in zip(once, twice, strict=True)]
    into = [sum(pair.get((a, b), 0) for a in range(7)) + 1 for b in range(7)]

    def step(a, b):
        return (pair.get((a, b), 0) + 5 * into[b] / sum(into)) / (sum(pair.get((a, c), 0) for c in range(7)) + 5)

    def strange(a):
        return sum(step(a, c) * (discount[c] * kinds[c] / tokens[c] if tokens[c] else 1.0) for c in range(6))

    got = by_id(score(chosen, **size))
    for i, t in texts.items():
        at, want = end, 0.0
        for w in t:
            if w in of:
                want += math.log10(step(at, of[w]) * (count[w] - discount[of[w]]) / tokens[of[w]])
                at = of[w]
            else:
                want += math.log10(strange(at))
        want += math.log10(step(at, end))
        assert abs(want - got[i].score) < 1e-6 * max(1, len(t))
    # the sweeps over all words raise the likelihood over the first assignment
    none, _ = fit(chosen, classes=6, core=50, sweeps=0)
    import numpy as np

    from tempograph.llm.lm_scoring import _transitions

    assert likelihood(_transitions(marked, 6)) > likelihood(_transitions(none, 6))
    assert np.isfinite(model.step).all()


def test_lm_words_are_hashed_once_and_left_behind(spark, docs):
    import numpy as np
    import xxhash

    from tempograph.llm import lm_scoring

    rows = docs.limit(50).selectExpr("doc_id as id", "text", "doc_id % 10 = 0 as held").coalesce(1)
    row = lm_scoring._encode(rows, 4_000_000).first().asDict()
    whole = lm_scoring.Chunk(row)
    lean = lm_scoring.Chunk({k: v for k, v in row.items() if k != "words"})
    assert lean.words == [] and lean.distinct == len(whole.words) > 100
    assert lean.parts(7).tolist() == [xxhash.xxh32_intdigest(w) % 7 for w in whole.words]
    values = np.arange(lean.distinct)
    assert lean.stream(values, -1, False).tolist() == whole.stream(values, -1, False).tolist()
    for joined in (b"", b"a", b"a\nbc\n\nd", "ä\n日本".encode()):
        assert lm_scoring._listed(joined).to_pylist() == joined.split(b"\n")
    index = np.random.default_rng(5).integers(0, 70_000, 500)
    for most in (9, 70_001):
        got = lm_scoring._grouped(index % most)
        assert [(k, at.tolist()) for k, at in got] == [(k, np.flatnonzero(index % most == k).tolist()) for k in sorted(set((index % most).tolist()))]


def test_lm_odd_rows(odd, empty):
    from tempograph.llm.lm_scoring import score

    got = score(odd, core=8, classes=4, sweeps=2).collect()
    assert len(got) == len(odd_rows()) and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert score(empty, core=8, classes=4).count() == 0


# 2


def check_sharding(frame, shards=16):
    """The law and the columns against plain Python over the input rows."""
    from collections import Counter

    from tempograph.llm.sharding import shard

    rows = shard(frame, shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in frame.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert all(r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r.slot)
    sizes = [len(per.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in per.values())
    return rows


def inside(rows):
    """Pairs of equal texts in one shard."""
    from collections import Counter

    return sum(n * (n - 1) // 2 for n in Counter((r.text_crc32, r.size, r.shard) for r in rows).values())


def test_sharding_law_and_cut(spark, odd, empty, docs):
    from tempograph.llm.sharding import balanced, cut_links, shard

    heavy = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 4}") for i in range(400)], "doc_id long, text string")
    # groups on both sides of what counts as hot
    mixed = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"pair {i // 6}" if i < 900 else f"single {i}") for i in range(4000)], "doc_id long, text string")
    for frame in (odd, docs):
        check_sharding(frame)
    # the best that capacities allow: 1334 copies fill five shards of 250 and part of a sixth
    best = 5 * 250 * 249 // 2 + 84 * 83 // 2
    kept = inside([r for r in check_sharding(mixed) if r.text_crc32 == zlib.crc32(b"same")])
    assert kept > 0.6 * best
    # circles need no room; what enters a full shard must be left by as much
    assert balanced([[0, 5, 0], [0, 0, 3], [4, 0, 0]], [0, 0, 0]) == [[0, 3, 0], [0, 0, 3], [3, 0, 0]]
    assert balanced([[0, 5, 0], [0, 0, 9], [0, 0, 0]], [0, 1, 2]) == [[0, 3, 0], [0, 0, 2], [0, 0, 0]]
    groups = heavy.select("doc_id", F.md5("text").alias("group"))
    cut = cut_links(shard(heavy, 16).select("doc_id", "shard"), groups).first()
    random_shards = heavy.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("shard"))
    assert cut.cut < cut_links(random_shards, groups).first().cut
    assert shard(empty, 16).count() == 0
    # the same input in another order gives the same shards and slots
    again = lambda rows: sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in rows)
    assert again(shard(odd, 16).collect()) == again(shard(odd.repartition(3, "extra"), 16).collect())


# 3


def test_toxicity_folding_and_exceptions():
    from tempograph.llm.toxicity import Lexicon, fold, weigh

    for text in ("stupid", "5tup1d", "ѕtupіd", "STU​PID!!", "stup1d$$$"):
        assert fold(text) == fold("stupid")
    a = Lexicon({fold("trash").rstrip(): 2.0, fold("tra").rstrip(): 1.0}).automaton()
    assert weigh(fold("what trash this is"), a) == 2.0
    assert weigh(fold("a trash can"), a) == 0.0
    assert weigh(fold(""), a) == 0.0


def test_toxicity_held_out_accuracy(spark):
    from tempograph.llm.toxicity import learn, score

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, learn(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.95


def test_toxicity_odd_rows(spark, odd, empty):
    from tempograph.llm.toxicity import clean, learn, score

    labels = spark.createDataFrame([(1, 1, 0), (5, 1, None), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    lexicon = learn(odd, labels)
    rows = score(odd, lexicon).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert clean(odd, lexicon).columns == odd.columns
    assert score(empty, learn(empty, labels.filter("false"))).count() == 0


# 4


@pytest.fixture(scope="module")
def model():
    from tempograph.llm.html_extraction import train

    return train(300)


def test_extraction_of_known_pages(model):
    from tempograph.llm.html_extraction import Maker, extract, own_blocks, parse

    maker, hit, made, wanted = Maker(123), 0, 0, 0
    for _ in range(80):
        page = maker.page()
        gold = {b for n in parse(page) for b in own_blocks(n) if n.gold and isinstance(b, str)}
        found = set(extract([page.replace(" data-gold", "").replace(" data-dross", "")], model)[0].split("\n")) - {""}
        hit, made, wanted = hit + len(gold & found), made + len(found), wanted + len(gold)
    assert hit / made > 0.85 and hit / wanted > 0.8


def test_decoding_never_contradicts():
    import numpy as np

    from tempograph.llm.html_extraction import decode, parse

    nodes = parse("<div><div><p>a<p>b</div><ul><li>c<li>d</ul></div>")
    r = np.random.default_rng(0)
    for _ in range(200):
        odds = r.normal(size=len(nodes)) * 3
        kept = decode(nodes, odds.copy())
        assert all(kept[n.parent] or not kept[i] for i, n in enumerate(nodes) if i)


def test_extraction_odd_pages(spark, model):
    from tempograph.llm.html_extraction import main_text

    page = "<article><h1>T &amp; U</h1><p>one\n two&nbsp;three<p>four <b>five</b></article><script>var x='<p>no</p>'</script><footer>f</footer>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", page, 3), (4, "u", "<<<>>> <p <b", 4), (None, "u", "plain", 5), (3, "u", page, 3), (6, "u", "<div>" * 3000 + "x", 6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = main_text(frame, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 3] == ["T & U\none two three\nfour five"] * 2
    assert main_text(frame.filter("false"), model).count() == 0


def article_of(page):
    """What a reader of these pages marks as the article: the blocks inside its element, read without the module."""
    import html
    import re

    body = page[page.index("<article>") + 9 :].split("</article>")[0].split("<footer")[0]
    blocks = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
    return [t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()))]


def test_articles_of_the_pages_table(spark):
    """Blocks of text found in all pages of sf0.01, against those of the article: precision and recall by characters."""
    from collections import Counter

    from tempograph.llm.html_extraction import main_text

    pages = spark.read.parquet(f"{DATA}/pages.parquet".replace("sf0.001", "sf0.01"))
    right = given = wanted = 0
    for r in main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        gold, found = Counter(article_of(r.html)), Counter(r.text.split("\n") if r.text else [])
        size = lambda blocks: sum(len(t) * n for t, n in blocks.items())
        right, given, wanted = right + size(gold & found), given + size(found), wanted + size(gold)
    assert right / given > 0.999 and right / wanted > 0.999


def test_broken_markup_takes_linear_time():
    import time

    from tempograph.llm.html_extraction import extract, parse, train

    size = 60_000
    cases = {
        "quotes without end": "<p>" + '<a "x ' * size, "values that swallow": "<p>" + '<a x="> ' * size, "no end of tags": "<a" * size + ">",
        "many values": "<a " + 'x="y" ' * size + ">", "lone end tags": "<b>" * size + "</i>" * size, "end tags past a block": "<i><div>" + "<b>" * size + "</i>" * size,
        "items of two lists": "<li><dt>" * size, "near end tags": "<script>" + "</scriptx>" * size, "brackets": "<" * size,
    }
    for name, page in cases.items():
        began = time.perf_counter()
        parse(page)
        assert time.perf_counter() - began < 5, name
    model = train(60)
    # a flat article of very many paragraphs keeps them all
    paragraphs = [f"Paragraph {i} says, once more, that it is part of the article." for i in range(2_000)]
    page = "<body><nav><ul><li><a href=/>a</a></ul></nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article><footer>f</footer></body>"
    assert extract([page], model)[0].split("\n") == paragraphs
    assert extract(['<article><p title="a > b">x &amp; y</p><p>it goes on and on, and so on.</p></article>'], model)


# 5


def brute_sketch(text, k=128, size=5):
    """The k least signed hashes of a text's shingles: XXH64 of each word (seed 42), then of the words' hashes in a chain of seeds."""
    import re
    import struct

    import xxhash

    def signed(h):
        return h - 2**64 if h >> 63 else h

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    runs = [hashes[i : i + size] for i in range(len(hashes) - size + 1)] or ([hashes] if hashes else [])
    out = set()
    for run in runs:
        h = 42
        for x in run:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        out.add(signed(h))
    return sorted(out)[:k]


def brute_likeness(a, b, k=128):
    if not a and not b:
        return 1.0
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union)


def test_sketches_estimate(spark):
    from tempograph.llm import sketches as s

    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    a, b = words[:2000], words[1000:]
    frame = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    h = frame.select(s.shingle_hashes(F.col("a")).alias("a"), s.shingle_hashes(F.col("b")).alias("b"))
    k = 256
    got = h.select(s.sketch(F.col("a"), k).alias("a"), s.sketch(F.col("b"), k).alias("b")).select(
        s.resemblance(F.col("a"), F.col("b"), k).alias("r"), s.distinct_shingles(F.col("a"), k).alias("n"), s.containment(F.col("a"), F.col("b"), k).alias("c")
    )
    x = got.first()
    assert abs(x.r - true) < 0.1 and abs(x.n / len(sets[0]) - 1) < 0.25 and abs(x.c - len(sets[0] & sets[1]) / len(sets[0])) < 0.15
    whole = h.select((s.sketch(F.concat("a", "b"), k) == s.merged(s.sketch(F.col("a"), k), s.sketch(F.col("b"), k), k)).alias("same"))
    assert whole.first().same


def beside_next_rows(rows):
    """What the operator must return of (doc_id, text) rows, in order of descending id, hash and text; null ids last."""
    import xxhash

    def tie(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - 2**64 if h >> 63 else h

    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))
    out = []
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed = brute_sketch(text), brute_sketch(edited)
        printed = ["".join(f"{h % 2**64:016x}" for h in x) for x in (own, changed)]
        likeness = [round(brute_likeness(own, x), 9) for x in (changed, brute_sketch(following))]
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), *printed, *likeness))
    return sorted(out)


def test_fingerprints_beside_next(spark, odd, empty, docs):
    from tempograph.llm.sketches import beside_next

    sparse = spark.createDataFrame([(i * 10**15 - 5, f"some words that are here number {i} of them all") for i in range(50)], "doc_id long, text string")
    same = spark.createDataFrame([(None if i % 3 else 7, f"w{i % 5} and then some more words") for i in range(60)], "doc_id long, text string")
    for frame, size in ((docs, 100_000), (docs, 10**9), (odd, 50), (sparse, 100), (same, 100)):
        want = beside_next_rows([(r.doc_id, r.text) for r in frame.collect()])
        got = beside_next(frame, range_bytes=size).collect()
        assert want == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert beside_next(empty).count() == 0


# 6


@pytest.fixture(scope="module")
def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_segmentations_round_trip_and_differ(docs, odd, empty, piece_model):
    from tempograph.llm.segmentation import decode, sample_segmentations

    for frame in (docs, odd):
        texts = {}
        for r in frame.collect():
            texts.setdefault(r.doc_id, set()).add(r.text or "")
        back = decode(sample_segmentations(frame, piece_model, k=3).withColumnRenamed("doc_id", "key"), piece_model)
        seen = {}
        for r in back.collect():
            assert r.text in texts[r.key]
            assert r.log_prob <= 1e-9 and r.log_inclusion <= 0
            seen.setdefault(r.key, {}).setdefault(r.sample, set()).add(bytes(r.ids))
        for samples in seen.values():
            assert all(len(x) == 1 for x in samples.values())  # equal rows, equal samples
            assert len({next(iter(x)) for x in samples.values()}) == len(samples)
    assert sample_segmentations(empty, piece_model).count() == 0


def test_segmentations_follow_their_probabilities(piece_model):
    import collections

    import pyarrow as pa

    from tempograph.llm.segmentation import Pieces, _seen, segment

    pieces = Pieces.load(piece_model, 0.2)
    n = 6000
    got = segment(pa.array(["the in"] * n), list(range(n)), pieces, _seen(pieces), 2)
    first, prob = collections.Counter(), {}
    weight = collections.Counter()
    for s in got:
        key = tuple(s.ids.tolist())
        prob[key] = math.exp(s.log_prob)
        if s.nth == 0:
            first[key] += 1
        weight[key] += prob[key] / math.exp(s.log_inclusion)
    for key, count in first.most_common(4):
        assert abs(count / n - prob[key]) < 4 * math.sqrt(prob[key] / n)
        assert abs(weight[key] / n - prob[key]) < 0.05  # inclusion scores weigh samples back to probabilities


def all_segmentations(text, names, alpha):
    """Every segmentation of a text with its probability, by plain recursion over the vocabulary: the one list of pieces that are words' parts."""
    listed = [n for i, n in enumerate(names) if i > 258 and "▁" not in n[1:]]
    weight = {n: -alpha * math.log(2 + rank) for rank, n in enumerate(listed)}
    bytes_weight = -alpha * math.log(2 + len(listed))
    units = ["▁" + u for u in text.split(" ")]

    def cut(unit, at):
        if at == len(unit):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in weight:
                out += [((unit[at:end], *rest), weight[unit[at:end]] + w) for rest, w in cut(unit, end)]
        if unit[at] not in weight:
            spelt = tuple(f"<0x{b:02X}>" for b in unit[at].encode())
            out += [((*spelt, *rest), bytes_weight * len(spelt) + w) for rest, w in cut(unit, at + 1)]
        return out

    found = [((), 0.0)]
    for u in units:
        found = [(a + b, x + y) for a, x in found for b, y in cut(u, 0)]
    total = sum(math.exp(w) for _, w in found)
    return {pieces: math.exp(w) / total for pieces, w in found}


@pytest.mark.parametrize("text", ["of it", "an𒀀in", "ab c"])
def test_segmentations_against_all_of_a_lattice(piece_model, text):
    import collections

    import pyarrow as pa
    import sentencepiece

    from tempograph.llm.segmentation import Pieces, _seen, segment

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    exact = all_segmentations(text, names, 0.2)
    assert abs(sum(exact.values()) - 1) < 1e-9 and len(exact) > 3
    pieces, n, k = Pieces.load(piece_model, 0.2), 5000, 2
    drawn = collections.defaultdict(dict)
    for s in segment(pa.array([text] * n), list(range(n)), pieces, _seen(pieces), k):
        key = tuple(names[i] for i in s.ids.tolist())
        assert abs(math.exp(s.log_prob) - exact[key]) < 1e-9  # fails for what is no segmentation, too
        drawn[s.row][s.nth] = key
    # without replacement: the second is drawn from what the first leaves
    pairs = collections.Counter((d[0], d[1]) for d in drawn.values())
    for (a, b), count in pairs.most_common(6):
        want = exact[a] * exact[b] / (1 - exact[a])
        assert a != b and abs(count / n - want) < 4.5 * math.sqrt(want / n)


def test_segmentations_of_the_sign_for_a_blank(spark, piece_model):
    from tempograph.llm.segmentation import decode, sample_segmentations

    texts = ["a▁b", "▁", " ▁ x", "▁▁the the▁in", "  a  ", "▁ "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = decode(sample_segmentations(frame, piece_model, k=3).withColumnRenamed("doc_id", "key"), piece_model).collect()
    assert {r.key for r in back} == set(range(len(texts))) and all(r.text == texts[r.key] for r in back)


# 7


def test_token_counts_match_library(spark, docs, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tempograph.llm.token_counts import count_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(-i, t, "", 0) for i, t in enumerate(["aaaaaaa aaaa", " a  b\n\n c\t", "it's we'll 'll", "日本語 　 x\x1cy", "\x85a\xa0b 12ab3 !!??", "x" * 3000], 1)], DOCS)
    for frame in (docs.select("doc_id", "text"), odd, extra):
        want = sorted((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in frame.collect())
        rows = count_tokens(frame, path).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert count_tokens(empty, path).count() == 0


# 8


def test_deep_shallow_orders_rows():
    import numpy as np

    from tempograph.llm.suffix_dedup import deep_shallow

    r = random.Random(9)
    stem = bytes(r.randrange(256) for _ in range(60))
    rows = [stem[: r.choice((0, 20, 40, 56, 60))] + bytes(r.randrange(3) for _ in range(64)) for _ in range(300)]
    rows = [x[:64] for x in rows] + [stem + b"\0" * 4] * 3
    table = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 64)
    order, common = deep_shallow(table)
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    for i in range(1, len(got)):
        n = next((k for k in range(64) if got[i][k] != got[i - 1][k]), 64)
        assert common[i] == n


def test_suffix_dedup_matches_brute_force(spark, docs, empty):
    from tempograph.llm.suffix_dedup import brute_force, digest, remove_repeats

    r = random.Random(1)
    base = ["".join(r.choice("ab ") for _ in range(r.choice([50, 150, 300]))) for _ in range(20)]
    rows = []
    for i in range(120):
        k = r.random()
        a, b = r.choice(base), r.choice(base)
        if k < 0.3:
            text = a
        elif k < 0.6:
            text = a[: r.randint(0, len(a))] + r.choice(["", "x", "yz"]) + b[r.randint(0, len(b)) :]
        elif k < 0.7:
            text = r.choice("aé") * r.randint(0, 400)
        elif k < 0.8:
            text = "line of text x | " * r.randint(0, 40)
        else:
            text = "".join(r.choice("abcdé ") for _ in range(r.randint(0, 300)))
        rows.append((i, text))
    frame = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string").repartition(3)
    for table, size in ((frame, 3000), (docs, 10**6)):
        got = {x.doc_id: (x.n_removed, x.n_spans, x.kept_sha256) for x in digest(remove_repeats(table, chunk_bytes=size)).collect()}
        assert got == brute_force([(x.doc_id, (x.text or "").encode()) for x in table.select("doc_id", "text").collect()])
    assert remove_repeats(empty).count() == 0


def test_suffix_dedup_odd_rows(odd):
    from tempograph.llm.suffix_dedup import remove_repeats

    got = remove_repeats(odd, carried=("extra", "group"), as_text=True)
    assert got.count() == len(odd_rows()) and "extra" in got.columns


# 9


def test_decontamination_finds_all_within_budget():
    from tempograph.llm.decontamination import Index, normalised

    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    items = [(i, " ".join(r.choices(words, k=r.randint(15, 50)))) for i in range(30)]
    index = Index.build(items, 0.1)
    for _ in range(150):
        i = r.randrange(len(items))
        raw = bytearray(index.texts[i])
        edits = r.randint(0, int(index.edits[i]))
        for _ in range(edits):
            p, kind = r.randrange(len(raw)), r.random()
            if kind < 0.4:
                raw[p] = r.choice(b"xyz")
            elif kind < 0.7:
                del raw[p]
            else:
                raw.insert(p, r.choice(b"xyz"))
        around = [normalised(" ".join(r.choices(words, k=40))) for _ in range(3)]
        found = index.find([around[0], around[1] + b" " + bytes(raw) + b" " + around[2], around[0]])
        own = [f for f in found if f[:2] == (1, i)]
        assert own and own[0][2] <= edits
    assert not index.find([normalised("nothing of the kind")])


def test_decontamination_tables(spark, docs, odd, empty):
    from tempograph.llm.decontamination import contaminated, decontaminated

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    plain = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert plain <= got
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench, block_bytes=2000).collect()} == got
    left = {r.doc_id for r in decontaminated(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}
    none = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "item_id long, text string")
    assert contaminated(odd, none).count() == 0 and contaminated(empty, bench).count() == 0
    assert decontaminated(odd, none).count() == len(odd_rows())


def test_decontamination_of_repeated_rows_and_long_items(spark):
    from tempograph.llm.decontamination import contaminated

    r = random.Random(3)
    long_item = " ".join(f"w{r.randrange(10**7)}" for _ in range(560_000))  # over 4 MB
    assert len(long_item) > 4 << 20
    short = "a passage of the benchmark that is not long"
    bench = spark.createDataFrame([(1, short), (2, short), (3, long_item)], "item_id long, text string")
    rows = [(1, f"x {short} y"), (1, f"x {short} y"), (None, short.upper()), (2, f"before it {long_item} after it"), (3, "nothing of it")]
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=100_000_000).collect()
    assert sorted((str(x.doc_id), x.item_id, x.edits) for x in got) == [("1", 1, 0), ("1", 1, 0), ("1", 2, 0), ("1", 2, 0), ("2", 3, 0), ("None", 1, 0), ("None", 2, 0)]


def test_decontamination_judges_rows_not_ids(spark):
    from tempograph.llm.decontamination import decontaminated

    item, other = "a passage of the benchmark that nobody should train on", "some further question with its own long answer"
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    rows = [(None, f"before {item} after", "bad", 0), (None, "plain words without an id", "ok", 0), (7, item, "bad", 1), (7, "the clean row of a repeated id", "ok", 1), (8, other, "bad", 2)]
    for size in (4_000_000, 60):
        left = decontaminated(spark.createDataFrame(rows, DOCS), bench, block_bytes=size).collect()
        assert sorted(r.text for r in left) == sorted(r[1] for r in rows if r[2] == "ok")


# 10


def brute_groups(texts, size=4, most=4):
    import xxhash

    prints = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= most:
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_simhash_groups_match_brute_force(spark, docs, empty):
    from tempograph.llm.simhash import near_groups

    r = random.Random(8)
    long = [f"w{i}" for i in range(400)]
    near = []
    for i in range(60):
        words = list(long)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(400)] = f"v{r.randrange(9)}"
        near.append((10_000 + i, " ".join(words)))
    rows = [(x.doc_id, x.text) for x in docs.collect()] + near + [(20_000, None), (20_001, ""), (20_002, "One two")]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    assert near_groups(empty).count() == 0


def test_code_words_of_near_fingerprints_meet():
    import numpy as np

    from tempograph.llm.simhash import fuzzy_keys, linked_in

    r = np.random.default_rng(0)
    fps = r.integers(0, 2**64, 500, dtype=np.uint64)
    for flips in range(5):
        other = fps.copy()
        for i in range(len(fps)):
            for b in r.choice(64, flips, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        a, b = (set(zip(*map(np.ndarray.tolist, fuzzy_keys(x)), strict=True)) for x in (fps, other))
        assert {i for i, _ in a & b} == set(range(500))
    assert len(linked_in(np.arange(16, dtype=np.uint64), 4)) == 15


def test_similar_groups_keep_one(spark, odd, empty):
    from tempograph.llm.simhash import similar_groups

    r = random.Random(2)
    base = [[f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(20)]
    rows = []
    for g, words in enumerate(base):
        for c in range(4):
            copy = list(words)
            if c:
                copy[r.randrange(100)] = f"x{r.randrange(10**6)}"
            rows.append((g * 4 + c, " ".join(copy), "e", g))
    kept = similar_groups(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(x.doc_id for x in kept.collect()) == [g * 4 for g in range(20)] and kept.columns == ["doc_id", "text", "extra", "group"]
    left = similar_groups(odd).collect()
    assert sorted(x.doc_id for x in left if x.doc_id is not None) == [1, 2, 7, 8, 9] and len(left) == 6
    assert similar_groups(empty).count() == 0


def one_of_each_copy(rows):
    """Least id of each group of texts that share 0.8 of their five-word shingles, by comparing all."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i for k, (i, _) in enumerate(rows) if find(k) == k}


def kept_copies(spark, rows):
    from tempograph.llm.simhash import similar_groups

    return {x.doc_id for x in similar_groups(spark.createDataFrame([(i, t, "e", 0) for i, t in rows], DOCS).repartition(3)).collect()}


def test_similar_groups_meet_edits_in_one_place(spark):
    r = random.Random(17)
    words = lambda n: [f"{r.choice('bdfgklmnprst')}{r.randrange(40_000)}" for _ in range(n)]
    rows = []
    for i in range(150):
        base, share = words(r.randint(120, 300)), r.uniform(0.8, 0.9)
        rows.append((2 * i, " ".join(base)))
        if i % 2:  # one paragraph at the end
            other = base + words(int(len(base) * (1 / share - 1)))
        else:  # one block replaced
            n = int(len(base) * (1 - share) / (1 + share))
            at = r.randrange(len(base) - n)
            other = base[:at] + words(n) + base[at + n :]
        rows.append((2 * i + 1, " ".join(other)))
    expected = one_of_each_copy(rows)
    assert len(expected) < 200
    assert kept_copies(spark, rows) == expected


def test_similar_groups_behind_a_shared_passage(spark):
    r = random.Random(23)
    words = lambda n: [f"{r.choice('bdfgklmnprst')}{r.randrange(40_000)}" for _ in range(n)]
    passage, rows = words(345), []
    for i in range(150):  # a passage that all share and a tail of two texts' own
        tail = words(55)
        rows.append((2 * i, " ".join(passage + tail)))
        rows.append((2 * i + 1, " ".join(passage[: 300 - 2 * (i % 9)] + words(20 + i % 9) + passage[330:] + tail)))
    expected = one_of_each_copy(rows)
    assert 100 < len(expected) < 200
    assert kept_copies(spark, rows) == expected


def test_similar_groups_of_copies_that_only_share_their_original(spark):
    """Sixty texts with twenty edited copies each: every copy is near its original and far from the other copies."""
    r = random.Random(31)
    rows, far = [], 0
    for g in range(60):
        base = [f"{r.choice('bdfgklmnprst')}{r.randrange(40_000)}" for _ in range(400)]
        made = [base]
        for _ in range(20):
            copy = list(base)
            for at in r.sample(range(400), 6):
                copy[at] = f"x{r.randrange(10**6)}"
            made.append(copy)
        r.shuffle(made)  # the original is anywhere among them
        rows += [(g * 21 + c, " ".join(words)) for c, words in enumerate(made)]
        sets = [{tuple(w[k : k + 5]) for k in range(396)} for w in made[:4]]
        far += sum(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert far > 200  # most pairs of copies are no link
    first = kept_copies(spark, rows)
    assert first == {g * 21 for g in range(60)}
    assert kept_copies(spark, rows[::-1]) == first  # the order of rows does not matter


def test_cells_hold_each_pair_once_and_few_copies_of_a_text(spark):
    from tempograph.llm.common import Scratch
    from tempograph.llm.simhash import CELL, celled

    small = {(100 * g + a, 100 * g + b) for g in range(5) for a in range(20) for b in range(a + 1, 20)}
    hub = {(10_000, 10_000 + k) for k in range(1, 1001)}
    made = celled(spark.createDataFrame(sorted(small | hub), "u long, v long"), Scratch(spark, "cells"), "stars").collect()
    assert sorted((x.u, x.v) for x in made) == sorted(small | hub)
    assert len({(x.cell, n) for x in made if x.u < 10_000 for n in (x.u, x.v)}) == 100  # once each, not once a pair
    cells = {x.cell for x in made if x.u == 10_000}
    assert len(cells) == 4 and all(sum(x.cell == c for x in made) < 12 * CELL for c in cells)


def test_few_links_are_contracted_without_rounds(spark, monkeypatch):
    from tempograph.llm import components
    from tempograph.llm.common import Scratch

    r = random.Random(3)
    pairs = [(r.randrange(300) - 50, r.randrange(300) - 50) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    scratch = Scratch(spark, "test-stars")
    by_rounds = {tuple(x) for x in components.star_components(edges, scratch, "rounds").collect()}
    saved = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *a, f=Scratch.save: saved.append(name) or f(self, df, name, *a))
    assert {tuple(x) for x in components.star_components(edges, scratch, "here", here=1000).collect()} == by_rounds and saved == ["here-0"]
    assert components.star_components(edges.filter("u > 5000"), scratch, "none", here=1000).count() == 0
    assert {tuple(x) for x in components.star_components(edges, scratch, "many", here=10).collect()} == by_rounds and "many-1" in saved


def test_ranges_leave_out_no_pair():
    import numpy as np

    from tempograph.llm.simhash import _blocks, may_be_alike, usable

    r = np.random.default_rng(1)
    for _ in range(100):
        rows = int(r.integers(1, 60))
        n = np.sort(r.integers(0, 60, rows)).astype(np.int32)
        place = np.minimum(r.integers(0, 12, rows), np.maximum(n - 1, 0)).astype(np.int32)
        want = np.triu(may_be_alike(n[:, None], place[:, None], n[None], place[None], 0.8), 1)
        got = {p for i, j in _blocks(n, place, 0.8, 50) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))
        assert not ((want.any(0) | want.any(1)) & ~usable(n, place, 0.8)).any()


def test_segmentation_lookups_are_searches(piece_model):
    import numpy as np

    from tempograph.llm.segmentation import Lattice, Pieces, _seen, _slot

    pieces = Pieces.load(piece_model, 0.2)
    slots = _slot(pieces.hashes)
    assert len(np.unique(slots)) < len(slots) and (pieces.find(pieces.hashes, slots) == np.arange(len(slots))).all()
    lattice = Lattice(["the", "internationalisation", "a", "", "naïve▁x"], pieces, _seen(pieces))
    place = np.repeat(np.arange(len(lattice.first) - 1), 50)
    u = np.random.default_rng(1).random(len(place))
    u[:3] = 0.0, 0.5, 1 - 2.0**-53
    want = np.minimum(np.searchsorted(lattice.keys, place + u, side="right"), lattice.first[place + 1] - 1)
    assert (lattice.edge(place, u) == want).all()
