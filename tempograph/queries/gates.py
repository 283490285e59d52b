"""Decisions, parsers and small formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import gates, parsing, scoring, text, udf
from tempograph.operators import resolve
from tempograph.sources.adapters import EPISODES_SQL, FACTS_SQL, NAMES_SQL, VECTORS_SQL, episodes, facts, names, raw, vectors, with_sql

from .batch import PAIRS, allpairs_cosine
from .scalar import DISC, ENTROPY, JAC, LONG, SH, norm, tok


def type_novelty(spark, sf):
    e = raw(spark, sf, "events")
    same = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 2 == 0)
    return e.select("event_id", gates.novelty_is_redundant(same, (F.col("event_id") % 100) / 100).alias("redundant"))


def prefilter_gate(spark, sf):
    return allpairs_cosine(spark, sf).filter(gates.prefilter(F.col("score"), 0.5)).groupBy("a").agg(F.count("*").alias("n"))


def intent_weights(spark, sf):
    t = raw(spark, sf, "conversations")
    return t.select("conv_id", "turn", F.round(gates.intent_weight(text.intent(F.col("text")), F.lit(0.5)), 6).alias("weight"))


def confidence_floors(spark, sf):
    p = allpairs_cosine(spark, sf)
    c = lambda x: F.when(F.col(x) % 6 != 0, (F.col(x) % 100) / 100)
    return p.select("a", "b", F.round(scoring.confidence_floor(c("a"), c("b")), 6).alias("floor"))


def score_floor(spark, sf):
    """Seeds at or over a floor; a floor of zero is none."""
    from .recall import vector_scores

    return vector_scores(spark, sf).filter(F.col("score") >= 0.1)


def normalize_labels(spark, sf):
    n = names(spark, sf)
    spaced = F.concat(F.lit("  "), F.regexp_replace("name", " ", "  "))
    return n.select("id", text.normalize_label(spaced).alias("label"), text.canonical_type(F.regexp_replace(F.lower("type_name"), " ", "_")).alias("type"))


def entropy_gates(spark, sf):
    return names(spark, sf).select("id", text.entropy_gate(F.col("name")).alias("passes"), text.entropy_gate(F.substring("name", 1, 7)).alias("short_passes"))


def neighbours(spark, sf):
    """Each part with the one before it in its brand."""
    return names(spark, sf).withColumn("other", F.lag("name").over(Window.partitionBy("group_id").orderBy("id"))).filter("other is not null")


def minhash_signatures(spark, sf):
    """Estimated likeness of neighbours, and one value of the signature."""
    n = neighbours(spark, sf)
    a, b = gates.minhash(F.col("name")), gates.minhash(F.col("other"))
    return n.select("id", a[0].alias("first"), F.round(gates.minhash_likeness(a, b), 6).alias("estimate"))


def deterministic_cascade(spark, sf):
    """Names against themselves in capitals, with one word more, and against another's: surely the same, or for a model."""
    n = neighbours(spark, sf)
    other = F.when(F.col("id") % 3 == 0, F.upper("name")).when(F.col("id") % 3 == 1, F.concat("name", F.lit("s"))).otherwise(F.col("other"))
    return n.select("id", F.coalesce(gates.surely_same(F.col("name"), other).cast("string"), F.lit("ask")).alias("verdict"))


def initialisms(spark, sf):
    """The first letters of each part's words, of fewer, and others, as short forms of it."""
    n = names(spark, sf).withColumn("w", F.split(F.col("name"), " "))
    letters = F.array_join(F.transform("w", lambda x: F.upper(F.substring(x, 1, 1))), "")
    short = F.when(F.col("id") % 3 == 0, letters).when(F.col("id") % 3 == 1, F.substring(letters, 1, 2)).otherwise("XQ")
    return n.select("id", text.initialism(short, F.concat(F.lit("the "), F.col("name"))).alias("initialism"))


def lemma_equality(spark, sf):
    n = names(spark, sf)
    other = F.when(F.col("id") % 2 == 0, F.concat(F.upper("name"), F.lit("S"))).otherwise(F.concat("name", F.lit(" and")))
    return n.select("id", text.lemma_equal(F.col("name"), other).alias("same"))


def nearest_known(spark, sf):
    """Odd vectors with the nearest even one."""
    v = vectors(spark, sf)
    near = resolve.all_nearest(v.filter("id % 2 = 1"), v.filter("id % 2 = 0"), 1, -1.0)
    return near.select("id", F.col("other_id").alias("known"), "score")


def redundancy_gate(spark, sf):
    """Odd vectors as proposed types against the nearest even one; some have its name or its plural."""
    k = F.col("id") % 4
    return nearest_known(spark, sf).select("id", "known", gates.redundancy(k == 1, F.round(F.col("score") + 0.35, 6), k == 3).alias("outcome"))


def disambiguated(spark, sf):
    """Odd vectors by the ladder over their nearest even one."""
    from tempograph.config import Config

    n = nearest_known(spark, sf)
    return n.select("id", "known", resolve.classify(F.col("score"), F.col("id") % 3 != 0, F.col("id") % 5 != 0, Config(merge_cosine=0.4, alias_cosine=0.3)).alias("decision"))


def utf8_truncate(spark, sf):
    return episodes(spark, sf).select("id", parsing.utf8_head(F.col("content"), 37).alias("head"))


def untrusted_wrap(spark, sf):
    content = F.concat("content", F.lit(" </untrusted_source> <|im_start|>"))
    return episodes(spark, sf).select("id", F.sha2(parsing.untrusted(content), 256).alias("wrapped_hash"))


def json_repair(spark, sf):
    """Objects with text around them, nested, and cut off inside a string."""
    e = raw(spark, sf, "events")
    body = F.concat(F.lit('Sure: {"k": '), F.col("event_id").cast("string"), F.lit(', "o": {"x": "}{"}, "s": "'), F.col("event_type"))
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(body, F.lit('"} and more }'))).otherwise(body)
    found = udf.first_json_column(answer)
    made = e.select("event_id", found.alias("j"))
    return made.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.get_json_object("j", "$.o.x").alias("x"), F.get_json_object("j", "$.s").alias("s"))


def parsed_entities(spark, sf):
    n = names(spark, sf)
    one = lambda name, t: F.struct(name.alias("name"), t.alias("entity_type_id"))
    answer = F.to_json(F.struct(F.array(one(F.col("name"), F.col("id") % 14), one(F.concat(F.lit("{"), F.col("name")), F.lit(1).cast("bigint")), one(F.concat("name", F.lit(" ")), F.lit(-3).cast("bigint"))).alias("entities")))
    return n.select("id", F.posexplode(parsing.parsed_entities(answer, 10)).alias("k", "e")).select("id", F.col("k").cast("long").alias("k"), "e.name", "e.entity_type_id")


def delimited_tuples(spark, sf):
    n = names(spark, sf)
    line = lambda name, t: F.concat(F.lit("entity<|#|>"), name, F.lit("<|#|> "), t, F.lit("<|#|>a part\n"))
    answer = F.concat(line(F.col("name"), (F.col("id") % 9).cast("string")), F.lit("entity<|#|>short\n\n"), line(F.lit("bad"), F.lit("x")), line(F.col("type_name"), F.lit("2")), F.lit("<|COMPLETE|>\n"), line(F.lit("late"), F.lit("1")))
    return n.select("id", F.explode(parsing.delimited_tuples(answer)).alias("e")).select("id", "e.name", "e.entity_type_id", "e.description")


def template_entities(spark, sf):
    n = names(spark, sf)
    answer = F.to_json(F.struct(F.array("name", "type_name").alias("Part"), F.array("group_id").alias("Brand")))
    return n.select("id", F.explode(parsing.template_entities(answer)).alias("e")).select("id", "e.name", "e.label")


def schema_violations(spark, sf):
    e = raw(spark, sf, "events")
    given = F.when(F.col("event_id") % 6 == 0, F.lit('{"kind": "a"}')).when(F.col("event_id") % 6 == 1, F.lit('{"k": "x", "kind": "a"}')).when(F.col("event_id") % 6 == 2, F.lit("{oops")).otherwise(F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}')))
    return e.select("event_id", F.coalesce(parsing.schema_violation(given, {"k": "integer", "kind": "string"}, {"kind": ("click", "view", "a")}), F.lit("ok")).alias("message"))


def chunk_ranges(spark, sf):
    """Facts of each namespace in tens."""
    order = Window.partitionBy("subject_id").orderBy("id")
    f = facts(spark, sf).withColumn("chunk", F.floor((F.row_number().over(order) - 1) / 10))
    return f.groupBy("subject_id", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def ordered_nominations(spark, sf):
    before = facts(spark, sf).withColumn("older", F.lag("valid_from").over(Window.partitionBy("subject_id").orderBy("id")))
    return before.select("id", gates.time_ordered(F.col("older"), F.col("valid_from")).alias("ordered"))


def proper_nouns(spark, sf):
    """Names in episodes by their capitals; a scan of each text."""
    return episodes(spark, sf).select("id", F.explode(udf.proper_noun_column(F.col("content"))).alias("name"))


def oov_words(spark, sf):
    """Words of four letters or more that fewer than three episodes have, the dictionary being what more have."""
    w = episodes(spark, sf).select("id", F.explode(F.array_distinct(F.filter(text.tokens(F.col("content")), lambda x: x.rlike(r"^\p{L}{4,}$")))).alias("word"))
    known = w.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3").select("word")
    return w.join(known, "word", "left_anti").groupBy("word").agg(F.min("id").alias("first_id"))


def merged_with_grounding(spark, sf):
    """A base and an additive list of names per turn, once each by normalised name, with whether the text has them."""
    t = raw(spark, sf, "conversations").withColumn("w", F.filter(F.split("text", " "), lambda x: F.length(x) > 3))
    given = F.concat(F.slice("w", 1, 4), F.transform(F.slice("w", 3, 4), lambda x: F.concat(x, F.lit("!"))), F.array(F.lit("Zebra")))
    e = t.select("conv_id", "turn", "text", F.explode(given).alias("name")).withColumn("norm", text.normalize_name(F.col("name"))).filter("norm <> ''")
    once = e.groupBy("conv_id", "turn", "text", "norm").agg(F.min("name").alias("name"))
    return once.select("conv_id", "turn", "norm", text.grounded(F.col("name"), text.tokens(F.col("text"))).alias("grounded"))


def hybrid_extraction(spark, sf):
    """Stage one brings half of a brand's part names, the audit the others not yet known, typing their type: one row each."""
    n = names(spark, sf).withColumn("norm", text.normalize_name(F.col("name")))
    first = n.filter("id % 2 = 0").groupBy("group_id", "norm").agg(F.min("id").alias("id")).withColumn("stage", F.lit("call"))
    audit = n.filter("id % 2 = 1").join(first.select("group_id", "norm"), ["group_id", "norm"], "left_anti").groupBy("group_id", "norm").agg(F.min("id").alias("id")).withColumn("stage", F.lit("audit"))
    both = first.unionByName(audit)
    return both.join(n.select("id", "type_name"), "id").select("id", "stage", F.col("type_name").alias("label"))


def consistency_inputs(spark, sf):
    """A subject's name with its three latest facts, as what is embedded."""
    latest = Window.partitionBy("subject_id").orderBy(F.col("recorded_at").desc(), F.col("id").desc())
    top = facts(spark, sf).withColumn("k", F.row_number().over(latest)).filter("k <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "predicate", "object_value").alias("fact")))), lambda x: x.fact)
    return top.groupBy("subject_id").agg(F.concat_ws(" | ", F.concat(F.array("subject_id"), listed)).alias("input"))


def rendered_context(spark, sf):
    """Subjects with their three latest facts as a prompt's text, with the namespace as there are several."""
    latest = Window.partitionBy("group_id", "subject_id").orderBy(F.col("recorded_at").desc(), F.col("id").desc())
    top = facts(spark, sf).withColumn("k", F.row_number().over(latest)).filter("k <= 3")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "subject_id", "predicate", "object_value").alias("fact")))), lambda x: F.concat(F.lit("- "), x.fact))
    block = F.concat(F.lit("[ns:"), F.col("group_id"), F.lit("] ## "), F.col("subject_id"), F.lit("\n"), F.lit("Entity"), F.lit("\n\nFacts:\n"), F.array_join(lines, "\n"))
    return top.groupBy("group_id", "subject_id").agg(block.alias("block"))


def ner_spans(spark, sf):
    """All runs of up to three words of each part's name."""
    return names(spark, sf).select("id", F.explode(parsing.word_spans(F.col("name"), 3)).alias("s")).select("id", F.col("s.first").cast("long").alias("first"), F.col("s.last").cast("long").alias("last"))


def ner_decoded(spark, sf):
    """Spans scored by a rule, the best taken first and none that meets one taken; a fold over each name's few spans."""
    s = names(spark, sf).select("id", parsing.word_spans(F.col("name"), 3).alias("spans"))
    scored = F.transform("spans", lambda x: F.struct((F.pmod(x.first * 7 + x.last * 3 + F.col("id"), F.lit(11)) / 10).alias("score"), x.first.alias("first"), x.last.alias("last")))
    return s.select("id", F.explode(parsing.spans_apart(scored)).alias("s")).select("id", F.col("s.first").cast("long").alias("first"), F.col("s.last").cast("long").alias("last"))


def stemmed_terms(spark, sf):
    """The commonest stems of names and turns."""
    t = raw(spark, sf, "conversations").select(udf.stemmed_tokens(F.col("text")).alias("w"))
    return t.select(F.explode("w").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


def embedding_chunks(spark, sf):
    """Pieces of episodes for embedding, of at most 500 characters; together they are the text."""
    c = udf.chunked(episodes(spark, sf), 500)
    return c.select("id", "chunk", F.length("body").alias("n"), F.sha2("body", 256).alias("body_hash"))


def prefixed_texts(spark, sf):
    return raw(spark, sf, "conversations").select("conv_id", "turn", F.sha2(parsing.prefixed(F.col("text"), True), 256).alias("query_hash"), F.sha2(parsing.prefixed(F.col("text"), False), 256).alias("document_hash"))


def search_expressions(spark, sf):
    return names(spark, sf).select("id", parsing.search_expression(F.concat(F.col("name"), F.lit(' "x-1" * '))).alias("expression"))


def hash_embeddings(spark, sf):
    """Vectors of a deterministic embedder for names that have none; lengths are one."""
    n = names(spark, sf).select("id", F.col("name").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    made = udf.backfill(n, udf.hash_embedder(16))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("id", F.size("embedding").cast("long").alias("dim"), F.round(squares, 3).alias("square"))


def resolved_pairs(spark, sf):
    """Neighbours judged by a caller's function, asked in windows of at most 32."""
    same = udf.resolve_column(lambda pairs: ["same" if a.split()[0] == b.split()[0] else "different" for a, b in pairs])
    return neighbours(spark, sf).select("id", same("name", "other").alias("verdict"))


def structured_answers(spark, sf):
    """What each way of asking gives, down the ladder, for a provider that fails in some; as rows of a caller's function."""

    def provider(way, body):
        k = int(body)
        if way == "schema" and k % 4:
            raise ValueError("no schema support")
        if way == "json" and k % 4 != 1:
            return "I cannot"
        if way == "prompt" and k % 4 != 2:
            return "no object here"
        return f"entity<|#|>n{k}<|#|>{k % 5}<|#|>d\n<|COMPLETE|>" if way == "tuples" else f'well: {{"entities": [{{"name": "n{k}", "entity_type_id": {k % 5}}}]}}'

    n = names(spark, sf).select("id", F.col("id").cast("string").alias("content"))
    rows = udf.extract(n, lambda body: [dict(zip(("way", "answer"), udf.structured_call(provider, body), strict=True))], "way string, answer string")
    return rows.select(F.col("source_key").alias("id"), "way", F.get_json_object("answer", "$.entities[0].name").alias("name"))


def replayed_answers(spark, sf):
    """Requests, some made twice, answered from a cassette by hash and call."""
    t = raw(spark, sf, "part")
    k = (F.col("p_partkey") / 2).cast("long")
    requests = t.select(F.col("p_partkey").alias("id"), F.sha2(k.cast("string"), 256).alias("request_hash"), (F.col("p_partkey") % 2).alias("call_index"))
    cassette = t.filter("p_partkey % 3 <> 0").select(F.sha2(k.cast("string"), 256).alias("request_hash"), (F.col("p_partkey") % 2).alias("call_index"), F.concat(F.lit("answer "), F.col("p_partkey").cast("string")).alias("answer"))
    return udf.replayed(requests, cassette).select("id", "answer")


ARMS = ["A1", "B2"]
SIG = "list_transform(range(0, 32), lambda i: list_min(list_transform({0}, lambda h: (((16807 * (i + 1) * (i + 1) + 48271) % 2147483647) * h + 69621 * (i + 1)) % 2147483647)))"
HASHED = "list_transform({0}, lambda s: CAST('0x' || substring(md5(s), 1, 7) AS BIGINT))"
EST = "len(list_filter(range(1, 33), lambda i: {0}[i] = {1}[i])) / 32.0::DOUBLE"
NEXT = "nb AS (SELECT *, lag(name) OVER (PARTITION BY group_id ORDER BY id) AS other FROM names)"
GATE = "length({0}) >= 6 AND len({1}) >= 2 AND {2} >= 1.5"
NEAREST = "px AS (SELECT CASE WHEN a % 2 = 1 THEN a ELSE b END AS id, CASE WHEN a % 2 = 1 THEN b ELSE a END AS known, score FROM p WHERE (a + b) % 2 = 1 AND score > -1), nk AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, known) = 1)"
EMPTY = "CAST([] AS VARCHAR[])"


def gate(c: str) -> str:
    n = norm(c)
    return GATE.format(n, tok(n), ENTROPY.format(n))


QUERIES = {
    "type_novelty": (type_novelty, "SELECT event_id, event_id % 5 <> 0 AND event_id % 2 = 0 AND (event_id % 100) / 100.0 >= 0.7 AS redundant FROM events"),
    "prefilter_gate": (prefilter_gate, with_sql(VECTORS_SQL, PAIRS, body="SELECT a, count(*) AS n FROM pairs WHERE score < 0.5 GROUP BY a")),
    "intent_weights": (intent_weights, "SELECT conv_id, turn, 0.5::DOUBLE AS weight FROM conversations"),
    "confidence_floors": (confidence_floors, with_sql(VECTORS_SQL, PAIRS, body="SELECT a, b, CASE WHEN a % 6 <> 0 AND b % 6 <> 0 THEN round(least((a % 100) / 100.0::DOUBLE, (b % 100) / 100.0::DOUBLE), 6) END AS floor FROM pairs")),
    "score_floor": (score_floor, with_sql(VECTORS_SQL, "s AS (SELECT id, round(list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE id = 0)), 6) AS score FROM vectors)", body="SELECT id, score FROM s WHERE score >= 0.1")),
    "normalize_labels": (normalize_labels, with_sql(NAMES_SQL, body="SELECT id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS label, array_to_string(list_transform(string_split(lower(type_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS type FROM names")),
    "entropy_gates": (entropy_gates, with_sql(NAMES_SQL, "n AS (SELECT id, name, substring(name, 1, 7) AS short FROM names)", body=f"SELECT id, {gate('name')} AS passes, {gate('short')} AS short_passes FROM n")),
    "minhash_signatures": (minhash_signatures, with_sql(NAMES_SQL, NEXT, f"h AS (SELECT id, {HASHED.format(SH.format('name'))} AS x, {HASHED.format(SH.format('other'))} AS y FROM nb WHERE other IS NOT NULL)", f"s AS (SELECT id, {SIG.format('x')} AS a, {SIG.format('y')} AS b FROM h)", body=f"SELECT id, a[1] AS first, round({EST.format('a', 'b')}, 6) AS estimate FROM s")),
    "deterministic_cascade": (deterministic_cascade, with_sql(NAMES_SQL, NEXT, f"o AS (SELECT id, {norm('name')} AS na, CASE id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN name || 's' ELSE other END AS ob FROM nb WHERE other IS NOT NULL)", f"q AS (SELECT id, na, {norm('ob')} AS nb_ FROM o)", f"h AS (SELECT *, {HASHED.format(SH.format('na'))} AS x, {HASHED.format(SH.format('nb_'))} AS y FROM q)", f"s AS (SELECT *, {SIG.format('x')} AS a, {SIG.format('y')} AS b FROM h)", body=f"SELECT id, CASE WHEN na = nb_ OR ({GATE.format('na', tok('na'), ENTROPY.format('na'))} AND {GATE.format('nb_', tok('nb_'), ENTROPY.format('nb_'))} AND {EST.format('a', 'b')} >= 0.9) THEN 'true' ELSE 'ask' END AS verdict FROM s")),
    "initialisms": (initialisms, with_sql(NAMES_SQL, f"w AS (SELECT id, list_filter({tok('name')}, lambda x: x NOT IN ('of', 'and', 'the', 'for')) AS w, string_split(name, ' ') AS raw FROM names)", "l AS (SELECT id, w, array_to_string(list_transform(raw, lambda x: upper(x[1])), '') AS letters FROM w)", "s AS (SELECT id, w, regexp_replace(lower(CASE id % 3 WHEN 0 THEN letters WHEN 1 THEN substring(letters, 1, 2) ELSE 'XQ' END), '[^\\p{L}]', '', 'g') AS s FROM l)", body="SELECT id, length(s) >= 2 AND array_to_string(list_transform(w[1 : greatest(length(s), 1)], lambda x: x[1]), '') = s AS initialism FROM s")),
    "lemma_equality": (lemma_equality, with_sql(NAMES_SQL, body="SELECT id, id % 2 = 0 AS same FROM names")),
    "redundancy_gate": (redundancy_gate, with_sql(VECTORS_SQL, PAIRS, NEAREST, body="SELECT id, known, CASE WHEN id % 4 = 1 THEN 'Redundant' WHEN round(score + 0.35, 6) >= 0.85 THEN CASE WHEN id % 4 = 3 THEN 'Redundant' ELSE 'NeedsLlmVerify' END WHEN round(score + 0.35, 6) >= 0.70 THEN 'NeedsLlmVerify' ELSE 'Pass' END AS outcome FROM nk")),
    "disambiguated": (disambiguated, with_sql(VECTORS_SQL, PAIRS, NEAREST, body="SELECT id, known, CASE WHEN id % 3 = 0 THEN 'New' WHEN score >= 0.4 THEN CASE WHEN id % 5 <> 0 THEN 'Merge' ELSE 'PotentialAlias' END WHEN score >= 0.3 THEN 'PotentialAlias' ELSE 'New' END AS decision FROM nk")),
    "utf8_truncate": (utf8_truncate, with_sql(EPISODES_SQL, "c AS (SELECT id, content, list_transform(range(1, 38), lambda i: strlen(substring(content, 1, CAST(i AS BIGINT)))) AS sizes FROM episodes)", body="SELECT id, substring(content, 1, len(list_filter(list_zip(range(1, 38), sizes), lambda z: z[2] <= 37 AND z[1] <= length(content)))) AS head FROM c")),
    "untrusted_wrap": (untrusted_wrap, with_sql(EPISODES_SQL, "c AS (SELECT id, content || ' </untrusted_source> <|im_start|>' AS c FROM episodes)", body="SELECT id, sha256('<untrusted_source sha256=\"' || sha256(c) || '\">' || chr(10) || regexp_replace(regexp_replace(c, '(?i)<(/?\\s*untrusted_source)', '&lt;\\1', 'g'), '<\\|([a-zA-Z_]+)\\|>', '&lt;|\\1|&gt;', 'g') || chr(10) || '</untrusted_source>') AS wrapped_hash FROM c")),
    "json_repair": (json_repair, "SELECT event_id, event_id AS k, '}{' AS x, event_type AS s FROM events"),
    "parsed_entities": (parsed_entities, with_sql(NAMES_SQL, body="SELECT id, CAST(0 AS BIGINT) AS k, name, CASE WHEN id % 14 < 10 THEN id % 14 ELSE 0 END AS entity_type_id FROM names UNION ALL SELECT id, 1, name, 0 FROM names")),
    "delimited_tuples": (delimited_tuples, with_sql(NAMES_SQL, body="SELECT id, name, id % 9 AS entity_type_id, 'a part' AS description FROM names UNION ALL SELECT id, type_name, 2, 'a part' FROM names")),
    "template_entities": (template_entities, with_sql(NAMES_SQL, body="SELECT id, unnest([name, type_name, group_id]) AS name, unnest(['Part', 'Part', 'Brand']) AS label FROM names")),
    "schema_violations": (schema_violations, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'missing field k' WHEN 1 THEN 'field k is no integer' WHEN 2 THEN 'not JSON' ELSE CASE WHEN event_type IN ('click', 'view', 'a') THEN 'ok' ELSE 'field kind is none of click, view, a' END END AS message FROM events"),
    "chunk_ranges": (chunk_ranges, with_sql(FACTS_SQL, "c AS (SELECT id, subject_id, (row_number() OVER (PARTITION BY subject_id ORDER BY id) - 1) // 10 AS chunk FROM facts)", body="SELECT subject_id, chunk, count(*) AS n, min(id) AS first_id FROM c GROUP BY 1, 2")),
    "ordered_nominations": (ordered_nominations, with_sql(FACTS_SQL, body="SELECT id, coalesce(valid_from > lag(valid_from) OVER (PARTITION BY subject_id ORDER BY id), false) AS ordered FROM facts")),
    "proper_nouns": (proper_nouns, None),
    "oov_words": (oov_words, with_sql(EPISODES_SQL, f"w AS (SELECT id, unnest(list_distinct(list_filter({tok('content')}, lambda x: regexp_matches(x, '^\\p{{L}}{{4,}}$')))) AS word FROM episodes)", body="SELECT word, min(id) AS first_id FROM w GROUP BY word HAVING count(*) < 3")),
    "merged_with_grounding": (merged_with_grounding, with_sql("t AS (SELECT conv_id, turn, text, list_filter(string_split(text, ' '), lambda x: length(x) > 3) AS w FROM conversations)", "g AS (SELECT conv_id, turn, text, unnest(list_concat(list_concat(w[1:4], list_transform(w[3:6], lambda x: x || '!')), ['Zebra'])) AS name FROM t)", f"n AS (SELECT conv_id, turn, text, {norm('name')} AS norm, min(name) AS name FROM g GROUP BY conv_id, turn, text, {norm('name')})", f"k AS (SELECT *, {tok('name')} AS nt, {tok('text')} AS tt FROM n WHERE norm <> '')", body="SELECT conv_id, turn, norm, len(nt) > 0 AND list_contains(tt, nt[len(nt)]) AS grounded FROM k")),
    "hybrid_extraction": (hybrid_extraction, with_sql(NAMES_SQL, f"n AS (SELECT *, {norm('name')} AS norm FROM names)", "f AS (SELECT group_id, norm, min(id) AS id FROM n WHERE id % 2 = 0 GROUP BY 1, 2)", "a AS (SELECT group_id, norm, min(id) AS id FROM n WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.group_id = n.group_id AND f.norm = n.norm) GROUP BY 1, 2)", body="SELECT n.id, s.stage, type_name AS label FROM (SELECT id, 'call' AS stage FROM f UNION ALL SELECT id, 'audit' FROM a) s JOIN n ON n.id = s.id")),
    "consistency_inputs": (consistency_inputs, with_sql(FACTS_SQL, "k AS (SELECT subject_id, predicate || ' ' || object_value AS f, row_number() OVER (PARTITION BY subject_id ORDER BY recorded_at DESC, id DESC) AS k FROM facts)", body="SELECT subject_id, subject_id || ' | ' || string_agg(f, ' | ' ORDER BY k) AS input FROM k WHERE k <= 3 GROUP BY subject_id")),
    "rendered_context": (rendered_context, with_sql(FACTS_SQL, "k AS (SELECT group_id, subject_id, subject_id || ' ' || predicate || ' ' || object_value AS f, row_number() OVER (PARTITION BY group_id, subject_id ORDER BY recorded_at DESC, id DESC) AS k FROM facts)", body="SELECT group_id, subject_id, '[ns:' || group_id || '] ## ' || subject_id || chr(10) || 'Entity' || chr(10) || chr(10) || 'Facts:' || chr(10) || string_agg('- ' || f, chr(10) ORDER BY k) AS block FROM k WHERE k <= 3 GROUP BY 1, 2")),
    "ner_spans": (ner_spans, with_sql(NAMES_SQL, "n AS (SELECT id, len(string_split(name, ' ')) AS n FROM names)", "f AS (SELECT id, n, unnest(range(0, n)) AS first FROM n)", body="SELECT id, first, unnest(range(first, least(first + 3, n))) AS last FROM f")),
    "ner_decoded": (ner_decoded, None),
    "stemmed_terms": (stemmed_terms, None),
    "embedding_chunks": (embedding_chunks, None),
    "prefixed_texts": (prefixed_texts, "SELECT conv_id, turn, sha256('search_query: ' || text) AS query_hash, sha256('search_document: ' || text) AS document_hash FROM conversations"),
    "search_expressions": (search_expressions, with_sql(NAMES_SQL, f"x AS (SELECT id, {tok('name')} AS w FROM names)", body="SELECT id, array_to_string(list_transform(list_append(w, 'x1'), lambda t: '\"' || t || '\"'), ' AND ') AS expression FROM x")),
    "hash_embeddings": (hash_embeddings, None),
    "resolved_pairs": (resolved_pairs, with_sql(NAMES_SQL, NEXT, body="SELECT id, CASE WHEN string_split(name, ' ')[1] = string_split(other, ' ')[1] THEN 'same' ELSE 'different' END AS verdict FROM nb WHERE other IS NOT NULL")),
    "structured_answers": (structured_answers, with_sql(NAMES_SQL, body="SELECT id, CASE id % 4 WHEN 0 THEN 'schema' WHEN 1 THEN 'json' WHEN 2 THEN 'prompt' ELSE 'tuples' END AS way, 'n' || id AS name FROM names")),
    "replayed_answers": (replayed_answers, "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'answer ' || p_partkey END AS answer FROM part"),
}
