"""Queries over results, retrieval, hierarchy and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors as vx
from graphloom.operators import evaluate, graph, incremental, merge, retrieval, tfidf
from graphloom.operators.hierarchy import id_key
from graphloom.plans.graphs import DEG, MENT
from graphloom.plans.registry import query
from graphloom.session import table

RANKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY coalesce(score, -1e9) DESC, id) AS pos FROM
  (SELECT query_id, kind, id, max(score) AS score, min(rank) AS rank FROM retrieval WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2, 3))"""
TOK = "len(list_filter(string_split_regex(coalesce({}, ''), '[ \\t\\r\\n]+'), lambda t: t <> ''))"
STRIP = "regexp_replace({}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"
NORM = "array_to_string(list_filter(string_split_regex(regexp_replace(lower(coalesce({}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '[ \\t\\r\\n]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
GOLD = f"gold AS (SELECT DISTINCT id, {NORM.format('output')} AS p, {NORM.format('g')} AS g FROM (SELECT id, output, unnest(string_split(coalesce(answer, ''), '|')) AS g FROM results))"
BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160) || chr(8203) || chr(65279)"
KEY = f"nullif(lower(trim({{}}, {BLANKS})), '')"
WORDS = "list_filter(string_split({}, ' '), lambda w: w <> '')"
COMMON = "list_sum(list_transform(list_intersect(list_distinct(pw), list_distinct(gw)), lambda w: least(len(list_filter(pw, lambda x: x = w)), len(list_filter(gw, lambda x: x = w)))))"


def _t(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


@query(f"SELECT DISTINCT id, {NORM.format('output')} AS normal FROM results")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "results").select("id", tx.normal_answer(F.col("output")).alias("normal")).distinct()


@query(f"WITH {GOLD} SELECT id, max(CAST(p = g AS INTEGER)) AS em, max(CAST(g <> '' AND contains(p, g) AS INTEGER)) AS accuracy FROM gold GROUP BY id")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.match(table(spark, sf_dir, "results")).groupBy("id").agg(F.max("em").alias("em"), F.max("accuracy").alias("accuracy"))


_F1 = f"""{GOLD}, w AS (SELECT *, {WORDS.format("p")} AS pw, {WORDS.format("g")} AS gw FROM gold),
  c AS (SELECT id, len(pw) AS np, len(gw) AS ng, CASE WHEN (p IN ('yes','no','noanswer') OR g IN ('yes','no','noanswer')) AND p <> g THEN 0 ELSE coalesce({COMMON}, 0) END AS k FROM w),
  s AS (SELECT id, coalesce(k / nullif(np, 0), 0.0) AS precision, coalesce(k / nullif(ng, 0), 0.0) AS recall FROM c),
  f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM s),
  b AS (SELECT id, f1, precision, recall FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY f1 DESC, precision DESC, recall DESC) = 1)"""


@query(f"WITH {_F1} SELECT id, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM b")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_f1(table(spark, sf_dir, "results"))


@query(
    f"""WITH {GOLD}, w AS (SELECT *, {WORDS.format("p")} AS pw, {WORDS.format("g")} AS gw FROM gold),
    c AS (SELECT id, len(pw) AS c, len(gw) AS r, coalesce(list_sum(list_transform(list_distinct(pw), lambda w: least(len(list_filter(pw, lambda x: x = w)), len(list_filter(gw, lambda x: x = w))))), 0) AS hit FROM w)
    SELECT id, round(max(CASE WHEN c = 0 THEN 0.0 ELSE CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / c) END * hit / c END), 2) AS bleu1 FROM c GROUP BY id"""
)
def bleu1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bleu1(table(spark, sf_dir, "results"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rouge_l(table(spark, sf_dir, "results"))


@query(
    """SELECT id, chosen, CAST(chosen = coalesce(answer_idx, '-') AS INTEGER) AS correct FROM (SELECT DISTINCT id, answer_idx, coalesce(nullif(upper(regexp_extract(coalesce(output, ''), '^\\s*\\(?([A-D])\\)?[.:)]?\\s*$', 1)), ''),
    nullif(upper(regexp_extract(coalesce(output, ''), '(?i)(?:answer|option)(?: is)?:?\\s*\\(?([A-D])\\b', 1)), ''), nullif(upper(regexp_extract(coalesce(output, ''), '^\\s*\\(?([A-D])[).:]\\s', 1)), ''), '') AS chosen FROM results WHERE options IS NOT NULL)"""
)
def option_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.chosen_option(table(spark, sf_dir, "results"))


@query(
    f"""WITH {_F1}, m AS (SELECT 'f1' AS metric, round(f1, 6) AS v FROM b UNION ALL SELECT 'precision', round(precision, 6) FROM b UNION ALL SELECT 'recall', round(recall, 6) FROM b)
    SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max, round(median(v), 6) AS median, count(v) AS n FROM m GROUP BY 1"""
)
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(evaluate.token_f1(table(spark, sf_dir, "results")), ["f1", "precision", "recall"])


@query(f"WITH {GOLD} SELECT DISTINCT id, max(CAST(len(list_filter({WORDS.format('g')}, lambda w: contains(p, w))) > 0 AS INTEGER)) OVER (PARTITION BY id) AS any_word FROM gold")
def word_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "results").select("id", tx.normal_answer(F.col("output")).alias("p"), F.explode(evaluate.golds(F.col("answer"))).alias("g"))
    hit = F.exists(evaluate.answer_words(F.col("g")), lambda w: F.contains(F.col("p"), w))
    return rows.groupBy("id").agg(F.max(hit.cast("int")).alias("any_word"))


@query(f"WITH {RANKED}, {DEG} SELECT query_id, id, pos, coalesce(degree, 0) AS degree FROM rk LEFT JOIN deg ON node = id WHERE kind = 'entity'")
def entity_vdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval")).filter("kind = 'entity'")
    degree = graph.node_degree(table(spark, sf_dir, "edges")).withColumnRenamed("node", "id")
    return rows.join(degree, "id", "left").select("query_id", "id", "pos", F.coalesce("degree", F.lit(0)).alias("degree"))


@query(
    f"""WITH {RANKED}, pool AS (SELECT * FROM rk WHERE (kind = 'entity' AND pos <= 25) OR (kind <> 'entity' AND pos <= 5)), q AS (SELECT * FROM pool WHERE kind <> 'community' OR pos <= 1),
    mixed AS (SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, -1e9) DESC, kind, id) AS place FROM q WHERE kind IN ('chunk', 'community'))
    SELECT * FROM (SELECT * FROM mixed UNION ALL SELECT query_id, kind, id, pos FROM q WHERE kind = 'entity') WHERE place <= 5"""
)
def hier_flat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hierarchical_flat_search(table(spark, sf_dir, "retrieval"), 5)


RELATIONS = f"""{DEG}, ed AS (SELECT p.src, p.dst, coalesce(a.degree, 0) + coalesce(b.degree, 0) AS degree FROM (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL) p LEFT JOIN deg a ON a.node = p.src LEFT JOIN deg b ON b.node = p.dst),
    x AS (SELECT src, dst, max(coalesce(weight, 0)) AS weight, min(CASE WHEN names <> '' THEN names ELSE {STRIP.format("concat_ws(' ', words, src, dst, description)")} END) AS text FROM (SELECT *, array_to_string(list_filter(coalesce(relation_names, []), lambda x: x <> ''), ', ') AS names, array_to_string(coalesce(keywords, []), ', ') AS words FROM edges) GROUP BY 1, 2),
    s AS (SELECT DISTINCT query_id, id AS node FROM retrieval WHERE kind = 'entity' AND query_id IS NOT NULL),
    r AS (SELECT DISTINCT query_id, src, dst, weight, degree, {TOK.format("text")} AS tokens FROM s JOIN x ON s.node = x.src OR s.node = x.dst JOIN ed USING (src, dst)),
    o AS (SELECT *, sum(tokens) OVER w AS used, row_number() OVER w AS place FROM r WINDOW w AS (PARTITION BY query_id ORDER BY degree DESC, weight DESC, src, dst ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {RELATIONS} SELECT query_id, src, dst, place FROM o WHERE used <= 60")
def relations_from_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges")
    return retrieval.relations_of_seeds(table(spark, sf_dir, "retrieval"), edges, graph.edge_degree(edges), merge.edge_text(edges), 60)


@query(f"WITH {RANKED}, {MENT} SELECT query_id, chunk, min(pos) AS first_pos, count(*) AS n_seeds FROM rk JOIN ment ON ment.entity = rk.id WHERE kind = 'entity' GROUP BY 1, 2")
def chunks_entity_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks_of_seeds(table(spark, sf_dir, "retrieval"), merge.entity_chunks(table(spark, sf_dir, "nodes")))


@query(
    f"""WITH {RANKED}, c AS (SELECT 'CHUNK_' || chunk_id AS id, min({TOK.format("content")}) AS tokens FROM chunks GROUP BY 1),
    o AS (SELECT query_id, rk.id, pos, sum(tokens) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM rk JOIN c ON c.id = rk.id WHERE kind = 'chunk')
    SELECT query_id, id, pos, CAST(used AS BIGINT) AS used FROM o WHERE used <= 400"""
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "chunks").groupBy(F.concat(F.lit("CHUNK_"), "chunk_id").alias("id")).agg(F.min(tx.token_count(F.col("content"))).alias("tokens"))
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval")).filter("kind = 'chunk'").join(sizes, "id")
    return retrieval.budget_prefix(rows, 400, ["query_id"], [F.col("pos")], F.col("tokens")).select("query_id", "id", "pos", "used")


@query(f"""WITH {RANKED} SELECT query_id, kind, count(*) AS n, md5(string_agg(pos || ',' || chr(9) || '"' || id || '"', chr(10) ORDER BY pos)) AS csv FROM rk GROUP BY 1, 2""")
def csv_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval")).withColumn("line", F.concat(F.col("pos").cast("string"), F.lit(',\t"'), "id", F.lit('"')))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"])
    return rows.groupBy("query_id", "kind").agg(F.count("*").alias("n"), F.md5(F.array_join(lines, "\n")).alias("csv"))


@query(
    f"""WITH {RANKED}, u AS (SELECT query_id, id, min(sec * 1000000 + pos) AS first FROM (SELECT query_id, id, pos, 1 AS sec FROM rk WHERE kind = 'entity' UNION ALL SELECT query_id, id, pos, 2 FROM rk) GROUP BY 1, 2)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY first, id) AS place FROM u"""
)
def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked sections as one: first occurrences, numbered anew."""
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval"))
    both = rows.filter("kind = 'entity'").select("query_id", "id", (F.lit(1000000) + F.col("pos")).alias("at")).unionByName(rows.select("query_id", "id", (F.lit(2000000) + F.col("pos")).alias("at")))
    first = both.groupBy("query_id", "id").agg(F.min("at").alias("first"))
    return first.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "id")).alias("place"))


@query(
    f"""WITH {RANKED}, k AS (SELECT * FROM rk WHERE pos <= 10) SELECT query_id, kind, id, round(avg(11 - pos) OVER (PARTITION BY query_id, kind, score), 6) AS prize FROM k"""
)
def pcst_prizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.steiner_prizes(table(spark, sf_dir, "retrieval"), 10)


@query(f"WITH {RANKED} SELECT query_id, kind, id, round(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0), 6) AS scaled FROM rk WINDOW w AS (PARTITION BY query_id, kind)")
def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("query_id", "kind")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.coalesce(F.try_divide(F.col("score") - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))
    return retrieval.ranked(table(spark, sf_dir, "retrieval")).select("query_id", "kind", "id", F.round(scaled, 6).alias("scaled"))


@query(
    f"""WITH {RANKED} SELECT query_id, kind, id, round(least(1, greatest(0, CASE WHEN score >= 0 THEN tanh(score) ELSE 1 / (1 + exp(-score)) END)), 6) AS by_product,
    round(least(1, greatest(0, exp(-score))), 6) AS by_distance FROM rk WHERE score IS NOT NULL"""
)
def typed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval")).filter("score is not null")
    return rows.select("query_id", "kind", "id", F.round(vx.similarity_from_product(F.col("score")), 6).alias("by_product"), F.round(vx.similarity_from_distance(F.col("score")), 6).alias("by_distance"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 5"""
)
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.exact_knn(vectors, vectors.filter("vec_id % 50 = 0"), 5, "vec_id", "embedding")
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT range(0, 16) AS planes), s AS (SELECT list_transform(range(0, 1024), lambda i: CASE WHEN (i * 7919 + (i * i) % 104729) % 1000 < 500 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS signs)
    SELECT vec_id, CAST(list_sum(list_transform(planes, lambda k: CASE WHEN list_dot_product(e, signs[k * 64 + 1 : k * 64 + 64]) > 0 THEN 1 << (15 - k) ELSE 0 END)) AS BIGINT) AS signature FROM v, p, s WHERE len(e) = 64"""
)
def lsh_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("size(embedding) = 64").withColumn("signs", vx.plane_signs(16, 64))
    return rows.select("vec_id", vx.signature(F.col("embedding"), 16, 64, F.col("signs")).alias("signature"))


@query()
def lsh_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pack_buckets(lsh_signature(spark, sf_dir).withColumnRenamed("signature", "bucket"), 5, 50)


@query(
    """WITH c AS (SELECT DISTINCT id, text FROM (SELECT chunk_id AS id, content AS text FROM chunks) WHERE id IS NOT NULL), q AS (SELECT DISTINCT id, question AS text FROM results),
    tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM c) GROUP BY 1, 2),
    idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT id) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    qt AS (SELECT id, term, count(*) * any_value(idf) AS w FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM q) JOIN idf USING (term) GROUP BY 1, 2),
    d AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)), dl AS (SELECT id, sqrt(sum(w * w)) AS l FROM d GROUP BY 1), ql AS (SELECT id, sqrt(sum(w * w)) AS l FROM qt GROUP BY 1),
    h AS (SELECT qt.id AS query, d.id, sum(qt.w * d.w) AS p FROM qt JOIN d USING (term) GROUP BY 1, 2), s AS (SELECT query, h.id, round(p / (dl.l * ql.l), 6) AS score FROM h JOIN dl ON dl.id = h.id JOIN ql ON ql.id = query)
    SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3"""
)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "chunks").filter("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.col("content").alias("text")).repartition("id").distinct()
    questions = table(spark, sf_dir, "results").select("id", F.col("question").alias("text")).distinct()
    return tfidf.tfidf_topk(corpus, questions, 3)


_COMM = f"""mem AS (SELECT DISTINCT community_id, level, {KEY.format("m")} AS member FROM (SELECT community_id, level, unnest(members) AS m FROM communities)), sizes AS (SELECT community_id, max(level) AS level, count(member) AS n FROM mem WHERE member IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_COMM} SELECT coalesce(level, -1) AS level, count(*) AS communities, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS members, grouping(level) AS overall FROM sizes GROUP BY ROLLUP (level)")
def hierarchy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return sizes.rollup("level").agg(
        F.count("*").alias("communities"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.sum("n").alias("members"), F.grouping("level").cast("bigint").alias("overall")
    ).withColumn("level", F.coalesce("level", F.lit(-1)))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "communities").select("community_id", "level", F.explode("members").alias("m"))
    return rows.select("community_id", "level", id_key(F.col("m")).alias("member")).filter("member is not null").distinct()


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).groupBy("community_id").agg(F.max("level").alias("level"), F.count("member").alias("n"))


@query(
    f"""WITH {_COMM}, occ AS (SELECT community_id, max(occurrence) AS o FROM communities GROUP BY 1), ent AS (SELECT community_id, count(DISTINCT member) AS n_entities FROM mem WHERE member LIKE 'ent-%' GROUP BY 1),
    inc AS (SELECT m.community_id, count(DISTINCT e.src || '->' || e.dst) AS n_edges FROM mem m JOIN edges e ON lower(e.src) = m.member OR lower(e.dst) = m.member WHERE m.member LIKE 'ent-%' GROUP BY 1)
    SELECT s.community_id, coalesce(s.level, -1) AS level, s.n AS n_members, coalesce(n_entities, 0) AS n_entities, coalesce(n_edges, 0) AS n_edges, o AS occurrence FROM sizes s LEFT JOIN occ USING (community_id) LEFT JOIN ent USING (community_id) LEFT JOIN inc USING (community_id)"""
)
def community_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    entities = members.filter("member like 'ent-%'").select("community_id", "member").distinct()
    ends = table(spark, sf_dir, "edges").select("src", "dst").distinct().select(F.concat_ws("->", "src", "dst").alias("edge"), F.explode(F.array(F.lower("src"), F.lower("dst"))).alias("member"))
    incident = entities.join(ends, "member").groupBy("community_id").agg(F.countDistinct("edge").alias("n_edges"))
    occurrence = table(spark, sf_dir, "communities").groupBy("community_id").agg(F.max("occurrence").alias("occurrence"))
    counts = entities.groupBy("community_id").agg(F.count("*").alias("n_entities"))
    joined = _sizes(spark, sf_dir).join(counts, "community_id", "left").join(incident, "community_id", "left").join(occurrence, "community_id", "left")
    return joined.select("community_id", F.coalesce("level", F.lit(-1)).alias("level"), F.col("n").alias("n_members"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "occurrence")


@query(
    f"""WITH {_COMM}, occ AS (SELECT community_id, max(occurrence) AS o FROM communities GROUP BY 1), s AS (SELECT DISTINCT query_id, lower(id) AS member FROM retrieval WHERE kind = 'entity' AND query_id IS NOT NULL),
    c AS (SELECT query_id, m.community_id, count(DISTINCT m.member) AS hits FROM s JOIN mem m USING (member) WHERE m.level <= 4 GROUP BY 1, 2)
    SELECT query_id, community_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, coalesce(o, 0) DESC, community_id) AS place FROM c JOIN occ USING (community_id)"""
)
def community_from_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurrence = table(spark, sf_dir, "communities").groupBy("community_id").agg(F.max("occurrence").alias("o"))
    seeds = table(spark, sf_dir, "retrieval").filter("kind = 'entity' and query_id is not null").select("query_id", F.lower("id").alias("member")).distinct()
    hits = seeds.join(_members(spark, sf_dir).filter("level <= 4"), "member").groupBy("query_id", "community_id").agg(F.countDistinct("member").alias("hits")).join(occurrence, "community_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc(F.coalesce("o", F.lit(0.0))), "community_id")
    return hits.select("query_id", "community_id", "hits", F.row_number().over(order).alias("place"))


@query(
    """SELECT level, community_id, occurrence, place FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY occurrence DESC, community_id) AS place FROM
    (SELECT community_id, max(level) AS level, max(occurrence) AS occurrence FROM communities GROUP BY 1) WHERE level IS NOT NULL AND occurrence IS NOT NULL) WHERE place <= 10"""
)
def community_from_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "communities").groupBy("community_id").agg(F.max("level").alias("level"), F.max("occurrence").alias("occurrence")).filter("level is not null and occurrence is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("occurrence"), "community_id"))).filter("place <= 10").select("level", "community_id", "occurrence", "place")


_LATEST = "latest AS (SELECT * FROM (SELECT DISTINCT * FROM node_state) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) = 1)"


@query(f"WITH {_LATEST} SELECT node_id, node_type, coalesce(level, -1) AS level, coalesce(is_valid, false) AS is_valid, coalesce(is_affected, false) AS is_affected, coalesce(signature, 0) AS signature FROM latest")
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = [F.coalesce(c, F.lit(v)).alias(c) for c, v in (("level", -1), ("is_valid", False), ("is_affected", False), ("signature", 0))]
    return _state(spark, sf_dir).select("node_id", "node_type", *defaults)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.latest(table(spark, sf_dir, "node_state").distinct(), ["node_id"], "updated_at")


@query(f"WITH {_LATEST} SELECT count(*) AS total, CAST(count_if(is_affected) AS BIGINT) AS affected, round(count_if(is_affected) / count(*), 6) AS ratio, count_if(is_affected) / count(*) > 0.99 AS rebuild FROM latest")
def affected_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.try_divide(F.count_if("is_affected"), F.count("*"))
    return _state(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("is_affected").alias("affected"), F.round(ratio, 6).alias("ratio"), (ratio > 0.99).alias("rebuild"))


@query(f"WITH {_LATEST} SELECT node_type, coalesce(level, -1) AS level, count(*) AS n, CAST(count_if(is_valid) AS BIGINT) AS valid, count(signature) AS signed FROM latest GROUP BY 1, 2")
def level_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).groupBy("node_type", F.coalesce("level", F.lit(-1)).alias("level")).agg(F.count("*").alias("n"), F.count_if("is_valid").alias("valid"), F.count("signature").alias("signed"))


@query(
    f"""WITH {_LATEST}, m AS (SELECT {KEY.format("parent")} AS community, signature FROM latest), k AS (SELECT * FROM m WHERE community IS NOT NULL AND signature IS NOT NULL),
    b AS (SELECT community, i, sum((signature >> i) & 1) AS ones, count(*) AS n FROM k, range(0, 62) r(i) GROUP BY 1, 2)
    SELECT community, CAST(sum(CASE WHEN ones * 2 >= n THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS signature, max(n) AS n FROM b GROUP BY 1"""
)
def signature_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.community_signatures(table(spark, sf_dir, "node_state").distinct())


@query()
def assign_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "node_state").distinct()
    free = _state(spark, sf_dir).filter("node_type <> 'community' and signature is not null and (parent is null or trim(parent) = '')").select(F.col("node_id").alias("node"), "signature")
    return incremental.assign_by_signature(free, incremental.community_signatures(state), 50)


@query(
    f"""WITH {MENT}, d AS (SELECT DISTINCT chunk_id AS chunk, chunk_index FROM chunks), n AS (SELECT chunk, max(coalesce(chunk_index, 0) % 5 = 0) AS is_new FROM d GROUP BY 1),
    k AS (SELECT ment.*, coalesce(is_new, false) AS is_new FROM ment LEFT JOIN n USING (chunk))
    SELECT a.chunk AS a, b.chunk AS b, CAST(count(*) AS INTEGER) AS shared FROM k a JOIN k b ON a.entity = b.entity AND a.chunk < b.chunk WHERE a.is_new OR b.is_new GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def incremental_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that new chunks bring: at least one end is new."""
    fresh = table(spark, sf_dir, "chunks").filter("coalesce(chunk_index, 0) % 5 = 0").select(F.col("chunk_id").alias("chunk")).distinct()
    pairs = merge.shared_entity_pairs(merge.entity_chunks(table(spark, sf_dir, "nodes")))
    new = lambda c: fresh.select(F.col("chunk").alias(c), F.lit(True).alias(f"new_{c}"))
    return pairs.join(new("a"), "a", "left").join(new("b"), "b", "left").filter("new_a or new_b").select("a", "b", "shared")


@query("SELECT id, output, mode, loaded_at FROM (SELECT DISTINCT id, output, lower(mode) AS mode, loaded_at FROM results) QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, output DESC, mode DESC) = 1")
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "results").select("id", "output", F.lower("mode").alias("mode"), "loaded_at").distinct()
    return incremental.latest(rows, ["id"], "loaded_at")


@query("SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT s FROM (SELECT unnest(source_ids) AS s FROM nodes) WHERE s IS NOT NULL)")
def filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "nodes").select(F.explode("source_ids").alias("chunk_id"))
    return table(spark, sf_dir, "chunks").select("chunk_id").filter("chunk_id is not null").distinct().join(used, "chunk_id", "left_anti")


@query("SELECT DISTINCT id FROM results WHERE id NOT IN (SELECT query_id FROM retrieval WHERE query_id IS NOT NULL)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "retrieval").select(F.col("query_id").alias("id"))
    return table(spark, sf_dir, "results").select("id").filter("id is not null").distinct().join(done, "id", "left_anti")


@query(
    """SELECT 'chunks' AS name, count(DISTINCT chunk_id) AS n FROM chunks UNION ALL SELECT 'nodes', count(DISTINCT node_id) FROM nodes UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT src, dst FROM edges)
    UNION ALL SELECT 'communities', count(DISTINCT community_id) FROM communities UNION ALL SELECT 'vectors', count(*) FROM (SELECT DISTINCT space, owner_id FROM vectors)"""
)
def data_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    keys = {"chunks": ["chunk_id"], "nodes": ["node_id"], "edges": ["src", "dst"], "communities": ["community_id"], "vectors": ["space", "owner_id"]}
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(*k).distinct().agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t, k in keys.items()])


@query("SELECT owner_type, space, count(*) AS n, count(embedding) AS filled, max(len(embedding)) AS dimension FROM (SELECT DISTINCT * FROM vectors) GROUP BY 1, 2")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "vectors").distinct()
    return rows.groupBy("owner_type", "space").agg(F.count("*").alias("n"), F.count("embedding").alias("filled"), F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint")).alias("dimension"))


@query(
    """WITH v AS (SELECT owner_id, space, any_value(embedding)::DOUBLE[] AS e FROM vectors WHERE len(embedding) = 64 GROUP BY 1, 2)
    SELECT a.owner_id, round(coalesce(list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0), -2), 6) AS cosine FROM v a JOIN v b USING (owner_id) WHERE a.space = 'node' AND b.space = 'node_text'"""
)
def node_text_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of a node's two embeddings."""
    rows = table(spark, sf_dir, "vectors").filter("size(embedding) = 64").groupBy("owner_id", "space").agg(F.first("embedding").alias("e"))
    side = lambda space, name: rows.filter(F.col("space") == space).select("owner_id", F.col("e").alias(name))
    return side("node", "a").join(side("node_text", "b"), "owner_id").select("owner_id", F.round(F.coalesce(vx.cosine("a", "b"), F.lit(-2.0)), 6).alias("cosine"))


@query(
    f"""SELECT coalesce(lower(mode), 'none') AS stage, count(*) AS calls, CAST(sum({TOK.format("question")}) AS BIGINT) AS prompt_tokens, CAST(sum({TOK.format("output")}) AS BIGINT) AS completion_tokens,
    round(sum({TOK.format("question")}) * 0.0005 + sum({TOK.format("output")}) * 0.0015, 6) AS cost FROM (SELECT DISTINCT id, mode, question, output FROM results) GROUP BY 1"""
)
def llm_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "results").select("id", "mode", "question", "output").distinct()
    asked, said = F.sum(tx.token_count(F.col("question"))), F.sum(tx.token_count(F.col("output")))
    return rows.groupBy(F.coalesce(F.lower("mode"), F.lit("none")).alias("stage")).agg(F.count("*").alias("calls"), asked.alias("prompt_tokens"), said.alias("completion_tokens"), F.round(asked * 0.0005 + said * 0.0015, 6).alias("cost"))


@query()
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.plans.graphs import seeds

    return retrieval.beam_search(table(spark, sf_dir, "edges"), seeds(spark, sf_dir))


@query(
    """WITH t AS (SELECT 'r' || r_regionkey AS ancestor, 'n' || n_nationkey AS descendant, 1 AS distance FROM region JOIN nation ON n_regionkey = r_regionkey), c AS (SELECT 'n' || c_nationkey AS ancestor, 'c' || c_custkey AS descendant, 1 AS distance FROM customer)
    SELECT * FROM t UNION ALL SELECT * FROM c UNION ALL SELECT t.ancestor, c.descendant, 2 FROM t JOIN c ON c.ancestor = t.descendant"""
)
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators import hierarchy

    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    region = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))
    customer = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"))
    return hierarchy.descendants(hierarchy.hierarchy(region.unionByName(nation).unionByName(customer)))
