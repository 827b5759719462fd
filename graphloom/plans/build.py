"""Queries over builders, providers, contents of communities and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import build, context, embed, evaluate, providers, retrieval
from graphloom.plans.queries import KEY, NORM, RANKED, TOK
from graphloom.plans.registry import query
from graphloom.plans.search import TEXTS
from graphloom.session import ensure_checkpoint_dir, table

_TRIPLES = """tw AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '[a-z]{10,}') AS w FROM chunks WHERE chunk_id IS NOT NULL),
    ti AS (SELECT chunk_id, w, unnest(range(1, len(w))) AS i FROM tw), tr AS (SELECT chunk_id, w[i] AS s, w[i + 1] AS o FROM ti WHERE w[i] <> w[i + 1])"""


@query(f"WITH {_TRIPLES} SELECT least(s, o) AS a, greatest(s, o) AS b, CAST(count(*) AS DOUBLE) AS weight, 'co_occurs' AS relations, count(DISTINCT chunk_id) AS n_sources FROM tr GROUP BY 1, 2")
def entity_relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.entity_relation_graph(table(spark, sf_dir, "chunks"))[1]


@query("SELECT entity, count(DISTINCT chunk_id) AS n_sources FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z]{10,}')) AS entity FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY 1")
def entity_relation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.entity_relation_graph(table(spark, sf_dir, "chunks"))[0]


@query(
    """SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(coalesce(weight, 1.0)), 6) AS weight, count(*) AS n
    FROM (SELECT DISTINCT * FROM edges) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2"""
)
def rich_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as delimited records, parsed and merged."""
    edges = table(spark, sf_dir, "edges").filter("src is not null and dst is not null").distinct()
    record = F.concat(F.lit('("relationship"<|>"'), "src", F.lit('"<|>"'), "dst", F.lit('"<|>"x"<|>"y"<|>'), F.coalesce(F.col("weight").cast("decimal(30,12)").cast("string"), F.lit("?")), F.lit(")"))
    return build.rich_graph(edges.select("src", record.alias("record")), "src")[1].select("a", "b", "weight", "n")


@query("SELECT DISTINCT src, dst, coalesce(relation_names[1], '') AS relation FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL")
def parse_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as a model's literals; the far end is given as a node only where the edge has a weight."""
    edges = table(spark, sf_dir, "edges").filter("src is not null and dst is not null").distinct()
    node = lambda c: F.concat(F.lit("Node(id='"), c, F.lit("', type='t')"))
    relation = F.concat(F.lit("Relationship(subj="), node("src"), F.lit(", obj="), node("dst"), F.lit(", type='"), F.coalesce(F.get("relation_names", F.lit(0)), F.lit("")), F.lit("')"))
    far = F.when(F.col("weight").isNotNull() | (F.col("src") == F.col("dst")), node("dst")).otherwise("")
    said = edges.select(F.xxhash64(*edges.columns).alias("chunk_id"), F.concat_ws(" ", node("src"), relation, far).alias("reply"))
    return build.parse_literals(said)[1].select("src", "dst", "relation").distinct()


@query("SELECT DISTINCT src, dst, s AS value FROM (SELECT src, dst, unnest(source_ids) AS s FROM edges) WHERE s IS NOT NULL AND s <> ''")
def unpack_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "edges").select("src", "dst", F.array_join("source_ids", "<SEP>").alias("packed"))
    return build.unpack(packed, ["src", "dst"], "packed").distinct()


@query(f"WITH {TEXTS}, lv AS (SELECT community_id AS id, max(level) AS level FROM communities GROUP BY 1) SELECT id, kind, CASE WHEN kind = 'community' THEN coalesce(level, 0) + 1 ELSE 0 END AS level, md5(text) AS text FROM tx LEFT JOIN lv USING (id)")
def hybrid_node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = embed.node_texts(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "communities"))
    levels = table(spark, sf_dir, "communities").groupBy(F.col("community_id").alias("id")).agg(F.max("level").alias("level"))
    level = F.when(F.col("kind") == "community", F.coalesce("level", F.lit(0)) + 1).otherwise(0)
    return texts.join(levels, "id", "left").select("id", "kind", level.alias("level"), F.md5("text").alias("text"))


_MEMBERS = f"mem AS (SELECT DISTINCT community_id, {KEY.format('m')} AS key FROM (SELECT community_id, unnest(members) AS m FROM communities WHERE community_id IS NOT NULL) WHERE {KEY.format('m')} IS NOT NULL)"


@query(
    f"""WITH {_MEMBERS}, lv AS (SELECT community_id, coalesce(max(level), 0) AS level FROM communities GROUP BY 1), n AS (SELECT DISTINCT node_id, {KEY.format('node_id')} AS key FROM nodes WHERE node_id IS NOT NULL)
    SELECT node_id, string_agg(DISTINCT level || ':' || community_id, ',' ORDER BY level || ':' || community_id) AS clusters FROM n JOIN mem USING (key) JOIN lv USING (community_id) GROUP BY 1"""
)
def cluster_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.clusters_of_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "communities"))


@query(
    f"""WITH {_MEMBERS}, n AS (SELECT DISTINCT node_id, {KEY.format('node_id')} AS key, node_type FROM nodes WHERE node_id IS NOT NULL), i AS (SELECT * FROM mem JOIN n USING (key)),
    c AS (SELECT community_id, count(DISTINCT CASE WHEN node_type = 'chunk' THEN node_id END) AS chunks, count(DISTINCT CASE WHEN node_type = 'entity' THEN node_id END) AS entities FROM i GROUP BY 1),
    r AS (SELECT a.community_id, count(*) AS relations FROM (SELECT DISTINCT src, dst FROM edges) e JOIN (SELECT DISTINCT community_id, node_id FROM i WHERE node_type = 'entity') a ON a.node_id = src JOIN (SELECT DISTINCT community_id, node_id FROM i WHERE node_type = 'entity') b ON b.node_id = dst AND b.community_id = a.community_id GROUP BY 1)
    SELECT community_id, chunks, entities, coalesce(relations, 0) AS relations FROM c LEFT JOIN r USING (community_id)"""
)
def community_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.community_contents(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"), table(spark, sf_dir, "communities"))


@query(
    f"""WITH {_MEMBERS}, p AS (SELECT key, min(community_id) AS parent FROM mem GROUP BY 1),
    s AS (SELECT DISTINCT node_id, 0 AS level FROM nodes WHERE node_id IS NOT NULL AND node_type <> 'community' UNION ALL SELECT community_id, coalesce(max(level), 0) + 1 FROM communities WHERE community_id IS NOT NULL GROUP BY 1)
    SELECT node_id, level, parent FROM s LEFT JOIN p ON p.key = {KEY.format('node_id')}"""
)
def state_from_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.state_of(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "communities"))


@query("SELECT level, count(signature) AS n, count(DISTINCT signature) AS signatures, round(avg(bit_count(signature)), 6) AS bits FROM (SELECT DISTINCT node_id, level, signature FROM node_state) GROUP BY 1")
def signature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "node_state").select("node_id", "level", "signature").distinct()
    return rows.groupBy("level").agg(F.count("signature").alias("n"), F.count_distinct("signature").alias("signatures"), F.round(F.avg(F.bit_count("signature")), 6).alias("bits"))


@query(
    """WITH c AS (SELECT community_id, max(level) AS level, max(coalesce(summary, '')) AS summary FROM communities GROUP BY 1), k AS (SELECT community_id, count(DISTINCT s) AS n FROM (SELECT community_id, unnest(sub_communities) AS s FROM communities) GROUP BY 1)
    SELECT level, count(*) AS communities, CAST(sum(CASE WHEN summary <> '' THEN 1 ELSE 0 END) AS BIGINT) AS summaries, CAST(sum(coalesce(n, 0)) AS BIGINT) AS children FROM c LEFT JOIN k USING (community_id) GROUP BY 1"""
)
def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    communities = table(spark, sf_dir, "communities")
    own = communities.groupBy("community_id").agg(F.max("level").alias("level"), F.max(F.coalesce("summary", F.lit(""))).alias("summary"))
    children = communities.select("community_id", F.explode("sub_communities").alias("s")).groupBy("community_id").agg(F.count_distinct("s").alias("n"))
    return own.join(children, "community_id", "left").groupBy("level").agg(F.count("*").alias("communities"), F.sum((F.col("summary") != "").cast("bigint")).alias("summaries"), F.sum(F.coalesce("n", F.lit(0))).alias("children"))


@query("SELECT DISTINCT query_id, r.id, c.content IS NOT NULL AS known, md5(coalesce(c.content, '')) AS content FROM retrieval r LEFT JOIN (SELECT 'CHUNK_' || chunk_id AS id, min(coalesce(content, '')) AS content FROM chunks GROUP BY 1) c USING (id) WHERE kind = 'chunk' AND r.id IS NOT NULL")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents by key; a key that is no chunk stays, without content."""
    asked = table(spark, sf_dir, "retrieval").filter("kind = 'chunk' and id is not null").select("query_id", "id").distinct()
    held = table(spark, sf_dir, "chunks").groupBy(F.concat(F.lit("CHUNK_"), "chunk_id").alias("id")).agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))
    return asked.join(held, "id", "left").select("query_id", "id", F.col("content").isNotNull().alias("known"), F.md5(F.coalesce("content", F.lit(""))).alias("content"))


_SEED = "sd AS (SELECT DISTINCT query_id, id AS node FROM retrieval WHERE kind = 'entity' AND query_id IS NOT NULL AND id IS NOT NULL)"


@query(f"WITH {_SEED} SELECT DISTINCT a.query_id, src, dst, array_to_string(list_sort(list_distinct(list_filter(relation_names, lambda x: x <> ''))), ',') AS names FROM edges JOIN sd a ON a.node = src JOIN sd b ON b.node = dst AND b.query_id = a.query_id")
def relations_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the edges between entities that one query found."""
    seeds = _seeds(spark, sf_dir)
    names = F.array_join(F.array_sort(F.array_distinct(F.filter("relation_names", lambda x: x != ""))), ",")
    both = table(spark, sf_dir, "edges").join(seeds.withColumnRenamed("node", "src"), "src").join(seeds.withColumnRenamed("node", "dst"), ["query_id", "dst"])
    return both.select("query_id", "src", "dst", names.alias("names")).distinct()


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "retrieval").filter("kind = 'entity' and query_id is not null and id is not null").select("query_id", F.col("id").alias("node")).distinct()


@query(
    f"""WITH {_SEED}, e AS (SELECT src, lower(r) AS relation, sum(w) AS w FROM (SELECT src, coalesce(weight, 0) AS w, unnest(relation_names) AS r FROM (SELECT DISTINCT * FROM edges)) WHERE r <> '' GROUP BY 1, 2)
    SELECT query_id, node, relation, row_number() OVER (PARTITION BY query_id, node ORDER BY round(w, 6) DESC, relation) AS place FROM sd JOIN e ON src = node WHERE round(w, 6) > 0 QUALIFY place <= 3"""
)
def relations_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three relations of each entity that the offline judge, their added weight, ranks first."""
    edges = table(spark, sf_dir, "edges").distinct().select("src", F.coalesce("weight", F.lit(0.0)).alias("w"), F.explode("relation_names").alias("r")).filter("r <> ''")
    # few rows an entity are left before they meet the queries
    scored = edges.groupBy(F.col("src").alias("node"), F.lower("r").alias("relation")).agg(F.round(F.sum("w"), 6).alias("w")).filter("w > 0")
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "relation"))).filter("place <= 3")
    return _seeds(spark, sf_dir).join(best, "node").select("query_id", "node", "relation", "place")


@query(
    f"""WITH {_SEED}, e AS (SELECT src, dst, max(coalesce(weight, 0)) AS w FROM edges WHERE dst IS NOT NULL GROUP BY 1, 2)
    SELECT query_id, dst AS tail, row_number() OVER (PARTITION BY query_id ORDER BY max(w) DESC, dst) AS place FROM sd JOIN e ON src = node WHERE w > 0 GROUP BY query_id, dst QUALIFY place <= 5"""
)
def tails_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tails of a query's entities that the offline judge, the edge weight, ranks first."""
    edges = table(spark, sf_dir, "edges").filter("dst is not null").groupBy(F.col("src").alias("node"), F.col("dst").alias("tail")).agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("w")).filter("w > 0")
    # no more than five tails of one entity can be among the five of a query
    few = edges.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "tail"))).filter("n <= 5")
    best = _seeds(spark, sf_dir).join(few, "node").groupBy("query_id", "tail").agg(F.max("w").alias("w"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "tail"))).filter("place <= 5").select("query_id", "tail", "place")


_WORDS = "SELECT id, list_filter(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'), lambda w: length(w) > 2) AS w FROM (SELECT DISTINCT id, question FROM results WHERE id % 50 = 0 AND question IS NOT NULL)"


def _question_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "results").filter("id % 50 = 0 and question is not null").select("id", "question").distinct()
    return rows.select("id", F.filter(F.regexp_extract_all(F.lower("question"), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)), lambda w: F.length(w) > 2).alias("w"))


@query(f"SELECT DISTINCT id, CASE WHEN length(term) >= 8 THEN 'high' ELSE 'low' END AS level, term FROM (SELECT id, unnest(w) AS term FROM ({_WORDS})) WHERE length(term) > 4")
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of questions by the offline rule: long words are high-level, shorter ones low-level."""
    terms = _question_words(spark, sf_dir).select("id", F.explode("w").alias("term")).filter("length(term) > 4")
    return terms.select("id", F.when(F.length("term") >= 8, "high").otherwise("low").alias("level"), "term").distinct()


@query(f"SELECT DISTINCT id, w[i] AS subject, 'relates_to' AS predicate, w[i + 1] AS object FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM ({_WORDS}))")
def query_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of questions by the offline rule: neighbouring words of more than two letters."""
    rows = _question_words(spark, sf_dir).filter("size(w) > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    return rows.select("id", F.element_at("w", F.col("i")).alias("subject"), F.lit("relates_to").alias("predicate"), F.element_at("w", F.col("i") + 1).alias("object")).distinct()


@query("WITH q AS (SELECT DISTINCT id, lower(question) AS q FROM results WHERE id % 50 = 0), n AS (SELECT DISTINCT lower(entity_name) AS name FROM nodes WHERE node_type = 'entity' AND length(entity_name) > 3) SELECT DISTINCT q.id, t AS term FROM q, (SELECT unnest(regexp_extract_all(name, '[\\p{L}\\p{N}]{5,}')) AS t FROM n) WHERE list_contains(regexp_extract_all(q, '[\\p{L}\\p{N}]+'), t)")
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of questions that occur in names of entities."""
    names = table(spark, sf_dir, "nodes").filter("node_type = 'entity' and length(entity_name) > 3").select(F.explode(F.regexp_extract_all(F.lower("entity_name"), F.lit("([\\p{L}\\p{N}]{5,})"), F.lit(1))).alias("term")).distinct()
    asked = table(spark, sf_dir, "results").filter("id % 50 = 0").select("id", F.explode(F.regexp_extract_all(F.lower("question"), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))).alias("term")).distinct()
    return asked.join(names, "term", "left_semi").select("id", "term")


@query("SELECT id, 'Q: ' || trim(max(question)) AS reply FROM results WHERE question IS NOT NULL AND id % 50 = 0 GROUP BY 1")
def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question straight to the provider, without any context."""
    rows = table(spark, sf_dir, "results").filter("question is not null and id % 50 = 0").groupBy("id").agg(F.concat(F.lit("Q: "), F.trim(F.max("question"))).alias("prompt"))
    return providers.ask_rows(rows, providers.echo, "id", "prompt").filter("error is null").select("id", "reply")


@query(
    """WITH w AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(min(coalesce(content, ''))), '[a-z]{6,}')) AS w FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1), t AS (SELECT chunk_id, unnest(w) AS t FROM w)
    SELECT chunk_id, t AS term FROM t QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY length(t) DESC, t) <= 9"""
)
def gleaned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of chunks, asked for once and twice more as long as the provider says that there are more."""
    rows = table(spark, sf_dir, "chunks").filter("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.coalesce("content", F.lit(""))).alias("prompt"))
    said = providers.ask_rows(rows, providers.longest_words, "chunk_id", "prompt", gleanings=2)
    return said.select("chunk_id", F.explode(F.split("reply", "\\s+")).alias("term")).filter("term <> ''")


@query(f"WITH {RANKED} SELECT query_id, count(DISTINCT kind) AS kinds, count(*) AS items, count(DISTINCT kind) = 3 AS complete FROM rk GROUP BY 1")
def validated_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query found something of every kind."""
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval"))
    return rows.groupBy("query_id").agg(F.count_distinct("kind").alias("kinds"), F.count("*").alias("items")).withColumn("complete", F.col("kinds") == 3)


FAILED = "No context was found for this question."


@query(
    f"""WITH {RANKED}, ch AS (SELECT 'CHUNK_' || chunk_id AS id, min(coalesce(content, '')) AS content FROM chunks GROUP BY 1), t AS (SELECT query_id, content FROM rk JOIN ch USING (id) WHERE kind = 'chunk' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) = 1)
    SELECT r.id, coalesce(nullif(array_to_string(list_filter(string_split_regex(content, '[ \\t\\r\\n]+'), lambda x: x <> '')[1:20], ' '), ''), '{FAILED}') AS reply FROM (SELECT DISTINCT id FROM results WHERE id IS NOT NULL) r LEFT JOIN t ON t.query_id = r.id"""
)
def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the offline generator, the first tokens of the best chunk, or the fixed failure reply."""
    contents = table(spark, sf_dir, "chunks").groupBy(F.concat(F.lit("CHUNK_"), "chunk_id").alias("id")).agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))
    found = retrieval.ranked(table(spark, sf_dir, "retrieval")).filter("kind = 'chunk'").join(contents, "id")
    best = found.groupBy(F.col("query_id").alias("id")).agg(F.min_by("content", "pos").alias("content"))
    rows = table(spark, sf_dir, "results").filter("id is not null").select("id").distinct().join(best, "id", "left")
    prompt = F.coalesce(F.nullif(context.truncate(F.col("content"), 20), F.lit("")), F.lit(FAILED))
    return providers.ask_rows(rows.select("id", prompt.alias("prompt")), providers.echo, "id", "prompt").select("id", "reply")


@query(
    f"""WITH s AS (SELECT community_id AS id, max(coalesce(level, 0)) AS level, max(coalesce(occurrence, 0)) AS occurrence, max(coalesce(summary, '')) AS summary FROM communities GROUP BY 1),
    t AS (SELECT *, {TOK.format('summary')} AS tokens FROM s WHERE level <= 2 AND occurrence > 0 AND summary <> '' ORDER BY occurrence DESC, id LIMIT 512)
    SELECT id, row_number() OVER (ORDER BY occurrence DESC, id) AS place FROM t QUALIFY sum(tokens) OVER (ORDER BY occurrence DESC, id ROWS UNBOUNDED PRECEDING) <= 2000"""
)
def strategy_global_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the 512 most occurring reports up to level 2, scored by the offline judge, in order, under a token budget."""
    c = table(spark, sf_dir, "communities").groupBy(F.col("community_id").alias("id")).agg(
        F.max(F.coalesce("level", F.lit(0))).alias("level"), F.max(F.coalesce("occurrence", F.lit(0.0))).alias("occurrence"), F.max(F.coalesce("summary", F.lit(""))).alias("summary")
    )
    order = [F.desc("occurrence"), F.col("id")]
    # at most 512 rows reach the one task of the window
    top = c.filter("level <= 2 and occurrence > 0 and summary <> ''").orderBy(*order).limit(512).withColumn("one", F.lit(1))
    kept = retrieval.budget_prefix(top, 2000, ["one"], order, tx.token_count(F.col("summary")))
    return kept.select("id", F.row_number().over(Window.partitionBy("one").orderBy(*order)).alias("place"))


@query(
    """WITH q AS (SELECT DISTINCT id FROM results WHERE id % 50 = 0), m AS (SELECT id FROM q WHERE id NOT IN (SELECT query_id FROM retrieval WHERE query_id IS NOT NULL)), f AS (SELECT DISTINCT 'CHUNK_' || chunk_id AS chunk FROM chunks WHERE chunk_id IS NOT NULL ORDER BY 1 LIMIT 5)
    SELECT id, chunk FROM m CROSS JOIN f"""
)
def fallback_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that found nothing start from the first five chunks."""
    asked = table(spark, sf_dir, "results").filter("id % 50 = 0").select("id").distinct()
    missed = asked.join(table(spark, sf_dir, "retrieval").select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")
    first = table(spark, sf_dir, "chunks").filter("chunk_id is not null").select(F.concat(F.lit("CHUNK_"), "chunk_id").alias("chunk")).distinct().orderBy("chunk").limit(5)
    return missed.crossJoin(F.broadcast(first))


@query(f"WITH g AS (SELECT id, {NORM.format('p')} AS p, {NORM.format('g')} AS g FROM (SELECT id, unnest(string_split(replace(coalesce(output, ''), '|', chr(10)), chr(10))) AS p, answer FROM results), LATERAL (SELECT unnest(string_split(coalesce(answer, ''), '|')) AS g)) SELECT id, max(CASE WHEN contains(p, g) THEN 1 ELSE 0 END) AS accuracy FROM g GROUP BY 1")
def multi_answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.multi_answer(table(spark, sf_dir, "results"))


def _bleu_sql() -> str:
    gram = lambda c, n: f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i : i + {n - 1}], ' '))"
    hits = lambda n: f"coalesce(list_sum(list_transform(list_distinct(p{n}), lambda x: least(len(list_filter(p{n}, lambda y: y = x)), len(list_filter(g{n}, lambda y: y = x))))), 0)"
    grams = ", ".join(f"{gram('pw', n)} AS p{n}, {gram('gw', n)} AS g{n}" for n in range(1, 5))
    logs = " + ".join(f"ln(CASE WHEN {hits(n)} > 0 THEN {hits(n)} ELSE 0.1 END / greatest(1, len(p{n})))" for n in range(1, 5))
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda x: x <> '')"
    return f"""WITH g AS (SELECT DISTINCT id, {words(NORM.format('output'))} AS pw, {words(NORM.format('g'))} AS gw FROM (SELECT id, output, unnest(string_split(coalesce(answer, ''), '|')) AS g FROM results)),
      n AS (SELECT id, pw, gw, {grams} FROM g), s AS (SELECT id, CASE WHEN {hits(1)} = 0 THEN 0 ELSE exp(({logs}) / 4) * CASE WHEN len(pw) >= len(gw) THEN 1 ELSE exp(1 - len(gw) / len(pw)) END END AS b FROM n)
      SELECT id, round(max(b), 4) AS bleu4 FROM s GROUP BY 1"""


@query(_bleu_sql())
def bleu4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bleu4(table(spark, sf_dir, "results"))


@query(f"WITH g AS (SELECT DISTINCT id, coalesce(lower(mode), '') AS mode, {NORM.format('output')} AS p, {NORM.format('g')} AS g FROM (SELECT id, mode, output, unnest(string_split(coalesce(answer, ''), '|')) AS g FROM results)), e AS (SELECT id, mode, max(CASE WHEN p = g THEN 1 ELSE 0 END) AS em, max(CASE WHEN g <> '' AND contains(p, g) THEN 1 ELSE 0 END) AS acc FROM g GROUP BY 1, 2) SELECT mode, count(*) AS n, round(100 * avg(em), 6) AS em, round(100 * avg(acc), 6) AS accuracy FROM e GROUP BY 1")
def evaluation_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of the answer metrics for each mode of answering, times 100."""
    return evaluate.by_mode(table(spark, sf_dir, "results"))


@query("SELECT CAST(parent_free AS VARCHAR) AS leaf, count(*) AS n FROM (SELECT node_id, lower(trim(node_id)) NOT IN (SELECT lower(trim(parent)) FROM node_state WHERE parent IS NOT NULL) AS parent_free FROM (SELECT DISTINCT node_id FROM node_state WHERE node_id IS NOT NULL)) GROUP BY 1")
def tree_leaves_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves and inner nodes of a tree, saved apart and read again."""
    import uuid

    from graphloom.sources import io

    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tree-{uuid.uuid4().hex}"
    state = table(spark, sf_dir, "node_state")
    io.save_tree(state.filter("node_id is not null").select("node_id", "parent"), place)
    leaves, inner = io.load_tree(spark, place)
    counted = lambda rows, leaf: rows.select("node_id").distinct().agg(F.count("*").alias("n")).select(F.lit(leaf).alias("leaf"), "n")
    return counted(leaves, "true").unionByName(counted(inner, "false")).filter("n > 0")
