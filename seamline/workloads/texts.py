"""Documents, similarity search, conversations and the pluggable sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import nested as nx
from seamline.functions import numeric
from seamline.functions import text as tx
from seamline.operators import relational as rel
from seamline.operators import vectors
from seamline.operators import windows as win
from seamline.plans import conversations, retrieval, text_index, vector_index
from seamline.session import cut_lineage, scratch
from seamline.sources import feeds
from seamline.sources.landed import FILTERS, LandedFeed
from seamline.streaming import runner
from seamline.workloads import standins as st
from seamline.workloads.aggregations import DELTAS
from seamline.workloads.registry import query
from seamline.workloads.scalars import ANSWERS_SQL, HEADING_SQL, INTENT_SQL, TOPIC_SQL, _answers

WORDS_SQL = "list_filter(regexp_split_to_array({0}, '{{BLANK}}+'), lambda x: x <> '')"
CHUNKS_SQL = "list_transform(range(0, len({0}), 462), lambda i: array_to_string({0}[i + 1:i + 512], ' '))"


@query("t01_word_chunks", f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents), c AS (SELECT doc_id, {CHUNKS_SQL.format('w')} AS chunks FROM w)
SELECT doc_id, CAST(unnest(range(len(chunks))) AS BIGINT) AS position, unnest(chunks) AS chunk FROM c
""")
def word_chunks(spark, sf):
    docs = st.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(retrieval.word_chunks(F.col("text"))).alias("position", "chunk"))


CHUNK_TABLE_SQL = f"""
p AS (SELECT clean, concat(source, '/', doc_id, '.txt') AS file_path, sha1(unhex('{fixed.DNS_NAMESPACE}') || encode(concat(source, '/', doc_id, '.txt'))) AS d FROM clean_documents),
q AS (SELECT clean, file_path, string_split(clean, chr(10)) AS ls, concat(d[1:8], '-', d[9:12], '-5', d[14:16], '-', substr('89ab', (instr('0123456789abcdef', d[17:17]) - 1) % 4 + 1, 1), d[18:20], '-', d[21:32]) AS document_id FROM p),
m AS (SELECT document_id, file_path, clean, concat('# Document', chr(10), chr(10), '**Source:** ', file_path, chr(10), chr(10), '---', chr(10), chr(10),
  array_to_string(list_transform(ls, lambda x, i: CASE WHEN {HEADING_SQL.format('x')} THEN concat('### ', x, chr(10), chr(10))
    WHEN i = len(ls) OR {HEADING_SQL.format('ls[i + 1]')} THEN concat(x, chr(10), chr(10)) ELSE concat(x, chr(10)) END), '')) AS md FROM q),
w AS (SELECT document_id, file_path, {WORDS_SQL.format('clean')} AS a, {WORDS_SQL.format('md')} AS b FROM m),
c AS (SELECT document_id, file_path, {CHUNKS_SQL.format('a')} AS ca, {CHUNKS_SQL.format('b')} AS cb FROM w),
t AS (SELECT *, least(len(ca), len(cb)) AS total FROM c),
e AS (SELECT document_id, file_path, total, unnest(range(total)) AS i, unnest(ca[1:total]) AS content, unnest(cb[1:total]) AS markdown FROM t)"""


@query("t02_chunk_table", f"""WITH {CHUNK_TABLE_SQL.strip()}
SELECT concat(document_id, '_', lpad(CAST(i AS VARCHAR), 4, '0')) AS chunk_id, document_id, content, markdown, CAST(i AS BIGINT) AS chunk_index,
  CAST(total AS BIGINT) AS total_chunks, length(content) AS chunk_size, sha256(concat(content, '{{"chunk_index": "', i, '", "chunk_size": "', length(content),
  '", "file_path": "', file_path, '", "total_chunks": "', total, '"}}')) AS provenance_hash FROM e
""")
def chunk_table(spark, sf):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return retrieval.chunk_table(st.documents(spark, sf), path, "text", F.lit(None).cast("string"))


@query("t03_chunk_embeddings", f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents)
SELECT doc_id, unnest(range(0, CAST(ceil(len(w) / 462.0) AS BIGINT))) AS position, 384::BIGINT AS dimensions, 1.0::DOUBLE AS squared_length FROM w
""")
def chunk_embeddings(spark, sf):
    chunks = st.documents(spark, sf).select("doc_id", F.posexplode(retrieval.word_chunks(F.col("text"))).alias("position", "chunk"))
    embedded = retrieval.embed(chunks, "chunk")
    return embedded.select("doc_id", "position", F.size("embedding").alias("dimensions"), nx.dot(F.col("embedding"), F.col("embedding")).alias("squared_length"))


@query("t04_nearest_by_distance", """
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT centre FROM centroid)), 6) AS distance FROM embeddings ORDER BY 2, vec_id LIMIT 10
""")
def nearest_by_distance(spark, sf):
    vecs = st.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(vecs, "embedding", vectors.overall_centre(vecs, "embedding"), 10, "l2", "vec_id").drop("embedding")


SEARCH_SQL = """SELECT d.doc_id, d.source, d.lang, d.text, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT centre FROM centroid)) AS similarity
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN embeddings e ON e.vec_id = d.doc_id
WHERE l.quality >= 0.7 AND (d.lang = 'en' OR l.toxic = 1 OR d.n_chars > 2000) AND (d.text ILIKE '%th%' OR d.source ILIKE '%th%')"""


def _search(spark, sf):
    vecs = st.table(spark, sf, "embeddings")
    centre = vectors.overall_centre(vecs, "embedding")
    rows = retrieval.searchable(
        st.documents(spark, sf), vecs.select(F.col("vec_id").alias("doc_id"), "embedding"), st.table(spark, sf, "labels"),
        (F.col("lang") == "en") | (F.col("toxic") == 1) | (F.col("n_chars") > 2000), contains="th",
    )
    return vectors.nearest(rows, "embedding", centre, 10, "cosine", "doc_id")


@query("t05_filtered_similarity_search", f"SELECT doc_id, source, lang, round(similarity, 6) AS similarity FROM ({SEARCH_SQL}) ORDER BY similarity DESC, doc_id LIMIT 10")
def filtered_similarity_search(spark, sf):
    return _search(spark, sf).select("doc_id", "source", "lang", "similarity")


def _indexed_neighbours(spark, sf):
    """An index over all embeddings, its queries (every row whose id is divisible by 100) and what it finds."""
    vecs = st.table(spark, sf, "embeddings").select("vec_id", "embedding")
    index = vector_index.build(vecs, "vec_id", "embedding", scratch(spark, "vectors"))
    asked = vecs.where(F.col("vec_id") % 100 == 0)
    return vecs, asked, index.search(asked, "vec_id", "embedding", 10)


@query("t06_approximate_nearest")
def approximate_nearest(spark, sf):
    return _indexed_neighbours(spark, sf)[2]


@query("t06_index_distances", """
SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings)) AS found, 0.0::DOUBLE AS nearest, 0.0::DOUBLE AS largest_error FROM embeddings WHERE vec_id % 100 = 0
""")
def index_distances(spark, sf):
    """The distances an index reports, measured again from the vectors: each query finds itself first, and none is off."""
    vecs, asked, found = _indexed_neighbours(spark, sf)
    pairs = found.join(vecs, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
    gap = F.aggregate(F.zip_with("embedding", "_q", lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda a, x: a + x)
    return pairs.groupBy("query_id").agg(
        F.count("*").alias("found"), F.min("distance").alias("nearest"), F.max(F.abs(F.sqrt(gap) - F.col("distance"))).alias("largest_error")
    )


@query("t07_batch_nearest", """
WITH q AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label),
s AS (SELECT q.label AS query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS similarity FROM embeddings, q)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def batch_nearest(spark, sf):
    vecs = st.table(spark, sf, "embeddings")
    queries = vectors.centroid(vecs, "embedding", ["label"])
    return vectors.batch_nearest(vecs, queries, 5, "vec_id", "embedding", "label", "centre")


CONTEXT_SQL = f"""chunks AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, doc_id) AS rank FROM ({SEARCH_SQL}) QUALIFY rank <= 5),
ws AS (SELECT metric, avg(value) / 100 AS weight FROM component_long GROUP BY metric),
wr AS (SELECT *, row_number() OVER (ORDER BY weight DESC, metric) AS rank FROM ws QUALIFY rank <= 10),
recent AS (SELECT * FROM gold_features WHERE feature_date >= (SELECT max(feature_date) FROM gold_features) - INTERVAL 7 DAY),
ch AS ({DELTAS.replace('gold_features', 'recent')}),
cr AS (SELECT *, CASE WHEN delta > 0.01 THEN 'increase' WHEN delta < -0.01 THEN 'decrease' ELSE 'stable' END AS direction,
  row_number() OVER (ORDER BY feature_date DESC, mine_id) AS rank FROM ch QUALIFY rank <= 5)"""


@query("t08_answer_context", f"""WITH {CONTEXT_SQL}
SELECT concat('User Query: Which assets stay viable?', chr(10), '=== RELEVANT DOCUMENTS ===', chr(10),
  (SELECT string_agg(concat('Document ', rank, ': ', source, ' (', lang, ')', chr(10), 'Similarity: ', printf('%.3f', round(similarity, 3)), chr(10), 'Content: ',
     substring(text, 1, 500), '...', chr(10)), chr(10) ORDER BY rank) FROM chunks), chr(10), '=== CURRENT METRIC WEIGHTS ===', chr(10),
  (SELECT string_agg(concat('- ', metric, ': ', printf('%.3f', round(weight, 3))), chr(10) ORDER BY rank) FROM wr), chr(10), '=== RECENT CHANGES ===', chr(10),
  (SELECT string_agg(concat('- ', mine_id, ': ', printf('%.3f', round(feature_freshness_score, 3)), ' (', direction, ': ', printf('%+.4f', round(delta, 4)), ') on ',
     strftime(feature_date, '%Y-%m-%d')), chr(10) ORDER BY rank) FROM cr)) AS context
""")
def answer_context(spark, sf):
    # Rank numbers only the few rows of each top-k result.
    chunks = conversations.ranked(_search(spark, sf).limit(5), [F.col("similarity").desc(), F.col("doc_id")])
    mean_weights = st.component_long(spark, sf).groupBy("metric").agg((F.avg("value") / 100).alias("weight"))
    heaviest = conversations.ranked(mean_weights.orderBy(F.col("weight").desc(), "metric").limit(10), [F.col("weight").desc(), F.col("metric")])
    gold = st.gold_features(spark, sf)
    recent = rel.where_since(gold, "feature_date", 7, rel.latest_value(gold, "feature_date"))
    changed = win.deltas(recent, "mine_id", "feature_date", "feature_freshness_score", 0.01, ("increase", "decrease", "stable"))
    newest = changed.orderBy(F.col("feature_date").desc(), "mine_id").limit(5).withColumnRenamed("feature_freshness_score", "score")
    return retrieval.answer_context(
        "Which assets stay viable?", chunks, heaviest, conversations.ranked(newest, [F.col("feature_date").desc(), F.col("mine_id")])
    )


@query("t09_response_audit", f"""WITH {ANSWERS_SQL}, c AS (SELECT *, (length(answer) - length(replace(answer, '[Source:', ''))) // 8 AS citations FROM answers)
SELECT conv_id, turn, CAST(citations AS BIGINT) AS citations, length(answer) AS characters, citations >= 2 AS valid,
  round((CASE WHEN citations >= 2 THEN 0.8 ELSE 0.4 END + 0.2 + CASE WHEN length(answer) BETWEEN 200 AND 2000 THEN 0.8 ELSE 0.6 END) / 3, 6) AS confidence,
  CASE WHEN citations >= 2 THEN 'Passed validation' ELSE 'Failed validation' END AS reason FROM c
""")
def response_audit(spark, sf):
    return conversations.audited(_answers(spark, sf), "answer", F.lit(None).cast("double")).drop("answer")


@query("t10_full_text_match", """
WITH t AS (SELECT doc_id, list_filter(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''), lambda x: x IN ('the', 'and', 'of')) AS hits FROM documents)
SELECT doc_id, len(hits)::BIGINT AS hits FROM t WHERE len(list_distinct(hits)) = 3
""")
def full_text_match(spark, sf):
    return _text_index(spark, sf).match_all(["the", "and", "of"])


def _text_index(spark, sf):
    return text_index.build(st.documents(spark, sf).select("doc_id", "text"), "doc_id", "text", scratch(spark, "terms"))


@query("t10_phrase_match", """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))::BIGINT AS hits FROM t)
SELECT doc_id, hits FROM h WHERE hits > 0
""")
def phrase_match(spark, sf):
    return _text_index(spark, sf).match_phrase(["of", "the"])


@query("t11_conversation_report", f"""
WITH m AS (SELECT conv_id, role, {INTENT_SQL} AS intent, {TOPIC_SQL} AS topics FROM chat_prompts WHERE role = 'user')
SELECT intent, count(*) AS messages, count(DISTINCT conv_id) AS sessions, count(*) FILTER (topics <> '') AS with_topics FROM m GROUP BY intent
""")
def conversation_report(spark, sf):
    return conversations.intent_report(st.chat_prompts(spark, sf), "conv_id", "message")


@query("t12_message_context", f"""
WITH m AS (SELECT conv_id, turn, {INTENT_SQL} AS intent FROM chat_prompts WHERE role = 'user'),
s AS (SELECT string_agg(CAST(score_id AS VARCHAR), ',' ORDER BY score_id) AS ids FROM (SELECT score_id FROM composite_scores ORDER BY score_id LIMIT 10)),
d AS (SELECT string_agg(CAST(definition_id AS VARCHAR), ',' ORDER BY definition_id) AS ids FROM (SELECT definition_id FROM metric_definitions ORDER BY definition_id LIMIT 50))
SELECT conv_id, turn, intent, (SELECT ids FROM s) AS score_ids, CASE WHEN intent IN ('explain', 'data_inquiry') THEN (SELECT ids FROM d) END AS definition_ids FROM m
""")
def message_context(spark, sf):
    asked = st.chat_prompts(spark, sf).where("role = 'user'").select("conv_id", "turn", tx.intent(F.col("message")).alias("intent"))
    joined = lambda df, c: df.orderBy(c).limit(50 if c == "definition_id" else 10).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")).scalar()
    scores = joined(st.composite_scores(spark, sf).select("score_id"), "score_id")
    definitions = joined(st.metric_definitions(spark, sf).select("definition_id"), "definition_id")
    return asked.withColumns({
        "score_ids": scores, "definition_ids": F.when(F.col("intent").isin("explain", "data_inquiry"), definitions)
    })


@query("u03_pluggable_source", "SELECT source, country, year, data FROM feed_payloads")
def pluggable_source(spark, sf):
    path = scratch(spark, "feeds")
    feeds.land(st.feed_payloads(spark, sf), path)
    spark.dataSource.register(LandedFeed)
    return spark.read.format("landed_feed").option("path", path).load()


@query("u03_pruned_source", "SELECT source, country, year, data FROM feed_payloads WHERE source IN ('IEA', 'IMF') AND country IS NOT NULL")
def pruned_source(spark, sf):
    path = scratch(spark, "feeds")
    feeds.land(st.feed_payloads(spark, sf), path)
    spark.dataSource.register(LandedFeed)
    with runner.options(spark, FILTERS):
        rows = spark.read.format("landed_feed").option("path", path).option("prune", "true").load()
        return cut_lineage(rows.where(F.col("source").isin("IEA", "IMF") & F.col("country").isNotNull()))


@query("u03_streamed_source", "SELECT source, country, year, data FROM feed_payloads")
def streamed_source(spark, sf):
    """Responses of two sources land, then those of the others; a run of the stream after each."""
    base = scratch(spark, "feeds")
    spark.dataSource.register(LandedFeed)
    payloads = st.feed_payloads(spark, sf)
    first = F.col("source").isin("IEA", "EIA")
    for part in (payloads.where(first), payloads.where(~first)):
        part.write.mode("append").partitionBy("source").json(f"{base}/landing")
        stream = spark.readStream.format("landed_feed").option("path", f"{base}/landing").load()
        runner.append_all(stream, f"{base}/out", f"{base}/checkpoint")
    return runner.read_appended(spark, f"{base}/out")


@query("u04_table_valued_chunker", f"""
WITH w AS (SELECT conv_id, turn, {WORDS_SQL.format('text')} AS w FROM conversations),
c AS (SELECT conv_id, turn, list_transform(range(0, len(w), 30), lambda i: array_to_string(w[i + 1:i + 40], ' ')) AS chunks FROM w)
SELECT conv_id, turn, CAST(unnest(range(len(chunks))) AS BIGINT) AS position, unnest(chunks) AS chunk FROM c
""")
def table_valued_chunker(spark, sf):
    msgs = st.table(spark, sf, "conversations")
    chunks = retrieval.WordChunker(F.col("text").outer(), F.lit(40), F.lit(10))
    return msgs.lateralJoin(chunks).select("conv_id", "turn", "position", "chunk")
