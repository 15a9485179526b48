"""Registration, storing, rules, filters, access, paging and deletion."""

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import NOW, pick
from quire.functions import status
from quire.operators import listing, quality
from quire.sources import tables


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


_STAMP = "'%Y-%m-%d %H:%M:%S'"


# --- registering and storing ---------------------------------------------------

@check("register_documents", "A9", """
    SELECT document_id, user_id, CASE WHEN document_id % 3 = 0 THEN 'doc_' || document_id ELSE title END AS title,
           CASE WHEN document_id % 4 > 0 THEN description END AS description, 'pending' AS status, 0 AS total_pages, 0 AS total_chunks,
           len(CASE WHEN document_id % 5 = 0 THEN [] ELSE tags END) AS n_tags
    FROM user_documents
""", ("user_documents",))
def register_documents(v):
    i = F.col("document_id")
    uploads = v.user_documents.withColumns({
        "title": F.when(i % 3 == 0, "").otherwise(F.col("title")),
        "description": F.when(i % 4 == 0, "").otherwise(F.col("description")),
        "tags": F.when(i % 5 != 0, F.col("tags")),
    })
    return tables.register_documents(uploads).select(
        "document_id", "user_id", "title", "description", "status", "total_pages", "total_chunks",
        F.size("tags").cast("bigint").alias("n_tags"))


_RAW_CHUNKS = """
    raw AS (SELECT document_id, CASE WHEN document_id % 13 = 0 THEN 'nobody' ELSE user_id END AS user_id, page_number,
                   page_number - 1 AS chunk_index, CASE WHEN page_number % 3 = 0 THEN '   ' ELSE text END AS chunk_text,
                   document_id % 11 > 0 AS embedded, CASE WHEN document_id % 2 = 0 THEN 7 END AS chunk_tokens,
                   CASE WHEN document_id % 3 = 0 THEN 0 WHEN document_id % 3 = 1 THEN 50 END AS page_position_end
            FROM doc_pages)"""


def raw_chunks(v):
    i = F.col("document_id")
    return v.doc_pages.select(
        "document_id", F.when(i % 13 == 0, "nobody").otherwise(F.col("user_id")).alias("user_id"), "page_number",
        (F.col("page_number") - 1).cast("bigint").alias("chunk_index"),
        F.when(F.col("page_number") % 3 == 0, "   ").otherwise(F.col("text")).alias("chunk_text"),
        F.when(i % 11 > 0, F.array(F.lit(0.5), F.lit(0.25)).cast("array<float>")).alias("embedding"),
        F.when(i % 2 == 0, 7).alias("chunk_tokens"),
        F.when(i % 3 == 0, 0).when(i % 3 == 1, 50).alias("page_position_end"),
    )


@check("convert_chunks", "A8", f"""
    WITH {_RAW_CHUNKS}
    SELECT document_id || '-chunk-' || chunk_index AS chunk_id, coalesce(chunk_tokens, 0) AS chunk_tokens, 0 AS page_position_start,
           CAST(coalesce(nullif(page_position_end, 0), length(chunk_text)) AS INT) AS page_position_end
    FROM raw WHERE embedded AND trim(chunk_text) <> ''
""", ("doc_pages",))
def convert_chunks(v):
    return tables.convert_chunks(raw_chunks(v))[0].select("chunk_id", "chunk_tokens", "page_position_start", "page_position_end")


@check("chunk_rejects", "A7 A8 C9", f"""
    WITH {_RAW_CHUNKS}
    SELECT reason, count(*) AS rows FROM (
        SELECT CASE WHEN NOT embedded AND trim(chunk_text) = '' THEN 'missing embedding|missing text'
                    WHEN NOT embedded THEN 'missing embedding' WHEN trim(chunk_text) = '' THEN 'missing text' ELSE 'stored' END AS reason
        FROM raw WHERE user_id <> 'nobody')
    GROUP BY reason
""", ("doc_pages",))
def chunk_rejects(v):
    valid, rejects = tables.convert_chunks(listing.owned(raw_chunks(v), v.user_documents))
    reasons = rejects.select(F.array_join("violations", "|").alias("reason")).unionByName(valid.select(F.lit("stored").alias("reason")))
    return reasons.groupBy("reason").agg(F.count("*").alias("rows"))


@check("upsert_preferences", "A11 B12", """
    WITH changes AS (SELECT user_id, ts, ['concise', 'detailed', 'academic', 'casual'][event_id % 4 + 1] AS style, event_id % 20 + 1 AS results FROM events),
    latest AS (SELECT user_id, max(ts) AS ts, arg_max(style, ts) AS style, arg_max(results, ts) AS results FROM changes GROUP BY user_id),
    stored AS (SELECT c_custkey AS user_id, 'casual' AS style, 5 AS results FROM customer)
    SELECT user_id, coalesce(l.style, s.style) AS style, CAST(coalesce(l.results, s.results) AS BIGINT) AS results, l.ts IS NOT NULL AS changed
    FROM stored s FULL JOIN latest l USING (user_id)
""")
def upsert_preferences(v):
    i = F.col("event_id")
    changes = v.table("events").select(
        "user_id", F.element_at(F.array(*[F.lit(x) for x in ("concise", "detailed", "academic", "casual")]), (i % 4 + 1).cast("int")).alias("style"),
        (i % 20 + 1).alias("results"), F.col("ts").cast("timestamp").alias("updated_at"))
    stored = v.table("customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("casual").alias("style"), F.lit(5).cast("bigint").alias("results"),
        F.lit(None).cast("timestamp").alias("updated_at"))
    return tables.upsert_preferences(stored, changes).select("user_id", "style", "results", F.col("updated_at").isNotNull().alias("changed"))


@check("preference_defaults", "B12", """
    SELECT DISTINCT user_id, 'ollama' AS embedding_provider, CASE WHEN c_custkey IS NULL THEN 'ollama' ELSE 'openai' END AS llm_provider,
           'detailed' AS default_response_style, CASE WHEN c_custkey IS NULL THEN 10 ELSE c_custkey % 20 + 1 END AS max_results_per_query, 'en' AS language
    FROM events LEFT JOIN customer ON user_id * 3 = c_custkey
""")
def preference_defaults(v):
    stored = v.table("customer").filter(F.col("c_custkey") % 3 == 0).select(
        F.floor(F.col("c_custkey") / 3).alias("user_id"), F.lit(None).cast("string").alias("embedding_provider"),
        F.lit("openai").alias("llm_provider"), F.lit(None).cast("string").alias("default_response_style"),
        (F.col("c_custkey") % 20 + 1).alias("max_results_per_query"), F.lit(None).cast("string").alias("language"))
    return tables.preferences_of(v.table("events").select("user_id").distinct(), stored)


@check("update_document_stats", "A12", f"""
    SELECT document_id, CASE WHEN n > 0 THEN 'completed' ELSE status END AS status, CAST(coalesce(n, total_chunks) AS INT) AS total_chunks,
           strftime(CASE WHEN n > 0 THEN TIMESTAMP '{NOW}' ELSE created_at END, {_STAMP}) AS updated_at
    FROM user_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunk_vectors GROUP BY document_id) USING (document_id)
""", ("user_documents", "chunk_vectors"))
def update_document_stats(v):
    documents = v.user_documents.select("document_id", "status", "total_chunks", F.col("created_at").alias("updated_at"))
    return tables.update_document_stats(documents, v.chunk_vectors, NOW).withColumn("updated_at", stamp("updated_at"))


_REQUESTED = "req AS (SELECT 'src' || (doc_id % 4 * 5 + doc_id % 5) AS user_id, doc_id AS document_id FROM labels WHERE toxic = 1 OR quality = 0)"


def requested(v):
    i = F.col("doc_id")
    asked = v.table("labels").filter((F.col("toxic") == 1) | (F.col("quality") == 0))
    return asked.select(F.concat(F.lit("src"), (i % 4 * 5 + i % 5).cast("string")).alias("user_id"), i.alias("document_id"))


@check("delete_documents", "A13", f"""
    WITH {_REQUESTED}, gone AS (SELECT document_id FROM user_documents SEMI JOIN req USING (user_id, document_id))
    SELECT user_id, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks
    FROM user_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) USING (document_id)
    WHERE document_id NOT IN (SELECT document_id FROM gone) GROUP BY user_id
""", ("user_documents", "chunks"))
def delete_documents(v):
    documents, chunks = tables.delete_documents(requested(v), v.user_documents.select("document_id", "user_id"), v.chunks.select("document_id", "user_id"))
    d = documents.groupBy("user_id").agg(F.count("*").alias("documents"))
    return d.join(chunks.groupBy("user_id").agg(F.count("*").alias("chunks")), "user_id", "left")


@check("delete_users", "A14", """
    WITH confirmed AS (SELECT DISTINCT user_id FROM user_documents WHERE length(user_id) = 4)
    SELECT 'documents' AS table_name, count(*) AS rows FROM user_documents ANTI JOIN confirmed USING (user_id)
    UNION ALL SELECT 'chunks', count(*) FROM chunks ANTI JOIN confirmed USING (user_id)
""", ("user_documents", "chunks"))
def delete_users(v):
    users = v.user_documents.select("user_id").distinct()
    asked = users.withColumn("confirm_user_id", F.when(F.length("user_id") == 4, F.col("user_id")).otherwise("no"))
    left = tables.delete_users(asked, {"documents": v.user_documents.select("user_id"), "chunks": v.chunks.select("user_id")})
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


# --- rules ------------------------------------------------------------------------

@check("document_rules", "B8", """
    SELECT document_id, concat_ws('|', CASE WHEN total_pages * 900 - 900 NOT BETWEEN 1 AND 2000 THEN 'pages' END,
        CASE WHEN file_size * 40000 NOT BETWEEN 1 AND 104857600 THEN 'file_size' END,
        CASE WHEN lang IN ('de', 'fr') THEN 'status' END) AS violations
    FROM user_documents
""", ("user_documents",))
def document_rules(v):
    suspect = v.user_documents.select(
        "document_id", (F.col("total_pages") * 900 - 900).alias("total_pages"), (F.col("file_size") * 40000).alias("file_size"),
        F.when(F.col("lang").isin("de", "fr"), F.col("lang")).otherwise(F.col("status")).alias("status"))
    return quality.with_violations(suspect, quality.document_rules()).select("document_id", F.array_join("violations", "|").alias("violations"))


@check("chunk_rules", "B8", """
    SELECT chunk_id, concat_ws('|', CASE WHEN chunk_index - 1 < 0 THEN 'chunk_index' END, CASE WHEN page_number - 2 <= 0 THEN 'page_number' END,
        CASE WHEN page_pos <= 0 THEN 'positions' END, CASE WHEN chunk_tokens * 4 NOT BETWEEN 1 AND 1000 THEN 'chunk_tokens' END) AS violations
    FROM chunks
""", ("chunks",))
def chunk_rules(v):
    suspect = v.chunks.select(
        "chunk_id", (F.col("chunk_index") - 1).alias("chunk_index"), (F.col("page_number") - 2).alias("page_number"),
        F.lit(0).alias("page_position_start"), F.col("page_pos").alias("page_position_end"), (F.col("chunk_tokens") * 4).alias("chunk_tokens"))
    return quality.with_violations(suspect, quality.chunk_rules()).select("chunk_id", F.array_join("violations", "|").alias("violations"))


@check("rule_counts", "B8", """
    SELECT rule, count(*) AS rows FROM (
        SELECT 'confidence' AS rule FROM query_log WHERE confidence_score * 1.2 NOT BETWEEN 0 AND 1
        UNION ALL SELECT 'duplicate upload' FROM (SELECT 1 FROM user_documents GROUP BY lang, file_hash HAVING count(*) > 1))
    GROUP BY rule
""", ("query_log", "user_documents"))
def rule_counts(v):
    log = v.query_log.select((F.col("confidence_score") * 1.2).alias("confidence_score"))
    repeats = quality.duplicate_keys(v.user_documents, ["lang", "file_hash"])
    return quality.violation_counts(log, quality.query_log_rules()).unionByName(
        repeats.agg(F.count("*").alias("rows")).filter(F.col("rows") > 0).select(F.lit("duplicate upload").alias("rule"), "rows"))


@check("request_rules", "B9", """
    SELECT conv_id, turn, concat_ws('|', CASE WHEN length(repeat(text, CAST(turn AS INT) + 1)) NOT BETWEEN 1 AND 2000 THEN 'query_length' END,
        CASE WHEN role = 'system' THEN 'user_id_alphanumeric' END, CASE WHEN conv_id % 30 > 20 THEN 'document_ids_count' END,
        CASE WHEN turn * 6 NOT BETWEEN 1 AND 20 THEN 'max_results' END, CASE WHEN role = 'assistant' THEN 'response_style' END) AS violations
    FROM conversations
""")
def request_rules(v):
    asked = v.table("conversations").select(
        "conv_id", "turn", F.repeat("text", (F.col("turn") + 1).cast("int")).alias("query"),
        F.when(F.col("role") == "system", F.lit("a-b")).otherwise(F.concat(F.lit("u"), F.col("conv_id").cast("string"))).alias("user_id"),
        F.transform(F.slice(F.sequence(F.lit(1), F.lit(30)), F.lit(1), (F.col("conv_id") % 30).cast("int")), lambda i: i.cast("string")).alias("document_ids"),
        (F.col("turn") * 6).alias("max_results"),
        F.when(F.col("role") == "assistant", "loud").when(F.col("role") == "user", "concise").alias("response_style"))
    checked = quality.with_violations(asked, quality.question_rules())
    return checked.select("conv_id", "turn", F.array_join("violations", "|").alias("violations"))


@check("upload_rules", "B9", """
    SELECT document_id, concat_ws('|', CASE WHEN length(title) % 2 = 0 THEN 'user_id_alphanumeric' END,
        CASE WHEN length(text) NOT BETWEEN 1 AND 200 THEN 'title_length' END, CASE WHEN length(text) > 1000 THEN 'description_length' END,
        CASE WHEN total_pages + 2 > 10 THEN 'tags_count' END, CASE WHEN length(description) * 2 > 50 THEN 'tags_length' END) AS violations
    FROM user_documents
""", ("user_documents",))
def upload_rules(v):
    uploads = v.user_documents.select(
        "document_id", F.when(F.length("title") % 2 == 0, "no\nname").otherwise(F.col("user_id")).alias("user_id"),
        F.col("text").alias("title"), F.col("text").alias("description"),
        F.concat(F.array(F.repeat("description", F.lit(2)), F.lit("x")), F.array_repeat(F.lit("t"), F.col("total_pages"))).alias("tags"))
    checked = quality.with_violations(uploads, quality.upload_rules())
    return checked.select("document_id", F.array_join("violations", "|").alias("violations"))


@check("setting_rules", "B9", """
    SELECT p_partkey, concat_ws('|', CASE WHEN p_size * 20 - 100 NOT BETWEEN 1 AND 500 THEN 'max_file_size' END,
        CASE WHEN p_size * 50 NOT BETWEEN 100 AND 2000 THEN 'chunk_size' END, CASE WHEN p_size * 15 - 60 NOT BETWEEN 0 AND 500 THEN 'chunk_overlap' END,
        CASE WHEN p_size - 3 < 1 THEN 'page' END, CASE WHEN p_size * 3 NOT BETWEEN 1 AND 100 THEN 'limit' END) AS violations
    FROM part
""")
def setting_rules(v):
    s = F.col("p_size")
    given = v.table("part").select("p_partkey", (s * 20 - 100).alias("max_file_size"), (s * 50).alias("chunk_size"),
                                   (s * 15 - 60).alias("chunk_overlap"), (s - 3).alias("page"), (s * 3).alias("limit"))
    checked = quality.with_violations(given, {**quality.setting_rules(), **quality.paging_rules()})
    return checked.select("p_partkey", F.array_join("violations", "|").alias("violations"))


# --- filters and access -----------------------------------------------------------

@check("user_isolation", "B1", "SELECT document_id, filename FROM user_documents WHERE user_id = 'src3'", ("user_documents",))
def user_isolation(v):
    return listing.of_user(v.user_documents, "src3").select("document_id", "filename")


@check("search_documents", "B2", """
    SELECT document_id, title FROM user_documents
    WHERE (title ILIKE '%en %' OR description ILIKE '%en %' OR filename ILIKE '%en %') AND status = 'completed'
      AND list_has_all(tags, ['en', 'long'])
""", ("user_documents",))
def search_documents(v):
    return listing.search_documents(v.user_documents, "EN ", "completed", ["en", "long"]).select("document_id", "title")


@check("between_dates", "B3", """
    SELECT user_id, count(*) AS queries FROM query_log
    WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY user_id
""", ("query_log",))
def between_dates(v):
    from datetime import datetime
    rows = listing.between_dates(v.query_log, datetime(2024, 1, 10), datetime(2024, 1, 20, 12))
    return rows.groupBy("user_id").agg(F.count("*").alias("queries"))


@check("owned_lookup", "B7", """
    SELECT query_id, confidence_score FROM query_log JOIN (SELECT event_id AS query_id, event_id % 150 AS user_id FROM events) USING (query_id, user_id)
""", ("query_log",))
def owned_lookup(v):
    asked = v.table("events").select(F.col("event_id").alias("query_id"), (F.col("event_id") % 150).alias("user_id"))
    return v.query_log.join(asked, ["query_id", "user_id"]).select("query_id", "confidence_score")


@check("denied_documents", "C8 G3", f"""
    WITH {_REQUESTED} SELECT user_id, document_id FROM req ANTI JOIN user_documents USING (user_id, document_id)
""", ("user_documents",))
def denied_documents(v):
    return listing.denied_documents(requested(v), v.user_documents).select("user_id", "document_id")


@check("owned_chunks", "C9", """
    SELECT user_id, count(*) AS chunks FROM (
        SELECT document_id, CASE WHEN chunk_index % 5 = 0 THEN 'src0' ELSE user_id END AS user_id FROM chunks)
    SEMI JOIN user_documents USING (document_id, user_id) GROUP BY user_id
""", ("chunks", "user_documents"))
def owned_chunks(v):
    claimed = v.chunks.select("document_id", F.when(F.col("chunk_index") % 5 == 0, "src0").otherwise(F.col("user_id")).alias("user_id"))
    return listing.owned(claimed, v.user_documents).groupBy("user_id").agg(F.count("*").alias("chunks"))


@check("duplicate_uploads", "C10", """
    SELECT document_id, first_document_id FROM (
        SELECT document_id, first_value(document_id) OVER (PARTITION BY lang, file_hash ORDER BY created_at, document_id) AS first_document_id
        FROM user_documents) WHERE document_id <> first_document_id
""", ("user_documents",))
def duplicate_uploads(v):
    uploads = v.user_documents.select("document_id", "lang", "file_hash", "created_at")
    return listing.duplicate_uploads(uploads, "lang").select("document_id", "first_document_id")


@check("new_uploads", "C10", """
    SELECT b.document_id FROM user_documents b
    ANTI JOIN (SELECT lang, file_hash FROM user_documents WHERE status = 'completed') s ON b.lang = s.lang AND b.file_hash = s.file_hash
""", ("user_documents",))
def new_uploads(v):
    return listing.new_uploads(v.user_documents, v.user_documents.filter(F.col("status") == "completed"), "lang").select("document_id")


# --- paging -------------------------------------------------------------------------

@check("page_per_user", "F1 F2 D26", f"""
    SELECT user_id, position, document_id, title, status FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY title, document_id) AS INT) AS position FROM user_documents)
    WHERE position BETWEEN 11 AND 20
""", ("user_documents",))
def page_per_user(v):
    return listing.page_per_user(v.user_documents, listing.sort_columns("title", "asc"), 2, 10).select(
        "user_id", "position", "document_id", "title", "status")


@check("page_of_documents", "F1 F2", f"""
    SELECT document_id, strftime(created_at, {_STAMP}) AS created_at FROM user_documents
    ORDER BY status DESC, document_id LIMIT 20 OFFSET 40
""", ("user_documents",))
def page_of_documents(v):
    page = listing.page_of(v.user_documents, listing.sort_columns("status", "desc"), 3, 20)
    return page.select("document_id", stamp("created_at").alias("created_at"))


@check("page_info", "F2", """
    SELECT 2 AS current_page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, count(*) AS total_items, 20 AS items_per_page,
           2 < ceil(count(*) / 20.0) AS has_next, TRUE AS has_prev
    FROM user_documents WHERE status = 'completed'
""", ("user_documents",))
def page_info(v):
    return listing.page_info(listing.search_documents(v.user_documents, status="completed"), 2, 20)


@check("chunk_page", "F3", """
    SELECT document_id, chunk_index, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS rn FROM chunks) WHERE rn BETWEEN 3 AND 4
""", ("chunks",))
def chunk_page(v):
    rows = v.chunks.withColumn("user_id", F.col("document_id"))
    return listing.page_per_user(rows, [F.asc("chunk_index")], 2, 2).select("document_id", "chunk_index", "chunk_id")


@check("activity", "G1 H14", f"""
    WITH logged AS (SELECT *, 'src' || (user_id % 20) AS owner FROM query_log), every AS (
        SELECT user_id, 'document_upload' AS type, created_at AS ts, CAST(document_id AS VARCHAR) AS item_id, title AS detail FROM user_documents
        UNION ALL SELECT user_id, 'document_processed', processing_completed_at, CAST(document_id AS VARCHAR), title FROM user_documents
                  WHERE processing_completed_at IS NOT NULL
        UNION ALL SELECT owner, 'query_processed', created_at, CAST(query_id AS VARCHAR),
                  CASE WHEN length(query_text) > 100 THEN substr(query_text, 1, 100) || '...' ELSE query_text END FROM logged)
    SELECT user_id, type, item_id, detail, position FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, type, item_id) AS INT) AS position FROM every)
    WHERE position BETWEEN 501 AND 600
""", ("user_documents", "query_log"))
def activity(v):
    log = v.query_log.withColumn("user_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")))
    rows = listing.activity(v.user_documents, log)
    return listing.page_per_user(rows, listing.newest_first(), 6, 100).select("user_id", "type", "item_id", "detail", "position")


@check("document_detail", "D30 H25", """
    SELECT document_id, coalesce(n, 0) AS live_chunks,
           CASE status WHEN 'completed' THEN 100 WHEN 'processing' THEN coalesce(map {'downloading': 10, 'extracting': 30, 'chunking': 50,
                'embedding': 70, 'storing': 90}[processing_stage], 50) ELSE 0 END AS percentage,
           CASE status WHEN 'completed' THEN 'completed' WHEN 'failed' THEN coalesce(processing_stage, 'failed') WHEN 'pending' THEN 'queued'
                ELSE CASE WHEN processing_stage = 'resting' OR processing_stage IS NULL THEN 'processing' ELSE processing_stage END END AS stage,
           CASE status WHEN 'completed' THEN 'Document ready for queries' WHEN 'failed' THEN coalesce(error_message, 'Processing failed')
                WHEN 'pending' THEN 'Document queued for processing'
                ELSE coalesce(map {'downloading': 'Downloading file from storage', 'extracting': 'Extracting text from PDF',
                    'chunking': 'Breaking document into chunks', 'embedding': 'Generating embeddings',
                    'storing': 'Storing in vector database'}[processing_stage], 'Processing document') END AS message
    FROM user_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunk_vectors GROUP BY document_id) USING (document_id)
""", ("user_documents", "chunk_vectors"))
def document_detail(v):
    return listing.document_detail(v.user_documents, v.chunk_vectors).select("document_id", "live_chunks", "progress.*")


@check("similar_queries", "H35", """
    WITH words AS (SELECT query_id, user_id, confidence_score, list_distinct(list_filter(regexp_split_to_array(
                       regexp_replace(lower(query_text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS w FROM query_log),
    asked AS (SELECT c_custkey AS request_id, c_custkey % 150 AS user_id,
                     [['submit', 'form'], ['meaning'], ['define', 'compare'], ['steps', 'list', 'the']][c_custkey % 4 + 1] AS need FROM customer)
    SELECT request_id, query_id, confidence_score, CAST(rank AS INT) AS rank FROM (
        SELECT request_id, query_id, confidence_score, row_number() OVER (PARTITION BY request_id ORDER BY confidence_score DESC, query_id) AS rank
        FROM asked JOIN words USING (user_id) WHERE len(need) > 0 AND list_has_all(w, need))
    WHERE rank <= 5
""", ("query_log",))
def similar_queries(v):
    i = F.col("c_custkey")
    asked = v.table("customer").select(
        i.alias("request_id"), (i % 150).alias("user_id"),
        pick(["Submit form", "meaning?", "define, compare; define", "list the STEPS"], i % 4).alias("query"))
    return listing.similar_queries(v.query_log, asked)


# --- status ---------------------------------------------------------------------------

@check("processing_times", "H26 H37 H38", """
    SELECT document_id, CAST(ceil(file_size * 3000 / (1024.0 * 1024.0) * 2) AS INT) AS minutes,
           CAST(round(epoch(processing_completed_at) - epoch(created_at)) AS BIGINT) AS seconds,
           CASE document_id % 5 WHEN 0 THEN 'Invalid or corrupted PDF file' WHEN 1 THEN 'Password-protected PDFs are not supported'
                WHEN 2 THEN 'PDF format not supported or file is corrupted' WHEN 3 THEN 'Password-protected PDFs are not supported'
                ELSE title END AS error
    FROM user_documents
""", ("user_documents",))
def processing_times(v):
    i = F.col("document_id")
    message = (F.when(i % 5 == 0, F.concat(F.lit("Invalid PDF: "), "title")).when(i % 5 == 1, F.concat("title", F.lit(" is encrypted")))
               .when(i % 5 == 2, F.concat(F.lit("parsing failed "), "title")).when(i % 5 == 3, F.concat(F.lit("password "), "title"))
               .otherwise(F.col("title")))
    return v.user_documents.select(
        "document_id", status.estimated_minutes(F.col("file_size") * 3000).alias("minutes"),
        status.processing_seconds(F.col("created_at"), F.col("processing_completed_at")).alias("seconds"),
        status.ingest_error(message).alias("error"))


@check("timeframes", "H27", """
    SELECT event_id, strftime(ts - INTERVAL 7 DAY, '%Y-%m-%d') AS d7, strftime(ts - INTERVAL 30 DAY, '%Y-%m-%d') AS d30,
           strftime(ts - INTERVAL 90 DAY, '%Y-%m-%d') AS d90, strftime(ts - INTERVAL 1 YEAR, '%Y-%m-%d') AS y1 FROM events
""")
def timeframes(v):
    now = F.col("ts").cast("timestamp")
    return v.table("events").select("event_id", *[
        F.date_format(status.timeframe_start(now, t), "yyyy-MM-dd").alias(n) for n, t in (("d7", "7d"), ("d30", "30d"), ("d90", "90d"), ("y1", "1y"))])
