"""Views over the test tables, written once in Spark and once in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.chunking import stride_documents
from quire.session import spread
from quire.sources.pages import split_pages

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
NOW = "2024-01-31 00:00:00"

SQL = {
    "user_documents": """
        SELECT doc_id AS document_id, source AS user_id, 'doc_' || doc_id || '.pdf' AS filename,
               split_part(text, chr(10), 1) AS title, lang || ' document from ' || source AS description,
               n_chars AS file_size, sha256(text) AS file_hash, lang, text,
               CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' ELSE 'completed' END AS status,
               CASE doc_id % 7 WHEN 0 THEN 'downloading' WHEN 1 THEN 'extracting' WHEN 2 THEN 'chunking'
                    WHEN 3 THEN 'embedding' WHEN 4 THEN 'storing' WHEN 5 THEN 'resting' END AS processing_stage,
               CASE WHEN doc_id % 20 = 0 THEN 'parsing failed at ' || doc_id END AS error_message,
               [lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END] AS tags,
               CAST((len(string_split(text, chr(10))) + 19) // 20 AS INT) AS total_pages,
               CAST(n_chars // 900 + 1 AS INT) AS total_chunks,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
               CASE WHEN doc_id % 10 > 2 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_seconds(n_chars % 600) END
                   AS processing_completed_at
        FROM documents""",
    "doc_pages": """
        SELECT * FROM (
            SELECT document_id, user_id, CAST(p + 1 AS INT) AS page_number,
                   regexp_replace(array_to_string(lines[p * 20 + 1 : p * 20 + 20], chr(10)), '^\\s+|\\s+$', '', 'g') AS text
            FROM (SELECT document_id, user_id, lines, unnest(range((len(lines) + 19) // 20)) AS p
                  FROM (SELECT document_id, user_id, string_split(text, chr(10)) AS lines FROM user_documents)))
        WHERE text <> ''""",
    "chunks": """
        SELECT document_id || '-chunk-' || chunk_index AS chunk_id, * FROM (
            SELECT document_id, user_id, page_number, page_pos, chunk_text,
                   CAST(ceil(length(chunk_text) / 4.0) AS INT) AS chunk_tokens,
                   row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_pos) - 1 AS chunk_index
            FROM (SELECT document_id, user_id, page_number, i AS page_pos,
                         array_to_string(w[i * 160 + 1 : i * 160 + 200], ' ') AS chunk_text
                  FROM (SELECT document_id, user_id, page_number, w,
                               unnest(range(greatest(1, CAST(ceil((len(w) - 40) / 160.0) AS BIGINT)))) AS i
                        FROM (SELECT document_id, user_id, page_number,
                                     list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w
                              FROM doc_pages))))""",
    "chunk_vectors": """
        SELECT vec_id AS chunk_id, label AS user_id, vec_id % 50 AS document_id, CAST(vec_id % 40 + 1 AS INT) AS page_number,
               CAST(embedding AS DOUBLE[]) AS embedding
        FROM embeddings""",
    "pair_hits": """
        SELECT query_id, chunk_id, document_id, page_number, user_id, similarity,
               row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
        FROM (SELECT q.chunk_id AS query_id, c.chunk_id, c.document_id, c.page_number, c.user_id,
                     round(list_cosine_similarity(c.embedding, q.embedding), 6) AS similarity
              FROM chunk_vectors c JOIN chunk_vectors q ON c.user_id = q.user_id AND c.chunk_id <> q.chunk_id)""",
    "conv_texts": """
        SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "query_log": """
        SELECT event_id AS query_id, user_id, ts AS created_at,
               ['How to submit the form for ', 'What is the meaning of ', 'Compare and analyze ', 'Define and compare ',
                'Please list the steps to complete ', 'Tell me of ', 'Explain the structure of ',
                'What is the procedure for '][event_id % 8 + 1] || coalesce(c.text, event_type) AS query_text,
               (event_id % 101) / 100.0::DOUBLE AS confidence_score,
               CAST(round(value * 10) AS BIGINT) AS processing_time_ms, event_type <> 'error' AS success,
               list_transform(range(event_id % 4), lambda i: {
                   'document_name': 'doc_' || ((event_id * 7 + i * 13) % 97) || '.pdf',
                   'page_number': CAST((event_id + i) % 40 + 1 AS INT),
                   'confidence': ((event_id * 3 + i * 31) % 101) / 100.0::DOUBLE}) AS sources
        FROM events LEFT JOIN conv_texts c ON c.conv_id = event_id % 128""",
    "usage_log": """
        SELECT event_id, ts, user_id,
               ['gpt-4', 'gpt-4-turbo', 'gpt-3.5-turbo', 'local-7b'][event_id % 4 + 1] AS model,
               event_id % 900 + 100 AS prompt_tokens, event_id % 300 AS completion_tokens,
               CAST(round(value * 10) AS BIGINT) AS latency_ms, event_type <> 'error' AS ok
        FROM events""",
    "manual_lines": """
        SELECT p_partkey // 200 AS document_id, CAST((p_partkey % 200) // 20 + 1 AS INT) AS page_number,
               CAST(p_partkey % 20 AS INT) AS line_no,
               CASE p_partkey % 11
                   WHEN 0 THEN (p_partkey % 9 + 1) || '.' || p_size || ' ' || p_name
                   WHEN 1 THEN 'Chapter ' || p_size || ': ' || p_name
                   WHEN 2 THEN 'Appendix ' || chr(97 + p_size % 26) || ' ' || p_name
                   WHEN 3 THEN chr(97 + p_size % 26) || '. ' || p_name || ' item'
                   WHEN 4 THEN 'iv. ' || p_name || ' scope'
                   WHEN 5 THEN 'Step ' || (p_size % 9) || ': sign the ' || p_name
                   WHEN 6 THEN 'Procedure: to complete the ' || p_name || ', see section ' || (p_size % 9) || '.2 (see Form ' || p_size || ').'
                   WHEN 7 THEN 'A ' || p_name || ' is defined as a part of ' || p_brand || ', page ' || p_size || '.'
                   WHEN 8 THEN (p_partkey % 9 + 1) || '.' || (p_size % 5) || '.1 ' || p_name || ' details'
                   WHEN 9 THEN 'REVIEW OF PARTS'
                   ELSE 'the ' || p_name || ' was kept in ' || p_type || '.' END AS line
        FROM part""",
    "manual_pages": """
        SELECT document_id, page_number, string_agg(line, chr(10) ORDER BY line_no) AS text
        FROM manual_lines GROUP BY ALL""",
    "headers": """
        SELECT document_id, page_number, line_no AS line, m.kind AS type,
               regexp_extract(line, m.pattern, 1) AS number, trim(regexp_extract(line, m.pattern, 2)) AS title
        FROM (SELECT *, CASE
                WHEN regexp_matches(line, '^(\\d+(?:\\.\\d+){0,5})\\s+(.+)')
                    THEN {'kind': 'hierarchical', 'pattern': '^(\\d+(?:\\.\\d+){0,5})\\s+(.+)'}
                WHEN regexp_matches(line, '(?i)^(?:chapter|ch\\.?)\\s+(\\d+)[\\s:]+(.+)')
                    THEN {'kind': 'chapter', 'pattern': '(?i)^(?:chapter|ch\\.?)\\s+(\\d+)[\\s:]+(.+)'}
                WHEN regexp_matches(line, '(?i)^(?:appendix|app\\.?)\\s+([a-z])\\s+(.+)')
                    THEN {'kind': 'appendix', 'pattern': '(?i)^(?:appendix|app\\.?)\\s+([a-z])\\s+(.+)'}
                WHEN regexp_matches(line, '(?i)^([a-z])\\.\\s+(.+)')
                    THEN {'kind': 'letter_section', 'pattern': '(?i)^([a-z])\\.\\s+(.+)'}
                WHEN regexp_matches(line, '(?i)^([ivx]+)\\.\\s+(.+)')
                    THEN {'kind': 'roman', 'pattern': '(?i)^([ivx]+)\\.\\s+(.+)'}
                WHEN regexp_matches(line, '(?i)^(?:step)\\s+(\\d+)[\\s:]+(.+)')
                    THEN {'kind': 'step', 'pattern': '(?i)^(?:step)\\s+(\\d+)[\\s:]+(.+)'} END AS m
              FROM (SELECT document_id, page_number, line_no, trim(line) AS line FROM manual_lines))
        WHERE m IS NOT NULL""",
    "leveled_headers": """
        SELECT *, CASE WHEN type = 'hierarchical' THEN length(number) - length(replace(number, '.', ''))
                       WHEN type IN ('letter_section', 'roman') THEN 1 WHEN type = 'step' THEN 2 ELSE 0 END AS level,
               CASE WHEN type = 'hierarchical' AND contains(number, '.') THEN regexp_replace(number, '\\.[^.]+$', '') END AS parent
        FROM headers""",
    "section_map": """
        SELECT document_id, number, arg_max(title, page_number * 1000 + line) AS title,
               arg_max(level, page_number * 1000 + line) AS level, arg_max(type, page_number * 1000 + line) AS type,
               -- arg_max skips null values, so the last parent is picked through a wrapping list
               arg_max([parent], page_number * 1000 + line)[1] AS parent,
               min(page_number * 1000 + line) AS first_at
        FROM leveled_headers GROUP BY document_id, number""",
}
NEEDS = {
    "doc_pages": ("user_documents",), "chunks": ("doc_pages",), "pair_hits": ("chunk_vectors",),
    "query_log": ("conv_texts",), "manual_pages": ("manual_lines",), "headers": ("manual_lines",),
    "leveled_headers": ("headers",), "section_map": ("leveled_headers",),
}


def with_views(sql: str, names) -> str:
    """Put the needed views in front of a statement; `WITH RECURSIVE` parts may follow them."""
    ordered: list[str] = []

    def add(name):
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[len('WITH '):]}"
    return f"WITH {views}\n{body}"


def pick(values, index) -> "F.Column":
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Views:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A test table. The text tables are one small file each, which one core would read and cut alone."""
        rows = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        keys = {"documents": "doc_id", "events": "event_id"}
        return spread(rows, keys[name]) if name in keys else rows

    @cached_property
    def user_documents(self) -> DataFrame:
        i = F.col("doc_id")
        created = F.timestamp_seconds(F.lit(EPOCH) + i * 60)
        done = F.timestamp_seconds(F.lit(EPOCH) + i * 60 + F.col("n_chars") % 600)
        return self.table("documents").select(
            i.alias("document_id"), F.col("source").alias("user_id"),
            F.concat(F.lit("doc_"), i.cast("string"), F.lit(".pdf")).alias("filename"),
            F.split("text", "\n")[0].alias("title"),
            F.concat("lang", F.lit(" document from "), "source").alias("description"),
            F.col("n_chars").alias("file_size"), F.sha2("text", 256).alias("file_hash"), "lang", "text",
            F.when(i % 10 == 0, "failed").when(i % 10 == 1, "processing").when(i % 10 == 2, "pending")
            .otherwise("completed").alias("status"),
            pick(["downloading", "extracting", "chunking", "embedding", "storing", "resting", None], i % 7).alias("processing_stage"),
            F.when(i % 20 == 0, F.concat(F.lit("parsing failed at "), i.cast("string"))).alias("error_message"),
            F.array("lang", F.when(F.col("n_chars") > 1000, "long").otherwise("short")).alias("tags"),
            F.floor((F.size(F.split("text", "\n")) + 19) / 20).cast("int").alias("total_pages"),
            (F.floor(F.col("n_chars") / 900) + 1).cast("int").alias("total_chunks"),
            created.alias("created_at"), F.when(i % 10 > 2, done).alias("processing_completed_at"),
        )

    @cached_property
    def doc_pages(self) -> DataFrame:
        return split_pages(self.user_documents.select("document_id", "user_id", "text"), 20)

    @cached_property
    def chunks(self) -> DataFrame:
        return stride_documents(self.user_documents.select("document_id", "user_id", "text"), 200, 40)

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        i = F.col("vec_id")
        return self.table("embeddings").select(
            i.alias("chunk_id"), F.col("label").alias("user_id"), (i % 50).alias("document_id"),
            (i % 40 + 1).cast("int").alias("page_number"), "embedding",
        )

    @cached_property
    def query_vectors(self) -> DataFrame:
        return self.chunk_vectors.select(F.col("chunk_id").alias("query_id"), "user_id", "embedding")

    @cached_property
    def conv_texts(self) -> DataFrame:
        asked = self.table("conversations").filter(F.col("role") == "user")
        return asked.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))

    @cached_property
    def query_log(self) -> DataFrame:
        i = F.col("event_id")
        opening = pick([
            "How to submit the form for ", "What is the meaning of ", "Compare and analyze ", "Define and compare ",
            "Please list the steps to complete ", "Tell me of ", "Explain the structure of ", "What is the procedure for ",
        ], i % 8)
        named = F.transform(
            F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (i % 4).cast("int")),
            lambda n: F.struct(
                F.concat(F.lit("doc_"), ((i * 7 + n * 13) % 97).cast("string"), F.lit(".pdf")).alias("document_name"),
                ((i + n) % 40 + 1).cast("int").alias("page_number"),
                (((i * 3 + n * 31) % 101) / 100.0).alias("confidence"),
            ),
        )
        events = self.table("events").withColumn("_c", i % 128)
        texts = self.conv_texts.withColumnRenamed("conv_id", "_c")
        return events.join(texts, "_c", "left").select(
            i.alias("query_id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"),
            F.concat(opening, F.coalesce("text", "event_type")).alias("query_text"),
            ((i % 101) / 100.0).alias("confidence_score"),
            F.round(F.col("value") * 10).cast("bigint").alias("processing_time_ms"),
            (F.col("event_type") != "error").alias("success"), named.alias("sources"),
        )

    @cached_property
    def usage_log(self) -> DataFrame:
        i = F.col("event_id")
        return self.table("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
            pick(["gpt-4", "gpt-4-turbo", "gpt-3.5-turbo", "local-7b"], i % 4).alias("model"),
            (i % 900 + 100).alias("prompt_tokens"), (i % 300).alias("completion_tokens"),
            F.round(F.col("value") * 10).cast("bigint").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"),
        )

    @cached_property
    def manual_lines(self) -> DataFrame:
        k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")

        def text(*parts):
            return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

        letter = F.chr(F.lit(97) + size % 26)
        kinds = [
            text(k % 9 + 1, ".", size, " ", name), text("Chapter ", size, ": ", name),
            text("Appendix ", letter, " ", name), text(letter, ". ", name, " item"), text("iv. ", name, " scope"),
            text("Step ", size % 9, ": sign the ", name),
            text("Procedure: to complete the ", name, ", see section ", size % 9, ".2 (see Form ", size, ")."),
            text("A ", name, " is defined as a part of ", F.col("p_brand"), ", page ", size, "."),
            text(k % 9 + 1, ".", size % 5, ".1 ", name, " details"), F.lit("REVIEW OF PARTS"),
        ]
        line = None
        for n, kind in enumerate(kinds):
            line = F.when(k % 11 == n, kind) if line is None else line.when(k % 11 == n, kind)
        return self.table("part").select(
            F.floor(k / 200).alias("document_id"), (F.floor(k % 200 / 20) + 1).cast("int").alias("page_number"),
            (k % 20).cast("int").alias("line_no"),
            line.otherwise(text("the ", name, " was kept in ", F.col("p_type"), ".")).alias("line"),
        )

    @cached_property
    def manual_pages(self) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # twenty lines a page
        return self.manual_lines.groupBy("document_id", "page_number").agg(lines.alias("_l")).select(
            "document_id", "page_number", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))
