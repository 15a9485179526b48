"""Text functions and chunking over `documents`, page by page."""

from pyspark.sql import functions as F

from checks.registry import check
from quire.functions import text as tx
from quire.operators import analytics, chunking, hooks
from quire.sources import files, pages


@check("token_counts", "H1 H2 H3 H4 U4", """
    SELECT document_id, page_number, CAST(ceil(n / 4.0) AS INT) AS estimate, CAST(ceil(w / 0.75) AS INT) AS by_words,
           w AS word_count, n AS char_count, ceil(n / 4.0) <= 200 AS fits,
           round(CASE WHEN w > 0 THEN ceil(n / 4.0) / w ELSE 0 END, 6) AS tokens_per_word,
           round(n / ceil(n / 4.0), 6) AS chars_per_token
    FROM (SELECT document_id, page_number, length(text) AS n,
                 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM doc_pages)
""", ("doc_pages",))
def token_counts(v):
    t = F.col("text")
    return v.doc_pages.withColumn("s", tx.token_stats(t)).select(
        "document_id", "page_number", F.col("s.total_tokens").alias("estimate"), tx.word_tokens(t).alias("by_words"),
        "s.word_count", "s.char_count", tx.within_limit(t, 200).alias("fits"),
        F.round("s.avg_tokens_per_word", 6).alias("tokens_per_word"),
        F.round("s.avg_chars_per_token", 6).alias("chars_per_token"),
    )


@check("clean_text", "H5", """
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\w\\s.,;:!?()-]', '', 'g'))) AS cleaned
    FROM documents
""")
def clean_text(v):
    return v.table("documents").select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("cleaned"))


_HEADING = ("(?:^(?i:Chapter|Section|Part|Article)\\s+\\d+)|(?:^\\d+\\.\\s+[A-Z])|"
            "(?:^[A-Z][A-Z\\s]{5,50}$)|(?:^[A-Z][a-z\\s]{5,50}$)")


@check("heading_lines", "H6", f"""
    SELECT document_id, count(*) AS lines,
           count(*) FILTER (length(line) BETWEEN 3 AND 200 AND regexp_matches(line, '{_HEADING}')) AS headings
    FROM (SELECT document_id, trim(unnest(string_split(text, chr(10)))) AS line FROM user_documents
          UNION ALL SELECT -1 - document_id, trim(line) FROM manual_lines)
    GROUP BY document_id
""", ("user_documents", "manual_lines"))
def heading_lines(v):
    docs = v.user_documents.select("document_id", F.explode(F.split("text", "\n")).alias("line"))
    manual = v.manual_lines.select((-1 - F.col("document_id")).alias("document_id"), "line")
    lines = docs.unionByName(manual).select("document_id", tx.strip(F.col("line")).alias("line"))
    return lines.groupBy("document_id").agg(
        F.count("*").alias("lines"), F.count_if(tx.looks_like_heading(F.col("line"))).alias("headings"))


@check("page_section_title", "T16", f"""
    SELECT document_id, page_number, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS section_title
    FROM (SELECT document_id, page_number,
                 list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5],
                     lambda x: length(x) BETWEEN 3 AND 200 AND regexp_matches(x, '{_HEADING}'))[1] AS t
          FROM (SELECT document_id, page_number, text FROM doc_pages
                UNION ALL SELECT -1 - document_id, page_number, text FROM manual_pages))
""", ("doc_pages", "manual_pages"))
def page_section_title(v):
    manual = v.manual_pages.withColumn("document_id", -1 - F.col("document_id"))
    both = v.doc_pages.select("document_id", "page_number", "text").unionByName(manual)
    return both.select("document_id", "page_number", tx.page_section_title(F.col("text")).alias("section_title"))


@check("excerpts", "H13 H14", """
    WITH cut AS (SELECT document_id, page_number, text, substr(text, 1, 200) AS c,
                        length(substr(text, 1, 200)) - instr(reverse(substr(text, 1, 200)), '.') AS p,
                        contains(substr(text, 1, 200), '.') AS has FROM doc_pages)
    SELECT document_id, page_number,
           CASE WHEN length(text) <= 200 THEN text WHEN has AND p > 140 THEN substr(c, 1, p + 1) ELSE c || '...' END AS excerpt,
           CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview
    FROM cut
""", ("doc_pages",))
def excerpts(v):
    t = F.col("text")
    return v.doc_pages.select("document_id", "page_number", tx.excerpt(t).alias("excerpt"), tx.preview(t).alias("preview"))


@check("format_bytes", "H15", """
    SELECT event_id, CASE WHEN b = 0 THEN '0 Bytes' ELSE
               regexp_replace(printf('%.2f', round(b / pow(1024, p), 2)), '\\.?0+$', '') || ' ' ||
               ['Bytes', 'KB', 'MB', 'GB', 'TB'][p + 1] END AS shown
    FROM (SELECT event_id, b, CAST(CASE WHEN b < 1024 THEN 0 WHEN b < pow(1024, 2) THEN 1 WHEN b < pow(1024, 3) THEN 2
                                   WHEN b < pow(1024, 4) THEN 3 ELSE 4 END AS INT) AS p
          FROM (SELECT event_id, CAST(event_id AS DOUBLE) * event_id * (event_id % 1000) AS b FROM events))
""")
def format_bytes(v):
    i = F.col("event_id").cast("double")
    return v.table("events").select("event_id", tx.format_bytes(i * i * (F.col("event_id") % 1000)).alias("shown"))


@check("split_at_budget", "T4", """
    WITH flat AS (SELECT document_id, page_number, text, regexp_replace(text, '\\s+', ' ', 'g') AS f FROM doc_pages),
    cut AS (SELECT *, CASE WHEN length(text) <= 400 THEN text WHEN length(f) <= 400 THEN f
                           ELSE regexp_extract(substr(f, 1, 401), '^(.*) ', 1, 's') END AS head FROM flat)
    SELECT document_id, page_number, md5(head) AS head,
           md5(CASE WHEN length(text) <= 400 OR length(f) <= 400 THEN ''
                    ELSE substr(f, length(head) + CASE WHEN head = '' THEN 1 ELSE 2 END) END) AS rest
    FROM cut
""", ("doc_pages",))
def split_at_budget(v):
    s = v.doc_pages.withColumn("s", tx.split_at_budget(F.col("text"), 100))
    return s.select("document_id", "page_number", F.md5("s.head").alias("head"), F.md5("s.rest").alias("rest"))


@check("overlap_text", "T3", """
    SELECT document_id, page_number, md5(CASE WHEN length(f) <= 160 THEN f
               ELSE regexp_extract(right(f, 161), '^[^ ]* (.*)$', 1, 's') END) AS tail
    FROM (SELECT document_id, page_number, regexp_replace(text, '\\s+', ' ', 'g') AS f FROM doc_pages)
""", ("doc_pages",))
def overlap_text(v):
    return v.doc_pages.select("document_id", "page_number", F.md5(tx.overlap_text(F.col("text"), 40)).alias("tail"))


@check("sentence_boundary", "T5", """
    WITH head AS (SELECT document_id, page_number, page_number * 37 + 20 AS pos, substr(text, 1, page_number * 37 + 20) AS h FROM doc_pages),
    found AS (SELECT *, length(regexp_extract(h, '^.*[.!?](?:\\s|$)', 0, 's')) AS s,
                     CASE WHEN contains(h, chr(10) || chr(10)) THEN length(h) - instr(reverse(h), chr(10) || chr(10)) - 1 ELSE -1 END AS p,
                     CASE WHEN contains(h, ' ') THEN length(h) - instr(reverse(h), ' ') ELSE -1 END AS b FROM head)
    SELECT document_id, page_number, CAST(CASE WHEN s > 0 THEN s WHEN p > 0 THEN p + 2 WHEN b > 0 THEN b + 1 ELSE pos END AS INT) AS boundary
    FROM found
""", ("doc_pages",))
def sentence_boundary(v):
    return v.doc_pages.select("document_id", "page_number", tx.sentence_boundary(
        F.col("text"), F.col("page_number") * 37 + 20).alias("boundary"))


# --- pages ------------------------------------------------------------------------

@check("file_manifest", "A1", """
    SELECT document_id, strlen(text) AS size, sha256(text) AS file_hash, strlen(text) > 5000 AS too_large, total_pages > 2 AS too_many_pages
    FROM user_documents
""", ("user_documents",))
def file_manifest(v):
    return files.text_manifest(v.user_documents, max_size=5000, max_pages=2).withColumn("size", F.col("size").cast("bigint"))


@check("storage_key", "A6", """
    SELECT document_id, user_id || '/' || CAST(epoch_ms(created_at) AS BIGINT) || '_' || md5(text) || '_' ||
           regexp_replace('n° ' || filename, '[^a-zA-Z0-9.-]', '_', 'g') AS key
    FROM user_documents
""", ("user_documents",))
def storage_key(v):
    return v.user_documents.select("document_id", files.storage_key(
        F.col("user_id"), F.unix_millis("created_at"), F.col("text"), F.concat(F.lit("n° "), "filename")).alias("key"))


@check("split_pages", "A2", """
    SELECT document_id, page_number, md5(text) AS page, length(text) AS size FROM doc_pages
""", ("doc_pages",))
def split_pages(v):
    return v.doc_pages.select("document_id", "page_number", F.md5("text").alias("page"),
                              F.length("text").cast("bigint").alias("size"))


@check("even_pages", "A3", """
    WITH RECURSIVE given AS (
        SELECT document_id, text, 1 + document_id % 7 AS n, CAST(ceil(length(text) / (1.0 + document_id % 7)) AS BIGINT) AS target,
               string_split(text, chr(10)) AS lines FROM user_documents),
    walk AS (
        SELECT document_id, 0 AS i, 1 AS page, 0::BIGINT AS held, 0 AS was FROM given
        UNION ALL
        SELECT w.document_id, w.i + 1,
               CASE WHEN w.held + length(g.lines[w.i + 1]) >= g.target AND w.page < g.n THEN w.page + 1 ELSE w.page END,
               CASE WHEN w.held + length(g.lines[w.i + 1]) >= g.target AND w.page < g.n THEN 0 ELSE w.held + length(g.lines[w.i + 1]) END,
               w.page
        FROM walk w JOIN given g USING (document_id) WHERE w.i < len(g.lines)),
    made AS (
        SELECT document_id, was AS page_number, regexp_replace(string_agg(g.lines[w.i], chr(10) ORDER BY w.i), '^\\s+|\\s+$', '', 'g') AS text
        FROM walk w JOIN given g USING (document_id) WHERE w.i > 0 GROUP BY ALL)
    SELECT p.document_id, CAST(p.page_number AS INT) AS page_number, md5(CASE WHEN g.n = 1 THEN g.text ELSE coalesce(m.text, '') END) AS page
    FROM (SELECT document_id, unnest(range(1, n + 1)) AS page_number FROM given) p
    JOIN given g USING (document_id) LEFT JOIN made m ON m.document_id = p.document_id AND m.page_number = p.page_number
""", ("user_documents",))
def even_pages(v):
    counted = v.user_documents.select("document_id", "text", (1 + F.col("document_id") % 7).alias("page_count"))
    return pages.even_pages(counted).select("document_id", "page_number", F.md5("text").alias("page"))


@check("page_statistics", "D17", f"""
    SELECT document_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters, round(avg(length(text)), 0) AS avg_characters,
           count(*) FILTER (len(list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5],
                     lambda x: length(x) BETWEEN 3 AND 200 AND regexp_matches(x, '{_HEADING}'))) > 0) AS pages_with_title
    FROM doc_pages GROUP BY document_id
""", ("doc_pages",))
def page_statistics(v):
    return analytics.page_statistics(v.doc_pages.withColumn("section_title", tx.page_section_title(F.col("text"))))


# --- chunks -----------------------------------------------------------------------

@check("stride_chunks", "T2 E3 H40 D15", """
    SELECT chunk_id, document_id, chunk_index, page_number, chunk_tokens, md5(chunk_text) AS chunk FROM chunks
""", ("chunks",))
def stride_chunks(v):
    return v.chunks.select("chunk_id", "document_id", "chunk_index", "page_number", "chunk_tokens",
                           F.md5("chunk_text").alias("chunk"))


@check("page_table_chunks", "T2 E3", """
    SELECT chunk_id, page_number, page_pos, md5(chunk_text) AS chunk FROM chunks
""", ("chunks",))
def page_table_chunks(v):
    """The same chunks from a table of pages: the index needs the blocked scan."""
    return chunking.stride_page_table(v.doc_pages, 200, 40).select("chunk_id", "page_number", F.col("page_pos").cast("bigint").alias("page_pos"),
                           F.md5("chunk_text").alias("chunk"))


def page_cut_sql(pages_sql: str, size: int, overlap: int) -> str:
    """The page cutter as a recursion: one step a chunk, carrying where the last new text lay."""
    room, lap = size * 4, overlap * 4
    return f"""
    src AS ({pages_sql}),
    whole AS (SELECT * FROM src WHERE ceil(length(text) / 4.0) <= {size}),
    large AS (SELECT document_id, page_number, text, length(text) AS n FROM src WHERE ceil(length(text) / 4.0) > {size}),
    walk AS (
        SELECT document_id, page_number, 0 AS nth, 1::BIGINT AS pos, 0::BIGINT AS start, 0::BIGINT AS stop, ''::VARCHAR AS chunk FROM large
        UNION ALL
        SELECT document_id, page_number, nth + 1,
               -- next word after the new text
               stop2 + 1 + length(regexp_extract(substr(text, stop2 + 1), '^\\s*')) AS pos,
               pos AS start, stop2 AS stop, substr(text, lead, stop2 - lead + 1) AS chunk
        FROM (
            SELECT *, CASE WHEN rest AND bound > pos - 1 AND bound < stop1
                           THEN length(regexp_replace(substr(text, 1, bound), '\\s+$', '')) ELSE stop1 END AS stop2
            FROM (
                -- bound: characters up to the last sentence, paragraph or blank
                SELECT *, lead - 1 + CASE WHEN s > 0 THEN s WHEN p > 0 THEN p + 2 WHEN b > 0 THEN b + 1 ELSE length(seen) END AS bound
                FROM (
                    SELECT *, length(regexp_extract(seen, '^.*[.!?](?:\\s|$)', 0, 's')) AS s,
                           CASE WHEN contains(seen, chr(10) || chr(10)) THEN length(seen) - instr(reverse(seen), chr(10) || chr(10)) - 1 ELSE -1 END AS p,
                           CASE WHEN contains(seen, ' ') THEN length(seen) - instr(reverse(seen), ' ') ELSE -1 END AS b
                    FROM (
                        SELECT *, substr(text, lead, stop1 - lead + 1) AS seen, stop1 < length(regexp_replace(text, '\\s+$', '')) AS rest
                        FROM (
                            SELECT *, pos - 1 + greatest(length(CASE WHEN n - pos + 1 <= budget * 4 THEN regexp_replace(substr(text, pos), '\\s+$', '')
                                        ELSE regexp_extract(substr(text, pos, budget * 4 + 1), '^(.*\\S)\\s', 1, 's') END),
                                    length(regexp_extract(substr(text, pos), '^\\S+'))) AS stop1
                            FROM (
                                SELECT *, CASE WHEN tail = '' THEN pos ELSE stop - length(tail) + 1 END AS lead,
                                       {size} - CASE WHEN tail = '' THEN 0 ELSE CAST(ceil((length(tail) + 1) / 4.0) AS INT) END AS budget
                                FROM (
                                    SELECT w.*, l.text, l.n,
                                           CASE WHEN w.nth = 0 THEN '' WHEN w.stop - w.start + 1 <= {lap} THEN substr(l.text, w.start, w.stop - w.start + 1)
                                                ELSE regexp_extract(right(substr(l.text, w.start, w.stop - w.start + 1), {lap} + 1), '\\s(\\S.*)$', 1, 's') END AS tail
                                    FROM walk w JOIN large l USING (document_id, page_number) WHERE w.pos <= l.n)))))))),
    cut AS (
        SELECT document_id, page_number, 0 AS page_pos, text AS chunk_text, 0 AS page_position_start, length(text) AS page_position_end FROM whole
        UNION ALL
        SELECT document_id, page_number, nth - 1, chunk, start - 1, stop FROM walk WHERE nth > 0),
    numbered AS (
        SELECT document_id, page_number, chunk_text, CAST(page_position_start AS INT) AS page_position_start,
               CAST(page_position_end AS INT) AS page_position_end,
               row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_pos) - 1 AS chunk_index
        FROM cut)
    """


@check("chunk_pages", "T1 E3 H40", "WITH RECURSIVE" + page_cut_sql("SELECT * FROM doc_pages", 200, 40) + """
    SELECT document_id || '-chunk-' || chunk_index AS chunk_id, page_number, page_position_start, page_position_end,
           md5(chunk_text) AS chunk, CAST(ceil(length(chunk_text) / 4.0) AS INT) AS chunk_tokens FROM numbered
""", ("doc_pages",))
def chunk_pages(v):
    return chunking.chunk_page_table(v.doc_pages, size=200, overlap=40).select(
        "chunk_id", "page_number", "page_position_start", "page_position_end",
        F.md5("chunk_text").alias("chunk"), "chunk_tokens")


@check("chunk_documents", "T1 E3 H40", "WITH RECURSIVE" + page_cut_sql("SELECT * FROM doc_pages", 800, 150) + """
    SELECT document_id || '-chunk-' || chunk_index AS chunk_id, page_number, page_position_start, page_position_end,
           md5(chunk_text) AS chunk FROM numbered
""", ("doc_pages",))
def chunk_documents(v):
    """Default sizes, made inside each document's row."""
    return chunking.chunk_documents(v.user_documents.select("document_id", "text")).select(
        "chunk_id", "page_number", "page_position_start", "page_position_end", F.md5("chunk_text").alias("chunk"))


@check("rechunk", "T15", "WITH RECURSIVE" + page_cut_sql("""
        SELECT document_id, page_number, string_agg(chunk_text, ' ' ORDER BY chunk_index) AS text FROM chunks GROUP BY ALL""", 300, 50) + """
    SELECT document_id, chunk_index, page_number, md5(chunk_text) AS chunk FROM numbered
""", ("chunks",))
def rechunk(v):
    stored = v.chunks.withColumn("section_title", F.lit(None).cast("string"))
    return chunking.rechunk(stored, size=300, overlap=50).select(
        "document_id", "chunk_index", "page_number", F.md5("chunk_text").alias("chunk"))


@check("chunking_totals", "D15", """
    SELECT document_id, page_number, count(*) AS chunks, CAST(sum(chunk_tokens) AS BIGINT) AS tokens, round(avg(chunk_tokens), 6) AS avg_tokens
    FROM chunks GROUP BY document_id, page_number
    UNION ALL SELECT document_id, 0, count(*), CAST(sum(chunk_tokens) AS BIGINT), round(avg(chunk_tokens), 6) FROM chunks GROUP BY document_id
""", ("chunks",))
def chunking_totals(v):
    per_page = analytics.chunking_totals(v.chunks, ("document_id", "page_number"))
    return per_page.unionByName(analytics.chunking_totals(v.chunks).withColumn("page_number", F.lit(0)))


@check("embeddable_text", "B10", """
    SELECT doc_id, CASE WHEN trim(text) = '' THEN 'text is empty' WHEN length(text) > 8192 THEN 'text is longer than 8192 characters' END AS problem
    FROM documents
""")
def embeddable_text(v):
    return v.table("documents").select("doc_id", hooks.embeddable_problem(F.col("text")).alias("problem"))


@check("hash_embedding", "H33 U1", """
    WITH letters AS (
        SELECT chunk_id, (unicode(c) + i + j) % 384 AS bucket
        FROM (SELECT chunk_id, i, unnest(string_split(w, '')) AS c, unnest(range(length(w))) AS j
              FROM (SELECT chunk_id, unnest(l) AS w, unnest(range(len(l))) AS i
                    FROM (SELECT chunk_id, regexp_split_to_array(lower(chunk_text), '\\s+') AS l FROM chunks)))),
    buckets AS (SELECT chunk_id, bucket, count(*) * 0.1::DOUBLE AS v FROM letters GROUP BY ALL),
    sized AS (SELECT *, (v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)))::FLOAT::DOUBLE AS u FROM buckets)
    SELECT chunk_id, count(*) AS filled, round(max(u), 6) AS highest, round(sum(u * (bucket + 1)), 6) AS weighted FROM sized GROUP BY chunk_id
""", ("chunks",))
def hash_embedding(v):
    e = hooks.embed(v.chunks.select("chunk_id", "chunk_text"), hooks.Embedder(384))
    d = F.transform("embedding", lambda x: x.cast("double"))
    return e.withColumn("d", d).select(
        "chunk_id", F.size(F.filter("d", lambda x: x != 0)).cast("bigint").alias("filled"),
        F.round(F.array_max("d"), 6).alias("highest"),
        F.round(F.aggregate(F.transform("d", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"),
    )
