"""Queries over documents and chunks: ingestion, chunking, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import numbers as N
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.plans.cut import written
from siltstone.plans.ranks import running_total
from siltstone.plans.registry import SQL, query
from siltstone.sources.tables import delivered_once, table

_W = r"[ \t\n\r\x0B\f]"
_S = r"[^ \t\n\r\x0B\f]"
_strip = lambda x: f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"
_count = lambda x: f"len(regexp_extract_all({x}, '{_S}+'))"
_norm = lambda x: _strip(f"regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_fold = lambda x: _strip(f"regexp_replace(lower(coalesce({x}, '')), '{_W}+', ' ', 'g')")
_share = lambda x, keep: f"coalesce(length(regexp_replace({x}, '[^{keep}]', '', 'g')) / nullif(length(regexp_replace({x}, '{_W}', '', 'g')), 0), 0)"
_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM document_chunks) WHERE rn = 1)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "title", "text")


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return delivered_once(table(spark, d, "document_chunks", "id", *columns, "created_at")).drop("created_at")


def _each(spark: SparkSession, d: str, *derived) -> DataFrame:
    """(id, derived...) once per chunk: what is derived from the text is shuffled, not the text.

    Rows delivered again have equal values, so any of them gives the same row.
    """
    return table(spark, d, "document_chunks", "id", *derived).dropDuplicates(["id"])


@query(f"""SELECT doc_id, {_strip('title')} AS title, length({_norm('text')}) AS chars, sha256({_norm('text')}) AS text_hash FROM documents
 WHERE length({_strip('title')}) > 0 AND length({_strip('text')}) >= 500""")
def ingest_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where((F.length(T.strip(F.col("title"))) > 0) & (F.length(T.strip(F.col("text"))) >= T.MIN_TEXT_CHARS))
    body = T.normalize(F.col("text"))
    return docs.select("doc_id", T.strip(F.col("title")).alias("title"), F.length(body).alias("chars"), F.sha2(body, 256).alias("text_hash"))


def _fixed_sql(size: int, overlap: int, strip: bool) -> str:
    step = size - overlap
    piece = f"array_to_string(t[a + 1:a + {size}], '')"
    return f"""toks AS (SELECT doc_id, regexp_extract_all(text, '{_W}*{_S}+') AS t FROM documents WHERE text IS NOT NULL), win AS (SELECT doc_id, t, unnest(generate_series(0, CASE WHEN len(t) <= {size} THEN 0 ELSE ceil((len(t) - {size}) / {step})::BIGINT * {step} END, {step})) AS a FROM toks WHERE len(t) > 0),
 pieces AS (SELECT doc_id, (a / {step})::INT AS chunk_index, {_strip(piece) if strip else piece} AS content FROM win)"""


@query(f"WITH {_fixed_sql(256, 24, True)} SELECT doc_id, chunk_index, {_count('content')} AS token_count, substr(sha256(concat_ws('|', doc_id, chunk_index, content)), 1, 16) AS chunk_id FROM pieces WHERE content <> ''")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.with_ids(C.fixed_windows(_documents(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "chunk_index", "token_count", "chunk_id")


@query(f"WITH {_fixed_sql(500, 80, False)} SELECT doc_id, chunk_index, length(content) AS chars, {_count('content')} AS token_count FROM pieces")
def sample_chunks_500_80(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed_windows(_documents(spark, d), "doc_id", "text", 500, 80, strip=False).select("doc_id", "chunk_index", F.length("content").alias("chars"), "token_count")


@query(f"WITH {_fixed_sql(256, 0, True)} SELECT doc_id, count(*) AS chunks, sum({_count("content")})::BIGINT AS tokens FROM pieces WHERE content <> '' GROUP BY 1")
def token_split_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed_windows(_documents(spark, d), "doc_id", "text", 256, 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))


_low = lambda x: f"regexp_matches({_strip(x)}, '^\\p{{Ll}}')"
_punct = lambda x: f"regexp_matches({_strip(x)}, '^[^\\p{{L}}\\p{{N}}_ \\t\\n\\r]')"
_mid = lambda x: f"({_strip(x)} <> '' AND NOT regexp_matches({_strip(x)}, '[.?!\"'')\\]]$'))"
_frag = lambda x: f"""({_low(x)} OR {_punct(x)} OR regexp_replace(regexp_extract(lower({_strip(x)}), '^{_S}+'), '^[,.;:]+|[,.;:]+$', '', 'g') IN ({', '.join(f"'{w}'" for w in T.CONTINUATION_WORDS)}))"""
_label = lambda x: f"({_strip(x)} <> '' AND ({_count(x)} <= 8 OR ({_count(x)} <= 15 AND NOT regexp_matches({_strip(x)}, '[.?!]$'))))"


_set = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '{_S}+'))"
_LAG = f"""lagged AS (SELECT content, lag(content) OVER w AS before, row_number() OVER w AS r FROM once WINDOW w AS (PARTITION BY document_id ORDER BY coalesce(chunk_index, 0), id)),
 j AS (SELECT coalesce(len(list_intersect({_set('before')}, {_set('content')})) / nullif(len(list_distinct(list_concat({_set('before')}, {_set('content')}))), 0), 0) AS j FROM lagged WHERE r > 1)"""
_FLAGS = {"chunks_starting_with_lowercase": "lo", "chunks_starting_with_punctuation": "pu", "chunks_ending_mid_sentence": "mid", "fragment_like_starts": "fr", "short_label_like_chunks": "la"}
_named = lambda n: f"pct_{n}"


@query(f"""WITH {_ONCE}, q AS (SELECT coalesce(token_count, {_count('content')}) AS n, {_low('content')} AS lo, {_punct('content')} AS pu, {_mid('content')} AS mid, {_frag('content')} AS fr, {_label('content')} AS la FROM once), {_LAG},
 g AS (SELECT {_fold('content')} AS x, count(*) AS c FROM once GROUP BY 1), dup AS (SELECT round(coalesce(sum(c - 1) / sum(c), 0), 6) AS exact_duplicate_ratio FROM g WHERE x <> ''),
 adj AS (SELECT round(coalesce(avg(j), 0), 6) AS avg_adjacent_token_jaccard, round(coalesce(median(j), 0), 6) AS median_adjacent_token_jaccard, round(coalesce(quantile_disc(j, 0.9), 0), 6) AS p90_adjacent_token_jaccard, round(coalesce(max(j), 0), 6) AS max_adjacent_token_jaccard FROM j)
 SELECT r.*, dup.*, adj.* FROM (SELECT count(*) AS total_chunks, round(avg(n), 6) AS avg_tokens_per_chunk, round(median(n), 6) AS median_tokens_per_chunk, min(n) AS min_tokens_per_chunk, max(n) AS max_tokens_per_chunk, quantile_disc(n, 0.1) AS p10_tokens_per_chunk, quantile_disc(n, 0.9) AS p90_tokens_per_chunk,
 {', '.join(f"count(*) FILTER (WHERE n < {k}) AS chunks_lt_{k}_tokens, round(count(*) FILTER (WHERE n < {k}) / count(*), 6) AS pct_chunks_lt_{k}_tokens" for k in (40, 80))},
 {', '.join(f"count(*) FILTER (WHERE {c}) AS {n}, round(count(*) FILTER (WHERE {c}) / count(*), 6) AS {_named(n)}" for n, c in _FLAGS.items())} FROM q) r, dup, adj""")
def chunk_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of 26 metrics: stored token counts where there are any, starts and ends, exact copies, overlap of neighbours."""
    c = F.col("content")
    x = T.folded(c)
    flags = [T.starts_lower(c).alias("lo"), T.starts_punctuated(c).alias("pu"), T.ends_mid_sentence(c).alias("mid"), T.starts_like_fragment(c).alias("fr"), T.short_label(c).alias("la")]
    # One pass over the texts; what leaves it are numbers, flags and hashes.
    each = written(_each(spark, d, "document_id", "chunk_index", F.coalesce("token_count", T.token_count(c)).alias("n"), *flags, F.when(x != "", F.md5(x)).alias("x"), _word_hashes(c).alias("w")), "report")
    n, count = F.col("n"), F.count(F.lit(1))
    share = lambda own: F.round(N.safe_ratio(F.count_if(own), count), 6)
    whole = each.agg(
        count.alias("total_chunks"), F.round(F.avg(n), 6).alias("avg_tokens_per_chunk"), F.round(F.median(n), 6).alias("median_tokens_per_chunk"), F.min(n).alias("min_tokens_per_chunk"), F.max(n).alias("max_tokens_per_chunk"),
        N.nearest_rank("n", 0.1).cast("int").alias("p10_tokens_per_chunk"), N.nearest_rank("n", 0.9).cast("int").alias("p90_tokens_per_chunk"),
        *[m for k in (40, 80) for m in (F.count_if(n < k).alias(f"chunks_lt_{k}_tokens"), share(n < k).alias(f"pct_chunks_lt_{k}_tokens"))],
        *[m for name, f in _FLAGS.items() for m in (F.count_if(f).alias(name), share(F.col(f)).alias(_named(name)))],
    )
    copies = each.where("x is not null").groupBy("x").agg(count.alias("c")).agg(F.round(N.safe_ratio(F.sum(F.col("c") - 1), F.sum("c")), 6).alias("exact_duplicate_ratio"))
    near = _jaccards(each)
    overlap = near.agg(*[F.coalesce(F.round(m, 6), F.lit(0.0)).alias(f"{name}_adjacent_token_jaccard") for name, m in (("avg", F.avg("j")), ("median", F.median("j")), ("p90", N.nearest_rank("j", 0.9)), ("max", F.max("j")))])
    one = F.lit(1).alias("_one")
    return whole.select("*", one).join(copies.select("*", one), "_one").join(overlap.select("*", one), "_one").drop("_one")


@query(f"WITH {_ONCE}, g AS (SELECT {_fold('content')} AS x, count(*) AS c FROM once GROUP BY 1) SELECT sum(c)::BIGINT AS texts, sum(c - 1)::BIGINT AS repeats, round(sum(c - 1) / sum(c), 6) AS duplicate_ratio FROM g WHERE x <> ''")
def duplicate_ratio(spark: SparkSession, d: str) -> DataFrame:
    # Only a 128-bit hash of each folded text is shuffled and counted.
    x = T.folded(F.col("content"))
    g = _each(spark, d, F.when(x != "", F.md5(x)).alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.sum("c").alias("texts"), F.sum(F.col("c") - 1).alias("repeats"), F.round(N.safe_ratio(F.sum(F.col("c") - 1), F.sum("c")), 6).alias("duplicate_ratio"))


@query(f"WITH {_ONCE}, {_LAG} SELECT count(*) AS pairs, round(avg(j), 6) AS avg_jaccard, round(median(j), 6) AS median_jaccard, round(quantile_disc(j, 0.9), 6) AS p90_jaccard, round(max(j), 6) AS max_jaccard FROM j")
def adjacent_jaccard(spark: SparkSession, d: str) -> DataFrame:
    base = written(_each(spark, d, "document_id", "chunk_index", _word_hashes(F.col("content")).alias("w")), "words")
    return _jaccards(base).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("j"), 6).alias("avg_jaccard"), F.round(F.median("j"), 6).alias("median_jaccard"), F.round(N.nearest_rank("j", 0.9), 6).alias("p90_jaccard"), F.round(F.max("j"), 6).alias("max_jaccard"))


def _word_hashes(c: Column) -> Column:
    """Hashes of the different lower-cased tokens of a text: only they travel."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"{T.NOT_WS}+"), F.lit(0))), lambda w: F.xxhash64(w))


def _jaccards(base: DataFrame) -> DataFrame:
    """(j): similarity of each chunk (id, document_id, chunk_index, w) to the one before it in its document, gaps or not."""
    placed = C.in_order(base.select("id", "document_id", "chunk_index"), "document_id", "id").select("id", "document_id", "place")
    own = placed.join(base.select("id", "w"), "id").select("document_id", "place", "w")
    before = own.select("document_id", (F.col("place") + 1).alias("place"), F.col("w").alias("v"))
    return own.join(before, ["document_id", "place"]).select(N.safe_ratio(F.size(F.array_intersect("w", "v")), F.size(F.array_union("w", "v"))).alias("j"))


_flat = "regexp_replace(coalesce(content, ''), '\\n', ' ', 'g')"


@query(f"""WITH {_ONCE} SELECT id, {_count('content')} AS tokens, CASE WHEN length({_strip(_flat)}) > 500 THEN substr({_strip(_flat)}, 1, 500) || '...' ELSE {_strip(_flat)} END AS preview FROM once ORDER BY tokens, id LIMIT 20""")
def shortest_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _each(spark, d, T.token_count(c).alias("tokens"), T.preview(c).alias("preview")).orderBy("tokens", "id").limit(20)


@query(f"WITH {_ONCE} SELECT id, {_frag('content')} AS fragment, {_label('content')} AS label FROM once WHERE {_frag('content')} OR {_label('content')} ORDER BY id LIMIT 20")
def fragment_examples(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _each(spark, d, T.starts_like_fragment(c).alias("fragment"), T.short_label(c).alias("label")).where("fragment or label").orderBy("id").limit(20)


_lines = lambda x: f"list_filter(list_transform(string_split({_norm(x)}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')"
_apart = lambda x: f"list_filter(list_transform(regexp_split_to_array({_norm(x)}, '\\n[ \\t]*\\n'), lambda l: {_strip('l')}), lambda l: l <> '')"


@query(f"""WITH l AS (SELECT doc_id, {_lines('text')} AS ls, {_apart('text')} AS ps FROM documents), p AS (SELECT doc_id, ls, CASE WHEN len(ps) <= 1 THEN ls ELSE ps END AS ps FROM l),
 c AS (SELECT doc_id, len(ls) AS n, len(ps) AS np, len(list_filter(ls, lambda x: regexp_matches(x, '{T.MONTH_LINE}|{T.TIMELINE_EVENT}'))) AS tl, len(list_filter(ls, lambda x: regexp_matches(x, '{T.LIST_ITEM}'))) AS li,
  len(list_filter(ps, lambda x: length(x) >= 180 AND {_share('x', chr(92) + 'p{L}')} >= 0.55)) AS pr FROM p)
 SELECT doc_id, CASE WHEN coalesce(n, 0) < 1 THEN 'article' WHEN tl / n >= 0.18 THEN 'timeline' WHEN li >= 10 AND li / n >= 0.35 AND pr <= greatest(4, floor(np / 3)) THEN 'list' ELSE 'article' END AS document_type FROM c""")
def document_type(spark: SparkSession, d: str) -> DataFrame:
    return C.with_document_type(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


_edge = "regexp_replace({x}, '^[()\\[\\]{{}}\"'']+|[()\\[\\]{{}}\"'']+$', '', 'g')"
_in = lambda x, words: f"{x} IN ({', '.join(chr(39) + w + chr(39) for w in words)})"


def _heading_sql(x: str) -> str:
    w = _edge.format(x="w")
    fits = f"({w} = '' OR (upper({w}) = {w} AND regexp_matches({w}, '\\p{{L}}')) OR (i > 1 AND {_in(f'lower({w})', T.MINOR_WORDS)}) OR regexp_matches({w}, '^\\p{{Lu}}'))"
    parts = f"list_filter(regexp_split_to_array({x}, '{_W}+'), lambda w: w <> '')"
    case = f"(len({parts}) > 0 AND len(list_filter({parts}, lambda w, i: NOT {fits})) = 0)"
    plain = f"(length({x}) <= 80 AND NOT regexp_matches({x}, '[.,;:]$') AND {_count(x)} <= 12 AND NOT regexp_matches({x}, '{T.LIST_ITEM}') AND NOT regexp_matches({x}, '{T.MONTH_LINE}|{T.TIMELINE_EVENT}'))"
    return f"({x} <> '' AND ({_in(f'lower({x})', T.IGNORED_SECTIONS)} OR ({plain} AND ({case} OR (upper({x}) = {x} AND regexp_matches({x}, '\\p{{L}}'))))))"


@query(f"""WITH ln AS (SELECT doc_id, coalesce(title, '') AS t, string_split({_norm("coalesce(text, '')")}, chr(10)) AS ls FROM documents), ex AS (SELECT doc_id, t, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM ln),
 fl AS (SELECT doc_id, t, n, x, {_strip('x')} AS sx FROM ex), hd AS (SELECT *, {_heading_sql('sx')} AS h FROM fl), sc AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY n) AS sid FROM hd),
 se AS (SELECT doc_id, t, sid, coalesce(max(CASE WHEN h THEN sx END), 'Introduction') AS section_title, {_norm("coalesce(string_agg(CASE WHEN NOT h THEN x END, chr(10) ORDER BY n), '')")} AS body FROM sc GROUP BY 1, 2, 3),
 ok AS (SELECT * FROM se WHERE body <> '' AND NOT {_in('lower(section_title)', T.IGNORED_SECTIONS)}),
 al AS (SELECT doc_id, sid, section_title, t || ' > ' || section_title AS section_path, body FROM ok UNION ALL SELECT doc_id, 0, 'Full Article', coalesce(title, ''), {_norm('text')} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ok) AND {_norm("coalesce(text, '')")} <> '')
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS section_index, section_title, section_path, sha256(body) AS text_hash FROM al""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(_documents(spark, d), "doc_id", "title", "text").select("doc_id", "section_index", "section_title", "section_path", F.sha2("section_text", 256).alias("text_hash"))


#: All characters that are white space in any of the engines.
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(SQL["section_split"].replace("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS section_index, section_title, section_path, sha256(body) AS text_hash FROM al", f"SELECT doc_id, md5(regexp_replace(string_agg(body, '' ORDER BY sid), '{_SPACE}+', '', 'g')) AS text_hash, true AS fits FROM al GROUP BY 1"))
def section_chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a document in order, without white space, are its sections in order: nothing is lost, repeated or too long."""
    made = C.section_chunks(_documents(spark, d), "doc_id", "title", "text").select("doc_id", "chunk_index", "content", "token_count")
    own = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"), (F.max("token_count") <= T.MAX_TOKENS).alias("fits"))
    return own.select("doc_id", F.md5(F.regexp_replace(F.array_join("c.content", ""), f"{_SPACE}+", "")).alias("text_hash"), "fits")


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.section_chunks(_documents(spark, d), "doc_id", "title", "text").drop("content")


@query(f"""WITH {_ONCE} SELECT id, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id FROM once WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)""")
def prev_next_links(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d, "document_id", "chunk_index").withColumnRenamed("id", "chunk_id")
    return C.linked(chunks, "document_id").select(F.col("chunk_id").alias("id"), "prev_chunk_id", "next_chunk_id")


@query(f"""WITH {_ONCE} SELECT document_id, count(*) AS chunks, round(avg({_count('content')}), 6) AS avg_tokens, min({_count('content')}) AS min_tokens, count(*) FILTER (WHERE {_count('content')} < 40) AS under_40,
 count(*) FILTER (WHERE {_low('content')}) AS lowercase, count(*) FILTER (WHERE {_punct('content')}) AS punctuation, count(*) FILTER (WHERE {_share('content', chr(92) + 'p{Nd}')} > 0.2) AS numeric_heavy FROM once GROUP BY 1""")
def chunk_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    c, n = F.col("content"), F.col("n")
    each = _each(spark, d, "document_id", T.token_count(c).alias("n"), T.starts_lower(c).alias("lo"), T.starts_punctuated(c).alias("pu"), (T.numeric_ratio(c) > 0.2).alias("nu"))
    return each.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg(n), 6).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.count_if(n < 40).alias("under_40"),
        F.count_if("lo").alias("lowercase"), F.count_if("pu").alias("punctuation"), F.count_if("nu").alias("numeric_heavy"),
    )


@query(f"WITH {_ONCE} SELECT id, round({_share('content', chr(92) + 'p{L}')}, 6) AS alpha_ratio, round({_share('content', chr(92) + 'p{Nd}')}, 6) AS numeric_ratio, {_mid('content')} AS mid_sentence FROM once")
def text_ratios(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _each(spark, d, F.round(T.alpha_ratio(c), 6).alias("alpha_ratio"), F.round(T.numeric_ratio(c), 6).alias("numeric_ratio"), T.ends_mid_sentence(c).alias("mid_sentence"))


@query("SELECT query_id, array_to_string(list_filter(regexp_split_to_array(replace(replace(replace(replace(lower(coalesce(query, '')), '?', ''), ',', ''), '.', ''), '/', ' '), '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], w)), ' ') AS keywords FROM queries")
def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries", "query_id", "query").select("query_id", F.array_join(T.keywords(F.col("query")), " ").alias("keywords"))


@query("""SELECT id, 'Title: ' || coalesce(title, '') || chr(10) || 'Source: ' || coalesce(json_extract_string(metadata, '$.source'), '') AS prompt, translate(coalesce(title, ''), '/ ', '__') AS file_name
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM rag_documents) WHERE rn = 1""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    docs = delivered_once(table(spark, d, "rag_documents", "id", "title", "metadata", "created_at"))
    text = T.fill("Title: $title\nSource: $source", title=F.col("title"), source=F.get_json_object("metadata", "$.source"))
    return docs.select("id", text.alias("prompt"), T.file_safe(F.coalesce("title", F.lit(""))).alias("file_name"))


@query(f"""WITH {_ONCE}, g AS (SELECT row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS rn, document_id FROM once) SELECT document_id, (rn - 1) // 64 AS batch, count(*) AS rows FROM g GROUP BY 1, 2""")
def insert_batches(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d, "document_id", "chunk_index")
    placed = running_total(chunks, "document_id", "chunk_index", "id", F.lit(1), "before")
    return placed.groupBy("document_id", F.floor(F.col("before") / 64).alias("batch")).agg(F.count(F.lit(1)).alias("rows"))
