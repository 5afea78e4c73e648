"""The engine's queries over the memory view, each beside its SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import report
from ..functions import strength as st
from ..functions import text as tx
from ..functions import vector as vec
from ..operators import conflict, maintain
from ..operators import search as se
from ..operators.embed import HashedTrigramEmbedder
from ..sources import store
from ..sources.gram_index import GramIndex
from ..sources.store import MemoryStore
from .memory_view import access_log, memories, now, table
from .scratch import folder, written

Q, SHORT, TAG = "thing ention src3", "zu", "src7"
TOP = 10
SUBSTRING = EngineConfig(candidate_mode="substring_or_tag")
#: The vectors of the test tables are far apart: lower thresholds give every verdict some rows.
LOW = EngineConfig(duplicate=0.72, supersede=0.66, coexist=0.6)

# ---------------------------------------------------------------- SQL pieces

_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _norm(x: str) -> str:
    return rf"regexp_replace(lower({x}), '^\s+|\s+$', '', 'g')"


def _grams(x: str) -> str:
    s = f"('  ' || {_norm(x)} || '  ')"
    return rf"list_distinct(list_filter([substr({s}, i, 3) FOR i IN range(1, len({s}) - 1)], lambda g: regexp_matches(g, '\S')))"


def _padded(x: str) -> str:
    return f"('  ' || {_norm(x)} || '  ')"


_OF_PADDED = r"list_distinct(list_filter([substr(padded, i, 3) FOR i IN range(1, len(padded) - 1)], lambda g: regexp_matches(g, '\S')))"


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN ({both}::DOUBLE / (len({a}) + len({b}) - {both}))::FLOAT::DOUBLE ELSE 0 END)"


def _days(t: str) -> str:
    return f"((epoch_us({_NOW}) - epoch_us({t})) / 86400000000.0::DOUBLE)"


_STRENGTH = f"(CASE WHEN is_pinned THEN base_strength ELSE base_strength * exp(-(decay_rate * (1 - importance * 0.5)) * {_days('last_accessed_at')}) END)"
_RECENCY = f"(CASE WHEN {_days('last_accessed_at')} >= 365 THEN 0 ELSE 1 - {_days('last_accessed_at')} / 365 END)"
_CURRENT = "(valid_until IS NULL AND NOT is_archived)"
_INDEX = "title || ' ' || summary || CASE WHEN len(tags) > 0 THEN ' ' || array_to_string(tags, ' ') ELSE '' END"

VIEW = f"""WITH lg AS (SELECT user_id AS id, count(*)::INT AS n, max(ts)::TIMESTAMP AS last_at FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id),
m0 AS (SELECT d.doc_id AS id, left({_FLAT}, 60) AS title, left({_FLAT}, 200) AS summary, left(text, 524288) AS content,
  list_filter([lang, source, CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags,
  TIMESTAMP '2023-12-01' + to_days((d.doc_id % 60)::INT) + to_minutes(d.doc_id % 1440) AS created_at,
  (d.doc_id % 11) / 10.0::DOUBLE AS importance, d.doc_id % 97 = 0 AS is_pinned, d.doc_id % 13 = 5 AS is_archived,
  CASE WHEN d.doc_id % 17 = 3 THEN {_NOW} - INTERVAL 1 DAY END AS expires_at, e.embedding
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
m1 AS (SELECT m0.*, created_at AS valid_from, CASE WHEN is_archived AND id % 2 <> 0 THEN created_at + INTERVAL 1 DAY END AS valid_until,
  CASE WHEN is_archived AND EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = m0.id + 1) THEN id + 1 END AS superseded_by,
  coalesce(n, 0) AS access_count, coalesce(last_at, created_at) AS last_accessed_at, 0.1::DOUBLE AS decay_rate,
  1 + coalesce(list_sum([0.1::DOUBLE / sqrt(k) FOR k IN range(1, coalesce(n, 0) + 1)]), 0) AS base_strength,
  left({_norm(_INDEX)}, 800) AS content_normalized FROM m0 LEFT JOIN lg USING (id)),
m2 AS (SELECT *, {_padded('content_normalized')} AS padded FROM m1),
m AS (SELECT * EXCLUDE (padded), {_OF_PADDED} AS trigrams FROM m2)
"""


def _words(q: str, least: int) -> str:
    return f"list_filter(string_split({q}, ' '), lambda w: len(w) >= {least})"


def _overlap(ws: str, text: str) -> str:
    return f"(CASE WHEN len({ws}) > 0 THEN len(list_filter({ws}, lambda w: contains({text}, w)))::DOUBLE / len({ws}) ELSE 0 END)"


def _stage1(q: str) -> str:
    """Scored columns of m for the normalised query expression ``q``."""
    ws = _words(q, 3)
    return f"""SELECT m.*, {_jac(_grams(q), 'trigrams')} AS fz, {_overlap(ws, 'content_normalized')} AS ov,
  CASE WHEN contains(content_normalized, {q}) THEN 0.5 ELSE 0 END AS ex,
  CASE WHEN len(list_filter(tags, lambda t: len(list_filter({ws}, lambda w: contains(lower(t), w))) > 0)) > 0 THEN 0.3 ELSE 0 END AS tg FROM m"""


_KEEP = "(fz > 0.05 OR ov > 0 OR ex > 0 OR tg > 0)"
_TEXT = f"(ex + 0.5 * fz + 0.3 * ov + tg + 0.2 * {_STRENGTH})"


def _fuzzy(q: str) -> str:
    ws = f"list_distinct({_words(q, 2)})"
    tag = f"list_transform(tags, lambda t: CASE WHEN contains({q}, lower(t)) OR contains(lower(t), {q}) THEN 0.9 WHEN len(list_filter({ws}, lambda w: contains(lower(t), w) OR contains(w, lower(t)))) > 0 THEN 0.8 ELSE 0 END)"
    jac = _jac(_grams(q), "trigrams")
    return f"""greatest(CASE WHEN contains(content_normalized, {q}) THEN 1.0 ELSE 0 END, CASE WHEN contains(lower(title), {q}) THEN 0.95 ELSE 0 END,
  coalesce(list_filter({tag}, lambda s: s > 0)[1], 0), 0.7 * {_overlap(ws, 'lower(title)')}, 0.5 * {_overlap(ws, 'content_normalized')},
  CASE WHEN {jac} > 0.05 THEN 0.6 * {jac} ELSE 0 END)::DOUBLE"""


def _cos(a: str, b: str) -> str:
    d = f"list_sum([{a}[i]::DOUBLE * {b}[i]::DOUBLE FOR i IN range(1, len({a}) + 1)])"
    n = lambda v: f"sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN {v}]))"
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND len({a}) = len({b}) AND {n(a)} * {n(b)} > 0 THEN {d} / ({n(a)} * {n(b)}) ELSE 0 END)"


def _hybrid(q: str, top: int, semantic: str | None, where: str = "true") -> str:
    s = f"least(1.0, {_STRENGTH} / 2)"
    score = f"0.5 * fuzzy + 0.3 * {s} + 0.2 * {_RECENCY}" if semantic is None else f"0.4 * sem + 0.3 * fuzzy + 0.2 * {s} + 0.1 * {_RECENCY}"
    return f"""{VIEW}, s1 AS ({_stage1(q)}), c AS (SELECT * FROM s1 WHERE {_KEEP} ORDER BY {_TEXT} DESC, id LIMIT {3 * top}),
qv AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), f AS (SELECT *, {_fuzzy(q)} AS fuzzy, {semantic or '0'} AS sem FROM c, qv WHERE {_CURRENT} AND {where})
SELECT id, round(fuzzy, 6) AS fuzzy, round(sem::DOUBLE, 6) AS semantic, round({score}, 6) AS score FROM f ORDER BY {score} DESC, id LIMIT {top}"""


_QN = f"'{Q.lower()}'"
_SEM = f"CASE WHEN embedding IS NULL THEN 0 ELSE ({_cos('qe', 'embedding')} + 1) / 2 END"

# ---------------------------------------------------------------- queries

REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


#: Rows of a batch that are Python strings at a time.
FEW = 64


def few_rows(batch: pa.RecordBatch):
    """A batch in pieces of FEW rows."""
    return (batch.slice(k, FEW) for k in range(0, batch.num_rows, FEW))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"{VIEW} SELECT id, title, array_to_string(tags, ', ') AS tags FROM m")
def memory_scan(spark, d):
    return memories(spark, d).select("id", "title", F.array_join("tags", ", ").alias("tags"))


@query(f"{VIEW} SELECT id, title, access_count, is_archived FROM m WHERE id = 42")
def point_lookup(spark, d):
    return memories(spark, d).where("id = 42").limit(1).select("id", "title", "access_count", "is_archived")


@query(f"{VIEW} SELECT id FROM m WHERE NOT (is_archived OR id % 10 = 7)")
def delete_by_ids(spark, d):
    m = memories(spark, d)
    gone = m.where("is_archived or id % 10 = 7").select("id")
    return m.select("id").join(gone, "id", "left_anti")


@query(
    f"""{VIEW}, u AS (SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE doc_id + 10000000 END AS id, 'updated ' || doc_id AS title,
CASE WHEN doc_id % 2 = 0 THEN 'new summary' END AS summary FROM documents WHERE doc_id % 5 = 0 OR doc_id % 50 = 1)
SELECT coalesce(u.id, m.id) AS id, coalesce(u.title, m.title) AS title, coalesce(u.summary, m.summary) AS summary FROM m FULL JOIN u ON u.id = m.id"""
)
def upsert_merge(spark, d):
    m = memories(spark, d).select("id", "title", "summary")
    u = table(spark, d, "documents").where("doc_id % 5 = 0 or doc_id % 50 = 1").selectExpr(
        "case when doc_id % 5 = 0 then doc_id else doc_id + 10000000 end id", "concat('updated ', doc_id) title", "case when doc_id % 2 = 0 then 'new summary' end summary"
    )
    return store.merged(m, u)


@query("WITH r AS (SELECT user_id AS id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT id, event_id, event_type FROM r WHERE k = 1 AND event_type <> 'error'")
def latest_version(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"), "event_id", "event_type")
    return store.latest(e)


@query(
    """SELECT doc_id AS id, length(left(repeat(text, 2), 500)) AS title_chars, length(left(repeat(text, 3), 2000)) AS summary_chars, length(left(text, 524288)) AS content_chars,
len(list_slice([source FOR i IN range(doc_id % 40)], 1, 20)) AS n_tags, least(1.0, greatest(0.0, (doc_id % 7 - 2) / 3.0::DOUBLE)) AS importance FROM documents"""
)
def input_clamp(spark, d):
    t = table(spark, d, "documents")
    tags = F.array_repeat("source", (F.col("doc_id") % 40).cast("int"))
    rows = t.select(F.col("doc_id").alias("id"), F.repeat("text", F.lit(2)).alias("title"), F.repeat("text", F.lit(3)).alias("summary"), F.col("text").alias("content"), tags.alias("tags"), ((F.col("doc_id") % 7 - 2) / 3.0).alias("importance"))
    c = store.clamped(rows)
    return c.select("id", F.length("title").cast("long").alias("title_chars"), F.length("summary").cast("long").alias("summary_chars"), F.length("content").cast("long").alias("content_chars"), F.size("tags").cast("long").alias("n_tags"), "importance")


@query("SELECT doc_id AS id, length(text) + 1 AS chars, sha256('🚀' || text) AS hash FROM documents")
def surrogate_sanitize(spark, d):
    """Unpaired surrogates, put into every text in Python, go; a pair becomes its character."""

    def mended(batches):
        for batch in batches:
            for part in few_rows(batch):
                texts = [t if t is None else tx.without_orphans("\ud83d\ude80" + t[: len(t) // 2] + "\ude00" + t[len(t) // 2 :] + "\ud83d") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "t"])

    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").mapInArrow(mended, "id long, t string")
    return t.select("id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("hash"))


@query(f"{VIEW} SELECT id, content_normalized FROM m")
def searchable_text(spark, d):
    return memories(spark, d).select("id", "content_normalized")


@query(f"{VIEW} SELECT id, len(trigrams) AS n FROM m")
def trigram_count(spark, d):
    return memories(spark, d).select("id", F.size("trigrams").cast("long").alias("n"))


@query(f"{VIEW} SELECT id, round({_jac(_grams(_QN), 'trigrams')}, 6) AS jaccard FROM m")
def trigram_jaccard_query(spark, d):
    return memories(spark, d).select("id", r6(tx.jaccard(tx.trigrams(F.lit(Q)), F.col("trigrams")), "jaccard"))


@query(f"{VIEW}, t AS (SELECT id, {_grams('title')} AS a, {_grams('summary')} AS b FROM m) SELECT id FROM t WHERE {_jac('a', 'b')} >= 0.3")
def is_similar_filter(spark, d):
    return memories(spark, d).where(tx.is_similar(F.col("title"), F.col("summary"))).select("id")


@query(f"{VIEW} SELECT id, round({_overlap(_words(_QN, 3), 'content_normalized')}, 6) AS overlap FROM m")
def word_overlap(spark, d):
    return memories(spark, d).select("id", r6(tx.share_contained(tx.words(F.lit(Q), 3), F.col("content_normalized")), "overlap"))


@query(f"{VIEW}, s1 AS ({_stage1(_QN)}) SELECT id, round({_TEXT}, 6) AS score FROM s1 WHERE {_KEEP} ORDER BY {_TEXT} DESC, id LIMIT {TOP}")
def text_search_topk(spark, d):
    return se.text_search(memories(spark, d), Q, TOP, now()).select("id", r6(F.col("_text_score"), "score"))


@query(f"{VIEW}, s1 AS ({_stage1(_QN)}) SELECT id, round({_TEXT}, 6) AS score FROM s1 WHERE {_KEEP} ORDER BY {_TEXT} DESC, id LIMIT {TOP}")
def text_search_indexed(spark, d):
    """The same by the inverted index."""
    m = memories(spark, d)
    return GramIndex.write(m, folder(spark, "index")).text_search(m, Q, TOP, now()).select("id", r6(F.col("_text_score"), "score"))


@query(f"{VIEW}, g AS (SELECT {_grams(_QN)} AS q) SELECT id, len(list_intersect(trigrams, q))::INT AS shared, round({_jac('q', 'trigrams')}, 6) AS fuzzy FROM m, g WHERE len(list_intersect(trigrams, q)) > 0")
def index_probe(spark, d):
    return GramIndex.write(memories(spark, d), folder(spark, "index")).probe(Q).select("id", "shared", r6(F.col("fuzzy"), "fuzzy"))


_SQ = f"'{SHORT}'"


@query(
    f"""{VIEW}, s1 AS ({_stage1(_SQ)}), g AS (SELECT bool_or(len(list_intersect(trigrams, {_grams(_SQ)})) > 0) AS shared FROM m)
SELECT id, round({_TEXT}, 6) AS score FROM s1, g WHERE (len(list_intersect(trigrams, {_grams(_SQ)})) > 0 OR (NOT shared AND contains(content_normalized, {_SQ}))
OR len(list_filter(tags, lambda t: contains({_SQ}, lower(t)) OR contains(lower(t), {_SQ}))) > 0) AND {_KEEP} ORDER BY {_TEXT} DESC, id LIMIT {TOP}"""
)
def text_search_short_query(spark, d):
    return se.text_search(memories(spark, d), SHORT, TOP, now()).select("id", r6(F.col("_text_score"), "score"))


_W3 = _words(_QN, 3)


@query(
    f"""{VIEW}, s1 AS ({_stage1(_QN)}) SELECT id, round({_TEXT}, 6) AS score FROM s1 WHERE (contains(content_normalized, {_QN}) OR len(list_filter(tags, lambda t: contains({_QN}, lower(t))
OR contains(lower(t), {_QN}) OR len(list_filter({_W3}, lambda w: contains(lower(t), w) OR contains(w, lower(t)))) > 0)) > 0) AND {_KEEP} ORDER BY {_TEXT} DESC, id LIMIT {TOP}"""
)
def text_search_substring_mode(spark, d):
    return se.text_search(memories(spark, d), Q, TOP, now(), SUBSTRING).select("id", r6(F.col("_text_score"), "score"))


@query(f"{VIEW} SELECT id, round({_STRENGTH}, 6) AS strength FROM m WHERE list_contains(tags, 'src7') OR list_contains(tags, 'toxic') ORDER BY {_STRENGTH} DESC, id LIMIT 20")
def tag_search(spark, d):
    return se.by_tags(memories(spark, d), ["SRC7", "toxic"], 20, now()).select("id", r6(F.col("strength"), "strength"))


@query(f"{VIEW} SELECT id, round({_STRENGTH}, 6) AS strength FROM m")
def current_strength(spark, d):
    return memories(spark, d).select("id", r6(st.current_strength(now()), "strength"))


@query(f"{VIEW} SELECT id, round({_STRENGTH}, 6) AS strength FROM m WHERE {_STRENGTH} < 0.3 ORDER BY {_STRENGTH}, id LIMIT 100")
def weak_memories(spark, d):
    return se.weak(memories(spark, d), 0.3, 100, now()).select("id", r6(F.col("strength"), "strength"))


@query(f"{VIEW} SELECT id FROM m WHERE {_CURRENT}")
def current_only(spark, d):
    return memories(spark, d).where(st.is_current()).select("id")


@query(f"{VIEW} SELECT id FROM m WHERE expires_at IS NOT NULL AND {_NOW} > expires_at")
def expired(spark, d):
    return memories(spark, d).where(st.is_expired(now())).select("id")


@query(f"{VIEW} SELECT count(*) AS total, round(coalesce(avg({_STRENGTH}), 0), 6) AS average_strength, count(*) FILTER ({_STRENGTH} < 0.3) AS weak, min(created_at)::VARCHAR AS oldest, max(created_at)::VARCHAR AS newest FROM m")
def repository_stats(spark, d):
    s = store.stats(memories(spark, d), now())
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("total", r6(F.col("average_strength"), "average_strength"), "weak", day("oldest"), day("newest"))


@query(
    f"""{VIEW} SELECT m.id, CASE WHEN is_archived THEN 0 ELSE access_count END AS access_count, round(CASE WHEN is_archived THEN 1 ELSE base_strength END, 6) AS base_strength,
strftime(CASE WHEN is_archived THEN created_at ELSE last_accessed_at END, '%Y-%m-%d %H:%M:%S') AS last FROM m"""
)
def reinforce_from_log(spark, d):
    r = store.reinforce(memories(spark, d, accessed=False), access_log(spark, d))
    return r.select("id", "access_count", r6(F.col("base_strength"), "base_strength"), F.date_format("last_accessed_at", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query(f"{VIEW} SELECT id, round({_RECENCY}, 6) AS recency FROM m")
def recency_score(spark, d):
    return memories(spark, d).select("id", r6(st.recency_score(now(), F.col("last_accessed_at")), "recency"))


@query(f"{VIEW} SELECT id, round(least(1.0, {_STRENGTH} / 2), 6) AS score FROM m")
def strength_score(spark, d):
    return memories(spark, d).select("id", r6(st.strength_score(st.current_strength(now())), "score"))


@query(f"{VIEW} SELECT id, round({_fuzzy(_QN)}, 6) AS fuzzy FROM m")
def fuzzy_score(spark, d):
    return memories(spark, d).select("id", r6(se.fuzzy_score(se.Probe.literal(spark, Q)), "fuzzy"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", r6(F.col("fuzzy_score"), "fuzzy"), r6(F.col("semantic_score"), "semantic"), r6(F.col("score"), "score"))


def _query_vector(spark, d):
    first = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)).cast("float") for x in first[0]])


@query(_hybrid(_QN, TOP, None))
def hybrid_search_lexical(spark, d):
    return _hits(se.search(memories(spark, d), Q, TOP, now()))


@query(_hybrid(_QN, TOP, _SEM))
def hybrid_search_semantic(spark, d):
    return _hits(se.search(memories(spark, d), Q, TOP, now(), vector=_query_vector(spark, d)))


@query(_hybrid(_QN, TOP, None, "(list_contains(tags, 'src3') OR list_contains(tags, 'de'))"))
def hybrid_search_tagged(spark, d):
    return _hits(se.search(memories(spark, d), Q, TOP, now(), tags=["SRC3", "de"]))


_BATCH_FROM = "SELECT item_id AS query_id, left(regexp_replace(text, '\\s+', ' ', 'g'), 40) AS query FROM benchmark"


def _batch_queries(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.left(F.regexp_replace("text", r"\s+", " "), F.lit(40)).alias("query"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return b.join(v, "query_id", "left")


def _batch_sql(queries: str, top: int, tail: str) -> str:
    sem = f"CASE WHEN embedding IS NULL OR query_vector IS NULL THEN 0 ELSE ({_cos('query_vector', 'embedding')} + 1) / 2 END"
    s = f"least(1.0, {_STRENGTH} / 2)"
    score = f"(CASE WHEN query_vector IS NULL THEN 0.5 * fuzzy + 0.3 * {s} + 0.2 * {_RECENCY} ELSE 0.4 * sem + 0.3 * fuzzy + 0.2 * {s} + 0.1 * {_RECENCY} END)"
    ws = _words("q", 3)
    return f"""{VIEW}, qs AS ({queries}), qn AS (SELECT *, {_norm('query')} AS q FROM qs), mq AS (SELECT m.*, qn.query_id, qn.q, qn.query_vector, {_grams('q')} AS qg FROM m, qn WHERE q <> ''),
s1 AS (SELECT *, {_jac('qg', 'trigrams')} AS fz, {_overlap(ws, 'content_normalized')} AS ov, CASE WHEN contains(content_normalized, q) THEN 0.5 ELSE 0 END AS ex,
  CASE WHEN len(list_filter(tags, lambda t: len(list_filter({ws}, lambda w: contains(lower(t), w))) > 0)) > 0 THEN 0.3 ELSE 0 END AS tg FROM mq),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_TEXT} DESC, id) AS k FROM s1 WHERE {_KEEP}),
f AS (SELECT *, {_fuzzy('q')} AS fuzzy, {sem} AS sem FROM c WHERE k <= {3 * top} AND {_CURRENT}),
h AS (SELECT *, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rank FROM f),
hits AS (SELECT * FROM h WHERE rank <= {top}) {tail}"""


@query(_batch_sql(f"SELECT b.*, e.embedding AS query_vector FROM ({_BATCH_FROM}) b LEFT JOIN embeddings e ON e.vec_id = b.query_id", 5, "SELECT query_id, id, rank, round(score, 6) AS score FROM hits"))
def batch_search(spark, d):
    return se.batch_search(memories(spark, d), _batch_queries(spark, d), 5, now()).select("query_id", "id", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


_V0, _QV = "qe", "(SELECT embedding AS qe FROM embeddings WHERE vec_id = 0) qv"


@query(f"SELECT vec_id, round({_cos('embedding', _V0)}, 6) AS cosine FROM embeddings, {_QV} ORDER BY {_cos('embedding', _V0)} DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    c = vec.cosine(F.col("embedding"), _query_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", c.alias("c")).orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", r6(F.col("c"), "cosine"))


@query(f"{VIEW} SELECT id, round(({_cos('embedding', _V0)} + 1) / 2, 6) AS similarity FROM m, {_QV}")
def normalized_cosine(spark, d):
    return memories(spark, d).select("id", r6(vec.normalized_cosine(F.col("embedding"), _query_vector(spark, d)), "similarity"))


_EU = f"sqrt(list_sum([pow(embedding[i]::DOUBLE - {_V0}[i]::DOUBLE, 2) FOR i IN range(1, len(embedding) + 1)]))"


@query(f"SELECT vec_id, round({_EU}, 6) AS distance FROM embeddings, {_QV} ORDER BY {_EU}, vec_id LIMIT 10")
def euclidean_topk(spark, d):
    e = vec.euclidean(F.col("embedding"), _query_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", e.alias("e")).orderBy("e", "vec_id").limit(10).select("vec_id", r6(F.col("e"), "distance"))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings) SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) AS first, round(embedding[-1]::DOUBLE / n, 6) AS last FROM n")
def l2_normalize_check(spark, d):
    u = vec.l2_normalized(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", r6(F.element_at(u, 1), "first"), r6(F.element_at(u, -1), "last"))


def _prep(x: str) -> str:
    x = rf"regexp_replace({x}, '[^\x20-\x7E\t\n\r]', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)https?://[^\s]+|www\.[^\s]+', ' [URL] ', 'g')"
    x = rf"regexp_replace({x}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}', ' [EMAIL] ', 'g')"
    for c in "!?.,;:":
        x = f"regexp_replace({x}, '[{c}]{{2,}}', '{c}', 'g')"
    return rf"left(trim(regexp_replace({x}, '\s+', ' ', 'g')), 1024)"


@query(f"SELECT doc_id AS id, {_prep('text')} AS prepared FROM documents")
def embedding_prep(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.embedding_text(F.col("text")).alias("prepared"))


_HB = "[('0x' || substr(md5(g), 1, 8))::BIGINT % 384 FOR g IN g3]"


@query(f"WITH p AS (SELECT doc_id, {_prep('text')} AS t FROM documents), q AS (SELECT doc_id, {_padded('t')} AS padded FROM p), g AS (SELECT doc_id, {_OF_PADDED} AS g3 FROM q), h AS (SELECT doc_id, {_HB} AS b FROM g) SELECT doc_id AS id, len(b) AS n, coalesce(list_sum(b), 0)::BIGINT AS total, coalesce(list_max(b), -1)::BIGINT AS highest FROM h")
def hashed_embedding(spark, d):
    b = HashedTrigramEmbedder().buckets(F.col("text"))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), b.alias("b"))
    return t.select("id", F.size("b").cast("long").alias("n"), F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.coalesce(F.array_max("b"), F.lit(-1)).cast("long").alias("highest"))


_INCOMING = "SELECT item_id + 5000000 AS query_id, left(regexp_replace(text, '\\s+', ' ', 'g'), 60) || ' ' || left(regexp_replace(text, '\\s+', ' ', 'g'), 80) AS query, e.embedding AS query_vector FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id + 100"
_VERDICTS = _batch_sql(
    _INCOMING,
    10,
    f""", per AS (SELECT query_id, min_by(id, rank) FILTER (sem >= {LOW.duplicate}) AS target, min(rank) FILTER (sem >= {LOW.coexist}) AS near FROM hits GROUP BY query_id),
old AS (SELECT id, min(h.query_id) AS query_id FROM hits h JOIN per p ON p.query_id = h.query_id AND p.target IS NULL WHERE sem >= {LOW.supersede} AND sem < {LOW.duplicate} GROUP BY id),
sup AS (SELECT query_id, list_sort(list(id)) AS superseded FROM old GROUP BY query_id),
v AS (SELECT q.query_id AS id, CASE WHEN target IS NOT NULL THEN 'ReinforcedExisting' WHEN superseded IS NOT NULL THEN 'StoredWithSupersede' WHEN near IS NOT NULL THEN 'StoredCoexist' ELSE 'StoredNew' END AS action,
  target, superseded FROM qs q LEFT JOIN per USING (query_id) LEFT JOIN sup USING (query_id)) """,
)


def _incoming(spark, d):
    flat = F.regexp_replace("text", r"\s+", " ")
    b = table(spark, d, "benchmark").select((F.col("item_id") + 5_000_000).alias("id"), F.left(flat, F.lit(60)).alias("title"), F.left(flat, F.lit(80)).alias("summary"), F.col("text").alias("content"), (F.col("item_id") + 100).alias("vec_id"))
    return b.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")


def _verdicts(spark, d):
    return conflict.classify(memories(spark, d), _incoming(spark, d), now(), LOW)


@query(f"{_VERDICTS} SELECT id, action, target, coalesce(len(superseded), 0) AS n_superseded FROM v")
def conflict_classify(spark, d):
    return _verdicts(spark, d).select("id", "action", "target", F.size("superseded").cast("long").alias("n_superseded"))


@query(f"{_VERDICTS} SELECT unnest(superseded) AS old_id, id AS new_id FROM v")
def supersede_edges(spark, d):
    return conflict.supersede_edges(_verdicts(spark, d))


@query(
    f"""{_VERDICTS}, seen AS (SELECT id, count(*) AS n FROM hits GROUP BY id), text AS (SELECT item_id + 5000000 AS id, text AS t FROM benchmark),
dup AS (SELECT target AS id, count(*) AS n, max(length(t)) AS chars FROM v JOIN text USING (id) WHERE target IS NOT NULL GROUP BY target),
prior AS (SELECT unnest(superseded) AS id, id AS new_id FROM v),
a AS (SELECT m.*, coalesce(seen.n, 0) + coalesce(dup.n, 0) AS more, dup.chars, new_id FROM m LEFT JOIN seen USING (id) LEFT JOIN dup USING (id) LEFT JOIN prior USING (id))
SELECT id, access_count + more AS access_count, round(base_strength + coalesce(list_sum([0.1::DOUBLE / sqrt(k) FOR k IN range(access_count + 1, access_count + more + 1)]), 0), 6) AS base_strength,
  is_archived OR new_id IS NOT NULL AS is_archived, coalesce(new_id, superseded_by) AS superseded_by, greatest(length(content), coalesce(chars, 0)) AS chars, 0::BIGINT AS n_superseded FROM a
UNION ALL SELECT v.id, 0, 1.0, false, NULL, length(t), coalesce(len(superseded), 0) FROM v JOIN text USING (id) WHERE target IS NULL"""
)
def conflict_state(spark, d):
    """All memories after a batch of conflict-aware stores."""
    none = F.array().cast("array<bigint>")
    m = memories(spark, d).withColumn("superseded_ids", none)
    new = _incoming(spark, d)
    blank = {"access_count": F.lit(0), "base_strength": F.lit(1.0), "is_archived": F.lit(False), "superseded_ids": none}
    rows = new.select(*[F.col(f.name) if f.name in new.columns else blank.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in m.schema])
    after = conflict.apply(m, rows, written(conflict.classify(m, rows, now(), LOW)), now(), LOW)
    return after.select("id", F.col("access_count").cast("long").alias("access_count"), r6(F.col("base_strength"), "base_strength"), "is_archived", "superseded_by", F.length("content").cast("long").alias("chars"), F.size("superseded_ids").cast("long").alias("n_superseded"))


_NEXT = "CASE WHEN doc_id % 50 = 49 THEN doc_id - 2 WHEN doc_id % 7 <> 3 THEN doc_id + 1 + doc_id % 3 END"


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id AS id, {_NEXT} AS next FROM documents), e AS (SELECT p.id, p.next FROM p JOIN p q ON q.id = p.next),
walk AS (SELECT id, id AS at, [id] AS path FROM p UNION ALL SELECT w.id, e.next, list_append(path, e.next) FROM walk w JOIN e ON e.id = w.at WHERE NOT list_contains(path, e.next)),
ends AS (SELECT w.* FROM walk w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = w.at))
SELECT p.id, ends.at AS head, len(path) - 1 AS depth, ends.id IS NULL AS cyclic, array_to_string(path, '>') AS path FROM p LEFT JOIN ends USING (id)"""
)
def supersede_chains(spark, d):
    """Every document as a memory that a later one supersedes, with cycles here and there."""
    rows = table(spark, d, "documents").selectExpr("doc_id AS id", f"{_NEXT} AS superseded_by")
    return conflict.supersede_chains(rows, with_path=True).withColumn("path", F.array_join("path", ">"))


@query(
    f"""{VIEW} SELECT id, title, CASE WHEN {_CURRENT} THEN 'CURRENT' ELSE 'Superseded' END AS status, superseded_by,
strftime(valid_from, '%Y-%m-%d') || ' to ' || coalesce(strftime(valid_until, '%Y-%m-%d'), 'present') AS validity FROM m WHERE list_contains(tags, '{TAG}')"""
)
def tag_history(spark, d):
    return conflict.tag_history(memories(spark, d), TAG.upper(), now()).drop("strength")


_PAIRS = f"""{VIEW}, live AS (SELECT id, {_grams('content_normalized')} AS g FROM m WHERE NOT is_archived),
pairs AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, {_jac('a.g', 'b.g')} AS s FROM live a JOIN live b ON a.id < b.id AND least(len(a.g), len(b.g)) >= 0.8 * greatest(len(a.g), len(b.g)) - 1e-6) WHERE s >= 0.8)"""


@query(f"{_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM pairs")
def similar_pairs(spark, d):
    return maintain.similar_pairs(memories(spark, d).where("not is_archived"), 0.8).select("a", "b", r6(F.col("similarity"), "similarity"))


_BLENDED = f"""{VIEW}, live AS (SELECT id, embedding, {_grams('content_normalized')} AS g FROM m WHERE NOT is_archived),
pairs AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, {_jac('a.g', 'b.g')} AS j, CASE WHEN a.embedding IS NOT NULL AND b.embedding IS NOT NULL THEN 0.6 * {_cos('a.embedding', 'b.embedding')} + 0.4 * {_jac('a.g', 'b.g')} ELSE {_jac('a.g', 'b.g')} END AS s
  FROM live a JOIN live b ON a.id < b.id AND least(len(a.g), len(b.g)) >= 0.5 * greatest(len(a.g), len(b.g)) - 1e-6 WHERE {_jac('a.g', 'b.g')} >= 0.49) WHERE s >= 0.8)"""


@query(f"{_BLENDED} SELECT a, b, round(s, 6) AS similarity FROM pairs")
def similar_pairs_blended(spark, d):
    return maintain.similar_pairs(memories(spark, d).where("not is_archived"), 0.8, use_vectors=True).select("a", "b", r6(F.col("similarity"), "similarity"))


_LEADERS = (
    _PAIRS.replace("WITH lg", "WITH RECURSIVE lg", 1)
    + """, ids AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs),
n AS (SELECT ids.id, row_number() OVER (ORDER BY ids.id) AS k, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS smaller FROM ids LEFT JOIN pairs p ON p.b = ids.id GROUP BY ids.id),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS leaders UNION ALL
  SELECT n.k, CASE WHEN list_has_any(walk.leaders, n.smaller) THEN walk.leaders ELSE list_append(walk.leaders, n.id) END FROM walk JOIN n ON n.k = walk.k + 1),
final AS (SELECT leaders FROM walk ORDER BY k DESC LIMIT 1),
led AS (SELECT n.id, CASE WHEN list_contains(leaders, n.id) THEN n.id ELSE list_min(list_intersect(n.smaller, leaders)) END AS leader FROM n, final)"""
)


@query(f"{_LEADERS} SELECT id, leader FROM led")
def leader_clusters(spark, d):
    return maintain.similar_clusters(memories(spark, d).where("not is_archived"), 0.8)


_CONSOLIDATED = f"""{_LEADERS}, c AS (SELECT led.id, leader, {_STRENGTH} AS s FROM led JOIN m ON m.id = led.id),
c2 AS (SELECT *, first_value(id) OVER (PARTITION BY leader ORDER BY s DESC, id) AS survivor, count(*) OVER (PARTITION BY leader) AS n FROM c)"""


@query(f"{_CONSOLIDATED} SELECT id, leader AS cluster, survivor, CASE WHEN id = survivor THEN 'keep' ELSE 'archive' END AS action FROM c2 WHERE n > 1")
def consolidate_apply(spark, d):
    return maintain.consolidate(memories(spark, d), now())


@query(
    f"""{_CONSOLIDATED} SELECT m.id, m.is_archived OR coalesce(n > 1 AND c2.id <> survivor, false) AS is_archived, CASE WHEN n > 1 AND c2.id <> survivor THEN survivor ELSE superseded_by END AS superseded_by,
access_count + CASE WHEN n > 1 AND c2.id = survivor THEN 1 ELSE 0 END AS access_count, round(base_strength + CASE WHEN n > 1 AND c2.id = survivor THEN 0.1::DOUBLE / sqrt(access_count + 1) ELSE 0 END, 6) AS base_strength
FROM m LEFT JOIN c2 ON c2.id = m.id"""
)
def consolidation_state(spark, d):
    """All memories after consolidation."""
    m = memories(spark, d)
    after = maintain.apply_consolidation(m, written(maintain.consolidate(m, now())), now())
    return after.select("id", "is_archived", "superseded_by", "access_count", r6(F.col("base_strength"), "base_strength"))


@query(f"{_CONSOLIDATED} SELECT count(DISTINCT leader) AS merged, count(*) FILTER (id <> survivor) AS archived FROM c2 WHERE n > 1")
def consolidation_stats(spark, d):
    return maintain.consolidate(memories(spark, d), now()).agg(F.count_distinct("cluster").alias("merged"), F.count_if(F.col("action") == "archive").alias("archived"))


@query(f"{VIEW} SELECT id FROM m WHERE {_STRENGTH} >= 0.1")
def prune_survivors(spark, d):
    return maintain.prune(memories(spark, d), now()).select("id")


@query(
    f"""{VIEW} SELECT count(*) AS total, count(*) FILTER ({_STRENGTH} < 0.1) AS pruned, round(coalesce(avg({_STRENGTH}), 0), 6) AS average_before,
round(coalesce(avg({_STRENGTH}) FILTER ({_STRENGTH} >= 0.1), 0), 6) AS average_after FROM m"""
)
def decay_stats(spark, d):
    return maintain.decay_report(memories(spark, d), now()).select("total", "pruned", r6(F.col("average_before"), "average_before"), r6(F.col("average_after"), "average_after"))


_WHOLE = "title || ' ' || summary || ' ' || content"


@query(f"{VIEW}, w0 AS (SELECT embedding, {_padded(_WHOLE)} AS padded FROM m), w AS (SELECT embedding, {_OF_PADDED} AS g FROM w0) SELECT count(*) AS memories, sum(len(g))::BIGINT AS trigrams_generated, count(embedding) AS embeddings FROM w")
def reindex_counts(spark, d):
    return maintain.reindex_report(memories(spark, d))


@query(f"{VIEW} SELECT id, content_normalized, len(trigrams) AS n FROM m")
def reindex_rebuild(spark, d):
    """The index columns are lost, and computed anew."""
    lost = memories(spark, d).withColumn("content_normalized", F.lit("lost")).withColumn("trigrams", F.array(F.lit("los")))
    return maintain.reindex(lost).select("id", "content_normalized", F.size("trigrams").cast("long").alias("n"))


@query(
    _hybrid(_QN, TOP, None).rsplit("SELECT id, round(fuzzy", 1)[0]
    + f"SELECT title, printf('%.2f', 0.5 * fuzzy + 0.3 * least(1.0, {_STRENGTH} / 2) + 0.2 * {_RECENCY}) AS score, id, summary, array_to_string(tags, ', ') AS tags FROM f ORDER BY 0.5 * fuzzy + 0.3 * least(1.0, {_STRENGTH} / 2) + 0.2 * {_RECENCY} DESC, id LIMIT {TOP}"
)
def search_result_format(spark, d):
    return se.search(memories(spark, d), Q, TOP, now()).select(*report.search_result())


@query(f"{VIEW} SELECT title, id, summary, content, array_to_string(tags, ', ') AS tags, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, printf('%.2f', {_STRENGTH}) AS strength FROM m")
def memory_detail_format(spark, d):
    return memories(spark, d).select(*report.detail(now()))


def _stored(spark, d) -> MemoryStore:
    s = MemoryStore(spark, folder(spark, "store"))
    s.save(memories(spark, d))
    s.save(s.scan().where("id % 3 = 0"))
    s.delete(["1", "2", "not there"])
    return s


@query("SELECT doc_id::VARCHAR AS id, length(text) AS chars FROM documents WHERE doc_id NOT IN (1, 2)")
def snapshot_compact(spark, d):
    s = _stored(spark, d)
    s.compact()
    return s.scan().select("id", F.length("content").cast("long").alias("chars"))


@query("SELECT true AS has_size, true AS is_smaller, count(*) AS memories FROM documents WHERE doc_id NOT IN (1, 2)")
def storage_size(spark, d):
    """Whether compaction leaves bytes, and no more than there were; and the memories."""
    s = _stored(spark, d)
    done = s.compact()
    return s.scan().agg(F.lit(done["after"] > 0).alias("has_size"), F.lit(done["after"] <= done["before"]).alias("is_smaller"), F.count("*").alias("memories"))


QUERIES = {k: f for k, (f, _) in REGISTRY.items()}
SQL = {k: s for k, (_, s) in REGISTRY.items() if s}
