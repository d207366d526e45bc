"""Every operator as a query over the driver's tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, text as tx
from ..operators import answering, chunking, evaluation, filters, health, search, store, synth
from ..sources import clean, loaders
from ..tables import ensure, version_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than there are cores is dealt out to all of them. Large tables, which have
    more, are left as they are."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def _docs(spark, d, *more) -> DataFrame:
    return _spread(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", *more))


def _asks(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, d) -> search.KeywordIndex:
    """The keyword index of documents, built by the first query that needs it and used until the files change."""
    raw = _t(spark, d, "documents")
    return search.KeywordIndex.build(_docs(spark, d), version_of(raw), "documents-terms")


def _search(spark, d, k, **options) -> DataFrame:
    return search.bm25(_asks(spark, d), _docs(spark, d), k, index=_index(spark, d), **options)


TOK = tx.keyword_tokens_sql

# ---------------------------------------------------------------- keyword search

_TF = f"toks AS (SELECT doc_id AS id, {TOK('text')} AS t FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY ALL)"
_BM25 = f"""{_TF}, st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK('text')}) AS term FROM benchmark),
scored AS (
  SELECT q.query_id, tf.id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * len(toks.t) / st.mean))), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN toks ON toks.id = tf.id, st GROUP BY ALL
)"""


def _ranked(source: str, k: int, name: str = "r", order: str = "score DESC, id", where: str = "") -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS \"rank\", score FROM {source} {where}) WHERE \"rank\" <= {k})"


@query(f"WITH {_TF} SELECT id, term, tf FROM tf")
def tokenize_tf(spark, d):
    return search.term_counts(_docs(spark, d)).select("id", "term", "tf")


@query(f"SELECT doc_id AS id, CAST(len({TOK('text')}) AS BIGINT) AS dl FROM documents")
def doc_length(spark, d):
    return search.document_lengths(_docs(spark, d))


@query(f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_freq(spark, d):
    return _index(spark, d).frequencies()


@query(f"WITH {_BM25}, {_ranked('scored', 10)} SELECT * FROM r")
def bm25_topk(spark, d):
    return _search(spark, d, 10)


@query(f"WITH {_BM25}, f AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.id WHERE d.lang IN ('en', 'de')), {_ranked('f', 5)} SELECT * FROM r")
def bm25_filtered_topk(spark, d):
    docs = _docs(spark, d, "lang")
    return _search(spark, d, 5, keep=docs.where(filters.compile_filter({"lang": {"$in": ["en", "de"]}}, docs)))


# ---------------------------------------------------------------- dense search

_KNN = """v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT q.id AS query_id, c.id, c.label, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0)"""


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _vector_asks(spark, d):
    return _vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")


@query(f"WITH {_KNN}, {_ranked('pairs', 10)} SELECT * FROM r")
def dense_knn_topk(spark, d):
    return search.nearest(_vector_asks(spark, d), _vectors(spark, d), 10)


@query(f"WITH {_KNN}, {_ranked('pairs', 5, where='WHERE label <= 3')} SELECT * FROM r")
def dense_knn_filtered(spark, d):
    v = _vectors(spark, d)
    return search.nearest(_vector_asks(spark, d), v.where(filters.compile_filter({"label": {"$lte": 3}}, v)), 5)


_SLOTS = """hw AS (SELECT id, word, count(*) AS n, md5(word) AS h FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS word FROM {table}) GROUP BY id, word),
hs AS (SELECT id, slot, CAST(sum(w) AS BIGINT) AS w FROM (SELECT id, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 384 AS slot, CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN n ELSE -n END AS w FROM hw) GROUP BY id, slot HAVING sum(w) <> 0)"""


@query(f"WITH {_SLOTS.format(id='doc_id', table='documents')} SELECT id, slot, w FROM hs")
def hashing_embed_sparse(spark, d):
    return search.hashed_slots(_docs(spark, d)).select("id", "slot", F.col("w").cast("long").alias("w"))


_DENSE_TEXT = f"""{_SLOTS.format(id='doc_id', table='documents').replace('hw', 'dw').replace('hs', 'ds')}, {_SLOTS.format(id='item_id', table='benchmark').replace('hw', 'qw').replace('hs', 'qs')},
dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM ds GROUP BY id), qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM qs GROUP BY id),
dense AS (SELECT qs.id AS query_id, ds.id, round(sum(qs.w * ds.w) / (qn.n * dn.n), 4) AS score FROM qs JOIN ds USING (slot) JOIN dn ON dn.id = ds.id JOIN qn ON qn.id = qs.id GROUP BY qs.id, ds.id, qn.n, dn.n)"""


def _dense_text(spark, d, k):
    asks = search.hashed_vectors(_asks(spark, d).withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id")
    vectors = ensure(spark, "documents-vectors", version_of(_t(spark, d, "documents")), lambda: search.hashed_vectors(_docs(spark, d)))
    return search.nearest(asks, vectors, k, digits=4, same=True)


@query(f"WITH {_DENSE_TEXT}, {_ranked('dense', 5)} SELECT * FROM r WHERE score > 0.05")
def dense_text_topk(spark, d):
    return _dense_text(spark, d, 5).where("score > 0.05")


_HYBRID = f"""{_BM25}, {_ranked('scored', 20, 's')}, {_DENSE_TEXT}, {_ranked('dense', 20, 'd')}"""


@query(f"""WITH {_HYBRID},
u AS (SELECT query_id, id, "rank", 0 AS l, 1.4::DOUBLE / (60 + "rank") AS x FROM d UNION ALL SELECT query_id, id, "rank", 1, 0.6::DOUBLE / (60 + "rank") FROM s),
f AS (SELECT query_id, id, round(sum(x), 9) AS score, min(l * 1000 + "rank") AS first FROM u GROUP BY ALL),
o AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS "rank", score FROM f) SELECT * FROM o WHERE "rank" <= 10""")
def hybrid_search(spark, d):
    return search.rrf([_dense_text(spark, d, 20), _search(spark, d, 20)], 10, weights=[1.4, 0.6])


@query(f"""WITH {_HYBRID},
dn2 AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM d WINDOW w AS (PARTITION BY query_id)),
sn AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM s WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, round(0.7::DOUBLE * coalesce(a.x, 0) + (1 - 0.7::DOUBLE) * coalesce(b.x, 0), 6) AS score FROM dn2 a FULL JOIN sn b USING (query_id, id)), {_ranked('f', 10)} SELECT * FROM r""")
def weighted_minmax_fuse(spark, d):
    return search.weighted(_dense_text(spark, d, 20), _search(spark, d, 20), 10, 0.7)


@query(f"""WITH {_BM25}, {_ranked('scored', 10, 'a')}, {_ranked('scored', 10, 'b', 'id')},
u AS (SELECT query_id, id, "rank", 0 AS l FROM a UNION ALL SELECT query_id, id, "rank", 1 FROM b),
f AS (SELECT query_id, id, round(sum(1::DOUBLE / (60 + "rank")), 9) AS score, min(l * 1000 + "rank") AS first FROM u GROUP BY ALL),
o AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS "rank", score FROM f) SELECT * FROM o WHERE "rank" <= 10""")
def rrf_fuse(spark, d):
    a = _search(spark, d, 10)
    return search.rrf([a, _search(spark, d, 10, by_id=True)], 10)


# ---------------------------------------------------------------- chunks and parents

_WINDOWS = """w AS (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 1200) / 1050.0) AS INTEGER)))) AS ordinal FROM documents WHERE length(coalesce(text, '')) > 0)"""


@query(f"WITH {_WINDOWS} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(ordinal * 1050 AS INTEGER) AS start, substr(text, CAST(ordinal * 1050 + 1 AS INTEGER), 1200) AS text FROM w")
def chunk_fixed_sql(spark, d):
    return chunking.fixed_windows(_docs(spark, d))


def _chunks(spark, d, method):
    return chunking.chunk(_docs(spark, d), method)


@query()
def chunk_fixed(spark, d):
    return _chunks(spark, d, "fixed").select("id", "doc_id", "ordinal", "text", "page")


@query()
def chunk_structure(spark, d):
    return _chunks(spark, d, "structure").select("id", "doc_id", "ordinal", "text", "heading_path", "page")


@query()
def chunk_parent_child(spark, d):
    return chunking.split_parents(_chunks(spark, d, "parent_child"))[0].select("id", "doc_id", "text", "parent_id")


@query()
def chunk_semantic(spark, d):
    return _chunks(spark, d, "semantic").select("id", "doc_id", "ordinal", "text")


@query(f"""WITH {_WINDOWS}, c AS (SELECT doc_id * 1000 + ordinal AS cid, doc_id, substr(text, CAST(ordinal * 1050 + 1 AS INTEGER), 1200) AS text FROM w),
toks AS (SELECT cid AS id, {TOK('text')} AS t FROM c), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK('text')}) AS term FROM benchmark),
scored AS (SELECT q.query_id, tf.id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * len(toks.t) / st.mean))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN toks ON toks.id = tf.id, st GROUP BY ALL),
{_ranked('scored', 20, 'top20')}, p AS (SELECT query_id, id // 1000 AS pid, min("rank") AS best_at, arg_min(score, "rank") AS score FROM top20 GROUP BY ALL)
SELECT query_id, pid AS id, CAST("rank" AS INTEGER) AS "rank", score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_at, pid) AS "rank" FROM p) WHERE "rank" <= 5""")
def parent_expand(spark, d):
    windows = chunking.fixed_windows(_docs(spark, d)).select((F.col("doc_id") * 1000 + F.col("ordinal")).alias("id"), "text", F.col("doc_id").alias("parent_id"))
    index = search.KeywordIndex.build(windows.select("id", "text"), version_of(_t(spark, d, "documents")), "windows-terms")
    return search.expand_parents(search.bm25(_asks(spark, d), windows, 20, index=index), windows.select("id", "parent_id"), 5)


# ---------------------------------------------------------------- filters and access

def _filtered(name, flt, where):
    def run(spark, d):
        docs = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
        return docs.where(filters.compile_filter(flt, docs))

    run.__name__ = name
    query(f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {where}")(run)


_filtered("filter_eq", {"lang": "de"}, "lang = 'de'")
_filtered("filter_ne", {"lang": {"$ne": "en"}}, "lang IS DISTINCT FROM 'en'")
_filtered("filter_in", {"source": {"$in": ["src1", "src2", None]}}, "source IN ('src1', 'src2') OR source IS NULL")
_filtered("filter_nin", {"source": {"$nin": ["src1", "src2"]}}, "coalesce(source NOT IN ('src1', 'src2'), true)")
_filtered("filter_range", {"n_chars": {"$gte": 1000, "$lt": 3000}}, "n_chars >= 1000 AND n_chars < 3000")
_filtered("filter_and_or", {"$or": [{"lang": "fr"}, {"$and": [{"source": "src3"}, {"n_chars": {"$gt": 500}}]}]}, "lang = 'fr' OR (source = 'src3' AND n_chars > 500)")
_filtered("filter_kind_mismatch", {"$or": [{"n_chars": {"$gt": "5"}}, {"lang": "fr"}]}, "lang = 'fr'")


@query("""WITH t AS (SELECT d.doc_id, list_filter([d.lang, CASE WHEN l.quality = 1 THEN 'good' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id FROM t WHERE list_has_any(tags, ['toxic', 'fr']) AND NOT list_contains(tags, 'good')""")
def filter_list_overlap(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    tags = F.array_compact(F.array("lang", F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    x = x.select("doc_id", tags.alias("tags"))
    return x.where(filters.compile_filter({"$and": [{"tags": {"$in": ["toxic", "fr"]}}, {"tags": {"$ne": "good"}}]}, x)).select("doc_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 19 AND event_type <> 'error'")
def filter_json_field(spark, d):
    x = _t(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return x.where(filters.compile_filter({"k": {"$gte": 10, "$lte": 19}, "event_type": {"$ne": "error"}}, x)).select("event_id", "k")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src4', '*') AND lang IN ('en', '*')")
def access_scope(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    rules = filters.AccessRules(roles="source", attributes={"lang": "language"})
    caller = filters.Caller(roles=("src1", "src4"), attributes={"language": "en"})
    return docs.where(filters.compile_filter(rules.filter_for(caller), docs)).select("doc_id", "source")


# ---------------------------------------------------------------- sources and clean-up

@query()
def html_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", loaders.html_text(F.col("html")).alias("x")).select("page_id", "x.text", "x.title")


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def html_headings(spark, d):
    return _t(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")
    )


_HASH = r"substr(sha256(trim(regexp_replace(lower(coalesce(text, '')), '[\x09-\x0D\x20]+', ' ', 'g'))), 1, 16)"


@query(f"SELECT {_HASH} AS hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def cross_doc_duplicates(spark, d):
    return health.duplicates(_docs(spark, d))


@query(f"SELECT min(doc_id) AS id, {_HASH} AS hash FROM documents GROUP BY 2")
def dedupe_exact(spark, d):
    return health.duplicate_members(_docs(spark, d)).groupBy("hash").agg(F.min("id").alias("id"))


@query("""WITH l AS (SELECT id, line, count(*) AS n FROM (SELECT id, trim(line, ' ') AS line FROM (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)) WHERE line <> '' GROUP BY ALL)
SELECT id, round(CAST(sum(CASE WHEN n >= 3 AND length(line) >= 12 THEN length(line) * n ELSE 0 END) AS DOUBLE) / sum(length(line) * n), 6) AS share FROM l GROUP BY id""")
def repeated_line_share(spark, d):
    return health.repeated_share(_docs(spark, d))


_FIG = r"""f AS (SELECT doc_id AS id, coalesce(text, '') AS t, length(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]', '', 'g')) AS visible, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÖØ-öø-ÿ]')) AS DOUBLE) AS letters, regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÖØ-öø-ÿ]+') AS w FROM documents),
g AS (SELECT id, CAST(length(t) AS BIGINT) AS chars, CAST(len(w) AS BIGINT) AS words, CAST(length(t) - length(replace(t, chr(12), '')) + 1 AS BIGINT) AS pages, CAST(len(regexp_extract_all(t, '(?m)^#{1,6} ')) AS BIGINT) AS headings, CAST(visible AS BIGINT) AS visible,
 round(letters / greatest(visible, 1), 6) AS letter_ratio, round(CAST(len(list_filter(w, lambda x: length(x) = 1 AND lower(x) NOT IN ('a', 'i'))) AS DOUBLE) / greatest(len(w), 1), 6) AS single_ratio, round(letters / greatest(len(w), 1), 6) AS word_length FROM f)"""
_MORE = r"SELECT g.*, CAST(len(regexp_extract_all(t, '(?m)^\|[ :|-]*-[ :|-]*\|$')) AS BIGINT) AS tables, round(len(regexp_extract_all(t, chr(65533))) / greatest(f.visible, 1), 6) AS bad_ratio FROM g JOIN f USING (id)"


@query(f"WITH {_FIG} {_MORE}")
def file_health(spark, d):
    return health.figures(_docs(spark, d))


@query()
def chunk_fragments(spark, d):
    return health.chunk_health(_chunks(spark, d, "structure"))


# ---------------------------------------------------------------- guardrails

_EMAIL = guards.PII["email"].replace("'", "''")


@query(f"SELECT doc_id AS id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_EMAIL}')) AS BIGINT) AS emails, regexp_matches(coalesce(text, ''), '{guards.PII['ip']}') AS has_ip FROM documents")
def pii_detect(spark, d):
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("id", F.regexp_count(t, F.lit(guards.PII["email"])).cast("long").alias("emails"), t.rlike(guards.PII["ip"]).alias("has_ip"))


_PERSONAL = {k: guards.PII[k].replace("'", "''") for k in ("ssn", "email", "ip", "phone")}


@query(f"""SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_PERSONAL["ssn"]}', '[SSN]', 'g'), '{_PERSONAL["email"]}', '[EMAIL]', 'g'), '{_PERSONAL["ip"]}', '[IP]', 'g'), '{_PERSONAL["phone"]}', '[PHONE]', 'g') AS text
FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' Call +49 170 1234567 or 123-45-6789.' ELSE '' END AS t FROM documents)""")
def pii_redact(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("id") % 3 == 0, " Call +49 170 1234567 or 123-45-6789.").otherwise(""))
    return _docs(spark, d).select("id", guards.redact(text, ("ssn", "email", "ip", "phone")).alias("text"))


@query("SELECT conv_id, turn, " + " + ".join(f"CAST(regexp_matches(coalesce(text, ''), '{p}') AS INTEGER)" for p in guards.INJECTION.values()) + " AS hits FROM conversations")
def injection_flags(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(guards.injection_kinds(F.col("text"))).alias("hits"))


@query(r"SELECT doc_id AS id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)\btoken\b') THEN 'block' WHEN regexp_matches(coalesce(text, ''), '(?i)\bthe\b') THEN 'escalate' ELSE 'allow' END AS action FROM documents")
def scope_route(spark, d):
    rules = [guards.Rule("secret", ["token"]), guards.Rule("english", ["the"], action="escalate")]
    return _docs(spark, d).select("id", guards.scope(F.col("text"), rules)["action"].alias("action"))


# ---------------------------------------------------------------- evaluation

_GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_METRICS = f"""{_BM25}, {_ranked('scored', 10)}, {_GOLD}, wanted AS (SELECT query_id, count(DISTINCT id) AS wanted FROM gold GROUP BY query_id),
found AS (SELECT query_id, count(DISTINCT id) AS n, min("rank") AS best FROM r JOIN (SELECT DISTINCT * FROM gold) USING (query_id, id) GROUP BY query_id),
m AS (SELECT query_id, CAST(coalesce(n, 0) > 0 AS DOUBLE) AS hit, round(CAST(coalesce(n, 0) AS DOUBLE) / wanted, 6) AS recall, round(coalesce(CAST(1 AS DOUBLE) / best, 0), 6) AS mrr FROM wanted LEFT JOIN found USING (query_id)),
long AS (SELECT query_id, 'hit' AS metric, hit AS value FROM m UNION ALL SELECT query_id, 'recall', recall FROM m UNION ALL SELECT query_id, 'mrr', mrr FROM m)"""
_INTERVAL = """CASE WHEN n >= 2 THEN round(CASE WHEN b THEN greatest(0, (m + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(m * (1 - m) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) ELSE greatest(0, m - 1.96 * sqrt(v / n)) END, 6) END AS low,
CASE WHEN n >= 2 THEN round(CASE WHEN b THEN least(1, (m + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(m * (1 - m) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) ELSE least(1, m + 1.96 * sqrt(v / n)) END, 6) END AS high"""
_STATS = "count(*) AS n, avg(value) AS m, var_samp(value) AS v, bool_and(value IN (0, 1)) AS b"


def _gold(spark, d) -> DataFrame:
    """Documents that hold an item word for word."""
    found = synth.held_word_for_word(_t(spark, d, "benchmark").select("item_id", "text"), _docs(spark, d))
    return found.select(F.col("item_id").alias("query_id"), "id")


def _metrics(spark, d) -> DataFrame:
    return evaluation.retrieval_metrics(_search(spark, d, 10), _gold(spark, d), _asks(spark, d))


def _long(spark, d) -> DataFrame:
    return evaluation.melt(_metrics(spark, d), "hit", "recall", "mrr")


@query(f"WITH {_METRICS} SELECT * FROM m")
def retrieval_metrics(spark, d):
    return _metrics(spark, d)


@query(f"WITH {_METRICS}, x AS (SELECT metric, {_STATS} FROM long GROUP BY metric) SELECT metric, n, round(m, 6) AS mean, {_INTERVAL} FROM x")
def wilson_interval(spark, d):
    return evaluation.summarize(_long(spark, d))


@query(f"WITH {_METRICS}, y AS (SELECT *, CASE WHEN CAST('0x' || substr(sha256(CAST(query_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 50 THEN 'test' ELSE 'dev' END AS split FROM long), x AS (SELECT metric, coalesce(split, 'all') AS split, {_STATS} FROM y GROUP BY GROUPING SETS ((metric), (metric, split))) SELECT split, metric, n, round(m, 6) AS mean, {_INTERVAL} FROM x")
def metrics_by_split(spark, d):
    return evaluation.with_total(_long(spark, d).withColumn("split", synth.test_split(F.col("query_id"))), "split")


@query(f"WITH {_METRICS}, t AS (SELECT DISTINCT g.query_id, d.lang AS tag FROM gold g JOIN documents d ON d.doc_id = g.id) SELECT tag, metric, count(*) AS n, round(avg(value), 6) AS mean FROM long JOIN t USING (query_id) GROUP BY ALL")
def metrics_by_tag(spark, d):
    langs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    cases = _gold(spark, d).join(langs, "id").groupBy("query_id").agg(F.collect_set("lang").alias("tags"))
    return evaluation.by_tag(_long(spark, d), cases)


_OUT = """o AS (SELECT b.item_id AS query_id, m.hit, m.query_id IS NOT NULL AS answerable, b.item_id % 7 = 0 AS abstained, CASE WHEN b.item_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS correctness FROM benchmark b LEFT JOIN m ON m.query_id = b.item_id),
p AS (SELECT query_id, CASE WHEN NOT answerable AND NOT abstained THEN 'answered_unanswerable' WHEN NOT answerable THEN 'ok' WHEN abstained AND hit = 0 THEN 'retrieval_miss' WHEN abstained THEN 'wrong_abstention' WHEN correctness < 1 AND hit = 0 THEN 'retrieval_miss' WHEN correctness < 1 THEN 'wrong_with_right_context' ELSE 'ok' END AS outcome FROM o)"""


def _outcomes(spark, d):
    x = _asks(spark, d).select("query_id").join(_metrics(spark, d), "query_id", "left")
    q = F.col("query_id")
    why = evaluation.outcome(F.lit(None).cast("string"), F.col("hit").isNotNull(), q % 7 == 0, F.col("hit"), F.when(q % 3 == 0, 0.5).otherwise(1.0), F.lit(None).cast("double"))
    return x.select("query_id", why.alias("outcome"))


@query(f"WITH {_METRICS}, {_OUT} SELECT * FROM p")
def outcome_label(spark, d):
    return _outcomes(spark, d)


@query(f"WITH {_METRICS}, {_OUT} SELECT outcome, count(*) AS n, list_sort(list(query_id ORDER BY query_id)[1:3]) AS examples FROM p GROUP BY outcome")
def outcome_breakdown(spark, d):
    return evaluation.outcome_counts(_outcomes(spark, d))


@query(f"WITH {_METRICS}, x AS (SELECT metric, round(avg(value), 6) AS mean FROM long GROUP BY metric), t AS (SELECT * FROM (VALUES ('hit', 0.92::DOUBLE), ('mrr', 0.78::DOUBLE), ('error_rate', 0.1::DOUBLE)) v(metric, threshold)) SELECT t.metric, threshold, mean, coalesce(CASE WHEN t.metric = 'error_rate' THEN mean <= threshold ELSE mean >= threshold END, false) AS passed FROM t LEFT JOIN x USING (metric)")
def threshold_gate(spark, d):
    return evaluation.gate(evaluation.summarize(_long(spark, d)), {"hit": 0.92, "mrr": 0.78, "error_rate": 0.1})


_SHALLOW = """found3 AS (SELECT query_id, count(DISTINCT id) AS n, min("rank") AS best FROM r JOIN (SELECT DISTINCT * FROM gold) USING (query_id, id) WHERE "rank" <= 3 GROUP BY query_id),
m3 AS (SELECT query_id, CAST(coalesce(n, 0) > 0 AS DOUBLE) AS hit, round(CAST(coalesce(n, 0) AS DOUBLE) / wanted, 6) AS recall, round(coalesce(CAST(1 AS DOUBLE) / best, 0), 6) AS mrr FROM wanted LEFT JOIN found3 USING (query_id)),
long3 AS (SELECT query_id, 'hit' AS metric, hit AS value FROM m3 UNION ALL SELECT query_id, 'recall', recall FROM m3 UNION ALL SELECT query_id, 'mrr', mrr FROM m3)"""


def _shallow(spark, d) -> DataFrame:
    """The same metrics of a search that returns three."""
    return evaluation.melt(evaluation.retrieval_metrics(_search(spark, d, 3), _gold(spark, d), _asks(spark, d)), "hit", "recall", "mrr")


@query(f"WITH {_METRICS}, {_SHALLOW}, a AS (SELECT metric, round(avg(value), 6) AS now FROM long GROUP BY metric), b AS (SELECT metric, round(avg(value), 6) AS before FROM long3 GROUP BY metric) SELECT metric, before, now, round(now - before, 6) AS delta FROM a JOIN b USING (metric)")
def baseline_compare(spark, d):
    return evaluation.compare(evaluation.summarize(_long(spark, d)), evaluation.summarize(_shallow(spark, d)))


@query(f"WITH {_METRICS}, {_SHALLOW}, a AS (SELECT metric, round(avg(value), 6) AS ten FROM long GROUP BY metric), b AS (SELECT metric, round(avg(value), 6) AS three FROM long3 GROUP BY metric) SELECT metric, ten, three FROM a JOIN b USING (metric)")
def ablation_pivot(spark, d):
    return evaluation.ablation({"ten": evaluation.summarize(_long(spark, d)), "three": evaluation.summarize(_shallow(spark, d))})


# ---------------------------------------------------------------- synthetic questions, copies, quotes

_GRAMS = "list_distinct(list_transform(range(1, len({w}) - 4), lambda i: array_to_string(list_slice({w}, i, i + 5), ' ')))"


@query(f"""WITH a AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), b AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
ga AS (SELECT item_id, unnest({_GRAMS.format(w='w')}) AS g FROM a WHERE len(w) >= 6), gb AS (SELECT id, unnest({_GRAMS.format(w='w')}) AS g FROM b WHERE len(w) >= 6)
SELECT item_id, id, count(*) AS shared FROM ga JOIN gb USING (g) GROUP BY ALL""")
def ngram_copied(spark, d):
    return synth.copied_from(_t(spark, d, "benchmark").select("item_id", "text"), _docs(spark, d))


@query(f"WITH {_GOLD} SELECT query_id, id FROM gold")
def quote_verify(spark, d):
    return _gold(spark, d)


@query()
def quote_verify_folded(spark, d):
    items = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    docs = _docs(spark, d)
    near = synth.copied_from(items.withColumnRenamed("quote", "text"), docs).join(items, "item_id").join(docs, "id")
    return near.select("item_id", "id", tx.quote_in_text(F.col("quote"), F.col("text")).alias("verified"))


@query("""WITH c AS (SELECT doc_id AS id, source, text, trim(regexp_replace(text, '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS k FROM documents WHERE length(text) >= 200), o AS (SELECT min(id) AS id, arg_min(source, id) AS source FROM c GROUP BY k)
SELECT id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY substr(sha256('0' || chr(31) || CAST(id AS VARCHAR)), 1, 16), id) AS INTEGER) AS turn FROM o""")
def synth_candidates(spark, d):
    docs = _docs(spark, d, "source")
    return synth.candidates(docs).select("id", "source", "turn")


# ---------------------------------------------------------------- ingestion, history, prompts, costs

def _snapshots(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("rel"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    before = docs.where("rel % 5 != 0").withColumn("hash", F.when(F.col("rel") % 7 == 0, "old").otherwise(F.col("hash"))).union(docs.where("rel % 11 = 0").select((-F.col("rel") - 1).alias("rel"), "hash"))
    return docs, before


_DIFF = """f AS (SELECT doc_id AS rel, sha256(coalesce(text, '')) AS hash FROM documents), m AS (SELECT rel, CASE WHEN rel % 7 = 0 THEN 'old' ELSE hash END AS hash FROM f WHERE rel % 5 <> 0 UNION ALL SELECT -rel - 1, hash FROM f WHERE rel % 11 = 0),
s AS (SELECT rel, CASE WHEN m.hash IS NULL THEN 'new' WHEN f.hash IS NULL THEN 'removed' WHEN f.hash <> m.hash THEN 'changed' ELSE 'unchanged' END AS state FROM f FULL JOIN m USING (rel))"""


@query(f"WITH {_DIFF} SELECT * FROM s")
def ingest_diff(spark, d):
    return store.diff(*_snapshots(spark, d))


@query(f"""WITH {_DIFF} SELECT count(*) FILTER (state = 'new') AS "new", count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'removed') AS removed FROM s""")
def ingest_report(spark, d):
    return store.ingest_counts(store.diff(*_snapshots(spark, d)))


@query("SELECT doc_id AS id, 'new' AS lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def upsert_rows(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return store.merge(docs, docs.where("id % 3 = 0").withColumn("lang", F.lit("new")))


@query("SELECT doc_id AS id, lang FROM documents WHERE NOT (doc_id % 2 = 0 AND lang = 'en')")
def delete_rows(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return store.remove(docs, docs.where("id % 2 = 0"), {"lang": "en"})


@query("""WITH w AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT a.conv_id, a.turn, CAST(count(b.n) AS BIGINT) AS messages, CAST(coalesce(sum(length(b.text)), 0) AS BIGINT) AS chars FROM w a LEFT JOIN w b ON a.conv_id = b.conv_id AND b.n < a.n AND b.n >= a.n - 6 WHERE a.role = 'user' GROUP BY ALL""")
def history_window(spark, d):
    x = answering.with_history(_t(spark, d, "conversations"))
    return x.select("conv_id", "turn", F.size("history").cast("long").alias("messages"), F.aggregate("history", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])).alias("chars"))


@query(f"""WITH {_BM25}, {_ranked('scored', 3)} SELECT query_id, string_agg('[' || "rank" || '] ' || d.doc_id || chr(10) || d.text, chr(10) || chr(10) ORDER BY "rank") AS context FROM r JOIN documents d ON d.doc_id = r.id GROUP BY query_id""")
def context_assemble(spark, d):
    found = _search(spark, d, 3).join(_docs(spark, d), "id")
    part = F.concat(F.lit("["), "rank", F.lit("] "), F.col("id").cast("string"), F.lit("\n"), "text")
    gathered = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("s"))
    return gathered.select("query_id", F.array_join(F.transform("s", lambda x: x["p"]), "\n\n").alias("context"))


@query("""WITH c AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'free' END AS model, CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS i, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS o FROM conversations), g AS (SELECT model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM c GROUP BY model)
SELECT *, round(CASE model WHEN 'small' THEN (input_tokens * 0.25::DOUBLE + output_tokens * 1.0::DOUBLE) / 1e6 WHEN 'large' THEN (input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE) / 1e6 END, 6) AS cost_usd FROM g""")
def usage_cost(spark, d):
    n = F.length("text").cast("long")
    calls = _t(spark, d, "conversations").select(F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("free")), (F.col("conv_id") % 3 + 1).cast("int")).alias("model"), F.when(F.col("role") == "user", n).otherwise(0).alias("input_tokens"), F.when(F.col("role") == "assistant", n).otherwise(0).alias("output_tokens"))
    prices = spark.createDataFrame([("small", 0.25, 1.0), ("large", 3.0, 15.0)], "model string, price_in double, price_out double")
    return evaluation.usage_cost(calls, prices)


@query()
def answer_pipeline(spark, d):
    return answering.answer(_asks(spark, d), _docs(spark, d), index=_index(spark, d)).select("query_id", "answer", "abstained", "reason", "proposed", "verified", "sources")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk(spark, d)
