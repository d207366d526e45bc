"""Further queries over the driver's tables, beside those of catalog: scalars, parts of evaluation, page layout,
the retrieval pipeline. Importing this module adds them to catalog.QUERIES and catalog.ORACLES."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards, text as tx
from ..operators import answering, evaluation, filters, health, retrieval, search, store, synth
from ..sources import clean, layout
from ..tables import ensure, version_of
from .catalog import ORACLES, QUERIES, _BM25, _DENSE_TEXT, _FIG, _asks, _dense_text, _docs, _index, _long, _METRICS, _ranked, _search, _t, query

__all__ = ["ORACLES", "QUERIES"]

# ---------------------------------------------------------------- scalars


@query(r"""SELECT doc_id AS id, CASE WHEN s = '' THEN 'agent' ELSE s END AS slug, trim(regexp_replace(coalesce(source, '') || '  ' || coalesce(lang, ''), '\s+', ' ', 'g')) AS plain,
substr(sha256(coalesce(source, '') || chr(31) || CAST(doc_id AS VARCHAR)), 1, 16) AS hash, round(1 / (1 + exp(-greatest(-50, least(50, (n_chars - 1000) / 10.0)))), 6) AS squashed
FROM (SELECT *, regexp_replace(regexp_replace(lower(coalesce(source, '') || '/' || coalesce(lang, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)""")
def scalar_strings(spark, d):
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), tx.slugify(F.concat(source, F.lit("/"), lang)).alias("slug"), tx.normalize_ws(F.concat(source, F.lit("  "), lang)).alias("plain"),
        tx.stable_hash(source, F.col("doc_id").cast("string")).alias("hash"), F.round(tx.sigmoid((F.col("n_chars") - 1000) / F.lit(10.0)), 6).alias("squashed"),
    )


@query(r"""WITH c AS (SELECT conv_id, turn, text, 'Source ' || turn || ', p. ' || conv_id AS label, CASE turn % 3 WHEN 0 THEN 'Docs\HR\Leave.md' WHEN 1 THEN 'other/leave.MD' ELSE 'it.md' END AS path FROM conversations)
SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(label, '([0-9]+)', 1), '') AS INTEGER) AS number,
 (lower(replace(path, '\', '/')) = 'hr/leave.md' OR lower(replace(path, '\', '/')) LIKE '%/hr/leave.md' OR split_part(lower(replace(path, '\', '/')), '/', -1) = 'leave.md') AS matches,
 nullif(concat_ws(', ', nullif(CASE WHEN turn % 2 = 0 THEN 'Leave > Days' ELSE '' END, ''), CASE WHEN turn > 1 THEN 'p. ' || turn END), '') AS place,
 list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '([0-9][0-9,]*(?:\.[0-9]+)?)', 1), lambda x: replace(x, ',', ''))) = [] AS no_numbers
FROM c""")
def scalar_citations(spark, d):
    c = _t(spark, d, "conversations")
    path = F.element_at(F.array(F.lit("Docs\\HR\\Leave.md"), F.lit("other/leave.MD"), F.lit("it.md")), (F.col("turn") % 3 + 1).cast("int"))
    return c.select(
        "conv_id", "turn", tx.source_number(F.concat(F.lit("Source "), "turn", F.lit(", p. "), "conv_id")).alias("number"), tx.path_matches(path, F.lit("HR/leave.md")).alias("matches"),
        tx.location_label(F.when(F.col("turn") % 2 == 0, "Leave > Days").otherwise(""), F.when(F.col("turn") > 1, F.col("turn"))).alias("place"), (F.size(tx.numbers(F.col("text"))) == 0).alias("no_numbers"),
    )


@query(r"""SELECT item_id, CASE WHEN json_valid(regexp_extract(r, '(?s)(\{.*\})', 1)) AND regexp_extract(r, '(?s)(\{.*\})', 1) <> '' THEN regexp_extract(r, '(?s)(\{.*\})', 1) END AS body
FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Sure: {"answer": "' || item_id || '"} ok' WHEN 1 THEN 'no object' ELSE '{"broken": ' END AS r FROM benchmark)""")
def json_replies(spark, d):
    i = F.col("item_id")
    reply = F.when(i % 3 == 0, F.concat(F.lit('Sure: {"answer": "'), i, F.lit('"} ok'))).when(i % 3 == 1, "no object").otherwise('{"broken": ')
    return _t(spark, d, "benchmark").select("item_id", tx.json_object(reply).alias("body"))


@query(r"""WITH n AS (SELECT doc_id, lang || '/Report ' || coalesce(source, 'x') || CASE doc_id % 4 WHEN 0 THEN ' v' || doc_id WHEN 1 THEN ' final' WHEN 2 THEN ' (2)' ELSE ' 2021' END || '.pdf' AS rel FROM documents WHERE lang IS NOT NULL),
k AS (SELECT DISTINCT rel, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part(rel, '/', -1)), '\.[a-z0-9]{1,5}$', ''), '[^a-z0-9]+', ' ', 'g'), '\b(v\d+|rev\d*|version|final|draft|copy|latest|new|old|(19|20)\d\d|\d{1,2})\b', ' ', 'g'), '\s+', ' ', 'g')) AS family FROM n)
SELECT family, count(*) AS n, list_sort(list(rel)) AS names FROM k WHERE family <> '' GROUP BY family HAVING count(*) > 1""")
def version_families(spark, d):
    i = F.col("doc_id")
    end = F.when(i % 4 == 0, F.concat(F.lit(" v"), i)).when(i % 4 == 1, " final").when(i % 4 == 2, " (2)").otherwise(" 2021")
    rel = F.concat("lang", F.lit("/Report "), F.coalesce("source", F.lit("x")), end, F.lit(".pdf"))
    return health.families(_t(spark, d, "documents").where("lang is not null").select(rel.alias("rel")).distinct())


@query(r"""WITH l AS (SELECT doc_id AS id, list_transform(string_split(text, chr(10)), lambda x: [x, trim(x, ' ')]) AS ls FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, list_transform(ls, lambda p: CASE
 WHEN NOT (length(p[2]) > 0 AND length(p[2]) <= 90 AND NOT regexp_matches(p[2], '[.:,]$') AND NOT regexp_matches(p[2], '^[#|>-]')) THEN p[1]
 WHEN regexp_matches(p[2], '^[0-9]+(?:\.[0-9]+)*\.?\s+\pL') THEN repeat('#', least(6, length(regexp_extract(p[2], '^([0-9]+(?:\.[0-9]+)*)', 1)) - length(replace(regexp_extract(p[2], '^([0-9]+(?:\.[0-9]+)*)', 1), '.', '')) + 2)) || ' ' || p[2]
 WHEN regexp_matches(p[2], '(?i)^(section|article|chapter|part)\s+[0-9ivxlc]+\b') THEN '## ' || p[2]
 WHEN regexp_matches(p[2], '^[^\p{Ll}]*\p{Lu}{2,}[^\p{Ll}]*\s+[^\p{Ll}]*\p{Lu}{2,}[^\p{Ll}]*$') THEN '## ' || p[2]
 ELSE p[1] END) AS out FROM l) SELECT id, array_to_string(out, chr(10)) AS text FROM c""")
def heading_marks(spark, d):
    return _docs(spark, d).where("text is not null").select("id", clean.promote_headings(F.col("text")).alias("text"))


_PAGED = """p AS (SELECT conv_id AS id, turn AS page, count(*) OVER (PARTITION BY conv_id) AS pages, 'Conversation ' || conv_id || chr(10) || 'Page ' || turn || ' of 9' || chr(10) || replace(coalesce(text, ''), chr(12), ' ') AS t FROM conversations),
l AS (SELECT id, page, pages, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM p),
s AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS s FROM l),
k AS (SELECT *, CASE WHEN length(s) BETWEEN 4 AND 120 THEN CASE WHEN len(regexp_extract_all(s, '[0-9]')) * 5 >= len(regexp_extract_all(s, '[\\p{L}\\p{N}]')) THEN regexp_replace(s, '[0-9]+', '#', 'g') ELSE s END END AS key FROM s),
g AS (SELECT id, key FROM k WHERE key IS NOT NULL AND pages >= 4 GROUP BY id, key, pages HAVING count(DISTINCT page) >= greatest(3, pages // 2))"""


@query(f"""WITH {_PAGED}, r AS (SELECT k.id, k.page, k.n, k.line FROM k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = k.id AND g.key = k.key)),
q AS (SELECT id, page, string_agg(line, chr(10) ORDER BY n) AS t FROM r GROUP BY id, page) SELECT id, string_agg(t, chr(12) ORDER BY page) AS text FROM q GROUP BY id""")
def running_heads(spark, d):
    c = _t(spark, d, "conversations")
    page = F.concat(F.lit("Conversation "), "conv_id", F.lit("\nPage "), "turn", F.lit(" of 9\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(chr(12)), F.lit(" ")))
    pages = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]), chr(12)).alias("text"))
    return clean.strip_repeated_lines(pages)


# ---------------------------------------------------------------- health and personal data


@query(_FIG.join(["WITH ", r""", h AS (SELECT f.id, CAST(len(regexp_extract_all(t, '(?m)^\|[ :|-]*-[ :|-]*\|$')) AS BIGINT) AS tables, round(len(regexp_extract_all(t, chr(65533))) / greatest(visible, 1), 6) AS bad_ratio FROM f),
ln AS (SELECT id, line, count(*) AS n FROM (SELECT id, trim(line, ' ') AS line FROM (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)) WHERE line <> '' GROUP BY ALL),
sh AS (SELECT id, round(CAST(sum(CASE WHEN n >= 3 AND length(line) >= 12 THEN length(line) * n ELSE 0 END) AS DOUBLE) / sum(length(line) * n), 6) AS share FROM ln GROUP BY id),
x AS (SELECT g.*, h.tables, h.bad_ratio, coalesce(sh.share, 0) AS share FROM g JOIN h USING (id) LEFT JOIN sh USING (id))
SELECT id, tables, bad_ratio, list_sort(list_filter([
 CASE WHEN chars = 0 THEN 'empty' END, CASE WHEN chars > 0 AND pages = 1 AND chars < 300 AND tables = 0 THEN 'short' END, CASE WHEN pages > 1 AND chars / pages < 150 THEN 'sparse_pages' END,
 CASE WHEN chars > 4000 AND headings = 0 AND tables = 0 THEN 'no_headings' END, CASE WHEN visible >= 200 AND bad_ratio > 0.002 THEN 'undecodable' END, CASE WHEN visible >= 200 AND letter_ratio < 0.55 THEN 'few_letters' END,
 CASE WHEN visible >= 200 AND single_ratio > 0.15 THEN 'single_letters' END, CASE WHEN visible >= 200 AND (word_length < 2.5 OR word_length > 12) THEN 'odd_words' END, CASE WHEN visible >= 200 AND share > 0.1 THEN 'repeated_lines' END],
 lambda f: f IS NOT NULL)) AS flags FROM x"""]))
def health_flags(spark, d):
    return health.health(_docs(spark, d)).select("id", "tables", "bad_ratio", "flags")


_RE = {k: v.replace("'", "''") for k, v in guards.PII.items()}
_LUHN = "list_sum(list_transform(range(length(c)), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(c[length(c) - i] AS INTEGER) > 9 THEN 2 * CAST(c[length(c) - i] AS INTEGER) - 9 ELSE 2 * CAST(c[length(c) - i] AS INTEGER) END ELSE CAST(c[length(c) - i] AS INTEGER) END)) % 10 = 0"


@query(f"""WITH t AS (SELECT doc_id AS id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' 4111 1111 1111 1111' WHEN 1 THEN ' 4111-1111-1111-1112' WHEN 2 THEN ' 123-45-6789' WHEN 3 THEN ' 000-45-6789' ELSE '' END AS text FROM documents),
cards AS (SELECT id, unnest(list_transform(regexp_extract_all(text, '{_RE["card"]}'), lambda x: regexp_replace(x, '[ -]', '', 'g'))) AS c FROM t),
good AS (SELECT DISTINCT id FROM cards WHERE {_LUHN})
SELECT t.id, list_sort(list_filter([CASE WHEN good.id IS NOT NULL THEN 'card' END, CASE WHEN regexp_matches(text, '{_RE["ssn"]}') THEN 'ssn' END, CASE WHEN regexp_matches(text, '{_RE["email"]}') THEN 'email' END, CASE WHEN regexp_matches(text, '{_RE["phone"]}') THEN 'phone' END, CASE WHEN regexp_matches(text, '{_RE["ip"]}') THEN 'ip' END], lambda x: x IS NOT NULL)) AS kinds FROM t LEFT JOIN good ON good.id = t.id""")
def pii_all_kinds(spark, d):
    i = F.col("id")
    more = F.when(i % 5 == 0, " 4111 1111 1111 1111").when(i % 5 == 1, " 4111-1111-1111-1112").when(i % 5 == 2, " 123-45-6789").when(i % 5 == 3, " 000-45-6789").otherwise("")
    return _docs(spark, d).select("id", guards.pii_kinds(F.concat(F.coalesce("text", F.lit("")), more), ("card", "ssn", "email", "phone", "ip")).alias("kinds"))


@query("SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{k}' END" for k, p in guards.INJECTION.items()) + "], lambda x: x IS NOT NULL) AS kinds FROM conversations")
def injection_names(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", guards.injection_kinds(F.col("text")).alias("kinds"))


# ---------------------------------------------------------------- retrieval

_PIPE = f"""{_BM25}, {_DENSE_TEXT}, ok AS (SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'de')),
sf AS (SELECT s.* FROM scored s JOIN ok USING (id)), df2 AS (SELECT s.* FROM dense s JOIN ok USING (id)), {_ranked('sf', 20, 's')}, {_ranked('df2', 20, 'd')},
u AS (SELECT query_id, id, "rank", 0 AS l, 1.4::DOUBLE / (60 + "rank") AS x FROM d UNION ALL SELECT query_id, id, "rank", 1, (2 * (1 - 0.7::DOUBLE)) / (60 + "rank") FROM s),
f AS (SELECT query_id, id, round(sum(x), 9) AS score, min(l * 1000 + "rank") AS first FROM u GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS n FROM f) WHERE n <= 10),
w AS (SELECT pool.query_id, pool.id, list_distinct(regexp_extract_all(lower(coalesce(x.text, '')), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS b FROM pool JOIN documents x ON x.doc_id = pool.id JOIN benchmark b ON b.item_id = pool.query_id),
r2 AS (SELECT query_id, id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS score FROM w)"""


@query(f"""WITH {_PIPE}, {_ranked('r2', 5, 'best')} SELECT * FROM best""")
def retrieval_pipeline(spark, d):
    """Access, both searches, fusion, reranking and the limit as one plan."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    vectors = ensure(spark, "documents-vectors", version_of(_t(spark, d, "documents")), lambda: search.hashed_vectors(_docs(spark, d)))
    score = F.round(synth.jaccard(tx.word_set(F.col("query")), tx.word_set(F.col("text"))), 6)
    options = retrieval.Retrieval(mode="hybrid", dense_weight=0.7, k=5, digits=4)
    rules = filters.AccessRules(roles="lang")
    return retrieval.retrieve(_asks(spark, d), docs, options, access=rules, caller=filters.Caller(roles=("en", "de")), scorer=score, index=_index(spark, d), vectors=vectors)


@query(f"""WITH toks AS (SELECT doc_id AS id, {tx.keyword_tokens_sql('text')} AS t FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
v AS (SELECT item_id AS query_id, 0 AS variant, text FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) >= 6), ' ') FROM benchmark),
q AS (SELECT DISTINCT query_id, variant, unnest({tx.keyword_tokens_sql('text')}) AS term FROM v),
sc AS (SELECT q.query_id, q.variant, tf.id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * len(toks.t) / st.mean))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN toks ON toks.id = tf.id, st GROUP BY ALL),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS "rank" FROM sc) WHERE "rank" <= 20),
f AS (SELECT query_id, id, round(sum(1::DOUBLE / (60 + "rank")), 9) AS score, min(variant * 1000 + "rank") AS first FROM rk GROUP BY ALL),
o AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS "rank", score FROM f) SELECT * FROM o WHERE "rank" <= 10""")
def multi_query_fuse(spark, d):
    """Each question and its longer words as a second wording, fused."""
    long = F.array_join(F.filter(tx.word_set(F.col("text")), lambda w: F.length(w) >= 6), " ")
    variants = _asks(spark, d).select("query_id", F.posexplode(F.array("text", long)).alias("variant", "text"))
    return answering.search_variants(variants, _docs(spark, d), index=_index(spark, d))


@query(f"""WITH {_BM25}, {_DENSE_TEXT}, {_ranked('scored', 5, 's')}, {_ranked('dense', 5, 'd')}
SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.id, d.id) AS id, d.score AS dense, s.score AS sparse FROM s FULL JOIN d USING (query_id, id)""")
def result_signals(spark, d):
    a, b = _dense_text(spark, d, 5), _search(spark, d, 5)
    out = retrieval.with_signals({"dense": a, "sparse": b}, search.rrf([a, b], 10))
    return out.select("query_id", "id", F.col("signals")["dense"].alias("dense"), F.col("signals")["sparse"].alias("sparse"))


# ---------------------------------------------------------------- evaluation

_PLACES = f"""{_BM25}, {_ranked('scored', 10)}, res AS (SELECT r.query_id, r.id, r."rank", 'Corpus/' || coalesce(d.source, 'none') || '/' || coalesce(d.lang, 'xx') || '.md' AS source, coalesce(d.lang, '') AS section FROM r JOIN documents d ON d.doc_id = r.id),
gold AS (SELECT item_id AS query_id, 0 AS gold_no, 'src' || (item_id % 8) || '\\EN.md' AS source, NULL AS section FROM benchmark UNION ALL SELECT item_id, 1, 'de.md', CASE WHEN item_id % 2 = 0 THEN 'De' ELSE 'fr' END FROM benchmark),
lk AS (SELECT DISTINCT res.query_id, gold_no, id, "rank" FROM res JOIN gold USING (query_id) WHERE (lower(res.source) = replace(lower(gold.source), '\\', '/') OR lower(res.source) LIKE '%/' || replace(lower(gold.source), '\\', '/') OR split_part(lower(res.source), '/', -1) = split_part(replace(lower(gold.source), '\\', '/'), '/', -1)) AND (gold.section IS NULL OR contains(lower(res.section), lower(gold.section)))),
mp AS (SELECT w.query_id, CAST(coalesce(n, 0) > 0 AS DOUBLE) AS hit, round(CAST(coalesce(n, 0) AS DOUBLE) / wanted, 6) AS recall, round(coalesce(CAST(1 AS DOUBLE) / best, 0), 6) AS mrr FROM (SELECT query_id, count(DISTINCT gold_no) AS wanted FROM gold GROUP BY query_id) w LEFT JOIN (SELECT query_id, count(DISTINCT gold_no) AS n, min("rank") AS best FROM lk GROUP BY query_id) f USING (query_id))"""


def _places(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Corpus/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit(".md")).alias("source"), F.coalesce("lang", F.lit("")).alias("section"), "text")
    found = _search(spark, d, 10).join(docs, "id")
    i = F.col("item_id")
    ref = lambda n, source, section: F.struct(F.lit(n).alias("gold_no"), source.alias("source"), section.cast("string").alias("section"), F.lit(None).cast("string").alias("quote"))
    gold = _t(spark, d, "benchmark").select(i.alias("query_id"), F.explode(F.array(ref(0, F.concat(F.lit("src"), i % 8, F.lit("\\EN.md")), F.lit(None)), ref(1, F.lit("de.md"), F.when(i % 2 == 0, "De").otherwise("fr")))).alias("g")).select("query_id", "g.*")
    return found, gold, evaluation.gold_links(found, gold)


@query(f"WITH {_PLACES} SELECT * FROM mp")
def metrics_by_place(spark, d):
    _, gold, links = _places(spark, d)
    return evaluation.metrics_by_place(links, gold)


_ANSWERED = """an AS (SELECT item_id AS query_id, item_id % 7 = 0 AS abstained, item_id % 5 AS proposed, least(item_id % 5, item_id % 3) AS verified, item_id % 6 <> 5 AS answerable FROM benchmark)"""


def _answered(spark, d):
    """Answers and cases by rule, as no model is at hand: what is measured on them is the operators' arithmetic."""
    i = F.col("query_id")
    x = _asks(spark, d).select("query_id")
    cite = lambda n: F.struct(n.cast("int").alias("source"), F.lit("q").alias("quote"), F.lit(True).alias("verified"))
    answers = x.select("query_id", (i % 7 == 0).alias("abstained"), (i % 5).alias("proposed"), F.least(i % 5, i % 3).alias("verified"), F.array(cite(i % 4 + 1), cite(i % 3 + 1)).alias("citations"))
    return answers, x.select("query_id", (i % 6 != 5).alias("answerable"), F.lit(True).alias("has_gold"))


@query(f"""WITH {_PLACES}, {_ANSWERED}, ct AS (SELECT query_id, unnest([query_id % 4 + 1, query_id % 3 + 1]) AS "rank" FROM an WHERE NOT abstained),
sh AS (SELECT ct.query_id, round(avg(CASE WHEN res.id IS NOT NULL AND EXISTS (SELECT 1 FROM lk WHERE lk.query_id = ct.query_id AND lk.id = res.id) THEN 1 ELSE 0 END), 6) AS share FROM ct LEFT JOIN res ON res.query_id = ct.query_id AND res."rank" = ct."rank" GROUP BY ct.query_id)
SELECT an.query_id, CASE WHEN proposed > 0 THEN round(CAST(verified AS DOUBLE) / proposed, 6) END AS citation_valid_rate, CASE WHEN answerable THEN share END AS citation_source_match FROM an LEFT JOIN sh USING (query_id)""")
def citation_metrics(spark, d):
    found, _, links = _places(spark, d)
    answers, cases = _answered(spark, d)
    return evaluation.citation_metrics(answers, found, links, cases)


@query(f"WITH {_ANSWERED} SELECT query_id, CAST(abstained <> answerable AS DOUBLE) AS abstain_correct, CASE WHEN answerable THEN CAST(abstained AS DOUBLE) END AS answerable_abstain_rate, CASE WHEN NOT answerable THEN CAST(abstained AS DOUBLE) END AS unanswerable_abstain_rate FROM an")
def abstention_metrics(spark, d):
    return evaluation.abstention_metrics(*_answered(spark, d))


@query("SELECT item_id AS query_id FROM benchmark ORDER BY substr(sha256('3' || chr(31) || CAST(item_id AS VARCHAR)), 1, 16), item_id LIMIT 7")
def judged_cases(spark, d):
    return evaluation.judge_sample(_asks(spark, d), 7, 3).select("query_id")


@query(f"WITH {_METRICS} SELECT query_id, round(avg(value), 6) AS mean FROM long GROUP BY query_id ORDER BY 2, 1 LIMIT 5")
def worst_cases(spark, d):
    return evaluation.worst(_long(spark, d), 5)


@query(f"""WITH {_BM25}, {_ranked('scored', 10, 'r10')}, {_ranked('scored', 1, 'r1')}, gold AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
v AS (SELECT g.query_id, max(CASE WHEN r10.id IS NULL THEN 0 ELSE 1 END) AS ten, max(CASE WHEN r1.id IS NULL THEN 0 ELSE 1 END) AS one FROM gold g LEFT JOIN r10 USING (query_id, id) LEFT JOIN r1 USING (query_id, id) GROUP BY g.query_id)
SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS tag, round(avg(one), 6) AS one, round(avg(ten), 6) AS ten FROM v GROUP BY ALL""")
def ablation_tags(spark, d):
    """Two depths of search as variants, by tag."""
    from .catalog import _gold

    gold, asks = _gold(spark, d), _asks(spark, d)
    make = lambda k: (lambda: evaluation.melt(evaluation.retrieval_metrics(_search(spark, d, k), gold, asks), "hit", "recall", "mrr"))
    values, _ = evaluation.ablate({"one": make(1), "ten": make(10)})
    cases = asks.select("query_id", F.array(F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")).alias("tags"))
    return evaluation.ablation_by_tag(values, cases, "hit", ["one", "ten"])


@query("""WITH c AS (SELECT item_id, item_id % 6 <> 5 AS answerable, CASE WHEN item_id % 4 = 0 THEN NULL ELSE text END AS a, item_id % 5 AS g, CASE WHEN item_id % 2 = 0 THEN 'test' ELSE 'dev' END AS split FROM benchmark)
SELECT count(*) AS cases, count(*) FILTER (answerable AND coalesce(a, '') = '') AS without_answer, count(*) FILTER (answerable AND g < 1) AS without_sources, count(*) FILTER (NOT answerable) = 0 AS no_unanswerable, count(*) FILTER (split = 'test') = 0 AS no_test_split FROM c""")
def dataset_gaps(spark, d):
    i = F.col("item_id")
    cases = _t(spark, d, "benchmark").select((i % 6 != 5).alias("answerable"), F.when(i % 4 != 0, F.col("text")).alias("gold_answer"), F.array_repeat(F.lit("s"), (i % 5).cast("int")).alias("gold_sources"), F.when(i % 2 == 0, "test").otherwise("dev").alias("split"))
    return evaluation.dataset_warnings(cases)


@query("SELECT item_id AS query_id, text AS question FROM benchmark WHERE NOT (item_id % 3 = 0 AND item_id % 2 = 0)")
def resume_remaining(spark, d):
    cases = _asks(spark, d).withColumnRenamed("text", "question")
    done = cases.where("query_id % 3 = 0").withColumn("error", F.when(F.col("query_id") % 2 == 1, "Boom").cast("string"))
    return evaluation.remaining(cases, done)


# ---------------------------------------------------------------- question sets and store

_DR = """dr AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'What does the passage above say?' WHEN 1 THEN left(text, 60) WHEN 2 THEN 'How many?' ELSE '' END AS q, CASE doc_id % 5 WHEN 0 THEN '123456789 days' ELSE 'some' END AS a FROM documents WHERE length(text) >= 200),
wd AS (SELECT *, regexp_extract_all(lower(q), '[a-z0-9]+') AS wq, regexp_extract_all(lower(text), '[a-z0-9]+') AS wt FROM dr),
g AS (SELECT *, CASE WHEN len(wq) >= 6 THEN list_transform(range(1, len(wq) - 4), lambda i: array_to_string(list_slice(wq, i, i + 5), ' ')) ELSE [] END AS gq, CASE WHEN len(wt) >= 6 THEN list_transform(range(1, len(wt) - 4), lambda i: array_to_string(list_slice(wt, i, i + 5), ' ')) ELSE [] END AS gt FROM wd),
nr AS (SELECT doc_id, CASE WHEN trim(q) = '' THEN 'no_draft' WHEN q = 'What does the passage above say?' THEN 'refers_to_passage' WHEN list_has_any(gq, gt) THEN 'copies_wording' WHEN doc_id % 5 = 0 AND NOT list_contains(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')), '123456789') THEN 'unsupported_number' ELSE 'kept' END AS reason FROM g)"""


@query(f"WITH {_DR} SELECT reason, count(*) AS n FROM nr GROUP BY reason")
def draft_reasons(spark, d):
    """What checks drop of drafts made by rule from each passage, by reason."""
    i = F.col("id")
    docs = _docs(spark, d).where(F.length("text") >= 200)
    rows = docs.select("id", "text", F.when(i % 4 == 0, "What does the passage above say?").when(i % 4 == 1, F.substring("text", 1, 60)).when(i % 4 == 2, "How many?").otherwise("").alias("q"), F.when(i % 5 == 0, "123456789 days").otherwise("some").alias("a"))
    rows = rows.withColumns({"wq": synth._words(F.col("q")), "wt": synth._words(F.col("text"))})
    reason = F.when(F.trim("q") == "", "no_draft").when(synth.refers_to_passage(F.col("q")), "refers_to_passage").when(synth.copies_wording(F.col("wq"), F.col("wt")), "copies_wording").when(~synth.numbers_supported(F.col("a"), F.col("text")), "unsupported_number").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT source, lang AS h, min(doc_id) AS first_at FROM documents WHERE source IS NOT NULL AND trim(coalesce(lang, '')) <> '' GROUP BY ALL), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_at, h) AS n FROM h) WHERE n <= 2),
s AS (SELECT source, string_agg(h, '; ' ORDER BY n) AS said FROM f GROUP BY source) SELECT DISTINCT d.source, '- ' || d.source || coalesce(': ' || said, '') AS line FROM documents d LEFT JOIN s USING (source) WHERE d.source IS NOT NULL""")
def source_outline(spark, d):
    chunks = _t(spark, d, "documents").where("source is not null").select("source", F.col("doc_id").alias("ordinal"), F.col("lang").alias("heading_path"))
    return synth.outline(chunks, 2)


@query("""WITH w AS (SELECT conv_id * 100 + turn AS id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))), ' ') AS k FROM conversations)
SELECT id, min(id) OVER (PARTITION BY k) AS class FROM w WHERE k <> ''""")
def question_classes(spark, d):
    x = _t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return synth.question_classes(x).select("id", "class")


@query("""WITH s AS (SELECT min(id) AS id, w FROM (SELECT item_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM benchmark UNION ALL SELECT 1000000 + doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) FROM documents) GROUP BY w),
p AS (SELECT a.id AS a, b.id AS b, round(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM s a JOIN s b ON a.id < b.id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(a.w) >= 0.75 * len(b.w) AND len(b.w) >= 0.75 * len(a.w)) SELECT * FROM p WHERE similarity >= 0.75""")
def near_dup_jaccard(spark, d):
    docs = _docs(spark, d).select((F.col("id") + 1000000).alias("id"), "text")
    return synth.similar_questions(_t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").union(docs), 0.75)


@query("SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (5, 3, 40)")
def fetch_by_ids(spark, d):
    return store.fetch(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang"), ["40", "no such", "3", "5"]).select(F.col("id").cast("long").alias("id"), "lang")


# ---------------------------------------------------------------- page layout

_LN = """ln AS (SELECT l_orderkey AS doc_id, 0 AS page, CAST(l_linenumber * 10 AS DOUBLE) AS top, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_partkey % 400 + 20 + l_suppkey % 7 * 40 AS DOUBLE) AS x1, l_linestatus || ' ' || l_returnflag AS text, CAST(10 + l_quantity % 4 AS DOUBLE) AS size, l_returnflag = 'R' AS bold, 600.0::DOUBLE AS width FROM lineitem)"""


def _page_lines(spark, d):
    dbl = lambda c: c.cast("double")
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), dbl(F.col("l_linenumber") * 10).alias("top"), dbl(F.col("l_partkey") % 400).alias("x0"), dbl(F.col("l_partkey") % 400 + 20 + F.col("l_suppkey") % 7 * 40).alias("x1"),
        F.concat("l_linestatus", F.lit(" "), "l_returnflag").alias("text"), dbl(10 + F.col("l_quantity") % 4).alias("size"), (F.col("l_returnflag") == "R").alias("bold"), F.lit(600.0).alias("width"),
    )


@query(f"""WITH {_LN}, sd AS (SELECT *, CASE WHEN x1 <= 318 THEN 1 WHEN x0 >= 282 THEN 2 ELSE 0 END AS side FROM ln),
tw AS (SELECT *, count(*) OVER p >= 6 AND count(*) FILTER (side = 1) OVER p >= 3 AND count(*) FILTER (side = 2) OVER p >= 3 AND count(*) FILTER (side = 0) OVER p <= count(*) OVER p * 0.5 AS two FROM sd WINDOW p AS (PARTITION BY doc_id)),
bl AS (SELECT *, CASE WHEN two THEN sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY top, x0) ELSE 0 END AS block, CASE WHEN two THEN side ELSE 0 END AS col FROM tw)
SELECT doc_id, top, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, col, top, x0) AS INTEGER) AS place FROM bl""")
def layout_order(spark, d):
    return layout.in_reading_order(_page_lines(spark, d)).select("doc_id", "top", "place")


@query(f"""WITH {_LN}, c AS (SELECT doc_id, round(size * 2) / 2 AS s, count(*) AS n FROM ln WHERE size > 0 GROUP BY ALL), b AS (SELECT doc_id, s AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS k FROM c) WHERE k = 1)
SELECT ln.doc_id, top, body, length(trim(text)) <= 90 AND NOT regexp_matches(trim(text), '[.:,]$') AND len(regexp_split_to_array(trim(text), '\\s+')) >= 2 AND body > 0 AND (size >= body * 1.15::DOUBLE OR (bold AND size >= body * 0.95::DOUBLE)) AS heading FROM ln JOIN b USING (doc_id)""")
def layout_headings(spark, d):
    x = _page_lines(spark, d)
    x = x.join(layout.body_sizes(x), ["doc_id", "page"])
    return x.select("doc_id", "top", "body", layout.is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body")).alias("heading"))


@query(r"""WITH p AS (SELECT conv_id AS doc_id, turn AS page, coalesce(text, '') AS raw, replace(coalesce(text, ''), ' a', ' ') AS rendered FROM conversations),
a AS (SELECT doc_id, page, w, count(*) AS n FROM (SELECT doc_id, page, unnest(regexp_extract_all(raw, '[^\s|]+')) AS w FROM p) GROUP BY ALL), b AS (SELECT doc_id, page, w, count(*) AS m FROM (SELECT doc_id, page, unnest(regexp_extract_all(rendered, '[^\s|]+')) AS w FROM p) GROUP BY ALL)
SELECT doc_id, page, round(CAST(sum(greatest(0, n - coalesce(m, 0))) AS DOUBLE) / sum(n), 6) AS share FROM a LEFT JOIN b USING (doc_id, page, w) GROUP BY doc_id, page""")
def layout_lost_words(spark, d):
    t = F.coalesce("text", F.lit(""))
    pages = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), t.alias("raw"), F.replace(t, F.lit(" a"), F.lit(" ")).alias("rendered"))
    return layout.lost_words(pages).withColumn("share", F.round("share", 6))
