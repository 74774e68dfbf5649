"""Queries of the knowledge, retrieval and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import knowledge as kb
from ..operators import retrieval as rt
from .bindings import ASSETS, assets, query, read

RULES = [("ti", ["tion"]), ("ch", ["sch", "que"]), ("an", ["cion", "mente"])]


def _rules_sql(column: str, rules, default: str | None) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules) + (f" ELSE '{default}' END" if default else " END")


def docs(spark, d):
    """Documents of the knowledge base."""
    return read(spark, d, "documents").select(F.col("lang").alias("doc_type"), "source", (F.col("doc_id") % 7).cast("string").alias("title"), (F.col("doc_id") % 5).cast("string").alias("chapter"),
                                               F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("page_content"))


@query("SELECT item_id, string_agg(w, ' ' ORDER BY i) AS text, " + _rules_sql("string_agg(w, ' ' ORDER BY i)", vocab.CATEGORY_RULES, vocab.DEFAULT_CATEGORY) + """ AS category FROM (
  SELECT item_id, i, CASE item_id % 8 WHEN i THEN CASE i WHEN 1 THEN '반납' WHEN 2 THEN '불용' WHEN 3 THEN '매각' WHEN 4 THEN 'G2B' WHEN 5 THEN '현황' WHEN 6 THEN '예측' ELSE 'x' END ELSE 'w' END AS w FROM benchmark, range(1, 9) t(i)) GROUP BY item_id""")
def f32_category(spark, d):
    words = ["반납", "불용", "매각", "G2B", "현황", "예측", "x", "x"]
    parts = [F.when(F.col("item_id") % 8 == i, w).otherwise("w") for i, w in enumerate(words, 1)]
    text = F.concat_ws(" ", *parts)
    return read(spark, d, "benchmark").select("item_id", text.alias("text"), tx.category(text).alias("category"))


MARKED = "CASE doc_id % 7 WHEN 1 THEN '반납 ' WHEN 2 THEN '불용 ' WHEN 3 THEN '매각 ' WHEN 4 THEN 'G2B ' WHEN 5 THEN '현황 ' WHEN 6 THEN '예측 ' ELSE '' END || text"


@query(f"SELECT doc_id, {_rules_sql(MARKED, vocab.CATEGORY_RULES, vocab.DEFAULT_CATEGORY)} AS category FROM documents")
def f32_document_category(spark, d):
    mark = F.element_at(F.array(*[F.lit(w) for w in ("", "반납 ", "불용 ", "매각 ", "G2B ", "현황 ", "예측 ")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", tx.category(F.concat(mark, F.col("text"))).alias("category"))


@query("SELECT doc_id, CASE WHEN x = '' THEN 'doc' ELSE x END AS clean FROM (SELECT doc_id, trim(regexp_replace(trim(CASE WHEN doc_id % 50 = 0 THEN '?!' ELSE text END, ' '), '[^0-9a-zA-Z가-힣_.-]+', '_', 'g'), '_') AS x FROM documents)")
def f33_document_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.doc_id(F.when(F.col("doc_id") % 50 == 0, "?!").otherwise(F.col("text"))).alias("clean"))


@query("SELECT doc_id, lower(regexp_replace(text, '[^a-zA-Z0-9가-힣]', '', 'g')) AS plain FROM documents")
def f34_plain_text(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.plain(F.col("text")).alias("plain"))


QA = """qa AS (SELECT a.conv_id, a.turn, b.text AS question, a.text AS answer, CASE WHEN a.conv_id % 3 = 0 THEN '' ELSE 'c' || (a.conv_id % 4)::VARCHAR END AS category, 't' || (a.conv_id % 5)::VARCHAR AS title
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant' AND b.role = 'user')"""


def qa(spark, d):
    c = read(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    b = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return a.join(b, ["conv_id", "turn"]).withColumns({"category": F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string"))), "title": F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string"))})


@query(f"""WITH {QA}, c AS (SELECT *, coalesce(nullif(category, ''), '일반') AS topic FROM qa WHERE length(trim(question)) >= 1 AND length(trim(answer)) >= 1)
SELECT conv_id, turn, topic AS category, '문서 유형: QA 매칭 문서' || chr(10) || '문서 주제: ' || topic || chr(10) || '관련 메뉴: ' || title || chr(10) || '사용자 질문: ' || question || chr(10) || '상세 답변: ' || answer AS page_content FROM c""")
def f35_qa_documents(spark, d):
    return kb.qa_documents(qa(spark, d)).select("conv_id", "turn", "category", "page_content")


@query("""SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text WHEN contains(left(text, 2000), '.') AND length(left(text, 2000)) - strpos(reverse(left(text, 2000)), '.') > 1000 THEN left(text, length(left(text, 2000)) - strpos(reverse(left(text, 2000)), '.') + 1) ELSE left(text, 2000) END AS context FROM documents""")
def f38_cut_context(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.cut_context(F.col("text")).alias("context"))


@query()
def f36_f37_chunks(spark, d):
    """Chunks of all documents: no SQL form for the data-dependent steps; tests rebuild the texts."""
    return kb.chunk_documents(docs(spark, d).withColumn("pos", F.col("doc_id").cast("long")), "page_content").select("source", "pos", "chunk_index", "doc_id", "page_content")


ROUTED = "CASE conv_id % 4 WHEN 0 THEN '반 납 사유' WHEN 1 THEN '처분 일자' WHEN 2 THEN '보유 현황' ELSE '' END || text"


@query(f"SELECT conv_id, turn, " + _rules_sql(f"replace({ROUTED}, ' ', '')", vocab.MANUAL_ROUTES, None) + f""" AS manual, array_to_string(list_filter([{', '.join("CASE WHEN " + ' OR '.join(f"contains({ROUTED} || ' ' || text, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in vocab.BUTTONS)}], lambda x: x IS NOT NULL), ',') AS buttons FROM conversations""")
def f41_u5_routes_and_buttons(spark, d):
    question = F.concat(F.when(F.col("conv_id") % 4 == 0, "반 납 사유").when(F.col("conv_id") % 4 == 1, "처분 일자").when(F.col("conv_id") % 4 == 2, "보유 현황").otherwise(""), F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", tx.route(question).alias("manual"), F.array_join(tx.buttons(question, F.col("text")), ",").alias("buttons"))


LINKS = " UNION ALL ".join(f"SELECT conv_id, turn, '{vocab.BUTTON_LINKS[name][0]}' AS label, '{vocab.BUTTON_LINKS[name][1]}' AS url FROM conversations WHERE " + " OR ".join(f"contains({ROUTED}, '{w}')" for w in words) for name, words in vocab.BUTTONS)


@query(LINKS)
def f41_button_links(spark, d):
    question = F.when(F.col("conv_id") % 4 == 0, "반 납 사유").when(F.col("conv_id") % 4 == 1, "처분 일자").when(F.col("conv_id") % 4 == 2, "보유 현황").otherwise("")
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(tx.button_links(question, F.col("text"))).alias("x")).select("conv_id", "turn", "x.label", "x.url")


@query("SELECT event_id, '- k: ' || (props::JSON ->> '$.k') AS shown FROM events")
def f47_bullets(spark, d):
    return read(spark, d, "events").select("event_id", tx.json_bullets(F.col("props")).alias("shown"))


@query("""SELECT p_partkey, '문서 유형: 원문 매뉴얼' || chr(10) || chr(10) || '장/절: ' || p_brand || chr(10) || chr(10) || '제목: ' || p_name || chr(10) || chr(10) || '키워드: ' || p_type || ', ' || p_brand || chr(10) || chr(10) ||
  'summary:' || chr(10) || p_type || chr(10) || chr(10) || 'process_steps:' || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_name AS page_content FROM part""")
def f48_manual_texts(spark, d):
    item = F.to_json(F.struct(F.col("p_brand").alias("chapter"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("keywords"), F.col("p_type").alias("summary"), F.array("p_brand", "p_name").alias("process_steps"), F.lit("").alias("notes")))
    return read(spark, d, "part").select("p_partkey", F.parse_json(item).alias("item")).select("p_partkey", tx.manual_text(F.col("item")).alias("page_content"))


@query("""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(trim(replace('```' || text, '```', '')), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM conversations)
SELECT conv_id, turn, coalesce(left(lines[1], 500), 'original') AS refined FROM l""")
def f42_refined_queries(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.refined_query(F.concat(F.lit("```"), F.col("text")), F.lit("original")).alias("refined"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'NO_RAG' ELSE 'NEED_RAG' END AS decision FROM events""")
def f43_needs_search(spark, d):
    reply = F.when(F.col("event_type") == "click", "I think no_rag.").when(F.col("event_type") == "view", "NEED_RAG").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", tx.needs_search(reply).alias("decision"))


@query("""WITH t AS (SELECT conv_id, turn, left(regexp_replace(regexp_replace(trim('<b>' || text || '</b>', ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '<[^>]+>', '', 'g'), 500) AS own FROM conversations)
SELECT conv_id, turn, CASE WHEN own = '' THEN 'http://front/prediction' ELSE 'http://front/prediction?init_prompt=' || replace(replace(replace(url_encode(own), '%20', '+'), '%2A', '*'), '~', '%7E') END AS url FROM t""")
def f44_page_urls(spark, d):
    """Addresses that hold the question, in the encoding of forms."""
    return read(spark, d, "conversations").select("conv_id", "turn", tx.page_url("http://front/prediction", F.concat(F.lit("<b>"), F.col("text"), F.lit("</b>"))).alias("url"))


@query("""SELECT doc_id, '[REDACTED]' AS token, CASE WHEN length(replace(text, chr(10), '\\n')) > 100 THEN left(replace(text, chr(10), '\\n'), 100) || '...' ELSE replace(text, chr(10), '\\n') END AS q FROM documents""")
def f45_safe_arguments(spark, d):
    own = tx.safe_arguments(F.create_map(F.lit("Token"), F.lit("abc"), F.lit("q"), F.col("text")))
    return read(spark, d, "documents").select("doc_id", own.alias("m")).select("doc_id", F.col("m")["Token"].alias("token"), F.col("m")["q"].alias("q"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (props::JSON ->> '$.k') END AS k FROM events")
def f46_reply_json(spark, d):
    reply = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))).otherwise("none")
    return read(spark, d, "events").select("event_id", F.get_json_object(tx.reply_json(reply), "$.k").alias("k"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), lower('ThE'))")
def p14_search_messages(spark, d):
    return kb.search_messages(read(spark, d, "conversations").withColumnRenamed("text", "content"), "ThE").select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE length(trim(text, ' ')) >= 10")
def p15_content_rows(spark, d):
    return kb.with_answers(read(spark, d, "documents"), "text", least=10).select("doc_id")


@query(f"""WITH {QA} SELECT doc_type, count(*) AS n, count(DISTINCT source) AS n_sources FROM (
  SELECT lang AS doc_type, source FROM documents UNION ALL SELECT 'qa', 'chat' FROM qa) GROUP BY 1""")
def u1_union_documents(spark, d):
    chat = kb.qa_documents(qa(spark, d)).withColumns({"source": F.lit("chat"), "chapter": F.lit(""), "doc_id": F.concat_ws("_", F.lit("qa"), "conv_id", "turn")})
    return kb.union_documents(docs(spark, d), chat).groupBy("doc_type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


@query("SELECT item_id, 'faq_' || lpad((row_number() OVER (ORDER BY item_id) - 1)::VARCHAR, 4, '0') AS doc_id FROM benchmark")
def w11_numbered_ids(spark, d):
    return kb.numbered(read(spark, d, "benchmark").select("item_id"), "faq_", 4, "item_id")


FAQ = "faq AS (SELECT item_id AS pos, 'q' || item_id::VARCHAR AS question, 'a' || item_id::VARCHAR AS answer, list_transform(string_split(text, ' ')[1:2], lambda k: lower(regexp_replace(k, '[^a-zA-Z0-9가-힣]', '', 'g'))) AS own FROM benchmark)"


@query(f"""WITH {FAQ}, asked AS (SELECT doc_id AS id, lower(regexp_replace(CASE WHEN doc_id % 40 = 0 THEN 'FAQ ' ELSE '' END || text, '[^a-zA-Z0-9가-힣]', '', 'g')) AS q FROM documents)
SELECT id, string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) || chr(10) ORDER BY pos) AS faq, count(*) AS n_faq FROM asked JOIN faq
ON regexp_matches(q, 'faq|자주묻는|질문리스트|질문목록') OR len(list_filter(own, lambda k: k <> '' AND contains(q, k))) > 0 GROUP BY id""")
def j13_faq_matches(spark, d):
    faq = read(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question"), F.concat(F.lit("a"), F.col("item_id").cast("string")).alias("answer"), F.slice(F.split("text", " "), 1, 2).alias("keywords"))
    asked = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 40 == 0, "FAQ ").otherwise(""), F.col("text")).alias("text"))
    return kb.faq_matches(asked, faq)


@query("SELECT p_partkey, CASE WHEN r_name IS NULL THEN p_type ELSE 'type ' || r_name END AS name FROM part LEFT JOIN (SELECT DISTINCT lower(p_type) AS w, min(p_brand) AS r_name FROM part WHERE p_size < 25 AND p_type < 'M' GROUP BY 1) s ON lower(trim(p_type)) = w")
def j14_standard_names(spark, d):
    part = read(spark, d, "part")
    words = part.filter("p_size < 25 AND p_type < 'M'").groupBy(F.lower("p_type").alias("word")).agg(F.concat(F.lit("type "), F.min("p_brand")).alias("standard"))
    return kb.standard_names(part.select("p_partkey", "p_type"), words, "p_type", "name").select("p_partkey", "name")


@query("""WITH s AS (SELECT lower(c_mktsegment) AS w, 'std ' || lower(c_mktsegment) AS std FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment <> 'BUILDING'),
x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS id_val FROM customer),
y AS (SELECT x.*, w IS NOT NULL AS known FROM x LEFT JOIN s ON lower(trim(id_val)) = w),
z AS (SELECT c_custkey, CASE WHEN name IS NULL AND id_val IS NULL THEN 'no argument' END AS error, CASE WHEN known AND coalesce(name, '') = '' THEN id_val ELSE name END AS name, CASE WHEN NOT known THEN id_val END AS id_val FROM y)
SELECT c_custkey, error, coalesce(std, name) AS name, id_val FROM z LEFT JOIN s ON lower(trim(name)) = w""")
def j15_correct_arguments(spark, d):
    c = read(spark, d, "customer")
    words = c.select("c_mktsegment").distinct().filter("c_mktsegment <> 'BUILDING'").select(F.lower("c_mktsegment").alias("word"), F.concat(F.lit("std "), F.lower("c_mktsegment")).alias("standard"))
    df = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("id_val"), F.lit(None).cast("string").alias("id_num"))
    return kb.correct_arguments(df, words).select("c_custkey", "error", "name", "id_val")


@query(f"WITH {ASSETS} SELECT asset_id, item_name = '1-URGENT' OR item_name = '2-HIGH' AS is_predictable, CASE item_name WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 5 END::BIGINT AS lifespan FROM asset")
def j16_predictability(spark, d):
    known = spark.createDataFrame([("1-URGENT", "c1", 3), ("2-HIGH", "c2", 5)], "item_name string, code string, lifespan long")
    return kb.predictability(assets(spark, d), known).select("asset_id", "is_predictable", F.col("prediction.lifespan").alias("lifespan"))


@query("SELECT count(DISTINCT p_brand) AS n_items, count(*) AS n_rows FROM part")
def a33_item_summary(spark, d):
    return kb.item_summary(read(spark, d, "part"), "p_brand")


# --- retrieval ---

SIM = """unit AS (SELECT vec_id AS id, label::VARCHAR AS category, (label % 3)::VARCHAR AS source, (vec_id % 20)::VARCHAR AS chapter, (vec_id % 7)::VARCHAR AS title, embedding::DOUBLE[] AS e FROM embeddings),
sim AS (SELECT a.id AS q, b.id AS doc, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM unit a, unit b WHERE a.id % 100 = 0),
top AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank, doc, score FROM sim QUALIFY rank <= 25),
nn AS (SELECT a.id AS q, b.id AS doc, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS rank FROM unit a, unit b WHERE a.id <> b.id QUALIFY rank <= 25),
found AS (SELECT q, rank, doc, round(1 - score, 9) AS score, category, source, chapter, title, 'v' || doc::VARCHAR AS doc_id, CASE doc % 4 WHEN 0 THEN 'manual_chunk' WHEN 1 THEN 'faq' WHEN 2 THEN 'domain_guide' ELSE 'qa' END AS doc_type, 'text ' || doc::VARCHAR AS page_content FROM top JOIN unit ON doc = id)"""


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def labelled(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("category"), (F.col("label") % 3).cast("string").alias("source"), (F.col("vec_id") % 20).cast("string").alias("chapter"), (F.col("vec_id") % 7).cast("string").alias("title"))


def top(spark, d):
    v = vectors(spark, d)
    return rt.top_k(v.filter("id % 100 = 0"), v, 25)


def found(spark, d):
    """Context documents of the query vectors, with a distance as score (lower is better)."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("manual_chunk", "faq", "domain_guide", "qa")]), (F.col("doc") % 4 + 1).cast("int"))
    return (top(spark, d).join(labelled(spark, d), F.col("doc") == F.col("id")).drop("id")
            .withColumns({"score": F.round(1 - F.round("score", 9), 9), "doc_id": F.concat(F.lit("v"), F.col("doc").cast("string")), "doc_type": kind, "page_content": F.concat(F.lit("text "), F.col("doc").cast("string"))}))


def long_rank(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS size FROM embeddings")
def f22_unit_vectors(spark, d):
    u = rt.unit(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("size"))


@query(f"WITH {SIM} SELECT q, rank, doc, round(score, 6) AS score FROM top")
def t1_j20_top_k(spark, d):
    return long_rank(top(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {SIM} SELECT q, rank, doc FROM nn")
def t2_neighbours(spark, d):
    v = vectors(spark, d)
    return long_rank(rt.top_k(v, v, 25, skip_self=True)).select("q", "rank", "doc")


@query(f"""WITH {SIM}, other AS (SELECT q, doc, round(score * 0.9::DOUBLE, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY doc) AS rank FROM found),
b AS (SELECT q, doc, min(score) AS score FROM (SELECT q, doc, score FROM found UNION ALL SELECT q, doc, score FROM other WHERE rank <= 12) GROUP BY ALL)
SELECT q, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score, doc) AS rank FROM b QUALIFY rank <= 25""")
def t3_merge_results(spark, d):
    from pyspark.sql import Window
    f = found(spark, d)
    other = f.withColumns({"score": F.round(F.col("score") * 0.9, 9), "rank": F.row_number().over(Window.partitionBy("q").orderBy("doc"))})
    return long_rank(rt.merge_results(f, other, 25)).withColumn("score", F.round("score", 6))


@query(f"""WITH {SIM}, l AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, doc) AS r, score <= min(score) OVER (PARTITION BY q) + greatest(0.20::DOUBLE, abs(min(score) OVER (PARTITION BY q)) * 0.35::DOUBLE) AS ok FROM found)
SELECT q, doc, r AS rank FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY q) AS n FROM l) WHERE ok OR n < 2 AND r <= 2""")
def t4_filter_scores(spark, d):
    return long_rank(rt.filter_scores(found(spark, d))).select("q", "doc", "rank")


@query(f"WITH {SIM} SELECT q, doc, r AS rank FROM (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY (doc * 7919) % 101 DESC, rank, doc) AS r FROM found) WHERE r <= 15")
def t5_rerank(spark, d):
    return long_rank(rt.rerank(found(spark, d).withColumn("second", F.col("doc") * 7919 % 101), "second", 15)).select("q", "doc", "rank")


LEAD = "lead AS (SELECT q, arg_max(category, n * 1000 - at_) AS category, max(n) AS n FROM (SELECT q, category, count(*) AS n, min(rank) AS at_ FROM found WHERE rank <= 8 GROUP BY ALL) GROUP BY q HAVING max(n) >= 2)"


@query(f"WITH {SIM}, {LEAD} SELECT * FROM lead")
def a32_dominant_category(spark, d):
    return rt.dominant_category(found(spark, d))


@query(f"""WITH {SIM}, {LEAD}, x AS (SELECT f.q, f.doc, f.q % 300 = 0 AS compares, l.category AS lead, coalesce(f.category = l.category, false) AS own, count(*) OVER (PARTITION BY f.q) AS n FROM found f LEFT JOIN lead l USING (q)),
y AS (SELECT *, sum(own::INT) OVER (PARTITION BY q) AS k FROM x) SELECT q, doc FROM y WHERE n <= 2 OR compares OR lead IS NULL OR k < 2 OR own""")
def t6_focus(spark, d):
    f = found(spark, d)
    questions = f.select("q").distinct().withColumn("text", F.when(F.col("q") % 300 == 0, "반납 불용 차이").otherwise("반납"))
    return rt.focus(f, questions).select("q", "doc")


@query(f"WITH {SIM} SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY doc % 4, rank, doc) AS rank FROM found")
def t7_context_order(spark, d):
    return long_rank(rt.context_order(found(spark, d))).select("q", "doc", "rank")


DIVERSE = "two AS (SELECT *, row_number() OVER (PARTITION BY q, source, category ORDER BY rank, doc) AS k FROM found QUALIFY k <= 2), diverse AS (SELECT * EXCLUDE (k, rank), row_number() OVER (PARTITION BY q ORDER BY rank, doc) AS rank FROM two QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank, doc) <= 6)"


def diverse(spark, d):
    return rt.diverse(found(spark, d), 6, ("source", "category"))


@query(f"WITH {SIM}, {DIVERSE} SELECT q, doc, rank FROM diverse")
def w12_diverse(spark, d):
    return long_rank(diverse(spark, d)).select("q", "doc", "rank")


@query(f"""WITH {SIM}, {DIVERSE} SELECT q, string_agg('[문서 ' || rank::VARCHAR || ']' || chr(10) || 'doc_type=' || doc_type || chr(10) || 'doc_id=' || doc_id || chr(10) || 'source=' || source || chr(10) || 'chapter=' || chapter || chr(10) || 'category=' || category || chr(10) || 'title=' || title || chr(10) || page_content, chr(10) || chr(10) ORDER BY rank) AS context FROM diverse GROUP BY q""")
def f39_context_text(spark, d):
    return rt.context_text(diverse(spark, d))


@query(f"WITH {SIM} SELECT q, string_agg(rank::VARCHAR || ':' || source || '/' || chapter || '/' || category, ' | ' ORDER BY rank) AS preview FROM found GROUP BY q")
def f40_preview(spark, d):
    return rt.preview(found(spark, d))


@query(f"WITH {SIM}, {DIVERSE} SELECT q, string_agg(doc_id || ':' || doc_type, ',' ORDER BY rank) AS docs FROM diverse GROUP BY q")
def f50_attribution(spark, d):
    return rt.attribution(diverse(spark, d)).select("q", F.array_join(F.transform("docs", lambda x: F.concat(x["doc_id"], F.lit(":"), x["doc_type"])), ",").alias("docs"))


@query(f"""WITH {SIM}, {DIVERSE}, qs AS (SELECT DISTINCT q FROM sim), c AS (SELECT q, count(*) AS n FROM diverse WHERE q % 200 = 0 GROUP BY q)
SELECT q, coalesce(n, 0) AS n_docs, CASE WHEN n IS NULL THEN 'no document' END AS answer FROM qs LEFT JOIN c USING (q)""")
def f53_fixed_answers(spark, d):
    return kb.fixed_answers(vectors(spark, d).filter("id % 100 = 0").select(F.col("id").alias("q")), diverse(spark, d).filter("q % 200 = 0"), "no document")


@query(f"""WITH {SIM}, {DIVERSE}, fl AS (SELECT q, count(*) AS n FROM found WHERE score <= 0.5 GROUP BY q)
SELECT q, (SELECT count(*) FROM found f WHERE f.q = d.q) AS n_retrieved, coalesce(any_value(fl.n), 0) AS n_filtered, count(*) AS n_final, string_agg(category, '|' ORDER BY rank) AS categories FROM diverse d LEFT JOIN fl USING (q) GROUP BY q""")
def a34_funnel(spark, d):
    f = found(spark, d)
    return rt.funnel(f, f.filter("score <= 0.5"), rt.diverse(f, 6, ("source", "category"))).drop("doc_types", "scores")


@query(f"""WITH {SIM}, {DIVERSE}, s AS (SELECT q, string_agg(doc::VARCHAR || ':' || format('{{:.6f}}', score), '|' ORDER BY rank) AS scores FROM found WHERE rank <= 10 GROUP BY q)
SELECT q, string_agg(doc_type, '|' ORDER BY rank) AS doc_types, any_value(scores) AS scores FROM diverse JOIN s USING (q) GROUP BY q""")
def a34_diagnostics(spark, d):
    f = found(spark, d)
    return rt.funnel(f, f.filter("score <= 0.5"), rt.diverse(f, 6, ("source", "category"))).select("q", "doc_types", "scores")


HITS = "flags AS (SELECT nn.q, nn.rank, l.label, CASE l.label WHEN 'category' THEN a.category = b.category WHEN 'source' THEN a.source = b.source ELSE a.chapter = b.chapter END::INT AS same FROM nn JOIN unit a ON a.id = nn.q JOIN unit b ON b.id = nn.doc, (VALUES ('category'), ('chapter'), ('source')) l(label))"


@query(f"""WITH {SIM}, {HITS}, per AS (SELECT label, k, q, max(same) AS hit, avg(same) AS p FROM flags, (VALUES (1), (3), (5), (10), (25)) t(k) WHERE rank <= k GROUP BY ALL)
SELECT label, k::BIGINT AS k, round(avg(hit), 6) AS hit, round(avg(p), 6) AS precision FROM per GROUP BY ALL""")
def a24_hits(spark, d):
    v = vectors(spark, d)
    out = rt.hits(rt.top_k(v, v, 25, skip_self=True), labelled(spark, d), ("category", "chapter", "source"), (1, 3, 5, 10, 25))
    return out.select("label", F.col("k").cast("long").alias("k"), F.round("hit", 6).alias("hit"), F.round("precision", 6).alias("precision"))


@query(f"""WITH {SIM}, per AS (SELECT a.category, nn.q, max((a.category = b.category)::INT) AS hit, avg((a.category = b.category)::INT) AS p FROM nn JOIN unit a ON a.id = nn.q JOIN unit b ON b.id = nn.doc WHERE rank <= 5 GROUP BY ALL)
SELECT category, round(avg(hit), 6) AS hit, round(avg(p), 6) AS precision, (SELECT count(*) FROM unit u WHERE u.category = per.category) AS n_docs FROM per GROUP BY category""")
def a25_category_hits(spark, d):
    v = vectors(spark, d)
    return rt.category_hits(rt.top_k(v, v, 5, skip_self=True), labelled(spark, d)).withColumns({c: F.round(c, 6) for c in ("hit", "precision")})


@query("""WITH u AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id, a.label, b.label AS other, avg(1 - list_cosine_similarity(a.e, b.e)) AS m FROM u a JOIN u b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b FROM p GROUP BY id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM s""")
def a26_silhouette(spark, d):
    df = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("category"), "embedding")
    return rt.silhouette(df).withColumn("silhouette", F.round("silhouette", 6))


NEAREST = "near AS (SELECT a.id AS q, min(CASE WHEN a.category = b.category THEN round(1 - list_cosine_similarity(a.e, b.e), 9) END) AS same, min(CASE WHEN a.category <> b.category THEN round(1 - list_cosine_similarity(a.e, b.e), 9) END) AS other FROM unit a JOIN unit b ON a.id <> b.id GROUP BY a.id)"


def nearest(spark, d):
    df = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("category"), "embedding")
    return rt.nearest_by_category(df).withColumns({c: F.round(c, 9) for c in ("same", "other")})


@query(f"WITH {SIM}, {NEAREST} SELECT q, round(same, 6) AS same, round(other, 6) AS other FROM near")
def a27_nearest_distances(spark, d):
    return nearest(spark, d).withColumns({c: F.round(c, 6) for c in ("same", "other")})


@query(f"""WITH {SIM}, {NEAREST} SELECT b AS bin, (SELECT count(*) FROM near WHERE b = least(greatest(floor(same / (1.1::DOUBLE / 22)) + 1, 1), 22)) AS n,
  (SELECT count(*) FROM near WHERE b = least(greatest(floor(other / (1.1::DOUBLE / 22)) + 1, 1), 22)) AS n_other FROM range(1, 23) t(b)""")
def a27_distance_histogram(spark, d):
    near = nearest(spark, d)
    other = rt.distance_histogram(near, "other", 22, 0.0, 1.1).withColumnRenamed("n", "n_other")
    return rt.distance_histogram(near, "same", 22, 0.0, 1.1).join(other, "bin")


@query("SELECT lang AS category, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1")
def a28_composition(spark, d):
    return rt.composition(docs(spark, d))


JUDGE = """judge AS (SELECT doc_id, lang AS category, (1 + n_chars % 5)::INT AS faithfulness, (1 + n_chars % 4)::INT AS relevance, (1 + n_chars % 3)::INT AS alignment, toxic = 1 AS hallucination, quality = 1 AS source_hit, quality = 0 AS chapter_hit FROM documents JOIN labels USING (doc_id))"""


def judge(spark, d):
    df = read(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), "n_chars").join(read(spark, d, "labels"), "doc_id")
    return df.select("doc_id", "category", *[(F.lit(1) + F.col("n_chars") % m).cast("int").alias(c) for c, m in (("faithfulness", 5), ("relevance", 4), ("alignment", 3))],
                     (F.col("toxic") == 1).alias("hallucination"), (F.col("quality") == 1).alias("source_hit"), (F.col("quality") == 0).alias("chapter_hit"))


MEANS = "round(avg(faithfulness), 6) AS faithfulness, round(avg(relevance), 6) AS relevance, round(avg(alignment), 6) AS alignment, round(avg(hallucination::INT), 6) AS hallucination_rate, round(avg(source_hit::INT), 6) AS source_hit_rate, round(avg(chapter_hit::INT), 6) AS chapter_hit_rate, count(*) AS n"


def _means(df):
    return df.withColumns({c: F.round(c, 6) for c in ("faithfulness", "relevance", "alignment", "hallucination_rate", "source_hit_rate", "chapter_hit_rate")})


@query(f"WITH {JUDGE} SELECT {MEANS} FROM judge")
def a21_judge_summary(spark, d):
    return _means(rt.judge_summary(judge(spark, d)))


@query(f"WITH {JUDGE} SELECT category, {MEANS} FROM judge GROUP BY category")
def a22_judge_by_category(spark, d):
    return _means(rt.judge_summary(judge(spark, d), ("category",)))


@query(f"""WITH {JUDGE}, l AS (SELECT 'faithfulness' AS measure, faithfulness AS score FROM judge UNION ALL SELECT 'relevance', relevance FROM judge UNION ALL SELECT 'alignment', alignment FROM judge),
g AS (SELECT measure, s::INT AS score FROM (VALUES ('faithfulness'), ('relevance'), ('alignment')) m(measure), range(1, 6) t(s))
SELECT measure, g.score::BIGINT AS score, count(l.score) AS n FROM g LEFT JOIN l USING (measure, score) GROUP BY ALL""")
def a23_score_histogram(spark, d):
    return rt.score_histogram(judge(spark, d)).withColumn("score", F.col("score").cast("long"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1 ELSE greatest(1, least(5, round_even(value / 40, 0))) END::BIGINT AS score FROM events")
def f21_judge_score(spark, d):
    return read(spark, d, "events").select("event_id", tx.judge_score(F.when(F.col("event_id") % 7 == 0, "good").otherwise((F.col("value") / 40).cast("string"))).cast("long").alias("score"))


@query(f"""WITH {SIM}, r AS (SELECT q, list(source) AS ss, list(chapter) AS cs FROM diverse GROUP BY q), {DIVERSE}
SELECT r.q, list_contains(ss, u.source) AS source_hit, list_contains(cs, u.chapter) AS chapter_hit FROM r JOIN unit u ON u.id = r.q""".replace("r AS (SELECT q, list(source) AS ss, list(chapter) AS cs FROM diverse GROUP BY q), " + DIVERSE, DIVERSE + ", r AS (SELECT q, list(source) AS ss, list(chapter) AS cs FROM diverse GROUP BY q)"))
def f49_judge_rows(spark, d):
    got = rt.attribution(diverse(spark, d)).withColumnRenamed("docs", "retrieved")
    return rt.judge_rows(got.join(labelled(spark, d), F.col("q") == F.col("id"))).select("q", "source_hit", "chapter_hit")


@query()
def t10_seeded_sample(spark, d):
    """A sampling operator: twenty rows by a seeded hash. No SQL form: DuckDB has no such hash."""
    return rt.seeded_sample(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 20, 42)
