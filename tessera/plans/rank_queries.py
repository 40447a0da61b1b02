"""Queries on ranking, clicks, metrics, A/B tests, trees, vectors, learned models and event streams."""

from __future__ import annotations

from pyspark.ml import classification, evaluation, feature, regression, tuning
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import abtest, boost, metrics, network, rank
from tessera.sources import files
from tessera.streaming import admission
from tessera.tables import materialize, spread, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _docs(spark, d, *cols):
    return spread(table(spark, d, "documents").select("doc_id", *cols), "doc_id")


_SHOWN = "select query_id, doc_id, cast(max(case when list_contains(coalesce(clicked, []), doc_id) then 1 else 0 end) as bigint) clicked from (select query_id, clicked, unnest(serp) doc_id from clicks) group by 1, 2"


@query("click_model", _SHOWN)
def click_model(spark, d):
    return rank.shown(table(spark, d, "clicks"))


@query("click_rates", "select query_id, doc_id, count(*) n_shown, cast(sum(case when list_contains(coalesce(clicked, []), doc_id) then 1 else 0 end) as bigint) n_clicked from (select query_id, clicked, unnest(serp) doc_id from clicks) group by 1, 2")
def click_rates(spark, d):
    return rank.click_rates(table(spark, d, "clicks"))


@query("serp_join", f"select query_id, doc_id, title, cast(coalesce(length(text), 0) as bigint) n_chars from ({_SHOWN}) join documents using (doc_id)")
def serp_join(spark, d):
    """Titles and lengths of the documents shown for each query."""
    return rank.shown(table(spark, d, "clicks")).join(_docs(spark, d, "title", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars")), "doc_id").select("query_id", "doc_id", "title", "n_chars")


@query("serp_missing", f"select query_id, doc_id from ({_SHOWN}) where doc_id not in (select doc_id from documents)")
def serp_missing(spark, d):
    return rank.shown(table(spark, d, "clicks")).join(_docs(spark, d), "doc_id", "left_anti").select("query_id", "doc_id")


@query("recommend_triples", f"select query_id, doc_id, clicked || ' ' || query_id || ' ' || doc_id line from ({_SHOWN})")
def recommend_triples(spark, d):
    return files.triples(rank.shown(table(spark, d, "clicks")))


_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_TFIDF = f"""
    tc as (select doc_id, term, count(*) tf from (select doc_id, unnest({_W.format('text')}) term from documents) group by 1, 2),
    idf as (select term, log2((select count(*) from documents) / count(*)) idf from tc group by 1),
    raw as (select doc_id, term, tf * idf r from tc join idf using (term) where tf * idf > 0),
    dw as (select doc_id, term, r / sqrt(sum(r * r) over (partition by doc_id)) weight from raw)"""
_QUERY_WEIGHTS = f"""
    qc as (select query_id, term, count(*) tf from (select query_id, unnest({_W.format('query')}) term from queries) group by 1, 2),
    qraw as (select query_id, term, tf * idf r from qc join idf using (term) where tf * idf > 0),
    qw as (select query_id, term, r / sqrt(sum(r * r) over (partition by query_id)) weight from qraw)"""


def _weights(spark, d):
    docs = _docs(spark, d, "text")
    counts = materialize(rank.term_counts(docs, "doc_id", "text"), "counts")
    idf = rank.idf(counts, docs.count())
    return counts, idf


@query("tfidf", f"with {_TFIDF} select doc_id, term, round(weight, 6) weight from dw")
def tfidf(spark, d):
    counts, idf = _weights(spark, d)
    return rank.tfidf(counts, idf, "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _similar(spark, d):
    counts, idf = _weights(spark, d)
    asked = rank.term_counts(table(spark, d, "queries"), "query_id", "query")
    return rank.cosine(rank.tfidf(asked, idf, "query_id"), rank.tfidf(counts, idf, "doc_id", asked.select("term").distinct()), rank.shown(table(spark, d, "clicks")))


@query("tfidf_cosine", f"with {_TFIDF}, {_QUERY_WEIGHTS}, c as ({_SHOWN}) select query_id, doc_id, round(sum(qw.weight * dw.weight), 6) sim from c join qw using (query_id) join dw using (doc_id, term) group by 1, 2")
def tfidf_cosine(spark, d):
    return _similar(spark, d).select("query_id", "doc_id", F.round("sim", 6).alias("sim"))


def _sims_sql() -> str:
    """CTEs up to ``s``: query_id, doc_id and the four cosines of words (1) and word pairs (2) with text and title."""
    grams = {1: "{0}", 2: "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"}
    ctes = [f"c as ({_SHOWN})", f"d0 as (select doc_id, {_W.format("coalesce(text, '')")} w_text, {_W.format("coalesce(title, '')")} w_title, {_W.format("concat_ws(' ', title, text)")} w from documents)", f"q0 as (select query_id, {_W.format("coalesce(query, '')")} w from queries)"]
    for n, gram in grams.items():
        ctes.append(f"i{n} as (select term, log2((select count(*) from documents) / count(*)) idf from (select distinct doc_id, unnest({gram.format('w')}) term from d0) group by 1)")
        for name, source, key, w in ((f"q{n}", "q0", "query_id", "w"), (f"text{n}", "d0", "doc_id", "w_text"), (f"title{n}", "d0", "doc_id", "w_title")):
            ctes.append(f"{name}t as (select {key}, term, count(*) tf from (select {key}, unnest({gram.format(w)}) term from {source}) group by 1, 2)")
            ctes.append(f"{name} as (select {key}, term, r / sqrt(sum(r * r) over (partition by {key})) weight from (select {key}, term, tf * idf r from {name}t join i{n} using (term) where tf * idf > 0))")
        for part in rank.PARTS:
            ctes.append(f"s_{part}{n} as (select query_id, doc_id, sum(a.weight * b.weight) sim from c join q{n} a using (query_id) join {part}{n} b using (doc_id, term) group by 1, 2)")
    columns = ", ".join(f"coalesce(s_{part}{n}.sim, 0) {label}_{part}" for n, label in ((1, "tfidf"), (2, "tfidf2")) for part in rank.PARTS)
    joins = " ".join(f"left join s_{part}{n} using (query_id, doc_id)" for n in grams for part in rank.PARTS)
    ctes.append(f"s as (select query_id, doc_id, {columns} from c join (select doc_id from documents) using (doc_id) {joins})")
    ctes.append("l as (select doc_id, len(w) n from d0), a as (select avg(n) a from l)")
    return "with " + ", ".join(ctes)


_SIMS = _sims_sql()
_FOUR = ", ".join(f"round({c}, 6) {c}" for c in rank.VECTOR[:4])


def _similarities(spark, d, pairs=None, queries=None):
    docs = _docs(spark, d, "text", "title")
    pairs = rank.shown(table(spark, d, "clicks")) if pairs is None else pairs
    return rank.similarities(pairs, table(spark, d, "queries") if queries is None else queries, docs, docs.count(), materialize)


def _lengths(spark, d):
    """Words of title and text of each document, and their mean."""
    lengths = _docs(spark, d, "text", "title").select("doc_id", F.size(text.tokens(F.concat_ws(" ", "title", "text"))).alias("n"))
    return lengths, lengths.agg(F.avg("n")).scalar()


@query("tfidf_similarities", f"{_SIMS} select query_id, doc_id, {_FOUR} from s")
def tfidf_similarities(spark, d):
    """Similarities of words and word pairs with text and title."""
    return _similarities(spark, d).select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in rank.VECTOR[:4]])


@query("similarity_order", f"{_SIMS} select query_id, doc_id, round(tfidf_text, 6) sim, cast(row_number() over (partition by query_id order by round(tfidf_text, 6) desc, doc_id) as int) place from s")
def similarity_order(spark, d):
    """All shown documents of each query in the order of their similarity."""
    sims = _similarities(spark, d).select("query_id", "doc_id", F.round("tfidf_text", 6).alias("sim"))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "doc_id")  # a query's shown documents, each once
    return sims.withColumn("place", F.row_number().over(w))


_TOP5 = "p as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) place from r) select query_id, doc_id, score, cast(place as int) place from p where place <= 5"


@query("tfidf_rank_top5", f"{_SIMS}, r as (select query_id, doc_id, round(tfidf_text + 15 * tfidf_title, 6) score from s), {_TOP5}")
def tfidf_rank_top5(spark, d):
    sims = _similarities(spark, d)
    return rank.top_k(sims.select("query_id", "doc_id", F.round(rank.tfidf_rank(sims), 6).alias("score")))


_FIRST = f"""{_SIMS}, m as (select query_id, doc_id, tfidf_text + 5 * tfidf_title + tfidf2_text + 5 * tfidf2_title sim from s),
    r as (select query_id, doc_id, round(sim / coalesce(nullif(max(sim) over (partition by query_id), 0), 1) + 0.7 * (1 - abs(0.2 * a - n) / a), 6) score from m join l using (doc_id), a), {_TOP5}"""


def _first_rank(spark, d, pairs=None, queries=None):
    sims = materialize(_similarities(spark, d, pairs, queries), "sims")
    scored = rank.first_rank(sims, *_lengths(spark, d))
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("first_rank_top5", _FIRST)
def first_rank_top5(spark, d):
    return rank.top_k(_first_rank(spark, d))


@query("keyword_idf", f"with {_TFIDF}, qc as (select distinct query_id, unnest({_W.format('query')}) term from queries) select query_id, arg_min(term, (-round(idf, 9), term)) keyword from qc join idf using (term) group by 1")
def keyword_idf(spark, d):
    _, idf = _weights(spark, d)
    asked = rank.term_counts(table(spark, d, "queries"), "query_id", "query")
    return rank.keyword(asked, idf.withColumn("idf", F.round("idf", 9)))


_KEYS = f"""kt as (select doc_id, unnest({_W.format('text')}) term from documents), ki as (select term, log2((select count(*) from documents) / count(distinct doc_id)) idf from kt group by 1),
    kq as (select distinct query_id, unnest({_W.format('query')}) term from queries), k as (select query_id, arg_min(term, (-round(idf, 9), term)) keyword from kq join ki using (term) group by 1)"""
_PLACES = "select distinct unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+')) term from (select n_name as name from nation union all select r_name from region)"


def _feature_sql(c: str) -> str:
    w = f"w_{c}"
    return f"""cast(len({w}) as bigint) len_{c},
        coalesce(list_min(list_filter(list_transform(q, lambda x: cast(list_position({w}, x) as bigint)), lambda p: p > 0)) - 1, {rank.NOWHERE}) first_pos_{c},
        case when array_to_string(q, ' ') <> '' and contains(array_to_string({w}, ' '), array_to_string(q, ' ')) then 1 else 0 end phrase_{c},
        round(case when len(q) > 0 then len(list_filter(q, lambda x: list_contains({w}, x))) / len(q) else 0.0 end, 6) part_{c},
        case when len(q) > 0 and len(list_filter(q, lambda x: list_contains({w}, x))) = len(q) then 1 else 0 end all_{c},
        case when list_has_any({w}, list_intersect(q, (select list(term) from ({_PLACES})))) then 1 else 0 end geo_{c},
        case when keyword is not null and list_contains({w}, keyword) then 1.0 else 0.0 end part_key_{c},
        case when keyword is not null and list_contains({w}, keyword) then 1 else 0 end all_key_{c},
        case when qy <> '' and list_contains({w}, qy) then 1 else 0 end year_{c}"""


_PAIRS = f"""z as (select query_id, doc_id, keyword, {_W.format("coalesce(query, '')")} q, regexp_extract(coalesce(query, ''), '{rank.YEAR}', 1) qy, {_W.format("coalesce(text, '')")} w_text, {_W.format("coalesce(title, '')")} w_title from ({_SHOWN}) c join queries using (query_id) join documents using (doc_id) left join k using (query_id))"""
_SIMPLE = [f"{n}_{c}" for c in rank.PARTS for n in ("len", "first_pos", "phrase", "part", "all", "geo", "part_key", "all_key", "year")]


def _places(spark, d):
    """The gazetteer: words of the names of nations and regions."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("name")))
    return names.select(F.explode(text.tokens("name")).alias("term")).distinct()


def _keywords(spark, d):
    _, idf = _weights(spark, d)
    return rank.keyword(rank.term_counts(table(spark, d, "queries"), "query_id", "query"), idf.withColumn("idf", F.round("idf", 9)))


def _text_features(spark, d):
    return rank.text_features(rank.shown(table(spark, d, "clicks")), table(spark, d, "queries"), _docs(spark, d, "text", "title"), _places(spark, d), materialize(_keywords(spark, d), "keywords"))


@query("text_features", f"with {_KEYS}, {_PAIRS} select query_id, doc_id, {_feature_sql('text')}, {_feature_sql('title')} from z")
def text_features(spark, d):
    return _text_features(spark, d).select("query_id", "doc_id", *_SIMPLE)


def _distance_sql(c: str) -> str:
    return f"""h_{c} as (select query_id, doc_id, unnest(w_{c}) w, unnest(range(0, len(w_{c}))) i, q from z), k_{c} as (select query_id, doc_id, w, i from h_{c} where list_contains(q, w)),
    m_{c} as (select query_id, doc_id, min(i - j) v from (select query_id, doc_id, w, i, lag(w) over o u, lag(i) over o j from k_{c} window o as (partition by query_id, doc_id order by i)) where u <> w group by 1, 2)"""


_DISTANCES = f"{_distance_sql('text')}, {_distance_sql('title')}"


@query("feat_min_dist", f"with {_KEYS}, {_PAIRS}, {_DISTANCES} select z.query_id, z.doc_id, coalesce(m_text.v, {rank.NOWHERE}) min_dist_text, coalesce(m_title.v, {rank.NOWHERE}) min_dist_title from z left join m_text using (query_id, doc_id) left join m_title using (query_id, doc_id)")
def feat_min_dist(spark, d):
    return _text_features(spark, d).select("query_id", "doc_id", "min_dist_text", "min_dist_title")


def _vector(spark, d):
    """All 24 features of each shown pair."""
    sims = materialize(_similarities(spark, d), "sims")
    return materialize(_text_features(spark, d).join(sims, ["query_id", "doc_id"]).select("query_id", "doc_id", *rank.VECTOR), "vector")


_ALL = f"""{_SIMS}, {_KEYS}, {_PAIRS}, {_DISTANCES}, g as (select query_id, doc_id, {_feature_sql('text')}, {_feature_sql('title')} from z),
    f as (select g.*, s.* exclude (query_id, doc_id), coalesce(m_text.v, {rank.NOWHERE}) min_dist_text, coalesce(m_title.v, {rank.NOWHERE}) min_dist_title
        from g join s using (query_id, doc_id) left join m_text using (query_id, doc_id) left join m_title using (query_id, doc_id))"""
_SCALE_SQL = ", ".join(f"round(case when max({c}) over w = min({c}) over w then 0.0 else ({c} - min({c}) over w) / (max({c}) over w - min({c}) over w) end, 6) {c}" for c in rank.VECTOR)
_SCALED = f"{_ALL}, v as (select query_id, doc_id, {_SCALE_SQL} from f window w as (partition by query_id))"


@query("feature_vector", f"{_ALL} select query_id, doc_id, {', '.join(f'round({c}, 5) {c}' for c in rank.VECTOR)} from f")
def feature_vector(spark, d):
    """The 24 features of each pair."""
    return _vector(spark, d).select("query_id", "doc_id", *[F.round(c, 5).alias(c) for c in rank.VECTOR])


@query("minmax_features", f"{_SCALED} select query_id, doc_id, {', '.join(rank.VECTOR)} from v")
def minmax_features(spark, d):
    return rank.min_max(_vector(spark, d), "query_id", rank.VECTOR)


def _linear(spark, d, rows):
    scaled = rank.min_max(rows, "query_id", rank.VECTOR)
    lengths, average = _lengths(spark, d)
    return scaled.select("query_id", "doc_id", rank.linear_rank().alias("linear")).join(lengths, "doc_id"), average


_LINEAR_SQL = " + ".join(f"{k} * {f'(1 - {c})' if c in rank.INVERTED else c}" for c, k in rank.COEFFICIENTS.items() if k)


@query("rank_linear", f"{_SCALED}, r as (select query_id, doc_id, round(({_LINEAR_SQL} + 2.0 * (1 - abs(0.2 * a - n) / a)) / 52, 4) score from v join l using (doc_id), a), {_TOP5}")
def rank_linear(spark, d):
    """Five best documents of each query by the linear rank of all scaled features and the length prior, without the boosted term."""
    linear, average = _linear(spark, d, _vector(spark, d))
    return rank.top_k(linear.select("query_id", "doc_id", F.round(rank.final_rank(F.col("linear"), F.lit(0.0), F.col("n"), average), 4).alias("score")))


def _final(spark, d, rounds: int = 20):
    """The whole final rank; the boosted term is fitted on the clicks of the pairs."""
    rows = _vector(spark, d)
    first = array_to_vector(F.array(*[F.col(c).cast("double") for c in rank.VECTOR[: rank.BOOSTED]])).alias("x")
    labelled = rows.select("query_id", "doc_id", first).join(rank.shown(table(spark, d, "clicks")).select("query_id", "doc_id", F.col("clicked").cast("double").alias("y")), ["query_id", "doc_id"])
    model = regression.GBTRegressor(featuresCol="x", labelCol="y", predictionCol="boosted", maxIter=rounds, maxDepth=2, seed=1).fit(labelled)
    linear, average = _linear(spark, d, rows)
    boosted = model.transform(labelled).select("query_id", "doc_id", "boosted")
    return linear.join(boosted, ["query_id", "doc_id"]).select("query_id", "doc_id", F.round(rank.final_rank(F.col("linear"), F.col("boosted"), F.col("n"), average), 6).alias("score"))


@query("rank_final")
def rank_final(spark, d):
    """Five best documents of each query by the final rank: linear part, boosted regression on the first 14 features, length prior."""
    return rank.top_k(_final(spark, d))


_P5 = lambda name, score: f"{name} as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) place from ({score}))"


@query("rank_diff", f"{_SCALED}, m0 as (select query_id, doc_id, tfidf_text + 5 * tfidf_title + tfidf2_text + 5 * tfidf2_title sim from s), {_P5('a1', 'select query_id, doc_id, round(sim / coalesce(nullif(max(sim) over (partition by query_id), 0), 1) + 0.7 * (1 - abs(0.2 * a - n) / a), 6) score from m0 join l using (doc_id), a')}, {_P5('a2', 'select query_id, doc_id, round(tfidf_text + 15 * tfidf_title, 6) score from s')} select count(distinct query_id) n_queries from (select * from a1 where place <= 5) x full join (select * from a2 where place <= 5) y using (query_id, place) where x.doc_id is distinct from y.doc_id")
def rank_diff(spark, d):
    """Queries whose first ranking and ranking by words alone differ in the top five."""
    sims = _similarities(spark, d)
    words = sims.select("query_id", "doc_id", F.round(rank.tfidf_rank(sims), 6).alias("score"))
    return rank.rank_difference(rank.top_k(_first_rank(spark, d)), rank.top_k(words))


#: Size of the word vectors and passes over the text.
VECTOR_SIZE, PASSES = 120, 7
_models: dict = {}


def _word_vectors(spark, d):
    """Word2Vec model and ``vec_id, term, embedding`` of its vocabulary; ids are hashes of the terms. Trained once a session and folder."""
    known = (spark.sparkContext.applicationId, d)
    if known not in _models:
        sentences = _docs(spark, d, "text").filter("text is not null").select(F.explode(F.transform(F.split("text", r"[.!?…\n]+"), lambda s: text.tokens(s))).alias("w")).filter("size(w) > 2")
        model = feature.Word2Vec(vectorSize=VECTOR_SIZE, windowSize=5, minCount=5, maxIter=PASSES, seed=1, numPartitions=spark.sparkContext.defaultParallelism, inputCol="w", outputCol="v").fit(sentences)
        vectors = model.getVectors().select(text.md5_hash(F.col("word")).alias("vec_id"), F.col("word").alias("term"), vector_to_array("vector").alias("embedding"))
        _models[known] = model, materialize(vectors, "vectors")
    return _models[known]


def _synonyms(spark, d, asked=None):
    """Four nearest words of every hundredth word, or of all words of the queries ``asked``."""
    _, terms = _word_vectors(spark, d)
    if asked is None:
        chosen = terms.filter("vec_id % 100 = 0")
    else:
        chosen = terms.join(asked.select(F.explode(text.tokens("query")).alias("term")).distinct(), "term", "left_semi")
    return rank.nearest(terms, chosen, 4).join(terms.select("vec_id", F.col("term").alias("synonym")), "vec_id").join(terms.select(F.col("vec_id").alias("query_vec"), "term"), "query_vec").select("term", "synonym", F.col("cosine").alias("sim"))


@query("word_synonyms")
def word_synonyms(spark, d):
    """Four nearest words of every hundredth word by Word2Vec."""
    return _synonyms(spark, d)


def _variants(spark, d):
    asked = table(spark, d, "queries")
    return rank.query_variants(asked, _synonyms(spark, d, asked))


@query("query_variants")
def query_variants(spark, d):
    """Queries rewritten with synonyms."""
    return _variants(spark, d)


@query("query_expanded")
def query_expanded(spark, d):
    """Queries with the nearest word of each word appended where it is very similar; stop words get none."""
    asked = table(spark, d, "queries")
    stop = tuple(w for words in text.STOP_WORDS.values() for w in words.split())
    return rank.expand_queries(asked, _synonyms(spark, d, asked), stop=stop)


@query("variant_merge")
def variant_merge(spark, d):
    """First ranks of the queries as asked, merged with those of their rewritten forms, weighted by the words replaced."""
    asked = table(spark, d, "queries")
    scored = rank.variant_scores(rank.shown(table(spark, d, "clicks")), asked, _synonyms(spark, d, asked), _docs(spark, d, "text", "title"), materialize)
    return scored.select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("doc_vectors_rank")
def doc_vectors_rank(spark, d):
    """Five best documents of each query by the cosine of mean word vectors."""
    model, _ = _word_vectors(spark, d)
    lift = lambda df, key, col: model.transform(df.select(key, text.tokens(F.coalesce(col, F.lit(""))).alias("w"))).select(key, vector_to_array("v").alias("v"))
    q, x = lift(table(spark, d, "queries"), "query_id", "query"), lift(_docs(spark, d, "text"), "doc_id", "text")
    rows = rank.shown(table(spark, d, "clicks")).join(q.withColumnRenamed("v", "a"), "query_id").join(x.withColumnRenamed("v", "b"), "doc_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rank.top_k(rows.select("query_id", "doc_id", F.round(dot("a", "b") / F.greatest(F.sqrt(dot("a", "a") * dot("b", "b")), F.lit(1e-12)), 6).alias("score")))


@query(
    "libsvm_clicks",
    f"""with c as ({_SHOWN}), qc as (select query_id, term, count(*) tf from (select query_id, unnest({_W.format('query')}) term from queries) group by 1, 2),
    dc as (select doc_id, term, count(*) tf from (select doc_id, unnest({_W.format('text')}) term from documents) group by 1, 2),
    v as (select term, row_number() over (order by term) idx from (select distinct term from qc)),
    qp as (select query_id, string_agg(idx || ':' || tf, ' ' order by idx) part from qc join v using (term) group by 1),
    dp as (select doc_id, string_agg((idx + (select count(*) from v)) || ':' || tf, ' ' order by idx) part from dc join v using (term) group by 1)
    select query_id, doc_id, concat_ws(' ', cast(clicked as varchar), qp.part, dp.part) line from c left join qp using (query_id) left join dp using (doc_id)""",
)
def libsvm_clicks(spark, d):
    """Click dataset in the sparse text form: query terms, then document terms, with term numbers by frequency."""
    shown = rank.shown(table(spark, d, "clicks"))
    asked = rank.term_counts(table(spark, d, "queries"), "query_id", "query")
    docs = rank.term_counts(_docs(spark, d, "text"), "doc_id", "text")
    from tessera.operators.prefix import row_numbers

    numbered = row_numbers(asked.select("term").distinct().withColumn("all", F.lit(1)), ["all"], [F.col("term")], "vocabulary").select("term", F.col("row").alias("idx"))
    return files.libsvm_lines(asked.join(numbered, "term"), docs.join(numbered, "term"), shown, numbered.count())


_SCORED = "select lang = 'ru' as label, round(n / greatest(k, 1), 4) score from (select lang, len(w) k, list_sum(list_transform(w, lambda x: length(x))) n from (select lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where lang is not null and text is not null)) where k > 0"


def _scored(spark, d):
    docs = _docs(spark, d, "text", "lang").filter("lang is not null and text is not null")
    words = text.tokens("text", text.ALNUM)
    total = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.char_length(w))
    return docs.select((F.col("lang") == "ru").alias("label"), F.round(total / F.when(F.size(words) > 0, F.size(words)), 4).alias("score")).filter("score is not null")


_CONFUSION = f"select threshold, cast(count(*) filter (label and score > threshold) as bigint) tp, cast(count(*) filter (not label and score > threshold) as bigint) fp, cast(count(*) filter (label and score <= threshold) as bigint) fn, cast(count(*) filter (not label and score <= threshold) as bigint) tn from ({_SCORED}), (select unnest(cast([LEVELS] as double[])) threshold) group by 1"
_LEVELS = [4.0 + 0.25 * k for k in range(13)]


@query("confusion", _CONFUSION.replace("LEVELS", "5.25"))
def confusion(spark, d):
    return metrics.confusion(_scored(spark, d), [5.25])


@query(
    "threshold_sweep",
    f"""with c as ({_CONFUSION.replace("LEVELS", ", ".join(map(str, _LEVELS)))}),
    p as (select *, case when tp = 0 or tp + fp = 0 then 0 else tp / (tp + fp) end pr, case when tp = 0 or tp + fn = 0 then 0 else tp / (tp + fn) end re, case when tn = 0 then 0 else tn / (tn + fn) end pr0, case when tn = 0 then 0 else tn / (tn + fp) end re0 from c),
    f as (select *, case when pr * re = 0 then 0 else 2 * pr * re / (pr + re) end f, case when pr0 * re0 = 0 then 0 else 2 * pr0 * re0 / (pr0 + re0) end f0 from p)
    select threshold, tp, fp, fn, tn, round(cast(pr as double), 6) "precision", round(cast(re as double), 6) recall, round(cast(f as double), 6) f1, round(cast(pr0 as double), 6) precision_0, round(cast(re0 as double), 6) recall_0, round(cast(f0 as double), 6) f1_0, round(cast((f + f0) / 2 as double), 6) macro_f1 from f""",
)
def threshold_sweep(spark, d):
    return metrics.precision_recall(metrics.confusion(_scored(spark, d), _LEVELS))


@query("roc_auc", f"with s as ({_SCORED}), r as (select label, avg(n) over (partition by score) rk from (select label, score, row_number() over (order by score) n from s)) select round((sum(rk) filter (label) - count(*) filter (label) * (count(*) filter (label) + 1) / 2) / (count(*) filter (label) * count(*) filter (not label)), 6) auc from r")
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d))


@query("hist_by_class", "with s as (select lang, n_chars from documents where lang is not null and n_chars >= 0 and n_chars < 3000), c as (select lang, cast(floor(n_chars / 10.0) as bigint) bin, count(*) n from s group by 1, 2) select lang, bin, round(n / (sum(n) over (partition by lang) * 10.0), 8) density from c")
def hist_by_class(spark, d):
    return metrics.histogram(_docs(spark, d, "lang", "n_chars"), "lang", "n_chars", 10.0, 3000.0)


@query("doc_stats", r"select doc_id, cast(coalesce(len(w), 0) as bigint) num_words, round(case when len(w) = 0 then 0.0 else list_sum(list_transform(w, lambda x: length(x))) / len(w) end, 6) avg_word_len from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents)")
def doc_stats(spark, d):
    return metrics.doc_stats(_docs(spark, d, "text")).withColumn("num_words", F.coalesce("num_words", F.lit(0)).cast("bigint"))


@query("zip_ratio")
def zip_ratio(spark, d):
    return _docs(spark, d, "text").select("doc_id", text.zip_ratio("text").alias("ratio"))


@query("length_average", f"select round(avg(len({_W.format(chr(34) + 'text' + chr(34))})), 6) average, count(*) n_docs from documents")
def length_average(spark, d):
    return _docs(spark, d, "text").agg(F.round(F.avg(F.when(F.col("text").isNotNull(), F.size(text.tokens("text")))), 6).alias("average"), F.count("*").alias("n_docs"))


@query("bow_df_limits", f"with t as (select distinct doc_id, unnest({_W.format('text')}) term from documents), c as (select term, count(*) df from t where length(term) > 1 group by 1) select term, df from c where df >= 0.02 * (select count(*) from documents) and df <= 0.9 * (select count(*) from documents)")
def bow_df_limits(spark, d):
    return metrics.limited_vocabulary(_docs(spark, d, "text"))


@query("kfold_assign", "select doc_id, ('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::bigint % 10 fold from documents")
def kfold_assign(spark, d):
    return _docs(spark, d).select("doc_id", metrics.fold("doc_id", 10).alias("fold"))


@query("split_md5", "select doc_id, ('0x' || substr(md5(doc_id || 's'), 1, 8))::bigint % 100 < 80 is_train from documents")
def split_md5(spark, d):
    return _docs(spark, d).select("doc_id", (metrics.fold("doc_id", 100, "s") < 80).alias("is_train"))


@query("sample_topk", "select doc_id from documents order by md5(doc_id || 's'), doc_id limit 100")
def sample_topk(spark, d):
    return metrics.sample_without_replacement(_docs(spark, d), "doc_id", 100)


@query("bootstrap_rows")
def bootstrap_rows(spark, d):
    """Documents drawn with replacement."""
    return metrics.bootstrap_sample(_docs(spark, d), "doc_id")


@query("sequential_split", "select doc_id, row_number() over (order by doc_id) <= 300 is_train from documents")
def sequential_split(spark, d):
    """The first 300 rows by id for training, the rest for tests."""
    from tessera.operators.prefix import row_numbers

    return row_numbers(_docs(spark, d).withColumn("all", F.lit(1)), ["all"], [F.col("doc_id")]).select("doc_id", (F.col("row") <= 300).alias("is_train"))


@query("language_counts", "select lang, count(*) n from documents group by 1")
def language_counts(spark, d):
    return _docs(spark, d, "lang").groupBy("lang").agg(F.count("*").alias("n"))


_GROUPS = r"""s as (select regexp_replace(lower(split_name), '[^\p{L}\p{N}]+', '', 'g') split, session_id, list_sum(clicks) total, len(clicks) k from sessions where split_name is not null and len(clicks) > 0),
    n as (select *, (row_number() over (partition by split order by session_id) - 1) // {size} grp from s),
    g as (select split, cast(grp as bigint) grp, avg(case when total > 0 then 1 else 0 end) ctr, avg(coalesce(total, 0) / k) mean_clicks from n group by 1, 2 having count(*) = {size})"""
#: Sessions a group in the queries: the tables are small.
GROUP = 20


def _groups(spark, d):
    return abtest.group_metrics(table(spark, d, "sessions"), GROUP)


@query("ab_ctr_groups", f"with {_GROUPS.replace('{size}', str(GROUP))} select split, grp, round(ctr, 6) ctr, round(mean_clicks, 6) mean_clicks from g")
def ab_ctr_groups(spark, d):
    return _groups(spark, d).select("split", "grp", F.round("ctr", 6).alias("ctr"), F.round("mean_clicks", 6).alias("mean_clicks"))


def _two(groups):
    """The two splits with the most groups, by name."""
    names = sorted(r.split for r in groups.groupBy("split").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "split").limit(2).collect())
    return (names + ["", ""])[:2]


@query(
    "ab_tstat",
    f"""with {_GROUPS.replace('{size}', str(GROUP))}, t as (select split from g group by 1 order by count(*) desc, split limit 2), o as (select split, row_number() over (order by split) r from t),
    x as (select r, ctr, mean_clicks from g join o using (split)),
    m as (select 'ctr' metric, abs(avg(ctr) filter (r = 1) - avg(ctr) filter (r = 2)) / sqrt(var_samp(ctr) filter (r = 1) / count(*) filter (r = 1) + var_samp(ctr) filter (r = 2) / count(*) filter (r = 2)) t from x
          union all select 'mean_clicks', abs(avg(mean_clicks) filter (r = 1) - avg(mean_clicks) filter (r = 2)) / sqrt(var_samp(mean_clicks) filter (r = 1) / count(*) filter (r = 1) + var_samp(mean_clicks) filter (r = 2) / count(*) filter (r = 2)) from x)
    select metric, round(t, 6) t, case when t > 1.96 then 1 else 0 end reject from m""",
)
def ab_tstat(spark, d):
    groups = materialize(_groups(spark, d), "groups")
    a, b = _two(groups)
    return abtest.t_criterion(groups, a, b, "ctr").unionByName(abtest.t_criterion(groups, a, b, "mean_clicks"))


@query("ab_bootstrap")
def ab_bootstrap(spark, d):
    """Share of bootstrap iterations that reject the equality of the two largest splits."""
    groups = materialize(_groups(spark, d), "groups")
    a, b = _two(groups)
    return abtest.bootstrap(groups, a, b, "ctr").unionByName(abtest.bootstrap(groups, a, b, "mean_clicks"))


def _design(spark, d):
    """Parts as a regression problem: price from size and two derived numbers."""
    x = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double"), F.length("p_name").cast("double"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("row"), x.alias("x"), F.col("p_retailprice").cast("double").alias("y"))


_LONG = "long as (select y, 0 feature, cast(p_size as double) v from d union all select y, 1, cast(p_partkey % 50 as double) from d union all select y, 2, cast(length(p_name) as double) from d)"
_BEST = f"""with d as (select p_size, p_partkey, p_name, cast(p_retailprice as double) y from part), {_LONG},
    per as (select feature, v, count(*) c, sum(y) s from long group by 1, 2),
    cum as (select feature, v, sum(c) over w - c nl, sum(s) over w - s sl, sum(c) over a n, sum(s) over a sn from per window w as (partition by feature order by v), a as (partition by feature)),
    g as (select feature, v, nl * (n - nl) / (n * n) * pow(sl / nl - (sn - sl) / (n - nl), 2) gain from cum where nl >= 1 and n - nl > 1)"""


@query("best_split", f"{_BEST} select feature, v as value, round(round(gain, 9), 4) gain from g order by round(gain, 9) desc, feature, v limit 1")
def best_split(spark, d):
    gains = boost.split_gains(_design(spark, d).withColumn("g", F.lit(0)), ["g"])
    return boost.best_splits(gains, ["g"]).select("feature", "value", F.round("gain", 4).alias("gain"))


@query("split_curve", f"{_BEST} select feature, v as value, round(round(gain, 9), 3) gain from g")
def split_curve(spark, d):
    """Gain of every split of every feature."""
    return boost.split_gains(_design(spark, d).withColumn("g", F.lit(0)), ["g"]).select("feature", "value", F.round("gain", 3).alias("gain"))


@query("mse_of_mean", "select round(avg(pow(p_retailprice - m, 2)), 2) mse from part, (select avg(cast(p_retailprice as double)) m from part)")
def mse_of_mean(spark, d):
    rows = _design(spark, d)
    return boost.mse(rows.withColumn("prediction", F.lit(rows.agg(F.avg("y")).first()[0]))).select(F.round("mse", 2).alias("mse"))


def _curve(**options):
    def run(spark, d):
        rows = materialize(_design(spark, d), "design")
        return boost.curve(boost.fit(rows, 3, **options), rows)

    return run


QUERIES["cart_tree"] = _curve(steps=1, depth=3)
QUERIES["boosting_curve"] = _curve(steps=4, depth=2, shrinkage=0.3)
QUERIES["bagboo_curve"] = _curve(steps=2, depth=2, shrinkage=0.3, bags=3, row_share=0.7, column_share=0.67)
QUERIES["bagboo_replacement_curve"] = _curve(steps=2, depth=2, shrinkage=0.3, bags=3, row_share=1.0, replace=True)
QUERIES["oblivious_curve"] = _curve(steps=2, depth=2, shrinkage=0.5, oblivious=True)


@query("heldout_curves")
def heldout_curves(spark, d):
    """Errors after each step on the rows the trees were grown on and on held-out ones, for plain and oblivious trees."""
    rows, out = materialize(_design(spark, d), "design"), None
    train, test = rows.filter(metrics.fold("row", 10) < 7), rows.filter(metrics.fold("row", 10) >= 7)
    for kind, oblivious in (("plain", False), ("oblivious", True)):
        forest = boost.fit(train, 3, steps=3, depth=2, shrinkage=0.4, oblivious=oblivious)
        for part, on in (("train", train), ("test", test)):
            errors = boost.curve(forest, on).select(F.lit(kind).alias("trees"), F.lit(part).alias("part"), "steps", "mse")
            out = errors if out is None else out.unionByName(errors)
    return out


@query("feature_importances")
def feature_importances(spark, d):
    """Importance of each feature in a boosted model and a forest; each model's sum to one."""
    rows = materialize(_design(spark, d).select("row", "y", array_to_vector("x").alias("features")), "vectors")
    found = []
    for name, model in (("boosted", regression.GBTRegressor(labelCol="y", maxIter=5, maxDepth=2, seed=1)), ("forest", regression.RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=4, seed=1))):
        found += [(name, k, round(float(v), 6)) for k, v in enumerate(model.fit(rows).featureImportances.toArray())]  # a number per feature
    return spark.createDataFrame(found, "model string, feature int, importance double")


@query("bagboo_grid")
def bagboo_grid(spark, d):
    """Errors over a grid of boosting steps and bags with the same product."""
    rows, out = materialize(_design(spark, d), "design"), None
    for steps, bags in ((4, 1), (2, 2), (1, 4)):
        part = boost.curve(boost.fit(rows, 3, steps=steps, bags=bags, depth=2, row_share=0.7), rows).filter(F.col("steps") == steps).select("steps", F.lit(bags).alias("bags"), "mse")
        out = part if out is None else out.unionByName(part)
    return out


@query("library_regressors")
def library_regressors(spark, d):
    """Errors of the built-in tree regressors on the same problem."""
    rows = materialize(_design(spark, d).select("row", "y", array_to_vector("x").alias("features")), "vectors")
    out = None
    for name, model in (("tree", regression.DecisionTreeRegressor(labelCol="y", maxDepth=3, seed=1)), ("boosted", regression.GBTRegressor(labelCol="y", maxIter=5, maxDepth=2, seed=1)), ("forest", regression.RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=4, seed=1))):
        part = boost.mse(model.fit(rows).transform(rows)).select(F.lit(name).alias("model"), "mse")
        out = part if out is None else out.unionByName(part)
    return out


@query("forest_grid")
def forest_grid(spark, d):
    """Cross-validated errors over a grid of forests, and the importance of the features of the best."""
    rows = materialize(_design(spark, d).select("row", "y", array_to_vector("x").alias("features")), "vectors")
    model = regression.RandomForestRegressor(labelCol="y", seed=1)
    grid = tuning.ParamGridBuilder().addGrid(model.numTrees, [5, 10, 20]).addGrid(model.maxDepth, [2, 3, 4]).build()
    found = tuning.CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=evaluation.RegressionEvaluator(labelCol="y"), numFolds=3, seed=1, parallelism=2).fit(rows)
    params = [(g[model.numTrees], g[model.maxDepth], float(e)) for g, e in zip(grid, found.avgMetrics)]
    return spark.createDataFrame(params, "trees int, depth int, rmse double").select("trees", "depth", F.round("rmse", 3).alias("rmse"))


def _spam_vectors(spark, d):
    """Labelled pages with the binary vector of all terms within the limits of document frequency; these bound the vocabulary."""
    pages = table(spark, d, "spam_pages").filter("mark is not null").select("id", "mark", files.decoded(F.col("page_b64")).alias("page")).filter("page is not null")
    words = pages.select(F.col("id").alias("row"), F.col("mark").cast("double").alias("y"), F.filter(text.tokens(text.visible_text("page"), text.ALNUM), lambda w: F.char_length(w) > 1).alias("w")).filter("size(w) > 0")
    counts = feature.CountVectorizer(inputCol="w", outputCol="features", vocabSize=1 << 18, minDF=0.02, maxDF=0.9, binary=True).fit(words)
    return materialize(counts.transform(words).select("row", "y", "features", vector_to_array("features").alias("x")), "bags")


@query("spam_classifier")
def spam_classifier(spark, d):
    """Quality of a multilayer perceptron on held-out labelled pages (binary bag of words)."""
    rows = _spam_vectors(spark, d)
    train, test = rows.filter(metrics.fold("row", 5) > 0), rows.filter(metrics.fold("row", 5) == 0)
    size = len(rows.select("x").first()[0])
    model = classification.MultilayerPerceptronClassifier(labelCol="y", layers=[size, 16, 2], maxIter=40, seed=1).fit(train)
    scored = model.transform(test).select((F.col("y") == 1).alias("label"), vector_to_array("probability")[1].alias("score"))
    return metrics.precision_recall(metrics.confusion(scored, [0.5]))


@query("deep_classifier")
def deep_classifier(spark, d):
    """Quality of the network pre-trained by stacked RBMs on held-out labelled pages."""
    rows = _spam_vectors(spark, d)
    train, test = rows.filter(metrics.fold("row", 5) > 0).select("row", "x", "y"), rows.filter(metrics.fold("row", 5) == 0)
    size = len(rows.select("x").first()[0])
    net = network.Network([size, 24, 8, 1]).pretrain(train, epochs=2).fit(train, iterations=12)
    return metrics.precision_recall(metrics.confusion(net.predict(test).select((F.col("y") == 1).alias("label"), "score"), [0.5]))


@query("rbm_monitor")
def rbm_monitor(spark, d):
    """Reconstruction error and pseudo-likelihood of an RBM on the labelled pages as its training goes on."""
    rows = _spam_vectors(spark, d).select("row", "x")
    machine, out = network.Rbm(len(rows.first()[1]), 16), []
    for epoch in range(3):
        out.append((epoch, round(machine.reconstruction_error(rows), 4), round(machine.pseudo_likelihood(rows), 4)))
        machine.fit(rows, epochs=1)
    return spark.createDataFrame(out, "epoch int, error double, pseudo_likelihood double")


@query("softmax_classifier")
def softmax_classifier(spark, d):
    """Share of the held-out labelled pages that a network with a softmax output puts into their class."""
    rows = _spam_vectors(spark, d)
    train, test = rows.filter(metrics.fold("row", 5) > 0).select("row", "x", "y"), rows.filter(metrics.fold("row", 5) == 0)
    net = network.Network([len(rows.select("x").first()[0]), 12, 2]).fit(train, iterations=12)
    return net.predict(test).agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") == F.col("y")).cast("double")), 4).alias("accuracy"))


@query("vec_topk", "with q as (select vec_id query_vec, embedding e from embeddings where vec_id % 100 = 0), s as (select query_vec, vec_id, round(list_cosine_similarity(cast(e as double[]), cast(embedding as double[])), 6) cosine from q, embeddings where vec_id <> query_vec), r as (select *, row_number() over (partition by query_vec order by cosine desc, vec_id) place from s) select query_vec, vec_id, cosine, cast(place as int) place from r where place <= 5")
def vec_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return rank.nearest(vectors, vectors.filter("vec_id % 100 = 0"), 5)


@query("events_tumbling", "select date_trunc('hour', ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def events_tumbling(spark, d):
    """Extension: hourly windows."""
    return admission.tumbling(table(spark, d, "events"))


@query("events_sessions", "with e as (select user_id, ts, case when ts - lag(ts) over w >= interval 30 minutes or lag(ts) over w is null then 1 else 0 end b from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from e) select user_id, min(ts) start, count(*) n from s group by user_id, k")
def events_sessions(spark, d):
    """Extension: sessions closed by half an hour of silence."""
    return admission.sessions(table(spark, d, "events"))
