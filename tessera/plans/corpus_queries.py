"""Queries on sources and sinks (written to the shared folder and read back), data quality, routing, harness and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text, url
from tessera.operators import crawl, index, metrics, rank
from tessera.plans import boolean
from tessera.sources import files, records
from tessera.tables import materialize, shared_dir, spread, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _crawl(spark, d, *cols):
    return spread(table(spark, d, "crawl_document").select("rec_id", *cols), "rec_id")


def _docs(spark, d, *cols):
    return spread(table(spark, d, "documents").select("doc_id", *cols), "doc_id")


# ---- sources and sinks

_DIGEST = "select url, md5(coalesce(body, '')) body_md5, md5(coalesce(text, '')) text_md5, body is null no_body, text is null no_text, count(*) n from crawl_document group by all"


@query("docstream_round_trip", _DIGEST)
def docstream_round_trip(spark, d):
    """The crawl written as length-prefixed records and read back."""
    records.register(spark)
    path = _path(spark, "stream")
    _crawl(spark, d, "url", "body", "text").select("url", "body", "text").write.format("docstream").mode("append").save(path)
    back = spark.read.format("docstream").load(path)
    digest = lambda c: F.md5(F.coalesce(c, F.lit("")))
    return back.select("url", digest("body").alias("body_md5"), digest("text").alias("text_md5"), F.isnull("body").alias("no_body"), F.isnull("text").alias("no_text")).groupBy("url", "body_md5", "text_md5", "no_body", "no_text").agg(F.count("*").alias("n"))


_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("index_store_load", f"select term, count(*) n, cast(sum(doc_id) as bigint) sum_ids from (select distinct doc_id, unnest({_W}) term from documents) group by 1")
def index_store_load(spark, d):
    """The inverted index stored with compressed blocks and loaded again."""
    path = _path(spark, "index")
    index.store(_docs(spark, d, "text"), path, "simple9")
    return index.load(spark, path).groupBy("term").agg(F.count("*").alias("n"), F.sum("key").alias("sum_ids"))


_SHARD = "cast(floor(greatest(doc_id - 1, 0) / 1000) as bigint) + 1"


@query("shards_round_trip", f"select {_SHARD} shard, count(*) n, cast(sum(coalesce(length(text), 0)) as bigint) chars from documents group by 1")
def shards_round_trip(spark, d):
    """The corpus appended to shards in two runs; the second stores what the first left out."""
    path, docs = _path(spark, "shards"), _docs(spark, d, "text")
    files.append_shards(docs, path, wanted=docs.filter(metrics.fold("doc_id", 3) == 0))
    files.append_shards(docs, path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"))


@query("shard_lookup", "select doc_id, md5(text) text_md5 from documents where doc_id in (1, 7, 500, 1000, 1001)")
def shard_lookup(spark, d):
    """Documents looked up by id in their shards."""
    path = _path(spark, "shards")
    files.append_shards(_docs(spark, d, "text"), path)
    return files.lookup(spark, path, [1, 7, 500, 1000, 1001]).select("doc_id", F.md5("text").alias("text_md5"))


_PAGES = "select cast(id as int) id, mark, url, length(page_b64) n from spam_pages where mark is not null and page_b64 is not null and url is not null and page_b64 <> ''"


def _page_file(spark, d, separator):
    path = _path(spark, "pages")
    rows = table(spark, d, "spam_pages").filter("mark is not null and page_b64 is not null and url is not null and page_b64 <> ''")
    rows.select(F.concat_ws(separator, "id", "mark", "url", "page_b64").alias("line")).write.option("compression", "gzip").text(path)
    return path


@query("pages_tab_file", f"select id, mark = 1 as mark, url from ({_PAGES})")
def pages_tab_file(spark, d):
    """Labelled pages from tab-separated gzip files, by way of their parsed copy."""
    path = _page_file(spark, d, "\t")
    reader = lambda s, p: files.labelled_pages(s, p, header=False)
    files.cached_pages(spark, path, path + "-copy", reader)
    return files.cached_pages(spark, path, path + "-copy", reader, reparse=True).select("id", "mark", "url")


@query("pages_blank_file", f"select id, mark = 1 as mark, url from ({_PAGES})")
def pages_blank_file(spark, d):
    """Labelled pages from files whose fields are parted by blanks."""
    return files.blank_separated_pages(spark, _page_file(spark, d, " ")).select("id", "mark", "url")


@query("url_files", "select site, case when text is null then 'unknown' else 'known' end kind, url, count(*) n from crawl_document where regexp_full_match(site, '\\w+(\\.\\w+)?') group by all")
def url_files(spark, d):
    """Url lists in files urls.<site>.<kind>, one a site and kind, read back by their names."""
    path = _path(spark, "urls")
    rows = _crawl(spark, d, "site", "url", "text").filter(F.col("site").rlike(r"^\w+(\.\w+)?$"))
    named = rows.select(F.regexp_replace("site", r"\.", "__").alias("s"), F.when(F.col("text").isNull(), "unknown").otherwise("known").alias("k"), "url")
    named.repartition("s", "k").write.partitionBy("s", "k").text(path)
    back = spark.read.text(path).select(F.regexp_replace("s", "__", ".").alias("site"), F.col("k").alias("kind"), F.trim("value").alias("url"))
    return back.groupBy("site", "kind", "url").agg(F.count("*").alias("n"))


@query("feature_file", "select rec_id as feature_id, length(url) n from crawl_document")
def feature_file(spark, d):
    """Feature counts written as tab-separated text and read back."""
    path = _path(spark, "features")
    files.write_features(_crawl(spark, d, "url").select(F.concat(F.lit("f:"), "rec_id").alias("feature"), F.char_length("url").cast("bigint").alias("n")), path)
    return files.read_features(spark, path).select(F.substring("feature", 3, 20).cast("bigint").alias("feature_id"), "n")


_CLICKS = "select query_id, len(serp) n_serp, len(coalesce(clicked, [])) n_clicked, coalesce(list_sum(serp), 0)::bigint sum_serp, count(*) n from clicks where serp is not null group by all"


@query("click_file", _CLICKS)
def click_file(spark, d):
    """The click log written as lines with bracketed lists and read back."""
    path = _path(spark, "clicks")
    show = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array().cast("array<bigint>")), lambda x: x.cast("string")), ", "), F.lit("]"))
    table(spark, d, "clicks").filter("serp is not null").select(F.concat_ws("\t", "query_id", show("serp"), show("clicked")).alias("line")).write.text(path)
    total = F.aggregate("serp", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return files.click_log(spark, path).groupBy("query_id", F.size("serp").cast("bigint").alias("n_serp"), F.size("clicked").cast("bigint").alias("n_clicked"), total.alias("sum_serp")).agg(F.count("*").alias("n"))


@query("session_file", "select len(clicks) n_clicks, cast(list_sum(clicks) as bigint) total, count(*) n from sessions where clicks is not null and len(clicks) > 0 group by all")
def session_file(spark, d):
    """Sessions written as lines of integers and read back."""
    path = _path(spark, "sessions")
    table(spark, d, "sessions").filter("size(clicks) > 0").select(F.array_join(F.transform("clicks", lambda x: x.cast("string")), " ").alias("line")).write.text(path)
    return files.sessions(spark, path).groupBy(F.size("clicks").cast("bigint").alias("n_clicks"), F.aggregate("clicks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")).agg(F.count("*").alias("n"))


@query("matrix_file", "select round(p_retailprice, 2) y, cast(p_size as double) x, count(*) n from part group by all")
def matrix_file(spark, d):
    """A numeric matrix without a header, its target in the last column."""
    path = _path(spark, "matrix")
    table(spark, d, "part").select(F.concat_ws(",", F.col("p_size").cast("double"), F.round("p_retailprice", 2)).alias("line")).write.text(path)
    return files.matrix(spark, path, 1).select(F.round("y", 2).alias("y"), F.get("x", 0).alias("x")).groupBy("y", "x").agg(F.count("*").alias("n"))


@query("libsvm_file", "select cast(coalesce(n_chars, 0) as double) as label, len(w) n_features, count(*) n from (select n_chars, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+')) w from documents where title is not null) where len(w) > 0 group by all")
def libsvm_file(spark, d):
    """Sparse rows written in the sparse text form and read back."""
    path = _path(spark, "libsvm")
    rows = _docs(spark, d, "title", "n_chars").filter("title is not null").select("n_chars", F.array_distinct(text.tokens("title")).alias("w")).filter("size(w) > 0")
    files.write_libsvm(rows.select(F.concat_ws(" ", F.coalesce("n_chars", F.lit(0)), F.array_join(F.transform("w", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":1"))), " ")).alias("line")), path)
    return files.read_libsvm(spark, path).groupBy("label", F.size("features").cast("bigint").alias("n_features")).agg(F.count("*").alias("n"))


@query("probability_files", "select query_id, doc_id, round((query_id % 100) / 100.0 + doc_id / 1e6, 6) probability from (select distinct query_id, unnest(serp) doc_id from clicks)")
def probability_files(spark, d):
    """Two files of one line per pair, zipped by line number."""
    a, b = _path(spark, "results"), _path(spark, "info")
    pairs = materialize(rank.shown(table(spark, d, "clicks")).select("query_id", "doc_id").orderBy("query_id", "doc_id").coalesce(1), "pairs")
    pairs.select(F.round(F.pmod("query_id", F.lit(100)) / 100 + F.col("doc_id") / 1e6, 6).cast("string")).coalesce(1).write.text(a)
    pairs.select(F.concat_ws(" ", "query_id", "doc_id")).coalesce(1).write.text(b)
    return files.line_probabilities(spark, a, b)


@query("submission_file", "select cast(query_id as varchar) as QueryId, cast(max(d) as varchar) as DocID from (select query_id, unnest(serp) d from clicks) group by query_id")
def submission_file(spark, d):
    """Ranked documents written as a submission and read back: the shown document with the largest id."""
    path = _path(spark, "submission")
    best = rank.shown(table(spark, d, "clicks")).groupBy("query_id").agg(F.max("doc_id").alias("doc_id")).withColumn("place", F.lit(1))
    files.write_submission(best, path)
    return spark.read.option("header", True).csv(path).select("QueryId", "DocID")


@query("prediction_file", "select cast(doc_id as varchar) as Id, case when length(text) > 500 then '1' else '0' end as Prediction from documents")
def prediction_file(spark, d):
    """Predictions written as a submission and read back."""
    path = _path(spark, "predictions")
    files.write_predictions(_docs(spark, d, "text").select(F.col("doc_id").alias("id"), F.coalesce(F.char_length("text") > 500, F.lit(False)).cast("int").alias("prediction")), path)
    return spark.read.option("header", True).csv(path).select("Id", "Prediction")


@query("query_dictionary", "select query_id, trim(query) query from queries where query is not null and trim(query) <> '' and not regexp_matches(query, '[\\r\\n\"\\x00-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{206f}\\x{3000}]') and trim(query) = regexp_replace(query, '^\\s+|\\s+$', '', 'g')")
def query_dictionary(spark, d):
    """Queries by number from a file of quoted lines."""
    path = _path(spark, "queries")
    clean = table(spark, d, "queries").filter(F.col("query").isNotNull() & (F.trim("query") != "") & ~F.col("query").rlike('[\\r\\n"\\x00-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{206f}\\x{3000}]') & (F.trim("query") == F.regexp_replace("query", r"^\s+|\s+$", "")))
    clean.select(F.concat(F.col("query_id").cast("string"), F.lit('\t"'), F.trim("query"), F.lit('"')).alias("line")).write.text(path)
    return files.keyed_lines(spark, path, "query_id", "query", "\t")


@query("url_dictionary", "select rec_id as idx, url from crawl_document where not regexp_matches(url, '[\\s\"]')")
def url_dictionary(spark, d):
    """Urls by number from a file of quoted lines, looked up by the url without its quotation marks."""
    path = _path(spark, "index")
    rows = table(spark, d, "crawl_document").filter(~F.col("url").rlike(r'[\s"]')).select("rec_id", "url")
    rows.select(F.concat(F.col("rec_id").cast("string"), F.lit(' "'), "url", F.lit('"')).alias("line")).write.text(path)
    return files.keyed_lines(spark, path, "idx", "url")


@query("model_persistence", "select cast(0 as bigint) n_differences, count(*) n from part")
def model_persistence(spark, d):
    """A model stored and loaded again predicts the same for every row."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor

    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row"), array_to_vector(F.array(F.col("p_size").cast("double"), F.length("p_name").cast("double"))).alias("features"), F.col("p_retailprice").cast("double").alias("y"))
    path, model = _path(spark, "model"), DecisionTreeRegressor(labelCol="y", maxDepth=3, seed=1).fit(rows)
    model.write().overwrite().save(path)
    both = model.transform(rows).select("row", F.col("prediction").alias("a")).join(DecisionTreeRegressionModel.load(path).transform(rows).select("row", F.col("prediction").alias("b")), "row")
    return both.agg(F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("n_differences"), F.count("*").alias("n"))


@query("gazetteer_terms", "select lower(n_name) term from nation union select 'atlantis'")
def gazetteer_terms(spark, d):
    """Names of places from a windows-1251 file, with one added by hand."""
    path = _path(spark, "places")
    table(spark, d, "nation").select("n_name").write.text(path)
    return files.gazetteer(spark, path, ("Atlantis",))


@query("experiment_log", "select bags, steps, error from (values (1, 2, 0.5), (2, 1, 0.25), (2, 2, 0.125)) t(bags, steps, error)")
def experiment_log(spark, d):
    """Results appended run by run."""
    path = _path(spark, "log")
    for row in ((1, 2, 0.5), (2, 1, 0.25), (2, 2, 0.125)):
        files.append_log(spark.createDataFrame([row], "bags int, steps int, error double"), path)
    return spark.read.parquet(path).select("bags", "steps", "error")


# ---- formats, encodings, work lists


@query("page_formats", r"select rec_id, case when body is null then null when regexp_matches(body[1:2048], '(?i)<(?:!doctype|html|head|body|title|div|p|h[1-6]|a|li|span|table|br)\b') then 'html' when body = '' then 'unknown' else 'text' end as format from crawl_document")
def page_formats(spark, d):
    """Format of each page by its first bytes and its mark-up."""
    return _crawl(spark, d, "body").select("rec_id", files.file_format(F.col("body").cast("binary")).alias("format"))


@query("encodings_detected")
def encodings_detected(spark, d):
    """Pages by label and encoding of their bytes; the decoded text is the page's whatever the encoding."""
    raw = table(spark, d, "spam_pages").select("mark", F.try_to_binary(F.rpad(F.regexp_replace("page_b64", r"[\s=]+", ""), ((F.length(F.regexp_replace("page_b64", r"[\s=]+", "")) + 3) / 4).cast("int") * 4, "="), F.lit("base64")).alias("raw"))
    found = raw.filter("raw is not null").select("mark", files.detect_encoding(F.col("raw"))["encoding"].alias("encoding"), F.char_length(files.detected_text(F.col("raw"))).alias("n_chars"))
    return found.groupBy("mark", "encoding").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


_EXT = r"lower(regexp_extract(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1))"


@query("parse_work_list", f"select rec_id from crawl_document where {_EXT} not in ('doc', 'pdf') and rec_id % 3 <> 0 and text is not null")
def parse_work_list(spark, d):
    """Pages still to be parsed: no skipped format, not done (every third stands for the log of done ones), wanted (those with a text)."""
    rows = table(spark, d, "crawl_document").select("rec_id", "url", F.col("text").isNotNull().alias("wanted"))
    return files.to_parse(rows, rows.filter("rec_id % 3 = 0"), rows.filter("wanted")).select("rec_id")


@query("malformed_lines", "select query_id, len(string_split(coalesce(query, ''), ' ')) n_fields from queries where len(string_split(coalesce(query, ''), ' ')) <> 3")
def malformed_lines(spark, d):
    """Lines whose number of fields isn't the expected one."""
    n = F.size(F.split(F.coalesce("query", F.lit("")), " "))
    return table(spark, d, "queries").select("query_id", n.cast("bigint").alias("n_fields")).filter("n_fields <> 3")


@query("html_with_head", f"select rec_id, md5(t) text_md5 from (select rec_id, {text.visible_text_sql('body', keep_head=True)} t from crawl_document)")
def html_with_head(spark, d):
    """Text of pages without scripts and styles, the head's kept."""
    return _crawl(spark, d, "body").select("rec_id", F.md5(text.visible_text("body", keep_head=True)).alias("text_md5"))


_GUESS = "case when w is null or greatest({all}) = 0 then '' {cases} end".format(
    all=", ".join(f"n_{lang}" for lang in text.STOP_WORDS), cases=" ".join("when n_{0} = greatest({1}) then '{0}'".format(lang, ", ".join(f"n_{x}" for x in text.STOP_WORDS)) for lang in text.STOP_WORDS)
)
_COUNTS = ", ".join("len(list_filter(w, lambda t: t in ({0}))) n_{1}".format(", ".join(f"'{s}'" for s in stop.split()), lang) for lang, stop in text.STOP_WORDS.items())


@query(
    "query_routing",
    f"""select query_id, guess, case when guess in ('ru', 'uk', 'en') then query else translate(lower(query), '{text.EN_KEYS.replace(chr(39), chr(39) * 2)}', '{text.RU_KEYS}') end as query
    from (select query_id, query, {_GUESS} guess from (select query_id, query, w, {_COUNTS} from (select query_id, query, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') w from queries)))""",
)
def query_routing(spark, d):
    """Queries of a known language as they are, the others read in the Russian keyboard layout."""
    guessed = table(spark, d, "queries").select("query_id", "query", text.guess_language(text.tokens("query"), fallback="").alias("guess"))
    return guessed.select("query_id", "guess", F.when(F.col("guess").isin("ru", "uk", "en"), F.col("query")).otherwise(text.repair_layout("query")).alias("query"))


@query("lemma_counts", r"with t as (select lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) token from documents where lang is not null), m as (select distinct lang, token, token[1:4] as lemma from t where length(token) > 6 and not regexp_matches(token, '[0-9]')) select lang, coalesce(lemma, token) lemma, count(*) n from t left join m using (lang, token) group by 1, 2")
def lemma_counts(spark, d):
    """Counts of lemmas by a lemma table; the table here cuts long words to four letters, any (lang, token, lemma) table serves."""
    tokens = _docs(spark, d, "lang", "text").filter("lang is not null").select("lang", F.explode(text.tokens("text")).alias("token"))
    lemmas = tokens.filter((F.char_length("token") > 6) & ~F.col("token").rlike("[0-9]")).distinct().withColumn("lemma", F.substring("token", 1, 4))
    return text.lemmas(tokens, lemmas).groupBy("lang", "lemma").agg(F.count("*").alias("n"))


# ---- membership


@query("known_urls", "select c.rec_id, c.url, k.url is not null as known from crawl_document c left join (select distinct url from crawl_document where text is not null and length(text) > 500) k using (url)")
def known_urls(spark, d):
    """Whether each url is on the list of known ones (here: those with a text of some length)."""
    rows = _crawl(spark, d, "url", "text")
    known = rows.filter(F.char_length("text") > 500).select("url").distinct().withColumn("hit", F.lit(True))
    return rows.join(known, "url", "left").select("rec_id", "url", F.coalesce("hit", F.lit(False)).alias("known"))


@query("place_queries", "with p as (select distinct unnest(regexp_extract_all(lower(n_name), '[\\p{L}\\p{N}_]+')) term from nation), t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) term from documents) select term, count(*) n from t join p using (term) group by 1")
def place_queries(spark, d):
    """Documents that name each place of the gazetteer."""
    places = table(spark, d, "nation").select(F.explode(text.tokens("n_name")).alias("term")).distinct()
    return index.doc_terms(_docs(spark, d, "text")).join(F.broadcast(places), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


_STOP = " ".join(text.STOP_WORDS.values()).split()


@query("without_stop_words", "select query_id, array_to_string(list_filter(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in dict.fromkeys(_STOP)) + ")), ' ') query from queries")
def without_stop_words(spark, d):
    """Queries without the stop words of their languages."""
    kept = F.filter(text.tokens("query"), lambda w: ~w.isin(list(dict.fromkeys(_STOP))))
    return table(spark, d, "queries").select("query_id", F.array_join(kept, " ").alias("query"))


# ---- boolean answers


_ANSWERS = {"page & river": "list_contains(w, 'page') and list_contains(w, 'river')", "the & !page": "list_contains(w, 'the') and not list_contains(w, 'page')", "nothing_has_this": "false"}


@query("bool_answers", " union all ".join(f"select {k} query_id, '{q}' query, doc_id, source from (select doc_id, source, coalesce({_W}, []) w from documents) where {c}" for k, (q, c) in enumerate(_ANSWERS.items(), 1)))
def bool_answers(spark, d):
    """Answers with the query's line as it was asked and the document's source."""
    docs = materialize(_docs(spark, d, "text", "source"), "docs")
    asked = spark.createDataFrame(list(enumerate(_ANSWERS, 1)), "query_id int, query string")
    found = index.search_many(asked, index.doc_terms(docs), docs.select(F.col("doc_id").alias("key")))
    return found.join(asked, "query_id").join(docs.select(F.col("doc_id").alias("key"), "source"), "key").select("query_id", "query", F.col("key").alias("doc_id"), "source")


# ---- crawl focusing


def _segments(spark, d):
    """``rec_id, site, url, cluster, is_good``: clusters of all urls by their features; known urls are good ones."""
    rows = materialize(_crawl(spark, d, "site", "url"), "urls")
    features = url.url_features(rows)
    usual = url.supported(url.feature_counts(features), rows.count()).select("feature")
    model, vectors = crawl.segment_model(materialize(features.join(F.broadcast(usual), "feature", "left_semi"), "features"))
    placed = model.transform(vectors).select(F.col("key").alias("rec_id"), F.col("cluster").cast("bigint").alias("cluster"))
    known = known_urls(spark, d).select("rec_id", F.col("known").alias("is_good"))
    return rows.join(placed, "rec_id").join(known, "rec_id").select("rec_id", "site", "url", "cluster", "is_good")


@query("segment_admission")
def segment_admission(spark, d):
    """Admission by clusters of url features: urls and known urls that each site's quota fetches."""
    rows = materialize(_segments(spark, d), "segments")
    decided = crawl.replay(rows, crawl.cluster_quality(rows, 500), 500)
    return decided.join(rows.select("rec_id", "is_good"), "rec_id").filter("fetched").groupBy("site").agg(F.count("*").alias("n_fetched"), F.sum(F.col("is_good").cast("bigint")).alias("n_known"))


_CLUSTERED = "select rec_id, url, ('0x' || substr(md5(site), 1, 8))::bigint % 33 as cluster from crawl_document"


@query("cluster_members", f"select cluster, count(*) n, count(distinct url) n_urls, md5(string_agg(cast(rec_id as varchar), ' ' order by rec_id)) members_md5 from ({_CLUSTERED}) group by 1")
def cluster_members(spark, d):
    """The urls of each cluster: their number and a digest of the ordered list. The list is cut in blocks on its way."""
    rows = _crawl(spark, d, "site", "url").select("rec_id", "url", F.pmod(text.md5_hash(F.col("site")), F.lit(crawl.CLUSTERS)).alias("cluster"))
    lists = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"), F.sort_array(F.collect_list("rec_id")).alias("members"))
    return lists.select("cluster", "n", "n_urls", F.md5(F.array_join(F.transform("members", lambda i: i.cast("string")), " ")).alias("members_md5"))


@query("cluster_labels", f"select count(distinct cluster) n_clusters from ({_CLUSTERED})")
def cluster_labels(spark, d):
    rows = _crawl(spark, d, "site").select(F.pmod(text.md5_hash(F.col("site")), F.lit(crawl.CLUSTERS)).alias("cluster"))
    return rows.agg(F.countDistinct("cluster").alias("n_clusters"))


_RATES = "with r as (select site, count(*) n, count(text) k from crawl_document where site is not null group by 1), m as (select avg(k / n) q, avg(least(n, 50) / 50.0) f from r)"


@query("harness_f1", f"{_RATES} select round(q, 6) known_rate, round(f, 6) fetched_rate, round(2 * q * f / (q + f), 6) f1 from m")
def harness_f1(spark, d):
    """Means over the sites of the share of known urls and of the used quota (50), and their harmonic mean."""
    rates = _crawl(spark, d, "site", "text").filter("site is not null").groupBy("site").agg(F.count("*").alias("n"), F.count("text").alias("k"))
    return metrics.harness(rates.select((F.col("k") / F.col("n")).alias("known_rate"), (F.least("n", F.lit(50)) / 50).alias("fetched_rate")))


_URL_WORDS = r"select rec_id, unnest(list_distinct(regexp_extract_all(lower(url), '[a-z]+'))) feature from crawl_document"
REPEATS = 100


@query("recall_repeats", f"""with f as ({_URL_WORDS}), r as (select unnest(range(0, {REPEATS})) r),
    g as (select feature from f group by 1 having count(*) > 0.01 * (select count(*) from crawl_document)),
    u as (select rec_id, r, ('0x' || substr(md5(rec_id || '|' || r), 1, 8))::bigint % 2 = 0 inside from crawl_document, r),
    n as (select r, count(*) filter (inside) n from u group by 1),
    s as (select r, feature from f join u using (rec_id) where inside group by 1, 2 having count(*) > 0.01 * (select n from n where n.r = u.r)),
    p as (select r.r, count(s.feature) filter (s.feature in (select feature from g)) hit, count(s.feature) found from r left join s using (r) group by 1)
    select round(avg(hit / (select count(*) from g)), 6) recall, round(avg(found / (select count(*) from g)), 6) size_ratio from p""")
def recall_repeats(spark, d):
    """Mean over a hundred random halves of how well their frequent url words reproduce those of all urls."""
    rows = _crawl(spark, d, "url")
    words = rows.select("rec_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z]+)"), F.lit(1)))).alias("feature"))
    return metrics.repeated_recall(words, rows.select("rec_id"), "rec_id", "feature", REPEATS, 0.01)


@query("frequent_features", r"with s as (select rec_id, unnest(list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) seg from crawl_document) select seg as feature, count(*) n from s group by 1 having count(*) > 2 * 0.05 * 100")
def frequent_features(spark, d):
    """Path segments on more than twice a twentieth of a hundred urls (the sample size of the exercise, here 100)."""
    segments = _crawl(spark, d, "url").select(F.explode(F.filter(F.split(url.path_of(F.col("url")), "/"), lambda x: x != "")).alias("feature"))
    return url.feature_counts(segments).filter(F.col("n") > 2 * 0.05 * 100)


@query("variant_groups", "select query_id, count(*) n_variants, string_agg(v, ',' order by v) variants from (select query_id, query_id || '_' || k v from queries, (select unnest(range(0, 3)) k) where (query_id + k) % 2 = 0) group by 1")
def variant_groups(spark, d):
    """Variants grouped by the query their id <query>_<number> begins with."""
    ids = table(spark, d, "queries").select(F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: F.pmod(F.col("query_id") + k, F.lit(2)) == 0), lambda k: F.concat_ws("_", F.col("query_id"), k))).alias("id"))
    grouped = ids.groupBy(F.split("id", "_")[0].cast("bigint").alias("query_id")).agg(F.count("*").alias("n_variants"), F.sort_array(F.collect_list("id")).alias("ids"))
    return grouped.select("query_id", "n_variants", F.array_join("ids", ",").alias("variants"))


# ---- splits, samples, scores


@query("validation_draw", "select doc_id from documents where ('0x' || substr(md5(doc_id || 'v'), 1, 8))::bigint % 10000 < 1813 and doc_id <= (select quantile_disc(doc_id, 0.1) from documents)")
def validation_draw(spark, d):
    """Validation rows: the distinct ones of a draw with replacement of a fifth (about 18 %), of the first tenth of the rows."""
    docs = _docs(spark, d)
    last = docs.agg(F.percentile_disc(0.1).withinGroup("doc_id") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.1) within group (order by doc_id)")).scalar()
    return docs.filter((metrics.fold("doc_id", 10_000, "v") < 1813) & (F.col("doc_id") <= last)).select("doc_id")


@query("first_features", "select p_partkey as row, cast(p_size as double) f0, round(p_retailprice, 2) f1 from part")
def first_features(spark, d):
    """A vector cut to its first columns."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.array(F.col("p_size").cast("double"), F.round("p_retailprice", 2), F.length("p_name").cast("double")).alias("x"))
    cut = rows.select("row", F.slice("x", 1, 2).alias("x"))
    return cut.select("row", F.get("x", 0).alias("f0"), F.get("x", 1).alias("f1"))


@query("bag_coverage")
def bag_coverage(spark, d):
    """Share of distinct rows in bags drawn with replacement, about 0.632 each."""
    rows, out = _docs(spark, d), None
    n = rows.count()
    for bag in range(3):
        part = metrics.bootstrap_sample(rows, "doc_id", bag).agg(F.round(F.countDistinct("doc_id") / F.lit(max(n, 1)), 6).alias("coverage")).withColumn("bag", F.lit(bag))
        out = part if out is None else out.unionByName(part)
    return out


@query("word_count_score", r"select doc_id, ('0x' || substr(md5(cast(coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), 0) as varchar)), 1, 8))::bigint % 1000 / 1000.0 score from documents")
def word_count_score(spark, d):
    """A score that looks random but is fixed by the number of words."""
    n = F.coalesce(F.size(text.tokens("text", text.ALNUM)), F.lit(0))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n)
    return _docs(spark, d, "text").select("doc_id", (F.pmod(text.md5_hash(n.cast("string")), F.lit(1000)) / 1000).alias("score"))


@query("length_score", r"select doc_id, n / k > 5.25 as is_spam from (select doc_id, len(w) k, list_sum(list_transform(w, lambda x: length(x))) n from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents)) where k > 0")
def length_score(spark, d):
    """Pages whose words are longer than 5.25 letters on average."""
    return metrics.doc_stats(_docs(spark, d, "text")).filter("num_words > 0").select("doc_id", (F.col("avg_word_len") > 5.25).alias("is_spam"))


@query("activations", "select vec_id, round(1 / (1 + exp(-x)), 6) sigmoid, round(tanh(x), 6) tanh, round(greatest(x, 0.0), 6) relu, round(exp(x - m) / s, 6) softmax, round(m + ln(s), 6) log_sum from (select vec_id, x, m, list_sum(list_transform(e, lambda v: exp(v - m))) s from (select vec_id, e, e[1] x, list_max(e) m from (select vec_id, cast(embedding as double[]) e from embeddings where embedding is not null and len(embedding) > 0)))")
def activations(spark, d):
    """Activation functions of the first entry of each vector, its softmax share, and the vector's log of summed exponentials."""
    from tessera.functions import maths

    e = table(spark, d, "embeddings").filter("size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    x = F.get("e", 0)
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in (("sigmoid", maths.sigmoid(x)), ("tanh", F.tanh(x)), ("relu", maths.relu(x)), ("softmax", F.get(maths.softmax("e"), 0)), ("log_sum", maths.log_sum_exp("e")))])


def _parsed(spark, d):
    return table(spark, d, "queries").select("query_id", "query", boolean.truth("query").alias("t"))


@query("bool_parsed")
def bool_parsed(spark, d):
    """Terms of every query that is a boolean expression, and whether it holds for a document without any of them."""
    return _parsed(spark, d).filter("t.terms is not null").select("query_id", F.array_join("t.terms", " ").alias("terms"), F.col("t.on_empty").alias("on_empty"))
