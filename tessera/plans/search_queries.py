"""Queries on tokens, index, boolean search, sketches, urls and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, url
from tessera.operators import crawl, index, metrics, rank, shingles
from tessera.plans import boolean
from tessera.sources import files
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
    return spread(table(spark, d, "documents").select("doc_id", *(cols or ("text",))), "doc_id")


def _crawl(spark, d, *cols):
    return spread(table(spark, d, "crawl_document").select("rec_id", *cols), "rec_id")


def _joined(pattern: str, lower: bool):
    def run(spark, d):
        words = text.tokens("text", pattern, lower)
        return _docs(spark, d).select("doc_id", F.coalesce(F.size(words), F.lit(0)).cast("bigint").alias("n"), F.array_join(words, " ").alias("words")).withColumn("n", F.greatest("n", F.lit(0)))

    source = "lower(text)" if lower else "text"
    return run, f"select doc_id, cast(coalesce(len(w), 0) as bigint) n, array_to_string(w, ' ') words from (select doc_id, regexp_extract_all({source}, '{pattern}') w from documents)"


for _name, _pattern, _lower in (("tok_word_lower", text.WORD, True), ("tok_word_case", text.WORD, False), ("tok_alnum", text.ALNUM, True), ("tok_letters", text.LETTERS, True)):
    QUERIES[_name], SQL[_name] = _joined(_pattern, _lower)

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_TERMS = f"select distinct doc_id, unnest({_W}) term from documents"


@query("term_df", f"select term, count(*) df, cast(sum(tf) as bigint) cf from (select doc_id, term, count(*) tf from (select doc_id, unnest({_W}) term from documents) group by 1, 2) group by 1")
def term_df(spark, d):
    counts = rank.term_counts(_docs(spark, d), "doc_id", "text")
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("distinct_terms", f"select count(distinct term) n_terms, count(*) n_pairs from ({_TERMS})")
def distinct_terms(spark, d):
    per = index.doc_terms(_docs(spark, d)).groupBy("term").agg(F.count("*").alias("df"))
    return per.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_pairs"))


_BLOCKS = f"select term, doc_id // {index.BLOCK} block, list(doc_id order by doc_id) ids, count(*) n from ({_TERMS}) group by 1, 2"


@query("postings", f"select term, block, n, array_to_string(ids, ' ') ids from ({_BLOCKS})")
def postings(spark, d):
    return index.postings(_docs(spark, d)).select("term", "block", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("postings_gaps", f"select term, doc_id as key, doc_id - coalesce(lag(doc_id) over (partition by term, doc_id // {index.BLOCK} order by doc_id), doc_id // {index.BLOCK} * {index.BLOCK} - 1) gap from ({_TERMS})")
def postings_gaps(spark, d):
    return index.gap_table(_docs(spark, d))


def _codec(codec):
    def run(spark, d):
        blobs = index.compressed(index.postings(_docs(spark, d)), codec)
        back = index.decompressed(blobs.select("term", "block", "blob"), codec)
        return back.select("term", "block", F.size("ids").cast("bigint").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))

    return run


for _codec_name in ("varbyte", "simple9"):
    query(f"{_codec_name}_round_trip", f"select term, block, n, array_to_string(ids, ' ') ids from ({_BLOCKS})")(_codec(_codec_name))


@query(
    "varbyte_bytes",
    f"select term, block, cast(sum(case when gap < 128 then 1 when gap < 16384 then 2 else 3 end) as bigint) n_bytes from (select term, doc_id // {index.BLOCK} block, doc_id - coalesce(lag(doc_id) over (partition by term, doc_id // {index.BLOCK} order by doc_id), doc_id // {index.BLOCK} * {index.BLOCK} - 1) gap from ({_TERMS})) group by 1, 2",
)
def varbyte_bytes(spark, d):
    return index.compressed(index.postings(_docs(spark, d)), "varbyte").select("term", "block", F.octet_length("blob").cast("bigint").alias("n_bytes"))


_BOOLEAN = {
    "bool_and": ("page & river", "list_contains(w, 'page') and list_contains(w, 'river')"),
    "bool_or": ("ferry | камера | maison", "list_contains(w, 'ferry') or list_contains(w, 'камера') or list_contains(w, 'maison')"),
    "bool_not": ("page & !river", "list_contains(w, 'page') and not list_contains(w, 'river')"),
    "bool_complement": ("!page", "not list_contains(w, 'page')"),
    "bool_nested": ("the & (river | !(page | ferry)) | книгу & !сайт", "list_contains(w, 'the') and (list_contains(w, 'river') or not (list_contains(w, 'page') or list_contains(w, 'ferry'))) or list_contains(w, 'книгу') and not list_contains(w, 'сайт')"),
}


def _boolean(expression):
    def run(spark, d):
        docs = _docs(spark, d)
        terms = index.doc_terms(docs)
        wanted = boolean.terms_of(boolean.parse(expression))
        universe = docs.select(F.col("doc_id").alias("key"))
        found = index.search(terms.filter(F.col("term").isin(wanted)), universe, expression)
        return found.select(F.col("key").alias("doc_id"))

    return run


for _name, (_expression, _condition) in _BOOLEAN.items():
    query(_name, f"select doc_id from (select doc_id, coalesce({_W}, []) w from documents) where {_condition}")(_boolean(_expression))


def _asked(spark, d):
    return table(spark, d, "queries").select("query_id", "query").filter(F.col("query").rlike("[&|!]"))


@query("bool_counts")
def bool_counts(spark, d):
    """Number of documents for every boolean query of the query table."""
    docs = _docs(spark, d)
    return index.search_many(_asked(spark, d), index.doc_terms(docs), docs.select(F.col("doc_id").alias("key")), counts_only=True)


@query("bool_results")
def bool_results(spark, d):
    """Documents of every boolean query of the query table."""
    docs = _docs(spark, d)
    return index.search_many(_asked(spark, d), index.doc_terms(docs), docs.select(F.col("doc_id").alias("key")))


@query("doc_first_per_url", "select url, rec_id from (select *, row_number() over (partition by url order by fetched_at nulls first, rec_id) r from crawl_document) where r = 1")
def doc_first_per_url(spark, d):
    return shingles.first_per_url(table(spark, d, "crawl_document").select("rec_id", "url", "fetched_at")).select("url", "rec_id")


@query("docs_listing", "select rec_id, url, cast(coalesce(strlen(body), 0) as bigint) body_bytes, cast(coalesce(strlen(text), 0) as bigint) text_bytes from crawl_document")
def docs_listing(spark, d):
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    return table(spark, d, "crawl_document").select("rec_id", "url", size("body").alias("body_bytes"), size("text").alias("text_bytes"))


_SHINGLES = r"""
    w as (select url, regexp_extract_all(text, '[\p{L}\p{N}_]+') w from (select *, row_number() over (partition by url order by fetched_at nulls first, rec_id) r from crawl_document) where r = 1),
    s as (select url, list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) s from w where len(w) > 5)"""
_SKETCH = (
    _SHINGLES
    + """,
    h as (select url, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint) h from s),
    b as (select url, list_transform(range(0, 20), lambda k: list_min(list_filter(h, lambda x: x % 20 = k))) b, list_sort(list_distinct(h)) u from h),
    k as (select url, case when len(list_filter(b, lambda x: x is not null)) = 20 then list_sort(b) when len(u) >= 20 then u[1:20] end sketch from b),
    sk as (select url, sketch from k where sketch is not null),
    c as (select sketch, min(url) rep from sk group by 1)"""
)


def _sketches(spark, d):
    first = shingles.first_per_url(_crawl(spark, d, "url", "fetched_at", "text")).select("url", "text")
    return materialize(shingles.sketches(first, "url"), "sketches")


@query("shingle_counts", f"with {_SHINGLES} select url, cast(len(s) as bigint) n, s[1] first_shingle from s")
def shingle_counts(spark, d):
    first = shingles.first_per_url(_crawl(spark, d, "url", "fetched_at", "text"))
    made = first.select("url", text.windows(text.tokens("text", lower=False), 5, include_last=False).alias("s")).filter("size(s) > 0")
    return made.select("url", F.size("s").cast("bigint").alias("n"), F.element_at("s", 1).alias("first_shingle"))


@query("minhash_sketches", f"with {_SKETCH} select url, array_to_string(sketch, ' ') sketch from sk")
def minhash_sketches(spark, d):
    return _sketches(spark, d).select(F.col("key").alias("url"), F.array_join(F.transform("sketch", lambda x: x.cast("string")), " ").alias("sketch"))


@query("neardup_members", f"with {_SKETCH} select url, rep from sk join c using (sketch)")
def neardup_members(spark, d):
    return shingles.classes(_sketches(spark, d)).select(F.col("key").alias("url"), "rep")


@query(
    "neardup_pairs",
    f"""with {_SKETCH},
    e as (select rep, unnest(sketch) h from c),
    p as (select a.rep key1, b.rep key2, count(*) shared from e a join e b on a.h = b.h and a.rep < b.rep group by 1, 2)
    select key1, key2, cast(shared as int) shared, round(shared / (shared + 2.0 * (20 - shared)), 6) jaccard, round(shared / 20.0, 6) share from p where shared >= 18""",
)
def neardup_pairs(spark, d):
    return shingles.pairs(_sketches(spark, d), 18)


def _features(spark, d):
    return url.url_features(_crawl(spark, d, "url"))


_URLS = r"""
    u as (select rec_id, regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') rp, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) rq from crawl_document),
    v as (select rec_id, rp, rq, url_decode(replace(rp, '+', '%2B')) p, url_decode(replace(rq, '+', '%2B')) q from u),
    x as (select *, list_filter(string_split(p, '/'), lambda s: s <> '') segs from v),
    sg as (select rec_id, unnest(segs) s, unnest(range(0, len(segs))) i from x),
    ex as (select *, regexp_extract(s, '^.+\.(.+)', 1) e, regexp_extract(s, '^[^0-9]+[0-9]+[^0-9]+\.([^0-9A-Za-z_]+)', 1) se from sg),
    sy as (select *, regexp_extract_all(s, '[-,;:@_\s]') y from sg),
    sc as (select rec_id, i, c, len(list_filter(y, lambda z: z = c)) n from (select rec_id, i, y, unnest(list_distinct(y)) c from sy)),
    pm as (select rec_id, m from (select rec_id, unnest(string_split(q, '&')) m from v where q <> '') where m <> ''),
    f as (
        select rec_id, 'segments:' || len(segs) feature from x
        union all select rec_id, 'segment_name_' || i || ':' || lower(s) from sg
        union all select rec_id, 'segment_len_' || i || ':' || length(s) from sg
        union all select rec_id, 'segment_[0-9]_' || i || ':1' from sg where regexp_matches(s, '^(?:[0-9]+$|[0-9]+\.)')
        union all select rec_id, 'segment_substr[0-9]_' || i || ':1' from sg where regexp_matches(s, '^[^0-9]+[0-9]+[^0-9]+$')
        union all select rec_id, 'segment_digits_in_begin_' || i || ':1' from sg where regexp_matches(s, '^[0-9]+[^0-9]')
        union all select rec_id, 'segment_digits_in_end_' || i || ':1' from sg where regexp_matches(s, '[^0-9][0-9]+(\.[0-9A-Za-z_]+)?$')
        union all select rec_id, 'segment_not_lower_' || i || ':1' from sg where regexp_matches(s, '^[a-zA-Z]+$') and s <> lower(s)
        union all select rec_id, 'segment_ext_' || i || ':' || lower(e) from ex where e <> ''
        union all select rec_id, 'segment_ext_exist:' from ex where e <> ''
        union all select rec_id, 'segment_ext:' || lower(e) from ex where e <> ''
        union all select rec_id, 'segment_ext_substr[0-9]_' || i || ':' || lower(se) from ex where se <> ''
        union all select rec_id, 'segment_include_brackets_in_begin' || i || ':1' from sg where regexp_matches(s, '^\(.*\)')
        union all select rec_id, 'segment_include_brackets_in_end' || i || ':1' from sg where regexp_matches(s, '\(.*\)') and not regexp_matches(s, '^\(.*\)')
        union all select rec_id, 'segment_many_special_symbol_' || i || ':' || len(y) from sy where len(y) > 7
        union all select rec_id, 'segment_special_symbol_' || i || ':1' from sc
        union all select rec_id, 'segment_special_symbol_' || c || ':1' from sc
        union all select rec_id, 'segment_include_cnt_special_symbol_' || c || ':' || n from sc
        union all select rec_id, 'segment_before_:_' || i || ':' || regexp_extract(s, '^(.*):', 1) from sg where contains(s, ':')
        union all select rec_id, case when regexp_matches(m, '^.+=.+') then 'param_name:' || lower(regexp_extract(m, '^(.+)=(.+)', 1)) else 'param_name:' || m end from pm
        union all select rec_id, 'param:' || lower(m) from pm where regexp_matches(m, '^.+=.+')
        union all select rec_id, 'url_data_large_2010_:1' from v where regexp_extract(p, '^.+/(20[0-9][0-9])/', 1) >= '2010'
        union all select rec_id, 'data_in_url_path:1' from v where regexp_matches(p, '^.+/20[0-9][0-9]/') and regexp_matches(p, '^.+/[0-9][0-9]/[0-9][0-9]/?')
        union all select rec_id, 'url_include_param:1' from v where q <> ''
        union all select rec_id, 'not_param:' from v where q = ''
        union all select rec_id, 'url_last_symbols_/:1' from v where ends_with(p, '/')
        union all select rec_id, 'url_was_encoded:1' from v where p <> rp or q <> rq
        union all select rec_id, 'url_cnt_digit_segments:' || len(list_filter(segs, lambda s: regexp_matches(s, '^(?:[0-9]+$|[0-9]+\.)'))) from x
    )"""
@query("url_feature_counts", f"with {_URLS} select feature, count(*) n from f group by 1")
def url_feature_counts(spark, d):
    """Every feature with its count."""
    return url.feature_counts(_features(spark, d))


@query("url_features_all", f"with {_URLS} select rec_id as key, feature, count(*) n from f group by 1, 2")
def url_features_all(spark, d):
    """The features of every url, repeated ones with their number."""
    return _features(spark, d).groupBy("key", "feature").agg(F.count("*").alias("n"))


@query("url_feature_support", f"with {_URLS}, c as (select feature, count(*) n from f group by 1), t as (select 0.035 * count(*) b, count(*) q from crawl_document) select feature, n from c, t where n > b and n <= 2 * q - b or contains(feature, 'segments:')")
def url_feature_support(spark, d):
    rows = _crawl(spark, d, "url")
    counts = url.feature_counts(url.url_features(rows))
    return url.supported(counts, rows.count())


@query("feature_recall", f"""with {_URLS}, c as (select feature, count(*) n from f group by 1), h as (select feature, count(*) n from f where rec_id % 2 = 0 group by 1),
    g as (select feature from c where n > 0.01 * (select count(*) from crawl_document)), e as (select feature from h where n > 0.01 * (select count(*) from crawl_document where rec_id % 2 = 0))
    select round(count(e.feature) / count(*), 6) recall, round((select count(*) from e) / count(*), 6) size_ratio from g left join e using (feature)""")
def feature_recall(spark, d):
    """How well the frequent features of half the urls (even ids) reproduce those of all of them."""
    rows = materialize(_crawl(spark, d, "url"), "urls")
    frequent = lambda part: url.feature_counts(url.url_features(part)).filter(F.col("n") > 0.01 * part.count()).select("feature")
    golden, found = frequent(rows), frequent(rows.filter("rec_id % 2 = 0")).withColumn("hit", F.lit(1))
    both = golden.join(found, "feature", "left").agg(F.count("hit").alias("hit"), F.count("*").alias("n"))
    return both.select(F.round(F.col("hit") / F.col("n"), 6).alias("recall"), F.round(F.lit(found.count()) / F.col("n"), 6).alias("size_ratio"))


_CLUSTERED = "select ('0x' || substr(md5(site), 1, 8))::bigint % 33 as cluster, text is not null and length(text) > 500 as is_good from crawl_document"


def _clustered(spark, d):
    return _crawl(spark, d, "site", "text").select("rec_id", "site", F.pmod(text.md5_hash(F.col("site")), F.lit(crawl.CLUSTERS)).alias("cluster"), F.coalesce(F.char_length("text") > 500, F.lit(False)).alias("is_good"))


_QUALITY = f"""q as (select cluster, count(*) n, cast(sum(case when is_good then 1 else 0 end) as bigint) n_good from ({_CLUSTERED}) group by 1),
    r as (select cluster, n, n_good, n_good / n ratio, n / (select count(*) from crawl_document) share from q)"""


@query("cluster_ratio", f"with {_QUALITY} select cluster, n, n_good, round(ratio, 6) ratio, round(share, 6) share, round(share * 10000, 4) quota from r")
def cluster_ratio(spark, d):
    q = crawl.cluster_quality(_clustered(spark, d))
    return q.select("cluster", "n", "n_good", F.round("ratio", 6).alias("ratio"), F.round("share", 6).alias("share"), F.round("quota", 4).alias("quota"))


@query("cluster_cumshare", f"with {_QUALITY} select cluster, round(sum(share) over (order by ratio desc, cluster rows unbounded preceding), 6) cum_share from r")
def cluster_cumshare(spark, d):
    return crawl.cumulative_share(crawl.cluster_quality(_clustered(spark, d))).select("cluster", F.round("cum_share", 6).alias("cum_share"))


@query("kmeans_segments")
def kmeans_segments(spark, d):
    """Size of each of the segments that clustering the url features gives."""
    model, vectors = crawl.segment_model(materialize(_features(spark, d), "features"))
    return model.transform(vectors).groupBy("cluster").agg(F.count("*").alias("n"))


@query("admission_replay")
def admission_replay(spark, d):
    """Urls each site's admission fetches."""
    rows = _clustered(spark, d)
    return crawl.replay(rows, crawl.cluster_quality(rows, 500), 500).filter("fetched").groupBy("site").agg(F.count("*").alias("n_fetched"))


@query("html_visible_text", f"select rec_id, md5(t) text_md5, cast(coalesce(length(t), 0) as bigint) n_chars from (select rec_id, {text.visible_text_sql('body')} t from crawl_document)")
def html_visible_text(spark, d):
    return _crawl(spark, d, "body").select("rec_id", text.visible_text("body").alias("t")).select("rec_id", F.md5("t").alias("text_md5"), F.coalesce(F.char_length("t"), F.lit(0)).cast("bigint").alias("n_chars"))


@query("html_streamed_text")
def html_streamed_text(spark, d):
    return _crawl(spark, d, "body").filter("body is not null").select("rec_id", text.streamed_text("body").alias("text"))


@query("page_stats")
def page_stats(spark, d):
    """Statistics of the labelled pages: words, mean length, title and link words, compression."""
    pages = table(spark, d, "spam_pages").select("id", (F.col("mark") == 1).alias("mark"), "url", files.decoded(F.col("page_b64")).alias("page")).filter("page is not null")
    words = lambda c: F.size(text.tokens(c, text.ALNUM))
    inner = lambda tag: F.array_join(F.regexp_extract_all("page", F.lit(f"(?is)<{tag}\\b[^<>]*>(.*?)</{tag}>"), F.lit(1)), " ")
    seen = pages.withColumn("t", text.visible_text("page"))
    stats = metrics.doc_stats(seen.select("id", "mark", "url", "page", "t"), "id", "t")
    rest = seen.select("id", "mark", "url", words(inner("title")).alias("num_words_title"), words(F.regexp_replace(inner("a"), "<[^<>]*>", " ")).alias("num_words_a"), text.zip_ratio(F.array_join(text.tokens("t", text.ALNUM), " ")).alias("compress_coef"))
    return rest.join(stats, "id")


@query("murmur_terms")
def murmur_terms(spark, d):
    """MurmurHash3 of every distinct term, signed, and the non-negative key made of it."""
    return index.doc_terms(_docs(spark, d)).select("term").distinct().select("term", text.murmur3("term").alias("hash")).withColumn("term_key", F.abs("hash"))


@query("stemmed_terms")
def stemmed_terms(spark, d):
    """Document frequency of stems; the language is the label's, else guessed."""
    words = text.tokens("text")
    docs = _docs(spark, d, "text", "lang").filter("text is not null").select("doc_id", words.alias("w"), F.coalesce("lang", text.guess_language(words)).alias("lang"))
    return docs.select("doc_id", "lang", F.explode(F.array_distinct(text.stems("w", "lang"))).alias("stem")).groupBy("lang", "stem").agg(F.count("*").alias("df"))


_GUESS = "case when w is null or greatest({all}) = 0 then 'ru' {cases} end".format(
    all=", ".join(f"n_{lang}" for lang in text.STOP_WORDS), cases=" ".join("when n_{0} = greatest({1}) then '{0}'".format(lang, ", ".join(f"n_{x}" for x in text.STOP_WORDS)) for lang in text.STOP_WORDS)
)
_COUNTS = ", ".join("len(list_filter(w, lambda t: t in ({0}))) n_{1}".format(", ".join(f"'{s}'" for s in stop.split()), lang) for lang, stop in text.STOP_WORDS.items())


@query("language_guess", f"select doc_id, {_GUESS} guess from (select doc_id, w, {_COUNTS} from (select doc_id, {_W} w from documents))")
def language_guess(spark, d):
    return _docs(spark, d).select("doc_id", text.guess_language(text.tokens("text")).alias("guess"))


@query("layout_repair", f"select query_id, translate(lower(query), '{text.EN_KEYS.replace(chr(39), chr(39) * 2)}', '{text.RU_KEYS}') repaired from queries")
def layout_repair(spark, d):
    return table(spark, d, "queries").select("query_id", text.repair_layout("query").alias("repaired"))


@query("bigram_counts", f"with w as (select {_W} w from documents), b as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) bigram from w where len(w) > 1) select bigram, count(*) n from b group by 1")
def bigram_counts(spark, d):
    return _docs(spark, d).select(F.explode(text.bigrams(text.tokens("text"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query("chunks7", f"with w as (select doc_id, {_W} w from documents) select doc_id, unnest(list_transform(range(0, cast(ceil(len(w) / 7.0) as bigint)), lambda i: array_to_string(w[i * 7 + 1 : i * 7 + 7], ' '))) chunk from w")
def chunks7(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(text.chunks(text.tokens("text"))).alias("chunk"))
