"""Text sources and sinks: labelled pages, url lists, feature files, sharded corpora, click files, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARD = 1000

_HIGH = "".join(bytes([b]).decode("latin-1") for b in range(128, 256))
_HIGH_1251 = "".join(bytes([b]).decode("cp1251", "replace") for b in range(128, 256))


def decoded(page: Column) -> Column:
    """Base64 (padded or not) to text: UTF-8 where the bytes are valid UTF-8, else windows-1251. What isn't base64 gives null."""
    clean = F.regexp_replace(page, r"[\s=]+", "")
    padded = F.rpad(clean, ((F.length(clean) + 3) / 4).cast("int") * 4, "=")
    raw = F.try_to_binary(padded, F.lit("base64"))
    as_text = raw.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), _HIGH, _HIGH_1251))


def labelled_pages(spark: SparkSession, path: str, header: bool = True, separator: str = "\t") -> DataFrame:
    """``id int, mark boolean, url string, page string`` of lines id, mark, url, base64 page; gzip by suffix. A malformed line fails the read."""
    schema = "id int, mark int, url string, page_b64 string"
    rows = spark.read.schema(schema).option("sep", separator).option("header", header).option("mode", "FAILFAST").csv(path)
    return rows.select("id", (F.col("mark") == 1).alias("mark"), "url", decoded(F.col("page_b64")).alias("page"))


def blank_separated_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same of lines whose fields are parted by blanks, without a header."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> ''")
    return rows.select(f[0].cast("int").alias("id"), (f[1].cast("int") == 1).alias("mark"), f[2].alias("url"), decoded(f[3]).alias("page"))


def cached_pages(spark: SparkSession, path: str, cache: str, reader=labelled_pages, reparse: bool = False) -> DataFrame:
    """Parsed pages from the Parquet copy ``cache``; it is made if it is absent or ``reparse`` is set."""
    if not reparse:
        try:
            return spark.read.parquet(cache)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    reader(spark, path).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def gazetteer(spark: SparkSession, path: str, extra: tuple[str, ...] = (), encoding: str = "cp1251") -> DataFrame:
    """``term``: distinct lower-case names of a file of one name a line in a single-byte encoding, and further ones."""
    latin = spark.read.option("encoding", "iso-8859-1").csv(path, schema="name string", sep="\n")
    names = latin.select(F.lower(F.trim(F.translate("name", _HIGH, _table(encoding)))).alias("term"))
    more = spark.createDataFrame([(x.lower(),) for x in extra], "term string")
    return names.unionByName(more).filter("term <> ''").distinct()


def keyed_lines(spark: SparkSession, path: str, key: str, value: str, separator: str = r"\s+") -> DataFrame:
    """``<key> bigint, <value> string`` of lines: a number, a separator, and the rest (quotation marks around it are taken off)."""
    f = F.split(F.trim("value"), separator, 2)
    return spark.read.text(path).filter("trim(value) <> ''").select(f[0].cast("bigint").alias(key), F.regexp_replace(F.trim(f[1]), r'^"(.*)"$', "$1").alias(value))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, at bigint, line``: lines numbered from 0 within their file, however the file is split.

    A split numbers its own lines; the few splits' sizes give their offsets.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    offsets = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), ["file", "start"]).select("file", (F.col("offset") + F.col("id") - F.col("first")).alias("at"), "line")


def lines(spark: SparkSession, paths) -> DataFrame:
    """``file string, line string`` of text files, empty lines left out."""
    return spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line")).filter("line <> ''")


def url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """``site, kind, url`` of files urls.<site>.<kind>."""
    rows = lines(spark, folder)
    part = lambda k: F.regexp_extract("file", r"^urls\.(\w+)\.(\w+)", k)
    return rows.select(part(1).alias("site"), part(2).alias("kind"), F.col("line").alias("url")).filter("site <> ''")


def write_features(counts: DataFrame, path: str) -> None:
    """Feature counts as tab-separated text, the most frequent first."""
    counts.orderBy(F.desc("n"), "feature").select("feature", "n").write.mode("overwrite").option("sep", "\t").csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, n bigint").option("sep", "\t").csv(path)


def shard_of(key: Column) -> Column:
    """Shard of an id, 1000 ids each; id 0 lies in shard 1."""
    return F.floor(F.greatest(key - 1, F.lit(0)) / SHARD).cast("bigint") + 1


#: Shards that lie in one folder; within it the rows are sorted by shard, so that Parquet's statistics find one.
FOLDER = 1000


def append_shards(docs: DataFrame, path: str, key: str = "doc_id", wanted: DataFrame | None = None) -> None:
    """Append the documents that aren't stored yet (only those of ``wanted``, if given): a broken run is resumed by running it again."""
    spark = docs.sparkSession
    if wanted is not None:
        docs = docs.join(wanted.select(key), key, "left_semi")
    try:
        stored = spark.read.parquet(path).select(key)
        docs = docs.join(stored, key, "left_anti")
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    placed = docs.withColumn("shard", shard_of(F.col(key))).withColumn("folder", F.expr(f"(shard - 1) div {FOLDER}"))
    placed.repartition("folder", F.pmod("shard", F.lit(64))).sortWithinPartitions("folder", "shard", key).write.mode("append").partitionBy("folder").parquet(path)


def lookup(spark: SparkSession, path: str, ids: list[int], key: str = "doc_id") -> DataFrame:
    """Documents by id; only their shards' folders and row groups are read."""
    shards = sorted({max(i - 1, 0) // SHARD + 1 for i in ids})
    folders = sorted({(s - 1) // FOLDER for s in shards})
    return spark.read.parquet(path).filter(F.col("folder").isin(folders) & F.col("shard").isin(shards) & F.col(key).isin(ids))


def click_log(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, serp, clicked`` of lines: id, tab, [d1,d2], tab, [c1]; the last field may be absent."""
    numbers = lambda c: F.transform(F.filter(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    f = F.split("value", "\t")
    return spark.read.text(path).filter("value <> ''").select(F.get(f, 0).cast("bigint").alias("query_id"), numbers(F.get(f, 1)).alias("serp"), numbers(F.get(f, 2)).alias("clicked"))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """``clicks array<int>`` of lines of integers."""
    return spark.read.text(path).select(F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.cast("int")).alias("clicks"))


def matrix(spark: SparkSession, path: str, target: int = 0, separator: str = ",") -> DataFrame:
    """``y, x`` of a headerless numeric file; ``target`` is the target's column."""
    rows = spark.read.text(path).filter("trim(value) <> ''").select(F.transform(F.split("value", separator), lambda v: F.trim(v).cast("double")).alias("v"))
    return rows.select(F.get("v", target).alias("y"), F.filter("v", lambda v, i: i != target).alias("x"))


def libsvm_lines(query_terms: DataFrame, doc_terms: DataFrame, shown: DataFrame, n_terms: int) -> DataFrame:
    """``query_id, doc_id, line``: click label, then the query's term counts and the document's, shifted by the vocabulary's size.

    The terms frames have (key, idx from 1, tf); a line's indices ascend.
    """
    pack = lambda df, key, shift: df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "tf"))), lambda s: F.concat_ws(":", s["idx"] + shift, s["tf"])), " ").alias(f"{key}_part"))
    rows = shown.join(pack(query_terms, "query_id", 0), "query_id", "left").join(pack(doc_terms, "doc_id", n_terms), "doc_id", "left")
    return rows.select("query_id", "doc_id", F.concat_ws(" ", F.col("clicked").cast("string"), F.expr("nullif(query_id_part, '')"), F.expr("nullif(doc_id_part, '')")).alias("line"))


def triples(shown: DataFrame) -> DataFrame:
    """``line``: label, query, document."""
    return shown.select("query_id", "doc_id", F.concat_ws(" ", "clicked", "query_id", "doc_id").alias("line"))


def write_submission(ranked: DataFrame, path: str, names: tuple[str, str] = ("QueryId", "DocID"), columns: tuple[str, str] = ("query_id", "doc_id")) -> None:
    """Ranked rows (query_id, place, doc_id) as CSV with a header, in order."""
    ranked.orderBy("query_id", "place").select(*[F.col(c).alias(n) for c, n in zip(columns, names)]).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """``Id,Prediction`` as CSV."""
    predictions.orderBy("id").select(F.col("id").alias("Id"), F.col("prediction").cast("int").alias("Prediction")).write.mode("overwrite").option("header", True).csv(path)


def line_probabilities(spark: SparkSession, results: str, info: str) -> DataFrame:
    """``query_id, doc_id, probability``: two files of one line per pair, matched by line number."""
    f = F.split(F.col("line"), r"\s+")
    probability = numbered_lines(spark, results).select("at", F.trim("line").cast("double").alias("probability"))
    pair = numbered_lines(spark, info).select("at", f[0].cast("bigint").alias("query_id"), f[1].cast("bigint").alias("doc_id"))
    return probability.join(pair, "at").select("query_id", "doc_id", "probability")


def write_libsvm(rows: DataFrame, path: str) -> None:
    """Lines of the sparse text form as text files."""
    rows.select("line").write.mode("overwrite").text(path)


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """``label double, features array<struct<idx bigint, value double>>`` of sparse text files."""
    f = F.split(F.trim("value"), r"\s+")
    pair = lambda x: F.struct(F.split(x, ":")[0].cast("bigint").alias("idx"), F.split(x, ":")[1].cast("double").alias("value"))
    return spark.read.text(path).filter("trim(value) <> ''").select(f[0].cast("double").alias("label"), F.transform(F.filter(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda x: x != ""), pair).alias("features"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append results of an experiment to its log; every run adds files."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


#: Encodings tried in turn, and how sure a hit is; bytes that aren't UTF-8 are judged by how many letters of a reading are small Cyrillic or Latin ones.
LEGACY = ("windows-1251", "koi8-r")


def detect_encoding(raw: Column) -> Column:
    """(encoding, confidence) of bytes: UTF-8 by its structure, else the legacy encoding that reads the most small letters; null for null."""
    as_text = raw.cast("string")
    ascii_only = F.decode(raw, "ISO-8859-1").rlike(r"^[\x00-\x7f]*$")
    small = lambda c: F.length(F.regexp_replace(F.translate(F.decode(raw, "ISO-8859-1"), _HIGH, _table(c)), "[^а-яё]", ""))
    high = F.greatest(F.lit(1), F.length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[\x00-\x7f]", "")))
    shares = [small(c) / high for c in LEGACY]
    best = F.greatest(*shares)
    legacy = F.when(shares[0] == best, F.lit(LEGACY[0])).otherwise(F.lit(LEGACY[1]))
    struct = lambda e, c: F.struct(e.alias("encoding"), c.alias("confidence"))
    known = F.when(ascii_only, struct(F.lit("ascii"), F.lit(1.0))).when(F.is_valid_utf8(as_text), struct(F.lit("utf-8"), F.lit(0.99))).otherwise(struct(legacy, F.round(best, 4)))
    return F.when(raw.isNotNull(), known)


def _table(codec: str) -> str:
    return "".join(bytes([b]).decode(codec, "replace") for b in range(128, 256))


def detected_text(raw: Column, least: float = 0.1) -> Column:
    """The text of bytes by their detected encoding; null where the confidence doesn't exceed ``least``."""
    found = detect_encoding(raw)
    latin = F.decode(raw, "ISO-8859-1")
    read = F.when(found["encoding"].isin("ascii", "utf-8"), raw.cast("string")).when(found["encoding"] == LEGACY[0], F.translate(latin, _HIGH, _table(LEGACY[0]))).otherwise(F.translate(latin, _HIGH, _table(LEGACY[1])))
    return F.when(found["confidence"] > least, read)


def file_format(raw: Column) -> Column:
    """``pdf``, ``doc``, ``html``, ``text`` or ``unknown`` by the first bytes and the mark-up; null for null."""
    head = F.decode(F.substring(raw, 1, 2048), "ISO-8859-1")
    return (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(head.startswith("%PDF-"), "pdf")
        .when(F.hex(F.substring(raw, 1, 8)) == "D0CF11E0A1B11AE1", "doc")
        .when(head.rlike(r"(?i)<(?:!doctype|html|head|body|title|div|p|h[1-6]|a|li|span|table|br)\b"), "html")
        .when(~head.rlike(r"[\x00-\x08\x0e-\x1f]") & (F.length(head) > 0), "text")
        .otherwise("unknown")
    )


def extension(url: Column) -> Column:
    """Lower-case extension of a url's path, empty if it has none."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"\.([A-Za-z0-9]+)$", 1))


def to_parse(urls: DataFrame, done: DataFrame | None = None, wanted: DataFrame | None = None, key: str = "rec_id", url: str = "url", skipped: tuple[str, ...] = ("doc", "pdf")) -> DataFrame:
    """Rows that are still to be parsed: not of a skipped format, not done before, and wanted, if a list is given."""
    out = urls.filter(F.col(url).isNotNull() & ~extension(F.col(url)).isin(list(skipped)))
    if done is not None:
        out = out.join(done.select(key), key, "left_anti")
    return out if wanted is None else out.join(wanted.select(key), key, "left_semi")
