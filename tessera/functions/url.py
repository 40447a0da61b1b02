"""Features of urls: segments, extensions, parameters, digits, brackets, special symbols, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unquoted(col: Column) -> Column:
    """Percent-decoding that leaves the plus sign; what can't be decoded gives null."""
    return F.try_url_decode(F.regexp_replace(col, r"\+", "%2B"))


def path_of(url: Column) -> Column:
    """Path without ;parameters of its last segment; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_features(urls: DataFrame, key: str = "rec_id", col: str = "url", lower: bool = True) -> DataFrame:
    """``key, feature``: one row per feature a url has, repeated ones too.

    The path is decoded before it is split; empty segments are skipped and don't count in the index. A url
    without path has zero segments; null urls and urls that can't be decoded have no row. With ``lower`` names,
    extensions and parameters are lower-cased. Digits and letters of the patterns are those of ASCII. A pair of round
    brackets anywhere but at the start counts as one at the end.
    """
    u = F.col(col)
    raw_path, raw_query = path_of(u), query_of(u)
    base = urls.select(F.col(key).alias("key"), raw_path.alias("raw_path"), raw_query.alias("raw_query"), unquoted(raw_path).alias("path"), unquoted(raw_query).alias("query")).filter("path is not null and query is not null")
    base = base.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
    return base.select("key", F.explode(F.concat(_whole(), _segments(lower), _parameters(lower))).alias("feature"))


def _if(condition: Column, *values: Column) -> Column:
    """The values as an array where the condition holds, else an empty one."""
    return F.when(condition, F.array(*values)).otherwise(F.array().cast("array<string>"))


NUMERIC = r"^(?:[0-9]+$|[0-9]+\.)"
SYMBOL = r"[-,;:@_\s]"


def _whole() -> Column:
    path, query, segments = F.col("path"), F.col("query"), F.col("segments")
    year = F.regexp_extract(path, r"^.+/(20[0-9][0-9])/", 1)
    numeric = F.size(F.filter(segments, lambda s: s.rlike(NUMERIC)))
    return F.concat(
        F.array(F.concat(F.lit("segments:"), F.size(segments)), F.concat(F.lit("url_cnt_digit_segments:"), numeric)),
        _if((path != F.col("raw_path")) | (query != F.col("raw_query")), F.lit("url_was_encoded:1")),
        _if(path.endswith("/"), F.lit("url_last_symbols_/:1")),
        _if((year != "") & (year >= "2010"), F.lit("url_data_large_2010_:1")),
        _if((year != "") & path.rlike(r"^.+/[0-9][0-9]/[0-9][0-9]/?"), F.lit("data_in_url_path:1")),
    )


def _segments(lower: bool) -> Column:
    def one(s: Column, i: Column) -> Column:
        low = lambda c: F.lower(c) if lower else c
        f = lambda label, value=None: F.concat(F.lit(label), i.cast("string"), F.lit(":"), value if value is not None else F.lit("1"))
        ext = low(F.regexp_extract(s, r"^.+\.(.+)", 1))
        sign_ext = low(F.regexp_extract(s, r"^[^0-9]+[0-9]+[^0-9]+\.([^0-9A-Za-z_]+)", 1))
        symbols = F.regexp_extract_all(s, F.lit(f"({SYMBOL})"), F.lit(1))
        bracketed, first = s.rlike(r"\(.*\)"), s.rlike(r"^\(.*\)")
        return F.concat(
            F.array(f("segment_name_", low(s)), f("segment_len_", F.char_length(s).cast("string"))),
            _if(s.rlike(NUMERIC), f("segment_[0-9]_")),
            _if(s.rlike(r"^[^0-9]+[0-9]+[^0-9]+$"), f("segment_substr[0-9]_")),
            _if(s.rlike(r"^[0-9]+[^0-9]"), f("segment_digits_in_begin_")),
            _if(s.rlike(r"[^0-9][0-9]+(?:\.[0-9A-Za-z_]+)?$"), f("segment_digits_in_end_")),
            _if(s.rlike(r"^[a-zA-Z]+$") & (s != F.lower(s)), f("segment_not_lower_")),
            _if(ext != "", f("segment_ext_", ext), F.lit("segment_ext_exist:"), F.concat(F.lit("segment_ext:"), ext)),
            _if(sign_ext != "", f("segment_ext_substr[0-9]_", sign_ext)),
            _if(first, f("segment_include_brackets_in_begin")),
            _if(bracketed & ~first, f("segment_include_brackets_in_end")),
            _if(F.size(symbols) > 7, f("segment_many_special_symbol_", F.size(symbols).cast("string"))),
            F.flatten(
                F.transform(
                    F.array_distinct(symbols),
                    lambda c: F.array(
                        f("segment_special_symbol_"),
                        F.concat(F.lit("segment_special_symbol_"), c, F.lit(":1")),
                        F.concat(F.lit("segment_include_cnt_special_symbol_"), c, F.lit(":"), F.size(F.filter(symbols, lambda d: d == c)).cast("string")),
                    ),
                )
            ),
            _if(s.contains(":"), f("segment_before_:_", F.regexp_extract(s, r"^(.*):", 1))),
        )

    return F.flatten(F.transform("segments", one))


def _parameters(lower: bool) -> Column:
    low = lambda c: F.lower(c) if lower else c

    def one(p: Column) -> Column:
        pair = p.rlike(r"^.+=.+")
        return F.when(pair, F.array(F.concat(F.lit("param_name:"), low(F.regexp_extract(p, r"^(.+)=(.+)", 1))), F.concat(F.lit("param:"), low(p)))).otherwise(F.array(F.concat(F.lit("param_name:"), p)))

    parts = F.filter(F.split("query", "&"), lambda p: p != "")
    return F.when(F.col("query") == "", F.array(F.lit("not_param:"))).otherwise(F.concat(F.array(F.lit("url_include_param:1")), F.flatten(F.transform(parts, one))))


def feature_counts(features: DataFrame) -> DataFrame:
    """``feature, n``: occurrences, repeated ones within a url each."""
    return features.groupBy("feature").agg(F.count("*").alias("n"))


def supported(counts: DataFrame, n_known: int, share: float = 0.07) -> DataFrame:
    """Features that are neither too rare nor on nearly every url, and all segment counts."""
    border = 0.5 * share * n_known
    return counts.filter(((F.col("n") > border) & (F.col("n") <= 2 * n_known - border)) | F.col("feature").contains("segments:"))
