import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codecs, text, url


def test_varbyte_golden_bytes():
    assert [codecs.varbyte_encode([n]).hex() for n in (1, 5, 127, 128, 300)] == ["81", "a1", "ff", "0081", "3441"]
    with pytest.raises(ValueError):
        codecs.varbyte_encode([0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2**28 - 1), max_size=60))
def test_codecs_round_trip(values):
    for encode, decode in codecs.CODECS.values():
        assert decode(encode(values)) == values
    ids = codecs.sums(values)
    assert codecs.gaps(ids) == values


def test_simple9_refuses_wide_gaps():
    with pytest.raises(ValueError):
        codecs.simple9_encode([1 << 28])


def test_codec_udfs(spark):
    rows = [(1, [1, 5, 9]), (2, []), (3, None), (4, sorted(random.Random(1).sample(range(1, 10**7), 300)))]
    df = spark.createDataFrame(rows, "k int, ids array<bigint>")
    for codec in codecs.CODECS:
        back = df.select("k", codecs.decoder(codec)(codecs.encoder(codec)("ids")).alias("ids")).collect()
        assert {r.k: r.ids for r in back} == dict(rows)


def test_murmur3_known_values():
    assert text.murmur3_32(b"") == 0
    assert text.murmur3_32(b"foo") == -156908512
    assert text.murmur3_32(b"hello") == 613153351


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "formalize": "formal", "hopeful": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky", "is": "is"}
    assert {w: text.porter(w) for w in pairs} == pairs


def test_text_columns(spark):
    df = spark.createDataFrame([(1, "Путин & Медведев_1, a-b"), (2, ""), (3, None), (4, "one")], "k int, t string")
    rows = df.select("k", text.tokens("t").alias("w"), text.bigrams(text.tokens("t")).alias("b"), text.windows(text.tokens("t"), 2, include_last=False).alias("s"), text.chunks(text.tokens("t"), 3).alias("c")).collect()
    got = {r.k: r for r in rows}
    assert got[1].w == ["путин", "медведев_1", "a", "b"]
    assert got[1].b == ["путин медведев_1", "медведев_1 a", "a b"]
    assert got[1].s == ["путин медведев_1", "медведев_1 a"]
    assert got[1].c == ["путин медведев_1 a", "b"]
    assert (got[2].w, got[2].b, got[2].s, got[2].c) == ([], [], [], [])
    assert (got[3].w, got[3].b, got[3].s, got[3].c) == (None, None, None, None)
    assert (got[4].b, got[4].s, got[4].c) == ([], [], ["one"])


def test_html_and_ratio(spark):
    page = "<html><head><title>T</title></head><body><!-- x --><script>bad()</script><p>Hello &amp; bye<br/>now</p></body></html>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "p string")
    rows = df.select(text.visible_text("p").alias("v"), text.streamed_text("p").alias("s"), text.zip_ratio("p").alias("z")).collect()
    assert rows[0].v == "Hello & bye now" and "now" in rows[0].s and "T" in rows[0].s
    assert rows[0].z == round(len(page) / len(zlib.compress(page.encode(), 9)), 6)
    assert rows[1].v is None and rows[1].s is None and rows[1].z is None and rows[2].z == 0.0


def test_layout(spark):
    df = spark.createDataFrame([("ghbdtn vbh",), (None,)], "q string")
    assert [r[0] for r in df.select(text.repair_layout("q")).collect()] == ["привет мир", None]


def test_url_features(spark):
    df = spark.createDataFrame([(1, "http://s.ru/Wiki/%D0%BA%D0%B0/2012/10/05/a-b:c.html?x=1&y"), (2, "http://s.ru"), (3, None), (4, "http://s.ru/a/"), (5, "http://s.ru/%FF")], "rec_id int, url string")
    got = {}
    for r in url.url_features(df).collect():
        got.setdefault(r.key, set()).add(r.feature)
    assert {"segments:6", "segment_name_0:wiki", "segment_name_1:ка", "segment_[0-9]_2:1", "segment_ext_5:html", "segment_special_symbol_-:1", "segment_include_cnt_special_symbol_-:1", "segment_special_symbol_5:1", "segment_ext_exist:", "segment_before_:_5:a-b", "param_name:x", "param:x=1", "param_name:y", "url_was_encoded:1", "url_include_param:1", "url_data_large_2010_:1", "data_in_url_path:1", "url_cnt_digit_segments:3"} <= got[1]
    assert {"segments:0", "not_param:"} <= got[2] and 3 not in got
    assert "url_last_symbols_/:1" in got[4]


def test_language_guess(spark):
    df = spark.createDataFrame([("the cat of the house",), ("кот на крыше и в доме",), ("zzz",), (None,)], "t string")
    assert [r[0] for r in df.select(text.guess_language(text.tokens("t"))).collect()] == ["en", "ru", "ru", "ru"]


def test_year(spark):
    from tessera.operators.rank import year_of

    df = spark.createDataFrame([("kjsgksag 1012 jw 4044 dhgbajr",), ("a12345",), ("",)], "t string")
    assert [r[0] for r in df.select(year_of(F.col("t"))).collect()] == ["1012", "", ""]
