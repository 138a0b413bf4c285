import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import captures as cp
from tidemark.llm import warc
from tidemark.llm.queries import op11_warc
from tidemark.llm.scratch import Scratch

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by looking at all pages."""
    groups = defaultdict(list)
    for place, (page, _, html) in enumerate(rows):
        groups[html or ""].append((page is None, page, place))
    out = []
    for html, pages in groups.items():
        pages.sort(key=lambda p: (p[0], p[1] or 0, p[2]))
        size = len(html.encode())
        for i, (_, page, _) in enumerate(pages):
            again = i > 0 and size >= least
            out.append((page, size, digest(html), "revisit" if again else "response", pages[0][1] if again else None))
    return sorted(out, key=str)


def found(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def awkward_rows():
    draw = random.Random(4)
    rows = [(i, f"https://Host{i % 7}.Example.org/{i % 40}?a={i % 3}#x", "<p>" + "w " * draw.randint(0, 30)) for i in range(200, 0, -1)]
    rows += [(1000 + i, "http://one.example.com/hot", "same " * 40) for i in range(150)]
    rows += [(None, None, None), (None, "http://a.b/", "same " * 40), (5000, None, ""), (5001, "", "x"), (5002, "no host at all", "y")]
    rows += [(6000, "http://[bad/ \n\t url é", "é\r\n\r\nWARC/1.1\r\n" * 3), (7, "http://u/", "twin"), (7, "http://u/", "twin"), (7, "http://v/", "twin")]
    rows += [(8000, "http://big/", "long \U0001f600 " * 200_000), (8001, "http://word/", "z" * 2_000_000)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, PAGES).repartition(5, "url")
    return df.select("*", *(F.lit(1).alias(c) for c in ("digest", "seq", "payload", "key", "first_id", "n", "offset")))


@pytest.mark.parametrize("least", [0, 20])
def test_awkward_pages_against_all_pairs(spark, least):
    rows = awkward_rows()
    pages = frame(spark, rows)
    archived = warc.archive(pages, min_bytes=least)
    assert found(warc.look_up(archived, pages)) == expected(rows, least)


def test_pages_joined_by_digest_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_LEAST", 50)
    rows = awkward_rows()
    pages = frame(spark, rows)
    archived = warc.archive(pages, side_rows=2, file_bytes=2000)
    assert found(warc.look_up(archived, pages)) == expected(rows)
    assert archived.captures.select("file").distinct().count() > 5


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    assert warc.look_up(warc.archive(pages), pages).count() == 0


def test_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(op11_warc(spark, sf)) == expected(rows)


def test_search_reads_only_what_it_needs(spark):
    rows = awkward_rows()
    pages = frame(spark, rows)
    archived = warc.archive(pages)
    asked = spark.createDataFrame([("HTTPS://one.example.com:443/hot#frag",), ("http://u/",), ("http://not.there/",), (None,)], "url string")
    got = warc.look_up(archived, asked)
    assert sorted(str(r.page_id) for r in got.collect()) == sorted([*map(str, range(1000, 1150)), "7", "7", "None", "5000", "5001"])
    # What the wanted captures have is one range for neighbours, not whole files.
    spans = cp.search(archived.index, warc.wanted_keys(asked)).agg(F.sum("length")).first()[0]
    assert spans < archived.captures.agg(F.sum("length")).first()[0] / 2


@pytest.mark.parametrize(("block", "shard"), [(1, 3), (7, 40), (1000, 250_000)])
def test_index_finds_every_capture_of_a_key_in_any_cut(spark, block, shard):
    draw = random.Random(9)
    keys = ["", "a", "a!", "a)/", "a,b)/x", "ab", "é)/", "zz"] + [f"k{draw.randrange(30)})/" for _ in range(60)]
    rows = [(draw.choice(keys), i, None, "f", i, 1) for i in range(300)] + [("hot)/", 1000 + i, "u", "f", i, 1) for i in range(200)]
    table = spark.createDataFrame(rows, cp.CAPTURE)
    index = cp.build(table, Scratch(spark, "test"), block=block, shard=shard)
    wanted = [(k,) for k in {r[0] for r in rows if draw.random() < 0.7}] + [("absent",), ("hot)/",), ("hot)/",), (None,), ("~",)]
    got = cp.search(index, spark.createDataFrame(wanted, "key string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if (r[0],) in wanted), key=str)


def test_keys():
    same = ["http://www.Example.com/a?b", "HTTPS://u:p@www.example.com:443/a?b#c", "http://www.example.com:80/a?b"]
    assert {cp.url_key(u) for u in same} == {"com,example,www)/a?b"}
    assert cp.url_key("http://h:81") == "h:81)/"
    assert cp.url_key(None) == "" == cp.url_key("")
    assert cp.url_key("a b\nc") == "a%20b%0Ac"


def test_records_are_standard_gzip_members():
    body = warc.make_record(3, 9, "http://x/", b"pay\r\n\r\nload", digest("pay\r\n\r\nload"), None)
    text = gzip.decompress(body)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"pay\r\n\r\nload\r\n\r\n")
    head, http, payload = warc.parse_record(body)
    assert (warc.page_of(head["warc-record-id"]), http["content-length"], payload) == (3, "11", b"pay\r\n\r\nload")
    head, http, payload = warc.parse_record(warc.make_record(None, 9, None, b"abc", digest("abc"), (-4, 2)))
    assert head["warc-type"] == "revisit" and warc.page_of(head["warc-refers-to"]) == -4 and payload == b"" and http["content-length"] == "3"


def test_changed_payloads_are_errors():
    body = warc.make_record(3, 9, "http://x/", b"payload", digest("other"), None)
    with pytest.raises(ValueError, match="digest"):
        warc._records([body])
    cut = gzip.compress(zlib.decompress(body, 31)[:-3])
    with pytest.raises(ValueError, match="length"):
        warc._records([cut])
