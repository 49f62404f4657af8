"""Language versions, OpenGraph and schema.org presence."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscope.operators.languages import alternate_problems, head_extras


def extras(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    return [(list(map(tuple, r.alternates)), r.open_graph, r.schema_types) for r in head_extras(df).orderBy("i").collect()]


def test_head_extras(spark):
    cases = [
        (None, ([], [], [])),
        ("", ([], [], [])),
        ("<link rel='x ALTERNATE' hreflang=' EN ' href=' /a?b=1&amp;c=2 '><link rel=alternate href=/no><link rel=canonical hreflang=de href=/no>", ([("en", "/a?b=1&c=2")], [], [])),
        ("<!-- <link rel=alternate hreflang=en href=/> --><script><link rel=alternate hreflang=en href=/></script>", ([], [], [])),
        ('<meta content=x property=og:b><meta property="OG:a" content="y"><meta property=og:b content=z><meta property=og:c content=""><meta name=og:d content=x>', ([], ["og:a", "og:b"], [])),
        ('<script type="application/ld+json">{"@type": "A"}</script><script id=1 type=application/ld+json>[{"@type": ["B", "A"]}, 1, {"x": {"@type": "no"}}]</script>', ([], [], ["A", "B"])),
        ('<script type="application/ld+json">{"@graph": [{"@type": "G"}, {"@type": 5}, null]}</script>', ([], [], ["5", "G"])),
        ('<script type="application/ld+json">{"@type": </script><!-- <script type="application/ld+json">{"@type": "C"}</script> -->', ([], [], [])),
    ]
    assert extras(spark, [text for text, _ in cases]) == [want for _, want in cases]


def test_alternate_problems(spark):
    link = lambda lang, href: (lang, href)
    rows = [
        ("https://e.com/en", [link("en", "/en"), link("fr", "/fr/"), link("de", "https://E.com/de"), link("es", "/es"), link("x-default", "/en")]),
        ("https://e.com/fr", [link("en", "https://e.com/en#top"), link("francais", "/fr")]),
        ("https://e.com/de/", []),
        ("https://e.com/pt", [link("zh-hant-tw", "/pt"), link("en-us", "javascript:0")]),
        ("https://e.com/pt", None),
    ]
    df = spark.createDataFrame(rows, "url string, alternates array<struct<lang:string,href:string>>")
    got = {tuple(r) for r in alternate_problems(df.withColumn("problem", F.lit("x"))).collect()}
    e = "https://e.com/"
    assert got == {(f"{e}en", "de", f"{e}de", "no return"), (f"{e}en", "es", f"{e}es", "not audited"), (f"{e}fr", "francais", f"{e}fr", "bad code")}
    assert alternate_problems(df.limit(0)).count() == 0
