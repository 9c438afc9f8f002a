"""One very long text does not stall a task: what grows with the square of spans or sections would."""

import random
import time

from gridwork.llm import pii


def test_many_spans_in_one_text(spark):
    """20,000 spans: all found and redacted, in seconds, as short texts give them."""
    r = random.Random(6)
    bits = [(lambda i: f"u{i}@ex{i % 7}.org"), (lambda i: f"10.0.{i % 256}.{i % 199}"), (lambda i: "4111 1111 1111 1111"), (lambda i: f"+1 202 555 {i % 10000:04d}"), (lambda i: "é漢 words")]
    words = [r.choice(bits)(i) for i in range(25_000)]
    text = " ; ".join(words)
    rows = spark.createDataFrame([(0, text), (1, "a@b.org"), *((2 + k, " ; ".join(words[k * 5 : k * 5 + 5])) for k in range(200))], "doc_id long, text string").repartition(4)
    pii.pii_report(rows.limit(1)).collect()  # fits the trees
    began = time.time()
    got = {x.doc_id: x for x in pii.pii_report(rows).collect()}
    assert time.time() - began < 60
    count = lambda mark: sum(mark in w for w in words)
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (count("@"), count("10.0."), count("4111 1111"), count("+1"))
    ends = [x.split(":") for x in got[0].spans.split(",")]
    assert got[0].n_spans == len(ends) == sum("é" not in w for w in words)
    assert sorted(text[int(a) : int(b)] for _, a, b in ends) == sorted(w for w in words if "é" not in w)
    clean = {x.doc_id: x.text for x in pii.redact(rows).collect()}
    assert clean[1] == "[EMAIL]" and clean[0].split(" ; ")[:1000] == " ; ".join(clean[2 + k] for k in range(200)).split(" ; ")
    assert "@" not in clean[0] and clean[0].count("é漢 words") == sum("é" in w for w in words)


def test_many_sections_in_one_text(spark):
    """16,000 blank-line-separated paragraphs: compared in seconds, by the same measure as short texts."""
    from pyspark.sql import functions as F

    from gridwork.llm import merkle

    paragraph = lambda i: f"Paragraph {i} says {i * i}.\n\n"
    text = "".join(map(paragraph, range(16_000)))
    rows = spark.createDataFrame([(1, text), (2, text[: len(text) // 2] + "new. " + text[len(text) // 2 :])], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in merkle.fingerprint_report(rows).collect()}
    assert time.time() - began < 60
    assert 0.999 < got[1].near_next < 1 and 0.5 < got[1].near_edited < 1 and got[1].near_next == got[2].near_next
    # A list that is halved says what one searched from its start says.
    names = spark.range(300).select(F.array_sort(F.transform(F.sequence(F.lit(1), F.col("id") + 1), lambda i: F.left(F.sha2((i * 3).cast("string"), 256), F.lit(16)))).alias("n"), F.left(F.sha2((F.col("id") % 97).cast("string"), 256), F.lit(16)).alias("x"))
    assert names.filter(merkle._held(F.col("n"), F.col("x")) != F.array_contains("n", F.col("x"))).count() == 0
    assert names.filter(merkle._held(F.col("n"), F.col("x"))).count() > 20


PROSE = "The committee published its yearly report on Tuesday, and it describes in some detail how the coastal towns recovered."
ARTICLE = f"<h1>Report</h1><p>{PROSE}</p><p>{PROSE} It was read by many.</p>"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/>News</a></li><li><a href=/>About us</a></li></ul>"


def test_wrappers_around_a_page():
    """An element that holds nearly the whole page does not take its article away, whatever it is called; menus and comments still go."""
    from gridwork.llm import html_cut

    want = f"Report {PROSE} {PROSE} It was read by many."
    pages = [f"<body><nav>{MENU}<article>{ARTICLE}</article></body>", f"<body><form id='aspnetForm'><div class='menu'>{MENU}</div><div>{ARTICLE}</div></form></body>", f"<body>{MENU}<div id='post-comment-policy'><article>{ARTICLE}</article></div></body>",
             f"<body><div class='search-story'>{ARTICLE}</div></body>", f"<body><nav>{MENU}</nav><div class='share-price'>{ARTICLE}</div></body>", f"<body><article>{ARTICLE}</article><div class='comments'><p>{PROSE}</p></div></body>"]
    assert [html_cut.extract(p) for p in pages] == [want] * len(pages)
    assert html_cut.extract(f"<body><nav>{MENU}</nav></body>") == html_cut.extract(f"<body><form><input><button>Send</button></form><footer>{MENU}</footer></body>") == ""
    assert all(c > 0 for c in html_cut.model()[1:])
