"""Column functions on small golden tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventmill.functions import dates as D
from eventmill.functions import text as T
from eventmill.functions import urls as U

NOW = "2026-01-20 12:00:00"


def one(spark, column, text, *more):
    return spark.createDataFrame([(text, *more)], ", ".join(f"c{i} string" for i in range(1 + len(more)))).select(column.alias("x")).first()["x"]


def as_of():
    return F.lit(NOW).cast("timestamp_ntz")


C = lambda: F.col("c0")


@pytest.mark.parametrize("text,want", [
    ("26 janvier 2026", "2026-01-26"), ("le 3 FÉVRIER", "2026-02-03"), ("27/01/2026", "2026-01-27"), ("27/01/26", "2026-01-27"), ("27/01", "2026-01-27"), ("27-01-2026", "2026-01-27"), ("2026-01-27", "2026-01-27"), ("32 janvier 2026", None), ("rien", None), ("", None), (None, None),
])
def test_parse_date_generic(spark, text, want):
    got = one(spark, D.parse_date_generic(C(), as_of()), text)
    assert (got and got.strftime("%Y-%m-%d")) == want


@pytest.mark.parametrize("text,want", [("19h30", "19:30"), ("19:30", "19:30"), ("19h", "19:00"), ("à 9 h", "09:00"), ("rien", None), (None, None)])
def test_parse_time_generic(spark, text, want):
    assert one(spark, D.parse_time_generic(C()), text) == want


@pytest.mark.parametrize("text,want", [("à 19H30", 1170), ("19h", 1140), ("25h00 ou 8:15", 495), ("99h99", None)])
def test_parse_french_time(spark, text, want):
    assert one(spark, D.parse_french_time(C()), text) == want


@pytest.mark.parametrize("text,want", [
    ("27 janvier 2026", "2026-01-27 20:00"), ("Mardi 27 janvier 2026 à 19h30", "2026-01-27 19:30"), ("Du 29 janvier au 7 février 2026", "2026-01-29 20:00"),
    ("27 janvier", "2026-01-27 20:00"), ("1 décembre", "2026-12-01 20:00"), ("10 decembre 2025", "2025-12-10 20:00"), ("5 truc 2026", None), ("31 février", None), (None, None),
])
def test_parse_french_date(spark, text, want):
    got = one(spark, D.parse_french_date(C(), as_of()), text)
    assert (got and got.strftime("%Y-%m-%d %H:%M")) == want


def test_infer_year_takes_the_next_after_thirty_days(spark):
    now = F.lit("2026-06-01 12:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([(5, 2), (5, 1), (4, 30), (7, 1)], "m int, d int").select(D.infer_year(F.col("m"), F.col("d"), now).alias("y")).collect()
    assert [r["y"] for r in rows] == [2026, 2027, 2027, 2026]


@pytest.mark.parametrize("text,want", [
    ("30 janvier", [30]), ("Du 3 au 5 février", [3, 4, 5]), ("2, 3 et 5 février", [2, 3, 5]), ("23 et 24 janvier", [23, 24]), ("Jusqu'au 31 janvier", [31]), ("32 janvier", []), ("À venir 4 mars", [4]), ("Du 28 au 30 février 2026", [28]), ("rien", []), (None, []),
])
def test_expand_french_dates(spark, text, want):
    assert [t.day for t in one(spark, D.expand_french_dates(C(), as_of()), text)] == want


def test_iso_dates_in_a_zone(spark):
    ask = lambda t: one(spark, D.parse_iso_local(C()), t)
    assert ask("2026-01-26T19:00:00Z") == dt.datetime(2026, 1, 26, 20)
    assert ask("2026-07-26T19:00:00+02:00") == dt.datetime(2026, 7, 26, 19)
    assert ask("2026-07-26T19:00:00") == dt.datetime(2026, 7, 26, 19)
    assert ask("2026-07-26") == dt.datetime(2026, 7, 26)
    assert ask("soon") is None


def test_terms_and_labels(spark):
    ts = F.to_timestamp_ntz(C())
    assert one(spark, D.french_date_term(ts), "2026-01-05 20:00:00") == "lundi-05-janvier"
    assert one(spark, D.french_date_term(ts), "2026-08-01 20:00:00") == "samedi-01-aout"
    assert one(spark, D.format_french_date_long(ts), "2026-12-27 20:00:00") == "27 décembre 2026"
    assert one(spark, D.expiry_ts(ts), "2026-03-28 23:30:00") == dt.datetime(2026, 3, 29)
    assert one(spark, D.day_label(F.to_date(C()), F.to_date(as_of())), "2026-01-20") == "Aujourd'hui"


@pytest.mark.parametrize("text,want", [("  a\n b\t c ", "a b c"), (None, ""), ("", "")])
def test_clean_text(spark, text, want):
    assert one(spark, T.clean_text(C()), text) == want


def test_truncate(spark):
    assert one(spark, T.truncate_words(C(), 12), "short") == "short"
    assert one(spark, T.truncate_words(C(), 12), "one two three four") == "one two..."
    assert one(spark, T.truncate_words(C(), 12), "x" * 20) == "x" * 9 + "..."
    assert one(spark, T.truncate_chars(C(), 12), "one two three four") == "one two t..."


@pytest.mark.parametrize("text,want", [
    ("<p>Un&nbsp;<b>soir</b></p>", "Un soir"), ("Caf&eacute; &#8217; &#x41;", "Café ’ A"), ('<a href="x">y</a> href="javascript:alert(1)" z', "y z"), ('t onclick="x()" u', "t u"), (None, ""),
])
def test_sanitize_description(spark, text, want):
    assert one(spark, T.sanitize_description(C()), text) == want


def test_names(spark):
    assert one(spark, T.normalize_venue_text(C()), "L’Œuvre – Théâtre (Été)") == "l oeuvre theatre ete"
    assert one(spark, T.normalize_name(C()), " Concert : Jazz! ") == "concert jazz"
    assert one(spark, T.slugify(C()), "Théâtre de l'Œuvre — 1,000 Straße") == "theatre-de-l-oeuvre-1000-strasse"
    assert one(spark, T.sanitize_slug(C()), "Un_Soir  à l'opéra!") == "un-soir--lopra".replace("--", "-")
    assert one(spark, T.slug_to_title(C()), "le-theatre-des-arts") == "Le Theatre des Arts"
    assert one(spark, T.alias_to_slug(C()), "/locations/foo/") == "foo" and one(spark, T.alias_to_slug(C()), "/x/foo/") == ""
    assert one(spark, T.strip_articles(C()), "le la friche") == "friche" and one(spark, T.strip_articles(C()), "lezard") == "lezard"


def test_similarity_is_by_matching_blocks(spark):
    ask = lambda a, b: one(spark, T.name_similarity(F.col("c0"), F.col("c1")), a, b)
    assert ask("Concert de Jazz", "concert de jazz!") == 1.0
    assert ask("Spectacle de danse", "Spectacle de danses") > 0.9 and ask("Jazz", "Théâtre") < 0.5


@pytest.mark.parametrize("url", ["https://www.example.com/event/123", "http://example.com/event/123/", "HTTPS://Example.com/event/123?utm_source=x", "example.com/event/123?ref=a"])
def test_normalize_url(spark, url):
    assert one(spark, U.normalize_url(C()), url) == "example.com/event/123"


@pytest.mark.parametrize("url,want", [
    ("https://example.com/x", True), ("ftp://example.com", False), ("http://localhost/", False), ("http://a.localhost", False), ("http://127.0.0.1", False), ("http://172.16.9.9", False), ("http://172.32.0.1", True),
    ("http://169.254.1.1", False), ("http://[::1]/", False), ("http://[fe80::1]/", False), ("http://[2606:4700::1]/", True), ("http://user@10.1.1.1:80/", False), ("", False), (None, False),
])
def test_is_safe_url(spark, url, want):
    assert one(spark, U.is_safe_url(C()), url) is want


@pytest.mark.parametrize("link,want", [("/a", "https://x.org/a"), ("b", "https://x.org/p/b"), ("//y.org/c", "https://y.org/c"), ("http://z.org", "http://z.org"), ("#t", "https://x.org/p/q#t"), ("mailto:a@b", "mailto:a@b")])
def test_absolute_url(spark, link, want):
    assert one(spark, U.absolute_url(F.lit("https://x.org/p/q?z"), C()), link) == want


def test_ids_and_files(spark):
    assert one(spark, U.source_id_from_url(F.lit("s"), C()), "https://x.org/events/jazz/") == "s:jazz"
    assert one(spark, U.source_id_from_url(F.lit("s"), C(), "path"), "https://x.org/e/jazz.html") == "s:e/jazz"
    assert one(spark, U.source_id_from_url(F.lit("s"), C(), "decoded"), "https://x.org/e/%C3%A9t%C3%A9") == "s:été"
    assert one(spark, U.image_file_name(C(), F.lit("jazz")), "https://x.org/a.PNG").startswith("jazz-") and one(spark, U.image_file_name(C(), F.lit("")), "https://x.org/a.PNG").endswith(".png")
