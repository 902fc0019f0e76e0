"""Text rules on hand-made rows, and the linear patterns against the plain ones."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webdrift import constants as C
from webdrift.functions import text as X
from webdrift.operators import pages, sentences
from webdrift.sources import files

NORMALIZED = [
    ("Call 010-123 45 67 or mail info@firm-a.nl", "Call phonenumber or mail email"),
    ("Phone +31 20 1234567 today", "Phone phonenumber today"),
    ("Founded 12-03-2016 09.30 here", "Founded phonenumber here"),
    ("We build.Read more!Contact", "We build. Read more! Contact"),
    ("our productsNews are here", "our products. News are here"),
    ("our products...News are here", "our products... News are here"),
    ("no change here.", "no change here."),
]


def test_normalize(column):
    assert column(X.normalize_text, *[a for a, _ in NORMALIZED]) == [b for _, b in NORMALIZED]


def test_null_text_stays_null(column):
    assert column(X.normalize_text, None) == [None]


def test_phone_mask_leaves_no_match(column):
    (masked,) = column(X.mask_phone, "a +31 20 1234567 b 020-1234567890 c")
    assert not re.search(C.PHONE, masked)


PLAIN_AND_LINEAR = [
    (C.EMAIL, C.EMAIL_LINEAR, C.EMAIL_WORD),
    (C.MISSING_SPACE, C.MISSING_SPACE_LINEAR, r"\1 \2"),
    (C.MISSING_PERIOD, C.MISSING_PERIOD_LINEAR, r"\1. \3"),
]


@pytest.mark.parametrize("plain, linear, replacement", PLAIN_AND_LINEAR)
@settings(max_examples=1500, deadline=None)
@given(text=st.text(alphabet="aBc1_@.-!? {3,}()N", max_size=40))
def test_linear_patterns_match_the_same(plain, linear, replacement, text):
    assert re.sub(linear, replacement, text, flags=re.ASCII) == re.sub(plain, replacement, text, flags=re.ASCII)


@settings(max_examples=1500, deadline=None)
@given(text=st.text(alphabet="ab.!? \n\r\t", max_size=30))
def test_line_patterns_match_the_same(text):
    pieces = [p.strip() for p in re.split(C.LINE_BREAK + "|  ", text)]
    assert [p for p in pieces if p] == [p for p in map(str.strip, re.split(C.PIECE_BREAK, text)) if p]
    if "\n\n" not in text:
        assert re.sub(C.SINGLE_NEWLINE_AFTER_TEXT, ". ", text) == re.sub(C.NEWLINE_AFTER_TEXT, r"\1. ", text)


def test_long_words_take_no_time(column):
    word = "a" * 200_000
    start = time.time()
    texts = [word, word + "." * 100_000, "x@" + word, " Abc" + "." * 200_000, "<" * 50_000, "<script>" + word]
    assert column(X.normalize_text, *texts)[0] == word
    assert len(column(lambda t: X.drop_tags(X.break_list_items(X.drop_hidden(t))), *texts)) == len(texts)
    assert time.time() - start < 60


def test_letter_filter(column):
    texts = ["", "***", "[_]", "12 34", "a1", "é!", "   "]
    assert column(X.has_letter, *texts) == [True, False, True, False, True, False, False]


def test_markup(column):
    assert column(X.strip_markup, "a<b>c{d}e", "a<<b>>c{{d}}e") == ["ace", "a>c}e"]
    assert column(X.strip_markup_repeated, "a<<b>>c{{d}}e") == ["ace"]


def test_lines(column):
    text = "Home\nOur work!\nNews  Jobs\n\n end"
    assert column(lambda t: X.newline_to_sentence(X.normalize_lines(t)), text) == ["Home. Our work! News. Jobs. end"]


def test_transliterate(column):
    assert column(X.transliterate, "Ünïcödé ß æ © “q” … €5", "plain", "Привет") == [
        'Unicode ss ae (c) "q" ... EUR5', "plain", "Привет",
    ]


def test_entities(column):
    text = "a &amp; b &#39;x&#x27; &#8364; &amp;lt; &bogus; & &nbsp;| &#0; &#99999999;"
    assert column(X.decode_entities, text) == ["a & b 'x' € &lt; &bogus; & \xa0| &#0; &#99999999;"]


def test_entities_without_semicolon(column):
    texts = ["&copy 2020 &copyright &#65 &#x41g &amp&lt &notit; &bogus &", "&#00000065; &eacute;t&eacute &AMP;"]
    assert column(X.decode_entities, *texts) == ["© 2020 ©right A Ag &< ¬it; &bogus &", "&#00000065; été &"]


def visible(spark, *html):
    rows = spark.createDataFrame(list(enumerate(html)), "id int, html string")
    return [r.text for r in pages.visible_text(rows).orderBy("id").collect()]


def test_visible_text(spark):
    assert visible(
        spark,
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><!-- <script> --><p>One</p>\n<p>Two <!-- x -->three</p></body></html>",
        '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a> <a href="/c">All</a></li></ul>',
        "<script>never closed <p>x</p>",
        "<p>a < b and c</p>",
        '<a title="x > y" href="z">link</a>',
    ) == ["TOne. Two three", "Home. News. All", "", "a < b and c", "link"]


def test_a_quote_in_a_tag_loses_no_text(spark):
    page = "<p>Start</p><a title=it's>Hello world</a> we don't <b>x</b>"
    assert visible(spark, page, '<a b = "1>2" c=\'>\' d=e"f g=>t</a>') == ["StartHello world we don't x", "t"]


def test_unclosed_brackets_take_no_time(column):
    start = time.time()
    texts = ["a<b>" + "<" * 200_000 + "{" * 200_000, "{" * 200_000 + "<b>c", "<" * 200_000 + "{d}", "<x{y>{z"]
    assert column(X.strip_markup, *texts) == [
        "a" + "<" * 200_000 + "{" * 200_000, "{" * 200_000 + "c", "<" * 200_000, "{z",
    ]
    assert time.time() - start < 30


def test_description_ending_in_a_newline(spark):
    assert visible(spark, '<meta name="description" content="Hi.\n"><p>T</p>') == ["Hi.\n. T"]


def test_end_marks_are_an_argument(column):
    assert column(lambda t: X.split_sentences(t, end_marks="(;)"), "a. b; c")[0] == ["a. b;", "c"]


def test_description(spark):
    body = "<p>Home.</p>"
    assert visible(
        spark,
        '<meta name="description" content="We build boats">' + body,
        '<meta content="We build boats!" name="description"/>' + body,
        '<meta name="description" content="">' + body,
        '<meta name="viewport" content="wide">' + body,
        body,
    ) == ["We build boats. Home.", "We build boats! Home.", "Home.", "Home.", "Home."]


def test_extract_drops_empty_pages(spark):
    rows = spark.createDataFrame([(1, "<p> </p>"), (2, "<p>x</p>"), (3, None)], "id int, html string")
    assert [(r.id, r.text) for r in pages.extract_text(rows).collect()] == [(2, "x")]
    assert sorted((r.id, r.status) for r in pages.rejects(rows).collect()) == [(1, "empty"), (3, "unreadable")]


def test_read_html_folder(spark, tmp_path):
    (tmp_path / "html.mt.html").write_text("<p>Hé</p>", encoding="utf-8")
    (tmp_path / "bad.html").write_bytes(b"<p>\xff\xfe</p>")
    (tmp_path / "note.txt").write_text("x")
    rows = {r.id: r for r in files.read_html_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"html.mt", "bad"}
    assert rows["html.mt"].html == "<p>Hé</p>" and rows["html.mt"].readable
    assert rows["bad"].html is None and not rows["bad"].readable


def test_texts_for_keys(spark, tmp_path):
    (tmp_path / "7.txt").write_text("one\ntwo\n")
    (tmp_path / "8.txt").write_text("one\ntwo")
    (tmp_path / "9.txt").write_text("x")
    keys = spark.createDataFrame([("7",), ("8",), ("8",)], "id string")
    rows = files.texts_for_keys(files.read_text_folder(spark, str(tmp_path)), keys, "id")
    assert sorted((r.id, r.text, r.line_count) for r in rows.collect()) == [("7", "one two ", 2), ("8", "one two", 2)]


def test_csv_keeps_texts(spark):
    rows = spark.createDataFrame([("01", ' "q", a\nb; ', "NA"), ("02", "", "x")], "id string, text string, k string")
    for sep in ",;":
        path = files.work_folder(spark)
        files.write_csv(rows, path, sep)
        back = files.read_csv(spark, path, files.string_schema("id", "text", "k"), sep)
        assert sorted(map(tuple, back.collect())) == [("01", ' "q", a\nb; ', "NA"), ("02", None, "x")]
        kept = files.read_csv(spark, path, files.string_schema("id", "text", "k"), sep, empty_as_null=False)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))


def test_abbreviation_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Afkorting,Betekenis(sen)\nNA,x\nprof.,professor\nir.,\n")
    (tmp_path / "b.csv").write_text('Afkorting,Betekenis\nadv.,"a, b"\nprof.,x\n')
    cells = files.read_abbreviation_lists(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert cells.where("cell = 'NA'").count() == 1
    result = sentences.abbreviation_dictionary(cells, "cell", ["list", "row"])
    assert [r.abbreviation for r in result.orderBy("list", "row").collect()] == ["prof.", "ir.", "adv."]


CELLS = [
    "AA of A.A.", "NAK / NACK", "O.L.S.[bron?]", "Dep(t)", "W.A. of WA", "prof.em.", "TU/e", "adv.", "I/O",
    "s of sec", "P.T.T.", "P.T.T.",
]


def test_abbreviation_dictionary(spark):
    rows = spark.createDataFrame(list(enumerate(CELLS)), "i int, cell string")
    result = sentences.abbreviation_dictionary(rows, "cell", ["i"])
    assert [r.abbreviation for r in result.orderBy("i", "piece_pos").collect()] == [
        "A.A.", "O.L.S.", "W.A.", "prof.em.", "adv.", "P.T.T.",
    ]
    assert set(sentences.abbreviation_list(result)) == {"A.A.", "O.L.S.", "W.A.", "prof.em.", "adv.", "P.T.T."}


def test_sentences(column):
    text = "Ask prof. Jansen today. He works at P.T.T. since May."
    known = column(lambda t: X.split_sentences(t, ["prof.", "P.T.T."]), text)[0]
    assert known == ["Ask prof. Jansen today.", "He works at P.T.T. since May."]
    assert len(column(X.split_sentences, text)[0]) == 4
    near = column(lambda t: X.split_sentences(t, ["adv.", "o.a.", "dr."]), "adv. Bos, o.a. dr. Wit! Ok")[0]
    assert near == ["adv. Bos, o.a. dr. Wit!", "Ok"]
    assert column(X.split_sentences, "Home >> News | Jobs")[0] == ["Home >>", "News |", "Jobs"]


def test_language(spark):
    rows = spark.createDataFrame([
        (0, "Wij zijn een bedrijf en maken het product voor de klant met zorg"),
        (1, "We are a company and the product is for you"),
        (2, "Wir sind eine Firma und das ist nicht alles"),
        (3, "12345"),
        (4, None),
    ], "i int, text string")
    result = sentences.detect_language(rows).orderBy("i").collect()
    assert [r.lang_code for r in result] == ["nl", "en", "de", None, None]
    assert [r.language for r in result] == ["dutch", "english", "english", "english", "english"]


def test_sentence_rows_carry_columns(spark):
    rows = spark.createDataFrame([(7, 1, "One. Two!"), (8, 0, ""), (9, 0, None)], "id int, innov int, text string")
    result = sentences.explode_sentences(rows).orderBy("sent_pos").collect()
    assert [(r.id, r.innov, r.sent_pos, r.text) for r in result] == [(7, 1, 0, "One."), (7, 1, 1, "Two!")]


def test_tokens(column):
    assert column(X.whitespace_tokens, " a\tb\xa0c\n ") == [["a", "b", "c"]]
    assert column(lambda t: X.word_tokens(t, 2), "A bc D_1 éé x") == [["bc", "d_1", "éé"]]
    assert column(lambda t: X.id_from_name(t), "x/html.mt.html", "a.txt") == ["html.mt", "a.txt"]


def test_costly_text_is_computed_once(spark, folder):
    """Filters on computed texts must stay above the computation."""
    rows = pages.extract_text(files.read_table(spark, folder, "pages"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("!--.*?") == 1
