"""Column functions over text, each against expected values or a plain Python twin."""

from __future__ import annotations

import random
import re
import time
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from winnow import fixed_values as fixed
from winnow.functions import html, pii, replies, text as t


def test_norm_skills_strips_lowers_and_drops_blanks(column):
    got = column(t.norm_skills, [["Python", " python ", "SQL", " ", " Go "], [], None], "array<string>")
    assert got == [["python", "sql", "go"], [], []]


def test_github_handle(column):
    texts = ["x GitHub.com/ab_c-1/x", "github.com/one github.com/two", "none", "github.com/"]
    assert column(t.github_handle, texts) == ["ab_c-1", "one", None, None]


def test_job_posting_id(column):
    urls = ["https://a.b/jobs/view/123/", "https://a.b/?currentJobId=45", "https://a.b/jobs/7"]
    assert column(t.job_posting_id, urls) == ["123", "45", "https://a.b/jobs/7"]


def test_query_terms_keep_three_letters(column):
    assert column(t.query_terms, ["Azure AI  Foundry", "C#", " Go \t lang", ""]) == [
        ["azure", "foundry"], [], ["lang"], [],
    ]


def test_parse_list(column):
    assert column(lambda c: t.parse_list(c, ","), ["a, ,b,", None]) == [["a", "b"], []]
    assert column(lambda c: t.parse_list(c, "\n"), ["x\n\n y "]) == [["x", "y"]]


def test_years_experience(column):
    texts = ["10+ years", "over 3.5 yrs and 12 Years", "years", "5 + years"]
    assert column(t.years_experience, texts) == [10.0, 12.0, None, 5.0]


def test_seniority(column):
    texts = ["Tech LEAD", "principal", "Senior dev", "dev", "Lead AI Engineer"]
    assert column(t.seniority_years, texts) == [8.0, 8.0, 5.0, 0.0, 8.0]
    assert column(t.seniority_title, texts)[-2:] == ["AI Engineer", "Lead AI Engineer"]


def test_job_title(column):
    assert column(t.job_title, ["a\nJob Title:  Chief \nb", "no title"]) == ["Chief", None]


def test_lines_of(column):
    assert column(t.lines_of, ["a\r\nb\rc\n", "a\n\n", "", "a"]) == [["a", "b", "c"], ["a", ""], [""], ["a"]]


COMPRESS = [
    "![a](b) x", "[t](https://x.y)", "see https://x.y/z now", "<b>bold</b>", "a Privacy Policy b",
    "a\n \n\nb", None, "", "[a](https://x)[b](https://y) z", " x ", "ALL RIGHTS RESERVED", "[a\nb](http://x)",
    "a \n　\nb", "[x] (http://y)", "![](<>)", "a\r\n\r\nb",
]


def python_compress(text):
    out = text or ""
    phrases = "(?i)" + "|".join(map(re.escape, fixed.BOILERPLATE_PHRASES))
    for pattern, replacement in {
        fixed.IMAGE_PATTERN: "",
        fixed.LINK_PATTERN: r"\g<1>",
        fixed.ADDRESS_PATTERN: "",
        fixed.TAG_PATTERN: "",
        phrases: "",
        fixed.BLANK_LINES_PATTERN: "\n",
    }.items():
        out = re.compile(pattern).sub(replacement, out)
    return out.strip()


def test_compress_markdown_matches_its_twin(column):
    random.seed(3)
    alphabet = ["![", "[", "](", "](https://", ")", "http://a", "<", ">", "\n", " ", " ", "x", " ", "\r"]
    made = ["".join(random.choices(alphabet, k=14)) for _ in range(400)]
    texts = COMPRESS + made
    assert column(t.compress_markdown, texts) == [python_compress(x) for x in texts]


WORD_CASES = [
    ("we use c# daily", "c#"), ("we use node.js here", "node.js"), ("scikit learn demo", "scikit-learn"),
    ("java script", "java"), ("javascript", "java"), ("cafés", "caf"), ("a c++ b", "c++"), ("x\\Ey", "\\E"),
    ("go_lang", "go"), ("été ok", "été"), ("", "x"), ("x", ""),
]


def test_contains_word_matches_python(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(WORD_CASES)], "i int, a string, b string")
    got = rows.select("i", t.contains_word(F.col("a"), F.col("b")).alias("out")).orderBy("i").collect()
    want = [bool(b) and bool(re.search(r"\b" + re.escape(b) + r"\b", a)) for a, b in WORD_CASES]
    assert [r["out"] for r in got] == want


# --- pages -----------------------------------------------------------------------
def test_text_of_drops_elements_and_decodes_once(column):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><nav>';</script></head>"
        "<body><nav>n<nav>inner</nav>tail</nav><header>h</header><form action='a>b'>f</form><aside>s</aside>"
        "<svg><path/></svg><p title=\"a > b\">One &amp;lt; two&nbsp;</p><!-- <p>gone</p> --> &eacute;&#233;&#x1F600;"
        "&bogus; <footer>foot</footer></body></html>"
    )
    assert column(lambda c: html.text_of(c, fixed.WEB_DROP_TAGS), [page]) == [
        "T\nOne &lt; two\néé\U0001f600&bogus;"
    ]


def test_unclosed_script_hides_the_rest(column):
    assert column(lambda c: html.text_of(c, ["script"]), ["a<script>b<p>c"]) == ["a"]


def test_headers_are_not_heads_or_navigators(column):
    page = "<header>x</header><navigator>kept</navigator><head>also</head>"
    assert column(lambda c: html.text_of(c, ["nav", "header"]), [page]) == ["kept\nalso"]


@pytest.mark.parametrize("chars, kept", [(100, False), (101, True)])
def test_web_page_needs_more_than_100_characters(column, chars, kept):
    (got,) = column(html.web_page, ["<p>" + "x" * chars + "</p>"])
    assert (got is not None) == kept


def test_page_text_is_whole_unless_a_length_is_given(column):
    page = "<p>" + "é" * 4000 + "</p>"
    (got,) = column(html.web_page, [page])
    assert len(got["text"]) == 4000 and got["title"] == fixed.WEB_TITLE
    (got,) = column(lambda c: html.web_page(c, fixed.JD_TEXT_CAP), [page])
    assert len(got["text"]) == 3500


def test_containers_go_at_any_depth(column):
    nested = "a" + "<nav>x" * 9 + "</nav>y" * 8 + "</nav>b"
    mixed = "a<header>1<nav>2<header>3</header>4</nav>5</header>b</nav>c<nav>open"
    got = column(lambda c: html.text_of(c, ["nav", "header"]), [nested, mixed, "plain", None])
    assert got == ["a\nb", "a\nb\nc", "plain", None]


class Tree(HTMLParser):
    """Text outside dropped elements, by a parser's events and a stack of open elements."""

    def __init__(self, dropped):
        super().__init__(convert_charrefs=True)
        self.dropped, self.open, self.texts = dropped, [], []

    def handle_starttag(self, tag, attrs):
        if tag == "body" and "head" in self.open:
            self.handle_endtag("head")
        like = tag in html._ENDED_BY_THEIR_LIKE and self.open[-1:] == [tag]
        if tag not in html._VOID and not like:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not set(self.open) & set(self.dropped) and data.strip():
            self.texts.append(data.strip())


def test_unclosed_containers_end_with_their_parents(column):
    draw = random.Random(3)
    parts = ["<div>", "</div>", "<nav>", "</nav>", "<header class='a>b'>", "</header>", "<p>", "</p>", "<br>", "<li>", "<nav/>", "<body>", "<head>", "</head>", "<B>", "</b >"]
    pages = ["".join(p + (f" t{i} " if draw.random() < 0.6 else "") for i, p in enumerate(draw.choices(parts, k=draw.randint(1, 40)))) for _ in range(400)]
    pages += ["<div>a<nav>b<div>c</div>d</div>e", "<nav>a</div>b</nav>c", "<ul><li>a<li><nav>b</ul>c", "x" * 10]
    want = []
    for page in pages:
        tree = Tree(["nav", "header", "head"])
        tree.feed(page)
        tree.close()
        want.append("\n".join(tree.texts))
    assert column(lambda c: html.text_of(c, ["nav", "header", "head"]), pages) == want


def test_deep_and_long_pages_take_linear_time(column):
    deep = "<div><nav>" * 500 + "in" + "</nav></div>" * 500 + "out"
    long = "<p>a<nav>b</nav>" * 5_000
    started = time.monotonic()
    got = column(lambda c: html.text_of(c, ["nav"]), [deep, long, "<nav>" * 30_000 + "never"])
    assert time.monotonic() - started < 20
    assert got[0] == "out" and got[1] == "\n".join(["a"] * 5_000) and got[2] == ""


def test_all_named_references(column):
    names = sorted(html5)
    texts = [f"a&{n}" if n.endswith(";") else f"a&{n} b" for n in names]
    want = [f"a{html5[n]}" if n.endswith(";") else f"a{html5[n]} b" for n in names]
    assert column(html.decode_entities, texts) == want


def test_references_as_browsers_read_them(column):
    texts = ["&#150;&#146;&#x96;&#129;", "&copy 2024 &copy2024 &notit; &amp;lt; &AMP &bogus", "&hellip &hellip;"]
    assert column(html.decode_entities, texts) == [
        "–’–\u0081", "© 2024 ©2024 ¬it; &lt; & &bogus", "&hellip …",
    ]


def test_job_posting_title_prefers_h2(column):
    body = "<p>" + "y" * 200 + "</p>"
    pages = ["<h1>a</h1><h2> b <i>c</i></h2>" + body, "<h1>a</h1>" + body, body, "<h1>a</h1><h2></h2>" + body]
    titles = [p["title"] for p in column(html.job_posting, pages)]
    assert titles == ["bc", "a", fixed.POSTING_TITLE_DEFAULT, ""]


def test_body_text_title_falls_back_to_page_title(column):
    pages = ["<head><title>T</title></head><body>x</body>", "<body><h1>H</h1></body>", "<body>x</body>", "<body> </body>"]
    got = column(html.body_text, pages)
    assert [p and (p["title"], p["text"]) for p in got] == [("T", "x"), ("H", "H"), ("Job Position", "x"), None]


@pytest.mark.parametrize(
    "function, text",
    [
        (t.compress_markdown, "[" * 60_000 + "![" * 60_000 + "<" * 60_000),
        (t.compress_markdown, "[a](http://x) " + "[" * 60_000 + "<b>" + "<" * 60_000),
        (lambda c: html.text_of(c, fixed.WEB_DROP_TAGS), "<a" * 100_000 + "<!--" * 50_000),
        (lambda c: html.text_of(c, fixed.WEB_DROP_TAGS), "<nav><form>" * 30_000 + "x=" * 50_000),
        (lambda c: html.text_of(c, fixed.WEB_DROP_TAGS), "<p " + "a='b' " * 100_000 + ">x</p>" * 20_000),
        (pii.redact_patterns, "Ab1" * 100_000),
    ],
)
def test_hostile_texts_take_little_time(column, function, text):
    started = time.monotonic()
    column(function, [text])
    assert time.monotonic() - started < 20


def test_emails_right_after_one_another(column):
    texts = ["a@b.com1d@z.org, ..x.y@z.io", "a@b.c d@e.fg-h@i.jk"]
    want = [re.sub(pii.PATTERNS["EMAIL_ADDRESS"], "<EMAIL_ADDRESS>", x) for x in texts]
    assert column(pii.redact_patterns, texts) == want


# --- personal data ------------------------------------------------------------------
def test_patterns_redact_by_type(column):
    texts = [
        "mail a.b+c@d-e.co.uk, call +1 (555) 555-0100 or (020) 555-0100.",
        "NI AB123456C and AB 12 34 56 C but not GB123456C, DB123456C or AB123456E",
        "", None,
    ]
    assert column(pii.redact_patterns, texts) == [
        "mail <EMAIL_ADDRESS>, call <PHONE_NUMBER> or <PHONE_NUMBER>.",
        "NI <UK_NINO> and <UK_NINO> but not GB123456C, DB123456C or AB123456E",
        "", None,
    ]


def test_spans_are_places_and_redaction_is_their_splice(column):
    draw = random.Random(9)
    parts = ["a.b@c.io", "415-555-0132", "+14155550132", "AB123456C", "é😀 ", " ", "x", "415", ".", "a@b.com415-555-0132@d.org"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(300)] + [None, ""]
    found = column(lambda c: pii.joined_spans(pii.pattern_spans(c)), texts)
    clean = column(pii.redact_patterns, texts)
    for text, spans, redacted in zip(texts, found, clean, strict=True):
        plain = sorted((m.start(), m.end(), e) for e, p in pii.PATTERNS.items() for m in re.finditer(p, text or ""))
        plain = [s for s in plain if s[2] != "UK_NINO" or text[s[0] : s[0] + 2].upper() not in pii.NINO_UNUSED_PREFIXES]
        merged = []
        for start, end, entity in plain:
            if merged and start < merged[-1][1]:
                last = merged[-1]
                longer = end - start > last[3]
                merged[-1] = (last[0], max(end, last[1]), entity if longer else last[2], max(end - start, last[3]))
            else:
                merged.append((start, end, entity, end - start))
        assert [tuple(s) for s in spans] == [m[:3] for m in merged]
        if text is not None:
            out, at = "", 0
            for start, end, entity, _ in merged:
                out, at = out + text[at:start] + f"<{entity}>", end
            assert redacted == out + text[at:]


def test_many_spans_in_one_text(column):
    text = "mail a.b@c.io, " * 5000
    started = time.monotonic()
    assert column(pii.redact_patterns, [text]) == ["mail <EMAIL_ADDRESS>, " * 5000]
    assert time.monotonic() - started < 20


def test_texts_without_names_are_not_shuffled(spark):
    from winnow.operators import redaction

    docs = spark.range(3000).selectExpr("id", "concat('some plain words ', id, if(id % 100 = 0, ' by Zed Quill', '')) AS text")
    names = spark.createDataFrame([("Zed Quill", "PERSON")], "term string, entity_type string")
    may = redaction.s.may_hold_terms(F.col("text"), names, "term", redaction.s.NAME_TOKEN, ignore_case=False)
    assert docs.filter(may).count() == 30
    clean = redaction.redact(docs, "id", "text", names)
    assert clean.filter("text LIKE '%<PERSON>'").count() == 30 and clean.filter("text LIKE '%Quill%'").count() == 0
    rows = redaction.pii_spans(docs, "id", "text", names).collect()
    assert len(rows) == 30 and {r["value"] for r in rows} == {"Zed Quill"}
    assert all(r["end_at"] - r["start_at"] == 9 for r in rows)


def test_redaction_is_idempotent_and_complete(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = docs.select(pii.redact_patterns(F.col("text")).alias("once"))
    twice = once.select("once", pii.redact_patterns(F.col("once")).alias("twice"))
    assert twice.filter("once <> twice").count() == 0
    assert once.filter(F.size(pii.pattern_spans(F.col("once"))) > 0).count() == 0


def test_telephone_forms_and_small_letters(column):
    texts = ["415-555-0132, 415.555.0132; 020 7946 0958 +14155550132 ab123456c", "19.37.233.111 2024-01-02 1234567890"]
    assert column(pii.redact_patterns, texts) == [
        "<PHONE_NUMBER>, <PHONE_NUMBER>; <PHONE_NUMBER> <PHONE_NUMBER> <UK_NINO>", texts[1],
    ]


def test_whatever_is_listed_is_redacted(spark):
    from winnow.operators import redaction

    docs = spark.createDataFrame(
        [(1, "By John\nSmith."), (2, "New  York and John. Smith"), (3, "Johnny Smithson, york New"), (4, None), (5, "a.b John Smith Jones")],
        "id bigint, text string",
    )
    names = spark.createDataFrame([("John Smith", "PERSON"), ("Smith Jones", "PERSON"), ("New York", "LOCATION"), ("a.b", "PERSON")], "term string, entity_type string")
    clean = redaction.redact(docs, "id", "text", names)
    assert redaction.pii_spans(docs, "id", "text", names).count() == 5
    assert redaction.pii_spans(clean, "id", "text", names).count() == 0
    got = {r["id"]: r["text"] for r in clean.collect()}
    assert got == {1: "By <PERSON>.", 2: "<LOCATION> and <PERSON>", 3: "Johnny Smithson, york New", 4: None, 5: "<PERSON> <PERSON>"}


# --- replies and templates ----------------------------------------------------------
def test_strip_fence(column):
    raws = ['```json\n{"a":1}\n```', " {} ", "```x```", "plain", None]
    assert column(replies.strip_fence, raws) == ['{"a":1}', "{}", "x", "plain", ""]


def test_hashtag_line(column):
    assert column(replies.hashtag_line, [["#Tag ", " ", "a#b"], [], None], "array<string>") == ["#Tag #ab", "", ""]


def test_render_template_like_str_format(spark):
    template = '{{"k":"{years_exp}"}} {context_json} {{years_exp}}'
    rows = spark.createDataFrame([(template, 14, '{"a":{"years_exp":"{years_exp}"}}')], "t string, y int, c string")
    slots = {"years_exp": F.col("y"), "context_json": F.col("c")}
    got = rows.select(replies.render_template(F.col("t"), slots).alias("o")).first()["o"]
    assert got == template.format(years_exp=14, context_json='{"a":{"years_exp":"{years_exp}"}}')


def test_unknown_slot_is_an_error(spark):
    rows = spark.createDataFrame([("{nope}",)], "t string")
    with pytest.raises(Exception, match="no value for template slot"):
        rows.select(replies.render_template(F.col("t"), {})).collect()


def test_the_set_of_spaces_is_short_and_whole(column):
    assert t.SPACE.count("\\x") < 25
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    others = [chr(i) for i in range(1, 0x3100) if not chr(i).isspace()]
    assert all(column(lambda c: F.rlike(c, F.lit(f"^{t.SPACE}$")), spaces))
    assert not any(column(lambda c: F.rlike(c, F.lit(f"^{t.SPACE}$")), others))
