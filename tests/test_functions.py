import hashlib
import json
import unicodedata

from pyspark.sql import functions as F

from marginalia.functions import dates, identity, numbers, text


def test_encoding_and_invisible(evaluate):
    value = "“Curly” ‘q’\r\nnext\rＦｕｌｌ ﬁ​\x07\tend"
    assert evaluate(text.strip_invisible(text.normalize_encoding("x")), value) == [
        "\"Curly\" 'q'\nnext\nFull fi\tend"]


def test_nfkc_quick_check_is_exact(evaluate):
    # every character of the lower planes, alone and before a combining mark
    samples = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    samples += [c + "́" for c in samples[:600]]
    assert evaluate(text.nfkc("x"), *samples) == [unicodedata.normalize("NFKC", s) for s in samples]


def test_junk_sections(evaluate):
    clean = evaluate(text.clean_text("x"),
                     "Intro line.......... 12\nTable of Contents\n(c) 2020 Someone\nBody stays.",
                     "Long body text that matters a lot.\n\n## References\n[1] Paper",
                     "References\nThis must not wipe the document.",
                     "# Title\nText\n- one\n- two\nwrapped\nline",
                     "exam-\nple of  hyphen")
    assert clean[0] == "Body stays."
    assert clean[1] == "Long body text that matters a lot."
    assert clean[2] == "References This must not wipe the document."
    assert clean[3] == "# Title\n\nText\n- one\n- two wrapped line"
    assert clean[4] == "example of hyphen"


def test_last_references_heading_counts(evaluate):
    value = "a" * 50 + "\nReferences\n" + "b" * 50 + "\n\n\nBibliography\ntail"
    assert evaluate(text.last_references_start("x"), value, "no heading") == [50 + 12 + 50 + 1, None]


def test_sentences_words_paragraphs(evaluate):
    assert evaluate(text.sentences("x"), 'One. Two! "Three?" four. (Five) 6') == [
        ["One.", "Two!", '"Three?" four.', "(Five) 6"]]
    assert evaluate(text.word_count("x"), "  a  b\nc ", "") == [3, 0]
    assert evaluate(text.paragraphs("x"), "a\n \n b\n\n\nc") == [["a", "b", "c"]]


def test_junk(evaluate):
    assert evaluate(text.is_junk("x"), "### *** $$$", "https://a.example/b", "123 456 789",
                    "Real sentence here.", "") == [True, True, True, False, True]


def test_headings(evaluate):
    assert evaluate(text.heading_text("x"), "# Deep Title #", "Rise of the Machines", "short words here",
                    "Ends With Stop.", "A B\nC", "of the and", "###",
                    "One Two Three Four Five Six Seven Eight Nine") == [
        "Deep Title #", "Rise of the Machines", None, None, None, None, None, None]


def test_keys(evaluate):
    assert evaluate(text.name_key("x"), "GPT-4", "Straße_1", " ΣΑΣ ") == ["gpt 4", "strasse_1", "σασ"]
    assert evaluate(text.fold_key("x"), "GPT-4", "A_b c") == ["gpt4", "abc"]
    assert evaluate(text.spaced_key("x"), "Héllo, Wörld!") == ["héllo wörld"]


def test_mentions(evaluate):
    assert evaluate(text.mentioned(F.lit("Atlas"), F.col("x")), "about Atlassian", "the atlas.") == [False, True]
    assert evaluate(text.mentioned(F.lit("GPT-4"), F.col("x")), "is gpt4 good", "gpt 45") == [True, False]
    assert evaluate(text.mentioned(F.lit("--"), F.col("x")), "anything") == [False]


def test_guessed_entities(evaluate):
    assert evaluate(text.guess_entities("x"), "What is Sam Altman's role at OpenAI?",
                    "Tell me about gpt-4 and GPT-4", "nothing here") == [
        ["Sam Altman", "OpenAI"], ["gpt-4"], []]


def test_question_normaliser(evaluate):
    assert evaluate(text.normalize_question("x"), " who​ is\t “X” \n ") == ['who is "X"']
    assert evaluate(F.length(text.normalize_question("x")), "a" * 3000) == [2000]


def test_sanitizer(evaluate):
    out = evaluate(text.sanitize_query("x"),
                   'mail bob.x@mail.example or see https://x.y/z id 123456789 "quoted" `c`',
                   " ".join(f"w{i}" for i in range(50)))
    assert out[0] == "mail or see id quoted c"
    assert out[1].split() == [f"w{i}" for i in range(12)]


def test_tokens_and_ngrams(evaluate):
    assert evaluate(text.search_tokens("x"), "Who is The Atlas atlas x_1") == [["atlas", "x_1"]]
    assert evaluate(text.ngrams(text.tokens("x"), 2), "a b a b", "a") == [["a b", "b a"], []]


def test_captions_and_lines(evaluate):
    assert evaluate(text.caption("x"), "**Table 3: Prices**", "Table 2", "table 1a - x", "A table 1: y") == [
        "Table 3: Prices", None, "table 1a - x", None]
    assert evaluate(text.line_key("x"), " 12 ", "Report Page 3 of 9", "Head") == ["#", "report page #", "head"]


def test_json_markup_and_scores(evaluate):
    assert evaluate(text.json_object_text("x"), 'Sure:\n```json\n{"a": {"b": 1}}\n```', "none") == [
        '{"a": {"b": 1}}', None]
    assert evaluate(text.escape_markup("x"), "a<b & c") == ["a&lt;b &amp; c"]
    assert evaluate(text.similarity_score(F.col("x").cast("double")), "0.25", "-1", "3", "nan") == [.75, 1, 0, 0]
    assert evaluate(text.inline_citations("x"), "a [E1] b [F2][E1] [x]") == [["E1", "F2"]]


def test_timestamps(evaluate):
    got = evaluate(text.aware_timestamp("x").isNotNull(), "2024-01-02T03:04:05Z",
                   "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "nonsense", None)
    assert got == [True, True, False, False, False]


def test_render_evidence(evaluate):
    block = text.render_evidence(F.lit("E1"), F.lit("chunk"), F.col("x"), doc_id=F.lit("d<"))
    assert evaluate(block, "a & b") == ['<evidence id="E1" kind="chunk" doc="d&lt;">\na &amp; b\n</evidence>']
    assert evaluate(text.truncate("x", 3), "abcdef") == ["abc ...[truncated]"]


def test_dates(evaluate):
    shown = F.transform(dates.extract_dates("x"), dates.format_date)
    assert evaluate(shown, "On 14 March 2021, in September 2022 and 2024.", "31 February 2023", "2023-13-45",
                    "Sept. 5th, 2020 then 2020-05-06", "March 2021-03-14", "in 1499 or 2100", "May 2001") == [
        ["2021-3-14", "2022-9", "2024"], [], [], ["2020-9-5", "2020-5-6"], ["2021-3-14"], [], ["2001-5"]]


def test_date_order(spark):
    def d(y, m=None, day=None):
        return F.struct(F.lit(y).cast("int").alias("year"), F.lit(m).cast("int").alias("month"),
                        F.lit(day).cast("int").alias("day"))
    row = spark.range(1).select(
        dates.compare_dates(d(2021, 3, 14), d(2022, 9)).alias("a"),
        dates.compare_dates(d(2021), d(2021, 3)).alias("b"),
        dates.compare_dates(d(2021), d(2021)).alias("c"),
        dates.compare_dates(d(2023, 2), d(2022, 12, 31)).alias("d"),
        dates.date_supported(d(2023), F.array(d(2023, 3, 14))).alias("e"),
        dates.date_supported(d(2023, 3, 14), F.array(d(2023))).alias("f"),
        dates.high(d(2024, 2)).cast("string").alias("g")).first()
    assert tuple(row) == ("before", "overlap", "same", "after", True, False, "2024-02-29")


def test_numbers(evaluate):
    assert evaluate(numbers.parse_number("x"), "1,200", "1.5 million", "2B", "40%", "12 km", "1.2.3", "-3") == [
        1200.0, 1.5e6, 2e9, 40.0, None, None, -3.0]
    assert evaluate(numbers.extract_numbers("x"), "GPT-4 launched on 14 March 2023 [E1]",
                    "1,500,000 users, 1.5 million, 40%", "v1.2 x3") == [[4.0], [1.5e6, 1.5e6, 40.0], []]
    assert evaluate(numbers.extract_numbers("x", False), "in 2023") == [[2023.0]]


def test_identity_matches_json(evaluate):
    for value in ("Atlas", "Straße \"q\" \\ \n\t", "日本 😀"):
        expected = hashlib.sha256(json.dumps(["Person", value], sort_keys=True).encode()).hexdigest()
        assert evaluate(identity.identity(F.lit("Person"), F.col("x")), value) == [expected]
        note = json.dumps(["document", "d", 3, "h", value, None], ensure_ascii=False)
        assert evaluate(identity.note_id(F.lit("document"), F.lit("d"), F.lit(3), F.lit("h"), F.col("x"),
                                         F.lit(None).cast("string")), value) == [
            hashlib.sha256(note.encode()).hexdigest()]


def test_patterns_run_once_for_a_date_and_a_number(spark):
    """A pattern written into several branches of a lambda runs in each of them."""
    def patterns(column):
        plan = spark.range(1).select(column(F.col("id").cast("string")).alias("y"))._jdf.queryExecution().analyzed().toString()
        return plan.count("regexp_extract(") + plan.count("RLIKE(")
    assert patterns(dates.extract_dates) == 2 and patterns(numbers.extract_numbers) == 2
    assert patterns(numbers.parse_number) == 2


def test_first_characters_of_dates(evaluate):
    found = evaluate(F.array_join(F.transform(dates.extract_dates("x"), dates.format_date), "|"),
                     "SEPT. 3rd, 2021; ſept 2020; xMay 2019; 7may 2018; 12 Jan 1999-01-02; 1999", "2023-02-31 or 31 February 2023, dec 2022")
    assert found == ["2021-9-3|2020|2019|2018|1999-1-2|1999", "2022-12"]
