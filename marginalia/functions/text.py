"""Text cleaning and tokenising as column expressions.

Everything is evaluated in the JVM.  The single Python function is Unicode
compatibility normalisation, which Spark lacks; it is fed nulls for rows that a
cheap regular expression proves unaffected, so ordinary text never crosses Arrow.

Character classes follow Unicode letters and numbers, spelled out, because the
short forms of the Java engine are ASCII by default and treat combining marks
differently when widened.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .. import config

WORD = r"\p{L}\p{N}_"
_LINES = "(?dm)"          # only \n ends a line
_EDGE_BLANKS = " \t\n"

# --- fixed values: patterns that decide what is kept -------------------------
SENTENCE_BREAK = r"""(?U)(?<=[.!?])\s+(?=[A-Z0-9"'(\[])"""
URL = r"https?://\S+|www\.\S+"
CITATION = r"\[([A-Za-z]\d+)\]"
CONTENTS_LINE = r"(?dmU)^.*\.{4,}\s*\d+\s*$"
CONTENTS_TITLE = r"(?dmUi)^\s*(table of contents|contents)\s*$"
RIGHTS_LINE = r"(?dmUi)^.*(©|\(c\)\s*\d{4}|all rights reserved).*$"
LIST_MARKER = r"[ \t]*(?:[-*+•][ \t]|\d{1,2}[.)][ \t])"
PAGE_NUMBER = r"(?Ui)^\s*(page\s*)?\d+(\s*(of|/)\s*\d+)?\s*$"
PAGE_PHRASE = r"(?Ui)\bpage\s*\d+(\s*(of|/)\s*\d+)?"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
LONG_NUMBER = r"(?U)\b\d{6,}\b"
ENTITY_RUN = (r"(?U)\b(?:[A-Z][\w.\-]*|[A-Za-z]+-\d+[\w\-]*)"
              r"(?:\s+(?:[A-Z][\w.\-]*|[A-Za-z]+-\d+[\w\-]*))*")
TABLE_CAPTION = r"^\s*\**\s*(table\s+\d+[a-z]?\s*[:.\-–].*?)\**\s*$"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_RULE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"
# --- end of fixed values -----------------------------------------------------

_CONNECTOR = "(?i:" + "|".join(config.HEADING_CONNECTORS) + r")(?!\S)"
# ``++`` is a loop in the Java engine, where ``+`` over a group takes stack for every connector; there is one way to match.
_PLAIN_TITLE = (rf"(?U)\A(?!(?:{_CONNECTOR}\s*)++\z)(?!.*[.!?:;,]\z)"
                rf"(?:(?:{_CONNECTOR}|\p{{Lu}}\S*)(?:\s+|\z)){{1,{config.HEADING_MAX_WORDS}}}\z")

#: Characters that compatibility normalisation may change, alone or in sequence.  Written
#: as ranges to look for: a negated class is an order of magnitude slower to scan with.
_DOUBTFUL = (r"[\x{A0}\x{A8}\x{AA}\x{AF}\x{B2}-\x{B5}\x{B8}-\x{BA}\x{BC}-\x{BE}\x{100}-\x{2012}"
             r"\x{2015}-\x{2017}\x{201A}\x{201B}\x{201E}-\x{2021}\x{2023}-\x{20AB}\x{20AD}-\x{10FFFF}]")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value, body) -> Column:
    """``body(value)`` with the value evaluated once.  Below a lambda nothing is shared: every mention is evaluated again."""
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def nfkc(text) -> Column:
    text = _col(text)
    doubtful = F.when(text.rlike(_DOUBTFUL), text)
    return F.coalesce(_nfkc(doubtful), text)


def straight_quotes(text) -> Column:
    return F.translate(_col(text), "‘’“”", "''\"\"")


def normalize_encoding(text) -> Column:
    """One newline style, compatibility form, straight quotes."""
    unix = F.regexp_replace(_col(text), r"\r\n?", "\n")
    return straight_quotes(nfkc(unix))


def strip_invisible(text) -> Column:
    return F.regexp_replace(_col(text), r"[\p{Cf}]|[\p{Cc}&&[^\n\t]]", "")


def strip(text) -> Column:
    return F.regexp_replace(_col(text), r"(?U)\A\s+|\s+\z", "")


def last_references_start(text) -> Column:
    """0-based offset where the last reference heading begins, null when there is none."""
    text = _col(text)
    before = F.regexp_extract(
        text, r"(?is)(?dU)\A(|.*\n)[^\S\n]*#*\s*(?:references|bibliography)[^\S\n]*(?:\n.*)?\z", 1)
    found = text.rlike(r"(?i)(?dUm)^[^\S\n]*#*\s*(?:references|bibliography)[^\S\n]*$")
    # a heading owns the blank or '#' lines directly above it
    own = F.length(F.regexp_replace(before, r"(?dU)(^|\n)\s*#*\s*\z", "$1"))
    return F.when(found, own)


def drop_junk_sections(text, cut_references: bool = True) -> Column:
    text = _col(text)
    for pattern in (CONTENTS_LINE, CONTENTS_TITLE, RIGHTS_LINE):
        text = F.regexp_replace(text, pattern, "")
    if not cut_references:
        return text

    def cut(t):
        start = last_references_start(t)
        far_enough = start > F.length(t) * config.REFERENCES_MIN_POSITION
        return F.when(F.coalesce(far_enough, F.lit(False)), F.substr(t, F.lit(1), start)).otherwise(t)
    return bound(text, cut)


def isolate_headings(text) -> Column:
    return F.regexp_replace(_col(text), _LINES + r"^(#{1,6}[ \t]+.+)$", "\n$1\n")


def fix_broken_lines(text) -> Column:
    # What a match begins with comes first, the look behind after it: the other order looks behind every character.
    joined = F.regexp_replace(_col(text), rf"-\n(?<=[{WORD}]-\n)(?=[a-z])", "")
    return F.regexp_replace(joined, rf"\n(?<!\n\n)(?!\n)(?!{LIST_MARKER})", " ")


def collapse_whitespace(text) -> Column:
    text = F.regexp_replace(_col(text), r"[ \t]{2,}|\t", " ")
    text = F.regexp_replace(text, r" \n ?|\n ", "\n")        # single blanks are left by now
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.btrim(text, F.lit(_EDGE_BLANKS))


def tidy(text, cut_references: bool = True) -> Column:
    """The cleaning steps that follow encoding repair."""
    return collapse_whitespace(fix_broken_lines(isolate_headings(
        drop_junk_sections(text, cut_references))))


def clean_text(text, cut_references: bool = True) -> Column:
    return tidy(strip_invisible(normalize_encoding(text)), cut_references)


def lost_most(original, cleaned) -> Column:
    """True when cleaning removed more than the warning share of a document."""
    size = F.length(strip(original))
    return (size > 0) & (F.length(_col(cleaned)) < size * (1 - config.CLEANING_LOSS_WARNING))


def words(text) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text) -> Column:
    return F.size(words(text))


def paragraphs(text) -> Column:
    """Blocks separated by a blank line, without surrounding white space."""
    return F.array_remove(F.split(strip(text), r"(?U)\s*\n\s*\n\s*"), "")


def sentences(text) -> Column:
    return F.array_remove(F.split(strip(text), SENTENCE_BREAK), "")


def is_junk(text) -> Column:
    """Mostly symbols or digits once links are gone."""
    def mostly_symbols(visible):
        letters = F.length(F.regexp_replace(visible, r"[^\p{L}]+", ""))
        return (visible == "") | (letters / F.length(visible) < config.MIN_ALPHA_RATIO)
    text = _col(text)
    unlinked = F.when(text.contains("http") | text.contains("www."), F.regexp_replace(text, URL, "")).otherwise(text)
    return bound(F.regexp_replace(unlinked, r"(?U)\s+", ""), mostly_symbols)


def heading_text(paragraph) -> Column:
    """Title carried by a paragraph, null when it is ordinary evidence.

    A plain title has few words, no closing punctuation, and a capital on every word
    that is not a connector; one pattern checks all of it.
    """
    return bound(strip(paragraph), title_of)


def title_of(line) -> Column:
    """``heading_text`` of a line without surrounding white space."""
    # Most evidence is told by its last character; the pattern reads to the end of a line only, and these end one.
    closed = F.right(line, F.lit(1)).isin(*".!?:;,")
    for mark in "\r\x85\u2028\u2029":
        closed = closed & ~line.contains(mark)
    return (F.when(line.contains("\n"), F.lit(None).cast("string"))
            .when(line.startswith("#"), bound(strip(F.regexp_replace(line, "^#+", "")), lambda t: F.nullif(t, F.lit(""))))
            .when(~closed & line.rlike(_PLAIN_TITLE), line))


def marked_heading(line) -> Column:
    """Title of a ``#`` line; other lines never count."""
    line = strip(line)
    return F.when(line.startswith("#"), F.nullif(strip(F.regexp_replace(line, "^#+", "")), F.lit("")))


def casefold(text) -> Column:
    """Caseless form: lower(upper(x)) expands sharp s and ligatures like full case folding.

    The replacement in the middle also keeps the optimizer from dropping ``upper``.
    """
    shouted = F.replace(F.upper(_col(text)), F.lit("ẞ"), F.lit("SS"))
    return F.translate(F.lower(shouted), "ς", "σ")


def spaced_key(text, fold=F.lower) -> Column:
    """Runs of non-word characters become one blank."""
    return F.btrim(F.regexp_replace(fold(_col(text)), rf"[^{WORD}]+", " "))


def name_key(name) -> Column:
    """Key under which the graph stores a name."""
    return spaced_key(name, casefold)


def fold_key(name) -> Column:
    """Key under which retrieval compares names: letters and digits only."""
    return F.regexp_replace(casefold(name), r"[^\p{L}\p{N}]", "")


def normalize_question(text, limit: int = config.MAX_QUESTION_CHARS) -> Column:
    text = straight_quotes(nfkc(text))
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]", " ")
    text = F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]", "")
    text = F.btrim(F.regexp_replace(text, " {2,}", " "))
    return F.btrim(F.left(text, F.lit(limit)))


def has_alnum(text) -> Column:
    return _col(text).rlike(r"[\p{L}\p{N}]")


def mention_pattern(entity) -> Column:
    """Regular expression that finds a name whatever separates its characters."""
    body = F.array_join(F.filter(F.split(fold_key(entity), ""), lambda c: c != ""),
                        rf"[^\p{{L}}\p{{N}}]*")
    return F.concat(F.lit(rf"(?<![{WORD}])"), body, F.lit(rf"(?![{WORD}])"))


def mentioned(entity, *texts) -> Column:
    pattern = mention_pattern(entity)
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.regexp_like(casefold(text), pattern)
    return (fold_key(entity) != "") & F.coalesce(hit, F.lit(False))


def first_by(items, key) -> Column:
    """Keep the first element for every key, in order."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def guess_entities(question) -> Column:
    """Runs of capitalised or hyphen-number tokens without surrounding question words."""
    runs = F.regexp_extract_all(_col(question), F.lit(ENTITY_RUN), F.lit(0))

    def trimmed(run):
        parts = F.transform(F.split(run, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(".,;:?!")))
        keep = F.transform(parts, lambda w: ~casefold(w).isin(*config.QUESTION_STOPWORDS))
        first = F.array_position(keep, True)
        last = F.size(parts) + 1 - F.array_position(F.reverse(keep), True)
        inner = F.when(first > 0, F.slice(parts, first.cast("int"), (last - first + 1).cast("int")))
        return F.array_join(F.filter(F.coalesce(inner, F.array().cast("array<string>")),
                                     lambda w: w != ""), " ")

    names = F.filter(F.transform(runs, trimmed), lambda n: n != "")
    return F.slice(first_by(names, casefold), 1, config.MAX_TARGET_ENTITIES)


def sanitize_query(text, max_words: int = config.SANITIZED_WORDS) -> Column:
    """Remove links, addresses, long numbers and quotes; keep the first words."""
    text = F.regexp_replace(_col(text), "(?i)" + URL, " ")
    text = F.regexp_replace(text, EMAIL, " ")
    text = F.regexp_replace(text, LONG_NUMBER, " ")
    text = F.regexp_replace(text, "[\"`“”]", " ")
    return F.array_join(F.slice(words(text), 1, max_words), " ")


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(rf"[{WORD}]+"), F.lit(0))


def search_tokens(text) -> Column:
    """Distinct caseless tokens without stop words."""
    found = F.regexp_extract_all(casefold(text), F.lit(rf"[{WORD}]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, config.SEARCH_STOPWORDS)))


def ngrams(token_array, n: int = config.LEAK_NGRAM) -> Column:
    """Distinct runs of n tokens, joined by blanks."""
    count = F.size(token_array) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                       lambda i: F.array_join(F.slice(token_array, i, n), " "))
    return F.when(count > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def escape_markup(text) -> Column:
    return F.replace(F.replace(_col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def truncate(text, limit: int = config.MAX_ITEM_CHARS) -> Column:
    text = _col(text)
    return F.when(F.length(text) > limit,
                  F.concat(F.left(text, F.lit(limit)), F.lit(" ...[truncated]"))).otherwise(text)


def render_evidence(evidence_id, kind, text, doc_id=None, doc_date=None, url=None,
                    retrieved_at=None, limit: int = config.MAX_ITEM_CHARS) -> Column:
    def attribute(name, value):
        if value is None:
            return F.lit("")
        value = _col(value)
        shown = F.concat(F.lit(f' {name}="'), escape_markup(value), F.lit('"'))
        return F.when(F.coalesce(value, F.lit("")) != "", shown).otherwise("")

    return F.concat(F.lit('<evidence id="'), _col(evidence_id), F.lit('" kind="'), _col(kind), F.lit('"'),
                    attribute("doc", doc_id), attribute("date", doc_date), attribute("url", url),
                    attribute("retrieved_at", retrieved_at), F.lit(">\n"),
                    escape_markup(truncate(text, limit)), F.lit("\n</evidence>"))


def json_object_text(reply) -> Column:
    """The outermost object inside a model reply, with fences and prose removed."""
    return F.nullif(F.regexp_extract(_col(reply), r"(?s)\{.*\}", 0), F.lit(""))


def fact_text(subject, relation, obj) -> Column:
    return F.format_string("(%s) -[%s]-> (%s)", _col(subject), _col(relation), _col(obj))


def inline_citations(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(CITATION), F.lit(1)))


def aware_timestamp(text) -> Column:
    """ISO timestamp, null unless it carries an offset."""
    text = _col(text)
    return F.when(text.rlike(r"[T ]\d{2}(:?\d{2}){0,2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"),
                  F.try_to_timestamp(text))


def bad_timestamp(text) -> Column:
    """True for text that is present but not an offset-carrying ISO timestamp."""
    text = _col(text)
    return text.isNotNull() & aware_timestamp(text).isNull()


def similarity_score(distance) -> Column:
    """Cosine distance to a score between 0 and 1; anything unusable scores 0."""
    score = F.lit(1.0) - _col(distance).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))))


def clean_metadata(metadata) -> Column:
    """Drop null entries of a string map; null when the required document id is absent."""
    kept = F.map_filter(_col(metadata), lambda k, v: v.isNotNull())
    return F.when(F.trim(F.element_at(kept, "doc_id")) != "", kept)


def clean_or_null(text) -> Column:
    return F.nullif(strip(text), F.lit(""))


def line_key(line) -> Column:
    """Form under which page headers and footers repeat."""
    key = F.regexp_replace(F.lower(strip(line)), PAGE_PHRASE, "page #")
    return F.when(key.rlike(r"^\p{Nd}+\z"), F.lit("#")).otherwise(key)


def caption(line) -> Column:
    """Table caption carried by a line, null when it is not one."""
    found = F.regexp_extract(
        _col(line), r"(?Ui)^\s*\**\s*(table\s+\d+[a-z]?\s*[:.\-–].*?)\**\s*\z", 1)
    return F.when(word_count(line) <= config.CAPTION_MAX_WORDS, F.nullif(strip(found), F.lit("")))
