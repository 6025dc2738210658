"""Title, author, identifier and markup functions as Column expressions (no Python in tasks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx

_FOLD_FROM, _FOLD_TO = lx.latin_fold_table()


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def words(c) -> Column:
    """Whitespace-separated words; an empty array for a blank or missing text."""
    empty = F.array().cast("array<string>")
    return bound(squeeze(c), lambda t: F.when(t == "", empty).otherwise(F.split(t, " ")))


def word_count(c) -> Column:
    c = F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


def first_words(c, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


# ---------------------------------------------------------------- titles
def ascii_fold(c) -> Column:
    """Accents removed; every other non-ASCII character deleted."""
    return F.regexp_replace(F.translate(as_col(c), _FOLD_FROM, _FOLD_TO), r"[^\x00-\x7F]", "")


def title_words(c, stop_words=lx.STOP_WORDS) -> Column:
    plain = F.regexp_replace(F.lower(ascii_fold(text_or_empty(c))), r"[^a-z0-9\s]", " ")
    return F.filter(words(plain), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))


def normalise_title(c, stop_words=lx.STOP_WORDS) -> Column:
    return F.array_join(title_words(c, stop_words), " ")


def sorted_title(c, stop_words=lx.STOP_WORDS) -> Column:
    """Normalised title with its words in sorted order: the form word-order-free scores compare."""
    return F.array_join(F.array_sort(title_words(c, stop_words)), " ")


def normalise_unicode(c) -> Column:
    """Lower case, letters and digits of any script kept, the rest squeezed to single spaces."""
    return squeeze(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}\p{M}_\s]", " "))


def longest_words(c, n: int = 4) -> Column:
    """The n longest distinct words of a title; equal lengths in alphabetical order."""
    keyed = F.transform(
        F.array_distinct(title_words(c)), lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["w"])


def search_key(title, authors) -> Column:
    """First eight title words of three or more letters, then the first author's last word."""
    kept = F.slice(
        F.filter(title_words(title, lx.STOP_WORDS_SHORT), lambda w: F.length(w) > 2), 1, 8
    )
    last = F.try_element_at(words(F.split_part(text_or_empty(authors), F.lit(","), F.lit(1))), F.lit(-1))
    return F.concat_ws(" ", kept, last)


def slug_id(prefix: str, year, title) -> Column:
    slug = F.substring(F.regexp_replace(F.lower(text_or_empty(title)), "[^a-z0-9]", ""), 1, 40)
    return F.concat(F.lit(prefix + "_"), as_col(year).cast("string"), F.lit("_"), slug)


def dedupe_key(year, title) -> Column:
    return F.concat_ws(
        "|",
        as_col(year).cast("string"),
        F.regexp_replace(F.lower(text_or_empty(title)), "[^a-z0-9]", ""),
    )


# ---------------------------------------------------------------- authors
def surnames(c) -> Column:
    """Surnames of a ';' list holding 'Last, First' or 'First Last' names."""

    def last_name(name: Column) -> Column:
        picked = F.when(name.contains(","), F.split_part(name, F.lit(","), F.lit(1))).otherwise(
            F.element_at(F.split(F.trim(name), r"\s+"), -1)
        )
        return F.regexp_replace(F.lower(picked), "[^a-z]", "")

    return F.array_distinct(
        F.filter(F.transform(F.split(text_or_empty(c), ";"), last_name), lambda s: s != "")
    )


def surnames_any_separator(c) -> Column:
    """Last word of each ';' or ',' part, final dots dropped."""
    parts = F.transform(F.split(text_or_empty(c), "[;,]"), lambda p: F.trim(p))
    lasts = F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.regexp_replace(F.lower(F.element_at(F.split(p, r"\s+"), -1)), r"\.+$", ""),
    )
    return F.array_distinct(lasts)


def first_lastname(c) -> Column:
    """Last word before the first comma; empty where there is none."""
    head = words(F.split_part(text_or_empty(c), F.lit(","), F.lit(1)))
    return F.when(F.size(head) > 0, F.element_at(head, -1)).otherwise(F.lit(""))


def programme_surnames(c, most: int = 3) -> Column:
    """The first `most` surnames of programme author lines, which mix names and affiliations: the last words of
    comma-separated parts of up to four words that neither begin nor end with an affiliation word."""
    line = text_or_empty(c)
    for pattern, to in lx.PROGRAMME_CLEANUP:
        line = F.regexp_replace(line, pattern, to)
    parts = F.transform(F.split(squeeze(line), ","), lambda part: F.split(F.trim(part), " "))

    def surname(words: Column) -> Column:
        return F.regexp_replace(F.element_at(words, -1), r"\.+$", "")

    def is_name(words: Column) -> Column:
        last = surname(words)
        outside = ~words[0].isin(*lx.AFFILIATION_WORDS) & ~last.isin(*lx.AFFILIATION_WORDS)
        return (F.size(words) <= 4) & (words[0] != "") & outside & (F.length(last) >= 2) & ~last.rlike(r"[()]") & ~last.rlike(lx.ROMAN_OR_NUMBER)

    return F.slice(F.transform(F.filter(parts, is_name), surname), 1, most)


def mentions_any(names, text) -> Column:
    """Any of the names inside the text; true where no name is known."""
    found = bound(
        F.lower(text_or_empty(text)), lambda t: F.exists(as_col(names), lambda s: t.contains(F.lower(s)))
    )
    return (F.size(as_col(names)) == 0) | found


def shares_surname(a, b) -> Column:
    """At least one shared surname; passes where either side is unknown."""
    a, b = as_col(a), as_col(b)
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def shares_half_surnames(query, candidate) -> Column:
    """Half of the smaller set shared; fails where only the candidate's authors are unknown."""
    q, c = as_col(query), as_col(candidate)
    share = F.size(F.array_intersect(q, c)) / F.least(F.size(q), F.size(c))
    return F.when(F.size(q) == 0, F.lit(True)).when(F.size(c) == 0, F.lit(False)).otherwise(share >= 0.5)


def author_count_semicolon(c) -> Column:
    return F.when(F.trim(as_col(c)) != "", F.size(F.split(as_col(c), ";")))


def author_count_comma(c) -> Column:
    return F.greatest(F.size(F.split(text_or_empty(c), ",")), F.lit(1))


# ---------------------------------------------------------------- identifiers and dates
def _nonblank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def paper_id_from_text(c) -> Column:
    """Working-paper id inside a URL or DOI."""
    return _nonblank(F.lower(F.regexp_extract(text_or_empty(c), lx.PAPER_ID_PATTERN, 1)))


def paper_id_from_url(c) -> Column:
    """Id of a '/papers/w123' path, else the last path part."""
    hit = _nonblank(F.regexp_extract(text_or_empty(c), r"/papers/(w\d+)", 1))
    return F.coalesce(hit, F.element_at(F.split(text_or_empty(c), "/"), -1))


def id_digits(c) -> Column:
    return F.regexp_replace(text_or_empty(c), "[^0-9]", "").try_cast("bigint")


def doi_clean(c) -> Column:
    return F.regexp_replace(text_or_empty(c), "^https://doi\\.org/", "")


def doi_in_text(c) -> Column:
    hit = F.regexp_extract(text_or_empty(c), "(10\\.\\d{4,}/[^\\s\"'<>]+)", 1)
    return _nonblank(F.regexp_replace(hit, r"[.,)]+$", ""))


def preprint_id_from_doi(c) -> Column:
    return _nonblank(F.regexp_extract(text_or_empty(c), r"(?i)^10\.2139/ssrn\.(\d+)", 1))


def display_year(c) -> Column:
    """Last four-digit word of 'January 2012'."""
    hits = F.filter(words(c), lambda w: w.rlike("^[0-9]{4}$"))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1).cast("int"))


def display_month(c) -> Column:
    months = F.array(*[F.lit(m) for m in lx.MONTHS])
    hits = F.filter(words(F.lower(text_or_empty(c))), lambda w: w.isin(*lx.MONTHS))
    return F.when(F.size(hits) > 0, F.array_position(months, F.element_at(hits, -1)).cast("int"))


# ---------------------------------------------------------------- markup and nested records
def strip_tags(c) -> Column:
    return squeeze(F.regexp_replace(text_or_empty(c), "<[^>]+>", " "))


def clean_abstract(c) -> Column:
    return F.regexp_replace(strip_tags(c), r"(?i)^abstract\s*[:.]?\s*", "")


def unescape_html(c) -> Column:
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
        ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def inverted_index_text(index) -> Column:
    """Text of a {word: [positions]} map, words in position order."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(as_col(index)),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))),
        )
    )
    return F.coalesce(
        F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " "), F.lit("")
    )


def author_names(authorships) -> Column:
    names = F.transform(as_col(authorships), lambda a: a["author"]["display_name"])
    return F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), "; ")


def affiliation_names(authorships) -> Column:
    """Distinct affiliations in order of first mention."""
    per_author = F.transform(
        as_col(authorships),
        lambda a: F.coalesce(
            F.transform(a["institutions"], lambda i: i["display_name"]),
            F.array().cast("array<string>"),
        ),
    )
    flat = F.filter(F.flatten(per_author), lambda n: n.isNotNull() & (n != ""))
    return F.array_join(F.array_distinct(flat), "; ")


def first_affiliation(authorships) -> Column:
    first = F.get(as_col(authorships), F.lit(0))
    inst = F.get(first["institutions"], F.lit(0))["display_name"]
    return F.coalesce(inst, first["raw_affiliation_string"], F.lit(""))


# ---------------------------------------------------------------- page text
def is_mirrored(c) -> Column:
    head = F.substring(text_or_empty(c), 1, 3000)
    return F.regexp_count(head, F.lit(lx.MIRRORED_WORDS)) > F.regexp_count(head, F.lit(lx.FORWARD_WORDS))


def unmirror(c) -> Column:
    """Each line reversed where the text reads right to left."""
    fixed = F.array_join(F.transform(F.split(as_col(c), "\n"), F.reverse), "\n")
    return F.when(is_mirrored(c), fixed).otherwise(as_col(c))


def table_score(c, with_stars: bool = True, pattern: str = lx.PAREN_DECIMAL) -> Column:
    """Regression-table signal of a page: decimals in parentheses per line, counted four times
    on lines with two or more, plus runs of significance stars."""

    def line_score(line: Column) -> Column:
        n = F.regexp_count(line, F.lit(pattern))
        return F.when(n >= 2, n * 4).otherwise(n)

    score = F.aggregate(
        F.transform(F.split(text_or_empty(c), "\n"), line_score), F.lit(0), lambda a, x: a + x
    )
    return score + F.regexp_count(text_or_empty(c), F.lit(lx.STAR_RUN)) if with_stars else score


def bracket_count(c) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(lx.BRACKET_DECIMAL))


def abstract_block(c, least: int = 80, most: int | None = None) -> Column:
    """Abstract inside document text, of `least` to `most` characters: up to a section word, else up to the keywords;
    without `most` of any length."""
    t = squeeze(c)
    body = lx.ABSTRACT_START + f"(.{{{least},{'' if most is None else most}}}?)"
    first = _nonblank(F.regexp_extract(t, body + lx.ABSTRACT_SECTION_END, 1))
    return F.trim(F.coalesce(first, F.regexp_extract(t, body + lx.ABSTRACT_KEYWORD_END, 1), F.lit("")))


def chunk_table(df, text_col: str, size: int = 20000, overlap: int = 2000):
    """One row per overlapping character chunk; the chunks together cover the whole text."""
    step = size - overlap
    last = F.greatest(F.length(text_col) - overlap - 1, F.lit(0))
    return (
        df.withColumn("start", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
        .withColumn("chunk_no", (F.col("start") / step).cast("int"))
        .withColumn("chunk", F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)))
        .drop("start", text_col)
    )
