"""Programme pages to (session, title, authors) rows.

A page is cut at its block tags with string functions alone: open tags become marks, so unclosed
or badly nested markup needs no tree. All of it stays inside the row until the final explode, so
parsing never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import rules as ru
from verdigris.functions import text as tx

MARK, END = "\u0001", "\u0002"


def _visible(html) -> Column:
    c = tx.text_or_empty(html)
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return F.regexp_replace(c, r"(?s)<!--.*?-->", " ")


def tag_stream(html, tags: list[str]) -> Column:
    """Array of (tag, text) for the given block tags in page order. A tag's text runs to the next
    block mark, opening or closing."""
    names = "|".join(tags)
    cut = F.regexp_replace(
        _visible(html), rf"(?i)<(/?(?:{names}|article|footer|div|body))\b[^>]*>", f"{MARK}$1{END}"
    )
    parts = F.slice(F.split(cut, MARK), 2, 1_000_000_000)
    return F.filter(
        F.transform(
            parts,
            lambda p: F.struct(
                F.lower(F.split_part(p, F.lit(END), F.lit(1))).alias("tag"),
                tx.squeeze(tx.unescape_html(tx.strip_tags(F.split_part(p, F.lit(END), F.lit(2))))).alias("text"),
            ),
        ),
        lambda s: s["tag"].isin(*tags),
    )


def _sections(stream: Column, heads: list[str]) -> Column:
    """Stream cut before every head tag: array of sub-arrays, the first without a head."""

    def cut_at(st: Column, bounds: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(bounds) - 1),
            lambda k: F.slice(
                st,
                F.element_at(bounds, k) + 1,
                F.greatest(F.element_at(bounds, k + 1) - F.element_at(bounds, k), F.lit(0)),
            ),
        )

    def starts(st: Column) -> Column:
        spots = F.transform(st, lambda s, i: F.when(s["tag"].isin(*heads), i))
        return F.concat(F.array(F.lit(0)), F.filter(spots, lambda i: i.isNotNull()), F.array(F.size(st)))

    return tx.bound(stream, lambda st: tx.bound(starts(st), lambda b: cut_at(st, b)))


def heading_layout(
    df: DataFrame, page_id: str, html: str, session_tags: list[str], title_tag: str, author_tag: str = "p",
    stop_tags: tuple[str, ...] = (), min_title: int = 5,
) -> DataFrame:
    """Title headings, each followed by its author paragraph, under session headings."""
    tags = list(dict.fromkeys([*session_tags, title_tag, author_tag, *stop_tags]))
    stream = F.filter(
        tag_stream(html, tags), lambda s: (s["text"] != "") | s["tag"].isin(*(stop_tags or ("",)))
    )
    by_session = df.select(page_id, F.posexplode(_sections(stream, session_tags)).alias("s_no", "sec"))
    head = F.get("sec", F.lit(0))
    session = F.when(head["tag"].isin(*session_tags), head["text"]).otherwise(F.lit(""))
    by_title = by_session.select(
        page_id, "s_no", session.alias("session"),
        F.posexplode(_sections(F.col("sec"), [title_tag])).alias("t_no", "blk"),
    ).filter(F.get("blk", F.lit(0))["tag"] == title_tag)
    stop = F.array_position(F.transform("blk", lambda s: s["tag"].isin(*(stop_tags or ("",)))), True)
    reach = F.when(stop > 0, F.slice("blk", 1, (stop - 1).cast("int"))).otherwise(F.col("blk"))
    first_par = F.get(F.filter(reach, lambda s: s["tag"] == author_tag), F.lit(0))["text"]
    authors = F.when(ru.is_skip_line(first_par), F.lit("")).otherwise(F.coalesce(first_par, F.lit("")))
    return by_title.select(
        page_id, "s_no", "t_no", "session",
        F.get("blk", F.lit(0))["text"].alias("title"),
        authors.alias("authors"),
    ).filter(F.length("title") >= min_title)


def dashed_layout(
    df: DataFrame, page_id: str, html: str, session_tags: list[str], par_tag: str = "p",
    dash: str = r"\s*[–—]\s*", joiner: str = " – ",
) -> DataFrame:
    """One paragraph per paper: the title after the last dash, the authors before it."""
    stream = F.filter(tag_stream(html, [*session_tags, par_tag]), lambda s: s["text"] != "")
    rows = df.select(page_id, F.posexplode(_sections(stream, session_tags)).alias("s_no", "sec"))
    head = F.get("sec", F.lit(0))
    session = F.when(head["tag"].isin(*session_tags), head["text"]).otherwise(F.lit(""))
    rows = rows.select(
        page_id, "s_no", session.alias("session"), F.posexplode("sec").alias("t_no", "s")
    ).filter(F.col("s.tag") == par_tag)
    parts = F.split("s.text", dash)
    title = F.trim(F.element_at(parts, -1))
    return (
        rows.filter((F.size(parts) > 1) & ~ru.is_skip_line("s.text"))
        .select(
            page_id, "s_no", "t_no", "session", title.alias("title"),
            F.array_join(F.slice(parts, 1, F.size(parts) - 1), joiner).alias("authors"),
        )
        .filter((tx.word_count("title") >= 2) & ~ru.looks_like_institution("title"))
        .filter(F.length("title") > 8)
    )


def paragraph_layout(
    df: DataFrame, page_id: str, html: str, par_tag: str = "p", institution=ru.looks_like_institution,
    session_pattern: str = r"(?i)^(session\s*:|01/|0[1-9]/|\d{1,2}/\d{1,2}/20)",
) -> DataFrame:
    """A title paragraph followed by an institution paragraph, which it uses up.

    In a run of paragraphs that each precede an institution line only every second one is a title,
    because the line between them is already used."""
    stream = tag_stream(html, [par_tag])
    rows = df.select(page_id, F.posexplode(stream).alias("pos", "s")).select(
        page_id, "pos", F.col("s.text").alias("text")
    )
    w = Window.partitionBy(page_id).orderBy("pos")
    head = F.col("text").rlike(session_pattern)
    usable = (F.col("text") != "") & ~ru.is_skip_line("text") & ~head & (tx.word_count("text") >= 3)
    can = F.coalesce(usable & institution(F.lead("text").over(w)), F.lit(False))
    rows = rows.withColumn("next", F.lead("text").over(w)).withColumn("can", can)
    rows = rows.withColumn("session", F.coalesce(F.last(F.when(head, F.col("text")), True).over(w), F.lit("")))
    rows = rows.withColumn("brk", F.sum(F.when(F.col("can"), 0).otherwise(1)).over(w))
    run = Window.partitionBy(page_id, "brk").orderBy("pos")
    rows = rows.withColumn("k", F.sum(F.col("can").cast("int")).over(run))
    return rows.filter(F.col("can") & (F.col("k") % 2 == 1)).select(
        page_id, "pos", "session", F.col("text").alias("title"), F.col("next").alias("authors")
    ).filter(F.length("title") > 8)


def inline_title_layout(df: DataFrame, page_id: str, html: str, title_tag: str, par_tag: str = "p", session_tags=("b", "strong")) -> DataFrame:
    """Paragraphs whose title sits in an inner tag and whose authors are the rest of the text;
    paragraphs with only a bold part name the session."""
    pars = F.regexp_extract_all(_visible(html), F.lit(rf"(?is)<{par_tag}\b[^>]*>(.*?)</{par_tag}\s*>"), F.lit(1))
    rows = df.select(page_id, F.posexplode(pars).alias("pos", "raw"))
    inner = F.regexp_extract("raw", rf"(?is)<{title_tag}\b[^>]*>(.*?)</{title_tag}\s*>", 1)
    plain = lambda c: tx.squeeze(tx.unescape_html(tx.strip_tags(c)))
    marks = "|".join(session_tags)
    rows = rows.select(
        page_id, "pos", plain("raw").alias("full"), plain(inner).alias("title"),
        F.col("raw").rlike(rf"(?i)<({marks})\b").alias("bold"),
    )
    w = Window.partitionBy(page_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # lines that name people are no headings, but a bold "Session: ..." line is one
    speaker = ru.is_skip_line("full") & ~F.lower("full").startswith("session:")
    is_head = F.col("bold") & (F.col("title") == "") & ~speaker
    rows = rows.withColumn("session", F.coalesce(F.last(F.when(is_head, F.col("full")), True).over(w), F.lit("")))
    rest = F.when(
        F.col("full").startswith(F.col("title")), F.substr("full", F.length("title") + 1)
    ).otherwise(F.replace("full", F.col("title"), F.lit("")))
    return rows.filter((F.col("title") != "") & ~ru.is_garbage_title("title")).select(
        page_id, "pos", "session", "title", F.ltrim(F.trim(rest), F.lit(" ,;")).alias("authors")
    )


def _class_blocks(html, tag: str, cls: str) -> Column:
    """Text after each opening tag of a class, up to the next one of the same class."""
    cut = F.regexp_replace(_visible(html), rf"(?i)<{tag}\b[^>]*class=[\"'][^\"']*\b{cls}\b[^\"']*[\"'][^>]*>", MARK)
    return F.slice(F.split(cut, MARK), 2, 1_000_000_000)


def _class_text(block: Column, tag: str, cls: str) -> Column:
    return tx.squeeze(
        tx.unescape_html(
            tx.strip_tags(
                F.regexp_extract(
                    block, rf"(?is)<{tag}\b[^>]*class=[\"'][^\"']*\b{cls}\b[^\"']*[\"'][^>]*>(.*?)</{tag}\s*>", 1
                )
            )
        )
    )


def session_filtered_layout(
    df: DataFrame, page_id: str, html: str, source_text: str, session=("div", "session"),
    source=("font", "sessionSource"), session_title=("div", "sessionTitle"), paper=("div", "paper"),
    title=("font", "paperTitle"), author=("div", "author_prelim"), name=("font", "name"),
    affiliation=("font", "affiliation"),
) -> DataFrame:
    """Papers of those session blocks whose source names one association, authors in page order."""
    s = df.select(page_id, F.posexplode(_class_blocks(html, *session)).alias("s_no", "sec"))
    s = s.filter(_class_text(F.col("sec"), *source).contains(source_text))
    p = s.select(
        page_id, "s_no", _class_text(F.col("sec"), *session_title).alias("session"),
        F.posexplode(_class_blocks("sec", *paper)).alias("t_no", "blk"),
    )
    people = F.transform(
        _class_blocks("blk", *author),
        lambda a: F.trim(F.concat_ws(" ", _class_text(a, *name), _class_text(a, *affiliation))),
    )
    return p.select(
        page_id, "s_no", "t_no", "session", _class_text(F.col("blk"), *title).alias("title"),
        F.array_join(F.filter(people, lambda a: a != ""), ", ").alias("authors"),
    ).filter(F.length("title") >= 5)


def session_page_layout(df: DataFrame, page_id: str, html: str) -> DataFrame:
    """Papers of a session page: title heading and abstract section inside each paper block."""
    p = df.select(page_id, F.posexplode(_class_blocks(html, "article", "paper")).alias("t_no", "blk"))
    titled = _class_text(F.col("blk"), "h3", "paper-title")
    any_h3 = tx.strip_tags(F.regexp_extract("blk", r"(?is)<h3\b[^>]*>(.*?)</h3\s*>", 1))
    body = F.regexp_extract("blk", r"(?is)<section\b[^>]*class=[\"'][^\"']*\babstract\b[^\"']*[\"'][^>]*>(.*?)</section\s*>", 1)
    body = F.regexp_replace(body, r"(?is)<h4\b.*?</h4\s*>", " ")
    return p.select(
        page_id, "t_no", F.coalesce(F.nullif(titled, F.lit("")), any_h3).alias("title"),
        tx.squeeze(tx.unescape_html(tx.strip_tags(body))).alias("abstract"),
    ).filter(F.col("title") != "")


def by_year(pages: DataFrame, page_id: str, year: str, layouts: list[tuple[int, int, object, object]]) -> DataFrame:
    """Each page goes through the layout of its year; a second layout, where given, takes the pages
    on which the first found nothing. layouts: (first year, last year, layout, fallback or None)."""
    shape = [page_id, year, "session", "title", "authors"]
    out = None
    for lo, hi, layout, fallback in layouts:
        part = pages.filter(F.col(year).between(lo, hi))
        found = layout(part)
        rows = found.join(part.select(page_id, year), page_id).select(*shape)
        if fallback is not None:
            rest = part.join(found.select(page_id), page_id, "left_anti")
            rows = rows.unionByName(fallback(rest).join(rest.select(page_id, year), page_id).select(*shape))
        out = rows if out is None else out.unionByName(rows)
    return out


def programme_rows(rows: DataFrame, year: str) -> DataFrame:
    """Parsed rows with their slug id, first of each (year, normalised title) kept."""
    from verdigris.operators.windows import best

    keyed = rows.withColumn("__k", tx.dedupe_key(year, "title")).withColumn(
        "paper_id", tx.slug_id("afa", year, "title")
    )
    order = [F.col(c) for c in rows.columns]
    return best(keyed, ["__k"], order).drop("__k")
