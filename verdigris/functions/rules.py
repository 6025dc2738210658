"""Topic, direction, table and statistic rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions import lexicon as lx
from verdigris.functions.stats import bound, normal_quantile
from verdigris.functions.text import as_col, text_or_empty, title_words, word_count


def contains_any(c: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in phrases))


def contains_all_count(c: Column, phrases) -> Column:
    """How many of the phrases occur."""
    return reduce(lambda a, b: a + b, (c.contains(p).cast("int") for p in phrases))


def topic_hit(c, phrases=lx.TOPIC_PHRASES, ambiguous=lx.TOPIC_AMBIGUOUS) -> Column:
    """Any phrase; a phrase too broad on its own needs a second one beside it."""
    low = F.lower(text_or_empty(c))
    clear = [p for p in phrases if p not in ambiguous]
    return contains_any(low, clear) | (contains_all_count(low, ambiguous) >= 2)


def topic_hit_title(c, phrases=lx.TOPIC_PHRASES, extra=lx.TOPIC_TITLE_EXTRA) -> Column:
    return contains_any(F.lower(text_or_empty(c)), list(phrases) + list(extra))


def topic_hits(c, phrases=lx.TOPIC_PHRASES) -> Column:
    low = F.lower(text_or_empty(c))
    return F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases]))


def _one_sided(low: Column, positive, negative) -> Column:
    pos, neg = contains_any(low, positive), contains_any(low, negative)
    return F.when(pos & ~neg, F.lit(1)).when(neg & ~pos, F.lit(-1)).otherwise(F.lit(0))


def direction_from_title(c, positive=lx.TITLE_POSITIVE, negative=lx.TITLE_NEGATIVE) -> Column:
    return _one_sided(F.lower(text_or_empty(c)), positive, negative)


def direction_from_abstract(
    c, null=lx.ABSTRACT_NULL, positive=lx.ABSTRACT_POSITIVE, negative=lx.ABSTRACT_NEGATIVE
) -> Column:
    """Null phrases decide first, then a phrase of one sign alone."""
    low = F.lower(text_or_empty(c))
    return F.when(contains_any(low, null), F.lit(0)).otherwise(_one_sided(low, positive, negative))


def direction_best(title, abstract, min_words: int = 20, **lists) -> Column:
    title_lists = {k[6:]: v for k, v in lists.items() if k.startswith("title_")}
    abstract_lists = {k[9:]: v for k, v in lists.items() if k.startswith("abstract_")}
    return F.when(
        word_count(abstract) >= min_words, direction_from_abstract(abstract, **abstract_lists)
    ).otherwise(direction_from_title(title, **title_lists))


def quoted_statistic(c) -> Column:
    """Test statistic quoted in prose: t or z, F, chi-square, p-value, then the level named."""
    t = text_or_empty(c)

    def number(pattern: str) -> Column:
        return F.regexp_extract(t, pattern, 1).try_cast("double")

    tz, f, chi, p = (number(x) for x in (lx.STAT_TZ, lx.STAT_F, lx.STAT_CHI, lx.STAT_P))
    level = F.regexp_extract(t, lx.STAT_LEVEL, 1)
    by_level = reduce(
        lambda acc, kv: acc.when(level == kv[0], F.lit(kv[1])),
        list(lx.STAT_LEVEL_VALUE.items())[1:],
        F.when(level == "1", F.lit(lx.STAT_LEVEL_VALUE["1"])),
    )
    return F.coalesce(
        bound(tz, lambda v: F.when(v.between(0.5, 20), v)),
        bound(f, lambda v: F.when((v > 0) & (v <= 400), F.sqrt(v))),
        bound(chi, lambda v: F.when((v > 0) & (v <= 400), F.sqrt(v))),
        bound(p, lambda v: F.when((v > 0) & (v < 0.5), F.abs(normal_quantile(v / 2)))),
        by_level,
    )


def expected_star(z) -> Column:
    z = as_col(z)
    return (
        F.when(z.isNull(), F.lit(None).cast("string"))
        .when(z >= lx.Z01, F.lit("***"))
        .when(z >= lx.Z05, F.lit("**"))
        .when(z >= lx.Z10, F.lit("*"))
        .otherwise(F.lit(""))
    )


def p_stars(p) -> Column:
    p = as_col(p)
    return (
        F.when(p < 0.01, F.lit("***")).when(p < 0.05, F.lit("**")).when(p < 0.10, F.lit("*"))
        .otherwise(F.lit(""))
    )


def table_kind(c) -> Column:
    low = F.lower(as_col(c))
    out = F.when(F.coalesce(F.trim(low), F.lit("")) == "", F.lit("Unknown/blank"))
    for label, parts in lx.TABLE_KIND_WORDS:
        out = out.when(contains_any(low, parts), F.lit(label))
    return out.otherwise(F.lit("Other"))


def is_control(c) -> Column:
    c = text_or_empty(c)
    return F.when(F.trim(c) == "", F.lit(False)).otherwise(c.rlike(lx.CONTROL_PATTERN))


def is_noise_title(c) -> Column:
    return F.coalesce(as_col(c).rlike(lx.NOISE_TITLE_PATTERN), F.lit(False))


def is_admin_title(c, phrases) -> Column:
    up = F.upper(text_or_empty(c))
    return (up == "") | contains_any(up, phrases)


def is_skip_line(c) -> Column:
    low = F.lower(F.trim(text_or_empty(c)))
    return reduce(lambda a, b: a | b, (low.startswith(p) for p in lx.SKIP_LINE_PREFIXES))


def is_garbage_title(c) -> Column:
    low = F.lower(text_or_empty(c))
    starts = reduce(
        lambda a, b: a | b,
        (low.startswith(p) for p in ("discussant", "session", "president", "location:")),
    )
    return (word_count(c) < 3) | starts


def looks_like_institution(c, pattern: str = lx.INSTITUTION_PATTERN) -> Column:
    return text_or_empty(c).rlike(pattern)


def is_top_institution(c, keywords=lx.TOP_INSTITUTIONS) -> Column:
    return contains_any(F.lower(text_or_empty(c)), keywords)


def usable_abstract(c, min_words: int = 20) -> Column:
    return word_count(c) >= min_words


def phrase_count(c, phrases) -> Column:
    """Whole-word occurrences of every phrase, overlaps between phrases counted for each."""
    low = F.lower(text_or_empty(c))
    return reduce(
        lambda a, b: a + b, (F.regexp_count(low, F.lit(r"(?U)\b" + p + r"\b")) for p in phrases)
    )


def supports_title(title, abstract, n: int = 2) -> Column:
    """At least n distinct title words of four letters or more occur inside the abstract."""
    from verdigris.functions.text import normalise_title

    body = normalise_title(abstract, lx.STOP_WORDS_SHORT)
    long_words = F.filter(
        F.array_distinct(title_words(title, lx.STOP_WORDS_SHORT)), lambda w: F.length(w) >= 4
    )
    found = bound(body, lambda b: F.filter(long_words, lambda w: b.contains(w)))
    return F.size(found) >= n
