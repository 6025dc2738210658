"""Conversations from messages that quote each other.

Lines that begin with quote marks belong to quoted passages, nested by the number of marks. A passage's
normalised words are hashed and joined to the messages, or paragraphs of messages, whose own words are the same,
which gives the reply links. Conversations follow the links; each message comes after the one it answers and loses its quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import saved
from verdigris.llm.graph import components

#: Leading quote marks of a line, which blanks may separate; a line that introduces a quotation.
MARKS = r"^((?:[ \t]*>)+)[ \t]?"
INTRODUCTION = r"(?i)^[ \t]*(?:on\b.*\bwrote|.*\bwrites)[ \t]*:[ \t]*$"

#: One word of a normalised text; in scripts that put no blanks between words every letter counts.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{UNSPACED}]|[^ {UNSPACED}]+"

#: A blank line; kinds of stretches: all of a level that stands together, one run of lines, one paragraph of a run.
BLANK = re.compile(r"\n[ \t]*\n")
BLOCK, RUN, PARAGRAPH = 0, 1, 2


def normal(text: Column) -> Column:
    """Lower-case letters and digits, blanks between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines(messages: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, at, level, line: every line with its number of quote marks, 0 for the message's own."""
    each = messages.select(*key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")).alias("at", "raw"))
    marks = F.regexp_extract("raw", MARKS, 1)
    level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
    return each.select(*key, "at", level.alias("level"), F.regexp_replace("raw", MARKS, "").alias("line"))


def runs_of(messages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, at, level, passage: runs of lines of one level; see parse."""
    order = Window.partitionBy(*key).orderBy("at")
    each = lines(messages, key, text).withColumn("next", F.lead("level").over(order))
    each = each.where(~(F.col("line").rlike(INTRODUCTION) & (F.coalesce("next", F.lit(0)) > F.col("level"))))
    changed = F.coalesce(F.col("level") != F.lag("level").over(order), F.lit(True)).cast("int")
    runs = each.withColumn("run", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy(*key, "run", "level").agg(F.min("at").alias("at"), joined("line").alias("passage"))
    return grouped.select(*key, "at", "level", "passage")


def joined(text: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", text))), lambda x: x[text]), "\n")


def own_of(runs: DataFrame, key: list[str]) -> DataFrame:
    return runs.where("level = 0").groupBy(*key).agg(F.trim(joined("passage"), F.lit(" \t\n")).alias("own"))


def parse(messages: DataFrame, key: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Own texts (key, own) and quoted passages (key, at, level, passage).

    A passage is a run of lines of one level; what a deeper level holds is a passage of its own. A line that
    introduces a quotation belongs to neither, if a quotation follows it."""
    runs = runs_of(messages, key, text)
    return own_of(runs, key), runs.where("level > 0")


def stretches(runs: list) -> list[tuple[int, int, int, str]]:
    """level, kind, at, text of all that a message's runs, in order, can be quoted or quote by: of each level the
    runs between which only deeper levels stand, joined; each run; each paragraph. What equals a larger one is left out."""
    out, open_blocks = [], []

    def close(least: int) -> None:
        while open_blocks and open_blocks[-1][0] > least:
            level, own = open_blocks.pop()
            out.append((level, BLOCK, own[0][0], "\n".join(t for _, t in own)))
            if len(own) > 1:
                out.extend((level, RUN, at, t) for at, t in own)

    for at, level, text in runs:
        close(level)
        if open_blocks and open_blocks[-1][0] == level:
            open_blocks[-1][1].append((at, text))
        else:
            open_blocks.append((level, [(at, text)]))
        parts = [x for x in BLANK.split(text) if x.strip()]
        if len(parts) > 1:
            out.extend((level, PARAGRAPH, at, x) for x in parts)
    close(-1)
    return out


def hashed_stretches(runs: DataFrame) -> DataFrame:
    """conv_id, turn, level, kind, at, hash, n_words of all stretches with words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (c, t, *x) for c, t, own in zip(batch["conv_id"], batch["turn"], batch["own"], strict=True)
                for x in stretches(sorted((r["at"], r["level"], r["passage"]) for r in own))
            ]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "level", "kind", "at", "passage"])

    lists = runs.groupBy("conv_id", "turn").agg(F.collect_list(F.struct("at", "level", "passage")).alias("own"))
    each = lists.mapInPandas(cut, "conv_id long, turn long, level int, kind int, at int, passage string").withColumn("words", normal(F.col("passage")))
    return each.where("words <> ''").select("conv_id", "turn", "level", "kind", "at", F.sha2("words", 256).alias("hash"), F.regexp_count("words", F.lit(WORD)).alias("n_words"))


def conversations(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", least_words: int = 3,
) -> DataFrame:
    """conv_id, turn, role, text, thread, depth, parent_conv, parent_turn, n_quotes: every message without its
    quotes, in conversations that follow quotation.

    A passage links to the message whose own words equal it, or else to one of which a run of lines between quotes
    or a paragraph equals it: one of its own conversation before one of another, then the latest earlier turn, then
    the smallest conversation. Passages are tried as all runs of a level together, between which only deeper levels
    stand, then run by run, then by paragraphs. Links to other conversations need least_words words (letters,
    in scripts without blanks). The passage of least level that has a source makes the parent; without one it is the turn before in the same
    conversation. thread is the smallest conv_id that links join, and a thread reads in the order of (depth,
    conv_id, turn), where depth counts the replies up to a message that answers nothing; the order needs no
    task to hold a whole thread. Links only lead to other messages, and never back: within a conversation to earlier turns,
    between conversations to smaller ids.

    Null and empty texts are messages without words. Rows with a null conv_id or turn are left out: they have no
    place. Of rows that share conv_id and turn the one with the least role and text stays. Other columns are not
    read; an empty table gives no rows. A passage that very many messages share is one row per hash and
    conversation before it is joined, and a first turn that many conversations share keeps one candidate
    outside."""
    key = ["conv_id", "turn"]
    rows = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = saved(rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(*key).agg(F.min(F.struct("role", "text")).alias("m")).select(*key, "m.*"), "messages")
    runs = saved(runs_of(rows, key), "runs")
    own = saved(rows.select(*key, "role").join(own_of(runs, key), key, "left").withColumn("own", F.coalesce("own", F.lit(""))), "own")
    found = saved(hashed_stretches(runs), "stretches")

    part = (F.col("kind") > BLOCK).alias("part")
    sources = found.where("level = 0").groupBy("hash", *key).agg(F.min(part).alias("part"))
    asked = found.where("level > 0").groupBy("hash", *key, "level", "kind").agg(F.min("at").alias("at"), F.first("n_words").alias("n_words"))
    inside = sources.select("hash", "conv_id", "part", F.col("turn").alias("source_turn")).join(asked, ["hash", "conv_id"]).where("source_turn < turn")
    nearest = F.min(F.struct("part", (-F.col("source_turn")).alias("back"))).alias("s")
    inside = inside.groupBy(*key, "level", "kind", "at").agg(nearest).select(
        *key, "level", "kind", "at", "s.part", F.col("conv_id").alias("source_conv"), (-F.col("s.back")).alias("source_turn")
    )
    first = sources.groupBy("hash", "part").agg(F.min(F.struct("conv_id", "turn")).alias("s"))
    outside = asked.where(F.col("n_words") >= least_words).join(first, "hash").where("s.conv_id < conv_id").select(
        *key, "level", "kind", "at", "part", F.col("s.conv_id").alias("source_conv"), F.col("s.turn").alias("source_turn")
    )
    choice = F.min(F.struct("level", (F.col("source_conv") != F.col("conv_id")).alias("other"), "kind", "part", "at", "source_conv", "source_turn")).alias("c")
    quoted = inside.unionByName(outside).groupBy(*key).agg(choice)

    counted = runs.where("level > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n_quotes"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    linked = own.withColumn("before", before).join(quoted, key, "left").join(counted, key, "left").select(
        *key, "role", F.col("own").alias("text"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("c.source_conv", F.when(F.col("before").isNotNull(), F.col("conv_id"))).alias("parent_conv"),
        F.coalesce("c.source_turn", "before").alias("parent_turn"),
    )
    linked = saved(linked, "linked")
    joins = linked.where("parent_conv <> conv_id").select(F.col("conv_id").alias("a"), F.col("parent_conv").alias("b"))
    threads = components(joins).select(F.col("node").alias("conv_id"), F.col("component").alias("thread"))
    depth = depths(linked)
    out = linked.join(threads, "conv_id", "left").join(depth, key).withColumn("thread", F.coalesce("thread", "conv_id"))
    return out.select(*key, "role", "text", "thread", "depth", "parent_conv", "parent_turn", "n_quotes")


def depths(linked: DataFrame) -> DataFrame:
    """conv_id, turn, depth: replies up to a message that answers nothing, by doubling the known distance."""
    key = ["conv_id", "turn"]
    up = linked.select(*key, F.col("parent_conv").alias("pc"), F.col("parent_turn").alias("pt"), F.when(F.col("parent_conv").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    up = saved(up, "depth")
    while not up.where("pc IS NOT NULL").isEmpty():
        ends = up.select(F.col("conv_id").alias("pc"), F.col("turn").alias("pt"), F.col("pc").alias("nc"), F.col("pt").alias("nt"), F.col("depth").alias("more"))
        # only rows that still have a way to go are joined
        going = up.where("pc IS NOT NULL").join(ends, ["pc", "pt"], "left")
        step = going.select(*key, F.col("nc").alias("pc"), F.col("nt").alias("pt"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        up = saved(up.where("pc IS NULL").unionByName(step), "depth")
    return up.select(*key, "depth")
