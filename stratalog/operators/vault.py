"""Note collections: names, conflicts, incremental scans, and resolution of link targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dialect import strip
from ..storage import checkpointed

HEAD = 4000


def front_matter(value: Column, head: int = HEAD) -> Column:
    """Struct (title, aliases) of the block between '---' lines at the very start; aliases inline or as a list, distinct in order."""
    block = F.regexp_extract(F.substring(value, 1, head), r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    title = strip(F.regexp_extract(block, "(?m)^title(?U:\\s*):(?U:\\s*)[\"']?([^\"'\\n]+)[\"']?", 1))

    def bare(x):
        return F.regexp_replace(strip(x), "\\A[\"']+|[\"']+\\z", "")

    inline = F.flatten(F.transform(F.regexp_extract_all(block, F.lit(r"aliases?(?U:\s*):(?U:\s*)\[([^\]]*)\]"), 1), lambda g: F.transform(F.split(g, ","), bare)))
    listed = F.regexp_extract(F.concat(block, F.lit("\n")), r"(?m)^aliases?(?U:\s*):(?U:\s*)\n((?:[ \t]+-[ \t]*.+\n?)+)", 1)
    items = F.transform(F.regexp_extract_all(listed, F.lit(r"(?m)^[ \t]+-[ \t]*(.+)$"), 1), bare)
    return F.struct(F.when(title != "", title).alias("title"), F.array_distinct(F.filter(F.concat(inline, items), lambda a: a != "")).alias("aliases"))


def visible(rel: Column) -> Column:
    """No part of the relative path starts with a dot."""
    return ~F.exists(F.split(rel, "/"), lambda p: F.startswith(p, F.lit(".")))


def note_entries(notes: DataFrame) -> DataFrame:
    """(rel, stem, rel_stem, title, aliases) of visible notes (rel, value)."""
    rel_stem = F.regexp_replace("rel", r"\.md\z", "")
    rows = notes.where(visible(F.col("rel"))).withColumn("fm", front_matter(F.col("value")))
    return rows.select("rel", F.element_at(F.split(rel_stem, "/"), -1).alias("stem"), rel_stem.alias("rel_stem"), F.col("fm.title").alias("title"), F.col("fm.aliases").alias("aliases"))


def name_index(entries: DataFrame) -> DataFrame:
    """(name, candidates, alias, conflict): the notes each stem, relative stem, title and alias names, in order of path parts; the first is the alias."""
    names = F.concat(F.array("stem", "rel_stem", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entries.select("rel_stem", F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))).alias("name"))
    ordered = F.array_sort(F.collect_list(F.struct(F.split("rel_stem", "/").alias("parts"), "rel_stem")))
    out = rows.groupBy("name").agg(F.array_distinct(F.transform(ordered, lambda x: x["rel_stem"])).alias("candidates"))
    return out.select("name", "candidates", F.element_at("candidates", 1).alias("alias"), (F.size("candidates") > 1).alias("conflict"))


def name_targets(entries: DataFrame) -> DataFrame:
    """(name, n_candidates, alias) as ``name_index``, without the candidates: counts and the first, which combine before they are shuffled."""
    names = F.concat(F.array("stem", "rel_stem", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entries.select("rel_stem", F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))).alias("name"))
    return rows.groupBy("name").agg(F.count_distinct("rel_stem").alias("n_candidates"), F.min_by("rel_stem", F.struct(F.split("rel_stem", "/"), "rel_stem")).alias("alias"))


def name_candidates(entries: DataFrame) -> DataFrame:
    """(name, ordinal, rel_stem): the candidates of ``name_index`` as rows, numbered from 1 in order of path parts.

    Names are dealt in ranges with their paths, and numbers within ranges are set off by the ranges' counts, so a name that
    very many notes share lies in as many tasks as it fills. The first one is the alias, the last one's number the count.
    """
    names = F.concat(F.array("stem", "rel_stem", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entries.select("rel_stem", F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))).alias("name")).distinct()
    order = ["parts", "rel_stem"]
    dealt = rows.withColumn("parts", F.split("rel_stem", "/")).repartitionByRange("name", *order)
    dealt = checkpointed(dealt.withColumn("range", F.spark_partition_id()))
    earlier = W.partitionBy("name").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("name", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("name", "range").orderBy(*order))
    return dealt.withColumn("own", own).join(sums, ["name", "range"]).select("name", (F.col("before") + F.col("own")).alias("ordinal"), "rel_stem")


def scan_counts(plan: DataFrame) -> DataFrame:
    """One row (reused, parsed, removed) of ``scan_plan``."""
    return plan.agg(*[F.count_if(F.col("action") == action).alias(name) for action, name in (("reuse", "reused"), ("parse", "parsed"), ("remove", "removed"))])


def scan_plan(files: DataFrame, before: DataFrame) -> DataFrame:
    """(rel, action) with action reuse, parse or remove, of file states (rel, mtime, size) now and before; only 'parse' rows need reading."""
    old = before.select(F.col("rel"), F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("was"))
    rows = files.select("rel", "mtime", "size", F.lit(True).alias("now")).join(old, "rel", "full")
    same = F.col("now") & F.col("was") & (F.col("mtime") == F.col("m0")) & (F.col("size") == F.col("s0"))
    return rows.select("rel", F.when(F.col("now").isNull(), "remove").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("parse").alias("action"))


def resolve_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(ord, term, n_candidates, target) of ``terms`` and ``name_targets``: one candidate is the target; none or several give none."""
    found = terms.select("ord", "term").join(names.select(F.col("name").alias("term"), "n_candidates", "alias"), "term", "left")
    n = F.coalesce("n_candidates", F.lit(0))
    return found.select("ord", "term", n.cast("long").alias("n_candidates"), F.when(n == 1, F.col("alias")).alias("target"))


def known_targets(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of targets (target) that name a note, in any case, with or without '.md', by path, stem, title or alias."""
    names = F.concat(F.array("rel", "stem", "rel_stem", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = entries.select(F.explode(F.filter(names, lambda n: n.isNotNull())).alias("key")).select(F.lower("key").alias("key")).distinct()
    clean = F.lower(F.replace("target", F.lit("\\"), F.lit("/")))
    return targets.withColumn("key", F.regexp_replace(clean, r"\.md\z", "")).join(keys, "key", "left_semi").drop("key")


def targets_of(value: Column) -> Column:
    """Targets of the wiki links of a text, in order, without display text, section or block."""
    found = F.transform(F.regexp_extract_all(value, F.lit(r"\[\[([^\]\n]+)\]\]"), 1), lambda raw: strip(F.regexp_extract(raw, r"\A([^|#^]*)", 1)))
    return F.filter(found, lambda t: t != "")


def link_targets(notes: DataFrame) -> DataFrame:
    """(note_id, target) of the wiki links in notes (note_id, value)."""
    return notes.select("note_id", F.explode(targets_of(F.col("value"))).alias("target"))


def dangling(notes: DataFrame, entries: DataFrame) -> DataFrame:
    """(note_id, target) of links whose target no note's path, stem, title or alias equals, case and all."""
    names = F.concat(F.array("rel", "stem", "rel_stem", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = entries.select(F.explode(F.filter(names, lambda n: n.isNotNull())).alias("key")).distinct()
    links = link_targets(notes).withColumn("clean", F.replace("target", F.lit("\\"), F.lit("/")))
    missing = links.join(keys.withColumnRenamed("key", "clean"), "clean", "left_anti")
    return missing.join(keys.withColumnRenamed("key", "target"), "target", "left_anti").select("note_id", "target")
