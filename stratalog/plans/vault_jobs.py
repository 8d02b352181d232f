"""Jobs over a folder of notes: index it, link notes with it. ``python -m stratalog.plans.vault_jobs scan|inject|all``.

Each job gives 0 where it is done and 2 where an input is missing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links, vault
from ..sources import notes as sources
from ..storage import checkpointed


def load_index(spark: SparkSession, index: str) -> DataFrame | None:
    """Entries (rel, mtime, size, stem, rel_stem, title, aliases) of the latest version, or None where there is no index."""
    try:
        rows = spark.read.parquet(index)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows.where(F.col("version") == rows.agg(F.max("version")).first()[0])


def _notes(spark: SparkSession, path: str) -> DataFrame | None:
    """Visible notes below ``path``, or None where there is none."""
    try:
        found = sources.read_notes(spark, path).where(vault.visible(F.col("rel")))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return None if found.isEmpty() else found


FIELDS = ["rel", "mtime", "size", "stem", "rel_stem", "title", "aliases"]
#: Paths of changed files that one read takes.
READ_PATHS = 10_000


def _parsed(found: DataFrame) -> DataFrame:
    return vault.note_entries(found).join(found.select("rel", "mtime", "size"), "rel").select(FIELDS)


def _append(entries: DataFrame, index: str, version: int) -> None:
    entries.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(index)


def scan(spark: SparkSession, folder: str, index: str) -> int:
    """Append a version of the index: entries of unchanged files as they were, of others parsed again, of removed files none.

    States come from the listing, and only files that changed are opened. A version is one commit, so readers see the last
    whole one. A folder that is missing or has no note gives 2.
    """
    try:
        listed = checkpointed(sources.file_states(spark, folder).where(vault.visible(F.col("rel"))))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 2
        raise
    if listed.isEmpty():
        return 2
    before = load_index(spark, index)
    if before is None:
        _append(_parsed(sources.read_notes(spark, folder).where(vault.visible(F.col("rel")))), index, 1)
        return 0
    plan = checkpointed(vault.scan_plan(listed, before.select("rel", "mtime", "size")))
    entries = before.join(plan.where("action = 'reuse'").select("rel"), "rel", "left_semi").select(FIELDS)
    paths, changed = [], listed.join(plan.where("action = 'parse'").select("rel"), "rel", "left_semi").select("path")
    for row in changed.toLocalIterator():
        paths.append(row["path"])
        if len(paths) == READ_PATHS:
            entries, paths = entries.unionByName(checkpointed(_parsed(sources.read_listed(spark, folder, paths)))), []
    if paths:
        entries = entries.unionByName(_parsed(sources.read_listed(spark, folder, paths)))
    _append(entries, index, before.select("version").first()[0] + 1)
    return 0


def follow(spark: SparkSession, folder: str, index: str, checkpoint: str):
    """Keep the index in step with a folder as a stream: each batch of additions, edits and deletions appends a version. A batch that is replayed gives the same entries."""
    spark.dataSource.register(sources.NoteChanges)
    rows = spark.readStream.format("note_changes").option("snapshots", f"{checkpoint}-snapshots").load(folder)

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.where(vault.visible(F.col("rel"))).persist()
        before = load_index(batch.sparkSession, index)
        entries = _parsed(batch.where("action <> 'delete'"))
        if before is not None:
            entries = entries.unionByName(before.join(batch.select("rel"), "rel", "left_anti").select(FIELDS))
        _append(entries, index, 1 if before is None else before.select("version").first()[0] + 1)
        batch.unpersist()

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inject(spark: SparkSession, source: str, terms: str, index: str, output: str | None, weak_links: str = "footer", audit: str | None = None, files: str | None = None) -> int:
    """Link all notes below ``source`` and write (note_id, value, linked, counts) to ``output`` as JSON, and to ``audit`` what became of the terms of each.

    ``files`` is a folder for the linked notes, a file each; the source's own path rewrites them in place. Without index,
    terms or notes, or any place to write to: 2.
    """
    if not output and not files:
        return 2
    entries, found = load_index(spark, index), _notes(spark, source)
    if entries is None or found is None:
        return 2
    try:
        listed = sources.parse_terms(spark.read.text(terms, wholetext=True))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 2
        raise
    plan = links.link_plan(listed, vault.name_index(entries), entries, weak_links)
    done = links.inject(found.select(F.col("rel").alias("note_id"), "value"), plan, weak_links)
    done = checkpointed(done)  # read for each sink, and before its source is rewritten
    if output:
        done.select("note_id", "value", "linked", "n_strong", "n_weak", "n_footer").write.mode("overwrite").json(output)
    if files:
        sources.write_files(done.select(F.col("note_id").alias("rel"), "value"), files)
    if audit:
        names = {"strong_links": "n_strong", "weak_links": "n_weak", "weak_footer": "n_footer", "linked_terms": "linked"}
        lists = ["terms_input", "skipped_invalid", "skipped_not_in_text", "invalid_targets", "ambiguous_terms", "skipped_self_links"]
        run = {"input": F.lit(source), "output": F.lit(output or files), "index_notes": F.lit(entries.count()), "weak_links_mode": F.lit(weak_links), "current_note": F.col("note_id")}
        done.select(*[F.col(c).alias(name) for name, c in names.items()], *lists, *[c.alias(name) for name, c in run.items()]).write.mode("overwrite").json(audit)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vault_jobs")
    parser.add_argument("job", choices=("scan", "inject", "all"))
    for name in ("vault", "index", "input", "terms", "output", "audit", "files"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--inplace", action="store_true", help="rewrite the notes of --input")
    parser.add_argument("--weak-links", default="footer", choices=("footer", "body", "none"))
    args = parser.parse_args(argv)
    if args.inplace:
        args.files = args.input
    needs = {"scan": ("vault", "index"), "inject": ("index", "input", "terms"), "all": ("vault", "index", "input", "terms")}[args.job]
    if args.job != "scan" and not args.output and not args.files:
        print("missing: --output, --files or --inplace", file=sys.stderr)
        return 2
    if lacking := [n for n in needs if not getattr(args, n)]:
        print("missing: " + ", ".join("--" + n for n in lacking), file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("vault_jobs").getOrCreate()
    code = scan(spark, args.vault, args.index) if args.job in ("scan", "all") else 0
    if code == 0 and args.job in ("inject", "all"):
        code = inject(spark, args.input, args.terms, args.index, args.output, args.weak_links, args.audit, args.files)
    return code


if __name__ == "__main__":
    sys.exit(main())
