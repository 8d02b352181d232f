import json
import os

from stratalog.plans import vault_jobs


def test_scan_and_inject(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("vault", "index", "input", "terms", "output")}
    inject = ["inject", "--index", at["index"], "--input", at["input"], "--terms", at["terms"], "--output", at["output"]]
    assert vault_jobs.main(["scan", "--index", at["index"]], spark) == 2
    assert vault_jobs.main(["scan", "--vault", at["vault"], "--index", at["index"]], spark) == 2
    os.makedirs(f"{at['vault']}/a/.hidden")
    os.makedirs(at["input"])
    for name, text in (("a/graph.md", "---\ntitle: Graph Theory\n---\nx"), ("tree.md", "x"), ("a/.hidden/no.md", "x")):
        open(f"{at['vault']}/{name}", "w").write(text)
    open(f"{at['input']}/me.md", "w").write("A graph is not a tree.")
    assert vault_jobs.main(inject, spark) == 2
    assert vault_jobs.main(["scan", "--vault", at["vault"], "--index", at["index"]], spark) == 0
    assert vault_jobs.main(inject, spark) == 2
    open(at["terms"], "w").write(json.dumps([{"term": "graph", "type": "concept"}, {"term": "tree", "type": "concept"}]))
    assert vault_jobs.main(inject, spark) == 0
    out = spark.read.json(at["output"]).first()
    assert out["note_id"] == "me.md" and sorted(out["linked"]) == ["graph", "tree"] and "[[" in out["value"]
    os.remove(f"{at['vault']}/tree.md")
    open(f"{at['vault']}/new.md", "w").write("---\naliases: [n]\n---\n")
    both = ["all", "--vault", at["vault"], *inject[1:]]
    assert vault_jobs.main(both, spark) == 0
    rows = {r["rel"]: (r["title"], r["aliases"], r["version"]) for r in vault_jobs.load_index(spark, at["index"]).collect()}
    assert rows == {"a/graph.md": ("Graph Theory", [], 2), "new.md": (None, ["n"], 2)}
