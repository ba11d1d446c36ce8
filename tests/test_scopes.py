"""Type environments: what a receiver's type is where it is called."""

from __future__ import annotations

import pytest

from terrane.functions.text import hint
from terrane.sources import code, code_graph, scopes

JAVA = """package com.a;
import java.util.*;
public class Loans {
    private final Map<String, List<Loan>> cache = new HashMap<>();
    private StockRepository repo;
    @Autowired
    Audit[] audits;
    void one(final Ledger repo, int n) {
        repo.post();
        this.repo.load();
        for (Entry e : repo.entries()) {
            e.close();
        }
        com.x.Mailer mailer = new com.x.Mailer();
        mailer.send(e);
        lower.name();
    }
    int two() {
        var made = new Report();
        made.print();
        repo.load();
        cache.get("repo.load()");
        return Ledger.total();
    }
}
"""
GROOVY = """package com.g
class StockService {
    def plainService
    StockRepository repo
    def run(Ledger l) {
        l.post()
        def r = new Report()
        r.print()
        plainService.go()
        repo.load()
        String text = 'x'
        text.trim()
    }
}
"""


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("java", JAVA, {("post", "Ledger"), ("load", "StockRepository"), ("entries", "Ledger"), ("close", "Entry"), ("send", "com.x.Mailer"), ("print", "Report"), ("get", "Map"), ("name", None), ("total", None)}),
        ("groovy", GROOVY, {("post", "Ledger"), ("print", "Report"), ("go", None), ("load", "StockRepository"), ("trim", "String")}),
    ],
)
def test_receivers_have_the_nearest_type(spark, language, text, want):
    files = spark.createDataFrame([("p", "src/F", f"plain_{language}", language, "h", text), ("p", "src/E", f"plain_{language}", language, "h", "")], "project_id string, path string, artifact_type string, language string, content_hash string, text string")
    declared = code_graph.described(code.declarations(files))
    lines = code_graph.body_lines(declared)
    edges = code_graph.body_edges(lines)
    got = scopes.typed_calls(edges, declared, lines)
    assert got.count() == edges.count() and got.columns == edges.columns
    calls = got.filter("type = 'CALLS'").select(hint(got["target_hint"], "method").alias("m"), hint(got["target_hint"], "declared").alias("t")).collect()
    assert {(r["m"], r["t"]) for r in calls} == want
