"""URIs and the patterns they reach."""

from __future__ import annotations

import pytest

from terrane.operators.routing import route

PATTERNS = {"root": "/", "loan": "/loan/$id?", "show": "/loan/show/$id", "both": "/book/$a?/$b?", "rest": "/static/**", "deep": "/static/js/*", "any": "/$controller/$action?/$id?(.$format)?", "error": "500", "brace": "/user/${id}/edit", "again": "/loan/$other"}


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("/", "root"), ("/loan", "loan"), ("/loan/", "loan"), ("/loan/7", "again"), ("/loan/show/7?x=1", "show"), ("/loan/edit/7", "any"), ("/book", "both"), ("/book/1/2#c", "both"), ("/book/1/2/3", None), ("/static", "rest"),
        ("/static/css/a/b.css", "rest"), ("/static/js/a.js", "deep"), ("/static/js/a/b.js", "rest"), ("/user/3/edit", "brace"), ("/user/3/delete", "any"), ("/x/y/z/w", None), ("500", "any"),
    ],
)
def test_the_most_specific_pattern(uri, want, routed):
    assert routed.get(uri) == want


@pytest.fixture(scope="module")
def routed(spark):
    uris = [m[0] for m in test_the_most_specific_pattern.pytestmark[0].args[1]]
    found = route(spark.createDataFrame([(u,) for u in uris * 2], "uri string"), spark.createDataFrame([(i, p) for i, p in PATTERNS.items()], "id string, pattern string"))
    rows = [(r["uri"], r["id"]) for r in found.collect()]
    assert len(rows) == len({u for u, _ in rows})
    return dict(rows)


def test_no_patterns(spark):
    assert route(spark.createDataFrame([("/a",)], "uri string"), spark.createDataFrame([], "id string, pattern string")).count() == 0
