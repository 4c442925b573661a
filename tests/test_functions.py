import pytest
from pyspark.sql import functions as F

from auditspan.functions import labels, paths, routes, text


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k)
            for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cols).select(column.alias("v")).first().v


def test_lines(spark):
    v = one(spark, text.lines_of(F.col("c")), c="a\r\nb\x0bc d\n\n")
    assert v == ["a", "b", "c", "d", ""]
    assert one(spark, text.lines_of(F.col("c")), c="") == []


def test_snippet_probes(spark):
    v = one(spark, text.snippet_probes(F.col("c")),
            c=" 12: def  handler(x):\n short\n...long enough but elided\n====== ======\n"
              "13| return compute(x, y)\nanother_line_here()\nfourth_longer_line_here()\n")
    assert v == ["fourth_longer_line_here()", "return compute(x, y)", "another_line_here()"]


@pytest.mark.parametrize("path,want", [
    ("/users/:userId", ("/users/{userId}", ["userId"])),
    ("/invoices/<int:pk>/", ("/invoices/{pk}/", ["pk"])),
    ("/api/[id]/items/{itemId:int}", ("/api/{id}/items/{itemId}", ["id", "itemId"])),
    ("^orders/(?P<order_id>\\d+)/$", ("/orders/{order_id}/", ["order_id"]))])
def test_template(spark, path, want):
    p = F.col("p")
    assert one(spark, routes.template_path(p), p=path) == want[0]
    assert one(spark, routes.template_params(p), p=path) == want[1]


def test_route_text(spark):
    p = F.col("p")
    assert one(spark, routes.collection_path(p), p="/users/{id}") == "/users"
    assert one(spark, routes.collection_path(p), p="/orgs/{o}/members/:id") == \
        "/orgs/{o}/members"
    m = F.create_map(F.lit("id"), F.lit("7"))
    assert one(spark, routes.fill_path(p, m), p="/users/{id}/posts/{pid}") == \
        "/users/7/posts/1"
    fam = lambda x: one(spark, routes.resource_family(p), p=x)
    assert [fam(x) for x in ("/Users/{id}", "/users/:id/", "/:a/:b", "/a/:b/c/:d", "/")] == \
        ["/users", "/users", "/:p", "/a/:p/c", "/"]
    assert one(spark, routes.normal_label(p), p="get  /users/:id/") == "GET /users/{}"
    assert one(spark, routes.normal_label(p), p="") == ""
    assert one(spark, routes.path_params(p), p="/a/{id:int}/<uuid:k>/[...rest]") == \
        ["id", "k", "rest"]


def test_hosts(spark):
    b, h = F.lit("https://App.test:8443/x"), F.array(
        F.lit("https://api.test/v1"), F.lit("CDN.test:80"), F.lit(" "))
    assert one(spark, paths.allowed_hosts(b, h)) == ["api.test", "app.test", "cdn.test"]
    assert one(spark, paths.url_path(F.lit("http://h/a/b?x=1#y"))) == "/a/b"
    assert one(spark, paths.url_path(F.lit("http://h"))) == "/"


def test_paths(spark):
    p = F.col("p")
    for path, lang, inc in (("src/a.py", "python", True), ("a/tests/b.py", "python", False),
                            ("x/vendor/y.go", "go", False), ("a.min.js", "javascript", False),
                            ("README", None, False)):
        assert one(spark, paths.language(p), p=path) == lang
        assert one(spark, paths.is_included(p, F.lit(10), F.lit(False)), p=path) is (
            inc if lang else None) or not inc
    assert one(spark, paths.escapes_root(p), p="a/../../b")
    assert not one(spark, paths.escapes_root(p), p="a/../b")
    assert one(spark, paths.ancestors(p), p="a/b/c.py") == ["", "a", "a/b"]
    assert one(spark, paths.is_test_path(p), p="pkg/thing_test.go")


def test_labels(spark):
    fp = lambda **k: one(spark, labels.fingerprint(*[
        F.lit(k.get(n)).cast("string") for n in
        ("cwe", "rule", "category", "title", "file_path", "endpoint")]))
    assert fp(cwe="CWE-89: SQL", file_path="db.py") == "cwe:cwe-89|db.py"
    assert fp(rule="R1", endpoint="GET /x") == "rule:r1|GET /x"
    assert fp(title="Some very long title of a finding here now") == \
        "title:some very long title finding here|"
    kind = lambda r, c: one(spark, labels.probe_kind(
        F.lit(r).cast("string"), F.lit(c).cast("string")))
    assert kind("access.idor", None) == "idor" and kind(None, "CWE-862: x") == "bfla"
    assert kind("access.inconsistent-authn", "CWE-862") == "missing_authn"
    assert kind("x", "CWE-1") is None
    assert one(spark, text.compact_count(F.lit(1234567))) == "1.23M"
    assert one(spark, text.slug(F.lit("--Ab C!"))) == "ab-c"


@pytest.mark.parametrize("message,status,cause", [
    ("Error: invalid_api_key", 401, "auth"), ("permission denied", 403, "auth"),
    ("The model 'm' does not exist", 404, "model"), ("DeploymentNotFound", 404, "model"),
    ("Too Many Requests: rate limit", 429, "rate_limit"),
    ("maximum context length is 8192 tokens", None, "context"),
    ("Request timed out", None, "timeout"), ("Connection error", None, "endpoint"),
    ("no parseable JSON", None, "bad_output"), ("strange", None, "unknown")])
def test_error_causes(spark, message, status, cause):
    assert one(spark, text.error_cause(F.lit(message), F.lit(status).cast("int"))) == cause


def test_json_recovery(spark):
    t = lambda s: one(spark, text.tolerant_json(F.lit(s)))
    assert t('<think>{no}</think> {"a":1}') == '{"a":1}'
    assert t('```json\n{"a":2}\n```') == '{"a":2}'
    assert t('sure: {"a":3} done') == '{"a":3}'
    assert t("nothing") == "{}"
    assert one(spark, text.json_text_length(F.lit('a"\né\U0001F600\x01'))) == \
        len(__import__("json").dumps('a"\né\U0001F600\x01'))


def test_headers(spark):
    h = F.create_map(F.lit("Authorization"), F.lit("s"), F.lit("Accept"), F.lit("x"))
    assert one(spark, text.redact_headers(h)) == {"Authorization": "<redacted>", "Accept": "x"}
    assert len(one(spark, text.missing_headers(h, F.lit("https://a")))) == 5
    assert one(spark, text.missing_cookie_flags(F.lit("a=b; Secure"))) == \
        ["HttpOnly", "SameSite"]
    body = "x" * 100 + "Traceback (most recent call last)" + "y" * 100
    got = one(spark, text.error_disclosure(F.lit(500), F.lit(body)))
    assert got == "x" * 60 + "Traceback (most recent call last)" + "y" * 60
    assert one(spark, text.escape_html(F.lit("<a href='x'>&</a>"))) == \
        "&lt;a href=&#x27;x&#x27;&gt;&amp;&lt;/a&gt;"


def test_quotes_join_before_lines_are_made_distinct(spark, tmp_path):
    from workload import corpus
    spark.createDataFrame([(1, "one long line\nanother  long line\nshort\n")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, "another long line\n one long  line\none long line" if k < 2 else "else here", "en", "s", 9) for k in range(4)],
                          "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus.benchmark_quotes(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join"):].count("Aggregate") == 1  # of the quotes
    assert sorted((r.item_id, r.path, r.shared_lines) for r in found.collect()) == [
        (1, "pkg/tests/d0.py", 2), (1, "vendor/lib/d1.py", 2)]
