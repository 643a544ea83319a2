import json
import random
import re
from difflib import SequenceMatcher

import pytest
from loomgraph.functions import java_code, json_paths, text
from loomgraph.operators import audits, corpus
from loomgraph.sources import files, paged_json
from loomgraph.streaming import pages
from pyspark.sql import functions as F


def test_candidate_band_is_exact(spark):
    rng = random.Random(1)
    rows = [(f"u{k:03}", rng.choice([1, 3, 8, 9, 20, 64, 65, 80, 88, 89, 300, 383, 384]), f"h{rng.randrange(20)}") for k in range(80)]
    got = {(r.l_uid, r.r_uid) for r in corpus.candidate_pairs(spark.createDataFrame(rows, "uid string, size int, hash string"), "uid", "size", "hash").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {(a[0], b[0]) for i, a in enumerate(order) for b in order[i + 1 :] if b[1] <= int(a[1] * 1.25) + 8 and a[2] != b[2]}
    assert got == want


def test_similar_groups(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, words), (2, words + " iota"), (3, "nothing like it at all, really"), (4, words.replace("beta", "betb"))]
    units = spark.createDataFrame([(k, t, len(t), str(k)) for k, t in rows], "uid int, text string, size int, hash string")
    got = corpus.similar_groups(units, "uid", "text", "size", "hash").collect()
    best = max(SequenceMatcher(None, a, b).ratio() for (i, a) in rows for (j, b) in rows if i != j and 3 not in (i, j))
    assert len(got) == 1 and got[0].members == [1, 2, 4] and abs(got[0].similarity - round(best, 4)) < 2e-4
    assert corpus.similar_pairs(units, "uid", "text", "size", "hash", 0.0, budget=2).count() <= 2
    assert corpus.ratio("return " + "ab " * 74, "ab " * 74) < 0.1 < 0.9 < corpus.ratio("return " + "ab " * 74, "ab " * 74, autojunk=False)


def test_all_pairs_are_decided(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("almond azure beige black blue brown coral cream".split()) for _ in range(rng.randrange(1, 16))) for _ in range(60)]
    texts = sorted({t for b in base for t in (b, b + "s", b[:-1], b[1:] + b[0], "é" + b)})
    rows = [(k, t, len(t), str(k % 280)) for k, t in enumerate(texts)]
    units = spark.createDataFrame([*rows, (9999, None, None, None)], "uid int, text string, size int, hash string")
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if b[2] <= int(a[2] * 1.25) + 8 and a[3] != b[3]]
    want = {(a[0], b[0]): s for a, b in pairs if (s := SequenceMatcher(None, a[1], b[1]).ratio()) >= 0.9}
    got = [tuple(r) for r in corpus.similar_pairs(units, "uid", "text", "size", "hash", budget=None).collect()]
    assert len(want) > 100 and len(got) == len(want) and {(a, b): s for a, b, s in got} == want


def test_registered_clusters_have_no_budget(spark, tmp_path):
    from loomgraph.plans import catalogue

    # 400 short names without a likeness fill the old budget of pairs before the two long ones are met
    names = [f"{k:03}" + "".join(random.Random(k).sample("abcdefghijklmnopqrstuvwxyz", 9)) for k in range(400)]
    long = "a far longer name of a part than all the others have, so that it comes last"
    rows = [(k, n, "b") for k, n in enumerate([*names, long, long + "s"])]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = catalogue.QUERIES["near_dup_clusters"](spark, str(tmp_path)).collect()
    assert "400,401" in {r.members for r in got}


def test_scan(spark):
    docs = spark.createDataFrame([("a.txt", "see /home/me/x and /tmp/y\r\nhttp://localhost:8080/z\n\nC:\\dir"), ("b.txt", "a.home/x\x0b  " + "p" * 200 + " file:///etc/x tail"), ("c.txt", ""), ("d.txt", None)], "path string, text string")
    got = sorted((r.path, r.line, r.rule, r.excerpt) for r in corpus.scan(docs, "path", "text", [*corpus.RULES, *corpus.token_rules(["e/me", " ", "a.b\\E"])]).collect())
    assert [x[:3] for x in got if x[0] == "a.txt"] == [("a.txt", 1, "absolute-posix-path"), ("a.txt", 1, "absolute-posix-path"), ("a.txt", 1, "legacy-token-1"), ("a.txt", 2, "hard-coded-localhost-url"), ("a.txt", 4, "windows-absolute-path")]
    b = [x for x in got if x[0] == "b.txt"]
    assert [x[1:3] for x in b] == [(2, "file-url")] and b[0][3].startswith("...") and len(b[0][3]) <= 186
    found = spark.createDataFrame([("medium",), ("low",)], "severity string")
    assert corpus.severity_gate(found, "medium").first().failed and not corpus.severity_gate(found, "high").first().failed and not corpus.severity_gate(found, "none").first().failed


def test_checklist(spark):
    t = spark.createDataFrame([("1", "a", "DONE", "OK", ""), ("2", "b", "TODO", "PENDING", "x|y")], "task_id string, task string, status string, check string, notes string")
    assert corpus.progress(t).first().percent == 50 and corpus.gate(t).first().gate == "PENDING"
    assert corpus.gate(t.where("task_id = '1'")).first().gate == "PASS" and corpus.gate(t.withColumn("check", F.lit("FAIL"))).first().gate == "FAIL"
    done = spark.createDataFrame([(k, "DONE" if k < 1 else "TODO") for k in range(8)], "k int, status string")
    assert corpus.progress(done).first().percent == 12  # 12.5 goes to even
    assert corpus.progress(t.limit(0)).first().percent == 0
    up = corpus.upsert_tasks(t, spark.createDataFrame([("2", "DONE"), ("3", "TODO")], "task_id string, status string"))
    assert {(r.task_id, r.status, r.task) for r in up.collect()} == {("1", "DONE", "a"), ("2", "DONE", "b"), ("3", "TODO", None)}
    assert corpus.insert_new(t, t.withColumn("status", F.lit("BLOCKED"))).count() == 2 and corpus.delete_keys(t, t.where("task_id = '1'"), "task_id").count() == 1
    assert corpus.invalid_tasks(t.withColumn("check", F.lit("?"))).count() == 2
    md = audits.checklist_markdown("Plan", t)
    assert "Progress: 50%" in md and "x\\|y" in md
    back = files.markdown_tasks(spark.createDataFrame([(x,) for x in md.splitlines()], "value string"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))


def test_reachable(spark):
    deps = spark.createDataFrame([("gw", "sdk"), ("sdk", "core"), ("core", "sdk"), ("core", "log"), ("gw", "log")], "module string, key string")
    mods = spark.createDataFrame([("gw",), ("sdk",), ("core",)], "key string")
    got = {(r.consumer, r.path) for r in corpus.reachable(deps, mods).collect()}
    assert got == {("gw", "gw -> sdk -> core"), ("gw", "gw -> sdk -> core -> sdk"), ("gw", "gw -> sdk -> core -> log"), ("sdk", "sdk -> core -> log"), ("core", "core -> sdk -> core") } - {("core", "core -> sdk -> core")}


def test_components(spark):
    e = spark.createDataFrame([(3, 2), (2, 1), (9, 8), (5, 4), (4, 3)], "a int, b int")
    assert dict(map(tuple, corpus.connected_components(e, "a", "b").collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


JAVA = """package a.b;
/* class Hidden { } */
public class Big {
    private int n; // }
    String s = "{ class X {";
    char c = '{';
    @Transactional
    public int add(int x, int y) throws Exception {
        int a = x + 1;
        int b = y + 2;
        this.n = a + b;
        if (a > b) { return a; }
        for (int i = 0; i < 3; i++) { b += i; }
        return a + b + 10;
    }
    int other(int q, int r) {
        int a = q + 1;
        int b = r + 2;
        int c = a + b;
        if (a > b) { return a; }
        for (int i = 0; i < 3; i++) { b += i; }
        return a + b + c;
    }
""" + "\n".join(f"    int f{k} = {k} + {k};" for k in range(20)) + "\n}\n"


def test_java_units(spark):
    hidden = java_code.masked(JAVA)
    assert len(hidden) == len(JAVA) and hidden.count("\n") == JAVA.count("\n") and hidden.count("{") == hidden.count("}")
    rows = list(java_code.units_of("x/Big.java", JAVA))
    assert [(r["kind"], r["name"]) for r in rows] == [("class", "Big"), ("method", "add"), ("method", "other")]
    add = rows[1]
    assert (add["start_line"], add["end_line"], add["line_count"], add["modifiers"], add["risk_level"]) == (7, 15, 9, ["public"], "high") and add["package"] == "a.b"
    assert [r["uid"] for r in rows] == ["x/Big.java:Big:3", "x/Big.java:Big:add:7", "x/Big.java:Big:other:16"]
    assert java_code.generalised(java_code.tokens("int x = y + 1.5;")) == "int ID = ID + NUM ;"
    copy = JAVA.replace("class Big", "class Two").replace("int other(int q, int r)", "static final long renamed(int q, int r)")
    df = java_code.units(spark.createDataFrame([("x/Big.java", JAVA), ("y/Two.java", copy)], "path string, text string"))
    exact, similar = audits.clone_groups(df, "method")  # names and headers of methods don't count
    assert exact.count() == 2 and similar.count() == 0
    members = corpus.group_members(df.where("kind = 'method'"), exact, "hash_exact")
    advised = audits.advice(members)
    assert {r.risk for r in advised.collect()} == {"high", "low"}
    assert tuple(audits.clone_summary(df, exact).first()) == (2, 4, 2, 2, 4)
    renamed = java_code.units(spark.createDataFrame([("x/Big.java", JAVA), ("y/Two.java", JAVA.replace("class Big", "class Two"))], "path string, text string"))
    assert [r.n for r in audits.clone_groups(renamed, "class")[0].collect()] == [2]  # nor do names of classes
    overview = {r.group_id: r for r in audits.clone_overview(members, advised).collect()}
    assert sorted(r.locations for r in overview.values()) == [["x/Big.java:Big:add:7", "y/Two.java:Two:add:7"], ["x/Big.java:Big:other:16", "y/Two.java:Two:renamed:16"]]


@pytest.mark.parametrize(
    ("signature", "body", "level", "n"),
    [
        ("private int get(Key publicKey, int finalValue)", "{ return finalValue; }", "low", 1), ("void f()", "{ this.n++; }", "high", 1), ("void f()", "{ return this.n + 2; }", "medium", 1),
        ("public void f() throws IOException", "{ }", "medium", 2), ("@Async void f()", "{ }", "high", 1), ("void f()", "{ synchronized (x) { } }", "high", 1),
        ("void f()", "{ save(x); }", "medium", 1), ("void f()", "{ save(x); send(y); }", "high", 1),
    ],
)
def test_risk(signature, body, level, n):
    words = sorted(java_code.MODIFIERS & set(re.findall(r"[A-Za-z_]\w*", signature)))
    got = java_code.risk(signature, body, words)
    assert (got[0], len(got[1])) == (level, n)


def test_modifiers_are_whole_words():
    code = "class A {\n    private int get(Key publicKey, int finalValue) {\n" + "        int x = publicKey.size() + finalValue;\n" * 6 + "        return x;\n    }\n" + "    int a;\n" * 25 + "}\n"
    method = [r for r in java_code.units_of("A.java", code) if r["kind"] == "method"][0]
    assert method["modifiers"] == ["private"] and method["risk_level"] == "low"


def test_java_sources_leave_tests_out(spark, tmp_path):
    for name in ("src/main/A.java", "src/main/ATest.java", "src/main/BTests.java", "src/test/C.java", "build/D.java", "coverage/E.java", "src/main/Testing.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class X { }")
    assert {r.path for r in files.java_files(spark, str(tmp_path)).collect()} == {"src/main/A.java", "coverage/E.java", "src/main/Testing.java"}
    assert files.java_files(spark, str(tmp_path), with_tests=True).count() == 6


def test_tagged_files(spark):
    df = spark.createDataFrame([("a/pom.xml",), ("README.md",), (".github/workflows/x.yml",), ("src/a.kt",), ("Dockerfile",), ("a.bin",)], "path string")
    rows = {r.path: r for r in files.tagged(df).withColumn("is_text", files.is_text_file(F.col("path"))).collect()}
    assert rows["a/pom.xml"].is_manifest and rows["README.md"].is_convention and rows[".github/workflows/x.yml"].is_pipeline and rows["src/a.kt"].language == "Kotlin"
    assert not rows["a.bin"].is_text and rows["Dockerfile"].is_text


def test_path_audit(spark):
    rows = [("k", "1", "m1", "compile", True, "m1 -> k"), ("k", "2", "m2", "compile", False, "m2 -> x -> k"), ("l", "1", "m1", "test", False, "m1 -> l")]
    df = spark.createDataFrame(rows, "key string, value string, module string, scope string, direct boolean, path string")
    got = {(r.kind, r.key): (r.occurrences, r.status) for r in audits.path_audit(df, df, df.where("key = 'l'")).collect()}
    assert got == {("component", "k"): (2, "conflict"), ("effective", "k"): (2, "conflict"), ("hint", "l"): (1, "duplicate")}
    assert [r.value for r in audits.first_wins(df, ["key"], ["value"]).orderBy("key").collect()] == ["1", "1"]
    names = spark.createDataFrame([("k", "Kay")], "key string, name string")
    assert {(r.key, r.name) for r in audits.named(df, "key", names, "name").collect()} == {("k", "Kay"), ("l", "l")}


def test_budget_says_that_it_cut(spark):
    units = spark.createDataFrame([(k, 10, str(k)) for k in range(5)], "uid int, size int, hash string")
    assert tuple(corpus.budget_used(units, "uid", "size", "hash", 9).first()) == (10, True) and tuple(corpus.budget_used(units, "uid", "size", "hash", 10).first()) == (10, False)


def test_deep_trees(spark):
    rows = [("g", k, k, f"n{k}") for k in range(30)]
    got = corpus.tree_parents(spark.createDataFrame(rows, "g string, line int, depth int, name string"), "g", "line", "depth", "name").orderBy("line").collect()
    assert [r.parent for r in got] == [None, *[f"n{k}" for k in range(29)]] and got[-1].tree_path.count("->") == 29


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(5)
    assert audits.markdown_table(df, most=3).endswith("There are more than these 3 rows.\n") and "more than" not in audits.markdown_table(df, most=5)
    assert len(json.loads(audits.json_report(df))) == 5


POM = """<project xmlns="http://maven.apache.org/POM/4.0.0"><groupId>g</groupId><artifactId>{a}</artifactId><version>1</version>
<properties><jdk>{v}</jdk></properties><dependencyManagement><dependencies><dependency><groupId>o</groupId><artifactId>x</artifactId><version>{v}</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>g</groupId><artifactId>{d}</artifactId></dependency></dependencies><build><plugins><plugin><artifactId>p</artifactId><version>2</version></plugin></plugins></build></project>"""


def test_version_audit(spark, tmp_path):
    for a, v, d in (("one", "1.0", "two"), ("two", "2.0", "three"), ("three", "2.0", "lib")):
        (tmp_path / a).mkdir()
        (tmp_path / a / "pom.xml").write_text(POM.format(a=a, v=v, d=d))
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "pom.xml").write_text("<x")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "pom.xml").write_text("<x")
    rows = files.pom_rows(files.pom_files(spark, str(tmp_path)))
    assert rows.where("kind = 'error'").count() == 1
    groups = {(r.kind, r.key): (r.occurrences, r.distinct_values, r.status) for r in audits.version_audit(rows).collect()}
    assert groups == {("property", "jdk"): (3, 2, "conflict"), ("dependency", "o:x"): (3, 2, "conflict"), ("plugin", "org.apache.maven.plugins:p"): (3, 1, "duplicate")}
    assert audits.audit_gate(audits.version_audit(rows)).first().failed
    got = {(r.module, r.key, r.path, r.direct) for r in audits.propagation(rows).collect()}
    assert ("g:one", "g:three", "g:one -> g:two -> g:three", False) in got and ("g:one", "g:lib", "g:one -> g:two -> g:three -> g:lib", False) in got
    profile = audits.repository_profile(files.listing(spark, str(tmp_path)))
    assert profile["totals"].first().files == 4 and profile["extensions"].first().extension == ".xml"
    assert "| jdk |" in audits.markdown_table(audits.version_audit(rows).select("key")) and json.loads(audits.json_report(rows.select("key").limit(2)))


def test_tree_log(spark):
    log = ["[INFO] g:app:jar:1.0", "[INFO] +- a:b:jar:1.0:compile", "[INFO] |  \\- c:d:jar:2.0:test (version managed)", "[INFO] |  +- (e:f:jar:1.0:compile - omitted for conflict with 2.0)", "[INFO] \\- h:i:jar:cls:3.0:runtime", "[INFO] BUILD SUCCESS"]
    tree = files.tree_log(spark.createDataFrame([("l", k, x) for k, x in enumerate(log)], "log string, line int, value string"))
    rows = [tuple(r)[2:] for r in tree.orderBy("line").collect()]
    assert [r[:4] for r in rows] == [(0, "g:app", "1.0", None), (1, "a:b", "1.0", "compile"), (2, "c:d", "2.0", "test"), (2, "e:f", "1.0", "compile"), (1, "h:i", "3.0", "runtime")]
    conflict, rest = files.conflicts_and_rest(tree)
    assert conflict.count() == 1 and rest.count() == 4
    paths = corpus.tree_parents(tree, "log", "line", "depth", "key").orderBy("line").collect()
    assert paths[2].parent == "a:b" and paths[2].tree_path == "g:app -> a:b -> c:d" and paths[4].parent == "g:app"


def test_paged_json(spark, tmp_path):
    def page(n, body):
        (tmp_path / f"page-{n}.json").write_text(body)

    page(1, '{"data": {"list": [{"id": 1}, {"id": 2}], "totalPages": 4}}')
    page(2, "no json")
    page(3, '{"data": {"list": {"id": 3}}}')
    page(4, '{"data": {}}')
    page(5, '{"data": {"list": [9]}}')
    paged_json.register(spark)
    options = {"urlTemplate": f"{tmp_path}/page-{{page}}.json", "dataPath": "data.list"}
    read = lambda **o: spark.read.format("paged_json").options(**options, **o).load().collect()
    rows = read(totalPagesPath="data.totalPages")
    assert sorted((r.page, r.item) for r in rows if r.item) == [(1, '{"id":1}'), (1, '{"id":2}'), (3, '{"id":3}')] and [r.page for r in rows if r.error] == [2]
    assert {r.page for r in read()} == {1, 2, 3}  # the empty page ends the run
    assert {r.page for r in read(mode="current", currentPage="3")} == {3}
    assert {r.page for r in read(maxPages="2")} == {1, 2}
    assert {r.page for r in read(totalPagesPath="data.nope", maxPages="6") if r.item} == {1, 3, 5}  # empty pages don't end it
    pages.collect(spark, options, str(tmp_path / "items"), str(tmp_path / "errors"), f"file://{tmp_path}/state", None)
    items = spark.read.parquet(str(tmp_path / "items"))
    assert items.count() == 3 and spark.read.parquet(str(tmp_path / "errors")).select("page").first()[0] == 2
    pages.export_array(items, str(tmp_path / "all.json"))
    assert json.loads((tmp_path / "all.json").read_text()) == [{"id": 1}, {"id": 2}, {"id": 3}]


def test_headers():
    assert paged_json.header_map('{"A": "b"}') == {"A": "b"} == paged_json.header_map("A: b\n\n") and paged_json.header_map("") == {}


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a":[{"b":1},{"b":"x"}],"n":"7","z":null}',), ("broken",), ('{"a":{"b":5}}',)], "j string")
    got = [tuple(r) for r in df.select(json_paths.at_path(F.col("j"), "a.1.b"), json_paths.positive_number(F.col("j"), "n"), json_paths.elements(F.col("j"), "a"), json_paths.elements(F.col("j"), "z")).collect()]
    assert got == [("x", 7.0, ['{"b":1}', '{"b":"x"}'], []), (None, None, [], []), (None, None, ['{"b":5}'], [])]
    assert json_paths.get({"a": [{"0": 5}]}, "a.0.0") == 5 and json_paths.get([1], "3") is None


def test_text_functions(spark):
    df = spark.createDataFrame([("Hello, World!", "\x1b[31m[INFO] x\x1b[0m", "T-1:: do :: it", "src/test/java/AbcTest.java")], "a string, b string, c string, d string")
    ident, rest = text.id_and_text(F.col("c"))
    r = df.select(text.slug(F.col("a")), text.plain_log_line(F.col("b")), ident, rest, text.is_test_file(F.col("d")), text.extension(F.col("d")), text.version_or_implicit(F.lit(" "))).first()
    assert tuple(r) == ("hello-world", "x", "T-1", "do :: it", True, ".java", "(managed/implicit)") and text.slug_of("!!").startswith("item-")
    log = "[INFO] a\n\x1b[1m[ERROR] bad\x1b[0m\n[INFO] BUILD FAILURE\n[ERROR] Operation not permitted: x\n[INFO] BUILD FAILURE"
    assert text.summary_of_errors(log) == "BUILD FAILURE | Operation not permitted: x"
    assert text.summary_of_errors("\n".join(f"[INFO] line {k}" for k in range(20)), 3) == "line 0 | line 1 | line 2" and text.summary_of_errors("") == ""
    causes = "\n".join(c for c in text.CAUSES)
    assert text.summary_of_errors(causes, 4).endswith(" | ... (truncated)")


def test_build_tasks(spark):
    df = spark.createDataFrame([("build:all",), ("deploy",), ("unit-test: x",), ("rebuild",), ("Lint",)], "t string")
    got = [tuple(r) for r in df.select(text.is_safe_task(F.col("t")), text.make_target(F.col("t"))).collect()]
    assert got == [(True, None), (False, None), (True, "unit-test"), (False, None), (True, None)]
    paths = spark.createDataFrame([("a/tests/x.py",), ("a/test_x.py",), ("a/x_test.go",), ("a/latest/x.py",), ("a/x.spec.ts",), ("contest.java",)], "p string")
    assert [r[0] for r in paths.select(text.is_test_file(F.col("p"))).collect()] == [True, True, True, False, True, True]
