"""Findings, data rights, supply chain, contamination, code, sources, reports and streaming on literal rows."""

import datetime

from pyspark.sql import functions as F

from quillscan.operators import code, contamination, data_rights, findings, supply_chain
from quillscan.plans import reports
from quillscan.plans.scan import detect, scan
from quillscan.sources import files
from quillscan.streaming.scan_stream import stream_documents, windowed_counts


def make(spark, rows):
    return spark.createDataFrame([(k, "p", t, f, s, r, c, e) for k, (t, f, s, r, c, e) in enumerate(rows)], findings.FINDING)


def test_correlation_and_deduplication(spark):
    found = make(spark, [("MissingAttribution", "a", "Medium", 2, 0.6, "x"), ("StrippedLicense", "a", "Medium", 2, 0.9, None), ("LockfileStaleness", "a", "Low", 1, 0.4, "y"), ("MissingAttribution", "a", "Low", 1, 0.7, "z"), ("StrippedLicense", "b", "High", 3, 0.5, "q")])
    out = {r.ord: r for r in findings.correlate(found).collect()}
    assert [out[k].corroborated for k in range(5)] == [True, True, False, True, False]
    assert (out[0].severity, out[3].severity, out[1].confidence) == ("High", "Low", 1.0)
    merged = {(r.file, r.vtype): r for r in findings.deduplicate(found).collect()}
    first = merged["a", "MissingAttribution"]
    assert (first.ord, first.severity, first.confidence, first.evidence, first.merged) == (0, "Medium", 0.7, "x; z", 2)
    counts = findings.severity_counts(found).first()
    assert (counts.total, counts.low, counts.medium, counts.high, counts.critical) == (5, 2, 2, 1, 0)


def test_policy(spark):
    found = make(spark, [("PiiExposure", "src\\vendor\\x", "High", 3, 0.6, None), ("PiiExposure", "y", "High", 3, 0.6, None), ("Custom", "y", "Low", 1, 0.6, None)])
    kept = findings.apply_policy(found, findings.Policy(min_severity=2, ignored_paths=["vendor/"])).collect()
    assert [r.file for r in kept] == ["y"]


def test_scores(spark):
    def score(rows, **policy):
        return tuple(findings.risk_score(make(spark, rows), findings.Policy(**policy)).first())

    assert score([]) == (0, "Clean")
    assert score([("NetworkServiceWithoutDisclosure", "a", "Critical", 4, 1.0, None)], network_service=True) == (100, "Critical")
    assert score([("CopyleftInProprietary", "a", "Critical", 4, 0.95, None)], commercial=True)[0] >= 50
    assert len(findings.type_rows()) == 77


def test_evidence_follows_order(spark):
    found = make(spark, [("Custom", "a", "Low", 1, 0.5, "x"), ("PiiExposure", "a", "High", 3, 0.5, "y")])
    again = findings.evidence_chain(found.repartition(3), "t", "s").first()
    assert again == findings.evidence_chain(found, "t", "s").first() and again["items"] == 2


def test_personal_data_probes(spark):
    rows = spark.createDataFrame([("user@example.com",), ("data,user@test.org,more",), ("no emails here",), ("192.168.1.1",), ("log: 10.0.0.1 connected",), ("version 1.2.3.4.5",), (None,)], "t string")
    got = rows.select(data_rights.has_email(F.col("t")).alias("e"), data_rights.has_ipv4(F.col("t")).alias("i")).collect()
    assert [r.e for r in got] == [True, True, False, False, False, False, False]
    assert [r.i for r in got] == [False, False, False, True, True, False, False]


def test_secrets_and_columns(spark):
    text = "ok\nkey AKIA" + "A" * 16 + "\npassword = hunter2\n"
    got = data_rights.secret_lines(spark.createDataFrame([(1, "p", text)], "ord long, path string, text string")).collect()
    assert [(r.line_no, r.secret) for r in got] == [(2, "AWS Access Key"), (3, "Assigned secret")]
    row = spark.createDataFrame([("name,email,phone\nJohn,j@x.com,5\n",)], "t string").select(data_rights.header_columns(F.col("t")).alias("c")).first()
    assert row.c == ["name", "email", "phone"]


def test_supply_chain(spark):
    deps = spark.createDataFrame([("npm", "lodahs", "^4"), ("npm", "lodash", "4.1"), ("npm", "request", "=2.0")], "ecosystem string, name string, version_spec string")
    assert [(r.name, r.popular, r.distance) for r in supply_chain.typosquats(deps).collect()] == [("lodahs", "lodash", 2)]
    assert sorted((r.name, r.flag) for r in supply_chain.flagged(deps).collect()) == [("lodahs", "unpinned"), ("request", "deprecated")]
    go = spark.createDataFrame([("go.sum", "a.b/c v1.0.0 h1:x=\na.b/c v1.0.0/go.mod h1:y=\n")], "path string, text string")
    assert [(r.name, r.version_spec) for r in supply_chain.go_requirements(go).collect()] == [("a.b/c", "v1.0.0")]
    urls = spark.createDataFrame([("npm", "@t/n", "1"), ("crates", "serde", None)], "e string, n string, v string").select(supply_chain.purl(F.col("e"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in urls] == ["pkg:npm/%40t/n@1", "pkg:cargo/serde"]


def test_contamination(spark):
    nodes = spark.createDataFrame([("my-app", "MIT", "Static"), ("lib-a", "GPL-3.0-only", "Static"), ("lib-b", "LGPL-2.1-only", "Dynamic")], "name string, licence string, linking string")
    edges = spark.createDataFrame([("my-app", "lib-a"), ("my-app", "lib-b")], "src string, dst string")
    assert [tuple(r) for r in contamination.contaminated(nodes, edges).collect()] == [("my-app", "lib-a", "StrongCopyleft", 1)]


def test_contamination_has_no_depth_bound_and_stops_at_boundaries(spark):
    names = [f"p{k}" for k in range(36)]
    rows = [("p0", "GPL-3.0-only", "Static"), *((n, "MIT", "Static") for n in names[1:]), ("ipc", "MIT", "IpcNetwork"), ("behind", "MIT", "Static"), ("gpl", "GPL-2.0-only", "Dynamic"), ("above", "MIT", "Static")]
    nodes = spark.createDataFrame(rows, "name string, licence string, linking string")
    edges = spark.createDataFrame([*zip(names[1:], names), ("p1", "p3"), ("ipc", "p0"), ("behind", "ipc"), ("gpl", "p0"), ("above", "gpl")], "src string, dst string")
    got = {(r.package, r.source): r.depth for r in contamination.contaminated(nodes, edges).collect() if r.source == "p0"}
    assert got == {(n, "p0"): k for k, n in enumerate(names) if k} | {("above", "p0"): 2}


def test_code(spark):
    rows = spark.createDataFrame([(1, "a", "x = 1 // c\n/* d */ Y('//s')\n"), (2, "b", "X =   1 y('//s')")], "ord long, path string, text string")
    got = code.fingerprint(rows).collect()
    assert got[0].normal_hash == got[1].normal_hash
    assert spark.createDataFrame([("aabb",)], "t string").select(code.byte_entropy("t").alias("e")).first().e == 1.0
    html = spark.createDataFrame([("<a href='x'> fetch(\"https://e.com/a\") <img src=\"y\">",)], "t string")
    got = html.select(code.links(F.col("t")).alias("l"), code.endpoints(F.col("t")).alias("e")).first()
    assert (got.l, got.e) == (["x", "y"], ["https://e.com/a"])


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("fn main() {}")
    (tmp_path / "LICENSE").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert (got["a.rs"].category, got["a.rs"].text, got["LICENSE"].category, got["LICENSE"].text) == ("SourceCode", "fn main() {}", "License", None)
    spec = spark.createDataFrame([("npm:@s/p@1.0",), ("pip:numpy",)], "s string").select(files.package_spec(F.col("s")).alias("p")).collect()
    assert [tuple(r.p) for r in spec] == [("npm", "@s/p", "1.0"), ("pypi", "numpy", None)]


def test_scan_and_reports(spark):
    rows = spark.createDataFrame([(1, "a.txt", "mail me: bob@example.com, GNU General Public License version 3"), (2, "b.txt", "nothing"), (3, "c.txt", None)], "ord long, path string, text string")
    found = scan(rows)
    assert sorted((r.vtype, r.file) for r in found.collect()) == [("CopyleftInProprietary", "a.txt"), ("PiiExposure", "a.txt")]
    assert {r.rule: r.level for r in reports.sarif_rules(found).collect()} == {"CopyleftInProprietary": "error", "PiiExposure": "error"}


def test_streaming(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12, 3)
    spark.createDataFrame([(1, "bob@example.com", at), (2, "10.0.0.1", at), (3, "x", at)], "doc_id long, text string, arrived timestamp").write.parquet(str(tmp_path / "in"))
    q = windowed_counts(stream_documents(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.kind, r.n) for r in spark.table("seen").collect()) == [("email", 1), ("ip", 1)]


def test_map_data_and_secrets_of_every_kind(spark):
    keys = ["AKIA" + "B" * 16, "ghp_" + "c" * 36, "sk_live_" + "d" * 24, "-----BEGIN EC PRIVATE KEY-----"]
    text = "\r\n".join([*keys, f"token: {keys[0]}", "plain"])
    rows = spark.createDataFrame([(1, "a", text), (2, "b", "tiles of OSM and OpenStreetMap, api.mapbox.com, census.gov"), (3, "c", ""), (4, "d", None)], "ord long, path string, text string")
    got = sorted((r.ord, r.line_no, r.secret, r.redacted) for r in data_rights.secret_lines(rows).collect())
    assert [g[:3] for g in got] == [(1, 1, "AWS Access Key"), (1, 2, "GitHub Personal Token"), (1, 3, "Stripe Live Key"), (1, 4, "EC Private Key"), (1, 5, "AWS Access Key"), (1, 5, "Assigned secret")]
    assert got[0][3] == "AKIABBBB..." and got[2][3] == "sk_live_...dddd"
    assert sorted((r.ord, r.provider, r.attribution) for r in data_rights.geodata(rows).collect()) == [(2, "CensusGov", False), (2, "Mapbox", True), (2, "OpenStreetMap", True)]
    found = detect(rows).collect()
    assert sorted((r.ord, r.file, r.vtype, r.evidence) for r in found if r.file != "a") == [(2_000_000, "b", "UnlicensedGeodata", "OpenStreetMap"), (2_000_001, "b", "UnlicensedGeodata", "Mapbox"), (2_000_002, "b", "UnlicensedGeodata", "CensusGov")]
    assert [r.vtype for r in found if r.file == "a"] == ["ExposedSecrets"] * 6
    assert len({r.ord for r in found}) == len(found)


def test_cosines_of_odd_vectors(spark, tmp_path):
    """Cells of matrix products give what the column expression gives, with other lengths, zeros, nulls and infinities."""
    import random

    from quillscan import catalog
    from quillscan.functions import text as T

    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(120)]
    rows += [(150, [0.0] * 8), (151, None), (152, [1.0, None] * 4), (153, [float("inf")] + [1.0] * 7), (154, [float("nan")] * 8), (155, []), (156, [1.0, 2.0]), (200, [3.0, 1.0]), (250, None), (300, []), (None, [1.0] * 8), (157, [1e200] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    a, b = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), df
    want = a.join(b, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.round(T.cosine(F.col("q"), F.col("embedding")), 5).alias("cosine"))
    got = catalog.QUERIES["embedding_cosine"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().toString()  # no product pair by pair
