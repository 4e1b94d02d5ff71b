from pyspark.sql import functions as F

from codestrata.functions import services as sv
from codestrata.operators import discovery, edges

COMPOSE = """services:
  api:
    build:
      context: .
    depends_on: [db, "users"]
  users:
    environment:
      USERS_API: http://api-service:80
  # note
volumes:
  data:
"""


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_compose_section_ends_at_unindented_line(make_files):
    text = "services:\n  api:\n    build: .\nvolumes:\n  data:\n"
    assert rows(discovery.svc_compose(make_files(("docker-compose.yml", text))), "name", "confidence") == [("api", 0.8)]


def test_merge_keeps_best_and_all_evidence(make_files):
    files = make_files(("services/api/main.go", "package main"), ("cmd/x/main.go", ""),
                       ("docker-compose.yml", "services:\n  api:\n    image: x\n"))
    merged = {r.name: r for r in discovery.merge_candidates(discovery.service_candidates(files)).collect()}
    assert merged["api"].confidence == 0.9
    assert merged["api"].detection_types == "main_go,docker_compose,directory"
    assert merged["api"].n_evidence == 3


def test_language_counts_any_path_with_the_prefix(make_files):
    files = make_files(("services/pay/notes.txt", ""), ("services/pay-gw/a.py", ""))
    got = {r.name: r.language for r in discovery.svc_directory(files).collect()}
    assert got == {"pay": "Python", "pay-gw": "Python"}


def test_single_main_needs_a_service_like_path(make_files):
    assert discovery.svc_main_go(make_files(("tool/main.go", ""))).count() == 0
    assert rows(discovery.svc_main_go(make_files(("worker/main.go", ""))), "name", "confidence") == [("worker", 0.7)]


def services_of(spark, *names):
    return spark.createDataFrame([("p", n, "http") for n in names], "project string, name string, api_type string")


def test_compose_edges(spark, make_files):
    files = make_files(("docker-compose.yml", COMPOSE))
    alias = edges.aliases(services_of(spark, "api", "users"))
    assert rows(edges.edge_depends_on(files, alias), "from", "to", "confidence") == [("api", "users", 1.0)]
    assert rows(edges.edge_compose_env(files, alias), "from", "to", "confidence") == [("users", "api", 0.9)]


def test_config_edge_trims_suffix(spark, make_files):
    files = make_files(("x/services/pay/.env", "USER_SERVICE_URL=http://users-service:8080\n"))
    alias = edges.aliases(services_of(spark, "pay", "users"))
    assert rows(edges.edge_config(files, alias), "from", "to", "confidence") == [("pay", "users", 0.8)]


def test_root_level_owner(spark, make_files):
    files = make_files(("cmd/pay-service/main.go", 'http.Get("http://users:80/a")'), ("other/a.go", 'http.Get("http://users:80/a")'))
    alias = edges.aliases(services_of(spark, "pay", "users"))
    assert rows(edges.edge_network(files, alias), "from", "to") == [("pay", "users")]


def test_localhost_and_addresses_are_no_edges(spark, make_files):
    files = make_files(("cmd/pay/a.go", 'http.Get("http://localhost:80/a")'), ("cmd/pay/b.go", 'grpc.Dial("10.0.0.1:50")'))
    alias = edges.aliases(services_of(spark, "pay", "localhost", "10.0.0.1"))
    assert edges.edge_network(files, alias).count() == 0


def test_dedup_key_is_unique(spark):
    df = spark.createDataFrame([("p", "a", "b", "config", "x", "f2", 0.8), ("p", "a", "b", "config", "y", "f1", 0.9)],
                               "project string, `from` string, `to` string, evidence_type string, evidence string, file_path string, confidence double")
    assert rows(edges.dedup_edges(df), "evidence", "confidence") == [("y", 0.9)]


def test_url_facts(spark):
    urls = ["https://github.com/o/r.git", "https://tok@github.com/o/r", "git@github.com:o/r.git", "https://x.org/a/b/c", "ftp x:y", "https://x.org"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r for r in sv.repo_url_facts(df, "url").collect()}
    first = got[urls[0]]
    assert (first.owner, first.name, first.safe_key, first.is_valid) == ("o", "r", "o-r", True)
    assert got[urls[1]].masked_url == "https://***@github.com/o/r"
    assert got[urls[2]].clone_url == "https://github.com/o/r.git"
    assert got[urls[3]].safe_key == "x-org-a-b"
    assert got[urls[4]].safe_key == "ftp_x-y"
    assert got[urls[5]].safe_key == "x-org"


def test_names(spark):
    df = spark.createDataFrame([("services/user-auth-service",)], "p string")
    row = df.select(sv.display_name("p").alias("d"), sv.service_purpose(F.lit("x-orders"), F.lit("http")).alias("q"),
                    sv.service_purpose(F.lit("zed"), F.lit("grpc")).alias("g"), sv.service_kind(F.lit("billing")).alias("k"),
                    sv.service_of_import(F.lit("a/clients/userservice")).alias("i"), sv.port_of(F.lit('":8080"')).alias("port")).first()
    assert row.d == "User Auth"
    assert row.q == "Manages order processing and fulfillment"
    assert (row.g, row.k, row.i, row.port) == ("gRPC service: zed", "Payment", "user", "8080")
