"""Views that shape the test tables like a file corpus.

``corpus``    documents -> files(project, path, content)
``web``       pages     -> files(project, path, content) plus the page url
``repos``     part      -> files(project, path, content): every run of 48 parts
              is one project and every part is one file of it.  Each third
              project is folded into the project ``hub``, so that one key holds
              a third of all rows.
``progress``  events    -> progress(run_id, seq, ts, type, stage, progress)

The expressions of ``repos`` use only functions and literals that Spark SQL and
ANSI SQL engines read alike; a checker can therefore build the same files from
the same text.  In the templates ``~`` is a line break, ``%`` a dollar sign and
``@A`` .. ``@D`` are service names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.session import cut_lineage

SLOTS = 48

SERVICE_NAMES = "users,auth,payments,orders,catalog,gateway,search-api,mailer"


def _service(offset: int) -> str:
    return (f"split_part('{SERVICE_NAMES}', ',', "
            f"CAST((blk + {offset}) % 8 AS INT) + 1)")


LEVELS: list[list[str]] = [
    [
        "p_name", "p_brand", "p_type", "p_size",
        f"CAST((p_partkey - p_partkey % {SLOTS}) / {SLOTS} AS BIGINT) AS blk",
        f"CAST(p_partkey % {SLOTS} AS INT) AS slot",
    ],
    [
        "p_name", "p_brand", "p_type", "p_size", "blk", "slot",
        "CASE WHEN blk % 3 = 0 THEN 'hub' ELSE 'proj_' || CAST(blk AS STRING) END AS project",
        "CASE WHEN blk % 3 = 0 AND blk > 0 THEN 'team' || CAST(blk AS STRING) || '/' ELSE '' END AS prefix",
        f"{_service(0)} AS a", f"{_service(1)} AS b", f"{_service(2)} AS c",
        f"{_service(3)} AS d",
    ],
]

PATHS = {
    0: "services/@A/main.go",
    1: "services/@B/main.go",
    2: "cmd/@C/main.go",
    3: "docker-compose.yml",
    4: "package.json",
    5: "web/package.json",
    6: "apps/@D/package.json",
    7: "apps/@D/src/index.js",
    8: ".env",
    9: "services/@A/.env",
    10: "services/@B/config.yaml",
    11: "deploy/services/@A/deployment.yaml",
    12: "README.md",
    13: "Makefile",
    14: "migrations/001_create_users.sql",
    15: "migrations/002_add_orders.sql",
    16: "migrations/003_alter_users.sql",
    17: "migrations/004_objects.sql",
    18: "db/migrations/010_legacy.sql",
    19: ".gitignore",
    20: "var/@A.log",
    21: "var/keep.log",
    22: "build/out.js",
    23: "node_modules/lib/index.js",
    24: "src/components/App.jsx",
    25: "src/a.css",
    26: "src/b.css",
    27: "public/index.html",
    28: "src/router/a.go",
    29: "server/app.py",
    30: "package-lock.json",
    31: "data/seed.sql",
    32: "test/fixtures/user_fixture.json",
    33: "assets/logo.png",
    34: "deep/a/b/c/d/e/f/g/h/i/x.go",
    35: "secrets.yaml",
    36: "id_rsa",
    37: "notes/todo.md",
    38: "main.go",
    39: "services/@A/models/user.rb",
    40: "notebooks/a.ipynb",
    41: "infra/main.tf",
    42: "lib/util.ts",
    43: "tests/util_test.py",
    44: "docs/guide.md",
    45: "config.json",
    46: "application.properties",
    47: "svc-@B/.env",
}

CONTENTS = {
    0: 'package main~~import "net/http"~import client "github.com/acme/mono/services/@B/pkg/client"~~// @A serves requests~type Server struct{}~func main() {~  http.HandleFunc("/", h)~  http.ListenAndServe(":80@K", nil)~  r := http.Get("http://@C-service:8080/api/v1")~  return r~}~',
    1: 'package main~~import "google.golang.org/grpc"~import pb "github.com/acme/mono/internal/clients/@Cservice"~~func main() {~  s := grpc.NewServer()~  u := @Apb.NewAuthClient(conn)~  conn := grpc.Dial("@D-service:50051")~}~',
    3: 'version: "3"~services:~  @A:~    build: ./services/@A~    depends_on:~      - @B~      - redis~    environment:~      - @U_SERVICE_URL=http://@C-service:8080~      - LOG=info~  @B:~    image: mono/@B~    depends_on: @C~    environment:~      CATALOG_API: http://@D:9090~      TOKEN: %{API_TOKEN:none}~  @C:~    build: .~    depends_on: [@A, @B]~  # storage~  redis:~    image: redis~    ports:~      - 6379~networks:~  default:~    driver: bridge~',
    5: '{~  "name": "web",~  "scripts": {"dev": "vite", "build": "vite build"},~  "dependencies": {"react": "18", "react-dom": "18", "vite": "5"}~}~',
    6: '{~  "name": "@D",~  "scripts": {"start": "node index"},~  "dependencies": {"express": "4", "apollo-server": "3"}~}~',
    7: 'const express = require("express")~const app = express()~// @D entry~app.get("/", h)~app.listen(3000)~',
    8: '# settings~OPENAI_API_KEY=~API_KEY=your_key~DB_URL=postgres://db.internal:5432/app~JWT_SECRET=""~PORT=3000~SMTP_HOST=localhost~export PATH_@K=~',
    9: '@U_SERVICE_URL=http://@B-service:8080~PAY_GRPC_ADDR=grpc://service-@C:50051~REDIS_URL=~DATABASE_URL=changeme~MODE=fast~',
    10: 'server:~  db: %{DB_URL:postgres}~  key: %API_KEY~  env: STRIPE_TOKEN~  password: ""~  timeout: 30~  client_secret: your_secret~  # token: none~  host:~',
    11: 'apiVersion: apps/v1~kind: Deployment~metadata:~  name: @A~spec:~  env:~    - name: @U_SERVICE_URL~      value: http://@B~    - name: LOG_LEVEL~      value: info~',
    12: '# Project @A~~Run make run-@A and go run ./cmd/@C~~docker-compose up @B~npm run dev starts the dev server~go run main.go~',
    13: 'build:~  go build ./...~run-@A:~  go run ./cmd/@C~start-@B:~  docker-compose up @B~build-worker:~  go build~build-test:~  true~@D-build:~  true~up:~  docker-compose up all~',
    14: "CREATE TABLE users (~  id UUID PRIMARY KEY,~  email TEXT UNIQUE NOT NULL,~  balance numeric(10, 2) DEFAULT 0,~  kind varchar(20) CHECK (kind IN (^a^, ^b^)) -- kinds~);~/* second */~CREATE TABLE IF NOT EXISTS teams (id INT, name TEXT, PRIMARY KEY (id), UNIQUE (name, id));~CREATE TABLE users (other INT);~",
    15: "CREATE TABLE orders (~  id BIGINT PRIMARY KEY,~  user_id UUID NOT NULL REFERENCES users(id),~  team_id INT,~  note TEXT DEFAULT ^none^,~  CONSTRAINT fk_team FOREIGN KEY (team_id) REFERENCES teams (id)~);~CREATE TABLE tmp_@K (a INT);~DROP TABLE tmp_@K;~INSERT INTO orders VALUES (1);~",
    16: "ALTER TABLE users ADD COLUMN created_at TIMESTAMP NOT NULL;~ALTER TABLE users DROP COLUMN email;~ALTER TABLE orders ALTER COLUMN note TYPE VARCHAR(64);~ALTER TABLE orders ADD CONSTRAINT uq_note UNIQUE (note);~ALTER TABLE audit_@K ADD COLUMN user_id UUID;~",
    17: "CREATE TYPE mood AS ENUM (^sad^, ^ok^, ^happy^);~CREATE INDEX idx_orders_user ON orders (user_id);~CREATE UNIQUE INDEX idx_users_id ON users (id, kind);~CREATE VIEW active_users AS SELECT id FROM users;~CREATE VIEW old_users AS SELECT id FROM users;~DROP VIEW IF EXISTS old_users;~",
    18: "create table items (~  id serial primary key,~  order_id bigint references orders(id),~  parent_id int references items(id),~  tags text[]~);~create table loops_x (id int, y_id int references loops_y(id));~create table loops_y (id int, x_id int references loops_x(id));~drop table teams_@K;~create table broken_@K;~alter table items add constraint fk_order foreign key (order_id) references orders (id);~",
    19: '# ignore~*.log~!keep.log~/secret/~docs/**~tmp?~build/~src/*.css~!b.css~',
    20: 'log @A~',
    21: 'log kept~',
    22: 'var x = 1~',
    23: 'module.exports = 1~',
    24: 'import React from "react"~export const App = () => null~',
    25: '.a { color: red }~',
    26: '.b { color: blue }~',
    27: '<!DOCTYPE html>~<html><body>@A</body></html>~',
    28: 'package router~',
    29: '# server for @A~from flask import Flask~app = Flask(__name__)~class Handler:~    pass~def main():~    app.run()~',
    30: '{"lockfileVersion": 2}~',
    31: 'INSERT INTO users VALUES (1);~',
    32: '{"id": @K}~',
    33: 'PNG~',
    34: 'package x~',
    35: 'password: hunter2~',
    36: 'PRIVATE~',
    37: 'todo @A~password: @K~x_token=@K~const a = @K~token := f("k")~api_key~',
    39: 'class User~  SECRET = 1~end~',
    40: '{"cells": []}~',
    41: 'resource "aws_instance" "web" {}~',
    42: '// helpers~import { x } from "lodash"~export function util() { return @K }~',
    43: 'def test_util():~    assert True~',
    44: '# Guide @A~~See docs.~',
    45: '{~  "url": "%{SERVICE_HOST}",~  "api_token": "todo",~  "name": "@A"~}~',
    46: 'app.name=@A~app.password=~# app.key=~db.user = <user>~',
    47: 'SVC_KEY=~API_KEY=todo~NAME=@B~',
}

# Slots whose content also depends on the project number.
VARIANTS = {
    2: ("blk % 3", [
        'package main~~import "github.com/99designs/gqlgen/handler"~func main() { serve("/graphql") }~',
        'package main~~import "database/sql"~// worker @C~func main() { sql.Open("x") }~',
        'package main~~import "github.com/gin-gonic/gin"~func main() {~  r := gin.Default()~  r.Run(":90@K")~}~',
    ]),
    4: ("blk % 4", [
        '{~  "name": "root",~  "scripts": {"start": "react-scripts start"},~  "dependencies": {"react": "18"}~}~',
        '{~  "name": "root",~  "scripts": {"server": "node server"},~  "dependencies": {"express": "4"}~}~',
        '{~  "name": "root",~  "scripts": {"dev": "next dev"},~  "dependencies": {"next": "14", "express": "4"}~}~',
        '{~  "name": "root",~  "private": true~}~',
    ]),
    38: ("blk % 2", [
        'package main~// entry of @A~func main() {}~',
        'package main~~import "fmt"~func main() { fmt.Println("@K") }~',
    ]),
}


def _case(key: str, arms: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(arms.items()))
    return f"CASE {key} {whens} ELSE '' END"


def _fill(template: str) -> str:
    out = template
    for mark, value in [
        ("'~'", "chr(10)"), ("'%'", "chr(36)"), ("'^'", "chr(39)"),
        ("'@A'", "a"), ("'@B'", "b"), ("'@C'", "c"), ("'@D'", "d"),
        ("'@U'", "upper(b)"), ("'@K'", "CAST(10 + blk % 80 AS STRING)"),
    ]:
        out = f"replace({out}, {mark}, {value})"
    return out


_arms = {k: f"'{v}'" for k, v in CONTENTS.items()}
for _slot, (_key, _texts) in VARIANTS.items():
    _arms[_slot] = _case(_key, {i: f"'{t}'" for i, t in enumerate(_texts)})

# Kinds of file by the comment that closes them; its text and length come from the part.
_SLASHES, _HASHES, _DASHES, _PROSE = (0, 1, 2, 7, 22, 23, 24, 28, 34, 38, 42), (8, 9, 10, 13, 29, 39, 43, 46, 47), (14, 15, 16, 17, 18), (12, 37, 44)


def _slots(numbers: tuple[int, ...]) -> str:
    return "slot IN (" + ", ".join(map(str, numbers)) + ")"


_TAIL = (f"CASE WHEN {_slots(_SLASHES)} THEN repeat('// ' || p_type || ' ' || p_brand || chr(10), p_size) "
         f"WHEN {_slots(_HASHES)} THEN repeat('# ' || p_name || ' ' || p_type || chr(10), p_size) "
         f"WHEN {_slots(_DASHES)} THEN repeat('-- ' || p_name || ' of size ' || CAST(p_size AS STRING) || chr(10), p_size) "
         f"WHEN {_slots(_PROSE)} THEN repeat(p_name || ', ' || p_type || ' ' || p_brand || chr(10), p_size * 20) ELSE '' END")

LEVELS.append([
    "project", "blk", "prefix", "a", "b", "c", "d", "slot", "p_size", f"{_TAIL} AS tail",
    "CASE WHEN slot IN (37, 42, 44) THEN lower(replace(replace(p_brand, '#', '-'), ' ', '-')) || '/' ELSE '' END AS shelf",
    _case("slot", {k: f"'{v}'" for k, v in PATHS.items()}) + " AS path_t",
    _case("slot", _arms) + " AS content_t",
])
LEVELS.append([
    "project",
    f"prefix || shelf || {_fill('path_t')} AS path",
    f"{_fill('content_t')} || tail AS content",
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = table(spark, sf_dir, "documents")
    return doc.select(
        F.col("source").alias("project"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("text").alias("content"),
    )


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "pages")
    rest = F.regexp_replace("url", r"^[a-zA-Z]+://", "")
    host = F.substring_index(F.substring_index(rest, "/", 1), ":", 1)
    return page.select(
        "page_id", "url",
        F.lower(host).alias("project"),
        F.regexp_replace(rest, r"^[^/]*/?", "").alias("path"),
        F.col("html").alias("content"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once for each session and folder: a table of files like any other, with columns to prune.

    A few narrow bytes of each part become a whole file, so the parts are spread before they grow.
    """
    sc = spark.sparkContext
    made = sc.__dict__.setdefault("_codestrata_repos", {})
    if sf_dir not in made:
        df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        df = df.repartition(sc.defaultParallelism)
        for level in LEVELS:
            df = df.selectExpr(*level)
        made[sf_dir] = cut_lineage(df)
    return made[sf_dir]


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_progress(table(spark, sf_dir, "events"))


def shape_progress(events: DataFrame) -> DataFrame:
    """Batch and streaming share this projection of the events table."""
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "complete")
        .otherwise("progress").alias("type"),
        F.col("event_type").alias("stage"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("progress"),
    )
