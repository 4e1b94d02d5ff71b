"""Service dependency edges.

Each producer extracts reference tokens inside the scan (one row per match).
Owners are resolved once per distinct owner key of a project, not per file, and
targets are semi-joined with the alias table.  Both joins are equi joins whose
right side has one row per key, so a hot token only makes the left side large
and adaptive execution may split it; the final dedup is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions import fixed, services as sv, text
from codestrata.operators.discovery import lines_of

EDGE = ["project", "from", "to", "evidence_type", "evidence", "file_path", "confidence"]


def aliases(services: DataFrame) -> DataFrame:
    """Names a service is referred to by."""
    name = F.col("name")
    forms = F.array(name, F.concat(name, F.lit("-service")), F.translate(name, "-", "_"))
    return services.select("project", F.explode(forms).alias("alias")).distinct()


# --- owners -----------------------------------------------------------------------

def owner_key(path: Column | str) -> Column:
    """Owner candidates of a path in order of preference, joined by a slash."""
    segs = text.segments(path)
    nexts = lambda word, make: F.flatten(F.transform(
        F.slice(segs, F.lit(1), F.size(segs) - 1),
        lambda s, i: F.when(s == word, make(F.get(segs, i + 1))).otherwise(F.array().cast("array<string>"))))
    cmd = nexts("cmd", lambda s: F.array(sv.trim_service(s), s))
    services = nexts("services", lambda s: F.array(s))
    return F.array_join(F.concat(cmd, services), "/")


def resolve_owners(refs: DataFrame, alias: DataFrame) -> DataFrame:
    """Replace the owner key of a reference by the first candidate that is a service."""
    keyed = refs.filter(F.col("owner_key") != "")
    keys = keyed.select("project", "owner_key").distinct()
    owners = (keys.select("project", "owner_key", F.posexplode(F.split("owner_key", "/")).alias("rank", "alias"))
              .join(alias, ["project", "alias"], "left_semi")
              .groupBy("project", "owner_key").agg(F.min_by("alias", "rank").alias("from")))
    return keyed.join(owners, ["project", "owner_key"]).drop("owner_key")


def with_owner(files: DataFrame, alias: DataFrame) -> DataFrame:
    return resolve_owners(files.withColumn("owner_key", owner_key("path")), alias)


def resolve_targets(refs: DataFrame, alias: DataFrame) -> DataFrame:
    """Keep references to known services other than the owner."""
    known = refs.join(alias.withColumnRenamed("alias", "to"), ["project", "to"], "left_semi")
    return known.filter(F.col("from") != F.col("to"))


REF = "array<struct<to:string,evidence:string,confidence:double,evidence_type:string>>"


def _refs(pattern: str, groups: tuple[int, ...], build, confidence: str, evidence_type: str) -> Column:
    """Array of references: one struct per match of the pattern in the content.

    ``build`` maps the captured groups of one match to (target, evidence).
    """
    parts = [F.regexp_extract_all("content", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]

    def ref(m: Column) -> Column:
        to, evidence = build(*[m[f"g{g}"] for g in groups])
        return F.struct(to.alias("to"), evidence.alias("evidence"),
                        F.lit(fixed.EDGE_CONFIDENCE[confidence]).alias("confidence"),
                        F.lit(evidence_type).alias("evidence_type"))

    return F.transform(F.arrays_zip(*parts), ref).cast(REF)


def _labelled(label: str, *parts: Column) -> Column:
    return F.concat(F.lit(label), *parts)


def _config_target(token: Column) -> Column:
    return sv._drop_prefix(sv.trim_service(token), "service-")


def _extractors() -> dict[str, tuple[Column, list[Column]]]:
    """Which files a kind of reference is read from, and how."""
    base, arrow = F.lower(text.basename("path")), F.lit(" -> ")
    manifest = (base.rlike(r"\.ya?ml$") & F.col("content").contains("apiVersion:")
                & text.contains_any("content", fixed.K8S_KINDS))
    return {
        "k8s": (manifest, [_refs(
            fixed.K8S_ENV_PATTERN, (1, 2), lambda n, t: (t, _labelled("K8s env var: ", n, arrow, t)), "k8s", "config")]),
        "config": (text.ends_with_any(base, fixed.CONFIG_NAMES), [_refs(
            fixed.CONFIG_URL_PATTERN, (1, 2),
            lambda n, t: (_config_target(t), _labelled("Config: ", n, arrow, _config_target(t))), "config", "config")]),
        "import": (F.col("path").endswith(".go"), [
            _refs(fixed.GO_IMPORT_PATTERN, (1,), lambda p: (sv.service_of_import(p), _labelled("Import: ", p)), "import", "import"),
            _refs(fixed.GRPC_CLIENT_PATTERN, (0, 1), lambda m, s: (F.lower(s), _labelled("gRPC client: ", m)), "grpc_client", "import")]),
        "network": (text.ends_with_any("path", fixed.CODE_EXTS), [
            _refs(fixed.HTTP_CALL_PATTERN, (1,), lambda u: (sv.host_of(u), _labelled("HTTP call: ", u)), "http_call", "network"),
            _refs(fixed.GRPC_DIAL_PATTERN, (1,), lambda d: (sv.host_of_address(d), _labelled("gRPC dial: ", d)), "grpc_dial", "network")]),
    }


def refs_column(*kinds: str) -> Column:
    """Array of all references of the chosen kinds in one file."""
    chosen = {k: v for k, v in _extractors().items() if not kinds or k in kinds}
    empty = F.array().cast(REF)
    found = F.concat(*[F.when(test, F.concat(*arrays)).otherwise(empty) for test, arrays in chosen.values()])
    return F.filter(found, lambda r: r["to"] != "")


def extract_refs(files: DataFrame, *kinds: str) -> DataFrame:
    """References found in file contents: one pass for any set of kinds."""
    refs = F.col("refs") if "refs" in files.columns and not kinds else refs_column(*kinds)
    return (files.select("project", "path", owner_key("path").alias("owner_key"), F.explode(refs).alias("r"))
            .select("project", "path", "owner_key", "r.*").filter(F.col("owner_key") != ""))


# --- docker-compose -----------------------------------------------------------------

def compose_entries(files: DataFrame) -> DataFrame:
    """``(project, path, service, key, kind, value)`` of compose service bodies.

    ``kind`` is scalar, item (list element) or pair (map entry as ``k=v``).  All
    windows run over the lines of one file.
    """
    compose = files.filter(F.lower(text.basename("path")).isin(fixed.COMPOSE_EDGE_FILES))
    clean = F.regexp_replace("line", r"\s+#.*$", "")
    lines = (lines_of(compose).withColumn("line", clean)
             .withColumn("body", text.strip("line"))
             .filter((F.col("body") != "") & ~F.col("body").startswith("#"))
             .withColumn("indent", F.length("line") - F.length(F.ltrim("line"))))
    by_file = Window.partitionBy("project", "path")
    upto = by_file.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    key = F.regexp_replace(F.regexp_extract("body", r"^([^:]+?)\s*:(?:\s|$)", 1), r"""^["']|["']$""", "")
    value = text.strip(F.regexp_extract("body", r"^[^:]+?\s*:\s+(.*)$", 1))
    is_item = F.col("body").rlike(r"^-\s")
    lines = (lines.withColumns({"key0": key, "value": value, "is_item": is_item})
             .withColumn("section", F.last(F.when(F.col("indent") == 0, F.col("key0")), ignorenulls=True).over(upto))
             .filter((F.col("section") == "services") & (F.col("indent") > 0))
             .withColumn("service_indent", F.min("indent").over(by_file))
             .withColumn("service", F.last(F.when(F.col("indent") == F.col("service_indent"), F.col("key0")), ignorenulls=True).over(upto))
             .filter(F.col("indent") > F.col("service_indent"))
             .withColumn("key_indent", F.min("indent").over(Window.partitionBy("project", "path", "service")))
             .withColumn("key", F.last(F.when((F.col("indent") == F.col("key_indent")) & ~F.col("is_item"), F.col("key0")), ignorenulls=True).over(upto)))
    at_key = (F.col("indent") == F.col("key_indent")) & ~F.col("is_item")
    plain = lambda c: F.regexp_replace(text.strip(c), r"""^["']|["']$""", "")
    flow = F.transform(F.split(F.regexp_extract("value", r"^\[(.*)\]$", 1), ","), lambda v: plain(v))
    entry = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    values = (F.when(at_key & F.col("value").rlike(r"^\[.*\]$"), F.transform(flow, lambda v: entry("item", v)))
              .when(at_key & (F.col("value") != ""), F.array(entry("scalar", plain(F.col("value")))))
              .when(F.col("is_item"), F.array(entry("item", plain(F.regexp_replace("body", r"^-\s+", "")))))
              .when(~at_key & (F.col("key0") != ""), F.array(entry("pair", F.concat("key0", F.lit("="), plain(F.col("value")))))))
    return lines.select("project", "path", "service", "key", F.explode(values).alias("e")).select(
        "project", "path", "service", "key", "e.kind", "e.value").filter(F.col("value") != "")


def compose_edges(files: DataFrame, alias: DataFrame, *keys: str) -> DataFrame:
    """Edges of ``depends_on`` and ``environment`` entries."""
    keys = keys or ("depends_on", "environment")
    depends = (F.col("key") == "depends_on") & F.col("kind").isin("scalar", "item")
    env = ((F.col("key") == "environment") & F.col("kind").isin("item", "pair")
           & F.col("value").rlike(fixed.COMPOSE_ENV_PATTERN))
    refs = compose_entries(files).filter(F.col("key").isin(*keys) & (depends | env)).select(
        "project", F.col("path").alias("file_path"), F.col("service").alias("from"),
        F.when(depends, F.col("value")).otherwise(
            sv.trim_service(F.regexp_extract("value", fixed.COMPOSE_ENV_PATTERN, 2))).alias("to"),
        F.concat(F.when(depends, "depends_on: ").otherwise("Docker env: "), "value").alias("evidence"),
        F.when(depends, fixed.EDGE_CONFIDENCE["depends_on"]).otherwise(fixed.EDGE_CONFIDENCE["compose_env"]).alias("confidence"),
        F.lit("config").alias("evidence_type"), depends.alias("depends"))
    known = refs.join(alias.withColumnRenamed("alias", "from"), ["project", "from"], "left_semi")
    found = known.join(alias.withColumnRenamed("alias", "to"), ["project", "to"], "left_semi")
    return found.filter(F.col("depends") | (F.col("from") != F.col("to"))).select(*EDGE).distinct()


def path_edges(files: DataFrame, alias: DataFrame, *kinds: str) -> DataFrame:
    """Edges whose owner is read from the path of the file."""
    owned = resolve_owners(extract_refs(files, *kinds), alias)
    return resolve_targets(owned, alias).withColumnRenamed("path", "file_path").select(*EDGE).distinct()


def edge_depends_on(files: DataFrame, alias: DataFrame) -> DataFrame:
    return compose_edges(files, alias, "depends_on")


def edge_compose_env(files: DataFrame, alias: DataFrame) -> DataFrame:
    return compose_edges(files, alias, "environment")


def edge_k8s(files: DataFrame, alias: DataFrame) -> DataFrame:
    return path_edges(files, alias, "k8s")


def edge_config(files: DataFrame, alias: DataFrame) -> DataFrame:
    return path_edges(files, alias, "config")


def edge_import(files: DataFrame, alias: DataFrame) -> DataFrame:
    return path_edges(files, alias, "import")


def edge_network(files: DataFrame, alias: DataFrame) -> DataFrame:
    return path_edges(files, alias, "network")


def service_edges(files: DataFrame, services: DataFrame) -> DataFrame:
    """All edges: one pass for path-owned references, one for compose files."""
    alias = aliases(services)
    return path_edges(files, alias).unionByName(compose_edges(files, alias))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Best edge per (from, to, evidence type): confidence, then path, then evidence."""
    order = F.struct((-F.col("confidence")).alias("c"), "file_path", "evidence")
    return (edges.groupBy("project", "from", "to", "evidence_type").agg(F.min(order).alias("b"))
            .select("project", "from", "to", "evidence_type", F.col("b.evidence").alias("evidence"),
                    F.col("b.file_path").alias("file_path"), (-F.col("b.c")).alias("confidence")))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges per source service, split by evidence type."""
    return edges.groupBy("project", "from").agg(
        F.count("*").alias("n_edges"),
        *[F.count_if(F.col("evidence_type") == t).alias(f"n_{t}") for t in ("config", "import", "network")])


def graph_nodes(services: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes: all services, then edge endpoints that are not services."""
    node = lambda c: F.regexp_replace(text.col(c), "[^a-zA-Z0-9]", "_")
    own = services.select("project", node("name").alias("node_id"), "name", F.col("api_type"), F.lit(0).alias("rank"))
    ends = (edges.select("project", F.explode(F.array("from", "to")).alias("name"))
            .select("project", node("name").alias("node_id"), "name", F.lit("").alias("api_type"), F.lit(1).alias("rank")))
    return (own.unionByName(ends).groupBy("project", "node_id")
            .agg(F.min(F.struct("rank", "name", "api_type")).alias("n"))
            .select("project", "node_id", F.col("n.name").alias("label"), F.col("n.api_type").alias("api_type")))


def graph_text(services: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph lines in row form: sort by (project, part, sort_key) to read the text."""
    ident = text.identifier
    name, node = F.col("name"), ident("name")
    shape = (F.when(F.col("api_type") == "http", F.concat(node, F.lit("["), name, F.lit(" - HTTP]")))
             .when(F.col("api_type") == "grpc", F.concat(node, F.lit("{"), name, F.lit(" - gRPC}")))
             .when(F.col("api_type") == "graphql", F.concat(node, F.lit("("), name, F.lit(" - GraphQL)")))
             .otherwise(F.concat(node, F.lit("["), name, F.lit("]"))))
    label = (F.when(F.col("evidence_type") != "network", F.col("evidence_type"))
             .when(F.lower("evidence").contains("grpc"), "grpc").otherwise("http"))
    head = services.select("project").distinct().select(
        "project", F.lit(0).alias("part"), F.lit("").alias("sort_key"), F.lit("graph TD").alias("line"))
    nodes = services.select("project", F.lit(1).alias("part"), name.alias("sort_key"), F.concat(F.lit("  "), shape).alias("line"))
    links = edges.select("project", F.lit(2).alias("part"), F.concat_ws(" ", "from", "to", "evidence_type").alias("sort_key"),
                         F.concat(F.lit("  "), ident("from"), F.lit(" -->|"), label, F.lit("| "), ident("to")).alias("line"))
    return head.unionByName(nodes).unionByName(links)
