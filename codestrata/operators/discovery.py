"""Service discovery: five candidate producers, merge, API types and exposure.

Producers work on paths or on single files and leave the scan as narrow rows.
"First file of its kind" is ``min_by`` over the path, an aggregate that combines
before the shuffle; existence tests are equi joins on (project, path).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions import fixed, services as sv, text

CANDIDATE = ["project", "name", "path", "entry_point", "detection_type", "confidence", "evidence", "language"]


def _is_service_dir(segment: Column) -> Column:
    return F.lower(segment).isin(fixed.SERVICE_DIRS)


def name_from_path(path: Column | str, project: Column | str = "project") -> Column:
    """Segment after the first service folder, else the parent folder, else the project."""
    segs = text.segments(path)
    n = F.size(segs)
    folders = F.slice(segs, F.lit(1), n - 1)
    pos = F.array_position(F.transform(folders, _is_service_dir), True).cast("int")
    return (F.when(n == 1, text.col(project))
            .when(pos > 0, F.get(segs, pos))
            .otherwise(F.get(segs, n - 2)))


def in_service_structure(path: Column | str) -> Column:
    return F.exists(text.segments(path), _is_service_dir) | text.contains_any(path, fixed.SERVICE_PATH_TOKENS)


def _per_project_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project").agg(F.count("*").alias("n_in_project"))


def _candidate(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    return df.select("project", cols["name"].alias("name"), cols["path"].alias("path"),
                     cols["entry_point"].alias("entry_point"), F.lit(kind).alias("detection_type"),
                     cols["confidence"].cast("double").alias("confidence"),
                     cols["evidence"].alias("evidence"), cols["language"].alias("language")).filter(F.col("name") != "")


def svc_main_go(files: DataFrame) -> DataFrame:
    mains = files.filter(F.col("path").endswith("main.go")).select("project", "path")
    counted = mains.join(_per_project_count(mains), "project")
    many = F.col("n_in_project") > 1
    kept = counted.filter(many | in_service_structure("path"))
    return _candidate(
        kept, "main_go", name=name_from_path("path"), path=text.dirname("path"), entry_point=F.col("path"),
        confidence=F.when(many, 0.9).otherwise(0.7),
        evidence=F.concat(F.when(many, "main.go file at ").otherwise("main.go file in service structure: "), F.col("path")),
        language=F.lit("Go"))


def first_files(files: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """``(project, kind, path, content)``: the lowest-path non-empty file of each kind, in one pass."""
    kind = F.lit(None).cast("string")
    for name, test in kinds.items():
        kind = F.coalesce(kind, F.when(test, name))
    return (files.select("project", "path", "content", kind.alias("kind"))
            .filter(F.col("kind").isNotNull() & (F.col("content") != "")).groupBy("project", "kind")
            .agg(F.min("path").alias("path"), F.min_by("content", "path").alias("content")))


def _landmark_tests() -> dict[str, Column]:
    base = F.lower(text.basename("path"))
    return {"makefile": base.isin(fixed.MAKE_FILES), "docker_compose": base.isin(fixed.COMPOSE_FILES)}


def lines_of(files: DataFrame, *keep: str) -> DataFrame:
    return files.select("project", "path", *keep, F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn(
        "line_no", F.col("pos") + 1).drop("pos")


def _hit(kind: str, name: Column, keep: Column) -> Column:
    return F.when((name != "") & keep, F.struct(F.lit(kind).alias("kind"), name.alias("name")))


def _make_targets(line: Column) -> Column:
    """Service names a Makefile line mentions, with the kind of mention."""
    found = {kind: F.regexp_extract(line, pattern, 1) for kind, pattern in fixed.MAKE_TARGET_PATTERNS.items()}
    built = F.concat(found["build target"], F.regexp_extract(line, fixed.MAKE_TARGET_PATTERNS["build target"], 2))
    return F.array(
        _hit("run target", found["run target"], F.lit(True)),
        _hit("go run cmd", found["go run cmd"], F.lit(True)),
        _hit("docker-compose up", found["docker-compose up"], ~found["docker-compose up"].isin("all", "-d")),
        _hit("build target", built, ~F.lower(built).isin(fixed.COMMON_MAKE_TARGETS)))


def compose_sections(lines: DataFrame) -> DataFrame:
    """Add ``in_services``: the state of the ``services:`` section, per file.

    The window runs over the lines of one file, which the size cap bounds.
    """
    trimmed = text.strip("line")
    unindented = F.col("line").rlike(r"^[^ \t]") & ~trimmed.startswith("#")
    mark = F.when(trimmed == "services:", True).when(unindented, False)
    w = Window.partitionBy("project", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False))
    return lines.withColumn("in_services", state & (trimmed != "services:"))


def _compose_service(line: Column) -> Column:
    """Service defined by an indented line of the services section."""
    name = text.strip(F.substring_index(line, ":", 1))
    keep = (F.col("in_services") & line.contains(":") & line.rlike(r"^(?:  (?!  )|\t(?!\t))")
            & ~F.lower(name).isin(fixed.COMPOSE_KEYS))
    return F.array(_hit("definition", name, keep))


def landmark_candidates(files: DataFrame, *kinds: str) -> DataFrame:
    """Candidates of the first Makefile and the first compose file of a project."""
    tests = {k: t for k, t in _landmark_tests().items() if k in kinds}
    lines = lines_of(first_files(files, tests), "kind")
    if "docker_compose" in kinds:
        lines = compose_sections(lines)
    make = F.col("kind") == "makefile"
    hits = F.when(make, _make_targets(text.strip("line")))
    if "docker_compose" in kinds:
        hits = F.when(make, _make_targets(text.strip("line"))).otherwise(_compose_service(F.col("line")))
    rows = lines.select("project", "path", "kind", "line_no", F.explode(F.array_compact(hits)).alias("t"))
    name, at = F.col("t.name"), F.concat(F.lit(" at line "), F.col("line_no").cast("string"))
    return rows.select(
        "project", name.alias("name"),
        F.when(make, F.concat(F.lit("cmd/"), name)).otherwise(F.concat(F.lit("service-"), name)).alias("path"),
        F.when(make, F.concat(F.lit("cmd/"), name, F.lit("/main.go"))).otherwise(F.col("path")).alias("entry_point"),
        F.col("kind").alias("detection_type"), F.lit(0.8).alias("confidence"),
        F.when(make, F.concat(F.lit("Makefile "), F.col("t.kind"), at))
        .otherwise(F.concat(F.lit("Docker Compose service definition"), at)).alias("evidence"),
        F.when(make, "Go").otherwise("Unknown").alias("language"))


def svc_makefile(files: DataFrame) -> DataFrame:
    return landmark_candidates(files, "makefile")


def svc_compose(files: DataFrame) -> DataFrame:
    return landmark_candidates(files, "docker_compose")


def svc_package_json(files: DataFrame) -> DataFrame:
    packages = files.filter(F.col("path").endswith("package.json")).select("project", "path")
    nested = packages.join(_per_project_count(packages).filter("n_in_project > 1"), "project").filter(F.col("path") != "package.json")
    return _candidate(
        nested, "package_json", name=name_from_path("path"), path=text.dirname("path"), entry_point=F.col("path"),
        confidence=F.lit(0.7), evidence=F.concat(F.lit("package.json file at "), F.col("path")), language=F.lit("Node.js"))


def _service_dir_hits(path: Column) -> Column:
    """Array of (parent path, service folder, next segment) for every service folder on a path."""
    segs = text.segments(path)
    folders = F.slice(segs, F.lit(1), F.size(segs) - 1)
    hits = F.transform(folders, lambda s, i: F.when(_is_service_dir(s), F.struct(
        F.array_join(F.slice(segs, F.lit(1), i + 1), "/").alias("parent"),
        s.alias("dir"), F.get(segs, i + 1).alias("name"))))
    return F.array_compact(hits)


def entry_points(files: DataFrame, suffixes=tuple(fixed.ENTRY_SUFFIXES)) -> DataFrame:
    """``(project, service_path, entry_point)``: the first existing entry of every folder."""
    path = F.col("path")
    options = F.array_compact(F.array(*[
        F.when(path.endswith(s), F.struct(F.left(path, F.length(path) - len(s)).alias("service_path"), F.lit(i).alias("rank")))
        for i, s in enumerate(suffixes)]))
    return (files.select("project", "path", F.explode(options).alias("o"))
            .groupBy("project", "o.service_path").agg(F.min_by("path", "o.rank").alias("found_entry")))


def folder_languages(files: DataFrame) -> DataFrame:
    """``(project, parent, name, language)`` for every prefix ``name`` of a segment under ``parent``.

    A service path counts as a plain string prefix of its files, so segments are
    expanded into their prefixes (a bounded factor: names have at most 255
    characters) and the match becomes an equi join.
    """
    path = F.col("path")
    language = None
    for suffix, name in fixed.LANGUAGE_SUFFIXES:
        language = F.when(path.endswith(suffix), name) if language is None else language.when(path.endswith(suffix), name)
    best = (files.select("project", "path", language.alias("language")).filter(F.col("language").isNotNull())
            .select("project", "path", "language", F.explode(_service_dir_hits(path)).alias("h"))
            .groupBy("project", "h.parent", "h.name").agg(F.min(F.struct("path", "language")).alias("best")))
    grown = best.select("project", "parent", "best", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda k: F.left(F.col("name"), k))).alias("name"))
    return grown.groupBy("project", "parent", "name").agg(F.min("best").alias("best")).select(
        "project", "parent", "name", F.col("best.language").alias("folder_language"))


def svc_directory(files: DataFrame) -> DataFrame:
    found = (files.select("project", F.explode(_service_dir_hits(F.col("path"))).alias("h"))
             .select("project", "h.*")
             .filter(~F.lower("name").isin(fixed.COMMON_SUBDIRS))
             .groupBy("project", "dir", "name").agg(F.min("parent").alias("parent"))
             .withColumn("service_path", F.concat_ws("/", "parent", "name")))
    joined = (found.join(entry_points(files), ["project", "service_path"], "left")
              .join(folder_languages(files), ["project", "parent", "name"], "left"))
    return _candidate(
        joined, "directory", name=F.col("name"), path=F.col("service_path"),
        entry_point=F.coalesce("found_entry", "service_path"), confidence=F.lit(0.6),
        evidence=F.concat(F.lit("Service directory structure: "), F.col("service_path")),
        language=F.coalesce("folder_language", F.lit("Unknown")))


def service_candidates(files: DataFrame) -> DataFrame:
    parts = [svc_main_go(files), landmark_candidates(files, "makefile", "docker_compose"),
             svc_package_json(files), svc_directory(files)]
    return reduce(DataFrame.unionByName, parts)


# --- merge, confidence, API type -----------------------------------------------------

def merge_candidates(cands: DataFrame) -> DataFrame:
    """One row per (project, lower-cased name): the most confident candidate wins.

    Ties go to the earlier producer, then the lower path.  Evidence texts stay in
    row form (``candidate_evidence``); the merged row carries their number.
    """
    number = F.array_position(F.array(*[F.lit(p) for p in fixed.PRODUCERS]), F.col("detection_type")).cast("int")
    numbered = cands.withColumns({"key": F.lower("name"), "no": number})
    order = F.struct((-F.col("confidence")).alias("c"), "no", "path", "entry_point", "evidence")
    kinds = F.array_sort(F.collect_set("no"))
    names = F.array(*[F.lit(p) for p in fixed.PRODUCERS])
    return (numbered.groupBy("project", "key").agg(
        F.min_by(F.struct("name", "path", "entry_point", "language", "confidence"), order).alias("w"),
        kinds.alias("kinds"), F.countDistinct("evidence").alias("n_evidence"))
        .select("project", "w.name", "w.path", "w.entry_point", "w.language", "w.confidence",
                F.transform("kinds", lambda k: F.element_at(names, k)).alias("kinds"), "n_evidence")
        .withColumns({
            "description": F.concat("language", F.lit(" service detected via "), F.array_join("kinds", " and ")),
            "detection_types": F.array_join("kinds", ",")})
        .drop("kinds"))


def candidate_evidence(cands: DataFrame) -> DataFrame:
    return cands.select("project", F.lower("name").alias("service_key"), "detection_type", "evidence").distinct()


def filter_confident(cands: DataFrame, minimum: float = fixed.MIN_SERVICE_CONFIDENCE) -> DataFrame:
    return cands.filter(F.col("confidence") >= minimum)


def may_be_entry() -> Column:
    """Files a candidate can name as its entry point: known entry names, or any file right under a service folder."""
    path = F.col("path")
    names = [s.rsplit("/", 1)[-1] for s in fixed.ENTRY_SUFFIXES]
    return text.ends_with_any(path, sorted(set(names))) | _is_service_dir(text.basename(text.dirname(path)))


def api_struct() -> Column:
    """API words in the content; only possible entry points are searched."""
    body = F.when(may_be_entry(), F.col("content"))
    return F.struct(*[F.coalesce(body.contains(w), F.lit(False)).alias(w) for w in ("grpc", "graphql", "apollo")])


def with_entry_content(services: DataFrame, files: DataFrame) -> DataFrame:
    """Content of each service's entry point, null when the entry is only a folder.

    Entry points are unique paths, so the join cannot skew, and only texts that can be entry points
    take part; use ``with_api_type`` where flags are enough and no text need move.
    """
    listed = F.lower(text.basename("path")).isin(fixed.MAKE_FILES + fixed.COMPOSE_FILES)
    texts = files.filter(may_be_entry() | listed).select("project", F.col("path").alias("entry_point"), "content")
    return services.join(texts, ["project", "entry_point"], "left")


def with_api_type(services: DataFrame, files: DataFrame) -> DataFrame:
    """API type from the entry point's content; only two flags leave the file scan."""
    if "api" not in files.columns:
        files = files.select("project", "path", api_struct().alias("api"))
    flags = files.select("project", F.col("path").alias("entry_point"), "api.*").filter("grpc OR graphql OR apollo")
    api = (F.when((F.col("language") == "Go") & F.col("grpc"), "grpc")
           .when((F.col("language") == "Go") & F.col("graphql"), "graphql")
           .when((F.col("language") == "Node.js") & (F.col("apollo") | F.col("graphql")), "graphql")
           .otherwise("http"))
    return (services.join(flags, ["project", "entry_point"], "left")
            .withColumn("api_type", api).drop("grpc", "graphql", "apollo"))


def discover_services(files: DataFrame) -> DataFrame:
    """Candidates, merge, confidence filter, API type, purpose and kind."""
    merged = filter_confident(merge_candidates(service_candidates(files)))
    purpose = sv.service_purpose("name", "api_type")
    return with_api_type(merged, files).withColumns({"purpose": purpose, "kind": sv.service_kind(purpose)}).select(
        "project", "name", "path", "entry_point", "language", "api_type", "confidence",
        "detection_types", "n_evidence", "description", "purpose", "kind")


def order_candidates(cands: DataFrame) -> DataFrame:
    return cands.orderBy("project", F.desc("confidence"), "name", "path", "evidence")


# --- stack-specific discovery and exposure ---------------------------------------------

def go_exposure(content: Column | str) -> Column:
    """API type of a Go entry point, null when it only works in the background."""
    c = text.col(content)
    return (F.when(text.contains_any(c, fixed.GO_HTTP_TOKENS), "http")
            .when(text.contains_any(c, fixed.GO_GRPC_TOKENS), "grpc")
            .when(text.contains_any(c, fixed.GO_GRAPHQL_TOKENS), "graphql")
            .when(~text.contains_any(c, fixed.GO_WORKER_TOKENS), "http"))


def exposed_go(files: DataFrame) -> DataFrame:
    path = F.col("path")
    segs = text.segments(text.dirname(path))
    pos = F.array_position(segs, "cmd").cast("int")
    name = F.get(segs, pos)
    by_cmd = F.when((text.basename(path) == "main.go") & (pos > 0) & name.isNotNull() & (F.instr(path, "/") > 0), name)
    top = F.when(path.endswith("main.go") & (F.instr(path, "/") == 0), F.col("project"))
    mains = files.filter(path.endswith("main.go")).withColumns({
        "name": F.coalesce(by_cmd, top), "api_type": go_exposure("content")})
    http = F.col("content").rlike(text.alternation(fixed.GO_HTTP_TOKENS))
    return mains.filter("name IS NOT NULL AND name <> '' AND api_type IS NOT NULL").select(
        "project", F.lit("go").alias("stack"), "name", text.dirname(path).alias("path"), F.col("path").alias("entry_point"),
        "api_type", F.when(http, sv.port_of("content")).otherwise("").alias("port"), F.lit("").alias("description"))


def _folder_name(folder: Column) -> Column:
    return text.basename(folder)


def exposed_node(files: DataFrame) -> DataFrame:
    """Packages with a server entry: first of the entry files that starts a server."""
    path = F.col("path")
    options = F.array_compact(F.array(*[
        F.when((path == s) | path.endswith("/" + s),
               F.struct(F.when(path == s, ".").otherwise(F.left(path, F.length(path) - len(s) - 1)).alias("folder"), F.lit(i).alias("rank")))
        for i, s in enumerate(fixed.NODE_ENTRY_SUFFIXES)]))
    entries = (files.filter(text.ends_with_any("path", fixed.NODE_ENTRY_SUFFIXES) & text.contains_any("content", fixed.NODE_SERVER_TOKENS))
               .select("project", "path", F.explode(options).alias("o"))
               .groupBy("project", "o.folder").agg(F.min_by("path", "o.rank").alias("entry_point")))
    packages = files.filter(text.basename("path") == "package.json").select("project", text.dirname("path").alias("folder"))
    return packages.join(entries, ["project", "folder"]).select(
        "project", F.lit("node.js").alias("stack"), _folder_name(F.col("folder")).alias("name"), F.col("folder").alias("path"),
        "entry_point", F.lit("http").alias("api_type"), F.lit("").alias("port"), F.lit("").alias("description"))


def exposed_react(files: DataFrame) -> DataFrame:
    folder = text.dirname("path")
    inside = folder.rlike(r"(?:^|/)(?:apps|packages)/[^/]")
    body = F.col("content")
    apps = files.filter((text.basename("path") == "package.json") & inside & body.contains("react")
                        & text.contains_any(body, fixed.REACT_APP_TOKENS))
    return apps.select(
        "project", F.lit("react.js").alias("stack"), _folder_name(folder).alias("name"), folder.alias("path"),
        F.col("path").alias("entry_point"), F.lit("http").alias("api_type"), F.lit("").alias("port"),
        F.concat(F.lit("React microfrontend: "), _folder_name(folder)).alias("description"))


def svc_by_stack(files: DataFrame, stack: str | None = None) -> DataFrame:
    makers = {"go": exposed_go, "node.js": exposed_node, "react.js": exposed_react}
    return reduce(DataFrame.unionByName, [make(files) for name, make in makers.items() if stack in (None, name)])


def exposure_flags(files: DataFrame) -> DataFrame:
    """Server tokens of single files, for services whose entry point is known; only files that raise a flag."""
    entries = files.filter(text.ends_with_any("path", ["main.go", "package.json", *fixed.NODE_ENTRY_SUFFIXES]) | may_be_entry())
    flags = entries.select("project", F.col("path").alias("entry_point"), go_exposure("content").alias("go_api"),
                           text.contains_any("content", fixed.NODE_SERVER_TOKENS).alias("node_api"),
                           text.contains_any("content", fixed.REACT_SERVER_TOKENS).alias("react_api"))
    return flags.filter("go_api IS NOT NULL OR node_api OR react_api")


def exposed_services(services: DataFrame, files: DataFrame) -> DataFrame:
    """Keep services whose entry point exists and exposes an API in their stack."""
    joined = services.join(exposure_flags(files), ["project", "entry_point"])
    keep = (((F.col("stack") == "go") & F.col("go_api").isNotNull())
            | ((F.col("stack") == "node.js") & F.col("node_api"))
            | ((F.col("stack") == "react.js") & F.col("react_api")))
    return joined.filter(keep).drop("go_api", "node_api", "react_api")


def svc_readme(files: DataFrame) -> DataFrame:
    """Service names in run commands of the first README."""
    readme = first_files(files, {"readme": F.lower(text.basename("path")) == "readme.md"})
    names = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in fixed.README_PATTERNS])
    return readme.select("project", F.explode(names).alias("name")).distinct()


def reconcile(services: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Append services that only the README mentions."""
    unseen = mentioned.join(services.select("project", "name").distinct(), ["project", "name"], "left_anti")
    name = F.col("name")
    extra = unseen.select(
        "project", F.lit("readme").alias("stack"), "name", F.concat(F.lit("cmd/"), name).alias("path"),
        F.concat(F.lit("cmd/"), name, F.lit("/main.go")).alias("entry_point"), F.lit("http").alias("api_type"),
        F.lit("").alias("port"), F.concat(F.lit("Service mentioned in README: "), name).alias("description"))
    return services.unionByName(extra)
