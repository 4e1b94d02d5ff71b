from codestrata.operators import config


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_env_keeps_only_missing_values(make_files):
    assert rows(config.env_required(make_files((".env", "A=\nB=real\nC=your_key\n"))), "name") == [("A",), ("C",)]


def test_yaml_references(make_files):
    got = rows(config.yaml_required(make_files(("c.yaml", "a: ${DB_URL:postgres}\nb: $API_KEY\n"))), "name", "type")
    assert got == [("API_KEY", "api_key"), ("DB_URL", "database_url")]


def test_longest_description_pattern_wins(make_files):
    row = config.env_required(make_files((".env", "MY_OPENAI_API_KEY=\n"))).first()
    assert row.description.startswith("OpenAI API key")


def test_same_variable_in_two_files_is_one_row(make_files):
    files = make_files((".env", "A_KEY=\n"), ("x/.env.local", "A_KEY=\n"))
    scoped = config.scoped_config(files)
    got = {(r.scope_kind, r.name): r for r in config.dedup_config(scoped).collect()}
    assert got[("service", "A_KEY")].n_sources == 2
    assert got[("global", "A_KEY")].n_sources == 1
    assert config.config_sources(scoped).count() == 3


def test_monorepo_scopes(make_files):
    files = make_files(("api/.env", "A=\n"), ("web/.env", "A=\n"), ("zzz/.env", "A=\n"), (".env", "A=\n"))
    assert rows(config.scoped_config(files), "scope") == [("api",), ("global",), ("web",)]
    total = config.config_totals(files).first()
    assert (total.project_type, total.n_services, total.total_variables) == ("monorepo", 2, 3)


def test_project_without_config(make_files):
    row = config.config_totals(make_files(("a.go", ""))).first()
    assert (row.total_variables, row.n_services) == (0, 1)
    assert row.summary.startswith("No configuration secrets")
