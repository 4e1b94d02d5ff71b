from codestrata.operators import detection


def one(make_files, *rows):
    return detection.project_type(make_files(*rows)).first()


def test_documented_example_is_fullstack(make_files):
    files = make_files(
        ("server.js", "const app = require('express')()"),
        ("package.json", '{"scripts": {"start": "node server.js", "dev": "vite"}, "dependencies": {"express": "4", "react": "18"}}'),
        ("controllers/UserController.js", "x"),
        ("migrations/001_create_users_table.sql", "x"),
        ("migrations/002_add_profile_fields.sql", "x"))
    row = detection.project_type(files).first()
    assert (row.primary_type, row.confidence) == ("Fullstack", 10.0)


def test_rule_once_plus_repeat_bonus(make_files):
    scores = {r.type: r.score for r in detection.rule_scores(make_files(("a.css", ""), ("b.css", ""), ("c.css", ""))).collect()}
    assert scores["Frontend"] == 2.5 + 2.5 * 3 * 0.1
    assert scores["Backend"] == 0.0


def test_low_score_is_unknown(make_files):
    row = one(make_files, ("notes/a.xyz", ""))
    assert (row.primary_type, row.secondary_type, row.confidence) == ("Unknown", "", 0.0)


def test_directory_rules_match_the_whole_parent(make_files):
    rules = [("Frontend", "Dirs", 2.0, [], ["components"], [])]
    hit = detection.rule_matches(make_files(("components/a.css", "")), rules).count()
    miss = detection.rule_matches(make_files(("src/components/a.css", "")), rules).count()
    assert (hit, miss) == (1, 0)


def test_close_second_is_cleared(make_files):
    rules = [("Frontend", "A", 5.0, [".a"], [], []), ("Backend", "B", 4.5, [".b"], [], []), ("Mobile", "C", 3.0, [".c"], [], [])]
    row = detection.project_type(make_files(("x.a", ""), ("x.b", "")), rules).first()
    assert (row.primary_type, row.secondary_type) == ("Frontend", "")
    row = detection.project_type(make_files(("x.a", ""), ("x.c", "")), rules).first()
    assert (row.primary_type, row.secondary_type) == ("Frontend", "Mobile")


def test_tie_falls_to_the_type_declared_first(make_files):
    rules = [("Mobile", "M", 3.0, [".x"], [], []), ("Backend", "B", 3.0, [".x"], [], [])]
    assert detection.project_type(make_files(("a.x", "")), rules).first().primary_type == "Backend"


def test_manifest_dampens_backend(make_files):
    scores = {r.type: r.score for r in detection.type_scores(make_files(
        ("package.json", '{"dependencies": {"react": "1"}}'), ("a.go", ""))).collect()}
    plain = {r.type: r.score for r in detection.rule_scores(make_files(
        ("package.json", '{"dependencies": {"react": "1"}}'), ("a.go", ""))).collect()}
    assert scores["Frontend"] == plain["Frontend"] + 6.0
    assert abs(scores["Backend"] - plain["Backend"] * 0.3) < 1e-9
