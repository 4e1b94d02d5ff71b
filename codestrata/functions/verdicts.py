"""Readable verdicts: confidence bands, type interpretations, stacks and setup commands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codestrata.functions import fixed
from codestrata.functions.text import col


def confidence_band(confidence: Column | str, scale: float = 1.0) -> Column:
    """Band of a 0-10 confidence; pass ``scale=0.1`` for 0-1 values."""
    c = col(confidence)
    out = None
    for floor, label in fixed.CONFIDENCE_BANDS:
        test = c >= F.lit(floor * scale)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(fixed.LOWEST_BAND)


def interpretation(kind: Column | str, confidence: Column | str, has_evidence: Column | str) -> Column:
    k, c = col(kind), col(confidence)
    out = F.when((k == fixed.UNKNOWN_TYPE) & col(has_evidence), fixed.UNKNOWN_WITH_EVIDENCE)
    out = out.when(k == fixed.UNKNOWN_TYPE, fixed.UNKNOWN_WITHOUT_EVIDENCE)
    for name, floor, sentence in fixed.INTERPRETATIONS:
        out = out.when((k == name) & (c >= floor), sentence)
    return out.otherwise("Project classification completed with available evidence.")


def stack_of(has_go_mod: Column | str, has_package: Column | str, primary: Column | str,
             stacks: Column | str, has_go: Column | str, has_script: Column | str) -> Column:
    """Supported stack from file evidence, then main stacks, then languages.

    ``stacks`` is one lower-cased text of the main stacks.
    """
    front = col(primary).isin("Frontend", "Fullstack")
    back = col(primary) == "Backend"
    s = col(stacks)
    react = s.contains("react")
    node = s.rlike("node|express|fastify")
    return (F.when(col(has_go_mod), "Go")
            .when(col(has_package) & (react | front), "React.js")
            .when(col(has_package) & (node | s.contains("nest") | back), "Node.js")
            .when(col(has_package), "React.js")
            .when(react, "React.js").when(node, "Node.js").when(s.contains("go"), "Go")
            .when(col(has_go), "Go")
            .when(col(has_script) & front, "React.js")
            .when(col(has_script) & back, "Node.js")
            .otherwise(""))


def setup_commands(stack: Column | str, has_package: Column | str, has_go_mod: Column | str,
                   has_main_go: Column | str, has_docker: Column | str, has_make: Column | str) -> Column:
    s = col(stack)
    web = s.isin("React.js", "Node.js") & col(has_package)
    go = (s == "Go") & col(has_go_mod)
    return F.array_compact(F.array(
        F.when(web, "npm install"),
        F.when(web, "npm run dev"),
        F.when(web & (s == "React.js"), "npm run build"),
        F.when(web & (s == "Node.js"), "npm test"),
        F.when(go, "go mod tidy"),
        F.when(go, "go build"),
        F.when(go, F.when(col(has_main_go), "go run main.go").otherwise("go run .")),
        F.when(col(has_docker), "docker-compose up -d"),
        F.when(col(has_make), "make"),
    ))
