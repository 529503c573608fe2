"""The declared vocabulary as small DataFrames, from the built-in values or a YAML/JSON file."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = (
    "predicate string, label string, inverse string, inverse_label string, domain array<string>, "
    "range array<string>, range_subtypes array<string>, storage string, provenance array<string>, "
    "path_weight double, is_symmetric boolean, is_structural boolean, "
    "excluded_from_path_intermediates boolean, narration string, narration_inverse string"
)

# Entity types, whether each is a node of the graph, and their subtypes.
ENTITY_TYPES: dict[str, dict[str, Any]] = {
    "title": {"graph_node": True, "subtypes": ["movie", "show"]},
    "person": {"graph_node": True},
    "character": {"graph_node": True},
    "concept": {"graph_node": True, "subtypes": ["genre", "theme", "mood", "keyword", "format"]},
    "collection": {"graph_node": True},
    "organization": {"graph_node": True, "subtypes": ["studio", "network", "distributor", "streamer", "production"]},
    "work": {"graph_node": True, "subtypes": ["book", "comic", "play", "game", "article", "true_events", "short_story"]},
    "season": {"graph_node": False},
    "episode": {"graph_node": False},
}

# Predicates with label, inverse, domain, range, storage, provenance, weight, narration.
PREDICATES: dict[str, dict[str, Any]] = {
    "directed": {
        "label": "directed", "inverse": "directed_by", "domain": ["person"], "range": ["title", "episode"],
        "storage": "credit", "provenance": ["asserted"], "path_weight": 1.0,
        "narration": "{subject} directed {object}", "narration_inverse": "{subject} was directed by {object}"},
    "acted_in": {
        "label": "acted in", "inverse": "features_actor", "domain": ["person"], "range": ["title", "episode"],
        "storage": "credit", "provenance": ["asserted"], "path_weight": 1.4,
        "narration": "{subject} appeared in {object}", "narration_inverse": "{subject} features {object}"},
    "wrote": {
        "label": "wrote", "inverse": "written_by", "domain": ["person"], "range": ["title", "episode"],
        "storage": "credit", "provenance": ["asserted"], "path_weight": 1.15,
        "narration": "{subject} wrote {object}", "narration_inverse": "{subject} was written by {object}"},
    "composed_for": {
        "label": "composed the score for", "inverse": "scored_by", "domain": ["person"], "range": ["title"],
        "storage": "credit", "provenance": ["asserted"], "path_weight": 1.6,
        "narration": "{subject} composed the score for {object}",
        "narration_inverse": "{subject} was scored by {object}"},
    "shot": {
        "label": "was cinematographer on", "inverse": "shot_by", "domain": ["person"], "range": ["title"],
        "storage": "credit", "provenance": ["asserted"], "path_weight": 1.6,
        "narration": "{subject} was the cinematographer on {object}",
        "narration_inverse": "{subject} was shot by {object}"},
    "portrayed_by": {
        "label": "portrayed by", "inverse": "portrays", "domain": ["character"], "range": ["person"],
        "storage": "edge", "provenance": ["asserted", "curated"], "path_weight": 1.1,
        "narration": "{subject} is portrayed by {object}", "narration_inverse": "{subject} portrays {object}"},
    "features_character": {
        "label": "features", "inverse": "appears_in", "domain": ["title"], "range": ["character"],
        "storage": "edge", "provenance": ["asserted", "curated"], "path_weight": 1.3,
        "narration": "{subject} features the character {object}",
        "narration_inverse": "{subject} appears in {object}"},
    "belongs_to_genre": {
        "label": "genre", "inverse": "genre_of", "domain": ["title"], "range": ["concept:genre"],
        "storage": "edge", "provenance": ["asserted"], "path_weight": 4.5,
        "excluded_from_path_intermediates": True,
        "narration": "{subject} is a {object} film", "narration_inverse": "{subject} is a genre of {object}"},
    "explores_theme": {
        "label": "explores", "inverse": "explored_by", "domain": ["title"], "range": ["concept:theme"],
        "storage": "edge", "provenance": ["curated", "derived"], "path_weight": 2.6,
        "narration": "{subject} explores {object}", "narration_inverse": "{subject} is explored by {object}"},
    "broader_than": {
        "label": "broader than", "inverse": "narrower_than", "domain": ["concept"], "range": ["concept"],
        "storage": "edge", "provenance": ["curated"], "path_weight": 2.0,
        "narration": "{subject} is a broader concept than {object}",
        "narration_inverse": "{subject} is narrower than {object}"},
    "part_of_franchise": {
        "label": "part of", "inverse": "includes", "domain": ["title"], "range": ["collection"],
        "storage": "edge", "provenance": ["asserted", "curated"], "path_weight": 1.1,
        "narration": "{subject} is part of {object}", "narration_inverse": "{subject} includes {object}"},
    "based_on": {
        "label": "based on", "inverse": "adapted_as", "domain": ["title"], "range": ["work"],
        "storage": "edge", "provenance": ["asserted", "curated"], "path_weight": 1.2,
        "narration": "{subject} is based on {object}", "narration_inverse": "{subject} was adapted as {object}"},
    "sequel_to": {
        "label": "sequel to", "inverse": "followed_by", "domain": ["title"], "range": ["title"],
        "storage": "edge", "provenance": ["curated"], "path_weight": 1.0,
        "narration": "{subject} is a sequel to {object}", "narration_inverse": "{subject} is followed by {object}"},
    "remake_of": {
        "label": "remake of", "inverse": "remade_as", "domain": ["title"], "range": ["title"],
        "storage": "edge", "provenance": ["curated"], "path_weight": 1.2,
        "narration": "{subject} is a remake of {object}", "narration_inverse": "{subject} was remade as {object}"},
    "influenced_by": {
        "label": "influenced by", "inverse": "influenced", "domain": ["title", "person"],
        "range": ["title", "person"], "storage": "edge", "provenance": ["curated"], "path_weight": 1.5,
        "narration": "{subject} was influenced by {object}", "narration_inverse": "{subject} influenced {object}"},
    "similar_to": {
        "label": "similar to", "inverse": "similar_to", "domain": ["title"], "range": ["title"],
        "storage": "edge_derived", "provenance": ["derived"], "path_weight": 2.2, "symmetric": True,
        "narration": "{subject} is similar to {object}", "narration_inverse": "{subject} is similar to {object}"},
    "produced_by": {
        "label": "produced by", "inverse": "produced", "domain": ["title"],
        "range": ["organization:studio", "organization:production"],
        "storage": "edge", "provenance": ["asserted"], "path_weight": 3.8,
        "narration": "{subject} was produced by {object}", "narration_inverse": "{subject} produced {object}"},
    "distributed_by": {
        "label": "distributed by", "inverse": "distributed", "domain": ["title"],
        "range": ["organization:distributor"], "storage": "edge", "provenance": ["asserted"], "path_weight": 4.2,
        "narration": "{subject} was distributed by {object}", "narration_inverse": "{subject} distributed {object}"},
    "aired_on": {
        "label": "aired on", "inverse": "aired", "domain": ["title"], "range": ["organization:network"],
        "storage": "edge", "provenance": ["asserted"], "path_weight": 3.5,
        "narration": "{subject} aired on {object}", "narration_inverse": "{subject} aired {object}"},
    "season_of": {
        "label": "season of", "inverse": "has_season", "domain": ["season"], "range": ["title"],
        "storage": "structural", "provenance": ["asserted"], "structural": True,
        "narration": "{subject} is a season of {object}", "narration_inverse": "{subject} has season {object}"},
    "episode_of": {
        "label": "episode of", "inverse": "has_episode", "domain": ["episode"], "range": ["season"],
        "storage": "structural", "provenance": ["asserted"], "structural": True,
        "narration": "{subject} is an episode of {object}", "narration_inverse": "{subject} has episode {object}"},
}


def read_document(path: str) -> Any:
    """A YAML or JSON file; YAML needs PyYAML."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return json.load(handle)
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs PyYAML; give a .json file instead") from error
        return yaml.safe_load(handle)


def predicate_rows(predicates: dict[str, dict[str, Any]]) -> list[tuple]:
    """Declarations as rows of ``predicate_meta``; ``type:subtype`` ranges are split in two."""
    rows = []
    for name, p in predicates.items():
        types = list(dict.fromkeys(r.split(":")[0] for r in p["range"]))
        subtypes = [r.split(":")[1] for r in p["range"] if ":" in r]
        rows.append((
            name, p["label"], p["inverse"], p["inverse"].replace("_", " "), list(p["domain"]), types, subtypes,
            p["storage"].removeprefix("core."), list(p["provenance"]), p.get("path_weight"),
            bool(p.get("symmetric", False)), bool(p.get("structural", False)),
            bool(p.get("excluded_from_path_intermediates", False)), p.get("narration"), p.get("narration_inverse"),
        ))
    return rows


def load_ontology(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``predicate_meta``: one row per declared predicate, a few dozen at most."""
    declared = PREDICATES if path is None else read_document(path)["predicates"]
    return spark.createDataFrame(predicate_rows(declared), META_SCHEMA)


def load_crosswalk(spark: SparkSession, source: str | dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Themes and keyword crosswalk of a file or mapping, as (concept rows, crosswalk rows).

    Layout: ``themes: {key: {label, definition}}``, ``crosswalk: {keyword: [{theme, salience}]}``,
    ``excluded: {reason: [keyword]}``. An excluded keyword is kept with a NULL theme.
    """
    doc = read_document(source) if isinstance(source, str) else source
    themes = doc["themes"]
    concepts = [(key, "theme", t["label"], t.get("definition"), True) for key, t in themes.items()]
    rows: list[tuple] = []
    for keyword, links in doc.get("crosswalk", {}).items():
        for link in links:
            if link["theme"] not in themes:
                raise ValueError(f"crosswalk names an undeclared theme: {link['theme']}")
            rows.append((keyword, link["theme"], float(link["salience"]), None))
    for reason, keywords in doc.get("excluded", {}).items():
        rows.extend((keyword, None, 0.0, f"excluded: {reason}") for keyword in dict.fromkeys(keywords))
    return (
        spark.createDataFrame(concepts, "concept_id string, scheme string, label string, description string, is_curated boolean"),
        spark.createDataFrame(rows, "keyword_label string, concept_id string, salience double, notes string"),
    )


def with_meta(edges: DataFrame, meta: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with their predicate's declaration; the declaration is a fixed handful of rows."""
    return edges.join(F.broadcast(meta), "predicate", how)
