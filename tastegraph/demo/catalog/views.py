"""The logical graph, the semantic views and the integrity checks."""

from pyspark.sql import functions as F

from tastegraph.demo.model import AS_OF
from tastegraph.demo.oracle_views import TODAY
from tastegraph.demo.registry import query
from tastegraph.operators import edges as E
from tastegraph.operators import validate as V
from tastegraph.operators import views as W
from tastegraph.sources.ontology import ENTITY_TYPES

c = F.col
_ATTRS = ["billing_order", "character_id", "character", "job", "salience", "score", "reason", "method"]
_NODE_TYPES = ", ".join(f"'{n}'" for n, e in ENTITY_TYPES.items() if e["graph_node"])


def joined(col):
    """An array as one text, for comparison."""
    return F.array_join(col, "; ")


@query("load_ontology", """
    SELECT predicate, label, inverse, inverse_label, array_to_string(domain_types, '; ') AS domain, array_to_string(range_types, '; ') AS range,
           array_to_string(range_subtypes, '; ') AS range_subtypes, storage, path_weight, is_symmetric, is_structural,
           count(e.id) AS edges
    FROM {o_meta} m LEFT JOIN {o_edge} e USING (predicate) GROUP BY ALL""")
def ontology(t):
    use = E.edge(t.credit, t.edge, t.edge_derived).groupBy("predicate").agg(F.count("*").alias("edges"))
    return t.predicate_meta.join(use, "predicate", "left").select(
        "predicate", "label", "inverse", "inverse_label", joined("domain").alias("domain"), joined("range").alias("range"),
        joined("range_subtypes").alias("range_subtypes"), "storage", "path_weight", "is_symmetric", "is_structural",
        F.coalesce("edges", F.lit(0)).alias("edges"))


@query("load_crosswalk", """
    SELECT lower(k.keyword_label) AS keyword, c.concept_id, c.salience, count(*) AS n
    FROM {title_keyword} k JOIN {crosswalk} c ON lower(c.keyword_label) = lower(k.keyword_label) GROUP BY 1, 2, 3""")
def crosswalk(t):
    x = t.crosswalk.select(F.lower("keyword_label").alias("keyword"), "concept_id", "salience")
    return t.title_keyword.select(F.lower("keyword_label").alias("keyword")).join(x, "keyword").groupBy(
        "keyword", "concept_id", "salience").agg(F.count("*").alias("n"))


@query("edge", "SELECT * FROM {o_edge}")
def edge(t):
    e = E.edge(t.credit, t.edge, t.edge_derived)
    return e.select("id", "subject_type", "subject_id", "predicate", "object_type", "object_id",
                    *[c(f"attributes.{a}").alias(a) for a in _ATTRS], "provenance", "confidence")


@query("edge_bidirectional", """
    SELECT subject_type, subject_id, predicate, object_type, object_id, job, confidence, is_inverse, canonical_predicate, path_weight,
           predicate_label, excluded AS excluded_from_path_intermediates FROM {o_both}""")
def edge_bidirectional(t):
    b = E.edge_bidirectional(E.edge(t.credit, t.edge, t.edge_derived), t.predicate_meta)
    return b.select("subject_type", "subject_id", "predicate", "object_type", "object_id", c("attributes.job").alias("job"), "confidence",
                    "is_inverse", "canonical_predicate", "path_weight", "predicate_label", "excluded_from_path_intermediates")


@query("node_degree", "SELECT * FROM {o_degree}")
def node_degree(t):
    return E.node_degree(E.edge(t.credit, t.edge, t.edge_derived))


@query("update_degree", """
    SELECT node_type, node_id, count(*) AS degree FROM (
        SELECT unnest([{'t': subject_type, 'i': subject_id}, {'t': object_type, 'i': object_id}]) AS node FROM {o_edge}
        WHERE NOT (subject_type = 'person' AND subject_id % 3 = 0)) x, LATERAL (SELECT node.t AS node_type, node.i AS node_id) y GROUP BY 1, 2""")
def update_degree(t):
    """Derived edges come, those of every third person go."""
    held = E.edge(t.credit, t.edge, t.edge_derived.limit(0))
    derived = E.edge(t.credit.limit(0), t.edge.limit(0), t.edge_derived)
    return E.update_degree(E.node_degree(held), derived, held.filter((c("subject_type") == "person") & (c("subject_id") % 3 == 0)))


@query("node", "SELECT * FROM {o_node}")
def node(t):
    return E.node(t)


@query("title_view", """
    SELECT id, slug, kind, title, release_date, runtime_minutes, status, poster_path, popularity, release_year, genres, themes,
           primary_director, franchise, tmdb_id FROM {o_title_view}""")
def title_view(t):
    return W.title_view(t).select(
        "id", "slug", "kind", "title", "release_date", "runtime_minutes", "status", "poster_path", "popularity", "release_year",
        joined("genres").alias("genres"), joined("themes").alias("themes"), "primary_director", "franchise", "tmdb_id")


@query("person_view", """
    WITH parts AS (SELECT person_id, predicate, count(DISTINCT title_id) AS n FROM {credit} GROUP BY ALL),
    roles AS (SELECT person_id AS id, string_agg(concat(predicate, '=', n), '; ' ORDER BY predicate) AS told FROM parts GROUP BY 1),
    keyed AS (SELECT entity_id AS id, source_id AS tmdb_id FROM {external_id} WHERE (entity_type, source) = ('person', 'tmdb'))
    SELECT id, slug, name, sort_name, birthday, tmdb_id, ifnull(told, '') AS role_summary FROM {person} LEFT JOIN roles USING (id) LEFT JOIN keyed USING (id)""")
def person_view(t):
    roles = F.transform(F.array_sort(F.map_entries("role_summary")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return W.person_view(t).select("id", "slug", "name", "sort_name", "birthday", "tmdb_id", joined(roles).alias("role_summary"))


@query("concept_view", """
    SELECT c.id, c.scheme, c.slug, c.label, c.is_curated, count(e.id) AS title_count
    FROM {concept} c LEFT JOIN {edge} e ON e.object_type = 'concept' AND e.object_id = c.id GROUP BY ALL""")
def concept_view(t):
    return W.concept_view(t)


@query("title_credit", "SELECT * FROM {o_title_credit}")
def title_credit(t):
    return W.title_credit(t)


@query("title_full", """
    WITH told AS (
        FROM (SELECT title_id, 'cast' AS what, row_number() OVER (PARTITION BY title_id ORDER BY billing_order NULLS LAST, person_name, id) AS k, '' AS s, id AS i,
                     concat_ws('/', person_name, ifnull(character_name, '-'), ifnull(billing_order, -1)) AS line FROM {o_title_credit} WHERE predicate = 'acted_in')
        WHERE k <= 20
        UNION ALL SELECT title_id, 'crew', ifnull(list_position(['directed', 'wrote', 'composed_for'], predicate), 4), person_name, id, concat_ws('/', person_name, predicate, job)
        FROM {o_title_credit} WHERE predicate <> 'acted_in'
        UNION ALL SELECT e.subject_id, e.predicate, 0, CASE e.predicate WHEN 'based_on' THEN w.slug ELSE '' END, c.id,
               CASE e.predicate WHEN 'based_on' THEN concat_ws('/', w.slug, w.title, w.kind, ifnull(p.name, '-')) ELSE c.slug || '/' || c.name END
        FROM {edge} e LEFT JOIN {work} w ON (e.predicate, w.id) = ('based_on', e.object_id) LEFT JOIN {collection} c ON (e.predicate, c.id) = ('part_of_franchise', e.object_id)
        LEFT JOIN {person} p ON p.id = w.author_person_id WHERE w.id IS NOT NULL OR c.id IS NOT NULL)
    SELECT t.id, any_value(t.title) AS title, any_value(t.genres) AS genres,
           ifnull(string_agg(line, '; ' ORDER BY k, s, i) FILTER (what = 'cast'), '') AS cast_members, ifnull(string_agg(line, '; ' ORDER BY k, s, i) FILTER (what = 'crew'), '') AS crew,
           ifnull(string_agg(line, '; ' ORDER BY k, s, i) FILTER (what = 'based_on'), '') AS based_on,
           ifnull(string_agg(line, '; ' ORDER BY k, s, i) FILTER (what = 'part_of_franchise'), '') AS franchises
    FROM {o_title_view} t LEFT JOIN told ON told.title_id = t.id GROUP BY t.id""")
def title_full(t):
    f = W.title_full(t)

    def told(name, *fields):
        one = lambda s: F.concat_ws("/", *[F.coalesce(s[x].cast("string"), F.lit(d)) for x, d in fields])
        return F.coalesce(joined(F.transform(name, one)), F.lit("")).alias(name)

    return f.select(
        "id", "title", joined("genres").alias("genres"),
        told("cast_members", ("person_name", ""), ("character_name", "-"), ("billing_order", "-1")),
        told("crew", ("person_name", ""), ("predicate", ""), ("job", "")),
        told("based_on", ("slug", ""), ("title", ""), ("kind", ""), ("author", "-")), told("franchises", ("slug", ""), ("name", "")))


@query("availability_current", "SELECT title_id, region, offer_type, link, observed_at, organization_id, provider_name FROM {o_availability}")
def availability_current(t):
    return W.availability_current(t, AS_OF)


@query("season_view", f"""
    SELECT s.id, s.title_id, s.season_number, s.name, count(e.id) AS episode_count,
           count(e.id) FILTER (WHERE e.air_date <= {TODAY}) AS aired_count
    FROM {{season}} s LEFT JOIN {{episode}} e ON e.season_id = s.id GROUP BY ALL""")
def season_view(t):
    return W.season_view(t, AS_OF)


@query("episode_view", "SELECT id, title_id, season_id, season_number, episode_number, name, air_date, has_aired FROM {o_episode_view}")
def episode_view(t):
    return W.episode_view(t, AS_OF).select("id", "title_id", "season_id", "season_number", "episode_number", "name", "air_date", "has_aired")


@query("user_title", "SELECT * FROM {o_user_title}")
def user_title(t):
    return W.user_title(t, AS_OF)


@query("user_title_aired_only", f"""
    SELECT account_id, title_id, id AS next_episode_id, air_date FROM (
        SELECT s.account_id, s.title_id, e.id, e.air_date, row_number() OVER (PARTITION BY s.account_id, s.title_id
               ORDER BY e.season_number, e.episode_number, e.id) AS rn
        FROM {{title_state}} s JOIN {{o_episode_view}} e ON e.title_id = s.title_id
        WHERE e.has_aired AND NOT EXISTS (SELECT 1 FROM {{episode_progress}} p WHERE p.account_id = s.account_id AND p.episode_id = e.id)) x
    WHERE rn = 1""")
def user_title_aired_only(t):
    u = W.user_title(t, AS_OF, aired_only=True).filter(c("next_episode_id").isNotNull())
    return u.select("account_id", "title_id", "next_episode_id", c("next_episode_air_date").alias("air_date"))


@query("user_viewing", """
    SELECT v.id, v.account_id, v.title_id, v.episode_id, v.watched_on, v.date_precision, v.note, v.created_at, t.title, t.kind, t.poster_path
    FROM {viewing} v JOIN {title} t ON t.id = v.title_id""")
def user_viewing(t):
    return W.user_viewing(t)


@query("user_taste_affinity", "SELECT * FROM {o_affinity}")
def user_taste_affinity(t):
    return W.user_taste_affinity(t, AS_OF)


@query("user_taste_affinity_distinct", f"""
    WITH u AS (SELECT s.account_id, s.title_id FROM {{title_state}} s WHERE s.status = 'watched')
    SELECT u.account_id, e.object_type AS node_type, e.object_id AS node_id, e.predicate, count(DISTINCT e.subject_id) AS n_titles
    FROM u JOIN {{o_both}} e ON e.subject_type = 'title' AND e.subject_id = u.title_id
    JOIN {{o_node}} n ON n.node_type = e.object_type AND n.id = e.object_id
    WHERE e.predicate IN ('directed_by', 'written_by', 'features_actor', 'belongs_to_genre', 'explores_theme', 'part_of_franchise')
    GROUP BY 1, 2, 3, 4""")
def user_taste_affinity_distinct(t):
    return W.taste_parts(t, AS_OF, distinct_titles=True)[0].select("account_id", "node_type", "node_id", "predicate", "n_titles")


# integrity checks over edges as an import brings them

@query("check_declared", """
    SELECT 'declared' AS rule, 'edge' AS table_name, id AS key, predicate AS detail FROM {raw_edge}
    WHERE predicate NOT IN (SELECT predicate FROM {o_meta})""")
def check_declared(t):
    return V.check_declared(t.raw_edge, t.predicate_meta)


@query("check_storage", """
    SELECT 'storage' AS rule, 'edge' AS table_name, e.id AS key, e.predicate || ' belongs in ' || m.storage AS detail
    FROM {raw_edge} e JOIN {o_meta} m USING (predicate) WHERE m.storage <> 'edge'""")
def check_storage(t):
    return V.check_storage(t.raw_edge, t.predicate_meta, "edge")


@query("check_domain_range", """
    SELECT 'domain' AS rule, 'edge' AS table_name, e.id AS key, e.predicate || ' from ' || e.subject_type AS detail
    FROM {raw_edge} e JOIN {o_meta} m USING (predicate) WHERE NOT list_contains(m.domain_types, e.subject_type)
    UNION ALL
    SELECT 'range', 'edge', e.id, e.predicate || ' to ' || e.object_type
    FROM {raw_edge} e JOIN {o_meta} m USING (predicate) WHERE NOT list_contains(m.range_types, e.object_type)""")
def check_domain_range(t):
    return V.check_domain_range(t.raw_edge, t.predicate_meta)


@query("check_subtypes", """
    SELECT 'subtype' AS rule, 'edge' AS table_name, e.id AS key, e.predicate || ' to ' || coalesce(s.subtype, 'nothing') AS detail
    FROM {raw_edge} e JOIN {o_meta} m USING (predicate)
    LEFT JOIN (SELECT 'concept' AS k, id, scheme AS subtype FROM {concept} UNION ALL SELECT 'organization', id, kind FROM {organization}) s
           ON s.k = e.object_type AND s.id = e.object_id
    WHERE len(m.range_subtypes) > 0 AND (s.subtype IS NULL OR NOT list_contains(m.range_subtypes, s.subtype))""")
def check_subtypes(t):
    return V.check_subtypes(t.raw_edge, t.predicate_meta, t.concept, t.organization)


@query("check_orphans", f"""
    SELECT 'orphan' AS rule, 'edge' AS table_name, x.id AS key, side || ' ' || x.k || ' ' || x.i AS detail FROM (
        SELECT id, 'subject' AS side, subject_type AS k, subject_id AS i FROM {{raw_edge}}
        UNION ALL SELECT id, 'object', object_type, object_id FROM {{raw_edge}}) x
    WHERE x.k IN ({_NODE_TYPES}) AND NOT EXISTS (SELECT 1 FROM {{o_node}} n WHERE n.node_type = x.k AND n.id = x.i)""")
def check_orphans(t):
    return V.check_orphans(t.raw_edge, E.node(t))


@query("check_vocab", """
    SELECT 'viewing_date' AS rule, 'viewing' AS table_name, CAST(v.id AS VARCHAR) AS key, v.date_precision AS detail FROM {viewing} v
    WHERE (v.date_precision = 'unknown') <> (v.watched_on IS NULL)
    UNION ALL SELECT 'offer_type', 'availability', title_id || '/' || organization_id, offer_type FROM {availability}
    WHERE offer_type NOT IN ('flatrate', 'free', 'ads', 'rent', 'buy')
    UNION ALL SELECT 'rating_range', 'rating', CAST(event_id AS VARCHAR), CAST(CAST(floor(value / 10) AS INTEGER) AS VARCHAR) FROM events
    WHERE CAST(floor(value / 10) AS INTEGER) NOT BETWEEN 1 AND 10
    UNION ALL SELECT 'status', 'title_state', user_id || '/' || event_id, event_type FROM events
    WHERE event_type NOT IN ('watchlist', 'watching', 'watched', 'abandoned')""")
def check_vocab(t):
    # events stand in for rows of an import that ignores the vocabulary
    rating = t.events.select(c("event_id").alias("id"), F.floor(c("value") / 10).cast("int").alias("value"))
    state = t.events.select(c("user_id").alias("account_id"), c("event_id").alias("title_id"), c("event_type").alias("status"))
    return V.check_vocab(t.replace(rating=rating, title_state=state))


@query("check_keys", """
    SELECT 'unique' AS rule, 'edge' AS table_name, subject_type || '|' || subject_id || '|' || predicate || '|' || object_type || '|' || object_id AS key,
           CAST(count(*) AS VARCHAR) AS detail FROM {raw_edge} GROUP BY 3 HAVING count(*) > 1
    UNION ALL
    SELECT 'unique', 'crosswalk', lower(l_returnflag) || '|' || CASE WHEN l_linestatus = 'F' THEN '1' ELSE '' END, CAST(count(*) AS VARCHAR)
    FROM lineitem GROUP BY 3 HAVING count(*) > 1""")
def check_keys(t):
    # order lines as a crosswalk repeat every key, NULL concepts included
    crosswalk = t.lineitem.select(c("l_returnflag").alias("keyword_label"), F.when(c("l_linestatus") == "F", 1).alias("concept_id"))
    return V.check_keys(t.replace(edge=t.raw_edge, crosswalk=crosswalk))


@query("check_ontology", """
    WITH used AS (SELECT predicate, count(*) AS n FROM {o_edge} GROUP BY 1)
    SELECT m.predicate, coalesce(u.n, 0) AS edges, CAST(0 AS BIGINT) AS problems FROM {o_meta} m LEFT JOIN used u USING (predicate)""")
def check_ontology(t):
    use = E.edge(t.credit, t.edge, t.edge_derived).groupBy("predicate").agg(F.count("*").alias("edges"))
    problems = V.check_ontology(t.predicate_meta).groupBy(c("key").alias("predicate")).agg(F.count("*").alias("problems"))
    out = t.predicate_meta.select("predicate").join(use, "predicate", "left").join(problems, "predicate", "left")
    return out.fillna(0, ["edges", "problems"])


