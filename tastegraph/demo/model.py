"""The graph model projected from the given tables, as SQL both Spark and DuckDB accept.

Each entry is one model table. ``{name}`` marks an input: a given table or another model table.
"""

from __future__ import annotations

AS_OF = "2001-12-31 00:00:00"
LISTING_AS_OF = "2001-06-30 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

SOURCES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

MODEL: dict[str, str] = {
    # one row per order line, with its order
    "line": """
        SELECT l.*, o.o_custkey AS account_id, o.o_orderstatus AS ostatus, o.o_orderdate AS odate,
               o.o_orderpriority AS opriority
        FROM (SELECT l_orderkey AS orderkey, l_partkey AS title_id, l_linenumber AS lineno,
                     min(l_suppkey) AS person_id, max(l_quantity) AS qty, max(l_discount) AS disc,
                     max(l_tax) AS tax, max(l_returnflag) AS flag, max(l_linestatus) AS lstatus,
                     min(l_shipdate) AS ship
              FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_linenumber) l
        JOIN {orders} o ON o.o_orderkey = l.orderkey""",
    "title": """
        SELECT p.p_partkey AS id,
               replace(p.p_name, ' ', '-') || '-' || CAST(p.p_partkey AS STRING) AS slug,
               CASE WHEN p.p_size <= 25 THEN 'movie' ELSE 'show' END AS kind,
               p.p_name AS title, upper(p.p_name) AS original_title,
               replace(p.p_name, ' ', '') AS sort_title,
               CAST(d.last_ship AS DATE) AS release_date,
               60 + p.p_size AS runtime_minutes,
               CASE p.p_type WHEN 'PROMO' THEN 'Returning Series' WHEN 'LARGE' THEN 'Planned'
                             ELSE 'Ended' END AS status,
               CASE WHEN p.p_type <> 'SMALL' THEN '/p' || CAST(p.p_partkey AS STRING) || '.jpg'
                    END AS poster_path,
               lower(p.p_brand) AS accent_color,
               p.p_retailprice AS popularity,
               coalesce(d.n_lines, 0) AS vote_count,
               CAST('2001-12-31 00:00:00' AS TIMESTAMP) - INTERVAL 1 DAY * (p.p_size * 3) AS synced_at
        FROM {part} p
        LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_ship, count(*) AS n_lines
                   FROM {lineitem} GROUP BY l_partkey) d ON d.l_partkey = p.p_partkey""",
    "person": """
        SELECT s_suppkey AS id, 'supplier-' || CAST(s_suppkey AS STRING) AS slug, s_name AS name,
               lower(replace(s_name, 'Supplier#', '')) || ' supplier' AS sort_name,
               CAST('1950-01-01' AS DATE) + s_nationkey * 365 AS birthday,
               CASE WHEN s_nationkey < 12 THEN 'Acting' ELSE 'Directing' END AS known_for_department,
               CASE WHEN s_nationkey <> 3 THEN '/s' || CAST(s_suppkey AS STRING) || '.jpg' END AS profile_path,
               s_acctbal AS popularity,
               CASE WHEN s_nationkey >= 8 THEN CAST('2001-06-01 00:00:00' AS TIMESTAMP) END AS detail_synced_at
        FROM {supplier}""",
    "crosswalk": """
        SELECT keyword_label, CAST(concept_id AS BIGINT) AS concept_id, CAST(salience AS DOUBLE) AS salience
        FROM (VALUES ('Hot', 101, 0.75), ('red', 101, 0.5), ('cold', 102, 0.75), ('blue', 102, 0.5),
                     ('old', 103, 0.75), ('anvil', 103, 0.25), ('new', 104, 0.75), ('gizmo', 104, 0.5),
                     ('gear', 105, 0.75), ('bolt', 105, 0.5), ('rod', 105, 0.25), ('small', 106, 0.5),
                     ('large', 107, 0.5), ('large', 103, 0.5), ('plate', 106, 0.25), ('small', 104, 0.25),
                     ('ring', NULL, 0.0), ('widget', NULL, 0.0)) AS c(keyword_label, concept_id, salience)""",
    "concept": """
        SELECT CAST(substring(p_brand, 7) AS BIGINT) AS id, 'genre' AS scheme,
               lower(replace(p_brand, '#', '-')) AS slug, p_brand AS label, false AS is_curated
        FROM (SELECT DISTINCT p_brand FROM {part}) b
        UNION ALL
        SELECT CAST(id AS BIGINT), 'theme', lower(label), label, true
        FROM (VALUES (101, 'Heat'), (102, 'Cold'), (103, 'Memory'), (104, 'Invention'), (105, 'Machinery'),
                     (106, 'Smallness'), (107, 'Scale')) AS v(id, label)""",
    "collection": """
        SELECT DISTINCT CAST(floor(p_size / 5) AS BIGINT) AS id,
               'size-' || CAST(CAST(floor(p_size / 5) AS BIGINT) AS STRING) AS slug, 'franchise' AS kind,
               'Size ' || CAST(CAST(floor(p_size / 5) AS BIGINT) AS STRING) AS name
        FROM {part}""",
    "organization": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS slug, n_name AS name, 'studio' AS kind
        FROM {nation}
        UNION ALL
        SELECT CAST(r_regionkey + 100 AS BIGINT), lower(r_name), r_name, 'network' FROM {region}""",
    "work": """
        SELECT DISTINCT CAST(ascii(substring(p_type, 1, 1)) * 1000 + ascii(substring(p_type, 2, 1)) AS BIGINT) AS id,
               lower(p_type) AS slug, 'book' AS kind, p_type AS title,
               CAST(ascii(substring(p_type, 1, 1)) % 5 AS BIGINT) AS author_person_id
        FROM {part}""",
    "character": """
        SELECT DISTINCT CAST(round(l_tax * 100) AS BIGINT) AS id,
               'role-' || CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING) AS slug,
               'Role ' || CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING) AS name
        FROM {lineitem} WHERE l_tax > 0.004""",
    "credit": """
        SELECT CAST(person_id AS STRING) || '-' || CAST(title_id AS STRING) || '-' || predicate || '-' ||
               job || '-' || CAST(coalesce(episode_id, 0) AS STRING) AS id, c.*
        FROM (SELECT x.l_suppkey AS person_id, x.l_partkey AS title_id,
                     CASE WHEN x.l_linenumber = 7 AND p.p_size > 25
                          THEN x.l_partkey * 1000000000 + x.l_orderkey * 10 + 7 END AS episode_id,
                     CASE x.l_linenumber WHEN 1 THEN 'directed' WHEN 2 THEN 'wrote' WHEN 3 THEN 'composed_for'
                          WHEN 4 THEN 'shot' ELSE 'acted_in' END AS predicate,
                     x.l_returnflag AS job,
                     max(CASE WHEN x.l_linenumber >= 5 AND x.l_tax > 0.004
                              THEN CAST(round(x.l_tax * 100) AS BIGINT) END) AS character_id,
                     max(CASE WHEN x.l_linenumber >= 5 THEN x.l_linestatus END) AS character_name_raw,
                     CAST(min(CASE WHEN x.l_linenumber >= 5 THEN x.l_orderkey % 10 END) AS INT) AS billing_order,
                     round(max(1 - x.l_discount), 2) AS confidence
              FROM {lineitem} x JOIN {part} p ON p.p_partkey = x.l_partkey
              GROUP BY 1, 2, 3, 4, 5) c""",
    "title_keyword": """
        SELECT p_partkey AS title_id, substring(p_name, 1, instr(p_name, ' ') - 1) AS keyword_label FROM {part}
        UNION ALL
        SELECT p_partkey, substring(p_name, instr(p_name, ' ') + 1) FROM {part}""",
    "theme_edge": """
        SELECT title_id, concept_id, least(score, 1.0E0) AS salience
        FROM (SELECT k.title_id, c.concept_id, sum(c.salience) AS score,
                     row_number() OVER (PARTITION BY k.title_id
                                        ORDER BY sum(c.salience) DESC, c.concept_id) AS rn
              FROM {title_keyword} k JOIN {crosswalk} c ON lower(c.keyword_label) = lower(k.keyword_label)
              WHERE c.concept_id IS NOT NULL GROUP BY k.title_id, c.concept_id) s
        WHERE score >= 0.5 AND rn <= 6""",
    "edge": """
        SELECT 'g' || CAST(p_partkey AS STRING) AS id, 'title' AS subject_type, p_partkey AS subject_id,
               'belongs_to_genre' AS predicate, 'concept' AS object_type,
               CAST(substring(p_brand, 7) AS BIGINT) AS object_id, CAST(NULL AS DOUBLE) AS salience,
               'asserted' AS provenance, 'tmdb' AS source, 1.0E0 AS confidence FROM {part}
        UNION ALL
        SELECT 't' || CAST(title_id AS STRING) || '-' || CAST(concept_id AS STRING), 'title', title_id,
               'explores_theme', 'concept', concept_id, salience, 'curated', 'crosswalk', 1.0E0 FROM {theme_edge}
        UNION ALL
        SELECT 'f' || CAST(p_partkey AS STRING), 'title', p_partkey, 'part_of_franchise', 'collection',
               CAST(floor(p_size / 5) AS BIGINT), NULL, 'asserted', 'tmdb', 1.0 FROM {part}
        UNION ALL
        SELECT 'p' || CAST(l.l_partkey AS STRING), 'title', l.l_partkey, 'produced_by', 'organization',
               CAST(s.s_nationkey AS BIGINT), NULL, 'asserted', 'tmdb', 1.0E0
        FROM (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_partkey) l
        JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
        UNION ALL
        SELECT 'a' || CAST(l.l_partkey AS STRING), 'title', l.l_partkey, 'aired_on', 'organization',
               CAST(n.n_regionkey + 100 AS BIGINT), NULL, 'asserted', 'tmdb', 1.0E0
        FROM (SELECT l_partkey, max(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_partkey) l
        JOIN {part} p ON p.p_partkey = l.l_partkey AND p.p_size > 25
        JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {nation} n ON n.n_nationkey = s.s_nationkey
        UNION ALL
        SELECT 'b' || CAST(p_partkey AS STRING), 'title', p_partkey, 'based_on', 'work',
               CAST(ascii(substring(p_type, 1, 1)) * 1000 + ascii(substring(p_type, 2, 1)) AS BIGINT),
               NULL, 'asserted', 'wikidata', 0.9E0 FROM {part} WHERE p_size <= 25""",
    "edge_derived": """
        SELECT 'd' || CAST(a AS STRING) || '-' || CAST(b AS STRING) AS id, 'title' AS subject_type, a AS subject_id,
               'similar_to' AS predicate, 'title' AS object_type, b AS object_id,
               'same_name_v1' AS method, 0.5E0 + (b - a) % 7 / 20.0E0 AS score,
               CASE WHEN (b - a) % 2 = 0 THEN 'franchise' ELSE 'theme' END AS reason, 0.5E0 AS confidence
        FROM (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS b
              FROM {part}) x WHERE b IS NOT NULL""",
    "external_id": """
        SELECT CASE WHEN p_size <= 25 THEN 'tmdb' ELSE 'tmdb_tv' END AS source,
               CAST(p_partkey + 5000 AS STRING) AS source_id, 'title' AS entity_type, p_partkey AS entity_id,
               true AS is_primary FROM {part}
        UNION ALL
        SELECT 'imdb', 'tt' || CAST(p_partkey AS STRING), 'title', p_partkey, false FROM {part}
        UNION ALL
        SELECT 'tmdb', CAST(s_suppkey AS STRING), 'person', s_suppkey, true FROM {supplier}""",
    "account": """
        SELECT c_custkey AS id, c_name AS display_name, substring(c_mktsegment, 1, 2) AS region,
               c_acctbal > 9900 AS is_admin,
               CAST('1995-01-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 HOUR * c_custkey AS created_at,
               CASE WHEN c_acctbal < -900 THEN CAST('2001-01-01 00:00:00' AS TIMESTAMP) END AS deleted_at
        FROM {customer}""",
    "status_intent": """
        SELECT account_id, title_id, orderkey * 10 + lineno AS event_id, odate AS occurred_at,
               CASE ostatus WHEN 'F' THEN 'watched' WHEN 'P' THEN 'watching'
                    ELSE CASE WHEN opriority = '5-LOW' THEN 'abandoned' ELSE 'watchlist' END END AS status
        FROM {line}""",
    "title_state": """
        SELECT account_id, title_id, status, is_favorite,
               CASE WHEN is_favorite THEN odate END AS favorited_at, added_at, started_at, completed_at,
               odate AS updated_at
        FROM (SELECT l.account_id, l.title_id, l.odate,
                     CASE l.ostatus WHEN 'F' THEN 'watched' WHEN 'P' THEN 'watching'
                          ELSE CASE WHEN l.opriority = '5-LOW' THEN 'abandoned' ELSE 'watchlist' END END AS status,
                     l.opriority = '1-URGENT' AS is_favorite,
                     min(l.odate) OVER (PARTITION BY l.account_id, l.title_id) AS added_at,
                     min(CASE WHEN l.ostatus IN ('F', 'P') THEN l.odate END)
                       OVER (PARTITION BY l.account_id, l.title_id) AS started_at,
                     min(CASE WHEN l.ostatus = 'F' THEN l.odate END)
                       OVER (PARTITION BY l.account_id, l.title_id) AS completed_at,
                     row_number() OVER (PARTITION BY l.account_id, l.title_id
                                        ORDER BY l.odate DESC, l.orderkey DESC, l.lineno DESC) AS rn
              FROM {line} l) s WHERE rn = 1""",
    "rating": """
        SELECT orderkey * 10 + lineno AS id, account_id, title_id, CAST(ceil(qty / 5) AS INT) AS value,
               ship AS rated_at,
               lead(ship) OVER (PARTITION BY account_id, title_id ORDER BY ship, orderkey, lineno) AS superseded_at
        FROM {line} WHERE ostatus = 'F'""",
    "season": """
        SELECT DISTINCT l_partkey * 10 + (l_linenumber - 1) AS id, l_partkey AS title_id,
               l_linenumber - 1 AS season_number,
               'Season ' || CAST(l_linenumber - 1 AS STRING) AS name
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_size > 25""",
    "episode": """
        SELECT l_partkey * 1000000000 + l_orderkey * 10 + l_linenumber AS id,
               l_partkey * 10 + (l_linenumber - 1) AS season_id, l_partkey AS title_id,
               CAST(row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey) AS INT) AS episode_number,
               'Episode ' || CAST(l_orderkey AS STRING) AS name,
               CAST(min(l_shipdate) AS DATE) + 365 AS air_date
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_size > 25
        GROUP BY l_partkey, l_orderkey, l_linenumber""",
    "episode_progress": """
        SELECT account_id, title_id, title_id * 1000000000 + orderkey * 10 + lineno AS episode_id, ship AS watched_at
        FROM {line} JOIN {part} ON p_partkey = title_id WHERE p_size > 25 AND ostatus IN ('F', 'P')""",
    "viewing": """
        SELECT orderkey * 10 + lineno AS id, account_id, title_id,
               CASE WHEN lineno >= 4 AND p_size > 25
                    THEN title_id * 1000000000 + orderkey * 10 + lineno END AS episode_id,
               CASE WHEN lineno <> 7 THEN CAST(ship AS DATE) END AS watched_on,
               CASE lineno WHEN 7 THEN 'unknown' WHEN 6 THEN 'month' ELSE 'day' END AS date_precision,
               'seen "' || opriority || '", again' AS note, odate AS created_at
        FROM {line} JOIN {part} ON p_partkey = title_id WHERE ostatus = 'F'""",
    "share": """
        SELECT 's' || CAST(orderkey AS STRING) || '-' || CAST(lineno AS STRING) || '-' || CAST(title_id AS STRING) AS slug,
               account_id, title_id, disc > 0.05 AS include_rating, odate AS created_at,
               CASE WHEN flag = 'R' THEN ship END AS revoked_at
        FROM {line} WHERE opriority = '2-HIGH'""",
    "share_view": """
        SELECT s.slug, e.event_id, e.ts,
               CASE e.event_type WHEN 'error' THEN 'Googlebot/2.1 (+http://example.test)'
                    WHEN 'view' THEN 'Slackbot-LinkExpanding 1.0' ELSE 'Mozilla/5.0 (X11; Linux)' END AS user_agent
        FROM {events} e JOIN {share} s ON s.account_id = e.user_id""",
    "auth_session": """
        SELECT event_id AS id, user_id, ts AS created_at, ts + INTERVAL 14 DAY AS expires_at
        FROM {events} WHERE event_type = 'signup'""",
    "availability_snapshot": """
        SELECT l_partkey AS title_id, CAST(s_nationkey AS BIGINT) AS organization_id,
               CASE WHEN l_linestatus = 'F' THEN 'US' ELSE 'GB' END AS region,
               CASE l_returnflag WHEN 'A' THEN 'flatrate' WHEN 'N' THEN 'rent' ELSE 'ads' END AS offer_type,
               max(CASE WHEN l_linenumber > 1 THEN 'http://watch.test/' || CAST(l_partkey AS STRING) || '/' ||
                   CAST(l_linenumber AS STRING) END) AS link,
               CASE WHEN year(l_shipdate) < 1998 THEN 1 ELSE 2 END AS snapshot_no
        FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey
        GROUP BY 1, 2, 3, 4, 6""",
    "availability": """
        SELECT title_id, organization_id, region, offer_type, link,
               CAST('2001-01-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 HOUR * title_id AS observed_at,
               CASE WHEN organization_id % 4 = 1 THEN CAST('2001-06-01 00:00:00' AS TIMESTAMP) END AS valid_to
        FROM {availability_snapshot} WHERE snapshot_no = 1""",
    "job": """
        SELECT event_id AS id,
               CASE event_type WHEN 'signup' THEN 'hydrate_title' WHEN 'view' THEN 'refresh_degree'
                    WHEN 'click' THEN 'refresh_stale' WHEN 'error' THEN 'hydrate_people' ELSE 'housekeeping' END AS kind,
               CASE WHEN value < 5 THEN 'queued' WHEN value < 10 THEN 'failed' ELSE 'done' END AS status,
               CAST(1 + event_id % 3 AS INT) AS attempts, ts AS created_at, ts AS run_after,
               CASE WHEN value >= 10 THEN ts + INTERVAL 1 HOUR END AS finished_at,
               CASE WHEN value >= 5 AND value < 10 THEN 'bad payload ' || props END AS last_error
        FROM {events}""",
    "listing": """
        SELECT p_partkey + 5000 AS provider_id, p_partkey AS position,
               CASE WHEN p_size <= 25 THEN 'movie' WHEN p_size = 50 THEN 'person' ELSE 'tv' END AS media_type,
               CASE WHEN p_type = 'SMALL' THEN '' ELSE p_name END AS title,
               CASE WHEN p_type <> 'MEDIUM' THEN '/p' || CAST(p_partkey AS STRING) || '.jpg' END AS poster_path,
               CAST(d.last_ship AS DATE) AS release_date, p_retailprice AS popularity,
               coalesce(d.n_lines, 0) AS vote_count, p_brand AS listing_name
        FROM {part} LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_ship, count(*) AS n_lines
                               FROM {lineitem} GROUP BY l_partkey) d ON d.l_partkey = p_partkey""",
    # edges as an import might bring them, right and wrong ones
    "raw_edge": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS id,
               CASE WHEN l_linestatus = 'F' THEN 'person' ELSE 'title' END AS subject_type, l_suppkey AS subject_id,
               CASE l_linenumber WHEN 1 THEN 'directed' WHEN 2 THEN 'sequel' WHEN 3 THEN 'belongs_to_genre'
                    WHEN 4 THEN 'produced_by' WHEN 5 THEN 'similar_to' WHEN 6 THEN 'explores_theme' ELSE 'acted_in' END AS predicate,
               CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'N' THEN 'concept' ELSE 'organization' END AS object_type,
               l_partkey % 200 AS object_id
        FROM {lineitem}""",
    # resolution: labelled documents are the catalogue, every document arrives again from a feed
    "er_title": """
        SELECT d.doc_id AS id, d.lang AS kind, d.source || ' ' || CAST(d.n_chars AS STRING) AS title,
               CAST(1990 + floor(d.n_chars / 200) AS INT) AS release_year, d.n_chars AS runtime_minutes
        FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    "er_incoming": """
        SELECT doc_id AS incoming_id, lang AS kind, source || ' ' || CAST(n_chars AS STRING) AS title,
               text AS content,
               CASE WHEN n_chars > 120 THEN CAST(1990 + floor(n_chars / 200) AS INT) END AS release_year,
               n_chars AS runtime_minutes,
               CAST(doc_id AS STRING) AS source_id, 'ext' || CAST(n_chars AS STRING) AS imdb_id
        FROM {documents}""",
    "er_external_id": """
        SELECT 'feed' AS source, CAST(d.doc_id AS STRING) AS source_id, 'title' AS entity_type,
               d.doc_id AS entity_id FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id
        WHERE l.quality = 1
        UNION ALL
        SELECT 'imdb', 'ext' || CAST(d.n_chars AS STRING), 'title', min(d.doc_id)
        FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.toxic = 1 GROUP BY d.n_chars""",
}

DEPENDS: dict[str, tuple[str, ...]] = {}


def _dependencies() -> None:
    import re

    for name, sql in MODEL.items():
        DEPENDS[name] = tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


_dependencies()


def duckdb_ctes(needed: list[str]) -> str:
    """``name AS (...)`` clauses for the wanted model tables and everything below them."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done or name not in MODEL:
            return
        for dep in DEPENDS[name]:
            visit(dep)
        done.append(name)

    for name in needed:
        visit(name)
    clauses = []
    for name in done:
        text = MODEL[name].format(**{d: d for d in DEPENDS[name]})
        clauses.append(f"{name} AS ({text})")
    return ",\n".join(clauses)
