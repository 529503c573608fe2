"""Column functions over whole tables."""

from pyspark.sql import functions as F

from tastegraph.demo.model import AS_OF
from tastegraph.demo.oracle_views import NOW, TODAY, norm_person, norm_title, sim, slug
from tastegraph.demo.registry import query
from tastegraph.functions import scalars as S
from tastegraph.functions import text as X

c = F.col


@query("normalize_title", f"SELECT incoming_id, {norm_title('content')} AS normalized FROM {{er_incoming}}")
def normalize_title(t):
    return t.er_incoming.select("incoming_id", X.normalize_title(c("content")).alias("normalized"))


@query("strip_diacritics", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def strip_diacritics(t):
    return t.documents.select("doc_id", X.strip_diacritics(c("text")).alias("folded"))


@query("normalize_person_name", f"SELECT incoming_id, {norm_person('content')} AS normalized FROM {{er_incoming}}")
def normalize_person_name(t):
    return t.er_incoming.select("incoming_id", X.normalize_person_name(c("content")).alias("normalized"))


_N = norm_person("content")


@query("person_sort_name", f"""
    SELECT incoming_id, CASE WHEN len(string_split(n, ' ')) < 2 THEN n
           ELSE string_split(n, ' ')[-1] || ' ' || array_to_string(string_split(n, ' ')[1:-2], ' ') END AS sort_name
    FROM (SELECT incoming_id, {_N} AS n FROM {{er_incoming}}) x""")
def person_sort_name(t):
    return t.er_incoming.select("incoming_id", X.person_sort_name(c("content")).alias("sort_name"))


@query("slugify", f"SELECT incoming_id, {slug('content')} AS slug, {slug('content')} || '-' || release_year AS dated FROM {{er_incoming}} WHERE release_year IS NOT NULL")
def slugify(t):
    dated = t.er_incoming.filter(c("release_year").isNotNull())
    return dated.select("incoming_id", X.slugify(c("content")).alias("slug"), X.slugify(c("content"), c("release_year")).alias("dated"))


@query("trigram_similarity", f"""
    SELECT id, round({sim('a', 'b')}, 6) AS sim FROM (
        SELECT p_partkey AS id, p_name AS a, lower(p_type || ' ' || p_name || ' ' || p_brand) AS b FROM part) x""")
def trigram_similarity(t):
    p = t.part.select(c("p_partkey").alias("id"), c("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("b"))
    return p.select("id", F.round(X.trigram_similarity(c("a"), c("b")), 6).alias("sim"))


_OFFER = """p_brand || CASE p_type WHEN 'PROMO' THEN ' Plus Premium' WHEN 'SMALL' THEN ' Amazon Channel' WHEN 'LARGE' THEN ' Basic with Ads'
            WHEN 'MEDIUM' THEN ' Roku Premium Channel' WHEN 'ECONOMY' THEN ' Plus ad-free' ELSE ' Store' END"""


@query("service_name", f"""
    SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(o,
           '(?i)\\s+(?:Amazon|Roku|Apple TV)(?:\\s+Premium)?\\s+Channel$', ''), '(?i)\\s+Plus\\b', '+'),
           '(?i)\\s+(?:with\\s+Ads|Ad[-\\s]?Free)$', ''), '(?i)\\s+(?:Essential|Premium|Basic|Standard)$', '')) AS service
    FROM (SELECT p_partkey AS id, {_OFFER} AS o FROM part) x""")
def service_name(t):
    return t.part.select(c("p_partkey").alias("id"), X.service_name(F.expr(_OFFER)).alias("service"))


@query("release_year", "SELECT id, year(release_date) AS release_year FROM {title}")
def release_year(t):
    return t.title.select("id", S.release_year(c("release_date")).alias("release_year"))


@query("recency_decay", f"""
    SELECT account_id, title_id, round(CASE WHEN completed_at IS NULL THEN 0.5
           ELSE greatest(0.25, exp(-0.0019 * (epoch_us({NOW}) - epoch_us(completed_at)) / 1e6 / 86400.0)) END, 6) AS weight
    FROM {{title_state}}""")
def recency_decay(t):
    return t.title_state.select("account_id", "title_id", F.round(S.recency_decay(c("completed_at"), AS_OF), 6).alias("weight"))


@query("title_max_age", f"""
    SELECT id, CASE WHEN release_date IS NULL OR release_date > {TODAY} - 180 THEN 7
           WHEN kind = 'show' AND status IN ('Returning Series', 'In Production', 'Planned', 'Pilot') THEN 7 ELSE 90 END AS days
    FROM {{title}}""")
def title_max_age(t):
    return t.title.select("id", S.title_max_age(c("kind"), c("status"), c("release_date"), AS_OF).alias("days"))


@query("stars_to_value", """
    SELECT id, stars, CASE WHEN floor(stars * 2 + 0.5) BETWEEN 1 AND 10 THEN CAST(floor(stars * 2 + 0.5) AS INTEGER) END AS value
    FROM (SELECT event_id AS id, floor(value) / 4 AS stars FROM events) e""")
def stars_to_value(t):
    e = t.events.select(c("event_id").alias("id"), (F.floor("value") / 4).alias("stars"))
    return e.select("id", "stars", S.stars_to_value(c("stars")).alias("value"))


@query("value_to_stars", "SELECT id, value / 2.0E0 AS stars FROM {rating}")
def value_to_stars(t):
    return t.rating.select("id", S.value_to_stars(c("value")).alias("stars"))


@query("path_strength", """
    SELECT id, CASE WHEN per < 5 THEN 'Strong' WHEN per < 8 THEN 'Moderate' ELSE 'Faint' END AS strength
    FROM (SELECT p_partkey AS id, CASE WHEN p_size % 4 > 0 THEN p_retailprice / 60 / (p_size % 4) ELSE p_retailprice / 60 END AS per
          FROM part) x""")
def path_strength(t):
    return t.part.select(c("p_partkey").alias("id"), S.path_strength(c("p_retailprice") / 60, c("p_size") % 4).alias("strength"))


@query("reason_phrase", """
    SELECT person_id, predicate, CASE predicate WHEN 'directed' THEN 'directed ' || n || ' you''ve seen'
           WHEN 'wrote' THEN 'wrote ' || n || ' you''ve seen' WHEN 'acted_in' THEN 'in ' || n || ' you''ve seen'
           WHEN 'composed_for' THEN 'scored ' || n || ' you''ve seen' ELSE 'shot ' || n || ' you''ve seen' END AS phrase
    FROM (SELECT person_id, predicate, count(*) AS n FROM {credit} GROUP BY 1, 2) x""")
def reason_phrase(t):
    n = t.credit.groupBy("person_id", "predicate").agg(F.count("*").alias("n"))
    return n.select("person_id", "predicate", S.reason_phrase(c("predicate"), c("n")).alias("phrase"))


@query("narrate", """
    SELECT e.id, upper(substr(s, 1, 1)) || substr(s, 2) || '.' AS sentence FROM (
        SELECT c.id, replace(replace('{subject} was directed by {object}', '{subject}', t.title), '{object}', p.name) || ', ' ||
               replace(replace('{subject} directed {object}', '{subject}', 'who'), '{object}', upper(t.title)) AS s
        FROM {credit} c JOIN {title} t ON t.id = c.title_id JOIN {person} p ON p.id = c.person_id WHERE c.predicate = 'directed') e""")
def narrate(t):
    title = t.title.select(c("id").alias("title_id"), "title")
    person = t.person.select(c("id").alias("person_id"), "name")
    rows = t.credit.filter("predicate = 'directed'").join(title, "title_id").join(person, "person_id")

    def step(template, label, kind):
        return F.struct(F.lit(template).alias("template"), F.lit("directed").alias("label"), label.alias("object_label"),
                        F.lit(kind).alias("object_type"))

    steps = F.array(step("{subject} was directed by {object}", c("name"), "person"),
                    step("{subject} directed {object}", F.upper("title"), "title"))
    return rows.select("id", S.narrate(c("title"), steps).alias("sentence"))


@query("squash", "SELECT p_partkey AS id, round(p_size / (p_size + 8.0E0), 4) AS score FROM part")
def squash(t):
    return t.part.select(c("p_partkey").alias("id"), F.round(S.squash(c("p_size")), 4).alias("score"))


@query("share_pct", """
    SELECT title_id, CAST(floor(100.0E0 * count(*) FILTER (WHERE predicate = 'directed') /
           nullif(count(*) FILTER (WHERE predicate = 'wrote'), 0) + 0.5) AS INTEGER) AS pct FROM {credit} GROUP BY 1""")
def share_pct(t):
    g = t.credit.groupBy("title_id").agg(F.count_if(c("predicate") == "directed").alias("a"), F.count_if(c("predicate") == "wrote").alias("b"))
    return g.select("title_id", S.share_pct(c("a"), c("b")).alias("pct"))


@query("is_bot", """
    SELECT slug, event_id, coalesce(regexp_matches(user_agent,
           '(?i)bot|crawler|spider|facebookexternalhit|slackbot|whatsapp|telegram|discord|preview|curl|wget|headless'), false) AS bot
    FROM {share_view}""")
def is_bot(t):
    return t.share_view.select("slug", "event_id", X.is_bot(c("user_agent")).alias("bot"))


@query("bucket_of", """
    SELECT event_id, CASE WHEN value < 30 THEN 0 WHEN value < 90 THEN 1 WHEN value < 180 THEN 2 WHEN value < 365 THEN 3 ELSE 4 END AS bucket
    FROM events""")
def bucket_of(t):
    return t.events.select("event_id", S.bucket_of(c("value"), [30, 90, 180, 365]).alias("bucket"))


@query("tuple_le", """
    SELECT id, (season_number < 3 OR (season_number = 3 AND episode_number <= 2)) AS before FROM {o_episode_view}""")
def tuple_le(t):
    from tastegraph.operators.views import episode_view

    e = episode_view(t, AS_OF)
    return e.select("id", S.tuple_le([c("season_number").cast("int"), c("episode_number")], [F.lit(3), F.lit(2)]).alias("before"))


_PIXELS = """
    SELECT vec_id AS image_id, CAST(floor(greatest(0, least(1, (embedding[(3 * i - 3) % 64 + 1] + 0.25) * 2)) * 255) AS INTEGER) AS r,
           CAST(floor(greatest(0, least(1, (embedding[(3 * i - 2) % 64 + 1] + 0.25) * 2)) * 255) AS INTEGER) AS g,
           CAST(floor(greatest(0, least(1, (embedding[(3 * i - 1) % 64 + 1] + 0.25) * 2)) * 255) AS INTEGER) AS b
    FROM embeddings, (SELECT unnest(generate_series(1, 22)) AS i) k"""


def pixels(t):
    """Twenty-two pixels per vector from its 64 dimensions, three at a time; the last one goes round to the first two."""
    level = lambda e: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (e.cast("double") + 0.25) * 2)) * 255).cast("int")
    rows = t.embeddings.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(22))).alias("i"))
    at = lambda shift: level(F.get("embedding", (c("i") * 3 - shift) % 64))
    return rows.select(c("vec_id").alias("image_id"), at(3).alias("r"), at(2).alias("g"), at(1).alias("b"))


@query("accent_color", f"""
    WITH px AS ({_PIXELS}),
    n AS (SELECT image_id, r / 255.0E0 AS r, g / 255.0E0 AS g, b / 255.0E0 AS b FROM px),
    m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM n),
    hsl AS (SELECT image_id, (hi + lo) / 2 AS l,
                   CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s,
                   60 * CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END
                             WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END AS h FROM m),
    bins AS (SELECT image_id, least(23, floor(h / 15)) AS bin, sum(s) AS w, avg(cos(radians(h))) AS x, avg(sin(radians(h))) AS y, avg(l) AS l
             FROM hsl WHERE s >= 0.18 AND l BETWEEN 0.12 AND 0.88 GROUP BY 1, 2),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w DESC, bin) AS rn FROM bins) z WHERE rn = 1),
    col AS (SELECT image_id, degrees(atan2(y, x)) AS h, greatest(0.46, least(0.62, l)) AS l FROM best),
    ch AS (SELECT image_id, unnest([0, 8, 4]) AS n, unnest([1, 2, 3]) AS o, h, l, 0.62 * least(l, 1 - l) AS a FROM col),
    v AS (SELECT image_id, o, floor(greatest(0, least(1, l - a * greatest(-1, least(k - 3, 9 - k, 1)))) * 255 + 0.5) AS v
          FROM (SELECT *, n + h / 30 - 12 * floor((n + h / 30) / 12) AS k FROM ch) q)
    SELECT e.vec_id AS image_id, x.accent_color FROM embeddings e LEFT JOIN
        (SELECT image_id, '#' || string_agg(lpad(upper(to_hex(CAST(v AS BIGINT))), 2, '0'), '' ORDER BY o) AS accent_color
         FROM v GROUP BY 1) x ON x.image_id = e.vec_id""")
def accent_color(t):
    return S.accent_color(pixels(t))


@query("edge_attributes", """
    SELECT id, '{' || concat_ws(',', CASE WHEN billing_order IS NOT NULL THEN '"billing_order":' || billing_order END,
           CASE WHEN character_id IS NOT NULL THEN '"character_id":' || character_id END,
           CASE WHEN character_name_raw IS NOT NULL THEN '"character":"' || character_name_raw || '"' END,
           '"job":"' || job || '"') || '}' AS attributes FROM {credit}""")
def edge_attributes(t):
    a = S.edge_attributes(billing_order=c("billing_order"), character_id=c("character_id"), character=c("character_name_raw"), job=c("job"))
    return t.credit.select("id", a.alias("attributes"))


@query("edge_cost", """
    SELECT id, round(1.4E0 * (1 + 0.45 * ln(1 + coalesce(billing_order, 0))) / greatest(coalesce(confidence, 1.0), 0.1), 6) AS cost FROM {credit}""")
def edge_cost(t):
    return t.credit.select("id", F.round(S.edge_cost(F.lit(1.4), c("billing_order"), c("confidence")), 6).alias("cost"))
