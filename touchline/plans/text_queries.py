"""Cleaning, chunking, tagging, question parsing and retrieval queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.functions import vocabulary as words
from touchline.operators import retrieval as ret, text as txt, vector_index
from touchline.plans import views
from touchline.plans.registry import query, rounded
from touchline.plans.stats_queries import tidy
from touchline.session import cut_lineage, new_path


def docs(spark, sf_dir):
    return views.spread(views.table(spark, sf_dir, "documents"))


@query("html_strip", "T1", """
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<iframe[^>]*>.*?</iframe>', '', 'gis'), '<[^>]*>', '', 'g')) AS digest FROM pages""")
def html_strip(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", F.md5(txt.strip_html(F.col("html"))).alias("digest"))


PROMO = """
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  Lire aussi : ' || text WHEN 1 THEN text || chr(10) || 'partager sur le web' || chr(10) || 'fin' ELSE text END AS text FROM documents)"""


def promo_docs(spark, sf_dir):
    slot, text = F.col("doc_id") % 3, F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.when(slot == 0, F.concat(F.lit("  Lire aussi : "), text))
                                      .when(slot == 1, F.concat(text, F.lit("\npartager sur le web\nfin"))).otherwise(text).alias("text"))


@query("promo_lines", "T2", PROMO + """
SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(trim(l), '^(publicité|partager sur|lire aussi|cliquez ici pour|abonnez-vous|suivez-nous sur|inscrivez-vous à|retrouvez l''article original sur)([^\\p{L}\\p{N}_]|$)', 'i')), chr(10))) AS digest FROM t""")
def promo_lines(spark, sf_dir):
    return promo_docs(spark, sf_dir).select("doc_id", F.md5(txt.drop_promo_lines(F.col("text"))).alias("digest"))


TERMS_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bregista\\b', 'milieu reculé', 'gi'), '\\bhalf[ -]spaces?\\b', 'demi-espace', 'gi'), '\\blow[ -]block\\b', 'bloc bas', 'gi'), '\\bgegenpress\\b', 'contre-pressing', 'gi')"""


@query("term_normalisation", "T3", f"""
WITH t AS (SELECT doc_id, 'Un Regista en half space, Low-Block puis GEGENPRESS' || chr(10) || text AS text FROM documents)
SELECT doc_id, md5({TERMS_SQL}) AS digest FROM t""")
def term_normalisation(spark, sf_dir):
    text = F.concat(F.lit("Un Regista en half space, Low-Block puis GEGENPRESS\n"), "text")
    return docs(spark, sf_dir).select("doc_id", F.md5(txt.normalise_terms(text)).alias("digest"))


@query("clean_pipeline", "T1 T2 T3 T4", """
WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<iframe[^>]*>.*?</iframe>', '', 'gis'), '<[^>]*>', '', 'g') AS text FROM pages),
p AS (SELECT page_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(trim(l), '^(publicité|partager sur|lire aussi|cliquez ici pour|abonnez-vous|suivez-nous sur|inscrivez-vous à|retrouvez l''article original sur)([^\\p{L}\\p{N}_]|$)', 'i')), chr(10)) AS text FROM h)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS digest FROM p""")
def clean_pipeline(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", F.md5(txt.clean(F.col("html"))).alias("digest"))


def _chunk_sql(limit: int) -> str:
    return f"""
ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM markdown_v),
l2 AS (SELECT *, regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS s FROM ln),
l3 AS (SELECT *, CASE WHEN s = '' THEN 'b' WHEN starts_with(s, '# ') THEN '1' WHEN starts_with(s, '## ') THEN '2' WHEN starts_with(s, '### ') THEN '3' ELSE 't' END AS k, len(list_filter(regexp_split_to_array(s, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS wc FROM l2),
st AS (SELECT doc_id, 0 AS i, upper(substr(source, 1, 1)) || lower(replace(replace(substr(source, 2), '.md', ''), '_', ' ')) AS h1, '' AS h2, '' AS h3, 0 AS words, 0 AS c, false AS has, -1 AS app FROM (SELECT DISTINCT doc_id, source FROM l3)
 UNION ALL
 SELECT doc_id, i, CASE WHEN k = '1' THEN trim(substr(s, 3)) ELSE h1 END, CASE WHEN k = '1' THEN '' WHEN k = '2' THEN trim(substr(s, 4)) ELSE h2 END, CASE WHEN k IN ('1', '2') THEN '' WHEN k = '3' THEN trim(substr(s, 5)) ELSE h3 END,
   CASE WHEN k = 'b' THEN words WHEN k <> 't' THEN 0 WHEN words + wc >= {limit} THEN 0 ELSE words + wc END, CASE WHEN k IN ('1', '2', '3') AND has THEN c + 1 WHEN k = 't' AND words + wc >= {limit} THEN c + 1 ELSE c END,
   CASE WHEN k = 'b' THEN has WHEN k <> 't' THEN false ELSE words + wc < {limit} END, CASE WHEN k = 't' OR (k = 'b' AND has) THEN c ELSE -1 END
 FROM (SELECT st.doc_id, l3.i, h1, h2, h3, words, c, has, k, s, wc FROM st JOIN l3 ON l3.doc_id = st.doc_id AND l3.i = st.i + 1)),
ch AS (SELECT st.doc_id, app AS chunk_no, any_value(h1) AS h1, any_value(h2) AS h2, any_value(h3) AS h3, regexp_replace(string_agg(line, chr(10) ORDER BY st.i), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS body, any_value(source) AS source FROM st JOIN l3 ON l3.doc_id = st.doc_id AND l3.i = st.i WHERE app >= 0 GROUP BY 1, 2),
full_text AS (SELECT *, '[' || h1 || CASE WHEN h2 <> '' THEN ' > ' || h2 ELSE '' END || CASE WHEN h3 <> '' THEN ' > ' || h3 ELSE '' END || ']' || chr(10) || body AS text FROM ch)"""


@query("header_chunks", "T5 S5 S6", f"""
WITH RECURSIVE {_chunk_sql(350)} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, md5(text) AS digest, CAST(length(text) AS INTEGER) AS n FROM full_text""")
def header_chunks(spark, sf_dir):
    return txt.chunk(views.markdown_documents(spark, sf_dir)).select("doc_id", "chunk_no", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("short_chunks", "T6")
def short_chunks(spark, sf_dir):
    topic, intent, phase = txt.file_topic(F.col("source"))
    return txt.chunk_short(views.markdown_documents(spark, sf_dir)).select("doc_id", "chunk_no", "words", F.md5("text").alias("digest"), topic.alias("topic"), intent.alias("intent"), phase.alias("phase"))


@query("file_topics", "T6", """
WITH s AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'desequilibrer_bloc_bas.md' WHEN 1 THEN 'pressing_haut.md' WHEN 2 THEN 'sortie_balle.md' WHEN 3 THEN 'roles_joueurs.md' WHEN 4 THEN 'formation_433.md' WHEN 5 THEN 'bloc_bas_defensif.md' ELSE source END AS s FROM documents)
SELECT doc_id, CASE s WHEN 'desequilibrer_bloc_bas.md' THEN 'bloc_bas' WHEN 'bloc_bas_defensif.md' THEN 'bloc_bas' WHEN 'pressing_haut.md' THEN 'pressing' WHEN 'sortie_balle.md' THEN 'relance' WHEN 'roles_joueurs.md' THEN 'roles' WHEN 'formation_433.md' THEN 'formations' ELSE 'general' END AS topic,
 CASE s WHEN 'desequilibrer_bloc_bas.md' THEN 'attack' WHEN 'bloc_bas_defensif.md' THEN 'defend' WHEN 'pressing_haut.md' THEN 'transition' WHEN 'sortie_balle.md' THEN 'attack' WHEN 'roles_joueurs.md' THEN 'roles' WHEN 'formation_433.md' THEN 'formations' ELSE 'general' END AS intent,
 CASE s WHEN 'desequilibrer_bloc_bas.md' THEN 'offensive' WHEN 'bloc_bas_defensif.md' THEN 'defensive' WHEN 'pressing_haut.md' THEN 'transition' WHEN 'sortie_balle.md' THEN 'offensive' ELSE 'general' END AS phase FROM s""")
def file_topics(spark, sf_dir):
    names = ["desequilibrer_bloc_bas.md", "pressing_haut.md", "sortie_balle.md", "roles_joueurs.md", "formation_433.md", "bloc_bas_defensif.md"]
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 7).cast("int")), F.col("source"))
    topic, intent, phase = txt.file_topic(name)
    return docs(spark, sf_dir).select("doc_id", topic.alias("topic"), intent.alias("intent"), phase.alias("phase"))


TAGGED = """
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Le PSG face a Arsenal, pressing haut' WHEN 1 THEN 'Real Madrid en bloc bas a la 12e minute' WHEN 2 THEN 'exercice de transition' WHEN 3 THEN 'Ajax 1970 et 4-3-3' WHEN 4 THEN 'un systeme <!-- @time: periode=2MT, intervalle=60-75 -->' ELSE 'rien' END || chr(10) || text AS text FROM documents)"""


def tagged_docs(spark, sf_dir):
    lines = ["Le PSG face a Arsenal, pressing haut", "Real Madrid en bloc bas a la 12e minute", "exercice de transition", "Ajax 1970 et 4-3-3",
             "un systeme <!-- @time: periode=2MT, intervalle=60-75 -->", "rien"]
    head = F.get(F.array(*[F.lit(x) for x in lines]), (F.col("doc_id") % 6).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.concat(head, F.lit("\n"), "text").alias("text"))


TEAM_CASES = ", ".join(f"CASE WHEN regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_]){n}([^\\p{{L}}\\p{{N}}_]|$)', 'i') THEN '{n}' END" for n in words.TEAM_NAMES)


@query("team_tags", "T7", TAGGED + f" SELECT doc_id, concat_ws(',', {TEAM_CASES}) AS teams FROM t")
def team_tags(spark, sf_dir):
    return tagged_docs(spark, sf_dir).select("doc_id", F.array_join(txt.team_tags(F.col("text")), ",").alias("teams"))


@query("tactical_tags", "T8", TAGGED + """
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(l, 'pressing|gegenpress|harcèlement|pression') THEN 'pressing' END, CASE WHEN regexp_matches(l, 'bloc bas|low-block|low block|défense basse|compacite|repli') THEN 'low-block' END,
 CASE WHEN regexp_matches(l, 'bloc médian|mid-block|bloc moyen|coulissement') THEN 'mid-block' END, CASE WHEN regexp_matches(l, 'attaque|offensive|possession|construction|centres|finition|déséquilibrer|animation|passes') THEN 'offense' END,
 CASE WHEN regexp_matches(l, 'défense|défensif|coulissement|zone|rest defense|marquage|hors-jeu') THEN 'defense' END, CASE WHEN regexp_matches(l, 'transition|contre-attaque|repli|perte|récupération') THEN 'transition' END,
 CASE WHEN regexp_matches(l, '4-3-3|4-4-2|3-5-2|3-4-3|4-2-3-1|3-2-4-1|5-4-1|4-1-4-1') THEN 'formation' END, CASE WHEN regexp_matches(l, 'faux 9|faux-9|sentinelle|piston|gardien-libéro|sweeper keeper|ailier inversé|latéral inversé|wingback') THEN 'player-role' END) AS tags FROM (SELECT doc_id, lower(text) AS l FROM t)""")
def tactical_tags(spark, sf_dir):
    return tagged_docs(spark, sf_dir).select("doc_id", F.array_join(txt.tactical_tags(F.col("text")), ",").alias("tags"))


@query("chunk_types", "T9", TAGGED + """
SELECT doc_id, CASE WHEN regexp_matches(l, 'exercice|entrainement|entraînement|consignes|dimensions|règles de jeu') THEN 'exercice' WHEN regexp_matches(l, 'match|rencontre|score|buts|minutes|mi-temps') THEN 'match'
  WHEN regexp_matches(l, 'historique|sacchi|cruyff|années|siecle|histoire|ajax 1970') THEN 'historique' WHEN regexp_matches(l, 'tactique|formation|principe|rôle|role|système') THEN 'tactique' ELSE 'general' END AS type FROM (SELECT doc_id, lower(text) AS l FROM t)""")
def chunk_types(spark, sf_dir):
    return tagged_docs(spark, sf_dir).select("doc_id", txt.chunk_type(F.col("text"), F.lit(""), F.lit("")).alias("type"))


@query("time_tags", "T10 P13", TAGGED + """,
m AS (SELECT doc_id, text, regexp_extract(text, '@time: periode=(\\w+)', 1) AS p, regexp_extract(text, 'intervalle=([\\w+-]+)', 1) AS iv, TRY_CAST(regexp_extract(text, '\\b(\\d{1,3})(?:e|ème)?\\s*(?:minute|min|'')', 1, 'i') AS INTEGER) AS mi, doc_id % 2 = 1 AS is_match FROM t)
SELECT doc_id, CASE WHEN p <> '' THEN p WHEN is_match AND mi IS NOT NULL THEN CASE WHEN mi <= 45 THEN '1MT' ELSE '2MT' END ELSE 'global' END AS period,
 CASE WHEN p <> '' THEN iv WHEN is_match AND mi IS NOT NULL THEN CASE WHEN mi <= 15 THEN '0-15' WHEN mi <= 30 THEN '15-30' WHEN mi <= 45 THEN '30-45' WHEN mi <= 60 THEN '45-60' WHEN mi <= 75 THEN '60-75' WHEN mi <= 90 THEN '75-90' ELSE '90+' END ELSE 'all' END AS interval FROM m""")
def time_tags(spark, sf_dir):
    source = F.when(F.col("doc_id") % 2 == 1, "match_report.md").otherwise("notes.md")
    period, interval = txt.time_tags(F.col("text"), source)
    return tagged_docs(spark, sf_dir).select("doc_id", period.alias("period"), interval.alias("interval"))


@query("match_reports", "T11 S10", """
WITH r AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders)
SELECT k AS report_id, CASE WHEN k % 4 <> 0 THEN strftime(d, '%Y_%m_%d') ELSE '2026_06_09' END || '_team' || (k * 7) % 20 || '_side' || (k * 3) % 20 || '_01' AS match_id, CAST(k % 5 AS INTEGER) AS score_home, CAST(k % 3 AS INTEGER) AS score_away,
 CASE WHEN k % 5 = 0 THEN 'Coupe' ELSE 'Ligue 1' END AS competition, CAST(k % 100 AS INTEGER) AS home_possession, 50 AS away_possession, round((k % 4) + (k % 10) / 10.0, 6)::DOUBLE AS home_xg, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS events, 'goal' AS first_event FROM r""")
def match_reports(spark, sf_dir):
    parsed = txt.parse_match_report(views.match_reports(spark, sf_dir))
    return parsed.select("report_id", "match_id", "score_home", "score_away", "competition", F.col("team_stats")[F.col("home")]["possession_pct"].alias("home_possession"),
                         F.col("team_stats")[F.col("away")]["possession_pct"].alias("away_possession"), rounded(F.col("team_stats")[F.col("home")]["xg"]).alias("home_xg"),
                         F.size("events").alias("events"), F.get("events", F.lit(0))["type"].alias("first_event"))


@query("vector_top_k_index", "O4")
def vector_top_k_index(spark, sf_dir):
    """Ten best of every fiftieth vector by the inverted file; payload ``label`` is kept with the vectors."""
    e = views.table(spark, sf_dir, "embeddings")
    index = vector_index.build(e, f"cells_{uuid.uuid4().hex}", new_path(spark, "cells"), "vec_id", "embedding", ["label"])
    found = vector_index.search(index, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", F.col("id").alias("vec_id"), rounded(F.col("score")).alias("score"), "rank")


def _interval_sql(m: str) -> str:
    return f"CASE WHEN {m} <= 15 THEN '0-15' WHEN {m} <= 30 THEN '15-30' WHEN {m} <= 45 THEN '30-45' WHEN {m} <= 60 THEN '45-60' WHEN {m} <= 75 THEN '60-75' WHEN {m} <= 90 THEN '75-90' ELSE '90+' END"


def _event_sql(m: str, text: str) -> str:
    return f"'### Événement : ' || ({m}) || 'ème minute' || chr(10) || '{text} <!-- @time: periode=' || CASE WHEN {m} <= 45 THEN '1MT' ELSE '2MT' END || ', intervalle=' || {_interval_sql(m)} || ' -->'"


@query("match_markdown", "T12", f"""
WITH r AS (SELECT o_orderkey AS k, o_orderdate AS d, 'Team' || (o_orderkey * 7) % 20 AS h, 'Side' || (o_orderkey * 3) % 20 AS a, chr(10) || chr(10) AS gap FROM orders),
t AS (SELECT k, CASE WHEN k % 4 <> 0 THEN strftime(d, '%Y_%m_%d') ELSE '2026_06_09' END || '_' || lower(h) || '_' || lower(a) || '_01' AS match_id,
 '# Match: ' || h || ' vs ' || a || ' (' || k % 5 || ' - ' || k % 3 || ')' || gap || '## Construction & Sortie' || chr(10) || 'Le ' || h || ' a complété ' || k % 700 || ' passes dont 30 progressives; l' || chr(39) || a || ' 400 dont 30.' || gap
 || '## Organisation Offensive' || chr(10) || 'Le ' || h || ': ' || k % 20 || ' tirs, 4 cadrés, ' || k % 4 || '.' || k % 10 || '0 xG; l' || chr(39) || a || ': 10 tirs, 4 cadrés, 1.00 xG.' || gap
 || '## Organisation Défensive' || chr(10) || 'Le ' || h || ' en low-block (PPDA 10.0); l' || chr(39) || a || ' en medium-block (PPDA 10.0).' || gap || '## Analyse Chronologique des Événements' || gap
 || {_event_sql('k % 95 + 1', 'But de la tete')} || CASE WHEN k % 2 = 0 THEN gap || {_event_sql('k % 60 + 1', 'Transition rapide')} ELSE '' END AS md FROM r)
SELECT k AS report_id, match_id, md5(md) AS digest, CAST(length(md) AS INTEGER) AS n FROM t""")
def match_markdown(spark, sf_dir):
    return txt.render_match(txt.parse_match_report(views.match_reports(spark, sf_dir))).select("report_id", "match_id", F.md5("markdown").alias("digest"), F.length("markdown").alias("n"))


@query("question_targets", "T13 O11", """
WITH q AS (SELECT query_id, slot, lower(query) AS l FROM questions_v),
a AS (SELECT * FROM (VALUES (1, 'inter', ['inter']), (2, 'man city', ['manchester_city', 'man_city', 'manchester']), (3, 'manchester', ['manchester_city', 'man_city', 'manchester']), (4, 'city', ['manchester_city', 'man_city', 'manchester']), (5, 'arsenal', ['arsenal']), (6, 'liverpool', ['liverpool']), (7, 'brest', ['brestois', 'brest']),
 (8, 'aston villa', ['aston_villa', 'aston']), (9, 'stuttgart', ['vfb_stuttgart', 'stuttgart']), (10, 'salzburg', ['salzburg']), (11, 'marseille', ['marseille']), (12, 'monaco', ['monaco']), (13, 'girona', ['girona']), (14, 'atletico', ['atletico']), (15, 'psv', ['psv']), (16, 'bayern', ['bayern'])) AS v(o, alias, slugs)),
h AS (SELECT query_id, string_agg(DISTINCT s, ',' ORDER BY s) AS teams FROM (SELECT query_id, unnest(slugs) AS s FROM q JOIN a ON contains(l, alias)) GROUP BY 1)
SELECT q.query_id, coalesce(teams, '') AS teams, CASE WHEN contains(l, 'ucl') OR contains(l, 'ldc') OR contains(l, 'ligue des champions') OR contains(l, 'champions league') THEN 'champions' WHEN contains(l, 'ligue 1') OR contains(l, 'l1') THEN 'ligue_1' WHEN contains(l, 'coupe') THEN 'coupe' END AS competition,
 array_to_string(list_filter(['vitinha', 'dembele', 'barcola', 'donnarumma', 'hakimi', 'ruiz'], lambda p: contains(l, p)), ',') AS players FROM q LEFT JOIN h ON h.query_id = q.query_id""")
def question_targets(spark, sf_dir):
    teams, competition, players = txt.targets(F.col("query"))
    return views.questions(spark, sf_dir).select("query_id", F.array_join(F.array_sort(teams), ",").alias("teams"), competition.alias("competition"), F.array_join(players, ",").alias("players"))


@query("question_expansion", "T14", """
WITH q AS (SELECT query_id, query, lower(query) AS l FROM questions_v),
m AS (SELECT *, TRY_CAST(regexp_extract(l, '\\b(\\d{1,3})(?:e|ème)?\\s*(?:minute|min|''|è)', 1) AS INTEGER) AS mi, regexp_matches(l, '1mt|première mi-temps|premiere mi-temps|début de match|debut de match|premières minutes|premieres minutes') AS f1, regexp_matches(l, '2mt|deuxième mi-temps|deuxieme mi-temps|fin de match|dernières minutes|dernieres minutes') AS f2,
  regexp_matches(l, 'début de match|debut de match|premières minutes') AS op, regexp_matches(l, 'fin de match|dernières minutes') AS cl,
  list_filter(['pressing', 'contre-pressing', 'bloc bas', 'bloc median', 'low-block', 'transition', 'possession', 'lateral', 'ailier'], lambda w: contains(l, w)) AS kw, list_filter(['psg', 'paris', 'om', 'marseille', 'real', 'madrid', 'barca', 'barcelone'], lambda w: contains(l, w)) AS tm FROM q)
SELECT query_id, CASE WHEN f1 THEN '1MT' WHEN f2 THEN '2MT' WHEN contains(l, 'prolongation') THEN 'prolongations' WHEN mi IS NOT NULL THEN CASE WHEN mi <= 45 THEN '1MT' ELSE '2MT' END WHEN op THEN '1MT' WHEN cl THEN '2MT' ELSE 'global' END AS period,
 CASE WHEN mi IS NOT NULL THEN CASE WHEN mi <= 15 THEN '0-15' WHEN mi <= 30 THEN '15-30' WHEN mi <= 45 THEN '30-45' WHEN mi <= 60 THEN '45-60' WHEN mi <= 75 THEN '60-75' WHEN mi <= 90 THEN '75-90' ELSE '90+' END WHEN op THEN '0-15' WHEN cl THEN '60-75' ELSE 'all' END AS interval,
 CASE WHEN len(kw) > 0 THEN 3 ELSE 2 END AS wordings, CASE WHEN len(kw) > 0 AND len(tm) > 0 THEN array_to_string(tm, ' ') || ' ' || array_to_string(kw, ' ') WHEN len(kw) > 0 THEN kw[1] || ' tactique' ELSE query || ' tactique football' END AS second FROM m""")
def question_expansion(spark, sf_dir):
    return txt.expand(views.questions(spark, sf_dir)).select("query_id", "period", "interval", F.size("variations").alias("wordings"), F.get("variations", F.lit(1)).alias("second"))


@query("question_classes", "T15")
def question_classes(spark, sf_dir):
    return txt.classify(views.questions(spark, sf_dir)).drop("query")


@query("question_scope", "T15", """
SELECT query_id, CASE WHEN slot = 2 THEN 'greeting' WHEN slot = 3 THEN 'out_of_scope' WHEN slot = 4 THEN 'unsupported_metric' WHEN slot IN (0, 1, 6, 9) THEN 'video_tactical_query' ELSE 'tactical_question' END AS type,
 CASE slot WHEN 0 THEN 'MATCH_EXPLANATION' WHEN 1 THEN 'MATCH_TIMELINE' WHEN 3 THEN 'UNSUPPORTED' WHEN 4 THEN 'UNSUPPORTED' WHEN 6 THEN 'MATCH_FACT' WHEN 9 THEN 'MATCH_COMPARISON' ELSE 'GENERAL_FOOTBALL' END AS scope,
 CASE slot WHEN 1 THEN 'TEAM_0' WHEN 9 THEN 'TEAM_1' END AS team, CASE WHEN slot = 1 THEN 12.4::DOUBLE END AS at_s, CASE WHEN slot = 0 THEN 2.5::DOUBLE END AS from_s, CASE WHEN slot = 0 THEN 6.0::DOUBLE END AS to_s, CASE WHEN slot = 6 THEN 145::BIGINT END AS at_frame,
 CASE slot WHEN 5 THEN '4-3-3' WHEN 10 THEN '4-4-2' END AS formation FROM questions_v""")
def question_scope(spark, sf_dir):
    return txt.classify(views.questions(spark, sf_dir)).select("query_id", "type", "scope", "team", "at_s", "from_s", "to_s", "at_frame", "formation")


@query("tokeniser", "T16", "SELECT doc_id, CAST(len(toks) AS INTEGER) AS n, md5(array_to_string(toks, ' ')) AS digest FROM doc_tokens_v")
def tokeniser(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ret.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("term_statistics", "A23", """
WITH p AS (SELECT doc_id, unnest(toks) AS token FROM doc_tokens_v) SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM p GROUP BY 1""")
def term_statistics(spark, sf_dir):
    return ret.postings(docs(spark, sf_dir)).groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


TOP_SQL = """
WITH c AS (SELECT query_id, doc_id, round(coalesce(score, 0.0), 9) AS score FROM (SELECT query_id, doc_id FROM search_v, documents) LEFT JOIN {view} USING (query_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)"""


@query("bm25_top50", "T17 O5", TOP_SQL.format(view="bm25_v") + """
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50""")
def bm25_top50(spark, sf_dir):
    d, q = docs(spark, sf_dir), views.search_queries(spark, sf_dir)
    return tidy(ret.bm25_top(d, q, 50))


@query("tfidf_weights", "T18", "SELECT doc_id, token, round(weight, 6) AS weight FROM tfidf_v")
def tfidf_weights(spark, sf_dir):
    return tidy(ret.tfidf_weights(docs(spark, sf_dir)))


@query("tfidf_top300", "T18", TOP_SQL.format(view="tfidf_scores_v") + """
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 300""")
def tfidf_top300(spark, sf_dir):
    d, q = docs(spark, sf_dir), views.search_queries(spark, sf_dir)
    return tidy(ret.tfidf_top(d, q, 300))


HYBRID_SQL = """
WITH cs AS (SELECT query_id, doc_id, round(coalesce(score, 0.0), 9) AS score FROM (SELECT query_id, doc_id FROM search_v, documents) LEFT JOIN tfidf_scores_v USING (query_id, doc_id)),
cl AS (SELECT query_id, doc_id, round(coalesce(score, 0.0), 9) AS score FROM (SELECT query_id, doc_id FROM search_v, documents) LEFT JOIN bm25_v USING (query_id, doc_id)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM cs) WHERE rk <= 300), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM cl) WHERE rk <= 50),
sn AS (SELECT query_id, doc_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1.0 END AS v FROM s WINDOW w AS (PARTITION BY query_id)),
lnm AS (SELECT query_id, doc_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1.0 END AS v FROM l WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT coalesce(sn.query_id, lnm.query_id) AS query_id, coalesce(sn.doc_id, lnm.doc_id) AS doc_id, 0.7 * coalesce(sn.v, 0.0) + 0.3 * coalesce(lnm.v, 0.0) AS hybrid FROM sn FULL OUTER JOIN lnm ON sn.query_id = lnm.query_id AND sn.doc_id = lnm.doc_id)"""


def _hybrid(spark, sf_dir):
    def build(s, d):
        corpus, q = docs(s, d), views.search_queries(s, d)
        return ret.hybrid(ret.tfidf_top(corpus, q, ret.SEMANTIC_POOL), ret.bm25_top(corpus, q, ret.LEXICAL_POOL))
    return views.shared("hybrid", spark, sf_dir, build)


@query("hybrid_scores", "T19 J21", HYBRID_SQL + " SELECT query_id, doc_id, round(hybrid, 6) AS hybrid FROM h")
def hybrid_scores(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "doc_id", rounded(F.col("hybrid")).alias("hybrid"))


@query("rerank_with_parents", "T21 J17", HYBRID_SQL + """
SELECT query_id, doc_id, CAST(rn AS INTEGER) AS final_rank, source AS parent_source, CAST(length(coalesce(text, '')) AS INTEGER) AS parent_chars FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid, 9) DESC, doc_id) AS rn FROM h) x LEFT JOIN (SELECT doc_id AS pd, source, text FROM documents WHERE doc_id % 4 <> 0) p ON pd = doc_id WHERE rn <= 5""")
def rerank_with_parents(spark, sf_dir):
    parents = docs(spark, sf_dir).filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("parent_id"), F.col("source").alias("parent_source"), F.col("text").alias("parent_text"))
    pool = _hybrid(spark, sf_dir).withColumn("parent_id", F.col("doc_id")).withColumn("hybrid", F.round("hybrid", 9))
    return ret.rerank_cut(pool, parents).select("query_id", "doc_id", "final_rank", "parent_source", F.length("parent_text").alias("parent_chars"))


@query("merged_variations", "O13", HYBRID_SQL + """,
v AS (SELECT query_id // 2 AS query_id, doc_id, query_id % 2 AS variation, round(hybrid, 9) AS hybrid FROM h)
SELECT query_id, doc_id, round(hybrid, 6) AS hybrid, variation FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hybrid DESC, variation) AS rn FROM v) WHERE rn = 1""")
def merged_variations(spark, sf_dir):
    two = _hybrid(spark, sf_dir).select(F.expr("query_id div 2").alias("query_id"), "doc_id", (F.col("query_id") % 2).alias("variation"), F.round("hybrid", 9).alias("hybrid"))
    return tidy(ret.merge_variations(two))


@query("vector_top_k", "O4 P37", """
WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(qe::DOUBLE[], embedding::DOUBLE[]) AS score FROM q JOIN embeddings ON label = ql)
SELECT query_id, vec_id, round(score, 5) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10""")
def vector_top_k(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("payload"))
    asked = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return tidy(ret.vector_top_k(asked, rows, 10, filtered=True), 5)


@query("cosine_similarity", "P37", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", rounded(ret.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@query("metadata_filter", "P20", TAGGED + """
SELECT doc_id FROM t WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(PSG|Ajax)([^\\p{L}\\p{N}_]|$)', 'i')""")
def metadata_filter(spark, sf_dir):
    tagged = tagged_docs(spark, sf_dir).withColumn("teams", txt.team_tags(F.col("text")))
    return tagged.filter(ret.metadata_match(F.col("teams"), F.array(F.lit("PSG"), F.lit("Ajax")))).select("doc_id")


@query("source_support", "T22", """
WITH s AS (SELECT item_id AS query_id, doc_id, unnest(toks) AS token FROM benchmark JOIN doc_tokens_v ON doc_id = item_id),
f AS (SELECT query_id, unnest(list_concat([token, replace(token, '-', '')], string_split(token, '-'))) AS token FROM s), q AS (SELECT query_id, unnest(toks) AS token FROM query_tokens_v)
SELECT query_id, EXISTS (SELECT 1 FROM q JOIN f ON f.query_id = q.query_id AND f.token = q.token WHERE q.query_id = v.query_id AND q.token NOT IN ('le', 'la', 'les', 'de', 'des', 'un', 'une', 'du', 'en', 'pour', 'dans', 'avec', 'est', 'sont', 'ce', 'que', 'qui', 'qu', 'comment', 'pourquoi', 'quelle', 'quelles', 'quel', 'quels', 'explique', 'expliques', 'moi', 'nous', 'vous', 'je', 'tu', 'il', 'elle', 'ils', 'elles',
 'mon', 'ton', 'son', 'ma', 'ta', 'sa', 'mes', 'tes', 'ses', 'et', 'ou', 'mais', 'donc', 'or', 'ni', 'car', 'sur', 'se', 'ces', 'cette', 'cet', 'par', 'aux', 'au', 'aussi', 'faire', 'fait', 'ont', 'avoir', 'etre', 'être')) AS supported FROM search_v v""")
def source_support(spark, sf_dir):
    sources = docs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "text")
    return ret.supported(views.search_queries(spark, sf_dir), sources)


@query("intent_boosts", "T20")
def intent_boosts(spark, sf_dir):
    questions = txt.classify(views.questions(spark, sf_dir)).select("query_id", "intent", "phase", "formation", "problem", "game_phase", "goal")
    chunks = txt.chunk_short(views.markdown_documents(spark, sf_dir))
    topic, intent, phase = txt.file_topic(F.col("source"))
    chunks = chunks.select("doc_id", "chunk_no", "text", "source", topic.alias("topic"), intent.alias("chunk_intent"), phase.alias("chunk_phase"))
    pairs = questions.withColumn("doc_id", F.expr("query_id div 1000")).join(chunks, "doc_id").withColumn("score", F.lit(0.2))
    return tidy(ret.boosted(pairs).select("query_id", "doc_id", "chunk_no", "unclamped", "display"))


@query("match_context", "O15", f"""
WITH RECURSIVE {_chunk_sql(350)} SELECT doc_id, count(*) AS chunks, any_value(source) AS title, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_no)) AS digest FROM full_text GROUP BY 1""")
def match_context(spark, sf_dir):
    return ret.match_context(txt.chunk(views.markdown_documents(spark, sf_dir))).select("doc_id", "chunks", "title", F.md5("body").alias("digest"))


@query("parent_replacement", "S20", """
SELECT doc_id AS parent_id, lang AS origin FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'second' FROM documents WHERE doc_id % 10 = 0""")
def parent_replacement(spark, sf_dir):
    stored = docs(spark, sf_dir).select(F.col("doc_id").alias("parent_id"), F.col("lang").alias("origin"))
    fresh = docs(spark, sf_dir).filter("doc_id % 5 = 0").select(F.col("doc_id").alias("parent_id"), F.lit("new").alias("origin"))
    again = docs(spark, sf_dir).filter("doc_id % 10 = 0").select(F.col("doc_id").alias("parent_id"), F.lit("second").alias("origin"))
    return ret.replace_parents(stored, fresh.unionByName(again))


@query("query_relaxation", "O10", TOP_SQL.format(view="tfidf_scores_v") + """,
pool AS (SELECT query_id, doc_id FROM r WHERE rank <= 150), k AS (SELECT query_id, doc_id, query_id % 40 = doc_id % 40 AND lang = 'fr' AS wanted FROM search_v JOIN documents ON true),
want AS (SELECT query_id, doc_id, 1 AS stage FROM pool JOIN k USING (query_id, doc_id) WHERE wanted),
wide AS (SELECT query_id, doc_id, 2 AS stage FROM k WHERE wanted AND query_id NOT IN (SELECT query_id FROM want)),
loose AS (SELECT query_id, doc_id, 3 AS stage FROM pool WHERE query_id NOT IN (SELECT query_id FROM want UNION SELECT query_id FROM wide))
SELECT * FROM want UNION ALL SELECT * FROM wide UNION ALL SELECT * FROM loose""")
def query_relaxation(spark, sf_dir):
    """The target filter over the 150 best hits of a question, else over the whole corpus, else all 150 hits."""
    d, q = docs(spark, sf_dir), views.search_queries(spark, sf_dir)
    pool = cut_lineage(ret.tfidf_top(d, q, 150).select("query_id", "doc_id"))
    target = d.select("doc_id", "lang", (F.col("doc_id") % 40).alias("slot"))
    near = pool.join(target, "doc_id").withColumn("wanted", (F.col("lang") == "fr") & (F.col("slot") == F.col("query_id") % 40))
    wide = q.select("query_id", (F.col("query_id") % 40).alias("slot")).join(target.filter("lang = 'fr'"), "slot").select("query_id", "doc_id")
    return ret.staged_fallback(near.select("query_id", "doc_id", "wanted"), F.col("wanted"), wide.withColumn("wanted", F.lit(True)), near.select("query_id", "doc_id", "wanted")).select("query_id", "doc_id", "stage")


@query("html_stat_rows", "S9", """
SELECT page_id, 'Player ' || page_id AS player_name, CAST(page_id % 90 AS INTEGER) AS minutes_played, CAST(page_id % 4 AS INTEGER) AS goals, round((page_id % 30) / 10.0, 6)::DOUBLE AS expected_goals, 0 AS key_passes FROM pages""")
def html_stat_rows(spark, sf_dir):
    pid = F.col("page_id").cast("string")
    cells = F.concat(F.lit("<table><tr><th>Player</th><th>Min</th><th>Gls</th><th>xG</th></tr><tr><td>Player "), pid, F.lit("</td><td>"), (F.col("page_id") % 90).cast("string"),
                     F.lit("</td><td>"), (F.col("page_id") % 4).cast("string"), F.lit("</td><td>"), (F.col("page_id") % 30 / F.lit(10.0)).cast("string"),
                     F.lit("</td></tr><tr><td>Squad Totals</td><td>990</td><td>1</td><td>1</td></tr></table>"))
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.concat("html", cells).alias("html"))
    return tidy(txt.html_stat_rows(pages).select("page_id", "player_name", "minutes_played", "goals", "expected_goals", "key_passes"))


@query("text_embedding", "P23")
def text_embedding(spark, sf_dir):
    e = docs(spark, sf_dir).select("doc_id", ret.test_embedding(F.col("text")).alias("e"))
    return e.select("doc_id", F.size("e").alias("size"), rounded(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v), 9).alias("norm"))
